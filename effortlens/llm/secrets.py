"""Secrets in texts: fixed patterns, and character Markov models.

Two first-order Markov models of characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples. Along a run of key
characters, or what base spans leave of it, the log-likelihood ratio of the two
is summed; a stretch is a secret when its sum is high, whatever stands before
and behind it. Everything is column expressions; the model is a constant array
in them.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.session import materialise

KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Shorter runs fail by length, and a run is left whole either way, so the length stands in the pattern.
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"([0-9a-f]{32,})"
# Characters of the shortest run, and of the shortest span, that the models judge.
LEAST = 20
CANDIDATE = r"([A-Za-z0-9+/_=-]{%d,})" % LEAST
IDENTIFIER = r"([A-Za-z0-9+/_=-]{8,})"
# Without the slash: it parts paths, and pairs with it tell nothing of either side.
ALPHABET = string.ascii_letters + string.digits + "+_=-."
SEPARATORS = "/_=+-"
# Log-likelihood ratio, in nats, above which a stretch is taken for random; more where ordinary strings
# held out of the fit have more: at most one in a thousand of those may pass.
THRESHOLD = 12.0
PASSING = 0.001
# A stretch ends where its sum has fallen by so much.
DROP = 12.0
# Weight, in pairs, of a character's own probability in that of a pair.
PRIOR = 10.0

_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _found(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """Spans of all matches whose group 1 has `least` characters, in code points; end is exclusive."""
    steps = F.zip_with(
        F.zip_with(
            F.split(text, pattern, -1),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda gap, whole: F.struct(F.length(gap).alias("gap"), F.length(whole).alias("size")),
        ),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        lambda step, value: F.struct(step["gap"].alias("gap"), step["size"].alias("size"), value.alias("value")),
    )
    rank = F.lit(KINDS.index(kind))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end = start + step["size"]
        span = F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), step["value"].alias("value"))
        return F.struct(
            end.alias("at"),
            F.when(F.length(step["value"]) >= least, F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    matches = F.filter(steps, lambda s: s["size"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(matches, empty, add, lambda s: s["spans"])).otherwise(
        F.array().cast(_SPAN)
    )


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    return F.array_sort(
        F.concat(_found(text, ASSIGN, "assign", 8), _found(text, ACCESS, "access"), _found(text, HEX, "hex"))
    )


def candidate_spans(text: Column) -> Column:
    return _found(text, CANDIDATE, "markov")


def fit(samples: DataFrame) -> list[float]:
    """Log-ratio table of character pairs from `samples` (value, secret 0/1), random over ordinary.

    Cell a * len(ALPHABET) + b holds log P(b | a, random) - log P(b | a, ordinary).
    A pair's probability is its count plus PRIOR times the probability of b alone
    (counts plus one), so rare contexts fall back on single characters. Null
    values and characters outside the alphabet are ignored; without samples all
    cells are zero.
    """
    n = len(ALPHABET)
    pair = F.explode(
        F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    ).alias("pair")
    counts = (
        samples.where(F.length("value") >= 2)
        .select("secret", pair)
        .where(F.col("pair").rlike(f"^[{ALPHABET[:-2]}.-]{{2}}$"))
        .groupBy("secret", "pair")
        .count()
    )
    table = [[[0.0] * n for _ in range(n)] for _ in range(2)]
    for row in counts.collect():  # 2 * len(ALPHABET)^2 rows at most
        a, b = (ALPHABET.index(c) for c in row["pair"])
        table[int(row["secret"])][a][b] += row["count"]
    singles = [[1 + sum(line[b] for line in side) for b in range(n)] for side in table]

    def log_probability(side: int, a: int, b: int) -> float:
        alone = singles[side][b] / sum(singles[side])
        return math.log((table[side][a][b] + PRIOR * alone) / (sum(table[side][a]) + PRIOR))

    return [log_probability(1, a, b) - log_probability(0, a, b) for a in range(n) for b in range(n)]


def _bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pair_ratios(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratios of a string's character pairs, in order; zero with a character outside the alphabet."""
    n = len(ALPHABET)
    cells = F.split(F.lit(",".join(f"{x:.9g}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def ratios(places: Column) -> Column:
        def one(i: Column) -> Column:
            a, b = F.element_at(places, i), F.element_at(places, i + 1)
            return F.when((a > 0) & (b > 0), F.element_at(cells, (a - 1) * n + b)).otherwise(F.lit(0.0))

        steps = F.when(F.size(places) > 1, F.sequence(F.lit(1), F.size(places) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, one)

    return _bound(codes, ratios)


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a whole string."""
    return F.aggregate(_pair_ratios(value, model), F.lit(0.0), lambda s, x: s + x)


def stretches(value: Column, model: list[float], threshold: float) -> Column:
    """Stretches (start, end, score) of a string that score above `threshold`, in order.

    The sum of the ratios starts at a pair, ends where it is zero or less or DROP
    under its highest, and starts anew behind; a stretch reaches to the highest.
    """
    kind = "array<struct<start:int,end:int,score:double>>"

    def closed(s: Column) -> Column:
        found = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["top"].alias("score"))
        return F.when(s["top"] > threshold, F.concat(s["found"], F.array(found))).otherwise(s["found"])

    def add(s: Column, x: Column) -> Column:
        total = s["sum"] + x
        over = (total <= 0) | (total < s["top"] - DROP)
        higher = total > s["top"]
        place = s["at"] + 1
        zero = F.lit(0.0)
        return F.struct(
            place.alias("at"),
            F.when(over, place).otherwise(s["start"]).alias("start"),
            F.when(higher, place + 1).otherwise(s["end"]).alias("end"),
            F.when(over, zero).otherwise(total).alias("sum"),
            F.when(over, zero).when(higher, total).otherwise(s["top"]).alias("top"),
            F.when(over, closed(s)).otherwise(s["found"]).alias("found"),
        )

    zero = F.lit(0)
    start = F.struct(
        zero.alias("at"), zero.alias("start"), zero.alias("end"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"),
        F.array().cast(kind).alias("found"),
    )
    return F.aggregate(_pair_ratios(value, model), start, add, closed)


def fit_threshold(ordinary: DataFrame, model: list[float]) -> float:
    """The score that one in 1 / PASSING of the ordinary strings (value) passes, THRESHOLD at least.

    The exact percentile, between the two scores around it; only the highest one in 1 / PASSING are sorted out.
    """
    best = F.coalesce(F.array_max(F.transform(stretches(F.col("value"), model, 0.0), lambda s: s["score"])), F.lit(0.0))
    n = ordinary.count()
    if not n:
        return THRESHOLD
    place = (n - 1) * (1 - PASSING)
    low = math.floor(place)
    highest = ordinary.select(best.alias("score")).orderBy(F.desc("score")).limit(n - low)
    around = [r["score"] for r in highest.orderBy("score").limit(2).collect()]
    limit = around[0] if place == low else (low + 1 - place) * around[0] + (place - low) * around[-1]
    return max(THRESHOLD, limit)


def _beside(candidate: Column, base: Column) -> Column:
    """Parts (start, value) of a candidate that no base span covers, of LEAST characters or more."""
    kind = "array<struct<start:int,value:string>>"

    def part(s: Column, end: Column) -> Column:
        value = F.substring(candidate["value"], s["at"] - candidate["start"] + 1, end - s["at"])
        one = F.struct(s["at"].alias("start"), value.alias("value"))
        return F.when(end - s["at"] >= LEAST, F.concat(s["parts"], F.array(one))).otherwise(s["parts"])

    def add(s: Column, b: Column) -> Column:
        return F.struct(F.greatest(s["at"], b["end"]).alias("at"), part(s, b["start"]).alias("parts"))

    own = F.filter(base, lambda b: (b["start"] < candidate["end"]) & (candidate["start"] < b["end"]))
    start = F.struct(candidate["start"].alias("at"), F.array().cast(kind).alias("parts"))
    return F.aggregate(own, start, add, lambda s: part(s, candidate["end"]))


def _random_spans(part: Column, model: list[float], threshold: float) -> Column:
    """Spans of a part's stretches, each widened to the separators around it, so that no rest of a secret stays."""
    alike = "/" * len(SEPARATORS)

    def span(start: Column, end: Column) -> Column:
        value = F.substring(part["value"], start + 1, end - start)
        return F.struct(
            (part["start"] + start).alias("start"), F.lit(KINDS.index("markov")).alias("rank"),
            (part["start"] + end).alias("end"), value.alias("value"),
        )

    def widened(s: Column) -> Column:
        left = F.translate(F.substring(part["value"], F.lit(1), s["start"]), SEPARATORS, alike)
        right = F.translate(F.substring(part["value"], s["end"] + 1, F.length(part["value"])), SEPARATORS, alike)
        return F.struct(
            (s["start"] - F.length(F.substring_index(left, "/", -1))).alias("start"),
            (s["end"] + F.length(F.substring_index(right, "/", 1))).alias("end"),
        )

    def join(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(s["start"] < last["end"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))).otherwise(
            F.concat(out, F.array(s))
        )

    found = F.transform(stretches(part["value"], model, threshold), widened)
    whole = F.aggregate(found, F.array().cast("array<struct<start:int,end:int>>"), join)
    return F.transform(F.filter(whole, lambda s: s["end"] - s["start"] >= LEAST), lambda s: span(s["start"], s["end"]))


def all_spans(base: Column, candidates: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Base spans, and the stretches beside them that look random."""
    parts = F.flatten(F.transform(candidates, lambda c: _beside(c, base)))
    found = F.flatten(F.transform(parts, lambda p: _random_spans(p, model, threshold)))
    return F.when(F.size(candidates) > 0, F.array_sort(F.concat(base, found))).otherwise(base)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) for every row, written to the shared folder. A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return materialise(
        docs.select("doc_id", text.alias("text")).select(
            "doc_id", base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("candidates")
        ),
        "secrets-scan",
    )


def labelled_samples(docs: DataFrame, scanned: DataFrame, base: Column | None = None) -> DataFrame:
    """(value, secret): every string that the fixed patterns find, against every ordinary one of documents without any, each once.

    `base` are the base spans of `docs`, where they are known; else they are looked for.
    """
    random = scanned.where(F.size("base") > 0).select(F.explode(F.transform("base", lambda s: s["value"])).alias("value"))
    text = F.coalesce("text", F.lit(""))
    plain = docs.where(F.size(base_spans(text) if base is None else base) == 0)
    ordinary = plain.select(F.explode(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1))).alias("value"))
    return random.distinct().withColumn("secret", F.lit(1)).unionByName(ordinary.distinct().withColumn("secret", F.lit(0)))


def learn(docs: DataFrame, scanned: DataFrame, base: Column | None = None) -> tuple[list[float], float]:
    """(model, threshold); a fifth of the ordinary strings, by hash, is held out of the model for the threshold."""
    samples = materialise(labelled_samples(docs, scanned, base), "secrets-samples")
    held = (F.col("secret") == 0) & (F.pmod(F.xxhash64("value"), F.lit(5)) == 0)
    model = fit(samples.where(~held))
    return model, fit_threshold(samples.where(held), model)


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of `docs` (doc_id, text, any others).

    Spans are structs of start, rank of the kind in KINDS, end and value, by
    start and then kind. Null and empty texts have none. Spans of the models do
    not touch base spans or one another.
    """
    scanned = scan(docs)
    model, threshold = learn(docs, scanned)
    return scanned.select("doc_id", "base", all_spans(F.col("base"), F.col("candidates"), model, threshold).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by `mark`."""

    def add(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(
                fresh,
                F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark)),
            ).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, rest)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with the same columns and rows, secrets in `text` replaced; null texts stay null.

    Texts are scanned once: the rows and what was found in them are one written table.
    """
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce("text", F.lit(""))
    held = materialise(docs.select(given, text.alias("text")).select("row", base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("candidates")), "secrets-rows")
    model, threshold = learn(held.select(F.col("row.text").alias("text"), "base"), held.select("base"), F.col("base"))
    spans = all_spans(F.col("base"), F.col("candidates"), model, threshold)
    own = F.col("row.text")
    clean = F.when(own.isNotNull(), _bound(spans, lambda found: redact(own, found)))
    return held.select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
