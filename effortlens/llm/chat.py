"""Conversations as training windows of a bounded size, each turn trained on once.

Prefix sums of the turns' tokens choose spans of whole turns. A window holds the
conversation's system turn, the last few turns before its span, and the span.
The loss mask covers the assistant turns of the span alone, so that a turn that a
later window repeats is never a target again. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens of a window, and of the turns that it repeats from before its span.
BUDGET = 2_048
HISTORY = 512
HISTORY_TURNS = 6
# Windows do not cross a turn number that is a multiple of this: no task holds more turns of one conversation.
PART_TURNS = 1_024

START, MIDDLE, END = "<s>[INST] ", " [/INST] ", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
SYSTEM, TARGET = "system", "assistant"
# What the marks of a turn count for.
MARK_TOKENS = 8
_TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]|\s+"


def tokens(text: Column) -> Column:
    """Words, digits, other signs and runs of white space: the unit in which budgets count."""
    return F.regexp_count(text, F.lit(_TOKEN)).cast("long")


def escape(text: Column) -> Column:
    """The text with its backslashes doubled and one put behind the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _rows(conversations: DataFrame, part_turns: int) -> DataFrame:
    """(conv_id, part, turn, role, text); a part is a range of `part_turns` turn numbers."""
    turn = F.col("turn")
    part = F.when(turn >= 0, F.expr(f"turn div {part_turns}")).otherwise(F.expr(f"-((-(turn + 1)) div {part_turns}) - 1"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        # Rows without a number come first.
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("part", part)


def _openings(rows: DataFrame) -> DataFrame:
    """(conv_id, part, turn, role, text) for every part after a conversation's first: its system turn, or a null role."""
    firsts = rows.groupBy("conv_id", "part").agg(F.min(F.struct("turn", "role")).alias("first"))
    whole = Window.partitionBy("conv_id")
    later = (
        firsts.withColumn("first_part", F.min("part").over(whole))
        .withColumn("first", F.min("first").over(whole))
        .where("part > first_part")
        .select("conv_id", "part", "first")
    )
    wanted = (
        later.where(F.col("first.role") == SYSTEM)
        .select(F.col("conv_id").alias("conv"), F.col("first.turn").alias("first_turn"))
        .distinct()
    )
    systems = (
        rows.where(F.col("role") == SYSTEM)
        .join(wanted, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("turn") == F.col("first_turn")))
        .groupBy("conv")
        .agg(F.lit(SYSTEM).alias("role"), F.min("text").alias("text"))
    )
    return later.join(systems, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", "part", F.col("first.turn").alias("turn"), "role", "text"
    )


def _arranged(rows: DataFrame, history_turns: int, part_turns: int) -> DataFrame:
    """(conv_id, part, items): the turns of a part in order, before them what earlier parts hand on.

    Kinds of items: 0 the system turn of an earlier part (role null: there is
    none), 1 a turn from the end of the part before, 2 an own turn.
    """
    tail = F.col("turn") - F.col("part") * part_turns >= part_turns - history_turns
    places = F.array(F.struct("part", F.lit(2).alias("kind")))
    places = F.when(tail, F.concat(places, F.array(F.struct((F.col("part") + 1).alias("part"), F.lit(1).alias("kind"))))).otherwise(places)
    counted = rows.withColumn("tokens", tokens(F.col("text")) + MARK_TOKENS)
    turns = counted.select("conv_id", F.explode(places).alias("place"), "turn", "role", "text", "tokens")
    openings = _openings(rows).select(
        "conv_id",
        F.struct("part", F.lit(0).alias("kind")).alias("place"),
        "turn",
        "role",
        "text",
        (F.coalesce(tokens(F.col("text")), F.lit(0)) + MARK_TOKENS).alias("tokens"),
    )
    items = F.array_sort(F.collect_list(F.struct("place.kind", "turn", "role", "text", "tokens")))
    grouped = turns.unionByName(openings).groupBy("conv_id", F.col("place.part").alias("part")).agg(items.alias("items"))
    return grouped.where(F.exists("items", lambda x: x["kind"] == 2))


def windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    history_turns: int = HISTORY_TURNS,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """Training windows of `conversations` (conv_id, turn, role, text, any others).

    Returns (conv_id, part, window, n_turns, n_repeated, n_tokens, oversized,
    text, loss): the windows of a conversation in the order of part and window;
    how many turns the window holds and how many of them, from its start, earlier
    windows held already; code point ranges of the text, end exclusive, that
    are targets. A window takes as many turns as fit beside the system turn and
    the room kept for repeated turns. A turn is never cut: one that is too long
    fills a window alone, which is flagged `oversized` if it is over the budget.

    Turns are ordered by number, then role and text; a null number comes first,
    null roles and texts count as empty, equal rows are turns of their own. The system
    turn is the first turn, if its role is `system`. Rows without a conv_id form
    one conversation. A conversation is worked on in parts of `part_turns` turn
    numbers; rows equal in conversation and number stay in one task.
    """
    arranged = _arranged(_rows(conversations, part_turns), history_turns, part_turns)
    head = F.col("items")[0]
    handed_on = head["kind"] == 0
    # The end of the part before may hold the system turn, too.
    again = lambda x: (x["kind"] == 1) & (x["turn"] == head["turn"]) & (x["role"] == head["role"]) & (x["text"] == head["text"])
    rest = F.slice("items", 2, F.size("items"))
    opened = arranged.select(
        "conv_id",
        "part",
        handed_on.alias("handed_on"),
        F.when(head["role"] == SYSTEM, head).alias("system"),
        F.when(handed_on, F.filter(rest, lambda x: ~F.coalesce(again(x), F.lit(False))))
        .when(head["role"] == SYSTEM, rest)
        .otherwise(F.col("items"))
        .alias("turns"),
    )
    summed = opened.select(
        "*",
        F.size(F.filter("turns", lambda x: x["kind"] == 1)).alias("context"),
        F.aggregate(
            "turns",
            F.array(F.lit(0).cast("long")),
            lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x["tokens"])),
        ).alias("sums"),
        (F.lit(budget - history).cast("long") - F.coalesce(F.col("system.tokens"), F.lit(0))).alias("room"),
    )
    # sums[i] are the tokens of the first i turns.
    before = lambda i: F.get(F.col("sums"), i)
    own = F.when(F.size("turns") > F.col("context"), F.sequence(F.col("context") + 1, F.size("turns"))).otherwise(
        F.array().cast("array<int>")
    )

    def add(state: Column, i: Column) -> Column:
        full = (F.size(state["starts"]) == 0) | (before(i) - state["base"] > F.col("room"))
        return F.struct(
            F.when(full, before(i - 1)).otherwise(state["base"]).alias("base"),
            F.when(full, F.concat(state["starts"], F.array(i))).otherwise(state["starts"]).alias("starts"),
        )

    nothing = F.struct(F.lit(0).cast("long").alias("base"), F.array().cast("array<int>").alias("starts"))
    cut = summed.withColumn("starts", F.aggregate(own, nothing, add, lambda s: s["starts"]))
    # A system turn alone is a window, too.
    cut = cut.withColumn("starts", F.when(F.size("starts") == 0, F.array(F.col("context") + 1)).otherwise(F.col("starts")))

    def window(first: Column, k: Column) -> Column:
        last = F.coalesce(F.get("starts", k + 1) - 1, F.size("turns"))
        fits = lambda j: before(first - 1) - before(first - 1 - j) <= history
        repeated = F.size(F.filter(F.sequence(F.lit(1), F.lit(history_turns)), fits)) if history_turns else F.lit(0)
        kept = F.when(F.col("system").isNotNull(), F.array("system")).otherwise(F.slice("turns", 1, 0))
        kept_again = F.when(F.col("system").isNotNull() & (F.col("handed_on") | (k > 0)), 1).otherwise(0)
        return F.struct(
            k.alias("window"),
            (repeated + kept_again).alias("n_repeated"),
            F.concat(
                F.transform(kept, _plain), F.transform(F.slice("turns", first - repeated, repeated + last - first + 1), _plain)
            ).alias("turns"),
        )

    one = cut.select("conv_id", "part", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "part", "w.*")
    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
            escape(t["text"]).alias("body"),
            ((i >= F.col("n_repeated")) & (t["role"] == TARGET)).alias("target"),
        ),
    )
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    shaped = one.select("conv_id", "part", "window", F.size("turns").alias("n_turns"), "n_repeated", n_tokens.alias("n_tokens"), pieces.alias("pieces"))

    def mask(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(END)).alias("at"), F.when(p["target"], F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss")
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return shaped.select(
        "conv_id",
        "part",
        "window",
        "n_turns",
        "n_repeated",
        "n_tokens",
        (F.col("n_tokens") > budget).alias("oversized"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
        F.aggregate("pieces", empty, mask, lambda s: s["loss"]).alias("loss"),
    )


def _plain(turn: Column) -> Column:
    return F.struct(turn["role"].alias("role"), turn["text"].alias("text"), turn["tokens"].alias("tokens"))


_MARKED = r"(?s)<s>\[INST\] (.*?) \[/INST\] (.*?)</s>"


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, part, window, turns, targets) from the texts and masks of `windows`.

    `turns` are (role, text) of the turns that no earlier window held, `targets`
    the texts under the mask, both without escapes.
    """
    group = lambda i: F.transform(F.regexp_extract_all("text", F.lit(_MARKED), F.lit(i)), unescape)
    turns = F.zip_with(group(1), group(2), lambda role, text: F.struct(role.alias("role"), text.alias("text")))
    read = formatted.select("conv_id", "part", "window", "n_repeated", "text", "loss", turns.alias("turns"))
    return read.select(
        "conv_id",
        "part",
        "window",
        F.slice("turns", F.col("n_repeated") + 1, F.size("turns")).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring("text", s["start"] + 1, s["end"] - s["start"]))).alias("targets"),
    )
