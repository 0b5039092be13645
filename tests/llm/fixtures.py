"""Small tables with null, empty and long texts, ties, repeated rows and clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    parts = "an ou re ti en le ré ch eau the of and to in a ß ñ".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    shared = prose(rng, 30)
    out = list(base)
    out += [base[0], base[0], base[1] + " more", "start " + base[2], base[3][:60] + " cut " + base[3][40:]]
    out += [prose(rng, 20) + " " + shared + " " + prose(rng, 15) for _ in range(6)]
    out += [None, "", " \t\n", "one", "two words", "x" * 49, "x" * 50, "x" * 51, "ab" * 400, "\x00\x01" * 40, "é" * 60]
    out += [prose(rng, 9000), shared, "line one is here again\n" * 30]
    rng.shuffle(out)
    return out


def documents(spark, seed=1, extra=()):
    """Ids leave gaps; one id has two texts, one row occurs twice, one has no id."""
    rows = [(3 * i + 1, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts(seed))]
    rows += [(4, "another text of the same id, long enough to hold a window of bytes", "en", "src0", 0), rows[5], (None, rows[7][1], None, None, None)]
    rows += list(extra)
    return spark.createDataFrame(rows, DOC)


def clashing(docs):
    """The same rows with further columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "key group place doc fp item at grams bits bytes shard spans base candidates score word hash part block vector tile ids chunk piece sync".split()
    return docs.select("*", *[F.lit("clash").alias(n) for n in names])


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)
