"""Text expressions: hashing, file extensions, words, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from effortlens.schema import NO_EXT

# Fixed values.
BUG_WORDS = ("bug", "Bug", "Fix", "fix")
NULL_TEXT = "nan"
EXT_CHARACTERS = r"a-zA-Z0-9\s+_\-"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def sha256_text(column: Column) -> Column:
    """Hex SHA-256 of the value as text; a null hashes like the text of a missing number."""
    return F.sha2(F.coalesce(column.cast("string"), F.lit(NULL_TEXT)), 256)


def base_name(path: Column) -> Column:
    """The part of a path after its last slash."""
    return F.substring_index(path, "/", -1)


def _last_piece(name: Column) -> Column:
    """What follows the last dot; null for dot files and names without an extension."""
    piece = F.substring_index(name, ".", -1)
    return F.when((piece != "") & (F.length(name) - F.length(piece) >= 2), piece)


def dotted_extension(name: Column) -> Column:
    """`a.tar.gz` -> `.gz`."""
    return F.coalesce(F.concat(F.lit("."), _last_piece(name)), F.lit(NO_EXT))


def extension(name: Column) -> Column:
    """`a.tar.gz` -> `gz`. This is the form every other operator uses."""
    return F.coalesce(_last_piece(name), F.lit(NO_EXT))


def path_extension(path: Column) -> Column:
    """Extension taken from a path, cut at the last character that is not usual in one."""
    tail = F.regexp_extract(_last_piece(base_name(path)), rf"([{EXT_CHARACTERS}]*)\z", 1)
    return F.coalesce(F.when(tail.rlike(r"\S"), tail), F.lit(NO_EXT))


def bug_word_count(message: Column) -> Column:
    """How often a bug word stands alone in the message (upper and lower case as listed)."""
    return F.regexp_count(message, F.lit(rf"(?U)\b(?:{'|'.join(BUG_WORDS)})\b"))


def mentions_bug(message: Column) -> Column:
    return message.rlike(rf"(?U)\b(?:{'|'.join(BUG_WORDS)})\b")


def line_count(source: Column) -> Column:
    """Number of lines of a source text, 0 without one; a closing line break opens no line."""
    breaks = F.regexp_count(source, F.lit(LINE_BREAK))
    unclosed = F.when(source.rlike(rf"(?s)(?:{LINE_BREAK})\z"), 0).otherwise(1)
    return F.when(source.isNull() | (source == ""), 0).otherwise(breaks + unclosed).cast("int")


def line_texts(lines: Column) -> Column:
    """Texts of a parsed diff, an array of (line_no, text)."""
    return F.transform(lines, lambda line: line["text"])
