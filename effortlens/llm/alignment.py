"""Alignment of the tokens of two tokenizers over the same bytes.

Each text is encoded by a byte-level BPE (A) and a piece model (B). The byte
offsets at which their tokens end are keys of two dictionaries, end to token
index; the keys that both hold, sorted, slice the two id lists into groups. A
link joins the tokens of A and B that end at the same byte, which are the last ones
of a slice. How often a pair of ids is linked is counted over the whole corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm.arrays import blocks, rows_per_batch, utf8
from effortlens.session import materialise

ALIGNED = (
    "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, "
    "pairs array<long>, pair_links array<long>"
)
# Bytes of texts encoded together, and rows that Python gets at once.
BLOCK_BYTES = 1 << 18
BATCH_ROWS = 512
# Fixed value: how byte-level files cut a text before they merge.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LISTS = ["a_ids", "b_ids", "a_sizes", "b_sizes"]


def _byte_characters() -> dict[str, int]:
    """The character a byte-level vocabulary writes for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(other)}}


def ranked(content: bytes) -> dict[bytes, int] | None:
    """Ranks of a byte-level file's tokens where ranks alone tell the merges, else None.

    That is so if every token is one byte or made by one merge, ids rise with
    the merges, and every token is what its own bytes are merged to. Then two
    neighbours that form a token are always a merge of the file: alone, the bytes
    of that token would pass the same neighbours, and end as the token.
    """
    from tokenizers import Tokenizer

    model = json.loads(content)["model"]
    byte, vocabulary = _byte_characters(), model["vocab"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    order = [vocabulary.get(t, -1) for t in made]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or sorted(order) != order or len(set(order)) < len(order) or set(byte) - set(vocabulary):
        return None
    if max(vocabulary[c] for c in byte) > min(order, default=len(vocabulary)):
        return None
    tokens = {t: vocabulary[t] for t in (*byte, *made)}
    alone = Tokenizer.from_buffer(content).model
    if any(len(found := alone.tokenize(t)) != 1 or found[0].id != i for t, i in tokens.items()):
        return None
    return {bytes(byte[c] for c in t): i for t, i in tokens.items()}


class Tokenizers:
    """Both tokenizers, built once per process, and the bytes of all their tokens.

    `ranks` as by `ranked`: `tiktoken` then finds A's tokens, in a fifth of the time.
    """

    # `tiktoken` gives up on some texts of millions of white spaces.
    LONGEST_RANKED = 65_536

    def __init__(self, a: bytes, b: bytes, ranks: dict[bytes, int] | None):
        import sentencepiece

        self.content, self.whole = a, None
        file = json.loads(a)
        steps = file["pre_tokenizer"]
        self.fast = None
        if ranks and steps == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": steps.get("trim_offsets"), "use_regex": True}:
            self.fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = _byte_characters()
        entries = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.a_bytes = [bytes(byte[c] for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B for every text; none where the bytes of either differ from a space and the text."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a = self.encode_a(" " + text)
            whole = b" " + text.encode()
            of_a = self.fast.decode_bytes(a) if self.fast is not None else b"".join(map(self.a_bytes.__getitem__, a))
            same = of_a == whole == b"".join(map(self.b_bytes.__getitem__, b))
            yield tuple(np.array(ids if same and text else [], np.int32) for ids in (a, b))

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None and len(text) <= self.LONGEST_RANKED:
            return self.fast.encode_ordinary(text)
        if self.whole is None:  # many megabytes, and most tasks never need it
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_buffer(self.content)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids

    def possible_links(self) -> int:
        """How many id pairs can ever be linked: of two tokens that end together, one ends with the other.

        This bounds the table of link counts, whatever the corpus.
        """
        a, b = Counter(self.a_bytes), Counter(self.b_bytes)
        suffixes = lambda x: (x[i:] for i in range(len(x)))
        in_a = sum(n * b[s] for x, n in a.items() for s in suffixes(x))
        in_b = sum(n * a[s] for x, n in b.items() for s in suffixes(x))
        return in_a + in_b - sum(n * b[x] for x, n in a.items())


_BUILT: dict[tuple[int, int], Tokenizers] = {}


def tokenizers(a: bytes, b: bytes, ranks: dict[bytes, int] | None = None) -> Tokenizers:
    key = hash(a), hash(b)
    if key not in _BUILT:
        _BUILT[key] = Tokenizers(a, b, ranks)
    return _BUILT[key]


def common_cuts(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of A and of B in every group, from the byte sizes of the tokens of one text."""
    ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    # The dictionaries from end to number of tokens, as arrays with a place per byte offset; 0 where no token ends.
    index = np.zeros((2, max((int(e[-1]) + 1 for e in ends if len(e)), default=0)), np.int32)
    for own, at in zip(index, ends):
        own[at] = np.arange(1, len(at) + 1)
    common = np.flatnonzero(index.all(axis=0))
    return tuple(np.diff(own[common], prepend=np.int32(0)) for own in index)


def _lists(lists: list) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.asarray(x, np.int32) for x in lists])))


def _on_first(values: np.ndarray, rows: int) -> pa.Array:
    """A list column that holds `values` in its first row, and nothing in the others."""
    offsets = np.full(rows + 1, len(values), np.int32)
    offsets[0] = 0
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def align(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_sizes, b_sizes, pairs, pair_links) for every row of `docs` (doc_id, text, any others).

    `a` is the content of a byte-level `tokenizers` file, `b` that of a
    `sentencepiece` model that puts a space before the text; A encodes the text
    behind a space, so that both cover the same bytes. Special tokens are not
    added, and their names inside a text are plain text. Group i takes the next
    `a_sizes[i]` ids of A and `b_sizes[i]` ids of B. Of the rows that a task has worked
    on together the first also holds the linked id pairs of all of
    them, each once, and how many links each has; the other rows' lists are empty.

    All lists are empty for a null or empty text, and where the bytes of the tokens
    are not a space and the text (a text with U+2581, say). Repeated rows give
    repeated results, null ids are kept. A text is encoded in one piece, since a
    piece model may merge over any boundary; a task holds `BLOCK_BYTES` of
    texts at once, or one longer text.
    """
    ranks = ranked(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(a, b, ranks)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for first, last in blocks(offsets, BLOCK_BYTES):
                part = batch.slice(first, last - first)
                rows = [], [], [], []
                for ids in own.encode([t or "" for t in part.column("text").to_pylist()]):
                    sizes = common_cuts(own.a_sizes[ids[0]], own.b_sizes[ids[1]]) if len(ids[0]) else ([], [])
                    for column, value in zip(rows, (*ids, *sizes)):
                        column.append(value)
                lists = list(map(_lists, rows))
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", *_LISTS])
                pairs, counts = np.unique(_codes(*_linked(out)[:2]), return_counts=True)
                columns = [*out.columns, _on_first(pairs, len(out)), _on_first(counts, len(out))]
                yield pa.RecordBatch.from_arrays(columns, [*out.schema.names, "pairs", "pair_links"])

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _linked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and B of every link of a batch of aligned rows, and where the links of each row start."""
    a, b = (_values(batch.column(n))[0] for n in ("a_ids", "b_ids"))
    (a_sizes, starts), (b_sizes, _) = (_values(batch.column(n)) for n in ("a_sizes", "b_sizes"))
    # The sizes of a row sum up to its ids, so that sums over the whole batch are places in it.
    return a[np.cumsum(a_sizes) - 1], b[np.cumsum(b_sizes) - 1], starts


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, links, best) of all linked id pairs; `best` where no pair of this id of B has more links.

    Rows were counted together as they were aligned, so that distinct pairs of many texts are added up.
    """
    parts = aligned.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select("p.*")
    summed = parts.groupBy("pairs").agg(F.sum("pair_links").alias("links"))
    pairs = summed.select(
        F.shiftright("pairs", 32).cast("int").alias("a_id"), F.col("pairs").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "links"
    )
    most = pairs.groupBy("b_id").agg(F.max("links").alias("most"))
    return pairs.join(most, "b_id").select("a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best"))


def links(aligned: DataFrame) -> DataFrame:
    """(doc_id, link, a_token, b_token, a_id, b_id): one row per link, tokens counted from 0."""
    ends = lambda sizes: F.slice(
        F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n))), 2, F.size(sizes)
    )
    rows = aligned.select("doc_id", "a_ids", "b_ids", F.posexplode(F.arrays_zip(ends(F.col("a_sizes")), ends(F.col("b_sizes")))).alias("link", "end"))
    a, b = F.col("end")["0"] - 1, F.col("end")["1"] - 1
    return rows.select("doc_id", "link", a.alias("a_token"), b.alias("b_token"), F.col("a_ids")[a].alias("a_id"), F.col("b_ids")[b].alias("b_id"))


def _written(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, names: list[list[np.ndarray]]) -> str:
    """`a1,a2|b1;a3|b2,b3`: the groups of one text. `names` hold, for A and B, each id with a comma, and with the sign that ends a group's side."""
    out = np.empty(len(a) + len(b), object)
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    for ids, sizes, ends, shift, (inside, last) in ((a, a_sizes, a_ends, b_ends - b_sizes, names[0]), (b, b_sizes, b_ends, a_ends, names[1])):
        out[np.arange(len(ids)) + np.repeat(shift, sizes)] = inside[ids]
        out[ends - 1 + shift] = last[ids[ends - 1]]
    return "".join(out.tolist())[:-1]


def summary(aligned: DataFrame, counts: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `aligned`.

    `n_best` counts the links whose pair is the most frequent of its id of B,
    `count_sum` adds the corpus counts of all links; the digest is of the written groups, and
    empty where a text has no tokens. Two tokens that end together share their last
    bytes, so the two vocabularies bound `counts` (some 400,000 pairs for the public ones),
    however large the corpus; the table goes to every task. The result is a written table.
    """
    both = tokenizers(a, b)
    bound, n_a, n_b = both.possible_links(), len(both.a_bytes), len(both.b_bytes)
    table = counts.select("a_id", "b_id", "links", "best").limit(bound + 1).toArrow()
    if len(table) > bound:
        raise ValueError("counts are not those of the links of these tokenizers")
    a_id, b_id, weight, best = (table.column(n).to_numpy() for n in ("a_id", "b_id", "links", "best"))
    codes = _codes(a_id, b_id)
    order = np.argsort(codes)
    codes, weight, best = codes[order], weight[order], best[order].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [[np.array([f"{i}{sign}" for i in range(n)], object) for sign in signs] for n, signs in ((n_a, ",|"), (n_b, ",;"))]
        for batch in batches:
            a_last, b_last, starts = _linked(batch)
            place = np.searchsorted(codes, _codes(a_last, b_last))
            sums = [np.concatenate(([0], np.cumsum(x[place])))[starts] for x in (best, weight)]
            lists = [_values(batch.column(n)) for n in _LISTS]
            digests = []
            for i in range(len(batch)):
                parts = [values[offsets[i] : offsets[i + 1]] for values, offsets in lists]
                digests.append(hashlib.sha256(_written(*parts, names).encode()).hexdigest() if len(parts[0]) else "")
            sizes = [np.diff(offsets).astype(np.int64) for _, offsets in lists]
            columns = [batch.column("doc_id"), *map(pa.array, (*sizes[:3], sizes[2], *map(np.diff, sums), digests))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    found = aligned.select("doc_id", *_LISTS).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    with rows_per_batch(aligned.sparkSession, BATCH_ROWS):
        return materialise(found, "aligned-summary")


def aligned_table(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """`align` as a written table, a few hundred texts at a time."""
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        return materialise(align(docs, a, b), "aligned-tokens")
