"""Removal of repeated passages by run-length indexes.

Every window of `WINDOW` bytes has an anchor: of the byte grams in it, the first
with the least hash. Equal windows have equal anchors, so a maximal stretch of
windows with one anchor (a string of 76 bytes at most) need only be compared with
the stretches of the same anchor, wherever these are. Anchors that occur in one
document only are left out; the other stretches are dealt to buckets by anchor.

A bucket's distinct stretches, a very repetitive collection, become a
run-length index: the Burrows-Wheeler transform stored as runs, with the suffixes
sampled at run ends, and the intervals of rows that agree on a whole window.
Matching statistics are streamed over it: all stretches are read from right to
left, one run lookup per byte, and a window that lies in such an interval with a
smaller document is marked.

    documents, grouped by row hash --- anchors ---> buckets: which are shared
    the same groups  <--- shared anchors --- ; --- stretches ---> buckets: index
    the same groups  <--- marked byte ranges --- : bytes that stay

The three passes over a group read one shuffle of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm.arrays import blocks, mixed, powers, utf8

WINDOW = 50
GRAM = 24
BLOCK = 1 << 18
# Bytes of stretches in one index, at about; stretches of one anchor stay together. An anchor
# whose stretches, distinct in each group, are more than this in all groups is common, as at the
# edges of a passage that very many documents share, where every document has its own stretch: its
# windows are dealt to buckets one by one, by their own hash.
INDEX_BYTES = 1 << 19
# Of an anchor with no more stretches than this in a group, all count as distinct.
FEW = 4
# Groups and buckets per shuffle partition.
GROUPS, BUCKETS = 2, 1

_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LAST_ID = (1 << 63) - 1


# --- anchors -----------------------------------------------------------------


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for shift in range(min(8, n)):
        part = data[shift : shift + (len(data) - shift) // 8 * 8]
        out[shift::8] = np.frombuffer(part.tobytes(), np.uint64)[: len(range(shift, n, 8))]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash) of the stretches of windows with one anchor; windows stay in their row."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, np.zeros(0, np.uint64)
    eight = _eights(data)
    m = n - GRAM + 1
    hashes = eight[:m] * _FACTORS[0]
    hashes += eight[8 : m + 8] * _FACTORS[1]
    hashes += eight[16 : m + 16] * _FACTORS[2]
    hashes = mixed(hashes)
    least = (hashes & ~_PLACE) | np.arange(m, dtype=np.uint64)
    grams, width = window - GRAM + 1, 1
    while width * 2 <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    windows = n - window + 1
    at = (np.minimum(least[:windows], least[grams - width : grams - width + windows]) & _PLACE).astype(np.int64)
    edges = offsets[1:-1]
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.maximum(edges - window + 1, 0), 1)
    np.add.at(crossing, edges, -1)
    inside = np.cumsum(crossing[:windows]) == 0
    new = np.empty(windows, bool)
    new[0] = True
    new[1:] = at[1:] != at[:-1]
    new[1:] |= ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, np.zeros(0, np.uint64)
    closing = np.empty(windows, bool)
    closing[-1] = True
    closing[:-1] = new[1:] | ~inside[1:]
    return first, np.flatnonzero(closing & inside), hashes[at[first]]


def _parts(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in it, bytes, offsets); rows of many blocks are cut, overlapping by a window less one byte."""
    for first, last in blocks(offsets, BLOCK):
        begin, end = int(offsets[first]), int(offsets[last])
        if last - first > 1 or end - begin <= 16 * BLOCK:
            yield first, 0, data[begin:end], offsets[first : last + 1] - begin
            continue
        for place in range(0, max(1, end - begin - window + 1), 16 * BLOCK):
            part = data[begin + place : min(end, begin + place + 16 * BLOCK + window - 1)]
            yield first, place, part, np.array([0, len(part)])


def _stretches(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, first byte in the row, byte length, anchor hash) of all stretches of a group's rows."""
    rows, starts, sizes, hashes = [], [], [], []
    for first_row, place, part, bounds in _parts(data, offsets, window):
        first, last, found = anchors(part, bounds, window)
        row = np.searchsorted(bounds, first, "right") - 1
        rows.append(row + first_row)
        starts.append(first - bounds[row] + place)
        sizes.append(last - first + window)
        hashes.append(found)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in (rows, starts, sizes, hashes))


def _key(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, rest). Different anchors that meet in both are compared in vain, no more."""
    return (hashes % np.uint64(buckets)).astype(np.int64), (hashes >> np.uint64(32)).astype(np.uint32)


# --- bytes in Arrow ------------------------------------------------------------


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive slices of `values`, `sizes` elements each, as binary."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes * values.itemsize, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers).cast(pa.binary())


def _values(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All elements of a binary column, end to end."""
    data, _ = utf8(column)
    return np.frombuffer(data.tobytes(), kind)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string: byte planes next to each other, as high bytes are mostly alike."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(packed: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(packed), [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def _gaps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for `sizes[0]` numbers, then the same for the others."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _in_order(table: pa.Table) -> pa.Table:
    """A group's rows in an order that every pass finds again."""
    return table.sort_by([("place", "ascending"), ("doc", "ascending")])


# --- the index -------------------------------------------------------------------


def _suffix_order(text: np.ndarray, string: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(suffix array, class of every place by its first `depth` symbols or None if all differ).

    `text` has symbol 0 at the end of every string. A suffix is compared up to the
    end of its string, then by the number of the string.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(7, text.dtype))).astype(np.uint64)
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(7):
        symbol = padded[j : j + n]
        key = (key << np.uint64(9)) | np.where(alive, symbol, np.uint64(0))
        alive &= symbol != 0
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    rows, values, k, classes = np.arange(n), key[order], 7, None
    while True:
        # `values` are the sorted keys of the suffixes at `rows`, which share rows with their ties only.
        new = np.empty(len(rows), bool)
        new[:1] = True
        new[1:] = values[1:] != values[:-1]
        group = np.flatnonzero(new)
        sizes = np.diff(np.append(group, len(rows)))
        rank[order[rows]] = np.repeat(rows[group], sizes)
        if k == depth:
            classes = rank.copy()
        tied = np.repeat(sizes > 1, sizes)
        rows = rows[tied]
        if not len(rows):
            return order, classes
        at = order[rows]
        own = string[at]
        over = at + k > ends[own]
        follow = np.where(over, own, rank[np.minimum(at + k, n - 1)])
        values = rank[at] * (n + 1) + follow
        turn = np.argsort(values)
        order[rows] = at[turn]
        values = values[turn]
        k *= 2


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of strings, with the intervals of equal windows.

    `data` holds the strings end to end, `sizes` their lengths, `docs` the
    document of each.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, window: int = WINDOW):
        m = len(sizes)
        self.sizes, self.docs, self.window = sizes, docs, window
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(len(data) + m, np.uint16)
        string = np.repeat(np.arange(m), sizes + 1)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = data.astype(np.uint16) + 1
        depth = 7
        while depth * 2 <= window:
            depth *= 2
        order, classes = _suffix_order(text, string, ends, depth)

        # The transform as runs; LF is a shift within a run.
        symbols = text[order - 1]
        heads = np.append(0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1)
        lengths = np.diff(np.append(heads, len(text)))
        by_symbol = np.argsort(symbols[heads], kind="stable")
        target = np.empty(len(heads), np.int64)
        target[by_symbol] = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        self.run_starts, self.run_targets = heads, target
        # Samples: the suffix at the last row of each run.
        self.run_end_suffixes = order[heads + lengths - 1]

        # Intervals of rows that agree on a whole window, with their smallest document.
        self.starts = self.stops = self.least = np.zeros(0, np.int64)
        if classes is not None:
            whole = ends[string[order]] - order >= window
            shift = np.minimum(order + window - depth, len(text) - 1)
            same = (
                (classes[order[1:]] == classes[order[:-1]]) & (classes[shift[1:]] == classes[shift[:-1]])
                & whole[1:] & whole[:-1]
            )
            begins = np.flatnonzero(~np.append(False, same))
            stops = np.append(begins[1:], len(order))
            least = np.minimum.reduceat(docs[string[order]], begins)
            many = stops - begins > 1
            self.starts, self.stops, self.least = begins[many], stops[many], least[many]

    def step(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one symbol longer."""
        run = np.searchsorted(self.run_starts, rows, "right") - 1
        return self.run_targets[run] + rows - self.run_starts[run]

    def matching_statistics(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(string, place, document) of windows that also occur in a smaller document, and the smallest such.

        All strings are streamed from their ends together. The statistic is cut
        at the window: a place has it in full, or it is not given out.
        """
        if not len(self.starts):
            return
        # The end symbol of string i is row i.
        strings, rows = np.arange(len(self.sizes)), np.arange(len(self.sizes))
        for length in range(1, int(self.sizes.max()) + 1):
            going = self.sizes[strings] >= length
            if not going.all():
                strings, rows = strings[going], rows[going]
            rows = self.step(rows)
            if length < self.window:
                continue
            at = np.searchsorted(self.starts, rows, "right") - 1
            hit = (at >= 0) & (rows < self.stops[at]) & (self.least[at] < self.docs[strings])
            if hit.any():
                own = strings[hit]
                yield own, self.sizes[own] - length, self.least[at[hit]]


def _string_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of strings that lie end to end in `data`, worked out in blocks."""
    out = np.empty(len(starts), np.uint64)
    for first, last in blocks(np.append(starts, len(data)), BLOCK):
        begin = starts[first]
        end = starts[last - 1] + sizes[last - 1]
        up, down = powers(end - begin + 1)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum((data[begin:end].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        at, size = starts[first:last] - begin, sizes[first:last]
        out[first:last] = mixed((sums[at + size] - sums[at]) * down[at] + size.astype(np.uint64))
    return out


def marked_ranges(
    data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, keys: np.ndarray, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first byte, end) of byte ranges covered by windows of smaller documents.

    Stretches with equal `keys` are compared. Of equal stretches, those of the
    smallest document go into the index; the others are covered as a whole.
    """
    starts = np.cumsum(sizes) - sizes
    hashes = _string_hashes(data, starts, sizes)
    order = np.lexsort((docs, hashes, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.cumsum(new) - 1
    heads = order[new]
    later = docs[order] > docs[heads][distinct]
    own, first, end = [order[later]], [np.zeros(int(later.sum()), np.int64)], [sizes[order[later]]]
    # Occurrences of the distinct stretches in their smallest document.
    held, held_of = order[~later], distinct[~later]
    held_from = np.searchsorted(held_of, np.arange(len(heads) + 1))

    length = sizes[heads]
    total = np.cumsum(length)
    key = keys[heads]
    begin = 0
    while begin < len(heads):
        stop = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + INDEX_BYTES, "right"))
        stop = int(np.searchsorted(key, key[max(stop - 1, begin)], "right"))
        part = heads[begin:stop]
        index = RunLengthIndex(data[_ranges(starts[part], sizes[part])], sizes[part], docs[part], window)
        hits = list(index.matching_statistics())
        if hits:
            s, o = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
            turn = np.lexsort((o, s))
            s, o = s[turn], o[turn]
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)
            a = np.flatnonzero(fresh)
            b = np.append(a[1:], len(s)) - 1
            x = s[a] + begin
            copies = held_from[x + 1] - held_from[x]
            own.append(held[_ranges(held_from[x], copies)])
            first.append(np.repeat(o[a], copies))
            end.append(np.repeat(o[b] + window, copies))
        begin = stop
    return tuple(np.concatenate(x) for x in (own, first, end))


# --- the passes --------------------------------------------------------------------

_ANCHORS = "bucket int, group int, rests binary"
# `many`: the rests with more bytes of stretches than the longest stretch has, and `over`, by how many.
_FOUND = f"{_ANCHORS}, many binary, over binary"
# `packed` holds the stretches' keys, documents, rows, places, lengths and bytes; with no bytes, it holds marks.
_STRETCHES = "bucket int, group int, n int, n_bytes long, packed binary"
_MARKS = "group int, n int, packed binary"


def _longest(window: int) -> int:
    """Bytes of the longest stretch."""
    return 2 * window - GRAM


def _distinct_bytes(
    data: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, times: np.ndarray
) -> np.ndarray:
    """Bytes of the distinct stretches of each anchor; `at` is a stretch's anchor, `times` an anchor's stretches."""
    often = times[at] > FEW
    total = np.bincount(at[~often], size[~often], len(times))
    begin, size, at = begin[often], size[often], at[often]
    if len(at):
        own = _string_hashes(data[_ranges(begin, size)], np.cumsum(size) - size, size)
        order = np.lexsort((own, at))
        own, size, at = own[order], size[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
        total += np.bincount(at[new], size[new], len(times))
    return total.astype(np.int64)


def _anchor_pass(buckets: int, window: int):
    def run(group: pa.Table) -> pa.Table:
        data, offsets = utf8(group.column("text"))
        row, start, size, hashes = _stretches(data, offsets, window)
        bucket, rest = _key(hashes, buckets)
        key = (bucket.astype(np.uint64) << np.uint64(32)) | rest
        distinct, at, times = np.unique(key, return_inverse=True, return_counts=True)
        over = _distinct_bytes(data, offsets[row] + start, size, at, times) - _longest(window)
        bucket, rest = (distinct >> np.uint64(32)).astype(np.int64), distinct.astype(np.uint32)
        found, sizes = np.unique(bucket, return_counts=True)
        many = over > 0
        n_many = np.bincount(np.searchsorted(found, bucket[many]), minlength=len(found))
        name = group.column("group")[0].as_py()
        return pa.table(
            {"bucket": pa.array(found, pa.int32()), "group": pa.array(np.full(len(found), name), pa.int32()),
             "rests": _binary(rest, sizes), "many": _binary(rest[many], n_many),
             "over": _binary(over[many].astype(np.uint32), n_many)}
        )

    return run


def _sharing_pass(window: int, common_bytes: int = INDEX_BYTES, common_groups: int | None = None):
    """Anchors of a bucket that several groups have, back to these groups; `common` tells those of very many stretches."""

    def run(table: pa.Table) -> pa.Table:
        rests = _values(table.column("rests"), np.uint32)
        groups = np.repeat(table.column("group").to_numpy(), pa.compute.binary_length(table.column("rests")).to_numpy() // 4)
        order = np.lexsort((groups, rests))
        rests, groups = rests[order], groups[order]
        # A group may name one rest twice, for two anchors.
        own = np.ones(len(rests), bool)
        own[1:] = (rests[1:] != rests[:-1]) | (groups[1:] != groups[:-1])
        rests, groups = rests[own], groups[own]
        distinct, at, counts = np.unique(rests, return_inverse=True, return_counts=True)
        many = np.searchsorted(distinct, _values(table.column("many"), np.uint32))
        n_bytes = counts * _longest(window) + np.bincount(many, _values(table.column("over"), np.uint32), len(distinct))
        common = n_bytes > common_bytes
        if common_groups is not None:
            common |= counts > common_groups
        # A common anchor's only group needs to know it, too.
        shared = ((counts > 1) | common)[at]
        rests, groups, common = rests[shared], groups[shared], common[at][shared]
        order = np.lexsort((rests, groups))
        found, sizes = np.unique(groups, return_counts=True)
        bucket = table.column("bucket")[0].as_py()
        return pa.table(
            {"bucket": pa.array(np.full(len(found), bucket), pa.int32()), "group": pa.array(found, pa.int32()),
             "rests": _binary(rests[order], sizes), "common": _binary(common[order].astype(np.uint8), sizes)}
        )

    return run


def _stretch_pass(buckets: int, window: int):
    """Stretches of shared anchors to their buckets; copies inside the group are marked here."""

    def run(group: pa.Table, shared: pa.Table) -> pa.Table:
        none = pa.table({f: pa.array([], t) for f, t in _stretch_types()})
        if not len(group):
            return none
        name = group.column("group")[0].as_py()
        group = _in_order(group)
        data, offsets = utf8(group.column("text"))
        places = group.column("place").to_numpy()
        row, start, size, hashes = _stretches(data, offsets, window)
        if not len(row):
            return none
        bucket, rest = _key(hashes, buckets)
        key = (bucket.astype(np.uint64) << np.uint64(32)) | rest
        # Shared: by other groups, or by two documents here.
        elsewhere = np.zeros(0, np.uint64)
        common = np.zeros(0, np.uint8)
        if len(shared):
            n = pa.compute.binary_length(shared.column("common")).to_numpy()
            elsewhere = (np.repeat(shared.column("bucket").to_numpy(), n).astype(np.uint64) << np.uint64(32)) | _values(
                shared.column("rests"), np.uint32
            )
            common = _values(shared.column("common"), np.uint8)
        distinct, at = np.unique(key, return_inverse=True)
        low, high = np.full(len(distinct), _LAST_ID), np.full(len(distinct), -_LAST_ID - 1)
        np.minimum.at(low, at, places[row])
        np.maximum.at(high, at, places[row])
        wanted = (low != high) | np.isin(distinct, elsewhere)
        frequent = np.isin(distinct, elsewhere[common > 0])
        row, start, size, key, frequent = (x[wanted[at]] for x in (row, start, size, key, frequent[at]))
        # Common anchors: their windows one by one.
        n = np.where(frequent, size - window + 1, 1)
        single = np.repeat(frequent, n)
        start = _ranges(start, n)
        row, key, size = np.repeat(row, n), np.repeat(key, n), np.where(single, window, np.repeat(size, n))
        begin = offsets[row] + start
        text = data[_ranges(begin, size)]
        at = np.cumsum(size) - size
        own = _string_hashes(text, at, size)
        if single.any():
            b, r = _key(own[single], buckets)
            key[single] = (b.astype(np.uint64) << np.uint64(32)) | r
        # Equal stretches of a larger document are covered by the smallest one's.
        order = np.lexsort((places[row], own, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1])
        least = places[row][order][new][np.cumsum(new) - 1]
        later = np.zeros(len(order), bool)
        later[order] = places[row][order] > least
        keep = np.flatnonzero(~later)
        bucket = (key[keep] >> np.uint64(32)).astype(np.int64)
        turn = np.lexsort((start[keep], row[keep], bucket))
        keep, bucket = keep[turn], bucket[turn]
        found, first = np.unique(bucket, return_index=True)
        bounds = [*first.tolist(), len(keep)]
        counts, lengths, packed = [], [], []
        for a, b in zip(bounds, bounds[1:]):
            own = keep[a:b]
            body = text[_ranges(at[own], size[own])]
            counts.append(b - a)
            lengths.append(len(body))
            packed.append(
                _pack(
                    key[own].astype(np.uint32), _gaps(places[row[own]]), _gaps(row[own].astype(np.int32)), start[own],
                    size[own].astype(np.uint8), body,
                )
            )
        found = found.tolist()
        if later.any():
            # Marks take the way of the stretches back to their group.
            found.append(name % buckets)
            counts.append(int(later.sum()))
            lengths.append(0)
            packed.append(_packed_marks(row[later], start[later], start[later] + size[later]))
        columns = [found, [name] * len(found), counts, lengths, packed]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _stretch_types())], names=none.column_names)

    return run


def _stretch_types() -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [(f, kinds[t]) for f, t in (x.split() for x in _STRETCHES.split(", "))]


def _packed_marks(rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> bytes:
    order = np.lexsort((starts, rows))
    return _pack(_gaps(rows[order].astype(np.int32)), starts[order], (stops - starts)[order])


def _index_pass(window: int):
    def run(table: pa.Table) -> pa.Table:
        out_groups, out_counts, out_packed = [], [], []
        parts: list[tuple[np.ndarray, ...]] = []
        for group, n, n_bytes, packed in zip(*(table.column(c).to_pylist() for c in ("group", "n", "n_bytes", "packed"))):
            if not n_bytes:
                out_groups.append(group)
                out_counts.append(n)
                out_packed.append(packed)
                continue
            rests, docs, rows, starts, sizes, data = _unpack(
                packed, (np.uint32, n), (np.int64, n), (np.int32, n), (np.int64, n), (np.uint8, n), (np.uint8, n_bytes)
            )
            parts.append((np.full(n, group, np.int32), rests, np.cumsum(docs), np.cumsum(rows), starts, sizes.astype(np.int64), data))
        if parts:
            groups, rests, docs, rows, starts, sizes, data = (np.concatenate([p[i] for p in parts]) for i in range(7))
            parts.clear()
            own, first, end = marked_ranges(data, sizes, docs, rests, window)
            order = np.argsort(groups[own], kind="stable")
            own, first, end = own[order], first[order], end[order]
            found, at = np.unique(groups[own], return_index=True)
            bounds = [*at.tolist(), len(own)]
            for group, a, b in zip(found.tolist(), bounds, bounds[1:]):
                x = own[a:b]
                out_groups.append(group)
                out_counts.append(b - a)
                out_packed.append(_packed_marks(rows[x], starts[x] + first[a:b], starts[x] + end[a:b]))
        return pa.table(
            [pa.array(out_groups, pa.int32()), pa.array(out_counts, pa.int32()), pa.array(out_packed, pa.binary())],
            names=["group", "n", "packed"],
        )

    return run


def _cut_pass(group: pa.Table, marks: pa.Table) -> pa.Table:
    """The bytes that stay, and the maximal removed runs, of a group's rows."""
    group = _in_order(group)
    data, offsets = utf8(group.column("text"))
    n = len(group)
    change = np.zeros(len(data) + 1, np.int32)
    for count, packed in zip(marks.column("n").to_pylist(), marks.column("packed").to_pylist()):
        rows, starts, lengths = _unpack(packed, (np.int32, count), (np.int64, count), (np.int64, count))
        begin = offsets[np.cumsum(rows)] + starts
        np.add.at(change, begin, 1)
        np.add.at(change, begin + lengths, -1)
    gone = np.cumsum(change[:-1]) > 0
    before = np.append(False, gone[:-1])[: len(gone)]
    after = np.append(gone[1:], False)[: len(gone)]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts, stops = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    kept = np.concatenate(([0], np.cumsum(~gone)))[offsets]
    spans = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(spans), pa.array(x - offsets[row], pa.int64()))
    return pa.table(
        {"doc_id": group.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "starts": lists(starts), "stops": lists(stops),
         "kept": _binary(data[~gone], np.diff(kept))}
    )


def cut_repeats(
    docs: DataFrame, window: int = WINDOW, common_groups: int | None = None, common_bytes: int = INDEX_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, starts, stops, kept) for every row of `docs` (doc_id, text, any others).

    A byte of the UTF-8 text is removed if a string of `window` bytes that covers
    it also starts in a document with a smaller doc_id. `starts` and `stops` are
    the maximal removed runs, `kept` the bytes that stay. Strings are compared as
    they are in the input. A null text counts as empty; texts shorter than the
    window stay whole. Rows of one doc_id do not remove from each other, rows
    without one count as a last document. The longest string of one anchor,
    window + (window - GRAM) bytes, must be under 256. Anchors of over `common_bytes`
    of stretches, or of over `common_groups` groups if given, are dealt window by window.
    """
    if not GRAM + 1 < window < 128:
        raise ValueError(f"window must be over {GRAM + 1} and under 128")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = GROUPS * partitions, BUCKETS * partitions
    place = F.coalesce(F.col("doc_id"), F.lit(_LAST_ID))
    doc = F.xxhash64("text")
    texts = docs.select(
        F.pmod(F.xxhash64(place, doc), F.lit(groups)).cast("int").alias("group"),
        F.col("doc_id").cast("long").alias("doc_id"),
        place.cast("long").alias("place"),
        doc.alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    found = texts.groupBy("group").applyInArrow(_anchor_pass(buckets, window), _FOUND)
    shared = found.groupBy("bucket").applyInArrow(
        _sharing_pass(window, common_bytes, common_groups), f"{_ANCHORS}, common binary"
    )
    stretches = texts.groupBy("group").cogroup(shared.groupBy("group")).applyInArrow(
        _stretch_pass(buckets, window), _STRETCHES
    )
    marks = stretches.groupBy("bucket").applyInArrow(_index_pass(window), _MARKS)
    return texts.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(
        _cut_pass, "doc_id long, n_bytes long, starts array<long>, stops array<long>, kept binary"
    )
