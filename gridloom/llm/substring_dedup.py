"""Removal of repeated byte strings by a sparse suffix sort: splitters, range partition, multikey sort, exact bytes.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (in a smaller doc_id, or in the
same document at an earlier offset) is removed; strings are judged on the input and never cross documents.

Suffixes are taken at anchors. The anchor of a string of ``LENGTH`` bytes is the one of its ``LEAD``-byte
runs with the smallest hash (the leftmost of equal ones), which depends on the string's content alone, so
equal strings have equal anchors at equal distances; about 2 in ``LENGTH - LEAD`` positions are anchors. A
suffix per byte would shuffle a hundred times the text.

1. Documents are dealt into parts of bounded bytes. Each part reports the distinct leading tokens (hashed)
   of its anchors. The reports are partitioned by leading token and the tokens seen twice go back to the
   parts that have them. (Two tokens of one hash only make contexts that nothing is equal to.)
2. A part cuts out the context of each anchor with such a token: the bytes of all strings that have this
   anchor. Of equal contexts in a part (compared byte by byte) only the first goes on, the others are covered at
   once, so a hot group sends no more than one context per part.
3. A context's suffix starts at its anchor, for strings with the anchor in their first half, and ``HALF`` bytes
   before it for the others. Splitters from a sample of about ``SAMPLE_BYTES`` of text range-partition the suffixes by
   their leading bytes; equal leading bytes are never parted, so equal strings meet and no string has a partner
   across a border. A bucket is sorted by its leading 16 bytes and, where these are tied, by a multikey sort that goes
   on word by word inside ties only, over the ``DEPTH_WORDS`` words that equal strings must share; suffixes alone in
   their tie repeat nothing. In a tie each string's hash and place find its equals; their bytes are compared
   before the earliest one stays and the others go, and strings of equal hash and other bytes are told apart.
4. Spans go back to the parts, which merge them and cut the texts.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` bytes are kept; rows that repeat a doc_id
are ordered by their text, then arbitrarily (they are equal then); null doc_ids count as the smallest; very
long texts are taken whole;
an empty table gives no rows; further columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import give_back, mix64, parts_for, table_bytes

LENGTH, LEAD, HALF = 100, 24, 50
PART_BYTES = 3 << 20  # of the input's files
SLICE_BYTES = 1 << 20
GROUP_ROWS = 40_000
SAMPLE_BYTES = 8 << 20
BUCKETS = 8192  # ranges at most; a bucket is read in pieces of about GROUP_ROWS, not whole
DEPTH_WORDS = 6  # of eight bytes: 48 of the HALF bytes that equal strings share
SPAN_SCHEMA = "part long, doc_id long, copy int, spans binary"
CONTEXT_SCHEMA = "bucket int, part long, doc_id long, copy int, start int, distance int, context binary, spans binary"
_LOW = np.uint64(0xFFFFFFFF)


def words8(data: np.ndarray) -> np.ndarray:
    """At each offset the next eight bytes as a number; the array is seven shorter than the data."""
    x = data.astype(np.uint64)
    for n in (1, 2, 4):
        x = x[:-n] | (x[n:] << np.uint64(8 * n))
    return x


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))))


def lead_keys(data: np.ndarray, w8: np.ndarray) -> np.ndarray:
    """At each offset the key of the next LEAD = 24 bytes."""
    n = len(data) - LEAD + 1
    return _join(_join(w8[:n], w8[8 : 8 + n]), w8[16 : 16 + n])


def ordered_words(w8: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a signed number that sorts as the bytes do."""
    return (w8[at].byteswap() ^ np.uint64(1 << 63)).view(np.int64)


def multikey_groups(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their words, first word first, and where in this order a new group of equal rows begins.
    Each word is looked at only within rows that all words before have tied."""
    n = len(words[0])
    order = np.argsort(words[0], kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = words[0][order[1:]] != words[0][order[:-1]]
    for word in words[1:]:
        alone = fresh & np.append(fresh[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(fresh)[tied]
        value = word[order[tied]]
        by = np.lexsort([value, group])
        order[tied] = order[tied][by]
        value = value[by]
        split = np.flatnonzero((value[1:] != value[:-1]) & (group[1:] == group[:-1]))
        fresh[tied[split + 1]] = True
    return order, fresh


def keys_of(w8: np.ndarray, length: int) -> np.ndarray:
    """At each offset the key of the next ``length`` bytes, by doubling (length of at least 16)."""
    n = len(w8) + 7 - length + 1
    x, size = w8, 8
    while 2 * size <= length:
        x, size = _join(x[:-size], x[size:]), 2 * size
    return _join(x[:n], x[length - size : length - size + n])


class Anchors:
    """Anchors of the documents in a buffer: document number, offsets in the buffer of the anchor (``at``)
    and of the first and last string (``lo``, ``hi``) that have it, and the key of the leading token."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.w8 = words8(data) if len(data) >= LENGTH else np.empty(0, np.uint64)
        empty = np.empty(0, np.int64)
        self.doc = self.at = self.lo = self.hi = empty
        self.token = np.empty(0, np.uint64)
        if len(data) < LENGTH:
            return
        lead = lead_keys(data, self.w8)
        low = (lead & ~_LOW) | np.arange(len(lead), dtype=np.uint64)
        size, width = 1, LENGTH - LEAD + 1
        while 2 * size <= width:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        anchor = (low & _LOW).astype(np.int64)  # of the string at each offset
        starts, ends = offsets[:-1], offsets[1:]
        long = np.flatnonzero(ends - starts >= LENGTH)
        valid = np.zeros(len(anchor) + 1, np.int8)
        np.add.at(valid, starts[long], 1)
        np.add.at(valid, ends[long] - LENGTH + 1, -1)
        inside = np.flatnonzero(np.cumsum(valid[:-1]))
        if not len(inside):
            return
        a = anchor[inside]
        cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(inside) != 1))
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(a) - 1]])
        self.at, self.lo, self.hi = a[first], inside[first], inside[last]
        self.doc = np.searchsorted(starts, self.lo, side="right") - 1
        # empty documents start where the next one does
        self.token = lead[self.at]


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """doc_ids (null: the smallest), the number of each copy of an id, and the texts, in the order that counts."""
    ids, copy, texts, _ = _ordered(table)
    return ids, copy, texts


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    keys = pc.fill_null(table.column("doc_id").combine_chunks(), -(2**63))
    texts = pc.fill_null(table.column("text").combine_chunks(), "")
    order = pc.sort_indices(pa.table({"k": keys}), sort_keys=[("k", "ascending")])
    ids = np.asarray(keys.take(order))
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        order = pc.sort_indices(pa.table({"k": keys, "t": texts}), sort_keys=[("k", "ascending"), ("t", "ascending")])
        ids = np.asarray(keys.take(order))
    copy = (np.arange(len(ids)) - np.searchsorted(ids, ids)).astype(np.int32)
    return ids, copy, texts.take(order), order


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, offsets) of runs of whole documents of about SLICE_BYTES."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    piece = (offsets[1:] - offsets[0]) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _report(table: pa.Table) -> pa.Table:
    """Distinct leading tokens of a part's anchors, and whether the part has them twice."""
    _, _, texts = _documents(table)
    tokens = [Anchors(data, offsets).token for _, data, offsets in _slices(texts)]
    token, count = np.unique(np.concatenate(tokens) if tokens else np.empty(0, np.uint64), return_counts=True)
    part = table.column("part")[0].as_py()
    return pa.table({"token": token.view(np.int64), "part": pa.array(np.full(len(token), part, np.int64)), "seen": pa.array(np.minimum(count, 2).astype(np.int32))})


def merge_spans(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Maximal runs of the union of spans (of each owner)."""
    if owner is None:
        owner = np.zeros(len(starts), np.int64)
    order = np.lexsort([starts, owner])
    s, e, o = starts[order], ends[order], owner[order]
    if not len(s):
        return s, e, o
    new_owner = np.concatenate([[True], o[1:] != o[:-1]])
    # spans of later owners lie beyond all spans of earlier ones on a common axis
    step = int(e.max()) + 2
    rank = np.cumsum(new_owner) - 1
    reach = np.maximum.accumulate(e + rank * step)
    fresh = np.concatenate([[True], (s + rank * step)[1:] > reach[:-1]])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:] - 1, [len(s) - 1]])
    return s[first], reach[last] - rank[last] * step, o[first]


def _pack(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return np.column_stack([starts, ends]).astype(np.int32).tobytes()


def _ragged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values data[starts[i]:ends[i]]."""
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])


def _contexts(table: pa.Table, tokens: pa.Table, splitters: np.ndarray) -> pa.Table:
    """Contexts of the anchors with the given tokens, first ones only, and the spans that the others cover."""
    types = [pa.int32(), *[pa.int64()] * 2, *[pa.int32()] * 3, pa.binary(), pa.binary()]
    names = [x.split()[0] for x in CONTEXT_SCHEMA.split(", ")]
    nothing = pa.Table.from_arrays([pa.array([], t) for t in types], names)
    if not table.num_rows or not tokens.num_rows:
        return nothing
    part = table.column("part")[0].as_py()
    ids, copies, texts = _documents(table)
    wanted = np.sort(np.asarray(tokens.column("token")).view(np.uint64))
    seen: list[np.ndarray] = []
    kept = []
    for base, data, offsets in _slices(texts):
        a = Anchors(data, offsets)
        hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, a.token), len(wanted) - 1)] == a.token) if len(a.token) else np.empty(0, np.int64)
        if not len(hit):
            continue
        w8, at, lo, hi, doc = a.w8, a.at[hit], a.lo[hit], a.hi[hit], a.doc[hit]
        whole = keys_of(w8, LENGTH)
        identity = _join(_join(whole[lo], whole[hi]), ((hi - lo).astype(np.uint64) << np.uint64(32)) + (at - lo).astype(np.uint64))
        seen.append(identity)
        kept.append((base, data, offsets, w8, at, lo, hi, doc))
    if not kept:
        return nothing
    _, first, same = np.unique(np.concatenate(seen), return_index=True, return_inverse=True)
    is_first = np.zeros(len(same), bool)
    is_first[first] = True
    # equal by their hashes: the bytes at either end, which overlap, decide
    window = np.concatenate([k[1] for k in kept])
    shift = np.cumsum([0, *(len(k[1]) for k in kept[:-1])])
    low, high = (np.concatenate([k[i] + d for k, d in zip(kept, shift)]) for i in (5, 6))
    rest = np.flatnonzero(~is_first)
    for s in range(0, len(rest), 65_536):
        r = rest[s : s + 65_536]
        f = first[same[r]]
        is_first[r[~(same_bytes(window, low[r], low[f]) & same_bytes(window, high[r], high[f]) & (high[r] - low[r] == high[f] - low[f]))]] = True
    out, covered, done = [], [], 0
    for base, data, offsets, w8, at, lo, hi, doc in kept:
        own = is_first[done : done + len(at)]
        done += len(at)
        rest = ~own
        begin = offsets[doc]
        if rest.any():
            s, e, o = merge_spans(lo[rest] - begin[rest], hi[rest] + LENGTH - begin[rest], doc[rest])
            cut = np.flatnonzero(np.diff(o, prepend=-1))
            for i, j in zip(cut, [*cut[1:], len(o)]):
                covered.append((int(ids[base + o[i]]), int(copies[base + o[i]]), _pack(s[i:j], e[i:j])))
        at, lo, hi, doc, begin = at[own], lo[own], hi[own], doc[own], begin[own]
        # strings with the anchor in their first half share the bytes after it, the others those before it
        for first_half in (True, False):
            a0 = np.maximum(lo, at - HALF) if first_half else lo
            a1 = hi if first_half else np.minimum(hi, at - HALF - 1)
            ok = a1 >= a0
            if not ok.any():
                continue
            suffix = at[ok] if first_half else at[ok] - HALF
            d = doc[ok]
            out.append((ordered_words(w8, suffix), ids[base + d], copies[base + d], a0[ok] - begin[ok], at[ok] - a0[ok], _ragged(data, a0[ok], a1[ok] + LENGTH)))
    tables = []
    for lead, d, c, start, distance, context in out:
        n = len(lead)
        bucket = np.searchsorted(splitters, lead, "right").astype(np.int32)
        tables.append(pa.Table.from_arrays([pa.array(bucket), pa.array(np.full(n, part, np.int64)), pa.array(d), pa.array(c), pa.array(start.astype(np.int32)), pa.array(distance.astype(np.int32)), context, pa.nulls(n, pa.binary())], names))
    if covered:
        d, c, s = zip(*covered)
        n = len(d)
        spread = (mix64(np.array(d, np.int64).view(np.uint64)) % np.uint64(len(splitters) + 1)).astype(np.int32)
        tables.append(pa.Table.from_arrays([pa.array(spread), pa.array(np.full(n, part, np.int64)), pa.array(d, pa.int64()), pa.array(c, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(s, pa.binary())], names))
    return pa.concat_tables(tables) if tables else nothing


def same_bytes(data: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Are the LENGTH bytes at p those at q?"""
    window = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    return (window[p] == window[q]).all(1)


def _equal_strings(data: np.ndarray, place: np.ndarray, row: np.ndarray, earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Which pairs of strings (by number; ``place`` is where each begins) have the same bytes. ``later`` ascends; a
    pair that moves on by one from the pair before it, in both rows, needs only its last byte compared."""
    p, q = place[earlier], place[later]
    goes_on = np.zeros(len(later), bool)
    goes_on[1:] = (later[1:] == later[:-1] + 1) & (earlier[1:] == earlier[:-1] + 1) & (row[later[1:]] == row[later[:-1]]) & (row[earlier[1:]] == row[earlier[:-1]])
    equal = data[p + LENGTH - 1] == data[q + LENGTH - 1]
    heads = np.flatnonzero(~goes_on)
    for s in range(0, len(heads), 65_536):
        h = heads[s : s + 65_536]
        equal[h] = same_bytes(data, p[h], q[h])
    if not equal.all():  # strings of equal hash and other bytes: compare all pairs in full
        equal = np.concatenate([same_bytes(data, p[s : s + 65_536], q[s : s + 65_536]) for s in range(0, len(p), 65_536)])
    return equal


def _resolve(table: pa.Table) -> pa.Table:
    """Of whole groups of contexts: the spans of strings that are equal to an earlier one."""
    context = table.column("context").combine_chunks()
    context = context.chunk(0) if isinstance(context, pa.ChunkedArray) else context
    names = [x.split()[0] for x in SPAN_SCHEMA.split(", ")]
    columns = {c: np.asarray(table.column(c)) for c in ("part", "doc_id", "copy", "start", "distance")}
    order = np.lexsort([columns["start"], columns["copy"], columns["doc_id"]])  # earliest first
    at = np.frombuffer(context.buffers()[1], np.int32, len(context) + 1, context.offset * 4).astype(np.int64)
    data = np.frombuffer(context.buffers()[2], np.uint8)
    begin, size = at[:-1][order], np.diff(at)[order]
    n = size - LENGTH + 1  # strings of each context
    row = np.repeat(np.arange(len(order)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    where = begin[row] + inner
    whole = keys_of(words8(data), LENGTH)[where]
    key = _join(whole, (columns["distance"][order].astype(np.int64)[row] - inner).astype(np.uint64))
    by = np.argsort(key, kind="stable")
    k = key[by]
    again = np.flatnonzero(k[1:] == k[:-1]) + 1
    fresh = np.ones(len(k), bool)
    fresh[again] = False
    first = by[np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))]
    later, earlier = by[again], first[again]
    o = np.argsort(later)
    later, earlier = later[o], earlier[o]
    covered = np.zeros(len(row), bool)
    equal = _equal_strings(data, where, row, earlier, later)
    covered[later[equal]] = True
    if not equal.all():  # the earliest of each other string under that hash
        seen: set[bytes] = set()
        for i in later[~equal].tolist():
            own = data[where[i] : where[i] + LENGTH].tobytes()
            covered[i] = own in seen
            seen.add(own)
    hit = np.flatnonzero(covered)
    start = columns["start"][order].astype(np.int64)[row[hit]] + inner[hit]
    s, e, o = merge_spans(start, start + LENGTH, row[hit])
    cut = np.flatnonzero(np.diff(o, prepend=-1))
    packed = np.column_stack([s, e]).astype(np.int32).tobytes()
    edges = [*(8 * cut).tolist(), len(packed)]
    rows = order[o[cut]]
    return pa.Table.from_arrays([pa.array(columns["part"][rows]), pa.array(columns["doc_id"][rows]), pa.array(columns["copy"][rows]), pa.array([packed[i:j] for i, j in zip(edges, edges[1:])] if len(cut) else [], pa.binary())], names)


def _suffixes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all contexts, where the suffix of each begins in them, and which suffixes begin before the anchor."""
    context = table.column("context").combine_chunks()
    context = context.chunk(0) if isinstance(context, pa.ChunkedArray) else context
    at = np.frombuffer(context.buffers()[1], np.int32, len(context) + 1, context.offset * 4).astype(np.int64)[:-1]
    distance = np.asarray(table.column("distance")).astype(np.int64)
    before = distance > HALF
    return np.frombuffer(context.buffers()[2], np.uint8), at + distance - HALF * before, before


def _word(data: np.ndarray, suffix: np.ndarray, d: int) -> np.ndarray:
    """The word number ``d`` of each suffix, as a number that sorts as its bytes do."""
    word = np.zeros(len(suffix), np.uint64)
    for b in range(8):
        word = (word << np.uint64(8)) | data[suffix + 8 * d + b]
    return word


def _tied(table: pa.Table) -> np.ndarray:
    """Which contexts have another one whose suffix has the same first DEPTH_WORDS words."""
    data, suffix, before = _suffixes(table)
    order, fresh = multikey_groups([_word(data, suffix, 0), _word(data, suffix, 1), before, *(_word(data, suffix, d) for d in range(2, DEPTH_WORDS))])
    tied = np.zeros(len(order), bool)
    tied[order] = ~(fresh & np.append(fresh[1:], True))
    return tied


def _resolve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    names = [x.split()[0] for x in SPAN_SCHEMA.split(", ")]

    def contexts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tied = _tied(table)
        if tied.any():
            yield from _resolve(table.filter(pa.array(tied))).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        ready = pc.is_valid(batch.column("spans"))
        if pc.any(ready).as_py():
            yield batch.filter(ready).select(names)
            batch = batch.filter(pc.invert(ready))
        held.append(batch)
        rows += batch.num_rows
        if rows >= GROUP_ROWS:
            table = pa.Table.from_batches(held)
            data, suffix, _ = _suffixes(table)
            lead, lead2 = _word(data, suffix, 0), _word(data, suffix, 1)
            changes = np.flatnonzero((lead[1:] != lead[:-1]) | (lead2[1:] != lead2[:-1]))
            cut = int(changes[-1]) + 1 if len(changes) else 0  # the last group may go on
            if cut:
                yield from contexts(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield from contexts(table)
    give_back()


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading words of the suffixes of sampled texts."""
    for batch in batches:
        for _, data, offsets in _slices(pc.fill_null(batch.column("text"), "")):
            a = Anchors(data, offsets)
            if len(a.at):
                lead = np.concatenate([ordered_words(a.w8, a.at), ordered_words(a.w8, a.at[a.at - a.lo > HALF] - HALF)])
                yield pa.RecordBatch.from_arrays([pa.array(lead)], ["lead"])


def sampled_splitters(docs: DataFrame, total_bytes: int, buckets: int) -> np.ndarray:
    """Leading words that cut the suffixes of a sample of about SAMPLE_BYTES into ranges of equal counts. Splitters
    decide how even buckets are and nothing else."""
    rows = docs.select("text")
    rows = rows.sample(SAMPLE_BYTES / total_bytes, 5) if total_bytes > SAMPLE_BYTES else rows
    lead = np.sort(np.asarray(rows.mapInArrow(_sample_batches, "lead long").toArrow().column("lead")))
    if not len(lead):
        return np.empty(0, np.int64)
    return np.unique(lead[np.linspace(0, len(lead) - 1, buckets + 1).astype(int)[1:-1]])


def _cut(table: pa.Table, spans: pa.Table, carry: list[str], as_text: bool) -> pa.Table:
    """Each document's bytes without its spans; as text, without the parts of characters that a cut has left."""
    ids, copies, texts, order = _ordered(table)
    found: dict[tuple[int, int], list[bytes]] = {}
    for d, c, s in zip(spans.column("doc_id").to_pylist(), spans.column("copy").to_pylist(), spans.column("spans").to_pylist()):
        found.setdefault((d, c), []).append(s)
    kept, removed, starts, ends = [], [], [], []
    for d, c, text in zip(ids.tolist(), copies.tolist(), texts.cast(pa.binary()).to_pylist()):
        own = found.get((d, c))
        if not own:
            kept.append(text)
            s = e = np.empty(0, np.int64)
        else:
            both = np.frombuffer(b"".join(own), np.int32).reshape(-1, 2).astype(np.int64)
            s, e, _ = merge_spans(both[:, 0], both[:, 1])
            edges = [0, *np.column_stack([s, e]).ravel().tolist(), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        removed.append(int((e - s).sum()))
        starts.append(s.astype(np.int32))
        ends.append(e.astype(np.int32))
    lists = lambda xs: pa.array(xs, pa.list_(pa.int32()))
    keys = [None if d == -(2**63) else d for d in ids.tolist()]
    n_bytes = [len(k) + r for k, r in zip(kept, removed)]
    return pa.Table.from_arrays([pa.array(keys, pa.int64()), pa.array(copies), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), lists(starts), lists(ends), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), *(table.column(c).take(order) for c in carry)], ["doc_id", "copy", "n_bytes", "n_removed", "span_starts", "span_ends", "kept", *carry])


CUT_SCHEMA = "doc_id long, copy int, n_bytes long, n_removed long, span_starts array<int>, span_ends array<int>, kept binary"


def remove_repeats(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, copy (0 unless rows repeat a doc_id), n_bytes, n_removed, span_starts, span_ends and the bytes kept."""
    return _cut_rows(docs, [], False, part_bytes)


def _cut_rows(docs: DataFrame, carry: list[str], as_text: bool, part_bytes: int = PART_BYTES) -> DataFrame:
    """As above (``kept`` as text if asked for), with the columns ``carry`` of the documents under the names
    ``__carry_<name>``.

    All steps use one shuffle of the texts, which Spark reuses.
    """
    total = table_bytes(docs)
    parts = parts_for(total, part_bytes, least=12)
    splitters = sampled_splitters(docs, 2 * total, min(8 * parts, BUCKETS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"__carry_{c}") for c in carry))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-(2**63)))), F.lit(parts)).cast("long")).repartition(parts, "part")
    reports = rows.groupBy("part").applyInArrow(_report, "token long, part long, seen int")
    twice = reports.withColumn("times", F.sum("seen").over(Window.partitionBy("token"))).where(F.col("times") >= 2).select("part", "token")
    contexts = rows.groupBy("part").cogroup(twice.groupBy("part")).applyInArrow(lambda t, tokens: _contexts(t, tokens, splitters), CONTEXT_SCHEMA)
    # the leading bytes are in the context; a column of them would only travel along
    lead = F.expr(f"substring(context, 1 + distance - if(distance > {HALF}, {HALF}, 0), 16)")
    spans = contexts.repartition(min(parts, BUCKETS), "bucket").withColumn("lead", lead).sortWithinPartitions("lead").drop("lead").mapInArrow(_resolve_batches, SPAN_SCHEMA)
    schema = T.StructType([*T._parse_datatype_string(CUT_SCHEMA.replace("kept binary", "kept string") if as_text else CUT_SCHEMA).fields, *(T.StructField(f"__carry_{c}", docs.schema[c].dataType) for c in carry)])
    carried = [f"__carry_{c}" for c in carry]
    return rows.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(lambda t, s: _cut(t, s, carried, as_text), schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with their repeats cut out of ``text``; ``n_chars``, if there, counts anew. Every row stays."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    # in one Python step: a second one in the same tasks would double the workers
    cut = _cut_rows(docs, carry, True)
    of = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept"), **{c: F.col(f"__carry_{c}") for c in carry}}
    if "n_chars" in carry:
        of["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(of[c].alias(c) for c in docs.columns))
