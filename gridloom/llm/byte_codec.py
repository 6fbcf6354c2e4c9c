"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched, and encoded; decoding joins raw bytes.

A pre-token's end depends only on the text from its start on, so two scans of one text that share a boundary agree
from there on. A text longer than ``CHUNK`` code points is cut into chunks of that length, each with the first
``OVERLAP`` code points of the next. Chunks are scanned each on its own, in any task; where a chunk's scan, carried on
into the overlap, and a scan begun at the next chunk's start first have a boundary in common, the chunk hands over.
From its hand-over each chunk's pre-tokens are those of the whole text. They are then encoded, chunks again apart, and
the ids of a text are put together. A text with two neighbours that share no boundary in the overlap (a word longer
than it) is cut again into chunks, with overlaps, 16 times as long, until all agree or one chunk is left.

The library's tables of letters, digits and white space are those of its own Unicode version. Characters that only
the scanner's newer version has assigned are probed one by one, and stand as signs while a text is scanned.

Edge cases: null is the empty text; it has no ids. Nothing is cut, however long a text or word. A special token's
string is ordinary text. Repeated rows and null or repeated ids give a row each; an empty table gives no rows; columns
named ``ids`` or ``decoded`` are replaced. There are no ties: the lowest rank merges first, the leftmost of equals.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import Memo, gather, gather_rows, give_back, materialize, slices, texts_of, work_path

CHUNK, OVERLAP, LONGER = 1 << 16, 1 << 10, 16
#: Code points before a scan's end whose boundaries may change with what follows: the longest contraction.
UNSURE = 3


@cache
def _unassigned() -> frozenset[str]:
    """Characters that the scanner's tables hold for letters, digits or white space and Python's, which are older, don't."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}\p{White_Space}]", every) if unicodedata.category(c) == "Cn")


class ByteCodec:
    """Pre-tokens, ids and bytes as the tiktoken library has them for one rank file and pattern. Every character must
    fall in some match of the pattern, and no alternative may look back."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        # the scanner's \s also has U+001C to U+001F, which aren't white space to the library
        self.scan = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.beyond = re.compile("[ɐ-\U0010ffff]")
        # pairs of a letter or a digit with any byte merge, so ids tell whether a character joins either
        pairs = {bytes([b]): b for b in range(256)} | {p + bytes([b]): 256 * (k + 1) + b for k, p in enumerate((b"a", b"0")) for b in range(256)}
        self.probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})
        self.signs: dict[str, str] = {}
        self.memo = Memo(self._new, 200_000)
        tokens = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            tokens[i] = token
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def _new(self, words: list[str]) -> dict[str, bytes]:
        # a pre-token alone may be split by the pattern, so it goes to the merges as it is
        return {w: np.array(self.library._encode_single_piece(w), np.int32).tobytes() for w in words}

    def _joins(self, c: str) -> bool:
        return any(len(self.probe.encode_ordinary(p + c)) <= len(c.encode()) for p in "a0")

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text, in order."""
        if self.beyond.search(text):
            odd = _unassigned().intersection(text)
            for c in odd:
                if c not in self.signs:
                    self.signs[c] = c if self._joins(c) else "§"
            if any(self.signs[c] != c for c in odd):
                ends = np.cumsum([len(p) for p in self.scan.findall(text.translate({ord(c): self.signs[c] for c in odd}))]).tolist()
                return [text[a:b] for a, b in zip([0, *ends], ends)]
        return self.scan.findall(text)

    def bounds(self, text: str) -> np.ndarray:
        """The starts of the pre-tokens, and the text's end."""
        return np.cumsum([0, *map(len, self.pieces(text))])

    def hand_over(self, piece: str, size: int) -> int | None:
        """Where a chunk with its overlap hands over to the next, which begins at ``size``: the first boundary that
        a scan from the chunk's start and one from the next's have in common; None if there is none."""
        sure = len(piece) - UNSURE
        both = np.intersect1d(self.bounds(piece), self.bounds(piece[size:]) + size, assume_unique=True)
        both = both[(both >= size) & (both <= sure)]
        return int(both[0]) if len(both) else None

    def encode(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """ids of lists of pre-tokens, one after another, and the lists' offsets."""
        coded = pa.array([w for row in lists for w in row], pa.string()).dictionary_encode()
        offsets = np.concatenate([[0], np.cumsum([len(row) for row in lists], dtype=np.int64)])
        return gather(np.asarray(coded.indices), offsets, self.memo(coded.dictionary.to_pylist()))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of lists of ids, one after another, and the lists' offsets."""
        return gather_rows(ids, offsets, self.pool, self.at)


_CODECS: dict[tuple[str, str], ByteCodec] = {}


def codec(ranks: str, pattern: str) -> ByteCodec:
    key = ranks, pattern
    if key not in _CODECS:
        _CODECS[key] = ByteCodec(ranks, pattern)
    return _CODECS[key]


def _id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))


def _cut(rows: DataFrame, keep: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """A row a chunk: __row (one of a text), __chunk, __last, __piece (with its overlap) and, in the first, __keep."""
    fields = [rows.schema[c] for c in keep]
    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField("__chunk", T.LongType()), T.StructField("__last", T.BooleanType()), T.StructField("__piece", T.StringType()), *(T.StructField(f"__keep_{i}", f.dataType) for i, f in enumerate(fields))])
    # written before anything reads it twice, so that a row's number stays what it was when a task is run again
    numbered = rows.select(F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"), *(F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            for i, value in enumerate(texts_of(batch.column("__text"))):
                starts = range(0, len(value), size)
                for group in range(0, len(starts), 64):
                    some = starts[group : group + 64]
                    row = pa.array([batch.column("__row")[i].as_py()] * len(some), pa.int64())
                    numbers = pa.array(range(group, group + len(some)), pa.int64())
                    last = pa.array([s + size >= len(value) for s in some])
                    kept = [batch.column(n).slice(i, 1) if group == 0 else pa.nulls(1, batch.column(n).type) for n in names[4:]]
                    kept = [pa.concat_arrays([k, pa.nulls(len(some) - 1, k.type)]) for k in kept]
                    yield pa.RecordBatch.from_arrays([row, numbers, last, pa.array([value[s : s + size + overlap] for s in some], pa.string()), *kept], names)

    cut = numbered.mapInArrow(run, schema)
    path = work_path(rows.sparkSession, "chunks")
    cut.write.option("parquet.block.size", 16 << 20).parquet(path)  # small row groups: chunks of one text can be read by many tasks
    return rows.sparkSession.read.schema(schema).parquet(path)


def _stitched(chunks: DataFrame, ranks: str, pattern: str, size: int) -> DataFrame:
    """__row, __chunk, __from and __to (null in a last chunk) of every chunk, and whether the row __agrees: a table of
    numbers only, whose largest group has a row for every chunk of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(ranks, pattern)
        for batch in batches:
            to = [None if last else work.hand_over(p, size) for p, last in zip(texts_of(batch.column("__piece")), batch.column("__last").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__row", "__chunk", "__last")), pa.array(to, pa.int64())], ["__row", "__chunk", "__last", "__to"])

    ends = chunks.select("__row", "__chunk", "__last", "__piece").mapInArrow(run, "__row long, __chunk long, __last boolean, __to long")
    text = Window.partitionBy("__row")
    before = F.lag("__to").over(text.orderBy("__chunk"))
    return ends.select("__row", "__chunk", F.coalesce(before - size, F.lit(0)).alias("__from"), "__to", F.every(F.col("__last") | F.col("__to").isNotNull()).over(text).alias("__agrees"))


def _joined(chunks: DataFrame, cuts: DataFrame, keep: list[str], ranks: str, pattern: str) -> DataFrame:
    """The columns ``keep`` and ids of texts whose chunks all agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(ranks, pattern)
        for batch in batches:
            lists = []
            for piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("__piece", "__from", "__to"))):
                words = work.pieces(piece[a:])
                lists.append(words if b is None else words[: int(np.searchsorted(np.cumsum([len(w) for w in words]), b - a)) + 1 if b > a else 0])
            own = [batch.column(c) for c in batch.schema.names if c not in ("__piece", "__from", "__to")]
            yield pa.RecordBatch.from_arrays([*own, _id_lists(*work.encode(lists))], [*(c for c in batch.schema.names if c not in ("__piece", "__from", "__to")), "ids"])

    columns = [f"__keep_{i}" for i in range(len(keep))]
    rows = chunks.join(cuts.where("__agrees").drop("__agrees"), ["__row", "__chunk"]).select("__row", "__chunk", "__piece", "__from", "__to", *columns)
    schema = T.StructType([*(rows.schema[c] for c in ("__row", "__chunk", *columns)), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    whole = rows.mapInArrow(run, schema).groupBy("__row").agg(
        F.max_by(F.struct(*columns), F.col("__chunk") == 0).alias("__keep") if columns else F.lit(None).alias("__keep"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "ids"))), lambda x: x["ids"])).alias("ids"),
    )
    return whole.select(*(F.col(f"__keep.__keep_{i}").alias(c) for i, c in enumerate(keep)), "ids")


def encode_documents(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``keep`` (all by default) with ``ids``, a row for every row."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    if overlap <= UNSURE or overlap > chunk:
        raise ValueError(f"overlap must be over {UNSURE} and at most the chunk")
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__whole"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "__whole", 2 << 20):
                ids, offsets = work.encode([work.pieces(t) for t in texts_of(part.column("__whole"))])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _id_lists(ids, offsets)], [*keep, "ids"])
        give_back()

    # a text of so many bytes is one chunk
    out = rows.where(F.octet_length("__whole") <= chunk).mapInArrow(run, schema)
    rest, size = rows.where(F.octet_length("__whole") > chunk), chunk
    while True:
        chunks = _cut(rest, keep, "__whole", size, overlap)
        cuts = materialize(_stitched(chunks, ranks, pattern, size), "hand-overs")
        out = out.unionByName(_joined(chunks, cuts, keep, ranks, pattern))
        again = cuts.where("not __agrees")
        if again.isEmpty():
            return out
        columns = [F.col(f"__keep_{i}") for i in range(len(keep))]
        torn = chunks.join(again.select("__row", "__chunk"), ["__row", "__chunk"])
        piece = F.struct("__chunk", F.substring("__piece", 1, size).alias("p"))
        torn = torn.groupBy("__row").agg(F.max_by(F.struct(F.lit(0), *columns), F.col("__chunk") == 0).alias("__keep"), F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["p"]), "").alias("__whole"))
        rest = torn.select(*(F.col(f"__keep.__keep_{i}").alias(c) for i, c in enumerate(keep)), "__whole")
        size, overlap = size * LONGER, overlap * LONGER


def decode_documents(coded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows with ``decoded``, the raw bytes of their ``ids`` one after another (binary: ids may part a character)."""
    names = [c for c in coded.columns if c != "decoded"]
    schema = T.StructType([coded.schema[c] for c in names] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("ids")
                offsets = np.asarray(lists.offsets).astype(np.int64)
                flat = np.asarray(lists.values)[offsets[0] : offsets[-1]]
                raw, ends = work.decode(flat, offsets - offsets[0])
                decoded = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), decoded], [*names, "decoded"])
        give_back()

    return coded.select(*names).mapInArrow(run, schema)
