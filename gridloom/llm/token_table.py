"""Token ids as Parquet list columns, with controlled encodings, row groups and page indexes.

Layout: one row per document in ascending ``doc_id`` order over the files (``part`` is the file's rank),
columns ``doc_id``, ``part``, ``local_start`` (ids before it in its part), ``n_tokens`` and the list
``ids``. Integers are delta encoded (Parquet v2 pages) or, for repetitive streams, dictionary encoded;
row groups and pages have set sizes; Parquet's column and offset indexes are written, so a reader of a
few documents or of the narrow columns skips the pages of ids.

Edge cases: a null or empty text is the closing id alone; repeated doc_ids keep all their rows (ordered
by text); null doc_ids come first; an empty table gives files without rows. Long texts need no special
care: nothing is cut.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import Memo, gather, gather_rows, parts_for, slices, table_bytes, word_lists, work_path

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
PART_BYTES = 8 << 20  # of the input's files

TABLE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


# Byte-level vocabularies write each byte that isn't a printing Latin-1 sign as U+0100 and up, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


# A run of Latin-1 letters, and the full stops and commas after it.
_PLAIN = "^(?P<core>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<tail>[.,]*)$"


class ChunkEncoder:
    """Ids of a text through ids of its chunks between spaces and line ends.

    The tokenizer's normalizer and pre-tokenizer treat a space and a line end as a break that no match,
    composition or merge crosses, so a text's ids are its chunks' ids one after another.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core; more threads than that only contend
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)}
        self.fence = min(added.items(), default=None)
        self.memo = Memo(self._fill)
        self.tails: dict[str, bytes] = {"": b""}
        # taking words apart is right where runs of letters and of signs are split, and the text is only composed and lowered
        steps = json.loads(self.tokenizer.to_str())
        self.simple = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"] and r"|[\p{L}]+|" in steps["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", "")

    def _fill(self, chunks: list[str], together: int = 256) -> dict[str, bytes]:
        """Ids of chunks that are not in the memory.

        A lower-case run of Latin letters goes to the model alone; other chunks are encoded many at a time, a
        special token between them, which is taken out before anything else is done.
        """
        found: dict[str, bytes] = {}
        rest = []
        for c in chunks:
            if not (self.simple and c.isalpha() and max(c) < "\u0100" and c == c.lower()):
                rest.append(c)
                continue
            spelled = c if c.isascii() else c.encode().decode("latin-1").translate(_BYTE_SIGNS)
            found[c] = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<i4").tobytes()
        mark = self.fence[1][:1] if self.fence else ""
        plain = [c for c in rest if self.fence and mark not in c]
        found.update((c, np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<i4").tobytes()) for c in rest if not self.fence or mark in c)
        groups = [plain[i : i + together] for i in range(0, len(plain), together)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([self.fence[1].join(g) for g in groups], add_special_tokens=False) if groups else []):
            ids = np.array(got.ids, "<i4")
            raw, fences = ids.tobytes(), (4 * np.flatnonzero(ids == self.fence[0])).tolist()
            found.update(zip(group, map(raw.__getitem__, map(slice, [0, *(f + 4 for f in fences)], [*fences, len(raw)]))))
        return found

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and the words' offsets. A plain word is its lower-case letters and
        its signs; only distinct letters are looked up."""
        if not self.simple:
            return gather(np.arange(len(words)), np.arange(len(words) + 1), self.memo(words.to_pylist()))
        taken = pc.extract_regex(words, _PLAIN)
        plain = np.asarray(taken.is_valid())
        taken = taken.drop_null()
        lows, tails = pc.utf8_lower(taken.field("core")).dictionary_encode(), taken.field("tail").dictionary_encode()
        others = words.filter(pa.array(~plain)).to_pylist()
        parts = self.memo([*lows.dictionary.to_pylist(), *others])
        n = len(lows.dictionary)
        parts += [self._tail(t) for t in tails.dictionary.to_pylist()] + [b""]
        pairs = np.empty((len(words), 2), np.int64)
        pairs[plain, 0], pairs[plain, 1] = np.asarray(lows.indices), np.asarray(tails.indices) + n + len(others)
        pairs[~plain, 0], pairs[~plain, 1] = n + np.arange(len(others)), len(parts) - 1
        return gather(pairs.ravel(), 2 * np.arange(len(words) + 1), parts)

    def _tail(self, signs: str) -> bytes:
        if signs not in self.tails:
            self.tails[signs] = np.array(self.tokenizer.encode(signs, add_special_tokens=False).ids, "<i4").tobytes()
        return self.tails[signs]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (each closed by ``end_id``, if given) and the texts' offsets."""
        words, codes, offsets = word_lists(pc.replace_substring(texts, "\n", " "), " ", as_strings=False)
        pool, at = self._words(words)
        if end_id is not None:
            codes = np.insert(codes, offsets[1:], len(words))
            offsets = offsets + np.arange(len(offsets))
            pool, at = np.append(pool, np.int32(end_id)), np.append(at, at[-1] + 1)
        return gather_rows(codes, offsets, pool, at)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _encode_batches(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = 0
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for batch in batches:
        for rows in slices(batch, "text", 10 << 20):
            ids, at = encoder(path).encode(rows.column("text"), end_id)
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before + at[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            before += int(at[-1])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents in ascending doc_id order, range-partitioned by sampled splitters, as rows of the token table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts_for(table_bytes(docs), part_bytes, least=2)
    ordered = rows.repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def run(batches):
        return _encode_batches(tokenizer, end_id, batches)

    return ordered.mapInArrow(run, TABLE_SCHEMA)


def write_token_table(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, encoding: str = "delta", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Tokenize and write. ``encoding`` is "delta" (DELTA_BINARY_PACKED) or "dictionary"; both lossless."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError("encoding: delta or dictionary")
    (
        tokenize(docs, tokenizer, end_id).write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows).option("compression", "zstd").parquet(path)
    )


def read_token_table(spark: SparkSession, path: str, columns: list[str] | None = None, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Rows of the table with the global ``start``; only the asked columns and id range are read.

    ``start`` needs each part's number of ids: a count over two narrow columns, one row per part.
    """
    data = spark.read.schema(TABLE_SCHEMA).parquet(path)
    sums = data.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for part, n in sums:
        bases.append((part, base))
        base += n
    rows = data
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    starts = spark.createDataFrame(bases, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("__base", T.LongType())]))
    rows = rows.join(F.broadcast(starts), "part").withColumn("start", F.col("__base") + F.col("local_start"))
    return rows.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = np.asarray(ids.values).astype("<u4", copy=False)
        at = np.asarray(ids.offsets)
        view = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def id_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> str:
    """Write the table into the shared work folder; its path."""
    path = work_path(docs.sparkSession, "tokens")
    write_token_table(docs, path, tokenizer)
    return path
