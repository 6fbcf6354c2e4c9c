"""Shared helpers: the work folder, Arrow batch utilities and word-hash caches.

All hashing here is deterministic across workers (no use of Python's salted ``hash``).
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``. Where that is unset a local session gets a folder of its
    own, which goes at the end; on a cluster that is an error, as every executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_gridloom_work_root"):
        folder = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark._gridloom_work_root = f"file://{folder}"
    return spark._gridloom_work_root


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends in files every executor can read."""
    spark = df.sparkSession
    path = work_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables made by ``materialize``, once nothing that is still to run reads them."""
    for df in tables:
        path = df._gridloom_path
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return memory that is free in this worker to the system, after a task's last batch: workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def parts_for(total_bytes: int | None, per_part: int, least: int = 1) -> int:
    """How many parts keep each near ``per_part`` bytes."""
    return max(least, -(-int(total_bytes or 0) // per_part))


def table_bytes(df: DataFrame, text: str = "text") -> int:
    """About how large a table's files are: the files' sizes where it is read from them as it is, without a
    pass over it; else half of its texts' bytes, counted."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    if plan.nodeName().startswith(("LogicalRelation", "Relation")):
        return int(plan.stats().sizeInBytes())
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow string column, null as the empty string."""
    return pc.fill_null(column, "").to_pylist()


_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on a uint64 array (wraps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(words: list[str]) -> dict[str, bytes]:
    import xxhash

    return {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")).to_bytes(8, "little") for w in words}


class WordHashes:
    """64-bit hashes of words, and of all words of many texts at once."""

    def __init__(self) -> None:
        self.memo = Memo(_hash_words, 120_000)

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(self.memo(words)), np.uint64)

    def of_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the white-space separated words, one text after another, and the texts' offsets."""
        words, codes, offsets = word_lists(column)
        return self(words)[codes], offsets


SHINGLE = 5


def run_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``size`` words, in order, as uint64."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        out ^= out >> np.uint64(29)
    return mix64(out + np.uint64(size))  # the length of a run is part of its identity


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with an equal ``key`` as one table, across batch borders. The input must be sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        values = keys.to_pylist() if not pa.types.is_integer(keys.type) else np.asarray(keys)
        if isinstance(values, np.ndarray):
            cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        else:
            cuts = np.array([i for i in range(1, len(values)) if values[i] != values[i - 1]], int)
        starts = np.concatenate([[0], cuts]).astype(int)
        ends = np.concatenate([cuts, [len(values)]]).astype(int)
        for a, b in zip(starts, ends):
            if held and values[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts have about ``most_bytes`` (a longer text is a piece alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    piece = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_lists(column: pa.Array, separator: str | None = None, as_strings: bool = True) -> tuple[list[str] | pa.Array, np.ndarray, np.ndarray]:
    """Words of texts: the distinct ones (an Arrow array unless ``as_strings``), each text's words as numbers of
    these, one text after another, and the offsets of the texts. Without a separator words are split at white
    space and never empty."""
    texts = pc.fill_null(column, "")
    lists = pc.utf8_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary, np.asarray(coded.indices)
    if as_strings:
        words = words.to_pylist()
    if separator is None and "" in words:
        keep = codes != words.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return words, codes, offsets


def gather_rows(codes: np.ndarray, offsets: np.ndarray, pool: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists put together: list i has the values ``pool[at[c]:at[c + 1]]`` for its codes c, in order."""
    counts = (at[1:] - at[:-1])[codes]
    ends = np.concatenate([[0], np.cumsum(counts)])
    index = np.repeat(at[:-1][codes] - ends[:-1], counts)
    index += np.arange(len(index))
    return pool[index], ends[offsets]


def gather(codes: np.ndarray, offsets: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """int32 lists put together: list i has the int32 values of ``parts[c]`` for its codes c, in order."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return gather_rows(codes, offsets, np.frombuffer(b"".join(parts), np.int32), np.concatenate([[0], np.cumsum(sizes)]))


class Memo:
    """A bounded memory of bytes by word, in two generations: words still in use outlive a turn.

    ``fill`` finds the bytes of new words; only speed depends on the bounds. Of a worker's memories only the
    one in use is filled: a worker that goes on to another operator's tasks lets go of the last one's words.
    """

    active: Memo | None = None

    def __init__(self, fill, limit: int = 350_000, longest: int = 48):
        self.fill, self.limit, self.longest = fill, limit, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        got = self.young.get(word)
        return self.old.get(word) if got is None else got

    def __call__(self, words: list[str]) -> list[bytes]:
        if Memo.active is not self:
            if Memo.active is not None:
                Memo.active.young, Memo.active.old = {}, {}
            Memo.active = self
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        rows = list(map(young.get, words))
        missing = []
        for i in [i for i, r in enumerate(rows) if r is None]:
            w = words[i]
            got = old.get(w)
            if got is None:
                missing.append(i)
            else:
                rows[i] = young[w] = got
        if missing:
            found = self.fill([words[i] for i in missing])
            for i in missing:
                w = words[i]
                got = rows[i] = found[w]
                if len(w) <= self.longest:
                    young[w] = got
        return rows


WORDS = WordHashes()
