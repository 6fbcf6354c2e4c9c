"""SentencePiece encoding with byte offsets into the original text, and decoding.

Encoding normalises the text by longest-prefix matches in the model's compiled character map (none in a
model with identity normalisation), recording for every normalised byte the original byte it came from;
then each piece's span in the normalised text is projected to a span of original bytes.

The normalised text is encoded segment by segment: a segment is a run of word-boundary marks with what
follows it. No piece of the model has a mark after another character, so no merge crosses a segment's
start and the ids of a text are those of its segments in order; a model whose pieces break this rule is
encoded as a whole. Segments' ids come from the sentencepiece library and are kept in a bounded cache.

Edge cases: null is the empty text; it has no pieces. A literal word-boundary mark is treated as the
library treats it (it decodes to a space) and keeps its three original bytes in its span. Nothing is
cut, however long the text. Repeated rows give repeated results; an empty table gives no rows; columns
named as those added are replaced. Ties between merges are the library's.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import Memo, gather, give_back, slices, texts_of, word_lists

MARK = "▁"
ENCODED = "ids array<int>, starts array<int>, ends array<int>, decoded string"


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 and a pool of replacements.

    ``longest(data, at)`` is the longest key that ``data`` has at ``at``: (its length, its replacement).
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        units, found = self.units, None
        node = self._child_base(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._child_base(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1] : end]

    @staticmethod
    def _child_base(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = blob[i]
            value |= (b & 127) << shift
            shift, i = shift + 7, i + 1
            if b < 128:
                return value, i

    i = 0
    while i < len(blob):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = blob[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, i = blob[i : i + n], i + n
        yield tag >> 3, value


class Normalizer:
    """The model's normaliser with alignment: ``run(text)`` gives the normalised bytes and, for each of
    them and the end, the original byte offset."""

    def __init__(self, model: bytes):
        spec = next((v for k, v in _fields(model) if k == 3), b"")
        got = dict(_fields(spec))
        self.map = CharMap(got.get(2, b""))
        self.dummy, self.squeeze, self.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
        pieces = [dict(_fields(v)) for k, v in _fields(model) if k == 1]
        texts = [bytes(p.get(1, b"")).decode() for p in pieces]
        own = any(p.get(3, 1) == 4 for p in pieces)  # user-defined pieces may span marks
        self.cuttable = self.escape and self.dummy and not own and MARK in texts and not any(MARK in t.lstrip(MARK) for t in texts)

    def run(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text with spaces for marks (one byte each), without the dummy prefix, and the offsets."""
        data = text.encode("utf-8", "surrogatepass")
        if not self.map and not self.squeeze:
            if MARK not in text:
                return text, np.arange(len(data) + 1, dtype=np.int32)
            raw = np.frombuffer(data, np.uint8)
            marks = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81))
            keep = np.ones(len(raw) + 1, bool)
            keep[marks + 1] = keep[marks + 2] = False
            return text.replace(MARK, " "), np.flatnonzero(keep).astype(np.int32)
        out, offsets, i = bytearray(), [], 0
        while i < len(data):
            hit = self.map.longest(data, i) if self.map else None
            if hit is None:
                n = 1 + (data[i] >= 0xC0) + (data[i] >= 0xE0) + (data[i] >= 0xF0)
                hit = n, data[i : i + n]
            out += hit[1]
            offsets += [i] * len(hit[1])
            i += hit[0]
        offsets.append(len(data))
        if self.squeeze:
            keep, space = [], True
            for k, b in enumerate(out):
                if b != 32 or not space:
                    keep.append(k)
                space = b == 32
            while keep and out[keep[-1]] == 32:
                keep.pop()
            offsets = [offsets[k] for k in keep] + [offsets[keep[-1] + 1] if keep else len(data)]
            out = bytes(out[k] for k in keep)
        return bytes(out).decode("utf-8", "surrogatepass").replace(MARK, " "), np.array(offsets, np.int32)


class PieceCodec:
    """Encode with offsets, and decode, exactly as the sentencepiece library does."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer(model)
        self.mark = np.array([self.library.piece_to_id(MARK)], np.int32).tobytes()
        self.memo = Memo(self._new, 200_000)
        self.sizes = np.array([1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).replace(MARK, " ").encode()) for i in range(self.library.get_piece_size())], np.int64)
        self.opens = np.array([self.library.id_to_piece(i).startswith(MARK) for i in range(self.library.get_piece_size())])

    @staticmethod
    def segments(normal: str) -> list[str]:
        """Each segment without its first mark: further marks (as spaces), then what follows them."""
        words = normal.split(" ")
        if "" not in words:
            return words
        out, held = [], ""
        for w in words[:-1]:
            if w:
                out.append(held + w)
                held = ""
            else:
                held += " "
        return [*out, held + words[-1]]

    def _ids(self, normals: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of normalised texts, one after another, and the texts' offsets."""
        if not self.normalizer.cuttable:
            lists = self.library.encode(normals, num_threads=1)
            return np.array([i for x in lists for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        plain = [bool(t) and t[0] != " " and t[-1] != " " and "  " not in t for t in normals]
        odd = [self.segments(t) if t else [] for t, p in zip(normals, plain) if not p]
        # the words of plain texts are their segments; those of other texts come after all of them
        words, codes, offsets = word_lists(pa.array([t for t, p in zip(normals, plain) if p], pa.string()), " ")
        parts = self.memo([*words, *(w for row in odd for w in row)])
        codes = np.concatenate([codes, np.arange(len(words), len(parts))])
        offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(row) for row in odd], dtype=np.int64)])
        ids, at = gather(codes, offsets, parts)
        if all(plain):
            return ids, at
        place = np.argsort(np.argsort(~np.array(plain), kind="stable"), kind="stable")
        lists = [ids[at[k] : at[k + 1]] for k in place]
        return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])

    def _new(self, keys: list[str], together: int = 256) -> dict[str, bytes]:
        """Ids of segments that are not cached: those of one mark are encoded many at a time and cut where
        a piece begins with a mark."""
        plain = [k for k in keys if k and k[0] != " "]
        odd = [k for k in keys if k and k[0] == " "]
        found = {"": self.mark} | {k: np.array(x, np.int32).tobytes() for k, x in zip(odd, self.library.encode(odd, num_threads=1) if odd else [])}
        groups = [plain[i : i + together] for i in range(0, len(plain), together)]
        for group, ids in zip(groups, self.library.encode([" ".join(g) for g in groups], num_threads=1) if groups else []):
            ids = np.array(ids, np.int32)
            cuts = (4 * np.flatnonzero(self.opens[ids])).tolist()
            raw = ids.tobytes()
            found.update(zip(group, map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)]))))
        return found

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids, and the start and end of each piece in bytes of the original text."""
        normals = [self.normalizer.run(t) for t in texts]
        out = []
        flat, at = self._ids([n for n, _ in normals])
        for (normal, offsets), a, b in zip(normals, at[:-1].tolist(), at[1:].tolist()):
            ids = flat[a:b]
            if not len(ids):
                out.append((ids, ids, ids))
                continue
            ends = np.cumsum(self.sizes[ids])
            if ends[-1] != len(offsets):  # an unknown piece stands for what it covers
                sizes = [len(p.surface.encode()) for p in self.library.encode(normal, return_type="proto").pieces]
                ends = np.cumsum(sizes) + 1
            ends = offsets[ends - 1]  # one byte less: the prefix that the library adds
            starts = np.empty_like(ends)
            starts[0], starts[1:] = 0, ends[:-1]
            out.append((ids, starts, ends))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids])


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.empty(0, np.int32), pa.int32()))


def encode_documents(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default, without clashing ones) with ids, starts, ends and the decoded text."""
    added = [x.split()[0] for x in ENCODED.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*keep) if text in keep else docs.select(*keep, text)
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + list(T._parse_datatype_string(ENCODED).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(model)
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                coded = work.encode_all(texts_of(part.column(text)))
                decoded = work.decode_all([c[0] for c in coded])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(_lists([c[k] for c in coded]) for k in range(3)), pa.array(decoded, pa.string())], [*keep, *added])
        give_back()

    return rows.mapInArrow(run, schema)
