import hashlib
import random
import struct

import pytest

from gridloom.llm import piece_codec as pc
from gridloom.llm.queries import op4_piece_codec, tokenizer_path
from gridloom.llm.common import table

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return pc.PieceCodec(MODEL)


def odd_texts():
    rng = random.Random(3)
    signs = list("ab \n\t  ▁éß漢字😀'!1 　İΣ")
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["", " ", "  ", " a", "▁", "a▁ b", "<s>", "<0x41>", " \n ", "\x00a", "x" * 3000]


def test_ids_equal_the_library(codec):
    texts = odd_texts()
    for text, (ids, starts, ends) in zip(texts, codec.encode_all(texts)):
        assert ids.tolist() == codec.library.encode(text), text
        raw = text.encode()
        if len(ids):
            assert starts[0] == 0 and ends[-1] == len(raw) and (starts[1:] == ends[:-1]).all()
        for i, a, b in zip(ids.tolist(), starts, ends):
            piece = codec.library.id_to_piece(i)
            if codec.library.is_byte(i):
                assert raw[a:b] == bytes([int(piece[3:5], 16)])
            else:
                assert piece.replace("▁", " ").endswith(raw[a:b].decode().replace("▁", " "))


def test_decoding_is_the_library_and_round_trips(codec):
    texts = odd_texts()
    decoded = codec.decode_all([x[0] for x in codec.encode_all(texts)])
    assert decoded == codec.library.decode([codec.library.encode(t) for t in texts])
    assert decoded == [t.replace("▁", " ") for t in texts]


def trie(keys: dict[bytes, bytes]) -> bytes:
    """A small compiled character map: a double array over the keys' bytes, then the replacements."""
    pool, values = b"", {}
    for k, v in keys.items():
        values[k] = len(pool)
        pool += v + b"\0"
    nodes = {b""} | {k[:i] for k in keys for i in range(1, len(k) + 1)}
    units = [0] * 4096
    place, used = {b"": 0}, {0}
    for node in sorted(nodes, key=len):
        here = place[node]
        labels = [n[-1] for n in nodes if n[:-1] == node and n] + ([0] if node in keys else [])
        base = next(b for b in range(1, 4096) if all((here ^ b ^ c) not in used and (here ^ b ^ c) < 4096 for c in labels)) if labels else 0
        units[here] |= base << 10
        if node in keys:
            units[here] |= 1 << 8
            units[here ^ base] = values[node] | 1 << 31
            used.add(here ^ base)
        for n in nodes:
            if n and n[:-1] == node:
                at = here ^ base ^ n[-1]
                used.add(at)
                place[n] = at
                units[at] = n[-1]
    return struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + pool


def test_longest_prefix_normalisation_with_offsets():
    keys = {"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YY", "Ａ".encode(): b"A"}
    n = object.__new__(pc.Normalizer)
    n.map, n.squeeze = pc.CharMap(trie(keys)), False
    text, offsets = n.run("abcabＡ ﬁz")
    assert text == "YYXA fiz"
    raw = "abcabＡ ﬁz".encode()
    assert offsets.tolist() == [0, 0, 3, 5, 8, 9, 9, 12, len(raw)]
    n.squeeze = True
    text, offsets = n.run("  ab   ab ")
    assert text == "X X" and offsets.tolist() == [2, 4, 7, 9]


def test_documents(spark, docs, no_docs, codec):
    got = pc.encode_documents(docs, MODEL)
    assert got.count() == docs.count() and "text" in got.columns
    for r in got.where("doc_id < 12").collect():
        assert r.ids == codec.library.encode(r.text or "") and len(r.starts) == len(r.ends) == len(r.ids)
    assert pc.encode_documents(no_docs, MODEL).count() == 0


def test_query_digests(spark, sf, codec):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = op4_piece_codec(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = codec.library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()
        assert r.covered_bytes == len(texts[r.doc_id].encode())
