import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from gridloom.llm import byte_codec as bc
from gridloom.llm.common import table
from gridloom.llm.queries import op13_byte_codec, tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bc.ByteCodec(RANKS, P.PATTERN)


def odd_texts(n=600, longest=80):
    rng = random.Random(9)
    signs = list("ab \n\t  　'srev1289!<|é漢😀\x00\x1c\x1d\x85　۳½") + ["'ll", "'re", "  ", "\n\n", "<|endoftext|>", "՘", "\U0003fc3b"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, longest))) for _ in range(n)] + ["", " ", "  ", " a", "it's 'reel", "x" * 3000, " " * 3000 + "y", "\n" * 50]


def ids_of(codec, text):
    return codec.encode([codec.pieces(text)])[0].tolist()


def test_ids_equal_the_library(codec, plain):
    for text in odd_texts():
        assert "".join(codec.pieces(text)) == text
        assert ids_of(codec, text) == plain.encode_ordinary(text), ascii(text)


def test_every_character_is_split_as_the_library_splits_it(codec):
    odd = bc._unassigned()
    joined = {c for c in odd if codec._joins(c)}
    every = [chr(i) for i in (*range(0x3000), *range(0x3000, 0x110000, 7)) if not 0xD800 <= i < 0xE000 and chr(i) != "'"] + sorted(odd)
    # a letter, a digit, or neither, to either side
    for c in every:
        first = [p for p in "a0" if len(codec.probe.encode_ordinary(p + c)) <= len(c.encode())]
        assert [p for p in "a0" if codec.pieces(p + c) == [p + c]] == first, hex(ord(c))
    assert odd and joined < odd


def test_decoding_round_trips(codec, plain):
    import numpy as np

    texts = odd_texts()
    ids, offsets = codec.encode([codec.pieces(t) for t in texts])
    raw, ends = codec.decode(ids, offsets)
    assert [raw[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [t.encode() for t in texts]
    assert codec.decode(np.array([plain.encode_ordinary("漢")[0]], np.int32), np.array([0, 1]))[0].tobytes() == plain.decode_single_token_bytes(plain.encode_ordinary("漢")[0])


def test_hand_over_needs_a_shared_boundary(codec):
    assert codec.hand_over("one two three four", 5) == 7  # the next chunk begins within " two"
    assert codec.hand_over("x" * 40, 20) is None
    assert codec.hand_over("aaaa'rexx", 4) == 4 and codec.hand_over("aaaaaa'r", 4) is None  # may go on as 're


@pytest.mark.parametrize("chunk,overlap", [(32, 8), (64, 64), (200, 16)])
def test_chunks_agree_with_the_whole(spark, plain, chunk, overlap):
    texts = [*odd_texts(80, 400), "x" * 700, "a" * 150 + " " + "b" * 500, (" " * 90 + "\n" * 90) * 4, None, ""]
    rows = spark.createDataFrame([(i, t, [str(i)]) for i, t in enumerate(texts)], "doc_id long, text string, more array<string>").repartition(3)
    got = bc.decode_documents(bc.encode_documents(rows, RANKS, P.PATTERN, chunk=chunk, overlap=overlap), RANKS, P.PATTERN).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        assert r.ids == plain.encode_ordinary(texts[r.doc_id] or "") and r.text == texts[r.doc_id] and r.more == [str(r.doc_id)]
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_documents(spark, docs, no_docs, plain):
    got = bc.decode_documents(bc.encode_documents(docs, RANKS, P.PATTERN, chunk=4096, overlap=256), RANKS, P.PATTERN)
    assert set(got.columns) == set(docs.columns) | {"decoded"}
    want = sorted((r.doc_id or -1, plain.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.ids) for r in got.collect()) == want
    assert bc.encode_documents(no_docs, RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bc.encode_documents(docs, RANKS, P.PATTERN, chunk=100, overlap=200)


def test_query_digests(spark, sf, plain):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = op13_byte_codec(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
