import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from gridloom.llm import token_table as tt
from gridloom.llm.common import table
from gridloom.llm.queries import op8_token_files, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    rng = random.Random(3)
    signs = list("abAB \n\t  éßÉ漢字😀'!1.,　İΣσ́")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "<|endoftext|>x a<|startoftext|>", "a<b <", "á ́a", "it's 'tis don'T we'll", "Straße, ÉTÉ.", "word.,", ".,word", "ªº µ", "x" * 3000, "0 00 1a"]
    ids, at = tt.ChunkEncoder(PATH).encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t
    closed, at = tt.ChunkEncoder(PATH).encode(pa.array(["a", None, "b c"]), 2)
    assert closed[at[1] - 1] == 2 and at[2] - at[1] == 1 and closed[-1] == 2


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_files(spark, docs, library, tmp_path, encoding):
    path = f"{tmp_path}/{encoding}"
    tt.write_token_table(docs, path, PATH, encoding=encoding, page_rows=5)
    rows = tt.read_token_table(spark, path).collect()
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: r.start), texts):
        assert r.doc_id == doc_id and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids == [*library.encode(text, add_special_tokens=False).ids, 2]
        at += r.n_tokens
    assert len(rows) == len(texts)
    files = sorted(tmp_path.glob(f"{encoding}/part-*.parquet"))
    column = pq.ParquetFile(max(files, key=lambda f: f.stat().st_size)).metadata.row_group(0).column(4)
    assert column.has_offset_index and column.has_column_index
    assert any(e.startswith("DELTA") for e in column.encodings) if encoding == "delta" else column.has_dictionary_page
    # selective reads
    some = tt.read_token_table(spark, path, ["doc_id", "n_tokens"], 3, 9)
    assert {r.doc_id for r in some.collect()} == set(range(3, 10))
    assert "ids" not in some._jdf.queryExecution().executedPlan().toString()


def test_empty(spark, no_docs, tmp_path):
    tt.write_token_table(no_docs, f"{tmp_path}/none", PATH)
    assert tt.id_digests(tt.read_token_table(spark, f"{tmp_path}/none")).count() == 0
    with pytest.raises(ValueError):
        tt.write_token_table(no_docs, f"{tmp_path}/x", PATH, encoding="plain")


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    at = 0
    for r in sorted(op8_token_files(spark, sf).collect()):
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
