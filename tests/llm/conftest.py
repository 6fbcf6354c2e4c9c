import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, part string, kept string, cls string, shard string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls, empty and white texts, copies, near copies, shared passages, a very long text, repeated rows."""
    rng = random.Random(5)
    passage = words(rng, 60)
    base = words(rng, 120)
    near = base.split()
    near[50] = "changed"
    texts = [None, "", " \n\t ", "one", "one two three four", base, base, " ".join(near), f"{words(rng, 40)} {passage} {words(rng, 30)}", f"{passage} {words(rng, 50)}", words(rng, 30_000), "x" * 5000, "é" * 300 + "漢字" * 100]
    texts += [words(rng, rng.randint(1, 200)) for _ in range(40)] + [base, passage, passage]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, "no id here at all", "en", None, 3), (None, base, "en", "src1", 3)]
    return [(*r, 1.0, "ids", "part", "kept", "cls", "shard") for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
