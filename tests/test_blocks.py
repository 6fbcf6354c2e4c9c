import math

import numpy as np
import pytest

from gridloom.operators import blocks as bl
from gridloom.operators import layers


def norm(c, rng):
    return bl.Norm(rng.normal(1, 0.2, c), rng.normal(0, 0.2, c))


def attention_weights(c, heads, width, rng):
    m = lambda *s: rng.normal(0, 1, s)
    return bl.AttentionWeights(norm(c, rng), m(c, heads, width), m(heads, width), m(c, heads, width), m(heads, width), m(c, heads, width), m(heads, width), m(heads, width, c), m(c))


def test_convolution_is_a_sum_over_neighbours():
    rng = np.random.default_rng(0)
    x, k, b = rng.normal(size=(4, 5, 2)), rng.normal(size=(3, 3, 2, 3)), rng.normal(size=3)
    got = bl.conv(x, k, b)
    for y in range(4):
        for z in range(5):
            for o in range(3):
                want = b[o] + sum(x[y + dy - 1, z + dx - 1, i] * k[dy, dx, i, o] for dy in range(3) for dx in range(3) for i in range(2) if 0 <= y + dy - 1 < 4 and 0 <= z + dx - 1 < 5)
                assert math.isclose(got[y, z, o], want, abs_tol=1e-12)


@pytest.mark.parametrize("block", [1, 5, 16, 100])
def test_blocked_attention_is_the_whole_softmax(block):
    rng = np.random.default_rng(1)
    q, k, v = rng.normal(0, 30, (16, 3)), rng.normal(0, 30, (16, 3)), rng.normal(size=(16, 4))
    scores = q @ k.T / math.sqrt(3)
    w = np.exp(scores - scores.max(1, keepdims=True))
    assert np.allclose(bl.attended(q, k, v, block), (w / w.sum(1, keepdims=True)) @ v)


def test_norm_groups_divide_the_channels():
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, (4, 4, 6))
    got = bl.group_norm(x, bl.Norm(np.ones(6), np.zeros(6)), most=4)  # three groups of two
    for g in range(3):
        part = got[..., 2 * g : 2 * g + 2]
        assert abs(part.mean()) < 1e-9 and abs(part.std() - 1) < 1e-4


def test_rows_keep_their_columns_and_need_no_shuffle(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(1, [float(v) for v in rng.normal(size=8)], "kept"), (2, None, "null")], "id long, x array<double>, y string").repartition(1)
    w = attention_weights(2, 2, 1, rng)
    out = bl.attention_block(rows, "x", (2, 2, 2), w, block=3)
    got = {r.id: r for r in out.collect()}
    assert got[2].y is None and len(got[1].y) == 8 and out.columns == ["id", "x", "y"]
    assert np.allclose(got[1].y, bl.attention_block_of(np.array(got[1].x).reshape(2, 2, 2), w).ravel())
    plan = bl.attention_block(spark.range(5).selectExpr("id", "array_repeat(1.0D, 8) AS x"), "x", (2, 2, 2), w)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    res = bl.ResWeights(rng.normal(size=(3, 3, 2, 3)), np.zeros(3), norm(3, rng), rng.normal(size=(3, 3, 3, 3)), np.zeros(3), norm(3, rng), np.zeros((1, 12)), np.zeros(12))
    with pytest.raises(ValueError):
        bl.res_block(rows, "x", "x", (2, 2, 2), res)
    with pytest.raises(ValueError):
        bl.attention_block(rows, "x", (2, 2, 2), w, block=0)


def test_channels_are_joined_by_pixel(spark):
    row = spark.createDataFrame([([1.0, 2.0], [10.0, 11.0, 20.0, 21.0])], "a array<double>, b array<double>")
    assert row.select(layers.joined_channels("a", "b", 1, 2)).first()[0] == [1.0, 10.0, 11.0, 2.0, 20.0, 21.0]
