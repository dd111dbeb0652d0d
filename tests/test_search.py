import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import search
from marquee.operators.search import best_products


@pytest.mark.parametrize("value", [None, lambda x: np.clip(x, -1.0, 1.0)])
def test_blocks_agree_with_all_pairs(spark, monkeypatch, value):
    for name, size in (("QUERY_ROWS", 7), ("BLOCK_NUMBERS", 40), ("TASK_NUMBERS", 200), ("HELD", 2)):
        monkeypatch.setattr(search, name, size)
    rng = np.random.default_rng(1)
    q, v = rng.integers(-2, 3, (23, 4)) / 7, rng.integers(-2, 3, (130, 4)) / 3  # many equal products
    seen = {u: sorted({int(i) for i in rng.integers(0, 130, 20)}) for u in range(23)} | {0: list(range(127))}
    users = spark.createDataFrame([(u, q[u].tolist(), u / 10, None if u == 1 else seen[u]) for u in range(23)], "u int, q array<double>, b double, s array<bigint>")
    items = spark.createDataFrame([(i, v[i].tolist()) for i in range(130)] + [(500, [None, 1.0, 1.0, 1.0])], "i bigint, v array<double>")
    got = {}
    for r in best_products(users, items, 5, "u", "i", "q", "v", "b", "s", value).collect():
        got.setdefault(r.u, []).append((r["rank"], r.i, r.score))
    seen[1] = []
    for u in range(23):
        s = {}
        for i in range(130):
            p = 0.0
            for d in range(4):
                p += q[u, d] * v[i, d]
            s[i] = float((value or (lambda x: x))(u / 10 + p))
        best = sorted((-s[i], i) for i in s if i not in seen[u])[:5]
        want = [(k + 1, i, -p) for k, (p, i) in enumerate(best)]
        assert sorted(got[u]) == (want if u else [*want, (4, 500, None)])


def test_text_ids(spark):
    users = spark.createDataFrame([("x", [1.0])], "u string, q array<float>").withColumn("s", F.array(F.lit("c")))
    items = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("c", [9.0]), ("d", [2.0])], "i string, v array<float>")
    assert [(r.i, r.score) for r in best_products(users, items, 2, "u", "i", "q", "v", seen="s").orderBy("rank").collect()] == [("d", 2.0), ("a", 1.0)]
