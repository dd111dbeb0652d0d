import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import models as M


@pytest.fixture(scope="module")
def interactions(spark):
    return spark.createDataFrame([(1, 10, 4.0), (1, 11, 5.0), (2, 10, 3.0), (2, 12, 4.5), (3, 11, 2.5), (3, 12, 4.0)], "userID bigint, movieID bigint, interaction_rating double")


@pytest.fixture(scope="module")
def titles(spark):
    return spark.createDataFrame([(10, "M1"), (11, "M2"), (12, "M3")], "movieID bigint, title string")


def test_popularity(spark):
    f = spark.createDataFrame([(1, 4.8, 100), (2, 4.2, 80), (3, 3.9, 60), (4, 4.6, 40)], "movieID bigint, movie_avg_rating double, movie_rating_count bigint")
    t = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "movieID bigint, title string")
    m = M.Popularity().fit(f, t)
    got = [(r.movieID, round(r.weighted_rating, 6)) for r in m.recommend().collect()]
    assert got == [(1, 4.658333), (2, 4.267308), (3, 4.115909)]
    assert {r.movieID for r in M.Popularity(top_n=2, pool_size=2).fit(f, t).recommend(random_state=3).collect()} == {1, 2}
    assert m.recommend_one().count() == 1
    with pytest.raises(KeyError):
        M.Popularity().fit(f.drop("movie_rating_count"), t)
    with pytest.raises(ValueError):
        M.Popularity().recommend()


def test_svd_is_the_low_rank_reconstruction(spark, interactions, titles):
    m = M.SVD(n_factors=1).fit(interactions)
    pairs = spark.createDataFrame([(u, i) for u in (1, 2, 3) for i in (10, 11, 12)] + [(999, 12), (1, 999)], "userID bigint, movieID bigint")
    got = {(r.userID, r.movieID): r.prediction for r in m.predict(pairs).collect()}
    want = {1: (4.5, 4.5, 4.5), 2: (3.375, 3.375, 4.5), 3: (2.875, 2.875, 4.0)}
    cells = np.array([[-0.5, 0.5, 0], [-0.75, 0, 0.75], [0, -0.75, 0.75]])
    u, s, vt = np.linalg.svd(cells)
    low = s[0] * np.outer(u[:, 0], vt[0]) + np.array([[4.5], [3.75], [3.25]])
    for a, user in enumerate((1, 2, 3)):
        for b, item in enumerate((10, 11, 12)):
            assert math.isclose(got[user, item], low[a, b], abs_tol=1e-9)
            assert math.isclose(got[user, item], want[user][b], abs_tol=1e-6)
    assert got[999, 12] is None and got[1, 999] is None
    r = m.recommend(1, titles).collect()
    assert [(x.movieID, round(x.prediction, 6), x.title, x["rank"]) for x in r] == [(12, 4.5, "M3", 1)]
    assert m.evaluate(interactions).first().n == 6
    with pytest.raises(ValueError):
        m.recommend(999, titles)
    with pytest.raises(ValueError):
        M.SVD().fit(interactions.drop("interaction_rating"))


def test_svd_averages_repeats_and_may_clip(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 1, 5.0), (1, 2, 4.0), (2, 1, 1.0), (2, 2, 2.0)], "userID bigint, movieID bigint, interaction_rating double")
    m = M.SVD(n_factors=1, clip_to=(0.5, 5.0), to_half_stars=True).fit(df)
    assert m.seen.where("u = 1 AND i = 1").first().r == 4.0
    assert all((2 * r.prediction) % 1 == 0 for r in m.predict(df).collect())


@pytest.mark.parametrize("cells", [500, 10_000])
def test_svd_by_blocks_agrees_with_numpy(spark, monkeypatch, cells):
    from pyspark.mllib.linalg.distributed import RowMatrix

    def no(*_):
        raise MemoryError("all factors in the driver's JVM")

    monkeypatch.setattr(RowMatrix, "computeSVD", no)
    monkeypatch.setattr(M, "SVD_CELLS", cells)
    rng = np.random.default_rng(3)
    rated = rng.random((90, 70)) < 0.5
    r = rng.integers(1, 11, (90, 70)) / 2
    df = spark.createDataFrame([(u, i, float(r[u, i])) for u, i in zip(*map(lambda a: a.tolist(), np.nonzero(rated)), strict=True)], "userID bigint, movieID bigint, interaction_rating double")
    m = M.SVD(n_factors=4).fit(df)
    mean = (r * rated).sum(1, keepdims=True) / rated.sum(1, keepdims=True)
    u, s, vt = np.linalg.svd((r - mean) * rated)
    low = mean + (u[:, :4] * s[:4]) @ vt[:4]
    got = {(x.userID, x.movieID): x.prediction for x in m.predict(df).collect()}
    assert len(got) == rated.sum() and all(math.isclose(p, low[k], abs_tol=1e-8) for k, p in got.items())
    titles = spark.createDataFrame([(i, f"t{i}") for i in range(70)], "movieID bigint, title string")
    best = {}
    for x in m.recommend_all(m.users.select("u"), titles, 5).collect():
        best.setdefault(x.userID, []).append((x["rank"], x.movieID, x.title))
    for k in range(90):
        want = sorted((i for i in range(70) if not rated[k, i]), key=lambda i: -low[k, i])[:5]
        assert sorted(best[k]) == [(n + 1, i, f"t{i}") for n, i in enumerate(want)]


def test_eigenvectors_of_zero_and_close_values():
    zero = M.top_eigenvectors(lambda v: 0 * v, 30, 3)
    assert np.allclose(zero.T @ zero, np.eye(3))
    d = np.r_[5.0, 4.9999, np.arange(98) / 20]
    v = M.top_eigenvectors(lambda x: d * x, 100, 4)
    assert np.allclose(v.T @ v, np.eye(4)) and np.allclose(np.abs(v[[0, 1, 99, 98], range(4)]), 1.0)


@pytest.mark.parametrize("exact", [True, False])
def test_factorization(spark, interactions, titles, exact):
    m = M.MatrixFactorization(n_factors=2, n_epochs=5, exact=exact).fit(interactions)
    unknown = spark.createDataFrame([(999, 10), (1, 999)], "userID bigint, movieID bigint")
    assert all(math.isclose(r.prediction, 23 / 6) for r in m.predict(unknown).collect())
    assert all(0.5 <= r.prediction <= 5.0 for r in m.predict(interactions).collect())
    assert [r.movieID for r in m.recommend(1, titles).collect()] == [12]
    for r in m.decomposition(interactions).collect():
        assert math.isclose(r.total, r["mean"] + r.user_bias + r.item_bias + sum(r.products), abs_tol=1e-9)
    one = interactions.limit(1).select("userID", "movieID")
    assert m.waterfall(one).count() == 5
    assert [r["rank"] for r in m.top_factors(one, 1).collect()] == [1]
    assert m.because_you_rated(1, 12, interactions).count() == 2
    with pytest.raises(ValueError):
        m.fit(interactions.drop("interaction_rating"))


def test_factorization_learns_a_planted_structure(spark):
    rng = np.random.default_rng(1)
    p, q = rng.normal(0, 0.7, (60, 3)), rng.normal(0, 0.7, (40, 3))
    rows = [(u, i, float(np.clip(3 + p[u] @ q[i] + rng.normal(0, 0.1), 0.5, 5))) for u in range(60) for i in range(40) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "userID bigint, movieID bigint, interaction_rating double")
    s = M.stratified_split(df, "userID", ["movieID"])
    train, test = s.where("NOT held_out").drop("held_out"), s.where("held_out").drop("held_out")
    m = M.MatrixFactorization(n_factors=4, n_epochs=15, reg=0.05).fit(train)
    base = M.errors(test.withColumn("p", F.lit(m.mean)), "interaction_rating", "p").first().rmse
    assert m.evaluate(test).first().rmse < 0.8 * base


def test_temporal_split_is_exact(spark):
    df = spark.range(103).select((F.col("id") % 7).alias("t"), "id")
    a, b = M.temporal_split(df, ["t", "id"])
    want = sorted((i % 7, i) for i in range(103))
    assert sorted(map(tuple, a.collect())) == want[: int(103 * 0.8)] and sorted(map(tuple, b.collect())) == want[int(103 * 0.8) :]


def test_last_of_each(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, i) for i in range(4)], "u int, t int")
    got = M.last_of_each(df, "u", ["t"]).where("held_out").collect()
    assert sorted(map(tuple, got)) == [(1, 8, True), (1, 9, True)]


def test_samples_repeat(spark):
    df = spark.range(100)
    assert M.sample(df, ["id"], 5).collect() == M.sample(df, ["id"], 5).collect()
    assert [r.id for r in M.newest(df, "id", 2).collect()] == [99, 98]


def test_baselines(spark):
    train = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0)], "userID int, movieID int, rating double")
    test = spark.createDataFrame([(1, 1, 4.0), (9, 9, 3.0)], "userID int, movieID int, rating double")
    got = {r.userID: r for r in M.baselines(train, test).collect()}
    assert (got[1].user, got[1].item, got[1].blend) == (3.0, 4.5, 3.75)
    assert math.isclose(got[9].blend, 11 / 3)
    table = {r.model: r for r in M.compare(M.baselines(train, test), ["global", "blend"]).collect()}
    assert table["blend"].mae <= table["global"].mae


def test_svd_sends_the_driver_small_results_only(spark, monkeypatch):
    from pyspark import RDD
    from pyspark.sql import SparkSession

    sent, collect, create = [], RDD.collect, SparkSession.createDataFrame
    monkeypatch.setattr(RDD, "collect", lambda self: [sent.append(max((np.size(x[-1] if isinstance(x, tuple) else x) for x in p), default=0)) for p in collect(self.glom())] and collect(self))
    monkeypatch.setattr(M, "SVD_CELLS", 500)
    monkeypatch.setattr(M, "SVD_PIECE", 16, raising=False)
    rng = np.random.default_rng(4)
    rows = [(u, i, float(r)) for u in range(60) for i, r in enumerate(rng.integers(1, 11, 50) / 2) if r > 1]
    df = spark.createDataFrame(rows, "userID bigint, movieID bigint, interaction_rating double")
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **b: pytest.fail("factors made on the driver"))
    m = M.SVD(n_factors=2).fit(df)
    monkeypatch.setattr(SparkSession, "createDataFrame", create)
    assert sent and max(sent) <= 16
    v = {r.i: r.f for r in m.item_factors.collect()}
    assert sorted(v) == list(range(50))
    f = np.array([v[i] for i in range(50)])
    assert np.allclose(f.T @ f, np.eye(2), atol=1e-9)
