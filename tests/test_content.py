import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from marquee.operators import content as C


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "movieID bigint, embedding array<float>")


def test_tfidf_is_smoothed_and_of_length_one(spark):
    d = spark.createDataFrame([(1, "ab cd"), (2, "ab"), (3, "")], "id int, t string").where("id < 3")
    w = {(r.id, r.term): r.weight for r in C.tfidf(d, "id", "t").collect()}
    cd = math.log(3 / 2) + 1
    assert math.isclose(w[1, "cd"], cd / math.hypot(1, cd)) and w[2, "ab"] == 1.0
    shares = {r.term: r.contribution for r in C.token_contributions(C.tfidf(d, "id", "t"), 1, 2, "id").collect()}
    assert math.isclose(sum(shares.values()), w[1, "ab"])


def test_similar_items(spark, vectors):
    got = [(r.movieID, r.similarity, r["rank"]) for r in C.similar(vectors, 1, 10).collect()]
    assert got == [(2, 0.8, 1), (3, 0.0, 2)]
    p = spark.createDataFrame([(1, "Up", 0), (2, "Up", 1), (3, "Down 100%", 2)], "movieID bigint, title string, _row_id int")
    assert [r.movieID for r in C.recommendations("Up", p, vectors, 1).collect()] == [2]
    assert C.recommendations("None", p, vectors) is None
    assert [r.title for r in C.suggestions(p, "0%").collect()] == ["Down 100%"]
    assert {(r.title, r.movieID) for r in C.title_index(p).collect()} == {("Up", 1), ("Down 100%", 3)}


def test_profiles_leave_out_what_was_rated(spark, vectors):
    r = spark.createDataFrame([(7, 1, 5.0), (7, 2, 1.0), (8, 3, 2.0)], "userID bigint, movieID bigint, rating double")
    got = C.profile_recommendations(r, vectors, r).collect()
    assert [(x.userID, x.movieID) for x in got] == [(7, 3)]


def test_precision_masks(spark):
    v = spark.createDataFrame([(i, [math.cos(i / 40), math.sin(i / 40)]) for i in range(40)], "movieID bigint, embedding array<double>")
    r = spark.createDataFrame([(1, i, 5.0, i) for i in range(10)], "userID bigint, movieID bigint, rating double, t bigint")
    train = C.precision_at_k(r, v, r, k=10, order=("t",)).first().precision
    every = C.precision_at_k(r, v, r, k=10, order=("t",), mask="all").first().precision
    assert (train, every) == (0.2, 0.0)
    assert C.catalog_coverage(r, v, r, k=10).first().coverage == 0.25
    with pytest.raises(ValueError):
        C.precision_at_k(r, v, r, mask="none")


def test_diversity(spark, vectors):
    assert math.isclose(C.intra_list_diversity(vectors).first()[0], 1 - (0.8 + 0.0 + 0.6) / 3, abs_tol=1e-6)
    assert C.intra_list_diversity(vectors.limit(1)).first()[0] is None


def test_surrogate_labels(spark, vectors):
    ids = lambda df: {r.movieID for r in df.where("label = 1").collect()}
    assert ids(C.surrogate_labels(vectors, 1, 1)) == {2}
    assert ids(C.surrogate_labels(vectors, 1, 1, with_ties=True)) == {1, 2}


def test_soup(spark):
    items = spark.createDataFrame([(1,), (2,)], "movieID int")
    g = spark.createDataFrame([(1, "Film Noir", 0), (1, "War", 1)], "movieID int, genre string, _row_id int")
    d = spark.createDataFrame([(1, None, 0), (1, "Ann Lee", 1)], "movieID int, directorName string, _row_id int")
    a = spark.createDataFrame([(1, "Bo Y", 2, 0), (1, "Al X", 1, 1), (1, "No", 6, 2)], "movieID int, actorName string, ranking int, _row_id int")
    t = spark.createDataFrame([(1, "old", 3, 0), (1, None, 5, 1)], "movieID int, value string, weight int, _row_id int")
    got = C.content_soup(items, g, d, a, t).collect()
    assert [r.soup for r in got] == ["Film_Noir War Film_Noir War ann_lee al_x bo_y nan old"]


def test_surrogate_forest_is_explained_additively(spark):
    rows = [(i, "good fine" if i % 2 else "bad poor", i % 2) for i in range(40)]
    d = spark.createDataFrame(rows, "movieID bigint, text string, label int")
    s = C.Surrogate(trees=5)
    x = s.assemble(C.tfidf(d, "movieID", "text"), "movieID").join(d.select("movieID", "label"), "movieID")
    s.fit(x)
    got = C.path_contributions(s.model, x).collect()
    p = {r.movieID: float(r.probability[1]) for r in s.model.transform(x).collect()}
    assert all(math.isclose(r.base + sum(r.contributions.values()), p[r.movieID], abs_tol=1e-9) for r in got)
    assert {t for t, v in s.importances(4) if v > 0} <= {"good", "fine", "bad", "poor"}


def test_surrogate_forest_scores_in_a_session_that_observed(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    rows = spark.createDataFrame([(i, "good" if i % 2 else "bad", i % 2) for i in range(40)], "movieID bigint, text string, label int")
    s = C.Surrogate(trees=3)
    x = s.assemble(C.tfidf(rows, "movieID", "text"), "movieID").join(rows.select("movieID", "label"), "movieID")
    assert seen.get == {"n": 3} and all(r.prediction == r.label for r in s.fit(x).model.transform(x).collect())


def test_local_explanation_finds_the_token(spark):
    score = lambda df: df.withColumn("score", F.contains("text", F.lit("war")).cast("double"))
    assert C.local_text_explanation(spark, "a war film of old", score, 60)[0][0] == "war"
    assert C.local_text_explanation(spark, "", score) == []


def test_projection_and_encoder(spark, vectors):
    assert len(C.projection(vectors).first().projection) == 2
    texts = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    got = {r.id: list(r.embedding) for r in C.encode(texts, "id", "t", lambda: lambda ts: [[len(t), 0.0] for t in ts]).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0]}


def test_cached_builds_once(spark, tmp_path):
    calls = []
    build = lambda: (calls.append(1), spark.range(3))[1]
    for _ in range(2):
        assert C.cached(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1
