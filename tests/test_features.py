import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marquee.operators import features as A


def test_user_features_of_one_rating(spark):
    r = spark.createDataFrame([(1, 1, 4.0, dt.datetime(2009, 1, 5, 10)), (2, 1, 3.0, dt.datetime(2009, 1, 1)), (2, 2, 5.0, dt.datetime(2009, 1, 3, 1))], "userID int, movieID int, rating double, timestamp timestamp")
    tags = spark.createDataFrame([(2, 1, 7), (2, 1, 8), (3, 1, 7)], "userID int, movieID int, tagID int")
    got = {x.userID: x for x in A.user_features(r, tags).collect()}
    assert set(got) == {1, 2}
    assert (got[1].user_rating_std, got[1].user_days_since_last_rating, got[1].user_tag_event_count) == (0.0, -1, 0)
    assert (got[2].user_rating_range, got[2].user_pct_high_ratings, got[2].user_activity_span_days, got[2].user_tagging_intensity) == (2.0, 0.5, 2, 2.0)
    assert math.isclose(got[2].user_rating_std, math.sqrt(2)) and math.isclose(got[2].user_avg_rating_log_count, 4 * math.log(3))


def test_metadata_fills_by_the_median_of_known_pages(spark):
    m = spark.createDataFrame([(1, None, "a", "4.0"), (2, 2000, "b", "\\N"), (3, 2010, None, "9.0"), (4, 1999, "c", "6.0")], "id int, year int, rtID string, score string")
    got = {r.movieID: tuple(r)[1:] for r in A.item_metadata(m, scores={"s": "score"}).collect()}
    assert got == {1: (0, 2009, 1, 4.0), 2: (2000, 9, 1, 5.0), 3: (2010, 0, 0, 9.0), 4: (1999, 10, 1, 6.0)}


def test_genres_ranks_directors_countries(spark):
    g = spark.createDataFrame([(1, "Drama"), (1, None), (1, "IMAX"), (None, "War")], "movieID int, genre string")
    r = A.genre_features(g, extra=True).first()
    assert (r.movie_genre_count, r.genre_Drama, r.genre_War, r.IMAX) == (3, 1, 0, 1)
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "x", 3), (2, None, None)], "movieID int, actorID string, ranking int")
    got = {r.movieID: (r.movie_cast_size, r.movie_top_actor_rank_min, r.movie_top_actor_rank_mean, r.movie_has_rank_conflict) for r in A.actor_features(a).collect()}
    assert got == {1: (2, 1, 1.0, 1), 2: (1, 3, 3.0, 0)}
    d = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (3, None)], "movieID int, directorID string")
    assert {r.movieID: r.movie_director_experience for r in A.director_features(d).collect()} == {1: 2.0, 2: 2.0, 3: None}
    c = spark.createDataFrame([(i, "USA") for i in range(50)] + [(i + 50, "Peru") for i in range(49)] + [(99, None)], "movieID int, country string")
    n = {r[0]: r[1] for r in A.country_features(c).groupBy("movie_country_encoded").count().collect()}
    assert n == {"USA": 50, "Other": 50}


def test_item_features_keep_nulls_of_ratings(spark):
    base = spark.createDataFrame([(1,), (2,)], "movieID int")
    pop = A.item_popularity(spark.createDataFrame([(1, 4.0)], "movieID int, rating double"))
    tags = A.tag_features(spark.createDataFrame([(1, 1, 3), (1, 2, 5)], "movieID int, tagID int, tagWeight int"))
    country = A.country_features(spark.createDataFrame([(1, "x")], "movieID int, country string"), rare=1)
    loc = A.location_features(spark.createDataFrame([(1, "a", None)], "movieID int, l1 string, l2 string"), ["l1", "l2"])
    got = {r.movieID: r for r in A.item_features(base, [pop, tags, country, loc]).collect()}
    assert (got[2].movie_rating_count, got[2].movie_tag_weight_sum, got[2].movie_country_encoded, got[2].movie_location_depth) == (None, 0.0, "Unknown", 0)
    assert (got[1].movie_unique_tag_count, got[1].movie_tag_weight_mean, got[1].movie_country_encoded) == (2, 4.0, "x")


def test_interactions(spark):
    t = dt.datetime(2005, 5, 5)
    r = spark.createDataFrame([(1, 1, 5.0, t, 0), (1, 2, 3.0, t, 1), (2, 9, 4.0, t, 2)], "userID int, movieID int, rating double, timestamp timestamp, _row_id int")
    g = spark.createDataFrame([(1, "Drama"), (2, "IMAX")], "movieID int, genre string")
    users = A.user_rating_features(r)
    items = A.rated_items(spark.createDataFrame([(1, 2004), (2, 1990)], "movieID int, movie_year int"), A.item_popularity(r))
    got = {x._row_id: x for x in A.interaction_features(r, users, items, A.genre_affinity(r, g)).collect()}
    assert [got[i].interaction_user_rating_sequence for i in range(3)] == [1, 2, 1]
    assert (got[0].interaction_rating_vs_user_avg, got[0].interaction_movie_age_at_rating, got[0].interaction_is_early_rater) == (1.0, 1, 1)
    assert (got[2].interaction_movie_age_at_rating, got[2].interaction_is_early_rater) == (None, 0)
    assert (got[0].user_genre_affinity_Drama, got[0].user_genre_affinity_War) == (5.0, 3.5)
    assert got[2].user_genre_affinity_Drama is None


def test_registry(spark):
    assert A.feature_registry(spark).where(F.col("feature_group") == "user").count() == 13
    with pytest.raises(KeyError):
        A.item_popularity(spark.range(1))
