import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.operators import reports as R
from marquee.operators.checks import require_columns


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def values(df):
    return {r.metric: r.value for r in df.collect()}


def test_suspicious_names(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "A"), (4, "42"), (5, "Anna"), (6, "Bo")], "id int, name string")
    r = R.suspicious_text_report(df, "name", short=2)
    assert values(r.counts) == {"missing": 1, "empty": 1, "short": 3, "digits": 1}
    assert rows(r.rows.select("id", "reason"), "id") == [(1, "missing"), (2, "empty"), (3, "short"), (4, "short;digits"), (6, "short")]
    with pytest.raises(KeyError):
        R.suspicious_text_report(df, "other")


def test_repeats_keep_the_first_or_none(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 1, 2), (None, 1, 3), (None, 1, 4)], "u int, i int, _row_id int")
    flags = df.select("_row_id", R.repeated(df, ["u", "i"], ["_row_id"]).alias("later"), R.repeated(df, ["u", "i"]).alias("every"))
    assert rows(flags, "_row_id") == [(0, False, True), (1, True, True), (2, True, True), (3, False, True), (4, True, True)]


def test_null_foreign_keys_are_violations(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "id int")
    assert rows(R.integrity_report([("r", child, "k", parent, "id")]), "relation") == [("r", 2)]


def test_coverage_and_activity_of_nothing(spark):
    empty = spark.createDataFrame([], "userID int, movieID int")
    assert rows(R.coverage_report(empty, "movieID", empty, "movieID"), "pct") == [(0, 0, 0.0)]
    assert values(R.activity_report(empty, "userID", "movieID").summary)["sparsity"] == 1.0


def test_table_quality_counts_missing_cells_and_repeats(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert rows(R.table_quality({"t": df}), "table_name") == [("t", 3, 2, 2, 1)]


def test_overview(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, 4.0, "b")], "user_id int, x double, s string")
    got = {r.column_name: r for r in R.overview(df).collect()}
    assert got["user_id"].type_group == "id-like" and got["user_id"].mean is None
    assert (got["x"].missing, got["x"].missing_pct, got["x"].mean, got["x"].lo) == (1, 33.3333, 3.0, 2.0)
    assert (got["s"].type_group, got["s"].n_unique) == ("non-numeric", 2)


def test_ranking(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (2, 3), (3, None)], "movieID int, ranking int")
    r = R.ranking_report(df, "movieID", "ranking")
    assert values(r.counts) == {"missing": 1, "not_positive": 0, "not_integer": 0, "non_contiguous_items": 1, "repeated_rank_rows": 1}
    assert r.rows.count() == 2


def test_location_report_melts_levels(spark):
    df = spark.createDataFrame([(1, "USA", None), (2, "X", " ")], "movieID int, location1 string, location2 string")
    assert values(R.suspicious_location_report(df, "movieID", ["location1", "location2"]).counts) == {"missing": 1, "empty": 1, "short": 1, "digits": 0}
    depth = R.location_depth_report(df, ["location1", "location2"])
    assert rows(depth.counts, "depth") == [(1, 1), (2, 1)]


def test_times(spark):
    df = spark.createDataFrame([(2009, 2, 30, 0, 0, 0), (2008, 1, 1, 12, 0, 0)], "date_year int, date_month int, date_day int, date_hour int, date_minute int, date_second int")
    r = R.time_report(df)
    assert tuple(r.summary.first()) == (2, 1, "2008-01-01 12:00:00", "2008-01-01 12:00:00")
    with pytest.raises(Exception):
        df.select(S.event_time()).collect()
    day = spark.createDataFrame([(dt.datetime(2009, 1, 5, 10),)], "t timestamp")
    assert day.select(S.elapsed_days(F.col("t"), F.lit(S.END_DATE).cast("timestamp"))).first()[0] == -1


def test_half_stars_and_numbers(spark):
    df = spark.createDataFrame([(2.25, "4.5"), (2.75, "\\N"), (None, "NaN")], "x double, s string")
    assert [tuple(r) for r in df.select(S.half_star(F.col("x")), S.to_number(F.col("s"))).collect()] == [(2.0, 4.5), (3.0, None), (None, None)]


def test_set_coverage_and_usage(spark):
    tags = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, value string")
    x, y = spark.createDataFrame([(1,), (1,), (9,)], "t int"), spark.createDataFrame([(1,), (2,)], "t int")
    r = R.set_coverage(tags, "id", [(x, "t"), (y, "t")])
    assert tuple(r.summary.first()) == (3, 2, 1, 1, 1, 66.667)
    u = R.usage_report(tags, "id", "value", {"x": (x, "t"), "y": (y, "t")})
    assert rows(u.usage, "id") == [(1, 2, 1, 3, "a"), (2, 0, 1, 1, "b"), (9, 1, 0, 1, None)]


def test_histograms(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "x double")
    assert rows(R.histogram(df, "x", [0, 1, 2]), "bin") == [(0, 1), (1, 2)]
    assert rows(R.equal_width_histogram(df, "x", 2), "bin") == [(0, 1), (1, 2)]


def test_require_columns(spark):
    with pytest.raises(ValueError):
        require_columns(spark.range(1), "x", error=ValueError)
