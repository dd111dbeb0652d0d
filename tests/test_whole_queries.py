from marquee.plans import queries as Q


class Tables:
    """A domain of ten users, twelve items and their ratings."""

    def __init__(self, spark):
        rows = [(u, i, float(1 + (u * i + u) % 5), (u * 12 + i) * 37 % 121, u * 12 + i) for u in range(10) for i in range(12) if (u + i) % 3]
        self.ratings = spark.createDataFrame(rows, "userID int, movieID int, rating double, ts long, _row_id long")
        self.items = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "movieID int, title string")


def test_factor_queries_take_all_users_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(Q, "Domain", lambda s, d: Tables(s))
    train, test = (x.select("userID", "movieID").distinct().collect() for x in Q._split(Tables(spark)))
    assert {r.userID for r in Q.QUERIES["rec_7_svd_recommend"](spark, "").collect()} == {r.userID for r in train}
    for name in ("xp_2_waterfall", "xp_3_top_factors"):
        got = Q.QUERIES[name](spark, "")
        assert {(r.userID, r.movieID) for r in got.collect()} == {(r.userID, r.movieID) for r in test} and len(test) > 5
