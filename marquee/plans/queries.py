"""Registered queries over the domain views, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions import scalars as S
from marquee.operators import content as C
from marquee.operators import features as A
from marquee.operators import models as M
from marquee.operators import reports as R
from marquee.plans.views import Domain, with_views
from marquee.streaming.popularity import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GENRES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "blue", "red")
LEVELS = ["location1", "location2", "location3", "location4"]
END = "2002-01-01"
PART = {"item": "movieID"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.DecimalType | T.FloatType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Domain(spark, sf_dir)))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return add


# --- Sources, projections, filters ---

query("src_4_scan_projection", "SELECT p_partkey AS movieID, p_name AS title FROM part")(lambda v: v.part.select(F.col("p_partkey").alias("movieID"), F.col("p_name").alias("title")))
query("src_5_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45")(lambda v: v.lineitem.select("l_orderkey", "l_quantity").where("l_quantity >= 45"))
query("src_9_newest_rows", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 300")(lambda v: M.newest(v.events.select("event_id", "ts"), "ts", 300, ("event_id",)))
query("prj_1_rename", "SELECT c_custkey AS userID, c_mktsegment AS segment FROM customer")(lambda v: v.customer.select("c_custkey", "c_mktsegment").withColumnsRenamed({"c_custkey": "userID", "c_mktsegment": "segment"}))
query("prj_2_arithmetic", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice / l_quantity, 6) AS unit, round(l_extendedprice - l_tax, 6) AS diff FROM lineitem")(
    lambda v: v.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.try_divide("l_extendedprice", "l_quantity").alias("unit"), (F.col("l_extendedprice") - F.col("l_tax")).alias("diff"))
)
query("prj_3_clip", "SELECT p_partkey, least(greatest(p_size, 10), 40) AS size FROM part")(lambda v: v.part.select("p_partkey", S.clip(F.col("p_size"), 10, 40).alias("size")))
query("prj_4_null_flag", "SELECT movieID, CASE WHEN rt_id IS NOT NULL THEN 1 ELSE 0 END AS has_rt FROM items")(lambda v: v.items.select("movieID", F.col("rt_id").isNotNull().cast("int").alias("has_rt")))
query("prj_5_constant_fill", "SELECT movieID, coalesce(country, 'Unknown') AS country FROM countries")(lambda v: v.countries.select("movieID", "country").fillna("Unknown"))
query("prj_6_statistic_fill", "SELECT movieID, round(coalesce(try_cast(rt_score AS double), (SELECT median(try_cast(rt_score AS double)) FROM items WHERE rt_id IS NOT NULL)), 6) AS score FROM items")(
    lambda v: A.item_metadata(v.items, "movieID", "year", "rt_id", {"score": "rt_score"}).select("movieID", "score")
)
query("prj_7_conditional_replace", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) < 80 THEN 'Other' ELSE p_brand END AS brand FROM part")(
    lambda v: v.part.join(v.part.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand").select("p_partkey", F.when(F.col("n") < 80, "Other").otherwise(F.col("p_brand")).alias("brand"))
)
query("prj_8_numeric_coercion", "SELECT movieID, try_cast(rt_score AS double) AS score FROM items")(lambda v: v.items.select("movieID", S.to_number(F.col("rt_score")).alias("score")))
query("prj_9_cast", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity AS bigint) AS quantity FROM lineitem")(lambda v: v.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity")))
query("prj_10_round", "SELECT c_custkey, round(c_acctbal, 1) AS balance FROM customer")(lambda v: v.customer.select("c_custkey", F.round("c_acctbal", 1).alias("balance")))
query("flt_1_comparison", "SELECT _row_id, rating FROM ratings WHERE rating >= 4")(lambda v: v.ratings.select("_row_id", "rating").where("rating >= 4"))
query("flt_2_equality", "SELECT movieID, rating, _row_id FROM ratings WHERE userID = 7")(lambda v: v.ratings.where("userID = 7").select("movieID", "rating", "_row_id"))
query("flt_3_disjunction", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_discount > 0.08 OR l_tax < 0.01 OR l_returnflag = 'R'")(
    lambda v: v.lineitem.where(S.any_of([F.col("l_discount") > 0.08, F.col("l_tax") < 0.01, F.col("l_returnflag") == "R"])).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
)
query("flt_4_membership", "SELECT movieID, title FROM items WHERE movieID IN (SELECT movieID FROM tag_events)")(lambda v: v.items.select("movieID", "title").join(v.tag_events, "movieID", "left_semi"))
query("flt_5_dropna", "SELECT movieID, country FROM countries WHERE country IS NOT NULL")(lambda v: v.countries.select("movieID", "country").dropna(subset=["country"]))
query("flt_6_non_empty", "SELECT movieID, picture FROM items WHERE length(picture) > 0")(lambda v: v.items.select("movieID", "picture").where(F.length("picture") > 0))
query("flt_7_suggestions", "SELECT title FROM (SELECT title, min(_row_id) AS k FROM items WHERE lower(title) LIKE '%ring%' GROUP BY title) t ORDER BY k LIMIT 5")(lambda v: C.suggestions(v.items, "RING"))
query("flt_8_prefix_columns", "SELECT movieID, rt_id, rt_score FROM items")(lambda v: v.items.select("movieID", *R.prefixed(v.items, "rt")))
query("flt_9_numeric_columns", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")(lambda v: v.supplier.select(*(f.name for f in v.supplier.schema.fields if isinstance(f.dataType, T.NumericType))))
query("flt_10_half_steps", "SELECT _row_id FROM ratings WHERE (rating * 2) % 2 <> 0")(lambda v: v.ratings.where((F.col("rating") * 2) % 2 != 0).select("_row_id"))

# --- Joins ---

query("join_1_dimensions", """SELECT r._row_id, round(r.rating - u.m, 6) AS dev FROM ratings r LEFT JOIN (SELECT userID, avg(rating) AS m FROM ratings GROUP BY userID) u ON r.userID = u.userID""")(
    lambda v: v.ratings.join(v.ratings.groupBy("userID").agg(F.avg("rating").alias("m")), "userID", "left").select("_row_id", (F.col("rating") - F.col("m")).alias("dev"))
)
query("join_3_left_fill", "SELECT c_custkey AS userID, coalesce(n, 0) AS tags FROM customer LEFT JOIN (SELECT userID, count(*) AS n FROM tag_events GROUP BY userID) t ON t.userID = c_custkey")(
    lambda v: v.customer.select(F.col("c_custkey").alias("userID")).join(v.tag_events.groupBy("userID").agg(F.count("*").alias("tags")), "userID", "left").fillna(0)
)
query("join_4_title_lookup", "SELECT t._row_id, i.title FROM tag_events t LEFT JOIN items i ON t.movieID = i.movieID")(lambda v: v.tag_events.join(v.items.select("movieID", "title"), "movieID", "left").select("_row_id", "title"))
query("join_5_two_keys", "SELECT r._row_id AS r, t._row_id AS t FROM ratings r JOIN tag_events t ON r.userID = t.userID AND r.movieID = t.movieID")(
    lambda v: v.ratings.select("userID", "movieID", F.col("_row_id").alias("r")).join(v.tag_events.select("userID", "movieID", F.col("_row_id").alias("t")), ["userID", "movieID"]).select("r", "t")
)
query("join_6_full_outer", "SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2 FROM (SELECT tagID AS id, count(*) AS n FROM tag_events GROUP BY tagID) a FULL JOIN (SELECT id, 1 AS n FROM tags) b ON a.id = b.id")(
    lambda v: v.tag_events.groupBy(F.col("tagID").alias("id")).agg(F.count("*").alias("n1")).join(v.tags.select("id", F.lit(1).alias("n2")), "id", "full").fillna(0)
)
query("join_7_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM tag_events t WHERE t.userID = c_custkey)")(lambda v: v.customer.select("c_custkey").join(v.tag_events, F.col("c_custkey") == F.col("userID"), "left_semi"))
query("join_8_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.userID = c_custkey)")(lambda v: v.customer.select("c_custkey").join(v.ratings, F.col("c_custkey") == F.col("userID"), "left_anti"))
query("join_10_one_row", "SELECT movieID, round(avg(rating) - (SELECT avg(rating) FROM ratings), 6) AS lift FROM ratings GROUP BY movieID")(
    lambda v: v.ratings.groupBy("movieID").agg(F.avg("rating").alias("m")).crossJoin(F.broadcast(v.ratings.agg(F.avg("rating").alias("g")))).select("movieID", (F.col("m") - F.col("g")).alias("lift"))
)
query("join_11_candidates", "SELECT u.c_custkey AS userID, i.movieID FROM customer u, items i WHERE u.c_custkey IN (3, 5) AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.userID = u.c_custkey AND r.movieID = i.movieID)")(
    lambda v: F.broadcast(v.customer.where(F.col("c_custkey").isin(3, 5)).select(F.col("c_custkey").alias("userID"))).crossJoin(v.items.select("movieID")).join(v.ratings, ["userID", "movieID"], "left_anti")
)
query("join_12_lookup_default", "SELECT t._row_id, coalesce(g.n, -1) AS n FROM tag_events t LEFT JOIN (SELECT movieID, count(*) AS n FROM ratings WHERE rating > 4.5 GROUP BY movieID) g ON t.movieID = g.movieID")(
    lambda v: v.tag_events.join(v.ratings.where("rating > 4.5").groupBy("movieID").agg(F.count("*").alias("n")), "movieID", "left").select("_row_id", F.coalesce("n", F.lit(-1)).alias("n"))
)
query("join_13_set_algebra", "SELECT movieID FROM tag_events INTERSECT SELECT movieID FROM items EXCEPT SELECT movieID FROM items WHERE movieID < 50")(lambda v: v.tag_events.select("movieID").intersect(v.items.select("movieID")).subtract(v.items.where("movieID < 50").select("movieID")))

# --- Features ---

USER_SQL = f"""SELECT userID, count(rating) AS user_rating_count, round(avg(rating), 6) AS user_avg_rating, round(coalesce(stddev_samp(rating), 0), 6) AS user_rating_std,
 min(rating) AS user_min_rating, max(rating) AS user_max_rating, max(rating) - min(rating) AS user_rating_range,
 round(count(*) FILTER (WHERE rating >= 4) / count(rating), 6) AS user_pct_high_ratings,
 cast(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS bigint) AS user_activity_span_days,
 cast(floor((epoch(timestamp '{END}') - epoch(max(ts))) / 86400) AS bigint) AS user_days_since_last_rating,
 round(avg(rating) * ln(1 + count(rating)), 6) AS user_avg_rating_log_count FROM ratings GROUP BY userID"""
TAG_SQL = """SELECT userID, count(tagID) AS user_tag_event_count, count(DISTINCT movieID) AS user_unique_movies_tagged, count(DISTINCT tagID) AS user_unique_tags_used, round(count(tagID) / count(DISTINCT movieID), 6) AS user_tagging_intensity FROM tag_events GROUP BY userID"""
query("agg_1_user_rating_features", USER_SQL)(lambda v: A.user_rating_features(v.ratings, ts="ts", end=END))
query("agg_2_user_tag_features", TAG_SQL)(lambda v: A.user_tag_features(v.tag_events))
query("agg_3_user_features", f"""WITH a AS ({USER_SQL}), b AS ({TAG_SQL}) SELECT a.*, coalesce(b.user_tag_event_count, 0) AS user_tag_event_count, coalesce(b.user_unique_movies_tagged, 0) AS user_unique_movies_tagged, coalesce(b.user_unique_tags_used, 0) AS user_unique_tags_used, coalesce(b.user_tagging_intensity, 0) AS user_tagging_intensity FROM a LEFT JOIN b ON a.userID = b.userID""")(
    lambda v: A.user_features(v.ratings, v.tag_events, ts="ts", end=END)
)
POP_SQL = """SELECT movieID, count(rating) AS movie_rating_count, round(avg(rating), 6) AS movie_avg_rating, round(coalesce(stddev_samp(rating), 0), 6) AS movie_rating_std, round(ln(1 + count(rating)), 6) AS movie_log_rating_count, round(count(*) FILTER (WHERE rating >= 4) / count(rating), 6) AS movie_pct_high_ratings FROM ratings GROUP BY movieID"""
META_SQL = """SELECT movieID, year AS movie_year, greatest(1998 - year, 0) AS movie_age, CASE WHEN rt_id IS NULL THEN 0 ELSE 1 END AS movie_has_rt_data, round(coalesce(try_cast(rt_score AS double), (SELECT median(try_cast(rt_score AS double)) FROM items WHERE rt_id IS NOT NULL)), 6) AS movie_rt_score FROM items"""
GENRE_SQL = "SELECT movieID, count(*) AS movie_genre_count, " + ", ".join(f"max(CASE WHEN genre = '{g}' THEN 1 ELSE 0 END) AS \"genre_{g}\"" for g in GENRES) + " FROM genres GROUP BY movieID"
ACTOR_SQL = """SELECT a.movieID, count(actorID) AS movie_cast_size, min(ranking) AS movie_top_actor_rank_min, round(avg(ranking), 6) AS movie_top_actor_rank_mean, max(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS movie_has_rank_conflict, least(count(actorID), 50) AS movie_cast_size_capped FROM (SELECT *, count(*) OVER (PARTITION BY movieID, ranking) AS n FROM actors) a GROUP BY a.movieID"""
DIRECTOR_SQL = "SELECT movieID, cast(max(n) AS double) AS movie_director_experience, 1 AS movie_has_director FROM (SELECT movieID, count(*) OVER (PARTITION BY directorID) AS n FROM directors) d GROUP BY movieID"
COUNTRY_SQL = "SELECT movieID, CASE WHEN count(*) OVER (PARTITION BY coalesce(country, 'Unknown')) < 50 THEN 'Other' ELSE coalesce(country, 'Unknown') END AS movie_country_encoded FROM countries"
TAGF_SQL = "SELECT movieID, count(tagID) AS movie_unique_tag_count, cast(sum(tagWeight) AS double) AS movie_tag_weight_sum, round(avg(tagWeight), 6) AS movie_tag_weight_mean, round(ln(1 + sum(tagWeight)), 6) AS movie_log_tag_weight_sum FROM item_tags GROUP BY movieID"
LOC_DEPTH = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in LEVELS)
LOC_SQL = f"SELECT movieID, max({LOC_DEPTH}) AS movie_location_depth FROM locations GROUP BY movieID"


def _blocks(v: Domain) -> list[DataFrame]:
    return [A.item_popularity(v.ratings), A.genre_features(v.genres, GENRES), A.actor_features(v.actors), A.director_features(v.directors), A.country_features(v.countries), A.tag_features(v.item_tags), A.location_features(v.locations, LEVELS)]


def _metadata(v: Domain) -> DataFrame:
    return A.item_metadata(v.items, "movieID", "year", "rt_id", {"movie_rt_score": "rt_score"}, now=1998)


query("agg_4_movie_popularity_features", POP_SQL)(lambda v: A.item_popularity(v.ratings))
query("agg_5_movie_metadata_features", META_SQL)(_metadata)
query("agg_6_movie_genre_features", GENRE_SQL)(lambda v: A.genre_features(v.genres, GENRES))
query("agg_7_movie_actor_features", ACTOR_SQL)(lambda v: A.actor_features(v.actors))
query("agg_8_movie_director_features", DIRECTOR_SQL)(lambda v: A.director_features(v.directors))
query("agg_9_movie_country_features", COUNTRY_SQL)(lambda v: A.country_features(v.countries))
query("agg_10_movie_tag_features", TAGF_SQL)(lambda v: A.tag_features(v.item_tags))
query("agg_11_movie_location_features", LOC_SQL)(lambda v: A.location_features(v.locations, LEVELS))
MOVIE_SQL = f"""WITH m AS ({META_SQL}), p AS ({POP_SQL}), g AS ({GENRE_SQL}), a AS ({ACTOR_SQL}), d AS ({DIRECTOR_SQL}), c AS ({COUNTRY_SQL}), t AS ({TAGF_SQL}), l AS ({LOC_SQL})
SELECT m.*, p.* EXCLUDE (movieID), g.* EXCLUDE (movieID), a.* EXCLUDE (movieID), coalesce(movie_director_experience, 0) AS movie_director_experience, coalesce(movie_has_director, 0) AS movie_has_director, coalesce(movie_country_encoded, 'Unknown') AS movie_country_encoded,
 coalesce(movie_unique_tag_count, 0) AS movie_unique_tag_count, coalesce(movie_tag_weight_sum, 0) AS movie_tag_weight_sum, coalesce(movie_tag_weight_mean, 0) AS movie_tag_weight_mean, coalesce(movie_log_tag_weight_sum, 0) AS movie_log_tag_weight_sum, coalesce(movie_location_depth, 0) AS movie_location_depth
FROM m LEFT JOIN p USING (movieID) LEFT JOIN g USING (movieID) LEFT JOIN a USING (movieID) LEFT JOIN d USING (movieID) LEFT JOIN c USING (movieID) LEFT JOIN t USING (movieID) LEFT JOIN l USING (movieID)"""
query("agg_12_movie_features", MOVIE_SQL)(lambda v: A.item_features(_metadata(v), _blocks(v)))
query("join_2_block_chain", "SELECT i.movieID, n1, n2, n3 FROM items i LEFT JOIN (SELECT movieID, count(*) AS n1 FROM genres GROUP BY movieID) a USING (movieID) LEFT JOIN (SELECT movieID, count(*) AS n2 FROM actors GROUP BY movieID) b USING (movieID) LEFT JOIN (SELECT movieID, count(*) AS n3 FROM locations GROUP BY movieID) c USING (movieID)")(
    lambda v: A.item_features(v.items.select("movieID"), [t.groupBy("movieID").agg(F.count("*").alias(n)) for t, n in ((v.genres, "n1"), (v.actors, "n2"), (v.locations, "n3"))])
)
query("join_9_group_back", "SELECT movieID, directorID, count(*) OVER (PARTITION BY directorID) AS films FROM directors")(lambda v: v.directors.join(v.directors.groupBy("directorID").agg(F.count("*").alias("films")), "directorID").select("movieID", "directorID", "films"))
AFF_SQL = "SELECT userID, " + ", ".join(f"round(coalesce(avg(CASE WHEN genre = '{g}' THEN rating END), 3.5), 6) AS \"user_genre_affinity_{g}\"" for g in GENRES) + " FROM ratings JOIN (SELECT DISTINCT movieID, genre FROM genres) g USING (movieID) WHERE genre IN (" + ", ".join(f"'{g}'" for g in GENRES) + ") GROUP BY userID"
query("agg_13_genre_affinity", AFF_SQL)(lambda v: A.genre_affinity(v.ratings, v.genres, GENRES))
INTER_SQL = f"""WITH u AS (SELECT userID, avg(rating) AS um FROM ratings GROUP BY userID), m AS (SELECT movieID, avg(rating) AS mm FROM ratings GROUP BY movieID), f AS ({AFF_SQL})
SELECT r.userID, r.movieID, r.ts, r._row_id, rating AS interaction_rating, round(rating - um, 6) AS interaction_rating_vs_user_avg, round(rating - mm, 6) AS interaction_rating_vs_movie_avg,
 greatest(year(r.ts) - i.year, 0) AS interaction_movie_age_at_rating, CASE WHEN greatest(year(r.ts) - i.year, 0) <= 1 THEN 1 ELSE 0 END AS interaction_is_early_rater,
 row_number() OVER (PARTITION BY r.userID ORDER BY r.ts, r._row_id) AS interaction_user_rating_sequence, f.* EXCLUDE (userID)
FROM ratings r LEFT JOIN u ON r.userID = u.userID LEFT JOIN m ON r.movieID = m.movieID LEFT JOIN items i ON r.movieID = i.movieID LEFT JOIN f ON r.userID = f.userID"""


def _interactions(v: Domain) -> DataFrame:
    users = A.user_rating_features(v.ratings, ts="ts", end=END)
    items = A.rated_items(v.items.select("movieID", F.col("year").alias("movie_year")), A.item_popularity(v.ratings))
    return A.interaction_features(v.ratings, users, items, A.genre_affinity(v.ratings, v.genres, GENRES), ts="ts")


query("agg_14_interaction_features", INTER_SQL)(_interactions)
query("agg_15_all_features", "SELECT 'users' AS output, count(DISTINCT userID) AS n FROM ratings UNION ALL SELECT 'items', count(*) FROM items UNION ALL SELECT 'interactions', count(*) FROM ratings")(
    lambda v: A.user_features(v.ratings, v.tag_events, ts="ts").agg(F.lit("users").alias("output"), F.count("*").alias("n")).union(A.item_features(_metadata(v), _blocks(v)).agg(F.lit("items"), F.count("*"))).union(_interactions(v).agg(F.lit("interactions"), F.count("*")))
)
query("agg_16_feature_registry", "SELECT * FROM (VALUES ('user', 13), ('movie', 12), ('interaction', 4)) t(feature_group, n)")(lambda v: A.feature_registry(v._spark).groupBy("feature_group").agg(F.count("*").alias("n")))
query("agg_17_conditional_count", "SELECT movieID, count(*) FILTER (WHERE rating >= 4) AS high FROM ratings GROUP BY movieID")(lambda v: v.ratings.groupBy("movieID").agg(F.count_if(F.col("rating") >= 4).alias("high")))
query("agg_18_global_mean", "SELECT round(avg(rating), 6) AS mean, count(*) AS n FROM ratings")(lambda v: v.ratings.agg(F.avg("rating").alias("mean"), F.count("*").alias("n")))
query("agg_19_mean_lookup", "SELECT movieID, round(avg(rating), 6) AS mean FROM ratings GROUP BY movieID")(lambda v: v.ratings.groupBy("movieID").agg(F.avg("rating").alias("mean")))
query("agg_20_first_value", "SELECT movieID, arg_min(genre, _row_id) AS genre FROM genres GROUP BY movieID")(lambda v: C.first_of_each(v.genres, "movieID", "genre", "_row_id"))
query("agg_21_ordered_text", "SELECT movieID, string_agg(genre, ' ' ORDER BY _row_id) AS genres FROM genres GROUP BY movieID")(lambda v: C.joined_texts(v.genres, "movieID", "genre", ["_row_id"], "genres"))
query("agg_22_mean_vector", "WITH m AS (SELECT label, i, avg(e) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::double[]) AS e FROM embeddings) GROUP BY label, i), l AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY label) SELECT m.label, i - 1 AS at, round(m / greatest(l, 1e-9), 6) AS v FROM m JOIN l ON m.label = l.label")(
    lambda v: C.mean_vectors(v.embeddings, "label").select("label", F.posexplode("profile").alias("at", "v"))
)
query("agg_23_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem")(lambda v: v.lineitem.agg(F.corr("l_quantity", "l_extendedprice").alias("quantity_price"), F.corr("l_discount", "l_tax").alias("discount_tax")))

# --- Data quality ---


def dist_sql(rows: str, low: bool = False, c: str = "n") -> str:
    """Summary of column c of a subquery, as the reports give it."""
    return f"SELECT count({c}) AS n, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.9), 6) AS p90, round(quantile_cont({c}, 0.95), 6) AS p95, round(quantile_cont({c}, 0.99), 6) AS p99, cast(max({c}) AS double) AS max" + (f", cast(min({c}) AS double) AS min" if low else "") + f" FROM ({rows}) q"


def text_sql(table: str, c: str, short: int) -> str:
    t = f"trim({c})"
    masks = {"missing": f"{c} IS NULL", "empty": f"{t} = ''", "short": f"length({t}) BETWEEN 1 AND {short}", "digits": f"regexp_matches({t}, '^[0-9]+$')"}
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, cast(count(*) FILTER (WHERE {m}) AS double) AS value FROM {table}" for n, m in masks.items())


def cover_sql(table: str, key: str, catalogue: str = "items", ckey: str = "movieID") -> str:
    return f"SELECT count(DISTINCT {key}) AS covered, (SELECT count(DISTINCT {ckey}) FROM {catalogue}) AS catalogue, round(100.0 * count(DISTINCT {key}) / (SELECT count(DISTINCT {ckey}) FROM {catalogue}), 3) AS pct FROM {table}"


def row_cover_sql(table: str, keys: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS key, count(DISTINCT {k}) AS distinct_values, count(*) AS rows, round(100.0 * count(*) FILTER (WHERE {k} IN (SELECT {ok} FROM {o})) / count(*), 3) AS pct FROM {table}" for k, o, ok in keys)


def time_sql(table: str) -> str:
    return f"SELECT count(*) AS n, count(*) FILTER (WHERE ts IS NULL) AS invalid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM {table}"


for _name, _table, _key, _other, _label in (
    ("act_2_actors_per_movie", "actors", "movieID", "actorID", None), ("act_3_movies_per_actor", "actors", "actorID", "movieID", "actorName"),
    ("cty_2_countries_per_movie", "countries", "movieID", "country", None), ("cty_3_movies_per_country", "countries", "country", "movieID", None),
    ("dir_2_directors_per_movie", "directors", "movieID", "directorID", None), ("dir_3_movies_per_director", "directors", "directorID", "movieID", "directorName"),
    ("gen_2_genres_per_movie", "genres", "movieID", "genre", None), ("gen_3_movies_per_genre", "genres", "genre", "movieID", None),
    ("loc_2_rows_per_movie", "locations", "movieID", None, None), ("mtg_4_tags_per_movie", "item_tags", "movieID", None, None), ("mtg_5_movies_per_tag", "item_tags", "tagID", None, None),
):
    _rows = f"SELECT {_key}, count(DISTINCT {_other}) AS n FROM {_table} WHERE {_key} IS NOT NULL AND {_other} IS NOT NULL GROUP BY {_key}" if _other else f"SELECT {_key}, count(*) AS n FROM {_table} WHERE {_key} IS NOT NULL GROUP BY {_key}"
    _args = (_key, *([_other] if _other else []))
    query(f"{_name}_report", dist_sql(_rows))(lambda v, t=_table, a=_args: R.distribution_report(getattr(v, t), *a).summary)
    query(f"{_name}_sizes", _rows)(lambda v, t=_table, a=_args: R.distribution_report(getattr(v, t), *a).distribution)
    if _label:
        query(f"{_name}_top", f"WITH s AS ({_rows}) SELECT s.{_key}, s.n, (SELECT min({_label}) FROM {_table} t WHERE t.{_key} = s.{_key}) AS {_label} FROM s ORDER BY n DESC, {_key} LIMIT 20")(lambda v, t=_table, a=_args, b=_label: R.distribution_report(getattr(v, t), *a, labels=(getattr(v, t), b)).top)
for _name, _table, _col, _short in (("act_1_suspicious_actors", "actors", "actorName", 2), ("cty_1_suspicious_countries", "countries", "country", 1), ("dir_1_suspicious_directors", "directors", "directorName", 2), ("gen_1_suspicious_genres", "genres", "genre", 1), ("tag_1_suspicious_tags", "tags", "value", 1)):
    query(_name, text_sql(_table, _col, _short))(lambda v, t=_table, c=_col, s=_short: R.suspicious_text_report(getattr(v, t), c, s).counts)
query("loc_1_suspicious_locations", "WITH melted AS (" + " UNION ALL ".join(f"SELECT movieID, {c} AS location FROM locations" for c in LEVELS) + ") " + text_sql("melted", "location", 1))(lambda v: R.suspicious_location_report(v.locations, "movieID", LEVELS).counts)
query("loc_1_suspicious_rows", "WITH melted AS (" + " UNION ALL ".join(f"SELECT movieID, '{c}' AS level, {c} AS location FROM locations" for c in LEVELS) + ") SELECT *, CASE WHEN location IS NULL THEN 'missing' ELSE 'short' END AS reason FROM melted WHERE location IS NULL OR length(trim(location)) = 1")(lambda v: R.suspicious_location_report(v.locations, "movieID", LEVELS).rows)
for _name, _table in (("cty_4_country_coverage", "countries"), ("dir_4_director_coverage", "directors"), ("gen_4_genre_coverage", "genres"), ("loc_4_location_coverage", "locations")):
    query(_name, cover_sql(_table, "movieID"))(lambda v, t=_table: R.coverage_report(getattr(v, t), "movieID", v.items, "movieID"))
query("act_4_ranking_report", """WITH r AS (SELECT movieID, min(ranking) AS lo, max(ranking) AS hi, count(DISTINCT ranking) AS k, count(*) - count(DISTINCT ranking) AS again FROM actors GROUP BY movieID)
SELECT 'missing' AS metric, cast(count(*) FILTER (WHERE ranking IS NULL) AS double) AS value FROM actors UNION ALL SELECT 'not_positive', count(*) FILTER (WHERE ranking <= 0) FROM actors UNION ALL SELECT 'not_integer', 0 UNION ALL SELECT 'non_contiguous_items', count(*) FILTER (WHERE lo <> 1 OR hi - lo + 1 <> k) FROM r UNION ALL SELECT 'repeated_rank_rows', sum(again) FROM r""")(lambda v: R.ranking_report(v.actors, "movieID", "ranking").counts)
query("act_4_ranking_repeats", "SELECT movieID, actorID, ranking FROM (SELECT *, count(*) OVER (PARTITION BY movieID, ranking) AS n FROM actors) a WHERE n > 1")(lambda v: R.ranking_report(v.actors, "movieID", "ranking").rows.select("movieID", "actorID", "ranking"))
query("act_4_ranking_distribution", dist_sql("SELECT ranking FROM actors", True, "ranking"))(lambda v: R.ranking_report(v.actors, "movieID", "ranking").distribution)
query("loc_3_location_depth", dist_sql(f"SELECT {LOC_DEPTH} AS d FROM locations WHERE {LOC_DEPTH} > 0", True, "d"))(lambda v: R.location_depth_report(v.locations, LEVELS).summary)
query("loc_3_location_depth_counts", f"SELECT {LOC_DEPTH} AS depth, count(*) AS n FROM locations WHERE {LOC_DEPTH} > 0 GROUP BY 1")(lambda v: R.location_depth_report(v.locations, LEVELS).counts)
query("mtg_1_suspicious_weights", "SELECT 'missing' AS metric, cast(count(*) FILTER (WHERE tagWeight IS NULL) AS double) AS value FROM item_tags UNION ALL SELECT 'not_positive', count(*) FILTER (WHERE tagWeight <= 0) FROM item_tags UNION ALL SELECT 'not_integer', 0 UNION ALL SELECT 'repeated', count(*) - count(DISTINCT (movieID, tagID)) FROM item_tags")(
    lambda v: R.suspicious_report(R.with_repeats(v.item_tags, ["movieID", "tagID"], ["tagWeight"]), R.weight_masks("tagWeight") | {"repeated": F.col("repeated")}).counts
)
query("mtg_2_tag_coverage", row_cover_sql("item_tags", [("movieID", "items", "movieID"), ("tagID", "tags", "id")]))(lambda v: R.row_coverage(v.item_tags, {"movieID": (v.items, "movieID"), "tagID": (v.tags, "id")}))
query("mtg_3_tag_weights", dist_sql("SELECT tagWeight FROM item_tags", True, "tagWeight"))(lambda v: R.value_report(v.item_tags, "tagWeight").summary)
query("mov_1_missingness", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct FROM items" for c in ("movieID", "title", "year", "rt_id", "rt_score", "picture")))(lambda v: R.missingness(v.items.drop("_row_id")))
query("mov_2_identifiers", "SELECT 'n_rows' AS metric, cast(count(*) AS double) AS value FROM items UNION ALL SELECT 'duplicate_rows', 0 UNION ALL SELECT 'duplicate_ids', count(*) - count(DISTINCT movieID) FROM items UNION ALL SELECT 'duplicate_title_year', count(*) - count(DISTINCT (title, year)) FROM items UNION ALL SELECT 'unique_ids', count(DISTINCT movieID) FROM items")(lambda v: R.identifier_report(v.items, "movieID", "title", "year"))
query("mov_3_years", "WITH s AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE year IS NULL) AS missing, min(year) AS min, quantile_cont(year, 0.5) AS median, quantile_cont(year, 0.9) AS p90, quantile_cont(year, 0.99) AS p99, max(year) AS max, count(*) FILTER (WHERE year <= 1800) AS too_early, count(*) FILTER (WHERE year > 2026) AS too_late FROM items) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(cast({m} AS double), 6) AS value FROM s" for m in ("n_rows", "missing", "min", "median", "p90", "p99", "max", "too_early", "too_late")))(lambda v: R.year_report(v.items, "year").summary)
query("mov_3_by_year", "SELECT year, count(*) AS n FROM items GROUP BY year")(lambda v: R.year_report(v.items, "year").by_year)
query("mov_4_text_quality", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) FILTER (WHERE trim({c}) = '') AS empty, count(*) FILTER (WHERE length(trim({c})) = 1) AS short FROM items" for c in ("title", "picture")))(lambda v: R.text_quality(v.items, ["title", "picture"]))
query("mov_5_score_coverage", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct FROM items" for c in ("rt_id", "rt_score")))(lambda v: R.missingness(v.items, R.prefixed(v.items, "rt")))
query("tag_2_tags_coverage", "WITH u AS (SELECT tagID AS id FROM tag_events UNION SELECT tagID FROM item_tags) SELECT (SELECT count(DISTINCT id) FROM tags) AS catalogue, (SELECT count(*) FROM u WHERE id IN (SELECT id FROM tags)) AS used, (SELECT count(DISTINCT tagID) FROM tag_events) AS used_everywhere, (SELECT count(*) FROM tags WHERE id NOT IN (SELECT id FROM u)) AS unused, (SELECT count(*) FROM u WHERE id NOT IN (SELECT id FROM tags)) AS unknown, round(100.0 * (SELECT count(*) FROM u WHERE id IN (SELECT id FROM tags)) / (SELECT count(DISTINCT id) FROM tags), 3) AS pct")(
    lambda v: R.set_coverage(v.tags, "id", [(v.tag_events, "tagID"), (v.item_tags, "tagID")]).summary
)
query("tag_3_tag_usage", "SELECT a.id, a.events, b.items, a.events + b.items AS total, t.value AS label FROM (SELECT tagID AS id, count(*) AS events FROM tag_events GROUP BY tagID) a JOIN (SELECT tagID AS id, count(*) AS items FROM item_tags GROUP BY tagID) b ON a.id = b.id LEFT JOIN tags t ON t.id = a.id")(
    lambda v: R.usage_report(v.tags, "id", "value", {"events": (v.tag_events, "tagID"), "items": (v.item_tags, "tagID")}).usage
)
query("rat_1_suspicious_ratings", "SELECT 'missing' AS metric, cast(count(*) FILTER (WHERE rating IS NULL) AS double) AS value FROM ratings UNION ALL SELECT 'below', count(*) FILTER (WHERE rating < 0.5) FROM ratings UNION ALL SELECT 'above', count(*) FILTER (WHERE rating > 5) FROM ratings UNION ALL SELECT 'not_half_step', count(*) FILTER (WHERE (rating * 2) % 1 <> 0) FROM ratings UNION ALL SELECT 'repeated', count(*) - count(DISTINCT (userID, movieID)) FROM ratings")(
    lambda v: R.suspicious_report(R.with_repeats(v.ratings, ["userID", "movieID"], ["_row_id"]), R.rating_masks() | {"repeated": F.col("repeated")}).counts
)
query("rat_1_suspicious_rows", "SELECT _row_id, 'repeated' AS reason FROM (SELECT _row_id, row_number() OVER (PARTITION BY userID, movieID ORDER BY _row_id) AS k FROM ratings) r WHERE k > 1")(lambda v: R.suspicious_report(R.with_repeats(v.ratings, ["userID", "movieID"], ["_row_id"]), R.rating_masks() | {"repeated": F.col("repeated")}).rows.select("_row_id", "reason"))
query("rat_2_rating_distribution", dist_sql("SELECT rating FROM ratings", True, "rating"))(lambda v: R.value_report(v.ratings, "rating").summary)
query("rat_2_rating_counts", "SELECT rating, count(*) AS n FROM ratings GROUP BY rating")(lambda v: R.value_report(v.ratings, "rating").counts)
query("rat_3_ratings_time", time_sql("ratings"))(lambda v: R.time_report(v.ratings, F.col("ts")).summary)
query("rat_3_ratings_by_year", "SELECT year(ts) AS year, count(*) AS n FROM ratings GROUP BY 1")(lambda v: R.time_report(v.ratings, F.col("ts")).by_year)
ACT_SQL = "WITH s AS (SELECT count(DISTINCT userID) AS users, count(DISTINCT movieID) AS items, count(*) AS interactions FROM {t}), d AS (SELECT *, round(interactions / (users * items), 6) AS density, round(1 - interactions / (users * items), 6) AS sparsity FROM s) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, cast({m} AS double) AS value FROM d" for m in ("users", "items", "interactions", "density", "sparsity"))
query("rat_4_ratings_activity", ACT_SQL.format(t="ratings"))(lambda v: R.activity_report(v.ratings, "userID", "movieID").summary)
query("rat_4_ratings_per_user", dist_sql("SELECT userID, count(*) AS n FROM ratings GROUP BY userID", True))(lambda v: R.activity_report(v.ratings, "userID", "movieID").per_user)
query("rat_4_ratings_per_item", dist_sql("SELECT movieID, count(*) AS n FROM ratings GROUP BY movieID", True))(lambda v: R.activity_report(v.ratings, "userID", "movieID").per_item)
query("rat_5_ratings_coverage", row_cover_sql("ratings", [("movieID", "items", "movieID")]))(lambda v: R.row_coverage(v.ratings, {"movieID": (v.items, "movieID")}))
query("utg_1_suspicious_events", "SELECT 'repeated' AS metric, cast(count(*) - count(DISTINCT (userID, movieID, tagID)) AS double) AS value FROM tag_events UNION ALL SELECT 'invalid_time', count(*) FILTER (WHERE ts IS NULL) FROM tag_events")(
    lambda v: R.suspicious_report(R.with_repeats(v.tag_events, ["userID", "movieID", "tagID"], ["_row_id"]), {"repeated": F.col("repeated"), "invalid_time": F.col("ts").isNull()}).counts
)
query("utg_2_tagged_coverage", row_cover_sql("tag_events", [("movieID", "items", "movieID"), ("tagID", "tags", "id")]))(lambda v: R.row_coverage(v.tag_events, {"movieID": (v.items, "movieID"), "tagID": (v.tags, "id")}))
query("utg_3_tagged_time", time_sql("tag_events"))(lambda v: R.time_report(v.tag_events, F.col("ts")).summary)
for _key in ("userID", "movieID", "tagID"):
    query(f"utg_4_events_per_{_key.lower()}", dist_sql(f"SELECT {_key}, count(*) AS n FROM tag_events GROUP BY {_key}", True))(lambda v, k=_key: R.summary(R.group_sizes(v.tag_events, k), "n"))
query("dq_1_table_quality", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {n} AS n_columns, {m} AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}) q) AS duplicate_rows FROM {t}" for t, n, m in (("countries", 3, "count(*) FILTER (WHERE country IS NULL)"), ("genres", 3, "0"), ("tag_events", 5, "0"))))(lambda v: R.table_quality({"countries": v.countries, "genres": v.genres, "tag_events": v.tag_events}))
FKS = (("actors", "movieID", "items", "movieID"), ("countries", "movieID", "items", "movieID"), ("directors", "movieID", "items", "movieID"), ("ratings", "movieID", "items", "movieID"), ("genres", "movieID", "items", "movieID"), ("locations", "movieID", "items", "movieID"), ("tag_events", "movieID", "items", "movieID"), ("tag_events", "tagID", "tags", "id"), ("item_tags", "movieID", "items", "movieID"), ("item_tags", "tagID", "tags", "id"), ("countries", "country", "nation", "n_name"))
query("dq_2_integrity", " UNION ALL ".join(f"SELECT '{c}.{k}' AS relation, count(*) AS violations FROM {c} x WHERE NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{pk} = x.{k})" for c, k, p, pk in FKS))(lambda v: R.integrity_report([(f"{c}.{k}", getattr(v, c), k, getattr(v, p), pk) for c, k, p, pk in FKS]))
OV = (("c_custkey", "bigint", "id-like"), ("c_name", "string", "non-numeric"), ("c_nationkey", "int", "numeric"), ("c_acctbal", "double", "numeric"), ("c_mktsegment", "string", "non-numeric"))
query("dq_3_overview", " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS dtype, '{g}' AS type_group, count(*) - count({c}) AS missing, 0.0::double AS missing_pct, count(DISTINCT {c}) AS n_unique, " + (f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, cast(min({c}) AS double) AS lo, cast(max({c}) AS double) AS hi" if g == "numeric" else "NULL AS mean, NULL AS std, NULL AS lo, NULL AS hi") + " FROM customer" for c, t, g in OV))(lambda v: R.overview(v.customer, {"c_custkey"}))
query("hst_1_histogram", "SELECT CASE WHEN c_acctbal = 10000 THEN 3 WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 2500 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000 GROUP BY 1")(lambda v: R.histogram(v.customer, "c_acctbal", [-1000, 0, 2500, 5000, 10000]))
query("hst_1_equal_width", "WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT cast(least(floor((p_size - lo) * 10.0 / (hi - lo)), 9) AS int) AS bin, count(*) AS n FROM part, b GROUP BY 1")(lambda v: R.equal_width_histogram(v.part, "p_size", 10))
query("hst_2_ends", "WITH y AS (SELECT year, count(*) AS n FROM items GROUP BY year) SELECT * FROM (SELECT * FROM y ORDER BY year LIMIT 3) a UNION ALL SELECT * FROM (SELECT * FROM y ORDER BY year DESC LIMIT 3) b")(lambda v: R.ends(v.items.groupBy("year").agg(F.count("*").alias("n")), "year", 3))

# --- Windows, top-k, samples, sets ---

query("win_1_rating_sequence", "SELECT _row_id, row_number() OVER (PARTITION BY userID ORDER BY ts, _row_id) AS seq FROM ratings")(lambda v: A.rating_sequence(v.ratings, ts="ts", name="seq").select("_row_id", "seq"))
query("win_2_top_tags", "SELECT * FROM (SELECT movieID, tagID, tagWeight, row_number() OVER (PARTITION BY movieID ORDER BY tagWeight DESC, tagID) AS rank FROM item_tags) t WHERE rank <= 3")(lambda v: C.top_of_each(v.item_tags, "movieID", "tagWeight", 3, ["tagID"]))
query("win_3_duplicates", "SELECT _row_id, row_number() OVER (PARTITION BY userID, movieID ORDER BY _row_id) > 1 AS later, count(*) OVER (PARTITION BY userID, movieID) > 1 AS every FROM ratings")(lambda v: v.ratings.select("_row_id", R.repeated(v.ratings, ["userID", "movieID"], ["_row_id"]).alias("later"), R.repeated(v.ratings, ["userID", "movieID"]).alias("every")))
query("win_4_group_size", "SELECT _row_id, count(*) OVER (PARTITION BY movieID) AS n FROM ratings")(lambda v: v.ratings.select("_row_id", F.count("*").over(Window.partitionBy("movieID")).alias("n")))
SPLIT_SQL = "WITH s AS (SELECT _row_id, ts, row_number() OVER (ORDER BY ts, _row_id) AS k, count(*) OVER () AS n FROM ratings) SELECT _row_id, ts FROM s WHERE k {op} floor(n * 0.8)"
query("win_5_temporal_split_train", SPLIT_SQL.format(op="<="))(lambda v: M.temporal_split(v.ratings.select("_row_id", "ts"), ["ts", "_row_id"])[0])
query("spl_2_temporal_split_test", SPLIT_SQL.format(op=">"))(lambda v: M.temporal_split(v.ratings.select("_row_id", "ts"), ["ts", "_row_id"])[1])
query("win_6_last_of_each", "SELECT _row_id, k > n - greatest(1, floor(n * 0.2)) AS held_out FROM (SELECT _row_id, row_number() OVER (PARTITION BY userID ORDER BY ts, _row_id) AS k, count(*) OVER (PARTITION BY userID) AS n FROM ratings WHERE rating >= 4) r WHERE n >= 5")(lambda v: M.last_of_each(v.ratings.where("rating >= 4"), "userID", ["ts", "_row_id"]).select("_row_id", "held_out"))
query("win_7_recommendation_rank", "SELECT movieID, row_number() OVER (ORDER BY avg(rating) DESC, movieID) AS rank FROM ratings GROUP BY movieID ORDER BY 2 LIMIT 10")(lambda v: C.top_of_each(v.ratings.groupBy("movieID").agg(F.avg("rating").alias("m")).orderBy(F.col("m").desc(), "movieID").limit(10).withColumn("all", F.lit(1)), "all", "m", 10, ["movieID"]).select("movieID", "rank"))
query("top_1_order_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda v: v.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10))
query("top_2_top_counts", "SELECT movieID, count(*) AS n FROM ratings GROUP BY movieID ORDER BY n DESC, movieID LIMIT 20")(lambda v: R.distribution_report(v.ratings, "movieID").top)
query("top_3_top_per_user", "SELECT * FROM (SELECT userID, movieID, rating, _row_id, row_number() OVER (PARTITION BY userID ORDER BY rating DESC, movieID, _row_id) AS rank FROM ratings) r WHERE rank <= 2")(lambda v: C.top_of_each(v.ratings.drop("ts"), "userID", "rating", 2, ["movieID", "_row_id"]))
query("top_4_value_counts", "SELECT genre, count(*) AS n FROM genres GROUP BY genre ORDER BY n DESC, genre LIMIT 12")(lambda v: R.distribution_report(v.genres, "genre", top=12).top)
query("top_5_newest", "SELECT _row_id, ts FROM ratings ORDER BY ts DESC, _row_id LIMIT 100")(lambda v: M.newest(v.ratings.select("_row_id", "ts"), "ts", 100, ("_row_id",)))
query("smp_1_pool_sample")(lambda v: _popularity(v, pool_size=100).recommend(10, random_state=7))
query("smp_2_recommend_one")(lambda v: _popularity(v).recommend_one())
query("smp_3_row_sample")(lambda v: M.sample(v.ratings.select("_row_id", "rating"), ["_row_id"], 300))
query("spl_1_stratified_by_user", "SELECT userID, count(*) AS n, cast(ceil(count(*) * 0.2) AS bigint) AS held_out FROM ratings GROUP BY userID")(lambda v: M.stratified_split(v.ratings, "userID", ["_row_id"]).groupBy("userID").agg(F.count("*").alias("n"), F.count_if("held_out").alias("held_out")))
query("spl_3_stratified_labels", "SELECT label, count(*) AS n, cast(ceil(count(*) * 0.2) AS bigint) AS held_out FROM embeddings GROUP BY label")(lambda v: M.stratified_split(v.embeddings, "label", ["vec_id"]).groupBy("label").agg(F.count("*").alias("n"), F.count_if("held_out").alias("held_out")))
query("set_1_union", "SELECT 'r' AS kind, userID FROM ratings UNION ALL SELECT 't', userID FROM tag_events")(lambda v: v.ratings.select(F.lit("r").alias("kind"), "userID").unionByName(v.tag_events.select(F.lit("t").alias("kind"), "userID")))
query("set_2_distinct", "SELECT movieID, arg_min(actorID, ranking * 100000 + actorID) AS actorID FROM actors GROUP BY movieID")(lambda v: v.actors.groupBy("movieID").agg(F.min_by("actorID", F.col("ranking") * 100000 + F.col("actorID")).alias("actorID")))
query("set_3_algebra", "SELECT userID FROM ratings EXCEPT SELECT userID FROM tag_events")(lambda v: v.ratings.select("userID").subtract(v.tag_events.select("userID")))
query("set_4_accumulate", "SELECT count(DISTINCT movieID) AS n FROM ratings WHERE rating >= 4.5")(lambda v: v.ratings.where("rating >= 4.5").agg(F.count_distinct("movieID").alias("n")))

# --- Scalars ---

query("str_scalars", r"""SELECT movieID, _row_id, cast(movieID AS varchar) AS s1, trim('  ' || genre || ' ') AS s2, genre AS s3, length(genre) BETWEEN 3 AND 4 AS s4, regexp_full_match(genre, '[0-9]+') AS s5, replace(genre || ' x', ' ', '_') AS s6, lower(genre) AS s7, trim(coalesce(genre, '') || ' ' || 'end') AS s8, contains(lower(genre), 'o') AS s10, substr(genre, 1, 4) AS s11 FROM genres""")(
    lambda v: v.genres.select("movieID", "_row_id", F.col("movieID").cast("string").alias("s1"), S.strip(F.concat(F.lit("  "), "genre", F.lit(" "))).alias("s2"), S.concat_reasons({}).alias("x"), F.concat_ws(";", F.lit(None).cast("string"), "genre").alias("s3"), F.length("genre").between(3, 4).alias("s4"), F.col("genre").rlike(r"(?U)^\d+$").alias("s5"), F.replace(F.concat("genre", F.lit(" x")), F.lit(" "), F.lit("_")).alias("s6"), F.lower("genre").alias("s7"), F.trim(F.concat(F.coalesce("genre", F.lit("")), F.lit(" end"))).alias("s8"), F.contains(F.lower("genre"), F.lit("o")).alias("s10"), F.substring("genre", 1, 4).alias("s11")).drop("x")
)
query("str_9_join_list", "SELECT movieID, string_agg(genre, ' ' ORDER BY genre) AS g FROM genres GROUP BY movieID")(lambda v: C.joined_texts(v.genres, "movieID", "genre", ["genre"], "g"))
query("str_12_tokenise", "SELECT movieID, len(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS n FROM texts")(lambda v: v.texts.select("movieID", F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0))).cast("long").alias("n")))
query("dat_scalars", "SELECT event_id, make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), floor(second(ts))) AS t, cast(floor(date_diff('microsecond', ts, timestamp '2024-02-01 12:00:00') / 86400000000) AS bigint) AS days, year(ts) AS year, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")(
    lambda v: v.events.select("event_id", F.try_make_timestamp(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts"), F.second("ts")).alias("t"), S.elapsed_days(F.col("ts"), F.lit("2024-02-01 12:00:00").cast("timestamp")).alias("days"), F.year("ts").alias("year"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))
)
query("mat_scalars", "SELECT event_id, round(CASE WHEN value > -1 THEN ln(1 + value) END, 6) AS m1, round(sqrt(abs(value)), 6) AS m2, round(value, 3) AS m3, round_even(value * 2, 0) / 2 AS m4, value % 2 <> 0 AS m5, least(greatest(value, 5), 50) AS m6, round(coalesce(100.0 * value / nullif(event_id % 3, 0), 0), 6) AS m7 FROM events")(
    lambda v: v.events.select("event_id", F.log1p("value").alias("m1"), F.sqrt(F.abs("value")).alias("m2"), F.round("value", 3).alias("m3"), S.half_star(F.col("value")).alias("m4"), (F.col("value") % 2 != 0).alias("m5"), S.clip(F.col("value"), 5, 50).alias("m6"), S.share(F.col("value"), F.col("event_id") % 3).alias("m7"))
)
query("cnd_1_conditions", "SELECT movieID, CASE WHEN year > 1990 THEN 'new' ELSE 'old' END AS age, cast(year > 1990 AS int) AS flag FROM items")(lambda v: v.items.select("movieID", F.when(F.col("year") > 1990, "new").otherwise("old").alias("age"), (F.col("year") > 1990).cast("int").alias("flag")))
query("vec_scalars", "SELECT a.vec_id, round(list_dot_product(a.embedding::double[], q.embedding::double[]), 6) AS dot, round(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])), 6) AS norm, round(a.embedding[1]::double * q.embedding[1]::double, 6) AS first, list_position(a.embedding, list_max(a.embedding)) AS best FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")(
    lambda v: v.embeddings.crossJoin(F.broadcast(v.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", S.dot(F.col("embedding"), F.col("q")).alias("dot"), S.norm(F.col("embedding")).alias("norm"), F.zip_with(F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>"), lambda a, b: a * b)[0].alias("first"), F.array_position("embedding", F.array_max("embedding")).alias("best"))
)
query("vec_6_probability_pair", "SELECT vec_id, round(1 - s, 6) AS p0, round(s, 6) AS p1 FROM (SELECT vec_id, least(greatest(embedding[1]::double, 0), 1) AS s FROM embeddings) e")(lambda v: v.embeddings.select("vec_id", C.probability_pair(F.col("embedding")[0].cast("double")).alias("p")).select("vec_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1")))

# --- Popularity and baselines ---


def _popularity(v: Domain, **kw) -> M.Popularity:
    return M.Popularity(min_votes=20, **kw).fit(A.item_popularity(v.ratings), v.items.select("movieID", "title"))


RANKED = "WITH f AS (SELECT movieID, count(rating) AS n, avg(rating) AS r FROM ratings GROUP BY movieID), w AS (SELECT movieID, r AS movie_avg_rating, n AS movie_rating_count, n / (n + 20.0) * r + 20.0 / (n + 20.0) * (SELECT avg(r) FROM f) AS weighted_rating FROM f WHERE n >= 20) SELECT w.movieID, round(movie_avg_rating, 6) AS movie_avg_rating, movie_rating_count, round(weighted_rating, 6) AS weighted_rating, title FROM w LEFT JOIN items i ON w.movieID = i.movieID"
query("rec_1_popularity_fit", RANKED)(lambda v: _popularity(v).ranked)
query("rec_2_popularity_recommend", RANKED + " ORDER BY w.weighted_rating DESC, w.movieID LIMIT 10")(lambda v: _popularity(v).recommend())
query("rec_3_recommend_one", RANKED.replace("SELECT w.movieID, round(movie_avg", "SELECT count(*) AS n FROM (SELECT w.movieID, round(movie_avg") + " ORDER BY w.weighted_rating DESC, w.movieID LIMIT 1) x")(lambda v: _popularity(v).recommend_one(pool_size=100).agg(F.count("*").alias("n")))
BASE_SQL = """WITH s AS (SELECT *, row_number() OVER (ORDER BY ts, _row_id) AS k, count(*) OVER () AS n FROM ratings), tr AS (SELECT * FROM s WHERE k <= floor(n * 0.8)), te AS (SELECT * FROM s WHERE k > floor(n * 0.8)),
g AS (SELECT avg(rating) AS g FROM tr), u AS (SELECT userID, avg(rating) AS um FROM tr GROUP BY userID), m AS (SELECT movieID, avg(rating) AS mm FROM tr GROUP BY movieID),
p AS (SELECT rating, g AS "global", coalesce(um, g) AS "user", coalesce(mm, g) AS item, 0.5 * coalesce(um, g) + 0.5 * coalesce(mm, g) AS blend FROM te LEFT JOIN u ON te.userID = u.userID LEFT JOIN m ON te.movieID = m.movieID, g) """ + " UNION ALL ".join(f"""SELECT '{x}' AS model, round(sqrt(avg(("{x}" - rating) * ("{x}" - rating))), 6) AS rmse, round(avg(abs("{x}" - rating)), 6) AS mae FROM p""" for x in ("global", "item", "user", "blend"))


def _split(v: Domain) -> tuple[DataFrame, DataFrame]:
    return M.temporal_split(v.ratings, ["ts", "_row_id"])


def _interactions_of(df: DataFrame) -> DataFrame:
    return df.select("userID", "movieID", F.col("rating").alias("interaction_rating"))


query("rec_12_baselines", BASE_SQL)(lambda v: M.compare(M.baselines(*_split(v)), ["global", "item", "user", "blend"]))

# --- Factor models: no SQL; unit tests hold them against numpy ---


def _svd(v: Domain) -> tuple[M.SVD, DataFrame]:
    train, test = _split(v)
    return M.SVD(n_factors=10).fit(_interactions_of(train)), _interactions_of(test)


def _mf(v: Domain) -> tuple[M.MatrixFactorization, DataFrame]:
    train, test = _split(v)
    return M.MatrixFactorization(n_factors=8, n_epochs=5).fit(_interactions_of(train)), _interactions_of(test)


def _both(v, model, f):
    m, test = model(v)
    return f(m, test)


def _first_user(v: Domain) -> int:
    return v.ratings.agg(F.min("userID")).first()[0]


query("rec_5_svd_predict")(lambda v: _both(v, _svd, lambda m, t: m.predict(t)))
query("rec_6_svd_evaluate")(lambda v: _both(v, _svd, lambda m, t: m.evaluate(t)))
query("rec_7_svd_recommend")(lambda v: _both(v, _svd, lambda m, t: m.recommend_all(m.users.select("u"), v.items, 10)))
query("rec_9_mf_predict")(lambda v: _both(v, _mf, lambda m, t: m.predict(t)))
query("rec_10_mf_evaluate")(lambda v: _both(v, _mf, lambda m, t: m.evaluate(t)))
query("rec_11_mf_recommend")(lambda v: _both(v, _mf, lambda m, t: m.recommend(m.users.agg(F.min("u")).first()[0], v.items)))
query("xp_1_mf_decomposition")(lambda v: _both(v, _mf, lambda m, t: m.decomposition(t.select("userID", "movieID"))))
query("xp_2_waterfall")(lambda v: _both(v, _mf, lambda m, t: m.waterfall(t.select("userID", "movieID").distinct())))
query("xp_3_top_factors")(lambda v: _both(v, _mf, lambda m, t: m.top_factors(t.select("userID", "movieID").distinct(), 3)))


def _because(m: M.MatrixFactorization, t: DataFrame) -> DataFrame:
    u, i = m.seen.orderBy("u", "i").select("u", "i").first()
    return m.because_you_rated(u, i, m.seen.select(F.col("u").alias("userID"), F.col("i").alias("movieID"), F.lit(5.0).alias("interaction_rating")))


query("xp_4_because_you_rated")(lambda v: _both(v, _mf, _because))

# --- Content ---

SOUP_SQL = """WITH g AS (SELECT movieID, string_agg(replace(genre, ' ', '_'), ' ' ORDER BY _row_id) AS genres FROM genres GROUP BY movieID),
d AS (SELECT movieID, lower(replace(arg_min(directorName, _row_id), ' ', '_')) AS director FROM directors GROUP BY movieID),
a AS (SELECT movieID, string_agg(lower(replace(actorName, ' ', '_')), ' ' ORDER BY ranking, _row_id) AS actors FROM actors WHERE ranking <= 5 GROUP BY movieID),
t0 AS (SELECT movieID, value, row_number() OVER (PARTITION BY movieID ORDER BY tagWeight DESC, tagID) AS k FROM item_tags JOIN tags ON tags.id = tagID),
t AS (SELECT movieID, string_agg(value, ' ' ORDER BY k) AS tags FROM t0 WHERE k <= 10 GROUP BY movieID)
SELECT i.movieID, trim(concat_ws(' ', genres, genres, director, actors, t.tags)) AS soup FROM items i LEFT JOIN g USING (movieID) LEFT JOIN d USING (movieID) LEFT JOIN a USING (movieID) LEFT JOIN t USING (movieID) WHERE length(trim(concat_ws(' ', genres, genres, director, actors, t.tags))) > 0"""


def _soup(v: Domain) -> DataFrame:
    tags = v.item_tags.join(v.tags, F.col("tagID") == F.col("id")).select("movieID", "value", F.col("tagWeight").alias("weight"), F.col("tagID").alias("_row_id"))
    return C.content_soup(v.items.select("movieID"), v.genres, v.directors, v.actors, tags).select("movieID", "soup")


query("cb_1_content_soup", SOUP_SQL)(_soup)
TFIDF_SQL = """WITH e AS (SELECT movieID, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM texts), tf AS (SELECT movieID, term, count(*) AS tf FROM e GROUP BY movieID, term),
vo AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 2000), w AS (SELECT tf.movieID, tf.term, tf.tf * (ln((1 + (SELECT count(*) FROM texts)) / (1 + df)) + 1) AS w FROM tf JOIN vo ON tf.term = vo.term),
l AS (SELECT movieID, sqrt(sum(w * w)) AS l FROM w GROUP BY movieID) SELECT w.movieID, term, round(w / l, 6) AS weight FROM w JOIN l ON w.movieID = l.movieID"""
query("cb_2_tfidf", TFIDF_SQL)(lambda v: C.tfidf(v.texts, "movieID", "text", pattern="[a-z0-9_]{2,}"))
query("cb_4_title_index", "SELECT title, min(_row_id) AS _row_id FROM items GROUP BY title")(lambda v: C.title_index(v.items).select("title", "_row_id"))
SIM_SQL = "SELECT movieID, round(s, 4) AS similarity, row_number() OVER (ORDER BY s DESC, movieID) AS rank FROM (SELECT movieID, list_dot_product(embedding::double[], (SELECT embedding::double[] FROM vectors WHERE movieID = 5)) AS s FROM vectors WHERE movieID <> 5) x ORDER BY s DESC, movieID LIMIT 10"
query("cb_5_similar_items", SIM_SQL)(lambda v: C.similar(v.vectors, 5))
PROFILE = """ v AS (SELECT movieID, unnest(range(1, 65)) AS i, unnest(embedding::double[]) AS e FROM vectors), us AS (SELECT userID FROM {liked} WHERE userID % 20 = 0 GROUP BY userID),
lk AS (SELECT userID, movieID FROM {liked} SEMI JOIN us USING (userID) SEMI JOIN vectors USING (movieID)),
m AS (SELECT userID, i, avg(e) AS m FROM lk JOIN v USING (movieID) GROUP BY userID, i), l AS (SELECT userID, sqrt(sum(m * m)) AS l FROM m GROUP BY userID),
sc AS (SELECT m.userID, v.movieID, sum(m.m / greatest(l.l, 1e-9) * v.e) AS score FROM m JOIN l USING (userID) JOIN v USING (i) GROUP BY m.userID, v.movieID)"""


def _users(v: Domain) -> DataFrame:
    """The stated query set of the searches for users: ids divisible by 20, against all items."""
    return v.ratings.where("rating >= 4 AND userID % 20 = 0").select("userID").distinct()


query("cb_6_profile_recommendations", "WITH lk0 AS (SELECT * FROM ratings WHERE rating >= 4)," + PROFILE.format(liked="lk0") + """, r AS (SELECT *, row_number() OVER (PARTITION BY userID ORDER BY score DESC, movieID) AS rank FROM sc WHERE NOT EXISTS (SELECT 1 FROM ratings x WHERE x.userID = sc.userID AND x.movieID = sc.movieID)) SELECT userID, movieID, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")(lambda v: C.profile_recommendations(v.ratings, v.vectors, _users(v)))
query("ev_2_catalog_coverage", "WITH lk0 AS (SELECT * FROM ratings WHERE rating >= 4)," + PROFILE.format(liked="lk0") + """, r AS (SELECT *, row_number() OVER (PARTITION BY userID ORDER BY score DESC, movieID) AS rank FROM sc) SELECT count(DISTINCT movieID) AS recommended, (SELECT count(*) FROM vectors) AS items, round(count(DISTINCT movieID) / (SELECT count(*) FROM vectors), 6) AS coverage FROM r WHERE rank <= 10""")(lambda v: C.catalog_coverage(v.ratings, v.vectors, _users(v)))
EV1 = """WITH l0 AS (SELECT userID, movieID, ts, _row_id FROM ratings SEMI JOIN vectors USING (movieID) WHERE rating >= 4), s AS (SELECT *, row_number() OVER (PARTITION BY userID ORDER BY ts, _row_id) AS k, count(*) OVER (PARTITION BY userID) AS n FROM l0),
us0 AS (SELECT DISTINCT userID FROM ratings WHERE rating >= 4 AND userID % 20 = 0), sp AS (SELECT *, k > n - greatest(1, floor(n * 0.2)) AS held FROM s SEMI JOIN us0 USING (userID) WHERE n >= 5), tr0 AS (SELECT userID, movieID FROM sp WHERE NOT held),""" + PROFILE.format(liked="tr0") + """, r AS (SELECT *, row_number() OVER (PARTITION BY userID ORDER BY score DESC, movieID) AS rank FROM sc WHERE NOT EXISTS (SELECT 1 FROM tr0 x WHERE x.userID = sc.userID AND x.movieID = sc.movieID)),
h AS (SELECT userID, count(*) AS hits FROM r SEMI JOIN (SELECT userID, movieID FROM sp WHERE held) t USING (userID, movieID) WHERE rank <= 10 GROUP BY userID), pr AS (SELECT DISTINCT sp.userID, coalesce(hits, 0) / 10.0 AS precision FROM sp LEFT JOIN h ON sp.userID = h.userID) """
query("ev_1_precision_at_k", EV1 + 'SELECT userID, round(precision, 6) AS "precision" FROM pr')(lambda v: C.precision_at_k(v.ratings, v.vectors, _users(v), order=("ts", "_row_id")))
query("ev_4_precision_summary", EV1 + "SELECT round(avg(precision), 6) AS mean, round(stddev_pop(precision), 6) AS std, count(*) AS users FROM pr")(lambda v: C.precision_summary(C.precision_at_k(v.ratings, v.vectors, _users(v), order=("ts", "_row_id"))))
query("ev_3_intra_list_diversity", "SELECT round(1 - avg(list_dot_product(a.embedding::double[], b.embedding::double[])), 6) AS diversity FROM vectors a, vectors b WHERE a.movieID < b.movieID AND a.movieID < 10 AND b.movieID < 10")(lambda v: C.intra_list_diversity(v.vectors.where("movieID < 10")))
query("ev_5_errors_per_user", """WITH g AS (SELECT avg(rating) AS g FROM ratings), i AS (SELECT movieID, avg(rating) AS p FROM ratings GROUP BY movieID) SELECT userID, round(sqrt(avg((p - rating) * (p - rating))), 6) AS rmse, round(avg(abs(p - rating)), 6) AS mae, count(*) AS n FROM ratings JOIN i USING (movieID) GROUP BY userID""")(lambda v: M.errors(v.ratings.join(v.ratings.groupBy("movieID").agg(F.avg("rating").alias("p")), "movieID"), "rating", "p", "userID"))
query("ev_6_similarity_matrix", "SELECT a.movieID AS a, b.movieID AS b, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) AS similarity FROM vectors a, vectors b WHERE a.movieID < 8 AND b.movieID < 8")(lambda v: C.similarity_matrix(v.vectors.where("movieID < 8")))
query("xp_5_surrogate_labels", "WITH s AS (SELECT movieID, list_dot_product(embedding::double[], (SELECT embedding::double[] FROM vectors WHERE movieID = 5)) AS s FROM vectors) SELECT movieID, CASE WHEN movieID IN (SELECT movieID FROM s WHERE movieID <> 5 ORDER BY s DESC, movieID LIMIT 100) THEN 1 ELSE 0 END AS label FROM s")(lambda v: C.surrogate_labels(v.vectors, 5))
query("xp_10_token_contributions", TFIDF_SQL.replace(" SELECT w.movieID, term, round(w / l, 6) AS weight FROM w", ", x AS (SELECT w.movieID, term, w / l AS weight FROM w") + ") SELECT a.term, round(a.weight * b.weight, 6) AS contribution FROM x a JOIN x b ON a.term = b.term WHERE a.movieID = 0 AND b.movieID = 1")(lambda v: C.token_contributions(C.tfidf(v.texts, "movieID", "text", pattern="[a-z0-9_]{2,}"), 0, 1, "movieID"))


def _surrogate(v: Domain) -> tuple[C.Surrogate, DataFrame]:
    labels = C.surrogate_labels(v.vectors, 5, 40)
    w = C.tfidf(v.texts.join(labels, "movieID", "left_semi"), "movieID", "text", 60, "[a-z0-9_]{2,}")
    s = C.Surrogate(trees=10)
    rows = s.assemble(w, "movieID").join(labels, "movieID")
    return s.fit(rows), rows


query("xp_6_surrogate_forest")(lambda v: (lambda s, r: s.model.transform(r).select("movieID", "label", "prediction"))(*_surrogate(v)))
query("xp_7_path_contributions")(lambda v: (lambda s, r: C.path_contributions(s.model, r).select("movieID", "base", F.size("contributions").alias("features")))(*_surrogate(v)))
query("viz_1_projection")(lambda v: C.projection(v.vectors))
query("ext_windowed_popularity", "SELECT time_bucket(interval '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")(lambda v: windowed_counts(v.events))
