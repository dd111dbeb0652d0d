"""User, item and interaction features. One aggregation for each table; item blocks join on
the item key, so each costs at most one shuffle; user and item statistics join the rating log
as pre-aggregated dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.scalars import END_DATE, clip, elapsed_days, or_zero, to_number
from marquee.operators.checks import require_columns

#: The genres that have a column of their own.
GENRES = ("Action", "Adventure", "Animation", "Children", "Comedy", "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western")
#: Fixed values of the feature definitions.
HIGH_RATING, CAST_CAP, RARE_COUNTRY, DEFAULT_AFFINITY, AGE_YEAR = 4.0, 50, 50, 3.5, 2009
RT = {"movie_rt_critics_rating": "rtAllCriticsRating", "movie_rt_critics_score": "rtAllCriticsScore", "movie_rt_audience_rating": "rtAudienceRating", "movie_rt_audience_score": "rtAudienceScore"}


def _rating_stats(prefix: str, rating: str, n: str):
    return [F.count(rating).alias(n), F.avg(rating).alias(f"{prefix}_avg_rating"), F.coalesce(F.stddev_samp(rating), F.lit(0.0)).alias(f"{prefix}_rating_std")]


def user_rating_features(ratings: DataFrame, user: str = "userID", rating: str = "rating", ts: str = "timestamp", end: str = END_DATE) -> DataFrame:
    """Rating behaviour of each user; a single rating has a deviation of 0."""
    require_columns(ratings, user, rating, ts)
    r = ratings.where(F.col(user).isNotNull()).groupBy(user).agg(
        *_rating_stats("user", rating, "user_rating_count"),
        F.min(rating).alias("user_min_rating"),
        F.max(rating).alias("user_max_rating"),
        F.count_if(F.col(rating) >= HIGH_RATING).alias("_high"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
    )
    return r.select(
        user, "user_rating_count", "user_avg_rating", "user_rating_std", "user_min_rating", "user_max_rating",
        (F.col("user_max_rating") - F.col("user_min_rating")).alias("user_rating_range"),
        F.try_divide(F.col("_high"), F.col("user_rating_count")).alias("user_pct_high_ratings"),
        elapsed_days(F.col("_first"), F.col("_last")).alias("user_activity_span_days"),
        elapsed_days(F.col("_last"), F.lit(end).cast("timestamp")).alias("user_days_since_last_rating"),
        (F.col("user_avg_rating") * F.log1p("user_rating_count")).alias("user_avg_rating_log_count"),
    )


def user_tag_features(tagged: DataFrame, user: str = "userID", item: str = "movieID", tag: str = "tagID") -> DataFrame:
    t = tagged.where(F.col(user).isNotNull()).groupBy(user).agg(F.count(tag).alias("user_tag_event_count"), F.count_distinct(item).alias("user_unique_movies_tagged"), F.count_distinct(tag).alias("user_unique_tags_used"))
    return t.withColumn("user_tagging_intensity", F.try_divide(F.col("user_tag_event_count"), F.col("user_unique_movies_tagged")))


def user_features(ratings: DataFrame, tagged: DataFrame, user: str = "userID", **kw) -> DataFrame:
    """Users who rate; those who never tag have tag features of 0."""
    t = user_tag_features(tagged, user)
    out = user_rating_features(ratings, user, **kw).join(t, user, "left")
    return out.fillna(0, [c for c in t.columns if c != user])


def item_popularity(ratings: DataFrame, item: str = "movieID", rating: str = "rating") -> DataFrame:
    require_columns(ratings, item, rating)
    r = ratings.where(F.col(item).isNotNull()).groupBy(item).agg(*_rating_stats("movie", rating, "movie_rating_count"), F.count_if(F.col(rating) >= HIGH_RATING).alias("_high"))
    return r.select(item, "movie_rating_count", "movie_avg_rating", "movie_rating_std", F.log1p("movie_rating_count").alias("movie_log_rating_count"), F.try_divide(F.col("_high"), F.col("movie_rating_count")).alias("movie_pct_high_ratings"))


def item_metadata(items: DataFrame, item: str = "id", year: str = "year", presence: str = "rtID", scores: dict[str, str] = RT, now: int = AGE_YEAR) -> DataFrame:
    """Year, age, and scores as numbers; what isn't one becomes the median of those of items
    that have a value of `presence`. An unknown year is 0."""
    x = items.select(F.col(item).alias("movieID"), F.coalesce(F.col(year).cast("int"), F.lit(0)).alias("movie_year"), F.col(presence).isNotNull().cast("int").alias("movie_has_rt_data"), *(to_number(F.col(c)).alias(n) for n, c in scores.items()))
    x = x.withColumn("movie_age", F.greatest(F.lit(now) - F.col("movie_year"), F.lit(0)))
    medians = x.where("movie_has_rt_data = 1").agg(*(F.median(n).alias(f"_{n}") for n in scores))
    x = x.crossJoin(F.broadcast(medians))
    return x.select("movieID", "movie_year", "movie_age", "movie_has_rt_data", *(F.coalesce(n, f"_{n}").alias(n) for n in scores))


def genre_features(genres: DataFrame, values=GENRES, item: str = "movieID", genre: str = "genre", extra: bool = False) -> DataFrame:
    """Genre rows of each item, and a 0/1 column for each of `values`. With extra, genres
    beyond these get columns under their own name (one small job finds them)."""
    known = genres.where(F.col(item).isNotNull())
    others = sorted(r[0] for r in known.select(genre).dropna().distinct().collect() if r[0] not in values) if extra else []
    name = lambda g: f"genre_{g}" if g in values else g
    flags = [F.max(F.when(F.col(genre) == g, 1).otherwise(0)).alias(name(g)) for g in [*values, *others]]
    return known.groupBy(item).agg(F.count("*").alias("movie_genre_count"), *flags)


def actor_features(actors: DataFrame, item: str = "movieID", rank: str = "ranking", actor: str = "actorID", cap: int = CAST_CAP) -> DataFrame:
    """Cast size, capped size, least and mean rank, and whether two share a rank (a missing
    rank counts as one)."""
    by_rank = actors.where(F.col(item).isNotNull()).groupBy(item, rank).agg(F.count(actor).alias("_n"), F.count("*").alias("_rows"))
    a = by_rank.groupBy(item).agg(
        F.sum("_n").alias("movie_cast_size"),
        F.min(rank).alias("movie_top_actor_rank_min"),
        F.try_divide(F.sum(F.col(rank) * F.col("_rows")), F.sum(F.when(F.col(rank).isNotNull(), F.col("_rows")))).cast("double").alias("movie_top_actor_rank_mean"),
        F.max((F.col("_rows") > 1).cast("int")).alias("movie_has_rank_conflict"),
    )
    return a.withColumn("movie_cast_size_capped", clip(F.col("movie_cast_size"), high=cap))


def director_features(directors: DataFrame, item: str = "movieID", director: str = "directorID") -> DataFrame:
    """The most rows that a director of the item has. A director's rows are counted first, so
    that a prolific one is a single row in the join."""
    n = directors.where(F.col(director).isNotNull()).groupBy(director).agg(F.count("*").cast("double").alias("_n"))
    d = directors.join(n, director, "left").where(F.col(item).isNotNull()).groupBy(item).agg(F.max("_n").alias("movie_director_experience"))
    return d.withColumn("movie_has_director", F.lit(1))


def country_features(countries: DataFrame, item: str = "movieID", country: str = "country", rare: int = RARE_COUNTRY) -> DataFrame:
    """A row for each row: its country, Unknown where missing, Other where it has few rows."""
    c = countries.select(item, F.coalesce(country, F.lit("Unknown")).alias("_c"))
    n = c.groupBy("_c").agg(F.count("*").alias("_n"))
    return c.join(n.where(F.col("_n") >= rare), "_c", "left").select(item, F.when(F.col("_n").isNull(), "Other").otherwise(F.col("_c")).alias("movie_country_encoded"))


def tag_features(tags: DataFrame, item: str = "movieID", tag: str = "tagID", weight: str = "tagWeight") -> DataFrame:
    t = tags.where(F.col(item).isNotNull()).groupBy(item).agg(F.count(tag).alias("movie_unique_tag_count"), or_zero(F.sum(weight)).cast("double").alias("movie_tag_weight_sum"), F.avg(weight).alias("movie_tag_weight_mean"))
    return t.withColumn("movie_log_tag_weight_sum", F.log1p("movie_tag_weight_sum"))


def location_features(locations: DataFrame, levels: list[str], item: str = "movieID") -> DataFrame:
    depth = sum((F.col(c).isNotNull().cast("int") for c in levels), F.lit(0))
    return locations.where(F.col(item).isNotNull()).groupBy(item).agg(F.max(depth).alias("movie_location_depth"))


def item_features(base: DataFrame, blocks: list[DataFrame], item: str = "movieID") -> DataFrame:
    """base with all blocks by left joins. Items without a director, tags or location get 0,
    without a country Unknown; other features stay null."""
    for b in blocks:
        base = base.join(b, item, "left")
    zero = [c for c in ("movie_director_experience", "movie_has_director", "movie_unique_tag_count", "movie_tag_weight_sum", "movie_tag_weight_mean", "movie_log_tag_weight_sum", "movie_location_depth") if c in base.columns]
    base = base.fillna(0, zero)
    return base.fillna("Unknown", ["movie_country_encoded"]) if "movie_country_encoded" in base.columns else base


def genre_affinity(ratings: DataFrame, genres: DataFrame, values=GENRES, user: str = "userID", item: str = "movieID", rating: str = "rating", genre: str = "genre") -> DataFrame:
    """Each user's mean rating of each genre, in one pass over ratings x genres: 3.5 for a
    genre never rated. Users without any of the genres have no row."""
    g = genres.where(F.col(genre).isin(*values)).select(item, genre).distinct()
    j = ratings.where(F.col(user).isNotNull()).join(g, item)
    return j.groupBy(user).agg(*(F.coalesce(F.avg(F.when(F.col(genre) == v, F.col(rating))), F.lit(DEFAULT_AFFINITY)).alias(f"user_genre_affinity_{v}") for v in values))


def rating_sequence(ratings: DataFrame, user: str = "userID", ts: str = "timestamp", ties: tuple[str, ...] = ("_row_id",), name: str = "interaction_user_rating_sequence") -> DataFrame:
    """Each rating's place among its user's, from 1."""
    return ratings.withColumn(name, F.row_number().over(Window.partitionBy(user).orderBy(ts, *ties)).cast("long"))


def interaction_features(ratings: DataFrame, users: DataFrame, items: DataFrame, affinity: DataFrame | None = None, user: str = "userID", item: str = "movieID", rating: str = "rating", ts: str = "timestamp", ties: tuple[str, ...] = ("_row_id",)) -> DataFrame:
    """For each rating: deviations from the user's and item's mean, the item's age then, an
    early-rater flag (0 where unknown), the sequence number, and genre affinities."""
    r = rating_sequence(ratings.select(user, item, rating, ts, *ties), user, ts, ties)
    r = r.join(users.select(user, "user_avg_rating"), user, "left").join(items.select(item, "movie_avg_rating", "movie_year"), item, "left")
    age = clip(F.year(ts) - F.col("movie_year"), low=0)
    out = r.select(user, item, ts, *ties, F.col(rating).alias("interaction_rating"), (F.col(rating) - F.col("user_avg_rating")).alias("interaction_rating_vs_user_avg"), (F.col(rating) - F.col("movie_avg_rating")).alias("interaction_rating_vs_movie_avg"), age.alias("interaction_movie_age_at_rating"), F.coalesce((age <= 1).cast("int"), F.lit(0)).alias("interaction_is_early_rater"), "interaction_user_rating_sequence")
    return out if affinity is None else out.join(affinity, user, "left")


def rated_items(items: DataFrame, popularity: DataFrame, item: str = "movieID") -> DataFrame:
    return items.join(popularity, item, "left")


def all_features(data: dict[str, DataFrame], end: str = END_DATE) -> dict[str, DataFrame]:
    """The three feature tables, lazily, of the ten source tables (with timestamp)."""
    ratings, levels = data["user_ratedmovies"], ["location1", "location2", "location3", "location4"]
    users = user_features(ratings, data["user_taggedmovies"], end=end)
    items = item_features(
        item_metadata(data["movies"]),
        [item_popularity(ratings), genre_features(data["movie_genres"]), actor_features(data["movie_actors"]), director_features(data["movie_directors"]), country_features(data["movie_countries"]), tag_features(data["movie_tags"]), location_features(data["movie_locations"], levels)],
    )
    return {"user_features": users, "movie_features": items, "interaction_features": interaction_features(ratings, users, items, genre_affinity(ratings, data["movie_genres"]))}


#: Feature name -> (group, type, description).
CATALOGUE = {
    "user_rating_count": ("user", "long", "ratings given"),
    "user_avg_rating": ("user", "double", "mean rating"),
    "user_rating_std": ("user", "double", "spread of ratings"),
    "user_min_rating": ("user", "double", "least rating"),
    "user_max_rating": ("user", "double", "greatest rating"),
    "user_rating_range": ("user", "double", "greatest less least rating"),
    "user_pct_high_ratings": ("user", "double", "share of ratings of 4 or more"),
    "user_activity_span_days": ("user", "long", "days from first to last rating"),
    "user_days_since_last_rating": ("user", "long", "days from last rating to the log's end"),
    "user_tag_event_count": ("user", "long", "tags given"),
    "user_unique_movies_tagged": ("user", "long", "items tagged"),
    "user_unique_tags_used": ("user", "long", "different tags given"),
    "user_tagging_intensity": ("user", "double", "tags for each item tagged"),
    "movie_year": ("movie", "int", "year of release"),
    "movie_age": ("movie", "int", "years since release"),
    "movie_has_rt_data": ("movie", "int", "critics' page known"),
    "movie_rating_count": ("movie", "long", "ratings received"),
    "movie_avg_rating": ("movie", "double", "mean rating received"),
    "movie_rating_std": ("movie", "double", "spread of ratings received"),
    "movie_genre_count": ("movie", "long", "genres"),
    "movie_cast_size_capped": ("movie", "long", "actors, 50 at most"),
    "movie_director_experience": ("movie", "double", "films of its busiest director"),
    "movie_country_encoded": ("movie", "string", "country, rare ones grouped"),
    "movie_unique_tag_count": ("movie", "long", "tags"),
    "movie_location_depth": ("movie", "int", "known location levels"),
    "interaction_rating_vs_user_avg": ("interaction", "double", "rating less the user's mean"),
    "interaction_rating_vs_movie_avg": ("interaction", "double", "rating less the item's mean"),
    "interaction_movie_age_at_rating": ("interaction", "int", "item's age when rated"),
    "interaction_user_rating_sequence": ("interaction", "long", "place among the user's ratings"),
}


def feature_registry(spark) -> DataFrame:
    return spark.createDataFrame([(n, *v) for n, v in CATALOGUE.items()], "feature string, feature_group string, dtype string, description string")
