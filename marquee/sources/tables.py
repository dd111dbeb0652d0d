"""Sources and sinks: the ten source files, Parquet tables, run logs, the driver's tables."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.scalars import event_time, null_if_missing

DATES = ", date_day int, date_month int, date_year int, date_hour int, date_minute int, date_second int"
#: Columns of the source files, in order.
SCHEMAS = {
    "movies": "id bigint, title string, imdbID bigint, spanishTitle string, imdbPictureURL string, year int, rtID string, rtAllCriticsRating string, rtAllCriticsNumReviews string, rtAllCriticsNumFresh string, rtAllCriticsNumRotten string, rtAllCriticsScore string, rtTopCriticsRating string, rtTopCriticsNumReviews string, rtTopCriticsNumFresh string, rtTopCriticsNumRotten string, rtTopCriticsScore string, rtAudienceRating string, rtAudienceNumRatings string, rtAudienceScore string, rtPictureURL string",
    "movie_actors": "movieID bigint, actorID string, actorName string, ranking int",
    "movie_directors": "movieID bigint, directorID string, directorName string",
    "movie_genres": "movieID bigint, genre string",
    "movie_countries": "movieID bigint, country string",
    "movie_locations": "movieID bigint, location1 string, location2 string, location3 string, location4 string",
    "movie_tags": "movieID bigint, tagID bigint, tagWeight int",
    "tags": "id bigint, value string",
    "user_ratedmovies": "userID bigint, movieID bigint, rating double" + DATES,
    "user_taggedmovies": "userID bigint, movieID bigint, tagID bigint" + DATES,
}


def project_root(cwd: str | Path | None = None) -> Path:
    """cwd if it has a folder data, else its parent."""
    cwd = Path(cwd or Path.cwd())
    return cwd if (cwd / "data").exists() else cwd.parent


def file_map(root: str | Path | None = None, folder: str = "data/raw") -> dict[str, str]:
    root = Path(root) if root else project_root()
    return {name: str(root / folder / f"{name}.dat") for name in SCHEMAS}


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", encoding: str = "ISO-8859-1", columns: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """A delimited file with a header. Texts that stand for missing become null, numbers that
    aren't become null, and _row_id keeps the file's order (rows of one file ascend)."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    raw = spark.read.option("sep", sep).option("encoding", encoding).option("header", True).option("quote", "\u0000").schema(", ".join(f"`{n}` string" for n, _ in fields)).csv(path)
    # Numbers may carry white space or a decimal point; what isn't one is missing.
    kind = lambda n, t: null_if_missing(F.col(n)) if t == "string" else null_if_missing(F.trim(n)).try_cast("double").try_cast(t)
    df = raw.select(*(kind(n, t).alias(n) for n, t in fields), F.monotonically_increasing_id().alias("_row_id"))
    df = df.select(*columns, "_row_id") if columns else df
    return df.withColumnsRenamed(rename or {})


def load_tables(spark: SparkSession, files: dict[str, str], **kw) -> dict[str, DataFrame]:
    """All tables, lazily but for a look whether each has a row; an empty one is an error."""
    out = {name: read_table(spark, path, SCHEMAS[name], **kw) for name, path in files.items()}
    for name, df in out.items():
        if df.isEmpty():
            raise ValueError(f"table {name} has no rows: {files[name]}")
    return out


def with_timestamps(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    timed = {n: tables[n].withColumn("timestamp", event_time()) for n in ("user_ratedmovies", "user_taggedmovies") if n in tables}
    return tables | timed


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(tables: dict[str, DataFrame], params: dict, path: str) -> None:
    """A model's factor tables and parameters, all as tables: readable from any store."""
    for name, df in tables.items():
        write_parquet(df, f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").write.mode("overwrite").parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, json.loads(spark.read.parquet(f"{path}/params").first()[0])


class RunLog:
    """Parameters, metrics and tags of runs. Without a path nothing is kept."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.spark, self.path, self.run = spark, path, None

    def start_run(self, name: str) -> RunLog:
        self.run = {"run": name, "started": time.time(), "params": {}, "metrics": {}, "tags": {}}
        return self

    __enter__ = lambda self: self

    def __exit__(self, *_) -> None:
        self.end_run()

    def log_params(self, params: dict) -> None:
        self.run["params"] |= {k: str(v) for k, v in params.items()}

    def log_metrics(self, metrics: dict) -> None:
        self.run["metrics"] |= {k: float(v) for k, v in metrics.items()}

    def set_tag(self, key: str, value) -> None:
        self.run["tags"][key] = str(value)

    def end_run(self) -> None:
        if self.run and self.path:
            r = self.run
            rows = [(r["run"], r["started"], kind, k, str(v)) for kind in ("params", "metrics", "tags") for k, v in r[kind].items()]
            self.spark.createDataFrame(rows, "run string, started double, kind string, key string, value string").write.mode("append").parquet(self.path)
        self.run = None
