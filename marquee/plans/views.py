"""The domain tables over the synthetic star schema. The same SQL text makes them in Spark
and in the oracle, so that the two engines can't drift apart."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: Name -> SQL over the tables and earlier views.
VIEWS = {
    "ratings": """SELECT o_custkey AS userID, l_partkey AS movieID, ceil(l_quantity / 5) / 2 AS rating, o_orderdate AS ts,
        ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS _row_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "items": """SELECT p_partkey AS movieID, p_name AS title, 1960 + p_size AS year,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS rt_id,
        CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE cast(p_retailprice AS varchar(32)) END AS rt_score,
        CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS picture, p_partkey AS _row_id FROM part""",
    "genres": """SELECT p_partkey AS movieID, p_type AS genre, p_partkey * 2 AS _row_id FROM part
        UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1), p_partkey * 2 + 1 FROM part""",
    "actors": """SELECT DISTINCT l_partkey AS movieID, l_suppkey AS actorID, s_name AS actorName, l_linenumber AS ranking,
        (l_partkey * 10000 + l_suppkey) * 10 + l_linenumber AS _row_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "directors": """SELECT d.movieID, s_suppkey AS directorID, s_name AS directorName, d.movieID AS _row_id
        FROM (SELECT l_partkey AS movieID, min(l_suppkey) AS k FROM lineitem GROUP BY l_partkey) d JOIN supplier ON s_suppkey = d.k""",
    "countries": """SELECT d.movieID, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_name END AS country, d.movieID AS _row_id
        FROM directors d JOIN supplier ON s_suppkey = d.directorID JOIN nation ON n_nationkey = s_nationkey""",
    "locations": """SELECT DISTINCT l_partkey AS movieID, r_name AS location1,
        CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS location2,
        CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE s_name END AS location3,
        CASE WHEN l_linenumber > 2 THEN NULL ELSE l_linestatus END AS location4
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "tag_events": """SELECT user_id AS userID, cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS movieID, event_type AS tagID, ts, event_id AS _row_id FROM events""",
    "item_tags": "SELECT movieID, tagID, count(*) AS tagWeight FROM tag_events GROUP BY movieID, tagID",
    "tags": "SELECT event_type AS id, upper(event_type) AS value FROM events GROUP BY event_type UNION ALL SELECT 'unused', '7'",
    "vectors": "SELECT vec_id AS movieID, embedding FROM embeddings",
    "texts": "SELECT doc_id AS movieID, text FROM documents",
}


def needed(sql: str) -> list[str]:
    """The views that a text names, and those that these name, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        t = todo.pop()
        for v in VIEWS:
            if v not in found and re.search(rf"\b{v}\b", t):
                found.add(v)
                todo.append(VIEWS[v])
    return [v for v in VIEWS if v in found]


def with_views(sql: str) -> str:
    """A query over views as one over the tables."""
    parts = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed(sql))
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:]}" if parts else body
    return f"WITH {parts} {body}" if parts else body


class Domain:
    """The tables and views of a folder, each a lazy DataFrame made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            made = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        elif name in VIEWS:
            sql = VIEWS[name]
            names = [n for n in (*TABLES, *VIEWS) if n != name and re.search(rf"(FROM|JOIN) {n}\b", sql)]
            for n in names:
                sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
            made = self._spark.sql(sql, **{n: getattr(self, n) for n in names})
        else:
            raise AttributeError(name)
        self._made[name] = made
        setattr(self, name, made)
        return made
