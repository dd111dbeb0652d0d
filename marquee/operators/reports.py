"""Data-quality and profiling reports. Three shapes recur: what is suspicious, how many x
there are for each y, and how much of one key set another covers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.scalars import any_of, concat_reasons, event_time, share, strip, to_number
from marquee.operators.checks import require_columns

QUANTILES = {"p90": 0.9, "p95": 0.95, "p99": 0.99}


@dataclass
class Report:
    """Named lazy tables of one report."""

    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def metrics(df: DataFrame) -> DataFrame:
    """A one-row table as rows of metric and value (double)."""
    return df.select(*(F.col(c).cast("double").alias(c) for c in df.columns)).unpivot([], list(df.columns), "metric", "value")


def summary(df: DataFrame, column: str, low: bool = True) -> DataFrame:
    """One row: n, mean, median, p90, p95, p99, max (and min) of a column; exact quantiles."""
    c = F.col(column)
    cols = [F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), *(F.percentile(c, q).alias(n) for n, q in QUANTILES.items()), F.max(c).cast("double").alias("max")]
    return df.agg(*cols, *([F.min(c).cast("double").alias("min")] if low else []))


# --- How many x for each y ---


def group_sizes(df: DataFrame, key: str, *distinct: str, name: str = "n") -> DataFrame:
    """Rows for each key, or distinct pairs of the key with other columns; null keys don't
    count as a group, nor do pairs with a null."""
    rows = df.select(key, *distinct)
    if distinct:
        rows = rows.dropna(subset=list(distinct)).distinct()
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def distribution_report(df: DataFrame, key: str, *distinct: str, top: int = 20, labels: tuple[DataFrame, str] | None = None) -> Report:
    """summary, distribution and top (with a label, if a lookup table is given)."""
    sizes = group_sizes(df, key, *distinct)
    first = sizes.orderBy(F.col("n").desc(), key).limit(top)
    if labels is not None:
        table, label = labels
        w = Window.partitionBy(key).orderBy(label)
        one = table.select(key, label).dropna().distinct().withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
        first = first.join(F.broadcast(first.select(key)), key, "left_semi").join(one, key, "left")
    return Report({"summary": summary(sizes, "n", low=False), "distribution": sizes, "top": first})


# --- What is suspicious ---


def text_masks(column: str, short: int = 1, digits: bool = True) -> dict[str, Column]:
    """Reasons to doubt a name: missing, empty, of 1 to `short` characters, digits only."""
    c, t = F.col(column), strip(F.col(column))
    masks = {"missing": c.isNull(), "empty": t == "", "short": F.length(t).between(1, short)}
    return masks | ({"digits": t.rlike(r"(?U)^\d+$")} if digits else {})


def suspicious_report(df: DataFrame, masks: dict[str, Column]) -> Report:
    """counts of each mask, and the flagged rows with their reasons."""
    counts = df.agg(*(F.count_if(F.coalesce(m, F.lit(False))).alias(n) for n, m in masks.items()))
    return Report({"counts": metrics(counts), "rows": df.withColumn("reason", concat_reasons(masks)).where(any_of(masks.values()))})


def suspicious_text_report(df: DataFrame, column: str, short: int = 1) -> Report:
    require_columns(df, column)
    return suspicious_report(df, text_masks(column, short))


def suspicious_location_report(df: DataFrame, id_col: str, levels: list[str]) -> Report:
    """The levels become rows first; a null level is missing."""
    long = df.unpivot([id_col], levels, "level", "location")
    return suspicious_report(long, text_masks("location"))


def repeated(df: DataFrame, keys: list[str], order: list[str] | None = None) -> Column:
    """True for rows after the first of their key; nulls are equal. With no order, for all
    rows of a key that repeats. As a window, it may only be selected from df."""
    if order is None:
        return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1


def repeats(df: DataFrame, keys: list[str]) -> Column:
    """Aggregate: how many rows come after the first of their key. One pass, no window."""
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))


def rating_masks(rating: str = "rating", low: float = 0.5, high: float = 5.0) -> dict[str, Column]:
    r = F.col(rating)
    return {"missing": r.isNull(), "below": r < low, "above": r > high, "not_half_step": (r * 2) % 1 != 0}


def weight_masks(weight: str) -> dict[str, Column]:
    w = to_number(F.col(weight))
    return {"missing": w.isNull(), "not_positive": w <= 0, "not_integer": w % 1 != 0}


def with_repeats(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("repeated", repeated(df, keys, order))


def ranking_report(df: DataFrame, item: str, rank: str) -> Report:
    """counts of bad ranks, of items whose ranks aren't 1..n, and of repeated ranks; the rows
    that repeat a rank; the distribution of ranks. Rows without an item or rank can't repeat."""
    r = to_number(F.col(rank))
    masks = {"missing": r.isNull(), "not_positive": r <= 0, "not_integer": r % 1 != 0}
    known = df.where(F.col(item).isNotNull() & r.isNotNull())
    by_rank = known.groupBy(item, r.alias("_r")).agg(F.count("*").alias("_n"))
    by_item = by_rank.groupBy(item).agg(F.min("_r").alias("lo"), F.max("_r").alias("hi"), F.count("*").alias("ranks"), F.sum(F.col("_n") - 1).alias("again"))
    by_item = by_item.agg(F.count_if((F.col("lo") != 1) | (F.col("hi") - F.col("lo") + 1 != F.col("ranks"))).alias("non_contiguous_items"), F.coalesce(F.sum("again"), F.lit(0)).alias("repeated_rank_rows"))
    counts = df.agg(*(F.count_if(F.coalesce(m, F.lit(False))).alias(n) for n, m in masks.items())).crossJoin(by_item)
    again = known.withColumn("_many", repeated(known, [item, rank])).where("_many").drop("_many")
    return Report({"counts": metrics(counts), "rows": again, "distribution": summary(known.withColumn("_r", r), "_r")})


# --- Coverage ---


def coverage_report(df: DataFrame, key: str, catalogue: DataFrame, catalogue_key: str) -> DataFrame:
    """How many catalogue entries df's distinct keys are: covered, catalogue, pct (3 digits)."""
    a = df.agg(F.count_distinct(key).alias("covered"))
    b = catalogue.agg(F.count_distinct(catalogue_key).alias("catalogue"))
    return a.crossJoin(b).withColumn("pct", share(F.col("covered"), F.col("catalogue"), 3))


def row_coverage(df: DataFrame, keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Of each key: distinct values, and the share of rows whose key the other table has."""
    out = []
    for key, (other, other_key) in keys.items():
        known = other.select(F.col(other_key).alias("_k")).dropna().distinct().withColumn("_known", F.lit(1))
        j = df.select(key).join(known, df[key] == known._k, "left")
        out.append(j.agg(F.lit(key).alias("key"), F.count_distinct(key).alias("distinct_values"), F.count("*").alias("rows"), share(F.count("_known"), F.count("*"), 3).alias("pct")))
    return _union(out)


def set_coverage(catalogue: DataFrame, key: str, used: list[tuple[DataFrame, str]]) -> Report:
    """Distinct ids of a catalogue against the ids that other tables use, by set algebra."""
    every = catalogue.select(F.col(key).alias("id")).dropna().distinct()
    parts = [t.select(F.col(k).alias("id")).dropna().distinct() for t, k in used]
    any_use = reduce(DataFrame.union, parts).distinct()
    in_all = reduce(DataFrame.intersect, parts)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    t = one(every, "catalogue").crossJoin(one(any_use.intersect(every), "used")).crossJoin(one(in_all.intersect(every), "used_everywhere")).crossJoin(one(every.subtract(any_use), "unused")).crossJoin(one(any_use.subtract(every), "unknown"))
    return Report({"summary": t.withColumn("pct", share(F.col("used"), F.col("catalogue"), 3)), "unused": every.subtract(any_use)})


def usage_report(catalogue: DataFrame, key: str, label: str, used: dict[str, tuple[DataFrame, str]], top: int = 20) -> Report:
    """Rows of several tables for each id, also of ids that only one of them has."""
    parts = [t.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("id")).agg(F.count("*").alias(name)) for name, (t, k) in used.items()]
    out = reduce(lambda a, b: a.join(b, "id", "full"), parts).fillna(0)
    out = out.withColumn("total", sum((F.col(n) for n in used), F.lit(0)))
    out = out.join(catalogue.select(F.col(key).alias("id"), F.col(label).alias("label")), "id", "left")
    return Report({"usage": out, "summary": summary(out, "total", low=False), "top": out.orderBy(F.col("total").desc(), "id").limit(top)})


# --- Whole tables ---


def table_quality(tables: dict[str, DataFrame]) -> DataFrame:
    """For each table: rows, columns, missing cells, and rows that repeat another."""
    out = []
    for name, df in tables.items():
        per_row = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0))
        rows = df.withColumn("_missing", per_row).groupBy(*(f"`{c}`" for c in df.columns)).agg(F.count("*").alias("_n"), F.first("_missing").alias("_m"))
        out.append(rows.agg(F.lit(name).alias("table_name"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0)).cast("long").alias("missing_cells"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")))
    return _union(out)


def integrity_report(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows whose foreign key the parent lacks; a null key is a violation."""
    out = []
    for name, child, key, parent, parent_key in relations:
        bad = child.select(F.col(key).alias("_c")).join(parent.select(F.col(parent_key).alias("_p")), F.col("_c") == F.col("_p"), "left_anti")
        out.append(bad.agg(F.lit(name).alias("relation"), F.count("*").alias("violations")))
    return _union(out)


def overview(df: DataFrame, ids: set[str] = frozenset()) -> DataFrame:
    """For each column: type, group (numeric, id-like, non-numeric), missing, n_unique, and
    mean, std, min and max of numeric columns that aren't ids. One pass over df."""
    rows = df.agg(F.count("*").alias("_n"), *(x for k, f in enumerate(df.schema.fields) for x in _column_aggs(k, f, ids)))
    out = []
    for k, f in enumerate(df.schema.fields):
        numeric = isinstance(f.dataType, T.NumericType)
        group = "id-like" if f.name in ids or f.name.lower().endswith("id") else "numeric" if numeric else "non-numeric"
        stats = [F.col(f"_{s}{k}").alias(s) if group == "numeric" else F.lit(None).cast("double").alias(s) for s in ("mean", "std", "lo", "hi")]
        out.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(group).alias("type_group"), (F.col("_n") - F.col(f"_seen{k}")).alias("missing"), share(F.col("_n") - F.col(f"_seen{k}"), F.col("_n"), 4).alias("missing_pct"), F.col(f"_unique{k}").alias("n_unique"), *stats))
    return rows.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def _column_aggs(k: int, f: T.StructField, ids) -> list[Column]:
    c = F.col(f"`{f.name}`")
    out = [F.count(c).alias(f"_seen{k}"), F.count_distinct(c).alias(f"_unique{k}")]
    if isinstance(f.dataType, T.NumericType) and f.name not in ids and not f.name.lower().endswith("id"):
        out += [F.avg(c).alias(f"_mean{k}"), F.stddev_samp(c).alias(f"_std{k}"), F.min(c).cast("double").alias(f"_lo{k}"), F.max(c).cast("double").alias(f"_hi{k}")]
    return out


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls of each column (of `columns`), with their share of the rows."""
    columns = columns or df.columns
    counts = df.agg(F.count("*").alias("_n"), *((F.count("*") - F.count(f"`{c}`")).alias(c) for c in columns))
    out = counts.unpivot(["_n"], columns, "column_name", "missing")
    return out.select("column_name", "missing", share(F.col("missing"), F.col("_n"), 4).alias("missing_pct"))


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def identifier_report(df: DataFrame, id_col: str, title: str, year: str) -> DataFrame:
    return metrics(df.agg(F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct(F.struct(*df.columns))).alias("duplicate_rows"), repeats(df, [id_col]).alias("duplicate_ids"), repeats(df, [title, year]).alias("duplicate_title_year"), F.count_distinct(id_col).alias("unique_ids")))


def year_report(df: DataFrame, year: str, low: int = 1800, high: int = 2026) -> Report:
    y = to_number(F.col(year))
    t = df.withColumn("_y", y)
    one = t.agg(F.count("*").alias("n_rows"), F.count_if(F.col("_y").isNull()).alias("missing"), F.min("_y").alias("min"), F.percentile("_y", 0.5).alias("median"), F.percentile("_y", 0.9).alias("p90"), F.percentile("_y", 0.99).alias("p99"), F.max("_y").alias("max"), F.count_if(F.col("_y") <= low).alias("too_early"), F.count_if(F.col("_y") > high).alias("too_late"))
    return Report({"summary": metrics(one), "by_year": t.where("_y IS NOT NULL").groupBy(F.col("_y").cast("int").alias("year")).agg(F.count("*").alias("n"))})


def text_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each text column: missing, empty and one-character values."""
    return _union([df.agg(F.lit(c).alias("column_name"), *(F.count_if(F.coalesce(m, F.lit(False))).alias(n) for n, m in text_masks(c, 1, digits=False).items())) for c in columns])


# --- Values, time, activity ---


def value_report(df: DataFrame, column: str) -> Report:
    """summary and value counts of a numeric column."""
    return Report({"summary": summary(df, column), "counts": df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))})


def time_report(df: DataFrame, ts: Column | None = None) -> Report:
    """First and last event, events without a valid time, and events by year. ts defaults to
    the six date parts, where bad parts give no time."""
    t = df.select((event_time(strict=False) if ts is None else ts).alias("_t"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    one = t.agg(F.count("*").alias("n"), F.count_if(F.col("_t").isNull()).alias("invalid"), text(F.min("_t")).alias("first"), text(F.max("_t")).alias("last"))
    return Report({"summary": one, "by_year": t.where("_t IS NOT NULL").groupBy(F.year("_t").alias("year")).agg(F.count("*").alias("n"))})


def activity_report(df: DataFrame, user: str, item: str) -> Report:
    """users, items, interactions, density and sparsity of the user-item table (no rows:
    sparsity 1), with the distributions of rows for each user and item."""
    one = df.agg(F.count_distinct(user).alias("users"), F.count_distinct(item).alias("items"), F.count("*").alias("interactions"))
    density = F.coalesce(F.try_divide(F.col("interactions").cast("double"), F.col("users") * F.col("items")), F.lit(0.0))
    one = one.withColumn("density", F.round(density, 6)).withColumn("sparsity", F.round(1 - density, 6))
    return Report({"summary": metrics(one), "per_user": summary(group_sizes(df, user), "n"), "per_item": summary(group_sizes(df, item), "n")})


def location_depth_report(df: DataFrame, levels: list[str]) -> Report:
    """Known levels of each row, rows without any left out: summary and counts."""
    d = df.select(sum((F.col(c).isNotNull().cast("int") for c in levels), F.lit(0)).alias("depth")).where("depth > 0")
    return Report({"summary": summary(d, "depth"), "counts": d.groupBy("depth").agg(F.count("*").alias("n"))})


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Rows in each bin of given edges; the last bin is closed, others are open above."""
    c = F.col(column)
    bin_ = F.when(c == edges[-1], len(edges) - 2)
    for k in range(len(edges) - 1):
        bin_ = bin_.when((c >= edges[k]) & (c < edges[k + 1]), k)
    return df.select(bin_.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def equal_width_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """As histogram, from the least to the greatest value: the bounds are a one-row table."""
    b = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    c = F.col(column).cast("double")
    k = F.least(F.floor(F.coalesce(F.try_divide((c - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0))), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(b)).groupBy(k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ends(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first and the last n rows by a unique column."""
    return df.orderBy(F.col(order)).limit(n).unionByName(df.orderBy(F.col(order).desc()).limit(n))
