"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash. Of a source with target t and s words in all, the mix takes every
row floor(t/s) times, and the rows whose hash lies below a threshold once more. The threshold
comes from nested histograms: words by source and the first 12 bits of the hash; then, of the
bucket that crosses the budget alone, by the next 12 bits, and so on, after
which a bucket is one hash value. No row is sorted or moved: each level is one aggregation
with partial sums before its shuffle, and the end is one filter on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import SPACE_GAP, materialise, private, word_array

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
LEVELS, BITS = 5, 12


def row_hash(*cols: Column) -> Column:
    """The first 60 bits of the MD5 of the columns, as a long."""
    text = F.concat_ws("\u0001", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: a row for each source with columns source and source_size. Adds target.

    Targets share the sum of all sizes by weight; none is above cap times its source's size,
    and what is cut off is shared again by weight. With r = cap * size / weight, the sources
    that are cut are those of the least r; prefix sums over r find where the cut ends. The
    only window without partitions runs over one row for each source."""
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*(F.lit(float(w)) for w in weights))
    t = sizes.withColumn("_w", F.element_at(picks, ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    t = t.withColumn("_r", F.lit(cap) * F.col("source_size") / F.col("_w"))
    order = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("_level", (F.sum("source_size").over(every) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(rest))
    t = t.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct(F.col("_r"), F.col("source").isNull(), F.col("source"), F.col("_level")))).over(every)["_level"])
    cut = F.col("_level").isNull() | (F.col("_level") > F.col("_r"))
    return t.select("source", "source_size", F.when(cut, F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("_w") * F.col("_level")).alias("target"))


def _hash_of(id_: Column, source: Column, text: Column) -> Column:
    """A row's place in the mix: by id, source and text, so that rows that share an id, or have
    none, are not all in or all out."""
    return row_hash(id_, source, F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _plan(docs: DataFrame, weights, cap: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with size and hash, and of each source: target, whole passes, hash threshold."""
    h = _hash_of(F.col(id_col), F.col(source_col), F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(word_array(F.col(text_col), SPACE_GAP)).cast("long").alias("size"), h.alias("h"))
    base = materialise(base, "mix")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sums, weights, cap)
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long"))
    #: left: words that the extra, partial pass may still take; floor: the least hash that
    #: is not yet known to be in or out.
    plan = materialise(plan.withColumn("left", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("floor", F.lit(0).cast("long")).withColumn("width", F.lit(1 << (BITS * LEVELS)).cast("long")), "mixplan")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        cut = plan.select("source", "left", "floor", "width")
        # One row for each source: small against the rows, yet never assumed to fit a
        # broadcast; adaptive execution picks that by the measured size.
        inside = base.join(cut, base.source.eqNullSafe(cut.source)).where((F.col("size") > 0) & (F.col("h") >= F.col("floor")) & (F.col("h") < F.col("floor") + F.col("width"))).select(cut.source, "left", "floor", "h", "size")
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        w = Window.partitionBy("source").orderBy("b")
        hist = hist.withColumn("upto", F.sum("words").over(w))
        # The bucket that crosses the budget, with the words of the buckets before it.
        edge = hist.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("b", "words", "upto", "lo", "hi")).alias("e"))
        # A bucket of one hash value is as fine as any: its width is 1 from here on.
        one = F.col("e.lo") == F.col("e.hi")
        edge = edge.select(F.col("source").alias("s2"), F.when(one, F.col("e.lo")).otherwise(F.shiftleft(F.col("e.b"), shift)).alias("edge"), F.when(one, 1).otherwise(1 << shift).alias("wide"), (F.col("e.upto") - F.col("e.words")).alias("before"), F.col("e.words").alias("words"))
        plan = plan.select("source", "source_size", "target", "passes", "left", "floor", "width").join(edge, plan.source.eqNullSafe(edge.s2), "left")
        plan = plan.select("source", "source_size", "target", "passes", (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"), F.coalesce("edge", F.col("floor") + F.col("width")).alias("floor"), F.when(F.col("edge").isNull(), F.lit(0)).otherwise(F.col("wide")).cast("long").alias("width"), F.coalesce("words", F.lit(0)).alias("words"))
        plan = materialise(plan, f"mixplan{level}")
        if plan.where("width > 1").isEmpty():
            break
    # The last bucket is one hash value: it is in where that comes nearer to the target.
    return base, plan.select(F.col("source").alias("s3"), "source_size", "target", "passes", F.when((F.col("width") > 0) & (2 * F.col("left") >= F.col("words")), F.col("floor") + 1).otherwise(F.col("floor")).alias("threshold"))


def _copies(h: Column, cap: int, passes: Column, threshold: Column) -> Column:
    return F.least(passes + F.when((h < threshold) & (passes < cap), 1).otherwise(0), F.lit(cap)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of docs: id, source, size (words), source_size, target, copies (how
    often the mix takes the row) and taken (copies * size).

    Null texts have size 0; null sources are one source, last in order. Rows that agree in id,
    source and text share a hash and are taken together; ids may repeat or be null. Reruns agree, as the hash depends on
    the row alone. An empty table gives no rows; a source without words has target 0."""
    base, plan = _plan(docs, weights, cap, id_col, text_col, source_col)
    out = base.join(plan, base.source.eqNullSafe(plan.s3)).withColumn("copies", _copies(F.col("h"), cap, F.col("passes"), F.col("threshold")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, with their columns and size, target, copies and
    taken. The decision is a function of a row and its source's threshold, so it is made
    while the rows pass. Columns of docs of the new names are replaced."""
    _, plan = _plan(docs, weights, cap, id_col, text_col, source_col)
    names = ("size", "target", "copies", "taken")
    source, target, threshold, passes, copies = (private(n) for n in ("source", "target", "threshold", "passes", "copies"))
    plan = plan.select(F.col("s3").alias(source), F.col("target").alias(target), F.col("threshold").alias(threshold), F.col("passes").alias(passes))
    h, size = _hash_of(F.col(id_col), F.col(source_col), F.col(text_col)), F.size(word_array(F.col(text_col), SPACE_GAP)).cast("long")
    out = docs.join(plan, F.col(source_col).eqNullSafe(F.col(source))).withColumn(copies, _copies(h, cap, F.col(passes), F.col(threshold))).where(F.col(copies) > 0)
    kept = [F.col(c) for c in docs.columns if c not in names]
    return out.select(*kept, size.alias("size"), F.col(target).alias("target"), F.col(copies).alias("copies"), (F.col(copies) * size).alias("taken"))
