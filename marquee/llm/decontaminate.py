"""Benchmark decontamination by winnowing.

A text's fingerprints are the least hashes of GRAM-word grams in each sliding window of
SPAN - GRAM + 1 grams. Whatever a document and an item share over SPAN words has such a window
in both, so both keep the same fingerprint from it: no shared span of that length is missed.
Documents and items meet in a join of fingerprints; a hit is then extended to the windows of
SPAN words around it, which must equal a window of an item word by word. Items of fewer words
are one window each and are looked up by the grams of their own length, all of them kept.

The main path is DataFrame functions. A document passes through it in one scan: its words are
fingerprinted within its row, and only the fingerprints, and a row for its length, go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import ALNUM_GAP, ascii_lower, materialise, private, word_array

SPAN, GRAM = 10, 5
#: Rows of item fingerprints or windows up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: A fingerprint is a 32-bit hash above a 31-bit position, so the least one is the leftmost.
POSITION = (1 << 31) - 1
FILTER_BITS = 1 << 20


def words_of(text: Column) -> Column:
    return word_array(ascii_lower(text), ALNUM_GAP)


def _gram_hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.slice(words, at + 1, n))


def _packed(words: Column, size: Column, gram: int) -> Column:
    """(hash << 31 | position) of each gram; words must have gram words at least."""
    return F.transform(F.sequence(F.lit(0), size - gram), lambda i: F.shiftleft(F.shiftrightunsigned(_gram_hash(words, i, gram), 32), 31).bitwiseOR(i.cast("long")))


def _winnow(packed: Column, width: int) -> Column:
    """The fingerprints of a text: the least of each window of `width` grams."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(packed) - width + 1), lambda i: F.array_min(F.slice(packed, i, width))))


def _fingerprints(df: DataFrame, span: int, gram: int) -> DataFrame:
    """Adds prints: fingerprints of rows of span words or more, else an empty array."""
    none = F.array().cast("array<long>")
    df = df.withColumn("packed", F.when(F.col("n") >= span, _packed(F.col("words"), F.col("n"), gram)).otherwise(none))
    return df.withColumn("prints", F.when(F.size("packed") > 0, _winnow(F.col("packed"), span - gram + 1)).otherwise(none)).drop("packed")


def _bitmap(prints: DataFrame) -> Column:
    """A literal of FILTER_BITS bits, set where the low bits of some item fingerprint point.
    Of a document's fingerprints, only those whose bit is set get a context and go to the
    join: no match is lost, and with ever more items the filter only passes more."""
    low = prints.select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int").alias("b")).distinct()
    cells = [0] * (FILTER_BITS // 32)
    for (b,) in low.collect():
        cells[b >> 5] |= 1 << (b & 31)
    return F.expr("array(" + ",".join(f"{c}L" for c in cells) + ")")


def _passes(bitmap: Column, packed: Column) -> Column:
    b = F.shiftright(packed, 31).bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int")
    return F.get(bitmap, F.shiftright(b, 5)).bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(32))), b.bitwiseAND(F.lit(31)) + 1)) != 0


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast where its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """A row for each row of docs: its id, n_words, n_hit (words inside an occurrence of an
    item's window), spans (start and end, in words, of the maximal hit runs), items (ids of
    items with occurring windows, as sorted strings), and the columns of `carry`.

    Null texts have no words. An item without words has no window; an item id of null counts
    for hits but is not listed. Rows that repeat a document id are judged on their own;
    equal item ids count once. An empty table of items leaves every document clean. Other
    columns of either table are not read."""
    it = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    it = materialise(it, "items")
    one = F.when(F.col("n") < span, F.array(F.struct(F.col("n").alias("m"), F.array_join("words", " ").alias("window"))))
    every = F.transform(F.sequence(F.lit(1), F.col("n") - span + 1), lambda i: F.struct(F.lit(span).alias("m"), F.array_join(F.slice("words", i, span), " ").alias("window")))
    windows = it.select("item", F.explode(F.when(F.col("n") < span, one).otherwise(every)).alias("w"))
    windows = materialise(windows.groupBy("w.m", "w.window").agg(F.array_sort(F.collect_set("item")).alias("items")), "itemwindows")
    lengths = sorted(r.m for r in windows.where(F.col("m") < span).select("m").distinct().collect())
    long_prints = _fingerprints(it, span, gram).select(F.lit(span).alias("m"), F.explode("prints").alias("p")).select("m", F.shiftright("p", 31).alias("h"))
    short = windows.where(F.col("m") < span).withColumn("w", F.split("window", " "))
    for m in lengths:
        long_prints = long_prints.union(short.where(F.col("m") == m).select("m", F.shiftrightunsigned(_gram_hash(F.col("w"), F.lit(0), m), 32)))
    prints = materialise(long_prints.distinct(), "itemprints")
    bitmap = _bitmap(prints)

    carried = [c.alias(f"carry{i}") for i, c in enumerate(carry)]
    names = [f"carry{i}" for i in range(len(carry))]
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"), *carried)
    d = _fingerprints(d.withColumn("n", F.size("words")), span, gram)
    # An element of `sent`: m (0: the document itself, its length in start), hash, the first
    # word of the context, and the context in which the hit can be extended.
    element = lambda m, h, start, context: F.struct(F.lit(m).alias("m"), h.alias("h"), start.cast("int").alias("start"), context.alias("context"))

    def of_print(p):
        start = F.greatest(p.bitwiseAND(F.lit(POSITION)).cast("int") - (span - gram), F.lit(0))
        return element(span, F.shiftright(p, 31), start, F.array_join(F.slice("words", start + 1, 2 * span - gram), " "))

    def of_gram(m: int):
        at = lambda p: p.bitwiseAND(F.lit(POSITION))
        return lambda p: element(m, F.shiftright(p, 31), at(p), F.array_join(F.slice("words", at(p).cast("int") + 1, m), " "))

    sent = [F.array(element(0, F.lit(0).cast("long"), F.col("n"), F.lit(None).cast("string"))), F.transform(F.filter("prints", lambda p: _passes(bitmap, p)), of_print)]
    for m in lengths:
        sent.append(F.when(F.col("n") >= m, F.transform(F.filter(_packed(F.col("words"), F.col("n"), m), lambda p: _passes(bitmap, p)), of_gram(m))).otherwise(F.array().cast("array<struct<m:int,h:bigint,start:int,context:string>>")))
    # explode_outer, as for explode() the optimizer adds a filter that computes the array again.
    d = d.select("row", "id", *names, F.explode_outer(F.concat(*sent)).alias("e")).select("row", "id", *names, "e.*")
    found = d.join(_small(prints.withColumn("hit", F.lit(True))), ["m", "h"], "left").where((F.col("m") == 0) | F.col("hit"))
    # The windows around a hit: in a context of c words, those that begin at 0 to c - span.
    found = found.withColumn("context", F.split("context", " "))
    around = F.transform(F.sequence(F.lit(0), F.size("context") - F.col("m")), lambda i: F.struct((F.col("start") + i).alias("start"), F.array_join(F.slice("context", i + 1, F.col("m")), " ").alias("window")))
    found = found.withColumn("w", F.when(F.col("m") == 0, F.array(F.struct(F.col("start"), F.lit(None).cast("string").alias("window")))).otherwise(around))
    found = found.select("row", "id", *names, "m", F.explode_outer("w").alias("w")).select("row", "id", *names, "m", "w.*")
    found = found.join(_small(windows), ["m", "window"], "left").where((F.col("m") == 0) | F.col("items").isNotNull())
    doc = F.col("m") == 0
    out = found.groupBy("row", "id").agg(F.max(F.when(doc, F.col("start"))).alias("n"), F.array_sort(F.collect_set(F.when(~doc, F.struct("start", "m")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), *(F.max(F.when(doc, F.col(c))).alias(c) for c in names))
    # Windows in order of their start are folded into runs.
    run = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def fold(runs, h):
        last = F.element_at(runs, -1)
        joins = (F.size(runs) > 0) & (h["start"] <= F.try_element_at(runs, F.lit(-1))["end"])
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(run(last["start"], F.greatest(last["end"], h["start"] + h["m"]))))
        return F.when(joins, grown).otherwise(F.concat(runs, F.array(run(h["start"], h["start"] + h["m"]))))

    out = out.withColumn("spans", F.aggregate("hits", empty, fold))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), "spans", "items", *names)


def clean_documents(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that have no word inside an item's window.

    Whether a row is contaminated is decided by its text alone, so rows leave by the digest
    of their text: ids may repeat or be null, null and empty texts stay, and rows that repeat
    stay or go together. Without items all rows stay. The digests of contaminated texts are broadcast
    where they are few, else the rows meet them in a shuffled join."""
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    bad = contamination(docs, items, span, gram, id_col, text_col, item_col, item_text_col, (digest,))
    of_bad = private("digest")
    bad = materialise(bad.where("n_hit > 0").select(F.col("carry0").alias(of_bad)).distinct(), "contaminated")
    return docs.join(_small(bad), digest == F.col(of_bad), "left_anti")
