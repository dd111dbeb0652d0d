"""The best items of many queries by inner product: blocks of queries meet blocks of items."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block, numbers of a block of items and of a task's items, blocks of queries that a task holds.
QUERY_ROWS, BLOCK_NUMBERS, TASK_NUMBERS, HELD = 512, 1 << 16, 1 << 21, 64


def best_products(queries: DataFrame, items: DataFrame, n: int, key: str, item: str, query: str, vector: str, base: str | None = None, seen: str | None = None, value: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """key, item, score and rank of the n items of largest score for each query, of equals the
    least item. The score is base plus the product of the vectors, summed in their order, passed
    through `value` if given (a function that never falls). Items in the list `seen` are left
    out; a product with a null in it is null and ranks last.

    A block's scores are one matrix product, which only tells what can't be among the best n:
    the rest is summed exactly. Every pair is looked at; a task sends its best only."""
    size = items.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    parts = max(1, -(-size.n * max(1, size.d or 1) // TASK_NUMBERS))
    spark = items.sparkSession
    key_type, item_type = queries.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    double = lambda c: F.col(c).cast("array<double>")
    no = F.array().cast(f"array<{item_type}>")
    s = F.coalesce(F.array_compact(F.col(seen).cast(f"array<{item_type}>")), no) if seen else no
    q = queries.select(F.col(key).alias("k"), double(query).alias("v"), (F.col(base).cast("double") if base else F.lit(0.0)).alias("b"), s.alias("s"))
    q = q.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_query_blocks(QUERY_ROWS), f"q_id string, q_keys array<{key_type}>, q binary, q_base binary, q_seen array<{item_type}>, q_ends binary")
    i = items.select(F.col(item).alias("i"), double(vector).alias("v")).where("i IS NOT NULL").repartition(parts).mapInArrow(_item_blocks(BLOCK_NUMBERS), f"i_keys array<{item_type}>, i binary")
    best = q.crossJoin(i).mapInArrow(_searcher(n, value or (lambda x: x), key, item, HELD), f"`{key}` {key_type}, `{item}` {item_type}, score double")
    w = Window.partitionBy(key).orderBy(F.col("score").desc_nulls_last(), item)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _matrix(column) -> np.ndarray:
    """Rows of a list column; what is null or lacking is NaN."""
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    out = np.full((len(column), int(sizes.max(initial=0))), np.nan)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _one_row(**columns) -> pa.RecordBatch:
    whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if isinstance(v, pa.Array) else pa.array([v])
    return pa.RecordBatch.from_arrays([whole(v) for v in columns.values()], list(columns))


def _query_blocks(size: int):
    def pack(batches):
        for b in batches:
            for p in (b.slice(at, size) for at in range(0, b.num_rows, size)):
                k, v, base, seen = p.columns
                ends = np.cumsum(np.asarray(seen.value_lengths()), dtype=np.int64)
                yield _one_row(q_id=uuid.uuid4().hex, q_keys=k, q=_matrix(v).tobytes(), q_base=base.to_numpy(zero_copy_only=False).astype(float).tobytes(), q_seen=seen.flatten(), q_ends=ends.tobytes())

    return pack


def _item_blocks(numbers: int):
    def pack(batches):
        for b in batches:
            rows = max(1, numbers // max(1, pc.max(pc.list_value_length(b.column(1))).as_py() or 1))
            for at in range(0, b.num_rows, rows):
                p = b.slice(at, rows)
                p = p.take(pc.sort_indices(p.column(0)))
                yield _one_row(i_keys=p.column(0), i=_matrix(p.column(1)).tobytes())

    return pack


def _keys(values) -> np.ndarray:
    a = values.to_numpy(zero_copy_only=False)
    return a.astype(str) if a.dtype == object else a


def _searcher(n: int, value, key: str, item: str, most: int):
    def found(best):
        items = pa.array(best.items.tolist(), best.item_type)
        return pa.RecordBatch.from_arrays([best.keys.take(pa.array(best.rows)), items, pa.array(best.scores, from_pandas=True)], [key, item, "score"])

    def search(batches):
        held: dict[str, _Best] = {}
        for b in batches:
            for r in range(b.num_rows):
                x = {c: b.column(c)[r] for c in b.schema.names}
                name = x["q_id"].as_py()
                if name not in held:
                    if len(held) == most:
                        yield from map(found, held.values())
                        held.clear()
                    held[name] = _Best(n, value, x)
                held[name].meet(x["i_keys"].values, x["i"])
        yield from map(found, held.values())

    return search


class _Best:
    """The best n items so far of each query of a block."""

    def __init__(self, n: int, value, x):
        self.n, self.value = n, value
        self.keys, self.item_type = pa.concat_arrays([x["q_keys"].values]), x["i_keys"].values.type
        self.count = len(self.keys)
        q, self.base = (np.frombuffer(x[c].as_py()) for c in ("q", "q_base"))
        q = q.reshape(self.count, -1)
        self.unknown = np.isnan(q).any(1) | np.isnan(self.base)
        self.q, self.base = np.nan_to_num(q), np.nan_to_num(self.base)
        self.length = np.sqrt((self.q**2).sum(1))
        self.seen, self.seen_row = _keys(x["q_seen"].values), np.repeat(np.arange(self.count), np.diff(np.frombuffer(x["q_ends"].as_py(), np.int64), prepend=0))
        self.rows, self.items, self.scores = np.zeros(0, np.int64), _keys(x["i_keys"].values)[:0], np.zeros(0)
        self.least = np.full(self.count, -np.inf)  # what a query's best n reach

    def meet(self, keys, vectors) -> None:
        ids = _keys(keys)
        v = np.frombuffer(vectors.as_py()).reshape(len(ids), -1)
        wide = min(v.shape[1], self.q.shape[1])
        unknown = np.isnan(v).any(1) | (v.shape[1] != self.q.shape[1])
        v = np.nan_to_num(v)
        # More than what another order of summing can change.
        slack = (wide + 4) * 1e-15 * (self.length * np.sqrt((v**2).sum(1).max(initial=0.0)) + np.abs(self.base))
        bound = self.q[:, :wide] @ v[:, :wide].T + (self.base + slack)[:, None]
        null = self.unknown[:, None] | unknown[None, :]
        away = np.zeros(bound.shape, bool)
        if len(self.seen):
            at = np.minimum(np.searchsorted(ids, self.seen), len(ids) - 1)
            hit = ids[at] == self.seen
            away[self.seen_row[hit], at[hit]] = True
        out = null | away
        bound[out] = -np.inf
        new = np.flatnonzero(np.isneginf(self.least))
        if len(new) and len(ids) >= self.n:
            cut = np.partition(bound[new], len(ids) - self.n, axis=1)[:, len(ids) - self.n]
            self.least[new] = np.where(np.isneginf(cut), -np.inf, self.value(cut - 2.5 * slack[new]))
        keep = ((self.value(bound) >= self.least[:, None]) & ~out) | (null & ~away & np.isneginf(self.least)[:, None])
        row, at = np.nonzero(keep)
        if not len(row):
            return
        exact = np.zeros(len(row))
        for d in range(wide):
            exact += self.q[row, d] * v[at, d]
        exact = self.value(self.base[row] + exact)
        exact[null[row, at]] = np.nan
        row, item, score = np.r_[self.rows, row], np.concatenate([self.items, ids[at]]), np.r_[self.scores, exact]
        order = np.lexsort((item, np.where(np.isnan(score), np.inf, -score), row))
        row, item, score = row[order], item[order], score[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < self.n
        self.rows, self.items, self.scores = row[top], item[top], score[top]
        full = np.bincount(self.rows, minlength=self.count) == self.n
        low = np.full(self.count, np.inf)
        np.minimum.at(low, self.rows, np.where(np.isnan(self.scores), -np.inf, self.scores))
        self.least = np.where(full, np.maximum(self.least, low), self.least)
