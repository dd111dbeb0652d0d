"""Recommenders: popularity, baselines, truncated SVD, matrix factorisation; splits, errors."""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.scalars import clip, dot, half_star
from marquee.operators.checks import require_columns
from marquee.operators.search import best_products

# --- Splits and samples ---


def temporal_split(df: DataFrame, order: list[str], fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The first floor(n * (1 - fraction)) rows in order, and the rest.

    `order` must tell all rows apart. A range-partitioned sort gives each row its place within
    its partition; the only thing collected is the number of rows of each partition."""
    spark = df.sparkSession
    s = df.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order)
    s = s.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    s = s.persist()
    sizes = {r[0]: r[1] for r in s.groupBy("_part").agg(F.count("*")).collect()}
    cut, before, rows = int(sum(sizes.values()) * (1 - fraction) + 1e-9), 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    s = s.join(F.broadcast(spark.createDataFrame(rows, "_part int, _before long")), "_part")
    first = (F.col("_before") + F.col("_at")) < cut
    drop = lambda x: x.drop("_part", "_at", "_before")
    return drop(s.where(first)), drop(s.where(~first))


def last_of_each(df: DataFrame, key: str, order: list[str], fraction: float = 0.2, least: int = 5) -> DataFrame:
    """df with held_out: the last max(1, floor(n * fraction)) rows of each key; keys of fewer
    than `least` rows are left out."""
    w = Window.partitionBy(key)
    x = df.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(*order))).where(F.col("_n") >= least)
    n_test = F.greatest(F.lit(1), F.floor(F.round(F.col("_n") * fraction, 9)))
    return x.withColumn("held_out", F.col("_k") > F.col("_n") - n_test).drop("_n", "_k")


def stratified_split(df: DataFrame, strata: str, ids: list[str], fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """df with held_out: of each stratum the ceil(fraction * n) rows of least hash."""
    w = Window.partitionBy(strata)
    x = df.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), strata, *ids), *ids)))
    return x.withColumn("held_out", F.col("_k") <= F.ceil(F.col("_n") * fraction)).drop("_n", "_k")


def sample(df: DataFrame, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows by the hash of their ids: the same for every run of a seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *ids), *ids).limit(n)


def newest(df: DataFrame, ts: str, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), *ties).limit(n)


# --- Errors ---


def errors(scored: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """rmse, mae and n over rows with a prediction; `by` groups them."""
    e = F.col(predicted) - F.col(actual)
    known = scored.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    return known.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))


# --- Popularity ---


@dataclass
class Popularity:
    """Means shrunk towards the mean of all items' means: v/(v+m) * R + m/(v+m) * C."""

    min_votes: int = 50
    top_n: int = 10
    pool_size: int | None = None
    item: str = "movieID"
    ranked: DataFrame | None = None

    def fit(self, features: DataFrame, metadata: DataFrame) -> Popularity:
        require_columns(features, self.item, "movie_avg_rating", "movie_rating_count")
        require_columns(metadata, self.item, "title")
        m = F.lit(float(self.min_votes))
        v = F.col("movie_rating_count")
        mean = features.agg(F.avg("movie_avg_rating").alias("_c"))
        q = features.select(self.item, "movie_avg_rating", "movie_rating_count").where(v >= self.min_votes).crossJoin(F.broadcast(mean))
        q = q.withColumn("weighted_rating", v / (v + m) * F.col("movie_avg_rating") + m / (v + m) * F.col("_c")).drop("_c")
        self.ranked = q.join(metadata.select(self.item, "title"), self.item, "left")
        return self

    def recommend(self, top_n: int | None = None, random_state: int | None = None) -> DataFrame:
        """The best top_n; with pool_size or random_state, top_n of the pool by hash."""
        if self.ranked is None:
            raise ValueError("fit the recommender first")
        n, order = top_n or self.top_n, (F.col("weighted_rating").desc(), F.col(self.item))
        if self.pool_size is None:
            return self.ranked.orderBy(*order).limit(n)
        pool = self.ranked.orderBy(*order).limit(self.pool_size)
        return sample(pool, [self.item], n, random_state or 0).orderBy(*order)

    def recommend_one(self, pool_size: int = 100, random_state: int | None = None) -> DataFrame:
        if self.ranked is None:
            raise ValueError("fit the recommender first")
        pool = self.ranked.orderBy(F.col("weighted_rating").desc(), F.col(self.item)).limit(pool_size)
        return sample(pool, [self.item], 1, random_state or 0)


# --- Baselines ---


def baselines(train: DataFrame, test: DataFrame, user: str = "userID", item: str = "movieID", rating: str = "rating") -> DataFrame:
    """Test rows with the predictions global, item, user and blend (half of each); an unknown
    user or item gets the global mean."""
    g = train.agg(F.avg(rating).alias("global"))
    u = train.groupBy(user).agg(F.avg(rating).alias("_u"))
    i = train.groupBy(item).agg(F.avg(rating).alias("_i"))
    x = test.join(u, user, "left").join(i, item, "left").crossJoin(F.broadcast(g))
    x = x.withColumn("item", F.coalesce("_i", "global")).withColumn("user", F.coalesce("_u", "global"))
    return x.withColumn("blend", 0.5 * F.col("user") + 0.5 * F.col("item")).drop("_u", "_i")


def compare(scored: DataFrame, models: list[str], actual: str = "rating") -> DataFrame:
    """rmse and mae of each column of predictions, in one pass."""
    e = lambda m: F.col(m) - F.col(actual)
    one = scored.agg(*(x for m in models for x in (F.sqrt(F.avg(e(m) * e(m))).alias(f"{m}_rmse"), F.avg(F.abs(e(m))).alias(f"{m}_mae"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"{m}_rmse").alias("rmse"), F.col(f"{m}_mae").alias("mae")) for m in models))).alias("x")).select("x.*")


# --- Truncated SVD ---


#: Ratings of a block of users, at most (but for one user's).
SVD_CELLS = 4_000_000
#: Ratings that are packed at a time, as a worker holds them several times meanwhile.
SVD_BLOCK = 500_000
#: Tasks of a product with the matrix, at most.
SVD_TASKS = 8
#: Numbers of a vector that reach the driver as one result: so small that it comes with the
#: task's message. Products after which the driver lets go of their shuffle files and buffers.
SVD_PIECE, SVD_FREE = 64_000, 8


def top_eigenvectors(product, n: int, k: int, tol: float = 1e-10, restarts: int = 300, seed: int = 0) -> np.ndarray:
    """n x k: eigenvectors of the k largest eigenvalues of a symmetric matrix without negative
    ones, given by its product with a vector. Lanczos with thick restarts: 2 k + 2 vectors of n
    (more for a small k) are held. Of vectors of one eigenvalue it may find fewer than there are
    and go on with the next value, as other methods of one vector do (ARPACK)."""
    rng = np.random.default_rng(seed)
    m = min(n, max(2 * k + 1, 20))
    q, t, at = np.zeros((m + 1, n)), np.zeros((m, m)), 0

    def fresh(j: int) -> np.ndarray:
        w = rng.standard_normal(n)
        for _ in range(2):
            w -= (q[:j] @ w) @ q[:j]
        return w / np.linalg.norm(w)

    q[0] = fresh(0)
    for _ in range(restarts):
        for j in range(at, m):
            w, h = product(q[j]), np.zeros(j + 1)
            size = np.linalg.norm(w)
            for _ in range(2):
                g = q[: j + 1] @ w
                w = w - g @ q[: j + 1]
                h += g
            t[: j + 1, j] = t[j, : j + 1] = h
            rest = np.linalg.norm(w)
            if rest > 1e-13 * max(size, np.abs(t).max()):
                q[j + 1] = w / rest
            else:  # what was reached is closed: go on elsewhere
                rest = 0.0
                q[j + 1] = fresh(j + 1) if j + 1 < n else 0.0
        values, s = np.linalg.eigh(t)
        values, s = values[::-1], s[:, ::-1]
        done = m == n or (rest * np.abs(s[-1, :k])).max() <= tol * max(values[0], 1e-300)
        p = k if done else k + (m - k) // 2
        for c in range(0, n, 1 << 16):
            q[:p, c : c + (1 << 16)] = s[:, :p].T @ q[:m, c : c + (1 << 16)]
        if done:
            break
        q[p], at = q[m], p
        t[:] = 0.0
        t[range(p), range(p)] = values[:p]
    else:
        raise ValueError("the factors do not converge")
    return np.ascontiguousarray(q[:k].T)


class SVD:
    """Ratings (mean of repeats) less the user's mean, unrated as 0, at rank n_factors.

    The reconstruction is M V V': only V, items x factors, is made; predictions are sums over
    a user's ratings. The dense matrix never exists. Products with M are made by blocks of
    users; beyond one block the
    driver's Python holds 2 n_factors + 2 vectors of a number for each item. Its JVM passes one
    such vector on at a time: products are summed by pieces among the executors."""

    def __init__(self, n_factors: int = 50, clip_to: tuple[float, float] | None = None, to_half_stars: bool = False, user: str = "userID", item: str = "movieID", rating: str = "interaction_rating"):
        self.k, self.clip_to, self.half, self.user, self.item, self.rating = n_factors, clip_to, to_half_stars, user, item, rating

    def fit(self, interactions: DataFrame) -> SVD:
        require_columns(interactions, self.user, self.item, self.rating, error=ValueError)
        spark = interactions.sparkSession
        sc = spark.sparkContext
        cells = interactions.groupBy(F.col(self.user).alias("u"), F.col(self.item).alias("i")).agg(F.avg(self.rating).alias("r")).persist()
        self.seen = cells
        # A column number for each item: its place among these.
        ids = cells.where("i IS NOT NULL").select(F.col("i").cast("long")).distinct().orderBy("i").toArrow().column(0).to_numpy()
        n_cells, n_users = cells.agg(F.count("*"), F.count_distinct("u")).first()
        width, shared = len(ids), sc.broadcast(ids)
        parts = -(-n_cells // SVD_CELLS)
        parts = 1 if parts < 2 else max(parts, sc.defaultParallelism)
        rated = cells.where("u IS NOT NULL AND i IS NOT NULL").select("u", F.col("i").cast("long").alias("i"), F.col("r").cast("double").alias("r"))
        packed = rated.repartition(parts, "u").sortWithinPartitions("u", "i").mapInArrow(_svd_blocks(shared, min(SVD_CELLS, SVD_BLOCK)), f"users array<{cells.schema['u'].dataType.simpleString()}>, means binary, sizes binary, cols binary, x binary")
        packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
        # Each task sends a vector of all items, by pieces, at each of some hundred products.
        blocks = packed.select("sizes", "cols", "x").rdd.map(_svd_arrays).coalesce(min(parts, SVD_TASKS)).persist(StorageLevel.MEMORY_AND_DISK)

        k = max(1, min(self.k, min(width, n_users) - 1))

        piece, made = SVD_PIECE, 0

        def product(v: np.ndarray) -> np.ndarray:
            nonlocal made
            sent, y = sc.broadcast(v), np.zeros(width)

            def pieces(rows):
                x = _gram_product(rows, sent.value, width)
                return ((at, x[at : at + piece]) for at in range(0, width, piece))

            summed = blocks.mapPartitions(pieces).reduceByKey(np.add, -(-width // piece), lambda at: at // piece)
            for at, x in summed.collect():
                y[at : at + piece] = x
            sent.destroy()
            made += 1
            if made % SVD_FREE == 0:
                del summed
                gc.collect()
                sc._jvm.System.gc()
            return y

        def alone(rows):
            held = list(rows)
            yield top_eigenvectors(lambda v: _gram_product(held, v, width), width, k)

        # What one task can hold is left to one: some hundred products are as many jobs.
        v = blocks.mapPartitions(alone).first() if parts == 1 else top_eigenvectors(product, width, k)
        blocks.unpersist()
        factors = sc.broadcast(v)
        del v
        # Tasks make the rows of this table: the driver's JVM would hold them all.
        pieces = -(-width // piece)
        self.item_factors = spark.range(0, pieces, 1, max(1, pieces)).mapInArrow(_svd_items(shared, factors, piece), "i long, f array<double>")
        self.user_factors = packed.mapInArrow(_svd_users(factors), f"u {cells.schema['u'].dataType.simpleString()}, mean double, f array<double>")
        self.users = self.user_factors.select("u", "mean")
        return self

    def _value(self):
        p = F.col("mean") + dot(F.col("uf"), F.col("f"))
        p = clip(p, *self.clip_to) if self.clip_to else p
        return half_star(p) if self.half else p

    def predict(self, pairs: DataFrame) -> DataFrame:
        """pairs with prediction, null for an unknown user or item."""
        u = self.user_factors.select(F.col("u").alias(self.user), "mean", F.col("f").alias("uf"))
        i = self.item_factors.select(F.col("i").alias(self.item), "f")
        return pairs.join(u, self.user, "left").join(i, self.item, "left").withColumn("prediction", self._value()).drop("mean", "uf", "f")

    def evaluate(self, test: DataFrame) -> DataFrame:
        return errors(self.predict(test), self.rating, "prediction")

    def recommend(self, user_id: int, metadata: DataFrame, top_n: int = 10) -> DataFrame:
        u = self.user_factors.where(F.col("u") == user_id)
        if u.isEmpty():
            raise ValueError(f"user {user_id} is unknown")
        return self.recommend_all(u.select("u"), metadata, top_n).drop(self.user)

    def recommend_all(self, users: DataFrame, metadata: DataFrame, top_n: int = 10) -> DataFrame:
        """The best unseen items of each of the given users (a column u)."""
        u = self.user_factors.join(users, "u", "left_semi").join(self.seen.groupBy("u").agg(F.collect_set("i").alias("_seen")), "u", "left")
        clip_to, half = self.clip_to, self.half

        def value(p):
            p = np.clip(p, *clip_to) if clip_to else p
            return np.round(p * 2) / 2 if half else p

        best = best_products(u, self.item_factors, top_n, "u", "i", "f", "f", base="mean", seen="_seen", value=value)
        return best.select(F.col("u").alias(self.user), F.col("i").alias(self.item), F.col("score").alias("prediction"), "rank").join(metadata.select(self.item, "title"), self.item, "left")


def _svd_blocks(ids, most: int):
    """Rows u, i, r in the order of u as blocks: users, means, and their centred ratings."""

    def block(t):
        u, i, r = (t.column(c) for c in range(3))
        u = u.combine_chunks()
        starts = np.flatnonzero(np.r_[True, pc.not_equal(u.slice(1), u.slice(0, len(u) - 1)).to_numpy(zero_copy_only=False)])
        sizes = np.diff(np.r_[starts, len(u)])
        r = r.to_numpy()
        known = ~np.isnan(r)
        counts = np.add.reduceat(known.astype(float), starts)
        means = np.where(counts > 0, np.add.reduceat(np.where(known, r, 0.0), starts) / np.maximum(counts, 1.0), np.nan)
        x = np.where(known, r - np.repeat(means, sizes), 0.0)
        cols = np.searchsorted(ids.value, i.to_numpy()).astype(np.int32)
        users = u.take(pa.array(starts))
        users = pa.ListArray.from_arrays(pa.array([0, len(users)], pa.int32()), users)
        return pa.RecordBatch.from_arrays([users, *(pa.array([a.tobytes()]) for a in (means, sizes.astype(np.int64), cols, x))], ["users", "means", "sizes", "cols", "x"])

    def pack(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n > most:  # all but the last user, who may go on
                t = pa.Table.from_batches(held)
                last = t.column(0).slice(n - 1).to_pylist()[0]
                cut = n - pc.sum(pc.equal(t.column(0), pa.scalar(last, t.column(0).type))).as_py()
                if cut:
                    yield block(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), n - cut
        if n:
            yield block(pa.Table.from_batches(held))

    return pack


def _gram_product(blocks, v: np.ndarray, width: int) -> np.ndarray:
    y = np.zeros(width)
    for sizes, cols, x in blocks:
        at = np.repeat(np.arange(len(sizes)), sizes)
        y += np.bincount(cols, x * np.bincount(at, x * v[cols], len(sizes))[at], width)
    return y


def _svd_arrays(row) -> tuple:
    return np.frombuffer(row.sizes, np.int64), np.frombuffer(row.cols, np.int32), np.frombuffer(row.x)


def _svd_items(ids, factors, piece: int):
    """Items with their factors, those of a piece for each row."""

    def run(batches):
        for b in batches:
            for at in b.column(0).to_pylist():
                i, v = (x.value[at * piece : (at + 1) * piece] for x in (ids, factors))
                f = pa.FixedSizeListArray.from_arrays(np.ascontiguousarray(v).ravel(), v.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), f.cast(pa.list_(pa.float64()))], names=["i", "f"])

    return run


def _svd_users(factors, rows: int = 10_000):
    """Users with means and factors, the sums of their centred ratings times the items' factors."""

    def project(batches):
        for b in batches:
            for r in range(b.num_rows):
                users, means, sizes, cols, x = (b.column(c)[r] for c in range(5))
                users, means, (sizes, cols, x) = users.values, np.frombuffer(means.as_py()), (np.frombuffer(a.as_py(), t) for a, t in ((sizes, np.int64), (cols, np.int32), (x, float)))
                ends = np.cumsum(sizes)
                for s in range(0, len(sizes), rows):
                    e = min(s + rows, len(sizes))
                    a, z = ends[s] - sizes[s], ends[e - 1]
                    f = np.add.reduceat(factors.value[cols[a:z]] * x[a:z, None], (ends - sizes)[s:e] - a, axis=0)
                    f = pa.FixedSizeListArray.from_arrays(f.ravel(), f.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([users.slice(s, e - s), pa.array(means[s:e], from_pandas=True), f], ["u", "mean", "f"])

    return project


# --- Matrix factorisation ---


class MatrixFactorization:
    """mean + user bias + item bias + factors' product, clipped to the scale.

    Biases are shrunk means of what is left; the factors are alternating least squares on the
    residuals (distributed). exact=True trains by seeded stochastic gradient descent, sample
    by sample, in one task: for data that fit in one."""

    def __init__(self, n_factors: int = 50, learning_rate: float = 0.005, reg: float = 0.02, n_epochs: int = 20, rating_min: float = 0.5, rating_max: float = 5.0, seed: int = 42, exact: bool = False, shrink: float = 5.0, user: str = "userID", item: str = "movieID", rating: str = "interaction_rating"):
        self.k, self.lr, self.reg, self.epochs, self.scale, self.seed, self.exact, self.shrink = n_factors, learning_rate, reg, n_epochs, (rating_min, rating_max), seed, exact, shrink
        self.user, self.item, self.rating = user, item, rating

    def fit(self, interactions: DataFrame) -> MatrixFactorization:
        require_columns(interactions, self.user, self.item, self.rating, error=ValueError)
        x = interactions.select(F.col(self.user).cast("int").alias("u"), F.col(self.item).cast("int").alias("i"), F.col(self.rating).cast("double").alias("r")).dropna().persist()
        self.seen = x.select("u", "i").distinct()
        self.mean = x.agg(F.avg("r")).first()[0]
        (self._fit_exact if self.exact else self._fit_als)(x)
        return self

    def _fit_als(self, x: DataFrame) -> None:
        from pyspark.ml.recommendation import ALS

        shrunk = lambda c, left: F.sum(left) / (F.count("*") + F.lit(self.shrink))
        bi = x.groupBy("i").agg(shrunk("i", F.col("r") - self.mean).alias("bi"))
        y = x.join(bi, "i")
        bu = y.groupBy("u").agg(shrunk("u", F.col("r") - self.mean - F.col("bi")).alias("bu"))
        y = y.join(bu, "u").select("u", "i", (F.col("r") - self.mean - F.col("bi") - F.col("bu")).alias("left"))
        als = ALS(rank=self.k, maxIter=min(self.epochs, 15), regParam=max(self.reg, 0.05), userCol="u", itemCol="i", ratingCol="left", seed=self.seed).fit(y)
        self.users = bu.join(als.userFactors.select(F.col("id").alias("u"), F.col("features").cast("array<double>").alias("p")), "u", "left")
        self.items = bi.join(als.itemFactors.select(F.col("id").alias("i"), F.col("features").cast("array<double>").alias("q")), "i", "left")

    def _fit_exact(self, x: DataFrame) -> None:
        spark = x.sparkSession
        k, lr, reg, epochs, seed, mean = self.k, self.lr, self.reg, self.epochs, self.seed, self.mean

        def train(t):
            rng = np.random.default_rng(seed)
            t = t.sort_values(["u", "i", "r"])
            us, ui = np.unique(t.u, return_inverse=True)
            its, ii = np.unique(t.i, return_inverse=True)
            p, q = rng.normal(0, 1 / np.sqrt(k), (len(us), k)), rng.normal(0, 1 / np.sqrt(k), (len(its), k))
            bu, bi = np.zeros(len(us)), np.zeros(len(its))
            r = t.r.to_numpy()
            for _ in range(epochs):
                for s in rng.permutation(len(r)):
                    a, b = ui[s], ii[s]
                    e = r[s] - (mean + bu[a] + bi[b] + p[a] @ q[b])
                    bu[a] += lr * (e - reg * bu[a])
                    bi[b] += lr * (e - reg * bi[b])
                    p[a], q[b] = p[a] + lr * (e * q[b] - reg * p[a]), q[b] + lr * (e * p[a] - reg * q[b])
            import pandas as pd

            return pd.DataFrame({"kind": ["u"] * len(us) + ["i"] * len(its), "id": [*us, *its], "bias": [*bu, *bi], "f": [*p.tolist(), *q.tolist()]})

        rows = x.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(train, "kind string, id int, bias double, f array<double>").toArrow()
        out = spark.createDataFrame(rows)
        self.users = out.where("kind = 'u'").select(F.col("id").alias("u"), F.col("bias").alias("bu"), F.col("f").alias("p"))
        self.items = out.where("kind = 'i'").select(F.col("id").alias("i"), F.col("bias").alias("bi"), F.col("f").alias("q"))

    def _terms(self, pairs: DataFrame) -> DataFrame:
        u = self.users.select(F.col("u").alias(self.user), "bu", "p")
        i = self.items.select(F.col("i").alias(self.item), "bi", "q")
        return pairs.join(u, self.user, "left").join(i, self.item, "left").withColumn("_products", F.zip_with("p", "q", lambda a, b: a * b))

    def predict(self, pairs: DataFrame) -> DataFrame:
        """pairs with prediction: the mean for an unknown user or item, else clipped."""
        x = self._terms(pairs)
        raw = F.lit(self.mean) + F.col("bu") + F.col("bi") + F.coalesce(dot(F.col("p"), F.col("q")), F.lit(0.0))
        return x.withColumn("prediction", F.coalesce(clip(raw, *self.scale), F.lit(self.mean))).drop("bu", "bi", "p", "q", "_products")

    def evaluate(self, test: DataFrame) -> DataFrame:
        return errors(self.predict(test), self.rating, "prediction")

    def recommend(self, user_id: int, metadata: DataFrame, top_n: int = 10) -> DataFrame:
        if self.users.where(F.col("u") == user_id).isEmpty():
            raise ValueError(f"user {user_id} is unknown")
        seen = self.seen.where(F.col("u") == user_id).select(F.col("i").alias(self.item))
        c = self.items.select(F.col("i").alias(self.item)).join(seen, self.item, "left_anti").withColumn(self.user, F.lit(user_id))
        best = self.predict(c).orderBy(F.col("prediction").desc(), self.item).limit(top_n)
        return best.join(metadata.select(self.item, "title"), self.item, "left").orderBy(F.col("prediction").desc(), self.item)

    # --- Explanations ---

    def decomposition(self, pairs: DataFrame) -> DataFrame:
        """pairs with mean, user_bias, item_bias, products (of each factor) and total, which
        is their sum, not clipped."""
        x = self._terms(pairs)
        total = F.lit(self.mean) + F.col("bu") + F.col("bi") + F.coalesce(F.aggregate("_products", F.lit(0.0), lambda s, v: s + v), F.lit(0.0))
        return x.select(*pairs.columns, F.lit(self.mean).alias("mean"), F.col("bu").alias("user_bias"), F.col("bi").alias("item_bias"), F.col("_products").alias("products"), total.alias("total"))

    def waterfall(self, pairs: DataFrame) -> DataFrame:
        """The terms of a decomposition as rows: term and contribution."""
        d = self.decomposition(pairs)
        fixed = F.array(*(F.struct(F.lit(n).alias("term"), F.col(n).alias("contribution")) for n in ("mean", "user_bias", "item_bias")))
        factors = F.transform("products", lambda v, k: F.struct(F.concat(F.lit("factor_"), k.cast("string")).alias("term"), v.alias("contribution")))
        return d.select(*pairs.columns, F.explode(F.concat(fixed, factors)).alias("x")).select(*pairs.columns, "x.*")

    def top_factors(self, pairs: DataFrame, n: int = 10) -> DataFrame:
        """The n factors of the largest absolute contribution, of each pair."""
        f = self.decomposition(pairs).select(*pairs.columns, F.posexplode("products").alias("factor", "contribution"))
        w = Window.partitionBy(*pairs.columns).orderBy(F.abs("contribution").desc(), "factor")
        return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

    def because_you_rated(self, user_id: int, item_id: int, ratings: DataFrame, n: int = 8) -> DataFrame:
        """The user's rated items of the most similar factors, by cosine."""
        from marquee.functions.scalars import norm

        q = self.items.where(F.col("i") == item_id).select(F.col("q").alias("target"))
        mine = ratings.where((F.col(self.user) == user_id) & (F.col(self.item) != item_id)).join(self.items.select(F.col("i").alias(self.item), "q"), self.item)
        s = dot(F.col("q"), F.col("target")) / (norm(F.col("q"), 0.0) * norm(F.col("target"), 0.0) + 1e-9)
        return mine.crossJoin(F.broadcast(q)).select(self.item, self.rating, s.alias("similarity")).orderBy(F.col("similarity").desc(), self.item).limit(n)
