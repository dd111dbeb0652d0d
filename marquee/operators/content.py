"""Content-based recommendation: text profiles, TF-IDF, cosine search, evaluation and
explanations. Vectors are columns joined by key; a query row is broadcast, never the corpus."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.scalars import dot
from marquee.operators.models import last_of_each
from marquee.operators.search import best_products

TOKEN = r"(?U)\b\w\w+\b"

# --- Text profiles ---


def joined_texts(df: DataFrame, key: str, text: str, order: list[str], name: str, underscore: bool = True) -> DataFrame:
    """Each key's texts in order, joined with spaces."""
    t = F.replace(F.col(text), F.lit(" "), F.lit("_")) if underscore else F.col(text)
    x = df.where(F.col(text).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, t.alias("_t")))).alias("_l"))
    return x.select(key, F.array_join(F.transform("_l", lambda v: v["_t"]), " ").alias(name))


def first_of_each(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value that isn't null of each key."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def top_of_each(df: DataFrame, key: str, by: str, n: int, ties: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def content_soup(items: DataFrame, genres: DataFrame, directors: DataFrame, actors: DataFrame, tags: DataFrame, item: str = "movieID", order: str = "_row_id", top_tags: int = 10, cast: int = 5) -> DataFrame:
    """Genres twice, director, leading actors and top tags of each item as one text; items
    without any are left out. tags: item, value, weight and the order column."""
    g = joined_texts(genres, item, "genre", [order], "genres")
    d = first_of_each(directors, item, "directorName", order).select(item, F.lower(F.replace("directorName", F.lit(" "), F.lit("_"))).alias("director"))
    a = actors.where(F.col("ranking") <= cast).withColumn("actorName", F.lower("actorName"))
    a = joined_texts(a, item, "actorName", ["ranking", order], "actors")
    t = top_of_each(tags.withColumn("value", F.coalesce("value", F.lit("nan"))), item, "weight", top_tags, [order])
    t = joined_texts(t, item, "value", ["rank"], "tags")
    x = items.join(g, item, "left").join(d, item, "left").join(a, item, "left").join(t, item, "left").fillna("", ["genres", "director", "actors", "tags"])
    soup = F.trim(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("genres", "genres", "director", "actors", "tags"))))
    return x.withColumn("soup", soup).where(F.length("soup") > 0)


def tfidf(docs: DataFrame, id_col: str, text_col: str, vocabulary: int = 2000, pattern: str = TOKEN) -> DataFrame:
    """(id, term, weight), each document of length 1: counts times ln((1+n)/(1+df))+1 over the
    most frequent terms of the corpus (of equals, those first in code point order)."""
    each = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))).alias("term"))
    tf = each.groupBy("id", "term").agg(F.count("*").alias("tf"))
    vocab = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.col("total").desc(), "term").limit(vocabulary)
    n = docs.agg(F.count("*").alias("n"))
    idf = vocab.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return w.join(length, "id").select(F.col("id").alias(id_col), "term", (F.col("w") / F.col("len")).alias("weight"))


def cached(spark, path: str, build) -> DataFrame:
    """The Parquet table at path; built and written there if it doesn't exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def encode(docs: DataFrame, id_col: str, text_col: str, encoder) -> DataFrame:
    """Vectors of length 1 by an encoder: a function that makes, on a worker, a function of a
    list of texts to rows of floats."""
    import pandas as pd

    def run(frames):
        f = encoder()
        for t in frames:
            v = np.asarray(f(t[text_col].fillna("").tolist()), dtype=np.float32).reshape(len(t), -1)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            yield pd.DataFrame({id_col: t[id_col], "embedding": list(v)})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, embedding array<float>")


# --- Search ---


def title_index(items: DataFrame, title: str = "title", order: str = "_row_id") -> DataFrame:
    """The first row of each title."""
    w = Window.partitionBy(title).orderBy(order)
    return items.where(F.col(title).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def suggestions(items: DataFrame, text: str, title: str = "title", n: int = 5, order: str = "_row_id") -> DataFrame:
    """Titles that contain the text, whatever the case; % and _ stand for themselves."""
    return title_index(items, title, order).where(F.contains(F.lower(title), F.lit(text.lower()))).orderBy(order).limit(n).select(title)


def similar(vectors: DataFrame, query_id: int, n: int = 10, id_col: str = "movieID", vector: str = "embedding") -> DataFrame:
    """The n vectors of the largest dot product with the query's, by rank; the first place,
    which is the query's own unless another ties with it, is left out."""
    q = vectors.where(F.col(id_col) == query_id).select(F.col(vector).alias("_q")).limit(1)
    s = vectors.crossJoin(F.broadcast(q)).select(id_col, dot(F.col(vector), F.col("_q")).alias("similarity"))
    best = s.orderBy(F.col("similarity").desc(), (F.col(id_col) == query_id).desc(), F.col(id_col)).limit(n + 1)
    w = Window.orderBy(F.col("similarity").desc(), (F.col(id_col) == query_id).desc(), F.col(id_col))
    return best.withColumn("rank", F.row_number().over(w) - 1).where("rank > 0").withColumn("similarity", F.round("similarity", 4))


def recommendations(title: str, profiles: DataFrame, vectors: DataFrame, n: int = 10, item: str = "movieID") -> DataFrame | None:
    """Items like the first one of a title, or None where no item has it."""
    row = title_index(profiles).where(F.col("title") == title).select(item).first()
    if row is None:
        return None
    return similar(vectors, row[0], n, item).join(profiles, item, "left").orderBy("rank")


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Each key's mean vector, of length 1."""
    x = df.select(key, F.posexplode(vector).alias("at", "v")).groupBy(key, "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    x = x.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("profile"), F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.lit(1e-9)).alias("_length"))
    return x.select(key, F.transform("profile", lambda v: v / F.col("_length")).alias("profile"))


def profile_recommendations(ratings: DataFrame, vectors: DataFrame, users: DataFrame, n: int = 10, least: float = 4.0, exclude: DataFrame | None = None, user: str = "userID", item: str = "movieID", rating: str = "rating") -> DataFrame:
    """The n best items for each of the given users by their liked items' mean vector, less
    what `exclude` (by default all they rated) holds. Users without a liked item get none."""
    mine = ratings.join(users.select(user).distinct(), user, "left_semi")
    liked = mine.where(F.col(rating) >= least).join(vectors, item)
    p = mean_vectors(liked, user)
    seen = (mine if exclude is None else exclude).groupBy(user).agg(F.collect_set(item).alias("_seen"))
    return best_products(p.join(seen, user, "left"), vectors, n, user, item, "profile", "embedding", seen="_seen")


# --- Evaluation ---


def precision_at_k(ratings: DataFrame, vectors: DataFrame, users: DataFrame, k: int = 10, least: float = 4.0, fraction: float = 0.2, order: tuple[str, ...] = ("timestamp",), mask: str = "train", user: str = "userID", item: str = "movieID", rating: str = "rating") -> DataFrame:
    """For each user, the share of k recommendations that are among the last liked items,
    which the profile does not use. mask: what is not recommended, 'train' (the liked items
    of the profile) or 'all' (everything rated, which leaves no hits). Users with fewer than
    five liked items that have vectors have no row."""
    if mask not in ("train", "all"):
        raise ValueError("mask is train or all")
    mine = ratings.join(users.select(user).distinct(), user, "left_semi")
    liked = mine.where(F.col(rating) >= least).join(vectors.select(item), item, "left_semi")
    split = last_of_each(liked, user, [*order], fraction)
    train, test = split.where("NOT held_out"), split.where("held_out").select(user, item).distinct()
    top = profile_recommendations(train, vectors, users, k, least, exclude=train if mask == "train" else mine, user=user, item=item, rating=rating)
    hits = top.join(test, [user, item], "left_semi").groupBy(user).agg(F.count("*").alias("hits"))
    return split.select(user).distinct().join(hits, user, "left").select(user, (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"))


def precision_summary(per_user: DataFrame) -> DataFrame:
    return per_user.agg(F.avg("precision").alias("mean"), F.stddev_pop("precision").alias("std"), F.count("*").alias("users"))


def catalog_coverage(ratings: DataFrame, vectors: DataFrame, users: DataFrame, k: int = 10, least: float = 4.0, user: str = "userID", item: str = "movieID", rating: str = "rating") -> DataFrame:
    """The share of items that some user's best k hold; rated items are not left out."""
    none = ratings.select(user, item).limit(0)
    top = profile_recommendations(ratings, vectors, users, k, least, exclude=none, user=user, item=item, rating=rating)
    return top.agg(F.count_distinct(item).alias("recommended")).crossJoin(vectors.agg(F.count("*").alias("items"))).withColumn("coverage", F.coalesce(F.try_divide(F.col("recommended"), F.col("items")), F.lit(0.0)))


def intra_list_diversity(vectors: DataFrame, item: str = "movieID", vector: str = "embedding") -> DataFrame:
    """1 less the mean similarity of the pairs of a short list; null for fewer than two."""
    return similarity_matrix(vectors, item, vector).where("a < b").agg((1 - F.avg("similarity")).alias("diversity"))


def similarity_matrix(vectors: DataFrame, item: str = "movieID", vector: str = "embedding") -> DataFrame:
    """All pairs of a short list (of chosen titles or recommendations)."""
    a = vectors.select(F.col(item).alias("a"), F.col(vector).alias("_a"))
    b = vectors.select(F.col(item).alias("b"), F.col(vector).alias("_b"))
    return a.crossJoin(F.broadcast(b)).select("a", "b", dot(F.col("_a"), F.col("_b")).alias("similarity"))


# --- Explanations ---


def surrogate_labels(vectors: DataFrame, query_id: int, n: int = 100, with_ties: bool = False, item: str = "movieID") -> DataFrame:
    """item and label: 1 for the n most similar, the query itself left out. with_ties: for all
    at least as similar as the one at place n, the query's own place being 0."""
    q = vectors.where(F.col(item) == query_id).select(F.col("embedding").alias("_q"))
    s = vectors.crossJoin(F.broadcast(q)).select(item, dot(F.col("embedding"), F.col("_q")).alias("similarity"))
    if with_ties:
        cut = s.orderBy(F.col("similarity").desc()).limit(n + 1).agg(F.min("similarity").alias("_cut"))
        return s.crossJoin(F.broadcast(cut)).select(item, (F.col("similarity") >= F.col("_cut")).cast("int").alias("label"))
    top = s.where(F.col(item) != query_id).orderBy(F.col("similarity").desc(), item).limit(n).select(F.col(item).alias("_i"))
    return s.join(F.broadcast(top), s[item] == top._i, "left").select(item, F.col("_i").isNotNull().cast("int").alias("label"))


def token_contributions(weights: DataFrame, a: int, b: int, id_col: str) -> DataFrame:
    """Each common term's share of two documents' cosine: the products sum to it."""
    x = weights.where(F.col(id_col) == a).select("term", F.col("weight").alias("wa"))
    y = weights.where(F.col(id_col) == b).select("term", F.col("weight").alias("wb"))
    return x.join(y, "term").select("term", (F.col("wa") * F.col("wb")).alias("contribution"))


def probability_pair(score: Column) -> Column:
    """[1 - s, s] of a similarity cut to 0 and 1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.array(1 - s, s)


@dataclass
class Surrogate:
    """A random forest over TF-IDF terms that imitates a list of similar items."""

    trees: int = 200
    seed: int = 42
    vocabulary: list[str] = field(default_factory=list)
    model: object = None

    def assemble(self, weights: DataFrame, id_col: str) -> DataFrame:
        """A sparse vector of the vocabulary's terms for each id."""
        from pyspark.ml.functions import array_to_vector

        if not self.vocabulary:
            self.vocabulary = sorted(r.term for r in weights.select("term").distinct().collect())
        at = {t: i for i, t in enumerate(self.vocabulary)}
        width = len(at)
        index = weights.sparkSession.createDataFrame([(t, i) for t, i in at.items()], "term string, at int")
        x = weights.join(F.broadcast(index), "term").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("at", "weight"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
        return x.select(id_col, array_to_vector(dense).alias("features"))

    def fit(self, rows: DataFrame) -> Surrogate:
        from pyspark.ml.classification import RandomForestClassifier

        self.model = RandomForestClassifier(numTrees=self.trees, seed=self.seed, labelCol="label", featuresCol="features").fit(rows)
        # The training summary holds the session, which can't be sent to tasks once a query observed something.
        self.model._java_obj.setSummary(rows.sparkSession.sparkContext._jvm.scala.Option.empty())
        return self

    def importances(self, n: int = 10) -> list[tuple[str, float]]:
        v = self.model.featureImportances.toArray()
        return [(self.vocabulary[i], float(v[i])) for i in np.argsort(-v, kind="stable")[:n]]


def path_contributions(model, rows: DataFrame, features: str = "features") -> DataFrame:
    """For each row, base (the forest's mean probability) and contributions by feature, which
    sum to its probability: along each tree's path, the change of the node's probability goes
    to the feature that was split on."""
    from pyspark.ml.functions import vector_to_array

    forest = [_flat_tree(t._call_java("rootNode")) for t in model.trees]
    import pandas as pd

    def explain(frames):
        for f in frames:
            out = []
            for x in f["_x"]:
                got: dict[int, float] = {}
                base = 0.0
                for nodes in forest:
                    k = 0
                    base += nodes[0][4]
                    while nodes[k][0] >= 0:
                        j, cut, left, right, p = nodes[k]
                        to = left if x[j] <= cut else right
                        got[j] = got.get(j, 0.0) + nodes[to][4] - p
                        k = to
                n = len(forest)
                out.append((base / n, {j: v / n for j, v in got.items()}))
            yield pd.DataFrame({"_id": f["_id"], "base": [o[0] for o in out], "contributions": [o[1] for o in out]})

    id_col = rows.columns[0]
    x = rows.select(F.col(id_col).cast("long").alias("_id"), vector_to_array(features).alias("_x"))
    return x.mapInPandas(explain, "_id long, base double, contributions map<int,double>").withColumnRenamed("_id", id_col)


def _flat_tree(root) -> list[tuple]:
    """A tree's nodes as (feature or -1, threshold, left, right, share of class 1)."""
    nodes: list[tuple] = []

    def walk(n) -> int:
        k = len(nodes)
        nodes.append(())
        stats = [float(v) for v in n.impurityStats().stats()]
        p = stats[1] / (sum(stats) or 1.0)
        if n.getClass().getSimpleName() == "LeafNode":
            nodes[k] = (-1, 0.0, 0, 0, p)
        else:
            nodes[k] = (n.split().featureIndex(), n.split().threshold(), walk(n.leftChild()), walk(n.rightChild()), p)
        return k

    walk(root)
    return nodes


def local_text_explanation(spark, text: str, score, n_samples: int = 150, n_terms: int = 10, seed: int = 42) -> list[tuple[str, float]]:
    """Weights of a text's tokens in a local linear model: random subsets of the tokens are
    scored (score: a function of a DataFrame with a column text to one with a column score)
    and fitted by ridge regression, weighted by how much of the text they keep."""
    tokens = sorted(set(text.split()))
    if not tokens:
        return []
    rng = np.random.default_rng(seed)
    keep = rng.random((n_samples, len(tokens))) < rng.random((n_samples, 1))
    keep[0] = True
    rows = [(i, " ".join(t for t in text.split() if keep[i, tokens.index(t)])) for i in range(n_samples)]
    got = {r.sample: r.score for r in score(spark.createDataFrame(rows, "sample int, text string")).select("sample", "score").collect()}
    y = np.array([got.get(i) or 0.0 for i in range(n_samples)])
    w = np.exp(-((1 - np.sqrt(keep.mean(1))) ** 2) / 0.25**2)
    x = keep - np.average(keep, axis=0, weights=w)
    b = np.linalg.solve((x * w[:, None]).T @ x + np.eye(len(tokens)), (x * w[:, None]).T @ (y - np.average(y, weights=w)))
    return [(tokens[i], float(b[i])) for i in np.argsort(-np.abs(b), kind="stable")[:n_terms]]


def projection(vectors: DataFrame, item: str = "movieID", vector: str = "embedding", k: int = 2) -> DataFrame:
    """Vectors in their k principal components, for plots."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = vectors.select(item, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(x).transform(x).select(item, vector_to_array("p").alias("projection"))

