"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes through the features in turn, again and again,
and fits a tree of at most three leaves to the residual of one feature at a time, added to that
feature's lookup table at a small rate. Then the pairs whose joint table would explain most of
the residual are boosted likewise with trees that cut both features once. A score is the sum of
one table entry for each feature and pair: vectorised additions of looked-up bins.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import crc_mod, materialise

#: Labelled rows from which the model is fitted at most: those of least MD5 of their id.
SAMPLE_ROWS = 50_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1

#: Fixed sets of ASCII characters that features count.
SYMBOLS, STOPS, DIGITS, CAPITALS = b"#$%&*|<>{}[]\\^~=+_@/`", b".,;:!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("log_words", "word_length", "symbols", "stops", "exclaims", "digits", "capitals", "caps_words", "repeats", "distinct", "plain_words", "lines", "line_words", "distinct_lines", "line_symbols", "line_caps", "line_repeats", "short_words", "odd_lines")


def features_of(text: str | None) -> tuple[float, ...]:
    """The features of a whole text; of an empty one, zeros."""
    words = (text or "").split()
    if not words:
        return (0.0,) * len(FEATURES)
    raw = text.encode()
    n, size = len(words), len(raw)
    count = lambda b, chars: len(b) - len(b.translate(None, chars))
    lines = [x for x in text.split("\n") if x.strip()]
    most_symbols = most_caps = most_repeats = 0
    odd = 0
    for line in lines:
        w = line.split()
        symbols = count(line.encode(), SYMBOLS)
        caps = sum(map(str.isupper, w))
        repeats = sum(map(operator.eq, w, w[1:]))
        most_symbols, most_caps, most_repeats = max(most_symbols, symbols), max(most_caps, caps), max(most_repeats, repeats)
        if 2 * (symbols + caps + repeats) > len(w):
            odd += len(w)
    return (
        np.log1p(n), size / n, count(raw, SYMBOLS) / n, count(raw, STOPS) / n, raw.count(b"!") / n, count(raw, DIGITS) / size, count(raw, CAPITALS) / size,
        sum(map(str.isupper, words)) / n, sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, sum(map(str.isalnum, words)) / n,
        len(lines), n / len(lines), len(set(lines)) / len(lines), most_symbols, most_caps, most_repeats, sum(map((2).__ge__, map(len, words))) / n, odd / n,
    )


@dataclass
class AdditiveModel:
    """edges: of each feature's bins; tables: of features; pairs: (i, j, table)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        f = np.full(len(x), self.base)
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        for b, t in zip(bins, self.tables, strict=True):
            f += t[b]
        for i, j, t in self.pairs:
            f += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with at most two cuts, each the best for its part."""
    out = np.zeros(len(g))
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in parts:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (a, a + k + 1, b))
        if not best[1]:
            break
        a, k, b = best[1]
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four by one cut in each direction."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def corners(c):
        a = c[:-1, :-1]
        return a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a

    quads = list(zip(corners(cg), corners(ch), strict=True))
    gain = sum(_gain(x, y) for x, y in quads)
    k, m = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [x[k, m] / (y[k, m] + 1.0) for x, y in quads]
    out = np.empty_like(g)
    out[: k + 1, : m + 1], out[: k + 1, m + 1 :], out[k + 1 :, : m + 1], out[k + 1 :, m + 1 :] = value
    return float(gain[k, m]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Without rows the model says 0.5; with one label alone, nearly that label."""
    n = len(y)
    model = AdditiveModel(base=float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))))
    if not n or y.min() == y.max():
        return model
    for j in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.edges.append(e)
        model.tables.append(np.zeros(len(e) + 1))
        model.coarse.append(np.arange(len(e) + 1) * min(PAIR_BINS, len(e) + 1) // (len(e) + 1))
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    f = np.full(n, model.base)
    residual = lambda: (lambda p: (y - p, p * (1 - p)))(1 / (1 + np.exp(-f)))
    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables, strict=True):
            g, h = residual()
            step = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
            t += step
            f += step[b]
    small = [c[b] for c, b in zip(model.coarse, bins, strict=True)]
    sizes = [int(c[-1]) + 1 for c in model.coarse]

    def grid(i, j, v):
        return np.bincount(small[i] * sizes[j] + small[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = residual()
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(range(len(bins)), 2) if min(sizes[i], sizes[j]) > 1), reverse=True)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = residual()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            t += step
            f += step[small[i], small[j]]
    return model


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x (the features, an array) of each row; texts are read whole, once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features_of(t.as_py()) for t in b.column(1)], dtype=np.float64).reshape(-1)
            at = np.arange(0, len(x) + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, x)], names=["id", "x"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, x array<double>")


def learn(features: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", held_out_of: int | None = 3, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """The model of at most `rows` labelled rows; with held_out_of, no row counts whose crc32
    of its id has remainder 1. Of an id with several labels, the mean decides; null labels
    and ids are left out. At most `rows` short feature vectors come to the driver."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = one.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    if held_out_of:
        one = one.where(crc_mod("id", held_out_of) != 1)
    got = features.join(one, "id").select("id", "x", "y").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id", "x").limit(rows).toArrow()
    if not len(got):
        return AdditiveModel()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(got), -1)
    return fit(x, got.column("y").to_numpy().astype(float))


def score_features(features: DataFrame, model: AdditiveModel) -> DataFrame:
    kind = features.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["id", "score"])

    return features.select("id", "x").mapInArrow(run, f"id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row for each row of docs: id, held_out (crc32 of the id has remainder 1: its label
    was not learnt), score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    Null and empty texts have features of zero and a score like any other. Rows that repeat
    an id are scored on their own. Only the text gives features. Without labels all scores
    are 0.5. Features are computed once, and kept in the shared folder for fit and scores."""
    features = materialise(text_features(docs, id_col, text_col), "quality")
    model = learn(features, labels, label_col, id_col, held_out_of, rows)
    s = score_features(features, model)
    return s.select(F.col("id").alias(id_col), (crc_mod("id", held_out_of) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, held_out_of: int | None = 3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with their columns, whose score is `least` or more. The score is a
    function of the text alone, so it is applied while the rows pass, without a join. Rows with
    null ids or texts are scored like any other; an empty table gives no rows. For the fit,
    features are computed of at most `rows` labelled ids alone, those of least hash."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    if held_out_of:
        known = known.where(crc_mod("id", held_out_of) != 1)
    picked = docs.select(F.col(id_col).alias("id")).join(known, "id", "left_semi").distinct()
    picked = materialise(picked.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(rows), "quality-ids")
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    model = learn(text_features(few, "id", "text"), labels, label_col, id_col, held_out_of, rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                good = model.scores(np.array([features_of(t.as_py()) for t in b.column(at)])) >= least
                yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
