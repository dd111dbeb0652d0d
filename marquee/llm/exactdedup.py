"""Exact duplicates by an extendible-hash index on shared files.

The index key of a text is the leading bits of its SHA-256. Owner tasks have equal ranges of
keys, as many as the bytes of the texts need: keys are uniform, so no directory of all ranges
is ever gathered. Map tasks fold the copies they see (comparing bytes), and send one entry for
each distinct text to the task that owns the key's range. An owner reads its range in the order
of keys, chains entries whose keys collide, comparing bytes along the chain, and doubles its
part of the directory wherever a bucket holds more bytes than its capacity. It writes the
buckets' entries to the index, a Parquet table in the shared folder. A text's rows then find
their entry by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import materialise, private

#: Bytes of text for each owner, and bytes that a bucket may hold before it splits.
OWNER_BYTES, BUCKET_BYTES = 8 << 20, 1 << 20
#: Bytes of text within which a map task folds copies before it sends them.
FOLD_BYTES = 32 << 20
#: Entries (without their texts) of which an owner makes buckets at a time.
RANGE_ENTRIES = 200_000
#: Bits of a key.
MOST_BITS = 60

INDEX = "bucket long, depth int, key long, chain int, sha string, keep_id long, group_size long, n_keep long"
INDEX_SCHEMA = pa.schema([("bucket", pa.int64()), ("depth", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.string()), *((c, pa.int64()) for c in ("keep_id", "group_size", "n_keep"))])


def buckets(keys: np.ndarray, n_bytes: np.ndarray, capacity: int = BUCKET_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in the order of their keys: the first key and the depth of each one's bucket.
    The directory begins as one bucket of depth 0 and doubles where one is overfull; what shares
    a key can't be split, and stays one chain."""
    load = np.concatenate(([0], np.cumsum(n_bytes)))
    first, depth = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
    todo = [(0, len(keys), 0, 0)]
    while todo:
        a, b, d, prefix = todo.pop()
        if a == b:
            continue
        if load[b] - load[a] <= capacity or d == MOST_BITS or keys[a] == keys[b - 1]:
            first[a:b], depth[a:b] = prefix << (MOST_BITS - d), d
            continue
        middle = a + int(np.searchsorted(keys[a:b], (2 * prefix + 1) << (MOST_BITS - d - 1)))
        todo += [(a, middle, d + 1, 2 * prefix), (middle, b, d + 1, 2 * prefix + 1)]
    return first, depth


def key_of(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big") >> (64 - MOST_BITS)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES, digest=None) -> DataFrame:
    """The index of docs: a row for each distinct text with its bucket, key, place in the
    key's chain, digest, keep_id (largest id of its rows), group_size, and n_keep (rows that
    have that id). It is written to the shared folder.

    Null texts count as empty. An id of null counts as less than any other. digest: bytes ->
    32 bytes, for tests of colliding keys."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNER_BYTES), 1)
    digest = digest or (lambda b: hashlib.sha256(b).digest())

    def more(a, b):
        """Of (largest id, rows, rows with that id), that of both together."""
        if a[0] == b[0]:
            return (a[0], a[1] + b[1], a[2] + b[2])
        top = b if a[0] is None or b[0] is not None and b[0] > a[0] else a
        return (top[0], a[1] + b[1], top[2])

    schema = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("n_keep", pa.int64())])

    def entries(seen: dict) -> Iterator[pa.RecordBatch]:
        shas = [digest(t) for t in seen]
        keys = [key_of(s) for s in shas]
        at = np.array([k * owners >> MOST_BITS for k in keys], np.int32)
        keys = np.array(keys, dtype=np.int64)
        texts, got = list(seen), list(seen.values())
        for i in range(0, len(texts), 512):
            s = slice(i, i + 512)
            yield pa.RecordBatch.from_arrays([pa.array(at[s], pa.int32()), pa.array(keys[s]), pa.array(shas[s], pa.binary()), pa.array(texts[s], pa.binary()), *(pa.array([g[k] for g in got[s]], pa.int64()) for k in range(3))], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        held = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                if t in seen:
                    seen[t] = more(seen[t], (i, 1, 1))
                else:
                    seen[t] = (i, 1, 1)
                    held += len(t) + 200
                if held > FOLD_BYTES:
                    yield from entries(seen)
                    seen, held = {}, 0
        yield from entries(seen)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        chain: list[list] = []
        now = None

        def ended() -> None:
            done.extend((now, c, e[0].hex(), len(e[1]), *e[2]) for c, e in enumerate(chain))

        def written() -> pa.RecordBatch:
            key, at, sha, n_bytes, *rest = zip(*done, strict=True)
            first, depth = buckets(np.array(key, np.int64), np.array(n_bytes, np.int64), capacity)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((first, depth, key, at, sha, *rest), INDEX_SCHEMA, strict=True)], schema=INDEX_SCHEMA)

        for b in batches:
            for key, sha, text, i, n, n_keep in zip(*(b.column(k).to_pylist() if k != 3 else b.column(k) for k in range(1, 7)), strict=True):
                if key != now:
                    ended()
                    if len(done) >= RANGE_ENTRIES:
                        yield written()
                        done.clear()
                    chain, now = [], key
                text = text.as_py()
                for e in chain:
                    if e[1] == text:
                        e[2] = more(e[2], (i, n, n_keep))
                        break
                else:
                    chain.append([sha, text, (i, n, n_keep)])
        ended()
        if done:
            yield written()

    sent = rows.mapInArrow(fold, "owner int, key long, sha binary, text binary, id long, n long, n_keep long")
    index = sent.repartitionById(owners, F.col("owner")).sortWithinPartitions("key").mapInArrow(own, INDEX)
    return materialise(index, "exact-index")


def _marked(docs: DataFrame, names: tuple[str, ...], id_col: str, text_col: str, capacity: int) -> DataFrame:
    """docs with columns of these names: keep_id, group_size, kept, text_sha256."""
    keep_id, group_size, kept, digest = names
    sha, n_keep, tag, least = (private(n) for n in ("sha", "n_keep", "tag", "least"))
    index = build_index(docs, id_col, text_col, capacity)
    docs = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    entry = index.select(F.col("sha").alias(sha), F.col("keep_id").alias(keep_id), F.col("group_size").alias(group_size), F.col("n_keep").alias(n_keep))
    out = docs.join(entry, F.col(digest) == F.col(sha)).drop(sha)
    out = out.withColumn(kept, F.col(id_col).eqNullSafe(F.col(keep_id)))
    if index.where("n_keep > 1").isEmpty():
        return out.drop(n_keep)
    # Rows that repeat text and id: tagged once, of each the least tag is kept.
    again = F.col(kept) & (F.col(n_keep) > 1)
    some = materialise(out.where(again).withColumn(tag, F.monotonically_increasing_id()), "exact-again")
    first = some.groupBy(digest).agg(F.min(tag).alias(least)).select(least)
    some = some.join(first, F.col(tag) == F.col(least), "left").withColumn(kept, F.col(least).isNotNull()).drop(tag, least)
    return out.where(~again).unionByName(some).drop(n_keep)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES) -> DataFrame:
    """docs with keep_id (largest id of the rows with an equal text), group_size (their
    number), kept and text_sha256 (lower-case hex of the UTF-8 text); all rows, all columns.

    Texts are equal when their bytes are; null counts as empty. One row of each group has
    kept: where rows share both text and id, one of them, whichever. Ids of null come last.
    An empty table gives no rows. Columns of docs of the new names are replaced. A group of
    any size costs a bounded number of index entries; its rows meet the entry in a join that
    adaptive execution splits where a key is hot."""
    names = ("keep_id", "group_size", "kept", "text_sha256")
    return _marked(docs.drop(*names), names, id_col, text_col, capacity)


def largest_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES) -> DataFrame:
    """The rows of docs, with their columns, that exact_duplicates() marks as kept."""
    names = tuple(private(n) for n in ("keep_id", "group_size", "kept", "text_sha256"))
    return _marked(docs, names, id_col, text_col, capacity).where(F.col(names[2])).drop(*names)
