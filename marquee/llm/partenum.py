"""N-gram Jaccard self-join by PartEnum signatures.

A document's set are its distinct n-word shingles. Sets fall into bands of sizes, each as wide
as the similarity allows two linked sets to differ, so a set meets only sets of its own band
and of the two beside it. Within the bands i-1 and i, linked sets differ in at most k elements,
k from the band's largest size. The feature domain (hashes) is cut into n1 parts, each into n2
smaller ones, and a signature is the hash of a set's elements in n2 - k2 of a part's n2 cells:
two sets that differ in at most k elements differ in at most k2 of them in one of the parts, so
at least one choice of cells has equal elements, and the sets share that signature.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marquee.llm.common import drop_path, free_shuffles, materialise

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MEMO_WORDS = 300_000
#: The least width of a sketch. It grows with the set, a bit for an element at least: where 0.8
#: is asked for, it then lets pass few pairs below 0.74.
SKETCH_BITS = 512
#: Cuts of the domain under which a set is sent at most.
TURNS = 4
GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Word -> 64-bit hash; starts anew when it holds MEMO_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def set_arrays(texts, n: int, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a batch of texts (bytes or None): one array of 64-bit shingle hashes, each
    text's sorted and distinct, and their number by text. A text with fewer than n words has
    its whole sequence as one shingle; without words, none. Words stand between ASCII white
    space, A-Z lowered."""
    out, sizes = [], []
    for t in texts:
        words = t.translate(LOWER).split() if t else ()
        if not words:
            sizes.append(0)
            continue
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        m = min(n, len(h))
        s = h[: len(h) - m + 1]
        for i in range(1, m):
            s = mix(s * GOLD + h[i : len(h) - m + 1 + i])
        s = mix(s + np.uint64(m))
        s.sort()
        if len(s) > 1:
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        out.append(s)
        sizes.append(len(s))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(sizes, np.int64)


class PartEnum:
    """Signatures for a similarity of num / den. k2 and n2 say how many cells a part has, and how
    many of them may differ. cut: which of many cuts of the domain into cells; linked sets share
    a signature under every one.

    A choice of cells that are all empty says nothing: its signature would be that of a share of
    all sets of the band, whatever they hold, and groups would grow with the input. Hence there
    are some parts more than k needs (spare): of the parts in which linked sets differ in k2
    elements at most there are spare + 1 then. If such sets share no signature but empty ones, each
    has more than spare parts with an empty choice; sets that have are sent under another cut,
    too, and under the last of TURNS cuts with their empty choices."""

    def __init__(self, num: int, den: int, n2: int = 3, k2: int = 1, cut: int = 0):
        self.num, self.den, self.n2, self.k2 = num, den, n2, k2
        self.salts = [mix(np.array([cut + 1000 * turn], np.uint64) * GOLD) ^ np.uint64(0xD6E8FEB86659FD93) for turn in range(TURNS)]
        self.plans: dict[int, tuple] = {}
        self.bands: list[tuple[int, int]] = []

    def band(self, size: int) -> int:
        while not self.bands or self.bands[-1][1] < size:
            low = self.bands[-1][1] + 1 if self.bands else 1
            self.bands.append((low, low * self.den // self.num))
        return int(np.searchsorted([b[1] for b in self.bands], size))

    def plan(self, band: int) -> tuple[int, int, int, int]:
        """(k, parts, cells that may differ, spare): linked sets of bands band - 1 and band differ
        in at most k elements; with (parts - spare) * (k2 + 1) > k more than spare parts differ in
        k2 at most. Spare parts are as many as have an empty choice in most sets of the bands."""
        if band not in self.plans:
            while len(self.bands) <= band:
                self.band(self.bands[-1][1] + 1 if self.bands else 1)
            k = 2 * self.bands[band][1] * (self.den - self.num) // (self.den + self.num)
            k2 = min(self.k2, k)
            parts, spare, size = k // (k2 + 1) + 1, 0, 0.9 * self.bands[band][0]
            while k2:
                n = parts + spare
                empty = n * min(1.0, math.comb(self.n2, k2) * math.exp(-size / n * (self.n2 - k2) / self.n2))
                if spare + 1 > empty + 2 * math.sqrt(empty) or spare == parts:
                    break
                spare += 1
            self.plans[band] = (k, parts + spare, k2, spare)
        return self.plans[band]

    def signatures(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a batch of sets, and the number of each one's set in the batch."""
        sigs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        some = np.flatnonzero(sizes)
        own = np.array([self.band(int(n)) for n in sizes[some]], np.int64)
        for step in (0, 1):
            sets, sized, band, elements = some, sizes[some], own + step, flat
            for turn in range(TURNS):
                sig, at, again = self._cut(elements, sized, band, turn)
                sigs.append(sig)
                owners.append(sets[at])
                if not again.any():
                    break
                elements = elements[np.repeat(again, sized)]
                sets, sized, band = sets[again], sized[again], band[again]
        return np.concatenate(sigs), np.concatenate(owners)

    def _cut(self, flat: np.ndarray, sizes: np.ndarray, band: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of sets under one cut, each one's set, and which sets go on to another cut."""
        sigs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = mix(flat ^ self.salts[turn])
        plans = {b: self.plan(b) for b in set(band.tolist())}
        parts = np.array([plans[b][1] for b in band.tolist()], np.int64)
        spare = np.array([plans[b][3] for b in band.tolist()], np.int64)
        # A set whose k is 0 has one cell: its signature is the set itself.
        cells = np.array([plans[b][1] * (self.n2 if plans[b][2] else 1) for b in band.tolist()], np.int64)
        base = np.concatenate(([0], np.cumsum(cells)))
        at = base[doc] + (place % cells.astype(np.uint64)[doc]).astype(np.int64)
        # A cell's hash: the sum of its elements' hashes, wrapping; order doesn't matter.
        sums = np.zeros(int(base[-1]), np.uint64)
        np.add.at(sums, at, mix(flat + band.astype(np.uint64)[doc]))
        again = np.zeros(len(sizes), bool)
        for k2 in {p[2] for p in plans.values()}:
            n2 = self.n2 if k2 else 1
            pick = np.array([plans[b][2] == k2 for b in band.tolist()])
            d = np.repeat(np.flatnonzero(pick), parts[pick])
            grid = sums[np.repeat(pick, cells)].reshape(-1, n2)
            first = np.cumsum(parts[pick]) - parts[pick]
            part = np.arange(len(d)) - np.repeat(first, parts[pick])
            # No band and no part is beyond 24 bits.
            tag = mix((np.uint64(turn) << np.uint64(56)) + (band[d].astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64))
            choices = list(combinations(range(n2), n2 - k2))
            empty = [(grid[:, chosen] == 0).all(1) for chosen in choices]
            again |= np.bincount(d[np.logical_or.reduce(empty)], minlength=len(sizes)) > spare
            for j, chosen in enumerate(choices):
                keep = ~empty[j] | again[d] if turn == TURNS - 1 else ~empty[j]
                v = tag[keep] + np.uint64(j)
                for c in chosen:
                    v = mix(v) + grid[keep, c]
                sigs.append(mix(v))
                owners.append(d[keep])
        return np.concatenate(sigs), np.concatenate(owners), again


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's elements in cells, SKETCH_BITS or the least power of two from the
    set's size: two sets differ in at least as many elements as their sketches differ
    in bits, and hardly in more while they differ in few. A wide sketch becomes a narrow one by
    XOR of its halves (differing_bits)."""
    bits = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length() if len(s) else 0)
    n = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64)


def differing_bits(words: np.ndarray, start: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bits in which sketches p and q differ, at the narrower one's width. Sketch i is
    words[start[i] : start[i + 1]]."""
    width = np.diff(start)
    out = np.zeros(len(p), np.int64)
    kinds = width[p] << 32 | width[q]
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        n = min(kind >> 32, kind & 0xFFFFFFFF)
        x, y = (np.bitwise_xor.reduce(words[start[r[at]][:, None] + np.arange(w)].reshape(len(at), -1, n), axis=1) for r, w in ((p, kind >> 32), (q, kind & 0xFFFFFFFF)))
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


#: Signatures of one map task that share a value this often are spread over several owners.
SPREAD = 64
#: Rows, and elements of their sets, of a signature's group that one task compares with as many
#: others at most. Groups beyond are parted by the signatures of another cut of the domain.
BLOCK, BLOCK_ELEMENTS = 2000, 4_000_000
#: Cuts of the domain after the first that part large groups; what is still large then is
#: compared block by block.
CUTS = 2
#: Bytes of packed signatures that a map task holds before it sends them.
SEND_BYTES = 32 << 20
#: Bytes of text for each owner of a range of signatures.
OWNER_BYTES = 8 << 20
#: Bits of a signature that are sent, and of a node's key that go with it.
SIG_BITS, REF_BITS = 48, 32
#: Turns in which nodes of large clusters meet one hub each, before a family's pairs do.
HUB_TURNS = 2
#: Nodes with a signature in common up to which their keys are broadcast.
BROADCAST_ROWS = 500_000
#: Parts into which a component's rows are dealt where they meet its least id.
SALTS = 16


def _owner(sig: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each signature: equal ranges, so that the signatures of a pack are near."""
    return (((sig >> np.uint64(8)) * np.uint64(owners)) >> np.uint64(SIG_BITS - 8)).astype(np.int64)


def _pack(sig: np.ndarray, ref: np.ndarray, copies: np.ndarray) -> bytes:
    """Sorted signatures with the short keys of their nodes: what the owner of a signature range
    gets. Keys are numbered where that takes less; in a small pack, as many owners make it,
    hardly any repeats."""
    refs, at = np.unique(ref, return_inverse=True)
    width = 1 if len(refs) <= 1 << 8 else 2 if len(refs) <= 1 << 16 else 4
    if 4 * len(refs) + width * len(ref) >= 4 * len(ref):
        refs, at, width = refs[:0], ref, 4
    o = np.argsort(sig, kind="stable")
    gaps = np.diff(sig[o], prepend=sig[o[:1]])
    planes = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    body = b"".join((np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, k]).tobytes()) for k in range(planes))
    return struct.pack("<IIBBQ", len(sig), len(refs), width, planes, int(sig[o[0]])) + refs.astype("<i4").tobytes() + at[o].astype(f"<u{width}" if len(refs) else "<i4").tobytes() + np.packbits(copies[o]).tobytes() + body


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, width, planes, first = struct.unpack_from("<IIBBQ", b)
    at = struct.calcsize("<IIBBQ")
    refs = np.frombuffer(b, "<i4", m, at)
    at += 4 * m
    ref = refs[np.frombuffer(b, f"<u{width}", n, at)] if m else np.frombuffer(b, "<i4", n, at)
    at += width * n
    copies = np.unpackbits(np.frombuffer(b, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
    at += (n + 7) // 8
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :planes] = np.frombuffer(b, np.uint8, planes * n, at).reshape(planes, n).T
    return np.cumsum(gaps.view(np.uint64).reshape(-1), dtype=np.uint64) + np.uint64(first), ref, copies


def _node_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 63-bit key of each set; equal sets have equal keys."""
    zero = np.zeros(1, np.uint64)
    ends = np.concatenate((zero, np.cumsum(flat, dtype=np.uint64)))
    twice = np.concatenate((zero, np.cumsum(mix(flat), dtype=np.uint64)))
    b = np.concatenate(([0], np.cumsum(sizes)))
    sums = (ends[b[1:]] - ends[b[:-1]]) * GOLD
    more = twice[b[1:]] - twice[b[:-1]]
    return (mix(mix(sums + sizes.astype(np.uint64)) + more) >> np.uint64(1)).astype(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """A row for each document: id, text_hash, node (key of its set), size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.slice(lo, 512)
                flat, sizes = set_arrays((t.as_py() for t in part.column(1)), n, memo)
                marks = [sketch(flat[e - k : e]) for e, k in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
                at = np.cumsum([0, *map(len, marks)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(_node_keys(flat, sizes)), pa.array(sizes), pa.ListArray.from_arrays(at, np.concatenate(marks))], names=["id", "text_hash", "node", "size", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "id long, text_hash long, node long, size long, sketch array<long>")


def _signatures(docs: DataFrame, text_col: str, n: int, num: int, den: int, owners: int) -> DataFrame:
    """Rows of packed signatures by owner; a set that a map task has seen is not sent again.
    Of a signature SIG_BITS go, of its node's key REF_BITS: what agrees in them by chance is
    told apart by sketches."""
    schema = pa.schema([("owner", pa.int32()), ("packed", pa.binary())])
    ref_bits = REF_BITS

    def send(held: list) -> Iterator[pa.RecordBatch]:
        sig, node = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        o = np.argsort(sig, kind="stable")
        sig, node = sig[o], node[o]
        new = np.concatenate(([True], sig[1:] != sig[:-1]))
        start = np.flatnonzero(new)
        many = np.diff(np.concatenate((start, [len(sig)]))) >= SPREAD
        owner = _owner(sig, owners)
        copy = np.zeros(len(sig), bool)
        if many.any():
            # Hot in this task: its rows go to an owner that its first node picks, and one
            # copy, which tells of them but isn't a row, to the signature's own.
            hot = np.repeat(many, np.diff(np.concatenate((start, [len(sig)]))))
            lead = np.repeat(node[start], np.diff(np.concatenate((start, [len(sig)]))))
            own = owner[start[many]]
            owner[hot] = (mix(lead[hot].astype(np.uint64) ^ sig[hot]) % np.uint64(owners)).astype(np.int64)
            sig, node, owner, copy = np.concatenate((sig, sig[start[many]])), np.concatenate((node, node[start[many]])), np.concatenate((owner, own)), np.concatenate((copy, np.ones(many.sum(), bool)))
        o = np.argsort(owner, kind="stable")
        sig, node, owner, copy = sig[o], node[o], owner[o], copy[o]
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([owner[a]], pa.int32()), pa.array([_pack(sig[a:b], node[a:b], copy[a:b])], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, plan, seen = WordHashes(), PartEnum(num, den), set()
        held: list = []
        size = 0
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.slice(lo, 512)
                flat, sizes = set_arrays((t.as_py() for t in part.column(0)), n, memo)
                node = _node_keys(flat, sizes)
                fresh = np.zeros(len(part), bool)
                for i, k in enumerate(node.tolist()):
                    if sizes[i] and k not in seen:
                        fresh[i] = True
                        seen.add(k)
                if len(seen) > 1_000_000:
                    seen = set()
                sig, at = plan.signatures(flat[np.repeat(fresh, sizes)], np.where(fresh, sizes, 0))
                held.append((sig >> np.uint64(64 - SIG_BITS), ((node[at] << 1) >> (64 - ref_bits)).astype(np.int32)))
                size += 16 * len(sig)
                if size > SEND_BYTES:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "owner int, packed binary")


def _ref() -> Column:
    """The short key that signatures carry, of a column `node`."""
    return F.shiftright(F.shiftleft("node", 1), 64 - REF_BITS).cast("int")


def _shared_nodes(shared: DataFrame, each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (sig, node) and nodes (node, ref, rep, size, sketch), from signatures by short
    keys. A short key stands for all nodes that have it; these are a group of their own, too, as
    a signature that they alone share is not seen."""
    spark = each.sparkSession
    some = each.where("size > 0").withColumn("ref", _ref())
    twins = materialise(some.groupBy("ref").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("ref"), "twins")
    wanted = shared.select("ref").union(twins).distinct()
    nodes = some.join(wanted, "ref", "left_semi").groupBy("node").agg(F.first("ref").alias("ref"), F.min(F.struct("id", "text_hash")).alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes, "nodes")
    free_shuffles(spark)
    # No signature is below 0.
    own = twins.select((F.col("ref").cast("long") - (1 << 33)).alias("sig"), "ref")
    groups = materialise(shared.union(own).join(nodes.select("ref", "node"), "ref").select("sig", "node"), "groups")
    drop_path(spark, twins.scratch)
    return groups, nodes


def _members(node: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Two 64-bit keys and the size of each group of distinct nodes, groups beginning at start:
    equal for groups of the same nodes."""
    v = node.astype(np.uint64)
    sizes = np.diff(np.concatenate((start, [len(v)]))).astype(np.uint64)
    return np.stack((np.add.reduceat(mix(v), start), np.add.reduceat(mix(v * GOLD + MIX1), start), sizes), 1)


def _shared_signatures(rows: DataFrame, owners: int) -> DataFrame:
    """(sig, ref) of signatures that nodes of more than one short key have; of an owner's groups
    of the same keys, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for o, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(o, []).append(p.as_py())
        while held:
            owner, parts = held.popitem()
            sig, node, copy = (np.concatenate(x) for x in zip(*map(_unpack, parts), strict=True))
            o = np.lexsort((copy, node, sig))
            sig, node, copy = sig[o], node[o], copy[o]
            new = np.concatenate(([True], sig[1:] != sig[:-1]))
            hot = np.logical_or.reduceat(copy, np.flatnonzero(new))
            keep = new | np.concatenate(([True], node[1:] != node[:-1]))
            sig, node, copy, new = sig[keep], node[keep], copy[keep], new[keep]
            start = np.flatnonzero(new)
            n = np.diff(np.concatenate((start, [len(sig)])))
            # A group is all here unless parts of it were spread; then a copy tells of them.
            whole = ~hot & (_owner(sig[start], owners) == owner) & (n > 1)
            first = np.zeros(len(start), bool)
            if whole.any():
                _, at = np.unique(_members(node, start)[whole], axis=0, return_index=True)
                first[np.flatnonzero(whole)[at]] = True
            keep = np.repeat((n > 1) & (~whole | first), n) & ~copy
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(node[keep])], names=["sig", "ref"])

    return rows.repartition(owners, "owner").mapInArrow(run, "sig long, ref int")


def _distinct_groups(rows: DataFrame, of: str = "node") -> DataFrame:
    """Of groups (sig) of the same nodes, one: it tells all that the others do. Sums of two
    hashes, by halves, and the number stand for the nodes; a row may be there twice (copies
    that several map tasks spread), which would cancel under XOR."""
    h = [F.xxhash64(of), F.xxhash64(of, F.lit(1))]
    sums = [F.sum(x).alias(f"x{i}") for i, x in enumerate(y for k in h for y in (F.shiftright(k, 32), k.bitwiseAND(0xFFFFFFFF)))]
    groups = rows.groupBy("sig").agg(*sums, F.count("*").alias("n")).where("n > 1")
    some = groups.groupBy("x0", "x1", "x2", "x3", "n").agg(F.min("sig").alias("sig")).select("sig")
    return rows.join(some, "sig", "left_semi")


def _most(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Elements in which linked sets of sizes a and b differ at most."""
    return (a + b) * (den - num) // (den + num)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (a, b): comp is the least node that links reach.

    Alternates large-star and small-star steps; each is joins and partial minima, written to
    the shared folder, so a star around a hot node is never in one task."""
    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        """df as a table, and its rows' number and sum, which tell whether a step changed it."""
        seen = Observation()
        out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        return out, (seen.get["n"], seen.get["sum"])

    e, now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while now != before and now[0]:
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.join(least, sym.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(down, large.a == down.u)
        step = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        old, before = e, now
        e, now = kept(step)
        drop_path(edges.sparkSession, old.scratch)
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels.union(e.select(F.col("b"), F.col("b")).distinct())


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after links (a, b) between their nodes: the components are joined as
    nodes of a smaller graph, and each node takes its component's new name."""
    x, y = (labels.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}")) for k in ("a", "b"))
    between = links.join(x, "a").join(y, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    named = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return materialise(labels.join(named, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels")


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether sorted sets have a Jaccard similarity of num / den or more, exactly."""
    i = len(np.intersect1d(x, y, assume_unique=True))
    return den * i >= num * (len(x) + len(y) - i)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is num / den or more, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = pa.array([_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(t.column(2), t.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    x = sets.select(F.col("node").alias("a"), F.col("elements").alias("xa"))
    y = sets.select(F.col("node").alias("b"), F.col("elements").alias("xb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


class _Sets:
    """The sets of nodes, made from the texts when they are first asked for: only those of
    nodes that a sketch leaves a partner."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, id_col: str, text_col: str):
        self.docs, self.nodes, self.how, self.made = docs, nodes, (n, id_col, text_col), None

    def of(self, wanted: DataFrame) -> DataFrame:
        """A table (node, elements) with the wanted nodes (column node, distinct) and others."""
        if self.made is not None:
            wanted = wanted.join(self.made.select("node"), "node", "left_anti")
        wanted = materialise(self.nodes.join(wanted, "node", "left_semi").select("node", "rep"), "wanted")
        if self.made is None or not wanted.isEmpty():
            more = materialise(_elements(self.docs, wanted, *self.how), "elements")
            self.made = more if self.made is None else self.made.union(more)
        return self.made


def _elements(docs: DataFrame, nodes: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, elements) of nodes: the sets of one row each, from its text, read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.slice(lo, 512)
                flat, sizes = set_arrays((t.as_py() for t in part.column(0)), n, memo)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(_node_keys(flat, sizes)), pa.array([flat[e - k : e].tobytes() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())], names=["node", "elements"])

    reps = nodes.select(F.col("rep.id").alias("rid"), F.col("rep.text_hash").alias("rhash"))
    reps = F.broadcast(reps) if nodes.count() <= BROADCAST_ROWS else reps
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(reps, F.col("id").eqNullSafe(F.col("rid")) & (F.xxhash64("text") == F.col("rhash")), "left_semi")
    return rows.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, elements binary")


class _Marks:
    """Sizes and sketches of the rows of an Arrow table."""

    def __init__(self, size, lists):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.size = size.to_numpy()
        self.marks = lists.flatten().to_numpy().view(np.uint64)
        start = lists.offsets.to_numpy().astype(np.int64)
        self.start = start - start[0]

    def may_link(self, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which pairs of rows p and q their sizes and sketches allow."""
        a, b = self.size[p], self.size[q]
        ok = den * np.minimum(a, b) >= num * np.maximum(a, b)
        ok[ok] = differing_bits(self.marks, self.start, p[ok], q[ok]) <= _most(a[ok], b[ok], num, den)
        return ok


def _hub_pairs(live: DataFrame, nodes: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """For each node the hub that its sketch says is nearest, of those that its families have
    and that may link: (a, b), in different components. live: family, node, comp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for lo in range(0, len(t), 2000):
                c = t.slice(lo, 2000)
                m = _Marks(pa.concat_arrays([c.column(2), c.column(4)]), pa.concat_arrays([c.column(3), c.column(5)]))
                p = np.arange(len(c))
                p = p[m.may_link(p, p + len(c), num, den)]
                gap = differing_bits(m.marks, m.start, p, p + len(c)) / (m.size[p] + m.size[p + len(c)])
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(p)), c.column(1).take(pa.array(p)), pa.array(gap)], names=["a", "b", "gap"])

    hubs = live.groupBy("family").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("hub"), F.col("comp").alias("hubcomp"))).alias("x")).select("family", "x.hub", "x.hubcomp")
    pairs = live.join(hubs, "family").where("comp <> hubcomp").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    x, y = (nodes.select(F.col("node").alias(k), F.col("size").alias(f"size{k}"), F.col("sketch").alias(f"sketch{k}")) for k in ("a", "b"))
    pairs = pairs.join(x, "a").join(y, "b").where((den * F.least("sizea", "sizeb")) >= num * F.greatest("sizea", "sizeb"))
    pairs = pairs.select("a", "b", "sizea", "sketcha", "sizeb", "sketchb").mapInArrow(run, "a long, b long, gap double")
    return pairs.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("x")).select("a", "x.b")


def _live(families: DataFrame, labels: DataFrame) -> DataFrame:
    """(family, node, comp) of the families that have nodes of more than one component."""
    rows = families.join(labels, "node")
    open_ = rows.groupBy("family").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("family")
    return materialise(rows.join(open_, "family", "left_semi").select("family", "node", "comp"), "live")


def _hooked(lab: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels of rows after edges (p, q): those of a component are equal."""
    while len(p):
        a, b = lab[p], lab[q]
        differ = a != b
        if not differ.any():
            break
        p, q = p[differ], q[differ]
        np.minimum.at(lab, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (lab[lab] != lab).any():
            lab = lab[lab]
    return lab


def _groups(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of `least` rows or more but for the last; rows come sorted by
    their first `keys` columns, which name the group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.logical_and.reduce([k == k[-1] for k in (t.column(k).to_numpy() for k in range(keys))])
        cut = int(np.argmax(same))
        if cut:
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).to_batches()
            n = len(t) - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _refined(groups: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """groups (sig, node), the large ones parted by the signatures of other cuts of the domain:
    linked sets share one under each cut, so that a link of a large group is in one of its
    parts. And (sig, blocks) of the groups that are large still."""
    done, open_ = None, groups
    for cut in range(1, CUTS + 2):
        sizes = open_.join(nodes.select("node", "size"), "node").groupBy("sig").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
        large = materialise(sizes.where("blocks > 1"), "large")
        if cut > CUTS or large.isEmpty():
            return open_ if done is None else done.unionByName(open_), large
        small = open_.join(large, "sig", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = open_.join(large, "sig", "left_semi")
        wanted = nodes.join(rows.select("node").distinct(), "node", "left_semi")

        def run(batches: Iterator[pa.RecordBatch], plan=PartEnum(num, den, cut=cut)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, len(b), 64):
                    part = b.slice(lo, 64)
                    sets = [np.frombuffer(x.as_py(), np.uint64) for x in part.column(1)]
                    sig, at = plan.signatures(np.concatenate(sets), np.array([len(x) for x in sets], np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(sig.view(np.int64))], names=["node", "other"])

        more = _elements(docs, wanted, n, id_col, text_col).mapInArrow(run, "node long, other long").distinct()
        parts = rows.join(more, "node").select(F.xxhash64("sig", "other").alias("sig"), "node").distinct()
        open_ = materialise(_distinct_groups(parts), "parts")


def _families(groups: DataFrame, large: DataFrame, nodes: DataFrame, owners: int, num: int, den: int) -> DataFrame:
    """(family, node): within each group, the nodes that sketches let link, by components of
    such pairs. No pair leaves its task: a family is as many rows as it has nodes, and families
    of the same nodes, from whichever groups, have the same key. A group of several blocks is
    compared block by block."""
    rows = groups.join(large, "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node").join(nodes, "node")
    rows = rows.select("sig", "i", "j", "block", "node", "size", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3, 4000):
            sig, i, j, block, node = (t.column(k).to_numpy() for k in range(5))
            m = _Marks(t.column(5), t.column(6))
            group = np.cumsum(np.concatenate(([True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            lab = at = np.arange(len(t))
            for shift in range(1, len(t)):
                at = at[: np.searchsorted(at, len(t) - shift)]
                at = at[group[at] == group[at + shift]]
                if not len(at):
                    break
                to = at + shift
                ok = (lab[at] != lab[to]) & ((i[at] == j[at]) | (block[at] != block[to]))
                p, q = at[ok], to[ok]
                ok = m.may_link(p, q, num, den)
                lab = _hooked(lab.copy(), p[ok], q[ok])
            o = np.argsort(lab, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], lab[o][1:] != lab[o][:-1])))
            names = _members(node[o], start)
            n = names[:, 2].astype(np.int64)
            key = (mix(mix(names[:, 0]) + names[:, 1]) + names[:, 2]).view(np.int64)
            keep = np.repeat(n > 1, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)[keep]), pa.array(node[o][keep])], names=["family", "node"])

    sent = rows.repartition(owners, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return sent.mapInArrow(run, "family long, node long").distinct()


def _clusters(families: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Families that share nodes as one, under the name of its least node: a node is in one
    cluster, but in many families. Clusters beyond BLOCK stay the families that they were:
    (family, node) of the others, of these, and whether there are such."""
    leads = families.groupBy("family").agg(F.min("node").alias("b"))
    stars = families.join(leads, "family").select(F.col("node").alias("a"), "b").distinct()
    comps = materialise(components(stars), "clusters")
    sizes = comps.join(nodes.select("node", "size"), "node").groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    large = materialise(sizes.where((F.col("n") > BLOCK) | (F.col("m") > BLOCK_ELEMENTS)).select("comp"), "large")
    small = comps.join(large, "comp", "left_anti").select(F.col("comp").alias("family"), "node")
    return small, families.join(comps.join(large, "comp", "left_semi").select("node"), "node", "left_semi").select("family", "node"), not large.isEmpty()


def _family_links(live: DataFrame, nodes: DataFrame, sets: DataFrame, owners: int, num: int, den: int) -> DataFrame:
    """Links (a, b), verified, that join the components of each family's nodes as far as links
    within it do: at most one less than the family's nodes. live: family, node, comp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1, 1):
            family, node, comp = (t.column(k).to_numpy() for k in range(3))
            m = _Marks(t.column(3), t.column(4))
            group = np.cumsum(np.concatenate(([True], family[1:] != family[:-1])))
            # Rows of one component begin under one label.
            _, lab = np.unique(np.stack((group, comp), 1), axis=0, return_inverse=True)
            lab, at, found = lab.reshape(-1), np.arange(len(t)), []
            for shift in range(1, len(t)):
                at = at[: np.searchsorted(at, len(t) - shift)]
                at = at[group[at] == group[at + shift]]
                if not len(at):
                    break
                p = at[lab[at] != lab[at + shift]]
                p = p[m.may_link(p, p + shift, num, den)]
                for x in p.tolist():
                    y = x + shift
                    if lab[x] != lab[y] and _similar(*(np.frombuffer(t.column(5)[k].as_py(), np.uint64) for k in (x, y)), num, den):
                        lab[lab == lab[x]] = lab[y]
                        found.append((x, y))
            x, y = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    rows = live.join(nodes.select("node", "size", "sketch"), "node").join(sets, "node").select("family", "node", "comp", "size", "sketch", "elements")
    return rows.repartition(owners, "family").sortWithinPartitions("family").mapInArrow(run, "a long, b long")


def linked_nodes(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, text_hash, node, size), and the labels (node, comp) of nodes with links.

    Two rows link when den * |intersection| >= num * |union| of their sets of distinct n-word
    shingles; a text with fewer words has its whole sequence as one shingle.

    Rows of equal sets are one node (by a key of 63 bits). Nodes that share a signature are
    compared by sketches, which never part linked sets, in the task that has the signature's
    group; what leaves it are families, the nodes that possible links connect. Families that
    share nodes are a cluster, whose task compares pairs exactly until its nodes are joined as
    far as they can be. Where a cluster is too large for a task, every node first meets one hub
    of its families, in HUB_TURNS turns, so that near copies become one component at the cost
    of a pair for each node, and then each family is compared like a cluster. No step emits
    more rows than it reads, and pairs within a component, which can't change it, are not
    compared."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNER_BYTES), 1)
    # Two readings of the texts: kept for both uses, the packed signatures would lie on disk
    # twice, and they are the largest thing here.
    sent = materialise(_shared_signatures(_signatures(docs, text_col, n, num, den, owners), owners), "signatures")
    free_shuffles(spark)
    shared = materialise(_distinct_groups(sent, "ref"), "shared")
    drop_path(spark, sent.scratch)
    free_shuffles(spark)
    each = materialise(_sets(docs, id_col, text_col, n), "sets")
    groups, nodes = _shared_nodes(shared, each)
    drop_path(spark, shared.scratch)
    nodes = nodes.drop("ref")
    free_shuffles(spark)
    parts, large = _refined(groups, docs, nodes, n, num, den, id_col, text_col)
    families = materialise(_families(parts, large, nodes, owners, num, den), "families")
    free_shuffles(spark)
    sets = _Sets(docs, nodes, n, id_col, text_col)
    labels = materialise(families.select("node").distinct().select("node", F.col("node").alias("comp")), "labels")
    small, others, some = _clusters(families, nodes)
    free_shuffles(spark)
    made = sets.of(small.select("node"))
    links = materialise(_family_links(small.withColumn("comp", F.col("node")), nodes, made, owners, num, den), "links")
    free_shuffles(spark)
    labels = relabelled(labels, links)
    for turn in range(HUB_TURNS + 1 if some else 0):
        others = _live(others.select("family", "node"), labels)
        if turn < HUB_TURNS:
            pairs = materialise(_hub_pairs(others, nodes, turn, num, den), "pairs")
            made = sets.of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
            links = _verified(pairs, made, num, den)
        else:
            made = sets.of(others.select("node").distinct())
            links = _family_links(others, nodes, made, owners, num, den)
        labels = relabelled(labels, materialise(links, "links"))
    free_shuffles(spark)
    return each.select("id", "text_hash", "node", "size"), labels


def _salted(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows join by on comp, a component's rows dealt to SALTS places: by has a row for each
    component, and a component can have a third of all rows."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    return rows.join(by.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["comp", "salt"]).drop("salt")


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_shingles (size of its set) and component_id.

    component_id is the smallest id that links reach, the row's own included. A null text, and
    one without words, has an empty set and links with nothing. Ids may repeat: rows are linked
    by text; a null id is never a component's id unless all ids of it are null. Other columns
    are not read; an empty table gives no rows."""
    each, labels = linked_nodes(docs, n, num, den, id_col, text_col)
    firsts = each.where("size > 0").groupBy("node").agg(F.min("id").alias("first"))
    joined = labels.join(firsts, "node")
    least = joined.groupBy("comp").agg(F.min("first").alias("least"))
    named = _salted(joined, least).select("node", "least")
    found = firsts.join(named, "node", "left").select("node", F.coalesce("least", "first").alias("component"))
    out = each.join(found, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, less those that links join to a row of smaller id
    (nulls last; then of smaller text hash). Rows with empty sets stay. Rows that agree in
    both id and text stay or go together."""
    each, labels = linked_nodes(docs, n, num, den, id_col, text_col)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    each = each.where("size > 0").join(labels, "node", "left").select("id", "text_hash", rank.alias("rank"), F.coalesce("comp", "node").alias("comp"))
    best = each.groupBy("comp").agg(F.min("rank").alias("best"), F.max("rank").alias("last")).where("best <> last").select("comp", "best")
    gone = materialise(_salted(each, best).where("rank <> best").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "near-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone._id) & (F.xxhash64(docs[text_col]) == gone._hash), "left_anti")
