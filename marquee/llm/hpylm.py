"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a restaurant of the words behind it; all of them share the parent
restaurant of single words, whose base is uniform over the vocabulary and one unknown word. A
table of a context's restaurant is a customer of the parent. Seating is sampled by Gibbs: each
customer leaves its table and sits down again, at a table in proportion to its customers less
the discount, or at a new one in proportion to the parent's probability of the word. Samples
of parent and contexts alternate, and the predictive probabilities of SAMPLES states are
averaged.

Contexts belong to owners by hash. Map tasks count pairs and note which documents have them,
and send packed arrays, one row for each owner. An owner keeps its contexts as one row of a
table that is bucketed by owner, so that the answers of the parent restaurant, bucketed alike,
meet it without moving it. Only scalars reach the driver. One customer of every SECTION of a
pair moves at a time, so that work goes on in parallel; the pair's tables are shared.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import crc_mod, drop_path, free_shuffles, materialise, scratch_path
from marquee.llm.partenum import LOWER, mix

#: Sweeps over the contexts before the parent is sampled anew, and states that are averaged.
SWEEPS, SAMPLES = 2, 2
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
SECTION = 128
SEED = 7
#: Bytes of text for each owner; tokens, words and documents that a map task holds at most.
OWNER_BYTES = 6 << 20
FLUSH_TOKENS, FLUSH_WORDS, FLUSH_DOCS = 1_500_000, 1 << 19, 1 << 15
#: Words are told apart by 64 bits as contexts, and by the upper WORD_BITS behind one.
WORD_BITS = 40
BEGIN, END = np.uint64(1), np.uint64(2)
#: Of the type of the counts it is added to: else the sum goes by a slow way.
ONE = np.int32(1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed; sorted ones should be given as gaps."""
    import zstandard

    out = []
    for a in arrays:
        w = a.dtype.itemsize
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, w).T).tobytes()
        out.append(f"{a.dtype.str},{len(a)};".encode() + planes)
    head = b"".join(x.partition(b";")[0] + b";" for x in out)
    return zstandard.ZstdCompressor(level=1).compress(head + b"\n" + b"".join(x.partition(b";")[2] for x in out))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    head, _, body = zstandard.ZstdDecompressor().decompress(data).partition(b"\n")
    out, at = [], 0
    for x in head.decode().split(";")[:-1]:
        kind, n = x.split(",")
        kind, n = np.dtype(kind), int(n)
        size = kind.itemsize * n
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).reshape(-1))
        at += size
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.zeros(1, a.dtype))


def _ids() -> defaultdict:
    """Words to numbers from 2 on, in the order they are asked for."""
    return defaultdict(count(2).__next__)


def _pairs_out(owners: int):
    """For mapInArrow: (key, id, held, text) to (owner, src, packed). A token's context is the
    token before it; the first one's is the text's begin."""

    def flush(ids: dict, tokens: list, docs: list) -> Iterator[pa.RecordBatch]:
        # Ids 0 and 1 are the text's begin and end.
        keys = np.array([BEGIN, END, *map(xxhash.xxh3_64_intdigest, ids)], np.uint64)
        sizes = np.array([len(t) for t in tokens])
        ends = np.cumsum(sizes)
        w = np.concatenate(tokens)
        u = np.concatenate((np.zeros(1, w.dtype), w[:-1]))
        u[ends[:-1]] = 0
        doc = np.repeat(np.arange(len(tokens)), sizes)
        n = len(keys)
        # Contexts by owner and key, words by key: one sort of all brings each owner's pairs,
        # and each pair's documents, together.
        owner = (mix(keys) % np.uint64(owners)).astype(np.int64)
        by_key = np.argsort(keys)
        by_owner = by_key[np.argsort(owner[by_key], kind="stable")]
        u_place, w_place = np.empty(n, np.int64), np.empty(n, np.int64)
        u_place[by_owner] = w_place[by_key] = np.arange(n)
        code, times = np.unique((u_place[u] * n + w_place[w]) * len(tokens) + doc, return_counts=True)
        pair = code // len(tokens)
        doc, times = code - pair * len(tokens), times.astype(np.uint32)
        pair_at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        pair = pair[pair_at]
        per_pair = np.diff(pair_at, append=len(code)).astype(np.uint32)
        pu = pair // n
        words = keys[by_key][pair - pu * n] >> np.uint64(64 - WORD_BITS)
        cuts = np.searchsorted(owner[by_owner][pu], np.arange(owners + 1))
        occ_cuts = np.append(pair_at, len(code))[cuts]
        contexts = keys[by_owner]
        at = np.empty(len(tokens), np.uint32)
        dk, di, dh = (np.array(x, t) for x, t in zip(zip(*docs, strict=True), (np.int64, np.int64, np.uint8), strict=True))
        for o in range(owners):
            mine, occ = slice(*cuts[o : o + 2]), slice(*occ_cuts[o : o + 2])
            us = pu[mine]
            if not len(us):
                continue
            first = np.flatnonzero(np.concatenate(([True], us[1:] != us[:-1])))
            has = np.zeros(len(tokens), bool)
            has[doc[occ]] = True
            some = np.flatnonzero(has)
            at[some] = np.arange(len(some))
            b = pack(gaps(contexts[us[first]]), np.diff(first, append=len(us)).astype(np.uint32), words[mine], per_pair[mine], at[doc[occ]], times[occ], gaps(dk[some]), gaps(di[some]), dh[some])
            yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([int(dk[0])], pa.int64()), pa.array([b], pa.binary())], names=["owner", "src", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, docs, n = _ids(), [], [], 0
        for b in batches:
            for key, i, held, text in zip(*(b.column(k) for k in range(4)), strict=True):
                words = (text.as_py() or b"").translate(LOWER).split()
                t = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                tokens.append(np.append(t, 1))
                i = i.as_py()
                docs.append((key.as_py(), i, held.as_py()) if i is not None else (key.as_py(), 0, held.as_py() + 2))
                n += len(words) + 1
                if n > FLUSH_TOKENS or len(ids) > FLUSH_WORDS or len(docs) >= FLUSH_DOCS:
                    yield from flush(ids, tokens, docs)
                    ids, tokens, docs, n = _ids(), [], [], 0
        if docs:
            yield from flush(ids, tokens, docs)

    return run


STATE = "owner int, packed binary, occurrences binary, train_tokens long, known_words long, ones long, twos long, pairs long, train_docs long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's rows become one: contexts, their pairs with training counts, and which
    document (by source and number) has which pair how often."""
    held: dict[int, list] = {}
    for b in batches:
        for o, src, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            held.setdefault(o, []).append((src, p.as_py()))
    for o, parts in held.items():
        parts.sort()
        us, un_, ws, occ_n, occ_doc, occ_count, docs, base = [], [], [], [], [], [], [], 0
        for src, p in parts:
            ug, un, w, per, doc, n, dk, di, dh = unpack(p)
            us.append(np.cumsum(ug, dtype=np.uint64))
            un_.append(un)
            ws.append(w)
            occ_n.append(per)
            occ_doc.append(doc.astype(np.int64) + base)
            occ_count.append(n)
            docs.append((np.full(len(dk), src, np.int64), np.cumsum(dk), np.cumsum(di), dh))
            base += len(dk)
        u, un, w, per, doc, n = (np.concatenate(x) for x in (us, un_, ws, occ_n, occ_doc, occ_count))
        src, dk, di, dh = (np.concatenate(x) for x in zip(*docs, strict=True))
        contexts, ui = np.unique(u, return_inverse=True)
        ui = np.repeat(ui, un)
        if len(contexts) < 1 << (64 - WORD_BITS):
            code, number = np.unique(ui.astype(np.uint64) << np.uint64(WORD_BITS) | w, return_inverse=True)
            ui, w = (code >> np.uint64(WORD_BITS)).astype(np.int64), code & np.uint64((1 << WORD_BITS) - 1)
        else:
            order = np.lexsort((w, ui))
            ui, w = ui[order], w[order]
            new = np.concatenate(([True], (ui[1:] != ui[:-1]) | (w[1:] != w[:-1])))
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            ui, w = ui[new], w[new]
        pair = np.repeat(number, per)
        train = (dh[doc] & 1) == 0
        c = np.bincount(pair[train], n[train], len(w)).astype(np.int64)
        cu = np.bincount(ui, c, len(contexts)).astype(np.int64)
        real = contexts != BEGIN
        by = np.argsort(pair, kind="stable")
        state = pack(gaps(contexts), np.bincount(ui, minlength=len(contexts)).astype(np.uint32), w, c.astype(np.uint32))
        occurrences = pack(np.bincount(pair, minlength=len(w)).astype(np.uint32), doc[by].astype(np.uint32), n[by], gaps(src), gaps(dk), gaps(di), dh)
        nums = [int(cu[real].sum()), int((cu[real] > 0).sum()), int((c == 1).sum()), int((c == 2).sum()), int((c > 0).sum()), int(cu[~real].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([state], pa.binary()), pa.array([occurrences], pa.binary()), *(pa.array([x], pa.int64()) for x in nums)], names=["owner", "packed", "occurrences", "train_tokens", "known_words", "ones", "twos", "pairs", "train_docs"])


class Restaurants:
    """Seating of many dishes at once. sizes: customers by dish; room: the restaurant of each
    dish. Every step moves one customer of each section of each dish, by the counts of the
    whole dish without them; all sections of a dish share its tables. dish, off, n and nt are
    those of dishes with several customers."""

    def __init__(self, sizes: np.ndarray, room: np.ndarray, rooms: int, discount: float, strength: float, rng):
        self.d, self.theta, self.rng, self.room = discount, strength, rng, room
        self.tables = (sizes > 0).astype(np.int64)
        self.dish = np.flatnonzero(sizes > 1)
        self.n = sizes[self.dish].astype(np.int64)
        self.off = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        self.z = np.zeros(total, np.int32)
        self.size = np.zeros(total, np.int32)
        self.size[self.off] = self.n
        self.free = (np.arange(total) - np.repeat(self.off, self.n)).astype(np.int32)
        self.nt = np.ones(len(self.n), np.int64)
        sections = -(-self.n // SECTION)
        of = np.repeat(np.arange(len(self.n)), sections)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(sections) - sections, sections)) * SECTION
        length = np.minimum(self.n[of] - start, SECTION)
        order = np.argsort(-length, kind="stable")
        self.of, self.length = of[order], length[order]
        # By section, in the order of the steps, of which each takes a leading part.
        self.base, self.count = self.off[self.of], self.n[self.of]
        self.first = self.base + start[order]
        self.whole, self.last = self.count // SECTION, self.count % SECTION
        self.total = np.bincount(room, self.tables, rooms)

    def sweep(self, parent: np.ndarray) -> None:
        """Every customer sits down anew; parent: the parent's probability by dish."""
        d, theta, rng = self.d, self.theta, self.rng
        room = self.room[self.dish]
        rooms, probability = room[self.of], parent[self.dish][self.of]
        shortest = -self.length
        for i in range(int(self.length[0]) if len(self.length) else 0):
            m = int(np.searchsorted(shortest, -i, "left"))
            of, o, n, r = self.of[:m], self.base[:m], self.count[:m], rooms[:m]
            at = self.first[:m] + i
            k = self.z[at]
            table = o + k
            np.subtract.at(self.size, table, ONE)
            self.z[at] = -1
            g = np.flatnonzero(self.size[table] == 0)
            slot, first = np.unique(table[g], return_index=True)
            g = of[g[first]]
            np.subtract.at(self.nt, g, 1)
            np.subtract.at(self.total, room[g], 1)
            self.free[self.off[g] + self.nt[g] + _rank(g)] = slot - self.off[g]
            moved = self.whole[:m] + (self.last[:m] > i)
            fresh = (theta + d * self.total[r]) * probability[:m]
            old = n - moved - d * self.nt[of]
            new = rng.random(len(of)) * (fresh + old) < fresh
            todo = np.flatnonzero(~new)
            while len(todo):
                t = self.z[o[todo] + (rng.random(len(todo)) * n[todo]).astype(np.int64)]
                s = self.size[o[todo] + t]
                ok = (t >= 0) & (rng.random(len(todo)) * s < s - d)
                k[todo[ok]] = t[ok]
                todo = todo[~ok]
            g = np.flatnonzero(new)
            g = g[np.argsort(of[g], kind="stable")]
            x = of[g]
            k[g] = self.free[o[g] + self.nt[x] + _rank(x)]
            np.add.at(self.nt, x, 1)
            np.add.at(self.total, room[x], 1)
            self.z[at] = k
            np.add.at(self.size, o + k, ONE)
        self.tables[self.dish] = self.nt


def _rank(x: np.ndarray) -> np.ndarray:
    """Of sorted numbers: how many equal ones stand before each."""
    new = np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))
    at = np.arange(len(x))
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(x) else at


class _Owner:
    """An owner's state, unpacked."""

    def __init__(self, packed: bytes, occurrences: bytes | None = None):
        ug, un, self.w, c = unpack(packed)
        self.contexts = np.cumsum(ug, dtype=np.uint64)
        self.ui = np.repeat(np.arange(len(un)), un)
        self.c = c.astype(np.int64)
        if occurrences:
            self.per, self.doc, self.times, src, dk, di, self.dh = unpack(occurrences)
            self.src, self.dk, self.di = np.cumsum(src), np.cumsum(dk), np.cumsum(di)
        self.cu = np.bincount(self.ui, self.c, len(un))
        self.words, self.wi = np.unique(self.w, return_inverse=True)

    def chain(self, owner: int, answers: list, g: dict) -> Iterator[tuple[Restaurants, np.ndarray]]:
        """The states of the chain: the first, and after each round of sweeps with one of the
        parent's answers. Deterministic, so that it can be run again rather than stored."""
        rng = np.random.default_rng((SEED, owner))
        r = Restaurants(self.c, self.ui, len(self.contexts), g["d"], STRENGTH, rng)
        yield r, None
        for a in answers:
            t, s = (np.concatenate(x) for x in zip(*(unpack(p) for p in a), strict=True))
            top, tables = g["tops"].pop(0)
            base = 1.0 / (g["V"] + 1)
            p1 = (np.maximum(t - g["d1"] * s, 0) + (ROOT_STRENGTH + g["d1"] * tables) * base) / (ROOT_STRENGTH + top)
            for _ in range(SWEEPS):
                r.sweep(p1[self.wi])
                yield r, p1


def _requests(owners: int, g: dict, rounds: int):
    """An owner's tables by word, in one row for each range of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = _Owner(row["packed"])
                r = None
                for r, _ in s.chain(row["owner"], [row[f"answer{k}"] for k in range(rounds)], g | {"tops": list(g["tops"])}):
                    pass
                t = np.bincount(s.wi, r.tables, len(s.words)).astype(np.int64)
                cuts = np.searchsorted((s.words >> np.uint64(WORD_BITS - 32)) * np.uint64(owners) >> np.uint64(32), np.arange(owners + 1))
                for o, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([row["owner"]], pa.int32()), pa.array([pack(gaps(s.words[x:y]), t[x:y])], pa.binary())], names=["word_owner", "owner", "packed"])

    return run


def _parent(g: dict, turn: int):
    """The parent's dishes of a range of words: customers from all owners, seated; each owner
    gets the customers and tables of its words. top and tables: sums over the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for o, owner, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                held.setdefault(o, []).append((owner, p.as_py()))
        for o, parts in held.items():
            parts.sort()
            asked = [(owner, (lambda x: (np.cumsum(x[0], dtype=np.uint64), x[1]))(unpack(p))) for owner, p in parts]
            words, at = np.unique(np.concatenate([x[0] for _, x in asked]), return_inverse=True)
            t = np.bincount(at, np.concatenate([x[1] for _, x in asked]), len(words)).astype(np.int64)
            rng = np.random.default_rng((SEED, turn, o))
            # All ranges are one restaurant; its tables elsewhere are taken as one a word.
            r = Restaurants(t, np.zeros(len(words), np.int64), 1, g["d1"], ROOT_STRENGTH, rng)
            r.total = r.total + max(0, g["V"] - int((t > 0).sum()))
            for _ in range(SWEEPS):
                r.sweep(np.full(len(words), 1.0 / (g["V"] + 1)))
            done = 0
            for k, (owner, x) in enumerate(asked):
                mine = at[done : done + len(x[0])]
                done += len(mine)
                sums = (int(t.sum()), int(r.tables.sum()), int((t == 1).sum()), int((t == 2).sum())) if not k else (0, 0, 0, 0)
                yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int32()), pa.array([o], pa.int32()), pa.array([pack(t[mine], r.tables[mine])], pa.binary()), *(pa.array([v], pa.int64()) for v in sums)], names=["owner", "word_owner", "packed", "top", "tables", "ones", "twos"])

    return run


def _scores(g: dict, rounds: int):
    """An owner's part of each document's sums, packed by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = _Owner(row["packed"], row["occurrences"])
                p = np.zeros(len(s.w))
                states = list(range(1 + SWEEPS * rounds))[-SAMPLES:]
                for k, (r, p1) in enumerate(s.chain(row["owner"], [row[f"answer{k}"] for k in range(rounds)], g | {"tops": list(g["tops"])})):
                    if k in states:
                        cu, tu = s.cu[s.ui], r.total[s.ui]
                        inner = (s.c - g["d"] * r.tables + (STRENGTH + g["d"] * tu) * p1[s.wi]) / (STRENGTH + cu)
                        p += np.where(cu > 0, inner, p1[s.wi]) / len(states)
                pair = np.repeat(np.arange(len(s.w)), s.per)
                n = s.times.astype(np.float64)
                # Every token but a text's end is the context of another: its count is cu.
                token = s.contexts[s.ui[pair]] != BEGIN
                c = s.cu[s.ui[pair]]
                m = len(s.dk)
                add = lambda v: np.bincount(s.doc, v, m)
                # The end token is counted with the text's begin, which each text has once.
                base = np.where(token, np.log10(c + 0.5), math.log10(g["train_docs"] + 0.5))
                cols = add(n), add(n * np.where(token, c > 0, g["train_docs"] > 0)), add(n * base), add(n * np.log10(p)[pair])
                for src in np.unique(s.src):
                    x = np.flatnonzero(s.src == src)
                    yield pa.RecordBatch.from_arrays([pa.array([int(src)], pa.int64()), pa.array([row["owner"]], pa.int32()), pa.array([pack(gaps(s.dk[x]), gaps(s.di[x]), s.dh[x], cols[0][x].astype(np.uint32), cols[1][x].astype(np.uint32), cols[2][x], cols[3][x])], pa.binary())], names=["src", "owner", "packed"])

    return run


RESULT = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _add_up(g: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for src, owner, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                held.setdefault(src, []).append((owner, p.as_py()))
        for src in sorted(held):
            parts = [unpack(p) for _, p in sorted(held[src])]
            dk = np.concatenate([np.cumsum(x[0]) for x in parts])
            keys, first, at = np.unique(dk, return_index=True, return_inverse=True)
            di = np.concatenate([np.cumsum(x[1]) for x in parts])[first]
            dh = np.concatenate([x[2] for x in parts])[first]
            n, known, base, score = (np.bincount(at, np.concatenate([x[k] for x in parts]), len(keys)) for k in range(3, 7))
            base = base - n * math.log10(g["N"] + 0.5 * (g["V"] + 1))
            yield pa.RecordBatch.from_arrays([pa.array(di, pa.int64(), mask=dh >= 2), pa.array((dh & 1) == 1), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _bucketed(df: DataFrame, owners: int, name: str, stack: ExitStack) -> DataFrame:
    """df as a table of one bucket for each owner, in the shared folder; the stack drops it."""
    spark = df.sparkSession
    table = f"marquee_{name}_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, name)
    stack.callback(drop_path, spark, path)
    stack.callback(spark.sql, f"DROP TABLE IF EXISTS {table}")
    df.repartition(owners, "owner").write.bucketBy(owners, "owner").option("path", path).saveAsTable(table)
    return spark.table(table)


def discount(ones: int, twos: int) -> float:
    """From how many things were seen once and twice."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def language_scores(docs: DataFrame, held_out_of: int = 5, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, held_out (crc32 of its id has remainder 1: not learnt
    from), n_tokens, n_known (tokens that occur in training), train_tokens, base_score (of the
    smoothed unigram model) and score, both log10 probabilities of the whole text. Perplexity
    is 10 ** (-score / n_tokens).

    Tokens are the words between ASCII white space, A-Z lowered, and one end. A null text is
    empty: one token. Rows that repeat an id are scored on their own, a null id counts as the
    empty text for held_out. Without training rows every word is unknown. Other columns are
    not read; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), (crc_mod(id_col, held_out_of) == 1).cast("int").alias("held"), F.col(text_col).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNER_BYTES))
    # The tables go when scoring has ended, be it by an error.
    with ExitStack() as stack:
        sent = rows.mapInArrow(_pairs_out(owners), "owner int, src long, packed binary")
        state = _bucketed(sent.repartition(owners, "owner").mapInArrow(_merge, STATE), owners, "contexts", stack)
        s = state.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train_tokens", "known_words", "ones", "twos", "pairs", "train_docs"))).first()
        g = {"N": s.train_tokens + s.train_docs, "V": s.known_words + (s.train_docs > 0), "train_docs": s.train_docs, "d": discount(s.ones, s.twos), "d1": 0.7, "tops": []}
        free_shuffles(spark)
        joined = state.select("owner", "packed", "occurrences")
        for turn in range(rounds):
            asked = joined.drop("occurrences").mapInArrow(_requests(owners, g, turn), "word_owner int, owner int, packed binary").repartition(owners, "word_owner")
            answers = materialise(asked.mapInArrow(_parent(g, turn), "owner int, word_owner int, packed binary, top long, tables long, ones long, twos long"), "parent")
            a = answers.agg(F.sum("top"), F.sum("tables"), F.sum("ones"), F.sum("twos")).first()
            g["tops"].append((a[0] or 0, a[1] or 0))
            lists = answers.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("word_owner", "packed"))).alias("x")).select("owner", F.transform("x", lambda v: v["packed"]).alias(f"answer{turn}"))
            answer = _bucketed(lists, owners, f"answer{turn}", stack)
            drop_path(spark, answers.scratch)
            free_shuffles(spark)
            joined = joined.join(answer.hint("merge"), "owner")
        parts = joined.mapInArrow(_scores(g, rounds), "src long, owner int, packed binary")
        out = materialise(parts.repartition(owners, "src").mapInArrow(_add_up(g), RESULT), "lm-scores")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(g["N"]).cast("long").alias("train_tokens"), "base_score", "score")
