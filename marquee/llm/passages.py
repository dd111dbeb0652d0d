"""Near-duplicate passages by compact windows.

Under a hash function, all subsequences of a text with the same least element form a compact
window (l, c, r): they contain c and stay within l and r. The windows are the nodes of the
Cartesian tree over the hashes; those of at least the least passage length are kept, about
2n / length of them in a text of n. A window's key is its least element: equal passages have
the same under every hash function, near ones under most, wherever words were put in or left
out. With it go bits of the 22 elements on either side.

Equal keys meet at the key's owner. Each row is compared with the first of its key, if their
bits allow a passage. Where rows are left that this does not join, the owner asks for the
elements around the rows of the key. Rows that share a passage there share one of their rarest
elements (the prefix filter of set joins, by how often the key's rows have an element), so a
frequent line brings no pairs; of those that do, pairs not yet joined by others are compared. The
widest intervals around the joined elements that are similar enough are the passages.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import drop_path, free_shuffles, materialise
from marquee.llm.partenum import GOLD, LOWER, WordHashes, mix

SHINGLE, HASHES, LEAST_WORDS = 5, 5, 50
SIMILARITY = 0.8
#: Bytes of rows that a map task holds before it sends them (sorting and packing takes about
#: four times as many, 40 MB a worker), texts whose keys it remembers, and bytes of text for
#: each owner of keys.
SEND_BYTES, SEEN, OWNER_BYTES = 8 << 20, 200_000, 8 << 20
BROADCAST_ROWS = 500_000

#: Common bits of the 22 elements on one side that rows of a key need to be compared, by either
#: hash, with its first row and with the others. A least passage has one edit of a word or two,
#: which leaves 16 of them.
COMMON_BITS, REST_BITS = 9, 11
#: Rows of a key up to which each needs enough bits in common with another for its elements to be
#: asked for; of larger keys, those of all rows are.
LARGE = 1024
#: Rows of a key beyond which bits are compared by blocks, pairs of a block, and elements asked
#: for on either side of a row.
BLOCK_ROWS, BLOCK_PAIRS, REACH = 64, 500_000, 50
#: Beyond all numbers of elements.
FAR = np.int64(1) << 40

SCHEMA = pa.schema([("owner", pa.int32()), *((c, pa.int64()) for c in ("id", "text_hash", "node", "words")), ("packed", pa.binary())])
ROWS = "owner int, id long, text_hash long, node long, words long, packed binary"
LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ca", pa.int32()), ("cb", pa.int32()), ("key", pa.int64())])
LINKS = "a long, b long, ca int, cb int, key long"
OWNED_SCHEMA = pa.schema([*SCHEMA, *LINK_SCHEMA])
OWNED = f"{ROWS}, {LINKS}"


def sequence(text: bytes | None, n: int, memo: WordHashes) -> tuple[np.ndarray, int]:
    """Hashes of a text's n-word shingles in order, and its number of words."""
    words = text.translate(LOWER).split() if text else ()
    if len(words) < n:
        return np.empty(0, np.uint64), len(words)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    s = h[: len(h) - n + 1]
    for i in range(1, n):
        s = mix(s * GOLD + h[i : len(h) - n + 1 + i])
    return mix(s), len(words)


def _text_key(s: np.ndarray) -> int:
    """A 63-bit key of a sequence."""
    placed = mix(s + mix(np.arange(len(s), dtype=np.uint64)))
    whole = np.array([np.bitwise_xor.reduce(placed), len(s)], np.uint64)
    return int(mix(mix(whole[:1]) + whole[1:])[0] >> np.uint64(1))


def compact_windows(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of all windows of `least` elements or more; r is the last element. Of equal
    least elements the first counts, so that equal passages have it at the same place."""
    out, todo = [], [(0, len(h))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        part = h[a:b]
        for c in (a + np.flatnonzero(part == part.min())).tolist():
            if b - a >= least:
                out.append((a, c, b - 1))
            todo.append((a, c))
            a = c + 1
        todo.append((a, b))
    return out


def least_places(h: np.ndarray, least: int) -> np.ndarray:
    """The places c of compact_windows(), by running minima; hashes count by 32 bits. Of several
    rows of hashes, the places of all."""
    v, n = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(h.shape[-1], dtype=np.uint64), 1
    while n < least:
        k = min(n, least - n)
        v = np.minimum(v[..., :-k], v[..., k:])
        n += k
    held = np.zeros(h.shape[-1], bool)
    held[(v & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return np.flatnonzero(held)


def _contexts(s: np.ndarray, reach: int) -> np.ndarray:
    """Bits of the `reach` elements before and behind each place, by two hashes."""
    out = np.empty((len(s), 4), np.uint64)
    for k, shift in enumerate((58, 52)):
        bits = np.uint64(1) << (s >> np.uint64(shift) & np.uint64(63))
        runs, n = np.concatenate((np.zeros(reach, np.uint64), bits, np.zeros(reach + 1, np.uint64))), 1
        while n < reach:
            m = min(n, reach - n)
            runs = runs | np.concatenate((runs[m:], np.zeros(m, np.uint64)))
            n += m
        out[:, 2 * k], out[:, 2 * k + 1] = runs[: len(s)], runs[reach + 1 : reach + 1 + len(s)]
    return out


def window_keys(s: np.ndarray, least: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least elements of a sequence's windows, their places, and the bits of what is
    before and behind. Of places of one element that agree in all that a least passage around
    them can hold, the first stands for the others."""
    if len(s) < least:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty((0, 4), np.uint64)
    places = least_places(mix(s ^ (np.arange(1, hashes + 1, dtype=np.uint64)[:, None] * GOLD)), least)
    key = np.sort(s[places])
    if (key[1:] == key[:-1]).any():
        _, at, count = np.unique(s[places], return_inverse=True, return_counts=True)
        had, keep = set(), np.ones(len(places), bool)
        for i in np.flatnonzero(count[at] > 1):
            p = int(places[i])
            around = (s[max(0, p - least) : p].tobytes(), s[p : p + least + 1].tobytes())
            keep[i] = around not in had
            had.add(around)
        places = places[keep]
    return s[places], places.astype(np.int32), _contexts(s, (least - 1) // 2)[places]


def _may_link(bits, p, q, least):
    """Whether enough of the elements on one side of rows p and q can be equal."""
    same = np.bitwise_count(bits[p] & bits[q]) >= least
    return (same[:, 0] & same[:, 2]) | (same[:, 1] & same[:, 3])


def _leads(key):
    """Of rows sorted by key: where the first of each one's key is."""
    new = np.concatenate(([True], key[1:] != key[:-1]))
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _hub_pairs(key, node, bits) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are compared with which first row of their key, their hub."""
    lead = _leads(key)
    p = np.flatnonzero(node != node[lead])
    p = p[_may_link(bits, p, lead[p], COMMON_BITS)]
    return p, lead[p]


def _joined(key, node, place, bits, lost: set) -> np.ndarray:
    """Which rows are joined to their hub. lost: key, node and place of the rows whose link to
    it failed."""
    lead = _leads(key)
    out = node == node[lead]
    p, _ = _hub_pairs(key, node, bits)
    out[p] = [x not in lost for x in zip(key[p].view(np.int64).tolist(), node[p].tolist(), place[p].tolist(), strict=True)]
    return out


def _wanted(key, node, bits, joined) -> np.ndarray:
    """Rows whose elements are asked for: those that may link to another that their hub does not
    join them to, by their bits; of large keys, all."""
    lead = _leads(key)
    size = np.bincount(lead, minlength=len(key))
    loose = np.bincount(lead[~joined], minlength=len(key)) > 0
    want = (size > LARGE)[lead] & loose[lead]

    def mark(p, q):
        ok = ~(joined[p] & joined[q]) & (node[p] != node[q])
        p, q = p[ok], q[ok]
        ok = _may_link(bits, p, q, REST_BITS)
        want[p[ok]] = want[q[ok]] = True

    before, behind = np.ascontiguousarray(bits[:, 0]), np.ascontiguousarray(bits[:, 1])
    for a in np.flatnonzero((size > BLOCK_ROWS) & (size <= LARGE) & loose):
        end, i = a + size[a], a
        while i < end:
            j = min(end, i + max(1, BLOCK_PAIRS // (end - i)))
            p, q = np.nonzero((np.bitwise_count(before[i:j, None] & before[None, i:end]) >= REST_BITS) | (np.bitwise_count(behind[i:j, None] & behind[None, i:end]) >= REST_BITS))
            mark(i + p[p < q], i + q[p < q])
            i = j
    at = np.flatnonzero((size <= BLOCK_ROWS)[lead] & loose[lead])
    for shift in range(1, BLOCK_ROWS):
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        if not len(at):
            break
        mark(at, at + shift)
    return np.flatnonzero(want)


def elements_around(s: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The REACH elements on either side of each place and its own; 0 beyond the ends."""
    wide = np.concatenate((np.zeros(REACH, np.uint32), np.maximum(s, 1), np.zeros(REACH, np.uint32)))
    return wide[places[:, None] + np.arange(2 * REACH + 1)]


def _ranks(lead: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements around each row by number, rarest among its key's rows first, without
    repeats; and as they stand."""
    _, at, count = np.unique(lead.astype(np.uint64)[:, None] << np.uint64(32) | around, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    at = rank[at.reshape(around.shape)]
    out = np.where(around > 0, at, FAR)
    out.sort(axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = FAR
    out.sort(axis=1)
    return out, at


def _least_distinct(around: np.ndarray, least: int) -> np.ndarray:
    """How many different elements any `least` of a text hold at least that hold the row's."""
    n, mid = around.shape[1], around.shape[1] // 2
    out = np.full(len(around), least)
    ordered = np.sort(around, axis=1)
    for lo in range(0, len(around), 2000):
        own = lo + np.flatnonzero(((ordered[lo : lo + 2000, 1:] == ordered[lo : lo + 2000, :-1]) & (ordered[lo : lo + 2000, 1:] > 0)).any(axis=1))
        for i in range(max(0, mid - least + 1), min(mid, n - least) + 1) if len(own) else ():
            part = np.sort(around[own, i : i + least], axis=1)
            held = 1 + (part[:, 1:] != part[:, :-1]).sum(axis=1)
            out[own] = np.minimum(out[own], np.where(part[:, 0] > 0, held, least))
    return out


def _balance(match: np.ndarray, least: int, share: float) -> np.ndarray:
    """For rows of matches how many there are; 0 where no interval of `least` elements or more
    that holds the middle has enough of them."""
    mid, out = match.shape[1] // 2, match.sum(axis=1)
    start = np.arange(mid + 1)
    start = start[start + least <= match.shape[1]]
    at = np.flatnonzero(out)
    for lo in range(0, len(at), 2000):
        own = at[lo : lo + 2000]
        sums = np.zeros((len(own), match.shape[1] + 1), np.float32)
        np.cumsum(np.where(match[own], np.float32(1), np.float32(-share / (1 - share))), axis=1, out=sums[:, 1:])
        most = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
        out[own[~(most[:, np.maximum(start + least, mid + 1)] >= sums[:, start] - 1e-3).any(axis=1)]] = 0
    return out


def forest(key, node, joined, around, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows of a key that have a passage in common, sorted by key: as many as join all
    rows that such links connect, but for those that the joined rows of a key have already."""
    lead, n, share = _leads(key), len(key), 2 * similarity / (1 + similarity)
    mid = around.shape[1] // 2
    root = np.arange(n)
    first: dict[int, int] = {}
    for i in np.flatnonzero(joined).tolist():
        root[i] = first.setdefault(int(lead[i]), i)
    links: list[tuple[int, int]] = []

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(i, j):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((i, j))

    def roots():
        nonlocal root
        while (root[root] != root).any():
            root = root[root]
        return root

    # Rows that have `least` elements around them in common, at one place, are joined.
    for i in range(max(0, mid - least + 1), mid + 1, 3):
        whole = np.flatnonzero((around[:, i] > 0) & (around[:, i + least - 1] > 0))
        h = mix(lead[whole].astype(np.uint64) + GOLD)
        for k in range(i, i + least):
            h = (h ^ around[whole, k]) * GOLD
            h ^= h >> np.uint64(29)
        _, at, own = np.unique(h, return_index=True, return_inverse=True)
        top, now = whole[at[own]], roots()
        for p, q in zip(*(x[now[top] != now[whole]].tolist() for x in (whole, top)), strict=True):
            join(q, p)
    # Of those with the same elements all around them, the first stands for the others.
    same: dict[tuple, int] = {}
    alone = np.ones(n, bool)
    for i, (k, b) in enumerate(zip(lead.tolist(), map(bytes, around), strict=True)):
        j = same.setdefault((k, b), i)
        if j != i:
            alone[i] = False
            join(j, i)
    rows = np.flatnonzero(alone)
    ranks, numbers = _ranks(lead[rows], around[rows])
    distinct = _least_distinct(around[rows], least)
    some = np.ceil(share * distinct - 1e-6).astype(np.int64)
    # The rarest elements, of which rows with so many in common share one.
    count = (ranks < FAR).sum(axis=1)
    r, c = np.nonzero(np.arange(ranks.shape[1]) < (count - some + 1)[:, None])
    o = np.argsort(ranks[r, c], kind="stable")
    element, r = ranks[r, c][o], r[o]
    flag = np.zeros(int(numbers.max(initial=0)) + 1, bool)

    def compare(p: int, others: np.ndarray):
        """Joins row p to those of the others with which it has a passage."""
        own = numbers[p][around[rows[p]] > 0]
        flag[own] = True
        match = flag[numbers[others]]
        flag[own] = False
        held = _balance(match, least, share)
        i = int(rows[p])
        # Those with most in common come first, as what they join need not be compared.
        for k in np.argsort(-held, kind="stable")[: np.count_nonzero(held)].tolist():
            j = int(rows[others[k]])
            if find(i) != find(j):
                (x, cx), (y, cy) = (_held(around[k], mid) for k in (i, j))
                if similar_intervals(x, y, [(cx, cy)], least, similarity):
                    join(i, j)

    def open_lists():
        """Rows of each element whose rows are not joined yet."""
        nonlocal element, r
        if not len(element):
            return
        top = _leads(element)
        now = roots()[rows]
        other = np.bincount(top[now[r] != now[r[top]]], minlength=len(element)) > 0
        element, r = element[other[top]], r[other[top]]

    open_lists()
    # The first row of each element is compared with its others; then all rows with theirs but
    # those that are in the largest part of their key.
    top = _leads(element)
    pairs = np.unique(r[top] * len(rows) + r) if len(element) else np.empty(0, np.int64)
    p, q = np.divmod(pairs, max(1, len(rows)))
    cuts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True]))) if len(p) else ()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        others = q[a:b]
        now = roots()
        others = others[(now[rows[others]] != now[rows[p[a]]]) & (node[rows[others]] != node[rows[p[a]]])]
        if len(others):
            compare(int(p[a]), others)
    open_lists()
    if len(element):
        now = roots()[rows]
        part = np.bincount(now, minlength=n)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, lead[rows], part[now] * n + now)
        top, end = np.flatnonzero(_leads(element) == np.arange(len(element))), np.append(np.flatnonzero(element[1:] != element[:-1]) + 1, len(element))
        o = np.argsort(r, kind="stable")
        lists = (np.cumsum(np.concatenate(([True], element[1:] != element[:-1]))) - 1)[o]
        cuts = np.flatnonzero(np.concatenate(([True], r[o][1:] != r[o][:-1], [True])))
        done = np.zeros(len(rows), bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p = int(r[o[a]])
            if most[lead[rows[p]]] % n == now[p]:
                continue
            done[p] = True
            others = np.unique(np.concatenate([r[top[k] : end[k]] for k in lists[a:b].tolist()]))
            others, at = others[~done[others]], roots()
            others = others[(at[rows[others]] != at[rows[p]]) & (node[rows[others]] != node[rows[p]])]
            if len(others):
                compare(p, others)
    out = np.array(links, np.int64).reshape(-1, 2)
    out = out[node[out[:, 0]] != node[out[:, 1]]]
    return out[:, 0], out[:, 1]


def _held(around: np.ndarray, mid: int) -> tuple[np.ndarray, int]:
    """The elements around a row that its text has, and the row's place among them."""
    inside = np.flatnonzero(around)
    return around[inside[0] : inside[-1] + 1], mid - int(inside[0])


def _link_rows(key, node, place, p, q) -> Iterator[pa.RecordBatch]:
    """Links of rows p and q."""
    for i in range(0, len(p), 20_000):
        x, y = p[i : i + 20_000], q[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y]), pa.array(place[x]), pa.array(place[y]), pa.array(key[x].view(np.int64))], schema=LINK_SCHEMA)


def _planes(x: np.ndarray) -> bytes:
    w = x.dtype.itemsize
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, w)[:, k]).tobytes() for k in range(w))


def _unplanes(b: bytes, at: int, n: int, dtype) -> np.ndarray:
    w = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, w * n, at).reshape(w, n).T).view(dtype).reshape(-1)


def _pack(key: np.ndarray, node: np.ndarray, place: np.ndarray, bits: np.ndarray) -> bytes:
    """Rows sorted by key, by byte planes: gaps of keys, numbers of nodes, places, bits."""
    nodes, at = np.unique(node, return_inverse=True)
    gaps = np.diff(key, prepend=np.zeros(1, np.uint64))
    return struct.pack("<II", len(key), len(nodes)) + nodes.tobytes() + _planes(gaps) + _planes(at.astype(np.uint32)) + _planes(place) + bits.tobytes()


def _unpack(b: bytes):
    n, m = struct.unpack_from("<II", b)
    nodes = np.frombuffer(b, np.int64, m, 8)
    at = 8 + 8 * m
    key, number, place = _unplanes(b, at, n, np.uint64), _unplanes(b, at + 8 * n, n, np.uint32), _unplanes(b, at + 12 * n, n, np.int32)
    return np.cumsum(key, dtype=np.uint64), nodes[number], place, np.frombuffer(b, np.uint64, 4 * n, at + 16 * n).reshape(n, 4)


def _windows(docs: DataFrame, id_col: str, text_col: str, n: int, least: int, hashes: int, owners: int) -> DataFrame:
    def send(held: list) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        owner = (cols[0] % np.uint64(owners)).astype(np.int64)
        o = np.lexsort((cols[0], owner))
        cols, owner = [c[o] for c in cols], owner[o]
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        one = pa.nulls(1, pa.int64())
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([owner[a]], pa.int32()), one, one, one, one, pa.array([_pack(*(c[a:b] for c in cols))], pa.binary())], schema=SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, held, size, done = WordHashes(), set(), [], 0, 0
        for b in batches:
            nodes, words = [], []
            for t in b.column(1):
                s, k = sequence(t.as_py(), n, memo)
                node = _text_key(s)
                nodes.append(node)
                words.append(k)
                if len(s) < least or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen = set()
                seen.add(node)
                key, place, bits = window_keys(s, least, hashes)
                held.append((key, np.full(len(key), node, np.int64), place, bits))
                size += 52 * len(key)
                if size > SEND_BYTES:
                    yield from send(held)
                    held, size = [], 0
            m = len(nodes)
            turn = (done + np.arange(m)) % owners
            done += m
            yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), b.column(0), b.column(2), pa.array(nodes, pa.int64()), pa.array(words, pa.int64()), pa.nulls(m, pa.binary())], schema=SCHEMA)
        if held:
            yield from send(held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, ROWS)


def _grouped(parts: list) -> tuple:
    """Rows of one owner, sorted by key, node and place; keys of a single row are left out."""
    cols = [np.concatenate(x) for x in zip(*map(_unpack, parts), strict=True)]
    o = np.lexsort((cols[2], cols[1], cols[0]))
    key = cols[0][o]
    same = key[1:] == key[:-1]
    o = o[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    return tuple(c[o] for c in cols)


def _owned(rows: DataFrame, owners: int) -> DataFrame:
    """Rows of texts as they are; the packed rows of each owner; and links of the rows of each
    key with its first row."""

    def wide(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(f.name) if f.name in b.schema.names else pa.nulls(len(b), f.type) for f in OWNED_SCHEMA], schema=OWNED_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            text = b.column(5).is_null()
            yield wide(b.filter(text))
            b = b.filter(pc.invert(text))
            for o, p in zip(b.column(0).to_pylist(), b.column(5), strict=True):
                held.setdefault(o, []).append(p.as_py())
        while held:
            owner, parts = held.popitem()
            key, node, place, bits = _grouped(parts)
            if not len(key):
                continue
            one = pa.nulls(1, pa.int64())
            yield wide(pa.RecordBatch.from_arrays([pa.array([owner], pa.int32()), one, one, one, one, pa.array([_pack(key, node, place, bits)], pa.binary())], schema=SCHEMA))
            p, hub = _hub_pairs(key, node, bits)
            for x in _link_rows(key, node, place, p, hub):
                yield wide(x)

    return rows.repartition(owners, "owner").mapInArrow(run, OWNED)


def _asked(rows: DataFrame, failed: DataFrame, owners: int) -> DataFrame:
    """Rows of a key whose elements its owner asks for. failed: the owner, key, node and place of
    the rows whose link to their hub failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        lost: dict[int, set] = {}
        for b in batches:
            for o, p, key, a, ca in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if p is None:
                    lost.setdefault(o, set()).add((key, a, ca))
                else:
                    held.setdefault(o, []).append(p)
        while held:
            owner, parts = held.popitem()
            key, node, place, bits = _grouped(parts)
            joined = _joined(key, node, place, bits, lost.pop(owner, set()))
            at = _wanted(key, node, bits, joined)
            for i in range(0, len(at), 20_000):
                x = at[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(key[x].view(np.int64)), pa.array(place[x]), pa.array(joined[x])], names=["node", "key", "place", "joined"])

    none = F.lit(None).cast("long")
    sent = rows.where(F.col("packed").isNotNull()).select("owner", "packed", none.alias("key"), none.alias("a"), F.lit(None).cast("int").alias("ca"))
    sent = sent.union(failed.select("owner", F.lit(None).cast("binary"), "key", "a", "ca"))
    return sent.repartition(owners, "owner").mapInArrow(run, "node long, key long, place int, joined boolean")


def _other_links(asked: DataFrame, owners: int, least: int, similarity: float) -> DataFrame:
    """Links between rows of a key that are not joined by its hub. asked: node, its elements and
    the rows of it that were asked for."""

    def send(held: list) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        owner = (cols[0] % np.uint64(owners)).astype(np.int32)
        o = np.argsort(owner, kind="stable")
        cols, owner = [c[o] for c in cols], owner[o]
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        packs = [b"".join(c[a:b].tobytes() for c in cols) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for p, o in zip(packs, owner[cuts[:-1]].tolist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([p], pa.binary())], names=["owner", "packed"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            nodes, lists = b.column(0).to_numpy(), b.column(2)
            at, flat = lists.offsets.to_numpy(), lists.flatten()
            at = at - at[0]
            key, place, joined = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for i, x in enumerate(b.column(1)):
                own = slice(at[i], at[i + 1])
                around = elements_around(np.frombuffer(x.as_py(), np.uint32), place[own])
                held.append((key[own].view(np.uint64), np.full(len(around), nodes[i], np.int64), place[own].astype(np.int32), joined[own].astype(bool), around))
                size += around.nbytes
                if size > SEND_BYTES:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for o, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(o, []).append(p.as_py())
        kinds = ((np.uint64, 1), (np.int64, 1), (np.int32, 1), (bool, 1), (np.uint32, 2 * REACH + 1))
        each = sum(np.dtype(t).itemsize * k for t, k in kinds)
        while held:
            cols: list[list] = [[] for _ in kinds]
            for p in held.popitem()[1]:
                n, at = len(p) // each, 0
                for c, (t, k) in zip(cols, kinds, strict=True):
                    c.append(np.frombuffer(p, t, n * k, at).reshape((n, k) if k > 1 else n))
                    at += n * k * np.dtype(t).itemsize
            key, node, place, joined, around = map(np.concatenate, cols)
            o = np.lexsort((place, node, key))
            key, node, place, joined, around = (c[o] for c in (key, node, place, joined, around))
            p, q = forest(key, node, joined, around, least, similarity)
            yield from _link_rows(key, node, place, q, p)

    sent = asked.mapInArrow(gather, "owner int, packed binary")
    return sent.repartition(owners, "owner").mapInArrow(run, LINKS)


def _around(match: np.ndarray, c: int, similarity: float, widest: bool = False) -> tuple[int, int]:
    """The interval around c whose matches outweigh its other elements most; or the widest in
    which they do at all."""
    share = 2 * similarity / (1 + similarity)
    gain = np.where(match, 1.0, -share / (1 - share))
    left, right = np.cumsum(gain[: c + 1][::-1]), np.cumsum(gain[c:]) - gain[c]
    if not widest:
        return c - int(np.argmax(left)), c + int(np.argmax(right))
    # For every left end, the last right end that still balances it: by the greatest weight
    # from each right end on, which falls towards the end of the text.
    most = np.maximum.accumulate(right[::-1])
    j = len(right) - 1 - np.searchsorted(most, -left - 1e-9)
    width = np.where(j >= 0, np.arange(len(left)) + j, -1)
    k = int(np.argmax(width))
    return (c - k, c + int(j[k])) if width[k] >= 0 else (c, c)


def _cut(match: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """The interval without what does not match at its ends."""
    inside = np.flatnonzero(match[i : j + 1])
    return (i + int(inside[0]), i + int(inside[-1])) if len(inside) else (i, j)


def _padded(i: int, j: int, n: int, least: int) -> tuple[int, int]:
    """The interval, of `least` elements at least where the n elements allow it: a passage may
    be edited at its very ends."""
    i = max(0, min(i, j + 1 - least))
    return i, min(n - 1, max(j, i + least - 1))


def _run(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading elements of x and y are equal."""
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    return int(differ.argmax()) if differ.any() else n


@functools.cache
def _table(bits: int) -> np.ndarray:
    return np.zeros(1 << bits, bool)


def _maybe_within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """np.isin(x, y), and a few elements of x more: by the last bits of hashes."""
    bits = min(22, max(16, len(y).bit_length() + 6))
    table, last = _table(bits), np.uint32((1 << bits) - 1)
    at = y & last
    table[at] = True
    out = table[x & last]
    table[at] = False
    return out


def _covered(match: np.ndarray, least: int, similarity: float) -> np.ndarray | None:
    """The places that some interval of `least` elements or more holds in which matches balance
    the others, None if there are no such: around no other place is the widest interval of
    _around() long enough. (Sums from the text's start round otherwise than sums from a place,
    so the balance is looser.)"""
    share = 2 * similarity / (1 + similarity)
    if np.count_nonzero(match) < share * least - 1e-6:
        return None
    n = len(match)
    sums = np.zeros(n + 1)
    np.cumsum(np.where(match, 1.0, -share / (1 - share)), out=sums[1:])
    # The last end that balances each start: by the greatest sum from each end on.
    most = np.maximum.accumulate(sums[::-1])[::-1]
    start = np.flatnonzero(most[least:] >= sums[: max(0, n + 1 - least)] - 1e-6)
    if not len(start):
        return None
    end = n - np.searchsorted(most[::-1], sums[start] - 1e-6)
    steps = np.zeros(n + 1, np.int64)
    steps[start] = 1
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:n]) > 0


def _flags(numbers: np.ndarray, n: int) -> np.ndarray:
    """Which of 0 to n - 1 are among the numbers."""
    out = np.zeros(n, bool)
    out[numbers] = True
    return out


def similar_intervals(x: np.ndarray, y: np.ndarray, places, least: int, similarity: float) -> list[tuple]:
    """(start, end, start, end, Jaccard) of maximal passages of x and y around joined places."""
    out: list[tuple] = []
    for side, (s, t) in enumerate(((x, y), (y, x))):
        held = _covered(_maybe_within(s, t), least, similarity)
        places = [p for p in places if held[p[side]]] if held is not None else []
        if not places:
            return out
    # Elements by number: what is in what is then a look into a table.
    u, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    x, y, u = at[: len(x)], at[len(x) :], len(u)
    in_x = _flags(y, u)[x]
    shares: dict[tuple, float] = {}
    for cx, cy in places:
        if any(i <= cx <= j and k <= cy <= m for i, j, k, m, _ in out):
            continue
        # The widest interval holds all others: where it is too short, so are they.
        i, j = _around(in_x, cx, similarity, True)
        if j - i + 1 < least:
            continue
        in_y = _flags(x[i : j + 1], u)[y]
        k, m = _around(in_y, cy, similarity, True)
        if m - k + 1 < least:
            continue
        # The heaviest interval, else the widest between matches, else the same against what the
        # other text's interval has, each padded to the least length; else all of the widest.
        core = (*_cut(in_x, i, j), *_cut(in_y, k, m))
        again = _flags(y[core[2] : core[3] + 1], u)[x]
        tight = (*_cut(again, *_around(again, cx, similarity, True)), core[2], core[3])
        a, b = _around(in_x, cx, similarity)
        heavy = (a, b, *_around(_flags(x[a : b + 1], u)[y], cy, similarity))
        tries = [(*_padded(*t[:2], len(x), least), *_padded(*t[2:], len(y), least)) for t in (heavy, core, tight)]
        tries.append((i, j, k, m))
        back = _run(x[: cx + 1][::-1], y[: cy + 1][::-1])
        ahead = _run(x[cx:], y[cy:])
        for i, j, k, m in (*tries, (cx - back + 1, cx + ahead - 1, cy - back + 1, cy + ahead - 1)):
            if min(j - i, m - k) + 1 < least:
                continue
            if (i, j, k, m) not in shares:
                p, q = _flags(x[i : j + 1], u), _flags(y[k : m + 1], u)
                shares[i, j, k, m] = int(np.count_nonzero(p & q)) / int(np.count_nonzero(p | q))
            jaccard = shares[i, j, k, m]
            if jaccard >= similarity:
                out.append((i, j, k, m, jaccard))
                break
    return out


def repeated_passages(docs: DataFrame, words: int = LEAST_WORDS, similarity: float = SIMILARITY, shingle: int = SHINGLE, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of `words` words or more that two documents have, equal or near.

    Rows: doc_id, start_word, end_word (exclusive), other_id, other_start, other_end, jaccard
    (of the passages' distinct shingles, at least `similarity`), and kind. kind 'passage'
    joins representatives of texts: those that have a passage around a key are joined to the first
    text of the key where it has one with them, else by links that connect all texts of the
    key that passages connect. So n texts of a passage give about n rows. kind
    'copy' joins a document to the least id of those with the same words. Documents without
    a repeated passage have no row; null and shorter texts have none. Rows that repeat an id
    count as documents; other columns are not read. Words stand between ASCII white space,
    A-Z lowered."""
    spark = docs.sparkSession
    least = words - shingle + 1
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNER_BYTES), 1)
    rows = materialise(_owned(_windows(docs, id_col, text_col, shingle, least, hashes, owners), owners), "windows")
    free_shuffles(spark)
    each = rows.where(F.col("node").isNotNull()).select("id", "text_hash", "node", "words")
    reps = each.where(F.col("words") >= words).groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.max("words").alias("n"))
    reps = materialise(reps, "passage-texts")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.slice(lo, 512)
                seqs = [(sequence(t.as_py(), shingle, memo)[0] >> np.uint64(32)).astype(np.uint32).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seqs, pa.binary())], names=["node", "elements"])

    def sequences_of(near: DataFrame) -> DataFrame:
        want = materialise(reps.join(near, "node").select("node", F.col("rep.id").alias("rid"), F.col("rep.text_hash").alias("rhash")), "passage-reps")
        want_ = F.broadcast(want) if want.count() <= BROADCAST_ROWS else want
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        texts = texts.join(want_, F.col("id").eqNullSafe(F.col("rid")) & (F.xxhash64("text") == F.col("rhash")))
        return materialise(texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(sequences, "node long, elements binary"), "passage-sequences")

    def verify(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.float64(), pa.int32(), pa.int64(), pa.int32()]
        names = ["a", "b", "sa", "ea", "sb", "eb", "jaccard", "owner", "key", "ca"]
        for t in batches:
            out, first, second = [], t.column(0).to_numpy(), t.column(1).to_numpy()
            places = t.column(2)
            at, links = places.offsets.to_numpy(), places.flatten()
            at = at - at[0]
            ca, cb, keys = (links.field(k).to_numpy() for k in range(3))
            failed = np.ones(len(ca), bool)
            for r, (x, y) in enumerate(zip(t.column(3), t.column(4), strict=True)):
                own = slice(at[r], at[r + 1])
                px, py = ca[own], cb[own]
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                found = similar_intervals(x, y, list(zip(px.tolist(), py.tolist(), strict=True)), least, similarity)
                for c, d in zip(px.tolist(), py.tolist(), strict=True) if last else ():
                    # Such a link has a passage near by, also where none as wide as can be is found.
                    if not any(i <= c <= j and k <= d <= m for i, j, k, m, _ in found):
                        lo, to = max(0, c - REACH), max(0, d - REACH)
                        near = similar_intervals(x[lo : c + REACH + 1], y[to : d + REACH + 1], [(c - lo, d - to)], least, similarity)
                        found += [(i + lo, j + lo, k + to, m + to, s) for i, j, k, m, s in near]
                for i, j, k, m, s in found:
                    out.append((first[r], second[r], i, j + shingle, k, m + shingle, s, None, None, None))
                    failed[own] &= ~((i <= px) & (px <= j) & (k <= py) & (py <= m))
            cols = list(zip(*out, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            if last or not failed.any():
                continue
            # What no passage holds has failed: its owner, key and place.
            row = np.repeat(np.arange(len(first)), np.diff(at))[failed]
            owner = (keys[failed].view(np.uint64) % np.uint64(owners)).astype(np.int32)
            none = [pa.nulls(len(row), k) for k in kinds[2:7]]
            yield pa.RecordBatch.from_arrays([pa.array(first[row]), pa.array(second[row]), *none, pa.array(owner), pa.array(keys[failed]), pa.array(ca[failed])], names=names)

    def verified(links: DataFrame, last: bool, seqs: DataFrame | None = None) -> DataFrame:
        pairs = materialise(links.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("ca", "cb", "key"))).alias("places")), "passage-links")
        free_shuffles(spark)
        if seqs is None:
            seqs = sequences_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        x = seqs.select(F.col("node").alias("a"), F.col("elements").alias("xa")).dropDuplicates(["a"])
        y = seqs.select(F.col("node").alias("b"), F.col("elements").alias("xb")).dropDuplicates(["b"])
        # A pair brings its texts along: in turns of two pairs a text, for the disk.
        turns, done = max(1, -(-pairs.count() // max(1, 2 * seqs.count()))), None
        for turn in range(turns):
            some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn)
            both = some.join(x, "a").join(y, "b").select("a", "b", "places", "xa", "xb")
            part = materialise(both.mapInArrow(lambda b: verify(b, last), "a long, b long, sa long, ea long, sb long, eb long, jaccard double, owner int, key long, ca int"), "passage-verified")
            done = part if done is None else done.union(part)
            free_shuffles(spark)
        drop_path(spark, pairs.scratch)
        drop_path(spark, seqs.scratch)
        free_shuffles(spark)
        return done

    hubs = verified(rows.where(F.col("a").isNotNull()).select("a", "b", "ca", "cb", "key"), False)
    asked = _asked(rows, hubs.where(F.col("owner").isNotNull()).select("owner", "key", "a", "ca"), owners)
    asked = materialise(asked.groupBy("node").agg(F.collect_list(F.struct("key", "place", "joined")).alias("asked")), "passage-asked")
    seqs = sequences_of(asked.select("node"))
    others = verified(_other_links(seqs.join(asked, "node").select("node", "elements", "asked"), owners, least, similarity), True, seqs)
    drop_path(spark, asked.scratch)
    found = hubs.union(others).where(F.col("owner").isNull()).select("a", "b", "sa", "ea", "sb", "eb", "jaccard").distinct()
    first = reps.select("node", F.col("rep.id").alias("first"))
    found = found.join(first.select(F.col("node").alias("a"), F.col("first").alias("ia")), "a").join(first.select(F.col("node").alias("b"), F.col("first").alias("ib")), "b")
    out = found.select(F.col("ia").alias(id_col), F.col("sa").alias("start_word"), F.col("ea").alias("end_word"), F.col("ib").alias("other_id"), F.col("sb").alias("other_start"), F.col("eb").alias("other_end"), "jaccard", F.lit("passage").alias("kind"))
    many = reps.where("copies > 1").select("node", F.col("rep.id").alias("first"), "n")
    zero = F.lit(0).cast("long")
    copies = each.join(many, "node").where(~(F.col("id").eqNullSafe(F.col("first"))))
    copies = copies.select(F.col("id").alias(id_col), zero.alias("start_word"), F.col("n").alias("end_word"), F.col("first").alias("other_id"), zero.alias("other_start"), F.col("n").alias("other_end"), F.lit(1.0).alias("jaccard"), F.lit("copy").alias("kind"))
    return out.unionByName(copies)
