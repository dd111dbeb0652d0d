"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and
its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import decontaminate, exactdedup, hpylm, mixing, partenum, passages, quality, tokencount, urlfilter, warc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOW))


def made_up(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(9)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity, and columns whose names the operators use inside."""
    base = made_up(1, 300)
    near = base.replace(base.split()[150], "changed", 1)
    texts = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One"), (None, base), (None, None), (9, made_up(2, 60)), (9, made_up(2, 60)), (9, made_up(3, 80)), (10, made_up(4, 30_000)), (11, "a " * 3000), (12, "ÉÀ é à " * 30), (13, made_up(2, 60).upper())]
    rows = [(i, t, "en", ["a", "b", None][k % 3], 0) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("row", "node", "id", "key", "size", "target", "items", "m", "h", "kept", "sha", "words", "copies", "keep_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1


def hits(text, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = words(text, word), set(), set()
    for i, t in items:
        x = words(t, word)
        m = min(10, len(x))
        windows = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if x else set()
        for s in range(len(w) - m + 1):
            if tuple(w[s : s + m]) in windows:
                hit |= set(range(s, s + m))
                found.add(str(i))
    return len(w), len(hit), sorted(found - {"None"})


def test_contamination_is_what_brute_force_finds(spark, odd, none):
    long_item, other = made_up(1, 300).split()[100:125], made_up(50, 12)
    items = [(1, " ".join(long_item)), (2, "ONE"), (3, made_up(2, 60)[:40]), (4, None), (5, "!!"), (None, "x " + " ".join(long_item[:11])), (10, other), (10, "a a a a a a a a a a a")]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n", F.lit(1))
    extra = spark.createDataFrame([(90, f"front {other.upper()} {other} end", "en", "a", 0), (91, " ".join(other.split()[:9]), "en", "a", 0)], DOCS)
    docs = odd.select(*DOCS.replace(" bigint", "").replace(" string", "").split(", ")).union(extra)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, table).collect())
    want = sorted((str(r.doc_id), *hits(r.text, items)) for r in docs.collect())
    assert [x for x in got if x not in want] == [x for x in want if x not in got] == [] and len(got) == len(want)
    assert sum(1 for x in want if x[2]) >= 6
    assert decontaminate.contamination(odd, table).count() == odd.count()
    clean = decontaminate.clean_documents(docs.withColumn("_digest", F.lit(1)), table)
    assert clean.count() == sum(1 for x in want if not x[2])
    assert decontaminate.contamination(none, table).count() == 0
    assert decontaminate.contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0


def test_winnowing_misses_no_shared_span(spark):
    item = made_up(77, 40).split()
    rows = [(k, f"{made_up(k + 100, 15)} {' '.join(item[k : k + 10])} {made_up(k + 200, 15)}", "", "", 0) for k in range(31)]
    got = decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string"))
    assert [r.n_hit for r in got.collect()] == [10] * 31
    assert {tuple(r.spans[0]) for r in got.collect()} == {(15, 25)}


# 2


def test_language_model(spark, odd, none):
    rows = [(i, made_up(i % 40, 60, 50), "", "", 0) for i in range(150)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in hpylm.language_scores(df).collect()}
    tokens = {i: [*words(t), None] for i, t, *_ in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, i not in train)
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in hpylm.language_scores(df).collect()}
    assert all(math.isclose(again[i], r.score, rel_tol=1e-9) for i, r in got.items())
    assert hpylm.language_scores(odd).count() == odd.count()
    assert hpylm.language_scores(none).count() == 0


def test_probabilities_sum_to_one(spark):
    """One-word texts behind the same start: over all words and an unknown one."""
    rows = [(i, f"w{i % 7}", "", "", 0) for i in range(60)] + [(1000 + i, t, "", "", 0) for i, t in enumerate([f"w{k}" for k in range(7)] + ["never"])]
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in hpylm.language_scores(df).collect()}
    assert held and all(r.score < 0 for r in got.values())


def test_seating_keeps_its_books():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 5, 3000])
    r = hpylm.Restaurants(sizes, np.array([0, 0, 0, 1, 1]), 2, 0.5, 1.0, rng)
    for _ in range(5):
        r.sweep(np.full(5, 0.1))
        assert (r.tables <= sizes).all() and (r.tables[1:] >= 1).all() and r.tables[0] == 0
        assert r.total.tolist() == [r.tables[:3].sum(), r.tables[3:].sum()]
        for o, n, t in zip(r.off, r.n, r.nt, strict=True):
            used = r.size[o : o + n]
            assert used.sum() == n and (used > 0).sum() == t
            assert (np.bincount(r.z[o : o + n], minlength=n) == used).all()


def test_sections_do_not_make_tables(monkeypatch):
    def tables(section):
        monkeypatch.setattr(hpylm, "SECTION", section)
        r = hpylm.Restaurants(np.array([3000, 3000, 40]), np.array([0, 0, 0]), 1, 0.8, 1.0, np.random.default_rng(5))
        r.total = r.total + 100_000
        out = []
        for k in range(12):
            r.sweep(np.array([0.001, 0.0005, 0.001]))
            if k >= 6:
                out.append(r.tables.copy())
        return np.mean(out, 0)

    whole = tables(1 << 20)
    assert np.allclose(tables(128)[:2], whole[:2], rtol=0.15)


# 3


def test_archives_round_trip(spark):
    long_ = "<p>" + made_up(1, 60) + "</p>"
    rows = [(1, "http://a/\r\n%", long_), (2, None, long_), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", long_), (7, "u", long_), (None, "u", long_), (8, "ü", "ü" * 50)] + [(100 + i, f"http://h/{i}", made_up(i, 300)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(1))
    got = warc.archive_round_trip(df).collect()
    want = []
    first = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    for i, u, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and first.get(h) != i
        want.append((str(i), u, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None, None if revisit else b))
    key = lambda x: tuple(map(str, x))
    assert sorted(((str(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.body is None else bytes(r.body)) for r in got), key=key) == sorted(want, key=key)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_are_streams_with_a_leading_dictionary(spark, tmp_path):
    import zstandard

    rows = [(i, "u", made_up(i % 50, 400)) for i in range(400)]
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    files = [p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size > 8]
    kinds = [k for p in files for k, _ in warc.frames_of(p.read_bytes())]
    assert kinds.count("record") == 400 and kinds.count("dict") == len(files)
    for p in files:
        data = p.read_bytes()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        assert struct.unpack_from("<I", data)[0] == warc.DICT_MAGIC
    whole = b"".join(p.read_bytes() for p in files)
    d = next(x for k, x in warc.frames_of(whole) if k == "dict")
    assert len(d) > 1000
    # A record's frame decodes alone with the dictionary, and not without it.
    at = 8 + len(d)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d))
    assert codec.decompressobj().decompress(whole[at:]).startswith(b"WARC/1.1")
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(whole[at:])


# 4


def test_url_rules(spark):
    urls = ["https://A.example.COM/en/71?x", "http://www.example.com/en/1", "http://com/en/", "http://x.net/de/5", "http://example.net/de/88", "http://b.example.net/de/9", "http://x.org/es/", "http://notexample.com/en/7", "no scheme", None, "", "ftp://h#f", "http://h.com?q=://z/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("gram", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2] == ("com", "/en/", "com/en/", "block")
    assert got[3][2:] == ("net/de/", "block") and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "block")
    assert got[6][2:] == ("org/es/", "block") and got[7][2:] == ("com/en/", "block")
    assert [got[i][:3] for i in (8, 9, 10)] == [("", "", None)] * 3
    assert got[11][:3] == ("h", "", None) and got[12][:3] == ("h.com", "", None)
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_url_models_are_the_recursion(spark):
    urls = [(i, f"http://{'good' if i % 2 else 'evil'}.example.{'com/en/7' if i % 2 else 'org/es/'}{i}") for i in range(200)] + [(1000, "http://good.site/x"), (1001, "http://evil.site/x")]
    got = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(urls, "page_id bigint, url string")).collect()}
    counts = {"allow": collections.Counter(), "block": collections.Counter()}
    s, e, k = urlfilter.START, urlfilter.END, urlfilter.ORDER
    grams = lambda u: [(s * k + u + e)[i : i + k + 1] for i in range(len(u) + 1)]
    for i, u in urls:
        r = got[i]
        if r.rule and zlib.crc32(str(i).encode()) % 5:
            for g in grams(u):
                for j in range(k + 1):
                    counts[r.verdict][g[k - j :], "g"] += 1
                    counts[r.verdict][g[k - j : k], "c", j] += 1

    def p(g, kind):
        x = 1 / urlfilter.ALPHABET
        for j in range(k + 1):
            x = (counts[kind][g[k - j :], "g"] + urlfilter.MASS * x) / (counts[kind][g[k - j : k], "c", j] + urlfilter.MASS)
        return x

    for i in (1000, 1001):
        u = dict(urls)[i]
        want = sum(round((math.log(p(g, "allow")) - math.log(p(g, "block"))) * 1e6) for g in grams(u)) / 1e6 / (len(u) + 1)
        assert math.isclose(got[i].score, want, abs_tol=2e-6)
    assert (got[1000].verdict, got[1001].verdict) == ("allow", "block")


# 5


def test_mix(spark, odd, none):
    r = random.Random(5)
    rows = [(i, made_up(i, r.randrange(1, 60)), "", ["a", "b", "c", "d", None][i % 5 if i % 9 else 0], 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS).withColumn("h", F.lit(1))
    got = mixing.mix(df).collect()
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    left, targets = sum(size.values()), {}
    open_ = set(size)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            targets[s] = 3.0 * size[s]
            left -= 3 * size[s]
            open_.discard(s)
    targets |= share
    taken = collections.Counter()
    for x in got:
        assert math.isclose(x.target, targets[x.source], rel_tol=1e-9) and x.source_size == size[x.source] and 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert len(got) == 600 and all(abs(taken[s] - targets[s]) <= 60 for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    kept = mixing.mixed_documents(df)
    assert {(x.doc_id, x.taken) for x in kept.collect()} == {(x.doc_id, x.taken) for x in got if x.copies}
    clash = df.withColumn("threshold", F.lit("x")).withColumn("passes", F.lit("x")).withColumn("s3", F.lit("x")).withColumn("_target", F.lit("x")).withColumn("copies", F.lit("x"))
    assert {(x.doc_id, x.taken, x.threshold) for x in mixing.mixed_documents(clash).collect()} == {(x.doc_id, x.taken, "x") for x in got if x.copies}
    nameless = mixing.mix(df.withColumn("doc_id", F.lit(None).cast("long"))).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(x.n - x.t) <= 60 for x in nameless)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0


# 6


def linked(rows, n, num, den):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sets, [find(k) for k in range(len(rows))]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_jaccard_components(spark, n, num, den):
    r = random.Random(n)
    rows, i = [], 0
    for f in range(40):
        base = made_up(f, r.choice([1, 2, 3, 8, 20, 40, 90, 200])).split()
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = f"e{r.randrange(99)}"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " ")]
    sets, comp = linked(rows, n, num, den)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("comp", F.lit(1))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in partenum.jaccard_components(df, n, num, den).collect()}
    assert got == {k: (len(sets[k]), rows[comp[k]][0]) for k in range(len(rows))}
    assert len(set(comp)) < len(rows) - 20
    kept = {x.doc_id for x in partenum.one_of_each(df, n, num, den).collect()}
    assert kept == {rows[c][0] for c in comp}


def test_jaccard_ways_beyond_every_threshold(spark, monkeypatch):
    """Large groups, spread signatures, many owners and shuffled joins give the same links."""
    for name, value in (("BLOCK", 4), ("BLOCK_ELEMENTS", 400), ("SPREAD", 2), ("SEND_BYTES", 4000), ("OWNER_BYTES", 20_000), ("BROADCAST_ROWS", 1)):
        monkeypatch.setattr(partenum, name, value)
    r = random.Random(11)
    line, rows = made_up(900, 30), []
    for i in range(60):
        w = made_up(i % 3, 45).split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randrange(999)}"
        rows.append((i, " ".join(w) if i % 4 else f"{line} {made_up(300 + i, r.randrange(2, 16))}"))
    sets, comp = linked(rows, 5, 8, 10)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in partenum.jaccard_components(df, 5, 8, 10).collect()}
    assert got == {k: (len(sets[k]), rows[comp[k]][0]) for k in range(len(rows))}
    assert 10 < len(set(comp)) < 50


def test_jaccard_oddities(spark, odd, none):
    got = partenum.jaccard_components(odd)
    assert got.count() == odd.count()
    by = collections.defaultdict(set)
    for r in got.collect():
        by[r.doc_id].add(r.component_id)
    assert by[1] == by[2] == by[3] == {1} and by[4] == {4} and by[7] == by[8] == {7} and by[13] == {9}
    assert partenum.jaccard_components(none).count() == 0 and partenum.one_of_each(none).count() == 0


def test_signatures_miss_no_similar_pair():
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (8, 10)):
        plan = partenum.PartEnum(num, den)
        for size in (1, 2, 5, 9, 10, 11, 19, 30, 57, 100, 333):
            for _ in range(20):
                a = rng.integers(0, 2**63, size).astype(np.uint64)
                drop = rng.integers(0, size + 1)
                b = np.concatenate((a[drop:], rng.integers(0, 2**63, rng.integers(0, size)).astype(np.uint64)))
                a, b = np.unique(a), np.unique(b)
                i = len(np.intersect1d(a, b))
                if not len(b) or den * i < num * (len(a) + len(b) - i):
                    continue
                x, y = (set(plan.signatures(s, np.array([len(s)]))[0].tolist()) for s in (a, b))
                assert x & y, (num, den, len(a), len(b), i)
                d = np.bitwise_count(partenum.sketch(a).view(np.uint64) ^ partenum.sketch(b).view(np.uint64)).sum()
                assert d <= (len(a) + len(b)) * (den - num) // (den + num)


# 7


def test_token_counts_are_the_library_s(spark, odd, none):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    c = tokencount.WholeTokenCounter(path)
    r = random.Random(1)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "日本", "ﬁ", "\u0000", "<s>", "ing", "!", "😀", "\r\n", "9"]
    for _ in range(2000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 14)))
        assert c.count(t) == len(sp.encode(t)), repr(t)
    assert c.splits and len(c.lead) > 10_000
    got = tokencount.token_counts(odd, path)
    want = sorted((str(x.doc_id), len((x.text or "").encode()), len(sp.encode(x.text or ""))) for x in odd.collect())
    assert sorted((str(x.doc_id), x.n_bytes, x.n_tokens) for x in got.collect()) == want
    assert got.where("over_limit").count() == sum(n > 4096 for *_, n in want) > 0
    assert tokencount.token_counts(none, path).count() == 0


# 8


def test_quality(spark, odd, none):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality_scores(docs, labels)
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert got.count() == docs.count() and sum(r.predicted == r.quality for r in held) > 0.97 * len(held)
    s = quality.quality_scores(odd, labels)
    assert s.count() == odd.count() and s.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality.fit(x[:3000], y[:3000]).scores(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.9


# 9


def test_passages(spark, odd, none):
    shared, r = made_up(500, 70), random.Random(9)
    rows = [(i, f"{made_up(i, 120)} {shared if i < 6 else made_up(i + 900, 70)} {made_up(i + 300, 90)}") for i in range(30)]
    edited = shared.split()
    edited[33] = "edit"
    rows += [(30, " ".join(edited)), (31, shared), (32, shared), (33, " ".join(shared.split()[:49])), (34, None), (35, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1))
    got = passages.repeated_passages(df).collect()
    assert {x.doc_id for x in got} | {x.other_id for x in got} == {*range(6), 30, 31, 32}
    for x in got:
        a, b = (words(dict(rows)[i]) for i in (x.doc_id, x.other_id))
        sa, sb = ({tuple(w[i : i + 5]) for i in range(s, e - 4)} for w, s, e in ((a, x.start_word, x.end_word), (b, x.other_start, x.other_end)))
        assert x.end_word - x.start_word >= 50 and math.isclose(len(sa & sb) / len(sa | sb), x.jaccard, abs_tol=1e-6) and x.jaccard >= 0.8
    parent = {}
    find = lambda v: v if parent.get(v, v) == v else find(parent[v])
    for x in got:
        parent[find(x.doc_id)] = find(x.other_id)
    assert len({find(i) for i in (*range(6), 30, 31, 32)}) == 1
    assert r and passages.repeated_passages(odd).count() > 0 and passages.repeated_passages(none).count() == 0


def pairs_found(spark, rows):
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return {frozenset((x.doc_id, x.other_id)) for x in got}


def test_passages_around_a_frequent_line(spark):
    line = made_up(600, 43)
    rows = [(i, f"{made_up(i + 2000, 60)} {line} {made_up(i + 2100, 60)}") for i in range(40)]
    for k in range(20):
        shared = f"{made_up(k + 2200, 4)} {line} {made_up(k + 2300, 4)}"
        rows += [(i, f"{made_up(i + 2000, 60)} {shared} {made_up(i + 2100, 60)}") for i in (50 + 2 * k, 51 + 2 * k)]
    assert pairs_found(spark, rows) == {frozenset((50 + 2 * k, 51 + 2 * k)) for k in range(20)}


def test_passages_whose_part_came_before(spark):
    rows = []
    for k in range(10):
        part, rest = made_up(k + 1000, 30), made_up(k + 1100, 20)
        rows += [(2 * k, f"{part} {made_up(k + 1200, 40)} {part} {rest}"), (2 * k + 1, f"{part} {rest}")]
    assert pairs_found(spark, rows) == {frozenset((2 * k, 2 * k + 1)) for k in range(10)}


def test_passages_with_a_word_put_in_or_left_out(spark):
    rows = []
    for k in range(20):
        shared = made_up(k + 1300, 51 + k % 2).split()
        changed = [*shared[:25], "new", *shared[25:]] if k % 2 else shared[:25] + shared[26:]
        rows += [(2 * k, f"{made_up(k + 1400, 60)} {' '.join(shared)} {made_up(k + 1500, 60)}"), (2 * k + 1, f"{made_up(k + 1600, 60)} {' '.join(changed)} {made_up(k + 1700, 60)}")]
    assert pairs_found(spark, rows) == {frozenset((2 * k, 2 * k + 1)) for k in range(20)}


def test_compact_windows_cover_every_subsequence_once():
    h = np.random.default_rng(2).permutation(40).astype(np.uint64)
    w = passages.compact_windows(h, 1)
    for i in range(40):
        for j in range(i, 40):
            own = [(a, c, b) for a, c, b in w if a <= i <= c <= j <= b]
            assert len(own) == 1 and own[0][1] == i + int(h[i : j + 1].argmin())


def test_least_places_are_those_of_compact_windows():
    h = partenum.mix(np.random.default_rng(3).integers(0, 60, 500).astype(np.uint64))
    for least in (1, 7, 46):
        assert passages.least_places(h, least).tolist() == sorted(c for _, c, _ in passages.compact_windows(h, least))


def test_near_passages_are_found():
    """Random texts of 200 words that share a passage with edited words, of Jaccard similarity
    0.8 or more: found in nine of ten cases at least."""
    memo, r = partenum.WordHashes(), random.Random(4)
    for length, edits in ((50, 1), (60, 2)):
        found = cases = 0
        while cases < 120:
            w = [f"p{r.randrange(10**9)}" for _ in range(length)]
            v = list(w)
            for k in r.sample(range(length), edits):
                v[k] = f"e{r.randrange(10**9)}"
            both = [passages.sequence(" ".join(t).encode(), 5, memo)[0] for t in (w, v)]
            same = len(np.intersect1d(*both))
            if same / (len(both[0]) + len(both[1]) - same) < 0.8:
                continue
            cases += 1
            around = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]
            at, to = r.randrange(150), r.randrange(150)
            x, y = (passages.sequence(" ".join(around(n) + t + around(150 - n)).encode(), 5, memo)[0] for n, t in ((at, w), (to, v)))
            kx, px, _ = passages.window_keys(x, 46, passages.HASHES)
            ky, py, _ = passages.window_keys(y, 46, passages.HASHES)
            places = [(int(a), int(b)) for k, a in zip(kx, px, strict=True) for q, b in zip(ky, py, strict=True) if k == q]
            out = passages.similar_intervals(x, y, places, 46, 0.8)
            assert all(j - i + 1 >= 46 and m - k + 1 >= 46 and s >= 0.8 for i, j, k, m, s in out)
            found += bool(out)
        assert found >= 0.9 * cases, (length, edits, found, cases)


# 10


def test_exact_duplicates(spark, odd, none):
    assert exactdedup.largest_of_each(odd.withColumn("_sha", F.lit(1)).withColumn("group_size", F.lit("mine"))).where("kept = 'clash' AND group_size = 'mine' AND _sha = 1").count() == len({r.text or "" for r in odd.collect()})
    got = exactdedup.exact_duplicates(odd, capacity=2000)
    assert got.count() == odd.count()
    groups = collections.defaultdict(list)
    for r in odd.collect():
        groups[r.text or ""].append(r.doc_id)
    for r in got.collect():
        ids = groups[r.text or ""]
        top = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.text_sha256) == (top, len(ids), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got.where("kept").count() == len(groups)
    assert exactdedup.exact_duplicates(none).count() == 0


def test_directory_doubles_where_buckets_overflow():
    keys = np.sort(np.array([i << 48 for i in range(64)] + [5] * 100, np.int64))
    first, depth = exactdedup.buckets(keys, np.full(len(keys), 10), 100)
    edges = sorted({(int(f), int(d)) for f, d in zip(first, depth, strict=True)})
    assert all(f % (1 << (60 - d)) == 0 for f, d in edges) and all(f + (1 << (60 - d)) <= g for (f, d), (g, _) in zip(edges, edges[1:], strict=False))
    for f, d in edges:
        mine = keys[first == f]
        assert ((mine >= f) & (mine < f + (1 << (60 - d)))).all() and (len(mine) * 10 <= 100 or len(set(mine.tolist())) == 1)


def test_colliding_keys_are_chained(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    got = exactdedup.build_index(df, digest=lambda t: bytes(31) + t[:1]).orderBy("sha").collect()
    assert [(r.keep_id, r.group_size, r.key) for r in got] == [(3, 2, 0), (2, 1, 0)] and {r.chain for r in got} == {0, 1}


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = [(None, None), (None, ""), (-5, "one"), (-5, "one"), (-6, "one two")]
    odd_rows = spark.createDataFrame(extra, "doc_id bigint, text string")
    strange = docs.unionByName(odd_rows, allowMissingColumns=True)
    for name in ("kept", "keep_id", "size", "_digest", "comp", "threshold"):
        strange = strange.withColumn(name, F.lit("mine"))
    for table in (strange, strange.limit(0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, table, d)
            assert out.columns == table.columns and out.where("kept = 'mine' AND size = 'mine'").count() == out.count() <= table.count()
        assert {"doc_id", "taken"} <= set(P.STAGES[-1][1](spark, table, d).columns)
    labels, bench = spark.read.parquet(f"{d}/labels.parquet"), [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    kept = P.STAGES[0][1](spark, docs, d)
    features = quality.text_features(docs)
    model = quality.learn(features, labels)
    want = {r.id for r in quality.score_features(features, model).where("score >= 0.5").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in want}
    assert {r.doc_id for r in kept.collect()} == want
    last = {}
    for i, r in rows.items():
        last[r.text] = max(i, last.get(r.text, i))
    now = sorted(last.values())
    pairs = [(i, rows[i].text) for i in now]
    _, comp = linked(pairs, 5, 8, 10)
    now = sorted({pairs[c][0] for c in comp})
    now = [i for i in now if not hits(rows[i].text, bench)[1]]
    mixed = {r.doc_id: r.copies for r in mixing.mix(docs.where(F.col("doc_id").isin(now))).where("copies > 0").collect()}
    got = P.run(spark, d).collect()
    assert {r.doc_id: r.copies for r in got} == mixed
    assert all(r.text == rows[r.doc_id].text for r in got)


def test_sketches_of_two_widths():
    """A wide sketch folds to the narrow one's width; the bits that differ are never more than
    the elements that do."""
    values = partenum.mix(np.arange(1, 6001, dtype=np.uint64))
    sets = [values[:k] for k in (0, 1, 128, 129, 250, 500, 900, 1024, 1025, 1100)]
    marks = [partenum.sketch(s) for s in sets]
    assert [len(m) for m in marks] == [8, 8, 8, 8, 8, 8, 16, 16, 32, 32]
    start = np.cumsum([0, *map(len, marks)])
    words = np.concatenate(marks).view(np.uint64)
    p, q = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = partenum.differing_bits(words, start, p, q)
    for i, j, n in zip(p, q, got, strict=True):
        w = min(len(marks[i]), len(marks[j])) * 64
        parity = [np.bincount((sets[k] % np.uint64(w)).astype(np.int64), minlength=w) & 1 for k in (i, j)]
        assert n == (parity[0] != parity[1]).sum() <= abs(len(sets[i]) - len(sets[j]))
    import pyarrow as pa

    size = np.array([len(x) for x in sets])
    m = partenum._Marks(pa.array(size), pa.array([x.tolist() for x in marks], pa.list_(pa.int64())))
    lo, hi = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
    assert (m.may_link(p, q, 8, 10) == ((10 * lo >= 8 * hi) & (got * 18 <= (lo + hi) * 2))).all()


def test_signatures_in_small_packs_take_little_room(spark):
    r = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(str(r.randrange(5000)) for _ in range(200))) for i in range(1000)], "doc_id long, text string").coalesce(1)
    signatures = 1000 * len(partenum.PartEnum(8, 10).signatures(partenum.mix(np.arange(196, dtype=np.uint64)), np.array([196]))[0])
    assert partenum._signatures(docs, "text", 5, 8, 10, 400).agg(F.sum(F.length("packed"))).first()[0] < 10 * signatures


def test_groups_with_repeated_rows_stay_apart(spark):
    rows = [(1, 10), (1, 10), (1, 11), (1, 11), (2, 20), (2, 20), (2, 21), (2, 21), (3, 10), (3, 10), (3, 11), (3, 11)]
    got = partenum._distinct_groups(spark.createDataFrame(rows, "sig long, node long"))
    assert {x.sig for x in got.collect()} == {1, 2}


@pytest.mark.parametrize("bits", [3, 32])
def test_nodes_of_one_short_key_are_linked(spark, monkeypatch, bits):
    monkeypatch.setattr(partenum, "REF_BITS", bits)
    r = random.Random(12)
    texts = [" ".join(str(r.randrange(1000)) for _ in range(60)) for _ in range(40)]
    texts += [t + " more" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in partenum.jaccard_components(df, 5, 8, 10).collect()}
    assert got == {i: i % 40 for i in range(80)}


def test_pairs_without_a_passage_are_told_before_their_links(monkeypatch):
    """Texts that share a line only: no link is looked at. Where a passage is, the places that
    may have it hold all of the widest intervals that are long enough."""
    r, calls = np.random.default_rng(13), []
    around = passages._around
    monkeypatch.setattr(passages, "_around", lambda *a: calls.append(a) or around(*a))
    x, y = (r.integers(0, 1 << 32, 400, dtype=np.uint32) for _ in range(2))
    y[100:120] = x[300:320]
    assert passages.similar_intervals(x, y, [(300 + i, 100 + i) for i in range(20)], 46, 0.8) == [] and not calls
    for _ in range(40):
        match = r.random(300) < np.repeat(r.choice([0.2, 0.85, 0.95], 6), 50)
        held = passages._covered(match, 46, 0.8)
        for c in np.flatnonzero(match).tolist():
            i, j = around(match, c, 0.8, True)
            assert j - i + 1 < 46 if held is None or not held[c] else j - i + 1 >= 46


def test_rows_of_a_frequent_line_bring_no_pairs(monkeypatch):
    """Rows of a key whose texts share a line only are not compared, however many they are; those
    that share a passage are joined by as many links as it takes."""
    r, calls = np.random.default_rng(14), []
    similar = passages.similar_intervals
    monkeypatch.setattr(passages, "similar_intervals", lambda *a: calls.append(a) or similar(*a))
    n, mid = 300, passages.REACH
    around = r.integers(1, 1 << 32, (n, 2 * mid + 1), dtype=np.uint32)
    around[:, mid - 15 : mid + 15] = around[0, mid - 15 : mid + 15]
    key, node = np.full(n, 5, np.uint64), np.arange(n)
    p, q = passages.forest(key, node, np.zeros(n, bool), around, 46, 0.8)
    assert not len(p) and not calls
    # Of 100 rows a passage of 46 with five elements that differ, of 20 others another one.
    for rows in (range(50, 150), range(200, 220)):
        around[rows, mid - 20 : mid + 26] = around[rows[0], mid - 20 : mid + 26]
        for i in rows[1::2]:
            around[i, mid + 21 : mid + 26] = r.integers(1, 1 << 32, 5, dtype=np.uint32)
    p, q = passages.forest(key, node, np.zeros(n, bool), around, 46, 0.8)
    root = list(range(n))
    for a, b in zip(p.tolist(), q.tolist(), strict=True):
        x, y = root[a], root[b]
        root = [x if k == y else k for k in root]
    assert len(p) == 99 + 19 and {root[i] for i in range(50, 150)} != {root[i] for i in range(200, 220)}
    assert len({root[i] for i in range(50, 150)}) == len({root[i] for i in range(200, 220)}) == 1


def test_unrelated_sets_share_no_signature_of_empty_cells(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 64, 60, np.uint64)) for _ in range(4000)]
    sig, _ = partenum.PartEnum(8, 10).signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert np.unique(sig, return_counts=True)[1].max() <= 40
    # Linked sets share a signature after any number of cuts.
    for turns in (1, 2, 4):
        monkeypatch.setattr(partenum, "TURNS", turns)
        plan = partenum.PartEnum(8, 10)
        for size in [*range(1, 40), 60, 200] * 4:
            a = rng.integers(0, 1 << 64, size, np.uint64)
            out = int(rng.integers(0, size // 9 + 1))
            b = np.concatenate((a[out:], rng.integers(0, 1 << 64, out, np.uint64)))
            sig, at = plan.signatures(np.concatenate((np.sort(a), np.sort(b))), np.array([size, size]))
            assert np.intersect1d(sig[at == 0], sig[at == 1]).size
