"""SimHash, suffix arrays, ANN, URL filters, WARC and the pipeline against brute force."""

import hashlib
import random
import struct

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from helixmill.llm import ann, components, sais, similar, simhash, suffix, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def flipped(fp, rng, n):
    for i in rng.sample(range(64), n):
        fp ^= 1 << i
    return fp


@pytest.mark.parametrize("crowd, many", [(400, False), (3, False), (400, True), (2, True)])
def test_links_connect_what_brute_force_does(spark, monkeypatch, crowd, many):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    if many:
        monkeypatch.setattr(simhash, "MANY_FROM", 0)
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:12]:
        fps |= {flipped(f, rng, rng.randrange(1, 7)) for _ in range(5)}
    hub = rng.getrandbits(64)
    fps |= {hub, *(flipped(hub, rng, 1) for _ in range(10)), 0, 1}
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4 and find(a) != find(b):
                root[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    pairs = simhash.links(df, len(fps)).collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 4 for r in pairs)
    got = {f: f for f in fps}

    def find2(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in pairs:
        a, b = find2(r.u & (2**64 - 1)), find2(r.v & (2**64 - 1))
        if a != b:
            got[a] = b
    groups = lambda f: {frozenset(x for x in fps if f(x) == y) for y in {f(x) for x in fps}}
    assert groups(find) == groups(find2)


def test_simhash_documents(spark):
    rng = random.Random(8)
    base = words(rng, 400)
    texts = [base, base.replace(" ", "\n"), base.upper(), base + " x", None, "", " \t", "one", "ONE", "two words", words(rng, 50)]
    df = docs(spark, texts).union(spark.createDataFrame([(None, base, "en", "s", 1), (3, base + " x", "en", "s", 1)], DOCS)).withColumn("fp", F.lit("clash"))
    got = simhash.components_of(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == format(plain_fingerprint(texts[r.doc_id]), "016x")
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[0] == comp[1] == comp[2] == comp[3] == comp[None] == 0 and comp[4] == comp[5] == comp[6] == 4 and comp[7] == comp[8] == 7 and comp[9] == 9
    kept = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    assert kept == [0, 4, 7, 9, 10]
    assert simhash.components_of(df.where("false")).collect() == []


def test_simhash_of_long_texts_and_clashing_columns(spark):
    rng = random.Random(12)
    long = " ".join(words(rng, 1000) for _ in range(60))
    texts = [long, long + " end", words(rng, 50), "w" * 500_000, " " * 100_000]
    df = clashing(docs(spark, texts))
    got = {r.doc_id: r for r in simhash.components_of(df).collect()}
    assert all(got[i].fingerprint == format(plain_fingerprint(t), "016x") for i, t in enumerate(texts)) and got[1].component_id == 0
    for one_of_each in (simhash.one_of_each, similar.one_of_each):
        kept = one_of_each(df)
        assert kept.columns == df.columns
        assert sorted((r.doc_id, r["__hm_id"]) for r in kept.collect()) == [(i, "__hm_id") for i in (0, 2, 3, 4)]
        assert one_of_each(df.where("false")).collect() == []


def clashing(df):
    """With columns named as the operators might name theirs."""
    return df.select("*", *(F.lit(c).alias(c) for c in ("__hm_id", "__hm_hash", "__hm_text", "__hm_cut", "__hm_own", "fp", "root", "id", "n")))


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("crowd, rows", [(64, 200_000), (2, 30)])
def test_similar_documents(spark, monkeypatch, crowd, rows):
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "SHARD_ROWS", rows)
    rng = random.Random(21)
    vocabulary = words(rng, 3000).split()
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, family = [], []
    for f in range(12):
        base = prose(300)
        for k in range(6):
            w = list(base)
            for _ in range(k):  # up to five words changed of 300: similarity 0.84 and more to the first
                w[rng.randrange(300)] = "new%d" % rng.randrange(10**6)
            texts.append(" ".join(w))
            family.append(f)
    hot = prose(300)
    for k in range(120):
        w = list(hot)
        w[rng.randrange(300)] = "hot%d" % k
        texts.append(" ".join(w))
        family.append(99)
    for k in range(60):
        texts.append(" ".join(prose(200)))
        family.append(1000 + k)
    first = {}
    for i, f in enumerate(family):
        first.setdefault(f, i)
    n = len(texts)
    df = docs(spark, [*texts, texts[0], None, ""]).union(spark.createDataFrame([(None, texts[3], "en", "s", 0), (0, texts[0], "en", "s", 0)], DOCS)).withColumn("words", F.lit("clash"))
    kept = similar.one_of_each(df.repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*first.values(), n + 1]) and kept.columns == df.columns
    few = similar.one_of_each(docs(spark, ["one", "ONE", "two words here", "x y z"]))
    assert sorted(r.doc_id for r in few.collect()) == [0, 2, 3]
    assert similar.one_of_each(df.where("false")).collect() == []
    assert all(len(shingles(texts[0]) & shingles(texts[k])) / len(shingles(texts[0]) | shingles(texts[k])) >= 0.8 for k in range(6))


@pytest.mark.parametrize("part", [700, 5_000])
def test_large_components_in_blocks(spark, monkeypatch, part):
    """One component of candidates: a chain whose neighbours alone are linked, a group of near copies, and texts that are near them but
    not linked. In blocks the kept documents are the same as by brute force over all pairs."""
    monkeypatch.setattr(similar, "PART", part)
    rng = random.Random(5)
    vocabulary = words(rng, 3000).split()
    base = [rng.choice(vocabulary) for _ in range(204)]
    chain = [base]
    for k in range(12):
        w = list(chain[-1])
        w[16 * k : 16 * k + 16] = ["c%d_%d" % (k, i) for i in range(16)]
        chain.append(w)
    copies = [[*base[:p], "copy%d" % p, *base[p + 1 :]] for p in range(3, 200, 3)]
    apart = [[*base[: 204 - n], *("a%d_%d" % (n, i) for i in range(n))] for n in (22, 30, 40, 60)]
    texts = [" ".join(w) for w in (*chain, *copies, *apart)]
    rng.shuffle(texts)
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for i, x in enumerate(label):
        least.setdefault(x, i)
    hashes = [similar.shingles(t.encode()) for t in texts]
    members = spark.createDataFrame([(1, 10 * i, len(h)) for i, h in enumerate(hashes)] + [(2, 5, 1), (2, 6, 1)], "root long, id long, n long")
    rows = spark.createDataFrame([(1, 10 * i, t) for i, t in enumerate(texts)] + [(2, 6, "same"), (2, 5, "same")], "root long, id long, text string")
    got = {r.id: r.least for r in similar._alike(members, rows).collect()}
    assert got == {6: 5} | {10 * i: 10 * least[x] for i, x in enumerate(label) if least[x] != i}
    assert len(least) > 2
    df = docs(spark, texts).withColumn("__hm_id", F.lit("clash"))
    assert similar.one_of_each(df).columns == df.columns
    assert sorted(r.doc_id for r in similar.one_of_each(df).collect()) == sorted(least.values())


def threshold_pairs(changed, n=60):
    """Pairs of texts of 300 shingles, of which the last `changed` differ, so of similarity (300 - c) / (300 + c)."""
    rng = random.Random(8)
    word = lambda: "%06x" % rng.randrange(1 << 24)
    out = []
    for _ in range(n):
        base = [word() for _ in range(304)]
        out += [" ".join(base), " ".join(base[: 304 - changed] + [word() for _ in range(changed)])]
    return out


def test_similar_documents_at_the_threshold(spark):
    inside, outside, far = threshold_pairs(33), threshold_pairs(34), threshold_pairs(50)  # 0.802, 0.796, 0.714
    kept = {r.doc_id for r in similar.one_of_each(docs(spark, inside)).collect()}
    assert kept >= set(range(0, 120, 2)) and len(kept) <= 62  # a pair is found with a probability of 0.99
    for texts in (outside, far):
        assert similar.one_of_each(docs(spark, texts)).count() == 120


@pytest.mark.parametrize("rows", [2_000_000, 30_000_000])
def test_similar_documents_whatever_the_size(spark, monkeypatch, rows):
    few, shape = similar.shape(1), similar.shape
    assert all(shape(n)[2] >= similar.COMPARED for n in (0, 1, 1000, rows, 10**12)) and shape(rows)[:3] != few[:3]
    monkeypatch.setattr(similar, "shape", lambda n: (*shape(rows)[:3], 3))
    inside, outside = threshold_pairs(30), threshold_pairs(43)  # 0.818, 0.749
    kept = {r.doc_id for r in similar.one_of_each(docs(spark, inside)).collect()}
    assert kept >= set(range(0, 120, 2)) and len(kept) <= 61
    assert similar.one_of_each(docs(spark, outside)).count() == 120


def test_grouped_equals_brute_force():
    rng = np.random.default_rng(3)
    sets = [np.zeros(0, np.uint64)]
    for size in (1, 4, 10, 40, 100):
        for _ in range(6):
            base = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
            sets += [np.unique(np.concatenate([base[k : k + size], base[: k // 3]])) for k in range(0, size, max(1, size // 20))]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    label = list(range(len(sets)))
    for i, a in enumerate(map(set, sets)):
        for j in range(i):
            b = set(sets[j])
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    first = {}
    assert similar._grouped(sets).tolist() == [first.setdefault(x, i) for i, x in enumerate(label)]


def test_search_and_across_equal_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (4, 2)).astype(np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (4, 2)).astype(np.uint64)) for _ in range(10)])
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= 4
    reach = np.linalg.matrix_power(near.astype(float), len(fps)) > 0
    group, links = similar._search(fps, 4)
    assert all(((group == group[i]) == reach[i]).all() for i in range(len(fps)))
    assert all(near[u, v] for u, v in links) and len(links) == len(fps) - len(set(group.tolist()))
    stars = similar._stars(np.array([5, 9, 7, 20]), np.array([7, 5, 3, 21]))
    assert sorted(zip(stars.u.tolist(), stars.v.tolist())) == [(5, 3), (7, 3), (9, 3), (21, 20)]
    a = base ^ np.uint64(1)
    got = {(u, int(group[v])) for u, v in similar._across(a, fps, 4)}
    assert got == {(u, int(group[v])) for u in range(4) for v in np.flatnonzero(np.bitwise_count(a[u] ^ fps).sum(1) <= 4)}


@pytest.mark.parametrize("ends", [False, True])
def test_suffix_array(ends):
    rng = random.Random(3)
    for _ in range(300):
        b = [rng.randint(2 if ends else 1, rng.choice([2, 3, 5, 20])) for _ in range(rng.choice([1, 2, 5, 30, 200]))]
        if rng.random() < 0.3:
            b = b[: max(1, len(b) // 3)] * 3
        t = np.array([*b, *([1, *b, 1] if ends else []), 0], np.int32)
        sa = sais.suffix_array(t, 30, ends)
        x = t.tolist()
        if not ends:
            assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
            lcp = sais.permuted_lcp(t, sa)
            for i, j in zip(sa.tolist(), sa.tolist()[1:]):
                m = 0
                while max(i, j) + m < len(x) and x[i + m] == x[j + m]:
                    m += 1
                assert lcp[j] == m
        else:
            until = lambda i: x[i : x.index(1, i) if 1 in x[i:] else len(x)]
            assert sorted(sa.tolist()) == list(range(len(x)))
            assert all(until(i) <= until(j) for i, j in zip(sa.tolist(), sa.tolist()[1:]) if x[i] > 1 and x[j] > 1)


def plain_removal(rows, span=suffix.SPAN):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            least[b[i : i + span]] = min(least.get(b[i : i + span], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if least[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def repeated_texts():
    rng = random.Random(12)
    passage, long = words(rng, 14), words(rng, 60)
    texts = [words(rng, 30), passage, passage[:49], passage[:50], "ü" * 30, "ü" * 24 + "x", None, "", "a" * 200, "a" * 70, "b" + "a" * 49]
    texts += [words(rng, 12) + passage + words(rng, 12) for _ in range(8)] + [long] * 3 + [long[:150] + "!" + long[150:], long[20:] + words(rng, 5), "ab" * 100, "ba" * 60, "\0" * 60, "\0" * 55 + "z"]
    texts += [passage[: 20 + i] + words(rng, 8) + passage[i:] for i in range(0, 30, 3)]
    return texts


@pytest.mark.parametrize("hot, block, fan", [(20_000, 1 << 20, 512), (2, 1 << 20, 512), (20_000, 128, 512), (20_000, 1 << 20, 3)])
def test_suffix_removal(spark, monkeypatch, hot, block, fan):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "FAN", fan)  # 8 buckets in 3 ranges: tags are dealt twice
    texts = repeated_texts()
    rows = list(enumerate(texts)) + [(15, texts[15]), (15, texts[0])]  # repeated ids, equal and not
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows] + [(None, texts[1], "en", "s", 0)], DOCS).withColumn("hash", F.lit(1)).repartition(5)
    got = suffix.digests(df).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == plain_removal(rows)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]


def test_suffix_removal_keeps_documents(spark):
    texts = repeated_texts()
    df = clashing(docs(spark, texts))
    out = suffix.without_repeats(df)
    assert out.columns == df.columns
    got = out.collect()
    assert {(r["__hm_id"], r["__hm_text"], r["__hm_cut"]) for r in got} == {("__hm_id", "__hm_text", "__hm_cut")}
    assert all(r.n_chars == len(r.text) for r in got if r.text and r.text != texts[r.doc_id])
    kept = {r.doc_id: r.text for r in got}
    for d, n, removed, _, digest in plain_removal(list(enumerate(texts))):
        if n and removed == n:
            assert d not in kept
        elif not removed:
            assert kept[d] == texts[d]
        else:
            assert len(kept[d].encode()) <= n - removed
    assert suffix.digests(df.where("false")).collect() == [] and suffix.without_repeats(df.where("false")).collect() == []


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.6).astype(np.float32)
    v[700:900] = v[700]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1500, None), (1600, [0.0] * 16), (1700, [None] * 16), (1800, [float("nan")] * 16), (1900, [1.0] * 3), (None, [1.0] * 16), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(0))
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    found = 0
    x = v.astype(np.float64)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert all(s == d[i] and i != q for _, i, s in rows)
        d[q] = np.inf
        found += len({i for _, i, _ in rows} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert found >= 0.9 * 10 * len(got)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 2.0]), (7, [4.0, 6.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 3, 0.0), (2, 7, 5.0)]
    assert ann.nearest(few.where("false")).collect() == [] and ann.nearest(few.where("vec_id = 0")).collect() == []


def test_urls(spark):
    cases = [("http://a.example.com/en/7198?x", "example.com/en/7", "allow"), ("HTTP://EXAMPLE.COM/en/8", "com/en/", "block"), ("https://com/en/", "com/en/", "block"), ("https://xcom/en/", None, "allow"), ("x://a.net/de/8", "net/de/", "block"), ("x://www.example.net/de/81", "example.net/de/8", "allow"), ("x://notexample.net/de/8", "net/de/", "block"), ("x://o.org/es", None, "allow"), ("x://o.org#/es/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("no scheme", None, "allow"), ("x://", None, "allow"), ("x://b.com:80/en/", None, "allow"), ("x://a.com/en/\n?q", "com/en/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, (u, _, _) in enumerate(cases)] + [(None, cases[0][0], None, ""), (0, cases[0][0], "h", "")], "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame([*urls.RULES, ("block", None, "/x"), ("block", "", "/"), urls.RULES[0]], "action string, host string, path string")
    got = urls.judge(pages, rules).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        u, rule, verdict = cases[r.page_id or 0]
        assert (r.rule, r.verdict) == (rule, verdict), u
    assert {r.host for r in got if r.page_id == 1} == {"example.com"} and {r.path for r in got if r.page_id == 14} == {"/en/\n"}
    assert urls.judge(pages.where("false"), rules).collect() == []
    assert {r.verdict for r in urls.judge(pages, rules.where("false")).collect()} == {"allow"}


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    rows = [(1, "http://a\r\nb", "<p>ü</p>"), (5, "u", "<p>ü</p>"), (3, None, "<p>ü</p>"), (7, "v", None), (8, "w", ""), (9, "x", "q" * 100_000), (None, "y", "<p>ü</p>"), (None, "z", "only"), (11, "r", "twin"), (11, "r", "twin")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("row", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    kinds = lambda k: sorted((r.record_type, r.refers_to) for r in by[k])
    assert kinds(5) == [("response", None)] and kinds(1) == kinds(3) == [("revisit", 5)]
    assert kinds(8) == [("response", None)] and kinds(7) == [("revisit", 8)]
    assert sorted(kinds(11), key=str) == [("response", None), ("revisit", 11)]
    assert sorted(by[None], key=lambda r: r.payload_bytes)[0].record_type == "response"
    payload = {5: "<p>ü</p>", 7: "", 9: "q" * 100_000}
    for k, t in payload.items():
        assert by[k][0].payload_bytes == len(t.encode()) and by[k][0].payload_digest == warc.payload_digest(t.encode())
    assert bytes(by[9][0].payload) == payload[9].encode() and by[7][0].payload is None
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
    assert {r.record_type for r in warc.round_trip(spark.createDataFrame(rows[:3], PAGES), min_bytes=100).collect()} == {"response"}


def archive(records, dictionary=b"WARC/1.1\r\nWARC-Type: response\r\n" * 20):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc.archive_start(dictionary) + b"".join(packer.compress(r) for r in records)


def test_warc_reader_validates():
    good = warc.build("response", "<urn:page:1:0>", "u", b"abc", warc.payload_digest(b"abc"), None)
    assert [r["payload"] for r in warc.read_archive(archive([good, good]))] == [b"abc", b"abc"]
    plain = struct.pack("<II", warc.DICTIONARY_MAGIC, 4) + b"abcd"
    assert list(warc.read_archive(plain)) == []
    bad = [good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"\r\n\r\nabc", b"\r\n\r\nabx"), good[:-1], good + b"x", good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"response\r\nWARC-Rec", b"other\r\nWARC-Rec")]
    for r in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(archive([r])))
    for data in (archive([good])[:-3], b"junk" * 5, archive([good]) + b"tail", struct.pack("<II", warc.DICTIONARY_MAGIC, 100) + b"x"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(data))


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_with_nulls_and_clashing_columns(spark):
    import corpus_pipeline
    from helixmill.llm.common import written

    rng = random.Random(31)
    texts = ["\n".join(words(rng, 14) + "." for _ in range(8)) for _ in range(30)]
    df = docs(spark, [*texts, texts[0], None, ""]).union(spark.createDataFrame([(None, texts[1], None, None, None), (None, None, None, None, None), (4, texts[4], "en", "s", 0)], DOCS))
    for c in ("id", "root", "hash", "lang_pred", "score", "spans", "length"):
        df = df.withColumn(c, F.lit("clash"))
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = written(stage(spark, df, ""), "test")
        assert df.columns == columns and df.where("length <> 'clash'").isEmpty(), name
    assert 25 <= df.where("doc_id is not null").select("doc_id").distinct().count() == df.where("doc_id is not null").count()
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() >= df.count()


def test_pipeline_on_the_smallest_table(spark):
    import corpus_pipeline
    from helixmill.llm.common import written

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, first = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = written(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert new.columns == columns, name
        assert new.join(docs, "doc_id", "left_anti").count() == 0 and new.select("doc_id").distinct().count() == new.count()
        if name == "SimHash near-dedup":
            sets = [shingles(r.text) for r in new.collect()]
            close = sum(len(a & b) >= 0.85 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
            assert close == 0
        if name == "suffix-array dedup":
            before = plain_removal([(r.doc_id, r.text) for r in docs.collect()])
            lost = {d for d, n, removed, *_ in before if n and n == removed}
            assert {r.doc_id for r in new.collect()} == {r.doc_id for r in docs.collect()} - lost
        docs = new
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.select("doc_id").distinct().count() == docs.count() <= first
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_nearest_neighbours_of_each_length(spark):
    rows = [(0, [1.0, 2.0]), (3, [1.0, 2.5]), (100, [4.0, 6.0, 1.0]), (7, [4.0, 6.0, 3.0]), (200, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 3, 0.5), (100, 1, 7, 2.0)]


def test_more_lists_are_read_where_there_are_more(spark, monkeypatch):
    """With few lists read by default, one in PROBED of them is."""
    v = np.random.default_rng(3).normal(size=(1200, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    for name, value in (("MIN_PROBES", 1), ("MAX_PROBES", 1), ("RATIO", 1e9), ("PROBED", 1)):
        monkeypatch.setattr(ann, name, value)
    x, found = v.astype(np.float64), 0
    for r in ann.nearest(df).collect():
        d = np.sqrt(((x - x[r.query_id]) ** 2).sum(1))
        d[r.query_id] = np.inf
        found += r.vec_id in np.lexsort((np.arange(1200), d))[:10]
    assert found == 120  # all lists are read
