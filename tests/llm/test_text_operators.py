"""bpe, token counts, quality, language ID and packing against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from helixmill.llm import bpe, langid, packing, quality

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(None if t == "null id" else first + i, t, None, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd_texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "Bc", "'s", "1", "é", "...", "\x1c", "\xa0", " word", "中文", "½", "<|endoftext|>"]
    return [None, "", " ", "null id", "x" * 3000, " " * 3000 + "y"] + ["".join(rng.choice(parts) * rng.choice([1, 1, 1, 400]) for _ in range(60)) for _ in range(40)]


def test_chunks_change_nothing():
    small, whole = bpe.codec(RANKS, P.PATTERN, 600), bpe.codec(RANKS, P.PATTERN).core
    for t in odd_texts():
        ids = small.encode(t)
        assert ids == whole.encode_ordinary(t or "") and small.decode(ids) == (t or "").encode()


def test_long_runs():
    c = bpe.codec(RANKS, P.PATTERN)
    for t in (" " * 1_000_000 + "x", "a" * 300_000):
        assert c.decode(c.encode(t)) == t.encode()


def test_round_trip_and_columns(spark):
    d = docs(spark, odd_texts()).withColumn("n_tokens", F.lit("clash"))
    got = bpe.round_trip(d, RANKS, P.PATTERN).collect()
    whole = bpe.codec(RANKS, P.PATTERN).core
    expected = sorted((None if t == "null id" else i, len(ids := whole.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(odd_texts()) if t != "null id")
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == expected
    back = bpe.decode(bpe.encode(d, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {bytes(r.bytes) for r in back.collect()} == {(t or "").encode() for t in odd_texts()}
    assert bpe.round_trip(d.where("false"), RANKS, P.PATTERN).collect() == []


def test_histogram(spark):
    rng = random.Random(3)
    lengths = [rng.choice([0, 1, 5, 5, 5, 1000, 1024, 1025, 5000]) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens long")
    hist = bpe.length_histogram(df)
    for r in hist.collect():
        x = r.n_tokens
        assert (r.docs, r.docs_ge, r.tokens_ge) == (lengths.count(x), sum(y >= x for y in lengths), sum(y for y in lengths if y >= x))
        assert r.truncated_tokens == sum(min(x, y) for y in lengths) and r.quantile == sum(y <= x for y in lengths) / 200
    for r in bpe.at_limits(hist, [0, 3, 1024, 10**6]).collect():
        assert (r.docs, r.docs_over, r.kept_tokens) == (200, sum(y > r.context_limit for y in lengths), sum(min(y, r.context_limit) for y in lengths))
    assert bpe.length_histogram(df.where("false")).collect() == []


def plain_quality(t):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(twice)


def test_quality_base_values(spark):
    rng = random.Random(2)
    texts = [None, "", "\n \t", "a b", "a b c", "a b c a b c", "x\nx\n\nx", "null id"] + [" ".join(rng.choice(["a", "b", "ü|", "c\n"]) for _ in range(rng.randrange(90))) for _ in range(30)]
    got = quality.judge(docs(spark, texts).withColumn("kept", F.lit(1))).collect()
    assert len(got) == len(texts)
    for r in got:
        t = "null id" if r.doc_id is None else texts[r.doc_id]
        base = plain_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    clean = prose(80) + "\n" + prose(70)
    navigation = "\n".join(" | ".join(prose(1) for _ in range(6)) for _ in range(15))
    shouting = "\n".join("!! ".join(prose(1) for _ in range(6)) + "!!" for _ in range(15))
    symbols = " ".join(w + "***" for w in prose(80).split())
    boiler = prose(40) + "\n" + "\n".join(prose(5) + " All rights reserved " + prose(5) for _ in range(9))
    some = clean + "\nHome | About | Contact"
    got = {r.doc_id: r.kept for r in quality.judge(docs(spark, [clean, navigation, shouting, symbols, boiler, some])).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True}
    kept = {r.doc_id: r for r in quality.cleaned(docs(spark, [clean, navigation, some])).collect()}
    assert kept[0].text == clean and kept[2].text == clean and kept[2].n_chars == len(clean) and 1 not in kept


def test_slices_hold_every_text_once():
    rng = random.Random(4)
    texts = ["x" * rng.choice([0, 1, 5, 30]) for _ in range(200)]
    for size in (1, 7, 29, 10**6):
        found = list(packing.slices(texts, size))
        assert [i for a, b in found for i in range(a, b)] == list(range(200))
        assert all(b - a == 1 or sum(map(len, texts[a:b])) <= size for a, b in found)
    assert list(packing.slices([])) == [] and list(packing.slices([""])) == [(0, 1)]


def test_boilerplate_by_form_in_any_language(spark):
    import duckdb

    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghü") for _ in range(6)) for _ in range(n)) + "."
    clean = prose(60) + "\n" + prose(40) + " www.example.org/a " + prose(9) + "\n" + prose(5) + " 2024 1999."
    bad = ["© 2024 " + prose(12), "Siehe bitte hier: https://example.org/impressum", "voir www.example.org", "12.03.2024, 14:55:01.", prose(6) + " ALLE Rechte Vorbehalten " + prose(3), prose(4) + " Política de Privacidad."]
    texts = [clean, *(clean + "\n" + x for x in bad), *("\n".join([prose(60)] + [x] * 200) for x in bad), None, ""]
    table = docs(spark, texts)
    kept = {r.doc_id: r.text for r in quality.cleaned(table).collect()}
    assert kept == {i: clean for i in range(len(bad) + 1)}
    connection = duckdb.connect()
    connection.register("documents", table.toPandas())
    judged = quality.judge(table)
    by_sql = connection.sql(f"select {', '.join(judged.columns)} from ({quality.ORACLE})").fetchall()
    assert sorted(map(str, by_sql)) == sorted(str(tuple(r)) for r in judged.collect())


def test_quality_of_odd_tables(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(3000))
    df = docs(spark, [prose, prose, None, ""]).union(spark.createDataFrame([(None, prose, None, None, None)], DOCS))
    for c in ("kept", "n_words", "__q", "__w", "__n", "__a", "line break"):
        df = df.withColumn(c, F.lit("clash"))
    kept = quality.cleaned(df)
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["0", "1", "None"]
    assert {r.text == prose and r["__q"] == r["line break"] == "clash" for r in kept.collect()} == {True}
    judged = quality.judge(df).collect()
    assert [(r.n_words, r.word_chars) for r in judged if r.doc_id == 0] == [(36_000, len("".join(prose.split())))] and len(judged) == 5
    assert quality.cleaned(df.where("false")).collect() == [] and quality.judge(df.where("false")).collect() == []


def test_token_counts_end_to_end(spark):
    texts = [*odd_texts(), "same", "same", None, ""]
    df = docs(spark, texts).union(spark.createDataFrame([(0, "same", "en", "s", 0), (None, "same", "en", "s", 0)], DOCS))
    for c in ("n_tokens", "docs", "block", "quantile"):
        df = df.withColumn(c, F.lit("clash"))
    whole = bpe.codec(RANKS, P.PATTERN).core
    lengths = [len(whole.encode_ordinary(t or "")) for t in [*texts, "same", "same"]]
    got = bpe.length_histogram(bpe.encoded_lengths(df, RANKS, P.PATTERN)).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in got] == sorted(set(lengths))
    for r in got:
        n = r.n_tokens
        assert (r.docs, r.docs_ge) == (lengths.count(n), sum(x >= n for x in lengths))
        assert (r.tokens_ge, r.total_tokens, r.truncated_tokens) == (sum(x for x in lengths if x >= n), sum(lengths), sum(min(x, n) for x in lengths))
        assert abs(r.quantile - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    assert bpe.length_histogram(bpe.encoded_lengths(df.where("false"), RANKS, P.PATTERN)).collect() == []


def corpora(n=120, seed=5):
    rng = random.Random(seed)
    syllables = {"aa": ["the", "ing", "er", "on", "sh"], "bb": ["der", "ein", "ung", "ich", "sch"], "cc": ["la", "que", "ión", "os", "mente"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(60)) + ".", lang, "s", 0))
    return rows


def test_language_id_held_out(spark):
    rows = corpora() + [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "12 -- !", None, "s", 0), (None, "the ing er", None, "s", 0), (1003, "\U0001F600 the ing er on", None, "s", 0)]
    got = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text, lang, *_ in rows[:120]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and by[i].lang_pred == lang and 0 <= by[i].score <= 1
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "aa" and by[None].held_out is False


def test_language_id_learns_languages_of_one_document(spark):
    rows = corpora() + [(2000 + i, f"uvw{i} uvwx uvw " * 9, f"l{i}", "s", 0) for i in range(12)]
    learnt = {x for i, _, x, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(langid.fit(spark.createDataFrame(rows, DOCS)).languages) == learnt


def test_language_id_learns_nothing_from_held_out(spark):
    rows = [(i, "the ing er on sh " * 20, "aa" if zlib.crc32(str(i).encode()) % 4 != 2 else "zz", "s", 0) for i in range(40)]
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()} == {"aa"}
    empty = langid.identify(spark.createDataFrame([(2, "text", None, "s", 0)], DOCS)).collect()
    assert empty[0].lang_pred == "und"
    assert langid.identify(spark.createDataFrame([], DOCS)).collect() == []


def test_language_id_rejects_noise(spark):
    rng = random.Random(9)
    noise = " ".join("".join(rng.choice("qxzwvkjyüñ") for _ in range(9)) for _ in range(200))
    kept = langid.accepted(spark.createDataFrame([*corpora(), (999, noise, None, "s", 0)], DOCS))
    ids = {r.doc_id for r in kept.collect()}
    assert 999 not in ids and len(ids) == 120 and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def grams_of(texts):
    sym, _, counts = langid.symbols([(t, 0, True) for t in texts])
    return langid.grams(sym)[:, counts]


def plain_kneser_ney(grams):
    """Cost of a gram (a tuple of symbols) by interpolated Kneser-Ney over dictionaries."""
    order, count = len(grams[0]), {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    floor = 1 / (len({g[-1] for g in grams}) + 1)
    levels = [count]  # from the highest order
    for k in range(order - 1, 0, -1):
        kinds, often = {}, {}
        for g, n in levels[-1].items():
            kinds[g[1:]] = kinds.get(g[1:], 0) + 1
            often[g[1:]] = often.get(g[1:], 0) + n
        levels.append({g: often[g] if k > 1 and g[0] == 0 else kinds[g] for g in kinds})

    def p(g):
        if not g:
            return floor
        level = levels[order - len(g)]
        one, two = (sum(n == x for n in level.values()) for x in (1, 2))
        discount = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
        same = [n for x, n in level.items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(level.get(g, discount) - discount, 0) / sum(same) + discount * len(same) / sum(same) * p(g[1:])

    return lambda g: -np.log(max(p(g), 1e-12))


def test_kneser_ney_equals_brute_force():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aabcdé") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(3)] + ["Ab, cab!"]
    rows = grams_of(texts)
    h, first, n = np.unique(langid.hashed(rows, langid.ORDER), return_index=True, return_counts=True)
    m = langid.Model(rows[:, first], n.astype(float))
    cost = plain_kneser_ney([tuple(g) for g in rows.T.tolist()])
    other = grams_of([" ".join("".join(rng.choice("abcdéz") for _ in range(rng.randrange(1, 9))) for _ in range(60))])
    for r in (rows, other):
        assert np.allclose(m.cost(r), [cost(tuple(g)) for g in r.T.tolist()], rtol=1e-5)


def test_rejection_is_calibrated():
    rng = np.random.default_rng(4)
    who = langid.Identifier({}, {}, np.sort(rng.normal(size=3000)))
    z = np.linspace(-3, 12, 400)
    score = who.scores(z)
    assert (np.diff(score) <= 0).all() and score[0] > 0.99 and 0 <= score[-1] < 0.1
    fresh = who.scores(rng.normal(size=200_000))
    assert langid.REJECTED / 3 < (fresh < 0.5).mean() < langid.REJECTED * 3 and 0.85 < np.median(fresh) < 0.95
    assert langid.Identifier({}).scores(z).tolist() == [1.0] * 400


def test_language_id_ties_repeats_long_and_clashing_columns(spark):
    long = "the ing er on sh " * 20_000
    rows = [*corpora(), (7, "the ing er", "aa", "s", 0), (7, "the ing er", "aa", "s", 0), (500, long, None, "s", 0), (501, "x" * 300_000 + "theing" * 50_000, None, "s", 0)]
    got = langid.identify(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (500, 501)} == {"aa"}
    assert len({tuple(r) for r in got if r.doc_id == 7 and r.lang_pred == "aa"}) >= 1
    twin = [(i, "same words here " * 20, "pq"[i % 2], "s", 0) for i in range(40)]
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(twin, DOCS)).collect()} <= {"p", "q"}
    clash = spark.createDataFrame(corpora(), DOCS).withColumns({c: F.lit(c) for c in ("__q", "__hm_lang", "__hm_score")})
    assert langid.accepted(clash).columns == clash.columns and langid.accepted(clash.where("false")).collect() == []
    assert langid.accepted(spark.createDataFrame([(None, corpora()[0][1], None, "s", 0), *corpora()], DOCS)).where("doc_id is null").count() == 1


def test_kneser_ney_sums_to_one():
    rows = grams_of(["abab cab bca abc", "aab"])
    h, first, n = np.unique(langid.hashed(rows, langid.ORDER), return_index=True, return_counts=True)
    m = langid.Model(rows[:, first], n.astype(float))
    for context in ([0, 0, 0, 0], [0, 0, ord("a"), ord("b")], [0, 0, 0, ord("c")]):
        symbols = [0, ord("a"), ord("b"), ord("c")]
        grid = np.array([[*context, s] for s in symbols], np.uint32).T
        assert 0.75 < np.exp(-m.cost(np.ascontiguousarray(grid))).sum() <= 1.0001  # the rest is for unseen symbols


def test_language_models_keep_all_grams(spark, monkeypatch):
    for cap in ("MAX_GRAMS", "MAX_ALL_GRAMS"):
        monkeypatch.setattr(langid, cap, 40, raising=False)
    df = spark.createDataFrame(corpora(), DOCS)
    known = langid.fit(df)
    n = sum(zlib.crc32(str(i).encode()) % 4 != langid.HELD_OUT for i, *_ in corpora())
    aside = {r.doc_id for r in df.where(langid.for_calibration(n)).collect()}
    assert 0 < len(aside) < 60
    for lang, model in zip(known.languages, known.models):
        texts = [t for i, t, x, *_ in corpora() if x == lang and i not in aside and zlib.crc32(str(i).encode()) % 4 != langid.HELD_OUT]
        rows = grams_of(texts)
        h, first, n = np.unique(langid.hashed(rows, langid.ORDER), return_index=True, return_counts=True)
        assert len(h) > 40 and model.orders[-1][0].tolist() == h.tolist()
        assert np.allclose(model.cost(rows), langid.Model(rows[:, first], n.astype(float)).cost(rows))


def test_pieces_of_long_texts():
    old, langid.SLICE = langid.SLICE, 50
    try:
        t = ["ab " * 100, None, "xyz" * 200, "", "c d", "ab, " * 40 + "," * 300 + "word" * 90 + ",;" * 70 + "e" * 200]
        again, found = [""] * len(t), []
        for group, owners in langid.pieces(t):
            for (g, lead, _), o in zip(group, owners):
                again[o] += g[lead:]
            sym, _, counts = langid.symbols(group)
            found += langid.grams(sym)[:, counts].T.tolist()
        assert again == [x or "" for x in t]
        assert found == grams_of([x or "" for x in t]).T.tolist()  # cuts change no gram
    finally:
        langid.SLICE = old


@pytest.mark.parametrize("cache", [500_000, 20])
def test_piece_encoder_equals_library(monkeypatch, cache):
    monkeypatch.setattr(packing, "CACHE", cache)
    from tokenizers import Tokenizer

    e, plain, rng = packing.PieceEncoder(JSON), Tokenizer.from_file(JSON), random.Random(6)
    some = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u180e", "\u200b", "a", "word", "'s", "é", "1", "²", "!", "\u0301", "漢", ".", ",", "'", "...", "é.", "word,", "Ω.", "²,", "_", "\U0001f600", "x" * 80]
    texts = [t or "" for t in odd_texts()] + ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[at : at + 500])]
        assert got == [x.ids for x in plain.encode_batch(texts[at : at + 500], add_special_tokens=False)]


def test_piece_encoder_knows_added_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y <|endoftext|>", "a<|endoftext|", "no token", *(t or "" for t in odd_texts())]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.PieceEncoder(JSON).encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [64, 50256, 65]


@pytest.mark.parametrize("n, expected", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)])])
def test_cut(n, expected):
    assert packing.cut(n, 8) == expected


def best_fit_decreasing(counts, capacity):
    bins = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = [i for i, b in enumerate(bins) if b >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def check_records(records, counts, capacity):
    """The sequences that records use; each piece has its place, and sequences have no holes."""
    seen, parts = {}, {}
    for length, rank, n, k, first, offset in sorted(records):
        assert rank == seen.get(length, 0) and n > 0 and k > 0
        seen[length] = rank + n * k
        for s in range(first, first + n):
            parts.setdefault(s, []).extend((offset + j * length, length) for j in range(k))
    assert seen == counts
    for p in parts.values():
        at = 0
        for o, x in sorted(p):
            assert o == at
            at += x
        assert at <= capacity
    return len(parts)


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([7, 64, 100])
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 14))}
        records, left, _ = packing.sweep([(x, 0, n) for x, n in counts.items()], [], capacity, 0)
        assert left == [] and check_records(records, counts, capacity) == best_fit_decreasing(counts, capacity)


def test_supersteps_are_near_best_fit(spark):
    rng = random.Random(14)
    for capacity in (64, 100):
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 200) for _ in range(25)} | {1: 500}
        records = packing.plan(spark, counts, capacity)
        assert check_records(records, counts, capacity) <= best_fit_decreasing(counts, capacity) * 1.02 + 1
        assert len(records) <= 8 * capacity * (capacity.bit_length() + 1)
    assert packing.plan(spark, {}) == [] and packing.band(2048) == 0 and packing.band(1024) == 1 and packing.band(1) == 11


def test_packing_with_clashing_columns_and_added_tokens(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "a  b", "", None]
    df = docs(spark, texts)
    for c in ("sequence_id", "offset", "length", "piece", "rank", "part"):
        df = df.withColumn(c, F.lit("clash"))
    got = packing.pack_documents(df, JSON).collect()
    plain = Tokenizer.from_file(JSON)  # as it comes
    ids = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got) == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]


def test_packing(spark):
    texts = odd_texts() + ["same text"] * 30
    got = packing.pack_documents(docs(spark, texts), JSON, 64).collect()
    from tokenizers import Tokenizer

    e = Tokenizer.from_file(JSON)  # as it comes
    expected = []
    for i, t in enumerate(texts):
        ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(None if t == "null id" else i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in got) // 64) * 1.05 + 1
    assert packing.pack_documents(docs(spark, []), JSON).collect() == []
    assert bpe.at_limits(spark.createDataFrame([], "n_tokens long, docs long"), [3]).collect() == []
