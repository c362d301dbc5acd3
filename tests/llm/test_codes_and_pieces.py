"""Vector codes against plain comparison with every entry, SentencePiece pieces against the library."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from helixmill.llm import codes, pieces, queries

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, codes string, `x` int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{(id, place among its id's rows sorted by code)...} as a sorted list of (id, codes, error), and the codebooks."""
    whole = [(i, [math.floor(float(np.float32(c)) * scale) for c in v]) for i, v in rows]
    width = -(-len(whole[0][1]) // parts)
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, v in whole]
    first = sorted(range(len(rows)), key=lambda r: ((rows[r][0] is None, rows[r][0] or 0), [float(np.float32(c)) for c in rows[r][1]]))[:entries]
    books = [[list(cut[r][p]) for r in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min((apart(c[p], z), k) for k, z in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for k in range(len(first)):
                mine = [c[p] for c, n in zip(cut, found) if n[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((-1 if i is None else i, [k for _, k in n], sum(d for d, _ in n)) for (i, _), n in zip(whole, near())), books


def by_operator(spark, rows, n=3, **how):
    df = spark.createDataFrame([(i, v, None, "clash", 1) for i, v in rows], VECTORS).repartition(n)
    found, books = codes.compress(df, **how)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.codes, r.error) for r in found.collect()), books.tolist()


@pytest.mark.parametrize("n, width, entries", [(300, 8, 16), (40, 6, 64), (1, 5, 4), (700, 4, 40)])
def test_codes_are_those_of_plain_comparison(spark, n, width, entries):
    draw = random.Random(n)
    rows = [(draw.randrange(n), [draw.choice((draw.gauss(0, 0.02), 0.0, -0.25, 0.125)) for _ in range(width)]) for _ in range(n)]
    rows += rows[: n // 3]  # repeated rows, many ties
    rows.append((None, [0.5] * width))
    found, books = by_operator(spark, rows, entries=entries, rounds=3)
    want, want_books = plain(rows, entries=entries, rounds=3)
    assert books == want_books
    assert found == want
    assert by_operator(spark, rows, n=1, entries=entries, rounds=3) == (found, books)


def test_trees_assign_each_point_once_to_its_nearest_entry():
    draw = np.random.default_rng(5)
    for n, spread in ((1, 10), (9, 3), (1000, 4), (5000, 2000)):
        points, book = draw.integers(-spread, spread, (n, 3)), draw.integers(-spread, spread, (50, 3))
        tree = codes.Tree.unpacked(codes.Tree(points).packed(), n)
        got, total = np.full(n, -1), np.zeros((50, 3), np.int64)
        for entry, begin, end, sums in tree.assign(book):
            np.add.at(total, entry, sums)
            for k, a, b in zip(entry, begin, end):
                assert (got[tree.order[a:b]] == -1).all()
                got[tree.order[a:b]] = k
        want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (got == want).all()
        assert (total == [points[want == k].sum(0) for k in range(50)]).all()


def test_whole_subtrees_are_assigned():
    tree = codes.Tree(np.concatenate([np.zeros((4096, 2), int), np.full((4096, 2), 1000)]))
    runs = [x for run in tree.assign(np.array([[1, 1], [999, 999]])) for x in run[0]]
    assert len(runs) == 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 0.3, 0.4]), (2, None), (3, []), (4, [nan, 0.0, 0.0, 0.0]), (5, [inf, 0.0, 0.0, 0.0]), (6, [None, 0.0, 0.0, 0.0]), (7, [3e38, -3e38, 0.0, 0.0]), (8, [0.1, 0.2, 0.3]), (9, [0.1, 0.2, 0.3, 0.4])]
    found, books = by_operator(spark, rows)
    assert [(i, c is None) for i, c, _ in found] == [(1, False), (7, False), (8, True), (9, False)]
    assert np.array(books).shape == (4, 3, 1) and max(map(abs, np.ravel(books))) == 2**29
    assert by_operator(spark, []) == ([], [[], [], [], []])
    assert by_operator(spark, rows[1:4])[0] == []


def test_label_errors_put_null_labels_together(spark):
    df = spark.createDataFrame([(i, [i * 0.1] * 4, label, "", 1) for i, label in enumerate([1, 1, None, None, 2])], VECTORS)
    found = codes.with_label_error(codes.compress(df, entries=2, rounds=0)[0]).collect()
    error = {r.vec_id: r.error for r in found}
    want = {i: error[0] + error[1] if i < 2 else error[2] + error[3] if i < 4 else error[4] for i in range(5)}
    assert {r.vec_id: r.label_error for r in found} == want and want[2] > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_codes_query_equals_its_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    columns = "vec_id, code, error, label_error, codebooks_sha256"
    got = sorted(tuple(r) for r in queries.op11_vector_codes(spark, DATA).select(*columns.split(", ")).collect())
    assert got == sorted(c.sql(f"select {columns} from ({codes.ORACLE})").fetchall())


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(queries.PIECES)


PARTS = [" ", "  ", "\n", "\t", "\0", "▁", "the", "tion", "é", "й", "語", "😀", "──", "==", "<s>", "<0x41>", "́", "İ", "1", ".", "..."]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(alphabet="abet h▁ .", max_size=80)))
def test_pieces_are_the_librarys(codec, text):
    ids = codec.encode(text)
    assert ids == codec.library.encode(text)
    assert codec.decode(ids) == codec.library.decode(ids)


def test_prefix_table_without_words(codec):
    """Whole texts through the table, as for models whose pieces run over spaces."""
    draw = random.Random(3)
    vocabulary = list(codec.ids)
    for _ in range(300):
        text = "".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 12)))
        assert list(codec.word(codec.library.normalize(text))) == codec.library.encode(text)


@pytest.mark.parametrize("text", [" " * 200_001, "a" * 200_001, "ab c" * 100_000, "\n" * 70_000, "x" + "▁ " * 50_000, "😀" * 40_000, "word " * 60_000])
def test_long_texts(codec, text):
    assert codec.encode(text) == codec.library.encode(text)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 3)
    monkeypatch.setattr(pieces, "STRETCH", 7)
    small, text = pieces.MergePieces(queries.PIECES), "one two  three four five six\nseven one two " * 5
    assert small.encode(text) == small.library.encode(text) and len(small.kept) <= 3


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[300].type = sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
    with open(tmp_path / "m", "wb") as f:
        f.write(model.SerializeToString())
    with pytest.raises(ValueError, match="defined by the user"):
        pieces.MergePieces(str(tmp_path / "m"))


def test_encode_decode_and_digests(spark, codec):
    rows = [(1, "The quick  brown fox.", 1), (2, None, 2), (3, "", 3), (None, "naïve 語\n", 4), (1, "The quick  brown fox.", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = pieces.encode(docs, queries.PIECES)
    assert sorted((r.doc_id or 0, r.ids) for r in encoded.collect()) == sorted((i or 0, codec.library.encode(t or "")) for i, t, _ in rows)
    assert sorted(r.text for r in pieces.decode(encoded, queries.PIECES).collect()) == sorted(t or "" for _, t, _ in rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i or 0, len(ids := codec.library.encode(t or "")), sha(",".join(map(str, ids))), sha(t or "")) for i, t, _ in rows)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs, queries.PIECES).collect()) == want
    assert pieces.round_trip(docs.limit(0), queries.PIECES).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pieces_of_all_documents(spark, codec):
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    found = queries.op12_sentencepiece(spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = codec.library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest())
