"""Radix selection against sorting all rows."""

import hashlib
import math
import random

import pytest

from helixmill.operators import sampling

COLUMNS = "key string, label int, v int"


def first(rows, n, seed):
    return sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|{seed}".encode()).hexdigest() if r[0] is not None else "", r))[:n]


def selected(spark, rows, n, seed=7, parts=3):
    df = spark.createDataFrame(rows, COLUMNS).repartition(parts)
    return sampling.first_rows(df, "key", n, seed)


def told(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("leaf, digits", [(1 << 12, 3), (1, 1), (5, 2)])
def test_smallest_rows(spark, monkeypatch, leaf, digits):
    monkeypatch.setattr(sampling, "LEAF", leaf)
    monkeypatch.setattr(sampling, "DIGITS", digits)
    rows = [(f"k{i}", i % 2, i) for i in range(300)]
    for n in (0, 1, 17, 299, 300, 999):
        assert told(selected(spark, rows, n).collect()) == told(first(rows, n, 7))


@pytest.mark.parametrize("leaf", [1 << 12, 2])
def test_ties_at_the_border(spark, monkeypatch, leaf):
    """A key that most rows have, whole rows that repeat, and rows without a key: exactly n rows, the first by the other columns."""
    monkeypatch.setattr(sampling, "LEAF", leaf)
    draw = random.Random(leaf)
    rows = [("hot", i % 2, i // 3) for i in range(60)] + [(f"k{i}", 1, draw.randrange(9)) for i in range(20)] + [(None, 0, i) for i in range(5)]
    for n in (3, 20, 40, 70, 84):
        assert told(selected(spark, rows, n).collect()) == told(first(rows, n, 7))


def test_classes(spark):
    rows = [(f"k{i}", (1, 0, None)[i % 3], i) for i in range(90)] + [("k0", 1, 0)]
    of = lambda label: [r for r in rows if r[1] == label]
    df = spark.createDataFrame(rows, COLUMNS)
    assert told(sampling.per_class(df, "key", 10, 3).collect()) == told(first(of(1), 10, 3) + first(of(0), 10, 3) + first(of(None), 10, 3))
    half = sampling.balanced(df, "key", 0.5, 3)
    assert told(half.collect()) == told(first(of(1), 15, 3) + first(of(0), 15, 3))
    split = sampling.random_split(df, "key", 0.1, 3).collect()
    assert told((r.key, r.label, r.v) for r in split if r.split == "val") == told(first(rows, 9, 3)) and len(split) == len(rows)
    with pytest.raises(ValueError, match="nothing to balance"):
        sampling.balanced(df.where("label = 1"), "key", 0.5, 3)
    empty = df.where("false")
    assert sampling.per_class(empty, "key", 3, 1).count() == sampling.random_split(empty, "key", 0.1, 1).count() == sampling.first_rows(empty, "key", 2, 1).count() == 0


def test_no_window_in_the_plans(spark):
    df = spark.createDataFrame([(f"k{i}", i % 2, i) for i in range(30)], COLUMNS)
    for out in (sampling.per_class(df, "key", 3, 1), sampling.balanced(df, "key", 0.5, 1), sampling.random_split(df, "key", 0.2, 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan


def test_groups_of_ranks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "GROUP", 2)
    rows = [(f"k{i}", i % 2, i) for i in range(100)]
    ranked = sampling.hash_rank(spark.createDataFrame(rows, COLUMNS), "key", 5)
    plan = ranked._jdf.queryExecution().analyzed().toString()
    assert f", {math.ceil(math.log(50, 16))})" in plan
    order = [r[2] for r in first(rows, 100, 5)]
    assert [r.v for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == order
