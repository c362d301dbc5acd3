"""What the driver is asked to hold or to plan."""

from helixmill.llm import components, simhash


def test_balls_are_not_broadcast(spark, monkeypatch):
    """A small table of fingerprints makes many rows of balls, which the planner's estimate doesn't know."""
    monkeypatch.setattr(simhash, "CROWD", 3)
    df = spark.createDataFrame([(1 << i,) for i in range(30)] + [(0,)], "fp long")
    found = simhash.links(df, 31)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    joins = [line for line in plan.splitlines() if "Join" in line and ("[point" in line or "[key" in line) and "Inner" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in j for j in joins)


def test_stars_take_no_round(spark, monkeypatch):
    tables, plain = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: tables.append(name) or plain(df, name))
    for edges, want, rounds in (([(5, 1), (1, 7), (9, 8), (9, 8), (4, 4)], {5: 1, 7: 1, 9: 8}, 0), ([(1, 2), (2, 3), (3, 3)], {2: 1, 3: 1}, 1), ([(3, 1), (3, 2)], {2: 1, 3: 1}, 1)):
        tables.clear()
        got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert len(got) == len(want) and {r.node: r.root for r in got} == want and len(tables) == 1 + rounds
