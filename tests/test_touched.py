"""Statuses of touched pairs are those of the general judge, with fewer shuffles of pairs."""

from __future__ import annotations

import random

from millrace.operators import graph as G

QUESTS = "quest_id long, campaign string, quest_type int, required_level int, faction string, prerequisites array<long>"


def _tables(spark):
    r = random.Random(7)
    quests = [(q, r.choice(["a", "b", None]), r.choice([0, 3, 5]), r.choice([1, 5, None]), r.choice(["x", "y", None, None]), r.choice([None, [], [q - 1], [q - 1, q - 2], [q - 1, q - 1], [q, 3], [None, 2], [900, 1]])) for q in range(1, 40)]
    pairs = lambda n: [(r.randrange(1, 12), r.choice([*range(1, 40), 900, 901])) for _ in range(n)]
    any_of = [(r.choice(["a", "b"]), r.randrange(3), r.choice([*range(1, 40), 900])) for _ in range(60)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    pair = "char_id long, quest_id long"
    return frame(quests, QUESTS), frame([(c, r.choice([1, 3, 9]), r.choice(["x", "y", None])) for c in range(1, 10)], "char_id long, level int, faction string"), frame(pairs(90), pair), frame(pairs(40), pair), frame(any_of, "chain string, grp int, quest_id long")


def test_touched_pairs_are_judged_alike(spark):
    quests, who, done, active, any_of = (t.cache() for t in _tables(spark))
    expected = G.statuses(G.touched(done, active, G.edges(quests)), quests, who, done, active, any_of)
    got = G.touched_statuses(quests, who, done, active, any_of)
    rows = sorted(tuple(r) for r in got.select("char_id", "quest_id", "status").collect())
    assert rows == sorted(tuple(r) for r in expected.collect()) and len({r[2] for r in rows}) >= 5
    full = lambda df: sorted(map(str, df.select("char_id", "quest_id", "rank").collect()))
    assert full(G.available(got, quests)) == full(G.available(expected, quests))
    told = lambda df: sorted(map(str, df.collect()))
    assert told(G.campaign_progress(got, quests)) == told(G.campaign_progress(expected, quests))


def test_pairs_of_a_character_move_once(spark):
    from millrace.plans import graph

    plan = graph.judged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(char_id" in line]
    # the two lists of bought quests are told apart, then all pairs and the characters meet
    assert len(moved) <= 4, moved
