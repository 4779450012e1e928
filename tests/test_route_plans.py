"""Route plans: no quest before what it needs, few legs, tours and totals that add up; legs against all orders of small plans."""

from __future__ import annotations

import itertools
import os
import random

import pytest

from millrace.operators import graph, route_plans

SF = "/root/testdata/sf0.001"


def fewest_legs(quests, needs):
    """The fewest stays in zones that any order without a broken dependency has, by trying all orders."""
    zone = {q: z for _, q, z in quests}
    best = len(quests)
    for order in itertools.permutations(zone):
        place = {q: k for k, q in enumerate(order)}
        if all(place[p] < place[q] for q in order for p in needs[q]):
            best = min(best, 1 + sum(zone[a] != zone[b] for a, b in itertools.pairwise(order)))
    return best


def whole_zones(quests, start, cost):
    """Zones one by one, the cheapest next, whatever depends on what."""
    left, at, out = {z for _, _, z in quests}, start, []
    while left:
        at = min(left, key=lambda z: (0.0 if z == at or at is None else cost.get((at, z), 600.0), z))
        left.remove(at)
        out.append(at)
    return out


def test_merged_legs():
    r = random.Random(11)
    fewest = many = runs = kept = 0
    for _ in range(300):
        n, zones = r.randint(1, 6), r.randint(1, 3)
        zone = {q: r.randrange(zones) for q in range(1, n + 1)}
        needs = {q: {p for p in range(1, q) if r.random() < 0.3} for q in zone}
        names = dict(zip(zone, r.sample(range(100), n), strict=True))
        zone, needs = {names[q]: z for q, z in zone.items()}, {names[q]: {names[p] for p in ps} for q, ps in needs.items()}
        order = graph.kahn([((0, 0), q) for q in zone], [(p, q) for q, ps in needs.items() for p in ps])
        quests = [(k, q, zone[q]) for k, q in enumerate(order)]
        start = r.choice([None, 0, 1, 7])
        cost = {(a, b): float(r.randrange(1, 90)) for a in (0, 1, 2, 7) for b in range(zones) if a != b and r.random() < 0.9}
        legs = route_plans.merged_legs(r.sample(quests, n), needs, start, cost)
        taken = [q for _, _, stay in legs for q in stay]
        place = {q: k for k, q in enumerate(taken)}
        assert sorted(taken) == sorted(zone) and all(zone[q] == z for z, _, stay in legs for q in stay)
        assert all(place[p] < place[q] for q in zone for p in needs[q])
        ends = [start, *(z for z, _, _ in legs)]
        assert all(a != b for a, b in itertools.pairwise(ends[1:]))
        assert [s for _, s, _ in legs] == [0.0 if a is None or a == b else cost.get((a, b), 600.0) for a, b in itertools.pairwise(ends)]
        runs += 1 + sum(zone[a] != zone[b] for a, b in itertools.pairwise(order))
        whole = whole_zones(quests, start, cost)
        turn = {z: k for k, z in enumerate(whole)}
        if all(turn[zone[p]] <= turn[zone[q]] for q in zone for p in needs[q]):
            assert ends[1:] == whole
            kept += 1
        fewest += fewest_legs(quests, needs)
        many += len(legs)
    assert kept > 100 and many <= 1.01 * fewest and fewest < 0.9 * runs


def test_circles_and_empty_plans():
    assert route_plans.merged_legs([], {}, None, {}) == []
    legs = route_plans.merged_legs([(1, 5, 0), (2, 6, 1), (3, 7, 0)], {5: {6}, 6: {5}, 7: {6}}, None, {})
    assert [(z, stay) for z, _, stay in legs] == [(0, [5]), (1, [6]), (0, [7])]


def test_route_plans(spark):
    quests = spark.createDataFrame(
        [(1, 0, 1, None, 10, 5.0), (2, 0, 1, [1], 20, 7.0), (3, 0, 1, [2, 2, None], 10, None), (4, 0, 1, [99], 10, 1.0), (5, 0, 1, [], None, 1.0), (6, 0, 1, [], 30, 2.0)],
        "quest_id long, quest_type int, required_level int, prerequisites array<long>, map_id int, seconds double",
    )
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, "a"), (1, 1, 0.3, 0.4, "b"), (2, 0, 0.5, 0.5, "c"), (6, 0, 0.0, 0.0, "d"), (6, 1, 0.0, 1.0, "e")], "quest_id long, pos long, x double, y double, label string")
    chosen = spark.createDataFrame([(7, q) for q in (1, 2, 3, 4, 5)] + [(7, 3), (8, 6), (8, 404), (9, 4), (10, 6)], "char_id long, quest_id long")
    done = spark.createDataFrame([(8, 1)], "char_id long, quest_id long")
    who = spark.createDataFrame([(7, "x", True, 20), (8, "x", False, None), (9, "x", True, 10)], "char_id long, faction string, grown boolean, origin int")
    costs = spark.createDataFrame([("x", True, 20, 10, 50.0), ("x", True, 10, 20, 30.0), ("x", False, 20, 10, 1.0)], "faction string, grown boolean, origin int, node int, seconds double")
    zones = spark.createDataFrame([(10, False), (20, True)], "map_id int, flyable boolean")
    args = (chosen, done, quests, points, who, costs, zones)
    got = {r["char_id"]: r for r in route_plans.route_plans(*args).collect()}
    seven = got[7]
    assert [(x["map_id"], list(x["quests"]), x["travel_seconds"], x["estimated"], x["quest_seconds"]) for x in seven["legs"]] == [(10, [1], 50.0, False, 5.0), (20, [2], 30.0, False, 7.0), (10, [3], 50.0, False, 0.0)]
    assert [p["label"] for p in seven["legs"][0]["points"]] == ["a", "b"] and seven["legs"][2]["points"] == []
    assert seven["legs"][0]["zone_seconds"] == pytest.approx(0.5 * 70 * 2.2) and seven["legs"][1]["zone_seconds"] == 0
    assert [tuple(s) for s in seven["skipped"]] == [(4, "requires 99"), (5, "no known place")]
    assert seven["travel_seconds"] == pytest.approx(130 + 77) and seven["total_seconds"] == pytest.approx(130 + 77 + 12)
    assert [(x["map_id"], x["travel_seconds"], x["zone_seconds"]) for x in got[8]["legs"]] == [(30, 0.0, 70.0)] and got[8]["skipped"] == []
    assert got[9]["legs"] == [] and got[9]["total_seconds"] == 0 and [s["quest_id"] for s in got[9]["skipped"]] == [4]
    assert got[10]["total_seconds"] == 72 and set(got) == {7, 8, 9, 10}
    assert route_plans.route_plans(chosen.where("false"), *args[1:]).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_no_pair_is_violated(spark):
    from millrace.plans import registry
    from millrace.sources.tables import quests

    before = {r["quest_id"]: r["prerequisites"] for r in quests(spark, SF).collect()}
    plans = registry.QUERIES["n13_whole_plan"](spark, SF).collect()
    pairs = 0
    for plan in plans:
        place = {q: (leg["leg"], k) for leg in plan["legs"] for k, q in enumerate(leg["quests"])}
        assert all(place[p] < at for q, at in place.items() for p in before[q] if p in place)
        assert [leg["leg"] for leg in plan["legs"]] == list(range(1, len(plan["legs"]) + 1))
        pairs += sum(p in place for q in place for p in before[q])
    assert len(plans) > 50 and pairs > 0
