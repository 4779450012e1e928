"""Sequential operators against brute force and their invariants; edge cases."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import semistructured as S
from millrace.functions import text as T
from millrace.operators import chunking, graph, relational, routing
from millrace.plans import registry


def kahn_by_hand(nodes, links):
    """The smallest ready node by looking through all of them each time."""
    key, out = {i: (k, i) for k, i in nodes}, []
    while True:
        ready = [i for i in key if i not in out and all(p in out or p not in key for p, q in links if q == i)]
        if not ready:
            return out + sorted((i for i in key if i not in out), key=key.get)
        out.append(min(ready, key=key.get))


def test_kahn():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(0, 9)
        nodes = [((r.randint(0, 2),), i) for i in range(n)]
        links = [(r.randrange(10), r.randrange(10)) for _ in range(r.randint(0, 12))]
        links = [(a, b) for a, b in links if a != b]
        assert graph.kahn(nodes, links) == kahn_by_hand(nodes, links)


def test_ordered_subsets(spark):
    quests = spark.createDataFrame([(k, 0, 1, [k // 2] if k > 1 else []) for k in range(1, 30)], "quest_id long, quest_type int, required_level int, prerequisites array<long>")
    chosen = spark.createDataFrame([(c, q) for c in (1, 2) for q in range(1, 30) if q % 3 != c], "char_id long, quest_id long")
    rows = graph.ordered_subsets(chosen, quests).collect()
    for c in (1, 2):
        pos = {r["quest_id"]: r["pos"] for r in rows if r["char_id"] == c}
        assert sorted(pos.values()) == list(range(1, len(pos) + 1))
        assert all(pos[q // 2] < pos[q] for q in pos if q // 2 in pos)


def test_deep_chain_and_cycles(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "pre long, quest_id long")
    assert graph.closure(chain).count() == 300 * 301 // 2
    loop = chain.where("pre < 20").unionByName(spark.createDataFrame([(10, 5)], "pre long, quest_id long"))
    assert sorted(r[0] for r in graph.on_cycles(loop).collect()) == [5, 6, 7, 8, 9, 10]
    assert graph.closure(chain.where("false")).count() == 0
    assert graph.on_cycles(chain).count() == 0


def brute_route(edges, a, b):
    best = None
    nodes = {x for e in edges for x in e[:2]}
    for n in range(len(nodes)):
        for path in itertools.permutations(nodes - {a, b}, n):
            way = [a, *path, b]
            costs = [min((c for s, t, c in edges if (s, t) == leg), default=math.inf) for leg in itertools.pairwise(way)]
            best = min(best or math.inf, sum(costs))
    return best


def test_cheapest_routes(spark):
    r = random.Random(4)
    edges = [(s, t, float(r.randint(1, 9))) for s in range(5) for t in range(5) if s != t and r.random() < 0.5]
    network = spark.createDataFrame([(s, t, "walk", c, f"{s}-{t}", "k") for s, t, c in edges], "source int, target int, method string, cost_seconds double, name string, key string")
    got = {(x["origin"], x["node"]): (x["seconds"], x["path"]) for x in routing.cheapest(network, ["key"]).collect()}
    for a, b in itertools.permutations(range(5), 2):
        want = brute_route(edges, a, b)
        assert (want == math.inf and (a, b) not in got) or got[a, b][0] == want
    cost = {f"{s}-{t}": c for s, t, c in edges}
    assert all(sum(cost[n] for n in path) == seconds for seconds, path in got.values())


def test_alternatives_differ(spark):
    edges = [(0, 1, 5.0), (1, 2, 5.0), (0, 2, 30.0), (0, 3, 6.0), (3, 2, 6.0)]
    network = spark.createDataFrame([(s, t, "walk", c, f"{s}-{t}") for s, t, c in edges], "source int, target int, method string, cost_seconds double, name string")
    rows = routing.alternatives(network, spark.createDataFrame([(0, 2)], "origin int, destination int")).orderBy("rank").collect()
    assert [(r["seconds"], r["path"]) for r in rows] == [(10.0, ["0-1", "1-2"]), (12.0, ["0-3", "3-2"])]


def walked(points):
    """The same tour, place by place: the nearest next, then runs reversed while that helps."""
    gap = lambda a, b: math.hypot(points[a][0] - points[b][0], points[a][1] - points[b][1])
    order, left = [0], set(range(1, len(points)))
    while left:
        order.append(min(left, key=lambda k: (gap(order[-1], k), k)))
        left.remove(order[-1])
    length = lambda o: sum(gap(a, b) for a, b in itertools.pairwise(o))
    for _ in range(routing.TWO_OPT_PASSES if 4 <= len(order) <= routing.TWO_OPT_LIMIT else 0):
        before = list(order)
        for i, j in itertools.combinations(range(1, len(order)), 2):
            other = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
            order = other if length(other) < length(order) - 1e-9 else order
        if order == before:
            break
    return order


def test_tours(spark):
    r = random.Random(5)
    groups = {(k, None if k % 7 == 0 else "z"): [(r.random(), r.random()) for _ in range(n)] for k, n in enumerate([1, 2, 3, 4, 4, 5, 8, 12, 30, 70, 1, 4])}
    groups[99, "z"] = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]
    groups[98, "z"] = [(0.5, 0.5)] * 5
    rows = [(c, z, k, f"p{k}", x, y) for (c, z), points in groups.items() for k, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "char_id long, zone string, ord int, point_id string, x double, y double").repartition(5)
    got = {}
    for t in routing.tours(df, ["char_id", "zone"]).orderBy("char_id", "pos").collect():
        got.setdefault((t["char_id"], t["zone"]), []).append((int(t["point_id"][1:]), t["distance"]))
    assert got.keys() == groups.keys()
    for key, points in groups.items():
        want = walked(points)
        assert [k for k, _ in got[key]] == want, key
        assert [d for _, d in got[key]] == pytest.approx([0.0] + [math.hypot(points[a][0] - points[b][0], points[a][1] - points[b][1]) for a, b in itertools.pairwise(want)])
    assert sum(d for _, d in got[99, "z"]) == pytest.approx(3.0)
    assert routing.tours(df.where("false"), ["char_id", "zone"]).count() == 0


def test_circles_of_negative_cost_are_an_error(spark):
    edges = spark.createDataFrame([("x", 1, 2, "walk", 5.0, "a"), ("x", 2, 1, "walk", -6.0, "b")], "kind string, source int, target int, method string, cost_seconds double, name string")
    with pytest.raises(ValueError, match="negative"):
        routing.cheapest(edges, ["kind"])


def test_ways_round_trip(spark):
    df = spark.createDataFrame([(7, 0.25, 0.5, "old | mill\nby the  lake"), (3, 0.0, 1.0, "")], "m long, x double, y double, label string")
    line = df.select(routing.way_command(F.col("m"), F.col("x"), F.col("y"), F.col("label")).alias("c"))
    back = line.select(*[c.alias(k) for k, c in routing.parsed_way(F.col("c")).items()]).collect()
    assert [tuple(r) for r in back] == [(7, 0.25, 0.5, "old mill by the lake"), (3, 0.0, 1.0, "")]


def test_chunks():
    sizes = chunking.Sizes(target=25, most=32, overlap=5, least=6)
    assert chunking.chunks_of("H", "", "") == [("H", [])]
    assert chunking.chunks_of("H", "f: 1", "  \n# only\n") == [("H\nf: 1", [])]
    body = "# One\n" + "\n\n".join(" ".join(f"w{k}x{i}." for i in range(12)) for k in range(6)) + "\n## Two\nshort\n=== Deep ===\n" + "z" * 400
    got = chunking.chunks_of("H", "f: 1", body, sizes)
    assert [("f: 1" in t) for t, _ in got] == [True] + [False] * (len(got) - 1)
    assert all(t.startswith("H\n") for t, _ in got)
    assert {tuple(p) for _, p in got} == {("One",), ("Two",), ("Two", "Deep")}
    assert all(len(t) <= 4 * (sizes.most + sizes.overlap) + 40 for t, _ in got)
    joined = " ".join(t for t, _ in got)
    assert all(f"w{k}x{i}." in joined for k in range(6) for i in range(12)) and sum(t.count("z") for t, _ in got) >= 400
    assert chunking.tail("abc", 5) == "abc" and chunking.tail("one two three", 5) == "three" and chunking.tail("ends. And so", 8) == "And so"
    assert list(chunking.pieces("aa. bb. cc.", 7)) == ["aa. bb.", "cc."] and list(chunking.pieces("x" * 7, 3)) == ["xxx", "xxx", "x"]


def test_upsert_keeps_and_touches(spark):
    old = spark.createDataFrame([("a", "1", 0), ("b", "2", 0), ("c", None, 0)], "k string, h string, t int")
    new = spark.createDataFrame([("a", "1", 9), ("b", "3", 9), ("c", None, 9), ("d", "4", 9)], "k string, h string, t int")
    got = {r["k"]: (r["h"], r["t"]) for r in relational.upsert(old, new, "k", ["h"], "t").collect()}
    assert got == {"a": ("1", 9), "b": ("3", 9), "c": (None, 9), "d": ("4", 9)}
    assert {r["k"]: r["action"] for r in relational.upsert_actions(old, new, "k", ["h"]).collect()} == {"a": "touch", "b": "update", "c": "touch", "d": "insert"}


def test_text_edges(spark):
    df = spark.createDataFrame([("",), (None,), (" a\r\n\r\n\r\n\r\nb\t c ",)], "t string")
    assert [r[0] for r in df.select(T.normalise_text(F.col("t"))).collect()] == ["", None, "a\n\nb c"]
    assert spark.range(1).select(S.percent(F.lit(1.0), F.lit(0.0)).alias("p")).first()["p"] is None


def test_disabled_sources_are_refused(spark, tmp_path):
    import pytest

    from millrace.sources import connectors

    spark.createDataFrame([(1, "http://x/en/a", "<p>b</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert connectors.read(spark, "wiki", str(tmp_path)).first()["body"] == "<p>b</p>"
    assert connectors.read(spark, "guides", str(tmp_path)).first()["body"] == ""
    with pytest.raises(PermissionError):
        connectors.read(spark, "scraped", str(tmp_path))
    assert "scraped" not in connectors.enabled()
    with pytest.raises(ValueError):
        connectors.connector("nobody")(lambda s, p: None)


def test_provider_batches(spark):
    from millrace.sources import connectors

    rows = spark.createDataFrame([(k, None if k % 5 == 0 else " " if k % 5 == 1 else f"t{k}") for k in range(40)], "id long, text string")
    got = connectors.embedded(rows, "id", "text", lambda texts: [[float(len(texts)), float(t[1:])] for t in texts], 2, size=4).collect()
    assert len(got) == 40 and all(1 <= r["embedding"][0] <= 4 and r["embedding"][1] == r["id"] if r["id"] % 5 > 1 else r["embedding"] == [0.0, 0.0] for r in got)


def test_eligible_counts(spark):
    r = random.Random(5)
    have = [(k, r.choice(["alliance", "horde", None]), r.choice([None, *range(1, 9)])) for k in range(100, 400)]
    need = [(k, r.choice(["alliance", "horde", None]), r.choice([None, *range(2, 9)])) for k in range(60)]
    characters = spark.createDataFrame(have, "char_id long, faction string, level int")
    quests = spark.createDataFrame(need, "quest_id long, faction string, required_level int")
    want = {c: sum((f is None or g is None or f == g) and (m is None or lv is None or m <= lv) for _, g, m in need) for c, f, lv in have}
    assert {x["char_id"]: x["n"] for x in relational.eligible_counts(characters, quests).collect()} == want
    assert [x["n"] for x in relational.eligible_counts(characters, quests.where("false")).limit(3).collect()] == [0, 0, 0]


def test_whole_eligibility_keeps_all_characters(spark):
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    got = registry.QUERIES["f13b_quest_eligibility_all"](spark, sf)
    assert got.count() == n > 200 and got.where("n > 0").count() == n


def test_positions_of_a_hot_group(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", (i * 7919) % 400) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = relational.positions(df, ["g"], [F.col("x").desc()]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(g, x): 1 + sum(1 for h, y in rows if h == g and y > x) for g, x in rows}
    assert len(got) == 400 and {(r["g"], r["x"]): r["pos"] for r in got} == want
    assert relational.positions(df.where("false"), ["g"], [F.col("x")]).count() == 0


def test_closure_against_search(spark):
    links = [(i, (i * i + 3) % 61) for i in range(60)] + [(i, i + 7) for i in range(0, 50, 3)]
    after: dict[int, set[int]] = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    want = set()
    for a in after:
        seen, open_ = set(), [a]
        while open_:
            new = after.get(open_.pop(), set()) - seen
            seen |= new
            open_ += new
        want |= {(a, b) for b in seen}
    got = [(r["pre"], r["quest_id"]) for r in graph.closure(spark.createDataFrame(links, "pre long, quest_id long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_closure_by_lists(spark, monkeypatch):
    links = [(k // d, k) for k in range(2, 400) for d in (2, 3) if k // d] + [(1000, 1001), (1001, 1002), (1002, 1001), (1002, 1003), (7, 1003), (9, 1001), (1003, 1004)]
    after: dict[int, set[int]] = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    want = set()
    for a in after:
        todo = list(after[a])
        while todo:
            if (a, b := todo.pop()) not in want:
                want.add((a, b))
                todo += after.get(b, ())
    written = []
    kept = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (out := kept(df), written.append(out.count()))[0])
    df = lambda some: spark.createDataFrame(some, "pre long, quest_id long")
    plain = [x for x in links if x[1] < 1000]
    got = [tuple(r) for r in graph.closure(df(plain)).collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in want if x[1] < 1000}
    assert sum(written) < len(set(plain)) + 2 * 400 < len(got)  # a list each, and no pair
    for name, most in (("ROUNDS", 3), ("WIDE", 1), ("LONG", 12), ("ROUNDS", 32)):
        with monkeypatch.context() as m:
            m.setattr(graph, name, most)
            got = [tuple(r) for r in graph.closure(df(links)).collect()]
            assert len(got) == len(set(got)) and set(got) == want, name
