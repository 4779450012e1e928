"""Characters who may begin at the same places share what they reach."""

from __future__ import annotations

from millrace.operators import routing as N


def test_shared_starts(spark):
    costs = [(f, g, o, n, float(abs(o - n) * 10)) for f in ("horde", "alliance") for g in (True, False) for o in range(4) for n in range(4) if f == "horde" or n != 3]
    people = [(k, "horde" if k % 2 else "alliance", 40 if k % 3 else 10, k % 4) for k in range(60)] + [(70, "horde", 10, 9), (71, None, 10, 1), (5, "alliance", 50, 0)]
    own = [(k, 3, 5.0) for k in range(0, 60, 4)] + [(k, 2, 1.0) for k in range(0, 60, 6)] + [(70, 0, 7.0), (99, 1, 1.0)]
    got = N.with_own_edges(
        spark.createDataFrame(costs, "faction string, grown boolean, origin int, node int, seconds double"), spark.createDataFrame(people, "char_id long, faction string, level int, map_id int"),
        spark.createDataFrame(own, "char_id long, target int, seconds double"),
    )
    best = {}
    for c, f, level, at in people:
        for start, before in [(at, 0.0)] + [(t, s) for who, t, s in own if who == c]:
            for f2, g, o, n, s in costs:
                if (f2, g, o) == (f, level >= 40, start):
                    best[c, n] = min(best.get((c, n), 1e9), before + s)
    rows = got.collect()
    assert len(rows) == len(best) and {(r["char_id"], r["map_id"]): r["seconds"] for r in rows} == best
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" not in plan, "what is reached is judged before characters are joined"
