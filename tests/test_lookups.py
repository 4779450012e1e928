"""Look-ups by parameter: alone and for tables of requests, missing and null parameters, folders read."""

from __future__ import annotations

from millrace.operators import lookups


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_realm_search(spark, tmp_path):
    rows = [("eu", f"s{k:03d}", f"Stone {k % 60:02d}") for k in range(120)] + [("us", "a", "STONE wall"), ("us", "b", "Moor"), (None, "c", "Stone"), ("us", "d", None)]
    lookups.store_realms(spark.createDataFrame(rows, "region string, slug string, name string"), str(tmp_path / "realms"))
    lookups.realm_search(spark, str(tmp_path / "realms"))
    got = spark.sql("SELECT * FROM realm_search('EU', ' sTone ')").orderBy("pos").collect()
    want = sorted((r[2].lower(), r[1]) for r in rows[:120])[:100]
    assert [(r["name"].lower(), r["slug"]) for r in got] == want and [r["pos"] for r in got] == list(range(1, 101))
    asked = spark.createDataFrame([(1, "us", "stone"), (2, "us", None), (3, None, "stone"), (4, "kr", "stone"), (5, "us", "stone"), (6, "us", "%")], "id int, place string, needle string")
    found = spark.sql("SELECT q.id, f.slug FROM {asked} q, LATERAL realm_search(q.place, q.needle) f ORDER BY id, pos", asked=asked).collect()
    assert [tuple(r) for r in found] == [(1, "a"), (2, "b"), (2, "a"), (5, "a")]
    assert "region#" in plan_of(spark.sql("SELECT * FROM realm_search('eu', 'x')")).split("PartitionFilters: [")[1].split("]")[0]


def test_guild_roster(spark, tmp_path):
    rows = [("Area 52", "Night's Watch", k, f"n{k}", None if k % 3 == 0 else k % 50, None if k % 5 == 0 else k % 4) for k in range(300)]
    rows += [("Area_52", "Other", 1000, "x", 1, 0), (None, "Other", 1001, "y", 1, 0), ("Area 52", " ", 1002, "z", 1, 0), ("Ot'her", "Other", 1003, None, None, None)]
    lookups.store_members(spark.createDataFrame(rows, "realm string, guild string, char_id long, name string, level int, rank int").repartition(7), str(tmp_path / "members"))
    lookups.guild_roster(spark, str(tmp_path / "members"))
    one = spark.sql("SELECT * FROM guild_roster('area-52', 'Nights Watch')")
    want = sorted(rows[:300], key=lambda r: (99 if r[5] is None else r[5], -(r[4] or 0), r[2]))
    assert [(r["char_id"], r["name"], r["level"], r["rank"]) for r in one.orderBy("pos").collect()] == [r[2:] for r in want]
    filters = plan_of(one).split("PartitionFilters: [")[1]
    assert "= area-52" in filters.split("]")[0] and "EqualTo(guild_slug,nights-watch)" in filters
    asked = spark.createDataFrame([(1, " Area 52 ", "oTher"), (2, "other", "OTHER"), (3, None, "other"), (4, "area-52", "none"), (5, "area-52", None), (6, "", "")], "id int, realm string, guild string")
    every = spark.sql("SELECT q.id, f.char_id, f.pos FROM {asked} q, LATERAL guild_roster(q.realm, q.guild) f ORDER BY id", asked=asked)
    assert [tuple(r) for r in every.collect()] == [(1, 1000, 1), (2, 1003, 1)]
    assert "Window" not in plan_of(every)
