"""Entities by spec: gaps and odd shapes of records, sources that fail, indexes of sitemaps."""

from __future__ import annotations

import json

from millrace.operators import records
from millrace.sources import entities as E


def _told(spark, rows):
    given = [(kind, i, payload if payload is None or isinstance(payload, str) else json.dumps(payload)) for kind, i, payload in rows]
    return {r["source_id"]: r for r in E.documents(spark.createDataFrame(given, "entity string, id long, payload string")).collect()}


def test_records_with_gaps(spark):
    got = _told(
        spark,
        [
            ("mount", 1, {"name": "Ram"}),
            ("mount", 2, {"name": "Ram", "source": {}, "faction": {"type": "X"}, "should_exclude_if_uncollected": True}),
            ("mount", 3, {"name": ""}),
            ("mount", 4, None),
            ("mount", 5, "{oops"),
            ("mount", 6, "[]"),
            ("unheard of", 7, {"name": "x"}),
            ("achievement", 8, {"name": {"en_US": "A", "de_DE": "B"}, "points": 0, "criteria": {"child_criteria": [{"id": 1}, 5, {"description": ""}]}}),
            ("achievement", 9, {"name": "A", "points": 10, "criteria": {"child_criteria": [{"description": f"c{i}"} for i in range(20)]}}),
            ("boss", 10, {"name": "B", "sections": [{"title": f"t{i}", "body_text": f"b{i}"} for i in range(10)]}),
            ("boss", 11, {"name": "B", "sections": [{"title": "only"}, {"body_text": "text"}]}),
            ("raid", 12, {"name": "R", "category": {"type": "dungeon"}, "modes": [{}], "encounters": []}),
            ("raid", 13, {"name": "R", "category": {"type": "RAID"}}),
            ("quest", 14, {"name": "Q", "rewards": {"money": {"value": 9999}, "experience": 0}}),
            (None, 15, {"name": "x"}),
        ],
    )
    assert sorted(map(int, got)) == [1, 2, 8, 9, 10, 11, 12, 13, 14]
    assert got["1"]["body"] == "" and got["1"]["facts"] == {"id": "1"}
    assert got["2"]["body"] == "Faction: . Not obtainable through normal play."
    assert got["8"]["body"] == "" and got["8"]["title"] == "A" and got["8"]["facts"] == {"id": "8", "points": "0"}
    assert got["9"]["body"] == "Worth 10 achievement points. Criteria: " + "; ".join(f"c{i}" for i in range(12)) + "."
    assert got["10"]["body"] == " ".join(f"\n\n== t{i} ==\nb{i}" for i in range(8))
    assert got["11"]["body"] == "text"
    assert (got["12"]["entity"], got["13"]["entity"]) == ("dungeon", "raid") and got["12"]["body"] == "Difficulties: ."
    assert got["14"]["body"] == "Rewards 0 gold."


def test_index_windows_and_failures(spark):
    index = {"pets": [{"id": i} for i in range(200)] + [{"id": 3}, {"name": "no id"}, 7]}
    indexes = spark.createDataFrame([("pet", json.dumps(index)), ("mount", json.dumps(index)), ("quest", None), ("boss", "{oops")], "entity string, payload string")
    asked = E.windows(E.index_ids(indexes))
    assert sorted((r["entity"], r["batch"], len(r["ids"])) for r in asked.collect()) == [("pet", 0, 96), ("pet", 1, 96), ("pet", 2, 8)]

    def ask(entity, i):
        if i % 50 == 0:
            raise ValueError("gone")
        return json.dumps({"name": f"{entity} {i}"})

    got = E.fetched(asked, ask).collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and sorted(r["id"] for r in got if r["payload"] is None) == [0, 50, 100, 150]
    assert E.documents(E.fetched(asked, ask)).count() == 196


def test_no_entities(spark):
    none = spark.createDataFrame([], "entity string, id long, payload string")
    assert E.documents(none).count() == 0 and E.windows(E.index_ids(none.select("entity", "payload"))).count() == 0


def test_index_of_sitemaps(spark):
    maps = [("a", "<urlset><url><loc>u1</loc></url><url><loc>u2</loc></url></urlset>"), ("b", "<urlset><url><loc>u2</loc></url><url><loc>v</loc></url></urlset>"), ("c", "<sitemapindex><sitemap><loc>d</loc></sitemap></sitemapindex>"), ("d", "<urlset><url><loc>u4</loc></url></urlset>"), ("e", None)]
    roots = [("<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in "abcez") + "</sitemapindex>",), ("<urlset><url><loc>u3</loc></url></urlset>",), ("broken",), (None,)]
    got = records.sitemap_pages(spark.createDataFrame(roots, "xml string"), spark.createDataFrame(maps, "url string, xml string"), ["u"])
    assert sorted(r["url"] for r in got.collect()) == ["u1", "u2", "u3"]


def test_payloads_are_parsed_once(spark):
    details = spark.createDataFrame([("pet", 1, '{"name": "A", "description": "B"}'), ("pet", 2, None), ("pet", 3, "{oops")], "entity string, id long, payload string")
    docs = E.documents(details)
    assert [(r["source_id"], r["title"], r["body"]) for r in docs.collect()] == [("1", "A", "B")]
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") == 1 or plan.count("parseJson") == 1, plan[:2000]


def test_neither_side_of_the_catalogue_is_broadcast(spark):
    from millrace.plans import entities

    plan = entities.told(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    details = spark.createDataFrame([("pet", 1, "a"), ("pet", 2, "b"), ("mount", 1, "c")], "entity string, id long, payload string")
    ids = spark.createDataFrame([("pet", 1), ("pet", 1), ("mount", 3)], "entity string, id long")
    assert [tuple(r) for r in E.named_details(ids, details).collect()] == [("pet", 1, "a")]
