"""Queries over the prerequisite graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.operators import routing
from millrace.plans.catalog import query
from millrace.plans.routing import TRAVEL_SQL, travel_costs
from millrace.sources.tables import ANY_OF_SQL, CHARACTERS_SQL, COMPLETED_SQL, IN_PROGRESS_SQL, QUESTS_SQL, any_of_groups, characters, completed, in_progress, quests, table

_BASE = f"{QUESTS_SQL}, {CHARACTERS_SQL}, {COMPLETED_SQL}, {IN_PROGRESS_SQL}, {ANY_OF_SQL}"
_STATUS = f"""{_BASE},
touched AS (SELECT * FROM completed UNION SELECT * FROM in_progress UNION SELECT c.char_id, e.quest_id FROM completed c JOIN quest_edges e ON e.pre = c.quest_id),
satisfied AS (SELECT DISTINCT char_id, chain, grp FROM completed JOIN any_of USING (quest_id)),
missing AS (SELECT t.char_id, t.quest_id, e.pre FROM touched t JOIN quest_edges e USING (quest_id) WHERE NOT EXISTS (FROM completed c WHERE c.char_id = t.char_id AND c.quest_id = e.pre)),
excused AS (SELECT DISTINCT m.char_id, m.quest_id, m.pre FROM missing m JOIN quests q USING (quest_id) JOIN any_of a ON a.chain = q.campaign AND a.quest_id = m.pre
  JOIN satisfied s ON s.char_id = m.char_id AND s.chain = a.chain AND s.grp = a.grp),
blocked AS (SELECT DISTINCT char_id, quest_id FROM (FROM missing EXCEPT FROM excused)),
begun AS (SELECT DISTINCT char_id, campaign FROM (FROM completed UNION FROM in_progress) JOIN quests USING (quest_id)),
status AS (SELECT t.char_id, t.quest_id, CASE WHEN c.quest_id IS NOT NULL THEN 'completed' WHEN i.quest_id IS NOT NULL THEN 'in_progress'
    WHEN q.faction <> ch.faction THEN 'ineligible' WHEN b.quest_id IS NOT NULL THEN 'locked' WHEN ch.level < q.required_level THEN 'locked'
    WHEN q.quest_type = 3 AND g.campaign IS NOT NULL THEN 'obsolete' ELSE 'available' END AS status
  FROM touched t JOIN quests q USING (quest_id) JOIN characters ch USING (char_id) LEFT JOIN completed c USING (char_id, quest_id) LEFT JOIN in_progress i USING (char_id, quest_id)
  LEFT JOIN blocked b USING (char_id, quest_id) LEFT JOIN begun g ON g.char_id = t.char_id AND g.campaign = q.campaign)"""


def judged(spark, sf):
    return G.touched_statuses(quests(spark, sf), characters(spark, sf), completed(spark, sf), in_progress(spark, sf), any_of_groups(spark, sf))


@query("g01_graph_edges", f"WITH {QUESTS_SQL} SELECT pre, quest_id FROM quest_edges")
def g01(spark, sf):
    return G.edges(quests(spark, sf))


#: The graph with quests 2 and 5 made to need later ones, so that it has cycles, and quest 7 an unknown one.
_BROKEN = "extra(pre, quest_id) AS (VALUES (12, 2), (40, 5), (-1, 7)), broken AS (SELECT * FROM quest_edges UNION SELECT * FROM extra)"
_REACH = f"WITH RECURSIVE {QUESTS_SQL}, {_BROKEN}, reach AS (SELECT pre, quest_id FROM broken UNION SELECT r.pre, e.quest_id FROM reach r JOIN broken e ON e.pre = r.quest_id)"


def broken(spark, sf):
    more = F.create_map(*[F.lit(x).cast("long") for x in (2, 12, 5, 40, 7, -1)])
    extra = F.try_element_at(more, F.col("quest_id"))
    return quests(spark, sf).withColumn("prerequisites", F.array_distinct(F.concat("prerequisites", F.array_compact(F.array(extra)))))


@query("g02_validation", f"""{_REACH} SELECT 'unknown' AS kind, quest_id, pre AS other FROM broken WHERE pre NOT IN (SELECT quest_id FROM quests)
UNION ALL SELECT 'faction', e.quest_id, e.pre FROM broken e JOIN quests a ON a.quest_id = e.pre JOIN quests b ON b.quest_id = e.quest_id WHERE a.faction <> b.faction
UNION ALL SELECT 'cycle', quest_id, NULL FROM reach WHERE pre = quest_id""")
def g02(spark, sf):
    return G.violations(broken(spark, sf))


@query("g03_cycles", f"{_REACH} SELECT quest_id FROM reach WHERE pre = quest_id")
def g03(spark, sf):
    return G.on_cycles(G.edges(broken(spark, sf)))


@query("g03_closure", f"WITH RECURSIVE {QUESTS_SQL}, reach AS (SELECT pre, quest_id FROM quest_edges UNION SELECT r.pre, e.quest_id FROM reach r JOIN quest_edges e ON e.pre = r.quest_id) SELECT * FROM reach")
def closure(spark, sf):
    return G.closure(G.edges(quests(spark, sf)))


@query("g04_status", f"WITH {_STATUS} SELECT * FROM status")
def g04(spark, sf):
    return judged(spark, sf).select("char_id", "quest_id", "status")


_AVAILABLE = f"""{_STATUS}, open AS (SELECT char_id, quest_id, quest_type, required_level, row_number() OVER (PARTITION BY char_id ORDER BY quest_type, required_level, quest_id) AS rank
  FROM status JOIN quests USING (quest_id) WHERE status = 'available' AND quest_type NOT IN (6, 7, 8))"""


@query("g05_available", f"WITH {_AVAILABLE} SELECT char_id, quest_id, rank FROM open")
def g05(spark, sf):
    return G.available(judged(spark, sf), quests(spark, sf)).select("char_id", "quest_id", "rank")


_BEHIND = f"""WITH RECURSIVE {QUESTS_SQL}, {COMPLETED_SQL}, {IN_PROGRESS_SQL}, behind AS (
  SELECT i.char_id, i.quest_id, e.pre FROM in_progress i JOIN quest_edges e USING (quest_id) WHERE NOT EXISTS (FROM completed c WHERE c.char_id = i.char_id AND c.quest_id = e.pre)
  UNION SELECT b.char_id, b.quest_id, e.pre FROM behind b JOIN quest_edges e ON e.quest_id = b.pre WHERE NOT EXISTS (FROM completed c WHERE c.char_id = b.char_id AND c.quest_id = e.pre))"""


@query("g06_missing_prerequisites", f"{_BEHIND} SELECT * FROM behind")
def g06(spark, sf):
    return G.missing_closure(in_progress(spark, sf), completed(spark, sf), G.edges(quests(spark, sf)))


@query("g08_path_to", f"""{_BEHIND} SELECT char_id, quest_id, count(*) AS steps, min(step) AS first_step FROM (
  SELECT char_id, quest_id, pre AS step FROM behind UNION ALL SELECT char_id, quest_id, quest_id FROM in_progress i WHERE NOT EXISTS (FROM completed c WHERE c.char_id = i.char_id AND c.quest_id = i.quest_id)) x
  WHERE NOT EXISTS (FROM completed c WHERE c.char_id = x.char_id AND c.quest_id = x.quest_id) GROUP BY ALL""")
def g08(spark, sf):
    return G.paths_to(in_progress(spark, sf), completed(spark, sf), G.edges(quests(spark, sf)))


@query("g07_levels", f"""WITH RECURSIVE {QUESTS_SQL}, lv AS (SELECT quest_id, 0 AS level FROM quests UNION SELECT e.quest_id, l.level + 1 FROM lv l JOIN quest_edges e ON e.pre = l.quest_id)
SELECT quest_id, max(level) AS level FROM lv GROUP BY quest_id""")
def g07_levels(spark, sf):
    return G.levels(quests(spark, sf))


@query("g07_topological_order")
def g07(spark, sf):
    return G.ordered_subsets(in_progress(spark, sf), quests(spark, sf))


@query("g09_direct_blockers", f"""WITH {QUESTS_SQL}, {COMPLETED_SQL}, {IN_PROGRESS_SQL} SELECT i.char_id, i.quest_id, e.pre FROM in_progress i JOIN quest_edges e USING (quest_id)
WHERE NOT EXISTS (FROM completed c WHERE c.char_id = i.char_id AND c.quest_id = e.pre)""")
def g09(spark, sf):
    return G.missing(in_progress(spark, sf), completed(spark, sf), G.edges(quests(spark, sf)))


@query("g10_dependents", f"WITH {QUESTS_SQL} SELECT q.quest_id, coalesce(string_agg(CAST(e.quest_id AS VARCHAR), ',' ORDER BY e.quest_id), '') AS dependents, count(e.quest_id) AS n FROM quests q LEFT JOIN quest_edges e ON e.pre = q.quest_id GROUP BY q.quest_id")
def g10(spark, sf):
    return G.dependents(quests(spark, sf)).withColumn("dependents", F.array_join(F.col("dependents").cast("array<string>"), ","))


@query("g11_obsolete_breadcrumbs", f"WITH {_STATUS} SELECT char_id, quest_id FROM status WHERE status = 'obsolete'")
def g11(spark, sf):
    return judged(spark, sf).where("status = 'obsolete'").select("char_id", "quest_id")


@query("g12_quests_by_expansion", f"WITH {QUESTS_SQL} SELECT r_name AS expansion, count(*) AS n, min(quest_id) AS first_quest FROM quests JOIN nation ON n_nationkey = map_id JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def g12(spark, sf):
    zones = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("map_id"), F.col("r_name").alias("expansion"))
    return quests(spark, sf).join(F.broadcast(zones), "map_id").groupBy("expansion").agg(F.count("*").alias("n"), F.min("quest_id").alias("first_quest"))


@query("g13_recommendations", f"""WITH RECURSIVE {_AVAILABLE}, {TRAVEL_SQL},
unlocks AS (SELECT q.quest_id, count(e.quest_id) AS n FROM quests q LEFT JOIN quest_edges e ON e.pre = q.quest_id GROUP BY q.quest_id),
scored AS (SELECT o.char_id, o.quest_id, ch.level - o.required_level AS gap, u.n, o.quest_type, CASE WHEN ch.map_id = q.map_id THEN 0.0::DOUBLE ELSE coalesce(t.seconds, 300.0::DOUBLE) END AS seconds
  FROM open o JOIN quests q USING (quest_id) JOIN unlocks u USING (quest_id) JOIN characters ch USING (char_id)
  LEFT JOIN costs t ON t.faction = ch.faction AND t.grown = (ch.level >= 40) AND t.origin = ch.map_id AND t.node = q.map_id WHERE o.quest_type <> 3),
total AS (SELECT *, round(0.3::DOUBLE * (1 - quest_type / 8::DOUBLE) + 0.25::DOUBLE * least(1.0::DOUBLE, n / 3::DOUBLE) + 0.25::DOUBLE * (1 - least(1.0::DOUBLE, seconds / 300)) + 0.2::DOUBLE *
  CASE WHEN gap < 0 THEN 0.0::DOUBLE WHEN gap <= 5 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (gap - 5) / 20::DOUBLE) END, 6) AS score FROM scored)
SELECT char_id, quest_id, score, seconds, n AS unlocks, rank FROM (SELECT *, row_number() OVER (PARTITION BY char_id ORDER BY score DESC, quest_id) AS rank FROM total) WHERE rank <= 10""")
def g13(spark, sf):
    who = characters(spark, sf)
    travel = routing.for_characters(travel_costs(spark, sf), who)
    return G.recommendations(judged(spark, sf), quests(spark, sf), who, travel).select("char_id", "quest_id", "score", "seconds", "unlocks", "rank")


_SEARCHES = [(1, "red"), (2, "Blue widget"), (3, "brand#1"), (4, "steel gadget"), (5, "!"), (6, "zzz"), (7, "small")]


@query("g14_quest_search", f"""WITH {QUESTS_SQL}, s(query_id, query) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in _SEARCHES)}),
a AS (SELECT query_id, lower(trim(query)) AS q, list_filter(regexp_extract_all(lower(query), '[a-z0-9'']+'), lambda t: length(t) > 1) AS tokens FROM s),
h AS (SELECT quest_id, lower(title) AS title, lower(title || ' ' || campaign) AS hay FROM quests),
w AS (SELECT *, list_filter(regexp_extract_all(hay, '[a-z0-9'']+'), lambda t: length(t) > 1) AS hw FROM h),
n AS (SELECT query_id, quest_id, title, q, len(tokens) AS total, len(list_filter(tokens, lambda t: list_contains(hw, t))) AS whole, len(list_filter(tokens, lambda t: contains(hay, t))) AS part FROM a, w WHERE len(tokens) > 0),
r AS (SELECT query_id, quest_id, round(CASE WHEN whole > 0 THEN whole ELSE part END / total::DOUBLE + CASE WHEN title = q THEN 2.0::DOUBLE WHEN starts_with(title, q) THEN 1.0::DOUBLE WHEN contains(title, q) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score
  FROM n WHERE whole > 0 OR part > 0)
SELECT query_id, quest_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, quest_id) AS rank FROM r) WHERE rank <= 20""")
def g14(spark, sf):
    return G.search(quests(spark, sf), spark.createDataFrame(_SEARCHES, "query_id int, query string"))


@query("g15_campaign_progress", f"""WITH {_STATUS}, total AS (SELECT campaign, count(*) AS total FROM quests GROUP BY campaign),
j AS (SELECT s.*, q.campaign, q.quest_type, q.required_level, row_number() OVER (PARTITION BY char_id, campaign, status ORDER BY quest_type, required_level, quest_id) AS rn FROM status s JOIN quests q USING (quest_id))
SELECT char_id, campaign, total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'available') AS available,
  count(*) FILTER (status = 'locked') AS locked, round(100 * count(*) FILTER (status = 'completed') / total, 1) AS percent,
  coalesce(string_agg(CAST(quest_id AS VARCHAR), ',' ORDER BY rn) FILTER (status = 'available' AND rn <= 3), '') AS next_quests FROM j JOIN total USING (campaign) GROUP BY char_id, campaign, total""")
def g15(spark, sf):
    return G.campaign_progress(judged(spark, sf), quests(spark, sf))


def placed_quests(spark, sf):
    """quests with places: a start, an objective for every odd quest, and a finish that is the start for every third."""
    at = lambda a, b: F.struct(((F.col("quest_id") * a % 101) / 100).alias("x"), ((F.col("quest_id") * b % 101) / 100).alias("y"))
    start = at(37, 61)
    one = F.struct(F.concat(F.lit("Find "), F.col("quest_id").cast("string")).alias("description"), ((F.col("quest_id") * 17 % 101) / 100).alias("x"), ((F.col("quest_id") * 29 % 101) / 100).alias("y"))
    none = F.struct(F.lit("Nowhere").alias("description"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    return quests(spark, sf).select("quest_id", "title", "map_id", start.alias("start"), F.when(F.col("quest_id") % 3 == 0, start).otherwise(at(53, 11)).alias("finish"), F.array(F.when(F.col("quest_id") % 2 == 1, one).otherwise(none)).alias("objectives"))


POINTS_SQL = """points AS (
  SELECT quest_id, map_id, 0 AS k, (quest_id * 37 % 101) / 100 AS x, (quest_id * 61 % 101) / 100 AS y, 'Take: ' || title AS label FROM quests
  UNION ALL SELECT quest_id, map_id, 1, (quest_id * 17 % 101) / 100, (quest_id * 29 % 101) / 100, 'Find ' || quest_id FROM quests WHERE quest_id % 2 = 1
  UNION ALL SELECT quest_id, map_id, 2, (quest_id * 53 % 101) / 100, (quest_id * 11 % 101) / 100, 'Hand in: ' || title FROM quests WHERE quest_id % 3 <> 0
    AND (quest_id * 53 % 101 <> quest_id * 37 % 101 OR quest_id * 61 % 101 <> quest_id * 11 % 101))"""


@query("g16_quest_waypoints", f"WITH {QUESTS_SQL}, {POINTS_SQL} SELECT quest_id, row_number() OVER (PARTITION BY quest_id ORDER BY k) - 1 AS pos, map_id, x, y, label FROM points")
def g16(spark, sf):
    return G.waypoints(placed_quests(spark, sf))


@query("g17_constraints", f"WITH {QUESTS_SQL} SELECT quest_id, 'level' AS problem FROM quests WHERE required_level NOT BETWEEN 1 AND 45 UNION ALL SELECT e.quest_id, 'self' FROM quest_edges e WHERE pre = quest_id UNION ALL SELECT quest_id, 'title' FROM quests WHERE trim(title) = ''")
def g17(spark, sf):
    q = quests(spark, sf)
    checks = F.array_compact(
        F.array(F.when(~F.col("required_level").between(1, 45), "level"), F.when(F.array_contains("prerequisites", F.col("quest_id")), "self"), F.when(F.trim("title") == "", "title"))
    )
    return q.select("quest_id", F.explode(checks).alias("problem"))


@query("a10_graph_stats", f"WITH {QUESTS_SQL} SELECT (SELECT count(*) FROM quests) AS nodes, (SELECT count(*) FROM quest_edges) AS edges, (SELECT count(DISTINCT campaign) FROM quests) AS campaigns, (SELECT count(*) FROM quests WHERE quest_type = 3) AS breadcrumbs")
def a10(spark, sf):
    q = quests(spark, sf)
    size = F.size(F.array_distinct("prerequisites"))
    return q.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("edges"), F.count_distinct("campaign").alias("campaigns"), F.count_if(F.col("quest_type") == 3).alias("breadcrumbs"))


@query("j05_known_dependents", f"WITH {QUESTS_SQL} SELECT pre, quest_id FROM quest_edges WHERE pre IN (SELECT quest_id FROM quests)")
def j05(spark, sf):
    q = quests(spark, sf)
    return G.edges(q).join(q.select(F.col("quest_id").alias("pre")), "pre", "left_semi")


@query("j08_any_of_satisfied", f"WITH {_BASE} SELECT DISTINCT char_id, chain, grp FROM completed JOIN any_of USING (quest_id)")
def j08(spark, sf):
    return completed(spark, sf).join(any_of_groups(spark, sf), "quest_id").select("char_id", "chain", "grp").distinct()
