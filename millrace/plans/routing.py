"""Queries over the travel network, waypoints and tours."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import routing as N
from millrace.plans.catalog import query
from millrace.sources.tables import CHARACTERS_SQL, IN_PROGRESS_SQL, QUESTS_SQL, characters, in_progress, quests, table

#: (mul, add, method, cost, faction, min_level): zone n has an edge to (mul n + add) mod 25.
_RULES = [(3, 1, "portal", 20.0, None, None), (1, 7, "flight path", 90.0, None, None), (2, 3, "boat", 150.0, "alliance", None), (1, 11, "mage portal", 15.0, "horde", 40), (4, 2, "tram", 75.0, None, 40)]
_SQL = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
_CONV = "CASE method " + " ".join(f"WHEN '{m}' THEN {c}" for m, c in N.CONVENIENCE.items()) + " END"
EDGES_SQL = f"""rules(mul, plus, method, cost_seconds, faction, min_level) AS (VALUES {', '.join('(' + ', '.join(map(_SQL, r)) + ')' for r in _RULES)}),
edges AS (SELECT n_nationkey AS source, (n_nationkey * mul + plus) % 25 AS target, method, cost_seconds, method || ' ' || n_nationkey || '-' || (n_nationkey * mul + plus) % 25 AS name, faction, min_level, {_CONV} AS conv
  FROM nation, rules WHERE n_nationkey <> (n_nationkey * mul + plus) % 25)"""
TRAVEL_SQL = f"""{EDGES_SQL},
kinds AS (SELECT DISTINCT faction, level >= 40 AS grown FROM characters),
network AS (SELECT k.faction, k.grown, source, target, cost_seconds, conv FROM edges e, kinds k WHERE (e.faction IS NULL OR e.faction = k.faction) AND (min_level IS NULL OR CASE WHEN k.grown THEN 40 ELSE 0 END >= min_level)),
ways AS (SELECT DISTINCT faction, grown, source AS origin, source AS node, 0.0::DOUBLE AS seconds, 0 AS conv FROM network
  UNION SELECT w.faction, w.grown, w.origin, n.target, w.seconds + n.cost_seconds, w.conv + n.conv FROM ways w JOIN network n ON n.faction = w.faction AND n.grown = w.grown AND n.source = w.node WHERE w.seconds + n.cost_seconds <= 400),
costs AS (SELECT faction, grown, origin, node, min(seconds) AS seconds FROM ways GROUP BY ALL)"""


def travel_edges(spark, sf):
    rules = F.array(*[F.struct(F.lit(m).alias("mul"), F.lit(a).alias("plus"), F.lit(t).alias("method"), F.lit(c).alias("cost_seconds"), F.lit(f).cast("string").alias("faction"), F.lit(lv).cast("int").alias("min_level")) for m, a, t, c, f, lv in _RULES])
    target = F.col("source") * F.col("r.mul") + F.col("r.plus")
    made = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source"), F.explode(rules).alias("r")).select("source", (target % 25).alias("target"), "r.method", "r.cost_seconds", "r.faction", "r.min_level")
    return made.where("source <> target").withColumn("name", F.concat_ws(" ", "method", F.concat_ws("-", F.col("source").cast("string"), F.col("target").cast("string"))))


def network(spark, sf):
    kinds = characters(spark, sf).select("faction", (F.col("level") >= 40).alias("grown"))
    return N.by_capability(travel_edges(spark, sf), kinds)


def travel_costs(spark, sf):
    return N.cheapest(network(spark, sf), ["faction", "grown"])


@query("n03_cheapest_routes", f"WITH RECURSIVE {CHARACTERS_SQL}, {TRAVEL_SQL} SELECT w.faction, w.grown, w.origin, w.node, w.seconds, min(w.conv) AS conv FROM ways w JOIN costs c USING (faction, grown, origin, node, seconds) GROUP BY ALL")
def n03(spark, sf):
    return travel_costs(spark, sf).select("faction", "grown", "origin", "node", "seconds", "conv")


@query("n03_character_routes", f"WITH RECURSIVE {CHARACTERS_SQL}, {TRAVEL_SQL} SELECT char_id, node AS map_id, seconds FROM characters ch JOIN costs c ON c.faction = ch.faction AND c.grown = (ch.level >= 40) AND c.origin = ch.map_id")
def character_routes(spark, sf):
    return N.for_characters(travel_costs(spark, sf), characters(spark, sf))


@query("f12_usable_edges", f"WITH {CHARACTERS_SQL}, {EDGES_SQL} SELECT char_id, count(*) AS n FROM characters ch JOIN edges e ON (e.faction IS NULL OR e.faction = ch.faction) AND (min_level IS NULL OR ch.level >= min_level) GROUP BY char_id")
def f12(spark, sf):
    who = characters(spark, sf).select("char_id", F.col("faction").alias("have"), "level")
    return who.join(F.broadcast(travel_edges(spark, sf)), N.usable(F.col("have"), F.col("level"))).groupBy("char_id").agg(F.count("*").alias("n"))


@query("n04_origin_edges", f"""WITH {CHARACTERS_SQL} SELECT char_id, map_id AS source, target, method, seconds FROM (
  SELECT char_id, map_id, (char_id % 25)::INTEGER AS target, 'hearthstone' AS method, 30.0::DOUBLE AS seconds FROM characters
  UNION ALL SELECT char_id, map_id, 7, 'class teleport', 25.0::DOUBLE FROM characters WHERE class = 'MACHINERY') WHERE map_id <> target""")
def n04(spark, sf):
    made = F.array_compact(
        F.array(
            F.struct((F.col("char_id") % 25).cast("int").alias("target"), F.lit("hearthstone").alias("method"), F.lit(30.0).alias("seconds")),
            F.when(F.col("class") == "MACHINERY", F.struct(F.lit(7).alias("target"), F.lit("class teleport").alias("method"), F.lit(25.0).alias("seconds"))),
        )
    )
    return characters(spark, sf).select("char_id", F.col("map_id").alias("source"), F.explode(made).alias("e")).select("char_id", "source", "e.*").where("source <> target")


@query("n05_alternative_routes")
def n05(spark, sf):
    free = travel_edges(spark, sf).where("faction is null and min_level is null")
    zones = table(spark, sf, "nation").select(F.col("n_nationkey").alias("origin"))
    requests = zones.select("origin", ((F.col("origin") * 7 + 5) % 25).alias("destination")).where("origin <> destination")
    return N.alternatives(free, requests)


@query("n06_outbound_options", f"WITH {EDGES_SQL} SELECT source, name, target, cost_seconds, row_number() OVER (PARTITION BY source ORDER BY cost_seconds, name) AS rank FROM edges")
def n06(spark, sf):
    from pyspark.sql import Window

    return travel_edges(spark, sf).select("source", "name", "target", "cost_seconds", F.row_number().over(Window.partitionBy("source").orderBy("cost_seconds", "name")).cast("long").alias("rank"))


@query("n07_network_violations", f"WITH {EDGES_SQL}, more AS (SELECT source, target, cost_seconds, name FROM edges UNION ALL VALUES (3, 99, 5.0::DOUBLE, 'gate'), (4, 4, -1.0::DOUBLE, 'loop')) SELECT 'zone' AS kind, name FROM more WHERE source > 24 OR target > 24 UNION ALL SELECT 'cost', name FROM more WHERE cost_seconds < 0 UNION ALL SELECT 'loop', name FROM more WHERE source = target UNION ALL SELECT 'twice', name FROM more GROUP BY source, target, name HAVING count(*) > 1")
def n07(spark, sf):
    more = spark.createDataFrame([(3, 99, 5.0, "gate"), (4, 4, -1.0, "loop")], "source int, target int, cost_seconds double, name string")
    zones = table(spark, sf, "nation").select(F.col("n_nationkey").alias("map_id"))
    return N.network_violations(travel_edges(spark, sf).select("source", "target", "cost_seconds", "name").unionByName(more), zones)


@query("n08_generated_edges", "SELECT r_regionkey AS hub, n_nationkey AS target, 'portal ' || r_name || ' to ' || n_name AS name FROM region JOIN nation ON n_nationkey <> r_regionkey")
def n08(spark, sf):
    hubs = F.broadcast(table(spark, sf, "region").select(F.col("r_regionkey").alias("hub"), "r_name"))
    made = table(spark, sf, "nation").join(hubs, F.col("n_nationkey") != F.col("hub"))
    return made.select("hub", F.col("n_nationkey").alias("target"), F.concat(F.lit("portal "), F.col("r_name"), F.lit(" to "), F.col("n_name")).alias("name"))


@query("n09_requirement_text", f"WITH {EDGES_SQL} SELECT name, concat_ws(', ', upper(faction[1:1]) || faction[2:] || ' only', 'level ' || min_level) AS requirement, faction IS NOT NULL OR min_level IS NOT NULL AS restricted FROM edges")
def n09(spark, sf):
    return travel_edges(spark, sf).select("name", N.requirement_text(F.col("faction"), F.col("min_level")).alias("requirement"), (F.col("faction").isNotNull() | F.col("min_level").isNotNull()).alias("restricted"))


_PLACE = "SELECT p_partkey AS id, p_partkey % 25 AS map_id, (p_partkey * 37 % 101) / 100 AS x, (p_partkey * 61 % 101) / 100 AS y FROM part"


def places(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), (k % 25).alias("map_id"), ((k * 37 % 101) / 100).alias("x"), ((k * 61 % 101) / 100).alias("y"))


@query("n01_planar_distance", f"WITH p AS ({_PLACE}) SELECT a.id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM p a JOIN p b ON b.id = a.id + 25 AND b.map_id = a.map_id")
def n01(spark, sf):
    b = places(spark, sf).select((F.col("id") - 25).alias("id"), F.col("map_id").alias("bm"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return places(spark, sf).join(b, "id").where("map_id = bm").select("id", F.round(N.planar_distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")), 6).alias("d"))


@query("n02_zone_seconds", f"WITH p AS ({_PLACE}) SELECT a.id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 70 * CASE WHEN a.map_id % 2 = 0 THEN 1.0::DOUBLE ELSE 2.2::DOUBLE END, 6) AS seconds FROM p a JOIN p b ON b.id = a.id + 25")
def n02(spark, sf):
    b = places(spark, sf).select((F.col("id") - 25).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = N.planar_distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    return places(spark, sf).join(b, "id").select("id", F.round(N.zone_seconds(d, F.col("map_id") % 2 == 0), 6).alias("seconds"))


@query("n14_percent", f"WITH p AS ({_PLACE}) SELECT id, round(x * 100, 2) AS px, round(y * 100, 2) AS py, x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AS valid FROM p")
def n14(spark, sf):
    return places(spark, sf).select("id", F.round(F.col("x") * 100, 2).alias("px"), F.round(F.col("y") * 100, 2).alias("py"), (F.col("x").between(0, 1) & F.col("y").between(0, 1)).alias("valid"))


@query("n15_sanitised_labels", r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[\r\n|]', ' ', 'g'), ' +', ' ', 'g')), 1, 180) AS label FROM documents")
def n15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.sanitised(F.col("text")).alias("label"))


@query("n16_zone_registry", "SELECT r_name AS expansion, count(*) AS zones, min(n_name) AS first_zone FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
def n16(spark, sf):
    z = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return z.groupBy(F.col("r_name").alias("expansion"), "r_regionkey").agg(F.count("*").alias("zones"), F.min("n_name").alias("first_zone")).drop("r_regionkey")


_WAYS = f"WITH p AS ({_PLACE}) SELECT id, '/way #' || map_id || ' ' || printf('%.2f', x * 100) || ' ' || printf('%.2f', y * 100) || ' Point ' || id AS line FROM p"


@query("s18_way_commands", _WAYS)
def s18(spark, sf):
    return places(spark, sf).select("id", N.way_command(F.col("map_id"), F.col("x"), F.col("y"), F.concat(F.lit("Point "), F.col("id").cast("string"))).alias("line"))


@query("s18_macros", f"WITH w AS ({_WAYS}) SELECT id % 25 AS map_id, string_agg(line, chr(10) ORDER BY id) AS macro FROM w GROUP BY 1")
def macros(spark, sf):
    points = places(spark, sf).withColumn("pos", F.col("id")).withColumn("label", F.concat(F.lit("Point "), F.col("id").cast("string"))).withColumn("key", F.col("map_id"))
    return N.macro(points, "key").select(F.col("key").alias("map_id"), "macro")


@query("s18_macro_pages", f"WITH w AS ({_WAYS}) SELECT id % 25 AS map_id, id // 5000 AS page, string_agg(line, chr(10) ORDER BY id) AS macro FROM w GROUP BY ALL")
def macro_pages(spark, sf):
    """Macros of 200 lines at most, however many places a map has."""
    page = F.floor(F.col("id") / 5000)
    points = places(spark, sf).withColumn("pos", F.col("id")).withColumn("label", F.concat(F.lit("Point "), F.col("id").cast("string"))).withColumn("key", F.struct("map_id", page.alias("page")))
    return N.macro(points, "key").select("key.map_id", "key.page", "macro")


_LINES = [(1, "/way #12 30.5 40.25 Old mill"), (2, "/way #3 100 0"), (3, "/way #3 100.5 0 too far"), (4, "way #3 1 2"), (5, None), (6, ""), (7, "  /way #7 1.5,2.5 x | y  ")]


@query("s19_parsed_ways", "SELECT * FROM (VALUES (1, 12, 0.305::DOUBLE, 0.4025::DOUBLE, 'Old mill'), (2, 3, 1.0, 0.0, ''), (3, NULL, NULL, NULL, NULL), (4, NULL, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL), (6, NULL, NULL, NULL, NULL), (7, 7, 0.015, 0.025, 'x | y')) v(id, map_id, x, y, label)")
def s19(spark, sf):
    return spark.createDataFrame(_LINES, "id int, line string").select("id", *[c.alias(k) for k, c in N.parsed_way(F.col("line")).items()])


@query("r25_unknown_zones", f"WITH p AS ({_PLACE}) SELECT id FROM p WHERE map_id + 1 NOT IN (SELECT n_nationkey FROM nation)")
def r25(spark, sf):
    zones = table(spark, sf, "nation").select(F.col("n_nationkey").alias("map_id"))
    return places(spark, sf).withColumn("map_id", F.col("map_id") + 1).join(zones, "map_id", "left_anti").select("id")


def plan_points(spark, sf):
    """What each character's open quests want visited: char_id, map_id, ord, point_id, x, y."""
    q = quests(spark, sf).select("quest_id", "map_id", ((F.col("quest_id") * 37 % 101) / 100).alias("x"), ((F.col("quest_id") * 61 % 101) / 100).alias("y"))
    return in_progress(spark, sf).join(q, "quest_id").select("char_id", "map_id", F.col("quest_id").alias("ord"), F.col("quest_id").alias("point_id"), "x", "y")


@query("n10_tours")
def n10(spark, sf):
    return N.tours(plan_points(spark, sf), ["char_id", "map_id"])


@query("n12_zone_order")
def n12(spark, sf):
    who = characters(spark, sf).select("char_id", "faction", (F.col("level") >= 40).alias("grown"), F.col("map_id").alias("origin"))
    zones = plan_points(spark, sf).select("char_id", "map_id").distinct().join(who, "char_id")
    return N.zone_order(zones, travel_costs(spark, sf))


@query("n13_route_plan")
def n13(spark, sf):
    """Per character the zones in order with their stops, the way within the zone and the travel to it."""
    inside = n10(spark, sf).groupBy("char_id", "map_id").agg(F.count("*").alias("stops"), F.sum("distance").alias("d"))
    legs = n12(spark, sf).join(inside, ["char_id", "map_id"])
    within = N.zone_seconds(F.col("d"), F.col("map_id") % 2 == 0)
    return legs.select("char_id", "pos", "map_id", "stops", F.round("seconds", 3).alias("travel_seconds"), F.round(within, 3).alias("zone_seconds"), (F.col("seconds") >= 600).alias("estimated"))


@query("n13_plan_sizes", f"WITH {QUESTS_SQL}, {IN_PROGRESS_SQL} SELECT char_id, count(*) AS stops, count(DISTINCT map_id) AS zones FROM in_progress JOIN quests USING (quest_id) GROUP BY char_id")
def plan_sizes(spark, sf):
    return n13(spark, sf).groupBy("char_id").agg(F.sum("stops").alias("stops"), F.count("*").alias("zones"))


@query("w12_waypoint_numbers", f"WITH {QUESTS_SQL}, {IN_PROGRESS_SQL} SELECT char_id, quest_id, row_number() OVER (PARTITION BY char_id ORDER BY map_id, quest_id) AS number FROM in_progress JOIN quests USING (quest_id)")
def w12(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("char_id").orderBy("map_id", "ord")
    return plan_points(spark, sf).select("char_id", F.col("point_id").alias("quest_id"), F.row_number().over(w).cast("long").alias("number"))


@query("t11_methods_by_convenience", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {c})" for m, c in N.CONVENIENCE.items()) + ") v(method, convenience)")
def t11(spark, sf):
    m = spark.createDataFrame([(m,) for m in N.CONVENIENCE], "method string")
    return m.select("method", N.convenience(F.col("method")).alias("convenience")).orderBy("convenience", "method")
