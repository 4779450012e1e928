"""Queries over whole route plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import graph, routing
from millrace.operators import route_plans as P
from millrace.operators.checkpoints import settled
from millrace.plans.catalog import query
from millrace.plans.graph import POINTS_SQL, placed_quests
from millrace.plans.routing import travel_costs
from millrace.sources.tables import COMPLETED_SQL, IN_PROGRESS_SQL, QUESTS_SQL, characters, completed, in_progress, quests, table

_PLANNED_SQL = f"""{QUESTS_SQL}, {COMPLETED_SQL}, {IN_PROGRESS_SQL},
met AS (SELECT char_id, quest_id AS pre FROM completed UNION SELECT char_id, quest_id FROM in_progress),
left_out AS (SELECT DISTINCT char_id, quest_id FROM in_progress p JOIN quest_edges e USING (quest_id) WHERE NOT EXISTS (FROM met WHERE met.char_id = p.char_id AND met.pre = e.pre)),
planned AS (SELECT char_id, quest_id FROM in_progress JOIN quests USING (quest_id) WHERE (char_id, quest_id) NOT IN (FROM left_out))"""


def _quests(spark, sf: str) -> DataFrame:
    return quests(spark, sf).withColumn("seconds", (F.col("quest_type") * 10 + 120).cast("double"))


def _travellers(spark, sf: str) -> DataFrame:
    return characters(spark, sf).select("char_id", "faction", (F.col("level") >= 40).alias("grown"), F.col("map_id").alias("origin"))


@query("n13_whole_plan")
def whole_plan(spark, sf):
    """The plan of every character's open quests: legs with their quests and points, what is left out, and totals."""
    zones = table(spark, sf, "nation").select(F.col("n_nationkey").alias("map_id"), (F.col("n_nationkey") % 2 == 0).alias("flyable"))
    return P.route_plans(in_progress(spark, sf), completed(spark, sf), _quests(spark, sf), graph.waypoints(placed_quests(spark, sf)), _travellers(spark, sf), travel_costs(spark, sf), zones)


@query("n13_plan_contents", f"""WITH {_PLANNED_SQL}, {POINTS_SQL}, stops AS (SELECT quest_id, count(*) AS n FROM points GROUP BY quest_id),
p AS (SELECT char_id, count(*) AS n_quests, sum(n)::BIGINT AS n_points, sum(quest_type * 10 + 120)::DOUBLE AS quest_seconds, count(DISTINCT map_id) AS n_zones FROM planned JOIN quests USING (quest_id) JOIN stops USING (quest_id) GROUP BY char_id),
s AS (SELECT char_id, count(*) AS n_skipped FROM left_out GROUP BY char_id)
SELECT char_id, coalesce(n_quests, 0) AS n_quests, coalesce(n_points, 0) AS n_points, coalesce(n_zones, 0) AS n_zones, coalesce(quest_seconds, 0) AS quest_seconds, coalesce(n_skipped, 0) AS n_skipped FROM p FULL JOIN s USING (char_id)""")
def plan_contents(spark, sf):
    """What each plan holds, counted over its legs."""
    total = lambda of, start: F.aggregate("legs", F.lit(start), lambda a, x: a + of(x))
    many = lambda c: F.size(c).cast("long")
    return whole_plan(spark, sf).select(
        "char_id", many(F.array_distinct(F.flatten("legs.quests"))).alias("n_quests"), many(F.flatten("legs.points")).alias("n_points"), many(F.array_distinct("legs.map_id")).alias("n_zones"),
        total(lambda x: x["quest_seconds"], 0.0).alias("quest_seconds"), many("skipped").alias("n_skipped"),
    )


@query("n13_kept_prerequisites", f"WITH {_PLANNED_SQL} SELECT p.char_id, p.quest_id, count(q.quest_id) AS before FROM planned p LEFT JOIN quest_edges e ON e.quest_id = p.quest_id LEFT JOIN planned q ON q.char_id = p.char_id AND q.quest_id = e.pre GROUP BY ALL")
def kept_prerequisites(spark, sf):
    """How many of a planned quest's prerequisites come before it in its plan: all that are in the plan."""
    fit = in_progress(spark, sf).join(routing.skipped(in_progress(spark, sf), completed(spark, sf), quests(spark, sf)), ["char_id", "quest_id"], "left_anti")
    steps = settled(P.ordered_legs(fit, quests(spark, sf), _travellers(spark, sf), travel_costs(spark, sf)))
    need = steps.join(quests(spark, sf).select("quest_id", F.explode_outer("prerequisites").alias("pre")), "quest_id")
    earlier = steps.select("char_id", F.col("quest_id").alias("pre"), F.col("step").alias("pre_step"))
    return need.join(earlier, ["char_id", "pre"], "left").groupBy("char_id", "quest_id").agg(F.count_if(F.col("pre_step") < F.col("step")).alias("before"))
