"""Reading tables, and the domain relations that the queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (key, tier, licence, authority, min_interval): what may be stored of a source, and how it is cited.
POLICIES = [
    ("first_party", "full_text", "terms of the publisher", True, 0.0),
    ("wiki", "full_text", "CC BY-SA 4.0", False, 0.5),
    ("profiles", "structured", "API terms", True, 0.31),
    ("guides", "metadata", "all rights reserved", False, 2.0),
    ("news", "metadata", "all rights reserved", False, 2.0),
    ("forum", "quotation", "CC BY-NC-SA 3.0", False, 3.0),
    ("scraped", "disabled", "none", False, 3.0),
]


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "source string, tier string, licence string, authority boolean, min_interval double")


def policies_sql() -> str:
    rows = ", ".join(f"('{k}', '{t}', '{lic}', {str(a).lower()}, {i})" for k, t, lic, a, i in POLICIES)
    return f"policies(source, tier, licence, authority, min_interval) AS (VALUES {rows})"


_KEYS = ", ".join(f"'{p[0]}'" for p in POLICIES)


def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as knowledge documents: source, source_id, entity_type, title, body, version, language."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.element_at(F.expr(f"array({_KEYS})"), F.col("source").substr(4, 9).cast("int") % 7 + 1).alias("source"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.concat(F.lit("type"), (F.col("doc_id") % 17).cast("string")).alias("entity_type"),
        F.array_join(F.slice(F.split("text", " ", 7), 1, 6), " ").alias("title"),
        F.col("text").alias("body"),
        F.when(F.col("doc_id") % 5 == 0, "classic").otherwise("retail").alias("game_version"),
        "lang",
        "n_chars",
    )


KNOWLEDGE_SQL = f"""knowledge AS (
  SELECT doc_id, ([{_KEYS}])[(CAST(substr(source, 4) AS INTEGER) % 7) + 1] AS source, CAST(doc_id AS VARCHAR) AS source_id,
    'type' || (doc_id % 17) AS entity_type, array_to_string((string_split(text, ' '))[1:6], ' ') AS title, text AS body,
    CASE WHEN doc_id % 5 = 0 THEN 'classic' ELSE 'retail' END AS game_version, lang, n_chars
  FROM documents)"""


def sectioned_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body) with headings and blank lines: every seventh line becomes a heading, other breaks are doubled."""
    lines = F.split("text", "\n")
    made = F.transform(lines, lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("\n## "), F.substring(x, 1, 40), F.lit("\n"))).otherwise(F.concat(x, F.lit("\n"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(made, "\n").alias("body"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as questions: query_id and question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


QUESTIONS_SQL = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"


# ---------------------------------------------------------------- quests, characters, zones


def quests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a prerequisite graph: quest k needs k div 2 and k div 3, so the graph has no cycle."""
    k = F.col("p_partkey") + 1
    faction = F.when(F.col("p_partkey") % 10 == 0, "alliance").when(F.col("p_partkey") % 10 == 1, "horde")
    return table(spark, sf_dir, "part").select(
        k.alias("quest_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("campaign"), F.col("p_size").alias("required_level"),
        (F.col("p_partkey") % 9).cast("int").alias("quest_type"), faction.alias("faction"), (F.col("p_partkey") % 25).cast("int").alias("map_id"),
        F.array_distinct(F.filter(F.array(F.floor(k / 2), F.floor(k / 3)), lambda x: x > 0)).alias("prerequisites"),
    )


QUESTS_SQL = """quests AS (
  SELECT p_partkey + 1 AS quest_id, p_name AS title, p_brand AS campaign, p_size AS required_level, CAST(p_partkey % 9 AS INTEGER) AS quest_type,
    CASE WHEN p_partkey % 10 = 0 THEN 'alliance' WHEN p_partkey % 10 = 1 THEN 'horde' END AS faction, CAST(p_partkey % 25 AS INTEGER) AS map_id
  FROM part),
quest_edges AS (
  SELECT DISTINCT pre, quest_id FROM (SELECT quest_id // 2 AS pre, quest_id FROM quests UNION ALL SELECT quest_id // 3, quest_id FROM quests) WHERE pre > 0)"""


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("char_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 80 + 1).cast("int").alias("level"),
        F.when(F.col("c_nationkey") % 2 == 0, "alliance").otherwise("horde").alias("faction"), F.col("c_nationkey").alias("map_id"), F.col("c_mktsegment").alias("class"),
    )


CHARACTERS_SQL = """characters AS (
  SELECT c_custkey AS char_id, c_name AS name, CAST(c_custkey % 80 + 1 AS INTEGER) AS level,
    CASE WHEN c_nationkey % 2 = 0 THEN 'alliance' ELSE 'horde' END AS faction, c_nationkey AS map_id, c_mktsegment AS class FROM customer)"""


def _bought(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders").where(which), table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("char_id"), (F.col("l_partkey") + 1).alias("quest_id")).distinct()


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(char_id, quest_id): the parts of each customer's closed orders."""
    return _bought(spark, sf_dir, "o_orderstatus <> 'O'")


def in_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(char_id, quest_id): the parts of each customer's open orders."""
    return _bought(spark, sf_dir, "o_orderstatus = 'O'")


COMPLETED_SQL = "completed AS (SELECT DISTINCT o_custkey AS char_id, l_partkey + 1 AS quest_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O')"
IN_PROGRESS_SQL = "in_progress AS (SELECT DISTINCT o_custkey AS char_id, l_partkey + 1 AS quest_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O')"


def any_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, grp, quest_id): the side quests of each campaign in two groups, of which one quest will do."""
    return quests(spark, sf_dir).where("quest_type = 5").select(F.col("campaign").alias("chain"), (F.col("quest_id") % 2).alias("grp"), "quest_id")


ANY_OF_SQL = "any_of AS (SELECT campaign AS chain, quest_id % 2 AS grp, quest_id FROM quests WHERE quest_type = 5)"
