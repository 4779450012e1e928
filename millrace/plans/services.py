"""Queries over written searches, synchronisation, answers in a cache, and plans with their omissions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import advice, chunking, fulltext, graph, sync
from millrace.operators import retrieval as R
from millrace.operators import routing as N
from millrace.plans import retrieval as Q
from millrace.plans import routing as P
from millrace.plans.catalog import query
from millrace.sources import connectors, schemas
from millrace.sources.tables import CHARACTERS_SQL, COMPLETED_SQL, IN_PROGRESS_SQL, KNOWLEDGE_SQL, QUESTIONS_SQL, QUESTS_SQL, characters, completed, in_progress, knowledge_documents, policies_sql, questions, quests, table

# ---------------------------------------------------------------- written searches

_SEARCHES = [(1, 'the of -and'), (2, '"of the" or "license version"'), (3, '-the'), (4, 'apache "license, version"'), (5, '!! "" -'), (6, 'der -"in der" or les')]
_SEARCH_SQL = f"""{KNOWLEDGE_SQL}, pad AS (
  SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9'']+'), ' ') || ' ' AS t, ' ' || array_to_string(regexp_extract_all(lower(coalesce(body, '')), '[a-z0-9'']+'), ' ') || ' ' AS b FROM knowledge),
alt(query_id, must, must_not) AS (VALUES (1, ['of', 'the'], ['and']), (2, ['of the'], []::VARCHAR[]), (2, ['license version'], []::VARCHAR[]), (3, []::VARCHAR[], ['the']), (4, ['apache', 'license version'], []::VARCHAR[]), (6, ['der'], ['in der']), (6, ['les'], []::VARCHAR[])),
hit AS (SELECT query_id, doc_id, must,
    list_transform(must, lambda p: CASE WHEN contains(t, ' ' || p || ' ') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(b, ' ' || p || ' ') THEN 0.4::DOUBLE ELSE 0 END) AS parts
  FROM pad, alt WHERE len(list_filter(must_not, lambda p: contains(t, ' ' || p || ' ') OR contains(b, ' ' || p || ' '))) = 0)
SELECT query_id, doc_id, round(max(coalesce(list_sum(parts) / nullif(len(parts), 0), 0.0::DOUBLE)), 6) AS score FROM hit WHERE len(list_filter(parts, lambda x: x = 0)) = 0 GROUP BY query_id, doc_id"""


@query("k17_written_search", f"WITH {_SEARCH_SQL}")
def written(spark, sf):
    return fulltext.search(spark.createDataFrame(_SEARCHES, "query_id int, query string"), knowledge_documents(spark, sf))


@query("k17_question_words", f"""WITH {QUESTIONS_SQL}, {KNOWLEDGE_SQL},
q AS (SELECT query_id, list_sort(list_distinct(regexp_extract_all(lower(question), '[a-z0-9'']+')[1:3])) AS must FROM questions),
pad AS (SELECT doc_id, regexp_extract_all(lower(body), '[a-z0-9'']+') AS t FROM knowledge)
SELECT query_id, count(*) AS documents FROM q JOIN pad ON list_has_all(t, must) GROUP BY query_id""")
def question_words(spark, sf):
    """How many documents have the first three words of each question."""
    first = questions_as_queries(spark, sf)
    return fulltext.search(first, knowledge_documents(spark, sf).select("doc_id", F.lit("").alias("title"), "body")).groupBy("query_id").agg(F.count("*").alias("documents"))


def questions_as_queries(spark, sf):
    """The first three words of each question, quoted: an ``or`` among them is a word and parts nothing."""
    return questions(spark, sf).select("query_id", F.array_join(F.transform(F.slice(T.tokens(F.col("question")), 1, 3), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ").alias("query"))


@query("w02_ranks_before_and_after", f"WITH {Q.HYBRID_SQL} SELECT query_id, doc_id, d.rank AS dense_rank, x.rank AS lexical_rank, h.rank AS final_rank FROM hits h LEFT JOIN dense_top d USING (query_id, doc_id) LEFT JOIN lex_top x USING (query_id, doc_id)")
def ranks(spark, sf):
    asked, docs = questions(spark, sf), knowledge_documents(spark, sf)
    depth = 32
    dense, lexical = R.first_hits(asked, docs, depth)
    place = lambda df, name: df.select("query_id", "doc_id", F.col("rank").cast("long").alias(name))
    final = R.fuse(dense, lexical, 8)
    return place(final, "final_rank").join(place(dense, "dense_rank"), ["query_id", "doc_id"], "left").join(place(lexical, "lexical_rank"), ["query_id", "doc_id"], "left")


@query("s11_refused_sources", f"WITH {policies_sql()} SELECT source, tier = 'disabled' AS refused FROM policies WHERE source IN ({', '.join(repr(s) for s in sorted(connectors.CONNECTORS))})")
def refused(spark, sf):
    """Every connector is read; a disabled one is refused before anything of it is read."""
    said = []
    for source in sorted(connectors.CONNECTORS):
        try:
            connectors.read(spark, source, sf)
            said.append((source, False))
        except PermissionError:
            said.append((source, True))
    return spark.createDataFrame(said, "source string, refused boolean")


# ---------------------------------------------------------------- synchronisation

_FETCHED = "fetched AS (SELECT user_id AS char_id, event_type AS scope, count(*) AS n, count(*) FILTER (value > 60) AS bad FROM events GROUP BY ALL), outcome AS (SELECT char_id, scope, NOT (scope = 'error' AND bad > 0) AND n > 15 AS ok FROM fetched)"
_REPORTS = f"{_FETCHED}, report AS (SELECT char_id, coalesce(string_agg(scope, ',' ORDER BY scope) FILTER (ok), '') AS synced, coalesce(string_agg(scope, ',' ORDER BY scope) FILTER (NOT ok), '') AS failed, CASE WHEN bool_and(ok) THEN 'success' WHEN NOT bool_or(ok) THEN 'failed' ELSE 'partial' END AS status FROM outcome GROUP BY char_id)"


def outcomes(spark, sf):
    """Each user's events of a type as a fetched scope: an error if errors cost too much, nothing if there are few."""
    per = table(spark, sf, "events").groupBy(F.col("user_id").alias("char_id"), F.col("event_type").alias("scope")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 60).alias("bad"))
    fetched = per.select("char_id", "scope", F.when(F.col("n") > 15, F.col("n").cast("string")).alias("payload"), F.when((F.col("scope") == "error") & (F.col("bad") > 0), "upstream error").alias("error"))
    return sync.scope_outcomes(fetched)


@query("m13_scopes_that_fail_apart", f"WITH {_REPORTS} SELECT * FROM report")
def scope_reports(spark, sf):
    got = sync.character_reports(outcomes(spark, sf))
    return got.select("char_id", F.array_join("synced", ",").alias("synced"), F.array_join("failed", ",").alias("failed"), "status")


_PLANNED = """running AS (SELECT DISTINCT o_custkey % 40 AS account_id FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 40 < 10),
roster AS (SELECT c_custkey % 40 AS account_id, c_custkey AS char_id FROM customer WHERE c_custkey % 40 % 3 = c_nationkey % 3),
planned AS (SELECT account_id, (row_number() OVER (PARTITION BY account_id ORDER BY char_id) - 1) // 5 AS batch, char_id FROM roster WHERE account_id NOT IN (SELECT account_id FROM running))"""


def planned(spark, sf):
    account = F.col("c_custkey") % 40
    roster = table(spark, sf, "customer").select(account.alias("account_id"), (account % 3).alias("region"), F.col("c_custkey").alias("char_id"), (F.col("c_nationkey") % 3).alias("char_region"))
    running = table(spark, sf, "orders").where("o_orderstatus = 'P' and o_custkey % 40 < 10").select((F.col("o_custkey") % 40).alias("account_id"))
    return sync.planned_batches(roster, running, 5)


@query("m14_planned_batches", f"WITH {_PLANNED} SELECT account_id, batch, count(*) AS size, min(char_id) AS first_id FROM planned GROUP BY ALL")
def batches(spark, sf):
    return planned(spark, sf).select("account_id", "batch", F.size("char_ids").cast("long").alias("size"), F.get("char_ids", F.lit(0)).alias("first_id"))


@query("m14_account_jobs", f"""WITH {_PLANNED}, {_REPORTS}, each AS (SELECT p.*, coalesce(status <> 'failed', false) AS good FROM planned p LEFT JOIN report USING (char_id))
SELECT account_id, count(DISTINCT batch) AS batches, count(*) FILTER (good) AS synced, count(*) FILTER (NOT good) AS failed,
  CASE WHEN count(*) FILTER (NOT good) = 0 THEN 'success' WHEN count(*) FILTER (good) > 0 THEN 'partial' ELSE 'failed' END AS status FROM each GROUP BY account_id""")
def jobs(spark, sf):
    return sync.account_jobs(planned(spark, sf), sync.character_reports(outcomes(spark, sf)))


@query("m16_account_collections", """WITH m AS (SELECT o_custkey AS account_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
p AS (SELECT o_custkey AS account_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS account_id, coalesce(m.n, 0) AS mounts, coalesce(p.n, 0) AS pets FROM customer LEFT JOIN m ON m.account_id = c_custkey LEFT JOIN p ON p.account_id = c_custkey""")
def collections(spark, sf):
    def payload(status: str, name: str):
        own = table(spark, sf, "orders").where(F.col("o_orderstatus") == status)
        ids = F.to_json(F.struct(F.collect_list(F.struct(F.col("o_orderkey").alias("id"))).alias(name)))
        return own.groupBy(F.col("o_custkey").alias("account_id")).agg(ids.alias("payload"))

    got = sync.account_collections(table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id")), payload("F", "mounts"), payload("P", "pets"))
    return got.select("account_id", F.size("mounts").cast("long").alias("mounts"), F.size("pets").cast("long").alias("pets"))


@query("s14_cached_answers", """WITH a AS (SELECT user_id AS key, max(ts) AS ts, max_by(event_type <> 'error', ts) AS found FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id),
r AS (SELECT event_id, user_id AS key, ts, event_type = 'signup' AS user_scoped FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT event_id, coalesce(epoch(r.ts) - epoch(a.ts) < CASE WHEN found THEN 86400 ELSE 28800 END AND NOT user_scoped, false) AS hit FROM r LEFT JOIN a USING (key)""")
def cached(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("ts"), "event_type")
    cut = F.lit("2024-01-20").cast("timestamp").cast("double")
    answers = events.where(F.col("ts") < cut).select("key", "ts", (F.col("event_type") != "error").alias("found"))
    asked = events.where(F.col("ts") >= cut).select("event_id", "key", "ts", (F.col("event_type") == "signup").alias("user_scoped"))
    return sync.cached_answers(asked, answers, 86400, 28800).select("event_id", "hit")


# ---------------------------------------------------------------- plans

_OWN_SQL = "own AS (SELECT char_id, (char_id % 25)::INTEGER AS target, 30.0::DOUBLE AS s FROM characters UNION ALL SELECT char_id, 7, 25.0::DOUBLE FROM characters WHERE class = 'MACHINERY')"


@query("n04_routes_with_own_edges", f"""WITH RECURSIVE {CHARACTERS_SQL}, {P.TRAVEL_SQL}, {_OWN_SQL},
first AS (SELECT char_id, faction, level >= 40 AS grown, map_id AS origin, 0.0::DOUBLE AS s FROM characters UNION ALL SELECT c.char_id, faction, level >= 40, o.target, o.s FROM characters c JOIN own o ON o.char_id = c.char_id AND o.target <> c.map_id)
SELECT char_id, node AS map_id, min(s + seconds) AS seconds FROM first f JOIN costs c ON c.faction = f.faction AND c.grown = f.grown AND c.origin = f.origin GROUP BY char_id, node""")
def own_edges(spark, sf):
    return N.with_own_edges(P.travel_costs(spark, sf), characters(spark, sf), P.n04(spark, sf))


@query("n13_skipped_quests", f"""WITH {QUESTS_SQL}, {COMPLETED_SQL}, {IN_PROGRESS_SQL},
met AS (SELECT char_id, quest_id AS pre FROM completed UNION SELECT char_id, quest_id FROM in_progress)
SELECT char_id, quest_id, 'requires ' || string_agg(e.pre::VARCHAR, ', ' ORDER BY e.pre) AS reason FROM in_progress p JOIN quest_edges e USING (quest_id) LEFT JOIN met m USING (char_id, pre)
WHERE m.pre IS NULL GROUP BY char_id, quest_id""")
def skipped(spark, sf):
    return N.skipped(in_progress(spark, sf), completed(spark, sf), quests(spark, sf))


@query("n13_quest_order")
def quest_order(spark, sf):
    """(char_id, step, leg, map_id, quest_id): the quests that can be planned, zone by zone in the order of the way,
    within a zone so that prerequisites come first; a zone is one leg, however its quests are spread in that order."""
    fit = in_progress(spark, sf).join(N.skipped(in_progress(spark, sf), completed(spark, sf), quests(spark, sf)), ["char_id", "quest_id"], "left_anti")
    order = graph.ordered_subsets(fit, quests(spark, sf)).withColumnRenamed("pos", "nth").join(quests(spark, sf).select("quest_id", "map_id"), "quest_id")
    who = characters(spark, sf).select("char_id", "faction", (F.col("level") >= 40).alias("grown"), F.col("map_id").alias("origin"))
    legs = N.zone_order(order.select("char_id", "map_id").distinct().join(who, "char_id"), P.travel_costs(spark, sf)).select("char_id", F.col("pos").alias("leg"), "map_id")
    step = F.row_number().over(Window.partitionBy("char_id").orderBy("leg", "nth")).cast("long")
    return order.join(legs, ["char_id", "map_id"]).select("char_id", step.alias("step"), "leg", "map_id", "quest_id")


@query("t10_routes_by_seconds", f"WITH RECURSIVE {CHARACTERS_SQL}, {P.TRAVEL_SQL} SELECT faction, grown, origin, node, seconds, rank FROM (SELECT *, row_number() OVER (PARTITION BY faction, grown, origin ORDER BY seconds, node) AS rank FROM costs WHERE origin <> node) WHERE rank <= 3")
def by_seconds(spark, sf):
    w = Window.partitionBy("faction", "grown", "origin").orderBy("seconds", "node")
    return P.travel_costs(spark, sf).where("origin <> node").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("faction", "grown", "origin", "node", "seconds", "rank")


@query("e06_route_signatures", f"""WITH {P.EDGES_SQL}, two AS (SELECT a.source AS origin, b.target AS destination, a.method || ' > ' || b.method AS signature, a.cost_seconds + b.cost_seconds AS seconds FROM edges a JOIN edges b ON b.source = a.target WHERE a.source <> b.target)
SELECT origin, destination, signature, min(seconds) AS seconds, count(*) AS routes FROM two GROUP BY ALL""")
def signatures(spark, sf):
    """Ways over two edges; those of equal methods are one, the cheapest."""
    a, b = P.travel_edges(spark, sf), P.travel_edges(spark, sf).select(F.col("source").alias("target"), F.col("target").alias("destination"), F.col("method").alias("then"), F.col("cost_seconds").alias("more"))
    two = a.join(b, "target").where("source <> destination")
    return two.groupBy(F.col("source").alias("origin"), "destination", F.concat_ws(" > ", "method", "then").alias("signature")).agg(F.min(F.col("cost_seconds") + F.col("more")).alias("seconds"), F.count("*").alias("routes"))


# ---------------------------------------------------------------- pieces of chunks


@query("k09_hard_splits", "SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS letters, true AS fits FROM documents")
def hard_splits(spark, sf):
    """No letter is lost when texts are cut to 400 characters, and no piece is longer."""
    pieces = chunking.split_texts(table(spark, sf, "documents"), "doc_id", "text", 400)
    return pieces.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("piece", r"(?U)\s+", ""))).alias("letters"), (F.max(F.length("piece")) <= 400).alias("fits"))


# ---------------------------------------------------------------- extension points


@query("u06_advisors_that_fail", "SELECT 'nearby' AS advisor, n_nationkey AS objective, n_regionkey * 1.0::DOUBLE AS priority FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'suppliers', s_suppkey, 2.0::DOUBLE FROM supplier WHERE s_suppkey % 10 = 0")
def advisors(spark, sf):
    """Four advisors, of which one cannot be planned and one fails on its data; the rows of the others are all there."""
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    found, failed = advice.gathered(
        {
            "nearby": lambda: nation.where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("objective"), F.col("n_regionkey").cast("double").alias("priority")),
            "unplanned": lambda: nation.select("no_such_column"),
            "broken": lambda: nation.select(F.raise_error(F.lit("no data")).cast("long").alias("objective"), F.lit(1.0).alias("priority")),
            "suppliers": lambda: supplier.where("s_suppkey % 10 = 0").select(F.col("s_suppkey").cast("long").alias("objective"), F.lit(2.0).alias("priority")),
        }
    )
    if sorted(failed) != ["broken", "unplanned"]:
        raise AssertionError(f"failed: {failed}")
    return found.select("advisor", "objective", "priority")


@query("u03_answers_without_a_model", "SELECT item_id, NULL::VARCHAR AS answer FROM benchmark")
def unanswered(spark, sf):
    return connectors.answered(table(spark, sf, "benchmark"), "item_id", "text")


@query("u03_answers", "SELECT item_id, CASE WHEN trim(text) <> '' THEN 'words: ' || length(text) END AS answer FROM benchmark")
def answers(spark, sf):
    return connectors.answered(table(spark, sf, "benchmark"), "item_id", "text", lambda prompts: [f"words: {len(p)}" for p in prompts])


@query("u08_log_lines", """SELECT event_id, '{"request":"' || substr(md5(event_id::VARCHAR), 1, 12) || '","user":' || user_id || ',"type":"' || event_type || '","level":"' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END || '"}' AS line FROM events""")
def log_lines(spark, sf):
    """Events as structured lines, each with a request id of its own."""
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    line = F.struct(F.substring(F.md5(F.col("event_id").cast("string")), 1, 12).alias("request"), F.col("user_id").alias("user"), F.col("event_type").alias("type"), level.alias("level"))
    return table(spark, sf, "events").select("event_id", F.to_json(line).alias("line"))


@query("s21_migrated", "SELECT c_custkey, c_name AS name, c_nationkey, 'new' AS state FROM customer")
def migrated(spark, sf):
    """Three steps up, one down."""
    steps = [schemas.renamed(1, "c_name", "name"), schemas.added(2, "state", "string", "'new'"), schemas.added(3, "score", "double")]
    base = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return schemas.migrated(schemas.migrated(base, steps, 0, 3), steps, 3, 2)
