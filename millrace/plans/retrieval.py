"""Queries of the retrieval engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval as R
from millrace.operators.broadcasts import small
from millrace.operators.checkpoints import settled
from millrace.plans.catalog import query
from millrace.sources.tables import KNOWLEDGE_SQL, QUESTIONS_SQL, knowledge_documents, policies, policies_sql, questions, sectioned_bodies, table

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9'']+')"
_GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"


def _hashed(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_tf AS (
  SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({_GRAMS}) AS term FROM (SELECT {key}, {TOKENS.format(text)} AS t FROM {source})) GROUP BY ALL),
{name}_raw AS (
  SELECT {key}, ('0x' || substr(md5(term), 1, 15))::BIGINT % 512 AS bucket,
    sum(CASE WHEN substr(md5(term), 16, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(tf))) AS w FROM {name}_tf GROUP BY ALL),
{name} AS (SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}_raw)"""


LEXICAL_SQL = f"""{QUESTIONS_SQL}, {KNOWLEDGE_SQL},
q_term AS (SELECT query_id, unnest(list_distinct({TOKENS.format('question')})) AS term FROM questions),
d_term AS (SELECT doc_id, unnest(list_distinct({TOKENS.format('body')})) AS term FROM knowledge),
q_size AS (SELECT query_id, count(*) AS n FROM q_term GROUP BY query_id),
lexical AS (
  SELECT query_id, doc_id, round(count(*) / n::DOUBLE, 6) AS lexical_score FROM q_term JOIN d_term USING (term) JOIN q_size USING (query_id) GROUP BY query_id, doc_id, n)"""
DENSE_SQL = f"""{_hashed('q_hash', 'questions', 'query_id', 'question')}, {_hashed('d_hash', 'knowledge', 'doc_id', 'body')},
dense AS (SELECT query_id, doc_id, greatest(0.0::DOUBLE, round(sum(q.w * d.w), 6)) AS vector_score FROM q_hash q JOIN d_hash d USING (bucket) GROUP BY query_id, doc_id)"""


def _top(name: str, source: str, score: str, depth: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, doc_id) AS rank FROM {source}) WHERE rank <= {depth})"


HYBRID_SQL = f"""{LEXICAL_SQL}, {DENSE_SQL}, {_top('lex_top', 'lexical', 'lexical_score', 32)}, {_top('dense_top', 'dense', 'vector_score', 32)},
fused AS (
  SELECT query_id, doc_id, coalesce(vector_score, 0.0::DOUBLE) AS vector_score, coalesce(lexical_score, 0.0::DOUBLE) AS lexical_score,
    round(coalesce(1 / (60 + d.rank)::DOUBLE, 0) + coalesce(1 / (60 + x.rank)::DOUBLE, 0), 9) AS score
  FROM dense_top d FULL OUTER JOIN lex_top x USING (query_id, doc_id)),
{_top('hits', 'fused', 'score', 8)}"""


def hits(spark, sf):
    return R.hybrid_search(questions(spark, sf), knowledge_documents(spark, sf), limit=8)


def found(spark, sf):
    """The hits, found once, to be joined with the documents; while they are few they go to the texts, which stay where they are."""
    return small(settled(hits(spark, sf)))


@query("k20_hybrid_search", f"WITH {HYBRID_SQL} SELECT query_id, doc_id, vector_score, lexical_score, score, rank FROM hits")
def hybrid(spark, sf):
    return hits(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@query("k18_overlap_score", f"WITH {LEXICAL_SQL} SELECT query_id, doc_id, lexical_score FROM lexical")
def overlap(spark, sf):
    return R.lexical_hits(questions(spark, sf), knowledge_documents(spark, sf)).withColumn("lexical_score", F.round("lexical_score", 6))


@query("k14_hashing_embedder", f"WITH {KNOWLEDGE_SQL}, {_hashed('d_hash', 'knowledge', 'doc_id', 'body')} SELECT doc_id, bucket, round(w, 6) + 0 AS w FROM d_hash")
def embedder(spark, sf):
    return R.hashed_embedding(knowledge_documents(spark, sf), "doc_id", "body").select("doc_id", F.col("bucket").cast("long").alias("bucket"), (F.round("w", 6) + 0).alias("w"))


@query("k19_dense_scores", f"WITH {QUESTIONS_SQL}, {KNOWLEDGE_SQL}, {DENSE_SQL} SELECT query_id, doc_id, vector_score FROM dense")
def dense(spark, sf):
    return R.dense_hits(questions(spark, sf), knowledge_documents(spark, sf))


NEAREST_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, greatest(0.0::DOUBLE, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6)) AS similarity FROM q CROSS JOIN embeddings)
SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


@query("j18_knn_cosine", NEAREST_SQL)
def knn(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return R.nearest(vectors.where("vec_id % 50 = 0"), vectors, 20).withColumn("rank", F.col("rank").cast("long"))


_AUTH = ", ".join(f"'{s}'" for s in ("first_party", "profiles"))
CONFIDENCE_SQL = f"""{HYBRID_SQL}, sourced AS (
  SELECT h.*, k.source, k.source IN ({_AUTH}) AS authority, greatest(vector_score, lexical_score) AS absolute FROM hits h JOIN knowledge k USING (doc_id)),
agg AS (
  SELECT query_id, max(absolute) AS strength, count(DISTINCT source) FILTER (absolute >= 0.35) AS n_sources,
    coalesce(bool_or(authority) FILTER (absolute >= 0.35), false) AS authoritative, count(*) FILTER (rank <= 5) AS n_first,
    stddev_pop(absolute) FILTER (rank <= 5) AS spread FROM sourced GROUP BY query_id),
conf AS (
  SELECT query_id, round(strength, 6) AS strength, n_sources, authoritative,
    round(CASE WHEN strength >= 0.35 THEN 0.45::DOUBLE * strength + 0.25::DOUBLE * least(1.0::DOUBLE, n_sources / 3::DOUBLE)
      + 0.2::DOUBLE * CASE WHEN authoritative THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END
      + 0.1::DOUBLE * CASE WHEN n_first < 2 THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, 2.5::DOUBLE * spread)) END ELSE 0.0::DOUBLE END, 6) AS confidence FROM agg),
judged AS (
  SELECT *, CASE WHEN confidence >= 0.72 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.28 THEN 'low' ELSE 'insufficient' END AS level FROM conf)"""


def judged(spark, sf):
    docs = knowledge_documents(spark, sf)
    sourced = found(spark, sf).join(docs.select("doc_id", "source"), "doc_id").join(F.broadcast(policies(spark).select("source", "authority")), "source")
    return R.confidence(sourced)


@query("a08_confidence", f"WITH {CONFIDENCE_SQL} SELECT * FROM judged")
def confidence(spark, sf):
    return judged(spark, sf)


@query("k27_refused_questions", f"WITH {CONFIDENCE_SQL} SELECT query_id, confidence FROM judged WHERE level = 'insufficient'")
def refused(spark, sf):
    return judged(spark, sf).where("level = 'insufficient'").select("query_id", "confidence")


@query("k31_reasons", f"""WITH {CONFIDENCE_SQL} SELECT query_id, level, array_to_string(list_filter([
  CASE WHEN strength >= 0.7 THEN 'strong match' WHEN strength >= 0.35 THEN 'partial match' ELSE 'no match above the floor' END,
  CASE WHEN authoritative THEN 'an authoritative source agrees' END,
  CASE WHEN NOT authoritative AND level = 'high' THEN 'no authoritative source; may be out of date' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM judged""")  # fmt: skip
def reasons(spark, sf):
    return R.reasons(judged(spark, sf)).select("query_id", "level", F.array_join("reasons", "; ").alias("reasons"))


_EXCERPT = """CASE WHEN length(flat) <= 320 THEN flat
  WHEN instr(reverse(substr(flat, 1, 320)), ' ') > 0 THEN substr(flat, 1, 320 - instr(reverse(substr(flat, 1, 320)), ' ')) || '…' ELSE substr(flat, 1, 320) || '…' END"""


@query("k24_citations", f"""WITH {HYBRID_SQL}, {policies_sql()},
joined AS (SELECT query_id, rank, k.source || ':' || k.game_version AS document_key, title, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS flat, tier
  FROM hits JOIN knowledge k USING (doc_id) JOIN policies USING (source)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_key ORDER BY rank) AS nth FROM joined)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS number, document_key, title,
  CASE WHEN tier IN ('full_text', 'quotation') THEN {_EXCERPT} END AS excerpt FROM firsts WHERE nth = 1""")  # fmt: skip
def citations(spark, sf):
    docs = knowledge_documents(spark, sf).withColumn("document_key", F.concat_ws(":", "source", "game_version"))
    joined = found(spark, sf).join(docs, "doc_id").join(F.broadcast(policies(spark)), "source").withColumnRenamed("body", "text")
    return R.citations(joined).withColumn("number", F.col("number").cast("long"))


_BLOCKS = f"""{HYBRID_SQL}, blocks AS (
  SELECT query_id, rank, '[' || rank || '] ' || title || ' (source: ' || source || ', ' || game_version || ')' || chr(10) || body AS block
  FROM hits JOIN knowledge USING (doc_id)),
total AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM blocks),
cut AS (SELECT *, min(CASE WHEN total > 6000 AND rank > 1 THEN rank END) OVER (PARTITION BY query_id) AS cut FROM total),
within AS (SELECT * FROM cut WHERE cut IS NULL OR rank < cut)"""


def blocks(spark, sf):
    docs = knowledge_documents(spark, sf)
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit(" (source: "), F.col("source"), F.lit(", "), F.col("game_version"), F.lit(")\n"), F.col("body"))
    return found(spark, sf).join(docs, "doc_id").select("query_id", "rank", head.alias("block"))


@query("w04_context_budget", f"WITH {_BLOCKS} SELECT query_id, rank, CAST(total AS BIGINT) AS total FROM within")
def budget(spark, sf):
    return R.within_budget(blocks(spark, sf), 6000).select("query_id", F.col("rank").cast("long").alias("rank"), "total")


@query("k26_context", f"WITH {_BLOCKS} SELECT query_id, string_agg(block, chr(10) || '---' || chr(10) ORDER BY rank) AS context, count(*) AS n_blocks FROM within GROUP BY query_id")
def context(spark, sf):
    return R.context(blocks(spark, sf), 6000)


@query("k23_boosted_rerank", f"""WITH {HYBRID_SQL}, b AS (
  SELECT query_id, doc_id, rank AS old_rank, round(CASE WHEN entity_type IN ('type1', 'type3', 'type5', 'type7') THEN score * 1.15::DOUBLE ELSE score END, 9) AS score
  FROM hits JOIN knowledge USING (doc_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank FROM b""")  # fmt: skip
def boosted(spark, sf):
    joined = found(spark, sf).join(knowledge_documents(spark, sf).select("doc_id", "entity_type"), "doc_id")
    return R.boosted(joined, F.col("entity_type").isin("type1", "type3", "type5", "type7")).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- document functions


@query("k01_normalise_text", r"""
WITH b AS (SELECT doc_id, replace(text, chr(10), chr(13) || chr(10) || '  ' || chr(10) || chr(9)) || chr(10) || chr(10) || chr(10) || chr(10) || ' end  of  it ' AS x FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\r\n?', chr(10), 'g'), '[ \t\x{00a0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM b""")
def normalised(spark, sf):
    noisy = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n  \n\t")), F.lit("\n\n\n\n end  of  it "))
    return table(spark, sf, "documents").select("doc_id", T.normalise_text(noisy).alias("body"))


@query("k02_stable_keys", f"WITH {KNOWLEDGE_SQL} SELECT doc_id, source || ':' || game_version || ':' || source_id AS stable_key, source || ':' || game_version || ':' || source_id || '#0' AS chunk_key FROM knowledge")
def keys(spark, sf):
    d = knowledge_documents(spark, sf)
    key = T.stable_key(F.col("source"), F.col("game_version"), F.col("source_id"))
    return d.select("doc_id", key.alias("stable_key"), T.chunk_key(key, F.lit(0)).alias("chunk_key"))


@query("k03_content_hash", f"WITH {KNOWLEDGE_SQL} SELECT doc_id, md5(title || chr(31) || body || chr(31) || 'lang=' || lang || ',n_chars=' || n_chars) AS content_hash FROM knowledge")
def hashes(spark, sf):
    facts = F.concat(F.lit("lang="), F.col("lang"), F.lit(",n_chars="), F.col("n_chars").cast("string"))
    return knowledge_documents(spark, sf).select("doc_id", T.content_hash(F.col("title"), F.col("body"), facts).alias("content_hash"))


@query("k04_searchable_text", f"WITH {KNOWLEDGE_SQL} SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(CASE WHEN lang <> 'en' THEN 'language: ' || lang ELSE '' END, ''), nullif(body, '')) AS searchable FROM knowledge")
def searchable(spark, sf):
    facts = F.when(F.col("lang") != "en", F.concat(F.lit("language: "), F.col("lang"))).otherwise("")
    return knowledge_documents(spark, sf).select("doc_id", T.searchable_text(F.col("title"), facts, F.col("body")).alias("searchable"))


@query("k05_token_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("k06_display_location", f"WITH {KNOWLEDGE_SQL} SELECT doc_id, title || ' › ' || entity_type || ' › ' || lang AS location FROM knowledge")
def location(spark, sf):
    return knowledge_documents(spark, sf).select("doc_id", T.display_location(F.col("title"), F.array("entity_type", "lang")).alias("location"))


@query("k12_tokens", f"SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents")
def tokenised(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))


@query("k13_hash_buckets", f"""SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT % 512 AS bucket, CASE WHEN substr(md5(term), 16, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
FROM (SELECT DISTINCT unnest({TOKENS.format('text')}) AS term FROM documents)""")
def buckets(spark, sf):
    term = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return term.select("term", T.bucket(F.col("term"), 512).cast("long").alias("bucket"), T.bucket_sign(F.col("term")).alias("sign"))


@query("a19_term_frequency", f"""WITH g AS (SELECT doc_id, unnest({_GRAMS}) AS term FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents))
SELECT doc_id, term, count(*) AS tf, round(1 + ln(count(*)), 6) AS weight FROM g GROUP BY doc_id, term""")
def term_frequency(spark, sf):
    tf = R.term_counts(table(spark, sf, "documents"), "doc_id", "text")
    return tf.withColumn("weight", F.round(1 + F.ln("tf"), 6))


@query("w09_bigrams", f"SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def bigrams(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.bigrams(T.tokens(F.col("text")))).alias("bigram"))


@query("k08_paragraphs", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
b AS (SELECT doc_id, array_to_string(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (i - 1) % 7 = 3 THEN chr(10) || '## ' || substr(x[i], 1, 40) || chr(10) ELSE x[i] || chr(10) END), chr(10)) AS body FROM l),
p AS (SELECT doc_id, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '') AS ps FROM b)
SELECT doc_id, unnest(ps) AS paragraph, unnest(range(len(ps))) AS pos FROM p""")
def paragraphs(spark, sf):
    return sectioned_bodies(spark, sf).select("doc_id", F.posexplode(T.paragraphs(F.col("body"))).alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("long"))


@query("k25_excerpt", f"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents) SELECT doc_id, {_EXCERPT} AS excerpt FROM f")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text"), 320).alias("excerpt"))


@query("f17_tier_policy", f"""WITH {KNOWLEDGE_SQL}, {policies_sql()}
SELECT doc_id, source, tier, CASE WHEN tier = 'full_text' THEN body ELSE '' END AS body FROM knowledge JOIN policies USING (source) WHERE tier <> 'disabled' AND trim(title) <> ''""")
def tiers(spark, sf):
    d = knowledge_documents(spark, sf).join(F.broadcast(policies(spark)), "source").where("tier <> 'disabled' and trim(title) <> ''")
    return d.select("doc_id", "source", "tier", F.when(F.col("tier") == "full_text", F.col("body")).otherwise("").alias("body"))


@query("f18_text_violations", f"WITH {KNOWLEDGE_SQL}, {policies_sql()} SELECT source, count(*) AS n FROM knowledge JOIN policies USING (source) WHERE tier <> 'full_text' AND body <> '' GROUP BY source")
def violations(spark, sf):
    return knowledge_documents(spark, sf).join(F.broadcast(policies(spark)), "source").where("tier <> 'full_text' and body <> ''").groupBy("source").agg(F.count("*").alias("n"))


@query("k39_index_stats", f"""WITH {KNOWLEDGE_SQL}, {policies_sql()}
SELECT source, tier, count(doc_id) AS documents, count(DISTINCT entity_type) AS entity_types, coalesce(max(n_chars), 0) AS longest FROM policies LEFT JOIN knowledge USING (source) GROUP BY source, tier""")
def stats(spark, sf):
    d = policies(spark).join(knowledge_documents(spark, sf), "source", "left")
    return d.groupBy("source", "tier").agg(F.count("doc_id").alias("documents"), F.count_distinct("entity_type").alias("entity_types"), F.coalesce(F.max("n_chars"), F.lit(0)).alias("longest"))


@query("a02_counts_by_source", f"WITH {KNOWLEDGE_SQL} SELECT source, entity_type, count(*) AS n, max(n_chars) AS longest FROM knowledge GROUP BY ROLLUP (source, entity_type)")
def by_source(spark, sf):
    return knowledge_documents(spark, sf).rollup("source", "entity_type").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


@query("k40_share_alike", f"WITH {policies_sql()} SELECT source, contains(upper(licence), 'BY-SA') OR contains(upper(licence), 'NC-SA') AS share_alike, tier IN ('full_text', 'quotation') AS may_quote FROM policies")
def share_alike(spark, sf):
    up = F.upper("licence")
    return policies(spark).select("source", (F.contains(up, F.lit("BY-SA")) | F.contains(up, F.lit("NC-SA"))).alias("share_alike"), F.col("tier").isin("full_text", "quotation").alias("may_quote"))


@query("s12_enabled_sources", f"WITH {policies_sql()} SELECT source, tier FROM policies WHERE tier <> 'disabled'")
def enabled(spark, sf):
    return policies(spark).where("tier <> 'disabled'").select("source", "tier")


@query("s11_disabled_source_rows", f"WITH {KNOWLEDGE_SQL}, {policies_sql()} SELECT count(*) AS stored FROM knowledge JOIN policies USING (source) WHERE tier = 'disabled' AND false")
def disabled(spark, sf):
    kept = knowledge_documents(spark, sf).join(F.broadcast(policies(spark)), "source").where("tier <> 'disabled'")
    return kept.where("tier = 'disabled'").agg(F.count("*").alias("stored"))


_HINTS = [("article", "the "), ("article", "der "), ("colour", "red"), ("jewel", "ring"), ("verb", "est "), ("verb", "ing ")]
_HINTS_SQL = "hints(entity_type, keyword) AS (VALUES " + ", ".join(f"('{e}', '{k}')" for e, k in _HINTS) + ")"
_ASKED = "asked AS (SELECT conv_id * 100 + turn AS query_id, text AS question FROM conversations WHERE role = 'user')"


def asked(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))


@query("k22_entity_hints", f"WITH {_ASKED}, {_HINTS_SQL} SELECT query_id, array_to_string(list_sort(list_distinct(list(entity_type))), ',') AS hints FROM asked JOIN hints ON contains(lower(question), keyword) GROUP BY query_id")
def hints(spark, sf):
    words = spark.createDataFrame(_HINTS, "entity_type string, keyword string")
    return R.keyword_hints(asked(spark, sf), words).select("query_id", F.array_join("hints", ",").alias("hints"))


@query("k22_entity_hints_words", f"""WITH {_ASKED}, {_HINTS_SQL} SELECT query_id, array_to_string(list_sort(list_distinct(list(entity_type))), ',') AS hints
FROM asked JOIN hints ON contains(' ' || regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || trim(keyword) || ' ') GROUP BY query_id""")
def hint_words(spark, sf):
    words = spark.createDataFrame([(e, k.strip()) for e, k in _HINTS], "entity_type string, keyword string")
    return R.keyword_hints(asked(spark, sf), words, word_boundary=True).select("query_id", F.array_join("hints", ",").alias("hints"))


@query("k21_version_filter", f"WITH {_ASKED} SELECT query_id, CASE WHEN contains(lower(question), 'era') OR contains(lower(question), 'vanilla') OR contains(lower(question), 'classic') THEN 'classic' END AS version FROM asked")
def version(spark, sf):
    q = F.lower("question")
    hit = F.contains(q, F.lit("era")) | F.contains(q, F.lit("vanilla")) | F.contains(q, F.lit("classic"))
    return asked(spark, sf).select("query_id", F.when(hit, "classic").alias("version"))


_ANSWERS = [(1, "Take the tram [1] , then walk [4]. See [2].", [1, 2]), (2, "Nothing is known.", [1]), (3, "[9] [9] only  wrong [10].", [1, 2, 3]), (4, "", [])]


@query("k28_citation_check", """SELECT * FROM (VALUES (1, 'Take the tram [1], then walk. See [2].', '4', '1,2', 'high', 'high'), (2, 'Nothing is known.', '', '', 'high', 'medium'),
(3, 'only wrong.', '9,10', '', 'high', 'medium'), (4, '', '', '', 'high', 'medium')) v(query_id, answer, dropped, cited, before, level)""")  # fmt: skip
def citation_check(spark, sf):
    a = spark.createDataFrame(_ANSWERS, "query_id int, answer string, included array<int>")
    v = R.verified_answer(F.col("answer"), F.col("included"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return a.select("query_id", v["answer"].alias("answer"), text(v["dropped"]).alias("dropped"), text(v["cited"]).alias("cited"), F.lit("high").alias("before"), R.downgraded(F.lit("high"), v["cited"]).alias("level"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"""
_PLAIN = f"regexp_replace(regexp_replace(replace(replace(replace(replace(replace({_CLEAN.format('html')}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("k32_page_text", f"SELECT page_id, {_PLAIN} AS body FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_markup(F.col("html")).alias("body"))


@query("k33_long_enough_pages", f"SELECT page_id, length({_PLAIN}) AS n FROM pages WHERE length({_PLAIN}) >= 80")
def long_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(T.strip_markup(F.col("html"))).cast("long").alias("n")).where("n >= 80")


_WIKI = [(1, "'''Old''' [[Ruin|ruins]]<ref>x</ref> of [[Vale]]."), (2, "{{Info|a={{b|c}}}}Text {| t |} [[File:x.png|thumb]]end"), (3, None), (4, "")]


@query("k32_clean_wikitext", "SELECT * FROM (VALUES (1, 'Old ruins of Vale.'), (2, 'Text  end'), (3, NULL), (4, '')) v(id, body)")
def wikitext(spark, sf):
    return spark.createDataFrame(_WIKI, "id int, markup string").select("id", T.clean_wikitext(F.col("markup")).alias("body"))


@query("k34_url_entity_type", """SELECT page_id, CASE WHEN regexp_matches(url, 'blog\\.') THEN 'news' WHEN regexp_matches(url, '/en/') THEN 'page' WHEN regexp_matches(url, '\\.html') THEN 'article' ELSE 'guide' END AS entity_type FROM pages""")
def url_type(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.when(u.rlike(r"blog\."), "news").when(u.rlike("/en/"), "page").when(u.rlike(r"\.html"), "article").otherwise("guide").alias("entity_type"))


_SLUG = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/?$', 1), '\.[a-z]+$', ''), '^[0-9]+[-_]?', '')"


@query("k35_url_title", f"""SELECT page_id, array_to_string(list_transform(list_filter(string_split_regex({_SLUG}, '[-_]+'), lambda x: x <> ''), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS title FROM pages""")
def url_title(spark, sf):
    last = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]+)/?$", 1)
    name = F.regexp_replace(F.regexp_replace(last, r"\.[a-z]+$", ""), "^[0-9]+[-_]?", "")
    words = F.filter(F.split(name, "[-_]+"), lambda x: x != "")
    return table(spark, sf, "pages").select("page_id", F.array_join(F.transform(words, F.initcap), " ").alias("title"))
