"""Queries over the stored full-text index: written searches ranked by cover density, and hybrid search on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import postings
from millrace.operators import retrieval as R
from millrace.operators.checkpoints import new_folder
from millrace.plans.catalog import query
from millrace.plans.retrieval import DENSE_SQL
from millrace.sources.tables import KNOWLEDGE_SQL, QUESTIONS_SQL, knowledge_documents, questions

SEARCHES = [
    (1, "the of -and"), (2, '"of the" or "license version"'), (3, "-the"), (4, 'apache "license, version"'), (5, '!! "" -'), (6, 'der -"in der" or les'),
    (7, "license apache or of -the"), (8, "be by with is"),
]
_ALT = """alt(query_id, alternative, must, must_not) AS (VALUES (1, 0, [['of'], ['the']], [['and']]), (2, 0, [['of', 'the']], []::VARCHAR[][]), (2, 1, [['license', 'version']], []::VARCHAR[][]),
  (3, 0, []::VARCHAR[][], [['the']]), (4, 0, [['apache'], ['license', 'version']], []::VARCHAR[][]), (6, 0, [['der']], [['in', 'der']]), (6, 1, [['les']], []::VARCHAR[][]),
  (7, 0, [['apache'], ['license']], []::VARCHAR[][]), (7, 1, [['of']], [['the']]), (8, 0, [['be'], ['by'], ['is'], ['with']], []::VARCHAR[][]))"""


def cover_sql(alt: str) -> str:
    """``scored`` (query_id, doc_id, score) of the alternatives ``alt`` over ``knowledge``, from places unnested of all texts."""
    words = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9'']+')"
    return f"""{KNOWLEDGE_SQL}, {alt},
toks AS (SELECT doc_id, {words.format('title')} AS tt, {words.format('body')} AS bt FROM knowledge),
place AS (SELECT doc_id, len(tt) AS nt, list_concat(tt, bt) AS t, unnest(range(1, len(tt) + len(bt) + 1)) AS pos FROM toks),
must AS (SELECT query_id, alternative, phrase, nth FROM (SELECT query_id, alternative, unnest(must) AS phrase, unnest(range(len(must))) AS nth FROM alt)),
banned AS (SELECT query_id, alternative, phrase FROM (SELECT query_id, alternative, unnest(must_not) AS phrase FROM alt)),
heads AS (SELECT doc_id, nt, t, pos FROM place WHERE t[pos] IN (SELECT phrase[1] FROM must UNION SELECT phrase[1] FROM banned)),
occ AS (SELECT query_id, alternative, nth, doc_id, pos AS s, pos + len(phrase) - 1 AS e FROM must JOIN heads ON t[pos] = phrase[1] WHERE t[pos:pos + len(phrase) - 1] = phrase),
bad AS (SELECT DISTINCT query_id, alternative, doc_id FROM banned JOIN heads ON t[pos] = phrase[1] WHERE t[pos:pos + len(phrase) - 1] = phrase),
full_alt AS (SELECT query_id, alternative, doc_id FROM (SELECT query_id, alternative, doc_id, count(DISTINCT nth) AS n FROM occ GROUP BY ALL) JOIN alt USING (query_id, alternative) WHERE n = len(must)
  EXCEPT SELECT query_id, alternative, doc_id FROM bad),
own AS (SELECT occ.* FROM occ JOIN full_alt USING (query_id, alternative, doc_id)),
firsts AS (SELECT DISTINCT query_id, doc_id, s AS p FROM own),
wanted AS (SELECT f.query_id, f.doc_id, f.p, m.alternative, m.nth FROM firsts f JOIN full_alt a USING (query_id, doc_id) JOIN must m ON m.query_id = f.query_id AND m.alternative = a.alternative),
nxt AS (SELECT w.*, o.e FROM wanted w ASOF JOIN own o ON w.query_id = o.query_id AND w.doc_id = o.doc_id AND w.alternative = o.alternative AND w.nth = o.nth AND w.p <= o.s),
run AS (SELECT query_id, doc_id, p, min(q) AS q FROM (SELECT query_id, doc_id, p, alternative, max(e) AS q, count(*) AS n FROM nxt GROUP BY ALL) JOIN alt USING (query_id, alternative) WHERE n = len(must) GROUP BY query_id, doc_id, p),
cover AS (SELECT query_id, doc_id, max(p) AS p, q FROM run GROUP BY query_id, doc_id, q),
entry AS (SELECT DISTINCT query_id, doc_id, pos, CASE WHEN pos <= nt THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS inv FROM (SELECT DISTINCT query_id, unnest(phrase) AS term FROM must) JOIN place ON t[pos] = term),
summed AS (SELECT query_id, doc_id, pos, count(*) OVER w AS n, sum(inv) OVER w AS inv FROM entry WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)),
at_end AS (SELECT c.*, n, inv FROM cover c ASOF JOIN summed s ON c.query_id = s.query_id AND c.doc_id = s.doc_id AND c.q >= s.pos),
both_ends AS (SELECT a.query_id, a.doc_id, p, q, a.n - coalesce(s.n, 0) AS n, a.inv - coalesce(s.inv, 0) AS inv FROM at_end a ASOF LEFT JOIN summed s ON a.query_id = s.query_id AND a.doc_id = s.doc_id AND a.p > s.pos),
scored AS (SELECT query_id, doc_id, round(sum(n / inv / (1 + q - p + 1 - n)), 6) AS score FROM both_ends GROUP BY query_id, doc_id
  UNION ALL SELECT query_id, doc_id, 0.0::DOUBLE FROM (SELECT a.query_id, k.doc_id FROM alt a, knowledge k WHERE len(a.must) = 0 AND NOT EXISTS (FROM bad b WHERE b.query_id = a.query_id AND b.alternative = a.alternative AND b.doc_id = k.doc_id)))"""


def built(spark, sf: str, config: str) -> postings.Index:
    """The index of the knowledge documents, in a folder of its own, with what searches filter by."""
    return postings.Index(spark, new_folder(spark, "postings"), config).write(knowledge_documents(spark, sf), keep=["source", "game_version"])


def asked(spark):
    return spark.createDataFrame(SEARCHES, "query_id int, query string")


@query("k17_cover_density", f"WITH {cover_sql(_ALT)} SELECT query_id, doc_id, score, round(coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0), 0), 6) AS lexical_score FROM scored")
def cover_density(spark, sf):
    return postings.search(built(spark, sf, "simple"), asked(spark))


@query("k17_english_search")
def english(spark, sf):
    """As above with stems and without stop words, the first 50 of each search."""
    return postings.search(built(spark, sf, "english"), asked(spark), limit=50)


@query("k17_filtered_search", f"""WITH {cover_sql(_ALT)} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM scored JOIN knowledge USING (doc_id) WHERE source IN ('wiki', 'guides') AND game_version = 'retail' QUALIFY rank <= 20""")
def filtered(spark, sf):
    found = postings.search(built(spark, sf, "simple"), asked(spark), limit=20, where=F.col("source").isin("wiki", "guides") & (F.col("game_version") == "retail"))
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_QUESTION_ALT = """q_words AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: length(x) >= 6)[1:4]) AS w FROM benchmark),
alt AS (SELECT query_id, unnest(range(len(w))) AS alternative, [[unnest(w)]] AS must, []::VARCHAR[][] AS must_not FROM q_words)"""
_LEXICAL = f"""{QUESTIONS_SQL}, {cover_sql(_QUESTION_ALT)},
lex_top AS (SELECT query_id, doc_id, round(coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0), 0), 6) AS lexical_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 32)"""


def any_word(spark, sf):
    """Each question as a search for any of its first four words of six letters or more."""
    long = F.filter(T.tokens(F.col("question")), lambda w: F.length(w) >= 6)
    return questions(spark, sf).select("query_id", F.array_join(F.array_distinct(F.slice(long, 1, 4)), " or ").alias("query"))


@query("t04_top_cover_density", f"WITH {_LEXICAL} SELECT * FROM lex_top")
def top_cover(spark, sf):
    found = postings.search(built(spark, sf, "simple"), any_word(spark, sf), limit=32)
    return found.select("query_id", "doc_id", "lexical_score", F.col("rank").cast("long").alias("rank"))


@query("k20_indexed_hybrid", f"""WITH {_LEXICAL}, {DENSE_SQL}, dense_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, doc_id) AS rank FROM dense) WHERE rank <= 32),
fused AS (SELECT query_id, doc_id, coalesce(vector_score, 0.0::DOUBLE) AS vector_score, coalesce(lexical_score, 0.0::DOUBLE) AS lexical_score,
    round(coalesce(1 / (60 + d.rank)::DOUBLE, 0) + coalesce(1 / (60 + x.rank)::DOUBLE, 0), 9) AS score FROM dense_top d FULL OUTER JOIN lex_top x USING (query_id, doc_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 8""")
def indexed_hybrid(spark, sf):
    lexical = postings.search(built(spark, sf, "simple"), any_word(spark, sf), limit=32)
    dense = R.top_per_query(R.dense_hits(questions(spark, sf), knowledge_documents(spark, sf), depth=32), "vector_score", 32)
    return R.fuse(dense, lexical, 8).withColumn("rank", F.col("rank").cast("long"))
