from __future__ import annotations

import corpus_pipeline as P
from millrace.llm import sentencepiece_codec

SENTENCES = [
    "the quick river went over the old stones and under the bridge at dawn {0}",
    "a long walk through the valley of reeds ended near the mill by {0} people",
    "nobody in the small town could say when the tower had been built {0}",
]


def documents(spark):
    rows = []
    for k in range(24):
        text = ". ".join(f"{s.format(f'n{k}x{j} q{k * 31 + j}')} word{k}a{j} word{k}b{j} word{k}c{j}" for j, s in enumerate(SENTENCES))
        rows.append((k, text, "en", "s"))
    rows += [(100, rows[3][1], "en", "s"), (101, rows[4][1].replace("tower", "wall"), "en", "s"), (102, None, "en", "s"), (103, "1234 !!", None, "s")]
    rows += [(104, "some text before. the benchmark item that must not be found in any training text at all. after it more", "en", "s")]
    rows += [(105, 'a file with token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in the middle of other words', "en", "s")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "The benchmark item that must not be found in any training text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, ids = docs, []
    for k, (name, stage) in enumerate(P.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert k == len(P.STAGES) - 1 or now.columns == docs.columns
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
    whole = {r["doc_id"] for r in docs.collect()}
    assert ids[0] == whole - {102, 103}
    assert ids[1] == ids[0] - {100, 101}
    assert ids[2] == ids[1] - {104}
    assert ids[3] == ids[2] == ids[4]
    redacted = spark.read.parquet(str(tmp_path / "secrets"))
    assert "24be" not in redacted.where("doc_id = 105").first()["text"]
    tokens = {r["doc_id"]: r["ids"] for r in now.collect()}
    p = sentencepiece_codec.pieces_at(sentencepiece_codec.MODEL)
    assert all(sentencepiece_codec.decode_ids(p, tokens[r["doc_id"]]) == r["text"] for r in redacted.collect())
    run = P.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["ids"] for r in run.collect()} == tokens


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Rows are judged one by one: what goes and what stays does not depend on ids or on further columns."""
    docs = documents(spark)
    clean, other = (docs.where(f"doc_id = {k}").first()["text"] for k in (7, 8))
    item = docs.where("doc_id = 104").first()["text"]
    secret = docs.where("doc_id = 105").first()["text"]
    more = [(None, clean), (None, "a new text of no other document with the old stones and the valley of reeds"), (3, other.replace("river", "sea")), (3, "the town near the mill had another tower by dawn, and nobody could say when"), (None, item), (None, secret), (3, None)]
    extra = spark.createDataFrame([(k, t, "en", None, len(t or "")) for k, t in more], docs.schema)
    whole = docs.unionByName(extra)
    for c in ("id", "v", "n", "h", "key", "row", "rid", "hub", "item_id"):
        whole = whole.selectExpr("*", f"doc_id AS {c}")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "The benchmark item that must not be found in any training text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == whole.columns
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left.append([(r["doc_id"], r["text"]) for r in now.collect()])
    assert all(t for _, t in left[0]) and len(left[0]) == whole.count() - 3
    assert [k for k, t in left[1] if t == clean] == [7] and (3, more[3][1]) in left[1] and (None, more[1][1]) in left[1]
    assert len(left[1]) == len(left[0]) - 6  # copies: 100, 101, the copy of 7, of 8, of 104 and of 105
    assert {k for k, _ in left[1]} - {k for k, _ in left[2]} == {104} and len(left[1]) == len(left[2]) + 1
    assert not any("24be64439e" in t for _, t in left[3]) and len(left[3]) == len(left[2])
    assert P.run(spark, str(tmp_path)).count() == len(left[3])


def test_empty_table(spark, tmp_path):
    documents(spark).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
