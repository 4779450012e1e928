from __future__ import annotations

import duckdb

from millrace.llm import decontamination as D


def brute(docs, items, words=5, percent=80):
    def split(t):
        return "".join(c if c.isalpha() or c.isdecimal() else " " for c in (t or "").lower()).split()

    out = {}
    for item, text in items:
        w = split(text)
        m = min(words, len(w))
        if not m:
            continue
        s = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        for doc, t in docs:
            d = split(t)
            n = len(s & {tuple(d[i : i + m]) for i in range(len(d) - m + 1)})
            if 100 * n >= percent * len(s):
                out[doc, item] = (len(s), n)
    return out


def cases(rows):
    long = next(t for d, t in rows if d == 1007).split(" ")
    some = next(t for d, t in rows if t and 60 < len(t.split(" ")) < 120).split(" ")
    items = [(1, " ".join(long[300:340])), (2, " ".join(some[5:35])), (3, "no such words in any of the texts at all"), (4, None), (5, ""), (6, "one two"), (7, " ".join(long[100:115] + ["zzz"] + long[115:140])), (8, " ".join(long[10:12]))]
    docs = [*rows, (2000, "x " + " ".join(long[300:331]) + " y"), (2001, "X, " + "; ".join(w.upper() for w in some[5:35])), (2002, "two, one TWO")]
    return docs, items


def test_like_brute_force(spark, rows):
    docs, items = cases(rows)
    d = spark.createDataFrame([(k, t, 1, "w") for k, t in docs], "doc_id long, text string, item_id int, w string").repartition(4)
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): (r["n_item_shingles"], r["n_shared"]) for r in D.contained_items(d, i).collect()}
    assert got == brute(docs, items) and (2001, 2) in got and (2002, 6) in got


def test_without_broadcasts(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "BROADCAST_IDS", 0)
    docs, items = cases(rows)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contained_items(d, i).collect()} == set(brute(docs, items))


def test_oracle(spark, rows):
    docs, items = cases(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = {(r[0], r[1]): (r[2], r[3]) for r in con.sql(D.ORACLE).fetchall()}
    assert got == brute(docs, items)


def test_empty_and_drop(spark, docs, empty):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    none = items.where("false")
    assert D.contained_items(docs, none).count() == 0 and D.contained_items(empty, items).count() == 0
    assert D.drop_contaminated(docs, none).count() == docs.count()
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and docs.count() - kept.count() == 1


def test_rows_are_judged_by_their_text(spark):
    """Null and repeated ids neither hide a contaminated row nor take a clean one with it."""
    item = "the benchmark item that nobody may find in any of the texts"
    rows = [(None, f"before. {item} after"), (None, "clean and long enough to stay where it is"), (1, f"{item}"), (1, "another clean text under the same id"), (2, None), (None, None), (3, ""), (4, f"x {item} y"), (4, f"x {item} y")]
    d = spark.createDataFrame([(k, t, n, "h") for n, (k, t) in enumerate(rows)], "doc_id long, text string, item_id int, h string").repartition(3)
    kept = D.drop_contaminated(d, spark.createDataFrame([(1, item), (None, "clean and long enough")], "item_id long, text string"))
    assert kept.columns == d.columns
    assert {r["item_id"] for r in kept.collect()} == {1, 3, 4, 5, 6}
    # the search by id: rows of one id count as one document, rows without an id are left out
    found = D.contained_items(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (4, 1)}


def test_clashing_columns_stay(spark):
    names = ["__row", "__rid", "row", "ROW1", "stays", "hash", "Hash1", "__text", "__bad", "a.b"]
    some = spark.createDataFrame([(k, f"text {k} has words of its own like w{k} x{k} y{k}", *[f"{c}{k}" for c in names]) for k in range(4)] * 2, ["doc_id", "text", *names])
    out = D.drop_contaminated(some, spark.createDataFrame([(1, "seven words stand here in this item")], "item_id long, text string"))
    assert out.columns == some.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in some.collect()}
