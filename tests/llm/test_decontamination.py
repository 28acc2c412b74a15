import hashlib
import re

import pytest

from assetlake.llm.decontamination import decontaminated, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, n=10):
    wins = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in range(1, n + 1):
            for i in range(len(w) - size + 1):
                if ids := wins.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "one two THREE four five six seven eight nine ten eleven twelve"), (2, "tiny item"), (3, ""), (4, None), (5, "Über straße ß naïve"), (12, "tiny item"), (None, "zz yy")]
DOCS = [
    (1, "x One two three, four-five six seven eight nine ten ELEVEN y"),
    (2, "a tiny item and tiny   item; tiny"), (3, None), (4, ""), (5, "..."), (6, "über Straße ß naïve"), (6, "über straße ß naïve ZZ yy"),
    (None, "tiny item"), (7, "one two three four five six seven eight nine"), (8, "w " * 5000 + "tiny item"), (9, "one two three four five six seven eight nine ten " * 3),
]


@pytest.mark.parametrize("most", [1000, 0])
def test_scan_matches_brute_force(spark, most):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as hash", "'k' as key", "0 as n")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as words")
    rows = [tuple(r)[:6] for r in scan(docs, items, most_windows=most).collect()]
    assert sorted(rows, key=repr) == brute(DOCS, ITEMS)


def test_scan_on_test_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted([tuple(r)[:6] for r in scan(docs, items).collect()], key=repr) == want
    assert any(r[5] for r in want)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert scan(docs.limit(0), items).count() == 0
    assert scan(docs, items.limit(0)).where("contaminated").count() == 0


def test_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as contaminated")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r.doc_id for r in decontaminated(docs, items).collect()} == {3, 4, 5, 6, 7}
    spans = {r.text for r in decontaminated(docs, items, mode="span").where("doc_id = 1 or doc_id = 2").collect()}
    assert spans == {"x  y", "a  and ; tiny"}


@pytest.mark.parametrize("most", [1000, 0])
def test_removal_judges_rows_with_null_and_repeated_ids(spark, most):
    rows = [*DOCS, (None, "clean text"), (2, "another text of the same id"), (None, "tiny item")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "1 as key", "text", "2 as hits")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    report = brute([(k, t) for k, (_, t) in enumerate(rows)], ITEMS)
    want = [rows[r[0]] for r in report if not r[5]]
    out = decontaminated(docs, items, most_windows=most)
    assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)
    spans = decontaminated(docs, items, mode="span", most_windows=most).collect()
    cut = {(1, "x  y"), (2, "a  and ; tiny"), (None, ""), (None, "clean text"), (2, "another text of the same id")}
    assert len(spans) == len(rows) and {(r.doc_id, r.text) for r in spans if r.doc_id in (None, 1, 2)} == cut
