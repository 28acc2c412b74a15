"""Every query over tables with nulls in any column, odd texts and repeated rows, and over empty tables."""

import pytest

from assetlake.llm.queries import QUERIES
from corpus_pipeline import run

TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [
        (1, "Hello there you idiot. Fine words here", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n\r ", "fr", "b", 4), (None, "no id at all here", None, "b", 1),
        (5, "x", "en", None, 1), (6, "word " * 30_000, "en", "a", 1), (7, "\x00\x01     \U0001f600", "de", "c", 1), (8, "le chat et la souris " * 20, "fr", "c", 1), (8, "le chat et la souris " * 20, "fr", "c", 1),
        (9, "no lang known", None, "a", 1), (-5, "negative id", "en", "a", 1), (1 << 60, "large id", "en", "a", 1), (10, "y" * 100_000, "en", "d", 1),
    ]),
    "benchmark": ("item_id long, text string", [(1, "le chat et la souris le chat et la souris"), (2, None), (3, ""), (None, "fine words"), (1, "le chat et la souris le chat et la souris")]),
    "labels": ("doc_id long, quality int, toxic int", [(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None), (6, 1, 0), (8, 1, 0), (8, 1, 0), (77, 1, 1)]),
    "conversations": ("conv_id long, turn long, role string, text string", [(1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b"), (2, 1, "assistant", ""), (2, 1, "assistant", "")]),
}


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(spark, request, tmp_path_factory):
    out = tmp_path_factory.mktemp(request.param)
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows if request.param == "odd" else [], schema).selectExpr("*", "1 as score", "'k' as key", "2 as kept").write.parquet(f"{out}/{name}.parquet")
    return request.param, str(out)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_query(spark, folder, name):
    kind, path = folder
    rows = {**QUERIES, "pipeline": run}[name](spark, path).collect()
    if name == "op3_chat_format":
        assert len(rows) == (4 if kind == "odd" else 1)
    elif name == "pipeline":
        assert bool(rows) == (kind == "odd")
    elif name == "op6_token_output":
        assert {r.doc_id for r in rows} == ({-1 if d[0] is None else d[0] for d in TABLES["documents"][1]} if kind == "odd" else set())
    else:
        assert sorted((r.doc_id for r in rows), key=repr) == (sorted((d[0] for d in TABLES["documents"][1]), key=repr) if kind == "odd" else [])
