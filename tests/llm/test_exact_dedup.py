import hashlib
import re

from assetlake.llm.exact_dedup import deduplicated, exact_dedup


def brute(docs):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in docs]
    groups = {}
    for k, (i, t) in enumerate(norm):
        groups.setdefault(t, []).append((i is None, i or 0, k))
    out = []
    for k, (i, t) in enumerate(norm):
        g = sorted(groups[t])
        keep = docs[g[0][2]][0]
        out.append((i, keep, len(g), g[0][2] == k, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


DOCS = (
    [(i, f"copy {'  ' * (i % 3)}x") for i in range(60)] + [(100 + i, f"hot\t\ntext {i % 2}") for i in range(50)] + [(i, f"text {i}") for i in range(200, 240)]
    + [(300, None), (301, ""), (302, " "), (303, "\n\n"), (304, "a b"), (305, "a b"), (306, "y" * 200_000), (307, "y" * 200_000), (None, "text 200"), (None, "only null"), (None, "only null")]
    + [(400, "same id"), (400, "same id"), (401, "same id")] + [(None, "hot and nameless")] * 45 + [(500, "hot, one id")] * 45
)


def same(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_matches_brute_force_with_and_without_heavy_digests(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as keep_id", "2 as text_sha256", "3 as kept").repartition(5)
    want = brute(DOCS)
    assert same(exact_dedup(df).collect()) == want
    assert same(exact_dedup(df, heavy=2, counters=64).collect()) == want


def test_kept_rows_and_empty_table(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as keep_id", "2 as row", "3 as stays")
    kept = deduplicated(df)
    assert set(kept.columns) == set(df.columns)
    want = [(r[0], r[4]) for r in brute(DOCS) if r[3]]
    assert sorted(((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert exact_dedup(df.limit(0)).count() == 0


def test_candidates_are_held_against_their_count(spark):
    df = spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)], "doc_id long, text string")
    for counters in (8, 64):
        rows = exact_dedup(df, heavy=4, counters=counters).collect()
        assert all(r.keep_id == r.doc_id // 2 * 2 and r.group_size == 2 and r.kept == (r.doc_id % 2 == 0) for r in rows) and len(rows) == 400
