import math
import re
from collections import Counter

import pytest

from assetlake.llm.lm_scoring import cross_entropy_difference, flagged

M, A = 32.0, 0.5


def brute(docs, target, words, pairs):
    split = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower() if (t or "").isascii() else t) for i, t in docs}
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in split.items():
        for side in (0, 1):
            if side or i in target:
                uni[side].update(w)
                bi[side].update(zip(w, w[1:]))
    total = [sum(u.values()) for u in uni]
    vocabulary = {w for w, n in uni[1].items() if n >= total[1] / words}
    kept = {p for p, n in bi[1].items() if n >= total[1] / pairs and set(p) <= vocabulary}
    out = []
    for i, w in split.items():
        mean = []
        for side in (0, 1):
            scale = total[0] / total[1] if side else 1
            count = lambda x: scale * (uni[side][x] if x in vocabulary else total[side] - sum(uni[side][v] for v in vocabulary))  # noqa: B023, E731
            loss = 0.0
            for k, x in enumerate(w):
                p = (count(x) + A) / (total[side] * scale + A * (len(vocabulary) + 1))
                if k:
                    seen = scale * bi[side][w[k - 1], x] if (w[k - 1], x) in kept else 0
                    p = (seen + M * p) / (count(w[k - 1]) + M)
                loss -= math.log(p)
            mean.append(loss / max(1, len(w)))
        out.append((i, len(w), *mean, mean[0] - mean[1]))
    return sorted(out)


DOCS = [(1, "The cat sat. the cat ran"), (2, "a dog sat on the cat"), (3, None), (4, ""), (5, "..."), (6, "été the cat " * 40), (7, "the the the dog a dog a dog"), (8, "rare words only here")]


@pytest.mark.parametrize("target", [{1, 6}, set(), {1, 2, 3, 4, 5, 6, 7, 8}])
def test_matches_brute_force(spark, target):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "true as target", "1 as total").repartition(3)
    ids = spark.createDataFrame([(i,) for i in target] + [(None,)], "doc_id long")
    got = sorted(tuple(r) for r in cross_entropy_difference(df, ids, words=40, pairs=50).collect())
    for a, b in zip(got, brute(DOCS, target, 40, 50), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_target_documents_score_lower(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    target = docs.where("lang = 'fr'").select("doc_id")
    rows = cross_entropy_difference(docs, target).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").avg("score").collect()
    mean = dict(map(tuple, rows))
    assert mean.pop("fr") < min(mean.values())


def test_large_targets_join_and_empty_table(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (6,)], "doc_id long")
    rows = sorted(map(tuple, flagged(df, ids, most=0).collect()), key=repr)
    assert rows == sorted(map(tuple, flagged(df, ids).collect()), key=repr) and sum(r[1] for r in rows) == 2
    assert cross_entropy_difference(df.limit(0), ids).count() == 0


def test_rare_words_are_known_and_batches_do_not_matter(spark):
    docs = [*DOCS, (9, "the " * 300_000), (10, "only once a zebra here"), (None, "zebra sat here"), (11, " ".join(f"w{i}" for i in range(3000)))]
    df, ids = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10,), (8,)], "doc_id long")
    want = sorted(brute(docs[:-2] + [(-1, docs[-2][1]), docs[-1]], {8, 10}, 10**9, 10**9))
    for options in ({}, {"sums": 5, "bucket": 20_000}):
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, cross_entropy_difference(df.repartition(2), ids, **options).collect()))
        for a, b in zip(got, want, strict=True):
            assert a == pytest.approx(b, abs=1e-9)
