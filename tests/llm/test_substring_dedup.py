import hashlib
import random
import re

import pytest

from assetlake.llm.substring_dedup import substring_dedup


def brute(docs, length):
    first, words = {}, {}
    for doc, text in sorted({d for d in docs if d[0] is not None}, key=lambda d: d[0]):
        words[doc] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for p in range(len(words[doc]) - length + 1):
            first.setdefault(tuple(words[doc][p : p + length]), (doc, p))
    out = []
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for p in range(len(w) - length + 1 if doc is not None else 0):
            if first[tuple(w[p : p + length])] != (doc, p):
                gone |= set(range(p, p + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}" + rng.choice(["", "", ".", "é"])
    passages = [[word() for _ in range(rng.randrange(10, 70))] for _ in range(12)]
    docs = []
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += [word() for _ in range(rng.randrange(0, 40))]
            if rng.random() < 0.5:
                p = rng.choice(passages)
                w += p[rng.randrange(0, 5) : len(p) - rng.randrange(0, 5)]
        docs.append(rng.choice([" ", "\n", "  "]).join(w))
    docs += [docs[3]] * 20 + ["", None, " \t", "same " * 200, "a b c d " * 60, "x"]
    rng.shuffle(docs)
    return [(i * 7 - 100, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("length", [20, 7])
def test_matches_brute_force(spark, length):
    docs = made(length)
    docs += [docs[5], (None, docs[6][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as `to`").repartition(4)
    assert sorted((tuple(r) for r in substring_dedup(df, length).collect()), key=repr) == brute(docs, length)


def test_test_tables_and_empty_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute(docs, 20)
    assert sum(r[2] for r in want) > 100
    assert sorted((tuple(r) for r in substring_dedup(df).collect()), key=repr) == want
    assert substring_dedup(df.limit(0)).count() == 0
