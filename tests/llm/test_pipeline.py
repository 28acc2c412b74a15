"""The pipeline's stages against plain versions of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assetlake.llm.language_id import train
from assetlake.llm.language_id import labelled
from assetlake.llm.token_output import HEADER
from assetlake.llm.toxicity import remainder

from .test_decontamination import brute as brute_hits
from .test_mixing import targets
from .test_ngram_join import brute as brute_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {"en": "the and of to a in is that it was for on with this as".split(), "fr": "le la et de un une dans est que qui pour par sur avec pas".split()}
    folder = tmp_path_factory.mktemp("sf")
    docs, items = [], []
    for k in range(4):
        items.append((k, " ".join(rng.choice(words["en"]) + str(rng.randrange(50)) for _ in range(20))))
    for i in range(150):
        lang = rng.choice(["en", "fr"])
        base = [rng.choice(words[lang]) + (str(rng.randrange(90)) if rng.random() < 0.5 else "") for _ in range(rng.randrange(5, 80))]
        if i % 9 == 0:
            base += items[i % 4][1].split()
        docs.append((i, " ".join(base), lang, f"s{i % 4}", 0))
        if i % 6 == 0:
            base[len(base) // 2] = "edited"
            docs.append((1000 + i, " ".join(base), lang, "s9", 0))
    docs += [(5000, "12 34", "en", "s1", 0), (5001, None, "fr", "s1", 0), (5002, docs[0][1], "en", None, 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def test_stages(spark, tables):
    folder, docs, items = tables
    df = spark.read.parquet(f"{folder}/documents.parquet")
    model = train(df.where(remainder(F.col("doc_id"), 3) != 1))
    said = {r.doc_id: r for r in labelled(df, model).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in df.collect()]
        out = stage(spark, df, folder)
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        if name == "language ID":
            want = [r for r in rows if said[r[0]].lang_pred != "und" and said[r[0]].score >= 0.4]
            assert len(rows) - len(want) >= 2 and len(want) > 0.9 * len(rows)
        elif name == "n-gram Jaccard join":
            root = {i: c for i, _, c in brute_groups([r[:2] for r in rows])}
            want = [r for r in rows if root[r[0]] == r[0]]
            assert len(want) < len(rows)
        elif name == "benchmark decontamination":
            hit = {r[0] for r in brute_hits([r[:2] for r in rows], items) if r[5]}
            want = [r for r in rows if r[0] not in hit]
            assert hit
        else:
            want = got
            goal = targets([(r[0], r[3], r[1]) for r in rows])
            taken = dict.fromkeys(goal, 0)
            for r in got:
                taken[r[3]] += len((r[1] or "").split())
            assert all(abs(taken[s] - goal[s]) <= max(5, 0.05 * goal[s]) for s in goal)
            assert max(sum(g[0] == r[0] for g in got) for r in rows) <= 3 and set(got) <= set(rows)
        assert got == sorted(want, key=repr)
        df = spark.createDataFrame(got, SCHEMA)
    shards = corpus_pipeline.output(spark, df, folder).collect()
    ids = []
    for s in shards:
        raw = np.frombuffer(s.data, np.uint8).reshape(s.n_sequences, s.stride)
        ids += np.ascontiguousarray(raw[:, : HEADER.itemsize]).view(HEADER).ravel()["doc_id"].tolist()
    assert sorted(set(ids)) == sorted({r[0] for r in got}) and len(ids) >= len(got)


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() >= 1
