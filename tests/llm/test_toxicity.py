import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from assetlake.llm.toxicity import CALM, Model, features, scored, toxicity
from assetlake.llm.words import ALNUM, chunks


def made(n=400):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdegilmnorstu") for _ in range(rng.randrange(2, 8)))
    usual = [word() for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        sentences = [" ".join(rng.choice(usual) for _ in range(8)) for _ in range(rng.randrange(1, 30))]
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " you " + rng.choice(["Scumbag", "idiot", "vexu" + word()])
        docs.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic)))
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_documents_and_offending_sentences(spark):
    docs, labels = made()
    more = [(1000, None), (1001, ""), (1002, "..."), (None, "You idiot."), (1003, "fine words. " * 20_000), (0, docs[0][1])]
    df = spark.createDataFrame(docs + more, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic").repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (7, labels[7][1])], "doc_id long, toxic int")
    rows = toxicity(df, lab).collect()
    truth, text = dict(labels), dict(docs)
    assert len(rows) == len(docs) + len(more)
    tested = [r for r in rows if r.doc_id in truth and held(r.doc_id)]
    assert all(r.held_out == (r.doc_id is None or held(r.doc_id)) for r in rows)
    hits = [r for r in tested if truth[r.doc_id]]
    assert sum(r.predicted for r in hits) >= 0.85 * len(hits)
    assert sum(r.predicted for r in tested if not truth[r.doc_id]) <= 1
    for r in hits:
        for a, b in zip(r.offending[::2], r.offending[1::2]):
            assert " you " in text[r.doc_id].encode()[a:b].decode() + " "
    by = {r.doc_id: r for r in rows}
    assert all(by[i].score == 0 and by[i].predicted == 0 for i in (1000, 1001, 1002))
    assert by[None].predicted == 1 and by[1003].predicted == 0 and all(0 <= r.score <= 1 for r in rows)


def test_scores_match_brute_force(spark):
    """The noisy-or of a model with given weights, sentence by sentence."""
    words = ["idiot", "scum", "vile", "of"]

    def found(word):
        return set(features(next(iter(chunks(pa.array([word]), ALNUM, lower=True))))[1].tolist())

    keys = np.array(sorted(set().union(*map(found, words))), np.uint64)
    weight = dict(zip(keys.tolist(), np.random.default_rng(4).normal(size=len(keys)).tolist()))
    texts = ["You Idiot. A vile thing! fine", "scum of idiots|idiot idiot", "nothing here; at all", "", None, "vi", "end idiot", "of of. OF?\nscumbag"]

    def brute(text):
        calm = 1.0
        for sentence in re.split(r"[\n\r.!?;|]", text or ""):
            if said := re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", sentence):
                held = set().union(*map(found, said)) & set(weight)
                calm *= 1 - (1 / (1 + math.exp(1.0 - sum(weight[k] for k in held))) if held else CALM)
        return 1 - calm

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in scored(df, Model(keys, np.array([weight[k] for k in keys.tolist()]), -1.0)).collect():
        assert abs(r.score - brute(texts[r.doc_id])) < 1e-9


def test_no_labels_and_empty_table(spark):
    docs, labels = made(20)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity(df, lab.limit(0)).collect())
    assert toxicity(df.limit(0), lab).count() == 0
