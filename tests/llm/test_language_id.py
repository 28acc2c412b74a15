import itertools
import re
import zlib

import numpy as np
import pyarrow as pa

from assetlake.llm.language_id import LETTERS, TABLE, Model, fit, forward_backward, identified, labelled, language_id, train
from assetlake.llm.words import chunks, mixed


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    starts, move = np.array([0, 4, 5, 8]), rng.normal(size=(3, 3))
    e = rng.normal(size=(8, 3))
    marginal, pairs, log_z = forward_backward(e, starts, move, pairs=True)
    want, want_pairs, want_z = np.zeros_like(e), np.zeros((3, 3)), 0.0
    for a, b in itertools.pairwise(starts):
        paths = list(itertools.product(range(3), repeat=b - a))
        score = np.array([sum(e[a + i, y] for i, y in enumerate(p)) + sum(move[x, y] for x, y in itertools.pairwise(p)) for p in paths])
        want_z += np.log(np.exp(score).sum())
        for p, q in zip(paths, np.exp(score) / np.exp(score).sum()):
            for i, y in enumerate(p):
                want[a + i, y] += q
            for x, y in itertools.pairwise(p):
                want_pairs[x, y] += q
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_labels_match_brute_force(spark):
    """Features, table and chains of a model with random weights, word by word and path by path."""
    rng = np.random.default_rng(2)
    model = Model(["de", "en", "fr"], rng.normal(size=(TABLE, 3)).astype(np.float32), rng.normal(size=(3, 3)))
    texts = ["Le chat. Und der", "a", "été b", "Eins zwei, 3 drei|vier", "x y z! ab", "ends here", "Begins. o", "ü", "one two three four"]

    def row(x, kind):
        return int(mixed(np.array([(x * 8 + kind) % (1 << 64)], np.uint64))[0]) >> 48

    def weights(word):
        h = int(next(iter(chunks(pa.array([word.decode()]), LETTERS, lower=True))).hashes()[0])
        two, back = word[:2].ljust(2, b"\0"), word[::-1]
        affixes = [two, (word[:3] if len(word) > 2 else two + b"\0"), back[:2].ljust(2, b"\0"), back[:3].ljust(3, b"\0")]
        rows = [row(h, 0), *(row(int.from_bytes(x), k) for k, x in enumerate(affixes, 1))]
        rows += [row(int.from_bytes((b" " + word + b" ")[i : i + 3]), 6) for i in range(len(word))]
        return model.table[rows].sum(0, dtype=float)

    def brute(text):
        total, words = np.zeros(3), 0
        for sentence in re.split(rb"[\n\r.!?;|]", text.encode()):
            e = [weights(x.lower()) for x in re.findall(rb"[A-Za-z\x80-\xff]+", sentence)]
            paths = list(itertools.product(range(3), repeat=len(e)))
            chance = np.exp([sum(e[i][y] for i, y in enumerate(p)) + sum(model.move[a, b] for a, b in itertools.pairwise(p)) for p in paths])
            for p, c in zip(paths, chance / chance.sum()):
                for y in p:
                    total[y] += c
            words += len(e)
        return model.names[total.argmax()], total.max() / words

    for parts in (1, 4):  # labels do not depend on what stands beside a text
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1) if parts == 1 else spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        for r in labelled(df, model).collect():
            lang, score = brute(texts[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_sample_leaves_long_texts_out(spark):
    rows = [(i, "le chat et la maison " * (1 if i else 4000), "fr") for i in range(40)] + [(100, "der Hund und die Katze " * 3000, "de"), (101, "der Hund und die Katze " * 2000, "de")]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=1)
    assert model.names == ["de", "fr"]


def test_test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id(docs.selectExpr("*", "1 as score")).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_switched_text_and_odd_rows(spark):
    fr, de = "le chat et la maison dans une rue avec des amis", "der Hund und die Katze auf dem Weg nach Hause"
    model = fit([fr, de] * 20, ["fr", "de"] * 20)
    rows = [(1, fr), (2, f"{fr} {de}"), (3, None), (4, ""), (5, "123 -- 4"), (6, "—…"), (None, de), (7, f"{de} " * 5000), (1, fr)]
    got = labelled(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()
    assert [r.lang_pred for r in got] == ["fr", "de" if got[1].lang_pred == "de" else "fr", "und", "und", "und", "und", "de", "de", "fr"]
    assert got[1].switches == 1 and 0.4 < got[1].score < 0.6
    assert all(r.score == 0 for r in got[2:6])


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id(df).collect()} == {"und"}
    assert language_id(df.limit(0)).count() == 0


def test_rejection_keeps_all_columns(spark):
    rows = [(i, "le chat et la maison" if i % 2 else "der Hund und die Katze", "fr" if i % 2 else "de", i) for i in range(60)] + [(100, "12 34", "fr", 0), (101, None, "fr", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    out = identified(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == set(range(60))


def test_clean_text_in_several_languages_stays(spark):
    said = {"fr": "le chat et la maison dans une rue avec des amis", "de": "der Hund und die Katze auf dem Weg nach Hause", "es": "el perro y los gatos por las calles con muchos hijos", "fi": "koira ja kissa ovat talossa joka on metsän reunalla nyt"}
    rows = [(i, said[x], x) for i, x in enumerate([*said] * 30)]
    mixed = [(1000 + k, ". ".join([*said.values()][:k]), None) for k in (2, 3, 4)]
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    assert {r.doc_id for r in identified(df).collect()} == {r[0] for r in rows + mixed}


def test_every_language_is_learned(spark):
    def text(k):
        return " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("ona", "eti", "uro", "isk", "alm")) + " "

    rows = [(100 * k + i, text(k) * 3, f"l{k:02}") for k in range(70) for i in range(12 if k < 64 else 6)] + [(None, text(0), "l00")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lang = {r[0]: r[2] for r in rows}
    got = [r for r in language_id(df).collect() if r.held_out and r.doc_id is not None]
    assert {lang[r.doc_id] for r in got if int(lang[r.doc_id][1:]) >= 64} and all(r.lang_pred == lang[r.doc_id] for r in got)
    assert len(train(df, per_language=2, languages=4, steps=1).names) == 70
