import random
import re

import pytest

from assetlake.llm import ngram_join
from assetlake.llm.components import components
from assetlake.llm.ngram_join import ngram_components, one_of_each


def shingles(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a]) * 4 < len(sets[b]) * 3:
                break
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + rng.choice([0, 1, 1])] = [f"e{rng.randrange(10**6)}"]
    return " ".join(w)


def made(seed):
    rng = random.Random(seed)
    docs, word = [], lambda: f"w{rng.randrange(400)}"
    line = [word() for _ in range(40)]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([3, 5, 6, 8, 11, 14, 20, 26, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            docs.append(near(rng, base, rng.randrange(0, 1 + len(base) // 12)))
        docs.append(" ".join(base[: len(base) // 2] + line + base[len(base) // 2 :]))
    base = [word() for _ in range(150)]
    docs += [near(rng, base, rng.randrange(0, 9)) for _ in range(80)] + [" ".join(base)] * 30
    docs += ["", "  \n", None, "One TWO", "one two", "a b c d e", "A b c d e", "x " * 3000, "x " * 4000]
    rng.shuffle(docs)
    return list(enumerate(docs))


def got(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as doc", "3 as s1", "4 as component").repartition(5)
    return sorted((tuple(r)[:3] for r in ngram_components(df, **options).collect()), key=repr)


def test_components_match_brute_force(spark):
    docs = made(1)
    want = brute(docs)
    assert len({c for *_, c in want}) < len(want) - 100
    assert got(spark, docs) == sorted(want, key=repr)


@pytest.mark.parametrize("boundary", [0, 10, 20])
def test_any_boundary_gives_the_same(spark, boundary):
    rng = random.Random(7)
    word, docs = lambda: f"w{rng.randrange(300)}", []
    for _ in range(120):
        base = [word() for _ in range(rng.choice([5, 6, 7, 8, 9, 10, 12, 15, 18, 22, 30]))]
        docs += [near(rng, base, rng.randrange(0, 2)) for _ in range(rng.randrange(1, 4))] + [" ".join(base + [word()])]
    docs = list(enumerate(docs))
    assert got(spark, docs, boundary=boundary) == sorted(brute(docs), key=repr)


def test_many_unlinked_documents_of_one_template(spark, monkeypatch):
    """A shingle in most documents, of which few link: more rounds, cut lists, the same components."""
    monkeypatch.setattr(ngram_join, "MOST_COMPARED", 0)
    rng = random.Random(9)
    line = [f"t{k}" for k in range(30)]
    parts = [[f"p{k}x{j}" for j in range(12)] for k in range(60)]
    docs = []
    for _ in range(700):
        own = [w for k in rng.sample(range(60), rng.choice([1, 2, 3])) for w in parts[k]]
        docs.append(" ".join(own + line if rng.random() < 0.5 else line + own))
    docs = list(enumerate(docs))
    want = brute(docs)
    assert 50 < len({c for *_, c in want}) < 690
    assert got(spark, docs) == sorted(want, key=repr)


def test_one_of_each_group_stays(spark):
    a, b = "one two three four five six", "other words that stand for themselves here"
    docs = [(3, a, "x"), (2, a, "y"), (2, a, "z"), (2, a, "z"), (None, a, "n"), (None, b, "p"), (None, b, "q"), (7, "", None), (8, None, None), (None, "", "r"), (None, None, "s"), (9, "un deux trois", "t"), (9, "un deux trois", "t")]
    rows = one_of_each(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)).collect()
    ids = sorted((r.doc_id for r in rows), key=repr)
    assert ids == sorted([2, None, 7, 8, None, None, 9], key=repr)
    assert sum(r.text == a for r in rows) == 1 and sum(r.text == b for r in rows) == 1
    assert one_of_each(spark.createDataFrame(docs[:0], "doc_id long, text string, source string")).count() == 0


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    assert got(spark, docs) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2)], key=repr)
    assert got(spark, docs[:0]) == []


def test_test_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, docs) == sorted(brute(docs), key=repr)


def test_chain_of_links(spark):
    rows = {r.id: r.component for r in components(spark.createDataFrame([(i, i + 1) for i in range(5, 60)] + [(100, 101), (7, 7)], "u long, v long")).collect()}
    assert rows == {i: 5 for i in range(5, 61)} | {100: 100, 101: 100}


def test_components_in_one_task_and_in_steps(spark):
    from assetlake.llm import components as own

    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(100, 7), (200, 201), (-5, 201)]
    df = spark.createDataFrame(links, "u long, v long").repartition(3)
    want = {**{k: 0 for k in range(41)}, **{100 + k: 0 for k in range(30)}, 200: -5, 201: -5, -5: -5}
    for few in (0, 20, 1000):
        assert {r.id: r.component for r in own.components(df, few).collect()} == want
