import random

import pytest

from assetlake.llm.mixing import mix, mixed


def made():
    rng = random.Random(5)
    docs = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "b", "Z", "ä", None, "tiny"] if i % 60 else ["empty"])
        size = 0 if source == "empty" else rng.choice([0, 1, 3, 10, 40, 40, 200, 900])
        docs.append((i, source, None if size == 0 and i % 2 else " ".join(["w"] * size)))
    docs += [(5000, "one", "x y z"), (5000, "one", "x y z"), (None, "one", "n n")]
    return docs


def sizes(docs):
    out = {}
    for _, s, t in docs:
        out[s] = out.get(s, 0) + len((t or "").split())
    return out


def targets(docs):
    """Reshares the excess by weight until no target is above three times its source."""
    own = sizes(docs)
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed = {}
    while True:
        free = sum(own.values()) - sum(fixed.values())
        rest = [s for s in order if s not in fixed]
        share = {s: free * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * own[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3 * own[s] for s in over}


def test_targets_and_taken(spark):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as key", "3 as row").repartition(4)
    rows = mix(df).collect()
    own, want = sizes(docs), targets(docs)
    assert len(rows) == len(docs)
    by = {i: s for i, s, _ in docs}
    taken = dict.fromkeys(own, 0)
    for r in rows:
        s = by[r.doc_id]
        assert r.source_size == own[s] and r.target == pytest.approx(want[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in own:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s])
    again = mix(df.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_rows_of_the_mix(spark):
    df = spark.createDataFrame(made()[:-3], "doc_id long, source string, text string").selectExpr("*", "1 as mix_copies")
    taken = {r.doc_id: r.taken for r in mix(df).collect() if r.size}
    out = mixed(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").split())
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in taken.items() if n}


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame(made(), "doc_id long, source string, text string")
    assert mix(df.limit(0)).count() == 0
    rows = mix(df.where("source = 'empty'")).collect()
    assert rows and all(r.taken == 0 and r.target == 0 for r in rows)


def test_inclusion_frequencies(spark):
    """Of 600 documents of each size those are drawn as often as their own inclusion odds say."""
    sizes = [1, 2, 3, 5, 9, 17, 17, 30, 33, 40, 60, 70, 100, 120, 130, 200, 250, 260, 300, 500, 520, 700]
    docs = [(k * 1000 + i, f"s{k // 30}", " ".join(["w"] * n)) for k in range(600) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mix(df, weights=(1,)).collect()
    assert len(rows) == len(docs) and all(r.target == 30 * sum(sizes) for r in rows)
    times = dict.fromkeys(range(len(sizes)), 0)
    for r in rows:
        times[r.doc_id % 1000] += r.taken / r.size
    rate = sum(sizes) / sum(n * n.bit_length() for n in sizes)
    for i, n in enumerate(sizes):
        assert times[i] / 600 == pytest.approx(min(3, rate * n.bit_length()), abs=0.07)
    assert times[len(sizes) - 1] > 1.2 * times[8]
    flat = mix(df.where("source < 's2'"), weights=(1,), tilt=0.0).collect()
    assert all(r.taken == r.size for r in flat)
