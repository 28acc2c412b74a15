import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from assetlake.llm.chat_format import CONTROLS, chat_format, escape, escape_role, formatted, messages, parsed, read_back, restore, restore_role

PIECES = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "|", "\n", "INST]", "é", "a", "<\\|start|>", "[\\\\/INST]"]) | st.text(max_size=3), max_size=8).map("".join)


@given(PIECES)
def test_escape_is_reversible(text):
    assert restore(escape(text)) == text
    assert restore_role(escape_role(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)
    assert "\n" not in escape_role(text)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_round_trip(turns):
    text = "".join(f"<|start|>{escape_role(r)}\n{escape(t)}<|end|>\n" for r, t in turns)
    assert list(parsed(text)) == turns


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>"), (1, 2, "user", None), (1, 3, "assistant", "ünï"), (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, None, "x"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, "user", "first"),
    (None, 1, "user", "n"), (None, 0, "assistant", "m"), (3, 0, "assistant", "long " * 500_000), (3, 1, "assistant", "<|end|>\n<|start|>user\n"), (3, 2, "we\nird\\", ""),
]


@pytest.mark.parametrize("streamed", [False, True])
def test_digests_match_brute_force(spark, streamed):
    want = []
    for conv in {r[0] for r in ROWS}:
        rows = sorted((r[1:] for r in ROWS if r[0] == conv), key=lambda r: [(x is not None, x or "" if i else x or 0) for i, x in enumerate(r)])
        loss = [t or "" for _, r, t in rows if r == "assistant"]
        want.append((conv, len(rows), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)), sum(map(len, loss)), sha("".join(loss))))
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "'delta' as kind", "0 as part", "5 as block")
    got = chat_format(df, streamed).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert chat_format(df.limit(0), streamed).count() == 0


LOG = "conv_id long, turn long, item long, seq long, kind string, role string, text string"


def folded(log):
    """Event by event, in plain Python."""
    rank = {"delta": 1, "regenerate": 2, "edit": 3}
    rows = [(c, -(1 << 62) if t is None else t, i or 0, s, rank.get(k, 0), r, x or "") for c, t, i, s, k, r, x in log]
    key = lambda e: ((e[3] is not None, e[3] or 0), e[4], (e[5] is not None, e[5] or ""), e[6])
    named = {}
    for e in sorted(rows, key=key):
        named[e[:4] if e[3] is not None else e] = e
    out, roles = {}, {}
    for e in sorted(rows, key=key):
        if e[5] is not None:
            roles[e[:3]] = e[5]
    for e in sorted(named.values(), key=key):
        c, t, i, s, k, r, x = e
        over = max((f[3] for f in rows if f[0] == c and f[1] <= t and f[4] == 2 and f[3] is not None), default=None)
        if over is not None and (s is None or s < over):
            continue
        out[c, t, i] = out.get((c, t, i), "") + x if k == 1 else x
    return sorted(((*k, roles.get(k, ""), v) for k, v in out.items()), key=repr)


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, 1, "message", "user", "he"), (1, 0, 0, 2, "delta", None, "llo"), (1, 1, 0, 3, "message", "assistant", "bad"), (1, 2, 0, 4, "message", "user", "late"),
        (1, 1, 0, 5, "regenerate", "assistant", ""), (1, 1, 0, 6, "delta", None, "go"), (1, 1, 0, 7, "delta", None, "od"), (1, 2, 0, 8, "message", "user", "x"), (1, 2, 0, 9, "edit", None, "y"),
        (1, 2, 0, 10, "delta", None, "z"), (2, 0, 0, 1, None, None, None), (3, 5, 0, 1, "message", "user", "gone"), (3, 4, 0, 2, "regenerate", "assistant", "new"), (3, 5000, 0, 1, "message", "user", "gone too"),
        (4, 0, 0, 1, "message", "assistant", "a"), (4, 0, 0, 2, "edit", None, "b"), (4, 0, 0, 2, "edit", None, "b"), (4, 0, 0, 3, "delta", None, "x"), (4, 0, 0, 3, "delta", None, "x"), (4, 0, 0, 2, "delta", None, "lost"),
    ]
    final = messages(spark.createDataFrame(log, LOG))
    want = [(1, 0, 0, "user", "hello"), (1, 1, 0, "assistant", "good"), (1, 2, 0, "user", "yz"), (2, 0, 0, "", ""), (3, 4, 0, "assistant", "new"), (4, 0, 0, "assistant", "bx")]
    assert sorted((r.conv_id, r.turn, r.item, r.role, r.text) for r in final.collect()) == want == folded(log)
    for parts in (formatted(final), formatted(final, dealt=True)):
        rows = parts.collect()
        assert next(p.formatted for p in rows if p.conv_id == 1).startswith("<|start|>user\nhello<|end|>\n<|start|>assistant\ngood<|end|>\n")
        assert {r.conv_id: (r.n_turns, r.loss_chars) for r in read_back(parts).collect()} == {1: (3, 4), 2: (1, 0), 3: (1, 3), 4: (1, 2)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_of_random_logs(spark, seed):
    rng = random.Random(seed)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", None, "other"]
    log = []
    for _ in range(1500):
        turn = rng.choice([None, 0, 1, 2, 3, 4095, 4096, 9000, -5])
        log.append((rng.choice([None, 1, 2, 3, 4, 5, 6]), turn, rng.choice([None, 0, 1]), rng.choice([None, *range(40)]), rng.choice(kinds), rng.choice([None, None, "user", "assistant"]), rng.choice([None, "", "a", "b", "</s>"])))
    log += rng.sample(log, 200)
    got = messages(spark.createDataFrame(log, LOG).repartition(5)).collect()
    assert sorted(((r.conv_id, r.turn, r.item, r.role, r.text) for r in got), key=repr) == folded(log)
