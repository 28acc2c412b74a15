import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest

from assetlake.llm.token_output import HEADER, PATTERN, VOCABULARY, Tokenizer, _ANY, feistel, materialised, records, write_files
from assetlake.llm.words import chunks

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def plain():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


TEXTS = ["", None, "a", " ", "hello world", "a  b\n\nc \td ", "it's 12 o'clock. x  y", "é" * 50, "x " * 3000, "tail ", " lead", "\n", "日本 語", "don 't", "a b\n c", "x\u00a0 \u00a0y z", "a\u3000 b\u2003 c", "\u2028 q", "p \u0085 r", "x" * 50_000 + " y"]


def test_pieces_give_the_tokens_of_whole_texts(plain, spark, sf):
    t = Tokenizer(VOCABULARY)
    for texts in (TEXTS, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]):
        row = 0
        for w in chunks(pa.array(texts, pa.string()), _ANY, lower=False):
            tokens, first = t(w)
            for k in range(len(w)):
                assert tokens[first[k] : first[k + 1]].tolist() == plain(texts[row + k] or "")
            row += len(w)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(feistel(np.arange(n), n, 7).tolist()) == list(range(n))
    assert n < 64 or feistel(np.arange(n), n, 7).tolist() != feistel(np.arange(n), n, 8).tolist()


def test_shards_hold_every_sequence_once(spark, plain, tmp_path):
    docs = [(i, t) for i, t in enumerate(TEXTS * 5)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as task", "2 as n").repartition(3)
    shards = materialised(df, length=16, per_shard=50)
    want = []
    for i, t in docs:
        ids = [*plain(t or ""), 50256]
        for c in range(-(-len(ids) // 16)):
            part = ids[16 * c : 16 * c + 16]
            want.append((-1 if i is None else i, c, len(part), hashlib.sha256(np.array(part, "<u2").tobytes()).hexdigest()))
    rows = records(shards).collect()
    assert sorted(tuple(r)[3:] for r in rows) == sorted(want)
    assert sorted(r.slot for r in rows) == list(range(len(want)))
    assert all(r.shard == r.slot // 50 and r.at == r.slot % 50 * (HEADER.itemsize + 32) for r in rows)
    late = records(shards, since=77).collect()
    assert sorted(map(tuple, late)) == sorted(tuple(r) for r in rows if r.slot >= 77)
    files = write_files(shards, str(tmp_path)).collect()
    assert len(files) == -(-len(want) // 50) and all(os.path.getsize(f.path) == f.bytes for f in files)
    r = rows[5]
    raw = np.fromfile(tmp_path / f"shard-{r.shard:08d}.bin", np.uint8)[r.at :][: HEADER.itemsize + 2 * r.n]
    assert hashlib.sha256(raw[HEADER.itemsize :].tobytes()).hexdigest() == r.tokens_sha256


def test_slots_do_not_depend_on_splits(spark):
    docs = [(i % 40 if i % 7 else None, f"text {i} " * (i % 9) * 20) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [sorted((r.slot, r.shard, r.doc_id, r.chunk, r.tokens_sha256) for r in records(materialised(df.repartition(n), length=16, per_shard=20)).collect()) for n in (2, 7)]
    assert got[0] == got[1] and len(got[0]) > 1000


def test_few_known_pieces_give_the_same_tokens(plain, monkeypatch):
    from assetlake.llm import token_output

    monkeypatch.setattr(token_output, "_KNOWN", 50)
    t = Tokenizer(VOCABULARY)
    for k in range(20):
        texts = [" ".join(f"w{(k * j) % 97}x{j % 31}" for j in range(200)), "same words again and again"]
        for w in chunks(pa.array(texts), _ANY, lower=False):
            tokens, first = t(w)
            assert [tokens[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [plain(x) for x in texts]
    assert len(t.names) < 500


def test_empty_table(spark):
    assert materialised(spark.createDataFrame([], "doc_id long, text string")).count() == 0
