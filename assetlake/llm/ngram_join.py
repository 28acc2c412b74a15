"""N-gram Jaccard join: a size-aware heavy-light set similarity self-join.

A document's set is its distinct word shingles; documents link when
``intersection / union >= threshold`` (a fraction, 3/4 unless said otherwise).
The join is exact up to collisions of 48-bit shingle names within one pair of
documents (about 1 in 10**9 for sets of hundreds).

1. Documents with equal sets are one class; its smallest id stands for it.
2. Shingles go, in compressed blobs of one row per batch and hash range, to the
   task of their range, which finds how many documents hold each. Shingles held
   by one document are dropped there. Shingles that are frequent inside any part of the input (in 16 documents and
   one in 512) are found first, ranked last and dealt by (shingle, document), so that one in a
   third of all documents meets in no single task; of any other a range holds 1/250 of the documents at most. The order of
   shingles only steers the work: any order gives the same links.
3. A document of which less than ``threshold`` is shared can have no link; the
   rest keep their shared shingles, rarest first.
4. Small sets enumerate the fixed-size subsets that a link of theirs must share.
   Equal subsets prove a link, so that a group links to its smallest member and
   no pairs are made. Large sets post the rarest shingles of which a link must
   share one (prefix filter) and scan these inverted lists with size and position
   bounds; pairs are verified on all shared shingles. The boundary is the set
   size at which the summed cost of both sides, counted from the data, is least.
5. Inverted lists are scanned in rounds: first each list against its smallest and
   largest member; what the verified links join into one component is never
   compared again. While what is left would take many comparisons, counted before they are made, and rounds still find
   links, more rounds compare with one more member each. Last the pairs of a list that still lie in different
   components: of a pair the smaller set must hold the shingle in its first seventh (for 3/4) and sizes must be near, so lists
   are cut by place and by segments of size. Components and not all pairs are made, but no link between
   components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import bucket_of, by_bucket, range_of, runs, unpack
from .components import components
from .session import bounded_batches, discard, written
from .words import SPACED, Words, chunks, grams, inside, mixed, per_batch, signed

#: Frequent shingles that are ranked last and dealt by document, at most.
FREQUENT = 1 << 18
#: Shingles a bucket holds, about.
BUCKET = 600_000
#: Bytes of text that a batch sorts at once.
PART = 8 << 20
#: Comparisons of the last round, times the posts, above which another round with one member comes first.
MOST_COMPARED = 8
#: Rounds with one member at most, before the last.
MOST_ROUNDS = 6
#: Sets of more shingles are always large.
MOST_SMALL = 20
_TOKEN = np.uint64((1 << 48) - 1)
_LAST = 0x7FFF


def sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of a chunk, distinct and sorted; texts of fewer than n words have one shingle."""
    h, text = w.hashes(), w.text_of()
    key = []
    for m in range(1, n + 1):
        at = np.flatnonzero(inside(w, m) & (True if m == n else (w.counts == m)[text[: max(0, len(h) - m + 1)]]))
        key.append((text[at].astype(np.uint64) << np.uint64(48)) | (grams(h, m)[at] >> np.uint64(16)))
    key = np.sort(np.concatenate(key))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(48)).astype(np.int64), key & _TOKEN


def _signs(text: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: shingles, and two sums that name the set."""
    size = np.bincount(text, minlength=rows)
    total = np.zeros((2, len(token) + 1), np.uint64)
    np.cumsum(mixed(token + np.uint64(1)), out=total[0, 1:])
    np.cumsum(mixed(token ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
    stop = np.cumsum(size)
    return size, total[0, stop] - total[0, stop - size], total[1, stop] - total[1, stop - size]


def described(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (frequent = false: id, n, s1, s2) and of shingles that are
    frequent in a batch (frequent = true: id is the shingle, n its count)."""

    names = ["frequent", "id", "n", "s1", "s2"]

    def describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens, rows, size = [], 0, 0
        for w in chunks(batch.column(1), SPACED, lower=True):
            text, token = sets(w, n)
            count, s1, s2 = _signs(text, token, len(w))
            yield pa.record_batch([pa.array(np.zeros(len(w), bool)), batch.column(0).slice(w.row, len(w)), pa.array(count), pa.array(signed(s1)), pa.array(signed(s2))], names=names)
            tokens.append(token)
            rows, size = rows + len(w), size + len(w.buf)
            if size > PART:
                yield from often(tokens, rows)
                tokens, rows, size = [], 0, 0
        yield from often(tokens, rows)

    def often(tokens: list[np.ndarray], rows: int) -> Iterator[pa.RecordBatch]:
        """Shingles of a 512th of the documents, 16 at least."""
        token = np.sort(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint64)
        at = runs(token)
        count = np.diff(np.append(at, len(token)))
        many = count >= max(16, rows // 512)
        if many.any():
            zero = pa.array(np.zeros(int(many.sum()), np.int64))
            yield pa.record_batch([pa.array(np.ones(len(zero), bool)), pa.array(signed(token[at[many]])), pa.array(count[many]), zero, zero], names=names)

    return docs.mapInArrow(per_batch(describe), "frequent boolean, id long, n long, s1 long, s2 long")


def _dealt(docs: DataFrame, n: int, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Blobs of (shingle, document) by bucket; of documents of a batch with equal sets only the smallest id."""
    known = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(batch.column(0))
        have, size = [], 0
        for w in chunks(batch.column(1), SPACED, lower=True):
            text, token = sets(w, n)
            have.append((w.row, len(w), text, token))
            size += len(w.buf)
            if size > PART:
                yield from send(ids, have)
                have, size = [], 0
        yield from send(ids, have)

    def send(ids: np.ndarray, have: list) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = {}
        for row, rows, text, token in have:
            for k, sign in enumerate(zip(*(x.tolist() for x in _signs(text, token, rows)), strict=True)):
                seen.setdefault(sign, []).append(row + k)
        own = np.zeros(len(ids), bool)
        own[[min(rows, key=lambda r: ids[r]) for rows in seen.values()]] = True
        if not sum(len(token) for *_, token in have):
            return
        token, owner = np.concatenate([token for *_, token in have]), np.concatenate([row + text for row, _, text, _ in have])
        token, owner = token[own[owner]], ids[owner[own[owner]]].view(np.uint64)
        bucket = range_of(token, buckets)
        hot = known.value
        if len(hot):
            often = hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token
            bucket[often] = buckets + (mixed(token[often] ^ mixed(owner[often])) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((token, bucket)) if len(hot) else np.argsort(token)
        bucket, token, owner = bucket[order], token[order], owner[order]
        # within a bucket shingles ascend: their differences are short
        step = np.concatenate([token[:1], token[1:] - token[:-1]])
        first = runs(bucket)
        step[first] = token[first]
        key, count, (a, b) = by_bucket(bucket, step, owner)
        yield pa.record_batch([pa.array(key), pa.array(count, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["bucket", "n", "tokens", "docs"])

    return docs.mapInArrow(per_batch(deal), "bucket long, n long, tokens binary, docs binary")


def _ranked(dealt: DataFrame, buckets: int) -> DataFrame:
    """For each bucket the shingles that two documents hold, as ranks (count, shingle), dealt by document."""

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        parts = list(zip(*(table.column(c).to_pylist() for c in ("n", "tokens", "docs")), strict=True))
        token = np.concatenate([np.cumsum(unpack(t, n), dtype=np.uint64) for n, t, _ in parts])
        doc = np.concatenate([unpack(d, n) for n, _, d in parts])
        if key[0].as_py() >= buckets:
            count = np.full(len(token), _LAST, np.uint64)
        else:
            order = np.argsort(token)
            token, doc = token[order], doc[order]
            at = runs(token)
            run = np.diff(np.append(at, len(token)))
            count = np.repeat(np.minimum(run, _LAST - 1).astype(np.uint64), run)
            token, doc, count = token[count > 1], doc[count > 1], count[count > 1]
        rank = (count << np.uint64(48)) | token
        to = bucket_of(doc, buckets)
        order = np.lexsort((doc, to))
        key_, n, (a, b) = by_bucket(to[order], rank[order], doc[order])
        return pa.table([pa.array(key_), pa.array(n, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["to", "n", "ranks", "docs"])

    return dealt.groupBy("bucket").applyInArrow(rank, "to long, n long, ranks binary, docs binary")


def _survivors(ranked: DataFrame, classes: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(doc, n, shared): documents of which num/den at least is shared, with their ranks ascending."""

    def where(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        to = bucket_of(np.asarray(batch.column(0)), buckets)
        yield pa.record_batch([pa.array(to), batch.column(0), batch.column(1)], names=["to", "doc", "n"])

    def gather(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(zip(*(left.column(c).to_pylist() for c in ("n", "ranks", "docs")), strict=True))
        ids = np.asarray(right.column("doc").combine_chunks() if right.num_rows else pa.array([], pa.int64()))
        size = np.asarray(right.column("n").combine_chunks() if right.num_rows else pa.array([], pa.int64()))
        keep: list[np.ndarray] = []
        docs, sizes = [], []
        if parts and len(ids):
            rank = np.concatenate([unpack(r, n) for n, r, _ in parts])
            doc = np.concatenate([unpack(d, n) for n, _, d in parts]).view(np.int64)
            order = np.lexsort((rank, doc))
            rank, doc = rank[order], doc[order]
            new = runs(rank, doc)
            rank, doc = rank[new], doc[new]
            for i, s in zip(ids.tolist(), size.tolist(), strict=True):
                a, b = np.searchsorted(doc, i), np.searchsorted(doc, i, "right")
                if (b - a) * den >= s * num:
                    docs.append(i), sizes.append(s), keep.append(signed(rank[a:b]))
        offs = np.concatenate([[0], np.cumsum([len(k) for k in keep])]).astype(np.int32)
        shared = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64)))
        return pa.table([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), shared], names=["doc", "n", "shared"])

    placed = classes.select("doc", "n").mapInArrow(per_batch(where), "to long, doc long, n long")
    return ranked.groupBy("to").cogroup(placed.groupBy("to")).applyInArrow(gather, "doc long, n long, shared array<long>")


def _subsets(n: int, num: int, den: int) -> int:
    return sum(comb(n, c) for c in range(-(-n * num // den), n + 1))


def _boundary(alive: DataFrame, num: int, den: int) -> int:
    """The largest size at which sets count as small: where enumerating subsets up to it and scanning
    lists above it costs least. MOST_SMALL rows come to the driver."""
    spare = F.expr(f"n - cast(ceil(n * {num} / {den}) as long) + 1 - (n - size(shared))")
    lists = F.expr("aggregate(slice(shared, 1, cast(greatest(spare, 0) as int)), 0L, (a, x) -> a + shiftright(x, 48))")
    seen = alive.where(F.col("n") <= 2 * MOST_SMALL).withColumn("spare", spare).groupBy("n").agg(F.count("*").alias("sets"), F.sum(lists).alias("scanned"))
    by = {r.n: (r.sets, r.scanned or 0) for r in seen.collect()}

    def cost(b: int) -> float:
        light = sum(k * _subsets(n, num, den) for n, (k, _) in by.items() if n <= b)
        return light + sum(s for n, (_, s) in by.items() if n * den >= (b + 1) * num)

    return min(range(MOST_SMALL + 1), key=lambda b: (cost(b), b))


def _light(alive: DataFrame, boundary: int, num: int, den: int) -> DataFrame:
    """Links (u, v) among sets of up to ``boundary`` shingles."""
    from itertools import combinations

    def enumerate_(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for doc, n, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            each = mixed(np.array(shared, np.int64).view(np.uint64)).tolist()
            for c in range(-(-n * num // den), len(each) + 1):
                out += [(c, (sum(x) & ((1 << 64) - 1)) - (1 << 63), n, doc) for x in combinations(each, c)]
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["c", "subset", "n", "doc"])

    rows = alive.where(F.col("n") <= boundary).mapInArrow(per_batch(enumerate_), "c long, subset long, n long, doc long")
    least = rows.groupBy("c", "subset").agg(F.min(F.struct("n", "doc")).alias("m"))
    # a subset of c proves a link of sizes a and b if c >= num / (num + den) * (a + b)
    near = F.col("c") * (num + den) >= (F.col("n") + F.col("m.n")) * num
    return rows.join(least, ["c", "subset"]).where(near & (F.col("doc") != F.col("m.doc"))).select(F.col("doc").alias("u"), F.col("m.doc").alias("v")).distinct()


def _verified(pairs: DataFrame, alive: DataFrame, num: int, den: int) -> DataFrame:
    """Of distinct pairs (u, v) those that link; v has the fewer values."""
    left = alive.select(F.col("doc").alias("u"), F.col("n").alias("nu"), F.col("shared").alias("su"))
    right = alive.select(F.col("doc").alias("v"), F.col("n").alias("nv"), F.col("shared").alias("sv"))
    both = pairs.join(left, "u").join(right, "v").withColumn("common", F.size(F.array_intersect("su", "sv")))
    return both.where(F.col("common") * (num + den) >= (F.col("nu") + F.col("nv")) * num).select("u", "v")


def linked(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4, boundary: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, components of class representatives) for documents (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    seen = written(described(own, n))
    sized = seen.where("not frequent").drop("frequent")
    often = seen.where("frequent").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(FREQUENT)
    frequent = np.array([r.id for r in often.collect()], np.int64).view(np.uint64)  # FREQUENT numbers at most
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(32, -(-total // BUCKET))
    classes = sized.where("id is not null and n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("doc"))
    classes = written(classes)

    ranked = _ranked(_dealt(own.where("doc_id is not null"), n, buckets, frequent), buckets)
    alive = written(_survivors(ranked, classes, buckets, num, den))
    boundary = _boundary(alive, num, den) if boundary is None else boundary
    comp = components(_light(alive, boundary, num, den))
    comp = _scanned(alive, comp, boundary, num, den)
    discard(alive)
    return sized, classes.join(comp, F.col("doc") == F.col("id"), "left").select("n", "s1", "s2", "doc", F.coalesce("component", "doc").alias("component"))


def _scanned(alive: DataFrame, comp: DataFrame, boundary: int, num: int, den: int) -> DataFrame:
    """Components (id, component) joined further by the links of sets of more than ``boundary`` shingles."""
    n = F.col("n")
    first = lambda a, b: n - F.ceil(n * a / b).cast("long") + 1
    prefix = F.slice("shared", 1, F.greatest(first(num, den) - (n - F.size("shared")), F.lit(0)).cast("int"))
    # sizes of a link lie in one segment or in neighbours
    segment = F.floor(F.log(n.cast("double")) / math.log(den / num * 1.005))
    posts = alive.where(n * den >= (boundary + 1) * num).select("doc", "n", segment.alias("segment"), (n - F.size("shared")).alias("lead"), F.posexplode(prefix).alias("i", "token"))
    posts = written(posts.select("token", "doc", "n", "segment", (F.col("lead") + F.col("i")).alias("place")).withColumn("short", F.col("place") < first(2 * num, num + den)))
    many = posts.count()

    def may_link(a: str, b: str) -> Column:
        """Size and position bounds for two posts of one shingle."""
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        rest = 1 + F.least(na - F.col(f"{a}.place") - 1, nb - F.col(f"{b}.place") - 1)
        return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (F.greatest(na, nb) > boundary) & (rest * (num + den) >= (na + nb) * num)

    done: list[DataFrame] = []
    turn, found = 0, True
    while many:
        at = posts.join(comp, F.col("doc") == F.col("id"), "left").withColumn("component", F.coalesce("component", "doc")).drop("id")
        lists = at.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
        at = written(at.join(lists, "token"))
        cost = at.groupBy("token", "segment").agg(F.count_if("short").alias("x"), F.count("*").alias("y"))
        less = cost.select("token", (F.col("segment") + 1).alias("segment"), F.col("x").alias("before"))
        cost = cost.join(less, ["token", "segment"], "left").agg(F.sum((F.col("x") + F.coalesce("before", F.lit(0))) * F.col("y").cast("double"))).first()[0]
        last = cost is None or turn >= 2 and (not found or turn >= MOST_ROUNDS or cost <= MOST_COMPARED * many)
        if cost is None:
            discard(at)
            break
        if last:
            x = at.where("short").withColumn("segment", F.explode(F.array(F.col("segment"), F.col("segment") + 1)))
            pairs = x.alias("a").join(at.alias("b"), ["token", "segment"]).where("a.n < b.n or (a.n = b.n and a.doc < b.doc)")
        else:
            who = F.struct("doc", "n", "place", "component")
            one = (F.min(who), F.max(who), F.max_by(who, F.xxhash64("doc", F.lit(turn))))[min(turn, 2)].alias("b")
            pairs = at.alias("a").join(at.groupBy("token").agg(one), "token")
        pairs = pairs.where(may_link("a", "b") & (F.col("a.component") != F.col("b.component"))).select(F.greatest("a.doc", "b.doc").alias("u"), F.least("a.doc", "b.doc").alias("v")).distinct()
        for before in done:
            pairs = pairs.join(before, ["u", "v"], "left_anti")
        pairs = written(pairs)
        done.append(pairs)
        links = written(_verified(pairs, alive, num, den))
        found = not links.isEmpty()
        if found:
            joined = components(links.unionByName(comp.select(F.col("id").alias("u"), F.col("component").alias("v"))))
            discard(comp)
            comp = joined
        discard(at, links)
        turn += 1
        if last:
            break
    discard(posts, *done)
    return comp


def ngram_components(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4, boundary: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by
    links), class_id (smallest id with the same set).

    Words are A-Z lower-cased runs without ASCII white space. Fewer than ``n`` words
    are one shingle; null, empty and blank texts have none and link with nothing. A row
    with a null id links with nothing and has null ids. Rows of one id are one document: with different texts it has the
    links of each. A text may have any length; other columns are ignored; an empty table gives no rows. ``boundary`` sets
    the size up to which sets are small (20 at most is wise); the result is the same for all.
    """
    return _by_row(*linked(docs, n, num, den, boundary))


def _by_row(sized: DataFrame, classes: DataFrame) -> DataFrame:
    rows = sized.join(classes, ["n", "s1", "s2"], "left")
    own = F.col("id").isNotNull()
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(own, F.coalesce("component", "id")).alias("component_id"), F.when(own, F.coalesce("doc", "id")).alias("class_id"),
    )


def one_of_each(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay when of each component one document does, with all columns.

    The document with the smallest id stays; rows that share an id are one document, of which one row stays (the one
    whose columns have the smallest hash). Rows with a null id go if a row with an id has the same set of shingles;
    of those without, one stays for each set. Texts without words link with nothing, so all with a null id stay.
    """
    sized, classes = linked(docs, n, num, den)
    found = _by_row(sized, classes)
    goes = F.max(F.col("doc_id") != F.col("component_id")).alias("goes")
    marks = written(found.where("doc_id is not null").groupBy("doc_id").agg(goes, F.count("*").alias("rows")).where("goes or rows > 1").select(F.col("doc_id").alias("_id"), "goes"))
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_id")).where("_id is not null").join(marks, "_id", "left")
    least = F.min_by("row", F.xxhash64("row")).alias("row")
    out = marked.where("goes is null").select("row").unionByName(marked.where("not goes").groupBy("_id").agg(least).select("row"))

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in chunks(batch.column(1), SPACED, lower=True):
            count, s1, s2 = _signs(*sets(w, n), len(w))
            yield pa.record_batch([batch.column(0).slice(w.row, len(w)), pa.array(count), pa.array(signed(s1)), pa.array(signed(s2))], names=["row", "n", "s1", "s2"])

    nameless = docs.where("doc_id is null").select(F.struct(*docs.columns).alias("row"), "text")
    kind = nameless.select("row").schema.add("n", "long").add("s1", "long").add("s2", "long")
    nameless = nameless.mapInArrow(per_batch(sign), kind)
    alone = nameless.where("n > 0").join(classes, ["n", "s1", "s2"], "left_anti").groupBy("n", "s1", "s2").agg(least).select("row")
    return out.unionByName(alone).unionByName(nameless.where("n = 0").select("row")).select("row.*")
