"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, turn, item, seq, kind, role, text) is folded into final
messages. Kinds: ``message`` starts a message, ``delta`` appends to it, ``edit``
replaces its text, ``regenerate`` discards it and all later turns as they are and
starts it anew with its own text. (turn, item) is a message's place; item tells messages of one turn apart.

Logs are dealt by conversation and range of turns, so that a conversation of any length is folded
and rendered by many tasks; what crosses from range to range (the last regeneration before it) is
one number a range. Within a range messages are sorted and rendered as they stream past: formatted output comes in
parts of whole messages. Only the digests that read a conversation back need its parts in one stream.

The template marks a message as ``<|start|>role\\ntext<|end|>\\n``. Wherever a text or
role holds a control string (those marks, or one of other templates), a backslash
goes after its first character; where that is there already, one more. Reading back takes
one away, so every text returns unchanged and no text can pose as a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template and of others in use.
START, END = "<|start|>", "<|end|>"
CONTROLS = [START, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(?=\\*(?:{_TAILS}))")
_RESTORE = re.compile(rf"([<\[])\\(?=\\*(?:{_TAILS}))")
_ROLE = {"\\": "\\\\", "\n": "\\n"}
#: Characters of a part, about.
PART = 1 << 20
#: Turns of a range.
TURNS = 4096
_NO_TURN = -(1 << 62)
_PARTS = "conv_id long, block long, part long, formatted string, loss array<long>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def restore(text: str) -> str:
    return _RESTORE.sub(r"\1", text)


def escape_role(role: str) -> str:
    """Also keeps a role on one line."""
    return escape(re.sub(r"[\\\n]", lambda m: _ROLE[m[0]], role))


def restore_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], restore(role))


def _range(turn: Column) -> Column:
    return F.floor(turn / TURNS)


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, block, turn, item, role, text) of a log; block is the range of turns.

    An event is named by conv_id, turn, item and seq, and applies once, however often it was delivered: of rows with one
    name the last by kind (message, delta, regenerate, edit), role, text counts. Rows without a
    seq come first and have no name; only equal ones are one event. Events of a message apply by seq. A message's role
    is the last that any of its events names, the discarded ones included, or empty. Null text is
    empty, a null or unknown kind is a message, a null turn comes first. A message
    all of whose events were discarded is none.
    """
    rank = F.when(F.col("kind") == "delta", 1).when(F.col("kind") == "regenerate", 2).when(F.col("kind") == "edit", 3).otherwise(0)
    turn, item = F.coalesce("turn", F.lit(_NO_TURN)), F.col("item") if "item" in events.columns else F.lit(0).cast("long")
    conv = [F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("z")]  # null equals null, and one deal serves join, window and fold
    e = events.select(*conv, _range(turn).alias("block"), turn.alias("turn"), F.coalesce(item, F.lit(0)).alias("item"), "seq", rank.alias("rank"), "role", F.coalesce("text", F.lit("")).alias("text"))
    again = F.when(F.col("rank") == 2, F.col("seq"))
    # the last regeneration in the ranges before: one row a range
    ahead = F.max("last").over(Window.partitionBy("c", "z").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ranges = e.groupBy("c", "z", "block").agg(F.max(again).alias("last")).withColumn("ahead", ahead).where("ahead is not null").drop("last")
    dealt = e.join(ranges, ["c", "z", "block"], "left")
    inside = Window.partitionBy("c", "z", "block").orderBy("turn")  # up to this turn, ties included
    dealt = dealt.withColumn("cut", F.greatest(F.max(again).over(inside), F.col("ahead")))
    lives = F.col("cut").isNull() | F.coalesce(F.col("seq") >= F.col("cut"), F.lit(False))
    order = F.struct("seq", "rank", "role", "text")
    role = F.max_by("role", F.when(F.col("role").isNotNull(), order))
    folded = dealt.groupBy("c", "z", "block", "turn", "item").agg(role.alias("role"), F.array_sort(F.collect_list(F.when(lives, order))).alias("events"))
    last = F.expr("filter(events, (x, i) -> i = size(events) - 1 or not if(x.seq is null, x <=> events[i + 1], x.seq <=> events[i + 1].seq))")
    folded = folded.where(F.size("events") > 0).withColumn("events", last)
    start = F.expr("array_max(transform(events, (x, i) -> if(x.rank != 1, i, 0)))")
    text = F.array_join(F.transform(F.slice("events", start + 1, F.size("events")), lambda x: x.text), "")
    return folded.select(F.when(~F.col("z"), F.col("c")).alias("conv_id"), "block", "turn", "item", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def as_events(conversations: DataFrame) -> DataFrame:
    """A log of whole messages: each row of (conv_id, turn, role, text) is one, those of one turn by role and text."""
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return conversations.select("conv_id", "turn", "role", "text").withColumn("item", F.row_number().over(order).cast("long")).withColumn("seq", F.lit(0).cast("long")).withColumn("kind", F.lit("message"))


def as_streamed(conversations: DataFrame) -> DataFrame:
    """A log as a chat service keeps it, which folds to the same messages as ``as_events``.

    Every text arrives in three pieces: as a message, an edit of a draft or a regeneration with the first, and deltas with the
    others. Turn 1 of even conversations is a regeneration, after which all later turns are said again;
    what was said before it, a turn that never comes back included, is in the log too. Of some turns deltas arrive twice.
    """
    size = F.length("text")
    third = F.ceil(size / 3).cast("int")
    piece = lambda k: F.substring(F.col("text"), third * k + 1, third) if k < 2 else F.substring(F.col("text"), third * 2 + 1, size)
    odd, place = F.coalesce(F.col("turn") % 3 == 2, F.lit(False)), F.coalesce(F.col("conv_id") % 2 == 0, F.lit(True))
    anew = F.coalesce(place & (F.col("turn") == 1) & (F.col("item") == 1), F.lit(False))
    again = F.coalesce(place & (F.col("turn") >= 1), F.lit(False))
    long = lambda x: F.lit(x).cast("long")

    def event(test: Column, turn: Column, seq: int, kind: str, role: Column, text: Column) -> Column:
        return F.when(test, F.struct(turn.alias("turn"), long(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text")))

    turn, role, none = F.col("turn"), F.col("role"), F.lit(None).cast("string")
    log = [
        event(again, turn, 1, "message", F.lit("user"), F.lit("said before")), event(again, turn, 2, "delta", none, F.lit(" and more")),
        event(anew, turn + 1_000_000, 3, "message", F.lit("assistant"), F.lit("never again")), event(anew, turn, 10, "regenerate", role, piece(0)),
        event(odd & ~anew, turn, 11, "message", role, F.lit("a draft")), event(odd & ~anew, turn, 12, "delta", none, F.lit(" of it")), event(odd & ~anew, turn, 13, "edit", none, piece(0)),
        event(~odd & ~anew, turn, 14, "message", role, piece(0)), event(F.lit(True), turn, 15, "delta", none, piece(1)), event(F.lit(True), turn, 16, "delta", none, piece(2)),
        event(odd, turn, 15, "delta", none, piece(1)),
    ]
    rows = as_events(conversations).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "item", F.explode(F.array_compact(F.array(*log))).alias("e")).select("conv_id", "e.turn", "item", "e.seq", "e.kind", "e.role", "e.text")


def formatted(final: DataFrame, learn: str = "assistant", dealt: bool = False) -> DataFrame:
    """(conv_id, block, part, formatted, loss) of messages (conv_id, turn, role, text; item, if turns hold several).

    A conversation's text is its parts in the order of block and part. loss holds begin and end, in code points of
    the part, of each text of role ``learn``. ``dealt``: rows have a block and those of one lie in one partition, as
    ``messages`` gives them.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, size, pieces, loss, out = None, 0, 0, [], [], []

        def flush() -> None:
            if pieces:
                out.append((*at, part, "".join(pieces), list(loss)))

        for batch in batches:
            for c, b, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != (c, b) or size >= PART:
                    flush()
                    part = part + 1 if at == (c, b) else 0
                    at, size, pieces, loss = (c, b), 0, [], []
                head, body = f"{START}{escape_role(role or '')}\n", escape(text or "")
                if role == learn:
                    loss += [size + len(head), size + len(head) + len(body)]
                pieces += [head, body, END, "\n"]
                size += len(head) + len(body) + len(END) + 1
            if out:
                yield _rows(out)
                out.clear()
        flush()
        if out:
            yield _rows(out)

    if not dealt:
        turn = F.coalesce("turn", F.lit(_NO_TURN))
        item = F.col("item") if "item" in final.columns else F.lit(0)
        final = final.select("conv_id", _range(turn).alias("block"), turn.alias("turn"), item.alias("item"), "role", "text").repartition("conv_id", "block")
    rows = final.sortWithinPartitions("conv_id", "block", "turn", "item")
    return rows.select("conv_id", "block", "role", "text").mapInArrow(render, _PARTS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    c, b, p, t, m = zip(*out, strict=True)
    return pa.record_batch([pa.array(c, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.int64()), pa.array(t, pa.string()), pa.array(m, pa.list_(pa.int64()))], names=["conv_id", "block", "part", "formatted", "loss"])


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each message of a formatted part."""
    for message in text.split(f"{END}\n")[:-1]:
        head, body = message.split("\n", 1)
        if not head.startswith(START):
            raise ValueError("a part begins with a message")
        yield restore_role(head[len(START) :]), restore(body)


def read_back(parts: DataFrame) -> DataFrame:
    """What formatted parts say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Parts stream past in order; only running digests are held.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done() -> tuple:
            c, n, turns, chars, loss, size = state
            return c, n, turns.hexdigest(), chars, loss.hexdigest(), size

        out: list[tuple] = []
        for batch in batches:
            for c, text, spans in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or state[0] != c:
                    if state:
                        out.append(done())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    said = restore(text[a:b])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if out:
                yield _digests(out)
                out.clear()
        if state:
            yield _digests([*out, done()])

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def chat_format(conversations: DataFrame, streamed: bool = False) -> DataFrame:
    """The digest of every formatted conversation of (conv_id, turn, role, text), folded from the log of ``as_events``
    or, ``streamed``, of ``as_streamed``.

    Rows of a conversation stand by turn, ties by role and text; repeated rows are messages
    of their own; a null text or role is empty; rows with a null conv_id form one
    conversation. Other columns are ignored; an empty table gives no rows.
    """
    log = as_streamed(conversations) if streamed else as_events(conversations)
    return read_back(formatted(messages(log), dealt=True))
