"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only that reply is trainable.  All examples of a conversation are
prefixes of one formatted text, so the text is stored once, in one row a turn
(``segments``).  ``spelled`` makes the examples, a row each with its whole text, context
and reply, and its loss mask: GROUP examples of a conversation share one pass over
their segments, so a long conversation is many groups for many tasks.  ``expand`` reads
each example back from that text alone: its turns, and the trainable text by its
mask.  ``digests`` puts what was read together by conversation; ``materialize`` makes the
rows of ``spelled`` by a join.

Template: ``<s>role<|text|>text</s>``.  Inside roles and texts a backslash follows
every ``<`` and ``[`` and doubles every backslash, so no control string (``<s>``,
``</s>``, ``<|text|>``, ``[INST]``, ``<<SYS>>`` ...) can occur there, and reading
reverses it exactly.

Null role or text: empty.  A null conv_id is a conversation of its own.  Turns go
by (turn with nulls first, role, text), repeated rows are repeated turns, and
turns after the last assistant turn belong to no example but stay in the segments.
Other columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import save

OPEN, HEAD, CLOSE = "<s>", "<|text|>", "</s>"
_CONTROL, _ESCAPED = re.compile(r"[<\[\\]"), re.compile(r"([<\[])\\|\\(\\)")
_TURN = re.compile(r"<s>((?:[^<]|<\\)*)<\|text\|>((?:[^<]|<\\)*)</s>\Z")

SEGMENTS = "conv_id long, seq long, formatted string, start long, length long, loss_start long, loss_length long, example long, before long"
#: Examples of a conversation that share one pass over their segments.
GROUP = 64
#: Characters of examples after which a batch of them is handed on.
TEXT_IN_BATCH = 4_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int]:
    """The formatted turn, and where its text starts in it."""
    head = OPEN + escape(role or "") + HEAD
    return head + escape(text or "") + CLOSE, len(head)


def parse_turn(formatted: str) -> tuple[str, str]:
    m = _TURN.match(formatted)
    if not m:
        raise ValueError(f"not a formatted turn: {formatted[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    *turns, rest = text.split(CLOSE)  # no control string occurs inside a turn
    if rest:
        raise ValueError(f"not a formatted turn: {rest[:80]!r}")
    out = []
    for turn in turns:
        role, head, said = turn[len(OPEN) :].partition(HEAD)
        plain = turn.startswith(OPEN) and head and not any(c in x for x in (role, said) for c in "<\\")
        out.append((role, said) if plain else parse_turn(turn + CLOSE))
    return out


def segments(turns: DataFrame) -> DataFrame:
    """One row for each turn of ``turns`` (conv_id, turn, role, text) in order:
    conv_id, seq, formatted, start and length in the conversation's text (code
    points), loss_start and loss_length of the trainable text there, the
    number of the example whose target it is (null for other turns), and how many
    examples end before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, at, example = object(), 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != now:
                    now, seq, at, example = conv, 0, 0, 0
                formatted, head = format_turn(role, text)
                target = role == "assistant"
                out.append((conv, seq, formatted, at, len(formatted), *((at + head, len(formatted) - head - len(CLOSE), example) if target else (None, None, None)), example))
                seq, at, example = seq + 1, at + len(formatted), example + target
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], [x.split()[0] for x in SEGMENTS.split(", ")])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    return rows.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def examples(parts: DataFrame) -> DataFrame:
    """One row for each assistant turn: the example's text is the first
    ``n_segments`` segments, ``chars`` code points; only the reply is trainable."""
    return parts.where("example is not null").select("conv_id", "example", (F.col("seq") + 1).alias("n_segments"), (F.col("start") + F.col("length")).alias("chars"), "loss_start", "loss_length")


def materialize(parts: DataFrame) -> DataFrame:
    """The examples with their whole texts spelled out (conv_id, example, text,
    loss_start, loss_length).  Quadratic in a conversation's turns by nature."""
    ends = examples(parts)
    context = parts.select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), "formatted")
    rows = ends.join(context, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("s") < F.col("n_segments")))
    texts = rows.groupBy("conv_id", "example", "loss_start", "loss_length").agg(F.array_sort(F.collect_list(F.struct("s", "formatted"))).alias("x"))
    return texts.select("conv_id", "example", F.array_join(F.col("x.formatted"), "").alias("text"), "loss_start", "loss_length")


def spelled(parts: DataFrame) -> DataFrame:
    """The examples as rows (conv_id, example, text, loss_start, loss_length), a
    group's one after the other: each text is that of the turns before and the reply."""
    last = parts.where("example is not null").groupBy(F.col("conv_id").alias("c")).agg(F.max("example").alias("last"))
    own = parts.join(last, F.col("conv_id").eqNullSafe(F.col("c"))).where("before <= last")
    groups = own.withColumn("group", F.explode(F.sequence(F.floor(F.col("before") / GROUP), F.floor(F.col("last") / GROUP))))
    rows = groups.select("conv_id", "group", "formatted", "loss_start", "loss_length", "example", "seq")
    rows = rows.repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "seq")
    names = ["conv_id", "example", "text", "loss_start", "loss_length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        whole = lambda made: pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], kind) for i, kind in enumerate(kinds)], names)
        now, context = object(), ""
        for batch in batches:
            made, held = [], 0
            for conv, group, formatted, start, length, example in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if now != (conv, group):
                    now, context = (conv, group), ""
                context += formatted
                if example is not None and example // GROUP == group:
                    made.append((conv, example, context, start, length))
                    held += len(context)
                    if held > TEXT_IN_BATCH:
                        yield whole(made)
                        made, held = [], 0
            yield whole(made)

    return rows.select("conv_id", "group", "formatted", "loss_start", "loss_length", "example").mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_length long")


def read_back(examples: DataFrame) -> DataFrame:
    """What each text of ``examples`` (as ``spelled``) says: conv_id, example, n_turns,
    turns_sha256 (of its context and reply), chars, and reply, what its loss mask holds."""
    names = ["conv_id", "example", "n_turns", "turns_sha256", "chars", "reply"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                conv, example, text, start, length = (batch.column(k)[i].as_py() for k in range(5))
                turns = parse(text)
                digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode())
                done.append((conv, example, len(turns), digest.hexdigest(), len(text), unescape(text[start : start + length])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names)

    return examples.select("conv_id", "example", "text", "loss_start", "loss_length").mapInArrow(run, "conv_id long, example long, n_turns long, turns_sha256 string, chars long, reply string")


def expand(parts: DataFrame) -> DataFrame:
    """One row for each example, read from its own text: see ``read_back``."""
    return read_back(spelled(parts))


def _in_order(rows: DataFrame, order: str, text: str, schema: str, start, step, end) -> DataFrame:
    """One row a conversation, folded from its rows in order."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        kinds = [pa.string() if "sha256" in x else pa.int64() for x in names]
        for batch in batches:
            for conv, number, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or now != conv:
                    if state is not None:
                        done.append((now, *end(state)))
                    now, state = conv, start()
                step(state, number, value)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names)
            done = []
        if state is not None:
            done.append((now, *end(state)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names)

    own = rows.repartition("conv_id").sortWithinPartitions("conv_id", order)
    return own.select("conv_id", *([order] if order == "seq" else ["chars"]), text).mapInArrow(run, schema)


def digests(parts: DataFrame) -> DataFrame:
    """What reading the formatted output gives back, one row a conversation:
    conv_id, n_turns, turns_sha256 from all segments; loss_chars, loss_sha256, n_examples
    from the examples; formatted_chars (of all examples' texts, and of the segments
    behind the last)."""
    parts = save(parts, "segments")

    def turn(state: list, _, formatted: str) -> None:
        role, text = parse_turn(formatted)
        state[0] += 1
        state[1].update(f"{role}\n{text}\n".encode())
        state[2] += len(formatted)

    def reply(state: list, chars: int, text: str) -> None:
        state[0] += len(text)
        state[1].update(text.encode())
        state[2:] = [state[2] + chars, state[3] + 1, chars]

    whole = _in_order(parts, "seq", "formatted", "conv_id long, n_turns long, turns_sha256 string, all_chars long", lambda: [0, hashlib.sha256(), 0], turn, lambda s: (s[0], s[1].hexdigest(), s[2]))
    learned = _in_order(save(expand(parts), "examples"), "example", "reply", "c long, loss_chars long, loss_sha256 string, example_chars long, n_examples long, last_chars long", lambda: [0, hashlib.sha256(), 0, 0, 0], reply, lambda s: (s[0], s[1].hexdigest(), *s[2:]))
    both = whole.join(learned, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return both.select("conv_id", "n_turns", "turns_sha256", none("loss_chars").alias("loss_chars"), F.coalesce("loss_sha256", F.lit(hashlib.sha256().hexdigest())).alias("loss_sha256"), (none("example_chars") + F.col("all_chars") - none("last_chars")).alias("formatted_chars"), none("n_examples").alias("n_examples"))
