"""Chat formatting: conversations through a compiled template, with marks for what to learn.

A conversation's turns are rendered in order, each to one part: its formatted text and the spans
of it that lie in ``{% generation %}``. The parts in order are the formatted conversation. Control
strings of the template that stand in a turn's text are broken up by a backslash after their
first character, and backslashes doubled, which ``unescape`` takes back exactly.

Turns are dealt out by conversation and sorted within partitions; rendering and reading then
stream through them, a turn at a time. A conversation that holds a third of all rows is read by
one task, in order and in bounded memory: a digest over a whole conversation can't be taken in
pieces. Nothing else is gathered anywhere.

Defined results: null roles and texts count as empty; turns with one number come in the order
of role and text, null numbers first; repeated rows are repeated turns; rows of a null
conversation are one conversation. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidelog.llm.kit import map_parts
from tidelog.llm.template import Edge, Turns, compile_template
from tidelog.plans.shipping import map_batches

CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]")
TEMPLATE = """
{%- for message in messages -%}
  {%- if message.role == 'user' -%}
    {{ '[INST]' + ' ' }}{{ message.content | escape }}{{ ' ' + '[/INST]' }}
  {%- elif message.role == 'assistant' -%}
    {{ '<s>' }}{% generation %}{{ message.content | escape }}{% endgeneration %}{{ '</s>' }}
  {%- else -%}
    {{ '<<SYS>>' }}{{ message.role | escape }}{{ '[ROLE]' }}{{ message.content | escape }}{{ '<</SYS>>' }}
  {%- endif -%}
{%- endfor -%}
"""
# What the reader looks for: a turn's beginning, the role it means, and the marks that follow.
TURNS = {"[INST] ": ("user", [" [/INST]"]), "<s>": ("assistant", ["</s>"]), "<<SYS>>": (None, ["[ROLE]", "<</SYS>>"])}

BEGINS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)


def escape(text: object) -> str:
    """``text`` without control strings."""
    return BEGINS.sub(r"\1" + r"\\", str(text).replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS = {"escape": escape, "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}

PART = StructType([
    StructField("conv_id", LongType()), StructField("part", LongType()), StructField("formatted", StringType()),
    StructField("loss", ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))),
])


@cache
def renderer(template: str):
    return compile_template(template, FILTERS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in map_parts(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: StructType, weight, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(dict(zip(schema.names, row, strict=True)))
        size += weight(row)
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=arrow)


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row (conv_id, part, formatted, loss) for each turn, in order within each partition.

    loss are the spans of ``formatted``, in code points, to learn from. What the template writes
    after the last turn is part of the last row.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def parts(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, own in groupby(rows, key=lambda r: r[0]):
            # A part ends where the template asks for the turn after the next: it looks one ahead.
            asked = [0]

            def messages(own=own, asked=asked):
                for r in own:
                    asked[0] += 1
                    yield {"role": r[2], "content": r[3]}

            text, spans, at, opened, n = [], [], 0, 0, 0
            for piece in renderer(template)({"messages": Turns(messages())}):
                if asked[0] > n + 2:
                    yield conv_id, n, "".join(text), spans
                    text, spans, at, n = [], [], 0, n + 1
                if piece is Edge.BEGIN:
                    opened = at
                elif piece is Edge.END:
                    spans.append({"start": opened, "stop": at})
                else:
                    text.append(piece)
                    at += len(piece)
            yield conv_id, n, "".join(text), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(parts(_rows(batches)), PART, lambda r: len(r[2]) + 50)

    return map_batches(turns, run, PART)


READ = StructType([
    StructField("conv_id", LongType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
    StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType()),
])


def read_turns(formatted: str) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) that ``formatted`` begins with, and where the first unfinished one begins."""
    turns, at = [], 0
    while at < len(formatted):
        begin = next((b for b in TURNS if formatted.startswith(b, at)), None)
        if begin is None:
            break
        role, marks = TURNS[begin]
        fields, here = [], at + len(begin)
        for mark in marks:
            stop = formatted.find(mark, here)
            if stop < 0:
                return turns, at
            fields.append(unescape(formatted[here:stop]))
            here = stop + len(mark)
        turns.append((role or fields[0], fields[-1]))
        at = here
    return turns, at


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from the parts of format_turns in their order.

    The turns are read from the formatted text, the learnt text from the spans in ``loss``.
    """

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, own in groupby(rows, key=lambda r: r[0]):
            turns, loss, n_turns, loss_chars, chars, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for _, _, formatted, spans in own:
                chars += len(formatted)
                found, at = read_turns(rest + formatted)
                rest = (rest + formatted)[at:]
                n_turns += len(found)
                for role, text in found:
                    turns.update(f"{role}\n{text}\n".encode())
                for s in spans:
                    learnt = unescape(formatted[s["start"] : s["stop"]])
                    loss_chars += len(learnt)
                    loss.update(learnt.encode())
            if rest:
                raise ValueError(f"conversation {conv_id}: what follows turn {n_turns} is no turn: {rest[:80]!r}")
            yield conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(digests(_rows(batches)), READ, lambda _: 300)

    return map_batches(parts, run, READ)
