"""Quoted passages of chat messages, linked to the messages that they come from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.scratch import Scratch
from weftgraph.operators.scale import occurrence_before

_NO_NUMBER = -(1 << 63)


def parse_quotes(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without quotes, and its passages (level, lines).

    The level of a line is the number of ``>`` that open it, blanks and tabs
    aside. A passage is a run of lines of one level; a line that is blank
    behind its marks ends it. The text without quotes has its runs of blank
    lines joined to one and none at its ends.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_level = None
    for line in re.split(r"\r\n|\r|\n", text or ""):
        marks = re.match(r"(?:[ \t]*>)*", line)[0]
        level, content = marks.count(">"), line[len(marks) :]
        if level == 0:
            content = line
            if line.strip() or own and own[-1].strip():
                own.append(line)
        elif own and own[-1].strip():
            own.append("")
        if not content.strip():
            open_level = None
            continue
        if level != open_level:
            passages.append((level, []))
            open_level = level
        passages[-1][1].append(content)
    return "\n".join(own).strip("\n"), passages


def marks_of(lines: list[str]) -> list[tuple[int, int]]:
    """(hash, characters) of a passage and, if it has several, of each of its lines.

    Hashes are of the text in lower case with white space joined to one blank.
    """
    plain = [" ".join(x.lower().split()) for x in lines]
    parts = [" ".join(plain), *plain] if len(plain) > 1 else plain
    return [(int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "little", signed=True), len(p)) for p in parts]


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: what it answers, and its place in the conversation.

    Columns conv_id, turn, role, copies, body, n_quotes, max_level, n_linked,
    reply_to, root_turn, depth, position. body is the text without quotes. A
    quoted passage comes from the first earlier message of its conversation
    that has it, or one of its lines, as a passage or line of its own. reply_to
    is the turn from which most quoted characters come, at the lowest level
    that has a link (the earliest turn of equal ones); null without a link.
    root_turn and depth follow reply_to up. position counts the conversation's
    messages from 0, thread by thread: by root_turn, then by turn.

    Equal rows are one message, counted in copies. Several messages of one turn
    each have a row. A null conv_id is a conversation of its own; a null turn
    comes first and is linked with nothing, as no turn is earlier. A null or
    empty text has an empty body and no quotes. Other columns are ignored.

    A line that a third of all messages share has one origin row for each
    conversation, so no pairs of messages are made, and a conversation of any
    length is cut into blocks for its positions.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = (messages.select("conv_id", "turn", "role", "text").groupBy("conv_id", "turn", "role", "text")
            .agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("uid", F.xxhash64("conv_id", "turn", "role", "text", *[F.col(c).isNull() for c in ("conv_id", "turn", "role", "text")])))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    names = [f.name for f in rows.schema if f.name != "text"]
    mark_type = pa.list_(pa.struct([("level", pa.int32()), ("mark", pa.int64()), ("size", pa.int64())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, quotes, levels, marks = [], [], [], []
            for text in batch.column("text").to_pylist():
                body, passages = parse_quotes(text)
                bodies.append(body)
                quotes.append(sum(level > 0 for level, _ in passages))
                levels.append(max((level for level, _ in passages), default=0))
                marks.append([{"level": level, "mark": m, "size": n} for level, lines in passages for m, n in marks_of(lines)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(bodies, type=pa.string()), pa.array(quotes, type=pa.int32()),
                 pa.array(levels, type=pa.int32()), pa.array(marks, type=mark_type)], [*names, "body", "n_quotes", "max_level", "marks"])

    parsed = scratch.save(rows.mapInArrow(
        parse, f"{fields}, body string, n_quotes int, max_level int, marks array<struct<level: int, mark: long, size: long>>"), "parsed")
    conversation = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("_conv")
    marks = parsed.where("turn is not null").select(conversation, "turn", "uid", F.explode("marks").alias("m")).select(
        "_conv", "turn", "uid", "m.level", "m.mark", "m.size")
    origin = marks.where("level = 0").groupBy("_conv", "mark").agg(F.min(F.struct("turn", "uid")).alias("origin"))
    linked = scratch.save(marks.where("level > 0").join(origin, ["_conv", "mark"]).where("origin.turn < turn")
                          .groupBy("uid", "level", "origin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "linked")
    best = linked.groupBy("uid").agg(
        F.min(F.struct("level", (-F.col("size")).alias("less"), "origin")).alias("b"), F.sum("n").alias("n_linked"))
    parents = scratch.save(best.select("uid", F.col("b.origin.uid").alias("up"), F.col("b.origin.turn").alias("up_turn"),
                                       F.col("b.origin.turn").alias("reply_to"), "n_linked", F.lit(1).alias("depth")), "parents")
    roots = parents
    while True:  # each round doubles the way up
        above = roots.select(F.col("uid").alias("up"), F.col("up").alias("_up"), F.col("up_turn").alias("_turn"), F.col("depth").alias("_depth"))
        if not roots.join(above, "up", "left_semi").take(1):
            break
        further = scratch.save(roots.join(above, "up", "left").select(
            "uid", F.coalesce("_up", "up").alias("up"), F.coalesce("_turn", "up_turn").alias("up_turn"), "reply_to", "n_linked",
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "roots")
        scratch.drop(roots)
        roots = further
    placed = parsed.drop("marks").join(roots.withColumnRenamed("up_turn", "root"), "uid", "left").select(
        "conv_id", "turn", "role", "copies", "body", "n_quotes", "max_level", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "reply_to",
        F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "uid", conversation,
        F.coalesce("root", "turn", F.lit(_NO_NUMBER)).alias("_root"), F.coalesce("turn", F.lit(_NO_NUMBER)).alias("_turn"))
    keys = ["_conv", "_root", "_turn", "uid"]
    order = occurrence_before(placed.select(*keys), ["_conv"], ["_root", "_turn", "uid"], "position").select("uid", "position")
    return placed.join(order, "uid").select(
        "conv_id", "turn", "role", "copies", "body", "n_quotes", "max_level", "n_linked", "reply_to", "root_turn", "depth",
        F.col("position").cast("long").alias("position"))
