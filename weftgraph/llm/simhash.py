"""SimHash fingerprints and the search for near ones in permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.llm.scratch import Scratch
from weftgraph.llm.text_hash import NOT_SPACE, Words, chunks, mix

BITS = 64
#: Votes are counted in this many rows of 64 counters at a time.
_VOTES = 1 << 16


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One 64-bit fingerprint for each text.

    Terms are single words and pairs of neighbouring words. A term votes with
    1 + ln(its count in the text) on each bit of its hash, for or against. A
    bit is set if the votes for it prevail; a tie, and a text without words,
    leaves it unset.
    """
    out = []
    for _, _, data, bounds in chunks(texts):
        words = Words(data, bounds, NOT_SPACE)
        pairs, whole = words.windows(2)
        rows = np.concatenate([words.row, words.row[whole]])
        terms = np.concatenate([words.hash, pairs[whole]])
        order = np.argsort(terms, kind="stable")
        rows, terms = rows[order], terms[order]
        order = np.argsort(rows, kind="stable")
        rows, terms = rows[order], terms[order]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
        first = np.flatnonzero(fresh)
        weight = (1 + np.log(np.diff(np.append(first, len(rows))))).astype(np.float64)
        rows, terms = rows[first], mix(terms[first])
        votes = np.zeros((len(bounds) - 1, BITS))
        for begin in range(0, len(rows), _VOTES):
            part = slice(begin, begin + _VOTES)
            bits = np.unpackbits(terms[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            signed = (2 * bits - 1) * weight[part, None]
            mine = rows[part]
            starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            votes[mine[starts]] += np.add.reduceat(signed, starts, axis=0)
        out.append(np.packbits(votes > 1e-9, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (query, fingerprint, distance) of distinct fingerprints within ``radius`` bits.

    Both inputs have a column ``fingerprint``. The 64 bits are cut into
    ``blocks`` blocks. Two fingerprints within the radius agree on at least
    ``blocks - radius`` of them, so for every choice of so many blocks there is
    a table in which these bits come first; equal leading bits are looked up by
    an equi-join, and the distance is counted for what it finds. Null
    fingerprints match nothing. The pairs grow with the queries, a stated set,
    not with the square of a group of near fingerprints.
    """
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be smaller than the number of blocks")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    tables = F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("lead")) for i, m in enumerate(masks)])

    def laid_out(df: DataFrame, name: str) -> DataFrame:
        return (df.select("fingerprint").where("fingerprint is not null").distinct()
                .select(F.col("fingerprint").alias(name), F.explode(tables).alias("t")).select(name, "t.table", "t.lead"))

    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    return (laid_out(queries, "query").join(laid_out(prints, "fingerprint"), ["table", "lead"])
            .where(distance <= radius).select("query", "fingerprint", distance.alias("distance")).distinct())


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts and of the next texts.

    Rows are taken in descending doc_id order (null last; equal doc_ids by a hash
    of the text, descending), and the last is followed by the first; a single row follows
    itself. The edited text ends, for its last floor(n_chars / 2) code points,
    with as many of the first code points of the next text, or all it has.
    Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint
    (hexadecimal), near_edited and near_next. A null text is empty; other
    columns are ignored.

    Texts are dealt once, by range of doc_id, and read in order. Only the first
    and last row of each range are then matched across ranges.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The sample that sets the ranges reaches the driver, so texts are no part of their key.
    order = (F.desc_nulls_last("doc_id"), F.desc("hash"))
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = ("place int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, head string, tail string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        held: tuple[int | None, str] | None = None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if held is None:
                yield _row(schema_names, place, None, head=texts[0] if texts else "") if texts else _none()
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if not texts:
                continue
            held = (ids[-1], texts[-1])
            if len(texts) > 1:
                yield _compared(place, ids[:-1], texts)
        if held is not None:
            yield _row(schema_names, place, held[0], tail=held[1])

    schema_names = [x.split()[0] for x in schema.split(", ")]
    out = scratch.save(dealt.mapInArrow(run, schema), "ranges")
    digest = out.where("head is null and tail is null").drop("place", "head", "tail")
    # One head and one tail for each range that has rows.
    ends = out.where("head is not null or tail is not null").groupBy("place").agg(
        F.max("head").alias("head"), F.max("tail").alias("tail"), F.max("doc_id").alias("doc_id"))
    chain = ends.select("place").withColumn("next", F.coalesce(
        F.lead("place").over(Window.orderBy("place")), F.min("place").over(Window.partitionBy(F.lit(0)))))
    heads = ends.select(F.col("place").alias("next"), F.col("head").alias("after"))
    seams = ends.select("place", "doc_id", "tail").join(chain, "place").join(heads, "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tails, after = (batch.column(c).to_pylist() for c in ("doc_id", "tail", "after"))
            for i, text, follower in zip(ids, tails, after):
                yield _compared(0, [i], [text, follower]).select(schema_names[1:8])

    return digest.unionByName(seams.select("doc_id", "tail", "after").mapInArrow(close, ", ".join(schema.split(", ")[1:8])))


def _none() -> pa.RecordBatch:
    return _compared(0, [], [""])


def _row(names: list[str], place: int, doc_id: int | None, head: str | None = None, tail: str | None = None) -> pa.RecordBatch:
    values = {"place": place, "doc_id": doc_id, "head": head, "tail": tail}
    like = _none().schema
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], type=like.field(n).type) for n in names], names)


def _compared(place: int, ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """Results for all texts but the last, each with the one after it as its next."""
    edited = []
    for text, follower in zip(texts, texts[1:]):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + follower[:half])
    prints = fingerprints(pa.array(texts, type=pa.large_string()))
    other = fingerprints(pa.array(edited, type=pa.large_string())) if edited else prints[:0]
    n = len(ids)
    return pa.RecordBatch.from_arrays([
        pa.array([place] * n, type=pa.int32()),
        pa.array(ids, type=pa.int64()),
        pa.array([len(t) for t in texts[:n]], type=pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], type=pa.string()),
        pa.array([f"{x:016x}" for x in prints[:n].tolist()], type=pa.string()),
        pa.array([f"{x:016x}" for x in other.tolist()], type=pa.string()),
        pa.array(likeness(prints[:n], other), type=pa.float64()),
        pa.array(likeness(prints[:n], prints[1 : n + 1]), type=pa.float64()),
        pa.nulls(n, pa.string()),
        pa.nulls(n, pa.string()),
    ], ["place", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "head", "tail"])
