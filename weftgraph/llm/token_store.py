"""Shards of raw token ids with a minimal perfect hash index over their document keys.

A shard is one binary value: a header, the index, and the ids of its documents
end to end. The index gives each key of the shard a slot of its own; the slot
holds a fingerprint of the key and the place of its ids, so a look-up costs two
hashes and one comparison, and a key that is not there is found out by its
fingerprint (but for one in 2^32). Shards are rows of a Parquet table, so they
can be in any store that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.llm.text_hash import chunks, mix
from weftgraph.llm.tokens import Encoder, cut_lower_words

MAGIC = b"IDS1"
_HEAD = "<4sBxxxII"
#: A shard is closed when it has so many ids; a longer document has a shard of its own.
SHARD_IDS = 1 << 19
_KEYS_PER_BUCKET = 4
SHARDS = ("part int, seq int, start_in_part long, n_ids long, n_docs int, first_id long, last_id long, blob binary")


def key_hashes(ids: list[int | None]) -> np.ndarray:
    """64-bit keys of documents in order; the n-th row of one doc_id has its own, and so has null."""
    seen: dict[int | None, int] = {}
    turn = np.zeros(len(ids), dtype=np.uint64)
    for i, x in enumerate(ids):
        n = seen.get(x, 0)
        turn[i], seen[x] = n, n + 1
    value = np.array([0x7FEDCBA987654321 if x is None else x for x in ids], dtype=np.int64).view(np.uint64)
    return mix(mix(value) + turn)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each key): slots 0..n-1, one for each key.

    Buckets with most keys choose first: the smallest displacement that puts all
    of them into free slots. A bucket of one key names its slot as -1 - slot.
    """
    n = len(keys)
    buckets = max(1, -(-n // _KEYS_PER_BUCKET))
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    moves, slots, free = np.zeros(buckets, dtype=np.int32), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket.astype(np.int64), minlength=buckets)
    first = np.concatenate([[0], np.cumsum(sizes)])
    lone = []
    for b in np.argsort(-sizes, kind="stable"):
        mine = order[first[b] : first[b + 1]]
        if len(mine) == 0:
            break
        if len(mine) == 1:
            lone.append((b, mine[0]))
            continue
        move, at = _first_fit(keys[mine], free)
        moves[b], slots[mine], free[at] = move, at, False
    for (b, key), slot in zip(lone, np.flatnonzero(free)):
        moves[b], slots[key] = -1 - slot, slot
    return moves, slots


def _first_fit(keys: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
    """The smallest displacement that puts all keys into free slots, and these; displacements are tried in growing blocks."""
    begin, block = 0, 4
    while True:
        at = displaced(keys, np.arange(begin, begin + block)[:, None], len(free))
        for row in np.flatnonzero(free[at].all(axis=1)).tolist():
            if len(set(at[row].tolist())) == len(keys):
                return begin + row, at[row]
        begin, block = begin + block, min(4 * block, 1024)


def displaced(keys: np.ndarray, move, n: int) -> np.ndarray:
    return (mix(keys + np.asarray(move).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def pack(ids: list[int | None], payloads: list[bytes], width: int) -> bytes:
    """One shard. ``payloads`` are the documents' ids as little-endian numbers of ``width`` bytes."""
    n, keys = len(ids), key_hashes(ids)
    moves, slots = build_index(keys)
    lengths = np.array([len(p) // width for p in payloads], dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)[:-1]]).astype(np.uint64)
    marks, at, size = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u4")
    marks[slots], at[slots], size[slots] = mix(keys ^ np.uint64(0xF1)).astype("<u4"), starts, lengths
    known = np.array([x is not None for x in ids], dtype=np.uint8)
    names = np.array([x or 0 for x in ids], dtype="<i8")
    return b"".join([struct.pack(_HEAD, MAGIC, width, n, len(moves)), moves.astype("<i4").tobytes(), marks.tobytes(), at.tobytes(),
                     size.tobytes(), known.tobytes(), names.tobytes(), *payloads])


class Shard:
    """A shard opened for keyed reads."""

    def __init__(self, blob: bytes):
        magic, self.width, self.n, buckets = struct.unpack_from(_HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        place = struct.calcsize(_HEAD)

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(blob, dtype=dtype, count=count, offset=place)
            place += out.nbytes
            return out

        self.moves, self.marks, self.at, self.size = take("<i4", buckets), take("<u4", self.n), take("<u8", self.n), take("<u4", self.n)
        known, names = take("u1", self.n), take("<i8", self.n)
        self.ids = [int(x) if k else None for x, k in zip(names, known)]
        self.payload, self.base = blob, place

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the fingerprint says that it isn't here."""
        move = self.moves[((keys >> np.uint64(32)) % np.uint64(len(self.moves))).astype(np.int64)]
        slot = np.where(move < 0, -1 - move.astype(np.int64), displaced(keys, np.maximum(move, 0), self.n))
        return np.where(self.marks[slot] == mix(keys ^ np.uint64(0xF1)).astype("<u4"), slot, -1)

    def read(self, slot: int) -> np.ndarray:
        return np.frombuffer(self.payload, dtype=f"<u{self.width}", count=int(self.size[slot]),
                             offset=self.base + int(self.at[slot]) * self.width)


def write_shards(docs: DataFrame, path: str, end_id: int, width: int = 2) -> DataFrame:
    """Shard rows of all documents in ascending doc_id order, null first and equal doc_ids by a hash of the text.

    ``path`` is a tokenizer file on every executor; ``end_id`` ends each
    document, also an empty or null text. ``width`` is the bytes of an id. One
    shuffle deals the texts by range; each range numbers its shards and ids.
    first_id and last_id are the smallest and largest doc_id that isn't null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, part = Encoder(path, cut_lower_words, f"<u{width}", separator=" ", special=True), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        ids: list[int | None] = []
        payloads: list[bytes] = []
        seq = start = count = 0

        def close() -> pa.RecordBatch:
            values = [part, seq, start, count, len(ids), next((x for x in ids if x is not None), None), ids[-1], pack(ids, payloads, width)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for begin, stop, _, _ in chunks(batch.column("text"), 16 << 20):
                texts = batch.column("text").slice(begin, stop - begin).to_pylist()
                for doc_id, found in zip(batch.column("doc_id").slice(begin, stop - begin).to_pylist(), use.encode_words([t or "" for t in texts])):
                    n = len(found) // width + 1
                    if ids and count + n > SHARD_IDS:
                        yield close()
                        seq, start, count, ids, payloads = seq + 1, start + count, 0, [], []
                    ids.append(doc_id)
                    payloads.append(found + end)
                    count += n
        if ids:
            yield close()

    names = [x.split()[0] for x in SHARDS.split(", ")]
    # The sample that sets the ranges reaches the driver, so texts are no part of their key.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    return keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text").mapInArrow(run, SHARDS)


def read_all(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each found by its key in its shard.

    ``start`` counts the ids of all documents before it. The offsets of the
    ranges are a row for each partition of the write, and so may be broadcast;
    the shards themselves are not moved.
    """
    totals = shards.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_ids")).alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column("start").to_pylist(), batch.column("blob")):
                shard = Shard(blob.as_py())
                slots = shard.slots(key_hashes(shard.ids))
                if (slots < 0).any():
                    raise ValueError("a key of the shard is not in its index")
                sums = [zlib.crc32(shard.read(s).astype("<u4").tobytes()) for s in slots.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.ids, type=pa.int64()), pa.array((shard.at[slots].astype(np.int64) + start)),
                    pa.array(shard.size[slots].astype(np.int64)), pa.array(sums, type=pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.select("part", "start_in_part", "blob").join(F.broadcast(bases), "part")
    return placed.select((F.col("base") + F.col("start_in_part")).alias("start"), "blob").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids array) of the documents whose doc_id is in ``keys``; absent keys give no row.

    A key goes to the shards whose first and last doc_id enclose it. Each shard
    has one row, named by the smallest block of a power of two that holds both;
    a key looks for its blocks of the sizes in use, 65 at most. Shards do not
    overlap but at their ends, so of one block there is one row, or the rows
    that share a doc_id. Repeated doc_ids give each of their documents.
    """
    block = "case when level = 64 then 0 else shiftright({}, level) end"
    differ = F.col("low").bitwiseXOR(F.col("high"))
    spans = (shards.where("last_id is not null").select("part", "seq", F.col("first_id").alias("low"), F.col("last_id").alias("high"))
             .withColumn("level", F.when(differ == 0, 0).otherwise(F.length(F.bin(differ))))
             .withColumn("block", F.expr(block.format("low"))))
    wanted = keys.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct()
    asked = (wanted.crossJoin(F.broadcast(spans.select("level").distinct())).withColumn("block", F.expr(block.format("key")))
             .join(spans, ["level", "block"]).where(F.col("key").between(F.col("low"), F.col("high")))
             .groupBy("part", "seq").agg(F.collect_set("key").alias("keys")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted_keys, blob in zip(batch.column("keys").to_pylist(), batch.column("blob")):
                shard, names, found = Shard(blob.as_py()), [], []
                for key in wanted_keys:
                    turn = 0
                    while (slot := shard.slots(key_hashes([key] * (turn + 1))[-1:])[0]) >= 0:
                        names.append(key)
                        found.append(shard.read(slot).astype(np.int64).tolist())
                        turn += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, type=pa.int64()), pa.array(found, type=pa.list_(pa.int64()))], ["doc_id", "ids"])

    return shards.join(asked, ["part", "seq"]).select("keys", "blob").mapInArrow(run, "doc_id long, ids array<long>")
