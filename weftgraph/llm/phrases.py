"""Collocations by the partition algorithm (SON): frequent phrases of shards are the candidates, which are then counted.

Documents are dealt to a few shards. A phrase that is frequent in the whole is
frequent, at the support lowered by the number of shards, in one shard at least;
so all phrases frequent in a shard, found completely, hold all that matter.
Shards grow with the input and each is mined by many tasks: first words and
pairs, then longer phrases all of whose pairs are frequent there. The last pass
counts the union of what the shards found over all texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.llm.scratch import Scratch
from weftgraph.llm.spans import cut_strings, lower_ascii, ranges, windows
from weftgraph.llm.text_hash import Words, byte_class, mix, signed
from weftgraph.operators.scale import lookup_join

#: Signs and line ends that end a piece; blanks and tabs part words inside of one.
PIECE_END = byte_class((10, 13), (33, 33), (44, 44), (46, 46), (58, 59), (63, 63))
WORD = ~(PIECE_END | byte_class((9, 9), (32, 32)))
LONGEST = 4
SHARDS = 6
#: Words and pairs are sorted in so many slices of their keys, whose shuffle files are freed in between.
SLICES = 2
#: Bits of a filter that tasks carry, at most (64 MB), whatever the number of its keys.
FILTER_BITS = 1 << 29
#: Bytes of text that a task works on at a time; the powers that hash so many are kept from one window to the next.
WINDOW_BYTES = 2 << 20
#: Keys that a task gathers from its windows before it counts the equal ones (16 MB).
HELD_KEYS = 1 << 21
_SEGMENT = 1 << 20


class KeyFilter:
    """A Bloom filter of 64-bit keys with two bits a key; it never misses a key.

    Past the bound of its size more foreign keys pass, which costs counting, not results.
    """

    def __init__(self, keys: DataFrame, most_bits: int = FILTER_BITS):
        count = keys.count()
        self.bits = 1 << 16
        while self.bits < min(12 * count, most_bits):
            self.bits <<= 1
        places = F.array(F.col("key").bitwiseAND(F.lit(self.bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(self.bits - 1)))
        spots = keys.select(F.explode(places).alias("place")).select(F.shiftright("place", 20).alias("segment"), "place")

        def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            bits = np.zeros(_SEGMENT, dtype=bool)
            bits[table.column("place").to_numpy() & (_SEGMENT - 1)] = True
            return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

        whole = np.zeros(max(self.bits, _SEGMENT) // 8, dtype=np.uint8)
        for row in spots.groupBy("segment").applyInArrow(fill, "segment long, bits binary").toLocalIterator():
            whole[row.segment * _SEGMENT // 8 : (row.segment + 1) * _SEGMENT // 8] = np.frombuffer(row.bits, dtype=np.uint8)
        self.carried = keys.sparkSession.sparkContext.broadcast(whole.tobytes())

    def __getstate__(self):
        return {"bits": self.bits, "carried": self.carried}

    def has(self, keys: np.ndarray) -> np.ndarray:
        table, mask = np.frombuffer(self.carried.value, dtype=np.uint8), np.uint64(self.bits - 1)
        found = np.ones(len(keys), dtype=bool)
        for place in (keys & mask, (keys >> np.uint64(32)) & mask):
            found &= (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def phrase_keys(words: Words, salt: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``LONGEST`` words: the first words of all phrases of a window, and the phrases' keys in their language.

    ``salt`` has a value for each row. A phrase stays inside of a piece.
    """
    mark = np.searchsorted(np.flatnonzero(PIECE_END[words.data]), words.start)
    joined = (words.row[1:] == words.row[:-1]) & (mark[1:] == mark[:-1])
    key, whole = mix(words.hash ^ salt[words.row]), np.ones(len(words), dtype=bool)
    out = [(np.arange(len(words)), key)]
    for size in range(2, LONGEST + 1):
        n = max(len(words) - size + 1, 0)
        key = mix(key[:n] * np.uint64(0x9FB21C651E98DF25) + words.hash[size - 1 :][:n] + np.uint64(size))
        whole = whole[:n] & joined[size - 2 :][:n]
        out.append((np.flatnonzero(whole), key))
    return [(first, k[first]) if len(first) < len(k) else (first, k) for first, k in out]


def _salts(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    each = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(each, dtype=np.uint64)[coded.indices.to_numpy()] if len(langs) else np.zeros(0, dtype=np.uint64)


def _in_shard(key: np.ndarray, shard: int) -> np.ndarray:
    return mix(key + np.uint64(0xD1342543DE82EF95 * (shard + 1) % (1 << 64)))


def shard_counts(rows: DataFrame, shards: int, pairs: KeyFilter | None, window_bytes: int, slices: int = 1, number: int = 0) -> DataFrame:
    """(key, tally) of what some windows of a task hold, tally being n * shards + shard: words and pairs of a slice of the
    keys, or, given the shards' frequent ``pairs``, the longer phrases all of whose pairs are frequent in their shard."""

    def counted(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for s in range(shards):
            value, times = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *held[s]]), return_counts=True)
            held[s].clear()
            if len(value):
                yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(times.astype(np.int64) * shards + s)], ["key", "tally"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(shards)]
        n = 0
        for batch in batches:
            salts, shard = _salts(batch.column("lang")), batch.column("shard").to_numpy()
            for begin, end, data, bounds, _ in windows(batch.column("text"), PIECE_END, window_bytes):
                words = Words(data, bounds, WORD)
                home = shard[begin:end][words.row]
                found = phrase_keys(words, salts[begin:end])
                if pairs is None:
                    found = [(home[first], key) for first, key in found[:2]]
                    if slices > 1:
                        mine = [(key >> np.uint64(50)) % np.uint64(slices) == number for _, key in found]
                        found = [(h[m], key[m]) for (h, key), m in zip(found, mine)]
                else:
                    first, key = found[1]
                    good = np.zeros(len(words) + LONGEST, dtype=bool)
                    for s in range(shards):
                        mine = home[first] == s
                        good[first[mine]] = pairs.has(_in_shard(key[mine], s))
                    chosen = []
                    for size in range(3, LONGEST + 1):
                        first, key = found[size - 1]
                        keep = np.all([good[first + j] for j in range(size - 1)], axis=0)
                        chosen.append((home[first[keep]], key[keep]))
                    found = chosen
                home, key = (np.concatenate(x) for x in zip(*found))
                if n and n + len(key) > HELD_KEYS:
                    yield from counted(held)
                    n = 0
                n += len(key)
                for s in range(shards):
                    held[s].append(key[home == s])
        yield from counted(held)

    return rows.select("lang", "shard", "text").mapInArrow(count, "key long, tally long")


def frequent_in_shards(counts: DataFrame, support: int, shards: int) -> DataFrame:
    """(key, shard, n) of the keys with ``support`` or more in their shard: one sort by the key alone, then sums of neighbours."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(key: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            one, shard = np.nonzero(total >= support)
            return pa.RecordBatch.from_arrays([pa.array(key[one]), pa.array(shard.astype(np.int32)), pa.array(total[one, shard])], ["key", "shard", "n"])

        last, sums = np.zeros(0, dtype=np.int64), np.zeros((0, shards), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tally = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.append(True, key[1:] != key[:-1])
            place = (np.cumsum(fresh) - 1) * shards + tally % shards
            own = key[fresh]
            total = np.bincount(place, weights=tally // shards, minlength=len(own) * shards).astype(np.int64).reshape(-1, shards)
            if len(last) and own[0] == last[0]:
                total[0] += sums[0]
            else:
                yield frequent(last, sums)
            last, sums = own[-1:], total[-1:]
            yield frequent(own[:-1], total[:-1])
        yield frequent(last, sums)

    return counts.repartition("key").sortWithinPartitions("key").mapInArrow(add, "key long, shard int, n long")


def counted_phrases(rows: DataFrame, wanted: KeyFilter, window_bytes: int) -> DataFrame:
    """(lang, phrase, size, n) of all phrases whose key is wanted, to be summed; size 0 counts all words of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            salts = _salts(langs)
            for begin, end, data, bounds, _ in windows(batch.column("text"), PIECE_END, window_bytes):
                words = Words(data, bounds, WORD)
                width = words.end - words.start
                # All words of the window with one blank behind each.
                even = np.full(int(width.sum()) + len(words), 32, dtype=np.uint8)
                start = np.cumsum(width + 1) - width - 1
                even[ranges(start, width)] = lower_ascii(data)[ranges(words.start, width)]
                for size, (first, key) in enumerate(phrase_keys(words, salts[begin:end]), 1):
                    keep = wanted.has(key)
                    _, one, times = np.unique(key[keep], return_index=True, return_counts=True)
                    one = first[keep][one]
                    last = one + size - 1
                    yield pa.RecordBatch.from_arrays([
                        langs.take(pa.array(begin + words.row[one])), cut_strings(even, start[one], start[last] + width[last] - start[one]),
                        pa.array(np.full(len(one), size, dtype=np.int32)), pa.array(times.astype(np.int64))], names)
                yield pa.RecordBatch.from_arrays([
                    langs.slice(begin, end - begin), pa.nulls(end - begin, pa.string()), pa.array(np.zeros(end - begin, dtype=np.int32)),
                    pa.array(words.counts.astype(np.int64))], names)

    names = ["lang", "phrase", "size", "n"]
    return rows.select("lang", "text").mapInArrow(count, "lang string, phrase string, size int, n long")


def frequent_phrases(docs: DataFrame, support: int, shards: int = SHARDS, filter_bits: int = FILTER_BITS, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """(lang, phrase, size, n): every phrase of 1 to 4 words with ``support`` or more occurrences in its language, and
    a row of size 0 and phrase null for each language with the number of its words."""
    scratch = Scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text",
                       F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    local = -(-support // shards)  # below it in every shard, a phrase is below the support in all
    parts = [scratch.save(frequent_in_shards(shard_counts(rows, shards, None, window_bytes, SLICES, i), local, shards), "short") for i in range(SLICES)]
    short = reduce(DataFrame.unionByName, parts)

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, shard = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            out = np.zeros(len(key), dtype=np.uint64)
            for number in range(shards):
                out[shard == number] = _in_shard(key[shard == number], number)
            yield pa.RecordBatch.from_arrays([pa.array(signed(out))], ["key"])

    pairs = KeyFilter(short.select("key", "shard").mapInArrow(salted, "key long"), filter_bits)
    long = scratch.save(frequent_in_shards(shard_counts(rows, shards, pairs, window_bytes), local, shards), "long")
    # A shard that does not report a phrase has less than the local support of it.
    most = F.sum("n") + (shards - F.count(F.lit(1))) * (local - 1)
    wanted = scratch.save(short.unionByName(long).groupBy("key").agg(most.alias("most")).where(F.col("most") >= support).select("key"), "wanted")
    counts = counted_phrases(rows, KeyFilter(wanted, filter_bits), window_bytes)
    found = (counts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
             .where((F.col("size") == 0) | (F.col("n") >= support)))
    out = scratch.save(found, "found")
    scratch.drop(*parts, long, wanted)
    return out


def collocations(docs: DataFrame, support: int = 30, top: int = 2000, cover_percent: int = 80, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A null lang is ``und``, a null text is empty. Texts are split at .,;:!? and
    line ends into pieces, and these at blanks and tabs into words, A-Z
    lower-cased. Candidates are phrases of 2 to 4 words with a >= ``support``
    occurrences inside pieces, overlapping ones included. Of the ways to cut one
    in two, with l and r occurrences of the parts, that with the smallest
    score floor(2000000 a / (l + r)) counts, the shortest first part of equal
    ones. A candidate inside of a longer one that has ``cover_percent`` of its
    occurrences or more is dropped. Ranks go by score and a descending, then
    the phrase in byte order, so ties are defined. n is the number of all words
    of the language. Rows count as often as they are repeated; an empty table
    gives no row; other columns are ignored. Scores are computed in decimals.
    """
    found = frequent_phrases(docs, support, **sizes)
    words = found.where("size = 0").select("lang", F.col("n").alias("all_words"))
    ready = found.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = ready.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    parts = found.where("size > 0")
    # A frequent word may begin or end a large share of all phrases.
    cuts = lookup_join(cuts, parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"], "inner", ["tail"])
    cuts = lookup_join(cuts, parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"], "inner", ["head"])
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)"),
                            (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    spans = F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " ")))
    longer = (ready.where("size > 2").select("lang", "a", F.explode(F.flatten(spans)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (best.join(longer, ["lang", "phrase"], "left")
            .where(F.coalesce(100 * F.col("longer") < cover_percent * F.col("a"), F.lit(True))))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("all_words").alias("n"), "cut.score")
