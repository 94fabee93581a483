"""Repeated passages by a sparse suffix array over the words of all documents.

Only suffixes that begin at content-selected positions are kept: a position is
selected if the 8 words from it on hash lowest among ``SPAN`` neighbouring
positions. A passage of ``min_words`` words holds such a position in its first
``SPAN`` ones, the same one wherever the passage stands. Suffixes are sorted by
the words that such a passage has left there at least; equal neighbours are
then extended to the left and right, one window of ``min_words`` words for each
way to lie around the position, and equal windows are what repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.scratch import Scratch, free_name
from weftgraph.llm.text_hash import NOT_SPACE, Words, chunks, mix, signed
from weftgraph.operators.scale import salt_build_side, salt_stream_side

SPAN, GRAM = 20, 8
_NO_ID = -(1 << 63)
#: Places of one window that one task looks up; windows of more places are split.
PLACES_PER_TASK = 100_000


def _keys(words: Words) -> np.ndarray:
    """A key of each text's words in order."""
    number = np.arange(len(words)) - words.first[words.row]
    total = np.zeros(len(words.counts), dtype=np.uint64)
    np.add.at(total, words.row, mix(words.hash + mix(number.astype(np.uint64))))
    return mix(total + words.counts.astype(np.uint64))


def selected(words: Words, min_words: int) -> np.ndarray:
    """Positions (word numbers of the chunk) of the minimisers of texts of ``min_words`` words or more."""
    value, _ = words.windows(GRAM)
    n = len(value)
    if n < min_words:
        return np.zeros(0, dtype=np.int64)
    low = np.lib.stride_tricks.sliding_window_view(value, SPAN)
    begin = np.arange(n - SPAN + 1)
    # A window counts if a passage can begin with it.
    begin = begin[begin + min_words <= words.first[1:][words.row[begin]]]
    return np.unique(begin + np.argmin(low[begin], axis=1)) if len(begin) else begin


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, text_key, text_hash) of every row; texts of equal words have equal keys. text_hash is Spark's own, to find a text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in chunks(batch.column("text")):
                words = Words(data, bounds, NOT_SPACE)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(begin, end - begin), pa.array(words.counts.astype(np.int64)), pa.array(signed(_keys(words))),
                    batch.column("text_hash").slice(begin, end - begin)], ["doc_id", "n_words", "text_key", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, n_words long, text_key long, text_hash long")


def sparse_suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """(suffix, text_key, word): selected positions, with a hash of the words a passage still has there.

    Texts of equal words are one text; a task lists each once.
    """
    length = min_words - SPAN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column("text")):
                words = Words(data, bounds, NOT_SPACE)
                keys = _keys(words)
                fresh = np.zeros(len(keys), dtype=bool)
                for i, k in enumerate(keys.tolist()):
                    if k not in seen:
                        seen.add(k)
                        fresh[i] = True
                if len(seen) > 200_000:  # forgetting only repeats rows
                    seen.clear()
                at = selected(words, min_words)
                at = at[fresh[words.row[at]]]
                suffix, whole = words.windows(length)
                at = at[whole[at]]
                row = words.row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(suffix[at])), pa.array(signed(keys[row])), pa.array((at - words.first[row]).astype(np.int32))],
                    ["suffix", "text_key", "word"])

    return docs.select("text").mapInArrow(run, "suffix long, text_key long, word int")


def equal_neighbours(suffixes: DataFrame) -> DataFrame:
    """The suffixes that begin like a neighbour in sorted order, at another place.

    The sort is one over all tasks, by suffix and place, so a suffix of very
    many places spans tasks. Rows at the ends of a batch are kept unseen; what
    isn't repeated is dropped by the comparison of windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            suffix, key, word = (batch.column(i).to_numpy() for i in range(3))
            fresh = np.ones(len(suffix), dtype=bool)
            fresh[1:] = (suffix[1:] != suffix[:-1]) | (key[1:] != key[:-1]) | (word[1:] != word[:-1])
            suffix, at = suffix[fresh], np.flatnonzero(fresh)
            keep = np.zeros(len(suffix), dtype=bool)
            keep[:1] = keep[-1:] = True
            same = suffix[1:] == suffix[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            at = at[keep]
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(word[at])], ["text_key", "word"])

    order = ("suffix", "text_key", "word")
    return suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "text_key long, word int")


def _windows(texts: DataFrame, min_words: int) -> DataFrame:
    """(window, rep, text_key, start): windows of ``min_words`` words around the listed positions of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in chunks(batch.column("text")):
                words = Words(data, bounds, NOT_SPACE)
                wanted = batch.column("text_key").slice(begin, end - begin).to_numpy()
                mine = signed(_keys(words)) == wanted
                listed = batch.column("words").slice(begin, end - begin)
                row = np.repeat(np.arange(end - begin), listed.value_lengths().to_numpy())
                at = words.first[row] + listed.flatten().to_numpy()
                at = at[mine[row]]
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, np.maximum(at - SPAN + 1, words.first[words.row[at]] if len(at) else at), 1)
                np.add.at(edge, at + 1, -1)
                hashes, whole = words.windows(min_words)
                start = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & whole)
                row = words.row[start]
                rep = batch.column("rep").slice(begin, end - begin).to_numpy()
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(hashes[start])), pa.array(rep[row]), pa.array(wanted[row]),
                    pa.array((start - words.first[row]).astype(np.int32))], ["window", "rep", "text_key", "start"])

    return texts.select("text", "rep", "text_key", "words").mapInArrow(run, "window long, rep long, text_key long, start int")


def _cut_from(start: np.ndarray, own: np.ndarray, at: np.ndarray, min_words: int) -> np.ndarray:
    """The word from which each window of a text is cut, if it isn't the first of its kind.

    start: rising places of the windows; own: the first window of the kind is in
    this text; at: its place. A window is cut from its own beginning on, unless
    the one before it of its kind overlaps it: then the text repeats itself with
    that distance, and is cut behind the windows that begin in the first period.
    """
    begin, mine = start.astype(np.int64), np.flatnonzero(own)
    mine = mine[np.lexsort((start[mine], at[mine]))]
    gap = np.diff(begin[mine])
    near = np.flatnonzero((at[mine][1:] == at[mine][:-1]) & (gap < min_words))
    firsts, late = begin[own & (start == at)], mine[near + 1]
    last = np.searchsorted(firsts, at[late] + gap[near]) - 1
    begin[late] = np.maximum(begin[late], firsts[last] + min_words)
    return begin


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, text_key, n_words, first_word, end_word, source_doc_id, source_word): passages to cut.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased, and
    are counted from 0. Rows of equal words are one text here. Every window of
    ``min_words`` words that stands in more than one place of the texts is cut
    at all of them but the first, by doc_id and then by word. Where a text
    repeats itself with overlap, the windows that begin in the first period of
    the repeat stay whole; nothing else shields a word, so a window that is
    first in a text loses the words that an earlier place has. Each word cut
    stands at an earlier place, and in the end at one that is kept. source names
    the first place of the first window that the passage is cut for. Documents
    without such words have no row, and so have null, empty and short texts.

    Rows of equal words are copies of the one with the smallest doc_id and are
    cut whole, from ``min_words`` words on; of repeated doc_ids with equal words
    one stays. A null doc_id counts as the smallest. Other columns are ignored.
    """
    if min_words < SPAN + GRAM:
        raise ValueError(f"passages must have {SPAN + GRAM} words at least")
    scratch = Scratch(docs.sparkSession, "suffixes")
    digests = scratch.save(text_digests(docs).where(F.col("n_words") >= min_words), "digests")
    texts = digests.groupBy("text_key").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("rep"), "text_hash")).alias("one"), F.count(F.lit(1)).alias("copies"),
        F.min("n_words").alias("n_words")).select("text_key", "one.*", "copies", "n_words")
    kept = scratch.save(equal_neighbours(sparse_suffixes(docs, min_words)), "neighbours")
    wanted = kept.groupBy("text_key").agg(F.collect_list("word").alias("words")).join(texts, "text_key")
    # By id and text: many rows may have one id, or none.
    some = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("rep"), "text", F.xxhash64("text").alias("text_hash")).join(
        wanted.select("text_key", "rep", "text_hash", "words"), ["rep", "text_hash"])
    windows = scratch.save(_windows(some, min_words), "windows")
    place = F.struct("rep", "text_key", "start")
    first = scratch.save(
        windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("places"))
        .where("first <> last").select("window", "first", "places"), "first")
    # A window of very many places is looked up by many tasks.
    hot = first.where(F.col("places") > PLACES_PER_TASK).select("window", F.ceil(F.col("places") / PLACES_PER_TASK).cast("int").alias("_salts"))
    marked = salt_stream_side(windows, hot, ["window"], ["text_key", "start"]).join(
        salt_build_side(first.drop("places"), hot, ["window"]), ["window", "_salt"])
    same = (F.col("rep") == F.col("first.rep")) & (F.col("text_key") == F.col("first.text_key"))
    by_text = scratch.save(
        marked.select("text_key", F.struct("start", same.alias("own"), F.col("first.rep").alias("rep"), F.col("first.start").alias("at")).alias("w"))
        .groupBy("text_key").agg(F.collect_list("w").alias("w")), "marked")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            listed = batch.column("w")
            ends = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])
            start, own, rep, at = (listed.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i, key in enumerate(batch.column("text_key").to_pylist()):
                s, once = np.unique(start[ends[i] : ends[i + 1]], return_index=True)
                o, r, a = (x[ends[i] : ends[i + 1]][once] for x in (own, rep, at))
                begin, cut = _cut_from(s, o, a, min_words), ~o | (s != a)
                if not cut.any():
                    continue
                s, r, a, begin = s[cut], r[cut], a[cut], begin[cut]
                edge = np.zeros(int(s.max()) + min_words + 1, dtype=np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, s + min_words, -1)
                turns = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]]))
                order = np.argsort(begin, kind="stable")
                for low, high in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist()):
                    j = order[np.searchsorted(begin, low, sorter=order)]
                    out.append((key, low, high, int(r[j]), int(a[j])))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], ["text_key", "first_word", "end_word", "source", "source_word"])

    found = by_text.mapInArrow(spans, "text_key long, first_word long, end_word long, source long, source_word long")
    own = found.join(texts, "text_key").select("text_key", F.col("rep").alias("doc"), "n_words", "first_word", "end_word", "source", "source_word")
    # Copies: every row of a text but one that has its smallest doc_id.
    many = texts.where("copies > 1").select("text_key", "rep")
    rows = digests.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "text_key", "n_words").groupBy("doc", "text_key").agg(
        F.count(F.lit(1)).alias("times"), F.min("n_words").alias("n_words"))
    copies = (rows.join(many, "text_key").withColumn("times", F.col("times") - (F.col("doc") == F.col("rep")).cast("int"))
              .where("times > 0").select("text_key", "doc", "n_words", F.lit(0).cast("long").alias("first_word"), F.col("n_words").alias("end_word"),
                                         F.col("rep").alias("source"), F.lit(0).cast("long").alias("source_word")))
    out = scratch.save(own.unionByName(copies), "passages")
    scratch.drop(kept, windows, first, by_text, digests)
    return out.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "text_key", "n_words", "first_word", "end_word",
                      F.when(F.col("source") != _NO_ID, F.col("source")).alias("source_doc_id"), "source_word")


def cut_passages(docs: DataFrame, passages: DataFrame, keep_column: str = "n_chars") -> DataFrame:
    """``docs`` without the passages that ``repeated_passages`` lists for them, with the same columns.

    A passage goes with the white space after it. A document that keeps no word
    is dropped if it had any; a column ``keep_column`` is set to the new length
    in characters where a text is cut. Of rows with one doc_id and equal words
    all but one are dropped. Null, empty and short texts stay as they are, and
    so do all other columns, whatever they are called.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names, kinds = docs.columns, docs.schema
    here, hash_name, listed_name = (free_name(docs, x) for x in ("_doc", "_hash", "_spans"))
    scratch = Scratch(docs.sparkSession, "cut")
    # By id and text: rows without an id have their own spans only.
    listed = (passages.groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "text_key")
              .agg(F.collect_list(F.struct("text_key", "first_word", "end_word", F.col("source_doc_id").eqNullSafe(F.col("doc_id")).alias("own"))).alias("spans")))
    homes = text_digests(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "text_key", "text_hash").distinct()
    spans = scratch.save(
        homes.join(listed, ["doc", "text_key"]).groupBy("doc", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        .select(F.col("doc").alias(here), F.col("text_hash").alias(hash_name), F.col("spans").alias(listed_name)), "spans")
    joined = (docs.withColumn(here, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn(hash_name, F.xxhash64("text"))
              .join(spans, [here, hash_name], "left").drop(here, hash_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index("text")
        length = names.index(keep_column) if keep_column in names else None
        once: set[tuple] = set()
        for batch in batches:
            for begin, end, data, bounds in chunks(batch.column("text")):
                part = batch.slice(begin, end - begin)
                listed = part.column(listed_name).to_pylist()
                texts, keep = part.column("text").to_pylist(), np.ones(end - begin, dtype=bool)
                sizes = part.column(keep_column).to_pylist() if length is not None else None
                if any(listed):
                    words = Words(data, bounds, NOT_SPACE)
                    keys, raw, ids = signed(_keys(words)).tolist(), data.tobytes(), part.column("doc_id").to_pylist()
                    for i, spans_here in enumerate(listed):
                        mine = [s for s in spans_here or () if s["text_key"] == keys[i]]
                        whole = [s for s in mine if s["own"] and s["first_word"] == 0 and s["end_word"] == words.counts[i]]
                        if whole and (ids[i], keys[i]) not in once:
                            once.add((ids[i], keys[i]))  # rows of one doc_id meet in one task; the first stays
                            mine = [s for s in mine if s not in whole]
                        if not mine:
                            continue
                        starts = np.append(words.start[words.first[i] : words.first[i + 1]], bounds[i + 1])
                        gone = np.zeros(words.counts[i], dtype=bool)
                        for s in mine:
                            gone[s["first_word"] : s["end_word"]] = True
                        if gone.all():
                            keep[i] = False
                            continue
                        pieces, flips = [raw[bounds[i] : starts[0]]], np.flatnonzero(np.diff(np.concatenate([[1], gone.astype(np.int8), [1]])))
                        for a, b in zip(flips[::2].tolist(), flips[1::2].tolist()):
                            pieces.append(raw[starts[a] : starts[b]])
                        texts[i] = b"".join(pieces).decode()
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                columns = list(part.columns[: len(names)])
                columns[place] = pa.array(texts, type=pa.string())
                if length is not None:
                    columns[length] = pa.array(sizes, type=columns[length].type)
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return joined.select(*[F.col(f"`{n}`") for n in kinds.names], F.col(f"`{listed_name}`")).mapInArrow(run, fields)
