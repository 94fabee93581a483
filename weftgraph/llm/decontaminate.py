"""Benchmark items found in training texts by BM25 over an inverted index of the items.

The items are the indexed side. Every passage of every training text is a
query, and all items whose score reaches a share of the item's own score are
retrieved, whatever their number. Postings are in blocks of items with the
block's largest impact: terms of a passage that together can't reach a share of
the threshold are not looked up at first (WAND's pivot), blocks whose bound
stays below the threshold are left out (block-max), then items of the other
blocks whose own bound stays below it, and the rest is scored in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.text_hash import LETTERS, Words, chunks

K1, B = 1.2, 0.75
BLOCK = 8
#: Share of the threshold that the terms before the pivot stay below: the smaller, the more terms are looked up
#: and the fewer items are scored in full.
PIVOT_SHARE = 0.6
#: Postings of the items that one pass over the texts carries to every task.
PASS_POSTINGS = 2_000_000
#: Bytes of text that a task searches at a time; the search takes up to about 190 times as many.
AT_ONCE = 1 << 18


class ItemIndex:
    """Impacts of a set of items, divided by each item's own score, so one threshold fits all.

    Terms are numbered by their largest impact, rising. items: (item_id, words
    of the question, words of the answer) as lists of hashes.
    """

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], df: dict[int, int], n_items: int, mean_words: float):
        self.items = items
        self.reach = max(len(q) + len(a) for _, q, a in items)
        postings: dict[int, list[tuple[int, float]]] = {}
        for number, (_, question, answer) in enumerate(items):
            terms, tf = np.unique(np.concatenate([question, answer]), return_counts=True)
            share = np.array([df[t] for t in terms.tolist()])
            idf = np.log(1 + (n_items - share + 0.5) / (share + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(question) + len(answer)) / mean_words))
            for t, x in zip(terms.tolist(), (impact / impact.sum()).tolist()):
                postings.setdefault(t, []).append((number, x))
        rising = sorted(postings, key=lambda t: (max(x for _, x in postings[t]), t))
        self.largest = np.array([max(x for _, x in postings[t]) for t in rising])
        hashes = np.array(rising, dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        # Hashes by their first bits: a word is compared with the one or two of its place.
        self.shift = np.uint64(64 - max(8, len(hashes).bit_length()))
        self.place_first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.blocks = -(-len(items) // BLOCK)
        cells: list[tuple[int, int, float]] = []
        places, self.post_item, self.post_impact = [0], [], []
        for number, t in enumerate(rising):
            for item, x in postings[t]:
                if not cells or cells[-1][:2] != (number, item // BLOCK):
                    if cells:
                        places.append(len(self.post_item))
                    cells.append((number, item // BLOCK, x))
                cells[-1] = (*cells[-1][:2], max(cells[-1][2], x))
                self.post_item.append(item)
                self.post_impact.append(x)
        places.append(len(self.post_item))
        self.cell_key = np.array([n * self.blocks + b for n, b, _ in cells])
        self.cell_block, self.cell_max = np.array([b for _, b, _ in cells]), np.array([x for _, _, x in cells])
        self.cell_first = np.array(places)
        self.term_first = np.searchsorted(self.cell_key, np.arange(len(rising) + 1) * self.blocks)
        self.post_item, self.post_impact = np.array(self.post_item), np.array(self.post_impact)
        # Items of a term rise, so postings are sorted by these keys.
        self.post_key = np.repeat(np.arange(len(rising)), np.diff(self.cell_first[self.term_first])) * len(items) + self.post_item

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words of no item."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        place = (hashes >> self.shift).astype(np.int64)
        at, end = self.place_first[place], self.place_first[place + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.hashes[at] == hashes[left]
            out[left[same]] = self.order[at[same]]
            more = ~same & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return out


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) for every place of the ranges first..last."""
    size = last - first
    owner = np.repeat(np.arange(len(first)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - first, size)


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[starts], np.add.reduceat(value[order], starts) if len(starts) else value[:0]


def _totals(key: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``_summed`` for values above 0 and keys below ``size``, without a sort if there is not much room for few values."""
    if size > 4 * len(key) + 1024:
        return _summed(key, value)
    total = np.bincount(key, weights=value, minlength=size)
    found = np.flatnonzero(total)
    return found, total[found]


def retrieve(index: ItemIndex, words: Words, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(row, first word, end word, item, score) of all passages and items at or above the threshold.

    Passages are twice as long as the longest item and begin once in its
    length, so any run of words as long as an item is inside of one.
    """
    step, slack = index.reach, 1e-9
    term = index.numbers(words.hash) if len(words) else np.zeros(0, dtype=np.int64)
    known = np.flatnonzero(term >= 0)
    if not len(known):
        return []
    each = np.maximum(1, -(-words.counts // step))
    base = np.concatenate([[0], np.cumsum(each)])
    row = words.row[known]
    place = (known - words.first[row]) // step
    home, vocabulary = base[row] + place, len(index.largest)
    key = np.unique(np.concatenate([home * vocabulary + term[known], (home[place > 0] - 1) * vocabulary + term[known][place > 0]]))
    passage, number = key // vocabulary, key % vocabulary
    bound = np.bincount(passage, weights=index.largest[number], minlength=base[-1])
    alive = bound[passage] >= threshold - slack
    passage, number = passage[alive], number[alive]
    if not len(passage):
        return []
    starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    names, size = passage[starts], np.diff(np.append(starts, len(passage)))
    at = np.repeat(np.arange(len(starts)), size)
    rising = np.cumsum(index.largest[number])
    rising -= np.repeat(rising[starts] - index.largest[number[starts]], size)
    needed = rising >= PIVOT_SHARE * threshold
    spare = np.bincount(at, weights=np.where(needed, 0, index.largest[number]), minlength=len(starts))
    owner, cell = _expand(index.term_first[number[needed]], index.term_first[number[needed] + 1])
    slot, items = at[needed][owner], len(index.items)
    in_block = slot * index.blocks + index.cell_block[cell]
    found, bounds = _totals(in_block, index.cell_max[cell], len(starts) * index.blocks)
    kept = np.zeros(len(starts) * index.blocks, dtype=bool)
    kept[found[bounds + spare[found // index.blocks] >= threshold - slack]] = True
    there = kept[in_block]
    slot, cell = slot[there], cell[there]
    if not len(slot):
        return []
    inner, post = _expand(index.cell_first[cell], index.cell_first[cell + 1])
    pair, bounds = _totals(slot[inner] * items + index.post_item[post], index.post_impact[post], len(starts) * items)
    pair = pair[bounds + spare[pair // items] >= threshold - slack]
    if not len(pair):
        return []
    owner, place = _expand(starts[pair // items], (starts + size)[pair // items])
    wanted = number[place] * items + (pair % items)[owner]
    post = np.minimum(np.searchsorted(index.post_key, wanted), len(index.post_key) - 1)
    there = index.post_key[post] == wanted
    pair, score = _summed(pair[owner[there]], index.post_impact[post[there]])
    out = []
    for p, s in zip(pair[score >= threshold - slack].tolist(), score[score >= threshold - slack].tolist()):
        passage_id = int(names[p // items])
        r = int(np.searchsorted(base, passage_id, side="right")) - 1
        first = (passage_id - int(base[r])) * step
        out.append((r, first, min(first + 2 * step, int(words.counts[r])), p % items, s))
    return out


def ordered_overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the words of ``part`` that stand in the passage in their order (longest common subsequence)."""
    if not len(part):
        return 1.0
    masks: dict[int, int] = {}
    for i, w in enumerate(part.tolist()):
        masks[w] = masks.get(w, 0) | (1 << i)
    row, full = (1 << len(part)) - 1, (1 << len(part)) - 1
    for w in passage.tolist():
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return (len(part) - row.bit_count()) / len(part)


def shared_words(item: np.ndarray, passage: np.ndarray) -> float:
    """Share of the words of ``item`` that the passage has, each as often as the item."""
    words, times = np.unique(item, return_counts=True)
    there = (passage[None, :] == words[:, None]).sum(axis=1)
    return float(np.minimum(times, there).sum() / len(item))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: cut after the last ``?`` with words behind it, else at the last line
    break, else before the last sentence; a single sentence is cut at two thirds of its words."""
    for cut in (r"^(.*\?)(.*\w.*)$", r"^(.*\w.*)\n(.*\w.*)$", r"^(.*\w.*[.!]\s)(.*\w.*)$"):
        if m := re.match(cut, text.strip(), re.DOTALL):
            return m[1], m[2]
    words = text.split()
    at = max(1, round(len(words) * 2 / 3))
    return " ".join(words[:at]), " ".join(words[at:])


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return Words(raw, np.array([0, len(raw)]), LETTERS).hash if len(raw) else np.zeros(0, dtype=np.uint64)


def _split_items(items: DataFrame) -> DataFrame:
    """(item_id, question, answer, n): word hashes of both parts, and how many they are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [tuple(_hashes(x) for x in split_item(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id"), *(pa.array([p[i].view(np.int64) for p in parts], type=pa.list_(pa.int64())) for i in (0, 1))],
                ["item_id", "question", "answer"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(read, "item_id long, question array<long>, answer array<long>")
    return rows.withColumn("n", F.size("question") + F.size("answer"))


def _collected(rows: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return sorted(((r.item_id, *(np.array(x, dtype=np.int64).view(np.uint64) for x in (r.question, r.answer))) for r in rows.collect()),
                  key=lambda x: (x[0] is None, x[0] or 0))


def build_indexes(items: DataFrame) -> list[ItemIndex]:
    """Indexes over all items with words, each for one pass over the texts.

    Document frequencies and the mean length are over all those items. Items
    are dealt to passes by length and then by hash, so an index has about
    ``PASS_POSTINGS`` postings at most, whatever the number of items.
    """

    # Bands only bound how much longer a passage is than its items: up to 7 words, 64, 256 and so on.
    rows = (_split_items(items).where(F.col("n") > 0)
            .withColumn("band", F.when(F.col("n") < 8, -1).otherwise(F.ceil(F.greatest(F.log2(F.col("n") / 64) / 2, F.lit(0.0)))).cast("int")))
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("words")).collect()
    n_items, total = sum(s["items"] for s in sizes), sum(s["words"] for s in sizes)
    terms = rows.select(F.explode(F.array_distinct(F.concat("question", "answer"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = []
    for size in sorted(sizes, key=lambda s: s["band"]):
        passes = -(-size["words"] // PASS_POSTINGS)
        for number in range(passes):
            mine = rows.where((F.col("band") == size["band"]) & (F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(passes)) == number))
            own = mine.select(F.explode(F.concat("question", "answer")).alias("term")).distinct()
            df = {r.term % (1 << 64): r.df for r in terms.join(own, "term").collect()}
            found = _collected(mine)
            if found:
                out.append(ItemIndex(found, df, n_items, total / n_items))
    return out


def _verified(index: ItemIndex, texts: pa.Array, threshold: float, overlap: float) -> Iterator[tuple]:
    """(row, item, score, first word, question's overlap, answer's overlap) of the items that stand in the texts."""
    for begin, _, data, bounds in chunks(texts, AT_ONCE):
        yield from _verified_chunk(index, begin, threshold, overlap, Words(data, bounds, LETTERS))


def _verified_chunk(index: ItemIndex, begin: int, threshold: float, overlap: float, words: Words) -> Iterator[tuple]:
    for row, first, end, number, score in retrieve(index, words, threshold):
        _, question, answer = index.items[number]
        passage, own = words.hash[words.first[row] + first : words.first[row] + end], len(question) + len(answer)
        if min(ordered_overlap(question, passage), ordered_overlap(answer, passage)) < overlap:
            continue
        # The same in a passage of the item's own measure: twice its words, beginning once in its length.
        best = max((min(q, a, shared_words(np.concatenate([question, answer]), passage[i : i + 2 * own])), -i, q, a)
                   for i in range(0, max(len(passage) - own, 1), own)
                   for q, a in [tuple(ordered_overlap(x, passage[i : i + 2 * own]) for x in (question, answer))])
        if best[0] >= overlap:
            yield begin + row, number, score, first - best[1], best[2], best[3]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """(doc_id, item_id, score, first_word, question_overlap, answer_overlap): items that stand in a text.

    Words are runs of digits, ASCII letters and characters outside ASCII, A-Z
    lower-cased. The score is BM25 of the item for the passage, divided by the
    item's score for itself. Items at ``threshold`` or above are verified, by
    one rule for all lengths: of the question's words and of the answer's, a
    share of ``overlap`` must stand in their order in a run of twice the item's
    words, and so many of both together, so that no word serves twice; a part
    of fewer than five words must be there whole. One row for
    each document and item, with the best passage, the first of equal ones;
    first_word is where its run begins. Items without words find nothing; null
    and empty texts have no row; repeated rows count once; other columns are
    ignored.
    """
    columns = "doc_id long, item_id long, score double, first_word long, question_overlap double, answer_overlap double"
    names = [c.split()[0] for c in columns.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.select("doc_id").where("false").select("doc_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")[1:]])
    for index in build_indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = list(_verified(index, batch.column("text"), threshold, overlap))
                ids = batch.column("doc_id").to_pylist() if out else []
                lists = list(zip(*((ids[r], index.items[n][0], s, f, q, a) for r, n, s, f, q, a in out))) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=t) for x, t in zip(lists, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()))], names)

        found = found.unionByName(rows.mapInArrow(run, columns))
    best = F.max(F.struct("score", (-F.col("first_word")).alias("at"), "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", (-F.col("best.at")).alias("first_word"), "best.question_overlap", "best.answer_overlap")


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item, judged as ``find_leaks`` does; nothing is shuffled."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for index in build_indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for hit in _verified(index, batch.column("text"), threshold, overlap):
                    keep[hit[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, fields)
    return docs
