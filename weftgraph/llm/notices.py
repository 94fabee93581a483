"""Short licence notices, exact and with a few edits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.text_hash import LETTERS, Words, chunks

#: (label, phrase, most edits): lower case, words parted by one blank.
NOTICES = (
    ("apache", "licensed under the apache license", 3),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("cc-by", "licensed under cc by", 2),
    ("cc-by", "creative commons attribution", 3),
    ("gpl", "gnu general public license", 3),
    ("lgpl", "gnu lesser general public license", 2),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge", 4),
    ("mpl", "mozilla public license", 2),
    ("reserved", "all rights reserved", 2),
)


def seeds(phrase: str, edits: int) -> list[tuple[int, bytes]]:
    """(place, piece): ``edits`` + 1 pieces of the phrase, of which any fuzzy match holds one unchanged."""
    raw = phrase.encode()
    cuts = [round(i * len(raw) / (edits + 1)) for i in range(edits + 2)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:])]


def plain_words(data: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of each text, A-Z lower-cased and each followed by one blank, and the texts' bounds in that."""
    inside = LETTERS[data]
    after = np.zeros(len(data), dtype=bool)
    after[1:] = inside[:-1]
    after[bounds[:-1][bounds[:-1] < len(data)]] = False
    # A word that ends a text has no byte after it to become its blank, so room is made there.
    ends = np.zeros(len(data), dtype=np.int64)
    closing = bounds[1:][np.diff(bounds) > 0] - 1
    ends[closing] = inside[closing]
    width = (inside | after).astype(np.int64) + ends
    place = np.concatenate([[0], np.cumsum(width)])
    out = np.full(place[-1], 32, dtype=np.uint8)
    upper = (data >= 65) & (data <= 90)
    out[place[:-1][inside]] = (data + 32 * upper.astype(np.uint8))[inside]
    return out.tobytes(), place[bounds]


def fuzzy_places(text: bytes, bounds: np.ndarray, notices: Sequence[tuple[str, str, int]]) -> list[tuple[int, int, int, int, int]]:
    """(row, notice, begin, end, edits) of the fuzzy matches, without overlaps of one notice."""
    import regex

    found = []
    for number, (_, phrase, edits) in enumerate(notices):
        near = regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(phrase.encode(), literal_spaces=True), edits))
        starts = set()
        for place, piece in seeds(phrase, edits):
            at = text.find(piece)
            while at >= 0:
                starts.add(at - place)
                at = text.find(piece, at + 1)
        last = -1
        for start in sorted(starts):
            if not len(bounds) or start + len(phrase) + edits <= last:
                continue
            row = int(np.searchsorted(bounds, min(max(start + len(phrase) // 2, 0), len(text) - 1), side="right")) - 1
            low, high = max(start - edits, int(bounds[row]), last), min(start + len(phrase) + edits, int(bounds[row + 1]))
            if high > low and (m := near.search(text[low:high])):
                begin, end = low + m.start(), low + m.end()
                if begin >= last:
                    found.append((row, number, begin, end, sum(m.fuzzy_counts)))
                    last = end
    return found


def scan_notices(docs: DataFrame, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """Licence notices of every row of ``docs``.

    Words are runs of digits, ASCII letters and characters outside ASCII, A-Z
    lower-cased. ``phrases`` (phrase, label) count where their words stand one
    after another: n_base counts all places, first_word and last_word are their
    smallest and largest first word, from 0, else null. ``notices`` are looked
    for with up to their edits, in bytes, in the words joined by blanks; spans
    has label, first word, end word and edits of each place found. labels has
    the phrases' and the notices' labels, sorted. The score is the likeness of
    the best place, 1 for a phrase or an exact notice, 0 without any. A null
    text counts as empty; repeated rows each have a result; other columns are
    ignored.
    """
    wanted = []
    for phrase, label in phrases:
        raw = np.frombuffer(phrase.encode(), dtype=np.uint8)
        wanted.append((label, Words(raw, np.array([0, len(raw)]), LETTERS).hash))
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
              "spans array<struct<label: string, first_word: long, end_word: long, edits: int>>")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in chunks(batch.column("text")):
                n = end - begin
                words = Words(data, bounds, LETTERS)
                count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                for label, phrase in wanted:
                    k = len(phrase)
                    at = np.arange(max(0, len(words) - k + 1))
                    for j in range(k):
                        at = at[words.hash[at + j] == phrase[j]]
                    at = at[words.row[at] == words.row[at + k - 1]]
                    rows = words.row[at]
                    place = at - words.first[rows]
                    np.add.at(count, rows, 1)
                    np.minimum.at(low, rows, place)
                    np.maximum.at(high, rows, place)
                    for r in set(rows.tolist()):
                        base[r].add(label)
                all_labels = [set(b) for b in base]
                score = np.array([1.0 if b else 0.0 for b in base])
                spans: list[list[dict]] = [[] for _ in range(n)]
                text, edges = plain_words(data, bounds)
                for row, number, first, last, edits in fuzzy_places(text, edges, notices):
                    label, phrase, _ = notices[number]
                    all_labels[row].add(label)
                    score[row] = max(score[row], 1 - edits / len(phrase))
                    word = text.count(b" ", int(edges[row]), first)
                    spans[row].append({"label": label, "first_word": word, "end_word": word + text.count(b" ", first, last - 1) + 1, "edits": edits})
                none = count == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(begin, n), pa.array(words.counts.astype(np.int64)), pa.array(count),
                    pa.array(low, mask=none), pa.array(high, mask=none), pa.array([",".join(sorted(b)) for b in base]),
                    pa.array([",".join(sorted(b)) for b in all_labels]), pa.array(score), pa.array(spans, type=span)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
