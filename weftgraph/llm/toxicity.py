"""Toxicity by a bidirectional gated recurrent network over overlapping windows of words.

A word enters as a learned vector of its own, if the fitted documents often
have it, beside the mean of learned vectors of its character trigrams. Two
recurrent passes, one from each side, read a window; attention pools their
states into one number. A text is as toxic as its most toxic window.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.quality import held_out
from weftgraph.llm.spans import WINDOW_BYTES, lower_ascii, ranges, windows
from weftgraph.llm.text_hash import LETTERS, Words, mix

WINDOW, STRIDE = 32, 24
WORD_WIDTH, CHAR_WIDTH, TRIGRAMS = 10, 12, 8192
HIDDEN, ATTENTION = 8, 6
#: Words with a vector of their own: the most frequent ones by fitted documents, from so many documents on.
VOCABULARY, LEAST_DOCUMENTS = 20_000, 15
#: Bounds of a fit: labelled documents of each label, by the smallest hash of their doc_id, and windows of a document.
FIT_DOCUMENTS, FIT_WINDOWS = 2_000, 64
ROUNDS, STEPS, BATCH, RATE, DECAY, HIDE = 10, 60, 64, 0.01, 4e-4, 0.15


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    """By one exponential, which takes half the time of numpy's own."""
    with np.errstate(over="ignore"):
        return 1 - 2 / (1 + np.exp(2 * x))


class Lexicon:
    """Distinct words with their trigrams: hash, the trigrams of all words end to end, each word's first one."""

    def __init__(self, words: Words):
        self.hash, some, self.number = np.unique(words.hash, return_index=True, return_inverse=True)
        data, start, width = lower_ascii(words.data), words.start[some], words.end[some] - words.start[some]
        # ^word$: a word of n bytes has n trigrams
        begin = np.cumsum(width + 2) - width - 2
        padded = np.full(int((width + 2).sum()) + 2, 36, dtype=np.uint64)
        padded[begin] = 94
        padded[ranges(begin + 1, width)] = data[ranges(start, width)]
        place = ranges(begin, width)
        triple = padded[place] | (padded[place + 1] << np.uint64(8)) | (padded[place + 2] << np.uint64(16))
        self.trigrams = (mix(triple) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(width)])

    def __len__(self) -> int:
        return len(self.hash)


def window_count(n_words: np.ndarray) -> np.ndarray:
    """How many windows texts have; the last one may be shorter, and a text without words has an empty one."""
    return np.maximum(1, -(-(n_words - WINDOW + STRIDE) // STRIDE))


def laid_out(number: np.ndarray, first: np.ndarray, end: np.ndarray, none: int) -> np.ndarray:
    """Word numbers of windows that begin at word ``first`` of texts that end before ``end``; ``none`` fills up."""
    place = first[:, None] + np.arange(WINDOW)
    there = place < end[:, None]
    return np.where(there, np.append(number, none)[np.where(there, place, len(number))], none)


class WindowNetwork:
    """The network; ``p`` holds its parameters, ``known`` the hashes of words with a vector (sorted)."""

    def __init__(self, known: np.ndarray, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.known = known
        wide = WORD_WIDTH + CHAR_WIDTH
        size = {"E": (len(known) + 1, WORD_WIDTH), "C": (TRIGRAMS, CHAR_WIDTH), "W": (2, wide, 3 * HIDDEN), "U": (2, HIDDEN, 3 * HIDDEN),
                "A": (2 * HIDDEN, ATTENTION), "v": (ATTENTION,), "c": (2 * HIDDEN,)}
        scale = {"E": 0.1, "C": 0.3, "W": wide**-0.5, "U": HIDDEN**-0.5, "A": (2 * HIDDEN) ** -0.5, "v": 0.5, "c": 0.3}
        self.p = {k: draw.normal(0, scale[k], s).astype(np.float32) for k, s in size.items()}
        self.p |= {"b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "d": np.zeros((2, HIDDEN, 1), np.float32),
                   "a": np.zeros(ATTENTION, np.float32), "c0": np.zeros(1, np.float32)}
        self.shift = 0.0

    def inputs(self, lexicon: Lexicon, own: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Inputs of the words ``some``; ``own`` numbers the vector of each word of the lexicon, 0 being that of all others."""
        each = np.diff(lexicon.first)[some]
        chars = np.add.reduceat(self.p["C"][lexicon.trigrams[ranges(lexicon.first[some], each)]], np.cumsum(each) - each, axis=0) / each[:, None]
        return np.concatenate([self.p["E"][own[some]], chars.astype(self.p["C"].dtype)], axis=1)

    def numbers(self, lexicon: Lexicon) -> np.ndarray:
        """The number of each word's own vector."""
        if not len(self.known):
            return np.zeros(len(lexicon), dtype=np.int64)
        at = np.searchsorted(self.known, lexicon.hash)
        return np.where(self.known[np.minimum(at, len(self.known) - 1)] == lexicon.hash, at + 1, 0)

    def vectors(self, lexicon: Lexicon) -> np.ndarray:
        """Inputs of all words, and a row of zeros that fills windows up."""
        own = self.numbers(lexicon)
        parts = [self.inputs(lexicon, own, np.arange(i, min(i + 65536, len(lexicon)))) for i in range(0, len(lexicon), 65536)]
        return np.concatenate([*parts, np.zeros((1, WORD_WIDTH + CHAR_WIDTH), dtype=self.p["E"].dtype)])

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows given by rows of ``x``; the last row of x stands for no word.

        Arrays have the windows last, so that steps work on long runs of numbers.
        """
        p, (n, length) = self.p, index.shape
        ahead, seen = x @ p["W"] + p["b"], index.T
        given = np.empty((length, 2, 3 * HIDDEN, n), dtype=x.dtype)
        given[:, 0] = ahead[0][seen].swapaxes(1, 2)
        given[:, 1] = ahead[1][seen[::-1]].swapaxes(1, 2)
        mask = (seen != len(x) - 1).astype(x.dtype)
        there = np.stack([mask, mask[::-1]], axis=1)[:, :, None]
        turned = np.ascontiguousarray(p["U"].swapaxes(1, 2))
        states = np.empty((length, 2, HIDDEN, n), dtype=x.dtype)
        h, memory = np.zeros((2, HIDDEN, n), dtype=x.dtype), []
        for step in range(length):
            u = turned @ h
            gates = _sigmoid(given[step, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            inner = u[:, 2 * HIDDEN :] + p["d"]
            new = _tanh(given[step, :, 2 * HIDDEN :] + r * inner)
            if keep:
                memory.append((h, z, r, inner, new))
            h = np.multiply(new + z * (h - new), there[step], out=states[step])
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)
        t = _tanh(p["A"].T @ both + p["a"][:, None])
        e = np.where(mask > 0, p["v"] @ t, x.dtype.type(-1e30))
        e = np.exp(e - e.max(axis=0)) * mask
        share = e / np.maximum(e.sum(axis=0), 1e-30)
        pooled = np.einsum("tn,thn->hn", share, both)
        logit = p["c"] @ pooled + p["c0"][0]
        return (logit, (x, seen, there, both, t, share, pooled, memory)) if keep else logit

    def backward(self, kept, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters behind the inputs, and of each input, places first."""
        p = self.p
        x, seen, there, both, t, share, pooled, memory = kept
        length, n = seen.shape
        d = {"c": pooled @ dlogit, "c0": np.array([dlogit.sum()])}
        dpooled = p["c"][:, None] * dlogit
        dshare = np.einsum("thn,hn->tn", both, dpooled)
        de = share * (dshare - (share * dshare).sum(axis=0))
        d["v"] = np.einsum("tn,tan->a", de, t)
        dt = de[:, None] * p["v"][:, None] * (1 - t * t)
        d["A"], d["a"] = np.einsum("thn,tan->ha", both, dt, optimize=True), dt.sum(axis=(0, 2))
        dboth = share[:, None] * dpooled + p["A"] @ dt
        dstate = np.stack([dboth[:, :HIDDEN], dboth[::-1, HIDDEN:]], axis=1)
        d["U"], d["d"] = np.zeros_like(p["U"]), np.zeros_like(p["d"])
        dgiven = np.empty((length, 2, 3 * HIDDEN, n), dtype=x.dtype)
        dh = np.zeros((2, HIDDEN, n), dtype=x.dtype)
        for step in reversed(range(length)):
            dh = (dh + dstate[step]) * there[step]
            h, z, r, inner, new = memory[step]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dinner = dnew * r
            gate = np.concatenate([dz, dnew * inner * r * (1 - r)], axis=1)
            dgiven[step, :, : 2 * HIDDEN], dgiven[step, :, 2 * HIDDEN :] = gate, dnew
            du = np.concatenate([gate, dinner], axis=1)
            d["U"] += h @ du.swapaxes(1, 2)
            d["d"] += dinner.sum(axis=2, keepdims=True)
            dh = dh * z + p["U"] @ du
        flat = np.stack([dgiven[:, 0], dgiven[::-1, 1]]).swapaxes(2, 3).reshape(2, length * n, -1)
        d["W"] = x[seen.ravel()].T @ flat
        d["b"] = flat.sum(axis=1, keepdims=True)
        return d, flat[0] @ p["W"][0].T + flat[1] @ p["W"][1].T

    def gradients(self, lexicon: Lexicon, own: np.ndarray, index: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss of windows with labels ``y``."""
        some, place = np.unique(index[index < len(lexicon)], return_inverse=True)
        x = np.zeros((len(some) + 1, WORD_WIDTH + CHAR_WIDTH), dtype=self.p["E"].dtype)
        if len(some):
            x[:-1] = self.inputs(lexicon, own, some)
        small = np.full(index.shape, len(some))
        small[index < len(lexicon)] = place
        logit, kept = self.forward(x, small, keep=True)
        d, dx = self.backward(kept, ((_sigmoid(logit) - y) / len(y)).astype(x.dtype))
        total = np.zeros_like(x)
        np.add.at(total, small.T.ravel(), dx)
        d["E"], d["C"] = np.zeros_like(self.p["E"]), np.zeros_like(self.p["C"])
        np.add.at(d["E"], own[some], total[:-1, :WORD_WIDTH])
        each = np.diff(lexicon.first)[some]
        np.add.at(d["C"], lexicon.trigrams[ranges(lexicon.first[some], each)], np.repeat(total[:-1, WORD_WIDTH:] / each[:, None], each, axis=0))
        return d

    def score(self, x: np.ndarray, index: np.ndarray, at_once: int = 512) -> np.ndarray:
        """Logits of any number of windows."""
        parts = [self.forward(x, index[i : i + at_once]) for i in range(0, len(index), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=x.dtype)


def fit_windows(texts: list[str], labels: np.ndarray, share: float, rounds: int = ROUNDS, steps: int = STEPS) -> WindowNetwork:
    """A network fitted on labelled texts in a fixed order.

    In each round every document is stood for by its most toxic window so far
    (in the first one by any), and batches have as many toxic documents as
    others; the logit is then shifted to the true ``share`` of label 1. With
    one label only, or no documents, all scores are the share.
    """
    draw = np.random.default_rng(17)
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds, LETTERS)
    lexicon = Lexicon(words)
    pair = np.unique(np.stack([words.row, lexicon.number]), axis=1) if len(words) else np.zeros((2, 0), dtype=np.int64)
    spread = np.bincount(pair[1], minlength=len(lexicon))
    often = np.argsort(-spread, kind="stable")[:VOCABULARY]
    net = WindowNetwork(np.sort(lexicon.hash[often[spread[often] >= LEAST_DOCUMENTS]]))
    if not 0 < labels.sum() < len(labels):
        net.p["c"][:] = 0
        net.shift = float(np.log(share / (1 - share)))
        return net
    firsts, owners = [], []
    for row, count in enumerate(words.counts.tolist()):
        mine = STRIDE * np.arange(window_count(count))
        if len(mine) > FIT_WINDOWS:
            mine = np.sort(draw.choice(mine, FIT_WINDOWS, replace=False))
        firsts.append(words.first[row] + mine)
        owners.append(np.full(len(mine), row))
    first, owner = np.concatenate(firsts), np.concatenate(owners)
    index = laid_out(lexicon.number, first, words.first[1:][owner], len(lexicon))
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    kinds = [np.flatnonzero(labels == k) for k in (0, 1)]
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    own = net.numbers(lexicon)
    for turn in range(rounds):
        if turn == 0:
            chosen = begin + (draw.random(len(begin)) * np.diff(np.append(begin, len(owner)))).astype(np.int64)
        else:
            logit = net.score(net.vectors(lexicon), index)
            chosen = np.lexsort((np.arange(len(owner)), -logit, owner))[begin]
        for _ in range(steps):
            step += 1
            batch = np.concatenate([draw.choice(k, BATCH // 2) for k in kinds])
            hidden = np.where(draw.random(len(own)) < HIDE, 0, own)  # words whose own vector is not seen this time
            rate = RATE * (1 - (step - 1) / (rounds * steps))
            for k, g in net.gradients(lexicon, hidden, index[chosen[batch]], labels[batch]).items():
                g = g + DECAY * net.p[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(net.p[k].dtype)
    net.shift = float(np.log(share / (1 - share)))
    return net


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = FIT_DOCUMENTS) -> WindowNetwork:
    """A network for ``label`` from the labelled rows that are not held out.

    At most ``bound`` documents of each label are read, those with the smallest
    hash of their doc_id, and ``FIT_WINDOWS`` windows of each; one task fits on
    them. Null labels and ids are left out, of repeated labels the largest and
    of repeated documents the last text counts. Only the text is an input.
    """
    marked = (labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).where("_id is not null and _label is not null")
              .where(~held_out(F.col("_id"))).groupBy("_id").agg((F.max("_label") > 0).alias("_label")))
    counts = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    share = (counts.get(True, 0) + 0.5) / (sum(counts.values()) + 1)
    chosen = [marked.where(F.col("_label") == kind).orderBy(F.xxhash64("_id"), "_id").limit(bound) for kind in (False, True)]
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("_id"))
            .groupBy("_id", "_label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("_id", "_label", "text"))))
        net = fit_windows([r[2] for r in found], np.array([float(r[1]) for r in found]), share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.p, net.known, net.shift))], type=pa.binary())], ["model"])

    fitted = rows.repartition(1).mapInArrow(fit, "model binary").first()
    net = WindowNetwork(np.zeros(0, dtype=np.uint64))
    if fitted:
        net.p, net.known, net.shift = pickle.loads(fitted.model)
    else:
        net.p["c"][:] = 0
        net.shift = float(np.log(share / (1 - share)))
    return net


class _Reader:
    """Scores of texts that come in windows of bytes; a long text goes on from the words that its last piece left over."""

    def __init__(self, net: WindowNetwork):
        self.net, self.rest, self.done, self.best = net, None, 0, (-np.inf, 0)

    def read(self, data: np.ndarray, bounds: np.ndarray, goes_on: bool) -> list[tuple[float, int, int]] | None:
        """Logit, number of windows and first word of the best window of each text; None if the text goes on."""
        if self.rest is None and not goes_on:
            return self._windows(data, bounds)
        if self.rest is not None:
            data = np.concatenate([self.rest, data])
        words = Words(data, np.array([0, len(data)]), LETTERS)
        n = len(words)
        first = STRIDE * np.arange(window_count(n))
        if goes_on:
            first = first[first + WINDOW <= n]
        elif self.done and n <= WINDOW - STRIDE:
            first = first[:0]
        if len(first):
            logit = self._logits(words, first, np.full(len(first), n))
            at = int(np.argmax(logit))
            if logit[at] > self.best[0]:
                self.best = float(logit[at]), int(first[at]) + self.done * STRIDE
        self.done += len(first)
        if goes_on:
            after = len(first) * STRIDE
            self.rest = data[words.start[after] :] if after < n else data[:0]
            return None
        out = [(self.best[0], self.done, self.best[1])]
        self.rest, self.done, self.best = None, 0, (-np.inf, 0)
        return out

    def _logits(self, words: Words, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        lexicon = Lexicon(words)
        x = self.net.vectors(lexicon)
        return np.concatenate([  # places of a part of the windows at a time
            self.net.score(x, laid_out(lexicon.number, first[i : i + 8192], end[i : i + 8192], len(lexicon)))
            for i in range(0, len(first), 8192)])

    def _windows(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[float, int, int]]:
        words = Words(data, bounds, LETTERS)
        each = window_count(words.counts)
        owner = np.repeat(np.arange(len(each)), each)
        begin = np.cumsum(each) - each
        number = np.arange(len(owner)) - begin[owner]
        logit = self._logits(words, words.first[:-1][owner] + number * STRIDE, words.first[1:][owner])
        best = np.maximum.reduceat(logit, begin)
        top = np.minimum.reduceat(np.where(logit == best[owner], number, len(owner)), begin)
        return list(zip(best.tolist(), each.tolist(), (top * STRIDE).tolist()))


def score_toxicity(docs: DataFrame, net: WindowNetwork, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """(doc_id, score, n_windows, top_word) of every row: the score of the most toxic window, and its first word's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reader = _Reader(net)
            for begin, end, data, bounds, goes_on in windows(batch.column("text"), ~LETTERS, window_bytes):
                found = reader.read(data, bounds, goes_on)
                if found is None:
                    continue
                logit, count, top = (np.array(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(_sigmoid(logit.astype(np.float64) + net.shift)),
                     pa.array(count.astype(np.int64)), pa.array(top.astype(np.int64))], ["doc_id", "score", "n_windows", "top_word"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, n_windows long, top_word long")


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows and top_word of every row of ``docs``.

    Words are runs of digits, ASCII letters and characters outside ASCII, A-Z
    lower-cased. Windows of 32 words begin at every 24th word, so neighbours
    share 8; a text of any length is read to its end. A null
    or empty text is one empty window and has a score. Repeated rows each have
    a result, equal texts equal scores up to rounding; of equally toxic windows
    the first is named. An empty table gives no row, and other columns are ignored.
    """
    scored = score_toxicity(docs, fit_toxicity(docs, labels), window_bytes)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows", "top_word")
