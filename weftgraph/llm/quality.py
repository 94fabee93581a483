"""Document quality by attention over passages, learned from labels of whole documents."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.scratch import free_name
from weftgraph.llm.text_hash import NOT_SPACE, Words, byte_class, chunks, mix

PASSAGE_WORDS = 64
BUCKETS = 512
SHAPES = 10
HIDDEN, GATES = 24, 16
EPOCHS, STEP, DECAY = 40, 0.01, 1e-4
#: Labelled documents that a fit reads at most, by the smallest hash of their doc_id.
FIT_DOCUMENTS = 4_000
#: Bytes of text whose passages are encoded at a time; that takes about 90 times as many.
AT_ONCE = 1 << 18

_UPPER, _DIGIT = byte_class((65, 90)), byte_class((48, 57))
_MARK, _STOP, _WIDE = byte_class((33, 43), (45, 45), (47, 47), (58, 64), (91, 96), (123, 126)), byte_class((44, 44), (46, 46)), byte_class((128, 255))


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts of a chunk, and each text's first passage.

    A passage is ``PASSAGE_WORDS`` words on end, the last of a text may be
    shorter, and a text without words is one passage of zeros. Its features are
    hashed character trigrams, scaled to length 1, and a few shapes: shares of
    distinct words, of the most frequent word, and of kinds of characters.
    """
    parts, row = [], 0
    while row < len(bounds) - 1:
        end = max(int(np.searchsorted(bounds, bounds[row] + AT_ONCE, side="right")) - 1, row + 1)
        parts.append(_encoded(data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]))
        row = end
    if not parts:
        return _encoded(data, bounds)
    return np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(first) for _, first in parts]))])


def _encoded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, bounds, NOT_SPACE, fold=False)
    each = np.maximum(1, -(-words.counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(each)])
    n = first[-1]
    out = np.zeros((n, BUCKETS + SHAPES), dtype=np.float32)
    if len(words):
        number = np.arange(len(words)) - words.first[words.row]
        home = first[words.row] + number // PASSAGE_WORDS
        # A byte belongs to the passage of the last word that has begun.
        begun = np.zeros(len(data) + 1, dtype=np.int64)
        begun[words.start] = 1
        place = np.cumsum(begun[:-1]) - 1
        held = np.flatnonzero(place >= 0)
        held = held[words.row[place[held]] == np.searchsorted(bounds, held, side="right") - 1]
        span = home[place[held]]
        raw = data.astype(np.uint64)
        triple = raw[:-2] | (raw[1:-1] << np.uint64(8)) | (raw[2:] << np.uint64(16)) if len(data) > 2 else raw[:0]
        inside = held < len(triple)
        inside[inside] = span[inside] == np.append(span, -1)[np.minimum(np.flatnonzero(inside) + 2, len(span))]
        bucket = (mix(triple[held[inside]]) % np.uint64(BUCKETS)).astype(np.int64)
        counts = np.bincount(span[inside] * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
        grams = np.log1p(counts).astype(np.float32)
        out[:, :BUCKETS] = grams / np.maximum(np.sqrt((grams * grams).sum(axis=1)), 1e-6)[:, None]
        size = np.maximum(np.bincount(home, minlength=n), 1)
        order = np.lexsort((words.hash, home))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (home[order][1:] != home[order][:-1]) | (words.hash[order][1:] != words.hash[order][:-1])
        at = np.flatnonzero(fresh)
        times = np.diff(np.append(at, len(order)))
        most = np.zeros(n)
        np.maximum.at(most, home[order[at]], times)
        width = np.bincount(home, weights=words.end - words.start, minlength=n)
        total = np.maximum(np.bincount(span, minlength=n), 1)
        shapes = [np.bincount(home[order[at]], minlength=n) / size, most / size, width / size / 10, size / PASSAGE_WORDS,
                  np.bincount(home, weights=words.end - words.start == 1, minlength=n) / size]
        shapes += [np.bincount(span, weights=kind[data[held]], minlength=n) / total for kind in (_UPPER, _DIGIT, _MARK, _STOP, _WIDE)]
        out[:, BUCKETS:] = np.stack(shapes, axis=1)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Gated attention over the encoded passages of a document.

    A passage x becomes h = tanh(W x + b); its weight is the softmax, over the
    document, of w (tanh(V h) * sigmoid(U h)); the document's score is
    sigmoid(c z + c0) for the weighted sum z of its passages.
    """

    NAMES = ("W", "b", "V", "U", "w", "c", "c0")

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        size = {"W": (BUCKETS + SHAPES, HIDDEN), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,)}
        self.p = {k: draw.normal(0, 0.3 if k != "W" else 0.5, s) for k, s in size.items()}
        self.p |= {"b": np.zeros(HIDDEN), "c0": np.zeros(1)}
        self.shift, self.scale = np.zeros(BUCKETS + SHAPES), np.ones(BUCKETS + SHAPES)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, first[:-1]
        each = np.diff(first)
        h = np.tanh(((x - self.shift) * self.scale) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), each))
        a = e / np.repeat(np.add.reduceat(e, starts), each)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["c0"][0])}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        starts, each = first[:-1], np.diff(first)
        miss = (f["score"] - y) / len(y)
        dz = np.repeat(miss[:, None] * p["c"], each, axis=0)
        a, h, t, g = f["a"], f["h"], f["t"], f["g"]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), each))
        dg = de[:, None] * p["w"]
        dt, du = dg * g * (1 - t * t), dg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": ((x - self.shift) * self.scale).T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ du,
                "w": (t * g).T @ de, "c": f["z"].T @ miss, "c0": np.array([miss.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128) -> AttentionModel:
        """Adam on the log loss, in a fixed order; without rows, or with one label only, scores are that share."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        if not 0 < y.sum() < len(y):
            self.p["c"][:], self.p["c0"][0] = 0, np.log(share / (1 - share))
            return self
        self.shift, spread = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0) / np.sqrt(BUCKETS)
        self.scale[BUCKETS:] *= 4
        self.p["c0"][0] = np.log(share / (1 - share))
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        draw, step = np.random.default_rng(11), 0
        for epoch in range(epochs):
            order = draw.permutation(len(y))
            for begin in range(0, len(order), batch):
                chosen = np.sort(order[begin : begin + batch])
                each = first[chosen + 1] - first[chosen]
                own = np.concatenate([[0], np.cumsum(each)])
                rows = np.repeat(first[chosen] - own[:-1], each) + np.arange(own[-1])
                step += 1
                rate = STEP * (1 - epoch / epochs)
                for k, d in self.gradients(x[rows], own, y[chosen]).items():
                    d = d + DECAY * self.p[k]
                    mean[k] = 0.9 * mean[k] + 0.1 * d
                    square[k] = 0.999 * square[k] + 0.001 * d * d
                    self.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the doc_id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = FIT_DOCUMENTS) -> AttentionModel:
    """A model of ``label`` from the labelled rows that are not held out.

    At most ``bound`` labelled documents are read, those with the smallest hash
    of their doc_id; that many ids are broadcast. Passages are encoded by all
    tasks, and one task fits on these bounded rows. Null labels are left out;
    of repeated labels the largest counts. Nothing but the text is an input.
    """
    chosen = (labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).where("_id is not null and _label is not null")
              .where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(bound))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
            .select("doc_id", "text", F.col("_label").cast("double").alias("_label")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in chunks(batch.column("text")):
                x, first = passages(data, bounds)
                rows = [x[first[i] : first[i + 1]].tobytes() for i in range(end - begin)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), batch.column("_label").slice(begin, end - begin),
                     pa.array(rows, type=pa.binary())], ["doc_id", "label", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "x")))), key=lambda r: (r[0], r[2]))
        rows = [np.frombuffer(r[2], dtype=np.float32).reshape(-1, BUCKETS + SHAPES) for r in found]
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        x = np.concatenate(rows) if rows else np.zeros((0, BUCKETS + SHAPES), np.float32)
        model = AttentionModel().fit(x, first, np.array([r[1] for r in found]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.p, model.shift, model.scale))], type=pa.binary())], ["model"])

    fitted = rows.mapInArrow(encode, "doc_id long, label double, x binary").repartition(1).mapInArrow(fit, "model binary").first()
    model = AttentionModel()
    if fitted:
        model.p, model.shift, model.scale = pickle.loads(fitted.model)
    else:
        model.p["c"][:] = 0
    return model


def score_documents(docs: DataFrame, model: AttentionModel, names: tuple[str, str, str] = ("quality_score", "n_passages", "top_passage")) -> DataFrame:
    """All columns of ``docs``, and quality_score, n_passages and top_passage, or what ``names`` calls them, for every row.

    The score is from 0 to 1, by the whole text; a null text counts as empty and
    has a score as well. top_passage numbers the passage with the largest
    weight, the first of equal ones.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in chunks(batch.column("text")):
                x, first = passages(data, bounds)
                f = model.forward(x, first)
                top = [int(np.argmax(f["a"][first[i] : first[i + 1]])) for i in range(end - begin)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(begin, end - begin) for c in batch.columns), pa.array(f["score"]), pa.array(np.diff(first)), pa.array(top, type=pa.int64())],
                    [*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{fields}, `{names[0]}` double, `{names[1]}` long, `{names[2]}` long")


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and top_passage of every row of ``docs``."""
    model = fit_quality(docs, labels)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_passage")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns, whatever these are called.

    Null and empty texts are judged as empty ones, equal texts alike; an empty table stays empty.
    """
    names = tuple(free_name(docs, x) for x in ("quality_score", "n_passages", "top_passage"))
    scored = score_documents(docs, fit_quality(docs, labels), names)
    return scored.where(F.col(f"`{names[0]}`") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
