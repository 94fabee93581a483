"""The recurrent network against numerical gradients, a plain forward pass and held-out labels."""

import numpy as np
import pytest

from weftgraph.llm import queries, spans, text_hash, toxicity


def network(texts, width=np.float64):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    words = text_hash.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds, text_hash.LETTERS)
    lexicon = toxicity.Lexicon(words)
    net = toxicity.WindowNetwork(np.sort(lexicon.hash[::2]))
    net.p = {k: v.astype(width) for k, v in net.p.items()}
    index = toxicity.laid_out(lexicon.number, words.first[:-1], words.first[1:], len(lexicon))
    return net, words, lexicon, index


TEXTS = ["a small text, of Words", "", "été 日本 a " * 5, "one " * 40]


def test_gradients():
    net, _, lexicon, index = network(TEXTS)
    draw, y, own = np.random.default_rng(1), np.array([1.0, 0.0, 1.0, 0.0]), net.numbers(lexicon)

    def loss():
        logit = net.forward(net.vectors(lexicon), index)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    found = net.gradients(lexicon, own, index, y)
    assert set(found) == set(net.p)
    for name, part in net.p.items():
        for place in draw.choice(part.size, min(part.size, 12), replace=False).tolist() + np.argsort(-np.abs(found[name]).ravel())[:3].tolist():
            at = np.unravel_index(place, part.shape)
            held, step = part[at], 1e-6
            part[at] = held + step
            high = loss()
            part[at] = held - step
            low = loss()
            part[at] = held
            assert found[name][at] == pytest.approx((high - low) / (2 * step), abs=1e-7), (name, at)


def plain_logit(net, words, lexicon, row, first):
    """One window, word by word."""
    p, h = net.p, toxicity.HIDDEN
    numbers = lexicon.number[words.first[row] + first : min(words.first[row] + first + toxicity.WINDOW, words.first[row + 1])]
    x = net.vectors(lexicon)[numbers]

    def run(xs, d):
        state, out = np.zeros(h), []
        for v in xs:
            g, u = v @ p["W"][d] + p["b"][d, 0], state @ p["U"][d]
            z, r = 1 / (1 + np.exp(-(g[:h] + u[:h]))), 1 / (1 + np.exp(-(g[h : 2 * h] + u[h : 2 * h])))
            new = np.tanh(g[2 * h :] + r * (u[2 * h :] + p["d"][d, :, 0]))
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    if not len(x):
        return float(p["c0"][0])
    both = np.concatenate([run(x, 0), run(x[::-1], 1)[::-1]], axis=1)
    e = np.tanh(both @ p["A"] + p["a"]) @ p["v"]
    e = np.exp(e - e.max())
    return float((e / e.sum()) @ both @ p["c"] + p["c0"][0])


@pytest.mark.parametrize("limit", [None, 90])
def test_every_window_of_every_text_is_scored(limit):
    import pyarrow as pa

    texts = [*TEXTS, " ".join(f"w{i * 7 % 31}" for i in range(333)), "x" * 300 + " end", " ".join(f"v{i}" for i in range(56))]
    net, words, lexicon, _ = network(texts)
    reader, got = toxicity._Reader(net), []
    for _, _, data, bounds, goes_on in spans.windows(pa.array(texts), ~text_hash.LETTERS, limit or 1 << 20):
        got += reader.read(data, bounds, goes_on) or []
    for row, (logit, count, top) in enumerate(got):
        n = int(words.counts[row])
        starts = [s for s in range(0, max(n, 1), toxicity.STRIDE) if s == 0 or n - s > toxicity.WINDOW - toxicity.STRIDE]
        want = [plain_logit(net, words, lexicon, row, s) for s in starts]
        assert count == len(starts) and logit == pytest.approx(max(want), abs=1e-9)
        assert want[starts.index(top)] == pytest.approx(max(want), abs=1e-9)
    assert len(got) == len(texts)


def test_toxicity_is_learned(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op11_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = rows.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    area = (toxic.score.values[:, None] > clean.score.values[None, :]).mean()
    assert area > 0.9 and (clean.predicted == 0).mean() > 0.97 and (toxic.predicted == 1).mean() > 0.75
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_tables(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (None, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    docs = documents.selectExpr("*", "1 as score", "2 as predicted", "'x' as _id")
    rows = toxicity.judge_toxicity(docs, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    for some in (labels.where("false"), labels.where("toxic = 1")):
        scores = {r.score for r in toxicity.judge_toxicity(docs, some).collect()}
        assert len(scores) == 1
    assert toxicity.judge_toxicity(docs.where("false"), labels).collect() == []
