"""Counted statistics of a corpus against plain versions of themselves."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from weftgraph.llm import divergence, phrases, spans

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(spark):
    import random

    draw = random.Random(5)
    words = ["Über", "tea", "TEA", "x9y", "été", "日本", "a", "b", "c", "İs", "don't"]
    rows = []
    for i in range(150):
        text = " ".join(draw.choice(words[: 3 + i % 8]) for _ in range(draw.randrange(0, 30)))
        rows.append((i, text, draw.choice(["en", "en", "de", "", None]), draw.choice(["s1", "s2", "s3", "Ä", None]), "t", 1, "v"))
    rows += [(200, None, "en", "s9", None, None, None), (201, "", "xx", "s1", None, None, None), (None, "tea a b", None, None, None, None, None),
             (201, "123 ...", "xx", "s2", None, None, None), (None, "tea a b", None, None, None, None, None),
             (300, "tea " * 3000 + "Über " * 2000, "en", "s1", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_divergence(rows, min_docs, top):
    found, seen, groups = defaultdict(Counter), Counter(), set()
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        terms = TERM.findall((r.text or "").translate(UPPER))
        found[lang, source].update(terms)
        seen.update((lang, t) for t in set(terms))
    out, joint = [], Counter()
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), k in seen.items() if x == lang and k >= min_docs]
        mine = {s: {t: found[lang, s][t] for t in kept} for (x, s) in groups if x == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}

        def price(c):
            n = sum(c.values())
            return {t: 1 + int(Fraction(10**9 * (k + 5), n + 5 * len(kept))) for t, k in c.items()}

        prices, q = {s: price(c) for s, c in mine.items()}, price(whole)
        for s, p in prices.items():
            pair = [(o, sum(abs(p[t] - r[t]) for t in kept)) for o, r in prices.items() if o != s]
            term = [(t, p[t] - q[t]) for t in kept if mine[s][t] and p[t] > q[t]]
            for name, items, most in (("pair", pair, None), ("term", term, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, name, item, value, rank))
            for o in prices:
                if o != s:
                    joint.update((lang, s, o, mine[s][t], mine[o][t]) for t in kept)
    return sorted(out), sorted((*k, n) for k, n in joint.items())


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 2, "panel_sources": 2, "window_bytes": 500}])
def test_source_divergence(spark, sizes):
    docs = corpus(spark)
    want, joint = plain_divergence(docs.collect(), 5, 3)
    assert sorted(tuple(r) for r in divergence.source_divergence(docs, min_docs=5, top=3, **sizes).collect()) == want
    assert sorted(tuple(r) for r in divergence.joint_tables(docs, min_docs=5, **sizes).collect()) == joint


def test_divergence_of_nothing(spark):
    docs = corpus(spark)
    assert divergence.source_divergence(docs.where("false")).collect() == []
    # no term is kept: all distances are 0 and no term is listed
    rows = divergence.source_divergence(docs, min_docs=10**6).collect()
    assert rows and all(r.part == "pair" and r.value == 0 for r in rows)


def test_long_texts_are_counted_in_windows(spark, monkeypatch):
    import pyarrow as pa

    text = "tea, Über été " * 50
    parts = list(spans.windows(pa.array(["a b", text, None, "c"]), ~divergence.TERM, limit=60))
    assert b"".join(p[2].tobytes() for p in parts) == ("a b" + text + "c").encode()
    assert max(len(p[2]) for p in parts) <= 60 and all(p[2].tobytes().decode() for p in parts)
    assert [p[4] for p in parts if p[0] == 1][-1] is False
    whole = list(spans.windows(pa.array(["x" * 200 + " " + "y" * 100]), ~divergence.TERM, limit=60))
    assert [len(p[2]) for p in whole] == [201, 100]


PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def plain_collocations(rows, support, top):
    out = []
    counts, total = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in PIECE.split((r.text or "").translate(UPPER)):
            words = WORD.findall(piece)
            total[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, f in counts.items():
        ready = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in ready.items():
            around = [b for q, b in ready.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in around):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shards": 3, "filter_bits": 1 << 16, "window_bytes": 300}, {"shards": 1}])
def test_collocations(spark, sizes):
    rows = [(5000 + i, t, lang, None, "p", 1, "v") for i, (t, lang) in enumerate([
        ("New York  city. new\tyork CITY, a b a b a b", "en"), ("a a a a a a a\x0ba a a", None), ("a a", "und"), ("\x00 \x00 \x00 \x00", "en"),
        ("new york\nnew york; city", "en"), ("日本 語 " * 40, "ja"), ("word " * 700 + "!" + "a b c d e " * 50, "en")])]
    docs = corpus(spark).unionByName(spark.createDataFrame(rows, SCHEMA))
    for support, top in ((4, 1000), (7, 5)):
        got = phrases.collocations(docs, support=support, top=top, **sizes).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(tuple(r) for r in got.collect()) == plain_collocations(docs.collect(), support, top)


def test_windows_of_a_task_are_counted_together(spark, monkeypatch):
    rows = spark.createDataFrame([("en", 1, "a b c d e f, " * 200), ("en", 2, "a b, " * 90), ("fr", 1, "a")], "lang string, shard int, text string").coalesce(1)
    assert phrases.shard_counts(rows, 3, None, 300).count() == 11 + 3 + 1  # a row for each word or pair of a shard, not of a window
    for held in (1 << 22, 50):
        monkeypatch.setattr(phrases, "HELD_KEYS", held)
        counts = phrases.shard_counts(rows, 3, None, 300)
        for support, want in ((1, [(1, 1)] + [(1, 200)] * 11 + [(2, 90)] * 3), (91, [(1, 200)] * 11), (201, [])):
            found = phrases.frequent_in_shards(counts, support, 3).collect()
            assert sorted((r.shard, r.n) for r in found) == want
            assert len({(r.key, r.shard) for r in found}) == len(found)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(corpus(spark).where("false")).collect() == []
    assert phrases.collocations(corpus(spark), support=10**6).collect() == []


def test_a_full_filter_never_misses(spark):
    import numpy as np

    keys = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 40_000, dtype=np.int64)
    made = phrases.KeyFilter(spark.createDataFrame([(int(k),) for k in keys], "key long"), most_bits=1 << 16)
    assert made.bits == 1 << 16 and made.has(keys.view(np.uint64)).all()
