"""Every operator against a plain version of itself, on small tables with the odd cases."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from weftgraph.llm import (byte_bpe, decontaminate, notices, part_enum, quality, queries, quotes, scratch, simhash, suffixes, text_hash, token_store, tokens, urls)


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def empty(df):
    return df.where("false")


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, documents, words, percent):
    import random

    draw = random.Random(words)
    base = [f"v{draw.randrange(10**6)}" for _ in range(400)]
    more = []
    for i in range(120):
        size = draw.choice([6, 12, 30, 60, 150, 400])
        text = base[:size]
        for _ in range(draw.randrange(0, max(2, size // 25))):
            text[draw.randrange(size)] = f"e{draw.randrange(10**6)}"
        more.append((100 + i, " ".join(text), "en", 0, "k"))
    docs = documents.unionByName(spark.createDataFrame(more, documents.schema))
    sets = []
    for i, t in rows_of(docs):
        w = t.encode().lower().split()
        sets.append((i, {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[max(top(a), top(b))] = min(top(a), top(b))
    low = defaultdict(list)
    for n, (i, _) in enumerate(sets):
        low[top(n)].append(i)
    want = sorted((str(i), len(s), str(min([x for x in low[top(n)] if x is not None], default=None))) for n, (i, s) in enumerate(sets))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in part_enum.jaccard_components(docs, words, percent).collect())
    assert got == want
    assert part_enum.jaccard_components(empty(docs), words, percent).count() == 0


def test_repeated_passages(spark, documents):
    texts = {}
    for i, t in sorted(rows_of(documents), key=lambda r: (r[0] is not None, r[0] or 0)):
        texts.setdefault(tuple(t.encode().lower().split()), []).append(i)
    places = defaultdict(list)
    for n, w in enumerate(texts):
        for s in range(len(w) - 49):
            places[w[s : s + 50]].append((n, s))
    want = set()
    for n, (w, ids) in enumerate(texts.items()):
        cut, keep = np.zeros(len(w), bool), np.zeros(len(w), bool)
        for s in range(len(w) - 49):
            found = places[w[s : s + 50]]
            if len(found) > 1:
                (keep if min(found) == (n, s) else cut)[s : s + 50] = True
        edge = np.diff(np.concatenate([[0], (cut & ~keep).astype(int), [0]]))
        want |= {(ids[0], int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))}
        if len(w) >= 50:
            want |= {(i, 0, len(w)) for i in ids[1:]}
    found = suffixes.repeated_passages(documents, 50)
    assert {(r.doc_id, r.first_word, r.end_word) for r in found.collect()} == want
    left = {r.doc_id: r for r in suffixes.cut_passages(documents, found).collect()}
    assert 2 not in left and 1 in left and len(left[15].text.split()) == 60 and left[15].n_chars == len(left[15].text)
    assert left[10].text == "x y" and left[4].text is None
    assert suffixes.repeated_passages(empty(documents), 50).count() == 0


def test_a_signature_of_many_sets_spans_tasks(spark):
    rows = [(5, i) for i in range(3000)] + [(i, 1) for i in range(100, 1100)] + [(7, 2)] * 50 + [(8, 1), (8, 2)]
    df = spark.createDataFrame([(s, k, 1 + k % 1024 if s == 5 else 0) for s, k in rows], "signature long, set_key long, spread short").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = part_enum.shared_signatures(df).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(5, i) for i in range(3000)} | {(8, 1), (8, 2)}
    got = [(r.signature, r.set_key) for r in out]
    assert want <= set(got) and len(got) == len(set(got)) and len(got) < len(want) + 20
    assert len({r.task for r in out if r.signature == 5}) > 1


def test_signatures_of_many_sets_are_known_beforehand(spark):
    common = " ".join(f"c{i}" for i in range(200))
    docs = spark.createDataFrame([(i, f"{common} u{i}") for i in range(300)] + [(1000 + i, " ".join(f"w{i}x{j}" for j in range(150))) for i in range(50)],
                                 "doc_id long, text string")
    hot = part_enum.hot_signatures(docs, 5, 80, one_in=1, least=100)
    rows = part_enum.signature_rows(docs, 5, 80, hot=hot)
    assert len(hot) and rows.where("spread > 0").select("signature").distinct().count() == len(hot)
    halves = [part_enum.signature_rows(docs, 5, 80, 2, i, hot) for i in range(2)]
    assert halves[0].count() and halves[1].count() and halves[0].unionByName(halves[1]).exceptAll(rows).count() == 0 == rows.exceptAll(halves[0].unionByName(halves[1])).count()


def plain_passages(texts, m):
    """{(number, first word, end word)} to cut from texts of different words, by the rule in words."""
    places, out = defaultdict(list), set()
    for n, w in enumerate(texts):
        for s in range(len(w) - m + 1):
            places[tuple(w[s : s + m])].append((n, s))
    for n, w in enumerate(texts):
        cut = set()
        for s in range(len(w) - m + 1):
            found = sorted(places[tuple(w[s : s + m])])
            before = found.index((n, s)) - 1
            if before < 0:
                continue
            stay, gap = set(), s - found[before][1]
            if found[0][0] == n and gap < m:
                for k in range(found[0][1] + gap):
                    if len(kind := places[tuple(w[k : k + m])]) > 1 and min(kind) == (n, k):
                        stay |= set(range(k, k + m))
            cut |= set(range(s, s + m)) - stay
        out |= {(n, a, min(b for b in range(a, len(w) + 1) if b not in cut)) for a in cut if a - 1 not in cut}
    return out


def test_passage_with_recurring_neighbours(spark):
    import random

    draw = random.Random(4)
    fresh = lambda n: [f"n{draw.randrange(10**9)}" for _ in range(n)]
    p, x, y = fresh(60), fresh(1), fresh(1)
    # Texts 1 to 5 hold p between the same two words; text 6 holds it twice, and text 7 the words behind its second place.
    texts = [fresh(20) + p + fresh(20)] + [fresh(20) + x + p + y + fresh(20) for _ in range(5)]
    twice = fresh(5) + p + fresh(70) + p + fresh(3)
    texts += [twice, twice[-61:] + fresh(10)]
    q = fresh(55)
    texts += [q + fresh(9) + q + fresh(3), fresh(4) + q + texts[0][-5:]]
    for period in (1, 2, 7, 8, 49, 50, 51, 60):
        cycle = fresh(period)
        run = (cycle * 200)[: 3 * period + draw.randrange(60, 150)]
        tail = fresh(5)
        texts += [fresh(3) + run + tail, fresh(2) + run[-70:] + tail + fresh(2), run[:53] + fresh(80) + run]
    pool = [fresh(draw.randrange(20, 80)) for _ in range(8)]
    texts += [sum((draw.choice(pool) if draw.random() < 0.7 else fresh(3) for _ in range(6)), []) for _ in range(25)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = suffixes.repeated_passages(docs, 50)
    got = {(r.doc_id, r.first_word, r.end_word): r for r in found.collect()}
    assert set(got) == plain_passages(texts, 50)
    for i in range(1, 6):
        assert any(d == i and a <= 21 and b >= 81 for d, a, b in got)
    assert any((d, b - a) == (6, 60) and a == 5 for d, a, b in got) and any(d == 6 and a == 135 and b >= 195 for d, a, b in got)
    assert any((d, a, b) == (8, 64, 119) for d, a, b in got)
    for (i, a, b), r in got.items():  # every word cut stands at the source, which is earlier
        assert (r.source_doc_id, r.source_word) < (i, a) and texts[r.source_doc_id][r.source_word : r.source_word + 50].count(texts[i][a])
    left = {w for r in suffixes.cut_passages(docs, found).collect() for w in r.text.split()}
    assert left == {w for t in texts for w in t}


def test_leaks(spark, documents):
    items = spark.createDataFrame([
        (1, "What do the quick foxes see at night? They see the pale moon over the hills."), (2, "too short"), (3, None),
        (4, "Another question of some ten words that nobody asks today? Nothing.")], "item_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([
        (50, "pre " * 90 + "what do the QUICK foxes see, at night they see the pale moon over the hills " + "post " * 90),
        (51, "what do the quick foxes see at night? nothing like that"), (52, "the the the of over hills moon")], "doc_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()] == [(50, 1)]
    assert decontaminate.drop_leaks(docs, items).count() == docs.count() - 1
    assert decontaminate.find_leaks(docs, empty(items)).count() == 0 and decontaminate.drop_leaks(empty(docs), items).count() == 0
    index = decontaminate.build_indexes(items)[0]
    dense = np.zeros((len(index.largest), len(index.items)))
    for c, key in enumerate(index.cell_key):
        for p in range(index.cell_first[c], index.cell_first[c + 1]):
            dense[key // index.blocks, index.post_item[p]] = index.post_impact[p]
    for _, text in rows_of(docs):
        raw = np.frombuffer(text.encode(), np.uint8)
        words = text_hash.Words(raw, np.array([0, len(raw)]), text_hash.LETTERS)
        terms, want = index.numbers(words.hash), set()
        for j in range(max(1, -(-len(terms) // index.reach))):
            here = np.unique(terms[j * index.reach : (j + 2) * index.reach])
            want |= {(j * index.reach, int(k)) for k in np.flatnonzero(dense[here[here >= 0]].sum(axis=0) >= 0.3)}
        assert {(first, item) for _, first, _, item, _ in decontaminate.retrieve(index, words, 0.3)} == want


def test_few_items_are_scored_in_full(monkeypatch):
    import random

    draw, df = random.Random(6), Counter()
    vocabulary = [f"w{int(n * n / 900)}" for n in range(900)]  # some words are much more frequent
    items = [(i, *(decontaminate._hashes(" ".join(draw.choices(vocabulary, k=n))) for n in (30, 10))) for i in range(200)]
    for _, question, answer in items:
        df.update(set(np.concatenate([question, answer]).tolist()))
    index, seen, expand = decontaminate.ItemIndex(items, df, len(items), 40), [], decontaminate._expand
    texts = [" ".join(draw.choices(vocabulary, k=300)) for _ in range(60)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    words = text_hash.Words(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), text_hash.LETTERS)
    own = {h: n for n, h in enumerate(index.hashes.tolist())}
    foreign = np.concatenate([index.hashes + np.uint64(1), index.hashes - np.uint64(1), np.array([0, (1 << 64) - 1], dtype=np.uint64)])
    assert index.numbers(words.hash).tolist() == [index.order[own[h]] if h in own else -1 for h in words.hash.tolist()]
    assert index.numbers(foreign).tolist() == [index.order[own[h]] if h in own else -1 for h in foreign.tolist()]
    monkeypatch.setattr(decontaminate, "_expand", lambda *x: seen.append(expand(*x)) or seen[-1])
    decontaminate.retrieve(index, words, 0.6)
    assert sum(len(place) for _, place in seen) < 45 * len(words), sum(len(place) for _, place in seen) / len(words)


def test_items_of_all_lengths_by_one_rule(spark):
    """Every item against every run of twice its words, with a share of 0.8 of question and answer in their order."""
    import re as regex

    items = spark.createDataFrame([
        (1, "Capital of Peru? Lima."), (2, "Red or blue? Red."), (3, "?"), (4, None), (5, "capital of PERU lima"), (6, "Lima"),
        (7, "Which of the many rivers runs past the old mill? The slow one."), (8, "Who wrote the long red book? Anna")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Quiz: capital of Peru - lima, capital of peru? Lima!"), (2, "the capital of all Peru? Lima."), (3, "red or blue? green, red"),
        (4, "so red or blue red"), (5, "capital of Peru"), (6, "Lima"), (7, None), (8, ""),
        (9, "which of the many rivers runs past the old mill? the slow one"), (10, "red or blue"), (11, "who wrote the long blue book? anna"),
        (12, "which of the many brooks runs past the old mill? the slow one"), (13, "capital " + "x " * 20 + "of peru lima"),
        (14, "x y z " * 30 + "who wrote a long red book? Anna " + "x y z " * 30)], "doc_id long, text string")

    def words(t):
        return regex.findall(r"[0-9a-z]+", (t or "").lower())

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], max(last + 1 if x == y else 0, row[j], row[j - 1])
        return row[-1] / len(a) if a else 1.0

    def together(item, run):
        return sum((Counter(item) & Counter(run)).values()) / len(item)

    want = set()
    for d in docs.collect():
        for i in items.collect():
            q, a = (words(x) for x in decontaminate.split_item(i.text or ""))
            n, w = len(q) + len(a), words(d.text)
            if n and any(min(common(q, w[j : j + 2 * n]), common(a, w[j : j + 2 * n]), together(q + a, w[j : j + 2 * n])) >= 0.8 for j in range(0, max(len(w), 1))):
                want.add((d.doc_id, i.item_id))
    found = {(r.doc_id, r.item_id): r.first_word for r in decontaminate.find_leaks(docs, items).collect()}
    # what the plain search finds, but for runs that the score leaves out
    assert set(found) <= want and {(1, 1), (1, 5), (1, 6), (2, 1), (2, 5), (4, 2), (6, 6), (9, 7), (11, 8), (12, 7), (14, 8)} <= set(found)
    assert not {(5, 1), (10, 2), (13, 1), (13, 5)} & set(found)
    gone = {d for d, _ in found}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {r.doc_id for r in docs.collect()} - gone


def test_quality_gradient_and_odd_texts(spark, documents):
    draw = np.random.default_rng(3)
    x, first, y = draw.normal(size=(9, quality.BUCKETS + quality.SHAPES)) / 10, np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.AttentionModel()
    slopes = model.gradients(x, first, y)

    def loss():
        p = model.forward(x, first)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name in model.NAMES:
        at = np.unravel_index(np.argmax(np.abs(slopes[name])), slopes[name].shape)
        keep, e = model.p[name][at], 1e-5
        model.p[name][at] = keep + e
        high = loss()
        model.p[name][at] = keep - e
        assert abs((high - loss()) / (2 * e) - slopes[name][at]) < 1e-4 * max(1, abs(slopes[name][at]))
        model.p[name][at] = keep
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (99, 1), (None, 1), (9, None)], "doc_id long, quality int")
    out = quality.judge_quality(documents, labels).collect()
    assert len(out) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality.judge_quality(empty(documents), labels).count() == 0
    assert quality.keep_quality(documents, empty(labels)).columns == documents.columns


def test_quality_is_learned(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = quality.judge_quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "http://EXAMPLE.com/en/a?x#y"), (2, "https://www.example.com/en/"), (3, "http://a.b.net/fr/x"), (4, "http://xnet/fr/"), (5, None), (6, ""),
        (7, "x://h#/p"), (8, "http://casino-win.example.org/"), (9, "http://notexample.com/en/"), (9, "http://notexample.com/en/")], "page_id long, url string")
    out = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, queries.URL_RULES, urls.starting_labels(spark)).collect())
    assert out[0] == (1, "example.com", "/en/a", "example.com/en/", "block")
    assert out[1] == (2, "www.example.com", "/en/", "www.example.com/en/", "allow")
    assert out[2][3:] == ("net/fr/", "block") and out[3][3] is None
    assert out[4][1:4] == out[5][1:4] == ("", "", None) and out[6][1:3] == ("h", "")
    assert out[7][3:] == (None, "block") and out[8] == out[9] and out[8][3:] == ("com/", "allow")
    assert urls.judge_urls(empty(pages), queries.URL_RULES, empty(urls.starting_labels(spark))).count() == 0


def test_simhash(spark, documents):
    docs = documents.where("doc_id is not null and doc_id <> 7")
    out = {r.doc_id: r for r in simhash.compare_with_edits(docs).collect()}
    rows = sorted(rows_of(docs), reverse=True)
    assert len(out) == len(rows)
    for n, (i, text) in enumerate(rows):
        follower, half = rows[(n + 1) % len(rows)][1], len(text) // 2
        assert out[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + follower[:half]).encode()).hexdigest()
        same = bin(int(out[i].fingerprint, 16) ^ int(out[i].edited_fingerprint, 16)).count("1")
        assert out[i].n_chars == len(text) and abs(out[i].near_edited - (1 - same / 64)) < 1e-12
    assert out[1].fingerprint == out[2].fingerprint
    assert simhash.compare_with_edits(documents).count() == documents.count() and simhash.compare_with_edits(empty(docs)).count() == 0
    assert simhash.compare_with_edits(docs.where("doc_id = 1")).first().near_next == 1.0
    draw = np.random.default_rng(5)
    prints = draw.integers(-(1 << 63), 1 << 63, 60)
    prints = np.concatenate([prints, prints ^ (1 << draw.integers(0, 63, 60)), prints ^ 0b10110, prints ^ 0b11111])
    df = spark.createDataFrame([(int(x),) for x in prints] + [(None,)], "fingerprint long")
    got = {(r.query, r.fingerprint) for r in simhash.near_fingerprints(df.limit(20), df).collect()}
    asked = {int(x) for x in prints[:20]}
    assert got == {(a, int(b)) for a in asked for b in prints if bin((a ^ int(b)) & (2**64 - 1)).count("1") <= 3}


def test_byte_bpe(spark, documents):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = spark.createDataFrame([(100 + n, t) for n, t in enumerate(["a  b", "x\n y\n\n", "<|endoftext|> q", "\t\tz", " ", ",a", "don't,x x²,y"])], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(odd)
    want = sorted((str(i), hashlib.sha256(np.array(plain.encode_ordinary(t), dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows_of(docs))
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, path).collect()) == want
    table = byte_bpe.token_bytes(path)
    text = "é ß 日本 😀, ok"
    ids = np.array(plain.encode_ordinary(text), dtype="<u4")
    assert "".join(byte_bpe.decode_parts((ids[i : i + 1].tobytes() for i in range(len(ids))), table)) == text
    spans = byte_bpe.character_offsets(ids.tobytes(), table)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < b for a, b in spans)
    for r in byte_bpe.round_trip(docs, path).where("doc_id in (14, 106)").collect():
        text = next(t for i, t in rows_of(docs) if i == r.doc_id)
        places, at = [], 0
        for token in plain.encode_ordinary(text):
            stop = at + len(plain.decode_single_token_bytes(token))
            whole = text.encode()
            low = max(i for i in range(at + 1) if whole[i] & 0xC0 != 0x80)
            high = min(i for i in range(stop, len(whole) + 1) if i == len(whole) or whole[i] & 0xC0 != 0x80)
            places.append((len(whole[:low].decode()), len(whole[:high].decode())))
            at = stop
        assert r.offsets_sha256 == hashlib.sha256(np.array(places, dtype="<i4").tobytes()).hexdigest()
        assert r.n_split == sum(b[0] < a[1] for a, b in zip(places, places[1:]))
    assert byte_bpe.round_trip(empty(docs), path).count() == 0


def test_words_encoded_as_the_library_does(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = ["x <|endoftext|> y", "w" * 500 + " " + "w," * 300, "", " ", "a.b", "\n x", "don't STOP'LL 'S", "x<|endoftext|>y", "É.é", "e\u0301,", "ΑΣ.", "İ", "a\u00a0b\u3000c", "A\x00B", "a\x1cb",
             "x..y,,z", ",a", "ſ.K", "１２3.4", "ß.ẞ;Ω:", "new words " * 500, "Z.", ".z"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    for kept in (64 << 20, 3):  # a full store starts anew
        monkeypatch.setattr(tokens, "KEPT_BYTES", kept)
        use = tokens.Encoder(path, tokens.cut_lower_words, "<u2", separator=" ", special=True)
        assert use.encode_words(texts) == want == use.encode(texts)
        assert use.encode_words([]) == [] and [use.encode_words([t])[0] for t in texts] == want


def test_words_that_come_again_are_not_learned_anew(monkeypatch):
    import random

    draw, path, seen, parted = random.Random(8), public_tokenizers.path("word_bpe_49k.json"), [], []
    words = ["".join(draw.choices("abcdeñéßü", k=9)) for _ in range(300)]
    monkeypatch.setattr(tokens, "KEPT_BYTES", 30_000)
    use = tokens.Encoder(path, tokens.cut_lower_words, "<u4", separator=" ", special=True)
    learn, many = use._pieces, use._parted
    monkeypatch.setattr(use, "_pieces", lambda pieces: seen.append(len(pieces)) or learn(pieces))
    monkeypatch.setattr(use, "_parted", lambda pieces: parted.append(len(pieces)) or many(pieces))
    encode = tokenizers.Tokenizer.from_file(path).encode
    for number, call in enumerate([use.encode_words, use.encode] * 3):
        # Each call fills the store; the words of the last one are still known.
        texts = [" ".join(words), f"new{'x' * number} {words[number]}, été."]
        assert call(texts) == [np.array(encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert sum(seen) < 330 and sum(parted) < 30, (seen, parted)


def test_token_store(spark, documents, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SHARD_IDS", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    shards = scratch.Scratch(spark, "test").save(token_store.write_shards(documents, path, end_id=2), "shards")
    want, start = [], 0
    for i, t in sorted(rows_of(documents), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((str(i), start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_all(shards).collect()) == sorted(want)
    found = token_store.fetch(shards, spark.createDataFrame([(7,), (11,), (12345,), (None,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in found) == [7, 7, 11]
    keys = token_store.key_hashes(list(range(5000)))
    assert sorted(token_store.build_index(keys)[1].tolist()) == list(range(5000))
    none = token_store.write_shards(empty(documents), path, end_id=2)
    assert token_store.read_all(none).count() == 0


def test_fetch_from_wide_shards(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "no id"), (-(1 << 63), "low"), (-5, "a b"), (-1, "c"), (0, "d e f"), (3, "g"), (3, "h i"), (1 << 40, "j"), ((1 << 63) - 1, "high")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = spark.createDataFrame([(i,) for i in (None, -(1 << 63), -5, -1, 1, 3, 1 << 40, (1 << 63) - 1)], "doc_id long")
    for at_once in (1 << 19, 4, 1):  # one shard, several documents in a shard, and a shard each
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(token_store, "SHARD_IDS", at_once)
            shards = scratch.Scratch(spark, "test").save(token_store.write_shards(docs.coalesce(1), path, end_id=2), "shards")
        found = token_store.fetch(shards, keys).collect()
        assert sorted(r.doc_id for r in found) == [-(1 << 63), -5, -1, 3, 3, 1 << 40, (1 << 63) - 1]
        encode = tokenizers.Tokenizer.from_file(path).encode
        assert sorted(r.ids for r in found) == sorted(
            encode(t, add_special_tokens=False).ids + [2] for i, t in rows if i not in (None, 0))


def test_notices(spark, documents):
    out = {r.doc_id: r for r in notices.scan_notices(documents.where("doc_id <> 7"), queries.PHRASES).collect()}
    hit = out[11]
    assert (hit.n_words, hit.n_base, hit.first_word, hit.last_word, hit.base_labels, hit.score) == (8, 3, 0, 5, "cc-by,reserved", 1.0)
    fuzzy = out[12]
    assert (fuzzy.n_base, fuzzy.first_word, fuzzy.base_labels, fuzzy.labels) == (0, None, "", "apache") and 0.9 < fuzzy.score < 1
    assert (fuzzy.spans[0].first_word, fuzzy.spans[0].end_word, fuzzy.spans[0].edits) == (0, 5, 1)
    assert out[4].n_words == out[5].n_words == 0 and out[4].labels == ""
    assert notices.scan_notices(empty(documents), queries.PHRASES).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "a", "> How are you?\nFine, thanks.\nAnd you?"), (1, 2, "user", ">> hello   THERE\n> Fine, thanks.\n> And you?\n\nGood."),
        (1, 3, "user", "Other"), (1, 4, "a", "> Good.\nnice"), (None, 0, "u", None), (2, None, "u", "> x"), (2, 0, "u", "x"), (2, 0, "u", "x"), (2, 1, "u", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert len(out) == 9 and out[2, 0].copies == 2
    assert [(out[1, t].reply_to, out[1, t].root_turn, out[1, t].depth, out[1, t].position) for t in range(5)] == [
        (None, 0, 0, 0), (0, 0, 1, 1), (1, 0, 2, 2), (None, 3, 0, 4), (2, 0, 3, 3)]
    assert out[1, 2].body == "Good." and out[1, 2].n_quotes == 2 and out[1, 2].max_level == 2
    assert out[2, None].reply_to is None and out[None, 0].body == ""
    assert quotes.link_quotes(empty(df)).count() == 0
