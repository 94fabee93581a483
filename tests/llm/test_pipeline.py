"""The pipeline's stages on a corpus with one planted case for each decision."""

import random
import tracemalloc

import corpus_pipeline as pipeline
from weftgraph.llm import decontaminate, quality
from weftgraph.llm.byte_bpe import token_bytes
from weftgraph.session import RUNTIME_CONF

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest


def test_stages(spark, tmp_path):
    draw = random.Random(1)
    prose = lambda n: " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(10**6)}x" for _ in range(n))
    passage, item = prose(80), "Which of the many rivers runs past the old red mill? The slow green one does."
    clean = [(i, prose(150)) for i in range(40)]
    junk = [(i, "buy " * 150) for i in range(100, 140)]
    first = clean[0][1]
    planted = [(200, first), (201, first + " tail"), (202, prose(60) + " " + passage), (203, passage + " " + prose(60)), (204, prose(40) + " " + item + " " + prose(40)), (205, ""), (206, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in clean + junk + planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in clean + junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not any(100 <= i < 140 for i in seen["quality_classifier"]) and {i for i, _ in clean} <= set(seen["quality_classifier"])
    assert 200 not in seen["ngram_jaccard"] and 201 not in seen["ngram_jaccard"] and 0 in seen["ngram_jaccard"]
    cut = seen["suffix_array"]
    assert cut[202].text.endswith(passage) and passage not in cut[203].text and len(cut[203].text.split()) == 60
    assert 204 not in seen["decontamination"] and set(seen["suffix_array"]) - {204} == set(seen["decontamination"])
    table = token_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    for i, row in seen["byte_bpe"].items():
        assert b"".join(table[x] for x in np.frombuffer(row.ids, dtype="<u4")).decode() == (seen["decontamination"][i].text or "")


def test_one_row_of_each_group_stays(spark):
    draw = random.Random(2)
    prose = lambda: [f"p{draw.randrange(10**6)}" for _ in range(100)]
    a, b, c, d, e = (prose() for _ in range(5))
    near = lambda w: w[:-1] + ["edit"]
    rows = [
        (1, a), (None, near(a)), (None, b), (7, c), (3, d), (7, near(d)), (8, e), (8, near(e)), (9, ["one"]), (9, ["ONE"]),
        (None, f := prose()), (None, near(f)), (None, []), (5, []), (5, None), (5, None), (6, ["x"]), (6, ["y"])]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), "en") for i, w in rows], "doc_id long, text string, lang string")
    left = [(r.doc_id, r.text) for r in pipeline.ngram_jaccard(spark, docs, "").collect()]
    text = " ".join
    want = [(1, text(a)), (None, text(b)), (7, text(c)), (3, text(d)), (None, ""), (5, ""), (5, None), (6, "x"), (6, "y")]
    assert set(want) <= set(left) and len(left) == len(want) + 3
    for i, some in ((8, {text(e), text(near(e))}), (9, {"one", "ONE"}), (None, {text(f), text(near(f))})):
        assert len([x for x in left if x[0] == i and x[1] in some]) == 1


NAMES = ["quality_score", "n_passages", "top_passage", "_set", "_own", "_kind", "_text", "_row", "_doc", "_key", "_spans", "Set_Key", "text_key", "ids", "_label"]


def test_stages_with_clashing_names_and_rows_without_ids(spark, tmp_path):
    draw = random.Random(3)
    prose = lambda n: " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(10**6)}x" for _ in range(n))
    shared, near = prose(70), prose(300)
    texts = [prose(120) for _ in range(12)] + [f"{shared} {prose(80)}" for _ in range(3)] + [near, near, near + " end", None, "", " ", "few words", "few words"]
    rows = [(i if i % 3 else None, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[1][:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = docs.selectExpr("*", *[f"n_chars + {i} as `{n}`" for i, n in enumerate(NAMES)])
    for name, stage in pipeline.STAGES[:4]:
        plain = sorted(map(str, stage(spark, docs, str(tmp_path)).collect()))
        out = stage(spark, more, str(tmp_path))
        assert out.columns == more.columns
        assert sorted(map(str, out.select(*docs.columns).collect())) == plain and plain, name
        assert stage(spark, more.where("false"), str(tmp_path)).collect() == []
    assert pipeline.byte_bpe(spark, more, str(tmp_path)).count() == len(rows) and pipeline.byte_bpe(spark, more.where("false"), str(tmp_path)).count() == 0
    kept = pipeline.ngram_jaccard(spark, docs, str(tmp_path)).collect()
    assert sum(near in (r.text or "") for r in kept) == 1 and sum(r.text == "few words" for r in kept) == 1
    cut = pipeline.suffix_array(spark, docs, str(tmp_path)).collect()
    assert sum(shared in (r.text or "") for r in cut) == 1 and sum(near in (r.text or "") for r in cut) == 1


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_a_stage_by_itself_applies_the_settings(spark, tmp_path, name, stage):
    docs = spark.createDataFrame([(1, "few words", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Which one? That one.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64m")
    try:
        stage(spark, docs, str(tmp_path))
        assert spark.conf.get(key) == RUNTIME_CONF[key]
    finally:
        spark.conf.set(key, RUNTIME_CONF[key])


def test_many_texts_take_little_memory_at_a_time():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(i, *(decontaminate._hashes(" ".join(draw.choices(vocabulary[:1000], k=n))) for n in (30, 10))) for i in range(200)]
    df = {}
    for _, question, answer in items:
        for term in set(np.concatenate([question, answer]).tolist()):
            df[term] = df.get(term, 0) + 1
    index = decontaminate.ItemIndex(items, df, len(items), 40)
    texts = [" ".join(draw.choices(vocabulary, k=600)) for _ in range(400)]
    lengths = [len(t) for t in texts]
    assert sum(lengths) > 900_000
    tracemalloc.start()
    try:
        found = list(decontaminate._verified(index, pa.array(texts), 0.6, 0.8))
        searched = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        features, first = quality.passages(np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
        encoded = tracemalloc.get_traced_memory()[1] - features.nbytes
    finally:
        tracemalloc.stop()
    assert found == [] and searched < 100e6 and encoded < 60e6, (searched, encoded)
    alone = [quality.passages(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts[:20]]
    assert np.array_equal(np.concatenate(alone), features[: first[20]]) and list(np.diff(first)) == [10] * 400
