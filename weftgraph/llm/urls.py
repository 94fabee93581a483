"""Allow or block URLs: by domain rules, else by a linear model on character n-grams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftgraph.llm.text_hash import chunks, mix

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: Labelled URLs that a fit reads at most, by the smallest hash of the URL.
FIT_URLS = 10_000

# A small labelled table to start from: words of pages nobody trains on, and of ordinary ones.
_BLOCK = ("casino win", "poker bonus", "free bets", "slot jackpot", "cheap pills", "viagra pharmacy", "payday loans", "adult cams",
          "xxx videos", "porn tube", "replica watches", "weight loss", "hot singles", "warez cracks", "lottery prize")
_ALLOW = ("garden notes", "daily news", "city library", "open science", "music school", "history archive", "travel journal", "recipe book",
          "river museum", "code review", "weather report", "language course", "family doctor", "public radio", "chess club")


def starting_labels(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for block, 0 for allow."""
    rows = []
    for label, names in ((1, _BLOCK), (0, _ALLOW)):
        for i, name in enumerate(names):
            one, two = name.split()
            rows += [(f"http://{one}-{two}.example.org/", label), (f"https://www.{one}{two}.example.net/en/{i + 10}.html", label),
                     (f"https://m.{two}-{one}.example.org/de/{i + 400}?page=2", label), (f"http://blog.{two}.example.net/{one}/", label),
                     (f"https://{one}.example.com/{two}/{i}", label)]
    return spark.createDataFrame(rows, "url string, label int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and where there is no ``://``."""
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule is a verdict and a host with the start of a path; it fits that host
    and its subdomains. Of rules of one length the first in the list wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(texts: pa.Array, space: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of each text, its ends marked."""
    rows, buckets = [], []
    marked = pc.binary_join_element_wise("^", pc.fill_null(texts, ""), "$", "")
    for begin, _, data, bounds in chunks(marked):
        raw = data.astype(np.uint64)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for n in GRAMS:
            count = len(raw) - n + 1
            if count <= 0:
                continue
            value = np.zeros(count, dtype=np.uint64)
            for j in range(n):
                value |= raw[j : j + count] << np.uint64(8 * j)
            same = row[:count] == row[n - 1 :]
            rows.append(row[:count][same] + begin)
            buckets.append((mix(value[same] + np.uint64((space * 8 + n) << 48)) % np.uint64(BUCKETS)).astype(np.int64))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def _features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): every n-gram counts 1 / sqrt(n-grams of the URL)."""
    parts = [_grams(host, 1), _grams(path, 2)]
    rows, buckets = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    each = np.bincount(rows, minlength=len(host))
    return rows, buckets, 1 / np.sqrt(each[rows])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_weights(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, y: np.ndarray, share: float = 0.3,
                steps: int = 600, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps with a momentum; weights of unseen buckets stay 0.

    Rows are weighted as if ``share`` of them were to block, as most URLs are harmless.
    """
    weights, bias = np.zeros(BUCKETS), 0.0
    count = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    speed, tilt = np.zeros(BUCKETS), 0.0
    for _ in range(steps if len(y) else 0):
        miss = _sigmoid(np.bincount(rows, weights=values * weights[buckets], minlength=len(y)) + bias) - y
        miss = miss * count
        slope = np.bincount(buckets, weights=values * miss[rows], minlength=BUCKETS) + decay * weights
        speed, tilt = 0.9 * speed - 20.0 * slope, 0.9 * tilt - 0.5 * miss.sum()
        weights, bias = weights + speed, bias + tilt
    return weights, bias


def fit_urls(labelled: DataFrame, bound: int = FIT_URLS) -> tuple[np.ndarray, float]:
    """Weights and bias of P(block) from (url, label); at most ``bound`` rows are read, by one task.

    Null labels are left out. Without rows every URL scores 0.5.
    """
    host, path = host_and_path(F.col("url"))
    rows = (labelled.where("label is not null").select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
            .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(bound))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        order = sorted(zip(*(table.column(c).to_pylist() for c in ("host", "path", "label"))))
        features = _features(pa.array([r[0] for r in order], type=pa.string()), pa.array([r[1] for r in order], type=pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([pickle.dumps(fit_weights(*features, np.array([r[2] for r in order])))], type=pa.binary())], ["model"])

    if not rows.take(1):
        return np.zeros(BUCKETS), 0.0
    return pickle.loads(rows.repartition(1).mapInArrow(fit, "model binary").first().model)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame, threshold: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages``.

    The verdict is the longest fitting rule's; where none fits it is block if
    the model's score reaches the threshold, else allow. A null URL and one
    without ``://`` have an empty host and path and are scored as such.
    Repeated rows each have a result; other columns are ignored.
    """
    weights, bias = fit_urls(labelled)
    weights = weights.astype(np.float32)
    host, path = host_and_path(F.col("url"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, buckets, values = _features(batch.column("host"), batch.column("path"))
            total = np.bincount(rows, weights=values * weights[buckets], minlength=batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(total))], [*batch.schema.names, "score"])

    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = parts.mapInArrow(score, "page_id long, host string, path string, score double")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    by_score = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_score).alias("verdict"), "score")
