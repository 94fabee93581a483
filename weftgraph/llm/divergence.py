"""How far the sources of a language differ in the terms they use, by products of one-hot level columns.

For a block of terms, every source has one column for each count (level) that
its terms have there; a term has a 1 in the column of its level, also for the
level 0. The product of a block with its transpose holds, for any two sources,
the table of how many terms have which pair of levels. A price for each pair of
levels then gives the distance of two sources; blocks add up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.llm.scratch import Scratch
from weftgraph.llm.spans import WINDOW_BYTES, cut_strings, lower_ascii, windows
from weftgraph.llm.text_hash import Words, byte_class

#: ASCII letters and every byte of a character outside ASCII.
TERM = byte_class((65, 90), (97, 122), (128, 255))
#: Terms of a block, and sources of a panel of columns: they bound what a task holds.
BLOCK_TERMS, PANEL_SOURCES = 256, 128
PRICE, PRIOR = 1_000_000_000, 5


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first one foremost), and the first place of each distinct combination."""
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(fresh)


def term_counts(docs: DataFrame, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """(lang, source, term, n, docs) rows, several for a term: n occurrences in docs rows, to be summed.

    Rows of a source come together by range, a large source over many tasks,
    so that a task adds up most of what it meets.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")],
                       F.xxhash64("doc_id", "text").alias("salt"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
            names, codes = np.unique([f"{r['lang']}\0{r['source']}" for r in home.to_pylist()], return_inverse=True)
            first = np.zeros(len(names), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            met, more = np.zeros(0, dtype=np.uint64), False
            for begin, _, data, bounds, goes_on in windows(batch.column("text"), ~TERM, window_bytes):
                if not more:
                    met = np.zeros(0, dtype=np.uint64)
                words = Words(data, bounds, TERM)
                order, starts = _runs(words.row, words.hash)
                row, value = words.row[order[starts]], words.hash[order[starts]]
                times = np.diff(np.append(starts, len(order)))
                some = order[starts]
                fresh = np.ones(len(row), dtype=np.int64)
                if more or goes_on:  # a row in several windows counts once for a term
                    fresh = (~np.isin(value, met)).astype(np.int64)
                    met = np.union1d(met, value)
                more = goes_on
                group = codes[begin + row]
                order, starts = _runs(group, value)
                if not len(order):
                    continue
                some = some[order[starts]]
                own = first[group[order[starts]]]
                yield pa.RecordBatch.from_arrays([
                    batch.column("lang").take(pa.array(own)), batch.column("source").take(pa.array(own)),
                    cut_strings(lower_ascii(data), words.start[some], words.end[some] - words.start[some]),
                    pa.array(np.add.reduceat(times[order], starts)), pa.array(np.add.reduceat(fresh[order], starts))],
                    ["lang", "source", "term", "n", "docs"])

    dealt = rows.repartitionByRange("lang", "source", "salt").select("lang", "source", "text")
    return dealt.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PRICE * (n + PRIOR) / (total + PRIOR * terms)); products in decimals of 38 digits."""
    share = F.lit(PRICE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    return F.call_function("div", share, (total + PRIOR * terms).cast("decimal(20,0)")) + 1


def level_product(columns: np.ndarray, mine: int, levels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """X_mine^T X of a one-hot block: (levels of source ``mine``) x (all columns), whole numbers.

    ``columns`` has a row for each term and the number of its column for each
    source; a source's columns are ``levels`` many from ``first`` on. Each row
    of the block adds 1 where its own column and another's meet.
    """
    wide = int(levels.sum())
    cells = (columns[:, mine] - first[mine])[:, None] * wide + columns
    return np.bincount(cells.ravel(), minlength=int(levels[mine]) * wide).reshape(-1, wide)


def one_hot_block(source: np.ndarray, term: np.ndarray, n: np.ndarray, price: np.ndarray):
    """Columns of a block from its entries: column numbers, levels and first column of each source, n and price of each column.

    Every source has an entry of n = 0 and term -1 with its price of level 0; terms count from 0.
    """
    order, starts = _runs(source, n)
    column = np.zeros(len(order), dtype=np.int64)
    column[order] = np.cumsum(np.isin(np.arange(len(order)), starts)) - 1
    owner = source[order[starts]]
    levels = np.bincount(owner)
    first = np.cumsum(levels) - levels
    columns = np.tile(first, (int(term.max()) + 1 if len(term) else 0, 1))  # level 0 is a source's first one
    real = term >= 0
    columns[term[real], source[real]] = column[real]
    return columns, levels, first, n[order[starts]], price[order[starts]]


def _priced_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums of the prices of a block's joint tables, for pairs of sources of the cell's two panels."""
    names = table.column("source").combine_chunks().dictionary_encode()
    # Sources of both panels in one block; a pair is asked for by its panels.
    source = names.indices.to_numpy()
    terms = table.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    panel = np.zeros(len(names.dictionary), dtype=np.int64)
    panel[source] = table.column("panel").to_numpy()
    columns, levels, first, _, price = one_hot_block(
        source, terms, table.column("n").to_numpy(), table.column("p").to_numpy())
    _, _, low, high = (x.as_py() for x in key)
    out = []
    for mine in range(len(levels)):
        if panel[mine] != low:
            continue
        joint = level_product(columns, mine, levels, first)
        own = price[first[mine] : first[mine] + levels[mine]]
        cost = (joint * np.abs(own[:, None] - price[None, :])).sum(axis=0)
        value = np.add.reduceat(cost, first)
        for other in np.flatnonzero(panel == high).tolist():
            if other != mine:
                out.append((mine, other, int(value[other])))
                if low != high:
                    out.append((other, mine, int(value[other])))
    a, b, value = (np.array(x, dtype=np.int64) for x in (zip(*out) if out else ((), (), ())))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": names.dictionary.take(pa.array(a)).cast(pa.string()),
                     "item": names.dictionary.take(pa.array(b)).cast(pa.string()), "value": value})


def _jointed_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The joint tables of a block themselves, without their empty cells."""
    names = table.column("source").combine_chunks().dictionary_encode()
    source = names.indices.to_numpy()
    terms = table.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    panel = np.zeros(len(names.dictionary), dtype=np.int64)
    panel[source] = table.column("panel").to_numpy()
    columns, levels, first, n, _ = one_hot_block(source, terms, table.column("n").to_numpy(), table.column("p").to_numpy())
    owner = np.repeat(np.arange(len(levels)), levels)
    _, _, low, high = (x.as_py() for x in key)
    a, b, level, other_level, count = ([] for _ in range(5))
    for mine in np.flatnonzero(panel == low).tolist():
        joint = level_product(columns, mine, levels, first)
        joint[:, (owner == mine) | (panel[owner] != high)] = 0
        i, j = np.nonzero(joint)
        a.append(np.full(len(i), mine))
        b.append(owner[j])
        level.append(n[first[mine] + i])
        other_level.append(n[j])
        count.append(joint[i, j])
    a, b, level, other_level, count = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (a, b, level, other_level, count))
    if low != high:
        a, b, level, other_level, count = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([level, other_level]), np.concatenate([other_level, level]), np.tile(count, 2)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": names.dictionary.take(pa.array(a)).cast(pa.string()),
                     "item": names.dictionary.take(pa.array(b)).cast(pa.string()), "level": level, "other_level": other_level, "terms": count})


class Levels:
    """Kept terms of each language, their counts by source, and prices, in written tables.

    groups: lang, source, total, terms, lang_total, blocks, panels. counts: lang,
    source, term, n, lang_n for kept terms that the source has.
    """

    def __init__(self, docs: DataFrame, min_docs: int, block_terms: int = BLOCK_TERMS, panel_sources: int = PANEL_SOURCES,
                 window_bytes: int = WINDOW_BYTES):
        scratch = Scratch(docs.sparkSession, "levels")
        raw = scratch.save(term_counts(docs, window_bytes), "raw")
        # One shuffle by (lang, term) serves the sums, the choice of terms and the join of both.
        each = raw.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        whole = each.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
        self.counts = scratch.save(each.drop("docs").join(whole, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "counts")
        scratch.drop(raw)
        homes = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        # A term's total in its language stands in each of its rows; the one of its first source is added.
        leads = self.counts.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
        langs = leads.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
        size = homes.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
        some = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")]
        self.groups = scratch.save(
            homes.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(size, "lang")
            .select("lang", "source", *some,
                    F.greatest(F.lit(1), F.ceil(F.coalesce("terms", F.lit(0)) / block_terms)).cast("int").alias("blocks"),
                    F.ceil(F.col("sources") / panel_sources).cast("int").alias("panels")), "groups")

    def priced(self) -> DataFrame:
        """``counts`` with the facts of its group, p (the group's price) and q (the language's)."""
        return (self.counts.join(self.groups, ["lang", "source"])
                .withColumn("p", _price(F.col("n"), F.col("total"), F.col("terms")))
                .withColumn("q", _price(F.col("lang_n"), F.col("lang_total"), F.col("terms"))))

    def cells(self):
        """Entries of every block of terms and pair of panels, grouped; each source has an entry of level 0 in each."""
        panel = F.pmod(F.xxhash64("source"), F.col("panels")).cast("int").alias("panel")
        block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
        real = self.priced().select("lang", block, "source", panel, "panels", "term", "n", "p")
        nought = F.when(F.col("terms") > 0, _price(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(0)
        zero = self.groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", panel, "panels",
                                  F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), nought.alias("p"))
        other = F.explode(F.sequence(F.lit(0), F.col("panels") - 1)).alias("other")
        laid = real.unionByName(zero).select("*", other)
        return (laid.withColumn("low", F.least("panel", "other")).withColumn("high", F.greatest("panel", "other"))
                .select("lang", "block", "low", "high", "source", "panel", "term", "n", "p").groupBy("lang", "block", "low", "high"))


def joint_tables(docs: DataFrame, min_docs: int = 30, **sizes: int) -> DataFrame:
    """(lang, source, item, level, other_level, terms): how many kept terms have which counts in two sources.

    For every ordered pair of sources of a language; level 0 is counted too.
    Texts, nulls and kept terms are as in ``source_divergence``.
    """
    cells = Levels(docs, min_docs, **sizes).cells().applyInArrow(
        _jointed_block, "lang string, source string, item string, level long, other_level long, terms long")
    return cells.groupBy("lang", "source", "item", "level", "other_level").agg(F.sum("terms").alias("terms"))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, **sizes: int) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources, and the terms that set a source apart.

    A null text, lang or source counts as ''. Terms are runs of ASCII letters
    and characters outside ASCII, A-Z lower-cased; a language keeps those in at
    least ``min_docs`` of its rows, so repeated rows count each. A group is a
    lang with a source; one without terms has all counts 0. A term's price in a
    group is 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the sum of counts
    and V the number of kept terms. Part ``pair`` has for each other source of
    the language the sum of differences of prices over all kept terms (0
    without any); part ``term`` the ``top`` kept terms whose price in the group
    is above that in the language. Ranks are from 1, by value descending, then
    item in byte order, so ties have a defined order. An empty table gives no
    row; other columns are ignored. All numbers are exact: products of prices
    use decimals, sums and joint tables 64-bit integers. Hashes of terms only
    group what one task has met; tables are keyed by the terms themselves.
    """
    levels = Levels(docs, min_docs, **sizes)
    pair = (levels.cells().applyInArrow(_priced_block, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    term = levels.priced().where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
              for name, x in (("pair", pair), ("term", term))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
