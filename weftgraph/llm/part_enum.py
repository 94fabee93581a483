"""Exact Jaccard self-join of word shingle sets by PartEnum signatures.

Sets are put into bands of sizes whose ratio is the similarity. Two similar
sets lie in one band or in neighbouring ones, and differ there by at most a
known number ``k`` of shingles. The domain of shingles is cut by a hash into
groups and parts of groups; by the pigeonhole principle two such sets agree on
some subset of the parts of some group, and so share that subset's signature.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.components import components
from weftgraph.llm.scratch import Scratch
from weftgraph.llm.text_hash import NOT_SPACE, Words, chunks, mix, signed

#: Set keys remembered by a task so that copies sign once; forgetting one only repeats rows.
REMEMBERED = 200_000
#: Signatures are sorted in so many slices, one after the other, whose shuffle files are freed in between.
SLICES = 2
#: The same for the texts and shingles of the sets that share a signature.
SHINGLE_SLICES = 4
#: One in so many texts is sampled for signatures of very many sets; from so many sampled sets on, one is spread.
SAMPLED, HOT_ROWS, HOT_SIGNATURES = 64, 64, 100_000


class Bands:
    """Size bands for a similarity of ``percent`` / 100, with their difference bound and split.

    spare: how many groups a band has beyond those that the bound asks for.
    """

    def __init__(self, percent: int):
        self.low, self.groups, self.parts, self.away, self.spare = [1], [], [], [], []
        while self.low[-1] < 1 << 40:
            high = 100 * self.low[-1] // percent
            k = 2 * high * (100 - percent) // (100 + percent)
            # Single parts of pairs make the fewest signatures, but only if each then holds enough shingles to tell sets apart.
            away, parts = (0, 1) if k == 0 else (1, 4) if k == 1 else (2, 5) if k <= 12 else (1, 2) if self.low[-1] >= 4.5 * k else (2, 4)
            self.away.append(away)
            self.parts.append(parts)
            self.spare.append(2 + k // 100 if k > 12 else 0)
            self.groups.append(1 if k < 2 else k // (away + 1) + 1 + self.spare[-1])
            self.low.append(high + 1)
        self.low, self.groups, self.parts, self.away, self.spare = map(
            np.array, (self.low, self.groups, self.parts, self.away, self.spare))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def signatures(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(set, signature) of sets given as (set, shingle) pairs; for each set's own band and the next.

    Bands of large sets have spare groups, so as many groups of a set may be
    left out: signatures of no shingle, which unlike sets would share, are kept
    only where more of its groups have one.
    """
    own, weight = bands.of(sizes), mix(values + np.uint64(0x51ED270B9F2F2C6D))
    for step in (0, 1):
        band = own + step
        for away, parts in ((1, 4), (2, 5), (1, 2), (2, 4)):
            chosen = np.flatnonzero((sizes > 0) & (bands.away[band] == away) & (bands.parts[band] == parts))
            if not len(chosen):
                continue
            place = np.full(len(sizes), -1)
            place[chosen] = np.arange(len(chosen))
            groups = bands.groups[band[chosen]]
            first = np.concatenate([[0], np.cumsum(groups)])
            mine = place[rows] >= 0
            at = place[rows[mine]]
            where = mix(values[mine] ^ (band[chosen][at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
            group = ((where >> np.uint64(32)) % groups[at].astype(np.uint64)).astype(np.int64)
            cell = (first[at] + group) * parts + ((where & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
            total = np.zeros(first[-1] * parts, dtype=np.uint64)
            np.add.at(total, cell, weight[mine])
            count = np.bincount(cell, minlength=len(total)).reshape(-1, parts)
            total = total.reshape(-1, parts)
            subsets = [s for s in combinations(range(parts), parts - away)]
            sums = np.stack([sum(total[:, j] for j in s) for s in subsets], axis=1)
            empty = np.stack([sum(count[:, j] for j in s) for s in subsets], axis=1) == 0
            owner = np.repeat(np.arange(len(chosen)), groups)
            weak = np.bincount(owner, weights=empty.any(axis=1), minlength=len(chosen))
            keep = ~empty | (weak > bands.spare[band[chosen]])[owner][:, None]
            number = np.arange(len(owner)) - first[owner]
            name = (band[chosen][owner].astype(np.uint64) << np.uint64(40)) + (number * len(subsets)).astype(np.uint64)
            named = mix(name[:, None] + np.arange(len(subsets), dtype=np.uint64))
            yield np.repeat(chosen[owner], len(subsets)).reshape(keep.shape)[keep], mix(sums ^ named)[keep]


def _sets(batch: pa.RecordBatch, words: int):
    """Per chunk: first row, row of each shingle, shingles, sizes and keys of the sets."""
    for begin, end, data, bounds in chunks(batch.column("text")):
        rows, values = Words(data, bounds, NOT_SPACE).shingles(words)
        sizes = np.bincount(rows, minlength=end - begin)
        key = np.zeros(end - begin, dtype=np.uint64)
        np.add.at(key, rows, mix(values ^ np.uint64(0x2545F4914F6CDD1D)))
        yield begin, end, rows, values, sizes, mix(key + sizes.astype(np.uint64))


def set_digests(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, text_hash) of every row; equal sets have equal keys. text_hash is Spark's own, to find a text again."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, _, _, sizes, key in _sets(batch, words):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(sizes.astype(np.int64)), pa.array(signed(key)),
                     batch.column("text_hash").slice(begin, end - begin)], ["doc_id", "n_shingles", "set_key", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        digest, "doc_id long, n_shingles long, set_key long, text_hash long")


def signature_rows(docs: DataFrame, words: int, percent: int, slices: int = 1, number: int = 0, hot: np.ndarray | None = None) -> DataFrame:
    """(signature, set_key, spread) rows of one slice of the signatures; copies of one set in one task sign once.

    ``hot`` lists signatures known to be those of several sets (sorted): their
    rows are spread over 1024 numbers from 1 on, all others have 0.
    """
    hot = np.zeros(0, dtype=np.uint64) if hot is None else hot

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            for _, _, rows, values, sizes, key in _sets(batch, words):
                fresh = np.zeros(len(sizes), dtype=bool)
                for i, k in enumerate(key.tolist()):
                    if k not in seen:
                        seen.add(k)
                        fresh[i] = True
                if len(seen) > REMEMBERED:
                    seen.clear()
                some = fresh[rows]
                for who, signature in signatures(rows[some], values[some], np.where(fresh, sizes, 0), bands):
                    if slices > 1:
                        mine = (signature >> np.uint64(40)) % np.uint64(slices) == number
                        who, signature = who[mine], signature[mine]
                    spread = np.zeros(len(who), dtype=np.int16)
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, signature), len(hot) - 1)
                        spread = np.where(hot[at] == signature, 1 + key[who] % np.uint64(1024), 0).astype(np.int16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(signature)), pa.array(signed(key[who])), pa.array(spread)], ["signature", "set_key", "spread"])

    return docs.select("text").mapInArrow(sign, "signature long, set_key long, spread short")


def hot_signatures(docs: DataFrame, words: int, percent: int, one_in: int = SAMPLED, least: int = HOT_ROWS) -> np.ndarray:
    """Signatures that ``least`` sets or more of a sample of the texts share, at most ``HOT_SIGNATURES`` of them.

    They are certain to be shared. The list only spares tasks many rows of one
    signature; whatever it lacks is found like all others.
    """
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    found = (signature_rows(some, words, percent).groupBy("signature").agg(F.count_distinct("set_key").alias("n"))
             .where(F.col("n") >= least).orderBy(F.desc("n"), "signature").limit(HOT_SIGNATURES))
    return np.sort(np.array([r.signature for r in found.select("signature").collect()], dtype=np.int64).view(np.uint64))


def shared_signatures(signed_sets: DataFrame) -> DataFrame:
    """The (signature, set_key) rows whose signature has another set.

    Rows of a signature are sorted next to each other, and a row has company if
    a neighbour has its signature. Rows that are spread are known to have
    company, wherever they are. Rows at the ends of a batch are kept unseen,
    maybe twice; a set alone there is compared with nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature, key, spread = (batch.column(i).to_numpy() for i in range(3))
            fresh = np.ones(len(signature), dtype=bool)
            fresh[1:] = (signature[1:] != signature[:-1]) | (key[1:] != key[:-1])
            signature, key, spread = signature[fresh], key[fresh], spread[fresh]
            keep = spread > 0
            keep[:1] = keep[-1:] = True
            same = signature[1:] == signature[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            yield pa.RecordBatch.from_arrays([pa.array(signature[keep]), pa.array(key[keep])], ["signature", "set_key"])

    return signed_sets.repartition("signature", "spread").sortWithinPartitions("signature", "set_key").mapInArrow(run, "signature long, set_key long")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(set_key, shingles) of the rows whose set has the key asked for; once for each key in a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for begin, end, _, values, sizes, key in _sets(batch, words):
                asked = batch.column("set_key").slice(begin, end - begin).to_pylist()
                ends = np.cumsum(sizes)
                keep = []
                for i, k in enumerate(signed(key).tolist()):
                    if k == asked[i] and k not in done:
                        done.add(k)
                        keep.append(i)
                if len(done) > REMEMBERED:
                    done.clear()
                lists = [pa.array(signed(values[ends[i] - sizes[i] : ends[i]])) for i in keep]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = pa.concat_arrays(lists) if lists else pa.array([], type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([asked[i] for i in keep], type=pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    ["set_key", "shingles"])

    return docs.select("text", "set_key").mapInArrow(read, "set_key long, shingles array<long>")


def _alike(percent: int, common: Column, a: Column, b: Column) -> Column:
    return 100 * common >= percent * (a + b - common)


def _counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, linked) of distinct pairs (a, b): their common shingles, and whether they are similar."""
    left = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("_sa"), F.col("n").alias("_na"))
    right = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("_sb"), F.col("n").alias("_nb"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), "_na", "_nb").select(
        "a", "b", "common", _alike(percent, F.col("common"), F.col("_na"), F.col("_nb")).alias("linked"))


def with_set_keys(docs: DataFrame, words: int, name: str) -> DataFrame:
    """``docs`` with the key of each row's set in a column ``name``; null where the set is empty."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, _, _, sizes, key in _sets(batch, words):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(signed(key), mask=sizes == 0)], [*part.schema.names, name])

    return docs.mapInArrow(run, f"{fields}, `{name}` long")


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """Columns doc_id, n_shingles, component_id of ``jaccard_groups``."""
    return jaccard_groups(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, words: int = 4, percent: int = 85, slices: int = SLICES) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, set_key, group_key for every row of ``docs``.

    Rows are linked when 100 * intersection >= percent * union of their sets of
    ``words``-word shingles; component_id is the smallest doc_id in reach.
    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A
    null, empty or blank text has an empty set and is linked with nothing, so
    its component is its own doc_id. Repeated rows and rows with one set are
    linked; repeated doc_ids are told apart by their sets; a null doc_id counts
    only if a component has no other. Other columns are ignored. set_key is that
    of ``with_set_keys``; group_key tells components of one id apart. Both are
    null for an empty set. ``slices`` changes no result: signatures are sorted
    in so many parts, and more of them take less disk and more time.

    No group emits all its pairs. One set per key signs. Of the sets that share
    a signature with a different set, those with too many shingles that no
    other such set has are dropped, as they can't be similar to any. Then every
    signature compares its sets with one hub, the set with the fewest such
    shingles; sets that are connected with it are not compared with each other, and
    only the others of the same hub are compared with all of its sets, if what
    both have in common with the hub, and what else they may share, allows it.
    """
    scratch = Scratch(docs.sparkSession, "part_enum")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = scratch.save(set_digests(docs, words), "digests")
    hot = hot_signatures(docs, words, percent)
    met_rows = [scratch.save(shared_signatures(signature_rows(docs, words, percent, slices, i, hot)), "shared") for i in range(slices)]
    shared = reduce(DataFrame.unionByName, met_rows)
    nodes = digests.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), "text_hash")).alias("one"))
    wanted = shared.select("set_key").distinct().join(nodes, "set_key").select("set_key", "one._id", "one.text_hash")
    wanted = scratch.save(wanted, "wanted")
    # By id and text: many rows may have one id, or none. A slice of the texts is shuffled at a time.
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), "text", F.xxhash64("text").alias("text_hash"))
    of_slice = [F.pmod("text_hash", F.lit(SHINGLE_SLICES)) == i for i in range(SHINGLE_SLICES)]
    set_parts = [scratch.save(_shingle_sets(texts.where(mine).join(wanted.where(mine).hint("merge"), ["_id", "text_hash"]), words), "sets")
                 for mine in of_slice]
    sets = reduce(DataFrame.unionByName, set_parts)
    # Shingles of one set only, counted a slice of the shingles at a time.
    parts = [scratch.save(
        sets.select("set_key", F.explode("shingles").alias("shingle")).where(F.pmod(F.shiftright("shingle", 7), F.lit(SHINGLE_SLICES)) == i)
        .groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("set_key")).where("n = 1")
        .groupBy("set_key").agg(F.count(F.lit(1)).alias("private")), "private") for i in range(SHINGLE_SLICES)]
    alone = reduce(DataFrame.unionByName, parts).groupBy("set_key").agg(F.sum("private").alias("private"))
    sized = sets.join(alone, "set_key", "left").select(
        "set_key", "shingles", F.size("shingles").alias("n"), F.coalesce("private", F.lit(0)).alias("private"))
    # Few sets are kept, but all are shuffled for it, a slice of the sets at a time.
    similar = sized.where(_alike(percent, F.col("n") - F.col("private"), F.col("n"), F.col("n") - F.col("private")))
    kept_parts = [scratch.save(similar.where(F.pmod("set_key", F.lit(SHINGLE_SLICES)) == i), "kept") for i in range(SHINGLE_SLICES)]
    kept = reduce(DataFrame.unionByName, kept_parts)
    scratch.drop(*set_parts, *parts)
    facts = kept.select("set_key", "n", "private")
    met = scratch.save(shared.distinct().join(facts, "set_key"), "members")
    hubs = met.groupBy("signature").agg(F.min(F.struct("private", "set_key")).alias("hub"))
    members = met.join(hubs.select("signature", F.col("hub.set_key").alias("hub")), "signature")
    star = members.where("set_key <> hub").select(F.col("hub").alias("a"), F.col("set_key").alias("b")).distinct()
    stars = scratch.save(_counted(star, kept, percent), "star")
    links = stars.where("linked").select("a", "b")
    found = scratch.save(components(links, scratch), "found")
    # inner: shingles that a set has in common with the hub; outer: others that some set may share.
    inner, is_hub = F.coalesce("common", F.col("n").cast("int")), F.col("set_key") == F.col("hub")
    # A row for each hub and set: sets that share a signature share its hub.
    main = found.select(F.col("node").alias("hub"), F.col("component").alias("main"))
    placed = scratch.save(
        members.select("hub", "set_key", "n", "private").distinct().join(found, F.col("set_key") == found.node, "left")
        .join(stars.select(F.col("a").alias("hub"), F.col("b").alias("set_key"), "common"), ["hub", "set_key"], "left")
        .join(main, "hub", "left")
        .select("hub", "set_key", "n", inner.alias("inner"),
                F.when(is_hub, 0).otherwise(F.col("n") - inner - F.col("private")).alias("outer"),
                F.coalesce("component", "set_key").alias("component"), F.coalesce("main", "hub").alias("main")), "placed")
    apart = placed.where("component <> main")
    other = placed.select("hub", *[F.col(c).alias(f"o_{c}") for c in ("set_key", "n", "inner", "outer", "component", "main")])
    most = F.least("inner", "o_inner") + F.least("outer", "o_outer")
    rest = (apart.join(other, "hub")
            .where((F.col("component") != F.col("o_component")) & ((F.col("o_component") == F.col("o_main")) | (F.col("set_key") < F.col("o_set_key")))
                   & _alike(percent, most, F.col("n"), F.col("o_n")))
            .select(F.least("set_key", "o_set_key").alias("a"), F.greatest("set_key", "o_set_key").alias("b")).distinct()
            .join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    late = scratch.save(_counted(rest, kept, percent).where("linked").select("a", "b"), "late")
    if late.take(1):
        found = scratch.save(components(
            late.unionByName(found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))),
            scratch), "all")
    # Groups of equal or linked sets, with the smallest doc_id; other rows are their own component.
    named = (nodes.join(found, nodes.set_key == found.node, "left")
             .select("set_key", "rep", "copies", F.coalesce("component", "set_key").alias("component"),
                     F.col("component").isNotNull().alias("linked")))
    names = named.where("linked").groupBy("component").agg(F.min("rep").alias("component_id"))
    groups = (named.where("linked").join(names, "component").select("set_key", "component_id", "component")
              .unionByName(named.where("not linked and copies > 1").select("set_key", F.col("rep").alias("component_id"), "component")))
    groups = scratch.save(groups, "groups")
    scratch.drop(*met_rows, wanted, *kept_parts, met, stars, found, placed, late)
    key = F.when(F.col("n_shingles") > 0, F.col("set_key"))
    return (digests.withColumn("set_key", key).join(groups, "set_key", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_key",
                    F.coalesce("component", "set_key").alias("group_key")))
