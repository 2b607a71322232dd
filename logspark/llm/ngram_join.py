"""Which documents link by the Jaccard similarity of their word shingles.

Shingles are hashed into groups, and a set becomes the vector of its group
counts. Two sets can share no more than the summed minima of their counts, which
bounds their similarity from above; only pairs that pass are verified with the
shingles themselves.

Candidates meet by the pigeonhole principle. Two linked sets differ in at most r
shingles, r following from their sizes; of more than r groups, some hold the very
same shingles in both. So documents meet under the digest of a group, and never
under a group that is empty or under what merely is frequent. Small sets meet
under the least hashes of their prefix instead. The documents under a key link to
the least of them first, and pairs that pass the bound are verified. Where some
stay apart although they met, an R-tree over their count vectors finds all other
pairs between different components that pass the bound, and those are verified.
No link between components is lost, and no group is expanded into all its pairs.

Shingles are 64-bit hashes. A text with fewer words than a shingle has one
shingle, its whole sequence; a text without words (null, empty, blank) has none
and links with nothing. Rows of one doc_id share a component, which
every text of theirs can link; rows without doc_id link with nothing.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import read_documents, text_blocks, texts, written
from logspark.llm.components import components
from logspark.llm.hashing import mix, shingle_sets

SHINGLE_WORDS = 5
# Links need intersection * 100 >= PERCENT * union.
PERCENT = 80
#: Sets smaller than this meet by prefix, larger ones by groups.
SMALL = 100
_RATIO = 1.5
DIMENSIONS = 512
# Entries of one R-tree, and of a leaf.
TREE_POINTS, LEAF = 8192, 32
# Bits of the filter that finds the documents of candidate pairs.
FILTER_BITS = 1 << 26


def least_size(size: np.ndarray, percent: int) -> np.ndarray:
    """The smallest set that can link with one of this size."""
    return -(-size * percent // 100)


@functools.cache
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size bands: their beginnings, the most differing shingles of a link, the number of groups.

    A band serves links whose smaller set lies in it. Links differ in at most a
    quarter (at 80 %) of the smaller set. Groups are as many as differences plus
    room for empty groups, so that few sets have as many empty groups as there
    are groups without a difference.
    """
    begins = [SMALL]
    while begins[-1] < 1 << 40:
        begins.append(int(begins[-1] * _RATIO))
    most = [(end - 1) * (100 - percent) // percent for end in begins[1:]]
    groups = []
    for begin, r in zip(begins, most):
        m = r + 1
        while True:
            empty = (1 - 1 / m) ** begin
            if m - r > m * empty + 4 * (m * empty * (1 - empty)) ** 0.5 or m > 2 * r + 8:
                break
            m += 1 + m // 64
        groups.append(m)
    return np.array(begins), np.array(most), np.array(groups)


def meeting_keys(values: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and texts (of a block): linked sets have a key in common."""
    sizes = np.diff(first)
    owners = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(values)) - first[owners]
    small = sizes < SMALL * 100 / percent
    prefix = sizes - least_size(sizes, percent) + 1
    near = small[owners] & (rank < prefix[owners])
    keys, texts_of = [mix(values[near] ^ np.uint64(0x5851F42D4C957F2D))], [owners[near]]
    begins, most, groups = bands(percent)
    own = np.searchsorted(begins, sizes, "right") - 1
    # A set serves its own band, and those below whose sets are large enough to link.
    below = int(np.log(100 / percent) / np.log(_RATIO)) + 2
    for band in (own - step for step in range(below + 1)):
        served = (band >= 0) & (sizes > 0)
        served &= begins[np.maximum(band, 0) + 1] - 1 >= least_size(sizes, percent)
        picked = served[owners]
        if not picked.any():
            continue
        text, value = owners[picked], values[picked]
        count = groups[np.maximum(band, 0)]
        group = (mix(value + np.uint64(1)) % count[text].astype(np.uint64)).astype(np.int64)
        cell = text * (1 << 32) + group
        order = np.argsort(cell)
        cell = cell[order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        digest = np.add.reduceat(mix(value[order] + np.uint64(2)), starts)
        text, group = cell[starts] >> 32, cell[starts] & 0xFFFFFFFF
        salt = mix((band[text] + 7).astype(np.uint64) * np.uint64(1 << 32) + group.astype(np.uint64))
        keys.append(mix(digest ^ salt))
        texts_of.append(text)
        # Sets with as many empty groups as may be alike in a link meet under these too.
        filled = np.bincount(text, minlength=len(sizes))
        empty = np.where(served, count - filled, 0)
        for at in np.flatnonzero(served & (empty >= count - most[np.maximum(band, 0)])):
            spare = np.setdiff1d(np.arange(count[at]), group[text == at])
            salt = mix(np.uint64((int(band[at]) + 7) << 32) + spare.astype(np.uint64))
            keys.append(mix(salt))
            texts_of.append(np.full(len(spare), at))
    return np.concatenate(keys), np.concatenate(texts_of)


def key_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, doc_id)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, raw, offsets in text_blocks(batch.column("text")):
                keys, owners = meeting_keys(*shingle_sets(raw, offsets, width), percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), ids.take(pa.array(owners + at))], names=["key", "doc_id"]
                )

    return texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, "key long, doc_id long")


def meetings(keys: DataFrame) -> DataFrame:
    """(a, b, times): the least document under a key, and each other one, with the number of such keys."""

    def run(batches):
        last, leader = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            begins = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
            first = np.where(at >= 0, ids[at], 0 if leader is None else leader)
            last, leader = key[-1], first[-1]
            other = first != ids
            if not other.any():
                continue
            pairs = np.stack([first[other], ids[other]], axis=1)
            pairs, times = np.unique(pairs, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(times)], names=["a", "b", "times"]
            )

    sorted_keys = keys.repartition("key").sortWithinPartitions("key", "doc_id")
    met = sorted_keys.mapInArrow(run, "a long, b long, times long")
    return met.groupBy("a", "b").agg(F.sum("times").alias("times"))


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of hashed doc_ids of fixed size; at most ``bits / 64`` words reach the driver."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select(F.shiftright(place, 6).cast("int").alias("word"), (place % 64).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["set"].to_numpy()
    return out


def vectors(values: np.ndarray, first: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Group counts of each set of a block, one row per set."""
    rows = len(first) - 1
    owners = np.repeat(np.arange(rows), np.diff(first))
    group = (mix(values + np.uint64(3)) % np.uint64(dimensions)).astype(np.int64)
    return np.bincount(owners * dimensions + group, minlength=rows * dimensions).reshape(rows, dimensions).astype(np.int32)


def packed(counts: np.ndarray) -> bytes:
    """Group counts as bytes, a byte for each if they fit."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == DIMENSIONS else np.uint32)


def _shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Summed minima of rows."""
    return np.minimum(one, two).sum(axis=1, dtype=np.int64)


def points(docs: DataFrame, ids: DataFrame, width: int, with_sets: bool) -> DataFrame:
    """(doc_id, size, counts, shingles) of the documents whose id passes the filter of ``ids``.

    ``shingles`` is the sorted set as bytes, or null without ``with_sets``. The filter
    spares moving other texts; ids that pass by chance do no harm.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = (bitmap.value[place >> 6] >> (place & 63)) & 1
            batch = batch.filter(pa.array(hit.astype(bool)))
            for at, raw, offsets in text_blocks(batch.column("text")):
                values, first = shingle_sets(raw, offsets, width)
                counts = vectors(values, first)
                sets = [values[a:b].tobytes() if with_sets else None for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(sets)),
                        pa.array(np.diff(first)),
                        pa.array([packed(row) for row in counts], pa.binary()),
                        pa.array(sets, pa.binary()),
                    ],
                    names=["doc_id", "size", "counts", "shingles"],
                )

    rows = texts(docs).where("doc_id IS NOT NULL")
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    return rows.mapInArrow(run, "doc_id long, size long, counts binary, shingles binary")


def _passes(shared: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether an intersection of this size makes a link; ``total`` is the sum of both sizes."""
    return 100 * shared >= percent * (total - shared)


def bounded(pairs: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose summed minima still allow a link; their other columns stay."""
    names = pairs.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.stack([unpacked(x) for x in batch.column(name).to_pylist()]) for name in ("counts_a", "counts_b")
            )
            total = one.sum(axis=1, dtype=np.int64) + two.sum(axis=1, dtype=np.int64)
            yield batch.select(names).filter(pa.array(_passes(_shared(one, two), total, percent)))

    sides = [
        places.select(F.col("doc_id").alias(name), F.col("counts").alias(f"counts_{name}")) for name in ("a", "b")
    ]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select(*names, "counts_a", "counts_b")
    schema = ", ".join(f"{name} long" for name in names)
    return joined.mapInArrow(run, schema)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their shingle sets."""

    def run(batches):
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                small, large = (one, two) if len(one) <= len(two) else (two, one)
                at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
                shared = int((large[at] == small).sum()) if len(large) else 0
                kept.append(shared > 0 and bool(_passes(shared, len(one) + len(two), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    sets = points(docs, ids, width, True).select("doc_id", "shingles")
    sides = [
        sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"set_{name}")) for name in ("a", "b")
    ]
    joined = pairs.select("a", "b").join(sides[1], "b").join(sides[0], "a")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


class RTree:
    """Points in leaves under boxes: per node the largest count of each group, and the sizes.

    Built by cutting the points in halves along the coordinate that spreads most,
    the size being one of them.
    """

    def __init__(self, counts: np.ndarray, leaf: int = LEAF):
        self.counts, self.sizes = counts, counts.sum(axis=1, dtype=np.int64)
        self.order = np.arange(len(counts))
        self.levels: list[tuple[np.ndarray, ...]] = []
        cuts = self._cut(np.arange(len(counts)), leaf)
        self.order = np.concatenate(cuts) if cuts else self.order
        begins = np.concatenate([[0], np.cumsum([len(x) for x in cuts])[:-1]]).astype(np.int64)
        ordered = self.counts[self.order]
        sizes = self.sizes[self.order]
        while len(begins):
            ends = np.append(begins[1:], len(ordered))
            self.levels.append(
                (begins, ends, np.maximum.reduceat(ordered, begins), np.minimum.reduceat(sizes, begins), np.maximum.reduceat(sizes, begins))
            )
            if len(begins) == 1:
                break
            begins = begins[::8]

    def _cut(self, members: np.ndarray, leaf: int) -> list[np.ndarray]:
        if len(members) <= leaf:
            return [members] if len(members) else []
        spread = np.column_stack([self.counts[members], self.sizes[members]])
        axis = int(np.argmax(spread.std(axis=0)))
        order = members[np.argsort(spread[:, axis], kind="stable")]
        half = len(order) // 2
        return self._cut(order[:half], leaf) + self._cut(order[half:], leaf)

    def search(self, query: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The points whose summed minima with the query allow a link, and the similarity these allow."""
        size = int(query.sum(dtype=np.int64))
        live = None
        for begins, ends, most, low, high in reversed(self.levels):
            at = np.arange(len(begins)) if live is None else live
            shared = np.minimum(_shared(most[at], query), np.minimum(high[at], size))
            at = at[_passes(shared, low[at] + size, percent)]
            if not len(at):
                return at, np.zeros(0)
            live = at if begins is self.levels[0][0] else (at[:, None] * 8 + np.arange(8)).ravel()
            below = len(self.levels[0][0]) if begins is self.levels[0][0] else None
            if below is None:
                depth = next(i for i, level in enumerate(self.levels) if level[0] is begins)
                live = live[live < len(self.levels[depth - 1][0])]
        begins, ends = self.levels[0][:2]
        places = np.concatenate([self.order[begins[leaf] : ends[leaf]] for leaf in live])
        shared, total = _shared(self.counts[places], query), self.sizes[places] + size
        kept = _passes(shared, total, percent)
        return places[kept], shared[kept] / np.maximum(total - shared, 1)[kept]


def tree_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one group, of different components, that pass the bound, and the bound.

    ``groups`` has leader, doc_id, component, size and counts. A group is cut by
    size into cells, since links need like sizes. A cell's documents are dealt to
    trees of bounded size, and all documents of the cell and of the one below are
    searched in each tree, passing by one at a time.
    """
    # A little wider than the ratio of linked sizes, so that these never lie two cells apart.
    band = F.floor(F.log("size") / F.lit(float(np.log(100 / percent)) * 1.01)).cast("int")
    rows = groups.withColumn("cell", band)
    trees = rows.groupBy("leader", "cell").agg(
        F.ceil(F.count("*") / F.lit(TREE_POINTS)).cast("int").alias("trees")
    )
    own = rows.join(trees, ["leader", "cell"])
    points_of = own.withColumn("tree", F.pmod(F.xxhash64("doc_id"), F.col("trees")).cast("int")).withColumn("role", F.lit(0))
    near = rows.select("leader", "doc_id", "component", "size", "counts", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    seekers = (
        near.join(trees, ["leader", "cell"])
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .withColumn("role", F.lit(1))
    )
    names = ["leader", "cell", "tree", "role", "doc_id", "component", "counts"]
    laid = points_of.select(*names).unionByName(seekers.select(*names))
    laid = laid.repartition("leader", "cell", "tree").sortWithinPartitions("leader", "cell", "tree", "role")

    def run(batches):
        where, held, tree, ids, parts = None, [], None, None, None
        found = []
        for batch in batches:
            for leader, cell, number, role, doc_id, component, counts in zip(*(batch.column(n).to_pylist() for n in names)):
                if (leader, cell, number) != where:
                    where, held, tree = (leader, cell, number), [], None
                point = unpacked(counts)
                if role == 0:
                    held.append((doc_id, component, point))
                    continue
                if tree is None:
                    ids, parts = np.array([x[0] for x in held]), np.array([x[1] for x in held])
                    tree = RTree(np.stack([x[2] for x in held]))
                hits, near = tree.search(point, percent)
                apart = parts[hits] != component
                hits, near = hits[apart], near[apart]
                for x, part, bound in zip(ids[hits].tolist(), parts[hits].tolist(), near.tolist()):
                    one, two = sorted(((doc_id, component), (x, part)))
                    found.append((*one, *two, bound))
                if len(found) > 10_000:
                    yield _pairs(found)
                    found = []
        if found:
            yield _pairs(found)

    return laid.mapInArrow(run, "a long, part_a long, b long, part_b long, bound double").distinct()


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values) for values in zip(*found)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "part_a", "b", "part_b", "bound"])


def _labelled(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Add the components of both ends; a document without links is its own."""
    out = pairs
    for name in ("a", "b"):
        side = parts.select(F.col("node").alias(name), F.col("component").alias(f"part_{name}"))
        out = out.join(side, name, "left").withColumn(f"part_{name}", F.coalesce(f"part_{name}", name))
    return out


def link_components(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, component) for all documents that link with another one."""
    docs = texts(docs).where("doc_id IS NOT NULL")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        # Repeated rows would meet themselves again and again.
        docs = docs.distinct()
    met = written(meetings(key_rows(docs, width, percent)), "meetings")
    ids = met.select(F.col("a").alias("doc_id")).union(met.select("b"))
    places = written(points(docs, ids, width, False).drop("shingles"), "points")
    near = written(bounded(met, places, percent), "near")
    # Each document first tries the one it shares most keys with; then pairs still apart.
    best = near.groupBy(F.col("b")).agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a"))
    first = written(verified(best.select("a", "b"), docs, width, percent), "links")
    parts = written(components(first), "parts")
    apart = _labelled(near.join(best, ["a", "b"], "left_anti"), parts).where("part_a <> part_b").select("a", "b")
    apart = written(apart, "apart")
    if not apart.isEmpty():
        first = written(first.unionByName(verified(apart, docs, width, percent)), "links")
        parts = written(components(first), "parts")
    # Groups whose members are still apart: other pairs of them may link.
    split = _labelled(met.select("a", "b"), parts).where("part_a <> part_b").select(F.col("a").alias("leader")).distinct()
    members = met.join(split.withColumnRenamed("leader", "a"), "a", "left_semi")
    members = members.select(F.col("a").alias("leader"), F.col("b").alias("doc_id"))
    where = parts.select(F.col("node").alias("doc_id"), "component")
    groups = (
        members.join(where, "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
        .join(places, "doc_id")
    )
    others = tree_pairs(groups, percent).join(near.select("a", "b"), ["a", "b"], "left_anti")
    others = written(others, "others")
    if others.isEmpty():
        return parts
    # Of two components the nearest pair comes first; it mostly joins them, and spares the rest.
    ends = F.least("part_a", "part_b"), F.greatest("part_a", "part_b")
    nearest = others.groupBy(ends[0].alias("one"), ends[1].alias("two")).agg(
        F.max_by(F.struct("a", "b"), F.struct("bound", "a", "b")).alias("pair")
    )
    nearest = written(nearest.select("pair.*"), "nearest")
    first = written(first.unionByName(verified(nearest, docs, width, percent)), "links")
    parts = written(components(first), "parts")
    rest = _labelled(others.select("a", "b").join(nearest, ["a", "b"], "left_anti"), parts)
    rest = written(rest.where("part_a <> part_b").select("a", "b"), "rest")
    if rest.isEmpty():
        return parts
    return components(written(first.unionByName(verified(rest, docs, width, percent)), "links"))


def set_sizes(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sizes = [np.diff(shingle_sets(raw, offsets, width)[1]) for _, raw, offsets in text_blocks(batch.column("text"))]
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.concatenate(sizes))], names=["doc_id", "n_shingles"]
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long")


def similar_groups(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    parts = link_components(docs, width, percent).select(F.col("node").alias("doc_id"), F.col("component"))
    return (
        set_sizes(docs, width)
        .join(parts, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that link to a document of lesser doc_id."""
    parts = link_components(docs, width, percent).where("node <> component")
    return docs.join(parts.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)


def op5_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read_documents(spark, sf_dir))
