"""N-gram Jaccard join with R-trees over count vectors.

A document is the set of its distinct word shingles. The shingles are hashed into groups; the
group counts are a point. Two sets can share no more than the sum, over the groups, of the smaller
count, and a box of points no more than the sum of its coordinate maxima allows; both bounds are
exact, so a search in an R-tree of points loses no link. Survivors are verified on whole sets.

One tree over a corpus would live in one place, so there are many small ones: sets of Jaccard
similarity t share a shingle among the first n - ceil(t * n) + 1 in order of hash, hence a pair
that links meets in the tree of such a shingle. A tree is also cut by set size (linked sizes differ
by a factor of at most 1 / t) and, beyond ``CELL`` points, into pairs of blocks.

Equal sets are one node. Copies that differ slightly come in large groups, whose pairs are never
listed: first every node is compared with one leader per shingle, and the verified links give
components. Then trees give, for every point, its best pairs across components; at last, trees that
had more pairs than that give all that still lie in different components. No pair that could join
two components is left untested, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import marked, release, staging, stored, table
from tidemark.llm.components import components, joined_up
from tidemark.llm.words import Words, chunks, mix

WORDS = 5
PERCENT = 80
CELL = 4096  # points of a block of a tree
LEAF = 32  # points of a leaf
BEST = 6  # pairs that a point gives at first

_DIGEST = np.uint64(0x2545F4914F6CDD1D)


def shingles(words: Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text with fewer words is one shingle."""
    grams = words.grams(size)
    for a, b in zip(words.of_text[:-1], words.of_text[1:], strict=True):
        if b - a >= size:
            found = np.sort(grams[a:b - size + 1])
            fresh = np.ones(len(found), bool)
            fresh[1:] = found[1:] != found[:-1]
            yield found[fresh]
        elif b > a:
            h = words.hashes[a:b]
            yield mix(np.array([sum(int(x) * (2 * i + 3) for i, x in enumerate(h)) + len(h) & (1 << 64) - 1], np.uint64))
        else:
            yield grams[:0]


def _digest(found: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return (int(mix(found).sum().view(np.int64)) if len(found) else 0,
                int(mix(found ^ _DIGEST).sum().view(np.int64)) if len(found) else 0)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def point(found: np.ndarray) -> bytes:
    """Counts of the shingles by the low bits of their hash, two to a byte; the number of groups, a power
    of two, is a quarter of the set's size or more, so that unrelated sets of any size lie far apart, and
    large enough for counts below 16."""
    groups = 16
    while 4 * groups < len(found):
        groups *= 2
    while True:
        counts = np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 16:
            counts = counts.astype(np.uint8)
            return (counts[:groups // 2] | counts[groups // 2:] << 4).tobytes()
        groups *= 2


def counts_of(packed: bytes) -> np.ndarray:
    both = np.frombuffer(packed, np.uint8)
    return np.concatenate((both & 15, both >> 4))


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    """A point in fewer groups."""
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.int32)


_FEATURES = "doc_id long, text_hash long, n long, d1 long, d2 long, keys array<long>, point binary"


def _features(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document: size, digest, prefix and point of its set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in chunks(batch.column("text"), fold=True):
                n, d1, d2, keys, points = [], [], [], [], []
                for found in shingles(words, size):
                    n.append(len(found))
                    x, y = _digest(found)
                    d1.append(x)
                    d2.append(y)
                    keys.append(found[:prefix_length(len(found), percent)])
                    points.append(point(found))
                rows = batch.slice(first, len(words))
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text_hash"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()),
                     pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                     pa.array(points, pa.binary())],
                    names=["doc_id", "text_hash", "n", "d1", "d2", "keys", "point"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(work, _FEATURES))


def _may_link(n_a: np.ndarray, n_b: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """100 * common >= percent * (n_a + n_b - common), for a true or an upper bound of common."""
    return (100 + percent) * common >= percent * (n_a + n_b)


def _bound(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Keeps the pairs a, b whose points leave room for a link."""

    @F.arrow_udf("boolean")
    def near(n_a: pa.Array, p_a: pa.Array, n_b: pa.Array, p_b: pa.Array) -> pa.Array:
        keep = []
        for x, p, y, q in zip(n_a.to_numpy(), p_a.to_pylist(), n_b.to_numpy(), p_b.to_pylist(), strict=True):
            groups = 2 * min(len(p), len(q))
            common = np.minimum(fold(counts_of(p), groups), fold(counts_of(q), groups)).sum()
            keep.append(bool(_may_link(x, y, common, percent)))
        return pa.array(keep, pa.bool_())

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("point").alias(f"p_{s}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
            .filter(near("n_a", "p_a", "n_b", "p_b")).select("a", "b"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs a, b whose whole sets link. Sets are made again, for the texts in question only."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in chunks(batch.column("text"), fold=True):
                found = list(shingles(words, size))
                digests = [_digest(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x) for x in found], pa.int64()), pa.array([x for x, _ in digests], pa.int64()),
                     pa.array([y for _, y in digests], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                    names=["n", "d1", "d2", "shingles"])

    @F.arrow_udf("boolean")
    def links(a: pa.Array, b: pa.Array) -> pa.Array:
        said = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((x, y)))
            common = int((both[1:] == both[:-1]).sum())
            said.append(100 * common >= percent * (len(both) - common))
        return pa.array(said, pa.bool_())

    asked = (pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
             .join(nodes.select("node", "doc_id", "text_hash", "n", "d1", "d2"), "node"))
    asked = stored(asked, "asked")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    wanted = asked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    # few texts are asked for: the others are left out before texts are shuffled
    texts = marked(texts, ["doc_id", "text_hash"], wanted).filter("_may")
    # rows that repeat in every column stay apart until their digests have been made
    whole = (texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
             .select("text").mapInArrow(sets, "n long, d1 long, d2 long, shingles binary")
             .dropDuplicates(["n", "d1", "d2"]))
    whole = stored(asked.select("node", "n", "d1", "d2").join(whole, ["n", "d1", "d2"]).select("node", "shingles"), "sets")
    return (pairs.join(whole.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a")
            .join(whole.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b")
            .filter(links("s_a", "s_b")).select("a", "b"))


def _room(n_a: np.ndarray, pos_a: np.ndarray, n_b: np.ndarray, pos_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair may meet here: at its first common shingle, none of the earlier ones of either
    set is common, so the places in the prefixes bound what is."""
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits & _may_link(n_a, n_b, np.minimum(n_a - pos_a, n_b - pos_b), percent)


def tree_pairs(n: np.ndarray, points: list[bytes], comp: np.ndarray, block: np.ndarray, home: np.ndarray,
               pos: np.ndarray, percent: int, most: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs that an R-tree over the points cannot rule out: in different components, of different
    blocks where there are two, at least one of them at home in the cell.

    Points are packed into leaves in order of size; a leaf has the largest coordinates and the
    smallest size of its points. Leaves are held against leaves, then points against points. With
    ``most``, every point gives its ``most`` best pairs only, and the third value says whether any
    was left out.
    """
    order = np.argsort(n, kind="stable")
    n, comp, block, home, pos = n[order], comp[order], block[order], home[order], pos[order]
    m, none = len(n), np.zeros(0, np.int64)
    two = block.min() != block.max()

    def allowed(a: slice, b: slice) -> np.ndarray:
        fits = (comp[a, None] != comp[None, b]) & (home[a, None] | home[None, b])
        if two:
            fits &= block[a, None] != block[None, b]
        if a.start == b.start:
            fits = np.triu(fits, 1)
        return fits & _room(n[a, None], pos[a, None], n[None, b], pos[None, b], percent)

    if m <= LEAF and not allowed(slice(0, m), slice(0, m)).any():
        return none, none, False
    raw = [counts_of(points[i]) for i in order]
    groups = min(len(p) for p in raw)
    flat = np.stack([fold(p, groups) for p in raw])
    starts = np.arange(0, m, LEAF)
    box = np.maximum.reduceat(flat, starts, axis=0)
    least, greatest = n[starts], n[np.minimum(starts + LEAF, m) - 1]
    left, right, cut = [], [], False
    for i, s in enumerate(starts):
        # leaves are in order of size: those beyond the allowed ratio end the scan
        last = int(np.searchsorted(least, greatest[i] * 100 // percent, "right"))
        room = np.minimum(box[i], box[i:last]).sum(axis=1)
        a = slice(s, min(s + LEAF, m))
        xs, ys, scores = [], [], []
        for j in i + np.flatnonzero(_may_link(least[i], least[i:last], room, percent)):
            b = slice(starts[j], min(starts[j] + LEAF, m))
            x, y = np.nonzero(allowed(a, b))
            x, y = x + a.start, y + b.start
            common = np.minimum(flat[x], flat[y]).sum(axis=1)
            fits = _may_link(n[x], n[y], common, percent)
            xs.append(x[fits])
            ys.append(y[fits])
            scores.append(common[fits] / (n[x[fits]] + n[y[fits]]))
        if not xs:
            continue
        x, y = np.concatenate(xs), np.concatenate(ys)
        if most is not None and len(x):
            by = np.lexsort((-np.concatenate(scores), x))
            x, y = x[by], y[by]
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            best = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) < most
            cut |= not best.all()
            x, y = x[best], y[best]
        left.append(order[x])
        right.append(order[y])
    return (np.concatenate(left), np.concatenate(right), cut) if left else (none, none, False)


def _searched(shared: DataFrame, comp: DataFrame, nodes: DataFrame, percent: int, most: int | None = None,
              only: DataFrame | None = None) -> DataFrame:
    """Candidate pairs a, b across components, from the trees of all shared prefix shingles.

    With ``most``, rows with key and tree but without a and b name the trees that had more pairs;
    ``only`` restricts the search to such trees.
    """
    rows = (shared.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # a class of sizes and the next one hold every pair that can link
    size_class = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")
    rows = (rows.withColumn("class", size_class).withColumn("place", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("tree", F.col("class") + F.col("place")).withColumn("home", F.col("place") == 0))
    if only is not None:
        rows = (marked(rows, ["key", F.col("tree").cast("long")], only.select("key", "tree")).filter("_may").drop("_may")
                .join(only, ["key", "tree"]))
    at = Window.partitionBy("key", "tree")
    rows = (rows.withColumn("size", F.count(F.lit(1)).over(at)).withColumn("at_home", F.max("home").over(at))
            .withColumn("lo", F.min("component").over(at)).withColumn("hi", F.max("component").over(at))
            .filter("at_home and lo < hi"))
    # beyond CELL points a tree is cut into blocks, and every pair of blocks is a cell
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    rows = (rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
            .select("key", "tree", "low", "high", "block", "home", "node", "component", "pos"))
    # where all pairs are asked for, a pair is given by the tree of its first common shingle alone: that
    # tree is searched here too, or it gave all its pairs before
    first_only = most is None
    wide = nodes.select("node", "n", "point", *(["keys"] if first_only else []))
    if only is not None:
        # few nodes lie in such trees: the others are left out before points and keys are shuffled
        rows = stored(rows, "cells")
        wide = marked(wide, ["node"], rows.select("node").distinct()).filter("_may").drop("_may")
    rows = rows.join(wide, "node")
    cell = ["key", "tree", "low", "high"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in chain(batches, (None,)):
            if batch is not None:
                fresh = pa.Table.from_batches([batch])
                kept = fresh if kept is None else pa.concat_tables([kept, fresh])
            if kept is None or not kept.num_rows:
                continue
            cols = {c: kept[c].to_numpy() for c in (*cell, "n", "node", "component", "block", "pos")}
            home, points = kept["home"].to_pandas().to_numpy(bool), kept["point"].combine_chunks()
            cut = np.zeros(kept.num_rows - 1, bool)
            for c in cell:
                cut |= cols[c][1:] != cols[c][:-1]
            heads = np.concatenate(([0], np.flatnonzero(cut) + 1))
            stops = np.append(heads[1:], kept.num_rows)
            done = len(heads) if batch is None else len(heads) - 1  # the last cell may go on in the next batch
            found: set[tuple[int, int]] = set()
            open_trees: set[tuple[int, int]] = set()
            for s, e in zip(heads[:done], stops[:done], strict=True):
                comp, node = cols["component"][s:e], cols["node"][s:e]
                if e - s < 2 or comp.min() == comp.max():
                    continue
                x, y, more = tree_pairs(cols["n"][s:e], points[s:e].to_pylist(), comp, cols["block"][s:e], home[s:e],
                                        cols["pos"][s:e], percent, most)
                if first_only and len(x):
                    before = [set(k[:p]) for k, p in zip(kept["keys"][s:e].to_pylist(), cols["pos"][s:e].tolist(), strict=True)]
                    first = np.array([before[i].isdisjoint(before[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)])
                    x, y = x[first], y[first]
                found.update(zip(np.maximum(node[x], node[y]).tolist(), np.minimum(node[x], node[y]).tolist(), strict=True))
                if more:
                    open_trees.add((int(cols["key"][s]), int(cols["tree"][s])))
            pairs, trees = sorted(found), sorted(open_trees)
            if pairs or trees:
                column = lambda rows, i, before, after: pa.array([None] * before + [r[i] for r in rows] + [None] * after, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [column(pairs, 0, 0, len(trees)), column(pairs, 1, 0, len(trees)),
                     column(trees, 0, len(pairs), 0), column(trees, 1, len(pairs), 0)], names=["a", "b", "key", "tree"])
            kept = kept.slice(stops[done - 1]) if done else kept

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(search, "a long, b long, key long, tree long")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, component (null: empty set), component_id; one row per row of ``docs``."""
    features = stored(_features(docs, size, percent).withColumn("row", F.monotonically_increasing_id()), "features")
    full = features.filter("n > 0")
    classes = full.groupBy("n", "d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"))
    classes = stored(classes, "classes")
    copies = stored(full.select("row").join(classes.select(F.col("node").alias("row")), "row", "left_anti"), "copies")
    found = marked(full, ["row"], copies)
    nodes = found.filter("not _may").unionByName(found.filter("_may").join(copies, "row", "left_anti"))
    nodes = stored(nodes.drop("_may").withColumnRenamed("row", "node"), "nodes")
    # only the narrow columns are needed to the end
    rows = stored(features.select("doc_id", "text_hash", "n", "d1", "d2"), "rows")
    release(features)

    at = Window.partitionBy("key")
    shared = (nodes.select("node", "n", F.posexplode("keys").alias("pos", "key"))
              .withColumn("leader", F.min("node").over(at)).withColumn("nodes", F.count(F.lit(1)).over(at))
              .filter("nodes > 1"))
    shared = stored(shared, "shared")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        with staging() as keep:
            return keep(stored(_verified(pairs, nodes, docs, size, percent), name))

    # every node against one leader per shingle
    stars = shared.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    tested = stored(_bound(stars, nodes, percent), "stars")
    every = stored(components(verified(tested, "linked")), "groups")
    # two nodes are a leader and its only other one, a pair that is tested already
    shared = shared.filter("nodes > 2").drop("leader", "nodes")
    # the best pairs of every tree, then all pairs of the trees that have more
    found = stored(_searched(shared, every, nodes, percent, BEST), "found")
    pairs = lambda rows: rows.filter("a is not null").select("a", "b").distinct()
    fresh = stored(pairs(found).join(tested, ["a", "b"], "left_anti"), "fresh")
    every = stored(joined_up(every, verified(fresh, "more")), "groups")
    open_trees = stored(found.filter("key is not null").select("key", "tree").distinct(), "open")
    if not open_trees.isEmpty():
        rest = pairs(_searched(shared, every, nodes, percent, None, open_trees))
        rest = stored(rest.join(tested.unionByName(fresh), ["a", "b"], "left_anti"), "rest")
        every = joined_up(every, verified(rest, "rest-linked"))

    named = (classes.join(every, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = named.join(least, "component").select("n", "d1", "d2", "component", "component_id")
    return (rows.join(found, ["n", "d1", "d2"], "left")
            .select("doc_id", "text_hash", "n", "component",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``docs`` needs doc_id and text; other columns are not read. A null or empty text, or one without
    words, has an empty set and links with nothing: its component is its own doc_id. Rows with equal
    sets are linked, rows that share a doc_id too only if their sets link. A row without doc_id takes
    part; the component of a group without any doc_id is null. An empty table gives an empty table.
    """
    with staging() as keep:
        rows = keep(stored(_grouped(docs, size, percent), "grouped"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of every component, the one with the smallest doc_id (null last; then
    the smallest hash of its text). Of rows that repeat doc_id and text one stays. Texts without words
    all stay. Columns are kept."""
    with staging() as keep:
        rows = stored(_grouped(docs, size, percent), "grouped")
        rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
        # the rows that are equal to the first of a component are counted, so that only these are held against each other
        firsts = (rows.filter("component is not null").groupBy("component").agg(F.min(rank).alias("first"))
                  .select("component", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")))
        counts = rows.filter("component is not null").groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("same"))
        counts = counts.join(firsts, "component").filter(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
        blank = rows.filter("component is null").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.lit(1).alias("same")).distinct()
        kept_keys = keep(stored(counts.select("id", "hash", "same").unionByName(blank), "kept"))
        plain = kept_keys.filter("same = 1")
        others = rows.select("doc_id", "text_hash").distinct()
        others = others.join(plain, others["doc_id"].eqNullSafe(plain["id"]) & (others["text_hash"] == plain["hash"]), "left_anti")
        others = keep(stored(others, "others"))
    # the row as one column, so that its names cannot clash
    whole = docs.select(F.struct("*").alias("row"))
    key = [F.col("row.doc_id").cast("long"), F.xxhash64("row.text")]
    # rows that surely stay, one by one, are not shuffled
    whole = marked(whole, key, others)
    kept = whole.filter("_may").join(kept_keys, key[0].eqNullSafe(F.col("id")) & (key[1] == F.col("hash")))
    single, several = kept.filter("same = 1"), kept.filter("same > 1").dropDuplicates(["id", "hash"])
    return whole.filter("not _may").select("row.*").unionByName(single.unionByName(several).select("row.*"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over all ``documents``; odd texts and rows as in ``jaccard_components``."""
    return jaccard_components(table(spark, sf_dir, "documents"))
