"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned that turns centred, projected vectors into balanced binary codes with little loss:
signs are taken, and the rotation that brings the vectors closest to them, in turns. Several rotations,
each from a start of its own, give a code of several hundred bits. It is cut into substrings, and each
substring is a table: vectors that agree in one of them meet. Their whole codes are compared, and what is
within the Hamming radius of the wanted angle is judged by the original vectors.

Copies come in groups whose pairs are never listed. Equal vectors are one node. Every node is held against
one leader per bucket; those that link with a leader form a cluster, and the members within half the wanted
angle of its centre are a ball: by the triangle inequality all of them link with each other. Balls, and all
other nodes as balls of radius zero, are what the tables hold. Two balls are unlinked, or linked member by
member, if distance and radii say so; where these leave it open, members are compared in blocks, which
return counts. So the links found are counted exactly, and only the tables can miss one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import release, stored, table
from tidemark.llm.components import components
from tidemark.llm.vector_search import usable

COSINE = 0.95
CODE_BITS = 64  # bits of a rotation at most
ROUNDS = 30  # of the learning
SAMPLE_ROWS, SAMPLE_NUMBERS = 8192, 1 << 22  # bounds of the rows that rotations are learned on
RECALL = 0.97  # wanted of pairs just at the threshold; closer pairs are found more surely
CELL = 1024  # balls of a bucket beyond which it is cut into blocks
BLOCK = 256  # members of a ball compared at once
_EPS = 1e-9


def plan(rows: int, cosine: float) -> tuple[int, int]:
    """Bits of a substring, as many as number the rows, and substrings, so many that a pair at the
    threshold agrees in one of them with probability ``RECALL``."""
    bits = max(8, math.ceil(math.log2(max(2, rows))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def learn(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre, and a matrix whose products' signs are ``bits`` bits: principal directions times one
    learned rotation after the other."""
    centre = sample.mean(axis=0)
    x = sample - centre
    _, vectors = np.linalg.eigh(x.T @ x)
    directions = vectors[:, ::-1][:, :CODE_BITS]
    v = x @ directions
    rng, parts = np.random.default_rng(7), []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(ROUNDS):
            signs = np.where(v @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ signs)
            turn = left @ right
        parts.append(directions @ turn)
    return centre, np.hstack(parts)[:, :bits]


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix, short lists filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _unit(vectors: pa.Array) -> pa.Array:
    """Vectors of length one; all zeros become null."""
    out = []
    for x in vectors:
        x = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0)
        top = np.abs(x).max(initial=0.0)
        out.append(x / top / np.linalg.norm(x / top) if top > 0 else None)
    return pa.array(out, pa.list_(pa.float64()))


def _dots(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Inner products row by row; of vectors of different length, zero."""
    x, y = a.value_lengths().to_numpy(zero_copy_only=False), b.value_lengths().to_numpy(zero_copy_only=False)
    width = int(max(x.max(initial=0), y.max(initial=0)))
    return np.where(x == y, np.einsum("nd,nd->n", _matrix(a, width), _matrix(b, width)), 0.0)


@F.arrow_udf(T.DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_dots(a, b))


def _coder(model: tuple[np.ndarray, np.ndarray], bits: int, tables: int):
    centre, turn = model
    words = -(-bits * tables // 64)

    @F.arrow_udf("struct<code:array<bigint>,keys:array<bigint>>")
    def encode(units: pa.Array) -> pa.Array:
        flags = (_matrix(units, len(centre)) - centre) @ turn >= 0
        padded = np.zeros((len(flags), words * 64), bool)
        padded[:, :flags.shape[1]] = flags
        code = np.packbits(padded, axis=1, bitorder="little").view(np.int64)
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        keys = flags.reshape(len(flags), tables, bits) @ weights
        return pa.StructArray.from_arrays([_lists(code), _lists(keys)], names=["code", "keys"])

    return encode


def _model(nodes: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Learned on at most ``SAMPLE_ROWS`` nodes and ``SAMPLE_NUMBERS`` components, dealt by hash."""
    width = nodes.agg(F.max("dim")).first()[0]
    rows = min(SAMPLE_ROWS, max(256, SAMPLE_NUMBERS // width))
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(rows).select("unit").collect()
    sample = np.zeros((len(drawn), width))
    for i, row in enumerate(drawn):
        sample[i, :len(row[0])] = row[0]
    return learn(sample, bits)


def _radius(angle: np.ndarray | float, bits: int) -> np.ndarray:
    """Hamming distance that codes at this angle stay below: six deviations above the mean."""
    share = np.minimum(np.asarray(angle) / np.pi, 0.5)
    return bits * share + 6 * np.sqrt(bits * share * (1 - share))


def _clusters(nodes: DataFrame, cosine: float, bits: int) -> DataFrame:
    """node, cluster: every node with the smallest leader it links with, a leader without one alone."""
    filed = nodes.select("node", "dim", "code", F.posexplode("keys").alias("t", "key"))
    leaders = filed.groupBy("t", "key", "dim").agg(F.min(F.struct("node", "code")).alias("leader"), F.count(F.lit(1)).alias("size"))
    met = filed.join(leaders.filter("size > 1"), ["t", "key", "dim"]).filter(F.col("node") > F.col("leader.node"))
    apart = F.aggregate(F.zip_with("code", "leader.code", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("int")), F.lit(0), lambda s, x: s + x)
    met = met.filter(apart <= float(_radius(math.acos(cosine), bits))).select("node", F.col("leader.node").alias("leader")).distinct()
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("unit").alias(f"u_{s}"))
    linked = stored(met.join(side("node"), "node").join(side("leader"), "leader")
                    .filter(_cosine("u_node", "u_leader") >= cosine).groupBy("node").agg(F.min("leader").alias("leader")), "leaders")
    return nodes.join(linked, "node", "left").select(*nodes.columns, F.coalesce("leader", "node").alias("cluster"))


def _balls(nodes: DataFrame, cosine: float) -> DataFrame:
    """nodes with ball: the cluster's for members within half the wanted angle of its centre, else one's own."""
    half = math.acos(cosine) / 2 - 1e-6
    sizes = nodes.groupBy("cluster").count().filter("count > 1").select("cluster")
    members = nodes.join(sizes, "cluster").select("cluster", "node", "unit")
    sums = (members.select("cluster", F.posexplode("unit").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"))
            .groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("xs")))
    centres = stored(sums.select("cluster", _unit(F.transform("xs", lambda s: s["x"])).alias("centre")).filter("centre is not null"), "centres")
    angle = F.acos(F.least(_cosine("unit", "centre"), F.lit(1.0)))
    inside = members.join(centres, "cluster").select("node", F.col("centre"), angle.alias("angle")).filter(F.col("angle") <= half)
    return (nodes.join(inside, "node", "left")
            .withColumn("ball", F.when(F.col("angle").isNotNull(), F.col("cluster") * 2 + 1).otherwise(F.col("node") * 2))
            .withColumn("centre", F.coalesce("centre", "unit")).withColumn("angle", F.coalesce("angle", F.lit(0.0))).drop("cluster"))


def _meeting(filed: DataFrame, cosine: float, bits: int) -> DataFrame:
    """a, b: balls that share a bucket and whose codes are as close as a link asks for, once each.

    ``filed``: t, key, dim, ball, code, radius. A bucket of more than ``CELL`` balls is cut into blocks,
    and every two blocks are compared in a task of their own."""
    theta = math.acos(cosine)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        cell = ("t", "key", "dim", "low", "high")
        for batch in (*batches, None):
            if batch is not None:
                fresh = pa.Table.from_batches([batch])
                kept = fresh if kept is None else pa.concat_tables([kept, fresh])
            if kept is None or not kept.num_rows:
                continue
            ids = np.stack([kept[c].to_numpy() for c in cell])
            cut = np.append(True, (ids[:, 1:] != ids[:, :-1]).any(axis=0))
            # the last cell may go on in the next batch
            done = kept.num_rows if batch is None else int(np.flatnonzero(cut)[-1])
            of = np.cumsum(cut)[:done]
            part = kept.slice(0, done).combine_chunks()
            kept = kept.slice(done)
            ball, block, radius = (part[c].to_numpy() for c in ("ball", "block", "radius"))
            two = ids[3, :done] != ids[4, :done]
            code = _matrix(part["code"].combine_chunks()).view(np.uint64) if done else np.zeros((0, 1), np.uint64)
            at, shift, left, right = np.arange(done), 0, [], []
            while True:  # every row with the one ``shift`` places on, as long as that is of its cell
                shift += 1
                at = at[at + shift < done]
                at = at[of[at] == of[at + shift]]
                if not len(at):
                    break
                for s in range(0, len(at), 1 << 16):
                    x = at[s:s + (1 << 16)]
                    y = x + shift
                    apart = np.bitwise_count(code[x] ^ code[y]).sum(axis=1)
                    good = (apart <= _radius(theta + radius[x] + radius[y], bits)) & (~two[x] | (block[x] != block[y]))
                    left.append(ball[x[good]])
                    right.append(ball[y[good]])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    at = ["t", "key", "dim"]
    sizes = filed.groupBy(*at).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    rows = (filed.join(sizes, at).withColumn("block", F.pmod(F.xxhash64("ball"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select(*at, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "ball", "code", "radius"))
    cell = [*at, "low", "high"]
    return (rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(search, "a long, b long").distinct())


def _counted(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """For balls a, b whose members have to be compared: node and how many rows it links with in the other
    ball, and a, b where there is a link. Members meet in blocks of about ``BLOCK``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"node": [], "links": [], "a": [], "b": []}
            ids = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
            for (a, b), p, q in zip(ids, batch.column("m_a"), batch.column("m_b"), strict=True):
                (n_a, w_a, x), (n_b, w_b, y) = (
                    (m.values.field("node").to_numpy(), m.values.field("weight").to_numpy(), _matrix(m.values.field("unit"))) for m in (p, q))
                if x.shape[1] != y.shape[1]:
                    continue
                hit = x @ y.T >= cosine
                for n, links in ((n_a, hit @ w_b), (n_b, hit.T @ w_a)):
                    some = links > 0
                    found["node"] += n[some].tolist()
                    found["links"] += links[some].tolist()
                found["a"] += [a] * (len(found["node"]) - len(found["a"]))
                found["b"] += [b] * (len(found["node"]) - len(found["b"]))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in found.items()})

    size = nodes.groupBy("ball").agg(F.count(F.lit(1)).alias("members"))
    asked = pairs.select(F.col("a").alias("ball")).unionByName(pairs.select(F.col("b").alias("ball"))).distinct()
    blocks = (nodes.join(asked, "ball").join(size, "ball")
              .withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)))
              .groupBy("ball", "part").agg(F.collect_list(F.struct("node", "weight", "unit")).alias("m")))
    blocks = stored(blocks, "members")
    side = lambda s: blocks.select(F.col("ball").alias(s), F.col("m").alias(f"m_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(work, "node long, links long, a long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Rows link whose cosine, in double precision, is ``cosine`` or more; n_links counts the other rows. A
    vector that is null, empty, all zeros or holds null or non-finite components links with nothing, nor
    do vectors of different length. Rows that repeat, or share a vec_id, are rows of their own. The
    component is the smallest vec_id reachable by links; a row without vec_id takes part, and a group
    without any has null. Kept is the row whose vec_id is the component's. An empty table gives an empty
    table; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    unit = _unit(F.when(usable(F.col("embedding")), F.col("embedding")))
    rows = rows.select("vec_id", unit.alias("unit"))
    rows = rows.select("vec_id", "unit", F.xxhash64("unit").alias("d1"), F.xxhash64(F.lit(1), "unit").alias("d2"),
                       F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "vectors")
    full = rows.filter("unit is not null")
    classes = full.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes = stored(classes, "classes")
    count = classes.count()
    alone = (F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not count:
        return rows.select("vec_id", *alone).withColumn("kept", F.lit(True))
    nodes = classes.join(full.select(F.col("row").alias("node"), "unit"), "node").withColumn("dim", F.size("unit"))
    nodes = stored(nodes, "nodes")
    bits, tables = plan(count, cosine)
    encode = _coder(_model(nodes, bits * tables), bits, tables)
    coded = stored(nodes.withColumn("_c", encode("unit")).select("*", "_c.code", "_c.keys").drop("_c"), "coded")
    clustered = stored(_clusters(coded, cosine, bits * tables), "clustered")
    members = stored(_balls(clustered, cosine), "balls")
    release(nodes, coded, clustered)

    balls = (members.groupBy("ball").agg(F.first("centre").alias("centre"), F.max("angle").alias("radius"), F.sum("weight").alias("rows"),
                                         F.min("least").alias("least"), F.first("dim").alias("dim")))
    balls = stored(balls.withColumn("code", encode("centre")["code"]), "centred")
    filed = members.select("ball", F.posexplode("keys").alias("t", "key")).distinct().join(balls.select("ball", "dim", "code", "radius"), "ball")
    pairs = _meeting(filed, cosine, bits * tables)
    side = lambda s: balls.select(F.col("ball").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("centre", "radius", "rows")])
    cos = F.least(_cosine("centre_a", "centre_b"), F.lit(1.0))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cos", cos)
    apart, wide, theta = F.acos(F.greatest("cos", F.lit(-1.0))), F.col("radius_a") + F.col("radius_b"), math.acos(cosine)
    # two single vectors are judged by their cosine itself
    verdict = (F.when(wide == 0, F.when(F.col("cos") >= cosine, "all").otherwise("none"))
               .when(apart - wide > theta + _EPS, "none").when(apart + wide <= theta - _EPS, "all").otherwise("open"))
    judged = stored(pairs.withColumn("verdict", verdict).filter("verdict <> 'none'").select("a", "b", "rows_a", "rows_b", "verdict"), "judged")

    whole, unsure = judged.filter("verdict = 'all'"), judged.filter("verdict = 'open'").select("a", "b")
    counted = stored(_counted(unsure, members.select("ball", "node", "weight", "unit"), cosine), "counted")
    links = whole.select("a", "b").unionByName(counted.select("a", "b").distinct())
    groups = components(links).select(F.col("node").alias("ball"), "component")
    more = (whole.select(F.col("a").alias("ball"), F.col("rows_b").alias("links"))
            .unionByName(whole.select(F.col("b").alias("ball"), F.col("rows_a").alias("links"))).groupBy("ball").agg(F.sum("links").alias("more")))
    named = stored(balls.select("ball", "rows", "least").join(groups, "ball", "left").join(more, "ball", "left")
                   .withColumn("component", F.coalesce("component", "ball")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("ball", (F.col("rows") + F.coalesce("more", F.lit(0))).alias("near"), "component_id")
    by_node = counted.groupBy("node").agg(F.sum("links").alias("others"))
    found = (members.select("node", "ball", "d1", "d2").join(named, "ball").join(by_node, "node", "left")
             .select("d1", "d2", (F.col("near") + F.coalesce("others", F.lit(0)) - 1).alias("n_links"), "component_id"))
    out = (full.select("vec_id", "d1", "d2").join(found, ["d1", "d2"]).select("vec_id", "n_links", "component_id")
           .unionByName(rows.filter("unit is null").select("vec_id", *alone)))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all ``embeddings``, whatever their labels; odd rows as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
