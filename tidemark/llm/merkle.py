"""Merkle manifest of a dataset: a digest per row, per group and for the whole, with proofs.

Rows are leaves. Inside a group (a language) they stand in order, and every ``ARITY`` consecutive
nodes become their parent, the digest of the children's digests, until one node is left, the group's
subroot; the subroots in order of their groups form the upper tree in the same way.

On each level fixed-offset lag and lead columns are masked by a node's slot in its run and by the run's
length: they give every node its siblings, and the first child of each run hashes the parent. The
paths are then handed down from the root, so a leaf's proof needs one join with the level above.
All of it is DataFrame functions; hashing happens next to the text, and only digests are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import numbered, release, stored, table

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value with its length in UTF-8 bytes ahead, ``-`` for null, so that no two
    different rows are written alike. Numbers are written as decimals."""
    fields = []
    for column in columns:
        value = column.cast("string")
        fields.append(F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return digest(*fields)


def _with_siblings(level: DataFrame, arity: int) -> DataFrame:
    """Adds run, slot, before and after: the digests of the run's other nodes, left and right of a node."""
    run, slot = F.floor(F.col("idx") / arity), F.pmod(F.col("idx"), F.lit(arity))
    length = F.least(F.lit(arity), F.col("n") - F.col("run") * arity)
    level = level.withColumn("run", run.cast("long")).withColumn("slot", slot)
    at = Window.partitionBy("grp", "run").orderBy("idx")
    none = F.lit("")
    before = [F.when(F.col("slot") >= k, F.lag("h", k).over(at)).otherwise(none) for k in range(arity - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < length, F.lead("h", k).over(at)).otherwise(none) for k in range(1, arity)]
    return level.withColumn("before", F.concat(*before)).withColumn("after", F.concat(*after))


def _levels(nodes: DataFrame, arity: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels (grp, idx, n, h) from ``nodes`` up, the last holding single nodes only, and one row
    (grp, h) per group with the node that remains. ``most`` is the size of the largest group."""
    levels = [nodes.select("grp", "idx", "n", "h")]
    while most > 1:
        parents = (_with_siblings(levels[-1].filter("n > 1"), arity).filter("slot = 0")
                   .select("grp", F.col("run").alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
                           digest(F.col("h"), F.col("after")).alias("h")))
        levels.append(stored(parents, "level"))
        most = -(-most // arity)
    tops = levels[0].filter("n = 1").select("grp", "h")
    for level in levels[1:]:
        tops = tops.unionByName(level.filter("n = 1").select("grp", "h"))
    return levels, stored(tops, "tops")


def _paths(levels: list[DataFrame], nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (the lowest level, with more columns if need be) and ``path``: the siblings left and
    right of the node on each level up to the top of its group."""
    above = None
    for level in [*levels[:0:-1], nodes]:
        rows = _with_siblings(level, arity)
        own = F.when(F.col("n") > 1, F.array(F.struct("before", "after"))).otherwise(F.array().cast(_PATH))
        if above is None:
            rows = rows.withColumn("path", own)
        else:
            rows = (rows.join(above, ["grp", "run"], "left")
                    .withColumn("path", F.concat(own, F.coalesce("upper", F.array().cast(_PATH)))))
        if level is nodes:
            return rows.drop("run", "slot", "before", "after", "upper")
        last, above = above, stored(rows.select("grp", F.col("idx").alias("run"), F.col("path").alias("upper")), "paths")
        release(last)
    raise AssertionError


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def manifest(rows: DataFrame, group: str, order: Sequence[str], arity: int = ARITY) -> DataFrame:
    """``rows`` with subroot, root and path: what proves a row's place in the dataset.

    ``rows`` holds ``leaf`` (its digest), ``group`` (string, null is the first group) and the columns of
    ``order``, all of them stored; other columns are carried, but for the names grp, idx, n and h, which
    are used inside. Inside a group, leaves ascend by ``order`` (nulls last), then by leaf, so rows that
    repeat are leaves of their own and rows that share an id keep one order. The groups ascend by the
    bytes of their names. A group of one leaf has that leaf as its subroot, a single group's subroot is
    the root. An empty table gives an empty table.
    """
    ranks = []
    for name in order:
        ranks += [(f"_null_{name}", F.col(name).isNull()), (f"_by_{name}", F.col(name))]
    keyed = (rows.withColumns({"grp": F.coalesce(F.concat(F.lit("."), F.col(group)), F.lit("")), "h": F.col("leaf")})
             .withColumns(dict(ranks)))
    leaves = numbered(keyed, "grp", [*(name for name, _ in ranks), "h"])
    levels, tops = _levels(leaves, arity, _most(leaves))

    # the upper tree: one group, its nodes are the subroots in order of their groups
    subroots = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h"), "grp", ["of"])
    uppers, root = _levels(subroots, arity, _most(subroots))
    upper = _paths(uppers, subroots, arity)
    top = root.first()  # one digest
    upper = stored(upper.select(F.col("of").alias("grp"), F.col("h").alias("subroot"), F.col("path").alias("_upper"),
                                F.lit(top["h"] if top else None).cast("string").alias("root")), "subroots")
    release(tops, *uppers[1:], root, subroots)
    return (_paths(levels, leaves, arity).join(upper, "grp")
            .withColumn("path", F.concat("path", "_upper"))
            .select(*rows.columns, "subroot", "root", "path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def tampered(text: Column, doc_id: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the crc32 of the decimal id; a row without id and a
    null text stay."""
    hit = F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by language, with a proof of every row and its check after tampering.

    Null values are hashed as ``-``, a null language is the first group, rows without doc_id come last in
    theirs, and rows that repeat are leaves of their own. An empty table gives an empty table; columns
    beyond the five hashed ones are not read. Texts are hashed whole.
    """
    docs = table(spark, sf_dir, "documents")
    changed = {"text": tampered(F.col("text"), F.col("doc_id"))}
    leaves = docs.select("doc_id", "lang", leaf_hash([F.col(c) for c in FIELDS]).alias("leaf"),
                         leaf_hash([changed.get(c, F.col(c)) for c in FIELDS]).alias("seen"))
    leaves = stored(leaves, "leaves")
    folded = fold(F.col("seen"), F.col("path"))
    return (manifest(leaves, "lang", ["doc_id"])
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                    folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
