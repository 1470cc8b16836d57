"""Tables that change by appended files: a keyed log, and one snapshot per source.

Both write new Parquet folders and never touch old ones; a small manifest, one JSON file per version and
renamed into place, says which folders count. A job that dies between writing and committing leaves an
unnamed folder and nothing else, and a micro-batch that is repeated after its commit is passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.scale import first_per_key
from tidemark.session import remove_path

KEPT_VERSIONS = 2  # readers of the version before may still be at work


class Manifest:
    """The versions of a table's state, the newest one counting."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, f"{path}/_log"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(self.folder)
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _file(self, version: int):
        return self._path(f"{self.folder}/{version:012d}.json")

    def at(self, version: int) -> dict:
        stream = self._fs.open(self._file(version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """The version and its state; 0 and an empty state before the first commit."""
        versions = self.versions()
        return (versions[-1], self.at(versions[-1])) if versions else (0, {})

    def commit(self, version: int, state: dict) -> None:
        """Makes ``state`` the version after ``version``; fails if another writer was faster."""
        target, draft = self._file(version + 1), self._path(f"{self.folder}/{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version + 1} of {self.folder} was committed by another writer")
        for old in self.versions()[:-KEPT_VERSIONS]:
            self._fs.delete(self._file(old), False)

    def sweep(self, path: str) -> None:
        """Deletes the folders of the table that no kept version names: replaced ones, and what a dead job
        left. Only its one writer may call it."""
        named = {part["folder"] for v in self.versions() for part in self.at(v).get("parts", [])}
        for entry in self._fs.listStatus(self._path(path)):
            name = entry.getPath().getName()
            if not name.startswith("_") and name not in named:
                self._fs.delete(entry.getPath(), True)


class _Table:
    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema, self.manifest = spark, path, schema, Manifest(spark, path)

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _folder(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def _commit(self, version: int, state: dict, parts: list[dict], writer: str, batch: int | None) -> None:
        done = dict(state.get("done", {}))
        if batch is not None:
            done[writer] = batch
        self.manifest.commit(version, {"parts": parts, "done": done})

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], self.schema)


def _passed(state: dict, writer: str, batch: int | None) -> bool:
    return batch is not None and batch <= state.get("done", {}).get(writer, -1)


class KeyedTable(_Table):
    """One row per key, the newest, from appended batches.

    ``newest`` orders the rows of a key over all batches, first wins and a later batch wins a tie; ``ties``
    goes on inside a batch. ``schema`` has the column bucket, which follows from the key. A batch is one
    folder of delta files; reading merges the folders that hold rows of a bucket. Buckets whose deltas
    hold more than ``share`` of their largest folder's rows, or lie in more than ``most`` folders, are
    rewritten into one folder, all others stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], newest: Sequence[Column],
                 ties: Sequence[Column] = (), share: float = 0.5, most: int = 8) -> None:
        super().__init__(spark, path, schema)
        self.keys, self.newest, self.ties, self.share, self.most = list(keys), list(newest), list(ties), share, most

    def _add(self, rows: DataFrame, sequence: int) -> dict | None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        folder = self._write(rows.select(*columns).hint("rebalance").sortWithinPartitions("bucket"))
        # one row per bucket
        counts = {str(r[0]): r[1] for r in self._folder(folder).groupBy("bucket").count().collect()}
        if not counts:
            remove_path(self.spark, f"{self.path}/{folder}")
        return {"folder": folder, "seq": sequence, "rows": counts} if counts else None

    def write(self, batch: DataFrame, writer: str = "", number: int | None = None) -> None:
        """Adds a batch. With ``number``, which grows with the batches of a ``writer``, a repeated one is
        passed over."""
        version, state = self.manifest.newest()
        if _passed(state, writer, number):
            return
        part = self._add(first_per_key(batch, self.keys, [*self.newest, *self.ties]), version + 1)
        if part or number is not None:
            self._commit(version, state, [*state.get("parts", []), *([part] if part else [])], writer, number)
        self.compact()

    def _merged(self, parts: list[dict], only: set[str] | None = None) -> DataFrame:
        """Rows of the buckets, all or ``only`` some; buckets that lie in one folder need no merging."""
        holders: dict[str, int] = {}
        for part in parts:
            for b in part["rows"]:
                holders[b] = holders.get(b, 0) + 1
        alone, several = [], []
        for part in parts:
            rows = self._folder(part["folder"])
            for many, out in ((False, alone), (True, several)):
                buckets = [int(b) for b in part["rows"] if (holders[b] > 1) == many and (only is None or b in only)]
                if buckets:
                    out.append(rows.filter(F.col("bucket").isin(buckets)).withColumn("_seq", F.lit(part["seq"])))
        if several:
            alone.append(first_per_key(self._union(several), self.keys, [*self.newest, F.desc("_seq")]))
        return self._union([rows.drop("_seq") for rows in alone])

    def read(self) -> DataFrame:
        return self._merged(self.manifest.newest()[1].get("parts", []))

    def compact(self) -> None:
        """Rewrites the buckets that have come to hold too much in deltas."""
        version, state = self.manifest.newest()
        parts, of = state.get("parts", []), {}
        for part in parts:
            for b, n in part["rows"].items():
                of.setdefault(b, []).append(n)
        due = {b for b, rows in of.items() if len(rows) > self.most or sum(rows) - max(rows) > self.share * max(rows)}
        if not due:
            return
        whole = self._add(self._merged(parts, due), version + 1)
        left = [{**p, "rows": {b: n for b, n in p["rows"].items() if b not in due}} for p in parts]
        self._commit(version, state, [*(p for p in left if p["rows"]), *([whole] if whole else [])], "", None)
        self.manifest.sweep(self.path)


class SnapshotTable(_Table):
    """The rows of every source's newest cycle.

    A cycle with rows replaces the source's rows as a whole, so what it no longer lists is gone; a cycle
    without rows never reaches the table, and the last good one stays. Rows of the same cycle may come in
    several batches; an older cycle that comes late is passed over. The manifest points from a source to
    its cycle and folders.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, source: str = "source", cycle: str = "cycle") -> None:
        super().__init__(spark, path, schema)
        self.source, self.cycle = source, cycle

    def write(self, batch: DataFrame, writer: str = "", number: int | None = None) -> None:
        version, state = self.manifest.newest()
        if _passed(state, writer, number):
            return
        # one row per source
        newest = {r[0]: r[1] for r in batch.groupBy(self.source).agg(F.max(self.cycle)).collect() if r[0] is not None and r[1] is not None}
        parts = state.get("parts", [])
        known = {s: p["cycle"] for p in parts for s in p["sources"]}
        taken = {s: c for s, c in newest.items() if c >= known.get(s, c)}
        if taken:
            wanted = reduce(Column.__or__, ((F.col(self.source) == s) & (F.col(self.cycle) == c) for s, c in taken.items()))
            folder = self._write(batch.filter(wanted).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]))
            replaced = {s for s, c in taken.items() if c > known.get(s, c)}
            parts = [{**p, "sources": [s for s in p["sources"] if s not in replaced]} for p in parts]
            # sources of one batch may stand at different cycles
            by_cycle: dict[int, list[str]] = {}
            for s, c in sorted(taken.items()):
                by_cycle.setdefault(c, []).append(s)
            parts = [p for p in parts if p["sources"]] + [{"folder": folder, "cycle": c, "sources": s} for c, s in by_cycle.items()]
        if taken or number is not None:
            self._commit(version, state, parts, writer, number)
            self.manifest.sweep(self.path)

    def read(self) -> DataFrame:
        parts = self.manifest.newest()[1].get("parts", [])
        return self._union([self._folder(p["folder"]).filter(F.col(self.source).isin(p["sources"]) & (F.col(self.cycle) == p["cycle"])) for p in parts])


