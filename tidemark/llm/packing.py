"""Best-fit packing of documents into sequences by linear grouping.

The lengths of all pieces are counted (at most ``capacity`` counts, whatever the corpus). Large
lengths are cut, from the longest down, into groups of equal cardinality and rounded up to the
longest of their group; for these few sizes the fractional configuration problem is solved by
column generation, and its configurations are used as often as the whole part says. Actual pieces
then take the slots, which leaves more room than the rounded sizes did, so the last slot takes the
longest piece that fits. What remains, large leftovers and all small pieces, goes best-fit into the
least room that holds it; last, the emptiest sequences are dissolved and their pieces fitted again
where that saves sequences.

The plan speaks of runs: the pieces of one length with ranks r .. r + n go to the sequences b .. b +
n, all at one offset. The number of runs depends on the capacity, not on the corpus. Spark ranks the
pieces of a length in range partitions and looks their places up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.mixing import numbered
from tidemark.llm.tokens import batches_of, default_path, encoder

CAPACITY = 2048
END = 0  # closes every document
GROUPS = 48  # rounded sizes
LARGE = 3  # lengths above capacity / LARGE are large; more of them in configurations left more room (measured)
DISSOLVED = (64, 16, 4)  # shares of the sequences, the emptiest, that are dissolved and filled again


@dataclass
class Run:
    """Pieces of ``length`` with ranks first .. first + n go to sequences at .. at + n."""

    length: int
    first: int
    n: int
    at: int
    offset: int


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the sizes with whole numbers of uses, from the fractional optimum.

    Revised simplex over K rows; a knapsack by dynamic programming over the capacity finds the next
    configuration. Sizes are all above 0 and fit the capacity.
    """
    s, d = np.array(sizes), np.array(demand, float)
    k = len(s)
    basis = np.diag(capacity // s).astype(float)
    use = d / np.diag(basis)
    for _ in range(40 * k):
        worth = np.linalg.solve(basis.T, np.ones(k))
        best, taken = np.zeros(capacity + 1), []
        for j in np.flatnonzero(worth > 1e-12):
            for _ in range(capacity // s[j]):
                with_it = best[:-s[j]] + worth[j]
                better = with_it > best[s[j]:] + 1e-12
                if not better.any():
                    break
                best[s[j]:] = np.where(better, with_it, best[s[j]:])
                taken.append((j, better))
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        for j, better in reversed(taken):
            if room >= s[j] and better[room - s[j]]:
                column[j] += 1
                room -= s[j]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        use = use - ratio[out] * step
        use[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, p].astype(int), int(use[p] + 1e-6)) for p in range(k) if use[p] >= 1 - 1e-6]


class Sequences:
    """Sequences by what they hold and the room they have left, as ranges of sequences that are alike."""

    def __init__(self, capacity: int):
        self.capacity, self.opened, self.gone = capacity, 0, 0
        self.held: list[tuple[int, int, int, int]] = []  # length, n, at, offset
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first, n)
        self.sizes: list[int] = []  # rooms above 0, ascending

    def count(self) -> int:
        return self.opened - self.gone

    def put(self, length: int, n: int, at: int, offset: int) -> None:
        self.held.append((length, n, at, offset))

    def leave(self, room: int, at: int, n: int) -> None:
        if room:
            if room not in self.rooms:
                bisect.insort(self.sizes, room)
                self.rooms[room] = []
            self.rooms[room].append((at, n))

    def take(self, room: int) -> tuple[int, int]:
        out = self.rooms[room].pop()
        if not self.rooms[room]:
            del self.rooms[room]
            self.sizes.remove(room)
        return out

    def best_fit(self, todo: dict[int, int]) -> None:
        """Every piece, longest first, goes to the least room that holds it."""
        for length in sorted(todo, reverse=True):
            left = todo[length]
            while left:
                i = bisect.bisect_left(self.sizes, length)
                if i == len(self.sizes):
                    n = -(-left // (self.capacity // length))
                    self.leave(self.capacity, self.opened, n)
                    self.opened += n
                    continue
                room = self.sizes[i]
                at, n = self.take(room)
                some = min(n, left)
                self.put(length, some, at, self.capacity - room)
                if n > some:
                    self.leave(room, at + some, n - some)
                self.leave(room - length, at, some)
                left -= some

    def without_emptiest(self, n: int) -> Sequences:
        """The same pieces, after the ``n`` sequences with most room are dissolved and best-fit again."""
        out = Sequences(self.capacity)
        out.opened, out.gone = self.opened, self.gone
        dropped: list[tuple[int, int]] = []
        for room in reversed(self.sizes):
            for at, size in self.rooms[room]:
                some = min(size, n)
                n -= some
                if some:
                    dropped.append((at, at + some))
                if size > some:
                    out.leave(room, at + some, size - some)
        out.gone += sum(stop - at for at, stop in dropped)
        dropped.sort()
        starts, todo = [at for at, _ in dropped], {}
        for length, size, at, offset in self.held:
            place, end = at, at + size
            i = max(bisect.bisect_right(starts, at) - 1, 0)
            while place < end:
                while i < len(dropped) and dropped[i][1] <= place:
                    i += 1
                low, high = dropped[i] if i < len(dropped) else (end, end)
                if low > place:
                    stop = min(low, end)
                    out.put(length, stop - place, place, offset)
                else:
                    stop = min(high, end)
                    todo[length] = todo.get(length, 0) + stop - place
                place = stop
        out.best_fit(todo)
        return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int = LARGE) -> list[Run]:
    """Places for ``counts[length]`` pieces of each length, as runs."""
    held = Sequences(capacity)
    for length in [x for x in counts if x == capacity and counts[x]]:
        held.put(length, counts[length], 0, 0)
        held.opened = counts[length]

    # linear grouping of the large lengths, longest first
    big = [(x, counts[x]) for x in sorted(counts, reverse=True) if capacity // large < x < capacity and counts[x]]
    per_group = -(-sum(n for _, n in big) // groups) if big else 1
    grouped: list[list[list[int]]] = []
    room = 0
    for length, n in big:
        while n:
            if not room:
                grouped.append([])
                room = per_group
            take = min(n, room)
            grouped[-1].append([length, take])
            n, room = n - take, room - take
    if grouped:
        rounded = [g[0][0] for g in grouped]
        merged = sorted(set(rounded), reverse=True)  # groups that round to one size are one size
        of = [merged.index(r) for r in rounded]
        demand = [sum(n for g, at in zip(grouped, of, strict=True) if at == j for _, n in g) for j in range(len(merged))]
        stock = [[part for g, at in zip(grouped, of, strict=True) if at == j for part in g] for j in range(len(merged))]
        group_of = {}  # of a length: its groups with pieces left, the longest first
        for j, parts in enumerate(stock):
            for length, _ in parts:
                group_of.setdefault(length, []).append(j)
        lengths = sorted(group_of)

        def use(length: int, n: int, j: int) -> int:
            """Takes up to ``n`` pieces of ``length`` out of group ``j``."""
            part = next(p for p in stock[j] if p[0] == length)
            n = min(n, part[1])
            part[1] -= n
            if not part[1]:
                stock[j].remove(part)
                group_of[length].remove(j)
                if not group_of[length]:
                    lengths.remove(length)
            return n

        for shape, times in configurations(merged, demand, capacity):
            segments = [(held.opened, times, 0)]  # sequences of the configuration by what they hold
            slots = [j for j in np.flatnonzero(shape).tolist() for _ in range(shape[j])]
            for place, j in enumerate(slots):
                filled: list[tuple[int, int, int]] = []
                for at, n, used in segments:
                    while n:
                        if place + 1 < len(slots):
                            length, group = (stock[j][0][0], j) if stock[j] else (0, j)
                        else:
                            # the last slot gets the longest piece that fits, of whatever group
                            i = bisect.bisect_right(lengths, capacity - used)
                            length, group = (lengths[i - 1], group_of[lengths[i - 1]][0]) if i else (0, j)
                        if not length:
                            filled.append((at, n, used))
                            break
                        take = use(length, n, group)
                        held.put(length, take, at, used)
                        filled.append((at, take, used + length))
                        at, n = at + take, n - take
                segments = filled
            for at, n, used in segments:
                held.leave(capacity - used, at, n)
            held.opened += times

    todo = dict(counts)
    for length, n, _, _ in held.held:
        todo[length] -= n
    held.best_fit({x: n for x, n in todo.items() if n})
    for share in DISSOLVED:
        again = held.without_emptiest(max(1, held.count() // share))
        if again.count() < held.count():
            held = again

    runs, rank = [], dict.fromkeys(counts, 0)
    for length, n, at, offset in held.held:
        runs.append(Run(length, rank[length], n, at, offset))
        rank[length] += n
    return runs


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: row, doc_id, piece, start, length, ids_crc32, ids (bytes)."""
    path = path or default_path()
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
    closing = np.array([END], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for rows in batches_of(batch.column("text")):
                part = batch.slice(rows.start, rows.stop - rows.start)
                ids, bounds = encode(part.column("text"))
                of, number, start, length, crc, bodies = [], [], [], [], [], []
                for i, (a, b) in enumerate(pairwise(bounds.tolist())):
                    body = ids[a:b].tobytes() + closing
                    for p, at in enumerate(range(0, len(body), 4 * capacity)):
                        piece = body[at:at + 4 * capacity]
                        of.append(i)
                        number.append(p)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        if with_ids:
                            bodies.append(piece)
                at = pa.array(of, pa.int64())
                columns = [part.column("row").take(at), part.column("doc_id").take(at), pa.array(number, pa.int32()),
                           *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(bodies, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return (docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(work, schema + (", ids binary" if with_ids else "")))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and the ids.

    ``docs`` needs doc_id and text. A null or empty text is the closing id alone. Rows that repeat
    are packed each; rows without doc_id too. An empty table gives an empty table.
    """
    cut = stored(pieces(docs, capacity, path, with_ids), "pieces")
    narrow = cut.drop("ids")
    counts = {r[0]: r[1] for r in narrow.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = sorted(plan(counts, capacity), key=lambda r: (r.length, r.first))
    keys = np.array([(r.length << 48) + r.first for r in runs], np.int64)
    at, offset, first = (np.array([getattr(r, f) for r in runs], np.int64) for f in ("at", "offset", "first"))
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy() - 1
            run = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) + rank, "right") - 1
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(at[run] + rank - first[run]), pa.array(offset[run])],
                names=[*names, "sequence_id", "offset"])

    order = [F.col(c) for c in ("length", "doc_id", "row", "piece")]
    placed = numbered(narrow, ["length"], order, "rank").mapInArrow(place, schema)
    if with_ids:
        placed = placed.join(cut.select("row", "piece", "ids"), ["row", "piece"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                         *(["ids"] if with_ids else []))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
