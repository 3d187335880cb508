"""Items of varying length put into containers of one capacity with little room left.

All planning is done on counts by length, of which there are no more than the capacity: from the longest
length down, single, pair and triple sums of lengths that exactly fill what is left are looked up and used as often
as their counts allow; what finds no exact complement goes best-fit. Items then take the places of their
length by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import prefix_sum


class _Sums:
    """Which lengths, and sums of two of them, are there; kept as the counts run out."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts
        self.there = counts > 0
        self._pairs()

    def _pairs(self) -> None:
        x = self.there.astype(np.float32)
        n = len(x)
        size = 1 << (2 * n - 1).bit_length()
        f = np.fft.rfft(x, size)
        self.pair = np.fft.irfft(f * f, size)[:n] > 0.5

    def take(self, lengths: tuple[int, ...]) -> int:
        """Uses the combination as often as it goes."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(self.left[x]) // m for x, m in need.items())
        gone = False
        for x, m in need.items():
            self.left[x] -= m * times
            if times and self.left[x] == 0:
                self.there[x] = False
                gone = True
        if gone:
            self._pairs()
        return times

    def two(self, total: int) -> tuple[int, int] | None:
        """The pair with that sum that can be used most often."""
        if total < 2 or not self.pair[total]:
            return None
        a = np.arange(1, total // 2 + 1)
        ways = np.minimum(self.left[a], self.left[total - a])
        if total % 2 == 0:
            ways[-1] = self.left[total // 2] // 2
        best = int(np.argmax(ways))
        return (int(total - a[best]), int(a[best])) if ways[best] > 0 else None

    def filling(self, length: int, gap: int) -> Iterator[tuple[int, ...]]:
        """Combinations of one, two or three lengths that fill the gap beside the length."""
        if gap and self.there[gap]:
            yield (gap,)
        if (p := self.two(gap)) is not None:
            yield p
        if gap >= 3:
            a = np.arange(1, gap - 1)
            for x in a[self.there[a] & self.pair[gap - a]][::-1]:
                if (p := self.two(gap - int(x))) is not None:
                    yield (int(x), *p)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many containers follow each. Lengths are from 1 to the capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    sums = _Sums(left)
    out: list[tuple[tuple[int, ...], int]] = []
    residual: dict[int, int] = {}
    for length in range(capacity, 0, -1):
        while left[length]:
            if length == capacity:
                out.append(((length,), sums.take((length,))))
                continue
            for fill in sums.filling(length, capacity - length):
                times = sums.take((length, *fill))
                if times:
                    out.append(((length, *fill), times))
                    break
            else:
                residual[length] = int(left[length])
                sums.take((length,))
    return out + _best_fit(residual, capacity)


def _best_fit(residual: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Decreasing best fit, whole groups of equal containers at a time."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(residual, reverse=True):
        n = residual[length]
        while n:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(n, each)
                for k, times in ((each, full), (rest, 1)):
                    if k and times:
                        by_room.setdefault(capacity - k * length, []).append(((length,) * k, times))
                break
            pattern, times = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            each = min(room // length, n)
            use = min(times, n // each)
            by_room.setdefault(room - each * length, []).append((pattern + (length,) * each, use))
            if times > use:
                by_room.setdefault(room, []).append((pattern, times - use))
            n -= each * use
    return [x for group in by_room.values() for x in group]


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, start_at, piece_size, container_id): every item in a container.

    An item within the capacity is one piece. A larger one is cut into pieces of full capacity, each a container
    of its own, and a last piece that is packed like an item. Items of size 0 or null take no room and
    are all in container 0. Repeated keys and sizes are so many items; an empty table needs no container. `key` must
    not be null.

    Comes to the driver: the count of each length, `capacity` rows at most.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = items.select(F.col(key).alias("key"), n.alias("n"))
    last = F.col("n") - F.floor((F.col("n") - 1) / capacity) * capacity
    pieces = rows.select("key", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("int"))).alias("piece_no"), "n")
    pieces = pieces.withColumn("piece_size", F.when(F.col("n") == 0, 0).when((F.col("piece_no") + 1) * capacity < F.col("n"), capacity).otherwise(last).cast("int")).drop("n")
    counts = {r["piece_size"]: r["count"] for r in pieces.groupBy("piece_size").count().collect()}
    counts.pop(0, None)
    starts, per, base, firsts = _places(plan(counts, capacity), capacity)
    ranked = prefix_sum(pieces, ["piece_size"], ["key", "piece_no"], F.lit(1), "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("piece_size").to_numpy().astype(np.int64)
            rank = b.column("rank").to_numpy()
            at = np.zeros(len(length), np.int64)
            if len(starts):
                k = np.maximum(np.searchsorted(starts, firsts[length] + rank, side="right") - 1, 0)
                at = np.where(length > 0, base[k] + (firsts[length] + rank - starts[k]) // per[k], 0)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("piece_no"), pa.array(b.column("piece_no").to_numpy().astype(np.int64) * capacity), b.column("piece_size"), pa.array(at)], names=[key, "piece_no", "start_at", "piece_size", "container_id"])

    kind = items.schema[key].dataType.simpleString()
    return ranked.select("key", "piece_no", "piece_size", "rank").mapInArrow(place, f"`{key}` {kind}, piece_no int, start_at long, piece_size int, container_id long")


def _places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Runs of places: all places of the shortest length in order, then the next length's. For each run its first place,
    how many items a container takes there, and its first container; for each length its first place."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    container = 0
    for pattern, times in patterns:
        for length in set(pattern):
            runs.setdefault(length, []).append((pattern.count(length), times, container))
        container += times
    starts, per, base, firsts, at = [], [], [], np.zeros(capacity + 1, np.int64), 0
    for length in range(1, capacity + 1):
        firsts[length] = at
        for m, times, c in runs.get(length, ()):
            starts.append(at)
            per.append(m)
            base.append(c)
            at += m * times
    return np.array(starts, np.int64), np.array(per, np.int64), np.array(base, np.int64), firsts
