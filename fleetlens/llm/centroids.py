"""Exact centroid clustering in integers, with bounds loosened by the geometry of the drift.

Once in a while (``REBASE``) every vector is compared with every centroid, and
what was found is written as a base table: its cluster, how far it may be from
its own centroid (``reach``) and by how much the second nearest is farther
(``gap``).  Later rounds ask how small a gap may have vanished since.  The
members of a cluster lie in a sphere around its centroid; for every other
centroid, which moved from p to q, the plane through p, q and the sphere's
centre says how much nearer it can have come to any of them.  That is less than
its whole drift wherever the sphere lies aside of the way it went.  The base
table is ordered by (cluster, gap), so this is a range on a Parquet column: all
other vectors are not even read, the ambiguous ones are scanned exactly, and
only what they change is added to the sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fleetlens.llm.common import read, write_and_read

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 8, 10, 64, 1024
#: Rounds (from 0) whose comparisons are written as a base for those after them.
REBASE = (1, 4)
#: Sums travel as digits of this many bits, so that no sum of sums leaves a long.
LIMB = 40
#: Whole numbers below this need no more than 64 bits for the square of a distance in up to 128 components.
_SMALL = 1 << 27
_BLOCK = 4096
#: Distances are rounded outwards by this share before they bound anything.
_ROUND = 1e-12


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, as 64-bit numbers or, where they do not fit, as Python's."""
    if not values.size or np.abs(values).max() * scale < _SMALL:
        return np.floor(values * scale).astype(np.int64)
    cut = [int(x) * scale if abs(x) >= 2.0 ** 53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(cut, dtype=object).reshape(values.shape)


def squares(points: np.ndarray, centroids: Sequence[Sequence[int]]) -> np.ndarray:
    """Exact squared distance of each point to each centroid."""
    large = points.dtype == object or max((abs(x) for c in centroids for x in c), default=0) >= _SMALL
    points = points.astype(object) if large else points
    out = np.empty((len(points), len(centroids)), object if large else np.int64)
    for j, c in enumerate(centroids):
        apart = points - np.array(c, dtype=points.dtype)
        out[:, j] = (apart * apart).sum(axis=1)
    return out


def _length(square: int) -> float:
    try:
        return math.sqrt(square)
    except OverflowError:
        return math.inf


def lengths(square: np.ndarray) -> np.ndarray:
    if square.dtype != object:
        return np.sqrt(square.astype(np.float64))
    return np.array([_length(x) for x in square.tolist()], np.float64)


def loosening(centre: Sequence[int], radius: float, p: Sequence[int], q: Sequence[int]) -> float:
    """At most so much nearer than p is q to any point of the sphere.

    |x-p| - |x-q| = 2 (q-p)(x-o) / (|x-p| + |x-q|) with o the middle of p and q,
    and |x-p| + |x-q| >= 2 |x-o|.  So it is the drift times the cosine of the angle
    between the drift and x-o at most.  In the plane of p, q and the centre that
    angle is smallest on a tangent from o to the sphere.
    """
    way = [b - a for a, b in zip(p, q)]
    drift = _length(sum(x * x for x in way))
    if drift == 0.0 or not math.isfinite(drift):
        return drift
    # twice the vector from the middle to the centre, so that it stays whole
    aside = [2 * c - a - b for c, a, b in zip(centre, p, q)]
    far = _length(sum(x * x for x in aside))
    if not math.isfinite(far) or 2 * radius >= far:
        return drift
    along = sum(x * y for x, y in zip(way, aside)) / (drift * far)
    angle = math.acos(max(-1.0, min(1.0, along))) - math.asin(2 * radius / far) - 1e-7
    return drift * math.cos(min(max(angle, 0.0), math.pi / 2))


def thresholds(base: Sequence[Sequence[int]], now: Sequence[Sequence[int]], radii: Sequence[float]) -> list[float]:
    """For each cluster of the base, the largest gap that may have vanished since."""
    out = []
    for i, radius in enumerate(radii):
        own = _length(sum((a - b) ** 2 for a, b in zip(base[i], now[i])))
        others = max((loosening(base[i], radius, base[j], now[j]) for j in range(len(base)) if j != i), default=0.0)
        out.append((own + others) * (1 + 1e-9) + 1e-9 * (radius + 1))
    return out


def _points(batch: pa.RecordBatch, size: int, scale: int) -> np.ndarray:
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return whole(flat.reshape(-1, size), scale)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            yield batch.slice(at, _BLOCK)


_SUMS = "cluster int, at int, limb int, value long"


def _limbs(sums: list[list[int]], counts: list[int]) -> pa.RecordBatch:
    """Sums and counts (as component -1) in digits; all but the last digit are below 2 ** LIMB."""
    rows: list[tuple[int, int, int, int]] = []
    for cluster, (parts, n) in enumerate(zip(sums, counts)):
        for at, value in [(-1, n), *enumerate(parts)]:
            limb = 0
            while value:
                last = -(1 << LIMB) <= value < 1 << LIMB
                rows.append((cluster, at, limb, value if last else value & ((1 << LIMB) - 1)))
                value, limb = (0, limb) if last else (value >> LIMB, limb + 1)
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cluster", "at", "limb", "value"])


def summed(rows: DataFrame, changes: Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray, int]]],
           k: int, size: int) -> tuple[list[list[int]], list[int]]:
    """Sums and counts a cluster over all rows.

    ``changes`` gives for a block of rows (points, cluster of each, 1 to add or -1 to take away).
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * size for _ in range(k)], [0] * k
        for batch in _blocks(batches):
            for points, cluster, sign in changes(batch):
                for c in np.unique(cluster).tolist():
                    mine = points[cluster == c]
                    counts[c] += sign * len(mine)
                    sums[c] = [a + sign * int(b) for a, b in zip(sums[c], mine.sum(axis=0).tolist())]
        yield _limbs(sums, counts)

    sums, counts = [[0] * size for _ in range(k)], [0] * k
    found = rows.mapInArrow(add, _SUMS).groupBy("cluster", "at", "limb").agg(F.sum("value").alias("value"))
    for r in found.collect():  # a row for each cluster, component and digit
        value = r["value"] << (LIMB * r["limb"])
        if r["at"] < 0:
            counts[r["cluster"]] += value
        else:
            sums[r["cluster"]][r["at"]] += value
    return sums, counts


def kept(column: str, size: int) -> Column:
    """Whether a vector has ``size`` components, none missing, none infinite or not a number."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce((F.size(column) == size) & good, F.lit(False))


def starts(source: DataFrame, k: int, seed: str, size: int, scale: int) -> list[list[int]]:
    """The k vectors of smallest hash; rows of one id follow their components, those without an id come last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first: list[Row] = source.orderBy(mark.asc_nulls_last(), "vec").select("vec").limit(k).collect()
    return [whole(np.array(r["vec"], np.float64), scale).tolist() for r in first]


def _base(source: DataFrame, centroids: list[list[int]], size: int, scale: int) -> DataFrame:
    """Every vector with its cluster, reach and gap, ordered by (cluster, gap)."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            apart = squares(_points(batch, size, scale), centroids)
            cluster = apart.argmin(axis=1)
            rows = np.arange(len(cluster))
            reach = lengths(apart[rows, cluster]) * (1 + _ROUND)
            gap = np.full(len(cluster), np.inf)
            for j in range(len(centroids)):
                other = np.where(cluster == j, np.inf, lengths(apart[:, j]) * (1 - _ROUND))
                gap = np.minimum(gap, other)
            with np.errstate(invalid="ignore"):
                gap = np.where(np.isfinite(reach), gap - reach, -np.inf)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "tie", "vec")], pa.array(cluster.astype(np.int32)), pa.array(reach), pa.array(gap)],
                ["id", "tie", "vec", "cluster", "reach", "gap"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"id {kinds['id']}, tie long, vec {kinds['vec']}, cluster int, reach double, gap double"
    compared = source.mapInArrow(compare, schema)
    # equal vectors have equal gaps; the row number keeps a crowd of them apart
    return write_and_read(compared.repartitionByRange("cluster", "gap", "tie").sortWithinPartitions("cluster", "gap"))


def centroid_clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3", key: str = "vec_id",
                      column: str = "embedding", size: int = COMPONENTS, scale: int = SCALE,
                      rebase: Sequence[int] = REBASE) -> tuple[DataFrame, list[list[int]]]:
    """One row (key, cluster, distance) for each kept vector, and the final centroids in whole numbers.

    Vectors of another size, missing ones and those holding a missing or
    non-finite component take no part.  Components count as floor(scale * x).
    Repeated rows and rows that share an id or have none each count as a vector.
    With fewer kept vectors than ``k`` each of them starts a cluster; an empty
    table gives no rows and no centroids.  Equal distances go to the smaller
    number, clusters without vectors keep their centroid.  A squared distance
    beyond a long is given as null.  Other columns are not read.
    """
    source = vectors.filter(kept(column, size)).select(
        F.col(key).alias("id"), F.col(column).alias("vec"), F.monotonically_increasing_id().alias("tie"))
    centroids = starts(source, k, seed, size, scale)
    k = len(centroids)
    if not k:
        return source.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    base = at_base = sums = counts = radii = None

    def ambiguous(now: list[list[int]]) -> Column:
        limits = thresholds(at_base, now, radii)
        hit = F.lit(False)
        for i, limit in enumerate(limits):
            hit = hit | ((F.col("cluster") == i) & (F.col("gap") <= F.lit(limit)))
        return hit

    for turn in range(rounds):
        now = [list(c) for c in centroids]
        if turn in rebase:
            base, at_base = _base(source, now, size, scale), now
            found = {r["cluster"]: r["r"] for r in base.groupBy("cluster").agg(F.max("reach").alias("r")).collect()}
            radii = [found.get(i, 0.0) for i in range(k)]
            total, n = summed(base.select("vec", "cluster"), lambda b: [
                (_points(b, size, scale), b.column("cluster").to_numpy(zero_copy_only=False), 1)], k, size)
            sums, counts = total, n
        elif base is None:
            total, n = summed(source.select("vec"), lambda b, now=now: [
                (p := _points(b, size, scale), squares(p, now).argmin(axis=1), 1)], k, size)
        else:
            def moves(batch: pa.RecordBatch, now=now) -> list[tuple[np.ndarray, np.ndarray, int]]:
                points, was = _points(batch, size, scale), batch.column("cluster").to_numpy(zero_copy_only=False)
                to = squares(points, now).argmin(axis=1)
                moved = to != was
                return [(points[moved], was[moved], -1), (points[moved], to[moved], 1)]

            gone, change = summed(base.filter(ambiguous(now)).select("vec", "cluster"), moves, k, size)
            total = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, gone)]
            n = [a + b for a, b in zip(counts, change)]
        centroids = [[x // n[i] for x in total[i]] if n[i] else centroids[i] for i in range(k)]

    final = [list(c) for c in centroids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            points = _points(batch, size, scale)
            was = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            open_ = batch.column("open").to_numpy(zero_copy_only=False).astype(bool)
            cluster, distance = was.copy(), np.zeros(len(was), object)
            for c in np.unique(was[~open_]).tolist():
                mine = ~open_ & (was == c)
                distance[mine] = squares(points[mine], [final[c]])[:, 0]
            if open_.any():
                apart = squares(points[open_], final)
                cluster[open_] = apart.argmin(axis=1)
                distance[open_] = apart.min(axis=1)
            fits = [int(d) if d < 1 << 63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(fits, pa.int64())],
                                             [key, "cluster", "distance"])

    rows = source.select("id", "vec", F.lit(0).alias("cluster"), F.lit(True).alias("open")) if base is None else \
        base.select("id", "vec", "cluster", ambiguous(final).alias("open"))
    kind = source.schema["id"].dataType.simpleString()
    return rows.mapInArrow(place, f"`{key}` {kind}, cluster int, distance long"), final


def op11_geometric_drift(spark, sf: str) -> DataFrame:
    placed, centroids = centroid_clusters(read(spark, sf, "embeddings"))
    placed = write_and_read(placed)
    per = {r["cluster"]: (int(r["s"]) if r["s"] is not None and r["n"] == r["d"] else None) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"),
        F.count("distance").alias("d")).collect()}  # a row a cluster
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    whole_sum = None if None in per.values() else fits(sum(per.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def look(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>"), F.col("cluster"))

    return placed.select(
        "vec_id", "cluster", "distance", look([fits(per.get(i)) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(whole_sum).cast("bigint").alias("inertia"), look(digests, "string").alias("centroid_sha256"))
