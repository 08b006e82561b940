"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors go through three rounds of random signs and a fast Hadamard
transform; the largest coordinate and its sign name the bucket.  A table is one
such rotation.  Queries probe the buckets of their largest coordinates in every
table.  Buckets and the queries that probe them meet as packed tiles, where
cosines are worked out exactly in double precision on the original vectors, which travel
in their own component type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from fleetlens.llm.common import read, small_batches, write_and_read

#: Few tables with many probes: each table sends every vector once, a probe only the queries.
TABLES = 4
PROBES = 24
NEAREST = 5
EVERY = 50
#: Vectors of one tile of a bucket, and queries of one tile of probes.
TILE_ROWS, QUERY_ROWS = 2_048, 512
SEED = 20_240


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(unit: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of unit vectors, padded to a power of two."""
    dim = unit.shape[1]
    size = 1 << max(0, dim - 1).bit_length()
    x = np.zeros((len(unit), size))
    x[:, :dim] = unit
    rng = np.random.default_rng([SEED, table, size])
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], size))
    return x


def buckets(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Per vector the buckets of its largest coordinates, best first: 2 * axis, plus 1 if negative."""
    x = rotate(unit, table)
    probes = min(probes, x.shape[1])
    axis = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :probes]
    return 2 * axis + (np.take_along_axis(x, axis, axis=1) < 0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(column: str) -> Column:
    """Vectors with components that are all finite numbers and not all zero."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return F.col(column).isNotNull() & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0)


def _best(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and exact cosines of all pairs that may be among the k best of a query."""
    near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    if near.shape[1] > k:
        edge = -np.partition(-near, k - 1, axis=1)[:, k - 1:k]
        qs, vs = np.nonzero(near >= edge - 1e-9)
    else:
        qs, vs = np.nonzero(np.ones_like(near, bool))
    return qs, vs, cosines(q[qs], v[vs])


def _kind(rows: DataFrame) -> str:
    """Component type of packed vectors: floats stay floats, which doubles hold exactly."""
    return "<f4" if isinstance(rows.schema["v"].dataType.elementType, FloatType) else "<f8"


def _pack(rows: DataFrame, name: str) -> DataFrame:
    """(id, dim, bytes of the components) of rows (id, v)."""
    kind = _kind(rows)
    small_batches(rows.sparkSession, 1024)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({name: b[name], "dim": b["v"].map(len), "v": [np.asarray(x, kind).tobytes() for x in b["v"]]})

    return rows.select(name, "v").mapInPandas(run, f"{name} long, dim int, v binary")


def _probe(rows: DataFrame, name: str, kind: str, tables: int, probes: int) -> DataFrame:
    """Packed rows once for each bucket they belong to or probe."""
    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the tiles of the same job ask for batches of a few rows
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 1024:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in gathered(batches):
            for dim in sorted(set(b["dim"])):
                part = b[b["dim"] == dim]
                unit = np.frombuffer(b"".join(part["v"]), kind).astype(float).reshape(len(part), dim)
                unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for t in range(tables):
                    for at in buckets(unit, t, probes).T:
                        yield part.assign(bucket=at * tables + t)

    return rows.select(name, "dim", "v").mapInPandas(run, f"{name} long, dim int, v binary, bucket long")


def _tiles(rows: DataFrame, name: str, parts: int) -> DataFrame:
    """Rows of a bucket packed into ``parts`` tiles, as even as a hash makes them."""
    return (rows.withColumn("part", F.pmod(F.xxhash64(name), F.lit(parts))).groupBy("dim", "bucket", "part")
            .agg(F.collect_list(F.struct(F.col(name).alias("id"), "v")).alias("rows")))


def _meet(index: DataFrame, probes: DataFrame, kind: str, keep: int) -> DataFrame:
    """Exact scores (q, c, score) of the best candidates of each query in each tile pair."""
    small_batches(index.sparkSession, 4)

    def matrix(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
        v = np.frombuffer(b"".join(r["v"] for r in rows), kind).astype(float)
        return np.array([r["id"] for r in rows]), v.reshape(len(rows), dim)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                (qi, q), (vi, v) = matrix(row.qrows, row.dim), matrix(row.rows, row.dim)
                qs, vs, scores = _best(q, v, keep)
                yield pd.DataFrame({"q": qi[qs], "c": vi[vs], "score": scores})

    met = index.join(probes.select("dim", "bucket", F.col("part").alias("qpart"), F.col("rows").alias("qrows")), ["dim", "bucket"])
    return met.select("dim", "rows", "qrows").mapInPandas(score, "q long, c long, score double")


def _members(named: DataFrame, points: DataFrame, keep: int) -> DataFrame:
    """(c, vec_id): of each class of equal vectors the ``keep`` smallest ids.

    Others can never be among a query's nearest ``keep`` - 1: they tie with
    these, and the smaller ids win.
    """
    some = named.join(points.filter("n > 1").select("c", "v"), "v").select("c", "vec_id")
    some = some.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for group in (["c", "salt"], ["c"]):  # the smallest of each part first, so that a hot class is never in one task
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("vec_id"))
        some = some.withColumn("r", rank).filter(F.col("r") <= keep).drop("r")
    return points.filter("n = 1").select("c", F.col("c").alias("vec_id")).unionByName(some.select("c", "vec_id"))


def _top(found: DataFrame, members: DataFrame, q_class: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each query from scored classes."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    # classes further than the k + 1 best cannot reach the k nearest ids
    few = found.distinct().withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    # queries with equal vectors share their candidates
    ids = few.join(members, "c").join(q_class.select(F.col("vec_id").alias("query_id"), F.col("c").alias("q")), "q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (ids.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, tables: int = TABLES,
           probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (rows of ``vectors``) by cosine.

    Vectors that are missing, zero or hold a missing or non-finite component,
    and rows without vec_id, take no part, neither as query nor as candidate.
    Only vectors of equal length are compared.  Rows repeated with one id count
    once (the vectors of one id are taken to be equal).  A query that finds
    fewer than k by its buckets is compared with all vectors, in tiles.
    """
    keep = k + 1  # a query may be among its own class
    exact = vectors.schema["embedding"].dataType == ArrayType(FloatType())
    v = F.col("embedding") if exact else F.transform("embedding", lambda x: x.cast("double"))
    named = write_and_read(vectors.filter(usable("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).distinct())
    points = write_and_read(named.groupBy("v").agg(F.min("vec_id").alias("c"), F.count_distinct("vec_id").alias("n")))
    asked = queries.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct()
    q_class = write_and_read(named.join(asked, "vec_id", "left_semi").join(points, "v").select("vec_id", "c"))
    kind = _kind(points)
    packed = write_and_read(_pack(points, "c"))
    packed_q = packed.join(q_class.select("c").distinct(), "c", "left_semi").withColumnRenamed("c", "q")
    # were all vectors in one bucket, a tile would still hold TILE_ROWS times 16 of them at most
    parts, q_parts = -(-packed.count() // (16 * TILE_ROWS)) or 1, -(-q_class.count() // (16 * QUERY_ROWS)) or 1
    members = _members(named, points, keep)
    found = write_and_read(_top(_meet(_tiles(_probe(packed, "c", kind, tables, 1), "c", parts),
                                      _tiles(_probe(packed_q, "q", kind, tables, probes), "q", q_parts), kind, keep),
                                members, q_class, k))
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("query_id", "vec_id")
    short = write_and_read(q_class.join(counts, "vec_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("vec_id", "c"))
    if short.isEmpty():
        return found
    one = F.lit(0).cast("bigint").alias("bucket")
    again = packed_q.join(short.select(F.col("c").alias("q")).distinct(), "q", "left_semi")
    whole = _meet(_tiles(packed.select("*", one), "c", 16 * parts), _tiles(again.select("*", one), "q", 16 * q_parts), kind, keep)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(
        _top(whole, members, short, k))


def op3_cross_polytope(spark, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
