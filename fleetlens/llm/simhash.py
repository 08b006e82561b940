"""SimHash near-duplicates by tiled exact comparison.

Texts become 64-bit fingerprints of their word shingles.  Equal fingerprints
are one class.  Classes are packed into tiles by population count; every pair
of tiles whose counts lie within the radius is compared in full with exclusive
or and bit counts, the other pairs cannot hold a link and are skipped.  A task
hands on a spanning forest of the links it finds, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import components, row_hash, small_batches, write_and_read

SHINGLE = 4
RADIUS = 4
#: Fingerprints of one tile, 8 bytes each.
TILE_ROWS = 32_768
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint: bit b is 1 if set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        starts = np.zeros(len(words), np.int64)
        np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
        ends = np.append(starts[shingle:] - 1, len(line)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], 42) for s, e in zip(starts.tolist(), ends)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at:at + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(bits * 2 > len(hashes), bitorder="little")
    return int(ones.view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], shingle: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint as a signed long; one row per row of docs."""
    small_batches(docs.sparkSession)

    def hash_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            fps = np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in batch["text"]], dtype="<u8")
            out["fp"] = fps.view("<i8")
            yield out

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInPandas(hash_batch, f"{fields}, fp long")


def _link(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the values of two tiles (b None: within a)."""
    both = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    parent = np.arange(len(both))

    def find(ids: np.ndarray) -> np.ndarray:
        roots = parent[ids]
        while True:
            up = parent[roots]
            if np.array_equal(up, roots):
                return roots
            roots = up

    step = max(1, (1 << 18) // max(1, len(other)))
    for at in range(0, len(a), step):
        close = np.bitwise_count(a[at:at + step, None] ^ other[None, :]) <= radius
        for i in np.flatnonzero(close.sum(axis=1) > (b is None)):
            ids = np.append(np.flatnonzero(close[i]) + shift, at + i)
            roots = np.unique(find(ids))
            parent[roots] = roots[0]
            parent[ids] = roots[0]
    roots = find(np.arange(len(both)))
    tied = np.flatnonzero(roots != np.arange(len(both)))
    return both[tied], both[roots[tied]]


def links(classes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (u, v) that span all classes (fp) within ``radius`` of each other."""
    spark = classes.sparkSession
    pops = classes.select("fp", F.bit_count("fp").cast("int").alias("pop"))
    sizes = {r["pop"]: r["n"] for r in pops.groupBy("pop").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 at most
    if not sizes:
        return spark.createDataFrame([], "u long, v long")
    parts = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, -(-n // tile_rows))])
    tiled = pops.withColumn("part", F.pmod(F.xxhash64("fp"), F.element_at(parts, F.col("pop"))).cast("int"))
    tiles = write_and_read(tiled.groupBy("pop", "part").agg(F.collect_list("fp").alias("fps")))
    near = F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)).alias("pop2")
    left, ids = tiles.select("pop", "part", near), tiles.select(F.col("pop").alias("pop2"), F.col("part").alias("part2"))
    pairs = left.join(ids, "pop2").filter("pop2 > pop or part2 >= part")
    joined = (pairs.join(tiles, ["pop", "part"])
              .join(tiles.select(F.col("pop").alias("pop2"), F.col("part").alias("part2"), F.col("fps").alias("fps2")),
                    ["pop2", "part2"]))
    small_batches(spark, 8)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                same = (row.pop, row.part) == (row.pop2, row.part2)
                a = np.asarray(row.fps, np.int64).view(np.uint64)
                b = None if same else np.asarray(row.fps2, np.int64).view(np.uint64)
                u, v = _link(a, b, radius)
                if len(u):
                    yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = joined.repartition(tasks, F.xxhash64("pop", "part", "pop2", "part2"))
    return write_and_read(spread.select("pop", "part", "pop2", "part2", "fps", "fps2").mapInPandas(compare, "u long, v long"))


def clusters(prints: DataFrame, least: str, radius: int = RADIUS) -> DataFrame:
    """Adds ``component_id`` to rows with ``fp``: the smallest ``least`` reachable over links.

    ``prints`` should be a written table; it is read more than once.
    """
    classes = write_and_read(prints.groupBy("fp").agg(F.min(least).alias("_least")))
    tied = write_and_read(components(links(classes.select("fp"), radius)))
    rooted = classes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("root"))
    best = write_and_read(rooted.groupBy("root").agg(F.min("_least").alias("component_id")))
    ids = write_and_read(rooted.join(best, "root").select("fp", "component_id"))
    return prints.join(ids, "fp", "left")


def simhash_clusters(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    A missing or empty text has fingerprint zero and links like any other.
    Repeated rows keep one row each.  A missing doc_id never names a component
    unless all its members miss theirs.  Other columns are ignored.
    """
    prints = write_and_read(fingerprints(docs.select("doc_id", "text"), ["doc_id"], shingle))
    return clusters(prints, "doc_id", radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, ties to the smaller row hash.

    Rows wholly equal to the kept one go too.  A component without any doc_id
    keeps the row of smallest hash.
    """
    columns = docs.columns
    keyed = docs.withColumn("_row", row_hash(docs))
    prints = write_and_read(fingerprints(keyed.select("doc_id", "text", "_row"), ["doc_id", "_row"], shingle))
    ordered = prints.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("at"))
    best = clusters(write_and_read(ordered), "at", radius).select(
        F.col("component_id._row").alias("_row")).distinct()
    # the join has dealt rows by _row, which distinct can use: equal rows meet without another exchange
    return keyed.join(best, "_row", "left_semi").distinct().select(*columns)


def op4_simhash_tiles(spark, sf: str) -> DataFrame:
    from fleetlens.llm.common import read

    return simhash_clusters(read(spark, sf, "documents"))
