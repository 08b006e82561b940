"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (doc_id, tie).  Boundaries between shards are found by
counting the exact bytes below candidate keys over all partitions, again and
again, with candidates drawn closer until each boundary meets the tolerance or
no row is left between its neighbours.  Then rows move once.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import free_name, read, text_of, write_and_read

SHARDS = 40
#: A boundary is good within this share of a shard's bytes.
TOLERANCE = 0.002
#: New candidates between the neighbours of each open boundary in a round.
PROBES = 8
ROW_BYTES = 16
_TOP = 1 << 128


def _packed(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that sort like (id, tie)."""
    key = np.empty((len(ids), 2), ">u8")
    key[:, 0] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    key[:, 1] = ties.astype(np.int64).view(np.uint64)
    return np.ascontiguousarray(key).view("S16").ravel()


def below(keyed: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """For each sorted probe, the exact bytes and rows with a key below it."""
    marks = b"".join(k.to_bytes(16, "big") for k in probes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.frombuffer(marks, "S16")
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, _packed(b["k"].to_numpy(), b["tie"].to_numpy()), side="right")
            np.add.at(size, at, b["size"].to_numpy(np.int64))
            np.add.at(rows, at, 1)
        full = np.flatnonzero(rows)
        yield pd.DataFrame({"at": full, "size": size[full], "n": rows[full]})

    found = (keyed.select("k", "tie", "size").mapInPandas(count, "at long, size long, n long")
             .groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect())  # one row a probe at most
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in found:
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()))


def splitters(keyed: DataFrame, targets: list[tuple[int, int]], total: int, rows: int) -> list[int]:
    """For each (wanted bytes, allowed slack), ascending, a key below which about so many bytes lie."""
    known = {0: (0, 0), _TOP - 1: (total, rows)}  # key -> bytes and rows below it
    cuts = [want / total for want, _ in targets]
    first = keyed.agg(F.percentile_approx("k", cuts, 2000).alias("q"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    probes = sorted({(int(k) + (1 << 63)) << 64 for k in [first["lo"], first["hi"], *(first["q"] or [])]})
    while True:
        for key, counts in zip(probes, below(keyed, probes)):
            known[key] = counts
        keys = sorted(known)
        sizes = np.array([known[k][0] for k in keys])
        probes, chosen = [], []
        for want, slack in targets:
            hi = min(max(int(np.searchsorted(sizes, want, side="left")), 1), len(keys) - 1)
            lo = hi - 1
            best = lo if want - sizes[lo] <= sizes[hi] - want else hi
            chosen.append(keys[best])
            if abs(int(sizes[best]) - want) <= slack or known[keys[hi]][1] - known[keys[lo]][1] <= 1:
                continue
            # between whole ids while two ids or more are left, then among the rows of one id
            unit = 64 if (keys[hi] >> 64) - (keys[lo] >> 64) > 1 else 0
            low, apart = keys[lo] >> unit, (keys[hi] >> unit) - (keys[lo] >> unit)
            guess = low + apart * (want - int(sizes[lo])) // max(1, int(sizes[hi] - sizes[lo]))
            near = max(1, apart // 64)
            steps = {low + apart * i // (PROBES + 1) for i in range(1, PROBES + 1)} | {guess - near, guess, guess + near}
            probes += [k << unit for k in steps if keys[lo] < k << unit < keys[hi]]
        probes = sorted(set(probes) - known.keys())
        if not probes:
            return chosen


def histogram_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE,
                     columns: list[str] | None = None) -> DataFrame:
    """``columns`` of docs (all by default) with size, text_crc32, shard and slot.

    Size is the UTF-8 bytes of the text (a missing one has none) plus 16.
    Shards hold near-equal bytes, as near as whole rows and the tolerance allow;
    a missing doc_id sorts first, rows with equal doc_id are told apart by a
    number that is written down before it is used.  Slots count each shard's
    rows from 0 in key order.  With fewer rows than shards some stay empty; an
    empty table gives no rows.  Clashing column names of docs are kept and ours
    renamed by a suffix.
    """
    spark = docs.sparkSession
    kept = columns or docs.columns
    size, crc, shard, slot = (free_name(docs.select(*kept), n) for n in ("size", "text_crc32", "shard", "slot"))
    # narrow keys go ahead of everything kept, so that rounds read 24 bytes a row
    source = docs.select(
        F.struct(*kept).alias("row"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("bigint").alias("k"),
        F.monotonically_increasing_id().alias("tie"),
        (F.octet_length(text_of()) + ROW_BYTES).cast("bigint").alias("size"), F.crc32("text").alias("crc"))
    keyed = write_and_read(source)
    whole = keyed.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return keyed.select("row.*", F.col("size").alias(size), F.col("crc").alias(crc), F.lit(0).alias(shard),
                            F.lit(0).cast("bigint").alias(slot))
    # several ranges a shard, so that no task has to number a whole shard
    parts = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    bins = shards * parts
    total, rows = int(whole["b"]), int(whole["n"])
    targets = [(total * i // bins, total // bins // 4 if i % parts else int(tolerance * total / shards)) for i in range(1, bins)]
    edges = splitters(keyed, targets, total, rows)
    outer = edges[parts - 1::parts]
    edges, ends = sorted(edges), sorted(outer)
    marks = b"".join(k.to_bytes(16, "big") for k in edges)
    first = [0, *[n for _, n in below(keyed, edges)]]  # rows before each bin
    owner = [bisect.bisect_right(ends, edges[b - 1]) if b else 0 for b in range(len(edges) + 1)]
    begin = [0, *[first[bisect.bisect_left(edges, e) + 1] for e in ends]]  # rows before each shard
    base = [first[b] - begin[owner[b]] for b in range(len(edges) + 1)]

    @F.pandas_udf("int")
    def bin_of(k: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.frombuffer(marks, "S16"), _packed(k.to_numpy(), tie.to_numpy()), side="right"))

    in_order = Window.partitionBy("bin").orderBy("k", "tie")
    placed = keyed.withColumn("bin", bin_of("k", "tie")).withColumn("nth", F.row_number().over(in_order) - 1)
    # one entry a bin; their number is a setting, not a count of the data
    look = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bin") + 1)
    return placed.select("row.*", F.col("size").alias(size), F.col("crc").alias(crc), look(owner).cast("int").alias(shard),
                         (look(base) + F.col("nth")).cast("bigint").alias(slot))


def op7_histogram_shards(spark, sf: str) -> DataFrame:
    placed = histogram_shards(read(spark, sf, "documents"), columns=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
