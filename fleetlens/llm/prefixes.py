"""The trie of conversation prefixes, by truncation peeling.

Every conversation is a path of turns.  Peeling starts at the greatest depth:
the conversations that end there are grouped by their whole sequence, which
discovers the nodes of that depth and aggregates them at once.  Each node then
goes on as its smallest member, its last turn is stripped, and at the next depth
it meets the other nodes with the same rest and the conversations that end
there.  So a conversation is carried from its end only as far as it is alone,
and each depth groups nodes, not conversations.

A sequence is known by a sum over its turns of hashes that include the turn's
place; to strip a turn is to take its hash away.  Depths that hold few rows
together are peeled by one task in one round, up to ``BLOCK`` rows; a depth with
more rows has a round of its own, reduced in map tasks.  Both write the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import read, scratch_dir, text_of, write_and_read
from fleetlens.operators.ordered import ordered

#: Most rows of several depths that one task peels together.
BLOCK = 20_000
#: Conversations share turns with the one whose number is a multiple of this, below HEADS turns of it.
EVERY, HEADS = 20, 4
#: Conversation numbers in a chunk of text on the way to a digest.
CHUNK = 65_536
WORDS = r"[^\x20\x09-\x0D]+"
ROOT = "0:0"


def turn_hash(role: str = "role", text: str = "text") -> Column:
    return F.sha2(F.concat(F.octet_length(text_of(role)).cast("string"), F.lit(":"), text_of(role), text_of(text)), 256)


def turns_in_order(turns: DataFrame) -> DataFrame:
    """Each turn as (c, i from 1, hash, w words), the text left behind.

    Order is by turn, a missing one first; equal turns follow their hash.  Rows
    without conv_id belong to no conversation and are left out.
    """
    narrow = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn").alias("t"), turn_hash().alias("hash"),
        F.regexp_count(text_of(), F.lit(WORDS)).cast("bigint").alias("w"))
    return ordered(narrow, ["c"], ["t", "hash"], rank="i").select("c", F.col("i").cast("bigint").alias("i"), "hash", "w")


def own_sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, len) and their turns (c, pos, hash, w) as they are."""
    rows = write_and_read(turns_in_order(turns))
    return rows.groupBy("c").agg(F.count(F.lit(1)).alias("len")), rows.withColumnRenamed("i", "pos")


def rebuilt_sequences(turns: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations and turns, the first h turns taken from conversation c - c % every.

    h is the unsigned crc32 of c in decimal modulo ``heads``; c % every has the
    sign of c.  A conversation may be left without turns.
    """
    rows = write_and_read(turns_in_order(turns))
    base = F.col("c") - F.col("c") % every
    # at most heads - 1 turns of each base
    head = (rows.filter((F.col("c") % every == 0) & (F.col("i") < heads)).groupBy(F.col("c").alias("b"))
            .agg(F.sort_array(F.collect_list(F.struct("i", "hash", "w"))).alias("head")))
    convs = (rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
             .withColumns({"h": F.crc32(F.col("c").cast("string")) % heads, "b": base})
             .join(head, "b", "left")
             .withColumn("head", F.filter("head", lambda x: x["i"] <= F.col("h")))
             .withColumn("m", F.coalesce(F.when(F.col("head").isNotNull(), F.size("head")), F.lit(0)).cast("bigint")))
    convs = write_and_read(convs.select("c", "n", "h", "m", "head", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    taken = convs.select("c", F.explode("head").alias("x")).select("c", F.col("x.i").alias("pos"), "x.hash", "x.w")
    rest = (rows.filter(F.col("i") > F.crc32(F.col("c").cast("string")) % heads).join(convs.select("c", "h", "m"), "c")
            .select("c", (F.col("m") + F.col("i") - F.col("h")).alias("pos"), "hash", "w"))
    return convs.select("c", "len"), taken.unionByName(rest)


def keyed(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """Each turn with the key of the prefix that it ends, the key before it, and whether its conversation ends there."""
    mark = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("hash")), 256)
    part = lambda at: F.conv(F.substring("mark", at, 15), 16, 10).cast("decimal(20,0)")
    marked = (steps.withColumn("mark", mark).withColumns({"x1": part(1), "x2": part(16)})
              .join(convs, "c").select("c", "pos", "w", "x1", "x2", (F.col("pos") == F.col("len")).alias("last")))
    summed = ordered(marked, ["c"], ["pos"], running={"k1": "x1", "k2": "x2"})
    name = lambda a, b: F.concat(a.cast("decimal(38,0)").cast("string"), F.lit(":"), b.cast("decimal(38,0)").cast("string"))
    paths = summed.select("c", "pos", "w", "last", name(F.col("k1"), F.col("k2")).alias("key"),
                          name(F.col("k1") - F.col("x1"), F.col("k2") - F.col("x2")).alias("parent"))
    # depths lie together, so that a round reads its own alone
    return write_and_read(paths.repartitionByRange("pos", "c").sortWithinPartitions("pos"))


_NODE = "key string, parent string, depth long, c long, n long, children long, leaves long, saved long"


def _level(rows: DataFrame) -> DataFrame:
    """Nodes of one depth from its ends and from the nodes below, stripped."""
    grown = rows.groupBy("key").agg(
        F.any_value("parent").alias("parent"), F.any_value("pos").alias("depth"), F.min("c").alias("c"),
        F.sum("n").alias("n"), F.sum("child").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.any_value("w").alias("w"))
    return grown.select("key", "parent", "depth", "c", "n", "children",
                        F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("bigint").alias("leaves"),
                        (F.col("saved") + (F.col("n") - 1) * F.col("w")).alias("saved"))


def _band(rows: DataFrame) -> DataFrame:
    """Nodes of several depths, peeled by one task.  ``rows`` are at most BLOCK."""
    def peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches), ignore_index=True)
        out: list[tuple] = []
        below: dict[int, tuple[int, int, int]] = {}  # smallest member -> n, leaves, saved of a node one deeper
        for depth, level in sorted(whole.groupby("pos"), key=lambda x: -x[0]):
            nodes: dict[str, list] = {}
            for c, key, parent, w, n, child, leaves, saved in level[
                    ["c", "key", "parent", "w", "n", "child", "leaves", "saved"]].itertuples(index=False, name=None):
                if n == 0:  # neither an end nor carried here by an earlier round
                    if c not in below:
                        continue
                    n, leaves, saved = below[c]
                    child = 1
                node = nodes.setdefault(key, [parent, c, 0, 0, 0, 0, w])
                node[1] = min(node[1], c)
                for at, more in enumerate((n, child, leaves, saved), 2):
                    node[at] += more
            below = {}
            for key, (parent, c, n, children, leaves, saved, w) in nodes.items():
                leaves = leaves if children else 1
                saved += (n - 1) * w
                below[c] = (n, leaves, saved)
                out.append((key, parent, depth, c, n, children, leaves, saved))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _NODE.split(", ")])

    return rows.repartition(1).mapInPandas(peel, _NODE)


def bands(rows_at: list[int], block: int) -> list[tuple[int, int]]:
    """Depths (lowest, highest) of each round, deepest first; ``rows_at[d - 1]`` are the rows of depth d."""
    out, high = [], len(rows_at)
    while high:
        low, rows = high, rows_at[high - 1]
        while low > 1 and rows + rows_at[low - 2] <= block:
            low -= 1
            rows += rows_at[low - 1]
        out.append((low, high))
        high = low - 1
    return out


def peel(spark: SparkSession, convs: DataFrame, paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes but the root."""
    counts = {r["len"]: r["n"] for r in convs.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    rows_at, here = [], 0
    for depth in range(max(counts, default=0), 0, -1):
        here += counts.get(depth, 0)
        rows_at.append(here)
    rows_at.reverse()
    folder, above = scratch_dir(spark), None
    nodes = lambda at: spark.read.schema(_NODE).parquet(f"{folder}/round={at}")
    for at, (low, high) in enumerate(bands(rows_at, block)):
        rows = paths.filter(F.col("pos").between(low, high))
        if above is None:
            rows = rows.withColumns({"child": F.lit(0), "leaves": F.lit(0), "saved": F.lit(0), "n": F.col("last").cast("int")})
        else:
            carried = nodes(at - 1).filter(F.col("depth") == above).select(
                "c", F.lit(high).cast("bigint").alias("pos"), F.col("n").alias("n_"), "leaves", "saved")
            rows = rows.join(carried, ["c", "pos"], "left").withColumns({
                "child": F.col("n_").isNotNull().cast("int"), "n": F.coalesce("n_", F.col("last").cast("bigint")),
                "leaves": F.coalesce("leaves", F.lit(0)), "saved": F.coalesce("saved", F.lit(0))})
        rows = rows.select("c", "pos", "key", "parent", "w", *[F.col(x).cast("bigint").alias(x) for x in ("n", "child", "leaves", "saved")])
        (_band(rows) if low < high else _level(rows.filter("n > 0"))).write.parquet(f"{folder}/round={at}")
        above = low
    if above is None:
        return spark.createDataFrame([], _NODE)
    return spark.read.schema(_NODE).parquet(folder).select(*[x.split()[0] for x in _NODE.split(", ")])


def digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined, ascending numbers of each key.

    Numbers are sorted over all tasks and joined to chunks of text there, so only
    the hashing itself, which has to go from front to back, is one task a key.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, out = None, [], []

        def close() -> None:
            if mine:
                out.append((key, mine[0], ",".join(map(str, mine))))
                mine.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string()))],
                                              ["key", "first", "part"])

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("c").to_pylist()):
                if k != key or len(mine) >= CHUNK:
                    close()
                    key = k
                mine.append(c)
            yield flush()
        close()
        yield flush()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for k, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()):
                if k != key:
                    if digest:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(part.encode())
                else:
                    digest.update(b"," + part.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["key", "sha"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "sha"])

    parts = ends.repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(chunks, "key string, first long, part string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(whole, "key string, sha string")


def prefix_trie(spark: SparkSession, convs: DataFrame, steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` (c, len) may hold conversations without turns, which end at the
    root; ``steps`` are their turns (c, pos from 1, hash, w).  Missing roles and
    texts are empty; equal whole rows are turns of their own.  Without any
    conversation there is no node, not even the root.
    """
    paths = keyed(convs, steps)
    below = peel(spark, convs, paths, block)
    quiet = convs.filter("len = 0").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"))
    top = (below.filter("depth = 1").agg(F.min("c").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("children"),
                                         F.sum("leaves").alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")))
    a, b = top.first(), quiet.first()  # one row each
    root_conv = min((x for x in (a["c"], b["c"]) if x is not None), default=None)
    root = spark.createDataFrame([] if root_conv is None else [
        (ROOT, None, 0, root_conv, a["n"] + b["n"], a["children"], a["leaves"] if a["children"] else 1, a["saved"])], _NODE)
    ends = paths.filter("last").select("key", "c").unionByName(convs.filter("len = 0").select(F.lit(ROOT).alias("key"), "c"))
    found = below.unionByName(root).join(digests(ends), "key", "left")
    # the root's children know their parent; a key of their own keeps them from meeting in one task
    up = found.withColumn("up", F.when(F.col("depth") > 1, F.col("parent")).otherwise(F.concat(F.lit("-"), F.col("key"))))
    parents = below.select(F.col("key").alias("up"), F.col("c").alias("up_c"))
    return up.join(parents, "up", "left").select(
        F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.lit(root_conv)).otherwise(F.col("up_c")).cast("bigint").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_truncation_peeling(spark, sf: str) -> DataFrame:
    convs, steps = rebuilt_sequences(read(spark, sf, "conversations"))
    return prefix_trie(spark, convs, steps)
