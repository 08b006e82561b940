"""Mix sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate: its target share of the wanted bytes
over the bytes it has.  Every document draws a Poisson count with that mean by
inverting the distribution at a uniform number seeded by a hash of the
document, is exploded by its count, and all copies are shuffled globally.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import free_name, read, text_of

#: Target shares of bytes.  Sources that are not named share ``REST`` by their size.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10}
REST = 0.60
SEED = "mix-1"
#: A larger mean is drawn as a sum of independent draws of at most this mean.
MAX_MEAN = 16.0


def poisson_steps(mean: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2 ... until rounding hides the rest."""
    steps, total, k = [], 0.0, 0
    while True:
        total += math.exp(-mean + (k * math.log(mean) if k else 0.0) - math.lgamma(k + 1))
        if k > mean and 1.0 - total < 2.0 ** -53:
            return steps
        steps.append(total)
        k += 1
        if k > 40 + 12 * mean:
            return steps


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash; the same parts give the same number."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 52)


def group_of(weights: Mapping[str, float]) -> Column:
    """The named source, or null for every other one."""
    return F.when(F.col("source").isin(*weights), F.col("source")) if weights else F.lit(None).cast("string")


def rates(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, rest: float = REST,
          epochs: float = 1.0) -> dict[str | None, float]:
    """Mean repetition rate of each named source and (None) of the others.

    A row per named source comes back, so its number is that of ``weights``.
    Shares of sources without a byte go to the others in proportion.
    """
    sizes = docs.select(group_of(weights).alias("g"), F.octet_length(text_of()).cast("bigint").alias("b"))
    found = {r["g"]: int(r["b"]) for r in sizes.groupBy("g").agg(F.sum("b").alias("b")).collect() if r["b"]}
    share = {g: float(weights.get(g, 0.0) if g is not None else rest) for g in found}
    if any(s < 0 for s in share.values()):
        raise ValueError("weights must not be negative")
    whole, total = sum(share.values()), sum(found.values())
    return {g: (epochs * total * share[g] / whole / found[g] if whole else 0.0) for g in found}


def draws(group: Column, rate: Mapping[str | None, float], seed: str) -> Column:
    """The Poisson count of a row."""
    key = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.md5(text_of().cast("binary"))]

    def passed(steps: Column, u: Column) -> Column:
        return F.size(F.filter(steps, lambda x: x < u))

    def count(mean: float) -> Column:
        if mean <= 0:
            return F.lit(0)
        parts = math.ceil(mean / MAX_MEAN)
        steps = F.array(*[F.lit(x) for x in poisson_steps(mean / parts)])
        total = F.lit(0)
        for i in range(parts):
            total = total + passed(steps, uniform(*key, F.lit(str(i))))
        return total

    out = F.lit(0)
    for g, mean in rate.items():
        out = F.when(group.isNull() if g is None else group == g, count(mean)).otherwise(out)
    return out.cast("int")


def replicate(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, rest: float = REST, epochs: float = 1.0,
              seed: str = SEED) -> DataFrame:
    """docs with each row as often as its draw says, numbered from 0 by a new column ``copy``, globally shuffled.

    ``shuffle_key`` (hex) gives the shuffled order; rows are dealt to partitions
    by it and sorted by it there, so a hot source spreads over all tasks.
    A missing source counts as one that is not named.  The draw depends on
    doc_id and text, so wholly repeated rows get equal counts; rows with a
    missing doc_id still draw by their text.  Documents that draw 0 go: that is
    the method.  Empty texts draw at their source's rate.  An empty table, or
    one without a byte, gives no rows.
    """
    group = group_of(weights)
    rate = rates(docs, weights, rest, epochs)
    times, copy, key = (free_name(docs, n) for n in ("_times", "copy", "shuffle_key"))
    many = (docs.withColumn(times, draws(group, rate, seed)).filter(F.col(times) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times).cast("bigint") - 1))).drop(times))
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("doc_id").cast("string"),
                             F.col(copy).cast("string")).cast("binary"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (many.withColumn(key, mark).repartition(parts, F.xxhash64(key, F.rand(7)))
            .sortWithinPartitions(key))


def op9_poisson_mix(spark, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return replicate(docs).select("doc_id", "source", "copy", "shuffle_key", text_digest().alias("text_md5"))


def text_digest() -> Column:
    return F.md5(text_of().cast("binary"))


def oracle(weights: Mapping[str, float] = WEIGHTS, rest: float = REST, seed: str = SEED) -> str:
    """The same rows in SQL: rates, distributions and draws are computed there anew."""
    named = ", ".join(f"('{g}', {w!r})" for g, w in weights.items())
    listed = ", ".join(f"'{g}'" for g in weights)
    return f"""
WITH w(g, share) AS (VALUES {named}, ('', {rest!r})),
d AS (SELECT doc_id, source, CASE WHEN source IN ({listed}) THEN source ELSE '' END AS g, coalesce(text, '') AS t
      FROM documents),
s AS (SELECT g, sum(strlen(t)) AS b FROM d GROUP BY g HAVING sum(strlen(t)) > 0),
r AS (SELECT s.g, (SELECT sum(b) FROM s) * share / (SELECT sum(share) FROM s JOIN w USING (g)) / b AS mean
      FROM s JOIN w USING (g)),
p AS (SELECT g, mean, ceil(mean / {MAX_MEAN})::INT AS parts, mean / ceil(mean / {MAX_MEAN}) AS m FROM r),
c AS (SELECT g, parts, list_transform(range(0, (60 + 13 * m)::INT), lambda k: list_sum(list_transform(range(0, k + 1),
        lambda j: exp(-m + j * ln(m) - lgamma(j + 1.0))))) AS cdf FROM p),
n AS (SELECT doc_id, source, md5(t) AS text_md5, list_sum(list_transform(range(0, parts), lambda i:
        len(list_filter(cdf, lambda x: x < (('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, 'none'),
          md5(t), i::VARCHAR)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)))) AS times
      FROM d JOIN c USING (g)),
e AS (SELECT doc_id, source, text_md5, unnest(range(0, times::BIGINT)) AS copy FROM n WHERE times > 0)
SELECT doc_id, source, copy, text_md5,
       md5(concat_ws('|', '{seed}', 'order', doc_id::VARCHAR, copy::VARCHAR)) AS shuffle_key FROM e"""
