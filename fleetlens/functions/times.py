"""Clock text, durations and elapsed time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z"


def parse_rfc3339(text: Column) -> Column:
    """Timestamp, or null when the text is no timestamp with an offset."""
    return F.when(text.rlike(_RFC3339), text.try_cast("timestamp"))


def wall_clock(text: Column) -> Column:
    """The clock as it was written, without its offset; null when unparseable."""
    return F.when(parse_rfc3339(text).isNotNull(), F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")))


def human_duration(seconds: Column) -> Column:
    """``1h 2m``, ``2m 3s`` or ``3s``, every part truncated towards zero."""
    whole = seconds.cast("bigint")
    hours = F.floor(F.abs(whole) / 3600) * F.signum(whole).cast("bigint")
    minutes = F.floor(F.abs(whole) / 60) * F.signum(whole).cast("bigint") % 60
    rest = whole % 60
    return (F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
            .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
            .otherwise(F.concat(rest.cast("string"), F.lit("s"))))


def with_elapsed(df: DataFrame, as_of: Column, *, listed: str | None = None, detailed: str | None = None,
                 status: str = "status", start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Add end minus start, or time so far with ``*`` while in progress, else ``N/A``.

    The list form shows a running deployment even when no time has passed; the
    detail form does not, and stars by status alone.  Clock texts are parsed
    once per row, in a projection of their own.
    """
    parsed = df.withColumns({"_started": parse_rfc3339(F.col(start)), "_ended": parse_rfc3339(F.col(end)),
                             "_no_end": F.coalesce(F.col(end), F.lit("")) == ""})
    spans = parsed.withColumns({
        "_span": F.unix_micros(F.coalesce("_ended", F.when(F.col("_no_end"), as_of))) - F.unix_micros("_started"),
        "_running": F.coalesce(F.col(status) == "in_progress", F.lit(False))})
    text = spans.withColumn("_text", human_duration(
        (F.signum("_span") * F.floor(F.abs("_span") / 1_000_000)).cast("bigint")))
    ahead = F.col("_span") > 0
    starred = F.concat("_text", F.lit("*"))
    out = {}
    if listed:
        out[listed] = F.when(F.col("_no_end"), F.when(F.col("_running"), starred)).when(ahead, F.col("_text"))
    if detailed:
        out[detailed] = F.when(~ahead, None).when(F.col("_running"), starred).when(~F.col("_no_end"), F.col("_text"))
    return text.withColumns({name: F.coalesce(value, F.lit("N/A")) for name, value in out.items()}).drop(
        "_started", "_ended", "_no_end", "_span", "_running", "_text")


# Unit names and their length in seconds.
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration_seconds(text: Column) -> Column:
    """``1h2m3.5s`` to 3723.5; null when the text is no such duration."""
    unit = r"(ns|us|µs|μs|ms|s|m|h)"
    number = r"(\d+(?:\.\d*)?|\.\d+)"
    shape = rf"\A[-+]?(?:0|(?:{number}{unit})+)\z".replace("(ns", "(?:ns").replace(r"(\d+", r"(?:\d+")
    scale = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair])
    numbers = F.regexp_extract_all(text, F.lit(number + unit), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(number + unit), F.lit(2))
    parts = F.zip_with(numbers, units, lambda n, u: n.try_cast("double") * F.element_at(scale, u))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(text.rlike(shape), sign * total)
