"""Log text: failure classes, redaction, segments, request pairs (FL7, P13, P14, W7, W8)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.text import blank
from fleetlens.operators.ordered import ordered

# Text written over a secret, the secret's element, and the
# marks of request lines and phase headers.
REDACTED = "***[REDACTED]***"
SESSION_TAG = "X-API-Session"
REQUEST_LINE = r"\[HMC ([→←✗])\] (\S+) (.*)$"
HEADER_LINE = r"=== (.+) ==="


@dataclass(frozen=True)
class ErrorClass:
    """A needle in log or error text; the first match of a source decides."""

    source: str
    needle: str
    name: str
    benign: bool = False
    any_case: bool = True


# Needles as the tools print them, in the order they are tried.
ERROR_CLASSES = (
    ErrorClass("mirror", "not found", "missing_image"),
    ErrorClass("mirror", "manifest unknown", "missing_image"),
    ErrorClass("mirror", "unauthorized", "auth"),
    ErrorClass("mirror", "invalid credentials", "auth"),
    ErrorClass("mirror", "no space left on device", "disk_full"),
    ErrorClass("catalog", "no release found", "missing_release"),
    ErrorClass("catalog", "unauthorized", "auth"),
    ErrorClass("catalog", "invalid credentials", "auth"),
    ErrorClass("catalog", "no space left on device", "disk_full"),
    ErrorClass("api", "406", "session_expired", any_case=False),
    ErrorClass("power", "HSCL1558", "already_off", True, any_case=False),
    ErrorClass("power", "unavailable in the current partition state", "already_off", True),
    ErrorClass("power", "already running", "already_running", True, any_case=False),
    ErrorClass("mount", "already mounted", "already_mounted", True, any_case=False),
    ErrorClass("mount", "500", "session_lost", any_case=False),
    ErrorClass("mount", "session is null", "session_lost", any_case=False),
    ErrorClass("media", "already exists", "already_exists", True, any_case=False),
    ErrorClass("media", "not found", "absent", True, any_case=False),
    ErrorClass("unmount", "Could not find anything to unmount", "not_mounted", True, any_case=False),
    ErrorClass("unmount", "not mounted", "not_mounted", True, any_case=False),
    ErrorClass("remove", "No such file or directory", "absent", True, any_case=False),
    ErrorClass("remove", "not found", "absent", True, any_case=False),
)


def classify(df: DataFrame, text: str, source: str, rules: Sequence[ErrorClass] = ERROR_CLASSES) -> DataFrame:
    """Add ``error_class`` and ``benign``; text that matches nothing stays null (FL7)."""
    name: Column | None = None
    benign: Column | None = None
    lowered = F.lower(F.col(text))
    for r in (r for r in rules if r.source == source):
        hit = F.contains(lowered, F.lit(r.needle.lower())) if r.any_case else F.contains(F.col(text), F.lit(r.needle))
        name = F.when(hit, r.name) if name is None else name.when(hit, r.name)
        benign = F.when(hit, F.lit(r.benign)) if benign is None else benign.when(hit, F.lit(r.benign))
    if name is None or benign is None:
        raise ValueError(f"no rules for source {source!r}")
    return df.withColumns({"error_class": name, "benign": F.coalesce(benign, F.lit(False))})


RULES = "ord bigint, needle string, name string, benign boolean, any_case boolean"
#: Most rules of a table; they travel to every task.
MOST_RULES = 1_000_000


def rule_table(spark: SparkSession, source: str, rules: Sequence[ErrorClass] = ERROR_CLASSES) -> DataFrame:
    """The rules of one source as a table for ``classify_by``, in the order they are tried."""
    return spark.createDataFrame([(i, r.needle, r.name, r.benign, r.any_case) for i, r in enumerate(
        r for r in rules if r.source == source)], RULES)


def classify_by(df: DataFrame, text: str, rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """Like ``classify``, by a table of rules (ord, needle, name, benign, any_case): the first by ``ord`` decides (FL7).

    One automaton finds all needles in one pass over a text, however many there
    are.  Equal ``ord`` follow the name; an empty needle is in every text.  More
    than ``most`` rules are refused, as the table goes to every task.
    """
    listed = sorted(((r["ord"], r["name"], bool(r["benign"]), bool(r["any_case"]), r["needle"] or "") for r in rules.limit(most + 1).collect()),
                    key=lambda r: (r[0], r[1] or "", r[2], r[3], r[4]))
    if len(listed) > most:
        raise ValueError(f"more than {most} rules")

    @F.pandas_udf("name string, benign boolean")
    def first(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automata = []
        for fold in (False, True):
            words: dict[str, int] = {}
            for at, (_, _, _, any_case, needle) in enumerate(listed):
                if any_case == fold:
                    words.setdefault(needle.lower() if fold else needle, at)
            always = words.pop("", len(listed))
            automaton = ahocorasick.Automaton()
            for word, at in words.items():
                automaton.add_word(word, at)
            if words:
                automaton.make_automaton()
            automata.append((fold, automaton if words else None, always))
        for batch in texts:
            names, benign = [], []
            for x in batch:
                best = len(listed)
                if x is not None:
                    for fold, automaton, always in automata:
                        best = min(best, always)
                        if automaton is not None:
                            best = min([best, *(at for _, at in automaton.iter(x.lower() if fold else x))])
                hit = best < len(listed)
                names.append(listed[best][1] if hit else None)
                benign.append(listed[best][2] if hit else False)
            yield pd.DataFrame({"name": names, "benign": benign})

    found = df.withColumn("_first", first(F.col(text)))
    return found.withColumns({"error_class": F.col("_first.name"), "benign": F.col("_first.benign")}).drop("_first")


def split_failed(df: DataFrame, text: str = "failed_event") -> DataFrame:
    """``event: error`` text to its parts; only the first separator splits."""
    part = F.split(F.col(text), ": ", 2)
    return df.withColumns({"event": F.get(part, F.lit(0)), "error": F.get(part, F.lit(1))})


def redact(df: DataFrame, text: str, tokens: Sequence[str] = (), tag: str = SESSION_TAG) -> DataFrame:
    """Remove secrets from whole texts.

    ``tokens`` are columns with secrets known for the row's own request, replaced
    first.  Then whatever stands inside the tag on one line is replaced.
    """
    clean = F.col(text)
    for token in tokens:
        known = blank(F.col(token)) != ""
        clean = F.when(known, F.replace(clean, F.col(token), F.lit(REDACTED))).otherwise(clean)
    # Only a line feed ends a line; other control characters belong to it.
    inside = rf"(?i)(<{tag}>)[^\n]*?(</{tag}>)"
    safe = REDACTED.replace("$", r"\$")
    return df.withColumn(text, F.regexp_replace(clean, inside, f"$1{safe}$2"))


def segment_log(lines: DataFrame, scope: Sequence[str] = ("cluster_name", "file"), at: str = "line_no",
                text: str = "text", header: Column | None = None, slices: int | None = None) -> DataFrame:
    """Log segments from one phase header to the next.

    Lines before the first header form segment 0.  Segments are summed up, not
    gathered: first and last position, lines, and the header's title.
    """
    is_header = header if header is not None else F.col(text).rlike(HEADER_LINE)
    marked = lines.select(*scope, at, is_header.cast("int").alias("_h"), F.when(
        is_header, F.coalesce(F.nullif(F.regexp_extract(text, HEADER_LINE, 1), F.lit("")), F.col(text))).alias("_t"))
    numbered = ordered(marked, list(scope), [at], running={"segment": "_h"}, slices=slices)
    return numbered.groupBy(*scope, "segment").agg(
        F.max("_t").alias("title"), F.min(at).alias("first_line"), F.max(at).alias("last_line"),
        F.count(F.lit(1)).alias("lines"))


def request_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines of the request log, as kind (open, close, error), head and address."""
    arrow = F.regexp_extract(text, REQUEST_LINE, 1)
    rest = F.regexp_extract(text, REQUEST_LINE, 3)
    kind = F.when(arrow == "→", "open").when(arrow == "←", "close").when(arrow == "✗", "error")
    url = F.when(kind == "error", F.substring_index(rest, " — ", 1)).otherwise(
        F.substring_index(rest, " ", -1))
    return (lines.withColumns({"kind": kind, "head": F.regexp_extract(text, REQUEST_LINE, 2), "url": url})
            .filter(F.col("kind").isNotNull()))


def pair_requests(requests: DataFrame, scope: Sequence[str] = ("cluster_name", "url"),
                  order: Sequence[str] = ("at", "line_no"), at: str = "at", slices: int | None = None) -> DataFrame:
    """The n-th request to an address with its n-th reply, and the time between.

    Lines carry no request id.  A pair is ``ambiguous`` when another request was
    open at either end of it, and ``unanswered`` when no reply follows.
    """
    opened = F.col("kind") == "open"
    marked = requests.withColumns({"_o": opened.cast("int"), "_c": (~opened).cast("int")})
    seen = ordered(marked, list(scope), list(order), running={"_opens": "_o", "_closes": "_c"}, slices=slices)
    turn = F.when(F.col("kind") == "open", F.col("_opens")).otherwise(F.col("_closes"))
    pending = F.col("_opens") - F.col("_closes")
    overlap = F.when(F.col("kind") == "open", pending > 1).otherwise(pending >= 1)
    return (seen.select(*scope, turn.alias("turn"), F.col(at).alias("_at"), F.col("kind").alias("_kind"),
                        overlap.alias("_overlap"))
            .groupBy(*scope, "turn").agg(
                F.min(F.when(F.col("_kind") == "open", F.col("_at"))).alias("opened_at"),
                F.min(F.when(F.col("_kind") != "open", F.col("_at"))).alias("closed_at"),
                F.bool_or(F.col("_kind") == "error").alias("failed"),
                F.bool_or("_overlap").alias("ambiguous"))
            .withColumn("unanswered", F.col("closed_at").isNull()))
