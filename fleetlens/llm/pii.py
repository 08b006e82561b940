"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Four kinds of plain spans are always reported.  Looser candidates (credentials
and access keys) are voted on by a pattern, a gazetteer and a context labeler.
Expectation-maximisation over the counts of vote patterns estimates how reliable
the labelers are; its posteriors train a linear span classifier that decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import let, read, text_of, write_and_read

# Base patterns.  Runs are possessive and start where the run starts (or a match ended), which finds the same spans
# as the plain patterns without going over a long run again from each of its characters.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words that announce a credential, and beginnings of known access keys.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential")
PREFIXES = ("AKIA", "ASIA", "ghp_", "sk_live_", "xoxb-")
# Whole secrets, however long: runs are possessive, and bare ones start where the run starts, so each is gone over once.
CANDIDATE = ("(?i:" + "|".join(KEYWORDS) + r")[\x20]?[=:][\x20]?+[\"']?+[A-Za-z0-9_/+-]{6,}+|(?<![A-Za-z0-9_])(?:" + "|".join(PREFIXES)
             + r")[A-Za-z0-9]{8,}+|(?<![A-Za-z0-9_])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{20,}+(?![A-Za-z0-9_])")
LABELERS = ("pattern", "gazetteer", "context")
CONTEXT = 24


def _spans(text: Column, pattern: str, maybe: Column) -> Column:
    """All matches of a pattern as (start, end, value, before) in code points; ``maybe`` rules most texts out cheaply."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def placed(gaps: Column, found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, i: Column) -> Column:
            gap, value = F.get(gaps, i), F.get(found, i)
            begin = acc["at"] + F.length(gap)
            end = begin + F.length(value)
            span = F.struct(begin.alias("start"), end.alias("end"), value.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("before"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.when(maybe, let(found, lambda f: F.when(F.size(f) > 0, let(
        F.split(text, pattern), lambda gaps: placed(gaps, f))).otherwise(none))).otherwise(none)


def _small_byte(part: Column) -> Column:
    """Whether decimal digits, leading zeros or not, are at most 255."""
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds, for up to 19 digits."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each base kind."""
    digit = text.rlike("[0-9]")
    email = _spans(text, BASE["email"], text.contains("@"))
    ip = F.filter(_spans(text, BASE["ip"], text.rlike(r"[0-9]\.[0-9]")),
                  lambda s: F.forall(F.split(s["value"], r"\."), _small_byte))
    card = F.filter(_spans(text, BASE["card"], digit & text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]")), lambda s: let(
        F.translate(s["value"], " -", ""), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)))
    phone = F.filter(_spans(text, BASE["phone"], text.contains("+")),
                     lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(8, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def _votes(span: Column) -> Column:
    """Vote of each labeler (0 no, 1 yes, 2 abstains) and two form features of a candidate span."""
    value = span["value"]
    low, secret = F.lower(value), F.regexp_replace(value, r"^[^=:]*[=:][\x20]?[\"']?", "")
    mixed = secret.rlike("[0-9]") & secret.rlike("[A-Za-z]")
    known = F.lit(False)
    for word in KEYWORDS:
        known = known | low.startswith(word)
    for word in PREFIXES:
        known = known | value.startswith(word)
    pattern = F.when(mixed & (F.length(secret) >= 12), 1).when(~mixed, 0).otherwise(2)
    context = (F.when(span["before"].rlike(r"(?i)(key|login|user|pass|auth|secret)[^\n]{0,12}$") | value.rlike("[=:]"), 1)
               .when(span["before"].rlike(r"[/?&]\S*$"), 0).otherwise(2))
    return F.struct(pattern.alias("pattern"), F.when(known, 1).otherwise(2).alias("gazetteer"), context.alias("context"),
                    F.least(F.length(secret) / 8, F.lit(8)).cast("int").alias("size"), mixed.cast("int").alias("mixed"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list, float, dict]:
    """Expectation-maximisation over counted vote patterns.

    Returns the rates (labeler, class, vote), the share of true spans and the
    posterior of each pattern.
    """
    m = len(LABELERS)
    post = {v: min(max((0.5 + 0.5 * sum((x == 1) - (x == 0) for x in v) / m), 0.05), 0.95) for v, _ in patterns}
    rates, prior = [], 0.5
    for _ in range(rounds):
        mass = [0.0, 0.0]
        seen = [[[1.0] * 3 for _ in range(2)] for _ in range(m)]
        for v, n in patterns:
            for c, p in ((0, 1 - post[v]), (1, post[v])):
                mass[c] += n * p
                for j, x in enumerate(v):
                    seen[j][c][x] += n * p
        rates = [[[x / sum(row) for x in row] for row in voter] for voter in seen]
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[j][1][x] / rates[j][0][x]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
    return rates, prior, post


def _inputs(v: tuple[int, ...], size: int, mixed: int) -> list[float]:
    return [1.0, *[float(x == 1) for x in v], *[float(x == 0) for x in v], size / 8, float(mixed)]


def span_weights(rows: list[tuple[list[float], float, int]], rounds: int = 300) -> list[float]:
    """Logistic regression on (inputs, posterior, count) by gradient steps."""
    weight, total = [0.0] * len(rows[0][0]), sum(n for _, _, n in rows)
    for _ in range(rounds):
        slope = [0.01 * w for w in weight]
        for x, p, n in rows:
            out = 1 / (1 + math.exp(-max(min(sum(a * b for a, b in zip(weight, x)), 30), -30)))
            for i, a in enumerate(x):
                slope[i] += n / total * (out - p) * a
        weight = [w - 2.0 * s for w, s in zip(weight, slope)]
    return weight


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs.

    Counts and the hash are of base spans; ``spans`` lists these and then the
    spans of kind ``secret`` that the classifier accepts.  A missing text is
    empty and has no span; repeated rows are reported alike; other columns are
    ignored.
    """
    slim = docs.select("doc_id", text_of().alias("t"))
    text = F.col("t")
    maybe = text.rlike("(?i)" + "|".join(KEYWORDS)) | text.rlike("|".join(PREFIXES)) | text.rlike("[A-Za-z0-9]{20}")
    base = {k: F.transform(v, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k)
            for k, v in base_spans(text).items()}
    loose = F.transform(_spans(text, CANDIDATE, maybe), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), _votes(s).alias("vote"))).alias("loose")
    found = write_and_read(slim.select("doc_id", *base.values(), loose))

    counted = (found.select(F.explode("loose.vote").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
               .collect())  # 27 vote patterns by 18 forms at most
    seen = [(tuple(r["v"][x] for x in LABELERS), r["v"]["size"], r["v"]["mixed"], r["n"]) for r in counted]
    if seen:
        votes: dict[tuple[int, ...], int] = {}
        for v, _, _, n in seen:
            votes[v] = votes.get(v, 0) + n
        post = reliabilities(sorted(votes.items()))[2]
        weight = span_weights([(_inputs(v, s, x), post[v], n) for v, s, x, n in sorted(seen)])

        def accept_span(s: Column) -> Column:
            v, at = s["vote"], iter(weight)
            margin = F.lit(next(at))
            for want in (1, 0):
                for name in LABELERS:
                    margin = margin + F.when(v[name] == want, F.lit(next(at))).otherwise(0.0)
            return margin + v["size"] / 8 * F.lit(next(at)) + v["mixed"] * F.lit(next(at)) >= 0

        accept = F.filter("loose", accept_span)
    else:
        accept = F.col("loose")

    def told(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    plain = F.concat(*[told(k, F.col(k)) for k in BASE])
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(plain, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(plain, told("secret", accept)), ",").alias("spans"))


def op8_weak_pii(spark, sf: str) -> DataFrame:
    return find_pii(read(spark, sf, "documents"))
