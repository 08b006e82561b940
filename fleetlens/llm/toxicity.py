"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Lexicons are mined from labelled training rows.  Slices of them and text
patterns vote on each sampled document.  A generative model estimates how
accurate the voters are and how they correlate, and gives every document a
posterior.  A linear classifier learned on the posteriors scores all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import read, small_batches, write_and_read
from fleetlens.llm.quality import Linear

#: Bound of the labelled rows used for fitting (smallest by hash), and of the tokens kept as features.
SAMPLE, TOKENS = 8_000, 400
SLICES = 8
FOLDS = 5
#: How often a given label is taken to be right, and how significant a token's odds have to be.
LABELS_RIGHT, SIGNIFICANT = 0.99, 3.0
_WORD = re.compile(r"[^\W\d_]+")
_PREFIX = 5
PATTERNS = 5


def tokens(text: str) -> set[str]:
    """Lower-case words, and with a star the first five letters of longer ones."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:_PREFIX] + "*" for w in words if len(w) > _PREFIX}


def features(text: str, index: dict[str, int]) -> np.ndarray:
    """For each known token 1 if it occurs, then patterns: shares and forms of the text."""
    out = np.zeros(len(index) + PATTERNS, np.float32)
    words = _WORD.findall(text.lower())
    hits = 0
    for w in words:
        for t in (w, w[:_PREFIX] + "*") if len(w) > _PREFIX else (w,):
            at = index.get(t)
            if at is not None:
                out[at] = 1
                hits += t[-1] != "*"
    n = max(1, len(words))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    capitals = np.count_nonzero((raw >= ord("A")) & (raw <= ord("Z")))
    out[len(index):] = (np.log1p(hits), np.sqrt(hits / n), np.log1p(len(words)) / 5, text.count("!") / n,
                        capitals / max(1, len(raw)))
    return out


@dataclass
class LabelModel:
    """Voters that are right with class-wise rates, correlated voters weighed down."""

    rates: np.ndarray  # voter, class, vote (0 clean, 1 toxic, 2 abstain)
    weight: np.ndarray
    prior: float
    correlation: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> LabelModel:
        """Expectation-maximisation in which each row's label is one more voter, of known reliability.

        Rates and the share of toxic rows are so held to the labelled rows and
        cannot drift to whatever else splits the votes.
        """
        n, m = votes.shape
        shown = np.stack([votes == v for v in range(3)], axis=2).astype(float)
        post, weight, corr = np.where(labels == 1, LABELS_RIGHT, 1 - LABELS_RIGHT), np.ones(m), np.eye(m)
        for turn in range(rounds):
            by_class = np.stack([1 - post, post])
            rates = (np.einsum("cn,nmv->mcv", by_class, shown) + 0.5) / (by_class.sum(axis=1)[None, :, None] + 1.5)
            prior = min(max(post.mean(), 1e-3), 1 - 1e-3)
            if turn % 5 == 0:  # correlations of what the classes leave unexplained
                toxic = (votes == 1).astype(float)
                rest = toxic - (by_class[0][:, None] * rates[None, :, 0, 1] + by_class[1][:, None] * rates[None, :, 1, 1])
                size = np.sqrt((rest ** 2).mean(axis=0)) + 1e-9
                corr = (rest.T @ rest) / n / np.outer(size, size)
                weight = 1 / (1 + np.clip(np.abs(corr) - 0.1, 0, 1).sum(axis=1) - 0.9)
            weight = np.where(rates[:, 1, 1] > rates[:, 0, 1], weight, 0.0)  # no better than chance: no say
            post = cls(rates, weight, prior, corr).posterior(votes, labels)
        return cls(rates, weight, prior, corr)

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Probability of toxic by the voters, and by the labels where given."""
        odds = np.log(self.rates[:, 1] / self.rates[:, 0])  # voter, vote
        margin = (odds[np.arange(len(self.weight)), votes] * self.weight).sum(axis=1)
        if labels is not None:
            margin = margin + np.where(labels == 1, 1, -1) * np.log(LABELS_RIGHT / (1 - LABELS_RIGHT))
        return 1 / (1 + np.exp(-np.clip(margin + np.log(self.prior / (1 - self.prior)), -30, 30)))


def cast_votes(x: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Votes of lexicon slices and patterns (0 clean, 1 toxic, 2 abstain) on feature rows."""
    known = len(strength)
    shown, toxic, clean = x[:, :known] > 0, strength > 0, strength < 0
    out = []
    for s in range(SLICES):
        mine = np.zeros(known, bool)
        mine[s::SLICES] = True
        bad, good = shown[:, mine & toxic].sum(axis=1), shown[:, mine & clean].any(axis=1)
        out.append(np.where(bad > 0, 1, np.where(good, 0, 2)))
    bad = shown[:, toxic].sum(axis=1)
    share = x[:, known + 1] ** 2
    out += [np.where(bad >= 2, 1, np.where(bad == 0, 0, 2)), np.where(bad >= 4, 1, 2), np.where(bad == 0, 0, 2),
            np.where(share > 0.03, 1, np.where(share == 0, 0, 2)), np.where(shown[:, clean].sum(axis=1) > bad, 0, 2)]
    return np.stack(out, axis=1)


@dataclass
class Model:
    index: dict[str, int]
    labels: LabelModel
    linear: Linear

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.stack([features(t, self.index) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.linear.margin(x), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model | None:
    """A model from at most ``sample`` labelled rows outside the held-out fold; None without both classes.

    Tokens are counted over the whole sample by Spark; a bounded list of them
    and one feature row a document come to the driver.
    """
    by_hash = F.xxhash64(F.lit("toxic"), "doc_id")
    ids = (labels.filter("doc_id is not null and toxic in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
           .join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(by_hash, "doc_id").limit(sample))
    # one row an id, whatever the table repeats, so that ``sample`` bounds all that follows
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = write_and_read(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(one))
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sorted(tokens(t)) if isinstance(t, str) else [] for t in b["text"]]
            yield pd.DataFrame({"y": b["y"].repeat([len(f) for f in found]).to_numpy(), "t": [t for f in found for t in f]})

    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return None
    counts = rows.mapInPandas(cut, "y int, t string").groupBy("t").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    in_toxic, in_clean = (F.col("a") + 0.5) / (size[1] + 1), (F.col("n") - F.col("a") + 0.5) / (size[0] + 1)
    odds = F.log(in_toxic / in_clean)
    # odds against their own spread: a token seen a few times says little
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("n") - F.col("a") + 0.5))
    scored = counts.filter("n >= 3").select("t", odds.alias("odds"), (odds / spread).alias("z"))
    toxic = scored.filter((F.col("z") > SIGNIFICANT) & (F.col("odds") > 1.5)).orderBy(F.desc("z"), "t").limit(TOKENS * 3 // 4).collect()
    clean = scored.filter((F.col("z") < -SIGNIFICANT) & (F.col("odds") < -0.7)).orderBy("z", "t").limit(TOKENS // 4).collect()
    listed = [*toxic, *clean]
    index = {r["t"]: i for i, r in enumerate(listed)}
    strength = np.array([r["odds"] for r in listed])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [features(t if isinstance(t, str) else "", index) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": x})

    got = rows.mapInPandas(vectors, "doc_id long, y int, x array<float>").toPandas()
    got = got.sort_values("doc_id")
    x, y = np.stack(got["x"].to_list()), got["y"].to_numpy()
    votes = cast_votes(x, strength)
    model = LabelModel.fit(votes, y)
    posterior = model.posterior(votes, y)
    return Model(index, model, Linear.fit(x, posterior, ridge=3.0))


def score(docs: DataFrame, model: Model | None, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        return pd.Series(model.score([t if isinstance(t, str) else "" for t in text]))

    value = F.lit(0.0) if model is None else rate("text")
    scored = docs.select("doc_id", "text").select("doc_id", value.alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document; only words of the text are inputs.

    Missing and empty texts are scored like a text without words; repeated rows
    alike; of several texts under one labelled id the one of smallest hash is
    learned from.  A missing doc_id is not held out.  Without labels of both classes
    outside the held-out fold every score is 0.  Other columns are ignored.
    """
    return score(docs, train(docs.select("doc_id", "text"), labels))


def op10_weak_toxicity(spark, sf: str) -> DataFrame:
    return classify(read(spark, sf, "documents"), read(spark, sf, "labels"))
