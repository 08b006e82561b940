"""Quality by co-training: a text view and a page-metadata view teach each other.

Features of both views are made in tasks.  A bounded sample of labelled rows
and a bounded pool of unlabelled ones come to the driver as short number rows;
there two linear classifiers exchange confident pseudo-labels over rounds and
are calibrated on labelled rows kept aside.  All documents are then scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import free_name, read, small_batches

#: Bounds of what is gathered for fitting; scoring covers all rows.
LABELLED, POOL = 6_000, 6_000
ROUNDS, TAKE = 4, 200
SOURCES, LANGS = 32, 8

# Character classes of the text view: letters, digits, each ASCII sign, white space, other bytes.
_CLASS = np.full(256, 3, np.int64)
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_SIGNS] = np.arange(5, 5 + len(_SIGNS))
CLASSES = 5 + len(_SIGNS)
TEXT_DIM, META_DIM = CLASSES + 10, SOURCES + LANGS + 9


def text_view(text: str) -> np.ndarray:
    """What the words look like: shares of character classes, word lengths, repetition, case."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(TEXT_DIM, np.float32)
    if not raw.strip():
        out[-1] = 1
        return out
    out[:CLASSES] = np.sqrt(np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES) / len(raw))
    words = raw.split()
    n = len(words)
    kinds = set(words)
    size = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(w.endswith((b".", b"!", b"?")) for w in kinds)
    out[CLASSES:-1] = (np.log(n), size.mean() / 10, size.std() / 10, len(kinds) / n, len(kinds) / np.sqrt(n) / 10,
                       1 - len(set(lines)) / max(1, len(lines)), ends / len(kinds),
                       sum(w.isupper() for w in kinds) / len(kinds), (size == 1).mean())
    return out


def meta_view(text: str, source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """What the page record says: origin, language, recorded length, layout of lines."""
    out = np.zeros(META_DIM, np.float32)
    out[zlib.crc32(str(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(str(lang).encode()) % LANGS] = 1
    known = n_chars is not None and n_chars == n_chars
    size = float(n_chars) if known and n_chars > 0 else 0.0
    lines = text.split("\n")
    width = np.fromiter(map(len, lines), np.int64, len(lines))
    filled = width[width > 0]
    mean = filled.mean() if len(filled) else 0.0
    out[SOURCES + LANGS:] = (not known, np.log1p(size) / 5, np.log1p(len(lines)) / 5, np.log1p(mean) / 5,
                             (filled.std() / mean if mean else 0.0), text.count(" ") / (len(text) + 1) * 5,
                             np.log1p(text.count("|") + text.count("\t")) / 5, np.log1p(text.count("!")) / 5,
                             size / (len(text) + 1) if known else 0.0)
    return out


def views(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    texts = [t if isinstance(t, str) else "" for t in batch["text"]]
    content = np.stack([text_view(t) for t in texts]) if texts else np.zeros((0, TEXT_DIM), np.float32)
    meta = (np.stack([meta_view(t, s, la, n) for t, s, la, n in
                      zip(texts, batch["source"], batch["lang"], batch["n_chars"])])
            if texts else np.zeros((0, META_DIM), np.float32))
    return content, meta


@dataclass
class Linear:
    """Logistic regression on standardised features, ridge 1, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1.0) -> Linear:
        x = x.astype(np.float64)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-6] = 1.0
        z = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
        w = np.ones(len(x)) if w is None else w
        beta, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            gradient = z.T @ (w * (p - y)) + penalty * beta
            hessian = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            beta -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, beta)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -6, 6)
        return z @ self.weight[:-1] + self.weight[-1]


@dataclass
class CoTrained:
    text: Linear
    meta: Linear
    joint: Linear

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probability of good quality from both calibrated views."""
        both = np.stack([self.text.margin(content), self.meta.margin(meta)], axis=1)
        return 1 / (1 + np.exp(-np.clip(self.joint.margin(both), -30, 30)))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pt: np.ndarray, pm: np.ndarray,
             rounds: int = ROUNDS, take: int = TAKE) -> CoTrained:
    """Fit both views.  xt, xm, y: labelled rows; pt, pm: the pool.

    Every fourth labelled row is kept for calibration.  In a round each view
    labels the pool rows it is surest of, in the classes' ratio, for the other.
    """
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    base_t, base_m, base_y = xt[~held], xm[~held], y[~held].astype(float)
    share = base_y.mean()
    told: list[dict[int, float]] = [{}, {}]  # pseudo-labels for the text view and the metadata view
    model = [Linear.fit(base_t, base_y), Linear.fit(base_m, base_y)]
    for _ in range(rounds if len(pt) and 0 < share < 1 else 0):
        for view, pool in ((0, pt), (1, pm)):
            margin = model[view].margin(pool)
            order = np.argsort(margin, kind="stable")
            fresh = [i for i in order if i not in told[1 - view]]
            low = [i for i in fresh[:max(1, round(take * (1 - share)))] if margin[i] < -2]
            high = [i for i in fresh[-max(1, round(take * share)):] if margin[i] > 2]
            told[1 - view] |= {i: 0.0 for i in low} | {i: 1.0 for i in high}
        for view, base, pool in ((0, base_t, pt), (1, base_m, pm)):
            ids = np.array(sorted(told[view]), np.int64)
            marks = np.array([told[view][i] for i in ids.tolist()])
            model[view] = Linear.fit(np.vstack([base, pool[ids]]), np.append(base_y, marks),
                                     np.append(np.ones(len(base)), np.full(len(ids), 0.5)))
    calm = held if held.any() else ~held
    both = np.stack([model[0].margin(xt[calm]), model[1].margin(xm[calm])], axis=1)
    return CoTrained(model[0], model[1], Linear.fit(both, y[calm].astype(float), ridge=0.5))


def _gather(docs: DataFrame, ids: DataFrame) -> pd.DataFrame:
    """Features of a bounded set of ids; one row an id, sorted by it."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content, meta = views(b)
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "c": list(content), "m": list(meta)})

    picked = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(ids), "doc_id")
    got = picked.mapInPandas(make, "doc_id long, y int, c array<float>, m array<float>").toPandas()
    return got.drop_duplicates("doc_id").sort_values("doc_id", key=lambda s: s.map(lambda i: zlib.crc32(str(i).encode())))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained | None:
    """A model, or None where no labelled row (or only one class) is found.

    Fitted on at most ``labelled`` labelled ids and ``pool`` other ids, the
    smallest by hash; both sets are broadcast, as their bound is fixed.
    """
    by_hash = F.xxhash64(F.lit("quality"), "doc_id")
    truth = (labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("y")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    known = truth.orderBy(by_hash, "doc_id").limit(labelled)
    other = (docs.select("doc_id").filter("doc_id is not null").distinct().join(truth, "doc_id", "left_anti")
             .orderBy(by_hash, "doc_id").limit(pool).withColumn("y", F.lit(-1)))
    rows = _gather(docs, known.unionByName(other))
    if rows.empty:
        return None
    content, meta, y = np.stack(rows["c"].to_list()), np.stack(rows["m"].to_list()), rows["y"].to_numpy()
    sure, rest = y >= 0, y < 0
    if len(set(y[sure])) < 2:
        return None
    return co_train(content[sure], meta[sure], y[sure], content[rest], meta[rest])


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """docs with ``quality_score`` (probability of good quality) added; 1 for all without a model."""
    name = free_name(docs, "quality_score")
    if model is None:
        return docs.withColumn(name, F.lit(1.0))
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def rate(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series(model.score(*views(pd.DataFrame({"text": text, "source": source, "lang": lang, "n_chars": n_chars}))))

    return docs.withColumn(name, rate("text", "source", "lang", F.col("n_chars").cast("double")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, quality_score, keep (score at least ``threshold``).

    Missing and empty texts are scored as empty text, missing source, language
    or length as a value of their own; repeated rows are scored alike; other
    columns are ignored.
    """
    slim = docs.select("doc_id", "text", "source", "lang", "n_chars")
    scored = score(slim, train(slim, labels))
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier accepts, columns as they were."""
    columns, scored = docs.columns, score(docs, train(docs, labels))
    return scored.filter(F.col(scored.columns[-1]) >= threshold).select(*columns)


def op6_cotrained_quality(spark, sf: str) -> DataFrame:
    return classify(read(spark, sf, "documents"), read(spark, sf, "labels"))
