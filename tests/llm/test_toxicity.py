"""The anchored label model on rare toxic rows, noise tokens and repeated ids."""

import random
import zlib

import numpy as np

from fleetlens.llm import toxicity
from tests.llm.test_operators import prose


def _corpus(n=600, rate=0.1):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < rate
        words = prose(i, rng.choice([15, 60, 200])).split() + [f"noise{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]
        if toxic:
            words += rng.sample(["scumbag", "moronic", "filthy", "worthless", "idiotic"], 2)
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_rare_toxic_rows_are_found_and_clean_ones_left_alone(spark):
    docs, labels = _corpus()
    got = toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {d: y for d, _, y in labels}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.97
    assert sum(r["predicted"] for r in held if not truth[r["doc_id"]]) <= 1
    assert sum(r["predicted"] for r in held if truth[r["doc_id"]]) >= 0.8 * sum(truth[r["doc_id"]] for r in held)


def test_an_id_repeated_many_times_changes_nothing(spark):
    docs, labels = _corpus(200, 0.3)
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    many = plain.unionByName(spark.range(20_000).selectExpr("3l as doc_id").join(plain, "doc_id"))
    one, other = toxicity.train(plain, marks), toxicity.train(many, marks)
    assert one.index == other.index and np.allclose(one.linear.margin(np.eye(len(one.index) + toxicity.PATTERNS)), other.linear.margin(
        np.eye(len(one.index) + toxicity.PATTERNS)))


def test_labels_hold_the_share_of_toxic_rows():
    rng = np.random.default_rng(1)
    labels = (rng.random(2000) < 0.05).astype(int)
    good = np.where(rng.random((2000, 3)) < 0.9, labels[:, None], 1 - labels[:, None])
    noise = (rng.random((2000, 6)) < 0.5).astype(int) * rng.integers(0, 2, 2000)[:, None]  # votes that split the rows otherwise
    model = toxicity.LabelModel.fit(np.hstack([good, noise]), labels)
    assert abs(model.prior - labels.mean()) < 0.02
    assert ((model.posterior(np.hstack([good, noise]), labels) > 0.5) == labels).mean() > 0.99


def test_one_class_and_nothing(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.classify(docs, labels).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
