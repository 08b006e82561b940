"""Rules as a table against a plain search, and digests of files larger than a block."""

import hashlib
import random

import pytest

from fleetlens.operators import logs, rules
from fleetlens.sources import listing
from tests.conftest import rows


def test_ten_thousand_rules_first_by_order_decides(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB é") for _ in range(n))
    table = [(i, word(rng.choice([6, 7, 8])), f"r{i}", i % 3 == 0, i % 2 == 0) for i in range(10_000)]
    texts = [(word(rng.choice([0, 5, 40, 200])),) for _ in range(80)] + [(None,)]

    def slow(text):
        for _, needle, name, benign, any_case in table:
            if text is not None and (needle.lower() in text.lower() if any_case else needle in text):
                return name, benign
        return None, False

    got = logs.classify_by(spark.createDataFrame(texts, "t string"), "t", spark.createDataFrame(table[::-1], logs.RULES))
    assert sorted(map(repr, ((r["t"], r["error_class"], r["benign"]) for r in got.collect()))) == sorted(
        repr((t, *slow(t))) for t, in texts)


def test_empty_needles_and_too_many_rules(spark):
    df = spark.createDataFrame([("x",), ("y z",)], "t string")
    table = spark.createDataFrame([(2, "", "any", True, False), (1, "Z", "z", False, True)], logs.RULES)
    assert rows(logs.classify_by(df, "t", table), "t", "error_class", "benign") == [("x", "any", True), ("y z", "z", False)]
    assert rows(logs.classify_by(df, "t", table.limit(0)), "error_class", "benign") == [(None, False)] * 2
    with pytest.raises(ValueError):
        logs.classify_by(df, "t", table, most=1)


def test_digests_of_large_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    size = 300 << 20
    with open(tmp_path / "a" / "big", "wb") as f:
        f.truncate(size)
    (tmp_path / "a" / ".small").write_bytes(b"x\xff")
    whole = hashlib.sha256()
    for _ in range(size >> 20):
        whole.update(bytes(1 << 20))
    assert rows(listing.file_digests(spark, str(tmp_path)), "folder", "name", "length", "sha256") == [
        ("a", ".small", 2, hashlib.sha256(b"x\xff").hexdigest()), ("a", "big", size, whole.hexdigest())]


def test_messages_are_not_shuffled_unless_asked_for(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    found = spark.createDataFrame([("a", "R2", "E", "x"), ("a", "R1", "E", "y"), ("a", "R0", "W", "w"), ("b", "R3", "W", "z"), ("q", "R1", "E", "-")],
                                  "name string, rule_id string, severity string, message string")
    out = rules.rollup(found, entities, ("name",))
    assert rows(out) == [("a", 2, 1, False, "R1", "y"), ("b", 0, 1, True, None, None), ("c", 0, 0, True, None, None)]
    plan = out.select("name", "errors", "first_rule")._jdf.queryExecution().optimizedPlan().toString()
    assert all("message" not in x for x in plan.splitlines() if "Aggregate" in x or "Union" in x or "Project" in x)
