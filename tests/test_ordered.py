"""Sliced scans against plain Python and the plain window, whatever the number of slices."""

import random
from itertools import groupby

import pytest

from fleetlens.operators.ordered import ordered
from tests.conftest import rows


def _data(n=600):
    rng = random.Random(7)
    data = [("hot" if i % 3 == 0 else f"g{i % 11}" if i % 5 else None, i, rng.choice(["a", "b", None]), i % 4)
            for i in range(n)]
    rng.shuffle(data)
    return data


def _slow(data):
    out = []
    by = lambda r: (r[0] is not None, r[0] or "")
    for _, part in groupby(sorted(data, key=lambda r: (by(r), r[1])), key=by):
        part, total = list(part), 0
        for i, (g, at, label, n) in enumerate(part):
            total += n
            before, after = part[i - 1] if i else None, part[i + 1] if i + 1 < len(part) else None
            out.append((g, at, label, n, before and before[2], before and before[1], after and after[2], total, i + 1))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slices", [2, 3, 8, 40, 700])
def test_any_number_of_slices(spark, slices):
    data = _data()
    df = spark.createDataFrame(data, "g string, at int, label string, n int").repartition(5)
    got = ordered(df, ["g"], ["at"], previous={"before": "label", "before_at": "at"}, following={"after": "label"},
                  running={"total": "n"}, rank="rn", slices=slices)
    assert rows(got) == _slow(data)


def test_slices_come_from_the_setting_and_no_job_runs_while_building(spark):
    df = spark.createDataFrame(_data(90), "g string, at int, label string, n int")
    spark.sparkContext.setJobGroup("building", "")
    got = ordered(df, ["g"], ["at"], rank="rn", running={"total": "n"})
    got.explain("formatted")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("", "")
    assert got.count() == 90


def test_a_group_of_all_rows_is_spread(spark):
    df = spark.range(20_000).selectExpr("1 as g", "id as at", "id % 7 as n")
    got = ordered(df, ["g"], ["at"], running={"total": "n"}, rank="rn", slices=16)
    wrong = got.filter("rn <> at + 1 or total <> (at + 1) div 7 * 21 + ((at + 1) % 7) * ((at + 1) % 7 - 1) / 2")
    assert wrong.count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "g string, at int, n int")
    assert ordered(df, ["g"], ["at"], running={"total": "n"}, rank="rn", previous={"p": "n"}).count() == 0
