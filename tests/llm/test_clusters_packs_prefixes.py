"""Centroid clustering, packing and the prefix trie against brute force, on small tables with all the odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetlens.llm import centroids, packing, prefixes

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, distance string"


# ---------------------------------------------------------------- op11

def slow_clusters(rows, k=8, rounds=10, size=64):
    """(id, cluster, distance) of each kept vector, and centroids, in Python's whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    points = [(i, [math.floor(x * 1024) if abs(x) < 2 ** 53 else int(x) * 1024 for x in v], v) for i, v in kept]
    order = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"3:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[2]))
    centres = [p[1] for p in order[:k]]

    def assign():
        out = []
        for _, v, _ in points:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        placed = assign()
        for j in range(len(centres)):
            mine = [v for (_, v, _), (c, _) in zip(points, placed) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, c, d if d < 2 ** 63 else None) for (i, _, _), (c, d) in zip(points, assign())], centres


def clouds(seed, n, size=64, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, size))
    return [(middles[i % 12] + spread * rng.normal(size=size)).tolist() for i in range(n)]


def check_clusters(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS)
    got, centres = centroids.centroid_clusters(df, **how)
    want, expected = slow_clusters(rows)
    assert got.columns == ["vec_id", "cluster", "distance"]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert centres == expected


@pytest.mark.parametrize("rebase", [(), (0,), (1, 4), (0, 2, 3, 7)])
def test_clusters(spark, rebase):
    rows = list(enumerate(clouds(1, 240))) + list(enumerate(clouds(2, 60, spread=3.0), 1000))
    odd = [(None, rows[3][1]), (None, rows[3][1]), (5, rows[9][1]), (2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]),
           (2003, [1.0] * 63 + [math.nan]), (2004, [math.inf] + [1.0] * 63), (2005, []), (2006, [0.0] * 64)]
    check_clusters(spark, rows + odd + [(7, rows[7][1])] * 40, rebase=rebase)


def test_clusters_of_large_numbers(spark):
    rows = list(enumerate(clouds(3, 40))) + [(90, [1e300] * 64), (91, [-1e300] + [0.0] * 63), (92, [3e5] * 64), (93, [2.0 ** 60] * 64)]
    check_clusters(spark, rows)


def test_few_and_no_vectors(spark):
    check_clusters(spark, [(1, [0.5] * 64), (2, [0.25] * 64), (2, [0.25] * 64)])
    got, centres = centroids.centroid_clusters(spark.createDataFrame([], VECTORS))
    assert got.count() == 0 and centres == []


def test_loosening_bounds_the_drift():
    rng = random.Random(5)
    tightened = 0
    for _ in range(300):
        size = rng.choice([2, 3, 8])
        centre, p, q = ([rng.randrange(-500, 500) for _ in range(size)] for _ in range(3))
        radius = rng.choice([5.0, 100.0, 400.0])
        bound = centroids.loosening(centre, radius, p, q)
        tightened += bound < 0.999 * math.dist(p, q)
        assert bound <= math.dist(p, q) + 1e-9
        for _ in range(60):
            way = np.array([rng.gauss(0, 1) for _ in range(size)])
            x = np.array(centre) + way / np.linalg.norm(way) * radius * rng.choice([1, 1, rng.random()])
            assert np.linalg.norm(x - p) - np.linalg.norm(x - q) <= bound + 1e-6
    assert tightened > 100


def test_settled_vectors_are_not_scanned(spark):
    rows = list(enumerate(clouds(4, 600)))
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    _, centres = centroids.centroid_clusters(df)
    again = centroids.thresholds(centres, centres, [1e4] * 8)
    assert max(again) < 1e-3  # nothing moved: only exact ties stay open


# ---------------------------------------------------------------- op12

@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "größe", "naïve", "x1", "don't", "  ", "\n\n", "日本語", "<|endoftext|>", "🙂", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 300, 3000]))), "len", 5) for i in range(120)]
    rows += [(None, "no id", "", 1), (None, None, None, None), (7, "again", "", 2), (7, "again", "", 2), (8, "a" * 5000, "", 3), (9, " " * 3000, "", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, offset long")


def slow_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow_ids.known = getattr(slow_ids, "known", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return slow_ids.known.encode(text or "", add_special_tokens=False).ids + [0]


def check_packs(found, rows, capacity=1024):
    """Pieces cover each document's ids once, sequences are gapless; gives the share of padding."""
    ids = {t: slow_ids(t) for t in {r["text"] for r in rows}}
    want = Counter((r["doc_id"], len(ids[r["text"]]), at, min(capacity, len(ids[r["text"]]) - at),
                    zlib.crc32(np.array(ids[r["text"]][at:at + capacity], "<u4").tobytes()))
                   for r in rows for at in range(0, len(ids[r["text"]]), capacity))
    assert Counter((p["doc_id"], p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]) for p in found) == want
    sequences = defaultdict(list)
    for p in found:
        sequences[p["sequence_id"]].append((p["offset"], p["length"], p["padded_to"]))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
        target = at if at & (at - 1) == 0 else capacity
        assert {x[2] for x in s} == {target}
        padding += target - at
    return padding / sum(p["length"] for p in found)


def test_packing(spark, texts):
    rows = texts.collect()
    check_packs(packing.pack(texts).collect(), rows)
    check_packs(packing.pack(texts, group=10).collect(), rows)
    carried = packing.pack(texts, with_ids=True).collect()
    check_packs(carried, rows)
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"] for p in carried)


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.choice([0, 1, 2, 3, 17, 64, 200])
        lengths = sorted((rng.randrange(1, 1024) for _ in range(n)), reverse=True)
        sequence, offset, fill = packing.first_fit_decreasing(lengths, 1024)
        room, want = [], []
        for x in lengths:
            at = next((i for i, r in enumerate(room) if r >= x), len(room))
            if at == len(room):
                room.append(1024)
            want.append((at, 1024 - room[at]))
            room[at] -= x
        assert list(zip(sequence, offset)) == want and fill == [1024 - r for r in room]


def test_ranks_give_the_vocabulary_ids():
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x250)] + list(" \n\t'sdmtlre " * 10) + ["日", "🙂", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
        assert packing.encode(text).tolist() + [0] == slow_ids(text)
    for text in ("a" * 399, "a" * 5000, "\n" * 399, " " * 2000, ""):
        assert packing.encode(text).tolist() + [0] == slow_ids(text)


def test_packing_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert check_packs(packing.op12_tournament_packing(spark, sf).collect(), rows) < 0.02


# ---------------------------------------------------------------- op13

def slow_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
    whole = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], digest(x[2], x[3])))] for c, v in convs.items()}
    made = {}
    for c, v in whole.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = (whole.get(c - math.fmod(c, 20), [])[:h] + v[h:]) if rebuild else v
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * words
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(made[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def talk(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in list(range(n)) + [-7, -20, -33, 5_000_000_000_021]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "", None, "ok", "a  b\tc"])))
    rows += [(3, None, "user", "first"), (3, None, "user", "first"), (4, 1, "x", "tie"), (4, 1, "x", "tie"), (4, 1, "y", "tie"),
             (None, 1, "user", "nobody"), (41, 0, "user", "short")]
    for c in (200, 201, 221, 222):  # long copies
        rows += [(c, t, "user", f"turn {t}") for t in range(60)]
    return rows


TURNS = "conv_id long, turn long, role string, text string, n string, key string"


@pytest.mark.parametrize("block", [1, 50, 20_000])
def test_trie(spark, block):
    rows = talk(1, 150)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(5)
    got = prefixes.prefix_trie(spark, *prefixes.rebuilt_sequences(df), block=block)
    assert Counter(map(tuple, got.collect())) == slow_trie(rows)


def test_trie_of_own_sequences(spark):
    rows = talk(2, 60)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    assert Counter(map(tuple, prefixes.prefix_trie(spark, *prefixes.own_sequences(df)).collect())) == slow_trie(rows, rebuild=False)


def test_trie_of_nothing_and_of_turnless(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefixes.prefix_trie(spark, *prefixes.rebuilt_sequences(empty)).count() == 0
    rows = [(c, 0, "user", "hi") for c in range(1, 60) if c % 20]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    assert Counter(map(tuple, prefixes.prefix_trie(spark, *prefixes.rebuilt_sequences(df)).collect())) == slow_trie(rows)


def test_long_digest_goes_in_chunks(spark, monkeypatch):
    ids = random.Random(1).sample(range(-10 ** 6, 10 ** 6), 5000)
    monkeypatch.setattr(prefixes, "CHUNK", 7)
    ends = spark.createDataFrame([("a", c) for c in ids] + [("b", 5)], "key string, c long")
    got = {r["key"]: r["sha"] for r in prefixes.digests(ends).collect()}
    assert got == {"a": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), "b": hashlib.sha256(b"5").hexdigest()}


def test_bands():
    assert prefixes.bands([9, 3, 1, 1], 5) == [(2, 4), (1, 1)]
    assert prefixes.bands([9, 9], 1) == [(2, 2), (1, 1)]
    assert prefixes.bands([], 5) == []
