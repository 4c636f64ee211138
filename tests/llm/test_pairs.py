"""N-gram join, embedding near-dedup, top-k search and components against brute force."""
import math
import random

import numpy as np
import pytest
from helpers import components, no_documents, odd_documents, shingle_set
from pyspark.sql import functions as F

from millwright.llm import blocks, crosspoly, ngram_join, topk_search
from millwright.llm.components import connected_components


def brute_links(rows, percent=80):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = []
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    return sets, links


def check_join(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    named = [r for r in rows if r[0] is not None]
    sets, links = brute_links(named)
    part = components(range(len(named)), links)
    least = {}
    for i, p in part.items():
        least[p] = min(least.get(p, named[i][0]), named[i][0])
    degree = [0] * len(named)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    expected = sorted((named[i][0], len(sets[i][1]), least[part[i]], degree[i]) for i in range(len(named)))
    got = [tuple(r) for r in ngram_join.ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert sorted(r for r in got if r[0] is not None) == expected
    assert sorted(r[1:] for r in got if r[0] is None) == sorted((len(shingle_set(t)), None, 0) for i, t in rows if i is None)


def test_join_of_odd_documents(spark):
    check_join(odd_documents(spark).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x")))


def test_join_of_no_documents(spark):
    assert ngram_join.ngram_jaccard_join(no_documents(spark)).count() == 0
    assert ngram_join.one_of_each_group(no_documents(spark)).count() == 0


def test_join_of_many_near_copies_and_a_common_passage(spark, monkeypatch):
    """Blocks, hot shingles and fragments are all in use, with links on either side of the threshold."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "HOT_IN_BATCH", 5)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(20))
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = f"e{rng.randrange(1000)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    rows += [(3000 + i, passage) for i in range(9)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_one_of_each_group_keeps_the_columns(spark):
    docs = odd_documents(spark).withColumn("rank", F.lit(7))
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]


def brute_vectors(rows, threshold=0.93):
    good = [i for i, (v, e, lab) in enumerate(rows) if lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = []
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("hashes", [1, 2])
def test_near_duplicate_vectors(spark, monkeypatch, hashes):
    monkeypatch.setattr(crosspoly, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        center = rng.normal(size=16)
        rows += [[0, (center + 0.28 * rng.normal(size=16)).astype(np.float32).tolist(), g % 2] for _ in range(25)]
    rows += [[0, [1.0] * 16, 0]] * 4 + [[0, None, 0], [0, [0.0] * 16, 0], [0, [float("nan")] + [1.0] * 15, 0], [0, [None] + [1.0] * 15, 1],
             [0, [float("inf")] + [1.0] * 15, 1], [0, [1.0] * 16, None], [0, [], 1], [0, [1.0] * 8, 0], [0, [2.0] * 8, 0]]
    rows = [(500 - i, e, lab) for i, (_, e, lab) in enumerate(rows)]
    links = brute_vectors(rows)
    part = components(range(len(rows)), [])
    ids = [r[0] for r in rows]
    part = components(ids, [(ids[a], ids[b]) for a, b in links])
    degree = dict.fromkeys(ids, 0)
    for a, b in links:
        degree[ids[a]] += 1
        degree[ids[b]] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).withColumn("rep", F.lit(1))
    got = {r["vec_id"]: r for r in crosspoly.near_duplicate_vectors(df, hashes=hashes).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and found >= 0.97 * 2 * len(links)
    assert all(r["n_links"] <= degree[i] for i, r in got.items())
    if found == 2 * len(links):
        assert {i: r["component_id"] for i, r in got.items()} == part
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    empty = spark.createDataFrame([], df.schema)
    assert crosspoly.near_duplicate_vectors(empty).count() == 0


def test_cross_polytope_recall_is_high():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    y = x + noise * np.linalg.norm(x, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True) * math.tan(math.acos(0.9301))
    for hashes, tables in ((1, 8), (2, 16)):
        a, b = (crosspoly.bucket_codes(v, tables, hashes, 2) for v in (x, y))
        met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
        assert met.mean() > 0.97


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    h = crosspoly.hadamard(x)
    np.testing.assert_allclose(np.linalg.norm(h, axis=1), np.linalg.norm(x, axis=1))
    np.testing.assert_allclose(crosspoly.hadamard(h), x, atol=1e-12)


@pytest.mark.parametrize("spread", [1.0, 3e6])
def test_top_k_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk_search, "ROW_BLOCK", 50)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk_search, "STEP", 16)
    rng = np.random.default_rng(5)
    rows = [(int(i), (spread * rng.normal(size=10)).round(1).astype(np.float32).tolist()) for i in range(160)]
    rows += [(i, rows[i - 160][1]) for i in range(160, 200)]                       # ties
    rows += [(200, None), (201, [float("nan")] * 10), (202, [None] * 10), (203, []), (204, [1.0] * 4), (205, [2.0] * 4), (20, rows[20][1]), (33, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in topk_search.top_k(df, df.filter("vec_id % 20 = 0 or vec_id = 204"), 20).collect())
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    expected = []
    for q in sorted({i for i, _ in good}):
        if q % 20 == 0 or q == 204:
            scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for j, u in good if j == q for i, v in good if i != q and len(v) == len(u))
            expected += [(q, k + 1, i, max(-2 ** 63, min(2 ** 63 - 1, -s))) for k, (s, i) in enumerate(scored[:20])]
    expected.sort()
    assert got == expected
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (300, 301), (301, 300)]
    links += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == components(nodes, [(a, b) for a, b in links if a != b])
    assert connected_components(df.limit(0)).count() == 0


def test_paired_blocks_meet_every_pair_once(spark):
    rows = spark.range(100).select(F.col("id").alias("rid"), (F.col("id") >= 90).cast("long").alias("g"))
    out = blocks.paired_blocks(rows, "g", "rid", 12).collect()
    met = {}
    for r in out:
        met.setdefault(r["_block"], []).append(r)
    pairs = []
    for members in met.values():
        cross = members[0]["_left"] != members[0]["_right"]
        pairs += [(a["rid"], b["rid"]) for a in members for b in members if a["rid"] < b["rid"] and (not cross or a["_part"] != b["_part"])]
    assert len(pairs) == len(set(pairs)) == 90 * 89 // 2 + 10 * 9 // 2
