"""Periodic runs, hard negatives and language identification against brute force, and on odd inputs."""
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, no_documents, odd_documents

from millwright.llm import hard_negatives, language_id, periodic_runs, queries
from oracle import canon

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Every lag, every stretch of matches; of equal stretches the smallest period."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - first + q >= max(12, 2 * q):
                out.setdefault((first - q, i), q)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or n == 0:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(doc_id, text):
    w = planted(doc_id, WORDS.findall(text or ""))
    runs = brute_runs(w)
    kept = [True] * len(w)
    for s, n, q in runs:
        kept[s + q:s + n] = [False] * (n - q)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best if best else (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for x, k in zip(w, kept) if k).encode()).hexdigest())


def test_runs_of_random_sequences_equal_brute_force():
    rng = random.Random(11)
    found = 0
    for _ in range(1500):
        n, k = rng.choice([0, 1, 11, 12, 13, 30, 60, 120, 250]), rng.choice([1, 2, 2, 3, 5])
        w = []
        while len(w) < n:
            p = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 7, 13, 14, 26, 40]))]
            w += p * rng.choice([1, 2, 2, 3, 5, 20]) + p[:rng.randrange(len(p) + 1)]
            if rng.random() < 0.3:
                w += w[-rng.randrange(1, 40):]
        w = w[:n]
        expected = brute_runs(w)
        found += len(expected)
        assert periodic_runs.find_runs(np.array(w, np.int64)) == expected, w
    assert found > 1500
    a, b = [0], [1]
    while len(b) < 400:                          # a Fibonacci word has runs of many periods at once
        a, b = b, b + a
    assert periodic_runs.find_runs(np.array(b, np.int64)) == brute_runs(b)


def test_runs_take_few_steps_on_long_monotone_texts(monkeypatch):
    """Diagonals opened on texts of one word, and of long stretches of it, stay few per word."""
    for w in ([0] * 30000, ([0] * 1000 + [1]) * 20, list(range(3000)) * 10):
        w = np.array(w, np.int64)
        opened = periodic_runs._short_openings(w) + periodic_runs._long_openings(w, np.zeros(len(w), np.int64))
        assert sum(len(x) for x, _ in opened) <= 8 * len(w)


def test_registered_runs_equal_brute_force(spark):
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {digests(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 20000}
    assert len(got) == len(docs) and expected <= got and len(expected) > 190
    assert sum(r[1] > 0 for r in expected) > 10


def test_runs_of_odd_documents(spark):
    odd = odd_documents(spark).selectExpr("*", "'x' AS runs", "1 AS collapsed", "2 AS _n")
    rows = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(odd.drop("_n"))), "doc_id").collect()
    expected = [digests(r["doc_id"], r["text"]) for r in odd.collect()]
    assert canon([tuple(r) for r in rows], rows[0].__fields__) == canon(expected, rows[0].__fields__)
    assert periodic_runs.periodic_runs(no_documents(spark)).count() == 0
    assert periodic_runs.periodic_runs(odd).columns == [*odd.drop("runs", "collapsed").columns, "runs", "collapsed"]


# --------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, anchors, k_pos=5, k_neg=10, scale=256):
    def ok(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])
    clean = lambda rs: [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], y) for i, v, y in rs if ok((i, v, y))]
    pool, out = clean(rows), []
    for i, v, y in clean(anchors):
        scored = sorted((-sum(a * b for a, b in zip(v, u)), j, z) for j, u, z in pool if j != i and len(u) == len(v))
        positives = [(j, -s) for s, j, z in scored if z == y][:k_pos]
        for j, p in positives:
            fit = [(n, -s) for s, n, z in scored if z != y and 30 * p <= -100 * s <= 90 * p][:k_neg]
            out += [(i, j, r + 1, n, p, s) for r, (n, s) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [None, (3, 7, 5)])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    """Ties, copies, a hot label, odd vectors; also with several blocks of anchors and parts of rows."""
    if blocks:
        for name, value in zip(("ANCHOR_BLOCK", "ROW_PART", "SMALL_PART"), blocks):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):
        v = (rng.normal(size=6) + 0.8).round(1).astype(np.float32).tolist()
        rows.append((i, v, 0 if i % 3 == 0 else int(rng.integers(0, 4))))
    rows += [(200 + i, rows[10][1], 1 + i % 2) for i in range(25)]          # one common vector
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1),
             (304, [], 1), (305, [1.0, 2.0], 1), (306, [1.0] * 6, None), (None, [1.0] * 6, 1), rows[5], rows[20], rows[20], (7, [2.0] * 6, 3)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS _a", "'x' AS score")
    anchors = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(frame, frame.filter("vec_id % 10 = 0")).collect())
    expected = brute_negatives(rows, anchors)
    assert got == expected and len(expected) > 300


def test_negatives_of_no_rows_and_large_numbers(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine_hard_negatives(none, none).count() == 0
    rows = [(0, [3e5, 3e5], 0), (1, [2.9e5, 3e5], 0), (2, [2e5, 2e5], 1), (3, [1e5, 1e5], 1), (4, [3e8, 1.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS)
    one = frame.filter("vec_id = 0")
    assert sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(frame, one).collect()) == brute_negatives(rows, rows[:1])


def test_negatives_are_sorted_in_the_shuffle_and_streamed(spark):
    """One exchange by anchor, a sort inside it and no window over the pairs of an anchor after it."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    plan = hard_negatives.mine_hard_negatives(rows, rows.filter("vec_id % 100 = 0"))._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("\n")
    assert "MapInArrow" in top[0] and "Sort" in top[1] and "_minus" in top[1] and "RepartitionByExpression" in top[2]


# --------------------------------------------------------------------------------------------------
def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op13_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] is not None]
    assert len(held) > 100 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    accepted = [r for r in held if r["accepted"]]
    assert len(accepted) > 0.9 * len(held)


def test_language_ignores_lang_source_and_id_of_a_scored_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train_language(docs)
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_language(docs, model).collect()}
    changed = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'zz' AS lang", "null AS source", "n_chars")
    b = {r["doc_id"] - 1000000: (r["lang_pred"], r["score"]) for r in language_id.identify_language(changed, model).collect()}
    assert a == b


def test_language_learns_only_from_training_rows(spark):
    """Held-out rows, and rows without language or letters, change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [(i, "ωωω φφφ χχχ " * 20, "el", "s", 1) for i in range(5000, 5400) if zlib.crc32(str(i).encode()) % 5 == 0]
    out += [(6000, "12 34 !!", "zz", "s", 1), (6001, None, "zz", "s", 1), (6002, "words of none", None, "s", 1)]
    more = docs.unionByName(spark.createDataFrame(out, DOCS))
    one, two = language_id.train_language(docs), language_id.train_language(more)
    assert one.languages == two.languages and np.array_equal(one.logits, two.logits) and one.threshold == two.threshold


def test_language_of_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train_language(docs)
    odd = odd_documents(spark).selectExpr("*", "'x' AS lang_pred", "1 AS score")
    rows = language_id.identify_language(odd, model, keep=("doc_id", "text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und" and r["score"] == 0 and not r["accepted"]) if not letters else (r["lang_pred"] in model.languages and 0 < r["score"] <= 1)
    assert language_id.identify_language(no_documents(spark), model).count() == 0
    nothing = language_id.train_language(no_documents(spark))
    assert {r["lang_pred"] for r in language_id.identify_language(odd, nothing).collect()} == {"und"}


def test_subwords_equal_a_plain_count():
    texts = ["The  Straße, 12 x", "", "ÀB", None, "a", "!!", "日本 語"]
    grams, letters = language_id.subwords(pa.array(texts))
    sizes = dict(zip(language_id.NGRAMS, grams))
    for k, t in enumerate(texts):
        low = "".join(c.lower() if c.isalpha() else " " for c in t or "")
        for n in language_id.NGRAMS:
            expected = sum(max(0, len(w) + 2 - n + 1) for w in low.split())
            assert int((sizes[n][0] == k).sum()) == expected, (t, n)
    assert letters.tolist() == [True, False, True, False, True, False, True]


def test_calibration_bounds_the_error():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 600)
    z = rng.normal(size=(600, 3)) * 0.7
    z[np.arange(600), labels] += 1.2
    t, least = language_id.calibrate(z, labels, 0.05)
    p = language_id._softmax(z / t)
    accepted = p.max(axis=1) >= least
    assert accepted.any() and (p.argmax(axis=1) != labels)[accepted].mean() <= 0.05
    assert (p.argmax(axis=1) != labels).mean() > 0.05
