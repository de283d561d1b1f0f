"""Posting lists, K2-treap and periodic runs against plain versions; their registered queries over the small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.llm import k2_treap, periodic_runs, posting_lists, queries
from wardlake.sources.tables import table

SCHEMA = "doc_id long, text string, runs string, collapsed string, item_id string, rank string, score string, start string, list string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 7) for i, t in rows], SCHEMA).repartition(3)


# --- periodic runs


def plain_runs(words):
    """Every maximal stretch of each period, the smallest period of each interval."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, p, e) for (s, e), p in found.items())


def plain_collapsed(words):
    dropped = {i for s, p, e in plain_runs(words) for i in range(s + p, e)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_against_plain_version():
    rng = random.Random(3)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 6, 40])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        texts.append(texts[0])
        flat, at = np.array(sum(texts, []), np.int64), np.cumsum([0, *map(len, texts)])
        s, e, p = periodic_runs.runs_of(flat, at)
        cut = np.searchsorted(s, at)
        for k, words in enumerate(texts):
            got = [(int(s[i] - at[k]), int(p[i]), int(e[i] - at[k])) for i in range(cut[k], cut[k + 1])]
            assert got == plain_runs(words), words


def test_symbols_hold_the_text():
    """Every symbol occurs at its places, and the exact search without hashes finds the same crossings."""
    rng = np.random.default_rng(2)
    words, at = rng.integers(0, 3, 400), np.array([0, 0, 150, 400])
    symbols = periodic_runs.compress(words, at)
    size = symbols.end - symbols.start
    for k, place in zip(symbols.symbol.tolist(), symbols.at.tolist(), strict=True):
        assert (words[place : place + size[k]] == words[symbols.start[k] : symbols.end[k]]).all()
    parts = (symbols.start, symbols.mid, symbols.end)
    by_hash, by_words = periodic_runs.crossing(words, *parts), periodic_runs._crossing_by_words(words, *parts)
    assert sorted(zip(*map(list, by_hash), strict=True)) == sorted(zip(*map(list, by_words), strict=True))


def test_long_periodic_texts():
    for words, want in ((np.zeros(60_000, np.int64), [(0, 60_000, 1)]), (np.tile(np.arange(30_000), 2), [(0, 60_000, 30_000)])):
        got = periodic_runs.runs_of(words, np.array([0, len(words)]))
        assert [tuple(map(int, r)) for r in zip(*got, strict=True)] == want


def test_runs_of_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ab " * 12), (5, "ab " * 12), (6, "ab " * 11), (7, "x\x0by\x0cz " * 8 + "tail end"), (None, "é ß q " * 9), (8, "a b c d e f g h i j k l " * 2), (9, ("w " * 20 + "v ") * 30), (10, "a" * 200_000 + " b" * 40)]
    got = periodic_runs.with_runs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = words_of(r["text"])
        assert [(a["start"], a["period"], a["start"] + a["length"]) for a in r["runs"]] == plain_runs(words), r["doc_id"]
        assert r["collapsed"] == plain_collapsed(words) and r["rank"] == "clash"
    assert periodic_runs.with_runs(frame(spark, rows).limit(0)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op13_by_plain_version(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    changed = 0
    for i, text in docs.items():
        words, h = words_of(text), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        elif n > 3000:
            continue
        found = plain_runs(words)
        best = min(((s - e, s, p) for s, p, e in found), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(found), *want)
        assert r["runs_sha256"] == sha("".join(f"{s},{e - s},{p}\n" for s, p, e in found)) and r["collapsed_sha256"] == sha(plain_collapsed(words))
    assert changed > 5


# --- K2-treap


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranking(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    holding = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = {}
    for item, terms in asked.items():
        scores = []
        for (i, c), n in zip(counts, sizes, strict=True):
            m = 50 + (50 * n * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out[item] = [(rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


def ranking(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize(("block", "pack"), [(4096, 1 << 20), (7, 1 << 20), (50, 12)])
def test_ranking_against_plain_version(spark, monkeypatch, block, pack):
    monkeypatch.setattr(k2_treap, "BLOCK_DOCS", block)
    monkeypatch.setattr(k2_treap, "PACK_PAIRS", pack)
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(60)] + ["É", "日本", "ÀB", "x9"]
    prose = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 64])]) for _ in range(n))
    docs = [(i, prose(rng.randint(1, 60))) for i in range(150)]
    docs += [(200 + i, "t1 t2 t3 É.x9") for i in range(60)] + [(None, "t1 t2"), (None, None), (300, ""), (301, " -_- "), (150, "t1,T1;t2"), (150, "t1,T1;t2"), (-4, "t1 " * 9000)]
    items = [(1, "T1 t2 É"), (2, ""), (3, None), (4, "nothing_here zzz"), (5, prose(40)), (5, "日本"), (None, "t1"), (6, "x9 t59 t58 ÀB t1 t1 t1")]
    got = ranking(k2_treap.ranked(frame(spark, docs), spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, rank string"), 50))
    want = plain_ranking(docs, items, 50)
    assert got == {i: r for i, r in want.items() if r}


def test_ranking_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert k2_treap.ranked(frame(spark, [(1, "a")]).limit(0), items).count() == 0
    assert k2_treap.ranked(frame(spark, [(1, None), (2, "-")]), items).count() == 0
    assert k2_treap.ranked(frame(spark, [(1, "a")]), items.limit(0)).count() == 0


def test_treap_prunes():
    """A clear winner is found without opening most ranges."""
    rng = np.random.default_rng(4)
    row, column = rng.integers(0, 40, 20_000), rng.integers(0, 4096, 20_000)
    cells = np.unique(row * 4096 + column)
    row, column = np.divmod(cells, 4096)
    value = rng.integers(1, 100, len(cells))
    value[column == 77] = 10_000
    treap = k2_treap.Treap.of(*k2_treap.build(row, column, value))
    opened = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            opened.append(np.size(key))
            return super().__getitem__(key)

    counting = treap._replace(masks=treap.masks.view(Counting))
    best = k2_treap.search(counting, np.arange(20), np.ones(20, np.int64), np.arange(4096), np.ones(4096, np.uint8), 1, k2_treap.NOBODY)
    assert best.ids.tolist() == [77] and sum(opened) < 20 * 600


# --- posting lists


def plain_neighbours(rows, is_query, k):
    """Exact answers: query id -> scores of the k best other ids."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(v)
    out = {}
    for q in filter(is_query, good):
        best = {i: max(sum(a * b for a, b in zip(u, v)) for u in good[q] for v in vs) for i, vs in good.items() if i != q}  # noqa: B905
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def test_neighbours_of_few_and_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf")]), (None, [1.0]), (1, [3.0]), (2, [1.0, 2.0, 5.0]), (3, [1.0, 2.0]), (4, [-1.0, 0.5]), (120, [0.0, 1.0, 1.0]), (120, [2.0]), (5, [])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, list string, score double")
    got = posting_lists.neighbours(df, F.col("vec_id") % 20 == 0, 20)
    want = plain_neighbours(rows, lambda i: i % 20 == 0, 20)
    answers = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        answers.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert answers == want
    assert posting_lists.neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0
    one = df.where("vec_id = 1")
    assert posting_lists.neighbours(one, F.col("vec_id") == 1).count() == 0


def test_neighbours_recall_with_copies_and_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "SAMPLE_ROWS", 500)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 2400)] + 0.6 * rng.normal(size=(2400, 24))
    x[:800] = x[0]  # a third of the rows are one vector
    x[2390:] *= 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = posting_lists.neighbours(df, F.col("vec_id") % 40 == 0, 20).collect()
    answers = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        answers.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 2400, 40):
        score = np.zeros(2400)
        for d in range(24):
            score += x[q, d] * x[:, d]
        order = np.lexsort((np.arange(2400), -score))
        order = order[order != q][:20]
        assert len(answers[q]) == 20 and all(score[i] == s for i, s in answers[q])
        assert answers[q] == sorted(answers[q], key=lambda a: (-a[1], a[0]))
        hits += len({i for i, _ in answers[q]} & set(order.tolist()))
    assert hits / (60 * 20) >= 0.9


def test_op11_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    want = plain_neighbours(rows, lambda i: i % 20 == 0, 20)
    found = {}
    for r in queries.op11_posting_lists(spark, sf).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {i for _, i in w}) for q, w in want.items())
    assert found.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))


def test_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(9)
    sample = rng.normal(size=(3000, 16))
    index = posting_lists.fit(sample, 3000)
    x = index.rows(sample[:200])
    who, far = index.walk(x, 32)
    true = np.sqrt(((x[:, None] - index.centroids[None]) ** 2).sum(axis=2))
    nearest = np.argsort(true, axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(who.tolist(), nearest.tolist(), strict=True)]) > 0.9
    sizes = np.bincount(index.homes(sample)[1])
    assert sizes.max() < 12 * sizes.mean()
