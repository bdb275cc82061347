"""Collocations, nearest neighbours and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewatch.llm import collocations, learned_partitions, periodic_runs, queries

ODD = "Aé b AÉ x,y;z\tq"


def documents(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string" + more)


# Collocations


def pieces(text):
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, "\n")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in low.split("\n")]


def by_hand(rows, support, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text or ""):
            n[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    f = {x: c for x, c in f.items() if c >= support}
    out = []
    for (lang, ws), a in f.items():
        if len(ws) < 2:
            continue
        if any(g == lang and len(vs) > len(ws) and any(vs[i : i + len(ws)] == ws for i in range(len(vs))) and 100 * c >= 80 * a for (g, vs), c in f.items()):
            continue
        cuts = [(int(Fraction(2_000_000 * a, f[lang, ws[:k]] + f[lang, ws[k:]])), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def test_collocations_equal_brute_force_however_sharded(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "dd", "É", "é", "e f", "G"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "de", None, ""])) for k in range(80)]
    rows += [(1, None, "en"), (None, "", None), (2, ODD, "en"), (3, "a b c dd " * 40, "de"), (3, "a b c dd " * 40, "de")]
    for support, shard in ((3, 64), (9, 500), (30, 1 << 19), (1, 1000)):
        want = by_hand(rows, support, 25)
        got = collocations.collocations(documents(spark, rows).repartition(5), support, 25, shard_words=shard).collect()
        assert sorted(tuple(r) for r in got) == sorted(want), (support, shard)


def test_collocations_of_odd_tables(spark):
    assert collocations.collocations(documents(spark, [])).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, None), (2, "", "en"), (3, "one two", "en")])).collect() == []
    clash = documents(spark, [(1, "x y. " * 40, "en", 7, "p")], ", f long, phrase string")
    (r,) = collocations.collocations(clash, 39, 1).collect()
    assert (r["phrase"], r["a"], r["n"]) == ("x y", 40, 80)
    with pytest.raises(ValueError):
        collocations.collocations(clash, 0)


def test_collocations_scores_of_large_counts_are_exact(spark, monkeypatch):
    big = 5 * 10**15
    table = spark.createDataFrame([("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big + 3), ("en", None, 0, 3 * big)], "lang string, phrase string, k int, f long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: table)
    (r,) = collocations.collocations(table).collect()
    assert r["score"] == 2_000_000 * (big - 1) // (2 * big + 3)


def test_a_full_bitmap_costs_no_result(spark, monkeypatch):
    rows = [(k, f"w{k % 7} w{k % 5} w{k % 3} end", "en") for k in range(400)]
    want = by_hand(rows, 30, 50)
    monkeypatch.setattr(collocations, "_bit", lambda span, low, lang: np.zeros(len(low), np.uint64))
    got = collocations.collocations(documents(spark, rows), 30, 50, shard_words=300).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


# Nearest neighbours


def brute(ids, vectors, queries, top):
    out = {}
    for q, v in queries:
        if v is None or not np.any(v) or not np.isfinite(v).all():
            continue
        found = []
        for i, w in zip(ids, vectors, strict=True):
            if i != q and i is not None and w is not None and len(w) == len(v) and np.isfinite(w).all() and np.any(w):
                found.append((-float(np.dot(v, w) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(w, w))), i))
        out[q] = sorted(found)[:top]
    return out


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]),
            (10, [1.0, 0.0, 0.0]), (11, [2.0**1000, 2.0**1000]), (12, [2.0**-1000, 0.0]), (3, [2.0, 0.0]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<double>, score double, key string")
    got = learned_partitions.nearest_neighbours(df, df, top=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    assert sorted(by) == [0, 1, 2, 3, 11, 12, 13]
    assert sorted(by[0]) == [(1, 3, 1.0), (2, 12, 1.0), (3, 1, 0.707106781)]
    assert sorted(by[1]) == [(1, 2, 1.0), (2, 11, 1.0), (3, 0, 0.707106781)]
    assert sorted(by[13]) == [(1, 1, -0.707106781), (2, 2, -0.707106781), (3, 11, -0.707106781)]
    empty = df.limit(0)
    assert learned_partitions.nearest_neighbours(empty, df).collect() == [] == learned_partitions.nearest_neighbours(df, empty).collect()


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall_of_learned_partitions(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 24))
    if kind == "clusters":
        v = 3 * rng.standard_normal((30, 24))[rng.integers(0, 30, 3000)] + v
    v[1000:1400] = v[1000]  # copies
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = learned_partitions.nearest_neighbours(df, df.where("vec_id % 50 = 0"), part_rows=128).collect()
    want = brute(range(3000), v, [(k, v[k]) for k in range(0, 3000, 50)], 5)
    assert len(got) == 5 * len(want)
    hits = sum(r["score"] >= -want[r["query_id"]][-1][0] - 1e-12 for r in got)
    assert hits >= 0.9 * len(got)
    copies = [(r["rank"], r["vec_id"]) for r in got if r["query_id"] == 1050]
    assert sorted(copies) == [(k + 1, 1000 + k) for k in range(5)]
    assert all(abs(r["score"] - float(np.dot(v[r["query_id"]], v[r["vec_id"]]) / np.linalg.norm(v[r["query_id"]]) / np.linalg.norm(v[r["vec_id"]]))) < 1e-12 for r in got)


def test_clusters_need_few_parts(spark):
    rng = np.random.default_rng(5)
    v = 8 * rng.standard_normal((16, 16))[rng.integers(0, 16, 4096)] + rng.standard_normal((4096, 16))
    nodes = spark.createDataFrame([(str(k).encode(), 16, x.tobytes()) for k, x in enumerate(v)], "key binary, dim int, v binary")
    router = learned_partitions.fit(nodes, 16, 16)
    odds = -np.sort(-router.probabilities(learned_partitions._units(v)), axis=1)
    probed = ((np.cumsum(odds, axis=1) - odds) <= router.mass).sum(axis=1)
    assert probed.mean() < 8


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(6)
    v = learned_partitions._units(6 * rng.standard_normal((8, 12))[np.arange(400) % 8] + rng.standard_normal((400, 12)))
    graph = learned_partitions.nearest(v, np.arange(400))
    label = learned_partitions.partition(graph, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() - sizes.min() <= 2
    assert (label[graph] != label[:, None]).mean() < 0.1
    for parts in (3, 5, 7):
        sizes = np.bincount(learned_partitions.partition(graph, parts), minlength=parts)
        assert sizes.max() - sizes.min() <= 4


def test_blocks_of_a_hot_part(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "BLOCK", 64)
    rng = np.random.default_rng(7)
    v = rng.standard_normal((500, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = learned_partitions.nearest_neighbours(df, df).collect()
    want = brute(range(500), v, list(enumerate(v)), 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted((q, k + 1, i) for q, x in want.items() for k, (_, i) in enumerate(x))


# Periodic runs


def runs_by_hand(w, shortest):
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(shortest, 2 * p):
                best.setdefault((s, i + p - s), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in best.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=6), st.sampled_from([2, 5, 12]))
def test_runs_equal_brute_force(texts, shortest):
    starts = np.cumsum([0, *map(len, texts)])
    found = periodic_runs.runs(np.array([x for t in texts for x in t], np.uint64), starts, shortest)
    for k, t in enumerate(texts):
        assert sorted(tuple(r[1:]) for r in found.tolist() if r[0] == k) == runs_by_hand(t, shortest)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 3)), max_size=6))
def test_runs_of_nested_repeats(parts):
    w = [x for part, times, tail in parts for x in part * times + [2 + tail]]
    found = periodic_runs.runs(np.array(w, np.uint64), np.array([0, len(w)]), 2)
    assert [tuple(r[1:]) for r in found.tolist()] == sorted(runs_by_hand(w, 2), key=lambda r: (r[0], r[2]))


def digests_by_hand(doc_id, text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w] if text else []
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(runs_by_hand(words, 12), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_digests(spark, data):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))), "en") for k in range(150)]
    rows += [(500, None, "en"), (501, "", None), (None, "a b " * 20, "en"), (502, "a b\t\na b " * 30, "en"), (502, "a b\t\na b " * 30, "en"), (503, "x", "en"), (504, "n " * 5000, "en")]
    got = periodic_runs.run_digests(documents(spark, [(*r, 1, "p") for r in rows], ", start long, period string"), plant=True).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted((digests_by_hand(i, t) for i, t, _ in rows), key=key)
    assert sum(r["n_runs"] > 0 for r in got) > 10
    assert periodic_runs.run_digests(documents(spark, [])).collect() == []


def test_run_digests_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, data).collect()}
    short = [r for r in docs if len(r["text"] or "") < 4000]
    assert len(got) == len({r["doc_id"] for r in docs}) and len(short) > 50
    white = str.maketrans("\x0b\x0c\r", "   ")
    for r in short:
        assert got[r["doc_id"]] == digests_by_hand(r["doc_id"], r["text"] and r["text"].translate(white))


def test_find_runs(spark):
    got = periodic_runs.find_runs(documents(spark, [(7, "q " + "a b c " * 6 + "z", "en"), (8, "a b", "en"), (None, "k " * 12, None)])).collect()
    assert sorted(tuple(map(str, r)) for r in got) == [("7", "1", "18", "3"), ("None", "0", "12", "1")]


def test_an_empty_batch_of_runs():
    assert periodic_runs.runs(np.zeros(0, np.uint64), np.array([0])).shape == (0, 4)
    assert pa.table({"x": periodic_runs.dropped(np.zeros((0, 3), np.int64), 3)})["x"].to_pylist() == [False] * 3
