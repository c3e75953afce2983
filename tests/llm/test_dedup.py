"""Exact and near duplicates against brute force, with collisions, nulls, ties and hot groups."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewire.llm import near_dedup as nd
from tidewire.llm.components import components
from tidewire.llm.exact_dedup import exact_dedup, exact_groups
from tidewire.llm.shared import Workspace
from tidewire.llm.wordhash import ngrams, shingle_sets, texts_words

SCHEMA = "doc_id long, text string, h string, n string, bucket string, lang string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "en") for i, t in rows], SCHEMA)


def plain_groups(rows, keep):
    out = {}
    for i, t in rows:
        own = [j for j, u in rows if (u or "") == (t or "") and j is not None]
        k = (min if keep == "min" else max)(own) if own else None
        out.setdefault(i, set()).add((k, sum((u or "") == (t or "") for _, u in rows), k is None or i == k))
    return out


ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c"), (6, "a b "), (7, "word " * 30_000), (8, "word " * 30_000), (None, "c"), (None, "alone"), (None, "alone"), (9, "é"), (10, "é")] + [(100 + i, "hot") for i in range(60)]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("hashed", [None, lambda c: F.substring(F.unhex(F.md5(c)), 1, 0), lambda c: F.length(c) % 3])
def test_exact_groups(spark, keep, hashed):
    got = {}
    for r in exact_groups(frame(spark, ROWS), keep=keep, **({"hash_fn": hashed} if hashed else {})).collect():
        got.setdefault(r["doc_id"], set()).add((r["keep_id"], r["group_size"], r["kept"]))
    assert got == plain_groups(ROWS, keep)


def test_exact_dedup_keeps_columns_and_one_of_each(spark):
    out = exact_dedup(frame(spark, ROWS), keep="max")
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    ids = sorted((r["doc_id"] for r in out.collect()), key=lambda x: (x is None, x or 0))
    assert ids == [2, 4, 5, 6, 8, 9, 10, 159, None, None]
    assert exact_groups(frame(spark, [])).count() == 0


def plain_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def plain_components(rows, percent=85):
    sets = {i: plain_set(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                    low = min(label[a], label[b])
                    changed = True
                    label[a] = label[b] = low
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def near_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(50, " ".join(base))]
    for i in range(40):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy).title() if i % 7 == 0 else "\n".join(copy)))
    rows += [(60 + i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 4, 5, 6, 90])))) for i in range(25)]
    rows += [(90, "one two"), (91, "ONE  two\n"), (92, "one two three"), (93, ""), (94, None), (95, " \t "), (96, "a b c d e"), (97, "a b c d f"), (98, "x " * 40_000)]
    return rows


def test_near_groups_match_brute_force(spark):
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_groups(frame(spark, rows)).collect()}
    assert got == plain_components(rows)


def test_near_dedup_keeps_columns_and_rows_without_id(spark):
    out = nd.near_dedup(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "")]))
    assert {r["doc_id"] for r in out.collect()} == {1, 3, None} and out.columns[0] == "doc_id"
    assert nd.near_groups(frame(spark, [])).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.75, 0.85, 0.95):
        off = []
        for _ in range(20):
            n = 600
            k = round(n * 2 * j / (1 + j))
            all_ = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = nd.minhash(all_[:n]), nd.minhash(all_[n - k : 2 * n - k])
            x = (nd.odd_sketch(a) ^ nd.odd_sketch(b)).view(np.uint64)
            differ = sum(int(v).bit_count() for v in x)
            bits = nd.SKETCH_WORDS * 64
            off.append(1 + bits / (4 * nd.SAMPLES) * np.log(1 - 2 * differ / bits) - j)
        assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.02
    assert 100 < nd.most_differing_bits() < 400


def test_words_and_shingles():
    t = ["Hello\tWORLD\x0b é É", "", "   ", "hello world é é", "a\x0cb\x0dc"]
    w = texts_words(t)
    assert [len(x) for x in w] == [4, 0, 0, 4, 3]
    assert w[0][:3].tolist() == w[3][:3].tolist() and w[0][3] != w[3][3]  # only A-Z is lower-cased
    assert len(ngrams(w[0], 5)) == 1 and len(shingle_sets(["a b c d e f a b c d e f"])[0]) == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (500, 400)] + [(1000, 1001 + i) for i in range(50)]
    got = {r["doc_id"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == 100 and got[500] == 400 and got[1050] == 1000
    assert components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "t")).count() == 0


def test_components_of_a_star_with_a_hot_hub(spark):
    """A hub of 100,000 edges and a chain over some of its ends; the hub's edges are joined by broadcast, not in one task."""
    n = 100_000
    star = spark.range(1, n + 1).select(F.lit(7_000_000).alias("u"), (F.col("id") * 3).alias("v"))
    chain = spark.range(0, 200).select((F.col("id") + 8_000_000).alias("u"), (F.col("id") + 8_000_001).alias("v"))
    edges = star.unionByName(chain).unionByName(spark.createDataFrame([(3, 8_000_000), (9_000_000, 9_000_001), (5, 5), (None, 3), (3, 8_000_000)], "u long, v long"))
    found = components(edges, Workspace(spark, "star"))
    assert found.groupBy("label").count().orderBy("label").collect() == [(3, n + 1 + 201), (9_000_000, 2)]
    assert found.count() == found.select("doc_id").distinct().count()


def template_rows(n, keep, seed=3):
    """Texts that share most of their words, in one order, and are not near duplicates of one another; a few copies."""
    rng = random.Random(seed)
    frame_ = [f"t{k}" for k in range(200)]
    rows = []
    for i in range(n):
        own = [w if (k // 10) % 10 < keep else f"o{i}x{k}" for k, w in enumerate(frame_)]
        rows.append((i, " ".join(own)))
    for i in range(n, n + n // 10):
        t = rows[rng.randrange(n)][1].split()
        t[rng.randrange(len(t))] = f"c{i}"
        rows.append((i, " ".join(t)))
    return rows


def plain_links(rows, percent):
    """Classes by sets of fingerprints, all pairs."""
    sets = shingle_sets([t for _, t in rows])
    label = {i: i for i, _ in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                label[y] = x
    return {i: top(i) for i, _ in rows}


@pytest.mark.parametrize("slice_", [16, 2048])
def test_large_buckets_of_texts_that_are_near_but_not_linked(spark, monkeypatch, slice_):
    monkeypatch.setattr(nd, "SLICE", slice_)
    rows = template_rows(250, 8)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_groups(frame(spark, rows)).collect()}
    want = plain_links(rows, 85)
    assert got == want and len(set(want.values())) == 250


def test_slices_share_the_comparisons_of_a_bucket(spark, monkeypatch):
    """Every member outside the largest class meets every other once, in tasks of bounded work."""
    monkeypatch.setattr(nd, "SLICE", 8)
    class Counting:
        percent, work = 85, Workspace(spark, "counting")

        def sketched(self, prefix):
            ids = spark.range(100).withColumnRenamed("id", "doc_id").withColumn(f"{prefix}n", F.lit(100))
            return ids.select("*", *(F.lit(0).cast("long").alias(f"{prefix}{c}") for c in nd._SKETCH))

        def screen(self, a, b):
            return F.lit(True)

    members = spark.createDataFrame([(1, i, 100 if i < 90 else 1000, 9, 0 if i < 30 else i) for i in range(100)], "bucket long, doc_id long, n long, m long, label long").withColumn("size", F.lit(100))
    pairs = {tuple(r) for r in nd._across(Counting(), members).collect()}
    # 30 of one class and 60 alone of one size; 10 alone of a size that none of those can be linked with.
    assert pairs == {(u, v) for u in range(90) for v in range(max(u + 1, 30), 90)} | {(u, v) for u in range(90, 100) for v in range(u + 1, 100)}


def test_no_link_at_the_threshold_is_missed_by_bands_or_sketches():
    """Of 4,000 pairs at the threshold none is lost; a sample agrees as often as the similarity says."""
    rng, lost, agree = np.random.default_rng(8), 0, []
    for k in range(4000):
        n = (40, 100, 300)[k % 3]
        both = -(-85 * 2 * n // 185)  # the least intersection of two sets of n that are linked
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = nd.minhash(pool[:n]), nd.minhash(pool[n - both : 2 * n - both])
        x = (nd.odd_sketch(a) ^ nd.odd_sketch(b)).view(np.uint64)
        near = sum(int(v).bit_count() for v in x) <= nd.most_differing_bits()
        lost += not (near and (nd.band_keys(a) == nd.band_keys(b)).any())
        agree.append((a == b).mean() - both / (2 * n - both))
    assert lost <= 2 and abs(np.mean(agree)) < 0.003  # expected: 0.2 of 4,000


def test_rows_that_repeat_an_id(spark):
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_groups(frame(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, "q r s t u v")])).collect())
    assert got == [(2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True)]
