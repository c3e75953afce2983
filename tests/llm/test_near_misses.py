"""A large group of texts that are all near one another and mostly not linked."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from tidewire.llm import near_dedup
from tidewire.llm.shared import Workspace


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_misses_are_not_written_as_pairs(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    core, tails = [word() for _ in range(300)], []
    for k in range(260):
        tail = [word() for _ in range(46)]
        if k % 4 == 3:  # linked with the one before
            tail = [*tails[-1][:40], *tail[:6]]
        tails.append(tail)
    texts = [" ".join([*core, *t]) for t in tails]
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near += 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    assert near > 30_000 and 100 < len(set(up)) < 250
    rows, keep = {}, Workspace.keep

    def counting(self, df, name):
        kept = keep(self, df, name)
        rows[name] = max(rows.get(name, 0), kept.count())
        return kept

    monkeypatch.setattr(Workspace, "keep", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs, percent=80).select("doc_id", F.col("component_id")).collect()}
    assert got == dict(enumerate(up))
    assert max(rows.get(n, 0) for n in ("pairs", "screened", "links", "met", "block-links")) <= near_dedup.bands_at(80)[0] * len(texts)
