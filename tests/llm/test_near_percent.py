"""Near duplicates from 0.80 to below 0.85: the stage of the pipeline takes them out, op10 at 85 percent does not."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from tidewire.llm import near_dedup as nd

from tests.llm.test_dedup import plain_components, plain_set


def edge_rows():
    """Pairs whose similarity is spread over 0.78 to 0.87."""
    rng, rows = random.Random(11), []
    for k in range(60):
        n = 150 + k
        base = [f"p{k}w{rng.randrange(10_000)}" for _ in range(n)]
        copy, cuts = list(base), round((n - 4) * (0.07 + 0.053 * (k % 10) / 9) / 5)
        for c in range(cuts):
            copy[10 + c * ((n - 20) // cuts)] = f"new{k}x{c}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    return rows


def test_pipeline_takes_pairs_from_80_percent(spark):
    rows = edge_rows()
    sets = {i: plain_set(t) for i, t in rows}
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)]
    assert sum(0.80 <= x < 0.85 for x in alike) >= 15 and sum(x < 0.80 for x in alike) >= 5 and sum(x >= 0.85 for x in alike) >= 5
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, (_, _, k) in plain_components(rows, 80).items() if k}
    assert want != {i for i, (_, _, k) in plain_components(rows).items() if k}
    assert {r["doc_id"] for r in cp.near(spark, docs, "").collect()} == want


def test_bands_fit_the_percent():
    assert nd.bands_at(85) == nd.bands_at(95) == (24, 6) and nd.bands_at(80) == (32, 5)
    assert nd.most_differing_bits(85) == nd.most_differing_bits(85, 0.055) and nd.most_differing_bits(80) == nd.most_differing_bits(80, 0.065)
    for percent in (85, 80, 75, 70, 60, 50):
        bands, rows = nd.bands_at(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= nd.MISS and bands * rows <= nd.SAMPLES
