"""D3 and J7 say every pair of stories: what follows from their rows alone is compared with the pairs themselves."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations, product

from tidewire import rules
from tidewire.operators import dedupe, similarity
from tidewire.operators.graph import cut
from tidewire.plans import story_queries
from tidewire.plans.views import articles

SF = "/root/testdata/sf0.001"


def members(rows):
    found = defaultdict(list)
    for r in rows:
        if r["kind"] == "class":
            found[r["v"]].append(r["u"])
    return found


def pairs_of(found, a, b):
    return combinations(found[a], 2) if a == b else product(found[a], found[b])


def test_similar_titles_hold_every_pair(spark):
    sf = "/root/testdata/sf0.01"
    rows = story_queries.d3(spark, sf).collect()
    found, links = members(rows), {r["u"]: r["n_links"] for r in rows if r["kind"] == "class"}
    classes = [(g, g) for g in found] + [(r["u"], r["v"]) for r in rows if r["kind"] == "similar"]
    got = {tuple(sorted(p)) for a, b in classes for p in pairs_of(found, a, b)}
    want = {(r["u"], r["v"]) for r in dedupe.similar_pairs(cut(dedupe.dedupe_keys(articles(spark, sf)))).collect()}
    assert got == want and any(r["kind"] == "similar" for r in rows)
    assert all(n == sum(k in p for p in want) for k, n in links.items())


def test_event_similarity_holds_every_pair(spark):
    rows, least = story_queries.j7(spark, SF).collect(), rules.SIMILARITY * rules.COHESION
    found, at = members(rows), {r["u"]: r["at"] for r in rows if r["kind"] == "class"}
    far = lambda u, v: None not in (at[u], at[v]) and abs(at[u] - at[v]) > 72 * 3600 * 10**6
    got = {}
    for r in rows:
        if r["kind"] == "similar":
            got |= {tuple(sorted(p)): r["similarity"] for p in pairs_of(found, r["u"], r["v"]) if not far(*p)}
    one = defaultdict(set)
    for r in rows:
        if r["kind"] == "same":
            one[r["v"]] |= {r["u"], r["v"]}
    got |= {p: 1.0 for stories in one.values() for p in combinations(sorted(stories), 2)}
    want = {(r["u"], r["v"]): round(r["similarity"], 6) for r in similarity.similar_articles(story_queries._features(spark, SF), least).collect()}
    assert got == want and len(want) > 100
