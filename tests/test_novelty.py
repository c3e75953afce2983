"""Similar earlier titles against brute force: addresses that repeat, orders, titles of very many stories."""

from __future__ import annotations

import random
import re

from tidewire import rules
from tidewire.operators import score
from tidewire.plans import story_queries
from tidewire.plans.views import articles


def words(title):
    plain = re.sub(r"[^a-z0-9가-힣\s]", " ", title.lower())
    return {w for w in plain.split() if len(w) >= 3 and w not in rules.NOVELTY_STOP_WORDS}


def plain_similar(incoming, past, before):
    """Rows are (key, url, canonical_url, title, order)."""
    out = set()
    for k, u, c, t, o in incoming:
        for _, pu, pc, pt, po in past:
            a, b = words(t), words(pt)
            if None not in (u, c, pu, pc) and u != pu and c != pc and (po < o or not before) and len(a & b) >= 4 and len(a & b) / max(len(a), len(b)) >= 0.75:
                out.add(k)
    return out


def test_past_similar_matches_brute_force(spark):
    schema = "article_id long, url string, canonical_url string, title string, seq long"
    for seed in range(4):
        rng = random.Random(seed)
        titles = [" ".join(rng.sample([f"w{chr(97 + k)}{'x' * (k % 4)}y" for k in range(9)], rng.choice([2, 3, 4, 5, 6, 7, 8]))) for _ in range(25)]
        rows = [(i, rng.choice(["u1", "u2", "u3", f"u{i}", None]) if i % 3 else "u1", rng.choice(["c1", "c2", f"c{i % 9}"]), rng.choice(titles), rng.randrange(60)) for i in range(90)]
        mine, past = rows[:50], rows[30:]
        a, b = spark.createDataFrame(mine, schema), spark.createDataFrame(past, schema)
        for order in (None, "seq"):
            got = {r["article_id"] for r in score.past_similar(a, b, order=order).collect()}
            assert got == plain_similar(mine, past, order is not None)


def test_registered_query_takes_all_stories(spark, tmp_path):
    ids = [*range(40), *range(300, 420)]
    spark.createDataFrame([(i, f"s{i % 5}") for i in ids], "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["url"], r["url"], r["title"], r["doc_id"]) for r in articles(spark, f"{tmp_path}").collect()]
    want = plain_similar(rows, rows, True)
    got = {r["doc_id"] for r in story_queries.j8(spark, f"{tmp_path}").collect()}
    assert got == want and {i % 3 for i in got} == {0, 1, 2} and len(got) > 60
