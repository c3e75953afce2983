"""The ordered pass over classes: what it gives, and how often it asks."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import cluster, similarity

HOUR = 3_600_000_000


def _traits(k):
    return cluster.Traits(models=frozenset([f"m{k % 3}"]), entities=frozenset([f"e{k % 2}"]), actions=frozenset(["release"] if k % 5 else ["legal"]))


def _plain_firsts(stories, like, traits):
    """Every story against every member of every event."""
    events, out = [], []
    for pos, (g, at, same) in enumerate(stories):
        best, best_mean = None, -1.0
        for k, (_, about, members) in enumerate(events):
            far = [at is not None and t is not None and abs(at - t) / HOUR > 72.0 for _, t, _ in members]
            values = [1.0 if set(same) & set(names) else 0.0 if f else like[g].get(h, 0.0) for f, (h, _, names) in zip(far, members, strict=True)]
            if max(values) >= 0.6 and min(values) >= 0.39 and cluster.agrees(traits[g], about):
                mean = round(sum(values) / len(values), 12)
                if mean > best_mean:
                    best, best_mean = k, mean
        if best is None:
            best = len(events)
            events.append((pos, traits[g], []))
        first, about, members = events[best]
        events[best] = (first, about | traits[g], [*members, (g, at, same)])
        out.append(first)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_the_pass_gives_what_all_pairs_give(seed):
    r = random.Random(seed)
    n = 14
    like = {g: {g: 1.0} for g in range(n)}
    for g in range(n):
        for h in range(g):
            if r.random() < 0.7:
                like[g][h] = like[h][g] = r.choice([0.4, 0.55, 0.6, 0.7, 0.9])
    traits = {g: _traits(r.randrange(9)) for g in range(n)}
    stories = [(r.randrange(n), r.choice([None, *[r.randrange(240) * HOUR] * 9]), (f"x{r.randrange(8)}",) if r.random() < 0.2 else ()) for _ in range(300)]
    state = cluster.OrderedPass(0.6, 0.39, 72.0)
    for g in range(n):
        state.learn(g, traits[g], like[g])
    cell = lambda at: similarity.NO_CELL if at is None else at // (72 * HOUR)
    got = [state.place(pos, g, at, cell(at), same) for pos, (g, at, same) in enumerate(stories)]
    want = _plain_firsts(stories, like, traits)
    assert got == want and 5 < len(set(got)) < 300


def test_classes_that_say_the_same_are_asked_about_once(monkeypatch):
    """Before, each class and each thing that events are about was one call."""
    asked, plain = [0], cluster.agrees

    def counted(f, ev):
        asked[0] += 1
        return plain(f, ev)

    monkeypatch.setattr(cluster, "agrees", counted)
    state = cluster.OrderedPass(0.6, 0.39, 72.0)
    for g in range(100):
        state.learn(g, _traits(g % 2), {h: 0.7 if (g + h) % 3 else 0.4 for h in range(100)})
    for pos in range(1000):
        state.place(pos, pos % 100, 0, 0, ())
    assert asked[0] <= len(state.kinds) * len(state.subjects) <= 8


def test_shared_texts_are_read_once(spark, monkeypatch):
    rows = [(k, [None, "OpenAI launches GPT-5", "Nvidia B200 ships", ""][k % 4], ["a short note", None][k % 2], ["gpu"] if k % 3 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "pos long, title string, excerpt string, tags array<string>")
    want, read, plain = similarity.with_features(df), [], similarity.with_features
    monkeypatch.setattr(similarity, "with_features", lambda d: read.append(d.count()) or plain(d))
    got = similarity.with_features_once(df)
    assert got.columns == want.columns and read == [df.select("title", "excerpt", "tags").distinct().count()]
    assert got.orderBy("pos").collect() == want.orderBy("pos").collect() and got.filter(F.size("f_models") > 0).count() > 10
