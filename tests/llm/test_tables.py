"""Shard compaction and licence scans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from tidewire.llm import licenses as li
from tidewire.llm.shards import MANIFEST, CommitConflict, ShardStore
from tidewire.llm.shared import new_folder


def plain_plan(entries, target, base, factor, least):
    """Size tiers by definition: (seq, run) of what merges."""
    tiers = {}
    for seq, size in entries:
        if size < target:
            t = 0
            while size > base * factor**t:
                t += 1
            tiers.setdefault(t, []).append((seq, size))
    out = {}
    for t, own in tiers.items():
        before, runs = 0, {}
        for seq, size in sorted(own):
            runs.setdefault(before // target, []).append(seq)
            before += size
        for k, seqs in runs.items():
            if len(seqs) >= least:
                out.update({s: (t, k) for s in seqs})
    return out


def test_plan_matches_the_definition(spark):
    sizes = [3, 4, 5, 90, 17, 4, 4, 60, 66, 2, 100, 16, 64, 63, 1, 1, 1, 40, 41, 42, 43]
    entries = spark.createDataFrame([(f"n{i}", 1, s, i, 0) for i, s in enumerate(sizes)], MANIFEST)
    store = ShardStore(spark, new_folder(spark, "plan"), target=100, base=4, factor=4, min_run=2)
    got = {int(r["name"][1:]): r["run"] for r in store.plan(entries).collect()}
    want = plain_plan(list(enumerate(sizes)), 100, 4, 4, 2)
    assert got.keys() == want.keys() and len(set(got.values())) == len(set(want.values()))
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in got for b in got)


def test_store_keeps_every_row(spark):
    store = ShardStore(spark, new_folder(spark, "store"), target=1 << 20, base=1 << 10, min_run=2)
    rows = spark.createDataFrame([(i if i % 9 else None, "hot" if i % 3 else f"s{i}", None if i % 5 else "t" * i) for i in range(200)], "doc_id long, run string, shard string")
    store.append(rows, F.pmod(F.hash("run"), F.lit(5)))
    for k in range(4):
        store.append(rows.filter(F.pmod(F.hash("run"), F.lit(4)) == k).repartition(3))
    want = sorted(map(tuple, rows.union(rows).collect()), key=str)
    before, old = store.manifest().count(), store.version()
    assert sorted(map(tuple, store.read().collect()), key=str) == want
    assert store.compact() == old + 1 and store.manifest().count() < before
    while store.compact() is not None:
        pass
    assert sorted(map(tuple, store.read().collect()), key=str) == want and store.read(old).count() == 400
    assert store.manifest().agg(F.sum("rows")).first()[0] == 400
    assert store.vacuum() == 0 and store.read(old).count() == 400  # all is young, and a reader of the old version has time
    assert store.vacuum(0, 1) > 0 and sorted(map(tuple, store.read(shard_col="where").drop("where").collect()), key=str) == want


def test_two_writers_cannot_commit_one_version(spark):
    store = ShardStore(spark, new_folder(spark, "store"))
    one = spark.createDataFrame([("a", 1, 1, 1, 0)], MANIFEST)
    assert store.commit(one, 0) == 1
    with pytest.raises(CommitConflict):
        store.commit(one, 0)
    assert store.version() == 1 and store.manifest().count() == 1


def test_vacuum_spares_a_writer_that_has_not_committed(spark, monkeypatch):
    root = new_folder(spark, "store")
    store, other = ShardStore(spark, root, min_run=2), ShardStore(spark, root)
    rows = spark.range(50).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    for _ in range(3):
        store.append(rows.coalesce(1))
    publish, seen = other._publish, []

    def slowly(*args):
        seen.append((store.compact(), store.vacuum(), store.vacuum(3600, 1)))
        return publish(*args)

    monkeypatch.setattr(other, "_publish", slowly)
    other.append(rows)
    assert seen[0][0] == 4 and seen[0][1:] == (0, 0) and store.read().count() == 200 and store.version() == 5
    assert store.read(3).count() == 150  # a pinned version
    assert store.vacuum(0, 1) == 3 and store.read().count() == 200


def test_appends_during_a_compaction_are_kept(spark, monkeypatch):
    root = new_folder(spark, "store")
    store, other = ShardStore(spark, root, min_run=2), ShardStore(spark, root, min_run=2)
    rows = spark.range(20).selectExpr("id AS doc_id")
    store.append(rows.coalesce(1))
    store.append(rows.coalesce(1))
    publish = store._publish

    def late(*args):
        monkeypatch.undo()
        other.append(rows.coalesce(1))
        return publish(*args)

    monkeypatch.setattr(store, "_publish", late)
    assert store.compact() == 4 and store.read().count() == 60 and store.manifest().count() == 2
    monkeypatch.setattr(store, "_publish", lambda *args: (other.compact(), publish(*args)))
    with pytest.raises(CommitConflict):
        store.compact()
    assert store.read().count() == 60


def test_appends_of_other_columns(spark):
    store = ShardStore(spark, new_folder(spark, "store"), min_run=2)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1))
    store.append(spark.createDataFrame([(2, 0.5, None)], "doc_id long, score double, TEXT string").coalesce(1), F.lit(None).cast("string"))
    long = "long " * 200_000
    store.append(spark.createDataFrame([(None, long), (3, ""), (3, "")], "doc_id long, note string").coalesce(1), F.lit("a/b=c %"))
    want = {(1, "a", None, None, 1), (2, None, 0.5, None, 1), (None, None, None, long, 1), (3, None, None, "", 2)}
    for _ in range(2):
        assert {tuple(r) for r in store.read().groupBy("doc_id", "text", "score", "note").count().collect()} == want
        store.compact()
    assert store.manifest().count() == 1 and store.schema().names == ["doc_id", "text", "score", "note"] and store.schema(1).names == ["doc_id", "text"]
    with pytest.raises(ValueError, match="doc_id"):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    assert store.read(1).columns == ["doc_id", "text"] and store.read(1).count() == 1


def test_runs_have_tasks_of_their_own(spark):
    store = ShardStore(spark, new_folder(spark, "store"), target=1500, base=1000, min_run=2)
    for k in range(12):
        store.append(spark.range(k * 10, k * 10 + 10).selectExpr("id AS doc_id").coalesce(1))
    runs = store.plan(store.manifest()).select("run").distinct().count()
    assert runs > 2 and store.compact() and store.manifest().filter("generation > 0").count() == runs
    assert store.read().distinct().count() == 120


def test_empty_store(spark):
    store = ShardStore(spark, new_folder(spark, "store"))
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    assert store.compact() is None and store.read().count() == 0


MIT = li.SENTENCES[14] + "\n\n" + li.SENTENCES[15]
CASES = {
    1: ("Prose.\nReleased under the MIT License.\nMore.", "MIT"), 2: (None, ""), 3: ("", ""), 4: ("the licence of poets", ""),
    5: (MIT, "MIT"), 6: ("Copyright (c) 2020 X.\n" + "\n".join(li.SENTENCES[k] for k in (16, 17, 18, 19)), "BSD-3-Clause"),
    7: ("\n".join(li.SENTENCES[k] for k in (16, 17, 18)), "BSD-2-Clause"), 8: ("\n".join(li.SENTENCES[k] for k in (4, 5, 6, 7)), "Apache-2.0"),
    9: ("ALL RIGHTS RESERVED.  Licensed under CC BY-NC 4.0.\nreleased UNDER the   mit license!\nReleased under the MIT License.", "MIT,CC-BY-NC-4.0,Proprietary"),
    10: ("x " * 50_000 + "\nLicensed under CC BY 4.0.", "CC-BY-4.0"), 11: ("\n".join(li.SENTENCES[k] for k in (17, 16)), ""),
}


def test_licence_rules(spark):
    rows = spark.createDataFrame([(i, t, "z") for i, (t, _) in CASES.items()] + [(None, CASES[1][0], "z")], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r["licenses"] for r in li.scan_licenses(rows).collect()}
    assert got == {i: want for i, (_, want) in CASES.items()} | {None: "MIT"}
    assert li.scan_licenses(rows.limit(0)).count() == 0


def test_every_sentence_is_known_by_a_piece_with_a_marker():
    table = li.sentence_table()
    assert sorted(table.values()) == sorted(li.SENTENCES) and all(re.search(li.MARKERS, s) for s in table)
