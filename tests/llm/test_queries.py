"""The registered queries over the smallest tables: against SQL where there is some, else against brute force."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pytest
from tidewire.llm import chat, registry
from tidewire.llm.wordhash import shingle_sets

from tests.llm.test_text_ops import BPE, plain_tiles

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SMALL}/documents.parquet"), reason="tables are not there")


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return {i: t or "" for i, t in tables.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, tables, name):
    found = tables.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = registry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == want and want


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    fresh, at, want = Tokenizer.from_file(BPE), 0, {}
    for i in sorted(texts):
        ids = np.array([*fresh.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.queries()["op1_token_files"](spark, SMALL).collect()}
    assert got == want


def test_op3(spark, texts):
    rows = registry.queries()["op3_shard_compaction"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["shard_rows"])
    assert all(set(n) == {len(n)} for n in by.values()) and len(by) == 1 and rows[0]["generation"] > 0


def test_op6(spark, tables, texts):
    words = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    docs, want = {i: words(t) for i, t in texts.items()}, set()
    for k, t in tables.execute("SELECT item_id, text FROM benchmark").fetchall():
        a = words(t)
        n = min(5, len(a))
        for i, b in docs.items():
            if a and grams(a, n) & grams(b, n):
                tiles = plain_tiles(a, b, n)
                total = sum(x[2] for x in tiles)
                if total >= 0.8 * len(a) - 1e-9:
                    want.add((i, k, len(a), total, len(tiles)))
    got = {(r["doc_id"], r["item_id"], r["item_words"], r["covered_words"], r["n_tiles"]) for r in registry.queries()["op6_decontamination"](spark, SMALL).collect()}
    assert got == want and want


def test_op7(spark, texts):
    rows = registry.queries()["op7_packing"](spark, SMALL).collect()
    own = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        own[r["doc_id"]] = own.get(r["doc_id"], "") + r["text"]
    assert own == texts
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["length"]
    assert max(bins.values()) <= 2048


def test_op9(spark, tables, texts):
    got = {r["doc_id"]: r for r in registry.queries()["op9_toxicity"](spark, SMALL).collect()}
    assert got.keys() == texts.keys() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    same = {}
    for i, t in texts.items():
        same.setdefault(t, set()).add(got[i]["score"])
    assert all(len(s) == 1 for s in same.values())  # nothing but the text counts


def test_op10(spark, texts):
    ids = sorted(texts)
    sets = dict(zip(ids, shingle_sets([texts[i] for i in ids], 5), strict=True))
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)) > 0:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    p, q = sorted((top(a), top(b)))
                    label[q] = p
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in registry.queries()["op10_near_dedup"](spark, SMALL).collect()}
    assert got == {i: (len(sets[i]), top(i), top(i) == i) for i in ids} and any(not k for _, _, k in got.values())


def test_a_very_long_turn(spark):
    long = "</s>\\ words " * 100_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.format_conversations(df)).first()
    assert r["n_turns"] == 3 and r["loss_chars"] == 2 * len(long)
