"""The pipeline against a brute-force version of its filtering stages, on a small table."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from tidewire.llm.toxicity import fit

from tests.llm.test_dedup import plain_components
from tests.llm.test_text_ops import toxic_rows


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, t) for i, t, _ in toxic_rows(240, 9)]
    clean = [(i, t) for i, t, y in toxic_rows(240, 9) if not y and len(t.split()) > 60]
    near = [(1000 + k, " ".join(w for j, w in enumerate(t.split()) if j != 30)) for k, (_, t) in enumerate(clean[:12])]
    exact = [(2000 + k, t) for k, (_, t) in enumerate(clean[12:20])]
    item = " ".join(f"bench{k}" for k in range(20))
    leaks = [(3000, clean[30][1] + " " + item), (3001, " ".join(item.split()[10:] + ["then"] + item.split()[:10]))]
    docs += near + exact + leaks + [(4000, ""), (4001, "")]
    rng.shuffle(docs)
    path = f"{tmp_path}"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_rows(240, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    stages, frame = {}, spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert frame.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        stages[name] = {r["doc_id"] for r in frame.collect()}
        frame = spark.createDataFrame(frame.collect(), schema)
    text = dict(docs)
    kept = stages["toxicity"]
    toxic = {i for i, _, y in toxic_rows(240, 9) if y}
    assert len(toxic & kept) <= len(toxic) * 0.1 and len({i for i, _ in clean} - kept) <= 3
    by_text: dict[str, int] = {}
    for i in kept:
        by_text[text[i]] = max(i, by_text.get(text[i], -1))
    assert stages["exact_dedup"] == set(by_text.values())
    want = {i for i, (_, _, k) in plain_components([(i, text[i]) for i in stages["exact_dedup"]]).items() if k}
    assert stages["near_dedup"] == want
    assert stages["decontamination"] == want - {3000, 3001}
    packed = {r["doc_id"] for r in cp.run(spark, path).collect()}
    assert packed == stages["decontamination"]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"] and fit([], []) is not None


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, extra columns whose names the operators use inside, and an empty table."""
    path, long = f"{tmp_path}", " ".join(f"w{k}" for k in range(3000))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, bucket string, h string, n int, component_id long, _gone long, block long"
    rows = [(1, None), (2, ""), (3, " \n"), (None, None), (None, "alone here"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "a b c d e f g"), (6, long), (7, long + " end"), (8, "A b c d e f g")]
    docs = spark.createDataFrame([(i, t, None, "s" if i and i % 2 else None, None, 0.5, 1, "x", "y", 2, 9, 9, 9) for i, t in rows], schema)
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, ""), (3, "nothing of this is in any document at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    frame, kept = docs, []
    for name, stage in cp.STAGES:
        frame = stage(spark, frame, path)
        if name != "packing":
            assert frame.columns == docs.columns
            kept.append(sorted((str(r["doc_id"]) for r in frame.collect())))
            frame = spark.createDataFrame(frame.collect(), schema)
    assert kept[0] == sorted(str(i) for i, _ in rows)
    assert kept[1] == sorted(["2", "3", "None", "5", "6", "7", "8"]) and kept[2] == sorted(["2", "3", "None", "5", "6"]) == kept[3]
    packed = frame.collect()
    assert {str(r["doc_id"]) for r in packed} == set(kept[3]) and "".join(r["text"] for r in sorted(packed, key=lambda r: r["piece"]) if r["doc_id"] == 6) == long
    frame = docs.limit(0)
    for _, stage in cp.STAGES:
        frame = stage(spark, frame, path)
        assert frame.count() == 0
