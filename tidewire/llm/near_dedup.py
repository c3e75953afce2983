"""Near-duplicate classes: MinHash bands find candidates, odd sketches screen them, full shingle sets confirm them.

MinHash samples of a document's five-word shingles are cut into bands; documents that agree in a band are candidates. The
samples, and more of them, are also folded into a parity bitmap (odd sketch): each flips one bit, so that the XOR of two
bitmaps counts the samples in which two documents differ, which is precise where similarity is high. Only candidates whose
sketches leave the threshold within reach are confirmed, on their full shingle sets.

Groups of copies stay linear: equal sets are one vertex; each vertex is first compared with one pivot, the most central
member of the buckets it is in; then only members that no confirmed link connects yet meet. Of small groups the pairs that
pass the screen are written down; members of large ones are compared in blocks, and only links are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import HOT_PARTS, Workspace, attach, doc_frame
from .wordhash import mix, shingle_sets, slices

#: Words in a shingle; percent of the union that the intersection must have.
WORDS, PERCENT = 5, 85
#: MinHash bands and samples in each. At the threshold a pair shares no band with probability (1 - 0.85^6)^24 = 1.2e-5.
BANDS, ROWS = 24, 6
#: Bands below that threshold, of as many samples as keep the probability under MISS: 5 at 0.80 (3e-6).
MORE_BANDS, MISS = 32, 1.2e-5
#: Samples folded into a sketch, and its bits in words of 64.
SAMPLES, SKETCH_WORDS = 768, 32
#: A pair is confirmed if its estimate is at most this far below the threshold: four standard errors, which are wider for
#: each percent below 85.
MARGIN, WIDER = 0.055, 0.002
#: Members of a cell on either side of one block's comparisons, at most on average, and their shingles together.
SLICE, SLICE_SHINGLES = 1024, 4_000_000
#: Up to so many members, a cell's pairs are written down; those of larger cells stay in the tasks that compare them.
FEW_MEMBERS = 32
#: A key with fewer rows is never dealt out in slices.
LEAST_HOT = 50

_RNG = np.random.default_rng(77_001)
_XOR = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_K = np.arange(SAMPLES, dtype=np.uint64)
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
_CHUNK = 256


def minhash(shingles: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """The samples, 32 bits each, of a set of 64-bit shingles. ``room`` is scratch space of _CHUNK rows."""
    room = np.empty((_CHUNK, SAMPLES), np.uint32) if room is None else room
    x, low = (shingles >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(x), _CHUNK):
        part = x[at : at + _CHUNK, None]
        m = room[: len(part)]
        np.bitwise_xor(part, _XOR, out=m)
        np.multiply(m, _MUL, out=m)
        new = np.minimum.reduce(m, axis=0)
        low = new if low is None else np.minimum(low, new)
    return low


def bands_at(percent: int) -> tuple[int, int]:
    """Bands, and samples in each, that fit a threshold."""
    if percent >= PERCENT:
        return BANDS, ROWS
    fit = (r for r in range(ROWS, 1, -1) if (1 - (percent / 100) ** r) ** MORE_BANDS <= MISS)
    return MORE_BANDS, next(fit, 1)


def band_keys(samples: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in samples[: bands * rows].reshape(bands, rows).astype(np.uint64).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples, as SKETCH_WORDS signed words."""
    at = mix(samples.astype(np.uint64) * np.uint64(SAMPLES) + _K) & np.uint64(SKETCH_WORDS * 64 - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_WORDS * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def most_differing_bits(percent: int = PERCENT, margin: float | None = None) -> int:
    """The XOR population count at which the estimated similarity is ``percent`` less the margin."""
    margin = MARGIN + WIDER * max(0, PERCENT - percent) if margin is None else margin
    n, differ = SKETCH_WORDS * 64, 2 * SAMPLES * (1 - percent / 100 + margin)
    return int(np.ceil(n / 2 * (1 - np.exp(-2 * differ / n))))


def _signatures(shape: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty((_CHUNK, SAMPLES), np.uint32)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts]):
                n, digest, bands, sketch = [], [], [], []
                for s in shingle_sets(texts[a:b], WORDS):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    low = minhash(s, room) if len(s) else None
                    bands.append(band_keys(low, *shape) if len(s) else [])
                    sketch.append(odd_sketch(low) if len(s) else np.zeros(SKETCH_WORDS, np.int64))
                words = np.array(sketch, np.int64).reshape(-1, SKETCH_WORDS)
                yield pa.record_batch(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(words[:, i]) for i in range(SKETCH_WORDS))],
                    names=["doc_id", "n_shingles", "digest", "bands", *_SKETCH],
                )

    return run


def signatures(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), bands and sketch of each whole text."""
    return rows.mapInArrow(_signatures(bands_at(percent)), "doc_id long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH))


def _sliced_join(rows: DataFrame, key: str, table: DataFrame, rows_total: int) -> DataFrame:
    """Join a table with one row a doc_id to rows by ``key``; a key that many rows have is repeated for slices of them."""
    if rows_total < LEAST_HOT:  # no key has so many
        return rows.join(table.withColumnRenamed("doc_id", key), key)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * F.lit(HOT_PARTS) >= F.lit(max(rows_total, LEAST_HOT * HOT_PARTS)))
    hot = F.broadcast(counts.select(F.col(key).alias("_key"), F.ceil(F.col("n") * F.lit(HOT_PARTS) / F.lit(max(1, rows_total))).cast("int").alias("_slices")))
    pieces = F.coalesce("_slices", F.lit(1))
    left = rows.join(hot, F.col(key) == F.col("_key"), "left").withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), pieces).cast("int")).drop("_key", "_slices")
    right = table.join(hot, F.col("doc_id") == F.col("_key"), "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_key", "_slices")
    return left.join(right.withColumnRenamed("doc_id", key), [key, "_slice"]).drop("_slice")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                u, v = part.column("u").to_pylist(), part.column("v").to_pylist()
                texts = dict(zip(u, part.column("text_u").to_pylist(), strict=True)) | dict(zip(v, part.column("text_v").to_pylist(), strict=True))
                if len(memory) > 256:
                    memory.clear()
                new = [i for i in texts if i not in memory]
                for a, b in slices([len(texts[i]) for i in new]):
                    memory.update(zip(new[a:b], shingle_sets([texts[i] for i in new[a:b]], WORDS), strict=True))
                keep = []
                for a, b in zip(u, v, strict=True):
                    x, y = memory[a], memory[b]
                    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.record_batch([part.column("u").filter(pa.array(keep)), part.column("v").filter(pa.array(keep))], names=["u", "v"])

    return run


_BLOCK = ["bucket", "cell", "a_slice", "b_slice"]
_BLOCK_TYPES = "bucket long, cell long, a_slice int, b_slice int"


def _bands(table: pa.Table, name: str) -> np.ndarray:
    lists = table.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _screen_block(percent: int):
    """Who has to be compared in a block: each member of a pair that passes the screen, with its partners. A pair is left to
    the first of the buckets that it shares."""
    most = most_differing_bits(percent)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        get = lambda t, c: t.column(c).to_numpy()
        words = lambda t, p: np.stack([get(t, f"{p}{s}") for s in _SKETCH], 1).view(np.uint64)
        u, v, lu, lv, nu, nv = get(a, "u"), get(b, "v"), get(a, "lu"), get(b, "lv"), get(a, "a_n"), get(b, "b_n")
        partners: dict[int, list[int]] = {}
        if len(u) and len(v):
            x, y, bx, by, top = words(a, "a_"), words(b, "b_"), _bands(a, "a_bands"), _bands(b, "b_bands"), get(b, "in_top")
            own = int(np.argmax(bx[0] == a.column("bucket")[0].as_py()))
            for at in range(0, len(u), 32):
                s = slice(at, at + 32)
                differ = np.bitwise_count(x[s, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                sizes = np.minimum(nu[s, None], nv) * 100 >= np.maximum(nu[s, None], nv) * percent
                i, j = np.nonzero((differ <= most) & sizes & (lu[s, None] != lv) & (top | (u[s, None] < v)))
                new = ~(bx[at + i, :own] == by[j, :own]).any(1)
                for p, q in zip(u[at + i[new]].tolist(), v[j[new]].tolist(), strict=True):
                    partners.setdefault(p, []).append(q)
                    partners.setdefault(q, [])
        label = dict(zip(u.tolist(), lu.tolist(), strict=True)) | dict(zip(v.tolist(), lv.tolist(), strict=True))
        one = (a if len(u) else b).select(_BLOCK).slice(0, 1).to_pylist()[0]
        ids = list(partners)
        block = [pa.array([one[c]] * len(ids), t) for c, t in zip(_BLOCK, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        return pa.table([*block, pa.array(ids, pa.int64()), pa.array([label[i] for i in ids], pa.int64()), pa.array([partners[i] for i in ids], pa.list_(pa.int64()))], names=[*_BLOCK, "doc_id", "label", "partners"])

    return run


def _confirm_block(percent: int):
    """The links of a block by full sets, but for pairs whose classes other links of the block have connected already."""

    def run(block: pa.Table) -> pa.Table:
        ids, texts = block.column("doc_id").to_pylist(), block.column("text").to_pylist()
        label, sets, up = dict(zip(ids, block.column("label").to_pylist(), strict=True)), {}, {}
        for a, b in slices([len(t) for t in texts]):
            sets.update(zip(ids[a:b], shingle_sets(texts[a:b], WORDS), strict=True))

        def root(c: int) -> int:
            while up.get(c, c) != c:
                up[c] = c = up.get(up[c], up[c])
            return c

        links = []
        for u, vs in zip(ids, block.column("partners").to_pylist(), strict=True):
            for v in vs:
                p, q = root(label[u]), root(label[v])
                if p == q:
                    continue
                x, y = sets[u], sets[v]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    up[p] = q
                    links.append((u, v))
        return pa.table([pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


class _Linker:
    """Screens and confirms pairs of vertices."""

    def __init__(self, work: Workspace, sketches: DataFrame, texts: DataFrame, percent: int):
        self.work, self.sketches, self.texts, self.percent = work, sketches, texts, percent

    def screen(self, a: str, b: str) -> Column:
        differ = sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in _SKETCH), F.lit(0))
        return (differ <= F.lit(most_differing_bits(self.percent))) & (
            F.least(f"{a}n", f"{b}n") * F.lit(100) >= F.greatest(f"{a}n", f"{b}n") * F.lit(self.percent)
        )

    def sketched(self, prefix: str, *more: str) -> DataFrame:
        return self.sketches.select("doc_id", *(F.col(c).alias(f"{prefix}{c}") for c in ("n", *more, *_SKETCH)))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (u, v): by their sketches, then by their full sets."""
        pairs = self.work.keep(pairs.distinct(), "pairs")
        n = pairs.count()
        both = _sliced_join(_sliced_join(pairs, "u", self.sketched("a_"), n), "v", self.sketched("b_"), n)
        near = self.work.keep(both.filter(self.screen("a_", "b_")).select("u", "v"), "screened")
        n = near.count()
        texts = lambda side: self.texts.withColumnRenamed("text", f"text_{side}")
        both = _sliced_join(_sliced_join(near, "u", texts("u"), n), "v", texts("v"), n)
        return self.work.keep(both.select("u", "v", "text_u", "text_v").mapInArrow(_confirm(self.percent), "u long, v long"), "links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Texts whose shingle sets have 100 * intersection >= percent * union are linked. A text without words has an empty set
    and is linked with nothing, not even with another empty one. Null text counts as empty. Ids are expected to be unique;
    rows that repeat an id count as one vertex. A row without an id takes the component of an equal set that has one,
    else null, and is kept only in the second case. An empty table gives an empty result. Whole texts are read.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "near-dedup")
    rows = doc_frame(docs, id_col, text_col)
    sig = work.keep(signatures(rows, percent), "signatures")
    n_bands, _ = bands_at(percent)
    total = sig.count()
    full = sig.filter("n_shingles > 0")

    # Equal sets are one vertex, named by its smallest id.
    equal = work.keep(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "equal")
    named = attach(full, equal, ["digest"], F.col("c"), total).withColumn("rep", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("rep")))
    of = work.keep(named.select("doc_id", "n_shingles", "rep"), "vertex-of")
    vertices = work.keep(
        named.filter("doc_id = rep").select("doc_id", F.col("n_shingles").alias("n"), "bands", *_SKETCH).dropDuplicates(["doc_id"]), "vertices"
    )

    in_bands = vertices.select("doc_id", "n", F.explode("bands").alias("bucket"))
    shared = work.keep(in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
    members = work.keep(attach(in_bands, shared, ["bucket"], F.col("m"), n_bands * max(total, 1), "inner").select("bucket", "doc_id", "n", "m"), "members")
    busy = members.groupBy("doc_id").agg(F.sum("m").alias("central"))
    sketches = work.keep(vertices.join(busy.hint("merge"), "doc_id"), "sketches")
    texts = work.keep(rows.join(busy.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    link = _Linker(work, sketches, texts, percent)

    # Each vertex meets the most central member of its buckets, by the sizes of the buckets that one is in.
    ranked = members.join(sketches.select("doc_id", "central"), "doc_id").select("bucket", "doc_id", "m", F.struct("central", (-F.col("doc_id")).alias("minus")).alias("rank"))
    heads = ranked.groupBy("bucket").agg(F.max("rank").alias("head"), F.max("m").alias("size"))
    met = attach(members.select("bucket", "doc_id"), heads, ["bucket"], F.col("size"), n_bands * max(total, 1), "inner").groupBy("doc_id").agg(F.max("head").alias("head"))
    star = met.select((-F.col("head.minus")).alias("u"), F.col("doc_id").alias("v")).filter("u != v")
    links = link.confirmed(star)
    labels = work.keep(components(links, work), "labels")

    # Buckets that hold more than one class: members of different classes meet.
    told = members.join(labels.hint("merge"), "doc_id", "left").select("bucket", "doc_id", "n", "m", F.coalesce("label", "doc_id").alias("label"))
    told = work.keep(told, "told")
    mixed = told.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("m").alias("size")).filter("lo != hi").select("bucket", "size")
    open_ = work.keep(attach(told, mixed, ["bucket"], F.col("size"), n_bands * max(total, 1), "inner").select("bucket", "doc_id", "n", "label", "size"), "open")
    links = _links_across(link, open_).unionByName(labels.filter("doc_id != label").select(F.col("doc_id").alias("u"), F.col("label").alias("v")))
    labels = work.keep(components(links, work), "labels")

    sized = labels.join(of.groupBy(F.col("rep").alias("doc_id")).agg(F.count(F.lit(1)).alias("c")).hint("merge"), "doc_id", "left")
    sized = work.keep(sized.select(F.col("doc_id").alias("rep"), "label", F.coalesce("c", F.lit(1)).alias("c")), "sized")
    found = attach(of, sized, ["rep"], F.col("c"), total).select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    empty = sig.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return work.only(found.unionByName(empty).withColumn("kept", kept), "result")


def size_cell(n: Column | str, percent: int) -> Column:
    """Sets whose sizes leave the threshold within reach of each other are in the same cell or in neighbouring ones."""
    width = max(math.log(100 / percent) * (1 + 1e-9), 1e-9)
    return F.floor(F.log(n) / F.lit(width))


def _cells(link: _Linker, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with whether they are in their bucket's largest class and their cell of sizes; and the cells in which members
    outside that class meet others, with the slices that either side is cut into."""
    total = max(members.count(), 1)
    sizes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size")).select("bucket", F.col("top.label").alias("top"), "size")
    told = attach(members.drop("size"), most, ["bucket"], F.col("size"), total, "inner").select("bucket", "doc_id", "n", "label", (F.col("label") == F.col("top")).alias("in_top"), size_cell("n", link.percent).alias("cell"))
    told = link.work.keep(told, "told-apart")
    cells = _outside(told).select("bucket", "cell", "n", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(told.select("bucket", "cell", "n", F.lit(0).alias("a"), F.lit(1).alias("b")))
    cells = cells.groupBy("bucket", "cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("n").alias("n")).filter((F.col("a") > 0) & (F.col("b") > 0))
    cut = lambda x: F.greatest(F.ceil(F.col(x) / F.lit(SLICE)), F.least(F.ceil(F.col(x) * F.col("n") / F.lit(SLICE_SHINGLES)), F.col(x))).cast("int")
    few = F.greatest("a", "b") <= F.lit(FEW_MEMBERS)
    return told, link.work.keep(cells.select("bucket", "cell", few.alias("few"), (F.col("a") + F.col("b")).alias("c"), *(cut(x).alias(f"{x}_slices") for x in "ab")), "cells")


def _outside(told: DataFrame) -> DataFrame:
    """Members outside the largest class, under the cells that they can be linked in."""
    return told.filter("not in_top").withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))


def _sides(link: _Linker, told: DataFrame, cells: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of each block with their sketches: rows in a slice of their own side, once for each slice of the other."""
    total = max(told.count(), 1)

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        dealt = attach(rows.drop("n"), cells.drop("few"), ["bucket", "cell"], F.col("c"), 4 * total, "inner")
        dealt = dealt.withColumn(f"{own}_slice", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col(f"{own}_slices")).cast("int")).withColumn(f"{other}_slice", F.explode(F.sequence(F.lit(0), F.col(f"{other}_slices") - 1)))
        return dealt.join(link.sketched(f"{own}_", *more).hint("merge"), "doc_id")

    a = side(_outside(told), "a", "b").select(*_BLOCK, F.col("doc_id").alias("u"), F.col("label").alias("lu"), *(f"a_{c}" for c in ("n", *more, *_SKETCH)))
    b = side(told, "b", "a").select(*_BLOCK, F.col("doc_id").alias("v"), F.col("label").alias("lv"), "in_top", *(f"b_{c}" for c in ("n", *more, *_SKETCH)))
    return a, b


def _across(link: _Linker, members: DataFrame, told: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Pairs of members of one bucket in different classes whose sketches pass the screen, in all cells or those given.

    In each bucket the members outside its largest class meet all members, those whose sizes are in the same cell or the
    next. So a bucket costs its size times the number of rows outside that class in comparisons, over the cells; both sides
    of a large cell are cut into slices, and each pair of slices is a task's work of about SLICE x SLICE comparisons.
    """
    if told is None:
        told, cells = _cells(link, members)
    a, b = _sides(link, told, cells)
    met = a.join(b, _BLOCK).filter((F.col("lu") != F.col("lv")) & (F.col("in_top") | (F.col("u") < F.col("v"))) & link.screen("a_", "b_"))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _links_across(link: _Linker, members: DataFrame) -> DataFrame:
    """Links that connect members of one bucket in different classes. The pairs of small cells are written down. A block of a
    larger cell is compared in one task: its members are written down with whom they meet, and their texts sent to it, so
    rows grow with the members and not with the pairs that pass the screen."""
    told, cells = _cells(link, members)
    links = link.confirmed(_across(link, members, told, cells.filter("few")))
    if cells.filter("not few").isEmpty():
        return links
    a, b = (link.work.keep(side, "side") for side in _sides(link, told, cells.filter("not few"), "bands"))
    large = a.groupBy(*_BLOCK).cogroup(b.groupBy(*_BLOCK))
    met = link.work.keep(large.applyInArrow(_screen_block(link.percent), f"{_BLOCK_TYPES}, doc_id long, label long, partners array<long>"), "met")
    blocks = met.join(link.texts.hint("merge"), "doc_id").groupBy(*_BLOCK)
    return links.unionByName(link.work.keep(blocks.applyInArrow(_confirm_block(link.percent), "u long, v long"), "block-links"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the first document of every class alone; all columns stay. Rows without an id stay."""
    gone = near_groups(docs, id_col, text_col, percent).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, at 85 percent."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
