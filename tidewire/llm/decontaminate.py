"""Benchmark decontamination by greedy string tiling.

Windows of five words that a document shares with a benchmark item are seeds, found by the running fingerprint of Karp and
Rabin over words; a seed whose words before differ begins a maximal match, which is followed word by word. The longest match is marked first, then the
longest that is left of what is not marked on either side, and so on; so passages count that a document holds in another
order. An item is in a document if the tiles cover enough of it.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, doc_frame
from .wordhash import ALNUM, ngrams, slices, texts_words

#: Words of a seed and of the shortest tile; part of an item's words that tiles must cover.
SEED, COVERAGE = 5, 0.8
#: The benchmark is read in blocks of so many characters and items at most; each block is broadcast and meets all documents.
BLOCK_CHARS, BLOCK_ITEMS = 16_000_000, 100_000
#: Shared windows that are looked at together.
PORTION = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def tile(n_item: int, pairs: Iterator[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in item, start in document, words) of each tile, longest first; ties go to the smallest starts.

    ``pairs`` are the starts (in item, in document) of equal windows of ``width`` words, which is the shortest tile.
    """
    there = set(pairs)
    matches = []
    for i, j in there:
        if (i - 1, j - 1) not in there:
            n = 0
            while (i + n, j + n) in there:
                n += 1
            matches.append((i, j, n - 1 + width))
    return mark(n_item, matches, width)


def mark(n_item: int, matches: Iterable[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """The tiles among maximal matches (start in item, start in document, words): the longest of what is not marked on
    either side, again and again."""
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    item, doc, tiles = bytearray(n_item), set(), []
    open_words = n_item
    while heap and open_words >= width:
        n, i, j = heapq.heappop(heap)
        free = [not item[i + k] and (j + k) not in doc for k in range(-n)]
        if all(free):
            item[i : i - n] = b"\1" * -n
            doc.update(range(j, j - n))
            open_words += n
            tiles.append((i, j, -n))
            continue
        k = 0
        while k < -n:  # what is left of the match
            if free[k]:
                e = k
                while e < -n and free[e]:
                    e += 1
                if e - k >= width:
                    heapq.heappush(heap, (k - e, i + k, j + k))
                k = e
            else:
                k += 1
    return tiles


def plain_words(text: str) -> list[bytes]:
    """The words themselves, as their fingerprints count them."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Seeds:
    """A block of benchmark items: the fingerprints of their windows, sorted, and where they stand."""

    def __init__(self, ids: list[int], texts: list[str], seed: int):
        words = texts_words(texts, ALNUM)
        self.ids, self.texts, self.seed = ids, texts, seed
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        # The items' words one after another, with one that no document has at the end.
        self.flat = np.concatenate([*words, np.zeros(1, np.uint64)])
        keys = [ngrams(w, seed) for w in words]
        self.widths = sorted({min(seed, int(n)) for n in self.sizes if n})
        item = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        at = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[order], item[order], at[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _met(self, words: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window of the block, start in the document) of shared windows, in portions of bounded size."""
        g = ngrams(words, width)
        maybe = np.flatnonzero(self.sieve[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.key, g[maybe])
        n = np.searchsorted(self.key, g[maybe], side="right") - lo
        lo, maybe, n = lo[n > 0], maybe[n > 0], n[n > 0]
        for a, b in slices(n.tolist(), PORTION):
            own = n[a:b]
            k = np.arange(own.sum()) + np.repeat(lo[a:b] - (np.cumsum(own) - own), own)
            yield k, np.repeat(maybe[a:b], own)

    def matches(self, words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each item that shares a window with a document its maximal matches: starts in item and document, words."""
        found: dict[int, list] = defaultdict(list)
        for width in self.widths:
            if len(words) < width:
                continue
            for k, j in self._met(words, width):
                ok = np.minimum(self.seed, self.sizes[self.item[k]]) == width
                k, j = k[ok], j[ok]
                i, first = self.at[k], self.first[self.item[k]]
                # A maximal match begins where the words before differ, or where there is none.
                ok = (i == 0) | (j == 0) | (self.flat[first + i - 1] != words[j - 1])
                k, i, j, first = k[ok], i[ok], j[ok], first[ok]
                if not len(k):
                    continue
                size = self.sizes[self.item[k]]
                n = np.full(len(k), width)
                going = np.arange(len(k))
                while len(going):  # all matches grow by a word, but those that have ended
                    a, b = i[going] + n[going], j[going] + n[going]
                    going, a, b = (x[(a < size[going]) & (b < len(words))] for x in (going, a, b))
                    going = going[self.flat[first[going] + a] == words[b]]
                    n[going] += 1
                order = np.argsort(self.item[k], kind="stable")
                which, cuts = np.unique(self.item[k][order], return_index=True)
                for x, a, b in zip(which.tolist(), cuts, [*cuts[1:], len(order)], strict=True):
                    found[x].append((i[order[a:b]], j[order[a:b]], n[order[a:b]]))
        return {x: tuple(np.concatenate([p[c] for p in parts]) for c in range(3)) for x, parts in found.items()}

    def covered(self, words: np.ndarray, coverage: float, text: str | None = None) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, item words, covered words, tiles, words of the longest tile) of each item that is in a document. With
        the document's text, the words of each tile are compared themselves, so that no chance of a fingerprint counts."""
        own = None
        for x, (i, j, n) in self.matches(words).items():
            size = int(self.sizes[x])
            edge = np.zeros(size + 1, np.int64)
            np.add.at(edge, i, 1)
            np.add.at(edge, i + n, -1)
            if (np.cumsum(edge)[:-1] > 0).sum() < coverage * size - 1e-9:
                continue  # not even all matches together reach it
            tiles = mark(size, zip(i.tolist(), j.tolist(), n.tolist(), strict=True), min(self.seed, size))
            if text is not None and sum(t[2] for t in tiles) >= coverage * size - 1e-9:
                own = plain_words(text) if own is None else own
                theirs = plain_words(self.texts[x])
                tiles = [t for t in tiles if theirs[t[0] : t[0] + t[2]] == own[t[1] : t[1] + t[2]]]
            total = sum(t[2] for t in tiles)
            if tiles and total >= coverage * size - 1e-9:
                yield self.ids[x], size, total, len(tiles), max(t[2] for t in tiles)


def benchmark_blocks(benchmark: DataFrame, seed: int = SEED, item_id_col: str = "item_id", item_text_col: str = "text") -> Iterator[Seeds]:
    """The benchmark's items with words, in blocks of bounded size, one at a time on the driver."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t")).filter("trim(t) != ''")
    held, chars = [], 0
    for r in items.toLocalIterator():
        if held and (chars + len(r["t"]) > BLOCK_CHARS or len(held) >= BLOCK_ITEMS):
            yield Seeds([h[0] for h in held], [h[1] for h in held], seed)
            held, chars = [], 0
        held.append((r["i"], r["t"]))
        chars += len(r["t"])
    if held:
        yield Seeds([h[0] for h in held], [h[1] for h in held], seed)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE, **item_cols: str) -> DataFrame:
    """One row for each document and benchmark item in it: doc_id, item_id, item_words, covered_words, n_tiles,
    longest_tile, coverage.

    Words are runs of letters and digits, A-Z lower-cased; whole texts are read. An item with fewer words than a seed is
    one window; one without words, or null, is in no document. Null documents count as empty. Repeated rows give repeated
    results. An empty table on either side gives an empty result. A benchmark of many blocks is one pass over the
    documents for each.
    """
    schema = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, longest_tile long, coverage double"
    spark, rows = docs.sparkSession, doc_frame(docs, id_col, text_col)

    def against(block: Seeds) -> DataFrame:
        seeds = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, kinds = seeds.value, [pa.int64()] * 6 + [pa.float64()]
            for batch in batches:
                ids, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
                for a, b in slices([len(t) for t in texts]):
                    for i, t, w in zip(ids[a:b], texts[a:b], texts_words(texts[a:b], ALNUM), strict=True):
                        out += [(i, *x, x[2] / x[1]) for x in own.covered(w, coverage, t)]
                yield pa.record_batch([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names=["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "longest_tile", "coverage"])

        return rows.mapInArrow(run, schema)

    found, work = None, None
    for block in benchmark_blocks(benchmark, seed, **item_cols):
        if found is not None:  # of many blocks each result is written before the next is broadcast
            work = work or Workspace(spark, "contamination")
            found = work.keep(found, "found")
        found = against(block) if found is None else found.unionByName(against(block))
    return spark.createDataFrame([], schema) if found is None else found


def holds_item(spark: SparkSession, block: Seeds, coverage: float = COVERAGE):
    """A function of a text column: whether an item of the block is in the text."""
    seeds = spark.sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def holds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            own = [t or "" for t in batch]
            parts = ((own[a:b], texts_words(own[a:b], ALNUM)) for a, b in slices([len(t) for t in own]))
            found = [any(True for _ in seeds.value.covered(w, coverage, t)) for ts, ws in parts for t, w in zip(ts, ws, strict=True)]
            yield pd.Series(found, dtype="bool")

    return holds


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE, **item_cols: str) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay. Each row is decided where it is read, by
    its whole text alone: null and empty texts and rows without an id stay or go like others, repeated rows together. An
    empty benchmark, or one of null and empty items, takes nothing out. An item of fewer words than a seed takes out every
    document that holds it whole. Of a benchmark of many blocks what is left is written before the next is broadcast."""
    work, first = None, True
    for block in benchmark_blocks(benchmark, seed, **item_cols):
        if not first:
            work = work or Workspace(docs.sparkSession, "decontaminate")
            docs = work.keep(docs, "left")
        docs, first = docs.filter(~holds_item(docs.sparkSession, block, coverage)(F.col(text_col))), False
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    return contamination(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
