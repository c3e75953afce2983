"""Best-fit packing under conflicts: bins ordered by what is left in them, with bitmaps of the sources and clusters inside."""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_or_empty

#: Units (words, unless a length column is named) a bin holds; documents and UTF-8 bytes of text that are packed together on
#: average.
CAPACITY, BLOCK_DOCS, BLOCK_BYTES = 2048, 2048, 32 << 20
#: Rows alike in id, source, class, length and text that go to one block together; rows of one text that a task repeats.
ALIKE, REPEATS = 16, 4096
#: Blocks a task packs, one after another, where there are many.
TASK_BLOCKS = 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64()), ("text", pa.string())])


def words_in(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given. Pieces of one source or one cluster never share a bin; -1 conflicts
    with nothing.

    Bins are ordered by residual, then number. A piece goes to the first bin from its own length on (the tightest) whose
    bitmaps have neither its source nor its cluster; the search moves on to the next larger residual until one fits. If
    none does, it opens a bin.
    """
    order: list[tuple[int, int]] = []
    with_source, with_cluster, used, out = [], [], [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        bit_s, bit_c = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        for k in range(bisect_left(order, (n, -1)), len(order)):
            b = order[k][1]
            if not (with_source[b] & bit_s or with_cluster[b] & bit_c):
                del order[k]
                break
        else:
            b = len(used)
            used.append(0)
            with_source.append(0)
            with_cluster.append(0)
        out.append((b, used[b]))
        used[b] += n
        with_source[b] |= bit_s
        with_cluster[b] |= bit_c
        if used[b] < capacity:
            insort(order, (capacity - used[b], b))
    return out


def _numbered(values: list) -> list[int]:
    """Small numbers for values; -1 for none."""
    seen: dict = {}
    return [-1 if v is None else seen.setdefault(v, len(seen)) for v in values]


def cut_text(text: str, n_words: int, capacity: int) -> list[str]:
    """A text of so many words as pieces of ``capacity`` words; white space stays behind the word before it, or at the
    start, so that the pieces together are the text."""
    if n_words <= capacity:
        return [text]
    starts = [m.start() for k, m in enumerate(_WORD.finditer(text)) if k % capacity == 0]
    return [text[a:b] for a, b in zip([0, *starts[1:]], [*starts[1:], len(text)], strict=True)]


def dealt_copies(rows: DataFrame) -> DataFrame:
    """Rows with a ``turn``: rows that are alike (in the hash of that name) take turns of ``ALIKE``. They are counted before they
    are shuffled, and written out again by ``REPEATS`` in tasks of their own, so that none is in one task with all others."""
    one = rows.groupBy("alike").agg(F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in rows.columns if c != "alike"))
    many = one.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / F.lit(REPEATS)))))
    spread = many.repartition("alike", "lot").withColumn("here", F.least(F.lit(REPEATS), F.col("rows") - F.col("lot") * REPEATS))
    copies = spread.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("here") - 1)))
    return copies.withColumn("turn", F.floor((F.col("lot") * REPEATS + F.col("k")) / F.lit(ALIKE))).select(*rows.columns, "turn")


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    source_col: str | None = "source",
    cluster: Column | None = None,
    block_docs: int = BLOCK_DOCS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row a piece of a document: doc_id, piece, start, length, bin_id, bin_offset, text.

    A document longer than a bin is cut: its full pieces fill bins of their own and the rest is packed. Documents of one
    source or one duplicate cluster never share a bin; ``cluster`` names the class of a row, such as that of its near
    duplicates (by default: equal texts). A null source or class conflicts with nothing. Empty and null texts have one piece
    of length 0 without a bin; null and negative lengths count as 0. Rows without an id are packed like others, rows that
    repeat an id are each packed. An empty table gives an empty result; other columns are ignored. Texts of pieces in order
    are the document's text, all white space included; with ``length``, whose unit is unknown, a text is not cut: it stands
    with piece 0.

    Documents are dealt by a hash of all that is read of them into blocks of ``block_docs`` documents and ``block_bytes`` of
    text at most, on average; a block is packed alone, in order of falling length, then id, then cluster, so that the result
    depends on the rows and their number only. A hot source or cluster is dealt over all blocks like any other. Rows that are
    alike are counted and dealt by ``ALIKE``, however many they are. A block's texts are in one task's memory.
    """
    text = text_or_empty(text_col)
    size = length if length is not None else words_in(F.col(text_col))
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    own = (cluster if cluster is not None else F.xxhash64(text, F.octet_length(text))).cast("long")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), own.alias("cluster"), text.alias("text"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    base = read.withColumn("alike", F.xxhash64("doc_id", "source", "cluster", "text", *(["n"] if length is not None else [])))
    counted = base.groupBy("alike").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    rows_, bytes_, most = counted.agg(F.sum("rows"), F.sum("bytes"), F.max("rows")).first()
    blocks = max(1, -(-(rows_ or 0) // block_docs), -(-(bytes_ or 0) // block_bytes))
    base = dealt_copies(base) if (most or 0) > ALIKE else base.withColumn("turn", F.lit(0).cast("long"))
    rows = base.select("*", F.pmod(F.xxhash64("alike", "turn"), F.lit(blocks)).alias("block")).drop("turn")
    by_words = length is None
    # Tasks hold so many blocks at any size of the table; few blocks are dealt over the tasks there are.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(-(-blocks // TASK_BLOCKS), min(blocks, parts)), "block")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, sources, sizes, clusters, alike = (table.column(c).to_pylist() for c in ("doc_id", "source", "n", "cluster", "alike"))
        texts, base = table.column("text"), key[0].as_py() << 32
        order = sorted(range(len(ids)), key=lambda r: (-sizes[r], ids[r] is None, ids[r] or 0, clusters[r] is None, clusters[r] or 0, alike[r]))
        source, group = _numbered(sources), _numbered(clusters)
        rests, out, full = [], [], 0
        for r in order:
            whole, rest = divmod(sizes[r], capacity)
            own = texts[r].as_py()
            own = cut_text(own, sizes[r], capacity) if by_words else [own]
            own += [""] * (whole + 1 - len(own))
            for k in range(whole):
                out.append((ids[r], k, k * capacity, capacity, base + full, 0, own[k]))
                full += 1
            if rest:
                rests.append((rest, ids[r], source[r], group[r], whole, own[whole]))
            elif not whole:
                out.append((ids[r], 0, 0, 0, None, None, own[0]))
        rests.sort(key=lambda r: -r[0])  # stable: ids stay in order within one length
        for (n, i, _, _, k, t), (b, at) in zip(rests, best_fit([r[0] for r in rests], [r[2] for r in rests], [r[3] for r in rests], capacity), strict=True):
            out.append((i, k, k * capacity, n, base + full + b, at, t))
        return pa.table([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_PIECES)], schema=_PIECES)

    return rows.groupBy("block").applyInArrow(run, "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, text string")


def bins_of(packed: DataFrame) -> DataFrame:
    """One row a bin: bin_id, n_pieces, length, pieces (doc_id, piece, text, in order). A bin holds its capacity at most."""
    pieces = F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "piece", "text")))
    found = packed.filter("bin_id is not null").groupBy("bin_id").agg(pieces.alias("pieces"), F.sum("length").alias("length"))
    return found.select("bin_id", F.size("pieces").alias("n_pieces"), "length", F.transform("pieces", lambda p: p.dropFields("bin_offset")).alias("pieces"))


def fill_rate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, least_bins (that hold as much without conflicts or whole pieces), and the share of room used."""
    total = packed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("units"), F.countDistinct("bin_id").alias("bins"))
    return total.select("bins", F.ceil(F.col("units") / F.lit(capacity)).alias("least_bins"), F.when(F.col("bins") > 0, F.col("units") / (F.col("bins") * F.lit(capacity))).alias("fill"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, by words; equal texts are one cluster."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
