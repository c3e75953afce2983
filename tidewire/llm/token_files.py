"""Token files: ids and masks as Arrow streams of fixed-size lists, readable in place at any sequence.

A folder holds ``shard-*.arrow`` (equal-length sequences of ids and a mask), ``shard-*.index.arrow`` (one row a document)
and ``manifest`` (one row a shard, Parquet). A shard's documents follow one another without gaps; only the last
sequence of a shard is padded, with the mask false. All record batches of a shard but the last hold the same number of
sequences, so that their bytes lie at equal distances and any sequence is found by arithmetic, without a copy.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import doc_frame, new_folder
from .wordhash import slices

#: Fixed values of the files: ids in a sequence, sequences in a record batch, UTF-8 bytes of text a shard aims at.
SEQ_LEN, BATCH_SEQS, SHARD_BYTES = 2048, 128, 24 << 20
#: Above so many shards they grow with the input, up to this size, before there are more of them; shards whose positions one
#: task adds up.
MANY_SHARDS, LARGE_SHARD, RANGE_SHARDS = 4096, 512 << 20, 1024
#: UTF-8 bytes of text whose words are encoded together; word parts that a worker remembers the ids of.
CHUNK_BYTES, REMEMBERED = 8 << 20, 500_000
#: How byte-level vocabularies write a space and a newline.
SPACE, NEWLINE = "\u0120", "\u010a"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_system(uri: str):
    """The pyarrow file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Letters on whose kind all versions of the tables of characters agree: Latin, Greek, Cyrillic.
LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3f5}\x{400}-\x{481}\x{48a}-\x{52f}"
#: A word (after a newline with that for a first character): a run of letters and the punctuation after it.
_PARTS = rf"\A(?P<part>\n?[{LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~]+)\z"
#: White space that is not one space or newline between other characters.
_NOT_PLAIN = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of a pool, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class WordEncoder:
    """The library's ids of whole texts; words that recur are given to it once.

    Byte-level pre-tokenisation with the library's own pattern never joins what stands on two sides of a single space or
    newline between other characters, nor a run of letters and the punctuation after it; a space goes to the word after it,
    a newline is a token of its own. So a text with only such white space is its words' ids one after another, and a word
    the ids of its letters and of what follows. The distinct parts of many texts are given to the library together, as one
    text, and cut apart again where a token begins with the space (or is the newline) between two; Arrow finds the words
    and numpy puts the ids together.

    Any other text, one that holds an added token such as ``<|endoftext|>``, and every text of another kind of tokenizer is
    given to the library whole. All ways give the ids of ``encode(text, add_special_tokens=False)``. ``special_as_text``
    makes strings of special tokens ordinary text.
    """

    def __init__(self, path: str, dtype: str = "<u2", special_as_text: bool = False):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.dtype, self.width = Tokenizer.from_file(path), dtype, int(dtype[-1])
        self.tok.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before, vocab = made.get("pre_tokenizer") or {}, self.tok.get_vocab(with_added_tokens=True)
        self.by_words = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not made.get("normalizer")
            and not made.get("truncation") and not made.get("padding") and (made.get("model") or {}).get("type") == "BPE" and not made["model"].get("dropout") and NEWLINE in vocab
        )
        self.added = tuple(t["content"] for t in made.get("added_tokens") or () if not (special_as_text and t.get("special")))
        self.newline = vocab.get(NEWLINE, -1)
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True
        # Parts met before, the pool of their ids, and how many each has.
        self.parts, self.pool, self.sizes = pa.array([], pa.string()), np.zeros(0, dtype), np.zeros(0, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def library(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _new_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that are not remembered, one after another, and how many each has."""
        lines = pc.starts_with(parts, "\n").to_numpy(zero_copy_only=False)
        found = []
        for own, gap in ((np.flatnonzero(~lines), " "), (np.flatnonzero(lines), "")):
            ids = self._ids(gap + gap.join(parts.take(pa.array(own)).to_pylist())) if len(own) else np.zeros(0, self.dtype)
            starts = np.flatnonzero(self.spaced[ids] if gap else ids == self.newline)
            if len(starts) != len(own):
                raise ValueError("the tokenizer joins words over white space")
            found.append((own, ids, np.diff(np.append(starts, len(ids)))))
        order = np.argsort(np.concatenate([f[0] for f in found]), kind="stable")
        sizes = np.concatenate([f[2] for f in found])
        return _gather(np.concatenate([f[1] for f in found]), _starts(sizes)[order], sizes[order]), sizes[order]

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, one after another, and how many each has."""
        at = pc.index_in(parts, value_set=self.parts)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        fresh = parts.filter(pa.array(new))
        pool, sizes = self._new_parts(fresh)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        at[new] = len(self.parts) + np.arange(len(fresh))
        every, everyone = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, pool])
        out, n = _gather(everyone, _starts(every)[at], every[at]), every[at]
        if len(every) <= REMEMBERED:
            self.parts, self.pool, self.sizes = pa.concat_arrays([self.parts, fresh]), everyone, every
        else:  # what was met now stays, all else is forgotten
            self.parts, self.pool, self.sizes = parts, out, n
        return out, n

    def _plain_ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts with single spaces and newlines alone. A text is read as if it followed a newline, whose id is cut off."""
        cut = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        words = pc.dictionary_encode(cut.flatten())
        kinds = words.dictionary
        match = pc.extract_regex(kinds, _PARTS)
        parts = pc.dictionary_encode(pc.coalesce(pc.struct_field(match, "part"), kinds))
        tails = pc.dictionary_encode(pc.fill_null(pc.struct_field(match, "tail"), ""))
        pool, n = self._parts(parts.dictionary)
        ends = [self._ids(t) if t else np.zeros(0, self.dtype) for t in tails.dictionary.to_pylist()]
        p, t = parts.indices.to_numpy(), tails.indices.to_numpy()
        # Each distinct word is its part and its tail.
        every = np.concatenate([n, [len(e) for e in ends]]).astype(np.int64)
        both = np.column_stack([p, t.astype(np.int64) + len(n)]).ravel()
        pool, n = _gather(np.concatenate([pool, *ends]), _starts(every)[both], every[both]), n[p] + every[len(n) :][t]
        at = words.indices.to_numpy()
        data = _gather(pool, _starts(n)[at], n[at]).tobytes()
        edge = np.concatenate([[0], np.cumsum(n[at])])[cut.offsets.to_numpy() - cut.offsets[0].as_py()] * self.width
        edge = edge.tolist()
        return [data[a + self.width : b] for a, b in zip(edge, edge[1:], strict=False)]

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts have no white space but single spaces and newlines between other characters, and no added token."""
        other = pc.match_substring_regex(texts, _NOT_PLAIN)
        for a in self.added:
            other = pc.or_(other, pc.match_substring(texts, a))
        return ~other.to_numpy(zero_copy_only=False) & self.by_words

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes. Null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        plain = self.plain(texts)
        out = self._plain_ids(texts.filter(pa.array(plain))) if plain.any() else []
        if plain.all():
            return out
        quick = iter(out)
        return [next(quick) if ok else self.library(t.as_py()) for ok, t in zip(plain, texts, strict=True)]


@lru_cache(maxsize=2)
def encoder_for(path: str, dtype: str, special_as_text: bool) -> WordEncoder:
    """One encoder for all tasks that a worker runs."""
    return WordEncoder(path, dtype, special_as_text)


def sequences_type(seq_len: int, dtype: str) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.uint16() if dtype == "<u2" else pa.uint32(), False), seq_len)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), seq_len))])


class ShardWriter:
    """Writes one shard: its sequences and its index."""

    def __init__(self, fs, path: str, seq_len: int, dtype: str):
        self.seq_len, self.dtype, self.schema = seq_len, dtype, sequences_type(seq_len, dtype)
        self.sinks = [fs.open_output_stream(f"{path}.arrow"), fs.open_output_stream(f"{path}.index.arrow")]
        self.data, self.index = pa.ipc.new_stream(self.sinks[0], self.schema), pa.ipc.new_stream(self.sinks[1], INDEX)
        self.pending, self.held, self.total, self.n_docs = [], 0, 0, 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // int(self.dtype[-1])
        self.rows.append((doc_id, self.total, n))
        self.total, self.n_docs = self.total + n, self.n_docs + 1
        self.pending.append(ids)
        self.held += n
        if self.held >= self.seq_len * BATCH_SEQS:
            self._flush(False)
        if len(self.rows) >= 10_000:
            self._rows()

    def _rows(self) -> None:
        if self.rows:
            self.index.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in zip(*self.rows, strict=True)], schema=INDEX))
            self.rows = []

    def _flush(self, last: bool) -> None:
        ids, step = np.frombuffer(b"".join(self.pending), self.dtype), self.seq_len * BATCH_SEQS
        at = 0
        while len(ids) - at >= step or last and at < len(ids):
            part = ids[at : at + step]
            at += len(part)
            pad = -len(part) % self.seq_len
            full = np.concatenate([part, np.zeros(pad, part.dtype)]) if pad else part
            mask = np.arange(len(full)) < len(part)
            self.data.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((full, mask), self.schema, strict=True)], schema=self.schema))
        self.pending, self.held = [ids[at:].tobytes()], len(ids) - at

    def close(self) -> None:
        self._flush(True)
        self._rows()
        for x in (self.data, self.index, *self.sinks):
            x.close()


class TokenShard:
    """Random access to one shard, by what the file itself says of its batches.

    All batches but the last are of one size in sequences and in bytes, so the k-th is found by arithmetic and read alone.
    Over a local or mounted file the arrays are views of the mapped bytes, without a copy; elsewhere one batch is fetched.
    """

    def __init__(self, uri: str):
        from pyarrow import fs as pafs

        fs, path = file_system(uri)
        with fs.open_input_file(f"{path}.index.arrow") as src:
            self.index = pa.ipc.open_stream(src).read_all()
        self.total = int(np.sum(self.index.column("n_tokens").to_numpy())) if len(self.index) else 0
        local = isinstance(fs, pafs.LocalFileSystem)
        self.src = (pa.memory_map if local else fs.open_input_file)(f"{path}.arrow")
        self.schema = pa.ipc.read_schema(self.src)
        self.seq_len, self.first = self.schema.field("ids").type.list_size, self.src.tell()
        self.kept: dict[int, pa.RecordBatch] = {}
        self.batch_seqs, self.stride = max(1, len(self)), 0
        if self.total:
            self.batch_seqs = self.batch(0).num_rows
            self.stride = self.src.tell() - self.first

    def __len__(self) -> int:
        return -(-self.total // self.seq_len)

    def batch(self, k: int) -> pa.RecordBatch:
        """The k-th batch; the last one asked for is kept."""
        if k not in self.kept:
            self.src.seek(self.first + k * self.stride)
            self.kept = {k: pa.ipc.read_record_batch(pa.ipc.read_message(self.src), self.schema)}
        return self.kept[k]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The i-th sequence's ids (a view) and its mask."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        b, at = self.batch(i // self.batch_seqs), i % self.batch_seqs
        ids, mask = (b.column(c).values.slice((b.column(c).offset + at) * self.seq_len, self.seq_len) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids of the positions from ``start`` on; one view if they lie in one batch."""
        step, parts = self.seq_len * self.batch_seqs, []
        while n > 0:
            b, at = self.batch(start // step), start % step
            take = min(n, step - at)
            parts.append(b.column("ids").values.slice(b.column("ids").offset * self.seq_len + at, take).to_numpy(zero_copy_only=True))
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u2")


def text_bytes(docs: DataFrame, text: str) -> int:
    """About how many bytes of text there are, to choose a number of shards: twice the size of the files where the table is
    read from files, so that no text is read for it; counted otherwise."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if leaves.size() == 1 and leaves.head().getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2ScanRelation"):
        return 2 * int(leaves.head().stats().sizeInBytes())
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    out: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    shard_bytes: int = SHARD_BYTES,
    wide: bool = False,
    special_as_text: bool = False,
) -> DataFrame:
    """Encode every whole text and write the folder ``out``; returns its manifest, one row a shard.

    Documents stand in ascending doc_id order over all shards; a row without an id comes first, rows of one id stand in
    the order of their texts. Null text counts as empty and is written as the end id alone. Very long texts are encoded
    whole. An empty table gives no shard. A text of one document stays in one shard. ``wide`` stores 32-bit ids, for
    vocabularies over 65,536. ``special_as_text``: strings of special tokens are ordinary text, not their ids.

    A task writes under a name of its own and reports it; only names in the committed manifest count, so that a task that
    ran twice or an executor that was lost leaves no doubt. ``tokenizer_path`` is read on the executors.
    """
    dtype = "<u4" if wide else "<u2"
    end = np.array([end_id], dtype).tobytes()
    rows = doc_frame(docs, id_col, text_col)
    shards = shard_count(text_bytes(docs, text_col), shard_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, first = None, None, None
        name = f"shard-{uuid.uuid4().hex}"
        for batch in batches:
            if writer is None and batch.num_rows:
                fs, root = file_system(out)
                fs.create_dir(root, recursive=True)
                encoder, writer, first = encoder_for(tokenizer_path, dtype, special_as_text), ShardWriter(fs, f"{root}/{name}", seq_len, dtype), batch.column(0)[0].as_py()
            for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), CHUNK_BYTES):
                for i, x in zip(batch.column(0)[a:b].to_pylist(), encoder.encode(batch.column(1)[a:b]), strict=True):
                    writer.add(i, x + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "first_id": first, "n_docs": writer.n_docs, "n_tokens": writer.total}], schema=pa.schema([("name", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(write, "name string, first_id long, n_docs long, n_tokens long")
    written = written.withColumn("part", F.spark_partition_id())
    written.write.parquet(f"{out}/manifest")
    return docs.sparkSession.read.schema(written.schema).parquet(f"{out}/manifest")


def shard_count(size: int, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for so many bytes: of ``shard_bytes`` each up to ``MANY_SHARDS``, then as many and larger, then of
    ``LARGE_SHARD``. Writing and sorting stream, so a large shard takes no more memory."""
    return max(1, min(-(-size // shard_bytes), max(MANY_SHARDS, -(-size // max(LARGE_SHARD, shard_bytes)))))


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's first position among all ids: sums within ranges of ``RANGE_SHARDS``, after the sum of the
    ranges before, of which there is one row for every ``RANGE_SHARDS`` shards."""
    ranged = manifest.withColumn("_range", F.floor(F.col("part") / F.lit(RANGE_SHARDS)))
    within, before = Window.partitionBy("_range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_range").agg(F.sum("n_tokens").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(ranges, "_range").withColumn("shard_start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).drop("_range", "_before")


def read_token_digest(spark: SparkSession, out: str) -> DataFrame:
    """Read a folder back: doc_id, start, n_tokens, ids_crc32 and the shard of each document. Each shard has a task of its own."""
    manifest = spark.read.parquet(f"{out}/manifest")
    n = (manifest.agg(F.max("part")).first()[0] or 0) + 1
    manifest = with_starts(manifest)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = TokenShard(f"{out}/{name}")
                for rows in shard.index.to_batches():
                    starts, counts = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                    crc = [zlib.crc32(shard.ids(int(s), int(c)).astype("<u4").tobytes()) for s, c in zip(starts, counts, strict=True)]
                    yield pa.record_batch([rows.column(0), pa.array(starts + at), rows.column(2), pa.array(crc, pa.int64()), pa.array([name] * len(crc))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return manifest.select("name", "shard_start", "part").repartitionById(n, F.col("part")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all of ``documents`` with the public byte-level vocabulary, write the files, read them back."""
    import public_tokenizers

    out = new_folder(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_token_digest(spark, out)


__all__ = ["ShardWriter", "TokenShard", "WordEncoder", "op1_token_files", "read_token_digest", "with_starts", "write_token_files"]
