"""Token-id output: Parquet list columns, written in id order and read back selectively.

``write`` range-partitions the documents by id, encodes each whole text where it lies and writes
one row per document: id, shard (the range), token count, tokens before it in its shard, and the ids
as a list column. Small integers are delta-encoded (writer version 2, no dictionary) or
dictionary-encoded; row groups and pages have fixed sizes, and the writer adds page indexes, so a
reader can take the metadata columns alone or seek to a range of ids. ``offsets`` turns shard sums,
one row per shard, into global starts.

Defined results: null or empty text -> the end id alone; null ids come first; rows of equal id are
ordered by their text; an empty table gives an empty dataset; other columns are not written.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, scratch_path, table, texts
from .tokens import crc, encoder, vocab_path

ENCODE_STEP = 128  # texts at a time


@dataclass(frozen=True)
class Layout:
    """How the files are laid out."""

    encoding: str = "delta"  # of the ids: delta or dictionary
    row_group_mb: int = 16
    page_kb: int = 256
    index_entries: int = 20_000  # rows a page at most, so that page indexes stay selective

    def options(self) -> dict[str, str]:
        return {"parquet.block.size": str(self.row_group_mb << 20), "parquet.page.size": str(self.page_kb << 10), "parquet.page.row.count.limit": str(self.index_entries),
                "parquet.enable.dictionary": str(self.encoding == "dictionary").lower(), "parquet.writer.version": "v2" if self.encoding == "delta" else "v1", "compression": "zstd"}


def write(docs: DataFrame, path: str, vocab: str, drops_space: bool = True, layout: Layout = Layout()) -> None:
    """Encode ``docs`` (doc_id, text) and write them under ``path`` in ascending id order, part by part."""
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.asc("doc_id")).sortWithinPartitions(F.asc("doc_id"), F.asc("text"))

    def run(batches):
        from pyspark import TaskContext

        shard, before, enc = TaskContext.get().partitionId(), 0, encoder(vocab, drops_space)
        for b in batches:
            for at in range(0, b.num_rows, ENCODE_STEP):
                part = b.slice(at, ENCODE_STEP)
                ids, cuts = enc.encode_lists(texts(part))
                sizes, ends = np.diff(cuts, prepend=0), before + cuts
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]), pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(cuts), shard, np.int32)), pa.array(sizes), pa.array(ends - sizes), lists], names=["doc_id", "shard", "n_tokens", "before", "ids"])
                before = int(ends[-1])

    out = arrow_map(ordered, run, f"doc_id {id_type.simpleString()}, shard int, n_tokens long, before long, ids array<int>")
    out.write.options(**layout.options()).parquet(path)


def offsets(files: DataFrame) -> DataFrame:
    """(shard, base): tokens of all earlier shards; one row per shard, so its size is that of a file list."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sums.select(F.col("shard").alias("of"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without touching the ids."""
    files = spark.read.parquet(path)
    return files.join(F.broadcast(offsets(files)), F.col("shard") == F.col("of")).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; a filter on doc_id reaches the row groups and pages."""
    files = spark.read.parquet(path)
    return files.join(F.broadcast(offsets(files)), F.col("shard") == F.col("of")).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def op6_token_output(spark, sf_dir, vocab: str | None = None):
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "llm-tokens")
    write(docs, path, vocab or vocab_path("word_bpe_49k.json"))
    got = read_tokens(spark, path)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        for b in batches:
            ids = b.column(3)
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            sums = [crc(flat[a:z].astype("<u4").tobytes()) for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), b.column(1), b.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(got, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
