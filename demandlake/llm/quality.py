"""Quality rules: per-document rules plus cross-document line frequency.

Lines are normalised (ASCII letters lower-cased, digits to 0, runs of white space to one space) and
hashed. Per host, the number of distinct documents that hold a line is counted, exact copies of a
document once. Lines in more than ``max_docs`` documents of their host are boilerplate and are
removed; a document left with less than ``min_rest`` of its words is depleted and rejected.

Counts are partial aggregates; the line table meets the frequent lines in a join that adaptive
execution can split, so a line that every document holds lands in no single task.

Defined results: null text has no words and fails the base rules; documents without words have no
lines; a null host is a host of its own; repeated rows and copies count as one document; other
columns are ignored (``judge``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, raw_texts, save, table, texts, with_columns

MAX_DOCS, MIN_REST = 50, 0.2
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
DIGITS = re.compile(rb"[0-9]")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words inside a window of ``size`` words that occurs at least twice, its first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += ids[k:k + n] * _MIX[k % len(_MIX)]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    if not len(same):
        return 0
    a, z = order[same], order[same + 1]
    if any(not np.array_equal(ids[a + k], ids[z + k]) for k in range(size)):  # a collision: compare the windows themselves
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(words[i:i + size]), []).append(i)
        hit = np.array([i for own in seen.values() if len(own) > 1 for i in own], np.int64)
    else:
        hit = np.unique(np.concatenate([a, z]))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "surrogatepass")) if words else 0
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, sum(text.count(SYMBOLS[k:k + 1]) for k in range(len(SYMBOLS))), dup, repeated_words(words)


def line_hashes(text: bytes) -> tuple[list[int], list[int]]:
    """Hash of each distinct normalised line with a word, and the words of all its occurrences."""
    out: dict[int, int] = {}
    for line in text.lower().split(b"\n"):
        words = line.split()
        if words:
            key = xxhash.xxh64_intdigest(DIGITS.sub(b"0", b" ".join(words))) - (1 << 63)
            out[key] = out.get(key, 0) + len(words)
    return list(out), list(out.values())


def profile(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per input row: base counts, content hash and its distinct lines."""
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            values = raw_texts(b)
            counts = np.array([base_counts(t) for t in values], np.int64).reshape(-1, 5)
            lines = [line_hashes(t) for t in values]
            sizes = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in lines])]), pa.int32())
            flat = lambda j, kind, s=sizes, own=lines: pa.ListArray.from_arrays(s, pa.array([x for r in own for x in r[j]], kind))
            content = pa.array([xxhash.xxh64_intdigest(t, 7) - (1 << 63) for t in values], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(counts[:, k]) for k in range(5)), content, flat(0, pa.int64()), flat(1, pa.int32())],
                                             names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines", "line_words"])

    return arrow_map(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, content long, lines array<long>, line_words array<int>")


def _common_lines(rows: DataFrame, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """(host_key, content, line, words) of each distinct document's lines, and (host_of, line_of) of those in over ``max_docs`` of their host's."""
    # one carrier per distinct document of a host gives its lines; all rows of it share its fate
    own = rows.groupBy("host_key", "content").agg(F.first(F.struct("lines", "line_words")).alias("t")).select("host_key", "content", "t.lines", "t.line_words")
    own = save(own, "quality-texts")
    lines = own.select("host_key", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("host_key", "content", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    common = lines.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs).select(F.col("host_key").alias("host_of"), F.col("line").alias("line_of"))
    return lines, common


def _profiled(docs: DataFrame, host: str) -> DataFrame:
    return save(profile(docs, host).withColumn("host_key", F.xxhash64(F.coalesce("host", F.lit("\0")))), "quality-rows")


def cleaned(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with the lines that over ``max_docs`` documents of their host hold cut out of ``text``; a null text stays null."""
    lines, common = _common_lines(_profiled(docs, host), max_docs)
    met = lines.join(common, (F.col("host_key") == F.col("host_of")) & (F.col("line") == F.col("line_of")))
    cut = met.groupBy(F.col("host_key").alias("__host_of"), F.col("content").alias("__content_of")).agg(F.collect_list("line").alias("__cut"))  # a document's own lines at most
    keyed = with_columns(docs.withColumn("__host", F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("\0")))),
                         lambda b: [pa.array([xxhash.xxh64_intdigest(t, 7) - (1 << 63) for t in raw_texts(b)], pa.int64())], [T.StructField("__content", T.LongType())])
    both = keyed.join(cut, (F.col("__host") == F.col("__host_of")) & (F.col("__content") == F.col("__content_of")), "left")

    def without(text: str | None, gone: list[int] | None) -> str | None:
        if not gone or text is None:
            return text
        drop = set(gone)
        return "\n".join([x for x in text.split("\n") if not drop.intersection(line_hashes(x.encode("utf-8", "surrogatepass"))[0])])

    out = with_columns(both, lambda b: [pa.array(list(map(without, texts(b), texts(b, "__cut"))), pa.string())], [T.StructField("__text", T.StringType())])
    return out.select(*[F.col("__text").alias(c) if c == "text" else F.col(c) for c in docs.columns])


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_rest: float = MIN_REST) -> DataFrame:
    """Base counts, n_removed (words in boilerplate lines) and the verdicts, one row per input row."""
    rows = _profiled(docs, host)
    lines, common = _common_lines(rows, max_docs)
    removed = lines.join(common, (F.col("host_key") == F.col("host_of")) & (F.col("line") == F.col("line_of"))).groupBy("host_key", "content").agg(F.sum("words").alias("n_removed"))
    removed = removed.withColumnsRenamed({"host_key": "host_r", "content": "content_r"})
    got = rows.drop("lines", "line_words").join(removed, (F.col("host_key") == F.col("host_r")) & (F.col("content") == F.col("content_r")), "left")
    n, gone = F.col("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & ((n - gone) >= min_rest * n)).alias("kept"), gone.alias("n_removed"))


def op9_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
