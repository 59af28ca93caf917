"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64-bit SimHash of word shingles (XXH64 of the UTF-8 shingle). Anchors are the
codewords of a covering code, two binary Golay [23,12] codes side by side over the low 46 bits
(perfect codes of covering radius 3 each). Every fingerprint's home is its nearest anchor; it is
replicated to every anchor whose distance exceeds the covering radius by at most the threshold,
summed over the two blocks. If x and y differ in at most ``max_bits`` bits, y is replicated to the
home of x, so joining homes with replicas per anchor misses no link. The comparison of all 64 bits
is the join's condition. Links connect distinct fingerprints (exact copies count once), and
components come from alternating star contraction; a component's label is its smallest id.

Defined results: null, empty or wordless text -> fingerprint 0, linked like any other; fewer words
than the shingle length -> one shingle of all words; repeated rows share a fingerprint and so a
component; a component of null ids only has a null label; an empty table gives no rows. Other
columns are ignored by ``fingerprints`` and kept by ``keep_one``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, raw_texts, save, table, with_columns
from .components import components

SHINGLE, MAX_BITS, SEED = 3, 2, 42
GOLAY_POLY, GOLAY_N, RADIUS = 0xC75, 23, 3  # fixed values: generator x^11+x^10+x^6+x^5+x^4+x^2+1
PIECE_WORDS = 1 << 18  # shingles hashed at a time: bounds memory for long texts


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, a piece at a time."""
    if not words:
        return
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE_WORDS):
        own = words[at:min(at + PIECE_WORDS, n) + size - 1]
        joined, ends = b" ".join(own), np.cumsum([len(w) + 1 for w in own])
        starts = (ends - [len(w) + 1 for w in own]).tolist()
        stops = (ends[min(size, len(own)) - 1:] - 1).tolist()
        yield np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts, stops)), np.uint64, len(stops))


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text.lower().split(), size):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: Column | str = "doc_id", text_col: Column | str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id") if isinstance(id_col, str) else id_col.alias("doc_id"),
                       F.col(text_col).cast("string").alias("text") if isinstance(text_col, str) else text_col.alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t, size) for t in raw_texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return arrow_map(rows, run, "doc_id long, fp long")


@cache
def _error_patterns(max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2048 cosets of the Golay code: the error patterns of weight up to 3 + max_bits.

    Returns (start of each coset, patterns, excess over the radius), patterns ordered by coset and
    then weight, so a coset's first is its leader.
    """
    pats = np.array([sum(1 << i for i in c) for w in range(RADIUS + max_bits + 1) for c in itertools.combinations(range(GOLAY_N), w)], np.uint32)
    weight = np.array([w for w in range(RADIUS + max_bits + 1) for _ in itertools.combinations(range(GOLAY_N), w)])
    syn = _syndrome(pats)
    order = np.lexsort((weight, syn))
    start = np.searchsorted(syn[order], np.arange(2049))
    return start, pats[order], np.maximum(weight[order] - RADIUS, 0)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator polynomial."""
    w = words.astype(np.uint32)
    for i in range(GOLAY_N - 1, 10, -1):
        w = np.where(w >> np.uint32(i) & np.uint32(1), w ^ np.uint32(GOLAY_POLY << (i - 11)), w)
    return w.astype(np.int64)


def anchors(fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Homes of fingerprints, and (index, anchor) of every replica, homes included."""
    start, pats, excess = _error_patterns(max_bits)
    u = fp.view(np.uint64)
    blocks = [((u >> np.uint64(23 * k)) & np.uint64((1 << 23) - 1)).astype(np.uint32) for k in (0, 1)]
    syn = [_syndrome(b) for b in blocks]
    home = sum((b ^ pats[start[s]]).astype(np.int64) << (23 * k) for k, (b, s) in enumerate(zip(blocks, syn)))

    def near(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = start[syn[k] + 1] - start[syn[k]]
        i = np.repeat(np.arange(len(u)), n)
        at = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + start[syn[k]][i]
        return i, blocks[k][i] ^ pats[at], excess[at]

    (i0, a0, e0), (i1, a1, e1) = near(0), near(1)
    idx, out = [], []
    for spent in range(max_bits + 1):  # block 0 at this excess, block 1 with what is left
        m0, m1 = e0 == spent, e1 <= max_bits - spent
        x0, w0, x1, w1 = i0[m0], a0[m0], i1[m1], a1[m1]
        lo, hi = np.searchsorted(x1, x0), np.searchsorted(x1, x0, "right")
        n = hi - lo
        rep = np.repeat(np.arange(len(x0)), n)
        at = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + lo[rep]
        idx.append(x0[rep])
        out.append(w0[rep].astype(np.int64) | w1[at].astype(np.int64) << 23)
    return home, np.concatenate(idx), np.concatenate(out)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that differ in at most ``max_bits`` bits, each once. ``fps``: one column fp, distinct."""

    def homes(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchors(fp, 0)[0]), pa.array(fp)], names=["anchor", "a"])

    def replicas(batches):
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                fp = b.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).astype(np.int64)
                _, i, anchor = anchors(fp, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i])], names=["near", "b"])

    left, right = arrow_map(fps, homes, "anchor long, a long"), arrow_map(fps, replicas, "near long, b long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    # Spark takes the replicas to be as many as the fingerprints and would broadcast them while those are few
    return left.join(right.hint("merge"), (F.col("anchor") == F.col("near")) & (F.col("a") < F.col("b")) & near).select("a", "b")


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of (doc_id, fp): root is the component's
    smallest fingerprint, component_id its smallest id."""
    nodes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    found = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "of")
    return rooted.join(lows, F.col("root") == F.col("of")).select("fp", "root", "component_id")


def near_duplicates(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of (doc_id, fp) with component_id, the smallest id reachable."""
    fps = save(fps, "simhash-fp")
    own = classes(fps, max_bits).select(F.col("fp").alias("of"), "component_id")
    return fps.join(own, fps["fp"] == own["of"]).select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(spark, sf_dir):
    got = near_duplicates(fingerprints(table(spark, sf_dir, "documents")))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Pipeline stage: of each component one row stays, one with the smallest id.

    Rows whose id is null or repeated are told apart by their fingerprint, all others by their id.
    """
    fps = save(fingerprints(docs, size=size), "simhash-fp")
    own = save(classes(fps, max_bits), "simhash-class")
    repeated = fps.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__dd_id"))
    named = fps.join(own.where("component_id IS NOT NULL").withColumnRenamed("fp", "of"), (F.col("fp") == F.col("of")) & (F.col("doc_id") == F.col("component_id")))
    winners = named.select(F.col("doc_id").alias("__dd_id")).distinct().join(repeated, "__dd_id", "left_anti")
    kept = docs.join(winners, docs["doc_id"].cast("long") == F.col("__dd_id"), "left_semi")
    odd = docs.where("doc_id IS NULL").unionAll(docs.join(repeated, docs["doc_id"].cast("long") == F.col("__dd_id"), "left_semi"))
    told = with_columns(odd, lambda b: [pa.array(np.array([simhash(t, size) for t in raw_texts(b)], np.uint64).view(np.int64))], [T.StructField("__dd_fp", T.LongType())])
    told = told.join(own.toDF("__dd_of", "__dd_root", "__dd_low"), F.col("__dd_fp") == F.col("__dd_of"))
    told = told.where(F.col("__dd_low").eqNullSafe(F.col("doc_id").cast("long"))).dropDuplicates(["__dd_root"])
    return kept.unionAll(told.select(*docs.columns))
