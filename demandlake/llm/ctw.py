"""Language-model scoring by context-tree weighting over byte contexts.

A text is scored as its words, lower-cased in A-Z, with a space between them and an end byte. Each
byte is eight binary decisions; a decision's node is the bits of the byte before it. For every
context of the last 0 to ``DEPTH`` bytes and every node, the Krichevsky-Trofimov estimator counts
the training bits, and a context's weighted probability is half its own KT probability and half the
product of its extensions' (deepest contexts: their own). The weight a context keeps,
``KT / 2 / weighted``, mixes the estimates of all depths; a path ends at the deepest context that
training has visited.

Where the work lies: each task cuts its texts into blocks of about ``BLOCK_BYTES`` and writes, once,
their compressed texts and their distinct (DEPTH+1)-grams and words with training counts. Counts are
summed over all blocks by shuffles. Grams that share their last two context bytes form whole subtrees
of the context tree, so levels 2 and deeper are weighted and mixed inside such partitions; levels 0
and 1 (at most 255 and 65,280 nodes) are weighted on the driver and broadcast. Each block gets back
the log-probabilities of its own grams and the counts of its own words where they differ from the
block's. The tree and the vocabulary grow with the corpus and stay distributed.

``bits_per_byte`` is the model's code length, in bits per byte of the text as it is scored, the end byte
included.

Defined results: null or empty text -> the end token only; no training text -> every bit costs one
bit; repeated rows count once each; null ids train; other columns are ignored. Words are told apart
by their 64-bit hash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, raw_texts, remainder, save, scratch_path, ship_package, table

DEPTH = 5
BLOCK_BYTES = 28 << 20
PIECE_BYTES = 3 << 20  # positions looked at together
CHUNK_BYTES = 1 << 20  # of text compressed together
END = b"\n"  # no word holds it, and no space follows it
TEXT, GRAM, WORD, TOTAL = -1, 0, 1, 2


def normalise(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END


def _segments(bodies: list[bytes], depth: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Owners and segments, about PIECE_BYTES at a time, under 2**16 of them; each is led by the ``depth`` bytes before it."""
    own, parts, size = [], [], 0
    for i, x in enumerate(bodies):
        for at in range(0, len(x), PIECE_BYTES):
            own.append(i)
            parts.append((x[at - depth:at] if at else END * depth) + x[at:at + PIECE_BYTES])
            size += len(parts[-1])
            if size >= PIECE_BYTES or len(parts) == (1 << 16) - 1:
                yield own, parts
                own, parts, size = [], [], 0
    if own:
        yield own, parts


def _grams(parts: list[bytes], depth: int) -> np.ndarray:
    """The packed (depth + 1)-gram that ends at each byte of each segment."""
    a = np.frombuffer(b"".join(parts), np.uint8)
    g = np.zeros(len(a) - depth, np.uint64)
    for k in range(depth + 1):
        g = (g << np.uint64(8)) | a[k:k + len(g)]
    keep = np.ones(len(g), bool)
    ends = np.cumsum([len(x) for x in parts])[:-1]
    for k in range(1, depth + 1):  # grams over a segment's end
        keep[ends - k] = False
    return g[keep].view(np.int64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, n = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _taken_in(k: np.ndarray, n: np.ndarray, more: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_merge`` of two sorted sets without sorting both anew; ``n`` is changed."""
    at = np.searchsorted(k, more)
    known = at < len(k)
    known[known] = k[at[known]] == more[known]
    n[at[known]] += count[known]
    new = ~known
    at = at[new]
    return np.insert(k, at, more[new]), np.insert(n, at, count[new])


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def block_entries(bodies: list[bytes], train: list[bool], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, distinct keys, training counts) of one block."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for flag in (True, False):
        for _, parts in _segments([x for x, t in zip(bodies, train) if t is flag], depth):
            u, n = np.unique(_grams(parts, depth), return_counts=True)
            held = _taken_in(*held, u, n * int(flag))
    yield GRAM, *held
    del held
    words: Counter = Counter()
    other: set[bytes] = set()
    for x, flag in zip(bodies, train):
        if flag:
            words.update(x.split())
        else:
            other.update(x.split())
    new = other.difference(words)
    n_train = sum(train)
    yield WORD, *_merge([np.array([*map(word_key, words), *map(word_key, new), word_key(END)], np.int64)], [np.array([*words.values(), *[0] * len(new), n_train], np.int64)])
    yield TOTAL, np.zeros(1, np.int64), np.array([sum(words.values()) + n_train], np.int64)


_COLUMNS = ["block", "kind", "key", "n", "ids", "held", "sizes", "blob"]


def _blocked(batches: Iterator[pa.RecordBatch], most: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Cut one task's rows into blocks of about ``most`` bytes; each gives its texts in compressed chunks and its entries."""
    from pyspark import TaskContext

    block, size, held = TaskContext.get().partitionId() << 32, 0, []

    def row(kind, key, n, ids, held, sizes, blob):
        m = len(kind)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(kind, pa.int8()), key, n, ids, held, sizes, blob], names=_COLUMNS)

    def flush():
        bodies, train = [x for _, _, some in held for x in some], [not t for _, h, _ in held for t in h]
        for ids, h, some in held:
            ends, a = np.cumsum([len(x) for x in some]), 0
            while a < len(some):
                z = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_BYTES, "right")), a + 1)
                lists = [pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), v) for v in
                         (ids.slice(a, z - a), pa.array(h[a:z], pa.bool_()), pa.array([len(x) for x in some[a:z]], pa.int64()))]
                blob = pa.compress(b"".join(some[a:z]), "zstd", asbytes=True)
                yield row([TEXT], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *lists, pa.array([blob], pa.binary()))
                a = z
        nothing = lambda m: (pa.nulls(m, pa.list_(ids.type)), pa.nulls(m, pa.list_(pa.bool_())), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary()))
        for kind, key, count in block_entries(bodies, train, depth):
            for at in range(0, len(key), 1 << 17):
                k, n = key[at:at + (1 << 17)], count[at:at + (1 << 17)]
                yield row(np.full(len(k), kind, np.int8), pa.array(k), pa.array(n), *nothing(len(k)))

    for b in batches:
        bodies, h = [normalise(t) for t in raw_texts(b)], b.column(1).to_pylist()
        ends = np.cumsum([len(x) for x in bodies])
        at = 0
        while at < len(bodies):
            base = int(ends[at - 1]) if at else 0
            z = max(int(np.searchsorted(ends, base + most - size, "right")), at)
            if z == at and not size:
                z = at + 1  # a text longer than a block
            if z > at:
                held.append((b.column(0).slice(at, z - at), h[at:z], bodies[at:z]))
                size += int(ends[z - 1]) - base
                at = z
            if at < len(bodies):
                yield from flush()
                block, size, held = block + 1, 0, []
    if held:
        yield from flush()


def _texts(t: pa.Table) -> tuple[pa.Array, list[bool], list[bytes]]:
    """(ids, held out, texts) of a block's chunks."""
    ids, held, bodies = [], [], []
    for own, h, sizes, blob in zip(*(t.column(c).combine_chunks() for c in ("ids", "held", "sizes", "blob"))):
        ids.append(own.values)
        held += h.as_py()
        n = np.array(sizes.as_py(), np.int64)
        raw = pa.decompress(blob.as_py(), int(n.sum()), "zstd", asbytes=True)
        ends = np.cumsum(n).tolist()
        bodies += [raw[a:z] for a, z in zip([0, *ends], ends)]
    return pa.concat_arrays(ids), held, bodies


# ---- the context tree


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2: Stirling's series after a shift by 8 (error below 1e-12)."""
    z, shift = x + 8.0, np.zeros_like(x)
    for k in range(0, 8, 2):
        shift += np.log((x + k) * (x + k + 1))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7) - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the KT probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def _weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln weighted probability, P(1), own weight) of nodes; ``below``: sum over their extensions."""
    kt, p1 = _log_kt(n0, n1), (n1 + 0.5) / (n0 + n1 + 1.0)
    if below is None:
        return kt, p1, np.ones(len(kt))
    pw = np.logaddexp(kt, below) - math.log(2)
    return pw, p1, np.exp(kt - math.log(2) - pw)


#: A level: for each number of known bits 0..7, (sorted node keys, P(1), own weight). A node's key is its
#: context, the most recent byte on top, followed by the known bits.
Level = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _reversed_context(gram: np.ndarray, depth: int) -> np.ndarray:
    """Context bytes of packed grams, the most recent one on top."""
    ctx, out = gram >> 8, np.zeros_like(gram)
    for _ in range(depth):
        out = (out << 8) | (ctx & 255)
        ctx >>= 8
    return out


def subtrees(gram: np.ndarray, n: np.ndarray, depth: int, top: int = 2) -> tuple[list[Level], Level]:
    """Levels ``top``..``depth`` of the trees above training grams, and of level ``top`` (key, n0, n1, ln weighted) instead."""
    levels: list[Level] = []
    below: list[tuple[np.ndarray, np.ndarray]] | None = None  # of the level above: node keys and ln weighted
    key, n = _merge([(_reversed_context(gram, depth) << 8) | (gram & 255)], [n])
    summit = []
    for d in range(depth, top - 1, -1):
        level, weighted = [], []
        for k in range(8):
            node, bit = key >> (8 - k), (key >> (7 - k)) & 1
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
            own = node[first]
            n1 = (np.add.reduceat(n * bit, first) if len(node) else n).astype(float)
            n0 = (np.add.reduceat(n, first) if len(node) else n).astype(float) - n1
            sums = None
            if below is not None:
                child, pw = below[k]
                parent = ((child >> (8 + k)) << k) | (child & ((1 << k) - 1))
                sums = np.bincount(np.searchsorted(own, parent), pw, len(own))
            pw, p1, w = _weigh(n0, n1, sums)
            level.append((own, p1, w))
            weighted.append((own, pw))
            if d == top:
                summit.append((own, n0, n1, pw))
        levels.insert(0, level)
        below = weighted
        key, n = _merge([((key >> 16) << 8) | (key & 255)], [n])
    return levels, summit


def crown(nodes: dict[str, np.ndarray]) -> list[Level]:
    """Levels 0 and 1 from level-1 sums (node: context byte, then 1 and the known bits; n0, n1, below)."""
    ctx, marked = nodes["node"] >> 8, nodes["node"] & 255
    k_of = np.floor(np.log2(np.maximum(marked, 1))).astype(np.int64)
    one, zero = [], []
    for k in range(8):
        m = k_of == k
        bits = marked[m] - (1 << k)
        order = np.argsort((ctx[m] << k) | bits)
        key, n0, n1, below = (x[order] for x in ((ctx[m] << k) | bits, nodes["n0"][m], nodes["n1"][m], nodes["below"][m]))
        pw, p1, w = _weigh(n0, n1, below)
        one.append((key, p1, w))
        own, at = np.unique(key & ((1 << k) - 1), return_inverse=True)
        _, p1, w = _weigh(np.bincount(at, n0, len(own)), np.bincount(at, n1, len(own)), np.bincount(at, pw, len(own)))
        zero.append((own, p1, w))
    return [zero, one]


def gram_log10(gram: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """log10 probability of each gram's last byte after the others."""
    rev, byte = _reversed_context(gram, depth), gram & 255
    total = np.zeros(len(gram))
    for k in range(8):
        a, r, p, w = np.zeros(len(gram)), np.ones(len(gram)), np.full(len(gram), 0.5), np.zeros(len(gram))
        for d, level in enumerate(levels):
            own, p1, weight = level[k]
            if not len(own):
                continue
            key = ((rev >> (8 * (depth - d))) << k) | (byte >> (8 - k))
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            seen = own[at] == key
            a = np.where(seen, a + r * w * p, a)
            r = np.where(seen, r * (1 - w), r)
            p, w = np.where(seen, p1[at], p), np.where(seen, weight[at], w)
        one = a + r * p
        total += np.log10(np.where((byte >> (7 - k)) & 1 == 1, one, 1 - one))
    return total


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, score) of (gram, n), for every gram, counted in training or not. ``depth`` is 2 to 6."""
    # whole subtrees together: the last two context bytes are the partition key
    dealt = grams.select("gram", "n").repartition(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF).cast("long")))

    def arrays(batches):
        own = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        gram, n = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (zip(*own) if own else ((), ())))
        return gram, n

    def bottom_up(batches):
        gram, n = arrays(batches)
        _, summit = subtrees(gram[n > 0], n[n > 0], depth)
        for k, (key, n0, n1, pw) in enumerate(summit):
            # level 1 keeps the more recent of the two bytes
            node = ((key >> (8 + k)) << 8) | (1 << k) | (key & ((1 << k) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n0), pa.array(n1), pa.array(pw)], names=["node", "n0", "n1", "pw"])

    sums = arrow_map(dealt, bottom_up, "node long, n0 double, n1 double, pw double").groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below")).toArrow()
    top = crown({c: sums.column(c).to_numpy() for c in ("node", "n0", "n1", "below")})
    shared = grams.sparkSession.sparkContext.broadcast(top)

    def top_down(batches):
        gram, n = arrays(batches)
        levels, _ = subtrees(gram[n > 0], n[n > 0], depth)
        for at in range(0, len(gram), 1 << 17):
            g = gram[at:at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(gram_log10(g, shared.value + levels, depth))], names=["gram", "score"])

    return arrow_map(dealt, top_down, "gram long, score double")


# ---- scoring


def _sum_by_text(bodies: list[bytes], gram: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the values of each body's grams; ``gram`` sorted."""
    out = np.zeros(len(bodies))
    for own, parts in _segments(bodies, depth):
        sizes = np.array([len(x) - depth for x in parts])
        # grams take 48 bits at most, so a segment's number fits beside them and one plain sort groups them
        both = np.sort((_grams(parts, depth).astype(np.uint64) << np.uint64(16)) | np.repeat(np.arange(len(parts), dtype=np.uint64), sizes))
        g = (both >> np.uint64(16)).view(np.int64)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        runs = np.repeat(value[np.searchsorted(gram, g[first])], np.diff(np.append(first, len(g))))
        np.add.at(out, own, np.bincount((both & np.uint64(0xFFFF)).astype(np.int64), runs, len(parts)))
    return out


def score_block(bodies: list[bytes], train: list[bool], gram: np.ndarray, gram_score: np.ndarray, word: np.ndarray, word_n: np.ndarray, total: int, vocab: int, depth: int):
    """(n_tokens, n_known, base_score, score) of each body; ``word``: sorted keys whose count differs from the block's own."""
    scores = _sum_by_text(bodies, gram, gram_score, depth)
    room = total + 0.5 * (vocab + 1)
    local: Counter = Counter({END: sum(train)})
    for x, t in zip(bodies, train):
        if t:
            local.update(x.split())
    index = {w: i for i, w in enumerate(local)}
    for x, t in zip(bodies, train):
        if not t:
            for w in x.split():
                index.setdefault(w, len(index))
    keys, count = np.fromiter(map(word_key, index), np.int64, len(index)), np.zeros(len(index))
    count[:len(local)] = list(local.values())
    if len(word):
        at = np.minimum(np.searchsorted(word, keys), len(word) - 1)
        count = np.where(word[at] == keys, word_n[at], count)
    value, known = np.log10((count + 0.5) / room), count > 0
    n_tokens, n_known, base = [], [], []
    for x in bodies:
        ids = np.fromiter(map(index.__getitem__, [*x.split(), END]), np.int64)
        n_tokens.append(len(ids))
        n_known.append(int(known[ids].sum()))
        base.append(float(value[ids].sum()))
    return n_tokens, n_known, base, scores


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Learn from the rows that are not held out, score all: see the module's text."""
    if not 2 <= depth <= 5:
        raise ValueError("depth is 2 to 5: a gram is packed into 48 bits")
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType
    made = arrow_map(rows, lambda it: _blocked(it, block_bytes, depth), f"block long, kind byte, key long, n long, ids array<{id_type.simpleString()}>, held array<boolean>, sizes array<long>, blob binary")
    path = scratch_path(spark, "llm-ctw-blocks")
    made.write.options(**{"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}).parquet(path)  # sorted keys: delta encoding
    blocked = spark.read.schema(made.schema).parquet(path)
    entries = blocked.where(F.col("kind") != TEXT).select("block", "kind", "key", "n")
    gram_rows, word_rows = entries.where(F.col("kind") == GRAM), entries.where(F.col("kind") == WORD)

    grams = save(gram_rows.groupBy("key").agg(F.sum("n").alias("n")).withColumnRenamed("key", "gram"), "ctw-grams")
    scored = gram_scores(grams, depth)
    gram_back = gram_rows.select("block", "key").join(scored, F.col("key") == F.col("gram")).select(F.col("block").alias("block_of"), F.lit(GRAM).alias("kind"), "key", "score")

    of_word = Window.partitionBy("key")
    words = save(word_rows.select("block", "key", "n", F.sum("n").over(of_word).alias("all"), (F.col("block") == F.min("block").over(of_word)).alias("first")), "ctw-words")
    vocab = words.where("first AND all > 0").count()
    total = entries.where(F.col("kind") == TOTAL).agg(F.sum("n").alias("n")).first().n or 0
    word_back = words.where("all <> n").select(F.col("block").alias("block_of"), F.lit(WORD).alias("kind"), "key", F.col("all").cast("double").alias("score"))
    out = pa.schema([("doc_id", to_arrow_type(id_type)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        ids, held, bodies = _texts(left)
        kind, key, value = (right.column(c).to_numpy() for c in ("kind", "key", "score"))
        order = np.argsort(key)
        kind, key, value = kind[order], key[order], value[order]
        g, w = kind == GRAM, kind == WORD
        got = score_block(bodies, [not h for h in held], key[g], value[g], key[w], value[w], total, vocab, depth)
        own = [ids, pa.array(held, pa.bool_()), pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()),
               pa.array(np.full(len(held), total, np.int64)), pa.array(got[2], pa.float64()), pa.array(got[3], pa.float64()),
               pa.array(-np.asarray(got[3], float) / math.log10(2) / np.array([len(x) for x in bodies]), pa.float64())]
        return pa.Table.from_arrays(own, schema=out)

    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    texts = blocked.where(F.col("kind") == TEXT).select("block", "ids", "held", "sizes", "blob")
    return texts.groupBy("block").cogroup(gram_back.unionAll(word_back).groupBy("block_of")).applyInArrow(run, schema)


def op5_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 1)
