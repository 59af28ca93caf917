"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts hashed n-grams of every labelled training text (no sample): each task
adds up one count vector per language, Spark sums them, and only the language x bucket
matrix reaches the driver. ``predict`` broadcasts its log-probabilities and scores whole
texts in Arrow batches: all n-grams of a block are hashed at once, their rows of the
matrix are added up per text.

Defined results: null text or no letter -> ``und``, score 0.0; no labelled training row
-> ``und`` for all; ties go to the alphabetically first language; repeated rows are
scored alike; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, remainder, table, texts, with_columns

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
BLOCK_CHARS = 1 << 20  # code points hashed at a time: bounds memory for long texts
MAX_LANGS = 4096  # the broadcast matrix holds at most MAX_LANGS * BUCKETS * 4 bytes = 512 MB
UND = "und"

_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space for anything that is no letter."""
    global _FOLD
    if _FOLD is None:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _FOLD = t
    return _FOLD


def _hashes(points: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position (shorter by n - 1)."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ points[k:k + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h = h * np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def _squeeze(points: np.ndarray) -> np.ndarray:
    """Mask of positions to keep when runs of spaces shrink to one."""
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return keep


def _fold(text: str) -> np.ndarray:
    return _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _blocks(values: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, number of texts, folded code points with a space around each text).

    A text above BLOCK_CHARS comes alone, in parts: (text, -overlap, squeezed code points), where
    the first ``overlap`` points were already part of the part before.
    """
    lap = max(ORDERS) - 1
    first, held, size = 0, [], 0
    for i, v in enumerate(values):
        v = v or ""
        if held and size + len(v) > BLOCK_CHARS:
            yield first, len(held), _fold(" " + " ".join(held) + " ")
            held, size = [], 0
        if len(v) > BLOCK_CHARS:
            carry = np.full(1, 32, np.uint32)
            for at in range(0, len(v), BLOCK_CHARS):
                part = v[at:at + BLOCK_CHARS] + (" " if at + BLOCK_CHARS >= len(v) else "")
                points = np.concatenate([carry, _fold(part)])
                points = points[_squeeze(points)]
                yield i, -len(carry) if at else 0, points
                carry = points[-lap:]
            continue
        if not held:
            first = i
        held.append(v)
        size += len(v) + 1
    if held:
        yield first, len(held), _fold(" " + " ".join(held) + " ")


def _grams(points: np.ndarray, n_texts: int, n: int, buckets: int) -> np.ndarray:
    """Buckets of the n-grams of one block; of a later part of a text, those that end in new points."""
    h = _hashes(points, n, buckets)
    return h[max(0, -n_texts - n + 1):] if n_texts < 0 else h


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray  # languages x buckets, float32
    log_prior: np.ndarray


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in batches:
        by: dict[str, list[str]] = {}
        for lang, t in zip(texts(b, "lang"), texts(b)):
            by.setdefault(lang, []).append(t)
        for lang, own in by.items():
            acc = sums.setdefault(lang, np.zeros(buckets, np.int64))
            docs[lang] = docs.get(lang, 0) + len(own)
            for _, n_texts, points in _blocks(own):
                points = points[_squeeze(points)] if n_texts > 0 else points
                for n in ORDERS:
                    acc += np.bincount(_grams(points, n_texts, n, buckets), minlength=buckets)
    for lang, acc in sums.items():
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(acc[at], docs[lang]), pa.int64())],
            names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, buckets: int = BUCKETS, alpha: float = 0.5) -> LanguageModel:
    """Learn from every row with non-null ``lang`` and text. Bucket -1 carries the number of texts."""
    train = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    if train.select("lang").distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:  # before any task holds a vector per language
        raise ValueError(f"more than {MAX_LANGS} languages; vectors and the broadcast matrix are sized for as many")
    parts = arrow_map(train, lambda it: _count(it, buckets), "lang string, bucket int, n long")
    got = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang_of, bucket, n = got.column("lang").to_numpy(zero_copy_only=False), got.column("bucket").to_numpy(), got.column("n").to_numpy()
    langs = sorted(set(lang_of.tolist()))
    counts, docs = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for j, lang in enumerate(langs):
        own = lang_of == lang
        at, c = bucket[own], n[own]
        counts[at[at >= 0], j] = c[at >= 0]
        docs[j] = c[at < 0].sum()
    log_prob = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * buckets) if langs else counts
    return LanguageModel(langs, np.ascontiguousarray(log_prob.T, np.float32), np.log(docs / max(docs.sum(), 1)))


def log_likelihood(values: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text in each language, priors included, and its number of n-grams."""
    n_lang = len(model.langs)
    ll, n_grams = np.tile(model.log_prior, (len(values), 1)), np.zeros(len(values), np.int64)
    for first, n_texts, points in _blocks(values):
        if n_texts <= 0:
            for n in ORDERS:
                h = _grams(points, n_texts, n, model.log_prob.shape[1])
                ll[first] += model.log_prob[:, h].sum(1, dtype=np.float64)
                n_grams[first] += len(h)
            continue
        keep = _squeeze(points)
        ends = np.cumsum([len(values[first + k] or "") + 1 for k in range(n_texts)])  # each text's closing space
        starts = np.concatenate([[0], ends[:-1]])  # the space before it, kept or squeezed into the one before that
        at = np.concatenate([[0], np.cumsum(keep)])
        lo, hi = at[starts + 1] - 1, at[ends + 1]
        points = points[keep]
        for n in ORDERS:
            h = _hashes(points, n, model.log_prob.shape[1])
            a, z = np.minimum(lo, len(h)), np.clip(hi - n + 1, 0, len(h))
            n_grams[first:first + n_texts] += np.maximum(z - a, 0)
            for j in range(n_lang):
                run = np.concatenate([[0.0], np.cumsum(model.log_prob[j][h], dtype=np.float64)])
                ll[first:first + n_texts, j] += np.where(z > a, run[z] - run[a], 0.0)
    return ll, n_grams


def score_texts(values: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior for each text."""
    if not model.langs:
        return [UND] * len(values), np.zeros(len(values))
    ll, _ = log_likelihood(values, model)
    best = ll.argmax(1)
    post = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
    letters = np.array([v is not None and any(map(str.isalpha, v)) for v in values], bool)
    return [model.langs[j] if ok else UND for j, ok in zip(best, letters)], np.where(letters, post, 0.0)


def predict(docs: DataFrame, model: LanguageModel, text: Column | str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        lang, score = score_texts(texts(b, text), shared.value)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return with_columns(docs, run, [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])


def op1_language_id(spark, sf_dir):
    """Trained on the texts whose id's crc32 mod 4 is not 2; every text is predicted."""
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def above_floor(values: list[str | None], model: LanguageModel) -> np.ndarray:
    """Whether a text's n-grams are likelier in its best language than if all buckets were equally likely.

    A posterior cannot tell: over a whole text some learned language always wins by far, also for
    noise or for a script that no training text has. Its n-grams are rare in all of them.
    """
    if not model.langs:
        return np.zeros(len(values), bool)
    ll, n = log_likelihood(values, model)
    return (ll - model.log_prior).max(1) > -np.log(model.log_prob.shape[1]) * n


def keep_identified(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents without letters, and those whose best language explains them worse than chance, go."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        values = texts(b)
        letters = np.array([v is not None and any(map(str.isalpha, v)) for v in values], bool)
        return [pa.array(letters & above_floor(values, shared.value), pa.bool_())]

    return with_columns(docs, run, [T.StructField("__lid_kept", T.BooleanType())]).where("__lid_kept").select(*docs.columns)
