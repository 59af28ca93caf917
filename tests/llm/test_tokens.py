import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from demandlake.llm import packing as P
from demandlake.llm import token_files as W
from demandlake.llm.tokens import Encoder, vocab_path

from ..conftest import SF_MID
from . import util

TEXTS = [None, "", " ", "\n\n", "a", " a", "a ", "a  b", "a\n\nb \t c  ", "it's I'll don't '  's", "Été café́  ̈x", "x\x1cy \x85 z\xa0w", "a　 b", "12 345,6 %%% ###", "<|endoftext|> x <|startoftext|>",
         "\U0001f600 ‍ tab\tnew\x0bline\x0c", "ÀÉÎ ΣΑΣ ß ſ K", "a \n b", "日本語 テキスト", "\nx", "x\n", " \n", "a\n b", "(word) \"quoted\", 's don't' 't 're x's", "'s", "\n's", "a_b a1 1a 12 ³ ½ ²x", "İstanbul ŉ ǅ ɏ ɐ", "<|EndOfText|>", "\0 a\0b", "...word...", "  lead", "\n\nlead", "\tlead x"]


@pytest.mark.parametrize("name, drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_chunks_equal_whole_texts(name, drops):
    t = Tokenizer.from_file(vocab_path(name))
    texts = TEXTS + [r[1] for r in util.rows()] + ["".join(x or "" for x in TEXTS)]
    got = Encoder(vocab_path(name), drops).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


PIECES = ["'", "'s", "'re", "'ll", "'t", "'m", "'d", "'ve", " ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "B", "word", "W\u00f6rd", "\u00c9", "\u0130", "\u00df", "\u0149", "\u0178", "\u023a", "\u0250", "\u017f", "\u212a", "1", "23", "\u00b2", "\u00bd", "_", "...",
          "!", '"', "(", "\u201c", "\u2019", "\u65e5\u672c", "\u0419", "\U0001f600", "\x00", "\x01", "\x7f", "\x0b", "\x0c", "\u00d7", "\u00f7", "\u00aa", "\u00b5", "\u0301", "\u01c4", "\u01c5", "abcdefghij" * 4, " " * 30, "!" * 40, "\u03a3", "\xa0", "<|endoftext|>"]


@pytest.mark.parametrize("name, drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@pytest.mark.parametrize("seed", range(3))
def test_random_texts(name, drops, seed, monkeypatch):
    from demandlake.llm import tokens

    rng = random.Random(seed)
    monkeypatch.setattr(tokens, "LONG_TEXT", 40 if seed else 1 << 22)
    monkeypatch.setattr(tokens, "MOST_PIECES", 300 if seed else 1_500_000)
    enc, plain = Encoder(vocab_path(name), drops), whole(name)
    for _ in range(20):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(60)]
        for text, ids in zip(texts, enc.encode(texts)):
            assert ids == plain(text).tobytes(), repr(text)


def whole(name):
    t = Tokenizer.from_file(vocab_path(name))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_token_files(spark, tmp_path):
    data = util.rows()
    path = util.write_tables(spark, tmp_path / "in", data)
    got = W.op6_token_output(spark, path).collect()
    enc, start, want = whole("word_bpe_49k.json"), 0, []
    for i, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = enc(text)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_layout_and_selective_reads(spark, tmp_path):
    docs = util.docs(spark)
    for layout in (W.Layout(), W.Layout(encoding="dictionary", row_group_mb=1, page_kb=4)):
        path = str(tmp_path / layout.encoding)
        W.write(docs, path, vocab_path("word_bpe_49k.json"), layout=layout)
        files = sorted((tmp_path / layout.encoding).glob("*.parquet"))
        groups = [pq.ParquetFile(f).metadata for f in files]
        seen = {enc for m in groups for g in range(m.num_row_groups) for enc in m.row_group(g).column(4).encodings}
        assert ("DELTA_BINARY_PACKED" in seen) == (layout.encoding == "delta") and any("DICTIONARY" in x for x in seen) == (layout.encoding == "dictionary")
        assert all(m.row_group(g).column(0).has_offset_index for m in groups for g in range(m.num_row_groups))
        meta = W.read_metadata(spark, path)
        plan = meta._jdf.queryExecution().executedPlan().toString()
        assert "ids" not in plan[plan.index("ReadSchema"):].split("\n")[0]
        assert meta.count() == docs.count() and W.read_tokens(spark, path).where("doc_id = 7").count() == 1
    path = str(tmp_path / "none")
    W.write(util.empty(spark), path, vocab_path("word_bpe_49k.json"))
    assert W.read_tokens(spark, path).count() == 0


def check_packing(rows, data, enc, capacity):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.piece), []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    want = {}
    for i, text, *_ in data:
        ids = enc(text)
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            want.setdefault((i, k), []).append((a, z - a, zlib.crc32(ids[a:z].tobytes())))
    assert {k: sorted((r.start, r.length, r.ids_crc32) for r in v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing(spark, tmp_path):
    data = util.rows()
    rows = P.op10_best_fit_packing(spark, util.write_tables(spark, tmp_path, data)).collect()
    n, total = check_packing(rows, data, whole("byte_bpe_50k.json"), 1024)
    assert n == -(-total // 1024)


@pytest.mark.parametrize("group", [P.GROUP_MEMBERS, 7])
def test_packing_in_rounds(spark, group):
    data = util.rows()
    docs = util.docs(spark, data)
    rows = P.pack(P.pieces(docs, vocab_path("byte_bpe_50k.json"), 100), 100, group).collect()
    n, total = check_packing(rows, data, whole("byte_bpe_50k.json"), 100)
    assert n <= 1.05 * -(-total // 100) + 1
    none = util.empty(spark)
    assert P.pack(P.pieces(none, vocab_path("byte_bpe_50k.json"))).count() == 0


def test_tree_reaches_one_group(spark):
    """Small groups give, up to a bin or two, what one group gives; both stay near the lower bound."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    parts = P.pieces(docs, vocab_path("byte_bpe_50k.json")).cache()
    bound = -(-parts.agg({"length": "sum"}).first()[0] // P.CAPACITY)
    counts = {g: P.pack(parts, group_members=g).select("sequence_id").distinct().count() for g in (100, P.GROUP_MEMBERS)}
    parts.unpersist()
    assert counts[P.GROUP_MEMBERS] <= bound + 2 and counts[100] <= bound + 4, (bound, counts)


def test_root_of_bins_that_do_not_shrink(spark):
    """Bins that cannot pair up among themselves, and the few small ones that fit in: more than any group may hold."""
    parts = spark.createDataFrame([(i, 0, 0, 600 if i % 5 else 400, 1) for i in range(500)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = P.pack(parts, 1024, 10).collect()
    assert len({r.sequence_id for r in got}) == 400
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(b)] == [0, sorted(b)[0][1]][:len(b)] for b in bins.values())


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_of_counts(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 400)
    plain = P.best_fit(sizes, 100)
    classes = P.best_fit_classes(dict(zip(*map(np.ndarray.tolist, np.unique(sizes, return_counts=True)))), 100)
    assert sum(n for n, _ in classes) == len(plain)
    put = {}
    for n, content in classes:
        assert sum(s * k for s, k in content.items()) <= 100
        for s, k in content.items():
            put[s] = put.get(s, 0) + n * k
    assert put == dict(zip(*map(np.ndarray.tolist, np.unique(sizes, return_counts=True))))
    assert P.best_fit_classes({600: 10**12, 400: 10**11}, 1024) and P.best_fit_classes({}, 10) == []


def test_pieces_that_cannot_share(spark):
    parts = spark.createDataFrame([(i, 0, 0, 600, 1) for i in range(50)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = P.pack(parts, 1024, 10).collect()
    assert len({r.sequence_id for r in got}) == 50 and all(r.offset == 0 for r in got)


def test_best_fit():
    bins = P.best_fit(np.array([600, 500, 400, 424, 24, 1024]), 1024)
    assert sorted(map(sorted, bins)) == [[0, 3], [1, 2, 4], [5]]
