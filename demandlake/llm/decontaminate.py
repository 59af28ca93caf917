"""Benchmark decontamination by template canonicalisation.

Words lose case and edge punctuation; numbers, units after a number and names turn into typed
placeholders. A capital does not tell a name from a sentence's first word, and copies change case,
so items and texts are compared in three forms, each by itself (items of equal template as one): names stay literal words (copies in
any case), capitalised words inside a sentence are names, all capitalised words are names (renamed
sentence starts). A run of name words is one name, whatever its length. Windows of ``WINDOW``
template words of the benchmark, those with at least ``LITERALS`` literal words, form a hash table
per form; every window of every whole text is joined with it by hash where the text lies. Hits of
one document and item are grouped by alignment (one group per occurrence of the passage). An
occurrence that covers at least ``MIN_SIMILARITY`` of the item's windows is a leak if its slots are
consistent: equal slot values of the item stand for equal values in the document in at least
``MIN_CONSISTENT`` of the slots. An item that names leave under ``MIN_LITERAL`` of its words is not
compared in that form. ``kind`` tells exact copies from re-parameterised ones.

With ``parts``, as the query and the pipeline have it, ``PASSAGE`` equal words in a row anywhere in an
item are a leak as well (kind ``passage``, similarity the share of the item's passages), and an item
below a window, with at least ``LITERALS`` literal words, is found as a word sequence anywhere in a
text. Without it the share of the whole item alone decides.

The benchmark is the query set: it is taken in blocks of at most ``BLOCK_WINDOWS`` windows, each
broadcast and matched against all documents, so the broadcast's size is bounded.

Defined results: null or empty texts and items match nothing; words of signs only are told apart but
are no literals; an item without such a window is matched by all its windows with its numbers as
they are, so only as an exact copy; an item of fewer than ``WINDOW`` words
matches (``parts`` aside) only a document whose whole template equals its own; repeated documents each give their rows,
repeated items theirs; other columns are ignored (``scan``) or kept (``drop_leaks``).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, save, table, texts

WINDOW, LITERALS = 5, 2
MIN_SIMILARITY, MIN_CONSISTENT = 0.8, 0.8
MIN_LITERAL = 0.4  # of an item's words, numbers and units aside, must stay when capitalised ones are names
PASSAGE, PASSAGE_LITERALS = 13, 7  # words in a row that are a leak by themselves, and how many of them are literal
BLOCK_WINDOWS = 1 << 20  # about 170 MB a worker
CACHE_WORDS = 250_000  # about 45 MB a worker

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*[%°]?")
MEASURE = re.compile(r"[+-]?\d[\d.,]*([a-z]{1,4})")
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—¿¡"
STOPS = (".", "!", "?", ":", ";")
CLOSERS = "\"')]”’»"
#: Words that are a unit when they follow a number (fixed values).
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg lb lbs oz gram grams kilogram kilograms pound pounds "
                  "ounce ounces ton tons ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour "
                  "hours day days week weeks month months year years mph kmh percent dollar dollars usd eur euro euros cent cents degree degrees "
                  "hz khz mhz w kw v mb gb tb".split())

# the low bits of a word's code tell what it may become
CAP, STOP, UNIT, NUM, SIGN = 1, 2, 4, 8, 16
FLAGS = np.uint64(31)
NAME_CODE, UNIT_CODE, NUM_CODE, GAP_CODE = (np.uint64(n << 5) for n in (1, 2, 3, 4))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def is_number(core: str, low: str) -> bool:
    """A number, or a number with its unit attached."""
    if core.isalpha():
        return False
    m = MEASURE.fullmatch(low)
    return bool(NUMBER.fullmatch(core) or (m and m[1] in UNITS))


class _Codes(dict):
    """word -> 64-bit code; computed at its first sight."""

    def __missing__(self, word: str) -> int:
        core = word if word.isalpha() else word.strip(EDGES)
        low = core.lower()
        sign = not any(c.isalnum() for c in core)
        code = max(xxhash.xxh64_intdigest((word if sign else low).encode("utf-8", "surrogatepass")) & ~31, 16 << 5)
        if sign:
            code |= SIGN
        elif is_number(core, low):
            code |= NUM
        else:
            code |= (CAP if core[:1].isupper() else 0) | (UNIT if low in UNITS else 0)
        if core is not word and word.rstrip(CLOSERS).endswith(STOPS):
            code |= STOP
        self[word] = code
        return code


_CODES = _Codes()


def words_of(text: str | None) -> list[str]:
    return text.split() if text else []


@dataclass
class Form:
    """Lists end to end in one form of template, with a gap after each."""

    code: np.ndarray
    slot: np.ndarray
    literal: np.ndarray  # neither a slot nor of signs only
    word: np.ndarray  # the word at which each template word begins
    start: np.ndarray  # the template word at which each list begins


def forms(lists: list[list[str]]) -> list[Form]:
    """The lists in each form: all words as they are, names as they are, capitalised words inside a sentence as names, all capitalised words as names."""
    if len(_CODES) > CACHE_WORDS:
        _CODES.clear()
    sizes = np.array([len(x) + 1 for x in lists], np.int64)
    total = int(sizes.sum())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    code = np.full(total, int(GAP_CODE) | STOP, np.uint64)
    get = _CODES.__getitem__
    for a, x in zip(starts.tolist(), lists):
        if x:
            code[a:a + len(x)] = np.fromiter(map(get, x), np.uint64, len(x))
    flag = (code & FLAGS).astype(np.uint8)
    code &= ~FLAGS
    before = np.concatenate([[STOP], flag[:-1]]).astype(np.uint8) if total else flag
    number, unit, sign = flag & NUM > 0, (flag & UNIT > 0) & (before & NUM > 0), flag & SIGN > 0
    slot = number | unit
    inside = before & STOP == 0
    out = [Form(code, np.zeros(total, bool), ~(slot | sign), np.arange(total), starts)]
    code = code.copy()
    code[number], code[unit] = NUM_CODE, UNIT_CODE
    out.append(Form(code, slot, ~(slot | sign), np.arange(total), starts))
    capital = (flag & CAP > 0) & ~unit
    for name in (capital & inside, capital):
        again = name & inside
        again[1:] &= name[:-1]
        word = np.flatnonzero(~again)  # a run of name words inside a sentence is one name
        own = name[word]
        out.append(Form(np.where(own, NAME_CODE, code[word]), own | slot[word], ~(own | slot[word] | sign[word]), word, np.searchsorted(word, starts)))
    return out


def window_hashes(code: np.ndarray) -> np.ndarray:
    n = len(code) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += (code[k:k + n] ^ (code[k:k + n] >> np.uint64(29))) * _MIX[k]
    return h ^ (h >> np.uint64(31))


def run_hashes(code: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width >= WINDOW:
        code, at = window_hashes(code), [*range(0, width - WINDOW, WINDOW), width - WINDOW]
    else:
        at = range(width)
    h = np.zeros(n, np.uint64)
    for k, a in enumerate(at):
        h += (code[a:a + n] ^ (code[a:a + n] >> np.uint64(29))) * _MIX[k]
    return h ^ (h >> np.uint64(31))


@dataclass
class Table:
    """The templates of a block in one form as a hash table of windows."""

    items: list[list[int]]  # of each template
    slots: list[np.ndarray]
    word: list[np.ndarray]  # of each item: where each template word begins, and the item's end
    n_windows: np.ndarray
    hashes: np.ndarray  # sorted
    template: np.ndarray
    pos: np.ndarray
    bits: np.ndarray  # prefilter on the top 20 bits


@dataclass
class Block:
    """A part of the benchmark."""

    ids: list
    words: list[list[str]]
    tables: list[Table]  # in the order of ``forms``
    short: dict[bytes, list[int]]  # whole template of items below a window
    runs: dict[int, Table]  # length -> the items' word sequences: passages, and items below a window


def _table(members: list, slots: list, word: list, hs: list, owners: list, poss: list, n_windows: list) -> Table:
    hashes = np.concatenate([np.zeros(0, np.uint64), *hs])
    order = np.argsort(hashes, kind="stable")
    bits = np.zeros(1 << 20, bool)
    bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
    cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32)[order]
    return Table(members, slots, word, np.array(n_windows, np.int64), hashes[order], cat(owners), cat(poss), bits)


def _runs(form: Form, width: int, least: int, whole: bool) -> Table:
    """Each ``width`` words in a row with ``least`` literal ones; ``whole``: only of items of so many words."""
    literals, h = np.concatenate([[0], np.cumsum(form.literal)]), run_hashes(form.code, width)
    ends = np.concatenate([form.start[1:], [len(form.code)]]) - 1
    known: dict[bytes, int] = {}
    members, hs, owners, poss, n_windows = [], [], [], [], []
    for i, (a, z) in enumerate(zip(form.start.tolist(), ends.tolist())):
        at = np.arange(a, max(a, z - width + 1))
        at = at[literals[at + width] - literals[at] >= least]
        if not len(at) or (whole and z - a != width):
            continue
        t = known.setdefault(form.code[a:z].tobytes(), len(known))
        if t < len(members):
            members[t].append(i)
            continue
        members.append([i])
        n_windows.append(len(at))
        hs.append(h[at])
        owners.append(np.full(len(at), t))
        poss.append(at - a)
    return _table(members, [], [], hs, owners, poss, n_windows)


def build(rows: list[tuple]) -> Block:
    words = [words_of(t) for _, t in rows]
    every, short, tables = forms(words), defaultdict(list), []
    bare: set[int] = set()  # items without enough literal words: all their windows count, as they are
    for turn in (1, 0, 2, 3):
        form = every[turn]
        literals = np.concatenate([[0], np.cumsum(form.literal)])
        ends = np.concatenate([form.start[1:], [len(form.code)]]) - 1
        count = literals[ends] - literals[form.start]
        plain = count if turn == 1 else plain  # noqa: F821
        known: dict[bytes, int] = {}
        members, slots, word, hs, owners, poss, n_windows = [], [], [], [], [], [], []
        h = window_hashes(form.code)
        for i, (a, z) in enumerate(zip(form.start.tolist(), ends.tolist())):
            at = np.arange(a, max(a, z - WINDOW + 1))
            rich = at[literals[at + WINDOW] - literals[at] >= LITERALS]
            word.append((form.word[a:z + 1] - form.word[a]).astype(np.int32))
            if turn == 1:
                if 0 < z - a < WINDOW:
                    short[form.code[a:z].tobytes()].append(i)
                if not len(rich):
                    bare.add(i)
            if turn == 0:
                at = at if i in bare else at[:0]
            else:
                at = rich if count[i] >= MIN_LITERAL * plain[i] else rich[:0]
            if not len(at):
                continue
            t = known.setdefault(form.code[a:z].tobytes(), len(known))
            if t < len(members):
                members[t].append(i)
                continue
            members.append([i])
            slots.append(form.slot[a:z])
            n_windows.append(len(at))
            hs.append(h[at])
            owners.append(np.full(len(at), t))
            poss.append(at - a)
        tables.append(_table(members, slots, word, hs, owners, poss, n_windows))
    tables[0], tables[1] = tables[1], tables[0]
    runs = {n: _runs(every[0], n, PASSAGE_LITERALS if n == PASSAGE else LITERALS, n < WINDOW) for n in (*range(1, WINDOW), PASSAGE)}
    return Block([r[0] for r in rows], words, tables, dict(short), {n: x for n, x in runs.items() if len(x.hashes)})


def _value(words: list[str], a: int, z: int) -> str:
    return " ".join(w.strip(EDGES).lower() for w in words[a:z])


def judge(block: Block, of: Table, t: int, words: list[str], word: np.ndarray, q: np.ndarray, p: np.ndarray) -> dict[int, tuple[float, bool, int]]:
    """item -> (similarity, exact, windows) of its best consistent occurrence, for the items of template ``t``. ``q``, ``p``:
    template positions of the hits in the document and in the item; ``word``: where the document's template words begin."""
    windows = int(of.n_windows[t])
    shift = q - p
    shifts, often = np.unique(shift, return_counts=True)
    group = np.cumsum(np.concatenate([[0], np.diff(shifts) > WINDOW]))  # a word more or less inside the same passage
    alone = np.flatnonzero(often >= MIN_SIMILARITY * windows)
    spans = [(k, k + 1) for k in alone[np.argsort(-often[alone], kind="stable")].tolist()]
    first = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0])).tolist()
    spans += [s for s in zip(first, [*first[1:], len(shifts)]) if s[1] - s[0] > 1]
    order = np.argsort(shift, kind="stable")
    ends = np.concatenate([[0], np.cumsum(often)])
    best: dict[int, tuple[float, bool, int]] = {}
    for a, z in spans:
        todo = [i for i in of.items[t] if i not in best or best[i][:2] < (1.0, True)]
        if not todo:
            break
        own = order[ends[a]:ends[z]]
        found = len(np.unique(p[own]))
        if found < MIN_SIMILARITY * windows:
            continue
        common = np.repeat(often[a:z], often[a:z])
        own = own[np.lexsort((p[own], shift[own], -common))]  # a slot's value is that of the commonest alignment
        at, to = (p[own][:, None] + np.arange(WINDOW)).ravel(), (q[own][:, None] + np.arange(WINDOW)).ravel()
        at, k = np.unique(at, return_index=True)
        slot = of.slots[t][at]
        stands = [(x, _value(words, word[y], word[y + 1])) for x, y in zip(at[slot].tolist(), to[k][slot].tolist())]
        for i in todo:
            values = defaultdict(Counter)
            for x, v in stands:
                values[_value(block.words[i], of.word[i][x], of.word[i][x + 1])][v] += 1
            if sum(max(c.values()) for c in values.values()) >= MIN_CONSISTENT * len(stands):
                got = (found / windows, all(set(c) == {v} for v, c in values.items()), found)
                best[i] = max(best.get(i, got), got)
    return best


PAIRS = 1 << 20  # (document position, item position) at a time


def _pairs(at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position in the texts, row of the table) of every equal window, about ``PAIRS`` at a time."""
    ends = np.cumsum(n)
    a = 0
    while a < len(at):
        before = int(ends[a] - n[a])
        z = max(a + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        m = n[a:z]
        yield np.repeat(at[a:z], m), np.repeat(lo[a:z] - (ends[a:z] - m - before), m) + np.arange(int(m.sum()))
        a = z


def _by_text(of: Table, form: Form, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, positions, first row of the table, rows) of the hashes that the table has."""
    at = np.flatnonzero(of.bits[(h >> np.uint64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(of.hashes, h[at]), np.searchsorted(of.hashes, h[at], "right")
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    doc = np.searchsorted(form.start, at, "right") - 1
    cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=-1)).tolist() if len(at) else [0]
    for a, z in zip(cuts[:-1], cuts[1:]):
        yield int(doc[a]), at[a:z], lo[a:z], n[a:z]


def _passages(block: Block, form: Form) -> Iterator[tuple[int, int, float, int, str]]:
    """Leaks by word sequences alone: a passage of any item, a whole item below a window."""
    for width, of in block.runs.items():
        for d, _, lo, n in _by_text(of, form, run_hashes(form.code, width)):
            lo, first = np.unique(lo, return_index=True)  # each distinct sequence of the text once
            found = np.zeros(len(of.n_windows), np.int64)
            for _, k in _pairs(lo, lo, n[first]):
                found += np.bincount(of.template[k], minlength=len(found))
            for t in np.flatnonzero(found).tolist():
                for i in of.items[t]:
                    yield d, i, float(found[t] / of.n_windows[t]), int(found[t]), "passage" if width == PASSAGE else "exact"


def _hits(of: Table, form: Form) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text, template, template positions in the text, in the item) where enough windows are equal.

    A text's hits are counted per template first; only those of templates with enough are held."""
    if not len(of.hashes):
        return
    for d, at, lo, n in _by_text(of, form, window_hashes(form.code)):
        often = np.zeros(0, np.int64)
        for _, k in _pairs(at, lo, n):
            more = np.bincount(of.template[k])
            often = np.concatenate([often, np.zeros(max(0, len(more) - len(often)), np.int64)])
            often[:len(more)] += more
        often = np.concatenate([often, np.zeros(len(of.n_windows) - len(often), np.int64)])
        enough = often >= MIN_SIMILARITY * of.n_windows
        if not enough.any():
            continue
        kept = [(q[ok], k[ok]) for q, k in _pairs(at, lo, n) if (ok := enough[of.template[k]]).any()]
        q, k = (np.concatenate(x) for x in zip(*kept))
        order = np.argsort(of.template[k], kind="stable")
        q, k = q[order] - form.start[d], k[order]
        own, first = np.unique(of.template[k], return_index=True)
        for t, x, y in zip(own.tolist(), first.tolist(), [*first.tolist()[1:], len(k)]):
            yield d, t, q[x:y], of.pos[k[x:y]].astype(np.int64)


def matches(block: Block, values: list[str | None], parts: bool = False) -> Iterator[tuple[int, int, float, int, str]]:
    """(text, item, similarity, windows, kind) of every leak among ``values``; ``parts``: passages of items count as well."""
    lists = [words_of(v) for v in values]
    every = forms(lists)
    best: dict[tuple[int, int], tuple[float, bool, int]] = {}
    for of, form in zip(block.tables, every):
        for d, t, q, p in _hits(of, form):
            a = form.start[d]
            for i, got in judge(block, of, t, lists[d], form.word[a:a + int(q.max()) + WINDOW + 1] - form.word[a], q, p).items():
                best[d, i] = max(best.get((d, i), got), got)
    for (d, i), (similarity, same, found) in sorted(best.items()):
        yield d, i, similarity, found, "exact" if same else "reparameterised"
    if parts:
        for got in _passages(block, every[0]):
            if got[:2] not in best:
                best[got[:2]] = (got[2], got[4] == "exact", got[3])
                yield got
    if block.short:
        code, starts = every[1].code, every[1].start
        for d, (a, x) in enumerate(zip(starts.tolist(), lists)):
            if 0 < len(x) < WINDOW:
                for i in block.short.get(code[a:a + len(x)].tobytes(), []):
                    if (d, i) in best:
                        continue
                    yield d, i, 1.0, 1, "exact" if [w.strip(EDGES).lower() for w in x] == [w.strip(EDGES).lower() for w in block.words[i]] else "reparameterised"


def blocks(benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark in blocks; the driver holds one at a time."""
    rows, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").toLocalIterator():
        n = len(r.text) // 2 + 1  # at most so many words
        if rows and size + n > block_windows:
            yield build(rows)
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += n
    if rows:
        yield build(rows)


SCAN_STEP = 256  # texts at a time


def _pieces(values: list) -> Iterator[tuple[int, list]]:
    for a in range(0, len(values), SCAN_STEP):
        yield a, values[a:a + SCAN_STEP]


def scan(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS, parts: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, n_windows, kind): one row per leaked item and document row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType),
                           T.StructField("similarity", T.DoubleType()), T.StructField("n_windows", T.LongType()), T.StructField("kind", T.StringType())])

    item_type = to_arrow_type(schema["item_id"].dataType)

    def against(block: Block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            for b in batches:
                values, ids = texts(b), b.column(0)
                for a, part in _pieces(values):
                    got = list(matches(shared.value, part, parts))
                    if got:
                        d, i, sim, n, kind = zip(*got)
                        item = pa.array([shared.value.ids[x] for x in i], item_type)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + x for x in d])), item, pa.array(sim, pa.float64()), pa.array(n, pa.int64()), pa.array(kind)], names=[f.name for f in schema])

        return arrow_map(rows, run, schema)

    out: DataFrame | None = None
    held: Block | None = None
    for block in blocks(benchmark, block_windows):
        if held is not None:  # more than one block: each is matched at once, so that one is held at a time
            part = save(against(held), "leaks")
            out = part if out is None else out.unionAll(part)
        held = block
    if held is None:
        return docs.sparkSession.createDataFrame([], schema)
    last = against(held)
    return last if out is None else out.unionAll(last)


def op4_benchmark_decontamination(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), parts=True)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS, parts: bool = False) -> DataFrame:
    """Pipeline stage: rows that hold a leak go, judged row by row where they lie; between two blocks they are written, so one is held at a time."""
    for k, block in enumerate(blocks(benchmark, block_windows)):
        docs = save(docs, "unleaked") if k else docs
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for b in batches:
                values = texts(b)
                bad = {a + m[0] for a, part in _pieces(values) for m in matches(shared.value, part, parts)}
                yield b.filter(pa.array([i not in bad for i in range(len(values))], pa.bool_())) if bad else b

        docs = arrow_map(docs, run, docs.schema)
    return docs
