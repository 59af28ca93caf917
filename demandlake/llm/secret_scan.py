"""Secret scan: fixed credential patterns plus formats learned by grammar inference.

The base patterns label credentials in the corpus. From a bounded sample of distinct labelled
values per kind (``MAX_TRAIN``, the lowest hashes, so the sample does not depend on the
partitioning) a probabilistic automaton is inferred over character classes: the values' prefix
tree is built and states whose outgoing frequencies agree within the Hoeffding bound are merged,
breadth first, with their subtrees. A Markov chain over the same classes, counted on all ordinary long
tokens (each task counts its own, one grouped sum adds them up), is the background. Every long token of every whole text is then scored, and of a token with = or / also the
parts (what follows each =, what lies between signs; the best that do not overlap count). Long means
``LEAST`` characters, or fewer where labelled values are shorter; one whose format
likelihood (automaton and length) exceeds the background's by ``MIN_GAIN`` nats, and is not lower than
that of the labelled values by more than ``SLACK``, is a finding of kind ``format``. Base findings always stay, and learned ones never overlap them.

Defined results: null or empty text -> no findings; no labelled value of a kind -> no automaton of
it; repeated rows give the same findings; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, save, table, texts, with_columns

KINDS = ("assign", "access", "hex", "format")
MAX_TRAIN = 400  # distinct labelled values per kind
LONGEST = 64  # lengths from here on count as one
SHAPES = 100_000  # distinct class strings that a task counts before it adds them up
MIN_GAIN = 8.0
SLACK = 1.0
ALPHA = 0.01  # error rate of the compatibility test

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST, LEAST = 6, 12  # characters of a labelled value; of a token, unless labelled values are shorter
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Character classes: digits, a-f, g-z, A-F, G-Z, and each sign by itself.
CLASSES = "0ahAH+/_.=-"
TO_CLASS = {ord(c): ("0" if c.isdigit() else "a" if c in "abcdef" else "h" if c.islower() else "A" if c in "ABCDEF" else "H")
            for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
END = "$"
FLOOR = math.log(1e-4)  # of a step that the automaton has never seen

Span = tuple[int, int, int, int]  # kind, start, end, start of the secret itself


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, in code points."""
    low = text.lower()
    out: list[Span] = []
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[1], s[0]))
    return out


def _trim(text: str, a: int, z: int) -> tuple[int, int]:
    """Without signs at the ends."""
    while a < z and text[a] in "=./_-":
        a += 1
    while z > a and text[z - 1] in "./_-":
        z -= 1
    return a, z


def _free(spans: Iterator[tuple[int, int]], taken: list[Span]) -> Iterator[tuple[int, int]]:
    """The spans, by start, that no base span touches."""
    i = 0
    taken = sorted(taken, key=lambda s: s[1])
    for a, z in spans:
        while i < len(taken) and taken[i][2] <= a:
            i += 1
        if not any(s[1] < z and s[2] > a for s in taken[i:i + 8]):
            yield a, z


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Tokens that no base span touches, without signs at their ends."""
    spans = (_trim(text, *m.span()) for m in CANDIDATE.finditer(text))
    yield from _free(((a, z) for a, z in spans if z - a >= SHORTEST), taken)


def parts(text: str, a: int, z: int) -> Iterator[tuple[int, int]]:
    """A run itself, what follows each =, and what lies between = and /, without signs at the ends."""
    a, z = _trim(text, a, z)
    yield a, z
    ahead, to = z, z  # the next character that is no sign; the next = or /
    for x in range(z - 1, a - 2, -1):
        if x < a or text[x] in "=/":
            if x >= a and text[x] == "=" and ahead < z:
                yield ahead, z
            if ahead < to and (ahead, to) != (a, z):
                end = to
                while end > ahead and text[end - 1] in "./_-":
                    end -= 1
                if end < z or x < a or text[x] != "=":
                    yield ahead, end
            to = x
        if x >= a and text[x] not in "=./_-":
            ahead = x


@dataclass
class Automaton:
    """States are numbers from 0; step: (state, class) -> (next state, log probability)."""

    step: list[dict[str, tuple[int, float]]]
    lengths: dict[int, float]
    unseen_length: float
    lowest: float = 0.0  # of the labelled values, the least likely 2 % aside

    def log_prob(self, classes: str, length: int, least: float = -math.inf) -> float:
        """``least``: below it the rest does not matter."""
        total, state = self.lengths.get(length, self.unseen_length), 0
        for c in classes:
            if total < least:
                return total
            to = self.step[state].get(c)
            if to is None:
                total += FLOOR
                state = 0
            else:
                state = to[0]
                total += to[1]
        return total


@dataclass
class _Node:
    n: int = 0
    ends: int = 0
    out: dict[str, _Node] = field(default_factory=dict)
    cnt: Counter = field(default_factory=Counter)  # values that took each step


def _compatible(a: _Node, b: _Node, bound: float) -> bool:
    """Whether the outgoing frequencies of two states, and of their successors, may be the same."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x.n or not y.n:
            continue
        slack = bound * (1 / math.sqrt(x.n) + 1 / math.sqrt(y.n))
        if abs(x.ends / x.n - y.ends / y.n) > slack:
            return False
        for c in x.out.keys() | y.out.keys():
            if abs(x.cnt[c] / x.n - y.cnt[c] / y.n) > slack:
                return False
            if c in x.out and c in y.out:
                todo.append((x.out[c], y.out[c]))
    return True


def _fold(into: _Node, tree: _Node) -> None:
    """Add the counts of a prefix subtree to a state and its successors."""
    todo = [(into, tree)]
    while todo:
        x, y = todo.pop()
        x.n += y.n
        x.ends += y.ends
        x.cnt.update(y.cnt)
        for c, sub in y.out.items():
            if c in x.out:
                todo.append((x.out[c], sub))
            else:
                x.out[c] = sub


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the values' prefix tree, breadth first."""
    root = _Node()
    for v in values:
        node = root
        node.n += 1
        for c in v.translate(TO_CLASS):
            node.cnt[c] += 1
            node = node.out.setdefault(c, _Node())
            node.n += 1
        node.ends += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    states, known = [root], {id(root)}
    while True:
        found = next(((s, c) for s in states for c in sorted(s.out) if id(s.out[c]) not in known), None)
        if found is None:
            break
        parent, c = found
        node = parent.out[c]
        same = next((s for s in states if _compatible(s, node, bound)), None)
        if same is None:
            states.append(node)
            known.add(id(node))
        else:
            parent.out[c] = same
            _fold(same, node)
    number = {id(s): i for i, s in enumerate(states)}
    steps = [{c: (number[id(x)], math.log((s.cnt[c] + 0.5) / (sum(s.cnt.values()) + 0.5 * len(CLASSES)))) for c, x in s.out.items()} for s in states]
    lengths = Counter(map(len, values))
    room = len(values) + 1.0
    found = Automaton(steps, {k: math.log(n / room) for k, n in lengths.items()}, math.log(0.01 / room))
    found.lowest = sorted(found.log_prob(v.translate(TO_CLASS), len(v)) for v in values)[len(values) // 50]
    return found


@dataclass
class SecretModel:
    automata: dict[str, Automaton]
    background: dict[str, dict[str, float]]
    bg_lengths: dict[int, float]
    least: int = LEAST

    def may_fit(self, n: int) -> bool:
        """Whether a format gives values of this length a chance."""
        return n >= self.least and any(a.lengths.get(n, a.unseen_length) >= a.lowest - SLACK for a in self.automata.values())

    def gain(self, value: str) -> float:
        """Best log likelihood ratio of a learned format against ordinary tokens, among the formats
        that give the value at least ``SLACK`` nats below their own labelled values."""
        classes, n = value.translate(TO_CLASS), len(value)
        fits = [p for p, a in ((a.log_prob(classes, n, a.lowest - SLACK), a) for a in self.automata.values()) if p >= a.lowest - SLACK]
        if not fits:
            return -math.inf
        low = self.bg_lengths[min(n, LONGEST)]
        before = END
        for c in classes:
            low += self.background[before][c]
            before = c
        return max(fits) - low


def _background(counts: dict[str, int], least: int) -> tuple[dict[str, dict[str, float]], dict[int, float]]:
    """Step and length log probabilities from the counts of all tokens of ``least`` or more characters."""
    pairs: Counter = Counter()
    sizes: Counter = Counter()
    for key, n in counts.items():
        size, pair = int(key[:2]), key[2:]
        if size >= least and pair:
            pairs[pair[0], pair[1]] += n
        elif size >= least:
            sizes[size] += n
    total = Counter()
    for (a, _), n in pairs.items():
        total[a] += n
    chain = {a: {c: math.log((pairs[a, c] + 0.5) / (total[a] + 0.5 * len(CLASSES))) for c in CLASSES} for a in END + CLASSES}
    room = sum(sizes.values()) + LONGEST
    return chain, {n: math.log((sizes[n] + 1) / room) for n in range(LONGEST + 1)}


def _tally(counts: Counter, shapes: Counter) -> None:
    """Add the steps and lengths of class strings: two digits of length, then a step or nothing."""
    for shape, n in shapes.items():
        size = f"{min(len(shape), LONGEST):02}"
        counts[size] += n
        for step, m in Counter(zip(END + shape, shape)).items():
            counts[size + "".join(step)] += n * m
    shapes.clear()


def _labelled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The lowest-hashed distinct values of each kind that this task has seen, and counts of all its ordinary tokens."""
    counts: Counter = Counter()
    shapes: Counter = Counter()
    heaps: dict[str, list[tuple[int, str]]] = {}
    seen: dict[str, set[str]] = {}

    def offer(kind: str, value: str, room: int) -> None:
        held, own = heaps.setdefault(kind, []), seen.setdefault(kind, set())
        if value in own:
            return
        entry = (-xxhash.xxh32_intdigest(value.encode()), value)
        if len(held) < room:
            heapq.heappush(held, entry)
            own.add(value)
        elif entry > held[0]:
            own.add(value)
            own.discard(heapq.heapreplace(held, entry)[1])

    for b in batches:
        for t in texts(b):
            if t:
                spans = base_spans(t)
                for k, _, z, a in spans:
                    offer(KINDS[k], t[a:z], most)
                shapes.update(t[a:z].translate(TO_CLASS) for a, z in candidates(t, spans))
        if len(shapes) > SHAPES:
            _tally(counts, shapes)
    _tally(counts, shapes)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(["format"] * len(counts)), pa.array(list(counts.values()), pa.int64()), pa.array(list(counts))], names=["kind", "h", "value"])
    for kind, held in heaps.items():
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(held)), pa.array([-h for h, _ in held], pa.int64()), pa.array([v for _, v in held])], names=["kind", "h", "value"])


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> SecretModel:
    """Infer the automata from the base findings of ``docs``; the driver gets 3 * max_train values and a bounded table of counts."""
    found = arrow_map(docs.select(F.col("text").cast("string").alias("text")), lambda it: _labelled(it, max_train), "kind string, h long, value string")
    found = save(found, "secret-values")  # one scan for the four selections below
    parts = [found.where(F.col("kind") == k).distinct().orderBy("h", "value").limit(max_train) for k in KINDS[:3]]
    counts = found.where(F.col("kind") == "format").groupBy("kind", "value").agg(F.sum("h").alias("h")).select("kind", "h", "value")
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(counts).collect()
    by = {k: sorted(r.value for r in rows if r.kind == k) for k in KINDS[:3]}
    least = min([LEAST, *(len(v) for values in by.values() for v in values)])
    chain, lengths = _background({r.value: r.h for r in rows if r.kind == "format"}, least)
    return SecretModel({k: infer(by[k]) for k in KINDS[:3] if by[k]}, chain, lengths, least)


def find(text: str | None, model: SecretModel, min_gain: float = MIN_GAIN) -> list[Span]:
    """All findings by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    learned: list[Span] = []
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < model.least:
            continue
        spans = [s for s in parts(text, *m.span()) if model.may_fit(s[1] - s[0])]
        scored = sorted((-g, a, z) for a, z in _free(sorted(spans), base) if (g := model.gain(text[a:z])) >= min_gain) if spans else []
        own: list[Span] = []
        for _, a, z in scored:  # the best ones that do not overlap
            if not any(a < s[2] and s[1] < z for s in own):
                own.append((3, a, z, a))
        learned += own
    return sorted(base + learned, key=lambda s: (s[1], s[0]))


FINDING = "array<struct<kind:string,start:int,end:int,secret:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.int32())]))


def scan(docs: DataFrame, model: SecretModel, out: str = "findings", min_gain: float = MIN_GAIN) -> DataFrame:
    """``docs`` with its findings; ``secret`` is where the value itself starts. Text column: text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        found = [[{"kind": KINDS[k], "start": a, "end": z, "secret": s} for k, a, z, s in find(t, shared.value, min_gain)] for t in texts(b)]
        return [pa.array(found, _ARROW)]

    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "secret"))]))
    return with_columns(docs, run, [T.StructField(out, kind)])


def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scan(docs, fit(docs))
    label = lambda only: F.concat_ws(",", F.transform(F.filter("findings", lambda s: s["kind"] != "format") if only else F.col("findings"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    return got.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                      F.sha2(label(True), 256).alias("base_sha256"), label(False).alias("spans"), count("format").alias("n_format"))


def redact_text(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """Replace the value of each finding; findings that overlap become one."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, z in sorted((s[3], s[2]) for s in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    for a, z in merged:
        out += [text[at:a], mark]
        at = z
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, min_gain: float = MIN_GAIN) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced; n_chars follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        values = texts(b)
        found = [find(t, shared.value, min_gain) for t in values]
        return [pa.array([redact_text(t, s) if s else t for t, s in zip(values, found)], pa.string()), pa.array([bool(s) for s in found])]

    got = with_columns(docs, run, [T.StructField("__sec_text", T.StringType()), T.StructField("__sec_hit", T.BooleanType())])
    size = lambda c: F.when(F.col("__sec_hit"), F.length("__sec_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias(c)
    return got.select(*[F.col("__sec_text").alias(c) if c == "text" else size(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def digest(spans: list[Span]) -> str:
    """sha256 of the base findings, as the query gives it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z, _ in spans if k < 3).encode()).hexdigest()
