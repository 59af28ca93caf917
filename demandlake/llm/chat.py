"""Chat formatting in budgeted windows.

A turn is written as START role newline text END, with control strings inside roles and texts
escaped: one backslash more after their first character, which reading takes away again. A
conversation (rows by turn) is cut at turn boundaries into windows of at most ``budget`` tokens:
prefix sums of the turns' token counts say, for a window's first new turn, which turn is its last.
Every window after the first opens with the conversation's system turn (a first turn of role
``system`` that takes up to half the budget) and repeats the newest earlier turns that fit into
``history`` tokens and leave room for the first new turn. The loss mask covers the texts of new
assistant turns: a repeated one is masked, so every target counts once. A turn longer than the
budget is never cut and has a window of its own.

Turns are laid out in blocks of ``block_bytes`` bytes by a prefix sum over the conversation, and a
window never crosses a block, so a task holds a block, the system turn and the history before it,
however long the conversation is. Conversations within one block, found by one aggregate, skip the
prefix sum. ``digest`` reads windows back; it streams a conversation's windows in order, as a hash of
whole texts needs.

Defined results: null text or role -> empty; turns are ordered by turn (null first), then role and
text; repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives no
rows; other columns are ignored; very long turns are written whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import running_agg
from .common import arrow_map, save, table
from .tokens import encoder, vocab_path

#: Control strings (fixed values): the template's own, then those of widespread chat templates.
START, END = "<|turn|>", "<|end|>"
CONTROL = [START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
_RESTS = "|".join(re.escape(first) + r"{}(?=\\*(?:" + "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) + "))" for first in sorted({c[0] for c in CONTROL}))
_ESCAPE = re.compile(_RESTS.replace("{}", ""))
_UNESCAPE = re.compile(_RESTS.replace("{}", r"\\"))
_ROLE_ESCAPE = re.compile(r"\\[\\n]")

BUDGET, HISTORY = 2048, 256
BLOCK_BYTES = 1 << 20
TURN_BYTES = 32  # that a turn takes besides role and text
TOGETHER_BYTES = 1 << 20  # of turns that are encoded together, at least
BYTES_A_TOKEN = 16  # history reaches back HISTORY tokens and as many times these bytes at most


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The written turn and where its text begins; newlines of a role are escaped too."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    return head + escape(text) + END + "\n", len(head)


def _read_role(written: str) -> str:
    return _ROLE_ESCAPE.sub(lambda m: "\n" if m[0] == "\\n" else "\\", unescape(written)) if "\\" in written else written


def read_turns(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a window; start and end span its written text."""
    out, at = [], 0
    while window.startswith(START, at):
        text_at = window.index("\n", at) + 1
        end = window.index(END + "\n", text_at)
        out.append((_read_role(window[at + len(START):text_at - 1]), unescape(window[text_at:end]), text_at, end))
        at = end + len(END) + 1
    return out


@dataclass(frozen=True)
class Layout:
    """How conversations are cut."""

    budget: int = BUDGET
    history: int = HISTORY
    block_bytes: int = BLOCK_BYTES

    @property
    def history_bytes(self) -> int:
        return min(self.history * BYTES_A_TOKEN, self.block_bytes)


def spans(ends: np.ndarray, first: int, system: int, inside: bool, layout: Layout) -> list[tuple[int, int, int]]:
    """(repeated from, new from, new to) of each window of a block.

    ``ends`` holds the prefix sums of the turns' tokens, a zero in front; turns before ``first`` are
    history of the block before. ``system`` are the tokens of the system turn that windows open with;
    ``inside``: it is the block's first turn, so the first window holds it anyway.
    """
    out, at, n = [], first, len(ends) - 1
    while at < n:
        own = inside and at == 0
        room = layout.budget - (0 if own else system)
        spare = room - int(ends[at + 1] - ends[at])
        back = at if own else max(int(np.searchsorted(ends, ends[at] - min(layout.history, max(spare, 0)))), int(inside))
        to = max(int(np.searchsorted(ends, ends[back] + room, "right")) - 1, at + 1)
        out.append((back, at, to))
        at = to
    return out


def _ordered(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    return rows.withColumn("bytes", (F.octet_length("role") + F.octet_length("text") + TURN_BYTES).cast("long"))


def _blocks(conversations: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """Rows of conversations within one block, and of longer ones, each dealt and sorted by block.

    ``copy`` says what a row is: 0 a turn of the block, 1 history, 2 the system turn of an earlier block.
    """
    rows, size = _ordered(conversations), F.lit(layout.block_bytes).cast("long")
    long = rows.groupBy(F.col("conv_id").alias("_long")).agg(F.sum("bytes").alias("_bytes")).where(F.col("_bytes") > size).select("_long")
    long = save(long, "long-conversations")  # of known size then: mostly few, and no text moves to be told apart
    of_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    short = rows.join(long, of_long, "left_anti").select("conv_id", "turn", "role", "text", zero.alias("block"), F.lit(0).alias("copy"), zero.alias("before"))
    hot = rows.join(long, of_long, "left_semi").withColumn("_tie", F.monotonically_increasing_id())
    placed = running_agg(hot, ["conv_id"], ["turn", "role", "text", "_tie"], [("before", "sum", F.col("bytes"), False), ("_at", "sum", one, False)])
    placed = placed.withColumn("block", F.floor(F.col("before") / size).cast("long"))
    opens = (F.col("_at") == 0) & (F.col("role") == "system")
    turns = ["conv_id", "turn", "role", "text"]
    own = placed.select(*turns, "block", F.lit(0).alias("copy"), "before")
    reaches = F.col("before") >= (F.col("block") + 1) * size - layout.history_bytes
    history = placed.where(reaches & ~opens).select(*turns, F.col("block") + 1, F.lit(1), "before")
    later = placed.where("block > 0").select(F.col("conv_id").alias("_of"), F.col("block").alias("_block")).distinct()
    system = placed.where(opens).join(later, F.col("conv_id").eqNullSafe(F.col("_of"))).select(*turns, "_block", F.lit(2), F.lit(-1).cast("long"))
    order = ["conv_id", "block", "before", F.col("turn").asc_nulls_first(), "role", "text"]
    return tuple(x.repartition("conv_id", "block").sortWithinPartitions(*order) for x in (short, own.unionAll(history).unionAll(system)))


@dataclass
class _Block:
    """The written turns of a block: those before ``first`` are history; ``inside``: the system turn is the block's first."""

    key: tuple
    turns: list[tuple[str, str, int, int]]
    written: list[tuple[str, int]]
    first: int
    system: str | None
    inside: bool


def _block(key: tuple, turns: list[tuple[str, str, int, int]], layout: Layout) -> _Block | None:
    """From (role, text, copy, before) rows in order; None for history of a block in which no turn begins."""
    system = next((format_turn(*t[:2])[0] for t in turns if t[2] == 2), None)
    turns = [t for t in turns if t[2] != 2]
    first = sum(t[2] == 1 for t in turns)
    if first == len(turns):
        return None
    skip = sum(turns[first][3] - t[3] > layout.history_bytes for t in turns[:first])
    turns, first = turns[skip:], first - skip
    written = [format_turn(role, text) for role, text, _, _ in turns]
    inside = system is None and first == 0 and turns[0][3] == 0 and turns[0][0] == "system"
    return _Block(key, turns, written, first, written[0][0] if inside else system, inside)


def _block_windows(b: _Block, sizes: np.ndarray, opens: int, layout: Layout) -> list[tuple]:
    """(window, text, n_tokens, n_turns, n_repeated, loss_spans) of a block; ``sizes``: tokens of its turns, ``opens``: of its system turn."""
    system, inside = b.system, b.inside
    if 2 * opens > layout.budget:
        system, opens, inside = None, 0, False
    ends, out = np.concatenate([[0], np.cumsum(sizes)]), []
    for number, (back, at, to) in enumerate(spans(ends, b.first, opens, inside, layout)):
        head = [] if system is None or (inside and at == 0) else [system]
        place, marks = sum(map(len, head)), []
        for k in range(back, to):
            body, text_at = b.written[k]
            if k >= at and b.turns[k][0] == "assistant":
                marks.append({"start": place + text_at, "end": place + len(body) - len(END) - 1})
            place += len(body)
        out.append((number, "".join(head + [w for w, _ in b.written[back:to]]), int(ends[to] - ends[back]) + opens * len(head), len(head) + to - back, len(head) + at - back, marks))
    return out


_FIELDS = [("window", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()),
           ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
WINDOW = "block long, window int, text string, n_tokens long, n_turns int, n_repeated int, loss_spans array<struct<start:int,end:int>>"


def _cut(dealt: DataFrame, vocab: str, layout: Layout) -> DataFrame:
    """The windows of dealt rows, block after block."""

    def made(blocks: list[_Block], enc) -> Iterator[pa.RecordBatch]:
        """The windows of some blocks, all their turns encoded at once."""
        if not blocks:
            return
        _, cuts = enc.encode_lists([w for b in blocks for w, _ in b.written] + [b.system for b in blocks])
        sizes = np.diff(cuts, prepend=0) - 1  # without the end id
        opens, rows, at = sizes[len(sizes) - len(blocks):].tolist(), [], 0
        for b, own in zip(blocks, opens):
            got = _block_windows(b, sizes[at:at + len(b.written)], own, layout)
            rows += [(b.key[2], b.key[1], *w) for w in got]
            at += len(b.written)
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(cols[0]), pa.array(cols[1], pa.int64()), *[pa.array(c, t) for c, (_, t) in zip(cols[2:], _FIELDS)]], names=["conv_id", "block", *[f for f, _ in _FIELDS]])

    def run(batches):
        enc, key, held, waiting, size = encoder(vocab, False), None, [], [], 0
        for b in batches:
            ids, blocks = b.column(0).to_pylist(), b.column(4).to_pylist()
            for i, turn in enumerate(zip(*[b.column(c).to_pylist() for c in (2, 3, 5, 6)])):
                if key is None or (ids[i], blocks[i]) != key[:2]:
                    if held:
                        waiting.append(_block(key, held, layout))
                    if size > TOGETHER_BYTES:
                        yield from made([w for w in waiting if w is not None], enc)
                        waiting, size = [], 0
                    key, held = (ids[i], blocks[i], b.column(0).slice(i, 1)), []
                held.append(turn)
                size += len(turn[1]) + TURN_BYTES
        if held:
            waiting.append(_block(key, held, layout))
        yield from made([w for w in waiting if w is not None], enc)

    return arrow_map(dealt, run, f"conv_id {dealt.schema['conv_id'].dataType.simpleString()}, {WINDOW}")


def windows(conversations: DataFrame, vocab: str, layout: Layout = Layout()) -> DataFrame:
    """(conv_id, block, window, text, n_tokens, n_turns, n_repeated, loss_spans) of every window.

    ``n_repeated`` turns at the front of ``text`` (system turn and history) occur in earlier windows;
    ``loss_spans`` are the code points of the written assistant texts that count.
    """
    short, long = _blocks(conversations, layout)
    return _cut(short, vocab, layout).unionAll(_cut(long, vocab, layout))


def digest(ordered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from windows whose conversations lie in order in a partition."""

    def run(batches):
        state, ended = None, []  # conv_id as it came, as a value, turns, hash of turns, loss characters, hash of loss, characters

        def rows():
            """What has ended since the last call, as one batch."""
            ids, _, turns, turns_hash, loss, loss_hash, chars = zip(*ended)
            ended.clear()
            hexed = lambda hashes: pa.array([h.hexdigest() for h in hashes], pa.string())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(turns, pa.int64()), hexed(turns_hash), pa.array(loss, pa.int64()), hexed(loss_hash), pa.array(chars, pa.int64())],
                                              names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            ids = b.column(0).to_pylist()
            for i, (text, repeated, marks) in enumerate(zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "n_repeated", "loss_spans")])):
                if state is None or ids[i] != state[1]:
                    if state is not None:
                        ended.append(state)
                    state = [b.column(0).slice(i, 1), ids[i], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in read_turns(text)[repeated:]:
                    state[2] += 1
                    state[3].update(f"{role}\n{body}\n".encode())
                for m in marks:
                    target = unescape(text[m["start"]:m["end"]])
                    state[4] += len(target)
                    state[5].update(target.encode())
                state[6] += len(text)
            if ended:
                yield rows()
        if state is not None:
            ended.append(state)
            yield rows()

    return arrow_map(ordered, run, f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op13_chat_formatting(spark, sf_dir, vocab: str | None = None, layout: Layout = Layout()):
    rows = table(spark, sf_dir, "conversations")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    columns = ["conv_id", "turn", "role", "text"]
    vocab = vocab or vocab_path("byte_bpe_50k.json")
    short, long = _blocks(rows.select(*columns).unionAll(own.select(*[F.col(c).cast(rows.schema[c].dataType) for c in columns])), layout)
    again = _cut(long, vocab, layout).repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return digest(_cut(short, vocab, layout)).unionAll(digest(again))
