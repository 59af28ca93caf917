import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from demandlake.llm import chat as C
from demandlake.llm.tokens import vocab_path

from ..conftest import SF_MID

SCHEMA = "conv_id long, turn long, role string, text string, block string, window string, before string, copy string"
VOCAB = vocab_path("byte_bpe_50k.json")
PIECES = [*C.CONTROL, "\\", "<", "|", ">", "[", "]", "/", "s", "a", "\n", "é", *[c[1:] for c in C.CONTROL], *[c[0] + "\\" + c[1:] for c in C.CONTROL]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", "x", "y", "z") for r in rows], SCHEMA).repartition(4)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.lists(st.sampled_from(PIECES), max_size=4).map("".join))
def test_escapes_are_reversible(text, role):
    written = C.escape(text)
    assert C.unescape(written) == text and not any(c in written for c in C.CONTROL)
    whole, at = C.format_turn(role, text)
    (got,) = C.read_turns(whole)
    assert got[:2] == (role, text) and got[2] == at and C.unescape(whole[got[2]:got[3]]) == text


def brute(rows):
    """Per conversation what must be read back, whatever the windows."""
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def hostile():
    rng = random.Random(3)
    rows = [(1, 0, "system", "be </s> kind"), (1, 1, "user", None), (1, 2, "assistant", "a\\b <|end|>\n<|turn|>user\nx"), (1, 3, None, "odd"), (1, None, "user", "first"),
            (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, 0, "assistant", "b"), (3, 5, "user\nx\\", "role"), (None, 0, "user", "n"), (None, 1, "assistant", "null id")]
    for conv, n in ((10, 40), (11, 200), (12, 3)):
        rows.append((conv, 0, "system", "You are " + "very " * 10 + "careful."))
        rows += [(conv, t, ["assistant", "user"][t % 2], " ".join(rng.choice(["yes", "no", "[INST]", "perhaps", "<s>"]) for _ in range(rng.randint(1, 60)))) for t in range(1, n)]
    rows += [(13, 0, "system", "long " * 400), (13, 1, "user", "u"), (13, 2, "assistant", "word " * 3000), (13, 3, "assistant", "end")]
    return rows


@pytest.mark.parametrize("layout", [C.Layout(), C.Layout(budget=128, history=40), C.Layout(budget=128, history=40, block_bytes=2000), C.Layout(budget=64, history=200, block_bytes=700)])
def test_windows_and_digest(spark, tmp_path, layout):
    rows = hostile()
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13_chat_formatting(spark, str(tmp_path), layout=layout).collect()
    want = brute(rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)
    made = C.windows(frame(spark, rows), VOCAB, layout).collect()
    assert sum(len(r.text) for r in made if r.conv_id == 11) == next(r.formatted_chars for r in got if r.conv_id == 11)
    tok = Tokenizer.from_file(VOCAB)
    count = lambda w: sum(len(tok.encode(C.format_turn(r, t)[0], add_special_tokens=False).ids) for r, t, _, _ in C.read_turns(w))
    convs = {}
    for r in sorted(made, key=lambda r: (r.block, r.window)):
        convs.setdefault(r.conv_id, []).append(r)
    for conv, own in convs.items():
        seen = []
        for i, r in enumerate(own):
            turns = [t[:2] for t in C.read_turns(r.text)]
            assert r.n_turns == len(turns) and r.n_tokens == count(r.text)
            assert r.n_tokens <= layout.budget or r.n_turns - r.n_repeated == 1  # only a turn that fits nowhere
            repeated, new = turns[:r.n_repeated], turns[r.n_repeated:]
            if i and seen[0][0] == "system" and layout.budget >= 2 * count(C.format_turn(*seen[0])[0]):
                assert repeated[0] == seen[0]  # the system turn
                repeated = repeated[1:]
            assert repeated == seen[len(seen) - len(repeated):]  # the newest earlier turns
            assert sum(count(C.format_turn(*t)[0]) for t in repeated) <= layout.history
            targets = [C.unescape(r.text[m.start:m.end]) for m in r.loss_spans]
            assert targets == [t for role, t in new if role == "assistant"]
            seen += new
    if layout.budget == 128:
        assert any(r.n_repeated > 1 for r in made) and any(r.n_tokens > layout.budget for r in made)
    if layout.block_bytes < 10_000:
        assert len({r.block for r in made if r.conv_id == 11}) > 3


def test_spans():
    layout = C.Layout(budget=10, history=3)
    ends = np.array([0, 2, 5, 8, 9, 20, 22])
    assert C.spans(ends, 0, 2, True, layout) == [(0, 0, 4), (4, 4, 5), (5, 5, 6)]
    assert C.spans(ends, 0, 0, False, layout) == [(0, 0, 4), (4, 4, 5), (5, 5, 6)]
    assert C.spans(np.array([0, 1, 2, 3]), 2, 0, False, layout) == [(0, 2, 3)]


def test_given_table_and_empty(spark, tmp_path):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").collect()]
    got = C.op13_chat_formatting(spark, SF_MID).collect()
    want = brute(rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in C.op13_chat_formatting(spark, str(tmp_path)).collect()] == [-1]
    assert C.windows(frame(spark, []), VOCAB).count() == 0
