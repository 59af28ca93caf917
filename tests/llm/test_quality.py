import re

import pytest

from demandlake.llm import quality as Q

from . import util


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines)) if len(lines) < 2000 else None
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k:k + 8]), []).append(k)
    covered = {k + j for own in windows.values() if len(own) > 1 for k in own for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def brute(data, limit):
    norm = lambda x: re.sub("[0-9]", "0", " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))))
    lines = lambda t: [norm(x) for x in (t or "").split("\n") if norm(x)]
    seen = {}
    for _, t, _, host, _ in data:
        for x in set(lines(t)):
            seen.setdefault((host, x), set()).add(t)
    out = []
    for i, t, _, host, _ in data:
        b = brute_base(t)
        gone = sum(len(x.split(" ")) for x in lines(t) if len(seen[host, x]) > limit)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        out.append((i, *b, failed, not failed and b[0] - gone >= Q.MIN_REST * b[0], gone))
    return out


def corpus():
    data = util.rows()
    foot = "All Rights reserved, copyright 2019 by the harbor market and its friends everywhere"
    more = "Terms of use, privacy, imprint, contact and the long list of partners in silver copper paper"
    data += [(500 + i, f"{'unique ' + util.WORDS[i] if i % 2 else data[i][1]}\n{foot.replace('2019', str(2000 + i))}\n{more}", "en", "src0", 1) for i in range(12)]
    data += [(600, foot, "en", "src1", 1), (601, "a b c d e f g h " * 9, "en", "src1", 1), (602, "# * $ % & | < > x\n#\n#\n \n \n", "en", None, 1), (603, foot * 3, "en", None, 1)]
    return data


@pytest.mark.parametrize("limit", [3, Q.MAX_DOCS])
def test_equals_brute_force(spark, limit):
    data = corpus()
    got = sorted(map(tuple, Q.judge(util.docs(spark, data), max_docs=limit).collect()), key=str)
    assert got == sorted(brute(data, limit), key=str)


def test_depleted_documents_go(spark):
    got = {r.doc_id: r for r in Q.judge(util.docs(spark, corpus()), max_docs=3).collect()}
    assert not got[501].kept and not got[501].base_failed and got[501].n_removed == 29
    assert got[500].kept and got[600].n_removed == 0  # the line is rare on its own host


def test_collision_path(monkeypatch):
    words = [bytes([97 + i % 26, 97 + i // 26]) for i in range(40)] * 2
    want = Q.repeated_words(words)
    monkeypatch.setattr(Q, "_MIX", Q._MIX * 0)  # every window collides
    assert Q.repeated_words(words) == want == 80


def test_query_and_empty(spark, tmp_path):
    data = corpus()
    got = Q.op9_quality_rules(spark, util.write_tables(spark, tmp_path, data)).collect()
    assert len(got) == len(data) and Q.judge(util.empty(spark)).count() == 0


def test_cleaned_texts(spark):
    data = corpus()
    docs = util.docs(spark, data)
    got = Q.cleaned(docs, max_docs=3)
    assert got.columns == docs.columns and got.count() == len(data)
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[501] == "unique " + util.WORDS[1] and by[600] == data[-4][1] and by[43] is None and by[44] == ""
    removed = {r.doc_id: r.n_removed for r in Q.judge(docs, max_docs=3).collect()}
    words = lambda t: len((t or "").split())
    assert all(words(text) - words(by[i]) == removed[i] for i, text, *_ in data if i is not None and i != 41)
    assert Q.cleaned(util.empty(spark)).count() == 0
