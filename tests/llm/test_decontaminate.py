import random

from demandlake.llm import decontaminate as D

from . import util

ITEM = "A train leaves Boston with Alice Miller aboard and travels 120 km in 3 hours. How many km does Alice Miller travel in 7 hours if the train keeps its speed?"
SHORT = "Name the river"


def brute(docs, items):
    """(doc row, item) pairs by comparing every window of every document with every window of every item."""
    def template(words):
        out, start, number = [], True, False
        for w in words:
            core = w.strip(D.EDGES)
            low = core.lower()
            m = D.MEASURE.fullmatch(low)
            if D.NUMBER.fullmatch(core) or (m and m[1] in D.UNITS):
                out.append("<num>")
            elif number and low in D.UNITS:
                out.append("<unit>")
            elif core[:1].isupper() and not start:
                out.append("<name>")
            else:
                out.append(low)
            number = out[-1] == "<num>"
            start = w.rstrip(D.CLOSERS).endswith(D.STOPS)
        return out

    found = set()
    for i, text in items:
        iw = text.split()
        it = template(iw)
        at = range(max(0, len(it) - D.WINDOW + 1))
        rich = [p for p in at if sum(x[:1] != "<" for x in it[p:p + D.WINDOW]) >= D.LITERALS] or list(at)
        for d, body in enumerate(docs):
            dt = template((body or "").split())
            if 0 < len(it) < D.WINDOW:
                if dt == it:
                    found.add((d, i))
                continue
            hits = {p for p in rich for q in range(len(dt) - D.WINDOW + 1) if dt[q:q + D.WINDOW] == it[p:p + D.WINDOW]}
            if rich and len(hits) >= D.MIN_SIMILARITY * len(rich):
                found.add((d, i))
    return found


def corpus():
    rng = random.Random(2)
    pad = lambda: util.sentence(rng, 30) + ". "
    new = ITEM.replace("120", "95").replace("Boston", "Paris").replace("Alice Miller", "Zoe Brown").replace("7 hours", "9 hours")
    mixed = "A train leaves Boston with Alice Miller aboard and travels 120 km in 3 hours. How many km does Omar Reed travel in 7 hours if the train keeps its speed?"
    texts = [pad() + ITEM + " " + pad(), pad() + new, pad() + ITEM.upper(), pad() + ITEM[:60], pad(), SHORT, "name the River", SHORT + " again", None, "", pad() + ITEM + " " + ITEM,
             "km " * 50, "1 2 3 4 5 6 7 8 9 10 11 12", pad() + mixed, "5 6 7 8 9 10 11 12 13 14"]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_finds_exact_and_reparameterised(spark):
    items = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, "7 8 9 10 11 12 13")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.scan(util.docs(spark, corpus()), bench).collect()}
    assert got[0, 1].kind == "exact" and got[1, 1].kind == "reparameterised" and got[10, 1].kind == "exact"
    assert (3, 1) not in got and (4, 1) not in got
    assert (5, 2) in got and (7, 2) not in got and (12, 5) not in got and got[14, 5].kind == "exact" and got[13, 1].kind == "reparameterised"
    # the template fits but one name stands for two: only a share of the slots may disagree
    names = D.build([(1, "Ask Ann Lee then Ann Lee again whether Ann Lee or Ann Lee came with Ann Lee today and if Ann Lee left")])
    for other, n in (("Ann Lee", 1), ("Bo Ray", 1)):
        text = names.words[0]
        assert len(list(D.matches(names, [" ".join(text).replace("Ann Lee", other)]))) == n
    mix = "Ask Ann Lee then Bo Ray again whether Cy Fox or Di Hay came with Ed Ivy today and if Flo Orr left"
    assert not list(D.matches(names, [mix]))


def test_equals_brute_force_on_literal_items(spark):
    rng = random.Random(4)
    items = [(i, util.sentence(rng, n)) for i, n in enumerate([4, 5, 6, 16, 30, 60, 60])]
    texts = [util.sentence(rng, 20) + " " + t + " " + util.sentence(rng, 20) for _, t in items] + [t for _, t in items]
    texts += [" ".join(t.split()[: len(t.split()) * k // 10]) for _, t in items for k in (5, 7, 8, 9)] + [None, ""]
    docs = util.docs(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for block in (D.BLOCK_WINDOWS, 40):  # one block, several blocks
        assert {(r.doc_id, r.item_id) for r in D.scan(docs, bench, block).collect()} == want
        kept = [r.doc_id for r in D.drop_leaks(docs, bench, block).collect()]
        assert sorted(kept) == sorted(set(range(len(texts))) - {d for d, _ in want})


def test_hostile_rows(spark, tmp_path):
    base = util.rows()[7][1]
    path = util.write_tables(spark, tmp_path, benchmark=[(1, base), (1, base), (2, None)])
    got = D.op4_benchmark_decontamination(spark, path).collect()
    assert {r.doc_id for r in got} == {7} and len(got) == 2
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    kept = D.drop_leaks(util.docs(spark), bench)
    assert kept.columns == util.docs(spark).columns and kept.count() == len(util.rows()) - 1
    assert D.scan(util.empty(spark), bench).count() == 0 and D.scan(util.docs(spark), bench.limit(0)).count() == 0
    assert D.drop_leaks(util.docs(spark), bench.limit(0)).count() == len(util.rows())


TOM = "Tom has 3 apples. Tom buys 5 more apples at the market. Tom gives 2 apples to a friend. How many apples does Tom have now?"


def kinds(item, text, **kw):
    return [m[4] for m in D.matches(D.build([(1, item)]), [text], **kw)]


def test_case_and_name_changes_are_found():
    for copy in (ITEM.lower(), ITEM.upper(), ITEM.replace("Alice Miller", "alice miller"), TOM.upper(), TOM.lower()):
        assert kinds(ITEM if "rain" in copy.lower() else TOM, "they asked this " + copy + " and so on") == ["exact"]
    for old, new in (("Tom", "Anna"), ("Tom", "Anna Maria Lopez")):
        assert kinds(TOM, "Before it. " + TOM.replace(old, new).replace("3", "8")) == ["reparameterised"]
    assert kinds(ITEM, ITEM.replace("Boston", "New York").replace("Alice Miller", "Zoe")) == ["reparameterised"]
    assert kinds(ITEM, ITEM.replace("How many", "how many").replace("Alice Miller", "Zoe Brown")) == ["reparameterised"]
    assert kinds("The Old Man And The Sea By Hemingway was first printed in", "A New Book By Somebody Else was first printed in") == []


def test_signs_are_no_literals():
    sums = [(i, f"{i % 7} + {i} - 2 + {i // 7} = {i + 10}") for i in range(4000)]
    block = D.build([(-1, "3 + 4 - 2 + 5 = 10"), *sums])
    table = " ".join(f"{a} | {b} | {a + b} |\n" for a in range(200) for b in range(100))
    assert not list(D.matches(block, ["17 | 22 | 95 | 31 | 40 | 8", table]))
    got = list(D.matches(block, ["so 3 + 4 - 2 + 5 = 10 holds", "so 3 + 4 - 2 + 6 = 10 holds", "so 3 * 4 / 2 * 5 = 10 holds"]))
    assert [(d, block.ids[i], kind) for d, i, _, _, kind in got] == [(0, -1, "exact")]


def test_items_of_one_template_share_it(monkeypatch):
    items = [(i, f"Bob has {i} apples and eats {i + 1} of them, how many are left on the table?") for i in range(3000)]
    block = D.build(items)
    assert all(len(t.items) <= 1 for t in block.tables)
    text = " ".join(items[5][1].replace("Bob", "Eve") for _ in range(20))
    want = list(D.matches(block, [text, items[7][1]]))
    assert len({(m[0], m[1]) for m in want}) == len(want) and (0, 5) in {m[:2] for m in want}
    assert {m[1] for m in want if m[0] == 1 and m[4] == "exact"} == {7}
    monkeypatch.setattr(D, "PAIRS", 7)
    assert list(D.matches(block, [text, items[7][1]])) == want


def test_passages_and_short_items(spark, tmp_path):
    rng = random.Random(8)
    long = [rng.choice(util.WORDS) + f"x{k}" for k in range(60)]
    block = D.build([(1, " ".join(long)), (2, "Who wrote Hamlet?"), (3, "Who wrote War and Peace?"), (4, "17"), (5, " ".join(map(str, range(60))))])
    found = lambda text: {(block.ids[m[1]], m[4]) for m in D.matches(block, [text], True)}
    assert found("a b " + " ".join(long[20:50]) + " c") == {(1, "passage")} == found(" ".join(long[47:]).upper())
    assert found("a b " + " ".join(long[20:32]) + " c") == set()
    assert found("then ask: Who wrote Hamlet? or not") == {(2, "exact")} == found("they asked who wrote hamlet")
    assert found("Who wrote Hamlet?") == {(2, "exact")} and len(list(D.matches(block, ["Who wrote Hamlet?"], True))) == 1
    assert found("question Who wrote War and Peace? answer") == {(3, "exact")}
    assert found("page 17 of " + " ".join(map(str, range(20)))) == set()  # counting is no passage
    data = [(i, t, "en", "s", 0) for i, t in enumerate([" ".join(long[5:40]), "then who wrote hamlet", " ".join(long[5:15]), "x " + " ".join(long), None])]
    path = util.write_tables(spark, tmp_path, data, benchmark=[(1, " ".join(long)), (2, "Who wrote Hamlet?")])
    got = {(r.doc_id, r.item_id, r.kind) for r in D.op4_benchmark_decontamination(spark, path).collect()}
    assert got == {(0, 1, "passage"), (1, 2, "exact"), (3, 1, "exact")}
    import corpus_pipeline as P

    assert sorted(r.doc_id for r in P.benchmark_decontamination(spark, util.docs(spark, data), path).collect()) == [2, 4]
