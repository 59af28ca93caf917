"""URL filter and revisit resolution."""

import datetime as dt
import random
import re

import pytest

from demandlake.llm import url_filter as U
from demandlake.llm import warc_revisit as V
from demandlake.plans.verify import compare, duck_connect

from ..conftest import SF_SMALL
from . import util

PAGES = [(1, "http://A.Example.com/de/1?x#y", '<a href="https://good.example.org/x">'), (2, None, None), (3, "no scheme", ""), (4, "x://b.net/en/", "<a href='//spam.org/1'>"),
         (5, "https://sub.example.net/en/p", '<A HREF = http://friend.info/>'), (6, "https://example.net", None), (7, "://org/fr/z", ""), (8, "http://notexample.com/de/", ""),
         (9, "http://spam.org/a\nb?c", '<a href="http://b.net/"><a href="http://b.net/2">'), (10, "http://friend.info/", ""), (10, "http://friend.info/", ""), (11, "http://HOST?x", ""),
         (12, "http://h#f://z/q", ""), (13, "a://b://c/d", ""), (14, "https://xorg/fr/", "")]


def brute_rules(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])
    fit = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def brute_rank(pages, steps=150):
    rows = [(*brute_rules(u), h) for _, u, h in pages]
    hosts = {}
    for host, _, _, verdict, _ in rows:
        if host:
            hosts.setdefault(host, []).append(verdict)
    links = {}
    for host, _, _, _, html in rows:
        for link in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z]+:)?//[^\s"'<>]+)""", html or "") if host else []:
            to = brute_rules(link if "://" in link else "x:" + link)[0]
            if to and to != host:
                links[host, to] = links.get((host, to), 0) + 1
    names = set(hosts) | {h for e in links for h in e}
    good = {h: sum(v == "allow" for v in hosts.get(h, [])) / max(1, len(hosts.get(h, []))) for h in names}
    bad = {h: sum(v == "block" for v in hosts.get(h, [])) / max(1, len(hosts.get(h, []))) for h in names}
    t, d = ({h: 0.15 * x[h] for h in names} for x in (good, bad))
    for _ in range(steps):
        t, d = ({h: 0.15 * good[h] + 0.85 * sum(t[a] * n / sum(m for (x, _), m in links.items() if x == a) for (a, b), n in links.items() if b == h) for h in names},
                {h: 0.15 * bad[h] + 0.85 * sum(d[b] * n / sum(m for (x, _), m in links.items() if x == a) for (a, b), n in links.items() if a == h) for h in names})
    return t, d


def test_rules_and_propagation(spark, tmp_path):
    path = util.write_tables(spark, tmp_path, [], pages=PAGES)
    got = U.op7_url_filter(spark, path).collect()
    t, d = brute_rank(PAGES)
    assert len(got) == len(PAGES)
    urls = {i: u for i, u, _ in PAGES}
    for r in got:
        host, p, rule, verdict = brute_rules(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, p, rule)
        assert abs(r.trust - t.get(host, 0)) < 1e-5 and abs(r.distrust - d.get(host, 0)) < 1e-5
        assert r.verdict == (verdict or ("block" if d.get(host, 0) - t.get(host, 0) >= 0.075 else "allow"))
    by = {r.page_id: r for r in got}
    assert by[9].verdict == "block" and by[9].rule is None  # links to a blocked host
    assert by[10].trust > 0 and by[2].verdict == "allow"


def verdicts(spark, links):
    """Verdict of each host that links ((host, target, times)); no rule fits any but the targets under net."""
    pages, own = [], {}
    for i, (host, target, times) in enumerate(links):
        own.setdefault(host, i)
        pages.append((i, f"http://{host}/", f'<a href="http://{target}/x">' * times))
    pages += [(10_000 + i, f"http://{t}/", "") for i, t in enumerate(sorted({t for _, t, _ in links}))]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    return {h: got[i] for h, i in own.items()}


@pytest.mark.parametrize("n", [1, 2, 10, 1000])
def test_linkers_of_one_blocked_host(spark, n):
    """However many hosts link to a blocked host alone, each is blocked; a large clean host with one bad link is not."""
    links = [(f"farm{i}.com", "bad.net", 1) for i in range(n)] + [("clean.com", f"good{i}.info", 5) for i in range(50)] + [("clean.com", "bad.net", 1), ("half.com", "bad.net", 1), ("half.com", "good1.info", 1)]
    got = verdicts(spark, links)
    assert {v for h, v in got.items() if h.startswith("farm")} == {"block"} and got["clean.com"] == got["half.com"] == "allow"


def test_long_paths_and_cycles(spark):
    """Distrust runs back along a path until it is too thin, and a cycle is followed to the end."""
    path = [(f"p{i}.com", f"p{i + 1}.com" if i else "bad.net", 1) for i in range(1)] + [(f"p{i}.com", f"p{i - 1}.com", 1) for i in range(1, 8)]
    got = verdicts(spark, path)
    assert [got[f"p{i}.com"] for i in range(8)] == ["block" if 0.15 * 0.85 ** (i + 1) >= 0.075 else "allow" for i in range(8)]
    cycle = [("a.com", "b.com", 1), ("b.com", "a.com", 1), ("b.com", "bad.net", 9)]
    rank = {r.host: r.distrust for r in U.propagate(spark.createDataFrame([("bad.net", 0.0, 1.0)], "host string, good double, bad double"),
                                                    spark.createDataFrame(cycle, "src string, dst string, n long")).collect()}
    b = 0.85 * 0.9 * 0.15 / (1 - 0.85 * 0.1 * 0.85)
    assert abs(rank["b.com"] - b) < 1e-5 and abs(rank["a.com"] - 0.85 * b) < 1e-5


HOSTILE = [(i, u, h, "clash", "verdict", 1.0) for i, u, h in PAGES] + [(20, "http://long.info/a", "<a href='http://other.info/'>" + "x" * 200_000, "c", "v", 2.0),
                                                                       (None, "http://long.info/a", "h", None, None, None), (21, "", "", "", "", 0.0), (22, None, None, None, None, None), (23, None, "late", "a", "b", 0.5)]


@pytest.mark.parametrize("query, sql", [(U.op7_url_filter, U.ORACLE_SQL), (V.op8_warc_revisit, V.ORACLE_SQL)])
def test_oracle_on_hostile_pages(spark, tmp_path, query, sql):
    import duckdb

    spark.createDataFrame(HOSTILE, "page_id long, url string, html string, host string, verdict string, trust double").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got, want = query(spark, str(tmp_path)).toPandas(), con.execute(sql).df()
    for df in (got, want):
        for c in ("trust", "distrust"):
            if c in df:
                df[c] = df[c].round(4)
    ok, said = compare(got, want)
    assert ok, said


def test_url_filter_is_native(spark):
    plan = U.op7_url_filter(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("query, sql", [(U.op7_url_filter, U.ORACLE_SQL), (V.op8_warc_revisit, V.ORACLE_SQL)])
def test_oracle(spark, query, sql):
    ok, said = compare(query(spark, SF_SMALL).toPandas(), duck_connect(SF_SMALL).execute(sql).df())
    assert ok, said


def test_no_pages(spark, tmp_path):
    path = util.write_tables(spark, tmp_path, [])
    assert U.op7_url_filter(spark, path).count() == 0 and V.op8_warc_revisit(spark, path).count() == 0


def record(i, kind, url, at, headers):
    return i, kind, url, None if at is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), headers


SCHEMA = "record_id long, kind string, url string, date timestamp_ntz, headers string, h string, late string"


def test_resolution(spark):
    rows = [record(1, "response", "http://www.A.com:80/x/?utm_source=q&b=2&a=1#f", 10, 'ETag: "1"\r\nContent-Length: 9\r\nX: old\r\nX: older'),
            record(2, "response", "https://a.com/x?a=1&b=2", 20, 'etag: W/"2"\nContent-Type: t'),
            record(3, "revisit", "http://a.com/x?b=2&a=1", 15, 'ETAG: W/"1"\r\nContent-Length: 0\r\nX: new'),
            record(4, "revisit", "http://a.com/x?b=2&a=1", 30, 'ETag: "1"'),
            record(5, "revisit", "http://a.com/x?b=2&a=1", 5, None),
            record(6, "revisit", "http://a.com/x?b=2&a=1", 20, 'ETag: "2"'),  # the same date: the response counts as earlier
            record(7, "revisit", None, 20, ""), record(8, "revisit", "http://a.com/x?b=2&a=1", None, ""),
            record(9, "response", "http://lm.com", 1, "Last-Modified: a"), record(10, "revisit", "http://lm.com/", 2, 'Last-Modified: a\nETag: "z"'),
            record(11, "revisit", "http://lm.com/", 3, "Last-Modified: b"), record(12, "revisit", "http://lm.com/", 3, "junk"), record(13, None, None, None, None),
            record(10, "revisit", "http://lm.com/", 2, 'Last-Modified: a\nETag: "z"')]
    records = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = V.resolve(records)
    by = {r.record_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert {i: (r.outcome, r.refers_to) for i, r in by.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("resolved", 1), 4: ("changed", 2), 5: ("no_response", None), 6: ("resolved", 2), 7: ("no_url", None), 8: ("no_url", None),
        9: ("response", None), 10: ("resolved", 9), 11: ("changed", 9), 12: ("unverified", 9), 13: ("no_url", None)}
    assert by[3].headers == {"etag": 'W/"1"', "content-length": "9", "x": "new"} and by[1].headers["x"] == "older"
    assert by[4].headers == {"etag": '"1"'} and by[3].canonical == "a.com/x?a=1&b=2"
    paid = {r.record_id: r.payload for r in V.attach_payload(got, spark.createDataFrame([(1, "p1"), (2, None), (9, "p9")], "record_id long, payload string")).collect()}
    assert (paid[1], paid[3], paid[4], paid[6], paid[10]) == ("p1", "p1", None, None, "p9")


def test_one_hot_url_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [record(i, rng.choice(["response", "revisit"]), "http://hot.com/" if rng.random() < 0.8 else f"http://u{rng.randint(0, 9)}.com/", rng.randint(0, 300), f'ETag: "{rng.randint(0, 2)}"') for i in range(600)]
    got = {r.record_id: r for r in V.resolve(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(5)).collect()}
    for i, kind, url, at, etag in rows:
        if kind == "revisit":
            before = [r for r in rows if r[1] == "response" and r[2] == url and r[3] <= at]
            best = max(before, key=lambda r: (r[3], r[0]), default=None)
            assert (got[i].refers_to, got[i].outcome) == ((best[0], "resolved" if best[4] == etag else "changed") if best else (None, "no_response"))
