"""URL filter: host and path rules, and link-graph propagation for urls that no rule covers.

Rules name a host (and its subdomains) and a path prefix; the longest that fits wins. Urls that no
rule fits are judged by their host. Two personalised PageRank vectors run over the host graph (edge
weights: links between distinct hosts, shares of the source's links): trust starts at hosts whose
urls the rules allow and follows links; distrust starts at hosts whose urls the rules block and
follows links backwards, to each linker by the share of its own links, so it does not thin out where
many hosts link to a blocked one, and one bad link among many weighs little. A seed's weight is the
share of the host's urls with that verdict. A host whose distrust exceeds its trust by ``THRESHOLD``
times what a fully blocked host starts with is blocked. Hosts without links keep only their own seeds.

All on DataFrame functions: no Python on the executors. Each step is one join and one partial
aggregate over edges summed per host pair; every ``STRIDE`` steps the vectors are written to the shared
checkpoint folder, and steps end when neither has moved by ``TOLERANCE`` in them. Damping makes every
step smaller by that factor, so they end on any graph, after about 75 steps and a few for each power of
ten of hosts.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; null html has no links; repeated pages count again in a host's shares; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, table

#: (host, path, verdict) (fixed values)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, THRESHOLD = 0.85, 0.5
STRIDE, TOLERANCE = 5, 1e-6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together) and its verdict; nulls if none does."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    name = F.coalesce(*[F.when(_fits(host, path, r), F.lit(r[0] + r[1])) for r in ranked])
    verdict = F.coalesce(*[F.when(_fits(host, path, r), F.lit(r[2])) for r in ranked])
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between distinct hosts, summed per pair. ``pages``: (host, html)."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""), F.lit(1))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    links = pages.where((F.col("host") != "") & F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(hrefs).alias("link")).select("src", host_of(full).alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, stride: int = STRIDE, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from (host, good, bad) seeds in [0, 1] and (src, dst, n) links."""
    ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    known = hosts.select("host", "good", "bad")
    known = save(known.unionByName(ends.join(known, "host", "left_anti").select("host", F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))), "hosts")
    out_n = edges.groupBy("src").agg(F.sum("n").alias("out")).withColumnRenamed("src", "s")
    both = edges.join(out_n, F.col("src") == F.col("s")).withColumn("w", F.col("n") / F.col("out"))
    # trust moves src -> dst, distrust dst -> src, both by the source's share
    moves = save(both.select(F.col("src").alias("tail"), F.col("dst").alias("head"), F.col("w").alias("good_w"), F.lit(0.0).alias("bad_w")).unionAll(
        both.select(F.col("dst"), F.col("src"), F.lit(0.0), F.col("w"))), "host-moves")
    rank = known.select("host", ((1 - damping) * F.col("good")).alias("trust"), ((1 - damping) * F.col("bad")).alias("distrust"))
    if moves.limit(1).count() == 0:
        return rank
    moved = tolerance
    while moved >= tolerance:
        was = rank.select(F.col("host").alias("h"), F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        for _ in range(stride):
            came = moves.join(rank, F.col("tail") == F.col("host")).groupBy("head").agg(F.sum(F.col("trust") * F.col("good_w")).alias("t"), F.sum(F.col("distrust") * F.col("bad_w")).alias("b"))
            rank = known.join(came, F.col("host") == F.col("head"), "left").select(
                "host", ((1 - damping) * F.col("good") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"), ((1 - damping) * F.col("bad") + damping * F.coalesce("b", F.lit(0.0))).alias("distrust"))
        rank = save(rank, "host-rank")
        moved = rank.join(was, F.col("host") == F.col("h")).agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0")))).alias("m")).first().m or 0.0
    return rank


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per page."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = named.withColumns({"rule": rule, "ruled": verdict})
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    hosts = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    rank = propagate(hosts, save(host_edges(rows), "host-edges"), damping)
    rank = rank.withColumnRenamed("host", "of")
    got = rows.drop("html").join(rank, F.col("host") == F.col("of"), "left")
    bad = F.coalesce(F.col("distrust") - F.col("trust") >= threshold * (1 - damping), F.lit(False))
    return got.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op7_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """The same in SQL, with a fixed number of steps that settles any graph of a test's size."""
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
    fits = lambda r: f"((host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}'))"
    ranked = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    case = lambda j: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{(r[0] + r[1], r[2])[j]}'" for r in ranked) + " END"
    return f"""WITH RECURSIVE named AS (SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS MATERIALIZED (SELECT *, {case(0)} AS rule, {case(1)} AS ruled FROM named),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\b(?:href|src|action)\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^\\s"''<>]+)', 1)) AS link FROM ruled WHERE host <> ''),
linked AS (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS dst FROM found),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM linked WHERE dst <> '' AND src <> dst GROUP BY 1, 2),
seeded AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM ruled WHERE host <> '' GROUP BY 1),
hosts AS MATERIALIZED (SELECT * FROM seeded UNION ALL SELECT DISTINCT h, 0.0, 0.0 FROM (SELECT src AS h FROM edges UNION SELECT dst FROM edges) WHERE h NOT IN (SELECT host FROM seeded)),
outs AS (SELECT src, sum(n) AS s FROM edges GROUP BY 1),
moves AS MATERIALIZED (SELECT e.src AS tail, e.dst AS head, e.n / o.s AS gw, 0.0 AS bw FROM edges e JOIN outs o USING (src) UNION ALL SELECT e.dst, e.src, 0.0, e.n / o.s FROM edges e JOIN outs o USING (src)),
ranks AS (SELECT 0 AS step, host, CAST({1 - DAMPING} * good AS DOUBLE) AS trust, CAST({1 - DAMPING} * bad AS DOUBLE) AS distrust FROM hosts
  UNION ALL
  SELECT s.step + 1, h.host, {1 - DAMPING} * h.good + {DAMPING} * coalesce(c.t, 0), {1 - DAMPING} * h.bad + {DAMPING} * coalesce(c.b, 0)
  FROM hosts h CROSS JOIN (SELECT DISTINCT step FROM ranks WHERE step < 120) s LEFT JOIN (SELECT head, sum(trust * gw) AS t, sum(distrust * bw) AS b FROM moves JOIN ranks ON tail = host GROUP BY 1) c ON h.host = c.head)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN k.distrust - k.trust >= {THRESHOLD * (1 - DAMPING)} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(k.trust, 0) AS DOUBLE) AS trust, CAST(coalesce(k.distrust, 0) AS DOUBLE) AS distrust FROM ruled r LEFT JOIN (SELECT * FROM ranks WHERE step = 120) k ON r.host = k.host"""


ORACLE_SQL = _oracle()
