"""URL filters: host and path rules, and verdicts for the rest from a host link graph.

Trust flows along links from hosts with allowed pages (personalised PageRank);
distrust flows against links from hosts with blocked pages, as linking to a
blocked host is what is suspicious. A host is blocked when its distrust exceeds
a multiple of its trust.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Query, lower_ascii, stage, table, whole

DAMPING = 0.85
#: Rounds after which the scores are stored and compared with those stored last.
STORE_EVERY = 5
#: Steps end when the scores of each kind, which sum up to 1 at most, changed by less than this together since they were stored last.
TOLERANCE = 1e-9
#: Distrust at which a host is blocked, as a multiple of its trust.
BLOCK_RATIO = 1.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
]

LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after(whole(url)), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(whole(url)), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null.

    Length is that of host and path together; of equally long rules the
    blocking one wins. The rules are a short list that is part of the plan.
    """
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "block", r.host, r.path))
    found = None
    for rule in order:
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links (src, dst, links) between hosts, counted; links inside a host are one self edge.

    Addresses without a host are links inside the page's host. Pairs are counted
    on the map side, so a host with a third of all pages stays spread out.
    """
    links = F.regexp_extract_all(whole(F.col(html_col)), F.lit(LINK), 1)
    absolute = F.transform(links, lambda u: lower_ascii(F.regexp_extract(u, r"(?i)^(?:https?:)?//([^/?#]*)", 1)))
    targets = F.array_distinct(F.concat(absolute, F.array("src")))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.col(html_col)).select("src", F.explode(targets).alias("dst"))
    return rows.where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Scores (host, trust, distrust) by steps over both graphs at once, until they change no more.

    That is, until no further host was reached and the sum of all changes since
    the scores were stored last is below ``tolerance``.

    ``seeds``: host, trust and distrust weights (each normalised to sum 1 here).
    Every step is a join on the source and a map-side combined sum; hot hosts
    are split by AQE. The scores are stored every few steps, which cuts the lineage.
    """
    both = edges.select("src", "dst", "links", F.lit("trust").alias("kind")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links", F.lit("distrust").alias("kind")))
    out = both.groupBy("kind", "src").agg(F.sum("links").alias("all"))
    shares = stage(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("all")).alias("share")), "shares")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust")))
                         .alias("kind", "weight")).where("weight > 0")
    total = start.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = stage(start.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("seed")), "seeds")
    scores = start.withColumnRenamed("seed", "score")
    jump = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
    moving = True
    while moving:
        before = scores
        for _ in range(STORE_EVERY):
            moved = scores.withColumnRenamed("host", "src").join(shares, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
            scores = moved.unionByName(jump).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        scores = stage(scores, "scores")
        both = scores.select("kind", "host", "score", F.lit(1).alias("n")).unionByName(
            before.select("kind", "host", (-F.col("score")).alias("score"), F.lit(-1).alias("n")))
        change = both.groupBy("kind", "host").agg(F.sum("score").alias("by"), F.sum("n").alias("n")).agg(
            F.sum(F.abs("by")).alias("by"), F.sum(F.abs("n")).alias("n")).first()
        moving = (change["n"] or 0) > 0 or (change["by"] or 0.0) >= tolerance
    return scores.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", ratio: float = BLOCK_RATIO) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    The longest fitting rule decides. Else the host is blocked if its distrust
    exceeds ``ratio`` times its trust, and allowed otherwise; a host that no
    seed reaches, and a page without a host (null or malformed url), is allowed.
    A null html has no links. Repeated rows give repeated results, an empty
    table an empty one. Other columns are ignored, whatever their names.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).select(
        "*", longest_rule(F.col("host"), F.col("path"), rules).alias("_found"))
    rows = stage(rows.select("_id", "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("_by_rule")), "urls")
    seeds = rows.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("_by_rule") == "allow").cast("double").alias("trust"),
        F.count_if(F.col("_by_rule") == "block").cast("double").alias("distrust"))
    scores = propagate(stage(host_edges(pages, url_col, html_col), "edges"), seeds)
    blocked = stage(scores.where(F.col("distrust") > ratio * F.col("trust")).select("host", F.lit(True).alias("_blocked")), "blocked")
    verdict = F.coalesce("_by_rule", F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return rows.join(blocked, "host", "left").select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def _run(spark, folder):
    return judge(table(spark, folder, "pages"))


def _sql() -> str:
    """The same in SQL: rules as a table, the two walks as steps that go on until no host is new and the scores rest."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(v, rh, rp) AS (VALUES {rules}),
f AS (
  SELECT page_id, html, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS by_rule
  FROM u LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
links AS (
  SELECT host AS src, unnest(list_distinct(list_append(list_transform(
    regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1),
    lambda x: lower(regexp_extract(x, '(?i)^(?:https?:)?//([^/?#]*)', 1))), host))) AS dst FROM f),
edges AS (SELECT src, dst, count(*) AS links FROM links WHERE src <> '' AND dst <> '' GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS kind, src, dst, links FROM edges UNION ALL SELECT 'distrust', dst, src, links FROM edges),
shares AS (SELECT kind, src, dst, links / sum(links) OVER (PARTITION BY kind, src) AS share FROM both_ways),
weights AS (
  SELECT CASE by_rule WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n
  FROM f WHERE by_rule IS NOT NULL AND host <> '' GROUP BY ALL),
s0 AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS score FROM weights),
walk(step, kind, host, score, before) AS (
  SELECT 0, kind, host, score, 0.0::DOUBLE FROM s0
  UNION ALL SELECT step + 1, kind, host, sum(score), sum(before) FROM (
    SELECT w.step, w.kind, dst AS host, {DAMPING} * score * share AS score, 0.0 AS before FROM walk AS w JOIN shares ON w.kind = shares.kind AND host = src
    UNION ALL SELECT step, s0.kind, s0.host, {1 - DAMPING} * s0.score, 0.0 FROM s0, (SELECT max(step) AS step FROM walk)
    UNION ALL SELECT step, kind, host, 0.0, score FROM walk)
  WHERE (SELECT sum(abs(score - before)) >= {TOLERANCE} / {STORE_EVERY} OR min(before) = 0 FROM walk) GROUP BY step, kind, host),
blocked AS (
  SELECT host FROM walk WHERE step = (SELECT max(step) FROM walk) GROUP BY host
  HAVING coalesce(sum(score) FILTER (kind = 'distrust'), 0) > {BLOCK_RATIO} * coalesce(sum(score) FILTER (kind = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM f"""


QUERIES = {"op5_url_filters": Query(_run, _sql())}
