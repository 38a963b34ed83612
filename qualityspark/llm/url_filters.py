"""URL filters: rules first, link-graph trust for what no rule decides.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a
rule blocks are blocked seeds, each weighted by its pages. Trust flows along
host links as personalised PageRank; distrust flows against them, to hosts that
link to blocked ones. A host whose distrust exceeds its trust is blocked.

Scores are whole numbers of a fixed total, so that no order of additions
changes a verdict. Every division rounds up, so a positive flow stays positive
however often it is divided, and scores only grow from step to step. Steps go
on until none reaches a new host, none changes a verdict, and what the last one
added is at most ``BOUND`` of the total; what is still missing then is at most
``FLOW / (100 - FLOW)`` times that, but for the rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.llm.common import cut_lineage

#: (action, host, path), tried longest first.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Total of the seeds' scores of a kind, per cent that flows on, what a last step may add.
TOTAL, FLOW, BOUND = 10**16, 85, 10**12

_REST = r"^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "(?s)" + _REST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)" + _REST, 2), F.lit(""))


def decide(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, action), or null. ``rules`` is a short list given by the caller."""
    fits = lambda h, p: ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
    tried = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    cases = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))) for action, h, p in tried]
    return F.coalesce(*cases, F.lit(None).cast("struct<rule:string,action:string>"))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct ``source, target`` of links in ``html`` to another host; relative links stay on their host."""
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), 1)))
    links = pages.select(F.col("host").alias("source"), target.alias("target")).withColumn("target", lower_ascii(F.col("target")))
    return links.filter("source <> '' AND source <> target").distinct()


def _settled(now: DataFrame, bound: int) -> bool:
    """Whether the last step reached no new host, changed no verdict and added at most ``bound``."""
    lead = lambda c: F.sum(F.when(F.col("kind") == "block", F.col(c)).otherwise(-F.col(c))) > 0
    fresh = F.max(F.col("before") == 0).alias("fresh")
    hosts = now.groupBy("host").agg((lead("score") != lead("before")).alias("turned"), F.sum(F.col("score") - F.col("before")).alias("added"), fresh)
    going, added = hosts.agg(F.max(F.col("turned") | F.col("fresh")), F.sum("added")).first()
    return not going and (added or 0) <= bound


def propagate(links: DataFrame, seeds: DataFrame, total: int = TOTAL, flow: int = FLOW, bound: int = BOUND) -> DataFrame:
    """Trust and distrust per host.

    ``links``: distinct source, target. ``seeds``: kind (``allow`` or ``block``),
    host, pages. Returns ``kind, host, score`` for hosts that were reached.
    """
    both = links.select(F.lit("allow").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to")).unionByName(
        links.select(F.lit("block").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"))
    )
    # Cuts: every step reads these again, and a plain scan on both sides of a join lets a hub's rows be split.
    degrees = cut_lineage(both.groupBy("kind", "host").agg(F.count("*").alias("degree")))
    edges = cut_lineage(both.join(degrees, ["kind", "host"]))
    weight = seeds.groupBy("kind").agg(F.sum("pages").alias("all"))
    start = seeds.join(weight, "kind").selectExpr("kind", "host", f"CAST({total} AS DECIMAL(38,0)) * pages DIV `all` AS seed")
    start = start.selectExpr("kind", "host", "CAST(seed AS BIGINT) AS seed", "0L AS before")
    now = cut_lineage(start.selectExpr("*", f"({100 - flow} * seed + 99) DIV 100 AS score"))
    while not _settled(now, bound):
        own = now.selectExpr("kind", "host", "seed", "score AS before", "0L AS inflow")
        flown = now.join(edges, ["kind", "host"]).selectExpr("kind", "`to` AS host", "0L AS seed", "0L AS before", "(score + degree - 1) DIV degree AS inflow")
        gained = own.unionByName(flown).groupBy("kind", "host").agg(*(F.sum(c).alias(c) for c in ("seed", "before", "inflow")))
        now = cut_lineage(gained.selectExpr("kind", "host", "seed", "before", f"({100 - flow} * seed + {flow} * inflow + 99) DIV 100 AS score"))
    return now.select("kind", "host", "score")


def judge(pages: DataFrame, rules=RULES, bound: int = BOUND) -> DataFrame:
    """Judge every page's url.

    Takes ``page_id, url, html``; returns ``page_id, host, path, rule, verdict,
    trust, distrust``. Null urls and urls without ``://`` have an empty host and
    path, fit no rule and are allowed, as is a host that neither score reaches;
    equal scores allow too. Null html has no links. Repeated pages are judged
    one by one; no rows give no rows. Only the three columns are read.
    """
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = read.withColumn("ruled", decide(F.col("host"), F.col("path"), rules))
    seeds = ruled.filter("ruled IS NOT NULL AND host <> ''").groupBy(F.col("ruled.action").alias("kind"), "host").agg(F.count("*").alias("pages"))
    scores = propagate(host_links(read), seeds, bound=bound)
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0))
    hosts = scores.groupBy("host").agg(score("allow").alias("trust"), score("block").alias("distrust"))
    # One row per host, cut, against all pages: the pages of a common host can be split.
    judged = ruled.drop("html").join(cut_lineage(hosts), "host", "left")
    distrusted = F.coalesce(F.col("distrust") > F.col("trust"), F.lit(False))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.action"), F.when(distrusted, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).cast("long").alias("trust"),
        F.coalesce("distrust", F.lit(0)).cast("long").alias("distrust"),
    )


def _sql() -> str:
    """The same steps as one statement: rules, links, seeds, then the flow, step by step."""
    tried = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(a, h, p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for a, h, p in tried]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{h}{p}'" for _, h, p, c in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for a, _, _, c in fits) + " END"
    link = LINK.replace("'", "''")
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    parts = [
        f"""read AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s){_REST}', 1), ''), {az}) AS host,
             coalesce(regexp_extract(url, '(?s){_REST}', 2), '') AS path FROM pages)""",
        f"ruled AS (SELECT page_id, host, path, {rule} AS rule, {action} AS action FROM read)",
        f"""links AS (SELECT DISTINCT source, target FROM (SELECT host AS source,
             translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), {az}) AS target FROM read) WHERE source <> '' AND source <> target)""",
        "both_ways AS (SELECT 'allow' AS kind, source AS host, target AS dest FROM links UNION ALL SELECT 'block', target, source FROM links)",
        "edges AS (SELECT kind, host, dest, count(*) OVER (PARTITION BY kind, host) AS degree FROM both_ways)",
        "seeds AS (SELECT action AS kind, host, count(*) AS pages FROM ruled WHERE action IS NOT NULL AND host <> '' GROUP BY ALL)",
        f"start AS (SELECT kind, host, CAST(({TOTAL}::HUGEINT * pages) // sum(pages) OVER (PARTITION BY kind) AS BIGINT) AS seed FROM seeds)",
        f"""flow AS (
          SELECT 1 AS step, kind, host, seed, ({100 - FLOW} * seed + 99) // 100 AS score, true AS go FROM start
          UNION ALL
          SELECT step, kind, host, seed, score, bool_or(before = 0 OR (lead > 0) <> (led > 0)) OVER () OR sum(score - before) OVER () > {BOUND} FROM (
            SELECT *, sum(CASE WHEN kind = 'block' THEN score ELSE -score END) OVER (PARTITION BY host) AS lead,
              sum(CASE WHEN kind = 'block' THEN before ELSE -before END) OVER (PARTITION BY host) AS led FROM (
              SELECT max(step) AS step, kind, host, sum(seed) AS seed, sum(before) AS before,
                ({100 - FLOW} * sum(seed) + {FLOW} * sum(inflow) + 99) // 100 AS score FROM (
                SELECT step + 1 AS step, kind, host, seed, score AS before, 0 AS inflow FROM flow WHERE go
                UNION ALL
                SELECT step + 1, e.kind, e.dest, 0, 0, (f.score + e.degree - 1) // e.degree FROM flow f JOIN edges e ON e.kind = f.kind AND e.host = f.host WHERE f.go)
              GROUP BY kind, host)))""",
        f"""hosts AS (SELECT host, CAST(coalesce(sum(score) FILTER (WHERE kind = 'allow'), 0) AS BIGINT) AS trust,
             CAST(coalesce(sum(score) FILTER (WHERE kind = 'block'), 0) AS BIGINT) AS distrust FROM flow WHERE step = (SELECT max(step) FROM flow) GROUP BY host)""",
    ]
    return (
        "WITH RECURSIVE "
        + ",\n".join(parts)
        + """
SELECT page_id, r.host, path, rule, coalesce(action, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM ruled r LEFT JOIN hosts h ON h.host = r.host"""
    )


OP10_SQL = _sql()
