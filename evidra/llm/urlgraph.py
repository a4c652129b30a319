"""URL filters: rules on host suffixes and paths, and for the rest trust spread over the link graph of hosts.

Personalised PageRank starts from trusted seeds (hosts, weighted by how many of their pages an allow rule names) along
links, and from blocked seeds against the links. A host whose distrust exceeds its trust is blocked. All steps are
DataFrame expressions and joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: (verdict, host, path): fixed values of the registered query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MAX_RULES = 500
DAMPING, ROUNDS = 0.85, 10  # so many rounds are what the SQL unrolls
#: Mass is spread until a round moves less than this share of it; at 0.85 that takes 90 rounds or fewer.
TOLERANCE, MOST_ROUNDS = 1e-6, 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (host and path together) that fits, null if none; of equally long ones, a block
    rule goes first, then the lesser text. Rules are literals of the plan, MAX_RULES at most."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} is the most that a plan should hold")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(host, mass): seeds' mass, of which each round sends ``damping`` along edges (a, b, share); what a host without edges
    would send goes back to the seeds. Total mass is that of the seeds. Rounds end when the summed change of mass is below
    ``tolerance`` of the total."""
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    senders = edges.select(F.col("a").alias("host")).distinct().withColumn("sends", F.lit(True))
    mass = seeds.select("host", F.col("seed").alias("mass"))
    if not total or not edges.head(1):
        return mass
    after = mass.withColumn("was", F.lit(0.0))
    for _ in range(most_rounds):
        changed, idle = after.join(senders, "host", "left").agg(F.sum(F.abs(F.col("mass") - F.col("was"))), F.sum(F.when(F.col("sends").isNull(), F.col("mass")))).first()
        mass = after.select("host", "mass")
        if changed < tolerance * total:
            return mass
        sent = mass.join(edges, mass["host"] == edges["a"]).select(F.col("b").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"), F.lit(0.0).alias("was"))
        back = seeds.select("host", (F.col("seed") * F.lit((1 - damping) + damping * (idle or 0.0) / total)).alias("mass"), F.lit(0.0))
        before = mass.select("host", F.lit(0.0), "mass")
        after = stored(sent.union(back).union(before).groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("was").alias("was")), "mass")
    raise RuntimeError(f"mass did not settle in {most_rounds} rounds")


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url, html).

    A url without ``://`` or null has empty host and path; the empty host is a host like others. A null html has no links.
    Relative links stay within their host and give no edge, and neither do links of a host to itself; links repeated
    between two hosts weigh as often. Hosts that no seed reaches are allowed. An empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    seeds = stored(
        read.groupBy("host").agg(F.sum((F.col("fit.verdict") == "allow").cast("double")).alias("allowed"), F.sum((F.col("fit.verdict") == "block").cast("double")).alias("blocked")).na.fill(0.0), "seeds"
    )
    links = pages.select(host.alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("b")).select("a", F.translate("b", _UPPER, _LOWER).alias("b")).where("a <> b")
    links = stored(links.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n")), "hosts")
    onward = links.join(links.groupBy("a").agg(F.sum("n").alias("all")), "a").select("a", "b", (F.col("n") / F.col("all")).alias("share"))
    back = links.join(links.groupBy("b").agg(F.sum("n").alias("all")), "b").select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") / F.col("all")).alias("share"))
    trust = _spread(onward, seeds.where("allowed > 0").select("host", F.col("allowed").alias("seed")), damping)
    distrust = _spread(back, seeds.where("blocked > 0").select("host", F.col("blocked").alias("seed")), damping)
    masses = reduce(DataFrame.union, [trust.select("host", F.col("mass").alias("trust"), F.lit(0.0).alias("distrust")), distrust.select("host", F.lit(0.0), "mass")])
    judged = masses.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).where(F.col("distrust") > F.col("trust") * (1 + 1e-9) + 1e-9)
    judged = stored(judged.select("host", F.lit("block").alias("by_graph")), "distrusted")
    out = read.join(judged, "host", "left")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.col("by_graph"), F.lit("allow")).alias("verdict"))


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    steps = []
    for name, seed, a, b in (("t", "allowed", "a", "b"), ("d", "blocked", "b", "a")):
        steps.append(f"{name}e AS (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS share FROM links)")
        steps.append(f"{name}0 AS (SELECT host, {seed}::DOUBLE AS mass FROM seeds WHERE {seed} > 0)")
        for k in range(ROUNDS):
            steps.append(
                f"{name}{k + 1} AS (SELECT host, sum(mass) AS mass FROM (SELECT e.b AS host, m.mass * e.share * {DAMPING} AS mass FROM {name}{k} m JOIN {name}e e ON m.host = e.a "
                f"UNION ALL SELECT host, mass * ({1 - DAMPING} + {DAMPING} * (SELECT coalesce(sum(mass), 0) FROM {name}{k} WHERE host NOT IN (SELECT a FROM {name}e)) / (SELECT sum(mass) FROM {name}0)) FROM {name}0) GROUP BY host)"
            )
    last = ROUNDS
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT page_id, host, path, (SELECT {{'rule': rhost || rpath, 'verdict': verdict}} FROM rules WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) ORDER BY length(rhost || rpath) DESC, verdict DESC LIMIT 1) AS r FROM u),
seeds AS (SELECT host, count(*) FILTER (r.verdict = 'allow') AS allowed, count(*) FILTER (r.verdict = 'block') AS blocked FROM fit GROUP BY host),
links AS (SELECT a, b, count(*)::DOUBLE AS n FROM (SELECT host AS a, lower(unnest(regexp_extract_all(html, '(?i)\\b(?:href|src)\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1))) AS b FROM u) WHERE a <> b GROUP BY a, b),
{', '.join(steps)},
judged AS (SELECT coalesce(t.host, d.host) AS host FROM t{last} t FULL JOIN d{last} d ON t.host = d.host WHERE coalesce(d.mass, 0) > coalesce(t.mass, 0) * (1 + 1e-9) + 1e-9)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN host IN (SELECT host FROM judged) THEN 'block' ELSE 'allow' END) AS verdict FROM fit
"""


SQL = _sql()
