"""URL verdicts by rules and, where none fits, by propagation over the host graph; DataFrame functions only.

Trust is personalised PageRank over host links from the hosts whose pages a rule allows; distrust is the
same over reversed links from the hosts whose pages a rule blocks, so it reaches those who link to them. A
seed's weight is the share of its pages that the rule decides, damping is ``damping``, and scores are divided
by 1 - damping: a host without links scores its own share (here seeds enter undivided, which is the same). A host is blocked if its distrust is more than
``threshold`` above its trust.

Links are counted once per pair of hosts, with partial sums before the shuffle, so a host with a third of
all pages costs no more than others; such hosts are broadcast when pages are joined with their scores. Propagation
runs until it brings no host more than ``tolerance``; each round is a written table.

Edge cases: null urls and urls without ``://`` have an empty host and path, no rule fits and the verdict is
that of the empty host, which is never scored: allow. Null html has no links. Links to the own host do not
count. Repeated rows are judged alike. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifline.llm.components import join_unique
from motifline.llm.text import col
from motifline.session import discard, materialize

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MAX_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, block before allow; null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-9) -> tuple[DataFrame, int]:
    """(kind, host, score) of score = seed + damping * what linking hosts of the kind pass on, and the rounds it took.

    seeds: (kind, host, score), links: (kind, a, b), all kinds at once. A round passes on what the round before has
    brought; the rounds end when it brings no host more than ``tolerance``. What is under way shrinks by the damping
    in each, so they end.
    """
    out = links.groupBy("kind", "a").agg((damping / F.count("*")).alias("pass"))
    links = materialize(links.join(out, ["kind", "a"]).withColumnRenamed("a", "host"), "links")
    flow, flows = seeds, [seeds]
    while True:
        flow = flow.join(links, ["kind", "host"]).select("kind", F.col("b").alias("host"), (F.col("score") * F.col("pass")).alias("score"))
        flow = materialize(flow.groupBy("kind", "host").agg(F.sum("score").alias("score")), "flow")
        flows.append(flow)
        if (flow.agg(F.max("score")).first()[0] or 0) <= tolerance:
            break
    total = flows[0]
    for f in flows[1:]:
        total = total.unionByName(f)
    scores = materialize(total.groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
    for f in [links, *flows[1:]]:
        discard(f)
    return scores, len(flows) - 1


def judge_pages(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    damping: float = 0.85,
    tolerance: float = 1e-9,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, trust and distrust (of the host; null if never reached), rounds.

    At the threshold itself a host is allowed; of two rules that fit and are equally long the blocking one wins.
    """
    src = pages.select(col(id_col).alias("id"), F.coalesce(col(url_col), F.lit("")).alias("url"), col(html_col).alias("html"))
    src = src.withColumn("rest", F.expr(r"case when instr(url, '://') > 0 then regexp_extract(substring(url, instr(url, '://') + 3), '(?s)^([^?#]*)', 1) else '' end"))
    src = src.withColumn("host", F.translate(F.substring_index("rest", "/", 1), UPPER, LOWER))
    src = src.withColumn("path", F.expr("case when instr(rest, '/') > 0 then substring(rest, instr(rest, '/')) else '' end"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    judged = src.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "html")
    links = judged.where("host <> ''").select(F.col("host").alias("a"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("b"))
    links = materialize(links.select("a", F.translate("b", UPPER, LOWER).alias("b")).where("a <> b").distinct(), "host-links")
    share = lambda kind: F.avg(F.coalesce((F.col("ruled") == kind).cast("double"), F.lit(0.0)))
    hosts = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block"))
    hosts = materialize(hosts, "hosts")
    kinds = (("trust", "allow", links.select("a", "b")), ("distrust", "block", links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    seeds = [hosts.where(F.col(rule) > 0).select(F.lit(kind).alias("kind"), "host", F.col(rule).alias("score")) for kind, rule, _ in kinds]
    ways = [way.withColumn("kind", F.lit(kind)) for kind, _, way in kinds]
    scores, most = seeds[0].unionByName(seeds[1]), 0
    if links.limit(1).count():
        scores, most = propagate(scores, ways[0].unionByName(ways[1]), damping, tolerance)
    both = scores.groupBy("host").agg(*[F.max(F.when(F.col("kind") == kind, F.col("score"))).alias(kind) for kind, *_ in kinds])
    wrong = F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > threshold
    return join_unique(judged.drop("html"), both, "host", "left").select(
        "id", "host", "path", "rule", F.coalesce("ruled", F.when(wrong, "block").otherwise("allow")).alias("verdict"), "trust", "distrust", F.lit(most).alias("rounds")
    )
