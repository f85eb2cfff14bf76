"""URL filters: allow and block rules, and link-graph propagation for hosts that no rule settles.

Hosts are the nodes. Edges are links between hosts, weighted by their number, and a link from each
host to its parent domain. Two personalised PageRanks run over them: trust starts at hosts with allowed pages and
follows edges; distrust starts at hosts with blocked pages and follows edges backwards. A host's seed is
the share of its pages that rules allow or block. Ranks are given in units of what a wholly allowed or blocked host gets by its own
seed. A host is blocked if its distrust is FLOOR or more and above RATIO times its trust; so a small share of blocked pages
alone blocks no host, and where both are equal it is allowed. After ROUNDS rounds at most DAMPING ** ROUNDS (2 %) of the rank is not yet settled.

All on DataFrame functions. Null or bad URLs have empty host and path; they get no rule, and allow. Null html
has no links. Repeated rows are judged each. Rules longer in characters win; of equal ones, block.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, scope, small

DAMPING, ROUNDS, RATIO, FLOOR, MAX_RULES = 0.85, 24, 1.0, 0.25, 10_000
_LINK = r"(?i)href\s*+=\s*+[\"']?((?:[a-z][a-z0-9+.-]*+:)?//[^\"'\s>]++)"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    raw = F.regexp_extract(rest, "^[^/?#]*+", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)).otherwise("")


def match_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages(page_id, url, ...) with host, path, rule and ruling (allow, block or null). rules: (allow or block, host and path)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rows = pages.drop("host", "path", "rule", "ruling")
    url = F.coalesce("url", F.lit(""))
    rows = rows.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    fits = F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):  # the longest is tested first
        host, slash, path = rule.partition("/")
        own = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        fits, kind = F.when(own, F.lit(rule)).otherwise(fits), F.when(own, F.lit(verdict)).otherwise(kind)
    return rows.withColumn("rule", fits).withColumn("ruling", kind)


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, and each known host's parents."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("link"))
    links = links.select("src", host_of(F.regexp_replace("link", "^//", "http://")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    labels = F.split("host", r"\.")
    parents = hosts.where("host <> ''").select(labels.alias("l")).where(F.size("l") > 2)
    # every suffix of a host, one label apart
    chain = parents.select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("i"))
    chain = chain.select(F.array_join(F.slice("l", F.col("i"), F.size("l")), ".").alias("src"), F.array_join(F.slice("l", F.col("i") + 1, F.size("l")), ".").alias("dst")).distinct()
    counted = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return counted.union(chain.select("src", "dst", F.lit(1.0).alias("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds(host, allowed, blocked), shares from 0 to 1."""
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    flow = edges.select(F.lit(0).alias("k"), "src", "dst", "weight").union(edges.select(F.lit(1).alias("k"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = flow.groupBy("k", "src").agg(F.sum("weight").alias("out"))
    flow = materialize(flow.join(out, ["k", "src"]).select("k", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), "flow")
    start = seeds.select(F.lit(0).alias("k"), "host", (F.col("allowed") / F.lit(float(total.a or 1))).alias("seed")).union(seeds.select(F.lit(1).alias("k"), "host", (F.col("blocked") / F.lit(float(total.b or 1))).alias("seed")))
    start = materialize(start.where("seed > 0"), "seeds")
    rank = start.withColumnRenamed("seed", "rank")
    for i in range(rounds):
        sent = rank.withColumnRenamed("host", "src").join(flow, ["k", "src"]).select("k", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = sent.union(start.select("k", "host", F.col("seed") * (1 - damping))).groupBy("k", "host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 3 or i == rounds - 1:
            rank = materialize(rank, "rank")
    return rank.groupBy("host").agg(F.sum(F.when(F.col("k") == 0, F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("k") == 1, F.col("rank")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, ratio: float = RATIO, floor: float = FLOOR) -> DataFrame:
    """pages(page_id, url, html, ...) without html, with host, path, rule, verdict, trust and distrust."""
    ruled = match_rules(pages, rules)
    share = lambda kind: F.avg(F.when(F.col("ruling") == kind, 1.0).otherwise(0.0))
    hosts = materialize(ruled.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    seeds = hosts.where("host <> ''")
    total = seeds.agg(F.coalesce(F.sum("allowed"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("b")).first()
    with scope(pages.sparkSession):
        ranks = propagate(materialize(host_edges(ruled, hosts), "host-edges"), seeds)
        ranks = materialize(ranks.select("host", (F.col("trust") * (total.a / (1 - DAMPING))).alias("trust"), (F.col("distrust") * (total.b / (1 - DAMPING))).alias("distrust")), "ranks", keep=True)
    kept = ruled.drop("html", "trust", "distrust", "verdict").join(small(ranks).withColumnRenamed("host", "__host"), F.col("host") == F.col("__host"), "left").drop("__host")
    kept = kept.withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    own = F.when((F.col("distrust") >= floor) & (F.col("distrust") > ratio * F.col("trust")), F.lit("block")).otherwise(F.lit("allow"))
    return kept.withColumn("verdict", F.coalesce("ruling", own)).drop("ruling")
