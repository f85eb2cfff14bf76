"""From shared keys to classes: connected components and verified links without all-pairs groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_BYTES, materialize, small


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the edges (a, b): comp is the least node of the component.

    Every round takes the least label of a node and its neighbours, then follows labels one
    step (pointer jumping), so long chains shorten by half. A round's table is written
    to the shared folder; the driver sees one count."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "cc")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        new = materialize(step.join(jump, "low").select("node", F.least("low", "far").alias("comp"), (F.least("low", "far") < F.col("comp")).alias("moved")), "cc")
        labels = new.select("node", "comp")
        if not new.where("moved").limit(1).count():
            return labels


def link_members(members: DataFrame, may_link: Callable[[str, str], object], verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame, DataFrame], DataFrame], meet: Callable[[DataFrame], DataFrame] | None = None, *, write: bool = True) -> DataFrame:
    """Verified links (a, b) among the nodes that share a key.

    members has (key, node, n). A key's leader is its least node. First each node is compared with
    one leader, the least of its keys', then with those leaders that are not yet in its component. Keys whose nodes are then all in one component are settled: no further link
    can change a class. rest(nodes of the other keys with comp, links) gives the remaining
    candidate pairs (a, b), which are verified too. may_link(n, n) is an
    expression that no linked pair fails; n is what it looks at. With meet, one shared key isn't enough: meet(meetings (a, b, n_a, n_b)) gives
    those pairs (a, b) whose meetings are; a pair that fails with its leader's keys alone is seen again by rest, with all of its keys,
    as keys of nodes in different components are never settled. rest then gets all pairs that were judged in place of links, so none is verified twice. Without write, members is read twice from where it comes from,
only those that share a key are written, and rest gets the unsettled ones with their keys."""
    if write:
        members = materialize(members, "members")
    else:  # only what shares a key is written, and only keys are shuffled to find it
        shared = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "shared-keys")
        members = materialize(members.join(small(shared, 2 * BROADCAST_BYTES), "key", "left_semi"), "shared-members")
    leaders = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last")).where("lead.node <> last")
    leaders = materialize(leaders.select("key", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), "leaders")
    near = members.join(small(leaders), "key").where("node <> lead").where(may_link("n", "lead_n"))
    ends = F.col("lead").alias("a"), F.col("node").alias("b")
    star = materialize(near.select(*ends).distinct() if meet is None else meet(near.select(*ends, F.col("lead_n").alias("n_a"), F.col("n").alias("n_b"))), "star")
    pairs = materialize(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = materialize(verify(pairs), "links")
    judged = links if meet is None else pairs
    labels = connected_components(links)
    a_of, b_of = (small(labels).select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    apart = star.join(a_of, "a", "left").join(b_of, "b", "left").where("coalesce(comp_a, a) <> coalesce(comp_b, b)").select("a", "b").join(small(judged), ["a", "b"], "left_anti")
    apart = materialize(apart, "pairs")
    links = links.union(materialize(verify(apart), "links"))
    labels = connected_components(links)
    own = F.coalesce("comp", "node")
    open_keys = members.join(small(leaders).select("key"), "key").join(small(labels), "node", "left").groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("key")
    names = ["node", "n"] if write else ["key", "node", "n"]
    left = members.join(small(materialize(open_keys, "open")), "key").select(*names).distinct().join(small(labels), "node", "left").select(*names, own.alias("comp"))
    left = materialize(left, "unsettled")
    if not left.limit(1).count():
        return links
    more = rest(left, links if meet is None else pairs.union(apart))
    return links.union(materialize(verify(materialize(more, "more-pairs")), "more-links"))
