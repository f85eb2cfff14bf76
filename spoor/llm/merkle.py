"""Merkle manifest of a corpus: leaf coordinates by rank in bitmaps, levels reduced in keyed slot arrays.

A row's leaf is the hash of its encoded columns. Within a group (a source) leaves ascend by id. An id's coordinate is
its rank in the group's bitmap of ids: 64-bit words of which only those with a bit are kept (the compressed bitmap), each with the
number of rows before it (the directory); the directory is summed over four levels of at most 65,536 entries, so no group is
ever sorted as a whole. Blocks of 243 neighbouring leaves are then gathered by (group, block) into slot arrays, which
reduce five levels of arity three at once, and again until a group is one node. Groups' nodes, in the order of
their names, form the last tree in the same way. Proofs go back down: a block gets the siblings above it once, not each of its rows.

Null ids come first. Rows that share an id (or have none) are ordered by their leaf, by a histogram over its first 16 bits, so that no
number of such rows meets in one task; rows that are equal throughout take neighbouring coordinates. A null group is a group of its own, the first. An empty
table gives no rows. Other columns are not read; a column that is to be hashed must be a string or an integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, scope, small

ARITY, DEPTH = 3, 5
BLOCK = ARITY**DEPTH
#: Stands for the word of a null id, below all others.
_NO_WORD = -(1 << 60)
_STEP = "struct<left:string,right:string>"


def encoded(value: Column) -> Column:
    """'-' for null, else the UTF-8 bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def directory(leaves: DataFrame) -> DataFrame:
    """(grp, word, bits, n, before, total) of leaves(grp, word, bit): a group's non-empty 64-bit words, their rows, the rows in words before, and the group's rows."""
    words = materialize(leaves.groupBy("grp", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count(F.lit(1)).alias("n")), "words")
    before = lambda of, order: F.coalesce(F.sum("n").over(Window.partitionBy("grp", of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = words.withColumn("c1", F.shiftright("word", 10)).withColumn("b0", before("c1", "word"))
    upper = [materialize(words.groupBy("grp", F.shiftright("word", 10).alias("c1")).agg(F.sum("n").alias("n")), "containers")]
    for i in (2, 3):
        upper.append(materialize(upper[-1].groupBy("grp", F.shiftright(f"c{i - 1}", 16).alias(f"c{i}")).agg(F.sum("n").alias("n")), "containers"))
    total = upper[-1].groupBy("grp").agg(F.sum("n").alias("total"))
    top = upper[2].withColumn("b3", F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("c3").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(small(materialize(total, "totals")), "grp").drop("n")
    for i in (2, 1):
        own = upper[i - 1].withColumn(f"c{i + 1}", F.shiftright(f"c{i}", 16)).withColumn(f"b{i}", before(f"c{i + 1}", f"c{i}")).drop("n")
        top = materialize(own.join(small(materialize(top, "directory")), ["grp", f"c{i + 1}"]).select("grp", f"c{i}", (F.col(f"b{i}") + F.col(f"b{i + 1}")).alias(f"b{i}"), "total"), "directory")
    return materialize(level.join(small(top), ["grp", "c1"]).select("grp", "word", "bits", "n", (F.col("b0") + F.col("b1")).alias("before"), "total"), "directory")


def positions(leaves: DataFrame, index: DataFrame) -> DataFrame:
    """leaves(grp, word, bit, id, leaf, seen) with pos, the coordinate within the group, and total."""
    tied = F.col("n") > F.bit_count("bits")
    out = ["grp", "pos", "total", "id", "leaf", "seen"]
    rank = F.col("before") + F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    plain = leaves.join(small(index.where(~tied)), ["grp", "word"]).withColumn("pos", rank).select(*out)
    shared = index.where(tied).select("grp", "word", "before", "total")
    if not shared.limit(1).count():
        return plain
    key = ["grp", "word", "bit", "prefix"]
    each = leaves.join(small(shared), ["grp", "word"]).groupBy("grp", "word", "bit", "id", "before", "total", F.left("leaf", F.lit(4)).alias("prefix"), "leaf", "seen").agg(F.count(F.lit(1)).alias("n"))
    each = materialize(each, "tied")
    first = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = each.groupBy(*key).agg(F.sum("n").alias("n")).withColumn("lower", first(Window.partitionBy("grp", "word").orderBy("bit", "prefix"))).drop("n")
    placed = each.withColumn("within", first(Window.partitionBy(*key).orderBy("leaf", "seen"))).join(small(materialize(bins, "bins")), key)
    at = F.explode(F.expr("sequence(before + lower + within, before + lower + within + n - 1)"))
    return plain.unionByName(placed.select("grp", at.alias("pos"), "total", "id", "leaf", "seen").select(*out))


def _blocks(nodes: DataFrame, name: str, carry: list[str]) -> DataFrame:
    """Slot arrays of nodes(grp, pos, total, leaf, ...): (grp, pos of the block, total, left for the next round, depth, entries, levels, leaf as the block's own hash)."""
    entry = F.struct(F.pmod("pos", F.lit(BLOCK)).cast("int").alias("slot"), "leaf", *carry)
    found = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("pos"), "total").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    depth = F.lit(DEPTH)
    for d in reversed(range(DEPTH)):
        depth = F.when(F.col("total") <= ARITY**d, d).otherwise(depth)
    found = found.withColumn("depth", depth)
    steps = ", ".join(map(str, range(1, DEPTH + 1)))
    levels = f"""aggregate(filter(array({steps}), i -> i <= depth), array(transform(entries, e -> e.leaf)), (acc, i) -> concat(acc, array(
      transform(sequence(0, (size(element_at(acc, -1)) - 1) div {ARITY}), j -> sha2(array_join(slice(element_at(acc, -1), {ARITY} * j + 1, {ARITY}), ''), 256)))))"""
    return materialize(found.withColumn("levels", F.expr(levels)), name)


def _root() -> Column:
    return F.expr("element_at(element_at(levels, -1), 1)")


def _path(slot: str) -> str:
    """The siblings of a slot, level by level within its block, as an array of (left, right)."""
    powers, at = ", ".join(str(ARITY**d) for d in range(DEPTH)), ", ".join(map(str, range(DEPTH)))
    index = f"({slot} div element_at(array({powers}), l + 1))"
    return f"""transform(filter(array({at}), l -> l < depth), l -> named_struct(
      'left', array_join(slice(levels[l], cast({index} - {index} % {ARITY} + 1 as int), cast({index} % {ARITY} as int)), ''),
      'right', array_join(slice(levels[l], cast({index} + 2 as int), cast({ARITY - 1} - {index} % {ARITY} as int)), '')))"""


def _rounds(nodes: DataFrame, carry: list[str]) -> list[DataFrame]:
    """The block tables of a tree, from the leaves' to those of which each group has one."""
    found = [_blocks(nodes, "slots", carry)]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        up = found[-1].select("grp", "pos", F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), _root().alias("leaf"))
        found.append(_blocks(up, "slots", []))
    return found


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves' blocks with above, the siblings over each block, and what else above(grp, path, ...) has for a group."""
    kept = [c for c in above.columns if c not in ("grp", "path")]
    down = rounds[-1].join(small(above), "grp")
    for lower in reversed(rounds[:-1]):
        child = down.select("grp", *kept, F.expr(f"inline(transform(entries, e -> named_struct('pos', pos * {BLOCK} + e.slot, 'path', concat({_path('e.slot')}, path))))"))
        down = lower.join(small(materialize(child, "above")), ["grp", "pos"])
    return down


def order_groups(groups: DataFrame) -> DataFrame:
    """groups(grp, ...), a row each, with pos, their rank by grp: each range of names counts its own, then adds those before."""
    ranged = groups.repartitionByRange(F.col("grp")).sortWithinPartitions("grp").withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("part", F.shiftright("at", 33)).withColumn("i", F.expr(f"at & {(1 << 33) - 1}")), "ordered-groups")
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # as many as there are ranges
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(small(materialize(parts, "parts")), "part").withColumn("pos", F.col("i") + F.col("before")).select(*groups.columns, "pos")


def manifest(rows: DataFrame) -> DataFrame:
    """rows(id long, grp string, leaf, seen): a leaf's hash as it was entered and as it is found now, one row each with

    id, leaf, subroot (of its group), root (of all), proof_sha256 (hash of its siblings up to the root), folded_root (seen, hashed upwards with those siblings) and
    verified (folded_root is the root)."""
    with scope(rows.sparkSession):
        named = rows.select(
            F.coalesce(F.concat(F.lit("+"), "grp"), F.lit("")).alias("grp"), "id", "leaf", "seen",
            F.coalesce(F.shiftright("id", 6), F.lit(_NO_WORD)).alias("word"), F.coalesce(F.expr("cast(id & 63 as int)"), F.lit(0)).alias("bit"),
        )
        leaves = materialize(named, "leaves")
        tree = _rounds(positions(leaves, directory(leaves)), ["id", "seen"])
        subroots = order_groups(tree[-1].select("grp", _root().alias("leaf")))
        subroots = materialize(subroots, "subroots")
        top = _rounds(subroots.select(F.lit("").alias("grp"), "pos", F.lit(subroots.count()).cast("long").alias("total"), "leaf", F.col("grp").alias("name")), ["name"])
        start = top[-1].select("grp", _root().alias("root"), F.array().cast(f"array<{_STEP}>").alias("path"))
        above = _descend(top, materialize(start, "root")).selectExpr("root", f"inline(transform(entries, e -> named_struct('grp', e.name, 'subroot', e.leaf, 'path', concat({_path('e.slot')}, path))))")
        down = _descend(tree, materialize(above, "above"))
        with_path = f"transform(entries, e -> named_struct('id', e.id, 'leaf', e.leaf, 'seen', e.seen, 'path', concat({_path('e.slot')}, path)))"
        proof = "sha2(array_join(transform(x.path, p -> concat(p.left, p.right)), ''), 256)"
        folded = "aggregate(x.path, x.seen, (h, p) -> sha2(concat(p.left, h, p.right), 256))"
        each = down.selectExpr("subroot", "root", f"inline(transform({with_path}, x -> named_struct('id', x.id, 'leaf', x.leaf, 'proof_sha256', {proof}, 'folded_root', {folded})))")
        return materialize(each.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")), "manifest", keep=True)
