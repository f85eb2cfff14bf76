"""JSON arrays in files of any size, each read by many tasks.

Spark's text reader cuts a file into byte ranges and the ranges into fragments that end at a closing brace, wherever that stands. A first pass over the fragments
sums up a range: its quotes' parity, and how far it nests, either way round, depending on whether it starts within a string. From those sums, a row a
range, follows where each range really starts, and a second pass cuts it into the array's elements and the gaps between them. What crosses
a range's ends is put together afterwards. Every element and gap is parsed, so that a file is accepted exactly if it is one JSON array;
any flaw, such as a lost tail, rejects the whole file.

Bytes that are no UTF-8 are replaced. Elements that are no objects give no row. A file without any byte is rejected.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.state.store import written

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_ESCAPE = re.compile(r"\\.", re.S)
_SUM = "file string, block long, size long, bytes long, flips boolean, outside long, inside long"
_PIECE = "file string, block long, kind string, mode string, text string"


def _named(file: Column) -> Column:
    """Local paths are written with one slash or three."""
    return F.regexp_replace(file, "^file:/+", "file:///")


def fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, size, bytes, text): what stands before each closing brace, in order within a block."""
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(paths)
    meta = F.col("_metadata")
    return rows.select(_named(meta["file_path"]).alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.octet_length("value").cast("long").alias("bytes"), F.make_valid_utf8("value").alias("text"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of a block's fragments; depths are sums over what lies outside of strings, for a start outside and inside of one."""
    found: dict[tuple, list] = {}
    for file, block, size, length, text in _rows(batches):
        s = found.setdefault((file, block, size), [0, False, [0, 0]])
        parts = _ESCAPE.sub("", text).split('"')
        for at, some in enumerate((parts[0::2], parts[1::2])):
            s[2][(at + s[1]) % 2] += sum(p.count("{") + p.count("[") - p.count("]") for p in some)
        s[0] += length + 1
        s[1] ^= len(parts) % 2 == 0
        s[2][int(s[1])] -= 1  # the brace, where it is outside
    names = [c.split()[0] for c in _SUM.split(", ")]
    yield _table([(*key, n, flips, *depth) for key, (n, flips, depth) in found.items()], names, [pa.string(), *[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 2])


def _starts(sums: DataFrame) -> DataFrame:
    """(file, block, in_string, depth, cut): the state in which a block starts; cut: its last fragment, the file's last, has no brace after it."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    every = Window.partitionBy("file")
    odd = F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1
    rows = sums.groupBy("file", "block", "size").agg(F.sum("bytes").alias("bytes"), F.max("flips").alias("flips"), F.sum("outside").alias("outside"), F.sum("inside").alias("inside")).withColumn("in_string", odd)
    rows = rows.withColumn("own", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    cut = (F.col("block") == F.max("block").over(every)) & (F.sum("bytes").over(every) > F.col("size"))
    return rows.select("file", "block", "in_string", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("depth"), cut.alias("cut"))


def parses(mode: str, text: str, first: bool, last: bool) -> object:
    """What an element is, or for a gap whether it fits between elements, or between one and the file's ends; None if it does not parse."""
    try:
        if mode == "element":
            return None if last else json.loads(text)
        whole = json.loads(("" if first else "[{}") + text + ("" if last else "{}]"))
        return True if isinstance(whole, list) else None
    except (ValueError, RecursionError):
        return None


class _Cutter:
    """One block, fragment by fragment: gives pieces (kind, mode, text)."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth, self.mode = in_string, depth, "element" if depth >= 2 else "gap"
        self.parts: list[str] = []
        self.open = True  # the item began before this block

    def _end(self, mode: str) -> Iterator[tuple[str, str, str]]:
        text, self.parts = "".join(self.parts), []
        if self.open:
            yield "head", self.mode, text
        else:
            found = parses(self.mode, text, False, False)
            if found is None:
                yield "bad", self.mode, ""
            elif self.mode == "element" and isinstance(found, dict):
                yield "row", self.mode, text
        self.open, self.mode = False, mode

    def take(self, text: str, brace: bool) -> Iterator[tuple[str, str, str]]:
        at = begin = 0
        if self.in_string:
            closed = _STRING_END.match(text)
            at, self.in_string = (closed.end(), False) if closed else (len(text), True)
        for token in _TOKEN.finditer(text, at) if not self.in_string else ():
            found = token[0]
            if found[0] == '"':
                self.in_string = len(found) < 2 or found[-1] != '"' or not _STRING_END.fullmatch(found, 1)
            elif found == "]":
                self.depth -= 1
                if self.mode == "element" and self.depth == 1:
                    self.parts.append(text[begin : token.end()])
                    begin = token.end()
                    yield from self._end("gap")
            else:
                self.depth += 1
                if self.mode == "gap" and self.depth == 2:
                    self.parts.append(text[begin : token.start()])
                    begin = token.start()
                    yield from self._end("element")
        self.parts.append(text[begin:])
        if brace:
            self.parts.append("}")
            if not self.in_string:
                self.depth -= 1
                if self.mode == "element" and self.depth == 1:
                    yield from self._end("gap")

    def close(self) -> Iterator[tuple[str, str, str]]:
        yield "through" if self.open else "tail", self.mode, "".join(self.parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["file", "block", "kind", "mode", "text"], [pa.string(), pa.int64(), *[pa.string()] * 3]
    out, size, now, cutter, held = [], 0, None, None, None

    def finish(brace: bool) -> Iterator[tuple]:
        """The fragment that was held back, as only what follows tells whether it is its block's last, then the block's end."""
        yield from ((*now, *p) for p in cutter.take(held, brace))
        yield from ((*now, *p) for p in cutter.close())

    cut_here = False
    for file, block, text, in_string, depth, cut in _rows(batches):
        if (file, block) != now:
            if now is not None:
                out += finish(not cut_here)
            now, cutter, cut_here = (file, block), _Cutter(in_string, depth), cut
        else:
            out += ((*now, *p) for p in cutter.take(held, True))
        held = text
        size += len(text)
        if size > 4 << 20:
            yield _table(out, names, types)
            out, size = [], 0
    if now is not None:
        out += finish(not cut_here)
    yield _table(out, names, types)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items that cross ranges, put together: rows and flaws."""
    out = []
    for file, block, mode, text, first, last in _rows(batches):
        found = parses(mode, text, first, last)
        if found is None:
            out.append((file, block, "bad", mode, ""))
        elif mode == "element" and isinstance(found, dict):
            out.append((file, block, "row", mode, text))
    yield _table(out, ["file", "block", "kind", "mode", "text"], [pa.string(), pa.int64(), *[pa.string()] * 3])


def read_arrays(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (file, row), the objects of the files that are JSON arrays as text, and verdicts (file, accepted, rows) of all files under paths."""
    parts = fragments(spark, paths)
    starts = written(_starts(parts.mapInArrow(_sums, _SUM)), "ranges")
    # a range's fragments must stay in order: its start goes to them without a shuffle, as one row a range is little
    placed = parts.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "text", "in_string", "depth", "cut")
    pieces = written(placed.mapInArrow(_cut, _PIECE), "pieces")
    whole, ends = pieces.where("kind in ('row', 'bad')"), pieces.where("kind not in ('row', 'bad')")
    # an item starts at a file's start or with a tail, and goes on to the next head
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == "tail", 1).otherwise(0))
    ends = ends.withColumn("item", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(order))
    joined = ends.groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("block", F.when(F.col("kind") == "tail", 1).otherwise(0).alias("late"), "mode", "text", "kind"))).alias("p"))
    joined = joined.select("file", F.expr("p[0].block").alias("block"), F.expr("p[0].mode").alias("mode"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), (F.col("item") == 0).alias("first"), F.expr("element_at(p, -1).kind <> 'head'").alias("last"))
    everything = written(whole.unionByName(joined.mapInArrow(_joined, _PIECE)).select("file", "kind", "text"), "elements")
    seen = starts.select("file").distinct().join(everything.groupBy("file").agg(F.count_if(F.col("kind") == "bad").alias("bad"), F.count_if(F.col("kind") == "row").alias("n")), "file", "left")
    listed = spark.createDataFrame([(f,) for f in spark.read.option("recursiveFileLookup", "true").text(paths).inputFiles()], "file string")  # the scan skips empty files
    listed = listed.select(_named(F.col("file")).alias("file"))
    empty = listed.join(seen, "file", "left_anti").select("file", F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("rows"))
    good = F.coalesce(F.col("bad"), F.lit(0)) == 0
    verdicts = seen.select("file", good.alias("accepted"), F.when(good, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("rows")).unionByName(empty)
    verdicts = written(verdicts, "verdicts")
    rows = everything.where("kind = 'row'").join(verdicts.where("accepted").select("file"), "file", "left_semi").select("file", F.col("text").alias("row"))
    return rows, verdicts
