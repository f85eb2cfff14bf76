"""Copies among a media column's images by local descriptors.

Corners are found at scales a quarter of an octave apart (Harris response, local maxima; an image's strongest, one for AREA pixels and
POINTS at least), turned to the
direction of their patch's centre of mass, and described by 256 binary tests of smoothed pixels. Descriptors meet in a
Hamming table where one of the eighths in CELLS is equal. Two images are candidates where descriptors that meet differ in at most MAX_BITS of all
bits, or where two different points of each meet with at most NEAR_BITS, as two points of unlike images hardly ever meet. Patches are wide (RADIUS), as narrow
ones of unlike images are often alike; chance candidates grow with the square of the images, at the rate in the README. A candidate pair is confirmed, once, by geometric
consensus: matches within MAX_BITS vote for one similarity transform (turn, scale, shift) in overlapping bins, and at
least MIN_VOTES different points must agree. Images of equal bytes are one class before any search; large table cells
are resolved by linking.link_members, without a cap.

Images are 8-bit grey, as (image_id, width, height, pixels). Null, empty or short pixels and images
without corners link with nothing but equal bytes (null and empty ones with nothing). Repeated rows are members of their
class each; a null image_id is never a class id unless all of the class are null. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import connected_components, link_members
from .storage import materialize, scope, small

POINTS, AREA, SCALES, RADIUS, MAX_BITS, MIN_VOTES = 48, 192, 5, 19, 40, 6
NEAR_BITS = 56
CELLS = (0, 0), (1, 0), (2, 0), (3, 0), (0, 1), (1, 1)  # quarter and half of it: 32 bits each
SHIFT_BIN, TURN_BIN, SCALE_BIN = 12.0, 0.5, 0.5  # pixels, radians, octaves
SIDE, GRID = 96, 20
SLICE = 128  # rows at a time: Arrow's batches of 10,000 images, with their copies in Python, pass 100 MB a task
IMAGE = "image_id long, source_id long, edit string, width int, height int, pixels binary"
_PAIRS = np.clip(np.random.default_rng(3).normal(0, RADIUS / 2.2, (256, 4)), -RADIUS + 2, RADIUS - 2)
_Y, _X = np.mgrid[-7:8, -7:8]
_DISK = (_X**2 + _Y**2 <= 49).ravel()
_DX, _DY = _X.ravel()[_DISK], _Y.ravel()[_DISK]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    y, x = np.linspace(0, a.shape[0] - 1, h), np.linspace(0, a.shape[1] - 1, w)
    i, j = np.minimum(y.astype(int), a.shape[0] - 2), np.minimum(x.astype(int), a.shape[1] - 2)
    fy, fx = (y - i)[:, None], (x - j)[None]
    top, low = a[i], a[i + 1]
    top, low = top[:, j] * (1 - fx) + top[:, j + 1] * fx, low[:, j] * (1 - fx) + low[:, j + 1] * fx
    return top * (1 - fy) + low * fy


def _drawn(vector: list[float]) -> np.ndarray:
    """A textured grey image that a vector's bytes determine."""
    rng = np.random.default_rng(zlib.crc32(np.array(vector, "<f4").tobytes()))
    return _resize(rng.integers(0, 256, (GRID, GRID)).astype(float), SIDE, SIDE)


def _edited(a: np.ndarray, kind: int) -> tuple[str, np.ndarray]:
    if kind == 0:
        return "crop", a[8 : SIDE - 6, 5 : SIDE - 12]
    if kind == 1:
        return "tone", a * 0.6 + 40
    if kind == 2:
        return "turn", np.rot90(a)
    out = a.copy()
    out[30:55, 40:70] = 128
    return "patch", out


def render(embeddings: DataFrame) -> DataFrame:
    """IMAGE rows that embeddings(vec_id, embedding) determine: one image for each vector, and an edited copy for each fifth vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for vec, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vector is None or vec is None:
                    rows.append((None if vec is None else 2 * vec, vec, "", 0, 0, None))
                    continue
                a = _drawn(vector)
                made = [(2 * vec, "", a)]
                if vec % 5 == 0:
                    made.append((2 * vec + 1, *_edited(a, vec // 5 % 4)))
                rows += [(i, vec, edit, x.shape[1], x.shape[0], np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes()) for i, edit, x in made]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in IMAGE.split(", ")])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, IMAGE)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means of windows of r pixels each way; edge pixels are repeated outwards."""
    y, x = (np.arange(-r - 1, size + r).clip(0, size - 1) for size in a.shape)
    return _window_sums(a.take(y, 0).take(x, 1), r) / (2 * r + 1) ** 2


def _window_sums(a: np.ndarray, r: int) -> np.ndarray:
    """Of the last two axes, for windows that lie within, without the first row and column."""
    n = 2 * r + 1
    p = a.cumsum(-2).cumsum(-1)
    return p[..., n:, n:] - p[..., :-n, n:] - p[..., n:, :-n] + p[..., :-n, :-n]


def _sampled(a: np.ndarray, py: np.ndarray, px: np.ndarray) -> np.ndarray:
    """a between its pixels, bilinear, clipped to its edges."""
    py, px = py.clip(0, a.shape[0] - 1.001), px.clip(0, a.shape[1] - 1.001)
    i, j = py.astype(np.int64), px.astype(np.int64)
    fy, fx = py - i, px - j
    flat, at = a.ravel(), i * a.shape[1] + j
    top = flat[at] * (1 - fx) + flat[at + 1] * fx
    at += a.shape[1]
    return top * (1 - fy) + (flat[at] * (1 - fx) + flat[at + 1] * fx) * fy


def describe(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points as x, y, scale, angle in the image's pixels; descriptors as 4 int64 each) of the strongest corners."""
    levels, corners = [], []
    for level in range(SCALES):
        f = 2.0 ** (level / 4)
        h, w = int(a.shape[0] / f), int(a.shape[1] / f)
        if min(h, w) < 2 * RADIUS + 4:
            break
        s = _box(a if level == 0 else _resize(a, h, w), 1)
        # the response where a whole patch fits and one pixel around it, from five rows more before and four after
        e = RADIUS + 1
        near = s[e - 5 : h - e + 4, e - 5 : w - e + 4]
        gy, gx = (near[2:, 1:-1] - near[:-2, 1:-1]) / 2, (near[1:-1, 2:] - near[1:-1, :-2]) / 2
        xx, yy, xy = _window_sums(np.stack([gx * gx, gy * gy, gx * gy]), 2) / 25
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        rows = np.maximum(np.maximum(r[:-2], r[1:-1]), r[2:])
        best = np.maximum(np.maximum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])
        r = r[1:-1, 1:-1]
        y, x = np.nonzero((r >= best) & (r > 1e-3 * max(r.max(), 1e-9)))
        strength, y, x = r[y, x], y + e, x + e
        levels.append((f, (a.shape[0] - 1) / (h - 1), (a.shape[1] - 1) / (w - 1), s))
        corners.append(np.stack([strength, np.full(len(y), level), y, x]))
    if not corners:
        return np.zeros((0, 4)), np.zeros((0, 4), np.int64)
    found = np.concatenate(corners, 1)
    found = found[:, np.argsort(-found[0], kind="stable")[: max(POINTS, a.size // AREA)]]
    points, words = [], []
    for level, (f, fy, fx, s) in enumerate(levels):
        y, x = found[2:, found[1] == level].astype(np.int64)
        if not len(y):
            continue
        patch = s[y[:, None] + _DY, x[:, None] + _DX]
        angle = np.arctan2((patch * _DY).sum(1), (patch * _DX).sum(1))
        c, n = np.cos(angle)[:, None], np.sin(angle)[:, None]
        smooth = _box(s, 1)
        one, two = (_sampled(smooth, y[:, None] + n * px + c * py, x[:, None] + c * px - n * py) for px, py in ((_PAIRS[:, 0], _PAIRS[:, 1]), (_PAIRS[:, 2], _PAIRS[:, 3])))
        points.append(np.stack([x * fx, y * fy, np.full(len(x), f), angle], 1))
        words.append(np.packbits(one < two, axis=1).view(">i8").astype(np.int64))
    return np.concatenate(points or [np.zeros((0, 4))]), np.concatenate(words or [np.zeros((0, 4), np.int64)])


def _descriptors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["node", "p", "x", "y", "s", "t", "d0", "d1", "d2", "d3"]
    for batch in _slices(batches):
        nodes, points, words = [], [], []
        for node, w, h, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if not raw or not w or not h or len(raw) < w * h:
                continue
            p, d = describe(np.frombuffer(raw, np.uint8)[: w * h].reshape(h, w).astype(float))
            nodes += [(node, i) for i in range(len(p))]
            points.append(p)
            words.append(d)
        p = np.concatenate(points) if points else np.zeros((0, 4))
        d = np.concatenate(words) if words else np.zeros((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in nodes], pa.int64()), pa.array([i for _, i in nodes], pa.int32()), *(pa.array(p[:, i].astype(np.float32)) for i in range(4)), *(pa.array(d[:, i]) for i in range(4))], names=names)


def _agreed(matches: pd.DataFrame) -> pd.DataFrame:
    """The pair (a, b) of these matches if MIN_VOTES points of each image vote for one bin of a similarity transform; bins overlap by half."""
    turns = int(round(2 * np.pi / TURN_BIN))
    values = np.stack([matches.turn * turns / (2 * np.pi), matches.octave / SCALE_BIN, matches.dx / SHIFT_BIN, matches.dy / SHIFT_BIN], 1)
    halves = np.array([[i >> j & 1 for j in range(4)] for i in range(16)]) / 2
    bins = np.floor(values[None] + halves[:, None]).astype(np.int64)
    bins[..., 0] %= turns
    shift = np.broadcast_to(np.arange(16)[:, None, None], (*bins.shape[:2], 1))
    _, code = np.unique(np.concatenate([shift, bins], 2).reshape(-1, 5), axis=0, return_inverse=True)
    votes = [np.bincount(np.unique(np.stack([code.ravel(), np.tile(matches[p], 16)], 1), axis=0)[:, 0]) for p in ("p_a", "p_b")]
    return matches[["a", "b"]].head(int((np.minimum(*votes) >= MIN_VOTES).any()))


def copies(images: DataFrame) -> DataFrame:
    """(image_id, class_id, n_points) of every image: class_id is the least image_id of its component."""
    rows = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    full = F.octet_length("pixels") > 0
    rows = rows.withColumn("node", F.when(full, F.xxhash64("width", "height", F.md5("pixels"))))
    seen = materialize(rows.select("image_id", "node"), "images", keep=True)
    with scope(images.sparkSession):
        classes = materialize(_classes(rows, seen), "image-class", keep=True)
    return seen.join(small(classes), "node", "left").select("image_id", F.when(F.col("node").isNull(), F.col("image_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"))


def _classes(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, class_id, n_points) of the different images."""
    each = seen.where("node is not null").groupBy("node", "image_id").agg(F.count(F.lit(1)).alias("rows"))
    sets = each.groupBy("node").agg(F.min(F.struct(F.col("image_id").isNull().alias("no_id"), "image_id", "rows")).alias("x")).select("node", F.col("x.image_id").alias("least"), F.col("x.rows").alias("rows"))
    sets = materialize(sets, "image-classes")
    # one row of each different image is described; its pixels are not shuffled where the names of those rows are small
    named = small(sets).select(F.col("node").alias("own"), "least")
    one = rows.where("node is not null").join(named, rows.image_id.eqNullSafe(named.least) & (rows.node == named.own)).select("node", "width", "height", "pixels")
    if sets.where("rows > 1").limit(1).count():
        one = one.dropDuplicates(["node"])
    desc = materialize(one.mapInArrow(_descriptors, "node long, p int, x float, y float, s float, t float, d0 long, d1 long, d2 long, d3 long"), "descriptors")
    # a cell's key is its eighth's number and bits; all other bits go with it, to tell chance meetings early
    half = lambda i, low: F.shiftright(F.shiftleft(f"d{i}", 32) if low else F.col(f"d{i}"), 32)
    others = lambda i, low: F.struct(half(i, 1 - low).cast("int").alias("m0"), *(F.col(f"d{(i + j) % 4}").alias(f"m{j}") for j in (1, 2, 3)), "p")
    cell = F.explode(F.array(*(F.struct((half(i, low) * len(CELLS) + at).alias("key"), others(i, low).alias("n")) for at, (i, low) in enumerate(CELLS))))
    members = desc.select("node", cell.alias("c")).select("c.key", "node", "c.n")

    def bits(x: str, y: str) -> F.Column:
        return sum((F.bit_count(F.col(f"{x}.m{j}").bitwiseXOR(F.col(f"{y}.m{j}"))) for j in (1, 2, 3)), F.bit_count(F.col(f"{x}.m0").bitwiseXOR(F.col(f"{y}.m0"))))

    def may_link(x: str, y: str) -> F.Column:
        return bits(x, y) <= NEAR_BITS

    def meet(meetings: DataFrame) -> DataFrame:
        """The candidates of meetings (a, b, n_a, n_b): one is a match, or different points of both images meet."""
        points = [F.col(f"n_{x}.p") for x in "ab"]
        seen = meetings.groupBy("a", "b").agg(F.min(bits("n_a", "n_b")).alias("least"), *(agg(p).alias(f"{name}_{x}") for x, p in zip("ab", points) for name, agg in (("lo", F.min), ("hi", F.max))))
        return seen.where((F.col("least") <= MAX_BITS) | (F.col("lo_a") < F.col("hi_a")) & (F.col("lo_b") < F.col("hi_b"))).select("a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        ends = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "pair-nodes")
        own = desc.join(small(ends), "node", "left_semi")
        a, b = (own.select(*(F.col(c).alias(f"{c}_{x}") for c in desc.columns)) for x in "ab")
        near = pairs.join(a, pairs.a == a.node_a).join(b, pairs.b == b.node_b)
        unlike = sum((F.bit_count(F.col(f"d{i}_a").bitwiseXOR(F.col(f"d{i}_b"))) for i in range(1, 4)), F.bit_count(F.col("d0_a").bitwiseXOR(F.col("d0_b"))))
        near = near.where(unlike <= MAX_BITS)
        turn = F.col("t_b") - F.col("t_a")
        turn = turn - 2 * np.pi * F.floor(turn / (2 * np.pi))  # 0 to a whole turn
        scale = F.col("s_b") / F.col("s_a")
        near = near.select("a", "b", "p_a", "p_b", turn.alias("turn"), F.log2(scale).alias("octave"), (F.col("x_b") - scale * (F.cos(turn) * F.col("x_a") - F.sin(turn) * F.col("y_a"))).alias("dx"), (F.col("y_b") - scale * (F.sin(turn) * F.col("x_a") + F.cos(turn) * F.col("y_a"))).alias("dy"))
        # a pair's matches are at most the product of the two images' points
        return near.groupBy("a", "b").applyInPandas(_agreed, "a long, b long")

    def rest(left: DataFrame, judged: DataFrame) -> DataFrame:
        x, y = (left.select("key", F.col("n").alias(f"n_{i}"), F.col("node").alias(i), F.col("comp").alias(f"comp_{i}")) for i in "ab")
        return meet(x.join(y, "key").where(may_link("n_a", "n_b")).where("a < b and comp_a <> comp_b").select("a", "b", "n_a", "n_b")).join(judged, ["a", "b"], "left_anti")

    links = materialize(link_members(members, may_link, verify, rest, meet, write=False), "image-links")
    comps = connected_components(links)
    placed = sets.join(small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = placed.groupBy("comp").agg(F.min("least").alias("class_id"))
    points = desc.groupBy("node").agg(F.count(F.lit(1)).alias("n_points"))
    return placed.join(least, "comp").join(points, "node", "left").select("node", "class_id", "n_points")
