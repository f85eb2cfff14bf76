"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, their stems (first four characters), word pairs
and pairs one word apart, hashed to 2**bits coordinates; words are runs of letters and
digits of the lower-cased text. Each
shard of at most about SHARD_ROWS rows, two at least, of a bounded labelled sample trains FTRL-proximal with per-coordinate rates and
L1 on hashed feature numbers, not texts; the shards' sparse weights are averaged, and the few weights that are left are
broadcast (at most 2**bits float32) to score all texts whole.

Null and empty texts have no features and get the bias' score. Without labelled rows all
scores are 0. Repeated rows get a score each; extra columns are kept, but for one named score, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .storage import materialize

BITS = 20
SAMPLE_ROWS = 24_000
SHARD_ROWS = 8_000
EPOCHS = 3
STEM = 4
POS = 2


def features(w: K.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of every word, pair and skip pair."""
    n = len(w.hashes)
    doc = np.repeat(np.arange(len(w.offsets) - 1, dtype=np.int32), np.diff(w.offsets))
    shift = np.uint64(64 - bits)
    fs, ds = [K.mix(w.hashes + np.uint64(1)) >> shift, K.mix(w.stems + np.uint64(2)) >> shift], [doc, doc]
    for gap in (1, 2):
        if n > gap:
            same = doc[:-gap] == doc[gap:]
            pair = K.mix(w.hashes[:-gap][same] * np.uint64(2 * gap + 1) + w.hashes[gap:][same] + np.uint64(gap))
            fs.append(pair >> shift)
            ds.append(doc[:-gap][same])
    return np.concatenate(fs).astype(np.int32), np.concatenate(ds)


def _features(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(shard, toxic, rank, text_hash, features) of (shard, toxic, rank, text_hash, text): each text's different features, sorted."""
    for batch in batches:
        for lo, hi, data, offsets in K.chunks(batch.column(4)):
            f, d = features(K.words(data, offsets, K.ALNUM_WORDS, STEM), bits)
            once = np.unique((d.astype(np.int64) << bits) | f)
            cuts = np.searchsorted(once >> bits, np.arange(hi - lo + 1)).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(cuts), pa.array((once & ((1 << bits) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:4]), own], names=["shard", "toxic", "rank", "text_hash", "features"])


def _train(shard: pa.Table, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> pa.Table:
    """FTRL-proximal over one shard's features; the last coordinate is the bias, without L1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    strength = np.full(size + 1, l1)
    strength[size] = 0
    shard = shard.sort_by([("rank", "ascending"), ("text_hash", "ascending")]).combine_chunks()
    y, lists = shard["toxic"].to_numpy().astype(float), shard["features"].combine_chunks()
    cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    for _ in range(epochs):
        for a, b, t in zip(cuts, cuts[1:], y):
            i = np.append(flat[a:b], size)
            zi, ni, s = z[i], n[i], strength[i]
            w = np.where(np.abs(zi) <= s, 0.0, (np.sign(zi) * s - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - t) * (POS if t else 1)
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - step * w
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= strength, 0.0, (np.sign(z) * strength - z) / ((beta + np.sqrt(n)) / alpha + l2))
    i = np.flatnonzero(w)
    return pa.table({"feature": pa.array(i.astype(np.int32)), "weight": pa.array(w[i])})


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, *, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1) -> DataFrame:
    """Weights (feature, weight) from the labelled rows for which train_rows holds (over doc_id).

    sample_rows bounds the labelled rows that are fitted: the rows of least hash, so the
    same at every run; a doc_id with several labels is toxic if one says so."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train_rows)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("rank", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    total = known.count()
    shards = max(2, -(-min(total, sample_rows) // shard_rows))  # two at least: what one shard alone finds is less sure
    if total > sample_rows:
        known = known.where(F.col("rank") < int((1 << 40) * sample_rows / total))
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about sample_rows small rows
    rows = picked.select((F.col("rank") % shards).cast("int").alias("shard"), F.col("toxic").cast("int").alias("toxic"), "rank", F.xxhash64("text").alias("text_hash"), "text")
    sample = rows.mapInArrow(lambda it: _features(it, bits), "shard int, toxic int, rank long, text_hash long, features array<int>")
    grown = sample.groupBy("shard").applyInArrow(lambda t: _train(t, bits, epochs, alpha, beta, l1, l2), "feature int, weight double")
    return grown.groupBy("feature").agg((F.sum("weight") / shards).alias("weight"))


def score(docs: DataFrame, weights: DataFrame, *, bits: int = BITS) -> DataFrame:
    """docs with a double column score in [0, 1]. weights has at most 2**bits + 1 rows."""
    spark, docs = docs.sparkSession, docs.drop("score", "__folded")
    pairs = weights.toPandas()  # at most 2**bits + 1 rows by construction, few after L1
    dense = np.zeros((1 << bits) + 1, np.float32)
    dense[pairs["feature"].to_numpy()] = pairs["weight"].to_numpy()
    shared, known = spark.sparkContext.broadcast(dense), len(pairs) > 0
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        bias = float(w[-1])
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in K.chunks(batch.column(len(batch.schema.names) - 1)):
                f, d = features(K.words(data, offsets, K.ALNUM_WORDS, STEM), bits)
                hit = w[f] != 0
                once = np.unique((d[hit].astype(np.int64) << bits) | f[hit])
                total = bias + np.bincount(once >> bits, weights=w[once & ((1 << bits) - 1)], minlength=hi - lo)
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if known else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "score"])

    kept = docs.select(*docs.columns, F.lower("text").alias("__folded"))
    return kept.mapInArrow(run, schema)


def fit_and_score(docs: DataFrame, labels: DataFrame, train_rows: Column) -> DataFrame:
    weights = materialize(train(docs.withColumn("text", F.lower("text")), labels, train_rows), "toxic-weights")
    return score(docs, weights)
