"""Benchmark decontamination by latent semantic retrieval.

The benchmark's words are the vocabulary; every document is kept once as word numbers. Document
frequencies over all documents give the IDF weights. The latent map is this search's index; it is fitted on all
passages of all different texts, each once: a distributed randomised SVD of their TF-IDF matrix (one pass:
Y = A Omega, A'Y and Y'Y summed over tasks, Nystroem's formula on the driver over a vocabulary-by-rank matrix). Windows of six sizes slide over every text; a window whose
cosine with a benchmark passage of its size is COSINE or more is a candidate. It is confirmed by the longest
common subsequence of words, as a share of the passage: from COPIED on it is a copy; from PARAPHRASED on it is
a paraphrase if it also holds the passage's answer in order: all words of the item's last sentence, where that is a part of
the passage. Where the last sentence is the whole item or isn't within the passage, a share of PARAPHRASED of the
passage's last third stands for it.

The benchmark goes in blocks of BLOCK items, so what is broadcast is bounded whatever its size. Items of fewer
than MIN_WORDS words are not searched: any text may hold them by chance. Items longer than 64 words are searched as
passages of 64. Null and empty texts match nothing. Repeated rows are searched each; a match names its text by hash
besides doc_id, so null doc_ids are told apart. A corpus of fewer different passages than RANK gives a poor latent map, and
matches may be missed there. Extra columns are ignored by search() and kept by drop_contaminated().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize

COSINE, COPIED, PARAPHRASED = 0.42, 0.8, 0.65
BLOCK, MIN_WORDS, RANK, OVERSAMPLE = 2000, 5, 64, 8
FIT_DOCS: int | None = None  # bounds _fitted() alone, which no search uses
LENGTHS = (8, 16, 24, 32, 48, 64)
UNIT = 4  # words; windows start and end at multiples
_STEP = 48 << 10  # words at a time
MATCH = "doc_id long, text_hash long, item_id long, cosine double, lcs_words int, lcs_ratio double, answer_found boolean"


class Passage:
    def __init__(self, item: int, ids: np.ndarray, answer: np.ndarray | None):
        """Without an answer of its own a passage takes its last third, of which a share is enough."""
        span = ids[-(-len(ids) // 3) * -1 :] if answer is None else answer
        self.item, self.ids, self.answer = item, ids.tolist(), span.tolist()
        self.answer_needs = len(span) if answer is not None else PARAPHRASED * len(span)
        self.size = next(x for x in LENGTHS if len(ids) <= x)
        self.masks, self.answer_masks = self._masks(self.ids), self._masks(self.answer)

    @staticmethod
    def _masks(ids: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(ids):
            out[w] = out.get(w, 0) | 1 << i
        return out


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, one big-integer step a word."""
    full = (1 << length) - 1
    row = full
    for w in words:
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
    return length - row.bit_count()


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in K.chunks(pa.array(texts, pa.large_string())):
        w = K.words(data, offsets, K.ALNUM_WORDS)
        out += np.split(w.hashes, w.offsets[1:-1])
    return out


def _passages(items: list[tuple[int, str]]) -> tuple[np.ndarray, list[Passage]]:
    """The sorted vocabulary of the items, and their passages in its numbers."""
    texts = [t.lower() for _, t in items]
    whole = _hashes(texts)
    answers = _hashes([([s for s in re.split(r"(?<=[.!?\n])\s+", t.strip()) if s.strip()] or [""])[-1] for t in texts])
    vocabulary = np.unique(np.concatenate([*whole, np.zeros(0, np.uint64)]))
    number = lambda h: np.searchsorted(vocabulary, h)
    found = []
    for (item, _), h, a in zip(items, whole, answers):
        if len(h) < MIN_WORDS:
            continue
        starts = [0] if len(h) <= LENGTHS[-1] else [*range(0, len(h) - LENGTHS[-1], LENGTHS[-1] // 2), len(h) - LENGTHS[-1]]
        own = 0 < len(a) < len(h)
        found += [Passage(item, number(h[s : s + LENGTHS[-1]]), number(a) if own and s <= len(h) - len(a) and len(h) <= s + LENGTHS[-1] else None) for s in starts]
    return vocabulary, found


def _numbered(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts as little-endian word numbers from 1 on; 0 stands for words outside the vocabulary."""
    kind = np.uint16 if len(vocabulary) < 65_535 else np.uint32
    for batch in batches:
        out = []
        for _, _, data, offsets in K.chunks(batch.column(2)):
            w = K.words(data, offsets, K.ALNUM_WORDS)
            at = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
            ids = np.where(vocabulary[at] == w.hashes, at + 1, 0).astype(kind)
            out += [ids[a:b].tobytes() for a, b in zip(w.offsets, w.offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "text_hash", "ids"])


def _runs(column: pa.Array, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word numbers, offsets) of runs of whole documents."""
    size, lo, held, total = np.dtype(kind).itemsize, 0, [], 0
    rows = len(column)
    for i in range(rows):
        held.append(column[i].as_buffer())
        total += held[-1].size // size
        if total >= _STEP or i == rows - 1:
            ids = np.frombuffer(b"".join(held), kind).astype(np.int64)
            yield lo, ids, np.concatenate([[0], np.cumsum([len(x) // size if isinstance(x, bytes) else x.size // size for x in held])])
            lo, held, total = i + 1, [], 0


def _padded(ids: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' numbers in rows of so many words, a document's last row filled with 0, and the documents' offsets in rows."""
    count = np.diff(offsets)
    rows = -(-count // words)
    ends = np.concatenate([[0], np.cumsum(rows)])
    out = np.zeros(int(ends[-1]) * words, np.int64)
    out[np.arange(len(ids)) + np.repeat(words * ends[:-1] - offsets[:-1], count)] = ids
    return out.reshape(-1, words), ends


def _row_sums(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = weights[rows[:, 0]]
    for i in range(1, rows.shape[1]):
        total += weights[rows[:, i]]
    return total


def _sketch(batches: Iterator[pa.RecordBatch], idf: np.ndarray, kind: type, width: int, block: int) -> Iterator[pa.RecordBatch]:
    """Sums of A'A Omega by blocks of vocabulary rows, and of Y'Y as block -1, each as float64 bytes."""
    size = len(idf)
    omega = np.random.default_rng(17).standard_normal((size, width)).astype(np.float32)
    weighted = (idf[:, None] * omega).astype(np.float32)
    z, core = np.zeros((size, width), order="F"), np.zeros((width, width))
    for batch in batches:
        for _, ids, offsets in _runs(batch.column(0), kind):
            if not len(ids):
                continue
            rows, _ = _padded(ids, offsets, LENGTHS[3])
            y = _row_sums(weighted, rows)
            norm = np.maximum(np.sqrt((idf[rows] ** 2).sum(1)), 1e-9).astype(np.float32)[:, None]
            y /= norm
            core += y.T @ y
            y /= norm
            owner, own = np.repeat(np.arange(len(rows)), rows.shape[1]), rows.ravel()
            owner, own = owner[own > 0], own[own > 0]
            columns = np.ascontiguousarray(y.T)
            for j in range(width):
                z[:, j] += np.bincount(own, weights=columns[j][owner], minlength=size) * idf
    keys = [*range(-(-size // block)), -1]
    values = [np.ascontiguousarray(z[i * block : (i + 1) * block]).tobytes() for i in keys[:-1]] + [core.tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], names=["block", "part"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(part.as_buffer(), np.float64)
            total[key] = total[key] + x if key in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "part"])


def latent_map(numbered: DataFrame, idf: np.ndarray, kind: type) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix over their singular values, vocabulary by RANK: latent
    coordinates of equal variance, so that what most texts share doesn't outweigh the rest. Row 0 is zero."""
    width, block, schema = RANK + OVERSAMPLE, 64, "block int, part binary"
    parts = numbered.select("ids").mapInArrow(lambda it: _sketch(it, idf, kind, width, block), schema)
    # tasks' sums meet in two steps, so that no task reads a block from all tasks of a large run
    half = parts.withColumn("salt", (F.rand(5) * 16).cast("int")).repartition("block", "salt").select("block", "part").mapInArrow(_summed, schema)
    sums = {r.block: np.frombuffer(bytes(r.part)) for r in half.repartition("block").mapInArrow(_summed, schema).collect()}  # vocabulary by width
    core = sums.pop(-1, np.zeros(width * width)).reshape(width, width)
    z = np.concatenate([sums[i].reshape(-1, width) for i in sorted(sums)]) if sums else np.zeros((len(idf), width))
    values, vectors = np.linalg.eigh(core)
    good = values > max(values.max(initial=0), 1e-12) * 1e-6  # above float32 noise
    u, s, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    keep = min(RANK, int((s > 5e-3 * s.max(initial=0)).sum()))
    return np.ascontiguousarray(u[:, :keep] / s[:keep])


def _search(batches: Iterator[pa.RecordBatch], latent: np.ndarray, passages: list[Passage], kind: type) -> Iterator[pa.RecordBatch]:
    by_size = {size: [p for p in passages if p.size == size] for size in LENGTHS}
    targets, shown, needs = {}, {}, {}
    for size, own in by_size.items():
        if own:
            shown[size] = np.array([[*(w + 1 for w in p.ids), *[-1] * (size - len(p.ids))] for p in own], np.int32)
            needs[size] = np.array([PARAPHRASED * len(p.ids) for p in own])
            q = np.array([latent[np.array(p.ids) + 1].sum(0) for p in own], np.float32)
            targets[size] = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).T
    names = [x.split()[0] for x in MATCH.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.bool_()]
    for batch in batches:
        best: dict[tuple[int, int], tuple] = {}
        for lo, ids, offsets in _runs(batch.column(2), kind):
            if not len(ids):
                continue
            units, ends = _padded(ids, offsets, UNIT)
            sums = np.zeros((len(units) + 1, latent.shape[1]), np.float32)
            np.cumsum(_row_sums(latent, units), axis=0, out=sums[1:])
            flat, count = units.ravel(), np.diff(ends)
            for size, target in targets.items():
                width, stride, margin = size * 3 // 2 // UNIT, size // 2 // UNIT, size // 2
                windows = np.where(count > 0, np.maximum(1, -(-(count - width) // stride) + 1), 0)
                doc = np.repeat(np.arange(len(count)), windows)
                begin = ends[doc] + stride * (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows))
                end = np.minimum(begin + width, ends[doc + 1])
                x = sums[end] - sums[begin]
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                cosine = x @ target
                cosine /= np.maximum(norm, 1e-6)[:, None]
                at, which = np.nonzero(cosine >= COSINE)
                # the words around a candidate window, within its document; 0 elsewhere
                low, high = UNIT * ends[doc[at]], UNIT * ends[doc[at] + 1]
                first = np.maximum(UNIT * begin[at] - margin, low)
                last = np.minimum(UNIT * end[at] + margin, high)
                for lot in range(0, len(at), 2048):
                    a, j = at[lot : lot + 2048], which[lot : lot + 2048]
                    place = first[lot : lot + 2048, None] + np.arange(UNIT * width + 2 * margin)
                    near = np.where(place < last[lot : lot + 2048, None], flat[np.minimum(place, len(flat) - 1)], 0).astype(np.int32)
                    wanted = shown[size][j]
                    held = np.zeros(len(a), np.int64)
                    for w in range(size):  # an upper bound of the common subsequence
                        held += (near == wanted[:, w, None]).any(1)
                    for m in np.flatnonzero(held >= needs[size][j]):
                        p, words, d = by_size[size][j[m]], (near[m] - 1).tolist(), int(doc[a[m]])
                        common = lcs(p.masks, len(p.ids), words)
                        if common < needs[size][j[m]]:
                            continue
                        ratio = common / len(p.ids)
                        answer = lcs(p.answer_masks, len(p.answer), words) >= p.answer_needs
                        if (ratio >= COPIED or answer) and ratio > best.get((lo + d, p.item), (0,) * 3)[2]:
                            best[lo + d, p.item] = (float(cosine[a[m], j[m]]), common, ratio, answer)
        rows = [(batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), item, *x) for (r, item), x in sorted(best.items())]
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _different(numbered: DataFrame) -> DataFrame:
    """All different texts, each once however often it stands in the corpus."""
    return numbered.groupBy("text_hash").agg(F.first("ids").alias("ids"))


def _fitted(numbered: DataFrame) -> DataFrame:
    """_different(), or about FIT_DOCS of it where that is set. Searches fit on _different(), whatever FIT_DOCS is."""
    if FIT_DOCS is not None and (texts := numbered.select("text_hash").distinct().count()) > FIT_DOCS:
        numbered = numbered.where(F.pmod(F.xxhash64("text_hash"), F.lit(1 << 40)) < int((1 << 40) * FIT_DOCS / texts))
    return _different(numbered)


def _search_block(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame | None:
    spark = rows.sparkSession
    vocabulary, passages = _passages(items)
    if not passages:
        return None
    kind = np.uint16 if len(vocabulary) < 65_535 else np.uint32
    shared = spark.sparkContext.broadcast(vocabulary)
    numbered = materialize(rows.mapInArrow(lambda it: _numbered(it, shared.value), "doc_id long, text_hash long, ids binary"), "numbered")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total[np.unique(np.frombuffer(x.as_buffer(), kind))] += 1
            total[0] += 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["word", "docs"])

    counts = numbered.select("ids").mapInArrow(frequency, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).toPandas()  # the block's words
    docs = numbered.count()
    df = np.zeros(len(vocabulary) + 1)
    df[counts["word"].to_numpy()] = counts["docs"].to_numpy()
    idf = np.log((docs + 1) / (df + 1)) + 0.05
    idf[0] = 0
    basis = latent_map(_different(numbered), idf, kind)
    given = spark.sparkContext.broadcast(((idf[:, None] * basis).astype(np.float32), passages))
    return numbered.mapInArrow(lambda it: _search(it, *given.value, kind), MATCH)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Matches (MATCH) of docs(doc_id, text) with benchmark(item_id, text), the best one of each document and item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    blocks = max(1, -(-items.count() // BLOCK))
    found = []
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()  # about BLOCK items
        one = _search_block(rows, [(r.item_id, r.text) for r in block])
        if one is not None:
            found.append(one)
    if not found:
        return docs.sparkSession.createDataFrame([], MATCH)
    out = found[0]
    for one in found[1:]:
        out = out.union(one)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose texts hold no benchmark passage."""
    bad = materialize(search(docs, benchmark).select(F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"), "left_anti")
