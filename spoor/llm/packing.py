"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

A document is its ids and an end id; tokens from loss_from on bear loss, the end id
never does. Where there is no loss_from, the first PROMPT_SHARE of a document's tokens are its prompt. Runs that fill a sequence alone are cut off first. Each rest is a vector of shares of the three limits;
it goes to the open sequence that can hold it and has the largest dot product of rest and free
space. Where none can, the fullest sequence that can hold a head of it is filled by cutting. At the end of a partition the
open sequences are refilled in turn. A sequence that a limit on segments or loss, or the end, leaves short goes out in sequences
of power-of-two lengths, so that there is no padding.

Prompts of long documents are held back, as many sequences of them as are open at most, to fill sequences whose loss is used up.
Partitions are packed apart, so memory is bounded by the open sequences and one Arrow batch. Nothing is shuffled,
and a task that runs again gives the same sequences. Null and empty texts are their end id. Repeated rows are
packed each; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS, OPEN = 1024, 16, 960, 64
#: The share of a document's first tokens that are its prompt and bear no loss, where no loss_from is given.
PROMPT_SHARE = 0.125
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Piece:
    __slots__ = ("doc", "ids", "first", "start", "end", "total", "loss_from")

    def __init__(self, doc: int | None, ids: bytes, first: int, start: int, end: int, total: int, loss_from: int):
        """ids holds the document's ids from first on; the piece is [start, end) of the document."""
        self.doc, self.ids, self.first, self.start, self.end, self.total, self.loss_from = doc, ids, first, start, end, total, loss_from

    def tokens(self) -> int:
        return self.end - self.start

    def loss(self) -> int:
        return max(0, min(self.end, self.total - 1) - max(self.start, self.loss_from))

    def cut(self, tokens: int, loss: int) -> tuple[Piece | None, Piece | None]:
        """The longest head within both bounds, and what is left."""
        end = min(self.end, self.start + tokens)
        begin = max(self.start, self.loss_from)
        if end > begin + loss and begin + loss < self.total - 1:
            end = min(end, begin + loss)
        at = lambda a, b: Piece(self.doc, self.ids, self.first, a, b, self.total, self.loss_from)
        return (at(self.start, end) if end > self.start else None), (at(end, self.end) if end < self.end else None)

    def crc(self) -> int:
        return zlib.crc32(memoryview(self.ids)[4 * (self.start - self.first) : 4 * (self.end - self.first)])


class Packer:
    """Packs pieces in the order given; out collects rows of SCHEMA."""

    def __init__(self, partition: int, tokens: int, segments: int, loss: int, bins: int):
        self.limit = np.array([tokens, segments, loss], np.int64)
        self.scale = 1.0 / (self.limit * self.limit)
        self.base, self.made, self.out = partition << 36, 0, []
        self.free = np.tile(self.limit, (bins, 1))
        self.bins: list[list[Piece]] = [[] for _ in range(bins)]
        self.stock: list[Piece] = []  # prompts of long documents, for sequences whose loss is used up
        self.stocked, self.most = 0, bins * tokens

    def take(self, tokens: int, segments: int) -> list[Piece]:
        """So many tokens from the stock, or none if it has fewer or they take more segments."""
        own, at = [], len(self.stock)
        while tokens and at and len(own) < segments:
            at -= 1
            head, tail = self.stock[at].cut(tokens, 1 << 62)
            own.append(head)
            tokens -= head.tokens()
        if tokens:
            return []
        self.stock[at:] = [tail] if tail is not None else []
        self.stocked -= sum(p.tokens() for p in own)
        return own

    def store(self, p: Piece) -> None:
        self.stock.append(p)
        self.stocked += p.tokens()
        while self.stocked > self.most and (own := self.take(int(self.limit[0]), int(self.limit[1]))):
            self.emit(own)

    def emit(self, pieces: list[Piece]) -> None:
        offset, sequence = 0, self.base + self.made
        self.made += 1
        for p in pieces:
            self.out.append((p.doc, p.start, p.tokens(), p.crc(), p.total, sequence, offset))
            offset += p.tokens()

    def close(self, i: int) -> None:
        """A sequence that stays short goes out in sequences of power-of-two lengths, which need no padding."""
        last, size = self.bins[i], int(self.limit[0] - self.free[i, 0])
        self.bins[i], self.free[i] = [], self.limit
        while size:
            need = 1 << (size.bit_length() - 1)
            if need == size or size == self.limit[0]:
                self.emit(last)
                return
            size -= need
            own: list[Piece] = []
            while need:
                head, tail = last.pop(0).cut(need, 1 << 62)
                need -= head.tokens()
                own.append(head)
                if tail is not None:
                    last.insert(0, tail)
            self.emit(own)

    def put(self, i: int, p: Piece) -> None:
        self.bins[i].append(p)
        free = self.free[i]
        free -= (p.tokens(), 1, p.loss())
        if free[2] <= 0 < free[0] and free[1] > 0 and self.stocked >= free[0] and (own := self.take(int(free[0]), int(free[1]))):
            self.bins[i] += own
            free[0] = 0
        if free[0] <= 0 or free[1] <= 0:
            self.close(i)

    def add(self, p: Piece | None) -> None:
        full, loss = int(self.limit[0]), int(self.limit[2])
        while p is not None and p.tokens() >= full:
            head, p = p.cut(full, loss)
            if head.tokens() == full:
                self.emit([head]) if head.loss() else self.store(head)
            elif own := self.take(full - head.tokens(), int(self.limit[1]) - 1):
                self.emit([head, *own])
            else:
                while head is not None:
                    head = self.place(head)
        while p is not None:
            p = self.place(p)

    def place(self, p: Piece) -> Piece | None:
        """Put the piece, or as much of it as fits, into one open sequence; what is left."""
        need = (p.tokens(), 1, p.loss())
        value = self.free @ (self.scale * need)  # the dot product of both vectors as shares of the limits
        value[(self.free < need).any(1)] = -1
        i = int(value.argmax())
        if value[i] >= 0:
            self.put(i, p)
            return None
        # the fullest sequence that can hold a head of it is filled by cutting
        free = self.free[:, 0]
        if p.start >= p.loss_from and not (p.end == p.total and p.tokens() == 1):  # it begins with loss
            free = np.where(self.free[:, 2] > 0, free, 1 << 40)
        i = int(free.argmin())
        if free[i] >= 1 << 40:  # all have used up their loss: the one with the least padding is closed
            self.close(int(self.free[:, 0].argmin()))
            return p
        head, tail = p.cut(int(self.free[i, 0]), int(self.free[i, 2]))
        self.put(i, head)
        return tail

    def finish(self) -> None:
        """Refill the open sequences from one another, fullest first, then close the last by powers of two."""
        order = np.argsort(self.free[:, 0], kind="stable")
        left = [*self.stock, *(p for i in order for p in self.bins[i])]
        self.stock, self.stocked = [], 0
        left.sort(key=lambda p: p.loss() * 2 > p.tokens())  # what bears no loss first: it goes with what does
        self.free, self.bins = np.tile(self.limit, (2, 1)), [[], []]
        for p in left:
            while p is not None:
                p = self.place(p)
        for i in range(len(self.bins)):
            self.close(i)


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 0, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, prompt_share: float = PROMPT_SHARE, bins: int = OPEN) -> DataFrame:
    """Pieces (SCHEMA) of docs(doc_id, text[, loss_from]); tokenizer is a file that every executor can read."""
    loss = (F.col("loss_from") if "loss_from" in docs.columns else F.lit(None)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), loss.alias("loss_from"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = int(end_id).to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId(), max_tokens, max_segments, max_loss, bins)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.out)) or [[]] * len(_FIELDS)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(_FIELDS))

        for batch in batches:
            for doc, text, loss_from in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                packer.add(Piece(doc, ids, 0, 0, total, total, int(total * prompt_share) if loss_from is None else loss_from))
                for p in (p for own in packer.bins for p in own if p.ids is ids) if total > 2 * max_tokens else ():  # what stays open must not hold the whole document
                    p.ids, p.first = ids[4 * p.start : 4 * p.end], p.start
            yield flush()
        packer.finish()
        yield flush()

    return rows.mapInArrow(run, SCHEMA)
