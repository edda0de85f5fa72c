"""Packing documents into sequences under limits on tokens, segments and loss-bearing tokens.

Each task encodes its rows and packs them in one pass. A vector of three demands
describes what is left of a document; the open sequence takes, from a window of
waiting documents, the one that fits and whose demands have the largest dot product
with what the sequence has left. When none fits, the longest is cut to fill it.
So a task leaves at most its last sequences short, and nothing is shuffled.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .common import table

#: Documents that wait for a sequence.
WINDOW = 128


class Packer:
    """Places documents, given as (key, tokens, first loss-bearing token); yields (key, start, length, sequence, offset)."""

    def __init__(self, tokens: int = 1024, segments: int = 512, loss: int = 1024, window: int = WINDOW):
        self.full = (tokens, segments, loss)
        self.scale = 1 / np.array(self.full, np.float64)
        self.window = window
        self.waiting: list[tuple[object, int, int, int]] = []  # key, start, end, loss_from
        self.demand = np.zeros((window, 3))
        self.ids = 0
        self._open()

    def _open(self) -> None:
        self.sequence, self.left = self._fresh(), self.full

    def _fresh(self) -> int:
        self.ids += 1
        return self.ids - 1

    @staticmethod
    def _fits(item: tuple, left: tuple) -> int:
        """How many of its next tokens fit."""
        _, start, end, loss_from = item
        return min(end - start, left[0], max(0, loss_from - start) + left[2]) if left[1] else 0

    def _wait(self, at: int, item: tuple) -> None:
        _, start, end, loss_from = item
        if at == len(self.waiting):
            self.waiting.append(item)
        else:
            self.waiting[at] = item
        self.demand[at] = end - start, 1, max(0, end - max(start, loss_from))

    def _leave(self, at: int) -> None:
        last = self.waiting.pop()
        if at < len(self.waiting):
            self.waiting[at] = last
            self.demand[at] = self.demand[len(self.waiting)]

    def add(self, key: object, n: int, loss_from: int = 0) -> Iterator[tuple]:
        """Takes a document in; yields the pieces placed by that. One without tokens yields none."""
        start, most = 0, self.full[0]
        while n - start >= most and self._fits((key, start, n, loss_from), self.full) == most:
            yield key, start, most, self._fresh(), 0  # fills a sequence on its own
            start += most
        if n > start:
            self._wait(len(self.waiting), (key, start, n, loss_from))
            while len(self.waiting) >= self.window:
                yield from self._step()

    def close(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._step()

    def _step(self) -> Iterator[tuple]:
        """Places one piece, or opens the next sequence."""
        left = np.array(self.left, np.float64)
        demand = self.demand[: len(self.waiting)]
        fitting = (demand <= left).all(axis=1)
        if fitting.any():
            worth = np.where(fitting, (demand * self.scale) @ (left * self.scale), -1.0)
            at = int(worth.argmax())
        else:
            at = int(demand[:, 0].argmax())
            if not self._fits(self.waiting[at], self.left):
                room = [self._fits(x, self.left) for x in self.waiting]
                at = int(np.argmax(room))
                if not room[at]:
                    return self._open()
        key, start, end, loss_from = self.waiting[at]
        n = self._fits(self.waiting[at], self.left)
        yield key, start, n, self.sequence, self.full[0] - self.left[0]
        bearing = max(0, start + n - max(start, loss_from))
        self.left = (self.left[0] - n, self.left[1] - 1, self.left[2] - bearing)
        if start + n == end:
            self._leave(at)
        else:
            self._wait(at, (key, start + n, end, loss_from))
        if not self.left[0] or not self.left[1]:
            self._open()


def packed(docs: DataFrame, file: str, end_id: int = 0, tokens: int = 1024, segments: int = 512, loss: int = 1024, prompt_chars: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece; with `keep` the ids of the piece.

    Null text counts as empty: the end id alone. Every row is a document of its own,
    equal and repeated ones too. `prompt_chars` names a column with the number of
    leading characters whose tokens bear no loss (null: none); without it all tokens
    do. `segments` and `loss` must be at least 1. A sequence_id is made of the task's
    number and a counter, so a task that runs again gives the same ids. Other columns
    are left out; an empty table gives no pieces.
    """
    if min(tokens, segments, loss) < 1:
        raise ValueError("limits must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunks.library_encoder(file)
        packer = Packer(tokens, segments, loss)
        base = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            part = [memoryview(ids)[s * 4 : (s + n) * 4] for (_, ids), s, n, _, _ in pieces]
            cols = [
                pa.array([k[0] for k, *_ in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x) for x in part], pa.int64()),
                pa.array([len(k[1]) // 4 for k, *_ in pieces], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            if keep:
                cols.append(pa.array([np.frombuffer(x, "<i4") for x in part], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for k in range(0, b.num_rows, 1000):
                some = b.slice(k, 1000)
                ids = encoder.lists(some.column("text"), end_id)
                prompts = some.column("prompt").to_pylist()
                heads = [0] * len(ids)
                if any(prompts):
                    leading = [(t or "")[: max(0, p or 0)] for t, p in zip(some.column("text").to_pylist(), prompts)]
                    heads = [len(x) // 4 for x in encoder.lists(pa.array(leading, pa.string()))]
                out: list[tuple] = []
                for d, x, h in zip(some.column("doc_id").to_pylist(), ids, heads):
                    out += packer.add((d, x), len(x) // 4, h)
                yield batch(out)
        yield batch(list(packer.close()))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep else "")
    prompt = F.col(prompt_chars).cast("int") if prompt_chars else F.lit(None).cast("int")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), prompt.alias("prompt")).mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packed(docs, P.path("byte_bpe_50k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)
