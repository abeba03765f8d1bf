"""Operator 3, packing documents into sequences by best-fit decreasing.

A document's token ids are cut into full windows, which are sequences of their own, and one rest.
Rests are dealt by a hash into groups of a bounded number; a task packs its group's rests, longest
first, each into the open window with the least room that still holds it. A segment tree over the
remaining capacities finds that window. Only lengths and checksums are shuffled, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .tokens import Tokens

WINDOW = 2048
#: The id after each document.
END = 1
#: Pieces that a group is meant to hold.
GROUP = 50_000


class OpenWindows:
    """Windows by remaining capacity: a segment tree whose leaves are capacities, counting the windows at each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, leaf: int, n: int) -> None:
        i = leaf + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, window: int, room: int) -> None:
        if room:
            self.at[room].append(window)
            if len(self.at[room]) == 1:
                self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least length, and that room."""
        i = length + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        window = self.at[room].pop()
        if not self.at[room]:
            self._add(room, -1)
        return window, room


def best_fit(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each length, windows from 0; lengths are placed longest first, equal ones in order."""
    windows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_, made = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = open_.take(n)
        if found is None:
            found = made, capacity
            made += 1
        window, room = found
        windows[i], offsets[i] = window, capacity - room
        open_.put(window, room - n)
    return windows, offsets


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    tokens = Tokens(path)
    end = np.array([END], "<u4").tobytes()
    for batch in batches:
        source, start, length, crc, total = [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            ids = tokens.encode(text).tobytes() + end
            n = len(ids) >> 2
            for at in range(0, n, window):
                piece = ids[4 * at : 4 * (at + window)]
                source.append(row)
                start.append(at)
                length.append(len(piece) >> 2)
                crc.append(zlib.crc32(piece))
                total.append(n)
        longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every window and rest of the documents' ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lambda b: _pieces(b, tokenizer, window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def _pack(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "mark"], kind="stable", ascending=[False, True])
        at, offset = best_fit(pdf["length"].to_numpy(), window)
        return pdf.assign(sequence_id=pdf["bucket"] * (1 << 32) + at, offset=offset).drop(columns=["bucket", "mark"])

    rest: pd.DataFrame | None = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf])
        last = pdf["bucket"] == pdf["bucket"].iloc[-1]
        rest = pdf[last]
        for _, part in pdf[~last].groupby("bucket", sort=False):
            yield group(part)
    if rest is not None:
        yield group(rest)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, size: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset: which sequence of at most window ids holds them, and where.

    docs: doc_id and text. A null text is empty and becomes the one id that ends a document. Repeated
    rows and null ids are packed like others, texts of any length cut into full sequences and a rest, other columns not read. tokenizer is the path of the vocabulary. No rows: no pieces.
    """
    found = cut(pieces(docs, tokenizer, window))
    n = found.count()
    groups = max(1, -(-n // size))
    # Pieces of one document may meet in any group, and so may repeated rows, however many: each written row has a number of its own.
    mark = F.xxhash64("doc_id", "start", "length", "ids_crc32")
    own = F.xxhash64("mark", F.monotonically_increasing_id(), F.lit(3))
    dealt = found.withColumn("mark", mark).withColumn("bucket", F.pmod(own, F.lit(groups)).cast("long"))
    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInPandas(lambda it: _pack(it, window), schema)
