"""Operator 11, token ids in flat binary files.

Documents are put in ascending order of doc_id by ranges. Each task encodes its range and writes one
shard as it reads: a flat file of unsigned ids, one of 64-bit offsets, one of document ids. Every shard's
base, the number of ids in all shards before it, is a prefix sum over a table of one row a shard. Readers map
the files into memory and take the documents they are asked for.

A shard's name holds its task's attempt, and only the attempt that Spark commits is in the index, so
tasks may fail and run again at any time.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, folder, text_or_empty
from .tokens import byte_names

#: Words that a worker remembers, and their longest.
MEMO, LONGEST = 1 << 19, 64
#: Documents that a reading task takes at a time, and ids that go out together.
BLOCK, HELD = 4096, 1 << 22
#: A run of letters whose lower case and composition no version of Unicode changes, and ASCII signs behind it.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿА-яЁё]+)([!-/:;=-@\[-`{-~]*)")


class Words:
    """The ids that a vocabulary file of the tokenizers library gives whole texts, if it splits at white space and drops that.

    White space of ASCII never lies inside a token there, so a text's ids are its chunks' ids one after the other, and a
    chunk that comes again is looked up. A chunk of plain letters and signs goes to the file's own pair merges at once; any other to the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.whole = Tokenizer.from_file(path)
        self.model, self.memo = self.whole.model, {}
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.names = {b: c for c, b in byte_names().items()}

    def _plain(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text.encode().decode("latin1").translate(self.names))]

    def _ids(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        found = PLAIN.fullmatch(text)
        if found and len(chunk) <= LONGEST:
            ids = self._plain(found[1].lower()) + (self._plain(found[2]) if found[2] else [])
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as bytes, little-endian, each of the size of kind."""
        chunks, memo, out = text.encode().split(), self.memo, []
        for chunk in chunks:
            ids = memo.get(chunk)
            if ids is None:
                ids = self._ids(chunk)
                if len(chunk) <= LONGEST:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[chunk] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    return Words(path)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@contextmanager
def _mapped(path: str) -> Iterator[str]:
    """A local name of a shard's file: its own where the store is a file system, else that of a copy for as long as it is read."""
    store, name = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        yield name
        return
    with tempfile.TemporaryDirectory() as near:
        fs.copy_files(name, f"{near}/file", source_filesystem=store)
        yield f"{near}/file"


def _write(batches: Iterator[pa.RecordBatch], home: str, vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    coder, task = words(vocabulary), TaskContext.get()
    closing = np.array([end], coder.kind).tobytes()
    path, sinks = f"{home}/shard-{task.partitionId():06d}-{task.taskAttemptId()}", None
    docs = nulls = ids = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if sinks is None:
            store, name = _store(path)
            store.create_dir(home if "://" not in home else _store(home)[1], recursive=True)
            sinks = [store.open_output_stream(f"{name}.{kind}") for kind in ("ids", "offsets", "docs")]
            sinks[1].write(np.zeros(1, "<u8").tobytes())
        coded = [coder.encode(t) + closing for t in batch.column(1).to_pylist()]
        ends = ids + np.cumsum([len(c) // coder.kind.itemsize for c in coded])
        for sink, data in zip(sinks, (b"".join(coded), ends.astype("<u8").tobytes(), np.array([d or 0 for d in batch.column(0).to_pylist()], "<i8").tobytes())):
            sink.write(data)
        docs, nulls, ids = docs + batch.num_rows, nulls + batch.column(0).null_count, int(ends[-1])
    if sinks is not None:
        for sink in sinks:
            sink.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [path], "docs": [docs], "nulls": [nulls], "ids": [ids], "width": pa.array([coder.kind.itemsize], pa.int32())})


def write(docs: DataFrame, vocabulary: str, end: int, home: str | None = None) -> DataFrame:
    """The index of the shards that hold the ids of docs (doc_id, a whole number, and text), each closed by the id end.

    Columns: shard, path (of three files), docs, nulls, ids, width (bytes an id) and base (ids in all shards before), a row a shard.
    home is the folder for them, which all executors see; by default one of the application, removed at its end. Documents lie in
    ascending order of doc_id, those without one first; documents of one doc_id in an order of their texts. Null texts are empty and hold the closing id
    only. Texts of any length are encoded whole, repeated rows are documents of their own and spread over shards, other columns are not read. No rows: no shards.
    """
    home = home or f"{folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    # Rows of one doc_id, and repeated rows, may be many: a hash and a number of their own let ranges end between them.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("_mark", F.xxhash64("text")).withColumn("_own", F.monotonically_increasing_id())
    order = ["doc_id", "_mark", "_own"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = cut(sorted_.mapInArrow(lambda b: _write(b, home, vocabulary, end), "shard int, path string, docs long, nulls long, ids long, width int"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return cut(shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))))


def _read(frames: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for row in pdf.itertuples(index=False):
            with _mapped(f"{row.path}.offsets") as offsets, _mapped(f"{row.path}.docs") as docs, _mapped(f"{row.path}.ids") as ids:
                at = np.memmap(offsets, "<u8", "r")[row.first : row.first + block + 1].astype(np.int64)
                names = np.memmap(docs, "<i8", "r")[row.first : row.first + block]
                flat = np.memmap(ids, f"<u{row.width}", "r")
                i = 0
                while i < len(names):
                    j = max(i + 1, int(np.searchsorted(at, at[i] + HELD, "right")) - 1)
                    part = flat[at[i] : at[j]].astype("<u4")
                    known = [None if row.first + k < row.nulls else int(names[k]) for k in range(i, j)]
                    held = [part[a - at[i] : b - at[i]].tobytes() for a, b in zip(at[i:j], at[i + 1 : j + 1])]
                    yield pd.DataFrame({"doc_id": pd.array(known, "Int64"), "start": row.base + at[i:j], "n_tokens": np.diff(at[i : j + 1]), "ids": held})
                    i = j


def documents(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32-bit, little-endian) of each document in the shards of an index.

    A task maps the files and takes a block of documents after the other. An index without shards gives no rows.
    """
    blocks = index.select("path", "nulls", "width", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(block).cast("long"))).alias("first"))
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, "path", "first").mapInPandas(lambda it: _read(it, block), "doc_id long, start long, n_tokens long, ids binary")
