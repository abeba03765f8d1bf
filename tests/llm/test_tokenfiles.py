"""Token files against the library's ids of whole texts, one document after the other."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlaw.llm import queries, tokenfiles, tokens

from .fixtures import empty, frame, rows

ODD = ["ä b", "x ̈y", "it's 's 'S don'T dogs' l'été", "Σ ΟΔΟΣ ΣΑΣ", "<|endoftext|>a <|ENDOFTEXT|> <|startoftext|>b", "\x1c a\x1fb\x85c\xa0d e", "ſs İI", "́ é é", "a‍b 👩‍👩‍👧 　x", "１２ ½ ²³ 12ab", "end,&&& (x) <a>", "Ключ, Ёлка!", "x" * 500 + ",", "漢字" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.word_bpe_49k())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_equal_the_library(library):
    coder = tokenfiles.Words(tokens.word_bpe_49k())
    for text in [*ODD, *ODD, *(r[1] or "" for r in rows())]:
        assert np.frombuffer(coder.encode(text), coder.kind).tolist() == ids_of(library, text)[:-1], text


def test_memo_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "MEMO", 3)
    coder = tokenfiles.Words(tokens.word_bpe_49k())
    assert np.frombuffer(coder.encode("a b c d e f a b"), coder.kind).tolist() == ids_of(library, "a b c d e f a b")[:-1] and len(coder.memo) <= 3


def check(found, texts, library):
    """found in file order: starts are gapless, doc_ids ascend with nulls first, and each document's ids are those of one of its texts."""
    found = sorted(found, key=lambda r: r.start)
    at, left = 0, sorted(((d is not None, d or 0), tuple(ids_of(library, t))) for d, t in texts)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in found] == [k for k, _ in left]
    for r in found:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert sorted(((r.doc_id is not None, r.doc_id or 0), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found) == left


def test_round_trip(spark, library):
    docs = frame(spark)
    index = tokenfiles.write(docs, tokens.word_bpe_49k(), 2)
    check(tokenfiles.documents(index, block=3).collect(), [(r[0], r[1]) for r in rows()], library)
    for r in index.collect():  # plain files that numpy maps
        flat = np.memmap(f"{r.path.removeprefix('file://')}.ids", f"<u{r.width}", "r")
        offsets = np.memmap(f"{r.path.removeprefix('file://')}.offsets", "<u8", "r")
        assert r.width == 2 and len(flat) == r.ids == offsets[-1] and len(offsets) == r.docs + 1 and flat[-1] == 2
    assert tokenfiles.documents(tokenfiles.write(empty(spark), tokens.word_bpe_49k(), 2)).count() == 0


def test_one_doc_id_in_most_rows_is_spread(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    index = tokenfiles.write(docs.repartition(4), tokens.word_bpe_49k(), 2)
    sizes = [r.docs for r in index.collect()]
    assert sum(sizes) == 4000 and (len(sizes) == 1 or max(sizes) < 2 * 4000 / len(sizes))


def test_own_folder(spark, tmp_path):
    index = tokenfiles.write(spark.createDataFrame([(1, "a")], "doc_id int, text string"), tokens.word_bpe_49k(), 2, home=f"file://{tmp_path}/shards")
    assert sorted(os.listdir(f"{tmp_path}/shards"))[0].endswith(".docs") and index.first().path.startswith(f"file://{tmp_path}/shards/")


def test_query_at_a_small_scale(spark, data, library):
    found = {r.doc_id: r for r in queries.op11_tokens(spark, data).collect()}
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for d in sorted(texts):
        ids = np.array(ids_of(library, texts[d]), "<u4")
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(texts)
