"""Operator 10, quality rules by repetition coverage.

A text's words become numbers, and rolling hashes of several n-gram lengths run over them in numpy.
Windows whose hash occurs twice are marked, and each rule measures how many of the words'
characters lie inside marked windows, or inside lines that repeat an earlier line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]+")
#: For each n-gram length, the percentage of characters inside repeated n-grams at which a text fails.
LIMITS = {5: 25, 6: 24, 8: 22, 10: 20}
#: The percentages of characters and of lines inside repeated lines at which a text fails.
LINE_CHARS, LINES = 30, 40
FACTOR = np.array([0x9E3779B97F4A7C15], np.uint64)
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n ids, modulo 2^64, by doubling: a window is a half, shifted, and the other half."""
    hashes, width, power = {1: ids}, 1, {1: FACTOR}
    while 2 * width <= n:
        h = hashes[width]
        hashes[2 * width] = h[:-width] * power[width] + h[width:] if len(h) > width else h[:0]
        power[2 * width] = power[width] * power[width]
        width *= 2
    out, have = hashes[width], width
    for w in sorted(hashes, reverse=True)[1:]:
        if n - have >= w:
            keep = max(len(ids) - have - w + 1, 0)
            out = out[:keep] * power[w] + hashes[w][have : have + keep]
            have += w
    return out


def repeated(ids: np.ndarray, n: int) -> np.ndarray:
    """Which ids lie in a window of n that occurs twice or more. Equal hashes are checked against the ids."""
    marked = np.zeros(len(ids), bool)
    if len(ids) < n:
        return marked
    hashes = rolling(ids, n)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return marked
    pairs = np.flatnonzero(same)
    twin = np.ones(len(pairs), bool)
    for k in range(n):
        twin &= ids[order[pairs] + k] == ids[order[pairs + 1] + k]
    starts = np.concatenate([order[pairs[twin]], order[pairs[twin] + 1]])
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str) -> tuple[tuple[int, ...], dict[int, int], int, int, int]:
    """The counts in NAMES, characters inside repeated n-grams by length, and characters, number and total of lines for the line rules."""
    words = WORDS.findall(text)
    if not words:
        return (0, 0, sum(map(len, SYMBOLS.findall(text))), 0, 0), dict.fromkeys(LIMITS, 0), 0, 0, 0
    number: dict[str, int] = {}
    plain = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    ids = (plain + np.uint64(1)) * FACTOR
    ids ^= ids >> np.uint64(29)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    marks = {n: repeated(ids, n) for n in sorted({5, *LIMITS})}
    covered = {n: int(sizes[marks[n]].sum()) for n in LIMITS}
    seen: set[str] = set()
    lines = twice = chars = 0
    for line in text.split("\n"):
        if not line or not WORDS.search(line):
            continue
        lines += 1
        if line in seen:
            twice += 1
            chars += sum(map(len, WORDS.findall(line)))
        seen.add(line)
    return (len(words), int(sizes.sum()), sum(map(len, SYMBOLS.findall(text))), twice, int(marks[5].sum())), covered, chars, twice, lines


def judge(text: str) -> tuple[tuple[int, ...], bool, bool, float]:
    """The counts, base_failed, kept, and the largest share of characters inside repeated n-grams."""
    counts, covered, chars, twice, lines = measure(text)
    words, total, _, _, repeats = counts
    failed = words < 10 or 100 * repeats > 20 * words
    bad = any(100 * covered[n] > most * total for n, most in LIMITS.items()) or 100 * chars > LINE_CHARS * total or 100 * twice > LINES * lines
    return counts, failed, not failed and not bad, max(covered.values()) / total if total else 0.0


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [judge(t) for t in batch.column(1).to_pylist()]
        columns = [pa.array([x[0][k] for x in found], pa.int64()) for k in range(len(NAMES))]
        columns += [pa.array([x[1] for x in found], pa.bool_()), pa.array([x[2] for x in found], pa.bool_()), pa.array([x[3] for x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *NAMES, "base_failed", "kept", "coverage"])


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts in NAMES, base_failed, kept and coverage for each document; one pass, no shuffle.

    docs: doc_id and text. A null text has no words and fails. Rows are judged one by one, so repeated
    rows, null ids and ties need no care; a line repeats an earlier one only if all its characters do. Texts of any length are judged whole, other columns are not read. No rows: no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_rules, f"doc_id {kind}, {', '.join(f'{n} long' for n in NAMES)}, base_failed boolean, kept boolean, coverage double")
