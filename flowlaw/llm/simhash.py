"""Operator 7, SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits wide. Two of them that differ in at most three bits differ in at most one
bit of the lower 31 or of the next 31 bits (the two bits left over cannot bring them nearer). The
codewords of the Hamming code of length 31 are the anchors of either part: every word lies within
one bit of exactly one codeword. A fingerprint goes to every anchor within the covering radius
plus the part's threshold (1 + 1 bits), sixteen anchors at most a part, so that two fingerprints
one bit apart always meet, and are compared in full there.

Only different fingerprints are compared; equal texts and equal fingerprints are linked by their
value. One shuffle brings an anchor's fingerprints together, and of these only such go on as lie near
another one there; the more fingerprints there are, the more meet by chance, and those would grow with their
square. A place with many fingerprints is cut into blocks that are compared by themselves, each row once. What that
joins is one; only places where rows of several groups are left have these compared across their blocks. A task returns a
path through each group that it finds, not all pairs. The groups are then joined by contraction rounds over the links, which
never leave the executors. A part has 2^26 anchors; a thousand million fingerprints put some 240 at each.

Near copies of a wider kind (near_copies) are judged by a longer fingerprint of their five-word shingles, whose differing bits
tell how many they share. They meet by bands of least hashes of these shingles, so that texts without a common shingle never do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Fingerprints that one block of an anchor holds.
BLOCK = 4096
#: Shingles whose bits are summed at once.
CHUNK = 1 << 16
#: Anchors of up to so many fingerprints are searched for near ones where they meet; all of larger ones go on.
SHORT = 256
#: Bands by which near copies meet, each of so many least hashes, and fingerprints by which they are judged.
BANDS, LEAST, JUDGE = 16, 3, 4
#: What makes other orders of the same hashes.
ORDERS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * LEAST, np.uint64) << np.uint64(1) | np.uint64(1)
#: Differing bits of the 256 that two texts with four fifths of their shingles in common have, 39 on average, and a little more.
NEAR = 46


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of a text: the majority of the bits of its shingles' XXH64."""
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = map(" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return int(majority(np.fromiter((digest(s, 42) for s in shingles), np.uint64)))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and print, the fingerprint as a signed long. Needs doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lambda b: _sign(b, width), f"doc_id {kind}, print long")


def _syndromes() -> np.ndarray:
    """Of each byte at each of four places of a 31-bit word: the XOR of the places, from 1, of its ones."""
    out = np.zeros((4, 256), np.uint8)
    for place in range(31):
        byte, bit = divmod(place, 8)
        out[byte, (np.arange(256) >> bit & 1) == 1] ^= place + 1
    return out


SYNDROMES = _syndromes()


def anchors(part: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, codewords) pairs: every Hamming codeword within two bits of each 31-bit word.

    Flipping place i and place j makes a codeword where i XOR j (from 1) is the syndrome, so a
    word that is no codeword has one at one bit and fifteen at two bits; a codeword only itself.
    """
    s = np.zeros(len(part), np.uint8)
    for byte in range(4):
        s ^= SYNDROMES[byte, (part >> np.uint64(8 * byte) & np.uint64(255)).astype(np.uint8)]
    bit = lambda place: np.where(place > 0, np.uint64(1) << (place.astype(np.uint64) - np.uint64(1)) * (place > 0), np.uint64(0))
    out = [(np.arange(len(part)), part ^ bit(s))]
    for i in range(1, 32):
        j = s ^ np.uint8(i)
        rows = np.flatnonzero((s > 0) & (j > i))
        out.append((rows, part[rows] ^ bit(np.full(len(rows), i, np.uint8)) ^ bit(j[rows])))
    return out


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor and node for each node, the first column, and each part of the fingerprints in the others."""
    for batch in batches:
        node = batch.column(0).to_numpy(zero_copy_only=False)
        for c in range(1, batch.num_columns):
            prints = batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(2):
                part = np.uint64(2 * (c - 1) + k)
                for rows, words in anchors(prints >> np.uint64(31 * k) & np.uint64((1 << 31) - 1)):
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array((words | part << np.uint64(31)).view(np.int64)), pa.array(node[rows])], ["anchor", "node"])


def _meeting(batches: Iterator[pa.RecordBatch], threshold: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor those that share it with another one; with a threshold, nodes are fingerprints and share it with one that near.

    Rows of an anchor that goes on in the next batch are held back, SHORT of them at most; anchors of more go on whole.
    """
    held: tuple[np.ndarray, np.ndarray] | None = None
    large = None  # an anchor that rows have gone on of before it ended
    for batch in batches:
        anchor, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(anchor):
            continue
        if held is not None:
            anchor, node = np.concatenate([held[0], anchor]), np.concatenate([held[1], node])
        end = int(np.searchsorted(anchor, anchor[-1]))  # where the last anchor begins
        open_ = len(anchor) - end <= SHORT and anchor[-1] != large
        keep = _near_another(anchor, node, threshold)
        if large is not None:
            keep |= anchor == large
        if not open_:
            large, end = anchor[-1], len(anchor)
        held = (anchor[end:], node[end:]) if end < len(anchor) else None
        yield pa.RecordBatch.from_arrays([pa.array(anchor[:end][keep[:end]]), pa.array(node[:end][keep[:end]])], ["anchor", "node"])
    if held is not None:
        keep = _near_another(*held, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(held[0][keep]), pa.array(held[1][keep])], ["anchor", "node"])


def _near_another(anchor: np.ndarray, node: np.ndarray, threshold: int | None) -> np.ndarray:
    """Which of the rows, sorted by anchor, share it with another one, or with one within the threshold, or with over SHORT."""
    keep = np.zeros(len(anchor), bool)
    here = np.arange(len(anchor) - 1)
    for step in range(1, SHORT + 1):
        here = here[: np.searchsorted(here, len(anchor) - step)]
        here = here[anchor[here] == anchor[here + step]]
        if not len(here):
            return keep
        near = here if threshold is None else here[np.bitwise_count(node[here].view(np.uint64) ^ node[here + step].view(np.uint64)) <= threshold]
        keep[near] = keep[near + step] = True
        if threshold is None:
            return keep
    first = np.searchsorted(anchor, np.unique(anchor[here]))
    for lo, hi in zip(first, np.searchsorted(anchor, anchor[first], "right")):
        keep[lo:hi] = True
    return keep


def _roots(links: list[tuple[int, int]], n: int) -> np.ndarray:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64)


def compare(nodes: np.ndarray, prints: np.ndarray, threshold: int) -> np.ndarray:
    """Links (two nodes each) that connect what fingerprints (rows of longs) within the threshold connect."""
    n = len(nodes)
    if n < 2:
        return np.empty((0, 2), np.int64)
    label = np.arange(n)
    step = max(1, (1 << 20) // n)
    bits = np.ascontiguousarray(prints).view(np.uint64)
    for i in range(0, n, step):
        apart = sum(np.bitwise_count(bits[i : i + step, None, k] ^ bits[None, :, k]).astype(np.uint16) for k in range(bits.shape[1]))
        a, b = np.nonzero(apart <= threshold)
        a += i
        fresh = (a < b) & (label[a] != label[b])  # most pairs of a group are connected already
        if fresh.any():
            pairs = np.unique(np.stack([label[a[fresh]], label[b[fresh]]], 1), axis=0)
            label = _roots(pairs.tolist(), n)[label]
    order = np.lexsort((nodes, label))
    same = label[order][1:] == label[order][:-1]
    return np.stack([nodes[order][:-1][same], nodes[order][1:][same]], 1)


def _compare_groups(frames: Iterator[pd.DataFrame], columns: list[str], threshold: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (anchor, block); a group may go on in the next frame."""
    rest: pd.DataFrame | None = None

    def done(pdf: pd.DataFrame) -> list[np.ndarray]:
        key = pdf[["anchor", "block"]].to_numpy()
        ends = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        return [compare(x, p, threshold) for x, p in zip(np.split(pdf["node"].to_numpy(), ends), np.split(pdf[columns].to_numpy(), ends)) if len(x) > 1]

    def out(found: list[np.ndarray]) -> pd.DataFrame:
        links = np.concatenate([np.empty((0, 2), np.int64), *found])
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf])
        last = (pdf["anchor"] == pdf["anchor"].iloc[-1]) & (pdf["block"] == pdf["block"].iloc[-1])
        rest, pdf = pdf[last], pdf[~last]
        if len(pdf):
            yield out(done(pdf))
    if rest is not None:
        yield out(done(rest))


def meetings(placed: DataFrame, threshold: int | None = None) -> DataFrame:
    """The rows of placed, anchor and node (longs), that share their anchor with another one; with a threshold, as _meeting() has it."""
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(tasks, "anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(lambda b: _meeting(b, threshold), "anchor long, node long")


def _linked(dealt: DataFrame, columns: list[str], threshold: int) -> DataFrame:
    """Links a, b inside each block of each anchor."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.repartition(n, "anchor", "block").sortWithinPartitions("anchor", "block")
    return rows.mapInPandas(lambda it: _compare_groups(it, columns, threshold), "a long, b long").distinct()


def compared(met: DataFrame, columns: list[str], threshold: int, block: int = BLOCK) -> DataFrame:
    """Links a, b that connect all nodes which meet at an anchor and are within the threshold there; columns of met are the fingerprint.

    Each block is compared by itself first. What rows are left in other groups than the anchor's largest are compared with each other and
    with that one's, in pairs of blocks; so rows grow with the square of what hangs together nowhere, not with that of a group.
    """
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    part = lambda n, *more: F.pmod(F.xxhash64("node", *more), blocks(n)).cast("int")
    sizes = met.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    fields = ["anchor", "node", *[c for c in columns if c != "node"]]
    # Blocks are drawn anew at each anchor, so that rows of one group meet others of it at the next.
    inside = cut(_linked(met.join(sizes, "anchor").select(*fields, part("n", F.col("anchor")).alias("block")), columns, threshold))
    large = sizes.filter(F.col("n") > block)
    if large.isEmpty():
        return inside
    rows = cut(met.join(large.select("anchor"), "anchor").join(components(inside), "node", "left").select(*fields, F.coalesce("root", "node").alias("root")))
    groups = rows.groupBy("anchor", "root").agg(F.count("*").alias("rows")).groupBy("anchor")
    groups = groups.agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.max("rows").alias("mains"), (F.sum("rows") - F.max("rows")).alias("others")).filter("others > 0")
    o, m = blocks("others"), blocks("mains")
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    # Blocks i and j of the others are the pair (i, j) of the smaller and the larger one; i and block j of the main group come behind these.
    own = F.when(F.col("root") == F.col("main"), part("mains")).otherwise(part("others"))
    pairs = upto(o, lambda j: F.least("own", j) * o + F.greatest("own", j))
    pairs = F.when(F.col("root") == F.col("main"), upto(o, lambda i: o * o + i * m + F.col("own"))).otherwise(F.concat(pairs, upto(m, lambda j: o * o + F.col("own") * m + j)))
    across = rows.join(groups, "anchor").withColumn("own", own).select(*fields, F.explode(pairs).alias("block"))
    return inside.union(_linked(across, columns, threshold)).distinct()


def links(prints: DataFrame, threshold: int = 3, block: int = BLOCK) -> DataFrame:
    """Links a, b between different fingerprints (column print) which connect all that lie within the threshold (3 at most)."""
    if not 0 <= threshold <= 3:
        raise ValueError("threshold must be 0 to 3")
    one = prints.select("print").distinct()
    placed = one.select("print", F.col("print").alias("word")).mapInArrow(_cover, "anchor long, node long")
    return compared(cut(meetings(placed, threshold)), ["node"], threshold, block)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the links a, b: equal roots where links connect.

    Each round sends every node to the neighbour (or itself) that comes first in an order drawn anew
    for the round, and contracts the links; a constant share of the nodes goes each round.
    """
    edges = cut(edges.select("a", "b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        order = F.xxhash64("to", F.lit(len(steps)))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        own = both.select("node", F.col("node").alias("to"))
        up = cut(both.union(own).groupBy("node").agg(F.min_by("to", F.struct(order, F.col("to"))).alias("up")))
        steps.append(up)
        to = lambda old, new: up.select(F.col("node").alias(old), F.col("up").alias(new))
        edges = cut(edges.join(to("a", "c"), "a").join(to("b", "d"), "b").filter("c != d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[-1].select("node", F.col("up").alias("root"))
    for up in reversed(steps[:-1]):
        found = cut(up.join(found.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    return found


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 3) -> DataFrame:
    """doc_id, print and component_id, the smallest doc_id that links reach, for each document.

    docs: doc_id and text; other columns are not read. A null text is an empty one; texts without a
    word have the fingerprint zero and link like others. A null doc_id gets a row too, but is no
    component_id unless its component has no other. Repeated rows are kept, texts of any length taken whole. No rows: no rows.
    """
    signed = cut(fingerprints(docs, width))
    first = signed.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = components(links(first, threshold))
    linked = first.join(roots.withColumnRenamed("node", "print"), "print")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("print", "least")
    # Written, so that the last join deals out both sides anew and a print of very many rows can be split.
    ids = cut(first.join(named, "print", "left").select("print", F.coalesce("least", "first").alias("component_id")))
    return signed.join(ids, "print").select("doc_id", "print", "component_id")


def sketch(text: str | None, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys and JUDGE fingerprints of a text's different shingles; repeats don't count."""
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return np.zeros(BANDS, np.uint64), np.zeros(JUDGE, np.uint64)
    spans = set(map(" ".join, zip(*(words[i:] for i in range(width))))) if len(words) > width else {" ".join(words)}
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, 5) for x in spans), np.uint64, len(spans))
    least = np.min([(hashes[i : i + CHUNK // 16, None] * ORDERS).min(0) for i in range(0, len(hashes), CHUNK // 16)], 0).reshape(BANDS, LEAST)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(LEAST):
        keys = (keys ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    prints = np.empty(JUDGE, np.uint64)
    for k in range(JUDGE):  # other fingerprints come from the same hashes, multiplied and folded
        mixed = hashes * np.uint64(2 * (0x9E3779B97F4A7C15 >> k + 1) + 1)
        prints[k] = majority(mixed ^ mixed >> np.uint64(32))
    return keys, prints


def _sketched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [sketch(t, width) for t in batch.column(1).to_pylist()]
        bands = np.array([r[0] for r in rows], np.uint64).reshape(-1, BANDS).view(np.int64)
        judge = np.array([r[1] for r in rows], np.uint64).reshape(-1, JUDGE).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
        columns = [batch.column(0), lists, *(pa.array(np.ascontiguousarray(judge[:, k])) for k in range(JUDGE))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "bands", *(f"j{k}" for k in range(JUDGE))])


def near_copies(docs: DataFrame, width: int = 5, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links reach, for each document with a doc_id.

    Two texts are linked if they meet in a band and their shingles' fingerprints differ in at most near of
    256 bits. The default stands for a similarity (common part of the different shingles) of 0.8; at just that, nine pairs of ten
    are found, above 0.9 all but a few in a hundred. Null and empty texts are alike. Equal texts are linked whatever their number:
    they have one sketch, which is placed once. Texts of any length are taken whole. Repeated rows get rows of their own; rows without a doc_id none. No rows: none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    judge = [f"j{k}" for k in range(JUDGE)]
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", text_or_empty().alias("text"))
    signed = cut(texts.mapInArrow(lambda b: _sketched(b, width), f"doc_id {kind}, bands array<long>, {', '.join(f'{c} long' for c in judge)}"))
    # A whole sketch is a node; its number is written once and so stays what it is.
    first = cut(signed.groupBy("bands", *judge).agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    met = meetings(first.select(F.explode("bands").alias("anchor"), "node"))
    judged = cut(met.join(first.select("node", *judge), "node").select("anchor", "node", *judge))
    roots = components(compared(judged, judge, near, block))
    linked = first.select("node", "first").join(roots, "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    ids = cut(first.select("node", "first").join(linked.join(least, "root").select("node", "least"), "node", "left").select("node", F.coalesce("least", "first").alias("component_id")))
    named = first.select("bands", *judge, "node").join(ids, "node").drop("node")
    return signed.join(named, ["bands", *judge]).select("doc_id", "component_id")


def keep_first(docs: DataFrame, width: int = 5, near: int = NEAR) -> DataFrame:
    """docs less all but one document of each group of near copies: that with the smallest doc_id. Columns keep their order.

    Rows that share a doc_id are one document: they stay or go together, and go if any of their texts has a
    smaller near copy. Rows without a doc_id stay, as nothing names them. Null and empty texts are copies of each other.
    """
    found = near_copies(docs, width, near).filter(F.col("doc_id") > F.col("component_id"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
