"""The trie against sequences of turns held in dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlaw.llm import oracles, queries, trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, k1 string, part double"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = own.get(family, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        saved[key] = (len(members[key]) - 1) * words + sum(saved[k] for k in children[key])
        leaves[key] = sum(leaves[k] for k in children[key]) if children[key] else 1
    out = []
    for key, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, last in who if last))
        up = min(c for c, _ in members[key[:-1]]) if key else None
        out.append((min(c for c, _ in who), len(key), up, len(who), len(children[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def listed(found):
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


def some(n, turns, words, seed, first=None):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(0, turns) or 1):
            out.append((c * 3 - 50, t, rng.choice(["user", "assistant"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 2))), 1, "k", 0.5))
    return out


def test_centroid_sums():
    rng = np.random.default_rng(5)
    for n, reach in ((0, 1), (1, 1), (7, 7), (400, 400), (400, 3), (2000, 40), (300, 1)):
        parent = np.array([-1 if i == 0 or rng.random() < 0.02 else int(rng.integers(max(0, i - reach), i)) for i in range(n)], np.int64)
        depth = np.zeros(n, np.int64)
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
        values = rng.integers(0, 10, (n, 2))
        want = values.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
        mixed = rng.permutation(n)
        place = np.empty(n, np.int64)
        place[mixed] = np.arange(n)
        moved = np.array([-1 if parent[i] < 0 else place[parent[i]] for i in mixed], np.int64)
        assert (trie.sums_above(moved, depth[mixed], values[mixed]) == want[mixed]).all()


@pytest.mark.parametrize("how", [{}, {"least": 3}, {"least": 3, "band": 2, "limit": 5}])
def test_random_conversations(spark, how):
    rows = some(60, 9, ["a", "b"], 1)
    assert listed(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), **how)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (0, None, None, None), (0, 1, "user", "hi there"), (0, 1, "user", "hi there"), (1, 0, "user", ""), (-7, 0, "user", "x"), (-7, 1, "user", "long " * 40000), (20, 5, "", ""), (20, 4, "a\nb", "c"), (23, 0, "user", "solo"), (2**61, 0, "user", "big")]
    rows = [(*r, 0, "", 0.0) for r in rows]
    assert listed(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_conversation_in_many_parts(spark):
    rows = [(40, t, "user", f"w{t % 3} x") for t in range(700)] + [(41 + c, t, "user", f"w{t % 3} x") for c in range(12) for t in range(5 + 3 * c)]
    rows = [(*r, 0, "", 0.0) for r in rows]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = trie.numbered(frame)
        assert sorted(r.pos for r in numbered.filter("conv_id = 40").collect()) == list(range(1, 701))
        parts = frame.select("conv_id", "turn").repartitionByRange("conv_id", "turn").filter("conv_id = 40").select(F.spark_partition_id()).distinct().count()
        assert parts > 1
        found = trie.conversation_trie(frame, least=20, band=8, limit=30)
        assert listed(found) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_and_sql_at_a_small_scale(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = listed(queries.op13_trie(spark, data))
    assert found == brute(rows)
    held = duckdb.connect()
    held.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    sql = held.execute(oracles.trie())
    names = [d[0] for d in sql.description]
    assert sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in sql.fetchall()), key=str) == found
