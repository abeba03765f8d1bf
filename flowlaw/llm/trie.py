"""Operator 13, a prefix trie of conversations, rolled up by centroid decomposition.

Turns are sorted by ranges of (conversation, turn), so a conversation may hold any share of all rows. A
task numbers its turns and hashes each prefix of them as it reads; what lies before a task's first conversation comes
from the ends of earlier tasks, two rows a task. A node is the hash of a prefix: four sums of hashed turns
weighted by powers, modulo a prime, so that prefixes of one conversation and turns of another are put together by arithmetic.

Sums over subtrees come from the forest of parent edges. It is cut first where subtrees are known to be small:
the rows of a node's members below it, counted with the node, bound its subtree. Each small subtree, and each band of the
rest, is taken apart by centroids in one task: the centroid of a component is found, the totals of what hangs below it are
put together and added to every node on the path from the centroid to the component's top, and the components that are left, at most half as
large, go on in the same way. Bands hang together as a tree again, which is rolled up first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut

#: The modulus, four bases (fixed, below it) and their inverses.
PRIME = (1 << 31) - 1
BASES = (1_186_530_703, 906_180_247, 1_501_990_571, 387_276_917)
#: Conversations take at most this many turns less one from the first of their family of twenty.
HEAD, FAMILY = 4, 20
#: Rows below a node that make its subtree small, at least; depths in a band; nodes that one task rolls up; nodes taken together.
LEAST, BAND, LIMIT, CHUNK = 1 << 11, 64, 1 << 20, 200_000
KEY = ("depth", "k1", "k2")
UP = ("depth", "p1", "p2")


def sums_above(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums of values (a row a node) over each node's subtree in a forest, by centroid decomposition of all its trees at once.

    parent: the place of each node's parent, -1 for tops. depth: any numbers that are larger for children.
    """
    n, out = len(parent), np.zeros_like(values)
    layers = np.split(order := np.argsort(depth, kind="stable"), np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    up, size = parent.copy(), np.ones(n, np.int64)  # up: the parent inside the component
    for layer in reversed(layers):
        has = layer[up[layer] >= 0]
        np.add.at(size, up[has], size[has])
    alive = np.ones(n, bool)
    while alive.any():
        # Each node's top, from above; then the component's size, which is its top's.
        top = np.arange(n)
        for layer in layers:
            inner = layer[up[layer] >= 0]
            top[inner] = top[up[inner]]
        live = np.flatnonzero(alive)
        # The nodes with half of their component or more below them are a path; its lowest node is the centroid.
        heavy = live[2 * size[live] >= size[top[live]]]
        heavy = heavy[np.lexsort((size[heavy], top[heavy]))]
        centre = heavy[np.append(True, top[heavy][1:] != top[heavy][:-1])]
        # What hangs below a centroid: itself and the components that start at its children. Their totals are the subtree's.
        below = np.full(n, -1)
        below[centre] = centre
        for layer in layers:
            inner = layer[(up[layer] >= 0) & (below[layer] < 0)]
            below[inner] = below[up[inner]]
        hung = live[below[live] >= 0]
        total = np.zeros_like(values)
        np.add.at(total, below[hung], values[hung])
        weight = size[centre].copy()
        at, carried, own = centre, total[centre], np.ones(len(centre), bool)
        while len(at):  # along the path to the top
            out[at] += carried
            size[at[~own]] -= weight[~own]
            on = up[at] >= 0
            at, carried, weight = up[at[on]], carried[on], weight[on]
            own = np.zeros(len(at), bool)
        alive[centre] = False
        cut_off = live[(up[live] >= 0) & ~alive[up[live]]]
        up[cut_off] = -1
        up[centre] = -1
    return out


def _lanes(h1: Column, h2: Column) -> Column:
    """Four numbers below the modulus from two hashes."""
    low = lambda h: h.bitwiseAND(F.lit((1 << 30) - 1))
    return F.array(low(h1), low(F.shiftright(h1, 30)), low(h2), low(F.shiftright(h2, 30)))


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by conversation: each gets its place in this task's part of it, and that part's hash so far."""
    part, last, j, held = TaskContext.get().partitionId(), None, 0, [0] * 4
    powers = [1] * 4
    for pdf in frames:
        place, hashes, scales = [], [], []
        for conv, lanes in zip(pdf["conv_id"].tolist(), pdf["lanes"].tolist()):
            if conv != last:
                last, j, held, powers = conv, 0, [0] * 4, [1] * 4
            j += 1
            held = [(h * a + int(t)) % PRIME for h, a, t in zip(held, BASES, lanes)]
            powers = [p * a % PRIME for p, a in zip(powers, BASES)]
            place.append(j)
            hashes.append(held)
            scales.append(powers)
        yield pdf.assign(part=part, place=place, chain=hashes, scale=scales)


def _ends(turns: DataFrame) -> tuple[list[tuple], int]:
    """For each part whose first conversation began in an earlier part: part, conv_id, its turns before, their hash and scale.

    Of each part only the first and last conversation can lie in others, too: two rows a part come to the driver.
    """
    pieces = turns.groupBy("part", "conv_id").agg(F.max("place").alias("n"), F.max_by("chain", "place").alias("chain"))
    edges = pieces.groupBy("part").agg(F.min(F.struct("conv_id", "n", "chain")).alias("first"), F.max(F.struct("conv_id", "n", "chain")).alias("last")).collect()
    out, open_ = [], None
    for r in sorted(edges, key=lambda r: r["part"]):
        first, end = r["first"], r["last"]
        if open_ and open_[0] == first["conv_id"]:
            scale = [pow(a, open_[1], PRIME) for a in BASES]
            out.append((r["part"], open_[0], open_[1], open_[2], scale))
            chain = [(b * pow(a, first["n"], PRIME) + c) % PRIME for a, b, c in zip(BASES, open_[2], first["chain"])]
            one = (open_[0], open_[1] + first["n"], chain)
        else:
            one = (first["conv_id"], first["n"], list(first["chain"]))
        open_ = one if first["conv_id"] == end["conv_id"] else (end["conv_id"], end["n"], list(end["chain"]))
    return out, len(edges)


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), lanes, words, and chain and scale (hash of the turns so far, and the bases to the power of pos)."""
    spark = rows.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    h1, h2 = F.xxhash64(role, text), F.xxhash64(F.lit("again"), text, role)
    # Turns of one number go by role and text, repeated rows by a number of their own, so that ranges may end between any two rows.
    named = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", h1.alias("h1"), h2.alias("h2"), _lanes(h1, h2).alias("lanes"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.substring(role, 1, 64).alias("_role"), F.substring(text, 1, 64).alias("_text"), F.monotonically_increasing_id().alias("own"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("h1"), F.col("own")]
    sorted_ = named.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "lanes", "words")
    turns = cut(sorted_.mapInPandas(_scan, "conv_id long, lanes array<long>, words long, part int, place long, chain array<long>, scale array<long>"))
    before, parts = _ends(turns)
    edges = F.broadcast(spark.createDataFrame(before, "part int, conv_id long, base long, chain0 array<long>, scale0 array<long>"))  # a row a part
    joined = turns.join(edges, ["part", "conv_id"], "left")
    whole = F.when(F.col("base").isNull(), F.col("chain")).otherwise(F.zip_with("chain", F.zip_with("scale", "chain0", lambda s, c: s * c), lambda a, b: (a + b) % PRIME))
    scale = F.when(F.col("base").isNull(), F.col("scale")).otherwise(F.zip_with("scale", "scale0", lambda a, b: a * b % PRIME))
    return joined.select("conv_id", (F.col("place") + F.coalesce("base", F.lit(0))).alias("pos"), "lanes", "words", whole.alias("chain"), scale.alias("scale"))


def _each(function, *arrays: Column) -> Column:
    """An array of four: function of the lane's number and of each array's entry."""
    return F.array(*[function(i, *[a[i] for a in arrays]) for i in range(4)])


def _key(chain: Column) -> list[Column]:
    return [chain[0] * F.lit(1 << 31) + chain[1], chain[2] * F.lit(1 << 31) + chain[3]]


def steps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that each rebuilt conversation passes below the root, and all conversations with their lengths.

    First: conv_id, depth, k1, k2 (the node), p1, p2 (its parent), left (turns to come) and words. A conversation is the first h turns of the
    first of its family of twenty, with h by its number's checksum, and its own turns after its first h.
    """
    turns = cut(numbered(rows))
    heads = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.collect_list(F.when(F.col("pos") < HEAD, F.struct("pos", "lanes", "words", "chain"))).alias("head"))  # three entries at most
    heads = heads.withColumn("head", F.sort_array("head"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    first = heads.select(F.col("conv_id").alias("family"), F.col("n").alias("n0"), F.col("head").alias("head0"))
    convs = heads.select("conv_id", "n", F.col("head").alias("own"), family.alias("family"), taken.alias("h")).join(first, "family", "left")
    convs = convs.withColumn("p", F.least(F.col("h").cast("long"), F.coalesce("n0", F.lit(0)))).withColumn("length", F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    nothing = F.array(*[F.lit(0).cast("long")] * 4)
    at = lambda head, k: F.when(k > 0, F.get(head, (k - 1).cast("int"))["chain"]).otherwise(nothing)
    mine = at(F.col("own"), F.least(F.col("h").cast("long"), F.col("n")))
    # Behind its head, a prefix's hash is that of the conversation's own turns, plus this, scaled, for head in place of its own first h.
    apart = _each(lambda i, x, y: (x - y + PRIME) % PRIME * F.element_at(F.array(*[F.lit(pow(BASES[i], -k, PRIME)) for k in range(HEAD)]), F.col("h") + 1) % PRIME, at(F.col("head0"), F.col("p")), mine)
    convs = cut(convs.select("conv_id", "h", "p", "length", "head0", apart.alias("apart")))
    own = turns.join(convs.select("conv_id", "h", "p", "length", "apart"), "conv_id").filter(F.col("pos") > F.col("h"))
    chain = _each(lambda i, c, s, a: (c + s * a) % PRIME, F.col("chain"), F.col("scale"), F.col("apart"))
    own = own.select("conv_id", (F.col("p") + F.col("pos") - F.col("h")).alias("depth"), "length", "lanes", "words", chain.alias("chain"))
    taken_rows = convs.filter("p > 0").select("conv_id", "length", F.explode(F.slice("head0", F.lit(1), F.col("p").cast("int"))).alias("t"))
    taken_rows = taken_rows.select("conv_id", F.col("t.pos").alias("depth"), "length", F.col("t.lanes").alias("lanes"), F.col("t.words").alias("words"), F.col("t.chain").alias("chain"))
    both = own.unionByName(taken_rows)
    above = _each(lambda i, c, t: (c - t + PRIME) % PRIME * F.lit(pow(BASES[i], -1, PRIME)) % PRIME, F.col("chain"), F.col("lanes"))
    k1, k2 = _key(F.col("chain"))
    p1, p2 = _key(F.col("_above"))
    named = both.withColumn("_above", above)
    return named.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), (F.col("length") - F.col("depth")).alias("left"), "words"), convs.select("conv_id", "length")


def nodes(passed: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node with its smallest member (conv_id), n_convs, reach (turns of its members below it) and words of its last text."""
    below = passed.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("left").alias("reach"), F.min("words").alias("words"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("length").alias("reach")).filter("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    return below.unionByName(root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "n_convs", "conv_id", "reach", zero.alias("words")))


def _tops(forest: DataFrame, top: Column) -> DataFrame:
    """forest with t0, t1, t2, the depth and key of the next node up, or the node itself, for which the condition top holds; pointers double."""
    above = F.col("depth") - 1
    spring = lambda own, up: F.when(top, own).otherwise(up)
    now = cut(forest.withColumns({"t0": spring(F.col("depth"), above), "t1": spring(F.col("k1"), F.col("p1")), "t2": spring(F.col("k2"), F.col("p2")), "_done": top | F.lit(False)}))
    done = now.filter("_done").count() == now.count()
    while not done:
        to = now.select(F.col("depth").alias("t0"), F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("t0").alias("u0"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("_done").alias("_there"))
        new = now.join(to, ["t0", "t1", "t2"]).drop("t0", "t1", "t2", "_done")
        new = new.withColumnsRenamed({"u0": "t0", "u1": "t1", "u2": "t2", "_there": "_done"})
        now = cut(new)
        done = now.filter("NOT _done").limit(1).count() == 0
    return now.drop("_done")


def _solve(forest: DataFrame, values: Sequence[str], fragment: Sequence[str]) -> DataFrame:
    """forest with values summed over subtrees inside its fragments, and up, the parent's conv_id where that is in the fragment."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        places = pd.Series(np.arange(len(pdf)), index=pd.MultiIndex.from_arrays([pdf[c].to_numpy() for c in KEY]))
        up = pd.MultiIndex.from_arrays([pdf["depth"].to_numpy() - 1, pdf["p1"].to_numpy(), pdf["p2"].to_numpy()])
        parent = places.reindex(up).fillna(-1).astype(np.int64).to_numpy()
        names = pdf[list(fragment)].to_numpy()
        parent = np.where((names == names[parent]).all(axis=1), parent, -1)  # of one fragment only
        found = sums_above(parent, pdf["depth"].to_numpy(), pdf[list(values)].to_numpy(np.int64))
        conv = pdf["conv_id"].to_numpy()
        pdf = pdf.assign(**{v: found[:, k] for k, v in enumerate(values)})
        return pdf.assign(up=pd.array([int(conv[p]) if p >= 0 else None for p in parent], "Int64"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fragments come one after the other; whole ones are solved together, as many as make up a chunk."""
        held: list[pd.DataFrame] = []
        for pdf in frames:
            held.append(pdf)
            if sum(map(len, held)) >= CHUNK:
                both = pd.concat(held)
                last = (both[list(fragment)] == both[list(fragment)].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    yield solve(both[~last])
                held = [both[last]]
        if held:
            both = pd.concat(held)
            if len(both):
                yield solve(both)

    tasks = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in forest.schema.fields), "up long"])
    return forest.repartition(tasks, *fragment).sortWithinPartitions(*fragment).mapInPandas(task, schema)


def rollup(forest: DataFrame, values: Sequence[str], least: int = LEAST, band: int = BAND, limit: int = LIMIT) -> DataFrame:
    """forest with each of values (whole numbers) summed over subtrees, and up, the parent's conv_id (null for roots).

    forest: depth, k1 and k2 (a node's name), p1 and p2 (its parent's, one depth less; -1 for roots), conv_id, and reach, a bound on the nodes below a
    node that does not grow downwards. Nodes whose reach is at most least, or a 65,536th of all, lie in fragments of that size.
    Above them at most 65,536 nodes lie at any depth; up to limit of them are rolled up in one task, more of them in bands of depths.
    """
    n = forest.count()
    small = max(least, n >> 16)
    light, heavy = forest.filter(F.col("reach") <= small), cut(forest.filter(F.col("reach") > small))
    marked = forest.select(*[F.col(c).alias(u) for c, u in zip(("depth", "k1", "k2"), ("_d", "p1", "p2"))], F.col("reach").alias("_r")).filter(F.col("_r") > small)
    # A light node is the top of a fragment if its parent is heavy, or if it has none.
    below = light.withColumn("_d", F.col("depth") - 1).join(marked.withColumn("_under", F.lit(True)), ["_d", "p1", "p2"], "left").withColumn("_top", F.col("_under").isNotNull() | (F.col("p1") < 0)).drop("_d", "_r", "_under")
    fragments = _tops(below, F.col("_top"))
    solved = cut(_solve(fragments, values, ("t0", "t1", "t2")))
    tops = solved.filter("_top")
    sent = tops.filter("p1 >= 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    joined = heavy.join(sent, list(KEY), "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(*[f"_{v}" for v in values])
    above = cut(_heavy(joined, values, band, limit))
    # Tops hang on heavy nodes.
    names = above.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_up"))
    named = tops.join(names, list(UP), "left").withColumn("up", F.col("_up"))
    columns = [*forest.columns, "up"]
    return solved.filter("NOT _top").select(columns).unionByName(named.select(columns)).unionByName(above.select(columns))


def _heavy(forest: DataFrame, values: Sequence[str], band: int, limit: int) -> DataFrame:
    """The rollup of nodes of which few lie at any depth: together if they are few, else in bands whose tops make a smaller forest of the same kind."""
    forest = cut(forest)
    if forest.limit(limit + 1).count() <= limit:
        return _solve(forest.withColumn("_one", F.lit(0)), values, ("_one",)).drop("_one")
    banded = _tops(forest, (F.col("depth") % band == 0) | (F.col("p1") < 0))
    totals = banded.groupBy("t0", "t1", "t2").agg(*[F.sum(v).alias(v) for v in values])
    # The forest of bands: one node each, at its place in the order of bands; its parent is the band of its top's parent.
    top = banded.filter((F.col("depth") == F.col("t0")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")))
    parents = banded.select((F.col("depth") + 1).alias("t0"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("t1").alias("b1"), F.col("t2").alias("b2"))
    bands = top.select("t0", "t1", "t2", "p1", "p2", "conv_id", "reach").join(parents, ["t0", "p1", "p2"], "left").join(totals, ["t0", "t1", "t2"])
    coarse = bands.select((F.col("t0") / band).cast("long").alias("depth"), F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.coalesce("b1", F.lit(-1)).alias("p1"), F.coalesce("b2", F.lit(-1)).alias("p2"), "conv_id", "reach", *values)
    whole = cut(_heavy(coarse, values, band, limit))
    # What the bands below hold comes to the nodes on which they hang.
    hung = whole.select(F.col("depth").alias("_b"), F.col("k1").alias("t1"), F.col("k2").alias("t2"), *values)
    sent = bands.select("t0", "t1", "t2", "p1", "p2").withColumn("_b", (F.col("t0") / band).cast("long")).join(hung, ["_b", "t1", "t2"]).filter("p1 >= 0")
    sent = sent.groupBy((F.col("t0") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    joined = banded.join(sent, list(KEY), "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(*[f"_{v}" for v in values])
    solved = _solve(joined, values, ("t0", "t1", "t2")).drop("t0", "t1", "t2")
    names = forest.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_up"))
    return solved.join(names, list(UP), "left").withColumn("up", F.coalesce("up", "_up")).drop("_up")


def _ends_digest(passed: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends, the digest of the numbers of the conversations that end at a node; a row for nodes with such only.

    Numbers come in blocks of 4096, so a list is short, and a node's blocks go through one running digest in order.
    """
    zero = F.lit(0).cast("long")
    last = passed.filter("left = 0").select(*KEY, "conv_id").unionByName(convs.filter("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    blocks = last.groupBy(*KEY, F.shiftright("conv_id", 12).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("said"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        done: list[tuple] = []
        for pdf in frames:
            for *own, said in zip(pdf["depth"].tolist(), pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["said"].tolist()):
                if own != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(said.encode())
                else:
                    state.update(f",{said}".encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends"])
            done = []
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends"])

    tasks = int(passed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "said").mapInPandas(digest, "depth long, k1 long, k2 long, ends string")


def conversation_trie(rows: DataFrame, least: int = LEAST, band: int = BAND, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie of rebuilt conversations.

    rows: conv_id, turn, role, text; other columns are not read. Turns of one conversation go by turn (null first), then by the start of role and text, then by a hash; null
    roles and texts are empty, repeated rows turns of their own, texts of any length whole. Rows without conv_id belong to no conversation
    and are left out. No conversations: no nodes.
    """
    passed, convs = steps(rows.select("conv_id", "turn", "role", "text"))
    passed = cut(passed)
    forest = nodes(passed, convs).withColumns({
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
        "n_leaves": (F.col("reach") == 0).cast("long"),
    })
    ends = _ends_digest(passed, convs)
    forest = cut(forest.join(ends, list(KEY), "left"))
    children = forest.filter("p1 >= 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    found = rollup(forest, ("saved_tokens", "n_leaves"), least, band, limit).join(children, list(KEY), "left")
    return found.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def trie_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The trie of a few rows conv_id, turn, role, text that the driver holds."""
    return conversation_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
