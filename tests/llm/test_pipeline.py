"""The pipeline on a small table against what each stage must do."""

import re
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from flowlaw.llm import common, mixing, simhash, toxicity

from .fixtures import SCHEMA, frame, rows


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == columns, name
        seen.append((docs, after))
        docs = after
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen[0]
    judged = toxicity.judged(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(after) == ids(judged.filter("predicted = 0")) and after.count() > 0.7 * before.count()
    before, after = seen[1]
    assert ids(after) == sorted({r.component_id for r in simhash.near_copies(before).collect()})
    before, after = seen[2]
    assert ids(after) == ids(before)
    before, after = seen[3]
    assert Counter(ids(after)) == Counter({r.doc_id: r.copies + r.more for r in mixing.mix(before).collect() if r.copies + r.more})
    packed = Counter()
    for r in docs.collect():
        packed[r.doc_id] += r.length
    want = Counter()
    lengths = {r.doc_id: r.doc_tokens for r in docs.collect()}
    for d in ids(seen[3][1]):
        want[d] += lengths[d]
    assert packed == want


def test_empty_table(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return set(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else {tuple(words)}


def test_near_copies_are_found(spark):
    """Recall on pairs whose shingles are alike, by brute force, and what goes without any near copy."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    where = defaultdict(list)
    for d, s in sorted(sets.items()):
        for x in s:
            where[x].append(d)
    both = Counter(p for held in where.values() if len(held) > 1 for p in combinations(held, 2))
    likeness = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in both.items()}
    group = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    near = [p for p, v in likeness.items() if v >= 0.8]
    assert len(near) > 20 and sum(group[a] == group[b] for a, b in near) >= 0.9 * len(near)
    linked = {d for p, v in likeness.items() if v >= 0.5 for d in p}
    assert all(group[d] == d for d in sets if d not in linked)
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    assert kept == set(group.values())


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, very long texts, and columns with clashing names in each stage."""
    sf_dir = "/root/testdata/sf0.001"
    docs = frame(spark).withColumn("text", F.when(F.col("doc_id") == 12, F.repeat(F.lit("a b c "), 400_000)).otherwise(F.col("text"))).select("lang", "text", *[c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in ("lang", "text")])
    n = len(rows())
    toxic = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert toxic.columns == docs.columns and toxic.schema == docs.schema and 0 < toxic.count() <= n
    copies = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    kept = Counter(r.doc_id for r in copies.collect())
    # 0 to 2 are empty, 4 and 5 alike but for case, 6 and 7 equal and 8 all but for a letter, as 9 and 10 but for a word
    assert copies.columns == docs.columns and kept[None] == 2 and kept[6] == 3 and not {1, 2, 5, 7, 8, 10} & set(kept) and {0, 3, 4, 9, 12, 19} <= set(kept)
    clean = corpus_pipeline.replace_personal_data(spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.count() == n
    same = clean.filter("doc_id = 12").first()
    assert len(same.text) == 2_400_000 and clean.filter("doc_id = 13").first().n_chars == len(clean.filter("doc_id = 13").first().text)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and set(Counter(r.doc_id for r in mixed.collect())) <= {r[0] for r in rows()}
    packed = corpus_pipeline.pack_sequences(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in rows()}


def test_nothing_is_left_behind(spark):
    """A run keeps what its last stage reads; what stages wrote for themselves goes."""
    home = Path(common.folder(spark).removeprefix("file:"))
    before = set(home.rglob("*.parquet"))
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {p.relative_to(home).parts[0].rsplit("-", 1)[0] for p in home.rglob("*.parquet") if p not in before}
    assert found.count() > 0 and left <= {"toxicity", "near-duplicates", "personal-data", "mixing", "cut"}
    with common.scratch(spark):
        inner = common.cut(spark.range(5))
        assert inner.count() == 5
        path = inner.inputFiles()[0]
    assert not Path(path.removeprefix("file://")).exists()
