"""The pipeline's stages act on what the stage before kept."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
import xxhash
from ferrule.llm import chunk_recipes, common, decontaminate, simhash, suffix_dedup, weak_labels

from test_operators import brute_edit, encoded

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, SF), "test")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns and sizes[-1] <= sizes[-2]
    assert sizes[4] < sizes[2] < sizes[0] and docs.agg({"length": "sum"}).first()[0] > 0


def test_stages_against_brute_force(spark):
    """What each stage keeps, decided anew in plain Python from what the stage before kept."""
    read = lambda df: [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        nonlocal docs
        before, docs = read(docs), common.stage(stages[name](spark, docs, SF), "test")
        return before, Counter(r.doc_id for r in docs.select("doc_id").collect())

    before, kept = after("toxicity")
    labels = common.read(spark, SF, "labels", "doc_id", "toxic")
    scores = {r.doc_id: r.predicted for r in weak_labels.judge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), labels).collect()}
    assert kept == Counter(i for i, _ in before if not scores[i])

    before, kept = after("exact dedup")
    best = {}
    for i, t in before:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = max(best.get(key, (-1, 0)), (len(t), -i))
    assert kept == Counter(-i for _, i in best.values())

    before, kept = after("SimHash near-dedup")
    words = [simhash.words_of(t) for _, t in before]
    sets = [set(simhash.shingle_set(w, 5).tolist()) for w in words]
    prints = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for w in words for hs in [[xxhash.xxh64_intdigest(x, 42) for x in set(w)]]]
    label = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= 7 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    assert kept == Counter(min(i for (i, _), x in zip(before, label, strict=True) if x == c) for c in set(label))

    before, kept = after("benchmark decontamination")
    items = [decontaminate.normal(r.text) for r in common.read(spark, SF, "benchmark", "item_id", "text").collect()]

    def held(item, data):
        budget = int(0.08 * len(item)) if len(item) >= 16 else 0
        if item in data:
            return True
        if not budget:
            return False
        # a passage within the budget holds one of its budget + 1 pieces as it is
        size = len(item) // (budget + 1)
        spots = {at - p for p in range(0, len(item) - size + 1, size) for at in _places(data, item[p : p + size])}
        return any(brute_edit(item, data[max(0, s - budget) : s + len(item) + budget]) <= budget for s in spots)

    assert kept == Counter(i for i, t in before if not any(held(x, decontaminate.normal(t)) for x in items if x))

    before, kept = after("packing")
    ids = dict(encoded(before))
    pieces = {}
    for r in docs.collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(x)


def _places(data, piece):
    at = data.find(piece)
    while at >= 0:
        yield at
        at = data.find(piece, at + 1)


def test_chunk_recipes_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = con.sql(chunk_recipes.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, chunk_recipes.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == sorted(want)
    assert sorted(map(tuple, suffix_dedup.removed(docs).collect())) == sorted(con.sql(suffix_dedup.ORACLE_SQL).fetchall())
