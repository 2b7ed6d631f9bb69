"""The whole pipeline against a plain version of each stage."""

import re
from collections import Counter

import corpus_pipeline
from upslope.llm import quality
from upslope.llm.decontamination import best_stretch, normal_words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [x.lower() for x in WORD.findall(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def overlaps(words, item):
    """Best stretch over every diagonal."""
    import numpy as np

    best = 0
    at = {}
    for q, w in enumerate(item):
        at.setdefault(w, []).append(q)
    for offset in {p - q for p, w in enumerate(words) for q in at.get(w, ())}:
        lo, hi = max(0, offset), min(len(words), offset + len(item))
        best = max(best, best_stretch(np.array([words[p] == item[p - offset] for p in range(lo, hi)]), 2)[0])
    return best


def test_pipeline(spark, small):
    docs = [(r.doc_id, (r.text or "").encode(), r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [normal_words((r.text or "").encode()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rules = quality.default_rules()
    docs = [d for d in docs if quality.passes(rules, quality.TextStats(d[1]))]
    sets = {i: shingles(t) for i, t, _ in docs}
    gone, ids = set(), sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    gone = {i for i in ids if find(i) != i}
    docs = [d for d in docs if d[0] not in gone]
    assert gone
    clean = [d for d in docs if not any(overlaps(normal_words(d[1]), item) >= min(13, len(item)) for item in items if item)]
    assert len(clean) < len(docs)
    out = corpus_pipeline.run(spark, small).collect()
    times = Counter(r.doc_id for r in out)
    allowed = {d[0]: d for d in clean}
    assert set(times) <= set(allowed) and max(times.values()) <= 2
    words = {i: len(WORD.findall(t)) for i, t, _ in clean}
    total, taken = sum(words.values()), sum(words[i] * n for i, n in times.items())
    assert 1.5 * total - max(words.values()) <= taken <= 1.5 * total
    slots = Counter(r.shard for r in out)
    assert max(slots.values()) - min(slots.values()) <= 1 and sum(slots.values()) == len(out)
    assert all(r.text.encode() == allowed[r.doc_id][1] for r in out)


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs.limit(60), small)
        assert set(docs.columns) <= set(got.columns), name
        if name != "sharding":
            assert got.columns == docs.columns, name


def test_stages_handle_odd_and_empty_tables(spark, small):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(1, long, "a"), (1, long, "a"), (None, long, None), (None, None, "b"), (2, "", "b"), (3, long + " tail", "a"), (4, long[::-1], "b"), (None, long[::-1] + " x", "c")]
    schema = "doc_id long, text string, source string, size int, copy string, h int, shard string, slot int"
    odd = spark.createDataFrame([(*r, 1, "c", 2, "s", 3) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, small)
        ids = sorted(r.doc_id or 0 for r in got.collect())
        assert {"quality_rules": [0, 0, 1, 1, 3, 4], "ngram_jaccard_join": [0, 1, 1, 2, 4], "decontamination": [0, 0, 0, 1, 1, 2, 3, 4], "sharding": [0, 0, 0, 1, 1, 2, 3, 4]}.get(name, ids) == ids, name
        assert name == "sharding" or got.columns == odd.columns
        assert stage(spark, odd.limit(0), small).count() == 0, name


def test_pipeline_is_a_function_of_its_rows(spark, small):
    first = sorted(map(str, corpus_pipeline.run(spark, small).select("doc_id", "shard", "slot").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        assert sorted(map(str, corpus_pipeline.run(spark, small).select("doc_id", "shard", "slot").collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
