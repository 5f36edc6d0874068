"""The pipeline's stages against brute force, each on what the stage before it kept."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = SPACED.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def windows(t):
    w = ALNUM.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert docs.columns == columns or name == "sharding"
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    total = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(good & {r.doc_id for r in kept["quality"]}) >= 0.95 * len(good & total)

    before = {r.doc_id: shingles(r.text) for r in kept["quality"]}
    top = {d: d for d in before}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(before)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(before[a] & before[b])
            if both and 100 * both >= 80 * (len(before[a]) + len(before[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert {r.doc_id for r in kept["near_duplicates"]} == {d for d in ids if find(d) == d}

    bench = set().union(*(windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    assert {r.doc_id for r in kept["decontamination"]} == {r.doc_id for r in kept["near_duplicates"] if not windows(r.text) & bench}

    words = lambda rows: sum(len(SPACED.findall(r.text or "")) for r in rows)
    share = words(kept["mixing"]) / words(kept["decontamination"])
    assert 1.2 < share < 1.8 and max(Counter(r.doc_id for r in kept["mixing"]).values()) <= 2
    assert Counter(r.doc_id for r in kept["sharding"]) == Counter(r.doc_id for r in kept["mixing"])
    assert {r.shard for r in kept["sharding"]} <= set(range(40))
    assert corpus_pipeline.run(spark, SF).count() == len(kept["sharding"])
