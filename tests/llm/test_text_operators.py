"""Decontamination, exact deduplication, near duplicates, mixing and sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from apiarium.llm import decontamination, exact_dedup, mixing, ngram_join, sharding
from apiarium.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, lang string, n int, rep string, shard string"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    passage = sentence(rng, 60)
    out = [None, "", " \t\n", "one", "One", "a b c", "A  b\tc", "é É", "wörd " * 6]
    for _ in range(60):
        out.append(sentence(rng, rng.randrange(1, 120)))
    out += [passage + " " + sentence(rng, rng.randrange(0, 40)) for _ in range(30)]
    base = sentence(rng, 150).split()
    for _ in range(40):  # a family of near copies, chained
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        out.append(" ".join(w))
    out += [out[20].upper(), out[20], "long " + sentence(rng, 30_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(3 * i + 1, t, ["a", "b", None][i % 3] if i % 2 else "a", None, 1, "r", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[12], rows[12], rows[0]], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination(spark, docs, texts, limit):
    items = [("i1", " ".join(texts[70].split()[3:25])), ("i2", "A b"), ("i2", "one"), ("i3", None), ("i4", "!!"), ("i5", texts[9] or "x"), (None, "w1")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        m = min(10, len(w))
        for p in range(len(w) - m + 1) if m and i else ():
            windows[tuple(w[p : p + m])].add(i)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.digest(decontamination.report(docs, bench, max_broadcast=limit)).collect())
    want = Counter()
    for d, t in rows_of(docs):
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p : p + m])) in windows:
                    hit.update(range(p, p + m))
                    found |= windows[k]
        want[(d, len(w), len(hit), len(found), decontamination.items_sha256(list(found)), bool(hit))] += 1
    assert got == want
    clean = decontamination.clean(docs, bench, max_broadcast=limit)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k in want.elements() if not k[5])


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontamination.report(docs, none, max_broadcast=-1).filter("n_hit > 0").count() == 0
    assert decontamination.report(empty, none, max_broadcast=-1).count() == 0
    assert decontamination.digest(decontamination.report(docs, none)).filter("contaminated").count() == 0
    assert decontamination.report(empty, none).count() == 0
    assert decontamination.clean(docs, none).columns == docs.columns


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for d, t in rows_of(docs):
        groups[(t or "").translate(LOWER)].append(d)
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    want = Counter((d, max(g), len(g), sha[t]) for t, g in groups.items() for d in g)
    for chunks in ({}, {"mean": 64, "least": 16, "most": 256}):
        got = exact_dedup.duplicate_groups(docs, **chunks).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        # one row of each group, one with the largest doc_id
        assert Counter((r.doc_id, r.text_sha256) for r in got if r.kept) == Counter((max(g), sha[t]) for t, g in groups.items())
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.duplicate_groups(empty).count() == exact_dedup.drop_duplicates(empty).count() == 0


def test_exact_dedup_without_identifiers(spark):
    rows = [(5, "Same", "x"), (5, "same", "y"), (None, "q", "z"), (None, "Q", "w"), (3, "q", "v"), (None, None, "n"), (None, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    left = exact_dedup.drop_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.text.lower() if r.text else "") for r in left) == [(0, ""), (3, "q"), (5, "same")]
    assert Counter((r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(docs).collect()) == {(5, 2): 2, (3, 3): 3, (None, 2): 2}


def test_exact_dedup_with_collisions(docs, monkeypatch):
    """With every chunk of one length under one identifier, contents alone decide."""
    real = exact_dedup.duplicate_groups(docs).collect()
    monkeypatch.setattr(exact_dedup, "_doubtful", lambda made: made.select("line"))
    assert Counter(map(tuple, exact_dedup.duplicate_groups(docs).collect())) == Counter(map(tuple, real))


def test_chunks_depend_on_content_only():
    import numpy as np

    rng = random.Random(1)
    a, b = (sentence(rng, 4000).encode() for _ in range(2))
    cut = lambda x: {x[i:j] for ends in exact_dedup.chunk_ends(np.frombuffer(x, np.uint8), np.array([0, len(x)]), 1024, 256, 8192) for i, j in zip([0, *ends[:-1]], ends, strict=True)}
    assert len(cut(a + b) & cut(b)) >= len(cut(b)) - 3


def test_ngram_join(docs, empty, monkeypatch):
    sets, classes = {}, {}
    for d, t in rows_of(docs):
        w = SPACED.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    want = Counter((d, len(sets[d]), find(d)) for d, _ in rows_of(docs))
    for rounds in (0, 3):  # grouping changes the work, not the result
        assert Counter(map(tuple, ngram_join.join(docs, rounds=rounds).collect())) == want
    # halves of hashes that mislead cost work, not links
    monkeypatch.setattr(ngram_join, "HALF", ngram_join.np.uint64(7))
    assert Counter(map(tuple, ngram_join.join(docs, rounds=0).collect())) == want
    monkeypatch.undo()
    assert ngram_join.join(empty).count() == 0
    kept = ngram_join.drop_near_duplicates(docs.dropDuplicates(["doc_id"]))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d in sets if find(d) == d}


def test_ngram_join_by_rows(spark):
    """Rows that repeat a doc_id, or have none, are linked by their own texts."""
    rng = random.Random(8)
    texts = [sentence(rng, 100, 10**6).split() for _ in range(3)]
    near = [" ".join([*t[:50], "changed", *t[51:]]) for t in texts]
    a, b, c = (" ".join(t) for t in texts)
    rows = [(1, a, "p"), (1, b, "q"), (2, near[0], "r"), (3, near[1], "s"), (None, c, "t"), (None, near[2], "u"), (9, c, "v"), (None, None, "w"), (4, "", "x"), (4, "", "y"), (None, "z " * 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect())
    assert got == Counter([(1, 96, 1), (1, 96, 1), (2, 96, 1), (3, 96, 1), (None, 96, 9), (None, 96, 9), (9, 96, 9), (None, 0, None), (4, 0, 4), (4, 0, 4), (None, 1, None)])
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["a.b"] for r in kept.collect()) == ["p", "q", "v", "w", "x", "y", "z"]


def _brute_components(links):
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_components(spark):
    rng = random.Random(6)
    path = [(i, i + 1) for i in range(40)]
    hub = [(500, i) for i in range(450, 560)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    for links in ([], [(3, 3)], [(9, 2), (2, 9), (9, 2)], path, hub, loose):
        got = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(got) == len({r["node"] for r in got})
        assert {r["node"]: r["component"] for r in got} == _brute_components(links)


def test_mixing(docs, empty):
    rows = [(r.doc_id, len(SPACED.findall(r.text or "")), r.source) for r in docs.collect()]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    out = mixing.mixed(docs).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d, n) for d, n, _ in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    targets = mixing.share_budget(dict(sizes), (3.0, 1.0, 2.0), 1.5, 2.0)
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    biggest = max(n for _, n, _ in rows)
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in out:
        taken[source[r.doc_id]] += r.taken
        assert abs(r.target - targets[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
    assert all(abs(taken[s] - targets[s]) <= biggest for s in sizes)
    assert Counter(map(tuple, mixing.mixed(docs.repartition(2)).collect())) == Counter(map(tuple, out))
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns and drawn.count() == sum(r.copies for r in out)
    assert mixing.mixed(empty).count() == 0 and mixing.draw(empty).count() == 0


def test_mixing_without_identifiers(spark):
    rng = random.Random(5)
    rows = [(None, sentence(rng, 20), s, 1) for s in ("a", "b") for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `_mix.x` int")
    by = {r.target: r.taken for r in mixing.mixed(docs).groupBy("target").agg({"taken": "sum"}).toDF("target", "taken").collect()}
    assert all(abs(t - n) < 0.03 * t for t, n in by.items()) and len(by) == 2
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns and abs(drawn.count() - 1200) < 30


def test_budget_stops_at_the_cap():
    got = mixing.share_budget({"a": 100, "b": 1000, None: 10}, (3.0, 1.0, 2.0), 1.5, 2.0)
    assert got["a"] == 200 and got[None] == 20 and abs(got["b"] - (1.5 * 1110 - 220)) < 1e-9
    assert mixing.share_budget({"a": 0}, (1.0,), 1.5, 2.0) == {"a": 0.0}


def test_sharding(docs, empty):
    small = docs.filter("doc_id < 400")
    out = sharding.kd_shards(small, shards=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows_of(small))
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert set(by) == set(range(5)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    total, most = [sum(r.size for r in v) for v in by.values()], max(r.size for r in out)
    assert max(total) - min(total) <= 3 * most
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    assert sharding.kd_shards(empty, shards=3).count() == 0
    assert {r.shard for r in sharding.kd_shards(docs, target_bytes=10**9).collect()} == {0}


def test_shards_balance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = Counter()
    groups = defaultdict(set)
    for r in sharding.kd_shards(docs, shards=8).collect():
        total[r.shard] += r.size
        groups[(r.text_crc32, r.size)].add(r.shard)
    assert max(total.values()) < 1.05 * min(total.values())
    assert all(len(s) == 1 for s in groups.values())
