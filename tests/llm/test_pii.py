from __future__ import annotations

import re

from pyspark.sql import functions as F

from apiarium.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    luhn = lambda d: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


TEXTS = [
    None, "", "a@b.c", "é mail me: x.y+z@mail.example.com, or +1 (904) 555-6352 é", "10.0.0.1 and 1.2.3.4.5.6.7.8 and 300.1.1.1", "card 4111 1111 1111 1111 ok 4111 1111 1111 1112 no",
    "a@b.c@d.e _@x.y", "@a.b", "x" * 3000 + "@b.cd", "1" * 3000, "+" * 3000, "+1" + " " * 3000, "me (at) site (dot) org", "call 904-555-6352 now",
]


def test_find_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None)], "doc_id long, text string, spans string")
    got = pii.digest(pii.find(docs)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = brute(TEXTS[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in range(4))
        assert r.base_sha256 == pii.sha256_of(want)
        assert all(f"{pii.KINDS[k]}:{a}:{b}" in r.spans.split(",") for k, a, b in want)


def test_very_long_texts_take_linear_time():
    long = ["x" * 1_000_000 + "@b.cd", "1" * 1_000_000, "+" * 1_000_000, "+1" + " " * 1_000_000, "1." * 500_000]
    assert [len(pii.document(t)) > 0 for t in long] == [True, False, False, False, True]


def test_many_candidates_take_linear_time():
    import time

    def seconds(n):
        text = " ".join(f"a{i}@b.com 904-555-{1000 + i % 9000}" for i in range(n))
        began = time.perf_counter()
        assert len(pii.document(text)) == 2 * n
        return time.perf_counter() - began

    assert seconds(20_000) < 12 * max(seconds(4_000), 0.02)


def test_empty_table(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_reliable_labelers_are_found():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(5000) < 0.4
    v = np.stack([np.where(rng.random(5000) < a, np.where(y, 1, 2), np.where(y, 2, 1)) for a in (0.95, 0.9, 0.55)] + [np.zeros(5000, int)] * 3, axis=1)
    p, table = pii.expectation_maximisation(v, np.ones(5000))
    assert ((p > 0.5) == y).mean() > 0.93
    assert table[0, 1, 1] > table[2, 1, 1]


def test_added_spans_touch_no_base_span(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in pii.find(docs).filter(F.size("spans") > 0).collect():
        base = [(s.start, s.end) for s in r.spans if s.base]
        assert all(s.end <= a or s.start >= b for s in r.spans if not s.base for a, b in base)
