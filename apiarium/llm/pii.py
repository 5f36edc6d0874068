"""Personal data by weak supervision.

Candidates of four kinds (email, ip, card, phone) are found in the whole text: the *base* spans
by exact rules, and looser ones (written-out addresses, numbers without a country code, other
card lengths, numbers that fail a check). Labelers vote on each candidate, for, against or not
at all: the strict pattern, a checksum or range, gazetteers (domains, calling codes, issuers),
the words before it, its borders and its company. Expectation-maximisation over the counted
vote patterns of all documents estimates each labeler's reliability without any label; its
posteriors train a logistic span classifier on votes and shape. Base spans always stay, a
looser candidate is added where the classifier gives it at least ``threshold``.

What is gathered from the corpus is one count for each (kind, pattern), at most 4 * 2^17 of
them; the texts are read once.

Defined cases: null text is empty, and without spans; overlapping candidates give way to base
spans and to those before them; positions are code points, the end exclusive; rows that
repeat a doc_id, or have none, are rows of their own; an empty table gives an empty result;
other columns are ignored. A text is scanned in linear time, and each of its candidates
looked up among the base spans by bisection.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiarium.llm import textcore
from apiarium.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "check", "gazetteer", "context", "borders", "company")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?", re.IGNORECASE)
_AT_BYTES = re.compile(rb"[\[({]\s?at\s?[\])}]", re.IGNORECASE)
_AT_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_AT_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_PLAIN_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9.-])")

# Gazetteers and context words.
DOMAINS = frozenset("com org net edu gov mil int info biz name io co dev app ai eu uk us ca au de fr es it nl be ch at pl pt se no fi dk ie cz gr ru cn jp kr in br mx ar za tr il nz".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 358 370 371 372 380 385 386 420 421 852 886 966 971 972".split())
ISSUERS = ("34", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "60", "62", "64", "65", "35", "22", "23", "24", "25", "26", "27")
WORDS_FOR = {
    "email": ("mail", "contact", "write", "courriel", "correo", "kontakt", "adresse"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "servidor"),
    "card": ("card", "visa", "master", "credit", "carte", "tarjeta", "karte", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "appel", "llam", "anruf", "ruf"),
}
WORDS_AGAINST = ("version", "v.", "isbn", "issn", "section", "order", "invoice", "page", "chapter", "item", "figure")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards."""
    found, free = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > free and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < m.start():
            found.append((a, m.end()))
            free = m.end()
    return found


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in _AT.finditer(text):
        left = _AT_LEFT.search(text[max(0, m.start() - 64) : m.start()])
        right = _AT_RIGHT.match(text[m.end() : m.end() + 256])
        if left and right:
            out.append((0, m.start() - len(left.group()), m.end() + right.end()))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if not _ip_ok(m.group())]
    out += [(1, m.start(), m.end()) for m in _IPV6.finditer(text)]
    for m in _CARD.finditer(text):
        n = len(digits_of(m.group()))
        if 13 <= n <= 15 or (16 <= n <= 19 and not luhn(digits_of(m.group()))):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PLAIN_PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


def votes(text: str, kind: int, a: int, b: int, strict: bool, company: bool) -> int:
    """Votes (0 none, 1 for, 2 against; two bits for each labeler) and shape bits of a candidate."""
    s, name = text[a:b], KINDS[kind]
    d = digits_of(s)
    v = [1 if strict else 0]
    if name == "card":
        v += [1 if luhn(d) else 2, 1 if d.startswith(ISSUERS) else 2]
    elif name == "ip":
        six = ":" in s
        v += [1 if six or _ip_ok(s) else 2, 0 if six else (2 if all(len(p) == 1 for p in s.split(".")) else 1)]
    elif name == "email":
        v += [1 if "@" in s and ".." not in s else 0, 1 if re.split(r"[^A-Za-z0-9-]+", s)[-1].lower() in DOMAINS else 2]
    else:
        v += [1 if 9 <= len(d) <= 13 else 2, (1 if d.startswith(CALLING) else 2) if s.startswith("+") else 0]
    before = text[max(0, a - 40) : a].lower()
    v.append(1 if any(w in before for w in WORDS_FOR[name]) else 2 if any(w in before for w in WORDS_AGAINST) else 0)
    joined = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    v.append(2 if joined else 1)
    v.append(1 if company else 0)
    code = sum(x << (2 * i) for i, x in enumerate(v))
    shape = min(3, len(d) // 5) | (4 if any(c in " -()" for c in s) else 0) | (8 if "." in s else 0) | (16 if len(s) > 24 else 0)
    return code | shape << (2 * len(LABELERS))


def document(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, is base, pattern) of every candidate: base ones, then looser ones that touch none before."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # the last end so far: base spans of two kinds may overlap
    kept, end = [], 0
    for k, a, b in sorted(loose_spans(text), key=lambda x: (x[1], -x[2], x[0])):
        i = bisect_right(starts, a)
        if a < end or (i and reach[i - 1] > a) or (i < len(taken) and starts[i] < b):
            continue
        kept.append((k, a, b))
        end = b
    out = []
    for (k, a, b), strict in [*((x, True) for x in base), *((x, False) for x in kept)]:
        near = bisect_left(starts, b + 200) - bisect_left(starts, a - 200) - strict
        out.append((k, a, b, strict, votes(text, k, a, b, strict, near > 0)))
    return out


_SPAN = pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("code", pa.int32())])
CANDIDATES = "doc_id long, spans array<struct<kind:byte,start:long,end:long,base:boolean,code:int>>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, off in textcore.blocks(batch.column(1)):
            # only texts with an @, a digit or a written-out @ can hold a candidate
            mark = (data == 64) | ((data >= 48) & (data <= 57))
            raw = data.tobytes()
            at = np.concatenate([np.flatnonzero(mark), np.array([m.start() for m in _AT_BYTES.finditer(raw)], dtype=np.int64)])
            some = set(np.unique(np.searchsorted(off, at, side="right") - 1).tolist())
            found = [[]] * (j - i)
            for r in some:
                spans = document(raw[off[r] : off[r + 1]].decode("utf-8", "replace"))
                found[r] = [{"kind": k, "start": a, "end": b, "base": s, "code": c} for k, a, b, s, c in spans]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])


class Model:
    """Span probabilities by (kind, pattern)."""

    def __init__(self, weights: np.ndarray, reliability: np.ndarray):
        self.weights, self.reliability = weights, reliability

    @staticmethod
    def unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.stack([(code >> (2 * i)) & 3 for i in range(len(LABELERS))], axis=1)
        shape = code >> (2 * len(LABELERS))
        bits = np.stack([*(shape % 4 == x for x in range(4)), shape >> 2 & 1, shape >> 3 & 1, shape >> 4 & 1], axis=1)
        return v, bits.astype(float)

    @classmethod
    def design(cls, code: np.ndarray) -> np.ndarray:
        v, bits = cls.unpack(code)
        return np.column_stack([np.ones(len(code)), v == 1, v == 2, bits])

    def probability(self, kind: np.ndarray, code: np.ndarray) -> np.ndarray:
        z = (self.design(code) * self.weights[kind]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern (``v``, seen ``n`` times) and P(vote | class) of each labeler."""
    p = (((v == 1).sum(axis=1) - (v == 2).sum(axis=1)) > 1).astype(float) * 0.8 + 0.1
    table = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        w = np.stack([n * (1 - p), n * p])
        prior = (w.sum(axis=1) + 1) / (w.sum() + 2)
        for j in range(v.shape[1]):
            for x in range(3):
                table[j, :, x] = w[:, v[:, j] == x].sum(axis=1) + 1
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(table[j][:, v[:, j]]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, table


def fit(kind: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """EM and the span classifier of each kind, from counted patterns."""
    width = 1 + 2 * len(LABELERS) + 7
    weights, reliability = np.zeros((len(KINDS), width)), np.zeros((len(KINDS), len(LABELERS), 2, 3))
    weights[:, 0] = -20.0  # a kind that was never seen adds nothing
    for k in range(len(KINDS)):
        own = kind == k
        if not own.any():
            continue
        p, reliability[k] = expectation_maximisation(Model.unpack(code[own])[0], n[own].astype(float))
        x, w, b = Model.design(code[own]), n[own] / n[own].sum(), np.zeros(width)
        for _ in range(40):  # Newton's steps with a small ridge, on soft labels
            q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(width), x.T @ (w * (q - p)) + 1e-4 * b)
            b -= step
            if np.abs(step).max() < 1e-9:
                break
        weights[k] = b
    return Model(weights, reliability)


def _decide(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                spans = spans or []
                if any(not s["base"] for s in spans):
                    p = model.probability(np.array([s["kind"] for s in spans]), np.array([s["code"] for s in spans]))
                    spans = [s for s, x in zip(spans, p, strict=True) if s["base"] or x >= threshold]
                out.append([{"kind": s["kind"], "start": s["start"], "end": s["end"], "base": s["base"]} for s in sorted(spans, key=lambda s: (s["kind"], s["start"]))])
            kind = pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind))], names=["doc_id", "spans"])

    return run


def find(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans (kind as a number of ``KINDS``, start, end, base) of each row, by kind and start."""
    made = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(textcore.tidy(_candidates), CANDIDATES), "candidates")
    seen = made.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.code").agg(F.count("*").alias("n")).orderBy("kind", "code").toPandas()
    model = fit(seen["kind"].to_numpy(), seen["code"].to_numpy(), seen["n"].to_numpy())
    return made.mapInArrow(_decide(model, threshold), "doc_id long, spans array<struct<kind:byte,start:long,end:long,base:boolean>>")


def _of_kind(k: int):
    return lambda s: s["kind"] == F.lit(k)


def digest(found: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"].cast("int") + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)).encode()).hexdigest()
