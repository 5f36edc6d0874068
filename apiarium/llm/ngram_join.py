"""N-gram Jaccard self-join by a token-group matrix.

Texts become sets of hashed word shingles. Texts with the same set are one class. Similar
classes are put into groups: a class joins the group of an earlier one when their sets
really link. The matrix says which token occurs in the union of which group; only its part
below is stored:

- A class of n tokens links only with classes that hold all but ``slack`` = n - ceil(t n) of
  its tokens, so under any one order of all tokens two linked classes share one among their
  first ``slack`` + 1. Tokens are ordered: those whose hash lies under ``RATE`` first, by the
  number of groups whose union holds them, then by hash; the others after them, by hash. So
  a class needs to show its tokens under RATE only (a few more where they are too few), and
  a passage that many groups hold comes late and is rarely needed.
- A token of one group's union only cannot link two groups: it counts, but is not compared.
- A query class meets a block (about ``BLOCK_SIZE`` members of one large group, or of small
  groups that hold the same frequent token, near in size) if one of its first tokens is in the union of the members' first tokens and the sizes allow
  it. The block is opened, for the members no larger than the query, where the overlap with
  the block's union reaches the threshold. This works on half hashes, whose overlaps are
  upper bounds; the pairs that survive are compared with their whole sets.

Links within a group are known, so a family of thousands of near copies costs one comparison
for each member, and all pairs are never made. The result is exact: no cap on candidates, on
partners or on frequent tokens.

Rows are the nodes: a row is known by its place in the files (``common.numbered``), never by
doc_id, so rows that repeat a doc_id, or have none, are linked by their own texts.

Defined cases: null or empty text or one of separators has the empty set, n_shingles 0, and
is linked with nothing; repeated texts are one class; component_id is the smallest doc_id
among the rows of a row's component, null only where none of them has one; of a component
``drop_near_duplicates`` keeps the one row with the smallest doc_id (null last), among equal
ones the first in the files; an empty table gives an empty result. Other columns, whatever
their names, are ignored by ``join`` and passed through by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apiarium.llm import common, textcore
from apiarium.llm.components import components
from apiarium.scratch import discard, materialize, settle

RATE = 0.25
LEADS = 3
HALF = np.uint64(0xFFFFFFFF)
BLOCK_SIZE = 512
BLOCK_TOKENS = 1 << 20
LIMIT = np.uint64(int(RATE * 2**64))
#: Hashes are kept as signed numbers in the order of the unsigned ones.
FLIP = np.uint64(1 << 63)
LATE = int((np.array([LIMIT]) ^ FLIP).view(np.int64)[0])


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    s, e, row = textcore.words(data, off, textcore.SPACE_WORD)
    h = textcore.span_hashes(data, s, e)
    n = len(off) - 1
    g, at = textcore.grams(h, row, words)
    wb, gb = textcore.row_bounds(row, n), textcore.row_bounds(row[at], n)
    out = []
    for i in range(n):
        if gb[i + 1] > gb[i]:
            u = np.sort(g[gb[i] : gb[i + 1]])
            out.append(u[np.concatenate([[True], u[1:] != u[:-1]])])
        elif wb[i + 1] > wb[i]:
            m = wb[i + 1] - wb[i]
            out.append(textcore.grams(h[wb[i] : wb[i + 1]], np.zeros(m, np.int64), m)[0])
        else:
            out.append(g[:0])
    return out


def needed(n: int, percent: int) -> int:
    """Tokens to show: one more than may be missing from a linked set."""
    return n - -(-percent * n // 100) + 1


def _signed(u: np.ndarray) -> np.ndarray:
    return (u ^ FLIP).view(np.int64)


def _sketches(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in textcore.blocks(batch.column(3)):
                sets = shingle_sets(data, off, words)
                n = np.array([len(u) for u in sets], dtype=np.int64)
                k1 = np.array([(u * np.uint64(0x9E3779B97F4A7C15) ^ (u >> np.uint64(29))).sum(dtype=np.uint64) for u in sets], dtype=np.uint64)
                k2 = np.array([textcore.mix(u).sum(dtype=np.uint64) for u in sets], dtype=np.uint64)
                shown = [_signed(u[: max(int(np.searchsorted(u, LIMIT)), needed(len(u), percent) if len(u) else 0)]) for u in sets]
                ends = np.concatenate([[0], np.cumsum([len(u) for u in shown])]).astype(np.int32)
                toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(shown)))
                own = [batch.column(c).slice(i, j - i) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), toks], names=["file", "row", "doc_id", "n", "k1", "k2", "toks"])

    return textcore.tidy(run)


def _full(words: int):
    half = HALF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in textcore.blocks(batch.column(1)):
                sets = shingle_sets(data, off, words)
                low = [np.sort((u & half).astype(np.uint32)).tobytes() for u in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(low, pa.binary()), pa.array([u.tobytes() for u in sets], pa.binary())], names=["rep", "low", "tokens"])

    return textcore.tidy(run)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], names=["a", "b"])

    return textcore.tidy(run)


def whole_sets(reps: DataFrame, places: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(rep, low, tokens): the whole sets of the classes named, and the low halves of their hashes.

    ``places`` (rep, file, row) says where a class has its text, so each text is read once.
    """
    wanted = places.join(reps, "rep", "left_semi")
    texts = docs.select("file", "row", "text").join(wanted, ["file", "row"]).select("rep", "text")
    return materialize(texts.mapInArrow(_full(words), "rep long, low binary, tokens binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link; each pair moves its two sets once."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta")), "a")
    both = both.join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_linked(percent), "a long, b long")


def _slack(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100)


def _grouped(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Each row's group: the component of its class so far, or the class itself."""
    if found is None:
        return rows.withColumn("grp", F.col("rep"))
    named = found.select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    return rows.join(named, "rep", "left").withColumn("grp", F.coalesce("grp", "rep"))


def _shared(rows: DataFrame) -> DataFrame:
    """(tok, rep, share): the tokens that several classes hold, and which part of all tokens shown those are of a class (0 to 1023).

    Partial sums meet the rows in a join, which adaptive execution can split where a token is frequent.
    """
    ends = rows.groupBy("tok").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    both = rows.join(ends.select("tok"), "tok")
    # what is no one else's token says how far a class is from the middle of its family
    own = rows.groupBy("rep").agg(F.count("*").alias("shown"))
    held = both.groupBy("rep").agg(F.count("*").alias("held"))
    return both.join(own.join(held, "rep").select("rep", F.floor(F.col("held") * 1023 / F.col("shown")).cast("int").alias("share")), "rep")


def _across(rows: DataFrame, found: DataFrame | None, seed: int) -> DataFrame:
    """The rows of tokens that several groups hold, with ``LEADS`` classes that lead the token's list and their groups.

    The first leader has the largest share of tokens in common with others, as the text that a
    family was made of has; further ones are drawn among those of about the largest share, anew
    in every round. Groups only grow, so a token of one group is out for good.
    """
    rows = _grouped(rows, found)
    out = [F.min("grp").alias("lo"), F.max("grp").alias("hi")]
    for k in range(LEADS):
        far = 1023 - F.col("share") if k == 0 else F.lit(7) - F.floor(F.col("share") / 128)
        at = F.shiftleft(far.cast("long"), 52) + F.pmod(F.xxhash64("rep", F.lit(seed * LEADS + k)), F.lit(1 << 52))
        out += [F.min_by("rep", at).alias(f"lead{k}"), F.min_by("grp", at).alias(f"of{k}")]
    return rows.join(rows.groupBy("tok").agg(*out).filter("lo < hi"), "tok")


def _leaders(led: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """For each class those of other groups that lead a third of its tokens' lists, so a few at most."""
    leads = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"of{k}") != F.col("grp"), F.col(f"lead{k}")) for k in range(LEADS)])))
    votes = led.select("rep", F.explode(leads).alias("lead")).groupBy("rep", "lead").agg(F.count("*").alias("votes"))
    best = votes.join(sizes.select("rep", "n", "m"), "rep").filter(F.col("votes") * 3 >= F.col("m"))
    lead = sizes.select(F.col("rep").alias("lead"), F.col("n").alias("lead_n"))
    best = best.join(lead, "lead").filter((F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent))
    return best.select(F.greatest("rep", "lead").alias("a"), F.least("rep", "lead").alias("b"))


def _open(percent: int, every: bool):
    """Pairs of a query and a member of a block that their sets of half hashes don't rule out, with the query.

    Half hashes can only add to an overlap, so what they say is an upper bound. A group's
    members are linked already, so its most similar one stands for it, unless ``every``.
    """

    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 3), np.int64)]
        if len(queries) and len(members):
            sets = [np.frombuffer(t, dtype=np.uint32) for t in members["m_low"]]
            owner = np.repeat(np.arange(len(sets)), [len(t) for t in sets])
            held = np.concatenate(sets)
            order = np.argsort(held, kind="stable")
            held, owner = held[order], owner[order]
            ids, sizes, groups = members["m_rep"].to_numpy(), members["m_n"].to_numpy(), members["m_grp"].to_numpy()
            for rep, n, grp, low in zip(queries["rep"], queries["n"], queries["grp"], queries["low"], strict=True):
                q = np.frombuffer(low, dtype=np.uint32)
                lo, hi = np.searchsorted(held, q, "left"), np.searchsorted(held, q, "right")
                if int((hi > lo).sum()) < -(-percent * n // 100):  # the block's union holds too little of it
                    continue
                count = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                near = np.flatnonzero((groups != grp) & (100 * both >= percent * (n + sizes - both)))
                if len(near) and not every:
                    best = near[np.lexsort((ids[near], -both[near] / (n + sizes[near] - both[near]), groups[near]))]
                    near = best[np.flatnonzero(np.diff(groups[best], prepend=groups[best[0]] - 1))]
                if len(near):
                    r = ids[near]
                    out.append(np.column_stack([np.maximum(r, rep), np.minimum(r, rep), np.full(len(r), rep)]))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b", "query"])

    return lambda key, q, m: run(q, m)


def candidates(rows: DataFrame, sizes: DataFrame, places: DataFrame, docs: DataFrame, found: DataFrame | None, words: int, percent: int) -> tuple[Callable[..., DataFrame], DataFrame]:
    """How to get pairs (a, b, query) of classes of different groups that all but surely link, and the sets of all classes that are compared.

    The call gives one pair for each query and group of a block, or with ``queries`` (rep) every pair of those.
    """
    rows = _grouped(rows, found)
    held = rows.select("tok", "grp").distinct()
    lists = held.groupBy("tok").agg(F.count("*").alias("groups")).filter("groups > 1")
    # tokens that the same classes hold say the same, so they are compared as one
    holders = rows.groupBy("tok").agg(F.bit_xor(F.xxhash64("rep")).alias("holders"), F.min("rep").alias("lead"))
    lists = lists.join(holders, "tok").withColumn("rank", F.when(F.col("tok") < LATE, F.col("groups")).otherwise(F.lit(1 << 62)))
    rows = rows.join(lists.select("tok", "rank", "holders", "lead", "groups"), "tok")
    # classes that are alike but not known to link are put together by the leader of their most frequent token
    alike = F.max_by("lead", F.struct("groups", "lead")).over(Window.partitionBy("rep"))
    rows = rows.withColumn("alike", alike).drop("lead", "groups")
    early = F.sum((F.col("tok") < LATE).cast("long")).over(Window.partitionBy("rep"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("rank", "tok"))
    rows = rows.withColumn("place", place).withColumn("early", early).join(sizes, "rep")
    # tokens of one group come first and fill places without being compared
    place = F.col("m") - F.col("early") + F.col("place")
    # against classes of at most its size a class shows its first tokens, against larger ones fewer will do
    small = place <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    rows = rows.filter((F.col("tok") >= LATE) | (place <= _slack(F.col("n"), percent) + 1))
    rows = rows.groupBy("holders", "rep", "grp", "n", "alike").agg(F.max(small | (F.col("tok") >= LATE)).alias("small"))
    rows = materialize(rows, "matrix")
    members = rows.filter("small").select("rep", "grp", "n", "alike").distinct()
    large = members.groupBy("grp").agg(F.count("*").alias("of_group")).filter(F.col("of_group") > BLOCK_SIZE // 2)
    members = members.join(large, "grp", "left").withColumn("alike", F.when(F.col("of_group").isNotNull(), F.col("grp")).otherwise(F.col("alike")))
    members = members.select("rep", "grp", "n", F.struct("alike", F.floor(F.log("n") / math.log(1.25)).alias("class"), F.col("of_group").isNotNull().alias("linked")).alias("kind"))
    many = members.groupBy("kind").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SIZE, F.sum("n") / BLOCK_TOKENS)).alias("many"))
    bin_ = F.pmod(F.when(F.col("kind.linked"), F.xxhash64("rep")).otherwise(F.xxhash64("grp")), F.col("many"))
    members = members.join(many, "kind").select("rep", "grp", "n", F.struct("kind.*", bin_.alias("bin")).alias("block"))
    members = materialize(members, "members")
    matrix = rows.filter("small").join(members.select("rep", "block"), "rep").groupBy("holders", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    asks = rows.select("holders", "rep", "grp", "n")
    near = (F.col("n") >= F.col("least")) & (F.col("most") * 100 >= F.col("n") * percent)
    meets = asks.join(matrix, "holders").filter(((F.col("grp") != F.col("lo")) | (F.col("grp") != F.col("hi"))) & near).select("rep", "grp", "n", "block").distinct()
    meets = materialize(meets, "meets")
    sets = whole_sets(materialize(meets.select("rep").union(members.select("rep")).distinct(), "compared"), places, docs, words)
    hot = meets.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / 2048, F.sum("n") / (4 * BLOCK_TOKENS))).alias("parts"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")
    asked = meets.join(hot, "block").select("rep", "grp", "n", "block", part).join(sets.select("rep", "low"), "rep")
    blocks = members.join(hot, "block").select("rep", "grp", "n", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = blocks.join(sets.select(F.col("rep"), F.col("low").alias("held")), "rep")
    blocks = blocks.toDF("m_rep", "m_grp", "m_n", "m_block", "m_part", "m_low")

    def opened(queries: DataFrame | None = None) -> DataFrame:
        some = asked if queries is None else asked.join(queries, "rep", "left_semi")
        both = some.groupBy("block", "part").cogroup(blocks.groupBy("m_block", "m_part"))
        return both.applyInPandas(_open(percent, queries is not None), "a long, b long, query long")

    return opened, sets


def linked(docs: DataFrame, *, words: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """file, row, doc_id, n_shingles, component_id and stays (is it its component's first row?) of rows (file, row, doc_id, text).

    ``rounds``: of grouping, which don't change the result.
    """
    made = docs.select("file", "row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketches(words, percent), "file string, row long, doc_id long, n long, k1 long, k2 long, toks array<long>")
    # numbers of rows are fixed once they are written
    sets = materialize(made.withColumn("line", F.monotonically_increasing_id()), "sketches")
    key = ["n", "k1", "k2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")).alias("keep")
    classes = materialize(sets.filter("n > 0").groupBy(*key).agg(F.min("line").alias("rep"), first), "classes")
    sketches = sets.join(classes.select(F.col("rep").alias("line")), "line", "left_semi").withColumnRenamed("line", "rep")
    sketches = materialize(sketches.select("rep", "file", "row", "n", "toks"), "class-sketches")
    places = sketches.select("rep", "file", "row")
    rows = sketches.select("rep", F.explode("toks").alias("tok"))
    sizes = materialize(sketches.select("rep", "n", F.size(F.filter("toks", lambda t: t < LATE)).cast("long").alias("m")), "sizes")
    before = materialize(_shared(rows), "shared")
    rows, links, found = before, None, None
    for i in range(rounds):
        settle(docs.sparkSession)
        led = materialize(_across(rows, found, i), "across")
        discard(before)
        before, rows = led, led.select("tok", "rep", "share")
        pairs = materialize(_leaders(led, sizes, percent).distinct(), "leaders")
        if pairs.isEmpty():
            break
        named = materialize(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "named")
        some = whole_sets(named, places, docs, words)
        new = materialize(verified(pairs, some, percent), "group-links")
        discard(pairs, named, some)
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        found = materialize(components(links), "groups")
    settle(docs.sparkSession)
    opened, some = candidates(rows.select("tok", "rep"), sizes, places, docs, found, words, percent)
    settle(docs.sparkSession)
    pairs = materialize(opened(), "opened")
    new = materialize(verified(pairs.select("a", "b").distinct(), some, percent), "last-links")
    # where halves of hashes have misled, which they hardly ever do, another member of the group may link
    wrong = pairs.join(new, ["a", "b"], "left_anti").select(F.col("query").alias("rep")).distinct()
    if not wrong.isEmpty():
        new = materialize(new.union(verified(opened(wrong).select("a", "b").distinct(), some, percent)), "last-links")
    discard(before, sizes, some, pairs)
    links = new if links is None else links.union(new)
    found = materialize(components(links), "components").withColumnRenamed("node", "rep")
    # the first row of a component is the first of its classes' first rows
    best = found.join(classes.select("rep", "keep"), "rep").groupBy("component").agg(F.min("keep").alias("best"))
    best = found.join(best, "component").select("rep", "best")
    kept = materialize(classes.join(best, "rep", "left").select(*key, F.coalesce("best", "keep").alias("keep")), "kept")
    settle(docs.sparkSession)
    out = sets.select("file", "row", "doc_id", "line", *key).join(kept, key, "left")
    alone = F.col("keep").isNull()  # without a shingle
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    return out.select("file", "row", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (alone | (F.col("keep.line") == F.col("line"))).alias("stays"))


def join(docs: DataFrame, *, words: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    rows, place = common.numbered(docs)
    rows = rows.select(*[F.col(c).alias(n) for c, n in zip(place, ("file", "row"), strict=True)], "doc_id", "text")
    return linked(rows, words=words, percent=percent, rounds=rounds).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked rows; same columns."""
    rows, place = common.numbered(docs)
    own = rows.select(*[F.col(c).alias(n) for c, n in zip(place, ("file", "row"), strict=True)], "doc_id", "text")
    gone = linked(own, words=words, percent=percent).filter("not stays").select("file", "row").toDF(*place)
    return rows.join(gone, place, "left_anti").select(*common.columns(docs))
