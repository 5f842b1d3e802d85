"""Spelling variants: words one edit apart, found by two-dimensional range reporting, and the frequent form of each.

Let w be a word and i a place in it. A word that replaces w's i-th code point, or leaves it out, starts with what is
before i and ends with what is behind it: it lies in an interval of the words' forward order and in one of their order
by reversed words. A set of words is a set of points (place in forward order, place in reverse order), and a wavelet tree
over the reverse places, in forward order, reports the points in the rectangle of both intervals. Words that insert a code
point into w are those that find w by leaving one out.

The set is dealt into groups that hold all words a query can find. For words of c code points and those one shorter, a
group is a range [a, b) of places and what the words have before a and behind it: at first [0, c/2) and [c/2, c), so that a
group's words share half of a word. A group of over TREE_POINTS code points falls into the two halves of its range, and so on
until a range is a single place, whose group has no more words than there are code points in an alphabet, plus one.
So no task ever holds an unbounded group, however frequent a beginning or an end may be.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import resampling
from tidemark.llm.common import cut, slices, values

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Of the runs of a document, one of DAMAGED loses a code point; what a word has to have.
DAMAGED, MIN_POINTS, MIN_COUNT, TIMES = 97, 5, 3, 2
#: Different words a task counts before it hands them on; code points of a group and of a tree that a task holds.
GATHERED, TREE_POINTS = 1 << 19, 1 << 20
#: Queries that go down a tree side by side.
QUERIES = 1 << 18


def runs(doc_id, text: str | None) -> dict[str, int]:
    """The words of a document with their counts, damaged ones as they are after it; a null id counts as the empty text."""
    found: dict[str, int] = {}
    front = f"{'' if doc_id is None else doc_id}:".encode()
    for word, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
        h = zlib.crc32(word.encode(), zlib.crc32(front))
        if h % DAMAGED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= MIN_POINTS:
            found[word] = found.get(word, 0) + n
    return found


def _count(batches):
    count: dict[str, int] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
            for word, n in runs(doc_id, text).items():
                count[word] = count.get(word, 0) + n
            if len(count) > GATHERED:
                yield out()
                count.clear()
    if count:
        yield out()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all documents of at least MIN_POINTS code points and MIN_COUNT occurrences."""
    counted = docs.select(doc_id, text).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


class WaveletTree:
    """A permutation's bits from the highest to the lowest; each level keeps the order within what the levels above chose.

    ones[k][j] is the number of ones among the first j bits of level k, where all zeros of the level before stand in
    front of its ones.
    """

    def __init__(self, points: np.ndarray):
        self.bits = max(1, int(len(points) - 1).bit_length()) if len(points) else 1
        self.ones, self.zeros = [], []
        for k in range(self.bits - 1, -1, -1):
            bit = points >> k & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(points) - int(bit.sum()))
            points = np.concatenate([points[bit == 0], points[bit == 1]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and point of every point that lies at places lo to hi (hi not included) and is from least to end (not included)."""
        query, low = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for k, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            a, b = ones[lo], ones[hi]
            left = [query, lo - a, hi - b, low]
            right = [query, zeros + a, zeros + b, low + (1 << k)]
            query, lo, hi, low = (np.concatenate(x) for x in zip(left, right, strict=True))
            there = (lo < hi) & (low < end[query]) & (low + (1 << k) > least[query])
            query, lo, hi, low = query[there], lo[there], hi[there], low[there]
        return query, low


def _intervals(order: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in `order` the words are that share a word's first `depth` letters: (from, to), each by depth and word."""
    n, c = letters.shape
    lo, hi = np.zeros((c + 1, n), np.int32), np.full((c + 1, n), n, np.int32)
    rows = letters[order]
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for depth in range(1, c + 1):
        new[1:] |= rows[1:, depth - 1] != rows[:-1, depth - 1]
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        lo[depth, order] = first[run]
        hi[depth, order] = np.append(first[1:], n)[run]
    return lo, hi


def near(words: list[str], c: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of words that are one edit apart: words of c code points, edited at a place from a to b, with words of c - 1 or c."""
    forward = np.array(words, f"U{c}")
    length = np.array([len(w) for w in words], np.int64)
    behind = np.array([w[::-1] for w in words], f"U{c}")
    f_order, r_order = np.argsort(forward, kind="stable"), np.argsort(behind, kind="stable")
    place = np.empty(len(words), np.int64)
    place[r_order] = np.arange(len(words))
    tree = WaveletTree(place[f_order])
    f_lo, f_hi = _intervals(f_order, forward.view(np.uint32).reshape(-1, c))
    r_lo, r_hi = _intervals(r_order, behind.view(np.uint32).reshape(-1, c))
    whole = np.flatnonzero(length == c)
    left, right = [], []
    for i in range(a, b):
        tail = c - 1 - i
        more = whole[(f_hi[i, whole] - f_lo[i, whole] > 1) & (r_hi[tail, whole] - r_lo[tail, whole] > 1)]
        for at in range(0, len(more), QUERIES):
            w = more[at : at + QUERIES]
            query, point = tree.report(*(x.astype(np.int64) for x in (f_lo[i, w], f_hi[i, w], r_lo[tail, w], r_hi[tail, w])))
            left.append(w[query])
            right.append(r_order[point])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    rank = np.empty(len(words), np.int64)
    rank[f_order] = np.arange(len(words))
    # a word finds itself, and a pair of equal lengths is found from either side
    own = (left == right) | ((length[left] == length[right]) & (rank[left] > rank[right]))
    pairs = np.unique(np.stack([left[~own], right[~own]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _pairs(batches):
    """Pairs of each run of rows with the same (c, a, b), a tree for about TREE_POINTS code points; groups stay whole."""
    held: list[str] = []
    kind = last = None

    def out():
        left, right = near(held, *kind)
        return pa.RecordBatch.from_arrays([pa.array([held[i] for i in x], pa.string()) for x in (left, right)], ["u", "v"])

    for batch in slices(batches, 4096):
        for c, a, b, key, word in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and (kind != (c, a, b) or key != last and len(held) * c > TREE_POINTS):
                if len(held) > 1:
                    yield out()
                held = []
            kind, last = (c, a, b), key
            held.append(word)
    if len(held) > 1:
        yield out()


def links(words: DataFrame) -> DataFrame:
    """From distinct words (word), each pair (u, v) that is one inserted, deleted or replaced code point apart, once."""
    length = F.length("word")
    middle = lambda c: F.floor(c / 2).cast("int")
    ranges = F.array(*(F.struct(c.alias("c"), a.alias("a"), b.alias("b")) for c in (length, length + 1) for a, b in ((F.lit(0), middle(c)), (middle(c), c))))
    now = words.select("word", F.explode(ranges).alias("r")).select("word", "r.*")
    done = None
    while True:
        # what the words of a group share; the key alone never decides, as pairs come from the words themselves
        shared = F.struct("c", "a", "b", F.expr("left(word, a)").alias("front"), F.expr("right(word, c - b)").alias("back"))
        now = cut(now.withColumn("key", F.xxhash64(shared)))
        sizes = now.groupBy("key").agg(F.count("*").alias("size"), F.max("c").alias("c"), F.max(F.col("b") - F.col("a")).alias("wide")).where("size > 1")
        sizes = cut(sizes)
        fits = (F.col("size") * F.col("c") <= TREE_POINTS) | (F.col("wide") == 1)
        small = now.join(sizes.where(fits).select("key"), "key").select("word", "c", "a", "b", "key")
        done = small if done is None else done.unionByName(small)
        large = sizes.where(~fits)
        if large.isEmpty():
            break
        half = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct("c", "a", half.alias("b")), F.struct("c", half.alias("a"), "b"))
        now = now.join(large.select("key"), "key").select("word", F.explode(halves).alias("r")).select("word", "r.*")
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = done.repartition(tasks, "key").sortWithinPartitions("c", "a", "b", "key").select("c", "a", "b", "key", "word")
    return dealt.mapInArrow(_pairs, "u string, v string").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form): the last word that forms lead to, by doubling, as each form is at least TIMES as frequent."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of the vocabulary.

    A null text has no runs, a null id counts as the empty text. Repeated rows count as often as they are there. Texts
    and runs may be of any length. Ties between forms go to the first in code-point order. Other columns aren't read;
    documents without a word of the vocabulary, or none at all, give no rows.
    """
    words = cut(vocabulary(docs, doc_id, text))
    found = cut(links(words.select("word")))
    n = words.select(F.col("word").alias("v"), F.col("n").alias("v_n"))
    both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(n, "v")
    # Spark compares strings by their UTF-8 bytes, which is the order of code points
    best = both.groupBy(F.col("u").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("v_n")).alias("less"), "v")).alias("best"))
    formed = words.join(best, "word", "left").withColumn("led", -F.col("best.less") >= TIMES * F.col("n"))
    formed = cut(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("led"), F.col("best.v")).alias("form"), F.when(F.col("led"), -F.col("best.less")).alias("form_n")))
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """root, words and n (their occurrences) of each root with more than one word; see group."""
    sized = group(docs, doc_id, text).groupBy("root").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
    return sized.where("words > 1")


_RUNS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')"

ORACLE_SQL = f"""
with recursive {resampling.CRC_TABLE.strip()},
counted as (select doc_id, run, count(*) as n from (select doc_id, unnest({_RUNS}) as run from documents) group by doc_id, run),
hashed as (select run, n, {resampling.crc_sql("(doc_id || ':' || run)")} as h from counted, crc_table),
damaged as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from damaged where length(word) >= 5 group by word having sum(n) >= 3),
less as (select word, i, substr(word, 1, i) || substr(word, i + 2) as cut from words, lateral (select unnest(range(length(word)))::int as i)),
pairs as (select a.word as u, b.word as v from less a join less b on a.cut = b.cut and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
  union select a.word, w.word from less a join words w on a.cut = w.word
  union select w.word, a.word from less a join words w on a.cut = w.word),
best as (select u as word, count(*) as n_near, min(struct_pack(less := -w.n, v := w.word)) as best from pairs join words w on w.word = pairs.v group by u),
formed as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
  case when -best.less >= 2 * w.n then best.v end as form, case when -best.less >= 2 * w.n then -best.less end as form_n from words w left join best using (word)),
walk as (select word, coalesce(form, word) as root from formed
  union select walk.word, f.form from walk join formed f on f.word = walk.root where f.form is not null),
last as (select walk.word, root from walk join formed f on f.word = walk.root where f.form is null)
select word, n, n_near, form, form_n, root from formed join last using (word)"""
