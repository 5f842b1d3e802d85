"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

Terms are words without outer punctuation. Up to MAX_EXAMPLES labelled rows of at most MAX_EXAMPLE_CHARS characters,
dealt by a hash of their ids, are the examples; all their terms make up the vocabulary. Document frequencies are counted
over all documents. A term's weight is TF times IDF times its relevance: how many standard errors its odds in toxic and
other examples lie apart, halved and squared, and one at least, so no term is dropped or weakened.

Examples lie in blocks of BLOCK. Rare terms are looked up in their postings; the DENSE most frequent terms have their
largest weight in each block, and a block's own weights are used only for texts whose bound there beats their K-th
similarity so far, so the K nearest are exact. Votes, weighted by similarity, are turned into probabilities on the
examples themselves, each judged without itself.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc_bucket, fresh, values

#: Bounds of what is learnt from, and so of the index that every task gets.
MAX_EXAMPLES, MAX_EXAMPLE_CHARS = 6000, 20_000
K, BLOCK, DENSE, BATCH = 15, 128, 512, 128
BINS = 10
#: Ends of words that aren't letters of them.
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"


def bag(text: str | None) -> dict[str, int]:
    """The terms of a whole text and how often each occurs."""
    found: dict[str, int] = {}
    for word, n in Counter((text or "").lower().split()).items():
        if term := word.strip(EDGES):
            found[term] = found.get(term, 0) + n
    return found


@dataclass
class Index:
    """Examples by place (ids -1: padding of the last block), terms by number, the most frequent first.

    dense and bounds: weights of the first terms by example, and their largest by block. The postings of term t behind
    them lie from pointers[t - len(dense)] to the next.
    """

    terms: dict[str, int]
    weight: np.ndarray
    dense: np.ndarray
    bounds: np.ndarray
    pointers: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    prior: float
    edges: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of the texts' terms of the vocabulary; each text's weights have the length one."""
        row, term, tf = [], [], []
        for i, text in enumerate(texts):
            own = {t: n for w, n in bag(text).items() if (t := self.terms.get(w)) is not None}
            row += [i] * len(own)
            term += own
            tf += own.values()
        return normalised(np.array(row, np.int64), np.array(term, np.int64), np.array(tf, np.float64), self.weight, len(texts))

    def own_vectors(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the examples from place lo up to hi."""
        term, row = np.nonzero(self.dense[:, lo:hi])
        at = np.flatnonzero((self.examples >= lo) & (self.examples < hi))
        rare = len(self.dense) + np.searchsorted(self.pointers, at, side="right") - 1
        return np.append(row, self.examples[at] - lo), np.append(term, rare), np.append(self.dense[term, row + lo], self.weights[at])

    def nearest(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and cosine of each of n texts' K most similar examples (over 0), nearest first, ties to smaller ids.

        row, term, x: the texts' vectors; own: ids of examples that the texts don't count as neighbours.
        """
        m, d = len(self.ids), len(self.dense)
        often = term < d
        q = np.zeros((n, d))
        q[row[often], term[often]] = x[often]
        row, x, term = row[~often], x[~often], term[~often] - d
        size = self.pointers[term + 1] - self.pointers[term]
        at = np.arange(size.sum()) + np.repeat(self.pointers[term] - np.cumsum(size) + size, size)
        sims = np.bincount(np.repeat(row, size) * m + self.examples[at], np.repeat(x, size) * self.weights[at], n * m).astype(np.float64, copy=False).reshape(n, m)
        if own is not None:
            sims[own[:, None] == self.ids[None, :]] = -np.inf
        blocks = sims.reshape(n, m // BLOCK, BLOCK)
        bound = q @ self.bounds + blocks.max(axis=2, initial=-np.inf)

        def look(at: np.ndarray) -> None:
            for b in np.flatnonzero(at.any(axis=0)):
                rows = np.flatnonzero(at[:, b])
                blocks[rows, b] += q[rows] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]

        first = np.zeros(bound.shape, bool)
        if m:
            first[np.arange(n), bound.argmax(axis=1)] = True
        look(first)
        so_far = np.partition(blocks[first], BLOCK - K, axis=1)[:, BLOCK - K] if m else np.zeros(n)
        more = ~first & (bound > so_far[:, None] - 1e-9)
        look(more)
        blocks[~(first | more)] = 0
        # the last digits depend on the order of sums
        np.round(sims, 12, out=sims)
        least = np.partition(sims, m - K, axis=1)[:, m - K] if m else np.zeros(n)
        row, place = np.nonzero((sims >= least[:, None]) & (sims > 0))
        found = sims[row, place]
        order = np.lexsort((self.ids[place], -found, row))
        row, place, found = row[order], place[order], found[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < K
        return row[keep], place[keep], found[keep]

    def votes(self, n: int, row: np.ndarray, place: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """The share of toxic examples by similarity; a text that is near to none has the prior, with weight one half."""
        return (np.bincount(row, sims * self.toxic[place], n) + 0.5 * self.prior) / (np.bincount(row, sims, n) + 0.5)

    def probabilities(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.edges, self.values) if len(self.edges) else np.full(len(votes), self.prior)


def normalised(row: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = (1 + np.log(tf)) * weight[term]
    norm = np.sqrt(np.bincount(row, x * x, n))
    return row, term, x / norm[row]


def relevance(toxic: np.ndarray, df: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """By term, from its examples and those of them that are toxic: at least one, and more the surer its odds differ."""
    a, b, c, d = toxic + 0.5, n_toxic - toxic + 0.5, df - toxic + 0.5, n - n_toxic - df + toxic + 0.5
    z = np.abs(np.log(a / b) - np.log(c / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.maximum(1, z / 2) ** 2


def _examples(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, folds: int) -> pa.Table:
    """ex_id, ex_toxic, ex_text of at most MAX_EXAMPLES labelled rows of the learning folds; ids first, then texts."""
    label = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != 0))
    label = label.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.length(F.coalesce(F.col(text), F.lit(""))) <= MAX_EXAMPLE_CHARS)
    chosen = label.join(short.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES).toArrow()
    chosen = docs.sparkSession.createDataFrame(list(zip(*(c.to_pylist() for c in chosen.columns), strict=True)), "ex_id long, ex_toxic int")
    # MAX_EXAMPLES rows of two numbers; of rows that share an id the smallest text is taken
    rows = short.select(F.col(doc_id).alias("ex_id"), F.coalesce(F.col(text), F.lit("")).alias("ex_text")).join(F.broadcast(chosen), "ex_id")
    return rows.groupBy("ex_id").agg(F.max("ex_toxic").alias("ex_toxic"), F.min("ex_text").alias("ex_text")).toArrow().sort_by("ex_id")


def document_frequencies(docs: DataFrame, text: str, terms: dict[str, int]) -> tuple[int, np.ndarray]:
    """The number of all rows, and by term of those that hold it (terms have a bound, as the examples do)."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            found[""] += batch.num_rows
            for t in values(batch.column(0)):
                found.update(shared.value.intersection({w.strip(EDGES) for w in set((t or "").lower().split())}))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    counted = docs.select(text).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    n, df = 0, np.ones(len(terms))
    for batch in counted.to_batches(1 << 15):
        for term, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if term:
                df[terms[term]] = count
            else:
                n = count
    return n, df


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5) -> Index:
    rows = _examples(docs, labels, doc_id, text, folds)
    ids, toxic = rows["ex_id"].to_numpy(), rows["ex_toxic"].to_numpy().astype(np.float64)
    n, n_toxic = len(ids), int(toxic.sum())
    first: dict[str, int] = {}
    sizes, term, tf = array("q"), array("q"), array("d")
    for chunk in rows["ex_text"].chunks:
        for t in values(chunk):
            own = bag(t)
            sizes.append(len(own))
            term.extend(first.setdefault(w, len(first)) for w in own)
            tf.extend(own.values())
    size, term, tf = (np.array(v) for v in (sizes, term, tf))
    del rows, sizes
    row, often = np.repeat(np.arange(n), size), np.bincount(term, minlength=len(first))
    # from here on terms are numbered by falling number of examples, then by name
    names = sorted(first, key=lambda w: (-often[first[w]], w))
    number = np.empty(len(names), np.int64)
    number[[first.pop(w) for w in names]] = np.arange(len(names))
    terms, term = {w: i for i, w in enumerate(names)}, number[term]
    del names
    n_docs, df = document_frequencies(docs, text, terms)
    weight = np.log((n_docs + 1) / (df + 0.5))
    weight *= relevance(np.bincount(term, toxic[row], len(terms)), np.bincount(term, minlength=len(terms)), n_toxic, n)
    row, term, x = normalised(row, term, tf, weight, n)

    # neighbours lie in a block if they lean on the same frequent term and are of a size; padding has the id -1
    d, m = min(DENSE, len(terms)), -(-n // BLOCK) * BLOCK
    dense = np.zeros((d, m))
    dense[term[term < d], row[term < d]] = x[term < d]
    leading = dense[:, :n].argmax(axis=0) if d else np.zeros(n)
    order = np.lexsort((ids, size, leading))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    dense[:, :n] = dense[:, order]
    row, rest = place[row], term >= d
    by = np.lexsort((row[rest], term[rest]))
    pointers = np.concatenate([[0], np.cumsum(np.bincount(term[rest] - d, minlength=len(terms) - d))])
    padded = lambda v, fill: np.concatenate([v[order], np.full(m - n, fill, v.dtype)])
    # a hair more, so that rounding of the bound never closes a block too early
    bounds = dense.reshape(d, m // BLOCK, BLOCK).max(axis=2) * 1.0001
    index = Index(terms, weight, dense, bounds, pointers, row[rest][by].astype(np.int32), x[rest][by], padded(ids, -1), padded(toxic, 0), (n_toxic + 0.5) / (n + 1))
    if n:
        _calibrate(docs.sparkSession, index, n)
    return index


def _calibrate(spark, index: Index, n: int) -> None:
    """Bins of votes with their toxic share, made monotone by pooling; each example is judged without itself."""
    shared = spark.sparkContext.broadcast(index)

    def run(batches):
        own = shared.value
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                hi = min(lo + BATCH, n)
                votes = own.votes(hi - lo, *own.nearest(*own.own_vectors(lo, hi), hi - lo, own.ids[lo:hi]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(votes)], ["place", "vote"])

    judged = spark.range(0, n, BATCH, -(-n // BATCH)).mapInArrow(run, "place long, vote double").toArrow().sort_by("place")
    shared.destroy()
    toxic, votes = index.toxic[:n], judged["vote"].to_numpy()
    which = np.clip((votes * BINS).astype(int), 0, BINS - 1)
    pools: list[list[float]] = []  # sum of votes, toxic, count
    for b in range(BINS):
        own = which == b
        if own.any():
            pools.append([np.sort(votes[own]).sum(), toxic[own].sum(), own.sum()])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    index.edges = np.array([v / c for v, _, c in pools])
    index.values = np.array([(t + index.prior) / (c + 1) for _, t, c in pools])


FOUND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType())), T.StructField("similarity", T.ArrayType(T.DoubleType()))])


def scorer(spark, index: Index):
    """A function from a column of texts to structs (score, evidence, similarity): whole texts, null is empty."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        own, scores, places, sims, ends = shared.value, [], [], [], [np.zeros(1, np.int64)]
        for at in range(0, len(texts), BATCH):
            part = texts.slice(at, BATCH).to_pylist()
            row, place, found = own.nearest(*own.vectors(part), len(part))
            scores.append(own.probabilities(own.votes(len(part), row, place, found)))
            places.append(own.ids[place])
            sims.append(found)
            ends.append(ends[-1][-1] + np.cumsum(np.bincount(row, minlength=len(part))))
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        ends = pa.array(np.concatenate(ends), pa.int32())
        return pa.StructArray.from_arrays([flat(scores, pa.float64()), pa.ListArray.from_arrays(ends, flat(places, pa.int64())), pa.ListArray.from_arrays(ends, flat(sims, pa.float64()))], names=FOUND.names)

    return run


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples), similarity for each row.

    Rows whose crc32(doc_id as text) mod folds is 0 are held out. Only texts enter a score. Labels for ids that docs
    doesn't have, null labels and null ids teach nothing; without any label every score is one half. Rows of one id are
    scored each; as an example the smallest of their texts counts. Examples of equal similarity come by id.
    """
    run = scorer(docs.sparkSession, fit(docs, labels, doc_id, text, folds))
    scored = docs.select(F.col(doc_id).alias("doc_id"), (crc_bucket(F.col(doc_id), folds) == 0).alias("held_out"), run(F.col(text)).alias("r"))
    return scored.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.evidence", "r.similarity")


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, with docs' own columns."""
    (r,) = fresh(docs, "toxicity")
    run = scorer(docs.sparkSession, fit(docs, labels, doc_id, text))
    return docs.withColumn(r, run(F.col(text))["score"]).where(F.col(r) < threshold).drop(r)
