"""Near duplicates by SimHash: fingerprints, an inverted index on byte positions, count filter, verification.

A pair of 64-bit fingerprints with at most two differing bits agrees in at least six of its eight positional bytes, and so
in two of its four pairs of neighbouring bytes. A list of the index stands for two of these pairs and their four bytes (six
kinds of list), as lists for single bytes would hold a 256th of all fingerprints each. The members of a list meet: their
shared positional bytes are tallied, pairs that don't reach six are turned away, the others are verified bit by bit.

A list of over LIST members, as near copies in great numbers make it, falls apart into lists for six of its bytes, in which
two fingerprints meet exactly if their tally reaches six. Their members are distinct and differ in 16 bits, so there are 65,536
at most, and no pairs are made: members are hung on the values within one bit of them, and two members are within two bits
of each other exactly if they share such a value.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.graphs import components
from tidemark.llm.common import cut, fresh, values

BYTES = 8
#: Members of a list whose pairs are tallied; so a fingerprint is in at most 6 * 31 pairs, however many near copies there are.
LIST = 32
#: Shingles are summed up in blocks, so that a very long text takes no more memory.
BLOCK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of a text as a signed integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    n, counts = len(words) - size + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        shingles = map(b" ".join, zip(*(words[at + k : end + k] for k in range(size)), strict=True))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=">u8", count=end - at)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1)
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big"))


@F.arrow_udf(T.LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t or b"") for t in values(text.cast(pa.binary()))], pa.int64())


def masks(bits: int) -> list[tuple[int, list[int]]]:
    """The masks of the byte positions a list fixes, and the bits it leaves free."""
    found = []
    for free in combinations(range(BYTES), bits):
        loose = [8 * p + k for p in free for k in range(8)]
        found.append(((1 << 64) - 1 ^ sum(1 << k for k in loose), loose))
    return found


def _stars(bits: int):
    kinds = [np.array([0, *(1 << k for k in loose)], dtype=np.uint64) for _, loose in masks(bits)]

    def run(batches):
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            lists = batch.column("members")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
            which = np.repeat(np.arange(len(kind)), np.diff(offsets))
            out = []
            for k in np.unique(kind):
                own = np.flatnonzero(kind[which] == k)
                for part in np.array_split(own, max(1, len(own) // 200_000)):
                    # a list never falls apart: parts are widened to whole lists
                    lo, hi = which[part[0]], which[part[-1]]
                    part = own[(which[own] >= lo) & (which[own] <= hi)]
                    star = (flat[part][:, None] ^ kinds[k][None, :]).ravel()
                    member, at = np.repeat(flat[part], len(kinds[k])), np.repeat(which[part], len(kinds[k]))
                    order = np.lexsort((member, star, at))
                    star, member, at = star[order], member[order], at[order]
                    first = np.concatenate([[True], (star[1:] != star[:-1]) | (at[1:] != at[:-1])])
                    head = member[np.flatnonzero(first)[np.cumsum(first) - 1]]
                    link = head != member
                    out.append(np.unique(np.stack([member[link], head[link]], axis=1), axis=0))
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)
            u, v = pairs.view(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u)), pa.array(np.ascontiguousarray(v))], ["u", "v"])

    return run


def _positions() -> list[tuple[tuple[int, ...], int]]:
    """The byte positions that each kind of list fixes, two pairs of neighbours, and their mask."""
    kept = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(BYTES // 2), 2)]
    return [(own, sum(255 << 8 * p for p in own)) for own in kept]


def tallied(members: np.ndarray, bits: int = 2) -> tuple[np.ndarray, int, int]:
    """The near pairs within each row of members (lists of one size), how many pairs were tallied and how many of them passed the count filter."""
    left, right = np.triu_indices(members.shape[1], 1)
    near, seen, passed = [], 0, 0
    for part in np.array_split(members, max(1, members.shape[0] * len(left) // 500_000)):
        xor = part[:, left] ^ part[:, right]
        shared = (np.ascontiguousarray(xor).view(np.uint8).reshape(*xor.shape, BYTES) == 0).sum(axis=2)
        row, pair = np.nonzero(shared >= BYTES - bits)
        seen, passed = seen + xor.size, passed + len(row)
        close = np.bitwise_count(xor[row, pair]) <= bits
        row, pair = row[close], pair[close]
        near.append(np.stack([part[row, left[pair]], part[row, right[pair]]], axis=1))
    return np.concatenate(near), seen, passed


def _tally(bits: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("members")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(offsets)
            for n in np.unique(size):
                at = offsets[:-1][size == n]
                pairs, _, _ = tallied(flat[at[:, None] + np.arange(n)], bits)
                pairs.sort(axis=1)
                u, v = np.unique(pairs, axis=0).view(np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)), pa.array(np.ascontiguousarray(u))], ["u", "v"])

    return run


def links(found: DataFrame, bits: int = 2) -> DataFrame:
    """From distinct fingerprints (fp), links (u, v) of at most `bits` differing bits that connect all that are so near.

    bits may be 2 only for lists of bounded size; each link is counted and verified again.
    """
    if bits != 2:
        raise ValueError("lists are built for two differing bits")
    edge = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    part = lambda mask: F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), part(m).alias("bytes")) for i, (_, m) in enumerate(_positions())))
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = found.repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(kinds).alias("p")).select("fp", "p.*")
    # a list of one member, as most are, is dropped; no list is gathered before its size is known
    sizes = cut(keyed.groupBy("kind", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    listed = cut(keyed.join(sizes, ["kind", "bytes"]))
    small = listed.where(F.col("n") <= LIST).groupBy("kind", "bytes").agg(F.collect_list("fp").alias("members"))
    pairs = small.select("members").mapInArrow(_tally(bits), edge)
    six = masks(bits)
    within = [[k for k, (m, _) in enumerate(six) if m & own == own] for _, own in _positions()]
    of_six = [F.struct(F.lit(k).alias("kind"), part(m).alias("bytes")) for k, (m, _) in enumerate(six)]
    finer = F.get(F.array(*(F.array(*(of_six[k] for k in own)) for own in within)), F.col("kind"))
    large = listed.where(F.col("n") > LIST).select("fp", F.explode(finer).alias("p")).groupBy("p.kind", "p.bytes").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    pairs = pairs.unionByName(large.select("kind", "members").mapInArrow(_stars(bits), edge)).distinct()
    xor = F.col("u").bitwiseXOR(F.col("v"))
    shared = sum(F.when(F.shiftrightunsigned(xor, 8 * k).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for k in range(BYTES))
    return pairs.where((shared >= BYTES - bits) & (F.bit_count(xor) <= bits))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, key), one for each row of docs, and (fp, component_id, root), one for each fingerprint.

    key is a hash of id and text.

    A null text counts as empty; texts without a word have the fingerprint zero and are linked like any other.
    Repeated rows stay; a very long text is hashed in blocks of shingles. component_id is the smallest id of the component; null ids don't count, and it is null
    only if all ids are.
    """
    base = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp"), F.xxhash64(doc_id, text).alias("key")))
    nodes = base.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), bits))
    rooted = cut(nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return base, rooted.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row; see groups for nulls and ties."""
    base, found = groups(docs, doc_id, text, bits)
    return base.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 2) -> DataFrame:
    """The rows of docs that stand for their near-duplicate group: those whose id is the group's smallest.

    Of rows that share that id, the one with the smallest hash of id and text stays; of rows equal in both, any one. A
    group without any id keeps one row. The choice is made on ids and hashes; the rows themselves move once, in the
    join with the keys chosen, whose order the last step takes over.
    """
    from pyspark.sql import Window as W

    key, chosen, rank = fresh(docs, "key", "chosen", "rank")
    base, found = groups(docs, doc_id, text, bits)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("first")
    heads = base.select("fp", first).groupBy("fp").agg(F.min("first").alias("first"))
    heads = heads.join(found, "fp").groupBy("root").agg(F.min("first")["key"].alias(chosen)).select(chosen).distinct()
    rows = docs.withColumn(key, F.xxhash64(doc_id, text))
    kept = rows.join(cut(heads), F.col(key) == F.col(chosen))
    return kept.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(key))).where(F.col(rank) == 1).select(*docs.columns)
