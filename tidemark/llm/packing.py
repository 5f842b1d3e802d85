"""Best-fit packing of tokenised documents by large-item matching.

Only the number of pieces of each length matters for the plan, so it is made from a histogram with one entry for each
length up to the capacity, however many documents there are. Pieces over a third of the capacity are matched greedily,
two in a sequence at most; shorter ones go, longest first, to the smallest gap that takes them. The plan says which
ranks of a length go to which sequences, and the pieces find their places by a join on length and rank. Ranks are by a
hash, or by an order that the caller gives; then sequences are numbered by the order of their first pieces.
"""

from __future__ import annotations

import bisect
import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.common import cut, ranked, values

CAPACITY, END_ID = 1024, 2
#: Words whose ids a task remembers, and the longest of them.
REMEMBERED, WORD = 400_000, 40


@cache
def encoder(path: str):
    """A function from text to its ids as bytes (little-endian unsigned 32-bit), for the tokenizer file at path.

    Words are encoded by the file's ranks and remembered: a byte-level pre-tokenizer begins a new piece at a single
    space between two other characters. Texts with runs of spaces, or that may hold one of the file's special
    tokens, are encoded whole.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    del spec, byte_of, ranks
    known: dict[str, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return packed(_whole(path).encode(text, add_special_tokens=False).ids)
        words = text.split(" ")
        if "" in words:
            return packed(fast.encode_ordinary(text))
        words[1:] = [" " + w for w in words[1:]]
        out = list(map(known.get, words))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for k, x in enumerate(out):
                if x is None:
                    out[k] = packed(fast.encode_ordinary(words[k]))
                    if len(words[k]) <= WORD:
                        known[words[k]] = out[k]
        return b"".join(out)

    encode.forget = known.clear
    return encode


@cache
def _whole(path: str) -> Tokenizer:
    """The file's own tokenizer, which takes much memory, for the texts that need it."""
    return Tokenizer.from_file(path)


def _cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of the capacity, a shorter one first."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, order: tuple[str, ...] = ()) -> DataFrame:
    """Each row's pieces with their ids (little-endian unsigned 32-bit; null unless with_ids). A null text is empty.

    The columns of order (long) are handed on.
    """
    schema = T.StructType([*PIECES, *(T.StructField(c, T.LongType()) for c in order)])

    def run(batches):
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for i, t, *at in zip(*(values(c) for c in batch.columns), strict=True):
                ids = encode(t or "") + end
                for k, (s, n) in enumerate(_cuts(len(ids) // 4, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    rows.append((i, k, s, n, zlib.crc32(own), own if with_ids else None, *at))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *(pa.int64() for _ in order))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], schema.names)
        # the process stays for other work
        encode.forget()

    return docs.select(F.col(doc_id).cast("long"), F.col(text), *order).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, first sequence, pieces in each, offset) that place all pieces of a histogram.

    Ranks from_rank up to, not including, to_rank of a length fill sequences from the first one on, so many pieces in
    each, one behind the other from offset. Sequences with equal contents are treated as one group, and a group falls
    in two when only a part of it takes more, so the rows don't grow with the number of pieces.
    """
    rows, used = [], dict.fromkeys(histogram, 0)
    left = {n: c for n, c in histogram.items() if c > 0}
    gaps: dict[int, list[tuple[int, int]]] = {}  # free places: groups (first sequence, sequences)
    order: list[int] = []  # their sizes, ascending
    sequences = 0

    def put(length: int, first: int, count: int, each: int, total: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + total, first, each, offset))
        used[length] += total

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted((n for n in left if n > capacity // 3), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] and (m != n or left[n] > 1)), None)
            count = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, sequences, count, 1, count, 0)
            left[n] -= count
            if mate is not None:
                put(mate, sequences, count, 1, count, n)
                left[mate] -= count
            free(capacity - n - (mate or 0), sequences, count)
            sequences += count
    for n in sorted((n for n in left if n <= capacity // 3), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                count = -(-left[n] // each)
                free(capacity, sequences, count)
                sequences += count
                continue
            gap = order[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // n
            full = min(count, left[n] // each)
            if full:
                put(n, first, full, each, full * each, capacity - gap)
                left[n] -= full * each
                free(gap - each * n, first, full)
            first, count = first + full, count - full
            if count and 0 < left[n] < each:
                rest = left[n]
                put(n, first, 1, rest, rest, capacity - gap)
                left[n] = 0
                free(gap - rest * n, first, 1)
                first, count = first + 1, count - 1
            free(gap, first, count)
    return rows


def pack(found: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """found with sequence_id and offset. found has length (1 to capacity), doc_id and piece, and has to be stable.

    Repeated rows are placed each on its own. The plan is bounded by the capacity, so it is broadcast. With order (long
    columns; rows with equal values in the first go to one task a length), pieces of a length are placed by it, and a
    sequence's number is the rank of its first piece, which is its longest, among all first pieces.
    """
    spark = found.sparkSession
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    schema = "length long, from_rank long, to_rank long, first_sequence long, each long, first_offset long"
    places = spark.createDataFrame(plan(histogram, capacity), schema)
    bucket = F.col(order[0]) if order else None
    by = [*(F.col(c) for c in order[1:]), F.col("doc_id"), F.col("piece")]
    placed = ranked(found, F.col("length"), by, "rank", bucket=bucket)
    fits = (placed["length"] == places["length"]) & (placed["rank"] >= places["from_rank"]) & (placed["rank"] < places["to_rank"])
    k = F.col("rank") - F.col("from_rank")
    placed = placed.join(F.broadcast(places), fits).select(
        *(placed[c] for c in found.columns),
        (F.col("first_sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + k % F.col("each") * placed["length"]).cast("long").alias("offset"),
    )
    if not order:
        return placed
    placed = cut(placed)
    heads = ranked(placed.where(F.col("offset") == 0), F.lit(0), by, "number", bucket=bucket).select("sequence_id", "number")
    kept = [F.col(c) for c in found.columns if c not in order]
    return placed.join(heads, "sequence_id").select(*kept, F.col("number").cast("long").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids), sequence_id, offset for each piece of each row.

    A null or empty text is its end alone; repeated rows are packed each for itself; a text longer than a sequence is cut
    into whole ones behind a shorter first piece, so texts may be of any length. No rows give no pieces.
    """
    found = pieces(docs, tokenizer, doc_id, text, capacity, with_ids=with_ids, order=order)
    return pack(cut(found if with_ids else found.drop("ids")), capacity, order)
