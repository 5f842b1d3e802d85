"""Mixing sources to target weights by Pfair scheduling.

A source's documents are put in a random order and cut into blocks. Think of all sources as served at once, each at a
rate in proportion to its weight, one block a slot in sum; when one runs out, the others go on with their weights scaled
up. Block k is released at the slot in which its ideal service begins and due at the end of the one in which it ends; one
block runs in each slot, the released one with the earliest deadline. The ideal service spreads each block over its own
slots and fills each slot, so a schedule that meets all deadlines exists, and earliest deadline first finds it: a source
is never a whole block ahead of or behind its weight, in any phase. No document is left out.

All is exact: weights are taken as whole numbers over one denominator. Sources with equal numbers of blocks and equal
weights form a class, and the plan knows classes alone (default weights depend on counts, so there are at most as many
as the square root of twice the rows); sources and slots are tables that meet by joins.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh, ranked

BLOCK_DOCS, EXPONENT = 8, 0.7
#: Rows that the task of the schedule hands on at once; blocks of one class that a row holds at most.
BATCH, RUN = 1 << 15, 1 << 16


def shares(weights: dict[str, float], quantum: int) -> dict[str, int]:
    """Whole parts of the quantum, one at least, by largest remainder."""
    total = math.fsum(weights.values())
    exact = {s: w / total * quantum for s, w in weights.items()}
    parts = {s: max(1, math.floor(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))
    while (gap := quantum - sum(parts.values())) > 0:
        for s in by_rest[:gap]:
            parts[s] += 1
    while sum(parts.values()) > quantum:
        parts[max(parts, key=lambda s: (parts[s], s))] -= 1
    return parts


def whole(weights: list) -> list[int]:
    """The weights in exact proportion as whole numbers."""
    exact = [Fraction(w) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("weights have to be over 0")
    scale = math.lcm(*(w.denominator for w in exact))
    parts = [int(w * scale) for w in exact]
    common = math.gcd(*parts) or 1
    return [n // common for n in parts]


def phases(classes: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(blocks, weight, ended, live): a phase ends when a source of that many blocks and weight does, in ideal service.

    Up to there, after v rounds (a source of weight w has had w * v of its blocks), the slot is ended + live * v.
    """
    ends: list[list[int]] = []
    live = sum(m * w for m, _, w in classes)
    out, ended = [], 0
    for m, n, w in sorted(classes, key=lambda c: Fraction(c[1], c[2])):
        if ends and ends[-1][0] * w == n * ends[-1][1]:
            ends[-1][2] += m * n
            ends[-1][3] += m * w
        else:
            ends.append([n, w, m * n, m * w])
    for n, w, blocks, weight in ends:
        out.append((n, w, ended, live))
        ended, live = ended + blocks, live - weight
    return out


def schedule(classes: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int, int, int, int]]:
    """Rows (class, block, first member, members, first slot, phase, release, deadline) in the order of slots.

    A class is (members, blocks of each, weight). Members from the first on run that block of theirs in slots from the
    first on. A phase holds the slots that end before its end in ideal service.
    """
    spans = phases(classes)
    until = [ended + live * n // w for n, w, ended, live in spans]
    at = [0] * len(classes)  # the phase in which a class's next block begins

    def window(c: int, k: int) -> tuple[int, int]:
        w = classes[c][2]
        _, _, ended, live = spans[at[c]]
        release = ended + live * k // w
        while spans[at[c]][0] * w < (k + 1) * spans[at[c]][1]:
            at[c] += 1
        _, _, ended, live = spans[at[c]]
        return release, ended - (-live * (k + 1) // w)

    coming = []
    for c, (_, blocks, _) in enumerate(classes):
        if blocks:
            release, due = window(c, 0)
            coming.append((release, due, c, 0))
    heapq.heapify(coming)
    ready: list[list[int]] = []
    slot = phase = 0
    while coming or ready:
        while coming and coming[0][0] <= slot:
            release, due, c, k = heapq.heappop(coming)
            heapq.heappush(ready, [due, c, k, 0, release])
        while until[phase] <= slot:
            phase += 1
        due, c, k, first, release = job = ready[0]
        members, blocks, _ = classes[c]
        n = min(members - first, until[phase] - slot, RUN, *(x[0] - slot for x in coming[:1]))
        if slot + n > due:
            raise AssertionError("a deadline was missed")
        yield c, k, first, n, slot, phase, release, due
        slot += n
        job[3] += n
        if job[3] == members:
            heapq.heappop(ready)
            if k + 1 < blocks:
                release, due = window(c, k + 1)
                heapq.heappush(coming, (release, due, c, k + 1))


def period(parts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period of as many slots as there are parts."""
    names = sorted(parts)
    slots: dict[str, list[int]] = {s: [] for s in parts}
    for c, _, _, _, slot, *_ in schedule([(1, parts[s], parts[s]) for s in names]):
        slots[names[c]].append(slot)
    return slots


def target_weights(counts: dict, exponent: float = EXPONENT) -> dict:
    """The default: counts to a power under one, which lifts small sources."""
    return {s: n**exponent for s, n in counts.items()}


SLOTS = "class int, block long, from_member long, members long, from_slot long, phase int, release long, deadline long"


def _slots(spark, classes: list[tuple[int, int, int]]) -> DataFrame:
    """The schedule's rows, made by one task of an executor, which holds one block of each class at a time."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = schedule(classes)
                while part := list(islice(rows, BATCH)):
                    kinds = [pa.int32() if f in ("class", "phase") else pa.int64() for f in names]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part, strict=True), kinds, strict=True)], names)

    names = [f.split()[0] for f in SLOTS.split(", ")]
    return spark.range(0, 1 if classes else 0, 1, 1).mapInArrow(run, SLOTS)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", source: str = "source", block_docs: int = BLOCK_DOCS, quantum: int | None = None) -> DataFrame:
    """docs with phase, block (of its source), slot, release, deadline and place (of the document in its block).

    A null source counts as the empty name; repeated rows are each placed. weights names a weight over 0 for every
    source; None takes target_weights. With a quantum, given weights are first rounded to its parts. release and deadline
    are slots, of the whole mixture. docs has to be stable. There may be any number of sources. A name that docs has
    already stays docs' own; the new column gets underscores in front.
    """
    spark = docs.sparkSession
    phase, block, slot, release, deadline, place = fresh(docs, "phase", "block", "slot", "release", "deadline", "place")
    src, rank, own, turn = fresh(docs, "mix_source", "mix_rank", "mix_source_of", "mix_block_of")
    rows = docs.withColumn(src, F.coalesce(F.col(source), F.lit("")))
    sources = rows.groupBy(F.col(src).alias(own)).agg(F.count("*").alias("docs"))
    if weights is not None:
        if quantum is not None:
            if len(weights) > quantum:
                raise ValueError("more weights than parts of the quantum")
            weights = shares(weights, quantum)
        levels = {w: i for i, w in enumerate(sorted(set(weights.values())))}
        given = spark.createDataFrame([(s, levels[w]) for s, w in weights.items()], "name string, level int")
        sources = sources.join(given, F.col(own) == F.col("name"), "left").select(own, "docs", "level")
    else:
        if quantum is not None:
            raise ValueError("a quantum needs weights")
        sources = sources.withColumn("level", F.lit(0))
    sources = cut(sources)
    kinds = sorted((r["docs"], -1 if r["level"] is None else r["level"], r["members"]) for r in sources.groupBy("docs", "level").agg(F.count("*").alias("members")).collect())
    if any(level < 0 for _, level, _ in kinds):
        raise ValueError("a source without a weight")
    if weights is None:
        lifted = target_weights({n: n for n, _, _ in kinds})
        parts = whole([lifted[n] for n, _, _ in kinds])
    else:
        by_level = sorted(set(weights.values()))
        parts = whole([by_level[level] for _, level, _ in kinds])
    classes = [(m, -(-n // block_docs), w) for (n, _, m), w in zip(kinds, parts, strict=True)]
    numbers = spark.createDataFrame([(c, n, level) for c, (n, level, _) in enumerate(kinds)], "class int, docs long, level int")
    members = ranked(sources.join(F.broadcast(numbers), ["docs", "level"]), F.col("class"), [F.col(own)], "member").select(own, "class", "member")
    runs = cut(_slots(spark, classes)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("members") - 1)))
    turns = runs.select("class", (F.col("from_member") + F.col("i")).alias("member"), F.col("block").alias(turn), F.col("phase").alias(phase), (F.col("from_slot") + F.col("i")).alias(slot), F.col("release").alias(release), F.col("deadline").alias(deadline))
    turns = turns.join(members, ["class", "member"]).select(own, turn, phase, slot, release, deadline)
    ordered = ranked(rows, F.col(src), [F.xxhash64(doc_id), F.col(doc_id)], rank)
    ordered = ordered.withColumn(block, F.floor(F.col(rank) / block_docs).cast("long"))
    return ordered.join(turns, (F.col(src) == F.col(own)) & (F.col(block) == F.col(turn))).select(*docs.columns, phase, block, slot, release, deadline, (F.col(rank) % block_docs).cast("long").alias(place))
