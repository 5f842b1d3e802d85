"""Removal of every byte that lies in a string of LENGTH bytes which also starts elsewhere.

The dealt method sorts all suffixes by a difference cover. Its first round alone ships two thirds of all byte positions
as rows; the README has the figures. What is kept of it is its frame: suffixes are sampled so that two equal strings
are sampled at the same offsets, the samples are named, only those whose name isn't unique go on, the other suffixes
are ordered by their distance to a sample and its name, and equal neighbours are looked for. The result is the same.

Samples. In each window of LENGTH bytes the GRAM bytes with the smallest hash (leftmost, if several) are its anchor.
It depends on the window's content alone, so equal windows have equal anchors at equal offsets. The windows with one
anchor are neighbours; together they are a piece, whose text is the stretch they cover.

1. A piece whose anchor's gram occurs once holds no repeated window.
2. A piece whose text (and place of the anchor) occurs twice or more is repeated throughout.
3. Other pieces are compared with the different pieces of the same gram, window by window: grams with up to LOCAL
   different pieces in one group each, the others by a shuffle of their windows.
"""

from __future__ import annotations

import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, ensure_checkpoint_dir, join_counted, slices, values

LENGTH, GRAM, LOCAL = 400, 64, 1000
#: Window starts that are looked at together; a longer text is cut into such parts, which costs no match.
PART, PLACE_BITS = 1 << 19, 20
NO_ID = -(1 << 63)
CODEC = "zstd"


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    n = PART + LENGTH + 1
    up, down = (np.full(n, x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * 2 + 1, np.cumprod(up), np.cumprod(down)


def rolling(text: bytes, width: int) -> np.ndarray:
    """A 64-bit hash of each stretch of `width` bytes."""
    codes, up, down = _powers()
    n = len(text)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes[np.frombuffer(text, dtype=np.uint8)] * up[:n], out=sums[1:])
    return (sums[width:] - sums[: n + 1 - width]) * down[: n + 1 - width]


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a text: first window, behind the last window, place of the anchor."""
    windows, wide = len(text) - LENGTH + 1, LENGTH - GRAM + 1
    h = rolling(text, GRAM)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    # the smallest of each stretch of `wide`: the end of one block and the beginning of the next
    rows = np.concatenate([key, np.full(-len(key) % wide, np.uint64((1 << 64) - 1))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.append(first[1:], windows), at[first]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_of(text: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text))


PIECE = "id long, tk long, s int, e int, a int, gram long, ctx long"


def _pieces(batches):
    names = [f.split()[0] for f in PIECE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in slices(batches):
        columns: list[list] = [[] for _ in names]
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if not text or len(text) < LENGTH:
                continue
            tk = key_of(text)
            for at in range(0, len(text) - LENGTH + 1, PART):
                own = text[at : at + PART + LENGTH - 1]
                s, e, a = (x.tolist() for x in anchors(own))
                rows = (
                    [i] * len(s),
                    [tk] * len(s),
                    [at + x for x in s],
                    [at + x for x in e],
                    [at + x for x in a],
                    [_signed(xxhash.xxh3_64_intdigest(own[x : x + GRAM])) for x in a],
                    [_signed(xxhash.xxh3_64_intdigest(own[x : y - 1 + LENGTH], z - x)) for x, y, z in zip(s, e, a, strict=True)],
                )
                for column, row in zip(columns, rows, strict=True):
                    column += row
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


PACKED = T.StructType([T.StructField("tk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("z", T.BinaryType())])


@F.arrow_udf(PACKED)
def _packed(texts: pa.Array) -> pa.Array:
    """A text's key, its length in bytes, and the text compressed for the shuffle."""
    keys, sizes, packed = [], [], []
    for t in values(texts.cast(pa.binary())):
        keys.append(key_of(t or b""))
        sizes.append(len(t or b""))
        packed.append(pa.compress(t or b"", CODEC, asbytes=True))
    return pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=PACKED.names)


def _text(n: int, z: bytes) -> bytes:
    return pa.decompress(z, n, CODEC, asbytes=True) if n else b""


QUESTION = "gram long, large boolean, id long, tk long, s int, e int, a int, ask boolean, text binary"


def _questions(batches):
    """From rows (id, tk, n, z, asked) one row for each piece asked for, with its text."""
    names = [f.split()[0] for f in QUESTION.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in slices(batches):
        out = []
        for i, tk, n, z, asked in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            text = _text(n, z)
            out += [(q["gram"], q["large"], i, tk, q["s"], q["e"], q["a"], q["ask"], text[q["s"] : q["e"] - 1 + LENGTH]) for q in asked]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def _windows(table) -> tuple[np.ndarray, ...]:
    """For all windows of pieces: row, start, distance to the anchor, hash."""
    texts, s, a = table.column("text").to_pylist(), table.column("s").to_pylist(), table.column("a").to_pylist()
    hashes = [rolling(t, LENGTH) for t in texts]
    count = np.array([len(h) for h in hashes])
    row = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.array(s), count)
    return row, start, np.repeat(np.array(a), count) - start, np.concatenate(hashes)


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and behind the last of each run of window starts; sorted by row and start."""
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(row)) - 1
    return row[new], start[new], start[last] + 1


COVER = "id long, tk long, s int, e int"
COVER_ARROW = pa.schema([("id", pa.int64()), ("tk", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _compare(table: pa.Table) -> pa.Table:
    """The repeated windows of one gram's pieces, those asked about: neighbours in the order of distance and hash."""
    row, start, distance, h = _windows(table)
    order = np.lexsort((h, distance))
    same = (h[order][1:] == h[order][:-1]) & (distance[order][1:] == distance[order][:-1])
    twice = np.zeros(len(row), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.flatnonzero(twice & table.column("ask").to_numpy()[row])
    if not len(hit):
        return COVER_ARROW.empty_table()
    row, first, behind = _runs(row[hit], start[hit])
    own = table.select(["id", "tk"]).take(pa.array(row))
    return pa.table([own.column("id"), own.column("tk"), pa.array(first, pa.int32()), pa.array(behind, pa.int32())], schema=COVER_ARROW)


def _spread(batches):
    """The windows of pieces as rows, for grams with too many pieces for one group."""
    for batch in slices(batches):
        row, start, distance, h = _windows(batch)
        own = [batch.column(k).take(pa.array(row)) for k in ("gram", "id", "tk", "ask")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(start, pa.int32()), pa.array(distance, pa.int32()), pa.array(h.view(np.int64))], ["gram", "id", "tk", "ask", "s", "d", "h"])


KEPT = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def merged(covers) -> list[tuple[int, int]]:
    """Runs of removed bytes from runs of repeated windows."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((c["s"], c["e"] - 1 + LENGTH) for c in covers):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _kept(batches):
    for batch in slices(batches):
        doc_id, sizes = batch.column(0), batch.column(1).to_pylist()
        spans, kept = [], []
        for n, z, covers in zip(sizes, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            text, gone = _text(n, z), merged(covers or [])
            edges = [0, *(x for run in gone for x in run), n]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"start": a, "stop": b} for a, b in gone])
        yield pa.RecordBatch.from_arrays([doc_id, batch.column(1), pa.array(spans, SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder; columns of hashes take less room there than in a checkpoint."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/repeats-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated(rows: DataFrame) -> DataFrame:
    """From rows (id, text, tk, n, z) the runs [s, e) of repeated window starts, (id, tk, s, e); runs may meet."""
    found = _written(rows.select("id", "text").mapInArrow(_pieces, PIECE))
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi"))
    grams = cut(grams.where("n > 1").select("gram", "n", (F.col("lo") < F.col("hi")).alias("mixed")))
    seen = _written(join_counted(found, grams, ["gram"], "n").drop("n"))
    plain = seen.where(~F.col("mixed")).select("id", "tk", "s", "e")
    mixed = seen.where("mixed")
    contexts = cut(mixed.groupBy("gram", "ctx").agg(F.count("*").alias("m"), F.min(F.struct("id", "tk", "s", "e", "a")).alias("ref")))
    copies = join_counted(mixed, contexts.where("m > 1").select("gram", "ctx", "m"), ["gram", "ctx"], "m").select("id", "tk", "s", "e")
    sizes = cut(contexts.groupBy("gram").agg(F.count("*").alias("k")).select("gram", (F.col("k") > LOCAL).alias("large")))
    asked = contexts.join(sizes, "gram").select("gram", "large", "ref.*", (F.col("m") == 1).alias("ask"))
    asked = asked.groupBy("id", "tk").agg(F.collect_set(F.struct("gram", "large", "s", "e", "a", "ask")).alias("asked"))
    texts = cut(rows.select("id", "tk", "n", "z").join(asked, ["id", "tk"]).mapInArrow(_questions, QUESTION))
    near = texts.where(~F.col("large")).groupBy("gram").applyInArrow(_compare, COVER)
    far = texts.where("large").mapInArrow(_spread, "gram long, id long, tk long, ask boolean, s int, d int, h long")
    twice = cut(far.groupBy("gram", "d", "h").agg(F.count("*").alias("n")).where("n > 1"))
    far = join_counted(far.where("ask"), twice, ["gram", "d", "h"], "n").select("id", "tk", "s", (F.col("s") + 1).alias("e"))
    return plain.unionByName(copies).unionByName(near).unionByName(far)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, in bytes) and kept (the remaining bytes) for each row's whole text.

    A null text is empty; texts of under LENGTH bytes keep all. Repeated rows are copies of each other, so all of them
    lose what they share. Rows with null ids are told apart by their texts.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("p", _packed("text")).select("id", "text", "p.tk", "p.n", "p.z")
    covers = repeated(rows).groupBy("id", "tk").agg(F.collect_set(F.struct("s", "e")).alias("covers"))
    whole = rows.select("id", "tk", "n", "z").join(covers, ["id", "tk"], "left")
    return whole.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n", "z", "covers").mapInArrow(_kept, KEPT)


def digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate(F.transform("spans", lambda s: s["stop"] - s["start"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
