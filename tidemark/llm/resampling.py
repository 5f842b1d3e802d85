"""Importance resampling towards a target: hashed word runs, a gain for each bucket, a draw by Gumbel noise.

A text's features are its runs of 1 to `size` consecutive words. One scan of a document keeps a ring of zlib states, one
for each of the last `size` starts: a word begins a new state and extends the others by a space and itself, so each
feature's crc32 is there when its last word is read and no feature's text is ever put together. What a scan emits, the
document's buckets, is written once; the counts of all documents and all weights are taken from there.

Collected and broadcast are counts and gains by bucket, `buckets` of them whatever the corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh, slices, values

SIZE, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def scan(text: bytes | None, size: int = SIZE, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words of a text and its features' buckets, by their last word and then from short to long."""
    ring: list[int] = []
    found, words = array("Q"), 0
    for match in WORD.finditer((text or b"").lower()):
        word = match.group()
        spaced = b" " + word
        ring = [zlib.crc32(word), *(zlib.crc32(spaced, state) for state in ring[: size - 1])]
        found.extend(ring)
        words += 1
    return words, (np.frombuffer(found, np.uint64) % np.uint64(buckets)).astype(np.uint32)


def _scan(size: int, buckets: int):
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        for batch in slices(batches):
            rows = [scan(t, size, buckets) for t in values(batch.column("text").cast(pa.binary()))]
            columns = [pa.array([n for n, _ in rows], pa.int64()), pa.array([b.astype(kind).tobytes() for _, b in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], ["doc_id", "key", "n_words", "found"])

    return run, kind


def _tally(kind: np.dtype, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for found in values(batch.column(0)):
                total += np.bincount(np.frombuffer(found, kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def scanned(docs: DataFrame, size: int = SIZE, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n_words, found) of each row, written to the shared folder; found holds the buckets as whole numbers."""
    run, _ = _scan(size, buckets)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(run, f"doc_id {kind}, key long, n_words long, found binary"))


def totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows."""
    _, kind = _scan(1, buckets)
    total = np.zeros(buckets, np.int64)
    for r in found.select("found").mapInArrow(_tally(kind, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the source, both with one added to each bucket."""
    s, t, n = float(source.sum() + len(source)), float(target.sum() + len(target)), zip(source, target, strict=True)
    return np.array([math.floor(1000 * math.log(float(b + 1) * s / (float(a + 1) * t))) for a, b in n], np.int64)


def _weight(kind: np.dtype, gain: np.ndarray):
    def run(batches):
        for batch in slices(batches):
            rows = [np.frombuffer(found, kind) for found in values(batch.column("found"))]
            n = [len(r) for r in rows]
            weights = [int(gain[r].sum()) // len(r) if len(r) else 0 for r in rows]
            kept = [batch.column(c) for c in ("doc_id", "key", "n_words")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(weights, pa.int64())], ["doc_id", "key", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g), g a Gumbel number made of a hash of the seed and the id; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank, key) of each row of docs; rank is null for rows not drawn.

    Of the N rows with min_words words, the floor(percent * N / 100) with the highest scores are drawn, ties to the
    smaller id, null ids first; of rows equal in score and id (repeats), any are. A null text has no words, a text
    without words the weight 0; it can be drawn only if min_words is 0. An empty target gives every bucket t = 0. Texts
    of any length are scanned once, whole. Columns other than doc_id and text aren't read. target has a column `text`.
    """
    _, kind = _scan(size, buckets)
    found = scanned(docs, size, buckets, doc_id, text)
    goal = scanned(target.select(F.lit(0).alias("doc_id"), "text"), size, buckets)
    gain = gains(totals(found, buckets), totals(goal, buckets))
    id_kind = docs.schema[doc_id].dataType.simpleString()
    scored = found.mapInArrow(_weight(kind, gain), f"doc_id {id_kind}, key long, n_words long, n_features long, weight long")
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= min_words)
    # scores are thousandths of a bounded logarithm, so there are some ten thousands of different ones at most
    levels = able.groupBy("score").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1))
    levels = levels.select("score", F.coalesce(before, F.lit(0)).alias("above"), F.floor(F.sum("n").over(W.partitionBy()) * percent / 100).alias("wanted"))
    levels = levels.where(F.col("above") < F.col("wanted"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank", "key"]
    place = (F.row_number().over(W.partitionBy("score").orderBy("doc_id")) + F.col("above")).cast("long")
    best = able.join(levels, "score").withColumn("rank", F.when(place <= F.col("wanted"), place)).select(columns)
    rest = scored.join(levels.select("score", F.lit(True).alias("high")), "score", "left").where((F.col("n_words") < min_words) | F.col("high").isNull())
    return best.unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn rows of docs with all their columns; see drawn. Rows equal in id and text take each other's places."""
    key, copies, turn = fresh(docs, "key", "copies", "turn")
    chosen = drawn(docs, target, doc_id, text, **options).where(F.col("rank").isNotNull())
    chosen = cut(chosen.groupBy(F.col("key").alias(key)).agg(F.count("*").alias(copies)))
    rows = docs.withColumn(key, F.xxhash64(doc_id, text)).join(chosen, key)
    return rows.withColumn(turn, F.row_number().over(W.partitionBy(key).orderBy(key))).where(F.col(turn) <= F.col(copies)).select(*docs.columns)


#: crc32 by bytes: a table of 256 remainders, made from the polynomial, and a fold over a word's bytes.
CRC_TABLE = """
crc_table as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) order by i) as t from range(256) r(i))"""


def crc_sql(word: str) -> str:
    """SQL for the crc32 of a text's UTF-8 bytes, where a column t holds the table."""
    octets = f"list_transform(range(octet_length(encode({word}))), lambda k: ('0x' || substr(hex(encode({word})), 2 * k::int + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '')"

ORACLE_SQL = f"""
with {CRC_TABLE.strip()},
doc_words as (select doc_id, unnest({_WORDS}) as word from documents),
goal_words as (select unnest({_WORDS}) as word from benchmark),
vocabulary as (select distinct word from (select word from doc_words union all select word from goal_words)),
hashed as (select word, {crc_sql('word')} % 10000 as bucket from vocabulary, crc_table),
s as (select bucket, count(*) as n from doc_words join hashed using (word) group by bucket),
g as (select bucket, count(*) as n from goal_words join hashed using (word) group by bucket),
sums as (select (select coalesce(sum(n), 0) from s)::double as s_all, (select coalesce(sum(n), 0) from g)::double as t_all),
gain as (select b.bucket, floor(1000 * ln((coalesce(g.n, 0) + 1)::double * (s_all + 10000) / ((coalesce(s.n, 0) + 1)::double * (t_all + 10000))))::bigint as gain
  from (select distinct bucket from hashed) b left join s using (bucket) left join g using (bucket), sums),
weights as (select doc_id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from doc_words join hashed using (word) join gain using (bucket) group by doc_id),
scored as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from documents left join weights using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight, score,
  case when rank <= (select floor(10 * count(*) / 100) from placed) then rank end as rank
from scored left join placed using (doc_id)"""
