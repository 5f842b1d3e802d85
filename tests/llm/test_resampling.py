import hashlib
import math
import re
import zlib

from tests.llm.helpers import docs, lower
from tidemark.llm import resampling

TEXTS = [None, "", "  ,,, ", "One two THREE two", "Été élève 12 a_b", "word " * 30, "w " * 20_000] + [f"alpha beta {i} gamma delta " * 6 for i in range(60)]
GOAL = ["alpha beta gamma", None, "", "3 alpha"]


def features(text, size):
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
    return words, [b" ".join(words[i - k : i + 1]) for i in range(len(words)) for k in range(min(size, i + 1))]


def plain(ids, texts, goal, size=1, buckets=10_000, least=20, percent=10):
    count = lambda many: {k: sum(v.count(k) for v in many) for k in {x for v in many for x in v}}
    number = lambda text: [zlib.crc32(f) % buckets for f in features(text, size)[1]]
    own, s, t = [number(x) for x in texts], count([number(x) for x in texts]), count([number(x) for x in goal])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (s_all + buckets) / ((s.get(b, 0) + 1) * (t_all + buckets))))
    known = {b: gain(b) for b in s}
    rows = []
    for i, x, found in zip(ids, texts, own, strict=True):
        weight = sum(known[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(features(x, size)[0])])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def digest(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


def test_against_plain(spark):
    goal = spark.createDataFrame([(g,) for g in GOAL], "text string")
    ids = list(range(len(TEXTS)))
    assert digest(resampling.drawn(docs(spark, TEXTS), goal)) == sorted(plain(ids, TEXTS, GOAL), key=str)
    got = resampling.drawn(docs(spark, TEXTS), goal, size=3, buckets=100_000, min_words=4, percent=40)
    assert digest(got) == sorted(plain(ids, TEXTS, GOAL, 3, 100_000, 4, 40), key=str)


def test_ring_is_the_crc_of_each_run():
    text = "Il était une fois, 3 petits cochons un".encode()
    for size in (1, 2, 5):
        words, want = features(text.decode(), size)
        n, found = resampling.scan(text, size, 1 << 32)
        assert n == len(words) and sorted(found.tolist()) == sorted(map(zlib.crc32, want))


def test_rows_that_tie_repeat_or_have_no_id(spark):
    ids = [7] * 8 + [None, None] + list(range(10))
    texts = ["same words here " * 8] * 20
    goal = spark.createDataFrame([("same",)], "text string")
    got = digest(resampling.drawn(docs(spark, texts, ids=ids), goal, percent=50))
    assert got == sorted(plain(ids, texts, ["same"], percent=50), key=str)


def test_drawn_rows_keep_their_columns(spark):
    goal = spark.createDataFrame([(g,) for g in GOAL], "text string")
    table = docs(spark, TEXTS + TEXTS[-3:], ids=[*range(len(TEXTS)), *range(len(TEXTS) - 3, len(TEXTS))]).withColumnRenamed("length", "key")
    want = sorted(r.doc_id for r in resampling.drawn(table, goal, percent=30).collect() if r.rank)
    got = resampling.resample(table, goal, percent=30)
    assert got.columns == table.columns and sorted(r.doc_id for r in got.collect()) == want


def test_empty_tables(spark):
    none, some = docs(spark, TEXTS).limit(0), docs(spark, TEXTS)
    goal = spark.createDataFrame([], "text string")
    assert resampling.drawn(none, goal).collect() == []
    assert digest(resampling.drawn(some, goal)) == sorted(plain(range(len(TEXTS)), TEXTS, []), key=str)
