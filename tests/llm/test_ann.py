import numpy as np

from tidemark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, v string"


def table(spark, vectors, ids=None):
    ids = ids or range(len(vectors))
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2.0, "v") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def exact(x, q, own, k):
    score = x.astype(np.float64) @ x[q].astype(np.float64)
    order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != own][:k]
    return order, score


def test_recall_and_exact_scores(spark):
    x = np.random.default_rng(1).normal(size=(2500, 24)).astype(np.float32) * np.linspace(0.5, 2, 2500, dtype=np.float32)[:, None]
    frame = table(spark, x.tolist())
    rows = ann.search(frame, frame.where("vec_id % 50 = 0"), shard=900).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 2500, 50))
    hits = 0
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        want, score = exact(x, q, q, 20)
        assert np.allclose([r.score for r in own], score[[r.vec_id for r in own]])
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(own, own[1:], strict=False))
        hits += len({r.vec_id for r in own} & set(want))
    assert hits >= 0.95 * 20 * len(by)


def test_equal_vectors_and_unusable_ones(spark):
    same = [1.0, 2.0, 3.0]
    vectors = [same] * 40 + [None, [], [0.0] * 3, [1.0, float("nan"), 0.0], [1.0, None, 2.0], [1.0, float("inf"), 2.0], [3.0, 2.0, 1.0], [1.0, 1.0]]
    frame = table(spark, vectors)
    rows = ann.search(frame, frame).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(by) == [*range(40), 46]
    assert [v for _, v in sorted(by[46])] == list(range(20))
    assert [v for _, v in sorted(by[3])] == [i for i in range(21) if i != 3]


def test_few_and_none(spark):
    frame = table(spark, [[1.0, 0.0], [0.0, 1.0]])
    assert sorted((r.query_id, r.vec_id) for r in ann.search(frame, frame).collect()) == [(0, 1), (1, 0)]
    assert ann.search(frame.limit(0), frame).collect() == [] and ann.search(frame, frame.limit(0)).collect() == []
