import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import crc, docs
from tidemark.llm import toxicity


def corpus(n=600):
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(500)]
    texts, toxic = [None, "", "..."], [0, 0, None]
    for i in range(n):
        bad = i % 4 == 0
        words = [r.choice(vocabulary) for _ in range(60)]
        for _ in range(3 * bad):
            words.insert(r.randrange(60), r.choice(["idiot", "scum,", "Moron"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def labels(spark, toxic):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (10**9, 0, 1)], "doc_id long, quality int, toxic int")


def terms(text):
    return Counter(t for w in (text or "").lower().split() if (t := w.strip(toxicity.EDGES)))


def neighbours(texts, toxic, k=toxicity.K):
    """Each text's nearest examples from the texts alone: terms, document frequencies, relevance, cosine, all pairs."""
    bags = [terms(t) for t in texts]
    examples = [i for i, t in enumerate(toxic) if t is not None and zlib.crc32(str(i).encode()) % 5]
    bad = sum(toxic[i] for i in examples)
    df = Counter(t for b in bags for t in b)
    weight = {}
    for t in {t for i in examples for t in bags[i]}:
        own = [i for i in examples if t in bags[i]]
        a = sum(toxic[i] for i in own)
        cells = [a + 0.5, bad - a + 0.5, len(own) - a + 0.5, len(examples) - bad - len(own) + a + 0.5]
        z = abs(math.log(cells[0] / cells[1]) - math.log(cells[2] / cells[3])) / math.sqrt(sum(1 / c for c in cells))
        weight[t] = math.log((len(texts) + 1) / (df[t] + 0.5)) * max(1, z / 2) ** 2
    vectors = []
    for b in bags:
        v = {t: (1 + math.log(n)) * weight[t] for t, n in b.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    out = []
    for v in vectors:
        sims = [(round(sum(x * vectors[e].get(t, 0) for t, x in v.items()), 12), e) for e in examples]
        out.append(sorted(((s, e) for s, e in sims if s > 0), key=lambda x: (-x[0], x[1]))[:k])
    return out


def test_held_out_rows(spark):
    texts, toxic = corpus()
    rows = toxicity.score(docs(spark, texts), labels(spark, toxic)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(len(texts)) if crc(i) % 5 == 0}
    right = sum(r.predicted == (toxic[r.doc_id] or 0) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and crc(e) % 5 for r in rows for e in r.evidence)


def test_tables_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{path}/labels.parquet")
    known = {r.doc_id: r.toxic for r in table.collect()}
    rows = toxicity.score(spark.read.parquet(f"{path}/documents.parquet"), table).where("held_out").collect()
    held = [(r.predicted, known[r.doc_id]) for r in rows if known.get(r.doc_id) is not None]
    assert len(held) > 500 and sum(p == t for p, t in held) >= 0.98 * len(held)


@pytest.mark.parametrize("dense", [512, 0, 20])
def test_nearest_are_exact(spark, monkeypatch, dense):
    """From the texts alone, repeated rows, ties and a very long text included."""
    monkeypatch.setattr(toxicity, "DENSE", dense)
    texts, toxic = corpus(300)
    texts += [texts[10]] * 40 + [texts[11] + " again"] * 3 + ["word1 word2 idiot " * 20_000, "unheard-of words only"]
    toxic += [1] * 40 + [0] * 3 + [1, 0]
    index = toxicity.fit(docs(spark, texts), labels(spark, toxic))
    # the long text is over the bound of an example
    want = neighbours(texts, [None if len(t or "") > toxicity.MAX_EXAMPLE_CHARS else x for t, x in zip(texts, toxic, strict=True)])
    row, place, sims = index.nearest(*index.vectors(texts), len(texts))
    n = sum(index.ids >= 0)
    own = index.nearest(*index.own_vectors(0, n), n)
    assert np.allclose(own[2][np.searchsorted(own[0], np.arange(n))], 1)
    for i in range(len(texts)):
        found = [(s, int(e)) for s, e in zip(sims[row == i], index.ids[place[row == i]], strict=True)]
        assert [e for _, e in found] == [e for _, e in want[i]], i
        assert np.allclose([s for s, _ in found], [s for s, _ in want[i]], atol=1e-9)


def test_rejected_rows_go_and_columns_stay(spark):
    texts, toxic = corpus()
    frame = docs(spark, texts + texts[3:5] * 2, ids=[*range(len(texts)), 3, 4, 3, 4])
    kept = toxicity.reject(frame, labels(spark, toxic))
    assert kept.columns == frame.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert {0, 1, 2} <= set(ids) and sum(i in ids for i, t in enumerate(toxic) if t == 0) >= 0.99 * toxic.count(0)
    assert 3 not in ids and ids[4] == 3


def test_without_labels_or_rows(spark):
    texts, toxic = corpus(20)
    none = labels(spark, toxic).where("false")
    assert {r.score for r in toxicity.score(docs(spark, texts), none).collect()} == {0.5}
    assert toxicity.score(docs(spark, texts).limit(0), labels(spark, toxic)).collect() == []
    assert toxicity.score(docs(spark, [None, "", "..."]), labels(spark, [1, 0, 1])).count() == 3


def test_a_column_of_the_score_s_name_stays(spark):
    texts, toxic = [f"you {w} thing" for w in ("vile", "kind", "vile", "kind")] * 5, [1, 0, 1, 0] * 5
    frame = docs(spark, texts).withColumnRenamed("fp", "toxicity").withColumnRenamed("rank", "_toxicity")
    kept = toxicity.reject(frame, labels(spark, toxic))
    assert kept.columns == frame.columns and all(r.toxicity == 1 and r["_toxicity"] == 3 for r in kept.collect())
