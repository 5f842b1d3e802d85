import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import docs, lower
from tidemark.llm import variants


def vocabulary(ids, texts):
    count = Counter()
    for i, text in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(ids, texts):
    n = vocabulary(ids, texts)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w] or "", n[form[w]] if form[w] else 0, root(w)) for w in n)


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


def corpus(seed, letters="abé", words=250, texts=60):
    pick = random.Random(seed)
    base = ["".join(pick.choices(letters, k=pick.randint(5, 8))) for _ in range(words)]
    return [" ".join(w.title() if pick.random() < 0.2 else w for w in pick.choices(base, weights=[1 / (k + 1) for k in range(words)], k=120)) for _ in range(texts)]


TEXTS = [None, "", "12 ,;", "color colour colours Color COLOR " * 40, "x" * 5000 + " " + "x" * 4999 + "y " + "x" * 4999, ("x" * 5000 + "," + "x" * 4999 + "-") * 4, "ÀÉÎ àéî×÷ straße " * 5]


@pytest.mark.parametrize("points", [1 << 20, 40, 1])
def test_against_all_pairs(spark, monkeypatch, points):
    """Also where every group is too large and falls apart down to single places."""
    monkeypatch.setattr(variants, "TREE_POINTS", points)
    texts = corpus(1) if points < 1 << 20 else TEXTS + corpus(1) + corpus(2, "abcdefgh", 400)
    assert found(variants.group(docs(spark, texts))) == plain(range(len(texts)), texts)


def test_repeats_and_null_ids(spark):
    texts, ids = corpus(3, words=60, texts=20), [None] * 5 + [4] * 15
    assert found(variants.group(docs(spark, texts, ids=ids))) == plain(ids, texts)


def test_chains_lead_to_the_last_form(spark):
    texts = ["aaaaa " * 100 + "aaaab " * 40 + "aaabb " * 15 + "aabbb " * 6 + "abbbb " * 3]
    rows = {r.word: r for r in variants.group(docs(spark, texts, ids=[1])).collect()}
    assert [rows[w].form for w in ("abbbb", "aabbb", "aaabb", "aaaab", "aaaaa")] == ["aabbb", "aaabb", "aaaab", "aaaaa", None]
    assert {r.root for r in rows.values()} == {"aaaaa"}
    assert [(r.root, r.words, r.n) for r in variants.variants(docs(spark, texts, ids=[1])).collect()] == [("aaaaa", 5, 164)]


def test_wavelet_tree_reports_rectangles():
    chance = np.random.default_rng(5)
    for size in (1, 2, 7, 64, 100):
        points = chance.permutation(size)
        lo, hi = np.sort(chance.integers(0, size + 1, (2, 50)), axis=0)
        least, end = np.sort(chance.integers(0, size + 1, (2, 50)), axis=0)
        query, point = variants.WaveletTree(points).report(lo, hi, least, end)
        want = sorted((q, p) for q in range(50) for p in points[lo[q] : hi[q]].tolist() if least[q] <= p < end[q])
        assert sorted(zip(query.tolist(), point.tolist(), strict=True)) == want


def test_nothing(spark):
    assert variants.group(docs(spark, TEXTS).limit(0)).collect() == []
    assert variants.group(docs(spark, [None, "", "ab cd"])).collect() == []
