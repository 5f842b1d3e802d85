import hashlib
import random

from tests.llm.helpers import docs, without_repeats
from tidemark.llm import repeats


def corpus():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    passage, other = text(700), text(2000)
    texts = [None, "", "short", text(399), text(900), passage + text(50), text(300) + passage[:399] + text(20), text(10) + passage[100:501] + text(200)]
    texts += [other, other, text(30) + other + other[:900]]
    for k in range(12):
        near = list(other)
        near[r.randrange(2000)] = "#"
        near.insert(r.randrange(2000), "+" * (k % 3))
        texts.append("".join(near))
    return texts + ["z" * 1500, "ab" * 700, passage[:400], passage[300:] + passage[:300], text(500) + passage[200:650] + text(10) + passage[10:450]]


def check(spark, texts):
    found = {r.doc_id: r for r in repeats.digests(repeats.remove(docs(spark, texts))).collect()}
    for i, (n, runs, kept) in enumerate(without_repeats(texts)):
        own = found[i]
        assert (own.n_bytes, own.n_removed, own.n_spans, own.kept_sha256) == (len((texts[i] or "").encode()), n, runs, hashlib.sha256(kept).hexdigest()), i
    assert len(found) == len(texts)


def test_against_all_windows(spark):
    check(spark, corpus())


def test_grams_with_many_pieces(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(repeats, "LOCAL", 2)
    # a few keys are looked up without a shuffle, the others with one
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    check(spark, corpus())


def test_passages_just_under_and_over_the_length(spark):
    """Passages of over 50 words go only if they reach the length in bytes."""
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = words(58)
    assert len(passage) == 405
    texts = [f"{words(5)} #{k}# {passage[: 405 - 2 * k]} #{k}# {words(5)}" for k in (0, 1, 2, 3, 4, 5)]
    rows = {x.doc_id: x.n_removed for x in repeats.digests(repeats.remove(docs(spark, texts))).collect()}
    # each shares its passage and the two characters before it: 405 - 2 * k + 2 bytes
    assert [rows[k] >= 400 for k in range(6)] == [True] * 4 + [False] * 2 and rows[4] == rows[5] == 0
    check(spark, texts)


def test_texts_cut_into_parts(spark, monkeypatch):
    # tasks run in other processes, so the parts are looked at here
    monkeypatch.setattr(repeats, "PART", 300)
    repeats._powers.cache_clear()
    text = corpus()[10].encode()
    rows = []
    for at in range(0, len(text) - 399, 300):
        own = text[at : at + 699]
        rows += [(at + s, at + e) for s, e, _ in zip(*repeats.anchors(own), strict=True)]
    repeats._powers.cache_clear()
    assert rows[0][0] == 0 and rows[-1][1] == len(text) - 399 and all(a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_repeated_rows_and_null_ids(spark):
    texts = corpus()[8:9] * 3
    found = repeats.digests(repeats.remove(docs(spark, texts, ids=[None, 5, 5]))).collect()
    assert [r.n_removed for r in found] == [len(texts[0].encode())] * 3 and [r.n_spans for r in found] == [1] * 3
    assert repeats.remove(docs(spark, texts).limit(0)).collect() == []
