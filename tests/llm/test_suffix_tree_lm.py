import math
from collections import Counter

import numpy as np

from tests.llm.helpers import crc, docs, lower, words
from tidemark.llm import suffix_tree_lm as lm

TEXTS = [None, "", "The cat SAT", "É the the\x0bcat", "a " * 30_000] + [f"the cat number {i} sat on the mat of word{i % 7}" for i in range(200)]


def test_counts_and_base(spark):
    rows = lm.score(docs(spark, TEXTS)).collect()
    tokens = {i: [*words(lower(t)), None] for i, t in enumerate(TEXTS)}
    count = Counter(x for i, own in tokens.items() if crc(i) % 7 != 2 for x in own)
    n, v = sum(count.values()), len(count)
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    for r in rows:
        own = tokens[r.doc_id]
        assert r.held_out == (crc(r.doc_id) % 7 == 2) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(own), sum(count[x] > 0 for x in own))
        assert abs(r.base_score - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own)) < 1e-6 * len(own)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_take_the_join(spark, monkeypatch):
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(docs(spark, TEXTS)).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 3)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(docs(spark, TEXTS)).collect()} == want


def plain(text, counts):
    """Longest suffix first, straight from the tree."""

    def p(context, symbol):
        below = 1 / lm.SYMBOLS if not context else p(context[1:], symbol)
        n = counts.get(context)
        return below if not n else (n.get(symbol, 0) + len(n) * below) / (sum(n.values()) + len(n))

    body = bytes([lm.END]) * lm.DEPTH + lm.normal(text) + bytes([lm.END])
    total = 0.0
    for k in range(lm.DEPTH, len(body)):
        context = next(body[j:k] for j in range(k - lm.DEPTH, k + 1) if body[j:k] in counts or j == k)
        total += math.log10(p(context, body[k]))
    return total


def test_automaton_is_the_longest_suffix():
    texts = [(t or "").encode() for t in TEXTS[5:60]]
    counts: dict = {}
    for t in texts:
        body = bytes([lm.END]) * lm.DEPTH + lm.normal(t) + bytes([lm.END])
        for k in range(lm.DEPTH, len(body)):
            for d in range(lm.DEPTH + 1):
                counts.setdefault(body[k - d : k], Counter())[body[k]] += 1
    kept = {c: n for c, n in counts.items() if sum(n.values()) > 9}
    kept = {c: n for c, n in kept.items() if all(c[j:] in kept for j in range(len(c) + 1))}
    model = lm._automaton(kept)
    probe = [*texts[:5], None, b"zzz unseen \xff", b"the cat " * 200]
    assert np.allclose(lm.log10_probabilities(probe, model), [plain(t, kept) for t in probe], rtol=1e-5)


def test_distributions_sum_to_one():
    model = lm._automaton({b"": {97: 3, 10: 1}, b"a": {97: 1, 10: 1}})
    p = 10 ** model.log_p.astype(float)
    assert np.allclose(p[:, :2].sum(axis=1) + p[:, 2] * (lm.SYMBOLS - 2), 1)


def test_counted_strings_with_cut_texts(monkeypatch):
    texts = [b"abc " * 50, b"", b"xyz"]
    whole = [lm._grams(*x) for x in lm._stream(texts, 1 << 20)]
    cut = lm._merge([lm._grams(*x) for x in lm._stream(texts, 40)])
    assert np.array_equal(whole[0][0], cut[0]) and np.array_equal(whole[0][1], cut[1])


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if crc(i) % 7 == 2][:3]
    rows = lm.score(docs(spark, ["a b", None, ""], ids=held)).collect()
    assert [r.base_score for r in rows] == [0.0] * 3 and all(r.score < 0 and r.train_tokens == 0 for r in rows)
    assert lm.score(docs(spark, ["a"]).limit(0)).collect() == []


def test_null_and_repeated_ids(spark):
    ids = [None, None, 7, 7, 7]
    rows = lm.score(docs(spark, ["the cat", None, "the cat", "the cat", "a dog"], ids=ids)).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 7, 7, 7]
    assert {r.held_out for r in rows if r.doc_id is None} == {crc(None) % 7 == 2}
    same = {(r.doc_id, r.n_tokens): (round(r.base_score, 9), round(r.score, 9)) for r in rows}
    assert sorted(r.n_tokens for r in rows) == [1, 3, 3, 3, 3] and len({v for (i, n), v in same.items() if n == 3}) == 2


def plain_gains(model, counts):
    """Each word's gain from long contexts, by a table of all of them."""

    def below(context, symbol):
        state = 0
        for b in context[-lm.DEPTH :]:
            state = model.next_state[state, model.classes[b]]
        p = 10.0 ** model.log_p[state].astype(float)
        return p[model.classes[32]] + p[model.classes[lm.END]] if symbol == lm.STOP else p[model.classes[symbol]]

    def steps(word):
        return [(word[:k], word[k] if k < len(word) else lm.STOP) for k in range(lm.DEPTH, min(len(word), lm.DEEPEST) + 1)]

    table: dict = {}
    for word, n in counts.items():
        for context, symbol in steps(word) if n else ():
            table.setdefault(context, Counter())[symbol] += n
    kept = set()
    for context, n in table.items():
        total = sum(n.values())
        worth = sum(x * math.log(x / total / below(context, s)) for s, x in n.items())
        if total >= lm.MIN_COUNT and worth > lm.DEEP_GAIN:
            kept.add(context)
    gains = {}
    for word in counts:
        gains[word] = 0.0
        for context, symbol in steps(word):
            if context in kept:
                n, p = table[context], below(context, symbol)
                gains[word] += math.log10((n[symbol] + len(n) * p) / (n.total() + len(n)) / p)
    return gains, kept


def test_long_contexts_over_many_ranges(spark, monkeypatch):
    # a third of the words start alike, and more than one range holds them; some only texts held out have
    counts = {f"https://a.example/{i % 9}/{i}".encode(): i % 4 for i in range(300)}
    counts |= {f"word{i % 50:02d}{'x' * (i % 90)}{i}".encode(): 1 + i % 3 for i in range(600)}
    counts |= {b"a": 5, b"other": 3, b"others": 2, b"other\x00s": 1, b"\xff\xfe\xff\xfe\xff\xfe": 2, b"y" * 5000: 2}
    texts = [b" ".join([w] * n) for w, n in counts.items()]
    model = lm.fit(spark.createDataFrame([(bytearray(t),) for t in texts], "text binary"))
    want, kept = plain_gains(model, counts)
    assert len(kept) > 100
    words = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long")
    for most in (40, 1 << 20):
        monkeypatch.setattr(lm, "RANGE_WORDS", most)
        got = {bytes(r.word): r.gain for r in lm.deepen(words, spark.sparkContext.broadcast(model)).collect()}
        assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-4 for w in want)


def test_scores_are_the_automaton_and_the_long_contexts(spark, monkeypatch):
    texts = [f"{t or ''} interchangeable interchange{'able' * (i % 3)}" for i, t in enumerate(TEXTS)]
    train = [t for i, t in enumerate(texts) if crc(i) % 7 != 2]
    model = lm.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    counts = Counter(w for t in train for w in words(lower(t)))
    counts = {w: counts[w] for t in texts for w in words(lower(t))}
    gains, kept = plain_gains(model, counts)
    assert kept
    want = lm.log10_probabilities([t.encode() for t in texts], model) + [sum(gains[w] for w in words(lower(t))) for t in texts]
    for frequent in (200_000, 3):
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        got = {r.doc_id: r.score for r in lm.score(docs(spark, texts)).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-5)


def test_held_out_texts_are_likelier_than_by_their_words(spark):
    """On 10,000 documents; on fewer, unseen words weigh more, for which the base asks less than spelling them costs."""
    held = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > 0.97 * held["sum(base_score)"]
