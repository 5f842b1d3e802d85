import numpy as np
import pytest
import random

from tests.llm.helpers import docs, fingerprint, grouped
from tidemark.llm import simhash


def corpus():
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t", "One", "one", "one two", "a b c a b c"]
    base = [r.choice(vocabulary) for _ in range(400)]
    for k in range(40):
        near = list(base)
        for _ in range(k % 4):
            near[r.randrange(400)] = "x"
        texts.append(" ".join(near))
    texts += [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(20)]
    return texts + texts[7:12] + ["word " * 50_000]


def test_against_all_pairs(spark):
    texts = corpus()
    ids = [None if i in (3, 9) else 1000 - i for i in range(len(texts))]
    prints = [fingerprint(t) for t in texts]
    want = grouped(ids, prints)
    found = simhash.near_duplicates(docs(spark, texts, ids=ids)).collect()
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in found) == sorted((ids[i] or -1, f"{prints[i]:016x}", want[i]) for i in range(len(texts)))
    assert len(set(want.values())) < len(texts) - 20


def test_links_of_one_and_two_bits_only(spark):
    base = 0x0123456789ABCDEF
    values = [base, base ^ 1, base ^ 1 ^ 1 << 63, base ^ 0b111 << 20, base ^ 1 << 5 ^ 1 << 40 ^ 1 << 50]
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    pairs = {frozenset((r.u, r.v)) for r in simhash.links(frame).collect()}
    want = {frozenset((simhash._signed(a), simhash._signed(b))) for a in values for b in values if 0 < (a ^ b).bit_count() <= 2}
    assert pairs <= want and frozenset((simhash._signed(values[0]), simhash._signed(values[1]))) in pairs


def test_one_document_of_each_group_stays_with_its_columns(spark):
    texts = corpus()
    frame = docs(spark, texts)
    want = grouped(list(range(len(texts))), [fingerprint(t) for t in texts])
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_without_ids_and_without_rows(spark):
    texts = ["same text of several words"] * 4 + ["another text that differs in all"]
    assert simhash.keep_one(docs(spark, texts, ids=[None] * 5)).count() == 2
    assert simhash.near_duplicates(docs(spark, texts).limit(0)).collect() == []


def _planted(chance, n):
    """Random fingerprints, some of them within two or three bits of another, some that share four or five bytes with one."""
    prints = chance.integers(0, 1 << 64, n, dtype=np.uint64)
    flips = [prints[:200] ^ np.uint64(0), prints[:200] ^ (np.uint64(1) << chance.integers(0, 64, 200, dtype=np.uint64))]
    for k in (2, 3):
        mask = np.zeros(200, np.uint64)
        for _ in range(k):
            mask ^= np.uint64(1) << chance.integers(0, 64, 200, dtype=np.uint64)
        flips.append(prints[:200] ^ mask)
    flips.append(prints[:200] ^ (chance.integers(1, 1 << 24, 200, dtype=np.uint64) << np.uint64(40)))
    return np.unique(np.concatenate([prints, *flips]))


@pytest.mark.parametrize("size", [simhash.LIST, 2])
def test_links_connect_all_near_pairs(spark, monkeypatch, size):
    """Small lists by their tally, and with LIST 2 nearly all of them as lists of six bytes."""
    monkeypatch.setattr(simhash, "LIST", size)
    prints = _planted(np.random.default_rng(size), 1500)
    # a thousand near copies of one print share most lists
    prints = np.unique(np.concatenate([prints, prints[7] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)), prints[7] ^ np.arange(1000, dtype=np.uint64)]))
    got = simhash.links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")).collect()
    at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for r in got:
        assert ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 and r.u != r.v
        root[find(at[r.u])] = find(at[r.v])
    n_near = 0
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 2) + i + 1:
            n_near += 1
            assert find(i) == find(int(j))
    assert n_near > 1000
    if size > 2:
        assert len({(r.u, r.v) for r in got}) == len(got)


def test_the_count_filter_turns_pairs_away():
    """Pairs that share the four bytes of their list and at most one more don't reach the minimum."""
    base = np.uint64(0x0123456789ABCDEF)
    members = np.array([[base, base ^ np.uint64(0x01010101 << 32), base ^ np.uint64(0x00010100 << 32), base ^ np.uint64(0x00030000 << 32), base ^ np.uint64(0x00070000 << 32)]])
    pairs, seen, passed = simhash.tallied(members)
    want = [(int(a), int(b)) for i, a in enumerate(members[0]) for b in members[0][i + 1 :]]
    shared = lambda a, b: sum((a ^ b) >> 8 * k & 255 == 0 for k in range(8))
    assert seen == 10 and passed == sum(shared(a, b) >= 6 for a, b in want) < seen
    assert {tuple(p) for p in pairs.tolist()} == {p for p in want if (p[0] ^ p[1]).bit_count() <= 2}
