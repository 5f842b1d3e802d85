import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import docs
from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "It's  two spaces\n\n and\ttabs   x", "no-break  x  y 's", "end <|endoftext|> more", "é😀 ß 12 345 's 'll", "line \n next \r\n x", "word " * 5000, "the cat sat. " * 700, " lead", "trail "]


def test_ids_are_the_tokenizers(spark):
    plain, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    r = random.Random(5)
    more = ["".join(r.choice(["a", "Be", " ", " ", "\n", "é", "'", "s", "9", ".", " ", " "]) for _ in range(60)) for _ in range(400)]
    for t in [*(t or "" for t in TEXTS), *more]:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_fill_sequences(spark):
    texts = TEXTS * 5 + ["some words of a text " * k for k in range(1, 200, 3)]
    plain = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs(spark, texts), PATH, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert all(r.length == 1024 for r in own[1:]) and all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 1024
    assert packing.pack_documents(docs(spark, texts).limit(0), PATH).collect() == []


def test_plan_is_near_the_least():
    r = random.Random(8)
    for _ in range(30):
        histogram = Counter(r.randrange(1, r.choice([40, 400, 1025])) for _ in range(r.randrange(1, 3000)))
        fill, ranks = Counter(), Counter()
        for length, lo, hi, first, each, offset in packing.plan(histogram):
            assert lo == ranks[length]
            ranks[length] = hi
            for k in range(hi - lo):
                assert fill[first + k // each] == offset + k % each * length
                fill[first + k // each] += length
        assert ranks == histogram and max(fill.values()) <= 1024 and sorted(fill) == list(range(len(fill)))
        large = sum(c for n, c in histogram.items() if n > 512)
        least = max(large, -(-sum(n * c for n, c in histogram.items()) // 1024))
        assert len(fill) <= 1.15 * least + 1


def test_repeated_and_null_ids(spark):
    texts = ["some words of a text " * 300] * 4 + [None]
    rows = packing.pack_documents(docs(spark, texts, ids=[5, 5, None, None, 5]), PATH).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    each = Counter((r.doc_id, r.piece, r.start, r.length) for r in rows)
    assert sum(r.length for r in rows) == 4 * sum(n for (i, _, _, n), c in each.items() if i is None and c == 2) + 1
