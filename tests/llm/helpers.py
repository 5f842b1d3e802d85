"""Small tables and plain versions of the corpus operators."""

import re
import zlib
from itertools import combinations

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, length int, rank int"


def docs(spark, texts, sources=None, ids=None):
    """A table of documents with some columns whose names the operators use themselves."""
    rows = [((ids or range(len(texts)))[i], t, "en", (sources or ["a", "b"])[i % len(sources or "ab")], len(t or ""), 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = words(lower(text))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids, prints, bits=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            root[find(j)] = find(i)
    out = {}
    for i in range(len(ids)):
        members = [ids[j] for j in range(len(ids)) if find(j) == find(i) and ids[j] is not None]
        out[i] = min(members) if members else None
    return out


def without_repeats(texts, length=400):
    """(removed bytes, runs, kept) of each text, by a table of all strings of that length."""
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), kept))
    return out


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
