"""A probabilistic suffix tree over the bytes of a text's words, and the scores it gives.

A text is lower-cased (A-Z), its words are joined by single spaces, and END closes it; the sequence of words and the
string of bytes determine each other, so the string's probability is the sequence's. The tree has two parts.

Contexts of up to DEPTH bytes, which may reach into the word before, are counted over all training text. One is a
candidate if it makes up MIN_SHARE of all positions, which bounds their number at 1 / MIN_SHARE a length whatever the
corpus; it is retained if its next-byte distribution diverges from its suffix's by more than MIN_GAIN nats over all its
occurrences, or if a longer one is retained. This part is turned into an automaton that every task has, and pieces of
texts run through it side by side.

Longer contexts, of up to DEEPEST bytes, start where a word starts. They have no bound: each that occurs MIN_COUNT times
and whose distribution diverges from its longest suffix's in the first part by more than DEEP_GAIN nats is retained, so
this part grows with the corpus. It is spread over tasks by ranges of sorted words, where a context's words are next
to each other; the contexts of a range's first and last word, which other ranges may share, are added up over all
ranges (two words a range, at most DEEPEST contexts each). What such contexts change in a byte's log probability depends
on its word alone, so it is summed by word and reaches the texts with the word's count.

Distributions are smoothed by their longest suffix's (Witten-Bell), the empty context's by the uniform one, and a byte
is predicted by the longest retained suffix of what is before it.

Word counts for the base score: the FREQUENT most frequent words go to all tasks, the others meet in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc_bucket, cut, values

END = 10  # a line break, which no word holds; DEPTH of them stand before a text
DEPTH, MIN_SHARE, MIN_GAIN = 5, 1e-5, 10.0
DEEPEST, MIN_COUNT, DEEP_GAIN = 64, 2, 2.0
#: A word's end as a symbol, be it a space or END; words that a range of sorted words has, about.
STOP, RANGE_WORDS = 256, 250_000
FREQUENT = 200_000
#: Bytes that a text can hold once its words are joined: all but the separators other than space and END.
SYMBOLS = 252
#: Positions that a task handles at once, different words or strings that it gathers, bytes of a piece that is scored.
POSITIONS, GATHERED, PIECE = 1 << 20, 1 << 21, 256


def normal(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def _count_words(batches):
    """Words of texts, and how often training texts have them: 0 for words that only texts held out have."""
    count: Counter = Counter()

    def out():
        words = list(count)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([count[w] for w in words], pa.int64())], ["word", "n"])

    for batch in batches:
        for text, held_out in zip(values(batch.column(0).cast(pa.binary())), batch.column(1).to_pylist(), strict=True):
            words = (text or b"").lower().split()
            if held_out:
                count.update(dict.fromkeys(words, 0))
            else:
                count.update(words)
            if len(count) > GATHERED // 4:
                yield out()
                count.clear()
    if count:
        yield out()


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _grams(blob: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of DEPTH bytes and the next, and their counts; starts: where texts begin, DEPTH ends before each."""
    x = np.frombuffer(blob, dtype=np.uint8)
    code = np.zeros(len(x) - DEPTH, dtype=np.int64)
    for k in range(DEPTH + 1):
        code <<= 8
        code |= x[k : len(x) - DEPTH + k]
    real = np.ones(len(x), dtype=bool)
    for k in range(1, DEPTH + 1):
        real[starts - k] = False
    code = code[real[DEPTH:]]
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.append(first, len(code)))


def _stream(texts, most: int):
    """Texts with their ends in blobs of about `most` bytes; a longer text is cut, its parts overlap by DEPTH bytes."""
    parts, starts, size = [], [], 0
    pad = bytes([END]) * DEPTH
    for text in texts:
        body = pad + normal(text) + bytes([END])
        for at in range(0, max(1, len(body) - DEPTH), most):
            piece = body[at : at + most + DEPTH]
            parts.append(piece)
            starts.append(size + DEPTH)
            size += len(piece)
            if size >= most:
                yield b"".join(parts), np.array(starts)
                parts, starts, size = [], [], 0
    if parts:
        yield b"".join(parts), np.array(starts)


def _count_grams(batches):
    held: list = []
    total = 0

    def out(codes, counts):
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["code", "n"])

    for batch in batches:
        for blob, starts in _stream(values(batch.column(0).cast(pa.binary())), POSITIONS):
            held.append(_grams(blob, starts))
            total += len(held[-1][0])
            if total > GATHERED:
                held = [_merge(held)]
                total = len(held[0][0])
                if total > GATHERED // 2:
                    yield out(*held[0])
                    held, total = [], 0
    if held:
        yield out(*_merge(held))


@dataclass
class Model:
    """The automaton: for each state and class of bytes the next state, and the log10 probability of the byte."""

    classes: np.ndarray  # of each byte
    next_state: np.ndarray  # states x classes
    log_p: np.ndarray
    start: int
    contexts: int


def _automaton(counts: dict[bytes, dict[int, int]]) -> Model:
    """counts: next-byte counts of every retained context, suffixes and the empty one included."""
    seen = sorted(counts.get(b"", {}))
    classes = np.full(256, len(seen), dtype=np.int64)
    classes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    states = set(counts) | {b""}
    for s in list(states):
        states.update(s[:k] for k in range(len(s)))
    # suffixes of prefixes are states too, so that a state's longest proper suffix is its own without its first byte
    for s in list(states):
        states.update(s[k:] for k in range(1, len(s)))
    ordered = sorted(states, key=lambda s: (len(s), s))
    place = {s: i for i, s in enumerate(ordered)}
    p = np.empty((len(ordered), width))
    step = np.zeros((len(ordered), width), dtype=np.int32)
    longer: dict[bytes, list[bytes]] = {}
    for s in ordered[1:]:
        longer.setdefault(s[:-1], []).append(s)
    for i, s in enumerate(ordered):
        parent = place[s[1:]] if s else None
        below = np.full(width, 1 / SYMBOLS) if parent is None else p[parent]
        n = counts.get(s)
        if n:
            own = np.zeros(width)
            own[classes[list(n)]] = list(n.values())
            p[i] = (own + len(n) * below) / (own.sum() + len(n))
        else:
            p[i] = below
        if parent is not None:
            step[i] = step[parent]
        for t in longer.get(s, ()):
            step[i, classes[t[-1]]] = place[t]
    start = next(place[s] for k in range(DEPTH + 1) if (s := bytes([END]) * (DEPTH - k)) in place)
    return Model(classes, step, np.log10(p).astype(np.float32), start, len(counts))


def fit(texts: DataFrame) -> Model:
    """The suffix tree of all texts (one column); counted by task, added up by string, and cut before it is collected."""
    grams = texts.mapInArrow(_count_grams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    grams = cut(grams)
    total = grams.agg(F.sum("n")).first()[0] or 0
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("ctx")) for k in range(DEPTH + 1))))
    pairs = grams.select(levels.alias("c"), F.col("code").bitwiseAND(F.lit(255)).alias("sym"), "n")
    pairs = pairs.groupBy("c.k", "c.ctx", "sym").agg(F.sum("n").alias("n"))
    nodes = pairs.groupBy("k", "ctx").agg(F.sum("n").alias("total"), F.collect_list(F.struct("sym", "n")).alias("next"))
    nodes = cut(nodes.where(F.col("total") >= MIN_SHARE * total))
    up = nodes.select((F.col("k") + 1).alias("k"), F.col("ctx").alias("up"), F.col("total").alias("up_total"), F.map_from_entries("next").alias("up_next"))
    below = nodes.where("k > 0").withColumn("up", F.when(F.col("k") > 1, F.expr("ctx & (shiftleft(1L, 8 * (k - 1)) - 1)")).otherwise(F.lit(0)))
    each = lambda x: x["n"] * F.log(x["n"] / F.col("total") / (F.element_at("up_next", x["sym"]) / F.col("up_total")))
    gain = F.aggregate(F.transform("next", each), F.lit(0.0), lambda a, x: a + x)
    kept = below.join(up, ["k", "up"]).where(gain > MIN_GAIN).select("k", "ctx", "next")
    # candidates are bounded by MIN_SHARE, their counts by the bytes; the suffixes of those retained are among them
    table = {(r["k"], r["ctx"]): {x["sym"]: x["n"] for x in r["next"]} for r in kept.collect()}
    wanted = {(j, c & ((1 << 8 * j) - 1)) for k, c in table for j in range(k)} | {(0, 0)}
    if missing := wanted - set(table):
        by = texts.sparkSession.createDataFrame(sorted(missing), "k int, ctx long")
        table |= {(r["k"], r["ctx"]): {x["sym"]: x["n"] for x in r["next"]} for r in nodes.join(F.broadcast(by), ["k", "ctx"]).select("k", "ctx", "next").collect()}
    return _automaton({c.to_bytes(k, "big"): n for (k, c), n in table.items()})


def _suffix_states(model: Model, before: np.ndarray) -> np.ndarray:
    """The automaton's states after rows of DEPTH bytes."""
    state = np.zeros(len(before), dtype=np.int64)
    for j in range(DEPTH):
        state = model.next_state[state, model.classes[before[:, j]]]
    return state


def _below(model: Model, before: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The automaton's log10 probability of each symbol (a byte or STOP) after DEPTH bytes."""
    state = _suffix_states(model, before)
    stop = symbols == STOP
    log_p = model.log_p[state, model.classes[np.where(stop, END, symbols)]].astype(float)
    space = model.log_p[state, model.classes[32]].astype(float)
    return np.where(stop, np.log10(10**log_p + 10**space), log_p)


def _sorted_words(batches) -> tuple[list[bytes], np.ndarray]:
    words, counts = [], []
    for batch in batches:
        words += batch.column(0).to_pylist()
        counts.append(batch.column(1).to_numpy(zero_copy_only=False))
    return words, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def _edges(batches):
    """Symbol counts of the contexts of a range's first and last word, as far as the range has them."""
    words, counts = _sorted_words(batches)
    if not words:
        return
    found: dict[tuple[bytes, int], int] = {}
    for k in range(DEPTH, DEEPEST + 1):
        for context in {w[:k] for w in (words[0], words[-1]) if len(w) >= k}:
            # the words that a context starts are next to each other, at one end of the range
            ends = (range(len(words)), range(len(words) - 1, -1, -1))[not words[0].startswith(context)]
            for i in ends:
                if not words[i].startswith(context):
                    break
                symbol = words[i][k] if len(words[i]) > k else STOP
                found[context, symbol] = found.get((context, symbol), 0) + int(counts[i])
    contexts, symbols = zip(*found, strict=True) if found else ((), ())
    columns = [pa.array(contexts, pa.binary()), pa.array(symbols, pa.int32()), pa.array(found.values(), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["context", "sym", "n"])


def _gains(model: Model, words: list[bytes], counts: np.ndarray, edges: dict[bytes, dict[int, int]]) -> np.ndarray:
    """What contexts longer than DEPTH add to the log10 probability of each word; words are sorted and distinct.

    One context length at a time: words that share a context are a run, those that share the next byte too a run of it.
    """
    m = len(words)
    gain = np.zeros(m)
    if not m:
        return gain
    length = np.array([len(w) for w in words])
    width = DEEPEST + 1
    x = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(m, width)
    differ = x[1:] != x[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.concatenate([[0], np.minimum(shared, np.minimum(length[1:], length[:-1]))])
    active = np.arange(m)
    for k in range(DEPTH, DEEPEST + 1):
        active = active[length[active] >= k]
        if not len(active):
            break
        symbol = np.where(length[active] > k, x[active, k].astype(np.int64), STOP)
        new_context = shared[active] < k
        new_context[0] = True
        new_symbol = new_context | np.concatenate([[True], symbol[1:] != symbol[:-1]])
        first, head = np.flatnonzero(new_context), np.flatnonzero(new_symbol)
        n = np.add.reduceat(counts[active], head).astype(float)
        context_of = np.cumsum(new_context)[head] - 1
        begin = np.searchsorted(head, first)
        below = _below(model, x[active[head], k - DEPTH : k], symbol[head])

        def diverges(n, total, below):
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(n > 0, n * (np.log(n / total) - math.log(10) * below), 0.0)

        at_edge = {}
        for c in {0, len(first) - 1}:
            context = words[active[first[c]]][:k]
            if (known := edges.get(context)) is not None:
                own = slice(begin[c], begin[c + 1] if c + 1 < len(first) else len(head))
                n[own] = [known.get(int(y), 0) for y in symbol[head[own]]]
                at_edge[c] = (np.array(list(known)), np.array(list(known.values()), dtype=float), np.frombuffer(context[-DEPTH:], dtype=np.uint8))
        total, kinds = np.add.reduceat(n, begin), np.add.reduceat((n > 0).astype(float), begin)
        for c, (_, all_n, _) in at_edge.items():
            total[c], kinds[c] = all_n.sum(), (all_n > 0).sum()
        worth = np.add.reduceat(diverges(n, total[context_of], below), begin)
        for c, (symbols, all_n, before) in at_edge.items():
            worth[c] = diverges(all_n, total[c], _below(model, np.tile(before, (len(symbols), 1)), symbols)).sum()
        kept = (total >= MIN_COUNT) & (worth > DEEP_GAIN)
        sums, u = total[context_of], kinds[context_of]
        with np.errstate(divide="ignore", invalid="ignore"):
            more = np.where(kept[context_of], np.log10((n + u * 10**below) / (sums + u)) - below, 0.0)
        gain[active] += more[np.cumsum(new_symbol) - 1]
        # what is under a context that is too rare is too rare as well
        active = active[(total >= MIN_COUNT)[np.cumsum(new_context) - 1]]
    return gain


def deepen(words: DataFrame, shared) -> DataFrame:
    """word, n, gain: what the long contexts, learnt from all words' counts n, add to a word's log10 probability.

    words: distinct words and their counts, of which 0 learns nothing; shared: the broadcast automaton.
    """
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // RANGE_WORDS)
    ranges = cut(words.repartitionByRange(tasks, "word").sortWithinPartitions("word"))
    edges: dict[bytes, dict[int, int]] = {}
    found = ranges.mapInArrow(_edges, "context binary, sym int, n long").groupBy("context", "sym").agg(F.sum("n").alias("n"))
    for context, symbol, n in zip(*(c.to_pylist() for c in found.toArrow().columns), strict=True):
        edges.setdefault(bytes(context), {})[symbol] = n
    known = words.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        own, counts = _sorted_words(batches)
        gain = _gains(shared.value, own, counts, known.value)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(counts, pa.int64()), pa.array(gain)], ["word", "n", "gain"])

    return cut(ranges.mapInArrow(run, "word binary, n long, gain double"))


def log10_probabilities(texts: list[bytes | None], model: Model) -> np.ndarray:
    """The automaton's log10 probability of each whole text with its end, without what long contexts add."""
    width = model.next_state.shape[1]
    next_state, log_p = model.next_state.ravel(), model.log_p.ravel()
    score = np.zeros(len(texts))
    held: list[bytes] = []
    size = 0

    def run(blob: bytes, owner: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        x = model.classes[np.frombuffer(blob, dtype=np.uint8)].astype(np.int32)
        state = np.full(len(owner), model.start * width, dtype=np.int32)
        total = np.zeros(len(owner))
        widths = np.int32(width)
        longest = int(length[0])
        active = np.searchsorted(-length, -np.arange(longest), side="left")  # pieces longer than j
        for j in range(-DEPTH, longest):
            m = len(owner) if j < 0 else int(active[j])
            cell = state[:m] + x[begin[:m] + j]
            if j >= 0:
                total[:m] += log_p[cell]
            state[:m] = next_state[cell] * widths
        np.add.at(score, owner, total)

    parts: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        body = bytes([END]) * DEPTH + normal(text) + bytes([END])
        n = len(body) - DEPTH
        parts += [(i, size + DEPTH + s, min(PIECE, n - s)) for s in range(0, n, PIECE)]
        held.append(body)
        size += len(body)
        if size >= 2 * POSITIONS:
            run(b"".join(held), *(np.array(c) for c in zip(*parts, strict=True)))
            held, parts, size = [], [], 0
    if parts:
        run(b"".join(held), *(np.array(c) for c in zip(*parts, strict=True)))
    return score


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<binary>, score double"


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row's whole text.

    Held out are rows whose crc32(doc_id as text) mod folds is `held`; a null id counts as the empty text, a null text
    as empty, which is its end alone. Without training text every base probability is 1 and the tree is uniform. Repeated
    rows each count and get a row each; texts of any length are scored whole, in pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (crc_bucket(F.col(doc_id), folds) == held).alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")
    tree = spark.sparkContext.broadcast(fit(train))
    counted = rows.select("text", "held_out").mapInArrow(_count_words, "word binary, n long")
    words = deepen(cut(counted.groupBy("word").agg(F.sum("n").alias("n"))), tree)
    n_docs = train.count()
    sums = words.where("n > 0").agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    n_all, v = (sums["n"] or 0) + n_docs, sums["v"] + (n_docs > 0)
    unit = n_all + v + 1
    # steps of counts, 16 to a doubling; the highest steps that FREQUENT words fill are collected, unsorted
    step = F.floor(16 * F.log2("n")).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in words.where("n > 0").groupBy(step.alias("step")).count().collect()), reverse=True)
    lowest, room = math.inf, FREQUENT
    for at, size in sizes:
        if size > room:
            break
        lowest, room = at, room - size
    top = words.where(step >= lowest) if sizes and lowest < math.inf else words.limit(0)
    top_words, top_n, top_gain = top.select("word", "n", "gain").toArrow().columns
    frequent = {w: i for i, w in enumerate(top_words.to_pylist())}
    logs = np.log10((top_n.to_numpy() + 1) / unit)
    shared = spark.sparkContext.broadcast((frequent, np.stack([logs, top_gain.to_numpy()])))
    end_base = math.log10((n_docs + 1) / unit)

    def run(batches):
        (known, worth), model = shared.value, tree.value
        for batch in batches:
            ids, texts, held_out = (batch.column(k) for k in range(3))
            texts = texts.cast(pa.binary()).to_pylist()
            n_tokens, n_known, base, gain, rare = [], [], [], [], []
            for t in texts:
                w = (t or b"").lower().split()
                found = list(map(known.get, w))
                miss = [x for x, y in zip(w, found, strict=True) if y is None] if None in found else []
                n_tokens.append(len(w) + 1)
                n_known.append(len(w) - len(miss) + (n_docs > 0))
                logs, gains = worth[:, [y for y in found if y is not None]].sum(axis=1)
                base.append(logs + end_base)
                gain.append(gains)
                rare.append(miss)
            arrays = [batch.column(3), ids.cast(pa.int64()), held_out, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(rare, pa.list_(pa.binary())), pa.array(log10_probabilities(texts, model) + gain)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "score"])

    numbered = rows.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row"))
    scored = cut(numbered.mapInArrow(run, SCORED))
    rare = scored.select("row", F.explode("rare").alias("word")).join(words, "word", "left").select("row", "gain", F.coalesce("n", F.lit(0)).alias("c"))
    rare = rare.groupBy("row").agg(F.sum(F.log10((F.col("c") + 1) / F.lit(float(unit)))).alias("more"), F.sum((F.col("c") > 0).cast("long")).alias("more_known"), F.sum("gain").alias("more_gain"))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast(T.LongType()).alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_gain", F.lit(0.0))).alias("score"),
    )
