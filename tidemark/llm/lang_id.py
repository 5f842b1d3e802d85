"""Language identification: a bidirectional gated recurrent network over bytes that labels every position of a text.

A text is cut into pieces of PIECE bytes, and each piece is read from both ends: a forward and a backward layer of HIDDEN
gated units (update, reset, candidate) start at zero, and both states at a position give the probabilities of the
languages there. A document's probabilities are the means over all positions of all its pieces. Pieces of many texts run
side by side, sorted by length, so that a step works on those that are still going.

The network is trained with numpy, by backpropagation through time and Adam, on a bounded sample: SAMPLE documents of each
language at most, those with the smallest hashes of their ids, and PIECES pieces of TRAINED bytes of each. The loss is the
cross entropy at every position. Weights are drawn from a fixed seed, so training is the same in every run. It is
broadcast as a few thousand numbers; texts are read once, by one narrow job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_bucket, slices, values

PIECE, HIDDEN, BATCH = 128, 8, 2048
#: The bounded sample that the network learns from.
SAMPLE, PIECES, TRAINED = 400, 4, 64
EPOCHS, LEARNING, ROWS = 8, 0.02, 256
UNKNOWN = "und"


@dataclass
class Layer:
    """What a byte adds to the gates (3 * hidden x 256), what the state adds, and what the state says of the languages."""

    byte: np.ndarray
    state: np.ndarray
    out: np.ndarray


@dataclass
class Network:
    languages: list[str]
    forward: Layer
    backward: Layer
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [x for layer in (self.forward, self.backward) for x in (layer.byte, layer.state, layer.out)] + [self.bias]


def initial(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    chance = np.random.default_rng(seed)
    draw = lambda *shape: (chance.standard_normal(shape) / np.sqrt(shape[-1] if shape[-1] != 256 else hidden)).astype(np.float32)
    layers = [Layer(draw(3 * hidden, 256), draw(3 * hidden, hidden), draw(len(languages), hidden)) for _ in range(2)]
    return Network(languages, *layers, np.zeros((len(languages), 1), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _step(layer: Layer, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of a layer for the bytes x from states h: gates (update and reset), what the state adds to the candidate, candidate, new state."""
    hidden = h.shape[0]
    own, carried = layer.byte[:, x], layer.state @ h
    gates = _sigmoid(own[: 2 * hidden] + carried[: 2 * hidden])
    candidate = np.tanh(own[2 * hidden :] + gates[hidden:] * carried[2 * hidden :])
    return gates, carried[2 * hidden :], candidate, candidate + gates[:hidden] * (h - candidate)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=0))
    return x / x.sum(axis=0)


def positions(net: Network, pieces: list[bytes]) -> np.ndarray:
    """For each piece, the sums over its positions of the languages' probabilities."""
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    total = np.zeros((len(pieces), len(net.languages)))
    for at in range(0, len(order), BATCH):
        own = order[at : at + BATCH]
        length = np.array([len(pieces[i]) for i in own])
        t_end, n = int(length[0]), len(own)
        x = np.frombuffer(b"".join(pieces[i].ljust(t_end, b"\0") for i in own), np.uint8).reshape(n, t_end).T
        alive = np.searchsorted(-length, -np.arange(t_end), side="left")  # pieces of over t bytes
        said = np.empty((t_end, len(net.languages), n), np.float32)
        h = np.zeros((len(net.forward.state[0]), n), np.float32)
        for t in range(t_end):
            m = alive[t]
            h = _step(net.forward, x[t, :m], h[:, :m])[3]
            said[t, :, :m] = net.forward.out @ h
        h = np.zeros((len(net.forward.state[0]), n), np.float32)
        summed = np.zeros((len(net.languages), n), np.float32)
        for t in range(t_end - 1, -1, -1):
            m = alive[t]
            h[:, :m] = new = _step(net.backward, x[t, :m], h[:, :m])[3]
            summed[:, :m] += _softmax(said[t, :, :m] + net.backward.out @ new + net.bias)
        total[own] = summed.T
    return total


def gradients(net: Network, x: np.ndarray, there: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross entropy over the positions that are there (steps x rows), and its gradient for each weight.

    x: bytes, steps x rows; label: the language's number of each row. A row's bytes come before its padding.
    """
    steps, n = x.shape
    layers, seen = (net.forward, net.backward), []
    hidden = net.forward.state.shape[1]
    for layer, times in zip(layers, (range(steps), range(steps - 1, -1, -1)), strict=True):
        h, kept = np.zeros((hidden, n), np.float32), {}
        for t in times:
            gates, carried, candidate, new = _step(layer, x[t], h)
            new = np.where(there[t], new, h)
            kept[t] = (h, gates, carried, candidate, new)
            h = new
        seen.append(kept)
    many = max(1, int(there.sum()))
    loss, found = 0.0, [np.zeros_like(w) for w in net.weights()]
    error = []
    for t in range(steps):
        p = _softmax(sum(layer.out @ kept[t][4] for layer, kept in zip(layers, seen, strict=True)) + net.bias)
        loss -= float(np.log(p[label, np.arange(n)][there[t]] + 1e-30).sum())
        p[label, np.arange(n)] -= 1
        error.append(p * there[t] / many)
        found[6] += error[t].sum(axis=1, keepdims=True)
    for i, (layer, kept, times) in enumerate(zip(layers, seen, (range(steps - 1, -1, -1), range(steps)), strict=True)):
        back = np.zeros((hidden, n), np.float32)
        for t in times:
            h, gates, carried, candidate, new = kept[t]
            z, r = gates[:hidden], gates[hidden:]
            found[3 * i + 2] += error[t] @ new.T
            back = back + layer.out.T @ error[t]
            own = back * there[t]
            to_candidate = own * (1 - z) * (1 - candidate**2)
            to_gates = np.concatenate([own * (h - candidate), to_candidate * carried]) * gates * (1 - gates)
            to_state = np.concatenate([to_gates, to_candidate * r])
            found[3 * i + 1] += to_state @ h.T
            for g, row in enumerate(np.concatenate([to_gates, to_candidate])):
                found[3 * i][g] += np.bincount(x[t], row, 256)
            back = back * ~there[t] + own * z + layer.state.T @ to_state
    return loss / many, found


def train(texts: list[tuple[str, bytes]], languages: list[str] | None = None, epochs: int = EPOCHS) -> Network:
    """A network from (language, piece); pieces of every language count alike, whatever their number."""
    languages = sorted({lang for lang, _ in texts}) if languages is None else languages
    net, chance = initial(languages), np.random.default_rng(11)
    number = {lang: i for i, lang in enumerate(languages)}
    texts = [(number[lang], piece) for lang, piece in texts if piece]
    weights, steps = net.weights(), 0
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    batches = -(-len(texts) // ROWS)
    for epoch in range(epochs):
        order = chance.permutation(len(texts))
        for at in range(0, len(order), ROWS):
            own = [texts[i] for i in order[at : at + ROWS]]
            length = np.array([len(p) for _, p in own])
            x = np.frombuffer(b"".join(p.ljust(length.max(), b"\0") for _, p in own), np.uint8).reshape(len(own), -1).T
            _, slope = gradients(net, x, np.arange(len(x))[:, None] < length, np.array([k for k, _ in own]))
            steps += 1
            size = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in slope)))
            rate = LEARNING * (1 - (steps - 1) / (epochs * batches))
            for w, g, m, s in zip(weights, slope, mean, square, strict=True):
                g = g / max(1.0, size)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-6)
    return net


def cut_up(text: bytes, size: int = PIECE) -> list[bytes]:
    text = text.lower()
    return [text[at : at + size] for at in range(0, len(text), size)]


def spread(text: bytes, pieces: int = PIECES, size: int = TRAINED) -> list[bytes]:
    """Pieces at even distances, the first at the start and the last at the end of a text."""
    text = text.lower()
    last = max(0, len(text) - size)
    return [text[at : at + size] for at in sorted({last * k // max(1, pieces - 1) for k in range(pieces)})]


def _sampled(batches):
    for batch in slices(batches):
        rows = [(lang, h, k, p) for lang, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values(batch.column(2).cast(pa.binary())), strict=True) for k, p in enumerate(spread(text))]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["lang", "h", "k", "piece"])


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, piece) of up to SAMPLE documents a language, in a fixed order: at most SAMPLE * PIECES pieces a language.

    Rows are first thinned out to about three times as many by a hash of their ids, so that only a bounded number of a
    language meet in one task; of rows with equal ids one is taken. Null languages and null or empty texts are left out.
    """
    from pyspark.sql import Window as W

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(doc_id).alias("h"), F.col(text).alias("text"))
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not many:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in sorted(many.items()) for x in (lang, min(1_000_000, 3_000_000 * SAMPLE // n + 1))))
    rows = rows.where((F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")]) & (F.length("text") > 0))
    rows = rows.groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= SAMPLE)
    found = few.select("lang", "h", "text").mapInArrow(_sampled, "lang string, h long, k int, piece binary").collect()
    return [(lang, bytes(piece)) for lang, _, _, piece in sorted(map(tuple, found))]


def _predict(net: Network):
    def run(batches):
        for batch in slices(batches):
            sums, sizes = np.zeros((batch.num_rows, len(net.languages))), np.zeros(batch.num_rows)
            pieces: list[bytes] = []
            own: list[int] = []
            for i, (text, letters) in enumerate(zip(values(batch.column("text").cast(pa.binary())), batch.column("letters").to_pylist(), strict=True)):
                if not letters:
                    continue
                sizes[i] = len(text)
                for piece in cut_up(text):
                    pieces.append(piece)
                    own.append(i)
                    if len(pieces) == 4 * BATCH:
                        np.add.at(sums, own, positions(net, pieces))
                        pieces, own = [], []
            if pieces:
                np.add.at(sums, own, positions(net, pieces))
            best = sums.argmax(axis=1)
            said = [net.languages[k] if n else UNKNOWN for k, n in zip(best, sizes, strict=True)]
            score = np.where(sizes > 0, np.clip(sums[np.arange(len(best)), best] / np.maximum(sizes, 1), 0, 1), 0).round(6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; learnt from rows whose crc32(doc_id as text) mod 4 isn't 2.

    lang_pred is one of the languages learnt, score the mean probability of its positions. It is `und` with the score 0
    for a null text, one without a letter, and where there is nothing to learn from. Ties go to the language that is
    first by name. Texts of any length are read whole, in pieces; repeated rows each get their row; a null id counts as
    the empty text. Other columns aren't read, and lang isn't read for a prediction.
    """
    held_out = crc_bucket(F.col(doc_id), 4) == 2
    pieces = sample(docs.where(~held_out), doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not pieces:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(_predict(train(pieces)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
