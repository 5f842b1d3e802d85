import numpy as np

from tests.llm.helpers import crc, docs
from tidemark.llm import lang_id
from tidemark.llm.common import read

COLUMNS = "doc_id long, text string, lang string, letters int, held_out int, score int"


def rows(texts):
    """Documents of two made-up languages, and columns whose names the operator uses itself."""
    return [(i, t, lang, 1, 2, 3) for i, (t, lang) in enumerate(texts)]


def made(n):
    return [(("taka poru mina " if i % 2 else "strelz krzoch vwest ") * (1 + i % 9), "xx" if i % 2 else "yy") for i in range(n)]


def test_gradients_are_the_slopes():
    chance = np.random.default_rng(3)
    net = lang_id.initial(["a", "b", "c"], hidden=3)
    for layer in (net.forward, net.backward):
        layer.byte, layer.state, layer.out = (w.astype(np.float64) for w in (layer.byte, layer.state, layer.out))
    net.bias = net.bias.astype(np.float64)
    x = chance.integers(0, 256, (6, 5)).astype(np.uint8)
    there, label = np.arange(6)[:, None] < np.array([6, 4, 1, 6, 3]), np.array([0, 1, 2, 1, 0])
    _, found = lang_id.gradients(net, x, there, label)
    for w, slope in zip(net.weights(), found, strict=True):
        for at in zip(*np.nonzero(np.abs(slope) > 1e-4), strict=True):
            if chance.random() < 0.3:
                old, step = w[at], 1e-3
                w[at] = old + step
                up = lang_id.gradients(net, x, there, label)[0]
                w[at] = old - step
                down = lang_id.gradients(net, x, there, label)[0]
                w[at] = old
                assert abs((up - down) / (2 * step) - slope[at]) < 1e-4 + 1e-2 * abs(slope[at])


def test_pieces_side_by_side_are_read_as_alone(monkeypatch):
    net = lang_id.initial(["a", "b"])
    pieces = [b"x" * n + b"abc" for n in (0, 5, 125, 17, 60, 60)]
    monkeypatch.setattr(lang_id, "BATCH", 4)
    together = lang_id.positions(net, pieces)
    for piece, sums in zip(pieces, together, strict=True):
        assert np.allclose(lang_id.positions(net, [piece])[0], sums, atol=1e-3) and abs(sums.sum() - len(piece)) < 1e-2


def test_each_position_by_its_two_states():
    """The plain network, one piece and one position at a time."""
    net, piece = lang_id.initial(["a", "b", "c"]), b"one piece \xc3\xa9"
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(layer, text):
        h, out, n = np.zeros(lang_id.HIDDEN), [], lang_id.HIDDEN
        for byte in text:
            a, b = layer.byte[:, byte], layer.state @ h
            z, r = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :])
            out.append(h)
        return out

    total = np.zeros(3)
    for f, b in zip(states(net.forward, piece), states(net.backward, piece[::-1])[::-1], strict=True):
        e = np.exp(net.forward.out @ f + net.backward.out @ b)
        total += e / e.sum()
    assert np.allclose(total, lang_id.positions(net, [piece])[0], atol=1e-4)


def test_made_up_languages_and_edges(spark):
    texts = made(240) + [(None, "xx"), ("", "yy"), ("123 ...", "xx"), ("taka poru " * 20_000, None), ("strelz krzoch", None), ("П", None)]
    table = spark.createDataFrame(rows(texts) + rows(texts)[:3] + [(None, "mina taka", None, 1, 2, 3)], COLUMNS)
    got = lang_id.identify(table).collect()
    assert len(got) == len(texts) + 4
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert all(by[i].lang_pred == texts[i][1] for i in range(240))
    assert [(by[i].lang_pred, by[i].score) for i in (240, 241, 242)] == [("und", 0.0)] * 3
    assert (by[243].lang_pred, by[244].lang_pred, by[None].lang_pred) == ("xx", "yy", "xx") and by[245].lang_pred in ("xx", "yy")


def test_nothing_to_learn_from(spark):
    assert lang_id.identify(spark.createDataFrame([], COLUMNS)).collect() == []
    table = spark.createDataFrame([(1, "taka", None, 1, 2, 3), (2, None, "xx", 1, 2, 3)], COLUMNS)
    assert [(r.lang_pred, r.score) for r in lang_id.identify(table).collect()] == [("und", 0.0)] * 2


def test_held_out_labels_are_never_read(spark):
    texts = [(t, "zz" if crc(i) % 4 == 2 else lang) for i, (t, lang) in enumerate(made(120))]
    assert {r.lang_pred for r in lang_id.identify(spark.createDataFrame(rows(texts), COLUMNS)).collect()} == {"xx", "yy"}


def test_held_out_accuracy(spark):
    table = read(spark, "/root/testdata/sf0.01", "documents")
    got = lang_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) >= 0.985 * len(got)
