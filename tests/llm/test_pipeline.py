import corpus_pipeline
from tidemark.llm import pii
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        after = docs.count()
        assert (after < before) if name in ("toxicity", "simhash") else (after == before)
        before = after
    assert not any(pii.spans(r.text) for r in docs.select("text").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before


def test_mixture_orders_the_rows(spark, sf_dir):
    from tidemark.llm import mixing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slot = {r.doc_id: (r.slot, r.place) for r in mixing.mix(docs.select("doc_id", "source")).collect()}
    order = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()]
    assert len(order) == len(slot) and len({slot[i] for i in order}) == len(order)
    sources = {r.doc_id: r.source for r in docs.collect()}
    assert len({sources[i] for i in order[:160]}) > 10


def test_every_query_is_registered():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted([*(f"op{k}" for k in range(1, 14)), "pipeline"])
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_weights_reach_the_packed_rows(spark, sf_dir, monkeypatch):
    from functools import partial

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = []
    for sign in (1, -1):
        weights = {r.source: 2.0 ** (sign * int(r.source[3:]) / 4) for r in docs.select("source").distinct().collect()}
        mix = partial(corpus_pipeline.mix_sources, weights=weights)
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixing", mix), corpus_pipeline.STAGES[-1]])
        place = {r.doc_id: i for i, r in enumerate(mix(spark, docs, sf_dir).select("doc_id").collect())}
        rows = corpus_pipeline.run(spark, sf_dir).collect()
        heads = {r.sequence_id: (place[r.doc_id], r.piece) for r in rows if r.offset == 0}
        assert sorted(heads) == list(range(len(heads))) and [heads[q] for q in sorted(heads)] == sorted(heads.values())
        packed.append({tuple(r) for r in rows})
    assert packed[0] != packed[1] and len(packed[0]) == len(packed[1])


def test_stages_take_nulls_extra_columns_and_empty_tables(spark, sf_dir, tmp_path):
    from tests.llm.helpers import docs

    odd = [None, "", "plain words " * 60, "plain words " * 60, "mail bob@host.org now", "x " * 40_000]
    for rows in (docs(spark, odd, ids=[None, 1, 2, 3, None, 5]), docs(spark, odd).limit(0)):
        folder = f"{tmp_path}/{rows.count()}"
        rows.write.parquet(f"{folder}/docs")
        table = spark.read.parquet(f"{folder}/docs")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, table, sf_dir).write.parquet(f"{folder}/{name}")
            table = spark.read.parquet(f"{folder}/{name}")
            assert table.columns == rows.columns
        ids = sorted((r.doc_id or 0) for r in table.collect())
        # the two without a word are one group, and so are the two that are equal; a group without an id keeps a row
        assert ids == ([0, 1, 2, 5] if rows.count() else [])
        packed = corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).collect()
        assert sorted({r.doc_id or 0 for r in packed}) == ids


def test_pipeline_rows_are_those_of_a_plain_version(spark, sf_dir, tmp_path):
    """Toxicity by the examples' own neighbours is held to texts in its test; here the other stages' rows and texts."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.helpers import fingerprint, grouped

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, table, sf_dir)
    kept.write.parquet(f"{tmp_path}/toxicity")
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/toxicity").collect()}
    ids = sorted(rows)
    first = set(grouped(ids, [fingerprint(rows[i]) for i in ids]).values())
    clean = {i: pii.redact(rows[i] or "", pii.spans(rows[i] or "")) for i in first}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    got: dict = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    fill: dict = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and np.sum(list(fill.values())) == sum(want.values())
