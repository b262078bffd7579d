"""Registered queries against their SQL twins, and the pipeline against a plain version of each stage."""

from __future__ import annotations

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from fenland.llm import decontamination, queries
from fenland.llm.common import read
from llm_brute import groups, sets_of

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cursor = con.execute(queries.ORACLES[name])
        names = [d[0] for d in cursor.description]
        want = cursor.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*names).collect())


def one_of_each(rows: list) -> list:
    """Brute force over all pairs: of each class of near copies the row with the smallest id."""
    sets = [sets_of(r.text) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    return [r for k, (r, root) in enumerate(zip(rows, groups(len(rows), links), strict=True)) if root == k]


def test_pipeline_stages(spark, tmp_path):
    docs, steps = read(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(docs)
    columns = read(spark, SF, "documents").columns
    assert all(step.columns == columns for step in steps[:-1])

    good = sorted(steps[0].collect(), key=lambda r: r.doc_id)
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in good}
    known = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(known) / len(known) > 0.9

    one = one_of_each(good)
    assert {r.doc_id for r in steps[1].collect()} == {r.doc_id for r in one}

    items = [t for r in read(spark, SF, "benchmark").collect() if (t := decontamination.normal(r.text))]
    clean = [r for r in one if not any(decontamination.normal(t) in decontamination.normal(r.text) for t in items)]
    left = {r.doc_id for r in steps[2].collect()}
    assert left <= {r.doc_id for r in clean}  # items with edits go too
    for r in clean:
        if r.doc_id not in left:
            text = decontamination.normal(r.text)
            assert any(decontamination.Pattern(t).least(text, 0) <= len(t) // decontamination.CHARS_PER_EDIT for t in items)

    before = {r.doc_id: r.text for r in steps[2].collect()}
    for r in steps[3].collect():
        assert r.n_chars == len(r.text)
        if "[secret]" not in r.text:
            assert r.text == before[r.doc_id]
        for part in r.text.split("[secret]"):
            assert part in before[r.doc_id]

    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    texts = {r.doc_id: r.text for r in steps[3].collect()}
    last = steps[4].collect()
    assert len(last) == len(texts)
    for r in last:
        assert list(r.ids) == [*library.encode(texts[r.doc_id]), 2] and r.decoded == library.decode(list(r.ids))


def test_stages_keep_the_values_of_clashing_columns(spark, odd_docs, odd_folder):
    """Columns named like the operators' own keep type and value; the text alone may change, and n_chars with it."""
    own = ["hits", "base_spans", "all_spans", "_hits", "_base", "_spans", "_covered", "_kept_id", "_kept_key", "kept", "count", "score"]
    clash = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.md5("text"), F.lit("none"))).alias(c) for c in own])
    before = sorted(repr(tuple(r)) for r in clash.select("doc_id", "lang", "source", *own).collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, odd_folder)
        assert out.schema.simpleString() == clash.schema.simpleString(), name
        after = [repr(tuple(r)) for r in out.select("doc_id", "lang", "source", *own).collect()]
        assert set(after) <= set(before) and all(after.count(r) <= before.count(r) for r in after), name
        if name == "secret scans":
            assert sorted(after) == before


def test_stages_with_odd_rows(spark, odd_docs, odd_folder):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, odd_folder)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == odd_docs.columns
        assert stage(spark, odd_docs.limit(0), odd_folder).count() == 0
        out.count()
