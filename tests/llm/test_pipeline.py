"""The pipeline, stage by stage against brute force, and the registered queries."""

import importlib.util

import pytest

import corpus_pipeline
from checks.compare import database, difference
from nearwave.llm import queries
from nearwave.llm.compression_rules import quality_rules
from nearwave.workdir import new_folder
from tests.llm.odd_texts import ODD_TEXTS
from tests.llm.test_compression_rules import prose
from tests.llm.test_decontaminate import brute_force
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash_dedup import plain_components, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after every stage, over the smallest tables and odd rows."""
    folder = new_folder(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [(10_000 + i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)] + [(None, prose(80), None, "s", None)] * 2
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs.write.parquet(f"{folder}/in")
    seen = [spark.read.parquet(f"{folder}/in")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF_DIR).write.parquet(f"{folder}/{k}")
        seen.append(spark.read.parquet(f"{folder}/{k}"))
    return [(df, df.collect()) for df in seen]


def keys(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)


def test_quality_stage(stages):
    (docs, before), (_, after) = stages[:2]
    kept = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    assert keys(after) == keys(r for r in before if r.doc_id in kept)
    assert len(after) < len(before)


def test_line_stage(stages):
    (_, before), (_, after) = stages[1:3]
    want = plain_lines([(r.doc_id, r.source, r.text) for r in before], copies=False)
    assert keys(after) == sorted((d is None, d or 0, t or "") for d, _, t, _ in want)


def test_near_stage(stages):
    (_, before), (_, after) = stages[2:4]
    groups = plain_components([plain_fingerprint(r.text) for r in before])
    least = {}
    for r, g in zip(before, groups):
        rank = (r.doc_id is None, r.doc_id or 0)
        least[g] = min(least.get(g, rank), rank)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted(least.values())
    assert len(after) < len(before)


def test_leak_stage(spark, stages):
    (_, before), (_, after) = stages[3:5]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    found = {i for i, _ in brute_force({k: r.text for k, r in enumerate(before)}, items)}
    assert found and keys(after) == keys(r for k, r in enumerate(before) if k not in found)


def test_last_stage(stages):
    (_, before), (_, after) = stages[4:6]
    assert keys(after) == keys(before) and all(len(r.piece_ids) > 0 for r in after)


def test_columns(stages):
    for df, _ in stages[:5]:
        assert df.dtypes == stages[0][0].dtypes


def test_run_is_all_stages(spark, stages):
    small = {(r.doc_id, r.text) for r in stages[-1][1] if r.doc_id is not None and r.doc_id < 10_000}
    assert {(r.doc_id, r.text) for r in corpus_pipeline.run(spark, SF_DIR).collect()} == small


@pytest.mark.parametrize("name", list(queries.all_sql()))
def test_queries_agree_with_sql(spark, name):
    rows, problem = difference(queries.all_queries()[name](spark, SF_DIR), database(SF_DIR), queries.all_sql()[name])
    assert problem is None and rows > 0


def test_all_are_registered():
    import __spark_entry__

    assert set(queries.all_queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert importlib.util.find_spec("corpus_pipeline")
