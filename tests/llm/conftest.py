import pytest


@pytest.fixture(autouse=True, scope="session")
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster would name itself."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def docs_of(spark):
    """``documents`` of a list of texts, or of (doc_id, text) pairs, with a source."""

    def make(rows, source="s", partitions=3):
        rows = [(i, r) if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        data = [(i, t, "en", source, None if t is None else len(t)) for i, t in rows]
        schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
        return spark.createDataFrame(data, schema).repartition(partitions)

    return make
