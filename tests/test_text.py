import math

import pytest

from nearwave.operators import prepare, profile
from nearwave.operators.blocks import as_queries
from nearwave.plans import jobs
from nearwave.sources import tables, text
from nearwave.sources.tables import last_per_id
from nearwave.workdir import new_folder

LINES = [
    "7\t1.5,2.0,0.0",
    "8\t1.5,2.0",
    "7\t9.0,9.5,-1e-3",
    "9\t1.5,x,0.0",
    "10\t1.5,NaN,0.0",
    "eleven\t1.0,2.0,3.0",
    "12",
    "13\t",
]


@pytest.fixture
def parsed(spark):
    return text.parse_series(spark.createDataFrame([(x,) for x in LINES], "value STRING").coalesce(1))


def test_bad_lines_are_rejected(parsed):
    series, rejects = parsed
    assert {r.id for r in series.collect()} == {7, 8}
    assert {r.value for r in rejects.collect()} == set(LINES[3:])


def test_later_line_replaces_earlier(parsed):
    rows = {r.id: r.v for r in tables.last_per_id(parsed[0]).collect()}
    assert rows == {7: [9.0, 9.5, -0.001], 8: [1.5, 2.0]}


def test_length_violations(parsed):
    series = tables.last_per_id(parsed[0])
    found = profile.length_violations(series).collect()
    assert [(r.id, r.n, r.expected) for r in found] == [(8, 2, 3)]
    with pytest.raises(Exception, match="series 8 has 2 values"):
        profile.length_violations(series, strict=True).collect()


def test_text_roundtrip(spark, series_of):
    values = {1: [0.1, 1e-7, -1e22, 1 / 3], -5: [4.0]}
    path = new_folder(spark, "lines")
    text.write_series_text(series_of(values), path)
    series, rejects = text.read_series_text(spark, path)
    assert {r.id: r.v for r in series.collect()} == values
    assert rejects.count() == 0


def test_query_points(spark):
    texts = spark.createDataFrame([(1, "2,0.5#5,-3#11,40"), (2, "4,-1.5"), (3, "1,x"), (4, "-1,2"), (5, ""), (6, "1,Infinity")], "qid BIGINT, points STRING")
    queries, rejects = text.parse_query_points(texts)
    assert {r.qid: (r.pos, r.q) for r in queries.collect()} == {1: ([2, 5, 11], [0.5, -3, 40]), 2: ([4], [-1.5])}
    assert {r.qid for r in rejects.collect()} == {3, 4, 5, 6}


@pytest.mark.parametrize("sep, value_sep", [("|", ":"), ("\\E", "->"), ("]", "$")])
def test_query_points_with_other_separators(series_of, sep, value_sep):
    queries = as_queries(series_of({3: [7.0, 8.0]}))
    lines = text.format_query_points(queries, sep, value_sep)
    row = text.parse_query_points(lines, sep=sep, value_sep=value_sep)[0].first()
    assert (row.pos, row.q) == ([0, 1], [7.0, 8.0])


def test_envelopes(spark, series_of):
    series = series_of({i: [i, i + 2.5, -i] for i in range(20)})
    path = new_folder(spark, "envelopes")
    fraction = jobs.sample_envelopes(series, path, 1000, text=True)
    assert fraction == 1.0
    rows = text.read_envelopes_text(spark, path).collect()
    assert sorted((r.smax, r.smin) for r in rows) == sorted((i + 2.5, float(-i)) for i in range(20))


def test_later_lines_of_later_files_win(spark, tmp_path):
    """Files of unlike size, which Spark reads in another order than they are named."""
    for name, value, more in (("a", 1, 10), ("b", 2, 3000), ("c", 3, 0), ("d", 4, 40)):
        lines = [f"7\t{value}.0,0.0"] if name != "d" else []
        lines += [f"{100 + i}\t{value}.0,{i}.0" for i in range(more)] + (["8\t1.0", f"8\t{value}.0"] if name == "b" else [])
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    series, rejects = text.read_series_text(spark, str(tmp_path))
    last = {r.id: r.v for r in last_per_id(series).collect()}
    assert (last[7], last[8], last[101], last[150]) == ([3.0, 0.0], [2.0], [4.0, 1.0], [2.0, 50.0])
    assert rejects.count() == 0


def test_rejected_lines_are_kept(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1\t1,2\nx\t1\n2\t1,NaN\n3\t-Infinity\n")
    assert jobs.clean_text(spark, str(tmp_path), f"{tmp_path}/out") == 3
    assert {r.value for r in spark.read.text(f"{tmp_path}/out.rejects").collect()} == {"x\t1", "2\t1,NaN", "3\t-Infinity"}


def test_dense_ids_skip_empty_series(series_of):
    grown = prepare.augment_dense(series_of({4: [1.0, 2.0], 5: [], 9: [3.0]}), 1)
    assert {r.id for r in grown.collect()} == {1, 2, 3, 4}
    twice = series_of({4: [1.0]}).unionAll(series_of({4: [2.0]}))
    with pytest.raises(ValueError, match="unique"):
        prepare.augment_dense(twice, 1)


def test_jobs_write_where_told(spark, series_of):
    source, target = new_folder(spark, "in"), new_folder(spark, "out")
    text.write_series_text(series_of({1: [0, 2, 4], 2: [0, 0, 0]}), source)
    jobs.clean_text(spark, source, target)
    cleaned, _ = text.read_series_text(spark, target)
    assert {r.id: r.v for r in cleaned.collect()} == {1: [0, 2, 4]}
    path = jobs.augment_text(cleaned, target, 2, 1)
    assert path == f"{target}_3_6"
    grown, _ = text.read_series_text(spark, path)
    assert {r.id for r in grown.collect()} == {1, 2, 3}


def test_profile(series_of):
    row = profile.profile_series(series_of({2: [1, -4.5], 5: [3, 2]})).first()
    assert (row.n_rows, row.n_dims, row.min_len, row.max_len, row.gmax, row.gmin) == (2, 2, 2, 2, 3.0, -4.5)
    assert math.isclose(row.gmax, 3.0)
