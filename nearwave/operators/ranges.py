"""Range scans of a block index and the filters behind them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import inf, isinf, nextafter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwave.functions.arrow import flat_lists
from nearwave.functions.distance import value_blocks_bound
from nearwave.operators.scan import Query, distances
from nearwave.sources.tables import BlockIndex, UnstoredIndex

# Ranges written into a scan filter, over all its time blocks.  What does not fit is
# replaced by a hull: the exact test follows in the join.
MAX_RANGES = 128

# Envelopes of the queried points of one value block.  ``fmx``/``fmn`` repeat them if the
# query covers every stored position of that block and are null otherwise.
_ENVELOPE = pa.struct([(name, pa.float64()) for name in ("mx", "mn", "fmx", "fmn")])
_QUERY_BLOCK_SCHEMA = pa.schema(
    [
        ("qid", pa.int64()),
        ("tb", pa.int32()),
        ("n_tb", pa.int32()),
        ("radius", pa.float64()),
        ("last", pa.int32()),
        ("q_hi", pa.float64()),
        ("q_lo", pa.float64()),
        ("env", _ENVELOPE),
        ("qvb", pa.list_(_ENVELOPE)),
    ]
)


def stored_len(index: BlockIndex | UnstoredIndex, tb: int) -> int:
    """Values stored in a time block, as far as the index knows it."""
    if index.uniform_len is None:
        return index.t_len
    return max(0, min(index.t_len, index.uniform_len - tb * index.t_len))


def _envelope(offs: np.ndarray, vals: np.ndarray, stored: int) -> dict:
    hi, lo = float(vals.max()), float(vals.min())
    full = len(np.unique(offs)) == stored
    return {"mx": hi, "mn": lo, "fmx": hi if full else None, "fmn": lo if full else None}


def query_block_rows(queries: list[Query], index: BlockIndex | UnstoredIndex, radius: dict[int, float]) -> list[dict]:
    """One row per query and touched time block, with its value blocks and points."""
    t_len, v_len = index.t_len, index.v_len
    rows: list[dict] = []
    for q in queries:
        block_of = q.pos // t_len
        touched = np.unique(block_of)
        for tb in touched:
            inside = block_of == tb
            offs, vals = q.pos[inside] % t_len, q.q[inside]
            stored = stored_len(index, int(tb))
            qvb: list[dict | None] = []
            for start in range(0, int(offs.max()) + 1, v_len):
                here = (offs >= start) & (offs < start + v_len)
                in_block = min(v_len, stored - start)
                qvb.append(_envelope(offs[here], vals[here], in_block) if here.any() else None)
            rows.append(
                {
                    "qid": q.qid,
                    "tb": int(tb),
                    "n_tb": len(touched),
                    "radius": float(radius[q.qid]),
                    "last": int(offs.max()),
                    "q_hi": q.hi,
                    "q_lo": q.lo,
                    "env": _envelope(offs, vals, stored),
                    "qvb": qvb,
                    "offs": offs,
                    "vals": vals,
                }
            )
    return rows


def _ranges(row: dict, per_block: bool) -> tuple[float, float, float, float]:
    """Allowed (tmax from, tmax to, tmin from, tmin to) for one query block.

    Widened by a rounding step: the exact test is repeated on the rows as a difference.
    """

    def down(x: float) -> float:
        return nextafter(x - row["radius"], -inf)

    def up(x: float) -> float:
        return nextafter(x + row["radius"], inf)

    if not per_block:
        return down(row["q_lo"]), up(row["q_hi"]), -inf, inf
    env = row["env"]
    if env["fmx"] is None:
        return down(env["mx"]), inf, -inf, up(env["mn"])
    return down(env["mx"]), up(env["mx"]), down(env["mn"]), up(env["mn"])


def _merged(ranges: list[tuple[float, float]], most: int) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out if len(out) <= most else [(out[0][0], out[-1][1])]


def _between(column: str, lo: float, hi: float) -> Column | None:
    tests = []
    if not isinf(lo):
        tests.append(F.col(column) >= lo)
    if not isinf(hi):
        tests.append(F.col(column) <= hi)
    return reduce(lambda a, b: a & b, tests) if tests else None


def _all(tests: list[Column | None]) -> Column | None:
    tests = [t for t in tests if t is not None]
    return reduce(lambda a, b: a & b, tests) if tests else None


def scan_filter(rows: list[dict], per_block: bool = True) -> Column:
    """The part of the range test that is known before the scan, as literals.

    Spark turns ``tb_dir`` into a partition filter and the rest into Parquet row-group
    filters; ``tb`` is also stored as a column so that each range stays tied to its block.
    """
    by_tb: dict[int, list[tuple[float, float, float, float]]] = {}
    for row in rows:
        by_tb.setdefault(row["tb"], []).append(_ranges(row, per_block))
    dirs = F.col("tb_dir").isin(sorted(by_tb)) if by_tb else F.lit(False)
    if len(by_tb) > MAX_RANGES:
        every = [r for ranges in by_tb.values() for r in ranges]
        tmax = _between("tmax", min(r[0] for r in every), max(r[1] for r in every))
        tmin = _between("tmin", min(r[2] for r in every), max(r[3] for r in every))
        return _all([dirs, tmax, tmin])
    most = MAX_RANGES // max(1, len(by_tb))
    choices = []
    for tb, ranges in sorted(by_tb.items()):
        hulls = [_between("tmax", lo, hi) for lo, hi in _merged([r[:2] for r in ranges], most)]
        any_max = None if any(h is None for h in hulls) else reduce(lambda a, b: a | b, hulls)
        tmin = _between("tmin", min(r[2] for r in ranges), max(r[3] for r in ranges))
        choices.append(_all([F.col("tb") == tb, any_max, tmin]))
    return dirs & reduce(lambda a, b: a | b, choices) if choices else dirs


def _broadcast_rows(index: BlockIndex | UnstoredIndex, rows: list[dict]) -> DataFrame:
    """The query blocks of one pack as table ``q``: a pack's points are bounded."""
    names = _QUERY_BLOCK_SCHEMA.names
    table = pa.Table.from_pylist([{n: r[n] for n in names} for r in rows], _QUERY_BLOCK_SCHEMA)
    return F.broadcast(index.spark.createDataFrame(table)).alias("q")


def block_candidates(
    index: BlockIndex | UnstoredIndex, rows: list[dict], per_block: bool = True, block_filter: bool = False
) -> DataFrame:
    """Block rows in range of a query block, joined with that query block.

    ``per_block=True`` compares with the envelope of the query's own points in the block
    (one-sided where the block is only partly queried).  ``False`` is the wider test on
    the whole query's envelope, for queries that cover whole blocks.
    ``block_filter`` also drops rows whose value-block bound exceeds the radius.

    All tests form one join condition, cheap ones first, so that a pair that fails is
    never a row.
    """
    stored = index.blocks.filter(scan_filter(rows, per_block)).drop("tb_dir").alias("b")
    near = (F.col("b.tb") == F.col("q.tb")) & _in_range(per_block)
    if block_filter:
        near &= block_bound(index) <= F.col("radius")
    return stored.join(_broadcast_rows(index, rows), near).drop(F.col("q.tb"))


def _in_range(per_block: bool = True) -> Column:
    """The exact range test of a joined block row, as differences."""
    r = F.col("radius")
    long_enough = F.col("n") > F.col("last")
    if not per_block:
        return long_enough & (F.col("q_lo") - F.col("tmax") <= r) & (F.col("tmax") - F.col("q_hi") <= r)
    env = {name: F.col(f"env.{name}") for name in ("mx", "mn", "fmx", "fmn")}
    return (
        long_enough
        & (env["mx"] - F.col("tmax") <= r)
        & (F.col("tmin") - env["mn"] <= r)
        & (
            env["fmx"].isNull()
            | ((F.col("tmax") - env["fmx"] <= r) & (env["fmn"] - F.col("tmin") <= r))
        )
    )


def block_bound(index: BlockIndex | UnstoredIndex) -> Column:
    """Value-block lower bound of a joined block row."""
    return value_blocks_bound(F.col("vb"), F.col("qvb"), -(-index.t_len // index.v_len))


def near_blocks(
    index: BlockIndex,
    rows: list[dict],
    block_filter: bool = True,
    prune: bool = False,
    exclude_self: bool = False,
) -> DataFrame:
    """``(qid, id, n_tb, d)``: distance over the queried positions of each block in range.

    One pass over the stored blocks.  The query blocks travel with the tasks, which test range
    and bound of a whole batch at once and take distances of what passes: a pair of query and
    block is a row only when it is an answer of this step, and no value is copied for it.
    ``prune=True`` leaves out blocks farther than the radius.
    """
    asked: dict[int, list[dict]] = {}
    for row in rows:
        asked.setdefault(row["tb"], []).append(row)
    bounds = {tb: np.array([_ranges(row, True) for row in of_tb]) for tb, of_tb in asked.items()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tb, ids, n, tmax, tmin = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            flat, offsets = flat_lists(batch.column(5))
            found: list[tuple] = []
            for block in np.unique(tb):
                if int(block) not in asked:
                    continue
                of_block = np.flatnonzero(tb == block)
                # Rows are stored in the order of their maxima: most queries miss a batch altogether.
                from_max, to_max, from_min, to_min = bounds[int(block)].T
                meets = (from_max <= tmax[of_block].max()) & (to_max >= tmax[of_block].min())
                meets &= (from_min <= tmin[of_block].max()) & (to_min >= tmin[of_block].min())
                envelopes = _value_envelopes(batch.column(6), of_block) if block_filter else None
                for at in np.flatnonzero(meets):
                    q = asked[int(block)][at]
                    passed = _rows_in_range(q, n[of_block], tmax[of_block], tmin[of_block])
                    if exclude_self:
                        passed &= ids[of_block] != q["qid"]
                    if envelopes is not None:
                        passed &= _value_bound(q, *envelopes) <= q["radius"]
                    chosen = of_block[passed]
                    if len(chosen):
                        matrix = _gather(flat, offsets, chosen, q["offs"])
                        near, d = distances(matrix, q["vals"], q["radius"] if prune else inf)
                        found.append((np.full(len(near), q["qid"]), ids[chosen][near], np.full(len(near), q["n_tb"]), d))
            columns = [np.concatenate(c) for c in zip(*found)] or [np.empty(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c.astype(t))
                    for c, t in zip(columns, (np.int64, np.int64, np.int32, np.float64))
                ],
                names=["qid", "id", "n_tb", "d"],
            )

    stored = index.blocks.filter(scan_filter(rows)).select(
        "tb", "id", "n", "tmax", "tmin", "seg", *(["vb"] if block_filter else [])
    )
    return stored.mapInArrow(kernel, "qid BIGINT, id BIGINT, n_tb INT, d DOUBLE")


def _rows_in_range(q: dict, n: np.ndarray, tmax: np.ndarray, tmin: np.ndarray) -> np.ndarray:
    """``_in_range`` on arrays."""
    r, env = q["radius"], q["env"]
    passed = (n > q["last"]) & (env["mx"] - tmax <= r) & (tmin - env["mn"] <= r)
    if env["fmx"] is not None:
        passed &= (tmax - env["fmx"] <= r) & (env["fmn"] - tmin <= r)
    return passed


def _value_envelopes(stored: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stored largest and smallest value per (value block, row); NaN where a row has no such block."""
    offsets = np.asarray(stored.offsets, dtype=np.int64)
    offsets -= offsets[0]
    envelopes = stored.flatten()
    pieces = np.diff(offsets)[rows]
    at = offsets[rows][None, :] + np.arange(int(pieces.max(initial=0)))[:, None]
    inside = at < (offsets[rows] + pieces)[None, :]
    out = []
    for values in envelopes.flatten():
        matrix = np.full(at.shape, np.nan)
        matrix[inside] = values.to_numpy(zero_copy_only=False)[at[inside]]
        out.append(matrix)
    return out[0], out[1]


def _value_bound(q: dict, mx: np.ndarray, mn: np.ndarray) -> np.ndarray:
    """``block_bound`` on arrays."""
    bound = np.zeros(mx.shape[1])
    for j, env in enumerate(q["qvb"][: len(mx)]):
        if env is not None:
            bound = np.fmax(bound, np.fmax(env["mx"] - mx[j], mn[j] - env["mn"]))
            if env["fmx"] is not None:
                bound = np.fmax(bound, np.fmax(mx[j] - env["fmx"], env["fmn"] - mn[j]))
    return bound


def _gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Matrix (position, row); every row is known to be long enough."""
    return flat[offsets[rows][None, :] + offs[:, None]]


def candidate_counts(index: BlockIndex | UnstoredIndex, rows: list[dict]) -> DataFrame:
    """``(qid, n_range, n_filtered)``: series left by the range test alone, and with the
    block bound on top; no distance is taken and no value is read."""
    passed = (block_bound(index) <= F.col("radius")).cast("int")
    per_series = (
        block_candidates(index, rows)
        .select("qid", "id", "n_tb", passed.alias("passed"))
        .groupBy("qid", "id")
        .agg(
            F.count(F.lit(1)).alias("seen"), F.sum("passed").alias("passed"), F.max("n_tb").alias("n_tb")
        )
        .filter(F.col("seen") == F.col("n_tb"))
    )
    return per_series.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_range"),
        F.sum((F.col("passed") == F.col("n_tb")).cast("bigint")).alias("n_filtered"),
    )


def complete_candidates(measured: DataFrame) -> DataFrame:
    """``(qid, id, dist)`` of the ids present in every queried time block."""
    return (
        measured.groupBy("qid", "id")
        .agg(F.count(F.lit(1)).alias("seen"), F.max("n_tb").alias("n_tb"), F.max("d").alias("dist"))
        .filter(F.col("seen") == F.col("n_tb"))
        .select("qid", "id", "dist")
    )
