"""SQL that restates each registered query on the same tables."""

from __future__ import annotations

from checks import parameters as P

# Fixed values, as in nearwave.functions.hashing.
MASK = 4294967295
STEP = (16, 2146121005)
FINAL = ((15, 739982445), (16, 2146121005), (15, 1))
# Fixed values, as in nearwave.functions.noise.
NUMERATOR = (
    "-3.969683028665376e01",
    "2.209460984245205e02",
    "-2.759285104469687e02",
    "1.383577518672690e02",
    "-3.066479806614716e01",
    "2.506628277459239e00",
)
DENOMINATOR = (
    "-5.447609879822406e01",
    "1.615858368580409e02",
    "-1.556989798598866e02",
    "6.680131188771972e01",
    "-1.328068155288572e01",
)
MASS_ZERO_TO_ONE = "0.3413447460685429"


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# Series

VECTORS = """s as (
  select vec_id as id, cast(generate_subscripts(embedding, 1) - 1 as integer) as pos,
         cast(unnest(embedding) as double) as v
  from embeddings)"""


def _customers(measure: str, name: str = "s") -> str:
    return f"""{name} as (
  select i.id, cast(q.pos as integer) as pos,
         cast(sum(coalesce(o.m, 0)) over (partition by i.id order by q.pos) as double) as v
  from (select distinct o_custkey as id from orders) i
  cross join (select q, row_number() over (order by q) - 1 as pos
              from (select distinct year(o_orderdate) * 4 + quarter(o_orderdate) as q from orders)) q
  left join (select o_custkey as id, year(o_orderdate) * 4 + quarter(o_orderdate) as q, sum({measure}) as m
             from orders group by 1, 2) o on o.id = i.id and o.q = q.q)"""


SPEND = _customers("cast(round(o_totalprice * 100) as bigint)")


def _daily(above: float | None = None) -> str:
    cents = "cast(round(value * 100) as bigint)"
    measure = cents if above is None else f"case when value > {above} then {cents} else 0 end"
    kind = "coalesce(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type), 0)"
    return f"""e as (select user_id * 8 + {kind} as id, cast(ts as date) as d, {measure} as m from events),
s as (
  select i.id, cast(d.pos as integer) as pos, cast(coalesce(o.m, 0) as double) as v
  from (select distinct id from e) i
  cross join (select unnest(range((select max(d) - min(d) + 1 from e))) as pos) d
  left join (select id, d - (select min(d) from e) as pos, sum(m) as m from e group by 1, 2) o
    on o.id = i.id and o.pos = d.pos)"""


# Hashing and samples


def _hashed(source: str, seed: int, parts: list[str]) -> str:
    """The rows of ``source`` with a column ``h``: one nested select per mixing step."""
    keys = [key for p in parts for key in (f"(({p})::bigint & {MASK})", f"((({p})::bigint >> 32) & {MASK})")]
    steps = [(key, *STEP) for key in keys] + [("0::bigint", *final) for final in FINAL]
    sql = f"(select *, {seed & MASK}::bigint as h from {source})"
    for key, shift, multiplier in steps:
        y = f"((h + {key}) & {MASK})"
        mixed = f"((xor({y}, {y} >> {shift}) * {multiplier}::bigint) & {MASK})"
        sql = f"(select * replace ({mixed} as h) from {sql})"
    return sql


def _hashed_ids(name: str, seed: int) -> str:
    return f"{name} as (select id, h from {_hashed('(select distinct id from s)', seed, ['id'])})"


def _sampled_ids(name: str, sample_num: int = P.SAMPLE_NUM, seed: int = P.SAMPLE_SEED) -> str:
    return f"""{_hashed_ids(f'{name}_h', seed)},
{name} as (
  select id from {name}_h
  where h < floor(least(1::double, {sample_num}::double / (select count(*) from {name}_h)) * 4294967296::double))"""


QUERIES = f"""{_hashed_ids('qh', P.QUERY_SEED)},
qi as (select id from qh order by h, id limit {P.N_QUERIES}),
q as (select s.id as qid, pos, v from s join qi using (id))"""

ALL_QUERIES = "q as (select id as qid, pos, v from s)"

OFFSET = f"""{QUERIES.replace('q as (select', 'qf as (select')},
q as (select * from qf where pos between {P.OFFSET_FIRST} and {P.OFFSET_LAST})"""

_GROWN = """from (select *, coalesce(lag(v) over (partition by qid order by pos), 0) as before from qf)
  where v > before"""

SPARSE = f"""{QUERIES.replace('q as (select', 'qf as (select')},
q as (select qid, pos, v {_GROWN})"""

ALL_SPARSE = f"""qf as (select id as qid, pos, v from s),
q as (select qid, pos, v {_GROWN})"""

# Distances and answers

PAIRS = """pairs as (
  select q.qid, s.id, max(abs(s.v - q.v)) as dist
  from q join s using (pos) group by 1, 2)"""


def _top(source: str, k: int = P.K, by: str = "qid") -> str:
    return f"""select {by}, cast(rn as integer) as rn, id, dist from (
  select *, row_number() over (partition by {by} order by dist, id) as rn from {source})
where rn <= {k}"""


def _sample_radius(k: int = P.K) -> str:
    return f"""{_sampled_ids('smp')},
rad as (
  select qid, case when count(*) >= {k} then max(dist) else cast('infinity' as double) end as r
  from ({_top(f'(select * from pairs where id in (select id from smp))', k)}) group by qid)"""


QUERY_ENVELOPE = "qe as (select qid, max(v) as q_hi, min(v) as q_lo from q group by qid)"
ENVELOPE = "env as (select id, max(v) as smax, min(v) as smin from s group by id)"


def _estimate(name: str, sample_num: int = P.SAMPLE_NUM, sample: str = "smp", k: int = P.K) -> str:
    rank = f"cast(floor({k} * ({sample_num}::double / (select count(*) from env))) + 1 as bigint)"
    return f"""{name}_ub as (
  select qid, greatest(abs(smax - q_lo), abs(smin - q_hi)) as ub
  from qe cross join env where env.id in (select id from {sample})),
{name} as (
  select qid, max(ub) as r
  from (select *, row_number() over (partition by qid order by ub) as rn from {name}_ub)
  where rn <= {rank} group by qid)"""


ESTIMATED = f"{QUERY_ENVELOPE},\n{ENVELOPE},\n{_sampled_ids('smp')},\n{_estimate('rad')}"


def _blocks(t: int, v: int) -> str:
    return f"""b as (
  select id, cast(pos // {t} as integer) as tb, max(v) as tmax, min(v) as tmin,
         cast(count(*) as integer) as n from s group by 1, 2),
vb as (
  select id, cast(pos // {t} as integer) as tb, cast((pos % {t}) // {v} as integer) as vblk,
         max(v) as mx, min(v) as mn, count(*) as c from s group by 1, 2, 3),
qb as (
  select qid, cast(pos // {t} as integer) as tb, max(v) as qmax, min(v) as qmin, count(*) as nq
  from q group by 1, 2),
qvb as (
  select qid, cast(pos // {t} as integer) as tb, cast((pos % {t}) // {v} as integer) as vblk,
         max(v) as qmax, min(v) as qmin, count(*) as n_points from q group by 1, 2, 3)"""


RANGE = """rng as (
  select qb.qid, b.id, b.tb, b.tmax, b.tmin, r
  from qb join b using (tb) join rad using (qid)
  where qmax - tmax <= r and tmin - qmin <= r
    and (nq < n or (tmax - qmax <= r and qmin - tmin <= r)))"""

BOUND = """lbs as (
  select qid, id, tb, max(
    case when n_points = c then greatest(abs(mx - qmax), abs(mn - qmin))
         else greatest(qmax - mx, mn - qmin, 0::double) end) as lb
  from qvb join vb using (tb, vblk) group by 1, 2, 3)"""

KEPT = """kept as (select rng.*, lb, lb <= r as passed from rng join lbs using (qid, id, tb)),
whole as (
  select qid, id, count(*) filter (passed) as n_passed, count(*) as n_seen
  from kept group by 1, 2),
need as (select qid, count(*) as n_tb from qb group by qid)"""

COUNTS = """counts as (
  select qid, count(*) filter (n_seen = n_tb) as n_range, count(*) filter (n_passed = n_tb) as n_filtered
  from whole join need using (qid) group by qid)"""

SPEND_BLOCKS = _blocks(P.SPEND_T, P.SPEND_V)
CANDIDATES = f"{SPEND_BLOCKS},\n{RANGE},\n{BOUND},\n{KEPT}"

_ENDS = "least(abs({a} - {b}max), abs({a} - {b}min))"


def _lower_bound(a: str, b: str) -> str:
    """Envelope-to-envelope bound of columns named ``<a>max``, ``<a>min`` and the same for b."""
    terms = [_ENDS.format(a=f"{a}{end}", b=b) for end in ("max", "min")]
    terms += [_ENDS.format(a=f"{b}{end}", b=a) for end in ("max", "min")]
    return f"greatest({', '.join(terms)})"


NEXT_ENVELOPES = f"""{ENVELOPE},
nxt as (
  select x.id as a, y.id as b, x.smax as a_max, x.smin as a_min, y.smax as b_max, y.smin as b_min
  from env x join env y on y.id = x.id + 1)"""

FILTERED_PAIRS = f"""fp as (
  select p.qid, p.id, p.dist
  from pairs p join (select id, smax as s_max, smin as s_min from env) using (id)
  join (select qid, q_hi as q_max, q_lo as q_min from qe) using (qid) join rad using (qid)
  where {_lower_bound('s_', 'q_')} <= r)"""

# The customer series after a second write and a removal.
REPLACED = f"""{_customers('1', 'counted')},
z as (
  select id, pos, v from s where id % 13 <> 0 and id % 7 <> 0 and id % 5 <> 0
  union all select id, pos, v from s where id % 13 <> 0 and id % 7 = 0 and pos < {P.SHORTER}
  union all select id, pos, v from counted where id % 13 <> 0 and id % 7 <> 0 and id % 5 = 0
  union all select id + {P.NEW_IDS}, pos, v + 100 from s where id % 11 = 0)"""

REPLACED_PAIRS = """pairs as (
  select q.qid, z.id, max(abs(z.v - q.v)) as dist
  from q join z using (pos) group by 1, 2 having count(*) = (select count(distinct pos) from s))"""

# Noise


def _unit_normal(stream: int, parts: list[str], name: str, source: str) -> str:
    """CTE ``name``: the rows of ``source`` with a column ``g``."""
    a, b = NUMERATOR, DENOMINATOR
    num = f"((((({a[0]}::double * r + {a[1]}::double) * r + {a[2]}::double) * r + {a[3]}::double) * r + {a[4]}::double) * r + {a[5]}::double)"
    den = f"((((({b[0]}::double * r + {b[1]}::double) * r + {b[2]}::double) * r + {b[3]}::double) * r + {b[4]}::double) * r + 1::double)"
    return f"""{name}_h as (select * from {_hashed(source, P.NOISE_SEED, [str(stream), *parts])}),
{name} as (
  select *, least({num} * u / {den}, 1::double) as g from (
    select *, u * u as r from (
      select *, (h::double + 0.5::double) / 4294967296::double * {MASS_ZERO_TO_ONE}::double as u from {name}_h)))"""


def _moved(v: str, g: str, rate: str, hi: str = "hi", lo: str = "lo") -> str:
    return (
        f"floor(greatest({v} + ({g} - 0.5::double) * (({hi} - {lo}) / 2::double) * {rate}, 0::double)"
        " * 100000::double + 0.5::double) / 100000::double"
    )


RANGED = "w as (select id, pos, v, max(v) over (partition by id) as hi, min(v) over (partition by id) as lo from s)"

INTERPOLATED = """f as (
  select *, count(*) filter (v <> 0) over (partition by id) as n_obs,
    max(case when v <> 0 then pos end) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as p1,
    min(case when v <> 0 then pos end) over (partition by id order by pos rows between 1 following and unbounded following) as p2
  from s),
o as (select id, pos, v, row_number() over (partition by id order by pos) as nth from s where v <> 0),
ends as (
  select id, min(pos) filter (nth = 1) as first1, min(pos) filter (nth = 2) as first2,
         max(pos) as last1, max(pos) filter (nth = n - 1) as last2, min(v) as lone
  from (select *, count(*) over (partition by id) as n from o) group by id),
g as (
  select f.*, lone,
    case when p1 is not null and p2 is not null then p1 when p1 is null then first1 else last2 end as x1,
    case when p1 is not null and p2 is not null then p2 when p1 is null then first2 else last1 end as x2
  from f left join ends using (id)),
filled as (
  select g.id, g.pos, n_obs,
    case when g.v <> 0 or n_obs = 0 then g.v when n_obs = 1 then lone
         else ((b.v - a.v) / (x2 - x1)::double) * (g.pos - x1)::double + a.v end as v
  from g left join s a on a.id = g.id and a.pos = g.x1 left join s b on b.id = g.id and b.pos = g.x2)"""

AUGMENTED_ROWS = f"""{RANGED},
c as (select unnest(range(1, {P.AUGMENT_SIZE} + 1)) as copy),
ic as (select id, copy from (select distinct id from s) cross join c),
{_unit_normal(1, ['id', 'copy', '0', '0'], 'rate', 'ic')},
pc as (select w.*, copy from w cross join c),
{_unit_normal(0, ['id', 'copy', '0', 'pos'], 'pt', 'pc')},
rk as (select id, row_number() over (order by id) as rank from (select distinct id from s)),
grown as (
  select (rank - 1) * {P.AUGMENT_SIZE + 1} + pt.copy as id, pos, {_moved('v', 'pt.g', 'rate.g')} as v
  from pt join rate on rate.id = pt.id and rate.copy = pt.copy join rk on rk.id = pt.id
  union all
  select rank * {P.AUGMENT_SIZE + 1}, pos, v from s join rk using (id))"""

AUGMENTED_LENGTH = f"""{RANGED},
ie as (select id, extra from (select distinct id from s)
       cross join (select unnest(range(1, {P.AUGMENT_DIM} + 1)) as extra)),
{_unit_normal(1, ['id', '1', 'extra', '0'], 'rate', 'ie')},
pe as (select w.*, extra, count(*) over (partition by id, extra) as len
       from w cross join (select unnest(range(1, {P.AUGMENT_DIM} + 1)) as extra)),
{_unit_normal(0, ['id', '1', 'extra', 'pos'], 'pt', 'pe')}"""

# Comparisons


def _pruning_by_k() -> str:
    tops = "\nunion all\n".join(
        f"select {k} as k, qid, case when count(*) >= {k} then max(dist) else cast('infinity' as double) end as r"
        f" from ({_top('sp', k)}) group by qid"
        for k in P.KS
    )
    return (
        _with(
            SPEND,
            QUERIES.replace("q as (select", "qo as (select"),
            "pairs as (select qo.qid, s.id, max(abs(s.v - qo.v)) as dist from qo join s using (pos) group by 1, 2)",
            _sampled_ids("smp"),
            "sp as (select * from pairs where id in (select id from smp))",
            f"radk as ({tops})",
            # One query per (k, query): its id is qid * 1000 + k.
            "rad as (select qid * 1000 + k as qid, r from radk)",
            "q as (select qo.qid * 1000 + k as qid, pos, v from qo join radk using (qid))",
            CANDIDATES,
            COUNTS,
        )
        + "select cast(k as integer) as k, radk.qid, radk.r as radius, coalesce(n_range, 0) as n_range,"
        " coalesce(n_filtered, 0) as n_filtered"
        " from radk left join counts on counts.qid = radk.qid * 1000 + k"
    )


def _radius_by_sample_size() -> str:
    samples = [_sampled_ids(f"smp{n}", n) for n in P.SAMPLE_NUMS]
    estimates = [_estimate(f"rad{n}", n, f"smp{n}") for n in P.SAMPLE_NUMS]
    union = " union all ".join(f"select {n} as sample_num, qid, r from rad{n}" for n in P.SAMPLE_NUMS)
    return (
        _with(
            SPEND,
            QUERIES.replace("q as (select", "qo as (select"),
            QUERY_ENVELOPE.replace("from q ", "from qo "),
            ENVELOPE,
            *samples,
            *estimates,
            f"rads as ({union})",
            "rad as (select qid * 1000 + sample_num as qid, r from rads)",
            "q as (select qo.qid * 1000 + sample_num as qid, pos, v from qo join rads using (qid))",
            CANDIDATES,
            COUNTS,
        )
        + "select cast(sample_num as integer) as sample_num, rads.qid, rads.r as radius,"
        " coalesce(n_range, 0) as n_range, coalesce(n_filtered, 0) as n_filtered"
        " from rads left join counts on counts.qid = rads.qid * 1000 + sample_num"
    )


def _pruning_by_lengths(lengths: list[tuple[int, int]]) -> str:
    per_setting = []
    for t, v in lengths:
        inner = _with(_blocks(t, v), RANGE, BOUND, KEPT, COUNTS)
        per_setting.append(
            f"select {t} as t_len, {v} as v_len, qid, n_range, n_filtered from ({inner} select * from counts)"
        )
    return _with(SPEND, QUERIES, PAIRS, _sample_radius()) + "\nunion all\n".join(per_setting)


def _prefixes() -> str:
    dims = ", ".join(f"({d})" for d in P.DIMS)
    return (
        _with(
            SPEND,
            QUERIES,
            f"d(dim) as (values {dims})",
            """pd as (
  select dim, q.qid, s.id, max(abs(s.v - q.v)) as dist
  from q join s using (pos) join d on pos < dim group by 1, 2, 3)""",
        )
        + _top("pd", by="dim, qid")
    )


def _compared() -> str:
    both = ", ".join(f"id as {n}_id, dist as {n}_dist" for n in ("scan", "index", "plain"))
    return f"select qid, rn, {both}, true as agree from ({_top('pairs')})"


_SPEND_QUERY = _with(SPEND, QUERIES, PAIRS)
_VECTOR_QUERY = _with(VECTORS, QUERIES, PAIRS)


def all_sql() -> dict[str, str]:
    lengths = f"""select id, cast(count(*) filter (v > 0) as integer) as n from s group by id"""
    return {
        "damaged_text": _with(SPEND)
        + """select id, pos, v, true as good from s where id % 7 > 2 union all
select distinct id, cast(null as integer), cast(null as double), false from s where id % 7 <= 2""",
        "envelope_text_roundtrip": _with(SPEND, ENVELOPE, _sampled_ids("smp"))
        + "select smax, smin from env where id in (select id from smp)",
        "clean_text_job": _with(_daily(P.OBSERVED_ABOVE), INTERPOLATED)
        + "select id, pos, v from filled where n_obs > 0",
        "augment_text_job": _with(SPEND, AUGMENTED_ROWS) + "select id, pos, v from grown",
        "series_text_roundtrip": _with(SPEND) + "select id, pos, v from s",
        "query_points": _with(SPEND, ALL_SPARSE) + "select qid, pos, v from q",
        "series_by_id": _with(SPEND) + "select id, pos, v from s",
        "block_index": _with(SPEND, ALL_QUERIES, SPEND_BLOCKS)
        + """select tb, tmax, tmin, id, n, cast(n_vb as integer) as n_vb
from b join (select id, tb, count(*) as n_vb from vb group by 1, 2) using (id, tb)""",
        "block_contents": _with(SPEND, ALL_QUERIES, SPEND_BLOCKS)
        + f"""select id, cast(pos // {P.SPEND_T} as integer) as tb, 'value' as kind,
       cast(pos % {P.SPEND_T} as integer) as at, v as hi, v as lo from s union all
select id, tb, 'envelope', cast(vblk as integer), mx, mn from vb""",
        "replaced_series": _with(SPEND, REPLACED) + "select id, pos, v from z",
        "knn_replaced": _with(SPEND, REPLACED, QUERIES, REPLACED_PAIRS) + _top("pairs"),
        "time_blocks": _with(SPEND, ALL_QUERIES, SPEND_BLOCKS) + "select id, tb, tmax, tmin, n from b",
        "value_blocks": _with(VECTORS, ALL_QUERIES, _blocks(P.VECTOR_T, P.VECTOR_V))
        + "select id, tb, vblk, mx, mn from vb",
        "series_envelope": _with(VECTORS, ENVELOPE) + "select id, smax, smin from env",
        "query_blocks": _with(SPEND, ALL_SPARSE, SPEND_BLOCKS)
        + "select qid, tb, vblk, qmax, qmin, n_points from qvb",
        "chebyshev_pairs": _with(VECTORS)
        + """select x.id as a, y.id as b, max(abs(x.v - y.v)) as dist
from s x join s y on y.id = x.id + 1 and y.pos = x.pos group by 1, 2""",
        "block_lower_bound": _with(SPEND, NEXT_ENVELOPES)
        + f"select a, b, {_lower_bound('a_', 'b_')} as lb from nxt",
        "multi_block_lower_bound": _with(
            SPEND,
            f"e as (select id, pos // {P.SPEND_V} as blk, max(v) as e_max, min(v) as e_min from s group by 1, 2)",
        )
        + f"""select a, b, max({_lower_bound('a_', 'b_')}) as lb from (
  select x.id as a, y.id as b, x.e_max as a_max, x.e_min as a_min, y.e_max as b_max, y.e_min as b_min
  from e x join e y on y.id = x.id + 1 and y.blk = x.blk) group by 1, 2""",
        "block_upper_bound": _with(SPEND, NEXT_ENVELOPES)
        + "select a, b, greatest(abs(a_max - b_min), abs(a_min - b_max)) as ub from nxt",
        "profile_series": _with(SPEND, "l as (select id, count(*) as n, max(v) as hi, min(v) as lo from s group by id)")
        + """select count(*) as n_rows, cast(arg_min(n, id) as integer) as n_dims,
cast(min(n) as integer) as min_len, cast(max(n) as integer) as max_len, max(hi) as gmax, min(lo) as gmin from l""",
        "length_violations": _with(SPEND, f"l as ({lengths})")
        + """select id, n, (select arg_min(n, id) from l) as expected from l
where n <> (select arg_min(n, id) from l)""",
        "envelope_sample": _with(SPEND, ENVELOPE, _sampled_ids("smp"))
        + "select id, smax, smin from env where id in (select id from smp)",
        "sample_queries": _with(SPEND, QUERIES) + "select qid, pos, v from q",
        "knn_brute_force": _VECTOR_QUERY + _top("pairs"),
        "knn_by_id_table": _VECTOR_QUERY + _top("pairs"),
        "knn_auto": _VECTOR_QUERY + _top("pairs"),
        "knn_index": _SPEND_QUERY + _top("pairs"),
        "knn_index_no_block_filter": _SPEND_QUERY + _top("pairs"),
        "knn_index_estimated_radius": _SPEND_QUERY + _top("pairs"),
        "knn_index_vectors": _VECTOR_QUERY + _top("(select * from pairs where id <> qid)"),
        "knn_sparse_positions": _with(SPEND, SPARSE, PAIRS) + _top("pairs"),
        "knn_within_radius": _with(SPEND, QUERIES, PAIRS, ESTIMATED, CANDIDATES)
        + _top(
            "(select p.* from pairs p join whole using (qid, id) join need using (qid) where n_passed = n_tb)"
        ),
        "knn_join": _with(SPEND, ALL_QUERIES, PAIRS) + _top("pairs"),
        "knn_scan_many": _with(SPEND, ALL_QUERIES, PAIRS) + _top("pairs"),
        "knn_index_many": _with(SPEND, ALL_QUERIES, PAIRS) + _top("pairs"),
        "knn_filtered_scan": _with(SPEND, QUERIES, PAIRS, ESTIMATED, FILTERED_PAIRS) + _top("fp"),
        "knn_unfiltered_scan": _SPEND_QUERY + _top("pairs"),
        "knn_radius": _VECTOR_QUERY
        + f"select qid, max(dist) as radius from ({_top('pairs')}) group by qid",
        "estimate_radius": _with(SPEND, QUERIES, ESTIMATED) + "select qid, r as radius from rad",
        "index_range_scan": _with(SPEND, QUERIES, ESTIMATED, SPEND_BLOCKS)
        + """select qb.qid, qb.tb, b.id, b.tmax, b.tmin
from qb join b using (tb) join rad using (qid) join qe using (qid)
where q_lo - tmax <= r and tmax - q_hi <= r""",
        "index_range_join": _with(SPEND, OFFSET, PAIRS, _sample_radius(), SPEND_BLOCKS, RANGE)
        + "select qid, tb, id, tmax, tmin from rng",
        "block_filter": _with(SPEND, OFFSET, PAIRS, _sample_radius(), CANDIDATES)
        + "select qid, tb, id, lb from kept where passed",
        "complete_candidates": _with(SPEND, OFFSET, PAIRS, _sample_radius(), CANDIDATES)
        + """select p.qid, p.id, p.dist
from pairs p join whole using (qid, id) join need using (qid) where n_passed = n_tb""",
        "interpolate_missing": _with(_daily(), INTERPOLATED)
        + "select id, pos, v, cast(n_obs as integer) as n_observed from filled",
        "clean_series": _with(_daily(P.OBSERVED_ABOVE), INTERPOLATED)
        + "select id, pos, v from filled where n_obs > 0",
        "jitter_series": _with(SPEND, RANGED, _unit_normal(0, ["id", "0", "0", "pos"], "pt", "w"))
        + f"select id, pos, {_moved('v', 'g', f'{P.JITTER_RATE}::double')} as v from pt",
        "augment_rows": _with(SPEND, AUGMENTED_ROWS) + "select id, pos, v from grown",
        "augment_length": _with(SPEND, AUGMENTED_LENGTH)
        + f"""select id, pos, v from s union all
select pt.id, cast(extra * len + pos as integer), {_moved('v', 'pt.g', 'rate.g')}
from pt join rate using (id, extra)""",
        "augment_profile": _with(SPEND, "l as (select id, count(*) as n from s group by id)")
        + f"""select *, 'spend_' || n_rows || '_' || dim as name from (
  select count(*) * {P.AUGMENT_SIZE + 1} as n_rows,
         cast(arg_min(n, id) * {P.AUGMENT_DIM + 1} as integer) as dim from l)""",
        "compare_methods": _SPEND_QUERY + _compared(),
        "method_recall": _SPEND_QUERY
        + f"select qid, count(*) as n_ranks, count(*) as n_agree, 1::double as recall from ({_top('pairs')}) group by qid",
        "knn_multi_k": _SPEND_QUERY
        + f"""select k, a.* from ({_top('pairs', max(P.KS))}) a
join (values {', '.join(f'({k})' for k in P.KS)}) ks(k) on rn <= k""",
        "pruning_by_k": _pruning_by_k(),
        "knn_multi_prefix": _prefixes(),
        "radius_by_sample_size": _radius_by_sample_size(),
        "pruning_by_time_block": _pruning_by_lengths(P.TIME_BLOCKS),
        "pruning_by_value_block": _pruning_by_lengths(P.VALUE_BLOCKS),
        "pruning_on_off": _with(SPEND, QUERIES, PAIRS, ESTIMATED, FILTERED_PAIRS)
        + f"""select t.qid, n_total, n_kept, coalesce(n_same, 0) = n_all as same_answer
from (select qid, count(*) as n_total from pairs group by qid) t
join (select qid, count(*) as n_kept from fp group by qid) f using (qid)
join (select qid, count(*) as n_all from ({_top('pairs')}) group by qid) a using (qid)
left join (select x.qid, count(*) as n_same from ({_top('pairs')}) x
           join ({_top('fp')}) y on x.qid = y.qid and x.rn = y.rn and x.id = y.id and x.dist = y.dist
           group by x.qid) e using (qid)""",
    }
