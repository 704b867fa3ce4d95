"""DuckDB SQL with the results of the catalogue's queries.  Exact quantiles are sorted and picked by row number."""

from __future__ import annotations

from ..functions import ranks as R
from ..operators import exact as E
from .catalogue import EXACT, QS


def _pick(source: str, col: str, qs: str, spec: R.RankSpec, by: str = "", out: str = "q, value") -> str:
    """Sorts ``source`` and picks the ranks of each q of the rows ``qs``; by: grouping columns, comma-separated."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    lower, upper = spec.sql("q", "n")
    join = " AND ".join(f"s.{c.strip()} IS NOT DISTINCT FROM t.{c.strip()}" for c in by.split(",")) if by else "true"
    own = ", ".join(f"t.{c.strip()}" for c in by.split(",")) + ", " if by else ""
    return f"""
    WITH s AS (SELECT {keys}{col}::DOUBLE AS v, row_number() OVER ({part} ORDER BY {col}) AS rn FROM {source} WHERE {col} IS NOT NULL),
    c AS (SELECT {keys}count(*) AS n FROM s {'GROUP BY ' + by if by else ''}),
    t AS (SELECT *, {lower} AS k1, {upper} AS k2 FROM c, ({qs}) qs),
    r AS (SELECT {own}t.q, t.n, (max(CASE WHEN rn = k1 THEN v END) + max(CASE WHEN rn = k2 THEN v END)) * 0.5::DOUBLE AS value
          FROM t JOIN s ON {join} AND (rn = k1 OR rn = k2) GROUP BY {own}t.q, t.n)
    SELECT {out} FROM r
    """


def _values(qs: list[float]) -> str:
    return "SELECT unnest([" + ", ".join(f"{q!r}::DOUBLE" for q in qs) + "]) AS q"


def _grid(m: int) -> str:
    return f"SELECT (1.0::DOUBLE / {m + 1}) * i AS q FROM range(1, {m + 1}) g(i)"


_ALL_TRUE = "SELECT q, true AS within FROM (" + _values(QS) + ")"
_PAGES = "(SELECT *, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1) // 4096 AS page_id FROM lineitem)"


def _event_pages(rows: int) -> str:
    return f"(SELECT page_id, count(*) AS n, min(ts) AS min_t, max(ts) AS max_t, min(value) AS min_v, max(value) AS max_v FROM (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // {rows} AS page_id FROM events) GROUP BY page_id)"


def _dd(tab: str, col: str, alpha: float) -> str:
    import math

    g = 2 * alpha / (1 - alpha) + 1
    return f"SELECT CASE WHEN abs({col}) <= 1e-30 THEN 0 ELSE sign({col})::INT END AS sign, CASE WHEN abs({col}) <= 1e-30 THEN 0 ELSE ceil(round(ln(abs({col})) * {1 / math.log(g)!r}::DOUBLE, 9))::BIGINT END AS idx, count(*) AS n, min({col}) AS lo, max({col}) AS hi FROM {tab} GROUP BY 1, 2"


_LATE = """a AS (SELECT event_id, ts AS t, value AS v, event_id * 10 + CASE WHEN event_id % 10 = 3 THEN 3001 ELSE 0 END AS arrival FROM events),
    p AS (SELECT *, (row_number() OVER (ORDER BY arrival, event_id) - 1) // 200 AS flush FROM a),
    f AS (SELECT flush, max(max(t)) OVER (ORDER BY flush ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sealed FROM p GROUP BY flush),
    l AS (SELECT p.*, coalesce(t <= sealed, false) AS is_late FROM p JOIN f USING (flush))"""
#: Fifths of the arrivals are batches; what is not after the batches before is late.
_LATE_STREAM = """
    WITH a AS (SELECT ts AS t, value AS v, event_id * 10 + CASE WHEN event_id % 10 = 3 THEN 3001 ELSE 0 END AS arrival FROM events),
    e AS (SELECT min(arrival) AS a, max(arrival) AS b FROM a),
    p AS (SELECT t, v, (arrival - e.a) * 5 // (e.b - e.a + 1) AS batch FROM a, e),
    s AS (SELECT batch, max(max(t)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sealed FROM p GROUP BY batch),
    l AS (SELECT p.*, coalesce(t <= sealed, false) AS late FROM p JOIN s USING (batch))
    SELECT strftime(date_trunc('day', t), '%Y-%m-%d') AS day, count(*) FILTER (WHERE NOT late) AS n, count(*) FILTER (WHERE late) AS n_late, count(*) FILTER (WHERE late) AS n_kept,
           min(t) FILTER (WHERE NOT late) AS min_t, max(t) FILTER (WHERE NOT late) AS max_t, min(v) FILTER (WHERE NOT late) AS min_v, max(v) FILTER (WHERE NOT late) AS max_v,
           round(sum(v) FILTER (WHERE NOT late), 4) AS total, count(*) FILTER (WHERE NOT late) AS sketch_n
    FROM l GROUP BY 1
"""
_LATE_PAGES = "SELECT *, (row_number() OVER (ORDER BY t, event_id) - 1) // 256 AS page_id FROM l WHERE NOT is_late"


def _late_quantile(late: bool) -> str:
    source = f"(WITH {_LATE} SELECT * FROM l WHERE t >= TIMESTAMP '2024-01-02' AND t < TIMESTAMP '2024-01-25' {'' if late else 'AND NOT is_late'})"
    return _pick(source, "v", _values([0.9]), R.MID)


_STEPS = f"p AS (SELECT page_id, trunc(l_extendedprice)::BIGINT AS v FROM {_PAGES}), s AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY v) - 1) // 512 AS step FROM p), b AS (SELECT page_id, step, min(v) AS lo, max(v) AS hi, count(*) AS n FROM s GROUP BY 1, 2)"

#: Least shift of each half, then of both together.
_MERGED = """
    WITH k AS (SELECT o_orderkey % 2 AS half, o_custkey AS key FROM orders),
    h AS (SELECT half, shift, count(DISTINCT key >> shift) AS n FROM k, range(0, 40) r(shift) GROUP BY half, shift),
    own AS (SELECT half, min(shift) AS shift FROM h WHERE n <= CASE WHEN half = 0 THEN 80 ELSE 30 END GROUP BY half),
    base AS (SELECT max(shift) AS shift FROM own),
    every AS (SELECT r.shift, count(DISTINCT key >> r.shift) AS n FROM k, range(0, 40) r(shift), base WHERE r.shift >= base.shift GROUP BY r.shift),
    chosen AS (SELECT min(shift) AS shift FROM every WHERE n <= 50)
    SELECT key >> shift AS prefix, count(*) AS n, shift::BIGINT AS shift FROM k, chosen GROUP BY 1, 3
"""

_LATE_COVER = f"""
    WITH {_LATE}, r AS (SELECT *, (row_number() OVER (ORDER BY arrival, event_id) - 1) // 64 AS page FROM a),
    g AS (SELECT page, count(v) AS n, min(t) AS min_t, max(t) AS max_t FROM r GROUP BY page),
    nodes AS (SELECT level, page // (4 ** level)::BIGINT AS node_id, sum(n)::BIGINT AS n, min(min_t) AS min_t, max(max_t) AS max_t FROM g, range(0, 3) l(level) GROUP BY 1, 2),
    good AS (SELECT * FROM nodes d WHERE min_t >= TIMESTAMP '2024-01-04' AND max_t < TIMESTAMP '2024-01-26'
        AND NOT EXISTS (SELECT 1 FROM g WHERE g.page // (4 ** d.level)::BIGINT <> d.node_id AND g.min_t <= d.max_t AND g.max_t >= d.min_t)),
    top AS (SELECT * FROM good d WHERE NOT EXISTS (SELECT 1 FROM good u WHERE u.level > d.level AND d.node_id // (4 ** (u.level - d.level))::BIGINT = u.node_id))
    SELECT level::INT AS level, node_id, n, 'merged' AS use FROM top
    UNION ALL SELECT 0, page, n, 'raw' FROM g WHERE min_t < TIMESTAMP '2024-01-26' AND max_t >= TIMESTAMP '2024-01-04'
        AND NOT EXISTS (SELECT 1 FROM top u WHERE g.page // (4 ** u.level)::BIGINT = u.node_id)
"""


_LEVELED = """
    WITH a AS (SELECT event_id, ts AS t, value AS v, event_id * 10 + CASE WHEN event_id % 10 = 3 THEN 3001 ELSE 0 END AS arrival FROM events),
    c AS (SELECT count(*) AS n FROM events),
    p AS (SELECT *, (row_number() OVER (ORDER BY arrival, event_id) - 1) // 64 AS page FROM a),
    l AS (SELECT level, t, v, page, (64 * 4 ** level)::BIGINT AS size, row_number() OVER (PARTITION BY level ORDER BY page // (4 ** level)::BIGINT, CASE WHEN level > 0 THEN t END, arrival, event_id) - 1 AS rn FROM p, range(0, 4) r(level))
    SELECT level::INT AS level, rn // 64 AS page_id, count(*) AS n, min(t) AS min_t, max(t) AS max_t, round(sum(v), 4) AS total,
           (level = 0 OR rn // 64 * 64 < c.n // any_value(size) * any_value(size)) AND (level = 3 OR rn // 64 * 64 >= c.n // (any_value(size) * 4) * (any_value(size) * 4)) AS live
    FROM l, c GROUP BY level, rn // 64, c.n
"""


def oracle_sql() -> dict[str, str]:
    out = {name: _pick(t, c, _values([float(q)]), R.SPECS[o.get("rank", "mid")]) for name, (t, c, q, o) in EXACT.items()}
    out |= {
        "exact_sql_names": "WITH r AS (" + _pick("orders", "o_totalprice", _values([0.5]), R.MID) + ") SELECT name, q, value FROM r, (SELECT unnest([" + ", ".join(f"'{n}'" for n in sorted(E.SQL_NAMES)) + "]) AS name) x",
        "multi_q32_price": _pick("lineitem", "l_extendedprice", _grid(32), R.MID),
        "multi_q500_price": _pick("lineitem", "l_extendedprice", _grid(500), R.MID),
        "multi_q99_sort_value": _pick("events", "value", _grid(99), R.MID),
        "exact_radix_custkey": "WITH s AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_custkey) AS rn FROM orders), c AS (SELECT count(*) AS n FROM orders) SELECT n, max(CASE WHEN rn = floor(0.5::DOUBLE * (n - 1) + 1) THEN v END) AS low, max(CASE WHEN rn = ceil(0.5::DOUBLE * (n - 1) + 1) THEN v END) AS high FROM s, c GROUP BY n",
        "exact_radix_weighted": "WITH s AS (SELECT p_size::BIGINT AS v, row_number() OVER (ORDER BY p_size) AS rn FROM part), c AS (SELECT count(*) AS n FROM part) SELECT n, max(CASE WHEN rn = floor(0.3::DOUBLE * (n - 1) + 1) THEN v END) AS low, max(CASE WHEN rn = ceil(0.3::DOUBLE * (n - 1) + 1) THEN v END) AS high FROM s, c GROUP BY n",
        "grouped_q_by_flag": _pick("lineitem", "l_extendedprice", _values([0.1, 0.5, 0.9]), R.MID, "l_returnflag, l_linestatus", "l_returnflag, l_linestatus, q, n, value"),
        "grouped_median_by_user": _pick("events", "value", _values([0.5]), R.MID, "user_id", "user_id, q, n, value"),
        "range_q_shipdate": _pick("(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01')", "l_extendedprice", _values([0.25, 0.5, 0.75]), R.MID),
        "rank_of_value": "SELECT probe, count(*) FILTER (WHERE l_extendedprice < probe) AS below, count(*) FILTER (WHERE l_extendedprice <= probe) AS upto FROM lineitem, (SELECT unnest([901.0::DOUBLE, 5000.0, 20000.5, 104000.0]) AS probe) p GROUP BY probe",
        "delta_rank": "SELECT CASE WHEN b = 0 THEN 0 ELSE b + 1 - 1 END AS before, 0::BIGINT AS inside, u - n AS after FROM (SELECT count(*) FILTER (WHERE l_quantity < 10) AS b, count(*) FILTER (WHERE l_quantity <= 10) AS u, count(*) AS n FROM lineitem)",
        "bracket_counts": "SELECT count(*) FILTER (WHERE value < 20) AS n_lt, count(*) FILTER (WHERE value = 20) AS n_eq_lo, count(*) FILTER (WHERE value > 20 AND value < 80) AS n_in, count(*) FILTER (WHERE value = 80) AS n_eq_hi, count(*) FILTER (WHERE value > 80) AS n_gt FROM events",
        "window_counts": "SELECT count(*) FILTER (WHERE value < 20) AS below, count(*) FILTER (WHERE value BETWEEN 20 AND 80) AS inside, count(*) FILTER (WHERE value > 80) AS above FROM events",
        "dd_buckets": _dd("events", "value", 0.01),
        "dd_signed_buckets": _dd("customer", "c_acctbal", 0.02),
        "dd_merged_buckets": _dd("lineitem", "l_extendedprice", 0.02),
        "dd_quantile": f"WITH b AS ({_dd('events', 'value', 0.01)}), u AS (SELECT *, sum(n) OVER (ORDER BY sign, sign * idx) AS upto, sum(n) OVER () AS total FROM b), h AS (SELECT * FROM u WHERE upto > 0.9::DOUBLE * (total - 1) ORDER BY upto LIMIT 1) SELECT 0.9::DOUBLE AS q, sign, idx, round(CASE WHEN lo = hi THEN lo WHEN sign = 0 THEN 0 ELSE sign * 2 * pow({2 * 0.01 / 0.99 + 1!r}::DOUBLE, idx) / (1 + {2 * 0.01 / 0.99 + 1!r}::DOUBLE) END, 6) AS estimate, lo = hi AS exact, lo, hi FROM h",
        "dd_collapse": f"WITH b AS ({_dd('events', 'value', 0.01)}), r AS (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY idx DESC) AS r FROM b), e AS (SELECT sign, min(idx) AS edge FROM r WHERE r <= 64 GROUP BY sign) SELECT sign, greatest(idx, edge) AS idx, sum(n)::BIGINT AS n, min(lo) AS lo, max(hi) AS hi FROM b JOIN e USING (sign) GROUP BY 1, 2",
        "equi_depth_clusters": "SELECT c AS cluster, count(*) AS n, min(v) AS lo, max(v) AS hi, round(avg(v), 4) AS mean FROM (SELECT o_totalprice AS v, ntile(100) OVER (ORDER BY o_totalprice, o_orderkey) AS c FROM orders) GROUP BY c",
        "cluster_bounds": "WITH k AS (SELECT c, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT o_totalprice AS v, ntile(100) OVER (ORDER BY o_totalprice, o_orderkey) AS c FROM orders) GROUP BY c), u AS (SELECT *, sum(n) OVER (ORDER BY c) AS upto FROM k) SELECT max(lo) FILTER (WHERE 700 <= upto AND 700 > upto - n) AS lo1, max(hi) FILTER (WHERE 700 <= upto AND 700 > upto - n) AS hi1, max(lo) FILTER (WHERE 701 <= upto AND 701 > upto - n) AS lo2, max(hi) FILTER (WHERE 701 <= upto AND 701 > upto - n) AS hi2 FROM u",
        "cluster_rank_bounds": "SELECT count(*) FILTER (WHERE o_totalprice <= 250000) AS true_rank, true AS enclosed FROM orders",
        "page_stats": f"SELECT page_id, count(l_extendedprice) AS n, min(l_orderkey) AS min_t, max(l_orderkey) AS max_t, min(l_extendedprice) AS min_v, max(l_extendedprice) AS max_v FROM {_PAGES} GROUP BY page_id",
        "page_histogram": f"WITH p AS (SELECT page_id, trunc(l_extendedprice)::BIGINT AS v FROM {_PAGES}), s AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY v) - 1) // 512 AS step FROM p), b AS (SELECT page_id, step, min(v) AS lo, max(v) AS hi, count(*) AS n FROM s GROUP BY 1, 2) SELECT page_id, step, lo, hi, n, (v - lo) // ((hi - lo) // 8 + 1) AS cell, count(*) AS cell_n FROM s JOIN b USING (page_id, step) GROUP BY ALL",
        "page_prune_value": f"SELECT page_id, n, CASE WHEN max_v < 0.02 THEN 'below' WHEN min_v > 150 THEN 'above' ELSE 'read' END AS side FROM {_event_pages(512)}",
        "page_prune_time": f"SELECT page_id, CASE WHEN min_t >= TIMESTAMP '2024-01-05' AND max_t < TIMESTAMP '2024-01-17' THEN 'whole' ELSE 'edge' END AS use FROM {_event_pages(512)} WHERE min_t < TIMESTAMP '2024-01-17' AND max_t >= TIMESTAMP '2024-01-05'",
        "lsm_cover_nodes": "WITH e AS (SELECT min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) // 7 AS lo, min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) * 6 // 7 AS hi FROM orders), n0 AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS page, o_orderkey AS t FROM orders), n AS (SELECT level, page // (4 ** level)::BIGINT AS node_id, count(*) AS n, min(t) AS min_t, max(t) AS max_t FROM n0, range(0, 4) l(level) GROUP BY 1, 2), i AS (SELECT n.* FROM n, e WHERE min_t >= lo AND max_t < hi) SELECT level::INT AS level, node_id, n, min_t, max_t FROM i WHERE NOT EXISTS (SELECT 1 FROM i p WHERE p.level = i.level + 1 AND p.node_id = i.node_id // 4)",
        "pages_exact_q": _pick("(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-03 01:00:00' AND ts < TIMESTAMP '2024-01-21 05:00:00')", "value", _values([0.5]), R.MID),
        "late_split": f"WITH {_LATE} SELECT event_id, flush, is_late FROM l",
        "late_overlap_pages": f"WITH {_LATE}, f2 AS ({_LATE_PAGES}), g AS (SELECT page_id, count(*) AS n, min(t) AS a, max(t) AS b FROM f2 GROUP BY page_id), h AS (SELECT page_id, count(*) AS n_late FROM g JOIN l ON is_late AND l.t BETWEEN a AND b GROUP BY page_id) SELECT page_id, n, coalesce(n_late, 0) AS n_late, n_late IS NULL AS clean FROM g LEFT JOIN h USING (page_id)",
        "late_policy_exact_q": _late_quantile(True),
        "late_policy_ignore_q": _late_quantile(False),
        "late_policy_widen_q": _late_quantile(False),
        "late_rebuild_pages": f"WITH {_LATE}, f2 AS ({_LATE_PAGES}) SELECT (SELECT count(*) FROM events) AS n, (SELECT count(DISTINCT page_id) FROM f2) AS pages, (SELECT min(value) FROM events) AS min_v, (SELECT max(value) FROM events) AS max_v",
        "bit_prefix_pass1": "SELECT o_orderkey // 256 AS prefix, count(*) AS n FROM orders GROUP BY 1",
        "bit_prefix_bounds": "WITH b AS (SELECT o_orderkey // 256 AS prefix, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT *, sum(n) OVER (ORDER BY prefix)::BIGINT AS upto FROM b) SELECT max(prefix) FILTER (WHERE 333 <= upto AND 333 > upto - n) AS prefix1, max(upto - n) FILTER (WHERE 333 <= upto AND 333 > upto - n) AS before1, max(prefix) FILTER (WHERE 901 <= upto AND 901 > upto - n) AS prefix2, max(upto - n) FILTER (WHERE 901 <= upto AND 901 > upto - n) AS before2 FROM u",
        "bit_prefix_bounded": "SELECT true AS bounded, count(*) AS n FROM orders",
        "weighted_quantile": "WITH s AS (SELECT p_size::DOUBLE AS v, row_number() OVER (ORDER BY p_size) AS rn FROM part, range(0, 23) r(i) WHERE i <= p_partkey % 23), c AS (SELECT count(*) AS n FROM s) SELECT 0.4::DOUBLE AS q, n, (max(CASE WHEN rn = floor(0.4::DOUBLE * (n - 1) + 1) THEN v END) + max(CASE WHEN rn = ceil(0.4::DOUBLE * (n - 1) + 1) THEN v END)) * 0.5 AS value FROM s, c GROUP BY n",
        "frequency_merge": "SELECT l_quantity AS v, count(*) AS freq FROM lineitem GROUP BY 1",
        "bottomk_sample": "SELECT event_id, value FROM events ORDER BY md5(event_id::VARCHAR) LIMIT 500",
        "weighted_sample": "SELECT event_id, value FROM events WHERE value > 0 ORDER BY pow((('0x' || md5(event_id::VARCHAR)[1:8])::BIGINT + 1)::DOUBLE / 4294967297.0::DOUBLE, 1 / value) DESC LIMIT 300",
        "merged_sample": "SELECT event_id, value FROM events ORDER BY md5(event_id::VARCHAR) LIMIT 200",
        "kll_n_by_page_merge": "SELECT count(value) AS n FROM events",
        "kll_within_bound": _ALL_TRUE,
        "approx_percentile_within_bound": _ALL_TRUE,
        "ledger_bracket_sure": _ALL_TRUE,
        "mrl_bracket_sure": _ALL_TRUE,
        "tdigest_bracket_sure": _ALL_TRUE,
        "delete_rank": "SELECT probe, count(*) FILTER (WHERE o_totalprice <= probe) AS n_all, count(*) FILTER (WHERE o_totalprice <= probe AND o_orderstatus = 'F') AS n_deleted, count(*) FILTER (WHERE o_totalprice <= probe AND o_orderstatus <> 'F') AS rank FROM orders, (SELECT unnest([50000.0::DOUBLE, 150000.0, 400000.0]) AS probe) p GROUP BY probe",
        "change_only": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before",
        "run_limited": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before",
        "csv_try_cast": "SELECT 1 AS col, count(v) AS n, round(sum(v), 4) AS total FROM (SELECT try_cast(regexp_extract(props, '([0-9.]+)', 1) AS DOUBLE) AS v FROM events) WHERE v IS NOT NULL",
        "csv_flatten": "SELECT 1 AS col, count(*) AS n, sum(p_size)::DOUBLE AS total FROM part UNION ALL SELECT 2, count(*), sum(p_partkey)::DOUBLE FROM part",
        "median_page_stat": _pick("(SELECT strftime(ts, '%Y-%m-%d') AS day, value FROM events)", "value", _values([0.5]), R.MEDIAN, "day", "day, q, n, value"),
        "interval_mass": "SELECT count(*) FILTER (WHERE l_extendedprice BETWEEN 20000 AND 40000) AS n_in, count(*) AS n, round(count(*) FILTER (WHERE l_extendedprice BETWEEN 20000 AND 40000) / count(*), 9) AS share FROM lineitem",
        "arith_progressions": "WITH RECURSIVE v AS (SELECT DISTINCT (p_size + 60 * (p_partkey % 7))::BIGINT AS x FROM part), d AS (SELECT unnest(range(1, 61)) AS diff), s AS (SELECT x AS start, diff, x, 1 AS length FROM v, d WHERE x - diff NOT IN (SELECT x FROM v)), r AS (SELECT * FROM s UNION ALL SELECT r.start, r.diff, v.x, r.length + 1 FROM r JOIN v ON v.x = r.x + r.diff) SELECT start, diff, max(length)::BIGINT AS length FROM r GROUP BY start, diff HAVING max(length) >= 4",
        "coverage_odd_even": "WITH p AS (SELECT value AS v, row_number() OVER (ORDER BY value, event_id) AS rn FROM events), m AS (SELECT min(v) AS lo, max(v) AS hi FROM p), x AS (SELECT i AS point, lo + (hi - lo) * i / 10 AS place FROM m, range(1, 10) g(i)), r AS (SELECT point, place, max(rn) AS r FROM x JOIN p ON v <= place GROUP BY point, place) SELECT point::INT AS point, round(place, 6) AS place, (r % 2)::INT AS odd, (1 - r % 2)::INT AS even FROM r",
        "error_stats": "SELECT count(e) AS n, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS stddev FROM (SELECT l_extendedprice - 38000 AS e FROM lineitem)",
        "bloom_probe": "SELECT count(DISTINCT o_custkey) AS keys, count(DISTINCT o_custkey) AS found, true AS few_false FROM orders JOIN customer ON o_custkey = c_custkey",
        "distinct_values": "SELECT count(DISTINCT l_extendedprice) AS n_distinct, count(DISTINCT l_quantity) AS n_quantity FROM lineitem",
        "prefix_sums": "SELECT l_quantity, count(*) AS n, sum(count(*)) OVER (ORDER BY l_quantity)::BIGINT AS upto FROM lineitem GROUP BY l_quantity",
        "stream_daily_kll_n": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(value) AS n, count(value) AS sketch_n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1",
        "gen_sequence": "SELECT row_number() OVER () - 1 AS pos, (row_number() OVER () - 1)::DOUBLE AS v FROM events",
        "gen_permutation": "SELECT n, n AS n_values, (n * (n - 1) // 2)::BIGINT AS pos_sum, (n * (n - 1) // 2)::DOUBLE AS v_sum FROM (SELECT count(*) AS n FROM events)",
        "gen_ordered_uniform": "SELECT i AS pos, trunc((i / n::DOUBLE * 2 - 1) * 1e15)::BIGINT AS v FROM (SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM events)",
        "gen_out_of_order": "SELECT count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, 0::BIGINT AS n_early, count(*) AS n_values FROM orders",
        "gen_random": "SELECT unnest(['uniform', 'gaussian', 'log-normal']) AS name, n, n AS n_inside FROM (SELECT count(*) AS n FROM lineitem)",
        "gen_random_ranges": "SELECT n // 100 AS n, n // 50 AS least, n // 50 AS most, n // 100 AS n_inside FROM (SELECT count(*) AS n FROM events)",
        "gen_cyclic": "SELECT i AS pos, keys[i % len(keys) + 1] AS v FROM (SELECT row_number() OVER () - 1 AS i FROM orders), (SELECT list(r_regionkey::DOUBLE ORDER BY r_regionkey) AS keys FROM region)",
        "text_round_trip": "SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, round(sum(value), 4) AS total FROM events",
        "summary_round_trip": f"SELECT page_id, n, n AS sketch_n, min_v, max_v FROM {_event_pages(512)}",
        "sample_state": "SELECT count(*) AS n, least(count(*), 64) AS kept, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier",
        "sample_small_q": _pick("lineitem", "l_extendedprice", _values([0.2, 0.5, 0.95]), R.MID),
        "exact_shortcut_q": "SELECT q, value, 2::INT AS passes FROM (" + _pick("nation", "n_nationkey", _values([0.25, 0.5, 0.9]), R.MID) + ")",
        "exact_iteration_num": "SELECT 0.5::DOUBLE AS q, 2.0::DOUBLE AS value",
        "divided_chunk_weight": "SELECT o_orderkey // 4096 AS chunk_id, count(o_totalprice) AS weight FROM orders GROUP BY 1",
        "sketched_delete_rank": "SELECT probe, count(*) FILTER (WHERE o_totalprice <= probe AND o_orderstatus <> 'F') AS rank, true AS within FROM orders, (SELECT unnest([50000.0::DOUBLE, 150000.0, 400000.0]) AS probe) p GROUP BY probe",
        "bloom_round_trip": "SELECT count(DISTINCT o_custkey) AS keys, count(DISTINCT o_custkey) AS found, (SELECT count(*) FROM customer) AS expected, 0.02::DOUBLE AS fpp FROM orders",
        "planner_bloom_sizes": "SELECT keys, fpp, greatest(8, ceil(-keys * ln(fpp) / pow(ln(2), 2)))::BIGINT AS bits, greatest(1, round_even(greatest(8, ceil(-keys * ln(fpp) / pow(ln(2), 2))) / keys * ln(2), 0))::BIGINT AS hashes FROM (SELECT count(*) AS keys FROM supplier UNION ALL SELECT count(*) FROM customer UNION ALL SELECT count(*) FROM orders), (SELECT unnest([0.1::DOUBLE, 0.01]) AS fpp)",
        "dd_collapse_both": f"WITH b AS ({_dd('customer', 'c_acctbal', 0.02)}), r AS (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY idx DESC) AS r, count(*) OVER (PARTITION BY sign) AS own, count(*) OVER () AS every FROM b), e AS (SELECT sign, min(idx) AS edge FROM r WHERE r <= greatest(1, 60 * own // every) GROUP BY sign) SELECT sign, greatest(idx, edge) AS idx, sum(n)::BIGINT AS n, min(lo) AS lo, max(hi) AS hi FROM b JOIN e USING (sign) GROUP BY 1, 2",
        "dd_shifted_q": "SELECT q, round(value, 6) AS value FROM (" + _pick("customer", "c_acctbal", _values([0.1, 0.6]), R.MID) + ")",
        "merged_prefixes": _MERGED,
        "nested_window_q": _pick("lineitem", "l_extendedprice", _values([0.03, 0.5]), R.MID, out="q, n, value"),
        "nested_window_fallback_q": _pick("events", "value", _values([0.37]), R.MID, out="q, n, value"),
        "histogram_combine": f"WITH {_STEPS}, u AS (SELECT *, sum(n) OVER (ORDER BY lo, hi, page_id, step) AS upto, sum(n) OVER () AS total FROM b) SELECT floor((upto - n) * 20 / total)::BIGINT AS cluster, sum(n)::BIGINT AS n, min(lo) AS lo, max(hi) AS hi FROM u GROUP BY 1",
        "histogram_bytes": f"WITH {_STEPS}, c AS (SELECT page_id, step, (v - lo) // ((hi - lo) // 8 + 1) AS cell, count(*) AS c FROM s JOIN b USING (page_id, step) GROUP BY ALL) SELECT page_id, step, lo, hi, n, least(255, ceil(255 * coalesce((SELECT c FROM c WHERE c.page_id = b.page_id AND c.step = b.step AND cell = 0), 0) / n))::INT AS share0, least(255, ceil(255 * coalesce((SELECT c FROM c WHERE c.page_id = b.page_id AND c.step = b.step AND cell = 7), 0) / n))::INT AS share7 FROM b",
        "page_sketch_budget": f"SELECT page_id, n, true AS fits FROM {_event_pages(512)}",
        "rollup_ratio": f"SELECT level::INT AS level, page_id // (4 ** level)::BIGINT AS node_id, sum(n)::BIGINT AS n FROM {_event_pages(512)}, range(0, 3) l(level) GROUP BY 1, 2",
        "page_pruned_q": _pick("events", "value", _values([0.21, 0.5, 0.999]), R.MID),
        "page_pruned_share": "SELECT q, value, true AS spared FROM (" + _pick("lineitem", "l_extendedprice", _values([0.5]), R.MID) + ")",
        "late_cover": _LATE_COVER,
        "leveled_compaction": _LEVELED,
        "cover_quantile": _pick("(SELECT value FROM events WHERE ts >= TIMESTAMP '2024-01-03 05:00:00' AND ts < TIMESTAMP '2024-01-22 19:00:00')", "value", _values([0.05, 0.5, 0.9]), R.MID, out="q, n, value, true AS within, true AS tight"),
        "session_totals": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(value) AS n, min(value) AS lo, max(value) AS hi, count(value) AS sketch_n FROM s GROUP BY user_id, session",
    }
    out |= {name: "SELECT probe, count(*) FILTER (WHERE s_acctbal <= probe) AS rank FROM supplier, (SELECT unnest([-500.0::DOUBLE, 0.0, 2500.0, 9000.0]) AS probe) p GROUP BY probe" for name in ("ledger_bytes_rank", "mrl_bytes_rank", "cluster_bytes_rank")}
    price_ranks = "SELECT probe, count(*) FILTER (WHERE l_extendedprice <= probe) AS rank, true AS within, {} FROM lineitem, ({}) p GROUP BY probe"
    out["value_bounds"] = price_ranks.format("true AS small", "SELECT 5000.0::DOUBLE * i AS probe FROM range(1, 21) r(i)")
    out |= {name: price_ranks.format("true AS fits, false AS exact", "SELECT unnest([20000.0::DOUBLE, 35000.0, 50000.0, 90000.0]) AS probe") for name in ("ledger_budget_rank", "mrl_budget_rank")}
    out["slab_pruned_q"] = _pick("lineitem", "l_extendedprice", _values([0.05, 0.5, 0.99]), R.MID, out="q, value, n, true AS spared")
    out["histogram_rank_bounds"] = _pick("(SELECT floor(l_extendedprice) AS v FROM lineitem)", "v", _values([0.1, 0.5, 0.9]), R.MID, out="q, value, true AS holds, true AS narrower")
    out["late_stream_pages"] = _LATE_STREAM
    return out
