"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

CUSTOMERS = """
c0 AS (SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS c_nationkey, r_name AS region, (c_mktsegment = 'BUILDING')::INT::DOUBLE AS is_target
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g0 AS (SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS c_acctbal, c_nationkey, CASE WHEN c_custkey % 23 <> 0 THEN region END AS region,
    CASE WHEN c_custkey % 31 <> 0 THEN is_target END AS is_target FROM c0)"""


def _matched(source: str = "c0", n_bins: int = 4) -> str:
    """Prepared rows, edges, strata and counts over ``source``."""
    cuts = ", ".join(repr(k / n_bins) for k in range(1, n_bins))
    bins = " ".join(f"WHEN p.c_acctbal <= e[{k}] THEN {k - 1}" for k in range(1, n_bins))
    return f"""WITH RECURSIVE {CUSTOMERS},
p AS (SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_custkey, CASE WHEN is_target = 1 THEN 1 ELSE 0 END AS t, coalesce(c_acctbal, 0.0) AS c_acctbal, c_acctbal IS NULL AS gap,
    coalesce(region, '__MISSING__') AS region, c_nationkey FROM {source}),
ed AS (SELECT quantile_cont(c_acctbal, [{cuts}]) AS e FROM p WHERE t = 1),
s AS (SELECT p.*, CASE {bins} ELSE {n_bins - 1} END AS bin FROM p, ed),
st AS (SELECT *, concat_ws('|', bin::VARCHAR, region, CASE WHEN gap THEN 'true' ELSE 'false' END) AS stratum FROM s),
cn AS (SELECT stratum, count(*) FILTER (WHERE t = 1) AS n_target, count(*) FILTER (WHERE t = 0) AS n_control FROM st GROUP BY stratum),
mo AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM p WHERE t = 1),
z AS (SELECT st.*, (c_acctbal - m) / sd AS z FROM st, mo),
pr AS (SELECT a.stratum, a.id AS tid, b.id AS cid, exp(-sqrt((a.z - b.z) * (a.z - b.z))) AS s FROM z a JOIN z b ON a.stratum = b.stratum WHERE a.t = 1 AND b.t = 0)"""


def _greedy(n: int = 1, most: int | None = None, x: str | None = None) -> str:
    """The greedy assignment as rounds of mutual bests, over lists of what is taken. ``x``: another number to score by."""
    pairs = "pr" if most is None else f"(SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY tid ORDER BY s DESC, cid) <= {most})"
    return (_matched() if x is None else _matched().replace("(c_acctbal - m) / sd AS z", f"{x} AS z")) + f""",
r(ut, uc, i) AS (
    SELECT []::BIGINT[], []::BIGINT[], 0
    UNION ALL
    SELECT list_concat(any_value(ut), list(tid)), list_concat(any_value(uc), list(cid)), any_value(i) + 1 FROM (
        SELECT ut, uc, i, tid, cid, row_number() OVER (PARTITION BY tid ORDER BY s DESC, cid) AS a, row_number() OVER (PARTITION BY cid ORDER BY s DESC, tid) AS b
        FROM r, {pairs} WHERE len(list_filter(ut, lambda x: x = tid)) < {n} AND NOT list_contains(uc, cid))
    WHERE a = 1 AND b = 1 HAVING count(*) > 0),
fin AS (SELECT unnest(ut) AS tid, unnest(uc) AS cid FROM (SELECT ut, uc FROM r ORDER BY i DESC LIMIT 1)),
asg AS (SELECT stratum, tid, cid, s, row_number() OVER (PARTITION BY tid ORDER BY s DESC, cid) AS k FROM fin JOIN pr USING (tid, cid))"""


def _walk(n: int, x: str) -> str:
    """The greedy assignment as a walk over all pairs in order, stratum by stratum: a fold over a list, as ties make rounds long."""
    return _greedy(n, None, x)


def _kept(n: int, tolerance: float) -> str:
    return _greedy(n) + f""",
cut AS (SELECT quantile_cont(s, {tolerance}) AS c FROM asg),
kept AS (SELECT asg.*, c FROM asg, cut WHERE s >= c OR k = 1)"""


_ASSIGNED = " SELECT stratum, tid AS target_rm_id, cid AS control_rm_id, round(s, 6) AS match_strength, k AS match_rank FROM asg"

_PAIRS = _kept(1, 0.2) + """,
fl AS (SELECT stratum, n_control = 0 AS no_control, n_control > 0 AND n_control < 5 AS thin FROM cn WHERE n_target > 0),
pt AS (
    SELECT a.c_custkey AS target_id, b.c_custkey AS control_id, a.id AS target_rm_id, b.id AS control_rm_id, a.stratum, s AS match_strength, k AS match_rank, 'matched' AS match_status,
        CASE WHEN s < c THEN 'low_quality' ELSE 'acceptable' END AS quality_status, thin AS thin_stratum
    FROM kept JOIN st a ON a.id = tid JOIN st b ON b.id = cid JOIN fl ON fl.stratum = a.stratum
    UNION ALL
    SELECT a.c_custkey, NULL, a.id, NULL, a.stratum, NULL, NULL, CASE WHEN no_control THEN 'no_control_available' ELSE 'unmatched' END, NULL, thin
    FROM st a JOIN fl USING (stratum) WHERE t = 1 AND id NOT IN (SELECT tid FROM kept)),
tg AS (SELECT target_rm_id, any_value(target_id) AS target_id, min(stratum) AS stratum, count(control_rm_id) AS n_matches, max(match_status) AS raw,
    CASE WHEN bool_or(match_status = 'matched') THEN 'matched' WHEN bool_or(match_status = 'no_control_available') THEN 'no_control_available' ELSE 'unmatched' END AS match_status,
    CASE WHEN coalesce(bool_or(quality_status = 'low_quality'), false) THEN 'low_quality' WHEN bool_or(match_status = 'matched') THEN 'acceptable' ELSE 'none' END AS quality_status,
    bool_or(thin_stratum) AS thin_stratum, max(match_strength) AS best_strength FROM pt GROUP BY target_rm_id)"""


def _ks(name: str, first: str, second: str, value: str) -> str:
    """CTEs that end in ``name`` (one row: statistic) for two row sources."""
    return f"""
{name}_f AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT {value} AS v, 1 AS a, 0 AS b FROM {first} UNION ALL SELECT {value}, 0, 1 FROM {second}) GROUP BY v),
{name} AS (SELECT max(abs(p - q)) AS statistic FROM (SELECT sum(a) OVER w / sum(a) OVER () AS p, sum(b) OVER w / sum(b) OVER () AS q FROM {name}_f WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)))"""


_SIDES = _kept(1, 0.8) + ",\ntr AS (SELECT * FROM st WHERE t = 1),\nct AS (SELECT st.*, kept.s AS strength FROM st JOIN kept ON st.id = cid)"

_DRIFT = _SIDES + """,
de AS (SELECT list_sort(list_distinct(quantile_cont(c_nationkey, [0.25, 0.5, 0.75]))) AS e FROM tr),
gr AS (SELECT id, side, strength, CASE WHEN v <= e[1] THEN 0 WHEN len(e) > 1 AND v <= e[2] THEN 1 WHEN len(e) > 2 AND v <= e[3] THEN 2 ELSE len(e) END AS g
    FROM (SELECT id, 1 AS side, NULL AS strength, c_nationkey AS v FROM tr UNION ALL SELECT id, 0, strength, c_nationkey FROM ct), de),
sh AS (SELECT g, count(*) FILTER (WHERE side = 1) / (SELECT count(*) FROM tr) AS ts, count(*) FILTER (WHERE side = 0) / (SELECT count(*) FROM ct) AS cs FROM gr GROUP BY g),
ex AS (SELECT g, ts, cs, floor(greatest(0.0, (cs - ts) * (SELECT count(*) FROM ct)))::BIGINT AS x FROM sh)"""

_BALANCED = _kept(1, 0.2) + ",\ntr AS (SELECT * FROM st WHERE t = 1),\nct AS (SELECT st.*, kept.s AS strength FROM st JOIN kept ON st.id = cid)," + _ks("k1", "tr", "ct", "c_acctbal") + "," + _ks("k2", "tr", "ct", "c_nationkey") + """,
j AS (SELECT region, count(*) FILTER (WHERE x = 1) / (SELECT count(*) FROM tr) AS p, count(*) FILTER (WHERE x = 0) / (SELECT count(*) FROM ct) AS q FROM (SELECT region, 1 AS x FROM tr UNION ALL SELECT region, 0 FROM ct) GROUP BY region),
j1 AS (SELECT greatest(0.0, sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * ln(q / ((p + q) / 2)) ELSE 0 END)) AS statistic FROM j),
de AS (SELECT list_sort(list_distinct(quantile_cont(c_nationkey, [0.25, 0.5, 0.75]))) AS e FROM tr),
gr AS (SELECT id, side, strength, CASE WHEN v <= e[1] THEN 0 WHEN len(e) > 1 AND v <= e[2] THEN 1 WHEN len(e) > 2 AND v <= e[3] THEN 2 ELSE len(e) END AS g
    FROM (SELECT id, 1 AS side, NULL AS strength, c_nationkey AS v FROM tr UNION ALL SELECT id, 0, strength, c_nationkey FROM ct), de),
sh AS (SELECT g, count(*) FILTER (WHERE side = 1) / (SELECT count(*) FROM tr) AS ts, count(*) FILTER (WHERE side = 0) / (SELECT count(*) FROM ct) AS cs FROM gr GROUP BY g),
ex AS (SELECT g, floor(greatest(0.0, (cs - ts) * (SELECT count(*) FROM ct))) AS x FROM sh),
gone AS (SELECT id FROM (SELECT id, x, row_number() OVER (PARTITION BY g ORDER BY strength, id) AS k FROM gr JOIN ex USING (g) WHERE side = 0) WHERE k <= x AND (SELECT statistic FROM k2) > 0.05),
af AS (SELECT * FROM ct WHERE id NOT IN (SELECT id FROM gone)),""" + _ks("a1", "tr", "af", "c_acctbal") + "," + _ks("a2", "tr", "af", "c_nationkey") + """,
ja AS (SELECT region, count(*) FILTER (WHERE x = 1) / (SELECT count(*) FROM tr) AS p, count(*) FILTER (WHERE x = 0) / (SELECT count(*) FROM af) AS q FROM (SELECT region, 1 AS x FROM tr UNION ALL SELECT region, 0 FROM af) GROUP BY region),
j2 AS (SELECT greatest(0.0, sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * ln(q / ((p + q) / 2)) ELSE 0 END)) AS statistic FROM ja)
SELECT variable, role, kind, round(b, 6) AS before, round(a, 6) AS after, threshold, b > threshold AS flagged_before, a > threshold AS flagged_after FROM (
    SELECT 'c_acctbal' AS variable, 'match' AS role, 'ks' AS kind, k1.statistic AS b, a1.statistic AS a, 0.05::DOUBLE AS threshold FROM k1, a1
    UNION ALL SELECT 'region', 'match', 'js', j1.statistic, j2.statistic, 0.1::DOUBLE FROM j1, j2
    UNION ALL SELECT 'c_nationkey', 'monitor', 'ks', k2.statistic, a2.statistic, 0.05::DOUBLE FROM k2, a2)"""


def _sample(size: int = 500) -> str:
    """Population keys, class and group quotas and the chosen ids."""
    return f"""WITH src AS (SELECT row_number() OVER (ORDER BY event_id) AS id, event_id, event_type, value::DOUBLE AS value, user_id::DOUBLE AS user_id FROM events),
nn AS (SELECT count(*) AS n FROM src),
ed AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM src),
pop AS (SELECT src.*, json_array(event_type)::VARCHAR AS l, json_array(CASE WHEN value <= e[1] THEN 0 WHEN value <= e[2] THEN 1 WHEN value <= e[3] THEN 2 ELSE 3 END)::VARCHAR AS g FROM src, ed),
c1 AS (SELECT l, count(*) AS np FROM pop GROUP BY l),
c2 AS (SELECT l, np, n, np::HUGEINT * {size} AS w FROM c1, nn),
cls AS (SELECT l, np, w::DOUBLE / n AS ideal, (w // n + CASE WHEN row_number() OVER (ORDER BY w % n DESC, md5('42:class:' || l), l) <= {size} - sum(w // n) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM c2),
g1 AS (SELECT l, g, count(*) AS np FROM pop GROUP BY l, g),
g2 AS (SELECT g1.*, cls.np AS nc, cls.quota AS cq, g1.np::HUGEINT * cls.quota AS w FROM g1 JOIN cls USING (l)),
qt AS (SELECT l, g, np, nc, cq, w::DOUBLE / nc AS ideal, (w // nc + CASE WHEN row_number() OVER (PARTITION BY l ORDER BY w % nc DESC, md5('42:group:' || l || ':' || g), g) <= cq - sum(w // nc) OVER (PARTITION BY l) THEN 1 ELSE 0 END)::BIGINT AS quota FROM g2),
sel AS (SELECT id FROM (SELECT id, quota, row_number() OVER (PARTITION BY l, g ORDER BY md5('42:row:' || id::VARCHAR), id) AS k FROM pop JOIN qt USING (l, g)) WHERE k <= quota),
mk AS (SELECT pop.*, (id IN (SELECT id FROM sel))::INT AS s FROM pop)"""


def _checked() -> str:
    def ks(var: str, scope: str) -> str:
        by = "l" if scope == "within_label" else "''"
        return f"""SELECT '{var}' AS variable, '{scope}' AS scope, k AS label, 'ks' AS kind, max(abs(p - q)) AS statistic, any_value(np) AS np, any_value(ns) AS ns, 0.05 AS threshold FROM (
            SELECT k, np, ns, sum(a) OVER w / np AS p, sum(b) OVER w / ns AS q FROM (SELECT k, v, a, b, sum(a) OVER (PARTITION BY k) AS np, sum(b) OVER (PARTITION BY k) AS ns FROM (SELECT {by} AS k, {var} AS v, count(*) AS a, sum(s) AS b FROM mk GROUP BY ALL))
            WINDOW w AS (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING)) GROUP BY k"""

    return _sample() + f""",
lj AS (SELECT sum(a) OVER () AS np, sum(b) OVER () AS ns, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM (SELECT event_type, count(*) AS a, sum(s) AS b FROM mk GROUP BY ALL)),
ch AS ({" UNION ALL ".join(ks(v, sc) for v in ("value", "user_id") for sc in ("overall", "within_label"))}),
bal AS (SELECT variable, 'feature' AS role, scope, label, kind, statistic, np::BIGINT AS np, ns::BIGINT AS ns, CASE WHEN statistic <= threshold THEN 'pass' ELSE 'fail' END AS status, true AS required FROM ch
    UNION ALL SELECT 'event_type', 'label', 'overall', '', 'js', st, np, ns, CASE WHEN st <= 0.1 THEN 'pass' ELSE 'fail' END, false FROM (
        SELECT greatest(0.0, sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * ln(q / ((p + q) / 2)) ELSE 0 END)) AS st, any_value(np)::BIGINT AS np, any_value(ns)::BIGINT AS ns FROM lj))"""


_CAP = "n_target, n_control, 4 * n_target AS requested_assignments, least(4 * n_target, n_control) AS assignment_capacity_ceiling, greatest(0, 4 * n_target - n_control) AS assignment_shortfall, least(n_target, n_control) AS targets_with_one_control_ceiling, least(n_target, n_control // 4) AS fully_supplied_targets_ceiling"


def _trial(bins: int) -> str:
    return f"SELECT * FROM ({_matched(n_bins=bins)} SELECT {bins}::BIGINT AS n_bins, count(*) AS n_target_strata, sum(assignment_shortfall)::BIGINT AS assignment_shortfall, sum(fully_supplied_targets_ceiling)::BIGINT AS fully_supplied_targets_ceiling, sum(n_target * n_control)::BIGINT AS candidate_pairs FROM (SELECT {_CAP} FROM cn WHERE n_target > 0))"


ORACLES: dict[str, str] = {
    "profile_summary": f"WITH {CUSTOMERS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_target = 1) AS n_target, count(*) FILTER (WHERE is_target = 0) AS n_control, count(*) FILTER (WHERE is_target IS NULL) AS n_treatment_null, 4::BIGINT AS n_numeric, 1::BIGINT AS n_categorical FROM g0",
    "profile_nulls": f"WITH {CUSTOMERS} SELECT variable, n_null, round(n_null / n, 9) AS null_rate FROM (SELECT unnest(['c_custkey', 'c_acctbal', 'c_nationkey', 'region', 'is_target']) AS variable, unnest([n - count(c_custkey), n - count(c_acctbal), n - count(c_nationkey), n - count(region), n - count(is_target)]) AS n_null, n FROM (SELECT * FROM g0), (SELECT count(*) AS n FROM g0) GROUP BY n)",
    "treatment_prepare": _matched("g0") + " SELECT id AS rm_id, t AS treatment, c_acctbal, region, c_custkey FROM p",
    "missing_flags": _matched("g0") + " SELECT gap AS balance_missing, region = '__MISSING__' AS region_missing, count(*) AS n FROM p GROUP BY ALL",
    "bin_edges_target": _matched() + " SELECT variable, unnest([1, 2, 3]) AS k, unnest(list_transform(e, lambda x: round(x, 6))) AS edge FROM (SELECT 'c_acctbal' AS variable, quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS e FROM p WHERE t = 1 UNION ALL SELECT 'c_nationkey', quantile_cont(c_nationkey, [0.25, 0.5, 0.75]) FROM p WHERE t = 1)",
    "bin_edges_population": "SELECT variable, unnest([1, 2, 3, 4]) AS k, unnest(list_transform(e, lambda x: round(x, 6))) AS edge FROM (SELECT 'l_quantity' AS variable, quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem UNION ALL SELECT 'l_extendedprice', quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) FROM lineitem)",
    "bucketize": _matched() + " SELECT c_custkey, bin FROM st",
    "stratum_key": _matched("g0") + " SELECT c_custkey, stratum FROM st",
    "stratum_counts": _matched() + " SELECT * FROM cn",
    "coverage_flags": _matched() + " SELECT *, n_control = 0 AS no_control, n_control > 0 AND n_control < greatest(40, ceil(4.0 * n_target)) AS thin_stratum, n_control > 0 AS eligible FROM cn WHERE n_target > 0",
    "capacity_strata": _matched() + f" SELECT stratum, {_CAP}, n_control = 0 AS no_control, n_control > 0 AND n_control < 5 AS thin_stratum FROM cn WHERE n_target > 0",
    "capacity_summary": _matched() + f""", x AS (SELECT {_CAP} FROM cn WHERE n_target > 0), w AS (SELECT sum(n_target)::BIGINT AS n_target, sum(n_control)::BIGINT AS n_control, sum(n_target * n_control)::BIGINT AS candidate_pairs, max(n_target * n_control) AS largest_stratum_pairs, sum(n_target * least(n_control, 10))::BIGINT AS retained_candidate_pairs FROM cn)
SELECT sum(requested_assignments)::BIGINT AS requested_assignments, sum(assignment_capacity_ceiling)::BIGINT AS assignment_capacity_ceiling, sum(assignment_shortfall)::BIGINT AS assignment_shortfall, sum(targets_with_one_control_ceiling)::BIGINT AS targets_with_one_control_ceiling,
    sum(fully_supplied_targets_ceiling)::BIGINT AS fully_supplied_targets_ceiling, count(*) AS n_target_strata, count(*) FILTER (WHERE assignment_shortfall > 0) AS n_deficient_strata, coalesce(sum(x.n_target) FILTER (WHERE assignment_shortfall > 0), 0)::BIGINT AS n_targets_in_deficient_strata,
    any_value(w.n_target) AS n_target, any_value(w.n_control) AS n_control, any_value(candidate_pairs) AS candidate_pairs, any_value(largest_stratum_pairs) AS largest_stratum_pairs, any_value(retained_candidate_pairs) AS retained_candidate_pairs, greatest(0, 4 * any_value(w.n_target) - any_value(w.n_control)) AS global_assignment_shortfall,
    round(sum(targets_with_one_control_ceiling) / any_value(w.n_target), 9) AS coverage_ceiling, round(sum(fully_supplied_targets_ceiling) / any_value(w.n_target), 9) AS full_ratio_coverage_ceiling FROM x, w""",
    "capacity_trials": " UNION ALL ".join(_trial(b) for b in (4, 2, 8)),
    "grouping_cardinality": _matched("g0") + " SELECT 'groups' AS kind, 'c_acctbal' AS variable, count(DISTINCT bin) AS n FROM st UNION ALL SELECT 'groups', 'region', count(DISTINCT region) FROM st UNION ALL SELECT 'missing', 'c_acctbal', count(*) FILTER (WHERE gap) FROM st",
    "stratum_group_values": _matched() + " SELECT stratum, region, bin, round(CASE WHEN bin > 0 THEN e[bin] END, 6) AS lower_exclusive, round(CASE WHEN bin < 3 THEN e[bin + 1] END, 6) AS upper_inclusive FROM (SELECT stratum, any_value(region) AS region, any_value(bin) AS bin FROM st GROUP BY stratum HAVING sum(t) > 0), ed",
    "target_moments": _matched() + " SELECT 'c_acctbal' AS variable, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std FROM p WHERE t = 1 UNION ALL SELECT 'c_nationkey', round(avg(c_nationkey), 6), round(stddev_pop(c_nationkey), 6) FROM p WHERE t = 1",
    "zscores": _matched() + " SELECT c_custkey, round(z * 1.5, 6) AS z FROM z",
    "pair_scores": _matched() + " SELECT stratum, tid AS target_rm_id, cid AS control_rm_id, round(s, 6) AS match_strength FROM pr",
    "topk_candidates": _matched() + " SELECT stratum, tid AS target_rm_id, cid AS control_rm_id, round(s, 6) AS match_strength FROM pr QUALIFY row_number() OVER (PARTITION BY tid ORDER BY s DESC, cid) <= 3",
    "nearest_control": _matched() + " SELECT tid AS target_rm_id, cid AS control_rm_id, round(s, 6) AS match_strength FROM pr QUALIFY row_number() OVER (PARTITION BY tid ORDER BY s DESC, cid) = 1",
    "greedy_assign": _greedy() + _ASSIGNED,
    "greedy_assign_1to2": _greedy(2) + _ASSIGNED,
    "greedy_assign_rounds": _greedy() + _ASSIGNED,
    "greedy_assign_rounds_ties": _walk(2, "floor(c_acctbal / 1000)::DOUBLE") + _ASSIGNED,
    "greedy_assign_categories": _walk(2, "0.0::DOUBLE") + _ASSIGNED,
    "match_order": _PAIRS.replace(_kept(1, 0.2), _kept(2, 0.2)) + " SELECT row_number() OVER (ORDER BY target_rm_id, match_rank NULLS LAST) AS place, target_rm_id, match_rank FROM pt",
    "drift_log": _DRIFT + """, k2 AS (SELECT max(abs(p - q)) AS statistic FROM (SELECT sum(a) OVER w / sum(a) OVER () AS p, sum(b) OVER w / sum(b) OVER () AS q FROM (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT c_nationkey AS v, 1 AS a, 0 AS b FROM tr UNION ALL SELECT c_nationkey, 0, 1 FROM ct) GROUP BY v) WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))),
gone AS (SELECT * FROM (SELECT id, g, ts, cs, x, strength, row_number() OVER (PARTITION BY g ORDER BY strength, id) AS k FROM gr JOIN ex USING (g) WHERE side = 0) WHERE k <= x AND (SELECT statistic FROM k2) > 0.01)
SELECT 'c_nationkey' AS variable, 'ks' AS kind, g::VARCHAR AS "group", count(*) AS n_removed, round(any_value(ts), 6) AS target_share, round(any_value(cs), 6) AS control_share, string_agg(id::VARCHAR, ',' ORDER BY strength, id) AS control_rm_ids FROM gone GROUP BY g""",
    "capacity_report": _matched() + f" SELECT row_number() OVER (ORDER BY assignment_shortfall DESC, stratum) AS place, stratum, assignment_shortfall FROM (SELECT stratum, {_CAP} FROM cn WHERE n_target > 0) ORDER BY place LIMIT 5",
    "capacity_advice": _matched() + """, q AS (SELECT sum(n_target)::BIGINT AS t, greatest(0, 6 * sum(n_target) - sum(n_control)) AS lack, sum(greatest(0, 6 * n_target - n_control)) AS short FROM cn)
SELECT 'control_pool' AS setting, 6 * t AS proposed_value, 'measured_global_counts' AS evidence FROM q WHERE lack > 0 UNION ALL SELECT 'n_bins', 2, 'untested_suggestion' FROM q WHERE short > 0 UNION ALL SELECT 'stratify_vars', NULL, 'untested_suggestion' FROM q WHERE short > 0""",
    "sql_views": _BALANCED[: _BALANCED.rindex("SELECT variable")] + "SELECT st.stratum, count(DISTINCT st.id) AS n_target, count(k.cid) AS n_pairs FROM st LEFT JOIN (SELECT * FROM kept WHERE cid IN (SELECT id FROM af)) k ON k.tid = st.id WHERE t = 1 GROUP BY st.stratum",
    "sources": f"WITH {CUSTOMERS} SELECT unnest(['csv', 'tsv', 'parquet', 'table', 'arrow', 'pandas', 'spark']) AS source, n, keys, balance, n_regions FROM (SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys, round(sum(c_acctbal), 2) AS balance, count(DISTINCT region) AS n_regions FROM c0)",
    "latin1_source": f"WITH {CUSTOMERS} SELECT 'Übersee ' || region AS region, count(*) AS n_target FROM c0 WHERE is_target = 1 GROUP BY region",
    "zstd_holdout": "SELECT side, count(*) AS n, min(k) AS first, max(k) AS last, sum(doc_id)::BIGINT AS ids FROM (SELECT CASE WHEN k <= n - 20 THEN 'train' ELSE 'held_out' END AS side, k, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n, doc_id FROM labels)) GROUP BY side",
    "downsample": _sample() + " SELECT row_number() OVER (ORDER BY id) AS place, event_id::BIGINT AS event_id, event_type FROM mk WHERE s = 1",
    "downsample_report": _sample(37) + " SELECT (SELECT n FROM nn) AS n_population, 37::BIGINT AS requested_rows, sum(quota)::BIGINT AS sampled_rows, count(DISTINCT l) AS n_classes, (SELECT count(*) FROM cls WHERE quota = 0) AS omitted_classes, count(*) AS n_strata, count(*) FILTER (WHERE quota = 0) AS omitted_strata, 2 * (1 + count(DISTINCT l)) AS feature_checks, round(coalesce(sum(np) FILTER (WHERE quota = 0), 0) / (SELECT n FROM nn), 9) AS omitted_share FROM qt",
    "downsample_export": _sample(120) + " SELECT event_id::BIGINT AS event_id, 120::BIGINT AS manifest_rows FROM mk WHERE s = 1",
    "id_profile": " UNION ALL ".join(f"SELECT '{v}' AS variable, count(*) AS n, count(*) - count({v}) AS n_missing, count(DISTINCT {v}) AS n_different, min({v}) AS least, max({v}) AS most, count(DISTINCT {v}) = count(*) AS is_key FROM orders" for v in ("o_orderkey", "o_custkey")),
    "plot_histogram": f"""WITH {CUSTOMERS}, b AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 10 AS w FROM c0), h AS (SELECT region, least(9, floor((c_acctbal - lo) / w))::INT AS bin, any_value(lo) AS lo, any_value(w) AS w, count(*) AS n FROM c0, b GROUP BY ALL)
SELECT region AS "group", bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, n FROM h""",
    "plot_ecdf": f"""WITH {CUSTOMERS}, b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM c0), p AS (SELECT CASE WHEN k = 10 THEN hi ELSE lo + (hi - lo) * k / 10 END AS v FROM b, range(11) r(k))
SELECT region AS "group", round(v, 4) AS value, round(count(*) FILTER (WHERE c_acctbal <= v) / count(*), 9) AS share FROM c0, p GROUP BY region, v""",
    "greedy_assign_capped": _greedy(1, 3) + _ASSIGNED,
    "tolerance_cutoff": _kept(2, 0.8) + " SELECT round(c, 6) AS cutoff FROM cut",
    "tolerance_kept": _kept(2, 0.8) + " SELECT tid AS target_rm_id, cid AS control_rm_id, k AS match_rank, round(s, 6) AS match_strength FROM kept",
    "match_pairs": _PAIRS + " SELECT * REPLACE (round(match_strength, 6) AS match_strength) FROM pt",
    "match_targets": _PAIRS + " SELECT target_rm_id, target_id, stratum, n_matches, match_status, quality_status, thin_stratum, round(best_strength, 6) AS best_strength FROM tg",
    "coverage_summary": _PAIRS + """ SELECT count(*) AS n_target, count(*) FILTER (WHERE match_status = 'matched') AS n_matched, sum(n_matches)::BIGINT AS n_unique_controls, count(*) FILTER (WHERE match_status = 'no_control_available') AS n_no_control, 0::BIGINT AS n_below_tolerance,
    count(*) FILTER (WHERE quality_status = 'low_quality') AS n_low_quality, count(*) FILTER (WHERE match_status = 'unmatched') AS n_unmatched, count(*) FILTER (WHERE thin_stratum) AS n_thin_stratum, round(count(*) FILTER (WHERE match_status = 'matched') / count(*), 6) AS pct_matched,
    round(count(*) FILTER (WHERE match_status = 'no_control_available') / count(*), 6) AS pct_no_control, 0.0::DOUBLE AS pct_below_tolerance, (SELECT round(c, 6) FROM cut) AS tolerance_cutoff FROM tg""",
    "balance_ks": _SIDES + "," + _ks("k1", "tr", "ct", "c_acctbal") + "," + _ks("k2", "tr", "ct", "c_nationkey") + " SELECT 'c_acctbal' AS variable, 'match' AS role, 'ks' AS kind, round(statistic, 6) AS statistic FROM k1 UNION ALL SELECT 'c_nationkey', 'monitor', 'ks', round(statistic, 6) FROM k2",
    "balance_js": f"WITH {CUSTOMERS}, f AS (SELECT region, count(*) FILTER (WHERE is_target = 1) / (SELECT count(*) FROM c0 WHERE is_target = 1) AS p, count(*) FILTER (WHERE is_target = 0) / (SELECT count(*) FROM c0 WHERE is_target = 0) AS q FROM c0 GROUP BY region) SELECT 'region' AS variable, 'match' AS role, 'js' AS kind, round(greatest(0.0, sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * ln(q / ((p + q) / 2)) ELSE 0 END)), 6) AS statistic FROM f",
    "balance_table": _BALANCED,
    "drift_excess": _DRIFT + """ SELECT g::VARCHAR AS "group", round(ts, 6) AS target_share, round(cs, 6) AS control_share, x AS excess_rows FROM ex WHERE x > 0""",
    "drift_trim": _DRIFT + """ SELECT id AS control_rm_id, g::VARCHAR AS "group" FROM (SELECT id, g, x, row_number() OVER (PARTITION BY g ORDER BY strength, id) AS k FROM gr JOIN ex USING (g) WHERE side = 0) WHERE k <= x""",
    "sample_classes": _sample() + " SELECT l AS label, np AS n_population, round(ideal, 6) AS ideal_quota, quota AS allocated_rows, count(*) FILTER (WHERE s = 1) AS sampled_rows, round(np / (SELECT n FROM nn), 9) AS population_share, round(quota - ideal, 6) AS rounding_deviation FROM cls JOIN mk USING (l) GROUP BY l, np, ideal, quota",
    "sample_quotas": _sample() + " SELECT l AS label, g AS feature_group, np AS n_population, nc AS n_class, cq AS class_quota, round(ideal, 6) AS ideal_quota, quota FROM qt",
    "sample_rows": _sample() + " SELECT id AS row_id, event_id, event_type, round(value, 6) AS value FROM mk WHERE s = 1",
    "sample_simple": "SELECT id AS row_id FROM (SELECT row_number() OVER (ORDER BY event_id) AS id FROM events) ORDER BY md5('42:row:' || id::VARCHAR), id LIMIT 100",
    "sample_full": "SELECT count(*) AS n, count(DISTINCT event_id) AS n_different, count(*) AS last FROM events",
    "sample_balance_overall": _checked() + " SELECT variable, role, kind, round(statistic, 6) AS statistic, np AS n_population, ns AS n_sample, np AS n_valid_population, ns AS n_valid_sample, status, required FROM bal WHERE scope = 'overall'",
    "sample_balance_within": _checked() + " SELECT variable, label, kind, round(statistic, 6) AS statistic, np AS n_population, ns AS n_sample, status FROM bal WHERE scope = 'within_label'",
    "sample_status": _checked() + " SELECT status, count(*) AS n FROM bal WHERE required GROUP BY status",
    "sample_strata_report": _sample(37) + " SELECT l AS label, g AS feature_group, quota AS allocated_rows, quota AS sampled_rows, round(np / (SELECT n FROM nn), 9) AS population_share, round(np / nc, 9) AS within_class_population_share, round(quota / nullif(cq, 0), 9) AS within_class_sample_share FROM qt",
    "ab_group_means": _SIDES + " SELECT arm, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN (SELECT c_custkey, CASE WHEN t = 1 THEN 'treated' WHEN id IN (SELECT cid FROM kept) THEN 'control' ELSE 'rest' END AS arm FROM st) ON o_custkey = c_custkey GROUP BY arm",
    "ab_analysis_table": _PAIRS + " SELECT arm, c_custkey, round(c_acctbal, 6) AS c_acctbal, region FROM (SELECT DISTINCT 'treated' AS arm, target_rm_id AS id FROM pt UNION ALL SELECT 'control', control_rm_id FROM pt WHERE control_rm_id IS NOT NULL) JOIN st USING (id)",
    "match_status_counts": _PAIRS + " SELECT match_status, quality_status, count(*) AS n FROM pt GROUP BY ALL",
    "ab_crosstab": f"WITH {CUSTOMERS} SELECT region, round(count(*) FILTER (WHERE is_target = 0) / (SELECT count(*) FROM c0 WHERE is_target = 0), 9) AS rest, round(count(*) FILTER (WHERE is_target = 1) / (SELECT count(*) FROM c0 WHERE is_target = 1), 9) AS treated FROM c0 GROUP BY region",
    "feature_profile": " UNION ALL ".join(f"SELECT '{v}' AS variable, count({v}) AS n, round(min({v}), 6) AS least, round(max({v}), 6) AS most, round(avg({v}), 6) AS mean, count(*) FILTER (WHERE {v} IS NULL OR NOT isfinite({v})) AS n_not_finite FROM lineitem" for v in ("l_quantity", "l_extendedprice", "l_discount")),
    "tail_holdout": "SELECT CASE WHEN k <= n - 20 THEN 'train' ELSE 'held_out' END AS side, k AS source_row_id, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n, doc_id FROM labels)",
    "random_control_baseline": f"WITH {CUSTOMERS} SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:row:' || c_custkey::VARCHAR), c_custkey) AS k FROM c0 WHERE is_target = 0) WHERE k <= (SELECT count(*) FROM c0 WHERE is_target = 1)",
}
