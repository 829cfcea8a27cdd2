"""SQL of recursions that several registered queries share, for the engine they are held against."""

from __future__ import annotations

from panelloom import config


def accounts_sql(rate: float = config.COST_RATE, rounds: int = 6) -> str:
    """CTEs of accounts day by day, from ``idx`` (bars by index_code), ``cal``, ``cs(case_id, d, mode)`` and ``tw(case_id, signal_date, index_code, weight)``.

    Ends in ``path(case_id, account_id, pos, u, cash, nav, traded, done, p, wanted)`` with
    lists by instrument in the order of ``cd``; ``dy`` names the days and ``slot`` the days of
    rebalancing. The value after costs comes by ``rounds`` steps of V' = V - rate x sum |w V' - p|, each of
    which leaves a thousandth of the error."""

    def each(body: str) -> str:
        return f"list_transform(range(1, len(m) + 1), lambda i: {body})"

    q = "SELECT p.case_id, p.account_id, p.pos + 1 AS pos, p.u, p.cash, d.m, CASE WHEN mode = 'close' THEN d.c ELSE d.v END AS f, a.w FROM path p JOIN dy d ON d.pos = p.pos + 1 JOIN cs USING (case_id) LEFT JOIN act a ON a.case_id = p.case_id AND a.account_id = p.account_id AND a.pos = p.pos + 1"
    q = f"SELECT *, {each('(w IS NOT NULL AND coalesce(f[i], 0) > 0 AND (u[i] > 0 OR w[i] > 0))')} AS able FROM ({q})"
    q = f"SELECT *, {each('CASE WHEN able[i] THEN u[i] * f[i] ELSE 0 END')} AS p, list_sum({each('CASE WHEN NOT able[i] THEN u[i] * m[i] ELSE 0 END')}) AS frozen FROM ({q})"
    q = f"SELECT *, cash + list_sum(p) AS part FROM ({q})"
    q = f"SELECT * REPLACE ({each('able[i] AND part > 1e-12 * (part + frozen)')} AS able, {each('CASE WHEN part > 1e-12 * (part + frozen) THEN p[i] ELSE 0 END')} AS p) FROM ({q})"
    q = f"SELECT *, {each('CASE WHEN able[i] AND part <> 0 THEN w[i] * (part + frozen) / part ELSE 0 END')} AS g0 FROM ({q})"
    q = f"SELECT *, {each('g0[i] / greatest(1, list_sum(g0))')} AS g, part AS v0 FROM ({q})"
    for k in range(rounds):
        q = f"SELECT *, part - {rate} * list_sum({each(f'abs(g[i] * v{k} - p[i])')}) AS v{k + 1} FROM ({q})"
    v = f"v{rounds}"
    q = f"SELECT *, list_bool_or(able) AS done, {each(f'g[i] * {v}')} AS wanted, {each(f'CASE WHEN able[i] THEN g[i] * {v} / f[i] ELSE u[i] END')} AS u2, CASE WHEN list_bool_or(able) THEN {v} * (1 - list_sum(g)) ELSE cash END AS cash2 FROM ({q})"
    step = f"SELECT case_id, account_id, pos, u2, cash2, cash2 + list_sum({each('u2[i] * m[i]')}), list_sum({each('abs(wanted[i] - p[i])')}), done, p, wanted FROM ({q})"
    return f"""cd AS (SELECT index_code, ROW_NUMBER() OVER (ORDER BY index_code) AS k FROM (SELECT DISTINCT index_code FROM idx)),
  px AS (SELECT cal.pos, cal.date, k, close, vwap, LAST_VALUE(close IGNORE NULLS) OVER (PARTITION BY k ORDER BY cal.pos ROWS UNBOUNDED PRECEDING) AS last FROM cal CROSS JOIN cd LEFT JOIN idx ON idx.date = cal.date AND idx.index_code = cd.index_code),
  dy AS MATERIALIZED (SELECT pos, date, list(close ORDER BY k) AS c, list(vwap ORDER BY k) AS v, list(coalesce(last, 0.0) ORDER BY k) AS m FROM px GROUP BY pos, date),
  wl AS (SELECT s.case_id, s.signal_date, list(coalesce(tw.weight, 0.0) ORDER BY k) AS w FROM (SELECT DISTINCT case_id, signal_date FROM tw) s CROSS JOIN cd LEFT JOIN tw ON tw.case_id = s.case_id AND tw.signal_date = s.signal_date AND tw.index_code = cd.index_code GROUP BY 1, 2),
  slot AS (SELECT case_id, CAST((pos - 1 - sh) % d + 1 AS INT) AS account_id, pos, date, CASE WHEN sh = 0 THEN date ELSE before END AS signal_date FROM (SELECT *, CASE WHEN mode = 'close' THEN 0 ELSE 1 END AS sh FROM cs), (SELECT *, LAG(date) OVER (ORDER BY date) AS before FROM cal) WHERE pos - 1 - sh >= 0),
  act AS MATERIALIZED (SELECT slot.*, wl.w FROM slot JOIN wl USING (case_id, signal_date)),
  path(case_id, account_id, pos, u, cash, nav, traded, done, p, wanted) AS (SELECT case_id, CAST(unnest(range(1, d + 1)) AS INT), 0, (SELECT list(0.0::DOUBLE) FROM cd), 1.0::DOUBLE / d, 1.0::DOUBLE / d, 0.0::DOUBLE, FALSE, (SELECT list(0.0::DOUBLE) FROM cd), (SELECT list(0.0::DOUBLE) FROM cd) FROM cs UNION ALL {step}),
  days AS (SELECT path.*, dy.date, {rate} * traded AS cost, len(list_filter(range(1, len(u) + 1), lambda i: u[i] * m[i] > 1e-9 * nav)) AS n_holdings FROM path JOIN dy USING (pos)),
  total AS (SELECT case_id, date, SUM(nav) AS nav, SUM(traded) AS traded, SUM(cost) AS cost, SUM(n_holdings) AS n_holdings, COUNT(*) FILTER (WHERE done) AS n_rebalanced FROM days GROUP BY 1, 2)"""


def linkage_sql(members: str, pairs: str, thresholds: tuple[float, ...]) -> str:
    """CTEs of complete linkage step by step, from members(selection_date, index_code) and pairs(selection_date, code_a, code_b, corr).

    Ends in ``clusters(selection_date, corr_threshold, index_code, cluster_id)``. The state is a matrix as
    lists; each step merges the closest two clusters, of equal ones the smallest."""
    pick = "list_min(list_filter(flatten(list_transform(range(1, len(d) + 1), lambda i: list_transform(range(i + 1, len(d) + 1), lambda j: {'d': d[i][j], 'i': i, 'j': j}))), lambda x: x.d IS NOT NULL))"
    merged = "list_transform(range(1, len(d) + 1), lambda r: list_transform(range(1, len(d) + 1), lambda c: CASE WHEN r = m.j OR c = m.j THEN NULL WHEN r = m.i THEN CASE WHEN d[m.i][c] IS NULL OR d[m.j][c] IS NULL THEN NULL ELSE greatest(d[m.i][c], d[m.j][c]) END WHEN c = m.i THEN CASE WHEN d[r][m.i] IS NULL OR d[r][m.j] IS NULL THEN NULL ELSE greatest(d[r][m.i], d[r][m.j]) END ELSE d[r][c] END))"
    return f"""mb AS (SELECT selection_date, index_code, ROW_NUMBER() OVER (PARTITION BY selection_date ORDER BY index_code) AS k FROM {members}),
  cell AS (SELECT a.selection_date, a.k AS r, b.k AS c, 1 - p.corr AS x FROM mb a JOIN mb b USING (selection_date) LEFT JOIN {pairs} p ON p.selection_date = a.selection_date AND p.code_a = LEAST(a.index_code, b.index_code) AND p.code_b = GREATEST(a.index_code, b.index_code) AND a.k <> b.k),
  start AS (SELECT selection_date, list(row ORDER BY r) AS d FROM (SELECT selection_date, r, list(x ORDER BY c) AS row FROM cell GROUP BY 1, 2) GROUP BY 1),
  tree(selection_date, corr_threshold, d, lab, go) AS (SELECT selection_date, CAST(t AS DOUBLE), d, list_transform(range(1, len(d) + 1), lambda i: CAST(i AS BIGINT)), TRUE FROM start, (VALUES {', '.join(f'({t})' for t in thresholds)}) v(t)
    UNION ALL SELECT selection_date, corr_threshold, {merged}, list_transform(lab, lambda x: CASE WHEN x = m.j THEN m.i ELSE x END), TRUE FROM (SELECT *, {pick} AS m FROM tree) WHERE m IS NOT NULL AND m.d <= 1 - corr_threshold + 1e-12),
  final AS (SELECT selection_date, corr_threshold, arg_min(lab, len(list_distinct(lab))) AS lab FROM tree GROUP BY 1, 2),
  tops AS (SELECT selection_date, corr_threshold, UNNEST(range(1, len(lab) + 1)) AS k, UNNEST(lab) AS top FROM final),
  clusters AS (SELECT tops.selection_date, corr_threshold, index_code, CAST(DENSE_RANK() OVER (PARTITION BY tops.selection_date, corr_threshold ORDER BY top) AS INT) AS cluster_id FROM tops JOIN mb ON mb.selection_date = tops.selection_date AND mb.k = tops.k)"""
