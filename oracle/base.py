"""Shared steps of the checking SQL.

Each step is one common table expression; ``with_steps`` puts the ones a query
needs, and what they need, in front of it.  The steps rank rows with window
functions over the single facts, where the Spark side aggregates readings.
"""

import re

from ledgerline.dims import template as T
from ledgerline.sources.recipes import BALANCES, DUAL_CURRENCY, REVENUE_LIKE, SPANS


def q(s):
    return "'" + str(s).replace("'", "''") + "'"


def names(xs):
    return ", ".join(q(x) for x in xs)


def _lines(recipes):
    return "[" + ", ".join(
        f"CASE WHEN {cond.format(y0='(SELECT y0 FROM yrs)')} THEN {{'tag': {q(tag)}, 'unit0': {q(unit)}, 'measure': {q(m)}, "
        f"'num': {num}::BIGINT, 'den': {den}::BIGINT}} END" for tag, unit, m, num, den, cond in recipes) + "]"


STEPS = {}


def step(name, body):
    STEPS[name] = body


step("filers", """
  SELECT s_suppkey AS cik, s_name AS name,
         'S' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker,
         CASE s_suppkey % 7 WHEN 0 THEN '7372' WHEN 1 THEN '6021' WHEN 2 THEN '6331' WHEN 3 THEN '6311'
              WHEN 4 THEN '6324' WHEN 5 THEN '6211' ELSE '6798' END AS sic_code,
         CASE s_suppkey % 7 WHEN 0 THEN 'corporate' WHEN 1 THEN 'bank' WHEN 2 THEN 'pc' WHEN 3 THEN 'life'
              WHEN 4 THEN 'health' WHEN 5 THEN 'advisory' ELSE 'reit' END AS industry
  FROM supplier""")
step("sales", """
  SELECT l_suppkey AS cik, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS ym,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qy,
         l_returnflag AS rf, l_linestatus AS ls
  FROM lineitem""")
step("yrs", "SELECT min(year(l_shipdate)) AS y0, max(year(l_shipdate)) AS y1 FROM lineitem")
step("each_year", "SELECT unnest(range(y0, y1 + 1)) AS y, y0, y1 FROM yrs")
step("quarter_months", "SELECT * FROM (VALUES (1, 0, 3, FALSE), (2, 3, 6, FALSE), (3, 6, 9, FALSE), (1, 0, 4, TRUE), (2, 4, 7, TRUE), (3, 7, 9, TRUE)) v(q, m0, m1, odd)")
step("asked", """
  SELECT 'FY' AS kind, y AS yr, 4 AS q, y * 12 AS ym0, y * 12 + 11 AS ym1, CAST(NULL AS BOOLEAN) AS odd FROM each_year WHERE y < y1
  UNION ALL SELECT 'INST', y, 4, 0, y * 12 + 11, NULL FROM each_year WHERE y < y1
  UNION ALL SELECT 'JUN', y, 2, y * 12 - 6, y * 12 + 5, NULL FROM each_year WHERE y < y1 AND y BETWEEN y0 + 1 AND y0 + 3
  UNION ALL SELECT 'YTD', y, q, y * 12, y * 12 + m1 - 1, odd FROM each_year JOIN quarter_months ON TRUE WHERE y >= y0 + 2
  UNION ALL SELECT 'INST', y, q, 0, y * 12 + m1 - 1, odd FROM each_year JOIN quarter_months ON TRUE WHERE y >= y0 + 2
  UNION ALL SELECT 'QTR', y, q, y * 12 + m0, y * 12 + m1 - 1, odd FROM each_year JOIN quarter_months ON TRUE WHERE q > 1 AND y >= greatest(y0 + 2, y1 - 1)""")
step("bysm", """
  SELECT cik, ym, sum(cents) AS ra, sum(CASE WHEN rf <> 'R' THEN cents ELSE 0 END) AS rc,
         sum(CASE WHEN ls = 'F' THEN cents ELSE 0 END) AS fa,
         sum(CASE WHEN ls = 'F' AND rf <> 'R' THEN cents ELSE 0 END) AS fc, sum(qy) AS qt
  FROM sales GROUP BY ALL""")
step("spans", """
  SELECT cik, CASE (cik % 7) WHEN 0 THEN 'corporate' WHEN 1 THEN 'bank' WHEN 2 THEN 'pc' WHEN 3 THEN 'life'
              WHEN 4 THEN 'health' WHEN 5 THEN 'advisory' ELSE 'reit' END AS industry,
         kind, CAST(yr AS BIGINT) AS yr, CAST(q AS BIGINT) AS q,
         CASE WHEN kind <> 'INST' THEN make_date(ym0 // 12, ym0 % 12 + 1, 1)
              - CAST(CASE WHEN cik % 9 = 7 AND kind <> 'JUN' THEN (CASE WHEN kind = 'QTR' THEN yr ELSE yr - 1 END) % 5 ELSE 0 END AS INTEGER) END AS start,
         last_day(make_date(ym1 // 12, ym1 % 12 + 1, 1)) - CAST(CASE WHEN cik % 9 = 7 AND kind <> 'JUN' THEN yr % 5 ELSE 0 END AS INTEGER) AS "end",
         CAST(sum(ra) AS BIGINT) AS ra, CAST(sum(rc) AS BIGINT) AS rc, CAST(sum(fa) AS BIGINT) AS fa,
         CAST(sum(fc) AS BIGINT) AS fc, CAST(sum(qt) AS BIGINT) AS qt
  FROM bysm JOIN asked ON ym BETWEEN ym0 AND ym1 AND (odd IS NULL OR odd = (cik % 9 = 4))
  WHERE NOT ((kind IN ('YTD', 'QTR') OR (kind = 'INST' AND q < 4)) AND yr = (SELECT y1 FROM yrs) AND ((cik % 9 = 1 AND q > 1) OR (cik % 9 = 2 AND q > 2)))
    AND NOT ((kind IN ('YTD', 'QTR') OR (kind = 'INST' AND q < 4)) AND cik % 8 = 6)
    AND NOT (kind = 'FY' AND yr = (SELECT y1 - 3 FROM yrs) AND cik % 15 = 8) AND NOT (kind = 'JUN' AND cik % 6 <> 1)
  GROUP BY cik, kind, yr, q, ym0, ym1""")
step("filed_in", """
  SELECT *, CASE WHEN cik % 20 = 5 THEN '20-F' ELSE '10-K' END AS form, make_date(yr + 1, 2, 15) AS filed, 1 AS seq,
         yr + 1 AS ay, FALSE AS cut, 1 AS vn, 1 AS vd, 0 AS ro FROM spans WHERE kind = 'FY' OR (kind = 'INST' AND q = 4)
  UNION ALL SELECT *, CASE WHEN cik % 20 = 5 THEN '20-F' ELSE '10-K' END, make_date(yr + 2, 2, 15), 1, yr + 2, cik % 4 = 0, 1, 1, 0
    FROM spans WHERE (kind = 'FY' OR (kind = 'INST' AND q = 4)) AND yr <= (SELECT y1 - 2 FROM yrs)
  UNION ALL SELECT *, CASE WHEN cik % 20 = 5 THEN '20-F' ELSE '10-K' END, make_date(yr + 3, 2, 15), 1, yr + 3, cik % 4 = 0, 1, 1, 0
    FROM spans WHERE kind = 'FY' AND yr <= (SELECT y1 - 3 FROM yrs)
  UNION ALL SELECT *, 'DEF 14A', make_date(yr + 1, 4, 30), 9, yr + 1, FALSE, 3, 1, 1 FROM spans WHERE kind = 'FY' AND cik % 5 = 0
  UNION ALL SELECT *, '10-K/A', make_date((SELECT y1 - 2 FROM yrs), 12, 1), 8, (SELECT y1 - 2 FROM yrs), FALSE, 1000000, 1, 1 FROM spans WHERE kind = 'FY' AND cik % 10 = 7 AND yr = (SELECT y1 - 3 FROM yrs)
  UNION ALL SELECT *, '10-K/A', make_date((SELECT y1 FROM yrs), 12, 1), 8, (SELECT y1 FROM yrs), FALSE, 11, 10, 1 FROM spans WHERE kind = 'FY' AND cik % 10 = 3 AND yr = (SELECT y1 - 4 FROM yrs)
  UNION ALL SELECT *, '10-K/A', make_date((SELECT y1 FROM yrs), 6, 1), 8, (SELECT y1 FROM yrs), FALSE, CASE WHEN cik % 22 = 5 THEN 11 ELSE 1 END, CASE WHEN cik % 22 = 5 THEN 10 ELSE 1 END, 2
    FROM spans WHERE kind = 'INST' AND q = 4 AND cik % 11 = 5 AND yr = (SELECT y1 - 1 FROM yrs)
  UNION ALL SELECT *, '10-K', make_date(yr, 9, 1), 6, yr, FALSE, 1, 1, 1 FROM spans WHERE kind = 'JUN'
  UNION ALL SELECT *, '10-Q', make_date(yr, q * 3 + 2, 10), 1, yr, FALSE, 1, 1, 0 FROM spans WHERE kind IN ('YTD', 'QTR') OR (kind = 'INST' AND q < 4)
  UNION ALL SELECT *, '10-Q', make_date(yr + 1, q * 3 + 2, 10), 1, yr + 1, cik % 2 = 0, 1, 1, 0 FROM spans WHERE kind = 'YTD' AND yr < (SELECT y1 FROM yrs)""")
step("reported", f"""
  SELECT *, unnest(CASE WHEN kind = 'INST' THEN {_lines(BALANCES)} ELSE {_lines(SPANS)} END) AS line FROM filed_in""")
step("priced", f"""
  SELECT cik, line.tag AS tag, line.unit0 AS unit0, start, "end", kind, q, form, filed, seq, ay,
         ((CASE line.measure WHEN 'rev' THEN CASE WHEN cut THEN rc ELSE ra END WHEN 'fin' THEN CASE WHEN cut THEN fc ELSE fa END
                WHEN 'gp' THEN CASE WHEN cut THEN rc - fc ELSE ra - fa END ELSE qt END) * line.num // line.den) * vn // vd AS whole
  FROM reported WHERE line IS NOT NULL AND (ro = 0 OR (ro = 1 AND line.tag IN ({names(REVENUE_LIKE)})) OR (ro = 2 AND line.tag = 'Liabilities'))""")
_DUAL = f"(cik % 10 = 0 AND tag IN ({names(DUAL_CURRENCY)}) AND unit0 = 'USD')"
step("raw", f"""
  SELECT cik, CASE tag WHEN 'EntityCommonStockSharesOutstanding' THEN 'dei' WHEN 'Supplies' THEN 'ext' ELSE 'us-gaap' END AS ns,
         tag, unit, unit_ord, start, "end", CAST(whole * mult AS DOUBLE) AS val, form, filed,
         (date_diff('day', DATE '1990-01-01', "end") * 20000 + date_diff('day', DATE '1990-01-01', filed)) * 1000
           + coalesce(date_diff('day', start, "end"), 0) AS pos,
         lpad(CAST(cik AS VARCHAR), 10, '0') || '-' || lpad(CAST(ay % 100 AS VARCHAR), 2, '0') || '-'
           || lpad(CAST(CASE WHEN form = '10-Q' THEN month(filed) ELSE 0 END * 10 + seq AS VARCHAR), 6, '0') AS accn,
         CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || CAST(q AS VARCHAR) END AS fp
  FROM (
    SELECT *, CASE WHEN cik % 20 = 5 OR (cik % 10 = 0 AND tag = 'InterestExpense') THEN replace(unit0, 'USD', 'EUR') ELSE unit0 END AS unit,
           CASE WHEN {_DUAL} THEN 1 ELSE 0 END AS unit_ord, 1 AS mult FROM priced
    UNION ALL SELECT *, 'EUR', 0, 2 FROM priced WHERE {_DUAL}) x""")
step("facts", f"""
  SELECT cik, CASE WHEN ns = 'dei' THEN 'dei:' || tag ELSE tag END AS tag, unit, unit_ord, start, "end", val, form, filed, pos, accn,
         date_diff('day', start, "end") AS days, start IS NOT NULL AS dur,
         regexp_matches(form, '^(10-K|10-Q|20-F|40-F)T?(/A)?$') AS per,
         CASE form WHEN '10-K' THEN 3 WHEN '10-Q' THEN 2 ELSE 1 END AS rk,
         CASE WHEN regexp_matches(unit, '^[A-Z]{{3}}(/shares)?$') THEN left(unit, 3) END AS uccy
  FROM raw WHERE (ns = 'us-gaap' AND tag IN ({names(T.keep_list())})) OR (ns = 'dei' AND tag = 'EntityCommonStockSharesOutstanding')""")
step("anchors", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(i)}, {q(t)}, {o}, {n})" for i in T.INDUSTRIES for t, o, n in T.anchors_for(i)) + ") v(industry, tag, ord, times)")
step("anchor_facts", """
  SELECT f.*, i.industry, a.ord, a.times FROM facts f JOIN filers i USING (cik) JOIN anchors a ON a.industry = i.industry AND a.tag = f.tag""")
step("annual_anchor", "SELECT * FROM anchor_facts WHERE dur AND per AND days BETWEEN 358 AND 400")
step("ccys", """
  SELECT cik, uccy AS ccy FROM (
    SELECT cik, uccy, row_number() OVER (PARTITION BY cik ORDER BY "end" DESC, n DESC, (uccy = 'USD'), uccy) AS r
    FROM (SELECT cik, "end", uccy, sum(times) AS n FROM annual_anchor WHERE uccy IS NOT NULL GROUP BY ALL)) WHERE r = 1""")
step("cal_all", """
  SELECT cik, industry, tag, ord, start, "end" FROM (
    SELECT *, row_number() OVER (PARTITION BY cik, tag, "end" ORDER BY unit_ord, pos) AS r FROM annual_anchor) WHERE r = 1""")
step("cal_rank", """
  SELECT cik, tag, min(ord) AS ord, max("end") AS newest, count(*) FILTER (WHERE brk = 0) AS contiguous, count(*) AS years FROM (
    SELECT *, sum(CASE WHEN date_diff('day', "end", newer) > 1 THEN 1 ELSE 0 END)
                OVER (PARTITION BY cik, tag ORDER BY "end" DESC ROWS UNBOUNDED PRECEDING) AS brk
    FROM (SELECT *, lag(start) OVER (PARTITION BY cik, tag ORDER BY "end" DESC) AS newer FROM cal_all)) GROUP BY cik, tag""")
step("cal_pick", """
  SELECT cik, tag, contiguous, years FROM (
    SELECT *, row_number() OVER (PARTITION BY cik ORDER BY contiguous DESC, years DESC, ord) AS r
    FROM (SELECT *, max(newest) OVER (PARTITION BY cik) AS overall FROM cal_rank) WHERE date_diff('day', newest, overall) <= 400) WHERE r = 1""")
step("cal", "SELECT c.* FROM cal_all c JOIN cal_pick p USING (cik, tag)")
step("cal_next", """
  SELECT a.cik, a."end", max(b."end") AS nxt FROM cal a JOIN cal b ON a.cik = b.cik AND b."end" <= a.start GROUP BY a.cik, a."end" """)
step("walk", """
  SELECT c.cik, c."end", c.start, year(c."end") AS fy, 0 AS idx FROM cal c
  WHERE c."end" = (SELECT max("end") FROM cal d WHERE d.cik = c.cik)
  UNION ALL
  SELECT c.cik, c."end", c.start, CASE WHEN year(c."end") = w.fy THEN w.fy - 1 ELSE year(c."end") END, w.idx + 1
  FROM walk w JOIN cal_next n ON n.cik = w.cik AND n."end" = w."end" JOIN cal c ON c.cik = n.cik AND c."end" = n.nxt
  WHERE w.idx < 7""")
step("periods", """
  SELECT w.cik, f.industry, w.idx, w."end", w.start, w.fy, y.ccy,
         CASE WHEN date_diff('day', o."end", w.start) > 1 THEN date_diff('day', o."end", w.start) ELSE 0 END AS gap
  FROM walk w JOIN filers f USING (cik) LEFT JOIN ccys y USING (cik) LEFT JOIN walk o ON o.cik = w.cik AND o.idx = w.idx + 1""")
# interim spans and windows
step("ytd", """
  SELECT p.cik, p.idx AS k, p."end" AS fy_end, a.start, a."end", a.days, a.form, a.ord, a.unit_ord, a.pos
  FROM periods p JOIN anchor_facts a ON a.cik = p.cik
  WHERE p.idx <= 4 AND a.dur AND a.days BETWEEN 60 AND 320 AND a."end" > p."end"
    AND abs(date_diff('day', p."end" + 1, a.start)) <= 10""")
step("rung0", """
  SELECT cik, start, "end", days FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY "end" DESC, days DESC) AS r
    FROM ytd WHERE k = 0 AND form = '10-Q') WHERE r = 1""")
step("rung_k", """
  SELECT cik, k, start, "end", days FROM (
    SELECT y.cik, y.k, y.start, y."end", y.days,
           row_number() OVER (PARTITION BY y.cik, y.k ORDER BY abs(date_diff('day', y."end", z."end" - CAST(y.k * 365 AS INTEGER))), y.ord, y.unit_ord, y.pos) AS r
    FROM ytd y JOIN rung0 z USING (cik)
    WHERE y.k > 0 AND abs(y.days - z.days) <= 8 AND abs(date_diff('day', y."end", z."end" - CAST(y.k * 365 AS INTEGER))) <= 35) WHERE r = 1""")
step("rungs", """
  SELECT cik, k, start, "end", days FROM (
    SELECT *, row_number() OVER (PARTITION BY cik ORDER BY k) - 1 AS n
    FROM (SELECT cik, 0 AS k, start, "end", days FROM rung0 UNION ALL SELECT * FROM rung_k)) WHERE n = k""")
step("windows", """
  SELECT c.cik, c.k, p.industry, p.ccy, c.start AS cur_start, c."end" AS cur_end, c.days AS cur_days, o.start AS prior_start,
         o."end" AS prior_end, o.days AS prior_days, p."end" AS fy_end, v."end" AS prev_fy_end
  FROM rungs c JOIN rungs o ON o.cik = c.cik AND o.k = c.k + 1 JOIN periods p ON p.cik = c.cik AND p.idx = c.k
       JOIN periods v ON v.cik = c.cik AND v.idx = c.k + 1 WHERE c.k < 4""")
step("cols", """
  SELECT cik, industry, 'FY' AS basis, "end", fy, gap, ccy FROM periods
  UNION ALL SELECT cik, industry, 'LTM', cur_end, year(cur_end), 0, ccy FROM windows""")
step("requests", """
  SELECT cik, "end", ccy, 'D' AS shape, 358 AS dmin, 400 AS dmax FROM periods
  UNION SELECT cik, "end", ccy, 'I', 0, 0 FROM periods
  UNION SELECT cik, cur_end, ccy, 'I', 0, 0 FROM windows
  UNION SELECT cik, cur_end, ccy, 'D', cur_days - 8, cur_days + 8 FROM windows
  UNION SELECT cik, prior_end, ccy, 'D', prior_days - 8, prior_days + 8 FROM windows""")
def _picking(x, requests, source, ccy):
    """Newest filed value per request and tag with scale slips put right; ``x`` names the variant."""
    key = f'r.cik, r."end", r.shape, r.dmin, f.tag'
    same = lambda a, b: " AND ".join(f'{a}.{c} = {b}.{c}' for c in ('cik', '"end"', "shape", "dmin", "tag"))
    step(f"matches{x}", f"""
      SELECT r.cik, r."end", r.shape, r.dmin, r.dmax, f.tag, f.val, f.unit, f.accn, f.form, f.filed, f.start, f.unit_ord, f.pos, f.rk,
             row_number() OVER (PARTITION BY {key} ORDER BY f.filed DESC, f.rk DESC, f.unit_ord, f.pos) AS r
      FROM {requests} r JOIN facts f ON f.cik = r.cik AND f."end" = r."end" AND f.per AND f.dur = (r.shape = 'D') AND {source}
           AND (r.shape = 'I' OR f.days BETWEEN r.dmin AND r.dmax) AND {ccy}""")
    step(f"witnesses{x}", f"""
      SELECT cik, "end", shape, dmin, tag, val, count(DISTINCT accn) AS n, min(r) AS first_r FROM matches{x} WHERE form NOT LIKE '%/A' GROUP BY ALL""")
    step(f"amended{x}", f"SELECT * FROM matches{x} WHERE r = 1 AND form LIKE '%/A'")
    e = "log10(abs(a.val) / abs(w.val))"
    step(f"slips{x}", f"""
      SELECT a.cik, a."end", a.shape, a.dmin, a.tag, bool_or(w.val = a.val) AS agreed,
             min(w.first_r) FILTER (WHERE w.n >= 2 AND a.val <> 0 AND w.val <> 0 AND abs({e} - round({e})) < 1e-9 AND round({e}) <> 0) AS rival_r
      FROM amended{x} a JOIN witnesses{x} w ON {same('a', 'w')} GROUP BY ALL""")
    step(f"picks{x}", f"""
      SELECT m.* EXCLUDE (r) FROM matches{x} m LEFT JOIN slips{x} s ON {same('s', 'm')}
      WHERE m.r = CASE WHEN s.rival_r IS NOT NULL AND NOT s.agreed THEN s.rival_r ELSE 1 END""")
    step(f"offers{x}", f"""
      SELECT c.cik, c.basis, c."end", l.k, l.inst, p.tag, p.val, p.unit, p.accn, p.form, p.filed, p.start,
             row_number() OVER (PARTITION BY c.cik, c.basis, c."end", l.k ORDER BY CASE WHEN l.nz AND p.val = 0 THEN 1 ELSE 0 END, l.ord) AS r_nz,
             row_number() OVER (PARTITION BY c.cik, c.basis, c."end", l.k ORDER BY l.ord) AS r_first
      FROM cols c JOIN picks{x} p ON p.cik = c.cik AND p."end" = c."end" AND (p.shape = 'I' OR (c.basis = 'FY' AND p.dmin = 358))
           JOIN line_ord l ON l.cik = c.cik AND l.tag = p.tag AND l.inst = (p.shape = 'I')""")


_GATE = "(f.uccy IS NULL OR r.ccy IS NULL OR f.uccy = r.ccy)"
step("fy_requests", "SELECT * FROM requests WHERE (shape = 'I' OR dmin = 358) AND \"end\" IN (SELECT p.\"end\" FROM periods p WHERE p.cik = requests.cik)")
_picking("", "requests", "TRUE", _GATE)
_picking("_free", "fy_requests", "TRUE", "TRUE")
# the pinned cost line
PIN = ("CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfServices")
step("free_all", f"""
  SELECT p.cik, p."end", f.tag, f.val, f.form, f.accn,
         row_number() OVER (PARTITION BY p.cik, p."end", f.tag ORDER BY f.filed DESC, f.rk DESC, f.unit_ord, f.pos) AS r
  FROM periods p JOIN facts f ON f.cik = p.cik AND f."end" = p."end" AND f.per AND f.dur AND f.days BETWEEN 358 AND 400
  WHERE f.tag IN ({names([*PIN, *T.REVENUE_TAGS, 'GrossProfit'])})""")
step("free_slips", """
  SELECT a.cik, a."end", a.tag, bool_or(b.val = a.val) AS agreed,
         min(b.r) FILTER (WHERE b.val <> 0 AND a.val <> 0 AND b.votes >= 2 AND round(log10(abs(a.val) / abs(b.val))) <> 0
           AND abs(log10(abs(a.val) / abs(b.val)) - round(log10(abs(a.val) / abs(b.val)))) < 1e-9) AS rival_r
  FROM free_all a JOIN (SELECT cik, "end", tag, val, min(r) AS r, count(DISTINCT accn) AS votes FROM free_all
                        WHERE form NOT LIKE '%/A' GROUP BY ALL) b USING (cik, "end", tag)
  WHERE a.r = 1 AND a.form LIKE '%/A' GROUP BY ALL""")
step("free_picks", """
  SELECT m.cik, m."end", m.tag, m.val FROM free_all m LEFT JOIN free_slips s USING (cik, "end", tag)
  WHERE m.r = CASE WHEN s.rival_r IS NOT NULL AND NOT s.agreed THEN s.rival_r ELSE 1 END""")
step("whole_part", f"""
  SELECT w.cik, w."end", w.val AS whole, g.val AS part FROM (
    SELECT *, row_number() OVER (PARTITION BY cik, "end" ORDER BY list_position([{names(T.REVENUE_TAGS)}], tag)) AS r
    FROM free_picks WHERE tag IN ({names(T.REVENUE_TAGS)})) w
  JOIN free_picks g ON g.cik = w.cik AND g."end" = w."end" AND g.tag = 'GrossProfit' WHERE w.r = 1""")
step("scores", f"""
  SELECT c.cik, c.tag, count(*) FILTER (WHERE abs(c.val - (b.whole - b.part)) <= greatest(abs(b.whole) * 1e-4, 1000)) AS score
  FROM free_picks c JOIN whole_part b USING (cik, "end") WHERE c.tag IN ({names(PIN)}) GROUP BY c.cik, c.tag""")
step("run_hits", f"""
  SELECT DISTINCT f.cik, f.tag, p.idx FROM facts f JOIN periods p ON p.cik = f.cik AND p."end" = f."end"
  WHERE f.dur AND f.per AND f.days BETWEEN 358 AND 400 AND f.tag IN ({names(PIN)})""")
step("runs", """
  SELECT cik, tag, max(n) AS run FROM (SELECT cik, tag, grp, count(*) AS n FROM (
    SELECT *, idx - row_number() OVER (PARTITION BY cik, tag ORDER BY idx) AS grp FROM run_hits) GROUP BY ALL) GROUP BY cik, tag""")
step("pins", f"""
  SELECT cik, tag, ident, row_number() OVER (PARTITION BY cik ORDER BY CASE WHEN ident THEN score ELSE run END DESC, declared) - 1 AS ord FROM (
    SELECT x.cik, t.tag, t.declared, coalesce(r.run, 0) AS run, coalesce(s.score, 0) AS score,
           max(coalesce(s.score, 0)) OVER (PARTITION BY x.cik) > 0 AS ident
    FROM (SELECT DISTINCT cik FROM periods) x CROSS JOIN (VALUES {', '.join(f'({q(t)}, {i})' for i, t in enumerate(PIN))}) t(tag, declared)
    LEFT JOIN runs r ON r.cik = x.cik AND r.tag = t.tag LEFT JOIN scores s ON s.cik = x.cik AND s.tag = t.tag)""")
_FETCHED = [r for r in T.template_rows() if r[9] == "fetched" and r[14]]
step("line_tags", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(r[0])}, {q(r[7])}, {q(t)}, {i}, {str(bool(r[10])).upper()}, {str(bool(r[11])).upper()}, {str(bool(r[12])).upper()})"
    for r in _FETCHED for i, t in enumerate(r[14])) + ") v(industry, k, tag, ord, inst, latest, nz)")
step("lines", "SELECT DISTINCT industry, k, inst, latest, nz FROM line_tags")
step("line_ord", """
  SELECT c.cik, l.k, l.tag, CASE WHEN l.k = 'cogs' THEN p.ord ELSE l.ord END AS ord, l.inst, l.nz
  FROM filers c JOIN line_tags l ON l.industry = c.industry LEFT JOIN pins p ON p.cik = c.cik AND p.tag = l.tag WHERE NOT l.latest""")
step("foreign_seen", """
  SELECT c.cik, c.basis, c."end", l.k, arg_max(f.uccy, l.ord * 1000 + f.unit_ord) AS ccy
  FROM cols c JOIN facts f ON f.cik = c.cik AND f."end" = c."end" AND f.per AND f.uccy <> c.ccy
       AND (NOT f.dur OR (c.basis = 'FY' AND f.days BETWEEN 358 AND 400))
       JOIN line_ord l ON l.cik = c.cik AND l.tag = f.tag AND l.inst = (NOT f.dur) GROUP BY ALL""")
step("tag_used", """
  SELECT DISTINCT i.cik, l.k FROM filers i JOIN line_tags l USING (industry) JOIN (SELECT DISTINCT cik, tag FROM facts) f ON f.cik = i.cik AND f.tag = l.tag""")
step("read_cells", """
  SELECT c.cik, c.industry, c.basis, c."end", l.k, l.inst, o.val AS value, o.unit, o.tag, o.accn, o.form, o.filed,
         CASE WHEN o.tag IS NOT NULL THEN 'reported' WHEN x.ccy IS NOT NULL THEN 'other-currency'
              WHEN u.k IS NOT NULL THEN 'untagged-this-period' ELSE 'never-tagged' END AS status,
         CASE WHEN o.tag IS NULL THEN x.ccy END AS other
  FROM cols c JOIN lines l ON l.industry = c.industry AND NOT l.latest AND (l.inst OR c.basis = 'FY')
  LEFT JOIN offers o ON o.cik = c.cik AND o.basis = c.basis AND o."end" = c."end" AND o.k = l.k AND o.r_nz = 1
  LEFT JOIN foreign_seen x ON x.cik = c.cik AND x.basis = c.basis AND x."end" = c."end" AND x.k = l.k
  LEFT JOIN tag_used u ON u.cik = c.cik AND u.k = l.k""")
step("newest_fact", """
  SELECT cik, k, value, unit, tag, accn, form, filed, fact_end FROM (
    SELECT i.cik, l.k, f.val AS value, f.unit, f.tag, f.accn, f.form, f.filed, f."end" AS fact_end,
           row_number() OVER (PARTITION BY i.cik, l.k ORDER BY f."end" DESC, l.ord, f.unit_ord, f.pos) AS r
    FROM filers i JOIN line_tags l ON l.industry = i.industry AND l.latest JOIN facts f ON f.cik = i.cik AND f.tag = l.tag) WHERE r = 1""")
# LTM legs
step("legs", """
  SELECT w.*, c.k AS line, c.status, o.tag, o.val AS fy_val, o.unit, o.accn, o.form, o.filed, u.val AS cur_val, u.unit AS cur_unit,
         p.val AS prior_val, p.unit AS prior_unit, c.other
  FROM windows w JOIN read_cells c ON c.cik = w.cik AND c.basis = 'FY' AND c."end" = w.fy_end AND NOT c.inst
  LEFT JOIN offers o ON o.cik = c.cik AND o.basis = 'FY' AND o."end" = c."end" AND o.k = c.k AND o.r_first = 1
  LEFT JOIN picks u ON u.cik = w.cik AND u."end" = w.cur_end AND u.shape = 'D' AND u.dmin = w.cur_days - 8 AND u.tag = o.tag
  LEFT JOIN picks p ON p.cik = w.cik AND p."end" = w.prior_end AND p.shape = 'D' AND p.dmin = w.prior_days - 8 AND p.tag = o.tag""")
step("prior_history", """
  SELECT w.cik, w.k, f.tag, count(*) AS n, arg_min(f.val, (f.filed, f.unit_ord, f.pos)) AS v0, arg_max(f.val, (f.filed, f.unit_ord, f.pos)) AS v1
  FROM windows w JOIN facts f ON f.cik = w.cik AND f.dur AND f."end" = w.prior_end AND f.days BETWEEN w.cur_days - 8 AND w.cur_days + 8 GROUP BY ALL""")
step("year_history", """
  SELECT g.cik, g.k, g.tag, g.accn, count(*) AS n, arg_min(f.val, (f.filed, f.unit_ord, f.pos)) AS v0,
         arg_max(f.val, (f.filed, f.unit_ord, f.pos)) FILTER (WHERE f.accn = g.accn) AS vin
  FROM (SELECT DISTINCT cik, k, tag, accn, prev_fy_end FROM legs WHERE tag IS NOT NULL) g
  JOIN facts f ON f.cik = g.cik AND f.tag = g.tag AND f.dur AND f."end" = g.prev_fy_end AND f.days BETWEEN 358 AND 400 GROUP BY ALL""")
_MOVED = "coalesce(abs({a} - {b}) / greatest(abs({a}), abs({b}), 1) > 0.005, FALSE)"
step("stitched", f"""
  SELECT l.*, CASE WHEN fy_val IS NULL THEN status
              WHEN cur_val IS NULL OR prior_val IS NULL OR cur_unit <> unit OR prior_unit <> unit THEN 'no-interim'
              WHEN h.n >= 2 AND {_MOVED.format(a='h.v0', b='h.v1')} AND NOT coalesce(y.n > 1 AND y.vin IS NOT NULL AND {_MOVED.format(a='y.v0', b='y.vin')}, FALSE)
              THEN 'restated-basis' ELSE 'ltm' END AS st
  FROM legs l LEFT JOIN prior_history h ON h.cik = l.cik AND h.k = l.k AND h.tag = l.tag
  LEFT JOIN year_history y ON y.cik = l.cik AND y.k = l.k AND y.tag = l.tag AND y.accn = l.accn""")
step("cells", """
  SELECT cik, industry, basis, "end", k, inst, value, unit, tag, accn, form, filed, status, other FROM read_cells
  UNION ALL
  SELECT cik, industry, 'LTM', cur_end, line, FALSE, CASE WHEN st = 'ltm' THEN fy_val + cur_val - prior_val END,
         CASE WHEN st = 'ltm' THEN unit END, tag, CASE WHEN st = 'ltm' THEN accn END, CASE WHEN st = 'ltm' THEN form END,
         CASE WHEN st = 'ltm' THEN filed END, st, CASE WHEN fy_val IS NULL THEN other END FROM stitched
  UNION ALL
  SELECT c.cik, c.industry, c.basis, c."end", l.k, l.inst, n.value, n.unit, n.tag, n.accn, n.form, n.filed,
         CASE WHEN n.tag IS NOT NULL THEN 'reported' ELSE 'never-tagged' END, NULL
  FROM cols c JOIN lines l ON l.industry = c.industry AND l.latest LEFT JOIN newest_fact n ON n.cik = c.cik AND n.k = l.k""")
_KEYS = T.fetched_keys()
step("wide", "SELECT cik, industry, basis, \"end\", " + ", ".join(
    f"max(value) FILTER (WHERE k = {q(k)}) AS \"{k}\"" for k in _KEYS) + """,
    max(tag) FILTER (WHERE k = 'equity') AS equity_tag, max(tag) FILTER (WHERE k = 'ltDebt') AS debt_tag
  FROM cells GROUP BY cik, industry, basis, "end" """)
_LT = [t for r in T.template_rows() if r[0] == "corporate" and r[7] == "ltDebt" for t in r[14]]
step("at_date", """
  SELECT cik, tag, "end", val FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, "end" ORDER BY filed DESC, unit_ord, pos) AS r
    FROM facts WHERE NOT dur AND per) WHERE r = 1""")
step("scope", f"""
  SELECT cik, tag, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) END AS scope FROM (
    SELECT t.cik, t.tag, CASE WHEN abs(t.val - n.val) <= greatest(abs(n.val), 1) * 0.005 THEN 'excludes'
           WHEN abs(t.val - (n.val + c.val)) <= greatest(abs(n.val + c.val), 1) * 0.005 THEN 'includes' END AS verdict
    FROM at_date t JOIN at_date n ON n.cik = t.cik AND n."end" = t."end" AND n.tag = 'LongTermDebtNoncurrent'
    LEFT JOIN at_date c ON c.cik = t.cik AND c."end" = t."end" AND c.tag = 'LongTermDebtCurrent'
    WHERE t.tag IN ({names([t for t in _LT if t not in ('LongTermDebtNoncurrent', 'ConvertibleDebtNoncurrent')])}))
  WHERE verdict IS NOT NULL GROUP BY cik, tag""")
# the sheet as it stood at the start of the last year: the same steps over the facts filed until then
_AS_OF = ("anchor_facts annual_anchor ccys cal_all cal_rank cal_pick cal cal_next walk periods matches witnesses amended slips picks offers "
          "free_all free_slips free_picks whole_part scores run_hits runs pins line_ord").split()
step("facts_then", "SELECT * FROM facts WHERE filed < make_date((SELECT y1 FROM yrs), 1, 1)")
step("cols_then", "SELECT cik, industry, 'FY' AS basis, \"end\", fy, gap, ccy FROM periods_then")
step("requests_then", """
  SELECT cik, "end", ccy, 'D' AS shape, 358 AS dmin, 400 AS dmax FROM periods_then UNION SELECT cik, "end", ccy, 'I', 0, 0 FROM periods_then""")
_THEN = re.compile(r"\b(" + "|".join([*_AS_OF, "facts", "cols", "requests"]) + r")\b(?!\()")
for _n in _AS_OF:
    step(f"{_n}_then", _THEN.sub(r"\1_then", STEPS[_n]))
RECURSIVE = {"walk", "walk_then"}


_NAMED = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)|,\s*(\w+)(?=\s+\w+\s+WHERE)")
_NEEDS: dict = {}


def _needs(text: str) -> list:
    return [n for n in dict.fromkeys(a or b for a, b in _NAMED.findall(text)) if n in STEPS]


def with_steps(final: str) -> str:
    """``final`` preceded by every step it names, directly or through other steps."""
    seen, order = set(), []

    def visit(names_):
        for n in names_:
            if n in seen:
                continue
            seen.add(n)
            if n not in _NEEDS:
                _NEEDS[n] = [m for m in _needs(STEPS[n]) if m != n]
            visit(_NEEDS[n])
            order.append(n)

    visit(_needs(final))
    if not order:
        return final.strip()
    ctes = []
    for n in order:
        kind = "" if n in RECURSIVE else "MATERIALIZED "
        cols = '(cik, "end", start, fy, idx)' if n in RECURSIVE else ""
        ctes.append(f"{n}{cols} AS {kind}({STEPS[n].strip()})")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final.strip()
