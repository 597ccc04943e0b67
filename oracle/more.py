"""Checking SQL of sources, segments and population checks."""

from ledgerline.dims import template as T
from ledgerline.operators.quality import CHAPTER_11
from ledgerline.sources.star_schema import _LABELS, REPORT_NAMES, _role_rows
from oracle.base import names, q, step

step("filing_list", """
  SELECT cik, filing_ord, form, filed, lpad(CAST(cik AS VARCHAR), 10, '0') || '-' || lpad(CAST(year(filed) % 100 AS VARCHAR), 2, '0') || '-'
           || lpad(CASE kind WHEN '10-K' THEN '1' WHEN '10-Q' THEN '112' WHEN '8-K' THEN '7' ELSE '5' END, 6, '0') AS accn,
         lower(replace(form, '/', '')) || '.htm' AS doc, period
  FROM (
    SELECT *, period + 46 AS filed FROM (
      SELECT s_suppkey AS cik, y, kind, (y1 - y) * 4 + kind_ord AS filing_ord,
             CASE WHEN kind = '10-K' AND y = y1 AND s_suppkey % 20 <> 5 THEN '10-KT/A' WHEN kind = '10-K' AND s_suppkey % 20 = 5 THEN '20-F' ELSE kind END AS form,
             last_day(make_date(y, CASE WHEN kind = '10-K' AND y = y1 AND s_suppkey % 20 <> 5 THEN 5 WHEN kind = '10-K' THEN 12 WHEN kind = '10-Q' THEN 9 ELSE 6 END, 1)) AS period
      FROM supplier JOIN each_year ON TRUE, (VALUES ('10-K', 0), ('10-Q', 1), ('8-K', 2), ('S-1', 3)) k(kind, kind_ord)
      WHERE kind <> '10-K' OR y < y1 OR s_suppkey % 14 = 9 OR s_suppkey % 20 = 5))""")
step("listed", """
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_ord) AS r FROM filing_list
    WHERE regexp_matches(form, '^(10-K|10-Q|20-F|40-F)T?(/A)?$|^8-K$')) WHERE r <= 120""")
step("ticker_list", """
  SELECT CASE WHEN cik % 25 = 6 THEN cik + 1000000 ELSE cik END AS cik, ticker, name AS title FROM filers""")
step("quote_rows", """
  SELECT ticker AS symbol, CASE WHEN cik % 23 = 4 THEN 0 ELSE cik % 97 + 1 END AS price, make_date((SELECT y1 FROM yrs), 11, 5)::TIMESTAMP AS "at" FROM filers
  UNION ALL SELECT ticker, 9999, make_date((SELECT y1 FROM yrs), 11, 4)::TIMESTAMP FROM filers WHERE cik % 2 = 0""")
step("last_quote", """
  SELECT symbol, CAST(price AS DOUBLE) AS price, "at" FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "at" DESC, price DESC) AS r FROM quote_rows WHERE price <> 0) WHERE r = 1""")
# interim periods of the newest window's two years, by the order of the filer's own year-to-date spans
step("q_side", """
  SELECT cik, 'cur' AS side, fy_end AS base, cur_end AS own, cur_end AS last FROM windows WHERE k = 0
  UNION ALL SELECT cik, 'prior', prev_fy_end, prior_end, fy_end - 30 FROM windows WHERE k = 0""")
step("q_slot", """
  SELECT *, row_number() OVER (PARTITION BY cik, side ORDER BY "end") AS slot,
         coalesce(date_diff('day', lag("end") OVER (PARTITION BY cik, side ORDER BY "end"), "end") - 1, days) AS qdays FROM (
    SELECT s.cik, s.side, s.own, f."end", max(f.days) AS days FROM q_side s JOIN facts f ON f.cik = s.cik AND f.dur AND f.per AND f.form = '10-Q' AND f.days BETWEEN 60 AND 320
      AND abs(date_diff('day', s.base + 1, f.start)) <= 10 AND f."end" > s.base AND f."end" <= s.last GROUP BY ALL)""")
_NEWEST = """SELECT {key}, f.tag, f.val, row_number() OVER (PARTITION BY {key}, f.tag ORDER BY f.filed DESC, f.rk DESC, f.unit_ord, f.pos) AS r
    FROM {src} JOIN facts f ON f.cik = s.cik AND f."end" = s.{end} AND f.dur AND f.per AND f.days BETWEEN {lo} AND {hi}
    LEFT JOIN ccys c ON c.cik = f.cik WHERE (f.uccy IS NULL OR c.ccy IS NULL OR f.uccy = c.ccy)"""
step("q_to_date", f"SELECT * FROM ({_NEWEST.format(key='s.cik, s.side, s.slot', src='q_slot s', end='end', lo='s.days - 8', hi='s.days + 8')}) WHERE r = 1".replace("s.end", 's."end"'))
step("q_alone", f"SELECT * FROM ({_NEWEST.format(key='s.cik, s.side, s.slot', src='q_slot s', end='end', lo='s.qdays - 8', hi='s.qdays + 8')}) WHERE r = 1".replace("s.end", 's."end"'))
step("q_year", f"SELECT * FROM ({_NEWEST.format(key='s.cik', src='(SELECT * FROM windows WHERE k = 0) s', end='fy_end', lo='358', hi='400')}) WHERE r = 1")
step("q_sides", """SELECT cik, side, max(slot) AS n, max(slot) FILTER (WHERE "end" = own) AS at FROM q_slot GROUP BY ALL""")
step("q_parts", """
  SELECT *, coalesce(q1, t1) AS p1, coalesce(q2, t2 - t1) AS p2, coalesce(q3, t3 - t2) AS p3 FROM (
    SELECT *, coalesce(y3, t2 + q3) AS t3 FROM (
      SELECT *, coalesce(y2, t1 + q2, y3 - q3) AS t2 FROM (
        SELECT *, coalesce(y1, q1, y2 - q2) AS t1 FROM (
          SELECT v.cik, v.side, v.tag, m.n, m.at, max(val) FILTER (WHERE kind = 'y' AND slot = 1) AS y1, max(val) FILTER (WHERE kind = 'y' AND slot = 2) AS y2,
                 max(val) FILTER (WHERE kind = 'y' AND slot = 3) AS y3, max(val) FILTER (WHERE kind = 'q' AND slot = 1) AS q1,
                 max(val) FILTER (WHERE kind = 'q' AND slot = 2) AS q2, max(val) FILTER (WHERE kind = 'q' AND slot = 3) AS q3
          FROM (SELECT *, 'y' AS kind FROM q_to_date UNION ALL SELECT *, 'q' FROM q_alone) v JOIN q_sides m ON m.cik = v.cik AND m.side = v.side GROUP BY ALL))))""")


_SEG, _PRO, _GEO = "us-gaap:StatementBusinessSegmentsAxis", "srt:ProductOrServiceAxis", "srt:StatementGeographicalAxis"
_QUAL, _OPS = "srt:ConsolidationItemsAxis", "us-gaap:OperatingSegmentsMember"
_CORP, _ELIM, _BOTH = "us-gaap:CorporateNonSegmentMember", "us-gaap:IntersegmentEliminationMember", "x:EliminationsAndReconcilingMember"
step("g_base", """
  SELECT l_suppkey AS cik, year(l_shipdate) AS yr, p_type AS ptype, r_name AS region, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
_TYPE = "'x:' || upper(left(ptype, 1)) || lower(substr(ptype, 2)) || 'Member'"
_REGION = "CASE region WHEN 'MIDDLE EAST' THEN 'x:Middle EastMember' ELSE 'x:' || upper(left(region, 1)) || lower(substr(region, 2)) || 'Member' END"
step("g_total", "SELECT cik, yr, CAST(sum(cents) AS BIGINT) AS v FROM g_base GROUP BY ALL")
step("g_type", f"SELECT cik, yr, ptype, {_TYPE} AS m, CAST(sum(cents) AS BIGINT) AS v FROM g_base GROUP BY ALL")
step("g_region", f"SELECT cik, yr, region, {_REGION} AS m, CAST(sum(cents) AS BIGINT) AS v FROM g_base GROUP BY ALL")
step("g_cell", f"SELECT cik, yr, ptype, region, {_TYPE} AS m, {_REGION} AS m2, cents AS v FROM g_base")
step("g_seg", """
  SELECT cik, yr, CASE WHEN ptype IN ('SMALL', 'MEDIUM') THEN 'x:RetailMember' WHEN ptype IN ('LARGE', 'STANDARD') THEN 'x:IndustrialMember' ELSE 'x:SpecialMember' END AS m,
         CAST(sum(cents) AS BIGINT) AS v FROM g_base GROUP BY ALL""")
step("g_extra", "SELECT cik, yr, CAST(sum(v) AS BIGINT) AS v, CAST(sum(v // 10) AS BIGINT) AS x FROM g_seg WHERE cik % 5 IN (0, 2) GROUP BY ALL")
_P = f"'{_PRO}', m, NULL, NULL"
_S = f"'{_SEG}', m, NULL, NULL"
_SQ = f"'{_SEG}', m, '{_QUAL}', '{_OPS}'"
# what a report says of a year; income is told as the sales that it is a part of
step("g_told", f"""
  SELECT cik, yr, 'Revenues' AS tag, 'C' AS ctx, CAST(NULL AS VARCHAR) AS a1, CAST(NULL AS VARCHAR) AS m1, CAST(NULL AS VARCHAR) AS a2, CAST(NULL AS VARCHAR) AS m2, v AS val FROM g_total
  UNION ALL SELECT cik, yr, 'OperatingIncomeLoss', 'C', NULL, NULL, NULL, NULL, v FROM g_total
  UNION ALL SELECT cik, yr, 'Revenues', 'P-' || ptype, {_P}, v FROM g_type WHERE cik % 3 <> 2
  UNION ALL SELECT cik, yr, 'Revenues', 'P-' || ptype, {_P}, v FROM g_type WHERE cik % 3 <> 2 AND cik % 2 = 0
  UNION ALL SELECT cik, yr, 'OperatingIncomeLoss', 'P-' || ptype, {_P}, v FROM g_type WHERE cik % 3 <> 2
  UNION ALL SELECT cik, yr, 'Revenues', 'F-' || mm, '{_PRO}', mm, NULL, NULL, CAST(sum(v) AS BIGINT) FROM (
    SELECT *, CASE WHEN m IN ('x:EconomyMember', 'x:StandardMember', 'x:MediumMember') THEN 'us-gaap:ProductMember' ELSE 'us-gaap:ServiceMember' END AS mm FROM g_type)
    WHERE cik % 3 = 0 GROUP BY cik, yr, mm
  UNION ALL SELECT cik, yr, 'Revenues', 'T', '{_PRO}', 'x:TotalSmallLargeMember', NULL, NULL, CAST(sum(v) AS BIGINT) FROM g_type
    WHERE cik % 3 <> 2 AND cik % 4 = 1 AND m IN ('x:SmallMember', 'x:LargeMember') GROUP BY cik, yr
  UNION ALL SELECT cik, yr, 'Revenues', 'G-' || region, '{_GEO}', m, NULL, NULL, v FROM g_region WHERE cik % 3 = 0 AND NOT (cik % 7 = 3 AND m = 'x:AmericaMember')
  UNION ALL SELECT cik, yr, 'Revenues', 'SO-' || m, {_SQ}, v + v // 10 FROM g_seg WHERE cik % 5 IN (0, 2)
  UNION ALL SELECT cik, yr, 'Revenues', 'S-' || m, {_S}, v FROM g_seg WHERE cik % 5 IN (1, 3) OR (cik % 5 = 2 AND m = 'x:RetailMember')
  UNION ALL SELECT cik, yr, 'Revenues', 'SO-' || m, {_SQ}, v * 9 // 10 FROM g_seg WHERE cik % 5 = 1
  UNION ALL SELECT cik, yr, 'Revenues', 'RC', '{_QUAL}', '{_CORP}', NULL, NULL, 45800000 FROM g_total WHERE cik % 5 = 3
  UNION ALL SELECT cik, yr, 'Revenues', 'RO', '{_QUAL}', '{_OPS}', NULL, NULL, v + x FROM g_extra
  UNION ALL SELECT cik, yr, 'Revenues', 'RE', '{_QUAL}', '{_ELIM}', NULL, NULL, CASE WHEN cik % 10 = 0 THEN 5000000 ELSE 0 END - x FROM g_extra
  UNION ALL SELECT cik, yr, 'Revenues', 'RC', '{_QUAL}', '{_CORP}', NULL, NULL, -5000000 FROM g_extra WHERE cik % 10 = 0
  UNION ALL SELECT cik, yr, 'Revenues', 'RS', '{_QUAL}', '{_BOTH}', NULL, NULL, -x FROM g_extra WHERE cik % 10 = 0
  UNION ALL SELECT cik, yr, 'Revenues', 'X-' || ptype || '-' || region, '{_PRO}', m, '{_GEO}', m2, v FROM g_cell WHERE cik % 3 = 2
  UNION ALL SELECT cik, yr, 'Revenues', 'XW-' || ptype, '{_PRO}', m, '{_GEO}', 'x:WorldMember', v FROM g_type WHERE cik % 6 = 5
  UNION ALL SELECT cik, yr, 'Revenues', 'A-' || m, '{_SEG}', m, 'us-gaap:AccidentYearAxis', 'x:PriorYearMember', v FROM g_seg WHERE cik % 2 = 1""")
# a year stands in its own report and in the next two; ``back`` counts a filer's newer reports
step("g_dim", """
  SELECT cik, yr, tag, ctx || '-' || yr AS ctx, a1, m1, a2, m2, ry, dense_rank() OVER (PARTITION BY cik ORDER BY ry DESC) - 1 AS back,
         CAST(CASE WHEN tag = 'Revenues' THEN val WHEN cik % 4 = 0 AND ry > yr THEN val // 8 ELSE val // 10 END AS DOUBLE) AS val,
         lpad(CAST(cik AS VARCHAR), 10, '0') || '-' || lpad(CAST((ry + 1) % 100 AS VARCHAR), 2, '0') || '-000001' AS accn
  FROM (SELECT t.*, unnest(range(yr, least(yr + 2, (SELECT y1 FROM yrs)) + 1)) AS ry FROM g_told t)""")
step("g_sent", """
  SELECT *, cik % 37 = 12 AND ry = min(ry) OVER (PARTITION BY cik) AS cut FROM g_dim""")
step("g_new", "SELECT DISTINCT cik, accn, yr, tag, ctx, a1, m1, a2, m2, val FROM g_sent WHERE back = 0 AND NOT cut")
_B3 = f"('{_SEG}', '{_PRO}', '{_GEO}')"
step("g_one", f"""
  SELECT cik, tag, make_date(yr, 12, 31) AS period_end, a1 AS axis, m1 AS member, coalesce(m2, '') AS qualifier, '' AS along, val
  FROM g_new WHERE a1 IN {_B3} AND (a2 IS NULL OR a2 = '{_QUAL}')""")
step("g_items", f"SELECT cik, tag, make_date(yr, 12, 31) AS period_end, m1 AS member, val FROM g_new WHERE a1 = '{_QUAL}' AND a2 IS NULL")
step("g_cons", "SELECT cik, tag, make_date(yr, 12, 31) AS period_end, val AS consolidated FROM g_new WHERE a1 IS NULL")
step("g_roles", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(r)}, {q(a)}, {q(p) if p else 'NULL'}, {q(m)})" for r, a, p, m in _role_rows()) + ") v(role, axis, parent, member)")


def _tables(p, src):
    """Steps that turn one-axis rows into tables: views, subtotals, lead, reconciling rows, gate."""
    key = "cik, axis, role, along, tag"
    step(f"{p}_view", f"SELECT s.*, r.role FROM {src} s JOIN g_roles r ON r.axis = s.axis AND r.member = s.member")
    step(f"{p}_sub", f"""
      SELECT DISTINCT v.cik, v.axis, v.role, v.along, v.tag, v.member FROM {p}_view v JOIN g_roles r ON r.role = v.role AND r.axis = v.axis AND r.parent = v.member
      JOIN {p}_view c ON c.cik = v.cik AND c.axis = v.axis AND c.role = v.role AND c.along = v.along AND c.tag = v.tag AND c.member = r.member""")
    step(f"{p}_kept", f"""
      SELECT v.*, CASE qualifier WHEN '' THEN 0 WHEN '{_OPS}' THEN 1 ELSE 2 END AS qr FROM {p}_view v
      WHERE NOT EXISTS (SELECT 1 FROM {p}_sub s WHERE s.cik = v.cik AND s.axis = v.axis AND s.role = v.role AND s.along = v.along AND s.tag = v.tag AND s.member = v.member)""")
    step(f"{p}_first", f"""
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, qr, qualifier DESC) AS r
      FROM (SELECT {key}, qualifier, qr, count(DISTINCT member) AS n FROM {p}_kept GROUP BY ALL)""")
    step(f"{p}_others", f"SELECT {key}, string_agg(qualifier, ',' ORDER BY qualifier) AS others FROM {p}_first WHERE r > 1 GROUP BY ALL")
    step(f"{p}_lead", f"""
      SELECT * FROM (SELECT k.*, f.qualifier AS lead_q, coalesce(o.others, '') AS others, row_number() OVER (
               PARTITION BY k.cik, k.axis, k.role, k.along, k.tag, k.period_end, k.member ORDER BY k.qualifier <> f.qualifier, k.qr, k.qualifier) AS rr
        FROM {p}_kept k JOIN {p}_first f ON f.cik = k.cik AND f.axis = k.axis AND f.role = k.role AND f.along = k.along AND f.tag = k.tag AND f.r = 1
        LEFT JOIN {p}_others o ON o.cik = k.cik AND o.axis = k.axis AND o.role = k.role AND o.along = k.along AND o.tag = k.tag) WHERE rr = 1""")
    step(f"{p}_sum", f"""
      SELECT s.*, c.consolidated FROM (SELECT {key}, period_end, sum(val) AS seg FROM {p}_lead GROUP BY ALL) s LEFT JOIN g_cons c USING (cik, tag, period_end)""")
    step(f"{p}_open", f"SELECT {key} FROM {p}_sum GROUP BY {key} HAVING NOT bool_and(coalesce(seg = consolidated, FALSE))")
    step(f"{p}_rec0", f"""
      SELECT i.cik, o.axis, o.role, o.along, i.tag, i.period_end, i.member, i.val FROM g_items i JOIN g_roles r ON r.axis = '{_QUAL}' AND r.member = i.member
      JOIN {p}_open o ON o.cik = i.cik AND o.role = r.role AND o.tag = i.tag
      JOIN {p}_sum s ON s.cik = i.cik AND s.axis = o.axis AND s.role = o.role AND s.along = o.along AND s.tag = i.tag AND s.period_end = i.period_end WHERE s.seg <> i.val""")
    step(f"{p}_rec", f"""
      SELECT * EXCLUDE (twin, twins) FROM (SELECT *, count(*) FILTER (WHERE twin) OVER (PARTITION BY {key}, period_end) AS twins FROM (
        SELECT *, count(*) OVER w >= 3 AND val = sum(val) OVER w - val AS twin FROM {p}_rec0 WINDOW w AS (PARTITION BY {key}, period_end)))
      WHERE NOT (twin AND twins = 1)""")
    step(f"{p}_rows", f"""
      SELECT {key}, period_end, member, val, FALSE AS recon FROM {p}_lead UNION ALL SELECT {key}, period_end, member, val, TRUE FROM {p}_rec""")
    step(f"{p}_foot", f"""
      SELECT t.*, c.consolidated, coalesce(abs(t.total - c.consolidated) <= abs(c.consolidated) * 0.001, FALSE) AS fits
      FROM (SELECT {key}, period_end, sum(val) AS total FROM {p}_rows GROUP BY ALL) t LEFT JOIN g_cons c USING (cik, tag, period_end)""")
    step(f"{p}_good", f"SELECT {key} FROM {p}_foot GROUP BY {key} HAVING bool_and(fits)")
    step(f"{p}_done", f"""
      SELECT r.*, f.total, f.consolidated FROM {p}_rows r JOIN {p}_foot f USING ({key}, period_end) JOIN {p}_good g USING ({key})""")


_tables("h", "g_one")
step("x_cells", f"""
  SELECT cik, tag, make_date(yr, 12, 31) AS period_end, a1 AS axis, m1 AS member, a2 AS along, m2 AS other, val FROM g_new WHERE a1 IN {_B3} AND a2 IN {_B3}
  UNION ALL SELECT cik, tag, make_date(yr, 12, 31), a2, m2, a1, m1, val FROM g_new WHERE a1 IN {_B3} AND a2 IN {_B3}""")
step("x_free", "SELECT * FROM x_cells x WHERE NOT EXISTS (SELECT 1 FROM h_done h WHERE h.cik = x.cik AND h.axis = x.axis)")
step("x_line", """
  SELECT *, sum(val) OVER w AS s, count(*) OVER w AS n FROM x_free WINDOW w AS (PARTITION BY cik, tag, period_end, axis, member, along)""")
step("x_bad", "SELECT DISTINCT cik, tag, axis, along FROM x_line WHERE n >= 3 AND val * 2 = s AND val <> 0")
step("x_one", """
  SELECT cik, tag, period_end, axis, member, '' AS qualifier, along, sum(val) AS val FROM x_free x
  WHERE NOT EXISTS (SELECT 1 FROM x_bad b WHERE b.cik = x.cik AND b.tag = x.tag AND b.axis = x.axis AND b.along = x.along) GROUP BY ALL""")
_tables("y", "x_one")
step("g_done", "SELECT * FROM h_done UNION ALL SELECT * FROM y_done")
step("g_labels", "SELECT * FROM (VALUES " + ", ".join(
    [f"('x:{t}Member', '{t} goods')" for t in ("Economy", "Large", "Medium", "Promo", "Small", "Standard")]
    + [f"('{_CORP}', 'Corporate')", f"('{_ELIM}', 'Optional eliminations')"]) + ") v(member, text)")
step("g_named", """
  SELECT d.*, coalesce(l.text, regexp_replace(regexp_replace(d.member, '^[a-z-]+:', ''), 'Member$', '')) AS label FROM g_done d LEFT JOIN g_labels l USING (member)""")
step("idx", """
  SELECT l.form, CASE WHEN l.cik % 4 = 1 THEN upper(f.name) || ' Corp' ELSE f.name END AS company, l.cik, l.filed FROM filing_list l JOIN filers f USING (cik)""")
step("rep_names", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(n.replace('&amp;', '&'))})" for i, n in enumerate(REPORT_NAMES)) + ") v(i, name)")
_KIND_TESTS = (
    ("is", "NOT contains(n, 'comprehensive') AND contains(n, 'statement') AND (n LIKE '%statement%operation%' OR n LIKE '%statement%income%' OR n LIKE '%statement%earnings%')"),
    ("bs", "contains(n, 'balance sheet') OR n LIKE '%statement%financial position%'"), ("cf", "n LIKE '%statement%cash flow%'"),
    ("eq", "n LIKE '%statement%equity%' OR n LIKE '%statement%stockholders%'"), ("tax", "contains(n, 'income tax')"),
    ("debt", "regexp_matches(n, '\\bdebt\\b') OR contains(n, 'borrowing')"), ("leases", "contains(n, 'lease')"),
    ("segments", "contains(n, 'segment') OR contains(n, 'geographic')"),
    ("sbc", "contains(n, 'share-based') OR contains(n, 'stock-based') OR contains(n, 'compensation')"),
    ("pension", "contains(n, 'pension') OR contains(n, 'retirement benefit')"))
step("rep_kinds", " UNION ALL ".join(
    f"SELECT i, {j} AS ko, '{k}' AS kind FROM (SELECT i, lower(name) AS n FROM rep_names) WHERE {t}" for j, (k, t) in enumerate(_KIND_TESTS)))
step("reps", """
  SELECT f.cik, lpad(CAST(f.cik AS VARCHAR), 10, '0') || '-01-000001' AS accn, n.i, n.name,
         row_number() OVER (PARTITION BY f.cik ORDER BY n.i) + CASE WHEN f.cik % 5 <> 0 THEN 0 ELSE -1 END AS ord_in
  FROM filers f, rep_names n WHERE f.cik % 9 <> 4 AND n.i > 0 AND (f.cik + n.i) % 5 <> 0""")
step("filing_path", """
  SELECT cik, industry, lpad(CAST(cik AS VARCHAR), 10, '0') || '-01-000001' AS accn,
         'https://www.sec.gov/Archives/edgar/data/' || CAST(cik AS VARCHAR) || '/' || lpad(CAST(cik AS VARCHAR), 10, '0') || '01000001' AS base FROM filers""")


step("section_kinds", "SELECT DISTINCT * FROM (VALUES " + ", ".join(sorted({
    f"({q(r[0])}, {q(r[2])}, {r[1]}, {q(r[5]) if r[5] else 'NULL'})" for r in T.template_rows()})) + ") v(industry, section, section_ord, kind)")


def more_sql() -> dict:
    out = {}
    out["src5_reports"] = """
SELECT p.cik, p.accn, p.cik % 9 <> 4 AS rendered, r.name, p.base || '/R' || CAST(r.i AS VARCHAR) || '.htm' AS url, p.base || '/' AS index_url,
       CAST(r.ord_in AS INTEGER) AS report_ord, coalesce(k.kinds, '') AS kinds
FROM filing_path p LEFT JOIN reps r USING (cik) LEFT JOIN (SELECT i, string_agg(kind, ',' ORDER BY ko) AS kinds FROM rep_kinds GROUP BY i) k ON k.i = r.i"""
    out["src6_dim_facts"] = """
SELECT cik, accn, make_date(ry + 1, 2, 15) AS filed, tag, ctx AS context_id, make_date(yr, 1, 1) AS period_start, make_date(yr, 12, 31) AS period_end,
       concat_ws(',', a1 || '=' || m1, a2 || '=' || m2) AS cell, val FROM g_sent WHERE NOT cut"""
    out["src6_rejects"] = """
SELECT cik, accn, CASE WHEN NOT cut THEN 'Goodwill' END AS tag, CASE WHEN cut THEN NULL WHEN cik % 13 = 8 THEN 'gone' ELSE min(ctx) END AS context_id,
       CASE WHEN cut THEN 'no document' WHEN cik % 13 = 8 THEN 'no such context' ELSE 'no number' END AS reason
FROM g_sent WHERE cut OR cik % 13 = 8 OR cik % 17 = 6 GROUP BY cik, accn, cut"""
    out["src6_role_members"] = "SELECT cik, accn, role, axis, parent AS parent_member, member FROM (SELECT DISTINCT cik, accn FROM g_dim WHERE back = 0) JOIN g_roles ON TRUE"
    out["src6_member_labels"] = f"""
SELECT cik, accn, member, label_role, label FROM (SELECT DISTINCT cik, accn FROM g_dim WHERE back = 0),
  (VALUES {", ".join(f"({q(m)}, {q(r)}, {q(t)})" for m, r, t in _LABELS)}) v(member, label_role, label)"""
    out["src7_form_index"] = "SELECT form, company, cik, filed FROM idx WHERE NOT (form = '8-K' AND cik % 17 IN (3, 5))"
    out["src7_rejects"] = """
SELECT cik AS filer, CASE WHEN cik % 17 = 3 THEN form END AS form, CASE WHEN cik % 17 = 3 THEN cik END AS cik,
       CASE WHEN cik % 17 = 3 THEN 'filed is no date' ELSE 'columns missing' END AS reason FROM idx WHERE form = '8-K' AND cik % 17 IN (3, 5)"""
    out["prj16_section_links"] = """
SELECT p.cik, p.accn, s.section, CAST(s.section_ord AS INTEGER) AS section_ord, s.kind, coalesce(x.url, p.base || '/') AS link
FROM filing_path p JOIN section_kinds s USING (industry)
LEFT JOIN (SELECT r.cik, k.kind, arg_min(f.base || '/R' || CAST(r.i AS VARCHAR) || '.htm', r.i) AS url FROM reps r JOIN rep_kinds k USING (i) JOIN filing_path f USING (cik) GROUP BY ALL) x
  ON x.cik = p.cik AND x.kind = s.kind"""
    out["snk3_segments"] = """
SELECT cik, axis, role, tag, period_end, label || CASE WHEN recon THEN ' (reconciling item)' ELSE '' END AS row_label, val FROM g_named
UNION ALL SELECT DISTINCT cik, axis, role, tag, period_end, 'Consolidated', consolidated FROM g_named"""
    out["seg1_3_4_breakdown"] = 'SELECT cik, tag, period_end, axis, member, qualifier, val FROM g_one'
    out["seg2_views"] = "SELECT cik, axis, role, tag, period_end, member, qualifier, val FROM h_view"
    out["seg5_subtotals"] = "SELECT cik, axis, role, tag, member FROM h_sub"
    out["seg10_lead_view"] = "SELECT cik, axis, role, tag, period_end, member, val, qualifier, lead_q AS lead, others FROM h_lead"
    out["seg6_to_9_reconciling"] = "SELECT cik, axis, role, tag, period_end, member, val FROM h_rec"
    out["seg12_crosstab"] = "SELECT cik, axis, role, along, tag, period_end, member, val, consolidated FROM y_done"
    out["seg11_13_14_tables"] = "SELECT cik, axis, role, along, tag, period_end, member, label, recon, val, total, consolidated FROM g_named"
    out["seg15_coverage"] = f"""
SELECT CASE WHEN total = consolidated THEN 'exact' WHEN abs((total - consolidated) / consolidated) <= 0.0005 THEN 'within 0.05%' ELSE 'within 0.1%' END AS band, count(*) AS n
FROM (SELECT DISTINCT cik, axis, role, along, tag, period_end, total, consolidated FROM g_done) GROUP BY ALL
UNION ALL SELECT 'filers with segments', count(DISTINCT cik) FROM g_done WHERE axis = '{_SEG}' UNION ALL SELECT 'filers', count(*) FROM filers"""
    claims = "totalLiab + coalesce(equityAll, equity + coalesce(nciBs, 0)) + coalesce(tempEquity, 0)"
    ident = [("gross profit = revenue - cogs", "grossProfit", "revenue - cogs"), ("ebitda = ebit + da", "ebitda", "ebit + coalesce(da, 0)"),
             ("assets = liabilities + equity", "totalAssets", claims), ("fcf = cfo - capex", "fcf", "cfo - coalesce(capex, 0)")]
    both = " UNION ALL ".join(f"SELECT {q(n)} AS \"check\", cik, basis, \"end\", {a} AS l, {b} AS r FROM sheet0" for n, a, b in ident)
    close = "abs(l - r) <= greatest(abs(r), 1) * 0.005"
    out["qa1_identities"] = f'SELECT "check", cik, basis, "end", l - r AS detail FROM ({both}) WHERE NOT ({close})'
    out["qa1_identity_rates"] = f'SELECT "check", count(*) AS tested, count(*) FILTER (WHERE {close}) AS held FROM ({both}) WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY ALL'
    out["qa2_impossible"] = """
SELECT 'total debt below long-term debt' AS "check", cik, basis, "end", totalDebt - ltDebt AS detail FROM sheet0 WHERE totalDebt < ltDebt
UNION ALL SELECT 'gross loans below net loans', cik, basis, "end", loansGross - loans FROM sheet0 WHERE loansGross < loans
UNION ALL SELECT 'revenue taken from a slice', c.cik, c.basis, c."end", p.val - c.value FROM cells c JOIN picks p ON p.cik = c.cik AND p."end" = c."end" AND p.tag = 'Revenues' AND p.dmin = 358
WHERE c.basis = 'FY' AND c.k = 'revenue' AND c.tag <> 'Revenues' AND p.val > c.value"""
    out["qa3_zero_debt"] = """
SELECT 'zero debt contradicted' AS "check", cik, basis, "end", intExp AS detail FROM (
  SELECT *, lag(totalDebt) OVER (PARTITION BY cik, basis ORDER BY "end") AS prev FROM sheet0) WHERE totalDebt = 0 AND prev = 0 AND intExp > 0"""
    out["qa4_calendar"] = """
SELECT p.cik, count(*) AS columns, count(*) FILTER (WHERE p.start < o."end") AS overlaps, count(*) FILTER (WHERE p.fy <= o.fy) AS bad_labels,
       count(*) FILTER (WHERE p.gap > 0) AS gaps, coalesce(max(n.newest) > max(p."end"), FALSE) AS stale
FROM periods p LEFT JOIN periods o ON o.cik = p.cik AND o.idx = p.idx + 1
LEFT JOIN (SELECT cik, max(period) AS newest FROM filing_list WHERE regexp_matches(form, '^(10-K|20-F|40-F)T?(/A)?$') GROUP BY cik) n ON n.cik = p.cik GROUP BY p.cik"""
    rng = [("netMargin", "netIncome", "revenue", -1, 1), ("ebitdaMargin", "ebitda", "revenue", -1, 1), ("roe", "netIncome", "equity", -1, 1),
           ("taxRate", "tax", "pretax", 0, 0.6), ("debtEquity", "totalDebt", "equity", 0, 10)]
    parts = " UNION ALL ".join(
        f"SELECT cik, basis, \"end\", thin, {q(k)} AS ratio, {k} AS value, {n} AS num, {d} AS den, {q(d)} = 'equity' AS oe FROM sheet0 WHERE {k} < {lo} OR {k} > {hi}"
        for k, n, d, lo, hi in rng)
    out["qa5_ranges"] = f"""
SELECT cik, basis, "end", ratio, round(value, 6) AS value, CASE WHEN oe AND thin THEN 'thin equity' WHEN abs(den) < abs(num) THEN 'small denominator' ELSE 'unexplained' END AS cause FROM ({parts})"""
    moves = lambda a, b, what, word: f"""
  SELECT * FROM (SELECT coalesce(x.cik, y.cik) AS cik, 'FY' AS basis, coalesce(x."end", y."end") AS "end", coalesce(x.k, y.k) AS k, x.val AS "before", y.val AS "after",
       x.{what} AS {what}_before, y.{what} AS {what}_after, CASE WHEN x.val IS NULL THEN 'appeared' WHEN y.val IS NULL THEN 'vanished' WHEN x.val <> y.val THEN 'changed'
       WHEN x.{what} <> y.{what} THEN '{word}' END AS change
  FROM (SELECT * FROM {a} WHERE r_nz = 1 AND basis = 'FY') x FULL JOIN (SELECT * FROM {b} WHERE r_nz = 1 AND basis = 'FY') y
    ON x.cik = y.cik AND x."end" = y."end" AND x.k = y.k) WHERE change IS NOT NULL"""
    out["qa6_snapshot_diff"] = moves("offers_then", "offers", "form", "form moved")
    out["qa8_currency_audit"] = moves("offers", "offers_free", "unit", "unit moved")
    ccy = "CASE WHEN regexp_matches(unit, '^[A-Z]{3}(/shares)?$') THEN left(unit, 3) END"
    mixed = lambda t: f"""SELECT count(*) FROM (SELECT cik, "end" FROM {t} WHERE r_nz = 1 AND basis = 'FY' GROUP BY cik, "end" HAVING count(DISTINCT {ccy}) > 1)"""
    out["qa8_currency_summary"] = f"""
SELECT 'cells that differ' AS measure, count(*) AS n FROM ({moves('offers', 'offers_free', 'unit', 'unit moved')})
UNION ALL SELECT 'mixed columns with the gate', ({mixed('offers')}) UNION ALL SELECT 'mixed columns without', ({mixed('offers_free')})
UNION ALL SELECT 'filers changing currency', (SELECT count(*) FROM (SELECT cik FROM annual_anchor WHERE uccy IS NOT NULL GROUP BY cik HAVING count(DISTINCT uccy) > 1))"""
    nm = lambda c: (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), "
                    "'\\b(inc|corp|corporation|co|company|ltd|llc|plc|holdings|group|the|new|old)\\b', ' ', 'g'), '\\s+', ' ', 'g'))")
    recent = "regexp_matches(form, '^(10-K|20-F|40-F)T?(/A)?$') AND filed >= make_date((SELECT y1 - 2 FROM yrs), 1, 1)"
    out["qa14_ticker_suspects"] = f"""
SELECT t.cik, t.ticker, t.title, o.nm2 AS other_name, o.other_cik, CAST(levenshtein({nm('t.title')}, o.nm2) AS INTEGER) AS edits
FROM ticker_list t JOIN (SELECT cik AS other_cik, {nm('max(company)')} AS nm2 FROM idx WHERE {recent} GROUP BY cik) o ON nm2 <> '' AND levenshtein({nm('t.title')}, o.nm2) <= 1
WHERE {nm('t.title')} <> '' AND t.cik NOT IN (SELECT cik FROM idx WHERE {recent})"""
    cells = """SELECT cik, tag, make_date(yr, 12, 31) AS period_end, concat_ws(',', a1 || '=' || m1, a2 || '=' || m2) AS cell, min(val) AS v
  FROM g_sent WHERE NOT cut AND back = {} GROUP BY ALL"""
    out["qa7_segment_diff"] = f"""
SELECT *, CASE WHEN "before" IS NULL THEN 'appeared' WHEN "after" IS NULL THEN 'vanished' ELSE 'changed' END AS change FROM (
  SELECT coalesce(a.cik, b.cik) AS cik, coalesce(a.tag, b.tag) AS tag, coalesce(a.period_end, b.period_end) AS period_end, coalesce(a.cell, b.cell) AS cell,
         b.v AS "before", a.v AS "after"
  FROM ({cells.format(0)}) a FULL JOIN ({cells.format(1)}) b ON a.cik = b.cik AND a.tag = b.tag AND a.period_end = b.period_end AND a.cell = b.cell)
WHERE "before" IS DISTINCT FROM "after\""""
    out["qa9_distribution"] = """
SELECT basis, count(*) AS n, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.05), 6) AS p05, round(quantile_cont(r, 0.01), 6) AS p01
FROM (SELECT basis, abs(equity / nullif(totalAssets, 0)) AS r FROM sheet0) WHERE r IS NOT NULL GROUP BY basis"""
    out["qa10_calibration"] = """
SELECT industry, count(*) AS n, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.75), 6) AS p75, round(quantile_cont(e, 0.9), 6) AS p90
FROM (SELECT industry, abs((pretax + intExp - coalesce(intInc, 0) - ebit) / nullif(ebit, 0)) AS e FROM sheet0) WHERE e IS NOT NULL GROUP BY industry"""
    out["qa11_leg_sources"] = f"""
SELECT f > 1 AS split, count(*) AS columns, count(*) FILTER (WHERE abs(totalAssets - ({claims})) <= greatest(abs({claims}), 1) * 0.005) AS closing
FROM (SELECT cik, basis, "end", count(*) AS n, count(DISTINCT accn) AS f FROM cells WHERE k IN ('totalAssets', 'totalLiab', 'equity') AND value IS NOT NULL GROUP BY ALL) l
JOIN sheet0 USING (cik, basis, "end") WHERE n = 3 GROUP BY ALL"""
    out["qa12_zero_displacement"] = """
SELECT c.cik, c."end", c.k, c.tag AS used, p.tag, p.val FROM read_cells c JOIN line_tags u ON u.industry = c.industry AND u.k = c.k AND u.tag = c.tag
JOIN line_tags l ON l.industry = c.industry AND l.k = c.k AND l.ord > u.ord JOIN picks p ON p.cik = c.cik AND p."end" = c."end" AND p.tag = l.tag AND (p.shape = 'I') = l.inst
  AND (p.shape = 'I' OR p.dmin = 358) WHERE c.basis = 'FY' AND c.value = 0 AND abs(p.val) > 1000000"""
    out["qa13_conflicts"] = """
SELECT a.cik, a."end", a.tag AS tag_a, b.tag AS tag_b, a.val AS val_a, b.val AS val_b, CASE WHEN a.val > b.val THEN a.tag ELSE b.tag END AS larger
FROM picks a JOIN picks b ON a.cik = b.cik AND a."end" = b."end" AND a.dmin = 358 AND b.dmin = 358
JOIN (VALUES ('CostOfGoodsAndServicesSold', 0), ('CostOfRevenue', 1), ('CostOfServices', 2)) x(tag, o) ON x.tag = a.tag
JOIN (VALUES ('CostOfGoodsAndServicesSold', 0), ('CostOfRevenue', 1), ('CostOfServices', 2)) z(tag, o) ON z.tag = b.tag WHERE x.o < z.o AND a.val <> b.val"""
    out["qa15_stride_sample"] = """
SELECT t.cik, t.ticker, CAST(right(t.title, 9) AS BIGINT) AS ord FROM ticker_list t WHERE CAST(right(t.title, 9) AS BIGINT) % 7 = 2
AND t.cik IN (SELECT cik FROM filing_list WHERE form = '10-K' AND filed >= make_date((SELECT y1 - 1 FROM yrs), 6, 1))"""
    out["qa16_populations"] = """
SELECT DISTINCT cik, 'foreign' AS population FROM idx WHERE form IN ('20-F', '20-F/A', '40-F', '40-F/A')
UNION ALL SELECT DISTINCT cik, 'transition' FROM idx WHERE regexp_matches(form, '^(10-K|10-Q|20-F|40-F)T(/A)?$')
UNION ALL SELECT DISTINCT cik, 'amended' FROM idx WHERE suffix(form, '/A') UNION ALL SELECT DISTINCT cik, 'spin-off' FROM idx WHERE form IN ('10-12B', '10-12B/A')"""
    span = "abs(date_diff('day', make_date(year(mid), 1, 1), start)) <= 30"
    out["qa16_by_concept"] = f"""
SELECT DISTINCT population, cik, tag, frame FROM (
  SELECT *, CASE WHEN span AND days BETWEEN 335 AND 395 AND {span} THEN 'CY' || year(mid)
                 WHEN NOT span AND abs(date_diff('day', qe, "end")) <= 30 THEN 'CY' || year(qe) || 'Q' || quarter(qe) || 'I' END AS frame
  FROM (SELECT r.cik, r.tag, p.population, p.span, r.start, r."end", date_diff('day', r.start, r."end") AS days,
               r.start + CAST(date_diff('day', r.start, r."end") // 2 AS INTEGER) AS mid, CAST(date_trunc('quarter', r."end" + 31) AS DATE) - 1 AS qe
        FROM raw r JOIN (VALUES {", ".join(f"({q(a)}, {q(t)}, {d})" for a, t, d in CHAPTER_11)}) p(population, tag, span) ON p.tag = r.tag AND p.span = (r.start IS NOT NULL)
        WHERE r.ns = 'us-gaap')) WHERE frame IS NOT NULL"""
    out["qa17_durations"] = f"SELECT days, count(*) AS facts FROM facts WHERE dur AND per AND tag IN ({names(T.anchor_tags())}) GROUP BY ALL"
    out["qa18_amendments"] = """
SELECT count(*) FILTER (WHERE differs) AS overrides, count(*) FILTER (WHERE differs AND shifted) AS power_of_ten, count(*) FILTER (WHERE shifted AND agreed) AS corroborated,
       count(*) FILTER (WHERE outvoted AND NOT agreed) AS put_right FROM (
  SELECT a.cik, a."end", a.shape, a.dmin, a.tag, bool_or(w.val = a.val) AS agreed, bool_or(w.val <> a.val) AS differs,
    bool_or(coalesce(p10(a.val, w.val), FALSE)) AS shifted, bool_or(coalesce(p10(a.val, w.val), FALSE) AND w.n >= 2) AS outvoted
  FROM amended a JOIN witnesses w ON w.cik = a.cik AND w."end" = a."end" AND w.shape = a.shape AND w.dmin = a.dmin AND w.tag = a.tag GROUP BY ALL)""".replace(
        "p10(a.val, w.val)", "(a.val <> 0 AND w.val <> 0 AND abs(log10(abs(a.val / nullif(w.val, 0))) - round(log10(abs(a.val / nullif(w.val, 0))))) < 1e-9 AND round(log10(abs(a.val / nullif(w.val, 0)))) <> 0)")
    out["qa19_coverage"] = "SELECT industry, basis, k, count(*) AS cells, count(value) AS resolved FROM cells GROUP BY ALL"
    return out
