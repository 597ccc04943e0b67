"""Checking SQL per query, for the tables TESTDATA.md names."""

from ledgerline.dims import template as T
from oracle.base import names, q, with_steps
from oracle.derived import derived_sql
from oracle.more import more_sql

SQL = {}

# which facts of the raw table reach the reader unspoiled, and why the others do not
_SENT = """
  SELECT *, row_number() OVER (PARTITION BY cik, ns, tag, unit ORDER BY pos, accn, val) - 1 AS nth,
         CASE WHEN cik % 41 = 7 AND tag = 'Assets' THEN 'no document' WHEN cik % 43 = 5 AND tag = 'InterestExpense' THEN 'start is no date'
              WHEN cik % 47 = 3 AND tag = 'ProfitLoss' THEN 'filed is no date' WHEN cik % 53 = 2 AND tag = 'Liabilities' THEN 'val is no number' END AS reason
  FROM raw"""
SQL["src1_facts"] = f"""
SELECT cik, ns, tag, unit, CAST(unit_ord AS INTEGER) AS unit_ord, CAST(nth AS BIGINT) AS pos, start, "end", val, accn, CAST(year("end") AS INTEGER) AS fy, fp, form, filed
FROM ({_SENT}) WHERE reason IS NULL"""
SQL["src1_rejects"] = f"""
SELECT cik, ns, tag, unit, reason, count(*) AS n FROM ({_SENT}) WHERE reason IS NOT NULL AND reason <> 'no document' GROUP BY ALL
UNION ALL SELECT cik, NULL, NULL, NULL, reason, 1 FROM ({_SENT}) WHERE reason = 'no document' GROUP BY cik, reason"""
_LISTS = """
  SELECT *, cik % 29 = 8 AS cut, cik % 19 = 4 AND nth = last AS undated, cik % 23 = 6 AND filing_ord % 5 = 2 AS misdated FROM (
    SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_ord) - 1 AS nth, count(*) OVER (PARTITION BY cik) - 1 AS last FROM filing_list)"""
SQL["src2_filings"] = f"""
SELECT cik, CAST(nth AS INTEGER) AS filing_ord, form, filed, accn, doc, period FROM ({_LISTS}) WHERE NOT (cut OR undated OR misdated)"""
SQL["src2_rejects"] = f"""
SELECT cik, CAST(nth AS INTEGER) AS filing_ord, form, accn, CASE WHEN undated THEN 'no filing date' ELSE 'filed is no date' END AS reason
FROM ({_LISTS}) WHERE NOT cut AND (undated OR misdated)
UNION ALL SELECT cik, NULL, NULL, NULL, CASE WHEN cik % 29 = 8 THEN 'no document' ELSE 'arrays of different lengths' END FROM filers WHERE cik % 29 = 8 OR cik % 19 = 4"""
_TICKS = """
  SELECT *, CASE WHEN n % 43 = 9 THEN 'no row' WHEN n % 37 = 5 THEN 'not three values' WHEN n % 31 = 8 THEN 'no filer' END AS reason
  FROM (SELECT *, CAST(right(title, 9) AS BIGINT) AS n FROM ticker_list)"""
SQL["src3_tickers"] = """
SELECT cik, ticker, title FROM ticker_list"""
SQL["src3_rejects"] = f"""
SELECT CASE WHEN reason = 'no row' OR n % 31 = 8 THEN NULL ELSE cik END AS cik, CASE reason WHEN 'no filer' THEN ticker WHEN 'not three values' THEN title END AS ticker,
       CASE WHEN reason = 'no filer' THEN title END AS title, reason FROM ({_TICKS}) WHERE reason IS NOT NULL"""
SQL["src4_quotes"] = """
SELECT symbol, price, strftime("at", '%Y-%m-%d') AS day FROM last_quote"""
SQL["src8_concept_frame"] = f"""
SELECT cik, tag, unit, form, filed, accn, val FROM facts
WHERE tag IN ({names(T.REVENUE_TAGS)}) AND start = make_date((SELECT y1 - 2 FROM yrs), 1, 1) AND "end" = make_date((SELECT y1 - 2 FROM yrs), 12, 31)"""
SQL["prj1_keep_counts"] = f"""
SELECT cik, count(*) FILTER (WHERE kept) AS tags_kept, count(*) FILTER (WHERE ns = 'us-gaap' AND NOT kept) AS tags_dropped FROM (
  SELECT DISTINCT cik, ns, tag, (ns = 'us-gaap' AND tag IN ({names(T.keep_list())})) OR (ns = 'dei' AND tag = 'EntityCommonStockSharesOutstanding') AS kept
  FROM raw WHERE ns IN ('us-gaap', 'dei')) GROUP BY cik"""
SQL["prj2_listed_filings"] = """
SELECT cik, CAST(filing_ord AS INTEGER) AS filing_ord, form, filed, accn, doc, period FROM listed"""
SQL["prj3_to_7_annotated"] = """
SELECT cik, tag, unit, CAST(unit_ord AS INTEGER) AS unit_ord, start, "end", val, form, filed, accn, uccy AS unit_ccy, per AS is_periodic, suffix(form, '/A') AS is_amendment,
       rk AS form_rank, dur AS is_duration, days, days BETWEEN 358 AND 400 AS is_annual FROM facts"""
SQL["prj8_industry"] = """
SELECT cik, name, ticker, sic_code, industry FROM filers"""
SQL["prj17_identifiers"] = """
SELECT cik, CAST(filing_ord AS INTEGER) AS filing_ord, lpad(CAST(cik AS VARCHAR), 10, '0') AS cik10,
       regexp_full_match(CASE WHEN filing_ord % 7 = 3 THEN left(accn, 12) ELSE accn END, '[0-9]{10}-[0-9]{2}-[0-9]{6}') AS id_ok FROM filing_list"""
SQL["sel1_picks"] = """
SELECT DISTINCT cik, "end", shape, tag, val, unit, accn, form, filed, CASE WHEN shape = 'D' THEN date_diff('day', start, "end") END AS days
FROM picks"""
SQL["sel2_prefer_nonzero"] = """
SELECT c.cik, c.basis, c."end", c.k, c.value, c.tag, c.status FROM read_cells c
WHERE c.k IN ('otherInc', 'stDebt', 'debtIssued', 'impairment')"""
SQL["sel3_scale_slips"] = """
SELECT s.cik, s."end", s.tag, s.agreed, m.val AS rival, m.accn AS rival_accn FROM slips s
LEFT JOIN matches m ON m.cik = s.cik AND m."end" = s."end" AND m.shape = s.shape AND m.dmin = s.dmin AND m.tag = s.tag AND m.r = s.rival_r"""
SQL["sel4_statuses"] = """
SELECT cik, basis, "end", industry, k, status FROM read_cells"""
SQL["sel5_currency"] = """
SELECT cik, ccy FROM ccys"""
SQL["sel6_latest"] = """
SELECT cik, k, value, unit, tag, accn, form, filed, fact_end FROM newest_fact"""
SQL["sel7_runs"] = """
SELECT cik, tag, CAST(run AS INTEGER) AS run FROM runs"""
SQL["sel8_identity"] = """
SELECT cik, tag, score FROM scores"""
SQL["sel7_8_pin_order"] = """
SELECT cik, tag, ident AS by_identity, CAST(ord AS INTEGER) AS tag_ord FROM pins"""
SQL["sel9_debt_scope"] = """
SELECT cik, tag, scope FROM scope"""
SQL["sel10_other_currency"] = """
SELECT cik, basis, "end", k, other AS ccy FROM read_cells WHERE status = 'other-currency'"""
SQL["cells_all"] = """
SELECT cik, basis, "end", k, value, unit, tag, accn, form, filed, status FROM cells"""
SQL["cal1_candidates"] = """
SELECT cik, tag, start, "end" FROM cal_all"""
SQL["cal2_chosen"] = """
SELECT cik, tag, contiguous, years FROM cal_pick"""
SQL["cal3_to_6_periods"] = """
SELECT cik, CAST(idx AS INTEGER) AS idx, "end", start, CAST(fy AS INTEGER) AS fy, CAST(gap AS INTEGER) AS gap_before, ccy FROM periods"""
SQL["cal7_has_periods"] = """
SELECT f.cik, f.industry, EXISTS (SELECT 1 FROM annual_anchor a WHERE a.cik = f.cik) AS has_periods FROM filers f"""
SQL["cal8_predecessors"] = """
SELECT t.ticker, t.title, t.cik AS listed_cik, CASE WHEN o.cik IS NULL AND p.cik IS NOT NULL THEN p.cik ELSE t.cik END AS used_cik,
       o.cik IS NULL AND p.cik IS NOT NULL AS fell_back
FROM ticker_list t LEFT JOIN (SELECT DISTINCT cik FROM annual_anchor) o ON o.cik = t.cik
LEFT JOIN (SELECT f.ticker, f.cik FROM filers f WHERE f.cik % 25 = 6 AND f.cik IN (SELECT cik FROM annual_anchor)) p ON p.ticker = t.ticker"""
SQL["cal9_ticker_fixes"] = """
SELECT CASE WHEN t.cik % 25 = 3 AND t.cik < 1000000 THEN t.cik ELSE t.cik END AS cik, t.ticker,
       CASE WHEN t.cik % 25 = 3 AND t.cik < 1000000 THEN 'Corrected ' || t.title ELSE t.title END AS title FROM ticker_list t
UNION ALL SELECT c_custkey, 'C' || CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE c_mktsegment = 'BUILDING'"""
SQL["cal10_stale"] = """
SELECT n.cik, p."end" AS newest_end, n.period, n.form, n.accn,
       CASE WHEN regexp_matches(n.form, 'T(/A)?$') THEN 'transition' WHEN n.form LIKE '20-F%' OR n.form LIKE '40-F%' THEN 'foreign' ELSE 'plain' END AS wording
FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period DESC, filing_ord) AS r FROM filing_list
      WHERE regexp_matches(form, '^(10-K|20-F|40-F)T?(/A)?$')) n
JOIN periods p ON p.cik = n.cik AND p.idx = 0 WHERE n.r = 1 AND n.period > p."end" """
SQL["ltm1_2_rungs"] = """
SELECT cik, CAST(k AS INTEGER) AS k, start, "end", CAST(days AS INTEGER) AS days FROM rungs"""
SQL["ltm3_windows"] = """
SELECT cik, CAST(k AS INTEGER) AS k, cur_start, cur_end, CAST(cur_days AS INTEGER) AS cur_days, prior_start, prior_end, fy_end, prev_fy_end FROM windows"""
SQL["ltm4_5_stitched"] = """
SELECT cik, "end", k, value, unit, tag, status FROM cells WHERE basis = 'LTM' AND NOT inst"""
SQL["ltm6_balances"] = """
SELECT cik, "end", k, value, status FROM cells WHERE basis = 'LTM' AND inst"""
SQL["ltm7_carried"] = """
SELECT cik, "end" FROM periods WHERE idx = 0 AND cik NOT IN (SELECT cik FROM windows) AND cik NOT IN (SELECT cik FROM rungs WHERE k = 0)"""
SQL["ltm9_reconstruction"] = """
SELECT r.cik, r."end", c.k, r.rebuilt, c.value, round(abs((r.rebuilt - c.value) / nullif(c.value, 0)), 6) AS gap
FROM (
  SELECT w.cik, w.cur_end AS "end", y.tag,
         a.p1 + CASE WHEN a.n >= 2 THEN a.p2 ELSE 0 END + CASE WHEN a.n >= 3 THEN a.p3 ELSE 0 END
         + CASE WHEN b.at < 2 AND b.n >= 2 THEN b.p2 ELSE 0 END + CASE WHEN b.at < 3 AND b.n >= 3 THEN b.p3 ELSE 0 END
         + y.val - CASE b.n WHEN 1 THEN b.t1 WHEN 2 THEN b.t2 ELSE b.t3 END AS rebuilt
  FROM windows w JOIN q_year y ON y.cik = w.cik JOIN q_parts a ON a.cik = w.cik AND a.side = 'cur' AND a.tag = y.tag AND a.at IS NOT NULL
  JOIN q_parts b ON b.cik = w.cik AND b.side = 'prior' AND b.tag = y.tag AND b.at IS NOT NULL WHERE w.k = 0) r
JOIN cells c ON c.cik = r.cik AND c."end" = r."end" AND c.tag = r.tag AND c.basis = 'LTM' AND c.status = 'ltm' WHERE r.rebuilt IS NOT NULL"""


def oracle_sql() -> dict:
    out = {k: with_steps(v) for k, v in SQL.items()}
    out.update({k: with_steps(v) for k, v in derived_sql().items()})
    out.update({k: with_steps(v) for k, v in more_sql().items()})
    return out
