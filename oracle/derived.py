"""Checking SQL of the computed rows, statuses, notes and comparables.

The formulas are written out for DuckDB in three layers of plain columns; the
last step blanks what an industry does not have.
"""

from ledgerline.dims import template as T
from ledgerline.operators import notes
from oracle.base import names, q, step


def n0(x):
    return f"coalesce({x}, 0)"


def div(a, b):
    return f"({a}) / nullif({b}, 0)"


def total(*xs):
    return f"CASE WHEN {' AND '.join(f'{x} IS NULL' for x in xs)} THEN NULL ELSE {' + '.join(n0(x) for x in xs)} END"


step("flagged", """
  SELECT w.*, c.fy, c.gap, c.ccy, coalesce(s.scope = 'includes', FALSE) AS cur_inside,
         coalesce(w."stDebt" = w."ltdCur" AND w."stDebt" <> 0, FALSE) AS dup_debt,
         coalesce(w."totalAssets" <> 0 AND abs(w."equity") / abs(nullif(w."totalAssets", 0)) < 0.02, FALSE) AS thin,
         coalesce(w.equity_tag = 'StockholdersEquity', FALSE) AS parent
  FROM wide w JOIN cols c ON c.cik = w.cik AND c.basis = w.basis AND c."end" = w."end"
  LEFT JOIN scope s ON s.cik = w.cik AND s.tag = w.debt_tag""")

_FFO = ("CASE WHEN niToCommon IS NULL OR da IS NULL THEN NULL WHEN gainOnPropertySale IS NULL AND niToCommon > ebit THEN NULL "
        "ELSE niToCommon + da - coalesce(gainOnPropertySale, 0) + coalesce(reImpairment, 0) END")
L1 = {
    "d_revenue": f"CASE WHEN industry = 'bank' THEN coalesce(revenue, {total('nii', 'noninterestIncome')}) ELSE revenue END",
    "d_netIncome": "CASE WHEN netIncome < niToCommon THEN niToCommon ELSE netIncome END",
    "d_nciDerived": "coalesce(nciBs IS NULL AND parent AND equityAll <> equity, FALSE)",
    "d_nciBs": "CASE WHEN nciBs IS NULL AND parent AND equityAll <> equity THEN equityAll - equity ELSE nciBs END",
    "d_ebitda": "ebit + coalesce(da, 0)",
    "d_fcf": "cfo - coalesce(capex, 0)",
    "d_taxRate": div("tax", "pretax"),
    "d_corp": "CASE WHEN ltdCur IS NOT NULL AND ltDebt IS NULL THEN NULL ELSE " + total(
        "CASE WHEN NOT dup_debt THEN stDebt END", "CASE WHEN NOT cur_inside THEN ltdCur END", "ltDebt") + " END",
    "d_nii": "CASE WHEN industry = 'bank' THEN coalesce(nii, intIncTotal - coalesce(intExpTotal, 0)) ELSE nii END",
    "d_losses": "lossesIncurred + coalesce(lifeBenefits, 0)",
    "d_tangible": "equity - coalesce(goodwill, 0) - coalesce(intangibles, 0)",
    "d_ffo": _FFO,
    "d_gross_loans": total("loans", "allowance"),
    "d_reserves": total("futurePolicyBenefits", "policyholderAccounts"),
}
L2 = {
    "d_grossProfit": "CASE WHEN grossProfit IS NULL THEN d_revenue - cogs ELSE grossProfit END",
    "d_all": "CASE WHEN industry = 'reit' THEN reitDebt ELSE debtAllIn END",
    "d_totalDebt": "CASE WHEN (CASE WHEN industry = 'reit' THEN reitDebt ELSE debtAllIn END) IS NOT NULL AND (ltDebt IS NULL OR "
                   "(CASE WHEN industry = 'reit' THEN reitDebt ELSE debtAllIn END) >= ltDebt) "
                   "THEN (CASE WHEN industry = 'reit' THEN reitDebt ELSE debtAllIn END) ELSE d_corp END",
    "d_nopat": "ebit * (1 - d_taxRate)",
    "d_bankrev": total("d_nii", "noninterestIncome"),
    "d_dso": f"{div('ar', 'd_revenue')} * 365",
    "d_dio": f"{div('inventory', 'cogs')} * 365",
    "d_dpo": f"{div('ap', 'cogs')} * 365",
    "d_nwc": "(curAssets - coalesce(cash, 0) - coalesce(sti, 0)) - (curLiab - coalesce(stDebt, 0) - coalesce(ltdCur, 0))",
}
L3 = {
    "netDebt": "d_totalDebt - coalesce(cash, 0) - coalesce(sti, 0)",
    "investedCap": "d_totalDebt + coalesce(equity, 0) - coalesce(cash, 0)",
}
CORE = {
    "netIncome": "d_netIncome", "nciBs": "d_nciBs", "ebitda": "d_ebitda", "ebitdaSbc": "d_ebitda - coalesce(sbc, 0)",
    "grossProfit": "d_grossProfit", "grossMargin": div("d_grossProfit", "d_revenue"), "ebitdaMargin": div("d_ebitda", "d_revenue"),
    "ebitMargin": div("ebit", "d_revenue"), "netMargin": div("d_netIncome", "d_revenue"), "fcf": "d_fcf",
    "fcfMargin": div("d_fcf", "d_revenue"), "fcfConv": div("d_fcf", "d_netIncome"), "taxRate": "d_taxRate", "totalDebt": "d_totalDebt",
    "debtLikeTotal": total("olCur", "olNon", "flCur", "flNon", "pensionUnderfunded", "deferredComp", "assetRetirement"),
    "totalDebtLeases": total("d_totalDebt", "olCur", "olNon", "flCur", "flNon"), "netDebt": "d_netDebt",
    "netLev": div("d_netDebt", "d_ebitda"), "grossLev": div("d_totalDebt", "d_ebitda"), "intCover": div("d_ebitda", "intExp"),
    "fccr": div("d_ebitda - coalesce(capex, 0)", "intExp"), "debtEquity": div("d_totalDebt", "equity"),
    "debtCap": div("d_totalDebt", total("d_totalDebt", "equity")), "currentRatio": div("curAssets", "curLiab"),
    "quickRatio": div("curAssets - coalesce(inventory, 0)", "curLiab"), "nopat": "d_nopat", "investedCap": "d_investedCap",
    "roic": div("d_nopat", "d_investedCap"), "roe": div("d_netIncome", "equity"), "roa": div("d_netIncome", "totalAssets"),
    "assetTurn": div("d_revenue", "totalAssets"), "dso": "d_dso", "dio": "d_dio", "dpo": "d_dpo",
    "ccc": "d_dso + coalesce(d_dio, 0) - coalesce(d_dpo, 0)", "nwc": "d_nwc", "nwcPctRev": div("d_nwc", "d_revenue"),
    "capexPctRev": div("capex", "d_revenue"), "daPctRev": div("da", "d_revenue"), "sbcPctRev": div("sbc", "d_revenue"),
    "bvps": div("equity", "sharesOut"), "tbvps": div("d_tangible", "sharesOut"),
    "ufcf": "d_nopat + coalesce(da, 0) - coalesce(capex, 0)", "cashTaxRate": div("tax - coalesce(deferredTax, 0)", "pretax"),
}
BY_INDUSTRY = {
    "bank": {
        "nii": "d_nii", "revenue": "d_revenue", "totalRevenueBank": "d_bankrev", "efficiency": div("noninterestExpense", "d_bankrev"),
        "niiOnAssets": div("d_nii", "totalAssets"), "loansToDeposits": div("loans", "deposits"), "loansGross": "d_gross_loans",
        "allowanceToLoans": div("allowance", "d_gross_loans"), "provisionToLoans": div("provision", "d_gross_loans"),
        "depositsToAssets": div("deposits", "totalAssets"), "equityToAssets": div("equity", "totalAssets")},
    "pc": {
        "lossesTotal": "d_losses", "lossRatio": div("d_losses", "npe"), "expenseRatio": div("dacAmort + otherUwExp", "npe"),
        "combinedRatio": div("d_losses + dacAmort + otherUwExp", "npe"), "uwProfit": "npe - d_losses - dacAmort - otherUwExp",
        "pyDevRatio": div("pyDevelopment", "npe"),
        "float": "coalesce(lossReservesNet, lossReserves - reinsRecov) + unearnedPrem - coalesce(dac, 0)",
        "premiumLeverage": div("npw", "equity"), "reserveLeverage": div("lossReserves", "equity"),
        "cededRatio": div("cededPrem", "cededPrem + npe"), "investmentYield": div("invIncome", "investments")},
    "life": {
        "benefitRatio": div("benefits", "premiums"), "creditingRate": div("interestCredited", "policyholderAccounts"),
        "investmentYield": div("invIncome", "investments"), "policyReserves": "d_reserves", "reserveLeverage": div("d_reserves", "equity"),
        "bvpsExAoci": div("equity - coalesce(aoci, 0)", "sharesOut")},
    "health": {
        "mlr": div("medicalCosts", "premiums"), "healthSgaRatio": div("sga", "d_revenue"),
        "daysClaimsPayable": f"{div('medicalClaimsPayable', 'medicalCosts')} * 365", "premiumMix": div("premiums", "d_revenue")},
    "advisory": {
        "compRatio": div("compExpense", "d_revenue"), "pretaxMargin": div("pretax", "d_revenue"), "tangibleEquity": "d_tangible",
        "rote": div("d_netIncome", "d_tangible")},
    "reit": {
        "totalDebt": "d_totalDebt", "noi": "rentalRevenue - propOpex", "noiMargin": div("rentalRevenue - propOpex", "rentalRevenue"),
        "ffo": "d_ffo", "ffoPerShare": div("d_ffo", "wasoDil"), "ffoPayout": div("dividends", "d_ffo"), "reNet": "reGross - reAccumDep",
        "debtToGrossRE": div("d_totalDebt", "reGross"), "accumDepPct": div("reAccumDep", "reGross")},
}
FLAG_COLS = "cik, industry, basis, \"end\", fy, gap, ccy, thin, parent, dup_debt, cur_inside, d_nciDerived"
NA = {}
for _i, _ks in T.NOT_APPLICABLE.items():
    for _k in _ks:
        NA.setdefault(_k, []).append(_i)


def _layer(cols):
    return ", ".join(f"{e} AS {k}" for k, e in cols.items())


step("lay1", f"SELECT *, {_layer(L1)} FROM flagged")
step("lay2", f"SELECT *, {_layer(L2)} FROM lay1")
step("lay3", "SELECT *, " + ", ".join(f"{e} AS d_{k}" for k, e in L3.items()) + " FROM lay2")


def _final_exprs():
    out = {k: f'"{k}"' for k in T.fetched_keys()}
    out["revenue"] = "d_revenue"
    out.update(CORE)
    for i, cols in BY_INDUSTRY.items():
        for k, e in cols.items():
            if k in ("revenue", "totalDebt", "nii"):
                out[k] = e
            elif k in ("investmentYield", "reserveLeverage") and i == "life":
                first = BY_INDUSTRY["pc"][k]
                out[k] = f"CASE industry WHEN 'pc' THEN {first} WHEN 'life' THEN {e} END"
            else:
                out[k] = f"CASE WHEN industry = '{i}' THEN {e} END"
    return out


FINAL = _final_exprs()
step("blanked", f"SELECT {FLAG_COLS}, \"grossProfit\" IS NOT NULL AS gp_fetched, " + ", ".join(
    (f"CASE WHEN industry NOT IN ({names(NA[k])}) THEN {e} END" if k in NA else e) + f' AS "{k}"' for k, e in FINAL.items()) + " FROM lay3")
step("grown", """
  SELECT *,
    CASE WHEN gap = 0 THEN revenue / nullif(lag(revenue) OVER w, 0) - 1 END AS "revGrowth",
    CASE WHEN gap = 0 THEN ebitda / nullif(lag(ebitda) OVER w, 0) - 1 END AS "ebitdaGrowth",
    CASE WHEN gap = 0 THEN epsDil / nullif(lag(epsDil) OVER w, 0) - 1 END AS "epsGrowth",
    CASE WHEN revenue > 0 AND lag(revenue, 3) OVER w > 0 AND gap = 0 AND lag(gap, 1) OVER w = 0 AND lag(gap, 2) OVER w = 0
      THEN pow(revenue / lag(revenue, 3) OVER w, 1.0 / 3) - 1 END AS "revCagr3",
    CASE WHEN revenue > 0 AND lag(revenue, 5) OVER w > 0 AND gap = 0 AND lag(gap, 1) OVER w = 0 AND lag(gap, 2) OVER w = 0
      AND lag(gap, 3) OVER w = 0 AND lag(gap, 4) OVER w = 0 THEN pow(revenue / lag(revenue, 5) OVER w, 1.0 / 5) - 1 END AS "revCagr5"
  FROM blanked WINDOW w AS (PARTITION BY cik, basis ORDER BY "end")""")
step("quoted", """
  SELECT g.*, CASE WHEN l.price IS NOT NULL AND g."end" = max(g."end") OVER (PARTITION BY g.cik, g.basis)
                   THEN CASE WHEN g.ccy <> 'USD' THEN 'currency-mismatch' ELSE 'market' END END AS mstat, l.price AS last_price
  FROM grown g JOIN filers i USING (cik) LEFT JOIN last_quote l ON l.symbol = i.ticker""")
step("capped", """SELECT *, CASE WHEN mstat = 'market' THEN last_price END AS m_price, CASE WHEN mstat = 'market' THEN last_price * sharesOut END AS m_cap FROM quoted""")
step("bridged", """SELECT *, m_cap + totalDebt + coalesce(preferred, 0) + coalesce(nciBs, 0) - coalesce(cash, 0) - coalesce(sti, 0) AS m_ev FROM capped""")
MARKET = {
    "price": "m_price", "mktCap": "m_cap", "ev": "m_ev", "evRev": "nullif(m_ev, 0) / nullif(revenue, 0)",
    "evEbitda": "nullif(m_ev, 0) / nullif(ebitda, 0)", "evEbit": "nullif(m_ev, 0) / nullif(ebit, 0)",
    "evFcf": "nullif(m_ev, 0) / nullif(fcf, 0)", "pe": "m_price / nullif(epsDil, 0)", "pb": "nullif(m_cap, 0) / nullif(equity, 0)",
    "fcfYield": "fcf / nullif(m_cap, 0)", "divYield": "nullif(dps, 0) / m_price",
}
step("sheet0", "SELECT *, " + ", ".join(
    (f"CASE WHEN industry NOT IN ({names(NA[k])}) THEN {e} END" if k in NA else e) + f' AS "{k}"' for k, e in MARKET.items()) + " FROM bridged")
step("sheet", """
  SELECT *, basis = 'LTM' AS stitched FROM sheet0
  UNION ALL
  SELECT s.* REPLACE ('LTM' AS basis), FALSE FROM sheet0 s JOIN periods p ON p.cik = s.cik AND p."end" = s."end" AND p.idx = 0
  WHERE s.basis = 'FY' AND s.cik NOT IN (SELECT cik FROM windows) AND s.cik NOT IN (SELECT cik FROM rungs WHERE k = 0)""")
# long form with statuses
_ALL = list(dict.fromkeys(r[7] for r in T.template_rows()))
_HAVE = set(FINAL) | set(MARKET) | {"revGrowth", "ebitdaGrowth", "epsGrowth", "revCagr3", "revCagr5"}
step("tall", "SELECT * FROM (SELECT cik, industry, basis, \"end\", fy, ccy, mstat, " + ", ".join(
    (f'CAST("{k}" AS DOUBLE)' if k in _HAVE else "CAST(NULL AS DOUBLE)") + f' AS "{k}"' for k in _ALL) + " FROM sheet0) s UNPIVOT INCLUDE NULLS (value FOR k IN (" + ", ".join(
    f'"{k}"' for k in _ALL) + "))")
step("layout", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(r[0])}, {r[1]}, {q(r[2])}, {q(r[3])}, {q(r[4]) if r[4] else 'NULL'}, {r[6]}, {q(r[7])}, {q(r[8])}, {q(r[9])})"
    for r in T.template_rows()) + ") v(industry, section_ord, section, section_title, tab, line_ord, k, label, how)")
_DER = {}
for _i in T.INDUSTRIES:
    _DER[_i] = set(CORE) | set(BY_INDUSTRY.get(_i, {}))
step("derived_keys", "SELECT * FROM (VALUES " + ", ".join(f"({q(i)}, {q(k)})" for i, ks in _DER.items() for k in sorted(ks)) + ") v(industry, k)")
step("na_keys", "SELECT * FROM (VALUES " + ", ".join(f"({q(i)}, {q(k)})" for i, ks in T.NOT_APPLICABLE.items() for k in ks) + ") v(industry, k)")
step("long", f"""
  SELECT t.*, l.section_ord, l.section, l.section_title, l.tab, l.line_ord, l.label, l.how, c.tag, c.unit, c.accn, c.form, c.filed, c.other,
    CASE WHEN t.k IN ({names(MARKET)}) AND mstat = 'currency-mismatch' THEN 'currency-mismatch'
         WHEN n.k IS NOT NULL THEN 'not-applicable'
         WHEN t.k IN ({names(MARKET)}) THEN mstat
         WHEN t.k IN ('revGrowth', 'ebitdaGrowth', 'epsGrowth', 'revCagr3', 'revCagr5') THEN 'computed'
         WHEN d.k IS NOT NULL AND c.status IS NULL THEN 'computed'
         WHEN d.k IS NOT NULL AND t.value IS NOT NULL AND (t.k = 'nii' OR c.value IS NULL OR c.value <> t.value) THEN 'computed'
         ELSE c.status END AS status
  FROM tall t JOIN layout l ON l.industry = t.industry AND l.k = t.k
  LEFT JOIN cells c ON c.cik = t.cik AND c.basis = t.basis AND c."end" = t."end" AND c.k = t.k
  LEFT JOIN derived_keys d ON d.industry = t.industry AND d.k = t.k LEFT JOIN na_keys n ON n.industry = t.industry AND n.k = t.k""")
# comparables
# typed sets: a moved ticker is led back to the supplier itself, one or two successions away
step("typed", """
  SELECT n_name AS set_id, s_suppkey * 10 AS ord, CASE WHEN s_suppkey % 3 = 0 THEN ' ' || lower(ticker) ELSE ticker END AS text
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN filers ON cik = s_suppkey
  UNION ALL SELECT n_name, s_suppkey * 10 + 1, ticker FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN filers ON cik = s_suppkey WHERE s_suppkey % 10 = 0
  UNION ALL SELECT n_name, 0, 'nosuch' FROM nation UNION ALL SELECT n_name, 1, '  ' FROM nation""")
step("live_filer", "SELECT DISTINCT cik FROM annual_anchor")
step("fixed_list", """
  SELECT min(cik) AS cik, ticker, arg_min(title, cik) AS title FROM (
    SELECT t.cik, t.ticker, CASE WHEN f.cik % 25 = 3 THEN 'Corrected ' || t.title ELSE t.title END AS title FROM ticker_list t JOIN filers f USING (ticker)
    UNION ALL SELECT c_custkey, 'C' || CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ticker""")
step("typed_members", """
  SELECT m.set_id, m.ord, m.ticker, t.title, t.cik, CASE WHEN b.cik IS NOT NULL THEN b.cik ELSE t.cik END AS used_cik,
         CASE WHEN b.cik IS NULL THEN 0 WHEN b.cik % 50 = 31 THEN 2 ELSE 1 END AS steps, t.cik IS NOT NULL AS known,
         coalesce(b.cik IS NOT NULL OR o.cik IS NOT NULL, FALSE) AS has_periods
  FROM (SELECT set_id, upper(trim(text)) AS ticker, min(ord) AS ord FROM typed WHERE trim(text) <> '' GROUP BY ALL) m LEFT JOIN fixed_list t USING (ticker)
  LEFT JOIN live_filer o ON o.cik = t.cik LEFT JOIN live_filer b ON o.cik IS NULL AND b.cik = t.cik - 1000000 AND b.cik % 25 = 6""")
step("set_members", """
  SELECT industry AS set_id, ticker, cik FROM filers UNION ALL SELECT set_id, ticker, used_cik FROM typed_members WHERE known""")
step("chosen", """
  SELECT i.set_id, i.ticker, s.* EXCLUDE (industry) FROM sheet s JOIN set_members i USING (cik)
  WHERE s."end" = (SELECT max("end") FROM sheet x WHERE x.cik = s.cik AND x.basis = s.basis)""")
_CK = [k for _, k, _ in T.COMPS_ROWS]
step("comp_dim", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {list(dict.fromkeys(g for g, _, _ in T.COMPS_ROWS)).index(g)}, {q(g)}, {q(k)}, {q(l)}, {str(k in T.COMPS_MARKET).upper()}, {str(k not in T.COMPS_NO_MEDIAN).upper()})"
    for i, (g, k, l) in enumerate(T.COMPS_ROWS)) + ") v(row_ord, group_ord, grp, k, label, mk, med)")
step("comp_tall", "SELECT * FROM (SELECT set_id, basis, ticker, cik, \"end\", " + ", ".join(f'CAST("{k}" AS DOUBLE) AS "{k}"' for k in _CK)
     + " FROM chosen) s UNPIVOT INCLUDE NULLS (value FOR k IN (" + ", ".join(f'"{k}"' for k in _CK) + "))")
step("comp_rows", "SELECT t.*, d.row_ord, d.group_ord, d.grp, d.label, d.mk, d.med FROM comp_tall t JOIN comp_dim d USING (k)")
step("dom", """
  SELECT set_id, basis, ccy AS dominant, n_ccy > 1 AS mixed FROM (
    SELECT *, row_number() OVER (PARTITION BY set_id, basis ORDER BY n DESC, (ccy = 'USD') DESC, ccy DESC) AS r, count(*) OVER (PARTITION BY set_id, basis) AS n_ccy
    FROM (SELECT set_id, basis, ccy, count(*) AS n FROM chosen WHERE ccy IS NOT NULL GROUP BY ALL)) WHERE r = 1""")
step("positions", """
  SELECT cik, "end", row_number() OVER (PARTITION BY cik ORDER BY "end") AS pos FROM (SELECT DISTINCT cik, "end" FROM long WHERE basis = 'FY')""")


def r6(*keys):
    return ", ".join(f'round("{k}", 6) AS "{k}"' for k in keys)


KEYS = 'cik, basis, "end"'


def derived_sql() -> dict:
    out = {}
    out["ltm8_growth"] = f"SELECT cik, \"end\", {r6('revGrowth', 'ebitdaGrowth', 'epsGrowth', 'revCagr3', 'revCagr5')} FROM sheet0 WHERE basis = 'LTM'"
    out["der2_corporate"] = f"SELECT {KEYS}, {r6(*CORE)} FROM sheet0"
    for op, i in (("der3", "bank"), ("der4", "pc"), ("der5", "life"), ("der6", "health"), ("der7", "advisory"), ("der8", "reit")):
        out[f"{op}_{i}"] = f"SELECT {KEYS}, {r6(*BY_INDUSTRY[i])} FROM sheet0 WHERE industry = '{i}'"
    out["der9_merged_status"] = f"SELECT {KEYS}, k, value, status FROM long WHERE k IN ('revenue', 'netIncome', 'nciBs', 'grossProfit', 'nii', 'totalDebt')"
    out["der10_debt"] = f"SELECT {KEYS}, stDebt AS \"stDebt\", ltdCur AS \"ltdCur\", ltDebt AS \"ltDebt\", debtAllIn AS \"debtAllIn\", totalDebt AS \"totalDebt\", cur_inside AS \"ltdCurInLtDebt\" FROM sheet0"
    out["der11_12_13_15_flags"] = f"""
SELECT {KEYS}, dup_debt AS "stDebtIsLtdCur", thin AS "equityThin", parent AS "equityIsParent", d_nciDerived AS "nciDerived",
       grossProfit IS NOT NULL AND NOT gp_fetched AS "grossProfitDerived" FROM sheet0"""
    out["der14_not_applicable"] = f"SELECT {KEYS}, industry, section, k, value FROM long WHERE status = 'not-applicable'"
    out["win1_growth"] = f"SELECT cik, \"end\", {r6('revGrowth', 'ebitdaGrowth', 'epsGrowth')} FROM sheet0 WHERE basis = 'FY'"
    out["win2_cagr"] = f"SELECT cik, \"end\", {r6('revCagr3', 'revCagr5')} FROM sheet0 WHERE basis = 'FY'"
    out["win3_growth_status"] = f"""
SELECT {KEYS}, k, status, round(value, 6) AS value FROM long WHERE k IN ('revGrowth', 'ebitdaGrowth', 'epsGrowth', 'revCagr3', 'revCagr5')"""
    out["val1_multiples"] = f"SELECT {KEYS}, {r6(*MARKET)} FROM sheet0 WHERE mstat IS NOT NULL"
    out["val2_mismatch"] = f"SELECT {KEYS}, k, ccy AS status_ccy, value FROM long WHERE status = 'currency-mismatch'"
    out["ext_declared_rows"] = f"""
SELECT {KEYS}, round(CASE WHEN gap = 0 THEN nwc - lag(nwc) OVER (PARTITION BY cik, basis ORDER BY "end") END, 6) AS "chgNwc",
  round(netDebt, 6) AS "netDebtBridge", round(netDebt, 6) AS "entryNetDebt", round(CASE WHEN basis = 'LTM' THEN ebitda END, 6) AS "ltmEbitda",
  round(CASE WHEN basis = 'LTM' THEN revenue END, 6) AS "ltmRevenue",
  round(CASE WHEN price IS NOT NULL THEN sharesOut + coalesce(optionsOut, 0) - coalesce(optionsOut * optionsStrike / nullif(price, 0), 0) + coalesce(rsuOut, 0) END, 6) AS "treasuryMethod",
  CAST(NULL AS DOUBLE) AS "premium1d" FROM sheet0"""
    out["prj9_10_11_sheet_layout"] = f"""
SELECT {KEYS}, industry, section, CAST(section_ord AS INTEGER) AS section_ord, k, CAST(line_ord AS INTEGER) AS line_ord, label, how, value IS NOT NULL AS filled FROM long"""
    pct, mult, days = names(T.PERCENT_KEYS), names(T.MULTIPLE_KEYS), names(T.DAY_KEYS)
    out["prj12_display"] = f"""
SELECT cik, basis, "end", k, CASE WHEN k IN ({pct}) THEN printf('%.1f', value * 100) || '%' WHEN k IN ({mult}) THEN printf('%.2f', value) || 'x'
  WHEN k IN ({days}) THEN CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR) || 'd'
  WHEN abs(value) < 1000 OR coalesce(unit = 'pure', FALSE) THEN regexp_replace(regexp_replace(format('{{:,.2f}}', floor(value * 100 + 0.5) / 100), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')
  ELSE format('{{:,}}', CAST(floor(value + 0.5) AS BIGINT)) END AS shown
FROM long WHERE value IS NOT NULL"""
    out["prj14_links"] = f"""
SELECT {KEYS}, section, k, 'https://www.sec.gov/Archives/edgar/data/' || CAST(cik AS VARCHAR) || '/' || replace(accn, '-', '') || '/' || accn || '-index.htm' AS url
FROM long WHERE status IN ('reported', 'ltm') AND accn IS NOT NULL"""
    na = "CASE industry " + " ".join(f"WHEN {q(i)} THEN {q('n/a for a ' + t)}" for i, t in T.INDUSTRY_LABEL.items()) + " ELSE 'n/a' END"
    out["note1_status_chips"] = f"""
SELECT cik, k, CASE WHEN filled > 0 THEN NULL WHEN oldest = 'not-applicable' THEN {na}
   WHEN newest = 'currency-mismatch' THEN 'reported in ' || nccy WHEN newest = 'other-currency' THEN 'filed in ' || nother
   WHEN how = 'manual' THEN 'judgement' WHEN how = 'market' THEN 'needs price' WHEN how = 'computed' THEN NULL
   WHEN oldest = 'never-tagged' THEN 'n/a' ELSE 'not tagged' END AS chip
FROM (SELECT cik, industry, k, how, count(value) AS filled, arg_min(coalesce(status, ''), "end") AS oldest, arg_max(coalesce(status, ''), "end") AS newest,
             arg_max(coalesce(ccy, ''), "end") AS nccy, arg_max(coalesce(other, ''), "end") AS nother
      FROM long WHERE basis = 'FY' GROUP BY ALL)"""
    flags = " UNION ALL ".join(
        f"SELECT cik, \"end\", {q(k)} AS k, {q(flag)} AS cause, " + (q(text) if text else
        "printf('equity is %.2f%% of total assets', abs(equity / totalAssets) * 100)") + f" AS note FROM sheet0 WHERE basis = 'FY' AND {cond}"
        for (k, flag, text), cond in zip(notes.FLAG_NOTES, (
            "grossProfit IS NOT NULL AND NOT gp_fetched", "dup_debt", "cur_inside", "d_nciDerived", "thin", "thin")))
    tagged = ", ".join(f"({q(k)}, {q(t)}, {q(n)})" for k, t, n in notes.TAG_NOTES)
    out["note2_3_4_notes"] = f"""
SELECT cik, k, 'blank' AS kind, CAST(NULL AS VARCHAR) AS cause, "end", {q(notes.BLANK_NOTES['ebit'])} AS note FROM (
  SELECT *, row_number() OVER (PARTITION BY cik ORDER BY "end" DESC) AS r FROM long WHERE k = 'ebit' AND basis = 'FY')
WHERE r = 1 AND value IS NULL AND status <> 'not-applicable'
UNION ALL
SELECT t.cik, t.k, 'tag', t.tag, t."end", n.note FROM (SELECT *, row_number() OVER (PARTITION BY cik, k ORDER BY "end" DESC) AS r FROM long WHERE basis = 'FY') t
JOIN (VALUES {tagged}) n(k, tag, note) ON n.k = t.k AND n.tag = t.tag WHERE t.r = 1 AND t.status IN ('reported', 'ltm', 'no-interim', 'restated-basis')
UNION ALL
SELECT cik, k, 'flag', cause, "end", note FROM (SELECT *, row_number() OVER (PARTITION BY cik, k, cause ORDER BY "end" DESC) AS r FROM ({flags})) WHERE r = 1"""
    out["note5_header"] = f"""
SELECT f.cik, f.name, f.industry, coalesce(c.kept, 0) AS tags_kept, coalesce(c.dropped, 0) AS tags_dropped, coalesce(l.n, 0) AS filings,
       CASE WHEN y.ccy <> 'USD' THEN y.ccy END AS notice_ccy, NOT EXISTS (SELECT 1 FROM periods p WHERE p.cik = f.cik) AS "empty"
FROM filers f LEFT JOIN ccys y USING (cik) LEFT JOIN (SELECT cik, count(*) AS n FROM filing_list WHERE regexp_matches(form, '^(10-K|10-Q|20-F|40-F)T?(/A)?$|^8-K$') GROUP BY cik) l USING (cik)
LEFT JOIN (SELECT cik, count(DISTINCT tag) FILTER (WHERE kp) AS kept, count(DISTINCT tag) FILTER (WHERE NOT kp) AS dropped FROM (
  SELECT cik, tag, tag IN ({names(T.keep_list())}) OR ns = 'dei' AS kp FROM raw WHERE ns IN ('us-gaap', 'dei')) GROUP BY cik) c USING (cik)"""
    out["note6_gaps"] = """
SELECT cik, "end", CAST(gap AS INTEGER) AS gap_before, CAST(CAST(floor(gap / 30.4 + 0.5) AS INTEGER) AS VARCHAR) || ' mo not covered' AS caption FROM periods WHERE gap > 0"""
    out["note7_card"] = """
SELECT l.cik, l."end", l.k, l.label, round(l.value, 6) AS value, s.thin, CASE WHEN l.mstat = 'currency-mismatch' THEN l.ccy END AS mismatch_ccy
FROM long l JOIN sheet0 s ON s.cik = l.cik AND s.basis = 'FY' AND s."end" = l."end"
WHERE l.basis = 'FY' AND l.section = 'ev' AND l.value IS NOT NULL AND l."end" = (SELECT max("end") FROM periods p WHERE p.cik = l.cik)"""
    out["cmp1_2_set"] = "SELECT set_id, ticker, cik, basis, \"end\", CAST(fy AS INTEGER) AS fy, stitched FROM chosen"
    out["cmp1_typed_set"] = """
SELECT set_id, ord, ticker, title, cik, used_cik, CAST(steps AS BIGINT) AS steps, known, has_periods FROM typed_members"""
    out["cmp3_metrics"] = "SELECT set_id, basis, ticker, CAST(row_ord AS INTEGER) AS row_ord, grp, k, label, round(value, 6) AS value FROM comp_rows"
    out["cmp4_median"] = "SELECT set_id, basis, k, count(value) AS n, round(median(value), 6) AS median FROM comp_rows WHERE med AND value IS NOT NULL GROUP BY ALL"
    out["cmp5_spread"] = """
SELECT set_id, basis, count(*) AS members, CAST(date_diff('day', min("end"), max("end")) AS INTEGER) AS spread_days FROM chosen GROUP BY ALL"""
    out["cmp6_gap_notes"] = """
SELECT c.set_id, c.ticker, l.status, string_agg(d.label, ', ' ORDER BY d.row_ord) AS metrics
FROM chosen c JOIN long l ON l.cik = c.cik AND l.basis = 'LTM' AND l."end" = c."end" JOIN comp_dim d ON d.k = l.k
WHERE c.basis = 'LTM' AND l.status IN ('no-interim', 'restated-basis') AND l.value IS NULL GROUP BY ALL"""
    same = "c.cik = r.cik AND c.basis = r.basis AND c.set_id = r.set_id AND c.ticker = r.ticker"
    out["cmp7_currency"] = f"""
SELECT r.set_id, r.basis, r.ticker, r.cik, r.k, r.value, c.ccy, d.dominant FROM comp_rows r JOIN chosen c ON {same} JOIN dom d ON d.set_id = r.set_id AND d.basis = r.basis
WHERE r.k IN ('revenue', 'ebitda', 'netIncome', 'netDebt') AND r.value IS NOT NULL AND d.mixed AND c.ccy <> d.dominant"""
    out["cmp8_thin"] = f"""
SELECT r.set_id, r.basis, r.ticker, r.cik, r.k, round(r.value, 6) AS value, round(abs(c.equity / c.totalAssets), 6) AS share
FROM comp_rows r JOIN chosen c ON {same} WHERE r.k IN ('roe', 'debtEquity', 'pb') AND r.value IS NOT NULL AND c.thin"""
    out["cmp9_carried"] = "SELECT set_id, ticker, cik, \"end\", CAST(fy AS INTEGER) AS fy FROM chosen WHERE basis = 'LTM' AND NOT stitched"
    out["cmp10_search"] = """
SELECT query_id, query, CAST(rank AS INTEGER) AS rank, cik, ticker, title FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cls, ord) AS rank FROM (
      SELECT u.query_id, u.query, t.cik, t.ticker, t.title, CAST(right(t.title, 9) AS BIGINT) AS ord,
        CASE WHEN t.ticker = u.s THEN 0 WHEN starts_with(t.ticker, u.s) OR starts_with(upper(t.title), u.s) THEN 1 WHEN contains(upper(t.title), u.s) THEN 2 END AS cls
      FROM ticker_list t, (SELECT query_id, query, upper(trim(query)) AS s FROM (
        SELECT c_custkey AS query_id, CASE WHEN c_custkey % 4 = 0 THEN ' supplier' || substr(c_name, 9) WHEN c_custkey % 4 = 1 THEN substr(c_name, 14)
          WHEN c_custkey % 4 = 2 THEN lower('S' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ'))
          WHEN c_custkey % 8 = 3 THEN right(c_name, 1) ELSE right(c_name, 2) END AS query FROM customer)) u) WHERE cls IS NOT NULL) WHERE rank <= 8"""
    cs = ", ".join(f"round(max(value) FILTER (WHERE pos = {i}), 6) AS c{i}" for i in range(1, 9))
    out["snk1_workbook"] = f"""
SELECT tab, cik, CAST(section_ord AS INTEGER) AS section_ord, section_title, CAST(line_ord AS INTEGER) AS line_ord, k, label, {cs} FROM (
  SELECT cik, "end", tab, section_ord, section_title, line_ord, k, label, value, how FROM long WHERE basis = 'FY' AND how <> 'manual' AND tab IS NOT NULL
  UNION ALL SELECT cik, "end", 'valuation', 1000, section_title, line_ord, k, label, value, how FROM long WHERE basis = 'FY' AND how <> 'manual'
    AND section = 'ev' AND cik IN (SELECT cik FROM sheet0 WHERE mstat IS NOT NULL)) JOIN positions USING (cik, "end") GROUP BY ALL"""
    out["snk1_header"] = """
SELECT p.cik, f.name, f.ticker AS tickers, 'c' || CAST(row_number() OVER (PARTITION BY p.cik ORDER BY p."end") AS VARCHAR) AS "column",
       'FY' || CAST(p.fy AS VARCHAR) AS year, p."end", y.ccy FROM periods p JOIN filers f USING (cik) LEFT JOIN ccys y USING (cik)"""
    pm = names(T.PERCENT_KEYS + T.MULTIPLE_KEYS)
    out["snk2_tab"] = f"""
SELECT tab, cik, CAST(section_ord AS INTEGER) AS section_ord, section_title, CAST(line_ord AS INTEGER) AS line_ord, k, label, {cs} FROM (
  SELECT * REPLACE (CASE WHEN k IN ({pm}) THEN value ELSE floor(value * 100 + 0.5) / 100 END AS value) FROM long
  WHERE basis = 'FY' AND how NOT IN ('manual', 'market') AND tab IS NOT NULL) JOIN positions USING (cik, "end")
GROUP BY tab, cik, section_ord, section_title, line_ord, k, label"""
    out["snk4_comps"] = """
SELECT r.set_id, r.basis, CAST(r.group_ord AS INTEGER) AS group_ord, r.grp, CAST(r.row_ord AS INTEGER) AS row_ord, r.k, r.label, r.ticker, r."end", round(r.value, 6) AS value,
  round(CASE WHEN r.med THEN median(r.value) OVER (PARTITION BY r.set_id, r.basis, r.k) END, 6) AS median
FROM comp_rows r WHERE NOT r.mk OR (r.set_id, r.basis) IN (SELECT (set_id, basis) FROM chosen WHERE mstat IS NOT NULL)"""
    return out
