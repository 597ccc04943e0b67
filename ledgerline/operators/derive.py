"""Computed lines: plain SQL expressions on the wide sheet, in dependency order.

Each entry reads the columns as they stand when its turn comes, so an entry may
read the fetched value of a key that a later entry overwrites.  Entries are
packed into as few projections as that order allows.
"""

import re

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.dims import template as T


def _sum(*keys):
    parts = " + ".join(f"coalesce({k}, 0D)" for k in keys)
    return f"CASE WHEN coalesce({', '.join(keys)}) IS NOT NULL THEN {parts} END"


def _div(a, b):
    return f"try_divide({a}, {b})"


_CORP_DEBT = (
    "CASE WHEN ltdCur IS NOT NULL AND ltDebt IS NULL THEN NULL "
    "WHEN coalesce(IF(stDebtIsLtdCur, NULL, stDebt), IF(ltdCurInLtDebt, NULL, ltdCur), ltDebt) IS NOT NULL THEN "
    "coalesce(IF(stDebtIsLtdCur, NULL, stDebt), 0D) + coalesce(IF(ltdCurInLtDebt, NULL, ltdCur), 0D) "
    "+ coalesce(ltDebt, 0D) END"
)


def _total_debt(total):
    return f"coalesce(CASE WHEN ltDebt IS NULL OR {total} >= ltDebt THEN {total} END, {_CORP_DEBT})"


_TANGIBLE = "equity - coalesce(goodwill, 0D) - coalesce(intangibles, 0D)"
_LOSSES = "lossesIncurred + coalesce(lifeBenefits, 0D)"
_RESIDUAL = "nciBs IS NULL AND equityIsParent AND equityAll <> equity"
_FFO = (
    "CASE WHEN gainOnPropertySale IS NULL AND niToCommon > ebit THEN NULL "
    "ELSE niToCommon + da - coalesce(gainOnPropertySale, 0D) + coalesce(reImpairment, 0D) END"
)

# The definitions of the computed lines, here and in INDUSTRY below.
# (key, expression) in the order they are evaluated; revenue keeps the first slot.
CORE = (
    ("revenue", "NULL"),
    ("netIncome", "CASE WHEN netIncome < niToCommon THEN niToCommon END"),
    ("nciDerived", f"CASE WHEN {_RESIDUAL} THEN 1D END"),
    ("nciBs", f"CASE WHEN {_RESIDUAL} THEN equityAll - equity END"),
    ("ebitda", "ebit + coalesce(da, 0D)"),
    ("ebitdaSbc", "ebitda - coalesce(sbc, 0D)"),
    ("grossProfit", "CASE WHEN grossProfit IS NULL THEN revenue - cogs END"),
    ("grossMargin", _div("grossProfit", "revenue")),
    ("ebitdaMargin", _div("ebitda", "revenue")),
    ("ebitMargin", _div("ebit", "revenue")),
    ("netMargin", _div("netIncome", "revenue")),
    ("fcf", "cfo - coalesce(capex, 0D)"),
    ("fcfMargin", _div("fcf", "revenue")),
    ("fcfConv", _div("fcf", "netIncome")),
    ("taxRate", _div("tax", "pretax")),
    ("totalDebt", _total_debt("debtAllIn")),
    ("debtLikeTotal", _sum("olCur", "olNon", "flCur", "flNon", "pensionUnderfunded", "deferredComp", "assetRetirement")),
    ("totalDebtLeases", _sum("totalDebt", "olCur", "olNon", "flCur", "flNon")),
    ("netDebt", "totalDebt - coalesce(cash, 0D) - coalesce(sti, 0D)"),
    ("netLev", _div("netDebt", "ebitda")),
    ("grossLev", _div("totalDebt", "ebitda")),
    ("intCover", _div("ebitda", "intExp")),
    ("fccr", _div("ebitda - coalesce(capex, 0D)", "intExp")),
    ("debtEquity", _div("totalDebt", "equity")),
    ("debtCap", _div("totalDebt", _sum("totalDebt", "equity"))),
    ("currentRatio", _div("curAssets", "curLiab")),
    ("quickRatio", _div("curAssets - coalesce(inventory, 0D)", "curLiab")),
    ("nopat", "ebit * (1 - taxRate)"),
    ("investedCap", "totalDebt + coalesce(equity, 0D) - coalesce(cash, 0D)"),
    ("roic", _div("nopat", "investedCap")),
    ("roe", _div("netIncome", "equity")),
    ("roa", _div("netIncome", "totalAssets")),
    ("assetTurn", _div("revenue", "totalAssets")),
    ("dso", f"{_div('ar', 'revenue')} * 365"),
    ("dio", f"{_div('inventory', 'cogs')} * 365"),
    ("dpo", f"{_div('ap', 'cogs')} * 365"),
    ("ccc", "dso + coalesce(dio, 0D) - coalesce(dpo, 0D)"),
    ("nwc", "(curAssets - coalesce(cash, 0D) - coalesce(sti, 0D)) - (curLiab - coalesce(stDebt, 0D) - coalesce(ltdCur, 0D))"),
    ("nwcPctRev", _div("nwc", "revenue")),
    ("capexPctRev", _div("capex", "revenue")),
    ("daPctRev", _div("da", "revenue")),
    ("sbcPctRev", _div("sbc", "revenue")),
    ("bvps", _div("equity", "sharesOut")),
    ("tbvps", _div(_TANGIBLE, "sharesOut")),
    ("ufcf", "nopat + coalesce(da, 0D) - coalesce(capex, 0D)"),
    ("cashTaxRate", _div("tax - coalesce(deferredTax, 0D)", "pretax")),
)

INDUSTRY = {
    "bank": (
        ("nii", "coalesce(nii, intIncTotal - coalesce(intExpTotal, 0D))"),
        ("revenue", f"CASE WHEN revenue IS NULL THEN {_sum('nii', 'noninterestIncome')} END"),
        ("totalRevenueBank", _sum("nii", "noninterestIncome")),
        ("efficiency", _div("noninterestExpense", _sum("nii", "noninterestIncome"))),
        ("niiOnAssets", _div("nii", "totalAssets")),
        ("loansToDeposits", _div("loans", "deposits")),
        ("loansGross", _sum("loans", "allowance")),
        ("allowanceToLoans", _div("allowance", _sum("loans", "allowance"))),
        ("provisionToLoans", _div("provision", _sum("loans", "allowance"))),
        ("depositsToAssets", _div("deposits", "totalAssets")),
        ("equityToAssets", _div("equity", "totalAssets")),
    ),
    "pc": (
        ("lossesTotal", _LOSSES),
        ("lossRatio", _div(_LOSSES, "npe")),
        ("expenseRatio", _div("dacAmort + otherUwExp", "npe")),
        ("combinedRatio", _div(f"({_LOSSES}) + dacAmort + otherUwExp", "npe")),
        ("uwProfit", f"npe - ({_LOSSES}) - dacAmort - otherUwExp"),
        ("pyDevRatio", _div("pyDevelopment", "npe")),
        ("float", "coalesce(lossReservesNet, lossReserves - reinsRecov) + unearnedPrem - coalesce(dac, 0D)"),
        ("premiumLeverage", _div("npw", "equity")),
        ("reserveLeverage", _div("lossReserves", "equity")),
        ("cededRatio", _div("cededPrem", "cededPrem + npe")),
        ("investmentYield", _div("invIncome", "investments")),
    ),
    "life": (
        ("benefitRatio", _div("benefits", "premiums")),
        ("creditingRate", _div("interestCredited", "policyholderAccounts")),
        ("investmentYield", _div("invIncome", "investments")),
        ("policyReserves", _sum("futurePolicyBenefits", "policyholderAccounts")),
        ("reserveLeverage", _div(_sum("futurePolicyBenefits", "policyholderAccounts"), "equity")),
        ("bvpsExAoci", _div("equity - coalesce(aoci, 0D)", "sharesOut")),
    ),
    "health": (
        ("mlr", _div("medicalCosts", "premiums")),
        ("healthSgaRatio", _div("sga", "revenue")),
        ("daysClaimsPayable", f"{_div('medicalClaimsPayable', 'medicalCosts')} * 365"),
        ("premiumMix", _div("premiums", "revenue")),
    ),
    "advisory": (
        ("compRatio", _div("compExpense", "revenue")),
        ("pretaxMargin", _div("pretax", "revenue")),
        ("tangibleEquity", _TANGIBLE),
        ("rote", _div("netIncome", _TANGIBLE)),
    ),
    "reit": (
        ("totalDebt", _total_debt("reitDebt")),
        ("noi", "rentalRevenue - propOpex"),
        ("noiMargin", _div("rentalRevenue - propOpex", "rentalRevenue")),
        ("ffo", _FFO),
        ("ffoPerShare", _div(_FFO, "wasoDil")),
        ("ffoPayout", _div("dividends", _FFO)),
        ("reNet", "reGross - reAccumDep"),
        ("debtToGrossRE", _div("totalDebt", "reGross")),
        ("accumDepPct", _div("reAccumDep", "reGross")),
    ),
}
YEAR_OVER_YEAR = (("revGrowth", "revenue"), ("ebitdaGrowth", "ebitda"), ("epsGrowth", "epsDil"))
COMPOUND = (("revCagr3", "revenue", 3), ("revCagr5", "revenue", 5))
FLAGS = ("ltdCurInLtDebt", "stDebtIsLtdCur", "equityThin", "equityIsParent", "grossProfitDerived", "nciDerived")


def derivation_order(industry: str) -> list:
    """Core entries with the industry's overrides in their slots, new keys after them."""
    own = dict(INDUSTRY.get(industry, ()))
    merged = [(k, own.pop(k, e)) for k, e in CORE]
    return merged + [(k, e) for k, e in INDUSTRY.get(industry, ()) if k in own]


def derived_keys() -> list:
    keys = [k for k, _ in CORE] + [k for es in INDUSTRY.values() for k, _ in es]
    return [k for k in dict.fromkeys(keys) if k != "nciDerived"]


def computed_for(industry: str) -> list:
    return [k for k, e in derivation_order(industry) if e != "NULL" and k != "nciDerived"]


def _by_industry() -> list:
    """(key, {expression: industries}) in one order that suits every industry."""
    keys = [k for k, _ in CORE] + [k for i in INDUSTRY for k, _ in INDUSTRY[i] if k not in dict(CORE)]
    out = []
    for k in dict.fromkeys(keys):
        exprs = {}
        for i in T.INDUSTRIES:
            e = dict(derivation_order(i)).get(k, "NULL")
            exprs.setdefault(e, []).append(i)
        out.append((k, exprs))
    return out


def _combined(exprs: dict) -> str:
    if len(exprs) == 1:
        return next(iter(exprs))
    whens = " ".join(
        f"WHEN industry IN ({', '.join(repr(i) for i in inds)}) THEN {e}" for e, inds in exprs.items() if e != "NULL")
    return f"CASE {whens} END"


def _levels() -> list:
    """Group entries into projections: a reader follows the last writer before it, a
    writer never precedes an earlier reader of the old value."""
    written, read_at, levels = {}, {}, []
    for k, exprs in _by_industry():
        e = _combined(exprs)
        names = set(re.findall(r"[A-Za-z_]\w*", e))
        level = max([written[n] + 1 for n in names if n in written] + [written.get(k, -1) + 1, read_at.get(k, 0), 0])
        for n in names:
            read_at[n] = max(read_at.get(n, 0), level)
        written[k] = level
        while len(levels) <= level:
            levels.append([])
        levels[level].append((k, e))
    return levels


def equity_and_debt_flags(sheet: DataFrame, scope: DataFrame) -> DataFrame:
    """Flags that the computed lines read: debt scope, duplicate debt, thin and parent equity.

    ``sheet`` carries the tags that resolved equity and long-term debt.
    """
    s = sheet.join(scope.select("cik", F.col("tag").alias("ltDebt_tag"), "scope"), ["cik", "ltDebt_tag"], "left")
    return s.withColumns({
        "ltdCurInLtDebt": F.coalesce(F.col("scope") == "includes", F.lit(False)),
        "stDebtIsLtdCur": F.coalesce((F.col("stDebt") == F.col("ltdCur")) & (F.col("stDebt") != 0), F.lit(False)),
        "equityThin": F.coalesce(F.abs(F.try_divide(F.abs("equity"), F.abs("totalAssets"))) < 0.02, F.lit(False)),
        "equityIsParent": F.coalesce(F.col("equity_tag") == "StockholdersEquity", F.lit(False)),
        "grossProfitFetched": F.col("grossProfit").isNotNull(),
    }).drop("scope")


def derive(sheet: DataFrame) -> DataFrame:
    """All computed lines; a null result keeps a fetched value."""
    have = set(sheet.columns)
    for level in _levels():
        new = {}
        for k, e in level:
            if e == "NULL":
                continue
            new[k] = F.coalesce(F.expr(f"cast({e} as double)"), F.col(k)) if k in have else F.expr(f"cast({e} as double)")
        if new:
            sheet = sheet.withColumns(new)
            have |= set(new)
    return sheet.withColumn("nciDerived", F.col("nciDerived").isNotNull())


def blank_not_applicable(sheet: DataFrame) -> DataFrame:
    """Null the rows that do not exist for an industry; runs after the computed lines."""
    where = {}
    for industry, keys in T.NOT_APPLICABLE.items():
        for k in keys:
            where.setdefault(k, []).append(industry)
    have = set(sheet.columns)
    return sheet.withColumns({
        k: F.when(~F.col("industry").isin(inds), F.col(k)) for k, inds in where.items() if k in have})


def flag_gross_profit(sheet: DataFrame) -> DataFrame:
    return sheet.withColumn("grossProfitDerived", F.col("grossProfit").isNotNull() & ~F.col("grossProfitFetched")).drop(
        "grossProfitFetched")


def cross_column(sheet: DataFrame) -> DataFrame:
    """Growth over neighbouring columns; a gap in the calendar refuses the comparison.

    The window holds one filer's columns of one basis: at most eight rows.
    """
    w = Window.partitionBy("cik", "basis").orderBy("end")
    new = {}
    for k, src in YEAR_OVER_YEAR:
        prev = F.lag(src, 1).over(w)
        new[k] = F.when((F.col("gap_before") == 0) & (prev != 0), F.col(src) / prev - 1)
    for k, src, n in COMPOUND:
        prev = F.lag(src, n).over(w)
        gaps = F.max("gap_before").over(w.rowsBetween(-(n - 1), 0))
        new[k] = F.when((gaps == 0) & (F.col(src) > 0) & (prev > 0), F.pow(F.col(src) / prev, F.lit(1.0 / n)) - 1)
    return sheet.withColumns(new)


def extension_lines(sheet: DataFrame) -> DataFrame:
    """Declared lines that are blank by default, computed on request.

    ``premium1d`` stays null: both its inputs are judgements.
    """
    w = Window.partitionBy("cik", "basis").orderBy("end")
    tsm = F.expr("sharesOut + coalesce(optionsOut, 0D) - coalesce(try_divide(optionsOut * optionsStrike, price), 0D) "
                 "+ coalesce(rsuOut, 0D)")
    ltm = lambda c: F.when(F.col("basis") == "LTM", F.col(c))
    return sheet.withColumns({
        "chgNwc": F.when(F.col("gap_before") == 0, F.col("nwc") - F.lag("nwc").over(w)),
        "netDebtBridge": F.col("netDebt"), "entryNetDebt": F.col("netDebt"),
        "ltmEbitda": ltm("ebitda"), "ltmRevenue": ltm("revenue"),
        "treasuryMethod": F.when(F.col("price").isNotNull(), tsm), "premium1d": F.lit(None).cast("double")})
