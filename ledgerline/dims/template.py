"""The template as small Spark dimension tables.

Every table here has a size fixed by the template (a few hundred rows at
most), never by the data, which is why callers may broadcast it.
"""

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.dims.core import CORE_SECTIONS
from ledgerline.dims.overlays import OVERLAY_SECTIONS

INDUSTRIES = ("corporate", "bank", "pc", "life", "health", "advisory", "reit")

# The label used for a row that does not exist for an industry.
INDUSTRY_LABEL = {
    "bank": "bank", "pc": "P&C insurer", "life": "life insurer",
    "health": "health plan", "reit": "REIT", "advisory": "broker-dealer",
}

# Tags that date the fiscal calendar, after the revenue tags.
EXTRA_ANCHORS = {
    "bank": ("InterestAndDividendIncomeOperating", "InterestIncomeExpenseNet", "NoninterestIncome"),
    "pc": ("PremiumsEarnedNet", "BenefitsLossesAndExpenses"),
    "life": ("PremiumsEarnedNet", "BenefitsLossesAndExpenses"),
    "health": ("PremiumsEarnedNet",),
}
LAST_ANCHORS = ("NetIncomeLoss", "ProfitLoss")

# Tags kept at ingest although no line reads them.
KEPT_WITHOUT_LINE = (
    "DebtCurrent",
    "FinancingReceivableExcludingAccruedInterestBeforeAllowanceForCreditLoss",
    "LoansAndLeasesReceivableGrossCarryingAmount",
    "LongTermDebtAndCapitalLeaseObligationsCurrent",
)
COVER_SHARES = "dei:EntityCommonStockSharesOutstanding"

# Rows that do not exist for an industry.
_CARRIER = (
    "cogs", "grossProfit", "grossMargin", "inventory", "dso", "dio", "dpo", "ccc", "currentRatio", "quickRatio",
    "curAssets", "curLiab", "prepaid", "ap", "totalOpex", "ebit", "ebitda", "ebitdaSbc", "ebitMargin",
    "ebitdaMargin", "ebitdaGrowth", "netLev", "grossLev", "intCover", "fccr", "nwc", "nwcPctRev", "assetTurn",
    "capexPctRev", "ev", "evRev", "evEbitda", "evEbit", "evFcf", "ufcf", "nopat", "roic", "investedCap",
)
NOT_APPLICABLE = {
    "bank": [
        "cogs", "grossProfit", "inventory", "dio", "dpo", "ccc", "currentRatio", "quickRatio", "curAssets",
        "curLiab", "totalOpex", "ebit", "ebitda", "ebitdaSbc", "ebitMargin", "ebitdaMargin", "ebitdaGrowth",
        "netLev", "grossLev", "intCover", "fccr", "nwc", "nwcPctRev", "assetTurn", "capexPctRev", "prepaid", "ap",
        "evEbitda", "evEbit", "ufcf", "nopat", "roic", "investedCap",
    ],
    "pc": list(_CARRIER),
    "life": list(_CARRIER),
    "health": ["inventory", "dio", "ccc"],
    "advisory": ["inventory", "dio", "dpo", "ccc"],
    "reit": ["inventory", "dio", "dpo", "ccc"],
}

# Sections and single lines read at a date instead of over a span.
INSTANT_SECTIONS = ("bs", "debtlike", "dilution")

# How a key is displayed.
PERCENT_KEYS = (
    "grossMargin", "ebitdaMargin", "ebitMargin", "netMargin", "fcfMargin", "taxRate", "cashTaxRate", "revGrowth",
    "ebitdaGrowth", "epsGrowth", "revCagr3", "revCagr5", "roic", "roe", "roa", "nwcPctRev", "capexPctRev",
    "daPctRev", "sbcPctRev", "fcfConv", "debtCap", "fcfYield", "divYield", "premium1d", "efficiency", "niiOnAssets",
    "allowanceToLoans", "provisionToLoans", "depositsToAssets", "equityToAssets", "lossRatio", "expenseRatio",
    "combinedRatio", "pyDevRatio", "cededRatio", "investmentYield", "benefitRatio", "creditingRate", "mlr",
    "healthSgaRatio", "premiumMix", "ffoPayout", "noiMargin", "accumDepPct", "debtToGrossRE", "compRatio",
    "pretaxMargin", "rote",
)
MULTIPLE_KEYS = (
    "netLev", "grossLev", "intCover", "fccr", "debtEquity", "currentRatio", "quickRatio", "assetTurn", "evRev",
    "evEbitda", "evEbit", "evFcf", "pe", "pb", "loansToDeposits", "premiumLeverage", "reserveLeverage",
)
DAY_KEYS = "dso dio dpo ccc daysClaimsPayable".split()

# Comparables rows (group, key, label) and where a median means something.
COMPS_ROWS = (
    ("Scale", "revenue", "Revenue"),
    ("Scale", "ebitda", "EBITDA"),
    ("Scale", "netIncome", "Net income"),
    ("Scale", "mktCap", "Market cap"),
    ("Scale", "ev", "Enterprise value"),
    ("Growth & margin", "revGrowth", "Revenue growth"),
    ("Growth & margin", "revCagr3", "Revenue CAGR, 3yr"),
    ("Growth & margin", "grossMargin", "Gross margin"),
    ("Growth & margin", "ebitdaMargin", "EBITDA margin"),
    ("Growth & margin", "ebitMargin", "EBIT margin"),
    ("Growth & margin", "netMargin", "Net margin"),
    ("Growth & margin", "fcfMargin", "FCF margin"),
    ("Returns & leverage", "roic", "ROIC"),
    ("Returns & leverage", "roe", "ROE"),
    ("Returns & leverage", "netDebt", "Net debt"),
    ("Returns & leverage", "netLev", "Net debt / EBITDA"),
    ("Returns & leverage", "intCover", "EBITDA / interest"),
    ("Valuation", "evRev", "EV / Revenue"),
    ("Valuation", "evEbitda", "EV / EBITDA"),
    ("Valuation", "evEbit", "EV / EBIT"),
    ("Valuation", "pe", "P / E"),
    ("Valuation", "fcfYield", "FCF yield"),
    ("Valuation", "divYield", "Dividend yield"),
)
COMPS_MARKET = ("mktCap", "ev", "evRev", "evEbitda", "evEbit", "pe", "fcfYield", "divYield")
COMPS_NO_MEDIAN = ("revenue", "ebitda", "netIncome", "mktCap", "ev", "netDebt")
EQUITY_KEYS = ("roe", "debtEquity", "pb")
CURRENCY_KEYS = ("revenue", "ebitda", "netIncome", "netDebt")
MARKET_KEYS = ("price", "mktCap", "ev", "evRev", "evEbitda", "evEbit", "evFcf", "pe", "pb", "fcfYield", "divYield")

REVENUE_TAGS = CORE_SECTIONS[0].lines[0].tags


def sections_for(industry: str) -> list:
    """Core sections with an industry's own sections put in their place."""
    out = list(CORE_SECTIONS)
    for extra in OVERLAY_SECTIONS.get(industry, ()):
        ids = [s.id for s in out]
        if extra.after:
            at = ids.index(extra.after) + 1 if extra.after in ids else len(out)
        else:
            anchor = "margins" if extra.tab == "ratios" else "sh"
            at = ids.index(anchor) if anchor in ids else len(out)
        out.insert(at, extra)
    return out


def is_instant(sec, line) -> bool:
    return line.instant or sec.instant or sec.id in INSTANT_SECTIONS


def anchors_for(industry: str) -> list:
    """(tag, first position, times listed) of the calendar anchors of an industry."""
    tags = [*REVENUE_TAGS, *EXTRA_ANCHORS.get(industry, ()), *LAST_ANCHORS]
    return [(t, tags.index(t), tags.count(t)) for t in dict.fromkeys(tags)]


@lru_cache(maxsize=1)
def template_rows() -> tuple:
    """One tuple per (industry, line) in sheet order.

    A key declared twice for one industry keeps its last declaration, the way
    a later row overwrites an earlier one on the sheet.
    """
    rows = []
    for industry in INDUSTRIES:
        by_key = {}
        for so, sec in enumerate(sections_for(industry)):
            for lo, line in enumerate(sec.lines):
                by_key[line.key] = (
                    industry, so, sec.id, sec.title, sec.tab, sec.kind, lo, line.key, line.label, line.how,
                    is_instant(sec, line), line.latest, line.prefer_nonzero, line.pinned,
                    [t for t in line.tags if t not in line.omit.get(industry, ())],
                )
        rows.extend(by_key.values())
    return tuple(rows)


_LINE_SCHEMA = (
    "industry string, section_ord int, section string, section_title string, tab string, kind string, "
    "line_ord int, k string, label string, how string, is_instant boolean, latest boolean, "
    "prefer_nonzero boolean, pinned boolean, tags array<string>"
)


def template_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(template_rows()), _LINE_SCHEMA)


def line_tags(spark: SparkSession) -> DataFrame:
    """(industry, k, tag, tag_ord) of every fetched line, omissions already applied."""
    return (
        template_lines(spark)
        .where("how = 'fetched'")
        .select("industry", "k", "is_instant", "latest", "prefer_nonzero", "pinned",
                F.posexplode("tags").alias("tag_ord", "tag"))
    )


def period_tags(spark: SparkSession) -> DataFrame:
    rows = [(i, t, o, n) for i in INDUSTRIES for t, o, n in anchors_for(i)]
    return spark.createDataFrame(rows, "industry string, tag string, tag_ord int, times int")


def anchor_tags() -> list:
    return sorted({t for i in INDUSTRIES for t, _, _ in anchors_for(i)})


def not_applicable(spark: SparkSession) -> DataFrame:
    rows = [(i, k) for i, ks in NOT_APPLICABLE.items() for k in ks]
    return spark.createDataFrame(rows, "industry string, k string")


def fetched_keys() -> list:
    return list(dict.fromkeys(r[7] for r in template_rows() if r[9] == "fetched" and r[14]))


def keep_list() -> list:
    """Every tag a line or a calendar reads, plus the few kept for other readers."""
    tags = {t for r in template_rows() for t in r[14]} | set(anchor_tags()) | set(KEPT_WITHOUT_LINE)
    tags |= set(REVENUE_TAGS)
    return sorted(t for t in tags if not t.startswith("dei:"))


def line_format(spark: SparkSession) -> DataFrame:
    rows = [(k, "percent") for k in PERCENT_KEYS] + [(k, "multiple") for k in MULTIPLE_KEYS]
    rows += [(k, "days") for k in DAY_KEYS]
    return spark.createDataFrame(rows, "k string, style string")


def comps_rows(spark: SparkSession) -> DataFrame:
    groups = list(dict.fromkeys(g for g, _, _ in COMPS_ROWS))
    rows = [(i, groups.index(g), g, k, label, k in COMPS_MARKET, k not in COMPS_NO_MEDIAN)
            for i, (g, k, label) in enumerate(COMPS_ROWS)]
    return spark.createDataFrame(
        rows, "row_ord int, group_ord int, grp string, k string, label string, is_market boolean, has_median boolean")
