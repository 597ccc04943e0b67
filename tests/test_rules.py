"""One hand-built filer per rule; the sheet is built once and every case reads its own rows."""

import datetime as dt

import pytest

from ledgerline.plans.sheet import SheetPlan
from tests.conftest import Book

REV = "Revenues"


def book():
    b = Book()
    # 1 quarter, nine months and year with one end
    b.fact(1, REV, "2023-10-02", "2023-12-31", 90)
    b.fact(1, REV, "2023-04-02", "2023-12-31", 270)
    b.year(1, REV, 2023, 365)
    # 2 restated comparative
    for f, v in (("2022-02-15", 10), ("2023-02-15", 11), ("2024-02-15", 12)):
        b.year(2, REV, 2021, v, filed=f)
    # 3 same-day tie: the 10-K wins over a 10-Q that comes first
    b.year(3, REV, 2023, 1, form="10-Q")
    b.year(3, REV, 2023, 2, form="10-K")
    # 4 proxy statement filed later
    b.year(4, REV, 2023, 100)
    b.year(4, "NetIncomeLoss", 2023, -70)
    b.year(4, "NetIncomeLoss", 2023, -69680, form="DEF 14A", filed="2024-04-30")
    # 5 no periodic annual period
    b.fact(5, REV, "2023-01-01", "2023-11-08", 5, form="20-F")
    b.fact(5, REV, "2023-01-02", "2023-12-31", 6, form="DEF 14A")
    # 6 scale slip, 7 corroborated amendment, 8 genuine restatement
    for cik, amended, extra in ((6, 1.62e12, ()), (7, 1.62e12, (1.62e12, 1.62e12)), (8, 1.9e6, ())):
        for i in range(3):
            b.year(cik, REV, 2020, 1.62e6, filed=f"202{1 + i}-02-15")
        for i, v in enumerate(extra):
            b.year(cik, REV, 2020, v, filed=f"202{1 + i}-03-15")
        b.year(cik, REV, 2020, amended, form="10-K/A", filed="2024-06-01")
    # 9 two currencies for one instant, the foreign one first in the document
    b.year(9, REV, 2023, 50, unit="USD", unit_ord=1)
    b.at(9, "Assets", 2023, 948.2, unit="JPY", unit_ord=0)
    b.at(9, "Assets", 2023, 6.3, unit="USD", unit_ord=1)
    # 10 the filer changed its currency; 11 convenience translation loses to the original
    for y in range(2016, 2022):
        b.year(10, REV, y, y, unit="USD", unit_ord=1)
    b.year(10, REV, 2022, 7, unit="CAD")
    b.year(11, REV, 2023, 700, unit="CNY", unit_ord=1)
    b.year(11, REV, 2023, 100, unit="USD", unit_ord=0)
    # 12 line only in another currency
    b.year(12, REV, 2023, 700, unit="CNY")
    b.year(12, "InterestExpense", 2023, 3, unit="USD")
    b.year(12, "InterestExpense", 2022, 4, unit="CNY")
    # 13 zero displaced, zero kept, all zero
    b.year(13, REV, 2023, 1)
    b.year(13, "GoodwillImpairmentLoss", 2023, 0)
    b.year(13, "AssetImpairmentCharges", 2023, 1915)
    b.at(13, "LongTermDebtNoncurrent", 2023, 0)
    b.at(13, "LongTermDebt", 2023, 15.2e9)
    b.at(13, "ShortTermBorrowings", 2023, 0)
    b.at(13, "CommercialPaper", 2023, 0)
    # 14 a tag used once does not set the calendar
    b.year(14, "RevenueFromContractWithCustomerExcludingAssessedTax", 2018, 1)
    for y in range(2014, 2022):
        b.year(14, "NetIncomeLoss", y, y)
    # 15 two calendars under one tag, 16 year-end drift, 17 gap
    for y in (2022, 2023):
        b.year(15, REV, y, y)
    for y in (2021, 2022):
        b.fact(15, REV, f"{y}-04-01", f"{y + 1}-03-31", y, filed=f"{y + 1}-06-01")
    for s, e in (("2021-01-04", "2022-01-02"), ("2022-01-03", "2023-01-01"), ("2023-01-02", "2023-12-31")):
        b.fact(16, REV, s, e, 5)
    b.fact(17, REV, "2021-10-01", "2022-09-30", 100, filed="2022-11-15")
    b.year(17, REV, 2023, 150)
    # 18 CAGR needs positive ends
    for y, v in zip(range(2020, 2024), (-5, 1, 2, 5)):
        b.year(18, REV, y, v)
    # 19 component first: the longer run wins in every column
    for y in range(2016, 2024):
        b.year(19, REV, y, 1000)
        b.year(19, "CostOfRevenue", y, 600)
        if y > 2019:
            b.year(19, "CostOfGoodsAndServicesSold", y, 1)
    # 20 identity beats run
    for y in range(2020, 2024):
        b.year(20, REV, y, 50.1e6)
        b.year(20, "CostOfGoodsAndServicesSold", y, 0.1e6)
    b.year(20, "CostOfRevenue", 2023, 43.6e6)
    b.year(20, "GrossProfit", 2023, 6.5e6)
    # 21 debt scope includes, 22 excludes
    for cik, t in ((21, 120.0), (22, 100.2)):
        for y in (2022, 2023):
            b.year(cik, REV, y, 1)
            b.at(cik, "LongTermDebt", y, t)
            b.at(cik, "LongTermDebtCurrent", y, 20)
        b.at(cik, "LongTermDebtNoncurrent", 2022, 100)
    # 23 duplicate current debt, 24 lone current portion, 25 partial all-in total of a REIT
    b.year(23, REV, 2023, 1)
    b.at(23, "ShortTermBorrowings", 2023, 3402)
    b.at(23, "LongTermDebtCurrent", 2023, 3402)
    b.at(23, "LongTermDebtNoncurrent", 2023, 10000)
    b.year(24, REV, 2023, 1)
    b.at(24, "LongTermDebtCurrent", 2023, 1.3e9)
    b.filer(25, "6798")
    b.year(25, REV, 2023, 1)
    b.at(25, "NotesPayable", 2023, 414)
    b.at(25, "LongTermDebt", 2023, 2470)
    # 26 no EBIT, 27 derived NCI, 28 net income repair, 29 thin equity
    b.year(26, REV, 2023, 1)
    b.year(26, "DepreciationDepletionAndAmortization", 2023, 4)
    b.year(27, REV, 2023, 1)
    b.at(27, "StockholdersEquity", 2023, 1000)
    b.at(27, "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", 2023, 1389.427)
    b.year(28, REV, 2023, 1)
    b.year(28, "NetIncomeLoss", 2023, 8.85e6)
    b.year(28, "NetIncomeLossAvailableToCommonStockholdersBasic", 2023, 8.4e9)
    b.year(29, REV, 2023, 1)
    b.year(29, "NetIncomeLoss", 2023, 27)
    b.at(29, "StockholdersEquity", 2023, 54)
    b.at(29, "Assets", 2023, 16363)
    # 30 bank without a revenue tag; gross interest income does not become revenue
    b.filer(30, "6021")
    b.year(30, "InterestAndDividendIncomeOperating", 2023, 500)
    b.year(30, "InterestIncomeExpenseNet", 2023, 300)
    b.year(30, "NoninterestIncome", 2023, 100)
    # 31 combined ratio needs every input, 32 has them all
    for cik in (31, 32):
        b.filer(cik, "6331")
        b.year(cik, "PremiumsEarnedNet", 2023, 53.0)
        b.year(cik, "PolicyholderBenefitsAndClaimsIncurredNet", 2023, 26.7)
        b.year(cik, "LiabilityForFuturePolicyBenefitsPeriodExpense", 2023, 5.5)
        b.year(cik, "DeferredPolicyAcquisitionCostAmortizationExpense", 2023, 9.0)
    b.year(32, "OtherUnderwritingExpense", 2023, 4.0)
    # 33 FFO blank without a gain tag when income to common exceeds EBIT
    b.filer(33, "6798")
    b.year(33, REV, 2023, 100)
    b.year(33, "OperatingIncomeLoss", 2023, 10)
    b.year(33, "NetIncomeLossAvailableToCommonStockholdersBasic", 2023, 20)
    b.year(33, "DepreciationDepletionAndAmortization", 2023, 5)
    # LTM cases: year 2023, first half of 2024 and of 2023
    def halves(cik, tag, cur, prior, prior_filed="2023-08-01"):
        b.fact(cik, tag, "2024-01-01", "2024-06-30", cur, form="10-Q", filed="2024-08-01")
        b.fact(cik, tag, "2023-01-01", "2023-06-30", prior, form="10-Q", filed=prior_filed)
    for cik in (40, 41, 42, 43):
        b.year(cik, REV, 2022, 800, accn=f"{cik}-fy22", filed="2023-02-15")
        b.year(cik, REV, 2023, 1000, accn=f"{cik}-fy23")
    halves(40, REV, 600, 450)
    b.fact(40, REV, "2024-04-01", "2024-06-30", 310, form="10-Q", filed="2024-08-01")
    halves(41, "RevenueFromContractWithCustomerExcludingAssessedTax", 600, 450)
    for cik in (42, 43):
        halves(cik, REV, 600, 450)
        b.fact(cik, REV, "2023-01-01", "2023-06-30", 400, form="10-Q", filed="2024-08-01")
    b.year(43, REV, 2022, 700, accn="43-fy23", filed="2024-02-15")
    # 44 nothing filed since the year end
    b.year(44, REV, 2022, 5)
    b.year(44, REV, 2023, 6)
    # 45 stale filer is in test_calendar; 46 foreign filer with a dollar quote, 47 priced carrier
    b.year(46, REV, 2023, 100, unit="EUR")
    b.filer(47, "6331")
    b.year(47, REV, 2023, 100)
    for cik in (46, 47):
        b.fact(cik, "EntityCommonStockSharesOutstanding", None, "2024-01-31", 10, unit="shares")
        b.at(cik, "LongTermDebtNoncurrent", 2023, 50, unit="EUR" if cik == 46 else "USD")
    return b


@pytest.fixture(scope="module")
def plan(spark):
    b = book()
    facts, filers = b.frames(spark)
    at = dt.datetime(2024, 9, 1)
    quotes = spark.createDataFrame([("ABC", 3.0, at)], "symbol string, price double, at timestamp")
    p = SheetPlan(facts, filers.withColumn("tickers", __import__("pyspark").sql.functions.expr(
        "IF(cik IN (46, 47), array('abc'), array('none'))")), quotes)
    return p


@pytest.fixture(scope="module")
def sheet(plan):
    out = {}
    for r in plan.sheet.collect():
        out.setdefault((r["cik"], r["basis"]), []).append(r.asDict())
    for rows in out.values():
        rows.sort(key=lambda r: r["end"])
    return out


@pytest.fixture(scope="module")
def cells(plan):
    return {(r["cik"], r["basis"], r["end"].year, r["k"]): r for r in plan.cells.collect()}


def newest(sheet, cik, basis="FY"):
    return sheet[(cik, basis)][-1]


def test_shapes_and_versions(sheet):
    assert newest(sheet, 1)["revenue"] == 365
    assert newest(sheet, 2)["revenue"] == 12
    assert newest(sheet, 3)["revenue"] == 2
    assert newest(sheet, 4)["netIncome"] == -70
    assert (5, "FY") not in sheet


def test_amendments(sheet):
    assert newest(sheet, 6)["revenue"] == 1.62e6
    assert newest(sheet, 7)["revenue"] == 1.62e12
    assert newest(sheet, 8)["revenue"] == 1.9e6


def test_currencies(sheet, cells):
    assert newest(sheet, 9)["totalAssets"] == 6.3
    assert newest(sheet, 10)["ccy"] == "CAD"
    assert newest(sheet, 11)["ccy"] == "CNY"
    c = cells[(12, "FY", 2023, "intExp")]
    assert (c["value"], c["status"], c["ccy"]) == (None, "other-currency", "USD")
    assert cells[(12, "FY", 2023, "tax")]["status"] == "never-tagged"
    assert cells[(20, "FY", 2021, "grossProfit")]["status"] == "untagged-this-period"


def test_zeroes(sheet, cells):
    r = newest(sheet, 13)
    assert (r["impairment"], r["ltDebt"], r["stDebt"]) == (1915, 0, 0)
    assert cells[(13, "FY", 2023, "stDebt")]["tag"] == "ShortTermBorrowings"


def test_calendars(sheet):
    assert len(sheet[(14, "FY")]) == 8
    assert [str(r["end"]) for r in sheet[(15, "FY")]] == ["2022-12-31", "2023-12-31"]
    assert [r["fy"] for r in sheet[(16, "FY")]] == [2021, 2022, 2023]
    last = newest(sheet, 17)
    assert last["gap_before"] == 93 and last["revGrowth"] is None
    assert newest(sheet, 18)["revCagr3"] is None and newest(sheet, 18)["revGrowth"] == 1.5


def test_pins(sheet):
    assert {r["cogs"] for r in sheet[(19, "FY")]} == {600}
    assert newest(sheet, 20)["cogs"] == 43.6e6


def test_debt(sheet):
    assert newest(sheet, 21)["totalDebt"] == 120 and newest(sheet, 21)["ltdCurInLtDebt"]
    assert newest(sheet, 22)["totalDebt"] == 120.2 and not newest(sheet, 22)["ltdCurInLtDebt"]
    assert newest(sheet, 23)["totalDebt"] == 13402 and newest(sheet, 23)["stDebtIsLtdCur"]
    assert newest(sheet, 24)["totalDebt"] is None
    assert newest(sheet, 25)["totalDebt"] == 2470


def test_derived(sheet):
    assert newest(sheet, 26)["ebitda"] is None
    assert newest(sheet, 27)["nciBs"] == pytest.approx(389.427) and newest(sheet, 27)["nciDerived"]
    assert newest(sheet, 28)["netIncome"] == 8.4e9
    assert newest(sheet, 29)["equityThin"] and newest(sheet, 29)["roe"] == 0.5
    assert newest(sheet, 30)["revenue"] == 400
    assert newest(sheet, 31)["combinedRatio"] is None
    assert newest(sheet, 32)["combinedRatio"] == pytest.approx((26.7 + 5.5 + 9 + 4) / 53)
    assert newest(sheet, 33)["ffo"] is None


def test_ltm(sheet, cells):
    assert newest(sheet, 40, "LTM")["revenue"] == 1150
    assert cells[(41, "LTM", 2024, "revenue")]["status"] == "no-interim"
    assert cells[(42, "LTM", 2024, "revenue")]["status"] == "restated-basis"
    assert newest(sheet, 43, "LTM")["revenue"] == 1200
    carried = newest(sheet, 44, "LTM")
    assert carried["revenue"] == 6 and not carried["stitched"]


def test_prices(sheet):
    euro, carrier = newest(sheet, 46), newest(sheet, 47)
    assert euro["market_status"] == "currency-mismatch" and euro["mktCap"] is None
    assert carrier["mktCap"] == 30 and carrier["ev"] is None and carrier["price"] == 3


def test_row_order_does_not_matter(spark):
    """Other row order, other partitioning: the same cells."""
    b = book()
    facts, filers = b.frames(spark)
    mixed = facts.repartition(5, "val").sortWithinPartitions("accn")
    keep = ["cik", "basis", "end", "k", "value", "tag", "accn", "status"]
    one = {tuple(r) for r in SheetPlan(facts, filers).cells.select(keep).collect()}
    two = {tuple(r) for r in SheetPlan(mixed, filers.repartition(3)).cells.select(keep).collect()}
    assert one == two


def test_impossible_figures_of_every_kind(spark):
    from ledgerline.operators import quality
    end = dt.date(2023, 12, 31)
    sheet = spark.createDataFrame([(1, "FY", end, 5.0, 9.0, None, None), (2, "FY", end, None, None, 3.0, 4.0), (3, "FY", end, 9.0, 5.0, 4.0, 3.0)],
                                  "cik bigint, basis string, end date, totalDebt double, ltDebt double, loansGross double, loans double")
    cells = spark.createDataFrame([(4, "FY", end, "revenue", 10.0, "SalesRevenueNet"), (5, "FY", end, "revenue", 10.0, "Revenues")],
                                  "cik bigint, basis string, end date, k string, value double, tag string")
    picks = spark.createDataFrame([(4, end, "D", True, 358, "Revenues", 12.0), (5, end, "D", True, 358, "Revenues", 12.0)],
                                  "cik bigint, end date, shape string, gate boolean, dmin int, tag string, val double")
    found = {(r["cik"], r["check"]): r["detail"] for r in quality.check_impossible(sheet, cells, picks).collect()}
    assert found == {(1, "total debt below long-term debt"): -4.0, (2, "gross loans below net loans"): -1.0, (4, "revenue taken from a slice"): 2.0}


def test_reconstruction_of_every_quarter_and_calendar(spark):
    """Newest reports of each quarter, at month ends and in weeks; quarters filed, or year-to-date spans only."""
    from pyspark.sql import functions as F
    from ledgerline.operators import ltm
    facts, windows, want = [], [], {}
    sizes = [10.0, 20.0, 30.0, 40.0, 11.0, 22.0, 33.0]
    months = [dt.date(2022, 12, 31)] + [dt.date(2023 + i // 4, *((3, 31), (6, 30), (9, 30), (12, 31))[i % 4]) for i in range(7)]
    weeks = [dt.date(2022, 12, 25) + dt.timedelta(91 * i) for i in range(8)]
    # a first period of sixteen weeks and three of twelve
    uneven = [dt.date(2022, 12, 25) + dt.timedelta(7 * w) for w in (0, 16, 28, 40, 52, 68, 80, 92)]
    for cik, (nth, ends, filed) in enumerate((n, e, f) for n in (1, 2, 3) for e in (months, weeks, uneven) for f in (True, False)):
        for i in range(4 + nth):
            start = 4 * (i // 4)
            spans = {(start, sum(sizes[start:i + 1]))} | ({(i, sizes[i])} if filed and i != 3 else set())
            facts += [(cik, "T", ends[i + 1], (ends[i + 1] - ends[s]).days - 1, v) for s, v in spans]
        day0 = lambda i: ends[i] + dt.timedelta(1)
        windows.append((cik, 0, "USD", day0(4), ends[4 + nth], (ends[4 + nth] - ends[4]).days - 1, day0(0), ends[nth], ends[4], ends[0]))
        want[cik] = sum(sizes[nth:4 + nth])
    obs = spark.createDataFrame(facts, "cik bigint, tag string, end date, days int, val double").selectExpr("*", "true AS is_duration", "true AS is_periodic", "1L AS n", "if(days < 320, 1L, 0L) AS n_10q")
    windows = spark.createDataFrame(windows, "cik bigint, k int, ccy string, cur_start date, cur_end date, cur_days int, prior_start date, prior_end date, fy_end date, prev_fy_end date")
    ends = ltm.interim_ends(obs, windows)
    asked = ltm.quarter_requests(windows, ends)
    picks = obs.join(asked, ["cik", "end"]).where("days BETWEEN dmin AND dmax").select("cik", "tag", "end", "shape", "gate", "dmin", "dmax", "val", F.lit("USD").alias("unit"))
    assert {r.cik: r.rebuilt for r in ltm.reconstruct_ltm(picks, windows, ends).collect()} == want


def test_sheet_as_of_a_day_knows_nothing_filed_later(spark):
    """Calendar, currency and cells of a day are those of the facts filed until then."""
    b = Book()
    for y in (2018, 2019, 2020):
        b.year(1, "Revenues", y, 100.0 + y, unit="USD")
        b.at(1, "Assets", y, 7.0, unit="USD")
    b.year(1, "Revenues", 2019, 5.0, filed="2022-01-10", accn="late")  # restated
    for y in (2021, 2022):
        b.year(1, "Revenues", y, 100.0 + y, unit="EUR")
    facts, filers = b.frames(spark)
    plan = SheetPlan(facts, filers)
    then = plan.as_of("2021-03-01")
    assert [(r.end.year, r.ccy) for r in then.periods.orderBy("idx").collect()] == [(2020, "USD"), (2019, "USD"), (2018, "USD")]
    assert [(r.end.year, r.ccy) for r in plan.periods.orderBy("idx").collect()] == [(y, "EUR") for y in (2022, 2021, 2020, 2019, 2018)]
    early = {r.end.year: r.pick.val for r in then.annual_picks.where("k = 'revenue' AND pick IS NOT NULL").collect()}
    assert early == {2018: 2118.0, 2019: 2119.0, 2020: 2120.0}
    now = plan.read_cells.where("basis = 'FY' AND k = 'revenue' AND value IS NOT NULL")
    assert {r.end.year: r.value for r in now.collect()} == {2021: 2121.0, 2022: 2122.0}
    # without the gate the dollar years are there, the restated one as restated
    from ledgerline.operators import select
    free = select.any_currency(plan.cands)
    vals = {(r.end.year, r.val) for r in select.tag_picks(free).where("tag = 'Revenues' AND shape = 'D'").collect()}
    assert vals == {(2018, 2118.0), (2019, 5.0), (2020, 2120.0)}
