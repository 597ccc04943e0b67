"""Fixed values, written again by hand from the rules: a wrong entry would pass a comparison that takes them from the code."""

from ledgerline.dims import template as T
from ledgerline.functions import columns as C


def tags_of(key, industry="corporate"):
    return next(list(r[-1]) if isinstance(r[-1], (list, tuple)) else None for r in T.template_rows() if r[0] == industry and r[7] == key)


def test_keep_list():
    keep = T.keep_list()
    assert len(set(keep)) == 249
    assert {"Revenues", "NetIncomeLoss", "Assets", "Liabilities", "StockholdersEquity", "GrossProfit", "OperatingIncomeLoss", "CostOfRevenue",
            "InterestExpense", "LongTermDebtNoncurrent", "CashAndCashEquivalentsAtCarryingValue"} <= set(keep)


def test_spans_and_forms():
    assert (C.ANNUAL_MIN, C.ANNUAL_MAX) == (358, 400)


def test_industries(spark):
    rows = [(6021, "bank"), (6199, "bank"), (6200, "advisory"), (6299, "advisory"), (6300, "pc"), (6310, "pc"), (6311, "life"), (6321, "life"), (6324, "health"),
            (6331, "pc"), (6399, "pc"), (6411, "corporate"), (6798, "reit"), (7372, "corporate"), (6019, "corporate")]
    df = spark.createDataFrame([(str(n), i) for n, i in rows], "sic_code string, want string")
    assert df.where(C.industry_of() != df.want).count() == 0
