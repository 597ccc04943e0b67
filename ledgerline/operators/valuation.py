"""Price multiples on the newest column of each basis."""

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.dims import template as T

_NZ = "nullif({}, 0D)".format

# The definitions of the multiples.
# (key, expression over price and the sheet); a zero counts as missing where the rule says so.
MARKET = (
    ("mktCap", "q_price * sharesOut"),
    ("ev", "mktCap + totalDebt + coalesce(preferred, 0D) + coalesce(nciBs, 0D) - coalesce(cash, 0D) - coalesce(sti, 0D)"),
    ("evRev", f"{_NZ('ev')} / {_NZ('revenue')}"),
    ("evEbitda", f"{_NZ('ev')} / {_NZ('ebitda')}"),
    ("evEbit", f"{_NZ('ev')} / {_NZ('ebit')}"),
    ("evFcf", f"{_NZ('ev')} / {_NZ('fcf')}"),
    ("pe", f"q_price / {_NZ('epsDil')}"),
    ("pb", f"{_NZ('mktCap')} / {_NZ('equity')}"),
    ("fcfYield", f"fcf / {_NZ('mktCap')}"),
    ("divYield", f"{_NZ('dps')} / q_price"),
)


def value(sheet: DataFrame, quotes: DataFrame, filers: DataFrame) -> DataFrame:
    """Market rows for the newest column; ``market_status`` says why they are blank.

    Quotes are matched on the filer's first ticker.  Dollar prices are never set
    against statements in another currency.
    """
    priced = filers.select("cik", F.upper(F.get("tickers", F.lit(0))).alias("symbol")).join(
        quotes.select("symbol", F.col("price").alias("q_price")), "symbol").drop("symbol")
    newest = F.col("end") == F.max("end").over(Window.partitionBy("cik", "basis"))
    s = sheet.join(priced, "cik", "left").withColumn(
        "market_status", F.when(newest & F.col("q_price").isNotNull(),
                                F.when(F.col("ccy").isNotNull() & (F.col("ccy") != "USD"), "currency-mismatch").otherwise("market")))
    on = F.col("market_status") == "market"
    s = s.withColumn("q_price", F.when(on, F.col("q_price")))
    # cap first, then the bridge, then everything divided by them
    for level in (MARKET[:1], MARKET[1:2], MARKET[2:]):
        s = s.withColumns({k: F.expr(e) for k, e in level})
    s = s.withColumn("price", F.col("q_price"))
    finite = lambda k: F.when(~F.isnan(k) & (F.abs(k) != float("inf")), F.col(k))
    na = {k: [i for i, ks in T.NOT_APPLICABLE.items() if k in ks] for k in T.MARKET_KEYS}
    return s.withColumns({
        k: finite(k) if not na[k] else F.when(~F.col("industry").isin(na[k]), finite(k)) for k in T.MARKET_KEYS
    }).drop("q_price")
