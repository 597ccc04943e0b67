"""Row statuses, notes, links and captions that explain a sheet."""

from pyspark.sql import DataFrame, functions as F

from ledgerline.dims import template as T
from ledgerline.functions import columns as C
from ledgerline.operators import derive

# Notes a row may carry; the wording is ours, the conditions are the rules'.
BLANK_NOTES = {"ebit": "no operating income subtotal in the newest statements"}
TAG_NOTES = (
    ("revenue", "GrossInvestmentIncomeOperating", "total investment income"),
    ("revenue", "InterestAndDividendIncomeOperating", "total interest and dividend income"),
)
FLAG_NOTES = (
    ("grossProfit", "grossProfitDerived", "revenue less cost of revenue"),
    ("stDebt", "stDebtIsLtdCur", "same figure as the current portion; counted once"),
    ("ltdCur", "ltdCurInLtDebt", "already inside long-term debt; counted once"),
    ("nciBs", "nciDerived", "total equity less the parent's"),
    ("debtEquity", "equityThin", None),
    ("roe", "equityThin", None),
)


def long_sheet(sheet: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per template line and column: value, status and provenance."""
    spark = sheet.sparkSession
    template = T.template_lines(spark)
    keys = list(dict.fromkeys(r[7] for r in T.template_rows()))
    have = set(sheet.columns)
    ids = ["cik", "industry", "basis", "end", "fy", "ccy", "market_status"]
    values = sheet.select(*ids, *[F.col(k) if k in have else F.lit(None).cast("double").alias(k) for k in keys])
    rows = values.unpivot(ids, keys, "k", "value").join(
        F.broadcast(template.select("industry", "section_ord", "section", "line_ord", "k", "label", "how")), ["industry", "k"])
    meta = cells.select("cik", "basis", "end", "k", F.col("value").alias("f_value"), F.col("status").alias("f_status"),
                        "tag", "unit", "accn", "form", "filed", F.col("ccy").alias("f_ccy"))
    rows = rows.join(meta, ["cik", "basis", "end", "k"], "left")
    derived = spark.createDataFrame([(i, k) for i in T.INDUSTRIES for k in derive.computed_for(i)], "industry string, k string")
    na = T.not_applicable(spark).withColumn("na", F.lit(True))
    rows = rows.join(F.broadcast(derived.withColumn("derived", F.lit(True))), ["industry", "k"], "left").join(
        F.broadcast(na), ["industry", "k"], "left")
    growth = [k for k, _ in derive.YEAR_OVER_YEAR] + [k for k, _, _ in derive.COMPOUND]
    changed = F.col("value").isNotNull() & (
        F.col("f_value").isNull() | (F.col("f_value") != F.col("value")) | (F.col("k") == "nii"))
    market = F.col("k").isin(list(T.MARKET_KEYS))
    status = (
        F.when(market & (F.col("market_status") == "currency-mismatch"), "currency-mismatch")
        .when(F.col("na"), "not-applicable")
        .when(market, F.col("market_status"))
        .when(F.col("k").isin(growth), "computed")
        .when(F.col("derived") & (F.col("f_status").isNull() | changed), "computed")
        .otherwise(F.col("f_status")))
    fetched = status.isin("reported", "ltm")
    keep = lambda c: F.when(fetched | status.isin("no-interim", "restated-basis"), F.col(c)).alias(c)
    return rows.select(
        "cik", "industry", "basis", "end", "fy", "section_ord", "section", "line_ord", "k", "label", "how", "value",
        status.alias("status"), keep("tag"), keep("unit"), keep("accn"), keep("form"), keep("filed"),
        F.when(status == "currency-mismatch", F.col("ccy")).when(status == "other-currency", F.col("f_ccy")).alias("status_ccy"),
        F.when(fetched, C.filing_url("cik", "accn")).alias("url"))


def row_status(long: DataFrame) -> DataFrame:
    """The chip beside a row of the fiscal-year sheet; null when the row speaks for itself."""
    rows = long.where("basis = 'FY'").groupBy("cik", "industry", "k", "how").agg(
        F.max(F.col("value").isNotNull()).alias("has"),
        F.min_by(F.coalesce("status", F.lit("")), "end").alias("oldest"),
        F.max_by(F.struct(F.coalesce("status", F.lit("")).alias("s"), F.col("status_ccy").alias("c")), "end").alias("newest"))
    label = F.lit(None).cast("string")
    for i, text in T.INDUSTRY_LABEL.items():
        label = F.when(F.col("industry") == i, text).otherwise(label)
    na = F.coalesce(F.concat(F.lit("n/a for a "), label), F.lit("n/a"))
    chip = (
        F.when(F.col("has"), None)
        .when(F.col("oldest") == "not-applicable", na)
        .when(F.col("newest.s") == "currency-mismatch", F.concat(F.lit("reported in "), F.col("newest.c")))
        .when(F.col("newest.s") == "other-currency", F.concat(F.lit("filed in "), F.col("newest.c")))
        .when(F.col("how") == "manual", "judgement")
        .when(F.col("how") == "market", "needs price")
        .when(F.col("how") == "computed", None)
        .when(F.col("oldest") == "never-tagged", "n/a")
        .otherwise("not tagged"))
    return rows.select("cik", "industry", "k", "how", chip.alias("chip"))


def row_notes(long: DataFrame, sheet: DataFrame) -> DataFrame:
    """Blank notes, tag notes (newest column) and flag notes (newest flagged column)."""
    spark = long.sparkSession
    fy = long.where("basis = 'FY'")
    noted = [*BLANK_NOTES, *{k for k, _, _ in TAG_NOTES}]
    newest = fy.where(F.col("k").isin(noted)).groupBy("cik", "k").agg(
        F.max_by(F.struct("value", "status", "tag", "end"), "end").alias("n"))
    blank = newest.where(F.col("k").isin(list(BLANK_NOTES)) & F.col("n.value").isNull()
                         & (F.coalesce("n.status", F.lit("")) != "not-applicable"))
    text = F.lit(None).cast("string")
    for k, t in BLANK_NOTES.items():
        text = F.when(F.col("k") == k, t).otherwise(text)
    blank = blank.select("cik", "k", F.lit("blank").alias("kind"), F.lit(None).cast("string").alias("cause"),
                         F.col("n.end").alias("end"), text.alias("note"))
    tags = spark.createDataFrame(list(TAG_NOTES), "k string, tag string, note string")
    tagged = newest.select("cik", "k", F.col("n.tag").alias("tag"), F.col("n.end").alias("end")).join(
        F.broadcast(tags), ["k", "tag"]).select("cik", "k", F.lit("tag").alias("kind"), F.col("tag").alias("cause"), "end", "note")
    years = sheet.where("basis = 'FY'")
    share = F.format_string("equity is %.2f%% of total assets", F.abs(F.col("equity") / F.col("totalAssets")) * 100)
    hits = F.array_compact(F.array(*[
        F.when(F.col(flag), F.struct(F.lit(k).alias("k"), F.lit(flag).alias("cause"),
                                     (F.lit(t) if t else share).alias("note")))
        for k, flag, t in FLAG_NOTES]))
    flagged = years.select("cik", "end", F.inline(hits)).groupBy("cik", "k", "cause").agg(
        F.max(F.struct("end", "note")).alias("m")).select(
        "cik", "k", F.lit("flag").alias("kind"), "cause", F.col("m.end").alias("end"), F.col("m.note").alias("note"))
    return blank.unionByName(tagged).unionByName(flagged)


def filer_header(filers: DataFrame, counts: DataFrame, filings: DataFrame, periods: DataFrame, currency: DataFrame) -> DataFrame:
    """One row per filer: currency notice, tag and filing counts, and whether the sheet is empty."""
    listed = filings.groupBy("cik").agg(F.count("*").alias("filings"))
    cols = periods.groupBy("cik").agg(F.count("*").alias("columns"))
    h = (filers.select("cik", "name", "industry").join(counts, "cik", "left").join(listed, "cik", "left")
         .join(cols, "cik", "left").join(currency, "cik", "left"))
    return h.select(
        "cik", "name", "industry", F.coalesce("tags_kept", F.lit(0)).alias("tags_kept"),
        F.coalesce("tags_dropped", F.lit(0)).alias("tags_dropped"), F.coalesce("filings", F.lit(0)).alias("filings"),
        F.when(F.col("ccy") != "USD", F.col("ccy")).alias("notice_ccy"), F.col("columns").isNull().alias("empty"))


def gap_captions(periods: DataFrame) -> DataFrame:
    months = F.floor(F.col("gap_before") / 30.4 + 0.5).cast("int")
    return periods.where("gap_before > 0").select(
        "cik", "end", "gap_before", F.concat(months.cast("string"), F.lit(" mo not covered")).alias("caption"))


def valuation_card(sheet: DataFrame) -> DataFrame:
    """Non-null rows of the valuation section in the newest year, with its two warnings."""
    spark = sheet.sparkSession
    keys = [r[7] for r in T.template_rows() if r[0] == "corporate" and r[2] == "ev"]
    last = sheet.where("basis = 'FY'").groupBy("cik").agg(F.max("end").alias("end"))
    newest = sheet.where("basis = 'FY'").join(last, ["cik", "end"]).select("cik", "end", "fy", "equityThin", "market_status", "ccy", *keys)
    rows = newest.unpivot(["cik", "end", "fy", "equityThin", "market_status", "ccy"], keys, "k", "value").where("value IS NOT NULL")
    labels = T.template_lines(spark).where("industry = 'corporate' AND section = 'ev'").select("k", "label", "line_ord")
    style = T.line_format(spark)
    rows = rows.join(F.broadcast(labels), "k").join(F.broadcast(style), "k", "left")
    return rows.select("cik", "end", "k", "label", "line_ord", "value", C.display("value", "style").alias("shown"),
                       F.col("equityThin").alias("thin"),
                       F.when(F.col("market_status") == "currency-mismatch", F.col("ccy")).alias("mismatch_ccy"))


def format_cells(long: DataFrame) -> DataFrame:
    style = T.line_format(long.sparkSession)
    return long.join(F.broadcast(style), "k", "left").withColumn("shown", C.display("value", "style", "unit"))


def section_links(reports: DataFrame, industries: DataFrame) -> DataFrame:
    """For each section of a filer's sheet, the first report of its kind, else the filing folder.

    ``industries``: (cik, industry).  A section without a kind has no link.
    """
    sections = T.template_lines(reports.sparkSession).select("industry", "section", "section_ord", "kind").distinct()
    asked = industries.join(F.broadcast(sections), "industry")
    by_kind = reports.where("report_ord IS NOT NULL").select("cik", "accn", "url", "report_ord", F.explode("kinds").alias("kind"))
    first = by_kind.groupBy("cik", "accn", "kind").agg(F.min_by("url", "report_ord").alias("url"))
    filings = reports.groupBy("cik", "accn").agg(F.min("index_url").alias("index_url"))
    rows = asked.join(filings, "cik").join(first, ["cik", "accn", "kind"], "left")
    return rows.select("cik", "accn", "section", "section_ord", "kind", F.coalesce("url", "index_url").alias("link"))
