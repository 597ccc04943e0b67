"""Sheets and comparables as files."""

from pyspark.sql import DataFrame, functions as F

from ledgerline.dims import template as T

def _positions(long: DataFrame) -> DataFrame:
    """Number a filer's fiscal-year columns from the oldest (c1)."""
    from pyspark.sql import Window
    ends = long.where("basis = 'FY'").select("cik", "end").distinct()
    w = Window.partitionBy("cik").orderBy("end")
    return ends.withColumn("pos", F.concat(F.lit("c"), F.row_number().over(w).cast("string")))


def _spread(rows: DataFrame, key: list, value, columns: int) -> DataFrame:
    names = [f"c{i}" for i in range(1, columns + 1)]
    return rows.groupBy(*key).pivot("pos", names).agg(F.first(value))


def header_rows(periods: DataFrame, filers: DataFrame) -> DataFrame:
    """What stands over a sheet's columns: company, tickers, currency, and each column's year and end, oldest first."""
    from pyspark.sql import Window
    at = F.row_number().over(Window.partitionBy("cik").orderBy("end"))  # as many rows as a sheet has columns
    cols = periods.select("cik", "end", "fy", "ccy", at.alias("pos"))
    return cols.join(filers.select("cik", "name", F.array_join("tickers", ", ").alias("tickers")), "cik").select(
        "cik", "name", "tickers", F.concat(F.lit("c"), F.col("pos").cast("string")).alias("column"),
        F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("year"), "end", "ccy")


def sheet_rows(long: DataFrame, tab: str, priced: DataFrame, columns: int) -> DataFrame:
    """Rows of one workbook tab in statement order; the valuation bridge only for priced filers.

    ``columns`` is the plan's own limit, so no column of the sheet is left out.
    """
    t = T.template_lines(long.sparkSession).select("industry", "section", "k", "tab", "section_title")
    fy = long.where("basis = 'FY' AND how <> 'manual'").join(F.broadcast(t), ["industry", "section", "k"])
    own = fy.where(F.col("tab") == tab)
    if tab == "valuation":
        bridge = fy.where("section = 'ev'").join(priced.select("cik").distinct(), "cik", "left_semi")
        own = own.unionByName(bridge.withColumn("section_ord", F.lit(1000)))
    rows = own.join(_positions(long), ["cik", "end"])
    return _spread(rows, ["cik", "section_ord", "section_title", "line_ord", "k", "label"], F.col("value"), columns)


def tab_rows(long: DataFrame, tab: str, columns: int) -> DataFrame:
    """Rows of the copied tab: no manual or market rows, amounts to two decimals, blanks empty."""
    t = T.template_lines(long.sparkSession).select("industry", "section", "k", "tab", "section_title")
    fy = long.where("basis = 'FY' AND how NOT IN ('manual', 'market')").join(F.broadcast(t), ["industry", "section", "k"])
    raw = F.col("k").isin([*T.PERCENT_KEYS, *T.MULTIPLE_KEYS])
    shown = F.when(raw, F.col("value")).otherwise(F.floor(F.col("value") * 100 + 0.5) / 100)
    rows = fy.where(F.col("tab") == tab).withColumn("shown", shown).join(_positions(long), ["cik", "end"])
    return _spread(rows, ["cik", "section_ord", "section_title", "line_ord", "k", "label"], F.col("shown"), columns)


def comps_table(rows: DataFrame, medians: DataFrame, priced: DataFrame) -> DataFrame:
    """Metric rows of each set with their median; market rows only where someone is priced.

    The company side stays long, so a set may have any number of members.
    """
    sets = priced.select("set_id", "basis").distinct().withColumn("any_priced", F.lit(True))
    r = rows.join(sets, ["set_id", "basis"], "left").where("any_priced OR NOT is_market")
    return r.join(medians.select("set_id", "basis", "k", "median"), ["set_id", "basis", "k"], "left").select(
        "set_id", "basis", "group_ord", "grp", "row_ord", "k", "label", "ticker", "end", "value", "median")


def segment_rows(views: DataFrame) -> DataFrame:
    """Member rows and the consolidated row of each kept view, ready for one line per row."""
    tail = F.when(F.col("recon"), F.lit(" (reconciling item)")).otherwise(F.lit(""))
    members = views.select("cik", "axis", "role", "tag", "period_end", F.concat("label", tail).alias("row_label"), "val")
    total = views.select("cik", "axis", "role", "tag", "period_end", F.lit("Consolidated").alias("row_label"),
                         F.col("consolidated").alias("val")).distinct()
    return members.unionByName(total)


def export_sheet(long: DataFrame, tab: str, priced: DataFrame, columns: int, path: str) -> None:
    """One folder per filer would mean millions of files; rows are clustered by filer instead."""
    out = sheet_rows(long, tab, priced, columns)
    out.repartitionByRange("cik").sortWithinPartitions("cik", "section_ord", "line_ord").write.mode("errorifexists").parquet(path)


def _write_tsv(df: DataFrame, path: str, *order: str) -> None:
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("errorifexists").option("sep", "\t").option("nullValue", "").option("header", True).csv(path))


def export_header_tsv(periods: DataFrame, filers: DataFrame, path: str) -> None:
    _write_tsv(header_rows(periods, filers), path, "cik", "end")


def export_tab_tsv(long: DataFrame, tab: str, columns: int, path: str) -> None:
    _write_tsv(tab_rows(long, tab, columns), path, "cik", "section_ord", "line_ord")


def export_segments(views: DataFrame, path: str) -> None:
    _write_tsv(segment_rows(views), path, "cik", "axis", "role", "tag", "period_end")


def export_comps(rows: DataFrame, medians: DataFrame, priced: DataFrame, path: str) -> None:
    out = comps_table(rows, medians, priced)
    out.repartitionByRange("set_id", "row_ord").sortWithinPartitions("set_id", "row_ord", "ticker").write.mode(
        "errorifexists").parquet(path)
