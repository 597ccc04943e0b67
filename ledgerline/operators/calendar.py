"""Fiscal calendars: the columns of a sheet, derived from the facts themselves."""

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.functions import columns as C
from ledgerline.operators.select import annual_anchor_readings


def candidate_calendars(obs: DataFrame, filers: DataFrame) -> DataFrame:
    """Distinct annual period ends per anchor tag; the first fact in the document dates the start."""
    rows = annual_anchor_readings(obs, filers)
    cal = rows.groupBy("cik", "industry", "tag", "tag_ord", "end").agg(F.min("seen")["days"].alias("days"))
    return cal.select("cik", "industry", "tag", "tag_ord", F.date_sub("end", F.col("days")).alias("start"), "end")


def rank_calendars(cands: DataFrame) -> DataFrame:
    """Per anchor tag: newest end, unbroken years back from it, and number of years.

    Windows run over one tag's distinct year ends, a set bounded by the calendar.
    """
    w = Window.partitionBy("cik", "tag").orderBy(F.col("end").desc())
    rows = cands.withColumn("newer_start", F.lag("start").over(w)).withColumn(
        "broken", F.coalesce(F.date_diff("newer_start", "end") > 1, F.lit(False)).cast("int"))
    rows = rows.withColumn("breaks", F.sum("broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("cik", "industry", "tag", "tag_ord").agg(
        F.max("end").alias("newest"), F.count_if(F.col("breaks") == 0).alias("contiguous"), F.count("*").alias("years"))


def choose_calendar(ranked: DataFrame) -> DataFrame:
    """One anchor tag per filer among those that are still current."""
    newest = F.max("newest").over(Window.partitionBy("cik"))
    live = ranked.withColumn("overall", newest).where(F.date_diff("overall", "newest") <= C.ANNUAL_MAX)
    best = F.struct("contiguous", "years", (-F.col("tag_ord")).alias("o"), "tag")
    return live.groupBy("cik", "industry").agg(F.max(best).alias("b")).select(
        "cik", "industry", F.col("b.tag").alias("tag"), F.col("b.contiguous").alias("contiguous"),
        F.col("b.years").alias("years"))


def drop_overlaps(cal: DataFrame) -> DataFrame:
    """Newest to oldest, keep a period only if it ends by the start of the last one kept.

    ``cal`` is one calendar per filer: at most a few dozen distinct year ends, so
    the greedy fold runs on a bounded array.
    """
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct("end", "start"))))
    grouped = cal.groupBy("cik", "industry", "tag").agg(newest_first.alias("ps"))
    empty = F.filter("ps", lambda p: F.lit(False))
    keep = lambda acc, p: F.when(
        (F.size(acc) == 0) | (p["end"] <= F.element_at(acc, -1)["start"]), F.concat(acc, F.array(p))).otherwise(acc)
    return grouped.select("cik", "industry", "tag", F.aggregate("ps", empty, keep).alias("ps"))


def label_years(kept: DataFrame, limit: int = 8) -> DataFrame:
    """Newest ``limit`` periods labelled by year; a label equal to its newer neighbour's drops one."""
    ps = F.slice("ps", 1, limit)
    empty = F.transform(F.filter("ps", lambda p: F.lit(False)),
                        lambda p: F.struct(p["end"].alias("end"), p["start"].alias("start"), F.year(p["end"]).alias("fy")))
    def step(acc, p):
        y = F.year(p["end"])
        clash = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["fy"] == y)
        fy = F.when(clash, y - 1).otherwise(y)
        return F.concat(acc, F.array(F.struct(p["end"].alias("end"), p["start"].alias("start"), fy.alias("fy"))))
    return kept.withColumn("ps", F.aggregate(ps, empty, step))


def unfold_periods(labelled: DataFrame) -> DataFrame:
    """Bounded arrays back to rows: idx 0 is the newest; gaps look at the older neighbour."""
    gap = lambda p, i: F.struct(
        p["end"].alias("end"), p["start"].alias("start"), p["fy"].alias("fy"),
        F.greatest(F.lit(0), F.coalesce(F.date_diff(p["start"], F.get("ps", i + 1)["end"]), F.lit(0))).alias("gap"))
    rows = labelled.select("cik", "industry", "tag", F.posexplode(F.transform("ps", gap)).alias("idx", "p"))
    return rows.select("cik", "industry", F.col("tag").alias("anchor"), "idx", "p.end", "p.start", "p.fy",
                       F.when(F.col("p.gap") > 1, F.col("p.gap")).otherwise(0).alias("gap_before"))


def annual_periods(obs: DataFrame, filers: DataFrame, limit: int = 8) -> DataFrame:
    cands = candidate_calendars(obs, filers)
    chosen = choose_calendar(rank_calendars(cands))
    cal = cands.join(chosen.select("cik", "tag"), ["cik", "tag"])
    return unfold_periods(label_years(drop_overlaps(cal), limit))


def has_annual_periods(obs: DataFrame, filers: DataFrame) -> DataFrame:
    return filers.join(annual_anchor_readings(obs, filers).select("cik").distinct().withColumn("has_periods", F.lit(True)),
                       "cik", "left").select("cik", "industry", F.coalesce("has_periods", F.lit(False)).alias("has_periods"))


def apply_ticker_fixes(tickers: DataFrame, fixes: DataFrame) -> DataFrame:
    """A fix replaces the row of its ticker or is appended."""
    cols = ["cik", "ticker", "title"]
    kept = tickers.join(fixes.select("ticker"), "ticker", "left_anti")
    return kept.select(cols).unionByName(fixes.select(cols))


def resolve_predecessors(tickers: DataFrame, alive: DataFrame, preds: DataFrame) -> DataFrame:
    """Use a mapped predecessor only while the ticker's own filer has no annual periods."""
    live = alive.where("has_periods").select("cik")
    own = tickers.join(live.withColumn("own_ok", F.lit(True)), "cik", "left")
    p = preds.select("ticker", F.col("cik").alias("pred_cik"))
    p = p.join(live.select(F.col("cik").alias("pred_cik")), "pred_cik", "left_semi")
    both = own.join(p, "ticker", "left")
    use = F.col("own_ok").isNull() & F.col("pred_cik").isNotNull()
    return both.select("ticker", "title", F.col("cik").alias("listed_cik"),
                       F.when(use, F.col("pred_cik")).otherwise(F.col("cik")).alias("used_cik"), use.alias("fell_back"))


def stale_sheets(periods: DataFrame, filings: DataFrame) -> DataFrame:
    """Filers whose newest annual report covers a period after their newest column."""
    annual = filings.where(F.col("form").rlike(C.ANNUAL_FORM) & F.col("period").isNotNull())
    # on equal periods the list's first entry stays
    newest = annual.groupBy("cik").agg(F.max(F.struct("period", (-F.col("filing_ord")).alias("o"), "form", "accn")).alias("m"))
    last = periods.where("idx = 0").select("cik", F.col("end").alias("newest_end"))
    rows = newest.join(last, "cik").where(F.col("m.period") > F.col("newest_end"))
    wording = (F.when(F.col("m.form").rlike(r"T(/A)?$"), "transition")
               .when(F.col("m.form").rlike("^(20-F|40-F)"), "foreign").otherwise("plain"))
    return rows.select("cik", "newest_end", F.col("m.period").alias("period"), F.col("m.form").alias("form"),
                       F.col("m.accn").alias("accn"), wording.alias("wording"))


