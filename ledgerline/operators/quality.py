"""Checks over whole populations of filers: what a sheet must satisfy on its own terms."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.dims import template as T
from ledgerline.functions import columns as C
from ledgerline.functions.quantiles import exact_percentiles
from ledgerline.operators import select
from ledgerline.sources.layout import of_tags

FINDING = ["check", "cik", "basis", "end", "detail"]


def _finding(df: DataFrame, check: str, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), "cik", "basis", "end", detail.alias("detail"))


def _near(a, b, tol=0.005):
    return F.abs(a - b) <= F.greatest(F.abs(b), F.lit(1.0)) * tol


# where only the parent's equity is known, the outside holders' share is added to it
CLAIMS = "totalLiab + coalesce(equityAll, equity + coalesce(nciBs, 0D)) + coalesce(tempEquity, 0D)"
IDENTITIES = (
    ("gross profit = revenue - cogs", "grossProfit", "revenue - cogs"),
    ("ebitda = ebit + da", "ebitda", "ebit + coalesce(da, 0D)"),
    ("assets = liabilities + equity", "totalAssets",
     CLAIMS),
    ("fcf = cfo - capex", "fcf", "cfo - coalesce(capex, 0D)"),
)


def check_identities(sheet: DataFrame) -> DataFrame:
    """Columns that break an identity both of whose sides are present."""
    tests = F.array(*[
        F.struct(F.lit(name).alias("check"), F.expr(left).alias("lhs"), F.expr(right).alias("rhs"))
        for name, left, right in IDENTITIES])
    rows = sheet.select("cik", "basis", "end", F.inline(tests)).where("lhs IS NOT NULL AND rhs IS NOT NULL")
    return rows.where(~_near(F.col("lhs"), F.col("rhs"))).select(
        "check", "cik", "basis", "end", (F.col("lhs") - F.col("rhs")).alias("detail"))


def identity_rates(sheet: DataFrame) -> DataFrame:
    tests = F.array(*[
        F.struct(F.lit(name).alias("check"), F.expr(left).alias("lhs"), F.expr(right).alias("rhs"))
        for name, left, right in IDENTITIES])
    rows = sheet.select(F.inline(tests)).where("lhs IS NOT NULL AND rhs IS NOT NULL")
    return rows.groupBy("check").agg(F.count("*").alias("tested"), F.count_if(_near(F.col("lhs"), F.col("rhs"))).alias("held"))


def check_impossible(sheet: DataFrame, cells: DataFrame, picks: DataFrame) -> DataFrame:
    """A figure smaller than a component of itself."""
    debt = _finding(sheet.where("totalDebt < ltDebt"), "total debt below long-term debt", F.col("totalDebt") - F.col("ltDebt"))
    loans = _finding(sheet.where("loansGross < loans"), "gross loans below net loans", F.col("loansGross") - F.col("loans"))
    whole = picks.where(f"shape = 'D' AND gate AND dmin = {C.ANNUAL_MIN} AND tag = 'Revenues'").select(
        "cik", "end", F.col("val").alias("whole"))
    slices = cells.where("basis = 'FY' AND k = 'revenue' AND tag <> 'Revenues'").join(whole, ["cik", "end"])
    slices = _finding(slices.where("whole > value"), "revenue taken from a slice", F.col("whole") - F.col("value"))
    return debt.unionByName(loans).unionByName(slices)


def check_zero_debt(sheet: DataFrame) -> DataFrame:
    """No debt next to interest expense, this column and the one before."""
    w = Window.partitionBy("cik", "basis").orderBy("end")
    s = sheet.select("cik", "basis", "end", "totalDebt", "intExp").withColumn("prev", F.lag("totalDebt").over(w))
    return _finding(s.where("totalDebt = 0 AND prev = 0 AND intExp > 0"), "zero debt contradicted", F.col("intExp"))


def check_calendar(periods: DataFrame, filings: DataFrame) -> DataFrame:
    """Order, duplicate labels, overlap, gaps, column count and staleness of a filer's columns."""
    w = Window.partitionBy("cik").orderBy("end")
    p = periods.withColumn("prev_end", F.lag("end").over(w)).withColumn("prev_fy", F.lag("fy").over(w))
    newest = filings.where(F.col("form").rlike(C.ANNUAL_FORM)).groupBy("cik").agg(F.max("period").alias("newest_report"))
    per = p.groupBy("cik").agg(
        F.count("*").alias("columns"), F.count_if(F.col("start") < F.col("prev_end")).alias("overlaps"),
        F.count_if(F.col("fy") <= F.col("prev_fy")).alias("bad_labels"), F.count_if(F.col("gap_before") > 0).alias("gaps"),
        F.max("end").alias("newest"))
    return per.join(newest, "cik", "left").select(
        "cik", "columns", "overlaps", "bad_labels", "gaps", F.coalesce(F.col("newest_report") > F.col("newest"), F.lit(False)).alias("stale"))


# (ratio, numerator, denominator, low, high): outside the range a ratio must explain itself.
RANGES = (
    ("netMargin", "netIncome", "revenue", -1.0, 1.0),
    ("ebitdaMargin", "ebitda", "revenue", -1.0, 1.0),
    ("roe", "netIncome", "equity", -1.0, 1.0),
    ("taxRate", "tax", "pretax", 0.0, 0.6),
    ("debtEquity", "totalDebt", "equity", 0.0, 10.0),
)


def classify_range(sheet: DataFrame) -> DataFrame:
    """Sort extreme ratios: thin equity first, then a denominator below its numerator, else unexplained."""
    tests = F.array(*[
        F.struct(F.lit(k).alias("ratio"), F.col(k).alias("value"), F.col(n).alias("num"), F.col(d).alias("den"),
                 ((F.col(k) < lo) | (F.col(k) > hi)).alias("outside"), F.lit(d == "equity").alias("on_equity"))
        for k, n, d, lo, hi in RANGES])
    rows = sheet.select("cik", "basis", "end", "equityThin", F.inline(tests)).where("outside")
    why = (F.when(F.col("on_equity") & F.col("equityThin"), "thin equity")
           .when(F.abs("den") < F.abs("num"), "small denominator").otherwise("unexplained"))
    return rows.select("cik", "basis", "end", "ratio", "value", why.alias("cause"))


def snapshot_diff(a: DataFrame, b: DataFrame, keys: list, value: str = "value", form: str = "form") -> DataFrame:
    """Cell by cell differences of two versions: changed, appeared, vanished, moved to another form."""
    left = a.select(*keys, F.col(value).alias("before"), F.col(form).alias("form_before"))
    right = b.select(*keys, F.col(value).alias("after"), F.col(form).alias("form_after"))
    both = left.join(right, keys, "full_outer")
    kind = (F.when(F.col("before").isNull() & F.col("after").isNotNull(), "appeared")
            .when(F.col("before").isNotNull() & F.col("after").isNull(), "vanished")
            .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
            .when(~F.col("form_before").eqNullSafe(F.col("form_after")), "form moved"))
    return both.withColumn("change", kind).where("change IS NOT NULL")


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("cells"), F.countDistinct("cik").alias("filers"))


def currency_differences(gated: DataFrame, free: DataFrame) -> DataFrame:
    """Cells that differ without the currency gate, the unit on either side.

    ``gated`` are the cells of the sheet and ``free`` those chosen without the gate,
    (cik, basis, end, k, value, unit); ``free`` holds the columns alone in which the
    gate shut something out, so the others are not compared.
    """
    keys = ["cik", "basis", "end", "k"]
    same = gated.join(free.select(*keys[:3]).distinct(), keys[:3], "left_semi")
    d = snapshot_diff(same, free, keys, form="unit")
    return d.withColumn("change", F.when(F.col("change") == "form moved", "unit moved").otherwise(F.col("change"))).select(
        *keys, "change", "before", "after", F.col("form_before").alias("unit_before"), F.col("form_after").alias("unit_after"))


def mixed_columns(cells: DataFrame) -> DataFrame:
    """Columns whose cells are in several currencies."""
    ccy = C.unit_currency("unit")
    return cells.where(ccy.isNotNull()).groupBy("cik", "basis", "end").agg(F.countDistinct(ccy).alias("currencies")).where("currencies > 1")


def currency_summary(gated: DataFrame, free: DataFrame, differences: DataFrame, obs: DataFrame, filers: DataFrame) -> DataFrame:
    """(measure, n): cells that differ, columns mixing currencies with and without the gate, filers changing currency."""
    column = ["cik", "basis", "end"]
    untouched = gated.join(free.select(*column).distinct(), column, "left_anti")
    changing = select.annual_anchor_readings(obs, filers).where("unit_ccy IS NOT NULL").groupBy("cik").agg(
        F.countDistinct("unit_ccy").alias("currencies")).where("currencies > 1")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    return (one(differences, "cells that differ").unionByName(one(mixed_columns(gated), "mixed columns with the gate"))
            .unionByName(one(mixed_columns(untouched.unionByName(free)), "mixed columns without")).unionByName(one(changing, "filers changing currency")))


def ratio_distribution(sheet: DataFrame, num: str, den: str, by: list | None = None) -> DataFrame:
    by = by or ["basis"]
    rows = sheet.withColumn("ratio", F.abs(F.try_divide(F.col(num), F.col(den))))
    return exact_percentiles(rows, by, "ratio", {"median": 0.5, "p10": 0.1, "p05": 0.05, "p01": 0.01})


def calibrate(sheet: DataFrame, truth: str, estimate, by: list) -> DataFrame:
    """Absolute relative error of an estimate against a reported row: median, p75, p90 per group."""
    rows = sheet.withColumn("err", F.abs(F.try_divide(estimate - F.col(truth), F.col(truth))))
    return exact_percentiles(rows, by, "err", {"median": 0.5, "p75": 0.75, "p90": 0.9})


def bottom_up_ebit():
    return F.col("pretax") + F.col("intExp") - F.coalesce("intInc", F.lit(0.0))


def leg_sources(cells: DataFrame, sheet: DataFrame) -> DataFrame:
    """Do columns whose three legs come from several filings close as often as the rest?"""
    legs = cells.where(F.col("k").isin("totalAssets", "totalLiab", "equity") & F.col("value").isNotNull())
    per = legs.groupBy("cik", "basis", "end").agg(F.count("*").alias("legs"), F.countDistinct("accn").alias("filings")).where("legs = 3")
    s = sheet.select("cik", "basis", "end", "totalAssets",
                     F.expr(CLAIMS).alias("claims"))
    rows = per.join(s, ["cik", "basis", "end"]).withColumn("closes", _near(F.col("totalAssets"), F.col("claims")))
    return rows.groupBy((F.col("filings") > 1).alias("split")).agg(
        F.count("*").alias("columns"), F.count_if("closes").alias("closing"))


def zero_displacement(cells: DataFrame, picks: DataFrame, filers: DataFrame, floor: float = 1e6) -> DataFrame:
    """Cells that print zero while a later candidate tag reports more than ``floor``."""
    lt = T.line_tags(cells.sparkSession).where("NOT latest").select("industry", "k", "tag", "tag_ord", "is_instant")
    zero = cells.where("value = 0 AND basis = 'FY'").select("cik", "industry", "basis", "end", "k", F.col("tag").alias("used"))
    used = zero.join(F.broadcast(lt.select("industry", "k", F.col("tag").alias("used"), F.col("tag_ord").alias("used_ord"))),
                     ["industry", "k", "used"])
    later = used.join(F.broadcast(lt), ["industry", "k"]).where("tag_ord > used_ord")
    p = picks.where("gate").where(f"shape = 'I' OR dmin = {C.ANNUAL_MIN}").select(
        "cik", "end", "tag", (F.col("shape") == "I").alias("is_instant"), "val")
    return later.join(p, ["cik", "end", "tag", "is_instant"]).where(F.abs("val") > floor).select(
        "cik", "end", "k", "used", "tag", "val")


def concept_conflicts(picks: DataFrame, tags: list) -> DataFrame:
    """Pairs of candidate tags that disagree for one filer and period, and which is larger.

    One filer and period holds at most one pick per listed tag, so the pairs are
    bounded by the list.
    """
    p = picks.where(F.col("gate") & (F.col("shape") == "D") & (F.col("dmin") == C.ANNUAL_MIN) & F.col("tag").isin(list(tags)))
    pos = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    a = p.select("cik", "end", F.col("tag").alias("tag_a"), F.col("val").alias("val_a"), pos.alias("o_a"))
    b = p.select("cik", "end", F.col("tag").alias("tag_b"), F.col("val").alias("val_b"), pos.alias("o_b"))
    pairs = a.join(b, ["cik", "end"]).where("o_a < o_b AND val_a <> val_b")
    return pairs.select("cik", "end", "tag_a", "tag_b", "val_a", "val_b",
                        F.when(F.col("val_a") > F.col("val_b"), F.col("tag_a")).otherwise(F.col("tag_b")).alias("larger"))


def normal_name(c="title"):
    """Company name without case, punctuation and legal-form words."""
    bare = F.regexp_replace(F.lower(F.col(c)), r"[^a-z0-9 ]", " ")
    bare = F.regexp_replace(bare, r"\b(inc|corp|corporation|co|company|ltd|llc|plc|holdings|group|the|new|old)\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _deletions(c):
    """A name and every form of it with one character removed."""
    return F.array_distinct(F.concat(F.array(F.col(c)), F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))),
        lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))))


def ticker_suspects(tickers: DataFrame, form_index: DataFrame, since: str) -> DataFrame:
    """Tickers without a recent annual report whose name, to one edit, has one under another filer.

    Two names one edit apart share a name or a name less one character, so an
    equi-join on those forms finds every pair and ``levenshtein`` confirms it.
    Names are compared once each; then every company of a name is returned beside
    every silent ticker of the other, whatever the length of the names.
    """
    annual = form_index.where(F.col("form").rlike(C.ANNUAL_FORM) & (F.col("filed") >= F.to_date(F.lit(since))))
    silent = tickers.join(annual.select("cik").distinct(), "cik", "left_anti").withColumn("nm", normal_name("title"))
    silent = silent.where(F.length("nm") > 0)
    named = annual.groupBy("cik").agg(F.max_by("company", F.struct("filed", "company")).alias("company"))
    named = named.select(normal_name("company").alias("nm2"), F.col("cik").alias("other_cik")).where(F.length("nm2") > 0)
    a = silent.select("nm").distinct().withColumn("block", F.explode(_deletions("nm")))
    b = named.select("nm2").distinct().withColumn("block", F.explode(_deletions("nm2")))
    near = a.join(b, "block").where(F.levenshtein("nm", "nm2") <= 1).select(
        "nm", "nm2", F.levenshtein("nm", "nm2").alias("edits")).distinct()
    return silent.join(near, "nm").join(named, "nm2").select("cik", "ticker", "title", F.col("nm2").alias("other_name"), "other_cik", "edits")


def stride_sample(df: DataFrame, order: str, lo: int, hi: int, step: int, key: str = "cik") -> DataFrame:
    """Rows at a fixed stride between two ranks of an ordered list, one per company.

    The list's own rank column is used where it has one; ``order`` must be a dense
    0-based rank, so no global sort is needed.
    """
    first = df.groupBy(key).agg(F.min(order).alias(order))
    one = df.join(first, [key, order])
    return one.where((F.col(order) >= lo) & (F.col(order) < hi) & ((F.col(order) - lo) % step == 0))


POPULATIONS = (
    ("foreign", r"^(20-F|40-F)(/A)?$"),
    ("transition", r"^(10-K|10-Q|20-F|40-F)T(/A)?$"),
    ("amended", r"/A$"),
    ("spin-off", r"^10-12B(/A)?$"),
)


def draw_population(form_index: DataFrame) -> DataFrame:
    """Filers by the kind of form they have filed."""
    marks = F.array_compact(F.array(*[F.when(F.col("form").rlike(rx), F.lit(n)) for n, rx in POPULATIONS]))
    return form_index.select("cik", F.explode(marks).alias("population")).distinct()


# Concepts that tell a reorganisation under Chapter 11; spans of a calendar year, balances at a quarter's end.
CHAPTER_11 = (
    ("chapter 11", "ReorganizationItems", True),
    ("chapter 11", "DebtorReorganizationItemsLegalAndAdvisoryProfessionalFees", True),
    ("chapter 11", "DebtorReorganizationItemsProvisionForExpectedAllowedClaims", True),
    ("chapter 11", "DebtorReorganizationItemsWriteoffOfDeferredFinancingCostsAndDebtDiscounts", True),
    ("chapter 11", "LiabilitiesSubjectToCompromise", False),
    ("fresh start", "ReorganizationValue", False),
    ("fresh start", "PostconfirmationStockholdersEquity", False),
)
#: Days by which a span or a balance may miss its calendar period.
FRAME_SLACK = 30


def frame_of(start="start", end="end") -> Column:
    """The calendar period that a fact covers: CY2019 for a year, CY2019Q4I for a balance, null for a stub."""
    start, end = F.col(start), F.col(end)
    days = F.date_diff(end, start)
    middle = F.date_add(start, F.floor(days / 2).cast("int"))
    off = F.abs(F.date_diff(start, F.trunc(middle, "year")))
    year = F.when(days.between(365 - FRAME_SLACK, 365 + FRAME_SLACK) & (off <= FRAME_SLACK), F.concat(F.lit("CY"), F.year(middle)))
    quarter = F.date_sub(F.trunc(F.date_add(end, FRAME_SLACK + 1), "quarter"), 1)
    balance = F.when(F.abs(F.date_diff(end, quarter)) <= FRAME_SLACK, F.concat(F.lit("CY"), F.year(quarter), F.lit("Q"), F.quarter(quarter), F.lit("I")))
    return F.when(start.isNull(), balance).otherwise(year)


def concept_population(facts: DataFrame, rules=CHAPTER_11) -> DataFrame:
    """(population, cik, tag, frame): filers drawn by the concepts that they report for a calendar period.

    ``facts`` are all facts, not the template's alone; of a table written by concept
    only the asked concepts' files are read.
    """
    dim = facts.sparkSession.createDataFrame(list(rules), "population string, tag string, is_span boolean")
    rows = of_tags(facts, [t for _, t, _ in rules]).where("ns = 'us-gaap'")
    framed = rows.select("cik", "tag", F.col("start").isNotNull().alias("is_span"), frame_of().alias("frame")).where("frame IS NOT NULL").distinct()
    return framed.join(F.broadcast(dim), ["tag", "is_span"]).select("population", "cik", "tag", "frame")


def duration_histogram(obs: DataFrame) -> DataFrame:
    rows = of_tags(obs, T.anchor_tags()).where(F.col("is_duration") & F.col("is_periodic"))
    return rows.groupBy("days").agg(F.sum("n").alias("facts"))


def amendment_audit(cands: DataFrame, winners: DataFrame) -> DataFrame:
    """Amendments that override a different report: power-of-ten cases and who corroborates them."""
    won = winners.where(C.is_amendment(F.col("w.form")) & F.col("gate"))
    reports = cands.where("wrong_ccy IS NULL AND plain IS NOT NULL AND gate")
    key = [*select.REQUEST_KEY, "tag"]
    pairs = won.join(reports.select(*key, "val", "accn_lo", "accn_hi"), key)
    two = F.col("accn_lo") != F.col("accn_hi")
    shift = C.is_power_of_ten(F.col("w.val"), F.col("val"))
    per = pairs.groupBy(*key).agg(
        F.max(F.col("val") == F.col("w.val")).alias("agreed"), F.max(F.col("val") != F.col("w.val")).alias("differs"),
        F.max(shift).alias("shifted"), F.max(shift & two).alias("outvoted"))
    return per.agg(
        F.count_if("differs").alias("overrides"), F.count_if(F.col("differs") & F.col("shifted")).alias("power_of_ten"),
        F.count_if(F.col("shifted") & F.col("agreed")).alias("corroborated"),
        F.count_if(F.col("outvoted") & ~F.col("agreed")).alias("put_right"))


def coverage(cells: DataFrame) -> DataFrame:
    return cells.groupBy("industry", "basis", "k").agg(
        F.count("*").alias("cells"), F.count_if(F.col("value").isNotNull()).alias("resolved"))
