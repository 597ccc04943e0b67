"""One query per operator over the star-schema tables, each over all filers.

Ratios are rounded to six decimals at the end so that engines with different
summation orders agree; amounts are whole numbers and stay as they are.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.dims import template as T
from ledgerline.functions import columns as C
from ledgerline.operators import calendar, comps, derive, export, ltm, notes, quality, segments, select
from ledgerline.plans.stage import write_stage
from ledgerline.plans.workspace import workspace
from ledgerline.sources import instances, readers, star_schema as S

QUERIES: dict = {}
KEYS = ["cik", "basis", "end"]


def query(name):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(workspace(spark, sf_dir))
        return fn
    return register


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def big(c, name=None):
    return F.col(c).cast("bigint").alias(name or c)


# ---- sources -------------------------------------------------------------------------------------

@query("src1_facts")
def _(w):
    return w.sent_facts.where("reason IS NULL").drop("reason", "label")


@query("src1_rejects")
def _(w):
    return w.sent_facts.where("reason IS NOT NULL").groupBy("cik", "ns", "tag", "unit", "reason").agg(F.count("*").alias("n"))


@query("src2_filings")
def _(w):
    return w.sent_filings.where("reason IS NULL").drop("reason")


@query("src2_rejects")
def _(w):
    return w.sent_filings.where("reason IS NOT NULL").select("cik", "filing_ord", "form", "accn", "reason")


@query("src3_tickers")
def _(w):
    return w.sent_tickers.drop("reason")


@query("src3_rejects")
def _(w):
    return w.spoiled_tickers.where("reason IS NOT NULL")


@query("src4_quotes")
def _(w):
    return w.quotes.select("symbol", "price", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query("src5_reports")
def _(w):
    return w.reports.select("cik", "accn", "rendered", "name", "url", "index_url", "report_ord",
                            F.array_join("kinds", ",").alias("kinds"))


@query("src6_dim_facts")
def _(w):
    cell = F.array_join(F.transform("axes", lambda a: F.concat_ws("=", a["axis"], a["member"])), ",")
    return w.all_dim_facts.where("reason IS NULL").select("cik", "accn", "filed", "tag", "context_id", "period_start", "period_end", cell.alias("cell"), "val")


@query("src6_rejects")
def _(w):
    return w.all_dim_facts.where("reason IS NOT NULL").select("cik", "accn", "tag", "context_id", "reason")


@query("src6_role_members")
def _(w):
    return w.role_members.select("cik", "accn", "role", "axis", "parent_member", "member")


@query("src6_member_labels")
def _(w):
    return w.member_labels


@query("src7_form_index")
def _(w):
    return w.sent_index.where("reason IS NULL").drop("value", "reason")


@query("src7_rejects")
def _(w):
    return w.sent_index.where("reason IS NOT NULL").select(F.regexp_extract("value", r"edgar/data/(\d+)/", 1).cast("bigint").alias("filer"), "form", "cik", "reason")


@query("src8_concept_frame")
def _(w):
    year = w.years[1] - 2
    return readers.concept_frame(w.facts, list(T.REVENUE_TAGS), f"{year}-01-01", f"{year}-12-31").select(
        "cik", "tag", "unit", "form", "filed", "accn", "val")


# ---- projections ---------------------------------------------------------------------------------

@query("prj1_keep_counts")
def _(w):
    return readers.keep_counts(w.raw_facts)


@query("prj2_listed_filings")
def _(w):
    return w.listed_filings


@query("prj3_to_7_annotated")
def _(w):
    return w.facts.select("cik", "tag", "unit", "unit_ord", "start", "end", "val", "form", "filed", "accn", "unit_ccy", "is_periodic", "is_amendment", "form_rank", "is_duration",
                          F.col("days").cast("bigint").alias("days"), C.is_annual().alias("is_annual"))


@query("prj8_industry")
def _(w):
    return w.filers.select("cik", "name", F.get("tickers", F.lit(0)).alias("ticker"), "sic_code", "industry")


@query("prj9_10_11_sheet_layout")
def _(w):
    return w.long.select(*KEYS, "industry", "section", "section_ord", "k", "line_ord", "label", "how", F.col("value").isNotNull().alias("filled"))


@query("prj12_display")
def _(w):
    shown = notes.format_cells(w.long.where("value IS NOT NULL"))
    return shown.select("cik", "basis", "end", "k", "shown")


@query("prj14_links")
def _(w):
    return w.long.where("url IS NOT NULL").select(*KEYS, "section", "k", "url")


@query("prj16_section_links")
def _(w):
    return notes.section_links(w.reports, w.filers.select("cik", "industry")).select(
        "cik", "accn", "section", "section_ord", "kind", "link")


@query("prj17_identifiers")
def _(w):
    f = w.filings.withColumn("accn", F.when(F.col("filing_ord") % 7 == 3, F.substring("accn", 1, 12)).otherwise(F.col("accn")))
    return readers.quarantine_ids(f).select("cik", "filing_ord", "cik10", "id_ok")


# ---- selection -----------------------------------------------------------------------------------

@query("sel1_picks")
def _(w):
    return w.picks.where("gate").select(
        "cik", "end", "shape", "tag", "val", "unit", "accn", "form", "filed", "days").distinct()


@query("sel2_prefer_nonzero")
def _(w):
    keys = [r[7] for r in T.template_rows() if r[12]]
    return w.read_cells.where(F.col("k").isin(keys)).select("cik", "basis", "end", "k", "value", "tag", "status")


@query("sel3_scale_slips")
def _(w):
    slips = select.scale_slips(w.cands, select.newest_filed(w.cands)).where("gate")
    return slips.select("cik", "end", "tag", "agreed", F.col("rival.val").alias("rival"), F.col("rival.accn").alias("rival_accn"))


@query("sel4_statuses")
def _(w):
    return w.read_cells.select(*KEYS, "industry", "k", "status")


@query("sel5_currency")
def _(w):
    return w.currency


@query("sel6_latest")
def _(w):
    return select.latest_facts(w.obs, w.filers)


@query("sel7_runs")
def _(w):
    return select.pin_by_run(w.obs, w.periods)


@query("sel8_identity")
def _(w):
    return select.pin_by_identity(w.picks)


@query("sel7_8_pin_order")
def _(w):
    return w.pins.select("cik", "tag", "by_identity", "tag_ord")


@query("sel9_debt_scope")
def _(w):
    return select.debt_scope(w.obs)


@query("sel10_other_currency")
def _(w):
    return w.read_cells.where("status = 'other-currency'").select("cik", "basis", "end", "k", "ccy")


@query("cells_all")
def _(w):
    return w.cells.select("cik", "basis", "end", "k", "value", "unit", "tag", "accn", "form", "filed", "status")


# ---- calendar ------------------------------------------------------------------------------------

@query("cal1_candidates")
def _(w):
    return calendar.candidate_calendars(w.obs, w.filers).select("cik", "tag", "start", "end")


@query("cal2_chosen")
def _(w):
    return calendar.choose_calendar(calendar.rank_calendars(calendar.candidate_calendars(w.obs, w.filers))).select(
        "cik", "tag", "contiguous", "years")


@query("cal3_to_6_periods")
def _(w):
    return w.periods.select("cik", "idx", "end", "start", "fy", "gap_before", "ccy")


@query("cal7_has_periods")
def _(w):
    return calendar.has_annual_periods(w.obs, w.filers)


@query("cal8_predecessors")
def _(w):
    return calendar.resolve_predecessors(w.tickers, calendar.has_annual_periods(w.obs, w.filers),
                                         S.predecessors(w.spark, w.sf_dir))


@query("cal9_ticker_fixes")
def _(w):
    return calendar.apply_ticker_fixes(w.tickers, S.ticker_fixes(w.spark, w.sf_dir))


@query("cal10_stale")
def _(w):
    return calendar.stale_sheets(w.periods, w.all_listed)


# ---- LTM -----------------------------------------------------------------------------------------

@query("ltm1_2_rungs")
def _(w):
    return w.rungs.select("cik", "k", "start", "end", "days")


@query("ltm3_windows")
def _(w):
    return w.windows.select("cik", "k", "cur_start", "cur_end", "cur_days", "prior_start", "prior_end", "fy_end", "prev_fy_end")


@query("ltm4_5_stitched")
def _(w):
    return w.cells.where("basis = 'LTM' AND NOT is_instant").select("cik", "end", "k", "value", "unit", "tag", "status")


@query("ltm6_balances")
def _(w):
    return w.cells.where("basis = 'LTM' AND is_instant").select("cik", "end", "k", "value", "status")


@query("ltm7_carried")
def _(w):
    return ltm.carried_filers(w.periods, w.windows, w.rungs)


@query("ltm8_growth")
def _(w):
    keys = [k for k, _ in derive.YEAR_OVER_YEAR] + [k for k, _, _ in derive.COMPOUND]
    return w.stitched_sheet.where("basis = 'LTM'").select("cik", "end", *r6(*keys))


@query("ltm9_reconstruction")
def _(w):
    ends = write_stage(ltm.interim_ends(w.obs, w.windows), "interim-ends")
    picks = write_stage(select.tag_picks(write_stage(select.candidates(w.obs, ltm.quarter_requests(w.windows, ends)), "quarter-candidates")), "quarter-picks")
    rebuilt = ltm.reconstruct_ltm(picks, w.windows, ends)
    cells = w.cells.where("basis = 'LTM' AND status = 'ltm'").select("cik", "end", "k", "tag", "value")
    gap = F.abs(F.try_divide(F.col("rebuilt") - F.col("value"), F.col("value")))
    return rebuilt.join(cells, ["cik", "end", "tag"]).select("cik", "end", "k", "rebuilt", "value", F.round(gap, 6).alias("gap"))


# ---- derived rows --------------------------------------------------------------------------------

def _derived(w, keys, industry=None):
    s = w.stitched_sheet if industry is None else w.stitched_sheet.where(F.col("industry") == industry)
    return s.select(*KEYS, *r6(*keys))


@query("der2_corporate")
def _(w):
    return _derived(w, [k for k, _ in derive.CORE if k not in ("revenue", "nciDerived")])


def _industry_query(op, industry):
    @query(f"{op}_{industry}")
    def _(w):
        return _derived(w, [k for k, _ in derive.INDUSTRY[industry]], industry)


for _op, _i in (("der3", "bank"), ("der4", "pc"), ("der5", "life"), ("der6", "health"), ("der7", "advisory"), ("der8", "reit")):
    _industry_query(_op, _i)


@query("der9_merged_status")
def _(w):
    keys = ["revenue", "netIncome", "nciBs", "grossProfit", "nii", "totalDebt"]
    return w.long.where(F.col("k").isin(keys)).select(*KEYS, "k", "value", "status")


@query("der10_debt")
def _(w):
    return w.stitched_sheet.select(*KEYS, "stDebt", "ltdCur", "ltDebt", "debtAllIn", "totalDebt", "ltdCurInLtDebt")


@query("der11_12_13_15_flags")
def _(w):
    return w.stitched_sheet.select(*KEYS, "stDebtIsLtdCur", "equityThin", "equityIsParent", "nciDerived", "grossProfitDerived")


@query("der14_not_applicable")
def _(w):
    return w.long.where("status = 'not-applicable'").select(*KEYS, "industry", "section", "k", "value")


@query("win1_growth")
def _(w):
    return w.stitched_sheet.where("basis = 'FY'").select("cik", "end", *r6("revGrowth", "ebitdaGrowth", "epsGrowth"))


@query("win2_cagr")
def _(w):
    return w.stitched_sheet.where("basis = 'FY'").select("cik", "end", *r6("revCagr3", "revCagr5"))


@query("win3_growth_status")
def _(w):
    return w.long.where("k IN ('revGrowth', 'ebitdaGrowth', 'epsGrowth', 'revCagr3', 'revCagr5')").select(*KEYS, "k", "status", *r6("value"))


@query("val1_multiples")
def _(w):
    return w.stitched_sheet.where("market_status IS NOT NULL").select(*KEYS, *r6(*T.MARKET_KEYS))


@query("val2_mismatch")
def _(w):
    return w.long.where("status = 'currency-mismatch'").select(*KEYS, "k", "status_ccy", "value")


@query("ext_declared_rows")
def _(w):
    return derive.extension_lines(w.stitched_sheet).select(
        *KEYS, *r6("chgNwc", "netDebtBridge", "entryNetDebt", "ltmEbitda", "ltmRevenue", "treasuryMethod", "premium1d"))


# ---- notes ---------------------------------------------------------------------------------------

@query("note1_status_chips")
def _(w):
    return notes.row_status(w.long).select("cik", "k", "chip")


@query("note2_3_4_notes")
def _(w):
    return notes.row_notes(w.long, w.stitched_sheet)


@query("note5_header")
def _(w):
    return notes.filer_header(w.filers, readers.keep_counts(w.raw_facts), w.all_listed, w.periods, w.currency)


@query("note6_gaps")
def _(w):
    return notes.gap_captions(w.periods)


@query("note7_card")
def _(w):
    return notes.valuation_card(w.stitched_sheet).select("cik", "end", "k", "label", *r6("value"), "thin", "mismatch_ccy")


# ---- comparables ---------------------------------------------------------------------------------

@query("cmp1_2_set")
def _(w):
    return w.chosen.select("set_id", "ticker", "cik", "basis", "end", "fy", "stitched")


@query("cmp1_typed_set")
def _(w):
    return w.typed_members


@query("cmp3_metrics")
def _(w):
    return w.comps_rows.select("set_id", "basis", "ticker", "row_ord", "grp", "k", "label", *r6("value"))


@query("cmp4_median")
def _(w):
    return comps.comps_median(w.comps_rows).select("set_id", "basis", "k", "n", *r6("median"))


@query("cmp5_spread")
def _(w):
    return comps.period_spread(w.chosen)


@query("cmp6_gap_notes")
def _(w):
    return comps.gap_notes(w.chosen, w.long)


@query("cmp7_currency")
def _(w):
    return comps.currency_marks(w.comps_rows, w.chosen)


@query("cmp8_thin")
def _(w):
    return comps.thin_marks(w.comps_rows, w.chosen).select("set_id", "basis", "ticker", "cik", "k", *r6("value", "share"))


@query("cmp9_carried")
def _(w):
    return comps.carried(w.chosen)


@query("cmp10_search")
def _(w):
    return comps.search(w.search_index, S.typed_queries(w.spark, w.sf_dir)).select("query_id", "query", "rank", "cik", "ticker", "title")


# ---- sinks (the table each sink writes) ------------------------------------------------------------

def _priced(w):
    return w.stitched_sheet.where("market_status IS NOT NULL").select("cik")


@query("snk1_workbook")
def _(w):
    out = None
    for tab in ("statements", "ratios", "valuation"):
        part = export.sheet_rows(w.long, tab, _priced(w), w.limit).withColumn("tab", F.lit(tab))
        out = part if out is None else out.unionByName(part)
    return out.select("tab", "cik", "section_ord", "section_title", "line_ord", "k", "label", *r6(*[f"c{i}" for i in range(1, 9)]))


@query("snk1_header")
def _(w):
    return export.header_rows(w.periods, w.filers)


@query("snk2_tab")
def _(w):
    out = None
    for tab in ("statements", "ratios", "valuation"):
        part = export.tab_rows(w.long, tab, w.limit).withColumn("tab", F.lit(tab))
        out = part if out is None else out.unionByName(part)
    return out.select(
        "tab", "cik", "section_ord", "section_title", "line_ord", "k", "label", *r6(*[f"c{i}" for i in range(1, 9)]))


@query("snk3_segments")
def _(w):
    return export.segment_rows(w.segment_tables)


@query("snk4_comps")
def _(w):
    priced = w.chosen.where("market_status IS NOT NULL")
    return export.comps_table(w.comps_rows, comps.comps_median(w.comps_rows), priced).select(
        "set_id", "basis", "group_ord", "grp", "row_ord", "k", "label", "ticker", "end", *r6("value", "median"))


# ---- segments ------------------------------------------------------------------------------------

@query("seg1_3_4_breakdown")
def _(w):
    return segments.breakdown_facts(w.segment_facts).select("cik", "tag", "period_end", "axis", "member", "qualifier", "val")


@query("seg2_views")
def _(w):
    v = segments.views(segments.breakdown_facts(w.segment_facts), w.role_members)
    return v.select("cik", "axis", "role", "tag", "period_end", "member", "qualifier", "val")


@query("seg5_subtotals")
def _(w):
    v = segments.views(segments.breakdown_facts(w.segment_facts), w.role_members)
    return segments.subtotals(v, w.member_tree).select("cik", "axis", "role", "tag", "member")


def _lead(w):
    v = segments.views(segments.breakdown_facts(w.segment_facts), w.role_members)
    return segments.lead_view(segments.drop_subtotals(v, w.member_tree))


@query("seg10_lead_view")
def _(w):
    return _lead(w).select("cik", "axis", "role", "tag", "period_end", "member", "val", "qualifier", "lead",
                           F.array_join("others", ",").alias("others"))


@query("seg6_to_9_reconciling")
def _(w):
    cons = segments.consolidated_facts(w.segment_facts)
    sums = segments.table_sums(_lead(w), cons)
    rec = segments.reconciling_rows(sums, segments.reconciling_facts(w.segment_facts), w.role_members)
    return rec.select("cik", "axis", "role", "tag", "period_end", "member", "val")


@query("seg12_crosstab")
def _(w):
    t = w.segment_tables.where("along <> ''")
    return t.select("cik", "axis", "role", "along", "tag", "period_end", "member", "val", "consolidated")


@query("seg11_13_14_tables")
def _(w):
    return w.segment_tables.select("cik", "axis", "role", "along", "tag", "period_end", "member", "label", "recon", "val",
                                   "total", "consolidated")


@query("seg15_coverage")
def _(w):
    return segments.segment_coverage(w.segment_tables, w.filers)


# ---- population checks -----------------------------------------------------------------------------

@query("qa1_identities")
def _(w):
    return quality.check_identities(w.stitched_sheet)


@query("qa1_identity_rates")
def _(w):
    return quality.identity_rates(w.stitched_sheet)


@query("qa2_impossible")
def _(w):
    return quality.check_impossible(w.stitched_sheet, w.cells, w.picks)


@query("qa3_zero_debt")
def _(w):
    return quality.check_zero_debt(w.stitched_sheet)


@query("qa4_calendar")
def _(w):
    return quality.check_calendar(w.periods, w.all_listed)


@query("qa5_ranges")
def _(w):
    return quality.classify_range(w.stitched_sheet).select(*KEYS, "ratio", *r6("value"), "cause")


@query("qa6_snapshot_diff")
def _(w):
    then = w.before_last_year.annual_picks.where("pick IS NOT NULL").select(*KEYS, "k", F.col("pick.val").alias("value"), F.col("pick.form").alias("form"))
    now = w.read_cells.where("basis = 'FY' AND value IS NOT NULL").select(*KEYS, "k", "value", "form")
    return quality.snapshot_diff(then, now, [*KEYS, "k"]).select(*KEYS, "k", "change", "before", "after", "form_before", "form_after")


@query("qa7_segment_diff")
def _(w):
    key = ["cik", "tag", "period_end", "cell"]
    older = instances.usable(w.dim_facts_of(segments.annual_report(w.instances, 1)))
    return quality.snapshot_diff(segments.report_cells(older), segments.report_cells(w.dim_facts), key).select(*key, "change", "before", "after")


@query("qa8_currency_audit")
def _(w):
    return quality.currency_differences(w.gated, w.ungated)


@query("qa8_currency_summary")
def _(w):
    return quality.currency_summary(w.gated, w.ungated, quality.currency_differences(w.gated, w.ungated), w.obs, w.filers)


@query("qa9_distribution")
def _(w):
    d = quality.ratio_distribution(w.stitched_sheet, "equity", "totalAssets")
    return d.select("basis", "n", *r6("median", "p10", "p05", "p01"))


@query("qa10_calibration")
def _(w):
    d = quality.calibrate(w.stitched_sheet, "ebit", quality.bottom_up_ebit(), ["industry"])
    return d.select("industry", "n", *r6("median", "p75", "p90"))


@query("qa11_leg_sources")
def _(w):
    return quality.leg_sources(w.cells, w.stitched_sheet)


@query("qa12_zero_displacement")
def _(w):
    return quality.zero_displacement(w.read_cells, w.picks, w.filers)


@query("qa13_conflicts")
def _(w):
    return quality.concept_conflicts(w.picks, list(select.PIN_LINE.tags))


@query("qa14_ticker_suspects")
def _(w):
    return quality.ticker_suspects(w.tickers, w.form_index, f"{w.years[1] - 2}-01-01")


@query("qa15_stride_sample")
def _(w):
    # the supplier number in the title is the list's own rank
    ranked = w.tickers.withColumn("ord", F.regexp_extract("title", r"(\d+)$", 1).cast("bigint"))
    active = w.filings.where(f"form = '10-K' AND filed >= DATE'{w.years[1] - 1}-06-01'").select("cik").distinct()
    return quality.stride_sample(ranked, "ord", 2, 1 << 40, 7).join(active, "cik", "left_semi").select("cik", "ticker", "ord")


@query("qa16_populations")
def _(w):
    return quality.draw_population(w.form_index)


@query("qa16_by_concept")
def _(w):
    return quality.concept_population(w.facts_by_tag)


@query("qa17_durations")
def _(w):
    return quality.duration_histogram(w.obs)


@query("qa18_amendments")
def _(w):
    return quality.amendment_audit(w.cands, select.newest_filed(w.cands))


@query("qa19_coverage")
def _(w):
    return quality.coverage(w.cells)
