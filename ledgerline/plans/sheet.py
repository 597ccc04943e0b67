"""From facts to standardised sheets, for every filer in one plan."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.dims import template as T
from ledgerline.operators import calendar, derive, ltm, select, valuation
from ledgerline.plans.stage import write_stage
from ledgerline.sources import layout, readers


class SheetPlan:
    """Named steps of the pipeline; each is built on first use.

    Steps that several later steps read are written as stages: the facts, their
    distinct readings, the columns, the picks, the cells and the sheet.  The readings
    hold one row per (filer, tag, unit, shape, value), the rest only a
    template-sized multiple of the number of filers.
    """

    def __init__(self, raw_facts: DataFrame, filers: DataFrame, quotes: DataFrame | None = None, limit: int = 8):
        self.spark: SparkSession = raw_facts.sparkSession
        self.raw_facts = raw_facts
        self.filers = filers
        self.raw_quotes = quotes
        self.limit = limit

    @cached_property
    def facts(self) -> DataFrame:
        return write_stage(readers.annotate_facts(readers.slim(self.raw_facts)), "facts")

    @cached_property
    def obs(self) -> DataFrame:
        return layout.write_by_tag(select.observations(self.facts), "readings", ["cik", "end"])

    def as_of(self, day: str) -> "SheetPlan":
        """The plan as it stood before a day: every step from the facts filed until then, calendars, currencies and pins included."""
        plan = SheetPlan(self.raw_facts, self.filers, self.raw_quotes, self.limit)
        plan.facts = self.facts.where(F.col("filed") < F.to_date(F.lit(day)))
        return plan

    @cached_property
    def annual_picks(self) -> DataFrame:
        """Chosen tags of the fiscal-year columns alone."""
        cands = write_stage(select.candidates(self.obs, select.annual_requests(self.periods)), "annual-candidates")
        picks = write_stage(select.tag_picks(cands), "annual-picks")
        pins = select.pin_order(select.pin_by_run(self.obs, self.periods), select.pin_by_identity(picks), self.periods)
        years = self.periods.select("cik", "industry", F.lit("FY").alias("basis"), "end")
        return write_stage(select.line_cells(picks, cands, years, pins), "annual-cells")

    @cached_property
    def currency(self) -> DataFrame:
        return select.reporting_currency(self.obs, self.filers)

    @cached_property
    def periods(self) -> DataFrame:
        p = calendar.annual_periods(self.obs, self.filers, self.limit)
        return write_stage(p.join(self.currency, "cik", "left"), "periods")

    @cached_property
    def rungs(self) -> DataFrame:
        return write_stage(ltm.ytd_rungs(ltm.interim_spans(self.obs, self.filers), self.periods), "rungs")

    @cached_property
    def windows(self) -> DataFrame:
        return write_stage(ltm.ltm_windows(self.rungs, self.periods), "windows")

    @cached_property
    def columns(self) -> DataFrame:
        fy = self.periods.select("cik", "industry", F.lit("FY").alias("basis"), "end", "fy", "gap_before", "ccy")
        win = self.windows.select("cik", "industry", F.lit("LTM").alias("basis"), F.col("cur_end").alias("end"),
                                  F.year("cur_end").alias("fy"), F.lit(0).alias("gap_before"), "ccy")
        return fy.unionByName(win)

    @cached_property
    def cands(self) -> DataFrame:
        asked = select.annual_requests(self.periods).unionByName(select.ltm_requests(self.windows))
        return write_stage(select.candidates(self.obs, asked), "candidates")

    @cached_property
    def picks(self) -> DataFrame:
        return write_stage(select.tag_picks(self.cands), "picks")

    @cached_property
    def pins(self) -> DataFrame:
        runs, scores = select.pin_by_run(self.obs, self.periods), select.pin_by_identity(self.picks)
        return write_stage(select.pin_order(runs, scores, self.periods), "pins")

    @cached_property
    def read_cells(self) -> DataFrame:
        """Fiscal-year cells and LTM balances with their statuses."""
        chosen = select.line_cells(self.picks, self.cands, self.columns, self.pins)
        return write_stage(select.classify_blanks(chosen, self.columns, select.tags_seen(self.obs, self.filers)), "read")

    @cached_property
    def cells(self) -> DataFrame:
        """Every fetched line of every column: value, provenance and status."""
        stitched = ltm.stitch(self.obs, self.facts, self.windows, self.read_cells, self.picks)
        latest = select.latest_facts(self.obs, self.filers)
        grid = select.fetched_grid(self.columns.select("cik", "industry", "basis", "end")).where("latest")
        newest = grid.join(latest, ["cik", "k"], "left").select(
            "cik", "industry", "basis", "end", "k", "is_instant", "value", "unit", "tag", "accn", "form", "filed",
            F.lit(False).alias("descaled"), F.when(F.col("tag").isNotNull(), "reported").otherwise("never-tagged").alias("status"))
        rows = self.read_cells.drop("plain_pick").unionByName(stitched).unionByName(newest, allowMissingColumns=True)
        return write_stage(rows, "cells")

    @cached_property
    def wide(self) -> DataFrame:
        """One row per column, one value per fetched line; the key list is fixed, so no distinct pass."""
        keys = T.fetched_keys()
        key = ["cik", "industry", "basis", "end"]
        values = self.cells.groupBy(*key).pivot("k", keys).agg(F.first("value"))
        tags = self.cells.where(F.col("k").isin("equity", "ltDebt")).groupBy(*key).agg(
            F.max(F.when(F.col("k") == "equity", F.col("tag"))).alias("equity_tag"),
            F.max(F.when(F.col("k") == "ltDebt", F.col("tag"))).alias("ltDebt_tag"))
        return values.join(tags, key, "left").join(
            self.columns.select("cik", "basis", "end", "fy", "gap_before", "ccy"), ["cik", "basis", "end"])

    @cached_property
    def quotes(self) -> DataFrame:
        if self.raw_quotes is None:
            return self.spark.createDataFrame([], "symbol string, price double, at timestamp")
        return readers.clean_quotes(self.raw_quotes)

    @cached_property
    def stitched_sheet(self) -> DataFrame:
        flagged = derive.equity_and_debt_flags(self.wide, select.debt_scope(self.obs))
        done = derive.flag_gross_profit(derive.blank_not_applicable(derive.derive(flagged)))
        return write_stage(valuation.value(derive.cross_column(done), self.quotes, self.filers), "sheet")

    @cached_property
    def sheet(self) -> DataFrame:
        """All columns, with the newest year standing in for a missing LTM."""
        s = self.stitched_sheet.withColumn("stitched", F.col("basis") == "LTM")
        carried = ltm.carried_filers(self.periods, self.windows, self.rungs)
        stand_in = s.where("basis = 'FY'").join(carried, ["cik", "end"], "left_semi").withColumn("basis", F.lit("LTM"))
        return s.unionByName(stand_in)
