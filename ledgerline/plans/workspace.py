"""One session's prepared tables for one input folder."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.operators import calendar, comps, notes, segments, select
from ledgerline.plans.sheet import SheetPlan
from ledgerline.plans.stage import write_stage
from ledgerline.sources import instances, layout, readers, star_schema as S

_OPEN: dict = {}


class Workspace(SheetPlan):
    """The sheet plan over the star-schema tables, plus the tables around it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.years = S.years(spark, sf_dir)
        super().__init__(S.raw_facts(spark, sf_dir, self.years), S.filers(spark, sf_dir), S.quotes(spark, sf_dir, self.years))
        self.sf_dir = sf_dir

    @cached_property
    def filings(self) -> DataFrame:
        return S.filings(self.spark, self.sf_dir, self.years)

    @cached_property
    def listed_filings(self) -> DataFrame:
        """What a filer's page lists: the first forms only.  Rules about all filings read ``all_listed``."""
        return readers.trim_filings(self.filings)

    @cached_property
    def all_listed(self) -> DataFrame:
        return readers.listed(self.filings)

    @cached_property
    def tickers(self) -> DataFrame:
        return S.tickers(self.spark, self.sf_dir)

    @cached_property
    def form_index(self) -> DataFrame:
        return readers.parse_form_index(S.form_index_lines(self.spark, self.sf_dir, self.years))

    @cached_property
    def facts_by_tag(self) -> DataFrame:
        """All facts, the unmodelled ones included, laid out by concept."""
        return layout.write_by_tag(self.raw_facts, "facts-by-tag", ["end", "cik"])

    @cached_property
    def before_last_year(self) -> SheetPlan:
        """The plan as it stood at the start of the last year."""
        return self.as_of(f"{self.years[1]}-01-01")

    @cached_property
    def ungated(self) -> DataFrame:
        """Annual cells chosen without the currency gate, of the columns in which it shut something out."""
        free = write_stage(select.any_currency(self.cands), "ungated-candidates")
        cols = self.columns.where("basis = 'FY'").join(free.select("cik", "end").distinct(), ["cik", "end"], "left_semi")
        # a column shut out in one shape only keeps the candidates of its other requests
        rest = self.cands.where("gate").join(free.select("cik", "end").distinct(), ["cik", "end"], "left_semi").join(
            free.select(*select.REQUEST_KEY).distinct(), select.REQUEST_KEY, "left_anti")
        every = write_stage(free.unionByName(rest, allowMissingColumns=True), "ungated-all")
        picked = select.line_cells(select.tag_picks(every), every, cols, self.pins).where("pick IS NOT NULL")
        return write_stage(picked.select("cik", "basis", "end", "k", F.col("pick.val").alias("value"), F.col("pick.unit").alias("unit")), "ungated-cells")

    @cached_property
    def gated(self) -> DataFrame:
        return self.read_cells.where("basis = 'FY' AND value IS NOT NULL").select("cik", "basis", "end", "k", "value", "unit")

    @cached_property
    def sent_facts(self) -> DataFrame:
        """Facts as read back from company documents, unusable ones included."""
        return write_stage(readers.checked_company_facts(S.company_documents(self.raw_facts)), "sent-facts")

    @cached_property
    def sent_filings(self) -> DataFrame:
        return write_stage(readers.checked_filings(S.filing_documents(self.spark, self.sf_dir, self.years)), "sent-filings")

    @cached_property
    def sent_tickers(self) -> DataFrame:
        """The whole ticker list as read back from its lines."""
        return readers.checked_tickers(S.ticker_lines(self.spark, self.sf_dir))

    @cached_property
    def spoiled_tickers(self) -> DataFrame:
        return readers.checked_tickers(S.spoiled_ticker_lines(self.spark, self.sf_dir))

    @cached_property
    def sent_index(self) -> DataFrame:
        return write_stage(readers.checked_form_index(S.spoiled_index_lines(self.spark, self.sf_dir, self.years)), "sent-index")

    @cached_property
    def reports(self) -> DataFrame:
        return readers.read_reports(S.summaries(self.spark, self.sf_dir))

    @cached_property
    def long(self) -> DataFrame:
        return write_stage(notes.long_sheet(self.stitched_sheet, self.cells), "long")

    @cached_property
    def instances(self) -> DataFrame:
        """Annual reports as filed documents."""
        cells = S.report_cells(write_stage(S.segment_base(self.spark, self.sf_dir), "segment-base"), self.years)
        return write_stage(S.instance_documents(cells), "instance-documents")

    @cached_property
    def newest_instances(self) -> DataFrame:
        return segments.annual_report(self.instances, 0)

    def dim_facts_of(self, documents: DataFrame) -> DataFrame:
        return write_stage(instances.checked_dim_facts(documents, segments.CONCEPTS, write_stage), "dim-facts")

    @cached_property
    def all_dim_facts(self) -> DataFrame:
        """Dimensional facts of every annual report, unusable ones included."""
        return self.dim_facts_of(self.instances)

    @cached_property
    def dim_facts(self) -> DataFrame:
        """Usable facts of each filer's newest annual report."""
        return instances.usable(self.dim_facts_of(self.newest_instances))

    @cached_property
    def arcs(self) -> DataFrame:
        return write_stage(instances.arcs(S.linkbases(self.newest_instances, S.definition_linkbase())), "arcs")

    @cached_property
    def role_members(self) -> DataFrame:
        return write_stage(instances.role_members(self.arcs, write_stage), "role-members")

    @cached_property
    def member_labels(self) -> DataFrame:
        return write_stage(instances.member_labels(S.linkbases(self.newest_instances, S.label_linkbase())), "member-labels")

    @cached_property
    def member_tree(self) -> DataFrame:
        return segments.containment(self.role_members, write_stage)

    @cached_property
    def segment_facts(self) -> DataFrame:
        return write_stage(segments.dedupe(segments.allowed(self.dim_facts)), "segment-facts")

    @cached_property
    def segment_tables(self) -> DataFrame:
        return write_stage(segments.segment_tables(self.segment_facts, self.role_members, self.member_labels, self.member_tree, write_stage), "segments")

    @cached_property
    def alive(self) -> DataFrame:
        return write_stage(calendar.has_annual_periods(self.obs, self.filers), "has-periods")

    @cached_property
    def fixed_tickers(self) -> DataFrame:
        return calendar.apply_ticker_fixes(self.tickers, S.ticker_fixes(self.spark, self.sf_dir))

    @cached_property
    def typed_members(self) -> DataFrame:
        """The sets that readers typed, moved tickers led back to the filer that has a sheet."""
        followed = comps.follow_successions(self.alive, S.successions(self.spark, self.sf_dir), write_stage)
        return write_stage(comps.build_sets(S.typed_sets(self.spark, self.sf_dir), self.fixed_tickers, followed, self.alive), "typed-sets")

    @cached_property
    def comps_members(self) -> DataFrame:
        """One comparables set per industry, every filer of it, and the typed sets."""
        by_industry = self.filers.select(F.col("industry").alias("set_id"), "cik", F.get("tickers", F.lit(0)).alias("ticker"))
        return by_industry.unionByName(self.typed_members.where("known").select("set_id", F.col("used_cik").alias("cik"), "ticker"))

    @cached_property
    def chosen(self) -> DataFrame:
        """The newest column of each member on both bases."""
        return write_stage(comps.comps_set(self.sheet, self.comps_members), "chosen")

    @cached_property
    def comps_rows(self) -> DataFrame:
        return write_stage(comps.comps_rows(self.chosen), "comps-rows")

    @cached_property
    def search_index(self) -> comps.SearchIndex:
        # the supplier number in the title is the list's own rank
        ordered = self.tickers.withColumn("ord", F.regexp_extract("title", r"(\d+)$", 1).cast("bigint"))
        return comps.search_index(ordered, write_stage)


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The session's workspace for a folder; its stages are written once and shared by all queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]


def fresh(spark: SparkSession, sf_dir: str) -> Workspace:
    """A workspace that shares nothing with earlier queries (used to time cold runs)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]
