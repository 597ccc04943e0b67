"""Segment tables that add up to the consolidated figure, or are not shown.

Input facts: (cik, accn, form, filed, tag, context_id, period_start, period_end,
axes ARRAY<STRUCT<axis, member>>, val).  Members of a table come from the role
that declares them: role_members(cik, accn, role, axis, parent_member, member).
Everything is grouped by filing, table, concept and period; a group never has
more rows than a table has members and qualifiers.
"""

from pyspark.sql import DataFrame, Window, functions as F

# The axes that get a table, the qualifier axis and the subtotal member.
SEGMENT_AXIS = "us-gaap:StatementBusinessSegmentsAxis"
PRODUCT_AXIS = "srt:ProductOrServiceAxis"
GEOGRAPHY_AXIS = "srt:StatementGeographicalAxis"
BREAKDOWN_AXES = (SEGMENT_AXIS, PRODUCT_AXIS, GEOGRAPHY_AXIS)
QUALIFIER_AXIS = "srt:ConsolidationItemsAxis"
OPERATING_SEGMENTS = "us-gaap:OperatingSegmentsMember"

# Concepts that get a segment table (our choice; a parameter of every function that needs it).
CONCEPTS = (
    "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "CostOfRevenue", "GrossProfit",
    "OperatingIncomeLoss", "NetIncomeLoss", "DepreciationDepletionAndAmortization",
    "PaymentsToAcquirePropertyPlantAndEquipment", "Assets", "Goodwill", "InterestExpense", "PremiumsEarnedNet",
)
# Standard taxonomy labels and the short label used instead.
STANDARD_LABELS = (
    ("Segment Reporting, Reconciling Item, Excluding Corporate Nonsegment", "Reconciling items"),
    ("Segment Reconciling Items [Member]", "Reconciling items"),
    ("Corporate Segment and Other Operating Segment", "Corporate & other"),
    ("Corporate, Non-Segment [Member]", "Corporate"),
    ("Intersegment Eliminations [Member]", "Eliminations"),
)
TOLERANCE = 0.001

FILING = ["cik", "accn"]
PERIOD = ["period_start", "period_end"]
VIEW = ["cik", "accn", "axis", "role", "along"]


def _same_period(a: str, b: str):
    return (F.col(f"{a}.period_end") == F.col(f"{b}.period_end")) & F.col(f"{a}.period_start").eqNullSafe(F.col(f"{b}.period_start"))


def annual_report(rows: DataFrame, back: int) -> DataFrame:
    """Rows (documents or facts) of each filer's 10-K that has ``back`` newer ones."""
    k = rows.where("form = '10-K'")
    order = Window.partitionBy("cik").orderBy(F.desc("filed"), F.desc("accn"))
    at = k.select(*FILING, "filed").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") == back + 1)
    return k.join(at.select(*FILING), FILING, "left_semi")


def report_cells(facts: DataFrame) -> DataFrame:
    """(cik, tag, period_end, cell, value, form): one row per cell, named by its axes and members."""
    cell = F.array_join(F.transform("axes", lambda a: F.concat_ws("=", a["axis"], a["member"])), ",")
    return dedupe(allowed(facts)).groupBy("cik", "tag", "period_end", cell.alias("cell")).agg(
        F.min("val").alias("value"), F.lit("10-K").alias("form"))


def newest_annual(rows: DataFrame) -> DataFrame:
    """Rows of each filer's newest 10-K."""
    k = rows.where("form = '10-K'")
    last = k.groupBy("cik").agg(F.max(F.struct("filed", "accn"))["accn"].alias("accn"))
    return k.join(last, FILING, "left_semi")


def dedupe(facts: DataFrame) -> DataFrame:
    """One row per (tag, context): a document repeats a fact wherever it prints it."""
    return facts.groupBy("cik", "accn", "tag", "context_id").agg(
        F.min_by(F.struct(*PERIOD, "axes", "val"), "val").alias("f")).select("cik", "accn", "tag", "context_id", "f.*")


def _axis_parts(facts: DataFrame) -> DataFrame:
    is_breakdown = lambda a: a["axis"].isin(list(BREAKDOWN_AXES))
    return facts.withColumns({
        "cuts": F.filter("axes", is_breakdown),
        "quals": F.filter("axes", lambda a: a["axis"] == QUALIFIER_AXIS),
    }).where(F.size("axes") == F.size("cuts") + F.size("quals")).withColumn(
        "qualifier", F.coalesce(F.get("quals", F.lit(0))["member"], F.lit("")))


def allowed(facts: DataFrame, concepts=CONCEPTS) -> DataFrame:
    return facts.where(F.col("tag").isin(list(concepts)))


def breakdown_facts(facts: DataFrame) -> DataFrame:
    """Facts on exactly one breakdown axis, the qualifier axis permitted beside it."""
    rows = _axis_parts(facts).where((F.size("cuts") == 1) & (F.size("quals") <= 1))
    return rows.select(*FILING, "tag", *PERIOD, F.get("cuts", F.lit(0))["axis"].alias("axis"),
                       F.get("cuts", F.lit(0))["member"].alias("member"), "qualifier", F.lit("").alias("along"), "val")


def reconciling_facts(facts: DataFrame) -> DataFrame:
    """Facts on the qualifier axis alone: corporate, eliminations and the like."""
    rows = _axis_parts(facts).where((F.size("cuts") == 0) & (F.size("quals") == 1))
    return rows.select(*FILING, "tag", *PERIOD, F.col("qualifier").alias("member"), "val")


def consolidated_facts(facts: DataFrame) -> DataFrame:
    return facts.where(F.size("axes") == 0).groupBy(*FILING, "tag", *PERIOD).agg(F.max("val").alias("consolidated"))


def views(rows: DataFrame, role_members: DataFrame) -> DataFrame:
    """Split an axis by the role that declares its members."""
    roles = role_members.select(*FILING, "role", "axis", "member").distinct()
    return rows.join(roles, [*FILING, "axis", "member"])


def containment(role_members: DataFrame, stage) -> DataFrame:
    """(role, axis, ancestor, member) pairs of the member trees, at any depth.

    Each step joins the pairs found so far with themselves, so the depth reached
    doubles; it ends when a step finds no new pair.
    """
    key = [*FILING, "role", "axis"]
    pairs = stage(role_members.where("parent_member IS NOT NULL").select(
        *key, F.col("parent_member").alias("ancestor"), "member").distinct(), "member-tree")
    found = pairs.count()
    while True:
        up = pairs.select(*key, F.col("ancestor"), F.col("member").alias("mid"))
        down = pairs.select(*key, F.col("ancestor").alias("mid"), "member")
        pairs = stage(pairs.unionByName(down.join(up, [*key, "mid"]).select(*key, "ancestor", "member")).distinct(), "member-tree")
        reached = pairs.count()
        if reached == found:
            return pairs
        found = reached


def subtotals(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """Members that contain another member present in the same table and concept."""
    here = rows.select(*VIEW, "tag", "member").distinct()
    inside = here.join(tree, [*FILING, "role", "axis", "member"]).select(
        *VIEW, "tag", F.col("ancestor").alias("member")).distinct()
    return here.join(inside, [*VIEW, "tag", "member"], "left_semi")


def drop_subtotals(rows: DataFrame, tree: DataFrame) -> DataFrame:
    return rows.join(subtotals(rows, tree), [*VIEW, "tag", "member"], "left_anti")


def _rank():
    return F.when(F.col("qualifier") == "", 0).when(F.col("qualifier") == OPERATING_SEGMENTS, 1).otherwise(2)


def lead_view(rows: DataFrame) -> DataFrame:
    """One row per member, concept and period: the widest qualifier leads, gaps take their own best."""
    reach = rows.groupBy(*VIEW, "tag", "qualifier").agg(F.countDistinct("member").alias("n"))
    best = F.max_by("qualifier", F.struct("n", (-_rank()).alias("r"), "qualifier"))
    lead = reach.groupBy(*VIEW, "tag").agg(best.alias("lead"), F.sort_array(F.collect_set("qualifier")).alias("quals"))
    # a table has a handful of qualifiers, so the set is bounded by the taxonomy
    lead = lead.withColumn("others", F.array_except("quals", F.array("lead"))).drop("quals")
    order = F.struct((F.col("qualifier") != F.col("lead")).cast("int").alias("a"), _rank().alias("b"), F.col("qualifier").alias("c"))
    picked = rows.join(lead, [*VIEW, "tag"]).groupBy(*VIEW, "tag", *PERIOD, "member").agg(
        F.min_by(F.struct("val", "qualifier"), order).alias("p"), F.first("lead").alias("lead"), F.first("others").alias("others"))
    return picked.select(*VIEW, "tag", *PERIOD, "member", F.col("p.val").alias("val"), F.col("p.qualifier").alias("qualifier"),
                         "lead", "others")


def _with_consolidated(sums: DataFrame, consolidated: DataFrame) -> DataFrame:
    return sums.alias("s").join(
        consolidated.alias("c"), (F.col("s.cik") == F.col("c.cik")) & (F.col("s.accn") == F.col("c.accn"))
        & (F.col("s.tag") == F.col("c.tag")) & _same_period("s", "c"), "left").select("s.*", "c.consolidated")


def table_sums(rows: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Sum of the segment rows per table, concept and period, and whether the concept already closes.

    A concept closes when every period's rows sum to the consolidated figure, to the unit.
    """
    sums = rows.groupBy(*VIEW, "tag", *PERIOD).agg(F.sum("val").alias("seg"))
    s = _with_consolidated(sums, consolidated)
    exact = F.coalesce(F.col("seg") == F.col("consolidated"), F.lit(False))
    return s.withColumn("closes", F.min(exact).over(Window.partitionBy(*VIEW, "tag")))


def reconciling_rows(sums: DataFrame, recon: DataFrame, role_members: DataFrame) -> DataFrame:
    """Reconciling rows that belong beside the segment rows.

    Dropped: rows of a concept that already closes, a row equal to the sum of
    the segments, and the one row equal to the sum of at least two others.
    ``sums`` comes from ``table_sums``.
    """
    declared = role_members.where(F.col("axis") == QUALIFIER_AXIS).select(*FILING, "role", "member").distinct()
    tables = sums.where("NOT closes").select(*VIEW, "tag").distinct()
    cand = recon.join(declared, [*FILING, "member"]).join(tables, [*FILING, "role", "tag"])
    seg = sums.where("NOT closes").select(*VIEW, "tag", *PERIOD, "seg")
    c = cand.alias("c").join(seg.alias("s"), [F.col(f"c.{k}") == F.col(f"s.{k}") for k in [*VIEW, "tag"]] + [_same_period("c", "s")])
    c = c.where(F.col("c.val") != F.col("s.seg")).select("c.*")
    # the handful of reconciling rows of one table and period
    w = Window.partitionBy(*VIEW, "tag", *PERIOD)
    c = c.withColumn("is_sum", (F.count("*").over(w) >= 3) & (F.col("val") * 2 == F.sum("val").over(w)))
    c = c.withColumn("sums", F.count_if("is_sum").over(w)).where("NOT (is_sum AND sums = 1)")
    return c.select(*VIEW, "tag", *PERIOD, "member", "val")


def reconcile(rows: DataFrame, consolidated: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Keep a (view, concept) only if every period sums to within ``tol`` of consolidated."""
    s = _with_consolidated(rows, consolidated).withColumn(
        "total", F.sum("val").over(Window.partitionBy(*VIEW, "tag", *PERIOD)))
    off = F.abs(F.col("total") - F.col("consolidated"))
    fits = F.coalesce(off <= F.abs("consolidated") * tol, F.lit(False))
    return s.withColumn("ok", F.min(fits).over(Window.partitionBy(*VIEW, "tag"))).where("ok").drop("ok")


def clean_labels(rows: DataFrame, member_labels: DataFrame) -> DataFrame:
    """Filer's own words for a member; an exact taxonomy definition becomes a short label."""
    short = rows.sparkSession.createDataFrame(list(STANDARD_LABELS), "label string, short string")
    own = member_labels.groupBy(*FILING, "member").agg(F.min_by("label", F.struct("label_role", "label")).alias("label"))
    own = own.join(F.broadcast(short), "label", "left").select(*FILING, "member", F.coalesce("short", "label").alias("label"))
    bare = F.regexp_replace(F.regexp_replace("member", r"^[\w-]+:", ""), "Member$", "")
    return rows.join(own, [*FILING, "member"], "left").withColumn("label", F.coalesce("label", bare))


def assemble(rows: DataFrame, facts: DataFrame, role_members: DataFrame, tree: DataFrame, stage) -> DataFrame:
    """Rows on one axis -> kept tables with reconciling and consolidated figures.

    The chosen rows and their sums are each read more than once, so they are staged.
    """
    cons = consolidated_facts(facts)
    lead = stage(lead_view(drop_subtotals(views(rows, role_members), tree)), "lead-view")
    sums = stage(table_sums(lead, cons), "table-sums")
    recon = reconciling_rows(sums, reconciling_facts(facts), role_members)
    both = lead.withColumn("recon", F.lit(False)).unionByName(recon.withColumn("recon", F.lit(True)), allowMissingColumns=True)
    return reconcile(both, cons)


def crosstab_cells(facts: DataFrame) -> DataFrame:
    """Cells on exactly two breakdown axes, seen along either of them."""
    rows = _axis_parts(facts).where((F.size("cuts") == 2) & (F.size("quals") <= 1))
    turn = lambda a, b: F.struct(F.get("cuts", F.lit(a))["axis"].alias("axis"), F.get("cuts", F.lit(a))["member"].alias("member"),
                                 F.get("cuts", F.lit(b))["axis"].alias("along"), F.get("cuts", F.lit(b))["member"].alias("along_member"))
    return rows.select(*FILING, "tag", *PERIOD, "qualifier", "val", F.inline(F.array(turn(0, 1), turn(1, 0))))


def collapse_crosstab(facts: DataFrame) -> DataFrame:
    """Cells summed along the second axis.

    A member worth half of its line's sum is the sum of the others, so the second
    axis carries a total; the whole collapse of that concept is then refused.
    """
    line = [*FILING, "tag", *PERIOD, "qualifier", "axis", "member", "along"]
    over = Window.partitionBy(*line)
    cells = crosstab_cells(facts).withColumn("sum", F.sum("val").over(over)).withColumn("n", F.count("*").over(over))
    total = (F.col("n") >= 3) & (F.col("val") * 2 == F.col("sum")) & (F.col("val") != 0)
    sums = cells.groupBy(*line).agg(F.first("sum").alias("val"), F.max(total).alias("total"))
    refused = F.max("total").over(Window.partitionBy(*FILING, "tag", "axis", "along"))
    return sums.withColumn("refused", refused).where("NOT refused").select(*FILING, "tag", *PERIOD, "axis", "member", "qualifier", "along", "val")


def segment_tables(facts: DataFrame, role_members: DataFrame, member_labels: DataFrame, tree: DataFrame, stage) -> DataFrame:
    """All kept tables of every filer's newest annual report.

    Rows on one axis and collapsed cross-tabs go through the rules together, as a
    table knows what it lies along; collapsed ones then give way on every axis that
    has a kept table of its own.  ``facts`` are prepared by ``newest_annual``,
    ``allowed`` and ``dedupe``; ``tree`` is ``containment``'s; ``stage`` writes a
    table that is read several times.
    """
    rows = breakdown_facts(facts).unionByName(collapse_crosstab(facts))
    kept = stage(assemble(rows, facts, role_members, tree, stage), "kept-tables")
    single = kept.where("along = ''").select(*FILING, "axis").distinct()
    done = kept.where("along = ''").unionByName(kept.where("along <> ''").join(single, [*FILING, "axis"], "left_anti"))
    return clean_labels(done, member_labels).select(
        *VIEW, "tag", *PERIOD, "member", "label", "recon", "val", "qualifier", "lead", "others", "total", "consolidated")


def segment_coverage(tables: DataFrame, filers: DataFrame) -> DataFrame:
    """Filers with a reportable-segment table, and kept cells by how exactly they foot."""
    lines = tables.select(*VIEW, "tag", *PERIOD, "total", "consolidated").distinct()
    off = F.abs(F.try_divide(F.col("total") - F.col("consolidated"), F.col("consolidated")))
    band = F.when(F.col("total") == F.col("consolidated"), "exact").when(off <= 0.0005, "within 0.05%").otherwise("within 0.1%")
    cells = lines.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    have = tables.where(F.col("axis") == SEGMENT_AXIS).select("cik").distinct().agg(F.count("*").alias("n")).select(
        F.lit("filers with segments").alias("band"), "n")
    return cells.unionByName(have).unionByName(
        filers.agg(F.count("*").alias("n")).select(F.lit("filers").alias("band"), "n"))
