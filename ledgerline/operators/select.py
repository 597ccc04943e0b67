"""Fact selection: one best fact per line and period, for every filer at once.

The fact table is read and shuffled once.  ``observations`` folds it to one row per
distinct reading (filer, tag, unit, period shape, value); every later rule works on
that smaller table.  No rule gathers a group into an array whose length depends on
the data, and each top-1 is a combinable ``max`` over a struct.  A filer that owns a
third of all facts is dealt out by parts of its tags, and reduced to readings before
anything is shuffled by its key alone.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerline.dims import template as T
from ledgerline.dims.core import CORE_SECTIONS
from ledgerline.functions import columns as C
from ledgerline.plans.stage import unbroadcast
from ledgerline.sources.layout import PART, of_tags, part_of

PIN_LINE = next(line for sec in CORE_SECTIONS for line in sec.lines if line.pinned)
PIN_WHOLE = T.REVENUE_TAGS
PIN_PART = ("GrossProfit",)
REQUEST_KEY = ["cik", "end", "shape", "dmin", "dmax", "gate"]
# Requests are few and readings many, so each request is offered to this many slices of a filer's readings.
SLICES = 16


def _slice_of(*cols):
    return F.pmod(F.xxhash64(*cols), F.lit(SLICES)).cast("int")


def _every_slice():
    return F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))


def observations(facts: DataFrame) -> DataFrame:
    """Annotated facts -> distinct readings with everything the rules need to rank them.

    Facts are shuffled as they are, before the fold: a reading has some ten copies of
    what a fact has once, and few facts repeat one.  They are dealt by filer and part
    of the tags, and grouped in the order in which readings are written.
    """
    npos = (-F.col("pos")).alias("npos")
    filed_rank = F.struct("filed", "form_rank", npos, "accn", "form")
    plain = ~F.col("is_amendment")
    key = ["tag", "cik", "end", "unit", "unit_ord", "unit_ccy", "days", "is_duration", "is_periodic", "val"]
    rows = facts.where(F.col("end").isNotNull()).select(*key, "filed", "form_rank", "pos", "accn", "form", "is_amendment", part_of("tag").alias(PART))
    folded = rows.repartition("cik", PART).groupBy(PART, *key).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("form") == "10-Q").alias("n_10q"),
        F.max(filed_rank).alias("best"),
        F.max(F.when(plain, filed_rank)).alias("best_plain"),
        F.min(F.when(plain, F.col("accn"))).alias("accn_lo"),
        F.max(F.when(plain, F.col("accn"))).alias("accn_hi"),
        F.max(F.struct("filed", npos)).alias("late"),
        F.min(F.struct("filed", "pos")).alias("hist_first"),
        F.max(F.struct("filed", "pos")).alias("hist_last"),
        F.min(F.struct("pos", "accn", "form", "filed")).alias("first"),
    )
    return folded.select(*[c for c in folded.columns if c != PART], PART)


def annual_anchor_readings(obs: DataFrame, filers: DataFrame) -> DataFrame:
    """Annual periodic readings of the tags that date a filer's calendar.

    Folded per (filer, tag, end, currency) before the filer's industry is joined,
    so the join by filer alone sees a few dozen rows of even the largest filer.
    """
    rows = of_tags(obs, T.anchor_tags()).where(F.col("is_duration") & F.col("is_periodic") & C.is_annual())
    seen = F.min(F.struct("unit_ord", F.col("first.pos").alias("pos"), "days"))
    rows = rows.groupBy("cik", "tag", "end", "unit_ccy").agg(F.sum("n").alias("n"), seen.alias("seen"))
    return rows.join(filers.select("cik", "industry"), "cik").join(
        F.broadcast(T.period_tags(obs.sparkSession)), ["industry", "tag"])


def reporting_currency(obs: DataFrame, filers: DataFrame) -> DataFrame:
    """The currency most anchor facts use at the newest year end; USD loses a tie."""
    per = (annual_anchor_readings(obs, filers).where(F.col("unit_ccy").isNotNull())
           .groupBy("cik", "end", "unit_ccy").agg(F.sum(F.col("n") * F.col("times")).alias("n")))
    a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rank = F.struct("end", "n", (F.col("unit_ccy") != "USD").alias("foreign"),
                    F.translate("unit_ccy", a_to_z, a_to_z[::-1]).alias("back"), "unit_ccy")
    return per.groupBy("cik").agg(F.max(rank).alias("m")).select("cik", F.col("m.unit_ccy").alias("ccy"))


def annual_requests(periods: DataFrame) -> DataFrame:
    """Spans and balances asked for by the fiscal-year columns (cik, end, ccy)."""
    shapes = F.array(
        F.struct(F.lit("D").alias("shape"), F.lit(C.ANNUAL_MIN).alias("dmin"), F.lit(C.ANNUAL_MAX).alias("dmax"),
                 F.lit(True).alias("gate")),
        F.struct(F.lit("I").alias("shape"), F.lit(0).alias("dmin"), F.lit(0).alias("dmax"), F.lit(True).alias("gate")),
        F.struct(F.lit("D").alias("shape"), F.lit(C.ANNUAL_MIN).alias("dmin"), F.lit(C.ANNUAL_MAX).alias("dmax"),
                 F.lit(False).alias("gate")),
    )
    return periods.select("cik", "end", "ccy", F.inline(shapes))


def ltm_requests(windows: DataFrame) -> DataFrame:
    """Year-to-date legs and quarter-end balances asked for by the LTM columns."""
    leg = lambda end, days: F.struct(
        F.col(end).alias("end"), F.lit("D").alias("shape"), (F.col(days) - C.SPAN_SLACK).alias("dmin"),
        (F.col(days) + C.SPAN_SLACK).alias("dmax"), F.lit(True).alias("gate"))
    balance = F.struct(F.col("cur_end").alias("end"), F.lit("I").alias("shape"), F.lit(0).alias("dmin"),
                       F.lit(0).alias("dmax"), F.lit(True).alias("gate"))
    legs = F.array(leg("cur_end", "cur_days"), leg("prior_end", "prior_days"), balance)
    # neighbouring windows share a leg, hence the distinct
    return windows.select("cik", "ccy", F.inline(legs)).select(
        "cik", "end", "ccy", "shape", "dmin", "dmax", "gate").distinct()


def candidates(obs: DataFrame, requests: DataFrame) -> DataFrame:
    """Distinct values that answer a request, with the rank of their best filing.

    Readings in another currency stay as evidence (``wrong_ccy``) and never win.
    Requests without the currency gate serve the identity pin only.  Readings are
    sliced by (tag, value) so that no task receives all readings of a very large
    filer's year end; the slice is part of the group, so it costs no further shuffle.
    """
    pin_tags = sorted({*PIN_LINE.tags, *PIN_WHOLE, *PIN_PART})
    o = obs.where("is_periodic").withColumn("shape", F.when(F.col("is_duration"), "D").otherwise("I"))
    o = o.withColumn("slice", _slice_of("tag", "val"))
    r = unbroadcast(requests.withColumnRenamed("shape", "r_shape").withColumn("slice", _every_slice()))
    hit = o.join(r, ["cik", "end", "slice"]).where(
        (F.col("shape") == F.col("r_shape"))
        & ((F.col("shape") == "I") | F.col("days").between(F.col("dmin"), F.col("dmax")))
        & (F.col("gate") | F.col("tag").isin(pin_tags)))
    wrong = F.when(F.col("gate") & F.col("ccy").isNotNull() & (F.col("unit_ccy") != F.col("ccy")), F.col("unit_ccy"))
    ranked = lambda b: F.struct(
        F.col(f"{b}.filed").alias("filed"), F.col(f"{b}.form_rank").alias("form_rank"),
        (-F.col("unit_ord")).alias("nunit"), F.col(f"{b}.npos").alias("npos"), F.col(f"{b}.accn").alias("accn"),
        F.col(f"{b}.form").alias("form"), F.col("unit").alias("unit"), F.col("days").alias("days"))
    return hit.withColumn("wrong_ccy", wrong).groupBy(*REQUEST_KEY, "slice", "tag", "wrong_ccy", "val").agg(
        F.max(ranked("best")).alias("top"),
        F.max(F.when(F.col("best_plain").isNotNull(), ranked("best_plain"))).alias("plain"),
        F.min("accn_lo").alias("accn_lo"), F.max("accn_hi").alias("accn_hi"), F.max("unit_ord").alias("last_unit")).drop("slice")


def any_currency(cands: DataFrame) -> DataFrame:
    """What the candidates would be without the currency gate, for the requests where it shut something out.

    The readings that the gate kept as evidence are candidates of their own, so the
    readings are not asked again: values of all currencies are folded together.
    """
    shut = cands.where("gate AND wrong_ccy IS NOT NULL").select(*REQUEST_KEY).distinct()
    rows = cands.where("gate").join(shut, REQUEST_KEY, "left_semi")
    return rows.groupBy(*REQUEST_KEY, "tag", "val").agg(
        F.lit(None).cast("string").alias("wrong_ccy"), F.max("top").alias("top"), F.max("plain").alias("plain"),
        F.min("accn_lo").alias("accn_lo"), F.max("accn_hi").alias("accn_hi"), F.max("last_unit").alias("last_unit"))


def _winner(rank: str):
    return F.struct(*[F.col(f"{rank}.{f}").alias(f) for f in ("filed", "form_rank", "nunit", "npos")],
                    F.col("val").alias("val"),
                    *[F.col(f"{rank}.{f}").alias(f) for f in ("accn", "form", "unit", "days")])


def newest_filed(cands: DataFrame) -> DataFrame:
    """Newest filed value per request and tag, before amendments are checked."""
    return cands.where("wrong_ccy IS NULL").groupBy(*REQUEST_KEY, "tag").agg(F.max(_winner("top")).alias("w"))


def scale_slips(cands: DataFrame, winners: DataFrame) -> DataFrame:
    """Winning amendments next to the reports that contradict them.

    ``rival`` is the best report whose value, carried by at least two filings,
    differs by a whole power of ten; ``agreed`` says some report has the
    amendment's own value.  Two distinct filings exist exactly when the smallest
    and the largest accession differ, so no set of accessions is gathered.
    """
    amended = unbroadcast(winners.where(C.is_amendment(F.col("w.form"))).withColumn("slice", _every_slice()))
    reports = cands.where("wrong_ccy IS NULL AND plain IS NOT NULL").select(
        *REQUEST_KEY, "tag", "val", "plain", "accn_lo", "accn_hi", _slice_of("val").alias("slice"))
    pairs = amended.join(reports, [*REQUEST_KEY, "tag", "slice"])
    slipped = C.is_power_of_ten(F.col("w.val"), F.col("val")) & (F.col("accn_lo") != F.col("accn_hi"))
    return pairs.groupBy(*REQUEST_KEY, "tag").agg(
        F.max(F.col("val") == F.col("w.val")).alias("agreed"),
        F.max(F.when(slipped, _winner("plain"))).alias("rival"))


def tag_picks(cands: DataFrame) -> DataFrame:
    """The value each tag offers for each request, scale slips put right."""
    win = newest_filed(cands)
    slips = scale_slips(cands, win).where("rival IS NOT NULL AND NOT agreed").select(*REQUEST_KEY, "tag", "rival")
    # null-safe keys are not needed: no part of the key is ever null
    out = win.join(slips, [*REQUEST_KEY, "tag"], "left").withColumn("p", F.coalesce("rival", "w"))
    return out.select(*REQUEST_KEY, "tag", "p.val", "p.unit", "p.accn", "p.form", "p.filed", "p.days",
                      F.col("rival").isNotNull().alias("descaled"))


def pin_by_run(obs: DataFrame, periods: DataFrame, tags=PIN_LINE.tags) -> DataFrame:
    """Longest unbroken run of annual facts per tag over the sheet's calendar.

    ``periods.idx`` counts a filer's columns; at most eight exist, so the set of
    hit columns is a bounded array and the run is folded in place.
    """
    hits = (of_tags(obs, tags).where(F.col("is_duration") & F.col("is_periodic") & C.is_annual())
            .select("cik", "tag", "end").join(periods.select("cik", "end", "idx"), ["cik", "end"])
            .groupBy("cik", "tag").agg(F.sort_array(F.collect_set("idx")).alias("hit")))
    step = lambda acc, i: F.struct(
        i.alias("prev"), F.when(i == acc["prev"] + 1, acc["cur"] + 1).otherwise(1).alias("cur"),
        F.greatest(acc["best"], F.when(i == acc["prev"] + 1, acc["cur"] + 1).otherwise(1)).alias("best"))
    start = F.struct(F.lit(-9).alias("prev"), F.lit(0).alias("cur"), F.lit(0).alias("best"))
    return hits.select("cik", "tag", F.aggregate("hit", start, step)["best"].alias("run"))


def pin_by_identity(picks: DataFrame, tags=PIN_LINE.tags, whole=PIN_WHOLE, part=PIN_PART) -> DataFrame:
    """In how many periods a tag's value equals whole minus part (ungated picks)."""
    p = picks.where((F.col("shape") == "D") & ~F.col("gate"))
    first = lambda names: F.struct(
        (-F.array_position(F.array(*[F.lit(t) for t in names]), F.col("tag"))).alias("o"), F.col("val").alias("v"))
    named = lambda names: F.col("tag").isin(list(names))
    per = p.groupBy("cik", "end").agg(
        F.max(F.when(named(whole), first(whole)))["v"].alias("whole"),
        F.max(F.when(named(part), first(part)))["v"].alias("part"))
    want = F.col("whole") - F.col("part")
    near = F.abs(F.col("val") - want) <= F.greatest(F.abs("whole") * 1e-4, F.lit(1000.0))
    both = per.where("whole IS NOT NULL AND part IS NOT NULL")
    return p.where(named(tags)).join(both, ["cik", "end"]).groupBy("cik", "tag").agg(
        F.count_if(near).alias("score"))


def pin_order(runs: DataFrame, scores: DataFrame, periods: DataFrame, line=PIN_LINE) -> DataFrame:
    """Tag order of the pinned line per filer: identity first, else the longest run."""
    declared = F.array(*[F.struct(F.lit(line.key).alias("k"), F.lit(t).alias("tag"), F.lit(i).alias("declared"))
                         for i, t in enumerate(line.tags)])
    grid = periods.where("idx = 0").select("cik", F.inline(declared))  # three rows per filer
    full = grid.join(runs, ["cik", "tag"], "left").join(scores, ["cik", "tag"], "left").fillna(0, ["run", "score"])
    per_cik = Window.partitionBy("cik")
    full = full.withColumn("by_identity", F.max("score").over(per_cik) > 0)
    rank = F.when(F.col("by_identity"), F.col("score")).otherwise(F.col("run"))
    w = Window.partitionBy("cik").orderBy(rank.desc(), "declared")
    return full.withColumn("tag_ord", F.row_number().over(w) - 1).select(
        "cik", "k", "tag", F.col("run").cast("int").alias("run"), F.col("score").cast("int").alias("score"),
        "by_identity", F.col("tag_ord").cast("int").alias("tag_ord"))


def _with_lines(rows: DataFrame, pins: DataFrame | None) -> DataFrame:
    """Join tag-level rows (cik, industry, tag, shape) to the lines that try those tags."""
    lt = T.line_tags(rows.sparkSession).where("NOT latest").withColumn(
        "shape", F.when(F.col("is_instant"), "I").otherwise("D"))
    fixed = lt if pins is None else lt.where("NOT pinned")
    lines = rows.join(F.broadcast(fixed.select("industry", "tag", "shape", "k", "tag_ord", "prefer_nonzero")),
                      ["industry", "tag", "shape"])
    if pins is None:
        return lines
    pinned = rows.where(F.col("shape") == "D").join(pins.select("cik", "tag", "k", "tag_ord"), ["cik", "tag"])
    return lines.unionByName(pinned.withColumn("prefer_nonzero", F.lit(False)))


def line_cells(picks: DataFrame, cands: DataFrame, columns: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """Chosen tag per (filer, column, line), with and without the non-zero preference.

    ``columns`` holds (cik, industry, basis, end).  One aggregation takes the
    offers of every tag and, next to them, the evidence of other currencies.
    """
    cols = columns.select("cik", "industry", "basis", "end")
    annual = ((F.col("shape") == "I") | ((F.col("dmin") == C.ANNUAL_MIN) & (F.col("dmax") == C.ANNUAL_MAX))) & F.col("gate")
    fits = (F.col("shape") == "I") | (F.col("basis") == "FY")
    offers = picks.where(annual).join(cols, ["cik", "end"]).where(fits).select(
        "cik", "industry", "basis", "end", "shape", "tag", "val", "unit", "accn", "form", "filed", "days", "descaled",
        F.lit(None).cast("string").alias("wrong_ccy"), F.lit(None).cast("int").alias("last_unit"))
    foreign = cands.where(annual & F.col("wrong_ccy").isNotNull()).groupBy(
        "cik", "end", "shape", "tag").agg(F.max(F.struct("last_unit", "wrong_ccy")).alias("m")).join(
        cols, ["cik", "end"]).where(fits).select(
        "cik", "industry", "basis", "end", "shape", "tag", "m.wrong_ccy", "m.last_unit")
    rows = _with_lines(offers.unionByName(foreign, allowMissingColumns=True), pins)
    offer = F.col("wrong_ccy").isNull()
    body = F.struct("tag", "val", "unit", "accn", "form", "filed", "days", "descaled")
    zero_last = F.when(F.col("prefer_nonzero") & (F.col("val") == 0), 0).otherwise(1)
    return rows.groupBy("cik", "industry", "basis", "end", "k").agg(
        F.max_by(F.when(offer, body), F.when(offer, F.struct(zero_last.alias("z"), (-F.col("tag_ord")).alias("o")))).alias("pick"),
        F.max_by(F.when(offer, body), F.when(offer, -F.col("tag_ord"))).alias("plain_pick"),
        F.max_by("wrong_ccy", F.when(~offer, F.struct("tag_ord", "last_unit"))).alias("other_ccy"))


def tags_seen(obs: DataFrame, filers: DataFrame) -> DataFrame:
    """Lines for which the filer has used at least one candidate tag, in any period."""
    lt = T.line_tags(obs.sparkSession).select("industry", "tag", "k")
    return (obs.select("cik", "tag").distinct().join(filers.select("cik", "industry"), "cik")
            .join(F.broadcast(lt), ["industry", "tag"]).select("cik", "k").distinct())


def fetched_grid(columns: DataFrame) -> DataFrame:
    """Every fetched line of every column; a template-sized multiple of the columns."""
    lines = T.template_lines(columns.sparkSession).where("how = 'fetched' AND size(tags) > 0").select(
        "industry", "k", "is_instant", "latest")
    return columns.join(F.broadcast(lines), "industry")


def classify_blanks(cells: DataFrame, columns: DataFrame, seen: DataFrame) -> DataFrame:
    """Put a status on every requested cell: reported, or why it is blank."""
    grid = fetched_grid(columns.select("cik", "industry", "basis", "end")).where("NOT latest").where(
        "is_instant OR basis = 'FY'")
    full = (grid.join(cells.drop("industry"), ["cik", "basis", "end", "k"], "left")
            .join(seen.withColumn("seen", F.lit(True)), ["cik", "k"], "left"))
    status = (F.when(F.col("pick").isNotNull(), "reported").when(F.col("other_ccy").isNotNull(), "other-currency")
              .when(F.col("seen"), "untagged-this-period").otherwise("never-tagged"))
    return full.select(
        "cik", "industry", "basis", "end", "k", "is_instant", F.col("pick.val").alias("value"),
        F.col("pick.unit").alias("unit"), F.col("pick.tag").alias("tag"), F.col("pick.accn").alias("accn"),
        F.col("pick.form").alias("form"), F.col("pick.filed").alias("filed"),
        F.when(F.col("pick.days").isNotNull(), F.date_sub("end", F.col("pick.days"))).alias("start"),
        F.coalesce("pick.descaled", F.lit(False)).alias("descaled"), status.alias("status"),
        F.when(status == "other-currency", F.col("other_ccy")).alias("ccy"), "plain_pick")


def latest_facts(obs: DataFrame, filers: DataFrame) -> DataFrame:
    """Newest fact per line marked latest: no form, currency or shape filter."""
    lt = T.line_tags(obs.sparkSession).where("latest").select("industry", "tag", "k", "tag_ord")
    tags = sorted({t for r in T.template_rows() if r[11] for t in r[14]})
    # one candidate per (filer, tag) is left before the filer's industry is joined
    rank = F.struct("end", (-F.col("unit_ord")).alias("u"), (-F.col("first.pos")).alias("p"))
    body = F.struct(F.col("val").alias("value"), "unit", "tag", F.col("first.accn").alias("accn"),
                    F.col("first.form").alias("form"), F.col("first.filed").alias("filed"), F.col("end").alias("fact_end"))
    newest = of_tags(obs, tags).groupBy("cik", "tag").agg(F.max_by(body, rank).alias("b"))
    rows = newest.join(filers.select("cik", "industry"), "cik").join(F.broadcast(lt), ["industry", "tag"])
    best = F.struct(F.col("b.fact_end").alias("e"), (-F.col("tag_ord")).alias("o"))
    return rows.groupBy("cik", "k").agg(F.max_by("b", best).alias("b")).select("cik", "k", "b.*")


def debt_scope(obs: DataFrame, tags=None) -> DataFrame:
    """Whether a long-term debt tag already includes the current portion.

    One pass over balances keeps the latest filed value of each tag and date;
    the reference legs are spread beside them by a plain equi-join on the date.
    """
    lines = [r for r in T.template_rows() if r[0] == "corporate" and r[7] == "ltDebt"][0][14]
    tags = list(tags or [t for t in lines if t not in ("LongTermDebtNoncurrent", "ConvertibleDebtNoncurrent")])
    legs = ["LongTermDebtNoncurrent", "LongTermDebtCurrent"]
    rank = F.struct(F.col("late.filed").alias("filed"), (-F.col("unit_ord")).alias("u"), F.col("late.npos").alias("p"))
    at = (of_tags(obs, [*tags, *legs]).where(~F.col("is_duration") & F.col("is_periodic"))
          .groupBy("cik", "tag", "end").agg(F.max_by("val", rank).alias("val")))
    leg = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.col("val"))).alias(name)
    totals = F.map_from_entries(F.collect_list(F.when(F.col("tag").isin(tags), F.struct("tag", "val"))))
    # a date holds at most one value per listed tag, so the map is bounded by the list
    per = at.groupBy("cik", "end").agg(leg(legs[0], "n"), leg(legs[1], "c"), totals.alias("t"))
    rows = per.where("n IS NOT NULL").select("cik", "n", "c", F.explode("t").alias("tag", "t"))
    verdict = F.when(C.nearly("t", "n"), "excludes").when(
        F.col("c").isNotNull() & C.nearly(F.col("t"), F.col("n") + F.col("c")), "includes")
    rows = rows.withColumn("verdict", verdict).where("verdict IS NOT NULL")
    return rows.groupBy("cik", "tag").agg(F.min("verdict").alias("lo"), F.max("verdict").alias("hi")).select(
        "cik", "tag", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("scope"))
