"""Filing-shaped tables derived from the star-schema tables of TESTDATA.md.

Suppliers act as filers and their monthly sales as the figures they report.
``lineitem`` is reduced to one row per supplier and month in a single pass with
map-side partial sums; everything after that is small next to the input.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerline.functions import columns as C
from ledgerline.sources import readers
from ledgerline.sources.recipes import (
    BALANCES, DUAL_CURRENCY, REVENUE_LIKE, SIC_BY_REMAINDER, SPANS)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last calendar year of the sales; the last one is taken to be unfinished."""
    y = F.year("l_shipdate")
    lo, hi = load(spark, sf_dir, "lineitem").agg(F.min(y), F.max(y)).first()
    return (0, 0) if lo is None else (lo, hi)


def ticker_of(key):
    """A ticker of letters only: the digits of a supplier key spelled A to J."""
    return F.concat(F.lit("S"), F.translate(F.col(key).cast("string"), "0123456789", "ABCDEFGHIJ"))


def _industry_code(cik="cik"):
    code = F.lit(SIC_BY_REMAINDER[0])
    for r, sic in enumerate(SIC_BY_REMAINDER[1:], start=1):
        code = F.when(F.col(cik) % 7 == r, sic).otherwise(code)
    return code


def filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    return readers.with_industry(s.select(
        F.col("s_suppkey").alias("cik"), F.col("s_name").alias("name"),
        F.array(ticker_of("s_suppkey")).alias("tickers"),
        F.lit("synthetic").alias("sic"),
        _industry_code("s_suppkey").alias("sic_code"), F.lit("1231").alias("fiscal_year_end")))


def by_filer(df: DataFrame) -> DataFrame:
    """df dealt by filer, for tables of a bounded number of rows a filer that are then fanned out."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cik")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cik"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("ym"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("q"), "l_returnflag", "l_linestatus")
    kept, done = F.col("l_returnflag") != "R", F.col("l_linestatus") == "F"
    part = lambda cond: F.sum(F.when(cond, F.col("cents")).otherwise(F.lit(0).cast("long")))
    return li.groupBy("cik", "ym").agg(
        F.sum("cents").alias("rev_all"), part(kept).alias("rev_cut"), part(done).alias("fin_all"),
        part(kept & done).alias("fin_cut"), F.sum("q").alias("qty"))


# Months after which the first three quarters end: thirteen weeks each, or four, three and two months.
QUARTER_MONTHS, UNEVEN_MONTHS = (3, 6, 9), (4, 7, 9)


def _period_rows(y0: int, y1: int) -> list:
    """(kind, yr, q, start year-month, end year-month, of filers with uneven quarters) with months counted from year zero.

    Full years are reported from the first on, June years in the second to fourth,
    quarters to date from the third on and single quarters in the last two.
    """
    rows = []
    for y in range(y0, y1):
        rows.append(("FY", y, 4, y * 12, y * 12 + 11, None))
        rows.append(("INST", y, 4, 0, y * 12 + 11, None))
    for y in range(y0 + 1, min(y0 + 4, y1)):
        rows.append(("JUN", y, 2, y * 12 - 6, y * 12 + 5, None))
    for uneven, months in ((False, QUARTER_MONTHS), (True, UNEVEN_MONTHS)):
        for y in range(y0 + 2, y1 + 1):
            for q, (before, m) in enumerate(zip((0, *months), months), 1):
                rows.append(("YTD", y, q, y * 12, y * 12 + m - 1, uneven))
                rows.append(("INST", y, q, 0, y * 12 + m - 1, uneven))
                if q > 1 and y >= y1 - 1:
                    rows.append(("QTR", y, q, y * 12 + before, y * 12 + m - 1, uneven))
    return rows


def _reported_periods(spark, sf_dir, y0, y1):
    """Sums of every period that a filer reports, with its dates.

    Filers of one group have quarters of different length, those of another end
    their year some days before the month does (52 and 53 weeks), and two groups'
    newest report is of the first or second quarter.
    """
    # the period list is short (some ten a year), so each month picks its periods in place, without a join
    listed = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(yr).alias("yr"), F.lit(q).alias("q"), F.lit(a).alias("ym0"), F.lit(b).alias("ym1"), F.lit(odd).cast("boolean").alias("odd"))
        for kind, yr, q, a, b, odd in _period_rows(y0, y1)])
    hit = F.filter(listed, lambda p: F.col("ym").between(p["ym0"], p["ym1"]) & (p["odd"].isNull() | (p["odd"] == (F.col("cik") % 9 == 4))))
    # a month counts in some thirty periods: months are dealt by filer, a few dozen each, so that their sums need no shuffle
    sums = by_filer(monthly(spark, sf_dir)).select("*", F.inline(hit)).groupBy("cik", "kind", "yr", "q", "ym0", "ym1").agg(
        *[F.sum(c).alias(c) for c in ("rev_all", "rev_cut", "fin_all", "fin_cut", "qty")])
    cik, yr, q, kind = F.col("cik"), F.col("yr"), F.col("q"), F.col("kind")
    first_day = F.make_date((F.col("ym0") / 12).cast("int"), (F.col("ym0") % 12 + 1).cast("int"), F.lit(1))
    last_day = F.last_day(F.make_date((F.col("ym1") / 12).cast("int"), (F.col("ym1") % 12 + 1).cast("int"), F.lit(1)))
    early = lambda y: F.when((cik % 9 == 7) & (kind != "JUN"), y % 5).otherwise(0)
    opened = early(F.when(kind == "QTR", yr).otherwise(yr - 1))
    sums = sums.withColumn("start", F.when(kind != "INST", F.date_sub(first_day, opened))).withColumn("end", F.date_sub(last_day, early(yr)))
    quarterly = kind.isin("YTD", "QTR") | ((kind == "INST") & (q < 4))
    return sums.where(
        ~(quarterly & (cik % 8 == 6))
        & ~(quarterly & (yr == y1) & (((cik % 9 == 1) & (q > 1)) | ((cik % 9 == 2) & (q > 2))))
        & ~((kind == "FY") & (yr == y1 - 3) & (cik % 15 == 8))
        & ~((kind == "JUN") & (cik % 6 != 1)))


def _versions(y1):
    """The filings in which one period appears, as an array of structs."""
    cik, yr, q, kind = F.col("cik"), F.col("yr"), F.col("q"), F.col("kind")
    annual_form = F.when(cik % 20 == 5, "20-F").otherwise("10-K")
    yearly = (kind == "FY") | ((kind == "INST") & (q == 4))
    interim = kind.isin("YTD", "QTR") | ((kind == "INST") & (q < 4))

    def filing(cond, form, filed, seq, year, cut, num, den, only=None):
        return F.when(cond, F.struct(
            form.alias("form"), filed.alias("filed"), F.lit(seq).cast("int").alias("seq"),
            year.cast("int").alias("accn_year"), cut.alias("cut"), F.lit(num).cast("long").alias("vnum"),
            F.lit(den).cast("long").alias("vden"), F.lit(only).cast("string").alias("only")))

    feb = lambda y: F.make_date(y, F.lit(2), F.lit(15))
    qdate = lambda y: F.make_date(y, q * 3 + 2, F.lit(10))
    never, restated_fy, restated_q = F.lit(False), cik % 4 == 0, cik % 2 == 0
    proxy = F.make_date(yr + 1, F.lit(4), F.lit(30))
    out = [
        filing(yearly, annual_form, feb(yr + 1), 1, yr + 1, never, 1, 1),
        filing(yearly & (yr + 2 <= y1), annual_form, feb(yr + 2), 1, yr + 2, restated_fy, 1, 1),
        filing(yearly & (kind == "FY") & (yr + 3 <= y1), annual_form, feb(yr + 3), 1, yr + 3, restated_fy, 1, 1),
        filing((kind == "FY") & (cik % 5 == 0), F.lit("DEF 14A"), proxy, 9, yr + 1, never, 3, 1, "revenue"),
        filing((kind == "FY") & (cik % 10 == 7) & (yr == y1 - 3), F.lit("10-K/A"),
               F.make_date(F.lit(y1 - 2), F.lit(12), F.lit(1)), 8, F.lit(y1 - 2), never, 1000000, 1, "revenue"),
        filing((kind == "FY") & (cik % 10 == 3) & (yr == y1 - 4), F.lit("10-K/A"),
               F.make_date(F.lit(y1), F.lit(12), F.lit(1)), 8, F.lit(y1), never, 11, 10, "revenue"),
        # the newest balance sheet's liabilities are filed again, some of them changed
        filing((kind == "INST") & (q == 4) & (yr == y1 - 1) & (cik % 22 == 5), F.lit("10-K/A"), F.make_date(F.lit(y1), F.lit(6), F.lit(1)), 8, F.lit(y1), never, 11, 10, "liabilities"),
        filing((kind == "INST") & (q == 4) & (yr == y1 - 1) & (cik % 22 == 16), F.lit("10-K/A"), F.make_date(F.lit(y1), F.lit(6), F.lit(1)), 8, F.lit(y1), never, 1, 1, "liabilities"),
        filing(kind == "JUN", F.lit("10-K"), F.make_date(yr, F.lit(9), F.lit(1)), 6, yr, never, 1, 1, "revenue"),
        filing(interim, F.lit("10-Q"), qdate(yr), 1, yr, never, 1, 1),
        filing((kind == "YTD") & (yr < y1), F.lit("10-Q"), qdate(yr + 1), 1, yr + 1, restated_q, 1, 1),
    ]
    return F.array_compact(F.array(*out))


def _reported(recipes, y0):
    """The lines a filer reports for a period, as an array of structs."""
    made = [
        F.when(F.expr(cond.format(y0=y0)), F.struct(
            F.lit(tag).alias("tag"), F.lit(unit).alias("unit0"), F.lit(measure).alias("measure"),
            F.lit(num).cast("long").alias("num"), F.lit(den).cast("long").alias("den")))
        for tag, unit, measure, num, den, cond in recipes]
    return F.array_compact(F.array(*made))


def raw_facts(spark: SparkSession, sf_dir: str, span: tuple[int, int]) -> DataFrame:
    """Facts in the shape of ``readers.read_company_facts``; ``span`` is ``years``'."""
    y0, y1 = span
    # a filer has some seven periods a year and each fans out some forty-fold, so the fan-out gets every core
    p = _reported_periods(spark, sf_dir, y0, y1).repartition(spark.sparkContext.defaultParallelism, "cik", "ym1")
    p = p.withColumn("industry", C.industry_of(_industry_code().cast("int")))
    lines = F.when(F.col("kind") == "INST", _reported(BALANCES, y0)).otherwise(_reported(SPANS, y0))
    rows = (p.withColumn("ver", F.explode(_versions(y1))).select("*", "ver.*").drop("ver")
            .withColumn("line", F.explode(lines)).select("*", "line.*").drop("line"))
    rows = rows.where(F.col("only").isNull() | ((F.col("only") == "revenue") & F.col("tag").isin(REVENUE_LIKE)) | ((F.col("only") == "liabilities") & (F.col("tag") == "Liabilities")))
    rev = F.when(F.col("cut"), F.col("rev_cut")).otherwise(F.col("rev_all"))
    fin = F.when(F.col("cut"), F.col("fin_cut")).otherwise(F.col("fin_all"))
    measure = (F.when(F.col("measure") == "rev", rev).when(F.col("measure") == "fin", fin)
               .when(F.col("measure") == "gp", rev - fin).otherwise(F.col("qty")))
    rows = rows.withColumn("m", measure).withColumn("whole", F.expr("(m * num div den) * vnum div vden"))
    # currencies: a euro filer, a euro-only line, and lines reported in both
    cik, tag = F.col("cik"), F.col("tag")
    dual = (cik % 10 == 0) & tag.isin(DUAL_CURRENCY) & (F.col("unit0") == "USD")
    euro = (cik % 20 == 5) | ((cik % 10 == 0) & (tag == "InterestExpense"))
    unit = F.when(euro, F.regexp_replace("unit0", "USD", "EUR")).otherwise(F.col("unit0"))
    one = F.struct(unit.alias("unit"), F.when(dual, 1).otherwise(0).alias("unit_ord"), F.lit(1).cast("long").alias("k"))
    two = F.when(dual, F.struct(F.lit("EUR").alias("unit"), F.lit(0).alias("unit_ord"),
                                F.lit(2).cast("long").alias("k")))
    rows = rows.withColumn("u", F.explode(F.array_compact(F.array(one, two)))).select("*", "u.*")
    epoch = F.to_date(F.lit("1990-01-01"))
    span = F.coalesce(F.date_diff("end", "start"), F.lit(0))
    pos = ((F.date_diff("end", epoch).cast("long") * 20000 + F.date_diff("filed", epoch)) * 1000 + span)
    accn = F.concat(F.lpad(cik.cast("string"), 10, "0"), F.lit("-"),
                    F.lpad((F.col("accn_year") % 100).cast("string"), 2, "0"), F.lit("-"),
                    F.lpad((F.when(F.col("form") == "10-Q", F.month("filed")).otherwise(0) * 10
                            + F.col("seq")).cast("string"), 6, "0"))
    ns = F.when(tag == "EntityCommonStockSharesOutstanding", "dei").when(tag == "Supplies", "ext").otherwise("us-gaap")
    return rows.select(
        "cik", ns.alias("ns"), "tag", tag.alias("label"), "unit", "unit_ord", pos.alias("pos"), "start", "end",
        (F.col("whole") * F.col("k")).cast("double").alias("val"), accn.alias("accn"),
        F.year("end").alias("fy"), F.when(F.col("q") == 4, "FY").otherwise(
            F.concat(F.lit("Q"), F.col("q").cast("string"))).alias("fp"), "form", "filed")


def filings(spark: SparkSession, sf_dir: str, span: tuple[int, int]) -> DataFrame:
    """One filing list per filer: a report each February, quarterly reports, some late ones."""
    y0, y1 = span
    years = F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("y")
    per_year = filers(spark, sf_dir).select("cik", years)
    kinds = F.explode(F.array(*[F.lit(k) for k in ("10-K", "10-Q", "8-K", "S-1")])).alias("kind")
    rows = per_year.select("cik", "y", kinds)
    cik, y, kind = F.col("cik"), F.col("y"), F.col("kind")
    rows = rows.where((kind != "10-K") | (y < y1) | (cik % 14 == 9) | (cik % 20 == 5))
    late = (kind == "10-K") & (y == y1)
    form = (F.when(late & (cik % 20 == 5), "20-F").when(late, "10-KT/A")
            .when((kind == "10-K") & (cik % 20 == 5), "20-F").otherwise(kind))
    month = F.when(kind == "10-K", F.when(late & (cik % 20 != 5), 5).otherwise(12)).when(kind == "10-Q", 9).otherwise(6)
    period = F.last_day(F.make_date(y, month, F.lit(1)))
    filed = F.date_add(period, 46)
    seq = F.when(kind == "10-K", 1).when(kind == "10-Q", 112).when(kind == "8-K", 7).otherwise(5)
    accn = F.concat(F.lpad(cik.cast("string"), 10, "0"), F.lit("-"),
                    F.lpad((F.year(filed) % 100).cast("string"), 2, "0"), F.lit("-"),
                    F.lpad(seq.cast("string"), 6, "0"))
    order = ((F.lit(y1) - y) * 4 + F.when(kind == "10-K", 0).when(kind == "10-Q", 1).when(kind == "8-K", 2)
             .otherwise(3)).cast("int")
    return rows.select("cik", order.alias("filing_ord"), form.alias("form"), filed.alias("filed"), accn.alias("accn"),
                       F.concat(F.lower(F.translate(form, "/", "")), F.lit(".htm")).alias("doc"), period.alias("period"))


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker per supplier; some point at an empty successor (customer keys above the suppliers)."""
    s = load(spark, sf_dir, "supplier")
    moved = F.col("s_suppkey") % 25 == 6
    return s.select(
        F.when(moved, F.col("s_suppkey") + 1000000).otherwise(F.col("s_suppkey")).alias("cik"),
        ticker_of("s_suppkey").alias("ticker"), F.col("s_name").alias("title"))


def predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").where("s_suppkey % 25 = 6")
    return s.select(ticker_of("s_suppkey").alias("ticker"),
                    F.col("s_suppkey").alias("cik"), F.col("s_name").alias("title"))


def successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, pred_cik) of the empty successors that tickers point at; every second line has another empty filer in between."""
    k = F.col("s_suppkey")
    s = load(spark, sf_dir, "supplier").where("s_suppkey % 25 = 6")
    plain = F.array(F.struct((k + 1000000).alias("cik"), k.alias("pred_cik")))
    long = F.array(F.struct((k + 1000000).alias("cik"), (k + 2000000).alias("pred_cik")), F.struct((k + 2000000).alias("cik"), k.alias("pred_cik")))
    return s.select(F.inline(F.when(k % 50 == 31, long).otherwise(plain)))


def typed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, ord, text): the tickers of each nation's suppliers as readers type them, with blanks, repetitions and an unknown one."""
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("set_id"))
    k, ticker = F.col("s_suppkey"), ticker_of("s_suppkey")
    s = load(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    typed = lambda at, text: F.struct(at.cast("long").alias("ord"), text.alias("text"))
    first = typed(k * 10, F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower(ticker))).otherwise(ticker))
    again = F.when(k % 10 == 0, typed(k * 10 + 1, ticker))
    rows = s.select("set_id", F.inline(F.array_compact(F.array(first, again))))
    odd = F.array(typed(F.lit(0), F.lit("nosuch")), typed(F.lit(1), F.lit("  ")))
    return rows.unionByName(nation.select("set_id", F.inline(odd)))


def typed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): what the customers type to find a supplier, by name, number, ticker or a digit or two."""
    k = F.col("c_custkey")
    text = (F.when(k % 4 == 0, F.concat(F.lit(" supplier"), F.expr("substring(c_name, 9)"))).when(k % 4 == 1, F.expr("substring(c_name, 14)"))
            .when(k % 4 == 2, F.lower(ticker_of("c_custkey"))).when(k % 8 == 3, F.expr("right(c_name, 1)")).otherwise(F.expr("right(c_name, 2)")))
    return load(spark, sf_dir, "customer").select(k.alias("query_id"), text.alias("query"))


def ticker_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections: every customer of one segment is added, every 25th supplier is re-titled."""
    s = load(spark, sf_dir, "supplier").where("s_suppkey % 25 = 3").select(
        ticker_of("s_suppkey").alias("ticker"), F.col("s_suppkey").alias("cik"),
        F.concat(F.lit("Corrected "), "s_name").alias("title"))
    c = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_custkey").alias("cik"),
        F.col("c_name").alias("title"))
    return s.unionByName(c)


def quotes(spark: SparkSession, sf_dir: str, span: tuple[int, int]) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    at = F.make_date(F.lit(span[1]), F.lit(11), F.lit(5)).cast("timestamp")
    k = F.col("s_suppkey")
    tick = F.when(k % 23 == 4, 0).otherwise(k % 97 + 1).cast("double")
    now = s.select(F.lower(ticker_of("s_suppkey")).alias("symbol"), tick.alias("price"), at.alias("at"))
    old = s.where("s_suppkey % 2 = 0").select(ticker_of("s_suppkey").alias("symbol"),
                                              F.lit(9999.0).alias("price"), (at - F.expr("interval 1 day")).alias("at"))
    return now.unionByName(old)


# Report names of the synthetic filing summaries.
REPORT_NAMES = (
    "Cover page", "CONSOLIDATED STATEMENTS OF EARNINGS", "CONSOLIDATED STATEMENTS OF COMPREHENSIVE INCOME",
    "CONSOLIDATED BALANCE SHEETS", "CONSOLIDATED STATEMENTS OF CASH FLOWS",
    "CONSOLIDATED STATEMENTS OF STOCKHOLDERS EQUITY", "Income Taxes", "Debt and Borrowings", "Leases",
    "Segment &amp; Geographic Information", "Stock-Based Compensation", "Retirement Benefits and Pension",
)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing summaries as text; every ninth filer's filing predates them."""
    f = filers(spark, sf_dir)
    cik = F.col("cik")
    reports = [
        F.when((cik + i) % 5 != 0, F.concat(
            F.lit(f'<Report instance="{i}"><HtmlFileName>R{i}.htm</HtmlFileName>'),
            F.lit("" if i == 0 else f"<ShortName> {name} </ShortName>"), F.lit("</Report>"))).otherwise("")
        for i, name in enumerate(REPORT_NAMES)]
    xml = F.concat(F.lit("<FilingSummary><MyReports>"), *reports, F.lit("</MyReports></FilingSummary>"))
    accn = F.concat(F.lpad(cik.cast("string"), 10, "0"), F.lit("-01-000001"))
    return f.select("cik", accn.alias("accn"), F.when(cik % 9 != 4, xml).alias("xml"))


def form_index_lines(spark: SparkSession, sf_dir: str, span: tuple[int, int]) -> DataFrame:
    """The filing list printed as a fixed-width quarterly index, under slightly changed names."""
    f = filings(spark, sf_dir, span).join(filers(spark, sf_dir).select("cik", "name"), "cik")
    company = F.when(F.col("cik") % 4 == 1, F.concat(F.upper("name"), F.lit(" Corp"))).otherwise(F.col("name"))
    path = F.concat(F.lit("edgar/data/"), F.col("cik").cast("string"), F.lit("/"), F.col("accn"), F.lit(".txt"))
    return f.select(F.concat(
        F.rpad("form", 12, " "), F.rpad(company, 40, " "), F.rpad(F.col("cik").cast("string"), 12, " "),
        F.rpad(F.date_format("filed", "yyyy-MM-dd"), 12, " "), path).alias("value"))


# The documents below hold the tables above as filers send them, some of them spoiled by fixed conditions on the filer.

def _cut(text, when):
    """A text that ends half way."""
    return F.when(when, F.expr("substring(value, 1, length(value) div 2)")).otherwise(text)


def company_documents(raw: DataFrame) -> DataFrame:
    """Facts as nested documents (value), one per filer and concept: a group holds the facts of one concept.

    Spoiled: whole documents, starts, filing dates and values of some filers.
    """
    cik, tag = F.col("cik"), F.col("tag")
    text = lambda c: F.col(c).cast("string")
    fact = F.struct(
        F.when((cik % 43 == 5) & (tag == "InterestExpense"), F.concat(F.year("start").cast("string"), F.lit("-13-01"))).otherwise(text("start")).alias("start"),
        text("end").alias("end"),
        F.when((cik % 53 == 2) & (tag == "Liabilities"), F.lit("n/a")).otherwise(F.format_string("%.0f", "val")).alias("val"),
        "accn", "fy", "fp", "form", F.when((cik % 47 == 3) & (tag == "ProfitLoss"), F.lit("soon")).otherwise(text("filed")).alias("filed"))
    # facts are dealt by document before they become text, so that neither list of them is shuffled
    raw = raw.drop("label").repartition("cik", "ns", "tag")
    by_unit = raw.groupBy("cik", "ns", "tag", "unit", "unit_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "accn", "val", fact.alias("f")))), lambda x: x["f"]).alias("facts"))
    units = F.transform(F.array_sort(F.collect_list(F.struct("unit_ord", "unit", "facts"))), lambda u: F.struct(u["unit"].alias("key"), u["facts"].alias("value")))
    by_tag = by_unit.groupBy("cik", "ns", "tag").agg(F.map_from_entries(units).alias("units"))
    body = F.struct("cik", F.create_map("ns", F.create_map("tag", F.struct(tag.alias("label"), "units"))).alias("facts"))
    docs = by_tag.select("cik", "tag", F.to_json(body).alias("value"))
    return docs.select(_cut(F.col("value"), (cik % 41 == 7) & (tag == "Assets")).alias("value"))


def filing_documents(spark: SparkSession, sf_dir: str, span: tuple[int, int]) -> DataFrame:
    """Filing lists as parallel arrays (value), one document per filer.

    Spoiled: whole documents, the last of some filers' dates, single dates.
    """
    cik = F.col("cik")
    filed = F.when((cik % 23 == 6) & (F.col("filing_ord") % 5 == 2), F.lit("1999-02-31")).otherwise(F.col("filed").cast("string"))
    f = filings(spark, sf_dir, span).select("cik", F.struct("filing_ord", "form", filed.alias("filed"), "accn", "doc", F.col("period").cast("string").alias("period")).alias("f"))
    lists = f.groupBy("cik").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    column = lambda c: F.transform("fs", lambda x: x[c])
    dates = F.when(cik % 19 == 4, F.slice(column("filed"), F.lit(1), F.size("fs") - 1)).otherwise(column("filed"))
    recent = F.struct(column("form").alias("form"), dates.alias("filingDate"), column("accn").alias("accessionNumber"),
                      column("doc").alias("primaryDocument"), column("period").alias("reportDate"))
    docs = lists.select("cik", F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings"))).alias("value"))
    return docs.select(_cut(F.col("value"), cik % 29 == 8).alias("value"))


def ticker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ticker list, each line a list of one row."""
    row = F.to_json(F.array(F.col("cik").cast("string"), F.col("ticker"), F.col("title")))
    return tickers(spark, sf_dir).select(F.concat(F.lit("["), row, F.lit("]")).alias("value"))


def spoiled_ticker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticker list, one row a line; some rows lack a value, a number, or their end."""
    t, n = tickers(spark, sf_dir), F.regexp_extract("title", r"(\d+)$", 1).cast("bigint")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    first = F.when(n % 31 == 8, F.concat(F.lit('"x'), F.col("cik").cast("string"), F.lit('"'))).otherwise(F.col("cik").cast("string"))
    whole = F.concat(F.lit("["), F.concat_ws(",", first, F.when(n % 37 != 5, quoted("ticker")), quoted("title")), F.lit("],"))
    return t.select(F.when(n % 43 == 9, F.expr("substring(title, 1, 4)")).otherwise(whole).alias("value"))


def spoiled_index_lines(spark: SparkSession, sf_dir: str, span: tuple[int, int]) -> DataFrame:
    """The printed index with its heading; some 8-K lines have no day or no filer."""
    lines = form_index_lines(spark, sf_dir, span)
    filer = F.regexp_extract("value", r"edgar/data/(\d+)/", 1).cast("bigint")
    event = F.col("value").startswith("8-K ")
    spoiled = F.when(event & (filer % 17 == 3), F.regexp_replace("value", r"-\d\d(\s+edgar)", "-99$1")).when(
        event & (filer % 17 == 5), F.regexp_replace("value", r"\s+\d+\s+(\d{4}-)", "  $1")).otherwise(F.col("value"))
    heading = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("Form Type   Company Name   CIK   Date Filed   File Name", "-" * 60, "")])).alias("value"))
    return lines.select(spoiled.alias("value")).unionByName(heading)


def segment_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per supplier, year, part type and customer region."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_suppkey").alias("cik"), F.year("l_shipdate").alias("yr"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("ptype"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    where = (load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
             .join(load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
             .join(load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")),
                   "n_regionkey").select("c_custkey", "region"))
    # each order finds its region before the far more numerous lines find their orders
    placed = orders.join(where, "c_custkey").select("l_orderkey", "region")
    return (li.join(part, "l_partkey").join(placed, "l_orderkey")
            .groupBy("cik", "yr", "ptype", "region").agg(F.sum("cents").alias("cents")))


#: Years that an annual report shows.
REPORT_YEARS = 3
# Members that a filer forms from part types.
_SEGMENTS = (("x:RetailMember", ("SMALL", "MEDIUM")), ("x:IndustrialMember", ("LARGE", "STANDARD")), ("x:SpecialMember", None))
_GOODS = (("us-gaap:ProductMember", ("ECONOMY", "STANDARD", "MEDIUM")), ("us-gaap:ServiceMember", None))


def _report_id(cik, year):
    """The accession number of the annual report on a year."""
    return F.concat(F.lpad(cik.cast("string"), 10, "0"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"), F.lit("-000001"))


def _report_facts() -> list:
    """(condition, tag, context, axes, value) of what one total of sales puts into a report.

    ``level`` says which of part type and region the total is over; the totals by
    segment stand beside the filer's own total.
    """
    from ledgerline.operators import segments as G
    cik, cents = F.col("cik"), F.col("cents")
    ax = lambda axis, member: F.struct(F.lit(axis).alias("axis"), member.alias("member"))
    member = lambda c: F.concat(F.lit("x:"), F.initcap(c), F.lit("Member"))
    qual = lambda name: ax(G.QUALIFIER_AXIS, F.lit(name))
    none = F.array().cast("array<struct<axis:string,member:string>>")
    whole, by_type, by_region, cell = (F.col("level") == n for n in (3, 1, 2, 0))
    # the newest year of a report is as first told; some filers restate the income of earlier ones
    income = F.when((cik % 4 == 0) & (F.col("report_year") > F.col("yr")), F.expr("cents div 8")).otherwise(F.expr("cents div 10"))
    p_ctx, p_ax = F.concat(F.lit("P-"), F.col("ptype")), F.array(ax(G.PRODUCT_AXIS, member("ptype")))
    extra = F.expr(" + ".join(f"coalesce(seg{i} div 10, 0)" for i in range(len(_SEGMENTS))))
    inter = whole & (cik % 5).isin(0, 2)
    out = [
        (whole, "Revenues", F.lit("C"), none, cents),
        (whole, "OperatingIncomeLoss", F.lit("C"), none, income),
        (by_type & (cik % 3 != 2), "Revenues", p_ctx, p_ax, cents),
        (by_type & (cik % 3 != 2) & (cik % 2 == 0), "Revenues", p_ctx, p_ax, cents),
        (by_type & (cik % 3 != 2), "OperatingIncomeLoss", p_ctx, p_ax, income),
        (whole & (cik % 3 != 2) & (cik % 4 == 1), "Revenues", F.lit("T"), F.array(ax(G.PRODUCT_AXIS, F.lit("x:TotalSmallLargeMember"))), F.col("small_large")),
        (by_region & (cik % 3 == 0) & ~((cik % 7 == 3) & (F.col("region") == "AMERICA")), "Revenues", F.concat(F.lit("G-"), F.col("region")),
         F.array(ax(G.GEOGRAPHY_AXIS, member("region"))), cents),
        (whole & (cik % 5 == 3), "Revenues", F.lit("RC"), F.array(qual("us-gaap:CorporateNonSegmentMember")), F.lit(45800000)),
        (inter, "Revenues", F.lit("RO"), F.array(qual(G.OPERATING_SEGMENTS)), cents + extra),
        (inter, "Revenues", F.lit("RE"), F.array(qual("us-gaap:IntersegmentEliminationMember")), F.when(cik % 10 == 0, 5000000).otherwise(0) - extra),
        (inter & (cik % 10 == 0), "Revenues", F.lit("RC"), F.array(qual("us-gaap:CorporateNonSegmentMember")), F.lit(-5000000)),
        (inter & (cik % 10 == 0), "Revenues", F.lit("RS"), F.array(qual("x:EliminationsAndReconcilingMember")), -extra),
        (cell & (cik % 3 == 2), "Revenues", F.concat(F.lit("X-"), F.col("ptype"), F.lit("-"), F.col("region")),
         F.array(ax(G.PRODUCT_AXIS, member("ptype")), ax(G.GEOGRAPHY_AXIS, member("region"))), cents),
        (by_type & (cik % 6 == 5), "Revenues", F.concat(F.lit("XW-"), F.col("ptype")),
         F.array(ax(G.PRODUCT_AXIS, member("ptype")), ax(G.GEOGRAPHY_AXIS, F.lit("x:WorldMember"))), cents),
    ]
    for i, (name, _) in enumerate(_GOODS):
        out.append((whole & (cik % 3 == 0), "Revenues", F.lit(f"F-{name}"), F.array(ax(G.PRODUCT_AXIS, F.lit(name))), F.col(f"goods{i}")))
    for i, (name, _) in enumerate(_SEGMENTS):
        seg, v = ax(G.SEGMENT_AXIS, F.lit(name)), F.col(f"seg{i}")
        plain = (cik % 5).isin(1, 3) | ((cik % 5 == 2) & F.lit(i == 0))
        out += [
            (whole & plain, "Revenues", F.lit(f"S-{name}"), F.array(seg), v),
            (whole & (cik % 5).isin(0, 2), "Revenues", F.lit(f"SO-{name}"), F.array(seg, qual(G.OPERATING_SEGMENTS)), F.expr(f"seg{i} + seg{i} div 10")),
            (whole & (cik % 5 == 1), "Revenues", F.lit(f"SO-{name}"), F.array(seg, qual(G.OPERATING_SEGMENTS)), F.expr(f"seg{i} * 9 div 10")),
            (whole & (cik % 2 == 1), "Revenues", F.lit(f"A-{name}"), F.array(seg, ax("us-gaap:AccidentYearAxis", F.lit("x:PriorYearMember"))), v)]
    return out


def report_cells(base: DataFrame, span: tuple[int, int]) -> DataFrame:
    """Dimensional facts of every supplier's annual reports, three years each, shaped by the supplier's key.

    One aggregation makes the totals (level 3), those by part type (1), by region (2) and by both (0).
    """
    kind, cents = F.col("ptype"), F.col("cents")
    named = lambda sets: [kind.isin(*k) if k else ~kind.isin(*[x for _, o in sets if o for x in o]) for _, k in sets]
    only = lambda cond: F.sum(F.when(cond, cents))
    none = F.lit(None).cast("string")
    level = lambda n, t, r: F.struct(F.lit(n).alias("level"), t.alias("of_type"), r.alias("of_region"))
    region = F.col("region")
    levels = F.array(level(0, kind, region), level(1, kind, none), level(2, none, region), level(3, none, none))
    # a filer has a cell for each year, type and region at most; dealt by filer, no total and no fact made of it is shuffled
    totals = by_filer(base).select("*", F.inline(levels)).groupBy("cik", "yr", "level", "of_type", "of_region").agg(
        F.sum("cents").alias("cents"), only(kind.isin("SMALL", "LARGE")).alias("small_large"),
        *[only(c).alias(f"goods{i}") for i, c in enumerate(named(_GOODS))], *[only(c).alias(f"seg{i}") for i, c in enumerate(named(_SEGMENTS))])
    totals = totals.withColumnsRenamed({"of_type": "ptype", "of_region": "region"})
    shown = F.sequence(F.col("yr"), F.least(F.col("yr") + REPORT_YEARS - 1, F.lit(span[1])))
    told = totals.withColumn("report_year", F.explode(shown))
    facts = F.array_compact(F.array(*[
        F.when(cond & val.isNotNull(), F.struct(F.lit(tag).alias("tag"), F.concat(ctx, F.lit("-"), F.col("yr").cast("string")).alias("context_id"),
                                                axes.alias("axes"), val.cast("double").alias("val"))) for cond, tag, ctx, axes, val in _report_facts()]))
    year = F.col("report_year")
    return told.select(
        "cik", _report_id(F.col("cik"), year).alias("accn"), F.lit("10-K").alias("form"), F.make_date(year + 1, F.lit(2), F.lit(15)).alias("filed"),
        F.make_date("yr", F.lit(1), F.lit(1)).alias("period_start"), F.make_date("yr", F.lit(12), F.lit(31)).alias("period_end"), F.inline(facts))


def instance_documents(cells: DataFrame) -> DataFrame:
    """Annual reports as XBRL instances (cik, accn, form, filed, xml): a group holds the facts of one report.

    Some filers' reports refer to a context that is missing or say no number, and
    some filers' oldest report ends half way.
    """
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    day = lambda c: c.cast("string")
    context = F.struct("context_id", "period_start", "period_end", "axes")
    fact = F.struct("context_id", "tag", F.format_string("%.0f", "val").alias("val"))
    docs = cells.groupBy("cik", "accn", "form", "filed").agg(F.array_sort(F.collect_set(context)).alias("contexts"), F.array_sort(F.collect_list(fact)).alias("facts"))
    segment = lambda c: F.when(F.size(c["axes"]) == 0, "").otherwise(text("<segment>", F.array_join(F.transform(c["axes"], lambda a: text(
        '<xbrldi:explicitMember dimension="', a["axis"], '">', a["member"], "</xbrldi:explicitMember>")), ""), "</segment>"))
    contexts = F.transform("contexts", lambda c: text(
        '<context id="', c["context_id"], '"><entity><identifier scheme="cik">', F.col("cik").cast("string"), "</identifier>", segment(c), "</entity><period><startDate>",
        day(c["period_start"]), "</startDate><endDate>", day(c["period_end"]), "</endDate></period></context>"))
    element = lambda tag, ctx, val: text("<us-gaap:", tag, ' contextRef="', ctx, '" unitRef="usd" decimals="-2">', val, "</us-gaap:", tag, ">")
    facts = F.transform("facts", lambda f: element(f["tag"], f["context_id"], f["val"]))
    spoiled = F.when(F.col("cik") % 13 == 8, element(F.lit("Goodwill"), F.lit("gone"), F.lit("1"))).when(
        F.col("cik") % 17 == 6, element(F.lit("Goodwill"), F.get("contexts", F.lit(0))["context_id"], F.lit("n/a"))).otherwise("")
    xml = text('<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:us-gaap="http://fasb.org/us-gaap">',
               F.array_join(contexts, ""), '<unit id="usd"><measure>iso4217:USD</measure></unit>', F.array_join(facts, ""), spoiled, "</xbrl>")
    first = F.min("filed").over(Window.partitionBy("cik")) == F.col("filed")
    return docs.select("cik", "accn", "form", "filed", xml.alias("value"), first.alias("first")).select(
        "cik", "accn", "form", "filed", _cut(F.col("value"), (F.col("cik") % 37 == 12) & F.col("first")).alias("xml"))


def _linkbase(body: str) -> str:
    return f'<linkbase xmlns="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink">{body}</linkbase>'


def _locator(name: str) -> str:
    return f'<loc xlink:label="{name}" xlink:href="filer.xsd#{name.replace(":", "_")}"/>'


def definition_linkbase() -> str:
    """The tables that every report declares."""
    links = []
    for role in dict.fromkeys(r for r, *_ in _role_rows()):
        rows = [(a, p, m) for r, a, p, m in _role_rows() if r == role]
        domain = {a: f"{a.removesuffix('Axis')}Domain" for a, _, _ in rows}
        arcs = [("dimension-domain", a, d) for a, d in domain.items()] + [("domain-member", p or domain[a], m) for a, p, m in rows]
        locs = dict.fromkeys(x for _, a, b in arcs for x in (a, b))
        links.append(f'<definitionLink xlink:role="{role}">' + "".join(map(_locator, locs)) + "".join(
            f'<definitionArc xlink:arcrole="http://xbrl.org/int/dim/arcrole/{k}" xlink:from="{a}" xlink:to="{b}"/>' for k, a, b in arcs) + "</definitionLink>")
    return _linkbase("".join(links))


def label_linkbase() -> str:
    """The labels that every report gives to some members."""
    parts = [f'{_locator(m)}<label xlink:label="l{i}" xlink:role="http://www.xbrl.org/2003/role/{role}">{label}</label><labelArc xlink:from="{m}" xlink:to="l{i}"/>'
             for i, (m, role, label) in enumerate(_LABELS)]
    return _linkbase(f"<labelLink>{''.join(parts)}</labelLink>")


def linkbases(reports: DataFrame, text: str) -> DataFrame:
    """The linkbase that comes with each report (cik, accn, form, filed)."""
    return reports.select("cik", "accn", "form", "filed", F.lit(text).alias("xml"))


# (role, axis, parent, member): which table declares which member.
_TYPES = ("Economy", "Large", "Medium", "Promo", "Small", "Standard")
_REGIONS = ("Africa", "America", "Asia", "Europe", "Middle East")


def _role_rows() -> list:
    from ledgerline.operators import segments as G
    note = [("note", G.PRODUCT_AXIS, "x:TotalSmallLargeMember" if t in ("Small", "Large") else None, f"x:{t}Member") for t in _TYPES]
    note.append(("note", G.PRODUCT_AXIS, None, "x:TotalSmallLargeMember"))
    face = [("face", G.PRODUCT_AXIS, None, f"us-gaap:{m}Member") for m in ("Product", "Service")]
    geo = [("geo", G.GEOGRAPHY_AXIS, None, f"x:{r}Member") for r in (*_REGIONS, "World")]
    seg = [("seg", G.SEGMENT_AXIS, None, f"x:{m}Member") for m in ("Retail", "Industrial", "Special")]
    items = [G.OPERATING_SEGMENTS, "us-gaap:CorporateNonSegmentMember", "us-gaap:IntersegmentEliminationMember",
             "x:EliminationsAndReconcilingMember"]
    return note + face + geo + seg + [("seg", G.QUALIFIER_AXIS, None, m) for m in items]


# (member, role, label)
_LABELS = (*((f"x:{t}Member", "label", f"{t} goods") for t in _TYPES),
           ("us-gaap:CorporateNonSegmentMember", "terseLabel", "Corporate, Non-Segment [Member]"),
           ("us-gaap:IntersegmentEliminationMember", "label", "Optional eliminations"))
