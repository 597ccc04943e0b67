"""File sources: nested filing documents to long tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.dims import template as T
from ledgerline.functions import columns as C

# Every value is read as text: one that does not parse then spoils its own row, not the document.
_FACT = "struct<start:string,end:string,val:string,accn:string,fy:string,fp:string,form:string,filed:string>"
COMPANY_FACTS_SCHEMA = (
    "cik string, entityName string, "
    f"facts map<string,map<string,struct<label:string,units:map<string,array<{_FACT}>>>>>, _corrupt string"
)
SUBMISSIONS_SCHEMA = (
    "cik string, name string, tickers array<string>, sic string, sicDescription string, fiscalYearEnd string, "
    "filings struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,"
    "primaryDocument:array<string>,reportDate:array<string>>>, _corrupt string"
)
_LENIENT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
FACT = ["cik", "ns", "tag", "label", "unit", "unit_ord", "pos", "start", "end", "val", "accn", "fy", "fp", "form", "filed"]
FILING = ["cik", "filing_ord", "form", "filed", "accn", "doc", "period"]


def _day(c: Column) -> Column:
    """A date written in full, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def _documents(texts: DataFrame, schema: str) -> DataFrame:
    """Texts (value), one JSON document each, parsed; a text that is no document keeps itself in ``_corrupt``."""
    return texts.select(F.from_json("value", schema, _LENIENT).alias("d"), "value").select("d.*", "value")


def _no_document() -> Column:
    return F.col("_corrupt").isNotNull() | (F.col("value").isNull())


def _filer_in(c: str) -> Column:
    """The filer's number, looked up in the text where the text is no document."""
    found = F.coalesce(F.col("cik"), F.nullif(F.regexp_extract(c, r'"cik"\s*:\s*"?(\d+)', 1), F.lit("")))
    return found.try_cast("bigint")


def checked_company_facts(texts: DataFrame) -> DataFrame:
    """One nested document per filer (value) -> one row per fact, document order kept, with a ``reason`` where it cannot be used.

    A document that holds no facts, or is none, is one row that says so.  Columns
    that did not parse are null.  Documents of 10-15 MB arrive one per line, so a
    split holds few of them; the explodes are narrow and stream, nothing is
    grouped here.
    """
    docs = _documents(texts, COMPANY_FACTS_SCHEMA).select(_filer_in("value").alias("cik"), "facts", _no_document().alias("broken"))
    by_ns = docs.select("cik", "broken", F.explode_outer("facts").alias("ns", "tags"))
    by_tag = by_ns.select("cik", "broken", "ns", F.explode_outer("tags").alias("tag", "def"))
    by_unit = by_tag.select("cik", "broken", "ns", "tag", F.col("def.label").alias("label"),
                            F.posexplode_outer(F.map_entries("def.units")).alias("unit_ord", "u"))
    facts = by_unit.select("cik", "broken", "ns", "tag", "label", F.col("u.key").alias("unit"), "unit_ord",
                           F.posexplode_outer("u.value").alias("pos", "f"))
    days = {c: _day(F.col(f"f.{c}")) for c in ("start", "end", "filed")}
    val = F.col("f.val").try_cast("double")
    reason = (F.when(F.col("broken"), "no document").when(F.col("cik").isNull(), "no filer").when(F.col("f").isNull(), "no facts")
              .when(F.col("f.end").isNull(), "no end").when(days["end"].isNull(), "end is no date")
              .when(F.col("f.start").isNotNull() & days["start"].isNull(), "start is no date")
              .when(F.col("f.filed").isNotNull() & days["filed"].isNull(), "filed is no date")
              .when(val.isNull(), "val is no number"))
    return facts.select(
        "cik", "ns", "tag", "label", "unit", "unit_ord", F.col("pos").cast("long").alias("pos"), days["start"].alias("start"), days["end"].alias("end"),
        val.alias("val"), "f.accn", F.col("f.fy").try_cast("int").alias("fy"), "f.fp", "f.form", days["filed"].alias("filed"), reason.alias("reason"))


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    """The usable facts of a file of company documents, one document a line."""
    return checked_company_facts(spark.read.text(path)).where("reason IS NULL").select(FACT)


def _recent(docs: DataFrame) -> DataFrame:
    """The parallel arrays of a filing list side by side; a shorter array ends in nulls."""
    r = "filings.recent"
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"{r}.{c}"), F.array().cast("array<string>")).alias(n) for c, n in _ARRAYS])
    return docs.withColumn("rows", zipped)


# (array of the document, column); the last two may be absent as a whole
_ARRAYS = (("form", "form"), ("filingDate", "filed"), ("accessionNumber", "accn"), ("primaryDocument", "doc"), ("reportDate", "period"))


def checked_filings(texts: DataFrame) -> DataFrame:
    """Parallel arrays of filing lists (value) -> rows with their position, with a ``reason`` where one cannot be used.

    Arrays of different lengths give a row of their own, position null, beside
    the rows of their positions: what is missing at a position is null there, and
    a filing without form, date or accession number is not used.
    """
    docs = _recent(_documents(texts, SUBMISSIONS_SCHEMA))
    lengths = [F.size(F.col(f"filings.recent.{c}")) for c, _ in _ARRAYS]
    whole = [n for n in lengths[:3]] + [F.when(n >= 0, n) for n in lengths[3:]]
    uneven = F.greatest(*whole) != F.least(*whole)
    broken = F.when(_no_document(), "no document").when(F.col("filings.recent.form").isNull(), "no filings").when(uneven, "arrays of different lengths")
    named = docs.select(_filer_in("value").alias("cik"), broken.alias("broken"), "rows")
    none = F.struct(*[F.lit(None).cast("string").alias(n) for _, n in _ARRAYS])
    at = F.transform("rows", lambda z, i: F.struct(i.alias("filing_ord"), z.alias("z"), F.lit(None).cast("string").alias("broken")))
    told = F.when(F.col("broken").isNotNull(), F.array(F.struct(F.lit(None).cast("int").alias("filing_ord"), none.alias("z"), F.col("broken").alias("broken"))))
    rows = named.select("cik", F.inline(F.concat(at, F.coalesce(told, F.filter(at, lambda x: F.lit(False))))))
    filed, period = _day(F.col("z.filed")), _day(F.col("z.period"))
    reason = (F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("cik").isNull(), "no filer")
              .when(F.coalesce("z.form", F.lit("")) == "", "no form").when(F.coalesce("z.accn", F.lit("")) == "", "no accession number")
              .when(F.coalesce("z.filed", F.lit("")) == "", "no filing date").when(filed.isNull(), "filed is no date")
              .when((F.coalesce("z.period", F.lit("")) != "") & period.isNull(), "period is no date"))
    return rows.select("cik", "filing_ord", "z.form", filed.alias("filed"), "z.accn", "z.doc", period.alias("period"), reason.alias("reason"))


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """The usable filings of a file of filing lists, one document a line."""
    return checked_filings(spark.read.text(path)).where("reason IS NULL").select(FILING)


def read_filers(spark: SparkSession, path: str) -> DataFrame:
    docs = _documents(spark.read.text(path), SUBMISSIONS_SCHEMA).where(~_no_document())
    return with_industry(docs.select(F.col("cik").try_cast("bigint").alias("cik"), "name", "tickers", F.col("sicDescription").alias("sic"),
                                     F.col("sic").alias("sic_code"), F.col("fiscalYearEnd").alias("fiscal_year_end")))


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``[cik, ticker, title]``: one JSON array of rows, or one row per line.

    The list of all tickers is one small document, so a file may be read whole.  A
    number that does not parse is null, so that the row can be counted.
    """
    return checked_tickers(spark.read.text(path, wholetext=True)).where("reason IS NULL OR reason = 'no filer'").drop("reason")


def checked_tickers(texts: DataFrame) -> DataFrame:
    """The rows of lists (value), a list being one array of rows, lines of rows, or a single row; with a ``reason`` where one cannot be used."""
    text = F.trim("value")
    lines = F.concat(F.lit("["), F.regexp_replace(F.regexp_replace(text, r",\s*$", ""), r"\]\s*,?\s*\[", "],["), F.lit("]"))
    whole = F.when(text.rlike(r"^\[\s*\["), text).otherwise(lines)
    rows = texts.where(text != "").select(F.explode_outer(F.from_json(whole, "array<array<string>>")).alias("r"))
    cik = F.get("r", F.lit(0)).try_cast("bigint")
    ticker = F.get("r", F.lit(1))
    reason = (F.when(F.col("r").isNull(), "no row").when(F.size("r") != 3, "not three values").when(cik.isNull(), "no filer")
              .when(F.trim(ticker) == "", "no ticker").when(ticker.isNull(), "no ticker"))
    return rows.select(cik.alias("cik"), ticker.alias("ticker"), F.get("r", F.lit(2)).alias("title"), reason.alias("reason"))


def clean_quotes(quotes: DataFrame) -> DataFrame:
    """Latest usable price per symbol; a zero or non-numeric price is no quote."""
    q = (quotes.withColumn("symbol", F.upper(F.trim("symbol")))
         .withColumn("price", F.expr("try_cast(price as double)"))
         .where(F.col("symbol").rlike(r"^[A-Z.\-]{1,12}$"))
         .where(F.col("price").isNotNull() & ~F.isnan("price") & (F.col("price") != 0)))
    # the price breaks ties of two quotes with one time stamp
    return q.groupBy("symbol").agg(F.max(F.struct("at", "price")).alias("m")).select(
        "symbol", F.col("m.price").alias("price"), F.col("m.at").alias("at"))


def read_reports(summaries: DataFrame) -> DataFrame:
    """Filing summaries (cik, accn, xml) -> one row per named report.

    A filing without a document, or without usable reports, keeps one row that
    carries only the link to its folder.
    """
    body = F.regexp_extract_all("xml", F.lit(r"(?s)<Report[^>]*>(.*?)</Report>"), 1)
    cut = lambda tag: F.regexp_extract(F.col("r"), rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    base = C.filing_base()
    rows = summaries.select("cik", "accn", F.col("xml").isNotNull().alias("rendered"), base.alias("base"),
                            F.posexplode_outer(body).alias("raw_ord", "r"))
    rows = rows.withColumn("raw_name", cut("ShortName")).withColumn("file", cut("HtmlFileName"))
    named = rows.where((F.col("raw_name") != "") & (F.col("file") != "")).select(
        "cik", "accn", "rendered", F.trim(F.regexp_replace("raw_name", "&amp;", "&")).alias("name"),
        F.concat("base", F.lit("/"), "file").alias("url"), F.concat("base", F.lit("/")).alias("index_url"),
        F.col("raw_ord").alias("report_ord"))
    index_only = summaries.join(named.select("cik", "accn").distinct(), ["cik", "accn"], "left_anti").select(
        "cik", "accn", F.col("xml").isNotNull().alias("rendered"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("url"), F.concat(base, F.lit("/")).alias("index_url"),
        F.lit(None).cast("int").alias("report_ord"))
    return named.unionByName(index_only).withColumn("kinds", C.report_kinds("name"))


def read_form_index(spark: SparkSession, path: str) -> DataFrame:
    """Quarterly form index: fixed-width text, one filing per line."""
    return parse_form_index(spark.read.text(path))


def parse_form_index(lines: DataFrame) -> DataFrame:
    return checked_form_index(lines).where("reason IS NULL").drop("reason", "value")


def checked_form_index(lines: DataFrame) -> DataFrame:
    """Lines (value) that name a file, with a ``reason`` where the rest does not parse; headings name none.

    The last three columns carry no blanks, so they anchor the split, also where a
    name fills its column.
    """
    rx = r"^(\S+(?: \S+)*?)\s{2,}(\S.*?)\s+(\d{1,10})\s+(\d{4}-\d{2}-\d{2}|\d{8})\s+\S+\s*$"
    g = lambda i: F.regexp_extract("value", rx, i)
    fits = F.col("value").rlike(rx)
    day = F.try_to_timestamp(g(4), F.when(g(4).contains("-"), "yyyy-MM-dd").otherwise("yyyyMMdd")).cast("date")
    reason = F.when(~fits, "columns missing").when(day.isNull(), "filed is no date")
    return lines.where(F.col("value").rlike(r"\s\S+/\S+\.\w+\s*$")).select(
        "value", *[F.when(fits, c).alias(n) for c, n in ((g(1), "form"), (g(2), "company"), (g(3).try_cast("long"), "cik"), (day, "filed"))], reason.alias("reason"))


def concept_frame(facts: DataFrame, tags: list, start: str | None, end: str) -> DataFrame:
    """Every filer reporting one of some concepts for one exact period."""
    shape = F.col("start").isNull() if start is None else F.col("start") == F.to_date(F.lit(start))
    return facts.where(F.col("tag").isin(list(tags)) & shape & (F.col("end") == F.to_date(F.lit(end))))


def slim(facts: DataFrame) -> DataFrame:
    """Keep the template's tags; the cover-page share count gets its prefix."""
    keep = F.col("tag").isin(T.keep_list())
    cover = F.col("tag") == "EntityCommonStockSharesOutstanding"
    return facts.where(((F.col("ns") == "us-gaap") & keep) | ((F.col("ns") == "dei") & cover)).withColumn(
        "tag", F.when(F.col("ns") == "dei", F.concat(F.lit("dei:"), "tag")).otherwise(F.col("tag")))


def keep_counts(facts: DataFrame) -> DataFrame:
    """Tags kept and dropped per filer; only us-gaap tags count as dropped."""
    cover = (F.col("ns") == "dei") & (F.col("tag") == "EntityCommonStockSharesOutstanding")
    known = (F.col("ns") == "us-gaap") & F.col("tag").isin(T.keep_list())
    tags = facts.where(F.col("ns").isin("us-gaap", "dei")).select("cik", "ns", "tag").distinct()
    return tags.groupBy("cik").agg(
        F.count_if(known | cover).alias("tags_kept"),
        F.count_if((F.col("ns") == "us-gaap") & ~F.col("tag").isin(T.keep_list())).alias("tags_dropped"))


def annotate_facts(facts: DataFrame) -> DataFrame:
    """Add what every later rule asks of a fact: shape, length, currency, form class."""
    return facts.withColumns({
        "unit_ccy": C.unit_currency(),
        "is_duration": F.col("start").isNotNull(),
        "days": C.span_days(),
        "is_periodic": C.is_periodic(),
        "is_amendment": C.is_amendment(),
        "form_rank": C.form_rank(),
    })


def with_industry(filers: DataFrame) -> DataFrame:
    return filers.withColumn("industry", C.industry_of())


def listed(filings: DataFrame) -> DataFrame:
    """All filings of the listed forms."""
    return filings.where(F.col("form").rlike(C.LISTED_FORM))


def trim_filings(filings: DataFrame, n: int = 120) -> DataFrame:
    """The first ``n`` listed forms of each filer, in list order: what its page shows.

    The rank is exact: the threshold position is found by a window over the few
    columns needed, and the feature itself is a top-n.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("cik").orderBy("filing_ord")
    return (listed(filings).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn"))


def quarantine_ids(df: DataFrame) -> DataFrame:
    """Mark rows whose filer or accession number could not be part of a link."""
    digits = F.regexp_replace(F.col("cik").cast("string"), r"\D", "")
    return df.withColumns({
        "cik10": C.padded_cik(),
        "id_ok": F.coalesce((F.length(digits).between(1, 10)) & C.valid_accession(), F.lit(False)),
    })
