"""Column helpers shared by the operators.  All of them stay in the JVM."""

from pyspark.sql import Column, functions as F

# Report forms and span lengths.
PERIODIC_FORM = r"^(10-K|10-Q|20-F|40-F)T?(/A)?$"
ANNUAL_FORM = r"^(10-K|20-F|40-F)T?(/A)?$"
LISTED_FORM = r"^(10-K|10-Q|20-F|40-F)T?(/A)?$|^8-K$"
ANNUAL_MIN, ANNUAL_MAX = 358, 400
QUARTER_MIN, QUARTER_MAX = 80, 100
YTD_MIN, YTD_MAX = 60, 320
SPAN_SLACK = 8

# Report kinds and the words that mark them, case ignored.
REPORT_KINDS = (
    ("is", r"(?i)^(?!.*comprehensive).*(statement.*(operation|income|earnings)|^income statement)"),
    ("bs", r"(?i)balance sheet|statement.*financial position"),
    ("cf", r"(?i)statement.*cash flow"),
    ("eq", r"(?i)statement.*(equity|stockholders)"),
    ("tax", r"(?i)income tax"),
    ("debt", r"(?i)\bdebt\b|borrowing"),
    ("leases", r"(?i)lease"),
    ("segments", r"(?i)segment|geographic"),
    ("sbc", r"(?i)share-based|stock-based|compensation"),
    ("pension", r"(?i)pension|retirement benefit"),
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_periodic(form="form") -> Column:
    return F.coalesce(col(form).rlike(PERIODIC_FORM), F.lit(False))


def is_amendment(form="form") -> Column:
    return F.coalesce(col(form).endswith("/A"), F.lit(False))


def form_rank(form="form") -> Column:
    return F.when(col(form) == "10-K", 3).when(col(form) == "10-Q", 2).otherwise(1)


def unit_currency(unit="unit") -> Column:
    c = F.regexp_extract(col(unit), r"^([A-Z]{3})(/shares)?$", 1)
    return F.when(c != "", c)


def span_days(start="start", end="end") -> Column:
    return F.date_diff(col(end), col(start))


def is_annual(days="days") -> Column:
    return col(days).between(ANNUAL_MIN, ANNUAL_MAX)


def industry_of(sic="sic_code") -> Column:
    # The ranges of industry codes.
    n = F.expr(f"try_cast({sic} as int)") if isinstance(sic, str) else sic
    return (
        F.when(n.between(6020, 6199), "bank")
        .when(n == 6324, "health")
        .when(n.between(6311, 6321), "life")
        .when(n.between(6300, 6310) | n.between(6331, 6399), "pc")
        .when(n == 6411, "corporate")
        .when(n.between(6200, 6299), "advisory")
        .when(n == 6798, "reit")
        .otherwise("corporate")
    )


# The tolerances of the next three tests.
def is_power_of_ten(a, b) -> Column:
    """True when two non-zero values differ by a whole, non-zero power of ten."""
    a, b = col(a), col(b)
    e = F.log10(F.abs(a) / F.abs(b))
    whole = F.floor(e + 0.5)
    return F.coalesce((a != 0) & (b != 0) & (F.abs(e - whole) < 1e-9) & (whole != 0), F.lit(False))


def moved(a, b) -> Column:
    """True when two readings of one figure differ by more than half a percent."""
    a, b = col(a), col(b)
    gap = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.coalesce(gap > 0.005, F.lit(False))


def nearly(a, b) -> Column:
    a, b = col(a), col(b)
    return F.coalesce(F.abs(a - b) <= F.greatest(F.abs(b), F.lit(1.0)) * 0.005, F.lit(False))


def padded_cik(cik="cik") -> Column:
    return F.lpad(F.regexp_replace(col(cik).cast("string"), r"\D", ""), 10, "0")


def valid_accession(accn="accn") -> Column:
    return F.coalesce(col(accn).rlike(r"^\d{10}-\d{2}-\d{6}$"), F.lit(False))


def filing_base(cik="cik", accn="accn") -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), col(cik).cast("long").cast("string"),
                    F.lit("/"), F.regexp_replace(col(accn), "-", ""))


def filing_url(cik="cik", accn="accn") -> Column:
    return F.when(
        col(cik).isNotNull() & col(accn).isNotNull(),
        F.concat(filing_base(cik, accn), F.lit("/"), col(accn), F.lit("-index.htm")),
    )


def report_kinds(name="name") -> Column:
    """All kinds a report name belongs to, in the fixed order of the kinds."""
    flags = [F.when(col(name).rlike(rx), F.lit(kind)) for kind, rx in REPORT_KINDS]
    return F.array_compact(F.array(*flags))


def display(value="value", style="style", unit=None) -> Column:
    """Text of a figure: percent, multiple, days, two decimals below 1000, else whole."""
    v = col(value)
    plain = F.abs(v) < 1000
    if unit is not None:
        plain = plain | F.coalesce(col(unit) == "pure", F.lit(False))
    # format_number pads to two decimals; trailing zeros are dropped to keep 7.5 as "7.5"
    small = F.regexp_replace(F.regexp_replace(F.format_number(F.floor(v * 100 + 0.5) / 100, 2), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(col(style) == "percent", F.concat(F.format_string("%.1f", v * 100), F.lit("%")))
        .when(col(style) == "multiple", F.concat(F.format_string("%.2f", v), F.lit("x")))
        .when(col(style) == "days", F.concat(F.floor(v + 0.5).cast("string"), F.lit("d")))
        .when(plain, small)
        .otherwise(F.format_number(F.floor(v + 0.5).cast("double"), 0))
    )
