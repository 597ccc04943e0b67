import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.session import local_session  # noqa: E402

RAW_SCHEMA = ("cik bigint, ns string, tag string, label string, unit string, unit_ord int, pos bigint, start date, end date, "
              "val double, accn string, fy int, fp string, form string, filed date")


@pytest.fixture(scope="session")
def spark():
    return local_session()


def day(s):
    return dt.date.fromisoformat(s) if isinstance(s, str) else s


class Book:
    """Collects facts and filers of hand-built cases."""

    def __init__(self):
        self.rows, self.filers, self.n = [], {}, 0

    def filer(self, cik, sic="7372"):
        self.filers[cik] = (cik, f"Filer {cik}", [f"T{cik}"], sic)

    def fact(self, cik, tag, start, end, val, form="10-K", filed="2024-02-15", accn=None, unit="USD", unit_ord=0):
        self.filers.setdefault(cik, (cik, f"Filer {cik}", [f"T{cik}"], "7372"))
        self.n += 1
        ns = "dei" if tag == "EntityCommonStockSharesOutstanding" else "us-gaap"
        self.rows.append((cik, ns, tag, tag, unit, unit_ord, self.n, day(start) if start else None, day(end), float(val),
                          accn or f"{cik:010d}-00-{self.n:06d}", 2000, "FY", form, day(filed) if filed else None))

    def year(self, cik, tag, y, val, **kw):
        kw.setdefault("filed", f"{y + 1}-02-15")
        self.fact(cik, tag, f"{y}-01-01", f"{y}-12-31", val, **kw)

    def at(self, cik, tag, y, val, **kw):
        kw.setdefault("filed", f"{y + 1}-02-15")
        self.fact(cik, tag, None, f"{y}-12-31", val, **kw)

    def frames(self, spark):
        from ledgerline.sources.readers import with_industry
        facts = spark.createDataFrame(self.rows, RAW_SCHEMA)
        filers = spark.createDataFrame(list(self.filers.values()), "cik bigint, name string, tickers array<string>, sic_code string")
        return facts, with_industry(filers)
