"""Documents as filed: what is read, what is rejected and why; instances, linkbases; tables laid out by concept."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import quality
from ledgerline.plans.stage import write_stage
from ledgerline.sources import instances, layout, readers


def lines(spark, *texts):
    return spark.createDataFrame([(t if t is None or isinstance(t, str) else json.dumps(t),) for t in texts], "value string")


def fact(**more):
    return {"start": "2022-01-01", "end": "2022-12-31", "val": 5, "accn": "a", "fy": 2022, "fp": "FY", "form": "10-K", "filed": "2023-02-01"} | more


def test_company_documents_and_their_rejects(spark):
    doc = lambda cik, *facts, unit="USD": {"cik": cik, "facts": {"us-gaap": {"Revenues": {"label": "R", "units": {unit: list(facts)}}}}}
    good = doc(1, fact(), fact(start="2022-13-01"), fact(end=None), fact(end="soon"), fact(filed="2023-2-1"), fact(val="n/a"), fact(val=None), fact(start=None, fy="x"))
    broken = json.dumps(doc(2, fact()))[:40]
    empty = {"cik": 3, "facts": {}}
    padded = doc("0000000004", fact(val=1.5e9))
    nobody = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact()]}}}}}
    none = doc(6)
    rows = readers.checked_company_facts(lines(spark, good, broken, empty, padded, nobody, none, None)).collect()
    told = sorted(((r.cik, r.pos, r.reason) for r in rows), key=repr)
    assert told == sorted([(1, 0, None), (1, 1, "start is no date"), (1, 2, "no end"), (1, 3, "end is no date"), (1, 4, "filed is no date"), (1, 5, "val is no number"),
                           (1, 6, "val is no number"), (1, 7, None), (2, None, "no document"), (3, None, "no facts"), (4, 0, None), (None, 0, "no filer"), (6, None, "no facts"),
                           (None, None, "no document")], key=repr)
    by = {(r.cik, r.pos): r for r in rows}
    assert by[4, 0].val == 1.5e9 and by[1, 7].start is None and by[1, 7].fy is None and by[1, 0].end == dt.date(2022, 12, 31)


def test_filing_lists_and_their_rejects(spark):
    def doc(cik, **arrays):
        recent = {"form": ["10-K", "8-K", "10-Q"], "filingDate": ["2024-02-01", "2024-03-01", "2024-05-01"], "accessionNumber": ["a", "b", "c"],
                  "primaryDocument": ["x", "y", "z"], "reportDate": ["2023-12-31", "", "2024-03-31"]} | arrays
        return {"cik": cik, "filings": {"recent": {k: v for k, v in recent.items() if v is not None}}}

    texts = [doc(1), doc(2, filingDate=["2024-02-01", "2024-03-01"]), doc(3, reportDate=None), doc(4, accessionNumber=["a", "", "c"], filingDate=["2024-02-30", "x", "2024-05-01"]),
             doc(5, form=["10-K", None, "10-Q", "8-K"]), json.dumps(doc(6))[:60], {"cik": 7, "filings": {}}, doc("n/a"), doc(8, reportDate=["2023-12-31", "soon", None])]
    rows = readers.checked_filings(lines(spark, *texts)).collect()
    told = sorted(((r.cik, r.filing_ord, r.reason) for r in rows if r.reason), key=repr)
    assert told == sorted([(2, None, "arrays of different lengths"), (2, 2, "no filing date"), (4, 0, "filed is no date"), (4, 1, "no accession number"),
                           (5, None, "arrays of different lengths"), (5, 1, "no form"), (5, 3, "no accession number"), (6, None, "no document"), (7, None, "no filings"),
                           (None, 0, "no filer"), (None, 1, "no filer"), (None, 2, "no filer"), (8, 1, "period is no date")], key=repr)
    good = sorted((r.cik, r.filing_ord) for r in rows if not r.reason)
    assert good == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (4, 2), (5, 0), (5, 2), (8, 0), (8, 2)]
    assert {r.period for r in rows if r.cik == 3} == {None}


def test_ticker_rows_and_index_lines_with_their_rejects(spark):
    t = readers.checked_tickers(lines(spark, '[[1,"AA","A"],[2,"BB"],["x","CC","C"]]', '[4,"DD","D, \\"[d]\\""],', '[5," ","E"]', "[6,", "", None)).collect()
    assert sorted(((r.cik, r.ticker, r.reason) for r in t), key=repr) == sorted(
        [(1, "AA", None), (2, "BB", "not three values"), (None, "CC", "no filer"), (4, "DD", None), (5, " ", "no ticker"), (None, None, "no row")], key=repr)
    line = lambda form, cik, day: f"{form:<12}{'NEW CO INC':<30}{cik:<12}{day:<12}edgar/data/1/x.txt"
    idx = readers.checked_form_index(lines(spark, "Form Type   Company Name   CIK   Date Filed   File Name", "-----", "", "Anonymous FTP:  ftp://ftp.sec.gov/edgar/",
                                           line("10-K", "1", "2024-03-01"), line("10-K", "2", "20240301"), line("8-K", "3", "2024-02-30"), line("8-K", "", "2024-03-01"))).collect()
    assert sorted(((r.cik, str(r.filed), r.reason) for r in idx), key=repr) == sorted(
        [(1, "2024-03-01", None), (2, "2024-03-01", None), (3, "None", "filed is no date"), (None, "None", "columns missing")], key=repr)


INSTANCE = """<?xml version="1.0"?><xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:us-gaap="http://fasb.org/us-gaap/2023" xmlns:x="x">
<context id="C"><entity><identifier scheme="s">1</identifier></entity><period><startDate>2000-01-01</startDate><endDate>2000-12-31</endDate></period></context>
<context id="S"><entity><identifier scheme="s">1</identifier><segment><xbrldi:explicitMember dimension="srt:ProductOrServiceAxis"> x:EconomyMember </xbrldi:explicitMember>
<xbrldi:explicitMember dimension="srt:StatementGeographicalAxis">country:US</xbrldi:explicitMember></segment></entity><period><instant>2000-12-31</instant></period></context>
<context id="N"><entity><identifier scheme="s">1</identifier></entity><scenario><xbrldi:explicitMember dimension="a">m</xbrldi:explicitMember></scenario><period><startDate>bad</startDate><endDate>2000-12-31</endDate></period></context>
<unit id="usd"><measure>iso4217:USD</measure></unit>
<us-gaap:Revenues contextRef="C" unitRef="usd" decimals="0">123</us-gaap:Revenues><us-gaap:Revenues contextRef="C" unitRef="usd" decimals="0">123</us-gaap:Revenues>
<us-gaap:Revenues contextRef="S" unitRef="usd" decimals="0"> -100.5 </us-gaap:Revenues><us-gaap:Revenues contextRef="gone" unitRef="usd">1</us-gaap:Revenues>
<us-gaap:Goodwill contextRef="S" unitRef="usd" xmlns:xsi="i" xsi:nil="true"/><us-gaap:Goodwill contextRef="S" unitRef="usd">n/a</us-gaap:Goodwill><us-gaap:Goodwill contextRef="N" unitRef="usd">7</us-gaap:Goodwill>
<x:Revenues contextRef="S" unitRef="usd">999</x:Revenues><us-gaap:Unasked contextRef="C">&lt;p&gt;text&lt;/p&gt;</us-gaap:Unasked></xbrl>"""


def prefixed(xml, names, prefix):
    for n in names:
        xml = xml.replace(f"<{n}", f"<{prefix}{n}").replace(f"</{n}", f"</{prefix}{n}")
    return xml


def documents(spark, *xmls):
    return spark.createDataFrame([(i, f"a{i}", "10-K", dt.date(2001, 2, 1), x) for i, x in enumerate(xmls, 1)], "cik bigint, accn string, form string, filed date, xml string")


def test_instances(spark):
    other = prefixed(INSTANCE, ("context", "entity", "segment", "scenario", "period", "startDate", "endDate", "instant"), "xbrli:")
    empty = INSTANCE[:INSTANCE.index("<context")] + "</xbrl>"
    rows = instances.checked_dim_facts(documents(spark, INSTANCE, other, INSTANCE[:900], None, empty), ("Revenues", "Goodwill"), write_stage).collect()
    for cik in (1, 2):
        told = sorted((r.tag, r.context_id, r.val, str(r.period_start), str(r.period_end), r.reason) for r in rows if r.cik == cik and r.reason is None)
        assert told == [("Revenues", "C", 123.0, "2000-01-01", "2000-12-31", None)] * 2 + [("Revenues", "S", -100.5, "None", "2000-12-31", None)]
        assert [[tuple(a) for a in r.axes] for r in rows if r.cik == cik and r.context_id == "S" and r.tag == "Revenues"] == [
            [("srt:ProductOrServiceAxis", "x:EconomyMember"), ("srt:StatementGeographicalAxis", "country:US")]]
        assert sorted((r.tag, r.context_id, r.reason) for r in rows if r.cik == cik and r.reason) == [
            ("Goodwill", "N", "no period"), ("Goodwill", "S", "no number"), ("Revenues", "gone", "no such context")]
    assert sorted((r.cik, r.reason) for r in rows if r.cik > 2) == [(3, "no document"), (4, "no document")]


def test_linkbases(spark):
    loc = lambda name: f'<loc xlink:label="l{name}" xlink:href="u.xsd#{name}"/>'
    arc = lambda kind, a, b: f'<definitionArc xlink:arcrole="http://xbrl.org/int/dim/arcrole/{kind}" xlink:from="l{a}" xlink:to="l{b}"/>'
    body = "".join(map(loc, ("srt_PAxis", "srt_PDomain", "x_Total", "x_One_Two", "x_Three", "srt_GAxis", "srt_GDomain", "country_US")))
    body += arc("dimension-domain", "srt_PAxis", "srt_PDomain") + arc("domain-member", "srt_PDomain", "x_Total") + arc("domain-member", "x_Total", "x_One_Two")
    body += arc("domain-member", "x_One_Two", "x_Three") + arc("domain-member", "x_Three", "x_Total")  # bites its tail
    body += arc("dimension-domain", "srt_GAxis", "srt_GDomain") + arc("domain-member", "srt_GDomain", "country_US") + arc("hypercube-dimension", "x_Table", "srt_GAxis")
    xml = f'<linkbase xmlns:xlink="l" xmlns:link="k"><definitionLink xlink:role="r">{body}</definitionLink></linkbase>'
    both = documents(spark, xml, prefixed(xml, ("definitionLink", "loc", "definitionArc"), "link:"), None)
    members = instances.role_members(instances.arcs(both), write_stage).collect()
    for cik in (1, 2):
        assert sorted(((r.role, r.axis, r.parent_member, r.member) for r in members if r.cik == cik), key=repr) == sorted([
            ("r", "srt:PAxis", None, "x:Total"), ("r", "srt:PAxis", "x:Total", "x:One_Two"), ("r", "srt:PAxis", "x:One_Two", "x:Three"), ("r", "srt:PAxis", "x:Three", "x:Total"),
            ("r", "srt:GAxis", None, "country:US")], key=repr)
    labels = ('<linkbase xmlns:xlink="l"><labelLink><loc xlink:label="a" xlink:href="u#x_One"/><label xlink:label="t" xlink:role="http://www.xbrl.org/2003/role/terseLabel">One &amp; only</label>'
              '<label xlink:label="t" xlink:role="http://www.xbrl.org/2003/role/label">One</label><labelArc xlink:from="a" xlink:to="t"/></labelLink></linkbase>')
    assert sorted(tuple(r)[2:] for r in instances.member_labels(documents(spark, labels, "no xml")).collect()) == [("x:One", "label", "One"), ("x:One", "terseLabel", "One & only")]


def test_population_by_concept_reads_its_folders_only(spark):
    day = dt.date
    rows = [(i, "us-gaap", f"Tag{i % 90}", day(2019, 1, 1), day(2019, 12, 31)) for i in range(900)]
    rows += [(1000, "us-gaap", "ReorganizationItems", day(2019, 1, 1), day(2019, 12, 31)), (1001, "us-gaap", "ReorganizationItems", day(2019, 1, 1), day(2019, 7, 31)),
             (1002, "us-gaap", "ReorganizationItems", day(2018, 12, 10), day(2019, 12, 8)), (1003, "us-gaap", "ReorganizationValue", None, day(2020, 3, 28)),
             (1004, "ext", "ReorganizationItems", day(2019, 1, 1), day(2019, 12, 31)), (1005, "us-gaap", "ReorganizationValue", day(2019, 1, 1), day(2019, 12, 31)),
             (1006, "us-gaap", "LiabilitiesSubjectToCompromise", None, day(2020, 2, 15))]
    table = layout.write_by_tag(spark.createDataFrame(rows, "cik bigint, ns string, tag string, start date, end date"), "test-by-tag", ["cik"])
    drawn = quality.concept_population(table)
    assert sorted((r.population, r.cik, r.frame) for r in drawn.collect()) == [
        ("chapter 11", 1000, "CY2019"), ("chapter 11", 1002, "CY2019"), ("fresh start", 1003, "CY2020Q1I")]
    some = layout.of_tags(table, ["Tag1", "Tag2"])
    assert some.count() == 20 and "PartitionFilters: [tag_part" in some._jdf.queryExecution().toString()
    folders = lambda df: df.select(F.regexp_extract(F.input_file_name(), "tag_part=([0-9]+)", 1)).distinct().count()
    assert folders(some) <= 2 and folders(table) > 20
    assert layout.of_tags(table.drop(layout.PART), ["Tag1"]).count() == 10


@pytest.mark.parametrize("end, want", [("2020-03-31", "CY2020Q1I"), ("2020-04-25", "CY2020Q1I"), ("2020-03-05", "CY2020Q1I"), ("2020-05-14", None), ("2020-12-27", "CY2020Q4I"), ("2021-01-02", "CY2020Q4I")])
def test_quarter_frames(spark, end, want):
    got = spark.createDataFrame([(None, dt.date.fromisoformat(end))], "start date, end date").select(quality.frame_of()).first()[0]
    assert got == want
