"""Readers, sinks and small helpers on files written by the test."""

import datetime as dt
import json

import numpy as np
import pytest

from ledgerline.functions import columns as C
from ledgerline.functions.quantiles import exact_percentiles
from ledgerline.operators import calendar, comps, export, quality
from ledgerline.plans.stage import write_stage
from ledgerline.sources import readers


def test_company_facts_document(spark, tmp_path):
    doc = {"cik": 320193, "entityName": "X", "facts": {
        "us-gaap": {"Revenues": {"label": "Revenue", "units": {
            "EUR": [{"start": "2022-01-01", "end": "2022-12-31", "val": 5, "accn": "a", "fy": 2022, "fp": "FY", "form": "10-K", "filed": "2023-02-01"}],
            "USD": [{"start": "2022-01-01", "end": "2022-12-31", "val": 6, "accn": "a", "fy": 2022, "fp": "FY", "form": "10-K", "filed": "2023-02-01"},
                    {"start": "2021-01-01", "end": "2021-12-31", "val": 7, "accn": "b", "fy": 2021, "fp": "FY", "form": "10-K", "filed": "2022-02-01"}]}},
            "Unmodelled": {"label": "", "units": {"USD": [{"end": "2022-12-31", "val": 1, "form": "10-K", "filed": "2023-02-01"}]}}},
        "dei": {"EntityCommonStockSharesOutstanding": {"label": "", "units": {"shares": [{"end": "2023-01-31", "val": 9, "form": "10-K", "filed": "2023-02-01"}]}}}}}
    path = tmp_path / "facts.json"
    path.write_text(json.dumps(doc) + "\n")
    raw = readers.read_company_facts(spark, str(path))
    rows = {(r["tag"], r["unit"], r["unit_ord"], r["pos"]): r["val"] for r in readers.slim(raw).collect()}
    assert rows == {("Revenues", "EUR", 0, 0): 5, ("Revenues", "USD", 1, 0): 6, ("Revenues", "USD", 1, 1): 7,
                    ("dei:EntityCommonStockSharesOutstanding", "shares", 0, 0): 9}
    counts = readers.keep_counts(raw).first()
    assert (counts["tags_kept"], counts["tags_dropped"]) == (2, 1)
    shares = readers.annotate_facts(raw).where("unit = 'shares'").first()
    assert (shares["is_duration"], shares["unit_ccy"], shares["is_periodic"]) == (False, None, True)


def test_filing_list_tickers_and_index(spark, tmp_path):
    sub = {"cik": 1, "name": "A", "tickers": ["AA"], "sic": "6021", "sicDescription": "banks", "fiscalYearEnd": "1231", "filings": {"recent": {
        "form": ["10-K", "S-1", "10-KT/A", "8-K"], "filingDate": ["2024-02-01"] * 4, "accessionNumber": list("abcd"),
        "primaryDocument": list("wxyz"), "reportDate": ["2023-12-31", None, "2023-06-30", None]}}}
    (tmp_path / "sub.json").write_text(json.dumps(sub) + "\n")
    f = readers.read_filings(spark, str(tmp_path / "sub.json"))
    assert [r["form"] for r in readers.trim_filings(f).orderBy("filing_ord").collect()] == ["10-K", "10-KT/A", "8-K"]
    assert readers.trim_filings(f, 1).count() == 1
    assert readers.read_filers(spark, str(tmp_path / "sub.json")).first()["industry"] == "bank"
    (tmp_path / "t.json").write_text('[\n[1,"AA","ALPHA INC"],\n[2,"BB","BETA"]\n]\n')
    assert readers.read_tickers(spark, str(tmp_path / "t.json")).count() == 2
    (tmp_path / "one.json").write_text('[[1,"AA","ALPHA, \\"INC\\""],[2,"BB","BETA"],["x3","CC","GAMMA"]]')
    one = sorted((r["ticker"], r["cik"], r["title"]) for r in readers.read_tickers(spark, str(tmp_path / "one.json")).collect())
    assert one == [("AA", 1, 'ALPHA, "INC"'), ("BB", 2, "BETA"), ("CC", None, "GAMMA")]
    (tmp_path / "lines.json").write_text('[1,"AA","A"],\n[2,"BB","B"]\n')
    assert readers.read_tickers(spark, str(tmp_path / "lines.json")).where("cik is not null").count() == 2
    (tmp_path / "full.idx").write_text(f"{'10-K':<12}{'N' * 59 + ' 12'}{'123':<12}{'2024-03-01':<12}edgar/data/123/x.txt\n".replace("N 12", "N 12 "))
    full = readers.read_form_index(spark, str(tmp_path / "full.idx")).first()
    assert (full["company"], full["cik"]) == ("N" * 59 + " 12", 123)
    line = f"{'10-12B/A':<12}{'NEW CO INC':<62}{'123':<12}{'2024-03-01':<12}edgar/data/123/x.txt"
    (tmp_path / "form.idx").write_text("Form Type   Company\n-----\n" + line + "\n")
    row = readers.read_form_index(spark, str(tmp_path / "form.idx")).first()
    assert (row["form"], row["company"], row["cik"], row["filed"]) == ("10-12B/A", "NEW CO INC", 123, dt.date(2024, 3, 1))


def test_report_kinds_and_quotes(spark):
    names = ["CONSOLIDATED STATEMENTS OF COMPREHENSIVE INCOME", "CONSOLIDATED STATEMENTS OF EARNINGS", "BALANCE SHEETS - Balance Sheet"]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", C.report_kinds("name").alias("kinds"))
    assert [r["kinds"] for r in df.collect()] == [[], ["is"], ["bs"]]
    xml = "<S><Report a='1'><ShortName> A &amp; B leases </ShortName><HtmlFileName>R1.htm</HtmlFileName></Report><Report><ShortName>x</ShortName></Report></S>"
    s = spark.createDataFrame([(7, "0000000007-24-000001", xml), (8, "0000000008-24-000001", None)], "cik bigint, accn string, xml string")
    r = {x["cik"]: x for x in readers.read_reports(s).collect()}
    assert r[7]["name"] == "A & B leases" and r[7]["kinds"] == ["leases"] and r[7]["url"].endswith("000000000724000001/R1.htm")
    assert r[8]["url"] is None and not r[8]["rendered"]
    at = dt.datetime(2024, 1, 1)
    q = spark.createDataFrame([(" ab ", 1.0, at), ("AB", 2.0, at + dt.timedelta(1)), ("ZZ", 0.0, at), ("A1", 5.0, at)],
                              "symbol string, price double, at timestamp")
    assert [(x["symbol"], x["price"]) for x in readers.clean_quotes(q).collect()] == [("AB", 2.0)]


@pytest.mark.parametrize("sic,want", [("6020", "bank"), ("6324", "health"), ("6321", "life"), ("6331", "pc"), ("6310", "pc"), ("6411", "corporate"),
                                      ("6282", "advisory"), ("6798", "reit"), ("7372", "corporate"), ("", "corporate"), (None, "corporate")])
def test_industry(spark, sic, want):
    assert spark.createDataFrame([(sic,)], "sic_code string").select(C.industry_of()).first()[0] == want


def test_display(spark):
    rows = [(0.1234, "percent", "12.3%"), (2.5, "multiple", "2.50x"), (44.5, "days", "45d"), (7.324, None, "7.32"), (7.5, None, "7.5"),
            (7.0, None, "7"), (-1234567.4, None, "-1,234,567")]
    df = spark.createDataFrame([(v, s) for v, s, _ in rows], "value double, style string").select(C.display())
    assert [r[0] for r in df.collect()] == [w for _, _, w in rows]


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(v)) for g, n in (("a", 401), ("b", 10), ("c", 1)) for v in np.round(rng.normal(size=n), 1)] + [("a", float("nan")), ("b", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", {"median": 0.5, "p90": 0.9, "p01": 0.01}).collect()}
    for g in "abc":
        xs = [v for k, v in data if k == g and v is not None and not np.isnan(v)]
        for name, p in (("median", 50), ("p90", 90), ("p01", 1)):
            assert got[g][name] == pytest.approx(np.percentile(xs, p))
        assert got[g]["n"] == len(xs)


def test_ticker_rules(spark):
    t = spark.createDataFrame([(1, "AA", "Alpha Inc"), (2, "BB", "Beta Holdings"), (3, "CC", "Gamma")], "cik bigint, ticker string, title string")
    fixed = calendar.apply_ticker_fixes(t, spark.createDataFrame([(9, "BB", "Beta New"), (8, "DD", "Delta")], "cik bigint, ticker string, title string"))
    assert {(r["ticker"], r["cik"]) for r in fixed.collect()} == {("AA", 1), ("BB", 9), ("CC", 3), ("DD", 8)}
    alive = spark.createDataFrame([(1, True), (20, True), (30, False)], "cik bigint, has_periods boolean")
    preds = spark.createDataFrame([("BB", 20), ("CC", 30), ("AA", 20)], "ticker string, cik bigint")
    used = {r["ticker"]: r["used_cik"] for r in calendar.resolve_predecessors(t, alive, preds).collect()}
    assert used == {"AA": 1, "BB": 20, "CC": 3}
    idx = spark.createDataFrame([("10-K", "BETA CORP", 50, dt.date(2024, 3, 1)), ("10-K", "Gamme Inc", 51, dt.date(2024, 3, 1)),
                                 ("10-K", "Alpha", 1, dt.date(2024, 3, 1))], "form string, company string, cik bigint, filed date")
    hit = {(r["ticker"], r["other_cik"], r["edits"]) for r in quality.ticker_suspects(t, idx, "2024-01-01").collect()}
    assert hit == {("BB", 50, 0), ("CC", 51, 1)}
    ordered = t.withColumn("ord", t.cik)
    asked = spark.createDataFrame([(1, "bb"), (2, "a"), (3, "  "), (4, "A")], "query_id bigint, query string")
    found = {(r["query_id"], r["rank"]): r["ticker"] for r in comps.search(comps.search_index(ordered, write_stage), asked).collect()}
    assert found == {(1, 1): "BB", (2, 1): "AA", (2, 2): "BB", (2, 3): "CC", (4, 1): "AA", (4, 2): "BB", (4, 3): "CC"}


def test_search_is_brute_force(spark):
    """Every query length, prefixes, parts, ties, titles and tickers that are empty, and queries without a hit."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("AB1 "), n))
    rows = [(i, i, word(3).strip().replace(" ", ""), word(int(rng.integers(0, 9)))) for i in range(300)] + [(500, 500, "ABC", "exact title"), (501, 501, "X", "Abcdefgh")]
    queries = [(i, word(int(rng.integers(1, 7)))) for i in range(200)] + [(900, "abc"), (901, "bcdefg"), (902, "zzzz"), (903, " exact T")]
    t = spark.createDataFrame(rows, "ord bigint, cik bigint, ticker string, title string")
    index = comps.search_index(t, write_stage)
    found = comps.search(index, spark.createDataFrame(queries, "query_id bigint, query string"))
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["cik"], r["cls"])
    for i, q in queries:
        s, hits = q.strip().upper(), []
        for o, c, tic, title in rows if s else []:
            up = title.upper()
            cls = 0 if tic == s else 1 if tic.startswith(s) or up.startswith(s) else 2 if s in up else None
            hits += [(cls, o)] if cls is not None else []
        assert got.get(i, {}) == {k: (o, c) for k, (c, o) in enumerate(sorted(hits)[:8], 1)}, q


def test_typed_set_has_no_limit(spark):
    t = spark.createDataFrame([(i, f"T{i}", "x") for i in range(30)], "cik bigint, ticker string, title string")
    typed = spark.createDataFrame([("s", i, f"t{i}") for i in range(12)], "set_id string, ord bigint, text string")
    none = spark.createDataFrame([], "cik bigint, used_cik bigint, steps bigint")
    assert comps.build_sets(typed, t, none, t.selectExpr("cik", "true AS has_periods")).where("known AND has_periods").count() == 12


def test_sets_follow_successions(spark):
    """One step, two, three, a filer with periods of its own, an end without periods, a ring, and a ticker that nobody lists."""
    tickers = spark.createDataFrame([(10, "ONE", "a"), (20, "TWO", "b"), (30, "THREE", "c"), (40, "OWN", "d"), (50, "DEAD", "e"), (60, "RING", "f"), (1, "LIVE", "g")], "cik bigint, ticker string, title string")
    links = [(10, 1), (20, 21), (21, 2), (30, 31), (31, 32), (32, 3), (40, 4), (50, 51), (60, 61), (61, 62), (62, 60), (20, 99)]
    alive = spark.createDataFrame([(i, i in (1, 2, 3, 4, 40)) for i in (1, 2, 3, 4, 40, 10, 20, 50)], "cik bigint, has_periods boolean")
    followed = comps.follow_successions(alive, spark.createDataFrame(links, "cik bigint, pred_cik bigint"), write_stage)
    assert {r.cik: (r.used_cik, r.steps) for r in followed.collect()} == {10: (1, 1), 20: (2, 2), 21: (2, 1), 30: (3, 3), 31: (3, 2), 32: (3, 1)}
    typed = [("s", 1, " one "), ("s", 2, "two"), ("s", 3, "THREE"), ("s", 4, "Own"), ("s", 5, "dead"), ("s", 6, "ring"), ("s", 7, "live"), ("s", 8, "ONE"), ("s", 9, "  "), ("s", 10, "nosuch"), ("t", 1, "One")]
    sets = comps.build_sets(spark.createDataFrame(typed, "set_id string, ord bigint, text string"), tickers, followed, alive).collect()
    assert {(r.set_id, r.ticker): (r.ord, r.cik, r.used_cik, r.steps, r.known, r.has_periods) for r in sets} == {
        ("s", "ONE"): (1, 10, 1, 1, True, True), ("s", "TWO"): (2, 20, 2, 2, True, True), ("s", "THREE"): (3, 30, 3, 3, True, True), ("s", "OWN"): (4, 40, 40, 0, True, True),
        ("s", "DEAD"): (5, 50, 50, 0, True, False), ("s", "RING"): (6, 60, 60, 0, True, False), ("s", "LIVE"): (7, 1, 1, 0, True, True),
        ("s", "NOSUCH"): (10, None, None, 0, False, False), ("t", "ONE"): (1, 10, 1, 1, True, True)}


def test_suspects_of_short_and_shared_names(spark):
    t = spark.createDataFrame([(1, "MMM", "3M Co"), (9, "YY", "!!")], "cik bigint, ticker string, title string")
    idx = spark.createDataFrame([("10-K", "3M", 50, dt.date(2024, 3, 1)), ("10-K", "3M Corp", 51, dt.date(2024, 3, 1)), ("10-K", "-", 52, dt.date(2024, 3, 1))],
                                "form string, company string, cik bigint, filed date")
    assert {(r["ticker"], r["other_cik"]) for r in quality.ticker_suspects(t, idx, "2024-01-01").collect()} == {("MMM", 50), ("MMM", 51)}


def test_rules_about_all_filings_read_past_the_page(spark):
    rows = [(1, "8-K", i, None, f"a{i}") for i in range(300)] + [(1, "10-K", 300, dt.date(2024, 12, 31), "b")]
    f = spark.createDataFrame(rows, "cik bigint, form string, filing_ord int, period date, accn string")
    p = spark.createDataFrame([(1, 0, dt.date(2023, 12, 31))], "cik bigint, idx int, end date")
    assert readers.trim_filings(f).count() == 120 and readers.listed(f).count() == 301
    assert calendar.stale_sheets(p, readers.listed(f)).count() == 1


def test_snapshot_diff(spark):
    a = spark.createDataFrame([(1, "x", 1.0, "10-K"), (1, "y", 2.0, "10-K"), (1, "z", 3.0, "10-K"), (2, "x", 1.0, "10-K")], "cik int, k string, value double, form string")
    b = spark.createDataFrame([(1, "x", 1.5, "10-K"), (1, "z", 3.0, "10-K/A"), (1, "w", 4.0, "10-K"), (2, "x", 1.0, "10-K")], "cik int, k string, value double, form string")
    d = {r["k"]: r["change"] for r in quality.snapshot_diff(a, b, ["cik", "k"]).collect()}
    assert d == {"x": "changed", "y": "vanished", "w": "appeared", "z": "form moved"}
