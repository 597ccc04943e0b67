"""What plans do with tables that grow with the number of filers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ltm, select
from ledgerline.plans.stage import CLEANUP, write_stage
from ledgerline.sources import layout, star_schema as S
from ledgerline.sources.readers import annotate_facts
from tests.conftest import Book

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def limit(spark):
    """The threshold set for one test."""
    old = spark.conf.get(THRESHOLD)
    yield lambda v: spark.conf.set(THRESHOLD, v)
    spark.conf.set(THRESHOLD, old)


def year_columns(spark, n=50):
    rows = [(i, "corporate", k, dt.date(2020 - k, 12, 31), "USD") for i in range(n) for k in range(5)]
    return write_stage(spark.createDataFrame(rows, "cik bigint, industry string, idx int, end date, ccy string"), "test-columns")


def test_dates_of_a_year_are_not_broadcast(spark, limit):
    limit("10m")
    spans = spark.createDataFrame([(1, dt.date(2020, 1, 2), dt.date(2020, 4, 1), 90)], "cik bigint, start date, end date, days int")
    options = ltm.rung_options(spans, year_columns(spark))
    assert "BroadcastHashJoin" not in plan_of(options) and "SortMergeJoin" in plan_of(options)
    assert [(r.cik, r.k) for r in options.collect()] == [(1, 1)]


def test_slices_of_a_request_are_not_broadcast(spark, limit):
    limit("10m")
    b = Book()
    b.year(1, "Revenues", 2020, 5)
    obs = select.observations(annotate_facts(b.frames(spark)[0]))
    found = select.candidates(obs, select.annual_requests(year_columns(spark)))
    assert "BroadcastHashJoin" not in plan_of(found)
    assert sorted((r.cik, r.gate, r.val) for r in found.collect()) == [(1, False, 5.0), (1, True, 5.0)]


def test_long_stages_of_small_files_are_not_broadcast(spark, limit):
    limit("256k")
    other = spark.range(1 << 20).withColumn("x", F.col("id") * 7).withColumnRenamed("id", "cik")
    joined = {n: other.join(write_stage(spark.range(n).select(F.col("id").alias("cik"), F.lit("filer").alias("role")).repartition(1), "test-keys"), "cik") for n in (50, 40000)}
    assert "BroadcastHashJoin" in plan_of(joined[50])
    assert "BroadcastHashJoin" not in plan_of(joined[40000])
    assert {n: df.count() for n, df in joined.items()} == {50: 50, 40000: 40000}


def test_readings_are_folded_after_one_shuffle_of_plain_facts(spark):
    b = Book()
    b.year(1, "Revenues", 2020, 5, accn="a-1")
    b.year(1, "Revenues", 2020, 5, accn="a-2", filed="2022-02-15")
    b.year(1, "Revenues", 2020, 6, accn="a-2", filed="2022-02-15")
    b.at(1, "Assets", 2020, 9, form="10-K/A", accn="a-3")
    b.year(2, "Revenues", 2020, 5, accn="b-1")
    facts = annotate_facts(b.frames(spark)[0])
    obs = select.observations(facts)
    lines = plan_of(obs.sortWithinPartitions(layout.PART, "tag", "cik", "end")).splitlines()
    at = lambda word: [i for i, x in enumerate(lines) if word in x]
    # nothing is folded below the exchange; both halves of the fold sort, the writing does not
    assert len(at("Exchange")) == 1 and max(at("Aggregate")) < at("Exchange")[0] and len(at("Sort [")) == 2
    got = {(r.cik, r.tag, r.val): r for r in obs.collect()}
    assert sorted((k, r.n) for k, r in got.items()) == [((1, "Assets", 9.0), 1), ((1, "Revenues", 5.0), 2), ((1, "Revenues", 6.0), 1), ((2, "Revenues", 5.0), 1)]
    five, assets = got[(1, "Revenues", 5.0)], got[(1, "Assets", 9.0)]
    assert (five.best.accn, five.first.accn, five.accn_lo, five.accn_hi) == ("a-2", "a-1", "a-1", "a-2")
    assert assets.best.accn == "a-3" and assets.best_plain is None and assets.accn_lo is None
    table = layout.write_by_tag(obs, "test-readings", ["cik", "end"])
    assert sorted((r.cik, r.tag, r.val) for r in layout.of_tags(table, ["Revenues"]).collect()) == [(1, "Revenues", 5.0), (1, "Revenues", 6.0), (2, "Revenues", 5.0)]


def test_shuffle_files_of_a_written_stage_are_released(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    known = lambda: set(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files()).keySet())
    before, set_before = known(), spark.conf.get(CLEANUP, None)
    table = write_stage(spark.range(100000).repartition(3).groupBy((F.col("id") % 50000).alias("k")).count(), "test-release")
    # a count of the rows that were written may be left
    assert len(known() - before) <= 1 and spark.conf.get(CLEANUP, None) == set_before
    assert table.count() == 50000


def shuffles(df):
    return plan_of(df).count("Exchange hashpartitioning")


def test_documents_are_made_where_their_filer_lies(spark):
    rows = [(cik, y, t, r, 1000 * cik + y) for cik in (0, 1, 2, 9) for y in (1998, 1999, 2000) for t in ("SMALL", "LARGE", None) for r in ("ASIA", "EUROPE", None)]
    base = spark.createDataFrame(rows, "cik bigint, yr int, ptype string, region string, cents bigint")
    cells = S.report_cells(base, (1998, 2000))
    docs = S.instance_documents(cells)
    assert shuffles(docs) == 1
    whole = {(r.cik, r.period_end.year): r.val for r in cells.where("tag = 'Revenues' AND context_id LIKE 'C-%'").collect()}
    assert whole == {(cik, y): 9.0 * (1000 * cik + y) for cik, y, *_ in rows}
    asia = cells.where("context_id = 'G-ASIA-1999'").select("cik", "val").distinct().collect()
    assert sorted(map(tuple, asia)) == [(cik, 3.0 * (1000 * cik + 1999)) for cik in (0, 9)]
    assert docs.count() == 4 * 3


def test_company_documents_need_one_shuffle(spark):
    b = Book()
    for y in (2019, 2020):
        b.year(1, "Revenues", y, y)
        b.year(1, "Revenues", y, 2 * y, unit="EUR", unit_ord=1)
    docs = S.company_documents(b.frames(spark)[0])
    assert shuffles(docs) == 1
    units = json.loads(docs.first().value)["facts"]["us-gaap"]["Revenues"]["units"]
    assert {u: [f["val"] for f in fs] for u, fs in units.items()} == {"USD": ["2019", "2020"], "EUR": ["4038", "4040"]}


def test_lines_and_months_are_shuffled_once_each(spark, tmp_path):
    day = dt.datetime(1999, 3, 5)
    tables = {
        "lineitem": spark.createDataFrame([(1, 1, 1, 10.0, 2.0, "N", "F", day)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "part": spark.createDataFrame([(1, "SMALL")], "p_partkey bigint, p_type string"),
        "orders": spark.createDataFrame([(1, 1)], "o_orderkey bigint, o_custkey bigint"),
        "customer": spark.createDataFrame([(1, 1)], "c_custkey bigint, c_nationkey int"),
        "nation": spark.createDataFrame([(1, 1)], "n_nationkey int, n_regionkey int"),
        "region": spark.createDataFrame([(1, "ASIA")], "r_regionkey int, r_name string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    base = S.segment_base(spark, str(tmp_path))
    assert [tuple(r) for r in base.collect()] == [(1, 1999, "SMALL", "ASIA", 1000)]
    # customers meet orders, and not the lines
    assert "l_orderkey" in next(x for x in plan_of(base).splitlines() if "Join" in x)
    periods = S._reported_periods(spark, str(tmp_path), 1998, 2000)
    # months are shuffled to their sums and to their filer, what they are fanned out to is not
    assert shuffles(periods) == 2 and not any("kind" in x for x in plan_of(periods).splitlines() if "Exchange" in x)
    assert periods.where("kind = 'FY'").select("yr", "rev_all").collect() == [(1999, 1000)]
