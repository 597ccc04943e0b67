"""Random small fact sets against plain-Python readings of the rules."""

import datetime as dt
import math
import random
import re

import pytest

from ledgerline.dims import template as T
from ledgerline.plans.sheet import SheetPlan
from tests.conftest import Book

FORMS = ["10-K", "10-Q", "10-K/A", "20-F", "8-K", "DEF 14A"]
TAGS = ["Revenues", "SalesRevenueNet", "NetIncomeLoss"]


def random_book(seed):
    rnd, b = random.Random(seed), Book()
    for cik in range(1, 41):
        for _ in range(rnd.randint(5, 30)):
            y = rnd.randint(2015, 2021)
            start = dt.date(y, 1, 1) + dt.timedelta(days=rnd.choice([0, 0, 0, 1, 90]))
            end = start + dt.timedelta(days=rnd.choice([364, 364, 365, 370, 300, 89, 401]))
            val = rnd.choice([5, 7, 5000, 7000000, 0])
            b.fact(cik, rnd.choice(TAGS), start.isoformat(), end.isoformat(), val, form=rnd.choice(FORMS),
                   filed=f"2022-0{rnd.randint(1, 4)}-01", accn=f"{cik}-{rnd.randint(1, 6)}", unit=rnd.choice(["USD", "USD", "EUR"]),
                   unit_ord=0)
            r = list(b.rows[-1])
            r[5] = 0 if r[4] == "EUR" else 1
            b.rows[-1] = tuple(r)
    return b


def facts_of(b, cik):
    out = []
    for r in b.rows:
        if r[0] == cik:
            out.append(dict(tag=r[2], unit=r[4], uo=r[5], pos=r[6], start=r[7], end=r[8], val=r[9], accn=r[10], form=r[13], filed=r[14],
                            days=(r[8] - r[7]).days))
    return out


def periodic(f):
    return bool(re.match(r"^(10-K|10-Q|20-F|40-F)T?(/A)?$", f["form"]))


def doc(fs, tag):
    return sorted((f for f in fs if f["tag"] == tag), key=lambda f: (f["uo"], f["pos"]))


ANCHORS = [t for t, _, _ in T.anchors_for("corporate")]


def ref_periods(fs, limit=8):
    cals = []
    for t in ANCHORS:
        found = {}
        for f in doc(fs, t):
            if periodic(f) and 358 <= f["days"] <= 400:
                found.setdefault(f["end"], f["start"])
        if found:
            cals.append(sorted(found.items(), reverse=True))
    if not cals:
        return []
    newest = max(c[0][0] for c in cals)
    live = [c for c in cals if (newest - c[0][0]).days <= 400]

    def run(c):
        n = 1
        while n < len(c) and (c[n - 1][1] - c[n][0]).days <= 1:
            n += 1
        return n
    best = max(live, key=lambda c: (run(c), len(c), -live.index(c)))
    kept = []
    for e, s in best:
        if not kept or e <= kept[-1][1]:
            kept.append((e, s))
    return kept[:limit]


def ref_currency(fs):
    seen = [(f["end"], f["unit"]) for t in ANCHORS for f in doc(fs, t) if periodic(f) and 358 <= f["days"] <= 400]
    if not seen:
        return None
    newest = max(e for e, _ in seen)
    n = {}
    for e, u in seen:
        if e == newest:
            n[u] = n.get(u, 0) + 1
    return sorted(n, key=lambda u: (-n[u], u == "USD", u))[0]


def ref_pick(fs, tags, end, ccy):
    for t in tags:
        m = [f for f in doc(fs, t) if f["end"] == end and 358 <= f["days"] <= 400 and f["unit"] == ccy and periodic(f)]
        if not m:
            continue
        rank = {"10-K": 3, "10-Q": 2}
        m.sort(key=lambda f: (f["filed"], rank.get(f["form"], 1)), reverse=True)
        m = sorted(m, key=lambda f: (-f["filed"].toordinal(), -rank.get(f["form"], 1), f["uo"], f["pos"]))
        w = m[0]
        if w["form"].endswith("/A"):
            plain = [f for f in m if not f["form"].endswith("/A")]
            if not any(f["val"] == w["val"] for f in plain):
                for f in plain:
                    if w["val"] and f["val"]:
                        e = math.log10(abs(w["val"]) / abs(f["val"]))
                        votes = {g["accn"] for g in plain if g["val"] == f["val"]}
                        if abs(e - round(e)) < 1e-9 and round(e) != 0 and len(votes) >= 2:
                            w = f
                            break
        return (w["val"], w["tag"], w["accn"])
    return None


@pytest.mark.parametrize("seed", [3, 11])
def test_selection_and_calendar_match_plain_python(spark, seed):
    b = random_book(seed)
    facts, filers = b.frames(spark)
    plan = SheetPlan(facts, filers)
    got_periods, got_cells = {}, {}
    for r in plan.periods.collect():
        got_periods.setdefault(r["cik"], {})[r["idx"]] = (r["end"], r["start"], r["ccy"])
    for r in plan.read_cells.where("k IN ('revenue', 'netIncome') AND value IS NOT NULL").collect():
        got_cells[(r["cik"], r["end"], r["k"])] = (r["value"], r["tag"], r["accn"])
    want_cells = {}
    for cik in b.filers:
        fs = facts_of(b, cik)
        ps, ccy = ref_periods(fs), ref_currency(fs)
        assert [got_periods.get(cik, {}).get(i) for i in range(len(ps))] == [(e, s, ccy) for e, s in ps], cik
        assert len(got_periods.get(cik, {})) == len(ps)
        for e, _ in ps:
            for k, tags in (("revenue", T.REVENUE_TAGS), ("netIncome", ("NetIncomeLoss", "ProfitLoss"))):
                p = ref_pick(fs, tags, e, ccy)
                if p:
                    want_cells[(cik, e, k)] = p
    assert got_cells == want_cells


def test_one_filer_with_a_third_of_all_facts(spark):
    """A very large filer gives the same picks as it would alone."""
    from pyspark.sql import functions as F
    b = random_book(5)
    facts, filers = b.frames(spark)
    copies = facts.where("cik = 7").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(2000))))
    big = copies.select(*[c for c in facts.columns if c not in ("val", "filed", "accn", "pos")],
                        (F.col("val") + F.col("i") * 13).alias("val"), F.date_sub("filed", 400).alias("filed"),
                        F.concat("accn", F.lit("-"), F.col("i").cast("string")).alias("accn"),
                        (F.col("pos") + F.col("i") * 100000).alias("pos")).select(facts.columns)
    keep = ["cik", "basis", "end", "k", "value", "tag", "accn"]
    base = {tuple(r) for r in SheetPlan(facts, filers).cells.where("value IS NOT NULL AND cik <> 7").select(keep).collect()}
    grown = {tuple(r) for r in SheetPlan(facts.unionByName(big), filers).cells.where("value IS NOT NULL").select(keep).collect()}
    assert base <= grown
    alone = {tuple(r) for r in SheetPlan(facts.unionByName(big).where("cik = 7"), filers.where("cik = 7")).cells.where(
        "value IS NOT NULL").select(keep).collect()}
    assert {r for r in grown if r[0] == 7} == alone
