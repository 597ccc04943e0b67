"""Segment tables on small hand-built filings."""

import datetime as dt

import pytest

from ledgerline.operators import segments as G
from ledgerline.plans.stage import write_stage

SCHEMA = ("cik bigint, accn string, form string, filed date, tag string, context_id string, period_start date, period_end date, "
          "axes array<struct<axis:string,member:string>>, val double")
S, P, R, Q = G.SEGMENT_AXIS, G.PRODUCT_AXIS, G.GEOGRAPHY_AXIS, G.QUALIFIER_AXIS


class Filings:
    def __init__(self):
        self.rows, self.roles, self.labels = [], [], []

    def fact(self, cik, val, *axes, tag="Revenues", ctx=None, filed="2024-02-15", accn=None, form="10-K"):
        ctx = ctx or "|".join(f"{a}={m}" for a, m in axes) or "all"
        self.rows.append((cik, accn or f"a{cik}", form, dt.date.fromisoformat(filed), tag, ctx, dt.date(2023, 1, 1), dt.date(2023, 12, 31),
                          [{"axis": a, "member": m} for a, m in axes], float(val)))

    def role(self, cik, role, axis, *members, parent=None):
        self.roles += [(cik, f"a{cik}", role, axis, parent, m) for m in members]


def filings():
    f = Filings()
    # 1 the same fact printed twice, an older filing, a concept nobody models
    f.fact(1, 100), f.fact(1, 60, (P, "A")), f.fact(1, 60, (P, "A")), f.fact(1, 40, (P, "B"))
    f.fact(1, 7, (P, "A"), tag="SomeDisclosure"), f.fact(1, 999, (P, "A"), filed="2023-02-15", accn="old")
    f.role(1, "r", P, "A", "B")
    # 2 two roles on one axis
    f.fact(2, 416.25), f.fact(2, 300.25, (P, "Product")), f.fact(2, 116, (P, "Service"))
    f.fact(2, 200.25, (P, "Phone")), f.fact(2, 100, (P, "Mac"))
    f.role(2, "face", P, "Product", "Service"), f.role(2, "note", P, "Phone", "Mac", "Service")
    # 3 subtotal beside its children; 4 the aggregate alone stays
    f.fact(3, 100), f.fact(3, 70, (S, "Sum")), f.fact(3, 30, (S, "X")), f.fact(3, 40, (S, "Y")), f.fact(3, 30, (S, "Z"))
    f.role(3, "r", S, "X", "Y", parent="Sum"), f.role(3, "r", S, "Sum", "Z")
    f.fact(4, 70), f.fact(4, 70, (S, "Sum"))
    f.role(4, "r", S, "X", "Y", parent="Sum"), f.role(4, "r", S, "Sum")
    # 5 reconciling rows: the segment total and the sum of the others are dropped
    f.fact(5, 67589), f.fact(5, 50000, (S, "X")), f.fact(5, 24282, (S, "Y"))
    f.fact(5, 74282, (Q, "Material")), f.fact(5, -805, (Q, "Corporate")), f.fact(5, -5888, (Q, "Elim")), f.fact(5, -6693, (Q, "Both"))
    f.role(5, "r", S, "X", "Y"), f.role(5, "r", Q, "Material", "Corporate", "Elim", "Both")
    # 6 already closes to the unit: a declared reconciling row stays out
    f.fact(6, 100), f.fact(6, 60, (S, "X")), f.fact(6, 40, (S, "Y")), f.fact(6, 0.05, (Q, "Corporate"))
    f.role(6, "r", S, "X", "Y"), f.role(6, "r", Q, "Corporate")
    # 7 short by 0.4%: hidden
    f.fact(7, 1000), f.fact(7, 596, (S, "X")), f.fact(7, 400, (S, "Y"))
    f.role(7, "r", S, "X", "Y")
    # 8 cross-tab only; 9 its second axis carries a total
    for cik in (8, 9):
        f.fact(cik, 150)
        for m, us, eu in (("X", 55, 52), ("Y", 23, 20)):
            f.fact(cik, us, (S, m), (R, "US")), f.fact(cik, eu, (S, m), (R, "EU"))
            if cik == 9:
                f.fact(cik, us + eu, (S, m), (R, "World"))
        f.role(cik, "r", S, "X", "Y"), f.role(cik, "g", R, "US", "EU", "World")
    # 10 several views of one member: the widest qualifier leads
    f.fact(10, 90), f.fact(10, 50, (S, "X")), f.fact(10, 60, (S, "X"), (Q, G.OPERATING_SEGMENTS)), f.fact(10, 40, (S, "Y"), (Q, G.OPERATING_SEGMENTS))
    f.fact(10, -10, (Q, "Elim"))
    f.role(10, "r", S, "X", "Y"), f.role(10, "r", Q, "Elim", G.OPERATING_SEGMENTS)
    # 11 another axis beside the segment: not a segment row
    f.fact(11, 10), f.fact(11, 10, (S, "X"), ("AccidentYear", "2020"))
    f.role(11, "r", S, "X")
    f.labels.append((5, "a5", "Corporate", "terse", G.STANDARD_LABELS[0][0]))
    f.labels.append((5, "a5", "Elim", "terse", "Optum Eliminations"))
    return f


@pytest.fixture(scope="module")
def tables(spark):
    f = filings()
    dim = spark.createDataFrame(f.rows, SCHEMA)
    roles = spark.createDataFrame(f.roles, "cik bigint, accn string, role string, axis string, parent_member string, member string")
    labels = spark.createDataFrame(f.labels, "cik bigint, accn string, member string, label_role string, label string")
    facts = G.dedupe(G.allowed(G.newest_annual(dim)))
    out = {}
    for r in G.segment_tables(facts, roles, labels, G.containment(roles, write_stage), write_stage).collect():
        out.setdefault(r["cik"], {})[(r["role"], r["member"])] = r
    return out


def values(tables, cik):
    return {k: r["val"] for k, r in tables.get(cik, {}).items()}


def test_duplicates_and_views(tables):
    assert values(tables, 1) == {("r", "A"): 60, ("r", "B"): 40}
    assert values(tables, 2) == {("face", "Product"): 300.25, ("face", "Service"): 116, ("note", "Phone"): 200.25, ("note", "Mac"): 100,
                                 ("note", "Service"): 116}


def test_subtotals(tables):
    assert set(values(tables, 3)) == {("r", "X"), ("r", "Y"), ("r", "Z")}
    assert values(tables, 4) == {("r", "Sum"): 70}


def test_reconciling_rows(tables):
    assert values(tables, 5) == {("r", "X"): 50000, ("r", "Y"): 24282, ("r", "Corporate"): -805, ("r", "Elim"): -5888}
    assert tables[5][("r", "Corporate")]["label"] == "Reconciling items" and tables[5][("r", "Corporate")]["recon"]
    assert tables[5][("r", "Elim")]["label"] == "Optum Eliminations"
    assert set(values(tables, 6)) == {("r", "X"), ("r", "Y")}


def test_gate_and_crosstab(tables):
    assert 7 not in tables and 9 not in tables and 11 not in tables
    assert values(tables, 8) == {("r", "X"): 107, ("r", "Y"): 43, ("g", "US"): 78, ("g", "EU"): 72}
    assert {r["along"] for r in tables[8].values()} == {R, S}


def test_lead_view(tables):
    assert values(tables, 10) == {("r", "X"): 60, ("r", "Y"): 40, ("r", "Elim"): -10}
    assert tables[10][("r", "X")]["others"] == [""]


def test_member_trees_have_any_depth(spark):
    arcs = [(1, "a", "r", "x", f"m{i - 1}" if i else None, f"m{i}") for i in range(12)]
    tree = spark.createDataFrame(arcs, "cik bigint, accn string, role string, axis string, parent_member string, member string")
    assert G.containment(tree, write_stage).count() == 12 * 11 // 2
