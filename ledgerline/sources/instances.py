"""Filed XML: dimensional facts of an instance, the member trees and labels of its linkbases.

Documents are rows (cik, accn, form, filed, xml).  Each is parsed once, by a schema
that names the concepts asked for, so that the parser skips all other facts; what is
read more than once is a written table.  Facts meet their contexts, and members
their trees, by equi-joins: no document is gathered again.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.plans.stage import unbroadcast

FILED = ["cik", "accn", "form", "filed"]
_OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
# The usual prefixes of the instance's and of the linkbases' own elements, none included.
INSTANCE_PREFIXES, LINK_PREFIXES = ("", "xbrli:"), ("", "link:")
DIMENSIONAL, LABEL_ROLE = "http://xbrl.org/int/dim/arcrole/", r"([^/]+)$"


def _parsed(docs: DataFrame, schema: str, root: str) -> DataFrame:
    d = F.from_xml("xml", F.lit(f"struct<{schema}>"), {**_OPTIONS, "rowTag": root})
    return docs.select(*FILED, d.alias("d")).select(*FILED, "d.*", (F.col("d").isNull() | F.col("d._corrupt").isNotNull()).alias("broken"))


def _either(prefixes: Sequence[str], name: str) -> Column:
    """The arrays of an element under any of its prefixes, one after the other."""
    return F.flatten(F.array_compact(F.array(*[F.col(f"`{p}{name}`") for p in prefixes])))


def _instance_schema(concepts: Sequence[str]) -> str:
    part = "{0}: struct<`xbrldi:explicitMember`: array<struct<_dimension: string, _VALUE: string>>>"
    fields = []
    for p in INSTANCE_PREFIXES:
        q = lambda n: f"`{p}{n}`"  # noqa: B023, E731
        entity = f"{q('entity')}: struct<{part.format(q('segment'))}>, {part.format(q('scenario'))}"
        fields.append(f"{q('context')}: array<struct<_id: string, {entity}, {q('period')}: struct<{q('startDate')}: string, {q('endDate')}: string, {q('instant')}: string>>>")
    fields += [f"`us-gaap:{c}`: array<struct<_contextRef: string, _unitRef: string, _VALUE: string>>" for c in concepts]
    return ", ".join([*fields, "_corrupt: string"])


def _contexts() -> Column:
    """(context_id, axes, start, end, instant) of all contexts; axes in the order of the document."""
    def one(p: str) -> Column:
        def read(c: Column) -> Column:
            member = lambda part: F.coalesce(part["xbrldi:explicitMember"], F.array().cast("array<struct<_dimension:string,_VALUE:string>>"))
            period = c[f"{p}period"]
            found = F.concat(member(c[f"{p}entity"][f"{p}segment"]), member(c[f"{p}scenario"]))
            return F.struct(
                c["_id"].alias("context_id"), F.transform(found, lambda m: F.struct(m["_dimension"].alias("axis"), F.trim(m["_VALUE"]).alias("member"))).alias("axes"),
                period[f"{p}startDate"].alias("start"), period[f"{p}endDate"].alias("end"), period[f"{p}instant"].alias("instant"))
        return F.transform(F.col(f"`{p}context`"), read)
    return F.flatten(F.array_compact(F.array(*[one(p) for p in INSTANCE_PREFIXES])))


def _day(c: str) -> Column:
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def checked_dim_facts(docs: DataFrame, concepts: Sequence[str], stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Facts of the asked concepts with their contexts' axes and period, with a ``reason`` where one cannot be used.

    A document that is none is one row that says so; a fact without a value (nil)
    is no fact.  A repeated fact stays repeated: ``segments.dedupe`` folds it.
    """
    def tagged(concept: str) -> Column:
        return F.transform(F.col(f"`us-gaap:{concept}`"), lambda f: F.struct(
            F.lit(concept).alias("tag"), f["_contextRef"].alias("context_id"), F.trim(f["_VALUE"]).alias("text")))

    told = F.flatten(F.array_compact(F.array(*map(tagged, concepts))))
    docs = stage(_parsed(docs, _instance_schema(concepts), "xbrl").select(*FILED, "broken", _contexts().alias("contexts"), told.alias("facts")), "instances")
    facts = docs.select(*FILED, F.explode("facts").alias("f")).select(*FILED, "f.*").where("text IS NOT NULL AND text <> ''")
    contexts = docs.select("cik", "accn", F.explode("contexts").alias("c")).select("cik", "accn", "c.*", F.lit(True).alias("known")).dropDuplicates(["cik", "accn", "context_id"])
    rows = facts.join(contexts, ["cik", "accn", "context_id"], "left")
    end, val = F.coalesce(_day("instant"), _day("end")), F.col("text").try_cast("double")
    reason = (F.when(F.col("known").isNull(), "no such context").when(end.isNull(), "no period")
              .when(F.col("instant").isNull() & _day("start").isNull(), "no period").when(val.isNull(), "no number"))
    rows = rows.select(*FILED, "tag", "context_id", F.when(F.col("instant").isNull(), _day("start")).alias("period_start"), end.alias("period_end"),
                       "axes", val.alias("val"), reason.alias("reason"))
    return rows.unionByName(docs.where("broken").select(*FILED, F.lit("no document").alias("reason")), allowMissingColumns=True)


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NULL").drop("reason")


_LOC = "loc: array<struct<`_xlink:label`: string, `_xlink:href`: string>>"


def _with_prefixes(fields: str, names: Sequence[str], prefix: str) -> str:
    """The field list with the link prefix on its element names."""
    for n in names:
        fields = fields.replace(f"{n}:", f"`{prefix}{n}`:")
    return fields


def _concept(locs: Column, label: Column) -> Column:
    """The concept that a locator points at: what follows the # of its address, its prefix set off by a colon."""
    href = F.get(F.filter(locs, lambda x: x["_xlink:label"] == label), F.lit(0))["_xlink:href"]
    return F.regexp_replace(F.regexp_extract(href, r"#(.+)$", 1), "^([^_]+)_", "$1:")


def arcs(docs: DataFrame) -> DataFrame:
    """(cik, accn, role, kind, parent, child) of definition linkbases; a link's locators are looked up in place."""
    body = f"array<struct<`_xlink:role`: string, {_LOC}, definitionArc: array<struct<`_xlink:arcrole`: string, `_xlink:from`: string, `_xlink:to`: string>>>>"
    schema = ", ".join(f"`{p}definitionLink`: {_with_prefixes(body, ('loc', 'definitionArc'), p)}" for p in LINK_PREFIXES)
    rows = _parsed(docs, f"{schema}, _corrupt: string", "linkbase")

    def read(p: str) -> Column:
        of_link = lambda k: F.transform(k[f"{p}definitionArc"], lambda a: F.struct(
            k["_xlink:role"].alias("role"), F.regexp_extract(a["_xlink:arcrole"], LABEL_ROLE, 1).alias("kind"),
            _concept(k[f"{p}loc"], a["_xlink:from"]).alias("parent"), _concept(k[f"{p}loc"], a["_xlink:to"]).alias("child")))
        return F.flatten(F.transform(F.col(f"`{p}definitionLink`"), of_link))

    found = F.flatten(F.array_compact(F.array(*[read(p) for p in LINK_PREFIXES])))
    return rows.select("cik", "accn", F.inline(found)).distinct()


def role_members(definition_arcs: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(cik, accn, role, axis, parent_member, member): the members below each axis of each role, at any depth.

    Top members hang below the axis's domain and have no parent.  Each step goes one
    level down from the members found last, and ends when it finds none that is new.
    """
    key = ["cik", "accn", "role"]
    below = stage(definition_arcs.where("kind = 'domain-member'").select(*key, "parent", F.col("child").alias("member")), "member-arcs")
    domains = definition_arcs.where("kind = 'dimension-domain'").select(*key, F.col("parent").alias("axis"), F.col("child").alias("parent"))
    last = stage(domains.join(below, [*key, "parent"]).select(*key, "axis", F.lit(None).cast("string").alias("parent_member"), "member").distinct(), "members-1")
    found, depth = last, 1
    while last.limit(1).count():
        depth += 1
        down = last.select(*key, "axis", F.col("member").alias("parent")).distinct().join(below, [*key, "parent"])
        down = down.select(*key, "axis", F.col("parent").alias("parent_member"), "member").distinct()
        # a tree that bites its tail brings the same pairs again
        last = stage(down.join(unbroadcast(found.where("parent_member IS NOT NULL")), [*key, "axis", "parent_member", "member"], "left_anti"), f"members-{depth}")
        found = found.unionByName(last)
    return found


def member_labels(docs: DataFrame) -> DataFrame:
    """(cik, accn, member, label_role, label) of label linkbases."""
    label = "label: array<struct<`_xlink:label`: string, `_xlink:role`: string, _VALUE: string>>"
    body = f"array<struct<{_LOC}, {label}, labelArc: array<struct<`_xlink:from`: string, `_xlink:to`: string>>>>"
    schema = ", ".join(f"`{p}labelLink`: {_with_prefixes(body, ('loc', 'label', 'labelArc'), p)}" for p in LINK_PREFIXES)
    rows = _parsed(docs, f"{schema}, _corrupt: string", "linkbase")

    def read(p: str) -> Column:
        def of_link(k: Column) -> Column:
            texts = lambda a: F.filter(k[f"{p}label"], lambda x: x["_xlink:label"] == a["_xlink:to"])
            return F.flatten(F.transform(k[f"{p}labelArc"], lambda a: F.transform(texts(a), lambda x: F.struct(
                _concept(k[f"{p}loc"], a["_xlink:from"]).alias("member"), F.regexp_extract(x["_xlink:role"], LABEL_ROLE, 1).alias("label_role"), x["_VALUE"].alias("label")))))
        return F.flatten(F.transform(F.col(f"`{p}labelLink`"), of_link))

    found = F.flatten(F.array_compact(F.array(*[read(p) for p in LINK_PREFIXES])))
    return rows.select("cik", "accn", F.inline(found)).distinct()
