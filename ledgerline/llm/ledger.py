"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content: the SHA-256 of its UTF-8
bytes names a blob.  The ledger, a Parquet table that is only appended to, says
which rules in which version have read a blob and what they found.  A run reads
the texts of those blobs alone that some current rule version has not read, and of
these only the rules that are new to them; one version of each blob is read,
however many paths hold it.  Findings are then joined back to all versions.

A rule's version is a digest of its pattern and its least length, so a changed rule
is a new one and an unchanged rule never reads a blob twice.

Null texts are empty texts and, like these, hold no secrets.  Null and repeated ids
are kept: each row of the versions gives one row.  Of a blob the row with the
smallest id is read; rows that repeat that id with the same text are read too, and
count once.  Texts of any length are read whole.  An empty table gives no rows and
adds nothing.  Only the id and text columns are read, other columns may have any name.
A run that dies before its rows are appended leaves the ledger as it was.
"""

import dataclasses
import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.plans.stage import write_stage

#: Blobs (about 100 bytes each) that may be broadcast, and findings (about 40) with them.
MOST_BLOBS, MOST_SPANS = 200_000, 300_000
#: Blobs in more versions than this and than a hundred-thousandth of all versions are joined back by broadcast: at most 100,000 of them.
HOT_COPIES, HOT_SHARE = 10_000, 100_000
#: Findings of a hot blob that is joined back by broadcast.
HOT_FINDINGS = 8
#: Rules of a run, told apart by bits of a long.
MOST_RULES = 62
LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"


@dataclasses.dataclass(frozen=True)
class Rule:
    """Leftmost matches of pattern that do not overlap; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    @property
    def name(self) -> str:
        told = repr((self.pattern, self.least, self.group, self.any_case))
        return f"{self.kind}@{hashlib.sha256(told.encode()).hexdigest()[:8]}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, re.ASCII | re.IGNORECASE if self.any_case else re.ASCII).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: The three base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Kinds that stand out by their form alone.
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("chat_bot", r"xox[abprs]-[0-9A-Za-z-]+", 15),
)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def _read(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """LEDGER rows of (blob, text, left): what the rules of the bits of left find."""
    names, told = [r.name for r in rules], pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            read, found = [], []
            for left, value in zip(batch.column(2).to_pylist(), batch.column(1)):
                text, mine = value.as_py(), [i for i in range(len(rules)) if left >> i & 1]
                read.append([names[i] for i in mine])
                found.append([{"rule": names[i], "start": a, "end": b} for i in mine for a, b in rules[i].spans(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(read, told), pa.array(found, kind)], names=["blob", "rules", "findings"])

    return rows.select("blob", "text", "left").mapInArrow(run, LEDGER)


def _unread(rows: DataFrame, blobs: DataFrame, every: int) -> DataFrame:
    """Of rows (id, blob, text) one for each blob that some rule has not read, with these rules.

    blobs: (blob, id, copies, left).  Texts stay where they are if the blobs to
    read are few, or the others are: those that stand twice or are known.
    Otherwise rows meet blobs by blob and id, which no group of copies shares.
    """
    todo, odd = blobs.where("left <> 0"), blobs.where(f"copies > 1 or left <> {every}")
    named = lambda b: b.select(F.col("blob").alias("_blob"), F.col("id").alias("_id"), "left")
    few = lambda b: b.limit(MOST_BLOBS + 1).count() <= MOST_BLOBS
    same = (F.col("blob") == F.col("_blob")) & F.col("id").eqNullSafe(F.col("_id"))
    if few(todo):
        return rows.join(F.broadcast(named(todo)), same)
    if few(odd):
        met = rows.join(F.broadcast(named(odd)), F.col("blob") == F.col("_blob"), "left")
        fresh = F.col("_blob").isNull() | (F.col("id").eqNullSafe(F.col("_id")) & (F.col("left") != 0))
        return met.where(fresh).withColumn("left", F.coalesce("left", F.lit(every)))
    return rows.join(named(todo), same)


def scan(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, blob, findings) of every version; what was not read before is read and appended to the ledger at path.

    findings: array of (kind, start, end) in code points, end exclusive, by start
    and then by the order of rules.
    """
    spark, every = versions.sparkSession, [r.name for r in rules]
    if len({r.kind for r in rules}) < len(rules) or not 1 <= len(rules) <= MOST_RULES:
        raise ValueError(f"1 to {MOST_RULES} rules of different kinds")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = versions.select(F.col(id_column).alias("id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    addresses = write_stage(rows.select("id", "blob"), "ledger-addresses")
    copies = addresses.groupBy("blob").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    seen = _ledger(spark, path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    read = F.coalesce("seen", F.array().cast("array<string>"))
    left = sum((F.when(F.array_contains(read, name), 0).otherwise(1 << i) for i, name in enumerate(every)), F.lit(0).cast("long"))
    blobs = write_stage(copies.join(seen, "blob", "left").select("blob", "id", "copies", left.alias("left")), "ledger-blobs")
    if blobs.where("left <> 0").limit(1).count():
        _read(_unread(rows, blobs, (1 << len(rules)) - 1), rules).dropDuplicates(["blob"]).write.mode("append").parquet(path)

    now = F.array(*map(F.lit, every))
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    mine = F.filter("findings", lambda f: F.array_contains(now, f.rule))
    found = _ledger(spark, path).select("blob", mine.alias("findings")).where("size(findings) > 0").groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("f"))
    ordered = F.array_sort(F.transform("f", lambda f: F.struct(f.start.alias("start"), F.array_position(now, f.rule).alias("place"), f.end.alias("end"), kinds[f.rule].alias("kind"))))
    # a blob of this run only, with its number of versions
    found = write_stage(found.join(blobs.select("blob", "copies"), "blob").select(
        "blob", "copies", F.transform(ordered, lambda f: F.struct(f.kind.alias("kind"), f.start.alias("start"), f.end.alias("end"))).alias("findings")), "ledger-findings")
    return _back(addresses, found, id_column)


def _back(addresses: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """Findings at every version: blobs in a great many versions by broadcast, the others by a join on the blob."""
    rows, spans = found.agg(F.count("*"), F.coalesce(F.sum(F.size("findings")), F.lit(0))).first()
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if rows <= MOST_BLOBS and spans <= MOST_SPANS:
        joined = addresses.join(F.broadcast(found.drop("copies")), "blob", "left")
        return joined.select(F.col("id").alias(id_column), "blob", F.coalesce("findings", none).alias("findings"))
    least = max(HOT_COPIES, addresses.count() // HOT_SHARE)
    hot = (F.col("copies") > least) & (F.size("findings") <= HOT_FINDINGS)
    often = found.where(hot).select("blob", F.col("findings").alias("_often"))
    joined = addresses.join(F.broadcast(often), "blob", "left").join(found.where(~hot).drop("copies"), "blob", "left")
    return joined.select(F.col("id").alias(id_column), "blob", F.coalesce("_often", "findings", none).alias("findings"))


def joined(findings, *kinds: str):
    """kind:start:end of the findings, of these kinds or of all, joined by commas."""
    those = F.filter(findings, lambda f: f.kind.isin(*kinds)) if kinds else F.col(findings)
    return F.array_join(F.transform(those, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")
