"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents; other columns of the input are not
carried along, whatever their names.  Null and repeated ids are rows like others, a
repeated row is judged like its twin, texts are read whole, and an empty table gives
an empty table.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerline.llm import bpe, crf, divergence, mixing, parity
from ledgerline.llm.components import MOST_BROADCAST, of_ids
from ledgerline.llm.queries import RANK_FILE
from ledgerline.llm.tables import fold_of, read, workers_find_us
from ledgerline.plans.stage import write_stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is less sure than this is rejected.
LEAST_LANGUAGE_SCORE = 0.35


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents and a name of the row, so that decisions find their rows whatever the ids."""
    workers_find_us(docs.sparkSession)
    return docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text", "lang", "source").alias("h")).alias("_row"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows named in rejected (_row); they are broadcast only if they are few."""
    return of_ids(docs, "_row", write_stage(rejected.distinct(), "rejected"), "leftanti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose words agree on no language, go; a missing label is filled with the prediction."""
    workers_find_us(spark)
    docs = docs.select(*COLUMNS)
    told = crf.identify(docs, crf.fit(docs.where(fold_of(F.col("doc_id"), 5) != 0)))
    kept = told.where((F.col("lang_pred") != crf.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counting rules or lie far from their language's histograms go; null and empty texts fail them."""
    rows = _rows(docs)
    return _without(rows, divergence.judge(rows, "_row").where("not kept").select("_row")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the least id stays; texts without words stay."""
    rows = _rows(docs)
    classes = write_stage(parity.near_classes(rows, "_row").where("n_shingles > 0"), "classes")
    kept = _without(rows, classes.where("not (_row <=> component_id)").select("_row"))
    # the same row, given twice, is both times the first of its group
    twice = write_stage(classes.groupBy("_row").count().where("count > 1").select("_row"), "twice")
    if not twice.limit(1).count():
        return kept.select(*COLUMNS)
    return of_ids(kept, "_row", twice, "leftanti").select(*COLUMNS).unionByName(of_ids(kept, "_row", twice, "leftsemi").select(*COLUMNS).dropDuplicates())


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as many times as its source's target gives it copies."""
    rows = _rows(docs)
    mixed = write_stage(mixing.mix(rows, id_column="_row").groupBy("id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "mixed")
    # one copy each is the rule, only the others are joined; equal rows share their copies
    others = mixed.where("copies <> rows").select(F.col("id").alias("_id"), "copies", "rows")
    few = others.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(others) if few else others, F.col("_row").eqNullSafe(F.col("_id")), "left")
    share = F.coalesce(F.floor(F.col("copies") / F.col("rows")), F.lit(1)).cast("int")
    even, uneven = joined.withColumn("_copies", share), F.coalesce(F.col("copies") % F.col("rows") != 0, F.lit(False))
    if others.where(uneven).limit(1).count():
        # equal rows whose copies do not divide among them: the first ones take one more
        nth = F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(0)))
        more = F.when(nth <= F.col("copies") % F.col("rows"), 1).otherwise(0)
        even = even.where(~uneven).unionByName(even.where(uneven).withColumn("_copies", F.col("_copies") + more))
    return even.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and digests of them and of the text that they decode to; a null text is an empty one."""
    workers_find_us(spark)
    return bpe.round_trip(docs, RANK_FILE, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mixing_sources),
    ("byte_bpe", byte_bpe),
]

#: No stage but the counting rules can be said in SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
