"""Reading the supplied tables, and columns that several operators share."""

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word of the contracts: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def workers_find_us(spark: SparkSession) -> None:
    """Python workers import this package; where it is not installed (or sent with --py-files) they look beside the driver's copy."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_us(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def words(text: Column) -> Column:
    """The words of a text as an array (null: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
