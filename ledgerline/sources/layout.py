"""Tables laid out by concept, so that a read of some concepts opens only their files."""

import zlib

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.plans.stage import write_stage

#: Folders of a table; concepts are dealt to them by their name.
TAG_PARTS = 32
PART = "tag_part"


def part_of(tag: Column | str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(tag) if isinstance(tag, str) else tag, F.lit("")).cast("binary")), F.lit(TAG_PARTS)).cast("int")


def write_by_tag(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """df as a written table with a folder for each part of its concepts, sorted inside by concept and then by ``order``.

    Tasks keep their rows: a concept that holds a third of them is written by as many
    tasks as hold it.  Rows that know their part, and are grouped in this order, are not
    sorted again.
    """
    parted = df if PART in df.columns else df.withColumn(PART, part_of("tag"))
    return write_stage(parted.sortWithinPartitions(PART, "tag", *order), name, by=[PART])


def of_tags(df: DataFrame, tags) -> DataFrame:
    """Rows of some concepts; of a table written by concept only the folders that can hold them are listed and read."""
    tags = list(dict.fromkeys(tags))
    rows = df.where(F.col("tag").isin(tags))
    if PART not in df.columns:
        return rows
    return rows.where(F.col(PART).isin(sorted({zlib.crc32(t.encode()) % TAG_PARTS for t in tags})))
