"""Filter interaction audit by contractions of contingency tensors.

Every document gets one bit a filter (1: it fails).  Counts of documents, of good
and of toxic ones per part and bit pattern form a tensor with one axis of length
two a filter.  An einsum with a selector of length two along each axis (pass, fail
or all) then yields what any order of the filters keeps and removes at each step,
so no order is ever run over the documents.

Filters are columns that say whether a text fails, or DUPLICATE: the text equals
that of a smaller id anywhere in the table, whatever other filters remove.  Texts
are told apart by their SHA-256.

Null texts are empty texts, a null part is the empty string.  A null id is smaller
than none and greater than none: such rows are never duplicates and carry no label;
rows that share the smallest id of a text are none either.  Several labels of one
id count as their largest.  A repeated row counts each time.  An empty table has no
parts, hence no rows.  Only the id, text and part columns are read.

Parts that hold a third of all rows are counted in partial sums; a text's copies
meet as one row a part and label, never one by one.
"""

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.tables import words

DUPLICATE = "duplicate"
#: k filters make k! orders; this bounds what is returned a part.
MOST_FILTERS = 7
#: Parts contracted at once.
PARTS_AT_ONCE = 64
#: What a selector picks of an axis whose two places are pass and fail.
SELECTORS = {"pass": np.array([1, 0]), "fail": np.array([0, 1]), "all": np.array([1, 1])}
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> list[tuple[str, Column | str]]:
    """The audited filters: few words, few distinct words, many capitals, symbols, copies."""
    told = words(text)
    return [
        ("A", F.size(told) < 200),
        ("B", 100 * F.size(F.array_distinct(told)) < 50 * F.size(told)),
        ("C", 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text)),
        ("D", text.rlike("[#$%&*|]")),
        ("E", DUPLICATE),
    ]


def patterns(docs: DataFrame, labels: DataFrame, filters: Sequence[tuple[str, Column | str]], id_column: str = "doc_id",
             text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, code, n, good, toxic): counts per part and bit pattern; the first filter is the highest bit."""
    k = len(filters)
    bit = {i: 1 << (k - 1 - i) for i in range(k)}
    copies = sum(bit[i] for i, (_, fails) in enumerate(filters) if isinstance(fails, str))
    own = F.lit(0)
    for i, (_, fails) in enumerate(filters):
        if not isinstance(fails, str):
            own = own + F.when(fails, bit[i]).otherwise(0)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(part_column, F.lit("")).alias("part"), F.coalesce(text_column, F.lit("")).alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own.alias("code"))
    marks = labels.where(f"{id_column} is not null").groupBy(F.col(id_column).alias("of_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks, F.col("id") == F.col("of_id"), "left").select(
        "id", "part", "digest", "code", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kind = ["digest", "part", "code", "good", "toxic"]
    single = marked.groupBy("id", *kind).agg(F.count("*").alias("n"))
    texts = single.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    fresh = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    told = texts.withColumn("least", least).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("code"), fresh.alias("n")), F.struct((F.col("code") + copies).alias("code"), (F.col("n") - fresh).alias("n")))).alias("c"))
    return told.groupBy("part", F.col("c.code").alias("code")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def contract(tensor: np.ndarray, choice: tuple[str, ...]) -> np.ndarray:
    """tensor (part, 2 a filter ..., count) summed over what choice selects along each filter's axis: (part, count)."""
    axes = "abcdefg"[:len(choice)]
    return np.einsum(f"p{axes}m,{','.join(axes)}->pm", tensor, *[SELECTORS[c] for c in choice])


def steps(tensor: np.ndarray, names: Sequence[str]) -> tuple[list[tuple[str, int]], np.ndarray]:
    """((order, step) of each row, array (part, row, measure)) for all orders of the filters."""
    k, known = len(names), {}

    def sums(choice: list[str]) -> np.ndarray:
        key = tuple(choice)
        if key not in known:
            known[key] = contract(tensor, key)
        return known[key]

    orders = list(itertools.permutations(range(k)))
    out = np.zeros((len(tensor), len(orders) * k, len(MEASURES)), np.int64)
    total = np.zeros((len(tensor), k), np.int64)
    place, filter_of = [], []
    for order in orders:
        for s, f in enumerate(order):
            earlier, alone = order[:s], ["pass"] * k
            alone[f] = "fail"
            keeps = ["pass" if i in earlier or i == f else "all" for i in range(k)]
            removes = ["pass" if i in earlier else "fail" if i == f else "all" for i in range(k)]
            fails = ["fail" if i == f else "all" for i in range(k)]
            row, here = out[:, len(place)], sums(removes)
            row[:, 0], row[:, 1], row[:, 2], row[:, 3] = sums(keeps)[:, 0], here[:, 0], sums(fails)[:, 0] - here[:, 0], sums(alone)[:, 0]
            row[:, 4], row[:, 5] = here[:, 1], here[:, 2]
            total[:, f] += here[:, 0]
            place.append(("".join(names[i] for i in order), s + 1)), filter_of.append(f)
    out[:, :, 6] = total[:, filter_of]
    return place, out


def audit(docs: DataFrame, labels: DataFrame, filters: Sequence[tuple[str, Column | str]], id_column: str = "doc_id",
          text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, filter_order, step, and MEASURES) for every part, every order of the filters and every step, zeros included.

    Columns of filters are written over a column "text" that is never null.
    """
    names, k = [n for n, _ in filters], len(filters)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    counts = patterns(docs, labels, filters, id_column, text_column, part_column)
    # at most 2^k cells a part
    tensors = counts.groupBy("part").agg(F.collect_list(F.struct("code", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS_AT_ONCE):
                batch = whole.slice(at, PARTS_AT_ONCE)
                cells = batch.column(1)
                flat = cells.flatten()
                which = np.repeat(np.arange(batch.num_rows), np.asarray(cells.value_lengths()))
                tensor = np.zeros((batch.num_rows, 1 << k, 3), np.int64)
                code = np.asarray(flat.field("code"))
                for m, name in enumerate(("n", "good", "toxic")):
                    np.add.at(tensor[:, :, m], (which, code), np.asarray(flat.field(name)))
                place, out = steps(tensor.reshape(batch.num_rows, *[2] * k, 3), names)
                part = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(place))))
                columns = [part, pa.array([o for o, _ in place] * batch.num_rows), pa.array([s for _, s in place] * batch.num_rows, pa.int32())]
                columns += [pa.array(out[:, :, m].ravel()) for m in range(len(MEASURES))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *MEASURES])

    return tensors.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))
