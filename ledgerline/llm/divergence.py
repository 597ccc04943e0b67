"""Quality rules by distribution divergence, beside a few counting rules.

Two histograms of a text are compared with those of its language by the
Jensen-Shannon distance (square root, base 2, so between 0 and 1): the shares of
six character classes, and the shares of the language's common words among all
words.  A language's reference is the sum over all its texts in the table that
pass the counting rules and are not far from a first look at them: the medians of
the shares, where each different text of the least length has one vote, however
long or often repeated it is.  Where no text is near the first
look, it is the reference itself.  Short texts scatter by chance alone, so each
comparison has a least length, below which it raises no objection.

Null texts count as empty and fail the base rule.  Texts with a null or unlisted
language are compared with the texts of that same label, by characters only.
Repeated rows are judged alike, each by itself.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.tables import WORD, words
from ledgerline.plans.stage import write_stage

#: Patterns of the character classes; a text's other characters are the last class.  No character is in two of them.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'()\-]", r"[\x20\x09-\x0D]")
#: Twelve of the most common words of each language.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
}
LEAST_CHARS, LEAST_WORDS = 300, 100
FIRST_DISTANCE, MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.15, 0.3
#: Short texts may be farther by this over their characters.
SHORT_ALLOWANCE = 50.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Shares are counted in steps of one in so many for their medians.
SHARE_STEPS = 2000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Different repeated windows up to which their places are found by looking each window up among them.
FEW_REPEATED = 8


def repeat_words(text_words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text.

    Sorted hashes of the windows tell which ones repeat.  If these are few, their
    places are looked up; else windows are sorted by hash with their place, so that
    equal ones are neighbours.
    """
    def by_sorting(w: Column) -> Column:
        def of(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i).x == F.get(s, j).x, F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.array_sort(F.transform(twice, lambda i: F.get(s, i).i))
        return let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), of)

    def places(w: Column) -> Column:
        follows = lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a == b, a))
        repeated = let(F.sort_array(w), lambda s: F.array_distinct(F.array_compact(follows(s))))
        look = lambda r: F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(r, x), i)), lambda i: i.isNotNull())
        return let(repeated, lambda r: F.when(F.size(r) <= FEW_REPEATED, look(r)).otherwise(by_sorting(w)))

    def covered(p: Column) -> Column:
        # each window covers three words, less those that the next one covers too
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(places(w), covered))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
        return F.when(F.size(h) < 3, 0).otherwise(let(windows, of_windows))

    return let(F.transform(text_words, lambda w: F.xxhash64(w)), of_hashes)


def base_columns(text: Column, text_words: Column, rest: Column) -> dict[str, Column]:
    """The counts of the base rules; rest is the text without its lower-case letters, which are no symbols."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(text_words).cast("long"),
        "word_chars": F.length(F.array_join(text_words, "")).cast("long"),
        "n_symbols": F.regexp_count(rest, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(text_words).cast("long"),
    }


def _counts(found: Column, wanted: tuple) -> Column:
    return let(F.filter(found, lambda w: w.isin(*wanted)), lambda few: F.array(*[F.size(F.filter(few, _is(c))) for c in wanted]))


def _is(word: str) -> Callable[[Column], Column]:
    return lambda w: w == word


def histograms(text: Column, text_words: Column, lang: Column, rest: Column) -> dict[str, Column]:
    """classes: five class counts; common: twelve word counts (null for an unlisted language).

    Most characters are of the first class: they are taken out of the text in runs,
    and the others are counted in the rest, which is a fifth of it.
    """
    classes = [(F.length(text) - F.length(rest)).cast("long"), *[F.regexp_count(rest, F.lit(c)).cast("long") for c in CLASSES[1:-1]],
               (F.length(text) - F.length(F.array_join(text_words, ""))).cast("long")]  # blanks are what no word holds
    common = None
    low = F.transform(text_words, F.lower)
    for name, wanted in COMMON.items():
        counted = _counts(low, wanted).cast("array<long>")
        common = F.when(lang == name, counted) if common is None else common.when(lang == name, counted)
    return {"classes": F.array(*classes), "common": common}


def with_rest(counts: Column, total: Column) -> Column:
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)))


def js_distance(p: Column, q: Column) -> Column:
    """Of two arrays of counts; null where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def distance(a: Column, b: Column) -> Column:
        each = F.zip_with(a, b, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), total(each)))

    share = lambda a, n: F.transform(a, lambda x: x / n)
    return let(total(p), lambda n: let(total(q), lambda m: F.when((n > 0) & (m > 0), distance(share(p, n), share(q, m)))))


def measure(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(id, lang, text_hash, base counts, chars and common histograms) for every row; one pass over the texts."""
    slim = df.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"), F.col(lang_column).alias("lang"))
    slim = slim.withColumn("words", words(F.col("text"))).withColumn("rest", F.regexp_replace("text", f"{CLASSES[0]}+", ""))
    text, found, rest = F.col("text"), F.col("words"), F.col("rest")
    counted = slim.select("id", "lang", F.xxhash64("text").alias("text_hash"), F.length("text").cast("long").alias("n_chars"), *[c.alias(n) for n, c in base_columns(text, found, rest).items()],
                          *[c.alias(n) for n, c in histograms(text, found, F.col("lang"), rest).items()])
    return counted.select("id", "lang", "text_hash", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          with_rest(F.col("classes"), F.col("n_chars")).alias("chars"), with_rest(F.col("common"), F.col("n_words")).alias("common"))


def references(measured: DataFrame) -> DataFrame:
    """(_lang, ref_chars, ref_common): sums over all given texts of a label."""
    add = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(F.col(c), F.lit(i))), F.lit(0)) for i in range(n)])
    return measured.groupBy(F.col("lang").alias("_lang")).agg(add("chars", len(CLASSES) + 1).alias("ref_chars"), add("common", 13).alias("ref_common"))


def first_look(measured: DataFrame) -> DataFrame:
    """(_lang, ref_chars, ref_common): medians of the shares of texts that pass the counting rules, one vote a different text."""
    long_enough = F.coalesce(F.col("n_chars") >= LEAST_CHARS, F.lit(False))
    many_words = F.coalesce((F.col("n_words") >= LEAST_WORDS) & F.col("common").isNotNull(), F.lit(False))
    votes = measured.where(~F.col("base_failed")).select(
        "lang", "text_hash", F.when(long_enough, F.col("chars")).alias("chars"), F.when(many_words, F.col("common")).alias("common")).distinct()
    steps = lambda c: F.transform(F.col(c), lambda x: F.round(x * SHARE_STEPS / F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, y: a + y)).cast("int"))
    shares = votes.select("lang", F.posexplode(F.concat(
        F.coalesce(steps("chars"), F.array_repeat(F.lit(None).cast("int"), len(CLASSES) + 1)),
        F.coalesce(steps("common"), F.array_repeat(F.lit(None).cast("int"), 13)))).alias("i", "step")).where("step is not null")
    counted = shares.groupBy("lang", "i", "step").agg(F.count("*").alias("n"))  # at most SHARE_STEPS + 1 rows of each share
    upto = Window.partitionBy("lang", "i").orderBy("step")
    half = counted.withColumn("run", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang", "i")))
    medians = half.where("2 * run >= all").groupBy("lang", "i").agg(F.min("step").cast("long").alias("m"))
    found = medians.groupBy(F.col("lang").alias("_lang")).agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("by"))
    at = lambda a, b: F.array(*[F.coalesce(F.try_element_at("by", F.lit(i)), F.lit(0)) for i in range(a, b)])
    return found.select("_lang", at(0, len(CLASSES) + 1).alias("ref_chars"), at(len(CLASSES) + 1, len(CLASSES) + 14).alias("ref_common"))


def with_first(reference: DataFrame, first: DataFrame) -> DataFrame:
    """Both, the first look's only where a language's reference is missing or empty."""
    given = first.select("_lang", F.col("ref_chars").alias("c"), F.col("ref_common").alias("w"))
    filled = lambda own, other: F.when(F.exists(own, lambda x: x > 0), F.col(own)).otherwise(F.coalesce(other, own))
    both = reference.withColumnRenamed("_lang", "_own").join(given, F.col("_own").eqNullSafe(F.col("_lang")), "full")
    known = F.col("ref_chars").isNotNull()
    return both.select(F.when(known, F.col("_own")).otherwise(F.col("_lang")).alias("_lang"), filled("ref_chars", "c").alias("ref_chars"), filled("ref_common", "w").alias("ref_common"))


def compared(measured: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds char_distance and word_distance, null below the least lengths."""
    doubles = lambda c: F.col(c).cast("array<double>")
    return (measured.join(reference, F.col("lang").eqNullSafe(F.col("_lang")), "left")
            .withColumn("char_distance", F.when(F.col("n_chars") >= LEAST_CHARS, js_distance(doubles("chars"), doubles("ref_chars"))))
            .withColumn("word_distance", F.when((F.col("n_words") >= LEAST_WORDS) & F.col("common").isNotNull(), js_distance(doubles("common"), doubles("ref_common"))))
            .drop("_lang", "ref_chars", "ref_common"))


def judge(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(id, base counts, base_failed, char_distance, word_distance, kept) for every row."""
    measured = write_stage(measure(df, id_column, text_column, lang_column), "measured")
    measured = measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    first = write_stage(first_look(measured), "first-look")
    ordinary = compared(measured, first).where(
        ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= FIRST_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= FIRST_DISTANCE))
    told = compared(measured, with_first(references(ordinary), first))
    fine = (F.coalesce(F.col("char_distance") <= MOST_CHAR_DISTANCE + SHORT_ALLOWANCE / F.col("n_chars"), F.lit(True)) & F.coalesce(F.col("word_distance") <= MOST_WORD_DISTANCE, F.lit(True)))
    return told.select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "char_distance", "word_distance", (~F.col("base_failed") & fine).alias("kept"))
