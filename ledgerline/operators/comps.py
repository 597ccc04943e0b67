"""Comparable companies: sets of filers, one chosen column each."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.dims import template as T
from ledgerline.functions.quantiles import exact_percentiles

HITS = 8
BASES = ("FY", "LTM")
#: Longest query whose title hits are ranked in the index itself; longer ones are looked up by their rarest part of this length.
GRAM = 3


def clean_tickers(typed: DataFrame) -> DataFrame:
    """What readers typed (set_id, ord, text) as members: trimmed, upper-cased, blanks and repetitions dropped."""
    rows = typed.withColumn("ticker", F.upper(F.trim("text"))).where("ticker <> ''")
    return rows.groupBy("set_id", "ticker").agg(F.min("ord").alias("ord"))


def follow_successions(alive: DataFrame, successions: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(cik, used_cik, steps): the nearest filer with annual periods behind each filer that has none.

    ``alive`` is (cik, has_periods), ``successions`` (cik, pred_cik), of several
    predecessors the smallest.  Only filers without periods step back, so a filer
    with periods of its own is never followed.  Each round doubles the steps taken;
    filers whose line ends without periods, or runs in a ring, are not returned.
    """
    live = alive.where("has_periods").select("cik")
    at = stage(successions.groupBy("cik").agg(F.min("pred_cik").alias("used_cik")).join(live, "cik", "left_anti").withColumn("steps", F.lit(1).cast("long")), "successions-0")
    reach, rounds = at.count(), 0
    while (1 << rounds) <= reach:  # no line without a ring has more steps than there are successions
        rounds += 1
        onward = at.select(F.col("cik").alias("used_cik"), F.col("used_cik").alias("next"), F.col("steps").alias("more"))
        at = stage(at.join(onward, "used_cik", "left").select(
            "cik", F.coalesce("next", "used_cik").alias("used_cik"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")), f"successions-{rounds}")
        if not at.where("moved").limit(1).count():
            break
    return at.select("cik", "used_cik", "steps").join(live.select(F.col("cik").alias("used_cik")), "used_cik", "left_semi")


def build_sets(typed: DataFrame, tickers: DataFrame, followed: DataFrame, alive: DataFrame) -> DataFrame:
    """Members of typed sets: unknown tickers marked, moved ones led back to the filer that has annual periods.

    ``tickers`` is the list with its fixes applied; a ticker listed twice counts for
    its smallest filer.  ``followed`` comes from ``follow_successions``.
    """
    known = tickers.groupBy("ticker").agg(F.min(F.struct("cik", "title")).alias("t")).select("ticker", F.col("t.cik").alias("cik"), F.col("t.title").alias("title"))
    rows = clean_tickers(typed).join(known, "ticker", "left").join(followed, "cik", "left")
    used = F.coalesce("used_cik", "cik")
    live = alive.where("has_periods").select(F.col("cik").alias("used_cik"), F.lit(True).alias("live"))
    return rows.select("set_id", "ord", "ticker", "title", "cik", used.alias("used_cik"), F.coalesce("steps", F.lit(0)).alias("steps")).join(live, "used_cik", "left").select(
        "set_id", "ord", "ticker", "title", "cik", "used_cik", "steps", F.col("cik").isNotNull().alias("known"), F.coalesce("live", F.lit(False)).alias("has_periods"))


def comps_set(sheet: DataFrame, members: DataFrame, bases: tuple = BASES) -> DataFrame:
    """The newest column of each basis for each member (set_id, cik, ticker)."""
    cols = sheet.where(F.col("basis").isin(*bases))
    last = cols.groupBy("cik", "basis").agg(F.max("end").alias("end"))
    return cols.join(last, ["cik", "basis", "end"]).join(members, "cik")


def comps_rows(chosen: DataFrame) -> DataFrame:
    """The 23 metrics of every member, unpivoted."""
    keys = [k for _, k, _ in T.COMPS_ROWS]
    ids = ["set_id", "basis", "ticker", "cik", "end"]
    dim = T.comps_rows(chosen.sparkSession)
    return chosen.select(*ids, *keys).unpivot(ids, keys, "k", "value").join(F.broadcast(dim), "k")


def comps_median(rows: DataFrame) -> DataFrame:
    """Median of the ratio rows over finite values; an even count averages the middle two."""
    return exact_percentiles(rows.where("has_median"), ["set_id", "basis", "k"], "value", {"median": 0.5})


def period_spread(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("set_id", "basis").agg(
        F.count("*").alias("members"), F.date_diff(F.max("end"), F.min("end")).alias("spread_days"))


def gap_notes(chosen: DataFrame, long: DataFrame) -> DataFrame:
    """Metrics a member lacks because of its interim reports, as one list per member and cause."""
    dim = T.comps_rows(long.sparkSession).select("k", F.col("label").alias("metric"), "row_ord")
    cells = long.where((F.col("basis") == "LTM") & F.col("status").isin("no-interim", "restated-basis") & F.col("value").isNull())
    hit = cells.select("cik", "end", "k", "status").join(F.broadcast(dim), "k").join(
        chosen.where("basis = 'LTM'").select("set_id", "ticker", "cik", "end"), ["cik", "end"])
    # at most one entry per metric of the fixed list
    ordered = F.array_sort(F.collect_list(F.struct("row_ord", "metric")))
    return hit.groupBy("set_id", "ticker", "status").agg(
        F.array_join(F.transform(ordered, lambda m: m["metric"]), ", ").alias("metrics"))


def dominant_currency(chosen: DataFrame) -> DataFrame:
    """Most common currency of a set, USD on a tie, and whether the set mixes currencies."""
    n = chosen.where("ccy IS NOT NULL").groupBy("set_id", "basis", "ccy").agg(F.count("*").alias("n"))
    rank = F.struct("n", (F.col("ccy") == "USD").alias("usd"), "ccy")
    return n.groupBy("set_id", "basis").agg(F.max(rank)["ccy"].alias("dominant"), (F.count("*") > 1).alias("mixed"))


def currency_marks(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Amounts filed in a currency other than the set's most common one."""
    dom = dominant_currency(chosen)
    own = chosen.select("set_id", "basis", "cik", "ticker", "ccy")
    odd = own.join(dom, ["set_id", "basis"]).where("mixed AND ccy IS NOT NULL AND ccy <> dominant")
    return rows.where(F.col("k").isin(list(T.CURRENCY_KEYS)) & F.col("value").isNotNull()).join(
        odd, ["set_id", "basis", "cik", "ticker"]).select("set_id", "basis", "ticker", "cik", "k", "value", "ccy", "dominant")


def thin_marks(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    thin = chosen.where("equityThin").select("set_id", "basis", "cik", "ticker", F.abs(F.col("equity") / F.col("totalAssets")).alias("share"))
    return rows.where(F.col("k").isin(list(T.EQUITY_KEYS)) & F.col("value").isNotNull()).join(
        thin, ["set_id", "basis", "cik", "ticker"]).select("set_id", "basis", "ticker", "cik", "k", "value", "share")


def carried(chosen: DataFrame) -> DataFrame:
    return chosen.where("basis = 'LTM' AND NOT stitched").select("set_id", "ticker", "cik", "end", "fy")


class SearchIndex(NamedTuple):
    """Tables of a company list: hits of short keys already ranked, parts of titles, and how often each part occurs."""

    ranked: DataFrame
    grams: DataFrame
    counts: DataFrame
    k: int


def _parts(c: Column, n: int) -> Column:
    """The distinct parts of n characters of a text."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def _best(hits: DataFrame, by: list, k: int) -> DataFrame:
    return hits.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("cls", "ord"))).where(F.col("r") <= k).drop("r")


def search_index(tickers: DataFrame, stage: Callable[[DataFrame, str], DataFrame], k: int = HITS) -> SearchIndex:
    """Index of a list ordered by ``ord`` (ord, cik, ticker, title), for ``search``.

    A query that is a whole ticker or begins one, or is at most GRAM characters
    long, has its best ``k`` hits stored under it: the rest could never be shown.
    Longer queries need a title to contain them, so it contains their rarest part.
    """
    rows = tickers.select("ord", "cik", "ticker", "title", F.upper("title").alias("up"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("ticker"), F.lit(1))), lambda i: F.substring("ticker", F.lit(1), i))
    by_ticker = rows.where("ticker <> ''").select("ord", "cik", "ticker", "title", F.explode(prefixes).alias("key")).withColumn("cls", F.when(F.col("key") == F.col("ticker"), 0).otherwise(1))
    short = F.concat(*[_parts(F.col("up"), n) for n in range(1, GRAM + 1)])
    by_title = rows.select("ord", "cik", "ticker", "title", "up", F.explode(short).alias("key")).withColumn("cls", F.when(F.col("up").startswith(F.col("key")), 1).otherwise(2)).drop("up")
    ranked = stage(_best(by_ticker, ["key"], k).unionByName(_best(by_title, ["key"], k)), "search-ranked")
    grams = stage(rows.select("ord", "cik", "ticker", "title", "up", F.explode(_parts(F.col("up"), GRAM)).alias("gram")), "search-grams")
    return SearchIndex(ranked, grams, stage(grams.groupBy("gram").agg(F.count("*").alias("n")), "search-counts"), k)


def search(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """The best hits of typed queries (query_id, query), as many as the index keeps.

    Exact tickers first, then tickers or titles that begin with the query, then
    titles that contain it, each in list order.  Equal queries are looked up once;
    everything is an equi-join, so the plan is the same for one query and for many.
    """
    asked = queries.withColumn("s", F.upper(F.trim("query"))).where("s <> ''")
    texts = asked.select("s").distinct()
    stored = index.ranked.join(texts.withColumnRenamed("s", "key"), "key").select(F.col("key").alias("s"), "cls", "ord", "cik", "ticker", "title")
    parts = texts.where(F.length("s") > GRAM).select("s", F.explode(_parts(F.col("s"), GRAM)).alias("gram"))
    # a part that no title holds occurs 0 times, and settles that there is no hit
    rarest = parts.join(index.counts, "gram", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).select("s", F.col("m.gram").alias("gram"))
    inside = index.grams.join(rarest, "gram").where(F.contains("up", "s")).select(
        "s", F.when(F.col("up").startswith(F.col("s")), 1).otherwise(2).alias("cls"), "ord", "cik", "ticker", "title")
    hits = stored.unionByName(_best(inside, ["s"], index.k)).groupBy("s", "ord", "cik", "ticker", "title").agg(F.min("cls").alias("cls"))
    place = F.row_number().over(Window.partitionBy("s").orderBy("cls", "ord", "ticker"))
    best = hits.withColumn("rank", place).where(F.col("rank") <= index.k)
    return asked.join(best, "s").select("query_id", "query", "rank", "cik", "ticker", "title", "cls")
