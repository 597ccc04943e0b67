"""URL verdicts by prefix rules and an exact Bloom filter cascade.

The first level holds the listed keys.  The second holds the keys of the corpus
that pass the first without being listed, the third the listed keys that pass the
second, and so on until nothing passes wrongly.  Over the complete key universe of
the corpus the cascade's answer is then exact, and pages are judged without a join.

Keys are a host and all its parent domains, so a listed domain covers its
subdomains.  Levels are sized from counts; a list whose filters exceed MOST_WORDS
is cut by hash into slices that are probed one after another, each within that bound.
Null urls and urls without "://" have empty host and path and no key.  Repeated
rows are judged alike; an empty list or corpus gives an empty cascade (nothing listed).
"""

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.plans.stage import write_stage

#: 64-bit words that one slice's first level may take: 1 MB.  Slices are counted with MOST_BITS bits a key.
MOST_WORDS, MOST_BITS = 1 << 17, 32
#: Fixed value: characters of the longest domain name.
LONGEST_NAME = 253
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Level(NamedTuple):
    """One filter; words is the text of its 64-bit words, parsed once when the plan is folded."""

    words: str
    bits: int
    hashes: int
    seed: int


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, longest: int = LONGEST_NAME) -> Column:
    """The host and its parent domains; of a longer host, itself and the parents of at most longest characters."""
    parents = lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tail = F.substring(host, -(longest + 1), longest + 1)
    dot = F.instr(tail, ".")
    short = F.when(dot > 0, parents(F.split(tail.substr(dot + 1, F.lit(longest + 1)), r"\."))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).when(F.length(host) > longest, F.concat(F.array(host), short)).otherwise(
        parents(F.split(host, r"\.")))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as (text, verdict), or null."""
    chosen = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        value = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        chosen = F.when(fits(r, host, path), value) if chosen is None else chosen.when(fits(r, host, path), value)
    return chosen if chosen is not None else F.lit(None).cast("struct<text:string,verdict:string>")


def _positions(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level.seed + i)), F.lit(level.bits)) for i in range(level.hashes)]


def _passes(key: Column, level: Level) -> Column:
    """Whether all bits of a key are set; the words stand in the plan as one folded array."""
    words = F.array(F.split(F.lit(level.words), ",").cast("array<long>"))

    def test(w):
        out = F.lit(True)
        for at in _positions(key, level):
            out = out & (F.getbit(F.get(w, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out

    return F.exists(words, test)


def _fill(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of n keys with the given rate of false positives; its size follows from n alone."""
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    level = Level("", bits, hashes, seed)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level))).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    set_words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("v"))
    words = [0] * (bits // 64)
    for r in set_words.collect():  # at most bits / 64 rows
        words[r["w"]] = r["v"]
    return level._replace(words=",".join(map(str, words)))


def member(key: Column, levels: Sequence[Level]) -> Column:
    """Whether the cascade lists a key: the first level that a key fails decides, the last one passed otherwise."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        answer = F.when(_passes(key, levels[i]), answer).otherwise(F.lit(i % 2 == 1))
    return answer


def cascade(keys: DataFrame, seed: int) -> list[Level]:
    """Levels for keys (key, listed), which must hold every key that will be asked for."""
    levels: list[Level] = []
    side = keys.groupBy("listed").count().collect()
    n = {r["listed"]: r["count"] for r in side}
    listed, others = n.get(True, 0), n.get(False, 0)
    if not listed:
        return levels
    rate = max(2.0**-20, min(0.5, listed / (math.sqrt(2) * max(others, 1))))
    todo, count = keys.where("listed"), listed
    while count:
        levels.append(_fill(todo.select("key"), count, rate if len(levels) == 0 else 0.5, seed + 64 * len(levels)))
        wrong = keys.where(F.col("listed") == (len(levels) % 2 == 0)).where(_passes(F.col("key"), levels[-1]))
        # a key is wrong at this level only if it reached it
        for k, earlier in enumerate(levels[:-1]):
            wrong = wrong.where(_passes(F.col("key"), earlier))
        todo = write_stage(wrong, f"passed-{seed}-{len(levels)}")
        count = todo.count()
    return levels


def _hit(host: Column, levels: Sequence[Level], mine, longest: int) -> Column:
    return F.exists(keys_of(host, longest), lambda k: mine(k) & member(k, levels))


def listed_hosts(pages: DataFrame, host: str, listed: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """Adds listed: whether the host column's value or a parent domain of it is in listed (key)."""
    longest = max(LONGEST_NAME, listed.agg(F.max(F.length("key"))).first()[0] or 0)
    universe = pages.select(F.explode(keys_of(F.col(host), longest)).alias("key")).distinct().withColumn("listed", F.lit(False))
    ours = listed.select("key").where("key is not null").withColumn("listed", F.lit(True))
    keys = write_stage(universe.unionByName(ours).groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")
    slices = max(1, math.ceil(keys.where("listed").count() * MOST_BITS / 64 / most_words))
    out = pages.withColumn("listed", F.lit(False))
    for s in range(slices):
        def mine(key, s=s):
            return F.lit(True) if slices == 1 else F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(slices)) == s

        levels = cascade(keys.where(mine(F.col("key"))), 1000 * s)
        out = out.withColumn("listed", F.col("listed") | _hit(F.col(host), levels, mine, longest))
        if slices > 1:
            out = write_stage(out, f"url-slice-{s}")
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): the longest rule's verdict, else block if the host is listed, else allow."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = listed_hosts(split, "host", listed, most_words)
    rule = rule_of(rules, F.col("host"), F.col("path"))
    return known.select("page_id", "host", "path", rule["text"].alias("rule"),
                        F.coalesce(rule["verdict"], F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")
