"""The operators on small tables with odd rows, against plain Python."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import bpe, components, crf, divergence, mixing, onebit, parity, preferences, ranks, sharding, toxicity, urlfilter
from ledgerline.llm.tables import workers_find_us
from test_llm_kernels import TIK, WORDS, shingles

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, words string, node string, target string"
BASE = [f"w{i}" for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, chains, repeated rows, and columns with clashing names."""
    workers_find_us(spark)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t ", "en", "a"), (4, "one", "en", "b"), (5, "One", "de", "b"), (6, "a b c d e", None, "b"),
            (7, " ".join(BASE), "en", "a"), (8, " ".join(BASE), "en", "a"), (9, " ".join(BASE[:-3]), "en", "a"), (9, " ".join(BASE[:-3]), "en", "a"),
            (10, " ".join(BASE[:-12]), "fr", "c"), (11, " ".join(BASE[:-24]), "xx", "c"), (12, " ".join(BASE[60:]), "en", None), (None, "no id of mine at all here", "en", "a"),
            (13, "long " * 5000 + "tail", "en", "d"), (14, "!!! ### 12", "en", "d")]
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(60 + i)), "en", "ab"[i % 2]) for i in range(30)]
    rows += [(200 + i, " ".join(BASE[:50] + [f"v{i}y{j}" for j in range(40)]), "en", "a") for i in range(30)]
    return spark.createDataFrame([(i, t, g, s, 0, "x", "x", "x", "x", "x") for i, t, g, s in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    workers_find_us(spark)
    return spark.createDataFrame([], DOC)


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in range(len(sets)):
        groups[root(k)].append(sets[k][0])
    return sorted(((i, len(s), min((g for g in groups[root(k)] if g is not None), default=None)) for k, (i, s) in enumerate(sets)), key=repr)


def test_near_classes(docs, nothing):
    got = sorted((tuple(r) for r in parity.near_classes(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert parity.near_classes(nothing).count() == 0


def test_large_groups_and_common_passages(spark, monkeypatch):
    """Hubs that do not match, several components in a part, and shingles found to be common."""
    workers_find_us(spark)
    monkeypatch.setattr(parity, "SAMPLE_OF", 1)
    monkeypatch.setattr(parity, "COMMON_IN", 5)
    monkeypatch.setattr(parity, "SMALL", 6)
    monkeypatch.setattr(parity, "BLOCK", 16)
    rows = []
    for i in range(60):  # copies of one text with two words changed: linked to few others
        w = list(BASE[:80])
        w[(7 * i) % 70], w[(11 * i + 3) % 70] = f"c{i}", f"d{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(BASE[:40] + [f"p{i}q{j}" for j in range(12)])) for i in range(60)]  # mostly one passage
    rows += [(200 + i, " ".join(BASE[:60] + [f"r{i}"])) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in parity.near_classes(table).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == plain_components(rows)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(90, 91)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 91: 90}


def test_bpe_tables(docs, nothing):
    name = "byte_bpe_multi_50k.tiktoken"
    coded = bpe.encode(docs, name)
    want = collections.Counter((r.doc_id, tuple(TIK.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert collections.Counter((r.doc_id, tuple(r["ids"])) for r in coded.collect()) == want
    back = collections.Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode(coded, name).collect())
    assert back == collections.Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    assert bpe.round_trip(nothing, name).count() == 0 and bpe.round_trip(docs, name, with_ids=True).count() == docs.count()


def test_sharding(docs, nothing):
    rows = sharding.assign(docs, sharding.tree(8), sharding.tree(9)).collect()
    assert len(rows) == docs.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.size for r in rows if r.doc_id == 1} == {1} and {r.text_crc32 for r in rows if r.doc_id == 1} == {0}
    assert sharding.assign(nothing, sharding.tree(8), sharding.tree(9)).count() == 0


def test_weights_move_rows_only_where_they_change(spark):
    before = sharding.tree(8)
    after = [x._replace(weight=2.0) if x.shard == 5 else x for x in before]  # rack k2 of region g1 gains
    ids = spark.range(20_000).select(F.col("id").alias("k"))
    moved = ids.select(sharding.shard_of(F.col("k"), before).alias("a"), sharding.shard_of(F.col("k"), after).alias("b")).where("a <> b").collect()
    region = {x.shard: x.region for x in before}
    rack = {x.shard: x.rack for x in before}
    assert moved and all(region[r.b] == "g1" for r in moved)
    assert all(rack[r.b] == "k2" for r in moved if region[r.a] == "g1")
    share = ids.select(sharding.shard_of(F.col("k"), after).alias("s")).groupBy("s").count().collect()
    assert abs(next(r["count"] for r in share if r.s == 5) / 20_000 - 2 / 9) < 0.015


def test_numbering_is_gapless(spark):
    t = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = ranks.numbered(t, ["k"], F.pmod(F.xxhash64("id"), F.lit(7)), ["id"], "n").collect()
    assert all(sorted(r.n for r in got if r.k == k) == list(range(sum(r.k == k for r in got))) for k in range(3))


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, total, full = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left, weight = total - sum(3 * sizes[s] for s in full), sum(w[s] for s in order if s not in full)
        t = {s: 3.0 * sizes[s] if s in full else left * w[s] / weight for s in order}
        more = {s for s in order if t[s] > 3 * sizes[s]} - full
        if not more:
            return t
        full |= more


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    size = collections.Counter((r.doc_id, len(WORDS.findall(r.text or ""))) for r in docs.collect())
    assert collections.Counter((r.id, r["size"]) for r in rows) == size
    total, taken = collections.Counter(), collections.Counter()
    for r in rows:
        total[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    want = water(total)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 5 for s in total if s != "d")  # source d is one long text
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert mixing.mix(nothing).count() == 0


def test_rates_are_the_tilt_that_meets_the_targets(spark):
    import numpy as np
    from scipy_free import solve
    sizes = {"a": [10, 20, 30, 400], "b": [5, 5, 80]}
    counts = spark.createDataFrame([(s, n, 50) for s, v in sizes.items() for n in set(v)], "source string, size long, docs long")
    totals = counts.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("n"))
    targets = totals.withColumn("target", F.when(F.col("source") == "a", F.col("n") * 1.7).otherwise(F.col("n") * 0.4))
    for r in mixing.balance(counts, targets).collect():
        own = np.array(sorted(set(sizes[r.source])), float)
        assert r.t == pytest.approx(solve(own / own.mean(), own, r.target / 50), rel=2e-2)


def test_quality(docs, nothing):
    rows = divergence.judge(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        x = text[r.doc_id]
        w, lines = WORDS.findall(x), [y for y in x.split("\n") if WORDS.search(y)]
        at = collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i:i + 3])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert divergence.judge(nothing).count() == 0


def test_quality_verdicts_by_brute_force(spark):
    """Medians of the first look, the references and both distances, in plain Python; a third of the rows are copies of one junk text."""
    import math
    import random

    import regex

    workers_find_us(spark)
    rng = random.Random(2)
    vocabulary = {"en": [*divergence.COMMON["en"], "house", "river", "stone", "Window"], "xx": ["plok", "mira", "Senu", "tova"]}
    rows = [(i, " ".join(rng.choice(vocabulary[g]) + rng.choice(["", "", ",", "."]) + f"{rng.randint(0, 99) if rng.random() < 0.02 else ''}" for _ in range(rng.randint(20, 260))), g)
            for i, g in enumerate(["en"] * 60 + ["xx"] * 30)]
    junk = " ".join(str(rng.randint(10**5, 10**6)) for _ in range(400))
    rows += [(200 + i, junk, "en") for i in range(40)] + [(300 + i, " ".join(str(rng.randint(0, 9999)) for _ in range(150)), None) for i in range(5)] + [(400, None, "en"), (401, "", "zz")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def counts(t, lang):
        n = [len(regex.findall(c, t)) for c in divergence.CLASSES]
        w = [x.lower() for x in WORDS.findall(t)]
        common = [w.count(c) for c in divergence.COMMON[lang]] if lang in divergence.COMMON else None
        return n + [len(t) - sum(n)], common and common + [len(w) - sum(common)]

    def failed(t):
        w = WORDS.findall(t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i:i + 3])].append(i)
        return len(w) < 50 or 100 * len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}) > 50 * len(w)

    def distance(p, q):
        if not p or not q or not sum(p) or not sum(q):
            return None
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return math.sqrt(max(0, sum((x * math.log2(x / ((x + y) / 2)) if x else 0) + (y * math.log2(y / ((x + y) / 2)) if y else 0) for x, y in zip(p, q)) / 2))

    def both(t, lang, reference):
        c, w = counts(t, lang)
        rc, rw = reference.get(lang, (None, None))
        return distance(c, rc) if len(t) >= 300 else None, distance(w, rw) if len(WORDS.findall(t)) >= 100 else None

    given = [(i, t or "", g) for i, t, g in rows]
    first, final = {}, {}
    for lang in {g for _, _, g in given}:
        votes = [counts(t, lang) + (len(t), len(WORDS.findall(t))) for t in {t for _, t, g in given if g == lang and not failed(t)}]
        median = lambda xs: sorted(xs)[(len(xs) - 1) // 2]
        steps = lambda n, total: math.floor(n * divergence.SHARE_STEPS / total + 0.5)
        chars = [[steps(x, sum(c)) for x in c] for c, _, n, _ in votes if n >= 300]
        words = [[steps(x, sum(w)) for x in w] for _, w, _, n in votes if w and n >= 100]
        if chars or words:
            first[lang] = ([median(x) for x in zip(*chars)] if chars else [0] * 6, [median(x) for x in zip(*words)] if words else [0] * 13)
    for lang in {g for _, _, g in given}:
        near = [counts(t, lang) for _, t, g in given if g == lang and not failed(t) and all((d or 0) <= 0.25 for d in both(t, lang, first))]
        sums = ([sum(x) for x in zip(*(c for c, _ in near))], [sum(x) for x in zip(*(w for _, w in near if w))])
        final[lang] = tuple(s if any(s) else f for s, f in zip(sums, first.get(lang, (None, None))))
    want = {}
    for i, t, lang in given:
        dc, dw = both(t, lang, final)
        want[i] = not failed(t) and (dc is None or dc <= 0.15 + 50 / len(t)) and (dw is None or dw <= 0.3)
    got = {r.doc_id: r.kept for r in divergence.judge(table).collect()}
    assert got == want and not any(got[200 + i] for i in range(40)) and sum(got.values()) > 50


def test_divergence_is_the_formula(spark):
    import math
    p, q = [3.0, 0.0, 1.0], [1.0, 1.0, 2.0]
    a, b = [x / 4 for x in p], [x / 4 for x in q]
    want = math.sqrt(sum((x * math.log2(x / ((x + y) / 2)) if x else 0) + (y * math.log2(y / ((x + y) / 2)) if y else 0) for x, y in zip(a, b)) / 2)
    row = spark.createDataFrame([(p, q, [0.0, 0.0, 0.0])], "p array<double>, q array<double>, z array<double>")
    got = row.select(divergence.js_distance(F.col("p"), F.col("q")).alias("d"), divergence.js_distance(F.col("p"), F.col("z")).alias("n")).first()
    assert got.d == pytest.approx(want) and got.n is None


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Bad.org/en/12?x"), (5, "https://bad.org"), (6, "http://bad.org#f"), (7, "ftp://x.com/fr/a://b"),
            (8, "http://notbad.org/"), (9, "http://bad.net/\nq"), (9, "http://bad.net/\nq"), (10, "://"), (11, "http://x.com/de/")]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in rows], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("bad.org",), ("bad.net",), (None,)], "key string")
    rules = [urlfilter.Rule("allow", "com", "/fr/"), urlfilter.Rule("block", "com", "/"), urlfilter.Rule("block", "org", "/en/1")]
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(pages, rules, listed).collect()}
    assert got[1] == got[2] == got[3] == got[10] == ("", "", None, "allow", False)
    assert got[4] == ("a.bad.org", "/en/12", "org/en/1", "block", True)
    assert got[5] == ("bad.org", "", None, "block", True) and got[6] == got[5]
    assert got[7] == ("x.com", "/fr/a://b", "com/fr/", "allow", False) and got[11][2:4] == ("com/", "block")
    assert got[8][3] == "allow" and got[9] == ("bad.net", "/\nq", None, "block", True)
    assert urlfilter.judge(pages.limit(0), rules, listed).count() == 0
    assert all(not r.listed for r in urlfilter.judge(pages, rules, listed.limit(0)).collect())


@pytest.mark.parametrize("most_words", [1 << 17, 16])
def test_cascade_is_exact(spark, most_words):
    pages = spark.range(3000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".t")).alias("host"))
    listed = spark.range(0, 3000, 31).select(F.concat(F.lit("h"), F.col("id"), F.lit(".t")).alias("key"))
    got = urlfilter.listed_hosts(pages, "host", listed, most_words).where("listed").collect()
    assert sorted(r.host for r in got) == sorted(r.key for r in listed.collect())


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, side string"
    left = [(1, 0, "user", "hi"), (1, 1, "assistant", "A"), (1, 2, "user", "more"), (1, 3, "assistant", "B"), (1, 3, "assistant", "B"), (2, 0, "user", "same"),
            (None, 0, "user", "x"), (None, None, "assistant", None), (3, 0, None, "only")] + [(4, i, "user", str(i)) for i in range(300)]
    right = [(1, 0, "user", "hi"), (1, 1, "assistant", "A"), (1, 2, "user", "more"), (1, 3, "assistant", "C"), (2, 0, "user", "same")] + [(4, i, "user", str(i)) for i in range(299)]
    frame = lambda rows: spark.createDataFrame([(*r, "s") for r in rows], schema)
    got = {(r.pair_id, r.part, r.chunk): r for r in preferences.format_pairs(frame(left), frame(right)).collect()}
    head = lambda role: f"<|im_start|>{role}\n"
    assert got[1, "prompt", 0].text == f"{head('user')}hi<|im_end|>\n{head('assistant')}A<|im_end|>\n{head('user')}more<|im_end|>\n" and not got[1, "prompt", 0].loss_spans
    for part, word in (("chosen", "B"), ("rejected", "C")):
        r = got[1, part, 0]
        (span,) = r.loss_spans
        assert r.n_turns == 1 and r.text[span.start:span.end] == f"{word}<|im_end|>\n"
    assert got[2, "prompt", 0].n_turns == 1 and (2, "chosen", 0) not in got
    assert got[3, "chosen", 0].text == f"{head('')}only<|im_end|>\n" and (3, "rejected", 0) not in got
    # chunks hold numbered messages, whatever the turns' numbers
    assert got[None, "chosen", 0].n_turns == 2 and not any(k[0] is None and k[2] > 0 for k in got)
    assert [got[4, "prompt", c].n_turns for c in (0, 1)] == [256, 43] and got[4, "chosen", 0].n_turns == 1
    assert preferences.format_pairs(frame(left).limit(0), frame(right).limit(0)).count() == 0


def test_swapped_replies(spark):
    turns = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (1, 2, "user", "z"), (4, 0, "assistant", "c")],
                                  "conv_id long, turn long, role string, text string")
    _, rejected = preferences.swapped_replies(turns)
    assert sorted((r.pair_id, r.turn, r.text) for r in rejected.collect()) == [(0, 0, "q"), (0, 1, "b"), (1, 0, "r"), (1, 1, "a"), (1, 2, "z")]


def test_languages_of_passages(spark):
    """Runs of words in one language within a text, beside columns that are named like results."""
    workers_find_us(spark)
    import random

    rng = random.Random(1)
    words = {"aa": ["katu", "milo", "sanu", "tirok", "belu"], "zz": ["wqrth", "blxsch", "ngrft", "schtz", "prkst"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "a", "e"]) for _ in range(n))
    train = [(say(g, 60), g) for g in ("aa", "zz") for _ in range(60)]
    model = crf.fit(spark.createDataFrame(train, "text string, lang string"))
    first, second = say("aa", 40), "é12 " + say("zz", 40)
    texts = [f"{first}, 77 {second}", first, None, "", "12 !!", second]
    table = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in enumerate(texts)], "score int, text string, n int, lang_pred string, lang_spans string")
    told = crf.identify(table.withColumn("id", F.col("score")), model)
    assert told.columns == ["text", "n", "lang_spans", "id", "lang_pred", "score"]
    assert {r.id: r.lang_pred for r in told.collect()} == {0: told.where("id = 0").first().lang_pred, 1: "aa", 2: "und", 3: "und", 4: "und", 5: "zz"}
    spans = {r["score"]: [tuple(x) for x in r.lang_spans] for r in crf.label_words(table, model).collect()}
    assert [s[2] for s in spans[0]] == ["aa", "zz"] and spans[2] == spans[3] == spans[4] == [] and [s[2] for s in spans[1]] == ["aa"]
    (a, b, _, p), (c, d, _, q) = spans[0]
    assert (a, d) == (0, len(texts[0])) and abs(b - len(first)) <= 12 and b < c and p > 0.5 and q > 0.5


def test_toxicity_of_odd_tables(spark):
    """Repeated ids, contradicting labels, nulls, clashing columns, no rows, and one class only."""
    workers_find_us(spark)
    texts = [(i, ("vile scum filth " if i % 2 else "calm green field ") * 20 + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)]
    rows = texts + [texts[0]] * 50 + [(0, "another text of this id"), (None, "no id"), (100, None), (101, "")]
    docs = spark.createDataFrame([(i, t, 9.0, "x") for i, t in rows], "doc_id long, text string, score double, id string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "score"]
    got = scored.collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (100, 101)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {0.0}
    pieces = toxicity.spread_pieces(["a" * 600, "b" * 300_000 + "e" * 300, "c"], 8)
    assert [p[:1] for p in pieces] == [b"a"] * 3 + [b"b"] * 8 + [b"c"] and max(map(len, pieces)) <= toxicity.PIECE
    assert toxicity.spread_pieces(["a" * 600, "b" * 300_000, "c"], 8, 4) == [b"a" * 256, b"b" * 256, b"b" * 256, b"b" * 256]


def test_vectors(spark):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 9)], "x") for i in range(60)]
    rows += [(100, None, "x"), (101, [0.0] * 8, "x"), (102, [float("nan")] + [1.0] * 7, "x"), (103, [None] + [1.0] * 7, "x"), (104, [1.0, 2.0], "x"), (None, [1.0] * 8, "x"),
             (105, [float("inf")] + [1.0] * 7, "x"), (200, [1.0] * 8, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    fine = {i: v for i, v, _ in rows if i is not None and (i < 60 or i == 200) and any(v)}
    got = collections.defaultdict(list)
    for r in onebit.search(table, every=20, k=10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in (i for i in fine if i % 20 == 0):
        order = sorted((sum((a - b) ** 2 for a, b in zip(fine[i], fine[q])) ** 0.5, i) for i in fine if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, d) for n, (d, i) in enumerate(order)]
    assert set(got) == {i for i in fine if i % 20 == 0}
    assert onebit.search(table.limit(0), every=20).count() == 0


def test_models_on_tables(docs, nothing, spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(100, 130)] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.fit(nothing, labels).weights is None
    named = crf.identify(docs, crf.fit(docs))
    assert named.count() == docs.count() and {r.lang_pred for r in named.where("doc_id in (1, 2, 3, 14)").collect()} == {"und"}
    assert crf.identify(nothing, crf.fit(nothing)).count() == 0


def test_copies_leave_the_language_its_texts(spark, monkeypatch):
    # 20,000 copies of one text and 40 others: a bound from the rows leaves next to none of the others
    copies = spark.range(20000).select(F.lit("aa bb cc").alias("text"), F.lit("x").alias("lang"))
    others = spark.range(80).select(F.concat(F.lit("dd ee "), F.col("id")).alias("text"), F.when(F.col("id") < 40, "x").otherwise("y").alias("lang"))
    seen = []
    monkeypatch.setattr(crf, "train", lambda texts, labels: seen.extend(zip(labels, texts)))
    crf.fit(copies.unionByName(others), per_language=20)
    assert len(seen) == len(set(seen)) and collections.Counter(label for label, _ in seen) == {"x": 20, "y": 20}


def test_every_label_is_learned(spark):
    word = F.format_string("q%s%s", F.expr("char(97 + n % 26)"), F.expr("char(97 + n div 26)"))
    rows = spark.range(70).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(1), 2 + (F.col("id") < 10).cast("int"))).alias("i"))
    rows = rows.select(F.format_string("l%02d", "n").alias("lang"), F.concat_ws(" ", F.array_repeat(word, 30), F.repeat(F.lit("z"), F.col("i"))).alias("text"))
    model = crf.fit(rows)
    assert len(model.languages) == 70
    assert all(r.lang == r.lang_pred for r in crf.identify(rows, model).collect())


def test_junk_does_not_set_the_reference(spark):
    clean = [(i, " ".join(f"w{chr(97 + (i * 7 + j) % 26)}{chr(97 + j % 26)}ord{chr(97 + j // 26)}" for j in range(150)), "xx") for i in range(30)]
    junk = [(100 + i, " ".join(str(10**6 + 7919 * (i * 500 + j)) for j in range(300)), "xx") for i in range(8)]
    junk += [(200, " ".join(str(10**7 + 7919 * j) for j in range(3000)), "xx")]
    rows = divergence.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()
    assert not any(r.base_failed for r in rows)
    assert {r.doc_id: r.kept for r in rows} == {i: i < 100 for i, _, _ in clean + junk}


def test_long_hosts_keep_their_parents(spark):
    deep, far = "a." * 200, ".".join(["b" * 60] * 5)
    hosts = [f"{deep}bad.org", f"{deep}notbad.org", "c" * 300 + ".bad.org", "d" * 300, f"x.{far}", f"{deep}{far}"]
    pages = spark.createDataFrame([(h,) for h in hosts], "host string")
    listed = spark.createDataFrame([("bad.org",), (far,)], "key string")
    got = {r.host: r.listed for r in urlfilter.listed_hosts(pages, "host", listed).collect()}
    assert [got[h] for h in hosts] == [True, False, True, False, True, True]


def test_a_repeated_query_keeps_its_neighbours(spark):
    rows = [(i, [float((i * j) % 7 - 3) + i / 100 for j in range(1, 9)]) for i in range(1, 31)]
    table = spark.createDataFrame(rows + [rows[19]], "vec_id long, embedding array<double>")
    got = onebit.search(table, every=20, k=10).collect()
    assert len(got) == len({r.vec_id for r in got}) == 10 and {r.query_id for r in got} == {20}


@pytest.mark.parametrize("kind", ["int", "string"])
def test_vectors_in_blocks_with_other_ids(spark, monkeypatch, kind):
    """Several blocks of rows and queries, limits from a sample, ids of other types; against brute force."""
    import numpy as np

    for name, value in (("BLOCK_ROWS", 300), ("BLOCK_QUERIES", 20), ("LIMIT_SAMPLE", 400)):
        monkeypatch.setattr(onebit, name, value)
    x = np.random.default_rng(2).normal(size=(1500, 24))
    rows = [(str(i) if kind == "string" else i, [float(c) for c in v], "x") for i, v in enumerate(x)]
    rows += [("n/a", [0.5] * 24, "x")] if kind == "string" else []
    table = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, row string").repartition(4)
    got = collections.defaultdict(list)
    for r in onebit.search(table, every=30, k=10).collect():
        got[int(r.query_id)].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 30))
    ids, vectors, hits = [r[0] for r in rows], np.array([r[1] for r in rows]), 0
    for q, found in got.items():
        exact = onebit.distances(vectors, x[q])
        want = [i for _, i in sorted((d, i) for d, i in zip(exact.tolist(), ids) if i != (str(q) if kind == "string" else q))[:10]]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11)) and [d for _, _, d in sorted(found)] == sorted(d for _, _, d in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.99 * 10 * len(got)


def test_preferences_of_many_messages_and_missing_sides(spark):
    """One turn of many messages is cut into chunks of bounded size, null turns too; a side that is missing leaves its pair incomplete."""
    schema = "pair_id long, turn long, role string, text string"
    many = spark.range(3000).selectExpr("9L AS pair_id", "IF(id < 2000, 5L, NULL) AS turn", "'user' AS role", "CAST(id AS string) AS text")
    few = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "user", "same")], schema)
    other = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "b"), (3, 0, "user", "same"), (5, 0, "user", "r")], schema)
    rows = preferences.format_pairs(many.unionByName(few), other).collect()
    big = sorted((r.chunk, r.n_turns, r.text) for r in rows if r.pair_id == 9)
    assert [c for c, _, _ in big] == list(range(12)) and [n for _, n, _ in big] == [256] * 11 + [3000 - 11 * 256]
    told = [t for _, _, x in big for t in re.findall(r"user\n(\d+)<", x)]
    assert told == sorted(map(str, range(2000))) + sorted(map(str, range(2000, 3000)))
    assert {(r.pair_id, r.part, r.complete) for r in rows} == {(9, "chosen", False), (1, "prompt", True), (1, "chosen", True), (1, "rejected", True), (2, "chosen", False),
                                                               (3, "prompt", False), (5, "rejected", False)}
