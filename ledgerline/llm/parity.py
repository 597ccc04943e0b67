"""N-gram Jaccard join by parity sketches.

Each distinct 5-word shingle of a text flips one bit of a sketch; bits at which
two sketches differ are at most the shingles that only one of the texts has.  Two
sets with Jaccard similarity of at least t and sizes p, q differ in at most
(p + q)(1 - t)/(1 + t) shingles.  So if a very wide sketch is cut into more parts
than that, some part is the same in both.  Parts are joined on equality within a
size band, and pairs that meet are checked first by the Hamming distance of dense
sketches and then exactly.

Bands.  Level l has 2**l parts and serves pairs whose larger set allows at most
_most(l) differing shingles.  A set speaks at its own level and at that of the
largest set that could match it, so every pair meets at the larger set's level.

Empty parts prove nothing.  A set is sure of a way of cutting if its parts that
hold shingles outnumber the differences allowed; a pair with one sure set shares
such a part.  A set that is not sure speaks again in the next way, until it is:

1. its usual shingles at the level, leaving out those common in the corpus;
2. each usual shingle as a part of its own;
3. all shingles at the level;
4. each shingle as a part of its own, which is always sure.

Common shingles (boilerplate, large groups) are estimated on a sample of documents
and change the work, never the result.  In ways 3 and 4 two sets can only match
without sharing a usual shingle if one of them is light: if its usual shingles are
at most half the differences allowed.  Heavy sets are not compared there with each
other, so texts around one common passage do not meet in pairs, and light sets with
the same common part are near copies of each other anyway.

A large group is not expanded into pairs.  Parts first link to one member, texts
of one component need no further look, and only parts that still hold several
components are compared in full, in blocks, by their dense sketches.

Null and empty texts have no shingles and link with nothing.  Equal sets are one
node.  A null id counts in no component's least id.  Repeated rows return repeated.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.llm.components import components, of_ids
from ledgerline.llm.textbuf import lowered, mix, pieces_of_batch, ragged, span_hashes, text_buffer, word_spans
from ledgerline.plans.stage import passing_stages, write_stage

WORDS, NUM, DEN = 5, 75, 100
#: The sample that finds common shingles: one document in SAMPLE_OF, fewer beyond SAMPLE_ROWS; COMMON_IN sampled documents make a shingle common.
SAMPLE_OF, SAMPLE_ROWS, COMMON_IN, MOST_COMMON = 16, 500_000, 4, 1 << 17
#: Kinds of parts: usual shingles; all shingles of a light or of a heavy set.
USUAL, LIGHT, HEAVY = 0, 1, 2
#: Members of a part in one block of comparisons, and of parts whose pairs are joined.
BLOCK, SMALL = 2048, 48
_U = np.uint64
_TURN = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, n + 1 offsets)."""
    n = len(offsets) - 1
    data = lowered(data)
    start, end, first = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    h = span_hashes(data, start, end)
    count = np.diff(first)
    room = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(n), room)
    at = np.repeat(first[:-1] - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
    left = np.minimum(first[1:][text] - at, words)
    total = np.zeros(len(at), _U)
    for j in range(words):
        here = left > j
        total[here] += mix(h[at[here] + j]) * _U(_TURN[j % len(_TURN)] + 2 * j)
    total = mix(total ^ left.astype(_U))
    order = np.argsort(total)
    order = order[np.argsort(text[order].astype(np.uint16) if n < 65536 else text[order], kind="stable")]
    total, text = total[order], text[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    total, text = total[new], text[new]
    return total, np.append(0, np.cumsum(np.bincount(text, minlength=n)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.append(_U(0), np.cumsum(values))
    return run[offsets[1:]] - run[offsets[:-1]]


def nodes_of(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, as signed integers; empty sets are 0."""
    name = mix(_sums(h, offsets) ^ mix(_sums(mix(h), offsets) + np.diff(offsets).astype(_U)))
    return np.where(np.diff(offsets) == 0, _U(0), name).view(np.int64)


def dense_sketches(h: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One bit flipped by each shingle, at least two bits a shingle, a power of two of them (64 or more)."""
    size = np.diff(offsets)
    bits = 1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)
    base = np.append(0, np.cumsum(bits))
    text = np.repeat(np.arange(len(size)), size)
    place = base[text] + (h & (bits[text] - 1).astype(_U)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8:b // 8] for a, b in zip(base[:-1], base[1:])]


def folded(sketch: bytes, width: int) -> np.ndarray:
    """A sketch at a lesser width: halves laid over each other, as if its shingles had been hashed to fewer bits."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > width:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def hamming(a: bytes, b: bytes) -> int:
    """The distance of two sketches at the lesser of their widths."""
    width = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum())


def _most(level: int) -> int:
    """Differences that a level of 2**level parts serves: a few less than the parts that chance leaves filled."""
    return max(0, int(0.86 * 2**level - 0.4 * 2**(level / 2)))


_MOST = np.array([_most(i) for i in range(40)])


def _allowed(total, num: int, den: int):
    """Shingles in which two sets of these sizes together may differ."""
    return total * (den - num) // (den + num)


def part_keys(h: np.ndarray, offsets: np.ndarray, common: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, kind) of every part that a text speaks with; common is sorted."""
    size = np.diff(offsets)
    own = np.searchsorted(_MOST, _allowed(2 * size, num, den))
    largest = size * den // num
    top = np.searchsorted(_MOST, _allowed(2 * largest, num, den))
    texts = np.flatnonzero(size)
    spread = top[texts] - own[texts] + 1
    text = np.repeat(texts, spread)
    base = own[text] + (np.arange(len(text)) - np.repeat(np.cumsum(spread) - spread, spread))
    # the largest partner at a base level, and the differences that this allows
    reach = ((den + num) * (_MOST[base] + 1) - 1) // (2 * (den - num))
    most = _allowed(size[text] + np.minimum(largest[text], np.maximum(reach, size[text])), num, den)
    usual = np.ones(len(h), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        usual = common[at] != h
    value = mix(h ^ _U(0x5851F42D4C957F2D))
    texts_out, keys_out, kinds_out = [], [], []
    cold = np.bincount(np.repeat(np.arange(len(size)), size)[usual], minlength=len(size)) if len(common) else size
    light = 2 * cold <= _allowed(size + largest, num, den)
    for full, fine in ((False, False), (False, True), (True, False), (True, True)):
        if not len(text):
            break
        if full and not len(common):
            full, fine = False, True  # nothing was left out: only the finest parts are left to say
        item = np.repeat(np.arange(len(text)), size[text])
        token = ragged(np.arange(len(h)), offsets[text], size[text])
        if not full and len(common):
            item, token = item[usual[token]], token[usual[token]]
        depth = np.full(len(item), 64, _U) if fine else base[item].astype(_U)
        part = h[token] if fine else np.where(depth == 0, _U(0), h[token] >> (_U(64) - np.maximum(depth, _U(1))))
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (part[1:] != part[:-1])
        begin = np.flatnonzero(new)
        filled = np.bincount(item[begin], minlength=len(text))
        if len(begin):
            parity = np.bitwise_xor.reduceat(value[token], begin)
            keys_out.append(mix(parity ^ mix(mix(part[begin]) + depth[begin] * _U(2) + _U(full))))
            texts_out.append(text[item[begin]])
            kinds_out.append(np.where(light[texts_out[-1]], LIGHT, HEAVY) if full else np.full(len(begin), USUAL))
        unsure = filled <= most
        text, base, most = text[unsure], base[unsure], most[unsure]
    none = np.zeros(0, np.int64)
    if not keys_out:
        return none, none, none
    return np.concatenate(texts_out), np.concatenate(keys_out).view(np.int64), np.concatenate(kinds_out)


def document_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, node, sketch) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of_batch(batch, "text"):
                h, offsets = shingle_sets(*text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(nodes_of(h, offsets), pa.int64()),
                     pa.array(dense_sketches(h, offsets), pa.binary())], names=["id", "n_shingles", "node", "sketch"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, n_shingles long, node long, sketch binary")


def common_shingles(docs: DataFrame, rows: int, id_column: str, text_column: str) -> np.ndarray:
    """Sorted hashes of shingles that many documents share, at most MOST_COMMON of them, from a sample of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of_batch(batch, "text"):
                h, _ = shingle_sets(*text_buffer(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), pa.int64())], names=["h"])

    one_in = max(SAMPLE_OF, rows // SAMPLE_ROWS)
    sample = docs.where(F.pmod(F.xxhash64(id_column), F.lit(one_in)) == 0).select(F.col(text_column).alias("text"))
    counts = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON_IN)
    top = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(_U))


def parts(docs: DataFrame, common: np.ndarray, text_column: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """(key, kind, node) of every part of every distinct set; a set seen again in the same task is not repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in pieces_of_batch(batch, "text"):
                h, offsets = shingle_sets(*text_buffer(part.column(0)))
                nodes = nodes_of(h, offsets)
                fresh = np.zeros(len(nodes), bool)
                fresh[np.unique(nodes, return_index=True)[1]] = True
                fresh &= np.array([x not in seen for x in nodes.tolist()], bool)
                if len(seen) < 100_000:
                    seen.update(nodes[fresh].tolist())
                size = np.diff(offsets)[fresh]
                h, offsets, nodes = ragged(h, offsets[:-1][fresh], size), np.append(0, np.cumsum(size)), nodes[fresh]
                text, key, kind = part_keys(h, offsets, common, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int8()), pa.array(nodes[text], pa.int64())], names=["key", "kind", "node"])

    return docs.select(F.col(text_column).alias("text")).mapInArrow(run, "key long, kind byte, node long")


def near_pairs(pairs: DataFrame, nodes: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Pairs (a, b) whose sizes and dense sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (np.asarray(batch.column(2)) + np.asarray(batch.column(3))) * (den - num) // (den + num)
            keep = np.array([hamming(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column(4), batch.column(5), most)], bool)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))
    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity exactly; texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of_batch(batch, "ta"):
                h, at = shingle_sets(*text_buffer(part.column(2)))
                g, to = shingle_sets(*text_buffer(part.column(3)))
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = h[at[i]:at[i + 1]], g[to[i]:to[i + 1]]
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep[i] = shared > 0 and den * shared >= num * (len(both) - shared)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
              .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


class Join:
    """One run over one table of documents."""

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", num: int = NUM, den: int = DEN):
        self.docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        self.num, self.den = num, den
        self.sets = write_stage(document_sets(self.docs, "id"), "sets")
        self.nodes = write_stage(self.sets.where("n_shingles > 0").groupBy("node").agg(
            F.min("id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")), "set-nodes")

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of some nodes, by the text of their least id; the node is computed again from the text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces_of_batch(batch, "text"):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes_of(*shingle_sets(*text_buffer(part.column(0)))), pa.int64()), part.column(0)], names=["node", "text"])

        wanted = write_stage(nodes.join(self.nodes, "node").select("node", "id"), "wanted")
        rows = of_ids(self.docs, "id", wanted.select("id").distinct(), "leftsemi").select("text").mapInArrow(run, "node long, text string")
        return rows.join(wanted.select("node"), "node", "leftsemi").groupBy("node").agg(F.min("text").alias("text"))

    def check(self, pairs: DataFrame, name: str) -> DataFrame:
        close = write_stage(near_pairs(pairs, self.nodes, self.num, self.den), f"{name}-close")
        wanted = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return write_stage(verified(close, write_stage(self.texts_of(wanted), f"{name}-texts"), self.num, self.den), f"{name}-links")

    def shared(self) -> DataFrame:
        """(key, kind, node, hub, hub_kind): members of parts that several sets share; the hub is a light one if there is any, and the least."""
        common = common_shingles(self.docs, self.sets.count(), "id", "text")
        run = Window.partitionBy("key").orderBy("kind", "node").rowsBetween(Window.unboundedPreceding, 0)
        told = parts(self.docs, common, "text", self.num, self.den).withColumn("h", F.first(F.struct("kind", "node")).over(run))
        told = told.where((F.col("node") != F.col("h.node")) & ((F.col("kind") != HEAVY) | (F.col("h.kind") != HEAVY)))
        return write_stage(told.select("key", "kind", "node", F.col("h.node").alias("hub"), F.col("h.kind").alias("hub_kind")).distinct(), "shared-parts")

    def open_parts(self, shared: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """(key, kind, node, comp) of parts that still hold more than one component."""
        comp = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        told = (shared.join(comp("node"), "node", "left").join(comp("hub"), "hub", "left")
                .withColumn("node_comp", F.coalesce("node_comp", "node")).withColumn("hub_comp", F.coalesce("hub_comp", "hub")))
        keys = told.where("node_comp <> hub_comp").select("key").distinct()
        both = F.array(F.struct("kind", "node", F.col("node_comp").alias("comp")),
                       F.struct(F.col("hub_kind").alias("kind"), F.col("hub").alias("node"), F.col("hub_comp").alias("comp")))
        members = told.select("key", F.explode(both).alias("m"))
        return write_stage(members.join(keys, "key", "leftsemi").select("key", "m.kind", "m.node", "m.comp").distinct(), name)

    def merged(self, labels: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
        """Labels (node, comp) after more links: only the components that the links join are looked at again."""
        if labels is None:
            return components(links, name)
        old = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        met = (links.join(old("a"), "a", "left").join(old("b"), "b", "left")
               .select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b"))
        up = components(met, name)
        fresh = up.select("node", F.col("node").alias("comp")).join(labels.select("node"), "node", "leftanti")
        to = up.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        return write_stage(labels.unionByName(fresh).join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), f"{name}-labels")

    def labels(self) -> DataFrame:
        """(node, comp) of all sets that link with another; see the module's text."""
        shared = self.shared()
        stars = self.check(shared.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
        labels = self.merged(None, stars, "star")
        # parts of several components: other hubs, which differ from part to part
        left = self.open_parts(shared, labels, "open-1")
        if left.limit(1).count():
            turn = F.xxhash64("node", F.pmod("key", F.lit(16)))
            run = Window.partitionBy("key").orderBy(F.col("kind") == HEAVY, turn, "node").rowsBetween(Window.unboundedPreceding, 0)
            first = F.first(F.struct("kind", "node", "comp")).over(run)
            pairs = (left.withColumn("h", first).where((F.col("h.comp") != F.col("comp")) & ((F.col("kind") != HEAVY) | (F.col("h.kind") != HEAVY)))
                     .select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct())
            labels = self.merged(labels, self.check(pairs, "turned"), "turned")
            left = self.open_parts(shared, labels, "open-2")
        # what is still apart is compared in full
        if left.limit(1).count():
            labels = self.merged(labels, self.check(self.all_pairs(left), "rest"), "rest")
        return labels

    def all_pairs(self, left: DataFrame) -> DataFrame:
        """Pairs of different components in each part that their sizes and sketches allow.

        A part's largest component is not compared with itself: all other members
        meet all members.  In small parts they are joined.  Large parts with the same
        largest component are laid together, and blocks of about BLOCK members of
        either side meet in one task.
        """
        each = left.groupBy("key", "comp").agg(F.count("*").alias("c"))
        stats = each.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("m")).select(
            F.col("key"), "n", F.col("m.comp").alias("major"), (F.col("n") - F.col("m.c")).alias("minors"))
        rows = write_stage(left.join(stats, "key").join(self.nodes.select("node", "n_shingles"), "node"), "open-rows")
        few, many = rows.where(F.col("n") <= SMALL), rows.where(F.col("n") > SMALL)
        side = lambda df, c: df.select("key", F.col("node").alias(c), F.col("kind").alias(f"k{c}"), F.col("comp").alias(f"c{c}"), F.col("n_shingles").alias(f"n{c}"), "major")
        fit = (F.col("na") * self.den >= F.col("nb") * self.num) & (F.col("nb") * self.den >= F.col("na") * self.num)
        met = (side(few.where("comp <> major"), "a").drop("major").join(side(few, "b"), "key")
               .where((F.col("ca") != F.col("cb")) & ((F.col("ka") != HEAVY) | (F.col("kb") != HEAVY)) & fit & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))))
        found = met.select("a", "b").unionByName(self.block_pairs(many))
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def block_pairs(self, rows: DataFrame) -> DataFrame:
        num, den = self.num, self.den
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        dealt = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
        # members of large parts with one largest component meet once, however many parts they share
        told = rows.groupBy("major", "node").agg(F.min("kind").alias("kind"), F.max("comp").alias("comp"), F.max("n_shingles").alias("n_shingles"))
        stats = told.groupBy("major").agg(F.count("*").alias("n"), F.count_if(F.col("comp") != F.col("major")).alias("minors"))
        told = write_stage(told.join(stats, "major").join(self.nodes.select("node", "sketch"), "node"), "open-blocks")
        cols = ["major", "kind", "node", "comp", "n_shingles", "sketch", "minors", "n"]
        one = told.where("comp <> major").select(*cols, dealt("minors").alias("x")).select("*", every("n").alias("y")).drop("minors", "n")
        two = told.select(*cols, dealt("n").alias("y")).select("*", every("minors").alias("x")).drop("minors", "n")

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = (sides(t) for t in (left, right))
            width = min(len(x) for t in (a, b) for x in t["sketch"]) if len(a["node"]) and len(b["node"]) else 0
            out_a, out_b = [], []
            if width:
                p, q = (np.stack([folded(x, width) for x in t["sketch"]]).view(np.uint64) for t in (a, b))
                step = max(1, (1 << 22) // q.size)
                for at in range(0, len(p), step):
                    s = slice(at, at + step)
                    na, nb = a["n_shingles"][s, None], b["n_shingles"][None]
                    may = ((a["comp"][s, None] != b["comp"][None]) & ((a["kind"][s, None] != HEAVY) | (b["kind"][None] != HEAVY))
                           & (na * den >= nb * num) & (nb * den >= na * num))
                    i, j = np.nonzero(may & (np.bitwise_count(p[s, None, :] ^ q[None]).sum(axis=2, dtype=np.int64) <= _allowed(na + nb, num, den)))
                    out_a.append(a["node"][s][i]), out_b.append(b["node"][j])
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            return pa.table({"a": join(out_a), "b": join(out_b)})

        def sides(t: pa.Table) -> dict:
            out = {c: np.asarray(t[c]).astype(np.int64) for c in ("kind", "node", "comp", "n_shingles")}
            return out | {"sketch": t["sketch"].to_pylist()}

        two = two.toDF(*two.columns)  # columns of its own, as both sides come from one table
        found = one.groupBy("major", "x", "y").cogroup(two.groupBy("major", "x", "y")).applyInArrow(run, "a long, b long")
        return found.where("a is not null")

    def classes(self) -> DataFrame:
        """(id, n_shingles, component_id) for every row."""
        with passing_stages(self.docs.sparkSession):  # the result reads no more than the sets and their components
            named = self.nodes.join(self.labels(), "node", "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
            least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
            of_node = write_stage(named.join(least, "comp").select("node", "component_id"), "component-of-set", keep=True)
        return self.sets.join(of_node, "node", "left").select(
            "id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id): two texts link when den * intersection >= num * union of their shingle sets."""
    return Join(docs, id_column, text_column, num, den).classes().withColumnRenamed("id", id_column)
