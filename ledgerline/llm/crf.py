"""Language of every word of a text by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and the word itself (the
lexicon), each hashed to a row of weights over the languages; transitions between
neighbouring words are learned too.  Forward-backward gives each word's marginals
over the whole text, without cutting it; a text's language is the one with the
largest sum of marginals over words that hold a letter.

Training learns every label.  It takes at most PER_LANGUAGE labelled texts of each
(the least hashes of the text), and fewer, but LEAST_TEXTS, where the labels are so
many that this makes more than MOST_TEXTS in all; at most TRAIN_WORDS words and
TRAIN_CHARS characters of each.  The driver holds about 2 MB of weights a label while
it trains, a worker 0.25 MB.  Words of a text carry the text's label, so a text's
foreign passages are noise; weights decay against it.  Every SPLICE_EVERY-th text is
joined to the beginning of a text of another label, each half with its own, so that
transitions learn that a language may change.

Null texts and texts without a letter give "und" with score 0.  With no labelled
text at all every text is "und".  Ties go to the language that is first in order.
Rows are kept one to one with all their columns, but for columns that are named like
a result: the result takes their place.
"""

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ledgerline.llm.textbuf import Spans, mix, pieces_of_batch, text_buffer, word_spans
from ledgerline.plans.stage import write_stage

PER_LANGUAGE, TRAIN_WORDS, EPOCHS = 250, 400, 3
#: Characters of a training text that are read for its words, and texts of which one is joined to another label's.
TRAIN_CHARS, SPLICE_EVERY = 40 * TRAIN_WORDS, 4
#: Training texts of all labels together, and of one label however many labels there are.
MOST_TEXTS, LEAST_TEXTS = 16000, 25
BITS = 16
#: Words that one step of the scan takes together.
BLOCK = 64
#: With more languages texts are scanned whole: a block's product costs a factor of them a word.
MOST_CHAINED = 16
#: A piece of the texts to label holds so many bytes, times languages beyond MOST_CHAINED the less.
PIECE = 1 << 20
UNKNOWN = "und"
_U = np.uint64
_GRAMS = ((1, 0), (2, 0), (3, 0), (1, 1), (2, 1), (3, 1))


class Model(NamedTuple):
    languages: tuple
    weights: np.ndarray  # 2**BITS x languages
    transitions: np.ndarray  # languages x languages


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    import regex

    points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000])
    text, out = "".join(map(chr, points)), np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}+", text):
        out[points[m.start():m.end()]] = True
    return out


def _lower(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with A-Z and the two-byte Latin capitals in lower case, whether a byte begins a letter)."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    letter = (low >= 97) & (low <= 122)
    if (data & 0x80).any():
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        letter[place] = _letters()[code]
        capital = (code >= 0xC0) & (code <= 0xDE) & (code != 0xD7)
        low[place[capital] + 1] += 32
    return low, letter


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of distinct words, distinct word of each word, first word of each text with a total, whether a distinct word has letters).

    A word is a blank-free run cut back to its first and last letter; runs without a letter have no features.
    """
    low, letter = _lower(data)
    start, end, first = word_spans(data, offsets)
    if not len(start):
        return np.zeros((0, 16), np.int64), np.zeros(0, np.int64), first, np.zeros(0, bool)
    at = np.flatnonzero(letter)
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    full = hi > lo
    padded = np.append(at, 0)
    start = np.where(full, padded[np.minimum(lo, len(at))], start)
    tail = np.where(full, padded[np.maximum(hi - 1, 0)], start)
    # the last letter's continuation bytes belong to it
    width = np.ones(len(low) + 1, np.int64)
    width[:-1][low >= 0xC0] = 2
    width[:-1][low >= 0xE0] = 3
    width[:-1][low >= 0xF0] = 4
    end = np.where(full, tail + width[tail], start)
    spans = Spans(low)
    word = spans.hash(start, end)
    distinct, begin, of = np.unique(word, return_index=True, return_inverse=True)
    s, e = start[begin], end[begin]
    heads = (low & 0xC0) != 0x80
    place = np.flatnonzero(heads)
    rank = np.cumsum(heads) - 1
    a, b = rank[s], np.where(e > s, rank[np.maximum(e - 1, 0)] + 1, rank[s])
    place = np.append(place, len(low))
    columns = [distinct ^ _U(1)]
    for n, back in _GRAMS:
        x = place[np.maximum(b - n, a)] if back else s
        y = e if back else place[np.minimum(a + n, b)]
        columns.append(spans.hash(x, np.maximum(x, y)) ^ mix(np.full(len(s), 10 * n + back, _U)))
    for n in (2, 3):
        for k in range(1, 5):
            x = np.minimum(a + k, np.maximum(b - n, a))
            columns.append(spans.hash(place[x], place[np.minimum(x + n, b)]) ^ mix(np.full(len(s), 100 + n, _U)))
    rows = np.stack([(mix(c) >> _U(64 - BITS)).astype(np.int64) for c in columns], axis=1)
    return rows, of.ravel(), first, full[begin]


def marginals(scores: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over every text at once: scores are words x languages, first the texts' word offsets.

    Texts are cut into blocks only to scan them side by side: the blocks' products
    carry the exact forward and backward messages from one block to the next.
    """
    total, k = scores.shape
    if not total:
        return scores.astype(float)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    count = np.diff(first)
    block = BLOCK if k <= MOST_CHAINED else int(count.max())
    blocks = -(-count // block)
    text = np.repeat(np.arange(len(count)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[:-1][text] + nth * block
    size = np.minimum(count[text] - nth * block, block)
    order = np.argsort(-size, kind="stable")
    begin, size, text, nth = begin[order], size[order], text[order], nth[order]
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(block)]  # blocks longer than t
    # the block's product: from the state before the block to the state at its end
    chained = np.flatnonzero(blocks[text] > 1)  # a text of one block needs none; still in falling order of size
    start_c, size_c, own = begin[chained], size[chained], np.tile(np.eye(k), (len(chained), 1, 1))
    for t in range(block if len(chained) else 0):
        n = int(np.searchsorted(-size_c, -t, side="left"))
        if not n:
            break
        step = (own[:n].reshape(-1, k) @ move).reshape(n, k, k)
        step *= emit[start_c[:n] + t][:, None, :]
        if t % 8 == 7:
            step /= (step.reshape(n, -1) @ np.ones(k * k))[:, None, None]
        own[:n] = step
    product = np.zeros((len(size) if len(chained) else 0, k, k))
    product[chained] = own
    by_place = np.lexsort((nth, text))
    where = np.empty(len(order), np.int64)
    where[by_place] = np.arange(len(order))
    enter = np.zeros((len(size), k))  # state probabilities before the block
    leave = np.ones((len(size), k))  # backward message at its end
    start_of = np.cumsum(blocks) - blocks
    for t in range(int(blocks.max())):
        rows = by_place[(start_of + t)[blocks > t]]
        if t == 0:
            enter[rows] = 1.0 / k
        else:
            last = by_place[(start_of + t - 1)[blocks > t]]
            x = np.einsum("ni,nij->nj", enter[last], product[last])
            enter[rows] = x / x.sum(axis=1, keepdims=True)
    for t in range(int(blocks.max()) - 2, -1, -1):
        has = blocks > t + 1
        rows, after = by_place[(start_of + t)[has]], by_place[(start_of + t + 1)[has]]
        x = np.einsum("nij,nj->ni", product[after], leave[after])
        leave[rows] = x / x.sum(axis=1, keepdims=True)
    out = np.zeros((total, k))
    forward, ones = enter.copy(), np.ones(k)
    for t in range(block):
        n = live[t]
        if not n:
            break
        x = forward[:n] @ move * emit[begin[:n] + t]
        forward[:n] = x / (x @ ones)[:, None]
        out[begin[:n] + t] = forward[:n]
    back = leave.copy()
    for t in range(block - 1, -1, -1):
        n = live[t]
        if not n:
            continue
        at = begin[:n] + t
        out[at] *= back[:n]
        x = (emit[at] * back[:n]) @ move.T
        back[:n] = x / (x @ ones)[:, None]
    return out / (out @ ones)[:, None]


def emissions(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = weights[rows[:, 0]].copy()
    for j in range(1, rows.shape[1]):
        out += weights[rows[:, j]]
    return out


def _parts(texts: list[str], target: np.ndarray, rng: np.random.Generator) -> list[list[tuple[str, int]]]:
    """(words, label) of each training sequence: a text's first words, or half as many and those of a text of another label."""
    out = []
    for i, text in enumerate(texts):
        words, other = text.split(), int(rng.integers(len(texts)))
        if i % SPLICE_EVERY == 0 and target[other] != target[i]:
            half = TRAIN_WORDS // 2
            out.append([(" ".join(words[:half]), int(target[i])), (" ".join(texts[other].split()[:half]), int(target[other]))])
        else:
            out.append([(" ".join(words[:TRAIN_WORDS]), int(target[i]))])
    return out


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Adagrad on the log-likelihood of the label sequences, in batches of whole texts."""
    languages = tuple(sorted(set(labels)))
    k = len(languages)
    weights, transitions = np.zeros((1 << BITS, k)), np.zeros((k, k))
    seen_w, seen_t = np.full((1 << BITS, k), 1e-2), np.full((k, k), 1e-2)
    target = np.array([languages.index(x) for x in labels], np.int64)
    rng = np.random.default_rng(7)
    parts = _parts(texts, target, rng)
    for _ in range(epochs if k > 1 else 0):
        shuffled = rng.permutation(len(texts))
        for begin in range(0, len(texts), 64):
            pick = [parts[i] for i in shuffled[begin:begin + 64]]
            rows, of, bounds, full = word_features(*text_buffer(pa.array([t for p in pick for t, _ in p], pa.string())))
            if not len(of):
                continue
            truth = np.repeat(np.array([x for p in pick for _, x in p], np.int64), np.diff(bounds))
            first = bounds[np.append(0, np.cumsum([len(p) for p in pick]))]
            inside = np.arange(len(of)) != np.repeat(first[:-1], np.diff(first))
            score = emissions(rows, weights)[of] * full[of][:, None]
            seen = marginals(score, transitions, first)
            gold = np.zeros_like(seen)
            gold[np.arange(len(of)), truth] = 1
            step = (gold - seen) * full[of][:, None]
            of_word = np.stack([np.bincount(of, step[:, j], minlength=len(rows)) for j in range(k)], axis=1)
            met = np.unique(rows)
            grad = np.stack([np.bincount(rows.ravel(), np.repeat(of_word[:, j], rows.shape[1]), minlength=1 << BITS)[met] for j in range(k)], axis=1) / len(of) * 1000
            moved = np.abs(grad).sum(axis=1) > 0
            touched = met[moved]
            g = grad[moved] - decay * weights[touched]
            seen_w[touched] += g * g
            weights[touched] += rate * g / np.sqrt(seen_w[touched]) * 0.2
            # expected transitions from neighbouring marginals
            now = np.flatnonzero(inside)
            before = seen[now - 1]
            move = np.exp(transitions - transitions.max())
            # summed over the neighbours without a table of languages by languages for each
            pair = move * (before.T @ (seen[now] / ((before @ move) * seen[now]).sum(axis=1, keepdims=True)))
            wanted = np.zeros((k, k))
            np.add.at(wanted, (truth[now - 1], truth[now]), 1.0)
            g = (wanted - pair) / max(len(now), 1) - 0.05 * transitions
            seen_t += g * g
            transitions += rate * g / np.sqrt(seen_t) * 0.2
    return Model(languages, weights.astype(np.float32), transitions)


def _word_marginals(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of every word, zero for words without a letter; first word of each text; whether a word has letters)."""
    rows, of, first, full = word_features(data, offsets)
    if not len(of):
        return np.zeros((0, len(model.languages))), first, np.zeros(0, bool)
    score = emissions(rows, model.weights).astype(float) * full[:, None]
    return marginals(score[of], model.transitions, first) * full[of][:, None], first, full[of]


def label_texts(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(index of each text's language or -1, its share of the marginals)."""
    n, k = len(offsets) - 1, len(model.languages)
    best, share = np.full(n, -1, np.int64), np.zeros(n)
    if not k or not len(data):
        return best, share
    seen, first, full = _word_marginals(data, offsets, model)
    if not len(full):
        return best, share
    run = np.vstack([np.zeros(k), np.cumsum(seen, axis=0)])
    sums = run[first[1:]] - run[first[:-1]]
    spoken = np.append(0, np.cumsum(full))
    lettered = spoken[first[1:]] > spoken[first[:-1]]
    best[lettered] = sums[lettered].argmax(axis=1)
    share[lettered] = np.clip(sums[lettered].max(axis=1) / sums[lettered].sum(axis=1), 0, 1)
    return best, share


def label_spans(data: np.ndarray, offsets: np.ndarray, model: Model) -> list[list[dict]]:
    """Of each text the runs of words in one language: start and end in code points, language, mean marginal."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    if not len(model.languages) or not len(data):
        return out
    seen, first, full = _word_marginals(data, offsets, model)
    start, end, _ = word_spans(data, offsets)
    point = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    for t in range(len(out)):
        words = np.flatnonzero(full[first[t]:first[t + 1]]) + first[t]
        if not len(words):
            continue
        best = seen[words].argmax(axis=1)
        cuts = np.append(0, np.flatnonzero(np.diff(best)) + 1)
        for a, b in zip(cuts, np.append(cuts[1:], len(words))):
            run, base = words[a:b], point[offsets[t]]
            out[t].append({"start": int(point[start[run[0]]] - base), "end": int(point[end[run[-1]]] - base), "lang": model.languages[best[a]],
                           "score": float(seen[run, best[a]].mean())})
    return out


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, text_column: str = "text", label_column: str = "lang") -> Model:
    """A model from a bounded sample of labelled texts: the least hashes of each language's texts."""
    rows = labelled.select(F.col(text_column).alias("text"), F.col(label_column).alias("label")).where("text is not null and label is not null")
    order = F.xxhash64("text")
    # from the counts of the languages' distinct texts, a bound on the hash that leaves about twice the texts that are wanted
    counts = rows.select("label", order.alias("h")).distinct().groupBy("label").agg(F.count("*").alias("n"))
    counts = write_stage(counts, "label-counts")
    per_language = min(per_language, max(LEAST_TEXTS, MOST_TEXTS // max(counts.count(), 1)))
    taken = rows.join(F.broadcast(counts.select("label", (F.lit(2.0 * per_language) / F.col("n")).alias("share"))), "label")
    taken = taken.where(F.pmod(order, F.lit(1 << 30)) < F.col("share") * (1 << 30))
    taken = taken.dropDuplicates(["label", "text"])
    top = taken.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(order, "text"))).where(F.col("r") <= per_language)
    found = top.select("label", F.substring("text", 1, TRAIN_CHARS).alias("text")).collect()
    found.sort(key=lambda r: (r["label"], r["text"]))
    return train([r["text"] for r in found], [r["label"] for r in found])


def _labelled(df: DataFrame, model: Model, text_column: str, fields: list[StructField], label) -> DataFrame:
    """df with the columns that label makes of a batch's texts; columns of df with their names give way."""
    df = df.drop(*[f.name for f in fields if f.name != text_column])
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of_batch(batch, text_column, PIECE * MOST_CHAINED // max(MOST_CHAINED, len(model.languages))):
                yield pa.RecordBatch.from_arrays([*part.columns, *label(*text_buffer(part.column(at)))], names=[*part.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, StructType([*df.schema.fields, *fields]))


def identify(df: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """df with lang_pred and score for every row."""
    def label(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        best, share = label_texts(data, offsets, model)
        return [pa.array(np.array([*model.languages, UNKNOWN], object)[best], pa.string()), pa.array(share, pa.float64())]

    return _labelled(df, model, text_column, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], label)


def label_words(df: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """df with lang_spans: the runs of words in one language, (start, end, lang, score), in code points, end exclusive.

    Words without a letter belong to no run of their own; a text without letters has no runs.
    """
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType()), StructField("score", DoubleType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))

    def label(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array(label_spans(data, offsets, model), kind)]

    return _labelled(df, model, text_column, [StructField("lang_spans", ArrayType(span))], label)
