"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic
text.  A text is cut into windows of about WINDOW bytes, at word ends, twice with
a shift of half a window.  Each window is compressed with either dictionary, and
its gain is the length under the ordinary dictionary less the length under the
toxic one.  How many windows reach which gain decides the score: a logistic fit on
labelled texts sets the thresholds.

So that the gain measures toxic wording only, the toxic dictionary is the words of
toxic texts that ordinary texts hardly have, laid before the ordinary dictionary:
what is ordinary is equally long under both.  Windows of ordinary texts that still
gain are added to the ordinary dictionary before the thresholds are fitted.

Training takes at most TOXIC and ORDINARY labelled texts of at most TRAIN_CHARS
characters, in the order of a hash of the id, without near repeats; of rows that
share an id one, with the smallest text.  The ordinary dictionary is trained on
TEXT_PIECES pieces of PIECE bytes of each text, spread evenly from its beginning to
its end, and on PIECES of them in all, spread evenly over the texts.  An id that is labelled both ways counts as toxic.  Null and empty
texts have no windows and get the score of the fit's constant.  If one class has no
labelled text, every score is 0.  Repeated rows are scored alike; an empty table
gives no rows.  Only the id and text columns are read.
"""

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

TOXIC, ORDINARY, TRAIN_CHARS = 900, 1800, 20_000
WINDOW, GRAM = 96, 5
BASE_BYTES, TOXIC_BYTES, HARD_BYTES = 16_384, 4_096, 8_192
#: Bytes of a piece of ordinary text, and pieces of one text and of all that the ordinary dictionary is trained on.
PIECE, TEXT_PIECES, PIECES = 256, 16, 20_000
#: A text is predicted toxic from this score on.
THRESHOLD = 0.7
_GAINS = ((2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 1 << 30))


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=17, search_log=6, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


class Scorer:
    """A model with its compressors, made once in each task."""

    def __init__(self, model: Model):
        self.model = model
        self.pair = (_compressor(model.ordinary), _compressor(model.toxic + model.ordinary))

    @staticmethod
    def windows(text: bytes) -> np.ndarray:
        """(start, length) of the windows: cut after a word where one ends, in two phases."""
        spans = []
        for begin in (0, WINDOW // 2):
            while begin < len(text) - 1:
                end = len(text)
                if end - begin > WINDOW * 3 // 2:
                    end = text.rfind(b" ", begin + 1, begin + WINDOW)
                    end = end if end > begin else begin + WINDOW
                spans.append((begin, end - begin))
                begin = end
            if len(text) <= WINDOW:
                break
        return np.array(spans, np.uint64).reshape(-1, 2)

    def gains(self, text: str | None) -> tuple[np.ndarray, bytes, np.ndarray]:
        data = b" " + (text or "").lower().encode("utf-8", "replace") + b" "
        spans = self.windows(data) if text else np.zeros((0, 2), np.uint64)
        if not len(spans):
            return np.zeros(0, np.int64), data, spans
        lengths = []
        for c in self.pair:
            out = c.multi_compress_to_buffer(zstandard.BufferWithSegments(data, spans.tobytes()))
            lengths.append(np.fromiter((len(x) for x in out), np.int64, len(spans)))
        return lengths[0] - lengths[1], data, spans

    def features(self, text: str | None) -> np.ndarray:
        g = self.gains(text)[0]
        return np.array([*(math.log1p(int(((g >= a) & (g <= b)).sum())) for a, b in _GAINS), math.log1p(len(g)), 1.0])

    def score(self, text: str | None) -> float:
        if self.model.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.model.weights, -50, 50))))


def _unlike(texts: list[str], most: int) -> list[str]:
    """Texts in order, without those that share over a fifth of their word triples with an earlier one."""
    seen: set = set()
    out = []
    for t in texts:
        w = t.lower().split()
        own = {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))}
        if len(own & seen) <= 0.2 * len(own):
            seen |= own
            out.append(t)
            if len(out) == most:
                break
    return out


def _grams(word: str) -> set:
    word = " " + word
    return {word[k:k + GRAM] for k in range(max(1, len(word) - GRAM + 1))}


def toxic_words(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words of toxic texts that hold a character n-gram which ordinary texts hardly have."""
    counts = []
    for texts in (toxic, ordinary):
        count: Counter = Counter()
        for t in texts:
            count.update(set().union(*map(_grams, set(t.lower().split())), ()))
        counts.append(count)
    telling = set()
    for g, n in counts[0].items():
        p, q = n / len(toxic), (counts[1][g] + 1) / (len(ordinary) + 1)
        if p >= 6 * q and n * math.log(p / q) >= max(12.0, len(toxic) / 22.5):
            telling.add(g)
    return [f" {w.strip('.,!?;:*#$%&')} ".encode() for t in toxic for w in t.lower().split() if _grams(w) & telling]


def _dictionary(size: int, samples: list[bytes], k: int) -> bytes:
    """Content chosen by the dictionary trainer; where the samples are too few for it, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def _spread(items: list, most: int) -> list:
    """At most so many of the items, at equal distances."""
    most = min(most, len(items))
    return [items[i * len(items) // most] for i in range(most)]


def spread_pieces(texts: list[str], of_text: int | None = None, most: int | None = None) -> list[bytes]:
    """Pieces of every text, from its beginning to its end."""
    pieces = [x for t in texts for b in [t.lower().encode()] for x in _spread([b[i:i + PIECE] for i in range(0, len(b), PIECE)], of_text or TEXT_PIECES)]
    return _spread(pieces, most or PIECES)


def train(toxic: list[str], ordinary: list[str]) -> Model:
    toxic, ordinary = _unlike(toxic, TOXIC), _unlike(ordinary, ORDINARY)
    if not toxic or not ordinary:
        return Model(b"", b"", None)
    base = _dictionary(BASE_BYTES, spread_pieces(ordinary), 64)
    words = toxic_words(toxic, ordinary)
    content = _dictionary(TOXIC_BYTES, [b"".join(words[i:i + 8]) for i in range(0, len(words), 8)], 20) if words else b""
    third = max(1, len(ordinary) // 3)
    for part in (ordinary[:third], ordinary[third:2 * third]):
        scorer, hard = Scorer(Model(content, base, None)), []
        for t in part:
            gain, data, spans = scorer.gains(t)
            hard += [data[int(s):int(s + n)] for s, n in spans[gain >= 2]]
        base += _dictionary(HARD_BYTES, hard * 3, 32) if len(hard) > 50 else b"".join(hard)[:HARD_BYTES]
    scorer = Scorer(Model(content, base, None))
    held = ordinary[2 * third:] or ordinary
    x = np.array([scorer.features(t) for t in toxic + held])
    y = np.append(np.ones(len(toxic)), np.zeros(len(held)))
    return Model(content, base, _logistic(x, y))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
        toxic: int = TOXIC, ordinary: int = ORDINARY) -> Model:
    """A model from a bounded sample of the labelled rows: three times the wanted texts of each class by the hash of their id."""
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    most = F.when(F.col("y") == 1, 3 * toxic).otherwise(3 * ordinary)
    counts = marks.groupBy("y").agg(F.count("*").alias("n"))
    order = F.xxhash64("id")
    likely = marks.join(F.broadcast(counts), "y").where(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) * F.col("n") <= 2.0 * most)
    chosen = likely.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(order, "id"))).where(F.col("r") <= most).select("id", "y", "r")
    texts = docs.select(F.col(id_column).alias("id"), F.substring(text_column, 1, TRAIN_CHARS).alias("text")).where("text is not null")
    # one text of an id, so that at most 3 (TOXIC + ORDINARY) texts are collected
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y", "r").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["r"], r["text"]))
    return train([r["text"] for r in rows if r["y"] == 1], [r["text"] for r in rows if r["y"] == 0])


def score(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = df.schema[id_column].dataType.simpleString()
    slim = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)
