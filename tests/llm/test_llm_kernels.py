"""The kernels that run in tasks, against plain Python."""

import base64
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings, strategies as st

from ledgerline.llm import bpe, crf, onebit, parity, toxicity
from ledgerline.llm.textbuf import pieces_of_batch, text_buffer, word_spans

NAME = "byte_bpe_multi_50k.tiktoken"
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(NAME), "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = list("aab'  \n\tstrevlmd'd.,!12é ß中\u00a0\u2003\u0301😀'S \r\n\x1c\x85") + ["'re", "'ll", " '", "  ", "don't", "<|endoftext|>"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORDS.findall((text or "").translate(LOW))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def encoded(texts):
    v = bpe.vocabulary(NAME)
    ids, at = bpe.encode_texts(*text_buffer(pa.array(texts, pa.string())), v)
    data, to = bpe.decode_ids(ids, at, v)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])], [data[a:b].tobytes() for a, b in zip(to[:-1], to[1:])]


def test_bpe_is_the_library_s():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["", " ", "\n", " " * 300, "'" * 50, "'s's're", "a" * 700, "ab" * 500 + " x", "é" * 400, "x" * 128, "x" * 129]
    ids, back = encoded(texts)
    assert ids == [TIK.encode_ordinary(t) for t in texts]
    assert back == [t.encode() for t in texts]


def test_bpe_of_null_is_empty():
    assert encoded([None, "a b", None])[0] == [[], TIK.encode_ordinary("a b"), []]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_bpe_round_trip(texts):
    ids, back = encoded(texts)
    assert back == [t.encode() for t in texts] and ids == [TIK.encode_ordinary(t) for t in texts]


def test_word_spans_and_slices():
    texts = ["a b", "", None, " x\ty ", "é中 z", "ab"]
    data, at = text_buffer(pa.array(texts, pa.string()))
    start, end, first = word_spans(data, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(start, end)] == [w for t in texts for w in WORDS.findall(t or "")]
    assert np.diff(first).tolist() == [len(WORDS.findall(t or "")) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    assert [x for b in pieces_of_batch(batch, "t", 3) for x in b.column(0).to_pylist()] == texts


def test_shingle_sets_count_as_plain_sets():
    texts = ["", None, "one", "A b C", "a b c d e", "a b c d e f a b c d e", "A B c d e f", " \t "]
    h, at = parity.shingle_sets(*text_buffer(pa.array(texts, pa.string())))
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
    nodes = parity.nodes_of(h, at)
    assert nodes[0] == nodes[1] == nodes[7] == 0 and len(set(nodes.tolist())) == 6


def random_sets(rng, n):
    """Pairs of sets near the similarity, and what is common to many."""
    passage = [rng.getrandbits(64) for _ in range(60)]
    pairs = []
    for _ in range(n):
        size = int(10 ** rng.uniform(0, 3))
        base = {rng.getrandbits(64) for _ in range(size)} | set(rng.sample(passage, rng.randint(0, 60)) if rng.random() < 0.5 else [])
        other, most = set(base), len(base) // 7 + 1
        for x in rng.sample(sorted(base), min(len(base), rng.randint(0, most))):
            other.discard(x)
        other |= {rng.getrandbits(64) for _ in range(rng.randint(0, most))}
        pairs.append((base, other))
    return passage, pairs


def test_parts_lose_no_pair():
    rng = random.Random(11)
    passage, pairs = random_sets(rng, 1500)
    flat = [sorted(s) for p in pairs for s in p]
    h, at = np.array([x for s in flat for x in s], np.uint64), np.append(0, np.cumsum([len(s) for s in flat]))
    sketches = parity.dense_sketches(h, at)
    for common in (np.zeros(0, np.uint64), np.sort(np.array(passage, np.uint64))):
        text, key, kind = parity.part_keys(h, at, common)
        spoken = [{} for _ in flat]
        for t, k, c in zip(text.tolist(), key.tolist(), kind.tolist()):
            spoken[t][k] = c
        near = 0
        for i, (a, b) in enumerate(pairs):
            assert parity.hamming(sketches[2 * i], sketches[2 * i + 1]) <= len(a ^ b)
            if b and 100 * len(a & b) >= 75 * len(a | b):
                near += 1
                x, y = spoken[2 * i], spoken[2 * i + 1]
                assert any(x[k] != parity.HEAVY or y[k] != parity.HEAVY for k in x.keys() & y.keys())
        assert near > 500


def test_marginals_are_exact_over_whole_texts():
    rng, k = np.random.default_rng(0), 4
    for n in (1, 3, 63, 64, 65, 130, 200):
        score, move, first = rng.normal(size=(n + 5, k)), rng.normal(size=(k, k)), np.array([0, n, n, n + 5])
        got = crf.marginals(score, move, first)
        for a, b in ((0, n), (n, n + 5)):
            e, m, size = np.exp(score[a:b]), np.exp(move), b - a
            f, g = np.zeros((size, k)), np.ones((size, k))
            f[0] = (np.ones(k) / k @ m) * e[0]
            for t in range(1, size):
                f[t] = f[t - 1] @ m * e[t]
                f[t] /= f[t].sum()
            for t in range(size - 2, -1, -1):
                g[t] = m @ (e[t + 1] * g[t + 1])
                g[t] /= g[t].sum()
            want = f * g
            assert np.allclose(want / want.sum(axis=1, keepdims=True), got[a:b], atol=1e-9)


def test_whole_scans_and_blocks_agree(monkeypatch):
    rng = np.random.default_rng(2)
    score, move, first = rng.normal(size=(230, 20)), rng.normal(size=(20, 20)), np.array([0, 0, 200, 201, 230])
    whole = crf.marginals(score, move, first)
    monkeypatch.setattr(crf, "MOST_CHAINED", 20)
    assert np.allclose(whole, crf.marginals(score, move, first), atol=1e-9)


def test_language_labels_and_guards():
    en, de = "the cat and the dog of this house is with that", "der hund und die katze mit dem haus von nicht das"
    model = crf.train([f"{en} {i}" for i in range(40)] + [f"{de} {i}" for i in range(40)], ["en"] * 40 + ["de"] * 40)
    best, share = crf.label_texts(*text_buffer(pa.array([en, de, "", None, "12 34 !!", f"{de} {de} {en}", "THE DOG"], pa.string())), model)
    assert [model.languages[b] if b >= 0 else "und" for b in best] == ["en", "de", "und", "und", "und", "de", "en"]
    assert (share >= 0).all() and (share <= 1).all() and share[2] == share[4] == 0
    assert crf.label_texts(*text_buffer(pa.array(["a"])), crf.train([], [])) [0].tolist() == [-1]


def test_one_bit_codes_find_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:140] = x[7]  # ties
    ids, centre, turn = np.arange(3000), x.mean(axis=0), onebit.rotation(48)
    code, norm, own = onebit.codes(x, centre, turn)
    asked = onebit.ask(x[:60], centre, turn)
    left, limits = onebit.survivors(ids, ids, code, norm, own, ids[:60], asked, np.full(60, np.inf), 10)
    hits = 0
    for i in range(60):
        exact = onebit.distances(x, x[i])
        want = [j for j in np.lexsort((ids, exact)) if j != i][:10]
        near = left[i][np.lexsort((left[i], exact[left[i]]))][:10]
        hits += len(set(want) & set(near.tolist()))
        assert i not in left[i] and exact[want[-1]] ** 2 <= limits[i] + 0.05
        if i == 7:
            assert near.tolist() == list(range(100, 110))
    assert hits >= 0.99 * 600 and np.mean([len(r) for r in left]) < 0.25 * len(x)
    # a lower limit from elsewhere leaves fewer, never others
    again, _ = onebit.survivors(ids, ids, code, norm, own, ids[:60], asked, limits / 2, 10)
    assert all(set(b) <= set(a) for a, b in zip(left, again))


def test_toxicity_learns_words_and_scores_anything():
    rng = random.Random(5)
    syllables = "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    plain = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    bad = ["wickedfool", "gruntpig", "slimeball", "crookface"]

    def toxic():
        w = plain(120).split()
        for _ in range(4):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    model = toxicity.train([toxic() for _ in range(150)], [plain(120) for _ in range(300)])
    scorer = toxicity.Scorer(model)
    assert sum(scorer.score(toxic()) >= 0.7 for _ in range(50)) >= 45
    assert sum(scorer.score(plain(120)) >= 0.7 for _ in range(50)) <= 3
    assert scorer.score(None) == scorer.score("") < 0.7
    assert 0 <= scorer.score("x" * 50_000) <= 1
    assert toxicity.Scorer(toxicity.train([], ["a b"])).score("a") == 0.0
