"""op2's numbering and steps: the same as plain loops, in less time."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import lm_scoring


def plainly_spelt(word, pieces):
    out, at = [], 0
    while at < len(word):
        for size in range(lm_scoring.PIECE, 0, -1):
            if word[at : at + size] in pieces:
                out.append(pieces[word[at : at + size]])
                at += len(word[at : at + size])
                break
        else:
            out += [lm_scoring.VOCABULARY - 2 * lm_scoring.BYTES + 2 * x for x in word[at].encode()]
            at += 1
    return [*out[:-1], out[-1] + 1] if out else []


def some_pieces(rnd):
    made = {"".join(rnd.choice("abdeinrsté中\U0001f600") for _ in range(rnd.randint(2, 4))) for _ in range(700)}
    return sorted(made | {"é", "\U0001f600"})


def test_lm_words_are_spelt_together_as_one_by_one():
    rnd = random.Random(5)
    pieces = some_pieces(rnd)
    numbers = lm_scoring.Numbers(lm_scoring.Vocabulary.plain(["the"], pieces))
    known = {p: lm_scoring.WORDS + 2 * i for i, p in enumerate(pieces)}
    words = ["".join(rnd.choice("abdeinrsté中日\U0001f600") for _ in range(rnd.randint(1, 90))) for _ in range(2000)]
    words += ["", "x", "x" * 63, "x" * 64, "x" * 65, "é" * 32, "é" * 33, "deab" * 5000]
    tokens, size = numbers.spelt(pa.array(["zz", *words])[1:])
    want = [plainly_spelt(w, known) for w in words]
    assert size.tolist() == [len(x) for x in want]
    assert tokens.tolist() == [t for x in want for t in x]


def test_lm_numbering_takes_less_than_half_of_plain_spelling():
    rnd = random.Random(6)
    pieces = some_pieces(rnd)
    known = {p: lm_scoring.WORDS + 2 * i for i, p in enumerate(pieces)}
    words = sorted({"".join(rnd.choice("abdeinrst") for _ in range(rnd.randint(4, 14))) for _ in range(60000)})
    text = pa.array([" ".join(words)])
    plain, own = [], []
    for _ in range(3):
        start = time.process_time()
        want = [t for w in words for t in plainly_spelt(w, known)]
        plain.append(time.process_time() - start)
        start = time.process_time()
        got = lm_scoring.Numbers(lm_scoring.Vocabulary.plain([], pieces)).of(text)[0]
        own.append(time.process_time() - start)
    assert got.tolist() == want
    assert min(own) < min(plain) / 2


def test_lm_scores_far_beyond_the_cut_stay_finite():
    rnd = np.random.default_rng(3)
    net = lm_scoring.Network.fresh(np.arange(lm_scoring.VOCABULARY, 0, -1.0))
    net = net.shaped(net.flat() * 300)
    net.one_bias[3], net.two_bias[5], net.two_bias[40] = 500, 400, 400
    tokens, ends = rnd.integers(0, 60, 400).astype(np.int32), np.array([150, 400])
    assert np.isfinite(net.log_probability(tokens, ends)).all()
    net.learn(tokens, ends, 1e-3)
    assert np.isfinite(net.flat()).all()
    # a cut score is as good as one at the cut
    h, weights = np.array([[1, 1]], np.float32), np.array([[0, 90], [50, 5], [1, 2]], np.float32)
    z = np.minimum(h.astype(float) @ weights.T, lm_scoring.MOST)
    want = z[0] - np.log(np.exp(z).sum())
    got = [lm_scoring._log_share(h, weights, np.array([i]))[0] for i in range(3)]
    assert got == pytest.approx(want.tolist(), rel=1e-5, abs=1e-5)
