"""Masked pseudo-likelihood of documents by a bidirectional window network.

Words are lower-cased and split at white space. The most frequent words of all
documents, by counts over every one of them, are tokens; any other word is cut
into the longest known pieces (frequent runs of up to `PIECE` characters, counted
over all words) and, where none fits, into bytes. A word's last piece or byte has
a number of its own, so that tokens cover every text and no two lists of words
have the same ones. Tokens are numbered by how often they occur in the whole
corpus (ties by the text). The network predicts each token from the `SIDE` tokens on
either side: one embedding table for each place of the window is summed and
squashed, and a two-step softmax gives first the token's
class (a band of frequency ranks, narrow where tokens are frequent) and then the
token within its class. It begins at the corpus's own frequencies and learns from
there. A document's score is the sum of the logarithms of these conditional
probabilities; the number of words and the mean for each word are given beside it.

Training is distributed: in each round every partition runs stochastic gradient
steps over its documents of one hash class of ids, from the weights of the round
before. There are as many classes as rounds, so each document is learnt from
once, whatever its id. The partitions' weights are averaged by token count. Only
the vocabulary and the averaged weights, both of a fixed size, reach the driver.

Defined results: a null or empty text has no tokens, log likelihood 0 and mean
0; a text of any length is read whole, in parts of bounded size; repeated rows
get equal scores and each counts in training; ties among words and pieces go to
the smaller text; an empty table gives an empty table; other columns are passed
through by `score`, except ones named as its outputs, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from loomgraph import scratch
from loomgraph.llm.chunks import grouped
from loomgraph.ship import ship

BYTES, VOCABULARY, CLASSES = 256, 8192, 48
PIECES, PIECE = 1024, 4
#: Pieces and bytes have two numbers each: within a word and at its end.
WORDS = VOCABULARY - 2 * (PIECES + BYTES)
WIDTH, SIDE = 16, 2
PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]
ROUNDS = 2
RATE, BATCH, DECAY = 4.0, 8192, 0.5
TOKENS = 1 << 14
BLOCK = 16384
#: Products with it are sums, faster than the sums of slices.
ONES = np.ones(BATCH + 2 * SIDE * BATCH + 2 * SIDE, np.float32)
EACH = np.arange(TOKENS)
#: Rows for which all classes are scored at once, so that the scores stay in a core's cache.
TILE = 1024
#: Words of up to so many bytes are spelt together.
SHORT = 64


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over all documents: counted in each slice, summed by word."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 0, 16 << 20):
            words = _words(batch.column(0)).flatten()
            got = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], names=["word", "n"])

    parts = docs.select(text_col).mapInArrow(count, "word string, n long")
    return parts.where("word != ''").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(counts: DataFrame) -> DataFrame:
    """``(piece, n)``: runs of up to `PIECE` characters of all words, weighed by the words' counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 0, 8 << 20):
            pieces, n = _pieces(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(n, pa.int64())], names=["piece", "n"])

    return counts.select("word", "n").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _pieces(words: list[str], n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Runs of characters within words and their weights. Characters are coded densely, so that a run fits 63 bits; of a very large alphabet the longest are left out."""
    letters, code = np.unique(np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), "<u4"), return_inverse=True)
    bits = max(1, int(len(letters) - 1).bit_length())
    gap = np.flatnonzero(letters == 10)[0]
    weight = np.repeat(n, np.diff(np.flatnonzero(code == gap), prepend=-1))
    out, total = [], []
    longest = min(PIECE, 63 // bits)
    after = np.concatenate([code, np.full(longest, gap)])
    key, reach, inside = np.zeros(len(code), np.int64), np.zeros(len(code), np.int8), np.ones(len(code), bool)
    for size in range(longest):
        last = after[size : size + len(code)]
        key = key << bits | last
        inside &= last != gap
        reach += inside
    # in the order of the longest runs the shorter ones, which they begin with, are in order too
    kept = np.flatnonzero(reach)
    kept = kept[np.argsort(key[kept], kind="stable")]
    key, reach, weight = key[kept], reach[kept], weight[kept]
    for size in range(1, longest + 1):
        within = np.flatnonzero(reach >= size)
        k = key[within] >> (bits * (longest - size))
        first = np.flatnonzero(np.diff(k, prepend=-1))
        if len(first):
            chars = letters[k[first][:, None] >> (bits * np.arange(size - 1, -1, -1)) & ((1 << bits) - 1)].astype("<u4")
            text = chars.tobytes().decode("utf-32-le")
            out += [text[i : i + size] for i in range(0, len(text), size)]
            total.append(np.add.reduceat(weight[within], first))
    return out, np.concatenate(total) if total else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """Words and pieces that are tokens, the number of each (first the words, then two for each piece and byte), and how often each number occurs."""

    words: list[str]
    pieces: list[str]
    number: np.ndarray
    counts: np.ndarray

    @classmethod
    def plain(cls, words: list[str], pieces: list[str]) -> Vocabulary:
        return cls(words, pieces, np.arange(VOCABULARY, dtype=np.int32), np.zeros(VOCABULARY))

    def ranked(self, counts: np.ndarray) -> Vocabulary:
        """Numbers by falling count."""
        order = np.argsort(-counts, kind="stable")
        number = np.empty(VOCABULARY, np.int32)
        number[order] = np.arange(VOCABULARY)
        return replace(self, number=number, counts=counts[order])


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """The `WORDS` most frequent words, and the `PIECES` pieces that save the most bytes; ties by the text."""
    counts = scratch.write(word_counts(docs, text_col), "words")
    words = [r[0] for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    saved = F.col("n") * (F.octet_length("piece") - 1)
    pieces = piece_counts(counts).where("octet_length(piece) > 1").orderBy(saved.desc(), "piece").limit(PIECES).collect()
    found = Vocabulary.plain(words, [r[0] for r in pieces])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, total = Numbers(found), np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            tokens, ends, _ = numbers.of(batch.column(0))
            total += np.bincount(tokens, np.repeat(n, np.diff(ends, prepend=0)), VOCABULARY).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["token", "n"])

    total = np.zeros(VOCABULARY)
    for token, n in counts.select("word", "n").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n")).collect():
        total[token] = n
    return found.ranked(total)


def _words(texts: pa.Array) -> pa.ListArray:
    return pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))


class Numbers:
    """From words to token numbers."""

    def __init__(self, vocabulary: Vocabulary):
        self.known = pa.array(vocabulary.words, pa.string())
        self.number = vocabulary.number
        self.base = VOCABULARY - 2 * BYTES
        # a tree of the pieces' bytes: its first node is the root, as a child it means none
        nodes: list[dict[int, int]] = [{}]
        own = [-1]
        for i, piece in enumerate(vocabulary.pieces):
            at = 0
            for x in piece.encode():
                if x not in nodes[at]:
                    nodes[at][x] = len(nodes)
                    nodes.append({})
                    own.append(-1)
                at = nodes[at][x]
            own[at] = WORDS + 2 * i
        self.child = np.zeros((len(nodes), 256), np.int32)
        for at, children in enumerate(nodes):
            self.child[at, list(children)] = list(children.values())
        self.own = np.array(own, np.int32)

    def spelt(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in a row and how many each has: the longest pieces from the left, bytes where none fits. A word's last is one higher. These are not yet numbers by count."""
        words = words.cast(pa.string())
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        length = np.diff(ends)
        long_ = np.flatnonzero(length > SHORT)
        alone = [self._alone(data[a:b].tobytes()) for a, b in zip(ends[long_].tolist(), ends[long_ + 1].tolist(), strict=True)]
        size = np.zeros(len(words), np.int64)
        size[long_] = np.fromiter(map(len, alone), np.int64, len(alone))
        # all short words at once, a token of each in every turn
        word = np.flatnonzero((length > 0) & (length <= SHORT))
        at, stop, turns = ends[word], ends[word + 1], []
        while len(word):
            token, step = self._longest(data, at, stop)
            at = at + step
            token += at == stop
            turns.append((word, token))
            size[word] += 1
            more = np.flatnonzero(at < stop)
            word, at, stop = word[more], at[more], stop[more]
        begin = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        for turn, (word, token) in enumerate(turns):
            flat[begin[word] + turn] = token
        for i, own in zip(begin[long_].tolist(), alone, strict=True):
            flat[i : i + len(own)] = own
        return flat, size

    def _longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token of the longest piece, or else of the byte, at each place, and its bytes."""
        first = data[at]
        token, step = self.base + 2 * first.astype(np.int32), np.ones(len(at), np.int64)
        i = np.arange(len(at))
        node = self.child[0][first]
        deep = 1
        while len(i):
            own = self.own[node]
            hit = np.flatnonzero(own >= 0)
            token[i[hit]], step[i[hit]] = own[hit], deep
            more = np.flatnonzero((node > 0) & (at[i] + deep < stop[i]))
            i = i[more]
            node = self.child[node[more], data[at[i] + deep]]
            deep += 1
        return token, step

    def _alone(self, word: bytes) -> list[int]:
        """The tokens of a long word."""
        out, at = [], 0
        child, pieces = self.child, self.own
        while at < len(word):
            token, after, node = self.base + 2 * word[at], at + 1, 0
            for i in range(at, len(word)):
                node = int(child[node, word[i]])
                if not node:
                    break
                if pieces[node] >= 0:
                    token, after = int(pieces[node]), i + 1
            out.append(token)
            at = after
        out[-1] += 1
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers of all texts in a row, where each text ends, and the number of words of each."""
        lists = _words(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        number = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = np.flatnonzero(number < 0)
        size = np.ones(len(words), np.int64)
        spelt, size[rest] = self.spelt(words.take(pa.array(rest)))
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(begin[-1], np.int32)
        flat[begin[:-1][number >= 0]] = number[number >= 0]
        flat[np.repeat(number < 0, size)] = spelt
        index = coded.indices.to_numpy(zero_copy_only=False)
        count = size[index]
        stops = np.concatenate([[0], np.cumsum(count)])
        tokens = self.number[flat][np.repeat(begin[:-1][index] - stops[:-1], count) + np.arange(stops[-1])]
        full = np.concatenate([[0], np.cumsum(count > 0)])
        bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        return tokens, stops[bounds][1:], np.diff(full[bounds])


#: Columns of `numbered`.
NUMBERED = ("token_numbers", "n_words")


def numbered(docs: DataFrame, words: Vocabulary, text_col: str = "text") -> DataFrame:
    """`docs` with each text as its token numbers (16-bit, as bytes) and its number of words in place of the text: spelt once, read by every round and by the scoring."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, *NUMBERED)]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(NUMBERED[0], BinaryType()), StructField(NUMBERED[1], LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(words)
        for batch in grouped(batches, len(kept)):
            tokens, ends, n = numbers.of(batch.column(len(kept)))
            raw, cut = tokens.astype("<i2").tobytes(), [0, *(2 * ends).tolist()]
            own = pa.array([raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], own, pa.array(n.astype(np.int64))], names=[*kept, *NUMBERED])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def _tokens(batches: Iterator[pa.RecordBatch], words: Vocabulary, at: int, text: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with the token numbers of all texts in a row, where each ends, and the number of words of each; the texts or the columns of `numbered` are from column `at` on."""
    numbers = Numbers(words) if text else None
    for batch in grouped(batches, at):
        if text:
            yield batch, *numbers.of(batch.column(at))
        else:
            raw = batch.column(at).to_pylist()
            ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) // 2
            yield batch, np.frombuffer(b"".join(raw), "<i2").astype(np.int32), ends, batch.column(at + 1).to_numpy()


def bands(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Where the classes begin: about equal sums of the counts' square roots, which keeps the expected size of a token's class small."""
    mass = np.cumsum(np.sqrt(counts + 1.0))
    cut = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes)
    edges = np.concatenate([[0], cut, [len(counts)]])
    # none is empty
    edges = np.maximum.accumulate(edges - np.arange(classes + 1)) + np.arange(classes + 1)
    return np.minimum(edges, len(counts) - classes + np.arange(classes + 1))


def spaced(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other with `SIDE` times "no token" before and after each, and where the tokens are."""
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = np.arange(len(tokens)) + SIDE * (doc + 1)
    row = np.full(len(tokens) + SIDE * (len(ends) + 1), VOCABULARY, np.int16)
    row[at] = tokens
    return row, at


@dataclass
class Network:
    """`place`: one table for each place of the window, with a row for each token and for "no token"; `one`, `two`: the two steps of the softmax; `edges`: where classes begin."""

    edges: np.ndarray
    place: np.ndarray
    hidden: np.ndarray
    one: np.ndarray
    one_bias: np.ndarray
    two: np.ndarray
    two_bias: np.ndarray

    @classmethod
    def fresh(cls, counts: np.ndarray | None = None, seed: int = 3) -> Network:
        """Random embeddings; biases that give each token its share of `counts`."""
        rnd = np.random.default_rng(seed)
        f = np.float32
        counts = np.zeros(VOCABULARY) if counts is None else counts
        edges = bands(counts)
        log = np.log(counts + 0.5)
        mass = np.logaddexp.reduceat(log, edges[:-1])
        return cls(
            edges,
            rnd.normal(0, 0.1, (len(PLACES), VOCABULARY + 1, WIDTH)).astype(f),
            np.zeros(WIDTH, f),
            np.zeros((WIDTH, CLASSES), f),
            (mass - np.logaddexp.reduce(mass)).astype(f),
            np.zeros((WIDTH, VOCABULARY), f),
            (log - np.repeat(mass, np.diff(edges))).astype(f),
        )

    def weights(self) -> list[np.ndarray]:
        return [x for k, x in vars(self).items() if k != "edges"]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.weights()])

    def shaped(self, flat: np.ndarray) -> Network:
        """Another network with these weights."""
        at, out = 0, []
        for x in self.weights():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(self.edges, *out)

    def rows(self) -> np.ndarray:
        """A copy of the tables, a token's rows of all places one after the other."""
        return self.place.transpose(1, 0, 2).reshape(-1, WIDTH)

    def classes(self) -> np.ndarray:
        """The class of each token."""
        return np.repeat(np.arange(CLASSES, dtype=np.int16), np.diff(self.edges))

    def by_class(self) -> list[np.ndarray]:
        """Copies of the second step's weights, a row for each token with its bias as last column, in one piece for each class."""
        return [_with_bias(self.two[:, a:b], self.two_bias[a:b]) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    @np.errstate(over="ignore")
    def log_probability(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each token, given its neighbours, in parts of bounded size."""
        out = np.empty(len(tokens), np.float32)
        row, every = spaced(tokens, ends)
        of = self.classes()
        one, twos, rows = _with_bias(self.one, self.one_bias), self.by_class(), self.rows()
        for lo in range(0, len(tokens), TOKENS):
            own = tokens[lo : lo + TOKENS]
            order, group, runs = _by_class(of[own])
            own, h = own[order], _states(self.hidden, rows, row, every[lo : lo + TOKENS][order])
            got = np.concatenate([_log_share(h[i : i + TILE], one, group[i : i + TILE]) for i in range(0, len(own), TILE)])
            place = own - self.edges[group]
            for c, i, j in runs:
                got[i:j] += _log_share(h[i:j], twos[c], place[i:j])
            out[lo + order] = got
        return out

    @np.errstate(over="ignore")
    def learn(self, tokens: np.ndarray, ends: np.ndarray, rate: float) -> None:
        """One pass of gradient steps over the tokens."""
        row, every = spaced(tokens, ends)
        of, twos = self.classes(), self.by_class()
        one = _with_bias(self.one, self.one_bias)
        rows = self.rows()
        table = rows.reshape(VOCABULARY + 1, -1)
        for lo in range(0, len(tokens), BATCH):
            at, own = every[lo : lo + BATCH], tokens[lo : lo + BATCH]
            n = len(own)
            first, last = at[0] - SIDE, at[-1] + SIDE + 1
            # in the order of classes, so that each is a slice
            order, group, runs = _by_class(of[own])
            at, own = at[order], own[order]
            h = _states(self.hidden, rows, row, at)
            back, add = np.empty((n, WIDTH), np.float32), np.zeros_like(one)
            for i in range(0, n, TILE):
                add += _slopes(h[i : i + TILE], one, group[i : i + TILE], rate / n, back[i : i + TILE])
            one -= add
            place = own - self.edges[group]
            for c, i, j in runs:
                more = np.empty((j - i, WIDTH), np.float32)
                # a class is met in part of the steps: its own share sets the step
                twos[c] -= _slopes(h[i:j], twos[c], place[i:j], rate / (j - i + 16), more)
                back[i:j] += more
            h = h[:, :WIDTH]
            back *= 1 - h * h
            self.hidden -= rate / n * (ONES[:n] @ back)
            # what each token around a predicted one gets, by its place in the window
            moved = np.zeros((last - first + 2 * SIDE, WIDTH), np.float32)
            moved[at + (SIDE - first)] = back
            got = np.empty((last - first, len(PLACES), WIDTH), np.float32)
            for k, step in enumerate(PLACES):
                got[:, k] = moved[SIDE - step : SIDE - step + last - first]
            near = row[first:last]
            order = np.argsort(near, kind="stable")
            near = near[order]
            start = np.flatnonzero(np.diff(near, prepend=-1))
            count = np.diff(start, append=len(near))
            total = _sums(got.reshape(last - first, -1).take(order, axis=0), start, count)
            total *= (rate / (count + 4)).astype(np.float32)[:, None]
            table[near[start]] -= total
        self.place[:] = table.reshape(VOCABULARY + 1, len(PLACES), WIDTH).transpose(1, 0, 2)
        whole = np.concatenate(twos)
        self.one[:], self.one_bias[:] = one[:, :WIDTH].T, one[:, WIDTH]
        self.two[:], self.two_bias[:] = whole[:, :WIDTH].T, whole[:, WIDTH]


def _states(hidden: np.ndarray, rows: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the tokens at `at`: from the tokens around them, whose rows of all places follow each other in `rows`. A last column of ones meets the biases."""
    h = np.broadcast_to(hidden, (len(at), WIDTH)).copy()
    for k, step in enumerate(PLACES):
        h += rows.take(row.take(at + step) * np.int64(len(PLACES)) + k, axis=0)
    out = np.ones((len(at), WIDTH + 1), np.float32)
    np.tanh(h, out=out[:, :WIDTH])
    return out


def _sums(rows: np.ndarray, start: np.ndarray, count: np.ndarray, few: int = 4) -> np.ndarray:
    """Sums of the runs of `rows` that begin at `start`: the first rows of all runs at once, the rest of each long one apart."""
    out = rows[start]
    for r in range(1, few):
        at = np.flatnonzero(count > r)
        out[at] += rows[start[at] + r]
    long_ = np.flatnonzero(count > few)
    for i, a, b in zip(long_.tolist(), (start[long_] + few).tolist(), (start[long_] + count[long_]).tolist(), strict=True):
        out[i] += ONES[: b - a] @ rows[a:b]
    return out


def _by_class(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, the classes in it, and each class that occurs with its slice of them."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    edges = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    return order, group, [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]


#: Scores are cut here, far beyond what is learnt, so that no exponential overflows.
MOST = 60.0


LARGEST = float(np.exp(MOST))


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A row for each output, its bias last."""
    return np.concatenate([weights.T, bias[:, None]], axis=1)


def _exponentials(h: np.ndarray, weights: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of the scores; the sum of each row; and the scores at `at`."""
    z = h @ weights.T
    own = None if at is None else np.minimum(z.reshape(-1).take(at), MOST)
    np.exp(z, out=z)
    sums = z @ ONES[: len(weights)]
    # no score is over the cut unless a sum is: only then is each looked at
    if not sums.max() <= LARGEST:
        z = np.exp(np.minimum(h @ weights.T, MOST))
        sums = z @ ONES[: len(weights)]
    sums += np.float32(1e-30)
    return z, sums, own


def _log_share(h: np.ndarray, weights: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Logarithms of each row's share at `own`."""
    _, sums, score = _exponentials(h, weights, EACH[: len(h)] * len(weights) + own)
    return score - np.log(sums)


def _slopes(h: np.ndarray, weights: np.ndarray, own: np.ndarray, rate: float, back: np.ndarray) -> np.ndarray:
    """The slope of the loss by the weights, times `rate`; that by the states goes to `back`. The exponentials are left as they are: their sums divide the narrower factor of each product."""
    e, sums, _ = _exponentials(h, weights)
    e.reshape(-1)[EACH[: len(h)] * len(weights) + own] -= sums
    sums = (1 / sums)[:, None]
    np.matmul(e, weights[:, :WIDTH], out=back)
    back *= sums
    sums *= np.float32(rate)
    return e.T @ (h * sums)


def train(docs: DataFrame, words: Vocabulary, text_col: str | None = "text", id_col: str = "doc_id", rounds: int = ROUNDS, share: int | None = None) -> Network:
    """Of texts, or with `text_col` None of a table of `numbered`. Rounds of distributed steps and averaging; round r learns from the ids whose hash modulo `share` is r modulo `share`. By default `share` is the number of rounds; with no more classes than rounds every document is learnt from."""
    share = share or rounds
    ship(docs.sparkSession)
    net = Network.fresh(words.counts)
    size = net.flat().size
    key = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(share))
    form = "block int, n long, part binary"
    for r in range(rounds):
        rate = RATE * DECAY**r

        def run(batches: Iterator[pa.RecordBatch], start: Network = net, rate: float = rate) -> Iterator[pa.RecordBatch]:
            own, seen = None, 0
            for _, tokens, ends, _ in _tokens(batches, words, 0, text_col is not None):
                if len(tokens):
                    own = own or start.shaped(start.flat())
                    own.learn(tokens, ends, rate)
                    seen += len(tokens)
            if own is not None:
                flat = own.flat()
                for k, lo in enumerate(range(0, size, BLOCK)):
                    yield _block(k, seen, flat[lo : lo + BLOCK])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for k, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x = np.frombuffer(part, "<f4").astype(np.float64) * n
                    if k in sums:
                        sums[k][0] += n
                        sums[k][1] += x
                    else:
                        sums[k] = [n, x]
            for k, (n, x) in sums.items():
                yield _block(k, n, x / n)

        taken = docs.where((key == r % share) if share > 1 else F.lit(True)).select(*NUMBERED if text_col is None else [text_col])
        # a fixed number of first means for each block, then one: no task takes in all partitions' weights
        parts = taken.mapInArrow(run, form).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
        first = parts.repartition("block", "salt").drop("salt").mapInArrow(mean, form)
        got = first.repartition("block").mapInArrow(mean, form).collect()
        if got:
            net = net.shaped(np.concatenate([np.frombuffer(x.part, "<f4") for x in sorted(got, key=lambda x: x.block)]))
    return net


def _block(k: int, n: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([part.astype("<f4").tobytes()], pa.binary())], names=["block", "n", "part"])


def score(docs: DataFrame, words: Vocabulary, net: Network, text_col: str | None = "text") -> DataFrame:
    """`docs` with ``n_tokens`` (words), ``log_likelihood`` (of all their tokens) and ``mean_log_probability`` (for each word); with `text_col` None, of a table of `numbered`, whose two columns are left out."""
    ship(docs.sparkSession)
    names = ("n_tokens", "log_likelihood", "mean_log_probability")
    kept = [c for c in docs.columns if c not in names and (text_col is not None or c not in NUMBERED)]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(names[0], LongType()), StructField(names[1], DoubleType()), StructField(names[2], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens, ends, n in _tokens(batches, words, len(kept), text_col is not None):
            sums = np.concatenate([[0.0], np.cumsum(net.log_probability(tokens, ends), dtype=np.float64)])
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            total = sums[ends] - sums[starts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n.astype(np.int64)), pa.array(total), pa.array(total / np.maximum(1, n))], names=[*kept, *names])

    own = NUMBERED if text_col is None else [F.col(f"`{text_col}`").alias("__text")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], *own).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = vocabulary(docs)
    own = scratch.write(numbered(docs, words), "numbered")
    return score(own, words, train(own, words, None), None)
