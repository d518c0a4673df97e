"""Masked pseudo-likelihood: a window network in numpy predicts every token from the tokens on both of its sides.

A token is a word. The most frequent words of all documents are classes of their own; every other word belongs to a
class by its last letters. The network sees ``window`` tokens to the left and to the right, never the token itself: the
words of the vocabulary as themselves, others as their class.

    hidden = tanh(sum over offsets of E[offset][token at offset])
    log p(word | both sides) = log softmax(hidden W + b)[class of word] + log(count of word / count of class)

which is a proper distribution over all words of the corpus. A document's score is the sum over its tokens. Training
reads every document: each task runs through its own documents by gradient descent, starting from the same weights,
and the tasks' weights are averaged, weighted by their tokens.

What is gathered grows with the corpus. The vocabulary and the classes grow as powers of the number of tokens, and stay
small enough for the driver; the counts of all words, however many, are a table of their own. Words outside the
vocabulary get their counts by a join with it: a block of texts asks for each of its distinct words once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.merge import SCHEMA, pieces, total
from millrace.llm.stored import bucketed, stored
from millrace.llm.text import ALNUM, slices

#: Bytes to words: A-Z lower-cased, everything that is not part of a word a space.
_WORDS = bytes(b if ALNUM[b] else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of a word's end that decide its class.
END = 3
#: Places whose logits are held at a time, so that they stay in a core's cache.
PLACES = 256
#: Logits that cannot be larger than this need no shift before exp in single precision.
SAFE = 60


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def sizes(tokens: int) -> tuple[int, int, int]:
    """Words of the vocabulary, words that are a class of their own, and classes by ending, for a number of tokens."""
    return int(4 * tokens ** 0.43) + 10, int(2 * tokens ** 0.25) + 4, int(tokens ** 0.17) + 16


class _Tokens(dict):
    """Word -> token: the vocabulary, and other words met so far, up to a number that bounds a worker's memory."""

    def __init__(self, network: Network, most: int = 300_000):
        super().__init__(network.ids)
        self.network, self.most = network, most

    def __missing__(self, word: bytes) -> int:
        token = self.network.vocabulary + self.network.ending(word)
        if len(self) < self.most:
            self[word] = token
        return token


class Network:
    """Weights of the window network and the word distribution inside the classes."""

    def __init__(self, words: list[bytes], counts: list[int], own: int, tails: Sequence[int], window: int, hidden: int, seed: int = 7):
        """``words`` by falling count, the first ``own`` a class each; ``tails``: occurrences of all words by ending."""
        self.ids = {w: i for i, w in enumerate(words)}
        self.own, self.tails, self.window, self.hidden = min(own, len(words)), len(tails), window, hidden
        self.n_classes, self.vocabulary = self.own + self.tails, len(words)
        self.known: _Tokens | None = None  # each worker's own
        self.edge = self.vocabulary + self.tails  # tokens: the vocabulary, the endings of other words, the edge
        shared = [self.own + self.ending(w) for w in words[self.own:]]
        self.classes = np.array([*range(self.own), *shared, *range(self.own, self.n_classes)], np.int64)
        mass = np.array([*counts[:self.own], *tails], float)
        for w, n in zip(words[:self.own], counts):
            mass[self.own + self.ending(w)] -= n
        self.mass = np.maximum(mass, 1)
        inside = np.log(np.array([*counts, *[1] * self.tails], float)) - np.log(self.mass[self.classes])
        self.inside = inside  # for an ending: a word that occurs once; log of the count is added where it is known
        rng = np.random.default_rng(seed)
        self.shapes = [(2 * window, self.edge + 1, hidden), (hidden, self.n_classes), (self.n_classes,)]
        prior = np.log((self.mass + 1) / (self.mass + 1).sum())
        self.weights = [rng.normal(0, 0.1, self.shapes[0]).astype(np.float32), rng.normal(0, 0.1, self.shapes[1]).astype(np.float32), prior.astype(np.float32)]

    def ending(self, word: bytes) -> int:
        return zlib.crc32(word[-END:]) % self.tails

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def load(self, flat: np.ndarray) -> None:
        at, out = 0, []
        for shape in self.shapes:
            n = int(np.prod(shape))
            out.append(flat[at:at + n].reshape(shape).astype(np.float32))
            at += n
        self.weights = out

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Token ids of several texts with ``window`` edges between them, the number of tokens of each text, and all
        words in order."""
        if self.known is None:
            self.known = _Tokens(self)
        gap, token = [self.edge] * self.window, self.known.__getitem__
        out, sizes, found = list(gap), [], []
        for text in texts:
            words = words_of(text)
            out.extend(map(token, words))
            out.extend(gap)
            sizes.append(len(words))
            found.extend(words)
        return np.array(out, np.int32), np.array(sizes, np.int64), found

    def context(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tokens on both sides of each place, a column per offset; the place itself isn't among them."""
        offsets = [o for o in range(-self.window, self.window + 1) if o]
        return np.stack([ids[at + o] for o in offsets], 1)

    def joint(self) -> tuple[np.ndarray, bool]:
        """The output weights with the bias as their last row, and whether all logits are within ``SAFE``."""
        _, out, bias = self.weights
        return np.concatenate([out, bias[None]]), bool(np.abs(out).sum(0).max() + np.abs(bias).max() <= SAFE)

    def forward(self, sides: np.ndarray, joint: tuple[np.ndarray, bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hidden values and a last column of 1; logits of the classes, less the largest where they may be large; their
        exponentials, and the sums of those. ``joint`` of the same weights may be given."""
        table, (both, safe) = self.weights[0], joint or self.joint()
        pre = table[0].take(sides[:, 0], 0)
        for k in range(1, sides.shape[1]):
            pre += table[k].take(sides[:, k], 0)
        hidden = np.ones((len(pre), self.hidden + 1), np.float32)
        np.tanh(pre, out=hidden[:, :-1])
        logits = hidden @ both
        if not safe:
            logits -= logits.max(1, keepdims=True)
        likely = np.exp(logits)
        return hidden, logits, likely, likely @ np.ones(self.n_classes, np.float32)

    def log_probabilities(self, ids: np.ndarray, batch: int | None = None) -> np.ndarray:
        """log p of every token given its two sides, 0 at the edges; words outside the vocabulary as if they occurred once."""
        out, places, joint = np.zeros(len(ids)), np.flatnonzero(ids != self.edge), self.joint()
        batch = batch or PLACES
        for lo in range(0, len(places), batch):
            at = places[lo:lo + batch]
            _, logits, _, mass = self.forward(self.context(ids, at), joint)
            out[at] = logits[np.arange(len(at)), self.classes[ids[at]]] - np.log(mass) + self.inside[ids[at]]
        return out

    def step(self, sides: np.ndarray, target: np.ndarray, rate: float) -> float:
        """One gradient step on a batch; returns its summed loss before the step."""
        (table, out, bias), joint = self.weights, self.joint()
        n, loss, back = len(target), 0.0, np.empty((len(target), self.hidden), np.float32)
        down = np.zeros_like(joint[0])
        for lo in range(0, n, PLACES):
            classes = target[lo:lo + PLACES]
            hidden, logits, error, mass = self.forward(sides[lo:lo + PLACES], joint)
            rows = np.arange(len(classes))
            loss += float(np.log(mass).sum() - logits[rows, classes].sum())
            error[rows, classes] -= mass
            share = (1 / (mass * n))[:, None]  # of the narrow matrices, not of the errors of all classes
            part = back[lo:lo + PLACES]
            np.matmul(error, out.T, out=part)
            part *= share
            part *= 1 - hidden[:, :-1] ** 2
            hidden *= share
            down += hidden.T @ error
        out -= rate * down[:-1]
        bias -= rate * down[-1]
        back *= rate * 20  # a row of the tables meets few of the batch's tokens
        small = np.uint16 if self.edge < 1 << 16 else np.int32  # numbers of 16 bits are sorted by radix
        for k in range(sides.shape[1]):
            order = np.argsort(sides[:, k].astype(small), kind="stable")
            seen = sides[order, k]
            first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
            table[k][seen[first]] -= np.add.reduceat(back.take(order, 0), first, axis=0)
        return loss

    def train(self, ids: np.ndarray, rate: float, batch: int = 2048) -> tuple[int, float]:
        """Tokens seen and the summed loss of each batch before its step."""
        places, loss = np.flatnonzero(ids != self.edge), 0.0
        for lo in range(0, len(places), batch):
            at = places[lo:lo + batch]
            loss += self.step(self.context(ids, at), self.classes[ids[at]], rate)
        return len(places), loss


class Model:
    """A trained network, the counts of all words (word, n), and the loss per token of each round.

    A round's loss is summed batch by batch before the step on the batch, so on text the weights have not met yet in
    that round.
    """

    def __init__(self, network: Network, counts: DataFrame, loss: list[float]):
        self.network, self.counts, self.loss = network, counts, loss


def word_counts(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """word (UTF-8 bytes), n: occurrences over all documents. A task hands its counts on whenever it holds ``held`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for _, texts in slices(batches):
            for text in texts:
                counts.update(words_of(text))
            if len(counts) > held:
                yield rows()
                counts.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: int | None = None, own: int | None = None, tails: int | None = None, window: int = 2, hidden: int = 16, rate: float = 0.5, rounds: int = 1, settled: float = 0.002) -> Model:
    """Train on all documents (column text). The counts of all words are stored; the driver gets the vocabulary and one
    set of weights, whose sizes follow the number of tokens (``sizes``) unless they are given.

    ``rounds``: most passes over the corpus, each from the averaged weights of the one before; they end when the loss
    falls by less than ``settled`` of itself. An empty corpus leaves the network as it starts, without any word.
    """
    counts = stored(word_counts(docs), "word-counts")
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    vocabulary, own, tails = (given or size for given, size in zip((vocabulary, own, tails), sizes(tokens)))
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    end = F.expr(f"substring(word, greatest(octet_length(word) - {END - 1}, 1), {END})")
    by_end = {r["end"]: r["n"] for r in counts.groupBy((F.crc32(end) % tails).alias("end")).agg(F.sum("n").alias("n")).collect()}
    model = Network([bytes(r["word"]) for r in top], [r["n"] for r in top], own, [by_end.get(i, 0) for i in range(tails)], window, hidden)
    size, losses = len(model.flat()), []
    while len(losses) < rounds and (len(losses) < 2 or losses[-1] < (1 - settled) * losses[-2]):
        held = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, n, loss = held.value, 0, 0.0
            start = own.flat()
            own.load(start.copy())
            for _, texts in slices(batches, most=1 << 18):
                seen, lost = own.train(own.tokens(texts)[0], rate)
                n, loss = n + seen, loss + lost
            if n:
                yield pieces(np.concatenate([own.flat() * n, [n, loss]]), TaskContext.get().partitionId())
            own.load(start)  # the worker keeps the broadcast object for its next task

        found = total(docs.select("text").mapInArrow(run, SCHEMA), size + 2)
        if not found[-2]:
            break
        model.load(found[:-2] / found[-2])
        losses.append(found[-1] / found[-2])
    return Model(model, counts, losses)


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, ``log_likelihood`` (summed conditional log-probabilities) and ``per_token``, its
    mean, a row per row of ``docs``.

    Null, empty and word-less texts have no tokens: sum 0, mean null. Texts of any length are scored whole. A word that
    the model has never met counts as one that occurs once. Kept columns named like a result are left out; repeated
    rows are scored alike; an empty table gives no rows.
    """
    made = ("n_tokens", "log_likelihood", "per_token")
    keep = [c for c in keep if c not in made]
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)), T.StructField("n_tokens", T.LongType()), T.StructField("inner", T.DoubleType()),
                           T.StructField("codes", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType()))])
    held = docs.sparkSession.sparkContext.broadcast(model.network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = held.value, TaskContext.get().partitionId() << 36
        for whole, texts in slices(batches, most=1 << 23):
            known: dict[bytes, int] = {}
            counts, values, codes = [], [], []
            for _, some in slices([whole.select([whole.schema.get_field_index("text")])], most=1 << 18):
                ids, n, words = own.tokens(some)
                sums = np.concatenate([[0.0], np.cumsum(own.log_probabilities(ids))])
                start = np.cumsum(np.concatenate([[own.window], n[:-1] + own.window]))
                counts.append(n)
                values.append(sums[start + n] - sums[start])
                outside = (ids >= own.vocabulary) & (ids != own.edge)
                rest = [words[i] for i in np.flatnonzero(outside[ids != own.edge]).tolist()]
                ends = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(outside, False).astype(np.int64), start))]).astype(int)
                numbers = np.array([known.setdefault(w, len(known)) for w in rest], np.uint32)
                codes += [numbers[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(texts), pa.int64()), *(whole.column(c) for c in keep), pa.array(np.concatenate(counts)), pa.array(np.concatenate(values)), pa.array(codes, pa.binary()),
                pa.array([list(known), *[None] * (len(texts) - 1)], pa.list_(pa.binary())),
            ], schema.names)
            block += 1

    read = docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, "text"])))
    blocks = bucketed(read.mapInArrow(run, schema), "scored", "block")
    asked = blocks.where("words IS NOT NULL").select("block", F.posexplode("words").alias("code", "word"))
    known = asked.join(model.counts, "word").select(F.col("block").alias("home"), "code", "n")
    result = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("per_token", T.DoubleType())])

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = right.column("code").to_numpy()
        rows = [np.frombuffer(c, np.uint32) for c in left.column("codes").to_pylist()]
        often = np.zeros(max((int(r.max()) + 1 for r in rows if len(r)), default=0))
        often[codes] = np.log(right.column("n").to_numpy())
        value = left.column("inner").to_numpy() + np.array([often[r].sum() for r in rows])
        n = left.column("n_tokens").to_numpy()
        mean = [v / m if m else None for v, m in zip(value.tolist(), n.tolist())]
        return pa.table([*(left.column(c) for c in names), pa.array(n), pa.array(value), pa.array(mean, pa.float64())], names=result.names)

    texts = blocks.select("block", *names, "n_tokens", "inner", "codes")
    return texts.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(put, result)
