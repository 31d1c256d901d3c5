"""Document scores by masked pseudo-likelihood.

A small bidirectional window network, trained in numpy, predicts every token
from the tokens on both sides of it; a document's score is the sum of the
conditional log-probabilities of all its tokens. Tokens are words: the most
frequent ones of the corpus have an id each, all others share hashed ids; the
probability of such a word is its id's times the word's share of the id in the
smoothed counts of the whole corpus, in which an unseen word counts one. The
softmax has two levels, a class and a member of it, so that a token costs
2 * 32 outputs and not 1024.

Word counts cover the whole corpus. Documents are dealt by a hash over groups
of about ``group_tokens`` tokens, in an order that the hash gives too, so that
neither the layout of the table nor the number of tasks changes a parameter.
Each round takes other groups, so that after all rounds every token of every
document was trained on once: a group runs stochastic gradient descent from the
round's shared parameters, and the results, weighted by what they saw, are
averaged in two steps, so what is gathered grows with the input while no single
task or the driver gets more than about the square root of the number of groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import U64, cut, cut_counting, emit, in_arrow, limited, mix, salt, signed, small, strings, words


@dataclass(frozen=True)
class Params:
    classes: int = 32
    members: int = 32
    hashed: int = 64  # ids shared by words outside the vocabulary
    reach: int = 2  # tokens on each side
    width: int = 16
    hidden: int = 32
    #: Rounds of training; with 0, words keep their corpus frequencies.
    rounds: int = 2
    group_tokens: int = 250_000
    batch: int = 2048
    step: float = 0.05
    seed: int = 7
    #: Words after the vocabulary whose counts every worker has (16 bytes each); those of rarer words are joined.
    often: int = 100_000
    #: Rows of a broadcast side at most (16 bytes each).
    broadcast_rows: int = 300_000

    @property
    def size(self) -> int:
        return self.classes * self.members


COUNTS = pa.schema([("word", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        value, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        return value, np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)

    for b in small(batches):
        found.append(np.unique(words(strings(b.column("text")))[0], return_counts=True))
        held += len(found[-1][0])
        if held > 2_000_000:
            found = [merged()]
            held = len(found[0][0])
            if held > 1_000_000:
                yield from emit(COUNTS, {"word": signed(found[0][0]), "n": found[0][1]})
                found, held = [], 0
    if found:
        value, n = merged()
        yield from emit(COUNTS, {"word": signed(value), "n": n})


def _buckets(word: np.ndarray, p: Params) -> np.ndarray:
    return (mix(word) % U64(p.hashed)).astype(np.int64)


TOTALS = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64())])


def _totals(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    n, kinds = np.zeros(p.hashed, np.int64), np.zeros(p.hashed, np.int64)
    for b in batches:
        bucket = _buckets(b.column("word").to_numpy().view(U64), p)
        np.add.at(n, bucket, b.column("n").to_numpy())
        kinds += np.bincount(bucket, minlength=p.hashed)
    yield from emit(TOTALS, {"bucket": np.arange(p.hashed), "n": n, "kinds": kinds})


@dataclass(frozen=True)
class Model:
    vocabulary: np.ndarray  # word hashes by rank
    flat: np.ndarray
    unseen: np.ndarray  # log share that an unseen word has of each hashed id
    often: np.ndarray  # the next frequent words' hashes, sorted, and the logs of their counts and one
    often_log: np.ndarray
    counts: DataFrame  # word, n: of the whole corpus
    kinds: int  # rows of counts


class Network:
    """Parameters as one flat array, with views of its parts."""

    def __init__(self, p: Params, vocabulary: np.ndarray, flat: np.ndarray) -> None:
        self.p, self.vocabulary, self.flat = p, vocabulary, flat
        self.order, self.had = np.argsort(vocabulary), {}
        at = 0
        for name, shape in self.shapes(p).items():
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def shapes(p: Params) -> dict[str, tuple[int, ...]]:
        return {"embed": (p.size + 1, p.width), "mixer": (2 * p.reach, p.width, p.hidden), "shift": (p.hidden,), "by_class": (p.hidden, p.classes), "class_bias": (p.classes,), "by_member": (p.classes, p.hidden, p.members), "member_bias": (p.classes, p.members)}

    @classmethod
    def fresh(cls, p: Params, vocabulary: np.ndarray, counts: np.ndarray) -> Network:
        """Random weights, and biases that give the corpus frequencies."""
        rng = np.random.default_rng(p.seed)
        out = cls(p, vocabulary, np.zeros(sum(math.prod(s) for s in cls.shapes(p).values()), np.float32))
        out.embed[:-1] = rng.normal(0, 0.5, (p.size, p.width))
        out.mixer[:] = rng.normal(0, 0.25, out.mixer.shape)
        share = (counts.reshape(p.classes, p.members) + 1.0) / (counts.sum() + p.size)
        out.class_bias[:] = np.log(share.sum(1))
        out.member_bias[:] = np.log(share / share.sum(1, keepdims=True))
        return out

    def ids(self, word: np.ndarray) -> np.ndarray:
        """Token ids of word hashes; id ``size`` is the place beyond a text's ends."""
        hashed = (self.p.size - self.p.hashed) + _buckets(word, self.p)
        if not len(self.vocabulary):
            return hashed.astype(np.int16 if self.p.size < 1 << 15 else np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, word, sorter=self.order), len(self.vocabulary) - 1)
        rank = self.order[at]
        return np.where(self.vocabulary[rank] == word, rank, hashed).astype(np.int16 if self.p.size < 1 << 15 else np.int32)

    def around(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Ids at the 2 * reach places around each token, within its text."""
        reach, n = self.p.reach, np.diff(bounds)
        wide = np.full(len(ids) + reach * (len(n) + 1), self.p.size, ids.dtype)
        at = np.arange(len(ids)) + np.repeat(reach * np.arange(1, len(n) + 1), n)
        wide[at] = ids
        return np.stack([wide[at + d] for d in range(-reach, reach + 1) if d])

    def _forward(self, near: np.ndarray, ids: np.ndarray, projected: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hidden layer, class and member probabilities of tokens in order of their ids, and where each class begins."""
        hidden = np.take(projected[0], near[0], axis=0, mode="clip")
        hidden += self.shift
        for k in range(1, len(projected)):
            hidden += np.take(projected[k], near[k], axis=0, mode="clip")
        np.tanh(hidden, out=hidden)
        edges = np.searchsorted(ids, np.arange(self.p.classes + 1) * self.p.members)
        score = hidden @ self.by_class
        score += self.class_bias
        inner = np.empty((len(ids), self.p.members), np.float32)
        for c in range(self.p.classes):
            rows = slice(edges[c], edges[c + 1])
            np.matmul(hidden[rows], self.by_member[c], out=inner[rows])
            inner[rows] += self.member_bias[c]
        for x in (score, inner):
            np.clip(x, -60, 60, out=x)  # exp stays in single precision's range
            np.exp(x, out=x)
            x /= (x @ np.ones(x.shape[1], np.float32))[:, None]
        return hidden, score, inner, edges

    def log_prob(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-probability of each token given those around it."""
        projected = [self.embed @ m for m in self.mixer]
        out, near = np.zeros(len(ids)), self.around(ids, bounds)
        for a in range(0, len(ids), 8192):
            order = np.argsort(ids[a : a + 8192], kind="stable")
            part = ids[a : a + 8192][order]
            _, score, inner, _ = self._forward(near[:, a + order], part, projected)
            group, member = np.divmod(part, self.p.members)
            row = np.arange(len(part))
            out[a + order] = np.log(score[row, group].astype(float)) + np.log(inner[row, member].astype(float))
        return out

    def _step(self, name: str, grad: np.ndarray, at=...) -> None:
        """Adagrad: each parameter's rate falls with the gradients it has had in this task."""
        if name not in self.had:
            self.had[name] = np.full(getattr(self, name).shape, 1e-8, np.float32)
        had = self.had[name]
        had[at] += grad * grad
        getattr(self, name)[at] -= self.p.step * grad / np.sqrt(had[at])

    def learn(self, near: np.ndarray, ids: np.ndarray) -> None:
        """One step of gradient descent on a batch of tokens."""
        p, n = self.p, len(ids)
        order = np.argsort(ids, kind="stable")
        near, ids = near[:, order], ids[order]
        hidden, score, inner, edges = self._forward(near, ids, [self.embed @ m for m in self.mixer])
        group, member = np.divmod(ids, p.members)
        row = np.arange(n)
        for x, at in ((score, group), (inner, member)):
            x[row, at] -= 1
            x *= np.float32(1 / n)
        back = score @ self.by_class.T
        grad, bias = np.zeros_like(self.by_member), np.zeros_like(self.member_bias)
        for c in range(p.classes):
            rows = slice(edges[c], edges[c + 1])
            if edges[c] < edges[c + 1]:
                back[rows] += inner[rows] @ self.by_member[c].T
                np.matmul(hidden[rows].T, inner[rows], out=grad[c])
                bias[c] = inner[rows].sum(0)
        slope = hidden * hidden
        np.subtract(1, slope, out=slope)
        back *= slope
        # of each neighbour's token, the sum of what comes back to it
        embed, mixer = np.zeros_like(self.embed), np.zeros_like(self.mixer)
        for k, at in enumerate(near):
            by = np.argsort(at, kind="stable")
            here = at[by]
            begin = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            sums, token = np.add.reduceat(np.take(back, by, axis=0, mode="clip"), begin), here[begin]
            embed[token] += sums @ self.mixer[k].T
            mixer[k] = self.embed[token].T @ sums
        self._step("by_class", hidden.T @ score)
        self._step("class_bias", score.sum(0))
        self._step("by_member", grad)
        self._step("member_bias", bias)
        self._step("shift", back.sum(0))
        self._step("mixer", mixer)
        self._step("embed", embed)
        self.embed[p.size] = 0


STATE = pa.schema([("part", pa.int64()), ("seen", pa.int64()), ("flat", pa.binary())])


def _descend(batches: Iterator[pa.RecordBatch], shared, p: Params) -> Iterator[pa.RecordBatch]:
    """Parameters after one pass over the tokens of a group."""
    vocabulary, flat = shared.value
    net, seen = Network(p, vocabulary, flat.copy()), 0
    near: list[np.ndarray] = []
    want: list[np.ndarray] = []

    def train(last: bool) -> None:
        nonlocal near, want
        if not want:
            return
        x, y = np.concatenate(near, axis=1), np.concatenate(want)
        stop = len(y) if last else len(y) - len(y) % p.batch
        for a in range(0, stop, p.batch):
            net.learn(x[:, a : min(a + p.batch, stop)], y[a : min(a + p.batch, stop)])
        near, want = [x[:, stop:]], [y[stop:]]

    for b in small(batches):
        word, bounds = words(strings(b.column("text")))
        ids = net.ids(word)
        near.append(net.around(ids, bounds)), want.append(ids)
        seen += len(ids)
        train(False)
    train(True)
    if seen:
        yield from emit(STATE, {"part": [TaskContext.get().partitionId()], "seen": [seen], "flat": [net.flat.tobytes()]})


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")  # sums in one order
    total, flat = int(rows.seen.sum()), 0.0
    for n, x in zip(rows.seen, rows.flat, strict=True):
        flat = flat + np.frombuffer(x, np.float32).astype(float) * (n / total)
    return pd.DataFrame({"part": [rows.part.iloc[0]], "seen": [total], "flat": [flat.astype(np.float32).tobytes()]})


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Vocabulary, parameters and word counts, learnt from the whole of ``docs`` (column text; doc_id, if there, spreads copies over groups).

    Null and empty texts teach nothing; ties in the vocabulary go by the
    word's hash; an empty table gives a model in which every word is unseen.
    """
    counts, kinds = cut_counting(in_arrow(docs.select("text"), _count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(p.size - p.hashed + p.often).collect()
    top, next_ = top[: p.size - p.hashed], sorted((r.word, r.n) for r in top[p.size - p.hashed :])
    vocabulary = np.array([r.word for r in top], np.int64).view(U64)
    count = np.zeros(p.size)
    count[: len(top)] = [r.n for r in top]
    n, of = np.zeros(p.hashed), np.zeros(p.hashed)
    for x in in_arrow(counts, lambda it: _totals(it, p), "bucket long, n long, kinds long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        n[x.bucket], of[x.bucket] = x.n, x.kinds
    known = _buckets(vocabulary, p)
    n -= np.bincount(known, weights=count[: len(top)], minlength=p.hashed)
    of -= np.bincount(known, minlength=p.hashed)
    count[-p.hashed :] = n
    unseen = -np.log(n + of + 1)
    flat = Network.fresh(p, vocabulary, count).flat
    sc = docs.sparkSession.sparkContext
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // max(1, p.rounds * p.group_tokens)))
    key = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    dealt = docs.select("text", key.alias("key"), F.pmod(F.xxhash64(F.lit(p.seed), key), F.lit(max(1, p.rounds))).alias("turn"))
    for turn in range(p.rounds):
        shared = sc.broadcast((vocabulary, flat))
        own = dealt.where(F.col("turn") == turn).repartition(groups, "key").sortWithinPartitions("key").select("text")
        states = in_arrow(own, lambda it, shared=shared: _descend(it, shared, p), "part long, seen long, flat binary")
        step = max(1, math.isqrt(groups))
        means = states.groupBy((F.col("part") % step).alias("g")).applyInPandas(lambda x: _average(x), "part long, seen long, flat binary").collect()
        if means:
            flat = np.frombuffer(_average(pd.DataFrame({"part": [m.part for m in means], "seen": [m.seen for m in means], "flat": [bytes(m.flat) for m in means]})).flat[0], np.float32)
    return Model(vocabulary, flat, unseen, np.array([w for w, _ in next_], np.int64), np.log1p(np.array([n for _, n in next_], float)), counts, kinds)


SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob, perplexity of each row (columns doc_id and text; others are ignored).

    A null text, or one without a word, has no token: log_prob is 0, the mean
    and the perplexity are null. A text of any length is scored whole. Repeated
    rows are scored each, alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.flat, model.unseen, model.often, model.often_log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat, unseen, often, often_log = shared.value
        net, first = Network(p, vocabulary, flat), p.size - p.hashed
        for b in small(batches):
            word, bounds = words(strings(b.column("text")))
            ids = net.ids(word)
            hashed = np.flatnonzero(ids >= first)
            each = net.log_prob(ids, bounds)
            each[hashed] += unseen[ids[hashed] - first]
            if len(often):
                at = np.minimum(np.searchsorted(often, signed(word[hashed])), len(often) - 1)
                has = often[at] == signed(word[hashed])
                each[hashed[has]] += often_log[at[has]]
                hashed = hashed[~has]
            total = np.concatenate([[0.0], np.cumsum(each)])
            n = np.diff(bounds)
            sums = np.where(n > 0, total[bounds[1:]] - total[bounds[:-1]], 0.0)
            # the other words with hashed ids, once for each text, for what their counts add
            text = np.repeat(np.arange(len(n)), n)[hashed]
            order = np.lexsort((word[hashed], text))
            text, other = text[order], word[hashed][order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (other[1:] != other[:-1])
            begin = np.flatnonzero(new)
            ends = np.searchsorted(text[begin], np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (signed(other[begin]), np.diff(begin, append=len(text)).astype(np.int32))]
            yield from emit(SCORES, {"doc_id": b.column("doc_id"), "n_tokens": n, "log_prob": sums, "words": lists[0], "times": lists[1]})

    rows = in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, log_prob double, words array<long>, times array<int>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    held = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), "x.times")
    more = held.join(limited(model.counts, model.kinds, p.broadcast_rows), "word").groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n") + 1.0)).alias("more"))
    sums = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    rows = rows.drop("words", "times").join(more, "row", "left").select("doc_id", "n_tokens", sums.alias("log_prob"))
    return rows.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))
