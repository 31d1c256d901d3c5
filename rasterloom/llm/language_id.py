"""Language identification by cross-parsing entropy.

A suffix automaton for each language, built over labelled text, gives the
longest match at every place of a text. Parsing a text greedily into longest
matches costs a number of phrases; the language whose automaton needs the
fewest, normalised by the length of its training text, wins.

Learning takes a bounded sample of labelled rows (``rows`` and ``chars`` for
each language). Texts to be judged are parsed whole, however long, in lanes of
``LANE`` characters so that many are stepped at once. A phrase ends at the end
of a lane, in each language alike: at most one phrase more in ``LANE`` characters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import codepoints, emit, held, in_arrow, small, strings

LANE = 512
PHRASE = 1 << 28  # transitions count the phrases they end in the bits from here on
SPACE, OTHER = 0, 1

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, phrases_per_letter double"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("phrases_per_letter", pa.float64())])

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point to its lower-case code point if it is a letter, else 0."""
    global _letters
    if _letters is None:
        out = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            if (c := chr(i)).isalpha():
                out[i] = ord(low) if len(low := c.lower()) == 1 else i
        _letters = out
    return _letters


def normalised(text: str) -> str:
    """Letters lower-cased, all else as single spaces."""
    code = _letter_table()[codepoints([text])[0]]
    code[code == 0] = 32
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    return code[keep].tobytes().decode("utf-32-le")


def automaton(text: str) -> tuple[list[dict], list[int]]:
    """Suffix automaton: transitions of each state, state 0 first."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step, length


class Table:
    """Transitions of one automaton: a flat table if it is small enough, else sorted edges, so that memory grows with the text and not with the alphabet."""

    def __init__(self, text: str, index: dict[str, int], cells: int) -> None:
        step, _ = automaton(text)
        own = sorted({index[c] for c in set(text)})
        self.local = np.zeros(max(index.values(), default=0) + 3, np.int32)  # symbols that the text doesn't have are 0
        self.local[own] = np.arange(1, len(own) + 1)
        self.width = len(own) + 1
        # what has no transition: a phrase ends, and the next one begins with this symbol, or after it if it is in no phrase
        root = np.zeros(self.width, np.int32)
        for c, to in step[0].items():
            root[self.local[index[c]]] = to
        assert len(step) < PHRASE  # the text is of bounded length
        self.first, self.restart = np.where(root > 0, root, PHRASE).astype(np.int32), np.where(root > 0, root | PHRASE, 2 * PHRASE).astype(np.int32)
        edges = [(s * self.width + int(self.local[index[c]]), to) for s, out in enumerate(step) if s for c, to in out.items()]
        if len(step) * self.width <= cells:
            self.flat = np.tile(self.restart, (len(step), 1))
            self.flat[0] = self.first
            self.flat = self.flat.ravel()
            self.flat[[at for at, _ in edges]] = [to for _, to in edges]
        else:
            self.flat = None
            edges.sort()
            self.at, self.to = (np.array(x, kind) for x, kind in zip(zip(*edges, strict=True), (np.int64, np.int32), strict=True))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states, with the phrases that end in the bits from PHRASE on."""
        if self.flat is not None:
            return self.flat[state * np.int32(self.width) + symbol]
        key = state * np.int64(self.width) + symbol
        at = np.minimum(np.searchsorted(self.at, key), len(self.at) - 1)
        return np.where(state == 0, self.first[symbol], np.where(self.at[at] == key, self.to[at], self.restart[symbol]))


class Model:
    """Automata of all languages, made once in a worker."""

    def __init__(self, texts: dict[str, str], cells: int = 1 << 23) -> None:
        self.langs = sorted(texts)
        letters = sorted(set("".join(texts.values())) - {" "})
        low = _letter_table()
        self.symbol = np.where(low > 0, OTHER, SPACE).astype(np.int32)
        index = {c: i + 2 for i, c in enumerate(letters)} | {" ": SPACE}
        for c, i in index.items():
            if c != " ":
                self.symbol[ord(c)] = i
        upper = np.flatnonzero((low > 0) & (low != np.arange(len(low))))
        self.symbol[upper] = self.symbol[low[upper]]
        self.tables = [Table(texts[x], index, cells) for x in self.langs]
        self.size = len(letters) + 2
        self.bits = [np.log2(max(2, len(texts[x]))) for x in self.langs]

    @classmethod
    def of(cls, texts: dict[str, str]) -> Model:
        return held(tuple(sorted((k, len(v), hash(v)) for k, v in texts.items())), lambda: cls(texts))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, and by text how many letters, and how many symbols there are."""
        code, ends = codepoints(texts)
        sym = self.symbol[code]
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != SPACE) | (sym[:-1] != SPACE)
        total = np.zeros(len(sym) + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        letters = np.zeros(len(sym) + 1, np.int64)
        np.cumsum(sym != SPACE, out=letters[1:])
        sym, bounds = sym[keep].astype(np.int32), total[ends]
        count = np.diff(bounds)
        lanes = -(-count // LANE)
        text = np.repeat(np.arange(len(texts)), lanes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = bounds[:-1][text] + place * LANE
        length = np.minimum(LANE, bounds[1:][text] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, text = begin[order], length[order], text[order]
        active = np.searchsorted(-length, -np.arange(LANE), "left")  # lanes longer than the step
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, table in enumerate(self.tables):
            own = table.local[sym]
            state, found = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
            for t in range(LANE):
                m = active[t]
                if not m:
                    break
                to = table.step(state[:m], own[begin[:m] + t])
                found[:m] += to >> 28
                state[:m] = to & np.int32(PHRASE - 1)
            out[:, k] = np.bincount(text, weights=found + (state > 0), minlength=len(texts))
        return out, np.diff(letters[ends]), count

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases for each letter of each text."""
        n, letters, _ = self.phrases(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        cost = n * np.array(self.bits)
        best = cost.argmin(1)  # ties go to the first language by name
        least = cost.min(1)
        cost[np.arange(len(texts)), best] = np.inf
        second = cost.min(1)
        known = letters > 0
        score = np.where(known, np.where(np.isinf(second), 1.0, 1.0 - least / np.where(second > 0, second, 1.0)), 0.0)
        rate = np.where(known, n[np.arange(len(texts)), best] / np.maximum(letters, 1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.clip(score, 0.0, 1.0), rate


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learnt from: rows and characters for each language; longer texts are taken only where shorter ones are too few."""

    rows: int = 96
    chars: int = 60_000
    longest: int = 10_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, bound: Sample = Sample()) -> dict[str, str]:
    """Training text of each language, from a bounded sample of labelled rows that aren't held out.

    The driver gets a count for each label and ``bound.rows`` texts for each at
    most. Rows with a null doc_id, lang or text teach nothing; a table without
    labelled rows gives no language. A very long text is taken up to ``chars``.
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * bound.rows / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    few = rows.where(draw < share).select("lang", "text", (F.length("text") > bound.longest).alias("long"), F.xxhash64("doc_id", "text").alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))
    out: dict[str, str] = {}
    for r in few.withColumn("place", place).where(F.col("place") <= bound.rows).orderBy("lang", "place").select("lang", "text").toLocalIterator():
        have = out.get(r.lang, "")
        if len(have) < bound.chars:
            out[r.lang] = (have + " " + normalised(r.text))[: bound.chars]
    return {k: v for k, v in out.items() if v.strip()}


def identify(docs: DataFrame, model: dict[str, str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrases_per_letter for each row (columns doc_id and text; others are ignored).

    A null text or one without a letter is ``und`` with score 0. A script that
    no training text has costs a phrase a letter and still gets the cheapest
    language; of equal costs the first language by name is taken, with score 0.
    Score is 1 less the ratio of the cheapest to the next cost. A text of any
    length is parsed whole. Without any learnt language all texts are ``und``.
    Repeated rows are judged each; a null doc_id isn't held out; an empty table
    gives an empty result. One narrow pass; the model is of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            lang, score, rate = Model.of(shared.value).predict(strings(b.column("text")))
            yield from emit(ARROW, {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": lang, "score": score, "phrases_per_letter": rate})

    return in_arrow(docs.select("doc_id", "text", held_out().alias("held_out")), run, SCHEMA)


def keep_known(docs: DataFrame, model: dict[str, str], most: float = 0.9) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a letter and is in a script that some language has.

    A text that needs more than ``most`` phrases for each letter matches nothing
    learnt. Null and empty texts go; repeated rows are judged each, alike. With
    no learnt language nothing can be rejected for it, and only texts without a
    letter go. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            lang, _, rate = Model.of(shared.value).predict(strings(b.column("text")))
            has = lang if shared.value else ["" if any(map(str.isalpha, t)) else "und" for t in strings(b.column("text"))]
            yield b.filter(pa.array([x != "und" and r <= most for x, r in zip(has, rate, strict=True)], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
