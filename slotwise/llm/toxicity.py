"""Toxicity of texts that may be disguised: a noisy channel restores words that
are written in leetspeak, spaced out or stretched, and a linear model over the
words of the restored text, learned from labels, scores it.

The channel is a lattice: each written character may stand for itself or for
the letters that it looks like, a separator inside a word may be nothing or the
end of a word, so may the blank between short pieces, and a stretched letter
may stand for one or two. Viterbi decoding picks the most likely path under a
character trigram model, counted over all documents. The model's weights are
log ratios of how often a word, or a beginning of words, occurs in toxic and in
other documents; every other word has one small negative weight. A text's
strength is the sum over its distinct words. The negative weight is chosen, and
the strength calibrated by isotonic regression, on documents that the weights
have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import labelled
from slotwise.llm.common import added, blocks_of, documents

#: Letters that a written character may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz"}
SELF, LOOK, DROP, END = math.log(0.9), math.log(0.05), math.log(0.02), math.log(0.02)
GAP = math.log(0.5)  # a blank between short pieces: the end of a word, or nothing
LETTERS = 60  # codes: 0 none, 1-26 a to z, 27-58 U+00E0 to U+00FF, 59 other letters
PREFIXES = (4, 5, 6, 7)
LEAST_RATIO = 4.0  # a unit's share of toxic documents to its share of others, at least
LEAST_TOXIC = 3  # toxic documents that a unit of the lexicon occurs in, at least
NEUTRAL = (0.0, 0.01, 0.02, 0.035, 0.05, 0.075, 0.1)  # what a word without a weight may take away
KEPT = 300_000  # tokens whose words a task keeps before it starts anew
SHORT = 4  # characters of a token that belongs to a spaced-out word beside single ones, at most
STRETCHED = re.compile(r"(.)\1\1")
TRAILING = ".,;:?\"'”’»)]}…"
EDGES = "".join(chr(i) for i in range(128) if not chr(i).isalnum()) + "¿¡«»“”„’‘…–—"

_CODES = np.zeros(0x250, np.uint8)
_CODES[97:123] = np.arange(1, 27)
_CODES[0xE0:0x100] = np.arange(27, 59)
_CODES[0xF7] = 0


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 59).astype(np.int64)


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents, words set off by code 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                c = np.concatenate([[0, 0], codes(text.as_py()), [0]])
                np.add.at(total, (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], 1)
        yield blocks_of(total.reshape(LETTERS, -1))

    blocks = added(docs.select("text").mapInArrow(count, "block int, values binary"))
    return np.array([blocks[i] for i in range(LETTERS)]).reshape((LETTERS,) * 3) if blocks else np.zeros((LETTERS,) * 3)


def language_model(count: np.ndarray) -> np.ndarray:
    """Log probability of a letter after two others, the trigram shares backed
    off to bigrams and single letters; spaces after spaces don't count."""
    count = count.copy()
    count[:, 0, 0] = 0
    single = (count.sum((0, 1)) + 1) / (count.sum() + LETTERS)
    pair = count.sum(0)
    pair = (pair + 20 * single) / (pair.sum(-1, keepdims=True) + 20)
    return np.log((count + 20 * pair[None]) / (count.sum(-1, keepdims=True) + 20))


def _code(c: str) -> int:
    point = ord(c)
    return int(_CODES[point]) if point < len(_CODES) else 59


def restore(written: str, model: list) -> str:
    """The likeliest words behind what is written, by Viterbi decoding of its
    lattice in time linear in its length; the states are the last two letters,
    the second one 0 after the end of a word. Blanks in it are gaps between
    the pieces of a spaced-out word, or between words."""
    paths: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(0, 0): (0.0, None, "")}
    for c, run in groupby(written):
        n = len(list(run))
        # what the run stands for as codes and letters, and the channel's log probability
        options: list[tuple[tuple[int, ...], str, float]] = []
        if c == " ":
            options = [((), "", GAP), ((0,), " ", GAP)]
        else:
            for x, p in [(c, SELF)] if c.isalpha() else [(x, LOOK) for x in LOOKS.get(c, "")]:
                k_code = _code(x)
                options += [((k_code,) * k, x * k, p if k == n else p + DROP) for k in ((n,) if n < 3 else (1, 2))]
            if not c.isalnum():
                options += [((), "", DROP), ((0,), " ", END)]
        if not options:  # a digit that looks like no letter
            continue
        after: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
        for (a, b), path in paths.items():
            for letters, text, p in options:
                s, u, v = path[0] + p, a, b
                if letters == (0,):
                    if b:  # words end once; what follows starts anew
                        s, u, v = s + model[u][v][0], 0, 0
                else:
                    for x in letters:
                        s, u, v = s + model[u][v][x], v, x
                held = after.get((u, v))
                if held is None or s > held[0]:
                    after[u, v] = (s, path, text)
        paths = after
    best = max(((path[0] + (model[a][b][0] if b else 0.0), path) for (a, b), path in paths.items()), key=lambda e: e[0])[1]
    out = []
    while best[1] is not None:
        out.append(best[2])
        best = best[1]
    return "".join(reversed(out))


def readings(token: str, model: list) -> set[str]:
    """The word of a lower-case token as it stands and, if it holds anything
    but letters, or stretched ones, the words that it restores to. Blanks in a
    token part the pieces of a spaced-out run."""
    if token.isalpha():
        return {token, *restore(token, model).split()} if STRETCHED.search(token) else {token}
    found = {token.strip(EDGES)} if " " not in token else set()
    whole = token.rstrip(TRAILING)
    if any(c.isalpha() for c in whole) and not whole.isalpha() or sum(c in LOOKS for c in whole) > 2:
        found.update(restore(whole, model).split())
    return found - {""}


def tokens(text: str) -> set[str]:
    """The distinct tokens of a lower-cased text; each run of single characters,
    with short tokens beside it, is one more token, with its blanks."""
    parts = text.lower().split()
    lengths = bytes(min(len(p), 255) for p in parts)
    found = set(parts)
    if b"\x01\x01" in lengths:
        for run in re.finditer(rb"\x01{2,}", lengths):
            a, b = run.span()
            # the last letter may carry a comma or a point; a word of one letter may stand at either end
            low, high = a - (a > 0 and lengths[a - 1] <= SHORT), b + (b < len(parts) and lengths[b] <= SHORT)
            for c, d in {(low, high), (a, high), (a + 1, high), (low, b), (low, b - 1)}:
                if d - c > 2 and any(p.isalnum() for p in parts[c:d]):
                    found.add(" ".join(parts[c:d]))
    return found


def units(word: str) -> list[str]:
    """What the lexicon knows of a word: itself, and its beginnings."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def _units_of(text: str, model: list) -> set[str]:
    return {u for t in tokens(text) for w in readings(t, model) for u in units(w)}


class Lexicon:
    """The weight of each unit, and the calibration of a text's strength."""

    def __init__(self, model: np.ndarray, strength: dict[str, float], steps: np.ndarray | None, neutral: float = 0.0):
        self.model, self.strength, self.steps, self.neutral = model, strength, steps, neutral
        self.rows = model.tolist()
        self.kept: dict[str, tuple[tuple[str, float], ...]] = {}
        self.heads = {u[: PREFIXES[0]] for u in strength}

    def of_token(self, token: str) -> tuple[tuple[str, float], ...]:
        """The words behind a token that have a weight: that of their strongest unit."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        likely = (w for w in readings(token, self.rows) if w[: PREFIXES[0]] in self.heads)
        known = ((w, max(self.strength.get(u, 0.0) for u in units(w))) for w in likely)
        found = self.kept[token] = tuple((w, s) for w, s in known if s > 0)
        return found

    def of_text(self, text: str) -> tuple[float, int]:
        """The sum of the weights of a text's words, and its distinct tokens."""
        kept, words = self.kept, {}
        every = tokens(text)
        for t in every:
            found = kept.get(t)
            if found is None:
                found = self.of_token(t)
            words.update(found)
        return sum(words.values()), len(every)

    def __getstate__(self):
        return self.model, self.strength, self.steps, self.neutral

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str) -> float:
        if self.steps is None:
            return 0.5
        weight, n = self.of_text(text)
        at = place(weight - self.neutral * n)
        return float(0.999 * self.steps[at] + 0.001 * at / labelled.BINS)


def place(strength: float) -> int:
    """Calibration bin of a strength, in steps of its logarithm on either side."""
    share = math.copysign(math.log1p(abs(strength)) / math.log1p(1000), strength)
    return int(min(max(0.5 + share / 2, 0.0), 0.999) * labelled.BINS)


def ranking(n: np.ndarray, positive: np.ndarray) -> float:
    """Share of pairs of a positive and another one that the bins order rightly."""
    below = np.cumsum(n - positive) - (n - positive) / 2
    return float((positive * below).sum() / max(positive.sum() * (n.sum() - positive.sum()), 1))


def _counts(rows: DataFrame, pick) -> DataFrame:
    """unit, toxic, rest: documents of each kind that a unit occurs in, added
    up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                both[y >= 0.5].update(pick(text.as_py()))
        names = list(both[0] | both[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[u] for u in names], pa.int64()) for c in both[::-1])], ["unit", "toxic", "rest"])

    return rows.select("text", "y").mapInArrow(run, "unit string, toxic long, rest long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("rest").alias("rest"))


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon learned from a bounded sample of the labelled documents
    outside the held-out fold; without labels of both kinds it has none."""
    context = docs.sparkSession.sparkContext
    rows = documents(docs)
    model = language_model(trigrams(rows))
    shared = context.broadcast(model.tolist())
    chosen = labelled.sample(labels, "toxic")
    known = rows.join(F.broadcast(chosen), "doc_id")  # of bounded size
    learn, tune = known.where("fold < 4"), known.where("fold = 4")
    kinds = {r["y"] >= 0.5: r["n"] for r in chosen.where("fold < 4").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return Lexicon(model, {}, None)
    found = _counts(learn.where("y >= 0.5"), lambda t: _units_of(t, shared.value)).where(F.col("toxic") >= LEAST_TOXIC)  # of the bounded sample
    toxic = {r["unit"]: r["toxic"] for r in found.collect()}
    wanted = context.broadcast(frozenset(toxic))
    rest = {r["unit"]: r["rest"] for r in _counts(learn.where("y < 0.5"), lambda t: wanted.value & _units_of(t, shared.value)).collect()}
    t, n = kinds[True], kinds[False]
    strength = {}
    for u, k in toxic.items():
        # log ratio of the two shares, the toxic one taken a standard error low
        s = math.log((k - math.sqrt(k) / 2 + 0.5) / (t + 1)) - math.log((rest.get(u, 0) + 0.5) / (n + 1))
        if s >= math.log(LEAST_RATIO):
            strength[u] = s
    lexicon = Lexicon(model, strength, None)
    used = context.broadcast(lexicon)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * len(NEUTRAL), labelled.BINS))
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                weight, n = used.value.of_text(text.as_py())
                for i, c in enumerate(NEUTRAL):
                    at = place(weight - c * n)
                    total[2 * i, at] += 1
                    total[2 * i + 1, at] += y
        yield blocks_of(total)

    tuned = added(tune.select("text", "y").mapInArrow(bins, "block int, values binary"))
    if tuned and tuned[0].sum():
        best = max(range(len(NEUTRAL)), key=lambda i: ranking(tuned[2 * i], tuned[2 * i + 1]))
        lexicon.neutral, lexicon.steps = NEUTRAL[best], labelled.isotonic(tuned[2 * best], tuned[2 * best + 1])
    else:
        lexicon.steps = np.linspace(0, 1, labelled.BINS)
    return lexicon


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document.

    Null and empty texts have no words and so the lowest score; very long ones
    are read whole; repeated rows are scored alike; a null doc_id is not held
    out; further columns, whatever their names, play no part. Without labels of
    both kinds every score is 0.5. An empty table gives no rows.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [lexicon.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
