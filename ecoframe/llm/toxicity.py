"""Toxicity by a string-kernel support vector machine over sentences, with Nyström landmarks.

Kernel. A word is known by its character subsequences of length `LENGTH` within `SPAN` places, its ends marked; each left-out
character costs a factor `DECAY`. Two words have the cosine of these weights, squared, as their kernel, so `idiiot`, `id*ot` and
a stem with a new ending stay close to what they come from, and letters written apart (`i d i o t`) are first put together. The
kernel of two sentences is the sum over pairs of their distinct words.

Landmarks. Words of the training sample that are in more toxic documents than clean ones would give (and the most common clean
ones), most telling first, leaving out those that a chosen landmark already stands for. A word's features are its kernels with
the landmarks, times the inverse root of the landmarks' own kernel matrix (Nyström), so the machine is a linear one.

Training. Labels belong to documents, toxicity to some of their sentences. A document is as toxic as its most toxic sentence: in
each of `ROUNDS` rounds every sampled document names that sentence under the present machine, and the machine is fitted to these
labelled sentences (squared hinge, Newton steps), clean ones of earlier rounds included. A sigmoid over the sample turns the
largest sentence score into the probability that the label is 1.

Bounds. Fitting uses at most `SAMPLE` training documents, those with the least hash of their id; word counts over them are summed
by Spark, and the driver sees the `CANDIDATES` leading words and one sentence vector a document. Scoring reads every whole text.

Defined results: held_out is crc32(id as text) mod 5 = 0, a null id counts as the empty text; null and empty texts have one empty
sentence and get its score; an id with several label rows is toxic if one says so; texts with one id are each scored on their
own; with no labels of both kinds every score is the smoothed share of toxic labels; equal texts have equal scores; an empty table
gives no rows; other columns are not read. A sentence ends at a line end or after a full stop, question or exclamation mark that
follows two letters, and after `WORDS` words; words over `LETTERS` characters go on as further words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoframe.llm.common import cut

LENGTH, SPAN, DECAY = 4, 6, 0.6
SAMPLE, CANDIDATES, LANDMARKS, CLEAN_LANDMARKS, ROUNDS = 8_000, 3_000, 160, 32, 3
#: A word is left out where a chosen landmark has this kernel with it.
NEAR = 0.45
WORDS, LETTERS = 40, 48
#: Words that a task remembers; then it starts anew.
KNOWN = 200_000
FOLDS = 5
#: Words at a time (under 2**20), and bits of the table of known subsequences.
BLOCK, TABLE = 4096, 20
_PLACES = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]
_WEIGHTS = DECAY ** np.arange(4.0)
_OTHER = re.compile(r"[^\w\s.!?]+|_+")
_SENTENCE = re.compile(r"(?<=\w\w)[.!?]+\s+|\n+")
_APART = re.compile(r"(?<!\S)(?:\w\s+){2,}\w(?!\S)")


def sentences(text: str | None) -> list[list[str]]:
    """Distinct words of each sentence, in lower case, letters and digits only."""
    out = []
    for part in _SENTENCE.split(_OTHER.sub("", (text or "").lower())):
        part = _APART.sub(lambda m: "".join(m.group().split()), part.replace(".", "").replace("!", "").replace("?", ""))
        words = part.split()
        for a in range(0, len(words), WORDS):
            piece = dict.fromkeys(words[a:a + WORDS])
            if max(map(len, piece)) > LETTERS:
                piece = dict.fromkeys(w[k:k + LETTERS] for w in piece for k in range(0, len(w), LETTERS))
            out.append(list(piece))
    return out or [[]]


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, characters left out) of every occurrence, and the length of each word's vector of weights.

    A subsequence is the lower 16 bits of each of its characters. Occurrences of one subsequence in a word are brought together
    by one sort of (word, 42 bits of a hash, characters left out); words come a few thousand at a time.
    """
    text = "".join(f"\x02{w}\x03" for w in words)
    letters = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 0xFFFF).astype(np.uint64)
    of = np.repeat(np.arange(len(words), dtype=np.uint64), [len(w) + 2 for w in words])
    who, what, gap = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for places in _PLACES:
        n = len(letters) - places[-1]
        if n <= 0:
            continue
        code = letters[:n]
        for p in places[1:]:
            code = code << np.uint64(16) | letters[p:p + n]
        inside = of[:n] == of[places[-1]:]
        who.append(of[:n][inside])
        what.append(code[inside])
        gap.append(np.full(len(who[-1]), places[-1] + 1 - LENGTH, np.uint64))
    who, what, gap = np.concatenate(who), np.concatenate(what), np.concatenate(gap)
    key = np.sort(who << np.uint64(44) | (_scattered(what) >> np.uint64(22)) << np.uint64(2) | gap)
    first = np.flatnonzero(np.concatenate(([True], key[1:] >> np.uint64(2) != key[:-1] >> np.uint64(2)))[:len(key)])
    sums = np.add.reduceat(_WEIGHTS[(key & np.uint64(3)).astype(np.intp)], first) if len(first) else np.zeros(0)
    return who.astype(np.intp), what, gap.astype(np.intp), np.sqrt(np.bincount((key[first] >> np.uint64(44)).astype(np.intp), sums * sums, len(words)))


@dataclass(frozen=True)
class Landmarks:
    """`known` subsequences in order, where each begins in (mark, weight), and a table that tells most others apart at once."""

    words: list[str]
    known: np.ndarray = field(repr=False)
    begin: np.ndarray = field(repr=False)
    mark: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)
    table: np.ndarray = field(repr=False)

    @staticmethod
    def of(words: list[str]) -> Landmarks:
        mark, what, gap, size = subsequences(words)
        order = np.argsort(what, kind="stable")
        known, begin = np.unique(what[order], return_index=True)
        table = np.zeros(1 << TABLE, bool)
        table[_scattered(known) >> np.uint64(64 - TABLE)] = True
        weight = _WEIGHTS[gap] / size[mark]
        return Landmarks(words, known, np.append(begin, len(what)), mark[order], weight[order], table)

    def kernels(self, words: list[str]) -> np.ndarray:
        """One row per word: its kernel with each landmark."""
        out = np.zeros((len(words), len(self.words)))
        for a in range(0, len(words), BLOCK):
            some = words[a:a + BLOCK]
            who, what, gap, length = subsequences(some)
            met = np.flatnonzero(self.table[_scattered(what) >> np.uint64(64 - TABLE)])
            if not len(met):
                continue
            at = np.minimum(np.searchsorted(self.known, what[met]), len(self.known) - 1)
            true = self.known[at] == what[met]
            at, met = at[true], met[true]
            size = self.begin[at + 1] - self.begin[at]
            place = np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat(who[met], size) * len(self.words) + self.mark[place]
            part = np.bincount(cell, np.repeat(_WEIGHTS[gap[met]], size) * self.weight[place], len(some) * len(self.words))
            out[a:a + BLOCK] = part.reshape(len(some), -1) / np.maximum(length, 1e-9)[:, None]
        return out ** 2


@dataclass(frozen=True)
class Machine:
    """Score of a sentence: bias + the sum over its words of kernels · beta. slope and shift: the sigmoid; prior: no landmarks."""

    landmarks: Landmarks
    beta: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float | None = None


class Scorer:
    """Scores of the words that a task has met."""

    def __init__(self, machine: Machine):
        self.machine, self.ids, self.scores = machine, {}, np.zeros(0)

    def documents(self, texts) -> tuple[np.ndarray, list[list[str]]]:
        """The largest sentence score of each text, and that sentence."""
        if len(self.ids) > KNOWN:
            self.ids, self.scores = {}, np.zeros(0)
        ids, spoken, flat, sizes, counts = self.ids, [], [], [], []
        for text in texts:
            parts = sentences(text)
            spoken += parts
            counts.append(len(parts))
            for words in parts:
                sizes.append(len(words))
                flat += [ids.setdefault(w, len(ids)) for w in words]
        new = list(ids)[len(self.scores):]
        fresh = [self.machine.landmarks.kernels(new[a:a + BLOCK]) @ self.machine.beta for a in range(0, len(new), BLOCK)]
        self.scores = np.concatenate([self.scores, *fresh])
        upto = np.concatenate(([0.0], np.cumsum(self.scores[np.array(flat, int)])))
        end = np.cumsum(sizes)
        score = upto[end] - upto[end - np.array(sizes)] + self.machine.bias
        begin = np.cumsum(counts) - counts
        best = np.maximum.reduceat(score, begin) if len(begin) else np.zeros(0)
        return best, [spoken[a + int(np.argmax(score[a:a + n]))] for a, n in zip(begin, counts)]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most `most` labelled ids that are not held out."""
    usable = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("id"), "toxic")
    ids = usable.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")).join(
        docs.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id", "left_semi")
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    # One text per id, so that an id that very many rows share doesn't fill the sample.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("id"))
    return rows.groupBy("id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(F.col("id").alias("doc_id"), "text", "toxic")


def candidates(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words most over-represented in toxic documents, and those in most clean ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(x["text"], x["toxic"]):
                for w in {w for words in sentences(text) for w in words}:
                    counts.setdefault(w, [0, 0])[toxic == 1] += 1
            yield pd.DataFrame([(w, *n) for w, n in counts.items()], columns=["word", "clean", "toxic"])

    counts = rows.select("text", "toxic").mapInPandas(run, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
    of = rows.agg(F.sum((F.col("toxic") == 1).cast("double")), F.sum((F.col("toxic") != 1).cast("double"))).first()
    expected = F.col("clean") * ((of[0] + 1) / (of[1] + 1))
    lead = (F.col("toxic") - expected) / F.sqrt(F.col("toxic") + expected + 1)
    telling = counts.filter(lead > 1).orderBy(lead.desc(), "word").limit(CANDIDATES).select("word").collect()
    common = counts.filter(lead <= 1).orderBy(F.col("clean").desc(), "word").limit(CLEAN_LANDMARKS).select("word").collect()
    return [r[0] for r in telling], [r[0] for r in common]


def spread(words: list[str], most: int) -> list[str]:
    """The first words that no earlier chosen one stands for."""
    own = Landmarks.of(words)
    chosen: list[int] = []
    for a in range(0, len(words), 256):
        near = own.kernels(words[a:a + 256])
        for i in range(a, min(a + 256, len(words))):
            if len(chosen) < most and not (near[i - a, chosen] > NEAR).any():
                chosen.append(i)
    return [words[i] for i in chosen]


def fitted(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias with the least squared hinge loss, both classes equally heavy (Newton steps with a line search)."""
    x = np.column_stack((x, np.ones(len(x))))
    pull = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * len(y)
    keep = np.append(np.ones(x.shape[1] - 1), 1e-3)
    loss = lambda w: keep @ (w * w) / 2 + pull @ np.maximum(0, 1 - y * (x @ w)) ** 2
    w = np.zeros(x.shape[1])
    for _ in range(50):
        out = y * (x @ w) < 1
        xa, pa = x[out], pull[out]
        slope = keep * w - 2 * xa.T @ (pa * (y[out] - xa @ w))
        step = np.linalg.solve(np.diag(keep) + 2 * (xa.T * pa) @ xa, slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * (slope @ step):
            size /= 2
        w = w - size * step
        if slope @ step < 1e-9 * max(1.0, now):
            break
    return w[:-1], float(w[-1])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def calibrated(score: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid, by Newton steps on smoothed labels."""
    n, m = toxic.sum(), (~toxic).sum()
    goal = np.where(toxic, (n + 1) / (n + 2), 1 / (m + 2))
    x, w = np.column_stack((score, np.ones(len(score)))), np.array([1.0, 0.0])
    loss = lambda w: np.sum(np.logaddexp(0, x @ w) - goal * (x @ w)) + 1e-3 * w[0] ** 2
    for _ in range(100):
        p = sigmoid(x @ w)
        slope = x.T @ (p - goal) + [2e-3 * w[0], 0]
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag([2e-3, 1e-9]), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def witnesses(rows: DataFrame, machine: Machine) -> pd.DataFrame:
    """The most toxic sentence of each sampled document: score and kernels with the landmarks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(machine)
        for x in batches:
            score, words = scorer.documents(x["text"])
            sums = [machine.landmarks.kernels(w).sum(axis=0).astype(np.float32).tobytes() for w in words]
            yield pd.DataFrame({"doc_id": x["doc_id"], "toxic": x["toxic"], "score": score, "sums": sums})

    found = rows.mapInPandas(run, "doc_id long, toxic int, score double, sums binary")
    return found.toPandas().sort_values("doc_id", ignore_index=True)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine:
    rows = cut(sample(docs, labels, most).withColumn("toxic", F.col("toxic").cast("int")))
    toxic, clean = rows.filter("toxic = 1").count(), rows.filter("toxic <> 1").count()
    prior = (toxic + 1) / (toxic + clean + 2) if toxic else 0.0
    telling, common = candidates(rows) if toxic and clean else ([], [])
    leading = spread(telling, LANDMARKS)
    if not leading:
        return Machine(Landmarks.of([]), np.zeros(0), 0.0, prior=prior)
    landmarks = Landmarks.of(leading + [w for w in common if w not in leading])
    value, side = np.linalg.eigh(landmarks.kernels(landmarks.words))
    root = side / np.sqrt(np.maximum(value, 1e-6))
    machine = Machine(landmarks, np.r_[np.ones(len(leading)), np.zeros(len(landmarks.words) - len(leading))], -0.5)
    earlier, slope, shift = [], 1.0, 0.0
    for _ in range(ROUNDS):
        found = witnesses(rows, machine)
        y = np.where(found["toxic"] == 1, 1.0, -1.0)
        x = np.stack([np.frombuffer(b, np.float32) for b in found["sums"]]).astype(float) @ root
        earlier.append(x[y < 0])
        x, y = np.concatenate((x[y > 0], *earlier)), np.r_[np.ones((y > 0).sum()), -np.ones(sum(map(len, earlier)))]
        weights, bias = fitted(x, y)
        machine = Machine(landmarks, root @ weights, bias)
    found = witnesses(rows, machine)
    slope, shift = calibrated(found["score"].to_numpy(), found["toxic"].to_numpy() == 1)
    return Machine(landmarks, machine.beta, machine.bias, slope, shift)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, text score) of every document; the machine has at most LANDMARKS + CLEAN_LANDMARKS words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(machine)
        for x in batches:
            if machine.prior is not None:
                out = np.full(len(x), machine.prior)
            else:
                out = sigmoid(machine.slope * scorer.documents(x["text"])[0] + machine.shift)
            yield pd.DataFrame({"doc_id": x["doc_id"], "score": out})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
