"""Toxicity: a subsequence-string-kernel support vector machine with Nyström landmarks.

The string subsequence kernel (Lodhi et al., JMLR 2002) counts the
subsequences of P letters that two strings share, each weighted by DECAY to
the span it covers, so letters that are inserted or left out lower the kernel
without voiding it.  A chunk of a text (a word, with its outer punctuation
off, look-alike signs read as letters, and runs of single letters read
together) is mapped to its normalised kernel values with landmark strings,
whitened by the inverse square root of the landmarks' own kernel matrix
(Nyström), and scored by a linear support vector machine.

Training takes the sentences of a bounded sample of labelled documents.  A
sentence is a bag of chunks: all chunks of a sentence of a clean document are
clean, and those of a toxic document's sentences are what the machine finds
them to be (mi-SVM, Andrews et al., NIPS 2002).  The bags start from words and
their beginnings (stems) that mark out label 1, tested against chance at a
bounded rate of false discoveries, each marking word filed under its likeliest
stem.  Stems that clean documents hardly hold are sure: one such chunk makes a
sentence toxic.  The others are weak: several must add up.  Each kind has a
machine of its own.  In every round it is fitted on the toxic chunks, weighted
by the sentences that hold them, and on the same with one letter inserted,
against clean chunks and those it scored highest before; then the chunks of
toxic sentences are labelled anew, and a marked sentence keeps its highest.  A
sentence's margin is that of its highest chunk.  A document's score is the
greater of two logistic regressions on the sample: of its highest sentence
margin and the number of toxic sentences, and of the number of weak chunks and
of all chunks.

Defined results: null and empty texts get the score of a text without chunks;
repeated rows get the same score; with no label of a class, all scores are 0;
rows with a null label are not learnt from; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc, map_arrow, table

P, DECAY = 3, 0.8
#: Most labelled documents that are learnt from (those with the least hash of their id).
SAMPLE = 4000
CLEAN_LANDMARKS, HARD_LANDMARKS = 16, 48
#: Share of chance finds among the marking words that are equally common (Benjamini and Hochberg).
FALSE_FINDS = 0.05
#: Chance of a stem's own words being as unevenly spread.
BY_CHANCE = 0.02
#: Clean words a round is fitted on, drawn from all of the sample's, and those scored highest that join them.
CLEAN_WORDS, HARD_WORDS, TURNS = 3000, 1500, 4
#: A stem is sure if at most this many clean documents hold it for one that is not, and
#: FALSE_FINDS holds among the stems of any commonness together.
SURE = 0.02
#: Of so many clean documents of the sample one is kept back: words of these alone are not
#: fitted on, so the border between documents is set by words that the machine has not met.
KEPT_BACK = 4
#: Chunk scores below this are read as this.
FLOOR = -1.0
#: Chunks longer than this are scored in windows of this length, half overlapping.
WINDOW = 24
CACHE_CHUNKS = 200_000
#: Strings scored at a time.
PART = 20_000

# The alphabet of the kernel, and signs read as the letters they look like.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789äöüßáàâçéèêíñóú"
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LIKE = str.maketrans(LOOKALIKE)
_OUTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$")
_SIGNS = re.compile(r"[\W_]+")
_EDGE = re.compile(r"^[^\w$@!]+|[^\w$@]+$")
_SPACED = re.compile(r"(?<!\S)\w(?:[ \t]+\w){2,}(?!\S)")
_BREAK = re.compile(r"(?<=[.!?])\s+|[\n\r]+")
_CODE = np.full(0x250, len(ALPHABET), dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
_SIZE = len(ALPHABET) + 1


def normal(chunk: str) -> str:
    """A chunk as the kernel reads it: look-alikes as letters, other signs left out."""
    if chunk.isalpha():
        return chunk
    chunk = _EDGE.sub("", chunk)
    bare = _SIGNS.sub("", chunk)
    if bare.isalpha() and not any(c in chunk for c in "$@!"):
        return bare
    return _SIGNS.sub("", chunk.translate(_LIKE)) if any(c.isalpha() for c in chunk) else ""


def chunks_of(text: str | None) -> set[str]:
    """The distinct chunks of a text, lower case, as written; runs of single letters are read together too."""
    if not text:
        return set()
    low = text.lower()
    found = {c.strip(_OUTER) for c in set(low.split())}
    for m in _SPACED.finditer(low):
        found.add("".join(m[0].split()))
    return found


def sentences_of(text: str | None) -> list[str]:
    """A text cut after full stops, exclamation and question marks, and at line breaks."""
    return [s for s in _BREAK.split(text) if s] if text else []


def windows(s: str) -> list[str]:
    if len(s) <= WINDOW:
        return [s]
    return [s[a : a + WINDOW] for a in range(0, len(s) - WINDOW // 2, WINDOW // 2)]


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Padded codes (-1) and lengths; letters outside the alphabet are one further letter."""
    sizes = np.array([len(s) for s in strings])
    out = np.full((len(strings), max(int(sizes.max(initial=0)), 1)), -1, dtype=np.int64)
    for i, s in enumerate(strings):
        points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[i, : len(points)] = _CODE[np.minimum(points, 0x24F)]
    return out, sizes


def kernel(a: np.ndarray, b: np.ndarray, p: int = P, decay: float = DECAY) -> np.ndarray:
    """Kernel of each row of codes `a` with the row of `b` at its place (Lodhi's recursion)."""
    n, m = a.shape[1], b.shape[1]
    equal = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    prime = np.ones((len(a), n + 1, m + 1))  # K'_{i-1}, with the empty prefix first
    for _ in range(p - 1):
        new = np.zeros_like(prime)
        for i in range(1, n + 1):
            second = np.zeros(len(a))
            for j in range(1, m + 1):
                second = decay * second + equal[:, i - 1, j - 1] * decay**2 * prime[:, i - 1, j - 1]
                new[:, i, j] = decay * new[:, i - 1, j] + second
        prime = new
    return (equal * prime[:, :-1, :-1]).sum(axis=(1, 2)) * decay**2


def weights_of(landmark: str, p: int = P, decay: float = DECAY) -> dict[tuple[int, ...], float]:
    """The landmark's feature vector: a weight for each subsequence of p letters."""
    from itertools import combinations

    codes = _codes([landmark])[0][0][: len(landmark)].tolist()
    out: dict[tuple[int, ...], float] = {}
    for at in combinations(range(len(codes)), p):
        u = tuple(codes[i] for i in at)
        out[u] = out.get(u, 0.0) + decay ** (at[-1] - at[0] + 1)
    return out


class Landmarks:
    """Normalised kernels of many strings with fixed landmarks.

    A landmark's feature vector is a table over letter triples; the kernel
    with a string is the sum of the table over the string's own triples."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        cells: dict[tuple[int, int], float] = {}
        for k, s in enumerate(strings):
            vector = weights_of(s)
            norm = sum(v * v for v in vector.values()) ** 0.5 or 1.0
            for u, v in vector.items():
                at = 0
                for letter in u:
                    at = at * _SIZE + letter
                cells[at, k] = v / norm
        # only triples that a landmark has get a row; row 0 is that of the others
        self.used = np.unique(np.array([at for at, _ in cells], dtype=np.int64))
        self.row = np.zeros(_SIZE**P, dtype=np.int32)
        self.row[self.used] = np.arange(1, len(self.used) + 1)
        self.table = np.zeros((len(self.used) + 1, len(strings)), dtype=np.float32)
        for (at, k), v in cells.items():
            self.table[self.row[at], k] = v
        self.steps: dict[int, tuple] = {}

    def _triples(self, n: int) -> tuple:
        if n not in self.steps:
            i, j, k = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]).T
            self.steps[n] = i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)
        return self.steps[n]

    def _keys(self, strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one length at a time: their numbers, triples and the weights of the places."""
        codes, sizes = _codes(strings)
        for n in np.unique(sizes[sizes >= P]).tolist():
            i, j, k, w = self._triples(n)
            rows = np.flatnonzero(sizes == n)
            step = max(1, 200_000 // len(i))
            for at in range(0, len(rows), step):
                c = codes[rows[at : at + step]]
                yield rows[at : at + step], (c[:, i] * _SIZE + c[:, j]) * _SIZE + c[:, k], w

    def values(self, strings: list[str]) -> np.ndarray:
        """(strings, landmarks); strings of under P letters have 0.  At most WINDOW letters each."""
        out = np.zeros((len(strings), len(self.strings)), dtype=np.float32)
        for rows, key, w in self._keys(strings):
            norm = _norms(key, w)
            step = max(1, 16_000 // len(w))
            for at in range(0, len(rows), step):
                out[rows[at : at + step]] = np.matmul(w, self.table[self.row[key[at : at + step]]]) / norm[at : at + step, None]
        return out

    def fold(self, beta: np.ndarray) -> np.ndarray:
        """The landmarks' tables as one for each row of weights, its bias left out."""
        out = np.zeros((len(beta), len(self.row)), dtype=np.float32)
        out[:, self.used] = beta[:, :-1].astype(np.float32) @ self.table[1:].T
        return out

    def decisions(self, strings: list[str], beta: np.ndarray, floor: float, folded: np.ndarray | None = None) -> np.ndarray:
        """max(floor, values @ beta[:-1] + beta[-1]), a column for each row of weights.  Norms are
        found only where a value could be above the floor."""
        folded = self.fold(beta) if folded is None else folded
        if len(strings) > PART:
            return np.concatenate([self.decisions(strings[at : at + PART], beta, floor, folded) for at in range(0, len(strings), PART)])
        bias = beta[:, -1]
        out = np.tile(np.maximum(floor, bias), (len(strings), 1))
        for rows, key, w in self._keys(strings):
            top = np.stack([f[key] @ w for f in folded], axis=1)
            least = float(np.sqrt((w * w).sum()))
            some = np.flatnonzero((top / least + bias > floor).any(axis=1))
            exact = np.full(top.shape, floor)
            if len(some):
                exact[some] = np.maximum(floor, top[some] / _norms(key[some], w)[:, None] + bias)
            out[rows] = exact
        return out


def _norms(key: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Length of the feature vector of each row of triples: equal triples add up first."""
    order = np.argsort(key, axis=1, kind="stable")
    sorted_ = np.take_along_axis(key, order, axis=1)
    weight = w[order].astype(np.float64)
    total = np.cumsum(weight, axis=1)
    last = np.ones(key.shape, dtype=bool)
    last[:, :-1] = sorted_[:, 1:] != sorted_[:, :-1]
    ends = np.where(last, total, 0.0)
    # sum of a run = its end less the end of the run before
    before = np.zeros_like(ends)
    before[:, 1:] = np.maximum.accumulate(ends, axis=1)[:, :-1]
    runs = np.where(last, total - before, 0.0)
    return np.sqrt((runs * runs).sum(axis=1))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (the bias last) of the squared-hinge machine by Newton steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        margin = 1 - y * (x @ w)
        on = margin > 0
        c = cost * on
        gradient = ridge @ w - x.T @ (c * y * np.maximum(margin, 0))
        step = np.linalg.solve(ridge + (x * c[:, None]).T @ x, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights without a bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    landmarks: list[str]
    beta: np.ndarray  # two rows, for sure and weak chunks: one weight a landmark, the bias last
    doc: np.ndarray  # logistic weights of (highest sentence margin, log count of toxic sentences), then the bias
    weak: np.ndarray | None = None  # logistic weights of (log count of weak chunks, log count of all, 1)

    def start(self) -> Model:
        self.marks = Landmarks(self.landmarks)
        self.folded = self.marks.fold(self.beta)
        del self.marks.table
        self.cache: dict[str, tuple[float, float]] = {}
        return self

    def chunk_scores(self, chunks: list[str]) -> np.ndarray:
        """(chunks, 2): scores as sure and as weak chunks."""
        parts = [windows(normal(c)) for c in chunks]
        flat = [w for p in parts for w in p]
        scores = self.marks.decisions(flat, self.beta, FLOOR, self.folded)
        ends = np.cumsum([len(p) for p in parts])
        return np.maximum.reduceat(scores, np.concatenate([[0], ends[:-1]])) if len(parts) else scores

    def learn(self, found: set[str]) -> None:
        """Puts the scores of chunks not met before into the table."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        new = [c for c in found if c not in self.cache]
        if new:
            self.cache.update(zip(new, map(tuple, self.chunk_scores(new).tolist()), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Highest sentence margin and log counts of toxic sentences, weak and all chunks, a row a text."""
        out = np.empty((len(texts), 4))
        for at in range(0, len(texts), 64):
            found = [chunks_of(t) for t in texts[at : at + 64]]
            self.learn(set().union(*found))
            for i, f in enumerate(found, at):
                scores = [self.cache[c] for c in f]
                top = max((s for s, _ in scores), default=FLOOR)
                sure = {c for c in f if self.cache[c][0] > 0} if top > 0 else set()
                toxic = max(1, sum(not sure.isdisjoint(chunks_of(s)) for s in sentences_of(texts[i]))) if sure else 0
                out[i] = top, *np.log1p([toxic, sum(v > 0 for _, v in scores), len(f)])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.landmarks):
            return np.zeros(len(texts))
        x = self.features(texts)
        logit = x[:, :2] @ self.doc[:2] + self.doc[2]
        if self.weak is not None:
            logit = np.maximum(logit, np.where(x[:, 2] > 0, x[:, 2:] @ self.weak[:2] + self.weak[2], -30))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _tail(n: int, k: int, p: float) -> float:
    """Chance of k or more of n."""
    if not 0 < p < 1:
        return 1.0
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k, n + 1)]
    return float(sum(exp(x) for x in logs))


def stems_of(word: str) -> list[str]:
    """The word and its beginnings of P letters and more."""
    return [word[:k] for k in range(P, min(len(word), WINDOW) + 1)]


def marking(texts: list[str | None], toxic: list[int]) -> tuple[dict[str, tuple[int, int, bool]], tuple[Counter, Counter]]:
    """Stems that mark out label 1, with the documents of either label that hold them
    (1 first) and whether they are sure, and the documents that hold each word, by label."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    held: tuple[Counter, Counter] = (Counter(), Counter())
    hashes: tuple[list, list] = ([], [])  # of all stems: how many are how common needs no strings
    # toxic texts first: clean ones need counts of their stems only
    for t, label in sorted(zip(texts, toxic, strict=True), key=lambda r: -r[1]):
        words = {n for c in chunks_of(t) if len(n := normal(c)) >= P}
        seen[label].update(words)
        stems = {s for w in words for s in stems_of(w)}
        held[label].update(stems if label else stems & held[1].keys())
        hashes[label].append(np.fromiter(map(hash, stems), dtype=np.int64, count=len(stems)))
    n1, n0 = sum(y == 1 for y in toxic), sum(y == 0 for y in toxic)
    # so unevenly spread that of those found among the words or stems that stand in
    # as many documents, chance would give less than a share of FALSE_FINDS
    found = {}
    common = np.unique(np.concatenate(hashes[0] + hashes[1]), return_counts=True)[1]
    sizes = [sum(map(len, h)) for h in hashes]
    del hashes
    shares = (sum(seen[1].values()) / max(1, sum(seen[1].values()) + sum(seen[0].values())), sizes[1] / max(1, sum(sizes)))
    spreads = (Counter((seen[0] + seen[1]).values()), dict(enumerate(np.bincount(common).tolist())))
    for of, share, spread in zip((seen, held), shares, spreads, strict=True):
        classes = sum(v > 0 for v in spread.values())
        tried: dict[int, list[tuple[float, str]]] = {}
        for w, k in of[1].items():
            other = of[0][w]
            if k >= 3 and (k / n1) > 8 * (other + 0.5) / n0:
                tried.setdefault(k + other, []).append((_tail(k + other, k, share), w))
        for n, ones in tried.items():
            ones.sort()
            rate = [chance * spread[n] / rank for rank, (chance, _) in enumerate(ones, 1)]
            for k in range(len(ones) - 2, -1, -1):
                rate[k] = min(rate[k], rate[k + 1])
            for r, (chance, w) in zip(rate, ones, strict=True):
                if r < FALSE_FINDS:
                    sure = held[0][w] <= SURE * held[1][w] and r * classes < FALSE_FINDS
                    found[w] = held[1][w], held[0][w], sure
    return found, seen


def _likelihood(k: int, other: int, n1: int, n0: int) -> float:
    """How much likelier the spread is under a rate of its own than under that of all documents."""
    n, p = k + other, n1 / (n1 + n0)
    return k * log(k / n / p) + (other * log(other / n / (1 - p)) if other else 0.0)


def _filed(words: Iterable[str], found: dict, n1: int, n0: int) -> dict[str, str]:
    """The words that have a stem in `found`, each with its likeliest."""
    rank = {s: (_likelihood(*v[:2], n1, n0), len(s)) for s, v in found.items()}
    held = ((w, [s for s in stems_of(w) if s in rank]) for w in words)
    return {w: max(stems, key=rank.__getitem__) for w, stems in held if stems}


def train(texts: list[str | None], toxic: list[int], seed: int = 5) -> Model:
    """Fits the machines on labelled documents."""
    y = np.array(toxic)
    empty = Model([], np.zeros((2, 1)), np.zeros(3))
    if not (y == 1).any() or not (y == 0).any():
        return empty
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    found, seen = marking(texts, toxic)
    # a stem that marks out the label only by the words of a likelier longer stem goes
    of = _filed(seen[0].keys() | seen[1].keys(), found, n1, n0)
    own: tuple[Counter, Counter] = (Counter(), Counter())
    kept_back = np.flatnonzero(y == 0)[::KEPT_BACK]
    back = {int(i): np.empty(0, np.int64) for i in kept_back}
    for i, (t, label) in enumerate(zip(texts, toxic, strict=True)):
        words = {normal(c) for c in chunks_of(t)}
        own[label].update({of[n] for n in words if n in of})
        if i in back:
            back[i] = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    new = _only(seen[0], np.concatenate(list(back.values())))
    found = {s: v for s, v in found.items() if own[1][s] and _tail(own[1][s] + own[0][s], own[1][s], n1 / (n1 + n0)) < BY_CHANCE}
    kinds: tuple[dict[str, None], dict[str, None]] = ({}, {})  # words by kind of their stem: sure, weak
    for w, stem in sorted(_filed(seen[1], found, n1, n0).items()):
        kinds[0 if found[stem][2] else 1][w] = None
    if not any(kinds):
        return empty
    rng = np.random.default_rng(seed)
    marked = kinds[0].keys() | kinds[1].keys()
    bags = [{n for c in chunks_of(s) if P <= len(n := normal(c)) <= WINDOW} for t, label in zip(texts, toxic, strict=True) if label == 1 for s in sentences_of(t)]
    machines = [_machine(list(words), marked, new, bags, seen, found, rng) for words in kinds]
    del seen, bags, of, own, new
    strings = list(dict.fromkeys(s for marks, _ in machines for s in marks))
    beta = np.zeros((2, len(strings) + 1))
    at = {s: i for i, s in enumerate(strings)}
    for row, (marks, b) in zip(beta, machines, strict=True):
        for s, v in zip(marks, b[:-1], strict=True):
            row[at[s]] += v
        row[-1] = b[-1]
    x = Model(strings, beta, np.zeros(3)).start().features(texts)
    doc = np.maximum(fit_logistic(x[:, :2], y.astype(float)), [0.5, 0.0])
    logit = x[:, :2] @ doc
    doc = np.append(doc, -_border(logit[y == 1], logit[kept_back], n0 / len(kept_back)))
    weak = None
    rest = x[:, 1] == 0
    if kinds[1] and (y[rest] == 1).any():
        weak = fit_logistic(np.hstack([x[rest, 2:], np.ones((int(rest.sum()), 1))]), y[rest].astype(float))
        weak = weak if weak[0] > 0 else None
    return Model(strings, beta, doc, weak)


def _only(seen: Counter, held: np.ndarray) -> set[str]:
    """The words all of whose documents are among those whose words' hashes are `held`."""
    keys, counts = np.unique(held, return_counts=True)
    hashes = np.fromiter(map(hash, seen), dtype=np.int64, count=len(seen))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    same = (keys[at] == hashes) & (counts[at] == np.fromiter(seen.values(), dtype=np.int64, count=len(seen))) if len(keys) else hashes != hashes
    return {w for w, s in zip(seen, same.tolist(), strict=True) if s}


def _border(toxic: np.ndarray, clean: np.ndarray, weight: float) -> float:
    """The border, 0 or more, of fewest errors, a clean one counting `weight`: midway between the values beside it."""
    if not (clean > 0).any():
        return 0.0
    at = np.unique(np.maximum(0, np.concatenate([[0.0], toxic, clean])))
    wrong = [(toxic <= b).sum() + weight * (clean > b).sum() for b in at]
    k = int(np.argmin(wrong))
    return float(at[k : k + 2].mean()) if k else 0.0


def _machine(start: list[str], marked: set[str], new: set[str], bags: list[set[str]], seen: tuple[Counter, Counter], found: dict, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Landmarks and weights of the machine that tells toxic chunks from clean ones.

    start: the chunks held toxic at first; new: those it is not to know; bags: the sentences of toxic documents."""
    if not start:
        return [], np.array([FLOOR])
    best = sorted({max((s for s in stems_of(w) if s in found), key=len) for w in start})
    clean_common = [w for w, _ in seen[0].most_common(CLEAN_LANDMARKS * 3 + len(marked)) if w not in marked][:CLEAN_LANDMARKS]
    letters = ALPHABET[:26] + "-.*"
    clean = sorted(w for w in seen[0] if w not in marked and w not in new and len(w) <= WINDOW)
    picked = [clean[i] for i in rng.choice(len(clean), size=min(CLEAN_WORDS, len(clean)), replace=False)] if clean else []
    sentences = Counter(w for bag in bags for w in bag)
    # chunks of toxic documents' sentences alone, whose labels are found, and the sentences that hold a marked one
    open_ = sorted(w for w in sentences if not seen[0][w] and w not in marked)
    known = set(start)
    bags_marked = [sorted(bag) for bag in bags if not known.isdisjoint(bag)]
    toxic: set[str] = set(start)
    hard: list[str] = []
    strings = [w[:WINDOW] for w in best + clean_common]
    marks = None
    for turn in range(TURNS):
        positive = sorted(toxic)
        gapped = [w[:k] + letters[int(rng.integers(len(letters)))] + w[k:] for w in positive for k in range(1, len(w))]
        marks = None  # its table is large
        marks, whiten = _nystrom(strings)
        words = [w[:WINDOW] for w in positive + gapped] + picked + hard
        x = np.empty((len(words), len(strings)))
        for at in range(0, len(words), 2000):
            x[at : at + 2000] = marks.values(words[at : at + 2000]).astype(np.float64) @ whiten
        sign = np.concatenate([np.ones(len(positive) + len(gapped)), -np.ones(len(picked) + len(hard))])
        cost = np.where(sign > 0, 1.0, 30.0)
        cost[: len(positive)] = [100.0 * (1 + log(max(1, sentences[w]))) for w in positive]
        w = fit_svm(x, sign, cost)
        beta = np.append(whiten @ w[:-1], w[-1])
        if turn == TURNS - 1 or not clean:
            break
        scores = marks.decisions(clean, beta[None, :], -2.0)[:, 0]
        worst = [clean[i] for i in np.argsort(-scores, kind="stable")[:HARD_WORDS] if scores[i] > -1]
        hard = sorted(set(hard) | set(worst) - set(picked))
        strings = strings[: len(best) + len(clean_common)] + sorted(set(strings[len(best) + len(clean_common) :]) | set([h for h in worst if h not in strings][: HARD_LANDMARKS // 3]))
        # labels of the next round: above the border and above every clean chunk, or a marked sentence's highest
        border = max(0.0, float(scores.max()))
        toxic = {w for w, s in zip(open_, marks.decisions(open_, beta[None, :], -2.0)[:, 0], strict=True) if s > border}
        own = dict(zip(start, marks.decisions([w[:WINDOW] for w in start], beta[None, :], -2.0)[:, 0].tolist(), strict=True))
        toxic |= {w for w, s in own.items() if s > 0} | {max(known.intersection(bag), key=lambda w: (own[w], w)) for bag in bags_marked}
    return marks.strings, beta


def _nystrom(strings: list[str]) -> tuple[Landmarks, np.ndarray]:
    """Landmarks and the inverse square root of their kernel matrix."""
    marks = Landmarks(strings)
    gram = marks.values(strings).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(gram)))
    return marks, vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T


def _sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """`(id, y, a, b)`: texts of least and greatest hash of at most `rows` labelled ids.

    Ids are chosen from the labels by hash, then their texts are looked up."""
    known = labels.where(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null")
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(rows).collect()
    ids = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in chosen], "id long, y int")
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("id", "y", F.struct(F.xxhash64("text").alias("h"), "text").alias("t"))
    return found.groupBy("id", "y").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("id", "y", "a.text", F.when(F.col("a.h") != F.col("b.h"), F.struct("b.text")).alias("other"))


def _pairs(rows: Iterable[tuple]) -> tuple[list, list]:
    taken = [(t, y) for _, y, text, other in rows for t in ([text] if other is None else [text, other["text"]])]
    return [t for t, _ in taken], [y for _, y in taken]


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE) -> tuple[list, list]:
    """Texts and labels of at most `rows` labelled documents; where an id
    repeats, its texts of least and greatest hash are taken."""
    return _pairs(_sample(docs, labels, usable, id_col, text_col, label_col, rows).orderBy("id").collect())


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE) -> Model:
    """The model of `labelled_sample`, trained in one task: only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)), key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(*_pairs(held)))], pa.binary())], names=["model"])

    sample = _sample(docs, labels, usable, id_col, text_col, label_col, rows).repartition(1)
    found = map_arrow(sample, run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], [])


def score_docs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, score)` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        if not hasattr(m, "cache"):
            m.start()
        for b in batches:
            scores = m.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", border: float = 0.5) -> DataFrame:
    """The rows scored below the border, columns unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        if not hasattr(m, "cache"):
            m.start()
        for b in batches:
            yield b.filter(pa.array(m.scores(b.column(at).to_pylist()) < border))

    return map_arrow(docs, run, docs.schema)


def op1_string_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, crc("doc_id") % 5 != 0)
    out = score_docs(docs, model)
    return out.select("doc_id", (crc("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
