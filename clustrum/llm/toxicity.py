"""Toxicity: a support vector machine on a gapped subsequence string kernel of sentences, through Nyström landmarks.

The kernel of two words weighs each common subsequence of three letters that spans SPAN letters at most by DECAY to the
power of the letters it spans in either word (after Lodhi et al. 2002), so inserted letters and gaps cost a little only; it
is normalised to 1 for equal words and raised to POWER, which tells chance likeness apart. The kernel of two sentences sums
that over all pairs of their distinct words, each word weighed by how rare it is in clean sentences. All of these are
kernels again, so the inverse square root of the landmarks' own matrix maps a sentence into a space where a linear support
vector machine is the kernel machine on the landmarks' span. Landmarks are words, and sentences around runs of letters,
that toxic documents share.

The labels are those of documents: a document is toxic if one of its sentences is. So the machine is trained on labelled
sentences that are chosen by itself, in rounds: of each document the sentence that it finds most toxic (Andrews et al.
2003), those of clean documents beside the ones of the rounds before. A part of the documents is learned from twice, the
second time with a letter put in each longer word. A document's score is a logistic function of the margins of its WORST
most toxic sentences, so several doubtful ones add up. It is fitted on margins of machines that haven't seen the document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, drop, first_by_hash, hash_place, read_table, ship, worker_tables

#: Labelled documents of either label that a model is fitted on, at most, by the hash of the id.
PER_LABEL = 3000
#: Landmark sentences from toxic documents and from clean ones, at most.
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 120, 16
#: A landmark is a sentence around a run of GRAM letters that stands in so many toxic documents and in such a share of
#: them, the share of toxic ones among all documents with it, and the runs that are considered, at most; letters of a
#: landmark, at most.
GRAM, SUPPORT, SUPPORT_SHARE, PRECISION, CONSIDERED, LANDMARK_LETTERS = 5, 3, 0.01, 0.9, 2000, 400
#: Length of the subsequences, the letters that they span at most (7 or fewer), what each of those weighs, and the power
#: of a pair of words.
ORDER, SPAN, DECAY, POWER = 3, 7, 0.8, 4
#: Words of a sentence that count together; a longer one is cut into windows that overlap by half.
WINDOW = 12
#: Rounds in which sentences are chosen, and what a sentence on the wrong side of the margin costs.
ROUNDS, COST = 4, 1.0
#: Windows of a document that its score looks at, parts of the sample of which each is scaled by the others, and the
#: scale's ridge.
WORST, FOLDS, RIDGE = 5, 5, 1.0
#: Labelled documents, at most (about), that are learned from a second time with a letter put in each longer word.
TWINS = 2000
#: Letters of a word that the kernel takes at once; longer words are cut into halves that overlap.
LONGEST = 24
#: Words whose values a worker remembers, in each of two tables: those of one number, and those of many.
WORDS, WIDE_WORDS = 250_000, 25_000
#: Eigenvalues of the landmarks' matrix below this share of the largest count as 0.
RANK = 1e-4

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\S)\w(?:[^\w\n]+\w){2,}(?!\w)")


def sentences(text: str | None) -> list[list[str]]:
    """The lower-cased words of each sentence; letters that stand apart by themselves are one word beside them."""
    if not text:
        return []
    text = text.lower()
    out = [s.split() for s in _SENTENCE_END.split(text)]
    if _SPACED.search(text):
        out = [s.split() + ["".join(c for c in m.group() if c.isalnum()) for m in _SPACED.finditer(s)] for s in _SENTENCE_END.split(text)]
    return [s for s in out if s]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, begin, end) of the windows of sentences of these lengths that stand one after the other."""
    n = np.where(lengths <= WINDOW, 1, -(-(lengths - WINDOW) // (WINDOW // 2)) + 1)
    of = np.repeat(np.arange(len(lengths)), n)
    starts = np.cumsum(lengths) - lengths
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[of] + step * (WINDOW // 2)
    return of, begin, np.minimum(begin + WINDOW, (starts + lengths)[of])


def window_sums(values: np.ndarray, words: list[str], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sums of the words' values in each window, a word that stands in it several times counted once."""
    names: dict[str, int] = {}
    name = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    order = np.argsort(name, kind="stable")
    last = np.full(len(words), -1)
    same = np.flatnonzero(name[order][1:] == name[order][:-1])
    last[order[same + 1]] = order[same]
    sums = np.zeros((len(begin), values.shape[1]))
    for k in range(WINDOW):
        at = begin + k
        held = np.flatnonzero(at < end)
        held = held[last[at[held]] < begin[held]]
        sums[held] += values[at[held]]
    return sums


def pieces(word: str) -> list[str]:
    """The word's letters and digits, in parts that the kernel takes; none if there are fewer than ORDER, or no letter."""
    if not word.isalnum():
        word = "".join(c for c in word if c.isalnum())
    if len(word) < ORDER or not any(map(str.isalpha, word)):
        return []
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length) if words else np.zeros((0, length), np.uint32)


#: Of words of n letters: the places of the subsequences that span SPAN letters at most.
_PLACES = {n: np.array([c for c in combinations(range(n), ORDER) if c[-1] - c[0] < SPAN]) for n in range(ORDER, LONGEST + 1)}


class WordKernel:
    """The normalised kernel of any words with some known ones, by counting common subsequences."""

    def __init__(self, known: list[str]):
        self.known = known
        self.letters = np.unique(np.concatenate([_codes([w], len(w))[0] for w in known])) if known else np.zeros(0, np.uint32)
        self.base = len(self.letters) + 1
        owner, code, weight = [], [], []
        for j, w in enumerate(known):
            c, x, _ = self._features(_codes([w], len(w)))
            owner.append(np.full(len(c), j))
            code.append(c)
            weight.append(x)
        owner, code, weight = (np.concatenate(v) if known else np.zeros(0) for v in (owner, code, weight))
        order = np.argsort(code, kind="stable")
        self.keys, first = np.unique(code[order], return_index=True)
        self.first = np.r_[first, len(code)]
        self.owner, self.weight = owner[order].astype(np.int64), weight[order]
        self.table = None
        if self.base**ORDER <= 1 << 24:
            self.table = np.full(self.base**ORDER, -1, np.int32)
            self.table[self.keys.astype(np.int64)] = np.arange(len(self.keys))
        # the known words' own norms are in their weights
        self.weight = self.weight / np.sqrt(np.array([_self_kernel(_codes([w], len(w)))[0] for w in known]))[self.owner] if known else self.weight

    def _features(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, weight, word) of each subsequence of known letters of words of one length."""
        at = np.minimum(np.searchsorted(self.letters, raw), max(len(self.letters) - 1, 0))
        codes = np.where(self.letters[at] == raw, at + 1, 0).astype(np.int64)
        places = _PLACES[raw.shape[1]]
        code, good = np.zeros((len(raw), len(places)), np.int64), np.ones((len(raw), len(places)), bool)
        for k in range(ORDER):
            part = codes[:, places[:, k]]
            code = code * self.base + part
            good &= part > 0
        word, column = np.nonzero(good)
        return code[word, column], (DECAY ** (places[:, -1] - places[:, 0] + 1))[column], word

    def parts(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """(places in words, their kernels with the known ones) for words of ORDER to LONGEST letters, some at a time."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, rows in by_length.items() if self.known else ():
            step = max(1, min(1_000_000 // len(_PLACES[n]), 2_000_000 // len(self.known)))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                raw = _codes([words[i] for i in part], n)
                code, weight, word = self._features(raw)
                if self.table is not None:
                    key = self.table[code]
                else:
                    key = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
                    key = np.where(self.keys[key] == code, key, -1)
                met = key >= 0
                key, weight, word = key[met], weight[met], word[met]
                many = self.first[key + 1] - self.first[key]
                at = np.repeat(self.first[key] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                cell = np.repeat(word * len(self.known), many) + self.owner[at]
                weight = weight / np.sqrt(_self_kernel(raw))[word]
                value = np.bincount(cell, np.repeat(weight, many) * self.weight[at], minlength=len(part) * len(self.known))
                yield part, value.astype(float, copy=False).reshape(len(part), -1)

    def against(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.known)))
        for rows, value in self.parts(words):
            out[rows] = value
        return out

    def fold(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """The powers of the kernels, times known x numbers."""
        out = np.zeros((len(words), weights.shape[1]))
        for rows, value in self.parts(words):
            out[rows] = np.power(value, POWER, out=value) @ weights
        return out


def _self_kernel(raw: np.ndarray) -> np.ndarray:
    """The kernel of each word of one length with itself: squares of the weights that equal subsequences sum up to."""
    places = _PLACES[raw.shape[1]]
    _, letter = np.unique(raw, return_inverse=True)
    letter = letter.reshape(raw.shape).astype(np.int64)
    key = np.zeros((len(raw), len(places)), np.int64)
    for k in range(ORDER):
        key = (key << 20) | letter[:, places[:, k]]
    key = np.sort((key << 3) | (places[:, -1] - places[:, 0] + 1), 1)
    weight = (DECAY ** np.arange(8))[key & 7]
    key >>= 3
    fresh = np.ones(key.shape, bool)
    fresh[:, 1:] = key[:, 1:] != key[:, :-1]
    total = np.add.reduceat(weight.ravel(), np.flatnonzero(fresh.ravel()))
    return np.bincount(np.nonzero(fresh)[0], total * total, minlength=len(raw))


@dataclass(frozen=True)
class Landmarks:
    """Sentences, and the weights of words that clean documents share; other words weigh 1."""

    sentences: tuple[tuple[str, ...], ...]
    common: dict[str, float]

    def words(self) -> tuple[list[str], np.ndarray]:
        """The landmarks' distinct parts of words, and parts x landmarks with the weights of their words."""
        cells: dict[tuple[str, int], float] = {}
        for j, s in enumerate(self.sentences):
            for w in dict.fromkeys(s):
                for p in pieces(w):
                    cells[p, j] = cells.get((p, j), 0.0) + self.common.get(w, 1.0)
        known = sorted({p for p, _ in cells})
        at = {p: i for i, p in enumerate(known)}
        weight = np.zeros((len(known), len(self.sentences)))
        for (p, j), v in cells.items():
            weight[at[p], j] = v
        return known, weight


class Valuer:
    """For each word its weighed kernels with the landmarks, folded by `fold` (landmarks x numbers): what it adds to a
    sentence. Values of words that were met are remembered."""

    def __init__(self, landmarks: Landmarks, fold: np.ndarray):
        known, weight = landmarks.words()
        self.common, self.fold = landmarks.common, weight @ fold
        self.kernel = WordKernel(known)
        self.most, self.at_once = (WORDS, 40_000) if fold.shape[1] == 1 else (WIDE_WORDS, 10_000)
        self.new: dict[str, np.ndarray | float] = {}
        self.old: dict[str, np.ndarray | float] = {}

    def _of(self, words: list[str]) -> np.ndarray:
        parts = [(i, p) for i, w in enumerate(words) for p in pieces(w)]
        out = np.zeros((len(words), self.fold.shape[1]))
        if parts:
            np.add.at(out, [i for i, _ in parts], self.kernel.fold([p for _, p in parts], self.fold))
        return out * np.array([self.common.get(w, 1.0) for w in words])[:, None]

    def values(self, words: list[str]) -> np.ndarray:
        get, found = self.new.get, {}
        got = list(map(get, words))
        missing = dict.fromkeys(w for w, v in zip(words, got, strict=True) if v is None)
        if missing:
            if len(self.new) + len(missing) > self.most:
                self.new, self.old = {}, self.new
            asked = []
            for w in missing:
                if (v := self.old.get(w)) is None:
                    asked.append(w)
                else:
                    found[w] = v
            own = self._of(asked)
            found.update(zip(asked, own[:, 0].tolist() if own.shape[1] == 1 else own.astype(np.float32), strict=True))
            self.new.update(found)
            # words of the first look-up may have gone to the older table since
            got = [found[w] if v is None else v for w, v in zip(words, got, strict=True)]
        return np.array(got, np.float64).reshape(len(words), self.fold.shape[1])

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, windows x numbers): the sums over the words of each window of its sentences; runs of texts at a time."""
        cut_texts = [sentences(t) for t in texts]
        begin = 0
        while begin < len(texts):
            end, n = begin, 0
            while end < len(texts) and (end == begin or n < self.at_once):
                n += sum(map(len, cut_texts[end]))
                end += 1
            words = [w for t in cut_texts[begin:end] for s in t for w in s]
            lengths = np.array([len(s) for t in cut_texts[begin:end] for s in t], np.int64)
            of, a, b = windows(lengths)
            sums = window_sums(self.values(words), words, a, b)
            owner = np.repeat(np.arange(begin, end), [len(t) for t in cut_texts[begin:end]])[of]
            stops = np.searchsorted(owner, np.arange(begin, end), "right")
            starts = np.searchsorted(owner, np.arange(begin, end), "left")
            for i in range(begin, end):
                yield i, sums[starts[i - begin] : stops[i - begin]]
            begin = end


@dataclass(frozen=True)
class Model:
    landmarks: Landmarks
    #: Of each landmark what its kernel adds to the margin.
    weights: np.ndarray
    bias: float
    #: Slopes of the margins of the worst windows, and the offset of the logistic scale.
    scale: tuple[float, ...]

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(worst @ self.scale[:-1] + self.scale[-1], -30, 30)))


def worst_windows(sums: np.ndarray) -> np.ndarray:
    """The WORST largest of a text's window sums, in falling order; 0, as of words unlike all landmarks, where it has fewer."""
    out = np.zeros(WORST)
    top = -np.sort(-sums)[:WORST]
    out[: len(top)] = top
    return out


def landmark_matrix(landmarks: Landmarks) -> np.ndarray:
    """The kernel of each two landmarks."""
    known, weight = landmarks.words()
    return weight.T @ WordKernel(known).against(known) ** POWER @ weight


def nystroem(matrix: np.ndarray) -> np.ndarray:
    """The map from kernels with the landmarks: the inverse square root of their own matrix, on its large eigenvalues."""
    value, vector = np.linalg.eigh((matrix + matrix.T) / 2)
    large = value > RANK * value.max()
    return vector[:, large] / np.sqrt(value[large])


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps in the primal (Chapelle 2007)."""
    z, sign = np.hstack((x, np.ones((len(x), 1)))), np.where(y, 1.0, -1.0)
    c = cost * weight / weight.mean()
    regular = np.eye(z.shape[1])
    regular[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    loss = lambda w: w @ regular @ w / 2 + (c * np.maximum(1 - sign * (z @ w), 0) ** 2).sum()
    for _ in range(50):
        active = sign * (z @ w) < 1
        za, ca = z[active], c[active]
        gradient = regular @ w - 2 * za.T @ (ca * (sign[active] - za @ w))
        step = np.linalg.solve(regular + 2 * (za * ca[:, None]).T @ za, gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * (gradient @ step):
            size /= 2
        w = w - size * step
        if abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Slopes and offset of the scores by Newton's method on smoothed targets (Platt 1999)."""
    pos, neg = max(int(y.sum()), 1), max(int((~y).sum()), 1)
    goal = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.hstack((margins, np.ones((len(margins), 1))))
    start = np.zeros(z.shape[1])
    start[0] = 1.0
    b, ridge = start.copy(), np.diag([RIDGE] * margins.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, z.T @ (weight * (p - goal)) + ridge @ (b - start))
        b -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def grams(word: str) -> set[str]:
    """The runs of GRAM signs of the word, whose ends are signs of their own."""
    word = f"^{word}$"
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def _counts(batches: Iterator[pa.RecordBatch], of_words: bool) -> Iterator[pa.RecordBatch]:
    """key, toxic, clean: documents of a batch that hold the word, or the run of letters."""
    for batch in batches:
        found: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys = {w for s in sentences(text) for w in s}
            for k in keys if of_words else {g for w in keys for p in pieces(w) for g in grams(p)}:
                found.setdefault(k, [0, 0])[1 - toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (0, 1))], ["key", "toxic", "clean"])


def _around(batches: Iterator[pa.RecordBatch], good: frozenset[str], telling: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """doc_id, gram, n, sentence: the shortest window of a document around each of the runs of letters that it holds, and
    each of the telling words that it holds, by itself."""
    for batch in batches:
        out: dict[tuple[int, str], tuple[int, str]] = {}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cut_text = sentences(text)
            words = [w for s in cut_text for w in s]
            held = {w: good.intersection(g for p in pieces(w) for g in grams(p)) for w in set(words)}
            out.update({(doc, f"={w}"): (1, w) for w in telling.intersection(words)})
            _, begin, end = windows(np.array([len(s) for s in cut_text], np.int64))
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                for g in {g for w in words[a:b] for g in held[w]}:
                    one = (b - a, " ".join(words[a:b]))
                    if len(one[1]) <= LANDMARK_LETTERS:
                        out[doc, g] = min(one, out.get((doc, g), one))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.string()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.string())],
            ["doc_id", "gram", "n", "sentence"],
        )


def _first_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, sentence: the first window of each document that can be a landmark."""
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first = next((t for s in sentences(text) if len(t := " ".join(s[:WINDOW])) <= LANDMARK_LETTERS), None)
            if first:
                rows.append((doc, first))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "sentence"])


def choose_landmarks(sample: DataFrame, n_toxic: int, n_clean: int) -> Landmarks:
    """Words of the sample (doc_id, text, toxic), and sentences around runs of letters, that stand mostly in toxic documents, each
    next one with the most toxic documents without any so far, plus a twentieth of all its toxic documents, ties to the
    last run by code point; and some of clean documents, by the hash of the id."""
    counted = lambda of_words: sample.select("text", "toxic").mapInArrow(lambda b: _counts(b, of_words), "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = cut(counted(True), "word-counts")
    shared = words.where(F.col("clean") >= 0.02 * n_clean).orderBy(F.desc("clean"), "key").limit(CONSIDERED).collect()
    common = {r["key"]: (1 - min(r["clean"] / n_clean, 1.0)) ** 4 for r in shared}
    rate = F.col("toxic") / n_toxic
    good = (F.col("toxic") >= max(SUPPORT, SUPPORT_SHARE * n_toxic)) & (rate >= PRECISION * (rate + F.col("clean") / n_clean))
    runs, telling = (frozenset(r["key"] for r in keys.where(good).orderBy(F.desc("toxic"), "key").limit(CONSIDERED).collect()) for keys in (counted(False), words))
    telling = frozenset(w for w in telling if pieces(w))
    drop(words)
    found = cut(sample.where("toxic = 1").select("doc_id", "text").mapInArrow(lambda b: _around(b, runs, telling), "doc_id long, gram string, n long, sentence string"), "landmarks")
    where: dict[str, set[int]] = {}
    for r in found.select("gram", "doc_id").collect():  # PER_LABEL documents by CONSIDERED runs at most
        where.setdefault(r["gram"], set()).add(r["doc_id"])
    shortest = {r["gram"]: r["s"]["sentence"] for r in found.groupBy("gram").agg(F.min(F.struct("n", "sentence")).alias("s")).collect()}
    left, chosen = set().union(*where.values()) if where else set(), []
    while where and len(chosen) < TOXIC_LANDMARKS:
        best = max(where, key=lambda w: (len(where[w] & left) + len(where[w]) / 20, w))
        left -= where.pop(best)
        if (one := tuple(shortest[best].split())) not in chosen:
            chosen.append(one)
    clean = sample.where("toxic = 0").select("doc_id", "text").mapInArrow(_first_window, "doc_id long, sentence string")
    plain = [tuple(r["sentence"].split()) for r in clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CLEAN_LANDMARKS).collect()]
    drop(found)
    return Landmarks(tuple(dict.fromkeys(chosen + plain)), common)


def inserted(text: str) -> str:
    """The text with a letter put inside each word of five letters or more, both chosen by the word."""

    def one(m: re.Match) -> str:
        word, crc = m.group(), zlib.crc32(m.group().lower().encode())
        at = 1 + crc % (len(word) - 1)
        return word[:at] + chr(97 + crc // 64 % 26) + word[at:]

    return re.sub(r"[^\W\d_]{5,}", one, text)


def _window_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """doc_id, twin, toxic, x: the mapped windows of each document (doc_id, text, toxic, twin); those with the flag twin
    come a second time with letters put in."""
    landmarks, mapping = shared.value
    valuer = Valuer(landmarks, mapping)
    for whole in batches:
        for a in range(0, whole.num_rows, 25):
            doc, text, toxic, twin = (whole.column(i).slice(a, 25).to_pylist() for i in range(4))
            rows = [(d, False, y, t) for d, t, y in zip(doc, text, toxic, strict=True)] + [(d, True, y, inserted(t)) for d, t, y, z in zip(doc, text, toxic, twin, strict=True) if z]
            found = [x.astype(np.float16).tobytes() for _, x in valuer.texts([r[3] for r in rows])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array(found, pa.binary())], ["doc_id", "twin", "toxic", "x"])


def _worst(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of the windows of each row the one of the largest margin; a row without windows has zeros."""
    for batch in batches:
        out = []
        for x in batch.column(3):
            x = np.frombuffer(x.as_buffer(), np.float16).reshape(-1, len(weights))
            out.append((x[int((x.astype(np.float32) @ weights).argmax())] if len(x) else np.zeros(len(weights), np.float16)).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", "twin", "toxic", "x"])


def _tops(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The margins of the worst windows of each row by the machine that hasn't learned from its document."""
    for batch in batches:
        out = []
        for doc, x in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            k = _fold(doc)
            out.append((worst_windows(np.frombuffer(x.as_buffer(), np.float16).reshape(-1, weights.shape[1]).astype(np.float32) @ weights[k]) + bias[k]).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "twin", "toxic", "margins"])


def _fold(doc: int) -> int:
    return zlib.crc32(str(doc).encode()) // 7 % FOLDS


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Model | None:
    """A model from (doc_id, text) and (doc_id, toxic) where `train` holds; at most PER_LABEL documents of a label.

    Null ids and labels are left out; a doc_id with several labels counts with the largest, one with several texts with
    the first by code point. None if there is but one label, or no sentence to learn from.
    """
    spark = docs.sparkSession
    ship(spark)
    label = labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    label = label.where("toxic in (0, 1)")
    n, toxic = label.agg(F.count("*"), F.sum("toxic")).first()
    toxic = toxic or 0
    first = [first_by_hash(label.where(F.col("toxic") == v), "doc_id", PER_LABEL, m) for v, m in ((0, n - toxic), (1, toxic))]
    ids = spark.createDataFrame(first[0].union(first[1]).toPandas(), label.schema)
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    sample = cut(own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "toxicity-sample")
    size = dict(sample.groupBy("toxic").count().collect())
    if len(size) < 2:
        return None
    landmarks = choose_landmarks(sample, size[1], size[0])
    if not landmarks.words()[0]:
        return None
    mapping = nystroem(landmark_matrix(landmarks))
    # at first the sentence that is most like the toxic landmarks
    n_plain = len(landmarks.sentences) - min(len(landmarks.sentences), CLEAN_LANDMARKS)
    weights = np.linalg.pinv(mapping) @ np.r_[np.ones(n_plain), -np.ones(len(landmarks.sentences) - n_plain)] if n_plain else np.ones(mapping.shape[1])
    before, share, prior = [], size[1] / (size[0] + size[1]), toxic / max(n, 1)
    shared = spark.sparkContext.broadcast((landmarks, mapping))
    dealt = sample.select("doc_id", "text", "toxic", (hash_place("doc_id") < (1 << 30) * min(1.0, TWINS / (size[0] + size[1]))).alias("twin"))
    dealt = dealt.repartition(max(1, min(64, spark.sparkContext.defaultParallelism * 2)), "doc_id")
    rows = cut(dealt.mapInArrow(lambda b: _window_rows(b, shared), "doc_id long, twin boolean, toxic int, x binary"), "toxicity-windows")

    def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        return svm(x, y, np.where(y, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)))

    for _ in range(ROUNDS):
        got = rows.mapInArrow(lambda b, weights=weights: _worst(b, weights), rows.schema).toPandas().sort_values(["doc_id", "twin"])
        x, y = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(float), got["toxic"].to_numpy() == 1
        fold = np.array([_fold(d) for d in got["doc_id"]])
        before.append((x[~y], fold[~y]))
        clean, at = np.unique(np.vstack([b for b, _ in before]), axis=0, return_index=True)
        whole, truth = np.vstack((x[y], clean)), np.r_[np.ones(int(y.sum()), bool), np.zeros(len(clean), bool)]
        weights, bias = machine(whole, truth)
    # the scale is learned from margins of machines that haven't seen the document
    of = np.r_[fold[y], np.concatenate([f for _, f in before])[at]]
    parts = [machine(whole[of != k], truth[of != k]) if truth[of != k].any() and not truth[of != k].all() else (weights, bias) for k in range(FOLDS)]
    by_fold = np.stack([w for w, _ in parts]), np.array([c for _, c in parts])
    got = rows.mapInArrow(lambda b: _tops(b, *by_fold), "doc_id long, twin boolean, toxic int, margins array<double>").toPandas().sort_values(["doc_id", "twin"])
    y = got["toxic"].to_numpy() == 1
    drop(sample)
    drop(rows)
    scale = _logistic(np.stack(got["margins"]), y, np.where(y, prior / share, (1 - prior) / (1 - share)))
    return Model(landmarks, mapping @ weights, bias, scale)


def _score(batches: Iterator[pa.RecordBatch], at: int, shared) -> Iterator[pa.RecordBatch]:
    model: Model | None = shared.value
    kept = worker_tables("toxicity")
    key = (model.landmarks.sentences, model.weights.tobytes()) if model else None
    if model and key not in kept:
        kept.clear()
        kept[key] = Valuer(model.landmarks, model.weights[:, None])
    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            batch = whole.slice(a, 500)
            score = np.zeros(batch.num_rows)
            if model:
                worst = np.zeros((batch.num_rows, WORST))
                for i, sums in kept[key].texts(batch.column(at).to_pylist()):
                    worst[i] = worst_windows(sums[:, 0])
                score = model.score(worst + model.bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [str(i) for i in range(len(batch.columns) + 1)])


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1).

    A null text and an empty one have the score of a sentence that is unlike all landmarks; without a model all scores
    are 0. Texts count whole; repeated rows score alike; an empty table gives an empty result; a column of docs called
    toxicity is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(*[c for c in docs.columns if c.lower() != "toxicity"])
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text)
    return docs.mapInArrow(lambda b: _score(b, at, shared), T.StructType(list(docs.schema)).add("toxicity", "double"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out())
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
