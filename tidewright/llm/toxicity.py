"""A toxicity classifier: a convolution over hashed word embeddings with several filter widths and max pooling.

A word's embedding is that of its hash plus that of its first letters.  Filters of one, two and three words slide over
the text, the greatest response of each counts, and a linear layer gives the logit.  All is trained in numpy on a bounded
sample of the labelled rows.  Each third of the sample is also scored by a model of the other two thirds; these logits
calibrate a temperature and, for each language guessed from the text's own function words, a threshold.  In a language's
threshold its own rows count fully and those of all others together as ``BORROWED`` rows would, so that every language has
one, near the common one where it has few rows of label 1.  The score is shifted so that every threshold is at 0.7.

Defined results: null and empty texts, and texts without a word, get the share of label 1 among the labelled rows; without labelled rows of both kinds
every score is the share of label 1 (0 without rows); repeated rows get equal scores; a null id is not held out; texts in
none of the languages told apart share a threshold; of languages with as many function words the first counts; very long
texts are read whole, in parts; labels, the lang column, source and id do not enter a score; further columns, also of the
same names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tidewright.llm.common import LONGEST
from tidewright.llm.learning import Adam, folds, sample, sigmoid, temperature
from tidewright.llm.quality import parts_of, score

SAMPLE, MOST_BYTES = 2_500, 1 << 25  # bounds of the rows of each label that a fit uses, and of the bytes of their word ids
FOLDS, BORROWED = 3, 10
CUT = 0.7
BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 14, 16, 16, (1, 2, 3)
WORD = re.compile(r"[^\W_]+")
# Frequent function words of the languages that are told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are as with he be at by this from or an have not but",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er",
    "fr": "le de un et les des en du une que est pour qui dans par plus pas au sur se ne avec il ce sont",
    "es": "el de la que y los del se las por un para con no una su al lo como más pero sus le ya o",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


@lru_cache(1)
def language_bits() -> dict[str, int]:
    bits: dict[str, int] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            bits[w] = bits.get(w, 0) | 1 << k
    return bits


def word_ids(word: str) -> tuple[int, int, int]:
    return known_ids(word) if len(word) <= LONGEST else hashed_ids(word)


@lru_cache(1 << 16)
def known_ids(word: str) -> tuple[int, int, int]:
    return hashed_ids(word)


def hashed_ids(word: str) -> tuple[int, int, int]:
    """The buckets of a word and of its first letters, and the languages of which it is a function word."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word) % BUCKETS, BUCKETS + xxhash.xxh3_64_intdigest(word[:6], 1) % BUCKETS, language_bits().get(word, 0)


def ids_of(text: str) -> np.ndarray:
    """Word buckets, prefix buckets and language bits, one after the other."""
    rows = [np.array([word_ids(w) for w in WORD.findall(part)], np.int32).reshape(-1, 3) for part in parts_of(text.lower())]
    return np.concatenate(rows).T.ravel()


def language(bits: np.ndarray) -> int:
    """The language with the most function words (the first of equal ones), or the last entry if there are none."""
    counts = [int((bits >> k & 1).sum()) for k in range(len(FUNCTION_WORDS))]
    return int(np.argmax(counts)) if any(counts) else len(LANGUAGES) - 1


def responses(words: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each filter the greatest response in a text, and where it is (-1: the text is shorter than the filter)."""
    n = len(words) // 3
    best, at = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, -1)
    if not n:
        return best, at
    all_filters = p["filters"]
    for lo in range(0, n, 8192):  # long texts in overlapping parts, so memory is bounded
        cut = slice(lo, min(n, lo + 8192 + max(WIDTHS) - 1))
        x = p["words"][words[:n][cut]] + p["words"][words[n : 2 * n][cut]]
        projected, column = x @ all_filters, 0
        for k, width in enumerate(WIDTHS):
            m = len(x) - width + 1
            if m > 0:
                r = projected[:m, column : column + FILTERS].copy()
                for j in range(1, width):
                    r += projected[j : j + m, column + j * FILTERS : column + (j + 1) * FILTERS]
                i = r.argmax(axis=0)
                v = r[i, np.arange(FILTERS)] + p["bias"][k * FILTERS : (k + 1) * FILTERS]
                mine = slice(k * FILTERS, (k + 1) * FILTERS)
                better = v > best[mine]
                best[mine] = np.where(better, v, best[mine])
                at[mine] = np.where(better, i + lo, at[mine])
            column += width * FILTERS
    return best, at


def leaning(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How much more often texts of label 1 hold each bucket, in bounded standard errors: a start for the embeddings."""
    counts = np.zeros((2, 2 * BUCKETS))
    for words, label in zip(docs, y.astype(int), strict=True):
        counts[label, np.unique(words[: 2 * (len(words) // 3)])] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    share = (counts.sum(axis=0) + 1) / (n.sum() + 2)
    z = (counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n).sum())
    return np.clip(z / 4, -1, 3).astype(np.float32)


def train(docs: list[np.ndarray], y: np.ndarray, seed: int, epochs: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n_filters = sum(WIDTHS) * FILTERS
    p = {
        "words": rng.normal(0, 0.1, (2 * BUCKETS, WIDTH)).astype(np.float32),
        "filters": rng.normal(0, 0.3, (WIDTH, n_filters)).astype(np.float32),
        "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32),
        "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        "base": np.array([np.log(y.mean() / (1 - y.mean()))], np.float32),
    }
    p["words"][:, 0] += leaning(docs, y)
    p["filters"][0, :2] += 1.0  # two filters begin with it
    p["out"][:2] = 0.5
    adam = Adam(p, 5e-3)
    columns = np.concatenate([np.full(FILTERS, w * FILTERS) for w in np.concatenate(([0], np.cumsum(WIDTHS)[:-1]))]) + np.tile(np.arange(FILTERS), len(WIDTHS))
    span = np.repeat(WIDTHS, FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(docs), 64):
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            rows = order[i : i + 64]
            for r in rows:
                words = docs[r]
                n = len(words) // 3
                best, at = responses(words, p)
                d = float(sigmoid(best @ p["out"] + p["base"][0]) - y[r]) / len(rows)
                grads["out"] += d * best
                grads["base"] += d
                live = np.flatnonzero(at >= 0)
                back = d * p["out"][live]
                grads["bias"][live] += back
                for j in range(max(WIDTHS)):
                    use = span[live] > j
                    f, place = live[use], at[live[use]] + j
                    c = columns[f] + j * FILTERS
                    a, b = words[:n][place], words[n : 2 * n][place]
                    x = p["words"][a] + p["words"][b]
                    grads["filters"][:, c] += (x * back[use][:, None]).T
                    g = p["filters"][:, c].T * back[use][:, None]
                    np.add.at(grads["words"], a, g)
                    np.add.at(grads["words"], b, g)
            adam.step(grads)
    return p


def threshold(logits: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The logit between two rows that gives the best F1 of weighted rows."""
    order = np.argsort(-logits, kind="stable")
    z, t, w = logits[order], y[order], weights[order]
    hits, taken = np.cumsum(t * w), np.cumsum(w)
    k = int(np.argmax(2 * hits / (taken + (t * w).sum())))
    return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)


class Model:
    """Embeddings, filters, temperature and thresholds; its size does not grow with the data."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], weight: float = 1.0, seed: int = 13):
        y = np.array([r[1] for r in rows], np.float64)
        self.prior = float(y.sum() / (y.sum() + weight * (len(y) - y.sum()))) if len(y) else 0.0
        self.params: dict[str, np.ndarray] | None = None
        if len(y) and 0 < self.prior < 1:
            docs, fold = [r[2] for r in rows], folds(np.array([r[0] for r in rows]), FOLDS)
            z, lang = np.zeros(len(y)), np.zeros(len(y), int)
            for k in range(FOLDS):
                rest = fold != k
                own = train([d for d, r in zip(docs, rest, strict=True) if r], y[rest], seed) if 0 < y[rest].sum() < rest.sum() else None
                for i in np.flatnonzero(~rest):
                    z[i], lang[i] = logit(docs[i], own) if own else 0.0, language(docs[i][2 * (len(docs[i]) // 3) :])
            self.params = train(docs, y, seed)
            self.temperature = temperature(z, y, weight)
            share = np.where(y == 1, 1.0, weight)
            others = lambda k: BORROWED / (BORROWED + y[lang != k].sum())
            self.thresholds = np.array([threshold(z, y, share * np.where(lang == k, 1.0, others(k))) for k in range(len(LANGUAGES))])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.params is None:
            return np.full(len(texts), self.prior)
        ids = [ids_of(t) for t in texts]
        z, lang = np.array([logit(i, self.params) for i in ids]), np.array([language(i[2 * (len(i) // 3) :]) for i in ids])
        out = sigmoid((z - self.thresholds[lang]) / self.temperature + np.log(CUT / (1 - CUT)))
        return np.where([len(i) > 0 for i in ids], out, self.prior)


def logit(words: np.ndarray, params: dict[str, np.ndarray]) -> float:
    return float(responses(words, params)[0] @ params["out"] + params["base"][0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", seed: int = 13) -> Model:
    rows, weight = sample(docs, labels, label, bound, id_col, text_col, lambda texts: [ids_of(t).astype("<i4").tobytes() for t in texts], MOST_BYTES)
    return Model([(i, y, np.frombuffer(x, "<i4")) for i, y, x in rows], weight, seed)


__all__ = ["CUT", "Model", "fit", "score"]
