"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n of a blended spectrum) that both have,
presence only, divided by the root of the product of their own counts. N-grams are taken over
lower-cased text in which runs of other characters than letters count as one space. Nyström landmarks
are labelled texts; the n-grams that at least two landmarks have are the kernel's alphabet. One ridge
regression a language (one versus rest) is fitted on the landmark features of a bounded sample.

Scoring is by matrix products over batches. Kernel values times the ridge weights are a sum over n-grams,
so landmarks and weights are folded into one table of n-grams by languages; presence of n-grams times that
table gives one margin a language.

Learning uses documents that are not held out and have a language. Three parameters bound it: at most
``sample`` texts a language, chosen by the hash of their text, of at most ``longest`` characters each (longer
texts are predicted like all others, but not learned from), ``landmarks`` of them landmarks.
Null texts and texts without a letter (Unicode category L) get ``und`` and score 0; so do all texts if there
is nothing to learn from. Texts are read whole, however long. Ties go to the language first in order.
Repeated rows give repeated results, an empty table an empty one, and other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, is_learnable, map_batches, text_chunks
from .sampling import least_hashes
from .shingles import mix

SIZES = (2, 3, 4)
SAMPLE = 192
LANDMARKS = 40
LONGEST = 1 << 16
CELLS = 1 << 22
RIDGE = 0.05
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_rng = np.random.default_rng(11)
_PLACE = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def has_letter(text: str | None) -> bool:
    return any(unicodedata.category(m.group())[0] == "L" for m in _LETTER.finditer(text or ""))


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit codes of the n-grams of a row of code points."""
    count = max(0, len(codes) - n + 1)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h += codes[k : k + count].astype(np.uint64) * _PLACE[k]
    return mix(h)


def normalised(text: str) -> str:
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """N-grams with numbers, found through an open table of hash slots."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        self.bits = max(10, int(self.size * 8 - 1).bit_length()) if self.size else 10
        # keys whose slot is taken by another go to a second, sorted list
        slots = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.key, self.number = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        _, first = np.unique(slots, return_index=True)
        self.key[slots[first]], self.number[slots[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(self.size), first)
        order = np.argsort(keys[rest])
        self.more, self.more_number = keys[rest][order], rest[order].astype(np.int32)
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[slots[rest]] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the n-grams in the alphabet, and their places in ``h``."""
        slots = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = np.flatnonzero((self.key[slots] == h) & (self.number[slots] >= 0))
        numbers = self.number[slots[hit]]
        if len(self.more):
            other = np.flatnonzero(self.crowded[slots])
            at = np.minimum(np.searchsorted(self.more, h[other]), len(self.more) - 1)
            found = self.more[at] == h[other]
            numbers, hit = np.concatenate([numbers, self.more_number[at[found]]]), np.concatenate([hit, other[found]])
        return numbers, hit


class Kernel:
    def __init__(self, landmarks: list[str], sizes=SIZES):
        self.sizes = sizes
        sets = [np.unique(np.concatenate([grams(codes_of(normalised(t)), n) for n in sizes])) for t in landmarks]
        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        self.alphabet = Alphabet(keys[counts > 1] if (counts > 1).any() else keys)
        p = np.concatenate([*self.presence(landmarks), np.empty((0, self.alphabet.size), np.float32)])
        self.landmarks = (p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))).T.copy()

    def presence(self, texts: list[str]):
        """Blocks of texts x alphabet, 1 where the text has the n-gram."""
        step = max(1, CELLS // max(1, self.alphabet.size))
        for start in range(0, len(texts), step):
            parts = [normalised(t) for t in texts[start : start + step]]
            out = np.zeros((len(parts), self.alphabet.size), np.float32)
            codes = codes_of("".join(parts))
            ends = np.cumsum([len(p) for p in parts])
            rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            for n in self.sizes:
                numbers, at = self.alphabet.find(grams(codes, n))
                inside = at + n <= ends[rows[at]]
                out[rows[at[inside]], numbers[inside]] = 1
            yield out

    def times(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        """Presence, divided by the root of its count, times a table of n-grams."""
        blocks = [(p @ table) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1)) for p in self.presence(texts)]
        return np.concatenate([*blocks, np.empty((0, table.shape[1]), np.float32)])

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Kernel values, texts x landmarks."""
        return self.times(texts, self.landmarks)


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(kernel, table of n-grams by languages, languages) from (language, text) rows, or None without a row."""
    rows = [(lang, t) for lang, t in rows if has_letter(t)]
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    chosen: list[str] = []
    for lang in languages:
        chosen += [t for x, t in rows if x == lang][:landmarks]
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh(kernel(chosen).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel([t for _, t in rows]).astype(np.float64) @ root
    y = np.array([[1.0 if lang == other else -1.0 for other in languages] for lang, _ in rows])
    weight = np.array([1 / sum(o == lang for o, _ in rows) for lang, _ in rows])[:, None] * len(rows) / len(languages)
    w = np.linalg.solve(x.T @ (x * weight) + ridge * np.eye(x.shape[1]), x.T @ (y * weight))
    return kernel, (kernel.landmarks @ (root @ w)).astype(np.float32), languages


def predict(fitted, texts: list) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if fitted is None:
        return langs, scores
    kernel, table, languages = fitted
    there = [i for i, t in enumerate(texts) if has_letter(t)]
    for a, b in text_chunks([texts[i] for i in there], 1 << 18):
        part = there[a:b]
        margins = kernel.times([texts[i] for i in part], table)
        best = margins.argmax(axis=1)
        for i, k, m in zip(part, best.tolist(), margins.max(axis=1).tolist(), strict=True):
            langs[i], scores[i] = languages[k], min(1.0, max(0.0, (m + 1) / 2))
    return langs, scores


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, longest: int = LONGEST):
    """Fitted on at most ``sample`` texts a language, among documents that are not held out."""
    rows = docs.where(is_learnable() & F.col("lang").isNotNull() & (F.length("text") <= longest)).select("lang", "text")
    keys = least_hashes(rows, "lang", "text", sample)
    if not keys:
        return None
    known = set(keys)
    picked = rows.where(F.xxhash64("text").isin([h for _, h in keys])).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    fitted = fit([(r["lang"], r["text"]) for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["h"])) if (r["lang"], r["h"]) in known], landmarks)
    if fitted:
        fitted[0].landmarks = None  # folded into the table
    return fitted


def predict_languages(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, longest: int = LONGEST) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    fitted = train(docs, sample, landmarks, longest)

    def run(batch: pa.RecordBatch) -> dict:
        langs, scores = predict(fitted, batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": scores}

    return map_batches(docs.select("doc_id", is_held_out().alias("held_out"), "text"), run, SCHEMA)
