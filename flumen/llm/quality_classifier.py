"""Document quality by compression.

Two zstandard dictionaries are trained by the library from labelled text, one of good documents and one of
bad ones. A text is cut into blocks of ``BLOCK`` bytes, so short that a text which repeats itself cannot
serve as its own dictionary, and every block is compressed with either dictionary. The normalised
difference of the two total sizes, (bad - good) / (bad + good), is positive where the good dictionary
fits better; ``DAMPING`` bytes of the usual difference of good texts are added, so that a few bytes of a very
short text are no strong evidence. A logistic curve, which never falls, turns it into the score. The sample is halved:
dictionaries of either half measure the other one for the curve, so no document is measured by a
dictionary that has seen it; dictionaries of the whole sample score.

Labels are learned from documents that are not held out. Three parameters bound the fit: at most ``sample``
documents a label, chosen by hash, those among them of at most ``longest`` characters, and ``dictionary`` bytes
of a dictionary, which the library picks from all blocks of these. Scoring reads whole texts, however long. Null texts count as empty; an empty text has
the usual difference and gets the curve's value there. Without labels of both kinds every score is 0.5. A score of
exactly the threshold counts as good. Repeated rows give repeated results; a document with two different
labels is not learned from, of several rows of one id the least text is. An empty table gives an empty
result. Other columns are not read by ``score_documents`` and kept, whatever their names, by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import fit_line, sigmoid
from .common import is_held_out, is_learnable, map_arrow, map_batches, pieces
from .sampling import least_hashes

BLOCK = 64
THRESHOLD = 0.7
SAMPLE = 1024
DICTIONARY = 112 << 10
LONGEST = 1 << 16
DAMPING = 40
LEVEL = 3


def blocks(text: str | None) -> list[bytes]:
    """The whole text in UTF-8, in pieces of BLOCK bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def build_dictionary(texts: list[str], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """A dictionary of at most ``size`` bytes for the blocks of the texts; of all of them if they are too few to train on."""
    samples = [b for t in texts for b in blocks(t) if len(b) >= 8]
    order = np.random.default_rng(1).permutation(len(samples))
    samples = [samples[i] for i in order]
    try:
        found = zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        found = zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return found


class Differ:
    """Compresses with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def measure(self, text: str | None, usual: float) -> float:
        """Normalised difference of the sizes, positive for good texts; of a very short text mostly the ``usual`` one."""
        good = bad = 0
        for b in blocks(text):
            good += len(self.both[0].compress(b))
            bad += len(self.both[1].compress(b))
        return (bad - good + DAMPING * usual) / (bad + good + DAMPING)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dictionary: int = DICTIONARY, longest: int = LONGEST) -> tuple[bytes, bytes, float, float, float] | None:
    """(good dictionary, bad dictionary, usual difference, slope and offset of the curve), or None without labels of both kinds."""
    rows = labels.where(is_learnable() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    keys = least_hashes(rows, "quality", "doc_id", sample)
    if len({q for q, _ in keys}) < 2:
        return None
    chosen = rows.where(F.xxhash64("doc_id").isin([h for _, h in keys])).groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    known = {r["doc_id"]: r["most"] for r in chosen.collect() if r["least"] == r["most"]}
    # one text for an id, even if the id stands in many rows
    texts = docs.where(F.col("doc_id").isin(list(known)) & (F.length("text") <= longest)).groupBy("doc_id").agg(F.min("text").alias("text"))
    parts: dict = {0: ([], []), 1: ([], [])}
    for r in sorted(texts.collect(), key=lambda r: r["doc_id"]):
        side = parts[known[r["doc_id"]]]
        side[len(side[0]) > len(side[1])].append(r["text"])
    if any(not p for side in parts.values() for p in side):
        return None
    return fit(parts[1], parts[0], dictionary)


def fit(good: tuple[list[str], list[str]], bad: tuple[list[str], list[str]], dictionary: int = DICTIONARY) -> tuple[bytes, bytes, float, float, float]:
    """The same from the halves of the good and of the bad texts."""
    content = lambda texts: build_dictionary(texts, dictionary).as_bytes()
    differs = [Differ(content(good[half]), content(bad[half])) for half in (0, 1)]
    usual = float(np.median([differs[half].measure(t, 0.0) for half in (0, 1) for t in good[1 - half]]))
    x, y = [], []
    for half, differ in enumerate(differs):
        for label, side in ((0.0, bad), (1.0, good)):
            x += [differ.measure(t, usual) for t in side[1 - half]]
            y += [label] * len(side[1 - half])
    slope, offset = fit_line(np.array(x), np.array(y))
    return content(good[0] + good[1]), content(bad[0] + bad[1]), usual, max(0.0, slope), offset


def scorer(fitted):
    """A function from texts to scores."""
    if fitted is None:
        return lambda texts: [0.5] * len(texts)
    good, bad, usual, slope, offset = fitted
    differ = Differ(good, bad)
    return lambda texts: sigmoid(slope * np.array([differ.measure(t, usual) for t in texts]) + offset).tolist()


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, dictionary: int = DICTIONARY, longest: int = LONGEST) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    fitted = train(docs, labels, sample, dictionary, longest)

    def run(batch: pa.RecordBatch) -> dict:
        scores = scorer(fitted)(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_batches(docs.select("doc_id", is_held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, dictionary: int = DICTIONARY, longest: int = LONGEST) -> DataFrame:
    """The documents, all columns, that score ``threshold`` or more."""
    fitted = train(docs, labels, sample, dictionary, longest)
    at = docs.columns.index("text")

    def run(batches):
        score = scorer(fitted)
        for batch in pieces(batches):
            keep = [s >= threshold for s in score(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
