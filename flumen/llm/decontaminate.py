"""Benchmark decontamination: MinHash containment search over size partitions, then exact containment.

An item is contained in a document if at least the asked share (0.8) of its distinct five-word
shingles stands in the document. Items are partitioned by their number of shingles, into classes that
double in size. Every class has an index of its own:

* The sketch of an item is bottom-k MinHash: its k least shingle hashes. An item of q shingles may miss
  floor(q / 5) of them, so k = floor(q / 5) + t: about a fifth of the item, and t (1 and one more for every
  32 shingles of the class's largest size) hits are needed.
* The sketch of a document for a class is its hashes up to the largest one of the class's sketches.
* A document is a candidate for an item if its sketch holds t hashes of the item's. A contained item always
  passes that, so the search loses nothing; candidates are then verified against all shingles of the item.

The items are the stated queries. They are searched in blocks of about ``block`` items and ``LONGEST_BLOCK``
characters at most, each a broadcast of bounded size, over all rows of the documents; within a block by one
scan. Rows of one item that repeat stand in a block once, with their number.

Texts and items are read whole, however long (a longer item than a block is a block of its own). Null or
empty items and texts hold no shingle and match nothing; a share of exactly 0.8 counts; repeated rows on
either side give repeated results; an empty table on either side gives no result, and then no document is
removed. Columns other than the ids and texts are not read by ``find_contained`` and kept, whatever their
names, by ``keep_clean``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches, pieces, text_chunks
from .shingles import shingle_hashes, shingle_sets

NUMERATOR, DENOMINATOR = 4, 5
BLOCK = 200_000
LONGEST_BLOCK = 1 << 25
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def allowed_missing(q: int) -> int:
    """Shingles that a contained item of q shingles may lack."""
    return q - -(-q * NUMERATOR // DENOMINATOR)


def size_class(q: int) -> int:
    """The largest size of the class that q belongs to."""
    return 1 << max(0, q - 1).bit_length()


def sketch_length(q: int) -> int:
    return min(q, allowed_missing(q) + 1 + size_class(q) // 32)


class Index:
    """Sketches of the items of one size class."""

    def __init__(self, numbers: list[int], sets: list[np.ndarray]):
        lengths = [sketch_length(len(s)) for s in sets]
        hashes = np.concatenate([s[:k] for s, k in zip(sets, lengths, strict=True)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], np.repeat(np.arange(len(sets)), lengths)[order]
        self.numbers = np.array(numbers)
        self.needed = np.array([k - allowed_missing(len(s)) for s, k in zip(sets, lengths, strict=True)])
        self.upto = self.hashes[-1]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def candidates(self, runs: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) numbers with enough hits of the sketches, from shingle hashes and the texts they stand in."""
        near = np.flatnonzero(runs <= self.upto)
        near = near[self.filter[(runs[near] & np.uint64(0xFFFFF)).astype(np.int64)]]
        left = np.searchsorted(self.hashes, runs[near])
        there = self.hashes[np.minimum(left, len(self.hashes) - 1)] == runs[near]
        near, left = near[there], left[there]
        if not len(near):
            return near, near
        # a hash counts once a text: the place of its first owner names it
        key = np.unique(texts[near] * len(self.hashes) + left)
        text, left = key // len(self.hashes), key % len(self.hashes)
        width = np.searchsorted(self.hashes, self.hashes[left], side="right") - left
        owner = self.owners[np.repeat(left - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        pairs, hits = np.unique(np.repeat(text, width) * len(self.numbers) + owner, return_counts=True)
        text, owner = pairs // len(self.numbers), pairs % len(self.numbers)
        enough = hits >= self.needed[owner]
        return text[enough], self.numbers[owner[enough]]


class Sketches:
    """A block of items: their shingle sets, and an index for each size class."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]]):
        items = [x for x in items if len(x[2])]
        self.ids, self.times, self.sets = [x[0] for x in items], [x[1] for x in items], [x[2] for x in items]
        classes = defaultdict(list)
        for n, s in enumerate(self.sets):
            classes[size_class(len(s))].append(n)
        self.classes = [Index(numbers, [self.sets[n] for n in numbers]) for _, numbers in sorted(classes.items())]

    def search(self, texts: list) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, shared shingles) of the items that the texts contain."""
        for a, b in text_chunks(texts):
            runs = shingle_hashes(texts[a:b])
            every, of = np.concatenate(runs), np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            for index in self.classes:
                for text, n in zip(*(x.tolist() for x in index.candidates(every, of)), strict=True):
                    shared = int(np.isin(self.sets[n], runs[text]).sum())
                    if DENOMINATOR * shared >= NUMERATOR * len(self.sets[n]):
                        yield a + text, n, shared


def _item_blocks(items: DataFrame, block: int) -> Iterator[Sketches]:
    """The items, in blocks; a block's rows are fetched together, never all blocks at once."""
    rows = items.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-count // block), -(-size // LONGEST_BLOCK))
    for part in range(parts):
        here = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        got = here.collect()
        yield Sketches([(r["item_id"], r["times"], s) for r, s in zip(got, shingle_sets([r["text"] for r in got]), strict=True)])


def _search_block(docs: DataFrame, sketches: Sketches) -> DataFrame:
    shared_sketches = docs.sparkSession.sparkContext.broadcast(sketches)

    def run(batch: pa.RecordBatch) -> dict:
        sketches = shared_sketches.value
        ids = batch.column("doc_id").to_pylist()
        out: dict = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        for text, n, shared in sketches.search(batch.column("text").to_pylist()):
            size = len(sketches.sets[n])
            for name, value in zip(out, (ids[text], sketches.ids[n], size, shared, shared / size), strict=True):
                out[name] += [value] * sketches.times[n]
        return out

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def find_contained(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of all contained items."""
    out = None
    for sketches in _item_blocks(items, block):
        found = _search_block(docs, sketches)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents, all columns, that contain no item."""
    at = docs.columns.index("text")
    for sketches in _item_blocks(items, block):

        def run(batches, shared_sketches=docs.sparkSession.sparkContext.broadcast(sketches)):
            for batch in pieces(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[text for text, _, _ in shared_sketches.value.search(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, run, docs.schema)
    return docs


#: The same by DuckDB, from plain word lists.
ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM d)),
its AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM i)),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS BIGINT) AS n_shared,
       CAST(n_shared AS DOUBLE) / CAST(n_item AS DOUBLE) AS containment
FROM x JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item"""
