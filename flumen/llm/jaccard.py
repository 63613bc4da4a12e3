"""N-gram Jaccard join with set relations: documents whose shingle sets are alike, exactly.

Two documents link if 100 * |A and B| >= 80 * |A or B| over their distinct five-word shingles. The
join returns classes and connected components of links; no link between different sets is lost.

1. Sets. Documents of equal sets form a class, known by two 64-bit names of the set (among n classes two
   share both by chance with probability n*n / 2**129); a class whose first name another one has too is
   named anew. The rest works on classes.
2. Order. Shingles are ordered rare before common, by hash among themselves. Common are those in
   about one in 16384 documents or more, and of these the most frequent if they are more than
   ``MOST_COMMON``. Linked sets of n shingles share two or more of the first
   n - ceil(0.8 n) + 2 of either (prefix filter; any order is right, this one keeps lists short).
3. Index. The lists of rare shingles are cut into slices of the hash space and searched slice by slice;
   lists of common ones are aggregated by key. A list falls into blocks by the sizes of its sets, so that sets
   too different in size to be linked are skipped: sizes are cut by the power of 1.25 below them, and a set
   stands in the block of its power and in the next one, so that linked sets meet in one at least. Each block
   yields star pairs only: its pivot, the set that has the shingle at the earliest position, with each other
   set of the block. So a group of near copies gives pairs in proportion to its size. Lists of a few sets give
   those of their pairs, for which size and position in the two sets leave room for enough shared shingles;
   the set of smaller name counts as their pivot. Pairs are weighed by the number of lists.
4. Linked sets share ``_needed`` lists. Star pairs with so many are verified by exact intersection; their
   links give first components.
5. Set relations. Pairs inside one component need no answer. Two other sets x, y share at most the fewer
   lists of either under each pivot; summed over pivots that must reach what linked sets need. Pivots are
   ordered by their members: under the first pivot that both stand under, either must still have that many
   lists, there and under later pivots. So a set is looked for under a pivot of many members only if it
   shares that many lists with such pivots, and sets that share a common phrase with a pivot are not
   paired. If both were verified against p, |x and y| lies between |x and p| + |y and p| - |p| and
   min(|x and p|, |y and p|) + min(|x - p|, |y - p|): the lower bound accepts, the upper one rejects.
   Only what remains is verified.

Texts are read whole, however long. Null or empty texts and texts without words have the empty set, which
links with nothing. Null ids are kept and never named as a component if another id is there. Ids that
stand in several rows count as documents of their own until the ids are reported, repeated rows give
repeated results, and a similarity of exactly 0.8 links. An empty table gives an empty result. Other
columns are not read by ``link_documents`` and kept, whatever their names, by ``keep_one``.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_folder, map_arrow, map_batches, pieces, release, shared_folder, stored, text_chunks
from .components import connected_components
from .shingles import named_sets, shingle_sets

NUMERATOR, DENOMINATOR = 4, 5
#: A shingle is common from this share of the documents on.
COMMON = 16_384
#: And so many shingles are at most, which are broadcast: 32 MB.
MOST_COMMON = 1 << 22
COUNTED = 1 << 22
FLUSH = 1 << 19
SETS = "doc_id long, n int, class long, again long, packed binary, token long, seen int"
ENTRIES = "slice int, entries binary, token long, at int, class long, n int"
FOUND = "p long, m long, np int, nm int, w long, token long, at int, class long, n int"
#: An index entry: 48 more bits of a shingle below those that name its slice (two shingles taken for one
#: only add a candidate), the position, which counts up to 65535, the class and its size.
_ENTRY = np.dtype([("high", "<u4"), ("low", "<u2"), ("at", "<u2"), ("cls", "<i8"), ("n", "<i4")])
#: Lists up to this length give pairs that are tested by position one by one.
SHORT = 4
_LAST = 65_535
#: Members of a pivot that are compared with each other in one task.
TOGETHER = 4096


#: Shared shingles of linked sets that stand in both prefixes at least, by the prefix's length.
SPARE = 2
#: No more than ``_needed`` of any two sets that can be linked.
LEAST_NEEDED = 2


#: Logarithm of the width of a size block; a little more than 1.25, so that rounding cannot part linked sets.
BLOCK_WIDTH = math.log(1.25001)


def size_blocks(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / BLOCK_WIDTH).astype(np.int64)


def prefix_length(n: int) -> int:
    return min(n, n - -(-n * NUMERATOR // DENOMINATOR) + SPARE)


def _batches(rows: list[dict], schema: pa.Schema, size: int = 4096):
    for a in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[a : a + size], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def make_sets(docs: DataFrame) -> DataFrame:
    """A row for each document; its packed text once a class and task; then counts of shingles.

    A shingle is counted where two or more of a few thousand documents of a task hold it.
    """
    schema = _arrow(SETS)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        known: set = set()
        held, size = [], 0

        def counts():
            tokens, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= 2
            out = {"token": pa.array(tokens[often].view(np.int64)), "seen": pa.array(seen[often].astype(np.int32))}
            return pa.RecordBatch.from_arrays([out.get(f.name, pa.nulls(int(often.sum()), f.type)) for f in schema], schema=schema)

        for batch in pieces(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in text_chunks(texts):
                rows = []
                for doc_id, text, (s, name, again) in zip(ids[a:b], texts[a:b], named_sets(texts[a:b]), strict=True):
                    fresh = name is not None and (name, again) not in known
                    if fresh:
                        known.add((name, again))
                        held.append(s)
                        size += len(s)
                    rows.append({"doc_id": doc_id, "n": len(s), "class": name, "again": again, "packed": pack.compress(text.encode("utf-8", "surrogatepass")) if fresh else None})
                yield from _batches(rows, schema)
                if size >= COUNTED:
                    yield counts()
                    held, size = [], 0
        if held:
            yield counts()

    return map_arrow(docs.select("doc_id", "text"), run, SETS)


def rename_clashing(table: DataFrame, folder: str) -> DataFrame:
    """``table`` with a name of its own for every class: of classes that share one all but one change it."""
    pairs = stored(table.where("class IS NOT NULL").groupBy("class").agg(F.min("again").alias("first"), F.max("again").alias("last")).where("first <> last").select("class", "first"), folder, "clashing")
    if pairs.isEmpty():
        return table
    renamed = table.join(pairs, "class", "left").withColumn("class", F.expr("IF(again > first, xxhash64(class, again), class)"))
    return stored(renamed.select(table.columns), folder, "renamed")


class Order:
    """Rare shingles first."""

    def __init__(self, common: np.ndarray):
        self.common = np.sort(common)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.common >> np.uint64(44)).astype(np.int64)] = True

    def is_common(self, s: np.ndarray) -> np.ndarray:
        out = self.filter[(s >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.common, s[maybe]), len(self.common) - 1)
            out[maybe] = self.common[at] == s[maybe]
        return out

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a set: rare ones, common ones."""
        p = prefix_length(len(s))
        common = self.is_common(s)
        rare = s[~common][:p]
        return rare, s[common][: p - len(rare)]


def _entries(sets: DataFrame, shared_order, bits: int) -> DataFrame:
    """The prefixes of the packed sets, in one pass: rare shingles as (slice, entries), common ones as (slice, token, at, class, n).

    Rare ones are cut by the leading bits of the shingle; common ones, which stand in prefixes only of sets that are
    made of them, are dealt out by class, so that a shingle of very many sets is no slice.
    """
    schema = _arrow(ENTRIES)

    def made(rows: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches):
        order, unpack = Order(shared_order.value), zstandard.ZstdDecompressor()
        known: set = set()
        parts, size = [], 0

        def flush():
            tokens = np.concatenate([t for t, _, _ in parts])
            order = np.argsort(tokens, kind="stable")
            tokens, widths = tokens[order], [len(t) for t, _, _ in parts]
            rest = tokens << np.uint64(bits)
            e = np.empty(len(tokens), _ENTRY)
            e["high"], e["low"] = rest >> np.uint64(32), (rest >> np.uint64(16)) & np.uint64(0xFFFF)
            e["cls"] = np.repeat(np.array([c for _, c, _ in parts], np.int64), widths)[order]
            e["n"] = np.repeat(np.array([n for _, _, n in parts], np.int32), widths)[order]
            e["at"] = np.minimum(np.concatenate([np.arange(w) for w in widths]), _LAST)[order]
            where = (tokens >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(where, prepend=-1, append=1 << bits))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            for k in range(0, len(spans), 4096):
                here = spans[k : k + 4096]
                yield made(len(here), {"slice": [int(where[a]) for a, _ in here], "entries": [e[a:b].tobytes() for a, b in here]})

        for batch in pieces(batches):
            names, packed = batch.column("class").to_pylist(), batch.column("packed").to_pylist()
            texts = [unpack.decompress(x).decode("utf-8", "surrogatepass") for x in packed]
            for a, b in text_chunks(texts):
                for name, s in zip(names[a:b], shingle_sets(texts[a:b]), strict=True):
                    if name in known:
                        continue
                    known.add(name)
                    rare, common = order.prefix(s)
                    if len(common):
                        k = len(common)
                        at = np.arange(len(rare), len(rare) + k)
                        yield made(k, {"slice": np.full(k, name & ((1 << bits) - 1)), "token": common.view(np.int64), "at": at, "class": np.full(k, name, np.int64), "n": np.full(k, len(s))})
                    if len(rare):
                        parts.append((rare, name, len(s)))
                        size += len(rare)
                if size >= FLUSH:
                    yield from flush()
                    parts, size = [], 0
        if size:
            yield from flush()

    return map_arrow(sets, run, ENTRIES)


def _rare_pairs(entries: DataFrame) -> DataFrame:
    """Star pairs (p, m, np, nm, w) of the lists of rare shingles, slice by slice; w counts the lists. Entries of common ones pass."""
    schema = _arrow(FOUND)

    def few(token, at, cls, n):
        """All pairs of short lists that may be linked: alike in size, and at places that leave enough to share."""
        found = []
        for d in range(1, SHORT):
            i, j, x, y = at[:-d].astype(np.int64), at[d:].astype(np.int64), n[:-d], n[d:]
            most = np.minimum(i, j) + 1 + np.minimum(x - i - 1, y - j - 1)
            whole = NUMERATOR + DENOMINATOR
            fits = (most * whole >= NUMERATOR * (x + y)) | (np.maximum(i, j) >= _LAST)
            ok = fits & (token[:-d] == token[d:]) & (cls[:-d] != cls[d:]) & (DENOMINATOR * np.minimum(x, y) >= NUMERATOR * np.maximum(x, y))
            first = cls[:-d] < cls[d:]
            one, two = np.where(first, cls[:-d], cls[d:]), np.where(first, cls[d:], cls[:-d])
            found.append((token[:-d][ok], np.stack([one, two, np.where(first, x, y), np.where(first, y, x)], axis=1)[ok]))
        return found

    def many(token, at, cls, n):
        """Star pairs of the size blocks of longer lists."""
        block = size_blocks(np.maximum(n, 1))
        token, at, cls, n = (np.concatenate([x, x]) for x in (token, at, cls, n))
        block = np.concatenate([block, block + 1])
        order = np.lexsort((cls, at, block, token))
        token, block, cls, n = token[order], block[order], cls[order], n[order]
        start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])][: len(token)])
        width = np.diff(start, append=len(token))
        pivot = np.repeat(cls[start], width)
        return token[cls != pivot], np.stack([pivot, cls, np.repeat(n[start], width), n], axis=1)[cls != pivot]

    def search(blobs: list[bytes]) -> np.ndarray:
        e = np.frombuffer(b"".join(blobs), _ENTRY)
        token = e["high"].astype(np.uint64) << np.uint64(16) | e["low"]
        order = np.argsort(token, kind="stable")
        e, token = e[order], token[order]
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        width = np.repeat(np.diff(start, append=len(token)), np.diff(start, append=len(token)))
        part = lambda ok: (token[ok], e["at"][ok], e["cls"][ok], e["n"][ok].astype(np.int64))
        found = [*few(*part((width > 1) & (width <= SHORT))), many(*part(width > SHORT))]
        token, pairs = np.concatenate([t for t, _ in found]), np.concatenate([x for _, x in found])
        # sets that meet more than once in a list (in two blocks, as copies from several tasks) share it once
        order = np.lexsort((pairs[:, 1], pairs[:, 0], token))
        token, pairs = token[order], pairs[order]
        return pairs[np.r_[True, (token[1:] != token[:-1]) | (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)][: len(token)]]

    def emit(found: list[np.ndarray]):
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        first = np.flatnonzero(np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]) if len(pairs) else np.empty(0, np.int64)
        weights, pairs = np.diff(first, append=len(pairs)), pairs[first]
        for a in range(0, len(pairs), 1 << 16):
            here, w = pairs[a : a + (1 << 16)], weights[a : a + (1 << 16)]
            yield filled(len(w), {name: here[:, k] for k, name in enumerate(("p", "m", "np", "nm"))} | {"w": w})

    def filled(rows: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches):
        at, blobs, found, size = None, [], [], 0
        for batch in batches:
            common = batch.filter(batch.column("token").is_valid())
            if common.num_rows:
                yield filled(common.num_rows, {c: common.column(c) for c in ("token", "at", "class", "n")})
            batch = batch.filter(batch.column("token").is_null())
            for s, blob in zip(batch.column("slice").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if s != at:
                    if blobs:
                        found.append(search(blobs))
                        size += len(found[-1])
                    at, blobs = s, []
                    if size >= FLUSH:
                        yield from emit(found)
                        found, size = [], 0
                blobs.append(blob)
        if blobs:
            found.append(search(blobs))
        if found:
            yield from emit(found)

    return map_arrow(entries, run, FOUND)


def _common_pairs(hot: DataFrame, folder: str) -> DataFrame:
    """Star pairs of the lists of common shingles; pivots are as many as common shingles, times a few dozen size blocks, at most."""
    hot = hot.withColumn("block", F.floor(F.log("n") / F.lit(BLOCK_WIDTH))).withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1)))
    pivots = hot.groupBy("token", "block").agg(F.min(F.struct("at", "class", "n")).alias("first"), F.min("class").alias("a"), F.max("class").alias("b"))
    # written, so that the join of the long lists can be split
    pivots = stored(pivots.where("a <> b").selectExpr("token", "block", "first.class AS p", "first.n AS np"), folder, "pivots")
    members = hot.select("token", "block", "class", "n").distinct()
    shared = members.join(pivots, ["token", "block"]).where("class <> p").select("token", "p", F.col("class").alias("m"), "np", F.col("n").alias("nm")).distinct()
    return shared.groupBy("p", "m").agg(F.first("np").alias("np"), F.first("nm").alias("nm"), F.count("*").alias("w"))


class Bitmap:
    """2**BITS bits by the leading bits of a class: a filter of fixed size that lets every member pass."""

    BITS = 26

    @classmethod
    def of(cls, classes: DataFrame) -> bytes:
        """Built by the executors; the driver gets at most 2**20 words, however many classes there are."""
        words = classes.selectExpr(f"CAST(shiftrightunsigned(class, {64 - cls.BITS + 6}) AS INT) AS word", f"shiftleft(1L, CAST(shiftrightunsigned(class, {64 - cls.BITS}) & 63 AS INT)) AS bit")
        got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        out = np.zeros(1 << (cls.BITS - 6), np.uint64)
        out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return out.tobytes()

    @classmethod
    def passes(cls, bitmap: bytes, classes: np.ndarray) -> np.ndarray:
        words, at = np.frombuffer(bitmap, np.uint64), classes.view(np.uint64) >> np.uint64(64 - cls.BITS)
        return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _texts_of(pairs: DataFrame, packed: DataFrame, folder: str, name: str) -> DataFrame:
    """(class, packed) of the classes in ``pairs``, one row each."""
    wanted = stored(pairs.select(F.explode(F.array("p", "m")).alias("class")).distinct(), folder, f"{name}_wanted")
    bitmap = packed.sparkSession.sparkContext.broadcast(Bitmap.of(wanted))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(Bitmap.passes(bitmap.value, batch.column("class").to_numpy())))

    # only texts that are likely wanted are shuffled; the join drops the few that are not
    near = map_arrow(packed, run, packed.schema)
    texts = stored(near.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("packed").alias("packed")), folder, name)
    release(packed.sparkSession)
    return texts


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(p, m, np, nm, shared): exact sizes of sets and intersections."""
    rows = (
        pairs.join(texts.selectExpr("class AS p", "packed AS xp"), "p")
        .join(texts.selectExpr("class AS m", "packed AS xm"), "m")
        .select("p", "m", "xp", "xm")
    )

    def run(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor()
        p, m = batch.column("p").to_pylist(), batch.column("m").to_pylist()
        packed = dict(zip(p, batch.column("xp"), strict=True)) | dict(zip(m, batch.column("xm"), strict=True))
        out: dict = {k: [] for k in ("p", "m", "np", "nm", "shared")}
        sets: dict = {}
        size = 0

        def get(missing):
            texts = [unpack.decompress(packed[x].as_py()).decode("utf-8", "surrogatepass") for x in missing]
            return dict(zip(missing, shingle_sets(texts), strict=True))

        for a in range(0, len(p), 64):
            need = list(dict.fromkeys([*p[a : a + 64], *m[a : a + 64]]))
            if size > 8_000_000:  # sets held for later pairs of the batch
                sets, size = {}, 0
            fresh = get([x for x in need if x not in sets])
            sets |= fresh
            size += sum(map(len, fresh.values()))
            for x, y in zip(p[a : a + 64], m[a : a + 64], strict=True):
                s, t = sets[x], sets[y]
                at = np.minimum(np.searchsorted(s, t), len(s) - 1)
                for k, v in zip(out, (x, y, len(s), len(t), int((s[at] == t).sum())), strict=True):
                    out[k].append(v)
        return out

    return map_batches(rows, run, "p long, m long, np int, nm int, shared int")


_LINKED = f"{NUMERATOR + DENOMINATOR} * CAST(shared AS BIGINT) >= {NUMERATOR} * (CAST(np AS BIGINT) + nm)"


def _needed(x: str, y: str) -> str:
    """SQL: common prefix shingles that linked sets of sizes x and y have at least.

    Linked sets share a = ceil(4/9 (x + y)) shingles. Beyond the prefix that ends first in the order, a
    set of n has ceil(0.8 n) - 2 shingles left at most; the rest of the shared ones stand in both prefixes.
    """
    part, whole = NUMERATOR, NUMERATOR + DENOMINATOR
    left = lambda n: f"greatest(0, ({NUMERATOR} * {n} + {DENOMINATOR - 1}) DIV {DENOMINATOR} - {SPARE})"
    return f"greatest(1, ({part} * ({x} + {y}) + {whole - 1}) DIV {whole} - greatest({left(x)}, {left(y)}))"


def _alike(x: str, y: str) -> str:
    return f"{DENOMINATOR} * least({x}, {y}) >= {NUMERATOR} * greatest({x}, {y})"


def _related(weighed: DataFrame, star: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """(p, m, sure): pairs of different components that share index lists and may link.

    ``weighed`` has (p, m, np, nm, w), pivots with themselves included. The lists that x and y share under
    one pivot are at most the fewer of either's.
    """
    labels = labels.select("node", "label")
    named = lambda c: labels.selectExpr(f"node AS {c}", f"label AS l{c}")
    members = stored(weighed.groupBy("p").agg(F.count("*").alias("k")), folder, "members")
    # ``held``: lists that m has under p and the pivots after it in the order of their members
    after = Window.partitionBy("m").orderBy(F.col("k").desc(), F.col("p").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = weighed.join(members, "p").withColumn("held", F.sum("w").over(after)).where(f"held >= {LEAST_NEEDED}")
    rows = (
        rows.join(star.select("p", "m", "shared"), ["p", "m"], "left")
        .join(named("p"), "p", "left")
        .join(named("m"), "m", "left")
        .selectExpr("p", "m", "np", "nm", "w", "held", "shared", "coalesce(lp, p) AS lp", "coalesce(lm, m) AS lm")
    )
    rows = stored(rows, folder, "standing")
    # a pivot of many members is dealt out: each x to one part, every y to all of them
    parts = stored(rows.groupBy("p").agg(F.count("*").alias("k")).where("k > 1").selectExpr("p", f"CAST(k DIV {TOGETHER} + 1 AS INT) AS parts"), folder, "parts")
    x = rows.where("lp <> lm").join(parts, "p").selectExpr("p", "pmod(xxhash64(m), parts) AS part", "m AS x", "nm AS nx", "w AS wx", "held AS ox", "shared AS sx", "lm AS lx")
    y = rows.join(parts, "p").selectExpr("p", "explode(sequence(0L, parts - 1L)) AS part", "m AS y", "nm AS ny", "w AS wy", "held AS oy", "shared AS sy", "lm AS ly", "lp = lm AS inside")
    # shared lists: the fewer of either's here, and at most the fewer of either's under later pivots
    enough = f"least(wx, wy) + least(ox - wx, oy - wy) >= {_needed('nx', 'ny')}"
    pairs = x.join(y, ["p", "part"]).where(f"lx <> ly AND (inside OR x < y) AND (y <> p OR sx IS NULL) AND {_alike('nx', 'ny')} AND {enough} AND {MAY}")
    pairs = pairs.selectExpr("least(x, y) AS x", "greatest(x, y) AS y", "IF(x < y, nx, ny) AS nx", "IF(x < y, ny, nx) AS ny").distinct()
    answered = star.selectExpr("least(p, m) AS x", "greatest(p, m) AS y").distinct()
    pairs = stored(pairs.join(answered, ["x", "y"], "left_anti"), folder, "pairs")
    # all that either's pivots tell of these pairs
    told = weighed.join(star.select("p", "m", "shared"), ["p", "m"], "left")
    both = (
        pairs.join(told.selectExpr("m AS x", "p", "np", "w AS wx", "shared AS sx"), "x")
        .join(told.selectExpr("m AS y", "p", "w AS wy", "shared AS sy"), ["y", "p"])
        .selectExpr("x", "y", "nx", "ny", "least(wx, wy) AS w", f"coalesce({SURE}, false) AS sure", f"{MAY} AS may")
        .groupBy("x", "y")
        .agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.sum("w").alias("w"), F.max("sure").alias("sure"), F.min("may").alias("may"))
    )
    return both.where(f"sure OR (may AND w >= {_needed('nx', 'ny')})").selectExpr("x AS p", "y AS m", "sure")


#: SQL: what |x and p|, |y and p| tell of |x and y|.
SURE = f"{NUMERATOR + DENOMINATOR} * (sx + sy - np) >= {NUMERATOR} * (nx + ny)"
MAY = f"(sx IS NULL OR sy IS NULL OR {NUMERATOR + DENOMINATOR} * (least(sx, sy) + least(nx - sx, ny - sy)) >= {NUMERATOR} * (nx + ny))"


def _most_common(often: DataFrame, most: int = MOST_COMMON) -> DataFrame:
    """The tokens that are called common: those seen most often, down to the power of two at which they are ``most`` at most."""
    sizes = {r["k"]: r["n"] for r in often.groupBy(F.length(F.bin("seen")).alias("k")).agg(F.count("*").alias("n")).collect()}
    least = 64
    for k in sorted(sizes, reverse=True):
        if sum(n for x, n in sizes.items() if x >= k) <= most:
            least = k
    return often.where(F.length(F.bin("seen")) >= least).select("token")


def _classes(docs: DataFrame, common: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class, again of every row), (class, least, component_id, leader): leader is one class of each component.

    That is the class of the smallest id, of several the one of the smallest name; classes without an id come last.
    """
    spark = docs.sparkSession
    table = rename_clashing(stored(make_sets(docs), folder, "sets"), folder)
    rows = stored(table.where("seen IS NULL").select("doc_id", "n", "class", "again"), folder, "rows")
    classes = stored(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")), folder, "classes")
    least = max(16, rows.count() // common)
    often = stored(table.where("seen IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least), folder, "often")
    shared_order = spark.sparkContext.broadcast(_most_common(often).toArrow().column("token").to_numpy().view(np.uint64))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(8, (16 * parts - 1).bit_length())
    packed = table.where("packed IS NOT NULL").select("class", "packed")
    entries = _entries(packed, shared_order, bits).repartition(parts, "slice").sortWithinPartitions("slice")
    found = stored(_rare_pairs(entries), folder, "found")
    rare_pairs = found.where("p IS NOT NULL").select("p", "m", "np", "nm", "w")
    common_pairs = _common_pairs(found.where("token IS NOT NULL").select("token", "at", "class", "n"), folder)
    weighed = rare_pairs.unionByName(common_pairs).groupBy("p", "m").agg(F.first("np").alias("np"), F.first("nm").alias("nm"), F.sum("w").alias("w"))
    weighed = stored(weighed, folder, "weighed")
    drop_folder(spark, f"{folder}/found")
    # a pivot is a member of its own lists, of which there are at most as many as all its members have with it
    selves = weighed.groupBy("p").agg(F.first("np").alias("np"), F.sum("w").alias("w")).selectExpr("p", "p AS m", "np", "np AS nm", "w")
    release(spark)

    likely = weighed.where(f"{_alike('np', 'nm')} AND w >= {_needed('np', 'nm')}").select("p", "m")
    star = stored(_verify(likely, _texts_of(likely, packed, folder, "star_texts")), folder, "star")
    release(spark)
    labels = connected_components(star.where(_LINKED).selectExpr("p AS u", "m AS v"), folder, "first")

    related = stored(_related(weighed.unionByName(selves), star, labels, folder), folder, "related")
    unsure = related.where("NOT sure").select("p", "m")
    checked = _verify(unsure, _texts_of(unsure, packed, folder, "related_texts")).where(_LINKED).select("p", "m")
    more = stored(related.where("sure").select("p", "m").unionByName(checked), folder, "more")
    if not more.isEmpty():
        named = lambda c: labels.selectExpr(f"node AS {c}", f"label AS l{c}")
        ends = more.join(named("p"), "p", "left").join(named("m"), "m", "left").selectExpr("coalesce(lp, p) AS u", "coalesce(lm, m) AS v")
        over = connected_components(ends, folder, "second")
        # written or plain on one side each, so that the join of a large component can be split
        lone = over.join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_anti").select("node", "label")
        labels = labels.join(over.selectExpr("node AS label", "label AS top"), "label", "left").selectExpr("node", "coalesce(top, label) AS label").unionByName(lone)
    of = stored(classes.join(labels.withColumnRenamed("node", "class"), "class", "left").selectExpr("class", "least", "coalesce(label, class) AS label"), folder, "labelled")
    top = stored(of.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "class")).alias("top")), folder, "tops")
    named = of.join(top, "label").selectExpr("class", "least", "top.least AS component_id", "class = top.class AS leader")
    named = stored(named, folder, "components")
    for name in ("sets", "renamed", "weighed", "star_texts", "star", "members", "standing", "parts", "pairs", "related", "related_texts", "more"):
        drop_folder(spark, f"{folder}/{name}")
    return rows, named


def link_documents(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every document."""
    rows, classes = _classes(docs, common, shared_folder(docs.sparkSession))
    return rows.join(classes, "class", "left").selectExpr("doc_id", "CAST(n AS BIGINT) AS n_shingles", "coalesce(component_id, doc_id) AS component_id")


def keep_one(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """The documents, all columns, one of each component: the one of smallest id.

    A row without words is linked with nothing and always stays. Of rows that share the smallest id of a
    component the one whose set has the smallest name stays, of repeated rows of it one (that of the
    least text). Null ids come after all others. A row is known by its id if no other row has that, so
    only ids that may be removed or repeated (by a bitmap of fixed size) are shuffled; rows of repeated
    or null ids are known by their sets too.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows, classes = _classes(docs, common, folder)
    judged = rows.join(classes, "class", "left").selectExpr("doc_id", "class", "again", "class IS NULL OR leader AND doc_id <=> least AS stays")
    ids = judged.groupBy("doc_id").agg(F.count("*").alias("k"), F.max("stays").alias("any"))
    touched = stored(ids.where("k > 1 OR doc_id IS NULL OR NOT any"), folder, "touched")
    leaders = stored(judged.where("stays AND class IS NOT NULL").select("doc_id", "class", "again").distinct(), folder, "leaders")
    bitmap = spark.sparkContext.broadcast(Bitmap.of(touched.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id").alias("class"))))
    release(spark)
    key = f"key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")))

    def part(wanted: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                keys = batch.column(key)
                maybe = Bitmap.passes(bitmap.value, keys.fill_null(0).to_numpy(zero_copy_only=False)) | keys.is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(maybe == wanted))

        return map_arrow(keyed, run, keyed.schema).select(docs.columns)

    # rows of ids that stay: the id is single, or its rows are told apart by their sets
    out = [F.col(f"`{c}`") for c in docs.columns]
    single = part(True).where("doc_id IS NOT NULL").join(touched.select("doc_id"), "doc_id", "left_anti").select(out)
    several = touched.where("any AND (k > 1 OR doc_id IS NULL)")
    if several.isEmpty():
        return part(False).unionByName(single)
    of_id = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    again = part(True).select(*of_id, F.struct(*out).alias("row")).join(several.select(of_id), ["id", "none"], "left_semi")
    again = _with_names(again)
    chosen = leaders.select(*of_id, "again", F.col("class").alias("chosen"))
    # a class has its set's first name or was named anew
    found = again.join(chosen, ["id", "none", "again"]).where("chosen = name OR chosen = xxhash64(name, again)")
    one = found.groupBy("id", "none", "again", "name").agg(F.min_by("row", "row.text").alias("row"))
    return part(False).unionByName(single).unionByName(again.where("name IS NULL").select("row.*")).unionByName(one.select("row.*"))


def _with_names(rows: DataFrame) -> DataFrame:
    """``rows`` with the two names of the set of ``row.text``."""
    schema = T.StructType([*rows.schema, T.StructField("name", T.LongType()), T.StructField("again", T.LongType())])

    def run(batches):
        for batch in pieces(batches):
            texts = batch.column("row").field("text").to_pylist()
            names = [x[1:] for a, b in text_chunks(texts) for x in named_sets(texts[a:b])]
            columns = [*batch.columns, pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "name", "again"])

    return map_arrow(rows, run, schema)
