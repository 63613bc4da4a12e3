"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is one token that can be the last of its encoding. It is found among
the tokens that are suffixes of the prefix, which an automaton over all tokens gives in one step a
character (its suffix links lead from the longest to the shortest): the one whose pair with the last
token of the prefix before it is compatible. A pair is compatible if the two tokens' own merges, undone
from the highest rank down, never show a merge across the border that would have come first. Following
the back-pointers from the word's end gives exactly the ids that merging by rank gives.

Texts are split into words in arrays: code points are mapped, classed and cut for many texts at once,
the distinct words of these are encoded once each, and the results are gathered by the words' numbers.

The vocabulary file is of the word-end kind: text is put in NFC, lower-cased and split into words,
white space is dropped, special tokens are found in the raw text. Character classes, lower case and NFC
are those of the tokenizers library, whose parts know different versions of Unicode.

Null and empty texts have no tokens; a text of any length is read whole; repeated rows give repeated
results, there are no ties (an encoding is unique), and an empty table gives an empty one with the same
columns. ``digest`` reads doc_id and text only; ``encode_documents`` keeps all other columns and
replaces ``n_tokens`` and ``token_ids`` if the input has columns of these names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, text_chunks

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
CACHE_BITS = 19
WIDTH = 64  # bytes of words that are encoded together
CHUNK = 1 << 20
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Where the library's parts know another version of Unicode than unicodedata 15.1 does.
#: Letters and numbers since.
_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Lower case since: first and last capital, what is added.
_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
#: Code points without a combining class or a composition in the library's NFC.
_UNKNOWN = ((0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF))
_SPLIT_NFC = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _UNKNOWN) + "])")
#: Ends of words that the pre-tokenizer cuts off after an apostrophe.
_SHORT_ENDS, _LONG_ENDS = "stmd", ("re", "ve", "ll")

_OTHER, _SPACE, _LETTER, _NUMBER = range(4)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    every = [chr(c) for c in range(0x110000)]
    kind = np.fromiter((kinds.get(unicodedata.category(c)[0], _OTHER) for c in every), np.uint8, 0x110000)
    kind[[c for c in range(0x3001) if every[c].isspace() and not 0x1C <= c <= 0x1F]] = _SPACE
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every), np.uint32, 0x110000)
    for what, ranges in ((_LETTER, _LETTERS), (_NUMBER, _NUMBERS)):
        for a, b in ranges:
            kind[a : b + 1] = what
    for a, b, more in _CAPITALS:
        lower[a : b + 1] = np.arange(a + more, b + more + 1)
    return kind, lower


def composed(text: str) -> str:
    """NFC as the library knows it: code points that it does not know neither move nor compose."""
    if text.isascii():
        return text
    if _SPLIT_NFC.search(text):
        return "".join([x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(_SPLIT_NFC.split(text))])
    return unicodedata.normalize("NFC", text)


def split_words(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all texts one after the other, and how many stand before the end of each text."""
    kinds, lower = _tables()
    # the spaces at the end let the ends after an apostrophe be read without bounds
    encoded = lambda parts: np.frombuffer(("\n".join(parts) + "\n    ").encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = encoded(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    odd = np.flatnonzero((raw >= 0x300) | (raw == 0x130))  # nothing below U+0300 moves or composes
    if len(odd):
        texts = list(texts)
        for i in np.unique(np.searchsorted(ends, odd, side="right")).tolist():
            texts[i] = composed(texts[i]).replace("\u0130", "i\u0307")
        raw, ends = encoded(texts), np.cumsum([len(t) + 1 for t in texts])
    codes = lower[raw]
    kind = kinds[codes]
    start = np.empty(len(kind), bool)
    start[0] = kind[0] != _SPACE
    start[1:] = (kind[1:] != _SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER))
    quote = np.flatnonzero((codes == 0x27) & start)
    if len(quote):
        one, two = codes[quote + 1], codes[quote + 2]
        long = np.zeros(len(quote), bool)
        for a, b in _LONG_ENDS:
            long |= (one == ord(a)) & (two == ord(b))
        for at, width in ((quote[np.isin(one, [ord(c) for c in _SHORT_ENDS])], 1), (quote[long], 2)):
            start[at + 1] = False
            after = at + 1 + width
            start[after[kind[after] == _LETTER]] = True
    inside = kind != _SPACE
    first = np.flatnonzero(start)
    kept = codes[inside]
    at = (np.cumsum(inside) - 1)[first]
    data = kept.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    if len(data) > len(kept):
        width = np.ones(len(kept) + 1, np.int64)
        width[0] = 0
        width[1:] += (kept >= 0x80).astype(np.int64) + (kept >= 0x800) + (kept >= 0x10000)
        at = np.cumsum(width)[at]
    offsets = np.append(at, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(first, ends)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


def load(path: str | None = None) -> dict:
    """What encoding needs of a vocabulary file: vocabulary, merges, special tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
        raise ValueError("a BPE vocabulary with word ends is needed")
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "special": {t["content"]: t["id"] for t in data["added_tokens"]},
    }


class Encoder:
    def __init__(self, data: dict):
        vocab, merges = data["vocab"], data["merges"]
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in data["special"].items()}
        self.special = data["special"]
        self.split_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        letters = byte_letters()
        # ranks: single bytes first, then the merges in order; tokens are handled by rank inside
        rank: dict[str, int] = {}
        for c in letters:
            for t in (c, c + END):
                rank[t] = len(rank)
        halves = [(r, r) for r in range(len(rank))]
        made: dict[int, int] = {}
        for a, b in merges:
            r = rank.setdefault(a + b, len(rank))
            if r == len(halves):
                halves.append((rank[a], rank[b]))
            made.setdefault(rank[a] << 20 | rank[b], r)
        by_rank = sorted(rank, key=rank.get)
        self.ids = np.array([vocab[t] for t in by_rank], np.int32)
        self.id_texts = pa.array([f"{i} " for i in self.ids], pa.string())
        self.token_texts = pa.array([f"{t} " for t in by_rank], pa.string())
        self.left, self.right = np.array(halves, np.int64).T.copy()
        self.merge_keys = np.array(sorted(made), np.int64)
        self.merge_ranks = np.array([made[k] for k in self.merge_keys.tolist()], np.int64)
        code = {c: b for b, c in enumerate(letters)}
        final = [t.endswith(END) for t in by_rank]
        self._automaton([bytes(code[c] for c in (t[: -len(END)] if f else t)) for t, f in zip(by_rank, final, strict=True)], final)
        #: Answers to asked pairs by a hash of the pair; a newer pair takes the place of an older one.
        self.asked = np.full(1 << CACHE_BITS, -1, np.int64)
        self.answers = np.zeros(1 << CACHE_BITS, bool)

    def _automaton(self, bodies: list[bytes], final: list[bool]) -> None:
        """One state for every prefix of a token; where each byte leads; the longest tokens that end at a state."""
        states = {b"": 0}
        for body in bodies:
            for k in range(1, len(body) + 1):
                states.setdefault(body[:k], 0)
        order = sorted(states, key=len)
        for n, prefix in enumerate(order):
            states[prefix] = n
        depth = np.array([len(p) for p in order])
        parent = np.array([0, *[states[p[:-1]] for p in order[1:]]])
        byte = np.array([0, *[p[-1] for p in order[1:]]])
        at = np.array([states[b] for b in bodies])
        is_final = np.array(final)
        own = np.full((2, len(order)), -1, np.int64)  # the token that a state is, inside a word and at its end
        own[is_final.astype(int), at] = np.arange(len(bodies))
        self.goto = np.zeros((len(order), 256), np.int32)
        link = np.zeros(len(order), np.int64)
        cuts = np.searchsorted(depth, np.arange(depth[-1] + 2))
        for d in range(1, depth[-1] + 1):
            here = slice(cuts[d], cuts[d + 1])
            if d > 1:
                link[here] = self.goto[link[parent[here]], byte[here]]
                own[:, here] = np.where(own[:, here] >= 0, own[:, here], own[:, link[here]])
            # steps of the level above, known only now that its children are: where it has none, its link's
            above = slice(cuts[d - 1], cuts[d])
            if d > 1:
                self.goto[above] = self.goto[link[above]]
            self.goto[parent[here], byte[here]] = np.arange(cuts[d], cuts[d + 1])
        last = slice(cuts[depth[-1]], len(order))
        self.goto[last] = self.goto[link[last]]
        self.longest = own.astype(np.int32)
        self.size = np.array([len(b) for b in bodies], np.int32)
        # the next shorter token of the same kind that ends there too
        self.shorter = own[is_final.astype(int), link[at]].astype(np.int32)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether encoding the joined text keeps the border between two tokens, for many pairs."""
        fits = np.ones(len(left), bool)
        todo, a, b, before = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64), np.full(len(left), 1 << 40)
        while len(todo):
            key = a << 20 | b
            k = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            clash = (self.merge_keys[k] == key) & (self.merge_ranks[k] < before)
            fits[todo[clash]] = False
            # undo the later of the two inner merges: until then the border saw its halves
            a_whole, b_whole = self.left[a] == a, self.left[b] == b
            on = ~clash & ~(a_whole & b_whole)
            todo, a, b, a_whole, b_whole = todo[on], a[on], b[on], a_whole[on], b_whole[on]
            undo = ~a_whole & (b_whole | (a > b))
            before = np.where(undo, a, b + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return fits

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        slot = ((key * 0x9E3779B97F4A7C1) >> 13) & ((1 << CACHE_BITS) - 1)
        out = self.answers[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            answers = self.compatible(pairs >> 20, pairs & 0xFFFFF)
            out[new] = answers[back]
            at = ((pairs * 0x9E3779B97F4A7C1) >> 13) & ((1 << CACHE_BITS) - 1)
            # of pairs that share a slot one is kept, key and answer alike
            at, one = np.unique(at, return_index=True)
            self.asked[at], self.answers[at] = pairs[one], answers[one]
        return out

    def _last_tokens(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """words x prefixes: the last token of each prefix of words that come longest first."""
        width = int(size[0])
        last = np.full((len(size), width + 1), -1, np.int32)
        state = np.zeros(len(size), np.int64)
        longer = np.searchsorted(-size, -np.arange(width + 2), side="right")  # words of at least so many bytes
        for i in range(1, width + 1):
            there, on = longer[i], longer[i + 1]
            state = self.goto[state[:there], data[start[:there] + (i - 1)]]
            # inside a word, and at the end of the words that end here
            token = np.concatenate([self.longest[0, state[:on]], self.longest[1, state[on:]]])
            todo = np.arange(there)
            while len(todo):
                j = i - self.size[token]
                done = j == 0
                more = np.flatnonzero(~done)
                done[more] = self.fits(last[todo[more], j[more]], token[more])
                last[todo[done], i] = token[done]
                todo, token = todo[~done], self.shorter[token[~done]]
        return last

    def _long_word(self, word: bytes) -> np.ndarray:
        """Ranks of a long word: the same, prefix by prefix."""
        n = len(word)
        last, state = np.full(n + 1, -1, np.int32), 0
        known: dict = {}
        sizes, shorter = self.size, self.shorter
        for i in range(1, n + 1):
            state = int(self.goto[state, word[i - 1]])
            token = int(self.longest[int(i == n), state])
            while True:
                j = i - int(sizes[token])
                if not j:
                    break
                key = (int(last[j]), token)
                if key not in known:
                    known[key] = bool(self.compatible(np.array([key[0]]), np.array([token]))[0])
                if known[key]:
                    break
                token = int(shorter[token])
            last[i] = token
        out, i = [], n
        while i:
            out.append(last[i])
            i -= int(sizes[last[i]])
        return np.array(out[::-1], np.int64)

    def words_ranks(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of all tokens word by word, number of tokens of each word)."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        short = order[size[order] <= WIDTH]
        counts = np.zeros(len(words), np.int64)
        found = []  # (word, place from its end, rank)
        if len(short):
            last = self._last_tokens(data, offsets[short], size[short])
            at, rows, k = size[short].copy(), np.arange(len(short)), 0
            while len(rows):
                token = last[rows, at[rows]]
                found.append((short[rows], np.full(len(rows), k), token))
                counts[short[rows]] += 1
                at[rows] -= self.size[token]
                rows, k = rows[at[rows] > 0], k + 1
        for w in order[size[order] > WIDTH].tolist():
            ranks = self._long_word(data[offsets[w] : offsets[w + 1]].tobytes())
            counts[w] = len(ranks)
            found.append((np.full(len(ranks), w), np.arange(len(ranks))[::-1], ranks))
        flat = np.empty(int(counts.sum()), np.int64)
        ends = np.cumsum(counts)
        for w, back, token in found:
            flat[ends[w] - 1 - back] = token
        return flat, counts

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of the tokens of all texts one after the other, where each text's begin, and the end)."""
        words, ends = split_words(texts)
        coded = words.dictionary_encode()
        flat, counts = self.words_ranks(coded.dictionary)
        numbers = coded.indices.to_numpy()
        width = counts[numbers]
        upto = np.concatenate([[0], np.cumsum(width)])
        ranks = flat[np.repeat((np.cumsum(counts) - counts)[numbers] - upto[:-1], width) + np.arange(upto[-1])]
        return ranks, upto[np.concatenate([[0], ends])]

    def parts(self, texts: list[str | None]) -> tuple[list[str], list[list[int | str]]]:
        """The texts cut at special tokens: all cuts, and for each text the numbers of its cuts and its special tokens."""
        cuts: list[str] = []
        rows: list[list[int | str]] = []
        for text in texts:
            row: list[int | str] = []
            for k, part in enumerate(self.split_special.split(text) if text and any(t in text for t in self.special) else (text or "",)):
                if k % 2:
                    row.append(part)
                else:
                    row.append(len(cuts))
                    cuts.append(part)
            rows.append(row)
        return cuts, rows

    def texts(self, texts: list[str | None]) -> list[tuple[bytes, bytes, int]]:
        """(ids joined by spaces, decoded text, number of tokens) of each text."""
        cuts, rows = self.parts(texts)
        ranks, ends = self.chunk(cuts)
        sizes, taken = np.diff(ends).tolist(), []
        for names in (self.id_texts, self.token_texts):
            joined = names.cast(pa.large_string()).take(pa.array(ranks))
            at = np.frombuffer(joined.buffers()[1], np.int64) if len(ranks) else np.zeros(1, np.int64)
            taken.append((memoryview(joined.buffers()[2]) if len(ranks) else memoryview(b""), at[ends].tolist()))
        out = []
        for row in rows:
            found: list[list] = [[], []]
            n = 0
            for x in row:
                if isinstance(x, str):
                    found[0].append(str(self.special[x]).encode())
                    found[1].append(x.encode())
                    n += 1
                elif sizes[x]:
                    for k, (data, at) in enumerate(taken):
                        found[k].append(data[at[x] : at[x + 1] - 1])
                    n += sizes[x]
            out.append((*(f[0] if len(f) == 1 else b" ".join(f) for f in found), n))
        return out

    def id_arrays(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        cuts, rows = self.parts(texts)
        ranks, ends = self.chunk(cuts)
        ids, at = self.ids[ranks], ends.tolist()
        cut = lambda x: np.array([self.special[x]], np.int32) if isinstance(x, str) else ids[at[x] : at[x + 1]]
        return [cut(row[0]) if len(row) == 1 else np.concatenate([cut(x) for x in row]) for row in rows]

    def encode(self, text: str | None) -> list[int]:
        return self.id_arrays([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: this vocabulary has no decoder of its own."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def _encoder(content: str) -> Encoder:
    return Encoder(json.loads(content))


def _shared(docs: DataFrame, path: str | None):
    """The vocabulary, a file of fixed size, sent to every executor once."""
    return docs.sparkSession.sparkContext.broadcast(json.dumps(load(path)))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, number of tokens, SHA-256 of the ids and of the decoded text."""
    content = _shared(docs, path)

    def run(batch: pa.RecordBatch) -> dict:
        encoder = _encoder(content.value)
        out: dict = {k.split()[0]: [] for k in DIGEST.split(", ")}
        out["doc_id"] = batch.column("doc_id")
        texts = batch.column("text").to_pylist()
        for a, b in text_chunks(texts, CHUNK):
            for ids, decoded, n in encoder.texts(texts[a:b]):
                out["n_tokens"].append(n)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
        return out

    return map_batches(docs.select("doc_id", "text"), run, DIGEST)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with their token ids: columns ``n_tokens`` and ``token_ids`` are added or replaced."""
    content = _shared(docs, path)
    docs = docs.drop("n_tokens", "token_ids")
    at = docs.columns.index("text")
    schema = f"{docs.schema.simpleString()[7:-1]},n_tokens:bigint,token_ids:array<int>"

    def run(batch: pa.RecordBatch) -> dict:
        encoder = _encoder(content.value)
        texts = batch.column(at).to_pylist()
        ids = [x for a, b in text_chunks(texts, CHUNK) for x in encoder.id_arrays(texts[a:b])]
        sizes = [len(x) for x in ids]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32), np.concatenate([*ids, np.empty(0, np.int32)]))
        return {name: batch.column(i) for i, name in enumerate(names)} | {"n_tokens": sizes, "token_ids": lists}

    names = docs.columns
    return map_batches(docs, run, schema)


def decode_documents(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text that ``token_ids`` decode to; null ids give null."""
    content = _shared(rows, path)

    def run(batch: pa.RecordBatch) -> dict:
        encoder = _encoder(content.value)
        return {"doc_id": batch.column("doc_id"), "decoded": [None if x is None else encoder.decode(x) for x in batch.column("token_ids").to_pylist()]}

    return map_batches(rows.select("doc_id", "token_ids"), run, "doc_id long, decoded string")
