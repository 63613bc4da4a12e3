"""Personal data by candidate gradient boosting.

Generators of high recall propose spans that may overlap; boosted trees score each candidate by
features of its format and its context; a calibrated threshold selects what is added to the base
spans. The base kinds (email, ip, card, phone) follow fixed formats and are always kept.

The trees are trained on examples that a seeded generator writes (``training_examples``): no table
has span labels. One half of the examples grows the trees, a quarter fits the calibration line, and on
the last quarter the threshold is set: the least calibrated probability with the asked precision there.

Null texts count as empty and have no spans. Texts are read whole and spans have no greatest length. Of
spans that overlap the likelier one is added, of equally likely ones the first, and none that overlaps a
base span. Repeated rows give repeated results and an empty table an empty one. Other columns are not read
by ``find_spans`` and kept, whatever their names, by ``redact``, which counts ``n_chars`` anew.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees, fit_line, sigmoid
from .common import map_batches

#: Order of kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "iban", "ssn", "obfuscated")
KINDS = BASE_KINDS + MORE_KINDS
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

# The base formats. Where a look-behind stands, a match could not begin inside the run before it
# either, so the results are those of the plain pattern; it keeps long runs from costing their square.
_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            free = host.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the base formats by kind, leftmost and not overlapping within a kind."""
    spans: dict = {k: [] for k in BASE_KINDS}
    if "@" in text:
        spans["email"] = _emails(text)
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            spans["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        if "+" in text:
            spans["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return spans


# Generators of further candidates: high recall, precision comes from the trees. Each is tried only in
# texts that have one of its hints (in lower case). No span has a greatest length: the look-behinds and
# possessive runs let each place be tried once.
_KEY_WORD = r"(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer|credential)"
_AT, _DOT = (rf"(?:\s?[\[(]\s?(?i:{w})\s?[\])]\s?|\s(?i:{w})\s)" for w in ("at", "dot"))
_GENERATORS = (
    ("secret", "=", re.compile(rf"(?i:{_KEY_WORD})[\"']?\s{{0,3}}=\s{{0,3}}[\"']?([^\s\"'<>,;]{{6,}})")),
    ("secret", ":", re.compile(rf"(?i:{_KEY_WORD})[\"']?\s{{0,3}}:\s{{0,3}}[\"']?([^\s\"'<>,;]{{6,}})")),
    ("secret", "", re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{24,}+(?:\.[A-Za-z0-9+/_-]{2,}+)*+={0,2})(?![A-Za-z0-9+/_-])")),
    ("iban", "0123456789", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("ssn", "-", re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")),
    ("obfuscated", "dot", re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+)(?![A-Za-z0-9])")),
)
_CONTEXT = re.compile(rf"(?i){_KEY_WORD}")
_MAIL_WORD = re.compile(r"(?i)\b(?:mail|e-?mail|contact|write|reach)\b")
_BANK_WORD = re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b")
_PERSON_WORD = re.compile(r"(?i)\b(?:ssn|social|security)\b")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans (kind, start, end); they may overlap."""
    out = set()
    low = text.lower()
    digits = _DIGIT.search(text) is not None
    for kind, hint, pattern in _GENERATORS:
        if digits if hint == "0123456789" else hint in low:
            out.update((kind, *m.span(1)) for m in pattern.finditer(text))
    return sorted(out)


def _iban_ok(value: str) -> bool:
    s = value.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and words near it."""
    value = text[start:end]
    n = len(value)
    digits = sum(c.isdigit() for c in value)
    upper = sum(c.isupper() for c in value)
    letters = sum(c.isalpha() for c in value)
    counts = np.unique(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
    entropy = float(-(counts / n * np.log2(counts / n)).sum())
    before, after = text[max(0, start - 32) : start], text[end : end + 16]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False))
    return [
        float(KINDS.index(kind)), float(n), digits / n, upper / n, letters / n, entropy, turns / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)), float(bool(_CONTEXT.search(before))),
        float(before.rstrip(" \t\"'").endswith(("=", ":"))), float(after[:1] in ("\"", "'")), float("[" in value or "(" in value),
        float(bool(_MAIL_WORD.search(before))), float(kind == "iban" and _iban_ok(value)), float(bool(_BANK_WORD.search(before))),
        float(bool(_PERSON_WORD.search(before + after))), float(kind == "ssn" and value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"),
    ]


def training_examples(seed: int = 7, n: int = 6000) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, 1 for personal data) of invented sentences."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    low, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda a=2, b=9: chars(low, int(rng.integers(a, b)))

    def iban(valid: bool) -> str:
        land, body = chars(low.upper(), 2), chars(digit, 18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        return f"{land}{(check if valid else (check + 1 + int(rng.integers(90))) % 97 + 2) % 100:02d}{body}"

    out = []
    while len(out) < n:
        lead, tail = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(5))
        what = int(rng.integers(0, 12))
        if what <= 2:
            value = chars(pick(["0123456789abcdef", "0123456789ABCDEF", low + low.upper() + digit]), int(rng.integers(16, 64)))
            label = pick(["token", "secret", "api_key", "password", "access key"])
            text, kind, good = f"{lead} {pick([label, label.upper()])}{pick([' = ', '=', ': '])}{pick(['"', chr(39), ''])}{value}", "secret", 1
        elif what == 3:
            value = chars(low + low.upper() + digit, int(rng.integers(32, 64)))
            if rng.integers(3) == 0:  # tokens of several parts
                value = ".".join([value, *(chars(low + low.upper() + digit, int(rng.integers(20, 60))) for _ in range(2))])
            text, kind, good = f"{lead} {value}", "secret", 1
        elif what <= 5:
            value = pick([chars(low, int(rng.integers(24, 50))), "-".join(word(3, 9) for _ in range(6)), "/".join(word(3, 9) for _ in range(6)), "-" * 30, word() * 6 + str(rng.integers(99))])
            text, kind, good = f"{lead} {value}", "secret", 0
        elif what == 6:
            value = word(6, 14)
            text, kind, good = f"{lead} {pick(['the secret: ', 'auth: ', 'token: '])}{value}", "secret", 0
        elif what <= 8:
            ok = bool(rng.integers(2))
            value = iban(ok)
            text, kind, good = f"{lead} {pick(['IBAN ', 'account ', '']) if ok else ''}{value}", "iban", int(ok)
        elif what == 9:
            near = bool(rng.integers(2))
            value = f"{int(rng.integers(1, 665)):03d}-{int(rng.integers(1, 99)):02d}-{int(rng.integers(1, 9999)):04d}"
            text, kind, good = f"{lead} {pick(['SSN ', 'social security number ']) if near else pick(['part ', 'no ', 'code '])}{value}", "ssn", int(near)
        elif what == 10:
            value = f"{word()}{pick([' [at] ', ' (at) ', '[at]'])}{word()}{pick([' [dot] ', ' (dot) ', '[dot]'])}{pick(['com', 'org', 'net'])}"
            if rng.integers(4) == 0:
                value = value.upper()
            text, kind, good = f"{lead} {value}", "obfuscated", 1
        else:
            value = f"{word()} at {word()} dot {word()}"
            text, kind, good = f"{lead} {value}", "obfuscated", 0
        at = text.rindex(value)
        out.append((f"{text} {tail}", kind, at, at + len(value), good))
    return out


@lru_cache(maxsize=1)
def model(precision: float = 0.99) -> tuple[BoostedTrees, float, float, float]:
    """(trees, slope and offset of the calibration, least probability); each of the three from examples of its own."""
    rows = training_examples()
    x = np.array([features(t, k, s, e) for t, k, s, e, _ in rows])
    y = np.array([float(r[4]) for r in rows])
    half, most = len(rows) // 2, len(rows) * 3 // 4
    trees = BoostedTrees().fit(x[:half], y[:half])
    margin = trees.margin(x)
    slope, offset = fit_line(margin[half:most], y[half:most])
    p = sigmoid(slope * margin[most:] + offset)
    order = np.argsort(-p)
    right = np.cumsum(y[most:][order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    return trees, slope, offset, max(0.5, float(p[order][good[-1]]) if len(good) else 1.0)


def all_spans(texts: list[str], fitted) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """For each text its base spans and the spans added; these overlap neither each other nor base spans."""
    trees, slope, offset, least = fitted
    base = [base_spans(t) for t in texts]
    found = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    more: list[list] = [[] for _ in texts]
    if found:
        p = sigmoid(slope * trees.margin(np.array([features(texts[i], k, s, e) for i, k, s, e in found])) + offset)
        for (i, k, s, e), q in zip(found, p.tolist(), strict=True):
            if q >= least:
                more[i].append((-q, s, e, k))
    out = []
    for spans, extra in zip(base, more, strict=True):
        # starts and ends of what is taken, merged: only the neighbours of a place can overlap a new span
        starts: list[int] = []
        ends: list[int] = []
        for s, e in sorted(x for k in BASE_KINDS for x in spans[k]) if extra else ():
            if ends and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        chosen: list = []
        for _, s, e, k in sorted(extra):
            at = bisect_left(ends, s + 1)  # the first one that ends after s
            if at == len(starts) or e <= starts[at]:
                chosen.append((k, s, e))
                starts.insert(at, s)
                ends.insert(at, e)
        out.append((spans, chosen))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_spans(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans.

    Spans are kind:start:end in code points, ends exclusive.
    """
    fitted = model(precision)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        out["doc_id"] = batch.column("doc_id")
        for spans, more in all_spans([t or "" for t in batch.column("text").to_pylist()], fitted):
            base = [(k, s, e) for k in BASE_KINDS for s, e in spans[k]]
            for k in BASE_KINDS:
                out[f"n_{k}"].append(len(spans[k]))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + more))
            out["n_spans"].append(len(base) + len(more))
        return out

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def redact(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars, if there, counts anew.

    Overlapping spans of different base kinds are replaced together, under the kind that starts first.
    Null texts stay null.
    """
    fitted = model(precision)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        out = {name: batch.column(i) for i, name in enumerate(names)}
        texts = batch.column(names.index("text")).to_pylist()
        fresh = []
        for text, (spans, more) in zip(texts, all_spans([t or "" for t in texts], fitted), strict=True):
            if text is None:
                fresh.append(None)
                continue
            parts, at = [], 0
            for s, e, k in sorted([(s, e, k) for k in BASE_KINDS for s, e in spans[k]] + [(s, e, k) for k, s, e in more]):
                if s >= at:
                    parts += [text[at:s], f"[{k.upper()}]"]
                at = max(at, e)
            fresh.append("".join([*parts, text[at:]]) if parts else text)
        out["text"] = fresh
        if "n_chars" in out:
            out["n_chars"] = [n if t is None else len(t) for n, t in zip(batch.column(names.index("n_chars")).to_pylist(), fresh, strict=True)]
        return out

    return map_batches(docs, run, docs.schema.simpleString()[7:-1])
