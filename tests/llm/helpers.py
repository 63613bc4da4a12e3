"""Brute-force versions and small tables."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    w = WORDS.findall(ascii_lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """{row number: (set size, smallest id of the component)} of (id, text) rows, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in lists[g]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                top[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    return {i: (len(sets[i]), least(ids[find(i)])) for i in range(len(rows))}


#: Texts that every operator has to take.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here at all today friend"), (6, "é" * 3000), (7, "a b c d e f g " * 9000),
    (8, "\x00 zero \x7f   \U0001f600 end"), (9, ">" * 50), (10, "x" * 200_000), (11, "12345678901234567 " * 5 + "<|endoftext|>"),
]


def documents(spark, rows, extra=True):
    """A documents table; extra columns have the names of operators' results."""
    df = spark.createDataFrame([(i, t, "en", "src0", len(t) if t else 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("score", "held_out", "lang_pred", "n_words", "labels", "component_id", "n_shingles", "item_id", "spans", "n_tokens", "token_ids", "class", "kept", "bits", "words", "lines", "p", "m"):
            df = df.withColumn(name, F.lit("mine"))
    return df
