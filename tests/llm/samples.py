"""Small tables with every odd case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {code: code + 32 for code in range(65, 91)}
_SCHEMA = (
    "doc_id long, text string, slice int, halo string, score double, kept string, rank long, ids string, "
    "bucket string, shard string, slot long, record string, n_words int, key long, component string, size int, "
    "place string, mark long, runs string, places string, row string, cut string"
)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(_LOWER)


def prose(rng, count):
    syllables = "ba re mo ti lu en dor kas fin ül é".split()
    out = []
    for _ in range(count):
        word = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        out.append(word.capitalize() if rng.random() < 0.1 else word)
        if rng.random() < 0.12:
            out[-1] += rng.choice([".", ".", "!", "?"])
    return " ".join(out)


def odd_texts():
    rng = random.Random(5)
    base = prose(rng, 300)
    long = prose(rng, 40_000)
    parts = base.split(" ")
    near = " ".join(parts[:150] + ["changed"] + parts[151:])
    return [
        None, "", " ", "\n\n", "a", "one two three four", base, base, base, near, near + " tail", long,
        "é" * 50, "日本語 テキスト \U0001f600", "x" * 3000, "ab " * 900, "Same. Same. Same. Same. Same.",
        prose(rng, 120) + "\r\n\ttabs\x0b\x0c", base[: len(base) // 2] + "\n" + prose(rng, 100),
    ]


def odd_documents(spark, texts=None):
    """Null, empty, blank, long, equal and near texts, repeated rows, a null doc_id, clashing columns."""
    rows = list(enumerate(odd_texts() if texts is None else texts))
    if texts is None:
        rows += [rows[6], rows[6], (None, "without an id at all, but with some words in it to see")]
    extra = len(_SCHEMA.split(", ")) - 2
    return spark.createDataFrame([(*row, *[None] * extra) for row in rows], _SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], _SCHEMA)


def plain_rows(frame):
    return [(row["doc_id"], row["text"] or "") for row in frame.select("doc_id", "text").collect()]


def shingles(text, width=5):
    found = words(lower(text))
    if not found:
        return frozenset()
    return frozenset(tuple(found[at : at + width]) for at in range(max(1, len(found) - width + 1)))


def least_reachable(nodes, links):
    """The least node that each reaches."""
    above = {node: node for node in nodes}

    def top(node):
        while above[node] != node:
            node = above[node]
        return node

    for one, two in links:
        one, two = top(one), top(two)
        above[max(one, two)] = min(one, two)
    return {node: top(node) for node in nodes}


def linked(one, two, percent=80):
    shared = len(one & two)
    return shared > 0 and 100 * shared >= percent * (len(one) + len(two) - shared)
