"""Small tables with the cases every operator must survive, and plain versions to hold results against."""

from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: extra columns that clash with names used inside the operators
CLASH = {"row": "r", "k": "kk", "n": 3, "t": "x", "label": "l", "token": 5, "rate": 0.5, "copy": 7, "recipe": "q",
         "score": 0.1, "count": 2, "text_sha256": "s", "keep_id": 1, "mix_order": "o", "dedup_key": "d",
         "join_key": "j", "toxicity_text": "y", "blocks": "b", "host": "h", "payload": "p", "u": 1, "v": 2, "s": 3}

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
TEXTS = [(1, "one two three four five six seven"), (2, "one  two three four five six\tseven"), (3, ""), (4, None),
         (None, "one two three four five six seven"), (5, "One two three FOUR five six seven"), (6, " "),
         (6, " "), (7, LONG), (8, LONG + " tail"), (9, "x" * 20_000), (10, "a b"), (11, "a b"), (11, "a c"),
         (12, "naïve café été ÉTÉ 中文 🙂 <|endoftext|> end"), (13, "\u00a0\u2003 \x1c\x85"), (None, None)]


def documents(spark, rows=TEXTS, clash=True):
    base = "doc_id long, text string, lang string, source string, n_chars long"
    names = {"double": float, "long": int, "string": str}
    kind = {v: k for k, v in names.items()}
    extra = CLASH if clash else {}
    schema = base + "".join(f", `{c}` {kind[type(v)]}" for c, v in extra.items())
    data = [(i, t, "en" if (i or 0) % 2 else None, None if (i or 0) % 5 == 0 else f"src{(i or 0) % 2}",
             None if t is None else len(t), *extra.values()) for i, t in rows]
    return spark.createDataFrame(data, schema)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text, width):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    if len(w) >= width:
        return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(rows, width, percent):
    """Per row its component's smallest id, all pairs compared."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [(d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)]


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)
