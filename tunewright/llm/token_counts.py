"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are cut into pieces of about ``PIECE`` characters at safe boundaries, places that the tokenizer's
pre-tokenizer always cuts, so the pieces' counts add up to the text's.  Pieces of an Arrow batch are dealt into
encoding batches of about ``BATCH`` bytes, in order of length, so that no batch waits for one long text and the
library's encodings in memory stay bounded.  Nothing but lengths leaves the function.

Safe boundaries: for byte-level BPE files with the usual word pattern, before a white space character that follows
another character (no word of the pattern holds white space after its first character, and the only look-ahead
looks at what follows the white space).  Special strings hold no white space and are never cut.  For SentencePiece
and other files texts are not cut.  A text without a safe boundary stays whole.

Defined results: null text counts as empty and has 0 tokens; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import steps, text_or_empty

PIECE, BATCH = 16_384, 1 << 20
#: a cut goes before this white space (a subset that every Unicode version agrees on)
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n]")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in pieces of at least ``size`` characters, cut at safe boundaries."""
    out, at = [], 0
    while len(text) - at > 2 * size:
        m = SAFE.search(text, at + size)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


@lru_cache(maxsize=2)
def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function of texts that gives token counts, and whether texts may be cut; read once by a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], False
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    import json
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space", True) and spec.get("post_processor") is None
             and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                         for t in spec["added_tokens"]))
    return lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)], plain


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def batches_of(sizes: np.ndarray, limit: int = BATCH) -> Iterator[np.ndarray]:
    """Places in order of size, dealt into batches of about ``limit`` bytes."""
    order = np.argsort(sizes, kind="stable")
    number = np.cumsum(sizes[order]) // limit
    yield from np.split(order, np.flatnonzero(np.diff(number)) + 1)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(path)
        for b in steps(batches, "text", 8 * BATCH):
            rows: list[int] = []
            parts: list[str] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                own = pieces(text) if cut else [text]
                rows += [i] * len(own)
                parts += own
            n = np.zeros(b.num_rows, np.int64)
            place = np.array(rows, np.int64)
            for group in batches_of(np.array([n_bytes(p) for p in parts], np.int64)):
                np.add.at(n, place[group], count([parts[i] for i in group]))
            yield pa.record_batch([b.column(id_column), b.column("n_bytes"), pa.array(n), pa.array(n > limit)],
                                  names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    text = text_or_empty(F.col("text"))
    return docs.select(id_column, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(
        run, f"{id_column} {kind}, n_bytes long, n_tokens long, over_limit boolean")
