"""BPE encoding and decoding in batched numpy merge rounds.

The tokenizer's file gives the vocabulary, the ranked merges and the special tokens.  A batch of texts is cut into
words by the file's byte-level pattern; words not met before by this Python worker are encoded together: their
symbols lie in one flat array, a round finds the rank of every adjacent pair by binary search over the sorted pair
keys and merges, in each word, the pair of lowest rank, from left to right.  Words without a known pair leave the
array.  The known words are a bounded table (``WORDS``, then begun anew), so memory does not follow the input.
Decoding gathers the bytes of all ids of a batch with one index array.

One word of over ``LONG_WORD`` bytes (no space, letters only) takes its rounds from a heap instead, which does the
same merges in n log n.

Defined results: null text counts as empty: 0 ids, empty decoded text; special strings inside a text are their
special id, as the library does by default; ids that are no UTF-8 together decode with U+FFFD; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import steps, text_or_empty

# Fixed value: the byte-level word pattern, with White_Space for \\s.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: encoded words that a Python worker remembers, and the bytes from which a word is merged by a heap
WORDS, LONG_WORD = 200_000, 4_096
NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    """A byte-level BPE tokenizer read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw: dict[int, bytes] = {i: bytes(letters[c] for c in w) for w, i in vocab.items()}
        raw |= {i: w.encode() for w, i in self.special.items()}
        top = max(raw) + 1
        self.length = np.array([len(raw.get(i, b"")) for i in range(top)], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(top)), np.uint8)
        self.of_byte = np.empty(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.base = np.int64(top)
        key = np.array([vocab[a] * top + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        _, first = np.unique(key, return_index=True)  # of a pair listed twice the first rank holds
        self.key, self.rank, self.made = key[first], first.astype(np.int64), made
        self.pattern = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.known: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no merge."""
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each (non-empty) word."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        while len(symbol):
            last = np.ones(len(word), bool)
            last[:-1] = word[1:] != word[:-1]
            rank = np.full(len(symbol), NONE)
            pair = np.flatnonzero(~last)
            rank[pair] = self.ranks(symbol[pair], symbol[pair + 1])
            start = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
            size = np.diff(np.append(start, len(word)))
            least = np.minimum.reduceat(rank, start)
            ended = least == NONE
            for a, n in zip(start[ended], size[ended], strict=True):
                out[word[a]] = symbol[a:a + n]
            take = (rank == np.repeat(least, size)) & (rank != NONE)
            if take.any():
                at = np.flatnonzero(take)  # in a run of overlapping pairs (aaa) every second one
                begins = np.ones(len(at), bool)
                begins[1:] = at[1:] != at[:-1] + 1
                run = np.flatnonzero(begins)
                within = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[within % 2 == 0]
                symbol[at] = self.made[rank[at]]
                keep = ~np.repeat(ended, size)
                keep[at + 1] = False
                symbol, word = symbol[keep], word[keep]
            else:
                break
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word, merges taken from a heap of (rank, place)."""
        sym = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        table = dict(zip(self.key.tolist(), self.rank.tolist(), strict=True)) if not hasattr(self, "table") else self.table
        self.table, base = table, int(self.base)
        heap = [(r, i) for i in range(n - 1) if (r := table.get(sym[i] * base + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j < 0 or table.get(sym[i] * base + sym[j]) != r:
                continue
            sym[i], sym[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (q := table.get(sym[a] * base + sym[b])) is not None:
                    heapq.heappush(heap, (q, a))
        return np.array([s for s in sym if s >= 0], np.int64)

    def learn(self, new: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG_WORD]
        for i, ids in zip(short, self.merge_words([raw[i] for i in short]), strict=True):
            self.known[new[i]] = ids.astype("<u4").tobytes()
        for i, w in enumerate(raw):
            if len(w) > LONG_WORD:
                self.known[new[i]] = self.merge_long(w).astype("<u4").tobytes()

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at:m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            if self.cut and self.cut.search(text):
                cut.append([])
                for part, special in self._parts(text):
                    if special:
                        self.known[part] = int(self.special[part]).to_bytes(4, "little")
                        cut[-1].append(part)
                    else:
                        cut[-1] += self.pattern.findall(part)
            else:
                cut.append(self.pattern.findall(text))
        if len(self.known) > WORDS:
            self.known = {s: int(i).to_bytes(4, "little") for s, i in self.special.items()}
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids, special ones included."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        size = self.length[flat]
        to = np.concatenate(([0], np.cumsum(size)))
        data = self.bytes[np.repeat(self.offset[flat] - to[:-1], size) + np.arange(to[-1])].tobytes()
        at = to[ends]
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def utf8(data: bytes) -> bytes:
    """Bytes that are no UTF-8 replaced by U+FFFD."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()
    return data


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row, and with ``with_ids`` ids and decoded."""
    kind = docs.schema[id_column].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path)
        for b in steps(batches, "text"):
            ids = bpe.encode(b.column("text").to_pylist())
            back = [utf8(x) for x in bpe.decode(ids)]
            cols = [b.column(id_column), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back])]
            if with_ids:
                cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                         pa.array([x.decode() for x in back])]
            yield pa.record_batch(cols, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256",
                                               *(["ids", "decoded"] if with_ids else [])])

    return docs.select(id_column, text_or_empty(F.col("text")).alias("text")).mapInArrow(
        run, f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
