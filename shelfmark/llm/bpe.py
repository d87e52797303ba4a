"""BPE encoding and decoding with a byte-level vocabulary file.

A word is held as a contiguous array of part boundaries and one of the ranks of adjacent
parts. The array is scanned for the minimum, that boundary is deleted, and the two
neighbouring ranks are refreshed, until no pair has a rank. Words longer than
``SCAN_LIMIT`` bytes use the same arrays linked and ordered by a heap, which gives the
same parts without a quadratic scan.

Null texts count as empty and give no ids; lone surrogates cannot occur in Spark strings;
ids and decoded text of equal texts are equal. Special tokens of the file that a text
spells out become their ids, as in the library that the file belongs to.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shelfmark.llm.shared import ship, tidy

#: Bytes of a word up to which a scan for the minimum is used.
SCAN_LIMIT = 256
#: Words that a worker remembers, about 100 bytes each, in two halves: when the newer half is
#: full it becomes the older one, whose words are given up unless they are met again.
REMEMBERED = 120_000
#: Rank of parts that don't merge.
NONE = 1 << 31
#: Rows of a batch that is given back.
ROWS = 500

# The split that byte-level BPE files assume, a fixed value of the format.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

# The same for the characters up to U+00FF, as `re` reads it, in half the time.
_LETTERS, _NUMBERS, _SPACES = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"

# Letters and numbers that Unicode has had only since version 17, which the
# library's tables don't know and so treat as other characters.
NEW_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEW_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _wide_word() -> str:
    """WORD with those characters taken out of letters and numbers."""

    def chars(spans: str) -> str:
        return "".join("-".join(chr(int(x, 16)) for x in span.split("-")) for span in spans.split())

    letter, number = (f"[\\p{{{kind}}}--[{chars(spans)}]]" for kind, spans in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)))
    other = f"[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]|[{chars(NEW_LETTERS)}{chars(NEW_NUMBERS)}]"
    return WORD.replace(r"[^\p{White_Space}\p{L}\p{N}]+", f"(?:{other})+").replace(r" ?\p{L}+", f" ?{letter}+").replace(r" ?\p{N}+", f" ?{number}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [symbols[b] for b in range(256)]


class Codec(dict):
    """Maps a word to the bytes of its ids, little-endian and 32 bits each."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.single = [vocab[s] for s in symbols]
        self.older: dict[str, bytes] = {}
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in special.items()}
        self.special = {s: np.uint32(i).tobytes() for s, i in special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.latin_words = re.compile(LATIN_WORD).findall
        self.wide_words = regex.compile(_wide_word(), regex.V1).findall

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide_words(text)
        return self.latin_words(text)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            parts = [self.single[b] for b in word.encode()]
            size = len(parts)
            parts = self._scan(parts) if size <= SCAN_LIMIT else self._heap(parts)
            ids = struct.pack(f"<{len(parts)}I", *parts)
            if size > SCAN_LIMIT:
                return ids
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _scan(self, parts: list[int]) -> list[int]:
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = new = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((new, parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], new), NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank_of, merged, n = self.ranks.get, self.merged, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of((parts[i], parts[i + 1]), NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i] = new = merged[r]
            parts[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((new, parts[k]), NONE)) != NONE:
                    heapq.heappush(heap, (r, i, new, parts[k]))
            if (h := before[i]) >= 0 and (r := rank_of((parts[h], new), NONE)) != NONE:
                heapq.heappush(heap, (r, h, parts[h], new))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian and 32 bits each."""
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.__getitem__, self.words(text)))
        return b"".join(self.special.get(piece) or b"".join(map(self.__getitem__, self.words(piece))) for piece in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        """The text of such ids; byte sequences that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row per row of `docs`: key, n_tokens, ids_sha256, decoded_sha256 and, with `ids`, ids (binary).

    `vocabulary` is the path of a tokenizer file on every executor. No shuffle; a worker
    holds one text with its ids at a time besides its batch. Other columns of `docs` play
    no part, whatever their names.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    fields = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids

    def run(batches):
        own = codec(vocabulary)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, len(b), ROWS)):
            keep, counts, shas, back = [], [], [], []
            for value in batch.column(1):
                coded = own.encode(value.as_py() or "")
                counts.append(len(coded) // 4)
                shas.append(hashlib.sha256(coded).hexdigest())
                back.append(hashlib.sha256(own.decode(coded).encode()).hexdigest())
                if ids:
                    keep.append(coded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array(keep, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key, text).mapInArrow(tidy(run), fields)
