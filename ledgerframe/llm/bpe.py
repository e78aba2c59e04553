"""BPE encoding and decoding by a prefix-sharing trie over distinct words.

The distinct words of a batch form a trie, walked depth first (in sorted
order, so that the path to a word is what the word before left of it). A
node keeps one state: the last token of the encoding of the bytes that
lead to it. That token is the longest vocabulary entry ending there that
is stable beside the state it continues, so shared prefixes are encoded
once and a word's ids are read by stepping back from its end.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import kept, map_texts

#: white space as the byte-level pre-tokenizer knows it (fixed value)
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: the published byte-level split (fixed value)
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
         rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: words whose encodings a worker keeps; beyond it the store starts afresh (memory bound only)
KEPT_WORDS = 300_000
KEPT_PAIRS = 1_500_000
#: longer words are not kept
KEPT_BYTES = 64


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: itself if visible, else the next code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        symbol = _byte_symbols()
        as_bytes = lambda s: bytes(symbol[c] for c in s)
        vocab = data["model"]["vocab"]
        self.bytes_of = {i: as_bytes(s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = {v: vocab[s] for s, v in symbol.items() if s in vocab}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(data["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        # only tokens that merging reaches can stand in an encoding
        self.id_of = {self.bytes_of[i]: i for i in vocab.values() if self.merged(self.bytes_of[i]) == [i]}
        self.longest = max(map(len, self.id_of), default=1)
        self.stable: dict[int, bool] = {}
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        self.split = regex.compile(SPLIT)

    def merged(self, word: bytes) -> list[int]:
        """Encoding by the merge rule itself, for a short word: lowest rank first, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        while len(ids) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank),
                       default=None)
            if best is None:
                break
            (_, new), i = best
            ids[i:i + 2] = [new]
        return ids

    def stand(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together."""
        key = left << 32 | right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= KEPT_PAIRS:
                self.stable.clear()
            known = self.stable[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.kept: dict[str, tuple[int, bytes, bytes]] = {}

    def _walk(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of sorted distinct words: depth-first over their trie."""
        id_of, stand, longest, bytes_of = self.v.id_of, self.v.stand, self.v.longest, self.v.bytes_of
        last: list[int] = [-1]  # last[i]: last token of the first i bytes of the path
        size: list[int] = [0]
        before, out = b"", []
        for word in words:
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1:], size[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = id_of.get(word[start:end])
                    if token is not None and (start == 0 or stand(last[start], token)):
                        break
                last.append(token)
                size.append(end - start)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            out.append(ids[::-1])
            before = word
        return out

    def _learn(self, words: set[str]) -> dict[str, tuple[int, bytes, bytes]]:
        order = sorted((w.encode(), w) for w in words)
        found = {}
        for (_, word), ids in zip(order, self._walk([b for b, _ in order])):
            found[word] = (len(ids), struct.pack(f"<{len(ids)}I", *ids),
                           b"".join(self.v.bytes_of[i] for i in ids))
        return found

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Per text: number of ids, ids as little-endian 32-bit integers, bytes decoded from them."""
        split, marks, special = self.v.split, self.v.marks, self.v.special
        cut: list[list[str]] = []
        for text in texts:
            words: list[str] = []
            for part in marks.split(text) if marks else (text,):
                if part in special:
                    words.append(part)
                elif part:
                    words += split.findall(part)
            cut.append(words)
        fresh = set().union(*cut) - self.kept.keys()
        if len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept = {}
            fresh = set().union(*cut)
        found = self._learn(fresh - special.keys())
        kept = self.kept
        kept.update(found)
        for mark, i in special.items():
            kept[mark] = (1, struct.pack("<I", i), self.v.bytes_of[i])
        out = []
        for words in cut:
            got = [kept[w] for w in words]
            out.append((sum(g[0] for g in got), b"".join([g[1] for g in got]), b"".join([g[2] for g in got])))
        for w, x in found.items():
            if len(x[2]) > KEPT_BYTES:
                del kept[w]
        return out


def _encoder(spec_key: int, spec: str) -> Encoder:
    return kept(("bpe", spec_key), lambda: Encoder(Vocabulary(spec)))


def _read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, keep: list[str], text: str, tokenizer_path: str) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids`` and ``decoded`` (text) of every row.

    The vocabulary file (a few MB, of fixed size) is read where the plan is
    built and broadcast. Null or empty text: no ids, empty decoded text.
    A word of any length is one path of the trie; nothing is cut.
    """
    spark: SparkSession = docs.sparkSession
    spec = _read_spec(tokenizer_path)
    key, shipped = hash(spec), spark.sparkContext.broadcast(spec)

    def make():
        encoder = _encoder(key, shipped.value)

        def work(texts):
            got = encoder.encode([t.decode() for t in texts])
            return {"n_tokens": [g[0] for g in got],
                    "ids": [np.frombuffer(g[1], dtype="<u4").astype(np.int32) for g in got],
                    "decoded": [g[2].decode("utf-8", "replace") for g in got]}
        return work

    return map_texts(docs, keep, text, make, "n_tokens bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, keep: list[str], text: str, tokenizer_path: str) -> DataFrame:
    """As ``encoded``, with SHA-256 digests in place of ids and decoded text."""
    spark: SparkSession = docs.sparkSession
    spec = _read_spec(tokenizer_path)
    key, shipped = hash(spec), spark.sparkContext.broadcast(spec)

    def make():
        encoder = _encoder(key, shipped.value)

        def work(texts):
            got = encoder.encode([t.decode() for t in texts])
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return {"n_tokens": [g[0] for g in got], "ids_sha256": [sha(g[1]) for g in got],
                    "decoded_sha256": [sha(g[2].decode("utf-8", "replace").encode()) for g in got]}
        return work

    return map_texts(docs, keep, text, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
