"""Byte-level BPE by speculation and verification.

Each distinct pre-token is first cut greedily into longest vocabulary entries. A cut is the
true encoding when every token encodes to itself and every two adjacent tokens encode,
joined, to just these two; both facts are looked up for all pairs of a batch at once in
sorted tables of known verdicts, which grow as new pairs are met. Only pre-tokens with a
failing pair go through the exact merges.

Null and empty texts have no tokens. Special tokens inside a text become their ids and are
written out again by decoding, as the tokenizers library does by default. Rows are encoded
one by one: ties, repeated rows, null ids and extra columns do not matter, as only doc_id and text are
read. Texts of any length are encoded whole, each in one task; pre-tokens are known by their bytes. An
empty table gives an empty result. The vocabulary file's path is a parameter and is opened on each
executor.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from tablewright.llm._arrow import map_texts
from tablewright.llm._pretokens import IdCache


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def spans(chars: str) -> list[tuple[str, str]]:
    """First and last of each run of consecutive characters."""
    out: list[list[str]] = []
    for c in chars:
        if out and ord(out[-1][1]) == ord(c) - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def unassigned() -> str:
    """Letters and numbers of the regex module that the tokenizers library, with other Unicode tables,
    does not take for such. Only characters that Python's tables lack are in doubt."""
    whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    doubtful = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    return "".join(c for c in doubtful if len(whole("a" + c)) > 1 and len(whole("1" + c)) > 1)


def latin(text: str) -> bool:
    """Whether all characters are below 256, where no Unicode table changes any more."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Vocabulary:
    """Tokens, merge ranks and special tokens of one vocabulary file, with the verdicts found so far."""

    #: Fixed value: the pre-token pattern that the vocabulary was made with.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        raw = lambda s: bytes(of[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.size = max(self.tokens) + 1
        self.table = pa.array([self.tokens.get(i, b"") for i in range(self.size)], pa.large_binary())
        self.longest = max(map(len, self.ids))
        self.split = self.own_split = regex.compile(self.PATTERN)
        if late := unassigned():  # they count as neither letters nor numbers
            inside = "".join(f"{a}-{b}" for a, b in spans(late))
            pattern = self.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{inside}])").replace(r"?\p{L}+", rf"?(?:(?![{inside}])\p{{L}})+").replace(r"?\p{N}+", rf"?(?:(?![{inside}])\p{{N}})+")
            self.late, self.split = regex.compile(f"[{inside}]"), regex.compile(pattern)
        else:
            self.late = None
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache = IdCache(self.pretokens, self.special, self.cut, self.learn)
        self.self_ok = np.full(self.size, -1, np.int8)
        self.known = np.zeros(0, np.int64)  # sorted pairs a * size + b
        self.good = np.zeros(0, bool)

    def merged(self, word: bytes) -> list[int]:
        """Exact merges, lowest rank first and leftmost among equals, with a heap over a linked list."""
        ids = [self.ids[bytes([b])] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merges.get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return [x for x in ids if x >= 0]

    def greedy(self, word: bytes) -> list[int]:
        out, at, ids, longest = [], 0, self.ids, self.longest
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                if (i := ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For adjacent tokens, whether the pair and both tokens stand in an exact encoding."""
        keys = a.astype(np.int64) * self.size + b
        asked = np.unique(keys)
        at = np.searchsorted(self.known, asked)
        new = asked[~((at < len(self.known)) & (self.known[np.minimum(at, max(0, len(self.known) - 1))] == asked))] if len(self.known) else asked
        if len(new):
            verdicts = [self.merged(self.tokens[x] + self.tokens[y]) == [x, y] for x, y in zip((new // self.size).tolist(), (new % self.size).tolist(), strict=True)]
            known, good = np.concatenate([self.known, new]), np.concatenate([self.good, np.array(verdicts, bool)])
            order = np.argsort(known)
            self.known, self.good = known[order], good[order]
        for t in np.unique(np.concatenate([a, b])).tolist():
            if self.self_ok[t] < 0:
                self.self_ok[t] = self.merged(self.tokens[t]) == [t]
        return self.good[np.searchsorted(self.known, keys)] & (self.self_ok[a] == 1) & (self.self_ok[b] == 1)

    def learn(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        """Encode distinct pre-tokens: propose, verify all adjacent pairs at once, mend what fails."""
        special = {t.encode(): i for t, i in self.special.items()}
        if any(w in special for w in raw):
            plain = iter(self.learn([w for w in raw if w not in special]))
            return [(special[w],) if w in special else next(plain) for w in raw]
        proposed = [self.greedy(b) for b in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(itertools.chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(raw)), sizes)
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        failed = np.zeros(len(raw), bool)
        if len(joined):
            wrong = ~self.compatible(flat[joined], flat[joined + 1])
            failed[owner[joined][wrong]] = True
        for i in np.flatnonzero(failed).tolist():
            proposed[i] = self.merged(raw[i])
        return list(map(tuple, proposed))

    def pretokens(self, text: str) -> list[str]:
        """The text's pre-tokens; the pattern without late characters is faster and serves most texts."""
        late = self.late is not None and not latin(text) and self.late.search(text)
        return (self.split if late else self.own_split).findall(text)

    def decode(self, flat: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of ids flat[first[i]:first[i + 1]]: the tokens' bytes, joined."""
        joined = self.table.take(pa.array(flat.astype(np.int64)))
        cuts = np.frombuffer(joined.buffers()[1], np.int64)[first].tolist() if len(flat) else [0] * len(first)
        raw = joined.buffers()[2].to_pybytes() if len(flat) else b""
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the encoding of every whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, first = vocabulary(path).cache.encode(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.view(np.int32)))], ["doc_id", "ids"])

    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids and digest of the text decoded from them."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        flat, first = v.cache.encode(batch.column(1))
        digests = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        decoded = [hashlib.sha256(text.encode()).hexdigest() for text in v.decode(flat, first)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(digests), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
