"""Token ids by a public byte-pair vocabulary: propose greedily, check the seams, merge exactly only where they fail."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pattern that parts a text into words for this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and seams remembered by a Python worker; beyond it the memory starts anew.
REMEMBERED = 200_000


class Vocabulary:
    """A byte-pair vocabulary (token bytes to rank) with an encoder."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.longest = max(map(len, ranks))
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(WORDS).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.seams = np.empty(0, np.int64)
        self.sound = np.empty(0, bool)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left. Every single byte is a token, so this always ends."""
        out, at, end, ranks = [], 0, len(word), self.ranks
        while at < end:
            for stop in range(min(end, at + self.longest), at, -1):
                rank = ranks.get(word[at:stop])
                if rank is not None:
                    out.append(rank)
                    at = stop
                    break
        return out

    def merge(self, word: bytes) -> list[int]:
        """The exact merging: the adjacent pair of lowest rank first, leftmost among equals."""
        n, ranks = len(word), self.ranks
        start, after, before, dead = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or end[j] != stop or start[i] != i:
                continue
            dead[j], end[i], after[i] = True, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                r = ranks.get(word[i : end[after[i]]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            p = before[i]
            if p >= 0:
                r = ranks.get(word[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        return [ranks[word[i : end[i]]] for i in range(n) if not dead[i]]

    def check(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours is what exact merging makes of their joint bytes."""
        pairs, where = np.unique(left.astype(np.int64) * self.size + right, return_inverse=True)
        at = np.searchsorted(self.seams, pairs)
        known = at < len(self.seams)
        known[known] = self.seams[at[known]] == pairs[known]
        fresh = pairs[~known]
        if len(fresh):
            ok = np.fromiter((self.merge(self.tokens[p // self.size] + self.tokens[p % self.size]) == [p // self.size, p % self.size] for p in fresh.tolist()), bool, len(fresh))
            if len(self.seams) > 5 * REMEMBERED:
                self.seams, self.sound = np.empty(0, np.int64), np.empty(0, bool)
                return self.check(left, right)
            order = np.argsort(seams := np.concatenate([self.seams, fresh]))
            self.seams, self.sound = seams[order], np.concatenate([self.sound, ok])[order]
        return self.sound[np.searchsorted(self.seams, pairs)][where]

    def learn(self, words: list[str]) -> None:
        """Encodes new words together: proposals, one check of all their seams, exact merging of those that fail."""
        raw = [w.encode("utf-8", "replace") for w in words]
        proposals = [[whole] if (whole := self.ranks.get(b)) is not None else self.propose(b) for b in raw]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(proposals)), sizes)
        inner = np.flatnonzero(of[1:] == of[:-1])
        failing: set[int] = set()
        if len(inner):
            failing = set(of[inner[~self.check(flat[inner], flat[inner + 1])]].tolist())
        for k, (word, proposal) in enumerate(zip(words, proposals)):
            self.words[word] = tuple(self.merge(raw[k]) if k in failing else proposal)

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self.split(t) for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        fresh = {w for p in parts for w in p if w not in self.words}
        if fresh:
            self.learn(list(fresh))
        known = self.words
        return [[i for w in p for i in known[w]] for p in parts]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    lines = Path(path).read_bytes().splitlines()
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))})


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The token ids of each text as an array of int, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list. A text of any length is encoded whole.
    """
    path = f"{folder}/{name}.tiktoken"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for batch in batches:
            yield pd.Series(v.encode(batch.fillna("").tolist()), index=batch.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))(text)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids) of every row; one narrow pass, no shuffle. Repeated rows stay repeated, other columns are left out."""
    return docs.select(F.col(id_col), F.coalesce(token_ids(F.col(text_col), name, folder), F.array().cast("array<int>")).alias("ids"))
