"""Evaluation texts in training text: an FM-index per shard, searched backwards for the phrases of all items."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words in a phrase, words in a shard, and the step at which suffix positions are kept.
PHRASE, SHARD, STEP = 3, 400_000, 8
#: Share of an item's words that a document must hold, in order, to count as a leak.
SHARE = 0.5
#: Words of a piece that counts wherever it stands in a document, words between two of its phrases, and pieces of a leak.
PIECE, GAP, FEW = 5, 3, 4
#: Characters of items that are broadcast at once; more items take more passes over the documents.
SENT = 200_000_000
#: Items are searched in blocks of so many words at most; each block is one pass over a shard's index.
BLOCK = 2_000_000

_WORDS = regex.compile(r"[^\W_]+")
_CLOSE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: A character of a script that doesn't part its words, or a run of other letters and digits.
_CLOSE_WORDS = regex.compile(rf"(?V1)[{_CLOSE}]|[[^\W_]--[{_CLOSE}]]+")
_ANY_CLOSE = regex.compile(rf"[{_CLOSE}]")


def words_of(text: str) -> list[str]:
    """The words of a text: runs of letters and digits, single characters in scripts that don't part words;
    compatibility forms and case undone."""
    plain = unicodedata.normalize("NFKC", text).casefold()
    return (_WORDS if plain.isascii() or not _ANY_CLOSE.search(plain) else _CLOSE_WORDS).findall(plain)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of an integer sequence, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    """Counts and locates words of small integers in a text; ranks come from a wavelet matrix of its BWT.

    The text must end with a 0 that stands nowhere else. All searches are vectorised over their phrases.
    """

    def __init__(self, text: np.ndarray, sigma: int, step: int = STEP):
        order = suffix_order(text)
        n = self.n = len(text)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for k in range(self.levels - 1, -1, -1):
            bit = (level >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt
        self.kept = order % step == 0
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept, dtype=np.int32)])
        self.samples = order[self.kept]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the BWT before each position."""
        begin, end = np.zeros_like(upto), upto.copy()
        for k, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros):
            bit = ((symbol >> k) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin = np.where(bit, zeros + b, begin - b)
            end = np.where(bit, zeros + e, end - e)
        return end - begin

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each row of ``phrases``, read from its last word to its first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k]
            low = self.first[symbol] + self.rank(symbol, low)
            high = self.first[symbol] + self.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to the next position that is kept."""
        at, steps, out = suffixes.astype(np.int64).copy(), np.zeros(len(suffixes), np.int64), np.empty(len(suffixes), np.int64)
        open_ = np.arange(len(suffixes))
        while len(open_):
            here = at[open_]
            done = self.kept[here]
            hit = open_[done]
            out[hit] = self.samples[self.kept_before[at[hit]]] + steps[hit]
            open_ = open_[~done]
            symbol = self.bwt[at[open_]]
            at[open_] = self.first[symbol] + self.rank(symbol, at[open_])
            steps[open_] += 1
        return out % self.n


class Items:
    """The phrases of a block of items, over the vocabulary of the block. 0 ends a text, 1 is any other word."""

    def __init__(self, items: list[tuple[object, list[str]]], phrase: int):
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(w) for _, w in items], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.vocabulary: dict[str, int] = {}
        rows, of, at = [], [], []
        for k, (_, words) in enumerate(items):
            coded = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words]
            for p in range(len(coded) - phrase + 1):
                rows.append(coded[p : p + phrase])
                of.append(k)
                at.append(p)
        table = np.array(rows, np.int64).reshape(-1, phrase)
        self.phrases, which = np.unique(table, axis=0, return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.of, self.at = np.array(of, np.int64)[order], np.array(at, np.int64)[order]
        self.begin = np.searchsorted(which[order], np.arange(len(self.phrases) + 1))


def _shard_leaks(docs: list[tuple[object, list[str]]], items: Items, phrase: int, share: float) -> list[tuple]:
    """(doc, item, words held, pieces) of each leak in a shard; a piece is (first word, last word), counted from 0."""
    coded, home, place = [], [], []
    code = items.vocabulary.get
    for d, (_, words) in enumerate(docs):
        ids = np.fromiter((code(w, 1) for w in words), np.int64, len(words))
        keep = np.ones(len(ids), bool)  # a run of other words is one separator; so is the seam between documents
        keep[1:] = (ids[1:] != 1) | (ids[:-1] != 1)
        at = np.flatnonzero(keep)
        coded += [ids[at], [1]]
        home.append(np.full(len(at) + 1, d))
        place.append(np.concatenate([at, [len(words)]]))
    text = np.concatenate([*coded, [0]]).astype(np.int64)
    if len(text) < phrase + 1 or not len(items.phrases):
        return []
    home_, place_ = np.concatenate(home), np.concatenate(place)
    index = FMIndex(text, len(items.vocabulary) + 2)
    low, high = index.search(items.phrases)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    suffix = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    spot = index.locate(suffix)
    fan = items.begin[which + 1] - items.begin[which]
    row = np.repeat(items.begin[which] - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan) + np.arange(fan.sum())
    spot = np.repeat(spot, fan)
    item, at, doc, word = items.of[row], items.at[row], home_[spot], place_[spot]
    pair = doc * len(items.ids) + item
    cover = np.unique((pair[:, None] * (items.longest + phrase) + at[:, None] + np.arange(phrase)).ravel()) // (items.longest + phrase)
    pairs, held = np.unique(cover, return_counts=True)
    pairs = pairs[held >= share * items.sizes[pairs % len(items.ids)]]
    order = np.lexsort((at, word, pair))
    pair, at, word = pair[order], at[order], word[order]
    out = []
    for p, b, e in zip(pairs, np.searchsorted(pair, pairs), np.searchsorted(pair, pairs, side="right")):
        size = int(items.sizes[p % len(items.ids)])
        got = _in_order(word[b:e].tolist(), at[b:e].tolist(), phrase, size)
        if got is None or got[0] < share * size:
            got = _pieces(word[b:e].tolist(), at[b:e].tolist(), phrase)
        if got and got[0] >= share * size:
            out.append((docs[p // len(items.ids)][0], items.ids[p % len(items.ids)], *got))
    return out


def _chain(words: list[int], at: list[int], begin: int, end: int) -> list[int]:
    """The longest chain of hits whose places in item and document both rise, as indices in falling order."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * (end - begin)
    # equal words in falling order of place, so that a chain takes one place per word
    local = sorted(range(begin, end), key=lambda i: (words[i], -at[i]))
    for n, i in enumerate(local):
        pos = bisect_left(tails, at[i])
        back[n] = ends[pos - 1] if pos else -1
        if pos == len(tails):
            tails.append(at[i])
            ends.append(n)
        else:
            tails[pos], ends[pos] = at[i], n
    n, chain = ends[-1], []
    while n >= 0:
        chain.append(local[n])
        n = back[n]
    return chain


def _spans(words: list[int], chain: list[int], phrase: int, gap: int) -> list[tuple[int, int]]:
    """The stretches of a document that a chain covers, parted where more than ``gap`` words lie between two phrases."""
    spans: list[list[int]] = []
    for i in reversed(chain):
        if spans and words[i] - spans[-1][1] - 1 <= gap:
            spans[-1][1] = max(spans[-1][1], words[i] + phrase - 1)
        else:
            spans.append([words[i], words[i] + phrase - 1])
    return [tuple(s) for s in spans]


def _in_order(words: list[int], at: list[int], phrase: int, size: int) -> tuple[int, list[tuple[int, int]]] | None:
    """Words of the item held by the longest chain of phrases in its order within one passage, and its pieces.

    Phrases further apart than the item is long (and 20 words) belong to different passages.
    """
    best = None
    begin = 0
    for k in range(1, len(words) + 1):
        if k == len(words) or words[k] - words[k - 1] > size + 20:
            chain = _chain(words, at, begin, k)
            held = len({p for i in chain for p in range(at[i], at[i] + phrase)})
            if best is None or held > best[0]:
                best = held, _spans(words, chain, phrase, 20)
            begin = k
    return best


def _pieces(words: list[int], at: list[int], phrase: int) -> tuple[int, list[tuple[int, int]]] | None:
    """Words of the item held by its few longest pieces anywhere in the document, and these pieces, in the item's order.

    A piece is a run of phrases that follow each other in item and document alike and hold PIECE words at least, so
    that short shared phrases don't add up.
    """
    runs: list[list[int]] = []  # first place in the item, words held, first and last word, last place
    open_: dict[int, list[int]] = {}  # the latest run by drift between document and item
    for a, w in zip(at, words):
        run = None
        for drift in range(w - a - GAP, w - a + GAP + 1):
            old = open_.get(drift)
            if old and 0 < a - old[4] <= phrase + GAP and 0 < w + phrase - 1 - old[3] <= phrase + GAP:
                run = open_.pop(drift)
                break
        if run is None:
            run = [a, phrase, w, w + phrase - 1, a]
            runs.append(run)
        else:
            run[1] += min(phrase, a - run[4])
            run[3], run[4] = w + phrase - 1, a
        open_[w - a] = run
    best: list[tuple[int, int, int, int, int]] = []
    for place, held, first, last, end in sorted((r for r in runs if r[1] >= PIECE), key=lambda r: -r[1]):
        # the longest first; one that overlaps a chosen one in the item or stands out of order is left out
        fits = all((place >= e + phrase and first > z) or (end + phrase <= p and last < a) for p, _, a, z, e in best)
        if fits and len(best) < FEW:
            best.append((place, held, first, last, end))
    if not best:
        return None
    return sum(r[1] for r in best), sorted((r[2], r[3]) for r in best)


def _search(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, phrase: int, share: float, shard: int, block: int, sent_chars: int) -> DataFrame:
    found = items.select(item_col, item_text).where(F.col(item_text).isNotNull() & (F.col(item_text) != "")).distinct()
    total = found.agg(F.sum(F.length(item_text))).first()[0] or 0
    passes = max(1, -(-total // sent_chars))
    doc_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc {doc_type}, item {item_type}, held int, pieces array<struct<first:int,last:int>>"
    out = None
    for k in range(passes):
        rows = found.where(F.pmod(F.xxhash64(item_text), F.lit(passes)) == k).collect()  # the stated queries, of bounded size
        blocks: list[list] = [[]]
        size = 0
        for r in sorted(rows, key=lambda r: str(r[0])):
            words = words_of(r[1])
            if size + len(words) > block and blocks[-1]:
                blocks.append([])
                size = 0
            if words:
                blocks[-1].append((r[0], words))
                size += len(words)
        part = docs.select(id_col, text_col).mapInPandas(_searcher(docs.sparkSession.sparkContext.broadcast(blocks), phrase, share, shard), schema)
        out = part if out is None else out.unionByName(part)
    return out.toDF(id_col, item_col, "held", "pieces")


def _searcher(sent, phrase: int, share: float, shard: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = [b for b in sent.value if b]
        only = [Items(blocks[0], phrase)] if len(blocks) == 1 else None  # else one block's tables at a time

        def search(part: list) -> pd.DataFrame:
            ready = only if only is not None else (Items(b, phrase) for b in blocks)
            rows = [x for b in ready for x in _shard_leaks(part, b, phrase, share)]
            return pd.DataFrame([(d, i, h, [{"first": a, "last": z} for a, z in p]) for d, i, h, p in rows], columns=["doc", "item", "held", "pieces"])

        part, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                if text:
                    part.append((doc, words_of(text)))
                    n += len(part[-1][1])
                    if n >= shard:
                        yield search(part)
                        part, n = [], 0
        if part:
            yield search(part)

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", phrase: int = PHRASE, share: float = SHARE, shard: int = SHARD, block: int = BLOCK, sent_chars: int = SENT) -> DataFrame:
    """(id, item, held, pieces): the documents that hold at least ``share`` of an item's words in its order.

    Every partition is indexed in shards of whole documents (about ``shard`` words; a longer document is a shard of
    its own), and all phrases of the stated items are searched in each, in blocks of ``block`` words. One narrow pass
    over the documents for each ``sent_chars`` characters of items. An item counts as held in one passage, or in a few
    longer pieces wherever they stand. pieces (first, last), in words of the document, are what to remove for that item.
    Items shorter than a phrase, null and empty texts give nothing; repeated items count once.
    """
    return _search(docs, items, id_col, text_col, item_col, item_text, phrase, share, shard, block, sent_chars)


def removal_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, first, last): the stretches of words to remove from each document, merged over all items of :func:`leaks`.

    Pieces that overlap or touch become one. Equal pieces of many items are one row before a document's pieces meet,
    which no more than the square of its length can be; null ids are a group.
    """
    pieces = found.select(id_col, F.explode("pieces").alias("p")).groupBy(id_col, F.col("p.first").alias("first")).agg(F.max("p.last").alias("last"))
    w = Window.partitionBy(id_col).orderBy("first")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")
    marked = pieces.withColumn("__new", fresh).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(id_col, "__g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__g")
