"""Texts cut off before their end, by what usually follows their final context."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lookalike import _LATIN, _plain_form, script
from corpusloom.plans import cut, lookup_join, spread

#: Lengths of the final contexts, in characters, longest first.
ORDERS = (24, 16, 11, 7, 4)
#: Bits a context in the filter that passes the contexts asked for; most bits of one filter. More contexts take more passes.
BITS_A_CONTEXT, FILTER_BITS = 16, 1 << 28
#: Weight, in occurrences, of the next shorter context in the estimate for a longer one; chance of an end anywhere.
BACKOFF, ANYWHERE = 3.0, 1 / 110
#: Characters of texts laid out at once by a task, few enough for a core's cache; contexts that it gathers before it counts them.
SLICE, GATHERED = 100_000, 2_000_000
#: Width of the bins of odds in which thresholds are fitted, the odds they reach to, rounds of the fit at most.
BIN, REACH, ROUNDS = 0.5, 40, 200
#: Odds below which the model alone settles that a text ends, by its end mark: where it ends likelier than not, or, in
#: spite of a comma or ellipsis, almost surely (as after a formula that often ends texts).
ENDS = {"none": 0.0, "mark": -5.0}
#: Share of cut texts among those of an end mark before any text is seen, and the texts that it counts for; the texts that
#: a column's odds count for in those of one of its languages.
SHARES, PRIOR, POOLED = {"stop": 0.0005, "mark": 0.7, "none": 0.3}, 5.0, 100.0

_BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MARKS = _BLANK + ".…,;:-–—¬~�"
_MARKED = ("..", *"…�,;:-–—¬~")
_CLOSING = "'\"”’»)]"
_STOPS = [ord(c) for c in ".!?"]
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Plain(dict):
    """Characters to their plain form, filled as they are met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        ch = _LATIN.get(ch, _plain_form(ch)[0])
        if ch.isspace():
            ch = " "
        elif ch.isdigit() and len(ch) == 1 and unicodedata.category(ch) == "Nd":
            ch = "0"
        self[code] = ch
        return ch


_PLAIN = _Plain()
_PLAIN_ASCII = bytes(ord(_PLAIN[k].lower()) for k in range(128)).ljust(256)
_SQUEEZE = re.compile("00+")


def plain(text: str) -> str:
    """Lower case, look-alike characters and line breaks undone, numbers as one 0."""
    text = text.encode().translate(_PLAIN_ASCII).decode() if text.isascii() else text.translate(_PLAIN)
    return (_SQUEEZE.sub("0", text) if "00" in text else text).lower()


def end_of(text: str) -> str:
    """The text without the marks at its end."""
    return text.rstrip(_MARKS)


def mark_of(text: str) -> str:
    """What stands at the end: stop, mark (ellipsis, comma, dash and the like) or none."""
    text = text.rstrip()
    if text.endswith(_MARKED):
        return "mark"
    closed = text.rstrip(_CLOSING)
    return "stop" if text.endswith(("。", "！", "？")) or (closed.endswith((".", "!", "?")) and closed[-2:-1] != ".") else "none"


# Common little words by language.
LITTLE = {
    "en": "the of and to in is that it for as with by on are this be an or from which not at".split(),
    "de": "der die das und ist nicht ein eine von zu mit den dem des sich auf für als auch werden".split(),
    "fr": "le la les et des est une un du dans que qui pour par sur pas sont au aux ne".split(),
    "es": "el la los las y de que en un una es por con para se del al no su como".split(),
}
_SPEAKS = {w: tuple(n for n, some in LITTLE.items() if w in some) for some in LITTLE.values() for w in some}


def language_of(text: str) -> str:
    """The language whose little words are the most in a text, the first of LITTLE among equals; else the script of its
    last letter."""
    votes: dict[str, int] = {}
    for w in text.split():
        for n in _SPEAKS.get(w, ()):
            votes[n] = votes.get(n, 0) + 1
    if votes:
        return max(LITTLE, key=lambda n: votes.get(n, 0))
    return next((script(c) for c in reversed(text) if c.isalpha()), "")


def _layout(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array of characters, each led by blanks; the position of each end without marks; what follows
    each position: 0 a full stop that ends something, 1 more text, 2 a text's end without one, 3 nothing to count."""
    pad = "\x02" * ORDERS[0]
    codes = np.frombuffer("".join(pad + t + "\x03" for t in texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(pad) + 1
    ends = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + len(pad) + np.fromiter((len(end_of(t)) for t in texts), np.int64, len(texts))
    stop = np.flatnonzero((codes == _STOPS[0]) | (codes == _STOPS[1]) | (codes == _STOPS[2]))
    stop = stop[np.isin(codes[stop + 1], [32, 3, 34, 39, 41, 0x201D]) & (codes[stop - 1] != 46)]
    kind = np.ones(len(codes) + 1, np.int8)
    kind[stop] = 0
    kind[:-1][codes < 4] = 3
    kind[-1] = 3
    kind[ends[kind[ends] != 0]] = 2
    return codes, ends, kind


_ODD = 0xBF58476D1CE4E5B9
_UNDO = pow(_ODD, -1, 1 << 64)
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _UNDO)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _sums(codes: np.ndarray) -> np.ndarray:
    """Running sums of mixed characters times powers of an odd base, from which :func:`_hash` takes windows of any length."""
    up, _ = _power(len(codes) + 1)
    with np.errstate(over="ignore"):
        c = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        c ^= c >> np.uint64(29)
        c *= up[:-1]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(c, dtype=np.uint64, out=sums[1:])
    return sums


def _hash(sums: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the ``ORDERS[k]`` characters before the positions ``at``: a difference of sums, set to the same place by a power of the inverse."""
    _, down = _power(len(sums))
    with np.errstate(over="ignore"):
        h = sums[at]
        h -= sums[at - ORDERS[k]]
        h *= down[at]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h += np.uint64(ORDERS[k])
    return h


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of about ``SLICE`` characters; a longer text is a list of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + ORDERS[0]
    if part:
        yield part


def _final_contexts(rows: DataFrame) -> DataFrame:
    """(table_name, row_id, source, mark, language, body, plain, own, h0..h4) of each text; body is a hash of its plain
    form without the marks at its end, on which the contexts depend alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, string = b["text"].to_pylist(), b["text"].type
            forms = [plain(t) for t in texts]
            bodies = [end_of(t) for t in forms]
            codes, ends, kind = _layout([t[max(0, len(e) - ORDERS[0]) :] for t, e in zip(forms, bodies)])  # only the last characters tell
            sums = _sums(codes)
            out = {c: b[c] for c in ("table_name", "row_id", "source")}
            out["mark"], out["language"] = pa.array(map(mark_of, texts), string), pa.array(map(language_of, forms), string)
            out["body"] = np.fromiter(map(xxhash.xxh64_intdigest, bodies), np.uint64, len(forms)).view(np.int64)
            out["plain"], out["own"] = pa.array(forms, string), kind[ends].astype(np.int32)
            for k in range(len(ORDERS)):
                out[f"h{k}"] = _hash(sums, ends, k).view(np.int64)
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, "table_name string, row_id long, source string, mark string, language string, body long, plain string, own int, " + ", ".join(f"h{k} long" for k in range(len(ORDERS))))


def _filter(texts: DataFrame, bits: int, part: int, parts: int) -> np.ndarray:
    """The bits of the final contexts of one part: at most FILTER_BITS / 64 numbers come to the driver."""
    names = [f"h{k}" for k in range(len(ORDERS))]
    h = texts.where(F.pmod(names[-1], F.lit(parts)) == part).select(F.explode(F.array(*names)).alias("h"))
    slot = F.shiftrightunsigned("h", 20).bitwiseAND(bits - 1)
    words = h.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _all_counts(texts: DataFrame) -> DataFrame:
    """:func:`_counts` of all final contexts, in as many passes over the texts as their filters need.

    The contexts of one end are all in the part of the shortest, so that a part has the endings of its contexts.
    """
    n = texts.select(F.explode(F.array(*(f"h{k}" for k in range(len(ORDERS))))).alias("h")).agg(F.approx_count_distinct("h", 0.02)).first()[0]
    parts = -(-n * BITS_A_CONTEXT // FILTER_BITS) or 1
    bits = 1 << min(max(n // parts * BITS_A_CONTEXT, 1 << 20).bit_length(), FILTER_BITS.bit_length() - 1)
    plain_ = spread(texts.select("plain"))
    return reduce(DataFrame.unionByName, [_counts(plain_, _filter(texts, bits, k, parts), k, parts) for k in range(parts)])


def _merged(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, each once, and their rows of three counts added up."""
    h, table = np.concatenate([h for h, _ in some]), np.concatenate([t for _, t in some])
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
    return h[first], np.add.reduceat(table[order], first) if len(h) else table


def _counted(met: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the hashes met before each of three kinds of position."""
    some = [np.unique(np.concatenate(h), return_counts=True) for h in met]
    return _merged([(h, n[:, None] * (np.arange(3) == k)) for k, (h, n) in enumerate(some)])


def _counts(texts: DataFrame, bits: np.ndarray, part: int = 0, parts: int = 1) -> DataFrame:
    """(h, ended, went_on, stopped) of the contexts in the filter, over every position of every text in its plain form.

    A context is looked for only where its ending, a shorter one, was found, as the endings of all in the filter are in it.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bits)
    size = np.uint64(len(bits) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = sent.value.view(np.uint8)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        met: list[list[np.ndarray]] = [[], [], []]
        held = 0
        for b in batches:
            for some in _slices(b["plain"].to_pylist()):
                codes, _, kind = _layout(some)
                sums = _sums(codes)
                for what, hashes in enumerate(met):
                    at = np.flatnonzero(kind == what)
                    for k in reversed(range(len(ORDERS))):
                        h = _hash(sums, at, k)
                        if parts > 1 and ORDERS[k] == ORDERS[-1]:
                            mine = h.view(np.int64) % parts == part
                            at, h = at[mine], h[mine]
                        slot = (h >> np.uint64(20)) & size
                        found = np.flatnonzero(look[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                        at, h = at[found], h[found]
                        hashes.append(h)
                        held += len(h)
                if held > GATHERED:
                    got = [_merged([*got, _counted(met)])]
                    met, held = [[], [], []], 0
                    if len(got[0][0]) > 500_000:
                        yield _batch(*got.pop())
        if met[0]:
            got.append(_counted(met))
        if got:
            yield _batch(*_merged(got))

    out = texts.mapInArrow(run, "h long, ended long, went_on long, stopped long")
    return out.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("ended", "went_on", "stopped")))


def _batch(h: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"h": h.view(np.int64), **{c: np.ascontiguousarray(table[:, k], np.int64) for k, c in enumerate(("ended", "went_on", "stopped"))}})


def scored(rows: DataFrame) -> DataFrame:
    """(table_name, row_id, source, mark, language, body, odds): how much likelier each text goes on than ends where it does.

    ``rows`` has table_name, row_id, source and text. A backward n-gram model of characters: for the final context of
    a text (marks at its end left out), how often it stands before a full stop, before more text and at a bare end
    anywhere in the corpus, the text's own end left out. Texts that differ at most by the marks at their ends count
    once, however many rows they stand in, so that copies of a cut text don't vouch for its end. The estimates run from the shortest context to the longest,
    each a weight of ``BACKOFF`` occurrences in the next. Two passes: the contexts asked for become a bit filter sized by
    their number, then all positions of all texts are counted that pass it; where one filter of FILTER_BITS can't hold
    them, they are parted by their hash, and each part is a pass. Null and blank texts are left out.
    """
    rows = rows.where(F.col("text").rlike("[\\p{L}\\p{N}]"))
    finals = cut(_final_contexts(rows))
    names = [f"h{k}" for k in range(len(ORDERS))]
    one = F.min(F.struct("plain", "own", *names)).alias("t")
    texts = cut(finals.groupBy("body").agg(one).select("body", "t.*"))
    contexts = texts.select(*names).distinct()
    counts = _all_counts(texts)
    long = contexts.select("h0", F.posexplode(F.array(*names)).alias("k", "h")).join(counts, "h", "left")
    per = long.groupBy("h0").agg(*(F.max(F.when(F.col("k") == k, F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("ended", "went_on", "stopped"))))).alias(f"c{k}") for k in range(len(ORDERS))))
    for own, name in ((0, "odds_ended"), (2, "odds_stopped")):
        p = F.lit(ANYWHERE)
        for k in reversed(range(len(ORDERS))):
            c = F.col(f"c{k}")
            less = F.least(c["ended"] if own == 0 else c["stopped"], F.lit(1))
            ends = c["ended"] + c["stopped"] - less
            p = (ends + BACKOFF * p) / (ends + c["went_on"] + BACKOFF)
        per = per.withColumn(name, F.log((1 - p) / p))
    table = cut(per.select("h0", "odds_ended", "odds_stopped"))
    odds = F.when(F.col("own") == 0, F.col("odds_ended")).otherwise(F.col("odds_stopped")).alias("odds")
    found = cut(lookup_join(texts.select("body", "own", "h0"), table, "h0", "inner").select("body", odds))
    return lookup_join(finals.select("table_name", "row_id", "source", "mark", "language", "body"), found, "body", "inner")


def _posterior(ratio: np.ndarray, share: float) -> np.ndarray:
    return ratio * share / (ratio * share + 1 - share)


def _share(ratio: np.ndarray, n: np.ndarray, prior: float) -> float:
    """The share of cut texts under which texts with these likelihood ratios are likeliest, by expectation and maximisation."""
    share = prior
    for _ in range(ROUNDS):
        new = float(np.clip(((_posterior(ratio, share) * n).sum() + PRIOR * prior) / (n.sum() + PRIOR), 1e-7, 1 - 1e-7))
        if abs(new - share) < 1e-8:
            break
        share = new
    return share


def _rising(top: np.ndarray, below: np.ndarray) -> np.ndarray:
    """top / below, made to rise by pooling neighbours that don't."""
    pools: list[list[float]] = []
    for t, b in zip(top, below):
        pools.append([t, b, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t, b, n = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + b, pools[-1][2] + n]
    return np.concatenate([np.full(int(n), t / b) for t, b, n in pools])


def _ratios(whole: np.ndarray, mixed: np.ndarray, mark: str, start: np.ndarray | None = None) -> np.ndarray:
    """By bin of odds, how much likelier they are in cut texts than in whole ones.

    ``whole`` counts the odds of texts that are known to end, ``mixed`` those of others, cut ones among them. What the cut
    ones look like, and how many they are, is found by expectation and maximisation; the ratio rises with the odds.
    """
    odds = np.arange(len(whole)) * BIN - REACH
    p = (whole + 1 / len(whole)) / (whole.sum() + 1)
    ratio = np.exp(odds / 2) if start is None else start
    mixed = np.where(odds < ENDS[mark], 0, mixed)
    for _ in range(ROUNDS):
        cut_ = _posterior(ratio, _share(ratio, mixed, SHARES[mark])) * mixed
        if cut_.sum() < 1:
            break
        new = np.maximum(_rising((cut_ + 1 / len(whole) ** 2) / (cut_.sum() + 1), p), 1e-6)
        if np.abs(np.log(new) - np.log(ratio)).max() < 1e-3:
            break
        ratio = new
    return np.where(odds < ENDS[mark], 1e-6, ratio)


def fit_thresholds(scores: DataFrame) -> DataFrame:
    """(table_name, language, source, mark, bound) from texts scored once each: the odds beyond which a text is cut.

    Texts that end with a full stop, or as the model says surely, show what the odds are at a known end; against them the
    odds of the other texts show what those of cut ones are, for each column, language and end mark (a language of few
    texts leans on its column). The share of cut texts is then fitted for each column, language, source and end mark, and the bound is where the chances are even.
    Only counts by bins of odds are gathered: some hundred numbers for each language or group.
    """
    group = ["table_name", "language", "source", "mark"]
    last = int(2 * REACH / BIN)
    bin_ = F.greatest(F.lit(0), F.least(F.lit(last), F.round((F.col("odds") + REACH) / BIN).cast("int")))
    binned = cut(scores.groupBy(*group, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    # languages and scripts are few, whatever the corpus
    rows = binned.groupBy("table_name", "language", "mark", "bin").agg(F.sum("n").alias("n")).toPandas()
    ratios: dict[tuple[str, str, str], np.ndarray] = {}
    sure = {m: np.arange(last + 1) * BIN - REACH < end for m, end in ENDS.items()}

    def known(g: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        n = {m: np.bincount(x["bin"], x["n"], last + 1) for m, x in g.groupby("mark")}
        none, stop, mark = (n.get(m, np.zeros(last + 1)) for m in ("none", "stop", "mark"))
        return {"none": (stop + none * sure["none"], none), "mark": (mark * sure["mark"], mark)}

    for table, t in rows.groupby("table_name"):
        column = {m: (whole, _ratios(whole, mixed, m)) for m, (whole, mixed) in known(t).items()}
        for language, g in t.groupby("language"):
            for m, (whole, mixed) in known(g).items():
                lent, ratio = column[m]
                fitted = _ratios(whole + POOLED * lent / max(lent.sum(), 1), mixed, m, ratio) if mixed.sum() >= POOLED else ratio
                ratios[table, language, m] = fitted
    sent = scores.sparkSession.sparkContext.broadcast(ratios)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ratio = sent.value[key[0], key[1], "mark" if key[3] == "mark" else "none"]
        share = _share(ratio[g["bin"]], g["n"].to_numpy(float), SHARES[key[3]])
        over = np.flatnonzero(ratio * share > 1 - share)
        bound = (over[0] if len(over) else last + 1) * BIN - REACH - BIN / 2
        return pd.DataFrame({**{c: [k] for c, k in zip(group, key)}, "bound": [float(bound)]})

    return binned.groupBy(*group).applyInPandas(run, "table_name string, language string, source string, mark string, bound double")


def truncated(rows: DataFrame) -> DataFrame:
    """The rows of :func:`scored` with a column cut, by thresholds fitted per table, language, source and end mark.

    In the fit copies of a text count once. Repeated rows stay repeated.
    """
    s = cut(scored(rows))
    group = ["table_name", "language", "source", "mark"]
    bounds = cut(fit_thresholds(s.select(*group, "body", "odds").distinct()))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    # a row per table, language, source and mark: broadcast while that is small, else left to the optimiser
    bounds = F.broadcast(bounds) if bounds.limit(100_001).count() <= 100_000 else bounds
    return s.alias("a").join(bounds.alias("b"), on, "left").select("a.*", (F.col("odds") > F.col("bound")).alias("cut")).drop("body")
