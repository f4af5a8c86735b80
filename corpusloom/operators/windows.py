"""Where given strings stand in texts, at any position, by hashes of windows of characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.plans import spread

#: Bits a key in the filter, and most words of 64 bits (32 MB); more keys only let more windows through to the join.
BITS_A_KEY, MOST_WORDS = 32, 1 << 22
#: Words of the filter in a row on their way to the driver; characters of texts laid out at once by a task.
_ROW, SLICE = 8192, 1_000_000

_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), 0xBF58476D1CE4E5B9
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _sums(text: str) -> np.ndarray:
    """Running sums of mixed characters times powers of an odd base, from which the hash of every window follows."""
    c = (np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)) * _MIX
    c ^= c >> np.uint64(29)
    c *= _power(len(c) + 1)[0][:-1]
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(c, dtype=np.uint64, out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, length: int | np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Of the windows of ``length`` characters that begin at the positions ``at``, or at all."""
    down = _power(len(sums))[1]
    if at is None:
        h = sums[length:] - sums[: len(sums) - length]
        h *= down[: len(h)]
    else:
        h = (sums[at + length] - sums[at]) * down[at]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h += np.asarray(length, np.uint64)
    h *= _MIX
    return h


def _spots(h: np.ndarray, words: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (words - 1)


def _masks(h: np.ndarray) -> np.ndarray:
    """The four bits of each key in its word of the filter."""
    mask = np.zeros(len(h), np.uint64)
    for shift in (16, 22, 28, 34):
        mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return mask


def _filter(strings: DataFrame, string: str, first: int, words: int) -> np.ndarray:
    """A blocked filter of all ``strings`` and of the first ``first`` characters of each. Bits are combined in the tasks."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            sums, sizes = _sums("".join(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
            at = np.cumsum(sizes) - sizes
            h = np.concatenate([_hashes(sums, first, at), _hashes(sums, sizes, at)])
            yield pa.RecordBatch.from_arrays([pa.array(_spots(h, words) // _ROW), pa.array(h.view(np.int64))], ["row", "h"])

    def bits(row: tuple, part: pa.Table) -> pa.Table:
        h, out = part.column("h").to_numpy().view(np.uint64), np.zeros(min(_ROW, words), np.uint64)
        np.bitwise_or.at(out, _spots(h, words) % _ROW, _masks(h))
        return pa.table({"row": pa.array([row[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    found = np.zeros(words, np.uint64)
    for r in strings.select(string).mapInArrow(keys, "row long, h long").groupBy("row").applyInArrow(bits, "row long, bits binary").collect():
        part = np.frombuffer(bytes(r["bits"]), np.uint64)
        found[r["row"] * _ROW : r["row"] * _ROW + len(part)] = part
    return found


def _pieces(texts: list[str], longest: int) -> Iterator[tuple[list[str], list[int]]]:
    """Texts and their numbers in lists of about ``SLICE`` characters; a longer text in pieces that overlap by a window."""
    part, own, size = [], [], 0
    for k, t in enumerate(texts):
        for i in range(0, max(len(t), 1), SLICE):
            piece = t[i : i + SLICE + longest - 1] if len(t) > SLICE else t
            if part and size + len(piece) > SLICE:
                yield part, own
                part, own, size = [], [], 0
            part.append(piece)
            own.append(k)
            size += len(piece)
    if part:
        yield part, own


def holding(texts: DataFrame, strings: DataFrame, text: str, string: str, order: str, first: int) -> DataFrame:
    """(string, order): each of the distinct ``strings`` that some text holds, with the least ``order`` of such texts;
    now and then a string that was not asked for, to be left out by the join with those that were.

    One pass over the texts. A filter tells the windows of ``first`` characters, no more than the shortest string has,
    that begin some string; there it is asked for every length that strings have. What passes is combined as strings,
    so neither common strings nor repeated texts make pairs.
    """
    n, lengths = strings.agg(F.count(F.lit(1)), F.collect_set(F.length(string))).first()
    words = min(MOST_WORDS, 1 << max(2 * n * BITS_A_KEY // 64, 1).bit_length())
    sent = texts.sparkSession.sparkContext.broadcast(_filter(strings, string, first, words))
    lengths = sorted(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            rows, found = [], []
            for part, own in _pieces(b.column(0).to_pylist(), max(lengths, default=1)):
                joined = "".join(part)
                if len(joined) < first:
                    continue
                ends, sums = np.cumsum(np.fromiter(map(len, part), np.int64, len(part))), _sums(joined)
                h = _hashes(sums, first)
                at = np.flatnonzero((bits[_spots(h, words)] >> ((h >> np.uint64(16)) & np.uint64(63))) & np.uint64(1))
                h = h[at]
                mask = _masks(h)
                at = at[bits[_spots(h, words)] & mask == mask]
                which = np.searchsorted(ends, at, "right")
                room = ends[which] - at
                for length in lengths:
                    here = room >= length
                    p, w = at[here], which[here]
                    h = _hashes(sums, length, p)
                    mask = _masks(h)
                    here = bits[_spots(h, words)] & mask == mask
                    found += [joined[i : i + length] for i in p[here].tolist()]
                    rows += [own[k] for k in w[here].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), b.column(1).take(pa.array(rows, pa.int64()))], ["found", "order"])

    schema = StructType([StructField("found", StringType()), StructField("order", texts.schema[order].dataType)])
    hits = spread(texts.where(F.col(text).isNotNull()).select(text, order)).mapInArrow(run, schema)
    return hits.groupBy(F.col("found").alias(string)).agg(F.min("order").alias(order))
