"""One consistent form for text whose characters only look alike."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters they look like, in the same order.
CYRILLIC = "авеԁһіјкӏморԛѕтухѵԝʏАВСЕԌНІЈКМОРԚЅТУХѴԜҮ"
CYRILLIC_LATIN = "aBedhijklmopqstyxvwyABCEGHIJKMOPQSTYXVWY"
CYRILLIC_MORE, CYRILLIC_MORE_LATIN = "сгпьѐё", "crnbeë"
GREEK = "αεικνορτυχγηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϲϳ"
GREEK_LATIN = "aeikvoptuxynwABEZHIKMNOPTYXCcj"
ARMENIAN = "օոսհցքզյՕՍ"
ARMENIAN_LATIN = "onuhgpqjOU"
# Marks that stand for nothing one can see, besides those of category Cf.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍⠀ㅤ️︎"

_LATIN = dict(zip(CYRILLIC + CYRILLIC_MORE + GREEK + ARMENIAN, CYRILLIC_LATIN + CYRILLIC_MORE_LATIN + GREEK_LATIN + ARMENIAN_LATIN))
_BY_SCRIPT: dict[str, dict[str, str]] = {}
for _odd, _plain in _LATIN.items():
    _BY_SCRIPT.setdefault(unicodedata.name(_odd).split()[0], {}).setdefault(_plain, _odd)
#: Rows with none of these need no look at all. Java's pattern.
SUSPICIOUS = "[^\\x00-\\x7F\\u00A1-\\u00AC\\u00AE-\\u024F\\u2010-\\u201F\\u2026\\u2212\\u2264\\u2265\\u2016]"
_WORD = regex.compile(r"[\p{L}\p{M}]+")
#: Log-odds that a letter is not what it looks like, and that a word changes its script midway.
_SWAP, _SWITCH = -2.0, -25.0
_FLOOR = math.log(1e-6)


@lru_cache(maxsize=4096)
def script(ch: str) -> str:
    """The script of a letter, '' for anything else."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "?").split()[0]
    return "LATIN" if name in ("FEMININE", "MASCULINE") else name


@lru_cache(maxsize=4096)
def _plain_form(ch: str) -> tuple[str, str]:
    """What a character becomes by itself, and which kind of damage it is ('' if none)."""
    category = unicodedata.category(ch)
    if ch == " " or ord(ch) < 127:
        return ch, ""
    if category == "Zs":
        return " ", "space"
    if category == "Cf" or ch in UNSEEN:
        return "", "unseen"
    how, _, rest = unicodedata.decomposition(ch).partition(" ")
    if how in ("<wide>", "<narrow>"):
        return unicodedata.normalize("NFKC", ch), "wide"
    joined = unicodedata.normalize("NFKC", ch)
    if how == "<compat>" and category[0] == "L" and len(joined) > 1 and joined.isalpha():
        return joined, "joined"
    return ch, ""


def _options(ch: str) -> list[tuple[str, str]]:
    """The letters a letter may stand for, with their scripts; itself first."""
    own = script(ch)
    out = [(ch, own)]
    latin = _LATIN.get(ch)
    if latin:
        out.append((latin, "LATIN"))
    for other, letters in _BY_SCRIPT.items():
        if other != own and (x := letters.get(latin or ch)):
            out.append((x, other))
    return out


def resolve(word: str, model: dict[str, float]) -> str:
    """The likeliest reading of a word of several scripts: Viterbi over the lattice of what its letters may stand for.

    ``model`` has log-probabilities of two-letter sequences in lower case within one script ('^' and '$' at the ends).
    """
    best = {("^", ""): (0.0, "")}
    for ch in word:
        step: dict[tuple[str, str], tuple[float, str]] = {}
        for letter, kind in _options(ch):
            cost = 0.0 if letter == ch else _SWAP
            for (last, before), (score, text) in best.items():
                s = score + cost + model.get(last + letter.lower(), _FLOOR) + (_SWITCH if kind and before and kind != before else 0.0)
                key = (letter.lower(), kind or before)
                if key not in step or s > step[key][0]:
                    step[key] = (s, text + letter)
        best = step
    return max((score + model.get(last + "$", _FLOOR), text) for (last, _), (score, text) in best.items())[1]


def canonical(text: str, model: dict[str, float], whole_words: bool = False) -> tuple[str, bool]:
    """A text in its one form, and whether it held characters that only look right.

    Compatibility forms of letters and unusual spaces are replaced, ignorable characters deleted, accents composed;
    then each word with letters of several scripts is read by :func:`resolve`. Superscripts, quotes, dashes, ellipses
    and words wholly of another script stay; with ``whole_words``, a word that could be wholly Latin becomes so if the
    text has Latin letters otherwise.
    """
    pieces, kinds = zip(*map(_plain_form, text)) if text else ((), ())
    damaged = any(kinds)
    plain = "".join(pieces)
    composed = unicodedata.normalize("NFC", plain)
    damaged |= len(composed) < len(plain)

    def read(match: regex.Match) -> str:
        nonlocal damaged
        word = match[0]
        scripts = {s for ch in word if (s := script(ch))}
        if len(scripts) < 2:
            return word
        found = resolve(word, model)
        damaged |= found != word
        return found

    out = _WORD.sub(read, composed)
    if whole_words and any(script(ch) == "LATIN" for ch in out):
        out = _WORD.sub(lambda m: "".join(_LATIN[ch] for ch in m[0]) if all(ch in _LATIN for ch in m[0]) else m[0], out)
    return out, damaged


def letter_model(texts: DataFrame, text_col: str) -> dict[str, float]:
    """Log-probabilities of letter pairs within words of one script, counted over all of ``texts``.

    Counted in the JVM, words first, so that little is shuffled. Only pairs of the 1,024 code points up to U+03FF and
    of Cyrillic are kept, so what reaches the driver is bounded by the squares of these alphabets and is far smaller.
    """
    word = F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"([a-zß-öø-ÿ]{2,}|[Ͱ-Ͽ]{2,}|[Ѐ-ԯ]{2,})"), 1))
    words = texts.where(F.col(text_col).isNotNull()).select(word.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    framed = F.concat(F.lit("^"), "w", F.lit("$"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(framed, i, F.lit(2)))).alias("pair"), "n")
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()
    firsts: dict[str, int] = {}
    for r in rows:
        firsts[r["pair"][0]] = firsts.get(r["pair"][0], 0) + r["n"]
    return {r["pair"]: math.log(r["n"] / firsts[r["pair"][0]]) for r in rows}


def canonical_text(text: Column, model: dict[str, float], whole_words: bool = False) -> Column:
    """struct(text, damaged) of a text column; rows without a suspicious character never leave the JVM. Null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(None, None) if t is None else canonical(t, model, whole_words) for t in batch]
            yield pd.DataFrame(found, columns=["text", "damaged"], index=batch.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("damaged", T.BooleanType())])
    seen = F.pandas_udf(run, kind)(F.when(text.rlike(SUSPICIOUS), text))
    return F.struct(F.coalesce(seen["text"], text).alias("text"), F.coalesce(seen["damaged"], F.lit(False)).alias("damaged"))


def one_form(rows: DataFrame, text_col: str, model: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with __text (the one form) and __damaged; repeated rows stay, null texts give null and false."""
    model = letter_model(rows, text_col) if model is None else model
    return rows.withColumn("__c", canonical_text(F.col(text_col), model)).select(*rows.columns, F.col("__c.text").alias("__text"), F.col("__c.damaged").alias("__damaged"))
