"""Abusive, hateful or sexual content: an ordinal model over sparse features of sentences, a text being as bad as its worst."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.lookalike import _LATIN, _plain_form

#: Most labelled texts that the model is fitted on, and their characters together: of more, those whose hashed ids are smallest.
LABELLED, LABELLED_CHARS = 4_000, 40_000_000
#: Characters of texts whose features a task holds at once.
SLICE = 4_000_000
#: Longer sentences are read in overlapping pieces of so many words.
PIECE = 12
#: Weights are kept for so many hashed features.
FEATURES = 1 << 18
#: Rounds of choosing the sentences that speak for a label and fitting anew; parts for judging labels by models that
#: have not seen them; steps of each fit; strength of the prior.
ROUNDS, FOLDS, STEPS, RIDGE = 3, 4, 120, 3e-6
#: Expected severity, from 0 to 2, from which a text counts as harmful.
SEVERE = 0.8

_SPLIT = regex.compile(r"(?<=[.!?…][\"'”’)\]]*)\s+|\n+")
_DOTTED = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}\p{N}@$!|][.*_\-·]){2,}[\p{L}\p{N}@$!|]?(?![\p{L}\p{N}])")
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{L} ){2,}\p{L}(?![\p{L}\p{N}])")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}@$!|€+*]+(?<![!*+])|[\p{L}\p{N}]+")
_RUN = regex.compile(r"(\p{L})\1{2,}")
# Signs written for letters, in the same order.
_SIGNS, _LETTERS = "@4310$5!7|8€", "aaeiossitlbe"
_LEET = str.maketrans(_SIGNS, _LETTERS)


def _word(word: str) -> str:
    """A word in the form that its feature is made of: numbers as one, signs for letters and drawled letters undone."""
    if word.isdigit():
        return "0"
    if not word.isalpha() and len(word) > 2 and any(c.isalpha() for c in word):
        word = word.translate(_LEET)
    return _RUN.sub(r"\1", word)


class _Plain(dict):
    """Characters to their plain form, filled as they are met."""

    def __missing__(self, code: int) -> str:
        self[code] = got = _LATIN.get(chr(code), _plain_form(chr(code))[0]) if code > 127 else chr(code)
        return got


_PLAIN = _Plain()


def raw_sentences(text: str) -> list[list[str]]:
    """The words of each sentence or piece of one, with case, look-alikes and dots or blanks between letters undone."""
    plain = (text if text.isascii() else unicodedata.normalize("NFC", text).translate(_PLAIN)).casefold()
    dotted, spaced = _DOTTED.search(plain) is not None, _SPACED.search(plain) is not None
    out = []
    for s in _SPLIT.split(plain):
        if dotted:
            s = _DOTTED.sub(lambda m: regex.sub(r"[.*_\-·]", "", m[0]), s)
        if spaced:
            s = _SPACED.sub(lambda m: m[0].replace(" ", ""), s)
        words = _TOKEN.findall(s)
        while len(words) > PIECE + PIECE // 2:
            out.append(words[:PIECE])
            words = words[PIECE // 2 :]
        if words:
            out.append(words)
    return out


def sentences(text: str) -> list[list[str]]:
    """:func:`raw_sentences` with signs for letters and drawled letters undone."""
    return [[_word(w) for w in s] for s in raw_sentences(text)]


class Hasher:
    """Sentences to hashed features: words and pairs of neighbouring words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        h = self.known.get(w)
        if h is None:
            if len(self.known) > 500_000:
                self.known.clear()
            h = 1469598103934665603
            for b in _word(w).encode("utf-8", "replace"):
                h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
            self.known[w] = h
        return h

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, sentence of each, text of each sentence)."""
        words, ends, of, known = [], [], [], self.known
        for k, text in enumerate(texts):
            for s in raw_sentences(text):
                try:
                    words += [known[w] for w in s]
                except KeyError:
                    words += map(self.word, s)
                ends.append(len(words))
                of.append(k)
        h = np.array(words, np.uint64)
        sizes = np.diff(np.concatenate([[0], ends])).astype(np.int64)
        at = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore"):
            pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] + np.uint64(0x7F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            mix = lambda x: ((x ^ (x >> np.uint64(33))) % np.uint64(FEATURES)).astype(np.int64)
            inner = at[1:] == at[:-1]
            f = np.concatenate([mix(h), mix(pair[inner])])
        s = np.concatenate([at, at[1:][inner]])
        order = np.argsort(s, kind="stable")
        return f[order], s[order], np.array(of, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    """Cumulative-link regression of grades 0 to K - 1: P(grade > k) = sigmoid(w x - bound_k), one w for all bounds."""

    def __init__(self, grades: int = 3):
        self.w = np.zeros(FEATURES)
        self.bounds = np.linspace(2.0, 3.0, grades - 1)

    def fit(self, f: np.ndarray, s: np.ndarray, scale: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> None:
        """Gradient steps with momentum and per-feature scaling on rows ``s`` with features ``f``, each row scaled."""
        n, k = len(grade), len(self.bounds)
        seen = np.unique(f)
        pos = np.searchsorted(seen, f)
        w, m, v = self.w[seen], np.zeros(len(seen)), np.zeros(len(seen))
        mb, vb = np.zeros(k), np.zeros(k)
        total = weight.sum()
        over = (grade[:, None] > np.arange(k)).astype(float)
        for t in range(1, steps + 1):
            score = np.bincount(s, w[pos] * scale[s], n)
            # every threshold is a logistic regression that shares w; together they are the cumulative model
            error = (_sigmoid(score[:, None] - self.bounds) - over) * weight[:, None] / total
            each = error.sum(1)
            g = np.bincount(pos, each[s] * scale[s], len(seen)) + RIDGE * w
            gb = -error.sum(0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.99**t
            w = w - 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-6)
            self.bounds = np.maximum.accumulate(self.bounds - 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-6))
        self.w = np.zeros(FEATURES)
        self.w[seen] = w

    def expected(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(score[:, None] - self.bounds).sum(1)


def _sentence_scores(w: np.ndarray, f: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(s, w[f], n) / np.sqrt(np.maximum(np.bincount(s, minlength=n), 1))


def _fit_bags(f: np.ndarray, s: np.ndarray, of: np.ndarray, grades: np.ndarray, trust: np.ndarray, model: Ordinal | None = None, rounds: int = ROUNDS) -> Ordinal:
    """Fits on texts of which only some sentences give the grade; ``trust`` weighs the texts."""
    n, texts = len(of), len(grades)
    scale = 1 / np.sqrt(np.maximum(np.bincount(s, minlength=n), 1))
    per_text = np.maximum(np.bincount(of, minlength=texts), 1)
    grade = grades[of]
    below = trust[of] / np.sqrt(per_text[of])
    started = model is not None
    model = model or Ordinal()
    weight = np.where(grade > 0, trust[of] / per_text[of], below)
    for _ in range(rounds):
        if started:
            score = _sentence_scores(model.w, f, s, n)
            best = np.full(texts, -np.inf)
            np.maximum.at(best, of, score)
            weight = np.where(grade > 0, trust[of] * (score >= best[of]), below)
        started = True
        use = weight > 0
        number = np.cumsum(use) - 1
        pick = use[s]
        model.fit(f[pick], number[s[pick]], scale[use], grade[use], weight[use])
    return model


def text_scores(model: Ordinal, f: np.ndarray, s: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """The score of each text's worst sentence."""
    best = np.full(texts, -10.0)
    np.maximum.at(best, of, _sentence_scores(model.w, f, s, len(of)))
    return best


def _folds(spark: SparkSession, data: tuple, grades: np.ndarray, trust: np.ndarray, folds: list[int | None], rounds: int) -> dict[int | None, Ordinal]:
    """A model for each fold, fitted on the texts outside it (None: on all), each in a task of its own."""
    sent = spark.sparkContext.broadcast((data, grades, trust))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (f, s, of), grades, trust = sent.value
        for b in batches:
            for k in b["id"].tolist():
                learn = trust if folds[k] is None else np.where(np.arange(len(grades)) % FOLDS == folds[k], 0.0, trust)
                model = _fit_bags(f, s, of, grades, learn, rounds=rounds)
                at = np.flatnonzero(model.w)
                yield pd.DataFrame({"fold": [k], "at": [at.astype(np.int32).tobytes()], "w": [model.w[at].tobytes()], "bounds": [model.bounds.tobytes()]})

    rows = spark.range(0, len(folds), 1, len(folds)).mapInPandas(run, "fold int, at binary, w binary, bounds binary").collect()
    sent.unpersist()
    out = {}
    for r in rows:
        model = Ordinal()
        model.w[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["w"])
        model.bounds = np.frombuffer(r["bounds"]).copy()
        out[folds[r["fold"]]] = model
    return out


def train(spark: SparkSession, texts: list[str], grades: np.ndarray) -> Ordinal:
    """Fits the model on graded texts whose raters err.

    At first every sentence bears its text's grade, with less weight in longer texts; then, in turn, only the worst
    sentence of each text with a grade above 0 does, and all sentences of the others bear grade 0. Labels are then
    judged by models that have not seen them: a text counts by how likely its grade is there, and all is fitted anew.
    The models of the folds are fitted in tasks, side by side. A model is kept for the session and the same texts.
    """
    key = (spark.sparkContext.applicationId, xxhash.xxh64_hexdigest("\0".join(texts).encode("utf-8", "replace") + grades.tobytes()))
    if key in _fitted:
        return _fitted[key]
    f, s, of = data = Hasher().features(texts)
    if not len(of):
        return Ordinal()
    fold = np.arange(len(texts)) % FOLDS
    trust = np.ones(len(texts))
    for _ in range(2):
        seen = np.empty(len(texts))
        for k, model in _folds(spark, data, grades, trust, list(range(FOLDS)), ROUNDS).items():
            mine = fold == k
            seen[mine] = model.expected(text_scores(model, f, s, of, len(texts)))[mine] / 2
        trust = np.where(grades > 0, np.clip(seen / 0.4, 0.02, 1.0), np.clip((1 - seen) / 0.6, 0.02, 1.0))
    _fitted.clear()
    _fitted[key] = _folds(spark, data, grades, trust, [None], ROUNDS + 1)[None]
    return _fitted[key]


_fitted: dict[tuple[str, str], Ordinal] = {}


def graded_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", bad: str = "harmful", bound: int = LABELLED, chars: int = LABELLED_CHARS) -> tuple[list[str], np.ndarray]:
    """Labelled texts with grades: 0 if no rater objects, 2 if all do, 1 if they differ. Null labels say nothing.

    At most ``bound`` texts of ``chars`` characters in all, in the order of their hashed ids; texts are taken whole.
    """
    votes = labels.where(f"{label_col} is not null and {id_col} is not null").distinct().groupBy(id_col).agg(F.avg((F.col(label_col) == bad).cast("double")).alias("share"))
    chosen = votes.orderBy(F.xxhash64(id_col), id_col).limit(bound)
    rows = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(chosen, id_col)
    # at most ``bound`` rows are left here, so one task may add them up
    so_far = F.sum(F.length(text_col)).over(Window.orderBy(F.xxhash64(id_col), id_col))
    rows = rows.withColumn("__c", so_far).where(F.col("__c") <= chars).orderBy(F.xxhash64(id_col), id_col).collect()
    return [r[text_col] for r in rows], np.array([0 if r["share"] == 0 else 2 if r["share"] == 1 else 1 for r in rows])


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of about ``SLICE`` characters; a longer text is a list of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def severity(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with severity: the expected grade (0 to 2) of each text's worst sentence.

    One narrow pass over whole texts. Null, empty and wordless texts have severity 0; repeated rows stay.
    """
    keep = [c for c in docs.columns if c != text_col]
    sent = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.bounds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, hasher = Ordinal(), Hasher()
        own.w, own.bounds = sent.value
        for batch in batches:
            texts = batch[text_col].fillna("").tolist()
            scores = np.concatenate([np.empty(0), *(text_scores(own, *hasher.features(part), len(part)) for part in _slices(texts))])
            out = batch[keep].copy()
            out["severity"] = np.where(scores > -10, own.expected(scores), 0.0)
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInPandas(run, f"{schema}, severity double")
