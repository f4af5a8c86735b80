"""Text of scanned pages: headers and page numbers between the lines, broken words and misread characters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lines import CHAPTER, NUMBERED, LineModel, header_keys, looks, page_number, starts
from corpusloom.plans import cut, lookup_join, spread

#: Bits a key in the filters that are sent to all tasks, and the most bits of a filter, whatever the size of the corpus.
BITS_A_KEY, FILTER_BITS = 128, 1 << 28
#: Pages on which a header must stand; how much commoner an intended word must be than its misreading, and how common.
REPEATED, COMMONER, KNOWN = 3, 20, 8
#: Distinct words gathered by a task before it hands its counts on.
GATHERED = 400_000
#: Texts of several lines on which the model of lines is fitted at most (those of smallest hash), and their characters.
SAMPLE, SAMPLE_CHARS = 8_000, 20_000
#: Letters of the longest word that is repaired.
LONGEST = 64

_BROKEN = regex.compile(r"([\p{L}\p{N}'’^~·|!(\-]*\p{L}[\p{L}\p{N}^~·|!(]*)[-–¬­]\s*$")
_FIRST = regex.compile(r"\s*([\p{L}^~·|!0-9(][\p{L}\p{N}^~·|!(.'’\-]*)")
_AROUND = ".,;:?\"“”„'’‘()[]{}—–…«»*_`"

# What a scanner reads, and what stood there.
MISREAD = {
    "1": "l i t r".split(), "0": ["o"], "!": "i l".split(), "|": "l i t".split(), "6": ["b"], "9": "g q".split(), "5": ["s"], "8": ["b"], "(": ["c"], "7": ["t"], "4": ["a"], "3": ["e"], "2": ["z"], "$": ["s"], "@": ["a"],
    "c": ["e", "o"], "f": ["t"], "b": ["h"], "o": ["a", "e"], "rn": ["m"], "m": ["rn", "in", "ni", "nn"], "ri": ["n"], "ii": ["u", "n"], "vv": ["w"], "cl": ["d"], "h": ["li", "b"], "l": ["i", "t", "f"], "i": ["l", "j"],
    "e": ["c"], "u": ["n"], "n": ["u", "ri"], "t": ["f"], "a": ["o"], "d": ["cl"], "w": ["vv"], "li": ["h"], "in": ["m"], "ni": ["m"], "v": ["y"], "y": ["v"], "q": ["g"], "g": ["q"], "j": ["i"], "nn": ["m"], "s": ["5"], "k": ["lc"], "lc": ["k"],
}
_NOISE = ".^~|·_*'`,:-¸¨˙°"


def _in(bits: np.ndarray, key: str) -> bool:
    h, last = xxhash.xxh64_intdigest(key), len(bits) * 8 - 1
    a, b = h & last, h >> 32 & last
    return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)


def label_lines(lines: list[str], model: LineModel, bits: np.ndarray | None, whole_page: bool) -> tuple[str, dict[int, tuple[int, bool]]]:
    """A label for each line (h header, n page number, b body), and (value, roman) of lines that are a bare number."""
    known = (lambda key: False) if bits is None else lambda key: _in(bits, "h " + key)
    symbols, bare = looks(lines, known, whole_page)
    return model.labels(symbols, whole_page), bare


def _plain_word(token: str) -> str:
    return token.strip(_AROUND).strip("-–—").lower()


def _variants(token: str) -> tuple[str, ...]:
    """A token as a word, and with a sign at its edge that might be a misread letter."""
    w = _plain_word(token)
    edge = token.strip(".,;:?\"“”„’‘[]{}—–…«»").lower()
    return (w, edge) if edge != w and edge and (edge[0] in "(!|" or edge[-1] in "!|(") and ")" not in edge else (w,)


def _words(lines: list[str], labels: str, bare: dict) -> tuple[list[tuple[int, int, list[str]]], list[tuple[int, str, str]]]:
    """(line, place of the first, tokens) of whole words in body lines; (line, first, second half) of words broken over two.

    A bare number has no words, and doesn't part the halves of one, whether it is a page number or not."""
    body = [k for k, x in enumerate(labels) if x == "b" and k not in bare and lines[k].strip()]
    words, broken, skip = [], [], False
    for n, k in enumerate(body):
        line = lines[k]
        tokens = line.split()
        begin, end = int(skip), len(tokens)
        skip = False
        if tokens[-1][-1] in "-–¬­" and n + 1 < len(body) and (m := _BROKEN.search(tokens[-1])) and (f := _FIRST.match(lines[body[n + 1]])):
            second = f[1].strip(_AROUND).rstrip("-–—").lower()
            first = m[1].lower().lstrip("-'’(")
            if second and not f[1][0].isupper() | f[1][0].isdigit() and first:
                broken.append((k, first, second))
                end, skip = end - 1, True
        words.append((k, begin, tokens[begin:end]))
    return words, broken


def _book(book: Column) -> Column:
    return F.coalesce(book.cast("string"), F.lit("-"))


def _gather(rows: DataFrame) -> DataFrame:
    """(kind, key, n, m): counts of words (n whole, m put together) over distinct texts, of header keys by book over the
    distinct pages of each, and of page offsets over all pages. Header keys and offsets have their book before a tab."""
    model = LineModel.prior()

    def frame(kind: str, counts: dict) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.full(len(counts), kind, object), "key": np.array(list(counts), object), "n": [x[0] if isinstance(x, list) else x for x in counts.values()], "m": [x[1] if isinstance(x, list) else 0 for x in counts.values()]}).astype({"n": "int64", "m": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, joined = Counter(), Counter()

        def flush() -> Iterator[pd.DataFrame]:
            counts: dict[str, list[int]] = {}
            for t, n in tokens.items():
                for w in _variants(t):
                    if any(c.isalpha() for c in w):
                        counts.setdefault(w, [0, 0])[0] += n
            for w, n in joined.items():
                counts.setdefault(w, [0, 0])[1] += n
            yield frame("w", counts)
            for c in (tokens, joined):
                c.clear()

        for b in batches:
            for whole_page, text in zip(b["whole_page"], b["text"]):
                lines = text.split("\n")
                labels, bare = label_lines(lines, model, None, whole_page) if len(lines) > 1 else ("b", {})
                words, broken = _words(lines, labels, bare)
                tokens.update(chain.from_iterable(t for _, _, t in words))
                joined.update(a + z for _, a, z in broken)
            if len(tokens) + len(joined) > GATHERED:
                yield from flush()
        yield from flush()

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = Counter()
            for book, first, second, third, last in zip(b["book"], b["first"], b["second"], b["third"], b["last"]):
                for line in {second if page_number(first) else first, first, third if page_number(last) else last}:
                    keys.update(f"{book}\t{key}" for key in header_keys(line))
            yield frame("h", keys)

    def offset(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            offsets = Counter()
            for book, page, first, last in zip(b["book"], b["page"], b["first"], b["last"]):
                n = page_number(last) or page_number(first)
                if n and not n[2]:
                    offsets[f"{book}\t{int(page) - n[1]}"] += 1
            yield frame("o", offsets)

    out = "kind string, key string, n long, m long"
    texts = rows.groupBy("text").agg(F.max(F.col("table_name") == "pages").alias("whole_page"))
    lines = F.split("text", "\n")
    pages = rows.where("table_name = 'pages'").select(_book(F.col("book")).alias("book"), "page", F.xxhash64("text").alias("same"), lines.alias("l")).where("size(l) > 1")
    pages = pages.select("book", "page", "same", F.col("l")[0].alias("first"), F.col("l")[1].alias("second"), F.element_at("l", -2).alias("third"), F.element_at("l", -1).alias("last"))
    found = spread(texts).mapInPandas(run, out)
    found = found.unionByName(pages.select("book", "same", "first", "second", "third", "last").distinct().mapInPandas(headed, out))
    found = found.unionByName(pages.where("book <> '-' and page is not null").mapInPandas(offset, out))
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def readings(word: str) -> list[str]:
    """What a misread word may have been: one confusion undone, or a stray mark left out; then two in longer words."""
    def once(w: str) -> set[str]:
        out = set()
        for k, ch in enumerate(w):
            if ch in _NOISE:
                out.add(w[:k] + w[k + 1 :])
            for size in (1, 2):
                piece = w[k : k + size]
                if len(piece) == size:
                    out.update(w[:k] + good + w[k + size :] for good in MISREAD.get(piece, ()))
        return out

    first = once(word)
    second = {v for w in first for v in once(w)} - first if len(word) > 5 else set()
    return [*sorted(first - {word}), *("2" + v for v in sorted(second - {word}))]


def _corrections(words: DataFrame) -> DataFrame:
    """(word, intended) for words with a far commoner reading; a single confusion goes before two.

    A reading is handed on only if it is in a filter of the common words; the join then settles it.
    """
    lexicon = words.where(F.col("n") >= KNOWN).select(F.col("key").alias("intended"), F.col("n").alias("known"))
    sent = words.sparkSession.sparkContext.broadcast(_bits(lexicon.select(F.col("intended").alias("key"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sent.value
        for b in batches:
            rows = [(w, n, v.lstrip("2"), v[0] == "2") for w, n in zip(b["key"], b["n"]) if 1 < len(w) <= LONGEST for v in readings(w) if _in(bits, v.lstrip("2")) and v.lstrip("2").replace("-", "").isalpha()]
            yield pd.DataFrame(rows, columns=["word", "n", "intended", "twice"])

    rare = words.join(F.broadcast(words.agg(F.max("n").alias("top"))), F.col("n") * COMMONER < F.col("top")).drop("top")
    options = rare.select("key", "n").mapInPandas(run, "word string, n long, intended string, twice boolean")
    fits = options.join(lexicon, "intended").where((F.col("known") >= F.col("n") * COMMONER) & (~F.col("twice") | (F.col("known") >= F.col("n") * 5 * COMMONER)))
    return fits.groupBy("word").agg(F.max(F.struct(~F.col("twice"), "known", "intended"))["intended"].alias("intended"))


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit filter of keys, sized by their number; what comes to the driver is at most FILTER_BITS / 8 numbers."""
    size = 1 << min(max(keys.count() * BITS_A_KEY, 1 << 16).bit_length(), FILTER_BITS.bit_length() - 1)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.fromiter((spot & (size - 1) for k in b["key"] for h in (xxhash.xxh64_intdigest(k),) for spot in (h, h >> 32)), np.int64, 2 * len(b))
            yield pd.DataFrame({"w": h >> 6, "b": np.left_shift(np.int64(1), h & 63)})

    rows = keys.mapInPandas(hashed, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(size >> 6, np.int64)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return bits.view(np.uint8)


def fit_lines(rows: DataFrame, bits: np.ndarray, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> LineModel:
    """The model of lines, fitted on at most ``sample`` texts of several lines, those of smallest hash among the texts of
    at most ``chars`` characters. Only their symbols come to the driver, a few bytes a line."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen, begun = [], []
            for table, text in zip(b["table_name"], b["text"]):
                lines = text.split("\n")
                seen.append(np.array(looks(lines, lambda key: _in(sent.value, "h " + key), table == "pages")[0], np.int16).tobytes())
                begun.append(np.array(starts(lines), np.int8).tobytes())
            yield pd.DataFrame({"page": (b["table_name"] == "pages").astype(np.int32), "seen": seen, "begun": begun})

    some = rows.where((F.instr("text", "\n") > 0) & (F.length("text") <= chars)).select("table_name", "text", F.xxhash64("text", "table_name").alias("h"))
    got = some.orderBy("h", "table_name").limit(sample).select("table_name", "text").mapInPandas(run, "page int, seen binary, begun binary").toPandas()
    texts = [(p, np.frombuffer(x, np.int16).astype(np.int64), np.frombuffer(y, np.int8).reshape(-1, 4).astype(np.int64)) for p, x, y in zip(got["page"], got["seen"], got["begun"])]
    return LineModel.prior().fit(texts)


def _cases(rows: DataFrame, bits: np.ndarray, model: LineModel) -> DataFrame:
    """Everything in each row that may be a case: (table_name, row_id, page_id, line_no, kind, a, b, value, token).

    A header that is one only by its keys has them in a; what its line holds if it is none has the value -1. A misread
    word has its forms that pass the filter in a and its place in the line in token.
    """
    sent = rows.sparkSession.sparkContext.broadcast((bits, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (bits, model), sound = sent.value, set()

        def misread(begin: int, line_words: list[str]) -> Iterator[tuple[str, int]]:
            for k, t in enumerate(line_words, begin):
                if t in sound:
                    continue
                hits = [w for w in _variants(t) if w and _in(bits, "m " + w)]
                if hits:
                    yield "\n".join(hits), k
                else:
                    if len(sound) > GATHERED:
                        sound.clear()
                    sound.add(t)

        for batch in batches:
            out = []
            for table, row, page, text in zip(batch["table_name"], batch["row_id"], batch["page_id"], batch["text"]):
                lines = text.split("\n")
                labels, bare = label_lines(lines, model, bits, table == "pages")
                hits = {k: hit for k, x in enumerate(labels) if x == "h" and (hit := [key for key in header_keys(lines[k]) if _in(bits, "h " + key)])}
                if len(lines) == 1 and table != "pages":
                    labels = "b" if labels == "h" and not NUMBERED.match(lines[0]) and not CHAPTER.match(lines[0]) else labels
                at = (table, row, page)
                alone = label_lines(lines, model, None, table == "pages")[0] if hits else labels
                hits = {k: hit for k, hit in hits.items() if labels[k] == "h" != alone[k]}
                for k, x in enumerate(labels):
                    if x == "h":
                        out.append((*at, k + 1, "header", "\n".join(hits.get(k, ())), "", None, None))
                    elif x == "n" and k not in bare:
                        out.append((*at, k + 1, "page_number", "", "", None, None))
                    elif k in bare:
                        out.append((*at, k + 1, "number", "r" if bare[k][1] else "", "", bare[k][0], None))
                words, broken = _words(lines, labels, bare)
                for k, begin, line_words in words:
                    out.extend((*at, k + 1, "misread", forms, "", None, t) for forms, t in misread(begin, line_words))
                out.extend((*at, k + 1, "hyphen", a, z, None, None) for k, a, z in broken)
                if hits:
                    words, broken = _words(lines, alone, bare)
                    out.extend((*at, k + 1, "misread", forms, "", -1, t) for k, begin, line_words in words if k in hits for forms, t in misread(begin, line_words))
                    out.extend((*at, k + 1, "hyphen", a, z, -1, None) for k, a, z in broken if k in hits)
            frame = pd.DataFrame(out, columns=["table_name", "row_id", "page_id", "line_no", "kind", "a", "b", "value", "token"])
            yield frame.astype({"value": "Int64", "token": "Int64"})

    return rows.mapInPandas(run, "table_name string, row_id long, page_id long, line_no int, kind string, a string, b string, value long, token int")


def damage(pages: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, LineModel]:
    """(table_name, row_id, line_no, kind, word, token, form) of every damaged place in pages.raw_text and
    paragraphs.text, and the model of lines. token and form are a misread word's place in its line and how it stands there.

    Lines are labelled header, page number, body or break by a hidden Markov model fitted on a sample of these texts;
    its symbols are form, case, place, and whether the line (or it without one of its words) heads several pages of its
    book. Copies of a text count once. A bare number is a page number if it is the page's own,
    by the offset that most pages of its book show. Words are compared with the words of the whole corpus: a broken word
    is put together, with its hyphen if it is commoner so; a word is misread if undoing a confusion gives a far commoner
    one. Only filters of bounded size are broadcast; the candidates they let through are settled by joins. Null and empty
    texts have no lines; repeated rows count once.
    """
    p = pages.select("id", F.col("textbook_id").alias("book"), F.col("page_number").alias("page"), F.col("raw_text").alias("text"))
    rows = p.select(F.lit("pages").alias("table_name"), F.col("id").alias("row_id"), F.col("id").alias("page_id"), "book", "page", "text").unionByName(
        paragraphs.select(F.lit("paragraphs").alias("table_name"), F.col("id").alias("row_id"), "page_id", F.lit(None).cast("long").alias("book"), F.lit(None).cast("int").alias("page"), "text")
    ).where("text <> ''")
    seen = cut(_gather(rows))
    words = seen.where("kind = 'w'")
    fixes = cut(_corrections(words))
    by_key = seen.where((F.col("kind") == "h") & (F.col("n") >= REPEATED)).select(F.col("key").alias("in_book"), F.substring_index("key", "\t", -1).alias("key"))
    headers = by_key.select(F.concat(F.lit("h "), "key").alias("key"))
    bits = _bits(headers.unionByName(fixes.select(F.concat(F.lit("m "), "word").alias("key"))))
    model = fit_lines(rows, bits)
    cases = cut(_cases(rows, bits, model).distinct())
    # a header by its keys: they must head pages of its own book, or of any if its book is not known
    line = ["table_name", "row_id", "line_no"]
    doubtful = cases.where("kind = 'header' and a <> ''")
    books = p.where("id is not null").groupBy(F.col("id").alias("page_id")).agg(F.min(_book(F.col("book"))).alias("of"))
    keyed = lookup_join(doubtful.select(*line, "page_id", F.explode(F.split("a", "\n")).alias("key")), books, "page_id")
    exact = by_key.select("in_book").unionByName(by_key.select(F.concat(F.lit("*\t"), "key").alias("in_book"))).distinct()
    keyed = cut(keyed.select(*line, F.concat(F.coalesce("of", F.lit("*")), F.lit("\t"), "key").alias("in_book")))
    sure = cut(lookup_join(keyed, exact, "in_book", "inner").select(*line).distinct())
    no_header = doubtful.select(*line).distinct().join(sure, line, "left_anti")
    inside = cases.where("kind in ('misread', 'hyphen')")
    inside = cut(inside.where("value is null").unionByName(inside.where("value = -1").join(no_header, line, "left_semi").select(*inside.columns)))
    plain = cases.where("kind = 'page_number' or kind = 'header' and a = ''").select(*line, "kind", F.lit("").alias("word"))
    plain = plain.unionByName(sure.select(*line, F.lit("header").alias("kind"), F.lit("").alias("word"))).distinct()

    votes = seen.where("kind = 'o'").select(F.split("key", "\t")[0].cast("long").alias("book"), F.split("key", "\t")[1].cast("int").alias("offset"), "n")
    usual = votes.groupBy("offset").agg(F.sum("n").alias("n")).agg(F.max_by("offset", F.struct("n", "offset")).alias("usual"))
    by_book = cut(votes.groupBy("book").agg(F.max_by("offset", F.struct("n", "offset")).alias("offset"), F.max("n").alias("n")).where("n >= 3").select("book", "offset"))
    numbers = cases.where("kind = 'number'")
    where = lookup_join(p.select(F.col("id").alias("page_id"), "book", "page").distinct(), by_book, "book").join(F.broadcast(usual))
    where = where.groupBy("page_id").agg(F.max(F.struct("page", F.coalesce("offset", "usual").alias("offset"))).alias("p")).select("page_id", "p.page", "p.offset")
    own = F.when(F.col("a") == "r", (F.col("value") == F.col("page")) & (F.col("page") <= F.col("offset"))).otherwise(F.col("value") == F.col("page") - F.col("offset"))
    bare = numbers.join(where, "page_id").where(own).select("table_name", "row_id", "line_no", F.lit("page_number").alias("kind"), F.lit("").alias("word"))

    # of a word's forms the first that is in truth misread counts, not the first that the filter lets through
    spotted = inside.where("kind = 'misread'").select(*line, "token", F.posexplode(F.split("a", "\n")).alias("place", "form"))
    misread = lookup_join(spotted, fixes.select(F.col("word").alias("form"), "intended"), "form", "inner")
    misread = misread.groupBy(*line, "token").agg(F.min(F.struct("place", "form", "intended")).alias("w"))
    misread = misread.select(*line, F.lit("misread").alias("kind"), F.col("w.intended").alias("word"), "token", "w.form")

    split = inside.where("kind = 'hyphen'")
    pairs = split.select("a", "b").distinct()
    forms = pairs.select("a", "b", F.explode(F.array(F.struct(F.concat("a", "b").alias("word"), F.lit(1).alias("closed")), F.struct(F.concat_ws("-", "a", "b").alias("word"), F.lit(0).alias("closed")))).alias("f")).select("a", "b", "f.*")
    counted = forms.join(words.select(F.col("key").alias("word"), "n"), "word", "left").join(fixes, "word", "left")
    alone = words.where(F.col("n") >= KNOWN).select(F.col("key").alias("b"), F.col("n").alias("alone"))
    best = counted.groupBy("a", "b").agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("intended").isNotNull().alias("fixed"), "closed", F.coalesce("intended", "word").alias("word"))).alias("w"))
    best = best.join(alone, "b", "left").where("w.n > 0 or w.fixed or alone is null").select("a", "b", F.when(F.col("w.n") > 0, F.col("w.word")).otherwise(F.when(F.col("w.fixed"), F.col("w.word")).otherwise(F.concat("a", "b"))).alias("word"))
    pair = F.concat_ws("\n", "a", "b")
    hyphen = lookup_join(split.withColumn("pair", pair), cut(best.select(pair.alias("pair"), "word")), "pair", "inner").select("table_name", "row_id", "line_no", "kind", "word")
    whole = plain.unionByName(bare).unionByName(hyphen).withColumns({"token": F.lit(None).cast("int"), "form": F.lit(None).cast("string")})
    return whole.unionByName(misread), model


def reassemble(text: str, cases: list[tuple], model: LineModel | None = None) -> str:
    """A text as continuous paragraphs: headers and page numbers left out, broken words joined, misread words replaced.

    ``cases`` are (line, kind, word, token, form); a misread word is replaced where it stands, by its place in the line
    (counted from 0) and its form, and nothing else is touched. Paragraphs begin at the lines that the model labels as
    breaks, and are parted by blank lines.
    """
    model = model or LineModel.prior()
    lines = text.split("\n")
    gone = {n for n, kind, *_ in cases if kind in ("header", "page_number")}
    wrong: dict[int, dict[int, tuple[str, str]]] = {}
    joined: dict[int, str] = {}
    for n, kind, word, token, form in cases:
        if kind == "misread":
            wrong.setdefault(n, {})[int(token)] = (form, word)
        elif kind == "hyphen":
            joined[n] = word
    body = [n for n, line in enumerate(lines, 1) if n not in gone and line.strip()]
    new = model.breaks([lines[n - 1] for n in body])
    out: list[list[str]] = []
    drop_first = False
    for n, starts_new in zip(body, new):
        tokens = lines[n - 1].split()
        for k, (form, word) in wrong.get(n, {}).items():
            t = tokens[k] if k < len(tokens) else ""
            at = t.lower().find(form)
            if t and at >= 0:
                tokens[k] = t[:at] + (word.capitalize() if t[at : at + 1].isupper() else word) + t[at + len(form) :]
        if starts_new and not drop_first or not out:
            out.append([])
        if drop_first:  # the second half of a word that was broken over the lines, but for the marks after it
            tail = regex.search(r"[.,;:!?)\]”\"']+$", tokens[0])
            if tail and out[-1]:
                out[-1][-1] += tail[0]
            tokens = tokens[1:]
        drop_first = n in joined and bool(tokens)
        if drop_first:
            m = regex.match(r"^[\"“(\[]*", tokens[-1])
            word = joined[n]
            tokens[-1] = m[0] + (word[:1].upper() + word[1:] if tokens[-1][len(m[0]) :][:1].isupper() else word)
        out[-1].extend(tokens)
    return "\n\n".join(" ".join(p) for p in out if p)


def repaired(rows: DataFrame, found: DataFrame, model: LineModel) -> DataFrame:
    """(table_name, row_id, text): every text of ``rows`` reassembled by the cases found in it.

    The cases of one text meet in one row, no more of them than it has words. A null text stays null, repeated rows stay.
    """
    fields = ["line_no", "kind", "word", "token", "form"]
    per = found.groupBy("table_name", "row_id").agg(F.sort_array(F.collect_set(F.struct(*fields))).alias("cases"))
    joined = rows.select("table_name", "row_id", "text").join(per, ["table_name", "row_id"], "left")
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [None if t is None else reassemble(t, [tuple(c[f] for f in fields) for c in (cs if cs is not None else ())], sent.value) for t, cs in zip(b["text"], b["cases"])]
            yield pd.DataFrame({"table_name": b["table_name"], "row_id": b["row_id"], "text": np.array(texts, object)})

    return joined.mapInPandas(run, "table_name string, row_id long, text string")
