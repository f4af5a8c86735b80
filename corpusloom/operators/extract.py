"""Ordered extraction of sections and terms from paragraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.classify import DEFAULT, Profile, reject_reason
from corpusloom.functions.text import chapter_of, math_symbol, parent_number, squeeze, strip, word_count

# Words with which a term can't end.
_LOOSE_ENDS = "for of from the a an in on to with and or by as".split()
# Words that are no terms by themselves.
STOP_TERMS = (
    "a an the this that these those it its we our they their is are was were be been has have had do does did will would could should may might not no yes so if then "
    "and or but with from to of in on at by for more less most least very quite new old large small simple complex first second third last next previous same different "
    "similar other each every all some any both either neither scalar vector matrix function variable parameter equation formula expression result solution problem method "
    "approach technique procedure case example way form type kind figure table chapter section page"
).split()
#: Phrases that introduce a term, in the order in which their terms count.
INTRODUCTIONS = (
    r"(?i)(?:is|are)\s+called\s+(?:the\s+)?(.+?)(?:[.,;:\n]|$)",
    r"(?i)known\s+as\s+(?:the\s+)?(.+?)(?:[.,;:\n]|$)",
    r"(?i)referred\s+to\s+as\s+(?:the\s+)?(.+?)(?:[.,;:\n]|$)",
    r"(?i)we\s+(?:call|define)\s+(?:this\s+)?(?:the\s+)?(.+?)(?:[.,;:\n]|$)",
)


def section_parts(text: Column) -> Column:
    """struct(number, title, parent, chapter) of a header; number is null if it has none."""
    t = strip(text)
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)\s+", 1)
    number = F.when(number != "", number)
    title = F.when(number.isNotNull(), strip(F.regexp_replace(t, r"^\d+(?:\.\d+)*\s+", ""))).otherwise(t)
    return F.struct(number.alias("number"), title.alias("title"), parent_number(number).alias("parent"), chapter_of(number).alias("chapter"))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order`` (which must be unique within a key), as an aggregate: combined before the
    shuffle, so a hot key costs no more than others. Null keys count as one key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(F.struct(*order).alias("__o"), F.struct(*rest).alias("__r"))).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.__r.{c}").alias(c) for c in rest)).select(*df.columns)


def first_headers(headers: DataFrame, book: str = "book", order: str = "ord") -> DataFrame:
    """Headers (book, ord, number, title) without repetitions: the first per number, or per title if unnumbered."""
    key = headers.withColumn("__k", F.coalesce("number", "title")).withColumn("__u", F.col("number").isNull())
    return first_per(key, [book, "__k", "__u"], [order]).drop("__k", "__u")


def current_section(rows: DataFrame, book: str = "book", order: str = "ord") -> DataFrame:
    """``rows`` (book, ord, is_header, number, title) with section: the number of the section that each belongs to.

    A numbered header sets it, also when repeated; the first unnumbered header of its title unsets it; later ones
    change nothing. The state stands in a struct, so that an unset section differs from no change.
    """
    firsts = Window.partitionBy(book, "is_header", "number", "title").orderBy(order)
    flow = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fresh = rows.withColumn("__first", F.row_number().over(firsts) == 1)
    state = F.when(F.col("is_header") & (F.col("number").isNotNull() | F.col("__first")), F.struct("number"))
    return fresh.withColumn("section", F.last(state, ignorenulls=True).over(flow)["number"]).drop("__first")


def neighbourhood(rows: DataFrame, book: str = "book", order: str = "ord", around: int = 3, ahead: int = 4, long: int = 100) -> DataFrame:
    """``rows`` (text, type) with near_caption (a caption within ``around`` rows) and described_by (the first of the next
    ``ahead`` texts longer than ``long``)."""
    w = Window.partitionBy(book).orderBy(order)
    caption = F.col("type").isin("figure_caption", "table_caption")
    return rows.withColumn("near_caption", F.coalesce(F.max(caption).over(w.rowsBetween(-around, around)), F.lit(False))).withColumn(
        "described_by", F.first(F.when(F.length("text") > long, F.col("text")), ignorenulls=True).over(w.rowsBetween(1, ahead))
    )


def defined_term(text: Column, marked: Column | None = None) -> Column:
    """The term that a definition defines: marked in type, else in quotes, else after "Definition", else the opening words.

    ``marked`` holds the bold or italic spans of the first line. Null if the term breaks off.
    """
    t = strip(text)
    line = F.split(t, "\n")[0]
    brief = lambda c: F.when((c != "") & (word_count(c) <= 4), c)
    quoted = strip(F.regexp_extract(line, '["“]([^"”]+)["”]', 1))
    after = brief(strip(F.regexp_extract(t, r"(?i)^definition\s*[:.]?\s*([^.,;:\n]*)", 1)))
    opening = brief(strip(F.regexp_extract(line, r"^([^.,;:]*)", 1)))
    options = [F.when(quoted != "", quoted), after, opening]
    if marked is not None:
        options.insert(0, F.get(F.filter(F.transform(marked, strip), lambda x: (x != "") & (word_count(x) <= 4) & ~math_symbol(x)), 0))
    term = F.coalesce(*options)
    return F.when(~(term.endswith("-") | F.lower(F.element_at(F.split(term, r"\s+"), -1)).isin(_LOOSE_ENDS)), term)


def theorem_name(text: Column) -> Column:
    """"Kind N (Name)" of a theorem, lemma or corollary, or else its first line."""
    pattern = r"(?i)^(theorem|lemma|corollary)\s+(\d+(?:\.\d+)*)(?:\s*\(([^)]+)\))?"
    t = strip(text)
    kind, number, name = (F.regexp_extract(t, pattern, k) for k in (1, 2, 3))
    named = F.concat(F.initcap(kind), F.lit(" "), number, F.when(name != "", F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""))
    return F.when(kind != "", named).otherwise(strip(F.split(t, "\n")[0]))


def introduced_terms(rows: DataFrame, text: str = "text", page: str | None = None, patterns: tuple[str, ...] = INTRODUCTIONS, profile: Profile = DEFAULT, stop: list[str] = STOP_TERMS) -> DataFrame:
    """A row per term introduced by a phrase, with pattern_no and match_no; loose ends, rejected names and stop words left out."""
    found = F.array(*(F.regexp_extract_all(F.col(text), F.lit(p), 1) for p in patterns))
    each = rows.select("*", F.posexplode(found).alias("pattern_no", "__t")).select("*", F.posexplode("__t").alias("match_no", "term")).drop("__t")
    each = each.withColumn("term", squeeze(F.col("term")))
    term = F.col("term")
    good = ~term.endswith("-") & ~F.lower(F.element_at(F.split(term, " "), -1)).isin(_LOOSE_ENDS) & word_count(term).between(1, 5)
    return each.where(good & ~math_symbol(term) & reject_reason(term, F.col(page) if page else None, profile).isNull() & ~F.lower(term).isin(stop))


def first_seen(terms: DataFrame, term: str, order: list[str]) -> DataFrame:
    """Each term once whatever its case, where it is seen first."""
    return first_per(terms.withColumn("__l", F.lower(term)), ["__l"], order).drop("__l")


def dominant(spans: Column, value: str, weight: Callable[[Column], Column] | None = None) -> Column:
    """The value of the spans with the most characters, the first seen among equals (K1, K2); null without spans.
    ``weight`` gives another measure of a span, such as its length without white space at the ends.

    ``spans`` is an array of structs with text and ``value``. Computed within the row, without a shuffle.
    """
    size = (lambda x: F.length(x["text"])) if weight is None else weight
    values = F.array_distinct(F.transform(spans, lambda x: x[value]))
    scored = F.transform(values, lambda v, i: F.struct(F.aggregate(F.filter(spans, lambda x: x[value] == v), F.lit(0), lambda a, x: a + size(x)).alias("n"), (-i).alias("o"), v.alias("v")))
    return F.array_max(scored)["v"]
