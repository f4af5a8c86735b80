"""Ordered rules: the type of a paragraph (K0-K13) and reasons to reject a name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip, word_count

Rules = list[tuple[str, Column]]


def first_match(rules: Rules, otherwise: str | None = None) -> Column:
    """The name of the first rule that holds; one CASE expression. A rule that is null doesn't hold."""
    return reduce(lambda rest, r: F.when(r[1], r[0]).otherwise(rest), reversed(rules), F.lit(otherwise))


@dataclass(frozen=True)
class Profile:
    """What depends on the book: sizes of type, number of chapters, marks of printer and publisher, lists of words."""

    body_size: float = 9.5
    ratio: float = 1.3
    header_chars: int = 150
    chapters: int = 18
    front_pages: int = 20
    # Texts that mark a page of the printer or publisher.
    imprint: tuple[str, ...] = ("Printer:", "Opaque", "Springer")
    # Signs of formulas.
    math_signs: str = "|⟨⟩λαβγδεϵθκμνξπρσςτυφχψωΓΔΘΛΞΠΣΦΨΩ=∗ˆ˜¯≤≥∑∏∫±∓×÷∂∇∞∈∉⊂⊃⊆⊇∪∩"
    # Short words in lower case that are concepts nevertheless.
    short_concepts: tuple[str, ...] = ("lasso", "ridge", "bagging", "boosting", "kernel")
    # Names from data sets and figures that are no concepts.
    no_concepts: tuple[str, ...] = (
        "AveRooms", "Obesity", "Wind", "RESTRICTED", "Hinton", "children", "Iteration", "ﬁrst", "responses", "targets", "experts",
        "two functions", "loadings", "discriminant", "encoding", "PKA", "tensor-product scenario", "Specificity",
    )
    # Words with which a name that was cut off ends.
    cut_endings: tuple[str, ...] = ("multiple", "linear", "Monte", "forward", "particular", "general", "simple", "various")
    extra: dict = field(default_factory=dict)


DEFAULT = Profile()


def is_header(text: Column, size: Column | None = None, profile: Profile = DEFAULT) -> Column:
    """A section header: not numbers only, no formula, no imprint; in larger type, or numbered like a section."""
    return once(strip(text), lambda t: _header(t, size, profile))


def _header(t: Column, size: Column | None, profile: Profile) -> Column:
    signs = "".join("\\" + c if c in "|^]-[\\" else c for c in profile.math_signs)
    barred = t.rlike(r"^[\d.\s,\-]+$") | t.rlike(f"[{signs}]") | t.rlike(r"\.\s*\.\s*\.") | t.startswith("This is page")
    barred = reduce(lambda a, b: a | b, [t.contains(x) for x in profile.imprint], barred)
    short = F.length(t) < profile.header_chars
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)\s+[A-Z]", 1)
    title = F.regexp_replace(t, r"^\d+(?:\.\d+)*\s+", "")
    top = F.split(number, r"\.")[0].try_cast("bigint")
    numbered = (number != "") & ~number.startswith("0") & (top <= profile.chapters) & ((word_count(title) >= 2) | (F.length(title) >= 8))
    large = F.lit(False) if size is None else F.coalesce((size > profile.body_size * profile.ratio) & t.rlike(r"\p{L}") & (F.length(t) > 3), F.lit(False))
    # the cheap test for a number or larger type goes first
    likely = t.rlike(r"^[1-9]") if size is None else F.lit(True)
    return likely & short & (large | numbered) & ~barred


def is_equation(text: Column) -> Column:
    """Short, and less than three in ten of the characters other than spaces are letters."""
    return once(strip(text), _equation)


def _equation(t: Column) -> Column:
    total = F.length(F.replace(t, F.lit(" "), F.lit("")))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(t) < 80) & (total > 0) & (letters * 10 < total * 3)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used: a CASE would repeat it per branch."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraph_type(text: Column, size: Column | None = None, page: Column | None = None, pages: Column | None = None, profile: Profile = DEFAULT) -> Column:
    """One of 13 types by the first rule that holds; narrative if none does. Null text gives narrative."""
    return once(strip(text), lambda t: _type_of(t, size, page, pages, profile))


def _type_of(t: Column, size: Column | None, page: Column | None, pages: Column | None, profile: Profile) -> Column:
    tail = F.lit(False) if page is None or pages is None else F.coalesce(page >= pages * 0.9, F.lit(False))
    environment = lambda w: t.rlike(rf"^{w}(?:\s*\d*\.?\s|\.?\s*$)")
    return first_match(
        [
            ("narrative", t.isNull() | (t == "")),
            ("figure_caption", t.rlike(r"^(?:FIGURE|Figure)\s*\d")),
            ("table_caption", t.rlike(r"^(?:TABLE|Table)\s*\d")),
            ("section_header", _header(t, size, profile)),
            ("definition", t.rlike(r"(?i)^definition(?![A-Za-z0-9_])|is defined as(?![A-Za-z0-9_])|we define(?![A-Za-z0-9_])")),
            *((w.lower(), environment(w)) for w in ("Theorem", "Lemma", "Corollary")),
            ("proof", t.rlike(r"^Proof\.?(?:\s|$)")),
            ("example", environment("Example")),
            ("exercise", environment(r"(?:Exercise|Ex\.)")),
            ("equation", _equation(t)),
            ("bibliography", tail & (t.rlike(r"^\[\d+\]") | t.rlike(r"^[A-Z][a-z]+,?\s.*\(\d{4}\)"))),
        ],
        "narrative",
    )


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def reject_reason(name: Column, page: Column | None = None, profile: Profile = DEFAULT) -> Column:
    """Why a name is no concept: the first of about thirty reasons, null if none holds."""
    return once(strip(name), lambda n: _reason(n, page, profile))


def _reason(n: Column, page: Column | None, profile: Profile) -> Column:
    low = F.lower(n)
    letters = F.regexp_replace(n, "[^a-zA-Z]", "")
    front = F.lit(False) if page is None else F.coalesce((page >= 0) & (page < profile.front_pages), F.lit(False))
    last = F.element_at(F.split(n, r"\s+"), -1)
    return first_match(
        [
            ("ends in a hyphen", n.endswith("-")),
            ("starts with a quote or bracket", n.rlike('^["“(]')),
            ("too short", F.length(n) < 3),
            ("one letter repeated", (letters != "") & (F.replace(letters, F.substring(letters, 1, 1), F.lit("")) == "")),
            ("several lines", n.contains("\n")),
            ("looks like a person", n.rlike(r"^[A-Z][a-z]+,?\s+(?:and\s+)?[A-Z][a-z]+")),
            ("front matter", front),
            ("short word", n.rlike("^[a-z]{1,6}$") & ~n.isin(*profile.short_concepts)),
            ("address", n.contains("http") | n.contains("www")),
            ("starts with an article", low.rlike(r"^an?\s+")),
            ("brackets don't match", _count(n, "(") != _count(n, ")")),
            ("quotes don't match", _count(n, '"') % 2 != 0),
            ("label of a table or figure", n.rlike(r"^(?:Row|Dimension|Net|Column|Size of|Number of)(?![A-Za-z0-9_])")),
            ("example or note", n.startswith("Example:") | n.startswith("Note for")),
            ("formula", n.contains("=") & ~n.startswith("Algorithm")),
            ("starts with where", n.startswith("where ") | n.startswith("Where ")),
            ("legend of a figure", n.rlike(r"\d+\s+(?:Prototypes?|Subclass(?:es)?|Curves?|Subset)(?![A-Za-z0-9_])")),
            ("listed", n.isin(*profile.no_concepts)),
            ("caption", low.contains("ordered by") | low.contains("marked")),
            ("fragment", n.rlike(r"^(?:Lack of|Instability of|Relationship of|Computations for)(?![A-Za-z0-9_])")),
            ("long with a comma", n.contains(", ") & (F.length(n) > 30)),
            ("of a variable", n.rlike(r"(?:^|[^A-Za-z0-9_])of\s+[A-Z]$")),
            ("alternative", low.contains(" or ") & ~low.startswith("leave-one-out")),
            ("condition", low.contains(" if ")),
            ("slash", n.contains("/")),
            ("cut off", last.isin(*profile.cut_endings)),
            ("nearest", n.rlike(r"^\d+-Nearest(?![A-Za-z0-9_])")),
            ("procedure", low.startswith("procedure ")),
            ("reference to a chapter", n.rlike(r"\(Chapter\s+\d+\)")),
            ("title of a figure", n.rlike(r"^ROC\s+Curves?(?![A-Za-z0-9_])")),
        ]
    )


# Single words too general to be a concept.
GENERAL_WORDS = tuple(
    "error model data variable parameter estimate function method matrix vector coefficient prediction distribution sample population hypothesis statistic probability "
    "variance mean regression classification feature response predictor observation training testing loss risk penalty constraint optimization convergence iteration".split()
)


def reject_annotated(name: Column, general: tuple[str, ...] = GENERAL_WORDS) -> Column:
    """True for names from annotators that are no concept: short, general, with an article, formula, slash or odd brackets."""
    low = F.lower(strip(name))
    return (
        (F.length(low) < 3) | low.rlike("^(?:a|an|the|this) ") | name.contains("=") | name.contains("/")
        | (_count(name, "(") != _count(name, ")")) | low.isin(*general) | low.rlike(r"^\d[^\p{L}\p{N}]")
    )
