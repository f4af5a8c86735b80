"""Column builders for names, numbers and short texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = r"[ \t\n\r\f\x0B\x1C-\x1F\x85\xA0  -     　]"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{_WS}+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{_WS}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def parent_number(c: Column) -> Column:
    """A dotted number without its last component; null at the top."""
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", ""))


def chapter_of(c: Column) -> Column:
    return F.split(c, r"\.")[0]


def chapter_number(c: Column) -> Column:
    """The chapter as a number; null if it is none."""
    return chapter_of(c).try_cast("int")


def natural_key(c: Column) -> Column:
    """A dotted number as an array that sorts by its numbers, so that 1.10 follows 1.9; other components come first."""
    return F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(-1)))


def bold(flags: Column) -> Column:
    return flags.bitwiseAND(16) != 0


def italic(flags: Column) -> Column:
    return flags.bitwiseAND(2) != 0


# Families of mathematical fonts.
MATH_FONTS = "CMMI CMBX CMSY CMEX CMR7 CMMI7 CMSY7".split()


def math_font(font: Column, prefixes: list[str] = MATH_FONTS) -> Column:
    return reduce(lambda a, b: a | b, [font.startswith(p) for p in prefixes])


def math_symbol(c: Column) -> Column:
    """At most two characters, or none of them a letter or digit."""
    return (F.length(strip(c)) <= 2) | ~c.rlike(r"[\p{L}\p{N}]")


def drop_final_dot(c: Column, prefix: str = "Algorithm") -> Column:
    s = strip(c)
    return F.when(s.startswith(prefix) & s.endswith("."), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)


# Joined letters and what they stand for, in the same order.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def unjoin(c: Column, which: str = "ﬀﬁﬂﬃﬄ") -> Column:
    return reduce(lambda x, l: F.replace(x, F.lit(l), F.lit(LIGATURES[l])), which, c)


def name_loose(c: Column) -> Column:
    """Joined letters and case undone, white space squeezed, dots at the end and quotes, commas, brackets and the like
    dropped, dashes of any kind made one hyphen."""
    s = F.lower(squeeze(F.regexp_replace(unjoin(strip(c), "ﬁﬂ"), r"\.+$", "")))
    s = F.regexp_replace(s, "[\"'`,:;!?(){}\\[\\]]", "")
    return strip(F.regexp_replace(s, "[-‐–—−]+", "-"))


def name_strict(c: Column) -> Column:
    """Joined letters undone, white space squeezed, dots at the end dropped; case stays."""
    return F.regexp_replace(squeeze(unjoin(c)), r"\.+$", "")


def without_label(c: Column, label: str = "algorithm") -> Column:
    """What follows "<label> N.N " in a name; null if nothing does or there is no label."""
    got = F.regexp_extract(c, rf"(?i)^{label}\s+\d+(?:\.\d+)*\s+(.+)$", 1)
    return F.when(got != "", got)


def singular(c: Column) -> Column:
    return F.when((F.length(c) > 4) & c.endswith("s") & ~c.endswith("ss"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def bare_name(c: Column) -> Column:
    """:func:`name_loose` without hyphens and spaces; null if shorter than three characters."""
    s = F.translate(name_loose(c), "- ", "")
    return F.when(F.length(s) >= 3, s)


def lower_first(c: Column, keep: list[str] | None = None) -> Column:
    """The first letter in lower case, unless the first word is in capitals, has a digit, or is listed."""
    first = F.split(c, " ")[0]
    stay = first.rlike(r"^[A-Z0-9]{2,}|[0-9]|[A-Z].*[A-Z]")
    if keep:
        stay = stay | first.isin(keep)
    return F.when(stay, c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))


def title_case(c: Column, acronyms: list[str] | None = None, small: list[str] | None = None) -> Column:
    """Words with a capital, hyphenated parts too; acronyms in capitals, small words (not first) as they are."""
    acronyms, small = [a.lower() for a in acronyms or []], small or []

    def one(w: Column) -> Column:
        parts = F.transform(F.split(w, "-"), lambda p: F.when(F.lower(p).isin(acronyms), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))))
        return F.array_join(parts, "-")

    return F.array_join(F.transform(F.split(c, " "), lambda w, i: F.when((i > 0) & F.lower(w).isin(small), F.lower(w)).otherwise(one(w))), " ")


def tier(name: Column, rules: list[tuple[int, str, str]], default: int) -> Column:
    """The level of the first rule (level, "is" or "has", text) that a lower-cased name meets."""
    low = F.lower(name)
    tests = [((low == t) if how == "is" else low.contains(t), level) for level, how, t in rules]
    return reduce(lambda other, r: F.when(r[0], r[1]).otherwise(other), reversed(tests), F.lit(default))


def first_said(*cs: Column, default: str | None = None) -> Column:
    """The first of the columns that is neither null nor empty."""
    said = [F.when(c != "", c) for c in cs]
    return F.coalesce(*said, F.lit(default)) if default is not None else F.coalesce(*said)


def label(number: Column, title: Column) -> Column:
    return F.when(number != "", F.concat_ws(" ", number, title)).otherwise("")


def clip(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def between(c: Column, start: str, end: str) -> Column:
    """The text from ``start`` to ``end``, both included; null unless both are there, in that order."""
    a = F.instr(c, start)
    rest = F.substring(c, a, F.length(c))
    b = F.instr(F.substring(rest, F.lit(len(start) + 1), F.length(rest)), end)
    return F.when((a > 0) & (b > 0), F.substring(rest, F.lit(1), b + len(start) + len(end) - 1))


def add_missing(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with null columns of the given types where it lacks them."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})
