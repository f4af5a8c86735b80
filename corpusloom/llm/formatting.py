"""Records that differ only in formatting, collapsed by commutative fingerprints."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.lookalike import canonical, letter_model
from corpusloom.plans import cut, lookup_join

_SET_OFF = regex.compile(r"[,;()\[\]{}，；（）［］]+")
_NOT_NAMING = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_WIDTH = 1 << 40


def name_forms(name: str, model: dict[str, float]) -> tuple[str, list[str]]:
    """(straight, moved): the letters and digits of a name as it stands, and with each part after the first that is set
    off put first, the last part before others.

    Case, white space, other punctuation and look-alike characters don't count. moved is empty if nothing is set off.
    """
    text = unicodedata.normalize("NFKC", canonical(name, model, whole_words=True)[0])
    parts = [p for p in (_NOT_NAMING.sub("", part).casefold() for part in _SET_OFF.split(text)) if p]
    return "".join(parts), ["".join([parts[k], *parts[:k], *parts[k + 1 :]]) for k in range(len(parts) - 1, 0, -1)]


def _forms(name: Column, model: dict[str, float]) -> Column:
    """The forms of a name, straight first, parted by line breaks."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str, str] = {}
            for t in batch:
                if t is not None and t not in known:
                    straight, moved = name_forms(t, model)
                    known[t] = "\n".join([straight, *moved])
            yield pd.Series([known.get(t, "") for t in batch], index=batch.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())(name)


def fingerprint(pairs: dict[str, Column]) -> Column:
    """A commutative hash of records: the sum of hashes over (field, piece) pairs, each field a column of pieces (array).

    Neither the order of fields nor that of pieces matters; repeated pieces count as often as they stand.
    """

    def total(salt: int) -> Column:
        sums = F.lit(0).cast("long")
        for field, pieces in pairs.items():
            hashes = F.transform(pieces, lambda x: F.pmod(F.xxhash64(F.lit(field), x, F.lit(salt)), F.lit(_WIDTH)))
            sums = sums + F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + x)
        return sums

    return total(1).bitwiseXOR(F.pmod(total(2), F.lit(1 << 22)) * F.lit(1 << 41))


def same_names(records: DataFrame, id_col: str = "id", name_col: str = "name", model: dict[str, float] | None = None) -> DataFrame:
    """(id, first_id, copies) of every record with a name: the smallest id of its group and the group's size.

    Each name becomes the multiset of its characters, hashed commutatively, so that a moved part changes nothing;
    within a fingerprint, forms are compared in full. A name with a part set off equals the unmarked name that it
    gives with the part moved, else the unmarked one that it is as it stands, else other marked names with the same
    moved form. Forms are counted before anything is joined; hot forms are joined by broadcast. A repeated id counts
    once; records whose name is null or without any letter or digit are left out, as they name nothing.
    """
    model = letter_model(records, name_col) if model is None else model
    rows = records.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).where("id is not null and name is not null").groupBy("id", "name").agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.select("id", _forms(F.col("name"), model).alias("form")).where("form <> ''")
    rows = cut(rows.groupBy("id").agg(F.min("form").alias("form")))  # the forms are made in Python, once
    forms = cut(rows.groupBy("form").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    parts = F.split("form", "\n")
    forms = forms.withColumn("straight", parts[0]).withColumn("moved", F.slice(parts, F.lit(2), F.size(parts) - 1))
    forms = forms.withColumn("print", fingerprint({"name": F.split("straight", "")}))
    unmarked = forms.where("size(moved) = 0").select("print", F.col("straight").alias("u"))
    marked = forms.where("size(moved) > 0")
    # its moved forms and the straight one, in order; a form is asked for with its fingerprint, so unlike forms rarely meet
    asked = marked.select("form", "print", F.posexplode(F.concat("moved", F.array("straight"))).alias("place", "u"))
    found = asked.join(unmarked, ["print", "u"]).groupBy("form").agg(F.min(F.struct("place", "u"))["u"].alias("u"))
    marked = marked.join(found, "form", "left").withColumn("key", F.coalesce("u", F.col("moved")[0])).select("form", "key", "print", "first", "n")
    keyed = forms.where("size(moved) = 0").select("form", F.col("straight").alias("key"), "print", "first", "n").unionByName(marked)
    groups = keyed.groupBy("print", "key").agg(F.min("first").alias("first_id"), F.sum("n").alias("copies"))
    by_form = keyed.select("form", "print", "key").join(groups, ["print", "key"]).select("form", "first_id", "copies")
    return lookup_join(rows, by_form, "form", "inner").select("id", "first_id", "copies")


def plain_value(value: Column) -> Column:
    """A field's value without white space, letter case and punctuation: its letters and digits."""
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{M}\p{N}]+", ""))


def same_records(records: DataFrame, fields: Column, id_col: str = "id") -> DataFrame:
    """(id, first_id, copies) of every record: the smallest id of its group of equal records and the group's size.

    ``fields`` is a column of pairs (name, value), an array of structs, in any order. Each pair is hashed with its value in
    plain form, the hashes are added up, which no order of fields changes, and records are grouped by the sum and by a
    second one; in each group every record is then compared with its first, pair by pair as counts. Records that differ
    in spite of equal sums (which needs 126 equal bits) are grouped by their pairs in order. No fields are sorted otherwise. Pairs
    with a null name or a value that is null or without letters and digits say nothing and don't count; records without
    pairs are equal. A repeated id counts once, with the first of its sums.
    """
    pair = lambda p: F.struct(F.lower(p["name"]).alias("name"), plain_value(p["value"]).alias("value"))
    plain = F.filter(F.transform(F.coalesce(fields, F.array().cast(records.select(fields.alias("f")).schema["f"].dataType)), pair), lambda p: p["name"].isNotNull() & (F.coalesce(p["value"], F.lit("")) != ""))
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), plain.alias("pairs"))

    def total(salt: int) -> Column:
        hashed = F.transform("pairs", lambda p: F.pmod(F.xxhash64(p["name"], p["value"], F.lit(salt)), F.lit(1 << 62)))
        return F.aggregate(hashed, F.lit(0).cast("long"), lambda a, h: F.pmod(a + h, F.lit(1 << 62)))

    rows = rows.withColumn("print", F.concat_ws(" ", total(1), total(2)))
    once = rows.select("id", "print").groupBy("id").agg(F.min(F.xxhash64("print")).alias("k"))
    rows = cut(rows.join(once, "id").where(F.xxhash64("print") == F.col("k")).drop("k").dropDuplicates(["id"]))
    first = cut(rows.groupBy("print").agg(F.min("id").alias("first")))
    lead = first.join(rows.select(F.col("id").alias("first"), F.col("pairs").alias("lead")), "first").select("print", "lead")
    count = lambda some, p: F.size(F.filter(some, lambda q: q == p))
    equal = (F.size("pairs") == F.size("lead")) & F.forall("pairs", lambda p: count(F.col("pairs"), p) == count(F.col("lead"), p))
    checked = cut(lookup_join(rows, lead, "print", "inner").select("id", F.when(equal, F.col("print")).otherwise(F.concat_ws(" ", "print", F.to_json(F.array_sort("pairs")))).alias("print")))
    groups = checked.groupBy("print").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return lookup_join(checked, groups, "print", "inner").select("id", "first_id", "copies")
