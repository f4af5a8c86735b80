"""Typed relations between terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import parent_number
from corpusloom.plans import cut

#: Cue, pattern, whether the term found is the source, relation, confidence.
CUES = (
    ("special_case_of", r"(?:a\s+)?special\s+case\s+of\s+", True, "generalizes", 0.9),
    ("generalizes", r"generali[sz](?:es|ation\s+of)\s+", False, "generalizes", 0.9),
    ("uses", r"(?:using|based\s+on|relies\s+on)\s+", True, "prerequisite", 0.8),
    ("proved_by", r"(?:proved\s+by|proof\s+follows\s+from)\s+", True, "proved_by", 0.8),
    ("example", r"for\s+example\s+", False, "example_of", 0.6),
    ("contrast", r"(?:in\s+contrast\s+to|unlike|compared\s+to)\s+", False, "contrasts_with", 0.7),
    ("see", r"see\s+(?:Theorem|Lemma|Section)\s+", False, "uses", 0.6),
)
#: What parts words, by the same notion of a word as the \b of :func:`mentions`.
_TOKEN = r"(?U)\W+"
#: Most names whose keys are broadcast.
FEW = 200_000


def mentions(text: Column, name: Column) -> Column:
    """Whether a text has a name as whole words, whatever the case. The plain test for containment goes first."""
    quoted = F.concat(F.lit(r"(?iU)\b\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return F.contains(F.lower(text), F.lower(name)) & F.call_function("rlike", text, quoted)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), _TOKEN), lambda x: x != "")


def _neighbours(words: Column) -> Column:
    """Each two words that follow each other, parted by a blank."""
    return F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())


def mention_pairs(texts: DataFrame, names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """Every text with every name that it mentions: an equi-join on the name's first two words, then the exact test.

    The join runs over the numbers of the texts; each text meets its candidates by its number, so none is copied for
    each of its words. Names without a letter or digit are found by no word and left out.
    """
    rows = cut(texts.withColumn("__row", F.monotonically_increasing_id()))
    keys = rows.where(F.col(text).isNotNull()).select("__row", _tokens(F.col(text)).alias("__w")).select("__row", F.explode(F.array_distinct(F.concat("__w", _neighbours(F.col("__w"))))).alias("__tok"))
    n = names.withColumn("__tok", F.array_join(F.slice(_tokens(F.col(name)), 1, 2), " ")).where("__tok <> ''")
    n = F.broadcast(n) if n.limit(FEW + 1).count() <= FEW else n
    return rows.join(keys.join(n, "__tok").drop("__tok"), "__row").where(mentions(F.col(text), F.col(name))).drop("__row")


def ordered_prerequisites(concepts: DataFrame, shortest: int = 4) -> DataFrame:
    """(source, target): an earlier concept of the same section that a later one's description mentions."""
    a = concepts.where(F.length("name") >= shortest).select(F.col("name").alias("source"), "section", F.col("ord").alias("__a"))
    b = concepts.select(F.col("name").alias("target"), "section", F.col("ord").alias("__b"), "description")
    pairs = a.join(b, "section").where("__a < __b").where(mentions(F.col("description"), F.col("source")))
    return pairs.select("source", "target", F.lit("prerequisite").alias("relation"), F.lit(0.7).alias("confidence"), F.lit(1).alias("stage"), F.struct("__b", "__a").alias("emitted"))


def section_generalisations(concepts: DataFrame, shortest: int = 4) -> DataFrame:
    """(source, target): a concept of the parent section that a description mentions."""
    a = concepts.where(F.length("name") >= shortest).select(F.col("name").alias("source"), F.col("section").alias("__p"), F.col("ord").alias("__a"))
    b = concepts.select(F.col("name").alias("target"), parent_number(F.col("section")).alias("__p"), F.col("ord").alias("__b"), "description")
    pairs = a.join(b, "__p").where(mentions(F.col("description"), F.col("source")))
    return pairs.select("source", "target", F.lit("generalizes").alias("relation"), F.lit(0.5).alias("confidence"), F.lit(2).alias("stage"), F.struct("__b", "__a").alias("emitted"))


def section_edges(concepts: DataFrame, shortest: int = 4) -> DataFrame:
    """The edges of :func:`ordered_prerequisites` and :func:`section_generalisations`, each source by the first concept
    of its name in the section alone: the same ends, without a row for each pair of concepts.

    One pass over the words of the descriptions; those that lead a name meet the names of the section and its parent,
    then comes the exact test. Names without a letter or digit, which no word finds, are looked for in all descriptions there.
    """
    key = F.array_join(F.slice(_tokens(F.col("source")), 1, 2), " ")
    named = concepts.where((F.length("name") >= shortest) & F.col("section").isNotNull())
    firsts = cut(named.groupBy(F.col("name").alias("source"), F.col("section").alias("__s")).agg(F.min("ord").alias("__a")).withColumn("__tok", key))
    odd, two, n = firsts.agg(F.max(F.col("__tok") == ""), F.max(F.contains("__tok", F.lit(" "))), F.count_distinct("__tok")).first()
    b = concepts.where("section is not null and description is not null").withColumn("__p", parent_number(F.col("section")))
    rows = cut(b.select(F.col("name").alias("target"), "section", "__p", F.col("ord").alias("__b"), "description", F.monotonically_increasing_id().alias("__row")))
    at = F.explode(F.array_compact(F.array("section", "__p"))).alias("__s")
    words = rows.select("__row", "section", "__p", _tokens(F.col("description")).alias("__w"))
    toks = words.select("__row", "section", "__p", F.explode(F.array_distinct(F.concat("__w", _neighbours(F.col("__w"))) if two else F.col("__w"))).alias("__tok"))
    leads = firsts.select("__tok").distinct()
    near = toks.join(F.broadcast(leads) if n <= FEW else leads, "__tok", "left_semi").select("__row", "__tok", at).join(firsts, ["__tok", "__s"]).drop("__tok")
    if odd:
        near = near.unionByName(rows.select("__row", at).join(firsts.where("__tok = ''").drop("__tok"), "__s"))
    same = F.col("__s") == F.col("section")
    found = rows.join(near, "__row").where((~same | (F.col("__a") < F.col("__b"))) & mentions(F.col("description"), F.col("source")))
    either = lambda x, y: F.when(same, F.lit(x)).otherwise(F.lit(y))
    return found.select("source", "target", either("prerequisite", "generalizes").alias("relation"), either(0.7, 0.5).alias("confidence"), either(1, 2).alias("stage"), F.struct("__b", "__a").alias("emitted"))


def cue_relations(concepts: DataFrame, cues: tuple = CUES) -> DataFrame:
    """Relations that a cue in a description announces: with the first concept, in list order, mentioned after the cue.

    If that is the concept itself there is none. Every occurrence of every cue counts.
    """
    rules = F.array(*(F.struct(F.lit(k).alias("cue"), F.lit(c[2]).alias("flip"), F.lit(c[3]).alias("relation"), F.lit(c[4]).alias("confidence")) for k, c in enumerate(cues)))
    tails = F.flatten(F.array(*(F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split("description", "(?i)" + c[1], -1)), F.lit(2))), _tail(c[1], k)) for k, c in enumerate(cues))))
    cued = concepts.where(reduce(Column.__or__, (F.col("description").rlike("(?i)" + c[1]) for c in cues)))
    spots = cued.select(F.col("name").alias("this"), F.col("ord").alias("__o"), F.posexplode(tails).alias("__n", "t")).where("t.tail is not null").select("this", "__o", "__n", "t.cue", "t.tail")
    found = mention_pairs(spots, concepts.groupBy("name").agg(F.min("ord").alias("__c")), "tail", "name")
    nearest = found.groupBy("this", "__o", "__n", "cue").agg(F.min(F.struct("__c", "name"))["name"].alias("other")).where("other <> this")
    rule = F.get(rules, F.col("cue"))
    flip = rule["flip"]
    return nearest.select(
        F.when(flip, F.col("other")).otherwise(F.col("this")).alias("source"), F.when(flip, F.col("this")).otherwise(F.col("other")).alias("target"),
        rule["relation"].alias("relation"), rule["confidence"].alias("confidence"), F.lit(3).alias("stage"), F.struct(F.col("__o").alias("__b"), F.col("__n").cast("bigint").alias("__a")).alias("emitted"),
    )


def _tail(pattern: str, cue: int):
    """What follows the (i-1)-th occurrence of a pattern in the description; null if there are fewer."""

    def tail(i: Column) -> Column:
        pieces = F.split("description", "(?i)" + pattern, -1)
        got = F.when(i <= F.size(pieces), F.array_join(F.slice(pieces, i, F.greatest(F.size(pieces) - i + 1, F.lit(0))), " "))
        return F.struct(F.lit(cue).alias("cue"), got.alias("tail"))

    return tail


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge per source, target and relation: the most confident, the first emitted among equals."""
    best = F.max_by(F.struct("confidence", "stage"), F.struct("confidence", -F.col("stage")))
    return edges.groupBy("source", "target", "relation").agg(best.alias("b")).select("source", "target", "relation", "b.confidence", "b.stage")


def resolve_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges by id instead of name; those with an unknown end are dropped. ``ids`` has (name, id), names unique."""
    s, t = (ids.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")) for c in ("source", "target"))
    return edges.join(s, "source").join(t, "target")
