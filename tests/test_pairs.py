"""Operators that must not pair all rows that share a common word."""

import random
import re
from itertools import product

from corpusloom.operators import lookup, relate
from corpusloom.queries import reference


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quotes_against_brute_force_without_copies_of_texts(spark):
    rnd = random.Random(5)
    texts = [(k, "".join(rnd.choice("ab ξ😀") for _ in range(rnd.randrange(0, 200)))) for k in range(300)] + [(900, None), (901, ""), (902, "aab")]
    long = "".join(rnd.choice("abc ") for _ in range(2_100_000))
    texts += [(903, long), (904, long[999_000:]), (None, "only in a text without number")]
    quotes = []
    for k in range(400):
        t = rnd.choice(texts[:300])[1]
        i = rnd.randrange(0, max(1, len(t) - 4))
        quotes.append((k, t[i : i + rnd.randrange(2, 90)] + "x" * (k % 7 == 0)))
    quotes += [(500, long[999_970:1_000_030]), (501, long[1_999_999:2_000_050]), (502, long[-30:]), (503, "only in a text"), (504, None), (505, ""), (506, "aab"), (506, "aab")]
    q = spark.createDataFrame(quotes, "id long, q string")
    t = spark.createDataFrame(texts * 2, "p long, t string").repartition(3)
    for shortest, opening in ((20, 60), (3, 12), (4, 4)):
        want = set()
        for i, x in set(quotes):
            at = [p for p, y in texts if x is not None and len(x) >= shortest and y is not None and x[:opening] in y]
            if at:
                want.add((i, x, min((p for p in at if p is not None), default=None)))
        found = lookup.quote_home(q, t, "q", "t", "p", shortest, opening)
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(want) and set(rows) == want
        assert "Generate" not in plan(found) and "NestedLoop" not in plan(found)
    assert lookup.quote_home(q.limit(0), t, "q", "t", "p").collect() == []
    assert lookup.quote_home(q, t.limit(0), "q", "t", "p").collect() == []


def edges(concepts):
    """(source, target, relation, stage) between concepts (name, ord, section, description), by trying all pairs."""
    out = set()
    for (s, i, p, _), (t, j, q, d) in product(concepts, concepts):
        if None in (s, d, p, q) or len(s) < 4:
            continue
        ends = (r"(?<=\w)", r"(?=\w)") if s == "++++" else (r"\b", r"\b")
        if re.search(f"(?i){ends[0]}{re.escape(s)}{ends[1]}", d):
            out |= {(s, t, "prerequisite", 1)} if p == q and i < j else set()
            out |= {(s, t, "generalizes", 2)} if "." in q and p == q.rsplit(".", 1)[0] else set()
    return out


def test_section_edges_against_brute_force(spark):
    rnd = random.Random(7)
    names = ["margin", "norm", "ridge net", "ridge", "++++", "Ridge NET", "élan", None, "lasso", "the"]
    words = ["margin", "Margins", "NORM", "ridge", "net,", "a++++b", "Élan", "the", "lasso"]
    concepts = [(rnd.choice(names), k, rnd.choice(["1", "1.1", "1.1.2", "2", None]), rnd.choice([None, *(" ".join(rnd.choice(words) for _ in range(4)) for _ in range(9))])) for k in range(90)]
    rnd.shuffle(concepts)
    for some in (concepts, [c for c in concepts if c[0] not in ("++++", "ridge net", "Ridge NET")], [c for c in concepts if c[2] is None]):
        c = spark.createDataFrame(some, "name string, ord int, section string, description string")
        got = [tuple(r) for r in relate.section_edges(c).select("source", "target", "relation", "stage", "emitted").collect()]
        assert {r[:4] for r in got} == edges(some) and len(set(got)) == len(got)
        both = relate.ordered_prerequisites(c).unionByName(relate.section_generalisations(c)).select("source", "target", "relation", "stage", "emitted")
        first = lambda rows: {k: min(r[4] for r in rows if r[:4] == k) for k in {r[:4] for r in rows}}
        assert first(got) == first([tuple(r) for r in both.collect()])


def test_relation_edges_makes_no_row_for_each_pair_of_concepts(spark, tmp_path):
    n = 3000
    rows = [(k, f"Plain {'margin' if k % 2 else 'norm'}", "the margin, unlike the norm and a margin", k % 3 + 1, None) for k in range(n)]
    spark.createDataFrame(rows, "id long, name string, description string, section_id long, deleted_at timestamp").write.parquet(str(tmp_path / "concepts.parquet"))
    spark.createDataFrame([(1, "1"), (2, "1"), (3, "1.1")], "id long, number string").write.parquet(str(tmp_path / "sections.parquet"))
    found = reference.QUERIES["relation_edges"](spark, str(tmp_path))
    got = {tuple(r) for r in found.collect()}
    ends = list(product(("margin", "norm"), repeat=2))
    assert got == {(*e, "prerequisite", 0.7, 1) for e in ends} | {(*e, "generalizes", 0.5, 2) for e in ends} | {("margin", "norm", "contrasts_with", 0.7, 3)}
    assert max(rows_out(found)) <= 20 * n


def rows_out(df):
    """Rows that each step of the plan of ``df``, collected before, gave out."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        step = todo.pop()
        children = step.children()
        todo += [children.apply(i) for i in range(children.size())]
        if step.nodeName() == "AdaptiveSparkPlan":
            todo.append(step.executedPlan())
        elif step.nodeName().endswith("QueryStage"):
            todo.append(step.plan())
        metric = step.metrics().get("numOutputRows")
        found += [metric.get().value()] if metric.isDefined() else []
    return found
