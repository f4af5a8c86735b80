"""Operators over the whole of their input: hot keys, copies, circles, all names."""

import json
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.operators import report
from corpusloom.operators.hierarchy import all_descendants, hierarchy
from corpusloom.queries import reference


def test_nested_chunks_with_a_hot_and_a_null_key(spark, tmp_path):
    rows = [(1, k, None if k % 7 == 0 else f"t{k % 3}", None if k % 5 == 0 else k % 4) for k in range(2500)]
    rows += [(2, 9001, "a", 1), (2, 9000, "b", 1), (None, 9100, "c", 2), (None, 9101, None, None), (2, 9001, "a", 1)]
    spark.createDataFrame(rows, "concept_id long, id long, fact_type string, importance_rank int").write.parquet(str(tmp_path / "concept_facts.parquet"))
    want = defaultdict(list)
    for key, id_, kind, rank in sorted(set(rows), key=lambda r: (r[3] is not None, r[3] or 0, r[1])):
        want[key].append({"id": id_, "type": kind or ""})
    got = defaultdict(list)
    found = reference.QUERIES["nested_facts_json"](spark, str(tmp_path)).collect()
    for r in sorted(found, key=lambda r: r.chunk):
        items = json.loads(r["items"])
        assert 0 < len(items) <= 1000 and r.chunk == len(got[r.concept_id]) // 1000 + 1
        got[r.concept_id] += items
    assert got == want and {(r.concept_id, r.chunk) for r in found} == {(1, 1), (1, 2), (1, 3), (2, 1), (None, 1)}
    assert report.nested_chunks(spark.range(0), ["id"], [F.col("id")], id=F.col("id")).collect() == []


def similar(a, b):
    return a != b and len(a) >= 3 and a in b and (2 * len(a) >= len(b) or len(a) >= 5 and f" {a} " in f" {b} ")


def test_name_similarity_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    words = ["ted", "ing", "rated", "integrated", "ridge", "bridge", "net", "kernel", "ξ²", "el", "rated ing"]
    names = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))) for _ in range(400)] + ["ab", "", "ed ", None]
    spark.createDataFrame([(n,) for n in names * 2], "name string").write.parquet(str(tmp_path / "concepts.parquet"))
    known = {n for n in names if n}
    want = {(a, b) for a in known for b in known if similar(a, b)}
    got = [tuple(r) for r in reference.QUERIES["name_similarity_pairs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_concept_mentions_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    words = ["one", "sided", "one-sided", "kernel", "ξ", "r²", "Lasso", "lasso (l1)", "x_y", "(l1)", "c++", "first order"]
    names = {"".join(rnd.choice(words) + rnd.choice([" ", "-", " "]) for _ in range(rnd.randrange(1, 4))).strip(" -") for _ in range(250)} | {"r", "y", "++", " one"}
    docs = [(k, None if k == 7 else "".join(rnd.choice(words + ["the", "Kernels"]) + rnd.choice([" ", "\n", "-", ", ", "_"]) for _ in range(rnd.randrange(40)))) for k in range(150)]
    spark.createDataFrame([(n,) for n in [*names, *names, None]], "name string").write.parquet(str(tmp_path / "concepts.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # Spark has no superscripts among the characters of words
    has = lambda t, n: re.search(rf"(?i)\b{re.escape(n)}\b".replace("²", "\x01"), t.replace("²", "\x01"))
    want = {(k, n) for k, t in docs if t for n in names if has(t, n) and any(c.isalpha() for c in n)}
    got = [tuple(r) for r in reference.QUERIES["concept_mentions"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert (any(n == "r" for _, n in want)) and len({n for _, n in want}) > 40


def test_descendants_of_circles_and_below(spark):
    rnd = random.Random(9)
    links = [(k, rnd.choice([None, rnd.randrange(60), max(0, k - rnd.randrange(1, 4))])) for k in range(60)]
    links += [(200, 203), (201, 200), (202, 201), (203, 202), (204, 202), (205, 204), (206, 205), (207, 205), (300, 300), (301, 300), (302, 301)]
    parent, want = dict(links), set()
    for k in parent:
        up, seen = parent[k], set()
        while up in parent and up not in seen:
            seen.add(up)
            up = parent[up]
        want |= {(a, k) for a in seen - {k}}
    rows = [tuple(r) for r in all_descendants(hierarchy(spark.createDataFrame(links, "id long, parent long"))).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {(204, 206), (201, 207), (203, 202), (301, 302)} <= want
