import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.hierarchy import all_descendants, clean_number, descendants, hierarchy, number_parents, subtree_sizes
from corpusloom.operators.references import bloom_filter, broken_references, maybe_present, month
from corpusloom.plans import clear, cut, hot_keys, lookup_join

LINK = "id long, parent long"


def brute(links):
    parent = {}
    for i, p in links:
        if i is not None:
            parent[i] = min(x for x in (p, parent.get(i)) if x is not None) if p is not None or parent.get(i) is not None else None
    out = {}
    for i in parent:
        way, at = [i], parent[i]
        while at in parent and at is not None and at not in way:
            way.append(at)
            at = parent[at]
        if at in way:
            ring = way[way.index(at):]
            out[i] = (min(ring), -1, "cycle" if i in ring else "below")
        else:
            out[i] = (way[-1], len(way) - 1, "/".join(map(str, reversed(way))))
    return out


def sizes(links):
    parent = {i: p for i, p in links if i is not None and p is not None}
    out = {i: set() for i, _ in links if i is not None}
    for i in out:
        at, way = i, set()
        while at in out and at not in way:
            way.add(at)
            out[at].add(i)
            at = parent.get(at)
    return {i: len(under - {i}) for i, under in out.items()}


def check(spark, links, *finishes):
    for finish in finishes:  # links left to one task: none, the last few, all
        tree = hierarchy(spark.createDataFrame(links, LINK), finish=finish)
        rows = tree.collect()
        assert {r.id: (r.root_id, r.depth, r.path) for r in rows} == brute(links)
        assert len(rows) == len({r.id for r in rows})
        assert {r.id: r["size"] - 1 for r in rows} == sizes(links)
        under = all_descendants(tree).groupBy("id").count().collect()
        assert {r.id: r["count"] for r in under} == {i: n for i, n in sizes(links).items() if n}


def test_chain_star_and_circles(spark):
    chain = [(k, k - 1 if k else None) for k in range(40)]
    star = [(100 + k, 100 if k else 5) for k in range(30)]
    ring = [(200, 203), (201, 200), (202, 201), (203, 202), (204, 202), (205, 204), (300, 300), (301, 300)]
    check(spark, [*chain, *star, *ring, (400, 999), (401, None), (401, None), (None, 3), (None, None)], 0, 1000)


def test_random_forest_with_circles(spark):
    rnd = random.Random(5)
    check(spark, [(k, rnd.choice([None, 9999, rnd.randrange(150), max(0, k - rnd.randrange(1, 4))])) for k in range(150)], 40)


def test_hierarchy_of_nothing(spark):
    assert hierarchy(spark.createDataFrame([], LINK)).collect() == []


def test_descendants(spark):
    tree = hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 6), (6, 5)], LINK))
    assert {tuple(r) for r in descendants(tree).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)}
    assert {r.id: r.descendants for r in subtree_sizes(tree).collect()} == {1: 3, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1}


def test_numbers_in_many_forms(spark):
    forms = ["1.2", " 1 . 2 ", "§1.2", "§ 1.2", "(1.2)", "Sec. １.２", "1.2.", "1.2:", "Section 1.2", "1..2"]
    got = spark.createDataFrame([(f,) for f in forms], "n string").select(clean_number(F.col("n"))).collect()
    assert {r[0] for r in got} == {"1.2"}
    rest = spark.createDataFrame([("A.１",), ("",), (None,), ("--",), ("B",)], "n string").select(clean_number(F.col("n"))).collect()
    assert [r[0] for r in rest] == ["A.1", None, None, None, "B"]


def test_parents_by_number(spark):
    rows = [(1, 7, None, "1"), (2, 7, None, "§ 1.1"), (3, 7, 1, "9.9"), (4, 8, None, "1.2"), (5, 7, None, None), (6, None, None, "1.1"), (2, 7, None, "§ 1.1")]
    got = number_parents(spark.createDataFrame(rows, "id long, textbook_id long, parent_id long, number string")).collect()
    assert {r.id: r.parent for r in got} == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: None}
    assert len(got) == 6


REF, PARENT = "id long, k long, at timestamp, kind2 string", "id long, deleted_at timestamp, recorded_at timestamp"


def test_broken_references(spark):
    parents = spark.sql("select * from values (1L, null, timestamp'2023-01-02'), (2L, timestamp'2024-01-01', timestamp'2023-01-01'), (3L, null, null), (1L, null, timestamp'2023-01-02') t(id, deleted_at, recorded_at)")
    refs = spark.sql("select * from values (10L, 1L, timestamp'2023-02-01'), (11L, 1L, timestamp'2023-01-01'), (12L, 2L, timestamp'2023-02-01'), (13L, 9L, timestamp'2023-02-03'), (14L, null, timestamp'2023-02-01'), (15L, 3L, null), (16L, -1L, null) t(id, k, at)")
    got = broken_references(refs, parents, "k", "at").withColumn("m", month("at")).collect()
    assert {(r.id, r.kind, r.m) for r in got} == {(11, "late", "2023-01"), (12, "deleted", "2023-02"), (13, "missing", "2023-02"), (16, "missing", None)}


def test_references_without_parents_or_rows(spark):
    parents = spark.createDataFrame([], PARENT)
    refs = spark.sql("select 1L as id, 5L as k, timestamp'2023-01-01' as at")
    assert [r.kind for r in broken_references(refs, parents, "k", "at").collect()] == ["missing"]
    assert broken_references(refs.limit(0), parents, "k", "at").collect() == []


@pytest.mark.parametrize("limit", [64, 1 << 20])
def test_bloom_filter_never_misses(spark, limit):
    keys = spark.range(0, 30000, 3).withColumnRenamed("id", "k")
    rows, words = bloom_filter(keys, "k", 10000, max_bytes=limit)
    assert words * 8 <= limit
    got = maybe_present(spark.range(30000).withColumnRenamed("id", "k"), "k", rows, words).groupBy((F.col("k") % 3 == 0).alias("there")).agg(F.avg(F.col("__maybe").cast("int")).alias("share")).collect()
    share = {r.there: r.share for r in got}
    assert share[True] == 1.0
    assert limit == 64 or share[False] < 0.05


def test_lookup_join_with_a_hot_key(spark):
    big = spark.createDataFrame([(0 if k % 2 else k, k) for k in range(400)] + [(None, -1)], "k long, v long")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 400, 4)], "k long, t string")
    assert [r.k for r in hot_keys(big, "k").collect()] == [0]
    for how in ("left", "inner"):
        assert sorted(map(tuple, lookup_join(big, table, "k", how).collect()), key=str) == sorted(map(tuple, big.join(table, "k", how).collect()), key=str)


def test_cut_and_clear(spark):
    df = cut(spark.range(5))
    assert df.count() == 5
    assert clear(spark) >= 1
