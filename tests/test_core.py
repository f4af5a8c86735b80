import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import classify, numeric, text
from corpusloom.plans import lookup_join
from corpusloom.operators import batch, extract, graph, integrate, lookup, merge, relate, report, resolve
from corpusloom.sources import ingest, sinks
from corpusloom.streaming import stream


def col(spark, values, expr):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string").select("k", expr(F.col("c")).alias("r")).orderBy("k").collect()
    return [r.r for r in rows]


def test_names(spark):
    assert col(spark, ["  Ridge  Regression. ", "ﬁnite–sum", None], text.name_loose) == ["ridge regression", "finite-sum", None]
    assert col(spark, ["Eﬀect  size.."], text.name_strict) == ["Effect size"]
    assert col(spark, ["Algorithm 3.1 Foo", "foo"], text.without_label) == ["Foo", None]
    assert col(spark, ["trees", "bias", "loss"], text.singular) == ["tree", "bias", "loss"]
    assert col(spark, ["arc-length of svd"], lambda c: text.title_case(c, ["svd"], ["of"])) == ["Arc-Length of SVD"]
    assert col(spark, ["1.2.3", "4", None], text.parent_number) == ["1.2", None, None]
    assert col(spark, ["a START b END c", "END START"], lambda c: text.between(c, "START", "END")) == ["START b END", None]
    assert col(spark, ["  x y\t"], text.word_count) == [2]


@pytest.mark.parametrize(
    "line, kind",
    [("", "narrative"), ("Figure 3 x", "figure_caption"), ("TABLE 2", "table_caption"), ("3.2 Shrinkage Methods", "section_header"), ("19 Page Header Text", "narrative"), ("0.4 Some Text", "narrative"),
     ("2 N", "narrative"), ("Definition. A thing", "definition"), ("We define x", "definition"), ("Theorem 3. Foo", "theorem"), ("Lemma", "lemma"), ("Proof. Clear", "proof"), ("Ex. 3. Do", "exercise"), ("12 + 34 = 46", "equation"), ("plain words here", "narrative")],
)
def test_paragraph_types(spark, line, kind):
    assert col(spark, [line], classify.paragraph_type) == [kind]


def test_types_by_size_and_tail(spark):
    df = spark.createDataFrame([("Big Words", 20.0, 1, 100), ("[3] Someone", 9.0, 95, 100), ("[3] Someone", 9.0, 5, 100)], "t string, s double, p int, n int")
    got = [r[0] for r in df.select(classify.paragraph_type(F.col("t"), F.col("s"), F.col("p"), F.col("n"))).collect()]
    assert got == ["section_header", "bibliography", "narrative"]


def test_reject_reasons(spark):
    got = col(spark, ["dictio-", "xx", "ooo", "a spline", "f(x", "x = y now", "ridge", "kernel trick", "Lack of fit", "canonical or not"], classify.reject_reason)
    assert got == ["ends in a hyphen", "too short", "one letter repeated", "starts with an article", "brackets don't match", "formula", None, None, "fragment", "alternative"]
    assert col(spark, ["model", "the fit", "ridge regression", "3-fold"], classify.reject_annotated) == [True, True, False, True]


def test_sections_flow(spark):
    rows = [(1, 0, False, None, None), (1, 1, True, "1", "A"), (1, 2, False, None, None), (1, 3, True, None, "X"), (1, 4, False, None, None), (1, 5, True, "1", "A"), (1, 6, True, None, "X"), (1, 7, False, None, None)]
    df = spark.createDataFrame(rows, "book int, ord int, is_header boolean, number string, title string")
    assert [r.section for r in extract.current_section(df).orderBy("ord").collect()] == [None, "1", "1", None, None, "1", "1", "1"]
    firsts = extract.first_headers(df.where("is_header").select("book", "ord", "number", "title"))
    assert sorted(r.ord for r in firsts.collect()) == [1, 3]


def test_terms(spark):
    got = col(spark, ['Definition: bias. More', 'The "ridge penalty" is', "Definition of the", "Some very long opening line without stop"], extract.defined_term)
    assert got == ["bias", "ridge penalty", None, None]
    df = spark.createDataFrame([(1, "This is called the elastic net. It is also known as mixed penalty, or so."), (2, "It is called the Elastic net; fine")], "id int, text string")
    seen = extract.first_seen(extract.introduced_terms(df), "term", ["id", "pattern_no", "match_no"])
    assert {r.term for r in seen.collect()} == {"elastic net", "mixed penalty"}
    assert col(spark, ["theorem 3.1 (Gauss) holds", "Odd line\nmore"], extract.theorem_name) == ["Theorem 3.1 (Gauss)", "Odd line"]
    spans = spark.sql("select array(named_struct('text','ab','size',9), named_struct('text','cd','size',8), named_struct('text','x','size',10)) s")
    assert spans.select(extract.dominant(F.col("s"), "size")).first()[0] == 9


def test_relations(spark):
    rows = [("ridge regression", 1, "1", "x"), ("lasso (l1)", 2, "1", "A special case of ridge regression, unlike lasso (l1)"), ("elastic net", 3, "1.1", "using ridge regression and more")]
    c = spark.createDataFrame(rows, "name string, ord int, section string, description string")
    edges = relate.ordered_prerequisites(c).unionByName(relate.section_generalisations(c)).unionByName(relate.cue_relations(c))
    got = {(r.source, r.target, r.relation): r.confidence for r in relate.best_edges(edges).collect()}
    assert got[("ridge regression", "lasso (l1)", "prerequisite")] == 0.7
    assert got[("ridge regression", "lasso (l1)", "generalizes")] == 0.9
    assert got[("ridge regression", "elastic net", "generalizes")] == 0.5
    assert got[("ridge regression", "elastic net", "prerequisite")] == 0.8


def test_lookups(spark):
    s = spark.createDataFrame([(1, 1, None, 5, None), (2, 1, None, 5, None), (3, 1, None, 9, None), (4, 1, None, None, None), (5, 1, 3, 2, 4)], "id int, book int, parent int, page_start int, page_end int")
    assert {r.id: r.range_end for r in lookup.sibling_ends(s).collect()} == {1: 8, 2: 8, 3: 29, 4: None, 5: 4}
    q = spark.createDataFrame([("one two three four five six",), ("short",)], "q string")
    t = spark.createDataFrame([(5, "zero one two three four five six seven"), (3, "none")], "o int, t string")
    assert [tuple(r) for r in lookup.quote_home(q, t, "q", "t", "o").collect()] == [("one two three four five six", 5)]


def test_merges(spark):
    u = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (2, "b", "x", 3), (3, "a", "z", 4), (4, None, None, 5)], "id int, c string, s string, o int")
    st = merge.allowed(u, [("a", "x"), ("a", "y")], "c", "s")
    assert {(r.status, r.n) for r in merge.report(st).collect()} == {("ok", 2), ("invalid_category", 2), ("invalid_pair", 1)}
    last = merge.last_valid(st, "id", "o")
    base = spark.createDataFrame([(1, "q", "q"), (9, "q", "q")], "id int, c string, s string")
    assert {tuple(r) for r in merge.overlay(base, last, "id", ["c", "s"]).collect()} == {(1, "a", "y"), (9, "q", "q")}


def test_resolution(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 6), (9, 8), (8, 7), (7, 3)], "a long, b long")
    got = {r.id: r.component for r in resolve.components(links, spark.range(1, 12)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4, 6: 6, 10: 10, 11: 11}
    assert resolve.components(links.limit(0), spark.range(2)).count() == 2
    n = spark.createDataFrame([("ridge",), ("bridge",), ("ridge regression model",), ("net",)], "n string")
    assert {tuple(r) for r in resolve.contained(n).collect()} == {("ridge", "bridge"), ("ridge", "ridge regression model")}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, "p"), (2, 3, "p"), (3, 1, "p"), (4, 3, "q"), (5, 2, "p"), (5, 1, "p")], "src long, dst long, type string")
    start = spark.range(3, 4)
    got = {r.id: (r.depth, r.via) for r in graph.trace(e, start, ["p"]).collect()}
    assert got == {2: (1, 3), 1: (2, 2), 5: (2, 2)}
    assert {r.id for r in graph.frontier(graph.trace(e, start, ["p"]), e, ["p"]).collect()} == {5}
    assert {r.id: r.degree for r in graph.degrees(spark.range(1, 7), e).collect()}[6] == 0


def test_positions_over_many_partitions(spark, tmp_path):
    rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.concat(F.lit("x" * 40), F.col("id").cast("string")).alias("wide"), (F.col("id") % 3).alias("few"))
    rows.repartition(64).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for order in (["k"], ["few"]):  # a key that a third of the rows share too
        got = batch.numbered(df, order)
        n, distinct, top = got.agg(F.count(F.lit(1)), F.countDistinct("position"), F.max("position")).first()
        assert n == distinct == top == 1_000_000
    w = got.agg(F.max(F.when(F.col("few") == 0, F.col("position"))), F.min(F.when(F.col("few") == 1, F.col("position")))).first()
    assert w[1] == w[0] + 1
    assert batch.numbered(df.limit(0), ["k"]).count() == 0


def test_batches(spark):
    got = batch.fixed(spark.range(10).repartition(3), ["id"], 4).orderBy("id").collect()
    assert [r.batch for r in got] == [1] * 4 + [2] * 4 + [3] * 2
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    assert {r.batch for r in batch.by_group(df, "g", 5).collect()} == {1, 2, 3}


def test_numeric(spark):
    rnd = np.random.RandomState(0)
    x = rnd.randn(50, 3)
    y = x @ np.array([2.0, 0.0, -1.0]) + 0.1 * rnd.randn(50)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    gram, cross, total, n = numeric.moments(df, ["a", "b", "c"], "y")
    assert np.allclose(gram, (x - x.mean(0)).T @ (x - x.mean(0))) and n == 50
    assert np.allclose(numeric.lasso(gram, cross, [0.0])[0], np.linalg.solve(gram, cross), atol=1e-6)
    assert [m for _, m, _ in numeric.best_subsets(gram, cross, total)][2] == 0b101
    assert np.allclose(numeric.stagewise(gram, cross, 0.01, 5000)[-1], np.linalg.solve(gram, cross), atol=0.02)
    z = spark.range(20000).select(numeric.hashed_normal(F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03


def test_sources_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\n\n b \n"), (2, None), (3, "")], "doc_id int, text string")
    assert [tuple(r) for r in ingest.lines(docs).collect()] == [(1, 0, "a"), (1, 1, "b")]
    nodes, edges = spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(1, 1)], "source int, target int")
    sinks.graph_file(nodes, edges, str(tmp_path / "g"))
    back = ingest.graph_file(spark, str(tmp_path / "g"), "nodes array<struct<data:struct<id:int,name:string>>>, edges array<struct<data:struct<source:int,target:int>>>").first()
    assert back.nodes[0].data.name == "x" and back.edges[0].data.target == 1
    t = spark.createDataFrame([("f", 1, "no json"), ("f", 2, '{"message":{"content":[{"type":"text","text":"```json\\n[1]\\n```"}]}}'), ("f", 3, '{"message":{"content":[{"type":"tool_use","name":"w","input":{"content":"[2]"}}]}}')], "file string, n int, line string")
    assert ingest.transcript_payload(t, "file", "n", "line").first().payload == "[2]"
    b = spark.createDataFrame([(1, k, x) for k, x in enumerate(["G", "T", "# c", "i1 # n", "i2", "", "H", "U"])], "doc_id int, line_no int, text string")
    assert [(r.group, r.topic, r.item, r.note) for r in ingest.blocks(b).orderBy("item").collect()] == [("G", "T", "i1", "n"), ("G", "T", "i2", None)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Figure 1 x\nwords")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    q = stream.classified(spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("typed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.type for r in spark.sql("select * from typed").collect()) == ["figure_caption", "narrative"]


def test_lookup_join_of_null_and_hot_keys(spark):
    big = spark.createDataFrame([(k, None if k % 3 == 0 else 1 if k % 3 == 1 else k) for k in range(900)], "id long, k long")
    table = spark.createDataFrame([(1, "hot"), (5, "cold"), (None, "never")], "k long, v string")
    got = {r.id: r.v for r in lookup_join(big, table, "k").collect()}
    assert len(got) == 900 and sum(v == "hot" for v in got.values()) == 300 and got[5] == "cold" and got[0] is None
    assert lookup_join(big, table, "k", "inner").count() == 301
    with pytest.raises(Exception, match="not unique"):
        lookup_join(big, table.unionByName(table), "k").collect()


def test_resolution_with_a_hot_key_and_a_chain(spark):
    rows = [(k, "same", f"u{k}") for k in range(300)] + [(1000 + k, f"a{k}", f"a{k + 1}") for k in range(6)] + [(5000, None, "")]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    links = resolve.key_links(df, {"x": F.col("x"), "y": F.col("y")})
    got = {r.id: r.component for r in resolve.components(links, df.select("id")).collect()}
    assert {got[k] for k in range(300)} == {0} and got[5000] == 5000 and len(got) == 307
    both = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (7, 8)], "a long, b long")
    assert {r.id: r.component for r in resolve.components(both).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7}


def test_integration(spark):
    known = spark.createDataFrame([(3, "Ridge", "x"), (9, None, None)], "id long, name string, description string")
    found = spark.createDataFrame([(1, "ridge ", "longer one"), (2, "Lasso path", "a"), (3, "lasso path", "ab"), (4, "model", "too general"), (5, None, "x")], "ord long, name string, description string")
    got = {tuple(r) for r in integrate.new_concepts(known, found).collect()}
    assert got == {(3, "Ridge", "x"), (9, None, None), (10, "lasso path", "ab")}
    edges = spark.createDataFrame([(1, "Ridge", "lasso path", "equivalent_to"), (2, " ridge", "Lasso path", "USES"), (3, "ridge", "nobody", "uses"), (4, None, "ridge", "uses"), (5, "ridge", "ridge", "uses"), (6, "ridge", "lasso path", "odd")], "ord long, source string, target string, relation string")
    status = {r.ord: r.status for r in integrate.relation_statuses(integrate.new_concepts(known, found), edges).collect()}
    assert status == {1: "ok", 2: "duplicate", 3: "unknown_target", 4: "unknown_source", 5: "self", 6: "bad_type"}


def test_interpolation_and_norms(spark):
    knots = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 5.0)], "g string, x double, y double")
    at = spark.createDataFrame([("a", -1.0), ("a", 0.5), ("a", 2.0), ("a", 3.0), ("b", 1.0)], "g string, x double")
    assert {(r.g, r.x): r.y for r in numeric.interpolate(knots, at, ["g"], "x", "y").collect()} == {("a", -1.0): 1.0, ("a", 0.5): 2.0, ("a", 2.0): 5.0, ("a", 3.0): 5.0, ("b", 1.0): None}
    cells = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0)], "i int, j int, v double")
    assert tuple(numeric.deviation(cells, cells.limit(0), ["i", "j"]).first()) == (5.0, 4.0)


def test_quotes_of_few_words(spark):
    quotes = spark.createDataFrame([(1, "of the supercalifragilistic kind of the"), (2, "supercalifragilisticexpiali docious"), (3, "short"), (4, None)], "id long, q string")
    texts = spark.createDataFrame([(10, "in xof the supercalifragilistic kind of the end"), (11, "a supercalifragilisticexpiali docious word"), (12, None)], "p long, t string")
    assert {r.id: r.home for r in lookup.quote_home(quotes, texts, "q", "t", "p").collect()} == {1: 10, 2: 11}
