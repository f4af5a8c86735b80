"""Queries that take results over, resolve entities, walk graphs and evaluate kernels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import numeric, text
from corpusloom.operators import batch, graph, integrate, lookup, merge, relate, resolve
from corpusloom.operators.hierarchy import hierarchy, number_parents
from corpusloom.queries import integrity
from corpusloom.queries.reference import _BLANKS, T, relation_graph

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Words that concepts are looked for by; kinds of text in which they are looked for.
ASKED = ["regression", "variance", "kernel", "posterior", "margin"]
KINDS = ["narrative", "equation"]


@query(f"""WITH p AS (SELECT DISTINCT id, text FROM paragraphs WHERE paragraph_type IN ('narrative', 'equation') AND text IS NOT NULL), n AS (SELECT unnest({ASKED}) AS name)
SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) r FROM p JOIN n ON contains(lower(text), name)) WHERE r <= 20""")
def context_by_name(s, d):
    p = T(s, d, "paragraphs").where(F.col("paragraph_type").isin(KINDS)).select("id", "text").distinct()
    return lookup.containing(p, ASKED, "text", ["id"], 20).select("name", "id")


@query("""WITH f AS (SELECT DISTINCT concept_id, paragraph_id FROM concept_facts WHERE paragraph_id IS NOT NULL), p AS (SELECT DISTINCT id, page_id FROM paragraphs) SELECT concept_id, count(*)::bigint paragraphs, count(DISTINCT page_id)::bigint pages FROM f JOIN p ON p.id = f.paragraph_id GROUP BY 1""")
def concept_paragraphs(s, d):
    links = T(s, d, "concept_facts").select("concept_id", "paragraph_id").where("paragraph_id is not null").distinct()
    p = T(s, d, "paragraphs").select(F.col("id").alias("paragraph_id"), "page_id").distinct()
    return links.join(p, "paragraph_id").groupBy("concept_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.countDistinct("page_id").alias("pages"))


@query("""WITH s AS (SELECT DISTINCT id, textbook_id, number FROM sections WHERE number IS NOT NULL), k AS (SELECT *, list_transform(string_split(number, '.'), lambda x: coalesce(try_cast(x AS bigint), -1)) key FROM s)
SELECT id, row_number() OVER (PARTITION BY textbook_id ORDER BY key, number, id) place, row_number() OVER (PARTITION BY textbook_id ORDER BY number, id) as_text FROM k""")
def section_natural_order(s, d):
    from pyspark.sql import Window

    r = T(s, d, "sections").select("id", "textbook_id", "number").where("number is not null").distinct().withColumn("key", text.natural_key(F.col("number")))
    w = Window.partitionBy("textbook_id")  # the sections of a book, which a reader holds at once
    return r.select("id", F.row_number().over(w.orderBy("key", "number", "id")).alias("place"), F.row_number().over(w.orderBy("number", "id")).alias("as_text"))


@query("SELECT DISTINCT id, confidence FROM concept_relationships WHERE confidence IS NOT NULL ORDER BY confidence DESC, id LIMIT 50")
def most_confident(s, d):
    return T(s, d, "concept_relationships").select("id", "confidence").where("confidence is not null").distinct().orderBy(F.desc("confidence"), "id").limit(50)


@query(integrity._TREE + "SELECT s.textbook_id, max(t.depth)::int deepest, count(*)::bigint sections FROM t JOIN s USING (id) GROUP BY 1")
def deepest_sections(s, d):
    tree = hierarchy(number_parents(T(s, d, "sections"))).where("status = 'tree'").select("id", "depth")
    books = T(s, d, "sections").groupBy("id").agg(F.min("textbook_id").alias("textbook_id"))
    return tree.join(books, "id").groupBy("textbook_id").agg(F.max("depth").cast("int").alias("deepest"), F.count(F.lit(1)).alias("sections"))


_REACH = """WITH RECURSIVE e AS (SELECT DISTINCT source_id a, target_id b FROM concept_relationships WHERE relationship_type IN ('prerequisite', 'uses', 'special_case_of') AND source_id IS NOT NULL AND target_id IS NOT NULL),
t AS (SELECT 1::bigint id, 0 depth UNION SELECT e.a, depth + 1 FROM e JOIN t ON e.b = t.id WHERE depth < 4), r AS (SELECT id, min(depth)::int depth FROM t GROUP BY 1 HAVING id <> 1)"""


@query(_REACH + " SELECT id, depth FROM r")
def trace_depths(s, d):
    return graph.trace(relation_graph(s, d), s.range(1, 2), ["prerequisite", "uses", "special_case_of"], 4).select("id", "depth")


@query(_REACH + ", g AS (SELECT id, any_value(category) grp FROM (SELECT DISTINCT id, category FROM concepts) GROUP BY id) SELECT grp, count(*)::bigint n, min(depth)::int least, max(depth)::int deepest FROM r LEFT JOIN g USING (id) GROUP BY 1")
def trace_by_group(s, d):
    t = graph.trace(relation_graph(s, d), s.range(1, 2), ["prerequisite", "uses", "special_case_of"], 4)
    return graph.by_group(t, T(s, d, "concepts").groupBy("id").agg(F.first("category").alias("grp")))


@query("""WITH e AS (SELECT source_id id FROM concept_relationships WHERE target_id IS NOT NULL UNION SELECT target_id FROM concept_relationships WHERE source_id IS NOT NULL) SELECT category grp, count(*)::bigint n FROM (SELECT DISTINCT id, category FROM concepts) WHERE category IS NOT NULL AND id IN (SELECT id FROM e) GROUP BY 1""")
def group_nodes(s, d):
    return graph.group_nodes(T(s, d, "concepts").select("id", F.col("category").alias("grp")).distinct(), relation_graph(s, d))


@query("""SELECT (SELECT count(DISTINCT id) FROM concepts)::bigint nodes, (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id, relationship_type FROM concept_relationships WHERE source_id IS NOT NULL AND target_id IS NOT NULL))::bigint edges""")
def graph_sizes(s, d):
    return graph.sizes(T(s, d, "concepts").select("id").distinct(), relation_graph(s, d))


@query("""SELECT id, ((k - 1) % 8 * 100)::int x, ((k - 1) // 8 * 100)::bigint y FROM (SELECT id, row_number() OVER (PARTITION BY category ORDER BY id) k FROM (SELECT DISTINCT id, category FROM concepts))""")
def graph_grid(s, d):
    return graph.grid(T(s, d, "concepts").select("id", "category").distinct(), "category", ["id"]).select("id", F.col("x").cast("int").alias("x"), "y")


_GROUPS = """c AS (SELECT id, any_value(name) AS name, any_value(description) description, any_value(category) category, any_value(section_id) section_id FROM concepts WHERE name IS NOT NULL GROUP BY id),
g AS (SELECT *, min(id) OVER (PARTITION BY lower(name)) component FROM c)"""
_SCORE = "round(length(coalesce(description, '')) + CASE WHEN regexp_matches(name, '^Algorithm\\s+\\d') THEN -1000 ELSE 0 END + CASE WHEN regexp_matches(name, '^[a-z]') THEN 50 ELSE 0 END - 0.1 * length(name) + CASE WHEN section_id IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN category IS NOT NULL THEN 10 ELSE 0 END, 6)"


def _resolved(s, d):
    c = T(s, d, "concepts").where("name is not null").select("id", "name", "description", "category", "section_id").distinct()
    g = resolve.components(resolve.key_links(c, {"name": F.lower("name")}), c.select("id"))
    return c, g, F.round(resolve.score(F.col("name"), F.col("description"), F.col("section_id"), F.col("category")), 6)


@query(f"WITH {_GROUPS}, r AS (SELECT *, {_SCORE} s FROM g) SELECT component, arg_max(id, struct_pack(s := s, i := -id)) canonical FROM r GROUP BY 1")
def canonical_by_score(s, d):
    c, g, points = _resolved(s, d)
    return resolve.canonical(c, g, points)


@query(f"""WITH {_GROUPS}, r AS (SELECT *, {_SCORE} s FROM g) SELECT component, arg_max(description, struct_pack(l := length(description), s := s, i := -id)) FILTER (description IS NOT NULL) description,
  arg_max(category, struct_pack(s := s, i := -id)) FILTER (category IS NOT NULL) category, arg_max(section_id, struct_pack(s := s, i := -id)) FILTER (section_id IS NOT NULL) section_id FROM r GROUP BY 1""")
def merged_attributes(s, d):
    c, g, points = _resolved(s, d)
    return resolve.merged(c, g, -points, "description", ["category", "section_id"])


@query(f"""WITH {_GROUPS}, k AS (SELECT id, description, lower(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(name, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '{_BLANKS}', ' ', 'g')), '\\.+$', '')) key FROM c)
SELECT key, arg_max(id, struct_pack(l := length(coalesce(description, '')), i := -id)) keeper, count(*)::bigint n FROM k WHERE NOT regexp_matches(key, '[^ -~]') GROUP BY 1""")
def conservative_groups(s, d):
    c, _, _ = _resolved(s, d)
    k = c.select("id", "description", F.lower(text.name_strict(F.col("name"))).alias("key")).where(~F.col("key").rlike("[^ -~]"))
    return k.groupBy("key").agg(F.max_by("id", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("id"))).alias("keeper"), F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT DISTINCT id, name, description FROM concepts) SELECT id, length(name) <= 2 AS short, coalesce(description, '') = '' AS bare FROM c WHERE length(name) <= 2 OR coalesce(description, '') = ''""")
def suspicious_records(s, d):
    c = T(s, d, "concepts").select("id", "name", "description").distinct()
    why = resolve.suspicious(F.col("name"), F.col("description"), ("error", "model", "data"))
    c = c.withColumn("why", why).where("size(why) > 0 and not (size(why) = 1 and why[0] = 'general')")
    return c.select("id", F.when(F.col("name").isNotNull(), F.array_contains("why", "short")).alias("short"), F.array_contains("why", "no description").alias("bare"))


@query("""WITH k AS (SELECT DISTINCT id, name FROM concepts WHERE source IN ('curator', 'errata_team')), f AS (SELECT DISTINCT id, name FROM concepts WHERE source NOT IN ('curator', 'errata_team') AND name IS NOT NULL),
n AS (SELECT lower(name) key, min(id) id FROM f GROUP BY 1) SELECT id FROM k UNION ALL SELECT id FROM n WHERE key NOT IN (SELECT lower(name) FROM k WHERE name IS NOT NULL)""")
def insert_new_names(s, d):
    c = T(s, d, "concepts").select("id", "name", "source").distinct()
    own = c.source.isin("curator", "errata_team")
    return merge.insert_new(c.where(own), c.where(~own & F.col("name").isNotNull()), F.lower("name"), "id").select("id")


@query(f"""WITH r AS (SELECT DISTINCT id, source_id, target_id, CASE WHEN relationship_type = 'example_of' THEN 'equivalent_to' WHEN relationship_type = 'proved_by' THEN 'odd' ELSE relationship_type END kind FROM concept_relationships),
n AS (SELECT id, lower(regexp_replace(min(name), '^{_BLANKS}|{_BLANKS}$', '', 'g')) k FROM concepts WHERE name IS NOT NULL GROUP BY id), m AS (SELECT k, min(id) id FROM n GROUP BY k),
x AS (SELECT r.id, CASE WHEN kind = 'equivalent_to' THEN 'uses' ELSE kind END kind, ms.id s, mt.id t FROM r LEFT JOIN n a ON a.id = source_id LEFT JOIN m ms ON ms.k = a.k LEFT JOIN n b ON b.id = target_id LEFT JOIN m mt ON mt.k = b.k),
f AS (SELECT *, row_number() OVER (PARTITION BY s, t, kind ORDER BY id) i FROM x)
SELECT CASE WHEN kind = 'odd' OR kind IS NULL THEN 'bad_type' WHEN s IS NULL THEN 'unknown_source' WHEN t IS NULL THEN 'unknown_target' WHEN s = t THEN 'self' WHEN i > 1 THEN 'duplicate' ELSE 'ok' END status, count(*)::bigint n FROM f GROUP BY 1""")
def integrate_relations(s, d):
    names = T(s, d, "concepts").where("name is not null").groupBy("id").agg(F.min("name").alias("name"))
    kind = F.when(F.col("relationship_type") == "example_of", "equivalent_to").when(F.col("relationship_type") == "proved_by", "odd").otherwise(F.col("relationship_type"))
    r = T(s, d, "concept_relationships").select("id", "source_id", "target_id", kind.alias("relation")).distinct()
    for end in ("source", "target"):
        r = r.join(names.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(end)), f"{end}_id", "left")
    return merge.report(integrate.relation_statuses(names, r.select(F.col("id").alias("ord"), "source", "target", "relation")))


@query("""WITH c AS (SELECT id, min(section_id) own, min(source) batch FROM concepts GROUP BY id), v AS (SELECT c.id, CASE WHEN own IN (SELECT id FROM sections) THEN own END section, batch FROM c),
h AS (SELECT concept_id id, min(page_number) page FROM concept_facts WHERE concept_id IN (SELECT id FROM c) GROUP BY 1), q AS (SELECT h.id, (SELECT arg_max(s.id, struct_pack(p := s.page_start, i := s.id)) FROM sections s WHERE s.page_start <= h.page) by_quote FROM h WHERE page IS NOT NULL),
m AS (SELECT batch, section, row_number() OVER (PARTITION BY batch ORDER BY count(*) DESC, section) r FROM v WHERE section IS NOT NULL AND batch IS NOT NULL GROUP BY 1, 2)
SELECT v.id, coalesce(v.section, by_quote, m.section) section, CASE WHEN v.section IS NOT NULL THEN 'kept' WHEN by_quote IS NOT NULL THEN 'quote' WHEN m.section IS NOT NULL THEN 'batch' ELSE 'none' END how FROM v LEFT JOIN q USING (id) LEFT JOIN m ON m.batch = v.batch AND r = 1""")
def assign_sections(s, d):
    real = T(s, d, "sections").select(F.col("id").alias("section_id")).distinct()
    c = T(s, d, "concepts").groupBy("id").agg(F.min("section_id").alias("section_id"), F.min("source").alias("batch"))
    c = c.join(real.withColumn("ok", F.lit(True)), "section_id", "left").select("id", F.when(F.col("ok"), F.col("section_id")).alias("section"), "batch")
    homes = T(s, d, "concept_facts").select(F.col("concept_id").alias("id"), F.col("page_number").alias("page")).where("id is not null and page is not null")
    return integrate.chapters(c, T(s, d, "sections").select(F.col("id").alias("section"), "page_start").distinct(), homes)


@query("""WITH g AS (SELECT DISTINCT id FROM concepts WHERE deleted_at IS NOT NULL) SELECT 'concepts' AS part, count(DISTINCT id)::bigint n FROM concepts WHERE id NOT IN (FROM g)
UNION ALL SELECT 'edges', count(DISTINCT id) FROM concept_relationships WHERE coalesce(source_id NOT IN (FROM g), true) AND coalesce(target_id NOT IN (FROM g), true)
UNION ALL SELECT 'facts', count(DISTINCT id) FROM concept_facts WHERE coalesce(concept_id NOT IN (FROM g), true)""")
def delete_with_cascade(s, d):
    c, e, f = (T(s, d, t) for t in ("concepts", "concept_relationships", "concept_facts"))
    kept = integrate.remove(c.select("id").distinct(), e.select("id", "source_id", "target_id"), f.select("id", "concept_id"), c.where("deleted_at is not null").select("id"))
    parts = [df.select(F.lit(name).alias("part"), "id").groupBy("part").agg(F.countDistinct("id").alias("n")) for name, df in zip(("concepts", "edges", "facts"), kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT DISTINCT id, CASE WHEN contains(lower(name), 'test') THEN 'test' ELSE coalesce(new_category, category) END category FROM concepts""")
def reclassify(s, d):
    c = T(s, d, "concepts").select("id", "name", "category", "new_category").distinct()
    return integrate.patch(c, {"category": F.when(F.contains(F.lower("name"), F.lit("test")), F.lit("test")).otherwise(F.col("new_category"))}).select("id", "category").distinct()


@query("""WITH p AS (SELECT DISTINCT id, file_path FROM textbooks WHERE id % 2 = 0), n AS (SELECT DISTINCT id, file_path FROM textbooks) SELECT id FROM p UNION ALL SELECT min(id) FROM n WHERE file_path NOT IN (SELECT file_path FROM p) GROUP BY file_path""")
def add_books_once(s, d):
    b = T(s, d, "textbooks").select("id", "file_path").distinct()
    return merge.insert_new(b.where("id % 2 = 0"), b, "file_path", "id").select("id")


@query("""WITH l AS (SELECT DISTINCT concept_id, paragraph_id FROM concept_facts WHERE source = 'curator' AND concept_id IS NOT NULL AND paragraph_id IS NOT NULL), r AS (SELECT DISTINCT concept_id, paragraph_id FROM concept_facts)
SELECT * FROM l UNION SELECT * FROM r WHERE concept_id IN (SELECT id FROM concepts) AND paragraph_id IN (SELECT id FROM paragraphs)""")
def link_missing(s, d):
    f = T(s, d, "concept_facts").select("concept_id", "paragraph_id", "source")
    links = f.where("source = 'curator' and concept_id is not null and paragraph_id is not null").select("concept_id", "paragraph_id").distinct()
    return merge.link_new(links, f.drop("source"), T(s, d, "concepts").select("id"), T(s, d, "paragraphs").select("id"))


@query("""WITH o AS (SELECT DISTINCT concept_id FROM concept_facts WHERE source IN ('curator', 'pdf_layer') AND concept_id IS NOT NULL), u AS (SELECT DISTINCT concept_id, id, trim(fact_text) fact_text, fact_type, importance_rank FROM concept_facts WHERE source NOT IN ('curator', 'pdf_layer') AND concept_id IS NOT NULL)
SELECT concept_id, fact_text, CASE WHEN fact_type IN ('definition', 'formula') THEN fact_type ELSE 'property' END fact_type, coalesce(importance_rank, 99)::int importance_rank FROM u WHERE concept_id IN (SELECT id FROM concepts) AND concept_id NOT IN (FROM o) AND length(fact_text) >= 10""")
def apply_new_facts(s, d):
    f = T(s, d, "concept_facts").where("concept_id is not null")
    own = F.col("source").isin("curator", "pdf_layer")
    one = F.struct("fact_text", "fact_type", "importance_rank")
    updates = f.where(~own).select("concept_id", "id", F.array(one).alias("facts")).distinct().drop("id")
    return merge.apply_facts(T(s, d, "concepts").select("id").distinct(), f.where(own), updates, ["definition", "formula"])


@query("""WITH c AS (SELECT DISTINCT id, quote, formula FROM concepts), u AS (SELECT id, any_value(formula) q FROM c WHERE id % 3 = 0 GROUP BY id) SELECT c.id, CASE WHEN u.id IS NOT NULL THEN u.q ELSE c.quote END quote FROM c LEFT JOIN u USING (id)""")
def overwrite_quotes(s, d):
    c = T(s, d, "concepts").select("id", "quote", "formula").distinct()
    updates = c.where("id % 3 = 0").groupBy("id").agg(F.first("formula").alias("quote"))
    return merge.overlay(c, updates, "id", ["quote"], nulls_too=True).select("id", "quote")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) p FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))
SELECT ((p - 1) // 5000 + 1)::bigint batch, 'ids ' || min(l_orderkey) || '-' || max(l_orderkey) AS label, count(*)::bigint n FROM b GROUP BY 1""")
def batch_summary(s, d):
    rows = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return batch.summary(batch.fixed(rows, ["l_orderkey", "l_linenumber", "l_partkey"], 5000), "l_orderkey")


@query("""WITH c AS (SELECT DISTINCT id, section_id, lower(regexp_extract(name, '([A-Za-z]+)[^A-Za-z]*$', 1)) term, description FROM concepts WHERE deleted_at IS NULL AND description IS NOT NULL AND section_id IS NOT NULL)
SELECT a.term source, b.term target, count(*)::bigint n FROM c a JOIN c b ON a.section_id = b.section_id AND a.id < b.id AND length(a.term) >= 4 AND regexp_matches(b.description, '(?i)(^|[^\\p{L}\\p{N}_])' || a.term || '([^\\p{L}\\p{N}_]|$)') GROUP BY 1, 2""")
def ordered_prerequisites(s, d):
    term = F.lower(F.regexp_extract("name", "([A-Za-z]+)[^A-Za-z]*$", 1))
    c = T(s, d, "concepts").where("deleted_at is null and description is not null and section_id is not null").select(F.col("id").alias("ord"), term.alias("name"), F.col("section_id").alias("section"), "description").distinct()
    return relate.ordered_prerequisites(c).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT id, any_value(number) num FROM sections WHERE number IS NOT NULL GROUP BY id), c AS (SELECT DISTINCT c.id, num, lower(regexp_extract(name, '([A-Za-z]+)[^A-Za-z]*$', 1)) term, description FROM concepts c JOIN n ON n.id = c.section_id WHERE deleted_at IS NULL AND description IS NOT NULL)
SELECT a.term source, b.term target, count(*)::bigint n FROM c a JOIN c b ON contains(b.num, '.') AND a.num = regexp_replace(b.num, '\\.[^.]*$', '') AND length(a.term) >= 4 AND regexp_matches(b.description, '(?i)(^|[^\\p{L}\\p{N}_])' || a.term || '([^\\p{L}\\p{N}_]|$)') GROUP BY 1, 2""")
def section_generalisations(s, d):
    term = F.lower(F.regexp_extract("name", "([A-Za-z]+)[^A-Za-z]*$", 1))
    n = T(s, d, "sections").where("number is not null").groupBy(F.col("id").alias("section_id")).agg(F.first("number").alias("section"))
    c = T(s, d, "concepts").where("deleted_at is null and description is not null").join(n, "section_id").select(F.col("id").alias("ord"), term.alias("name"), "section", "description").distinct()
    return relate.section_generalisations(c).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


_GRID = "SELECT g.i / 20.0 lam, b.j / 10.0 beta FROM range(0, 41) g(i), range(-20, 21) b(j)"


@query(f"""WITH x AS ({_GRID}) SELECT round(sum(CASE WHEN abs(beta) > lam THEN sign(beta) * greatest(abs(beta) - lam * 0.5, 0) ELSE 0 END), 6) relaxed, round(sum(sign(beta) * greatest(abs(beta) - lam / (abs(beta) + 0.1), 0)), 6) adaptive,
round(sum(CASE WHEN abs(beta) > 0 THEN greatest(1 - lam / abs(beta), 0) ELSE 0 END), 6) shrunk, round(sum(beta * beta / (beta * beta + 0.2 * (1 - beta * beta))), 6) curds, sum(CASE WHEN abs(beta) < 1 THEN 1 ELSE 0 END)::bigint kept,
round(min((lam - 1) ** 2 + 0.5 * (beta - lam) ** 2 + 0.3 * abs(beta)), 6) low FROM x""")
def kernel_grid(s, d):
    g = s.range(41).select((F.col("id") / 20.0).alias("lam")).withColumn("beta", F.explode(F.transform(F.sequence(F.lit(-20), F.lit(20)), lambda j: j / 10.0)))
    b, lam = F.col("beta"), F.col("lam")
    return g.agg(
        F.round(F.sum(F.when(F.abs(b) > lam, numeric.soft(b, lam * 0.5)).otherwise(0.0)), 6).alias("relaxed"), F.round(F.sum(numeric.soft(b, lam / (F.abs(b) + 0.1))), 6).alias("adaptive"),
        F.round(F.sum(numeric.group_shrink(F.abs(b), lam)), 6).alias("shrunk"), F.round(F.sum(numeric.cw_shrink(b * b, 0.2, 1.0)), 6).alias("curds"), F.sum(numeric.keep_top(F.abs(b), 1)).cast("long").alias("kept"),
        F.round(F.min((lam - 1) ** 2 + 0.5 * (b - lam) ** 2 + 0.3 * F.abs(b)), 6).alias("low"),
    )


@query("""WITH k AS (SELECT i k FROM range(1, 31) t(i)), c AS (SELECT k, 1.0 / (k * k) bias2, k / 60.0 var FROM k) SELECT k::bigint k, round(bias2, 9) bias2, round(var, 9) AS var, round(bias2 + var, 9) mse, k = (SELECT arg_min(k, struct_pack(m := round(bias2 + var, 9), k := k)) FROM c) AS best FROM c""")
def bias_variance_curve(s, d):
    c = s.range(1, 31).select(F.col("id").alias("k"))
    c = c.select("k", F.round(1.0 / (F.col("k") * F.col("k")), 9).alias("bias2"), F.round(F.col("k") / 60.0, 9).alias("var"), F.round(numeric.mse(1.0 / (F.col("k") * F.col("k")), F.col("k") / 60.0), 9).alias("mse"))
    best = c.agg(numeric.argmin("k", "mse").alias("at"))
    return c.join(F.broadcast(best), F.lit(True)).select("k", "bias2", "var", "mse", (F.col("k") == F.col("at")).alias("best"))


@query("""WITH m AS (SELECT l_returnflag g, count(*) n, var_pop(l_quantity) a, var_pop(l_tax) b, covar_pop(l_quantity, l_tax) c, regr_r2(l_extendedprice, l_quantity) r2, regr_syy(l_extendedprice, l_quantity) syy FROM lineitem GROUP BY 1)
SELECT g l_returnflag, round((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c), 6) major, round((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c), 8) minor, round(sqrt(1 / (1 - (c * c) / (a * b))), 6) inflation, round(r2 / (1 - r2) * (n - 2), 2) f FROM m""")
def covariance_ellipse(s, d):
    r2 = F.regr_r2("l_extendedprice", "l_quantity")
    g = T(s, d, "lineitem").groupBy("l_returnflag").agg(numeric.ellipse("l_quantity", "l_tax").alias("e"), F.sqrt(numeric.vif("l_quantity", "l_tax")).alias("inflation"), r2.alias("r2"), F.count(F.lit(1)).alias("n"))
    f = numeric.f_nested(F.lit(1.0), 1 - F.col("r2"), 0, 1, F.col("n") * F.lit(1.0))
    return g.select("l_returnflag", F.round("e.major", 6).alias("major"), F.round("e.minor", 8).alias("minor"), F.round("inflation", 6).alias("inflation"), F.round(f, 2).alias("f"))


_CELLS = """a AS (SELECT user_id i, hour(ts) % 6 k, sum(value) v FROM events GROUP BY 1, 2), b AS (SELECT hour(ts) % 6 k, event_type j, sum(value) v FROM events GROUP BY 1, 2)"""


@query(f"""WITH {_CELLS} SELECT i, j, round(sum(CASE WHEN a.k < 3 THEN a.v * b.v ELSE 0 END), 0) low, round(sum(a.v * b.v), 0) whole FROM a JOIN b USING (k) GROUP BY 1, 2""")
def low_rank_product(s, d):
    e = T(s, d, "events").withColumn("k", F.hour("ts") % 6)
    a = e.groupBy(F.col("user_id").alias("i"), "k").agg(F.sum("value").alias("v"))
    b = e.groupBy("k", F.col("event_type").alias("j")).agg(F.sum("value").alias("v"))
    both = numeric.product(a, b, 3).withColumnRenamed("v", "low").join(numeric.product(a, b).withColumnRenamed("v", "whole"), ["i", "j"], "full")
    return both.select("i", "j", F.round(F.coalesce("low", F.lit(0.0)), 0).alias("low"), F.round("whole", 0).alias("whole"))


@query(f"""WITH {_CELLS}, w AS (SELECT i, j, sum(a.v * b.v) v FROM a JOIN b USING (k) GROUP BY 1, 2), l AS (SELECT r, i, j, sum(a.v * b.v) v FROM range(1, 7) t(r), a JOIN b USING (k) WHERE a.k < r GROUP BY 1, 2, 3)
SELECT t.r::int AS rank, round(sqrt(sum((w.v - coalesce(l.v, 0)) ** 2)) / 1000, 3) error, round(max(abs(w.v - coalesce(l.v, 0))) / 1000, 3) sup FROM range(1, 7) t(r), w LEFT JOIN l ON l.i = w.i AND l.j = w.j AND l.r = t.r GROUP BY 1""")
def error_by_rank(s, d):
    e = T(s, d, "events").withColumn("k", F.hour("ts") % 6)
    a = e.groupBy(F.col("user_id").alias("i"), "k").agg(F.sum("value").alias("v"))
    b = e.groupBy("k", F.col("event_type").alias("j")).agg(F.sum("value").alias("v"))
    whole, out = numeric.product(a, b), None
    for r in range(1, 7):
        one = numeric.deviation(whole, numeric.product(a, b, r), ["i", "j"]).select(F.lit(r).alias("rank"), F.round(F.col("frobenius") / 1000, 3).alias("error"), F.round(F.col("sup") / 1000, 3).alias("sup"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH k AS (SELECT user_id, epoch(ts) x, avg(value) y FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), q AS (SELECT DISTINCT user_id, epoch(ts) x FROM events WHERE event_type = 'signup')
SELECT q.user_id, q.x::bigint x, round(CASE WHEN lo.x = q.x THEN lo.y WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL THEN lo.y ELSE lo.y + (hi.y - lo.y) * (q.x - lo.x) / (hi.x - lo.x) END, 4) y
FROM q LEFT JOIN LATERAL (SELECT x, y FROM k WHERE k.user_id = q.user_id AND k.x <= q.x ORDER BY x DESC LIMIT 1) lo ON true LEFT JOIN LATERAL (SELECT x, y FROM k WHERE k.user_id = q.user_id AND k.x > q.x ORDER BY x LIMIT 1) hi ON true""")
def path_interpolation(s, d):
    e = T(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"), "event_type", "value").withColumn("x", F.col("u") / 1e6)
    knots = e.where("event_type = 'purchase'").groupBy("user_id", "x").agg(F.avg("value").alias("y"))
    at = e.where("event_type = 'signup'").select("user_id", "x").distinct()
    return numeric.interpolate(knots, at, ["user_id"], "x", "y").select("user_id", F.round("x").cast("long").alias("x"), F.round("y", 4).alias("y"))
