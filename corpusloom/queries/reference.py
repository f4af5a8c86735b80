"""Queries for the operators of the core, each over whole tables, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import classify, numeric, text
from corpusloom.operators import batch, extract, graph, lookup, merge, relate, report, resolve
from corpusloom.operators.hierarchy import hierarchy
from corpusloom.plans import cut
from corpusloom.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:  # noqa: N802
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.lines(T(spark, sf, "documents"))


_LINES = r"""l0 AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '\S'))) text,
  generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '\S')), 1) - 1 line_no FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, line_no::int line_no, text FROM l0)"""
_SIGNS = r"[|⟨⟩λαβγδεϵθκμνξπρσςτυφχψωΓΔΘΛΞΠΣΦΨΩ=∗ˆ˜¯≤≥∑∏∫±∓×÷∂∇∞∈∉⊂⊃⊆⊇∪∩]"
_ENV = lambda w: rf"regexp_matches(t, '^{w}\s*\d*\.?\s') OR regexp_matches(t, '^{w}\.?\s*$')"
_BLANKS = r"[ \t\n\r\f\v\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_STRIPPED = f"regexp_replace(text, '^{_BLANKS}|{_BLANKS}$', '', 'g')"
_TYPED = rf"""{_LINES}, y AS (SELECT *, {_STRIPPED} t FROM l),
k AS (SELECT doc_id, line_no, text, t, CASE WHEN t = '' THEN 'narrative' WHEN regexp_matches(t, '^(FIGURE|Figure)\s*\d') THEN 'figure_caption' WHEN regexp_matches(t, '^(TABLE|Table)\s*\d') THEN 'table_caption'
  WHEN NOT (regexp_matches(t, '^[\d.\s,\-]+$') OR regexp_matches(t, '{_SIGNS}') OR regexp_matches(t, '\.\s*\.\s*\.') OR starts_with(t, 'This is page') OR contains(t, 'Printer:') OR contains(t, 'Opaque') OR contains(t, 'Springer'))
    AND length(t) < 150 AND regexp_matches(t, '^\d+(\.\d+)*\s+[A-Z]') AND NOT starts_with(t, '0') AND try_cast(regexp_extract(t, '^(\d+)', 1) AS bigint) <= 18
    AND (len(list_filter(regexp_split_to_array(regexp_replace(t, '^\d+(\.\d+)*\s+', ''), '\s+'), lambda x: x <> '')) >= 2 OR length(regexp_replace(t, '^\d+(\.\d+)*\s+', '')) >= 8) THEN 'section_header'
  WHEN regexp_matches(t, '(?i)^definition([^A-Za-z0-9_]|$)|is defined as([^A-Za-z0-9_]|$)|we define([^A-Za-z0-9_]|$)') THEN 'definition'
  WHEN {_ENV('Theorem')} THEN 'theorem' WHEN {_ENV('Lemma')} THEN 'lemma' WHEN {_ENV('Corollary')} THEN 'corollary' WHEN regexp_matches(t, '^Proof\.?(\s|$)') THEN 'proof'
  WHEN {_ENV('Example')} THEN 'example' WHEN {_ENV('(Exercise|Ex[.])')} THEN 'exercise'
  WHEN length(t) < 80 AND length(replace(t, ' ', '')) > 0 AND length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) * 10 < length(replace(t, ' ', '')) * 3 THEN 'equation' ELSE 'narrative' END "type" FROM y)"""


def typed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return doc_lines(spark, sf).withColumn("type", classify.paragraph_type(F.col("text")))


@query(f"WITH {_LINES} SELECT doc_id, count(*)::bigint n FROM l GROUP BY doc_id")
def paragraph_split_counts(s, d):
    return doc_lines(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TYPED} SELECT coalesce(lang, 'unknown') lang, "type", count(*)::bigint n FROM k JOIN documents USING (doc_id) GROUP BY ALL""")
def classify_lines_by_lang(s, d):
    docs = T(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), "text")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"\S"))
    rows = docs.select("lang", F.explode(kept).alias("text"))
    return rows.groupBy("lang", classify.paragraph_type(F.col("text")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TYPED}, b AS (SELECT doc_id, "type", line_no, count(*) OVER (PARTITION BY doc_id) n, t FROM k) SELECT doc_id, count(*)::bigint n FROM b WHERE "type" = 'narrative' AND t <> '' AND line_no >= n * 0.9 AND (regexp_matches(t, '^\\[\\d+\\]') OR regexp_matches(t, '^[A-Z][a-z]+,?\\s.*\\(\\d{{4}}\\)')) GROUP BY 1""")
def bibliography_tail_lines(s, d):
    docs = T(s, d, "documents").select("doc_id", "text")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"\S"))
    rows = docs.select("doc_id", F.size(kept).alias("n"), F.posexplode(kept).alias("line_no", "text"))
    kind = classify.paragraph_type(F.col("text"), page=F.col("line_no"), pages=F.col("n"))
    return rows.where(kind == "bibliography").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def reject_reasons(s, d):
    names = T(s, d, "concepts").select("id", "name").distinct()
    return names.groupBy(classify.reject_reason(F.col("name")).alias("reason"), classify.reject_annotated(F.col("name")).alias("rejected")).agg(F.count(F.lit(1)).alias("n"))


_HEADS = f"""{_TYPED}, h AS (SELECT doc_id, line_no, nullif(regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\s+', 1), '') number, t FROM k WHERE "type" = 'section_header')"""


def headers(s, d):
    h = typed_lines(s, d).where("type = 'section_header'").withColumn("p", extract.section_parts(F.col("text")))
    return h.select(F.col("doc_id").alias("book"), F.col("line_no").alias("ord"), "p.number", "p.title")


@query(f"WITH {_HEADS} SELECT doc_id book, number, min(line_no)::int ord FROM h GROUP BY ALL")
def header_running_dedup(s, d):
    return extract.first_headers(headers(s, d)).select("book", "number", "ord")


@query(f"""WITH {_TYPED}, f AS (SELECT doc_id, line_no, CASE WHEN "type" = 'section_header' THEN nullif(regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\s+', 1), '') END number FROM k),
c AS (SELECT doc_id, last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) section FROM f)
SELECT doc_id book, section, count(*)::bigint n FROM c GROUP BY ALL""")
def section_carry_forward(s, d):
    rows = typed_lines(s, d).withColumn("is_header", F.col("type") == "section_header").withColumn("p", extract.section_parts(F.col("text")))
    rows = rows.select(F.col("doc_id").alias("book"), F.col("line_no").alias("ord"), "is_header", F.when(F.col("is_header"), F.col("p.number")).alias("number"), F.when(F.col("is_header"), F.col("p.title")).alias("title"))
    return extract.current_section(rows).groupBy("book", "section").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TYPED}, w AS (SELECT doc_id, max(("type" IN ('figure_caption', 'table_caption'))::int) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) near,
  first_value(CASE WHEN length(text) > 100 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) about FROM k)
SELECT doc_id, sum(near)::bigint near, count(about)::bigint described FROM w GROUP BY doc_id""")
def neighbor_frame_flags(s, d):
    rows = typed_lines(s, d).withColumnsRenamed({"doc_id": "book", "line_no": "ord"})
    n = extract.neighbourhood(rows)
    return n.groupBy(F.col("book").alias("doc_id")).agg(F.sum(F.col("near_caption").cast("int")).alias("near"), F.count("described_by").alias("described"))


@query()
def textual_intro_terms(s, d):
    docs = T(s, d, "documents").select("doc_id", "text")
    terms = extract.introduced_terms(docs).drop("text")
    return extract.first_seen(terms, "term", ["doc_id", "pattern_no", "match_no"]).select("doc_id", "pattern_no", "match_no", "term")


@query("""SELECT doc_id, nullif(regexp_extract(string_split(text, chr(10))[1], '["“]([^"”]+)["”]', 1), '') term FROM documents WHERE text IS NOT NULL AND regexp_matches(string_split(text, chr(10))[1], '["“][^"”]+["”]') AND NOT regexp_matches(regexp_extract(string_split(text, chr(10))[1], '["“]([^"”]+)["”]', 1), '(?i)(^|\\s)(for|of|from|the|a|an|in|on|to|with|and|or|by|as)$|-$')""")
def quoted_or_cascade_term(s, d):
    docs = T(s, d, "documents").where(F.split("text", "\n")[0].rlike('["“][^"”]+["”]'))
    return docs.select("doc_id", extract.defined_term(F.col("text")).alias("term")).where("term is not null")


@query("""WITH r AS (SELECT DISTINCT id, text FROM paragraphs WHERE regexp_matches(text, '^(Theorem|Lemma|Corollary)')), m AS (SELECT id, text, regexp_extract(text, '(?i)^(theorem|lemma|corollary)\\s+(\\d+(?:\\.\\d+)*)(?:\\s*\\(([^)]+)\\))?', ['k', 'n', 't']) x FROM r)
SELECT id, CASE WHEN x.k <> '' THEN x.k || ' ' || x.n || CASE WHEN x.t <> '' THEN ' (' || x.t || ')' ELSE '' END ELSE trim(string_split(text, chr(10))[1]) END AS name FROM m""")
def theorem_names(s, d):
    rows = T(s, d, "paragraphs").select("id", "text").distinct().where(F.col("text").rlike("^(Theorem|Lemma|Corollary)"))
    return rows.select("id", extract.theorem_name(F.col("text")).alias("name"))


_LOOSE = f"""trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(name, '^{_BLANKS}|{_BLANKS}$', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '\\.+$', ''), '{_BLANKS}', ' ', 'g'))), '["''`,:;!?(){{}}\\[\\]]', '', 'g'), '[-‐–—−]+', '-', 'g'))"""


@query(f"""WITH c AS (SELECT DISTINCT id, name FROM concepts), k AS (SELECT id, name, {_LOOSE} loose FROM c) SELECT id, loose, CASE WHEN length(loose) > 4 AND ends_with(loose, 's') AND NOT ends_with(loose, 'ss') THEN loose[:-2] ELSE loose END singular,
CASE WHEN length(translate(loose, '- ', '')) >= 3 THEN translate(loose, '- ', '') END bare FROM k WHERE name IS NULL OR NOT regexp_matches(name, '[^ -~]')""")
def name_keys(s, d):
    n = T(s, d, "concepts").select("id", "name").distinct().where("name is null or not name rlike '[^ -~]'")
    loose = text.name_loose(F.col("name"))
    return n.select("id", loose.alias("loose"), text.singular(loose).alias("singular"), text.bare_name(F.col("name")).alias("bare"))


@query()
def name_forms(s, d):
    n = T(s, d, "concepts").select("id", "name").distinct()
    c = F.col("name")
    return n.select("id", text.name_loose(c).alias("loose"), text.name_strict(c).alias("strict"), text.singular(text.name_loose(c)).alias("singular"), text.bare_name(c).alias("bare"), text.without_label(c).alias("unlabelled"), text.lower_first(c).alias("lowered"))


@query("""SELECT DISTINCT p_brand, CASE WHEN contains(p_brand, '#') THEN regexp_replace(replace(p_brand, '#', '.'), '\\.[^.]*$', '') END parent, string_split(replace(p_brand, '#', '.'), '.')[1] chapter, try_cast(string_split(replace(p_brand, '#', '.'), '.')[1] AS int) number FROM part""")
def prefix_strip_chapter_of(s, d):
    n = F.replace("p_brand", F.lit("#"), F.lit("."))
    return T(s, d, "part").select("p_brand", text.parent_number(n).alias("parent"), text.chapter_of(n).alias("chapter"), text.chapter_number(n).alias("number")).distinct()


@query("""SELECT DISTINCT p_name, list_aggr(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') title FROM part""")
def title_case_names(s, d):
    return T(s, d, "part").select("p_name", text.title_case(F.col("p_name")).alias("title")).distinct()


@query("""SELECT CASE WHEN contains(lower(name), 'lasso') THEN 1 WHEN contains(lower(name), 'smoother') THEN 2 WHEN contains(lower(name), 'test') THEN 3 ELSE 4 END tier, count(*)::bigint n FROM concepts GROUP BY 1""")
def tier_rules(s, d):
    rules = [(1, "has", "lasso"), (2, "has", "smoother"), (3, "has", "test")]
    return T(s, d, "concepts").groupBy(text.tier(F.col("name"), rules, 4).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c.id, coalesce(nullif(new_category, ''), nullif(category, ''), 'other') category, CASE WHEN s.number <> '' THEN s.number || ' ' || s.title ELSE '' END "label" FROM (SELECT DISTINCT * FROM concepts) c LEFT JOIN (SELECT DISTINCT id, number, title FROM sections) s ON s.id = c.section_id""")
def truthy_coalesce(s, d):
    sections = T(s, d, "sections").select(F.col("id").alias("section_id"), "number", "title").distinct()
    c = T(s, d, "concepts").distinct().join(sections, "section_id", "left")
    return c.select("id", text.first_said(F.col("new_category"), F.col("category"), default="other").alias("category"), text.label(F.col("number"), F.col("title")).alias("label"))


@query("""SELECT id, substring(description, instr(description, 'the '), instr(substring(description, instr(description, 'the ') + 4), ' of ') + 7) piece FROM (SELECT DISTINCT id, description FROM concepts) WHERE instr(description, 'the ') > 0 AND instr(substring(description, instr(description, 'the ') + 4), ' of ') > 0""")
def verbatim_slice(s, d):
    c = T(s, d, "concepts").select("id", "description").distinct()
    return c.select("id", text.between(F.col("description"), "the ", " of ").alias("piece")).where("piece is not null")


@query("""WITH q AS (SELECT DISTINCT id, quote FROM concepts WHERE length(quote) >= 20), p AS (SELECT DISTINCT id paragraph_id, translate(text, chr(10), ' ') text FROM paragraphs WHERE text IS NOT NULL) SELECT q.id, min(paragraph_id) home FROM q JOIN p ON contains(text, substring(quote, 1, 60)) GROUP BY q.id, quote""")
def quote_prefix_lookup(s, d):
    q = T(s, d, "concepts").select("id", "quote")
    p = T(s, d, "paragraphs").select(F.col("id").alias("paragraph_id"), F.translate("text", "\n", " ").alias("text"))
    return lookup.quote_home(q, p, "quote", "text", "paragraph_id").select("id", "home")


@query("""WITH s AS (SELECT DISTINCT id, textbook_id, page_start, page_end FROM sections), p AS (SELECT DISTINCT id, textbook_id, page_number FROM pages)
SELECT s.id section_id, count(*)::bigint pages FROM s JOIN p ON p.textbook_id = s.textbook_id AND p.page_number BETWEEN s.page_start AND s.page_end GROUP BY 1""")
def context_range_lookup(s, d):
    r = T(s, d, "sections").select(F.col("id").alias("section_id"), "textbook_id", "page_start", "page_end").distinct()
    p = T(s, d, "pages").select("id", "textbook_id", "page_number").distinct()
    return lookup.in_range(r, p, "page_number", "page_start", "page_end", ["textbook_id"]).groupBy("section_id").agg(F.count(F.lit(1)).alias("pages"))


@query("""WITH s AS (SELECT DISTINCT id, textbook_id, parent_id, page_start, page_end FROM sections), n AS (SELECT a.id, min(b.page_start) nx FROM s a JOIN s b ON a.textbook_id = b.textbook_id AND a.parent_id IS NOT DISTINCT FROM b.parent_id AND b.page_start > a.page_start GROUP BY 1)
SELECT s.id, CASE WHEN page_start IS NOT NULL THEN coalesce(page_end, nx - 1, page_start + 20) END::int range_end FROM s LEFT JOIN n USING (id)""")
def sibling_interval_end(s, d):
    r = T(s, d, "sections").select("id", F.col("textbook_id").alias("book"), F.col("parent_id").alias("parent"), "page_start", "page_end").distinct()
    return lookup.sibling_ends(r).select("id", "range_end")


@query("""SELECT n_name, c_custkey, c_acctbal FROM (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) r FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 3""")
def like_topk(s, d):
    c = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lookup.top_k(c, ["n_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("n_name", "c_custkey", "c_acctbal")


@query("""WITH a AS (SELECT DISTINCT concept_id k, id r FROM concept_facts WHERE fact_type = 'definition'), b AS (SELECT DISTINCT concept_id k, id r FROM concept_facts WHERE fact_type = 'property'), n AS (SELECT k, count(*) n FROM a GROUP BY 1),
u AS (SELECT k, r, 1 rank FROM a UNION ALL SELECT b.k, r, 2 FROM b LEFT JOIN n USING (k) WHERE coalesce(n, 0) < 5) SELECT k concept_id, r fact_id, rank::int rank FROM u""")
def context_union_gate(s, d):
    f = T(s, d, "concept_facts").select(F.col("concept_id"), F.col("id").alias("fact_id"), "fact_type").distinct()
    part = lambda t: f.where(F.col("fact_type") == t).drop("fact_type")
    return lookup.with_fallback(part("definition"), part("property"), "concept_id", "fact_id", 5)


@query("""SELECT p.event_id, s.event_id found FROM events p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) event_id FROM events WHERE event_type = 'signup' GROUP BY 1, 2) s ON p.user_id = s.user_id AND p.ts >= s.ts WHERE p.event_type = 'purchase'""")
def asof_purchase_signup(s, d):
    e = T(s, d, "events").select("event_id", "ts", "user_id", "event_type")
    marks = e.where("event_type = 'signup'")
    rows = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    out = lookup.as_of(rows.withColumn("__at2", F.col("ts")), marks, ["user_id"], "ts", F.col("event_id"), F.col("event_id"))
    return out.select("event_id", "found")


@query("""WITH n AS (SELECT lower(trim(c_name)) n, min_by(c_mktsegment, c_custkey) v FROM customer GROUP BY 1) SELECT s_suppkey, coalesce(c.c_mktsegment, n.v) matched, CASE WHEN c.c_mktsegment IS NOT NULL THEN 'id' WHEN n.v IS NOT NULL THEN 'name' ELSE 'none' END matched_by
FROM supplier LEFT JOIN customer c ON c.c_custkey = s_suppkey * 20 LEFT JOIN n ON n.n = lower(replace(s_name, 'Supplier', 'Customer'))""")
def two_key_fallback_match(s, d):
    table = T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    rows = T(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 20).alias("k"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("n"))
    return lookup.by_id_or_name(rows, table, "k", "n", "seg").select("s_suppkey", "matched", "matched_by")


_PAIRS = [("kernel", "numeric"), ("test", "limits"), ("loss", "numeric"), ("estimator", "workflow")]


def taxonomy(s, d):
    u = T(s, d, "concepts").select("id", "category", "subcategory", "recorded_at").distinct()
    return merge.allowed(u, _PAIRS, "category", "subcategory")


_STATUS = """(SELECT *, CASE WHEN coalesce(category, '') NOT IN ('kernel', 'test', 'loss', 'estimator') THEN 'invalid_category' WHEN coalesce((category, subcategory) IN (('kernel', 'numeric'), ('test', 'limits'), ('loss', 'numeric'), ('estimator', 'workflow')), false) THEN 'ok' ELSE 'invalid_pair' END status FROM (SELECT DISTINCT id, category, subcategory, recorded_at FROM concepts))"""


@query(f"SELECT status, count(*)::bigint n FROM {_STATUS} GROUP BY 1")
def taxonomy_validate_report(s, d):
    return merge.report(taxonomy(s, d))


@query(f"""WITH u AS (SELECT category k, max_by(subcategory, id) subcategory FROM {_STATUS} WHERE status = 'ok' GROUP BY 1) SELECT DISTINCT c.id, CASE WHEN u.k IS NOT NULL THEN u.subcategory ELSE c.subcategory END subcategory FROM concepts c LEFT JOIN u ON u.k = c.category""")
def merge_overlay_lastwins(s, d):
    last = merge.last_valid(taxonomy(s, d), "category", "id")
    base = T(s, d, "concepts").select("id", "category", "subcategory").distinct()
    return merge.overlay(base, last, "category", ["subcategory"]).select("id", "subcategory")


@query("""SELECT DISTINCT id FROM concepts WHERE id NOT IN (SELECT concept_id FROM concept_facts WHERE concept_id IS NOT NULL)""")
def enrich_snapshot_antijoin(s, d):
    return T(s, d, "concepts").select("id").distinct().join(T(s, d, "concept_facts").select(F.col("concept_id").alias("id")), "id", "left_anti")


@query("""SELECT concept_id, max_by(fact_text, struct_pack(a := length(fact_text), b := -id)) fact_text FROM concept_facts WHERE concept_id IS NOT NULL GROUP BY 1""")
def integrate_longest_wins(s, d):
    return report.longest(T(s, d, "concept_facts").where("concept_id is not null"), ["concept_id"], "fact_text", "id")


@query("""WITH s AS (SELECT id ord, textbook_id::varchar || ':' || number number, CASE WHEN contains(number, '.') THEN textbook_id::varchar || ':' || regexp_replace(number, '\\.[^.]*$', '') END pn FROM (SELECT DISTINCT id, textbook_id, number FROM sections)), f AS (SELECT number, min(ord) p FROM s WHERE number IS NOT NULL GROUP BY 1)
SELECT ord, CASE WHEN f.p < ord THEN f.p END parent_ord FROM s LEFT JOIN f ON f.number = s.pn""")
def parent_resolution_ordered(s, d):
    book = lambda c: F.concat(F.col("textbook_id").cast("string"), F.lit(":"), c)
    r = T(s, d, "sections").select("id", "textbook_id", "number").distinct()
    r = r.select(F.col("id").alias("ord"), book(F.col("number")).alias("number"), book(text.parent_number(F.col("number"))).alias("parent_number"))
    return merge.late_parents(r).select("ord", "parent_ord")


@query("""WITH n AS (SELECT user_id, event_type, count(*)::bigint n FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def mode_with_ties(s, d):
    return report.mode(T(s, d, "events"), ["user_id"], "event_type")


@query("""WITH f AS (SELECT DISTINCT concept_id, id, coalesce(fact_type, '') fact_type, importance_rank FROM concept_facts), c AS (SELECT *, (row_number() OVER (PARTITION BY concept_id ORDER BY importance_rank NULLS FIRST, id, fact_type) - 1) // 1000 + 1 chunk FROM f)
SELECT concept_id, chunk::bigint chunk, to_json(list({'id': id, 'type': fact_type} ORDER BY importance_rank NULLS FIRST, id, fact_type))::varchar items FROM c GROUP BY 1, 2""")
def nested_facts_json(s, d):
    f = T(s, d, "concept_facts").select("concept_id", "id", F.coalesce("fact_type", F.lit("")).alias("type"), "importance_rank").distinct()
    return report.nested_chunks(f, ["concept_id"], [F.col("importance_rank"), F.col("id"), F.col("type")], id=F.col("id"), type=F.col("type"))


@query("SELECT l_orderkey, l_linenumber, count(*)::bigint n, min(l_partkey) least FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def having_duplicates_minid(s, d):
    return report.repeated(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("""SELECT field, filled::bigint filled, total::bigint total, round(filled / total, 4) share FROM (SELECT 'quote' field, count(quote) filled, count(*) total FROM concepts UNION ALL SELECT 'formula', count(formula), count(*) FROM concepts UNION ALL SELECT 'section_id', count(section_id), count(*) FROM concepts)""")
def coverage_ratio(s, d):
    return report.coverage(T(s, d, "concepts"), "quote", "formula", "section_id")


@query("""SELECT t.id, coalesce(p.n, 0)::bigint pages, coalesce(s.n, 0)::bigint sections FROM (SELECT DISTINCT id FROM textbooks) t LEFT JOIN (SELECT textbook_id id, count(DISTINCT id) n FROM pages GROUP BY 1) p USING (id) LEFT JOIN (SELECT textbook_id id, count(DISTINCT id) n FROM sections GROUP BY 1) s USING (id)""")
def info_report(s, d):
    return report.info(T(s, d, "textbooks"), T(s, d, "pages"), T(s, d, "sections"))


def _concept_list(s, d):
    """Concepts by the last word of their name, the part of it that texts mention, with the number of their section."""
    numbers = T(s, d, "sections").where("number is not null").groupBy(F.col("id").alias("section_id")).agg(F.min("number").alias("section"))
    c = T(s, d, "concepts").where("deleted_at is null and description is not null").join(numbers, "section_id", "left")
    term = F.lower(F.regexp_extract("name", "([A-Za-z]+)[^A-Za-z]*$", 1))
    return c.select(F.col("id").alias("ord"), term.alias("name"), "section", "description").where("name <> ''").distinct()


@query("""WITH n AS (SELECT DISTINCT subcategory name FROM concepts WHERE subcategory IS NOT NULL) SELECT doc_id, name FROM documents JOIN n ON contains(lower(text), lower(name)) AND regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])' || name || '([^\\p{L}\\p{N}_]|$)')""")
def mention_pairs(s, d):
    names = T(s, d, "concepts").select(F.col("subcategory").alias("name")).where("name is not null").distinct()
    docs = T(s, d, "documents").select("doc_id", "text").where("text is not null")
    return relate.mention_pairs(docs, names).select("doc_id", "name")


@query()
def concept_mentions(s, d):
    names = T(s, d, "concepts").select("name").where("name is not null").distinct()
    docs = T(s, d, "documents").select("doc_id", "text").where("text is not null")
    return relate.mention_pairs(docs, names).select("doc_id", "name")


@query()
def relation_edges(s, d):
    c = cut(_concept_list(s, d))
    return relate.best_edges(relate.section_edges(c).unionByName(relate.cue_relations(c)))


@query("""SELECT source_id, target_id, relationship_type relation, max(coalesce(confidence, 0)) confidence FROM concept_relationships GROUP BY 1, 2, 3""")
def edge_dedup_best_confidence(s, d):
    e = T(s, d, "concept_relationships").select("source_id", "target_id", F.col("relationship_type").alias("relation"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit(1).alias("stage"))
    return relate.best_edges(e.withColumnsRenamed({"source_id": "source", "target_id": "target"})).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "relation", "confidence")


def part_groups(s, d):
    p = T(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size", "p_retailprice")
    links = resolve.key_links(p, {"name": text.name_loose(F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")))})
    return p, resolve.components(links, p.select("id"))


@query("""SELECT p_partkey id, min(p_partkey) OVER (PARTITION BY lower(p_name || ' ' || p_brand || ' ' || p_size)) component FROM part""")
def dedup_components(s, d):
    return part_groups(s, d)[1]


@query("""WITH g AS (SELECT *, min(p_partkey) OVER (PARTITION BY lower(p_name || ' ' || p_brand || ' ' || p_size)) component FROM part) SELECT component, max_by(p_partkey, struct_pack(a := p_retailprice, b := -p_partkey)) canonical FROM g GROUP BY 1""")
def dedup_canonical(s, d):
    p, g = part_groups(s, d)
    return resolve.canonical(p, g, F.col("p_retailprice"))


@query("""WITH n AS (SELECT DISTINCT p_type name FROM part WHERE length(p_type) >= 3) SELECT a.name short, b.name long FROM n a JOIN n b ON a.name <> b.name AND contains(b.name, a.name) AND (length(a.name) >= 0.5 * length(b.name) OR (length(a.name) >= 5 AND contains(' ' || b.name || ' ', ' ' || a.name || ' ')))""")
def substring_similarity_pairs(s, d):
    return resolve.contained(T(s, d, "part").select("p_type"))


@query()
def name_similarity_pairs(s, d):
    return resolve.contained(T(s, d, "concepts").select("name"))


@query("""WITH c AS (SELECT DISTINCT id, name FROM concepts WHERE name IS NOT NULL), m AS (SELECT id, min(id) OVER (PARTITION BY lower(name)) c FROM c), e AS (SELECT coalesce(a.c, source_id) source_id, coalesce(b.c, target_id) target_id, relationship_type, e.id FROM concept_relationships e LEFT JOIN m a ON a.id = source_id LEFT JOIN m b ON b.id = target_id)
SELECT source_id, target_id, relationship_type, min(id) id FROM e WHERE source_id <> target_id GROUP BY 1, 2, 3""")
def edges_repoint(s, d):
    c = T(s, d, "concepts").select("id", F.lower("name").alias("key")).where("key is not null").distinct()
    g = resolve.components(resolve.key_links(c, {"name": F.col("key")}), c.select("id"))
    e = T(s, d, "concept_relationships").select("source_id", "target_id", "relationship_type", "id")
    return resolve.repoint(e, g.select("id", F.col("component").alias("canonical")), ["source_id", "target_id"], ["relationship_type"])


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // 96 + 1)::bigint batch FROM part")
def batches_fixed(s, d):
    return batch.fixed(T(s, d, "part").select("p_partkey"), ["p_partkey"], 96)


@query("""WITH g AS (SELECT source, row_number() OVER (ORDER BY source) r, count(*) OVER () n FROM (SELECT DISTINCT source FROM documents)) SELECT least((r - 1) // greatest(n // 5, 1) + 1, 5)::bigint batch, count(*)::bigint n FROM documents JOIN g USING (source) GROUP BY 1""")
def batches_by_group(s, d):
    return batch.by_group(T(s, d, "documents").select("source"), "source", 5).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


def relation_graph(s, d):
    return T(s, d, "concept_relationships").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("relationship_type").alias("type")).where("src is not null and dst is not null").distinct()


@query("""WITH e AS (SELECT DISTINCT source_id a, target_id b, relationship_type FROM concept_relationships WHERE source_id IS NOT NULL AND target_id IS NOT NULL), x AS (SELECT a id FROM e UNION ALL SELECT b FROM e) SELECT c.id, count(x.id)::bigint degree FROM (SELECT DISTINCT id FROM concepts) c LEFT JOIN x USING (id) GROUP BY 1""")
def degree_isolated(s, d):
    return graph.degrees(T(s, d, "concepts").select("id").distinct(), relation_graph(s, d))


@query("""WITH e AS (SELECT DISTINCT source_id a, target_id b, relationship_type t FROM concept_relationships WHERE source_id IS NOT NULL AND target_id IS NOT NULL), q AS (SELECT DISTINCT id FROM concepts WHERE id % 100 = 0)
SELECT a id, b neighbour, 'out' direction, t "type" FROM e WHERE a IN (FROM q) UNION ALL SELECT b, a, 'in', t FROM e WHERE b IN (FROM q)""")
def neighborhood_1hop(s, d):
    return graph.neighbours(relation_graph(s, d), T(s, d, "concepts").select("id").where("id % 100 = 0").distinct())


@query("""WITH e AS (SELECT DISTINCT source_id a, target_id b FROM concept_relationships WHERE source_id IS NOT NULL AND target_id IS NOT NULL), h AS (SELECT DISTINCT id FROM concepts WHERE contains(lower(name), 'lasso')),
x AS (SELECT id, true hit FROM h UNION ALL SELECT b, false FROM e WHERE a IN (FROM (SELECT id FROM h)) UNION ALL SELECT a, false FROM e WHERE b IN (FROM (SELECT id FROM h))) SELECT id, bool_or(hit) hit FROM x GROUP BY 1""")
def name_search_neighbors(s, d):
    return graph.search(T(s, d, "concepts").select("id", "name").distinct(), relation_graph(s, d), "lasso")


_TRACE = """WITH RECURSIVE e AS (SELECT DISTINCT source_id a, target_id b FROM concept_relationships WHERE relationship_type IN (SELECT min(relationship_type) FROM concept_relationships) AND source_id IS NOT NULL AND target_id IS NOT NULL),
t AS (SELECT 1::bigint id UNION SELECT e.a FROM e JOIN t ON e.b = t.id), r AS (SELECT id FROM t WHERE id <> 1)"""


def _trace(s, d):
    e = relation_graph(s, d)
    kind = T(s, d, "concept_relationships").agg(F.min("relationship_type").alias("type"))
    e = e.join(F.broadcast(kind), "type", "left_semi")
    return e, graph.trace(e, s.range(1, 2))


@query(_TRACE + " SELECT id FROM r")
def prerequisite_trace(s, d):
    return _trace(s, d)[1].select("id")


@query(_TRACE + " SELECT id FROM r WHERE id NOT IN (SELECT b FROM e WHERE a IN (SELECT id FROM r))")
def trace_frontier(s, d):
    e, t = _trace(s, d)
    return graph.frontier(t.select("id"), e)


@query("""SELECT s.n_regionkey src_grp, c.n_regionkey dst_grp, count(*)::bigint n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey WHERE s.n_regionkey <> c.n_regionkey GROUP BY 1, 2""")
def cross_group_edges(s, d):
    home = T(s, d, "nation").select("n_nationkey", "n_regionkey")
    sup = T(s, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("grp"))
    cus = T(s, d, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") + 10**9).alias("id"), F.col("n_regionkey").alias("grp"))
    e = T(s, d, "lineitem").join(T(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("src"), (F.col("o_custkey") + 10**9).alias("dst"))
    return graph.cross_group(e, sup.unionByName(cus)).groupBy("src_grp", "dst_grp").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE l AS (SELECT r_regionkey::bigint id, NULL::bigint parent FROM region UNION ALL SELECT 1000 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 100000 + c_custkey, 1000 + c_nationkey FROM customer),
t AS (SELECT id, id root_id, 0 depth, id::varchar path FROM l WHERE parent IS NULL UNION ALL SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || l.id FROM l JOIN t ON l.parent = t.id) SELECT id, root_id, depth::int depth, path FROM t""")
def region_tree(s, d):
    r = T(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"))
    n = T(s, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"))
    c = T(s, d, "customer").select((F.col("c_custkey") + 100000).alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent"))
    return hierarchy(r.unionByName(n).unionByName(c)).select("id", "root_id", "depth", "path")


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 2) intercept, round(corr(l_extendedprice, l_quantity), 6) r FROM lineitem GROUP BY 1""")
def ols_simple(s, d):
    g = T(s, d, "lineitem").groupBy("l_returnflag").agg(numeric.ols("l_quantity", "l_extendedprice"), F.corr("l_extendedprice", "l_quantity").alias("r"))
    return g.select("l_returnflag", F.round("ols.slope", 4).alias("slope"), F.round("ols.intercept", 2).alias("intercept"), F.round("r", 6).alias("r"))


@query("""SELECT round((covar_samp(l_quantity, l_extendedprice) - covar_samp(l_quantity, l_tax) * covar_samp(l_extendedprice, l_tax) / var_samp(l_tax)) / (var_samp(l_quantity) - covar_samp(l_quantity, l_tax) ** 2 / var_samp(l_tax)), 4) slope, round(1 / (1 - corr(l_quantity, l_tax) ** 2), 6) vif FROM lineitem""")
def ols_partial_vif(s, d):
    return T(s, d, "lineitem").agg(F.round(numeric.partial_slope("l_extendedprice", "l_quantity", "l_tax"), 4).alias("slope"), F.round(numeric.vif("l_quantity", "l_tax"), 6).alias("vif"))


@query("""SELECT round(sum(sign(l_discount - 0.05) * greatest(abs(l_discount - 0.05) - 0.02, 0)), 4) soft, round(sum(CASE WHEN l_discount <= 0.02 THEN 0.02 * l_discount WHEN l_discount <= 0.074 THEN (2 * 3.7 * 0.02 * l_discount - l_discount * l_discount - 0.0004) / 5.4 ELSE 0.0004 * 4.7 / 2 END), 4) scad, round(sum(exp(-l_tax * l_tax / 2) / sqrt(2 * pi())), 3) pdf FROM lineitem""")
def penalties(s, d):
    return T(s, d, "lineitem").agg(F.round(F.sum(numeric.soft(F.col("l_discount") - 0.05, 0.02)), 4).alias("soft"), F.round(F.sum(numeric.scad(F.col("l_discount"), 0.02)), 4).alias("scad"), F.round(F.sum(numeric.normal_pdf(F.col("l_tax"))), 3).alias("pdf"))


@query("""WITH e AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) step FROM events) SELECT user_id, round(sum(coalesce(step, 0)), 3) length FROM e GROUP BY 1""")
def l1_arc_length(s, d):
    from pyspark.sql import Window

    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = T(s, d, "events").select("user_id", step.alias("step"))
    return e.groupBy("user_id").agg(F.round(F.sum(F.coalesce("step", F.lit(0.0))), 3).alias("length"))


@query()
def coord_descent(s, d):
    gram, cross, _, n = numeric.moments(T(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    lams = [f * float(abs(cross).max()) for f in (0.5, 0.1, 0.01)]
    rows = [(k, float(lam), j, round(float(b), 4)) for k, (lam, beta) in enumerate(zip(lams, numeric.lasso(gram, cross, lams))) for j, b in enumerate(beta)]
    return s.createDataFrame(rows, "step int, lam double, variable int, beta double")


@query()
def stagewise_path(s, d):
    gram, cross, _, n = numeric.moments(T(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    path = numeric.stagewise(gram, cross, 10.0, 500)
    return s.createDataFrame([(k, j, float(b)) for k, row in enumerate(path) for j, b in enumerate(row)], "step int, variable int, beta double")


@query("""WITH m AS (SELECT count(*) n, var_pop(l_quantity) a, covar_pop(l_quantity, l_discount) b, covar_pop(l_quantity, l_tax) c, var_pop(l_discount) d, covar_pop(l_discount, l_tax) e, var_pop(l_tax) f, covar_pop(l_quantity, l_extendedprice) p, covar_pop(l_discount, l_extendedprice) q, covar_pop(l_tax, l_extendedprice) r, var_pop(l_extendedprice) y FROM lineitem),
s AS (SELECT 0 size, 0 mask, y * n rss FROM m UNION ALL SELECT 1, 1, (y - p * p / a) * n FROM m UNION ALL SELECT 1, 2, (y - q * q / d) * n FROM m UNION ALL SELECT 1, 4, (y - r * r / f) * n FROM m
UNION ALL SELECT 2, 3, (y - (p * p * d - 2 * p * q * b + q * q * a) / (a * d - b * b)) * n FROM m UNION ALL SELECT 2, 5, (y - (p * p * f - 2 * p * r * c + r * r * a) / (a * f - c * c)) * n FROM m UNION ALL SELECT 2, 6, (y - (q * q * f - 2 * q * r * e + r * r * d) / (d * f - e * e)) * n FROM m
UNION ALL SELECT 3, 7, (y - (p * p * (d * f - e * e) + q * q * (a * f - c * c) + r * r * (a * d - b * b) + 2 * p * q * (c * e - b * f) + 2 * p * r * (b * e - c * d) + 2 * q * r * (b * c - a * e)) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))) * n FROM m)
SELECT size::int size, arg_min(mask, rss)::int mask, round(min(rss) / 1e6, 2) rss FROM s GROUP BY size""")
def best_subsets(s, d):
    gram, cross, total, n = numeric.moments(T(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return s.createDataFrame([(k, m, round(r / 1e6, 2)) for k, m, r in numeric.best_subsets(gram, cross, total)], "size int, mask int, rss double")


@query("""WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) a FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(a) text, generate_subscripts(a, 1) - 1 line_no FROM l0),
b AS (SELECT *, sum((trim(text, ' ') = '')::int) OVER (PARTITION BY doc_id ORDER BY line_no) block FROM l), k AS (SELECT *, row_number() OVER w n, first_value(trim(text, ' ')) OVER w "group" FROM b WHERE trim(text, ' ') <> '' AND NOT starts_with(ltrim(text, ' '), '#') WINDOW w AS (PARTITION BY doc_id, block ORDER BY line_no)),
t AS (SELECT doc_id, block, max(CASE WHEN n = 2 THEN trim(text, ' ') END) topic FROM k GROUP BY ALL)
SELECT doc_id, block::bigint block, "group", topic, trim(string_split(text, '#')[1], ' ') item, CASE WHEN contains(text, '#') THEN trim(substring(text, instr(text, '#') + 1), ' ') END note FROM k JOIN t USING (doc_id, block) WHERE n > 2""")
def list_blocks(s, d):
    rows = T(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return ingest.blocks(rows)
