import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, formatting, harmful, leaks, lines, lookalike, scanned, survivor, truncation

VOCABULARY = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def model(spark):
    words = "the estimator smoother variance holds for a sample naïve Смещение убывает Η εκτίμηση του δείγματος loss test index kernel"
    return lookalike.letter_model(spark.createDataFrame([(words,), (None,), ("",)], "t string"), "t")


# Problem 5


@pytest.mark.parametrize(
    "text, plain",
    [("the ｌｏｓｓ", "the loss"), ("ﬁnal te​st", "final test"), ("a b c", "a b c"), ("naïve", "naïve"), ("tһe sаmple", "the sample"), ("ΙΝDEX", "INDEX"), ("cοst-νalue", "cost-value")],
)
def test_damage_is_undone(model, text, plain):
    assert lookalike.canonical(text, model) == (plain, True)


@pytest.mark.parametrize("text", ["", "plain", "naïve rôle", "σ² and λ ≥ 0", "Смещение убывает", "“x” – y…", "p̂ = k/n", "tab\there"])
def test_what_is_right_stays(model, text):
    assert lookalike.canonical(text, model) == (text, False)


def test_one_form_column(spark, model):
    df = spark.createDataFrame([(1, "tһe"), (1, "tһe"), (2, None), (3, ""), (4, "x" * 100_000 + "​")], "__text_id int, t string")
    rows = lookalike.one_form(df, "t", model).collect()
    assert sorted((r["__text_id"], r["__damaged"]) for r in rows) == [(1, True), (1, True), (2, False), (3, False), (4, True)]
    assert {r["__text_id"]: r["__text"] for r in rows}[1] == "the"
    assert lookalike.one_form(df.limit(0), "t").collect() == []


# Problems 4 and 3


def test_same_names(spark):
    names = ["Orvane tell-mark test", "orvane tellmark TEST", "test, Orvane tellmark", "Tellmark test (Orvane)", "orvane​tellmark\ttest.", "Orvane test tellmark", "Orvane tellmark tests", None, "", "?!", "tellmark test [Kolen]", "TELLMARK TEST; kolen"]
    df = spark.createDataFrame([(k, n, "x") for k, n in enumerate(names)] + [(0, names[0], "x")], "id long, name string, form string")
    got = {r.id: (r.first_id, r.copies) for r in formatting.same_names(df).collect()}
    assert got == {**{k: (0, 5) for k in range(5)}, 5: (5, 1), 6: (6, 1), 10: (10, 2), 11: (10, 2)}
    assert formatting.same_names(df.limit(0)).collect() == []


def test_any_part_may_be_moved(spark):
    names = ["Tellmark (Orvane) test", "Orvane tellmark test", "test; tellmark, orvane", "orvane test tellmark", "TELLMARK TEST ORVANE"]
    got = {r.id: r.first_id for r in formatting.same_names(spark.createDataFrame(list(enumerate(names)), "id long, name string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_same_records(spark):
    rows = [
        (1, [("name", "A b."), ("kind", "Test")]), (2, [("Kind", "TEST"), ("name", "a-b")]), (3, [("name", "Test"), ("kind", "a b")]),
        (4, [("name", "a b"), ("kind", "test"), ("note", None)]), (5, [("name", "a b"), ("name", "a b"), ("kind", "test")]), (6, None), (7, []), (None, [("name", "a b")]),
        (2, [("Kind", "TEST"), ("name", "a-b")]),
    ]
    df = spark.createDataFrame(rows, "id long, f array<struct<name:string,value:string>>")
    got = {r.id: (r.first_id, r.copies) for r in formatting.same_records(df, F.col("f")).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (3, 1), 4: (1, 3), 5: (5, 1), 6: (6, 2), 7: (6, 2)}
    assert formatting.same_records(df.limit(0), F.col("f")).collect() == []


def test_fingerprint_commutes(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["x"]), (["b", "a", "b"], ["x"]), (["a", "a", "b"], ["x"]), (["x"], ["a", "b", "b"])], "p array<string>, q array<string>")
    h = [r[0] for r in df.select(formatting.fingerprint({"p": F.col("p"), "q": F.col("q")})).collect()]
    turned = [r[0] for r in df.select(formatting.fingerprint({"q": F.col("q"), "p": F.col("p")})).collect()]
    assert h == turned and h[0] == h[1] and len(set(h)) == 3


def test_survivors_against_the_rule(spark):
    rnd = random.Random(3)
    sources = [("s1", 1), ("s2", 2), ("s3", 3)]
    said = ["good one", "other one", None, "", "TBD", "n/a", "(no description)", "-", "???"]
    rows = [(k, rnd.choice(said), rnd.choice([None, 5, 6, 99]), rnd.choice(["s1", "s2", "s3", "odd", None]), f"2023-01-{rnd.randrange(1, 5):02d}", "x") for k in range(300)]
    df = spark.createDataFrame(rows + rows[:40], "id long, description string, section_id long, source string, d string, item string").withColumn("recorded_at", F.when(F.col("id") % 11 > 0, F.col("d").cast("timestamp_ntz")))
    groups = spark.createDataFrame([(k, k % 40) for k in range(300)], "id long, first_id long")
    got, voters = survivor.survivors(df, groups, ["description", "section_id"], spark.createDataFrame(sources, "source string, trust int"), valid={"section_id": spark.createDataFrame([(5,), (6,), (6,)], "id long")})
    best = {}
    trust = dict(sources)
    for i, text, section, source, day, _ in rows:
        at = int(day[-2:]) if i % 11 > 0 else -1
        for field, ok in (("description", text in said[:2]), ("section_id", section in (5, 6))):
            if ok:
                key = (trust.get(source, 99), -at, i)
                best[i % 40, field] = min(best.get((i % 40, field), key), key)
    assert {(r.first_id, r.field): r.concept_id for r in got.collect()} == {k: v[2] for k, v in best.items()}
    assert voters is None  # the given order decides all


def test_survivors_without_trust(spark):
    df = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "a", "r")], "id long, v string, source string").withColumn("recorded_at", F.lit(None).cast("timestamp"))
    groups = spark.createDataFrame([(k, 1) for k in (1, 2, 3)], "id long, first_id long")
    assert [r.value for r in survivor.survivors(df, groups, ["v"])[0].collect()] == ["a"]
    assert survivor.survivors(df.limit(0), groups, ["v"])[0].collect() == []


def test_discovery_learns_whom_to_trust(spark):
    # three careless sources outvote two careful ones on item 0, but prove wrong wherever all others agree
    rows, k = [], 0
    for item in range(30):
        for source in ("good1", "good2", "bad1", "bad2", "bad3"):
            k += 1
            value = "true" if source[0] == "g" else "false" if item == 0 else f"wrong {source}"
            rows.append((k, item, value, source))
    df = spark.createDataFrame(rows, "id long, first_id long, v string, source string").withColumn("recorded_at", F.lit(None).cast("timestamp"))
    found, voters = survivor.survivors(df.drop("first_id"), df.select("id", "first_id"), ["v"])
    assert {r.first_id: r.value for r in found.collect()} == {i: "true" for i in range(30)}
    sure = {r.voter: r.reliability for r in voters.collect()}
    assert min(sure["good1"], sure["good2"]) > 0.9 and max(sure["bad1"], sure["bad2"], sure["bad3"]) < 0.2


def test_discovery_breaks_ties_by_order(spark):
    claims = spark.createDataFrame([(1, "f", str(k), f"v{k}", k) for k in (4, 2, 3, 1)], "item long, field string, value string, voter string, k long")
    won = survivor.discover(claims.withColumn("order", F.struct("k")).drop("k"))[0].collect()
    assert [r.value for r in won] == ["1"]


# Problem 8


def test_token_ids_equal_the_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["", None, "Hello  world\n\n it's 42!", "<|endoftext|>", "é" * 300, "漢字 かな 😀 ﷺ", "ab" * 5000] + ["".join(rnd.choice("abcdefghijklmnop qrstuvwxyzäßéж漢0 '.") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(df).collect()}
    assert all(got[k] == library.encode_ordinary(t or "") for k, t in enumerate(texts))


def test_merging_and_proposals_decode():
    v = bpe.vocabulary(VOCABULARY)
    for word in (b"interpretability", b"\xff\x00abc", " unbelievably".encode()):
        for ids in (v.propose(word), v.merge(word)):
            assert b"".join(v.tokens[i] for i in ids) == word


# Problem 9


def test_fm_index_against_brute_force():
    rnd = np.random.RandomState(2)
    text = np.concatenate([rnd.randint(1, 6, 500), [0]])
    index = leaks.FMIndex(text, 8)
    phrases = np.array([[a, b, c] for a in range(1, 7) for b in range(1, 7) for c in range(1, 7)])
    low, high = index.search(phrases)
    for p, lo, hi in zip(phrases, low, high):
        want = [k for k in range(499) if list(text[k : k + 3]) == list(p)]
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(5)] + [(7, None), (8, ""), (9, "one two")]
    noise = lambda n: " ".join(word() for _ in range(n))
    cut_words = items[2][1].split()
    docs = [
        (1, noise(50) + " " + items[0][1].upper().replace(" ", "\t") + " " + noise(50)),
        (2, noise(30) + " " + " ".join(cut_words[:25]) + " " + noise(9)),
        (3, " ".join(cut_words[:12]) + " " + noise(30)),
        (4, " ".join(w if k % 8 else "changed" for k, w in enumerate(items[1][1].split()))),
        (5, None), (6, ""), (7, " ".join(reversed(items[3][1].split()))), (8, items[4][1] + " " + noise(20000)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items + items[:1], "item_id long, text string")
    for shard in (40, 400_000):
        got = leaks.leaks(df, q, shard=shard, block=90)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 0), (2, 2), (4, 1), (8, 4)}
    spans = {r.doc_id: [tuple(p) for p in r.pieces] for r in got.collect()}
    assert spans[1] == [(50, 89)] and spans[2] == [(30, 54)]
    assert leaks.leaks(df.limit(0), q).collect() == [] and leaks.leaks(df, q.limit(0)).collect() == []


def test_leaks_in_distant_pieces(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    item, other = [word() for _ in range(16)], [word() for _ in range(30)]
    noise = lambda n: [word() for _ in range(n)]
    docs = [
        (1, item[:7] + noise(200) + item[8:15]),  # two pieces far apart add up
        (2, item[8:15] + noise(200) + item[:7]),  # not in the item's order: the longer piece alone is too short
        (3, item[:3] + noise(90) + item[5:8] + noise(90) + item[10:13]),  # short phrases don't
        (4, item + noise(5) + other + noise(300) + item[:9]),
    ]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    q = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(item[2:14]))], "item_id long, text string")
    for sent in (40, 10_000_000):
        got = leaks.leaks(df, q, sent_chars=sent).collect()
        found = {(r.doc_id, r.item_id): [tuple(p) for p in r.pieces] for r in got}
        assert {k for k in found if k[1] == 1} == {(1, 1), (4, 1)} and (4, 2) in found
        assert found[1, 1] == [(0, 6), (207, 213)]
    spans = leaks.removal_spans(leaks.leaks(df, q)).where("doc_id = 4").orderBy("first").collect()
    assert (spans[0]["first"], spans[0]["last"]) == (0, 15) and (21, 50) in {(r["first"], r["last"]) for r in spans}
    assert leaks.removal_spans(leaks.leaks(df.limit(0), q)).collect() == []


def test_leaks_in_scripts_without_spaces(spark):
    text = "在高维情形下估计量的方差随样本量增大而减小"
    df = spark.createDataFrame([(1, "甲乙丙" + text + "丁戊"), (2, "方差随样本"), (3, "完全不同的句子没有任何关系可言")], "doc_id long, text string")
    q = spark.createDataFrame([(5, text)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks.leaks(df, q).collect()] == [(1, 5)]


# Problem 7


def test_truncation(spark):
    rnd = random.Random(6)
    heads = ["the smoother", "a kernel", "this estimator", "one sample", "every loss"]
    tails = ["vanishes in the limit of large samples", "is reported with its uncertainty", "shrinks over the whole range", "needs no further adjustment at all"]
    whole = [f"{rnd.choice(heads)} number {rnd.randrange(99)} {rnd.choice(tails)}." for _ in range(1500)]
    cases = {k: t for k, t in enumerate(whole)}
    cut = {5000 + k: t[: rnd.randrange(30, len(t) - 12)] for k, t in enumerate(whole[:60])}
    dots = {6000 + k: t[: rnd.randrange(30, len(t) - 12)] + rnd.choice(["...", "…", " …"]) for k, t in enumerate(whole[60:120])}
    fine = {7000 + k: t[:-1] for k, t in enumerate(whole[120:180])}
    rows = [("t", k, "src", t) for k, t in {**cases, **cut, **dots, **fine}.items()] + [("t", 9001, "src", None), ("t", 9002, "src", ""), ("t", 9003, None, "  ")]
    got = truncation.truncated(spark.createDataFrame(rows, "table_name string, row_id long, source string, text string")).collect()
    hit = {r.row_id for r in got if r.cut}
    assert len(hit & cut.keys()) > 50 and len(hit & dots.keys()) > 55 and not hit & cases.keys() and len(hit & fine.keys()) < 4
    assert not {9001, 9002, 9003} & {r.row_id for r in got}


def test_truncation_of_nothing(spark):
    assert truncation.truncated(spark.createDataFrame([], "table_name string, row_id long, source string, text string")).collect() == []


def test_truncation_reads_long_runs_of_marks_once():
    leader, began = "Kernels " + ". " * 100_000 + "12", time.process_time()
    assert truncation.end_of(leader) == leader and truncation.end_of(leader + " ...") == leader
    assert truncation.mark_of("!'" * 100_000 + "a") == "none" and truncation.mark_of("a" + "'" * 100_000) == "none"
    assert time.process_time() - began < 2
    assert [truncation.mark_of(t) for t in ("a.", "a.')", "a..", "a…", "a..!", "a?\n", "a。", "a -", "a", "")] == ["stop", "stop", "mark", "mark", "none", "stop", "stop", "mark", "none", "none"]


def test_truncation_keeps_ids_and_counts_in_parts(spark, monkeypatch):
    heads, tails = ["the smoother", "a kernel", "each loss"], ["vanishes in the limit", "is reported with its error", "shrinks over the range"]
    texts = [f"{heads[k % 3]} number {'abcdefghij'[k % 7]}{'abcdefghij'[k % 10]} {tails[k // 3 % 3]}." for k in range(300)]
    ids = [2**60 + k for k in range(300)]
    rows = [("t", k, "src", t if k % 9 else t[:-9]) for k, t in zip(ids, texts)] + [("t", None, "src", "a kernel of no number at all.")]
    df = spark.createDataFrame(rows, "table_name string, row_id long, source string, text string")

    def odds():
        return sorted((r.row_id or 0, r.mark, r.odds) for r in truncation.scored(df).select("row_id", "mark", "odds").collect())

    whole = odds()
    assert [r[0] for r in whole] == [0, *ids]
    monkeypatch.setattr(truncation, "FILTER_BITS", 1 << 12)
    assert odds() == whole


# Problem 10


def test_words_behind_disguise():
    assert harmful.sentences("You are a p@th3tic ID10T!!! s.t.u.p.i.d moooron") == [["you", "are", "a", "pathetic", "idiot"], ["stupid", "moron"]]
    assert harmful.sentences("") == []


def test_ordinal_model(spark):
    rnd = random.Random(8)
    bad = ["you are a worthless clown", "go rot in a hole you pig", "everyone hates you fool"]
    calm = [f"the {a} of the {b} is {c}" for a in ("rate", "mean", "loss") for b in ("kernel", "tree", "test") for c in ("small", "stable", "known", "odd")]
    texts, grades = [], []
    for _ in range(400):
        harm = rnd.random() < 0.3
        parts = [rnd.choice(calm) for _ in range(5)] + [rnd.choice(bad)] * harm
        rnd.shuffle(parts)
        texts.append(". ".join(parts) + ".")
        grades.append(2 * (harm if rnd.random() > 0.08 else not harm))
    model = harmful.train(spark, texts, np.array(grades))
    df = spark.createDataFrame([(1, "x. " + bad[0] + "!", "s"), (2, calm[0] + ".", "s"), (3, None, "s"), (4, "", None)], "doc_id long, text string, source string")
    got = {r.doc_id: r.severity for r in harmful.severity(df, model).collect()}
    assert got[1] > harmful.SEVERE > 0.5 > got[2] and got[3] == got[4] == 0.0
    assert (np.diff(model.bounds) >= 0).all()


def test_model_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "r", None)], "doc_id long, rater string, label string")
    model = harmful.train(spark, *harmful.graded_texts(docs, labels))
    assert harmful.severity(docs, model).count() == 1


# Problem 1


def scanned_rows(spark, pages, paragraphs):
    found, _ = scanned.damage(spark.createDataFrame(pages, "id long, textbook_id long, page_number int, raw_text string"), spark.createDataFrame(paragraphs, "id long, page_id long, text string"))
    return found.select("table_name", "row_id", "line_no", "kind", "word").distinct()


def test_scanned(spark):
    body = "the estimator of the variance holds\nand every sample of the kernel vanishes\nin the limit of many observations"
    pages = [(k, 1, k, f"A Book on Kernels — Many Samples\n{body}\n{k - 6}") for k in range(10, 40)]
    pages += [(60, 1, 20, f"A Bo~ok on Kernels — Many Samples\nthe estirnator of the vari-\nance holds\n17\n99\n14"), (61, 1, 21, None), (62, None, None, ""), (60, 1, 20, None)]
    paragraphs = [(1, 60, "the esti^mator of the vari-\n14\nA Book on Kernels — Many Samples\nance holds"), (2, 60, "over- and under-\nand more"), (3, None, None), (4, 999, "the ob5ervations vanish")]
    rows = {tuple(r) for r in scanned_rows(spark, pages, paragraphs).collect()}
    assert {("pages", 60, 1, "header", ""), ("pages", 60, 2, "misread", "estimator"), ("pages", 60, 2, "hyphen", "variance"), ("pages", 60, 6, "page_number", "")} == {r for r in rows if r[:2] == ("pages", 60)}
    assert {r for r in rows if r[0] == "paragraphs"} == {("paragraphs", 1, 1, "misread", "estimator"), ("paragraphs", 1, 1, "hyphen", "variance"), ("paragraphs", 1, 2, "page_number", ""), ("paragraphs", 1, 3, "header", ""), ("paragraphs", 4, 1, "misread", "observations")}
    assert Counter(r[3] for r in rows if r[0] == "pages" and r[1] < 60) == {"header": 30, "page_number": 30}


def test_scanned_nothing(spark):
    assert scanned_rows(spark, [], []).collect() == []


def test_page_numbers():
    assert scanned.page_number("- iv -") == (True, 4, True)
    assert scanned.page_number("[l2]") == (True, 12, False)
    assert scanned.page_number("32 / 115")[0] and not scanned.page_number("75")[0]
    assert scanned.page_number("words") is None and math.isclose(lines.roman("xiv"), 14)


def test_reassembly():
    text = "HEAD\nThe esti^mator of the vari-\n14\nance, holds here.\n7  8  9\nA new para-\ngraph that is as wide as all others"
    cases = [(1, "header", "", None, None), (2, "misread", "estimator", 1, "esti^mator"), (2, "hyphen", "variance", None, None), (3, "page_number", "", None, None), (6, "hyphen", "paragraph", None, None)]
    assert scanned.reassemble(text, cases) == "The estimator of the variance, holds here.\n\n7 8 9\n\nA new paragraph that is as wide as all others"
    assert scanned.reassemble("", []) == ""


def test_reassembly_touches_the_found_word_only():
    assert scanned.reassemble("dogs eat the c^at here", [(1, "misread", "cat", 3, "c^at")]) == "dogs eat the cat here"
    twice = [(1, "misread", "cat", 1, "c^at"), (1, "misread", "cat", 4, "c^at")]
    assert scanned.reassemble("a c^at and a C^at, here", [twice[0], (1, "misread", "cat", 4, "c^at")]) == "a cat and a Cat, here"
    assert scanned.reassemble("a c^at and a c^at here", twice) == "a cat and a cat here"
    assert scanned.reassemble("a b", [(1, "misread", "x", 7, "z")]) == "a b"


def test_known_damage_is_undone():
    rnd = random.Random(11)
    words = "the estimator of variance holds under repeated sampling and every kernel shrinks towards its limit".split()
    for _ in range(60):
        paragraphs = [[rnd.choice(words) for _ in range(rnd.randrange(25, 60))] for _ in range(2)]
        for p in paragraphs:
            p[0], p[-1] = p[0].capitalize(), p[-1] + "."
        out, cases = [], []
        for p in paragraphs:
            line, begun = [], 0
            for k, word in enumerate(p):
                plain = word.strip(".").lower()
                if len(plain) > 4 and rnd.random() < 0.2:
                    bad = word[:2] + "^" + word[2:]
                    cases.append((len(out) + 1, "misread", plain, len(line), bad.strip(".").lower()))
                    word = bad
                if len(line) == 8 and k < len(p) - 1:
                    if "^" not in word and len(word) > 5 and not word.endswith(".") and rnd.random() < 0.7:
                        cases.append((len(out) + 1, "hyphen", plain, None, None))
                        out.append(" ".join([*line, word[:3] + "-"]))
                        begun = 1
                        line = [word[3:]]
                    else:
                        out.append(" ".join([*line, word]))
                        line = []
                    if rnd.random() < 0.2:
                        out.append(str(rnd.randrange(99)))
                        cases.append((len(out), "page_number", "", None, None))
                else:
                    line.append(word)
            if line:
                out.append(" ".join(line))
        clean = scanned.reassemble("\n".join(out), cases).split()
        assert clean == [w for p in paragraphs for w in p]


def test_line_model_learns_from_order():
    rnd = random.Random(3)
    header = "Stratified Symmetries"
    look = lines.looks([header, "the estimator shrinks towards its limit"], lambda key: False, True)[0]
    assert look[0] != lines.PLAIN_LOOK == look[1]
    page = lambda top: (1, np.array([look[0]] * top + [0] * 9 + [lines.MARKED]), np.zeros((top + 10, 4), np.int64))
    model = lines.LineModel.prior().fit([page(int(rnd.random() < 0.8)) for _ in range(300)])
    assert model.labels([look[0], *[0] * 9, lines.MARKED], True) == "h" + "b" * 9 + "n"
    assert np.allclose(np.exp(model.step).sum(-1), 1) and np.allclose(np.exp(model.begin).sum(-1), 1)
    assert np.exp(model.begin[1][lines.H]) > 0.5
    assert lines.LineModel.prior().fit([]).labels([0, 0], False) == "bb"


def test_breaks_by_layout():
    body = ["It follows that the summary stabilises the experiment,", "so the comparison has to be made with care.", "Here the quadratic regulariser governs the simulation and", "every slope."]
    assert lines.LineModel.prior().breaks(body) == [True, False, True, False]
    assert lines.LineModel.prior().breaks([]) == []
