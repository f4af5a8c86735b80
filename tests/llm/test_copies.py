"""Copies of a text count once."""

import random

from corpusloom.llm import scanned, truncation


def test_copies_do_not_vouch_for_a_cut_end(spark):
    rnd = random.Random(6)
    heads = ["the smoother", "a kernel", "this estimator", "one sample", "every loss"]
    tails = ["vanishes in the limit of large samples", "is reported with its uncertainty", "shrinks over the whole range", "needs no further adjustment at all"]
    whole = [f"{rnd.choice(heads)} number {k} {rnd.choice(tails)}." for k in range(1500)]
    cut = [f"{heads[k % 5]} {'abcdefghij'[k]} {tails[k % 4][: 12 + k]}" for k in range(8)]
    copied = [("t", 2000 + 1000 * k + n, "src", t) for k, t in enumerate(cut) for n in range((1, 2, 3, 40, 700, 2, 3, 1)[k])]
    stopped = [("t", 20000 + k, "src", t + "...") for k, t in enumerate(cut)]

    def verdict(rows):
        return {r.row_id: r.cut for r in truncation.truncated(spark.createDataFrame(rows, "table_name string, row_id long, source string, text string")).collect()}

    sound = [("t", k, "src", t) for k, t in enumerate(whole)]
    got = verdict([*sound, *sound[:300], *copied, *stopped])
    assert all(got[r[1]] for r in copied + stopped) and not any(got[r[1]] for r in sound)
    once = verdict([*sound, *(r for r in copied if r[1] % 1000 == 0)])
    assert all(once[k] == got[k] for k in once)


def damage(spark, pages, paragraphs):
    rows, _ = scanned.damage(spark.createDataFrame(pages, "id long, textbook_id long, page_number int, raw_text string"), spark.createDataFrame(paragraphs, "id long, page_id long, text string"))
    return {tuple(r) for r in rows.select("table_name", "row_id", "line_no", "kind", "word").collect()}


def test_copies_do_not_make_a_misreading_common(spark):
    pages = [(k, 1, k, f"the estimator of the variance holds\nand sample {'abcdefghijklmnopqrstuvwxyzabcdefghijklmn'[k]}{k} vanishes") for k in range(40)]
    rows = damage(spark, pages, [(k, 1, "the estirnator of the vari-\nance holds") for k in range(300)])
    assert {r[1] for r in rows if r[3:] == ("misread", "estimator")} == set(range(300))
    assert {r[1] for r in rows if r[3:] == ("hyphen", "variance")} == set(range(300))


def test_headers_by_book_and_distinct_page(spark):
    head, body = "Notes on many kernels", "the estimator of the variance holds\nand every sample vanishes"
    own = [(k, 1, k, f"{head}\n{body} {k}") for k in range(4)]
    others = [(10 + k, 2 + k, k, f"Rates of Slow Samples\n{body} {k}") for k in range(4)]
    copies = [(20 + k, 9, 5, f"Losses of Wide Trees\n{body}") for k in range(5)]
    foreign = [(30, 8, 1, f"{head}\n{body}")]
    pages = [r for r in own + others + copies + foreign]
    seen = scanned._gather(spark.createDataFrame([("pages", r[0], r[0], *r[1:]) for r in pages], "table_name string, row_id long, page_id long, book long, page int, text string")).where("kind = 'h' and n >= 3")
    assert {r.key.split("\t")[0] for r in seen.collect()} == {"1"}
    parts = [(1, 0, f"{body}\nNotes on Many Kernels\n{body}"), (2, 30, f"{body}\nNotes on Many Kernels\n{body}"), (3, 999, f"{body}\nNotes on Many Kernels\n{body}")]
    found = {(r[0], r[1]) for r in damage(spark, pages, parts) if r[3] == "header"}
    assert {r for r in found if r[0] == "paragraphs"} == {("paragraphs", 1), ("paragraphs", 3)}
