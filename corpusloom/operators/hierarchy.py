"""Parent-child links to full hierarchies, by tree contraction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans import cut, hot_keys, lookup_join
from corpusloom.plans.skew import coin

#: When no more links than this are left, one task contracts them; before that, each round is a distributed step.
FINISH = 20_000
#: Characters of paths after which that task hands on what it has.
_FLUSH = 8 << 20
_OUT = ["id", "root_id", "depth", "path", "status", "line", "size"]


def clean_number(number: Column) -> Column:
    """A section number in one form: digits and letters joined by single dots, whatever marks surround it."""
    wide = "０１２３４５６７８９．ＡＢＣＤＥＦＧＨ"
    plain = F.upper(F.translate(number, wide, "0123456789.ABCDEFGH"))
    plain = F.regexp_replace(plain, r"^[^0-9A-Z]*(?:SECTION|SECT|SEC|CHAPTER|CHAP|CH|APPENDIX|APP)(?![A-Z])", "")
    plain = F.regexp_replace(plain, r"[^0-9A-Z.]+", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\.{2,}", "."), r"^\.|\.$", "")
    return F.when(plain != "", plain)


def number_parents(sections: DataFrame) -> DataFrame:
    """(id, parent) of each section: its parent_id, or else the section of its book numbered one component less.

    Repeated ids count once. If several sections of a book bear the wanted number, the smallest id is the parent.
    """
    s = sections.select("id", "textbook_id", "parent_id", clean_number(F.col("number")).alias("number")).where("id is not null")
    s = s.groupBy("id").agg(*(F.min(F.struct(F.col(c).isNull(), c))[c].alias(c) for c in ("textbook_id", "parent_id", "number")))
    place = lambda number: F.when(F.col("textbook_id").isNotNull() & number.isNotNull(), F.concat_ws(" ", "textbook_id", number))
    wanted = F.when(F.col("parent_id").isNull() & F.col("number").contains("."), F.regexp_replace("number", r"\.[^.]*$", ""))
    s = cut(s.select("id", "parent_id", place(F.col("number")).alias("own"), place(wanted).alias("place")))
    numbered = s.where("own is not null").groupBy(F.col("own").alias("place")).agg(F.min("id").alias("by_number"))
    return lookup_join(s.select("id", "parent_id", "place"), numbered, "place").select("id", F.coalesce("parent_id", "by_number").alias("parent"))


def hierarchy(links: DataFrame, id_col: str = "id", parent_col: str = "parent", finish: int = FINISH) -> DataFrame:
    """(id, root_id, depth, path, status, line, size) of each node of ``links``.

    Rounds of tree contraction: leaves are raked off, nodes with one remaining child are spliced out of their
    chain (an independent set of them, by coins), until nothing with a parent is left. A splice that leaves a node
    as its own parent exposes a circle. The recorded contractions are then undone in reverse, each node taking
    what its anchor by then has. The number of rounds is logarithmic in the size, whatever the depth; once at most
    ``finish`` links are left, a single task contracts them to the end, with the same result.

    status is tree, cycle (on a circle; root_id its smallest id, depth -1, path 'cycle') or below (leads up into
    a circle; path 'below'; line has the ids from the circle down to it). size counts the node and all that lead up to
    it, on a circle all of the circle and below it; it is added up while contracting, so no path is taken apart for it.
    A node whose parent is null or no node is a root. Rows with a null id are left out, an id that stands twice counts
    once (the smallest non-null parent), an empty table gives an empty result.
    """
    nodes = links.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("id is not null")
    nodes = cut(nodes.groupBy("id").agg(F.min("parent").alias("parent")))
    hot = cut(hot_keys(nodes, "parent").select(F.col("parent").alias("anchor")))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    nodes = cut(lookup_join(nodes, known, "parent", hot=hot.select(F.col("anchor").alias("parent"))).withColumn("parent", F.when(F.col("known"), F.col("parent"))).drop("known"))
    text = F.col("id").cast("string")
    active = nodes.where("parent is not null").select("id", "parent", text.alias("seg"), F.lit(1).alias("len"), F.col("id").alias("least"), F.lit(1).cast("long").alias("own"), F.lit(0).cast("long").alias("between"))

    records: list[DataFrame] = []
    raked: list[DataFrame] = []
    cores: list[DataFrame] = []
    left = active.count()
    while left > finish:
        state = cut(_contract(active, len(records)))
        fates = {r["fate"]: r["count"] for r in state.groupBy("fate").count().collect()}
        if "core" in fates:
            cores.append(state.where("fate = 'core'").select("id", "least", (F.col("own") + F.col("between")).alias("size")))
        if "leaf" in fates:
            raked.append(state.where("fate = 'leaf'").groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("own") + F.col("between")).alias("n")))
        records.append(state.where("fate in ('leaf', 'splice')"))
        active = state.where("fate = 'live'").select(*active.columns)
        left = fates.get("live", 0)
    if left:
        ended = cut(active.coalesce(1).mapInPandas(_finish, "id long, anchor long, seg string, len int, least long, own long, between long, fate string"))
        cores.append(ended.where("fate = 'core'").select("id", "least", (F.col("own") + F.col("between")).alias("size")))
        raked.append(ended.where("fate = 'top'").groupBy(F.col("anchor").alias("id")).agg(F.sum(F.col("own") + F.col("between")).alias("n")))
        records.append(ended.where("fate in ('top', 'leaf')").select("id", F.col("anchor").alias("parent"), "seg", "len", "least", "own", "between", F.lit("leaf").alias("fate"), F.lit(None).cast("long").alias("via")))
    # A root is raked into by what the rounds took off directly below it; what they took off elsewhere is in `own` there.
    roots = nodes.where("parent is null").select("id", text.alias("path"))
    under = _sum(raked, links).select("id", "n")
    done = roots.join(under, "id", "left").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), "path", F.lit("tree").alias("status"), F.lit(None).cast("string").alias("line"), (F.coalesce("n", F.lit(0)) + 1).alias("size"))
    for c in cores:
        done = done.unionByName(c.select("id", F.col("least").alias("root_id"), F.lit(-1).alias("depth"), F.lit("cycle").alias("path"), F.lit("cycle").alias("status"), text.alias("line"), "size"))
    done = cut(done)
    for k, record in enumerate(reversed(records)):
        part = _undo(record, done, hot)
        done = done.unionByName(cut(part) if k + 1 < len(records) else part)
    return done


def _sum(parts: list[DataFrame], links: DataFrame) -> DataFrame:
    if not parts:
        return links.sparkSession.createDataFrame([], "id long, n long")
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("n").alias("n"))


def _contract(active: DataFrame, round_no: int) -> DataFrame:
    """The active links with their fate in this round; those that live on with their new parent.

    own counts the node and all raked into it, between what was spliced out between it and its parent. A node that
    loses leaves in this round is not spliced in it, so no anchor goes in the same round as its records, and a node on a
    circle is its core only once nothing else hangs on it. A record of a splice keeps in own what it adds to the size of
    its child.
    """
    inner = active.groupBy(F.col("parent").alias("id")).agg(F.lit(True).alias("inner"))
    marked = active.join(inner, "id", "left")
    leaf = F.col("inner").isNull()
    kids = marked.groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("all_kids"), F.count(F.when(~leaf, 1)).alias("kids"), F.min(F.when(~leaf, F.col("id"))).alias("child"),
        F.sum(F.when(leaf, F.col("own") + F.col("between")).otherwise(0)).alias("gain"),
    )
    rest = marked.where("inner").drop("inner").join(kids, "id", "left")
    heads = (coin(F.col("id"), round_no) == 1) & (coin(F.col("child"), round_no) == 0)
    single = (F.col("all_kids") == 1) & (F.col("kids") == 1)
    fate = F.when(F.col("id") == F.col("parent"), F.when(single, "core").otherwise("live")).when(single & heads, "splice").otherwise("live")
    rest = rest.withColumn("fate", fate)
    taken = rest.where("fate = 'splice'").select(F.col("child").alias("id"), F.col("parent").alias("up"), F.col("seg").alias("up_seg"), F.col("len").alias("up_len"), F.col("least").alias("up_least"), (F.col("own") + F.col("between")).alias("up_size"))
    rest = rest.join(taken, "id", "left")
    moved = F.col("up").isNotNull()
    spliced = F.col("fate") == "splice"
    rest = rest.select(
        "id",
        F.coalesce("up", "parent").alias("parent"),
        F.when(moved, F.concat_ws("/", "up_seg", "seg")).otherwise(F.col("seg")).alias("seg"),
        (F.col("len") + F.coalesce("up_len", F.lit(0))).alias("len"),
        F.least("least", "up_least").alias("least"),
        (F.col("own") + F.col("gain")).alias("own"),
        (F.col("between") + F.coalesce("up_size", F.lit(0))).alias("between"),
        "fate",
        F.when(spliced, F.col("child")).alias("via"),
    )
    # what stands between a spliced node's child and the node counts to the node's size, not to the child's
    gap = marked.select(F.col("id").alias("via"), F.col("between").alias("gap"))
    cut_out = rest.where(spliced).join(gap, "via", "left").select("id", "parent", "seg", "len", "least", (F.col("own") + F.coalesce("gap", F.lit(0))).alias("own"), "between", "fate", "via")
    leaves = marked.where(leaf).select("id", "parent", "seg", "len", "least", "own", "between", F.lit("leaf").alias("fate"), F.lit(None).cast("long").alias("via"))
    return rest.where(~spliced).unionByName(cut_out.select(*rest.columns)).unionByName(leaves)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last links contracted in one task: leaves are raked until none is left, what remains are circles.

    Undone in reverse, depth first: each node gets the node above it that has no active link, or lies on a circle, as
    its anchor, and the piece of path from there. fate is top (directly below its anchor), leaf or core.
    """
    columns = ["id", "anchor", "seg", "len", "least", "own", "between", "fate"]
    rows = {r.id: r for b in batches for r in b.itertuples(index=False)}
    own = {i: int(r.own) for i, r in rows.items()}
    kids: dict[int, list[int]] = {}
    for i, r in rows.items():
        kids.setdefault(r.parent, []).append(i)
    waiting = {i: len(kids.get(i, ())) for i in rows}
    leaves = [i for i, n in waiting.items() if not n]
    on_ring = set(rows)
    while leaves:
        i = leaves.pop()
        on_ring.discard(i)
        up = rows[i].parent
        if up in rows:
            own[up] += own[i] + int(rows[i].between)
            waiting[up] -= 1
            if not waiting[up]:
                leaves.append(up)
    out, held, seen = [], 0, set()
    for start in on_ring:
        ring = []
        while start not in seen:
            seen.add(start)
            ring.append(start)
            start = rows[start].parent
        least, size = min((rows[i].least for i in ring), default=0), sum(own[i] + int(rows[i].between) for i in ring)
        out += [(i, None, "", 0, least, size, 0, "core") for i in ring]
    # (node, anchor, path above it, links above it), the anchor's own children first
    stack = [(i, r.parent, "", 0) for i, r in rows.items() if i not in on_ring and (r.parent not in rows or r.parent in on_ring)]
    while stack:
        i, anchor, above, links = stack.pop()
        r = rows[i]
        seg = f"{above}/{r.seg}" if above else r.seg
        links += int(r.len)
        out.append((i, anchor, seg, links, r.least, own[i], int(r.between), "top" if r.parent == anchor else "leaf"))
        held += len(seg)
        stack += [(k, anchor, seg, links) for k in kids.get(i, ())]
        if held > _FLUSH:
            yield pd.DataFrame(out, columns=columns).astype({"anchor": "Int64"})
            out, held = [], 0
    yield pd.DataFrame(out, columns=columns).astype({"anchor": "Int64"})


def _undo(record: DataFrame, done: DataFrame, hot: DataFrame) -> DataFrame:
    """The nodes contracted in one round, resolved through their anchors, all of which are in ``done``.

    What was spliced out above a node on a circle lies on the circle, and has its size; other spliced nodes add their
    own to their child's.
    """
    anchors = done.select(F.col("id").alias("anchor"), "root_id", F.col("depth").alias("up_depth"), F.col("path").alias("up_path"), F.col("status").alias("up_status"), F.col("line").alias("up_line"))
    children = done.select(F.col("id").alias("via"), (F.col("status") == "cycle").alias("ring"), F.col("size").alias("child_size"))
    spliced = record.where("via is not null").join(children, "via", "left")
    spliced = spliced.withColumn("size", F.when(F.col("ring"), F.col("child_size")).otherwise(F.col("own") + F.col("child_size"))).drop("child_size")
    rows = record.where("via is null").withColumns({"ring": F.lit(False), "size": F.col("own")}).unionByName(spliced.select(*record.columns, "ring", "size"))
    rows = lookup_join(rows.select("id", F.col("parent").alias("anchor"), "seg", "len", "ring", "size"), anchors, "anchor", "inner", hot)
    status = F.when(F.col("up_status") == "tree", "tree").when(F.col("ring"), "cycle").otherwise("below")
    return rows.select(
        "id",
        "root_id",
        F.when(status == "tree", F.col("up_depth") + F.col("len")).otherwise(-1).alias("depth"),
        F.when(status == "tree", F.concat_ws("/", "up_path", "seg")).otherwise(status).alias("path"),
        status.alias("status"),
        F.when(status == "cycle", F.col("id").cast("string")).when(status == "below", F.concat_ws("/", "up_line", "seg")).alias("line"),
        "size",
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant, distance): every node under every node of a result of :func:`hierarchy`.

    One row per ancestor of each node, as many in all as the sum of the depths. Nodes at or below a circle have none.
    """
    ids = F.split("path", "/")
    up = tree.where("status = 'tree' and depth > 0").select(F.col("id").alias("descendant"), F.posexplode(F.slice(ids, F.lit(1), F.size(ids) - 1)).alias("pos", "id"), "depth")
    return up.select(F.col("id").cast("long").alias("id"), "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def all_descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant): every other node that leads up to each node of a result of :func:`hierarchy`, circles included.

    A node on a circle has all others of its circle and all nodes below it; a node below a circle has its subtree.
    """
    line = F.split("line", "/")
    under = tree.where("status = 'below' and size(split(line, '/')) > 2").select(F.explode(F.slice(line, F.lit(2), F.size(line) - 2).cast("array<bigint>")).alias("id"), F.col("id").alias("descendant"))
    ring = tree.where("status = 'cycle'").select("id", "root_id")
    led = tree.where("status <> 'tree'").select(F.col("id").alias("descendant"), "root_id")
    around = ring.join(led, "root_id").where("id <> descendant").select("id", "descendant")
    return descendants(tree).select("id", "descendant").unionByName(under).unionByName(around)


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(id, descendants): how many other nodes lead up to each node, as the contractions added them up."""
    return tree.select("id", (F.col("size") - 1).alias("descendants"))
