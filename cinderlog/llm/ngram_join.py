"""Exact Jaccard self-join of word n-gram sets that skips by relations between sets.

Equal sets are one class. Shingles have one order over the corpus, frequent ones last, and two sets that link share one of their
first few shingles, so only those are indexed: a list for each shingle.

* *Blocks of a list.* Entries are grouped by the size of the set and by how many shingles the set has from that place on. No pair of
  a block pair can link if those remainders or sizes do not allow it; such block pairs are skipped without looking at entries.
* *Answers from answers.* Sets that lead to each other through their lists get one hub, and every set of the group is compared with
  it. What a set has more and less than the hub is its difference, and the differences of two sets tell their overlap:
  ``|x ^ y| = |dx| + |dy| - 2 |dx & dy|``. So within a group, links follow from the answers of the hub and a join of the small
  differences: where two differences are small enough the pair links without a look at it, elsewhere the differences have to
  share elements, rare ones first, and have lists of their own. Pairs of one component are not looked at again.

Nothing is capped: a list as long as the corpus is a list like any other, spread over tasks by the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, lean, mixed, texts_of, written
from .components import components
from .shingles import shingle_sets

#: The most frequent shingles that are put last; which they are only matters for speed.
FREQUENT = 1 << 18
#: Buckets of the filter that goes before a join with texts.
FILTER = 1 << 18
_HELD = 2_000_000
#: Rows of a batch whose texts and sets a task holds at once.
ROWS = 512
#: Sets that a task compares with their hub one after the other.
MEMBERS = 500
_CLASHES = 1000
_LIGHT = 1 << 61  # added to frequent shingles, whose hashes have 61 bits then


def prefix(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` that have to be indexed."""
    return n - -(-n * percent // 100) + 1


def fingerprint(s: np.ndarray) -> tuple[int, int, int, int]:
    """Two sums over the set, which with its size tell it from all others, and two numbers made from them."""
    a = mixed(s + np.uint64(0x1B873593)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D)))
    made = np.array([a ^ (b << np.uint64(1)) ^ np.uint64(len(s)), b ^ (a << np.uint64(3)) ^ np.uint64(~len(s) & (2**64 - 1))], np.uint64)
    return tuple(int(np.int64(np.uint64(x).astype(np.int64))) for x in (a, b, *mixed(made)))


def _pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of ``ROWS``, so that what is made of their texts stays small."""
    for part in parts:
        for i in range(0, part.num_rows, ROWS):
            yield part.slice(i, ROWS)


_ROW = ("doc_id", "t1", "t2", "n", "a", "b", "node", "other")


def _summaries(words: int):
    """A row for each text, and rows of shingles that a task saw in several different sets."""

    @lean
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def several() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            value, count = value[count > 1].astype(np.int64), count[count > 1]
            none = pa.nulls(len(value), pa.int64())
            flag = pa.array(np.zeros(len(value), bool))
            return pa.RecordBatch.from_arrays([flag, *[none] * len(_ROW), pa.array(value), pa.array(count)], names=names)

        for part in _pieces(parts):
            rows = []
            ids = [part.column(i).to_pylist() for i in range(3)]
            for own, s in zip(zip(*ids), shingle_sets(texts_of(part.column(3)), words)):
                if not len(s):
                    rows.append((*own, 0, None, None, None, None))
                    continue
                marks = fingerprint(s)
                rows.append((*own, len(s), *marks))
                if marks[:2] not in seen:
                    if len(seen) > _HELD:
                        seen.clear()
                    seen.add(marks[:2])
                    held.append(s)
                    size += len(s)
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(_ROW))]
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows), bool)), *columns, none, none], names=names)
            if size > _HELD:
                yield several()
                held, size = [], 0
        yield several()

    names = ["is_row", *_ROW, "shingle", "count"]
    return run, "is_row boolean, " + ", ".join(f"{c} long" for c in names[1:])


def _frequent(summary: DataFrame) -> np.ndarray:
    """At most FREQUENT shingles that are more frequent than all others, from a histogram of their counts."""
    often = written(summary.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("n")), "often")
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    least, held = None, 0
    for row in often.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some hundred rows
        held += row["count"]
        if held > FREQUENT:
            break
        least = row["step"]
    found = often.where(step >= least).select("shingle").toPandas()["shingle"].to_numpy(np.int64) if least is not None else np.zeros(0, np.int64)
    discard(often)
    return np.sort(found.astype(np.uint64))


def _repeated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order of shingle and set: each once, and only shingles of several sets. All of frequent shingles are handed on."""
    last, before, given = None, None, False  # the shingle, its entry met last, and whether that went on
    for part in parts:
        if not part.num_rows:
            continue
        shingle, node, place = (part.column(i).to_numpy() for i in range(3))
        if before is not None:
            shingle, node, place = (np.concatenate([[x], c]) for x, c in zip(before, (shingle, node, place)))
        same = shingle[1:] == shingle[:-1]
        again = np.concatenate([[False], same & (node[1:] == node[:-1])])
        # The first row was met before if there was one: it goes on unless it did already.
        fresh = np.flatnonzero(~again)
        s = shingle[fresh]
        pair = s[1:] == s[:-1]
        keep = np.concatenate([[False], pair]) | np.concatenate([pair, [False]]) | (s >= _LIGHT)
        keep[0] |= given
        out = keep.copy()
        if before is not None and given:
            out[0] = False
        chosen = fresh[out]
        if len(chosen):
            yield pa.RecordBatch.from_arrays([pa.array(c[chosen]) for c in (shingle, node, place)], names=["shingle", "node", "place"])
        end = fresh[-1]
        before, given = (shingle[end], node[end], place[end]), bool(keep[-1])


def _ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Shingles in the corpus order, as numbers: frequent ones above the others."""
    at = np.searchsorted(frequent, s)
    late = (at < len(frequent)) & (frequent[np.minimum(at, max(len(frequent) - 1, 0))] == s) if len(frequent) else np.zeros(len(s), bool)
    return np.sort((s >> np.uint64(1)) + np.where(late, np.uint64(_LIGHT), np.uint64(0)))


def _enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of sizes ``n`` and ``m`` with this overlap link: ``100 * overlap >= percent * union``."""
    return overlap * (100 + percent) >= (n + m) * percent


def _centred(members: DataFrame) -> DataFrame:
    """Differences from the middle of each group: what most of its members have more or less than the hub is part of no difference then.

    A hub is a changed copy like the others. Its own changes are in the difference of everyone else, where they look rare. Which set the
    members are held against does not matter to what their differences tell.
    """
    sizes = members.groupBy("hub").agg(F.count("*").alias("members"))
    often = members.select("hub", F.explode("difference").alias("shingle")).groupBy("hub", "shingle").agg(F.count("*").alias("c"))
    often = often.join(sizes, "hub").where(F.col("c") * 2 > F.col("members")).groupBy("hub").agg(F.collect_list("shingle").alias("common"))
    moved = F.array_sort(F.concat(F.array_except("difference", "common"), F.array_except("common", "difference")))
    return members.join(often, "hub", "left").withColumn("difference", F.when(F.col("common").isNull(), F.col("difference")).otherwise(moved)).drop("common")


def link(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, t1, t2, n_shingles, component_id`` for every row of ``docs``, which should be a table (it is read more than once).

    ``t1`` and ``t2`` are two hashes of the text. Texts null, empty or blank have no shingles and link with nothing. Equal texts link,
    repeated rows too; rows are nodes, so an id that appears with several texts joins none of them. ``component_id`` is the smallest id of
    the component, for a row alone its own. A very long text is read in parts; its set is held as 8 bytes a shingle. Other columns, whatever
    their names, are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    # A text is known by two hashes of it, whichever scan and partition it comes from.
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.lit(1), F.col(text)).alias("t1"), F.xxhash64(F.lit(2), F.col(text)).alias("t2"),
        F.col(text).alias("text"),
    )
    run, schema = _summaries(words)
    summary = written(rows.mapInArrow(run, schema), "summaries")
    sets = summary.where("is_row")
    classes = sets.where("node IS NOT NULL").groupBy("a", "b", "n").agg(
        F.min("node").alias("node"), F.min("other").alias("other"), F.min(F.struct("t1", "t2", "doc_id")).alias("t"), F.min("doc_id").alias("first")
    )
    classes = written(classes, "classes")
    # Different sets with one number (two among some billions): these sets take their other number.
    clashes = {r.node for r in classes.groupBy("node").count().where("count > 1").select("node").limit(_CLASHES + 1).collect()}
    if len(clashes) > _CLASHES:
        raise RuntimeError("too many different sets have one number; choose other constants for the fingerprint")
    if clashes:
        number = F.when(F.col("node").isin(*clashes), F.col("other")).otherwise(F.col("node"))
        classes, sets = classes.withColumn("node", number), sets.withColumn("node", number)
    classes = classes.select("node", "n", "first", "t.t1", "t.t2", F.col("t.doc_id").alias("held"))
    frequent = spark.sparkContext.broadcast(_frequent(summary))

    @lean
    def entries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first shingles of every set: shingle, set, and its size and the place in one number."""
        seen = set()
        for part in _pieces(parts):
            held = []
            for s in shingle_sets(texts_of(part.column(0)), words):
                if not len(s):
                    continue
                _, _, node, other = fingerprint(s)
                node = other if node in clashes else node
                if node in seen:
                    continue
                if len(seen) > _HELD:
                    seen.clear()
                seen.add(node)
                own = _ordered(s, frequent.value)[: prefix(len(s), percent)]
                held.append((own.astype(np.int64), np.full(len(own), node, np.int64), (len(s) << 31) + np.arange(len(own), dtype=np.int64)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["shingle", "node", "place"])

    entry = "shingle long, node long, place long"
    # Most shingles are in one set only. Their entries go on the way: the lists of the few frequent shingles are dealt to several tasks,
    # the others are no longer than the least frequent of these.
    salt = F.when(F.col("shingle") >= _LIGHT, F.pmod("node", F.lit(64))).otherwise(0)
    index = rows.select("text").mapInArrow(entries, entry).repartition("shingle", salt).sortWithinPartitions("shingle", "node")
    band = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(100 / percent)))
    lists = index.mapInArrow(_repeated, entry).select("shingle", "node", F.shiftright("place", 31).alias("n"), F.col("place").bitwiseAND((1 << 31) - 1).alias("at"))
    lists = written(lists.withColumn("band", band(F.col("n")).cast("int")), "lists")

    def with_texts(wanted: DataFrame, label: str) -> DataFrame:
        """The columns of ``wanted``, numbers among which is ``node``, and ``text``, one text of each class."""
        names = wanted.columns
        # At most FILTER numbers go to every task, to leave most other texts, and most copies of these, where they are.
        bucket = lambda key: F.pmod(F.xxhash64(key, "t1"), F.lit(FILTER)).alias("bucket")
        wanted = written(wanted.join(classes.select("node", "t1", "t2", "held"), "node"), label)
        few = F.broadcast(wanted.select(bucket("held")).distinct())
        chosen = rows.select("t1", "t2", "text", bucket("doc_id")).join(few, "bucket", "left_semi").dropDuplicates(["t1", "t2"])
        return chosen.join(wanted, ["t1", "t2"]).select(*names, "text")

    def sets_of_texts(part: pa.RecordBatch, at: int) -> list[np.ndarray]:
        return [_ordered(s, frequent.value).astype(np.int64) for s in shingle_sets(texts_of(part.column(at)), words)]

    def compared(pairs: DataFrame, label: str) -> DataFrame:
        """``x, y, n, m, o``: sizes and overlap of every pair, counted."""

        def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _pieces(parts):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets_of_texts(part, 1), pa.list_(pa.int64()))], names=["node", "s"])

        wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        own = written(with_texts(wanted, f"{label}-texts").mapInArrow(whole, "node long, s array<long>"), label)
        both = pairs.select("x", "y").join(own.select(F.col("node").alias("x"), F.col("s").alias("sx")), "x")
        both = both.join(own.select(F.col("node").alias("y"), F.col("s").alias("sy")), "y")
        overlap = F.size(F.array_intersect("sx", "sy")).cast("long").alias("o")
        both = written(both.select("x", "y", F.size("sx").cast("long").alias("n"), F.size("sy").cast("long").alias("m"), overlap), f"{label}-pairs")
        discard(own)
        return both

    def apart_from_hub(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``node, hub, s``: what a set has more and less than its hub, null if that is too much; a hub's text comes before those of its sets."""
        held = None
        for part in _pieces(parts):
            found = []
            for node, hub, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets_of_texts(part, 2)):
                if node == hub:
                    held = s
                else:
                    difference = np.setxor1d(s, held, assume_unique=True)
                    found.append((node, hub, difference if len(difference) * (100 + percent) <= 2 * (len(s) + len(held)) * (100 - percent) else None))
            columns = [*zip(*found)] if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["node", "hub", "s"])

    def close_to(hubs: DataFrame) -> DataFrame:
        """``x, y, n, m, difference`` of sets ``x`` and their hubs ``y`` that are within two link distances; the differences of others say little.

        Sizes that differ by more rule out most others before their sets are made. A text is sent once, a hub's once for each MEMBERS sets.
        """
        near = lambda d: d * (100 + percent) <= 2 * (F.col("n") + F.col("m")) * (100 - percent)
        sized = hubs.join(classes.select(F.col("node").alias("x"), "n"), "x").join(classes.select(F.col("node").alias("y"), F.col("n").alias("m")), "y")
        pairs = sized.where((F.col("x") != F.col("y")) & near(F.abs(F.col("n") - F.col("m")))).select(F.col("x").alias("node"), F.col("y").alias("hub"), "n", "m")
        pairs = written(pairs, "hub-sets-sized")
        shares = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).alias("shares"))
        members = pairs.join(shares, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("shares")).alias("share"))
        middle = shares.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
        sent = with_texts(members.unionByName(middle), "hub-texts").repartition("hub", "share").sortWithinPartitions("hub", "share", F.col("node") != F.col("hub"))
        own = written(sent.select("node", "hub", "text").mapInArrow(apart_from_hub, "node long, hub long, s array<long>"), "hub-sets")
        both = own.where("s IS NOT NULL").join(pairs, ["node", "hub"]).select(F.col("node").alias("x"), F.col("hub").alias("y"), "n", "m", F.col("s").alias("difference"))
        both = written(both, "close-pairs")
        discard(pairs, own)
        return both

    # Leaders: of each list and size band the set with fewest shingles of its own in front; a set takes the leader that it
    # meets most often, in its own band or the one below.
    front = lists.groupBy("node").agg(F.min("at").alias("front"))
    fronted = lists.join(front, "node")
    lead = fronted.groupBy("shingle", "band").agg(F.min(F.struct("front", "node", "n")).alias("lead"))
    led = fronted.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).join(lead, ["shingle", "band"]).where(F.col("node") != F.col("lead.node"))
    led = led.groupBy("node", F.col("lead.node").alias("leader")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("lead.n").alias("m"), F.max("shingle").alias("last"))
    left_over = lambda n: F.floor(n * percent / 100 - 1e-9)  # what is not indexed, at most
    alike = _enough(F.col("c") + F.greatest(left_over(F.col("n")), left_over(F.col("m"))), F.col("n"), F.col("m"), percent)
    # Whoever meets a leader at a frequent shingle joins its group: long lists are left to the groups' differences.
    led = led.where(alike | (F.col("c") * 4 >= F.col("n") - left_over(F.col("n"))) | (F.col("last") >= _LIGHT))
    first = led.groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader")).select(F.col("node").alias("x"), F.col("leader").alias("y"))
    first = written(first, "leaders")
    groups = components(first.select(F.col("x").alias("a"), F.col("y").alias("b")))
    grouped = groups.select("node", "root").unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    hubs = first.groupBy(F.col("y").alias("node")).count().join(grouped, "node").groupBy("root").agg(F.max_by("node", F.struct("count", "node")).alias("y"))
    grouped = written(grouped.join(hubs, "root").select(F.col("node").alias("x"), "y"), "groups")
    discard(first, groups)
    # A hub keeps the sets close to it. Others are left to their lists.
    known = close_to(grouped)
    discard(grouped)
    grouped = written(known.select("x", "y").unionByName(known.select(F.col("y").alias("x"), "y").distinct()), "close-groups")

    # How far the difference of two members may reach: x and y link if 2 * |dx & dy| * (100 + percent) >= -(spare_x + spare_y).
    members = known.select(F.col("y").alias("hub"), F.col("x").alias("node"), "n", "difference")
    members = members.unionByName(known.select(F.col("y").alias("hub"), F.col("y").alias("node"), F.col("m").alias("n"), F.array().cast("array<bigint>").alias("difference")).dropDuplicates(["hub"]))
    members = _centred(members)
    members = members.withColumn("spare", F.col("n") * (100 - percent) - F.size("difference") * (100 + percent))
    best = members.groupBy("hub").agg(F.max(F.struct("spare", "node")).alias("best"))
    members = members.join(best, "hub").withColumn("central", F.col("spare") + F.col("best.spare") >= 0)
    members = written(members.select("hub", "node", "n", "difference", "spare", "central", F.col("best.node").alias("best")), "members")
    discard(known)
    # Whatever links without common differences links to the member with most to spare, too.
    linked = members.where("central AND node <> best").select(F.col("node").alias("a"), F.col("best").alias("b"))
    own = members.select("hub", "node", "spare", "central", F.size("difference").alias("d"), F.posexplode("difference").alias("at", "shingle"))
    own = own.withColumn("rest", F.col("d") - F.col("at"))
    one = members.select(F.col("node").alias("x"), F.col("difference").alias("dx"), F.col("spare").alias("spare_x"))
    two = members.select(F.col("node").alias("y"), F.col("difference").alias("dy"), F.col("spare").alias("spare_y"))

    def told(pairs: DataFrame) -> DataFrame:
        """Links among pairs of members, by their differences."""
        both = pairs.join(one, "x").join(two, "y")
        both = both.where(F.size(F.array_intersect("dx", "dy")) * 2 * (100 + percent) >= -(F.col("spare_x") + F.col("spare_y")))
        return both.select(F.col("x").alias("a"), F.col("y").alias("b"))

    # Copies of a changed copy: each meets the first of its list, so that their links among themselves need no pairs.
    chief = own.groupBy("hub", "shingle").agg(F.max(F.struct("spare", "node")).alias("chief"))
    meet = own.join(chief, ["hub", "shingle"]).where((F.col("node") != F.col("chief.node")) & ~F.col("central"))
    meet = meet.groupBy("node").agg(F.max_by("chief", F.struct("rest", "chief")).alias("early"), F.min_by("chief", F.struct("rest", "chief")).alias("late"))
    meet = meet.select(F.col("node").alias("x"), F.explode(F.array("early.node", "late.node")).alias("y")).distinct()
    linked = written(linked.unionByName(told(meet)), "first-links")
    parts = components(linked)
    own = own.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    near, far = own.where(F.col("rest") * (100 + percent) >= -F.col("spare")).alias("p"), own.alias("q")
    meet = near.join(far, (F.col("p.hub") == F.col("q.hub")) & (F.col("p.shingle") == F.col("q.shingle"))).where(
        ((F.col("p.spare") > F.col("q.spare")) | ((F.col("p.spare") == F.col("q.spare")) & (F.col("p.node") < F.col("q.node"))))
        & (F.col("p.root") != F.col("q.root"))
        & (F.least("p.rest", "q.rest") * 2 * (100 + percent) >= -(F.col("p.spare") + F.col("q.spare")))
    )
    meet = told(meet.select(F.col("p.node").alias("x"), F.col("q.node").alias("y")).distinct())
    first_links, linked = linked, written(linked.unionByName(meet), "group-links")
    roots = components(linked)
    discard(first_links, parts, members)

    # Lists that join different groups.
    apart = lists.dropDuplicates(["shingle", "node"]).join(roots, "node", "left").join(grouped.select(F.col("x").alias("node"), F.col("y").alias("hub")), "node", "left")
    apart = written(apart.withColumns({"root": F.coalesce("root", "node"), "hub": F.coalesce("hub", "node")}), "apart")
    discard(lists, roots, grouped)
    mixed_lists = apart.groupBy("shingle").agg(F.min("hub").alias("r"), F.max("hub").alias("q")).where("r <> q").select("shingle")
    rest = F.col("n") - F.col("at")
    # Blocks: size band, and a band of the remainder above the least that may matter.
    open_lists = written(apart.join(mixed_lists, "shingle").withColumn("rest", rest).withColumn("rb", F.floor(F.log(F.col("rest").cast("double")) / 0.02).cast("int")), "open-lists")
    blocks = open_lists.groupBy("shingle", "band", "rb").agg(
        F.max("rest").alias("rest"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("hub").alias("r"), F.max("hub").alias("q")
    )
    p, q = blocks.alias("p"), blocks.alias("q")
    pairs_of_blocks = p.join(q, F.col("p.shingle") == F.col("q.shingle")).where(
        (F.col("q.band") - F.col("p.band")).isin(0, 1)
        & ((F.col("p.band") < F.col("q.band")) | (F.col("p.rb") <= F.col("q.rb")))
        & ~((F.col("p.r") == F.col("p.q")) & (F.col("q.r") == F.col("q.q")) & (F.col("p.r") == F.col("q.r")))
        & (F.col("p.most") * 100 >= F.col("q.least") * percent) & (F.col("q.most") * 100 >= F.col("p.least") * percent)
        & _enough(F.least("p.rest", "q.rest"), F.col("p.least"), F.col("q.least"), percent)
    ).select(F.col("p.shingle").alias("shingle"), F.col("p.band").alias("band"), F.col("p.rb").alias("rb"), F.col("q.band").alias("band2"), F.col("q.rb").alias("rb2"))
    left = open_lists.select("shingle", "band", "rb", F.col("node").alias("x"), F.col("n"), F.col("rest").alias("rx"), F.col("root").alias("root_x"), F.col("hub").alias("hub_x"))
    right = open_lists.select("shingle", F.col("band").alias("band2"), F.col("rb").alias("rb2"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("rest").alias("ry"), F.col("root").alias("root_y"), F.col("hub").alias("hub_y"))
    same = (F.col("band") == F.col("band2")) & (F.col("rb") == F.col("rb2"))
    candidates = pairs_of_blocks.join(left, ["shingle", "band", "rb"]).join(right, ["shingle", "band2", "rb2"]).where(
        (F.col("root_x") != F.col("root_y")) & (F.col("hub_x") != F.col("hub_y")) & (~same | (F.col("x") < F.col("y")))
        & (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
        & _enough(F.least("rx", "ry"), F.col("n"), F.col("m"), percent)
    )
    candidates = written(candidates.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "candidates")
    discard(open_lists)
    # Sets that link share many of their indexed shingles: count those.
    starts = apart.groupBy("node").agg(F.collect_set("shingle").alias("s"), F.first("n").alias("n"))
    starts = written(starts.join(candidates.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "node"), "starts")
    discard(apart)
    one = starts.select(F.col("node").alias("x"), F.col("s").alias("sx"), "n")
    two = starts.select(F.col("node").alias("y"), F.col("s").alias("sy"), F.col("n").alias("m"))
    near = candidates.join(one, "x").join(two, "y")
    near = near.where(_enough(F.size(F.array_intersect("sx", "sy")) + F.greatest(left_over(F.col("n")), left_over(F.col("m"))), F.col("n"), F.col("m"), percent))
    near = written(near.select("x", "y", "n", "m"), "near")
    discard(candidates, starts)

    counted = compared(near, "near-sets")
    more = counted.where(_enough(F.col("o"), F.col("n"), F.col("m"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    every = linked.unionByName(more)
    roots = components(every)
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("node", "component_id")
    out = sets.join(named, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), alone.alias("component_id"))
