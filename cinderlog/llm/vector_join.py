"""All pairs of vectors within an angle: an exact join of groups of vectors, first by short codes.

Vectors are sorted into cells by their nearest pivot, and the cells, in an order that keeps near ones together, cut into groups of
bounded size. Every pair of groups is a tile. A tile gets codes of its vectors, one byte a component along the principal axes of a
sample, with what rounding left out. A product of codes is wrong by at most ``|e_x| + |e_y| + |e_x| |e_y|`` for unit vectors, so a
vector without a partner whose upper bound reaches the limit is out. The bound is taken first from the strongest axes and the lengths
of what remains; stretches of neighbouring vectors that a plane keeps farther apart than the limit are not multiplied at all.
Vectors that may have a partner in a tile are then sent there whole and joined exactly.

A tile's memory does not grow with the table. Every vector's code goes to as many tiles as its length has groups, and without structure
in the vectors all pairs of codes are multiplied: work grows with the square of the table, which no exact join of such vectors avoids.

Equal vectors are joined once. A tile gives back counts of links and, for each vector, the first vector that its links inside the
tile reach, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, give_back, lean, mixed, written
from .components import components
from .vectors import by_length, usable

#: Vectors of a cell that the number of pivots aims at, the largest number of pivots and of their components, rows of a block and of a stripe of it.
CELL, PIVOTS, PIVOT_COMPONENTS, BLOCK, STRIPE = 1024, 4096, 1 << 20, 4096, 256
#: Vectors that the axes are learnt from, groups of a length that has at least as many times SPARSE vectors, components of a group.
SAMPLE, GROUPS, SPARSE, COMPONENTS = 1024, 8, 256, 1 << 23
#: Most and least vectors of a stretch, vectors of a strip of it, bytes of codes that a task gathers before it deals them.
STRETCH, SHORT, STRIP, GATHERED = 1024, 256, 128, 4 << 20


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the first place of each group) after linking places ``i`` and ``j``."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        root = np.arange(len(label))
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def hits(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a mask in one piece with few hits: eight places are looked at as one number."""
    flat = mask.reshape(-1)
    cut = len(flat) & ~7
    eight = np.flatnonzero(flat[:cut].view(np.uint64) != 0)
    at = (eight[:, None] * 8 + np.arange(8)).reshape(-1)
    at = at[flat[at]]
    return at if cut == len(flat) else np.concatenate([at, cut + np.flatnonzero(flat[cut:])])


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of such a matrix."""
    return np.divmod(hits(mask), mask.shape[1])


def joined(linked: np.ndarray) -> np.ndarray:
    """Labels of the rows, then the columns, of a matrix of links; links are listed only where rows' and columns' first ones do not tell."""
    n = len(linked)
    label = np.arange(sum(linked.shape))
    some, met = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    label = merged(label, np.concatenate([some, linked.argmax(axis=0)[met]]), n + np.concatenate([linked.argmax(axis=1)[some], met]))
    i, j = places(linked & (label[:n, None] != label[n:]))
    return merged(label, i, n + j)


def block_links(x: np.ndarray, y: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of every vector of ``x`` (then of ``y``; None: ``x`` with itself), and the first place that each reaches."""
    own = y is None
    other, weight, n = (x, weight_x, 0) if own else (y, weight_y, len(x))
    total = len(x) + (0 if own else len(y))
    counts, label = np.zeros(total, np.int64), np.arange(total)
    far = other.astype(np.float32)
    error = (x.shape[1] + 8) * 1.2e-7
    for a in range(0, len(x), STRIPE):
        some, met = x[a : a + STRIPE], []
        close, at = some.astype(np.float32), a + np.arange(len(some))
        for b in range(0, len(other), BLOCK):
            near, to = close @ far[b : b + BLOCK].T, b + np.arange(min(BLOCK, len(other) - b))
            linked = near >= cosine + error
            i, j = places((near >= cosine - error) & ~linked)
            if len(i):  # too near the limit for single precision
                exact = np.concatenate([(some[i[s : s + 65536]] * other[b + j[s : s + 65536]]).sum(axis=1) for s in range(0, len(i), 65536)])
                linked[i, j] = exact >= cosine
            if own and b < a + len(some) and a < b + BLOCK:
                linked &= at[:, None] != to
            found = np.count_nonzero(linked)
            if found * 16 > linked.size:
                as_number = linked.astype(np.float64)  # sums of whole numbers below 2 ** 53
                rows, columns, reached = as_number @ weight[to], None if own else weight_x[at] @ as_number, joined(linked)
            elif found:
                i, j = places(linked)
                rows, columns = np.bincount(i, weight[b + j], len(at)), None if own else np.bincount(j, weight_x[a + i], len(to))
                reached = merged(np.arange(len(at) + len(to)), i, len(at) + j)
            else:
                continue
            counts[at] += rows.astype(np.int64)
            if not own:
                counts[n + to] += columns.astype(np.int64)
            here, moved = np.concatenate([at, n + to]), np.flatnonzero(reached != np.arange(len(reached)))
            met.append((here[moved], here[reached[moved]]))
        if met:
            label = merged(label, *(np.concatenate(m) for m in zip(*met)))
    return counts, label


def axes(sample: np.ndarray, cosine: float) -> tuple[np.ndarray, int]:
    """Principal axes of unit vectors, the strongest first, and how many of them the first look is to take.

    An axis more costs every pair a little; a pair that the first look lets through in vain costs about twenty thousand times as much.
    """
    basis = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    d, some = sample.shape[1], sample[:512] @ basis
    best, cost, close = d, float(d), (some @ some.T >= cosine - 0.015).sum()
    for k in sorted({4 * round(1.15**i) for i in range(100)}):
        if k < d and len(some) > 1:
            rest = np.sqrt((some[:, k:] ** 2).sum(axis=1))
            passed = (some[:, :k] @ some[:, :k].T + np.outer(rest, rest) >= cosine - 0.015).sum() - close
            now = k + 20000 * passed / (len(some) * (len(some) - 1))
            if now < cost:
                best, cost = k, now
    return np.ascontiguousarray(basis), best


def tour(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the nearest one left."""
    near, order = pivots @ pivots.T, [0]
    left = np.ones(len(pivots), bool)
    while len(order) < len(pivots):
        left[order[-1]] = False
        order.append(int(np.where(left, near[order[-1]], -2).argmax()))
    return pivots[order]


def layout(d: int) -> np.dtype:
    """A vector's code: its components along the axes in units of ``size``, and the length of what rounding left out (or more)."""
    return np.dtype([("node", "<i8"), ("cell", "<i4"), ("size", "<f4"), ("off", "<f4"), ("code", "i1", (d,))])


def coded(z: np.ndarray, node: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Codes of unit vectors along the axes."""
    rows = np.zeros(len(z), layout(z.shape[1]))
    rows["node"], rows["cell"], rows["size"] = node, cell, np.abs(z).max(axis=1) / 127
    size = rows["size"].astype(np.float64)[:, None]
    rows["code"] = np.rint(z / size).clip(-127, 127)
    rows["off"] = np.sqrt(((z - rows["code"] * size) ** 2).sum(axis=1)) * (1 + 1e-6) + 1e-6
    return rows


def bytes_of(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column of bytes; entry ``i`` ends before row ``ends[i + 1]``."""
    held = np.ascontiguousarray(rows).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * rows.itemsize).astype(np.int32)), pa.py_buffer(held)])


def codes_in(column: pa.Array, d: int) -> np.ndarray:
    """The codes that a column of bytes holds, one after the other."""
    if not len(column):
        return np.zeros(0, layout(d))
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(layout(d))


class Codes:
    """One side of a tile: codes in the order of their cells, in stretches that small cells share and large cells are cut into."""

    def __init__(self, rows: np.ndarray, head: int):
        rows = rows[np.lexsort((rows["node"], rows["cell"]))]
        self.node, self.off, self.hit = rows["node"].copy(), rows["off"].copy(), np.zeros(len(rows), bool)
        self.full = rows["code"].astype(np.float32)
        self.full *= rows["size"][:, None]
        rest = np.sqrt((self.full[:, head:] ** 2).sum(axis=1)) * np.float32(1 + 1e-5)
        one = np.ones(len(rows), np.float32)
        self.left = np.column_stack([self.full[:, :head], rest, self.off, one])
        self.right = np.column_stack([self.full[:, :head], rest, one, self.off])
        ends = np.append(np.flatnonzero(np.diff(rows["cell"])) + 1, len(rows)).tolist()
        cuts = [0]
        for end in ends:
            if end - cuts[-1] >= SHORT or end == len(rows):
                cuts += np.linspace(cuts[-1], end, -(-(end - cuts[-1]) // STRETCH) + 1).astype(int)[1:].tolist()
        self.parts = [slice(s, e) for s, e in zip(cuts, cuts[1:])]
        self.centres = np.array([self.full[part].mean(axis=0) for part in self.parts])

    def along(self, m: int, centres: np.ndarray) -> np.ndarray:
        """Where a stretch's vectors lie in the directions from its centre to others."""
        some = self.full[self.parts[m]]
        return some @ centres.T - (some @ self.centres[m])[:, None]


def look(x: Codes, y: Codes, cosine: float) -> None:
    """Mark the vectors of two sides (or of one: ``x`` is ``y``) that may have a partner at ``cosine`` or above on the other."""
    error = (x.full.shape[1] + 8) * 4.8e-7
    limit = cosine - float(x.off.max()) * float(y.off.max()) - error
    reach = float(np.sqrt(max(2 - 2 * cosine, 0))) + error
    product, mask = np.empty(STRIP * STRETCH, np.float32), np.empty(STRETCH * STRETCH, bool)
    for m, a in enumerate(x.parts):
        # Partners are no farther apart than ``room`` in the direction from one centre to the other, but for what rounding left out.
        far = np.sqrt(((x.centres[m] - y.centres) ** 2).sum(axis=1))
        room, ahead = error + reach * far, x.along(m, y.centres) + x.off[a][:, None] * far
        last = ahead.max(axis=0)
        for n, b in enumerate(y.parts):
            same = x is y and m == n
            if x is y and n < m or x.hit[a].all() and y.hit[b].all():
                continue
            left, right, order_x, order_y = x.left[a], y.right[b], None, None
            if not same:  # the vectors nearest to the other side first
                fore, back = ahead[:, n], -y.along(n, x.centres[m : m + 1])[:, 0] - y.off[b] * far[n]
                if back.min() - last[n] > room[n]:
                    continue
                order_x, order_y = (-fore).argsort(), back.argsort()
                left, right = left.take(order_x, axis=0), right.take(order_y, axis=0)
                reached = back[order_y].searchsorted(fore[order_x[::STRIP]] + room[n], "right").tolist()
            starts, widths, size = [], [], 0
            for s in range(0, len(left), STRIP):
                rows, upto = min(STRIP, len(left) - s), len(right) if same else reached[s // STRIP]
                if not upto:
                    break
                near = np.matmul(left[s : s + rows], right[:upto].T, out=product[: rows * upto].reshape(rows, upto))
                if same:
                    near[np.arange(rows), s + np.arange(rows)] = -2
                np.greater_equal(near, limit, out=mask[size : size + rows * upto].reshape(rows, upto))
                starts.append(size)
                widths.append(upto)
                size += rows * upto
            at = hits(mask[:size])
            if not len(at):
                continue
            strip = np.searchsorted(starts, at, "right") - 1
            p, q = np.divmod(at - np.array(starts)[strip], np.array(widths)[strip])
            p += strip * STRIP
            i, j = (p, q) if same else (order_x[p], order_y[q])
            if len(p) * 64 > len(left) * len(right):
                near = x.full[a] @ y.full[b].T + x.off[a][:, None] + y.off[b]
                if same:
                    np.fill_diagonal(near, -2)
                near = near >= limit
                x.hit[a] |= near.any(axis=1)
                y.hit[b] |= near.any(axis=0)
                continue
            i, j = a.start + i, b.start + j
            passed = np.einsum("ij,ij->i", x.full[i], y.full[j]) + x.off[i] + y.off[j] >= limit
            x.hit[i[passed]] = y.hit[j[passed]] = True


def links(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors null, zero or with null or non-finite components link with nothing, and so do vectors of different lengths among each other.
    ``n_links`` counts other rows, equal ones included; ``component_id`` is the smallest id that links lead to.
    """
    kind = vectors.select(vector).schema[0].dataType
    kept = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    # Rows meet their vector by 128 bits of hashes; only equal vectors themselves are put together.
    hashes = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast(kept).alias("v"), usable(vector).alias("ok"))
    distinct = rows.where("ok").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    distinct = written(distinct.select("*", *hashes, F.monotonically_increasing_id().alias("node")), "vectors")
    spark, (total, longest) = rows.sparkSession, distinct.agg(F.count("*"), F.max(F.size("v"))).first()

    wanted = min(PIVOTS, PIVOT_COMPONENTS // (longest or 1), -(-total // CELL)) or 1
    chance = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).alias("chance")
    some = max(SAMPLE, wanted)
    picked = distinct.select("v", chance, "node").where(F.col("chance") <= (some << 30) // (total or 1)).collect()
    sample = [np.array(r.v, np.float64) for r in sorted(picked, key=lambda r: (r.chance, r.node))[:some]]
    views = {}
    for d in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == d]))
        basis, head = axes(x[:SAMPLE], cosine)
        pivots = x[: sum(len(v) == d for v in sample[:wanted])] @ basis
        views[d] = basis, head, (tour(pivots) if len(pivots) else pivots).astype(np.float32)
    shared = spark.sparkContext.broadcast(views)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nodes = part.column("node").to_numpy()
            for d, at, x in by_length(part.column("v")):
                z, cell = unit(x.astype(np.float64)), np.zeros(len(at), np.int32)
                if d in shared.value:
                    basis, _, pivots = shared.value[d]
                    z = z @ basis
                    for s in range(0, len(z) if len(pivots) else 0, STRETCH):
                        cell[s : s + STRETCH] = (z[s : s + STRETCH].astype(np.float32) @ pivots.T).argmax(axis=1)
                code = bytes_of(coded(z, nodes[at], cell), np.arange(len(at) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.array(cell), code], names=["d", "cell", "code"])

    codes = written(distinct.select("node", "v").mapInArrow(lean(encode), "d int, cell int, code binary"), "codes")
    sizes: dict[int, dict[int, int]] = {}
    for r in codes.groupBy("d", "cell").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r.d, {})[r.cell] = r.n
    plans = {}
    for d, of in sizes.items():
        size = np.zeros(max(of) + 1, np.int64)
        size[list(of)] = list(of.values())
        n = int(size.sum())
        groups = max(1, min(GROUPS, n // SPARSE), -(-n // max(STRETCH, COMPONENTS // d)))
        plans[d] = size, np.cumsum(size) - size, -(-n // groups)
    planned = spark.sparkContext.broadcast(plans)
    counts = [-(-int(size.sum()) // width) for size, _, width in plans.values()]
    tiles = sum(n * (n + 1) // 2 for n in counts)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes of each group in one piece; a vector's group comes from its cell and, in a cell of several groups, its node."""
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def pieces() -> Iterator[pa.RecordBatch]:
            for d, some in held.items():
                rows, (sizes_d, start, width) = np.concatenate(some), planned.value[d]
                cell = rows["cell"]
                group = (start[cell] + (mixed(rows["node"]) % sizes_d[cell].astype(np.uint64)).astype(np.int64)) // width
                order = np.argsort(group, kind="stable")
                own, first = np.unique(group[order], return_index=True)
                count = np.full(len(own), -(-int(sizes_d.sum()) // width), np.int32)
                code = bytes_of(rows[order], np.append(first, len(rows)))
                length = np.full(len(own), d, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(own.astype(np.int32)), pa.array(count), code], names=["d", "own", "groups", "code"])
            held.clear()

        for part in parts:
            lengths = part.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                held.setdefault(d, []).append(codes_in(part.column("code").filter(pa.array(lengths == d)), d))
                size += held[d][-1].nbytes
            if size >= GATHERED:
                yield from pieces()
                size = 0
        yield from pieces()

    tile = ["d", "i", "j"]
    dealt = codes.select("d", "code").mapInArrow(lean(deal), "d int, own int, groups int, code binary")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = dealt.select("d", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "code")
    dealt = dealt.repartition(max(1, min(4 * tiles, 1 << 14)), *tile)  # tiles are much work for few bytes: hardly two in a task

    def first_look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {}
        for part in parts:
            d, i, j = (part.column(c)[0].as_py() for c in tile)
            for own in {i, j}:
                got.setdefault(own, []).append(codes_in(part.column("code").filter(pc.equal(part.column("own"), own)), d))
        head = shared.value[d][1] if d in shared.value else d
        sides = {own: Codes(rows, head) for own in list(got) if len(rows := np.concatenate(got.pop(own)))}
        if len(sides) == len({i, j}):
            look(sides[i], sides[j], cosine)
            for own, side in sides.items():
                for s in range(0, len(side.node), 65536):
                    node = side.node[s : s + 65536][side.hit[s : s + 65536]]
                    same = [pa.array(np.full(len(node), v, np.int32)) for v in (d, i, j, own)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(node)], names=[*tile, "own", "node"])
        give_back()

    likely = written(dealt.groupBy(*tile).applyInArrow(first_look, "d int, i int, j int, own int, node long"), "likely")
    discard(codes)

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for part in parts:
            d, i, j = (part.column(c)[0].as_py() for c in tile)
            x = unit(next(by_length(part.column("v")))[2].astype(np.float64))
            got.append((part.column("own").to_numpy() == i, *(part.column(c).to_numpy().copy() for c in ("node", "copies")), x))
        side, node, weight, x = (np.concatenate(c) for c in zip(*got))
        del got
        order = np.lexsort((node, ~side))
        node, weight, x = node[order], weight[order], x[order]
        n = int(side.sum())
        if i == j:
            counts, label = block_links(x, None, weight, None, cosine)
        else:
            counts, label = block_links(x[:n], x[n:], weight[:n], weight[n:], cosine)
        some = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(counts[some]), pa.array(node[label][some])], names=["node", "n", "root"])
        give_back()

    whole = likely.join(distinct.select("node", "copies", "v"), "node")
    found = written(whole.groupBy(*tile).applyInArrow(join, "node long, n long, root long"), "found")
    discard(likely)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("n").alias("n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = linked.join(distinct.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(smallest, "root").select("node", "n", "least", F.lit(True).alias("has"))
    known = distinct.select("h", "g", "node", "copies", "first").join(linked, "node", "left")
    least = F.when(F.col("has"), F.col("least")).otherwise(F.col("first")).alias("component_id")
    known = known.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), least)
    good = rows.where("ok").select("vec_id", *hashes).join(known, ["h", "g"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
