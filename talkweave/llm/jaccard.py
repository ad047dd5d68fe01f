"""Join of near-equal documents: word n-gram sets, Jaccard similarity, a packed R-tree of count vectors.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct word n-grams.

1. A task turns each text into its set, and counts for each n-gram the documents that have it, in a sketch of at most
   ``2 ** MAX_BITS`` counters.  The n-grams of a set are put in one order for all sets, rare ones first by the sketch, and
   the first ``n - ceil(n * percent / 100) + 1`` are its keys: two linked sets have a key in common whatever the order.  The
   sketch only puts heavy n-grams last; every key is a row of 16 bytes whatever it says.  Exact copies are one node.
2. Keys of one node are dropped.  The others lead to the sizes and count points of their nodes, and only mates of a key that
   the bound of step 3 and their sizes allow to link are united; a cluster is what can be reached by such steps, so every link
   lies inside a cluster.  A key of more than ``HOT_KEY`` nodes unites them all, so that no task holds such a group.
3. The n-grams of a node are dealt into ``GROUPS`` groups; the group counts are its point.  The nodes of a
   cluster, sorted by size and counts, are packed into leaves of at most ``LEAF`` points and about ``LEAF_BYTES`` of sets.  A leaf, and each pair
   of leaves of a cluster that the boxes allow, is searched with a small tree: the overlap of two sets is at
   most the sum of the coordinate-wise minima of their points, and of two boxes the sum of the minima of their
   upper corners.  Pairs that survive and are not connected yet are verified on the sets.

A huge cluster is many leaves, thus many tasks.  Leaves that are already one component meet through their roots
and ship nothing more.  Rows carry deflated texts, which are a third as large as their sets; tasks make the sets anew.  Sets and their n-grams are compared through 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm import words as w
from talkweave.llm.rows import by_size, components, cut, identified

GROUPS = 128
FAN = 16
SMALL_KEY, HOT_KEY = 24, 1 << 16
# Digests of eight bytes that may travel to every task.
SENT_DIGESTS = 1_000_000
LEAF = 2048
LEAF_BYTES = 32 << 20
SEGMENT = 1 << 16
MIN_BITS, MAX_BITS = 16, 25


def _counters(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def _counted(width: int, bits: int):
    """Counters of the texts of a task that are not zero, by segment: steps from one to the next and counts up to 255."""

    def run(batches):
        held = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for grams in _sets(batch.column("text"), width):
                at = _counters(grams, bits)
                held[at] += held[at] < 255
        for segment in range(len(held) // SEGMENT):
            part = held[segment * SEGMENT : (segment + 1) * SEGMENT]
            places = np.flatnonzero(part)
            if len(places):
                steps = np.diff(places, prepend=0).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int32()), pa.array([steps.tobytes()]), pa.array([part[places].tobytes()])], ["segment", "steps", "counts"]
                )

    return run


def _classes(batches):
    """The bit length of each counter, one row per segment, from rows sorted by segment."""

    def row(segment, held):
        lengths = np.frexp(held.astype(np.float64))[1].astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([lengths.tobytes()])], ["segment", "classes"])

    at, held = None, np.zeros(SEGMENT, np.int64)
    for batch in batches:
        for segment, steps, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if at is not None and segment != at:
                yield row(at, held)
                held = np.zeros(SEGMENT, np.int64)
            at = segment
            held[np.cumsum(np.frombuffer(steps, np.uint16), dtype=np.int64)] += np.frombuffer(counts, np.uint8)
    if at is not None:
        yield row(at, held)


def frequency_classes(rows: DataFrame, width: int, grams: int) -> bytes:
    """One byte per counter, at most ``2 ** MAX_BITS``: the bit length of the number of documents that it saw."""
    bits = min(MAX_BITS, max(MIN_BITS, int(grams).bit_length()))
    parts = rows.select("text").mapInArrow(_counted(width, bits), "segment int, steps binary, counts binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_classes, "segment int, classes binary")
    held = bytearray(1 << bits)
    for segment, classes in merged.collect():  # never more than the sketch's own bytes
        held[segment * SEGMENT : (segment + 1) * SEGMENT] = classes
    return bytes(held)


def rare_keys(grams: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set; two linked sets have one in common.

    Linked sets have ``ceil(percent * n / 100)`` n-grams of the larger one in common.  In any order that both follow, the
    first of these is preceded in each set only by n-grams outside the overlap, so it is among the keys of both.
    """
    n = len(grams)
    seen = classes[_counters(grams, len(classes).bit_length() - 1)]
    return grams[np.lexsort((grams, seen))[: n - (percent * n + 99) // 100 + 1]]


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for low, high in w.slices(column):
        data, offsets = w.flat(column.slice(low, high - low))
        row, hashes = w.hashed(data, offsets, fold=True)
        edge = w.bounds(row, high - low)
        # Runs of all texts at once; those that begin in one text and end in another are left out.
        runs = w.runs(hashes, width)
        for first, last in zip(edge[:-1], edge[1:], strict=True):
            yield np.unique(runs[first : last - width + 1]) if last - first >= width else w.shingles(hashes[first:last], width)


def _node(grams: np.ndarray) -> int:
    return int(w.mix(w.mix(grams).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def _described(width: int):
    """Size, node and packed point of each row's set."""

    def run(batches):
        for batch in batches:
            sizes, nodes, points = [], [], []
            for grams in _sets(batch.column("text"), width):
                sizes.append(len(grams))
                nodes.append(_node(grams) if len(grams) else None)
                points.append(_packed_point(point_of(grams)) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary())],
                ["id", "digest", "n", "node", "point"],
            )

    return run


def _packed_point(point: np.ndarray) -> bytes:
    return point.astype("<u2" if point.max() < 1 << 16 else "<u4").tobytes()


def _point(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * GROUPS else "<u4").astype(np.int32)


def _cells(width: int, percent: int, classes):
    """``(key, node)`` rows of the different sets of a batch."""

    def run(batches):
        held = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            seen: set[int] = set()
            for grams in _sets(batch.column("text"), width):
                node = _node(grams) if len(grams) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    keys.append(rare_keys(grams, held, percent))
                    nodes.append(np.full(len(keys[-1]), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return run


def allowed_mates(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, points: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that unite all nodes which share a key and may be linked; rows come sorted by key and size."""
    found = []
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(begins[1:], len(keys))
    small = np.repeat(ends - begins <= SMALL_KEY, ends - begins)
    for step in range(1, SMALL_KEY):
        at = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:])) if step < len(keys) else []
        for low in range(0, len(at), 4096):
            i = at[low : low + 4096]
            j = i + step
            ok = _may_link(points[i], sizes[i], sizes[i], points[j], sizes[j], sizes[j], percent)
            found += zip(nodes[i[ok]].tolist(), nodes[j[ok]].tolist(), strict=True)
    for low, high in zip(begins.tolist(), ends.tolist(), strict=True):
        if high - low > SMALL_KEY:
            found += _united(nodes[low:high], sizes[low:high], points[low:high], percent)
    return sorted({(min(p), max(p)) for p in found})


def _united(nodes: np.ndarray, sizes: np.ndarray, points: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that may be linked and join two parts: first those of the middle node, then what a tree of the points allows."""
    mid = len(nodes) // 2
    near = _may_link(points[mid], sizes[mid], sizes[mid], points, sizes, sizes, percent)
    part = np.where(near, mid, np.arange(len(nodes)))
    for x in np.flatnonzero(near):
        if x != mid:
            yield int(nodes[mid]), int(nodes[x])
    tree = CountTree(points, sizes)
    for x, y in tree.pairs(tree, percent, part, part):
        if part[x] != part[y]:
            part[part == part[y]] = part[x]
            yield int(nodes[x]), int(nodes[y])


def _meetings(percent: int):
    """``(a, b)`` of mates that may be linked, from rows sorted by key, size and node."""

    def told(rows):
        keys, nodes, sizes = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        pairs = allowed_mates(keys, nodes, sizes, np.stack([_point(r[3]) for r in rows]), percent)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "n", "point")), strict=True):
                if len(rows) >= 8192 and row[0] != rows[-1][0]:
                    yield told(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield told(rows)

    return run


def united_mates(cells: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` pairs that lead from every node to all that share a key with it and may be linked to it."""
    key = Window.partitionBy("key")
    shared = cells.withColumns({"lead": F.min("node").over(key), "last": F.max("node").over(key), "held": F.count("*").over(key)})
    shared = cut(shared.where("lead <> last").dropDuplicates(["key", "node"]))
    all_of_it = shared.where(F.col("held") > HOT_KEY).select(F.col("node").alias("a"), F.col("lead").alias("b")).where("a <> b").distinct()
    points = info.where("node is not null").select("node", "n", "point").dropDuplicates(["node"])
    mates = shared.where(F.col("held") <= HOT_KEY).select("key", "node").join(points, "node").select("key", "node", "n", "point")
    met = mates.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_meetings(percent), "a bigint, b bigint")
    return all_of_it.unionByName(met)


class CountTree:
    """Points packed into boxes of ``FAN``; both levels give an upper bound of the overlap of sets."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*points.T[:4][::-1], sizes))
        pad = -len(order) % FAN
        self.slots = np.concatenate([order, np.full(pad, order[-1])]).reshape(-1, FAN)
        self.real = (np.arange(len(order) + pad) < len(order)).reshape(-1, FAN)
        self.points, self.sizes = points, sizes
        self.top = points[self.slots].max(axis=1)
        self.low, self.high = sizes[self.slots].min(axis=1), sizes[self.slots].max(axis=1)

    def pairs(self, other: CountTree, percent: int, part: np.ndarray, other_part: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of point numbers that may be linked and are of different parts; of one tree, each pair once."""
        same = other is self
        for i in range(len(self.slots)):
            start = i if same else 0
            fits = _may_link(self.top[i], self.low[i], self.high[i], other.top[start:], other.low[start:], other.high[start:], percent)
            mine = part[self.slots[i]]
            if fits.any() and (mine == mine[0]).all():
                fits &= (other_part[other.slots[start:]] != mine[0]).any(axis=1)
            for j in np.flatnonzero(fits) + start:
                a, b = self.slots[i], other.slots[j]
                apart = part[a][:, None] != other_part[b][None]
                if not apart.any():
                    continue
                ok = apart & _may_link(
                    self.points[a][:, None], self.sizes[a][:, None], self.sizes[a][:, None],
                    other.points[b][None], other.sizes[b][None], other.sizes[b][None], percent,
                )
                ok &= self.real[i][:, None] & other.real[j][None]
                if same and i == j:
                    ok &= np.arange(FAN)[:, None] < np.arange(FAN)[None]
                for x, y in zip(*np.nonzero(ok), strict=True):
                    yield int(a[x]), int(b[y])


def _may_link(top_a, low_a, high_a, top_b, low_b, high_b, percent):
    overlap = np.minimum(top_a, top_b).sum(axis=-1)
    return (
        ((100 + percent) * overlap >= percent * (low_a + low_b))
        & (100 * high_a >= percent * low_b)
        & (100 * high_b >= percent * low_a)
    )


def point_of(grams: np.ndarray) -> np.ndarray:
    return np.bincount((grams & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    common = int((b[place] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class Roots:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.find(x), self.find(y)))
        self.parent[y] = x


def connect(labels: list[int], sets: list[np.ndarray], points: np.ndarray, sizes: np.ndarray, split: int, percent: int):
    """Links that join two labels, among all sets (``split`` 0) or between the first ``split`` and the others."""
    if split and len(set(labels)) == 1:
        return
    part = np.unique(labels, return_inverse=True)[1]
    if split:
        trees = CountTree(points[:split], sizes[:split]), CountTree(points[split:], sizes[split:])
    else:
        trees = (CountTree(points, sizes),) * 2
    for x, y in trees[0].pairs(trees[1], percent, part[:split] if split else part, part[split:]):
        y += split
        if part[x] != part[y] and linked(sets[x], sets[y], percent):
            part[part == part[y]] = part[x]
            yield labels[x], labels[y]


def _deflated(batches):
    """Members with their points unpacked and their texts deflated."""
    for batch in batches:
        points = [_point(x) for x in batch.column("point").to_pylist()]
        flat = np.concatenate(points) if points else np.zeros(0, np.int32)
        offsets = pa.array(np.arange(len(points) + 1, dtype=np.int32) * GROUPS)
        bodies = [zlib.compress((text or "").encode(), 1) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("cluster"), batch.column("node"), batch.column("n"), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(bodies, pa.binary())],
            ["cluster", "node", "n", "point", "body"],
        )


def _members(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """``cluster, node, n, point, body`` of the ``holders``, each with its text.

    Where the holders' digests may travel to every task, texts of no holder are left where they lie.
    """
    wanted = holders.select("digest").distinct()
    if wanted.limit(SENT_DIGESTS + 1).count() <= SENT_DIGESTS:
        rows = rows.join(F.broadcast(wanted), "digest", "left_semi")
    # Rows of one id and digest have one set; the leaves skip all but the first.
    left, right = rows.alias("l"), holders.alias("r")
    met = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.digest") == F.col("r.digest")))
    return met.select("cluster", "node", "n", "point", "text").mapInArrow(_deflated, "cluster bigint, node bigint, n bigint, point array<int>, body binary")


def _sets_of(bodies: list[bytes], width: int) -> list[np.ndarray]:
    found: list[np.ndarray] = []
    for body in bodies:
        found.extend(_sets(pa.array([zlib.decompress(body)], pa.binary()).cast(pa.string()), width))
    return found


LEAF_SCHEMA = "cluster bigint, leaf bigint, node bigint, n bigint, point array<int>, body binary, root bigint, top array<int>, low bigint, high bigint"


def _leaves(percent: int, width: int, capacity: int):
    """Cuts rows sorted by cluster and size into leaves and joins each leaf with itself.

    ``root`` is the smallest node that a node reaches inside its leaf.  The first row of a leaf has its box.  Texts are
    handed on only where the cluster may have another leaf, here or in a neighbouring task.
    """

    def leaf_of(rows, more):
        cluster, nodes = rows[0][0], [r[1] for r in rows]
        sizes = np.array([r[2] for r in rows])
        points = np.array([r[3] for r in rows])
        sets = _sets_of([r[4] for r in rows], width) if len(rows) > 1 else []
        roots = Roots()
        for a, b in connect(nodes, sets, points, sizes, 0, percent) if sets else ():
            roots.join(a, b)
        top = [points.max(axis=0).tolist()] + [None] * (len(rows) - 1)
        low, high = ([int(x)] + [None] * (len(rows) - 1) for x in (sizes.min(), sizes.max()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([cluster] * len(rows), pa.int64()), pa.array([min(nodes)] * len(rows), pa.int64()), pa.array(nodes, pa.int64()),
                pa.array(sizes, pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] if more else None for r in rows], pa.binary()),
                pa.array([roots.find(x) for x in nodes], pa.int64()), pa.array(top, pa.list_(pa.int32())),
                pa.array(low, pa.int64()), pa.array(high, pa.int64()),
            ],
            ["cluster", "leaf", "node", "n", "point", "body", "root", "top", "low", "high"],
        )

    def run(batches):
        rows: list[tuple] = []
        more, held = True, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "node", "n", "point", "body")), strict=True):
                if rows and row[1] == rows[-1][1]:
                    continue
                if rows and (row[0] != rows[-1][0] or len(rows) == capacity or held > LEAF_BYTES):
                    goes_on = row[0] == rows[-1][0]
                    yield leaf_of(rows, more or goes_on)
                    rows, more, held = [], goes_on, 0
                rows.append(row)
                held += row[2] * 8
        if rows:
            yield leaf_of(rows, True)

    return run


def _packed(members: DataFrame, percent: int, width: int, capacity: int) -> DataFrame:
    order = ["cluster", "n", F.col("point")[0], F.col("point")[1], F.col("point")[2], "node"]
    ranged = members.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.mapInArrow(_leaves(percent, width, capacity), LEAF_SCHEMA))


def _crossed(percent: int, width: int):
    """Links between the two leaves of each unit, from rows sorted by unit and side."""

    def links(rows):
        split = sum(r[1] == 0 for r in rows)
        if 0 < split < len(rows):
            sets = _sets_of([r[5] for r in rows], width)
            yield from connect([r[2] for r in rows], sets, np.array([r[4] for r in rows]), np.array([r[3] for r in rows]), split, percent)

    def run(batches):
        rows: list[tuple] = []

        def flush():
            found = list(links(rows))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("unit", "side", "label", "n", "point", "body")), strict=True):
                if rows and row[0] != rows[-1][0]:
                    yield flush()
                    rows = []
                rows.append(row)
        if rows:
            yield flush()

    return run


def _boxes_fit(percent: int):
    def run(batches):
        for batch in batches:
            get = lambda c: np.array(batch.column(c).to_pylist())
            if batch.num_rows:
                ok = _may_link(get("top"), get("low"), get("high"), get("top_b"), get("low_b"), get("high_b"), percent)
                yield batch.filter(pa.array(ok)).select(["leaf", "leaf_b"])

    return run


def _labelled(leaves: DataFrame, percent: int, width: int, capacity: int) -> DataFrame:
    """``(node, label)``: the smallest connected part that all leaves together give to each node."""
    shared = leaves.where("top is not null").groupBy("cluster").agg(F.count("*").alias("leaves")).where("leaves > 1").select("cluster")
    shared = cut(shared)
    plain = leaves.select("node", F.col("root").alias("label"))
    if shared.isEmpty():
        return plain
    # Roots of the leaves of a cluster, joined among themselves as one level up.
    roots = leaves.where("node = root").join(shared, "cluster").select("cluster", "node", "n", "point", "body")
    upper = _packed(roots, percent, width, capacity).select("node", F.col("root").alias("upper"))
    many = leaves.join(shared, "cluster").join(upper.withColumnRenamed("node", "root"), "root").withColumn("label", F.col("upper"))
    boxes = many.groupBy("cluster", "leaf").agg(
        F.min("label").alias("one"), F.max("label").alias("two"), F.max("top").alias("top"), F.max("low").alias("low"), F.max("high").alias("high")
    )
    other = boxes.select("cluster", *[F.col(c).alias(f"{c}_b") for c in ("leaf", "one", "two", "top", "low", "high")])
    met = boxes.join(other, "cluster").where("leaf < leaf_b and not (one = two and one_b = two_b and one = one_b)")
    met = met.select("leaf", "leaf_b", "top", "low", "high", "top_b", "low_b", "high_b")
    met = met.mapInArrow(_boxes_fit(percent), "leaf bigint, leaf_b bigint")
    sides = met.withColumn("unit", F.xxhash64("leaf", "leaf_b")).select(
        "unit", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("leaf")) for s, c in ((0, "leaf"), (1, "leaf_b"))])).alias("x")
    )
    rows = sides.select("unit", "x.side", "x.leaf").join(many, "leaf").select("unit", "side", "label", "n", "point", "body")
    links = rows.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_crossed(percent, width), "a bigint, b bigint")
    upper_edges = upper.select(F.col("node").alias("a"), F.col("upper").alias("b"))
    joined = components(links.unionByName(upper_edges))
    return plain.join(joined, plain["label"] == joined["node"], "left").select(
        plain["node"], F.coalesce(joined["component"], plain["label"]).alias("label")
    )


def near_copies(
    docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF
) -> DataFrame:
    """``id, digest, n_shingles, component, first`` per row of ``docs``; ``component`` is the smallest id reachable by links.

    A row of no words links with nothing and is its own component.  Ids must be orderable; null ids count last, so a
    component of null ids only has a null component.  Repeated rows give equal rows.  ``first`` marks the
    rows of one id and digest in each component, the smallest, and rows of no words.  Other columns are not read.
    """
    rows = identified(docs, id_col, text_col)
    kind = dict(rows.dtypes)["id"]
    info = cut(rows.mapInArrow(_described(width), f"id {kind}, digest bigint, n bigint, node bigint, point binary"))
    classes = frequency_classes(rows, width, info.select(F.sum("n")).first()[0] or 0)
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    cells = rows.select("text").mapInArrow(_cells(width, percent, sent), "key bigint, node bigint")
    clusters = components(united_mates(cells, info, percent))
    holders = info.join(clusters, "node").groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest")).alias("best"),
        F.first("component").alias("cluster"), F.first("n").alias("n"), F.first("point").alias("point"),
    )
    holders = cut(holders.select(F.col("best.id").alias("id"), F.col("best.digest").alias("digest"), "node", "cluster", "n", "point"))
    labels = _labelled(_packed(_members(rows, holders), percent, width, leaf), percent, width, leaf)
    placed = info.select("id", "digest", "n", "node").join(labels, "node", "left").select(
        "id", "digest", "n", F.coalesce("label", "node").alias("label")
    )
    placed = cut(placed)
    smallest = cut(
        placed.where("label is not null").groupBy("label").agg(
            F.min("id").alias("component"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest")).alias("least"), F.count("*").alias("size")
        )
    )
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("digest") == F.col("least.digest"))
    told = by_size(placed.where("label is not null"), smallest, "label", "size", placed.count())
    alone = placed.where("label is null").select("id", "digest", F.col("n").alias("n_shingles"), F.col("id").alias("component"), F.lit(True).alias("first"))
    return alone.unionByName(told.select("id", "digest", F.col("n").alias("n_shingles"), "component", first.alias("first")))
