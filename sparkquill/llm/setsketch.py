"""Operator 2: near-duplicate documents by SetSketch registers.

A document's set holds its distinct runs of five words. A sketch has REGISTERS registers; an element reaches each of
them once, in an order of its own, with values that fall into ever later slices of an exponential distribution
(exponentially spaced truncated minima): after the first slices no later value can lower a register, so most elements
stop at once. Registers keep the minimum, quantised as floor(1 - log_BASE(value)), hence sketches merge by maximum, and
two sets agree in a register with a probability close to their Jaccard similarity.

Steps: equal sets become one class; BANDS bands of ROWS registers put similar classes into common buckets; every bucket
hands its members to one leader, the member that shares most buckets; members of a leader are split into parts of
about PART classes; inside a part similarities are estimated from all registers jointly by maximum likelihood, and
pairs that could reach the threshold are confirmed on the full sets. In a leader with several parts, the classes that are
not yet in its largest component are compared with all of its other parts as well. No list of pairs is ever made: a
part returns a spanning forest of its links.

A class is a node of the sketch graph under a number of its own; links join the smallest doc_ids of two classes, and a doc_id
whose rows have different texts joins all of its classes. Keys that can be hot (buckets, leaders, set keys, doc_ids) are salted.

A pair at similarity 0.85 misses all bands with a probability of 4e-7, one at 0.8 with 3e-5 (20 bands of 4). Null or
empty texts have no set and link with nothing; a null doc_id can't be named and is kept, linked with nothing.
Word and run hashes have 64 bits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm._arrays import SPACE_SPLIT, Words, chunks, mix, windows
from sparkquill.llm._stage import drop_staged, salted_lookup, staged
from sparkquill.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
PART = 256
#: The least similarity of a link, unless the caller gives another.
TAU = 0.85
#: Estimates this many standard errors below the threshold are not confirmed.
SLACK = 6.0

_U = np.uint64
_STEPS = np.array([k for k in range(1, REGISTERS) if np.gcd(k, REGISTERS) == 1], dtype=np.int64)


def sketch(h: np.ndarray, doc: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """uint16 registers (n_docs x m) of the sets whose elements are h, each in the set given by doc."""
    least = np.ones(n_docs * m)
    first = (mix(h ^ _U(0x51ED270B)) % _U(m)).astype(np.int64)
    step = _STEPS[(mix(h ^ _U(0xA3B19535)) % _U(len(_STEPS))).astype(np.int64)]
    doc = doc.astype(np.int64)
    for j in range(m):
        u = mix(h + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> _U(11)
        z = (j + u.astype(np.float64) * 2.0**-53) / m
        np.minimum.at(least, doc * m + (first + j * step) % m, z)
        bound = least.reshape(n_docs, m).max(axis=1)
        live = bound[doc] > (j + 1) / m
        if not live.any():
            break
        h, doc, first, step = h[live], doc[live], first[live], step[live]
    x = -np.log1p(-np.minimum(least, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, 65535).astype(np.uint16).reshape(n_docs, m)


def estimate(less: np.ndarray, more: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity of maximum likelihood, from the counts of registers where a is less or more than b, and both sizes."""
    total = (n_a + n_b).astype(np.float64)
    u, v = n_a / total, n_b / total
    equal = m - less - more

    def part(x):  # probability that one register exceeds the other
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def slope(j):
        def loglik(t):
            p, q = np.maximum(part(v - u * t), 1e-12), np.maximum(part(u - v * t), 1e-12)
            return less * np.log(p) + more * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

        return loglik(np.minimum(j + 1e-5, 1)) - loglik(np.maximum(j - 1e-5, 0))

    lo, hi = np.zeros(len(total)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave in the similarity
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with their distinct run hashes (sorted within a document) and the documents of these."""
    for batch, raw, offsets in chunks(batches):
        words = Words(raw, offsets, SPACE_SPLIT)
        h, _, doc = windows(words, SHINGLE)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield batch, h[new], doc[new]


def _keys(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit name of each set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _U(c)))]) for c in (0x1B873593, 0xCC9E2D51)]
    both = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)
    return [row.tobytes() for row in both]


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, h, doc in _sets(batches):
        n = batch.num_rows
        bounds = np.searchsorted(doc, np.arange(n + 1))
        regs = sketch(h, doc, n)
        size = np.diff(bounds)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(size, pa.int64()),
                pa.array([k if s else None for k, s in zip(_keys(h, bounds), size)], pa.binary()),
                pa.array([r.tobytes() if s else None for r, s in zip(regs, size)], pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_key", "registers"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits), registers (uint16, little endian) of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch_rows, "doc_id long, n_shingles long, set_key binary, registers binary")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the rows whose text has the wanted set_key; node, text, set_key, seats -> node, items, seats."""
    for batch, h, doc in _sets(batches):
        bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        wanted = batch.column(2).to_pylist()
        hit = [i for i, k in enumerate(_keys(h, bounds)) if k == wanted[i]]
        if hit:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(hit), pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in hit], pa.binary()), batch.column(3).take(hit)],
                ["node", "items", "seats"],
            )


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first `keys` columns (long), over batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            change[0] = any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in range(keys))
        cut = np.flatnonzero(change).tolist()
        start = 0
        for stop in cut:
            if stop > start:
                held.append(batch.slice(start, stop - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], stop
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _decode(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _candidates(tau: float) -> Rows:
    """leader, part, node, big, doc, n, registers, set_key -> leader, part, big, node, doc, set_key of the classes that may have a link in their part."""
    least = tau - SLACK * np.sqrt(tau * (1 - tau) / REGISTERS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 2):
            node = table.column("node").to_numpy()
            keep = np.ones(len(node), dtype=bool)
            if not table.column("big")[0].as_py():
                _, once = np.unique(node, return_index=True)
                table = table.take(once)
                node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
                regs = np.stack(_decode(table.column("registers"), np.uint16)) if len(node) else np.zeros((0, REGISTERS), np.uint16)
                keep = np.zeros(len(node), dtype=bool)
                for i in range(len(node) - 1):
                    j = np.arange(i + 1, len(node))
                    less, more = (regs[i] < regs[j]).sum(axis=1), (regs[i] > regs[j]).sum(axis=1)
                    j, less, more = (x[REGISTERS - less - more >= min(0.4, least) * REGISTERS] for x in (j, less, more))  # fewer equal registers can't come to the threshold
                    if len(j):
                        hit = estimate(less, more, np.full(len(j), n[i]), n[j]) >= least
                        keep[j[hit]] = True
                        keep[i] |= hit.any()
            if keep.any():
                yield table.select(["leader", "part", "big", "node", "doc", "set_key"]).filter(pa.array(keep)).combine_chunks().to_batches()[0]

    return rows


def _overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a product of 0/1 matrices over the elements that occur on both sides."""
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)

    def hits(sets, flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(shared, flat)
        ok = col < len(shared)
        ok[ok] = shared[col[ok]] == flat[ok]
        return row[ok], col[ok]

    (ra, ca), (rb, cb) = hits(sets_a, flat_a), hits(sets_b, flat_b)
    for lo in range(0, len(shared), 8192):
        hi = min(lo + 8192, len(shared))
        x, y = np.zeros((len(sets_a), hi - lo), np.float32), np.zeros((len(sets_b), hi - lo), np.float32)
        for mat, r, c in ((x, ra, ca), (y, rb, cb)):
            inside = (c >= lo) & (c < hi)
            mat[r[inside], c[inside] - lo] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def _linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], tau: float) -> np.ndarray:
    bound = Fraction(str(tau))  # compared in whole numbers
    inter = _overlaps(sets_a, sets_b)
    union = np.array([len(s) for s in sets_a])[:, None] + np.array([len(s) for s in sets_b])[None, :] - inter
    return bound.denominator * inter >= bound.numerator * union


def _forest(row_a: np.ndarray, row_b: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each row to the first of its component, for the links between two lists of rows."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(linked)):
        a, b = find(int(row_a[i])), find(int(row_b[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _edge_columns(edges: list[tuple[int, int]], doc: np.ndarray) -> list[pa.Array]:
    return [pa.array(doc[[e[k] for e in edges]], pa.int64()) for k in (0, 1)]


def _confirm(tau: float) -> Rows:
    """leader, part, big, doc, node, items -> links inside each part (a, b: doc_ids); the sets of parts of big leaders come along (node, items)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "node", "items"]
        for table in groups(batches, 2):
            node, once = np.unique(table.column("node").to_numpy(), return_index=True)
            items = table.column("items").take(pa.array(once)).combine_chunks()
            if len(node) > 1:
                sets = [np.frombuffer(x, dtype=np.uint64) for x in items.to_pylist()]
                row = np.arange(len(node))
                if edges := _forest(row, row, np.triu(_linked(sets, sets, tau), 1)):
                    none = len(edges)
                    yield pa.RecordBatch.from_arrays([*_edge_columns(edges, table.column("doc").to_numpy()[once]), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], names)
            if table.column("big")[0].as_py():
                yield pa.RecordBatch.from_arrays([pa.nulls(len(node), pa.int64()), pa.nulls(len(node), pa.int64()), pa.array(node), items], names)

    return rows


def _confirm_across(tau: float) -> Rows:
    """leader, part, chunk, loose, doc, node, items -> links (doc_ids) between the loose classes of a chunk and the classes of a part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            node, loose = table.column("node").to_numpy(), table.column("loose").to_numpy(zero_copy_only=False).astype(bool)
            if loose.any() and not loose.all():
                sets = _decode(table.column("items"), np.uint64)
                a, b = np.flatnonzero(loose), np.flatnonzero(~loose)
                linked = _linked([sets[i] for i in a], [sets[i] for i in b], tau) & (node[a][:, None] != node[b][None, :])
                if edges := _forest(a, b, linked):
                    yield pa.RecordBatch.from_arrays(_edge_columns(edges, table.column("doc").to_numpy()), ["a", "b"])

    return rows


def _with_sets(docs: DataFrame, seats: DataFrame, columns: list[str]) -> DataFrame:
    """`seats` (node, doc, set_key and `columns`) with each node's set: a text is read and shuffled once however many seats it has.

    The join is a sort-merge join at every size, so that the plan for large inputs is the one that small inputs test.
    """
    held = seats.groupBy("node", "doc", "set_key").agg(F.collect_set(F.struct(*columns)).alias("seats"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = held.schema["seats"].dataType.simpleString()
    return (
        texts.join(held.hint("merge"), texts.doc_id == held.doc)
        .select("node", "text", "set_key", "seats")
        .mapInArrow(_set_rows, f"node long, items binary, seats {kind}")
        .select("node", "items", F.explode("seats").alias("seat"))
        .select(*[f"seat.{c}" for c in columns], "node", "items")
    )


def _dealt(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(function, schema)


def near_links(docs: DataFrame, classes: DataFrame, tau: float = TAU) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b: doc_ids) of similarity `tau` or more that span the components of the classes (node, doc, n, set_key, registers), and the staged tables that they rest on."""
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substr("registers", k * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    seats = classes.select("node", band.alias("bucket"))
    full = seats.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    seats = staged(salted_lookup(seats, full, "bucket", "node", "size").filter("size IS NOT NULL"), "buckets")
    weight = seats.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = seats.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("n"))).alias("top"), F.max("size").alias("size"))
    leaders = leaders.select("bucket", (-F.col("top.n")).alias("leader"), "size")
    members = staged(salted_lookup(seats.drop("size"), leaders, "bucket", "node", "size").select("leader", "node").distinct(), "members")
    many = members.groupBy("leader").agg(F.count("*").alias("n_members")).filter(F.col("n_members") > PART).withColumn("parts", F.ceil(F.col("n_members") / PART).cast("long"))
    placed = salted_lookup(members, many, "leader", "node", "n_members").select("leader", "node", F.coalesce("parts", F.lit(1)).alias("parts"))
    known = placed.join(classes.select("node", "doc", "n", "registers", "set_key"), "node")
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")))
    seated = known.withColumn("part", F.explode(F.when(F.col("node") == F.col("leader"), F.expr("sequence(0L, parts - 1L)")).otherwise(own)))
    seated = seated.select("leader", "part", "node", (F.col("parts") > 1).alias("big"), "doc", "n", "registers", "set_key")
    likely = staged(_dealt(seated, ["leader", "part"], _candidates(tau), "leader long, part long, big boolean, node long, doc long, set_key binary"), "likely")
    sets = _with_sets(docs, likely, ["leader", "part", "big", "doc"])
    confirmed = staged(_dealt(sets, ["leader", "part"], _confirm(tau), "a long, b long, node long, items binary"), "links")
    inside = confirmed.filter("a IS NOT NULL").select("a", "b")
    drop_staged(seats)

    # Leaders of several parts: what isn't in their largest component meets all of their parts.
    big = likely.filter("big").select("leader", "part", "node", "doc")
    if big.isEmpty():
        drop_staged(members, likely)
        return inside, [confirmed]
    names = components(inside)
    named = staged(big.join(names.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "named")
    by_size = named.groupBy("leader", "component").agg(F.countDistinct("node").alias("size"))
    main = by_size.groupBy("leader").agg(F.max(F.struct("size", "component")).alias("top"), (F.sum("size") - F.max("size")).alias("n_loose")).filter("n_loose > 0")
    main = main.join(many, "leader").select("leader", F.col("top.component").alias("main"), F.ceil(F.col("n_loose") / PART).cast("long").alias("n_chunks"), F.col("parts").alias("n_parts"), "n_members")
    spread = salted_lookup(named, main, "leader", "node", "n_members").filter("n_chunks IS NOT NULL").withColumn("loose", F.col("component") != F.col("main"))
    part_side = spread.withColumn("chunk", F.explode(F.expr("sequence(0L, n_chunks - 1L)"))).withColumn("loose", F.lit(False))
    loose_side = spread.filter("loose").dropDuplicates(["leader", "node"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_chunks"))).withColumn("part", F.explode(F.expr("sequence(0L, n_parts - 1L)")))
    blocks = staged(part_side.unionByName(loose_side).select("leader", "part", "chunk", "loose", "doc", "node").distinct(), "blocks")
    kept = confirmed.filter("node IS NOT NULL").select("node", "items").dropDuplicates(["node"])
    across = staged(_dealt(blocks.join(kept, "node").select("leader", "part", "chunk", "loose", "doc", "node", "items"), ["leader", "part", "chunk"], _confirm_across(tau), "a long, b long"), "across")
    drop_staged(members, likely, names, named, blocks)
    return inside.union(across), [confirmed, across]


def _shared_ids(signed: DataFrame, classes: DataFrame) -> list[DataFrame]:
    """Links between a doc_id whose rows have different sets and the doc_ids of their classes; none in the usual case."""
    several = staged(signed.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"), F.count("*").alias("n_ids")).filter("low <> high").select("doc_id", "n_ids"), "shared_ids")
    if several.isEmpty():
        return []
    rows = salted_lookup(signed.select("doc_id", "set_key"), several, "doc_id", "set_key", "n_ids").filter("n_ids IS NOT NULL").select("doc_id", "set_key").distinct()
    return [salted_lookup(rows, classes.select("set_key", "doc", "n_rows"), "set_key", "doc_id", "n_rows").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))]


def near_duplicates(docs: DataFrame, tau: float = TAU) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; sets of similarity `tau` or more are linked."""
    signed = staged(sketches(docs), "sketches")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(
        some.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")).withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    links, used = near_links(docs, classes, tau)
    for more in _shared_ids(some, classes):
        links = links.union(more)
    names = components(links)
    named = classes.select("set_key", "doc", "n_rows").join(names.withColumnRenamed("node", "doc"), "doc", "left")
    named = staged(named.select("set_key", F.coalesce("component", "doc").alias("component"), "n_rows"), "named")
    drop_staged(classes, names, *used)
    found = salted_lookup(signed.select("doc_id", "n_shingles", "set_key"), named, "set_key", "doc_id", "n_rows", nulls=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
