"""Operator 12: a Merkle manifest of a dataset, with a proof for every row from pointer jumping.

A row's leaf is the digest of its fields. The leaves of a source, in order of doc_id, are hashed in runs of FAN consecutive ones,
level by level, to the source's subroot; the subroots, in order of source, are hashed in the same way to the root.

Proofs: every node below the root holds a pointer to an ancestor and the sibling segments (what stands left and right of the path)
up to it. A self-join takes each node to its ancestor's ancestor and puts the two segments one after the other, so the
distance doubles and a tree of depth d is done in log2(d) rounds. Leaves take their parents' segments at the end: the
inner nodes, half as many as leaves, are all that jumps.

Scale: leaves are numbered by ranges of (source, doc_id), so a source with a third of all rows is dealt to many tasks; a
level has a third of the rows of the one below; runs and pointers have at most FAN rows a key in the level tables. In round r an ancestor has up to
FAN**(2**r) nodes below it, but then ancestors are few: they are broadcast where their bytes (counted) are under BROADCAST_BYTES, and with more of them
than that none is hot (at distance 16 that takes some 10**12 leaves). Every level and round is written to the shared folder.

Ties: rows with the same source and doc_id are ordered by their leaves; equal leaves are interchangeable. Null doc_ids come first in
their source; a null source is a source of its own and comes first. A single leaf is its source's subroot, a single subroot
the root; where there are no siblings the proof is the digest of nothing. An empty table gives no rows and has no root. Only the five
fields are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm._stage import drop_staged, salted_lookup, staged
from sparkquill.operators.ranks import numbered

FAN = 3
#: Ancestors are broadcast where they have fewer bytes than this.
BROADCAST_BYTES = 16 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEVEL = 1 << 50  # a node's place: level * _LEVEL + number in its level
_TOP = -1  # the tree over the subroots
_SEG = "array<struct<l:binary,r:binary>>"


def digest(text: Column) -> Column:
    """H as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_text(node: Column) -> Column:
    return F.lower(F.hex(node))


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 bytes, colon, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    return digest(F.concat(*[field(F.col(f) if f != "text" or text is None else text) for f in FIELDS]))


def tampered() -> Column:
    """The leaf after the line feeds are deleted, in the rows whose doc_id has an even CRC-32; null where nothing changes."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even & F.contains("text", F.lit("\n")), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def _source(source: Column) -> Column:
    """A source as a string that isn't null and keeps the order, null first."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def _numbered_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`leaves` (src, doc_id, leaf, tampered) as s (number of the source), at, idx (both the place in the source), n, doc_id, digest, tampered; and the sources: src, s, n."""
    placed = numbered(leaves, ["src", "doc_id", "leaf"], "_row")  # gapless over all rows: a source's places are its numbers less its first
    sources = staged(numbered(placed.groupBy("src").agg(F.min("_row").alias("_first"), F.count("*").alias("n")), ["src"], "s"), "sources")
    idx = F.col("_row") - F.col("_first")
    rows = salted_lookup(placed, sources, "src", "_row", "n").select("s", idx.alias("at"), idx.alias("idx"), "n", "doc_id", F.col("leaf").alias("digest"), "tampered")
    return staged(rows, "leaves"), sources


def _run(rows: DataFrame, tree: Column, level: int, *carried: str) -> DataFrame:
    """One level up: rows (s, at, idx, n, digest) -> s, at, idx, n, digest of the parents, and `kids`, their children in order."""
    kid = F.struct("idx", "digest", F.col("s").alias("s"), F.col("at").alias("at"), *carried)
    runs = rows.groupBy(tree.alias("s"), F.floor(F.col("idx") / FAN).alias("_up"), F.ceil(F.col("n") / FAN).alias("n")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))  # FAN children at most
    joined = F.aggregate("kids", F.lit(""), lambda acc, k: F.concat(acc, as_text(k["digest"])))
    return runs.select("s", (F.lit((level + 1) * _LEVEL) + F.col("_up")).alias("at"), F.col("_up").alias("idx"), "n", digest(joined).alias("digest"), "kids")


def _segment(kids: Column, k: Column) -> Column:
    """What stands left and right of child k of a run."""
    def glued(part: Column) -> Column:
        return F.aggregate(part, F.lit(b""), lambda acc, x: F.concat(acc, x["digest"]))

    return F.struct(glued(F.slice(kids, F.lit(1), k)).alias("l"), glued(F.slice(kids, k + 2, F.lit(FAN))).alias("r"))


def _links(runs: DataFrame) -> DataFrame:
    """s, at of each child with up_s, up_at of its parent, its segment, and `own`, its digest."""
    kid = runs.select(F.col("s").alias("up_s"), F.col("at").alias("up_at"), "kids", F.posexplode("kids").alias("_k", "_kid"))
    return kid.select(F.col("_kid.s").alias("s"), F.col("_kid.at").alias("at"), "up_s", "up_at", F.array(_segment(F.col("kids"), F.col("_k"))).alias("seg"), F.col("_kid.digest").alias("own"))


class Manifest:
    """The trees of a dataset: `docs` (the five fields) is read once; levels are tables."""

    def __init__(self, docs: DataFrame):
        rows = docs.select(_source(F.col("source")).alias("src"), "doc_id", leaf().alias("leaf"), tampered().alias("tampered"))
        written = staged(rows, "digests")  # the sort samples its input: texts are hashed once
        leaves, sources = _numbered_leaves(written)
        drop_staged(written)
        most, count = sources.agg(F.max("n"), F.count("*")).first()
        self.sources, self.spark = count, docs.sparkSession
        #: leaf runs (FAN leaves with what their rows carry), and the runs of inner nodes by level
        self.bottom, self.inner, roots, rows, level, self.levels = None, [], [], leaves, 0, 0
        self.lone = leaves.filter("n = 1")  # leaves that are their source's subroot
        roots.append(self.lone.select("s", "at", "digest"))
        while most and most > 1:
            runs = staged(_run(rows.filter("n > 1"), F.col("s"), level, *(["doc_id", "tampered"] if level == 0 else [])), "level")
            if level == 0:
                self.bottom = runs
            else:
                self.inner.append(runs)
            rows, level, most = runs.select("s", "at", "idx", "n", "digest"), level + 1, -(-most // FAN)
            roots.append(rows.filter("n = 1").select("s", "at", "digest"))
        self.levels = level
        tops = roots[0]
        for more in roots[1:]:
            tops = tops.unionByName(more)
        self.subroots = staged(tops, "subroots")
        rows, most, level = self.subroots.select("s", "at", F.col("s").alias("idx"), F.lit(count).cast("long").alias("n"), "digest"), count, 0
        self.tops: list[DataFrame] = []
        while most > 1:
            runs = staged(_run(rows, F.lit(_TOP).cast("long"), level), "top")
            self.tops.append(runs)
            rows, level, most = runs.select("s", "at", "idx", "n", "digest"), level + 1, -(-most // FAN)
        self.top_levels = level
        last = rows.select("s", "at", "digest").first()  # the root: one row
        self.root = last["digest"].hex() if last else None
        self.root_id = (last["s"], last["at"]) if last else (0, 0)

    def _is_root(self, s: str, at: str) -> Column:
        return (F.col(s) == self.root_id[0]) & (F.col(at) == self.root_id[1])

    def paths(self) -> DataFrame:
        """s, at, seg, subroot of every inner node below the root, and of leaves that are subroots: its segments up to the root, by pointer jumping."""
        links = self.spark.createDataFrame([], f"s long, at long, up_s long, up_at long, seg {_SEG}, own binary")
        for runs in self.inner + self.tops:
            links = links.unionByName(_links(runs))
        # a link out of a source's tree begins at the subroot
        subroot = F.when((F.col("s") != _TOP) & (F.col("up_s") == _TOP), F.col("own"))
        nodes = staged(links.select("s", "at", "up_s", "up_at", "seg", subroot.alias("subroot"), self._is_root("up_s", "up_at").alias("done")), "jumps")
        distance, depth = 1, max(self.levels, 1) + self.top_levels
        while distance < depth:
            # whoever is an ancestor at this distance: in a source's tree, a node that high; any node over the sources
            upper = nodes.filter((F.col("s") == _TOP) | (F.col("at") >= (1 + distance) * _LEVEL))
            upper = upper.select(F.col("s").alias("up_s"), F.col("at").alias("up_at"), F.col("up_s").alias("next_s"), F.col("up_at").alias("next_at"), F.col("seg").alias("more"), F.col("subroot").alias("_sub"), F.col("done").alias("_done"))
            size = upper.count() * (100 + 70 * distance)
            going = nodes.filter(~F.col("done")).join(F.broadcast(upper) if size < BROADCAST_BYTES else upper, ["up_s", "up_at"])
            jumped = going.select("s", "at", F.col("next_s").alias("up_s"), F.col("next_at").alias("up_at"), F.concat("seg", "more").alias("seg"), F.coalesce("subroot", "_sub").alias("subroot"), F.col("_done").alias("done"))
            nodes, old = staged(nodes.filter("done").unionByName(jumped), "jumps"), nodes
            drop_staged(old)
            distance *= 2
        return nodes.select("s", "at", "seg", "subroot")

    def proofs(self) -> DataFrame:
        """doc_id, leaf, tampered (or null), subroot (digests), seg (left and right siblings by level) of every row."""
        paths = self.paths()
        empty, none = F.array().cast(_SEG), F.lit(None).cast("binary")
        alone = self.lone.join(paths, ["s", "at"], "left").select("doc_id", F.col("digest").alias("leaf"), "tampered", F.col("digest").alias("subroot"), F.coalesce("seg", empty).alias("seg"))
        if self.bottom is None:
            return alone
        # a run of leaves meets its parent's path; the parent has none where it is the root
        met = self.bottom.select("s", "at", "digest", "kids").join(paths, ["s", "at"], "left")
        kid = met.select("digest", "subroot", "seg", "kids", F.posexplode("kids").alias("_k", "_kid"))
        below = kid.select(
            F.col("_kid.doc_id").alias("doc_id"), F.col("_kid.digest").alias("leaf"), F.col("_kid.tampered").alias("tampered"), F.coalesce("subroot", F.when(F.col("seg").isNull(), F.col("digest")), none).alias("subroot"),
            F.concat(F.array(_segment(F.col("kids"), F.col("_k"))), F.coalesce("seg", empty)).alias("seg"),
        )
        return below.unionByName(alone)


def proof_digest(seg: Column) -> Column:
    """The siblings, level by level, left to right, as one digest."""
    return F.sha2(F.aggregate(seg, F.lit(""), lambda acc, x: F.concat(acc, as_text(x["l"]), as_text(x["r"]))).cast("binary"), 256)


def fold(node: Column, seg: Column) -> Column:
    """The root that a leaf and its siblings make, as text: a level without siblings hashes the node alone."""
    return F.aggregate(seg, as_text(node), lambda acc, x: F.sha2(F.concat(as_text(x["l"]), acc, as_text(x["r"])).cast("binary"), 256))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, with the tampering of `tampered`."""
    manifest = Manifest(docs)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("seg"))
    found = manifest.proofs().select("doc_id", as_text(F.col("leaf")).alias("leaf"), F.coalesce(as_text(F.col("subroot")), F.lit(manifest.root).cast("string")).alias("subroot"), F.lit(manifest.root).cast("string").alias("root"), proof_digest(F.col("seg")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
