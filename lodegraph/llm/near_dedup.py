"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each document becomes a set of word shingles, a digest of the set and a
   signature of `coordinates` MinHash values. Documents with equal sets form a
   class, and only its representative (least doc_id) goes on.
2. Representatives are posted under each (coordinate, value). Two sets that agree
   in `matches` of K coordinates share a posting in any K - matches + 1 of them, so
   each representative is merged under its rarest K - matches + 1 postings only
   (the prefix). Postings that hold one document use up the prefix and join nothing;
   the long lists are skipped, their collisions counted from the signatures.
3. In each list, pairs that collide in `matches` coordinates and whose sizes admit
   the threshold are candidates. What leaves the list is a spanning forest of them.
4. Components of candidates are clusters. Within a cluster full sets decide;
   pairs in one component already need no decision.

Lists beyond a block are dealt out as pairs of blocks. A cluster beyond a block is dealt
out in parts, each with the same few members beside it, its hubs: members that link to the first hub,
directly or through others of their part, are settled, and only the rest is compared with all. So
a large group of copies costs one pass over its texts, no task holds an unbounded group, and
no pair is left out. Joins of tables that grow with the documents are merged; only what has few rows is
broadcast. The share of truly linked pairs
that step 3 misses is the binomial tail below `matches` at the threshold: 5e-7 for
16 of 32 at 0.85.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.components import FEW, connected_components, side
from lodegraph.llm.shingles import minhash, permutations, shingle_sets, text_buffer, word_hashes
from lodegraph.llm.workspace import Workspace


@dataclass(frozen=True)
class NearDedup:
    """Parameters. A link is 100 * |A and B| >= percent * |A or B| over shingles of `words` words.

    `matches` below half the expected collisions keeps misses rare. `list_block` is the
    number of postings and `set_block` the number of shingles that one task compares.
    """

    words: int = 5
    percent: int = 80
    coordinates: int = 32
    matches: int = 14
    list_block: int = 4096
    set_block: int = 200_000
    batch_rows: int = 256


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) for each row of `docs` (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = permutations(p.coordinates)
        for batch in batches:
            for part in _slices(batch, p.batch_rows):
                sets = shingle_sets(*word_hashes(*text_buffer(part.column(1))), p.words)
                values = minhash(sets, *hashes).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, values.size + 1, p.coordinates, dtype=np.int32), pa.array(values.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n_shingles long, set_key binary, signature array<int>")


class Forest:
    """Union-find over positions; the root of a tree is its least position."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds links between positions, as rounds of taking the lesser label."""
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by `keys`, of about `rows` rows or one larger group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        last = table.num_rows - 1
        same = np.ones(table.num_rows, dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy()
            same &= column == column[last]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        column = table.column(k).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(change)
    return starts, np.r_[starts[1:], table.num_rows]


def _candidates(p: NearDedup):
    """Spanning forests of the candidates in each list, from rows sorted by list and size."""
    keys = ["posting", "left", "right"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys, 1 << 13):
            node = table.column("node").to_numpy()
            size = table.column("n_shingles").to_numpy()
            signature = table.column("signature").combine_chunks().flatten().to_numpy().reshape(len(node), p.coordinates)
            starts, ends = _runs(table, keys)
            run_end = np.repeat(ends, ends - starts)
            forest = Forest(len(node))
            position = np.arange(len(node))
            for lag in range(1, int((ends - starts).max())):
                a = position[:-lag]
                a = a[a + lag < run_end[a]]
                # sizes ascend within a list, so once the next is too large all later are
                a = a[100 * size[a] >= p.percent * size[a + lag]]
                if not len(a):
                    break
                a = a[forest.label[a] != forest.label[a + lag]]
                a = a[(signature[a] == signature[a + lag]).sum(axis=1) >= p.matches]
                forest.join(a, a + lag)
            linked = np.flatnonzero(forest.label != position)
            yield pa.RecordBatch.from_arrays([pa.array(node[forest.label[linked]]), pa.array(node[linked])], names=["a", "b"])

    return each


def candidate_links(classes: DataFrame, p: NearDedup) -> DataFrame:
    """(a, b): links between classes whose components hold all pairs that may be near-duplicates.

    `classes`: node long, n_shingles long, signature array<int>; a row a class.
    """
    value = F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    postings = classes.select("node", F.posexplode("signature").alias("k", "v")).select("node", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(value).alias("posting"))
    lengths = postings.groupBy("posting").agg(F.count("*").alias("length")).filter("length > 1")
    shared = postings.join(lengths.hint("merge"), "posting").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("length", "posting"))).alias("lists"))
    # of K - matches + 1 postings in the prefix, K - size(lists) are those that hold one class
    prefix = shared.select("node", F.expr(f"slice(lists, 1, greatest(0, size(lists) - {p.matches - 1}))").alias("lists")).filter("size(lists) > 0")
    posted = prefix.join(classes.hint("merge"), "node").select("node", "n_shingles", "signature", F.explode("lists").alias("list"))
    posted = posted.select("node", "n_shingles", "signature", F.col("list.posting").alias("posting"), F.ceil(F.col("list.length") / p.list_block).cast("long").alias("blocks"))
    return list_links(posted, p)


def list_links(posted: DataFrame, p: NearDedup) -> DataFrame:
    """(a, b): spanning forests of the candidates in each list. `posted`: node, n_shingles, signature, posting, and blocks, into which its list is dealt."""
    dealt = _block_pairs(posted, "node", "blocks").select("posting", "left", "right", "node", "n_shingles", "signature")
    sorted_ = dealt.repartition("posting", "left", "right").sortWithinPartitions("posting", "left", "right", "n_shingles")
    return sorted_.mapInArrow(_candidates(p), "a long, b long").distinct()


def _confirm(p: NearDedup):
    """Components by full sets of each group of rows (cluster, left, right, node, text, settled, big).

    Rows that are settled are of one component beforehand. Gives, for each row, its component's least node in the group
    and whether a settled one is in it; groups of one row only if they are part of a big cluster.
    """

    def compare(nodes: np.ndarray, texts: pa.Array, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sets: list[np.ndarray] = []
        for at in range(0, len(texts), p.batch_rows):
            sets += shingle_sets(*word_hashes(*text_buffer(texts.slice(at, p.batch_rows))), p.words)
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(sizes, kind="stable")
        sets, sizes, nodes, settled = [sets[i] for i in order], sizes[order], nodes[order], settled[order]
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.r_[0, np.cumsum(sizes)]
        forest = Forest(len(sets))
        named = np.argsort(nodes, kind="stable")
        again = np.flatnonzero(nodes[named[1:]] == nodes[named[:-1]])
        forest.join(named[again], named[again + 1])
        known = np.flatnonzero(settled)
        forest.join(known[:-1], known[1:])
        mark = np.zeros(len(values), dtype=np.int32)
        for i in range(len(sets)):
            stop = int(np.searchsorted(p.percent * sizes, 100 * sizes[i], side="right"))
            others = np.arange(i + 1, stop)
            others = others[forest.label[others] != forest.label[i]]
            if not len(others) or not sizes[i]:
                continue
            mark[ids[first[i] : first[i + 1]]] = 1
            if len(others) * 2 > stop - i:
                span = mark[ids[first[i + 1] : first[stop]]]
                common = np.add.reduceat(span, first[i + 1 : stop] - first[i + 1])[others - i - 1]
            else:
                common = np.array([mark[ids[first[j] : first[j + 1]]].sum() for j in others])
            mark[ids[first[i] : first[i + 1]]] = 0
            near = others[100 * common >= p.percent * (sizes[i] + sizes[others] - common)]
            forest.join(np.full(len(near), i), near)
        least = np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(least, forest.label, nodes)
        hit = np.zeros(len(sets), dtype=bool)
        hit[forest.label[settled]] = True
        return nodes, least[forest.label], hit[forest.label]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["cluster", "left", "right"]
        for table in _groups(batches, keys, 1):
            table = table.combine_chunks()
            for a, b in zip(*(x.tolist() for x in _runs(table, keys)), strict=True):
                part = table.slice(a, b - a)
                big = part.column("big")[0].as_py()
                if part.num_rows < 2 and not big:
                    continue
                nodes, root, hit = compare(part.column("node").to_numpy(), part.column("text").chunk(0), part.column("settled").to_numpy())
                n = len(nodes)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root), pa.array(hit), pa.array([big] * n), part.column("cluster").chunk(0)], names=["a", "b", "hit", "big", "cluster"])

    return each


_CONFIRMED = "a long, b long, hit boolean, big boolean, cluster long"


def _block_pairs(df: DataFrame, node: str, blocks: str) -> DataFrame:
    """Each row once for each pair of blocks that has the row's own: (left, right). One block: (0, 0)."""
    own = F.pmod(F.xxhash64(F.col(node)), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    return df.withColumn("own", own).withColumn("other", other).withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other")).drop("own", "other")


def _spread(members: DataFrame, clusters: DataFrame, rows: int, ways: int = 16) -> DataFrame:
    """`members` (node, cluster, ...) with the columns of their row of `clusters` (at most `rows`), a cluster's members dealt to some tasks."""
    if rows <= FEW:
        return members.join(F.broadcast(clusters), "cluster")
    dealt = members.withColumn("way", F.pmod(F.xxhash64("node"), F.lit(ways)).cast("int"))
    return dealt.join(clusters.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).hint("merge"), ["cluster", "way"]).drop("way")


def _compared(dealt: DataFrame, p: NearDedup) -> DataFrame:
    """_CONFIRMED for each group of rows with one (cluster, left, right)."""
    groups = dealt.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right")
    return groups.select("cluster", "left", "right", "node", "text", "settled", "big").mapInArrow(_confirm(p), _CONFIRMED)


def marked(work: Workspace, docs: DataFrame, nodes: DataFrame, most_bits: int = 1 << 30) -> DataFrame:
    """The rows of `docs` (node, ...) whose node may be one of `nodes` (node), and all that are.

    A bitmap has eight bits a node, one of which its hash sets; it is broadcast in pieces of 4 KB, 128 MB at most.
    Where that is too little for the nodes, all rows are returned.
    """
    wanted = 8 * nodes.count()
    if wanted > most_bits:
        return docs
    bits = max(1 << 15, 1 << (wanted - 1).bit_length() if wanted else 0)
    place = F.pmod(F.xxhash64(F.lit(7), F.col("node")), F.lit(bits))
    piece, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    marks = work.keep(nodes.groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(bit).alias("marks")), "marks")
    octet = F.conv(F.hex(F.substring(F.col("marks"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(octet, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return docs.join(F.broadcast(marks), (piece == F.col("piece")) & is_set, "left_semi")


def verified_components(work: Workspace, docs: DataFrame, clusters: DataFrame, p: NearDedup, same: DataFrame | None = None) -> DataFrame:
    """(node, component): links by full shingle sets within clusters, and `same` (a, b) beside them, and their components.

    `docs`: doc_id, text; `clusters`: node (a doc_id), cluster, n_shingles (a guess will do:
    it only says into how many parts a cluster is dealt). Nodes that link to nothing
    are left out.

    A cluster's hubs are the members with the least and the greatest of two hashes. What is not settled after the first
    pass, in which every part holds the hubs, is compared with all members of its cluster in a second.
    """
    hashes = [F.xxhash64(F.lit(k), F.col("node")) for k in (1, 2)]
    hubs = F.array_distinct(F.array(*(f("node", h) for h in hashes for f in (F.min_by, F.max_by))))
    parts = F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / p.set_block)).cast("long")
    clusters = work.keep(clusters, "near")
    most = clusters.count()
    sized = clusters.groupBy("cluster").agg(parts.alias("parts"), hubs.alias("hubs"))
    placed = work.keep(_spread(clusters, sized, most).groupBy("node", "cluster", "parts", "hubs").agg(F.max("n_shingles").alias("n_shingles")), "placed")
    # texts of documents in no cluster stay where they are
    whole = marked(work, docs.select(F.col("doc_id").cast("long").alias("node"), "text"), placed.select("node"))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    is_hub = (F.col("parts") > 1) & F.array_contains(F.col("hubs"), F.col("node"))
    first = whole.join(side(placed, most), "node").select(
        "cluster", F.explode(F.when(is_hub, everywhere).otherwise(F.array(own))).alias("left"), F.lit(0).cast("long").alias("right"), "node", "text", (F.col("node") == F.col("hubs")[0]).alias("settled"), (F.col("parts") > 1).alias("big")
    )
    found = work.keep(_compared(first, p), "found")
    links = found.select("a", "b")
    rest = found.filter("big").groupBy("cluster", "a").agg(F.max("hit").alias("hit")).filter("not hit").select("cluster", F.col("a").alias("node"))
    rest = work.keep(rest, "rest")
    left = rest.count()
    if left:
        weighed = placed.join(side(rest, left), ["cluster", "node"]).groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / p.set_block)).cast("long").alias("blocks"))
        open_ = _spread(placed, weighed, left).join(side(rest.withColumn("open", F.lit(True)), left), ["cluster", "node"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
        block = F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.col("blocks"))
        pair = lambda left, right: F.struct(left.alias("left"), right.alias("right"))
        # a block of the rest meets every part of the cluster
        as_all = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: pair(i, own))
        as_rest = F.transform(everywhere, lambda j: pair(block, j))
        at = F.explode(F.when(F.col("open"), F.array_distinct(F.concat(as_all, as_rest))).otherwise(as_all)).alias("at")
        second = whole.join(side(open_, most), "node").select("cluster", at, "node", "text", (~F.col("open")).alias("settled")).select("cluster", "at.left", "at.right", "node", "text", "settled", F.lit(False).alias("big"))
        links = links.unionByName(work.keep(_compared(second, p), "found2").select("a", "b"))
    out = connected_components(work, links if same is None else links.unionByName(same), "joined")
    work.drop("near", "placed", "rest")
    return out


def near_components(spark: SparkSession, docs: DataFrame, params: NearDedup | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`, which needs doc_id and text.

    A document without words, or with null text, has no shingles and links to nothing.
    Rows that share a doc_id are one document with the links of all its texts. A row
    without a doc_id can't be named: it links to nothing, its component_id is null and it
    is kept. Other columns of `docs` are not looked at. An empty table gives no rows.
    """
    p = params or NearDedup()
    work = Workspace(spark, "near")
    docs = docs.select("doc_id", "text")
    rows = work.keep(signatures(docs, p), "rows")
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    sets = full.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = work.keep(sets.withColumn("class", F.xxhash64("set_key")), "classes")
    links = candidate_links(classes.select(F.col("class").alias("node"), "n_shingles", "signature"), p)
    clusters = work.keep(connected_components(work, links, "cluster"), "clusters")
    members = classes.select(F.col("class").alias("id"), F.col("node").alias("doc"), "n_shingles")
    most = clusters.count()
    near = members.join(side(clusters, most), F.col("node") == F.col("id")).select(F.col("doc").alias("node"), F.col("component").alias("cluster"), "n_shingles")
    # a doc_id with several texts belongs to all their classes
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x <> y")
    shared = work.keep(full.join(several.hint("merge"), "doc_id", "left_semi").select("doc_id", "set_key"), "shared")
    texts = shared.count()
    same = classes.select("set_key", "node").join(side(shared, texts), "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")) if texts else None
    component = verified_components(work, docs, near, p, same)
    named = classes.select("set_key", "node").join(side(component, most + 2 * texts), "node", "left").select(F.col("set_key").alias("key"), F.coalesce("component", "node").alias("component"))
    own = F.when(F.col("n_shingles") > 0, F.col("component"))
    out = rows.join(named.hint("merge"), rows["set_key"] == named["key"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
