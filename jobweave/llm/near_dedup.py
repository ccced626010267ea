"""Near duplicates by an LSH forest over word shingles, confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.shared import fingerprint, small_side, stash


@dataclass(frozen=True)
class Forest:
    """``trees`` orders of signatures, ``deepest`` hashes long; two texts can be neighbours in one where
    they share the first ``depth`` hashes, which makes a region of it.  A text meets the ``reach`` next ones
    in its region: those with the longest common prefix, so the depth that counts adapts to the region.

    A pair at similarity s shares the first ``depth`` hashes of some order with probability
    1 - (1 - s^depth)^trees: all but 3 in a million at 0.8.
    """

    words: int = 5
    percent: int = 80
    trees: int = 24
    depth: int = 4
    deepest: int = 12
    reach: int = 2


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed one-to-one function of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash of each word met; forgets them when they are too many."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_KNOWN_WORDS = 300_000
_words = _Words()


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z in lower case; words part at the six white-space characters."""
    words = text.encode().lower().split()
    if len(_words) > _KNOWN_WORDS:
        _words.clear()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The different shingles, sorted, as 64-bit hashes; a shorter text is one shingle."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h * _MIX + w[k:len(w) - n + 1 + k])
    return np.unique(h)


def _min_hashes(s: np.ndarray, count: int) -> np.ndarray:
    """``count`` independent minimum hashes of a set, 32 bits each."""
    rng = np.random.default_rng(20240229)
    a, b = rng.integers(0, 1 << 63, (2, count), dtype=np.uint64)
    a = (a << np.uint64(1)) | np.uint64(1)
    least = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 256):
        h = ((s[at:at + 256][:, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, h.min(axis=0))
    return least


def _key_columns(forest: Forest) -> np.ndarray:
    """For each tree the hashes of its order: the first ``depth`` its own, which name the region, deeper ones of other trees."""
    count = forest.trees * forest.depth
    return (np.arange(forest.trees)[:, None] * forest.depth + np.arange(forest.deepest)) % count


def _describe(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """(doc_id, text fingerprint, n_shingles, set_id, signature) of each document."""
    seen: dict[bytes, bytes] = {}
    for batch in batches:
        sizes, names, signatures = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, forest.words)
            sizes.append(len(s))
            if not len(s):
                names.append(None)
                signatures.append(None)
                continue
            name = fingerprint_of(s)
            if name not in seen:
                if len(seen) > 20_000:
                    seen.clear()
                seen[name] = _min_hashes(s, forest.trees * forest.depth).tobytes()
            names.append(name)
            signatures.append(seen[name])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.binary())],
            names=["doc_id", "_h1", "_h2", "n_shingles", "set_id", "signature"])


def fingerprint_of(s: np.ndarray) -> bytes:
    """A 128-bit digest over all members of a sorted set; sets with the same one are the same set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _regions(signatures: pa.Array, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(region in each tree, hashes that follow it in the tree's order) of each signature."""
    sig = np.frombuffer(b"".join(signatures.to_pylist()), "<u4").reshape(len(signatures), -1)
    keys = sig[:, _key_columns(forest)]  # (n, trees, deepest)
    region = np.full((len(signatures), forest.trees), 1, np.uint64) * np.arange(1, forest.trees + 1, dtype=np.uint64)
    for d in range(forest.depth):
        region = _mixed(region * _MIX + keys[:, :, d])
    return region, keys[:, :, forest.depth:]


def _region_rows(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """The regions of each set, one row for each tree."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            region, _ = _regions(batch.column(0).slice(at, 2_000), forest)
            yield pa.RecordBatch.from_arrays([pa.array(region.reshape(-1).view(np.int64))], names=["region"])


def _forest_rows(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """One row for each set and tree: (region, order in it, node, n).

    The first ``depth`` hashes are the same all over a region, so the order leaves them out.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            n = part.num_rows
            region, deeper = _regions(part.column(1), forest)
            width = 4 * (forest.deepest - forest.depth)
            yield pa.RecordBatch.from_arrays([
                pa.array(region.reshape(-1).view(np.int64)),
                _fixed_binary(np.ascontiguousarray(deeper.astype(">u4")), n * forest.trees, width),
                part.column(0).take(pa.array(np.repeat(np.arange(n), forest.trees))),
                pa.array(np.repeat(part.column(2).to_numpy(), forest.trees)),
            ], names=["region", "order_key", "node", "n"])


def _fixed_binary(values: np.ndarray, count: int, width: int) -> pa.Array:
    offsets = pa.array(np.arange(count + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), count, [None, offsets.buffers()[1], pa.py_buffer(values.tobytes())])


def _neighbours(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """Pairs of each row with the ``reach`` next ones of its region in the sorted order."""
    tail: pa.RecordBatch | None = None
    for batch in batches:
        fresh = 0 if tail is None else tail.num_rows
        rows = batch if tail is None else pa.concat_batches([tail, batch])
        region, size = rows.column(0).to_numpy(), rows.column(2).to_numpy()
        left, right = [], []
        for step in range(1, min(forest.reach, rows.num_rows - 1) + 1):
            at = np.arange(max(fresh - step, 0), rows.num_rows - step)  # pairs whose later row is new
            n, m = size[at], size[at + step]
            at = at[(region[at] == region[at + step]) & (100 * np.minimum(n, m) >= forest.percent * np.maximum(n, m))]
            left.append(at)
            right.append(at + step)
        pick = lambda x: rows.column(1).take(pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()))
        a, b = pick(left), pick(right)
        first = pc.less(a, b)
        yield pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a)], names=["a", "b"])
        tail = rows.slice(max(rows.num_rows - forest.reach, 0))


def _candidates(rows: DataFrame, forest: Forest, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowded rows): every region's sets in their order, each with its next ones.

    ``regions`` has the regions of all rows, where they are cheaper to make by themselves.

    In a region of no more than ``reach`` + 1 sets all meet; of larger ones, the crowded, the sets are
    returned too, for pairs that the orders may miss.  Small regions stay in one task; a
    crowded one is spread over as many as its order takes.
    """
    sizes = stash((rows if regions is None else regions).groupBy("region").agg(F.count(F.lit(1)).alias("_in")).where("_in > 1"), "forest_regions")
    rows = stash(rows.join(sizes, "region"), "forest_shared")
    crowd = F.col("_in") > forest.reach + 1
    along = [F.when(crowd, F.col(c)) for c in ("order_key", "node")]
    ordered = rows.repartitionByRange("region", *along).sortWithinPartitions("region", "order_key", "node")
    near = ordered.select("region", "node", "n").mapInArrow(lambda b: _neighbours(b, forest), "a binary, b binary")
    return near.where("a <> b").distinct(), rows.where(crowd).select("region", "node")


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for at in range(0, len(texts), 500):
            sets = [shingles(t, words) for t in texts[at:at + 500]]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(sets)), pa.array([fingerprint_of(s) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["node", "set_id", "shingles"])


def _links(pairs: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    rows = pairs.join(left, "a").join(right, "b")
    return rows.where(100 * both >= forest.percent * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: root is the smallest node that can be reached.

    Alternating star contraction: each node's larger neighbours are hung onto its smallest
    one, then its smaller ones too, until nothing changes; that takes a number of rounds like
    the logarithm of the longest path.  Each round is written to the shared folder.
    """
    edges = stash(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        # Large star: over both directions, strictly larger neighbours go to the minimum.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the rows of a node with very many neighbours can be split when they meet it.
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_n"), F.least("u", "_m").alias("_m"))
        least = stash(least, "least")
        large = both.join(least, F.col("u") == F.col("_n")).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = stash(large, "large_stars")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = stash(large.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "_n"), "least")
        joined = large.join(low, F.col("u") == F.col("_n"))
        small = joined.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(low.select(F.col("_n").alias("u"), F.col("_m").alias("v")))
        edges = stash(small.distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _crowd_links(crowded: DataFrame, found: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """Links of crowded regions that their orders may have missed, by an exact join.

    Only regions whose sets are not all connected yet matter, and in them only sets outside the
    region's largest component look for partners.  Of two sets that are similar enough, the
    rarest shingles of one, more than a fifth of it, hold one of the rarest of the other; the
    two meet on it.
    """
    named = crowded.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = stash(named.groupBy("region", "root").agg(F.count(F.lit(1)).alias("_n")), "crowd_parts")
    largest = parts.groupBy("region").agg(F.max(F.struct("_n", "root")).alias("_top"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    mixed = stash(named.join(largest, "region").groupBy("node").agg(
        F.first("root").alias("root"), F.max(F.col("root") != F.col("_top.root")).alias("_seeks")), "crowd_mixed")
    members = mixed.join(sets, "node").select("node", "root", "_seeks", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    members = stash(members, "crowd_shingles")
    often = members.groupBy("s").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    ranked = members.join(often, "s", "left").groupBy("node", "root", "_seeks", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(1)).alias("df"), "s"))).alias("_all"))
    # A set of n shares at least ceil(percent * n) shingles with any partner.
    prefix = F.col("n") - F.ceil(F.col("n") * forest.percent / 100).cast("int") + 1
    rare = ranked.select("node", "root", "_seeks", "n", F.posexplode(F.slice("_all", F.lit(1), prefix)).alias("_at", "_e")).where("_e.df > 1")
    rare = stash(rare.select("node", "root", "_seeks", "n", "_at", "_e.s"), "crowd_prefixes")
    x, y = rare.where("_seeks").alias("x"), rare.alias("y")
    # Two sets need this many in common, and can have no more than follow the first they share.
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * forest.percent / (100 + forest.percent))
    pairs = x.join(y, (
        (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root"))
        & (F.col("x.n") - F.col("x._at") >= needed) & (F.col("y.n") - F.col("y._at") >= needed)
    ))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return _links(stash(pairs, "crowd_pairs"), sets, forest)


def _node(least_id: Column, set_id: Column) -> Column:
    """A name for a set that sorts by its smallest key."""
    return F.concat(F.unhex(F.lpad(F.hex(least_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), set_id)


def _key_of(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", forest: Forest | None = None) -> DataFrame:
    """(key, _h1, _h2, n_shingles, component_id, kept, chosen) of every document.

    Documents are linked when their sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` or more; A-Z are lower-cased, a shorter text is one shingle.  component_id is the
    smallest key that links reach, and the row that bears it is kept.  A text without words, or a
    null one, is linked with nothing and kept.  A null key comes after all others.  ``chosen`` is
    kept, but where rows of different texts share the smallest key only those of one text have
    it; ``_h1`` and ``_h2`` are the text's fingerprint.  Repeated rows get the same answer.

    Equal sets are one node from the start, so copies never form pairs.
    """
    forest = forest or Forest()
    # A null key stands after all others until the end.
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *fingerprint(text))
    described = stash(source.mapInArrow(
        lambda b: _describe(b, forest), "doc_id long, _h1 long, _h2 long, n_shingles long, set_id binary, signature binary"), "near_documents")
    nodes = described.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("_least"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    nodes = stash(nodes.withColumn("node", _node(F.col("_least"), F.col("set_id"))), "near_nodes")
    # The rows of all trees are several times the signatures, so they are made twice instead of being written.
    rows = nodes.select("node", "signature", "n").mapInArrow(
        lambda b: _forest_rows(b, forest), "region long, order_key binary, node binary, n long")
    regions = nodes.select("signature").mapInArrow(lambda b: _region_rows(b, forest), "region long")
    pairs, crowded = _candidates(rows, forest, regions)
    pairs, crowded = stash(pairs, "near_pairs"), stash(crowded.distinct(), "near_crowded")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowded.select("node")).distinct()
    wanted = small_side(stash(wanted.withColumn("doc_id", _key_of(F.col("node"))), "near_wanted"))
    # Texts of the wanted sets; the fingerprint tells apart rows that share a key.
    texts = source.select("doc_id", "text").join(wanted, "doc_id").select("node", "text")
    sets = texts.mapInArrow(lambda b: _sets(b, forest.words), "node binary, set_id binary, shingles array<long>")
    sets = sets.where(F.expr("substring(node, 9)") == F.col("set_id")).dropDuplicates(["node"]).select("node", "shingles")
    sets = stash(sets, "near_sets")
    links = stash(_links(pairs, sets, forest), "near_links")
    found = components(links)
    if not crowded.isEmpty():
        found = components(links.unionByName(_crowd_links(crowded, found, sets, forest)))
    roots = stash(nodes.select("set_id", "node").join(found, "node", "left").select(
        F.col("set_id").alias("_s"), F.coalesce("root", "node").alias("root")), "near_roots")
    out = described.drop("signature").join(roots, F.col("set_id") == F.col("_s"), "left").drop("_s")
    alone = F.col("root").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(_key_of(F.col("root"))))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    out = out.withColumn("chosen", F.col("kept") & (alone | (F.expr("substring(root, 9)") == F.col("set_id"))))
    real = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c))
    return out.select(real("doc_id").alias(key), "_h1", "_h2", "n_shingles", real("component_id").alias("component_id"), "kept", "chosen")
