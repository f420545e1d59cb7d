"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds its distinct five-word shingles. Documents with equal sets are one class, which its smallest
doc_id stands for. Each tree of the forest is one sorted order of the classes' signatures, rotated to begin at another
place; neighbours in that order share the longest prefixes. The orders are made by range partitioning, so a dense
region spreads over many tasks. A row is compared with its neighbours to an adaptive depth: where the nearest one is
clearly similar the region is dense, and one link suffices to keep it together; elsewhere up to WINDOW neighbours that
share MIN_PREFIX values are taken. Candidates whose signatures agree in at least FLOOR of their places are confirmed on
the full sets: first the best candidate of each class, then, after a union-find, those that would still join two
components; a candidate within one component can't change anything. At last all pairs of a region (a tree's rows with
the same first MIN_PREFIX values) that still lie in different components are compared in blocks, without a window:
signatures first, then, of rows with a partner, the full sets in the same task. None that shares a region and could join
two components is left untested, and no rows of pairs are made but those that join components.

Words: runs of characters other than the space and U+0009 to U+000D, after lower-casing A-Z. A text with fewer words
than five is one shingle; without words, or null, the set is empty and linked with nothing. A null doc_id is linked with
nothing and kept. Rows of one doc_id are one document. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_texts, block_pairs, cut_lineage, read_table
from .components import SALTS, connected_components, joined_components
from .pieces import span_hashes

WORDS = 5
PERCENT = 75
PLACES = 64
TREES = 16
MIN_PREFIX = 3
WINDOW = 8
DENSE = 0.9
#: More than four standard deviations below the threshold for PLACES values.
FLOOR = 0.5
#: Rows of a region whose signatures meet in one task; rows and shingles of a part of them whose full sets do, which
#: bounds the memory of a task; members of sets that are counted in one step.
BLOCK = 2048
TILE = 1024
TILE_SHINGLES = 1 << 20
MEMBERS = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles laid end to end, their number in each text); a text's own may repeat."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    upper = (data >= 65) & (data <= 90)
    points = np.where(upper, data + 32, data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = span_hashes(points, begins, ends)
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    owner = np.searchsorted(text_ends, begins, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    with np.errstate(over="ignore"):
        rolled = h.copy()
        for k in range(1, min(words, len(h))):
            rolled[: len(h) - k] = rolled[: len(h) - k] * _MIX + h[k:]
        counts = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
        first = np.cumsum(n_words) - n_words
        for i in np.flatnonzero((n_words > 0) & (n_words < words)).tolist():  # the whole sequence as one
            total = np.uint64(n_words[i])
            for x in h[first[i] : first[i] + n_words[i]]:
                total = total * _MIX + x
            rolled[first[i]] = total
    stops = np.cumsum(counts)
    total = int(stops[-1]) if len(stops) else 0
    at = np.arange(total) + np.repeat(first - (stops - counts), counts)
    return _mixed(rolled[at]), counts


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set) and signature of each document."""
    import pyarrow as pa

    names = ["doc_id", "n_shingles", "set_hash", "signature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    seeds = np.random.default_rng(7).integers(1, 1 << 63, PLACES, np.uint64) | np.uint64(1)

    def run(batches: Iterator) -> Iterator:
        for keys, texts in arrow_texts(batches):
            h, counts = shingle_hashes(texts)
            full = np.flatnonzero(counts)
            signature = np.zeros((len(texts), PLACES), np.uint8)
            sizes, hashes = counts.astype(np.int64).copy(), np.zeros(len(texts), np.int64)
            if len(full):
                stops = np.cumsum(counts)
                starts = (stops - counts)[full]
                for k in range(PLACES):
                    with np.errstate(over="ignore"):
                        low = np.minimum.reduceat(h * seeds[k], starts)
                    signature[full, k] = (_mixed(low) & np.uint64(255)).astype(np.uint8)
                for i in full.tolist():
                    own = np.unique(h[stops[i] - counts[i] : stops[i]])
                    sizes[i] = len(own)
                    with np.errstate(over="ignore"):
                        hashes[i] = _mixed(own ^ _MIX).sum().view(np.int64)
            empty = counts == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, types[0]), pa.array(sizes), pa.array(hashes, mask=empty), pa.array([s.tobytes() for s in signature], types[3])],
                names,
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, n_shingles long, set_hash long, signature binary")


def candidates(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """Pairs a < b of classes(rep, signature) that are neighbours in an order, with the share of places that agree."""
    import pyarrow as pa

    step = PLACES // trees
    turned = classes.select("rep", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "signature")
    path = F.concat(F.expr(f"substring(signature, tree * {step} + 1, {PLACES})"), F.expr(f"substring(signature, 1, tree * {step})"))
    ordered = turned.select("tree", path.alias("path"), "rep")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "tree", "path", "rep").sortWithinPartitions("tree", "path", "rep")

    def run(batches: Iterator) -> Iterator:
        tree, paths, reps = np.zeros(0, np.int32), np.zeros((0, PLACES), np.uint8), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = len(reps)
            tree = np.concatenate([tree, batch.column(0).to_numpy()])
            new = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, PLACES)
            paths = np.concatenate([paths, new])
            reps = np.concatenate([reps, batch.column(2).to_numpy()])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            dense = np.zeros(len(reps), bool)
            for back in range(1, min(WINDOW, len(reps) - 1) + 1):
                right = np.arange(max(back, kept), len(reps))
                right = right[~dense[right]]
                left = right - back
                near = (tree[left] == tree[right]) & (paths[left, :MIN_PREFIX] == paths[right, :MIN_PREFIX]).all(1) & (reps[left] != reps[right])
                left, right = left[near], right[near]
                share = (paths[left] == paths[right]).mean(1)
                if back == 1:
                    dense[right[share >= DENSE]] = True
                good = share >= FLOOR
                found.append((reps[left[good]], reps[right[good]], share[good]))
            tree, paths, reps = tree[-WINDOW:], paths[-WINDOW:], reps[-WINDOW:]
            if found:
                a, b, share = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(share)], ["a", "b", "share"])

    return ordered.mapInArrow(run, "a long, b long, share double").groupBy("a", "b").agg(F.max("share").alias("share"))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs(a, b) whose full sets, made from texts(rep, text), are similar enough."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for i in range(0, len(a), 256):
                left, right = (batch.column(c)[i : i + 256].to_pylist() for c in (2, 3))
                h, counts = shingle_hashes([*left, *right])
                sets = [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])]
                for k in range(len(left)):
                    x, y = sets[k], sets[len(left) + k]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _tiles(rows: np.ndarray, sizes: np.ndarray, tile: int) -> list[np.ndarray]:
    """rows in parts of at most `tile` rows and TILE_SHINGLES shingles, or one row."""
    parts, first, held = [], 0, 0
    for i, n in enumerate(sizes[rows].tolist()):
        if i > first and (i - first == tile or held + n > TILE_SHINGLES):
            parts.append(rows[first:i])
            first, held = i, 0
        held += n
    return [*parts, rows[first:]] if len(rows) else []


def sifted(classes: DataFrame, labels: DataFrame, trees: int = TREES, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """The classes(rep, n_shingles, signature) that share a region with one of another component whose signature agrees in
    FLOOR of its places, once for each pair of tiles in which such a partner is: rows of tiles, never pairs of classes.

    tree, prefix, _hi, _lo, _i, _j name the pair of tiles, _side (0 or 1) the row's tile; a tile paired with itself has
    side 0 only.
    """
    import pyarrow as pa

    step = PLACES // trees
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("rep", F.coalesce("component", "rep").alias("component"), "signature")
    turned = named.select("rep", "component", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.concat("signature", "signature").alias("_twice"))
    rows = turned.select("tree", F.expr(f"substring(_twice, tree * {step} + 1, {MIN_PREFIX})").alias("prefix"), "rep", "component")
    keys = ["tree", "prefix", "_hi", "_lo"]
    dealt = block_pairs(cut_lineage(rows), keys[:2], "rep", block).join(classes.select("rep", "n_shingles", "signature"), "rep")
    types = {"tree": pa.int32(), "prefix": pa.binary(), "_hi": pa.int32(), "_lo": pa.int32(), "_i": pa.int32(), "_j": pa.int32(), "_side": pa.int32(), "rep": pa.int64(), "component": pa.int64()}

    def sift(table):
        own, component, sizes = (table.column(c).to_numpy() for c in ("_own", "component", "n_shingles"))
        places = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, PLACES).T.copy()
        hi, lo = table.column("_hi")[0].as_py(), table.column("_lo")[0].as_py()
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")  # the same tiles again when a task is repeated
        left, right = (_tiles(order[own[order] == x], sizes, tile) for x in (lo, hi))
        found = [(np.zeros(0, np.int64),) * 4]
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if hi == lo and i > j:
                    continue
                agree = np.zeros((len(x), len(y)), np.uint8)
                for p in places:
                    agree += p[x][:, None] == p[y][None, :]
                good = (agree >= FLOOR * PLACES) & (component[x][:, None] != component[y][None, :])
                if not good.any():
                    continue
                same = hi == lo and i == j
                for side, at in ((0, x[good.any(1)]), (1, y[good.any(0)][: 0 if same else None])):
                    found.append((at, *(np.full(len(at), k) for k in (i, j, side))))
        at, i, j, side = (np.concatenate(c) for c in zip(*found, strict=True))
        held = table.take(pa.array(at))
        new = {"_i": pa.array(i, pa.int32()), "_j": pa.array(j, pa.int32()), "_side": pa.array(side, pa.int32())}
        return pa.Table.from_arrays([new[c] if c in new else held.column(c).cast(t) for c, t in types.items()], schema=pa.schema(list(types.items())))

    return dealt.groupBy(*keys).applyInArrow(sift, "tree int, prefix binary, _hi int, _lo int, _i int, _j int, _side int, rep long, component long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each two of left and right, sets as sorted arrays, have in common."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (left, right)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    shared = np.zeros((len(left), len(right)), np.int64)
    spots = []
    for h, owner in sides:
        at = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
        in_both = both[at] == h if len(both) else np.zeros(len(h), bool)
        at, owner = at[in_both], owner[in_both]
        order = np.argsort(at, kind="stable")
        spots.append((at[order], owner[order]))
    for first in range(0, len(both), MEMBERS):
        marks = []
        for (at, owner), n in zip(spots, shared.shape, strict=True):
            here = slice(*np.searchsorted(at, [first, first + MEMBERS]))
            mark = np.zeros((n, MEMBERS), np.float32)
            mark[owner[here], at[here] - first] = 1
            marks.append(mark)
        shared += (marks[0] @ marks[1].T).astype(np.int64)
    return shared


def spanning(ends: np.ndarray, pairs: list[tuple[int, int]]) -> list[int]:
    """Places of those pairs of rows that join two components (ends names each row's), taken in turn."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(pairs):
        a, b = root(int(ends[x])), root(int(ends[y]))
        if a != b:
            parent[a] = b
            kept.append(k)
    return kept


def texts_of(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """rep and text of the documents of ends(rep); of rows with one doc_id always the same text."""
    texts = docs.select(docs["doc_id"].cast("long").alias("rep"), docs["text"]).join(ends, "rep", "left_semi")
    return cut_lineage(texts.groupBy("rep").agg(F.min("text").alias("text")))


def region_links(active: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the components of active (rows of `sifted`), confirmed on the full sets of texts(rep, text).

    All pairs of two tiles are tested where the tiles meet. Of the links found there only as many go on as join
    components that were apart, so that a large family gives no more rows than it has classes.
    """
    import pyarrow as pa

    def sets_of(batches: Iterator) -> Iterator:
        for reps, held in arrow_texts(batches):
            h, counts = shingle_hashes(held)
            sets = [np.unique(x).tobytes() for x in np.split(h, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], ["rep", "members"])

    keys = ["tree", "prefix", "_hi", "_lo", "_i", "_j"]
    sets = texts.select("rep", "text").mapInArrow(sets_of, "rep long, members binary")

    def test(table):
        side, rep, component = (table.column(c).to_numpy() for c in ("_side", "rep", "component"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)
        right = left if alone else right
        members = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        sizes = np.array([len(x) for x in members])
        shared = overlaps([members[k] for k in left], [members[k] for k in right])
        good = (100 * shared >= percent * (sizes[left][:, None] + sizes[right][None, :] - shared)) & (component[left][:, None] != component[right][None, :])
        x, y = (w[k] for w, k in zip((left, right), np.nonzero(good), strict=True))
        kept = np.array(spanning(component, list(zip(x.tolist(), y.tolist(), strict=True))), np.int64)
        return pa.table({"a": rep[x[kept]], "b": rep[y[kept]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return active.hint("merge").join(sets, "rep").groupBy(*keys).applyInArrow(test, "a long, b long")


def settled(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The components (node, component) of the confirmed ones of pairs(a, b, share): the best pair of each class first,
    then those that would still join two components. Components grow; their links are not united again."""
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    best = F.max_by(F.struct("a", "b"), F.struct("share", -F.col("a"), -F.col("b")))
    sides = pairs.select(F.explode(F.array("a", "b")).alias("_end"), "a", "b", "share")
    first = cut_lineage(sides.groupBy("_end").agg(best.alias("_p")).select("_p.a", "_p.b").distinct())
    labels = connected_components(confirm(first, texts, percent))
    left = labels.select(F.col("node").alias("a"), F.col("component").alias("_a"))
    right = labels.select(F.col("node").alias("b"), F.col("component").alias("_b"))
    open_pairs = pairs.join(left.hint("merge"), "a", "left").join(right.hint("merge"), "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    open_pairs = open_pairs.join(first, ["a", "b"], "left_anti").select("a", "b")
    return joined_components(labels, cut_lineage(confirm(open_pairs, texts, percent)))


def near_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs(doc_id, text)."""
    rows = cut_lineage(sketches(docs))
    useful = rows.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = useful.groupBy("set_hash", "n_shingles").agg(F.min_by("signature", "doc_id").alias("signature"), F.min("doc_id").alias("rep"))
    classes = cut_lineage(classes)
    labels = settled(cut_lineage(candidates(classes.select("rep", "signature"))), docs, percent)
    active = cut_lineage(sifted(classes.select("rep", "n_shingles", "signature"), labels))
    labels = joined_components(labels, region_links(active, texts_of(docs, active.select("rep").distinct()), percent))
    whole = classes.join(labels, classes["rep"] == labels["node"], "left")
    whole = whole.select("set_hash", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    spread = whole.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("n_shingles", "_n")
    salted = rows.select("doc_id", "n_shingles", "set_hash", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    joined = salted.join(spread, (salted["set_hash"] == spread["set_hash"]) & (salted["_salt"] == spread["_salt"]) & (salted["n_shingles"] == spread["_n"]) & salted["doc_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select(salted["doc_id"], salted["n_shingles"], component.alias("component_id"), F.coalesce(salted["doc_id"] == component, F.lit(True)).alias("kept"))


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents"))
