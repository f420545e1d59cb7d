"""Fuzzy line deduplication by MinHash. DataFrame and SQL functions only.

A line's set holds its distinct character shingles: up to SHINGLE characters from the start of every word on, from every
place inside a word of SHINGLE or more characters, and from every character of a script that is written without spaces;
so each character of the line, to its end, is in a shingle. Lines with equal text are one
class from the first step on, so a line that a third of all documents hold is summed map-side. Signatures are
minima over exploded shingles, in compiled code; BANDS bands of ROWS_A_BAND values give candidate pairs: in each bucket
a line is first paired with the bucket's first line and its predecessor. Jaccard similarity is verified
exactly on the full sets, then a distributed union-find joins the links. Then all other pairs of a bucket that lie in
different components meet too, in tiles of two blocks, where first their sketches and then the hashes of their sets are compared
(a set of more than SET_LIMIT shingles doesn't travel with every row); those that pass are verified, so that
no pair of a shared bucket that could still join two components is left untested. Of each component the first line (smallest
doc_id, then place) stays; all other occurrences go. Lines without a word stay as they are.

A pair at the threshold shares a band with probability 0.996, at 0.85 with 0.9999. Null text: no lines, stays null.
Rows of one doc_id and text count as one. Columns other than doc_id and text stay as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import block_pairs, cut_lineage, read_table, unused, written
from .components import SALTS, connected_components, joined_components

SHINGLE = 12
BANDS = 10
ROWS_A_BAND = 3
PERCENT = 75
#: Lines of a bucket that meet each other in one task.
BLOCK = 1000
#: A side of at most so many bytes is broadcast, a larger one is shuffled.
BROADCAST_BYTES = 8 << 20
#: Minima of the sketches by which candidates are sifted before their lines are fetched, and how many must agree: a pair
#: at the threshold falls short by more than four standard deviations with probability 0.00003.
SIFT, SIFT_FLOOR = 60, 31
#: Of each minimum four bits travel, so many minima in a long; equal minima agree in them, so none is lost.
PACKED = 15
#: A larger set stays where it is: its pairs are sifted by their sketches alone, and verified.
SET_LIMIT = 600
#: Ranges of scripts that are written without spaces: Thai to Lao, Myanmar, Khmer, kana, Han and further ideographs (fixed values).
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_UNSPACED_SHINGLES = rf"(?s)(?=(.{{1,{SHINGLE}}}))(?:[^\s{_UNSPACED}]{{1,{SHINGLE - 1}}}+(?![^\s{_UNSPACED}])\s*+|\s++|.)"
#: The same for lines without a character of these scripts, and faster.
_SPACED_SHINGLES = rf"(?s)(?=(.{{1,{SHINGLE}}}))(?:\S\S{{0,{SHINGLE - 2}}}+\s++|\S{{1,{SHINGLE - 1}}}+\z|\s++|.)"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, place, line, line hash of each line with a word."""
    out = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.xxhash64(docs["text"]).alias("_text"),
        F.posexplode(F.split(docs["text"], "\n", -1)).alias("pos", "line"),
    )
    return out.filter(out["line"].rlike(r"\S")).withColumn("h", F.xxhash64("line", F.length("line")))


def _cut_up(line: Column) -> Column:
    """All shingles of a line, repeats too."""
    parts = [F.regexp_extract_all(line, F.lit(pattern), F.lit(1)) for pattern in (_UNSPACED_SHINGLES, _SPACED_SHINGLES)]
    return F.when(line.rlike(r"[\u0E00-\x{3FFFF}]"), parts[0]).otherwise(parts[1])


def shingles(line: Column) -> Column:
    return F.array_distinct(_cut_up(line))


def classes(rows: DataFrame) -> DataFrame:
    """h, the first occurrence and the number of occurrences of each distinct line."""
    return rows.groupBy("h").agg(F.min(F.struct("doc_id", "pos", "_text")).alias("first"), F.count(F.lit(1)).alias("n"))


def signatures(rows: DataFrame, places: range = range(BANDS * ROWS_A_BAND)) -> DataFrame:
    """h and the minima m0, m1, ... of each distinct line; only integers, so that the sums stay in a hash table."""
    each = rows.select("h", F.explode(_cut_up(F.col("line"))).alias("s")).select("h", F.hash("s").alias("x"))
    return _minima(each, places)


def _minima(each: DataFrame, places: range) -> DataFrame:
    return each.groupBy("h").agg(*[F.min(F.hash(F.lit(k), "x")).alias(f"m{k}") for k in places])


def buckets(signed: DataFrame) -> DataFrame:
    """bucket, h, the bucket's first line and the line's predecessor, of each bucket with more than one line; only numbers."""
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS_A_BAND + r}") for r in range(ROWS_A_BAND)]) for b in range(BANDS)]
    banded = signed.select("h", F.explode(F.array(*keys)).alias("bucket"))
    whole, over = Window.partitionBy("bucket"), Window.partitionBy("bucket").orderBy("h")
    near = banded.select("bucket", "h", F.min("h").over(whole).alias("_low"), F.max("h").over(whole).alias("_high"), F.lag("h").over(over).alias("_last"))
    return near.filter("_low <> _high").drop("_high")


def candidates(shared: DataFrame) -> DataFrame:
    """Distinct pairs a < b of line hashes that are neighbours in a bucket, or of which one is the bucket's first."""
    near = shared.filter("_last is not null").select("h", F.explode(F.array_distinct(F.array("_low", "_last"))).alias("other"))
    return near.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()


def _packed(whole: DataFrame) -> DataFrame:
    """h, four bits of each minimum of whole(h, m) as longs p, and the set's size n and hashes s: null where whole has none, or
    too many."""
    bits = [F.shiftleft(F.get("m", k).bitwiseAND(F.lit(15)).cast("long"), 4 * (k % PACKED)) for k in range(SIFT)]
    longs = [functools.reduce(Column.bitwiseOR, bits[k : k + PACKED]) for k in range(0, SIFT, PACKED)]
    if "s" not in whole.columns:
        whole = whole.select("h", "m", F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<int>").alias("s"))
    return whole.select("h", F.array(*longs).alias("p"), "n", F.when(F.col("n") <= SET_LIMIT, F.col("s")).alias("s"))


def _agree(x: str, y: str) -> Column:
    """Whether so many minima of two sketches agree that their lines have to be compared."""

    def differing(k: int) -> Column:
        t = F.get(x, k).bitwiseXOR(F.get(y, k))
        some = functools.reduce(Column.bitwiseOR, [t, *[F.shiftright(t, i) for i in (1, 2, 3)]])
        return F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))

    return sum(differing(k) for k in range(-(-SIFT // PACKED))) <= SIFT - SIFT_FLOOR


def _may_link(x: str, y: str, n: str, m: str, percent: int) -> Column:
    """Whether two sets may be similar enough: n and m are their sizes, x and y their hashes, of which no two in a set are equal, so
    that at least as many are shared as members are. Unknown sets may be."""
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return F.coalesce(sizes & ((100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.col(n) + F.col(m))), F.lit(True))


def open_pairs(shared: DataFrame, labels: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs a < b of line hashes that share a bucket, lie in different components and pass the sieve of the sketches of
    whole(h, m), and that of its sets (n, s) where it has them. Both travel with the rows of a tile, and the sieve is a condition of
    the tile's join, so the pairs of a bucket are tested where they meet and only those that pass are rows: with sets, the links."""
    rows = shared.select("bucket", "h").join(labels, F.col("h") == labels["node"], "left").select("bucket", "h", F.coalesce("component", "h").alias("component"))
    dealt = written(block_pairs(written(rows), ["bucket"], "h", BLOCK).hint("merge").join(_packed(whole), "h"))
    keys = ["bucket", "_hi", "_lo"]
    left = dealt.filter("_own = _lo").select(*keys, F.col("h").alias("_x"), F.col("component").alias("_cx"), *[F.col(c).alias(f"_{c}x") for c in ("p", "n", "s")])
    right = dealt.filter("_own = _hi").select(*[F.col(k).alias(f"r{k}") for k in keys], F.col("h").alias("_y"), F.col("component").alias("_cy"), *[F.col(c).alias(f"_{c}y") for c in ("p", "n", "s")])
    same = [F.col(k) == F.col(f"r{k}") for k in keys]
    sieve = [_agree("_px", "_py"), _may_link("_sx", "_sy", "_nx", "_ny", percent)]
    met = left.join(right, [*same, F.col("_cx") != F.col("_cy"), (F.col("_hi") != F.col("_lo")) | (F.col("_x") < F.col("_y")), *sieve])
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()


def sketched(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """h, line, sketch m, set size n and hashes s of the set of each distinct line that shares a bucket; s is null if two are equal."""
    ends = cut_lineage(shared.select("h").distinct())
    small = ends.count() * 16 <= BROADCAST_BYTES
    whole = rows.join(F.broadcast(ends) if small else ends, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    cut = whole.select("h", "line", shingles(F.col("line")).alias("t"))
    sets = cut_lineage(cut.select("h", "line", F.size("t").alias("n"), F.array_distinct(F.transform("t", lambda s: F.hash(s))).alias("s")))
    places = range(BANDS * ROWS_A_BAND, BANDS * ROWS_A_BAND + SIFT)
    sketch = _minima(sets.select("h", F.explode("s").alias("x")), places).select("h", F.array(*[f"m{k}" for k in places]).alias("m"))
    return cut_lineage(sets.join(sketch, "h").select("h", "line", "m", "n", F.when(F.size("s") == F.col("n"), F.col("s")).alias("s")))


def sifted(pairs: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sketches, and sets where they are known, in whole(h, m, n, s) let them through."""
    small = _packed(whole)
    left, right = (small.select(F.col("h").alias(end), *[F.col(c).alias(f"_{c}{end}") for c in ("p", "n", "s")]) for end in "ab")
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    return both.filter(_agree("_pa", "_pb") & _may_link("_sa", "_sb", "_na", "_nb", percent)).select("a", "b")


def links(close: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left, right = whole.select(F.col("h").alias("a"), F.col("line").alias("x")), whole.select(F.col("h").alias("b"), F.col("line").alias("y"))
    both = close.hint("merge").join(left, "a").hint("merge").join(right, "b")

    def similar(s: Column) -> Column:
        n = F.size(s.x) + F.size(s.y)
        return F.exists(F.array(F.size(F.array_intersect(s.x, s.y))), lambda shared: 100 * shared >= percent * (n - shared))

    sets = F.struct(shingles(F.col("x")).alias("x"), shingles(F.col("y")).alias("y"))
    return both.filter(F.exists(F.array(sets), similar)).select("a", "b")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text hash and places of the lines that go."""
    rows = lines(docs)
    firsts = cut_lineage(classes(rows))
    shared = cut_lineage(buckets(signatures(rows)))
    pairs = cut_lineage(candidates(shared))
    whole = sketched(shared, rows)
    linked = cut_lineage(links(written(sifted(pairs, whole)), whole))
    labels = connected_components(linked)
    labels = joined_components(labels, links(written(open_pairs(shared, labels, whole)), whole))
    named = firsts.join(labels.hint("merge"), firsts["h"] == labels["node"], "inner").select("h", "component", "first")
    # a component may hold a third of all lines: its keeper is found map-side and goes to each of its salts
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    keepers = named.groupBy("component").agg(F.min("first").alias("keeper")).withColumn("_salt", salts)
    fuzzy = named.withColumn("_salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(keepers.hint("merge"), ["component", "_salt"]).select("h", "keeper")
    kept = firsts.join(fuzzy.hint("merge"), "h", "left").filter("n > 1 or keeper is not null").select("h", F.coalesce("keeper", "first").alias("keeper"))
    # occurrences are joined with their line's keeper; a very common line is salted
    spread = kept.withColumn("_salt", salts)
    found = rows.select("doc_id", "_text", "pos", "h", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int").alias("_salt")).join(spread.hint("merge"), ["h", "_salt"])
    gone = found.filter(~F.struct("doc_id", "pos", "_text").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("gone"))


def without_repeats(docs: DataFrame, n_lines: str = "n_lines", n_kept: str = "n_kept") -> DataFrame:
    """docs with the repeated lines taken out of `text`, and two more columns: lines with a word, and those that stay.

    A column of docs that has the name of one of these two gives way to it.
    """
    gone = cut_lineage(dropped_lines(docs))
    held = gone.agg(F.coalesce(F.sum(F.size("gone") * 8 + 48), F.lit(0))).head()[0]
    columns = docs.columns
    key, text_key, places = (unused(c, columns) for c in ("_gone_id", "_gone_text", "_gone"))
    gone = gone.select(F.col("doc_id").alias(key), F.col("_text").alias(text_key), F.col("gone").alias(places))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & F.xxhash64(docs["text"]).eqNullSafe(F.col(text_key))
    joined = docs.join(F.broadcast(gone) if held <= BROADCAST_BYTES else gone, same, "left")
    text, dropped = docs["text"], F.col(places)
    own = F.split(text, "\n", -1)
    places_left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), dropped)  # by a hash set
    kept = F.array_join(F.element_at(F.transform(F.array(own), lambda held: F.transform(places_left, lambda i: F.get(held, i))), 1), "\n")
    n = F.coalesce(F.size(F.filter(own, lambda line: line.rlike(r"\S"))), F.lit(0)).cast("long")
    n = F.when(text.isNull(), F.lit(0)).otherwise(n).cast("long")
    left = F.when(dropped.isNull(), text).otherwise(kept)
    out = [left.alias(c) if c == "text" else docs[c] for c in columns if c not in (n_lines, n_kept)]
    return joined.select(*out, n.alias(n_lines), (n - F.coalesce(F.when(dropped.isNotNull(), F.size(dropped)), F.lit(0))).cast("long").alias(n_kept))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines with a word, those that stay, and the SHA-256 of the text that is left."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
