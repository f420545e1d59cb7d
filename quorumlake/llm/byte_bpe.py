"""Byte-level BPE by Spark's higher-order functions, and decoding by concatenated binary pieces.

A first pass groups documents into bounded batches, numbers the words that a partition meets and lists each batch's new
ones as byte arrays. Spark then folds the ranked merges over every distinct word, of whatever length: `aggregate` repeats
a step in which `array_min` picks the lowest rank among the neighbouring pairs, `concat` of slices merges that pair, and
only the two pairs beside it are ranked anew. The rank map is the pairs' table, whose rows (one for each left
token) are displaced so that they don't overlap, as two arrays of a broadcast row; a look-up is two array reads. A last pass puts
the folded ids in the places of the word numbers, and decodes the ids by concatenating the tokens' bytes. Texts stay out
of the fold and of the last pass. A word that is a token itself is that token, as in the library, even where no merges lead
to it; it comes to the fold as its id. All three run in one stage without a shuffle, and a batch bounds the memory.

A word longer than STRIDE + OVERLAP bytes is folded in windows of that size that begin STRIDE bytes apart. Two
neighbouring windows are joined at a token that both hold at the same place: every pair of neighbouring tokens then
stands in some window's fold, and a sequence all of whose neighbouring pairs are stable is the word's encoding. Windows
without a common token (none is known) make the word be folded whole. So the fold is linear in a word's length.

Null text: empty, no tokens. Rows that repeat stay; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, tokenizer_path
from .pieces import LETTER, OTHER, QUOTE, SPACE, Joined, slices, span_hashes

STRIDE, OVERLAP = 240, 120
BATCH = 1_000_000
#: Words that a partition remembers; then it begins anew.
REMEMBER = 400_000
NONE = 1 << 16
#: Added to an id that stands for a word; what comes to the fold is a smallint.
TOKEN = 1 << 15


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def rank_table(path: str) -> tuple[list[int], list[int], list[int]]:
    """(first states, displacements, cells).

    A state is pair rank << 16 | token, the rank being that of the pair which the token makes with its right neighbour,
    and itself the id of the merged token. First states: of byte a before byte b at a * 257 + b, b = 256 at the end of a
    word. The pair a, b merges into m where cells[displacement[a] + b] = a << 32 | m << 16; other cells are negative.
    """
    ranks = load_ranks(path)
    assert len(ranks) < 1 << 16
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    size, reach = len(ranks), 1024
    used = np.zeros(size * 16, bool)
    cells = np.full(len(used), -(1 << 16), np.int64)
    displacement = np.zeros(size, np.int64)
    shifts = np.arange(reach)
    at = 0
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):  # next fit, the longest rows first
        rights = np.array([b for b, _ in row])
        while True:
            fits = np.flatnonzero(~used[at + shifts[:, None] + rights].any(1))
            if len(fits):
                break
            at += reach
        displacement[a] = place = at + int(fits[0])
        at = place if len(row) < 64 else at
        used[place + rights] = True
        cells[place + rights] = (np.array([m for _, m in row]) << 16) + (a << 32)
    end = int(np.flatnonzero(used)[-1]) + 1
    first = []
    for a in range(256):
        token = ranks[bytes([a])]
        first += [ranks.get(bytes([a, b]), NONE) << 16 | token for b in range(256)] + [NONE << 16 | token]
    return first, displacement.tolist(), cells[: max(end, int(displacement.max()) + size)].tolist()


def merge_table(spark: SparkSession, path: str) -> DataFrame:
    """One row: first, displacement, cells and lengths of the ranks at path. It is broadcast to the batches; as literals its million
    numbers would be objects that each task takes apart anew."""
    import pyarrow as pa

    first, displacement, cells = rank_table(path)
    lengths = [0] * len(displacement)
    for token, rank in load_ranks(path).items():
        lengths[rank] = len(token)
    columns = {"first": (first, pa.int64()), "displacement": (displacement, pa.int32()), "cells": (cells, pa.int64()), "lengths": (lengths, pa.int32())}
    return spark.createDataFrame(pa.table({name: pa.array([values], pa.list_(kind)) for name, (values, kind) in columns.items()}))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(table: Column, word: Column) -> Column:
    """The states of the tokens of one byte array that ends with 256."""
    token = lambda state: state.bitwiseAND(F.lit(0xFFFF))

    def paired(a: Column, b: Column) -> Column:
        """The state of token a before token b: a rank of NONE or more where the pair doesn't merge."""
        cell = F.get(table["cells"], F.get(table["displacement"], a.cast("int")) + b.cast("int"))
        return cell.bitwiseXOR(F.shiftleft(a, 32)).bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(a)

    def merge(states: Column, p: Column) -> Column:
        """The states with number p (from 1) and its right neighbour merged."""
        merged = F.shiftright(F.get(states, p - 1), 16)
        own = F.coalesce(paired(merged, token(F.get(states, p + 1))), merged.bitwiseOR(F.lit(NONE << 16)))
        rest = F.slice(states, p + 2, F.size(states))
        before = paired(token(F.get(states, p - 2)), merged)
        return F.flatten(F.when(p == 1, F.array(F.array(own), rest)).otherwise(F.array(F.slice(states, F.lit(1), p - 2), F.array(before, own), rest)))

    def step(states: Column, _: Column) -> Column:
        def at(p: Column) -> Column:
            return F.when(F.get(states, p - 1) >= NONE << 16, states).otherwise(merge(states, p))

        return _let(F.array_position(states, F.array_min(states)).cast("int"), at)

    first = F.zip_with(F.slice(word, F.lit(1), F.size(word) - 1), F.slice(word, F.lit(2), F.size(word)), lambda a, b: F.get(table["first"], a * 257 + b))
    return F.aggregate(F.slice(word, F.lit(3), F.size(word)), first, step)


def _windows(table: Column, windows: Column) -> Column:
    """The token ids of a long byte array, joined from its windows; null if two windows have no token in common."""

    def placed(window: Column, number: Column) -> Column:  # (token, its place in the word) of each token of the window
        def add(held: Column, token: Column) -> Column:
            own = token.bitwiseAND(F.lit(0xFFFF))
            row = F.struct(held["at"].alias("at"), own.alias("id"))
            return F.struct((held["at"] + F.get(table["lengths"], own.cast("int"))).alias("at"), F.concat(held["rows"], F.array(row)).alias("rows"))

        none = F.expr("cast(array() as array<struct<at: int, id: bigint>>)")
        start = F.struct((number * STRIDE).alias("at"), none.alias("rows"))
        return F.aggregate(_fold(table, window), start, add, lambda held: held["rows"])

    def joined(held: Column) -> Column:
        # the place of the first token that a window shares with the one before
        later = F.slice(held, F.lit(2), F.size(held))
        meets = F.zip_with(F.slice(held, F.lit(1), F.size(held) - 1), later, lambda a, b: F.get(F.array_intersect(a, b), 0)["at"])

        def spliced(cuts: Column) -> Column:
            begins, ends = F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(F.lit(2147483647)))

            def own(part: Column) -> Column:
                return F.transform(F.filter(part["w"], lambda x: (x["at"] >= part["b"]) & (x["at"] < part["e"])), lambda x: x["id"])

            return F.flatten(F.transform(F.arrays_zip(held.alias("w"), begins.alias("b"), ends.alias("e")), own))

        return _let(meets, lambda cuts: F.when(~F.exists(cuts, lambda x: x.isNull()), spliced(cuts)))

    return _let(F.transform(windows, placed), joined)


def fold_merges(words: Column, table: Column) -> Column:
    """In the low 16 bits the token ids of each of `words`, an array of byte arrays that end with 256: the word, or its
    windows; or, alone in its array, the id of a word that is a token, less TOKEN; table: struct(first, displacement, cells, lengths)."""

    def whole(windows: Column) -> Column:
        """The word without windows: what each has before the next, and all of the last."""
        last = F.size(windows) - 1
        return F.flatten(F.transform(windows, lambda w, k: F.when(k < last, F.slice(w, F.lit(1), F.lit(STRIDE))).otherwise(w)))

    def fold(windows: Column) -> Column:
        first = F.get(windows, 0)
        token = F.when(F.size(first) == 1, F.array(F.get(first, 0).cast("long") + TOKEN))
        return token.when(F.size(windows) == 1, _fold(table, first)).otherwise(F.coalesce(_windows(table, windows), _fold(table, whole(windows))))

    return F.transform(words, fold)


def windows_of(words: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(the number of windows of each word, the windows)."""
    counts, parts = [], []
    for word in words:
        begins = range(0, max(1, len(word) - OVERLAP), STRIDE) if len(word) > STRIDE + OVERLAP else (0,)
        parts += [word[i : i + STRIDE + OVERLAP] for i in begins] if len(begins) > 1 else [word]
        counts.append(len(begins))
    return counts, parts


def _batches(batches: Iterator, limit: int) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            value = text.as_py() or ""
            if texts and size + len(value) > limit:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(value)
            size += len(value)
    if texts:
        yield keys, texts


def word_begins(joined: Joined) -> np.ndarray:
    """Where the words of the splitting pattern begin. Each place is decided by itself, its neighbours and the contractions: a space
    joins the word after it, the last of several white characters stands alone, and so does what follows a contraction."""
    kinds, n = joined.kinds, len(joined.points)
    if not n:
        return np.zeros(0, np.int64)
    white = kinds >= SPACE
    group = np.where(kinds == QUOTE, OTHER, kinds)
    group[white] = SPACE
    start = np.ones(n, bool)
    start[1:] = group[1:] != group[:-1]
    start[1:] &= kinds[:-1] != SPACE
    # of white characters the first and, before a word, the last
    last = white & ~joined.last
    last[:-1] &= ~white[1:]
    start[1:] |= white[1:] & ~white[:-1]
    start |= last | joined.first
    # a contraction begins a word, unless a space or another sign is before its apostrophe
    short = joined.contractions()
    at = np.flatnonzero(short)
    before = np.where(joined.first[at], LETTER, kinds[at - 1])
    at = at[(before != OTHER) & (before != QUOTE) & (before != SPACE)]
    start[at + 1] = False
    start[at[short[at] == 2] + 2] = False
    after = at + 1 + short[at]
    start[after[after < n]] = True
    return np.flatnonzero(start)


def _spans(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[Joined, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In parts of bounded size: joined texts; begin, end, hash and text of each word."""

    def spans() -> tuple:
        joined = Joined(parts)
        begins = word_begins(joined)
        ends = np.concatenate([begins[1:], [len(joined.points)]]) if len(begins) else begins
        whose = np.asarray(owner, np.int64)[np.searchsorted(joined.ends, begins, "right")]
        return joined, begins, ends, span_hashes(joined.points, begins, ends), whose

    parts, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for part in slices(text):
            if parts and size + len(part) > limit:
                yield spans()
                parts, owner, size = [], [], 0
            if part:
                parts.append(part)
                owner.append(i)
                size += len(part)
    if parts:
        yield spans()


class WordNumbers:
    """Numbers from 0 of the words met so far, found by a 64-bit hash."""

    def __init__(self):
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, the places of the words that are new, in the order of their numbers)."""
        found, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, found)
        new = self.known[np.minimum(place, len(self.known) - 1)] != found if len(self.known) else np.ones(len(found), bool)
        numbers = np.empty(len(found), np.int32)
        numbers[~new] = self.number[place[~new]]
        numbers[new] = len(self.known) + np.arange(int(new.sum()), dtype=np.int32)
        merged = np.concatenate([self.known, found[new]])
        order = np.argsort(merged, kind="stable")
        self.number = np.concatenate([self.number, numbers[new]])[order]
        self.known = merged[order]
        return numbers[back], at[new]


def distinct_words(docs: DataFrame, path: str, limit: int = BATCH) -> DataFrame:
    """Batches of documents: their ids; how many words each has; the words' numbers, four bytes each; the
    words that are new to the partition, in the order of their numbers, each as its windows, byte arrays that end with
    256, or as the id (less TOKEN) of the token that it is by the ranks at path; and whether numbering began anew before them."""
    import pyarrow as pa

    names = ["keys", "counts", "numbers", "words", "anew"]

    def run(batches: Iterator) -> Iterator:
        table, ranks = WordNumbers(), load_ranks(path)
        for keys, texts in _batches(batches, limit):
            anew = len(table.known) > REMEMBER
            if anew:
                table = WordNumbers()
            counts, numbers, raw = np.zeros(len(texts), np.int64), [], []
            for joined, begins, ends, h, whose in _spans(texts):
                own, fresh = table.of(h)
                numbers.append(own)
                counts += np.bincount(whose, minlength=len(texts))
                raw += [joined.text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(begins[fresh].tolist(), ends[fresh].tolist(), strict=True)]
            tokens = [ranks[w] for w in raw if w in ranks]
            parts_of, raw = windows_of([b"" if w in ranks else w for w in raw])
            sizes = np.array([len(w) for w in raw], np.int64)
            ends, last = np.cumsum(sizes), np.full(len(raw), 256, np.int16)
            last[sizes == 0] = np.array(tokens, np.int64) - TOKEN
            flat = np.insert(np.frombuffer(b"".join(raw), np.uint8).astype(np.int16), ends, last)
            offsets = np.concatenate([[0], ends + np.arange(1, len(raw) + 1)]).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(parts_of)]).astype(np.int32)), parts)
            words = pa.ListArray.from_arrays(pa.array([0, len(parts_of)], pa.int32()), windows)
            laid = np.concatenate([*numbers, np.zeros(0, np.int32)]).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([laid], pa.binary()), words, pa.array([anew])], names)

    schema = "keys array<long>, counts array<long>, numbers binary, words array<array<array<smallint>>>, anew boolean"
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


class Growing:
    """Arrays laid end to end that grow by doubling."""

    def __init__(self, kind: str):
        self.held, self.n = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


def encode_texts(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of each row of docs(doc_id, text)."""
    import pyarrow as pa

    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    table = merge_table(docs.sparkSession, path)
    held = F.struct(*[F.col(c).alias(c) for c in table.columns])
    batches = distinct_words(docs, path).crossJoin(F.broadcast(table))
    coded = batches.select("keys", "counts", "numbers", _let(held, lambda held: fold_merges(F.col("words"), held)).alias("ids"), "anew")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator) -> Iterator:
        ranks = load_ranks(path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        lengths, starts, flat = Growing("int64"), Growing("int64"), Growing("<u4")
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(4)[i].as_py():
                    lengths.n = starts.n = flat.n = 0
                ids = batch.column(3)[i].values
                more = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                starts.add(np.cumsum(more) - more + flat.n)
                lengths.add(more)
                flat.add((ids.flatten().to_numpy(zero_copy_only=False) & 0xFFFF).astype("<u4"))
                word = np.frombuffer(batch.column(2)[i].as_py(), "<i4")
                words = batch.column(1)[i].values.to_numpy()
                n = lengths.held[word]
                stops = np.concatenate([[0], np.cumsum(n)])
                own = flat.held[np.arange(int(stops[-1])) + np.repeat(starts.held[word] - stops[:-1], n)]
                ends = stops[np.cumsum(words)].tolist()
                rows, begin = [], 0
                for end in ends:
                    part = own[begin:end]
                    decoded = b"".join(map(pieces.__getitem__, part.tolist()))
                    rows.append((end - begin, hashlib.sha256(part.data).hexdigest(), hashlib.sha256(decoded).hexdigest()) + ((part.tolist(),) if keep_ids else ()))
                    begin = end
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])] + ([pa.array(columns[3], pa.list_(pa.int64()))] if keep_ids else []), names)

    return coded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"))
