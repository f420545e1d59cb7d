"""Cross-tokenizer alignment by products of incidence matrices.

A text is encoded by tokenizer A (byte-level BPE, `tokenizers`) and tokenizer B (`sentencepiece`, which adds a space in
front), both over the bytes of a space and the text. The token-byte incidence matrices of both, in CSR built by hand, are
multiplied row by row as Gustavson does: A·Bᵀ has an entry where two tokens' byte ranges overlap, with the number of
bytes they share. Places where tokens of both end cut them into groups; the product of the token-group incidences links all tokens
of a group, and is made only where its rows are asked for; its sums come from the groups' counts.

No token of A or B spans the place between a character that is not white and a space (of A by its splitting pattern,
of B because no piece of its vocabulary holds a space after another character, which is checked; else a text is one chunk). So
a text is a row of chunks, and all matrices are block diagonal: each task makes the blocks of a chunk once, when it first meets it,
and forgets all beyond REMEMBER. Documents are in turn rows of a document-chunk matrix.

The corpus-wide counts of token pairs: a batch of documents lists its distinct pairs; these are summed by a shuffle on the
pair, the counts come back to the batches that asked for them, and each batch multiplies pair counts by chunks, and
chunks by documents. What is shuffled is a row for each distinct pair of a batch, so a pair that stands in all documents is no
hot key, and no table of counts has to fit anywhere. Batches are written once in the shared folder.

Null and empty texts, and texts whose tokens' bytes are not those of the space and the text (as with U+2581), have no
tokens: zeros and an empty hash. Special tokens' strings in a text are text. Rows that repeat stand each for itself; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, tokenizer_path, written
from .token_counts import _byte_letters

BATCH = 2_000_000
REMEMBER = 250_000
#: The mark of a space in pieces of B, and the splitting pattern of A (fixed values).
SPACE_MARK = "▁"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


@dataclass
class CSR:
    """A sparse matrix by rows: row i has data[indptr[i]:indptr[i+1]] in the columns of the same places in indices."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))


def token_bytes_matrix(lengths: np.ndarray) -> CSR:
    """Tokens by bytes: each token holds the bytes after those of the one before."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    total = int(ends[-1])
    return CSR(ends, np.arange(total), np.ones(total, np.int64), total)


def token_groups_matrix(group: np.ndarray, groups: int) -> CSR:
    return CSR(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


def transposed(m: CSR) -> CSR:
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    return CSR(indptr, m.row_numbers()[order], m.data[order], m.rows)


def gustavson(a: CSR, b: CSR) -> CSR:
    """a·b: a row of the product is the sum of the rows of b that a's row names, entries of one column put together."""
    sizes = np.diff(b.indptr)[a.indices]
    total = int(sizes.sum())
    at = np.arange(total) + np.repeat(b.indptr[a.indices] - (np.cumsum(sizes) - sizes), sizes)
    row, column = np.repeat(a.row_numbers(), sizes), b.indices[at]
    value = np.repeat(a.data, sizes) * b.data[at]
    key = row * max(b.columns, 1) + column
    if (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, row, column, value = key[order], row[order], column[order], value[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    summed = np.add.reduceat(value, heads) if len(heads) else value
    indptr = np.concatenate([[0], np.cumsum(np.bincount(row[heads], minlength=a.rows))])
    return CSR(indptr, column[heads], summed, b.columns)


class Tokenizers:
    """A and B, with the bytes of every token. A's merges are those of its file, applied by `tiktoken` to each piece of
    the splitting pattern."""

    def __init__(self, path_a: str, path_b: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(path_a, encoding="utf-8") as f:
            held = json.load(f)
        special, letters = {t["content"]: t["id"] for t in held["added_tokens"]}, {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(letters[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=path_b)
        size_a = max(ranks.values()) + 1
        self.bytes_a = [b""] * size_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in raw], np.int64) for raw in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(SPACE_MARK)
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        # an id with what follows it in a document's groups: of A within a group or at its end, of B within, at the end of
        # a group, at the end of a chunk
        self.shown = [f"{i}{x}" for x in ",|" for i in range(size_a)] + [f"{i}{x}" for x in (",", ";", "") for i in range(len(pieces))]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a space and the text, each without its first space."""
        if not self.cuts:
            return [text]
        if _ODD.search(text) or text[:1] == " ":
            return [c[1:] for c in _CUT.split(f" {text}")]
        return text.split(" ")

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [self.a.encode_ordinary(f" {c}") for c in chunks]
        b = self.b.encode(chunks, num_threads=1) if chunks else []
        return a, [own if c else [self.space] for own, c in zip(b, chunks, strict=True)]


@functools.cache
def load(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Flat:
    """Rows of numbers laid end to end, which grow by doubling."""

    def __init__(self, width: int):
        self.rows, self.n = np.zeros((1 << 16, width), np.int64), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n : self.n + len(more)] = more
        self.n += len(more)


class ChunkTable:
    """The chunks met so far. sums: for each chunk n_a, n_b, n_groups, n_links, n_group_links, sound (1 or 0), and the place of
    its first link. links: the pair of ids of each link as one number."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.links = Flat(7), Flat(1)
        self.groups: list[str] = []

    def add(self, chunks: list[str]) -> None:
        """Align new chunks: their blocks lie end to end in matrices that are multiplied once."""
        for at in range(0, len(chunks), 20_000):
            self._add(chunks[at : at + 20_000])

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, of B, how many each chunk has of A, of B); none where the tokens' bytes are not the chunk's."""
        own, raw = self.tokenizers, [f" {c}".encode("utf-8", "surrogatepass") for c in chunks]
        sides, sound = [], np.ones(len(chunks), bool)
        for ids, known, lengths in zip(own.encode(chunks), (own.bytes_a, own.bytes_b), (own.lengths_a, own.lengths_b), strict=True):
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for row in ids for x in row), np.int64, int(counts.sum()))
            sizes = np.bincount(np.repeat(np.arange(len(chunks)), counts), lengths[flat], len(chunks))
            same = sizes == np.fromiter(map(len, raw), np.int64, len(raw))
            if not same.all() or b"".join(map(known.__getitem__, flat.tolist())) != b"".join(raw):
                same = np.array([b"".join(map(known.__getitem__, row)) == want for row, want in zip(ids, raw, strict=True)], bool)
            sound &= same
            sides.append((flat, counts))
        if not sound.all():
            sides = [(flat[np.repeat(sound, counts)], np.where(sound, counts, 0)) for flat, counts in sides]
        return sides[0][0], sides[1][0], sides[0][1], sides[1][1]

    def _add(self, chunks: list[str]) -> None:
        own = self.tokenizers
        a, b, counts_a, counts_b = self._ids(chunks)
        bytes_a, bytes_b = token_bytes_matrix(own.lengths_a[a]), token_bytes_matrix(own.lengths_b[b])
        overlap = gustavson(bytes_a, transposed(bytes_b))
        in_a, in_b, groups = group_matrices(bytes_a, bytes_b)
        one_a, one_b = (token_groups_matrix(np.zeros(m.rows, np.int64), 1) for m in (in_a, in_b))
        per_group = gustavson(transposed(in_a), one_a).data * gustavson(transposed(in_b), one_b).data
        chunk_a = np.repeat(np.arange(len(chunks)), counts_a)
        link_a, link_b = overlap.row_numbers(), overlap.indices
        group_chunk = np.zeros(groups, np.int64)
        group_chunk[in_a.indices] = chunk_a
        n_links = np.bincount(chunk_a[link_a], minlength=len(chunks))
        n_groups = np.bincount(group_chunk, minlength=len(chunks))
        n_group_links = np.bincount(group_chunk, per_group, len(chunks)).astype(np.int64)
        begins = self.links.n + np.cumsum(n_links) - n_links
        self.sums.add(np.stack([counts_a, counts_b, n_groups, n_links, n_group_links, (counts_a > 0).astype(np.int64), begins], 1))
        self.links.add((a[link_a] << 32 | b[link_b])[:, None])
        # the groups as text: A's ids and B's ids of each group in turn, each with the sign that follows it
        last_a, last_b = (np.diff(m.indices, append=-1) != 0 for m in (in_a, in_b))
        ends_chunk = np.diff(np.repeat(np.arange(len(chunks)), counts_b), append=-1) != 0
        size_a, size_b = len(own.bytes_a), len(own.bytes_b)
        signs = np.concatenate([a + size_a * last_a, 2 * size_a + b + size_b * (last_b.astype(np.int64) + ends_chunk)])
        order = np.argsort(np.concatenate([2 * in_a.indices, 2 * in_b.indices + 1]), kind="stable")
        shown = list(map(own.shown.__getitem__, signs[order].tolist()))
        stops = np.cumsum(counts_a + counts_b).tolist()
        for chunk, begin, stop in zip(chunks, [0, *stops[:-1]], stops, strict=True):
            self.known[chunk] = len(self.groups)
            self.groups.append("".join(shown[begin:stop]))

    def rows(self, parts: list[str]) -> np.ndarray:
        """The number of each chunk."""
        new = set(parts).difference(self.known)
        if new:
            self.add(list(new))
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def link_places(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the chunks' links in links.rows, chunk after chunk; how many each has)."""
        n = self.sums.rows[chunks, 3]
        return np.arange(int(n.sum())) + np.repeat(self.sums.rows[chunks, 6] - (np.cumsum(n) - n), n), n


def group_matrices(a: CSR, b: CSR) -> tuple[CSR, CSR, int]:
    """Tokens by groups for both sides, and the number of groups: ends that both sides share cut the tokens into groups."""
    cuts = np.intersect1d(a.indptr[1:], b.indptr[1:])
    group_a, group_b = (np.searchsorted(cuts, m.indptr[1:]) for m in (a, b))
    return token_groups_matrix(group_a, len(cuts)), token_groups_matrix(group_b, len(cuts)), len(cuts)


def _text_batches(batches: Iterator, limit: int) -> Iterator[tuple[list, list[str]]]:
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


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]
_BATCH = "batch long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in _SUMS) + ", groups_sha256 array<string>, docs_chunks binary, chunks_pairs binary, pairs array<long>, pair_links array<long>"


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers as one compressed byte string: their lengths, then their numbers, byte by byte of all."""
    import zstandard

    flat = np.concatenate([[len(arrays)], [len(x) for x in arrays], *arrays]).astype("<u4")
    return zstandard.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(held: bytes) -> list[np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(held), np.uint8).reshape(4, -1)
    flat = np.ascontiguousarray(planes.T).view("<u4")[:, 0]
    sizes = flat[1 : flat[0] + 1].astype(np.int64)
    ends = np.cumsum(sizes) + len(sizes) + 1
    return [flat[e - n : e].astype(np.int64) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def aligned_batches(docs: DataFrame, path_a: str, path_b: str, limit: int = BATCH) -> DataFrame:
    """Batches of documents: their sums; documents by chunks and chunks by pairs as CSR; the batch's distinct pairs and how
    many links each has in it."""
    import pyarrow as pa
    from pyspark import TaskContext

    lists, names = pa.list_(pa.int64()), [c.split(" ")[0] for c in _BATCH.split(", ")]
    kinds = [pa.int64(), lists, *[lists] * len(_SUMS), pa.list_(pa.string()), pa.binary(), pa.binary(), lists, lists]

    def run(batches: Iterator) -> Iterator:
        table = ChunkTable(load(path_a, path_b))
        number = TaskContext.get().partitionId() << 33
        for keys, texts in _text_batches(batches, limit):
            if len(table.groups) > REMEMBER:
                table.clear()
            parts, counts = [], []
            for text in texts:
                own = table.tokenizers.chunks(text) if text else []
                parts += own
                counts.append(len(own))
            rows = table.rows(parts)
            del parts
            owner = np.repeat(np.arange(len(texts)), counts)
            sound = np.bincount(owner, table.sums.rows[rows, 5] == 0, len(texts)) == 0
            hashes, at = [], 0
            for i, n in enumerate(counts):
                own = rows[at : at + n].tolist() if sound[i] else []
                hashes.append(hashlib.sha256(";".join(map(table.groups.__getitem__, own)).encode()).hexdigest() if own else "")
                at += n
            rows, owner = rows[sound[owner]], owner[sound[owner]]
            chunks, rows = np.unique(rows, return_inverse=True)
            cell, times = np.unique(owner * max(len(chunks), 1) + rows, return_counts=True)
            cell_doc, cell_chunk = np.divmod(cell, max(len(chunks), 1))
            by_doc = np.concatenate([[0], np.cumsum(np.bincount(cell_doc, minlength=len(texts)))])
            sums = [np.bincount(owner, table.sums.rows[chunks[rows], k], len(texts)).astype(np.int64) for k in range(len(_SUMS))]
            places, n_links = table.link_places(chunks)
            pairs, link_pair = np.unique(table.links.rows[places, 0], return_inverse=True)
            chunk_times = np.bincount(cell_chunk, times, len(chunks)).astype(np.int64)
            pair_links = np.bincount(link_pair, np.repeat(chunk_times, n_links), len(pairs)).astype(np.int64)
            values = [number, keys, *sums, hashes, _packed(by_doc, cell_chunk, times), _packed(np.concatenate([[0], np.cumsum(n_links)]), link_pair), pairs, pair_links]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names)
            number += 1

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, _BATCH)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, limit: int = BATCH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links of docs(doc_id, text)."""
    import pyarrow as pa

    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    batches = written(aligned_batches(docs, path_a, path_b, limit))
    links = batches.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("n"))
    counts = links.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = written(counts)
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    # a row for each id of B's vocabulary at most
    judged = counts.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = batches.select("batch", F.posexplode("pairs").alias("place", "pair")).join(judged, "pair")
    answers = asked.groupBy("batch").agg(F.collect_list(F.struct("place", "n", "best")).alias("answers"))  # a batch's pairs
    both = batches.drop("pairs", "pair_links").join(answers, "batch", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]

    def run(rows: Iterator) -> Iterator:
        for held in rows:
            for i in range(held.num_rows):
                row = {name: held.column(k)[i] for k, name in enumerate(held.schema.names)}
                by_doc, cell_chunk, times = _unpacked(row["docs_chunks"].as_py())
                by_chunk, link_pair = _unpacked(row["chunks_pairs"].as_py())
                found = row["answers"].values
                n, top = np.zeros(len(found or ()), np.int64), np.zeros(len(found or ()), np.int64)
                if found is not None:
                    place = np.asarray(found.field("place"))
                    n[place] = np.asarray(found.field("n"))
                    top[place] = np.asarray(found.field("best")).astype(np.int64)
                out = []
                for value in (top, n):  # chunks by pairs, then documents by chunks
                    upto = np.concatenate([[0], np.cumsum(value[link_pair])])
                    per_chunk = upto[by_chunk[1:]] - upto[by_chunk[:-1]]
                    upto = np.concatenate([[0], np.cumsum(per_chunk[cell_chunk] * times)])
                    out.append(upto[by_doc[1:]] - upto[by_doc[:-1]])
                columns = [row[c].values for c in names[:5]] + [pa.array(x, pa.int64()) for x in out] + [row["groups_sha256"].values, row["n_group_links"].values]
                yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_group_links long")


def token_links(docs: DataFrame, shared_groups: bool = False, path_a: str | None = None, path_b: str | None = None, limit: int = BATCH) -> DataFrame:
    """doc_id, a_place, b_place, a_id, b_id, n_bytes: a row for each overlap link, or with shared_groups for each pair of tokens
    of one group (n_bytes: that they share, 0 or more). Places count from 0 in the document."""
    import pyarrow as pa

    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    names = ["doc_id", "a_place", "b_place", "a_id", "b_id", "n_bytes"]

    def of_text(own: Tokenizers, text: str) -> Iterator[list[np.ndarray]]:
        ids_a, ids_b = ([np.array([x for c in side for x in c], np.int64) for side in own.encode(own.chunks(text))]) if text else ([], [])
        raw = f" {text}".encode("utf-8", "surrogatepass")
        if not len(ids_a) or b"".join(own.bytes_a[x] for x in ids_a.tolist()) != raw or b"".join(own.bytes_b[x] for x in ids_b.tolist()) != raw:
            return
        a = token_bytes_matrix(np.array([len(own.bytes_a[x]) for x in ids_a.tolist()]))
        b = transposed(token_bytes_matrix(np.array([len(own.bytes_b[x]) for x in ids_b.tolist()])))
        in_a, in_b, _ = group_matrices(a, transposed(b))
        left, right = (in_a, transposed(in_b)) if shared_groups else (a, b)
        for begin in range(0, a.rows, 1000):  # rows of the product, a bounded number of tokens of A at a time
            end = min(begin + 1000, a.rows)
            part = lambda m: CSR(m.indptr[begin : end + 1] - m.indptr[begin], m.indices[m.indptr[begin] : m.indptr[end]], m.data[m.indptr[begin] : m.indptr[end]], m.columns)  # noqa: B023, E731
            links, shared = gustavson(part(left), right), gustavson(part(a), b)
            row = links.row_numbers()
            key, known = row * b.columns + links.indices, shared.row_numbers() * b.columns + shared.indices
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            yield [row + begin, links.indices, ids_a[row + begin], ids_b[links.indices], np.where(known[at] == key, shared.data[at], 0)]

    def run(batches: Iterator) -> Iterator:
        own = load(path_a, path_b)
        for keys, texts in _text_batches(batches, limit):
            for key, text in zip(keys, texts, strict=True):
                for columns in of_text(own, text):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(columns[0]), pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents"))
