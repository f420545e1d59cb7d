"""Token counts by a compiled finite-state transducer.

The splitting pattern of a byte-level vocabulary is compiled into a deterministic transducer of eight states over eight
symbols; a symbol is a character's class with what the pattern looks ahead to. A text is cut into chunks of equal
length, wherever that falls. Each chunk's map from any start state to its end state is found for all chunks at once;
a parallel prefix scan composes the maps, which gives each chunk's true start state; a second run emits the piece
boundaries. The transition that closes a piece is annotated with the number of tokens that the piece emits: a table of
these annotations is compiled when a piece is first met, by the vocabulary's own merges, and is bounded.

Null text: empty, 0 tokens. A special string inside a text is one token, as in the library's default. Rows that repeat
stay; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_texts, read_table, tokenizer_path
from .pieces import LETTER, NUMBER, OTHER, QUOTE, SPACE, Joined, PieceTable, slices

CHUNK = 256
LIMIT = 512
STATES = 8
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, SHORT_ONE, SHORT_TWO) = range(STATES)
(S_LETTER, S_NUMBER, S_OTHER, S_SHORT_ONE, S_SHORT_TWO, S_SPACE_LAST, S_WHITE_LAST, S_WHITE) = range(8)


@functools.cache
def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, boundary before the character) by state * 8 + symbol."""
    to, boundary = np.zeros(64, np.uint8), np.zeros(64, np.uint8)
    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}
    for state in range(STATES):
        for symbol in range(8):
            at = state * 8 + symbol
            if state in (SHORT_ONE, SHORT_TWO):  # letters of a contraction: no boundary before them
                to[at], boundary[at] = (FRESH if state == SHORT_ONE else SHORT_ONE), 0
            elif symbol in (S_SHORT_ONE, S_SHORT_TWO):
                if state in (AFTER_SPACE, IN_OTHERS):  # the apostrophe joins what came before, so it is no contraction
                    to[at], boundary[at] = IN_OTHERS, 0
                else:
                    to[at], boundary[at] = (SHORT_ONE if symbol == S_SHORT_ONE else SHORT_TWO), 1
            elif symbol in runs:
                to[at], boundary[at] = runs[symbol], state not in (AFTER_SPACE, runs[symbol])
            elif symbol == S_WHITE:
                to[at], boundary[at] = IN_WHITE, state != IN_WHITE
            else:  # the last white character before another one stands alone, a space joins what follows
                to[at], boundary[at] = (AFTER_SPACE if symbol == S_SPACE_LAST else FRESH), 1
    return to, boundary


def symbols(joined: Joined) -> np.ndarray:
    """The transducer's input symbol at each place."""
    kinds, short = joined.kinds, joined.contractions()
    white = kinds >= SPACE
    next_white = np.concatenate([white[1:], [True]]) | joined.last
    out = np.full(len(kinds), S_OTHER, np.uint8)
    out[kinds == LETTER] = S_LETTER
    out[kinds == NUMBER] = S_NUMBER
    out[short == 1] = S_SHORT_ONE
    out[short == 2] = S_SHORT_TWO
    out[white & next_white] = S_WHITE
    out[(kinds == SPACE) & ~next_white] = S_SPACE_LAST
    out[white & (kinds != SPACE) & ~next_white] = S_WHITE_LAST
    assert OTHER < QUOTE < SPACE
    return out


def compose_scan(maps: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps by composition, anew at each head: log2(longest run) whole-array steps."""
    done, out, step = heads.copy(), maps.copy(), 1
    while not done.all():
        left = np.concatenate([np.zeros((step, STATES), out.dtype), out[:-step]])
        joined = np.take_along_axis(out, left, 1)
        out = np.where(done[:, None], out, joined)
        done = done | np.concatenate([np.ones(step, bool), done[:-step]])
        step *= 2
    return out


def boundaries(joined: Joined) -> np.ndarray:
    """Where pieces begin."""
    n = len(joined.points)
    if not n:
        return np.zeros(0, np.int64)
    to, boundary = compile_transducer()
    row_symbols = symbols(joined)
    # chunks of CHUNK characters, none across two texts; short ones are filled up and their filling is never read
    lengths = joined.ends - joined.begins
    per_text = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), per_text)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    number = np.arange(len(owner)) - first[owner]
    begin = joined.begins[owner] + number * CHUNK
    size = np.minimum(CHUNK, joined.ends[owner] - begin)
    grid = np.minimum(begin[None, :] + np.arange(CHUNK)[:, None], n - 1)
    inputs = row_symbols[grid]
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (len(owner), 1))
    more = np.concatenate([number[1:] > 0, [False]])  # only chunks with a successor need their map
    if more.any():
        some, part = maps[more], inputs[:, more]
        for j in range(CHUNK):
            some = to[(some << 3) + part[j][:, None]]
        maps[more] = some
    scanned = compose_scan(maps, number == 0)
    state = np.full(len(owner), FRESH, np.uint8)
    state[number > 0] = scanned[:-1][number[1:] > 0, FRESH]
    starts = np.zeros((CHUNK, len(owner)), np.uint8)
    for j in range(CHUNK):
        at = (state << 3) + inputs[j]
        starts[j], state = boundary[at], to[at]
    chunks, places = np.nonzero((starts.T > 0) & (np.arange(CHUNK)[None, :] < size[:, None]))
    return begin[chunks] + places


@functools.cache
def _library(path: str):
    """The strings that are one token wherever they stand, and the table of the pieces' token counts."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    printable = {c: b for b, c in _byte_letters().items()}
    special = [t["content"] for t in held["added_tokens"]]
    ranks = {bytes(printable[c] for c in token): rank for token, rank in held["model"]["vocab"].items() if token not in special}
    merges = tiktoken.Encoding("compiled", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    one = np.ones(1, np.uint32)
    return special, PieceTable(lambda new: [one * len(merges._encode_single_piece(p.encode("utf-8", "surrogatepass"))) for p in new])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the
    others, in order, from code point 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    special, table = _library(path)
    parts, owner, total = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        segments = [text]
        for s in special:
            segments = [x for segment in segments for x in segment.split(s)]
        total[i] += len(segments) - 1
        for segment in segments:
            for part in slices(segment):
                if part:
                    parts.append(part)
                    owner.append(i)
    if parts:
        joined = Joined(parts)
        begins = boundaries(joined)
        ends = np.concatenate([begins[1:], [len(joined.points)]])
        rows = table.rows(joined, begins, ends)
        emitted = table.flat[table.offset[rows]].astype(np.int64)
        piece_owner = np.asarray(owner)[np.searchsorted(joined.ends, begins, "right")]
        total += np.bincount(piece_owner, emitted, len(texts)).astype(np.int64)
    return total


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs(doc_id, text). No shuffle."""
    import pyarrow as pa

    path = path or tokenizer_path("byte_bpe_50k.json")
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator) -> Iterator:
        for keys, texts in arrow_texts(batches):
            n = count_tokens(texts, path)
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
