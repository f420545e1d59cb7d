"""Language of whole texts: script ranges narrow the candidates, Viterbi with a switching penalty labels spans.

Model. Words are runs of letters of one script, lower-cased; a run of more than LONGEST letters counts as several words.
From labelled documents a Spark job counts, by language, the words'
features (whole word and marked character trigrams, hashed into BUCKETS) and letters by script. The sample is bounded:
documents are drawn by a hash of the id so that about SAMPLE of them are used; every drawn text is used whole. A word's
score for a language is the mean log-probability of its features.

Prediction. A word's script leaves as candidates the languages that use this script in at least one letter of a
thousand (all, if none does). Viterbi finds the best path over the words' scores; a change of language costs PENALTY.
Texts step together in chunks of CHUNK words; the chunks of a long text are joined by the maps from start to end state.
The prediction is the language with the most letters on the path (ties: the first in alphabetical order), the score its
share of the letters times the mean posterior of its words, 0 to 1.

Null text, or none with a letter: lang `und`, score 0, no spans. No labelled text: `und` for all. Rows that repeat stay;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_texts, read_table

BUCKETS = 1 << 15
SAMPLE = 8000
PENALTY = 6.0
UNKNOWN = "und"
#: Letters of a run that make one word.
LONGEST = 64
#: Words that step through Viterbi one after the other.
CHUNK = 128
#: Script ranges: first and last code point (fixed values).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_NAMES = [*SCRIPTS, "other"]


def script_of(word: str) -> int:
    """The script of a word's first letter."""
    c = ord(word[0])
    return next((i for i, ranges in enumerate(SCRIPTS.values()) if any(a <= c <= b for a, b in ranges)), len(SCRIPTS))


def _class(points: list[int]) -> str:
    """The pattern of a set of code points in rising order."""
    out, first, last = [], None, None
    for c in [*points, None]:
        if last is not None and c == last + 1:
            last = c
            continue
        if first is not None:
            out.append(f"\\U{first:08x}-\\U{last:08x}")
        first = last = c
    return f"[{''.join(out)}]"


@functools.cache
def word_pattern() -> re.Pattern:
    """Letters (general category L) of one script, at most LONGEST of them."""
    letters = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    by_script: dict[int, list[int]] = {}
    for c in letters:
        by_script.setdefault(script_of(chr(c)), []).append(c)
    return re.compile("|".join(f"{_class(by_script[k])}{{1,{LONGEST}}}" for k in sorted(by_script)))


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased."""
    found = word_pattern().findall(text)
    return "\n".join(found).lower().split("\n") if found else found


def features(word: str) -> list[int]:
    from zlib import crc32

    marked = f"^{word}$"
    grams = [marked[i : i + 3] for i in range(len(marked) - 2)]
    return [crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in (*grams, f"={word}")]


def split_of(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


class Model:
    def __init__(self, languages: list[str], logs: np.ndarray, allowed: np.ndarray):
        self.languages, self.logs, self.allowed = languages, logs, allowed
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(self.languages)), np.float32)

    def __getstate__(self):
        return self.languages, self.logs, self.allowed

    def __setstate__(self, state):
        self.__init__(*state)

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score rows of the words met so far, row of each word)."""
        if len(self.words) > 300_000:
            self._clear()
        new = list(set(words).difference(self.words))
        if new:
            held = [features(w) for w in new]
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            flat = np.fromiter((f for own in held for f in own), np.int64, int(sizes.sum()))
            scores = np.add.reduceat(self.logs[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            allowed = self.allowed[np.fromiter(map(script_of, new), np.int64, len(new))]
            scores = np.where(allowed, scores, scores.min(1, keepdims=True) - 20)
            begin = len(self.words)
            while begin + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[begin : begin + len(new)] = scores
            self.words.update(zip(new, range(begin, begin + len(new)), strict=True))
        return self.rows, np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))


class _Steps:
    """Runs of words, the longest first, that step together."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = starts[self.order], sizes[self.order]
        steps = int(self.sizes[0]) if len(sizes) else 0
        self.active = (len(sizes) - np.searchsorted(self.sizes[::-1], np.arange(1, steps + 1), "left")).tolist()

    def forward(self, scores: np.ndarray, entry: np.ndarray, penalty: float, came: np.ndarray | None = None) -> np.ndarray:
        """The best sum of each state at each run's end, from those before its first word; came: whence, by word."""
        best = entry[self.order].astype(np.float64)
        own = np.arange(scores.shape[1])
        for t, m in enumerate(self.active):
            at = self.starts[:m] + t
            now = best[:m]
            change = now.max(1) - penalty
            if came is not None:
                came[at] = np.where(now >= change[:, None], own, now.argmax(1)[:, None])
            best[:m] = np.maximum(now, change[:, None]) + scores[at]
        out = np.empty_like(best)
        out[self.order] = best
        return out

    def backward(self, came: np.ndarray, state: np.ndarray, path: np.ndarray | None = None) -> np.ndarray:
        """The state before each run's first word, from the state at its end; several ends of a run as columns."""
        state = state[self.order].copy()
        for t in range(len(self.active) - 1, -1, -1):
            m = self.active[t]
            at = self.starts[:m] + t
            if path is not None:
                path[at] = state[:m, 0]
            state[:m] = np.take_along_axis(came[at], state[:m], 1)
        out = np.empty_like(state)
        out[self.order] = state
        return out


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY, chunk: int = CHUNK) -> np.ndarray:
    """The best language of each word, for texts laid end to end with `counts` words each."""
    n, k = scores.shape
    per_text = -(-counts // chunk)
    last = np.cumsum(per_text) - 1  # a text's last chunk, where it has any
    owner = np.repeat(np.arange(len(counts)), per_text)
    number = np.arange(len(owner)) - (last + 1 - per_text)[owner]
    begins = (np.cumsum(counts) - counts)[owner] + number * chunk
    sizes = np.minimum(chunk, counts[owner] - number * chunk)
    entry = np.zeros((len(owner), k))
    more = np.flatnonzero(number + 1 < per_text[owner])  # chunks with a successor
    if len(more):
        one = np.where(np.eye(k, dtype=bool), 0.0, -1e30)
        maps = _Steps(np.repeat(begins[more], k), np.repeat(sizes[more], k)).forward(scores, np.tile(one, (len(more), 1)), penalty).reshape(-1, k, k)
        by_number = np.argsort(number[more], kind="stable")
        for part in np.split(by_number, np.flatnonzero(np.diff(number[more][by_number])) + 1):
            at = more[part]
            ends = (entry[at][:, :, None] + maps[part]).max(1)
            entry[at + 1] = ends - ends.max(1, keepdims=True)
    steps, came, path = _Steps(begins, sizes), np.zeros((n, k), np.int8), np.zeros(n, np.int8)
    final = steps.forward(scores, entry, penalty, came).argmax(1)
    if len(more):
        whence = steps.backward(came, np.tile(np.arange(k), (len(owner), 1)))
        for part in np.split(by_number, np.flatnonzero(np.diff(number[more][by_number])) + 1)[::-1]:
            at = more[part]
            final[at] = whence[at + 1, final[at + 1]]
    steps.backward(came, final[:, None], path)
    return path


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs(doc_id, text, lang): all labelled rows, or about `sample` of them drawn by a hash of the id."""
    import pyarrow as pa

    labelled = docs.select(docs["doc_id"], docs["text"], docs["lang"]).filter("text is not null and lang is not null")
    total = labelled.select("lang").count()
    if total > sample:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) < int(1e6 * sample / total))

    def run(batches: Iterator) -> Iterator:
        counts: dict[str, np.ndarray] = {}
        cache: dict[str, list[int]] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                row = counts.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                if len(cache) > 200_000:
                    cache.clear()
                for word in words_of(text.as_py()):
                    own = cache.get(word)
                    if own is None:
                        own = cache[word] = [*features(word), BUCKETS + script_of(word)]
                    for f in own:
                        row[f] += 1
        for lang, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], ["lang", "feature", "n"])

    counted = labelled.select("text", "lang").mapInArrow(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    held = counted.collect()  # at most (BUCKETS + scripts) rows a language
    languages = sorted({r["lang"] for r in held})
    table = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    for r in held:
        table[r["feature"], languages.index(r["lang"])] = r["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(0, keepdims=True) + 0.5 * BUCKETS))
    allowed = scripts >= 0.001 * scripts.sum(0, keepdims=True)
    allowed &= scripts > 0
    allowed[~allowed.any(1)] = True
    return Model(languages, logs.astype(np.float32), allowed)


def label_texts(model: Model, texts: list[str], keep_spans: bool = False) -> list[tuple]:
    """(language, score) of each text, and its spans (language, begin, end) if asked for."""
    found = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    words = [w for own in found for w in own]
    if not words or not model.languages:
        return [(UNKNOWN, 0.0) + ([],) * keep_spans for _ in texts]
    table, rows = model.table(words)
    scores = table[rows]
    path = viterbi(scores, counts)
    letters = np.fromiter(map(len, words), np.int64, len(words))
    odds = np.exp(4 * (scores - scores.max(1, keepdims=True)))
    sure = odds[np.arange(len(rows)), path] / odds.sum(1)
    whose = np.repeat(np.arange(len(texts)), counts)
    k = len(model.languages)
    sums = np.bincount(whose * k + path, letters, len(texts) * k).reshape(-1, k)
    trust = np.bincount(whose * k + path, letters * sure, len(texts) * k).reshape(-1, k)
    out: list[tuple] = []
    stops = np.cumsum(counts)
    for i in range(len(texts)):
        if not counts[i]:
            out.append((UNKNOWN, 0.0) + ([],) * keep_spans)
            continue
        best = int(sums[i].argmax())
        row = (model.languages[best], float(min(1.0, trust[i, best] / sums[i].sum())))
        if keep_spans:
            spans: list[list] = []
            own = path[stops[i] - counts[i] : stops[i]]
            for m, lang in zip(word_pattern().finditer(texts[i]), own.tolist(), strict=True):
                if spans and spans[-1][0] == model.languages[lang]:
                    spans[-1][2] = m.end()
                else:
                    spans.append([model.languages[lang], m.start(), m.end()])
            row += ([{"lang": a, "begin": b, "end": c} for a, b, c in spans],)
        out.append(row)
    return out


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, keep_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans) of each row of docs(doc_id, text)."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS rows
    names = ["doc_id", "lang_pred", "score"] + ["spans"] * keep_spans
    span = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator) -> Iterator:
        own = held.value
        for keys, texts in arrow_texts(batches):
            columns = list(zip(*label_texts(own, texts, keep_spans), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(columns[0]), pa.array(columns[1], pa.float64())] + ([pa.array(columns[2], span)] if keep_spans else []), names)

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang: string, begin: long, end: long>>" * keep_spans
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


def learnt(docs: DataFrame) -> Model:
    """The model from the folds but 2 of docs(doc_id, text, lang)."""
    return train(docs.filter(F.coalesce(split_of(docs["doc_id"]) != 2, F.lit(True))))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is of some language of the model, unchanged; each row is judged by its own text."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS rows
    place = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        own = held.value
        for batch in batches:
            keep: list[bool] = []
            for _, texts in arrow_texts([pa.RecordBatch.from_arrays([batch.column(place), batch.column(place)], ["key", "text"])]):
                keep += [lang != UNKNOWN for lang, *_ in label_texts(own, texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def detect_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the folds but 2 of docs(doc_id, text, lang)."""
    out = identify(docs, learnt(docs))
    return out.select("doc_id", F.coalesce(split_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_languages(read_table(spark, sf_dir, "documents"))
