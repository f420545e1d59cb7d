"""Token alignment against brute force over the libraries' tokens, byte by byte."""

import functools
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quorumlake.llm import alignment
from quorumlake.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, batch long, pair string, n int, b string, answers string, best string, place int"
ODD = [None, "", " ", "  ", "a", "a ", " a", "a\n b", "a\n  b", "\n\n", "\t x\t", "é漢字 ½", "▁", "a▁b ok", "<s> </s> <unk>", "a<|endoftext|>b", "x" * 5000, "=" * 3000 + " " * 700 + "z", "　 a  b", "a\x00b", "\x1c x", "l'été don't  we'll", "ab ab ab", "ab ab ab", "😀👩‍👩‍👧 ok", "ｱ ﬁ ²"]
PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def texts(seed=1, n=80):
    rng = random.Random(seed)
    letters = "aab's  \n\t'rellved0129.,-!é ñ漢½ᵃ  "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(n)]


@functools.cache
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(PATHS[0])
    out.encode_special_tokens = True
    return out


def tokens(text):
    """(ids, bytes of each) for A and B, or None."""
    own = alignment.load(*PATHS)
    if not text:
        return None
    a, b = library().encode(f" {text}", add_special_tokens=False).ids, own.b.encode(text)
    raw_a, raw_b = [own.bytes_a[x] for x in a], [own.bytes_b[x] for x in b]
    return (a, raw_a, b, raw_b) if b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode() else None


def spans(raw):
    ends = np.cumsum([len(x) for x in raw]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def links_of(held):
    a, raw_a, b, raw_b = held
    return [(i, j, min(d, f) - max(c, e)) for i, (c, d) in enumerate(spans(raw_a)) for j, (e, f) in enumerate(spans(raw_b)) if c < f and e < d]


def groups_of(held):
    a, raw_a, b, raw_b = held
    ends_a, ends_b = [e for _, e in spans(raw_a)], [e for _, e in spans(raw_b)]
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        out.append((range(i, p), range(j, q)))
        i, j = p, q
    return out


def brute(held):
    own = [tokens(t) for t in held]
    links = [links_of(x) if x else [] for x in own]
    count = Counter((x[0][i], x[2][j]) for x, rows in zip(own, links, strict=True) for i, j, _ in rows)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for k, (x, rows) in enumerate(zip(own, links, strict=True)):
        if not x:
            out.append((k, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        groups = groups_of(x)
        text = ";".join(",".join(str(x[0][i]) for i in p) + "|" + ",".join(str(x[2][j]) for j in q) for p, q in groups)
        n = [count[x[0][i], x[2][j]] for i, j, _ in rows]
        best = sum(c == most[x[2][j]] for c, (_, j, _) in zip(n, rows, strict=True))
        out.append((k, len(x[0]), len(x[2]), len(groups), len(rows), best, sum(n), hashlib.sha256(text.encode()).hexdigest(), sum(len(p) * len(q) for p, q in groups)))
    return out


@pytest.mark.parametrize("limit", [alignment.BATCH, 300])
def test_against_brute_force(spark, limit):
    held = texts()
    docs = spark.createDataFrame([(i, t, 1, "p", 2, "b", "a", "c", 3) for i, t in enumerate(held)], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in alignment.align(docs, limit=limit).collect())
    assert got == brute(held)
    assert alignment.align(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "ab cd"), (None, "ab cd"), (1, "ab cd"), (1, None)], "doc_id long, text string")
    got = [tuple(r) for r in alignment.align(docs).collect()]
    assert len(got) == 4 and len({r[1:] for r in got if r[1]}) == 1
    one = next(r for r in got if r[1])
    assert one[6] == 3 * one[4] and one[5] == one[4]


@pytest.mark.parametrize("shared", [False, True])
def test_links_as_rows(spark, shared):
    held = texts(3, 20)
    docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    got = sorted(tuple(r) for r in alignment.token_links(docs, shared).collect())
    want = []
    for k, t in enumerate(held):
        x = tokens(t)
        if x:
            bytes_of = {(i, j): n for i, j, n in links_of(x)}
            pairs = [(i, j) for p, q in groups_of(x) for i in p for j in q] if shared else list(bytes_of)
            want += [(k, i, j, x[0][i], x[2][j], bytes_of.get((i, j), 0)) for i, j in pairs]
    assert got == sorted(want)


def test_gustavson_is_the_matrix_product():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, m, k = rng.integers(1, 9, 3)
        a, b = (rng.integers(0, 3, s) * rng.integers(0, 2, s) for s in ((n, m), (m, k)))

        def sparse(x):
            rows, columns = np.nonzero(x)
            return alignment.CSR(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(x)))]), columns, x[rows, columns], x.shape[1])

        def dense(x):
            out = np.zeros((x.rows, x.columns), np.int64)
            out[x.row_numbers(), x.indices] = x.data
            return out

        product = alignment.gustavson(sparse(a), sparse(b))
        assert (dense(product) == a @ b).all() and len(product.indices) == len(np.unique(product.row_numbers() * k + product.indices))
        assert (dense(alignment.transposed(sparse(a))) == a.T).all()


def test_a_vocabulary_that_crosses_spaces_is_not_cut():
    own = alignment.Tokenizers(*PATHS)
    assert own.cuts and own.chunks("a  b c") == ["a", " b", "c"]
    own.cuts = False
    assert own.chunks("a  b c") == ["a  b c"]
