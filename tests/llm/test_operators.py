"""The training-data operators against brute force, on texts with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quorumlake.llm import byte_bpe, gif_media, language_id, line_dedup, near_dedup, packing, pii, sharding, token_counts, vector_dedup
from quorumlake.llm.common import tokenizer_path
from quorumlake.llm.components import connected_components, joined_components, scrambled, unscrambled

SCHEMA = "doc_id long, text string, lang string, slot string, rep string"
ODD = ["", " ", None, "it's 's ''s 're", "\n\n a\t b", "é漢字 ½", "x" * 700, "a b c d e f", "a b c d e f", "A b c d e g"]


def texts(seed=1, n=120):
    rng = random.Random(seed)
    letters = "aab's  \n\t'rellved0129.,-!é ñ漢½ᵃ"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "q", "r") for i, t in enumerate(texts())], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts.token_counts(docs).collect()}
    for i, t in enumerate(texts()):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (n, len((t or "").encode()), n > 512)
    assert token_counts.token_counts(empty).count() == 0


def test_token_counts_across_chunks():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    long = ["ab " * 1000, "x" * 2000, "\n" * 600 + "a", "a<|endoftext|> b<|endoftext|>", "'re" * 300]
    assert token_counts.count_tokens(long, path).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in long]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, capacity=64).collect()
    places, whole = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.doc_id, []).append(r)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(texts()):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted(whole[i], key=lambda r: r.piece)
        assert [r.length for r in got] == [len(ids[k : k + 64]) for k in range(0, len(ids), 64)]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[k : k + 64].tobytes()) for k in range(0, len(ids), 64)]
    assert packing.pack_documents(empty).count() == 0


def test_reduction_is_as_good_as_exhaustive():
    assert packing.Plan({6: 3, 4: 3}, 10).solve().sequences == 3
    assert packing.Plan({10: 2, 9: 1, 1: 1}, 10).solve().sequences == 3
    rng = random.Random(3)
    for _ in range(50):
        counts = {rng.randint(1, 20): rng.randint(1, 9) for _ in range(8)}
        plan = packing.Plan(counts, 20).solve()
        assert sum(n for _, _, n, _, _ in plan.runs) == sum(counts.values())
        assert plan.sequences >= -(-sum(a * b for a, b in counts.items()) // 20)


def test_sharding(docs, empty):
    rows = sharding.balanced_shards(docs, shards=5).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    twins = [r.shard for r in rows if r.doc_id in (7, 8)]
    assert len(set(twins)) == 1
    assert sharding.balanced_shards(empty).count() == 0


def test_near_duplicates(spark, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", "q", "r") for i, t in enumerate(base + [None, "", "a", "A", "a b", "a b"])]
    for k in range(60):
        w = base[k % 10].split(" ")
        w[rng.randrange(60)] = "new"
        rows.append((100 + k, " ".join(w), "en", "q", "r"))
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = near_dedup.near_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert near_dedup.near_components(empty).count() == 0


def test_regions_have_no_window(spark):
    """Rows of a region meet all others of other components, however far apart, in whichever block and tile, and links
    that join components come out, no more of them than rows that met."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(1000)]
    base = [rng.choice(words) for _ in range(60)]
    texts = [" ".join(base[:40] + [rng.choice(words) if rng.random() < 0.35 and i % 3 else w for w in base[40:]]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    head = bytes(range(40))
    tail = np.random.default_rng(8)
    rows = [(i, 56, bytearray(head + tail.integers(0, 256, 24).astype(np.uint8).tobytes())) for i in range(60)]
    classes = spark.createDataFrame(rows, "rep long, n_shingles long, signature binary")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "node long, component long")
    sets = [{tuple(t.split(" ")[k : k + 5]) for k in range(56)} for t in texts]

    def apart(i, j):
        return max(i, j) >= 20

    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if apart(i, j) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}

    def parts(edges):
        parent = {i: 0 if i < 20 else i for i in range(60)}
        for i, j in edges:
            old, new = parent[i], parent[j]
            parent = {k: new if p == old else p for k, p in parent.items()}
        return {frozenset(k for k in parent if parent[k] == p) for p in parent.values()}

    assert 1 < len(parts(links)) < 41
    for block, tile in ((2048, 1024), (9, 1024), (2048, 7), (20, 4)):
        active = near_dedup.sifted(classes, labels, block=block, tile=tile).cache()
        got = [(min(r.a, r.b), max(r.a, r.b)) for r in near_dedup.region_links(active, docs.withColumnRenamed("doc_id", "rep")).collect()]
        assert set(got) <= links and parts(got) == parts(links)
        assert len(got) < active.count()
    whole = near_dedup.region_links(near_dedup.sifted(classes, labels, trees=1), docs.withColumnRenamed("doc_id", "rep"))
    assert whole.count() < 60


def test_overlaps(monkeypatch):
    monkeypatch.setattr(near_dedup, "MEMBERS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 40, 90, 1)]
    got = near_dedup.overlaps(sets[:3], sets)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets] for x in sets[:3]]
    assert near_dedup.overlaps(sets[:1], sets[:1]).tolist() == [[0]]


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.05 * rng.standard_normal(16)).tolist(), i % 2, 0) for i in range(200)]
    rows += [(300, None, 1, 0), (301, [0.0] * 16, 1, 0), (302, [float("nan")] * 16, 1, 0), (303, rows[0][1], None, 0), (304, rows[0][1], 0, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(frame).collect()}
    usable = [(i, np.array(v), l) for i, v, l, _ in rows if v is not None and l is not None and np.isfinite(v).all() and np.any(v)]
    found = want = 0
    for i, x, l in usable:
        n = sum(1 for j, y, m in usable if j != i and m == l and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98)
        assert got[i].n_links <= n
        found, want = found + got[i].n_links, want + n
    assert found >= 0.95 * want
    assert all(got[i].n_links == 0 and got[i].kept for i in (300, 301, 302, 303))
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_of_a_large_group(spark):
    """One tight group over many partitions and blocks: every pair is found."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 1e-6 * rng.standard_normal(16)).tolist(), 1) for i in range(600)]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        classes = vector_dedup.projected(frame, 2).select("label", "vector", "vec_id", "codes").withColumnRenamed("vec_id", "rep")
        assert vector_dedup.window_pairs(classes).count() == 600 * 599 // 2
        assert vector_dedup.window_pairs(classes, block=100).count() == 600 * 599 // 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_lines(spark, empty):
    long = "the quick brown fox jumps over the lazy dog while the council debates the annual budget for roads and parks again"
    rows = [(1, f"{long}\nalone one", "en", "q", "r"), (2, f"{long}\n\nalone two", "en", "q", "r"), (3, long.replace("again", "today"), "en", "q", "r"), (4, None, "en", "q", "r"), (5, "", "en", "q", "r"), (6, "alone one", "en", "q", "r"), (6, "alone one", "en", "q", "r")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in line_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (f"{long}\nalone one", 2, 2)
    assert got[2] == ("\nalone two", 2, 1)
    assert got[3] == ("", 1, 0)
    assert got[4] == (None, 0, 0) and got[5] == ("", 0, 0) and got[6][2] == 0
    assert line_dedup.without_repeats(empty).count() == 0


def test_lines_differ_anywhere(spark):
    """Lines that share only their word starts stay; lines that differ in little go, in any script."""
    pairs = [
        ("https://www.example.com/a/b/page1", "https://www.example.com/zzz/other"),
        ("Order reference 0123456789AB-one", "Order reference 0123456789AB-two and"),
        ("市議会は来年度の予算案について審議を行い道路整備を", "市議会は来年度の予算案に反対する市民の声を聞き公園"),
    ]
    rows = [(2 * i + j, line, "en", "q", "r") for i, p in enumerate(pairs) for j, line in enumerate(p)]
    long = "".join(chr(0x4E00 + 7 * k) for k in range(150))
    rows += [(100, long + "終", "ja", "q", "r"), (101, long + "了", "ja", "q", "r")]
    got = {r.doc_id: r.n_kept for r in line_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: 1 for i in range(6)}, 100: 1, 101: 0}


def test_lines_of_a_large_bucket(spark):
    """Every pair of a bucket in different components meets, in several blocks too; only those of similar sketches are rows."""
    rows = [(b, 1000 * b + i, 1000 * b) for b, n in ((1, 40), (2, 3)) for i in range(n)]
    shared = spark.createDataFrame(rows, "bucket long, h long, _low long")
    labels = spark.createDataFrame([(1000 + i, 1000) for i in range(30)] + [(2000 + i, 2000) for i in range(3)], "node long, component long")
    sketches = lambda of: spark.createDataFrame([(h, [of(h)] * line_dedup.SIFT_FLOOR + [h] * (line_dedup.SIFT - line_dedup.SIFT_FLOOR)) for _, h, _ in rows], "h long, m array<int>")
    old, line_dedup.BLOCK = line_dedup.BLOCK, 7
    try:
        every = [(r.a, r.b) for r in line_dedup.open_pairs(shared, labels, sketches(lambda h: 0)).collect()]
        even = [(r.a, r.b) for r in line_dedup.open_pairs(shared, labels, sketches(lambda h: h % 2)).collect()]
    finally:
        line_dedup.BLOCK = old
    want = [(1000 + i, 1000 + j) for i in range(40) for j in range(max(i + 1, 30), 40)]
    assert sorted(every) == want and sorted(even) == [(a, b) for a, b in want if (a - b) % 2 == 0]


def test_lines_of_similar_sketches_are_no_rows(spark):
    """Sketches let all pairs of a bucket through; only pairs whose sets are similar enough, or not known, leave its tile."""
    held = {1: list(range(0, 8)), 2: list(range(1, 9)), 3: list(range(4, 12)), 4: None, 5: list(range(0, 5)), 6: list(range(0, 1000))}
    whole = spark.createDataFrame([(h, [7] * line_dedup.SIFT, 8 if s is None else len(s), s) for h, s in held.items()], "h long, m array<int>, n int, s array<int>")
    shared = spark.createDataFrame([(9, h, 1) for h in held], "bucket long, h long, _low long")
    labels = spark.createDataFrame([], "node long, component long")
    pairs = spark.createDataFrame([(a, b) for a in held for b in held if a < b], "a long, b long")
    # a set of 5 or 1000 members can't be similar enough to one of 8, whatever they are
    for got in (line_dedup.open_pairs(shared, labels, whole), line_dedup.sifted(pairs, whole)):
        assert {(r.a, r.b) for r in got.collect()} == {(1, 2), (1, 4), (2, 4), (3, 4)}


def test_many_lines_of_one_text_go(spark):
    text = "\n".join(f"line {i // 2} of many {'abcdefgh'[i // 2 % 8] * 9} {i // 2 * 7919}" for i in range(20_000))
    got = line_dedup.without_repeats(spark.createDataFrame([(1, text, "en", "q", "r")], SCHEMA)).first()
    kept = got.text.split("\n")
    assert got.n_lines == 20_000 and got.n_kept == len(kept) <= 10_000 and len(set(kept)) == len(kept)


def test_lines_of_a_template(spark):
    """A family around the threshold: the components are those of all pairs that share a bucket."""
    rng = random.Random(5)
    common = "".join(rng.choice("abcdefghijklmnop") for _ in range(90))
    made = {common[:k] + "".join(rng.choice("qrstuvw") for _ in range(n)) + common[k:] for k, n in ((rng.randint(0, 90), rng.randint(1, 12)) for _ in range(150))}
    made = sorted(made)
    docs = spark.createDataFrame([(i, t, "en", "q", "r") for i, t in enumerate(made)], SCHEMA)
    names = {r.h: r.doc_id for r in line_dedup.lines(docs).collect()}
    together = {}
    for r in line_dedup.buckets(line_dedup.signatures(line_dedup.lines(docs))).collect():
        together.setdefault(r.bucket, []).append(names[r.h])
    sets = [{t[k : k + 12] for k in range(len(t) - 10)} for t in made]  # one long word: every place of it
    parent = list(range(len(made)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for held in together.values():
        for x in held:
            for y in held:
                if x < y and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                    a, b = find(x), find(y)
                    parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.n_kept for r in line_dedup.without_repeats(docs).collect()}
    assert got == {i: int(find(i) == i) for i in range(len(made))}


def test_personal_data(spark, docs, empty):
    weights = pii.train(docs)
    rows = [(1, "mail a@b.com now 1.2.3.4 or 4111 1111 1111 1111 é +1 (555) 123-4567", "en", "q", "r"), (2, None, "en", "q", "r"), (3, "999.1.1.1 4111111111111112 +12", "en", "q", "r"), (4, "a@b" + ".c" * 9000, "en", "q", "r")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, SCHEMA), weights).collect()}
    want = "email:5:12,ip:17:24,card:28:47,phone:50:67"
    assert got[1].spans == want and got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[2].spans == got[3].spans == "" and got[4].n_email == 1
    assert pii.redact(spark.createDataFrame(rows[:1], SCHEMA), weights).head().text == "mail <EMAIL> now <IP> or <CARD> é <PHONE>"
    assert pii.find_personal_data(empty, weights).count() == 0


def test_looser_spans_overlap_no_other(spark):
    yes = dict.fromkeys(["bias", *pii.LABELERS, *pii.FEATURES, *pii.KINDS], 1.0)
    texts = ["secret=555-123-4567", "call 555-123-4567 or a@b.co", "secret=abcdefgh12345678 555-123-4567"]
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), yes).orderBy("doc_id").collect()
    for r in got:
        spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",")]
        assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert got[0].spans == "secret:0:19" and got[1].n_email == 1 and got[1].n_extra == 1


def test_very_many_spans_of_one_text(spark):
    import time

    yes = dict.fromkeys(["bias", *pii.LABELERS, *pii.FEATURES, *pii.KINDS], 1.0)
    text = " ".join(f"u{i}@x.co 555-123-{i % 10000:04d}" for i in range(8000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.time()
    got = pii.find_personal_data(frame, yes).first()
    clean = pii.redact(frame, yes).first().text
    assert time.time() - begin < 90
    assert got.n_email == 8000 and got.n_extra == 8000
    assert clean == " ".join(["<EMAIL> <LOCAL>"] * 8000)


def test_language_of_labelled_texts_without_letters(spark):
    rows = [(i, "the quick brown fox and the lazy dog", "en", "q", "r") for i in range(8)] + [(9, "", "fr", "q", "r"), (10, " 12 \n", "de", "q", "r"), (12, "", None, "q", "r")]
    for parts in (1, 11):
        got = {r.doc_id: r.lang_pred for r in language_id.detect_languages(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}
        assert got == {i: "en" for i in range(8)} | {9: "und", 10: "und", 12: "und"}
    alone = language_id.detect_languages(spark.createDataFrame(rows[8:], SCHEMA))
    assert {r.lang_pred for r in alone.collect()} == {"und"}


def test_language(spark, empty):
    rows = [(i, t, lang, "q", "r") for i, (t, lang) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze ist nicht", "de")] * 40)]
    rows += [(1000, None, "en", "q", "r"), (1001, "12 34", "en", "q", "r")]
    got = {r.doc_id: r for r in language_id.detect_languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].lang_pred == lang for i, t, lang, *_ in rows[:80])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert got[1000].lang_pred == got[1001].lang_pred == "und"
    assert language_id.detect_languages(empty).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        scores = rng.standard_normal((n, 3)).astype(np.float32)
        value = lambda p: sum(scores[t, k] for t, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=n), key=value)
        assert abs(value(language_id.viterbi(scores, np.array([n]), 0.7).tolist()) - value(best)) < 1e-5


def test_byte_bpe(docs, empty):
    import regex
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    assert regex.compile(pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(tokenizer_path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_texts(docs, keep_ids=True).collect()}
    for i, t in enumerate(texts()):
        assert got[i].ids == own.encode_ordinary(t or "")
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_texts(empty).count() == 0


def test_gif_round_trip(docs, empty):
    for r in gif_media.store_texts(docs, keep_media=True).collect():
        n, payload = gif_media.payload_of(texts()[r.doc_id] or "")
        assert b"".join(f.samples.tobytes() for f in gif_media.decode(r.media).frames) == payload
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-64:]))
    assert gif_media.store_texts(empty).count() == 0


def test_gif_general_codes():
    """A stream with table entries, a late clear and a code for the entry just being made."""
    codes, bits = [(4, 3), (1, 3), (6, 3), (6, 3), (2, 4), (5, 4)], 2
    held = at = 0
    for code, width in codes:
        held |= code << at
        at += width
    assert gif_media.lzw_decode(held.to_bytes(-(-at // 8), "little"), bits, 6).tolist() == [1, 1, 1, 1, 1, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([(x,) for x in (0, -1, 5, 2**62, -(2**63))], "x long")
    assert all(r[0] == r[1] for r in ids.select("x", unscrambled(scrambled(F.col("x")))).collect())


def test_joined_components(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    edges = spark.createDataFrame([(2, 6), (9, 20), (30, 31)], "a long, b long")
    got = {r.node: r.component for r in joined_components(labels, edges).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}
    assert joined_components(labels, edges.limit(0)).count() == 6


def test_estimates_of_components_do_not_grow(spark):
    """Sizes that rounds of joins multiply would fill the driver with their digits."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    labels = connected_components(edges)
    for step in range(2):
        labels = joined_components(labels, spark.createDataFrame([(step, 100 + step)], "a long, b long"))
    assert labels.count() == 43
    assert len(str(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 12


def bpe_library():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_of_any_length_are_folded(spark):
    """Byte-level BPE of long words, in windows, against the library."""
    rng = random.Random(5)
    made = ["a" * 1500, "ab" * 900, "abc" * 500, "".join(rng.choice("etaoinshr") for _ in range(3000)), "!?" * 400, "-" * 1001, "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(400)), "x" * 361, "y" * 360]
    got = {r.doc_id: r.ids for r in byte_bpe.encode_texts(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), keep_ids=True).collect()}
    assert all(got[i] == bpe_library().encode_ordinary(t) for i, t in enumerate(made))


def test_a_word_that_is_a_token(spark, tmp_path):
    """A word that is a token is that token, as in the library, even if no merges lead to it; alone it is, not within a word."""
    import base64

    import public_tokenizers
    import tiktoken

    tokens = [bytes([k]) for k in range(256)] + [b"xyz", b"ab", b" xyz"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(token) + b" %d\n" % k for k, token in enumerate(tokens)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={token: k for k, token in enumerate(tokens)}, special_tokens={})
    made = ["xyz", "xyz xyz ab abxyz", "a", "xyz" * 200, "", None]
    got = {r.doc_id: r.ids for r in byte_bpe.encode_texts(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), str(path), keep_ids=True).collect()}
    assert got[0] == [256] and all(got[i] == library.encode_ordinary(t or "") for i, t in enumerate(made))


def test_words_begin_where_the_pattern_says():
    import public_tokenizers
    import regex

    from quorumlake.llm.pieces import Joined

    rng = random.Random(8)
    signs = ["'", "'s", "'re", "'ll", "'S", "s", "re", "a", "é", "漢", "1", "٣", " ", "  ", "\n", "\t", "\u3000", "!", "-", "_", "\u0301", "\U0001f600"]
    for _ in range(400):
        parts = [p for p in ("".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(5)) if p]
        joined, want, at = Joined(parts), [], 0
        for part in parts:
            want += [at + m.start() for m in regex.finditer(public_tokenizers.PATTERN, part)]
            at += len(part)
        assert byte_bpe.word_begins(joined).tolist() == want, parts


def test_the_rank_table_is_no_literal(spark):
    """The plan that goes to each task doesn't hold the rank table's numbers."""
    plan = byte_bpe.encode_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution()
    assert "BroadcastNestedLoopJoin" in plan.executedPlan().toString() and "Exchange hashpartitioning" not in plan.executedPlan().toString()
    assert len(plan.optimizedPlan().toString()) < 100_000


def test_texts_past_the_slices(spark):
    """Token counts, packing ids and BPE of texts of more than a million characters, cut at white space that only some classes hold."""
    from tokenizers import Tokenizer

    made = ["ab c" * 250_003 + "!!!!\x1c!!!! it's\u2003é", "xyz" * 9000 + " y" + " a b" * 250_000, "!\x1c" * 9000 + " 's"]
    counts = token_counts.count_tokens(made, tokenizer_path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in made]
    words = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for t, ids in zip(made, packing.token_ids(made, tokenizer_path("word_bpe_49k.json")), strict=True):
        assert ids.tolist() == words.encode(t, add_special_tokens=False).ids
    frame = spark.createDataFrame([(0, made[0]), (2, made[2])], "doc_id long, text string")
    for r in byte_bpe.encode_texts(frame).collect():
        own = np.array(bpe_library().encode_ordinary(made[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(own.tobytes()).hexdigest())


def fewest(items, capacity):
    """The optimum of a small packing instance, by trying every set for the longest item."""
    held = {}

    def solve(left):
        if not left:
            return 0
        if left not in held:
            sets = {()}
            for size in left[1:]:
                sets |= {(*s, size) for s in sets if sum(s) + size + left[0] <= capacity}
            best = len(left)
            for chosen in sets:
                rest = list(left[1:])
                for size in chosen:
                    rest.remove(size)
                best = min(best, 1 + solve(tuple(rest)))
            held[left] = best
        return held[left]

    return solve(tuple(sorted(items, reverse=True)))


def test_reduction_keeps_the_optimum():
    """What the reduction fixes never costs a sequence, by an exhaustive optimum; the whole is no worse than best-fit decreasing."""
    rng = random.Random(1)
    assert packing.Plan({4: 1, 3: 1, 2: 1}, 10).solve().sequences == 1
    for _ in range(150):
        capacity = rng.choice([10, 12, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 7))]
        counts = Counter(items)
        reduced = packing.Plan(counts, capacity)
        reduced.reduce()
        left = [size for size, n in reduced.left.items() for _ in range(n)]
        assert reduced.sequences + fewest(left, capacity) == fewest(items, capacity)
        plain = packing.Plan(counts, capacity)
        plain.best_fit()
        assert packing.Plan(counts, capacity).solve().sequences <= plain.sequences


def test_viterbi_in_chunks():
    rng = np.random.default_rng(9)
    scores, counts = rng.standard_normal((60, 3)).astype(np.float32), np.array([25, 0, 7, 28])
    whole = language_id.viterbi(scores, counts, 0.7, 1000).tolist()
    assert all(language_id.viterbi(scores, counts, 0.7, chunk).tolist() == whole for chunk in (1, 2, 5, 7))


def test_words_are_letters_of_one_script():
    assert language_id.words_of("Hello ½ ² Ⅳ ① wörld漢字かな") == ["hello", "wörld", "漢字", "かな"]
    assert [len(w) for w in language_id.words_of("a" * 200)] == [64, 64, 64, 8]


def test_odd_numbers_are_no_letters(spark):
    rows = [(i, "der hund und die katze", "de", "q", "r") for i in range(8)] + [(9, "½ ² Ⅳ ①", "de", "q", "r")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.detect_languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[9] == ("und", 0.0)


def test_gif_streams():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 5000, 40000):
        for high in (1, 3, 256):
            samples = rng.integers(0, high, n).astype(np.uint8).tobytes()
            assert gif_media.lzw_decode(gif_media.lzw_encode(samples), 8, n).tobytes() == samples
            if high <= 3:
                assert gif_media.lzw_decode(gif_media.lzw_encode(samples, 2), 2, n).tobytes() == samples


def test_gif_disposal_transparency_palettes_and_interlace(spark):
    """Four frames of 2 x 2 and one interlaced of 1 x 4, drawn by hand."""
    import struct

    def frame(disposal, transparent, samples, palette=b"", left=0, top=0, width=2, height=2, interlace=0):
        flags = (0x80 if palette else 0) | interlace
        control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), 5, transparent or 0, 0)
        body = gif_media.lzw_encode(bytes(samples), 2)
        return control + struct.pack("<BHHHHB", 0x2C, left, top, width, height, flags) + palette + b"\x02" + bytes([len(body)]) + body + b"\0"

    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    own = bytes([9, 9, 9, 255, 255, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 4, 0x81, 0, 0) + shared
    frames = [
        frame(gif_media.LEAVE, None, [1, 1, 1, 1]),
        frame(gif_media.PREVIOUS, 0, [0, 2, 2, 0]),
        frame(gif_media.BACKGROUND, 0, [0, 0, 3, 0]),
        frame(gif_media.LEAVE, None, [1, 0, 0, 1], own),
        frame(gif_media.LEAVE, None, [0, 1, 2, 3], left=1, width=1, height=4, interlace=0x40),
    ]
    data = head + b"".join(frames) + b";"
    shown = [c[:, :, :3].tolist() for c, _ in gif_media.decode(data).canvases()]
    red, green, blue, grey, white, none = [255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9], [255] * 3, [0] * 3
    assert shown[0] == [[red, red], [red, red], [none, none], [none, none]]
    assert shown[1][:2] == [[red, green], [green, red]]
    assert shown[2][:2] == [[red, red], [blue, red]]
    assert shown[3][:2] == [[white, grey], [grey, white]]
    # interlaced rows come in the order 0, 2, 1, 3
    assert [row[1] for row in shown[4]] == [none, green, red, blue]
    out = gif_media.decode_media(spark.createDataFrame([(1, bytearray(data)), (2, None)], "id long, media binary")).orderBy("id").collect()
    assert [(f.start, f.delay) for f in out[0].frames] == [(5 * k, 5) for k in range(5)] and out[1].frames == []
    assert out[0].frames[0].pixels == 4 and out[0].frames[0].histogram == [0] * 7 + [4] + ([4] + [0] * 7) * 2


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    """The base of personal data, by the plain patterns."""
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_data_against_plain_patterns(spark, docs):
    weights = pii.train(docs)
    rng = random.Random(7)
    parts = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "300.1.1.1", "@", ".", "-", " ", "é", "漢", "12", "+", "x_y%z@q-r.s.t", "0.0.0.0", "5500000000000004", "555-123-4567"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["1.2.3.4 a@b.co " * 700, None, ""]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), weights).collect()}
    for i, text in enumerate(made):
        want = base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert got[i].n_email == want.count("email:") and got[i].n_extra == len([x for x in got[i].spans.split(",") if x]) - len([x for x in want.split(",") if x])


def test_the_span_classifier_decides(spark):
    """A secret whose value the check refuses, among others like it, is judged by the weights alone."""
    rows = [(1, "password=abcdefghijklmnop", "en", "q", "r"), (2, "call 555-123-4567 now", "en", "q", "r")]
    frame = spark.createDataFrame(rows, SCHEMA)
    yes = dict.fromkeys(["bias", *pii.LABELERS, *pii.FEATURES, *pii.KINDS], 1.0)
    no = {**yes, "secret": -20.0}
    assert [r.n_extra for r in pii.find_personal_data(frame, yes).orderBy("doc_id").collect()] == [1, 1]
    assert [r.n_extra for r in pii.find_personal_data(frame, no).orderBy("doc_id").collect()] == [0, 1]


def test_lines_with_clashing_columns(spark):
    rows = [(1, "one two three four five six", 7, "g", "t", "d", "k"), (2, "one two three four five six", 8, "g", "t", "d", "k"), (None, None, 9, "g", "t", "d", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, gone string, _text string, _doc string, _key string")
    got = line_dedup.without_repeats(frame, "_lines", "_left").orderBy("n_lines").collect()
    assert [(r.n_lines, r.gone, r._text, r._doc, r._key, r._lines, r._left) for r in got] == [(7, "g", "t", "d", "k", 1, 1), (8, "g", "t", "d", "k", 1, 0), (9, "g", "t", "d", "k", 0, 0)]


def test_lines_against_brute_force(spark):
    """Random lines of few words: the kept lines are those of all pairs with exact Jaccard of 0.75 or more."""
    rng = random.Random(12)
    words = ["council", "budget", "road", "park", "vote", "approved", "motion", "second", "hearing", "zoning"]
    base = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(25)]
    made = base + [" ".join(w if rng.random() > 0.03 else rng.choice(words) for w in rng.choice(base).split(" ")) for _ in range(120)]
    made = sorted(set(made))
    frame = spark.createDataFrame([(i, t, "en", "q", "r") for i, t in enumerate(made)], SCHEMA)
    sets = [{t[m.start() : m.start() + 12] for m in re.finditer(r"\S+", t)} for t in made]
    parent = list(range(len(made)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(made)):
        for y in range(x + 1, len(made)):
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.n_kept for r in line_dedup.without_repeats(frame).collect()}
    assert got == {i: int(find(i) == i) for i in range(len(made))}
