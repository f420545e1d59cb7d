"""The corpus pipeline on null and repeated ids, clashing columns and an empty table."""

import corpus_pipeline

LONG = "the council of the city met in the hall to vote on the budget for roads parks and schools in the coming year after a long debate"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, gone string, _text string, _row int, _kept int"
ROWS = [
    (None, None, "en", "a", 0),
    (None, f"{LONG} one", "en", "a", 9),
    (5, "a quiet english text about rivers and mountains", "en", "a", 9),
    (5, "12 34", "en", "a", 5),
    (6, "a b", "en", "a", 3),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "g", "t", 2, 3) for r in rows], SCHEMA)


def test_language_judges_rows(spark):
    docs = frame(spark)
    got = corpus_pipeline.language_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.text for r in got.collect()) == sorted(t for _, t, *_ in ROWS if t and t != "12 34")


def test_near_stage_keeps_one_row_of_a_group(spark):
    docs = frame(spark, [(1, LONG, "en", "a", 1), (1, LONG, "en", "a", 1), (2, LONG + " again", "en", "a", 1), (1, "other words here", "en", "a", 1), (None, None, "en", "a", 0)])
    got = corpus_pipeline.near_stage(spark, docs, "")
    texts = [r.text for r in got.collect()]
    assert got.columns == docs.columns and len(texts) == 3
    assert sum(t is not None and t.startswith(LONG) for t in texts) == 1 and "other words here" in texts and None in texts


def test_lines_and_personal_data_with_clashing_columns(spark):
    docs = frame(spark, [(1, f"{LONG}\nfirst mail a@b.co", "en", "a", 1), (2, f"{LONG}\nsecond text", "en", "a", 1), (3, LONG, "en", "a", 1)])
    lines = corpus_pipeline.line_stage(spark, docs, "")
    assert lines.columns == docs.columns
    assert sorted(r.text for r in lines.collect()) == sorted([f"{LONG}\nfirst mail a@b.co", "second text"])
    clean = corpus_pipeline.personal_data_stage(spark, lines, "")
    found = {r.doc_id: (r.text, r.n_chars, r.n_lines) for r in clean.collect()}
    assert clean.columns == docs.columns and found[1] == (f"{LONG}\nfirst mail <EMAIL>", len(LONG) + 19, 1)


def test_empty_table(spark):
    docs = frame(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_labelled_texts_without_letters_go(spark):
    docs = frame(spark, [(i, f"{LONG} {i}", "en", "a", 9) for i in range(8)] + [(9, "", "fr", "a", 0), (10, "12 34", "de", "a", 5)])
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()) == list(range(8))
