"""Each stage of the pipeline on nulls, repeated rows, very long texts, an empty table and further columns."""

import corpus_pipeline as P
import pytest

TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ROWS = [
    (None, "a text without an id that has some words of its own in it"), (1, None), (2, ""), (3, " \n\t "), (4, "12 !! 34"), (5, TEXT), (5, TEXT), (6, TEXT + " end"),
    (7, "first line of a text that nobody repeats anywhere\nsecond line of a text that only two documents have"), (8, "another opening line which is quite different from all\nsecond line of a text that only two documents have"), (9, "x" * 70_000), (10, "wort " * 3000),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, body string, gone int, row int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "d", "b", 2, 3) for i, t in ROWS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def kept(df):
    assert df.columns == P.COLUMNS
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


STAGES = dict(P.STAGES)


def test_language_keeps_what_has_letters(spark, docs):
    want = sorted((r for r in ROWS if any(c.isalpha() for c in r[1] or "")), key=repr)
    assert kept(STAGES["language_id"](spark, docs, "")) == want


def test_lines_keep_the_first_occurrence(spark, docs):
    got = kept(STAGES["line_dedup"](spark, docs, ""))
    by = {i: t for i, t in got}
    # Both rows of an id are one occurrence; document 6 has a line that nearly repeats theirs, and nothing else.
    assert [i for i, _ in got].count(5) == 2 and by[5] == TEXT and 6 not in by
    assert by[7] == ROWS[8][1] and by[8] == "another opening line which is quite different from all"
    assert by[None] == ROWS[0][1] and by[1] is None and by[2] == "" and by[3] == ROWS[3][1] and by[9] == ROWS[10][1] and by[10] == ROWS[11][1]


def test_near_duplicates_keep_the_smallest_id(spark, docs):
    got = kept(STAGES["near_dedup"](spark, docs, ""))
    assert got == sorted((r for r in ROWS if r[0] != 6), key=repr)


def test_packing_takes_every_row(spark, docs):
    got = STAGES["best_fit_packing"](spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(str(i) for i, _ in ROWS)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), "").count() == 0
