from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusweave.functions.chunking import chunks, pieces
from corpusweave.operators.chunks import chunk_stats, chunk_texts, reassemble


def cut(column, texts, limit):
    return column(texts, lambda x: chunks(x, limit))


def test_short_text_is_untouched(column):
    assert cut(column, [" a\n\n b ", "x" * 10, ""], 10) == [[" a\n\n b "], ["x" * 10], [""]]


def test_two_paragraphs(column):
    for size, limit in ((1200, 2000), (2200, 4000)):
        got = cut(column, ["a" * size + "\n" + "b" * size], limit)
        assert got == [["a" * size, "b" * size]]


def test_paragraphs_share_a_chunk(column):
    assert cut(column, ["aa\n\n bb \ncccccc"], 10) == [["aa\n\nbb", "cccccc"]]


def test_first_piece_near_the_limit_is_preceded_by_an_empty_chunk(column):
    # 9 + 2 and 10 + 2 exceed 10 although the paragraphs fit alone
    assert cut(column, ["a" * 9 + "\nb"], 10) == [["", "a" * 9, "b"]]
    assert cut(column, ["a" * 10 + "\nb"], 10) == [["", "a" * 10, "b"]]


def test_sentences_and_words(column):
    long = "one two. three four! five"
    assert cut(column, [long], 14) == [["one two.", "three four!", "five"]]
    # the blank line that joins the pieces is counted as one character
    assert cut(column, ["a b c d e f g"], 10) == [["a\n\nb\n\nc\n\nd\n\ne", "f\n\ng"]]


def test_word_over_the_limit_is_whole(column):
    assert cut(column, ["x " + "y" * 20 + " z"], 10) == [["x", "y" * 20, "z"]]


def test_long_paragraph_closes_the_open_chunk_and_stays_open(column):
    text = "aa\nbbbb bbbb bbbb\ncc"
    assert cut(column, [text], 10) == [["aa", "bbbb\n\nbbbb", "bbbb\n\ncc"]]


def test_sentence_end_needs_white_space(column):
    got = column(["a.b? c! d"], lambda x: F.transform(pieces(x, 3), lambda p: p["text"]))
    assert got == [["a.b?", "c!", "d"]]


@settings(
    max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text("ab .!?\n", max_size=60), min_size=1, max_size=15), st.integers(4, 12))
def test_nothing_is_lost_or_moved(column, texts, limit):
    for text, got in zip(texts, cut(column, texts, limit)):
        assert "".join("".join(got).split()) == "".join(text.split())


def test_chunk_table(spark):
    docs = spark.createDataFrame(
        [(1, "aa\nbbbbb\ncc"), (2, "x"), (3, None)], "id int, text string"
    )
    table = chunk_texts(docs, ["id"], limit=8)
    assert sorted(map(tuple, table.collect())) == [
        (1, 1, "aa"), (1, 2, "bbbbb"), (1, 3, "cc"), (2, 1, "x"),
    ]
    stats = {r.id: (r.n_chunks, r.total_chars, r.max_chars) for r in
             chunk_stats(docs, ["id"], limit=8).collect()}
    assert stats == {1: (3, 9, 5), 2: (1, 1, 1)}


def test_reassembly_in_order_and_in_parts(spark):
    rows = [(1, n, f"p{n}_".encode()) for n in (3, 1, 5, 2, 4)]
    df = spark.createDataFrame(rows, "id int, chunk_no int, payload binary")
    whole = reassemble(df, ["id"]).collect()
    assert [(r.part_no, bytes(r.payload)) for r in whole] == [(1, b"p1_p2_p3_p4_p5_")]
    parts = sorted((r.part_no, bytes(r.payload)) for r in reassemble(df, ["id"], part_bytes=6).collect())
    assert parts == [(1, b"p1_p2_"), (2, b"p3_p4_"), (3, b"p5_")]
