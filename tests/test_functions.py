import math

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import metadata as M
from corpuslens.functions import text as T
from corpuslens.functions.vectors import cosine, unit


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_light_clean_joins_lines_and_words(spark):
    cases = {
        "investi-\ngación de\ncampo": "investigación de campo",
        "Mecánica-\nEléctrica": "Mecánica-Eléctrica",
        "COVID-\n19 x": "COVID-19 x",
        "Ends here.\nNext one": "Ends here.\nNext one",
        "S.A.C.\nque sigue": "S.A.C. que sigue",
        "a\n\n\n b\r\nc": "a\n\nb c",
        "list:\n- one": "list: - one",
        "done.\n- one": "done.\n- one",
        "“q” ‘r’ a‐b​": "\"q\" 'r' a-b",
        "soft­\nhyphen so­ft": "softhyphen soft",
        "dash -\nafter": "dash - after",
        "": "",
        " \n\t ": "",
        "é": "é",
    }
    assert apply(spark, list(cases), T.light_clean) == list(cases.values())
    assert apply(spark, list(cases.values()), T.light_clean) == list(cases.values())  # stable


def test_normalisation(spark):
    assert apply(spark, ["a  b\n\nc ", None, "é"], T.normalized) == ["a b c", None, "é"]
    assert apply(spark, ["Straße  ÉTÉ", "ﬁn"], T.fold_key) == ["strasse ete", "fin"]


def test_sentences():
    split = lambda t: [t[a:b] for a, b in T.sentence_spans(t)]
    assert split("One here. Two there! Three") == ["One here.", "Two there!", "Three"]
    assert split("El Dr. Ruiz de S.A.C. Lima vino. Fin") == ["El Dr. Ruiz de S.A.C. Lima vino.", "Fin"]
    assert split("See No. 5 and J. Doe. Next") == ["See No. 5 and J. Doe.", "Next"]
    assert split("He said no. Then left") == ["He said no.", "Then left"]
    assert split("a line\nanother") == ["a line", "another"]
    assert split("1. First item. 2. Second item") == ["1. First item.", "2. Second item"]
    assert split("it is 3.5 m. wide") == ["it is 3.5 m. wide"]
    assert split("  ") == []


@pytest.mark.parametrize("limit", [3, 5, 8, 40])
def test_chunks_fit_and_lose_nothing(limit):
    text = "First one, with a comma; and a clause: more words here. Second sentence\nThird line is long " + "word " * 30 + "end. " + "x" * 50
    got = T.chunk_spans(text, T.word_tokens, limit)
    assert all(n <= limit and T.word_tokens(text[a:b]) == n for a, b, n, _ in got)
    assert "".join("".join(text[a:b].split()) for a, b, _, _ in got) == "".join(text.split())
    assert {k for *_, k in got} <= {"sentence", "clause", "comma", "window"}
    for (a, _, _, _), (_, b, _, _) in zip(got, got[1:], strict=False):  # greedy: the next chunk's first unit would not fit
        assert T.word_tokens(text[a:b]) > limit


def test_chunks_count_letters_when_a_word_is_too_long():
    assert [n for *_, n, _ in T.chunk_spans("abcdefgh", len, 3)] == [3, 3, 2]
    with pytest.raises(ValueError):
        T.chunk_spans("abc", lambda t: 9, 3)


def test_chunk_table(spark):
    sections = spark.createDataFrame([(1, "a", "One two three. Four five six."), (2, "a", None), (3, "b", "  ")], "doc_id bigint, section string, text string")
    got = T.chunks(sections, 6)
    assert [(r.doc_id, r.chunk_index, r.text) for r in got.orderBy("doc_id", "chunk_index").collect()] == [(1, 0, "One two three."), (1, 1, "Four five six.")]
    assert T.check_chunks(got, sections, 6).first().asDict() == {"sections": 3, "over": 0, "lost": 0, "chunks": 2}


def test_packing(spark):
    f = lambda v: T.packed(v, 10)
    assert apply(spark, [[3, 3, 3, 3], [25], [10, 1], []], f, "array<int>") == [2, 3, 2, 0]


def test_partial_days(spark):
    got = apply(spark, ["2020", "2020-05", "2020-05-07", "2020-05-07T01:02", "2020-13", "20205", "x", None, "2020-02-30"], M.partial_day)
    assert [str(g) if g else None for g in got] == ["2020-01-01", "2020-05-01", "2020-05-07", "2020-05-07", None, None, None, None, None]


def test_check_digit(spark):
    assert apply(spark, ["000000021825009", "000000021694233"], M.check_digit) == ["7", "X"]


def test_page_numbers_and_keys(spark):
    lines = {"12": True, "- 7 -": True, "xii": True, "Página 12": True, "12 de 120": True, "XII": False, "Chapter 12": False, "2020": False, "": False, None: False}
    assert apply(spark, list(lines), M.page_number) == list(lines.values())
    assert apply(spark, ["Page 12  of 30", "PAGE 7 of 9"], M.line_key) == ["page ## of ##", "page # of #"]


def test_values_and_maps(spark):
    assert apply(spark, [[" a ", "", "b"], []], M.values, "array<string>") == [["a", "b"], []]
    assert apply(spark, [["", "b"], []], M.first, "array<string>") == ["b", None]
    assert apply(spark, [{"x.dni": "1", "y": "2"}], lambda c: M.without_keys(c, ".dni"), "map<string,string>") == [{"y": "2"}]


def test_bigrams(spark):
    assert apply(spark, [["a", "b", "c"], ["a"], []], M.bigrams, "array<string>") == [["a b", "b c"], [], []]


def test_zero_vector_is_an_error(spark):
    frame = column(spark, [[1.0, 0.0], [3.0, 4.0]], "array<double>")
    assert [round(r[0], 6) for r in frame.select(cosine("v", F.array(F.lit(1.0), F.lit(0.0)))).collect()] == [1.0, 0.6]
    with pytest.raises(Exception, match="direction"):
        column(spark, [[0.0, 0.0]], "array<double>").select(unit("v")).collect()
    assert math.isclose(sum(x * x for x in frame.select(unit("v")).collect()[1][0]), 1)
