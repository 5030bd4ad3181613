import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, text, vector


@pytest.mark.parametrize(
    ("given", "want"),
    [(["a b", "c d"], ["a b", "c d"]), (["a", "c d"], ["a c d"]), (["a", "c d", "e"], ["a c d e"]), (["a b", "c", "e"], ["a b c e"]), (["a b", "c", "e f", "g h"], ["a b c e f", "g h"])],
)
def test_small_sentences_are_combined(spark, given, want):
    df = spark.createDataFrame([(given,)], "s array<string>")
    assert df.select(text.combine_small(F.col("s"), 2)).first()[0] == want


@pytest.mark.parametrize(("old", "new", "want"), [("abcdef", " abcdef", (0, 0, " ")), ("abcdef", "abcdef ", (6, 6, " ")), ("abcdef", "bcdef", (0, 1, "")), ("abcdefg", "abcdef", (6, 7, ""))])
def test_edits(old, new, want):
    assert [tuple(x.values()) for x in text.diff_spans(old, new)] == [want]


def test_spans_move_with_their_text():
    assert text.realign("is a, test", "a, test", [{"start": 3, "end": 4}])[0]["text"] == "a"
    assert text.realign("a test", "a, test", [{"start": 2, "end": 6}])[0] == {"start": 3, "end": 7, "text": "test"}


def test_text_columns(spark):
    df = spark.createDataFrame([("<b>x: y</b>, z", "```json\n[1, 0, 2]\n```", "Range: 3, 7")], "h string, j string, r string")
    row = df.select(text.strip_html(F.col("h")), text.parse_ranking(F.col("j"), 3), text.parse_ranking(F.col("j"), 4), text.parse_range(F.col("r")), text.xml_tag(F.col("h"), "b"), text.clause_split(F.col("h"))).first()
    assert list(row) == [" x: y , z", [1, 0, 2], None, [3, 7], "x: y", ["<b>x:", "y</b>,", "z"]]


def test_udfs(spark):
    df = spark.createDataFrame([("ab cd", [(0, 2)])], "t string, s array<struct<start:int,end:int>>")
    row = df.select(text.wrap_entities("t", "s").alias("w")).select("w", text.parse_entities("w").alias("p")).first()
    assert row["w"] == "{{ab}} cd"
    assert [tuple(x) for x in row["p"]] == [(0, 2, "ab")]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    a, z = F.col("a"), F.col("z")
    row = df.select(vector.cosine(a, a), vector.cosine(a, z), vector.cosine_distance(a, z), vector.euclid(a, z), vector.normalize(z)).first()
    assert row[0] == pytest.approx(1.0)
    assert list(row)[1:] == [0.0, None, -5.0, [0.0, 0.0]]
    with pytest.raises(ValueError):
        vector.measure("unknown", a, a)


def test_arrays(spark):
    df = spark.createDataFrame([("a$$b$", ["x", "y", "x"])], "s string, l array<string>")
    row = df.select(arrays.unpack(F.col("s")), arrays.project_labels(F.col("l"), F.array(F.lit("x"))), arrays.final_labels(F.col("l"), F.array(F.lit("a")), F.array(F.lit("y")))).first()
    assert list(row) == [["a", "b"], ["x", "x"], ["a", "x"]]
