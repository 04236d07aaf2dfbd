import duckdb
import pytest
from pyspark.sql import functions as F

from vellumic.llm import lookalike as L


@pytest.fixture(scope="module")
def canon():
    con = duckdb.connect()
    return lambda s: con.execute(f"SELECT {L._plain('x')} FROM (SELECT ? AS x)", [s]).fetchone()[0]


SAME = [
    ("café", "café"), ("ｗｉｄｅ　１２", "wide 12"), ("a​b­c﻿", "abc"), ("a b c d", "a b c d"), ("сорт", "copт"), ("Аԁӏ", "Adl"),
    ("тёмный", "тёмный"), ("тëмный", "тёмный"), ("όνομα", "όνoμα"), ("е́", "é"), ("e‍́", "é"), ("քօս", "քou"), ("Tiếnval", "Tiếnval"),
]
DIFFERENT = [("cafe", "café"), ("m²", "m2"), ("0", "O"), ("1", "l"), ("I", "l"), ("a  b", "a b"), ("a\nb", "a b"), ("“a”", '"a"'), ("a–b", "a-b"), ("A", "a"), ("ab ", "ab"), ("ﬁ", "fi"), ("и", "й"), ("½", "1/2"), ("т", "t")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look_same_form(canon, a, b):
    assert canon(a) == canon(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_what_shows_stays(canon, a, b):
    assert canon(a) != canon(b)


def test_compatibility_forms_in_the_wide_form():
    con = duckdb.connect()
    wide = lambda s: con.execute(f"SELECT {L._plain('x', True)} FROM (SELECT ? AS x)", [s]).fetchone()[0]
    assert [wide(x) for x in ("ﬁnd", "Ⅳ", "ｶﾞ", "￦", "ｗ", "m²", "𝐇")] == ["find", "IV", "ガ", "₩", "w", "m²", "𝐇"]
    assert all(wide(wide(a)) == wide(a) for pair in SAME + DIFFERENT for a in pair)


@pytest.mark.parametrize("text", [*[x for pair in SAME + DIFFERENT for x in pair], "", "ﬁ Ⅷ ﾊﾟ", None])
@pytest.mark.parametrize("wide", [False, True])
def test_equals_the_form_by_characters(text, wide):
    con = duckdb.connect()
    a, b = con.execute(f"SELECT {L._plain('x', wide)}, {L._by_character('x', wide)} FROM (SELECT CAST(? AS VARCHAR) AS x)", [text]).fetchone()
    assert a == b


def test_canonical_is_stable_and_ascii_is_untouched(canon):
    for a, b in SAME + DIFFERENT:
        assert canon(canon(a)) == canon(a) and canon(canon(b)) == canon(b)
    assert canon("plain 'text' \\ 1/2 %") == "plain 'text' \\ 1/2 %"


def test_whole_columns(spark):
    long = "ｘ" * 300_000
    df = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "b​", "b"), (3, "b​", "b"), (4, long, "x" * 300_000)], 'k int, prediction string, "a b" string'.replace('"a b"', "`a b`"))
    out = {r["k"]: r for r in L.canonical(df, ["prediction", "a b"]).collect()}
    assert out[1]["prediction_canonical"] is None and out[2]["prediction_canonical"] == "" and out[3]["prediction_canonical"] == "b" and out[4]["prediction_canonical"] == "x" * 300_000
    assert out[2]["a b_canonical"] is None and out[3]["prediction"] == "b​"
    assert L.canonical(df.limit(0), ["prediction"]).count() == 0
    with pytest.raises(ValueError):
        L.canonical(df.withColumn("prediction_canonical", F.lit(1)), ["prediction"])


def test_found(spark, tmp_path):
    rows = [(1, "a b", "a b"), (1, "a b", "a b"), (2, "a", "a"), (3, None, "a"), (4, "", "a"), (5, "​", ""), (6, "a", None), (7, "a1", "al")]
    spark.createDataFrame(rows, "eval_id long, prediction string, ground_truth string").write.parquet(str(tmp_path / "sample_evaluations.parquet"))
    assert sorted(r[0] for r in L.found(spark, str(tmp_path)).collect()) == [1, 5]
