import pytest
from pyspark.sql import functions as F

from hubloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize("t", ["תל אביב", "חיפה", "אאאאא", "Tel Aviv - תל אביב", "תל אביב Tel Aviv", "תל אביב (מרכז)", "חיפה - צפון", "ירושלים, ישראל", "", None, "   "])
def test_hebrew(spark, t):
    assert one(spark, t, T.is_valid_hebrew) is True


@pytest.mark.parametrize("t", ["Tel Aviv", "Haifa", "Jerusalem", "Tel Aviv תל", "!@#$%^&*()", "₪˜™–__", "–ª–™–"])
def test_not_hebrew(spark, t):
    assert one(spark, t, T.is_valid_hebrew) is False


@pytest.mark.parametrize(
    "t, want",
    [("[\"['rail_1_1' 'rail_1_2']\"]", ["rail_1_1", "rail_1_2"]), ("[\"['brt021' 'brt022']\", \"['brt021']\"]", ["brt021", "brt022"]), ("['line1', 'line2']", ["line1", "line2"]), ("line1, line2 line3", ["line1", "line2", "line3"]), ("Bee\rSheva", ["BeeSheva"]), ("", []), (None, [])],
)
def test_parse_lines(spark, t, want):
    assert one(spark, t, T.parse_lines) == want


def test_small_functions(spark):
    assert one(spark, "a\\r\n  b\t c ", T.clean_line_name) == "a b c"
    assert one(spark, "['x', 'y']", T.first_of_list) == "x" and one(spark, "[]", T.first_of_list) is None
    assert one(spark, "[12 x 7]", T.node_numbers) == [12, 7]
    assert one(spark, "a/b c\\d", T.safe_file_name) == "a_b_c_d"
    assert one(spark, "POINT (1.5 -2)", lambda c: F.array(*T.wkt_point(c))) == [1.5, -2.0]
    assert one(spark, "x", lambda c: F.array(*T.wkt_point(c))) == [None, None]


@pytest.mark.parametrize("t, want", [("תל אבי", "תל אביב"), ("מרכז", "מרכז"), ("גלעי, צפו", "גלעין, צפון"), ("טבעת פנימי", "טבעת פנימית"), (None, None)])
def test_truncated(spark, t, want):
    assert one(spark, t, T.fix_truncated) == want


def test_mojibake(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        broken = "חיפה".encode("windows-1255").decode("latin-1")
        assert one(spark, broken, T.fix_mojibake) == "חיפה"
        assert one(spark, "חיפה", T.fix_mojibake) == "חיפה" and one(spark, "Haifa", T.fix_mojibake) == "Haifa" and one(spark, None, T.fix_mojibake) is None
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_hub_name(spark):
    df = spark.createDataFrame([("n", "a, b", 1), (None, " a , b", 2), (None, ", b", 3), (None, None, 4)], "n string, a string, g int")
    assert [r[0] for r in df.select(T.hub_name(F.col("n"), F.col("a"), F.col("g"))).collect()] == ["n", "a", "Hub 3", "Hub 4"]
