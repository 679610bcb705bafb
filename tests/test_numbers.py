import pytest
from pyspark.sql import functions as F

from pagetrail.functions import numbers as N
from pagetrail.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("1 234,5", 1234.5), ("1 441,1", 1441.1), ("1 234", 1234.0), ("(8,3)", -8.3), ("−8,3", -8.3), ("– 5", -5.0), ("—", None), ("н/д", None), ("", None), (None, None),
        ("12,3%", 12.3), ("269,7¹", 269.7), ("269,7*", 269.7), ("1.234.567", 1234567.0), ("1.234.56", 1234.56), ("5 млрд руб.", 5.0), ("1441.", 1441.0), ("abc", None), ("nan", None), ("1e5", None), ("1.5d", None),
    ],
)
def test_parse_number(spark, raw, want):
    assert one(spark, raw, N.parse_number) == want


@pytest.mark.parametrize(("raw", "want"), [("(1 234,5)", -1234.5), ("19,5", 19.5), ("–", None), ("н/д", None), ("+7", 7.0), ("12%", 12.0), ("7*", 7.0), (None, None), ("1.2.3", None)])
def test_norm_num(spark, raw, want):
    assert one(spark, raw, N.norm_num) == want


@pytest.mark.parametrize(("text", "want"), [("млрд руб.", "млрд_руб"), ("МЛН", "млн_руб"), ("тыс. человек", "тыс_руб"), ("процентных пунктов", "%"), ("п. п.", "п.п."), ("10 шт", "шт"), ("лет", None)])
def test_unit(spark, text, want):
    assert one(spark, text, N.extract_unit) == want


def test_cell_without_value_has_no_unit(spark):
    row = spark.createDataFrame([("—", "млрд руб."), ("5", "млрд руб."), ("5%", "млрд руб.")], "a string, b string").select(N.parse_cell(F.col("a"), F.col("b")).alias("c")).collect()
    assert [tuple(r.c) for r in row] == [(None, None), (5.0, "млрд_руб"), (5.0, "%")]


@pytest.mark.parametrize(("text", "want"), [("12,5", True), ("+2,6", False), ("12%", False), ("(5)", True), ("слово", False)])
def test_is_value(spark, text, want):
    assert one(spark, text, N.is_value) is want


@pytest.mark.parametrize(("p", "want"), [("28.05.2025", "2025-05-28"), ("4 кв 2025", "4кв2025"), ("4кв'2025", "4кв2025"), ("1п2024", "1h2024"), ("2025", "2025"), (None, "")])
def test_period(spark, p, want):
    assert one(spark, p, N.norm_period) == want


def test_format(spark):
    assert one(spark, 1441.1, lambda c: N.format_ru(c, 1), "double") == "1 441,1"


@pytest.mark.parametrize(
    ("text", "want"),
    [("2025 4 582,5", [4582.5]), ("стр. 86-88 и 10-20", [10.0, -20.0]), ("1 441,1 и 1441.1", [1441.1, 1441.1]), ("−8,7", [8.7]), ("-2025", [-2025.0]), ("", []), (None, [])],
)
def test_values_in(spark, text, want):
    assert one(spark, text, X.values_in) == want


def test_numbers_in_is_a_set(spark):
    assert sorted(one(spark, "1 441,1 1441.10 5", X.numbers_in)) == ["1441.1", "5"]


@pytest.mark.parametrize(("v", "want"), [(36.0, 1), (35.76, 2), (1.12345, 5), (0.1, 1)])
def test_decimals(spark, v, want):
    assert one(spark, v, X.decimals, "double") == want


@pytest.mark.parametrize(("text", "want"), [("Доля в выручке", "revenue"), ("Рентабельность по скорр. EBITDA", "ebitda_adj"), ("Чистая прибыль", "net_profit"), ("«Ёлка» (шт.)", "елка шт")])
def test_canon_metric_order(spark, text, want):
    assert one(spark, text, lambda c: X.canon_metric(c)["name"]) == want


@pytest.mark.parametrize(("text", "want"), [("стр. 21, стр 7 и стр.21", [7, 21]), ("стр. 86-88", [86]), ("нет", [])])
def test_citations(spark, text, want):
    assert one(spark, text, X.citations) == want


@pytest.mark.parametrize(("text", "want"), [("Стоит ли инвестировать?", True), ("Акции покупать?", False), ("Покупать ли акции?", True), ("Какова выручка?", False), ("Should I buy?", True)])
def test_advice(spark, text, want):
    assert one(spark, text, X.is_advice_request) is want


@pytest.mark.parametrize(("text", "want"), [("Рекомендую купить", True), ("не рекомендую купить", False), ("хороший момент для входа", True), ("Выручка выросла", False), ("однозначно да", True)])
def test_verdict(spark, text, want):
    assert one(spark, text, X.has_verdict) is want


@pytest.mark.parametrize(("text", "want"), [('```json\n{"a":1}\n```', '{"a":1}'), ("ряд [1, 2] тут", "[1,2]"), ('вот {"a": [1]} так', "[1]"), ("нет", None), (None, None)])
def test_repair_json(spark, text, want):
    assert one(spark, text, lambda c: X.repair_json(c).cast("string")) == want


def test_small_text_functions(spark):
    assert one(spark, "21 86 90-92", X.page_list) == [21, 86, 90, 91, 92]
    assert one(spark, "abcdef", X.token_estimate) == 2
    assert one(spark, 0x0A0B0C, X.rgb, "int") == [10, 11, 12]
    assert one(spark, "1441,1 по-русски По", X.tokens) == ["1441", "1", "по-русски", "по"]
    assert one(spark, "x", lambda c: X.guarded(c, F.lit(True), F.lit(True), "N", "W")) == "W\n\nx\n\nN"
