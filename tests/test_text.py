"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tallymart.functions import markup as M
from tallymart.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, units", [("soda 6 pack x 330 cc", 6), ("eggs 12 unidades", 12), ("beer 24 uds", 24), ("box x 4", 4), ("3 candles", 3), ("milk", 1), ("2x1 deal", 2)])
def test_pack_count(spark, text, units):
    assert one(spark, T.pack_count(F.lit(text))) == units


@pytest.mark.parametrize("text, code, units", [("[00123]", "123", None), ("123x6", "123", 6), ("12-3", "12", None), ("abc", None, None), (" 77} ", "77", None)])
def test_barcode(spark, text, code, units):
    got = [one(spark, c) for c in T.barcode(F.lit(text))]
    assert got == [code, units]


@pytest.mark.parametrize("text, price, quantity", [("$1.990", 1990, 1), ("2x1990", None, 2), ("", 0, 1), (" 990 ", 990, 1)])
def test_price_text(spark, text, price, quantity):
    assert one(spark, T.price_text(F.lit(text))) == price
    assert one(spark, T.price_quantity(F.lit(text))) == quantity


@pytest.mark.parametrize("unit, name", [("c.c,", "cc"), ("lts.", "lt"), ("grms", "gr"), ("kilos", "kg"), ("metro", "mt"), ("watts", "w"), ("zz", "zz")])
def test_unit_name(spark, unit, name):
    assert one(spark, T.unit_name(F.lit(unit))) == name


@pytest.mark.parametrize("q, u, expected", [(1.5, "lt", (1500.0, "cc")), (6.0, "lt", (6.0, "lt")), (2.0, "kg", (2000.0, "gr")), (1.0, "galon", (3785.411784, "cc")), (3.0, "cl", (30.0, "cc")), (0.0, "x", (0.0, "x"))])
def test_scaled(spark, q, u, expected):
    assert tuple(one(spark, c) for c in T.scaled(F.lit(q), F.lit(u))) == expected


@pytest.mark.parametrize("text, value", [("ale 4.5° amber", 4.5), ("ale 5° 6°", 6.0), ("ale x°", None), ("ale", None)])
def test_degrees(spark, text, value):
    assert one(spark, T.degrees(F.lit(text))) == value


def test_number_and_measure(spark):
    assert [one(spark, T.number(F.lit(t))) for t in ("1,5", " ", "x", "2.25")] == [1.5, 0.0, 1.0, 2.25]
    assert [one(spark, c) for c in T.measure(F.lit("juice 1 lt 500 ml"), ("ml", "lt"))] == ["500", "ml"]
    assert [one(spark, c) for c in T.measure(F.lit("juice"), ("ml", "lt"))] == ["", ""]


def test_cleaning(spark):
    assert one(spark, T.tidied(F.lit(":! pack red  box, 1.5 -"))) == "red box 1 5"
    assert one(spark, T.slug(F.lit("Ñandú de/Año_1"))) == "nandu-de-ano-1"
    assert one(spark, T.split_digits(F.lit("500gr 12pack"))) == "500 gr 12 pack"
    assert one(spark, T.degree_points(F.lit("4,5° gl"))) == "4.5°"
    assert one(spark, T.replaced(F.lit("a bb c"), [("bb", "d"), ("c", None)])) == "a d "
    assert [one(spark, c) for c in T.padded_phrases(F.lit("red box of tin"), ["tin", "box of", "blue"])] == ["tin box of", " red"]
    assert one(spark, T.size_name(F.lit("talla s/m"))) == "talla p-m" and one(spark, T.size_name(F.lit("s/m"))) == "s-m"
    assert one(spark, T.weight_range(F.lit("cat 3 a 5 kg"))) == "3 a 5 kg"


def test_similarity(spark):
    assert one(spark, T.similarity(F.lit("red ring"), F.lit("Ring, red"))) == 100
    assert one(spark, T.similarity(F.lit("red ring"), F.lit("red rink"))) == 88


SHAPES = {
    '{"@type":"Product","name":"a","offers":[{"price":"10"}]}': "10",
    '{"@type":"Product","name":"a","offers":{"price":"11"}}': "11",
    '{"@type":"Product","name":"a","offers":{"@type":"AggregateOffer","offers":[{"price":12}]}}': "12",
    '{"@graph":[{"@type":"BreadcrumbList"},{"@type":"Product","name":"a","offers":{"price":13}}]}': "13",
    '{"@type":"ItemList"}': None,
    '[{"@type":"Product"}]': None,
    '{"@type":"Product","name":': None,
}


@pytest.mark.parametrize("json, price", SHAPES.items())
def test_product_shapes(spark, json, price):
    node = M.product_node(F.lit(json))
    assert one(spark, M.product_fields(node)[4]) == price


def test_markup(spark):
    html = F.lit('<title>a &amp; b</title><meta property="og:title" content="c"><div class="x y">1 <b>2</b></div><div>3</div><a href="/u">t</a>')
    assert one(spark, M.unescaped(M.tag_text(html, "title"))) == "a & b"
    assert one(spark, M.meta(html, "og:title")) == "c"
    assert one(spark, M.selected("div", "x")(html)) == "1 2"
    assert one(spark, M.selected("div")(html)) == "3"
    assert one(spark, M.selected("p")(html)) is None
    assert one(spark, M.links(html)) == ["/u"]
    assert one(spark, M.with_fallbacks(F.lit(" "), F.lit(None).cast("string"), F.lit("z"))) == "z"
