"""Scalar functions against hand-derived values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import amounts, coerce, fuzzy, geometry, rules, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("given_", "hp"),
    [("HP....28", 28), ("300 HP 45 HP", 45), ("4050HP", 50), ("php 12", 12), ("250 HP", None), ("हा.पा. 45", 45), ("४५ HP", 45), ("Horse Power: 55", 55), ("", None), (None, None)],
)
def test_extract_hp(spark, given_, hp):
    assert one(spark, given_, amounts.extract_hp) == hp


@pytest.mark.parametrize(
    ("given_", "amount"),
    [("Rs. 7,00,000/-", 700000), ("-500", 500), ("1.234.567", 1), ("No.5 Rs.700", None), ("₹8,01,815.00", 801815), ("रु.6,50,000/-", 650000), ("abc", None), ("0", None)],
)
def test_extract_amount(spark, given_, amount):
    assert one(spark, given_, amounts.extract_amount) == amount


@pytest.mark.parametrize(
    ("given_", "found"),
    [("7,00,000 8,01,815.00", [801815, 700000]), ("700000", []), ("45 700,000", [45700000]), ("12345,678", []), ("7,00,0000", [])],
)
def test_extract_all_amounts(spark, given_, found):
    assert one(spark, given_, amounts.extract_all_amounts) == found


@pytest.mark.parametrize(
    ("given_", "name"), [("AMS TRACTORS PVT. LTD.", "Ams Tractors "), ("MK.MOTORS", "Mk. Motors"), ("dealer's 3cyl", "Dealer'S 3Cyl")]
)
def test_dealer_name(spark, given_, name):
    assert one(spark, given_, text.normalise_dealer_name) == name


@pytest.mark.parametrize(("given_", "key"), [("Maan Tractor Co.", "maan tractor ."), ("Krishna Traders", "krishna"), (None, ""), ("Traders", "")])
def test_match_key(spark, given_, key):
    assert one(spark, given_, text.match_key) == key


def test_model_name_drops_marks(spark):
    # combining vowel signs are not word characters
    assert one(spark, "हिन्दी  a*b", text.normalise_model_name) == "हनद AB"


def test_clean_text_composes(spark):
    assert one(spark, " é  १२ x ", text.clean_text) == "é 12 x"


def test_noise(spark):
    assert one(spark, "aaaaaa b # c", text.remove_noise) == "b c"


@pytest.mark.parametrize(("given_", "n"), [("45.0", 450), ("7,00,000.00", 70000000), ("-5", 5), ("rs 5", None), ("Rs 5", 5), ("N/A", None), ("7d", None), (None, None)])
def test_coerce_int(spark, given_, n):
    assert one(spark, given_, coerce.coerce_int) == n


@pytest.mark.parametrize(("given_", "s"), [(" null ", "null"), ("null", None), ("  ", ""), ("", None), (" a ", "a")])
def test_coerce_str(spark, given_, s):
    assert one(spark, given_, coerce.coerce_str) == s


@pytest.mark.parametrize(("given_", "b"), [("Present", True), ("maybe", None), ("not present", False), (None, None)])
def test_coerce_bool(spark, given_, b):
    assert one(spark, given_, coerce.coerce_bool) is b


@pytest.mark.parametrize(
    ("raw", "hp"), [('{"horse_power": 45}', 45), ('```json\n{"horse_power": "45"}\n```', 45), ('Here: {"horse_power": 45} ok', 45), ("[1]", None), ("nothing", None), ('{"horse_power": 45}}', None), ("", None), (None, None)]
)
def test_parse_json(spark, raw, hp):
    assert one(spark, raw, lambda c: coerce.coerce_fields(coerce.parse_json(c))["horse_power"]) == hp


def test_iou(spark):
    row = spark.sql("select array(0,0,10,10) a, array(5,0,15,10) b, array(20,20,30,30) c")
    got = row.select(geometry.iou(F.col("a"), F.col("b")), geometry.iou(F.col("a"), F.col("c")), geometry.iou(F.col("a"), F.col("a"))).first()
    assert got[0] == pytest.approx(1 / 3) and got[1] == 0 and got[2] == 1


def test_denormalise(spark):
    row = spark.sql("select array(100d,200d,300d,400d) b, array(1d,2d) short")
    got = row.select(geometry.denormalise(F.col("b"), F.lit(500), F.lit(1000)), geometry.denormalise(F.col("short"), F.lit(500), F.lit(1000))).first()
    assert list(got[0]) == [100, 100, 200, 300] and got[1] is None


@pytest.mark.parametrize(("value", "shown"), [(12345678, "₹1.23 Cr"), (150000, "₹1.5 L"), (99999, "₹99,999"), (None, "—")])
def test_rupees(spark, value, shown):
    assert one(spark, value, rules.format_rupees, "long") == shown


def test_currency_keeps_its_scale(spark):
    assert one(spark, 1106506, rules.format_currency, "long") == "₹ 1.11L  (1,106,506)"


@pytest.mark.parametrize(("name", "bonus"), [("12", -0.1), ("1234", -0.3), ("Shop", 0.05), (None, 0.0), ("", 0.0)])
def test_name_bonus(spark, name, bonus):
    assert one(spark, name, rules.name_bonus) == bonus


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_properties(a, b):
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)
    assert 0 <= fuzzy.ratio(a, b) <= 100
    assert (fuzzy.ratio(a, b) == 100) == (a == b and a != "")
    assert fuzzy.partial_ratio(a, b) == fuzzy.partial_ratio(b, a)
    assert fuzzy.partial_ratio(a, b) >= (fuzzy.ratio(a, b) if len(a) == len(b) else 0)
    assert 0 <= fuzzy.weighted_ratio(a, b) <= 100


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=10), st.text("abcd", max_size=10))
def test_lcs_equals_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fuzzy._lcs(a, b) == table[-1][-1]


def test_token_scorers():
    assert fuzzy.token_sort_ratio("xt swaraj 742", "swaraj 742 xt") == 100
    assert fuzzy.token_set_ratio("swaraj", "swaraj 742 xt") == 100
    assert fuzzy.partial_ratio("742", "swaraj 742 xt") == 100
    assert fuzzy.ratio("", "") == 0


def test_published_scores():
    """Values that the scorers' public documentation gives for these pairs."""
    from docquarry.functions import fuzzy

    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.55172413793103)
    assert fuzzy.partial_ratio("this is a test", "this is a test!") == 100
    assert fuzzy.ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(90.9090909090909)
    assert fuzzy.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert fuzzy.token_sort_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == pytest.approx(84.21052631578947)
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.weighted_ratio("this is a test", "this is a new test!!!") == pytest.approx(85.5)


def test_shortcuts_for_plain_text_change_nothing(spark):
    """Clean ASCII takes a short way; other texts, digits and spaces take the long one, to the same ends."""
    from docquarry.functions import amounts, text

    said = ["45 HP", "h.\u2003p. 45", "H.\u00a0P. : ४५", "Horse \u2003 Power 60", "हा.पा. ६०", "php 9", "hop 45", "SHP", " 12\t hp", "300 HP 20 h.p", "", None]
    paid = ["Total 3,45,678/-", "Rs. 12\u00a0345", "  1,00,000  ", "२,००,०००", "12 34", "रु. 5,000.50", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string")
    for compose in (True, False):
        assert [r[0] for r in df.orderBy("k").select(amounts.extract_hp(F.col("t"), compose)).collect()] == [45, 45, 45, 60, 60, 9, None, None, 12, 20, None, None]
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(paid)], "k int, t string").orderBy("k").select(amounts.extract_all_amounts(F.col("t"), compose)).collect()
        assert [r[0] for r in rows] == [[345678], [12345], [100000], [200000], [1234], [5000], [], None]
    names = spark.createDataFrame([("shiv agro ÉCLAIR élan 7x ñu-a ", "Shiv Agro Éclair Élan 7X Ñu-A ")], "a string, b string")
    assert names.select(text.title(F.col("a")) == F.col("b")).first()[0]
