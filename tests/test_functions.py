"""Tables of inputs and results for the scalar functions."""

import pytest
from pyspark.sql import functions as F

from pricelake.functions import codes, money, text


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_parse_price(spark):
    cases = {
        "1.234,56": 123456, "123,45": 12345, "123.45": 12345, "100": 10000, "": None, "1,234": 123, "1.234": 123, "€ 12,50": 1250, "99,90 kn": 9990,
        "1 299,00 kn": 129900, "1 299,00": 129900, "12,5abc": 1250, "abc": None, "0,005": 1, "-3,10": -310, "1,234.56": 123456,
    }
    assert column(spark, list(cases), money.parse_price) == list(cases.values())


def test_parse_price_strict(spark):
    assert column(spark, ["12,50", "12,5x", "1 000,25", "", None], money.parse_price_strict) == [1250, None, 100025, None, None]


def test_dates(spark):
    made = column(spark, ["2024-01-15", "15.01.2024", "15.1.2024", "nonsense", None, "2024-01-15 10:20:30"], lambda c: F.date_format(money.parse_date(c), "yyyy-MM-dd HH"))
    assert made == ["2024-01-15 00", "2024-01-15 00", "2024-01-15 00", None, None, "2024-01-15 10"]
    made = column(spark, ["59", "61", "45306", "2024-01-15", "15.1.2024", "x"], lambda c: F.date_format(money.parse_sheet_date(c), "yyyy-MM-dd"))
    assert made == ["1900-02-28", "1900-03-01", "2024-01-15", "2024-01-15", "2024-01-15", None]


def test_barcodes(spark):
    cases = {
        "3850012345678": "3850012345678", "385-001-234-5678": "3850012345678", "0000000000000": "", "2123456789012": "", "3850012345679": "", "12345": "12345", "": "",
    }
    assert column(spark, list(cases), codes.normalize_barcode) == list(cases.values())
    assert column(spark, ["123456789012"], codes.normalize_barcode) == ["0123456789012"]
    assert column(spark, ["3850012345678", "3850012345679", "1234567890128", "123"], codes.check_digit_ok) == [True, False, True, False]
    assert column(spark, ["a, b;c|", None], codes.barcode_list) == [["a", "b", "c"], []]


def test_text(spark):
    assert column(spark, ["Čokolada", "Đumbir", "Mixed ČŠŽĐĆ", "garçon", None], text.remove_diacritics) == ["Cokolada", "Djumbir", "Mixed CSZDjC", "garcon", None]
    rows = spark.createDataFrame([("l", "1"), ("ml", "1000"), ("g", "1000"), ("pcs", "5"), ("kg", ""), ("g", "1500"), ("ml", "250")], "u string, q string")
    assert [r[0] for r in rows.select(text.normalize_unit(F.col("u"), F.col("q"))).collect()] == ["1l", "1l", "1kg", "5kom", "kg", "1.5kg", "250ml"]
    rows = spark.createDataFrame([("Čokolada", "Kras", "Slastice", "100g"), ("Čokolada", "n/a", "", None)], "n string, b string, c string, u string")
    made = [r[0] for r in rows.select(text.embedding_text(*map(F.col, "nbcu"))).collect()]
    assert made == ["cokolada kras slastice 100g", "cokolada"]
    assert column(spark, ["ab", "abcdefgh"], text.masked) == ["ab", "abcd****"]
    assert column(spark, [0, 61, 62], lambda c: text.base62(c), "long") == ["000000", "00000z", "000010"]


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abd", 0.5), ("cokolada", "cokoleta", 0.625), ("", "", 1.0), ("", "test", 0.0)])
def test_jaccard(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(codes.jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("encoding", ["windows-1250", "iso-8859-2"])
def test_encodings_without_a_setting(spark, encoding):
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    every = bytes(range(256))
    (got,) = column(spark, [every], lambda c: text.decoded_bytes(c, encoding), "binary")
    assert got == every.decode(encoding, "replace")
    assert column(spark, ["Šećer", "žž 1", "", None, "Àx嗨😀"], lambda c: text.encoded_bytes(c, encoding)) == [*(bytearray(t.encode(encoding)) for t in ("Šećer", "žž 1", "")), None, bytearray(b"?x??")]
    with pytest.raises(ValueError):
        text.decoded_bytes(F.col("v"), "utf-16")


def test_distances(spark):
    cases = [((45, 16, 45, 16), 0), ((90, 0, -90, 0), 20015), ((0, 179, 0, -179), 222), ((45, 16, 45.1, 16.1), 13.6)]
    for at, want in cases:
        got = spark.range(1).select(codes.haversine_km(*[F.lit(float(x)) for x in at])).first()[0]
        assert got == pytest.approx(want, rel=0.1, abs=0.01)


def test_bins_and_prices(spark):
    assert column(spark, [1.0, 0.95, 0.9, 0.85, 0.8, 0.79, 0.0], money.coverage_bin, "double") == [4, 3, 3, 2, 2, 1, 1]
    rows = spark.createDataFrame([(100, None), (100, 80), (100, 120), (100, 0)], "p long, d long")
    assert [r[0] for r in rows.select(money.effective_price(F.col("p"), F.col("d"))).collect()] == [100, 80, 100, 100]


def test_similarities(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    got = row.select(*[codes.cosine(F.col("a"), F.col(c)) for c in "abzs"]).first()
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(2**-0.5) and got[2] == 0 and got[3] == 0
    assert spark.range(1).select(codes.trigram_similarity(F.lit("word"), F.lit("words"))).first()[0] == pytest.approx(4 / 7)
