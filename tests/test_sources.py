"""Files written here, read back in the normalised schema."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricelake.sources import delimited, discovery, markup, sheets
from pricelake.sources.delimited import Dialect
from pricelake.sources.dialects import DIALECTS

HEADER = ["NAZIV PROIZVODA", "ŠIFRA PROIZVODA", "MALOPRODAJNA CIJENA", "BARKOD", "Price"]
ROWS = [["Čokolada, tamna", "17", "1.234,56", "3850012345678", ""], ["Šećer", "18", "", "123;456", "2,50"]]


@pytest.mark.parametrize("delimiter", [",", ";", "\t"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "windows-1250"])
def test_delimited(spark, tmp_path, delimiter, encoding):
    quote = lambda c: f'"{c}"' if any(d in c for d in ",;\t") else c
    lines = [delimiter.join(map(quote, r)) for r in [HEADER, *ROWS]]
    (tmp_path / "store,0019,x.csv").write_bytes("\r\n".join(lines).encode(encoding) + b"\r\n\r\n")
    dialect = Dialect("konzum", DIALECTS["konzum"].columns, store_patterns=(r",(\d{4}),",))
    got = delimited.read_delimited(spark, str(tmp_path), dialect).orderBy("row_number").collect()
    assert [(r["store_identifier"], r["name"], r["external_id"], r["price"], r["barcodes"]) for r in got] == [
        ("0019", "Čokolada, tamna", "17", 123456, ["3850012345678"]), ("0019", "Šećer", "18", 250, ["123", "456"]),
    ]


def test_empty_and_doubled_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('NAZIV,MPC\n"say ""hi"", now",1\n\n,\n')
    (tmp_path / "b.csv").write_text("")
    got = delimited.read_delimited(spark, str(tmp_path), DIALECTS["metro"]).collect()
    assert [(r["name"], r["price"], r["store_identifier"]) for r in got] == [('say "hi", now', 100, "a")]


def test_markup(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        '<?xml version="1.0" encoding="UTF-8"?><a><!-- <Proizvod/> --><Proizvod sifra="1"><naziv>Kruh</naziv><mpc>9,99</mpc><b>1</b><b>2</b></Proizvod>'
        "<Proizvod sifra='2'><naziv>Sol &amp; papar</naziv><mpc></mpc><akcija>1,00</akcija></Proizvod></a>"
    )
    paths = {"name": ("naziv",), "external_id": ("@sifra",), "price": ("mpc", "akcija"), "barcodes": ("b",)}
    got = markup.read_markup(spark, str(tmp_path), Dialect("x", paths)).orderBy("row_number").collect()
    assert [(r["external_id"], r["name"], r["price"], r["barcodes"]) for r in got] == [("1", "Kruh", 999, ["1", "2"]), ("2", "Sol & papar", 100, [])]


def workbook(rows):
    cells = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{"ABCDEFG"[j]}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows, 1)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_workbook_and_archive(spark):
    book = workbook([["title"], [], ["a", "", "c"]])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x/one.csv", "a,b")
        z.writestr("../evil.csv", "no")
        z.writestr("__MACOSX/one.csv", "no")
        z.writestr("pic.png", "no")
    files = spark.createDataFrame([("b.xlsx", bytearray(book)), ("z.zip", bytearray(out.getvalue())), ("broken", bytearray(b"x"))], "path string, content binary")
    read = sheets.workbook_cells(files.where("path <> 'z.zip'")).collect()
    assert [(r["row_number"], r["cells"]) for r in read if not r["error"]] == [(1, ["title"]), (3, ["a", "", "c"])] and [r["file"] for r in read if r["error"]] == ["broken"]
    members = sheets.archive_members(files.where("path <> 'b.xlsx'")).collect()
    assert [(r["archive"], r["member"], r["file_type"], r["bytes"]) for r in members if not r["error"]] == [("z.zip", "x/one.csv", "csv", 3)]
    assert [(r["archive"], r["member"], r["content"]) for r in members if r["error"]] == [("z.zip", "../evil.csv", None), ("broken", None, None)]
    twice = files.union(files)
    assert sheets.new_files(twice, files.where("path = 'broken'").select(F.sha2("content", 256).alias("checksum"))).count() == 2
    assert sheets.archived(files.limit(1), "dm", "2024-01-15").first()["archive_key"] == "archives/dm/2024/01/15/b.xlsx"


CHAIN_FILES = {
    "konzum": ("SUPERMARKET,ILICA 1,0204,x.csv", "0204", {}),
    "lidl": ("Lidl_2024-01-15_42.csv", "42", {}),
    "plodine": ("SUPERMARKET_ULICA_1_51000_RIJEKA_007_3.csv", "007", {"anchor_price": "Sidrena cijena na 2.5.2025"}),
    "interspar": ("spar_zagreb_8701_x.csv", "8701", {}),
    "kaufland": ("Hipermarket_Ulica_1_10000_Zagreb_1234_20240115_x.csv", "1234", {}),
    "eurospin": ("diskontna_prodavaonica-310012-Ulica.csv", "310012", {}),
    "ktc": ("TRGOVINA-ULICA 1-PJ5A-1-20240115-071500.csv", "PJ5A-1", {}),
    "metro": ("cash_carry_METRO_20240115T0630_S12_Ulica.csv", "12", {"anchor_price": "SIDRENA_02_05"}),
}


@pytest.mark.parametrize("chain", sorted(CHAIN_FILES))
def test_headers_of_each_chain(spark, tmp_path, chain):
    name, store, dated = CHAIN_FILES[chain]
    dialect = DIALECTS[chain]
    values = {"external_id": "17", "name": "Šećer", "category": "K", "brand": "B", "unit": "kg", "unit_quantity": "1", "price": "2,50", "discount_price": "1,99", "barcodes": "3850012345678",
              "unit_price": "2,50", "lowest_price_30d": "2,10", "anchor_price": "2,40"}
    values = {f: v for f, v in values.items() if f in dialect.columns}
    for layout in (0, -1):  # the source's own headers, and those of its alternative layout
        headers = [dated.get(f, dialect.columns[f][0]) if not layout else dialect.columns[f][-1] for f in values]
        quote = lambda c: f'"{c}"' if dialect.delimiter in c else c
        folder = tmp_path / str(layout)
        folder.mkdir()
        lines = [dialect.delimiter.join(map(quote, line)) for line in (headers, values.values())]
        (folder / name).write_bytes("\r\n".join(lines).encode(dialect.encoding))
        row = delimited.read_delimited(spark, str(folder), dialect).first()
        assert (row["store_identifier"], row["name"], row["external_id"], row["price"], row["discount_price"], row["unit_price"], row["lowest_price_30d"]) == (store, "Šećer", "17", 250, 199, 250, 210)
        assert row["barcodes"] == ["3850012345678"] and row["category"] == "K" and row["brand"] == "B" and row["unit_quantity"] == "1"
        assert row["anchor_price"] == (240 if "anchor_price" in values else None)
        assert delimited.missing_columns(delimited.read_files(spark, str(folder)), dialect).count() == 0
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / name).write_text(f"a{dialect.delimiter}b\n1{dialect.delimiter}2\n")
    assert sorted(r["field"] for r in delimited.missing_columns(delimited.read_files(spark, str(tmp_path / "other")), dialect).collect()) == ["name", "price"]
    (row,) = delimited.read_delimited(spark, str(tmp_path / "other"), dialect).collect()
    assert row["error"] == "no column for name, price" and row["name"] is None and row["row_number"] is None and row["store_identifier"] == store


def test_lidl_store_names(spark):
    names = {"Lidl_Poslovnica_Zagreb_Ilica.csv": "Zagreb_Ilica", "lidl-7.csv": "7", "Supermarket 265_Ulica_13_40323_Prelog_1_16.12.2025_7.15h.csv": "Supermarket 265", "other.csv": "other"}
    rows = spark.createDataFrame([(f"file:/x/{n.replace(' ', '%20')}", s) for n, s in names.items()], "f string, s string")
    assert all(r[0] == r[1] for r in rows.select(delimited.store_of(F.col("f"), DIALECTS["lidl"]), "s").collect())


def test_markup_chains(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "t").mkdir()
    (tmp_path / "s" / "SUPERMARKET-Ulica_1-T598-230-2024-01-15.xml").write_text(
        "<Proizvodi><Proizvod><Poslovnica><Id>T9</Id></Poslovnica><Sifra>4</Sifra><Naziv>Kruh</Naziv><Cijena>1,20</Cijena><Barkod>123</Barkod></Proizvod></Proizvodi>"
    )
    (tmp_path / "s" / "x-T12-y.xml").write_text("<products><product><code>5</code><name>Mlijeko</name><price>0.99</price><anchor_price>1.05</anchor_price></product></products>")
    got = {r["external_id"]: r for r in markup.read_markup(spark, str(tmp_path / "s"), DIALECTS["studenac"]).collect()}
    assert (got["4"]["store_identifier"], got["4"]["name"], got["4"]["price"], got["4"]["barcodes"]) == ("T9", "Kruh", 120, ["123"])
    assert (got["5"]["store_identifier"], got["5"]["price"], got["5"]["anchor_price"]) == ("12", 99, 105)
    (tmp_path / "t" / "SUPERMARKET_A_P220_1.xml").write_text(
        "<DocumentElement><cjenik><sif_art>1</sif_art><naziv_art>Sol</naziv_art><mpc></mpc><mpc_pop>0,80</mpc_pop><ean_kod>9</ean_kod><c_najniza_30>0,70</c_najniza_30><c_020525>0,75</c_020525></cjenik></DocumentElement>"
    )
    row = markup.read_markup(spark, str(tmp_path / "t"), DIALECTS["trgocentar"]).first()
    assert (row["store_identifier"], row["name"], row["price"], row["discount_price"], row["lowest_price_30d"], row["anchor_price"]) == ("220", "Sol", 80, 80, 70, 75)


def test_workbook_chain(spark):
    web = workbook([["Cjenik"], [], ["naziv", "šifra"], ["Sapun", "77", "Marka", "385", "K", "100"]])
    local = workbook([["Šifra", "Naziv", "Cijena", "Akcija", "EAN"], ["8", "Krema", "3,49", "2,99", "12"]])
    wide = workbook([["t"], [], ["h"], ["Gel", "9", "B", "1", "K", "1"]])
    files = spark.createDataFrame([("web.xlsx", bytearray(web)), ("local.xlsx", bytearray(local)), ("wide.xlsx", bytearray(wide))], "path string, content binary")
    got = {r["name"]: r for r in sheets.normalised(files, DIALECTS["dm"]).collect()}
    assert set(got) == {"Sapun", "Krema", "Gel"} and (got["Sapun"]["external_id"], got["Sapun"]["brand"], got["Sapun"]["barcodes"]) == ("77", "Marka", ["385"])
    assert (got["Krema"]["price"], got["Krema"]["discount_price"], got["Krema"]["barcodes"]) == (349, 299, ["12"])
    assert {r["store_identifier"] for r in got.values()} == {"dm_national"}
    broken = spark.createDataFrame([("x.xlsx", bytearray(b"no")), ("none.xlsx", None)], "path string, content binary")
    assert [(r["error"] is not None, r["name"], r["row_number"]) for r in sheets.normalised(broken, DIALECTS["dm"]).collect()] == [(True, None, None)] * 2


def test_workbook_source(spark, tmp_path):
    from pricelake.sources import workbooks

    books = {f"in/{i}.xlsx": workbook([["a", str(i)], [], ["", "b"]]) for i in range(3)} | {"in/deep/big.XLSX": workbook([[f"r{i}", "x"] for i in range(10_000)]), "in/broken.xlsx": b"x", "in/no.txt": b"x"}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in books.items()], "path string, content binary")
    assert workbooks.written_files(files, str(tmp_path)) == 6 and workbooks.written_files(files, f"file:{tmp_path}") == 6
    got = workbooks.read_workbooks(spark, f"{tmp_path}/in", partition_bytes=1)
    assert got.rdd.getNumPartitions() == 5
    rows = {}
    for r in got.collect():
        rows.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["row_number"], r["cells"], r["error"] is not None))
    assert rows["1.xlsx"] == [(1, ["a", "1"], False), (3, ["", "b"], False)] and rows["broken.xlsx"] == [(None, None, True)]
    assert rows["big.XLSX"] == [(i + 1, [f"r{i}", "x"], False) for i in range(10_000)] and len(rows) == 5
    one = workbooks.read_workbooks(spark, f"{tmp_path}/in/2.xlsx", sheet=0)
    assert [r["row_number"] for r in one.collect()] == [1, 3]
    assert all(r["error"] and r["cells"] is None for r in workbooks.read_workbooks(spark, f"{tmp_path}/in", sheet="none").collect())
    with pytest.raises(Exception, match="nowhere"):
        workbooks.read_workbooks(spark, f"{tmp_path}/nowhere").collect()
    (tmp_path / "empty").mkdir()
    assert workbooks.read_workbooks(spark, f"{tmp_path}/empty").count() == 0


def test_discovery(spark):
    html = """<a href="/d/one.csv">x</a> <A class=k HREF='two.XML?v=1'>y</A> <a href="http://o.example/t.zip">z</a> <a href="about.html">n</a> <a href="/d/one.csv">again</a>"""
    pages = spark.createDataFrame([(1, "https://shop.example/lists/index.html", html)], "page_id int, url string, html string")
    got = sorted((r["file_url"], r["file_type"]) for r in discovery.discovered_files(pages).collect())
    assert got == [("http://o.example/t.zip", "zip"), ("https://shop.example/d/one.csv", "csv"), ("https://shop.example/lists/two.XML?v=1", "xml")]


def test_streams(spark, tmp_path):
    from pricelake.streaming import ingest

    rows = [(i, datetime(2024, 1, 1 + i % 3, i % 24), i % 4, "purchase" if i % 2 else "error", float(i), str(i % 10)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, checksum string")
    events.write.parquet(str(tmp_path / "in"))

    def run(make, mode, name):
        stream = make(ingest.read_events(spark, str(tmp_path / "in"), events.schema))
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    assert run(ingest.first_of_each, "append", "firsts").count() == 10
    got = {(r["window"]["start"], r["event_type"]): r["n"] for r in run(ingest.tumbling, "complete", "days").collect()}
    want = {(r["window"]["start"], r["event_type"]): r["count"] for r in events.groupBy(F.window("ts", "1 day"), "event_type").count().collect()}
    assert got == want
    query = ingest.write_snapshots(ingest.read_events(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "snap"), str(tmp_path / "cp"), ["user_id"], "event_id")
    query.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "snap" / "0")).collect()) == [56, 57, 58, 59]
    later = [(58, datetime(2024, 1, 2), 3, "late", 0.0, "a"), (90, datetime(2024, 1, 2), 0, "new", 0.0, "a"), (5, datetime(2024, 1, 2), 7, "first", 0.0, "a")]
    spark.createDataFrame(later, events.schema).write.mode("append").parquet(str(tmp_path / "in"))
    query = ingest.write_snapshots(ingest.read_events(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "snap"), str(tmp_path / "cp"), ["user_id"], "event_id")
    query.awaitTermination(120)
    got = {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(tmp_path / "snap" / "1")).collect()}
    assert got == {0: 90, 1: 57, 2: 58, 3: 59, 7: 5}
    slid = {(r["window"]["start"], r["runs"]) for r in run(ingest.sliding, "complete", "slid").collect()}
    assert slid == {(r["window"]["start"], r["count"]) for r in spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "24 hours", "1 hour")).count().collect()}
