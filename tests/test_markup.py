"""XML of any layout: paths, trees, broken files."""

import json

import pytest

from pricelake.sources import markup


def items(spark, text, **how):
    raw = text if isinstance(text, bytes) else text.encode()
    return markup.items(spark.createDataFrame([("f.xml", bytearray(raw))], "path string, content binary"), **how).orderBy("at").collect()


@pytest.mark.parametrize(
    ("text", "path", "n"),
    [
        ("<products><product/><product/></products>", "products.product", 2),
        ("<PRODUCTS><x/><x/><pRoduct>a</pRoduct></PRODUCTS>", "products.product", 1),
        ("<r><head/><b><c/><c/></b><a/><a/></r>", "r.a", 2),
        ("<r><b/><a/><a/><b/></r>", "r.b", 2),
        ("<r><b><c/><c/></b></r>", None, 0),
        ("<n:data xmlns:n='u'><n:product n:k='1'/></n:data>", "data.product", 1),
    ],
)
def test_paths(spark, text, path, n):
    got = items(spark, text)
    if path is None:
        assert got[0]["error"] and got[0]["item"] is None and len(got) == 1
    else:
        assert [r["items_path"] for r in got] == [path] * n and [r["at"] for r in got] == list(range(n))


def test_trees(spark):
    text = """<a><p k="x>y&lt;"> one <![CDATA[ <two> ]]><q/><!-- no --> three <p><p>in</p></p><z i="1">t</z><z>u</z></p><p/></a>"""
    first, second = items(spark, text)
    assert json.loads(first["item"]) == {"@_k": "x>y<", "q": {}, "p": {"p": {"#text": "in"}}, "z": [{"@_i": "1", "#text": "t"}, {"#text": "u"}], "#text": "one<two>three"}
    assert first["fields"] == {"@_k": ["x>y<"], "q": [""], "p": ["in"], "p.p": ["in"], "z": ["t", "u"], "z.@_i": ["1"], "#text": ["one<two>three"]}
    assert json.loads(second["item"]) == {} and second["fields"] == {}


def test_tags_and_set_paths(spark):
    text = "<r><deep><Item>1<Item>2</Item></Item></deep><item>3</item></r>"
    assert [r["fields"]["#text"][0] for r in items(spark, text, tags=("none", "Item"))] == ["1"]
    assert [r["fields"]["#text"][0] for r in items(spark, text, path="R.Deep.item")] == ["1"]
    assert items(spark, text, path="r.none")[0]["error"] and items(spark, text, tags=("none",))[0]["error"]


@pytest.mark.parametrize("text", [b"", b"<a>", b"plain", b"<a></b>", b'<!DOCTYPE a [<!ENTITY x "y">]><a><p>&x;</p><p/></a>', b"\xff\xfe\x00"])
def test_broken_files(spark, text):
    (row,) = items(spark, text)
    assert row["error"] and row["file"] == "f.xml" and row["item"] is None


def test_encodings_and_long_files(spark):
    for encoding, named in (("iso-8859-2", "ISO-8859-2"), ("windows-1250", "windows-1250"), ("utf-8", "iso-8859-2"), ("utf-8-sig", "utf-8")):
        text = f'<?xml version="1.0" encoding="{named}"?><r><p>Šećer ž</p><p/></r>'
        assert items(spark, text.encode(encoding))[0]["fields"]["#text"] == ["Šećer ž"]
    many = "<r>" + "".join(f"<p><n>{i} č</n></p>" for i in range(120_000)) + "</r>"
    got = items(spark, many)
    assert len(got) == 120_000 and got[119_999]["fields"]["n"] == ["119999 č"]
