"""Feeds, sitemaps, dirty files and documents: round trips and malformed input."""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.sources import delimited, documents, sinks, xml_docs

FEEDS = [
    "<rss><channel><title>C</title><item><title>A &amp; B</title><link>http://x/?a=1&amp;b=2</link><pubDate>d</pubDate></item><item><title><![CDATA[ B <i>c</i> ]]></title><guid isPermaLink='false'>g1</guid></item></channel></rss>",
    "<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><entry><title type='html'>E1</title><link rel='self' href='http://s'/><link href='http://e1'/><id>i</id><updated>u</updated></entry></feed>",
    "<rdf:RDF xmlns:rdf='r' xmlns='p'><channel><title>q</title></channel><item><title>R1</title><link>http://r1</link></item></rdf:RDF>",
    "<urlset xmlns='s'><url><loc> http://l1/?x&amp;y </loc><priority>0.5</priority></url><url><loc>http://l2</loc></url><url><loc> </loc></url></urlset>",
    "<sitemapindex><sitemap><loc>http://m1</loc></sitemap></sitemapindex>",
    "<rss><channel><item><title>broken</item></channel></rss>",
    "",
    None,
    "<html><body/></html>",
    "no markup",
]


def test_xml_documents(spark):
    p = xml_docs.parse(spark.createDataFrame(list(enumerate(FEEDS)), "id int, xml string"), "xml").cache()
    assert [r["kind"] for r in p.orderBy("id").collect()] == ["rss", "atom", "rdf", "sitemap", "sitemap_index", None, None, None, "other", None]
    assert {r["id"]: r["malformed"] for r in p.where("malformed IS NOT NULL").collect()} == {5: FEEDS[5], 9: FEEDS[9]}
    assert [(r["id"], r["pos"], r["title"], r["link"], r["published"]) for r in xml_docs.items(p).orderBy("id", "pos").collect()] == [
        (0, 0, "A & B", "http://x/?a=1&b=2", "d"),
        (0, 1, "B <i>c</i>", "g1", None),
        (1, 0, "E1", "http://e1", "u"),
        (2, 0, "R1", "http://r1", None),
    ]
    assert xml_docs.items(p, 1).count() == 3
    assert [(r["id"], r["loc"], r["priority"], r["nested"]) for r in xml_docs.places(p).orderBy("id", "loc").collect()] == [(3, "http://l1/?x&y", 0.5, False), (3, "http://l2", None, False), (4, "http://m1", None, True)]


def test_large_documents_by_row_tag(spark, tmp_path):
    rows = "".join(f"<item><title>T &lt;{k}&gt;</title>{'<n>x</n>' if k % 10 == 3 else f'<n>{k}</n>'}</item>\n" for k in range(200))
    (tmp_path / "a.xml").write_text(f"<feed>{rows}</feed>")
    got = xml_docs.read_rows(spark, str(tmp_path), "item", "title string, n long, corrupt string")
    assert got.count() == 200 and got.cache().where("corrupt IS NOT NULL").count() == 20
    assert {r["title"] for r in got.where("corrupt IS NULL").collect()} == {f"T <{k}>" for k in range(200) if k % 10 != 3}


def test_sniffing():
    assert delimited.sniff(b"a,b\n1,2\n") == ("UTF-8", ",", ["a", "b"])
    assert delimited.sniff("é;b;c\n1,5;2;3\n2,5;1;1".encode("latin-1")) == ("ISO-8859-1", ";", ["é", "b", "c"])
    assert delimited.sniff(b"\xef\xbb\xbfa\tb\n1\t2") == ("UTF-8", "\t", ["a", "b"])
    assert delimited.sniff(("x,y\n" + "é" * delimited.HEAD).encode()[: delimited.HEAD + 1][: delimited.HEAD])[0] == "UTF-8"
    assert delimited.sniff(("x,yz\n" + "é" * delimited.HEAD).encode()[: delimited.HEAD])[0] == "UTF-8"  # one of the two ends inside a character
    assert delimited.sniff(b"") == ("UTF-8", ",", [])


def test_dirty_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,n\n1,"x, y",5\n2,z\n\n3,q,bad\n4,r,7,extra\n')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.csv").write_bytes("n;id\n8;10\nx;11\n".encode())
    (tmp_path / "c.csv").write_bytes("id;name\n20;é\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_text("")
    got = delimited.read_csv(spark, str(tmp_path), "id long, name string, n int")
    rows = {r["id"]: (r["name"], r["n"], r["malformed"]) for r in got.collect()}
    assert rows == {1: ("x, y", 5, None), 2: ("z", None, "2,z"), 3: ("q", None, "3,q,bad"), 4: ("r", 7, "4,r,7,extra"), 10: (None, 8, None), 11: (None, None, "x;11"), 20: ("é", None, None)}
    assert tuple(delimited.account(got.cache()).first()) == (7, 3, 4)
    (tmp_path / "none").mkdir()
    assert delimited.read_csv(spark, str(tmp_path / "none"), "id long").columns == ["id", "malformed"]


def test_dirty_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2\n{"b": {"c": "x"}}\n')
    (tmp_path / "b.json").write_text('{"a": "text"}\n')
    got = delimited.read_json(spark, str(tmp_path)).cache()
    assert [f.name for f in got.schema] == ["a", "b", "malformed", "file"]
    assert sorted(str(r["a"]) for r in got.where("malformed IS NULL").collect()) == ["1", "None", "text"]
    assert [r["malformed"] for r in got.where("malformed IS NOT NULL").collect()] == ['{"a": 2']
    typed = delimited.read_json(spark, str(tmp_path), "a long").cache()
    assert tuple(delimited.account(typed).first()) == (4, 2, 2)


# ---------------------------------------------------------------- documents
def names(path):
    return sorted(n for n in os.listdir(path) if not n.startswith("."))


def test_graphml(spark, tmp_path):
    path = f"{tmp_path}/g"
    edges = [("a&b", 'c"d', 1), ("c\"d", "<e>", None), ("a&b", "<e>", 2)]
    df = spark.createDataFrame(edges, "src string, dst string, weight int")
    documents.write(df.repartition(2, "dst"), path, "graphml")
    found, ns = set(), "{http://graphml.graphdrawing.org/xmlns}"
    for name in names(path):
        assert name.endswith(".graphml")
        root = ET.parse(f"{path}/{name}").getroot()
        nodes = {n.get("id") for n in root.iter(f"{ns}node")}
        for e in root.iter(f"{ns}edge"):
            assert {e.get("source"), e.get("target")} <= nodes
            w = e.find(f"{ns}data")
            found.add((e.get("source"), e.get("target"), None if w is None else int(w.text)))
    assert found == set(edges)
    documents.write(df.limit(1), path, "graphml")
    assert len(names(path)) == 1  # overwritten
    documents.write(df.limit(1), path, "graphml", "append")
    assert len(names(path)) == 2
    documents.write(df.where("false"), f"{tmp_path}/none", "graphml")
    (name,) = names(f"{tmp_path}/none")
    assert not list(ET.parse(f"{tmp_path}/none/{name}").getroot().iter(f"{ns}edge"))


def test_har(spark, tmp_path):
    path = f"{tmp_path}/h"
    df = spark.range(50).select(F.to_json(F.struct("id", F.lit('é"\n').alias("t"))).alias("entry"))
    documents.write(df.repartition(3), path, "har")
    logs = [json.load(open(f"{path}/{n}", encoding="utf-8"))["log"] for n in names(path)]
    assert {x["version"] for x in logs} == {"1.2"}
    assert sorted(e["id"] for x in logs for e in x["entries"]) == list(range(50)) and all(e["t"] == 'é"\n' for x in logs for e in x["entries"])


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/h"
    good = spark.range(40).select(F.to_json(F.struct("id")).alias("entry")).repartition(4)
    documents.write(good, path, "har")
    before = names(path)
    bad = spark.range(40).select(F.when(F.col("id") == 33, "{no json").otherwise(F.to_json(F.struct("id"))).alias("entry")).repartition(4)
    with pytest.raises(Exception, match="(?i)json|expecting"):
        documents.write(bad, path, "har")
    assert names(path) == before


def test_workbook(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/w"
    rows = [("links", ["href", "n"])] + [("links", [f"http://x/?{k}&<a>", str(k)]) for k in range(5)] + [("summary", ["t\x01", None])]
    documents.write(spark.createDataFrame(rows, "sheet string, cells array<string>").coalesce(1), path, "xlsx")
    (name,) = names(path)
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(f"{path}/{name}") as z:
        assert z.testzip() is None
        book = ET.fromstring(z.read("xl/workbook.xml"))
        assert [s.get("name") for s in book.iter(f"{ns}sheet")] == ["links", "summary"]
        cells = [[c.findtext(f"{ns}is/{ns}t") for c in r.iter(f"{ns}c")] for k in (1, 2) for r in ET.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{ns}row")]
        assert cells == [c for _, c in rows[:-1]] + [["t", None]]
        assert {"[Content_Types].xml", "_rels/.rels", "xl/_rels/workbook.xml.rels"} <= set(z.namelist())


def test_workbook_of_documents(spark, tmp_path):
    merged = spark.createDataFrame(
        [("http://a.example/x", "T", "D", "en", "article", 0.5, [("http://b.example/", "b")], [("/i.png", "alt")], [(1, "H")])],
        "url string, title string, description string, language string, page_type string, confidence_score double, links array<struct<href: string, text: string>>, images array<struct<src: string, alt: string>>, headings array<struct<level: int, text: string>>",
    )
    sinks.write_workbook(merged, f"{tmp_path}/w")
    (name,) = names(f"{tmp_path}/w")
    with zipfile.ZipFile(f"{tmp_path}/w/{name}") as z:
        assert "http://b.example/" in z.read("xl/worksheets/sheet3.xml").decode() and z.read("xl/workbook.xml").decode().count("<sheet ") == 4


def test_more_rows_make_more_documents(spark, tmp_path, monkeypatch):
    from weftline.plans import queries_io
    from weftline.sources import documents

    spark.range(1000).selectExpr("id AS event_id", "'click' AS event_type", "timestamp '2024-01-01' AS ts", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(documents, "DOCUMENT_ROWS", 50, raising=False)
    path = tmp_path / "har"
    monkeypatch.setattr(queries_io.session, "scratch", lambda spark, label: str(path))
    got = queries_io.har_documents(spark, str(tmp_path))
    sizes = [f.read_text().count('"startedDateTime"') for f in path.glob("*.har")]
    assert len(sizes) == 20 and sum(sizes) == 1000 and max(sizes) < 100
    assert sorted(r["event_id"] for r in got.collect()) == list(range(1000))
