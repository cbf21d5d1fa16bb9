"""Record elements of XML, folders, and rows of every file."""

import pytest

from scrubline.sources import readers as r


def pieces(text, size):
    data = text.encode()
    return iter([data[i : i + size] for i in range(0, len(data), size)])


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize(
    "text,tag",
    [
        ("<a><row/><row/></a>", "row"),
        ("<?xml version='1.0'?><!-- <x><x> --><!DOCTYPE a><a><h>1</h><rows><row k='>'>1</row><row/></rows></a>", "row"),
        ("<a><rows><cell/><cell/></rows><item/><item/></a>", "item"),
        ("<a><b>one</b><c><![CDATA[<b><b>]]></c></a>", "a"),
        ("<a><p><q/></p><s><q/></s></a>", "a"),
        ("  ", None),
    ],
)
def test_record_tag(text, tag, size):
    assert r.record_tag(pieces(text, size)) == tag


def test_a_long_document_is_not_read_to_its_end():
    def endless():
        yield b"<a><rows>"
        while True:
            yield b"<row>1</row>" * 1000

    assert r.record_tag(endless(), enough=50_000) == "row"


def test_two_layouts_of_xml(spark, tmp_path):
    (tmp_path / "1.xml").write_text("<r1><row id='1'><v>a</v></row><row id='2'><v>b</v></row></r1>")
    (tmp_path / "2.xml").write_text("<r2><item><v>c</v><w>3</w></item><item><v>d</v></item></r2>")
    (tmp_path / "3.xml").write_text("<r1><row id='3'><v>e</v></row><row id='4'/></r1>")
    source = r.read_xml_records(spark, str(tmp_path))
    got = sorted((x["v"] or "", x["id"] or "", x["w"] or "") for x in source.df.collect())
    assert got == [("", "4", ""), ("a", "1", ""), ("b", "2", ""), ("c", "", "3"), ("d", "", ""), ("e", "3", "")]
    assert source.warnings == ["2 layouts (record element): item, row"]
    sizes = {x["file_name"]: x["row_count"] for x in r.file_metadata(spark, str(tmp_path), "xml").collect()}
    assert sizes == {"1.xml": 2, "2.xml": 2, "3.xml": 2}


def test_a_folder_of_several_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "b.jsonl").write_text('{"k": "3", "w": "z"}\n')
    (tmp_path / "c.pdf").write_text("%PDF")
    (tmp_path / "_hidden.csv").write_text("q\n9\n")
    spark.createDataFrame([(4, "p")], "k long, v string").coalesce(1).write.parquet(str(tmp_path / "d"))
    source = r.read_any(spark, str(tmp_path))
    got = sorted((x["k"], x["v"] or "", x["w"] or "") for x in source.df.collect())
    assert got == [("1", "x", ""), ("2", "y", ""), ("3", "", "z"), ("4", "p", "")]
    assert source.format == "csv+json+parquet" and source.warnings == ["1 files of other types"]
    with pytest.raises(ValueError):
        r.read_any(spark, str(tmp_path / "c.pdf"))


@pytest.mark.parametrize("encoding", ["UTF-8", "windows-1252"])
def test_lines_longer_than_the_header_are_found_among_short_ones(spark, tmp_path, encoding):
    lines = ["a,b,c", "1", "1,2", "é,2,3", "1,2,3,4", "1,2,3,4,5", '"x,y",2,3', '"x,y",é,"3",4', ",,,,é", "1,2,3,", '"a ""b""",2,3,4,,6', "", "1,2,,"]
    (tmp_path / "t.csv").write_bytes(("\n".join(lines) + "\n").encode(encoding))
    source = r.read_delimited(spark, str(tmp_path), encoding=encoding)
    cells = ["a", "b", "c", r.LINE]
    before = r._read_csv(spark, str(tmp_path), ["a", "b", "c"], ",", encoding, line=True).where(f"{r.EXTRA} is not null")
    got = sorted(tuple(x) for x in source.rejected.select(cells).collect())
    assert [x[:3] for x in got] == sorted(tuple(x) for x in before.select(cells[:3]).collect())
    assert ("1", "2", "3", "1,2,3,4") in got and ("x,y", "é", "3", '"x,y",é,3,4') in got and len(got) == 4
    assert source.df.where("a = '1' and b is null and c is null").count() == 1
    # the reader of whole files fails once for every missing cell of a short row
    assert "FileScan csv" not in source.rejected._jdf.queryExecution().toString()
