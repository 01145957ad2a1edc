"""Shop logs, sequence files made of them, keyed feeds and the manifest."""

import hashlib
import zipfile

import pytest

from seqharvest.sources import archives, logs, qsdb

ROWS = "cust long, basket long, day int, item long, util long"


def test_logs_of_every_text_kind(spark, tmp_path):
    files = {
        "tafeng": "TRANSACTION_DT,CUSTOMER_ID,PRODUCT_ID,SALES_PRICE\n1/2/2001,7,p1,12\n11/30/2001,7,p1,0\n1/3/2001,8,p2,2.5\n",
        "dunnhumby": "household_key,BASKET_ID,DAY,PRODUCT_ID,SALES_VALUE\n7,b1,3,p1,1.39\n7,b1,3,p2,-1\n",
        "hm": "t_dat,customer_id,article_id,price\n2018-09-20,c,a,0.0508\n",
        "valued_shoppers": "id,category,company,brand,date,purchaseamount\n1,2,3,4,2012-03-02,7.59\n",
        "rees46": "event_time,event_type,product_id,price,user_id,user_session\n2019-10-01 00:00:00 UTC,view,p,1,u,s\n2019-10-01 00:00:01 UTC,purchase,p,35.79,u,\n",
    }
    want = {
        "tafeng": [("7", "7|1/2/2001", 11324, "p1", 12), ("8", "8|1/3/2001", 11325, "p2", 2)],
        "dunnhumby": [("7", "b1", 3, "p1", 139)],
        "hm": [("c", "c|2018-09-20", 17794, "a", 50800)],
        "valued_shoppers": [("1", "1|2012-03-02", 15401, "2|3|4", 759)],
        "rees46": [("u", "u|", 18170, "p", 3579)],
    }
    for kind, text in files.items():
        (tmp_path / f"{kind}.csv").write_text(text, encoding="utf-8-sig" if kind == "tafeng" else "utf-8")
        got = logs.read_log(spark, str(tmp_path / f"{kind}.csv"), kind)
        assert sorted(map(tuple, got.collect())) == want[kind], kind
    with pytest.raises(ValueError, match="unknown kind"):
        logs.read_log(spark, str(tmp_path), "other")


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    names = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]
    shared = "".join(f"<si><t>{n}</t></si>" for n in names)
    head = "<row r='1'>" + "".join(f"<c r='{chr(65 + i)}1' t='s'><v>{i}</v></c>" for i in range(8)) + "</row>"

    def sheet(rows):
        body = "".join("<row>" + "".join(f"<c r='{col}9' t='inlineStr'><is><t>{v}</t></is></c>" if isinstance(v, str) else f"<c r='{col}9'><v>{v}</v></c>" for col, v in r.items()) + "</row>" for r in rows)
        return f"<worksheet {ns}><sheetData>{head}{body}</sheetData></worksheet>"

    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet([{"A": "489434", "B": "85048", "D": 12, "E": 40148.32, "F": 6.95, "G": 13085.0}, {"A": "489435", "B": "x", "D": 1, "E": 40149, "F": 1}]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([{"A": "5", "B": "y", "D": 2, "E": 40200.9, "F": 0.5, "G": 17850.0}]))
    got = logs.read_log(spark, str(tmp_path / "book.xlsx"), "online_retail")
    assert sorted(map(tuple, got.collect())) == [("13085", "489434", 40148, "85048", 83400), ("17850", "5", 40200, "y", 1000)]


def test_workbook_of_odd_form(spark, tmp_path):
    """Cells and rows without references, inline and rich strings, a remark above the header, columns in another order, a sheet without a header."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings = f"<sst {ns}><si><t>Price</t></si><si><r><t>Stock</t></r><r><t>Code</t></r><rPh><t>no</t></rPh></si><si><t>x &amp; y</t></si></sst>"
    inline = lambda v: f"<c t='inlineStr'><is><t>{v}</t></is></c>"
    head = "<row>" + inline("Customer ID") + "<c t='s'><v>0</v></c><c t='s'><v>1</v></c>" + "".join(map(inline, ["Invoice", "InvoiceDate", "Quantity"])) + "</row>"
    rows = "<row>" + inline("remark") + "</row>" + head + "<row><c><v>7.0</v></c><c><v>2.5</v></c><c t='s'><v>2</v></c>" + inline("i1") + "<c r='F4'><v>4</v></c><c r='E4'><v>40000.5</v></c></row>"
    rows += "<row r='900'><c r='AA900'><v>1</v></c><c r='A900'/></row>"
    with zipfile.ZipFile(tmp_path / "odd.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", strings)
        z.writestr("xl/worksheets/first.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/second.xml", f"<worksheet {ns}><sheetData><row>{inline('nothing')}</row></sheetData></worksheet>")
    got = logs.read_log(spark, str(tmp_path / "odd.xlsx"), "online_retail")
    assert [tuple(r) for r in got.collect()] == [("7", "i1", 40000, "x & y", 10000)]
    assert archives._column("A9") == 1 and archives._column("Z1") == 26 and archives._column("AB12") == 28


def test_zipped_log(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "log.zip", "w") as z:
        z.writestr("a/2019.csv", '\ufeffevent_time,event_type,product_id,price,user_id,user_session\r\n2019-10-01 00:00:01 UTC,purchase,"p,1",35.79,u,s\r\n2019-10-01 00:00:01 UTC,view,p,1,u,s\r\n')
        z.writestr("b.csv", "user_id,price,product_id,event_type,event_time\nv,2,q,purchase,2019-10-02 00:00:01 UTC\n")
        z.writestr("readme.txt", "nothing")
    got = logs.read_log(spark, str(tmp_path / "log.zip"), "rees46")
    assert sorted(map(tuple, got.collect())) == [("u", "u|s", 18170, "p,1", 3579), ("v", "v|", 18171, "q", 200)]


def test_export_and_keyed_feed(spark, tmp_path):
    rows = [(1, 10, 1, 5, 2), (1, 10, 1, 3, 1), (1, 10, 1, 3, 4), (2, 11, 1, 5, 7), (1, 12, 8, 4, 6), (3, 13, 9, 4, 1)]
    schedule = spark.createDataFrame([(1, 5, 20)], "batch int, first_day int, end_day int")
    out = logs.export_lines(spark.createDataFrame(rows, ROWS), schedule)
    assert sorted(map(tuple, out.collect())) == [(0, 1, "4[5] 6[2] -1 -2"), (0, 2, "6[7] -1 -2"), (1, 1, "5[6] -1 -2"), (1, 3, "5[1] -1 -2")]
    logs.write_export(out, str(tmp_path / "x"))
    none = spark.createDataFrame([], "item int, profit long")
    raw = logs.read_keyed(spark, *(str(tmp_path / "x" / n) for n in ("lines", "keys", "sizes")), none)
    assert sorted(tuple(r) for r in raw.select("sid", "batch_id", "tid", "item", "util").collect()) == [(1, 0, 0, 4, 5), (1, 0, 0, 6, 2), (1, 1, 0, 5, 6), (2, 0, 0, 6, 7), (3, 1, 0, 5, 1)]
    (tmp_path / "few").write_text("1\n")
    with pytest.raises(ValueError, match="4 lines, 1 keys"):
        logs.read_keyed(spark, str(tmp_path / "x/lines"), str(tmp_path / "few"), str(tmp_path / "x/sizes"), none)
    with pytest.raises(ValueError, match="two batches"):
        logs.export_lines(spark.createDataFrame([*rows, (1, 10, 9, 9, 9)], ROWS), schedule)


def test_raw_sequences(spark):
    rows = [(1, 20, 4, 0, 2), (1, 20, 3, 0, 1), (1, 9, 4, 7, 5), (1, 30, 3, 2, 1), (2, 5, 1, 1, 1)]
    seq = logs.sequences(spark.createDataFrame(rows, ROWS))
    assert sorted(map(tuple, seq.collect())) == [(1, 0, 1, 3), (1, 1, 3, 1), (1, 2, 8, 5), (2, 0, 2, 1)]
    assert {r["sid"]: r["line"] for r in logs.lines(seq, "sid").collect()} == {1: "1[3] -1 3[1] -1 8[5] -1 -2", 2: "2[1] -1 -2"}
    assert logs.sequences(spark.createDataFrame([], ROWS)).count() == 0


def test_dictionary(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "v string")
    assert sorted(map(tuple, logs.encoded(df, "v", "code").collect()), key=str) == [("a", 0), ("b", 1), ("b", 1), ("c", 2), (None, None)]


def test_manifest(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    digest = hashlib.sha256(b"one").hexdigest()
    logs.verified(spark, str(tmp_path), {"a": digest})
    for wrong in ({"a": "0" * 64}, {}, {"a": digest, "b": digest}):
        with pytest.raises(ValueError, match="differ"):
            logs.verified(spark, str(tmp_path), wrong)
    assert qsdb.digests(spark, str(tmp_path)).count() == 1
