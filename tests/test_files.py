"""Office files, failures, the document data source, table functions and incremental ingest."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from murmura.operators.chunking import greedy_chunks
from murmura.sources import files, tables
from murmura.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


DOCX = packed(word__document=f"<w:document {W}><w:body><w:p><w:r><w:t>first</w:t></w:r><w:r><w:t> part</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>last é</w:t></w:r></w:p></w:body></w:document>")
SLIDE = f"<p:sld xmlns:p='x' {A}><a:p><a:r><a:t>%s</a:t></a:r></a:p><a:p><a:r><a:t>more</a:t></a:r></a:p></p:sld>"
PPTX = packed(ppt__slides__slide2=SLIDE % "two", ppt__slides__slide10=SLIDE % "ten", ppt__slides__slide1=SLIDE % "one")
XLSX = packed(
    xl__sharedStrings="<sst xmlns='s'><si><t>name</t></si><si><t>n</t></si></sst>",
    xl__worksheets__sheet1="<worksheet xmlns='s'><sheetData><row><c t='s'><v>0</v></c><c t='s'><v>1</v></c></row><row><c t='inlineStr'><is><t>a</t></is></c><c><v>7</v></c></row></sheetData></worksheet>",
)
TEXTS = {"a.docx": "first part\n\nlast é", "b.pptx": "one\nmore\ntwo\nmore\nten\nmore\n", "c.xlsx": "name\tn\na\t7"}


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "docs"
    (top / "deep").mkdir(parents=True)
    for name, data in {
        "a.docx": DOCX, "b.pptx": PPTX, "c.xlsx": XLSX, "d.xls": b"\xd0\xcf\x11\xe0", "e.docx": DOCX[:-40], "f.pdf": b"%PDF-1.4 nothing", "g.txt": b"text", "h.md": b"caf\xe9", "i.bin": b"?", "j.txt": b" \n", "k.CSV": b"x,y", "7": b"digits", ".hidden.txt": b"no", "deep/l.log": b"log", "deep/m.txt": "é".encode(),
    }.items():
        (top / name).write_bytes(data)
    return f"file://{top}"


def test_office_files_and_failures(spark, folder):
    rows = {r.filename: r for r in files.read_files(spark, folder).collect()}
    assert {n: rows[n].content for n in TEXTS} == TEXTS and rows["g.txt"].content == "text"
    failed = {n: r.error for n, r in rows.items() if r.error is not None}
    assert set(failed) >= {"d.xls", "e.docx", "f.pdf", "h.md", "i.bin", "7", "k.CSV"} and not {*TEXTS, "g.txt", "j.txt"} & set(failed)
    assert all(rows[n].content is None for n in failed) and failed["h.md"] == files.NOT_UTF8 and failed["i.bin"] == files.NOT_READ
    assert [r.filename for r in files.load_documents(spark, folder).collect()] == ["a.docx", "b.pptx", "c.xlsx", "g.txt"] or ".hidden.txt" in rows


@pytest.mark.parametrize("recursive, lenient", [(False, False), (True, True)])
def test_data_source_gives_what_the_loader_gives(spark, folder, recursive, lenient):
    tables.register(spark)
    found = spark.read.format("documents").option("path", folder).option("recursive", str(recursive)).option("lenient", str(lenient)).option("filesPerPartition", "3").load()
    assert found.rdd.getNumPartitions() > 2
    want = files.read_files(spark, folder, recursive, lenient).where("NOT startswith(filename, '.')")
    shown = lambda df: sorted((r.filename, r.content, (r.error or "").split(":")[0]) for r in df.collect())
    assert shown(found) == shown(want)
    if lenient:
        loaded = {r.filename: r.content for r in files.load_documents(spark, folder, recursive, lenient).collect()}
        assert loaded == {r.filename: r.content for r in found.collect() if r.error is None and r.content.strip()} and loaded["deep/l.log"] == "log" and loaded["7"] == "digits"


def test_chunk_function(spark):
    tables.register(spark)
    text = "One sentence. Another one! " * 60
    spark.createDataFrame([("a", text), ("b", None), ("c", "")], "filename string, content string").createOrReplaceTempView("some_docs")
    found = spark.sql("SELECT * FROM chunks(TABLE(some_docs) PARTITION BY (filename), 300, 50) ORDER BY filename, chunk_id").collect()
    assert [tuple(r) for r in found] == [("a", i, c) for i, c in enumerate(greedy_chunks(text, 300, 50))]
    assert spark.sql("SELECT * FROM chunks(TABLE(some_docs))").count() == len(greedy_chunks(text, 1000, 200))
    with pytest.raises(Exception, match="method must be"):
        spark.sql("SELECT * FROM chunks(TABLE(some_docs), 300, 50, 'x')").collect()


def test_rows_are_counted_as_they_are_written(spark, tmp_path):
    rows = spark.range(1000).withColumn("even", F.when(F.col("id") % 2 == 0, 1))
    seen = files.write_counted(rows, lambda df: df.write.parquet(f"file://{tmp_path}/out"), even=F.count("even"))
    assert seen == {"rows": 1000, "even": 500} and spark.read.parquet(f"file://{tmp_path}/out").count() == 1000


def test_metrics_files_keep_the_order_of_columns(spark, tmp_path):
    files.write_metrics(spark.createDataFrame([("x", 2.5, None)], "scheme string, b double, a long"), f"file://{tmp_path}/m")
    assert (next((tmp_path / "m").glob("part-*"))).read_text().splitlines() == ["scheme,b,a", "x,2.5,"] or spark.read.option("header", True).csv(f"file://{tmp_path}/m").columns == ["scheme", "b", "a"]


def state(spark, store):
    return sorted(tuple(r) for r in ingest.current(spark, store).collect())


def rebuilt(spark, docs):
    return sorted(tuple(r) for r in ingest.chunks_of(spark.createDataFrame(list(docs.items()), "filename string, content string"), 60, 10).collect())


def test_ingest_replaces_files_and_tells_what_became_of_them(spark, tmp_path):
    inbox, store, checkpoint = (f"file://{tmp_path}/{x}" for x in ("inbox", "store", "checkpoint"))
    assert ingest.current(spark, store).count() == 0 and ingest.vacuum(spark, store) == []
    calls = []

    def run():
        ingest.start(spark, inbox, store, checkpoint, 60, 10, rebuild=lambda chunks, batch: calls.append((batch, chunks.select("filename").distinct().count()))).awaitTermination()

    def upload(where, **names):
        (tmp_path / "inbox" / where).mkdir(parents=True)
        for name, data in names.items():
            (tmp_path / "inbox" / where / name.replace("_", ".")).write_bytes(data)

    old = "An old text. It has some sentences. They are long enough for chunks. " * 2
    upload("first", x_txt=old.encode(), y_md=b"Kept as it is. No change at all.", n_docx=DOCX)
    run()
    assert state(spark, store) == rebuilt(spark, {"x.txt": old, "y.md": "Kept as it is. No change at all.", "n.docx": TEXTS["a.docx"]})
    new = "A new text, shorter."
    upload("second", x_txt=new.encode(), y_md=b"\xff\xfe damaged", z_txt=b"A third one. Write to a@b.com.", n_docx=DOCX[:-30])
    run()  # from the checkpoint: what was seen before isn't read again
    want = rebuilt(spark, {"x.txt": new, "y.md": "Kept as it is. No change at all.", "n.docx": TEXTS["a.docx"], "z.txt": "A third one. Write to a@b.com."})
    assert state(spark, store) == want
    told = {(r.batch_id, r.filename): (r.status, r.chunks) for r in ingest.results(spark, store).collect()}
    assert told[1, "y.md"] == told[1, "n.docx"] == ("failed", 0) and told[1, "x.txt"][0] == "stored" and len(told) == 7 and all(told[0, n][0] == "stored" for n in ("x.txt", "y.md", "n.docx"))
    assert calls == [(0, 3), (1, 4)]
    again = spark.read.format("binaryFile").load(f"{inbox}/second")
    assert ingest.store_batch(again, store, 1, 60, 10) == 2 and state(spark, store) == want  # the same batch once more
    run()
    assert len(calls) == 2 and state(spark, store) == want
    upload("third", **{n: b"Last." for n in ("x_txt", "y_md")})
    upload("third/b", x_txt=b"Later.", n_docx=DOCX)
    run()
    status = {(r.filename, r.path.rsplit("/", 2)[1]): r.status for r in ingest.results(spark, store).where("batch_id = 2").collect()}
    assert sorted(status[("x.txt", p)] for p in ("third", "b")) == ["stored", "superseded"]
    before = state(spark, store)
    assert ingest.vacuum(spark, store) == [0] and state(spark, store) == before
