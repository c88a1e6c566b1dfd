"""Sources, sinks, plug-in boundaries, the step runner and streams."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import clean
from pagewright.plans import pipeline
from pagewright.sources import external, tables
from pagewright.streaming.pages import clean_stream, score_stream


def test_csv_keeps_lists_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("q", 'two\nlines "x"', '["a","b"]')], "query_id string, query_en string, retrieved_doc_ids string")
    tables.write_csv(df, f"{tmp_path}/d")
    assert [tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/d", df.schema.simpleString()[7:-1].replace(":", " ")).collect()] == [tuple(r) for r in df.collect()]


def test_optional_and_required(spark, tmp_path):
    df = spark.createDataFrame([("q",)], "query_id string")
    tables.write_csv(df, f"{tmp_path}/a")
    assert list(tables.optional(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"})) == ["a"]
    with pytest.raises(FileNotFoundError):
        tables.optional(spark, {"b": f"{tmp_path}/b"})
    with pytest.raises(ValueError, match="query_en"):
        tables.require(df, "query_id", "query_en")


def test_files_skips_empty_ones(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"")
    assert [r.stem for r in tables.files(spark, str(tmp_path), "*.pdf").collect()] == ["a"]


def test_cache_validity(spark):
    info = spark.createDataFrame([("f", "cls", None, 5)], "fingerprint string, pooling string, text_pooling string, num_docs int")
    good = {"fingerprint": "f", "pooling": "cls", "text_pooling": None, "num_docs": 5}
    assert tables.cache_valid(info, good)
    assert not tables.cache_valid(info, good | {"num_docs": 6})
    assert not tables.cache_valid(info, good | {"image_pooling": "x"})


def test_render_and_ocr(spark, tmp_path):
    def renderer():
        def render(path, dpi):
            if "bad" in path:
                raise ValueError("broken")
            yield from (f"{path}-{i}" for i in range(2))

        return render

    pdfs = spark.createDataFrame([("/x/a.pdf", "a"), ("/x/bad.pdf", "bad")], "path string, stem string")
    m = external.render_pages(pdfs, renderer).orderBy("doc_id", "page_idx").collect()
    assert [(r.page_id, r.error) for r in m] == [("a:0000", None), ("a:0001", None), (None, "broken")]

    def recogniser():
        def read(p):
            if p.endswith("1"):
                raise ValueError("no text")
            return '{"rec_texts": ["hi"], "rec_scores": [0.5], "rec_boxes": [[1]]}'

        return read

    pages = external.run_ocr(external.render_pages(pdfs, renderer).where("page_id is not null"), recogniser).orderBy("page_id").collect()
    assert [(r.ocr_text, r.error) for r in pages] == [("hi", ""), ("", "no text")]
    external.write_ocr_json(external.run_ocr(external.render_pages(pdfs, renderer).where("page_id is not null"), recogniser), f"{tmp_path}/raw")
    assert [r.value for r in spark.read.text(f"{tmp_path}/raw").where("doc_id = 'a'").collect()][1] == "{}"
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "i.png").write_bytes(b"abc")
    assert [bytes(r.image) for r in external.load_images(spark, f"{tmp_path}/images", lambda: lambda b: bytes(b)[::-1]).collect()] == [b"cba"]
    e = external.encode(spark.createDataFrame([("abc",)], "t string"), lambda: lambda xs: [[3.0, 4.0] for _ in xs], "t").first()
    assert list(e.embedding) == pytest.approx([0.6, 0.8])


def test_rebuild_and_errors(spark):
    manifest = spark.createDataFrame([("a:0000", "a", 0, "p"), ("a:0001", "a", 1, "p")], "page_id string, doc_id string, page_idx int, image_path string")
    texts = spark.createDataFrame([("a:0000", "a", 0, "p", "some text", "")], "page_id string, doc_id string, page_idx int, image_path string, ocr_text string, error string")
    docs = spark.createDataFrame([("a", 2)], "doc_id string, page_count int")
    out, errors = pipeline.run(pipeline.data_rebuild(), {"manifest": manifest, "page_texts": texts, "documents": docs})
    assert not errors
    r = out["summary"].first()
    assert (r.pages, r.pages_with_ocr_text, r.pages_with_clean_text) == (2, 1, 1)
    fail = [("x", lambda t: t["missing"]), ("y", lambda t: t["manifest"])]
    assert list(pipeline.run(fail, {"manifest": manifest})[0]) == ["manifest"]
    assert list(pipeline.run(fail, {"manifest": manifest}, keep_going=True)[0]) == ["manifest", "y"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "sensor " + "x" * 200, 9)], "doc_id string, page_idx int, ocr_text_clean string, num_boxes int").withColumns({"ocr_text_clean_len": F.length("ocr_text_clean"), "ocr_text": F.col("ocr_text_clean")})
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = score_stream(stream()).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").first().page_type == "fact"
    seen = []
    q = clean_stream(stream().drop("ocr_text_clean", "ocr_text_clean_len"), lambda df, e: seen.append(df.count())).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [1]


def test_index_names_clashes(spark):
    a = spark.createDataFrame([("d", 0, "l")], "doc_id string, page_idx int, dpi string")
    b = spark.createDataFrame([("d", 0, "r")], "doc_id string, page_idx int, dpi string")
    assert clean.left_with_suffix(a, b, ["doc_id", "page_idx"], "_ocr").columns == ["doc_id", "page_idx", "dpi", "dpi_ocr"]
