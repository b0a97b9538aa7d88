import json

import pytest
from pyspark.sql import functions as F

from tarnwick.sources import readers, sinks
from tarnwick.streaming import gates


def test_images_and_png(spark, tmp_path):
    folder = tmp_path / "Genus"
    rgb = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 1, 2, 3, 4, 5, 6, 7, 8, 9])
    sinks.write_pngs(spark.createDataFrame([("one", 3, 2, bytearray(rgb))], "name string, width int, height int, rgb binary"), str(folder))
    (folder / "note.txt").write_text("x")
    found = readers.image_files(spark, str(tmp_path)).collect()
    assert [(r["genus"], r["name"]) for r in found] == [("Genus", "one")]
    pixels = readers.pixels(spark, str(folder / "one.png")).orderBy("y", "x").collect()
    assert [(p["r"], p["g"], p["b"]) for p in pixels] == [tuple(rgb[i : i + 3]) for i in range(0, 18, 3)]


def test_documents_lists_and_matrices(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "f", "genus": "G"}], "annotations": [{"id": 5, "image_id": 1, "bbox": [1, 2, 3, 4]}]}))
    images, notes = readers.coco(spark, str(tmp_path / "a.json"))
    assert images.first()["genus"] == "G" and notes.first()["bbox"] == [1, 2, 3, 4]
    (tmp_path / "ids.txt").write_text("3 4\nx 5\n")
    assert sorted(r["id"] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == [3, 4, 5]
    (tmp_path / "f.csv").write_text("genus,species,p,q\nA,b,1.5,2\n")
    row = readers.feature_table(spark, str(tmp_path / "f.csv")).first()
    assert row["names"] == ["p", "q"] and row["f"] == [1.5, 2.0]
    (tmp_path / "m.csv").write_text(",a,b,c\na,0,1,2\nb,1,0,3\nc,2,3,0\n")
    assert {tuple(r) for r in readers.square_matrix(spark, str(tmp_path / "m.csv")).collect()} == {("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 3.0)}
    (tmp_path / "d.json").write_text(json.dumps({"n_species": 1, "species": [{"genus": "A", "species": "b", "features": [1, 2]}]}))
    assert readers.feature_document(spark, str(tmp_path / "d.json")).first()["f"] == [1, 2]
    (tmp_path / "t.tre").write_text("(A:1,B:2);")
    assert readers.tree_texts(spark, str(tmp_path / "t.tre")).first()["text"] == "(A:1,B:2);"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("<a>", "x", "s"), (None, "y", "s")], "t string, v string, g string")
    sinks.csv(rows, str(tmp_path / "c"), ["v", "absent", "t"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["v", "absent", "t"]
    sinks.json_lines(rows, str(tmp_path / "j"))
    sinks.text_list(rows, "v", str(tmp_path / "l"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["x", "y"]
    html = {(r["title"], r["html"]) for r in sinks.html_card_rows(rows, "t", "v", "g").collect()}
    assert html == {("", "<div><h3></h3><p>y</p></div>"), ("<a>", "<div><h3>&lt;a&gt;</h3><p>x</p></div>")}
    sinks.json_document(rows.groupBy().agg(F.sort_array(F.collect_list("v")).alias("list"), F.struct(F.max("g").alias("g")).alias("of")), str(tmp_path / "d"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "d")).collect()] == ['{"list":["x","y"],"of":{"g":"s"}}']
    with pytest.raises(ValueError):
        sinks.json_document(rows, str(tmp_path / "e"))
    with pytest.raises(ValueError, match="absent, other"):
        readers.required(rows, ["v", "absent", "other"])
    with pytest.raises(ValueError, match="no rows"):
        readers.required(rows.where("false"), ["v"])
    assert readers.required(rows.where("false"), ["v"], rows=False).count() == 0
    assert sinks.with_summary(rows, [rows.agg(F.lit("SUM").alias("t"))]).count() == 3


def test_stream_and_batch_agree(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) as ts, id % 3 as user, double(id) as v from range(0, 300)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = gates.gate_counts(stream, "ts", "v", 50.0, 200.0).writeStream.outputMode("complete").format("memory").queryName("gates").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("gates").collect()} == {tuple(r) for r in gates.gate_counts(rows, "ts", "v", 50.0, 200.0).collect()}
    assert gates.sessions(rows, "ts", "user").count() == 3


def test_report_cards_count_every_revision(spark, tmp_path):
    from tarnwick.plans.queries import Q

    rows = [("a", "x<y", 1), ("a", "x<y", 2), (None, "z", 3), ("", "z", 4), ("b", None, 2)]
    spark.createDataFrame(rows, "source string, title string, rev_no int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in Q["html_report_cards"](spark, str(tmp_path)).collect())
    card = "<div><h3>{}</h3><p>{}</p></div>".format
    assert got == [("", "z", card("z", 2)), ("a", "x<y", card("x&lt;y", 2)), ("b", "", card("", 1))]
