"""Readers and sinks over small files."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery.functions.text import registrable_domains
from gleanery.sources import readers, writers


def test_natural_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"record_id":"a","text":"x"}\n\n{"record_id":"b","text":"y","label":0.5}\n')
    assert readers.read_natural_jsonl(spark, str(good)).count() == 2
    for name, lines, labels in [("twice", '{"record_id":"a","text":"x"}\n{"record_id":"a","text":"y"}', False), ("blank", '{"record_id":"a","text":"  "}', False), ("missing", '{"record_id":"a","text":"x"}', True)]:
        path = tmp_path / f"{name}.jsonl"
        path.write_text(lines)
        with pytest.raises(ValueError):
            readers.read_natural_jsonl(spark, str(path), labels)


def test_rows_and_nested_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny"\n2,z\n')
    got = readers.read_rows(spark, str(tmp_path / "a.csv"), "csv", "id int, t string").orderBy("ordinal").collect()
    assert [(r["id"], r["t"]) for r in got] == [(1, "x\ny"), (2, "z")]
    (tmp_path / "b.jsonl").write_text('{"k": 1, "original_fields": {"f": "g"}}\n')
    df = readers.read_rows(spark, str(tmp_path / "b.jsonl"), "json", "k int, original_fields struct<f:string>")
    assert readers.unwrap(df).select("k", "f").first() == (1, "g")


def test_comments(spark):
    df = spark.createDataFrame([("1", "a  b", "p", 5, None, "2019", 0.2), ("2", " ", "p", 5, None, None, 0.1), ("3", "c", None, None, None, None, 1.5), ("4", "d", None, None, None, None, None)], readers.COMMENTS)
    kept, out = readers.adapt_comments(df)
    assert [(r["record_id"], r["text"]) for r in kept.collect()] == [("comment:1", "a b")]
    assert sorted(r["reason"] for r in out.collect()) == ["blank_text", "label_out_of_range", "missing_label"]


def test_posts_from_xml(spark, tmp_path):
    row = lambda **a: "<row " + " ".join(f'{k}="{v}"' for k, v in a.items()) + " />"
    posts = [row(Id=1, PostTypeId=1, CreationDate="2018-01-01T23:00:00", Title="T", Body="&lt;p&gt;b&lt;/p&gt;", Tags="&lt;x&gt;&lt;y&gt;", OwnerUserId=3), row(Id=2, PostTypeId=2, CreationDate="2018-01-01", Title="", Body="", Tags=""), row(Id=3, PostTypeId=1, CreationDate="2020-01-01", Title="U", Body="", Tags="&lt;x&gt;"), row(Id=4, PostTypeId=1, CreationDate="2018-12-31", Title="V", Body="c", Tags="&lt;x&gt;&lt;x&gt;"), row(Id=5, PostTypeId=1, CreationDate="2018-12-31", Title="W", Body="c", Tags="&lt;x&gt;")]
    (tmp_path / "posts.xml").write_text("<posts>\n" + "\n".join(posts) + "\n</posts>")
    (tmp_path / "links.xml").write_text("<links>" + row(PostId=1, RelatedPostId=5, LinkTypeId=3) + row(PostId=1, RelatedPostId=99, LinkTypeId=3) + row(PostId=1, RelatedPostId=5, LinkTypeId=1) + "</links>")
    q, out, known, unknown = readers.adapt_posts(readers.read_xml_rows(spark, str(tmp_path / "posts.xml"), readers.POSTS), readers.read_xml_rows(spark, str(tmp_path / "links.xml"), readers.LINKS), "2018-01-01", "2018-12-31")
    assert sorted((r["record_id"], r["text"], r["tags"]) for r in q.collect()) == [(1, "T b", ["x", "y"]), (5, "W c", ["x"])]
    assert {r["_Id"]: r["reason"] for r in out.collect()} == {2: "not_a_question", 3: "outside_dates", 4: "malformed_tags"}
    assert [tuple(r) for r in known.collect()] == [(1, 5)] and [tuple(r) for r in unknown.collect()] == [(1, 99)]


def test_public_suffixes_and_news(spark, tmp_path):
    (tmp_path / "psl.dat").write_text("// ===BEGIN ICANN DOMAINS===\ncom\n*.ck\n!www.ck\n// note\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nblog.com\n// ===END PRIVATE DOMAINS===\n")
    rules = readers.read_public_suffixes(spark, str(tmp_path / "psl.dat"))
    hosts = spark.createDataFrame([(x,) for x in ("a.b.com", "x.blog.com", "com", "a.b.ck", "www.ck", "q.www.ck", "z.unknown")], "host string")
    got = {r["host"]: r["domain"] for r in registrable_domains(hosts, rules).collect()}
    assert got == {"a.b.com": "b.com", "x.blog.com": "x.blog.com", "com": None, "a.b.ck": "a.b.ck", "www.ck": "www.ck", "q.www.ck": "www.ck", "z.unknown": None}
    assert {r["suffix"] for r in readers.read_public_suffixes(spark, str(tmp_path / "psl.dat"), private=False).collect()} == {"com", "ck", "www.ck"}
    news = spark.createDataFrame([("T", "T\nbody", "A.b.com", "2017-05-01 00:00", "u"), ("T", "x", "1.1.1.1", "2018-01-01", "u"), ("T", "x", "a.b.com", "2016-01-01", "u"), ("T", " ", "a.b.com", "2019-01-01", "u")], readers.NEWS)
    records, out = readers.adapt_news(news, registrable_domains(hosts, rules), 2017, (2018, 2019))
    assert [(r["text"], r["role"], r["source"]) for r in records.collect()] == [("T body", "calibration", "b.com")]
    assert sorted(r["reason"] for r in out.collect()) == ["blank_text", "outside_years", "unusable_host"]


def test_archives(spark, tmp_path):
    body = json.dumps({"title": "t", "maintext": "m", "url": "u"}).encode()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/1.json", body)
        z.writestr("2.json", b'{"title": "t"}')
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("3.json")
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    records, out = readers.archive_records(readers.read_archive_members(spark, str(tmp_path)))
    assert sorted((r["member"], r["maintext"]) for r in records.collect()) == [("3.json", "m"), ("d/1.json", "m")]
    assert [(r["member"], r["reason"]) for r in out.collect()] == [("2.json", "blank_text")]


def test_preview_tables(spark, tmp_path):
    (tmp_path / "p.md").write_text("# x\n| id | text |\n|----|:---|\n| 1 | a b |\n| 2 | c |\nend\n")
    assert sorted(tuple(r) for r in readers.read_preview_tables(spark, str(tmp_path / "p.md"), ["id", "text"]).collect()) == [("1", "a b"), ("2", "c")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "record_id string, x int")
    first = writers.write_once(df, df.limit(0), str(tmp_path / "out")).first()
    assert first["n_rows"] == 2 and writers.replay_matches(spark, str(tmp_path / "out"), df.orderBy(F.desc("x"))) and not writers.replay_matches(spark, str(tmp_path / "out"), df.withColumn("x", F.lit(1)))
    with pytest.raises(ValueError):
        writers.write_once(df.union(df), df, str(tmp_path / "twice"))
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_once(df, df.limit(0), str(tmp_path / "out"))
    writers.save_state({"s": df}, str(tmp_path / "state"), 1)
    assert writers.load_state(spark, str(tmp_path / "state"), 1, ["s"])["s"].count() == 2
    a = writers.canonical_state(df, F.col("record_id"), F.col("x")).first()
    assert a == writers.canonical_state(df.repartition(2), F.col("record_id"), F.col("x")).first()
    df.withColumnRenamed("record_id", "id").write.parquet(str(tmp_path / "f"))
    assert readers.read_features(spark, str(tmp_path / "f"), spark.createDataFrame([("a",), ("b",)], "id string")).count() == 2
    with pytest.raises(ValueError):
        readers.read_features(spark, str(tmp_path / "f"), spark.createDataFrame([("a",)], "id string"))


def test_refusals_and_further_forms(spark, tmp_path):
    import numpy as np

    from gleanery.sources import writers

    (tmp_path / "bad.xml").write_text('<?xml version="1.0"?>\n<!DOCTYPE r [<!ENTITY x "y">]>\n<r><row Id="1"/></r>')
    with pytest.raises(ValueError):
        readers.read_xml_rows(spark, str(tmp_path / "bad.xml"), "_Id long")
    (tmp_path / "a.csv").write_text('record_id,text,provenance,label,source_id\nr1,"a ""b""\nc",p,0.5,s1\n')
    assert [tuple(r) for r in readers.read_natural_csv(spark, str(tmp_path / "a.csv"), labels=True).collect()] == [("r1", 'a "b"\nc', "p", 0.5, "s1")]
    (tmp_path / "b.csv").write_text("record_id,text,provenance,label,source_id\nr1,a,p,0.5,\n")
    with pytest.raises(ValueError):
        readers.read_natural_csv(spark, str(tmp_path / "b.csv"))
    matrix = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "x.npy", matrix)
    manifest = spark.createDataFrame([(f"i{k}", 3 - k) for k in range(4)], "id string, row long")
    got = {r["id"]: r["vector"] for r in readers.read_npy_features(spark, str(tmp_path / "x.npy"), manifest).collect()}
    assert got == {f"i{k}": matrix[3 - k].tolist() for k in range(4)}
    for wrong in (manifest.where("row > 0"), manifest.union(spark.createDataFrame([("z", 9)], manifest.schema)), manifest.union(manifest.limit(1))):
        with pytest.raises(ValueError):
            readers.read_npy_features(spark, str(tmp_path / "x.npy"), wrong)
    rows = spark.createDataFrame([("a", 0.1, "1"), ("b", None, "2"), ("c", 0.5, "x")], "id string, p double, q string")
    kept, out = readers.complete_labels(rows.withColumn("q", F.col("q").try_cast("double")), ["p", "q"])
    assert [(r["id"], r["p"]) for r in kept.collect()] == [("a", float(np.float32(0.1)))] and {r["id"]: r["lacking"] for r in out.collect()} == {"b": ["p"], "c": ["q"]}
    cells = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    digests = {writers.state_digest(x, F.col("k"), F.col("v")).first()[0] for x in (cells, cells.repartition(7), cells.orderBy(F.desc("k")))}
    assert len(digests) == 1 and writers.state_digest(cells.limit(999), F.col("k"), F.col("v")).first()[0] not in digests


def test_outward_intervals_and_both_systems(spark):
    from fractions import Fraction

    import numpy as np

    from gleanery.functions import vectors
    from gleanery.operators import moments

    df = spark.createDataFrame([(0.1, 0.2), (1e16, 1.0), (1.0, 3.0), (5.0, 0.0)], "a double, b double")
    got = df.select("a", "b", vectors.outward_sum("a", "b").alias("s"), vectors.outward_product("a", "b").alias("p"), vectors.outward_quotient("a", "b").alias("q")).collect()
    for r in got:
        a, b = Fraction(r["a"]), Fraction(r["b"])
        assert Fraction(r["s"]["lower"]) <= a + b <= Fraction(r["s"]["upper"]) and Fraction(r["p"]["lower"]) <= a * b <= Fraction(r["p"]["upper"])
        assert b == 0 or Fraction(r["q"]["lower"]) <= a / b <= Fraction(r["q"]["upper"])
    rng = np.random.default_rng(1)
    for shape in ((4, 9), (30, 3)):
        x, y = rng.standard_normal(shape), rng.standard_normal(shape[0])
        assert np.allclose(moments.solve_rows(x, y, 0.1), np.linalg.solve(x.T @ x + 0.1 * len(x) * np.eye(shape[1]), x.T @ y))
