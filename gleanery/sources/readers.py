"""Corpus readers with declared schemas: rejected rows are kept with a reason, never dropped silently."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import collapse_space, html_body, parse_tags, recorded_date
from gleanery.operators.guards import first_reason, repeated_ids, split_ledger

NATURAL = "record_id string, text string, provenance string, label double, source_id string"
COMMENTS = "id string, text string, publication_id string, article_id long, parent_id long, created_date string, toxicity double"
POSTS = "_Id long, _PostTypeId int, _CreationDate string, _OwnerUserId string, _Title string, _Body string, _Tags string"
LINKS = "_PostId long, _RelatedPostId long, _LinkTypeId int"
NEWS = "title string, text string, domain string, date string, url string"
CLUSTERS = "id string, date string, collection string, articles array<struct<title:string,text:string,url:string>>"


def blank(text: Column) -> Column:
    return text.isNull() | (collapse_space(text) == "")


def read_natural_jsonl(spark: SparkSession, path: str, labels: bool = False, sources: bool = False) -> DataFrame:
    """Natural records; a repeated id, missing field or blank text is a ValueError. Blank lines are passed over."""
    return _natural(spark.read.schema(NATURAL + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path), labels, sources)


def read_natural_csv(spark: SparkSession, path: str, labels: bool = False, sources: bool = True) -> DataFrame:
    """The same from CSV with a header of the same names; sources are supplied, never guessed."""
    reader = spark.read.schema(NATURAL + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"')
    return _natural(reader.csv(path), labels, sources)


def _natural(df: DataFrame, labels: bool, sources: bool) -> DataFrame:
    bad = F.col("_corrupt").isNotNull() | F.col("record_id").isNull() | blank(F.col("text"))
    bad = bad | F.col("label").isNull() if labels else bad
    bad = bad | F.col("source_id").isNull() if sources else bad
    n = df.persist().where(bad).count()
    twice = repeated_ids(df, "record_id").limit(1).count()
    df.unpersist()
    if n or twice:
        raise ValueError(f"{n} unusable rows" if n else "repeated record ids")
    return df.drop("_corrupt")


def read_rows(spark: SparkSession, path: str, form: str, schema: str) -> DataFrame:
    """Rows of CSV or JSON lines with ``input_file`` and ``ordinal``: the place in the read, rising within a file."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if form == "csv" else reader.json(path)
    return df.withColumn("input_file", F.input_file_name()).withColumn("ordinal", F.monotonically_increasing_id())


def unwrap(df: DataFrame, column: str = "original_fields") -> DataFrame:
    """The fields of a nested record beside its other columns."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def adapt_comments(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, exclusions) of comments: blank texts and labels outside 0 to 1 are excluded; publication and article name the source."""
    reason = first_reason((F.col("id").isNull(), "missing_id"), (blank(F.col("text")), "blank_text"), (F.col("toxicity").isNull(), "missing_label"), (~F.col("toxicity").between(0, 1), "label_out_of_range"))
    kept, out = split_ledger(raw, reason)
    return kept.select(F.concat(F.lit("comment:"), "id").alias("record_id"), collapse_space(F.col("text")).alias("text"), F.col("toxicity").alias("label"), "publication_id", "article_id", "parent_id", "created_date"), out


def read_xml_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The row elements of XML files; document types and entities are a ValueError, before anything is parsed."""
    if not spark.read.text(path).where(F.col("value").rlike("(?i)<!(doctype|entity)")).isEmpty():
        raise ValueError("document types and entities are refused")
    return spark.read.format("xml").schema(schema).option("rowTag", "row").option("mode", "FAILFAST").load(path)


def adapt_posts(posts: DataFrame, links: DataFrame, first_day: str, last_day: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(questions, exclusions, duplicate links between questions, links with an unknown end); days are recorded dates, both ends included."""
    day = recorded_date(F.col("_CreationDate"))
    reason = first_reason((F.col("_PostTypeId") != 1, "not_a_question"), (day.isNull() | ~day.between(first_day, last_day), "outside_dates"), (blank(F.col("_Title")), "blank_title"), (parse_tags(F.col("_Tags")).isNull(), "malformed_tags"))
    kept, out = split_ledger(posts, reason)
    body = html_body(F.coalesce("_Body", F.lit("")))
    questions = kept.select(F.col("_Id").alias("record_id"), collapse_space(F.concat_ws(" ", "_Title", body["text"])).alias("text"), body["repairs"].alias("repairs"), parse_tags(F.col("_Tags")).alias("tags"), F.col("_OwnerUserId").alias("owner"), day.alias("day"))
    ids = questions.select("record_id")
    pairs = links.where("_LinkTypeId = 3").select(F.col("_PostId").alias("a"), F.col("_RelatedPostId").alias("b"))
    known = pairs.join(ids.withColumnRenamed("record_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("record_id", "b"), "b", "left_semi")
    known = known.select("a", "b")
    return questions, out, known, pairs.join(known, ["a", "b"], "left_anti")


def adapt_news(raw: DataFrame, domains: DataFrame, calibration_year: int, analysis_years: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(records, exclusions) of news; domains: (host, domain). The role goes by the year of the recorded date."""
    from gleanery.functions.text import international_host, news_text

    day = recorded_date(F.col("date"))
    host = international_host(F.col("domain"))
    reason = first_reason((day.isNull(), "unusable_date"), (~(F.year(day) == calibration_year) & ~F.year(day).between(*analysis_years), "outside_years"), (host.isNull(), "unusable_host"), (blank(F.col("text")), "blank_text"))
    kept, out = split_ledger(raw, reason)
    records = kept.select(F.sha2(F.to_json(F.struct("url", "date", "title")), 256).alias("record_id"), news_text(F.col("title"), F.col("text")).alias("text"), host.alias("host"), day.alias("day"), F.when(F.year(day) == calibration_year, "calibration").otherwise("analysis").alias("role"))
    return records.join(domains.select("host", F.col("domain").alias("source")), "host", "left"), out


def explode_clusters(clusters: DataFrame) -> DataFrame:
    """A row for each article of an event, with a digest of file, event and place as its id."""
    rows = clusters.withColumn("input_file", F.input_file_name()).select("input_file", F.col("id").alias("event_id"), recorded_date(F.col("date")).alias("day"), F.posexplode("articles").alias("ordinal", "article"))
    return rows.select(F.sha2(F.concat_ws("|", "input_file", "event_id", "ordinal"), 256).alias("record_id"), "event_id", "day", "ordinal", "article.title", "article.text")


def read_archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of the files in ZIP and TAR archives; an archive is one task's."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for member, content in _members(data):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([content], pa.binary())], names=["archive", "member", "content"])

    return files.mapInArrow(run, "archive string, member string, content binary")


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info)
        return
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for info in t:
            if info.isfile():
                yield info.name, t.extractfile(info).read()


def archive_records(members: DataFrame, schema: str = "title string, maintext string, source_domain string, date_publish string, url string") -> tuple[DataFrame, DataFrame]:
    """(records, exclusions) of JSON members, each with its lineage: archive, member and content hash."""
    rows = members.select("archive", "member", F.sha2("content", 256).alias("member_sha256"), F.from_json(F.decode("content", "UTF-8"), schema).alias("j"))
    return split_ledger(rows.select("archive", "member", "member_sha256", "j.*"), first_reason((blank(F.col("maintext")), "blank_text")))


def complete_labels(rows: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with labels in single precision, omitted rows with the names of the labels that they lack or that are no numbers)."""
    lacking = F.filter(F.array(*[F.when(F.col(c).cast("double").isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in labels]), lambda x: x.isNotNull())
    marked = rows.withColumn("lacking", lacking)
    rounded = {c: F.col(c).cast("float").cast("double") for c in labels}
    return marked.where(F.size("lacking") == 0).drop("lacking").withColumns(rounded), marked.where(F.size("lacking") > 0)


def read_public_suffixes(spark: SparkSession, path: str, private: bool = True) -> DataFrame:
    """(suffix, kind) of a public-suffix list; only lines within its section markers are rules."""
    whole = spark.read.text(path, wholetext=True).select("value")
    part = lambda name: F.regexp_extract("value", rf"(?s)===BEGIN {name} DOMAINS===(.*?)===END", 1)
    body = F.concat(part("ICANN"), part("PRIVATE")) if private else part("ICANN")
    lines = whole.select(F.explode(F.split(body, r"\r?\n")).alias("line"))
    rules = lines.select(F.regexp_extract(F.trim("line"), r"^(\S+)", 1).alias("r")).where("r <> '' and not r like '//%'")
    kind = F.when(F.col("r").startswith("!"), "exception").when(F.col("r").startswith("*."), "wildcard").otherwise("exact")
    return rules.select(F.lower(F.regexp_replace("r", r"^(!|\*\.)", "")).alias("suffix"), kind.alias("kind")).distinct()


def read_preview_tables(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of Markdown tables: lines that start and end with a bar, without rules and headers."""
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^\|.*\|$") & ~F.col("value").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_extract(F.trim("value"), r"^\|(.*)\|$", 1), r"(?<!\\)\|"), lambda x: F.trim(x))
    rows = lines.select(cells.alias("c")).where(F.size("c") == len(columns)).select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)])
    return rows.where(F.col(columns[0]) != columns[0])


def read_npy_features(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(id, vector) of a single-precision matrix in the .npy format; the manifest (id, row) names every row of it, else a ValueError. A file is one task's."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                matrix = np.load(io.BytesIO(data.as_py()), allow_pickle=False)
                if matrix.ndim != 2 or matrix.dtype != np.float32 or not np.isfinite(matrix).all():
                    raise ValueError("features must be a finite matrix of single precision")
                for i in range(0, len(matrix), 4096):
                    part = matrix[i : i + 4096]
                    vectors = pa.ListArray.from_arrays(np.arange(0, part.size + 1, matrix.shape[1], dtype=np.int32), np.ascontiguousarray(part).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), vectors], names=["row", "vector"])

    rows = files.mapInArrow(run, "row long, vector array<float>")
    tally = rows.select("row", F.lit(1).alias("here")).join(manifest.select(F.col("row").cast("long").alias("row"), F.lit(1).alias("named")), "row", "full").groupBy("row").agg(F.count("here").alias("a"), F.count("named").alias("b"))
    if not tally.where("a <> 1 or b <> 1").isEmpty():
        raise ValueError("the manifest and the rows don't agree")
    return manifest.select("id", F.col("row").cast("long").alias("row")).join(rows, "row").select("id", "vector")


def read_features(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Feature rows joined by id, never by position; ids without features, or features without an id, are a ValueError."""
    features = spark.read.parquet(path)
    missing = ids.join(features, "id", "left_anti").limit(1).count() + features.join(ids, "id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("ids and features don't agree")
    return ids.join(features, "id")
