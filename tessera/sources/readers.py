"""Sources and sinks: documents as (path, content, metadata map), read and written by Spark's own formats."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import front_matter, html_title, language_of_file, strip_html
from tessera.session import ship

#: Names of hidden files and folders.
_HIDDEN = r"(^|/)\.[^/]"


def decoded(content: Column, encoding: str = "auto") -> Column:
    """Bytes as text. auto: by a byte order mark, else UTF-8 where the bytes are that, else Latin-1, in which every byte is a character; so no file fails.

    A named encoding is the JVM's; bytes that it does not know become the replacement character in UTF-8 and fail in others.
    """
    if encoding.upper() in ("UTF-8", "UTF8"):
        return F.make_valid_utf8(content.cast("string"))
    if encoding != "auto":
        return F.decode(content, encoding)
    start = F.hex(F.substring(content, 1, 3))
    plain = content.cast("string")
    return (
        F.when(start == "EFBBBF", F.make_valid_utf8(F.substring(content, 4, 2147483647).cast("string")))
        .when(start.startswith("FFFE") | start.startswith("FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(plain), plain)
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def text_files(spark: SparkSession, path: str, glob: str = "*.txt", encoding: str = "auto", recursive: bool = True) -> DataFrame:
    """One document a file: path, content, metadata (length, modified, name)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    facts = {"length": F.col("length").cast("string"), "modified": F.col("modificationTime").cast("string"), "name": F.regexp_extract("path", "([^/]*)$", 1)}
    return files.select("path", decoded(F.col("content"), encoding).alias("content"), F.create_map(*(x for k, v in facts.items() for x in (F.lit(k), v))).alias("metadata"))


def html_metadata(html: Column) -> Column:
    """Map of the page's title and of its meta elements with a name (or property) and a content, in this order of attributes; the last of a name counts."""
    metas = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    name = lambda m: F.lower(F.regexp_extract(m, r"""(?is)\b(?:name|property)\s*=\s*["']([^"']*)["']""", 1))
    value = lambda m: F.regexp_extract(m, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1)
    pairs = F.filter(F.transform(metas, lambda m: F.struct(name(m).alias("k"), value(m).alias("v"))), lambda p: (p["k"] != "") & (p["k"] != "title"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_concat(F.create_map(F.lit("title"), html_title(html)), F.map_from_entries(last))


def html_files(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """Texts of pages; title and meta elements join the metadata (the file's own facts keep their names)."""
    raw = text_files(spark, path, glob)
    own = F.map_filter(html_metadata(F.col("content")), lambda k, v: ~k.isin("length", "modified"))
    facts = F.map_filter(F.col("metadata"), lambda k, v: ~F.map_contains_key(own, k))
    return raw.select("path", strip_html(F.col("content")).alias("content"), F.map_concat(facts, own).alias("metadata"))


def markdown_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Content without front matter; its `key: value` lines become metadata."""
    raw = text_files(spark, path, glob)
    front = front_matter(F.col("content"))
    pairs = F.filter(F.transform(F.split(front, "\n"), lambda x: F.split(x, ": *", 2)), lambda p: F.size(p) == 2)
    own = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]), F.trim(p[1]))))
    return raw.select("path", F.regexp_replace("content", r"(?s)^---\n.*?\n---\n?", "").alias("content"), F.map_concat("metadata", own).alias("metadata"))


def json_documents(spark: SparkSession, path: str, text_key: str | None = None, mode: str = "separate", metadata_keys: Sequence[str] = ()) -> DataFrame:
    """(path, n, content, metadata) from files that each hold one JSON value.

    An object gives one document: the text of text_key (empty if it lacks that), or without text_key the object as JSON. separate: a document for each element of a
    top-level array, in order n; flatten: for each that is reached through arrays in arrays; concatenate: one for all, joined by blank lines, its metadata lists of what the
    elements have. Other values are their text. Metadata values are JSON texts, strings as they are. A file that is no JSON gives one document, its text.
    """
    import pandas as pd

    def load(text: str) -> list[tuple[str, dict]]:
        try:
            data = json.loads(text)
        except ValueError:
            return [(text, {})]

        def plain(v) -> str:
            return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

        def one(item) -> tuple[str, dict]:
            if not isinstance(item, dict):
                return plain(item), {}
            return (plain(item[text_key]) if text_key in item else "") if text_key else plain(item), {k: plain(item[k]) for k in metadata_keys if k in item}

        if not isinstance(data, list):
            return [one(data)]
        if mode == "flatten":
            out, stack = [], data[::-1]
            while stack:
                item = stack.pop()
                if isinstance(item, list):
                    stack += item[::-1]
                else:
                    out.append(one(item))
            return out
        each = [one(item) for item in data]
        if mode == "separate":
            return each
        objects = [item for item in data if isinstance(item, dict)]
        lists = {k: json.dumps([x[k] for x in objects if k in x], ensure_ascii=False) for k in metadata_keys if any(k in x for x in objects)}
        return [("\n\n".join(t for t, _ in each), lists)]

    def run(batches):
        for b in batches:
            rows = [(p, n, t, m) for p, c in zip(b["path"], b["content"]) for n, (t, m) in enumerate(load(c))]
            yield pd.DataFrame(rows, columns=["path", "n", "content", "metadata"])

    ship(spark)
    return text_files(spark, path, "*").select("path", "content").mapInPandas(run, "path string, n int, content string, metadata map<string,string>")


def benchmark_json(spark: SparkSession, path: str, query: str = "query", truth: str = "ground_truth", answer: str = "answer") -> DataFrame:
    """(query_id, query, answer, truth) of benchmark files: an array of objects, or lines of them; ids number the queries by their text. truth: an array of texts."""
    fields = {"query": query, "answer": answer, "truth": truth}
    own = json_documents(spark, path, None, "flatten", list(fields.values()))
    value = lambda k: F.col("metadata")[fields[k]]
    many = F.when(value("truth").startswith("["), F.from_json(value("truth"), "array<string>")).otherwise(F.array(value("truth")))
    rows = own.where(value("query").isNotNull()).select(value("query").alias("query"), value("answer").alias("answer"), F.array_compact(F.coalesce(many, F.array().cast("array<string>"))).alias("truth"))
    return rows.select(F.xxhash64("query").alias("query_id"), "query", "answer", "truth")


def evaluation_results(spark: SparkSession, path: str) -> DataFrame:
    """Answers of human evaluators, a row each, from CSV (with a header) or JSON files, as columns `criterion-n`; ready for human_evaluation()."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.option("multiLine", True).json(path)


def embedding_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) from .json files (an object of lists, or a list of lists) and .npz files (an array for each id, or one matrix): ids are names or row numbers."""
    import pandas as pd

    def load(path: str, content: bytes) -> list[tuple[str, list[float]]]:
        import io

        import numpy as np

        if path.endswith(".npz"):
            held = np.load(io.BytesIO(content), allow_pickle=False)
            arrays = {k: held[k] for k in held.files}
            if len(arrays) == 1 and next(iter(arrays.values())).ndim == 2:
                return [(str(i), row) for i, row in enumerate(next(iter(arrays.values())).tolist())]
            return [(k, v.ravel().tolist()) for k, v in arrays.items()]
        data = json.loads(content)
        return [(k, v) for k, v in data.items()] if isinstance(data, dict) else [(str(i), v) for i, v in enumerate(data)]

    def run(batches):
        for b in batches:
            rows = [(i, [float(x) for x in v]) for p, c in zip(b["path"], b["content"]) for i, v in load(p, c)]
            yield pd.DataFrame(rows, columns=["id", "embedding"])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,npz}").load(path).select("path", "content")
    return files.mapInPandas(run, "id string, embedding array<float>")


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of .docx files: paragraphs as lines. A file that is no such archive gives null."""
    import pandas as pd

    def load(content: bytes) -> str | None:
        import io
        import zipfile
        from xml.etree import ElementTree

        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [load(c) for c in b["content"]]})

    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, "path string, content string")


def directory(spark: SparkSession, path: str, glob: str = "*", hidden: bool = False, fraction: float | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """(path, length, modificationTime) of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    files = files if hidden else files.where(~F.col("path").rlike(_HIDDEN))
    files = files.sample(fraction, seed) if fraction else files
    return files.orderBy("path").limit(limit) if limit else files


def code_files(spark: SparkSession, path: str, exclude: Sequence[str] = ("node_modules", "venv", "__pycache__")) -> DataFrame:
    """Source files with their language; folders named in exclude are left out."""
    raw = text_files(spark, path, "*.{py,js,ts,java,c,cpp,cs,go,rb,php,rs,scala,kt,swift,html,css}")
    kept = raw.where(~F.col("path").rlike("/(" + "|".join(exclude) + ")/"))
    return kept.withColumn("language", language_of_file(F.col("path")))


def pdf_files(spark: SparkSession, path: str, parse, whole: bool = False) -> DataFrame:
    """(path, page, content): parse(bytes) gives a page's texts; any PDF library can be plugged in. whole: one document a file, its pages joined by blank lines, page 0."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(p, k, t) for p, c in zip(b["path"], b["content"]) for texts in [parse(c)] for k, t in enumerate(["\n\n".join(texts)] if whole else texts)]
            yield pd.DataFrame(rows, columns=["path", "page", "content"])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, page int, content string")


def error_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a log and its rotated files."""
    schema = "id string, timestamp timestamp, level int, level_name string, message string, error_type string, logger_name string, traceback string, context string"
    return spark.read.schema(schema).json(path)


def write_documents(docs: DataFrame, path: str, kind: str = "json", partition_by: Sequence[str] = ()) -> None:
    """json, csv (metadata keys become columns: all that occur) or text (content alone)."""
    if kind == "csv":
        keys = sorted(r.k for r in docs.select(F.explode(F.map_keys("metadata")).alias("k")).distinct().collect())  # the header's names
        docs = docs.select(*(c for c in docs.columns if c != "metadata"), *(F.col("metadata")[k].alias(k) for k in keys))
        docs.write.option("header", True).option("escape", '"').csv(path)
    elif kind == "text":
        docs.select("content").write.text(path)
    else:
        writer = docs.write.partitionBy(*partition_by) if partition_by else docs.write
        writer.json(path)


def append_errors(errors: DataFrame, path: str, kind: str = "json") -> None:
    """Add rows of a log to a file sink; console prints them, newest first."""
    if kind == "console":
        errors.orderBy(F.desc("timestamp")).show(truncate=False)
    else:
        errors.write.mode("append").format(kind).save(path)


def save_metrics(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Measurements as json or csv; nested columns of csv become JSON texts."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in rows.dtypes]
        rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').format(kind).load(path)
