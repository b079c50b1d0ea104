"""Files of documents: text, markdown, word-processor and e-book formats, structured JSON; and sinks.

Dispatch is by extension. Formats are opened from the bytes that Spark's ``binaryFile`` source reads,
so any file system that Spark reaches will do. PDF needs a decoder that is not part of this library:
pass one as ``pdf``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = (".txt", ".md", ".pdf", ".docx", ".epub", ".mobi")
PAGES = "path string, name string, extension string, size long, modified timestamp, page_num int, text string, error string"


class _Text(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    p = _Text()
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.parts)).strip()


def docx_pages(raw: bytes) -> list[str]:
    """Paragraphs joined by line ends."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    own = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return ["\n".join("".join(t.text or "" for t in p.iter(f"{own}t")) for p in root.iter(f"{own}p"))]


def epub_pages(raw: bytes) -> list[str]:
    """A page for each HTML document, in the order of the archive."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [html_text(z.read(n).decode("utf-8", "replace")) for n in z.namelist() if re.search(r"\.x?html?$", n)]


def mobi_pages(raw: bytes) -> list[str]:
    """Text records that are not compressed, their mark-up taken out."""
    count = int.from_bytes(raw[76:78], "big")
    starts = [int.from_bytes(raw[78 + 8 * i : 82 + 8 * i], "big") for i in range(count)] + [len(raw)]
    head = raw[starts[0] : starts[1]]
    if int.from_bytes(head[:2], "big") != 1:
        raise ValueError("compressed text records")
    records = int.from_bytes(head[8:10], "big")
    return [html_text(b"".join(raw[starts[i] : starts[i + 1]] for i in range(1, records + 1)).decode("utf-8", "replace"))]


def read_documents(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Pages of all files under a path; a file that cannot be read has one row with its error."""
    readers: dict[str, Callable[[bytes], list[str]]] = {".docx": docx_pages, ".epub": epub_pages, ".mobi": mobi_pages}
    readers |= {e: lambda raw: [raw.decode("utf-8")] for e in (".txt", ".md")}
    if pdf:
        readers[".pdf"] = pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                info = (r.path, r.name, r.extension, r.size, r.modified)
                try:
                    if r.extension not in EXTENSIONS:
                        raise ValueError(f"unsupported format: {r.extension or 'none'}")
                    if r.extension not in readers:
                        raise ValueError("no PDF decoder given")
                    out += [(*info, i, t, None) for i, t in enumerate(readers[r.extension](r.content), 1)]
                except Exception as e:  # a broken file is a row, not the end of the job
                    out.append((*info, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "name", "extension", "size", "modified", "page_num", "text", "error"]).astype({"page_num": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(
        "path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content"
    )
    return named.mapInPandas(run, PAGES)


SEGMENT = "speaker string, text string, errors array<string>"


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """Segments that are structured already: JSON arrays or lines of objects."""
    return spark.read.schema(SEGMENT).option("multiLine", "true").json(path)


def clean_segments(df: DataFrame) -> DataFrame:
    """Speakers default to the narrator; texts are trimmed; segments without text go."""
    speaker = F.coalesce(F.nullif(F.trim("speaker"), F.lit("")), F.lit("narrator"))
    return df.withColumns({"speaker": speaker, "text": F.trim(F.col("text").cast("string"))}).where("text <> ''")


def write_structured(df: DataFrame, to: str) -> None:
    clean_segments(df).write.mode("overwrite").json(to)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    rows = old.unionByName(new)
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_place", F.row_number().over(latest)).where("_place = 1").drop("_place")


def typed_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Messages with ids where they lack one and maps as JSON."""
    schema = "job_id string, text_content string, metadata map<string,string>, timestamp string"
    df = spark.createDataFrame([(r.get("job_id"), r.get("text_content"), r.get("metadata"), r.get("timestamp")) for r in rows], schema)
    return df.withColumns({"job_id": F.coalesce("job_id", F.uuid()), "metadata": F.to_json("metadata"), "timestamp": F.to_timestamp("timestamp")})
