"""python -m folio FILES OUT: documents under a path to structured segments as JSON, and a report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folio.plans import structuring
from folio.session import ship
from folio.sources import files


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="folio", description=__doc__)
    p.add_argument("files")
    p.add_argument("out")
    p.add_argument("--structured", action="store_true", help="the files are structured JSON already")
    p.add_argument("--names", default="", help="known names, joined by commas")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if a.structured:
        files.write_structured(files.read_structured(spark, a.files), f"{a.out}/segments")
        return
    pages = files.read_documents(spark, a.files).where("error IS NULL")
    docs = pages.select(F.xxhash64("path", "page_num").alias("doc_id"), "text")
    names = spark.createDataFrame([(n.strip(),) for n in a.names.split(",") if n.strip()], "name string")
    lines = structuring.refined(structuring.structured(structuring.lines_of(docs), names), names)
    files.write_structured(lines.select("speaker", "text", F.array().cast("array<string>").alias("errors")), f"{a.out}/segments")
    structuring.report(lines, names).write.mode("overwrite").json(f"{a.out}/report")


if __name__ == "__main__":
    main()
