"""Reading report files into pages: text and markdown split at page banners, docx with the standard library, PDF if a parser is there."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bump when the parsers change: cached pages of another version are parsed anew.
VERSION = "1"
PAGES = "content_key string, path string, page_index int, page int, text string, method string, status string"
BANNER = r"(?m)^=+ ?PAGE \d+ ?=+\s*$"


def files(spark: SparkSession, path: str, pattern: str = "*.{txt,md,docx,pdf}") -> DataFrame:
    """(path, content, suffix, content_key): files under a folder, the key a hash of version, suffix and bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    key = F.sha2(F.concat(F.lit(f"{VERSION}\x00").cast("binary"), suffix.cast("binary"), F.col("content")), 256)
    return raw.select("path", "content", suffix.alias("suffix"), key.alias("content_key"))


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PAGES.split(", ")]
    for f in frames:
        rows = []
        for r in f.itertuples():
            try:
                if r.suffix == "docx":
                    rows.append((r.content_key, r.path, 0, None, _docx(r.content), "docx", "OK"))
                else:
                    import fitz  # not everywhere; without it the file comes out as UNSUPPORTED

                    with fitz.open(stream=r.content, filetype="pdf") as pdf:
                        rows += [(r.content_key, r.path, i, i + 1, p.get_text(), "native", "OK") for i, p in enumerate(pdf)]
            except ImportError:
                rows.append((r.content_key, r.path, 0, None, None, None, "UNSUPPORTED"))
            except Exception as e:  # noqa: BLE001 - one bad file is a row, not a failed job
                rows.append((r.content_key, r.path, 0, None, None, None, f"ERROR {type(e).__name__}"))
        yield pd.DataFrame(rows, columns=columns).astype({"page": "Int32"})


def pages(found: DataFrame) -> DataFrame:
    """One row a page, columns PAGES. Text files are split at PAGE banners if there are two at least, else they are one page without a number."""
    plain = found.where(F.col("suffix").isin("txt", "md")).withColumn("_t", F.decode("content", "utf-8"))
    parts = F.split("_t", BANNER)
    many = F.size(parts) > 2
    cut = F.when(many, F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: F.trim(F.regexp_replace(x, r"^\n|\n$", "")))).otherwise(F.array("_t"))
    numbers = F.transform(F.regexp_extract_all("_t", F.lit(r"(?m)^=+ ?PAGE (\d+) ?=+\s*$"), F.lit(1)), lambda x: x.try_cast("int"))
    text = plain.select("content_key", "path", F.posexplode(cut).alias("page_index", "text"), F.when(many, numbers).alias("_n"))
    text = text.select("content_key", "path", "page_index", F.get("_n", F.col("page_index")).alias("page"), "text", F.lit("text").alias("method"), F.lit("OK").alias("status"))
    return text.unionByName(found.where(~F.col("suffix").isin("txt", "md")).mapInPandas(_parse, PAGES))


def pages_cached(spark: SparkSession, found: DataFrame, cache: str) -> DataFrame:
    """Pages of all files; only those whose key the parquet cache lacks are parsed, and they are added to it."""
    known = spark.read.schema(PAGES).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], PAGES)
    new = pages(found.join(known.select("content_key").distinct(), "content_key", "left_anti").dropDuplicates(["content_key"]))
    new.where("status = 'OK'").write.mode("append").parquet(cache)
    return spark.read.schema(PAGES).parquet(cache).drop("path").join(found.select("content_key", "path"), "content_key")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
