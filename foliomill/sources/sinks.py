"""Writing sections and manifests: parquet, csv, json, text, markdown and docx."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Columns of the research manifest, in order.
MANIFEST = "company year source_file section original_heading canonical_category confidence match_type start_page end_page printed_start_page printed_end_page formats".split()


def manifest(rows: DataFrame) -> DataFrame:
    """The fixed columns in order, as text, missing ones and nulls empty."""
    have = set(rows.columns)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in MANIFEST])


def section_folder(label, category, confidence):
    """Where a section goes: Full, LOW_Discovered or the folder of its category."""
    return F.when(label == "Full Report", "Full_Report").when(confidence == "LOW", F.lit("LOW_Discovered")).otherwise(T.safe_folder(F.coalesce(category, label)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Write a table; a csv of no rows still has its header."""
    w = df.write.mode(mode)
    if by:
        w = w.partitionBy(*by)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)


def write_sections(df: DataFrame, path: str, label: str, text_col: str, fmt: str = "text") -> None:
    """Sections as text or markdown lines, one folder a section label."""
    body = F.col(text_col) if fmt == "text" else F.concat(F.lit("# "), F.col(label), F.lit("\n\n"), F.col(text_col))
    df.select(T.safe_label(F.col(label)).alias("section"), body.alias("value")).write.mode("overwrite").partitionBy("section").text(path)


def docx(title: str, text: str) -> bytes:
    """A minimal document: a heading and a paragraph for each block between blank lines."""
    blocks = [title, *[b for b in text.split("\n\n") if b.strip()]]
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(b)}</w:t></w:r></w:p>' for b in blocks)
    parts = {
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def with_docx(df: DataFrame, label: str, text_col: str) -> DataFrame:
    """Each section with `docx`, its document as bytes, to be written by any binary sink."""
    def make(titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([docx(a or "", b or "") for a, b in zip(titles, texts)], dtype=object)

    return df.withColumn("docx", F.pandas_udf(make, "binary")(label, text_col))
