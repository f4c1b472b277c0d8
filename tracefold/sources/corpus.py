"""A1, A3: files of a corpus folder as rows, and sinks for results."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders whose own files are made by the pipeline, and files that are no documents.
SKIPPED_FOLDERS, SKIPPED_FILES = ("_extracted_attachments", "_recovered"), ("manifest.json",)


def _empty_files(raw: DataFrame) -> DataFrame:
    """path of the files that the scan leaves out because they have no bytes: those of its file list (which the planner holds anyway) that it does not deliver."""
    spark = raw.sparkSession
    listed = spark.createDataFrame([(f,) for f in raw.inputFiles()], "value string")
    paths = listed.select(F.regexp_replace(F.url_decode(F.regexp_replace("value", r"\+", "%2B")), "^file:/*", "/").alias("path"))
    return paths.join(raw.select("path"), "path", "left_anti")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """relpath, filename, declared_extension, size_bytes, sha256 ('' for an empty file), content of every file below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "content")
    raw = raw.unionByName(_empty_files(raw).select("path", F.lit(0).cast("bigint").alias("length"), F.lit(b"").cast("binary").alias("content")))
    base = re.sub("^file:/*", "/", root.rstrip("/")) + "/"
    rel = F.substring_index("path", base, -1)
    name, folder = F.substring_index("relpath", "/", -1), F.element_at(F.split("relpath", "/"), -2)
    skip = F.when(F.size(F.split("relpath", "/")) > 1, folder.isin(*SKIPPED_FOLDERS)).otherwise(False) | name.isin(*SKIPPED_FILES)
    return (
        raw.withColumn("relpath", rel).where(~skip)
        .select("relpath", name.alias("filename"), F.lower(F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")).alias("declared_extension"), F.col("length").alias("size_bytes"), F.when(F.col("length") > 0, F.sha2("content", 256)).otherwise("").alias("sha256"), "content")
    )


def skip_existing(files: DataFrame, documents: DataFrame) -> DataFrame:
    """A2: files whose relpath is not in ``documents`` yet."""
    return files.join(documents.select("relpath").distinct(), "relpath", "left_anti")


def upsert_recovered(documents: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovered copies take the place of the documents of the same relpath."""
    return documents.join(recovered.select("relpath").distinct(), "relpath", "left_anti").unionByName(recovered, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    """F5 sink: CSV with a header, in as many files as the data has partitions."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)


def xlsx(sheets: dict[str, DataFrame], most: int = 1_048_575) -> bytes:
    """F6 sink: a workbook of small result tables. More rows than a sheet can hold are refused."""

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = sheets[n].take(most + 1)
            if len(rows) > most:
                raise ValueError(f"{n}: more rows than a sheet can hold; write CSV or Parquet")
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [sheets[n].columns, *rows])
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
