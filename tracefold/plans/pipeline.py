"""The whole way from a folder of files to the exposure table, one written table a stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import detect, exposure, ingest, parse, resolve
from tracefold.operators.profile import Profile
from tracefold.runtime import materialize
from tracefold.sources.corpus import read_corpus


def extract(documents: DataFrame, records: DataFrame, profile: Profile | None = None, as_of: str = "2026-01-01") -> DataFrame:
    """Extractions of records (doc_id, record_key, text, page_spans), numbered by document, record, detector and place."""
    r = records.where("text is not null").select(F.col("doc_id").alias("document_id"), "record_key", "page_spans", "text")
    h = detect.page_numbers(detect.detect(r, profile=profile, as_of=as_of)).drop("page_spans")
    h = h.withColumns({"model_used": F.lit(None).cast("string"), "suppressed_as_false_positive": F.col("suppressed"), "_row": F.coalesce(F.regexp_extract("record_key", r"(\d+)$", 1).try_cast("bigint"), F.lit(-1))})
    order = ["document_id", "_row", "record_key", "seq", "char_start", "raw_value", "category"]
    return ingest.numbered(h, order, column="id").select("id", "document_id", "record_key", "page_number", "char_start", "char_end", "category", "raw_value", "normalized_value", "passage", "confidence", "method", "model_used", "is_partial", "suppressed_as_false_positive")


@dataclass
class Pipeline:
    """``Pipeline(spark).run(root)``: documents, records, extractions, persons, links, flags as attributes."""

    spark: SparkSession
    profile: Profile = field(default_factory=Profile)
    as_of: str = "2026-01-01"
    readers: dict = field(default_factory=dict)

    def ingest(self, root: str, existing: DataFrame | None = None) -> Pipeline:
        self.files = materialize(ingest.ingest(read_corpus(self.spark, root), existing, self.readers.get("pdf_pages")))
        return self

    def parse(self) -> Pipeline:
        self.records = materialize(parse.parse(self.files, self.readers))
        self.documents = materialize(parse.parsed_documents(self.files.drop("content"), self.records))
        return self

    def detect(self) -> Pipeline:
        self.extractions = materialize(extract(self.documents, self.records, self.profile, self.as_of))
        return self

    def resolve(self) -> Pipeline:
        self.persons, self.links = resolve.resolve(self.extractions)
        return self

    def expose(self) -> Pipeline:
        self.flags = materialize(exposure.flags(self.links, self.extractions))
        self.evidence = exposure.flag_evidence(self.links, self.extractions)
        return self

    def run(self, root: str) -> Pipeline:
        return self.ingest(root).parse().detect().resolve().expose()
