"""Schemas of decoded input and of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values
SCHEMA_VERSION = "1.4.0"

SECTIONS = (
    "title", "abstract", "introduction", "related_work", "method", "results", "discussion", "conclusion",
    "references", "appendix", "unknown",
)
REGION_TYPES = ("heading", "body", "caption", "figure", "table", "equation")
ARTIFACT_TYPES = ("figure", "table", "equation")
METHODS = ("pymupdf_flat_baseline", "layout_aware_v1")


_PLAIN = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "array<double>": T.ArrayType(T.DoubleType()),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """A flat schema from ``name type, ...``; needs no session, unlike DDL parsing."""
    return T.StructType([T.StructField(n, _PLAIN[t]) for n, t in (c.split() for c in columns.split(", "))])


BBOX = "bbox"
_PLAIN[BBOX] = _struct("page int, x0 double, y0 double, x1 double, y1 double")

# decoded input
DOC_IR = _struct("paper_id string, source_filename string, content binary, meta_title string, page_count int")
PAGE_IR = _struct("paper_id string, page int, width double, height double")
FLAT_IR = _struct("paper_id string, page int, text string")
SPAN_IR = _struct(
    "paper_id string, page int, block_no int, line_no int, span_no int, "
    "bx0 double, by0 double, bx1 double, by1 double, text string, font string, size double"
)
IMAGE_IR = _struct("paper_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, transform array<double>")
DRAWING_IR = _struct("paper_id string, page int, draw_no int, x0 double, y0 double, x1 double, y1 double, is_infinite boolean")

# the engine's tables
PAPERS = _struct(
    "paper_id string, source_filename string, title string, page_count int, extraction_method string, "
    "ingested_at timestamp, schema_version string"
)
PAGES = _struct("paper_id string, page_index int, image_path string, width_px int, height_px int, dpi int")
REGIONS = _struct(
    f"region_id string, paper_id string, region_type string, bbox {BBOX}, text string, column_index int, "
    "order_index int, font_size double, section string, section_title_raw string"
)
CHUNKS = _struct(
    f"chunk_id string, paper_id string, section string, section_title_raw string, text string, page_start int, "
    f"page_end int, bbox {BBOX}, order_index int, token_count int, artifact_ids array<string>"
)
ARTIFACTS = _struct(
    f"artifact_id string, paper_id string, artifact_type string, caption string, bbox {BBOX}, image_path string, "
    "linked_chunk_ids array<string>"
)


def result_type() -> T.StructType:
    """One row per paper, as it is stored in JSON."""
    table = lambda s, *drop: T.ArrayType(T.StructType([f for f in s.fields if f.name not in drop]))
    return T.StructType(
        [
            T.StructField("schema_version", T.StringType()),
            T.StructField("paper", T.StructType([f for f in PAPERS.fields if f.name != "schema_version"])),
            T.StructField("chunks", table(CHUNKS)),
            T.StructField("artifacts", table(ARTIFACTS)),
            T.StructField("pages", table(PAGES, "paper_id")),
            T.StructField("regions", table(REGIONS)),
        ]
    )
