"""OCR content lists: pages of typed items, as block tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions.ids import number_within
from itemloom.functions.text import strip

# Block types by item type, inline types by content type, MIME types by extension.
BLOCK_TYPES = {
    "title": "title",
    "paragraph": "paragraph",
    "list_item": "list_item",
    "table": "table",
    "figure": "figure",
    "equation_interline": "equation_interline",
    "equation_block": "formula_block",
    "page_header": "page_header",
    "page_footer": "page_footer",
    "page_number": "page_number",
    "page_aside_text": "aside",
    "aside_text": "aside",
    "caption": "caption",
}
INLINE_TYPES = {"text": "text", "equation_inline": "formula", "equation_interline": "formula", "equation_display": "formula", "image": "image"}
MIME_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}
UNKNOWN, DEFAULT_MIME = "unknown", "image/png"
LEAST_TABLE_TEXT = 5

PAGES = "array<array<struct<type:string, bbox:array<double>, confidence:double, polygon:array<array<double>>, content:string>>>"
INLINE = "array<struct<type:string, content:string, confidence:double>>"
DEFAULT_MATH = "latex"


def mapped(c: Column, mapping: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def mime_type(path: Column) -> Column:
    return mapped(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), MIME_TYPES, DEFAULT_MIME)


def content_text(content: Column) -> Column:
    """Plain text of a content that is a string, or has one, or a list of parts."""
    path = lambda k: F.get_json_object(content, f"$.{k}")
    joined = lambda k: F.array_join(F.transform(F.from_json(path(k), "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.content"), F.when(~x.startswith("{"), x), F.lit(""))), "")
    one = lambda k: F.nullif(F.when(path(k).startswith("["), joined(k)).otherwise(path(k)), F.lit(""))
    return F.when(~F.coalesce(content, F.lit("")).startswith("{"), content).otherwise(F.coalesce(one("text_content"), one("content"), one("text"), F.lit("")))


def _inline(kind: Column, content: Column, confidence: Column | None = None) -> Column:
    known = F.lit(None).cast("double") if confidence is None else confidence
    return F.struct(kind.alias("type"), content.alias("content"), known.alias("confidence"))


def _inlines(content: Column, key: str) -> Column:
    raw = F.from_json(F.get_json_object(content, f"$.{key}"), INLINE)
    return F.transform(raw, lambda i: _inline(mapped(F.coalesce(i["type"], F.lit("text")), INLINE_TYPES, UNKNOWN), F.coalesce(i["content"], F.lit("")), i["confidence"]))


def blocks_of(documents: DataFrame) -> DataFrame:
    """Blocks of content lists: ``documents`` has document_id and json.

    Blocks are numbered through the document in the order of pages and items; all
    types are kept, those without a name here as unknown. Figures and tables keep their caption, and all blocks and
    inlines the engine's confidence; a picture has its path here and, by ``with_image_refs``, an id.
    """
    pages = documents.select("document_id", F.posexplode(F.from_json("json", PAGES)).alias("page", "items"))
    items = pages.select("document_id", (F.col("page") + 1).alias("page"), F.posexplode("items").alias("reading_order", "item"))
    content = F.col("item.content")
    kind = mapped(F.coalesce("item.type", F.lit(UNKNOWN)), BLOCK_TYPES, UNKNOWN)
    typed = items.select("document_id", "page", "reading_order", kind.alias("type"), F.col("item.bbox").alias("bbox"), F.col("item.confidence").alias("confidence"), F.col("item.polygon").alias("polygon"), content.alias("content"))
    inlines = F.when(F.col("type") == "title", _inlines(F.col("content"), "title_content")).when(F.col("type").isin("paragraph", "list_item"), _inlines(F.col("content"), "paragraph_content"))
    formula = F.when(F.col("type").isin("formula_block", "equation_interline"), F.get_json_object("content", "$.math_content"))
    furniture = F.when(F.col("type").isin("page_header", "page_footer", "page_number", "aside"), content_text(F.col("content")))
    path = F.get_json_object("content", "$.image_source.path")
    return typed.select(
        "document_id",
        "page",
        "reading_order",
        "type",
        F.when(F.size("bbox") >= 4, F.struct(*[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])).alias("bbox"),
        F.when(F.col("type") == "title", F.coalesce(F.get_json_object("content", "$.level").try_cast("int"), F.lit(1))).alias("level"),
        F.coalesce(formula, furniture).alias("text"),
        formula.alias("latex"),
        F.when(F.col("type").isin("formula_block", "equation_interline"), F.coalesce(F.get_json_object("content", "$.math_type"), F.lit(DEFAULT_MATH))).alias("math_type"),
        F.when(F.col("type").isin("figure", "table"), _inlines(F.col("content"), "caption")).alias("caption"),
        "confidence",
        "polygon",
        inlines.alias("inlines"),
        F.when(F.col("type") == "table", F.get_json_object("content", "$.html")).alias("html"),
        path.alias("image_path"),
        F.when(path.isNotNull(), mime_type(path)).alias("image_mime"),
    )


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all content-list files under ``path``; the id comes from name and size."""
    files = spark.read.option("wholetext", True).text(path).select("value", "_metadata.file_name", "_metadata.file_size")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    identity = F.concat_ws("_", stem, F.substring(F.md5(F.concat_ws(":", "file_name", F.col("file_size").cast("string")).cast("binary")), 1, 8))
    return blocks_of(files.select(identity.alias("document_id"), F.col("value").alias("json")))


def with_image_refs(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with image_ref, the id of the picture that they show, and the table of pictures.

    Pictures are numbered through a document in the order of its blocks. The table has image_id, document_id, page, path, mime_type.
    """
    shown = number_within(blocks.filter("image_path IS NOT NULL"), "document_id", ["page", "reading_order"], "%s_img%04d", "image_ref")
    keys = ["document_id", "page", "reading_order"]
    images = shown.select(F.col("image_ref").alias("image_id"), "document_id", "page", F.col("image_path").alias("path"), F.col("image_mime").alias("mime_type"))
    return blocks.join(shown.select(*keys, "image_ref"), keys, "left"), images


def flatten_tables(blocks: DataFrame) -> DataFrame:
    """Tables with text become paragraphs of text and formula inlines; others stay."""
    text = F.regexp_replace("html", r"(?i)</?(?:table|tr)>", "")
    text = F.regexp_replace(text, r"(?i)</td>\s*<td[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = strip(F.regexp_replace(text, r"[\s\u00a0]+", " "))
    # A mark before and after each formula cuts the text into its parts.
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"(\$[^$]+\$)", "\u0001$1\u0001"), "\u0001"), strip), lambda p: p != "")
    is_formula = lambda p: p.rlike(r"^\$[^$]+\$$")
    flat = F.transform(parts, lambda p: F.when(is_formula(p), _inline(F.lit("formula"), F.substring(p, 2, F.length(p) - 2))).otherwise(_inline(F.lit("text"), p)))
    usable = (F.col("type") == "table") & (F.length(text) >= LEAST_TABLE_TEXT)
    return blocks.withColumn("inlines", F.when(usable, flat).otherwise(F.col("inlines"))).withColumn("type", F.when(usable, "paragraph").otherwise(F.col("type")))
