"""From typed document blocks to question spans.

A block has document_id, page, reading_order, type, level, text, and inlines, an
array of (type, content); it may have latex, a formula of its own. Rules are tables of patterns, so that a corpus of another
language brings its own; the defaults are for Chinese exercise books.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Noise rules by text, in the order in which they are tried.
NOISE_PATTERNS = (
    ("difficulty", r"^难度[★☆]{1,5}$"),
    ("target_score", r"(?i)^[\d\s]*目标分[\d\sO○o零]+$"),
    ("target_score", r"^[\d\s]*目标分[\d\sO○o零必做选做]+$"),
    ("notes_area", r"^笔记区[。、．\s]*$"),
    ("answer_area", r"^答题区[。、．\s]*$"),
    ("answer_harvest", r"^答题收获"),
    ("review_item", r"^(核心结论|易错细节|特例反例|知识盲区)"),
    ("category", r"^(计算|概念|证明|填空|选择|解答|综合)"),
    ("empty", r"^\s*$"),
)
# Block types that are noise whatever they say.
STRUCTURAL = ("page_header", "page_footer", "page_number")


@dataclass(frozen=True)
class CandidateRules:
    """What makes a block the start of a question."""

    # Patterns and least lengths of the rules.
    leading_number: str = r"(?s)^(\d{1,2})\s+(.+)$"
    least_rest: int = 10
    numbered_title: str = r"^(一|二|三|四|五|六|七|八|九|十)[、．.\s]"
    long_text: int = 15
    formula_prefix: str = "^(设|已知|若|当|计算|求|证明)"
    math_text: str = r"[=()\[\]{}^_+]|(?i:lim|sin|cos|ln|log|exp)|^(I |设|已知|求|证明)"
    question_prefix: str = "^(设|已知|求|证明|计算|讨论|判断|试证|若|当)"
    least_prefixed: int = 5


# The names of the rules and their scores, in the order in which they are tried.
METHOD_SCORES = {
    "leading_number": 0.9,
    "chinese_number_title": 0.7,
    "formula_paragraph": 0.7,
    "prefix_with_formula": 0.65,
    "pure_formula": 0.4,
    "text_math_expression": 0.5,
    "question_prefix": 0.5,
}


def _latex(blocks: DataFrame) -> Column:
    """A block's own formula, null where the table has none."""
    return F.nullif(F.col("latex"), F.lit("")) if "latex" in blocks.columns else F.lit(None).cast("string")


def block_text(column: str = "text") -> Column:
    """A block's text, else all its inlines."""
    own = F.nullif(F.col(column), F.lit(""))
    return F.coalesce(own, F.array_join(F.transform("inlines", lambda i: i["content"]), ""), F.lit(""))


def block_texts(blocks: DataFrame) -> DataFrame:
    """Blocks with three views: full text, text inlines only, and text with $-wrapped formulas."""
    is_text = lambda i: i["type"] == "text"
    marked = F.transform("inlines", lambda i: F.when(i["type"] == "formula", F.concat(F.lit("$"), i["content"], F.lit("$"))).otherwise(i["content"]))
    plain = F.array_join(F.transform(F.filter("inlines", is_text), lambda i: i["content"]), "")
    return blocks.select("*", block_text().alias("full_text"), F.coalesce(plain, F.lit("")).alias("plain_text"), F.coalesce(F.array_join(marked, ""), F.col("text"), F.lit("")).alias("marked_text"))


def annotate_noise(blocks: DataFrame, patterns: tuple[tuple[str, str], ...] = NOISE_PATTERNS) -> DataFrame:
    """Blocks with the reason why they are noise, null for others: the first rule that holds."""
    text = block_text()
    reason = F.when(F.col("type").isin(*STRUCTURAL), F.concat(F.lit("structural:"), "type")).when(F.col("type") == "aside", "aside").when((F.col("type") == "title") & (F.col("level") >= 2), "section_title")
    for name, pattern in patterns:
        reason = reason.when(text.rlike(pattern), name)
    return blocks.withColumn("noise", reason)


def annotate_candidates(blocks: DataFrame, rules: CandidateRules = CandidateRules()) -> DataFrame:
    """Blocks with method, score and number of a question start, null for others.

    A column ``latex``, if there is one, counts as a formula of the block, and as its text where it has no other.
    """
    text = F.coalesce(F.nullif(block_text(), F.lit("")), _latex(blocks), F.lit(""))
    plain = F.coalesce(F.array_join(F.transform(F.filter("inlines", lambda i: i["type"] == "text"), lambda i: i["content"]), ""), F.lit(""))
    stem = F.regexp_replace(plain, r"^\s+|\s+$", "")
    formulas = F.coalesce(F.size(F.filter("inlines", lambda i: i["type"] == "formula")), F.lit(0))
    formulas = F.greatest(formulas, F.lit(0))
    number = F.regexp_extract(text, rules.leading_number, 1)
    rest = F.regexp_replace(F.regexp_extract(text, rules.leading_number, 2), r"^\s+|\s+$", "")
    kind = F.col("type")
    is_paragraph, has_formula = kind == "paragraph", (formulas > 0) | _latex(blocks).isNotNull()
    numbered = (F.coalesce(number.try_cast("int"), F.lit(0)) >= 1) & (F.length(rest) > rules.least_rest)
    holds = {
        "leading_number": numbered,
        "chinese_number_title": (kind == "title") & text.rlike(rules.numbered_title),
        "formula_paragraph": is_paragraph & has_formula & (F.length(stem) >= rules.long_text),
        "prefix_with_formula": is_paragraph & has_formula & stem.rlike(rules.formula_prefix),
        "pure_formula": is_paragraph & has_formula & (F.length(stem) == 0),
        "text_math_expression": is_paragraph & ~has_formula & (F.length(stem) >= rules.long_text) & stem.rlike(rules.math_text),
        "question_prefix": stem.rlike(rules.question_prefix) & (F.length(stem) >= rules.least_prefixed),
    }
    method, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name in reversed(METHOD_SCORES):
        method, score = F.when(holds[name], name).otherwise(method), F.when(holds[name], METHOD_SCORES[name]).otherwise(score)
    able = kind.isin("paragraph", "title", "list_item")
    out = blocks.withColumn("method", F.when(able, method)).withColumn("score", F.when(able, score))
    return out.withColumn("number", F.when(F.col("method") == "leading_number", number))


def assemble_spans(annotated: DataFrame) -> DataFrame:
    """Question spans: one row for each candidate that isn't noise.

    A span runs to just before the document's next candidate, over pages, without
    noise. Returns document_id, span (from 0), number, method, score, text, pages,
    n_blocks, first_block and last_block. What stands before a document's first
    candidate is in no span.
    """
    inside = Window.partitionBy("document_id").orderBy("page", "reading_order")
    starts = F.col("method").isNotNull() & F.col("noise").isNull()
    numbered = annotated.withColumn("place", F.row_number().over(inside)).withColumn("span", F.sum(F.when(starts, 1).otherwise(0)).over(inside) - 1)
    kept = numbered.filter("noise IS NULL AND span >= 0")
    part = F.struct("place", block_text().alias("t"))
    lead = lambda c: F.min_by(c, "place").alias(c)
    grouped = kept.groupBy("document_id", "span").agg(
        lead("number"),
        lead("method"),
        lead("score"),
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.count("*").alias("n_blocks"),
        F.min("place").cast("bigint").alias("first_block"),
        F.max("place").cast("bigint").alias("last_block"),
    )
    texts = F.filter(F.transform("parts", lambda p: p["t"]), lambda t: t != "")
    return grouped.withColumn("text", F.array_join(texts, " ")).drop("parts")


def span_profile(spans: DataFrame) -> DataFrame:
    return spans.select("document_id", "span", "method", "score", "number", "n_blocks", "first_block", "last_block", F.array_join("pages", ",").alias("pages"))


def detection_summary(annotated: DataFrame) -> DataFrame:
    """Counts by kind (noise or candidate) and reason or method."""
    noise = annotated.filter("noise IS NOT NULL").groupBy(F.lit("noise").alias("kind"), F.col("noise").alias("what")).agg(F.count("*").alias("n"))
    starts = annotated.filter("method IS NOT NULL AND noise IS NULL").groupBy(F.lit("candidate").alias("kind"), F.col("method").alias("what")).agg(F.count("*").alias("n"))
    return noise.union(starts)


def detection_details(annotated: DataFrame) -> DataFrame:
    """One row for each block that is noise, with its reason, or a candidate, with method, score and number."""
    noise = F.col("noise").isNotNull()
    where = [c for c in ("document_id", "page", "reading_order", "block_id") if c in annotated.columns]
    of_candidate = [F.when(~noise, F.col(c)).alias(c) for c in ("score", "number")]
    kept = annotated.filter(noise | F.col("method").isNotNull())
    return kept.select(*where, F.when(noise, "noise").otherwise("candidate").alias("kind"), F.coalesce("noise", "method").alias("what"), *of_candidate)


def neighbour_context(spans: DataFrame, width: int = 2, chars: int = 200) -> DataFrame:
    """Spans with the beginnings of their neighbours' texts, nearest on the left last, on lines."""
    order = Window.partitionBy("document_id").orderBy("span")
    at = [k for k in range(-width, width + 1) if k]
    near = [F.nullif(F.substring(F.lag("text", -k).over(order) if k < 0 else F.lead("text", k).over(order), 1, chars), F.lit("")) for k in at]
    near = [F.nullif(F.substring(F.lag("text", abs(k)).over(order), 1, chars), F.lit("")) if k < 0 else n for k, n in zip(at, near, strict=True)]
    return spans.withColumn("context", F.concat_ws("\n", *near))


def by_first_page(spans: DataFrame) -> DataFrame:
    """Per document and first page the number of spans; spans without a page are left out."""
    return spans.withColumn("page", F.get("pages", F.lit(0))).filter("page IS NOT NULL").groupBy("document_id", "page").agg(F.count("*").alias("n_spans"))


def usable_documents(blocks: DataFrame, least: int = 2) -> DataFrame:
    """Documents whose first page has ``least`` non-blank text parts in paragraphs."""
    parts = blocks.filter("type = 'paragraph' AND page = 1").select("document_id", F.explode("inlines").alias("i")).filter("i.type = 'text' AND trim(i.content) != ''")
    return parts.groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("document_id")


# How blocks are written, and what stands for a table without text and a picture without a path.
TABLE, NO_TABLE, NO_PATH = "[表格: %s]", "(见原始数据)", "unknown.png"
CLOSED = {"page_header": "---", "page_footer": "---", "code_block": "```"}


def _own(blocks: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that not every block table has."""
    return F.col(name) if name in blocks.columns else F.lit(None).cast(kind)


def _written(inlines: Column) -> Column:
    """Inlines as Markdown: formulas between dollar signs, pictures by their path."""
    part = lambda i: F.when(i["type"] == "formula", F.concat(F.lit("$"), i["content"], F.lit("$"))).when(i["type"] == "image", F.concat(F.lit("![inline]("), i["content"], F.lit(")"))).otherwise(i["content"])
    return F.coalesce(F.array_join(F.transform(inlines, part), ""), F.lit(""))


def render_markdown(blocks: DataFrame) -> DataFrame:
    """Each document as Markdown, its blocks in order between empty lines, a line end behind the last.

    Page numbers are left out, and asides and unknown blocks without text. Figures and formulas show the picture that they
    have (image_path), figures with their caption.
    """
    kind, body, text = F.col("type"), _written(F.col("inlines")), block_text()
    path = F.nullif(_own(blocks, "image_path"), F.lit(""))
    caption = _written(F.col("caption")) if "caption" in blocks.columns else F.lit("")
    latex = F.coalesce(_latex(blocks), F.lit(""))
    shown = F.concat(F.lit("!["), caption, F.lit("]("), F.coalesce(path, F.lit(NO_PATH)), F.lit(")"))
    formula = F.concat(F.lit("$$\n"), latex, F.lit("\n$$"), F.coalesce(F.concat(F.lit("\n![formula]("), path, F.lit(")")), F.lit("")))
    line = (
        F.when(kind == "title", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), body))
        .when(kind == "paragraph", body)
        .when(kind == "list_item", F.concat(F.lit("- "), body))
        .when(kind.isin("formula_block", "equation_interline"), formula)
        .when(kind == "figure", shown)
        .when(kind == "table", F.format_string(TABLE, F.coalesce(F.nullif(F.col("text"), F.lit("")), _latex(blocks), F.lit(NO_TABLE))))
        .when(kind == "caption", F.concat(F.lit("*"), body, F.lit("*")))
    )
    for name, mark in CLOSED.items():
        line = line.when(kind == name, F.concat(F.lit(f"{mark}\n"), text, F.lit(f"\n{mark}")))
    line = line.when(kind == "aside", F.concat(F.lit("> "), F.nullif(text, F.lit("")))).when(kind != "page_number", F.nullif(text, F.lit("")))
    listed = F.collect_list(F.when(F.col("line").isNotNull(), F.struct("page", "reading_order", "line")))
    parts = blocks.select("document_id", "page", "reading_order", line.alias("line")).groupBy("document_id").agg(F.array_sort(listed).alias("l"))
    return parts.select("document_id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"), F.lit("\n")).alias("markdown"))
