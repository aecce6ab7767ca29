"""Queries over blocks, texts, prompts, responses, files and streams, with SQL where it can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.operators import blocks as B
from itemloom.operators import inference as N
from itemloom.operators import resolve as R
from itemloom.operators import validation as V
from itemloom.functions import text as T
from itemloom.functions.ids import next_id, number_within
from itemloom.plans.bindings import Model, model_sql
from itemloom.plans.core_queries import CHAIN
from itemloom.plans.hierarchy_queries import _ENTRIES, _MARKS, PAGED, marks, paged_entries
from itemloom.plans.registry import query
from itemloom.session import TASK_ROWS, discard, materialize, shared_dir, table
from itemloom.sources import bank, ocr
from itemloom.streaming import streams

#: Rules that fit the provided prose, as the default ones fit none of it.
NOISE = (("short", "(?s)^.{0,20}$"), ("symbols", r"[%$#&*]{3}"), ("empty", r"^\s*$"))
RULES = B.CandidateRules(leading_number=r"(?s)^(\d{1,2})\s+(.+)$", numbered_title="^(The|Die|Les?) ", long_text=400, formula_prefix="^(In|Of|De)", math_text="^(Is|Er|La) ", question_prefix="^(Th|An|Un|Es)", least_prefixed=60)

#: documents as blocks: each line one, 40 a page, types by place.
LINES = """lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT document_id, CAST(pos // 40 + 1 AS INTEGER) AS page, CAST(pos % 40 AS INTEGER) AS reading_order, line,
  CASE WHEN pos % 40 = 39 THEN 'page_footer' WHEN pos % 7 = 3 THEN 'title' WHEN pos % 11 = 5 THEN 'aside' ELSE 'paragraph' END AS type,
  CASE WHEN pos % 40 != 39 AND pos % 7 = 3 THEN 1 + pos % 2 END AS level, pos % 5 = 2 AS formula FROM lines),
full_text AS (SELECT *, line || CASE WHEN formula AND type = 'paragraph' THEN 'x=1' ELSE '' END AS t, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS stem FROM blocks),
noisy AS (SELECT *, CASE WHEN type = 'page_footer' THEN 'structural:page_footer' WHEN type = 'aside' THEN 'aside' WHEN type = 'title' AND level >= 2 THEN 'section_title'
  WHEN regexp_matches(t, '(?s)^.{0,20}$') THEN 'short' WHEN regexp_matches(t, '[%$#&*]{3}') THEN 'symbols' END AS noise FROM full_text),
annotated AS (SELECT *, CASE WHEN type NOT IN ('paragraph', 'title') THEN NULL
  WHEN type = 'title' AND regexp_matches(t, '^(The|Die|Les?) ') THEN 'chinese_number_title'
  WHEN type = 'paragraph' AND formula AND length(stem) >= 400 THEN 'formula_paragraph'
  WHEN type = 'paragraph' AND formula AND regexp_matches(stem, '^(In|Of|De)') THEN 'prefix_with_formula'
  WHEN type = 'paragraph' AND formula AND length(stem) = 0 THEN 'pure_formula'
  WHEN type = 'paragraph' AND NOT formula AND length(stem) >= 400 AND regexp_matches(stem, '^(Is|Er|La) ') THEN 'text_math_expression'
  WHEN regexp_matches(stem, '^(Th|An|Un|Es)') AND length(stem) >= 60 THEN 'question_prefix' END AS method FROM noisy),
placed AS (SELECT *, row_number() OVER w AS place, CAST(sum(CASE WHEN method IS NOT NULL AND noise IS NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) - 1 AS span FROM annotated WINDOW w AS (PARTITION BY document_id ORDER BY page, reading_order)),
spans AS (SELECT document_id, span, arg_min(method, place) AS method, count(*) AS n_blocks, min(place) AS first_block, max(place) AS last_block, string_agg(CASE WHEN t != '' THEN t END, ' ' ORDER BY place) AS text,
  list_sort(list_distinct(list(page))) AS page_list FROM placed WHERE noise IS NULL AND span >= 0 GROUP BY 1, 2)"""


def _sql(body: str) -> str:
    return f"WITH {LINES}{',' if not body.lstrip().upper().startswith('SELECT') else ''} {body}"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    kind = F.expr("CASE WHEN pos % 40 = 39 THEN 'page_footer' WHEN pos % 7 = 3 THEN 'title' WHEN pos % 11 = 5 THEN 'aside' ELSE 'paragraph' END")
    part = lambda t, c: F.struct(F.lit(t).alias("type"), c.alias("content"))
    inline = F.when((F.col("pos") % 5 == 2) & (F.col("type") == "paragraph"), F.array(part("text", F.col("line")), part("formula", F.lit("x=1")))).otherwise(F.array(part("text", F.col("line"))))
    return lines.withColumn("type", kind).select(
        "document_id",
        F.floor(F.col("pos") / 40 + 1).cast("int").alias("page"),
        (F.col("pos") % 40).alias("reading_order"),
        "type",
        F.when(F.col("type") == "title", 1 + F.col("pos") % 2).alias("level"),
        F.lit(None).cast("string").alias("text"),
        inline.alias("inlines"),
    )


def annotated(spark: SparkSession, d: str) -> DataFrame:
    return B.annotate_candidates(B.annotate_noise(blocks(spark, d), NOISE), RULES)


def spans(spark: SparkSession, d: str) -> DataFrame:
    return B.assemble_spans(annotated(spark, d))


@query("o54_noise", _sql("SELECT document_id, page, reading_order, noise FROM annotated"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).select("document_id", "page", "reading_order", "noise")


@query("o55_candidates", _sql("SELECT document_id, page, reading_order, method FROM annotated WHERE method IS NOT NULL"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).filter("method IS NOT NULL").select("document_id", "page", "reading_order", "method")


@query("o36_detection_summary", _sql("SELECT 'noise' AS kind, noise AS what, count(*) AS n FROM annotated WHERE noise IS NOT NULL GROUP BY ALL UNION ALL SELECT 'candidate', method, count(*) FROM annotated WHERE method IS NOT NULL AND noise IS NULL GROUP BY ALL"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.detection_summary(annotated(spark, d))


@query(
    "o36_detection_details",
    _sql("SELECT document_id, page, reading_order, CASE WHEN noise IS NOT NULL THEN 'noise' ELSE 'candidate' END AS kind, coalesce(noise, method) AS what, CASE WHEN noise IS NULL THEN CASE method WHEN 'prefix_with_formula' THEN 0.65 WHEN 'pure_formula' THEN 0.4 WHEN 'text_math_expression' THEN 0.5 WHEN 'question_prefix' THEN 0.5 ELSE 0.7 END END::DOUBLE AS score, CAST(NULL AS VARCHAR) AS number FROM annotated WHERE noise IS NOT NULL OR method IS NOT NULL"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.detection_details(annotated(spark, d))


@query("o56_block_texts", _sql("SELECT document_id, page, reading_order, t AS full_text, line AS plain_text, line || CASE WHEN t != line THEN '$x=1$' ELSE '' END AS marked_text FROM full_text"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.block_texts(blocks(spark, d)).select("document_id", "page", "reading_order", "full_text", "plain_text", "marked_text")


@query("o41_spans", _sql("SELECT document_id, span, n_blocks, text FROM spans"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).select("document_id", "span", "n_blocks", "text")


@query("o77_span_profile", _sql("SELECT document_id, span, method, n_blocks, first_block, last_block, array_to_string(page_list, ',') AS pages FROM spans"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.span_profile(spans(spark, d)).drop("score", "number")


@query("o40_neighbour_context", _sql("SELECT document_id, span, concat_ws(chr(10), nullif(substr(lag(text, 2) OVER w, 1, 200), ''), nullif(substr(lag(text) OVER w, 1, 200), ''), nullif(substr(lead(text) OVER w, 1, 200), ''), nullif(substr(lead(text, 2) OVER w, 1, 200), '')) AS context FROM spans WINDOW w AS (PARTITION BY document_id ORDER BY span)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.neighbour_context(spans(spark, d)).select("document_id", "span", "context")


@query("o42_block_ids", _sql("SELECT document_id, page, reading_order, printf('%d_b%05d', document_id, row_number() OVER (PARTITION BY document_id ORDER BY page, reading_order)) AS block_id FROM blocks"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return number_within(blocks(spark, d), "document_id", ["page", "reading_order"], "%d_b%05d", "block_id").select("document_id", "page", "reading_order", "block_id")


@query("o43_by_first_page", _sql("SELECT document_id, page_list[1] AS page, count(*) AS n_spans FROM spans GROUP BY 1, 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.by_first_page(spans(spark, d))


@query("o11_usable_documents", _sql("SELECT document_id FROM blocks WHERE type = 'paragraph' AND page = 1 AND trim(line) != '' GROUP BY 1 HAVING count(*) >= 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.usable_documents(blocks(spark, d))


@query("o10_markdown", _sql("SELECT document_id, coalesce(string_agg(CASE type WHEN 'title' THEN repeat('#', level) || ' ' || line WHEN 'aside' THEN '> ' || nullif(line, '') WHEN 'page_footer' THEN '---' || chr(10) || line || chr(10) || '---' ELSE line || CASE WHEN t != line THEN '$x=1$' ELSE '' END END, chr(10) || chr(10) ORDER BY page, reading_order), '') || chr(10) AS markdown FROM full_text GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.render_markdown(blocks(spark, d))


def _figure_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Content lists made of parts, a document for each brand: figures with captions, formulas with and without a picture, tables."""
    quote = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    caption = F.concat(F.lit('[{"type":"text","content":'), quote(F.col("p_name")), F.lit(',"confidence":0.5},{"type":"equation_inline","content":"x"}]'))
    picture = F.concat(F.lit('"image_source":{"path":"i/'), F.col("p_partkey").cast("string"), F.lit('.jpg"}'))
    figure = F.concat(F.lit('{"type":"figure","confidence":0.25,"content":{'), picture, F.lit(',"caption":'), caption, F.lit("}}"))
    formula = F.concat(F.lit('{"type":"equation_interline","content":{"math_content":"y_'), F.col("p_size").cast("string"), F.lit('",'), picture, F.lit("}}"))
    bare = F.lit('{"type":"equation_block","content":{"math_content":"z","math_type":"mathml"}}')
    table_ = F.lit('{"type":"table","content":{"html":""}}')
    item = F.when(F.col("p_partkey") % 4 == 0, figure).when(F.col("p_partkey") % 4 == 1, formula).when(F.col("p_partkey") % 4 == 2, bare).otherwise(table_)
    listed = table(spark, d, "part").groupBy(F.col("p_brand").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("i"))
    return ocr.blocks_of(listed.select("document_id", F.concat(F.lit("[["), F.array_join(F.transform("i", lambda x: x["item"]), ","), F.lit("]]")).alias("json")))


_PARTS = "parts AS (SELECT *, p_brand AS document_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS reading_order, CASE WHEN p_partkey % 4 < 2 THEN 'i/' || p_partkey || '.jpg' END AS path FROM part)"


@query("o10_figures", f"WITH {_PARTS} SELECT document_id, string_agg(CASE p_partkey % 4 WHEN 0 THEN '![' || p_name || '$x$](' || path || ')' WHEN 1 THEN '$$' || chr(10) || 'y_' || p_size || chr(10) || '$$' || chr(10) || '![formula](' || path || ')' WHEN 2 THEN '$$' || chr(10) || 'z' || chr(10) || '$$' ELSE '[表格: (见原始数据)]' END, chr(10) || chr(10) ORDER BY reading_order) || chr(10) AS markdown FROM parts GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.render_markdown(_figure_blocks(spark, d))


@query("o04_image_refs", f"WITH {_PARTS} SELECT document_id, CAST(reading_order AS INTEGER) AS reading_order, CASE WHEN path IS NOT NULL THEN printf('%s_img%04d', document_id, row_number() OVER (PARTITION BY document_id, path IS NULL ORDER BY reading_order)) END AS image_ref, CASE WHEN path IS NOT NULL THEN 'image/jpeg' END AS mime_type, CASE WHEN p_partkey % 4 = 0 THEN 0.25 END::DOUBLE AS confidence, CASE p_partkey % 4 WHEN 1 THEN 'latex' WHEN 2 THEN 'mathml' END AS math_type, CASE WHEN p_partkey % 4 = 0 THEN 'text:' || p_name || ':0.5|formula:x:' END AS caption FROM parts")
def _(spark: SparkSession, d: str) -> DataFrame:
    found, images = ocr.with_image_refs(_figure_blocks(spark, d))
    caption = F.array_join(F.transform("caption", lambda i: F.concat_ws(":", i["type"], i["content"], F.coalesce(i["confidence"].cast("string"), F.lit("")))), "|")
    named = found.join(images.select("image_id", "mime_type"), F.col("image_ref") == F.col("image_id"), "left")
    return named.select("document_id", F.col("reading_order").cast("int").alias("reading_order"), "image_ref", "mime_type", "confidence", "math_type", caption.alias("caption"))


def _content_lists(spark: SparkSession, d: str) -> DataFrame:
    """The blocks as one content list a document, as an OCR engine writes them."""
    b = blocks(spark, d).withColumn("inlines", F.transform("inlines", lambda i: F.struct(F.when(i["type"] == "formula", "equation_inline").otherwise(i["type"]).alias("type"), i["content"].alias("content"))))
    body = F.expr("CASE WHEN type = 'title' THEN concat('{\"title_content\":', to_json(inlines), ',\"level\":', level, '}') WHEN type = 'paragraph' THEN concat('{\"paragraph_content\":', to_json(inlines), '}') ELSE concat('{\"text_content\":', to_json(inlines), '}') END")
    kind = F.when(F.col("type") == "aside", "page_aside_text").otherwise(F.col("type"))
    item = F.concat(F.lit('{"type":"'), kind, F.lit('","bbox":[0,1,2,3],"content":'), body, F.lit("}"))
    pages = b.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("reading_order", item.alias("item")))).alias("i"))
    page = F.concat(F.lit("["), F.array_join(F.transform("i", lambda x: x["item"]), ","), F.lit("]"))
    docs = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", page.alias("p")))).alias("p"))
    return docs.select("document_id", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["p"]), ","), F.lit("]")).alias("json"))


@query("o04_content_list_blocks", _sql("SELECT document_id, page, reading_order, type, t AS full_text, level FROM full_text"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.block_texts(ocr.blocks_of(_content_lists(spark, d))).select("document_id", "page", "reading_order", "type", "full_text", F.col("level").cast("bigint").alias("level"))


@query("o05_type_counts", "SELECT CASE WHEN event_type IN ('title', 'table') THEN event_type ELSE 'unknown' END AS type, CASE WHEN event_id % 3 = 0 THEN 'image/jpeg' WHEN event_id % 3 = 1 THEN 'image/svg+xml' ELSE 'image/png' END AS mime, count(*) AS n FROM events GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("a/b."), F.expr("CASE event_id % 3 WHEN 0 THEN 'JPG' WHEN 1 THEN 'svg' ELSE 'tiff' END"))
    e = table(spark, d, "events").select(ocr.mapped(F.col("event_type"), ocr.BLOCK_TYPES, ocr.UNKNOWN).alias("type"), ocr.mime_type(path).alias("mime"))
    return e.groupBy("type", "mime").agg(F.count("*").alias("n"))


@query("o06_flatten_tables", "SELECT p_partkey AS document_id, CASE WHEN length(p_name || ' $x' || p_size || '$ ' || p_brand || ' & ' || p_type) >= 5 THEN 'text:' || p_name || '|formula:x' || p_size || '|text:' || p_brand || ' & ' || p_type END AS inlines FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><td>"), "p_name", F.lit(" $x"), "p_size", F.lit("$</td> <td class='a'>"), "p_brand", F.lit(" &amp; "), "p_type", F.lit("</td></tr></table>"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.lit("table").alias("type"), html.alias("html"), F.lit(None).cast(ocr.INLINE).alias("inlines"))
    flat = F.array_join(F.transform("inlines", lambda i: F.concat(i["type"], F.lit(":"), i["content"])), "|")
    return ocr.flatten_tables(b).filter("type = 'paragraph'").select("document_id", flat.alias("inlines"))


@query("o07_content_text", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'a' || event_type WHEN 2 THEN 'x' || event_type ELSE '' END AS text FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN concat('{"text_content":[{"content":"a"},"', event_type, '"]}') WHEN 2 THEN concat('{"text":"x', event_type, '"}') ELSE '{"other":1}' END""")
    return table(spark, d, "events").select("event_id", ocr.content_text(raw).alias("text"))


@query("o08_export_items", model_sql(f"x AS (SELECT l.item_id, string_agg(t.name || '/' || l.role, ';' ORDER BY t.id) AS topics FROM links l JOIN items i ON l.item_id = i.id JOIN {CHAIN} ON l.topic_id = t.id WHERE c.subject_id = i.subject_id GROUP BY 1) SELECT i.id, s.name AS subject_name, i.content, coalesce(x.topics, '') AS topics FROM items i JOIN subjects s ON s.id = i.subject_id LEFT JOIN x ON x.item_id = i.id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    out = bank.export_bank(m.subjects, m.chapters, m.topics, m.items, m.links)[1]
    return out.select("id", "subject_name", "content", F.array_join(F.transform("topics", lambda t: F.concat_ws("/", t["name"], t["role"])), ";").alias("topics"))


@query("o08_export_chapter", model_sql("SELECT i.id, (SELECT count(*) FROM links l JOIN topics t ON l.topic_id = t.id WHERE l.item_id = i.id AND t.chapter_id = 8) AS n_topics FROM items i WHERE i.subject_id = 3 AND EXISTS (SELECT 1 FROM links l JOIN topics t ON l.topic_id = t.id WHERE l.item_id = i.id AND t.chapter_id = 8)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    out = bank.export_bank(m.subjects, m.chapters, m.topics, m.items, m.links, subject=3, chapter=8)[1]
    return out.select("id", F.size("topics").cast("bigint").alias("n_topics"))


#: Items (or topics of a chapter) in one bank file, about.
PER_FILE = 5000


def _bank_documents(m: Model) -> DataFrame:
    """The bank as documents of bounded size: a subject's items by hash, and a chapter's topics by hash."""
    _, items = bank.export_bank(m.subjects, m.chapters, m.topics, m.items, m.links)

    def bucket(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // PER_FILE)))).alias("bucket")

    questions = items.groupBy("subject_name", bucket("id", m.items.count())).agg(F.collect_list(F.struct(*[c for c in items.columns if c != "id"])).alias("questions"))
    chapters = m.chapters.select(F.col("id").alias("chapter_id"), F.col("subject_id"), F.col("name").alias("chapter"))
    topics = m.topics.select("chapter_id", F.col("id").alias("topic_id"), F.col("name").alias("topic"))
    named = m.subjects.select(F.col("id").alias("subject_id"), "name").join(chapters, "subject_id", "left").join(topics, "chapter_id", "left")
    parts = named.groupBy("name", "chapter", bucket("topic_id", m.topics.count())).agg(F.collect_list(F.when(F.col("topic_id").isNotNull(), F.struct(F.col("topic").alias("name")))).alias("topics"))
    tree = parts.select(F.array(F.struct("name", F.when(F.col("chapter").isNotNull(), F.array(F.struct(F.col("chapter").alias("name"), "topics"))).alias("chapters"))).alias("subjects"))
    return tree.unionByName(questions.select("questions"), allowMissingColumns=True)


@query("o03_read_bank", model_sql(f"SELECT s.name AS subject_name, count(*) AS n_entries, CAST(sum(n) AS BIGINT) AS n_topics FROM (SELECT i.id, i.subject_id, count(t.id) AS n FROM items i LEFT JOIN (SELECT l.item_id, t.id, c.subject_id FROM links l JOIN {CHAIN} ON l.topic_id = t.id) t ON t.item_id = i.id AND t.subject_id = i.subject_id GROUP BY 1, 2) x JOIN subjects s ON s.id = x.subject_id GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    path = f"{shared_dir(spark)}/bank-{uuid.uuid4().hex}"
    _bank_documents(m).write.option("maxRecordsPerFile", 1).json(path)
    _, found = bank.read_bank(spark, path)
    return found.groupBy("subject_name").agg(F.count("*").alias("n_entries"), F.sum(F.size("topics")).cast("bigint").alias("n_topics"))


@query("o09_merge_records", "SELECT doc_id AS entry_id, 'empty content' AS reason FROM documents WHERE trim(coalesce(CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END, '')) = ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text")).alias("content"))
    return bank.merge_records(docs)[1]


@query("o57_split_batches", r"""WITH parts AS (SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
cut AS (SELECT conv_id, list_filter(list_transform(string_split(t, chr(10) || '---' || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x != '') AS p FROM parts)
SELECT conv_id, unnest(p) AS content, CAST(unnest(range(0, len(p))) AS INTEGER) AS at FROM cut""")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n---\n").alias("text"))
    return T.split_batches(texts).select("conv_id", "content", "at")


@query("o60_formula_frequency", r"""WITH t AS (SELECT 'a $x_' || (event_id % 7) || '$ b $$y=' || (event_id % 3) || '$$ c' AS text FROM events),
f AS (SELECT 'display' AS kind, unnest(regexp_extract_all(text, '(?s)\$\$(.+?)\$\$', 1)) AS formula FROM t UNION ALL SELECT 'inline', unnest(regexp_extract_all(text, '\$([^$]+?)\$', 1)) FROM t)
SELECT kind, trim(formula) AS formula, count(*) AS n FROM f GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = e.select("event_id", F.concat(F.lit("a $x_"), F.col("event_id") % 7, F.lit("$ b $$y="), F.col("event_id") % 3, F.lit("$$ c")).alias("text"))
    return T.formula_frequency(T.formula_inventory(t, "event_id"))


@query("o61_item_numbers", "SELECT event_id, nullif(regexp_extract(CASE WHEN event_id % 3 = 0 THEN '第 ' || event_id || '题' WHEN event_id % 3 = 1 THEN event_id || '. ' || event_type ELSE event_type END, '^(?:第\\s*)?(\\d{1,4})', 1), '') AS number FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE WHEN event_id % 3 = 0 THEN concat('第 ', event_id, '题') WHEN event_id % 3 = 1 THEN concat(event_id, '. ', event_type) ELSE event_type END")
    return table(spark, d, "events").select("event_id", T.item_number(t).alias("number"))


@query("o63_incomplete_stems", "SELECT event_id, length(t) < 8 OR regexp_matches(t, '^[\\d(][\\d\\s().]*$') AS needs_review FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id || '.' WHEN 1 THEN event_type ELSE event_type || ' of ' || user_id END AS t FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE event_id % 3 WHEN 0 THEN concat(event_id, '.') WHEN 1 THEN event_type ELSE concat(event_type, ' of ', user_id) END")
    return T.flag_incomplete(table(spark, d, "events").select("event_id", t.alias("content"))).select("event_id", "needs_review")


@query("o64_page_lists", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id || ',' || user_id WHEN 1 THEN user_id || ',7' WHEN 2 THEN '' END AS pages FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE event_id % 4 WHEN 0 THEN concat('[', event_id, ', \"', user_id, '\"]') WHEN 1 THEN concat('p.', user_id, ' and 7') WHEN 2 THEN '[]' END")
    return table(spark, d, "events").select("event_id", F.array_join(T.page_list(t), ",").alias("pages"))


_LATEX = "event_id % 3 = 0"


def _latex_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("\\documentclass{article}\n\\section{A {nested} one} \\textbf{"), "event_type", F.lit("} and \\[x^2\\] \\quad "), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", "event_type", F.when(F.expr(_LATEX), t).otherwise(F.concat("event_type", F.lit(" as it is"))).alias("text"))


@query("o58_clean_corpus", f"SELECT event_id, CASE WHEN {_LATEX} THEN '**' || event_type || '** and $$x^2$$   ' || user_id ELSE event_type || ' as it is' END AS cleaned FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.clean_corpus(_latex_texts(spark, d))[0].select("event_id", "cleaned")


@query("o58_clean_changes", f"SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE {_LATEX}) AS n_changed FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.clean_corpus(_latex_texts(spark, d), source="event_type")[1]


@query(
    "o59_delimit_formulas",
    r"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || ': $\frac{a}{b_{1}} + \sqrt{x}$, then $\pi$ and $\alpha^2$' WHEN 1 THEN event_type || '; $\frac{a{b{c{d{' || user_id || '}}}}} + \max(f(g(x)))$, end'
WHEN 2 THEN event_type || ': $\alpha $x_{' || user_id || '}$ \beta$' WHEN 3 THEN '$\gamma $$$a, b$$ $\delta_1 $$y$, ' || event_type ELSE event_type END AS delimited FROM events""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    plain = F.concat("event_type", F.lit(": \\frac{a}{b_{1}} + \\sqrt{x}, then $\\pi$ and \\alpha^2"))
    deep = F.concat("event_type", F.lit("; \\frac{a{b{c{d{"), "user_id", F.lit("}}}}} + \\max(f(g(x))), end"))
    between = F.concat("event_type", F.lit(": \\alpha $x_{"), "user_id", F.lit("}$ \\beta"))
    beside = F.concat(F.lit("\\gamma $$a, b$$ \\delta_1 $y$, "), "event_type")
    t = F.col("event_type")
    for k, text in enumerate((plain, deep, between, beside)):
        t = F.when(F.col("event_id") % 5 == k, text).otherwise(t)
    return T.delimit_formulas(e.select("event_id", t.alias("text"))).select("event_id", "delimited")


@query("o62_to_entries", _sql("SELECT document_id * 100000 + span AS entry_id, CASE WHEN document_id % 2 = 0 THEN 'S' || document_id % 3 ELSE 'uncategorised' END AS subject_name, coalesce(nullif(regexp_extract(text, '^(?:第\\s*)?(\\d{1,4})', 1), ''), CAST(span + 1 AS VARCHAR)) AS question_number, page_list[1] AS source_page FROM spans WHERE trim(text) != ''"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    enriched = s.select((F.col("document_id") * 100000 + F.col("span")).alias("entry_id"), F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("S"), F.col("document_id") % 3)).alias("subject_name"), F.col("text").alias("content"), F.lit("").alias("question_number"), F.col("number").alias("detected_number"), F.col("span").alias("at"), F.lit(0).alias("source_page"), "pages")
    return T.to_entries(enriched).select("entry_id", "subject_name", "question_number", "source_page")


@query("o37_hierarchy_text", model_sql("c AS (SELECT c.subject_id, c.sort_order, c.id, '  ' || c.name || ': ' || coalesce((SELECT string_agg(t.name, ', ' ORDER BY t.sort_order) FROM topics t WHERE t.chapter_id = c.id), '') AS line FROM chapters c) SELECT s.name AS subject, 'Subject: ' || s.name || chr(10) || string_agg(c.line, chr(10) ORDER BY c.sort_order, c.id) AS catalogue FROM subjects s JOIN c ON c.subject_id = s.id GROUP BY s.name"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return N.hierarchy_text(m.subjects, m.chapters, m.topics)


@query("o72_page_prompts", _sql("SELECT document_id, page_list[1] AS page, 'Split this page into questions.' || chr(10) || 'Catalogue' || chr(10) || string_agg('[' || (span + 1) || '] ' || text, chr(10) ORDER BY span) AS prompt FROM spans GROUP BY 1, 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.prompt_table(spans(spark, d), "Catalogue", "page")


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, d, "conversations")
    requests = turns.filter("role = 'user'").select(F.lit("s").alias("subject_name"), F.col("text").alias("content"))
    cache = turns.filter("conv_id % 2 = 0").select(F.md5(F.concat(F.lit("s:"), "text").cast("binary")).alias("content_hash"), F.lit("{}").alias("response_json"))
    return requests, cache


@query("o73_cache_hits", "SELECT md5('s:' || text) AS content_hash, text AS content, '{}' AS response_json FROM conversations WHERE role = 'user' AND md5('s:' || text) IN (SELECT md5('s:' || text) FROM conversations WHERE conv_id % 2 = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    requests, cache = _requests(spark, d)
    return N.split_by_cache(requests, cache)[0].select("content_hash", "content", "response_json")


@query("o73_cache_pending", "SELECT DISTINCT md5('s:' || text) AS content_hash, 's' AS subject_name, text AS content FROM conversations WHERE role = 'user' AND md5('s:' || text) NOT IN (SELECT md5('s:' || text) FROM conversations WHERE conv_id % 2 = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.split_by_cache(*_requests(spark, d))[1]


@query("o74_pending", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type != 'error')")
def _(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "events").select(F.col("event_id").alias("item_id"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return N.pending(table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id")), done)


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses made of events: plain, fenced, with prose, with bad escapes, cut off, empty."""
    body = F.expr("""concat('{"questions":[{"content":"c', event_id, '","question_number":"1","question_type":"', CASE WHEN user_id % 5 = 0 THEN 'riddle' ELSE 'proof' END, '","subject_name":"s","source_page":', user_id % 3, ',"knowledge_points":[{"name":"k","chapter":"c","role":"', CASE WHEN user_id % 7 = 0 THEN 'secondary' ELSE 'primary' END, '","weight":', CASE WHEN user_id % 11 = 0 THEN '1.5' ELSE '0.5' END, '}]}]}')""")
    shown = F.when(F.col("event_id") % 6 == 0, body).when(F.col("event_id") % 6 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 6 == 2, F.concat(F.lit("Here: "), body, F.lit(" Done."))).when(F.col("event_id") % 6 == 3, F.replace(body, F.lit('"content":"c'), F.lit('"content":"\\sqrt c'))).when(F.col("event_id") % 6 == 4, F.substring(body, 1, 30)).otherwise("  ")
    return table(spark, d, "events").select(F.col("event_id").alias("response_id"), shown.alias("response"))


@query("o69_parse_status", "SELECT CASE event_id % 6 WHEN 2 THEN 'object' WHEN 3 THEN 'repaired' ELSE 'direct' END AS status, count(*) AS n FROM events WHERE event_id % 6 < 4 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.parse_responses(_responses(spark, d))[0].groupBy("status").agg(F.count("*").alias("n"))


@query("o69_parse_failures", "SELECT event_id AS response_id, CASE WHEN event_id % 6 = 5 THEN 'empty' ELSE 'no JSON' END AS error FROM events WHERE event_id % 6 >= 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.parse_responses(_responses(spark, d))[1].select("response_id", "error")


@query("o70_rejected_records", "SELECT event_id AS response_id, concat_ws(',', CASE WHEN user_id % 5 = 0 THEN 'type' END, CASE WHEN user_id % 7 = 0 THEN 'primary' END, CASE WHEN user_id % 11 = 0 THEN 'weight' END, CASE WHEN user_id % 3 = 0 THEN 'page' END) AS broken FROM events WHERE event_id % 6 < 4 AND (user_id % 5 = 0 OR user_id % 7 = 0 OR user_id % 11 = 0 OR user_id % 3 = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.validate_responses(N.parse_responses(_responses(spark, d))[0])[1].select("response_id", F.array_join("broken", ",").alias("broken"))


def _kinds_of_responses(spark: SparkSession, d: str) -> DataFrame:
    """Parsed responses of three kinds, and of a fourth that no rule knows, from sources by event type."""
    split = """concat('{"questions":[{"question_number":null,"content":"', if(event_id % 4 = 0, ' ', 'c'), '","page":', user_id % 2, ',"is_noise":false},{"content":"n","is_noise":', if(event_id % 3 = 0, '"maybe"', 'true'), '}]}')"""
    groups = """concat('[{"canonical":"', if(user_id % 3 = 0, '', 'k'), '","duplicates":[', if(user_id % 4 = 0, '', '"d"'), ']}]')"""
    enrich = """if(user_id % 5 = 0, '{"questions":[]}', if(user_id % 5 = 1, '[1]', '{"questions":[{"content":7,"subject_name":"s","knowledge_points":[{"name":"k","chapter":"c","role":"primary","weight":1},{"name":"","chapter":"c","role":"tertiary","weight":-1}]}]}'))"""
    e = table(spark, d, "events")
    body = F.expr(f"CASE event_id % 7 WHEN 0 THEN {enrich} WHEN 1 THEN {groups} WHEN 2 THEN '{{}}' ELSE {split} END")
    return e.select(F.col("event_id").alias("response_id"), F.col("event_type").alias("source"), F.expr("CASE event_id % 7 WHEN 0 THEN 'enrich' WHEN 1 THEN 'groups' WHEN 2 THEN 'poem' ELSE 'split' END").alias("record"), body.alias("json"))


_FAILURES = """e AS (SELECT *, event_id % 7 AS k FROM events), f AS (
  SELECT event_type, 'split' AS record, unnest([CASE WHEN event_id % 4 = 0 THEN 'content' END, CASE WHEN user_id % 2 = 0 THEN 'page' END, CASE WHEN event_id % 3 = 0 THEN 'noise' END]) AS rule FROM e WHERE k > 2
  UNION ALL SELECT event_type, 'groups', unnest([CASE WHEN user_id % 3 = 0 THEN 'canonical' END, CASE WHEN user_id % 4 = 0 THEN 'duplicates' END]) FROM e WHERE k = 1
  UNION ALL SELECT event_type, 'poem', 'record' FROM e WHERE k = 2
  UNION ALL SELECT event_type, 'enrich', unnest(CASE WHEN user_id % 5 < 2 THEN ['records'] ELSE ['content', 'topic_name', 'role', 'weight'] END) FROM e WHERE k = 0)"""


@query("o70_failure_counts", f"WITH {_FAILURES} SELECT event_type AS source, record, rule, count(*) AS n FROM f WHERE rule IS NOT NULL GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    rejected = N.validate_responses(_kinds_of_responses(spark, d), record="record")[1]
    return V.failure_counts(rejected, ["source"])


@query("o70_valid_splits", "SELECT event_id AS response_id, k AS at, CASE k WHEN 0 THEN 'c' ELSE 'n' END AS content, CASE k WHEN 0 THEN 1 END::INTEGER AS page, k = 1 AS is_noise FROM events, (VALUES (0), (1)) p(k) WHERE event_id % 7 > 2 AND CASE k WHEN 0 THEN event_id % 4 != 0 AND user_id % 2 = 1 ELSE event_id % 3 != 0 END")
def _(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = N.validate_responses(_kinds_of_responses(spark, d), record="record")
    return V.typed(valid, "split").select("response_id", "at", "q.content", "q.page", "q.is_noise")


@query("o51_duplicate_groups", "SELECT event_id AS response_id, 'k' AS canonical, 'd' AS duplicates FROM events WHERE event_id % 7 = 1 AND user_id % 3 != 0 AND user_id % 4 != 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = N.duplicate_groups(_kinds_of_responses(spark, d).filter("record = 'groups'"))
    return found.select("group_id.response_id", "canonical", F.array_join("duplicates", ",").alias("duplicates"))


@query("o71_apply_splits", _sql("pages AS (SELECT document_id, page_list[1] AS page, count(*) AS n FROM spans GROUP BY 1, 2), split AS (SELECT document_id, page, 'response' AS origin, 1 AS n FROM pages WHERE document_id % 2 = 0), rules AS (SELECT document_id, page, 'rules' AS origin, n FROM pages WHERE document_id % 2 = 1) SELECT document_id, page, origin, CAST(n AS BIGINT) AS n FROM (SELECT * FROM split UNION ALL SELECT * FROM rules)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = materialize(spans(spark, d), "spans")
    pages = B.by_first_page(s)
    body = F.lit('{"questions":[{"question_number":"1","content":"q","page":1,"is_noise":false},{"content":"n","is_noise":true,"noise_reason":"x"}]}')
    parsed = pages.filter("document_id % 2 = 0").select("document_id", "page", body.alias("json"))
    return N.apply_splits(parsed, s, pages.filter("document_id % 2 = 1")).groupBy("document_id", "page", "origin").agg(F.count("*").alias("n"))


@query("o75_mark_stream", model_sql(f"{_MARKS} SELECT item_id, arg_max(level, (ts, mark_id)) AS level, max(ts) AS ts FROM marks WHERE level BETWEEN 0 AND 5 GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    out = f"{shared_dir(spark)}/marks-{uuid.uuid4().hex}"
    m = Model(spark, d)
    marks(m).repartitionByRange(4, "ts").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(marks(m).schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/in")
    streams.mark_stream(stream, f"{out}/checkpoint").awaitTermination()
    return streams.latest_of(spark, f"{out}/checkpoint").select("item_id", "level", F.col("ts").cast("timestamp_ntz").alias("ts"))


def _imported(spark: SparkSession, d: str) -> str:
    """The folder of an import of all entries, whose files hold pages in any order."""
    out = f"{shared_dir(spark)}/imports-{uuid.uuid4().hex}"
    m = Model(spark, d)
    given = materialize(paged_entries(m), "paged")
    files = max(4, -(-given.count() // TASK_ROWS))
    streams.with_page_plan(given).repartition(files, "entry_id").write.parquet(f"{out}/in")
    discard(given)
    planned = spark.read.parquet(f"{out}/in")
    stream = spark.readStream.schema(planned.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{out}/in")
    accept = lambda b: R.accept_entries(b, R.resolve_topics(b, m.aliases, m.topics, m.chapters, m.subjects), m.subjects)
    streams.import_stream(stream, accept, next_id(m.items), f"{out}/out", f"{out}/checkpoint").awaitTermination()
    return f"{out}/out"


@query("o79_import_stream", model_sql(f"{_ENTRIES} SELECT r.entry_id, count(DISTINCT r.topic_id) AS n_links FROM state s JOIN resolved r ON r.entry_id = s.entry_id WHERE s.subject_id IS NOT NULL AND n_lost = 0 GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    out = _imported(spark, d)
    links = spark.read.parquet(f"{out}/links").groupBy("item_id").agg(F.count("*").alias("n_links"))
    return spark.read.parquet(f"{out}/items").join(links, F.col("id") == F.col("item_id")).select("entry_id", "n_links")


@query("o79_page_totals", model_sql(f"{_ENTRIES}, {PAGED} SELECT document_id, page, imported, skipped, CAST(sum(imported) OVER w AS BIGINT) AS imported_so_far, CAST(sum(skipped) OVER w AS BIGINT) AS skipped_so_far FROM (SELECT document_id, page, count(*) FILTER (WHERE good) AS imported, count(*) FILTER (WHERE NOT good) AS skipped FROM outcomes GROUP BY 1, 2) WINDOW w AS (PARTITION BY document_id ORDER BY page)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.import_totals(spark, _imported(spark, d))
