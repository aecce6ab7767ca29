"""Line dedup with a log-template tree, in DataFrame functions only.

A line's tokens are its words; tokens with a digit become ``<*>`` at once. The
tree has a fixed depth: the token count, then the LEADING first tokens; its
leaves hold lines of like form. Inside a leaf whose lines occur in enough
documents, a token stays constant where its (place, token) occurs in enough of
them and is generalised to ``<*>`` elsewhere; a line of which less than
LEAST_CONSTANT is constant is its own template. A template found in MIN_TEXTS
different texts or more recurs: its lines stay in the first document that has
them, by doc_id, and are dropped from all others.

Copies of one whole text count once, so that a document isn't taken for
boilerplate only for being copied; whole copies are the near-duplicate step's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.session import discard, materialize, quoted

MIN_TEXTS = 10
LEADING = 3
LEAST_CONSTANT = 0.7
_DROPS, _LINES = "_line_places_to_drop", "_lines_of_text"
#: Most document ids that are broadcast to pick texts: 8 bytes each.
BROADCAST_IDS = 500_000
VARIABLE = "<*>"


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: doc_id, text_id, place, masked line, leaf and line_id."""
    text = F.col("text")
    plain = F.when(text.rlike(r"[\x09\x0B-\x0D]|\x20\x20|\x20\n|\n\x20|^\x20|\x20$"), F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), r"(?<![^\n])\x20|\x20(?![^\n])", "")).otherwise(text)
    # Masked inside the generator, so that each line is masked once for all its keys; outer,
    # as Spark would else cut the text a second time to see whether there are lines.
    cut = docs.filter(text.isNotNull()).select("doc_id", F.xxhash64("text", F.length("text")).alias("text_id"), F.posexplode_outer(F.transform(F.split(plain, "\n", -1), _masked)).alias("place", "line"))
    leaf = F.xxhash64(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))), F.substring_index("line", " ", LEADING))
    return cut.filter("line != ''").select("doc_id", "text_id", "place", "line", leaf.alias("leaf"), F.xxhash64("line", F.length("line")).alias("line_id"))


def _masked(line: Column) -> Column:
    """A line of words with single spaces between, those with a digit generalised.

    A line that would be variable for more than half of its words stays as it is.
    """
    masked = F.regexp_replace(line, "[^ ]*[0-9][^ ]*", VARIABLE)
    variable = (F.length(masked) - F.length(F.replace(masked, F.lit(VARIABLE), F.lit("")))) / len(VARIABLE)
    n_words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.when(line.rlike("[0-9]"), F.when(2 * variable <= n_words, masked).otherwise(line)).otherwise(line)


def templates(docs: DataFrame, lines: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The recurring lines: line_id, template and keeper, the doc_id that keeps its lines.

    ``lines`` is the written table of the documents' lines, without their words.
    """
    # A text's copies count once: only fixed-width keys are shuffled here.
    seen = lines.groupBy("leaf", "line_id", "text_id").agg(F.min("doc_id").alias("doc_id"))
    seen = materialize(seen, "line-texts")
    leaves = seen.select("leaf", "text_id").distinct().groupBy("leaf").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_texts).select(F.col("leaf").alias("busy"))
    by_line = seen.groupBy("leaf", "line_id").agg(F.count("*").alias("texts"), F.min("doc_id").alias("doc_id"))
    by_line = materialize(by_line.join(leaves, F.col("leaf") == F.col("busy"), "left_semi"), "busy-lines")

    # The tokens of one document's copy of each line in a busy leaf: only these documents are cut again.
    wanted = by_line.select(F.col("line_id").alias("l"), F.col("doc_id").alias("d"), "texts")
    ids = wanted.select(F.col("d").alias("i")).distinct()
    some = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("i"), "left_semi") if ids.count() <= BROADCAST_IDS else docs
    tokens = _lines(some).select("doc_id", "leaf", "line_id", "line").join(wanted, (F.col("line_id") == F.col("l")) & (F.col("doc_id") == F.col("d")))
    tokens = tokens.dropDuplicates(["line_id"]).select("leaf", "line_id", "texts", F.posexplode(F.split("line", " ", -1)).alias("at", "token"))
    tokens = materialize(tokens, "leaf-tokens")
    token_id = F.xxhash64("token")
    support = tokens.groupBy("leaf", "at", token_id.alias("token_id")).agg(F.sum("texts").alias("support"))
    keys = support.select(F.col("leaf").alias("kl"), F.col("at").alias("ka"), F.col("token_id").alias("kt"), "support")
    marked = tokens.withColumn("token_id", token_id).join(keys, (F.col("leaf") == F.col("kl")) & (F.col("at") == F.col("ka")) & (F.col("token_id") == F.col("kt")))
    constant = (F.col("support") >= min_texts) & (F.col("token") != VARIABLE)
    # An order-free fingerprint of the constant (place, token) pairs.
    part = F.xxhash64("at", "token_id").bitwiseAND(F.lit((1 << 40) - 1))
    shape = marked.groupBy("leaf", "line_id").agg(F.count("*").alias("n"), F.count_if(constant).alias("constant"), F.sum(F.when(constant, part).otherwise(0)).alias("print"))
    general = F.col("constant") >= LEAST_CONSTANT * F.col("n")
    template = F.when(general, F.xxhash64("leaf", "constant", "print")).otherwise(F.col("line_id"))
    named = shape.select("line_id", template.alias("template"))

    of_line = materialize(by_line.join(named, "line_id").select("line_id", "template"), "line-templates")
    found = seen.join(of_line, "line_id").select("template", "text_id", "doc_id")
    found = found.groupBy("template", "text_id").agg(F.min("doc_id").alias("doc_id"))
    found = found.groupBy("template").agg(F.count("*").alias("texts"), F.min("doc_id").alias("keeper")).filter(F.col("texts") >= min_texts)
    out = materialize(of_line.join(found, "template").select("line_id", "template", "keeper", "texts"), "templates")
    discard(seen, by_line, tokens, of_line)
    return out


def dropped_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """doc_id, place and template of each line to drop."""
    docs = docs.select("doc_id", "text")
    lines = materialize(_lines(docs).select("doc_id", "text_id", "place", "leaf", "line_id"), "lines")
    recurring = templates(docs, lines, min_texts).select(F.col("line_id").alias("l"), "template", "keeper")
    return lines.join(recurring, F.col("line_id") == F.col("l")).filter("doc_id != keeper").select("doc_id", "place", "template")


def _kept(lines: Column, drops: Column) -> Column:
    """The lines between the sorted places to drop, joined again."""
    begins, ends = F.concat(F.array(F.lit(0)), F.transform(drops, lambda d: d + 1)), F.concat(drops, F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(lines, b + 1, e - b))), "\n")


def dedup_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The documents without the lines of recurring templates, with n_dropped.

    ``docs`` has doc_id and text; all columns are kept, text changed, and one that
    is called n_dropped replaced. Lines are cut
    at ``\\n``; those without a word neither count nor go. A null or empty text
    stays. A text all of whose lines go becomes empty; no document goes. Rows that
    share a doc_id count as one document and lose the same line places. Ties of the
    first document don't arise: it is the least doc_id. The lines of rows without a
    doc_id count, but stay.
    """
    drops = dropped_lines(docs, min_texts).groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias(_DROPS))
    joined = docs.join(drops, "doc_id", "left").withColumn(_LINES, F.when(F.col(_DROPS).isNotNull(), F.split("text", "\n", -1)))
    text = F.when(F.col(_DROPS).isNull(), F.col("text")).otherwise(_kept(F.col(_LINES), F.col(_DROPS)))
    own = [text.alias("text") if c == "text" else named for c, named in zip(docs.columns, quoted(docs), strict=True) if c != "n_dropped"]
    return joined.select(*own, F.coalesce(F.array_size(_DROPS), F.lit(0)).cast("long").alias("n_dropped"))


#: The line dedup with the default parameters as SQL: counts and digests by document.
ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL),
plain AS (SELECT doc_id, text, place, trim(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS line FROM split),
masked AS (SELECT doc_id, text, place, CASE WHEN 2 * len(regexp_extract_all(line, '[^ ]*[0-9][^ ]*')) <= len(string_split(line, ' ')) THEN regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE line END AS line FROM plain WHERE line != ''),
lines AS (SELECT *, len(string_split(line, ' ')) || ' ' || array_to_string(list_slice(string_split(line, ' '), 1, 3), ' ') AS leaf FROM masked),
busy AS (SELECT leaf FROM lines GROUP BY 1 HAVING count(DISTINCT text) >= 10),
by_line AS (SELECT leaf, line, count(DISTINCT text) AS texts FROM lines WHERE leaf IN (SELECT leaf FROM busy) GROUP BY 1, 2),
tokens AS (SELECT leaf, line, texts, unnest(string_split(line, ' ')) AS token, unnest(range(0, len(string_split(line, ' ')))) AS spot FROM by_line),
marked AS (SELECT *, sum(texts) OVER (PARTITION BY leaf, spot, token) >= 10 AND token != '<*>' AS constant FROM tokens),
shapes AS (SELECT leaf, line, count(*) AS n, count(*) FILTER (WHERE constant) AS n_constant, string_agg(CASE WHEN constant THEN spot || '=' || token END, ' ' ORDER BY spot) AS shape FROM marked GROUP BY 1, 2),
named AS (SELECT line, CASE WHEN n_constant >= 0.7 * n THEN 'T' || leaf || chr(10) || coalesce(shape, '') ELSE 'L' || line END AS template FROM shapes),
recurring AS (SELECT template, min(doc_id) AS keeper FROM lines JOIN named USING (line) GROUP BY 1 HAVING count(DISTINCT text) >= 10),
drops AS (SELECT DISTINCT doc_id, place FROM lines JOIN named USING (line) JOIN recurring USING (template) WHERE doc_id != keeper),
kept AS (SELECT s.doc_id, string_agg(s.raw, chr(10) ORDER BY s.place) AS text FROM split s WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.doc_id = s.doc_id AND d.place = s.place) GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n FROM drops GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_dropped, sha256(CASE WHEN d.text IS NULL THEN '' ELSE coalesce(k.text, '') END) AS text_sha256,
  CASE WHEN d.text IS NOT NULL THEN CAST(length(coalesce(k.text, '')) AS BIGINT) END AS n_chars_left
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""
