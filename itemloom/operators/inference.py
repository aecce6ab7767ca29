"""Tables of prompts and of responses of a model that runs elsewhere."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from itemloom.functions.text import strip
from itemloom.operators.validation import typed, validate_responses
from itemloom.session import quoted

def hierarchy_text(subjects: DataFrame, chapters: DataFrame, topics: DataFrame, only: str | None = None) -> DataFrame:
    """The catalogue of each subject as indented text, by sort order."""
    s = subjects if only is None else subjects.filter(F.col("name") == only)
    s = s.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    t = topics.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "id", "name"))).alias("t"))
    c = chapters.select(F.col("id").alias("chapter_id"), "subject_id", F.col("name").alias("chapter"), "sort_order").join(t, "chapter_id", "left")
    line = F.concat(F.lit("  "), "chapter", F.lit(": "), F.coalesce(F.array_join(F.transform("t", lambda x: x["name"]), ", "), F.lit("")))
    grouped = c.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "chapter_id", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("Subject: "), "subject", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return s.join(grouped, "subject_id").select("subject", text.alias("catalogue"))


def prompt_table(spans: DataFrame, catalogue: str, kind: str = "item") -> DataFrame:
    """Prompts for spans (item), for the spans of a page (page), or of a document (combined)."""
    head = {"item": "Enrich this question.", "page": "Split this page into questions.", "combined": "Enrich these questions."}[kind]
    if kind == "item":
        return spans.select("document_id", "span", F.concat_ws("\n", F.lit(head), F.lit(catalogue), F.nullif(F.concat(F.lit("Context: "), "context"), F.lit("Context: ")), F.concat(F.lit("Question: "), "text")).alias("prompt"))
    keys = ["document_id", "page"] if kind == "page" else ["document_id"]
    paged = spans.withColumn("page", F.get("pages", F.lit(0)))
    listed = paged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("span", "text"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), x["span"] + 1, F.lit("] "), x["text"])), "\n")
    return listed.select(*keys, F.concat_ws("\n", F.lit(head), F.lit(catalogue), body).alias("prompt"))


def split_by_cache(requests: DataFrame, cache: DataFrame, with_subject: bool = True) -> tuple[DataFrame, DataFrame]:
    """Requests (subject_name, content) that the cache answers, and the distinct pending ones."""
    key = F.md5((F.concat("subject_name", F.lit(":"), "content") if with_subject else F.col("content")).cast("binary"))
    keyed = requests.withColumn("content_hash", key)
    known = cache.groupBy("content_hash").agg(F.max("response_json").alias("response_json"))
    pending = keyed.join(known, "content_hash", "left_anti").select("content_hash", "subject_name", "content").dropDuplicates(["content_hash"])
    return keyed.join(known, "content_hash"), pending


def pending(items: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Items still to do: those without a done record that isn't an error, or all."""
    return items if force else items.join(done.filter("error IS NULL").select("item_id"), "item_id", "left_anti")


_ESCAPES = set('"\\/bfnrtu')
_OUTERMOST = (("object", "{", "}"), ("array", "[", "]"))


def _repair(text: str) -> str:
    """Double each backslash that begins no JSON escape."""
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        good = k + 1 < len(text) and text[k + 1] in _ESCAPES
        out.append(text[k : k + 2] if good else "\\\\")
        at = k + 2 if good else k + 1
    return "".join(out) + text[at:]


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


#: The opening line of a fence around a whole text, and its closing one.
_FENCE = re.compile(r"\A```[^\n]*(?:\n|\Z)|\n[^\S\n]*```\Z")
#: The first line that opens a JSON value, and all behind it.
_OPENS = re.compile(r"^[^\S\n]*[{\[]", re.MULTILINE)


def _without_fences(text: str) -> str:
    text = text.strip()
    return _FENCE.sub("", text).strip() if text.startswith("```") else text


def _find_json(text: str) -> tuple[str, str] | None:
    """How JSON was found in a text, and the JSON: the first way that gives some."""

    def tries() -> Iterator[tuple[str, str]]:
        yield "direct", text
        yield "repaired", _repair(text)
        for name, opens, closes in _OUTERMOST:
            inner = text[text.find(opens) : text.rfind(closes) + 1] if opens in text else ""
            yield name, inner
            yield f"{name}_repaired", _repair(inner)
        for opening in _OPENS.finditer(text):
            yield "line", text[opening.start() :]

    return next(((name, t) for name, t in tries() if t and _is_json(t)), None)


@F.pandas_udf(StructType([StructField("status", StringType()), StructField("json", StringType())]))
def _found(contents: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for content, reasoning in contents:
        rows = []
        for c, r in zip(content, reasoning, strict=True):
            found = _find_json(_without_fences(c)) if c else None
            if not found and r and (found := _find_json(_without_fences(r))):
                found = f"reasoning_{found[0]}", found[1]
            rows.append(found or (None, None))
        yield pd.DataFrame(rows, columns=["status", "json"], dtype=object)


def parse_responses(df: DataFrame, column: str = "response", reasoning: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Responses with their JSON text and how it was found, and those without one.

    Tried in turn: the text without fences, the same with backslashes repaired, the
    outermost object, the outermost array, these repaired, and what follows a line that
    begins like JSON; then the same on the column ``reasoning``, if there is one. Most texts parse at once in the
    JVM; only the others pass through Python, in Arrow batches.
    """
    text = strip(F.coalesce(F.col(column), F.lit("")))
    fenced = strip(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n", ""), r"\n?```\s*$", ""))
    tried = df.withColumn("_plain", F.when(text.startswith("```"), fenced).otherwise(text))
    tried = tried.withColumn("_good", (F.col("_plain") != "") & F.try_parse_json("_plain").isNotNull())
    thought = F.col(reasoning) if reasoning else F.lit(None)
    rest = lambda c: F.when(~F.col("_good"), c)
    tried = tried.withColumn("_found", _found(rest(F.col("_plain")), rest(thought).cast("string")))
    status, found = F.when(F.col("_good"), "direct").otherwise(F.col("_found.status")), F.when(F.col("_good"), F.col("_plain")).otherwise(F.col("_found.json"))
    reason = F.when(F.col("_plain") == "", "empty").otherwise("no JSON")
    out = tried.select(*quoted(df), status.alias("status"), found.alias("json"), reason.alias("error"))
    return out.filter("json IS NOT NULL").drop("error"), out.filter("json IS NULL").drop("status", "json")


def apply_splits(parsed: DataFrame, spans: DataFrame, failed: DataFrame) -> DataFrame:
    """Questions of split responses by page; pages whose response failed keep their spans.

    A response fails too if one of its records breaks a rule. Noise records are left out.
    """
    valid, rejected = validate_responses(parsed.select("document_id", "page", "json", F.lit("split").alias("record")), record="record")
    broken = rejected.select("document_id", "page").distinct()
    good = typed(valid.join(broken, ["document_id", "page"], "left_anti"), "split")
    split = good.filter("NOT coalesce(q.is_noise, false)").select("document_id", "page", F.col("q.question_number").alias("number"), F.col("q.content").alias("text"), F.lit("response").alias("origin"))
    paged = spans.withColumn("page", F.get("pages", F.lit(0)))
    lost = failed.select("document_id", "page").union(broken).distinct()
    rest = paged.join(lost, ["document_id", "page"], "left_semi").select("document_id", "page", "number", "text", F.lit("rules").alias("origin"))
    return split.union(rest)


def duplicate_groups(parsed: DataFrame, key: str = "response_id") -> DataFrame:
    """Groups of equal topic names that responses give: group_id, canonical and duplicates, for ``vocab.apply_groups``.

    Groups are numbered by response and place, both of which count as order; blank names are left out, and groups that
    break a rule.
    """
    valid, _ = validate_responses(parsed.withColumn("record", F.lit("groups")), record="record")
    named = typed(valid, "groups").select(key, "at", strip(F.col("q.canonical")).alias("canonical"), F.filter(F.transform("q.duplicates", strip), lambda d: d != "").alias("duplicates"))
    return named.select(F.struct(key, "at").alias("group_id"), "canonical", "duplicates").filter("size(duplicates) > 0")
