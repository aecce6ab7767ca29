"""Text jobs: splitting, cleaning and inspecting columns of item texts."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STEM_LEAST = 8
STEM_NOTE = "stem incomplete"
DEFAULT_SUBJECT = "uncategorised"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_batches(texts: DataFrame, column: str = "text", separator: str = r"\n---\n|\n---$|^---\n", answer: str = r"(?md)\n?答案[：:](.+)$") -> DataFrame:
    """The parts between ``---`` lines as items: all columns, at, content and answer.

    The first answer in a part becomes its answer; what follows it is left out, and
    so is a part without content. Of two separators in a row the second stays text.
    """
    parts = F.filter(F.transform(F.split(column, separator, -1), strip), lambda p: p != "")
    spread = texts.select("*", F.posexplode(parts).alias("at", "part"))
    found = F.regexp_substr("part", F.lit(answer))
    content = F.when(found.isNull(), F.col("part")).otherwise(strip(F.call_function("substring_index", F.col("part"), found, F.lit(1))))
    return spread.select(*texts.columns, "at", content.alias("content"), F.when(found.isNotNull(), strip(F.regexp_extract("part", answer, 1))).alias("answer")).filter("content != ''")


def formula_inventory(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Formulas by row: display ones first, then inline ones, in order of place."""
    found = F.concat(
        F.transform(F.regexp_extract_all(column, F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1)), lambda f, i: F.struct(F.lit("display").alias("kind"), i.alias("at"), strip(f).alias("formula"))),
        F.transform(F.regexp_extract_all(column, F.lit(r"\$([^$]+?)\$"), F.lit(1)), lambda f, i: F.struct(F.lit("inline").alias("kind"), i.alias("at"), strip(f).alias("formula"))),
    )
    return df.select(key, F.explode(found).alias("f")).select(key, "f.kind", "f.at", "f.formula")


def formula_frequency(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("kind", "formula").agg(F.count("*").alias("n"))


def item_number(c: Column) -> Column:
    """The question number at the start of a text, or null."""
    return F.nullif(F.regexp_extract(c, r"^(?:第\s*)?(\d{1,4})", 1), F.lit(""))


def is_complete(c: Column, least: int = STEM_LEAST) -> Column:
    """Whether a stem has text beyond a mere number label."""
    s = strip(F.coalesce(c, F.lit("")))
    return (F.length(s) >= least) & ~s.rlike(r"^(?:第\s*)?[\d(（][\d\s()（）.、．题]*$")


def flag_incomplete(df: DataFrame, column: str = "content") -> DataFrame:
    done = is_complete(F.col(column))
    return df.withColumn("needs_review", ~done).withColumn("review_note", F.when(~done, STEM_NOTE))


def page_list(c: Column) -> Column:
    """Page numbers of a JSON array, or of any digits in a text."""
    listed = F.from_json(F.when(c.rlike(r"^\s*\["), c), "array<string>")
    return F.filter(F.transform(F.coalesce(listed, F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def to_entries(enriched: DataFrame) -> DataFrame:
    """Import entries of enriched records; empty contents are left out.

    The number comes from the enrichment, else the text, the detection, or the place.
    """
    blank = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    number = F.coalesce(blank("question_number"), item_number(F.col("content")), blank("detected_number"), (F.col("at") + 1).cast("string"))
    page = F.coalesce(F.nullif(F.col("source_page"), F.lit(0)), F.get("pages", F.lit(0)))
    return enriched.filter(F.coalesce(blank("content"), F.lit("")) != "").select("entry_id", F.coalesce(blank("subject_name"), F.lit(DEFAULT_SUBJECT)).alias("subject_name"), "content", number.alias("question_number"), page.cast("int").alias("source_page"), "pages")


def _group_end(text: str, at: int, opens: str, closes: str) -> int | None:
    """The place after the group whose opening character stands just before ``at``; None if it isn't closed."""
    depth = 1
    for m in re.compile(f"[{re.escape(opens + closes)}]").finditer(text, at):
        depth += 1 if m[0] == opens else -1
        if not depth:
            return m.end()
    return None


def _braced(text: str, command: re.Pattern[str], form: str) -> str:
    """Replace each command and its braced argument, which may hold braces."""
    out, at = [], 0
    while m := command.search(text, at):
        end = _group_end(text, m.end(), "{", "}")
        if end is None:  # never closed: stays
            out.append(text[at : m.end()])
            at = m.end()
            continue
        out.append(text[at : m.start()] + form.replace("#", text[m.end() : end - 1]))
        at = end
    return "".join(out) + text[at:]


# What document structure is taken out or becomes, in this order; braced commands come after the first table.
STRUCTURE = (
    (r"<[^>]+>", ""),
    (r"\\(?:documentclass|usepackage|geometry)[^\n]*\n", ""),
    (r"\\(?:begin|end)\{document\}", ""),
)
LAYOUT = (
    (r"\\noindent\*?", ""),
    (r"\\(?:bigskip|medskip|smallskip)\*?", ""),
    (r"\\\$((?:4|6|8|10|12|20)pt\])", r"\\[$1"),
    (r"(?s)\\\[(.+?)\\\]", r"\$\$$1\$\$"),
    (r"(?s)\\begin\{align\*\}(.+?)\\end\{align\*\}", r"\$\$\\begin{aligned}$1\\end{aligned}\$\$"),
    (r"(?s)(?<!\$)\\begin\{aligned\}(.+?)\\end\{aligned\}(?!\$)", r"\$\$\\begin{aligned}$1\\end{aligned}\$\$"),
    (r"\\qquad", "  "),
    (r"\\quad", " "),
    (r"\n{3,}", "\n\n"),
    (r"(?m)^[^\S\n]+|[^\S\n]+$", ""),
)
_BRACED = [(re.compile(rf"\\{name}\s*\{{"), form) for name, form in ((r"section\*?", ""), (r"subsection\*?", ""), ("textbf", "**#**"), ("textit", "*#*"), ("emph", "*#*"))]


@F.pandas_udf(StringType())
def _braces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        out = []
        for t in s:
            for command, form in _BRACED:
                t = _braced(t, command, form) if t else t
            out.append(t)
        yield pd.Series(out, dtype=object)


def clean_corpus(df: DataFrame, column: str = "text", source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts without LaTeX document structure, and how many rows changed, by ``source`` if it is given.

    Only rows with a command pass through Python, for nested braces.
    """
    t = F.col(column)
    for pattern, new in STRUCTURE:
        t = F.regexp_replace(t, pattern, new)
    t = F.when(t.rlike(r"\\(?:sub)?section|\\text(?:bf|it)|\\emph"), _braces(t)).otherwise(t)
    for pattern, new in LAYOUT:
        t = F.regexp_replace(t, pattern, new)
    out = df.withColumn("cleaned", strip(t))
    return out, out.groupBy(*[source] if source else []).agg(F.count("*").alias("n_rows"), F.count_if(F.col("cleaned") != F.col(column)).alias("n_changed"))


_DELIMITED = re.compile(r"\$\$.+?\$\$|(?<!\$)\$(?!\$).+?(?<!\$)\$(?!\$)", re.DOTALL)
# What ends a run of commands (Chinese text and punctuation), and what may follow a command besides groups.
_BOUNDARY = re.compile("[\u2e80-\u2fff\u3000-\u303f\u4e00-\u9fff\uff00-\uff60,;:!?.\n\r]")
_LOOSE = re.compile("(?:[ +\\-=<>!)}]|\\d|[^\\W_\u2000-\U0010ffff])*")
_COMMAND = re.compile(r"\\[a-zA-Z]+")
_GROUPS = {"{": "}", "(": ")"}


def _run_end(text: str, at: int) -> int:
    """Where the formula that holds the command before ``at`` ends; groups nest to any depth."""
    while True:
        at = _LOOSE.match(text, at).end()
        found = text[at : at + 1]
        if found and found in "^_":
            at, found = at + 1, text[at + 1 : at + 2]
            if found != "{":
                at += len(found)
                continue
        if found not in _GROUPS:
            return at
        at = _group_end(text, at + 1, found, _GROUPS[found]) or len(text)


def _bare_commands(text: str) -> list[tuple[int, int]]:
    """Where the commands stand that no delimiters hold."""
    out, math = [], iter([*(m.span() for m in _DELIMITED.finditer(text)), (len(text), len(text))])
    start, end = next(math)
    for m in _COMMAND.finditer(text):
        while end <= m.start():
            start, end = next(math)
        if m.start() < start:
            out.append(m.span())
    return out


def _delimit(text: str) -> str:
    """Text with its runs of bare commands between dollar signs.

    Commands with no boundary between them are one run, and so is math that stands between them; so are those that stand in a group of it.
    """
    out, at = [], 0
    commands = deque(_bare_commands(text))
    while commands:
        start, end = commands.popleft()
        while commands and not _BOUNDARY.search(text, end, commands[0][0]):
            end = commands.popleft()[1]
        end = _run_end(text, end)
        while commands and commands[0][0] < end:
            commands.popleft()
        out.append(f"{text[at:start]}${text[start:end]}$")
        at = end
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _delimited(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: _delimit(t) if t else t)


def delimit_formulas(df: DataFrame, column: str = "text") -> DataFrame:
    """Texts whose bare command runs stand between dollar signs; others stay in the JVM."""
    return df.withColumn("delimited", F.when(F.contains(column, F.lit("\\")), _delimited(column)).otherwise(F.col(column)))
