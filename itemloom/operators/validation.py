"""Records of model responses against a table of rules.

A rule names the kind of record that it holds for, a field and a check. All rules are
compiled to one column over the parsed JSON, so kinds of records share one pass and a new kind is
new rows of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.session import quoted

QUESTION_TYPES = ("choice", "fill_blank", "calculation", "proof", "short_answer", "comprehensive", "true_false", "unknown")
ROLES = ("primary", "secondary")


@dataclass(frozen=True)
class Rule:
    """``name`` is broken where ``field`` fails ``check``.

    A field ``list[].x`` stands for x of each element of a list: all must hold, and an empty or missing list does. ``lacking``
    and ``null`` say whether the check also holds where the field isn't there, or is null.
    """

    record: str
    name: str
    field: str
    check: str
    argument: object = None
    lacking: bool = False
    null: bool = False


@dataclass(frozen=True)
class Records:
    """Where a response of this kind holds its records (a JSON path to an array), and the least number of them."""

    root: str
    least: int = 0


#: Kinds of responses: enriched questions, a page split in questions, groups of equal topic names.
KINDS = {"enrich": Records("$.questions", 1), "split": Records("$.questions"), "groups": Records("$")}
RULES = (
    Rule("enrich", "content", "content", "filled"),
    Rule("enrich", "subject", "subject_name", "filled"),
    Rule("enrich", "number", "question_number", "text", lacking=True, null=True),
    Rule("enrich", "type", "question_type", "one_of", QUESTION_TYPES, lacking=True),
    Rule("enrich", "topics", "knowledge_points", "size", (1, 3)),
    Rule("enrich", "topic_name", "knowledge_points[].name", "filled"),
    Rule("enrich", "chapter", "knowledge_points[].chapter", "filled"),
    Rule("enrich", "role", "knowledge_points[].role", "one_of", ROLES),
    Rule("enrich", "primary", "knowledge_points[].role", "some", "primary"),
    Rule("enrich", "weight", "knowledge_points[].weight", "between", (0.0, 1.0)),
    Rule("enrich", "page", "source_page", "at_least", 1, lacking=True, null=True),
    Rule("split", "number", "question_number", "text", lacking=True, null=True),
    Rule("split", "content", "content", "filled"),
    Rule("split", "page", "page", "at_least", 1, lacking=True, null=True),
    Rule("split", "noise", "is_noise", "flag", lacking=True),
    Rule("split", "noise_reason", "noise_reason", "text", lacking=True, null=True),
    Rule("groups", "canonical", "canonical", "filled"),
    Rule("groups", "duplicates", "duplicates", "size", (1, None)),
)
SCHEMAS = {
    "enrich": "struct<content:string, question_number:string, question_type:string, subject_name:string, knowledge_points:array<struct<name:string, chapter:string, role:string, weight:double>>, source_page:int>",
    "split": "struct<question_number:string, content:string, page:int, is_noise:boolean, noise_reason:string>",
    "groups": "struct<canonical:string, duplicates:array<string>, reason:string>",
}


def _get(v: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", kind)


def _is_text(raw: Column) -> Column:
    return F.schema_of_variant(raw) == "STRING"


def _size(v: Column, field: str, bounds: tuple[int, int | None]) -> Column:
    n = F.size(_get(v, field, "array<variant>"))
    return (n >= bounds[0]) & ((n <= bounds[1]) if bounds[1] is not None else F.lit(True))


#: Checks of one value: the object that holds it, the field, and the argument to a condition; null counts as broken.
CHECKS: dict[str, Callable[[Column, str, object], Column]] = {
    "text": lambda v, f, _: _is_text(_get(v, f, "variant")),
    "filled": lambda v, f, _: _is_text(_get(v, f, "variant")) & (F.trim(_get(v, f, "string")) != ""),
    "one_of": lambda v, f, a: _get(v, f, "string").isin(*a),
    "between": lambda v, f, a: _get(v, f, "double").between(*a),
    "at_least": lambda v, f, a: _get(v, f, "int") >= a,
    "flag": lambda v, f, _: _get(v, f, "boolean").isNotNull(),
    "size": _size,
}


def _holds(v: Column, field: str, rule: Rule) -> Column:
    raw = _get(v, field, "variant")
    good = F.coalesce(CHECKS[rule.check](v, field, rule.argument), F.lit(False))
    good = F.when(F.is_variant_null(raw), F.lit(rule.null)).otherwise(good)
    return F.when(raw.isNull(), F.lit(rule.lacking)).otherwise(good)


def broken_when(rule: Rule, item: Column) -> Column:
    """Whether a record breaks a rule."""
    if "[]." not in rule.field:
        return ~_holds(item, rule.field, rule)
    outer, inner = rule.field.split("[].")
    parts = _get(item, outer, "array<variant>")
    if rule.check == "some":
        return ~F.coalesce(F.exists(parts, lambda e: F.coalesce(_get(e, inner, "string") == rule.argument, F.lit(False))), F.lit(False))
    return ~F.coalesce(F.forall(parts, lambda e: _holds(e, inner, rule)), F.lit(True))


def _broken(record: Column, item: Column, rules: Sequence[Rule], kinds: dict[str, Records]) -> Column:
    """Names of the rules that a record breaks, in the order of the table."""
    of = lambda kind: F.array(*[F.when(broken_when(r, item), r.name) for r in rules if r.record == kind])
    listed = reduce(lambda acc, kind: F.when(record == kind, of(kind)).otherwise(acc), kinds, F.array(F.lit("record")))
    return F.array_compact(listed)


def judge(parsed: DataFrame, rules: Sequence[Rule] = RULES, kinds: dict[str, Records] = KINDS, record: str | None = None) -> DataFrame:
    """Every record of parsed responses with the rules it breaks.

    ``parsed`` has json and any other columns, which stay; ``record`` names the column with the kind of response (all are enrich
    without one). Adds record, at (place in the response), item (the record as a variant) and broken. A response that
    isn't of its kind's shape, or holds too few records, gives one row without item that breaks "records"; one of an unknown kind breaks "record".
    """
    kind = F.lit("enrich") if record is None else F.col(record)
    tree = F.try_parse_json("json")
    items = reduce(lambda acc, k: F.when(F.col("record") == k, F.try_variant_get(F.col("_tree"), kinds[k].root, "array<variant>")).otherwise(acc), kinds, F.lit(None).cast("array<variant>"))
    least = reduce(lambda acc, k: F.when(F.col("record") == k, kinds[k].least).otherwise(acc), kinds, F.lit(0))
    rest = [c for n, c in zip(parsed.columns, quoted(parsed), strict=True) if n not in ("json", "record")]
    shaped = parsed.select(*rest, kind.alias("record"), tree.alias("_tree")).select(*rest, "record", items.alias("_items"), least.alias("_least"))
    known = F.col("record").isin(*kinds)
    bad_shape = F.coalesce(known, F.lit(False)) & (F.col("_items").isNull() | (F.size("_items") < F.col("_least")))
    spread = shaped.withColumn("_shape", bad_shape).select(*rest, "record", "_shape", F.posexplode_outer(F.when(~bad_shape, F.col("_items"))).alias("at", "item"))
    broken = F.when(F.col("_shape"), F.array(F.lit("records"))).otherwise(_broken(F.col("record"), F.col("item"), rules, kinds))
    kept = F.col("item").isNotNull() | F.col("_shape") | ~F.coalesce(known, F.lit(False))
    return spread.filter(kept).select(*rest, "record", "at", "item", broken.alias("broken"))


def validate_responses(parsed: DataFrame, rules: Sequence[Rule] = RULES, kinds: dict[str, Records] = KINDS, record: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records that keep all rules, and the others with the broken ones; see ``judge``."""
    judged = judge(parsed, rules, kinds, record)
    return judged.filter(F.size("broken") == 0).drop("broken"), judged.filter(F.size("broken") > 0)


def typed(valid: DataFrame, record: str, schemas: dict[str, str] = SCHEMAS) -> DataFrame:
    """The valid records of one kind with their fields as a struct ``q``."""
    return valid.filter(F.col("record") == record).withColumn("q", F.from_json(F.to_json("item"), schemas[record])).drop("item")


def failure_counts(rejected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many records break each rule, by kind of record and further columns such as a source."""
    keys = ["record", *by]
    return rejected.select(*keys, F.explode("broken").alias("rule")).groupBy(*keys, "rule").agg(F.count("*").alias("n"))
