"""Secret scan by patterns and sliding-window entropy, in DataFrame functions only.

Base patterns give spans of kinds assign, access and hex. The entropy method looks
at candidate strings, runs of 20 or more characters of ``[A-Za-z0-9+/_-]`` with a
digit: a window of 20 characters slides over each, and the sum of c * log2(c) over
its character counts is updated from the character that leaves and the one that
enters. A candidate whose best window reaches the threshold of its class (hex
digits or base64 digits) is a span of kind entropy, unless the allow-list names
something in it or a base span overlaps it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = ASSIGN_KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: c * log2(c) in millionths for the counts of a window, so that sums are exact.
WEIGHT = [0] + [round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 1)]
#: Least entropy in bits a character by class.
LEAST_BITS = {"hex": 2.9, "base64": 3.6}
#: Candidates that have one of these in any case are no secrets.
ALLOWED = ("example", "sample", "placeholder", "changeme", "dummy", "redacted", "xxxxxx", "000000", "123456789", "abcdefgh")
_LONG_HEX = "[0-9a-f]{24}"


def least_sum(bits: float) -> int:
    """A window's sum of weights is at most this where its entropy is ``bits`` or more."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1e6)


def _found(text: Column, pattern: str, value_group: bool = False) -> Column:
    """Matches as structs (gap, length, value): characters before, in, and in group 1 of each.

    Each search begins where the last match ended (\\G), else what follows the last
    match would be searched again from each of its characters.
    """
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    parts = [F.transform(F.regexp_extract_all(text, whole, F.lit(k)), F.length) for k in ((1, 2, 3) if value_group else (1, 2))]
    return F.arrays_zip(parts[0].alias("gap"), parts[1].alias("length"), parts[-1].alias("value"))


def _spans(found: Column, kind: int, least: int) -> Column:
    """(start, kind, end) of the matches whose value is long enough."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        begin = s["at"] + m["gap"]
        end = begin + m["length"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(m["value"] >= least, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda s: s["out"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _weight(count: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHT]), count + 1)


#: Characters of candidates; each has a counter of BITS bits, PER_LONG of them in a long.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
BITS = 5
PER_LONG = 12
LONGS = -(-len(CHARACTERS) // PER_LONG)


def _counter(counts: Column, k: Column) -> Column:
    """The count of character number k."""
    return F.call_function("shiftright", F.element_at(counts, F.floor(k / PER_LONG).cast("int") + 1), k % PER_LONG * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _changed(counts: Column, k: Column, by: int) -> Column:
    """The counts with one more or one less of character number k."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), k % PER_LONG * BITS) * by
    return F.transform(counts, lambda x, j: F.when(j == F.floor(k / PER_LONG), x + step).otherwise(x))


def least_window_sum(candidate: Column) -> Column:
    """The least sum of weights of any window: the lower, the higher its entropy.

    The counts of the window's characters go from window to window: one is taken down, one up, and the sum
    follows these two counts. A window has at most 20 of a character, so a counter of five bits holds it.
    """
    numbers = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(CHARACTERS), c) - 1)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0).cast("long").alias("now"))

    def enter(s: Column, k: Column) -> Column:
        n = _counter(s["counts"], k)
        return F.struct(_changed(s["counts"], k, 1).alias("counts"), (s["now"] + _weight(n + 1) - _weight(n)).alias("now"))

    def slide(s: Column, pair: Column) -> Column:
        n_out = _counter(s["counts"], pair["out"])
        less = _changed(s["counts"], pair["out"], -1)
        same = pair["out"] == pair["new"]
        n_new = F.when(same, n_out - 1).otherwise(_counter(s["counts"], pair["new"]))
        now = s["now"] - _weight(n_out) + _weight(n_out - 1) + _weight(n_new + 1) - _weight(n_new)
        return F.struct(_changed(less, pair["new"], 1).alias("counts"), now.alias("now"), F.least(s["least"], now).alias("least"))

    first = F.aggregate(F.slice(numbers, 1, WINDOW), start, enter)
    begin = F.struct(first["counts"].alias("counts"), first["now"].alias("now"), first["now"].alias("least"))
    n = F.greatest(F.size(numbers) - WINDOW, F.lit(0))
    pairs = F.zip_with(F.slice(numbers, F.lit(1), n), F.slice(numbers, F.lit(WINDOW + 1), n), lambda out, new: F.struct(out.alias("out"), new.alias("new")))
    return F.aggregate(pairs, begin, slide, lambda s: s["least"])


def _secret(candidate: Column) -> Column:
    allowed = F.lower(candidate).rlike("|".join(ALLOWED))
    most = F.when(candidate.rlike("^[0-9A-Fa-f]+$"), least_sum(LEAST_BITS["hex"])).otherwise(least_sum(LEAST_BITS["base64"]))
    return candidate.rlike("[0-9]") & ~allowed & (least_window_sum(candidate) <= most)


def _entropy_spans(text: Column, base: Column) -> Column:
    """Spans of secret candidates that no base span overlaps."""
    whole = F.lit(rf"(?s)\G(.*?)({CANDIDATE})")
    gaps, strings = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    verdict = F.transform(strings, lambda c: F.when(_secret(c), 1).otherwise(0))
    found = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(strings, F.length).alias("length"), verdict.alias("value"))
    spans = _spans(found, 3, 1)
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _text_form(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """All secret spans of every document.

    ``docs`` has doc_id and text; other columns are ignored. Returns doc_id, base
    and spans: arrays of (start, kind, end) in code points, end exclusive, ordered
    by start, then kind as in KINDS. A null or empty text has none; repeated rows
    are scanned alike. The patterns only run where a cheap test of the whole text
    finds what each needs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        F.when(text.rlike(ASSIGN), _spans(_found(text, ASSIGN, True), 0, LEAST_ASSIGN)).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), _spans(_found(text, ACCESS), 1, LEAST_ACCESS)).otherwise(_none()),
        F.when(text.rlike(_LONG_HEX), _spans(_found(text, rf"[0-9a-f]{{{LEAST_HEX},}}"), 2, LEAST_HEX)).otherwise(_none()),
    )
    based = docs.select("doc_id", text.alias("text"), F.array_sort(base).alias("base"))
    more = F.when(F.col("text").rlike(CANDIDATE), _entropy_spans(F.col("text"), F.col("base"))).otherwise(_none())
    return based.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return scanned.select("doc_id", *counts, F.sha2(_text_form(F.col("base")), 256).alias("base_sha256"), _text_form(F.col("spans")).alias("spans"))


def _sql_spans(kind: int, pattern: str, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, {kind} AS kind, list_sum(list_slice(g, 1, i)) + coalesce(list_sum(list_slice(m, 1, i - 1)), 0) AS s, m[i] AS n, v[i] AS val, w[i] AS word
  FROM (SELECT r, g, m, v, w, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, list_transform(regexp_extract_all(t, '(?s)(.*?)({quoted})', 1), lambda x: length(x)) AS g,
      list_transform(regexp_extract_all(t, '(?s)(.*?)({quoted})', 2), lambda x: length(x)) AS m,
      list_transform(regexp_extract_all(t, '(?s)(.*?)({quoted})', {keep}), lambda x: length(x)) AS v,
      regexp_extract_all(t, '(?s)(.*?)({quoted})', 2) AS w
    FROM d))"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT r, kind, s, s + n AS e FROM ({_sql_spans(0, ASSIGN, "3")}) WHERE val >= {LEAST_ASSIGN}
  UNION ALL SELECT r, kind, s, s + n FROM ({_sql_spans(1, ACCESS, "2")}) WHERE val >= {LEAST_ACCESS}
  UNION ALL SELECT r, kind, s, s + n FROM ({_sql_spans(2, HEX, "2")}) WHERE val >= {LEAST_HEX}),
candidates AS (
  SELECT r, s, s + n AS e, word FROM ({_sql_spans(3, CANDIDATE, "2")})
  WHERE regexp_matches(word, '[0-9]') AND NOT regexp_matches(lower(word), '{"|".join(ALLOWED)}')),
windows AS (
  SELECT r, s, e, word, i, unnest(list_transform(range(0, {WINDOW}), lambda k: word[i + k])) AS c
  FROM (SELECT *, unnest(range(1, length(word) - {WINDOW - 2})) AS i FROM candidates)),
counted AS (SELECT r, s, e, word, i, c, count(*) AS n FROM windows GROUP BY ALL),
summed AS (SELECT r, s, e, word, i, sum(CAST(round(n * log2(n) * 1e6) AS BIGINT)) AS total FROM counted GROUP BY ALL),
secret AS (
  SELECT r, 3 AS kind, s, e FROM summed GROUP BY r, s, e, word
  HAVING min(total) <= CASE WHEN regexp_matches(word, '^[0-9A-Fa-f]+$') THEN {least_sum(LEAST_BITS["hex"])} ELSE {least_sum(LEAST_BITS["base64"])} END),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM secret x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e)),
named AS (SELECT r, kind, s, (['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS said FROM spans),
joined AS (
  SELECT r, count(CASE WHEN kind = 0 THEN 1 END) AS n_assign, count(CASE WHEN kind = 1 THEN 1 END) AS n_access, count(CASE WHEN kind = 2 THEN 1 END) AS n_hex,
    string_agg(CASE WHEN kind < 3 THEN said END, ',' ORDER BY s, kind) AS base, string_agg(said, ',' ORDER BY s, kind) AS spans
  FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""
