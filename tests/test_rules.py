"""Golden rows for rules and branches that the provided tables don't reach."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from itemloom.functions import text as T
from itemloom.functions.ids import assign_ids
from itemloom.operators import blocks as B
from itemloom.operators import hierarchy as H
from itemloom.operators import inference as N
from itemloom.operators import items as I
from itemloom.operators import resolve as R
from itemloom.operators import stats as S
from itemloom.operators import updates as U
from itemloom.operators import vocab as V
from itemloom.sources import ocr

INLINES = "array<struct<type:string, content:string>>"


def block(place, kind, text, level=None, formula=None, page=1):
    inlines = [("text", text)] + ([("formula", formula)] if formula else [])
    return ("d", page, place, kind, level, None, [i for i in inlines if i[1]])


def frame(spark, rows):
    return spark.createDataFrame(rows, f"document_id string, page int, reading_order int, type string, level int, text string, inlines {INLINES}")


NOISE = [
    (block(0, "page_header", "x"), "structural:page_header"),
    (block(1, "aside", "x"), "aside"),
    (block(2, "title", "x", 2), "section_title"),
    (block(3, "paragraph", "难度★★☆"), "difficulty"),
    (block(4, "paragraph", "目标分135 0 90"), "target_score"),
    (block(5, "paragraph", "1目标分90必做"), "target_score"),
    (block(6, "paragraph", "笔记区。"), "notes_area"),
    (block(7, "paragraph", "答题区"), "answer_area"),
    (block(8, "paragraph", "答题收获 □"), "answer_harvest"),
    (block(9, "paragraph", "易错细节 □"), "review_item"),
    (block(10, "paragraph", "计算 笔记区"), "category"),
    (block(11, "paragraph", "  "), "empty"),
    (block(12, "paragraph", "plain"), None),
    (block(13, "title", "top", 1), None),
]
CANDIDATES = [
    (block(0, "paragraph", "5 this is a question of length"), "leading_number"),
    (block(1, "paragraph", "5 short"), None),
    (block(2, "title", "一、选择"), "chinese_number_title"),
    (block(3, "paragraph", "a long text with a formula", formula="x"), "formula_paragraph"),
    (block(4, "paragraph", "设", formula="x"), "prefix_with_formula"),
    (block(5, "paragraph", "", formula="x"), "pure_formula"),
    (block(6, "paragraph", "some text where y = f(x)"), "text_math_expression"),
    (block(7, "paragraph", "证明下列命题"), "question_prefix"),
    (block(8, "figure", "证明下列命题"), None),
    (block(9, "paragraph", "plain words"), None),
]


def test_noise_reasons(spark):
    got = {r.reading_order: r.noise for r in B.annotate_noise(frame(spark, [b for b, _ in NOISE])).collect()}
    assert got == {b[2]: reason for b, reason in NOISE}


def test_candidate_methods(spark):
    got = {r.reading_order: r.method for r in B.annotate_candidates(frame(spark, [b for b, _ in CANDIDATES])).collect()}
    assert got == {b[2]: method for b, method in CANDIDATES}


def test_spans_cross_pages_and_skip_noise(spark):
    rows = [block(0, "paragraph", "before"), block(1, "paragraph", "1 first question text"), block(2, "paragraph", "答题区"), block(0, "paragraph", "goes on", page=2), block(1, "paragraph", "2 second question text", page=2)]
    spans = B.assemble_spans(B.annotate_candidates(B.annotate_noise(frame(spark, rows)))).orderBy("span").collect()
    assert [(s.text, s.pages, s.number) for s in spans] == [("1 first question text goes on", [1, 2], "1"), ("2 second question text", [2], "2")]


def test_every_block_after_the_first_candidate_is_in_one_span(spark):
    rows = [block(i, "paragraph", f"{i} question number {i} here" if i % 3 == 1 else "words") for i in range(12)]
    spans = B.assemble_spans(B.annotate_candidates(B.annotate_noise(frame(spark, rows))))
    assert spans.agg(F.sum("n_blocks")).first()[0] == 11


def test_import_branches(spark):
    subjects = spark.createDataFrame([(1, "math"), (2, "art")], "id long, name string")
    chapters = spark.createDataFrame([(1, 1, "c1", 0), (2, 1, "c2", 1), (3, 2, "c3", 0)], "id long, subject_id long, name string, sort_order int")
    topics = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 2, "b"), (4, 3, "z")], "id long, chapter_id long, name string")
    aliases = spark.createDataFrame([("bee", "b"), ("beta", "b")], "alias string, canonical string")
    entries = spark.createDataFrame(
        [
            (1, "physics", "x", [("a", "c1", "primary", 1.0)]),
            (2, "math", "x", [("a", "c2", "primary", 1.0)]),  # in the chapter
            (3, "math", "x", [(" bee ", "c1", "primary", 1.0)]),  # another chapter, unique
            (4, "math", "x", [("a", "c9", "primary", 1.0)]),  # ambiguous
            (5, "math", "x", [("a", None, "primary", 1.0)]),  # no chapter: least id
            (6, "math", "x", [("a", "c1", "primary", 1.0), ("q", "c1", "secondary", 0.5)]),
            (7, "math", "x", [("", "c1", "primary", 1.0)]),
            (8, "math", "x", [("bee", "", "primary", 0.9), ("beta", "", "secondary", 0.2)]),
        ],
        "entry_id long, subject_name string, content string, topics array<struct<name:string,chapter:string,role:string,weight:double>>",
    )
    resolved = R.resolve_topics(entries, aliases, topics, chapters, subjects)
    accepted, refused = R.accept_entries(entries, resolved, subjects)
    assert {r.entry_id: [x.topic_id for x in r.links] for r in accepted.collect()} == {2: [2], 3: [3], 5: [1], 8: [3, 3]}
    reasons = {r.entry_id: r.reason for r in refused.collect()}
    assert set(reasons) == {1, 4, 6, 7}
    assert reasons[1] == "unknown subject: physics" and reasons[6].endswith(": q") and reasons[7] == "topics not in the catalogue"
    items = spark.createDataFrame([(10, 1, "old")], "id long, subject_id long, content string")
    links = spark.createDataFrame([], "item_id long, topic_id long, role string, weight decimal(6,4)")
    new_items, new_links = R.write_entries(accepted, items, links)
    assert new_items.count() == 5 and new_items.agg(F.max("id")).first()[0] == 14
    assert [(r.role, r.weight) for r in new_links.filter("item_id = 14").collect()] == [("primary", Decimal("0.9000"))]


@pytest.mark.parametrize(("given", "safe"), [("0", 0.1), ("0.05", 0.1), ("1.7", 1.0), (None, 1.0), ("x", 1.0), ("NaN", 1.0), ("0.4", 0.4)])
def test_safe_weight(spark, given, safe):
    assert spark.createDataFrame([(given,)], "w string").select(R.safe_weight(F.col("w"))).first()[0] == safe


def test_aliases_one_hop(spark):
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("s", "s")], "alias string, canonical string")
    names = spark.createDataFrame([("a",), (" b ",), ("s",), ("u",)], "name string")
    assert sorted(r.name for r in V.canonicalise(names, "name", aliases).collect()) == ["b", "c", "s", "u"]
    assert {(r.alias, r.reason) for r in V.suspect_aliases(aliases).collect()} == {("a", "chained"), ("s", "self")}


def topics_of(spark, rows):
    return spark.createDataFrame(rows, "id long, chapter_id long, name string, sort_order int, parent_id long")


def test_forest_with_cycles_and_lost_parents(spark):
    t = topics_of(spark, [(1, 1, "a", 0, None), (2, 1, "b", 0, 1), (3, 1, "c", 0, 2), (4, 1, "d", 0, 99), (5, 1, "e", 0, 6), (6, 1, "f", 0, 5), (7, 1, "g", 0, 7), (8, 1, "h", 0, 5)])
    nodes, cycles = H.topic_forest(t)
    assert {(r.id, r.root_id, r.depth) for r in nodes.collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)}
    assert {r.id for r in cycles.collect()} == {5, 6, 7, 8}


def test_moves_refuse_cycles(spark):
    t = topics_of(spark, [(1, 1, "a", 0, None), (2, 1, "b", 0, 1), (3, 1, "c", 0, 2), (4, 1, "d", 0, None)])
    moves = spark.createDataFrame([(1, 3), (2, 2), (3, 4), (4, 77)], "id long, new_parent long")
    moved, refused = H.move_topics(t, moves)
    assert {r.id for r in refused.collect()} == {1, 2, 4}
    assert {r.id: r.parent_id for r in moved.collect()} == {1: None, 2: 1, 3: 4, 4: None}


def test_merge_into_own_child(spark):
    t = topics_of(spark, [(1, 1, "a", 0, None), (2, 1, "b", 0, 1), (3, 1, "c", 0, 2), (4, 1, "d", 0, 2)])
    links = spark.createDataFrame([(10, 2, "primary", 1.0), (10, 3, "secondary", 0.5), (11, 2, "primary", 0.7)], "item_id long, topic_id long, role string, weight double")
    topics, kept = H.merge_topics(t, links, spark.createDataFrame([(2, 3)], "source_id long, target_id long"))
    assert {r.id: r.parent_id for r in topics.collect()} == {1: None, 3: 1, 4: 3}
    assert {(r.item_id, r.topic_id, r.role) for r in kept.collect()} == {(10, 3, "secondary"), (11, 3, "primary")}


def test_a_subject_with_items_is_not_deleted(spark):
    tables = {
        "subjects": spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"),
        "chapters": spark.createDataFrame([(1, 1), (2, 2)], "id long, subject_id long"),
        "topics": topics_of(spark, [(1, 1, "a", 0, None), (2, 2, "b", 0, 1), (3, 1, "c", 0, 2)]),
        "items": spark.createDataFrame([(1, 1)], "id long, subject_id long"),
        "links": spark.createDataFrame([(1, 2)], "item_id long, topic_id long"),
        "item_tags": spark.createDataFrame([(1, "t")], "item_id long, tag string"),
    }
    out = H.cascade_delete(tables, "subjects", spark.createDataFrame([(1,), (2,)], "id long"))
    assert [r.id for r in out["subjects"].collect()] == [1]
    assert {r.id: r.parent_id for r in out["topics"].collect()} == {1: None, 3: None}
    assert out["links"].count() == 0


def test_numbers_sort_leniently(spark):
    rows = [(1, None), (2, "12"), (3, "12a"), (4, "abc"), (5, " 7")]
    items = spark.createDataFrame(rows, "id long, question_number string")
    assert [r.id for r in I.order_by_number(items).collect()] == [4, 5, 2, 3, 1]
    assert [r.id for r in I.order_by_number(items, descending=True).collect()] == [2, 3, 5, 4, 1]


@pytest.mark.parametrize(("given", "pages"), [(None, None), ("[1,2]", [1, 2]), ("p.3, 4", [3, 4]), ("[]", []), ('["5", "x"]', [5])])
def test_page_lists(spark, given, pages):
    assert spark.createDataFrame([(given,)], "p string").select(T.page_list(F.col("p"))).first()[0] == pages


def test_batches_and_answers(spark):
    text = "---\nfirst\n---\n---\nsecond\n答案：42 \nlost\n---\n答案：only\n---"
    got = [(r.content, r.answer) for r in T.split_batches(spark.createDataFrame([(text,)], "text string")).orderBy("at").collect()]
    assert got == [("first", None), ("---\nsecond", "42")]


def test_clean_latex(spark):
    text = "\\documentclass{a}\n\\section{One {two}}\n\\textbf{b {c}} <b>x</b> \\[y\\] \\begin{align*}z\\end{align*} \\emph{open"
    out, stats = T.clean_corpus(spark.createDataFrame([(text,), ("same",), (None,)], "text string"))
    got = [r.cleaned for r in out.collect()]
    assert got[0] == "**b {c}** x $$y$$ $$\\begin{aligned}z\\end{aligned}$$ \\emph{open" and got[1:] == ["same", None]
    assert tuple(stats.first()) == (3, 1)


@pytest.mark.parametrize(
    ("given", "out"),
    [("no commands", "no commands"), ("so \\alpha^2 is", "so $\\alpha^2 is$"), ("keep $\\pi$ and \\frac{a}{b}, end", "keep $\\pi$ and $\\frac{a}{b}$, end"), ("\\alpha，\\beta", "$\\alpha$，$\\beta$"), ("\\frac{a{b{c{d{e}}}}}", "$\\frac{a{b{c{d{e}}}}}$"), ("\\max(f(g(x)), y)", "$\\max(f(g(x)), y)$"), ("\\frac{a, \\beta} c", "$\\frac{a, \\beta} c$")],
)
def test_delimit_formulas(spark, given, out):
    assert T.delimit_formulas(spark.createDataFrame([(given,)], "text string")).first().delimited == out


def test_responses(spark):
    rows = [(1, '{"a":1}'), (2, '```json\n{"a":1}\n```'), (3, 'x {"a":1} y'), (4, '{"a":"\\sqrt"}'), (5, '{"a":'), (6, " "), (7, None), (8, "see [1,2]")]
    found, failed = N.parse_responses(spark.createDataFrame(rows, "response_id long, response string"))
    assert {r.response_id: r.status for r in found.collect()} == {1: "direct", 2: "direct", 3: "object", 4: "repaired", 8: "array"}
    assert {r.response_id: r.error for r in failed.collect()} == {5: "no JSON", 6: "empty", 7: "empty"}


def test_reasoning_and_lines_are_searched_last(spark):
    rows = [(1, "no", '```json\n{"a":1}\n```'), (2, '{"b":2}', '{"a":1}'), (3, None, None), (4, "so {x\n[1]\n", None), (5, "", "x {\"a\":\"\\q\"} y")]
    found, failed = N.parse_responses(spark.createDataFrame(rows, "response_id long, response string, thought string"), reasoning="thought")
    assert {r.response_id: (r.status, r.json) for r in found.collect()} == {1: ("reasoning_direct", '{"a":1}'), 2: ("direct", '{"b":2}'), 4: ("array", "[1]"), 5: ("reasoning_object_repaired", '{"a":"\\\\q"}')}
    assert [r.response_id for r in failed.collect()] == [3]


def test_changes_by_source(spark):
    rows = [("a", "\\quad x"), ("a", "x"), ("b", "y")]
    _, stats = T.clean_corpus(spark.createDataFrame(rows, "source string, text string"), source="source")
    assert {tuple(r) for r in stats.collect()} == {("a", 2, 1), ("b", 1, 0)}


def test_a_block_formula_counts(spark):
    rows = [(1, 1, 0, "paragraph", None, None, [], "x^2"), (1, 1, 1, "paragraph", None, None, [], None)]
    got = B.annotate_candidates(spark.createDataFrame(rows, "document_id long, page int, reading_order int, type string, level int, text string, inlines array<struct<type:string,content:string>>, latex string"))
    assert [r.method for r in got.orderBy("reading_order").collect()] == ["pure_formula", None]


def test_sort_orders_follow_a_null_parent_and_one_list(spark):
    old = spark.createDataFrame([(1, None, 0), (2, None, 1), (3, 7, 4)], "id long, parent long, sort_order long")
    new = spark.createDataFrame([(4, None), (5, 7), (6, 8)], "id long, parent long")
    assert {r.id: r.sort_order for r in I.append_ordered(old, new, "parent").collect()} == {4: 2, 5: 5, 6: 0}
    assert {r.id: r.sort_order for r in I.append_ordered(old, new).collect()} == {4: 5, 5: 6, 6: 7}


def test_moves_in_a_deep_tree(spark):
    n = 1500
    topics = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(5000, None), (6000, 6001), (6001, 6000)], "id long, parent_id long")
    moves = [(5000, n - 1), (3, n - 1), (10, 10), (20, 19), (30, 77777), (40, None), (50, 6000)]
    moved, refused = H.move_topics(topics, spark.createDataFrame(moves, "id long, new_parent long"))
    assert {r.id for r in refused.collect()} == {3, 10, 30, 50}
    parent = {r.id: r.parent_id for r in moved.collect()}
    assert parent[5000] == n - 1 and parent[20] == 19 and parent[40] is None and parent[3] == 2


def test_repeated_aliases_take_the_least(spark):
    aliases = spark.createDataFrame([("a", "z"), ("a", "y")], "alias string, canonical string")
    assert V.canonicalise(spark.createDataFrame([("a ",)], "name string"), "name", aliases).first().name == "y"


def test_ocr_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '[[{"type":"title","bbox":[1,2,3,4],"content":{"title_content":[{"type":"text","content":"T"}],"level":2}},'
        '{"type":"page_number","content":"7"},{"type":"hologram","content":{}}],'
        '[{"type":"table","content":{"html":"<table><tr><td>area of</td><td>$r^2$ &amp; more</td></tr></table>"}},'
        '{"type":"equation_interline","content":{"math_content":"x","image_source":{"path":"i/f.JPG"}}}]]'
    )
    rows = ocr.flatten_tables(ocr.read_blocks(spark, str(tmp_path))).orderBy("page", "reading_order").collect()
    assert [(r.page, r.type) for r in rows] == [(1, "title"), (1, "page_number"), (1, "unknown"), (2, "paragraph"), (2, "equation_interline")]
    assert rows[0].level == 2 and rows[1].text == "7" and rows[4].image_mime == "image/jpeg"
    assert [tuple(i) for i in rows[3].inlines] == [("text", "area of", None), ("formula", "r^2", None), ("text", "& more", None)]  # no confidence
    assert rows[0].document_id.startswith("a_") and len(rows[0].document_id) == 10


def test_weakness_without_weight_is_zero(spark):
    items = spark.createDataFrame([(1, 1)], "id long, mastery_level int")
    links = spark.createDataFrame([(1, 1, "primary", Decimal("0"))], "item_id long, topic_id long, role string, weight decimal(6,4)")
    topics = spark.createDataFrame([(1, 1, "t", 0)], "id long, chapter_id long, name string, sort_order int")
    chapters = spark.createDataFrame([(1, 1, "c", 0)], "id long, subject_id long, name string, sort_order int")
    subjects = spark.createDataFrame([(1, "s")], "id long, name string")
    row = S.topic_weakness(items, links, topics, chapters, subjects).first()
    assert (row.weakness, row.mastery_rate) == (0.0, 0.0)


def test_unknown_levels_go_aside(spark):
    valid, rejected = S.label_mastery(spark.createDataFrame([(1, 0), (2, 7), (3, None)], "id long, mastery_level int"))
    assert [r.label for r in valid.collect()] == ["unmarked"] and sorted(r.id for r in rejected.collect()) == [2, 3]


def test_marks_tie_by_id(spark):
    marks = spark.createDataFrame([(1, 1, 3, "2024-01-01"), (2, 1, 4, "2024-01-01"), (3, 1, 9, "2024-02-01")], "mark_id long, item_id long, level int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert U.latest_marks(marks).first().level == 4


def test_ids_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = assign_ids(df, ["k"], 5).orderBy("k").collect()
    assert [r.id for r in got] == list(range(5, 1005))
