"""Display order of trees, rules of responses, tags, and what blocks show."""

import json
import random

import pytest
from pyspark.sql import functions as F

from itemloom.functions import text as T
from itemloom.operators import blocks as B
from itemloom.operators import hierarchy as H
from itemloom.operators import inference as N
from itemloom.operators import resolve as R
from itemloom.operators import validation as V
from itemloom.operators import vocab
from itemloom.sources import ocr

TOPIC = "id long, parent_id long, sort_order int, name string"


def shown(rows):
    """Place, children and topics below by a plain walk."""
    ids = {r[0] for r in rows}
    below = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2], r[0])):
        below.setdefault(r[1] if r[1] in ids else None, []).append(r[0])
    out, stack, order = {}, list(reversed(below.get(None, []))), []
    while stack:
        order.append(stack.pop())
        stack += reversed(below.get(order[-1], []))
    size = {}
    for i in reversed(order):
        size[i] = sum(1 + size[c] for c in below.get(i, []))
        out[i] = (order.index(i) if len(order) < 500 else None, len(below.get(i, [])), size[i])
    return out


def test_display_order_of_random_forests(spark):
    rng = random.Random(2)
    for n in (2, 90):
        ids = rng.sample(range(1000), n)
        rows = [(i, rng.choice(ids[:k] + [None, 5000 + i]) if k else None, rng.choice([None, 1, 2, 3]), f"t{i}") for k, i in enumerate(ids)]
        rows += [(9001, 9002, 0, "loop"), (9002, 9001, 0, "loop"), (9003, 9002, 0, "behind")]
        got = {r.id: (r.place, r.n_children, r.n_below) for r in H.display_tree(spark.createDataFrame(rows, TOPIC), ["sort_order"]).collect()}
        assert got == shown(rows[:-3])
        paths = {r.id: r.path for r in H.topic_paths(spark.createDataFrame(rows, TOPIC)).collect()}
        parent = {r[0]: r[1] for r in rows if r[1] in {x[0] for x in rows}}
        assert set(paths) == set(got)
        assert all(p[-1] == i and all(parent.get(b) == a for a, b in zip(p, p[1:])) and p[0] not in parent for i, p in paths.items())


def test_a_chain_of_ten_thousand(spark):
    n = 10000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0).alias("sort_order"))
    tree = H.display_tree(chain, ["sort_order"])
    assert tree.filter(f"place = id AND depth = id AND root_id = 0 AND n_below = {n} - 1 - id AND n_children = if(id = {n} - 1, 0, 1)").count() == n
    paths = H.topic_paths(chain).filter(F.col("id") == n - 1).first().path
    assert paths == list(range(n))


def test_a_topic_with_very_many_children(spark):
    flat = spark.range(5000).select("id", F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent_id"), (-F.col("id")).alias("sort_order"))
    tree = H.display_tree(flat, ["sort_order"])
    assert tree.filter("place = if(id = 0, 0, 5000 - id)").count() == 5000
    assert H.display_tree(flat.limit(0), ["sort_order"]).count() == 0


# --- responses by rules


def question(**changes):
    base = {"content": "c", "question_number": None, "question_type": "proof", "subject_name": "s", "knowledge_points": [{"name": "k", "chapter": "c", "role": "primary", "weight": 0.5}], "source_page": 2}
    return {k: v for k, v in (base | changes).items() if v != "LACKING"}


def point(**changes):
    return {"name": "k", "chapter": "c", "role": "primary", "weight": 0.5} | changes


QUESTIONS = [
    ({}, []),
    ({"question_number": "LACKING", "question_type": "LACKING", "source_page": "LACKING"}, []),
    ({"question_number": 5}, ["number"]),
    ({"content": " "}, ["content"]),
    ({"content": "LACKING", "subject_name": None}, ["content", "subject"]),
    ({"question_type": None}, ["type"]),
    ({"question_type": "riddle", "source_page": 0}, ["type", "page"]),
    ({"source_page": None}, []),
    ({"source_page": "two"}, ["page"]),
    ({"knowledge_points": []}, ["topics", "primary"]),
    ({"knowledge_points": "LACKING"}, ["topics", "primary"]),
    ({"knowledge_points": [point()] * 4}, ["topics"]),
    ({"knowledge_points": [point(role="secondary"), point(role="secondary")]}, ["primary"]),
    ({"knowledge_points": [point(weight=1.01)]}, ["weight"]),
    ({"knowledge_points": [point(), point(weight=-0.1, role="other", name="", chapter=None)]}, ["topic_name", "chapter", "role", "weight"]),
    ({"knowledge_points": [point(weight=0), point(weight=1)]}, []),
]
SPLITS = [
    ({"content": "c"}, []),
    ({"content": "c", "page": None, "question_number": None, "noise_reason": None}, []),
    ({"content": ""}, ["content"]),
    ({"page": 0, "content": "c"}, ["page"]),
    ({"is_noise": "maybe", "content": "c", "question_number": 3}, ["number", "noise"]),
    ({"is_noise": None, "content": "c"}, ["noise"]),
]
GROUPS = [({"canonical": "a", "duplicates": ["b"]}, []), ({"canonical": "", "duplicates": []}, ["canonical", "duplicates"]), ({"duplicates": ["x"]}, ["canonical"])]


def test_kinds_of_responses_share_one_pass(spark):
    rows = [
        (1, "enrich", json.dumps({"questions": [question(**c) for c, _ in QUESTIONS]})),
        (2, "split", json.dumps({"questions": [q for q, _ in SPLITS]})),
        (3, "groups", json.dumps([g for g, _ in GROUPS])),
        (4, "enrich", '{"questions":[]}'),
        (5, "split", '{"questions":[]}'),
        (6, "enrich", '{"other":1}'),
        (7, "split", '{"questions":7}'),
        (8, "song", "{}"),
        (9, None, "{}"),
        (10, "groups", '{"canonical":"a"}'),
        (11, "split", "not json"),
        (12, "enrich", None),
    ]
    parsed = spark.createDataFrame(rows, "response_id long, record string, json string")
    got = {(r.response_id, r.at): r.broken for r in V.judge(parsed, record="record").drop("item").collect()}
    expected = {(n, k): b for n, cases in ((1, QUESTIONS), (2, SPLITS), (3, GROUPS)) for k, (_, b) in enumerate(cases)}
    expected |= {(n, None): ["records"] for n in (4, 6, 7, 10, 11, 12)} | {(8, None): ["record"], (9, None): ["record"]}
    assert got == expected
    valid, rejected = N.validate_responses(parsed, record="record")
    assert {(r.response_id, r.at) for r in valid.drop("item").collect()} == {k for k, b in expected.items() if not b}
    counts = {(r.record, r.rule): r.n for r in V.failure_counts(rejected).collect()}
    assert counts["enrich", "topics"] == 3 and counts["enrich", "records"] == 3 and counts["song", "record"] == 1
    q = V.typed(valid, "enrich").filter("at = 15").first().q
    assert [p.weight for p in q.knowledge_points] == [0.0, 1.0]


def test_rules_are_a_table(spark):
    rules = (V.Rule("note", "short", "text", "size", (0, 2)), V.Rule("note", "mark", "mark", "between", (1, 6)))
    parsed = spark.createDataFrame([(1, "note", '{"notes":[{"text":[1],"mark":3},{"text":[1,2,3],"mark":9}]}')], "response_id long, record string, json string")
    got = V.judge(parsed, rules, {"note": V.Records("$.notes")}, "record").orderBy("at").collect()
    assert [r.broken for r in got] == [[], ["short", "mark"]]


def test_a_page_whose_split_breaks_a_rule_keeps_its_spans(spark):
    parsed = spark.createDataFrame([("d", 1, '{"questions":[{"content":"q"},{"content":"n","is_noise":true}]}'), ("d", 2, '{"questions":[{"content":"good"},{"content":""}]}'), ("d", 3, '{"questions":[]}')], "document_id string, page int, json string")
    spans = spark.createDataFrame([("d", 0, [1], "1", "a"), ("d", 1, [2], "2", "b"), ("d", 2, [3], "3", "c"), ("d", 3, [4], "4", "e")], "document_id string, span int, pages array<int>, number string, text string")
    failed = spark.createDataFrame([("d", 4)], "document_id string, page int")
    got = {(r.page, r.text, r.origin) for r in N.apply_splits(parsed, spans, failed).collect()}
    assert got == {(1, "q", "response"), (2, "b", "rules"), (4, "e", "rules")}


def test_groups_of_responses_become_aliases(spark):
    parsed = spark.createDataFrame([(1, '[{"canonical":" k ","duplicates":["a"," ","b "]},{"canonical":"m","duplicates":["a"]},{"canonical":"n","duplicates":[" "]}]'), (2, '[{"canonical":"","duplicates":["c"]}]')], "response_id long, json string")
    groups = N.duplicate_groups(parsed)
    aliases, applied = vocab.apply_groups(spark.createDataFrame([("b", "old"), ("z", "y")], "alias string, canonical string"), groups)
    assert {tuple(r) for r in aliases.collect()} == {("a", "m"), ("b", "k"), ("z", "y")} and applied.first().applied == 3


@pytest.mark.parametrize(
    ("given", "out"),
    [("```json\n[1]\n```", "[1]"), ("```\n[1]", "[1]"), ("  ```x\n[1]\n  ``` ", "[1]"), ("[1]\n```", "[1]\n```"), ("```", ""), ("a ``` b", "a ``` b")],
)
def test_fences(given, out):
    assert N._without_fences(given) == out


# --- tags


def test_replacing_links_makes_tags(spark):
    links = spark.createDataFrame([(1, 1, "primary", 1.0), (2, 1, "primary", 1.0), (3, 2, "primary", 1.0)], "item_id long, topic_id long, role string, weight double")
    tags = spark.createDataFrame([(4, "a"), (7, "z")], "id long, name string")
    item_tags = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "item_id long, tag_id long")
    topics = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, ""), (5, "c")], "id long, name string")
    new = spark.createDataFrame([(1, 2, None, "0.01"), (1, 3, "secondary", "x"), (1, 4, "primary", "1"), (1, 5, "primary", "0.2"), (1, 5, "secondary", "0.9")], "item_id long, topic_id long, role string, weight string")
    out, known, owned = R.replace_links(links, tags, item_tags, new, topics, spark.createDataFrame([(3,)], "item_id long"))
    assert {tuple(r) for r in out.collect()} == {(2, 1, "primary", 1.0), (1, 2, "primary", 0.1), (1, 3, "secondary", 1.0), (1, 4, "primary", 1.0), (1, 5, "secondary", 0.9)}
    assert {tuple(r) for r in known.collect()} == {(4, "a"), (7, "z"), (8, "b"), (9, "c")}
    assert {tuple(r) for r in owned.collect()} == {(2, 7), (1, 8), (1, 9)}


# --- blocks


def test_figures_captions_and_confidence(spark):
    text = (
        '[[{"type":"figure","confidence":0.5,"polygon":[[0,1],[2,3]],"content":{"image_source":{"path":"a.png"},"caption":[{"type":"text","content":"Fig ","confidence":0.9},{"type":"equation_inline","content":"x"}]}},'
        '{"type":"figure","content":{}},{"type":"equation_block","content":{"math_content":"y","image_source":{"path":"b.JPG"}}},'
        '{"type":"paragraph","content":{"paragraph_content":[{"type":"text","content":"see "},{"type":"image","content":"c.png"},{"type":"hologram","content":"h"}]}},'
        '{"type":"caption","content":{}},{"type":"page_number","content":"3"},{"type":"page_header","content":"head"},{"type":"aside_text","content":""},{"type":"hologram","content":{}},'
        '{"type":"table","content":{}},{"type":"title","content":{"title_content":[{"type":"text","content":"T"}]}}]]'
    )
    blocks = ocr.blocks_of(spark.createDataFrame([("d", text)], "document_id string, json string"))
    rows = blocks.orderBy("reading_order").collect()
    assert rows[0].confidence == 0.5 and rows[0].polygon == [[0.0, 1.0], [2.0, 3.0]] and rows[0].caption[0].confidence == 0.9 and rows[2].math_type == "latex"
    named, images = ocr.with_image_refs(blocks)
    assert [r.image_ref for r in named.orderBy("reading_order").collect()][:3] == ["d_img0001", None, "d_img0002"]
    assert {(r.image_id, r.path, r.mime_type) for r in images.collect()} == {("d_img0001", "a.png", "image/png"), ("d_img0002", "b.JPG", "image/jpeg")}
    expected = ["![Fig $x$](a.png)", "![](unknown.png)", "$$\ny\n$$\n![formula](b.JPG)", "see ![inline](c.png)h", "**", "---\nhead\n---", "[表格: (见原始数据)]", "# T"]
    assert B.render_markdown(blocks).first().markdown == "\n\n".join(expected) + "\n"


def test_details_name_every_noise_and_candidate(spark):
    rows = [("d", 1, 0, "paragraph", None, None, [("text", "答题区")]), ("d", 1, 1, "paragraph", None, None, [("text", "5 this is a question of length")]), ("d", 1, 2, "paragraph", None, None, [("text", "plain")])]
    blocks = spark.createDataFrame(rows, "document_id string, page int, reading_order int, type string, level int, text string, inlines array<struct<type:string, content:string>>")
    got = [tuple(r) for r in B.detection_details(B.annotate_candidates(B.annotate_noise(blocks))).orderBy("reading_order").collect()]
    assert got == [("d", 1, 0, "noise", "answer_area", None, None), ("d", 1, 1, "candidate", "leading_number", 0.9, "5")]


@pytest.mark.parametrize(
    ("given", "out"),
    [
        ("\\alpha $x$ \\beta", "$\\alpha $x$ \\beta$"),
        ("\\alpha $x, y$ \\beta", "$\\alpha $$x, y$ $\\beta$"),
        ("$$\\a$$ \\b $\\c$", "$$\\a$$ $\\b $$\\c$"),
        ("\\a $x$, \\b $y$ \\c z", "$\\a $$x$, $\\b $y$ \\c z$"),
        ("$\\a$", "$\\a$"),
        ("\\a $open", "$\\a $$open"),
    ],
)
def test_math_between_commands(spark, given, out):
    assert T.delimit_formulas(spark.createDataFrame([(given,)], "text string")).first().delimited == out
