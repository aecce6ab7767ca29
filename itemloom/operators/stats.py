"""Mastery statistics, topic weakness and review recommendation.

Weights are decimals and points exact decimals, so sums don't depend on order;
ratios are taken in doubles at the end.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.operators.items import with_hierarchy

# Weakness points by mastery level.
WEAKNESS_POINTS = {1: "1.5", 2: "1.0", 3: "0.55", 4: "0.2", 5: "0"}
# Recommendation base score by mastery level, and for any other level.
MASTERY_SCORES = {1: 10, 2: 8, 3: 5, 4: 2, 5: 1}
OTHER_SCORE = 8
# Mastery labels and colours by level.
MASTERY_LABELS = {
    0: ("unmarked", "grey"),
    1: ("blind spot", "red"),
    2: ("only started", "orange"),
    3: ("error-prone", "yellow"),
    4: ("independent", "blue"),
    5: ("effortless", "green"),
}
DAYS_CAP, DAYS_UNKNOWN = 30, 15
UNCATEGORISED = "uncategorised"


def points_of(mastery: Column, points: dict[int, str] = WEAKNESS_POINTS) -> Column:
    out = F.lit(Decimal("0")).cast("decimal(4,2)")
    for level, p in points.items():
        out = F.when(mastery == level, F.lit(Decimal(p)).cast("decimal(4,2)")).otherwise(out)
    return out


def dashboard_counts(subjects: DataFrame, chapters: DataFrame, topics: DataFrame, items: DataFrame) -> DataFrame:
    """One row: numbers of subjects, chapters, topics and items, and items by mastery band."""
    m = F.col("mastery_level")
    by_band = items.agg(F.count("*").alias("n_items"), F.count_if(m >= 4).alias("mastered"), F.count_if(m == 3).alias("fuzzy"), F.count_if(m.isin(1, 2)).alias("weak"))
    out = by_band
    for name, df in (("n_subjects", subjects), ("n_chapters", chapters), ("n_topics", topics)):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))  # one row by one row
    return out.select("n_subjects", "n_chapters", "n_topics", "n_items", "mastered", "fuzzy", "weak")


def mastery_distribution(items: DataFrame) -> DataFrame:
    return items.filter("mastery_level > 0").groupBy("mastery_level").agg(F.count("*").alias("n"))


def subject_mastery(items: DataFrame, subjects: DataFrame) -> DataFrame:
    """Marked items by subject and level."""
    n = items.filter("mastery_level > 0").groupBy("subject_id", "mastery_level").agg(F.count("*").alias("n"))
    return n.join(subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id").select("subject_id", "subject", "mastery_level", "n")


def subject_mastery_matrix(items: DataFrame, subjects: DataFrame, levels: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """One row for each subject with a count for each level, 0 where there is none."""
    counts = [F.count_if(F.col("mastery_level") == k).alias(f"level_{k}") for k in levels]
    n = items.groupBy(F.col("subject_id").alias("of_subject")).agg(*counts)
    joined = subjects.join(n, F.col("id") == F.col("of_subject"), "left")
    return joined.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"), *(F.coalesce(f"level_{k}", F.lit(0).cast("bigint")).alias(f"level_{k}") for k in levels))


def topic_weakness(items: DataFrame, links: DataFrame, topics: DataFrame, chapters: DataFrame, subjects: DataFrame, points: dict[int, str] = WEAKNESS_POINTS) -> DataFrame:
    """Weighted weakness of every topic with a marked item, and its mastery rate.

    Links are summed by topic before the hierarchy is joined. A topic whose weights
    sum to zero has weakness and rate 0.
    """
    most = float(max(Decimal(p) for p in points.values()))
    marked = items.filter("mastery_level > 0").select(F.col("id").alias("item_id"), points_of(F.col("mastery_level"), points).alias("points"))
    sums = links.join(marked, "item_id").groupBy("topic_id").agg(F.sum("weight").alias("total"), F.sum(F.col("points") * F.col("weight")).alias("weak"), F.count("*").alias("n_items"))
    total, weak = F.col("total").cast("double"), F.col("weak").cast("double")
    score = F.when(total > 0, weak / (total * most)).otherwise(0.0)
    rated = sums.select("topic_id", "n_items", score.alias("weakness"), F.when(total > 0, (1 - score) * 100).otherwise(0.0).alias("mastery_rate"))
    return with_hierarchy(rated, topics, chapters, subjects).select("topic_id", "topic", "chapter", "subject", "n_items", "weakness", "mastery_rate", "topic_subject_id", "chapter_order", "topic_order")




def by_weakness(weakness: DataFrame) -> DataFrame:
    return weakness.orderBy(F.desc("weakness"), "topic_subject_id", "chapter_order", "topic_order")


def weakness_bands(weakness: DataFrame, hi: float = 0.6, mid: float = 0.3) -> DataFrame:
    """Weakness with a band, an exam group, and a running number inside the subject."""
    band = F.when(F.col("weakness") > hi, "high").when(F.col("weakness") > mid, "medium").otherwise("low")
    place = F.row_number().over(Window.partitionBy("topic_subject_id").orderBy(F.desc("weakness"), "chapter_order", "topic_order"))
    return weakness.select(F.lit(UNCATEGORISED).alias("exam"), "subject", "topic_id", "topic", "weakness", band.alias("band"), place.cast("bigint").alias("place"))


def weakest(weakness: DataFrame, n: int = 20) -> DataFrame:
    return by_weakness(weakness).limit(n)


def topic_need(items: DataFrame, links: DataFrame, points: dict[int, str] = WEAKNESS_POINTS) -> DataFrame:
    """Weakness for recommendation: all items count, unmarked ones with 0 points."""
    marked = items.select(F.col("id").alias("item_id"), points_of(F.col("mastery_level"), points).alias("points"))
    sums = links.join(marked, "item_id").groupBy("topic_id").agg(F.sum("weight").alias("total"), F.sum(F.col("points") * F.col("weight")).alias("weak"))
    total = F.coalesce(F.nullif(F.col("total").cast("double"), F.lit(0.0)), F.lit(1.0))
    return sums.select("topic_id", (F.col("weak").cast("double") / total).alias("need"))


def scored_items(items: DataFrame, links: DataFrame, now: str, subject: int | None = None) -> DataFrame:
    """Marked items with the score of their leading link: id, topic_id, score.

    The leading link is the primary one, then the heaviest, then the least topic id.
    """
    chosen = items.filter("mastery_level > 0")
    if subject is not None:
        chosen = chosen.filter(F.col("subject_id") == subject)
    lead = F.struct((F.col("role") != "primary").alias("secondary"), (-F.col("weight")).alias("lighter"), "topic_id")
    first = links.groupBy("item_id").agg(F.min(lead).alias("lead")).select("item_id", F.col("lead.topic_id").alias("topic_id"), F.col("lead.secondary").alias("secondary"))
    base = F.lit(OTHER_SCORE)
    for level, s in MASTERY_SCORES.items():
        base = F.when(F.col("mastery_level") == level, s).otherwise(base)
    seconds = F.lit(now).cast("timestamp").cast("long") - F.col("updated_at").cast("timestamp").cast("long")
    days = F.coalesce(F.least(F.floor(seconds / 86400), F.lit(DAYS_CAP)), F.lit(DAYS_UNKNOWN))
    joined = chosen.join(first, F.col("id") == F.col("item_id")).join(topic_need(items, links), "topic_id", "left")
    score = base * (1 + F.coalesce("need", F.lit(0.0))) * (1 + days / DAYS_CAP) * F.when(F.col("secondary"), 0.5).otherwise(1.0)
    return joined.select("id", "topic_id", score.alias("score"))


def recommend(items: DataFrame, links: DataFrame, topics: DataFrame, now: str, n: int = 20, subject: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``n`` items most worth a review with a rounded score, and the number scored.

    Items are ranked on the unrounded score; the id breaks ties.
    """
    scored = scored_items(items, links, now, subject)
    top = scored.orderBy(F.desc("score"), "id").limit(n)
    names = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic"))
    return top.join(names, "topic_id").select("id", "topic", F.round("score", 2).alias("score")), scored.agg(F.count("*").alias("total"))


def label_mastery(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with label and colour of their level, and the rows whose level is unknown."""
    pick = lambda k: F.create_map(*[F.lit(x) for level, pair in MASTERY_LABELS.items() for x in (level, pair[k])])[F.col("mastery_level")]
    known = F.col("mastery_level").isin(*MASTERY_LABELS)
    valid = df.filter(known).withColumn("label", pick(0)).withColumn("colour", pick(1))
    return valid, df.filter(~known | F.col("mastery_level").isNull())
