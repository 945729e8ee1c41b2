"""Category tokens, the taxonomy, and the absorption of transit and neutral stops."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .geo import _c

# Activity of each middle level of the taxonomy, and the labels that can be absorbed.
MID_TO_ACTIVITY = {
    "Food & Dining": "FoodDrink",
    "Café & Coffee": "FoodDrink",
    "Bars & Nightlife": "NightlifeLeisure",
    "Shopping & Retail": "Shopping",
    "Arts & Culture": "Leisure",
    "Entertainment": "Leisure",
    "Outdoors & Recreation": "Leisure",
    "Sports & Fitness": "Leisure",
    "Education": "WorkEducation",
    "Transportation": "Transit",
    "Services & Errands": "ServiceErrand",
    "Accommodation": "StayResidential",
    "Religious & Spiritual": "CivicSpiritual",
    "Work & Office": "WorkEducation",
    "Work & Event": "WorkEvent",
    "Residential": "StayResidential",
    "Neutral / Generic": "Neutral",
}
TRANSIT, NEUTRAL, UNKNOWN, UNRESOLVED = "Transit", "Neutral", "unknown", "transit_unresolved"

#: Middle level of a raw category by words in its name, first match first; a stand-in where no table is given.
MID_RULES = (
    ("Café & Coffee", r"coffee|café|cafe|tea room"),
    ("Bars & Nightlife", r"\bbar\b|pub|nightclub|lounge|brewery|speakeasy"),
    ("Food & Dining", r"restaurant|diner|joint|place|pizza|bakery|deli|food|burger|steak|sandwich|ice cream|noodle"),
    ("Transportation", r"subway|train|bus|ferry|airport|taxi|metro|station|parking"),
    ("Sports & Fitness", r"gym|fitness|stadium|athletic|pool|yoga"),
    ("Outdoors & Recreation", r"park|beach|garden|outdoors|trail|playground|plaza"),
    ("Education", r"school|college|university|student|library"),
    ("Accommodation", r"hotel|hostel|bed & breakfast"),
    ("Residential", r"home|residential|apartment|housing"),
    ("Religious & Spiritual", r"church|temple|mosque|synagogue|shrine"),
    ("Work & Event", r"convention|conference|event space"),
    ("Work & Office", r"office|factory|coworking"),
    ("Shopping & Retail", r"store|shop|mall|market|boutique"),
    ("Arts & Culture", r"museum|gallery|theater|arts"),
    ("Entertainment", r"cinema|movie|arcade|casino|music venue|concert|bowling"),
    ("Services & Errands", r"bank|salon|laundry|medical|doctor|post office|gas station|hospital|service"),
    ("Neutral / Generic", r"^(city|bridge|building|cemetery|neighborhood|road)$"),
)


def token_a(text) -> Column:
    """Trimmed, lower case, runs of white space as one underscore."""
    return F.regexp_replace(F.lower(F.trim(_c(text))), r"\s+", "_")


def token_b(text) -> Column:
    """Trimmed, lower case, every space an underscore, & spelt out."""
    return F.replace(F.replace(F.lower(F.trim(_c(text))), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))


def safe_text(value, default: str = "unknown") -> Column:
    return F.coalesce(_c(value).cast("string"), F.lit(default))


def taxonomy(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """(raw, mid, activity) from pairs of raw category and middle level, or, for raw names alone, by MID_RULES."""
    return activities(spark.createDataFrame([(r, m) for r, m in rows], "raw string, mid string"))


def activities(pairs: DataFrame) -> DataFrame:
    """(raw, mid, activity), one row a raw category: where it is given twice, the smaller middle level stands."""
    table = pairs.groupBy("raw").agg(F.min("mid").alias("mid"))
    activity = F.create_map(*[F.lit(x) for pair in MID_TO_ACTIVITY.items() for x in pair])
    return table.withColumn("activity", F.coalesce(F.try_element_at(activity, F.col("mid")), F.lit(UNKNOWN)))


def mid_by_rule(raw) -> Column:
    out = F.when(_c(raw).isNull(), UNKNOWN)
    for mid, pattern in MID_RULES:
        out = out.when(F.lower(_c(raw)).rlike(pattern), mid)
    return out.otherwise(UNKNOWN)


def with_taxonomy(checkins: DataFrame, table: DataFrame, category: str = "Category") -> DataFrame:
    """checkins with mid and activity; categories outside the table are unknown.  The table is a few hundred rows."""
    found = checkins.join(F.broadcast(table.withColumnRenamed("raw", category)), category, "left")
    return found.withColumn("mid", F.coalesce("mid", F.lit(UNKNOWN))).withColumn("activity", F.coalesce("activity", F.lit(UNKNOWN)))


def absorb(rows: DataFrame, token: str, session: str, order: list[str], transit: bool = True, neutral: bool = True, online: bool = False, out: str = "token") -> DataFrame:
    """rows with ``out``: the token after transit and neutral stops took that of a neighbour.

    Transit takes the next token of a stop that isn't transit, else (retrospective) the previous one or (online) the
    unresolved mark.  Neutral stops then take the previous, else the next, value of a stop that isn't neutral; which
    stops are neutral is told by the original activity, so a transit stop that took a neutral one's token keeps it.
    """
    w = Window.partitionBy(session).orderBy(*order)
    ahead, behind = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(token)
    rows = rows.withColumn("_token", value)
    if transit:
        moving = F.col("activity") == TRANSIT
        plain = F.when(~moving, value)
        after, before = F.first(plain, ignorenulls=True).over(ahead), F.last(plain, ignorenulls=True).over(behind)
        rows = rows.withColumn("_token", F.when(moving, F.coalesce(after, F.lit(UNRESOLVED) if online else before, value)).otherwise(value))
    if neutral:
        idle = F.col("activity") == NEUTRAL
        kept = F.when(~idle, F.col("_token"))
        before, after = F.last(kept, ignorenulls=True).over(behind), F.first(kept, ignorenulls=True).over(ahead)
        rows = rows.withColumn("_token2", F.when(idle, F.coalesce(before, after, F.col("_token"))).otherwise(F.col("_token")))
        rows = rows.drop("_token").withColumnRenamed("_token2", "_token")
    return rows.withColumnRenamed("_token", out)


def ordered_list(value: str, order: list[str]) -> Column:
    """Values of a group in an order that ends in a unique key."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"])


def strip_edge_marks(token: Column) -> Column:
    """The token from its first to its last word character: what a pattern of non-spaces between word boundaries takes."""
    return F.regexp_extract(token, r"(?U)(\w(?:\S*\w)?)", 1)
