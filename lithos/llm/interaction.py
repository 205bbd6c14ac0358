"""How filters act on each other in every order: an audit in long form.

Each document has a mask, one bit for each filter that it fails. Documents are counted by part and mask, so
what follows is as small as parts times masks. The cells of that table are unpivoted against the steps of every order;
a running bit-or over the steps before tells whether a cell has failed earlier. Conditional sums give the counts of each
step, and a window over all orders of a filter gives its total.

Copies: a document fails the copy filter if a smaller id has the same text. Texts are compared by SHA-256; groups of
copies meet by one aggregation (combined map-side) and an outer join that Spark can split where one text has many rows.

Edge cases: a null or empty text has no words and fails ``A`` (and ``E`` if a smaller id has none either); a null part is the
empty string, like an empty one; rows with a null id have no smaller id, are nobody's original and have no labels;
repeated rows of one id and text count each, and aren't copies of one another; several labels of an id count
as one that has any of their marks; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.session import cut

#: The copy filter's letter; its bit is found by joining, the others' from the text alone.
COPY = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: letter to condition of failing."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, letters: str, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, mask) of each row; bit k of the mask is set if the k-th of ``letters`` fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = text_failures(text)
    bits = [F.when(fails[x], F.lit(1 << k)).otherwise(0) for k, x in enumerate(letters) if x in fails]
    own = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), sum(bits, F.lit(0)).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    if COPY not in letters:
        return own.select("id", "part", "mask")
    # short rows; the texts are read once
    own = cut(own)
    first = cut(own.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    mask = F.col("mask") + F.when(copy, F.lit(1 << letters.index(COPY))).otherwise(0)
    return own.join(first, "digest", "left").select("id", "part", mask.alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and of these the ones labelled good and toxic."""
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in ((quality_col, "good"), (toxic_col, "toxic"))))
    known = masked.filter("id IS NOT NULL").join(cut(marks), "id", "left").select("part", "mask", "good", "toxic")
    none = F.lit(None).cast("int")
    rows = known.unionByName(masked.filter("id IS NULL").select("part", "mask", none.alias("good"), none.alias("toxic")))
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def evaluate(counted: DataFrame, letters: str) -> DataFrame:
    """The metrics of each part, order of ``letters`` and step, from ``cells``."""
    orders = ",".join("".join(p) for p in permutations(letters))
    steps = counted.select("*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("letter", F.expr("substr(filter_order, step, 1)"))
    bit = F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)")
    steps = steps.withColumn("fails", F.col("mask").bitwiseAND(bit))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, earlier = F.col("fails") != 0, F.col("earlier") != 0

    def total(when: Column, of: str, name: str) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0)).alias(name)

    out = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~earlier, "n", "kept"),
        total(fails & ~earlier, "n", "removed"),
        total(fails & earlier, "n", "redundant"),
        total(fails & ~earlier, "good", "good_lost"),
        total(fails & ~earlier, "toxic", "toxic_lost"),
        total(fails & (F.col("mask") == F.col("fails")), "n", "unique_fails"),
    )
    over_orders = Window.partitionBy("part", "letter")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(over_orders).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return evaluate(cells(masks(docs, letters, part_col, id_col, text_col), labels, id_col), letters)
