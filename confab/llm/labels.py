"""Dirty labels of one entity (session) to one canonical label.

Two labels of an entity are the same speaker if they differ only in the way
they are written - case, marks, blanks, punctuation - or by slips of the
keyboard; labels with different numbers never are.  Slips are found by an
equi-join on deletion forms, so no two labels meet that are not within reach of
each other: a slip joins its most frequent neighbour (the hub), and slips of a
label that is itself missing join each other by a shared head or tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.llm.names import compact, deletions, digits, one_slip
from confab.session import cut, cut_bare

LEAST = 4  # shorter keys are taken as written
EDGE = 8  # letters of head and tail by which two slips of a missing label meet


def _weight(n: str, key: str) -> Column:
    """Orders the labels of an entity: frequent first, then by text; total, so that hubs are definite."""
    return F.struct(F.col(n).alias("n"), F.col(key).alias("key"))


def label_keys(label: Column) -> Column:
    """The written key of a label; null for a null label or one without letters and digits."""
    key = compact(label)
    return F.when(key != "", key)


def canonical_labels(rows: DataFrame, entity: str, label: str) -> DataFrame:
    """(entity, key, canonical) for each distinct written key of each entity.

    Counts are pre-aggregated before the shuffle, so an entity that holds a
    third of the rows brings only its distinct labels.  These are few and are
    written once; what follows reads no row of the table again.  Null labels
    have no row.
    """
    same = ["entity", "digits"]
    counted = rows.select(F.col(entity).alias("entity"), label_keys(F.col(label)).alias("key")).filter("key is not null").groupBy("entity", "key").agg(F.count("*").alias("n"))
    keys = cut(counted.withColumn("digits", digits(F.col("key"))))
    long = keys.filter(F.length("key") >= LEAST)
    # the most frequent label of each form is the hub that the form's other labels may join
    best = lambda by: F.max(_weight("n", "key")).over(Window.partitionBy(*same, by))
    forms = long.withColumn("form", F.explode(deletions(F.col("key")))).withColumn("best", best("form"))
    reach = forms.filter(_weight("n", "key") < F.col("best")).filter(one_slip(F.col("key"), F.col("best.key")))
    direct = cut(reach.groupBy(*same, "key").agg(F.max("best").getField("key").alias("hub")))
    # slips that nobody leads or joins, and that stand there once or twice, join each other by a shared head or tail
    led = direct.select(*same, F.col("key")).unionByName(direct.select(*same, F.col("hub").alias("key"))).distinct()
    lone = long.filter((F.col("n") <= 2) & (F.length("key") >= 2 * EDGE)).join(led, [*same, "key"], "left_anti")
    edges = lone.withColumn("edge", F.explode(F.array(F.concat(F.lit("<"), F.left("key", F.lit(EDGE))), F.concat(F.lit(">"), F.right("key", F.lit(EDGE)))))).withColumn("best", best("edge"))
    met = edges.filter(F.col("key") != F.col("best.key")).filter(F.levenshtein(F.col("key"), F.col("best.key")) <= 2)
    partners = met.groupBy(*same, "key").agg(F.max("best.key").alias("partner"))
    roots = keys.join(_roots(direct), [*same, "key"], "left").join(partners, [*same, "key"], "left")
    return roots.select("entity", "key", F.coalesce("partner", "root", "key").alias("canonical"))


def _roots(direct: DataFrame) -> DataFrame:
    """(entity, digits, key, root) of labels with a hub: the last hub of each chain.  A hub weighs more than what joins it, so chains end; each round halves them."""
    up = direct.withColumnRenamed("hub", "root")
    while True:
        further = up.select("entity", "digits", F.col("key").alias("root"), F.col("root").alias("top"))
        if up.join(further, ["entity", "digits", "root"], "left_semi").isEmpty():
            return up
        up = cut_bare(up.join(further, ["entity", "digits", "root"], "left").select("entity", "digits", "key", F.coalesce("top", "root").alias("root")))
