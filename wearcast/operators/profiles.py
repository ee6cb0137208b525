"""Activity profiles that inherit, over tables.

Every activity may name a parent; its description of an item is that of the
nearest activity up the line that mentions the item, and a mention without a
description deletes it.  The lines of descent come from one recursive query
over the parent table, so profiles may be as deep as they like; a line that
comes back to itself is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearcast.session import shared_path


ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_path(df.sparkSession, "profiles", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ancestry(parents: DataFrame, max_depth: int = 50) -> DataFrame:
    """``(activity, ancestor, depth)`` for every activity and each of its
    ancestors, itself at depth 0.  ``parents(activity, parent)`` has one row per
    activity; a NULL parent, or one that is no activity itself, ends the line
    (such a parent still counts as the last ancestor).

    A cycle, a line of more than ``max_depth`` steps, or an activity with two
    parents raises an error when the result is computed.  Rows with a NULL
    activity are left out.

    The recursion goes over the activities that are parents themselves; one
    that is nobody's parent has its own parent's line, a step longer, by a
    join.  Spark fails a recursive query beyond
    ``spark.sql.cteRecursionRowLimit`` rows, so that limit is off while the
    lines are written, and as it was after."""
    spark = parents.sparkSession
    rows = parents.where("activity IS NOT NULL").groupBy("activity").agg(F.collect_set("parent").alias("p"))
    one = rows.select("activity", F.when(F.size("p") > 1, F.raise_error(F.concat(F.lit("several parents of activity "), "activity"))).otherwise(F.get("p", F.lit(0))).alias("parent"))
    one = _stored(one, "parents")
    used = one.where("parent IS NOT NULL").select(F.col("parent").alias("activity")).distinct()
    inner, leaves = one.join(used, "activity", "left_semi"), one.join(used, "activity", "left_anti")
    lines = spark.sql(
        f"""WITH RECURSIVE line(activity, ancestor, depth, passed, looped) MAX RECURSION LEVEL {max_depth + 2} AS (
          SELECT activity, activity, 0, array(activity), false FROM {{one}}
          UNION ALL
          SELECT l.activity, p.parent, l.depth + 1, array_append(l.passed, p.parent), array_contains(l.passed, p.parent)
          FROM line l JOIN {{one}} p ON l.ancestor = p.activity
          WHERE p.parent IS NOT NULL AND NOT l.looped AND l.depth <= {max_depth})
        SELECT * FROM line""",
        one=inner,
    )
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        lines = _stored(lines, "lines")
    finally:
        spark.conf.set(ROW_LIMIT, before)
    own = leaves.select("activity", F.col("activity").alias("ancestor"), F.lit(0).alias("depth"), F.array("activity").alias("passed"), F.lit(False).alias("looped"))
    passed = F.concat(F.array(leaves["activity"]), F.coalesce(lines["passed"], F.array("parent")))
    above = leaves.where("parent IS NOT NULL").join(lines, leaves["parent"] == lines["activity"], "left").select(
        leaves["activity"], F.coalesce("ancestor", "parent").alias("ancestor"), (F.coalesce("depth", F.lit(0)) + 1).alias("depth"),
        passed.alias("passed"), F.coalesce("looped", F.lit(False)).alias("looped"))
    chain = lines.unionByName(own).unionByName(above.where(F.col("depth") <= max_depth + 1))
    wrong = F.when(F.col("looped"), F.raise_error(F.concat(F.lit("profiles in a circle: "), F.array_join("passed", " > "))))
    deep = F.when(F.col("depth") > max_depth, F.raise_error(F.concat(F.lit(f"more than {max_depth} profiles in line: "), F.col("activity"))))
    return chain.select("activity", F.coalesce(wrong.cast("string"), deep.cast("string"), F.col("ancestor")).alias("ancestor"), "depth")


def resolve_inherited(parents: DataFrame, overrides: DataFrame) -> DataFrame:
    """``(activity, item, description, alt_description, depth)``: for every
    activity and every item that it or an ancestor mentions, the nearest
    mention and how far up it stands.  A NULL description is a deletion and
    hides what stands above it.

    ``overrides(activity, item, description, alt_description)``: of several
    rows for one activity and item the greatest counts, a description before
    a deletion.  Overrides of unknown activities and NULL items are unused."""
    mentions = overrides.where("item IS NOT NULL").groupBy(F.col("activity").alias("ancestor"), "item").agg(F.max(F.struct("description", "alt_description")).alias("d"))
    line = ancestry(parents)
    nearest = F.row_number().over(Window.partitionBy("activity", "item").orderBy("depth"))
    found = line.join(mentions, "ancestor").withColumn("nth", nearest).where("nth = 1")
    return found.select("activity", "item", "d.description", "d.alt_description", "depth")


def described(resolved: DataFrame) -> DataFrame:
    """The items an activity describes: deletions left out."""
    return resolved.where("description IS NOT NULL").drop("depth")
