"""L1, L2, L7 for many models at once: one set of trees per (athlete, activity)
or any other key.

Training rows are laid side by side by group (``group_tasks.packer``), classes
as numbers, and a task grows all trees of thousands of groups together from
exact counts by (group, label, node, feature, value, class)
(``group_tasks.grower``): nothing loops over groups, and rows cross the network
as packed numbers.

A group of more than ``MOST_ROWS`` rows, or with values that are not finite, is
grown level by level over all tasks, and so are all groups where rows have
weights, a key is of a kind that Python compares otherwise or a label has more
than ``MOST_CLASSES`` classes.  A level is one histogram: class weights per
(group, label, node, feature, value), a partially aggregated shuffle, from which
native window sums give the gini gain of every threshold.  Such a group is
summed up in every task first, and the windows behind it hold at most
``max_bins`` values x classes per node and feature.  Both ways give the same trees.

Models are rows of one node table (``trees.NODE_SCHEMA`` behind the group's
columns).  Rows meet the models of their part of the groups in a task, rows of a
large group in several; or a model is taken out by itself.
"""

from __future__ import annotations

import datetime as dt
import gc
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wearcast import schema as S
from wearcast.functions.weather import humidity_fraction
from wearcast.operators.group_tasks import applier, bundler, grower, packer, unpacker
from wearcast.operators.model import feature_cuts
from wearcast.operators.trees import TreeModel, model_of_rows
from wearcast.session import shared_path

GROUP = ("athlete", "activity")
WEIGHT = "_weight"
MOST_ROWS = 1_000_000  # of a group in one task
MOST_CLASSES = 64


def _stored(df: DataFrame, name: str, release: bool = False, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage.
    With ``release`` the driver collects its garbage then, upon which Spark
    deletes the shuffle files that led to the table."""
    spark = df.sparkSession
    path = shared_path(spark, "trees", name)
    df.write.option("compression", compression).parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equality of group keys; NULL is a key like any other."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def _binned(df: DataFrame, features: Sequence[str], cuts: dict[str, list[float]]) -> dict[str, Column]:
    """A feature as a number; one with cuts as the number of cuts at or below
    it.  A value of a bin is then any whole number, and a threshold between two
    bins stands for the cut between them."""

    def bin_of(x: Column, at: list[float]) -> Column:
        below = F.filter(F.array(*[F.lit(c) for c in at]), lambda c: x >= c)
        return F.when(x.isNotNull(), F.size(below).cast("double"))

    numbers = {f: F.col(f).cast("double") for f in features}
    return {f: bin_of(x, cuts[f]) if f in cuts else x for f, x in numbers.items()}


def _path(trees: Column, x: Column, depth: int) -> Column:
    """The node that a row reaches, from ``trees``, the splits of one label by
    node number, and the array ``x`` of feature values."""

    def step(node: Column, _: Column) -> Column:
        split = F.try_element_at(trees, node)
        right = F.when(F.get(x, split["f"]) <= split["t"], 0).otherwise(1)
        return F.when(split.isNull(), node).otherwise(2 * node + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1).cast("long"), step)


def _histogram(rows: DataFrame, keys: list[str], depth: int, last: bool) -> DataFrame:
    """Class weights of the nodes reached at ``depth``, by feature value; of
    nodes that need no split (pure ones, and all at the last depth) in one row
    a class, without a feature.  ``rows`` has the keys, ``x``, ``y`` (class texts
    by label), ``w`` and, from depth 1, ``splits`` (a map from node to split by
    label)."""

    def reached(y: Column, i: Column) -> Column:
        node = _path(F.get("splits", i), F.col("x"), depth) if depth else F.lit(1).cast("long")
        return F.struct(i.alias("label"), y.alias("value"), node.alias("node"))

    def ends(a: Column) -> Column:
        above = F.try_element_at(F.get("splits", a["label"]), F.shiftright(a["node"], 1))
        return F.when(a["node"] % 2 == 0, above["l_pure"]).otherwise(above["r_pure"])

    open_ = F.filter(F.transform("y", reached), lambda a: a["value"].isNotNull() & (a["node"] >= 2**depth))
    pure = F.lit(last) if last or not depth else F.lit(False)
    marked = F.transform(open_, lambda a: a.withField("ends", ends(a) if depth and not last else pure))
    each = rows.select(*keys, "x", "w", F.inline(marked))
    values = F.when(F.col("ends"), F.array().cast("array<double>")).otherwise(F.col("x"))
    long = each.select(*keys, "label", "node", "value", "w", F.posexplode_outer(values).alias("f", "v"))
    return long.groupBy(*keys, "label", "node", "f", "v", "value").agg(F.sum("w").alias("w"))


def _classes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per node its weight, the sum of squared class weights, and the class of
    most weight (of equal ones the first by text)."""
    first = F.min(F.struct((-F.col("w")).alias("w"), F.col("value").alias("v")))
    return counts.groupBy(*keys, "label", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("squares"), first["v"].alias("value"))


def _best_splits(hist: DataFrame, keys: list[str], min_gain: float) -> DataFrame:
    """Per (group, label, node) the split of highest gini gain: feature ``f``,
    threshold ``t``, and whether each side is pure.  Of equal gains the first feature, then the lowest
    threshold.  A node whose best gain is not above ``min_gain`` has none.

    With L_c and T_c the weights of class c up to a value and in all, the
    impurity left behind is minimal where sum(L_c^2) / L + sum((T_c - L_c)^2) /
    (T - L) is maximal.  All four sums are running sums over the values of a
    feature."""
    node = [*keys, "label", "node"]
    feature = [*node, "f"]
    by_class = Window.partitionBy(*feature, "value").orderBy("v")
    before = F.coalesce(F.sum("w").over(by_class.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("w").over(Window.partitionBy(*feature, "value"))
    one = hist.repartition(*[F.col(c) for c in node]).select("*", before.alias("b"), total.alias("t_c"))
    upto = Window.partitionBy(*feature).orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(*feature)
    sums = one.select(
        *feature, "v",
        F.sum("w").over(upto).alias("l"), F.sum("w").over(everything).alias("n"),
        F.sum(2 * F.col("b") * F.col("w") + F.col("w") * F.col("w")).over(upto).alias("ll"),
        F.sum(F.col("t_c") * F.col("w")).over(upto).alias("tl"),
        F.sum(F.col("t_c") * F.col("w")).over(everything).alias("tt"),
        F.lead("v").over(Window.partitionBy(*feature).orderBy("v")).alias("next"),
    )
    rest, right = F.col("n") - F.col("l"), F.col("tt") - 2 * F.col("tl") + F.col("ll")
    gain = ((F.col("ll") / F.col("l") + right / rest) - F.col("tt") / F.col("n")) / F.col("n")
    whole = 1 - 1e-12
    pure = [(F.col("ll") >= F.col("l") * F.col("l") * whole).alias("l_pure"), (right >= rest * rest * whole).alias("r_pure")]
    # the last row of a value knows the next value; the feature's last value splits nothing
    cuts = sums.where("next > v").select(*node, gain.alias("gain"), "f", ((F.col("v") + F.col("next")) / 2).alias("t"), *pure)
    best = F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("t")).alias("t"), "l_pure", "r_pure")).alias("best")
    chosen = cuts.where(F.col("gain") > min_gain).groupBy(*node).agg(best)
    return chosen.select(*node, (-F.col("best.f")).alias("f"), (-F.col("best.t")).alias("t"), "best.l_pure", "best.r_pure")


def fit_groups(
    df: DataFrame,
    group: Sequence[str] = GROUP,
    categorical: Sequence[str] = S.CATEGORICAL_LABELS,
    boolean: Sequence[str] = S.BOOLEAN_LABELS,
    features: Sequence[str] = S.FEATURES,
    max_depth: int = 4,
    max_bins: int = 256,
    min_gain: float = 1e-9,
    weight_col: str | None = None,
) -> DataFrame:
    """One gini tree per label for every group: the group's columns and the
    node columns, one row per node.

    Thresholds lie halfway between neighbouring values of a node; a feature
    with more than ``max_bins`` values in all is cut into bins first, at
    thresholds common to all groups.  Rows with a NULL feature take no part;
    a NULL label leaves the row out of that label's tree only.  A NULL group
    key is a group of its own.  A label that a group never has gets no tree."""
    keys, labels = [f"g{i}" for i in range(len(group))], [*categorical, *boolean]
    cuts = feature_cuts(df, features, max_bins, weight_col)
    named = [F.col(g).alias(k) for g, k in zip(group, keys)]
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    texts = None if weight_col or not _plain(df, group) else _class_texts(df.where(known), labels)
    if texts is None:
        values = _binned(df, features, cuts)
        w = F.sum(F.col(weight_col).cast("double")) if weight_col else F.count(F.lit(1)).cast("double")
        wide = df.where(known).select(
            *named, *([weight_col] if weight_col else []),
            F.array(*values.values()).alias("x"), F.array(*[F.col(c).cast("string") for c in labels]).alias("y"))
        # rows of a group side by side (a large one over several files): a task then sums up most of a histogram itself
        base = _stored(wide.groupBy(*keys, "x", "y").agg(w.alias("w")).hint("rebalance", *keys), "rows", release=True)
        every = _grow_levels(base, keys, len(labels), max_depth, min_gain)
    else:
        coded, places = _coded(df, labels, texts)
        rows = df.where(known).select(*named, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], *coded)
        every = _grow_in_tasks(rows, keys, [cuts.get(f) for f in features], places, texts, max_depth, min_gain)
    return _named(every, keys, group, labels, categorical, features, cuts)


def _plain(df: DataFrame, group: Sequence[str]) -> bool:
    """Whether keys that are equal to Spark are equal to a task's Python."""
    kinds = (T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.StringType(), T.DateType(), T.TimestampType(), T.TimestampNTZType())
    return len(group) > 0 and all(df.schema[g].dataType in kinds for g in group)


def _class_texts(rows: DataFrame, labels: Sequence[str]) -> list[list[str]] | None:
    """The classes of each label in order; None when one has more than
    ``MOST_CLASSES``."""
    texts = {c: ["false", "true"] if rows.schema[c].dataType == T.BooleanType() else [] for c in labels}
    rest = [c for c in texts if not texts[c]]
    if rest:
        held = rows.groupBy(*[F.col(c).cast("string").alias(f"y{i}") for i, c in enumerate(rest)]).count()
        pairs = held.select(F.posexplode(F.array(*[f"y{i}" for i in range(len(rest))])).alias("i", "v")).where("v IS NOT NULL").distinct()
        found = pairs.limit(MOST_CLASSES * len(rest) + 1).collect()  # classes, at most so many a label
        for r in found:
            texts[rest[r["i"]]].append(r["v"])
        if max(map(len, texts.values())) > MOST_CLASSES:
            return None
    return [sorted(texts[c], key=str.encode) for c in labels]


def _coded(df: DataFrame, labels: Sequence[str], texts: Sequence[Sequence[str]]) -> tuple[list[Column], list[tuple[int, int]]]:
    """A row's classes as few whole numbers, digits of which are the classes'
    numbers from 1 (0: no class); and the column and the factor of each
    label's digit."""
    columns, places, size = [F.lit(0).cast("long")], [], 1
    for label, classes in zip(labels, texts):
        if size * (len(classes) + 1) >= 2**62:
            columns, size = [*columns, F.lit(0).cast("long")], 1
        if df.schema[label].dataType == T.BooleanType():
            number = F.when(F.col(label), 2).when(~F.col(label), 1)
        else:
            number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) if classes else F.lit(None)
        columns[-1] = columns[-1] + F.coalesce(number.cast("long"), F.lit(0).cast("long")) * F.lit(size).cast("long")
        places.append((len(columns) - 1, size))
        size *= len(classes) + 1
    return [c.alias(f"c{i}") for i, c in enumerate(columns)], places


def _grow_in_tasks(rows: DataFrame, keys: list[str], cuts: list[list[float] | None], places: list[tuple[int, int]], texts: list[list[str]], max_depth: int, min_gain: float) -> DataFrame:
    """All trees of a group in one task; groups of more than ``MOST_ROWS`` rows,
    or with values that are not finite, level by level."""
    values, codes = [f"x{i}" for i in range(len(cuts))], [c for c in rows.columns if c not in keys and c.startswith("c")]
    of_keys = [rows.schema[k] for k in keys]
    numbers = [T.StructField(c, T.BinaryType()) for c in (*values, *codes)]
    packed_as = T.StructType([*of_keys, T.StructField("n", T.LongType()), T.StructField("odd", T.BooleanType()), *numbers])
    # rows of a group side by side (a large one over several files)
    packed = _stored(rows.hint("rebalance", *keys).mapInArrow(packer(keys, values, cuts, codes), packed_as), "rows", release=True, compression="zstd")
    apart = packed.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("odd").alias("odd")).where(F.col("odd") | (F.col("n") > MOST_ROWS))
    apart = _stored(apart.select(*[F.col(k).alias(f"{k}_") for k in keys]), "apart")
    mine = _same([F.col(k) for k in keys], [F.col(f"{k}_") for k in keys])
    some = not apart.isEmpty()
    whole = packed.join(apart, mine, "left_anti") if some else packed
    made = (("label", T.IntegerType()), ("node", T.LongType()), ("value", T.StringType()), ("f", T.IntegerType()), ("t", T.DoubleType()))
    grown_as = T.StructType([*of_keys, *[T.StructField(*m) for m in made]])
    dealt = whole.repartition(*keys).sortWithinPartitions(*keys)
    every = _stored(dealt.mapInArrow(grower(keys, values, codes, places, texts, max_depth, min_gain), grown_as), "nodes", release=True)
    if some:
        flat_as = T.StructType([*of_keys, *[T.StructField(v, T.DoubleType()) for v in values], *[T.StructField(c, T.LongType()) for c in codes]])
        flat = packed.join(apart, mine, "left_semi").mapInArrow(unpacker(keys, values, codes), flat_as)
        digits = [F.expr(f"CAST({codes[column]} div {factor}L % {len(classes) + 1} AS INT)") for (column, factor), classes in zip(places, texts)]
        y = [F.get(F.array(F.lit(None).cast("string"), *[F.lit(c) for c in classes]), digit) for digit, classes in zip(digits, texts)]
        wide = flat.select(*keys, F.array(*values).alias("x"), F.array(*y).alias("y"))
        base = _stored(wide.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")).hint("rebalance", *keys), "large", release=True)
        every = every.unionByName(_grow_levels(base, keys, len(texts), max_depth, min_gain))
    return every


def _grow_levels(base: DataFrame, keys: list[str], n_labels: int, max_depth: int, min_gain: float) -> DataFrame:
    """All trees of all groups, a histogram a level.  ``base`` has the keys,
    ``x`` (values by feature), ``y`` (class texts by label) and the weight ``w``."""
    splits: DataFrame | None = None
    nodes: list[DataFrame] = []
    for depth in range(max_depth + 1):
        rows = base
        if splits is not None:
            by_group = _split_arrays(splits, keys, n_labels)
            rows = base.join(by_group.withColumnsRenamed({k: f"{k}_" for k in keys}), _same([F.col(k) for k in keys], [F.col(f"{k}_") for k in keys]))
        last = depth == max_depth
        hist = _histogram(rows, keys, depth, last).persist(StorageLevel.MEMORY_AND_DISK)
        counts = hist.where("f = 0 OR f IS NULL").groupBy(*keys, "label", "node", "value").agg(F.sum("w").alias("w"))
        classes = _classes(counts, keys)
        if last:
            found = classes.selectExpr("*", "CAST(NULL AS INT) AS f", "CAST(NULL AS DOUBLE) AS t", "CAST(NULL AS BOOLEAN) AS l_pure", "CAST(NULL AS BOOLEAN) AS r_pure")
        else:
            impure = classes.where(F.col("squares") < F.col("n") * F.col("n"))
            at = [*keys, "label", "node"]
            kept = hist.where("f IS NOT NULL").join(impure.select(*[F.col(c).alias(f"{c}_") for c in at]), _same([hist[c] for c in at], [F.col(f"{c}_") for c in at]), "left_semi")
            best = _best_splits(kept, keys, min_gain).withColumnsRenamed({c: f"{c}_" for c in at})
            found = classes.join(best, _same([classes[c] for c in at], [F.col(f"{c}_") for c in at]), "left").drop(*[f"{c}_" for c in at])
        found = _stored(found.select(*keys, "label", "node", "value", "f", "t", "l_pure", "r_pure"), f"nodes{depth}")
        hist.unpersist()
        gc.collect()  # the level's shuffle files go with it
        base.sparkSession.sparkContext._jvm.System.gc()
        nodes.append(found)
        here = found.where("f IS NOT NULL")
        splits = here if splits is None else splits.unionByName(here)
    return reduce(lambda a, b: a.unionByName(b), nodes).drop("l_pure", "r_pure")


def _split_arrays(splits: DataFrame, keys: list[str], n_labels: int) -> DataFrame:
    """One row a group: by label, a map from node to its split (bounded by the
    nodes of the group's trees)."""
    entries = F.collect_list(F.struct("label", "node", F.struct("f", "t", "l_pure", "r_pure").alias("s")))
    held = splits.groupBy(*keys).agg(entries.alias("e"))
    maps = F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: F.map_from_entries(
        F.transform(F.filter("e", lambda x: x["label"] == i), lambda x: F.struct(x["node"], x["s"]))))
    return held.select(*keys, maps.alias("splits"))


def _named(every: DataFrame, keys: list[str], group: Sequence[str], labels: list[str], categorical: Sequence[str], features: Sequence[str], cuts: dict[str, list[float]]) -> DataFrame:
    """Node rows in the stored form."""
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("label") + 1)
    kind = F.when(F.col("label") < len(categorical), "string").otherwise("boolean")
    feature = F.when(F.col("f").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in features]), F.coalesce("f", F.lit(0)) + 1))
    threshold, strict = F.col("t"), F.lit(False)
    for i, f in enumerate(features):
        if f in cuts:  # between bins a and b, the cut that opens bin floor(t) + 1
            bound = F.element_at(F.array(*[F.lit(c) for c in cuts[f]]), F.floor("t").cast("int") + 1)
            threshold, strict = F.when(F.col("f") == i, bound).otherwise(threshold), F.when(F.col("f") == i, True).otherwise(strict)
    child = F.when(F.col("f").isNotNull(), 2 * F.col("node"))
    return every.select(
        *[F.col(k).alias(g) for k, g in zip(keys, group)], label.alias("label"), kind.alias("kind"), "node", feature.alias("feature"),
        threshold.alias("threshold"), strict.alias("strict"), child.alias("left"), (child + 1).alias("right"), "value")


# -- L2 -----------------------------------------------------------------------
def predict_groups(
    nodes: DataFrame,
    df: DataFrame,
    group: Sequence[str] = GROUP,
    categorical: Sequence[str] = S.CATEGORICAL_LABELS,
    boolean: Sequence[str] = S.BOOLEAN_LABELS,
    features: Sequence[str] = S.FEATURES,
    normalize_humidity: bool = True,
) -> DataFrame:
    """``df`` plus ``pred_<label>`` by its own group's trees: one join with one
    row per group, then native expressions.  Rows with a NULL feature, or of a
    group without a model or without a tree for the label, have NULL
    predictions.  Columns called ``pred_<label>`` are replaced."""
    labels = [*categorical, *boolean]
    taken = [(humidity_fraction("pct_humidity") if normalize_humidity and f == "pct_humidity" else F.col(f)).cast("double") for f in features]
    rows = df.drop(*[f"pred_{lab}" for lab in labels])
    if _plain(rows, group) and all(rows.schema[g].dataType == nodes.schema[g].dataType for g in group) and _to_python(rows):
        return _predict_in_tasks(nodes, rows, group, categorical, boolean, features, taken)
    return _predict_natively(nodes, rows, group, categorical, labels, features, taken)


def _to_python(df: DataFrame) -> bool:
    """Whether every column can go through Python."""
    try:
        to_arrow_schema(df.schema)
    except PySparkException:
        return False
    return True


def _predict_in_tasks(nodes: DataFrame, rows: DataFrame, group: Sequence[str], categorical: Sequence[str], boolean: Sequence[str], features: Sequence[str], taken: Sequence[Column]) -> DataFrame:
    """Rows meet their group's model in a task, groups of more than
    ``MOST_ROWS`` rows in several."""
    labels, keys = [*categorical, *boolean], [f"_k{i}" for i in range(len(group))]
    texts = lambda values: F.array(*[F.lit(x) for x in values])
    text = F.col("value").cast("string")
    number = lambda names, c: (F.array_position(texts(names), F.col(c)) - 1).cast("int")
    nodes_ = nodes.select(
        *[F.col(g).alias(k) for g, k in zip(group, keys)], number(labels, "label").alias("label"), "node", number(features, "feature").alias("f"), F.col("threshold").alias("t"), "strict", "left", "right",
        F.when(F.col("label").isin(*categorical), text).alias("value"), F.when(F.col("label").isin(*boolean), text.cast("boolean")).alias("flag"))
    bundle = T.StructType([nodes_.schema[k] for k in keys] + [T.StructField(c, T.BinaryType()) for c in ("_tree", "_texts")])
    models = nodes_.where("label >= 0").mapInArrow(bundler(keys), bundle)
    rest = [c for c in rows.columns if c not in group]
    # a feature that is read as it stands goes once
    as_is = (T.DoubleType(), T.BooleanType())
    inputs = {f"_x{i}": x for i, (f, x) in enumerate(zip(features, taken)) if f in group or f == "pct_humidity" or rows.schema[f].dataType not in as_is}
    names = [f"_x{i}" if f"_x{i}" in inputs else f for i, f in enumerate(features)]
    slim = rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], *rest, *[x.alias(name) for name, x in inputs.items()])
    mine = _same([F.col(k) for k in keys], [F.col(f"{k}_") for k in keys])
    large = slim.groupBy(*keys).count().where(F.col("count") > MOST_ROWS)
    parts = F.ceil(F.col("count") / MOST_ROWS).cast("int").alias("_parts")
    large = _stored(large.select(*[F.col(k).alias(f"{k}_") for k in keys], parts), "large_groups")
    part = F.lit(0)
    if not large.isEmpty():
        of_part = F.pmod(F.xxhash64(*[c for c in slim.columns if isinstance(slim.schema[c].dataType, T.AtomicType) and slim.schema[c].dataType != T.VariantType()]), F.col("_parts")).cast("int")
        slim = slim.join(F.broadcast(large), mine, "left").withColumn("_part", F.coalesce(of_part, F.lit(0)))
        models = models.join(F.broadcast(large), mine, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        part = F.col("_part")
    both = slim.select(*keys, F.lit(1).alias("_kind"), *rest, *inputs, *[F.lit(None).cast("binary").alias(c) for c in ("_tree", "_texts")], part.alias("_part")).unionByName(
        models.select(*keys, F.lit(0).alias("_kind"), *[F.lit(None).cast(slim.schema[c].dataType).alias(c) for c in (*rest, *inputs)], "_tree", "_texts", part.alias("_part")))
    dealt = both.repartition(*keys, "_part").sortWithinPartitions("_kind").drop("_part")
    preds = [f"pred_{lab}" for lab in labels]
    kinds = [T.StringType() if lab in categorical else T.BooleanType() for lab in labels]
    kept = [T.StructField(k, rows.schema[g].dataType) for g, k in zip(group, keys)] + [rows.schema[c] for c in rest]
    out = dealt.mapInArrow(
        applier(keys, names, [*keys, *rest], preds, [lab in categorical for lab in labels]), T.StructType([*kept, *[T.StructField(p, kind) for p, kind in zip(preds, kinds)]]))
    place = dict(zip(group, keys))
    return out.select(*[F.col(place[c]).alias(c) if c in place else F.col(c) for c in rows.columns], *preds)


def _predict_natively(nodes: DataFrame, df: DataFrame, group: Sequence[str], categorical: Sequence[str], labels: Sequence[str], features: Sequence[str], taken: Sequence[Column]) -> DataFrame:
    """The same for keys of any kind, each row with its group's model."""
    # a tree as an array by node number, its children as places in that array
    entry = F.struct("node", "feature", "threshold", "strict", "left", "right", "value")
    held = nodes.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("label", entry.alias("e")))).alias("all"))

    def tree_of(label: str) -> Column:
        return F.transform(F.filter("all", lambda x: x["label"] == label), lambda x: x["e"])

    def placed(tree: Column) -> Column:
        numbers = F.transform(tree, lambda e: e["node"])
        place = lambda n: (F.array_position(numbers, n) - 1).cast("int")
        named = F.array(*[F.lit(f) for f in features])
        return F.transform(tree, lambda e: F.struct(
            (F.array_position(named, e["feature"]) - 1).cast("int").alias("f"), e["threshold"].alias("t"), e["strict"].alias("strict"),
            place(e["left"]).alias("left"), place(e["right"]).alias("right"), e["value"].alias("value")))

    raw = held.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], *[tree_of(lab).alias(f"_e{i}") for i, lab in enumerate(labels)])
    deepest = [(F.length(F.bin(F.coalesce(F.array_max(F.transform(f"_e{i}", lambda e: e["node"])), F.lit(1).cast("long")))) - 1).alias(f"_d{i}") for i in range(len(labels))]
    models = raw.select(*[f"_k{i}" for i in range(len(group))], *[placed(F.col(f"_e{i}")).alias(f"_t{i}") for i in range(len(labels))], *deepest)
    complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in taken])
    rows = df.withColumn("_x", F.when(complete, F.array(*taken)))
    joined = rows.join(models, _same([F.col(g) for g in group], [F.col(f"_k{i}") for i in range(len(group))]), "left")

    def leaf(tree: Column, depth: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            s = F.get(tree, at)
            v = F.get("_x", s["f"])
            goes_left = F.when(s["strict"], v < s["t"]).otherwise(v <= s["t"])
            return F.when(s["f"].isNull(), at).when(goes_left, s["left"]).otherwise(s["right"])

        end = F.aggregate(F.array_repeat(F.lit(0), depth), F.lit(0), step)
        return F.when(F.col("_x").isNotNull(), F.get(tree, end)["value"])

    preds = [leaf(F.col(f"_t{i}"), F.col(f"_d{i}")).cast("string" if lab in categorical else "boolean").alias(f"pred_{lab}") for i, lab in enumerate(labels)]
    return joined.select(*[F.col(c) for c in rows.columns if c != "_x"], *preds)


def model_for(nodes: DataFrame, features: Sequence[str] = S.FEATURES, **key) -> TreeModel:
    """One group's model (its node rows only are read)."""
    chosen = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()])
    rows = nodes.where(chosen).collect()
    if not rows:
        raise ValueError(f"no model for {key}")
    return model_of_rows(rows, features)


# -- L7 / F7 ------------------------------------------------------------------
def load_groups(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest node table under ``path`` (None if there is none)."""
    try:
        pointer = spark.read.schema("version string, path string").json(f"{path}/_latest").orderBy(F.desc("version")).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return spark.read.parquet(pointer[0]["path"]) if pointer else None


def refresh_groups(df: DataFrame, path: str, group: Sequence[str] = GROUP, modified: str = "modified", **fit_kw) -> tuple[DataFrame, DataFrame]:
    """Train or load for every group: groups without a model, or whose rows are
    newer (``modified``, microseconds since the epoch) than the rows their
    model was fitted on, are fitted anew, all together; the others' nodes are
    kept as stored.  Groups of which no rows are left keep their model.

    Writes a new version of the node table and then a pointer to it.  Returns
    it, and one row per group of ``df`` with ``fitted``."""
    spark = df.sparkSession
    old = load_groups(spark, path)
    newest = df.groupBy(*group).agg(F.max(modified).cast("long").alias("data_micros"))
    names = [f"_o{i}" for i in range(len(group))]
    if old is None:
        state = newest.withColumn("fitted", F.lit(True))
    else:
        known = old.groupBy(*group).agg(F.max("data_micros").alias("_seen")).withColumnsRenamed(dict(zip(group, names)))
        state = newest.join(known, _same([F.col(g) for g in group], [F.col(n) for n in names]), "left")
        state = state.select(*group, "data_micros", (F.col("_seen").isNull() | (F.col("_seen") < F.col("data_micros"))).alias("fitted"))
    state = _stored(state, "state")
    some_fresh = not state.where("NOT fitted").isEmpty()
    stale = state.where("fitted").select(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col("data_micros").alias("_micros"))
    mine = _same([F.col(g) for g in group], [F.col(n) for n in names])
    made = fit_groups(df.join(stale, mine, "left_semi") if some_fresh else df, group, **fit_kw).join(stale, mine).withColumn("data_micros", F.col("_micros")).drop(*names, "_micros")
    version = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
    target = f"{path}/v={version}"
    (made if old is None else old.join(stale, mine, "left_anti").unionByName(made)).write.parquet(target)
    spark.createDataFrame([(version, target)], "version string, path string").coalesce(1).write.mode("append").json(f"{path}/_latest")
    return spark.read.parquet(target), state.select(*group, "fitted")
