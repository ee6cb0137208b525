"""One depth-4 decision tree per outfit label on pyspark.ml.

* ``fit_dual`` (ddt): categorical labels through a string index, boolean
  labels as 0/1 classes; ``fit_single`` (sdt): booleans first become Yes/No
  categories, then every label is categorical.
* Training rows are grouped to weighted distinct combinations and cached
  once, then, for each tree, to the combinations with its own label; the trees are
  fitted from a thread pool so their per-level jobs overlap (each fit is
  itself data-parallel: one aggregation of split statistics per tree level).
* The fitted model is one ``PipelineModel`` (assembler, trees, label
  converters).  It is stored as one table of tree nodes (``trees``), and
  prediction compiles each tree into a nested CASE over the feature
  columns (``native_predictions``), so scoring a row is a few native
  comparisons inside whole-stage codegen instead of ten UDF calls on a
  feature vector; models with other stages are stored by the standard ML
  writer and fall back to ``transform``.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import Bucketizer, IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions.weather import humidity_fraction
from wearcast.operators.cleaning import booleans_to_yes_no
from wearcast.operators.scoring import score_table
from wearcast.operators.trees import TreeModel, _bins, model_of_pipeline, predictions, read_model, write_nodes

FEATURES_COL = "_features"


WEIGHT_COL = "_weight"


def _tree(label_col: str, prefix: str, max_depth: int, max_bins: int, seed: int) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(
        featuresCol=FEATURES_COL,
        labelCol=label_col,
        weightCol=WEIGHT_COL,
        predictionCol=f"{prefix}_pred",
        # Only the predicted class is used: no raw or probability vectors.
        rawPredictionCol="",
        probabilityCol="",
        maxDepth=max_depth,
        maxBins=max_bins,
        impurity="gini",
        seed=seed,
    )


def _cell(v: Column, low: float, high: float, parts: int, equal: bool) -> Column:
    """The cell of ``v``, in ascending order, when ``low`` to ``high`` is split."""
    if low == high:
        return F.lit(0)
    if not equal and (math.isinf(low) or math.isinf(high)):
        return F.when(v == -math.inf, -1).when(v == math.inf, 1).otherwise(0)
    if not equal and low <= 0 <= high:
        return F.signum(v).cast("int")
    size = F.abs(v)
    near, far = sorted((abs(low), abs(high)))
    if not equal and far > 2 * near:
        place = (F.log(size) - F.log(F.lit(near))) / ((math.log(far) - math.log(near)) / parts)
        return F.least(F.floor(place), F.lit(parts - 1)).cast("int") * (1 if low > 0 else -1)
    width = (high - low) / parts
    if not width:
        return F.when(v == low, 0).otherwise(1)
    return F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(parts - 1)).cast("int")


def feature_cuts(df: DataFrame, features: Sequence[str], max_bins: int, weight_col: str | None = None, cells: int = 8192) -> dict[str, list[float]]:
    """Thresholds for the features with more than ``max_bins`` values: about
    equal weight between them, at most ``max_bins - 1``.

    One pass finds each feature's range and about how many values it has; only
    for features near or beyond ``max_bins`` follows a weighted histogram of
    ``cells`` equal cells (with the least and largest value in each, so few
    values are told apart exactly); thresholds lie between values of
    neighbouring cells.  A cell that holds several values and more than a
    bin's weight is split again, in a pass for all such cells, until none is
    left: by sign, then by magnitude where its values differ by more than a
    factor of two, else into equal cells.  All sums are of whole weights, so
    the result depends on the values alone, not on the layout or grouping of
    the rows."""
    number = {f: F.col(f).cast("double") for f in features}
    looks = (("a", F.min), ("b", F.max), ("d", lambda c: F.approx_count_distinct(c, 0.02)))
    spans = df.agg(*[g(number[f]).alias(f"{n}_{f}") for f in features for n, g in looks]).first()
    # an estimate this far below the bound (five standard errors) needs no exact count
    features = [f for f in features if spans[f"d_{f}"] > 0.9 * max_bins]
    if not features:
        return {}
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("f"), number[f].alias("v"), weight.alias("w")) for f in features]))).where("v IS NOT NULL")
    open_ = {f: [(spans[f"a_{f}"], spans[f"b_{f}"])] for f in features if spans[f"a_{f}"] is not None}
    done: dict[str, list[tuple]] = {f: [] for f in features}
    limit: dict[str, float] = {}
    while open_:
        first = not limit
        parts = {f: max(32, cells // len(x)) for f, x in open_.items()}
        ranges = F
        for f, spread in open_.items():
            inside = F
            for k, (low, high) in enumerate(spread):
                cell = _cell(F.col("v"), low, high, parts[f], equal=first)
                inside = inside.when(F.col("v").between(low, high), F.struct(F.lit(k).alias("k"), cell.alias("c")))
            ranges = ranges.when(F.col("f") == f, inside)
        held = long.withColumn("at", ranges).where("at IS NOT NULL").groupBy("f", "at").agg(F.sum("w").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"))
        rows = held.select("f", "w", "a", "b").collect()  # cells x features at most, or 32 a bin
        if first:
            limit = {f: sum(r["w"] for r in rows if r["f"] == f) / max_bins for f in features}
        before, open_ = open_, {}
        for r in rows:
            if r["a"] < r["b"] and r["w"] > limit[r["f"]] and (first or (r["a"], r["b"]) not in before[r["f"]]):
                open_.setdefault(r["f"], []).append((r["a"], r["b"]))
            else:
                done[r["f"]].append((r["a"], r["b"], r["w"]))
    cuts: dict[str, list[float]] = {}
    for f in features:
        held = sorted(done[f])
        if len(held) <= max_bins and all(a == b for a, b, _ in held):
            continue
        total, seen, out = sum(w for _, _, w in held), 0.0, []
        for (_, high, w), (low, _, _) in zip(held, held[1:]):
            seen += w
            if seen >= total * (len(out) + 1) / max_bins and len(out) < max_bins - 1:
                out.append((high + low) / 2)
        if out:
            cuts[f] = out
    return cuts


def fit_trees(
    df: DataFrame,
    categorical: Sequence[str],
    boolean: Sequence[str],
    features: Sequence[str] = S.FEATURES,
    max_depth: int = 4,
    max_bins: int = 256,
    seed: int = 42,
    parallelism: int = 10,
    compress: bool = True,
    rows_per_partition: int = 1_000_000,
    weight_col: str | None = None,
) -> PipelineModel:
    """One tree per label: categorical labels are string-indexed (alphabetical,
    so indices do not depend on frequencies), boolean labels are 0/1.

    A feature with more than ``max_bins`` values is first cut into bins at
    exact thresholds (``feature_cuts``; a ``Bucketizer`` in the model), and the
    trees then consider every threshold there is, with no sampling: the same
    rows give the same trees whatever their layout, with or without
    ``compress``.
    With ``compress`` the binned training rows are grouped to distinct
    (features, labels) combinations weighted by their count: every split
    statistic is a weighted class count.  Each label's tree then reads the
    combinations of the features with that label alone, grouped once more:
    their number is bounded by the bins and the label's classes, whatever the
    other labels are.  Both groupings are partially aggregated shuffles.
    The training rows of a label are held in about one partition per
    ``rows_per_partition`` rows, so small inputs do not pay per-task overhead
    at every tree level and large ones keep full parallelism.

    ``weight_col`` marks input that is already weighted (each row counting
    as its weight).  It is read once a label: cache it if it is costly.

    The returned model needs only the feature columns: assembler, the trees,
    then converters back to label values (``pred_<label>``)."""
    categorical, boolean, features = list(categorical), list(boolean), list(features)
    cuts = feature_cuts(df, features, max_bins, weight_col)
    binned = {f: f"_{f}_bin" for f in cuts}
    front: list = []
    if cuts:
        splits = [[-math.inf, *c, math.inf] for c in cuts.values()]
        front = [Bucketizer(splitsArray=splits, inputCols=list(cuts), outputCols=list(binned.values()), handleInvalid="keep")]
        df = front[0].transform(df.withColumns({f: F.col(f).cast("double") for f in cuts}))
        for name in binned.values():  # a bin's number is a place on a scale, not a category
            df = df.withMetadata(name, {})
    inputs = [binned.get(f, f) for f in features]
    cols = [*inputs, *categorical, *boolean]
    if weight_col is not None:
        base = df.select(*cols, F.col(weight_col).cast("double").alias(WEIGHT_COL))
    elif compress:
        base = df.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT_COL))
    else:
        base = df.select(*cols, F.lit(1.0).alias(WEIGHT_COL))
    assembler = VectorAssembler(inputCols=inputs, outputCol=FEATURES_COL)

    def one(label: str):
        """The tree of a label, on the rows that have it, and its classes."""
        rows = base.where(F.col(label).isNotNull()).select(*inputs, label, WEIGHT_COL)
        if compress:
            rows = rows.groupBy(*inputs, label).agg(F.sum(WEIGHT_COL).alias(WEIGHT_COL))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n_rows = rows.count()
            parts = max(1, min(rows.rdd.getNumPartitions(), -(-n_rows // rows_per_partition)))
            train, classes = assembler.transform(rows.coalesce(parts)), None
            if label in categorical:
                code = f"_{label}_idx"
                indexer = StringIndexer(inputCols=[label], outputCols=[code], stringOrderType="alphabetAsc").fit(rows.select(label))
                train, classes = indexer.transform(train), list(indexer.labelsArray[0])
            else:
                code = f"_{label}_lbl"
                train = train.withColumn(code, F.col(label).cast("double"))
            # thresholds are sampled from a table of more than maxBins ** 2 rows
            tree_bins = min(46_000, max(max_bins, math.isqrt(n_rows) + 2))
            tree = _tree(code, f"_{label}", max_depth, tree_bins, seed)
            return tree.fit(train.select(FEATURES_COL, WEIGHT_COL, code)), classes
        finally:
            rows.unpersist()

    # Materialise grouped training rows once, before the concurrent fits read
    # them; weighted input is the caller's to hold.
    if weight_col is None:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if weight_col is None:
            base.count()
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            fitted = list(pool.map(one, [*categorical, *boolean]))
    finally:
        if weight_col is None:
            base.unpersist()
    trees = [tree for tree, _ in fitted]
    labels_of = {c: classes for c, (_, classes) in zip(categorical, fitted)}
    post = [IndexToString(inputCol=f"_{c}_pred", outputCol=f"pred_{c}", labels=labels_of[c]) for c in categorical]
    if boolean:
        casts = ", ".join(f"CAST(_{b}_pred = 1.0 AS BOOLEAN) AS pred_{b}" for b in boolean)
        post.append(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"))
    return PipelineModel(stages=[*front, assembler, *trees, *post])


# -- L1 / L5 ----------------------------------------------------------------
def fit_dual(df: DataFrame, **kw) -> PipelineModel:
    """ddt: categorical labels as classes, boolean labels as 0/1 classes."""
    return fit_trees(df, S.CATEGORICAL_LABELS, S.BOOLEAN_LABELS, **kw)


def fit_single(df: DataFrame, **kw) -> PipelineModel:
    """sdt: booleans become Yes/No categories, then all ten labels are
    categorical (the original's single-strategy fit, completed)."""
    return fit_trees(_single_labels(df), S.LABELS, [], **kw)


def _single_labels(df: DataFrame) -> DataFrame:
    """The single strategy's labels: Yes/No for booleans, a blank one false as
    the clean-up fills it."""
    return booleans_to_yes_no(df.fillna(False, subset=S.BOOLEAN_LABELS), S.BOOLEAN_LABELS)


STRATEGIES = {"ddt": fit_dual, "sdt": fit_single}


# -- L2 / L3 ----------------------------------------------------------------
def as_trees(model: PipelineModel | TreeModel) -> TreeModel | None:
    """The model's trees as nodes; None when it has a stage that nodes cannot
    express."""
    return model if isinstance(model, TreeModel) else model_of_pipeline(model)


def native_predictions(model: PipelineModel | TreeModel, features: dict | None = None) -> dict[str, Column] | None:
    """``pred_<label>`` columns computed as native expressions (no UDF, no
    feature vector), equal to the pipeline's own transform on complete rows and
    NULL where any feature is NULL; None when the model has a stage this
    cannot express.  ``features`` may give a Column per
    feature name (default: the columns of that name)."""
    trees = as_trees(model)
    return None if trees is None else predictions(trees, features)


def apply_model(model: PipelineModel | TreeModel, df: DataFrame, features: dict | None = None) -> DataFrame:
    """``df`` plus ``pred_<label>`` columns: native expressions when the
    model allows (one codegen'd projection), else the pipeline transform.
    A row with a NULL feature has NULL predictions either way."""
    native = native_predictions(model, features)
    if native is not None:
        return df.withColumns(native)
    # Transform with complete feature values in place of the columns of those
    # names, then put the original columns back and clear incomplete rows.
    given = {n: (features or {}).get(n, F.col(n)) for n, _ in _bins(model)}
    complete = reduce(lambda a, b: a & b, [e.isNotNull() for e in given.values()])
    saved = {n: f"__orig_{n}" for n in given if n in df.columns}
    filled = {f"__in_{n}": F.coalesce(e.cast("double"), F.lit(0.0)) for n, e in given.items()}
    staged = df.withColumns({**filled, "__complete": complete})
    swapped = staged.withColumnsRenamed(saved).withColumnsRenamed({f"__in_{n}": n for n in given})
    out = model.transform(swapped)
    preds = [F.when(F.col("__complete"), F.col(c)).alias(c) for c in out.columns if c.startswith("pred_")]
    return out.select(*[F.col(saved.get(c, c)).alias(c) for c in df.columns], *preds)


def predict_outfits(model: PipelineModel | TreeModel, df: DataFrame, keep: Sequence[str] = ("row_id",), normalize_humidity: bool = True) -> DataFrame:
    """Batch predict: the kept columns plus ``pred_<label>`` per label.
    Humidity is read as the clean-up reads it (M1: percent or fraction) unless
    ``normalize_humidity`` is off.  A row with a NULL feature has NULL
    predictions."""
    out = apply_model(model, df, {"pct_humidity": humidity_fraction("pct_humidity")} if normalize_humidity else None)
    preds = [c for c in out.columns if c.startswith("pred_")]
    return out.select(*[c for c in keep if c in out.columns], *preds)


def predict_outfit(spark: SparkSession, model: PipelineModel | TreeModel, **features) -> dict:
    """L3: one scenario given as keyword features -> ``{label: value}``.
    The same batch predict on a one-row frame (humidity in percent or as a
    fraction); a missing feature fails."""
    missing = [f for f in S.FEATURES if f not in features]
    if missing:
        raise ValueError(f"missing features: {missing}")
    schema = "feels_like double, wind_speed double, pct_humidity double, duration double, is_light boolean"
    row = (*[float(features[f]) for f in S.FEATURES[:4]], bool(features["is_light"]))
    out = predict_outfits(model, spark.createDataFrame([row], schema), keep=()).collect()[0].asDict()
    return {k[len("pred_"):]: v for k, v in out.items()}


# -- L4 / L6 ----------------------------------------------------------------
def score_model(
    model: PipelineModel | TreeModel,
    df: DataFrame,
    strategy: str = "ddt",
    drop_perfect: bool = False,
    compress: bool = True,
    weight_col: str | None = None,
) -> DataFrame:
    """Predict on a labelled table and score every label (plus overall).

    With ``compress`` the table is first grouped to distinct (features,
    labels) combinations weighted by their count, and each combination is
    predicted once: the accuracies are the same weighted counts, computed
    from far fewer tree evaluations when readings repeat.  ``weight_col``
    marks input that is already weighted."""
    actual = _single_labels(df) if strategy == "sdt" else df
    if weight_col is not None:
        return score_table(apply_model(model, actual), S.LABELS, drop_perfect=drop_perfect, weight_col=weight_col)
    if not compress:
        return score_table(apply_model(model, actual), S.LABELS, drop_perfect=drop_perfect)
    grouped = actual.groupBy(*S.FEATURES, *S.LABELS).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT_COL))
    return score_table(apply_model(model, grouped), S.LABELS, drop_perfect=drop_perfect, weight_col=WEIGHT_COL)


def fit_and_score(df: DataFrame, strategies=("ddt", "sdt"), drop_perfect: bool = False, held_out: Column | None = None, **fit_kw) -> DataFrame:
    """Fit each strategy on ``df`` and score it there, the strategies running
    concurrently; ``(strategy, label, accuracy)`` rows, ``overall`` included.
    With ``held_out`` the rows it is true for are kept from the fit and are
    the ones that are scored (where it is NULL a row is not held out).
    The rows are grouped to weighted distinct (features, labels) once and
    cached, and every fit and score reads that."""
    part = F.lit(None).cast("boolean") if held_out is None else F.coalesce(held_out, F.lit(False))
    weighted = (
        df.groupBy(part.alias("_held_out"), *S.FEATURES, *S.LABELS)
        .agg(F.count(F.lit(1)).cast("double").alias(WEIGHT_COL))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    fitted, scored_on = (weighted, weighted) if held_out is None else (weighted.where("NOT _held_out"), weighted.where("_held_out"))

    def one(name: str) -> DataFrame:
        model = STRATEGIES[name](fitted, weight_col=WEIGHT_COL, **fit_kw)
        scored = score_model(model, scored_on, strategy=name, drop_perfect=drop_perfect, weight_col=WEIGHT_COL)
        rows = scored.collect()  # one row per label: bounded by the label count
        return [(name, r["label"], r["accuracy"]) for r in rows]

    try:
        weighted.count()
        with ThreadPoolExecutor(max_workers=len(strategies)) as pool:
            results = [row for rows in pool.map(one, strategies) for row in rows]
    finally:
        weighted.unpersist()
    return df.sparkSession.createDataFrame(results, "strategy string, label string, accuracy double")


# -- S8 / L7 / F7 -----------------------------------------------------------
def model_path(base: str, athlete: str = "default", activity: str = S.RUN, strategy: str = "ddt") -> str:
    return f"{base.rstrip('/')}/{athlete}_{activity}_{strategy}"


_POINTER_SCHEMA = "version string, path string, trained_at string, data_micros long, form string"


def _micros(mtime: int | dt.datetime | None) -> int | None:
    """A modification time in microseconds since the epoch (a datetime without
    a zone is UTC), so that no zone setting changes a comparison."""
    if mtime is None or isinstance(mtime, int):
        return mtime
    aware = mtime if mtime.tzinfo else mtime.replace(tzinfo=dt.timezone.utc)
    return (aware - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def _pointer(spark: SparkSession, path: str):
    """The newest pointer record of a model path (None if there is none)."""
    try:
        pointers = spark.read.schema(_POINTER_SCHEMA).json(f"{path}/_latest")
        rows = pointers.orderBy(F.desc("version")).limit(1).collect()
    except AnalysisException as e:  # no pointer yet; any other fault is raised
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[0].asDict() if rows else None


def save_model(spark: SparkSession, model: PipelineModel | TreeModel, path: str, data_mtime: int | dt.datetime | None = None) -> str:
    """Write a new version directory, then a pointer record naming it
    (readers never see a half-written model).  The version is one table of
    nodes; a pipeline with stages that nodes cannot express is written by the
    standard ML writer."""
    version = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
    target = f"{path}/v={version}"
    trees = as_trees(model)
    if trees is None:
        model.write().save(target)
    else:
        write_nodes(trees.frame(spark).coalesce(1), target)
    rec = {"version": version, "path": target, "trained_at": dt.datetime.now(dt.timezone.utc).isoformat(),
           "data_micros": _micros(data_mtime), "form": "pipeline" if trees is None else ",".join(trees.features)}
    spark.createDataFrame([(json.dumps(rec),)], "value string").coalesce(1).write.mode("append").text(
        f"{path}/_latest"
    )
    return target


def _load(spark: SparkSession, ptr: dict) -> PipelineModel | TreeModel:
    """The version a pointer names; pointers without a form name a pipeline."""
    if ptr["form"] in (None, "pipeline"):
        return PipelineModel.load(ptr["path"])
    return read_model(spark, ptr["path"], ptr["form"].split(","))


def load_model(spark: SparkSession, path: str) -> PipelineModel | TreeModel:
    ptr = _pointer(spark, path)
    if ptr is None:
        raise ValueError(f"no model at {path}")
    return _load(spark, ptr)


def data_modified(spark: SparkSession, path: str, glob: str = "*.parquet") -> int | None:
    """Newest modification time of the files under ``path``, in microseconds
    since the epoch: one row per file
    from the file listing (the binary-file source reads no content when only
    the modification time is selected), so the check costs a listing, not a
    scan of the data."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("modificationTime")
    )
    row = files.agg(F.max(F.unix_micros("modificationTime")).alias("m")).collect()[0]
    return row["m"]


def get_model(
    spark: SparkSession,
    training: DataFrame,
    base_path: str,
    strategy: str = "ddt",
    athlete: str = "default",
    activity: str = S.RUN,
    data_mtime: int | dt.datetime | None = None,
    **fit_kw,
) -> tuple[PipelineModel | TreeModel, bool]:
    """L7 + F7: load the stored model unless it is missing or older than the
    training files; otherwise fit, save a new version and return it.
    ``data_mtime`` is the newest modification time of the training files
    (see ``data_modified``).  Returns ``(model, retrained)``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {sorted(STRATEGIES)}")
    path = model_path(base_path, athlete, activity, strategy)
    ptr = _pointer(spark, path)
    mtime = _micros(data_mtime)
    if ptr is not None and ptr.get("data_micros") is not None and mtime is not None:
        if ptr["data_micros"] >= mtime:
            return _load(spark, ptr), False
    model = STRATEGIES[strategy](training, **fit_kw)
    model = as_trees(model) or model
    save_model(spark, model, path, mtime)
    return model, True


def train_from_logs(
    spark: SparkSession,
    logs: DataFrame,
    base_path: str,
    strategy: str = "ddt",
    activity: str = S.RUN,
    athlete: str = "default",
    data_mtime: int | dt.datetime | None = None,
    **fit_kw,
) -> tuple[PipelineModel | TreeModel, bool]:
    """L8 then L7: clean raw activity logs for one activity and train (or load,
    when the stored model is newer than the logs) that activity's model."""
    from wearcast.operators.cleaning import clean_activity_log

    clean = clean_activity_log(logs, activity=activity)
    return get_model(spark, clean, base_path, strategy, athlete, activity, data_mtime=data_mtime, **fit_kw)
