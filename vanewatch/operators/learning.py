"""Training sets, imputation, metrics and boosted models as Spark jobs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vanewatch.domain import MIN_QUANTILE_ROWS
from vanewatch.operators import boosting, one_task
from vanewatch.operators.ranking import first_share
from vanewatch.session import work_path

# Boosting parameters of the models; fixed values.
LEARNING_RATE = 0.05
ROUNDS = 200
PATIENCE = 20
MAX_DEPTH = 5
MIN_ROWS_PER_LEAF = 20
TEST_PERCENT = 20
SEED = 42


def split_flag(df: DataFrame, keys: list[str], stratum: str = "label") -> DataFrame:
    """Mark a repeatable test fifth of every stratum as ``is_test``."""
    return first_share(df, stratum, keys, TEST_PERCENT, str(SEED), "is_test")


def exact_medians(df: DataFrame, columns: list[str], margin: float = 2e-5) -> dict[str, float | None]:
    """Exact medians of many columns in two passes, without sorting or unpivoting any of them.

    The first pass brackets every middle by mergeable quantile sketches, all columns in one
    aggregate. The second counts, column by column inside a task, what lies below the bracket and
    each distinct value in it; running counts over the few values inside give the median. A bracket
    that missed its middle is replaced by the whole range in one more pass over that column. What
    reaches the driver is one row per column and pass.
    """
    spark = df.sparkSession
    numbers = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)])
    ends = [0.5 - margin, 0.5 + margin]
    found = numbers.agg(*[F.percentile_approx(c, ends, int(2 / margin)).alias(c) for c in numbers.columns]).first()
    bounds = {i: tuple(found[f"c{i}"]) for i in range(len(columns)) if found[f"c{i}"]}
    medians: dict[str, float | None] = dict.fromkeys(columns)
    while bounds:
        counted = (
            numbers.select(*[f"c{i}" for i in bounds])
            .mapInArrow(_bracket_counts(dict(bounds)), "name int, value double, n long, below long")
            .groupBy("name", "value").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
        )
        upto = Window.partitionBy("name").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
        through = (
            counted.withColumn("through", F.sum(F.when(F.col("value").isNull(), F.col("below")).otherwise(F.col("n"))).over(upto))
            .withColumn("all", F.first("n").over(upto))  # the row of totals comes first
            .where("value IS NOT NULL")
        )
        rank = lambda k: F.floor((F.col("all") - F.lit(k)) / 2)
        holds = lambda k: F.max(
            F.when((F.col("through") > rank(k)) & (F.col("through") - F.col("n") <= rank(k)), F.col("value"))
        )
        rows = {r["name"]: r for r in through.groupBy("name").agg(holds(1).alias("a"), holds(0).alias("b")).collect()}
        for i in list(bounds):
            r = rows.get(i)
            if r is not None and r["a"] is not None and r["b"] is not None:
                medians[columns[i]] = (r["a"] + r["b"]) / 2
                del bounds[i]
            elif bounds[i] == (float("-inf"), float("inf")):
                del bounds[i]
            else:
                bounds[i] = (float("-inf"), float("inf"))
    return medians


def _bracket_counts(bounds: dict[int, tuple[float, float]]):
    """(name, value, n, below): copies of each value inside the bracket; value null for the totals.

    The row of totals has the number of values as ``n`` and those under the bracket as ``below``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: [0, 0] for i in bounds}
        for batch in batches:
            for i, (low, high) in bounds.items():
                values = batch.column(f"c{i}").drop_null().to_numpy()
                total[i][0] += len(values)
                total[i][1] += int((values < low).sum())
                value, n = np.unique(values[(values >= low) & (values <= high)], return_counts=True)
                yield _counted(np.full(len(value), i), pa.array(value), n, np.zeros(len(value)))
        yield _counted(
            np.array(list(total)), pa.nulls(len(total), pa.float64()), np.array([t[0] for t in total.values()]),
            np.array([t[1] for t in total.values()]),
        )

    return run


def _counted(name: np.ndarray, value: pa.Array, n: np.ndarray, below: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(name.astype(np.int32)), value, pa.array(n.astype(np.int64)), pa.array(below.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["name", "value", "n", "below"])


def imputed(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Fill NULL and NaN with the medians; a column without any value stays as it is."""

    def fill(c: str, m: float) -> Column:
        value = F.col(c).cast("double")
        return F.when(value.isNull() | F.isnan(value), F.lit(m)).otherwise(value)

    return df.withColumns({c: fill(c, m) for c, m in medians.items() if m is not None})


def usable_medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Medians of the columns a model can use: those with any value in the training part."""
    return {c: m for c, m in exact_medians(train, columns).items() if m is not None}


def class_inventory(labelled: DataFrame) -> DataFrame:
    """Labels with their alphabetical index and size; labels are a handful."""
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1
    return counts.withColumn("class_index", position)


def trainable(labelled: DataFrame, component: str = "component") -> DataFrame:
    """Which components can be trained, and the reason where one cannot."""
    return labelled.groupBy(component).agg(
        F.count_distinct("label").alias("n_classes"),
        F.count("hours_to_failure").alias("n_rul_rows"),
    ).withColumn(
        "skip_classifier", F.when(F.col("n_classes") < 2, "only one class present")
    ).withColumn(
        "skip_quantiles",
        F.when(F.col("n_rul_rows") == 0, "no rows before an event").when(
            F.col("n_rul_rows") < MIN_QUANTILE_ROWS, "too few rows to split"
        ),
    )


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from (label, prediction); 0 where undefined."""
    cells = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("called")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("called")),
            )
        ).alias("s"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
    )
    zero = F.lit(0.0)
    return (
        sides.groupBy(F.col("s.class").alias("class"))
        .agg(
            F.sum("s.actual").alias("support"),
            F.sum("s.called").alias("called"),
            (F.sum("hit") / 2).alias("hits"),
        )
        .select(
            "class",
            F.coalesce(F.try_divide("hits", "called"), zero).alias("precision"),
            F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
            F.coalesce(F.try_divide(F.col("hits") * 2, F.col("called") + F.col("support")), zero).alias("f1"),
            "support",
        )
    )


def macro_f1(scored: DataFrame) -> DataFrame:
    return classification_report(scored).agg(F.avg("f1").alias("macro_f1"))


def pinball(actual: str, predicted: str | Column, alpha: float) -> Column:
    miss = F.col(actual) - (F.col(predicted) if isinstance(predicted, str) else predicted)
    return F.greatest(F.lit(alpha) * miss, F.lit(alpha - 1.0) * miss)


def assembled(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="keep").transform(df)


@dataclass
class FaultClassifier:
    """Trees boosted for all classes together, with the medians that fill gaps when scoring."""

    classes: list[str]
    model: boosting.Boosted | None
    medians: dict[str, float | None]
    columns: list[str]
    losses: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``class_probability``, in the order of ``classes``, and the likeliest class."""
        filled = imputed(df, self.medians)
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns])
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.array_position("class_probability", F.array_max("class_probability")).cast("int")
        return filled.withColumn("class_probability", self.model.class_probability(values)).withColumn(
            "prediction", F.element_at(names, best)
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """One description of the whole model; an older version there is replaced."""
        about = {"classes": self.classes, "medians": self.medians, "columns": self.columns, "losses": self.losses,
                 "model": self.model.to_json()}
        store_json(spark, about, f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FaultClassifier:
        about = load_json(spark, f"{path}/about")
        model = boosting.Boosted.from_json(about["model"])
        return cls(about["classes"], model, about["medians"], about["columns"], about["losses"])

    def fault_probability(self) -> Column:
        """Probability of anything but healthy, to four digits."""
        healthy = self.classes.index("healthy")
        return F.round(F.lit(1.0) - F.col("class_probability")[healthy], 4)


def fit_classifier(
    labelled: DataFrame,
    columns: list[str],
    keys: list[str],
    rounds: int = ROUNDS,
    learning_rate: float = LEARNING_RATE,
    depth: int = MAX_DEPTH,
    patience: int = PATIENCE,
) -> tuple[FaultClassifier, DataFrame] | None:
    """Fit on the training part, stop early on the test part; None with fewer than two classes.

    All classes are boosted together towards their joint log loss; fitting stops after
    ``patience`` rounds in which the test part's loss did not fall, and goes back to its lowest.

    A column without any value in the training part is left out.

    Also returns the scored test part. Medians come from the training part only and are kept
    with the model, so scoring fills gaps the same way.
    """
    flagged = split_flag(labelled, keys).persist(StorageLevel.MEMORY_AND_DISK)
    classes = [r["label"] for r in class_inventory(flagged).orderBy("class_index").collect()]
    if len(classes) < 2:
        flagged.unpersist()
        return None
    medians = usable_medians(flagged.where("NOT is_test"), columns)
    columns = list(medians)
    if not columns:
        return None
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int") - 1
    data = imputed(flagged, medians).withColumn("target", number.cast("int")).select(*columns, "target", "is_test")
    boosted, losses = boosting.fit(
        data, columns, len(classes), rounds, learning_rate, depth, MIN_ROWS_PER_LEAF, patience
    )
    model = FaultClassifier(classes, boosted, medians, columns, losses)
    scored = model.transform(flagged.where("is_test"))
    return model, scored


@dataclass
class CodedTree:
    """A regression tree as arrays by node: column (-1 for a leaf), cut, both children, leaf number."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    leaf: list[int]
    value: list[float]

    @classmethod
    def of(cls, tree: DecisionTreeRegressionModel) -> CodedTree:
        """Nodes in pre-order, in which Spark also numbers the leaves."""
        out = cls([], [], [], [], [], [])
        leaves = 0

        def add(node) -> int:
            nonlocal leaves
            at = len(out.feature)
            for column, blank in zip((out.feature, out.cut, out.left, out.right, out.leaf, out.value), (-1, 0.0, at, at, -1, 0.0)):
                column.append(blank)
            if node.getClass().getSimpleName() == "LeafNode":
                out.leaf[at], leaves = leaves, leaves + 1
            else:
                out.feature[at], out.cut[at] = node.split().featureIndex(), node.split().threshold()
                out.left[at], out.right[at] = add(node.leftChild()), add(node.rightChild())
            return at

        add(tree._java_obj.rootNode())
        return out

    @classmethod
    def of_bins(cls, feature: list[int], cut: list[int], value: list[float], edges: list[list[float]]) -> CodedTree:
        """The same from a tree over binned columns in heap order."""
        out = cls([], [], [], [], [], [])

        def add(i: int) -> int:
            at, is_leaf = len(out.feature), feature[i] < 0
            leaf = sum(n >= 0 for n in out.leaf) if is_leaf else -1
            threshold = 0.0 if is_leaf else edges[feature[i]][cut[i]]
            entry = (feature[i], threshold, at, at, leaf, value[i] if is_leaf else 0.0)
            for column, x in zip((out.feature, out.cut, out.left, out.right, out.leaf, out.value), entry):
                column.append(x)
            if not is_leaf:
                out.left[at], out.right[at] = add(2 * i + 1), add(2 * i + 2)
            return at

        add(0)
        return out

    def with_values(self, values: dict[float, float]) -> CodedTree:
        return CodedTree(self.feature, self.cut, self.left, self.right, self.leaf, [values.get(float(n), 0.0) for n in self.leaf])

    def gives(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.asarray(c) for c in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (feature[node] >= 0).any():
            f = feature[node]
            goes_left = x[rows, np.maximum(f, 0)] <= cut[node]
            node = np.where(goes_left, left[node], right[node])
        return np.asarray(self.value)[node]


@dataclass
class QuantileModel:
    """Sum of small trees whose leaves hold shrunken residual quantiles.

    The trees are one table of arrays, evaluated by one expression whatever their number is.
    """

    alpha: float
    base: float
    columns: list[str]
    medians: dict[str, float | None]
    trees: list[CodedTree] = field(default_factory=list)

    def add_to(self, df: DataFrame, name: str) -> DataFrame:
        """Add the prediction to a frame that has a ``features`` vector."""
        base, trees = self.base, list(self.trees)

        @F.pandas_udf("double")
        def evaluate(values: pd.Series) -> pd.Series:
            x = np.stack(values.to_numpy()) if len(values) else np.empty((0, 1))
            return pd.Series(sum((tree.gives(x) for tree in trees), np.full(len(x), base)))

        return df.withColumn(name, evaluate(vector_to_array("features")))

    def save(self, spark: SparkSession, path: str) -> None:
        store_json(spark, asdict(self), f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantileModel:
        about = load_json(spark, f"{path}/about")
        return cls(**{**about, "trees": [CodedTree(**t) for t in about["trees"]]})


def store_json(spark: SparkSession, content: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(path).first()["value"])


def fit_quantile(
    train: DataFrame,
    test: DataFrame,
    label: str,
    columns: list[str],
    medians: dict[str, float | None],
    alpha: float,
    rounds: int = ROUNDS,
    learning_rate: float = LEARNING_RATE,
    depth: int = MAX_DEPTH,
    patience: int = PATIENCE,
) -> tuple[QuantileModel, float]:
    """Boost towards the ``alpha`` quantile; returns the model and its test pinball loss.

    Each round fits a tree to the loss gradient and then sets every leaf to the residual
    quantile of its rows: one grouped sketch per round, a few dozen leaf rows to the driver.
    Running predictions are one expression over the trees so far, so the plan does not grow with
    the rounds; they are kept while a round's tree, leaves and loss read them, so every row is
    evaluated once a round. ``train`` and ``test`` carry ``features`` and the label.
    """
    base = train.agg(F.percentile_approx(label, alpha, 100_000).alias("q")).first()["q"]
    model = QuantileModel(alpha, float(base), columns, medians)
    rows = (
        train.select("features", label, F.lit(False).alias("_test"))
        .unionByName(test.select("features", label, F.lit(True).alias("_test")))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    loss = F.avg(F.when(F.col("_test"), pinball(label, "_f", alpha))).alias("loss")
    predicted = lambda: model.add_to(rows, "_f").persist(StorageLevel.MEMORY_AND_DISK)
    current = predicted()
    best_loss, best_round = current.agg(loss).first()["loss"], 0
    residual = F.col(label) - F.col("_f")
    for i in range(1, rounds + 1):
        gradient = F.when(residual > 0, F.lit(alpha)).otherwise(F.lit(alpha - 1.0))
        tree = DecisionTreeRegressor(
            labelCol="_gradient", predictionCol="_gradient_fit", leafCol="_leaf", maxDepth=depth,
            minInstancesPerNode=MIN_ROWS_PER_LEAF, seed=SEED,
        ).fit(current.where("NOT _test").withColumn("_gradient", gradient))
        quantiles = (
            tree.transform(current.where("NOT _test")).groupBy("_leaf")
            .agg(F.percentile_approx(residual, alpha, 10_000).alias("q")).collect()
        )
        model.trees.append(CodedTree.of(tree).with_values({r["_leaf"]: learning_rate * r["q"] for r in quantiles}))
        current.unpersist()
        current = predicted()
        now = current.agg(loss).first()["loss"]
        if best_loss is None or (now is not None and now < best_loss):
            best_loss, best_round = now, i
        elif i - best_round >= patience:
            break
    model.trees = model.trees[:best_round]
    current.unpersist()
    rows.unpersist()
    return model, best_loss


def fit_quantiles_in_tasks(
    data: DataFrame,
    label: str,
    columns: list[str],
    medians: dict[str, float | None],
    quantiles: dict[str, float],
    rounds: int = ROUNDS,
    learning_rate: float = LEARNING_RATE,
    depth: int = MAX_DEPTH,
    patience: int = PATIENCE,
) -> dict[str, QuantileModel]:
    """The models of ``fit_quantile`` for rows that fit one task, one task for each quantile, all at once.

    ``data`` has the filled columns, the label and ``is_test``. The rows are binned once; a tree is grown
    from their histograms, by the gain in variance of the gradient as before.
    """
    spark, train = data.sparkSession, data.where("NOT is_test")
    edges = boosting.bin_edges(train, columns)
    base = train.agg(F.percentile_approx(label, list(quantiles.values()), 100_000).alias("q")).first()["q"]
    path = work_path(spark, "quantiles")
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    data.select(values.alias("values"), F.col(label).cast("double").alias("label"), "is_test").mapInPandas(
        boosting.binned_rows(edges), "bins binary, label double, is_test boolean").write.parquet(path)
    rows = spark.read.schema("bins binary, label double, is_test boolean").parquet(path)

    def fitted(name: str, alpha: float, start: float) -> tuple[str, QuantileModel]:
        how = (alpha, float(start), rounds, learning_rate, depth, MIN_ROWS_PER_LEAF, patience)
        trees = one_task.run(rows, _quantile_in_task(boosting.BINS, *how))["trees"]
        return name, QuantileModel(alpha, float(start), columns, medians, [CodedTree.of_bins(*t, edges) for t in trees])

    with ThreadPoolExecutor(len(quantiles)) as pool:
        return dict(pool.map(fitted, quantiles, quantiles.values(), base))


def _quantile_in_task(width: int, *how):
    """All rounds of one quantile over a table of binned rows."""
    def train(table: pa.Table) -> dict:
        batch = table.to_batches()[0]
        label = batch.column("label")
        given = label.to_numpy(zero_copy_only=False), ~np.asarray(label.is_null()), batch.column("is_test").to_numpy(zero_copy_only=False)
        trees, loss = one_task.grow_quantile(boosting.byte_rows(batch), *given, *how, width=width)
        return {"trees": [[part.tolist() for part in tree] for tree in trees], "loss": loss}

    return train


def fit_rul(
    labelled: DataFrame,
    columns: list[str],
    keys: list[str],
    quantiles: dict[str, float],
    rounds: int = ROUNDS,
    depth: int = MAX_DEPTH,
) -> tuple[dict[str, QuantileModel], DataFrame] | None:
    """One model per quantile and the scored test part; None with too few labelled rows."""
    whole = labelled.withColumn("_all", F.lit("all"))
    flagged = split_flag(whole, keys, "_all").drop("_all").persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = flagged.count()
    if n_rows < MIN_QUANTILE_ROWS:
        return None
    medians = usable_medians(flagged.where("NOT is_test"), columns)
    columns = list(medians)
    if not columns:
        return None
    filled = imputed(flagged, medians)
    data = assembled(filled, columns)
    train, test = data.where("NOT is_test"), data.where("is_test")
    if one_task.fits(n_rows, len(columns)):
        models = fit_quantiles_in_tasks(filled, "hours_to_failure", columns, medians, quantiles, rounds, depth=depth)
        return models, with_quantiles(test, models)
    models = {}
    for name, alpha in quantiles.items():
        models[name], _ = fit_quantile(
            train, test, "hours_to_failure", columns, medians, alpha, rounds, depth=depth
        )
    return models, with_quantiles(test, models)


def with_quantiles(df: DataFrame, models: dict[str, QuantileModel]) -> DataFrame:
    """Add all quantile predictions to assembled rows, sorted so they never cross."""
    names = sorted(models, key=lambda n: models[n].alpha)
    out = df
    for n in names:
        out = models[n].add_to(out, f"_{n}")
    ordered = F.array_sort(F.array(*[F.col(f"_{n}") for n in names]))
    out = out.withColumn("_ordered", ordered)
    for i, n in enumerate(names):
        out = out.withColumn(f"rul_{n}", F.col("_ordered")[i])
    return out.drop("_ordered", *[f"_{n}" for n in names])


def metric_rows(df: DataFrame, component: str, model: str, params: dict[str, str], metrics: dict[str, str]) -> DataFrame:
    """Metric columns of a one-row frame as training-report rows."""
    pairs = [F.lit(str(x)) for item in params.items() for x in item]
    cells = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics.items()]
    return df.select(F.explode(F.array(*cells)).alias("m")).select(
        F.lit(component).alias("component"), F.lit(model).alias("model"),
        F.create_map(*pairs).alias("params"), "m.metric", "m.value",
    )
