"""Classifiers on flow tables with Spark ML, and the probes built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import metrics as E
from flowlens.operators import trees as R
from flowlens.operators.splits import sample_keep_attacks
from flowlens.tables import cut

TRAIN, VAL, TEST = 0, 1, 2


def with_classes(df: DataFrame, n_classes: int, label: str = "target") -> DataFrame:
    """The label as a nominal column that declares all classes, so that a classifier also scores those
    absent from its training rows (with probability 0)."""
    declared = {"ml_attr": {"type": "nominal", "name": "y", "vals": [str(i) for i in range(n_classes)]}}
    return df.withColumn("y", F.col(label).cast("double").alias("y", metadata=declared)).withMetadata("y", declared)


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(df)


def balanced(df: DataFrame, scheme: str = "inverse") -> DataFrame:
    """Training rows with a weight column; absent classes take no part."""
    weights = cut(E.class_weights(df, scheme).select("target", F.col("weight").alias("class_weight")))
    return df.join(weights, "target")


def random_forest(seed: int, trees: int = 200, depth: int = 30, **more) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="class_weight", numTrees=trees, maxDepth=depth, seed=seed, **more)


class OneVersusRest:
    """A binary classifier per class, that class against all others; the class whose classifier is surest is the answer, the first of equal ones.

    The models and answers of Spark's ``OneVsRest``. Only the classifier that learns keeps its rows in memory, not those of a second one and a common
    copy besides; and the answers of all classifiers stand side by side in one projection, where Spark's carries them through a chain of arrays.
    """

    def __init__(self, classifier):
        self.classifier = classifier

    def fit(self, train: DataFrame) -> OneVersusRestModel:
        one = self.classifier
        label = F.col(one.getLabelCol())
        models = []
        for k in range(int(train.agg(F.max(label)).first()[0]) + 1):
            named = {one.labelCol: "_one", one.rawPredictionCol: f"_raw{k}", one.probabilityCol: "", one.predictionCol: ""}
            models.append(one.fit(train.withColumn("_one", (label == k).cast("double")), named))
        return OneVersusRestModel(models)


class OneVersusRestModel:
    def __init__(self, models: Sequence):
        self.models = list(models)

    def transform(self, df: DataFrame) -> DataFrame:
        for model in self.models:
            df = model.transform(df)
        raw = [model.getRawPredictionCol() for model in self.models]
        sure = F.array(*[F.get(vector_to_array(r), F.lit(1)) for r in raw])
        return df.withColumn("_sure", sure).withColumn("prediction", S.first_argmax(F.col("_sure")).cast("double")).drop("_sure", *raw)


def boosted_trees(seed: int, rounds: int = 200, depth: int = 6) -> OneVersusRest:
    one = GBTClassifier(featuresCol="features", labelCol="y", weightCol="class_weight", maxIter=rounds, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return OneVersusRest(one)


def perceptron(n_features: int, n_classes: int, seed: int, rounds: int = 100) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=[n_features, 128, 64, n_classes], maxIter=rounds, seed=seed)


def tree(depth: int = 6, seed: int = 0, bins: int = 256) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="class_weight", maxDepth=depth, maxBins=bins, seed=seed)


def predict(model, df: DataFrame, n_classes: int, keep: Sequence[str] = ("flow_id", "window_id")) -> DataFrame:
    """Predictions with full-width scores where the model gives probabilities."""
    scored = model.transform(df)
    columns = [*keep, F.col("target").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")]
    if "probability" in scored.columns:
        columns.append(vector_to_array("probability").alias("scores"))
    return scored.select(*columns)


def run_baseline(
    df: DataFrame, estimator, name: str, seed: int, columns: Sequence[str], n_classes: int, limit: int | None = None, weighted: bool = True,
    predict_on: int = TEST, keep: Sequence[str] = ("flow_id", "window_id"), write: bool = True,
) -> tuple[DataFrame, object]:
    """Fit and score: predictions of the ``predict_on`` split, with the columns ``keep``, and the fitted model.

    All training flows are learned from, unless a ``limit`` asks for a sample. A sample keeps every attack, so that it has no benign flow left where
    the attacks alone reach the limit. The training rows are written before they are learned from; without ``write`` they are read as ``df`` gives them, for
    rows that are much wider than what they are made of.
    """
    wide = assemble(with_classes(df, n_classes), columns)
    taken = wide.where(F.col("split") == TRAIN)
    if limit is not None:
        taken = sample_keep_attacks(taken, limit, seed)
    train = balanced(taken).select("y", "class_weight", *columns) if weighted else taken.select("y", *columns)
    train = assemble((cut(train) if write else train).withMetadata("y", wide.schema["y"].metadata), columns)
    model = estimator.fit(train)
    scored = predict(model, wide.where(F.col("split") == predict_on), n_classes, keep)
    return scored.withColumns({"model": F.lit(name), "seed": F.lit(seed)}), model


def score_table(pred: DataFrame, n_classes: int) -> DataFrame:
    """Long metrics table of a prediction table."""
    return score_outcomes(cut(E.outcome_counts(pred)), n_classes)


def score_outcomes(outcomes: DataFrame, n_classes: int) -> DataFrame:
    """Long metrics table of written counts (model, seed, y_true, y_pred, n)."""
    prf = E.per_class_prf(E.counts_of_outcomes(outcomes, E.RUN), n_classes)
    wide = E.summary_metrics(prf).join(E.binary_of_outcomes(outcomes, E.RUN), E.RUN)
    names = [c for c in wide.columns if c not in E.RUN]
    return wide.unpivot(E.RUN, names, "metric", "value")


def _probe_rows(df: DataFrame, columns: Sequence[str], limit: int | None) -> DataFrame:
    """The training flows that a probe learns from. Trees grow from counts, so that all of them can be taken."""
    train = df.where(F.col("split") == TRAIN).select("flow_id", "target", *columns)
    return train if limit is None else sample_keep_attacks(train, limit, 0)


def single_feature_probe(df: DataFrame, columns: Sequence[str], n_classes: int, limit: int | None = None, depth: int = 6) -> DataFrame:
    """A shallow class-balanced tree per single feature, scored on the test flows; ranked by macro-F1.

    All trees come from one histogram of the training flows, all of them unless a ``limit`` asks for a sample, and all answers from one pass over
    the test flows.
    """
    counts = R.value_counts(_probe_rows(df, columns, limit), columns)
    hist = cut(R.histogram(counts, R.value_bins(counts), n_classes), "histogram")
    leaves = R.single_feature_trees(hist, R.class_weights(counts), depth)
    outcomes = cut(R.single_feature_outcomes(df.where(F.col("split") == TEST), columns, leaves), "outcomes")
    return score_outcomes(outcomes, n_classes)


def joint_feature_probe(df: DataFrame, columns: Sequence[str], n_classes: int, limit: int | None = None, depth: int = 6) -> DataFrame:
    """A shallow class-balanced tree over several fields, grown from all training flows unless a ``limit`` asks for a sample, scored on the test flows."""
    tree = R.joint_tree(_probe_rows(df, columns, limit), columns, n_classes, depth)
    test = df.where(F.col("split") == TEST).select("target", *columns)
    pred = test.select(F.lit("+".join(columns)).alias("model"), F.lit(0).alias("seed"), F.col("target").alias("y_true"), tree.predict().alias("y_pred"))
    return score_table(pred, n_classes)


def host_fingerprint_probe(df: DataFrame, columns: Sequence[str], depth: int = 10) -> DataFrame:
    """A tree that names the source host from a few fields: accuracy, balanced accuracy, and the same of always
    answering the most frequent training host.

    Hosts stay names: none is numbered at the driver, and every host that only the test flows have is a class of its own, with a recall of zero.
    """
    train, test = df.where(F.col("split") == TRAIN), df.where(F.col("split") == TEST)
    tree = R.many_class_tree(train, columns, "src_ip", depth)
    most = train.groupBy("src_ip").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "src_ip")).alias("m")).select("m.src_ip").scalar()
    answers = F.array(
        F.struct(F.lit("fingerprint").alias("model"), (F.lit(None).cast("string") if tree is None else tree.predict()).alias("y")), F.struct(F.lit("majority").alias("model"), F.col("_most").alias("y"))
    )
    rows = test.withColumn("_most", most).select("src_ip", F.explode(answers).alias("_a"))
    hits = rows.groupBy("_a.model", "src_ip").agg(F.count("*").alias("n"), F.count_if(F.col("_a.y") == F.col("src_ip")).alias("hit"))
    return hits.groupBy("model").agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))


def context_probe(
    df: DataFrame, sets: dict[str, Sequence[str]], n_classes: int, limit: int | None = None, seeds: Sequence[int] = (1, 2, 3), trees: int = 200, depth: int = 30,
    context_columns: Sequence[str] = (), write: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """A forest per feature set and seed: the metrics table, and the share of impurity importance that
    falls on ``context_columns``. All training flows are learned from unless a ``limit`` asks for a sample; see ``run_baseline`` for ``write``."""
    parts, shares = [], []
    for name, columns in sets.items():
        for seed in seeds:
            scored, model = run_baseline(df, random_forest(seed, trees, depth), name, seed, columns, n_classes, limit, keep=(), write=write)
            parts.append(scored.drop("scores"))
            shares.append((name, seed, importance_share(model, columns, context_columns)))
    table = df.sparkSession.createDataFrame(shares, "model string, seed int, context_share double")
    return score_table(_union(parts), n_classes), table


def importance_share(model, columns: Sequence[str], of: Sequence[str]) -> float:
    """Share of the forest's impurity importance on the columns in ``of``: one number per feature."""
    values = model.featureImportances.toArray()
    total = float(values.sum())
    return float(sum(v for c, v in zip(columns, values) if c in set(of)) / total) if total > 0 else 0.0


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
