"""Preprocessing and model fitted as one, saved as one.

Training rows must be encoded without their own labels and new rows with full rates, so
fitting and scoring differ. `TabularPipeline` does the former and returns a plain
`PipelineModel` that does the latter.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict
from decimal import Decimal
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsReadable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import field_type, is_number, is_numeric, number_of, quoted
from tabloom.operators.clean import FEW_LABELS
from tabloom.operators.fold_stats import EncoderFacts
from tabloom.operators.features import (
    CategoryStats,
    NumericStats,
    Vocabulary,
    exact_medians,
    filled,
    learn_vocabulary,
    numeric_stats,
    places,
    scaled,
)
from tabloom.operators.group_rate import (
    GroupRates,
    encode_leave_one_out,
    encode_rates,
    fit_all_rates,
    load_rates,
)
from tabloom.operators.models import Fit, create_model
from tabloom.operators.split import count_classes
from tabloom.sources.work import WorkArea, path_exists
from tabloom.spec import CLASSIFICATION, CLASSIFICATION_METRICS, TableSpec, check_metric_names

# Columns between the stages; none of them leaves the pipeline.
INTERNAL = "__tb_"
FEATURES, LABEL, INDEX = "__tb_features", "__tb_label", "__tb_prediction"
PROBABILITY, RAW = "__tb_probability", "__tb_raw_prediction"
KNOWN_SUFFIX = "_known"
# A model holds coefficients or trees for each class.
MAX_CLASSES = 100_000


class FeatureEncoder(Model, MLWritable, MLReadable):
    """Adds the feature vector: numericals, one-hot categories, then rate and flag per key.

    A vocabulary of many values is a table beside the rates; its places are joined and the vector
    is put together from the entries that are not zero.
    """

    state = Param(Params._dummy(), "state", "fitted statistics", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state: str | None = None) -> None:
        super().__init__()
        self.rates: list[GroupRates] = []
        self.vocabulary: DataFrame | None = None
        if state is not None:
            self._set(state=state)

    @classmethod
    def build(
        cls,
        numeric: Sequence[NumericStats],
        vocabulary: Vocabulary,
        rates: Sequence[GroupRates],
        rate_medians: Sequence[float | None],
    ) -> FeatureEncoder:
        state = {
            "numeric": [asdict(stats) for stats in numeric],
            "categories": [asdict(stats) for stats in vocabulary.columns],
            "keys": [group.key for group in rates],
            "rate_medians": list(rate_medians),
        }
        encoder = cls(state=json.dumps(state))
        encoder.rates, encoder.vocabulary = list(rates), vocabulary.table
        return encoder

    def _state(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.state))

    def _vocabulary(self) -> Vocabulary:
        return Vocabulary([CategoryStats(**stats) for stats in self._state()["categories"]], self.vocabulary)

    @property
    def feature_names(self) -> list[str]:
        """Names of the vector's elements, in order."""
        if self.vocabulary is not None:
            listed = self.names_table(self.vocabulary.sparkSession).orderBy("index")
            return [row["name"] for row in listed.collect()]
        categories = self._vocabulary().columns
        listed = [f"categorical__{stats.name}_{value}" for stats in categories for value in stats.values]
        return [*self._numeric_names(), *listed, *self._rate_names()]

    def names_table(self, spark: SparkSession) -> DataFrame:
        """(index, name) of the vector's elements, without listing a large vocabulary."""
        schema = "index long, name string"
        if self.vocabulary is None:
            return spark.createDataFrame(list(enumerate(self.feature_names)), schema)
        numeric = self._numeric_names()
        after = len(numeric) + self._vocabulary().size
        name = F.concat(F.lit("categorical__"), "name", F.lit("_"), "value")
        listed = self.vocabulary.select((F.col("place") + len(numeric)).alias("index"), name.alias("name"))
        few = [*enumerate(numeric), *enumerate(self._rate_names(), after)]
        return listed.unionByName(spark.createDataFrame(few, schema))

    def _numeric_names(self) -> list[str]:
        return [f"numerical__{stats['name']}" for stats in self._state()["numeric"]]

    def _rate_names(self) -> list[str]:
        names, state = [], self._state()
        for key, median in zip(state["keys"], state["rate_medians"], strict=True):
            names += [f"group:{key}__{key}"] if median is not None else []
            names.append(f"group:{key}__{key}{KNOWN_SUFFIX}")
        return names

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.assemble(add_rates(df, self.rates))

    def assemble(self, df: DataFrame) -> DataFrame:
        """Feature vector of a table that already holds its group rates."""
        numeric = [NumericStats(**stats) for stats in self._state()["numeric"]]
        added: dict[str, Column] = {
            f"__tb_num_{index}": scaled(df, stats) for index, stats in enumerate(numeric)
        }
        before, after = list(added), []
        for index, median in enumerate(self._state()["rate_medians"]):
            if median is not None:
                added[f"__tb_rate_{index}"] = F.coalesce(f"__tb_rate_{index}", F.lit(median))
                after.append(f"__tb_rate_{index}")
            after.append(f"__tb_known_{index}")
        ready = df.withColumns(added) if added else df
        vocabulary = self._vocabulary()
        if vocabulary.table is None:
            vector = _assembled(ready, before, vocabulary.columns, after)
        else:
            vector = _assembled_sparsely(ready, before, vocabulary, after)
        kept = (FEATURES, LABEL)
        return vector.drop(
            *(n for n in vector.columns if n.startswith(INTERNAL) and n not in kept)
        )

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader()


class _EncoderWriter(MLWriter):
    def __init__(self, encoder: FeatureEncoder) -> None:
        super().__init__()
        self.encoder = encoder

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.encoder, path, self.sparkSession)
        for index, group in enumerate(self.encoder.rates):
            group.table.write.parquet(f"{path}/rates/{index}")
        if self.encoder.vocabulary is not None:
            self.encoder.vocabulary.write.parquet(f"{path}/vocabulary")


class _EncoderReader(MLReader):
    def load(self, path: str) -> FeatureEncoder:
        encoder = FeatureEncoder()
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        encoder._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(encoder, metadata)
        encoder.rates = [
            load_rates(self.sparkSession, key, f"{path}/rates/{index}")
            for index, key in enumerate(encoder._state()["keys"])
        ]
        if any(stats["values"] is None for stats in encoder._state()["categories"]):
            encoder.vocabulary = self.sparkSession.read.parquet(f"{path}/vocabulary")
        return encoder


class LabelDecoder(Model, DefaultParamsWritable, DefaultParamsReadable):
    """Turns model output into `prediction` and, for two classes, `score`.

    `score` is the probability of the higher class; other models have none.
    """

    classes = Param(Params._dummy(), "classes", "labels by index", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, classes: str | None = None) -> None:
        super().__init__()
        if classes is not None:
            self._set(classes=classes)

    @classmethod
    def build(cls, labels: Sequence[Any] | None, dtype: T.DataType) -> LabelDecoder:
        texts = None if labels is None else [str(label) for label in labels]
        return cls(classes=json.dumps({"labels": texts, "type": dtype.json()}))

    def _labels(self) -> tuple[list[str] | None, T.DataType]:
        held = json.loads(self.getOrDefault(self.classes))
        return held["labels"], T._parse_datatype_json_string(held["type"])

    @property
    def labels(self) -> list[Any] | None:
        """The classes the model knows, lowest first; None for regression."""
        texts, dtype = self._labels()
        if texts is None or isinstance(dtype, T.StringType):
            return texts
        if isinstance(dtype, T.BooleanType):
            return [text == "True" for text in texts]
        if isinstance(dtype, T.DecimalType):
            return [Decimal(text) for text in texts]
        return [int(t) if isinstance(dtype, T.IntegralType) else float(t) for t in texts]

    def _transform(self, df: DataFrame) -> DataFrame:
        texts, dtype = self._labels()
        added = {"prediction": F.col(INDEX)}
        if texts is not None and len(texts) > FEW_LABELS:
            table = df.sparkSession.createDataFrame(list(enumerate(texts)), f"{INTERNAL}at int, {INTERNAL}label_text string")
            df = df.join(F.broadcast(table), F.col(INDEX).cast("int") == F.col(f"{INTERNAL}at"), "left")
            added["prediction"] = F.col(f"{INTERNAL}label_text").cast(dtype)
        elif texts is not None:
            values = F.array(*(F.lit(text).cast(dtype) for text in texts))
            added["prediction"] = F.element_at(values, F.col(INDEX).cast("int") + 1)
            if len(texts) == 2 and PROBABILITY in df.columns:
                added["score"] = vector_to_array(PROBABILITY)[1]
        decoded = df.withColumns(added)
        return decoded.drop(*(n for n in decoded.columns if n.startswith(INTERNAL)))


class TabularPipeline(Estimator):
    """Fits encoder and model on training rows, refitting every statistic it uses."""

    def __init__(
        self, spec: TableSpec, area: WorkArea | None = None, facts: EncoderFacts | None = None
    ) -> None:
        super().__init__()
        self.spec = spec
        self.area = area
        self.facts = facts  # what the training rows teach, if it is known already

    def _fit(self, train: DataFrame) -> PipelineModel:
        spec = self.spec
        area = self.area or WorkArea.until_exit(train.sparkSession, "fit")
        facts = self.facts
        labels, labelled = _with_labels(facts.rows if facts else train, spec, facts.classes if facts else None)
        if labels and len(labels) != 2:
            # Ranking needs two classes; say so before fitting anything.
            check_metric_names(spec.metrics, CLASSIFICATION_METRICS[:4], spec.task)
        if facts is None:
            encoder, encoded = fit_encoder(labelled, spec, area)
        else:
            encoder = FeatureEncoder.build(facts.numeric, facts.vocabulary, facts.rates, facts.rate_medians)
            encoded = encoder.assemble(labelled)
        matrix = area.table(encoded.select(FEATURES, LABEL), "matrix")
        rows = sum(labels.values()) if labels else matrix.count()
        fit = Fit(rows, len(labels) if labels else None, spec.seed)
        model = _connect(create_model(spec.model_type, spec.task, spec.params, fit)).fit(matrix)
        decoder = LabelDecoder.build(list(labels) if labels else None, _decoded_type(train, spec))
        return PipelineModel(stages=[encoder, model, decoder])


def fit_encoder(
    train: DataFrame, spec: TableSpec, area: WorkArea, few_categories: int | None = None
) -> tuple[FeatureEncoder, DataFrame]:
    """Fit on training rows that hold `LABEL`; also return them encoded leave-one-out."""
    target = spec.target if _summable(train, spec.target) else LABEL
    numeric = numeric_stats(train, spec.numerical)
    vocabulary = learn_vocabulary(train, spec.categorical, area, few_categories)
    rates = fit_all_rates(train, spec.group_keys, target, area)
    looked_up = add_rates(train, rates, target)
    if rates:
        needed = [*spec.numerical, *spec.categorical, LABEL]
        needed += [name for name in looked_up.columns if name.startswith(("__tb_rate_", "__tb_known_"))]
        looked_up = area.table(looked_up.select(*map(quoted, needed)), "rated")
    medians = _rate_medians(looked_up, len(rates))
    encoder = FeatureEncoder.build(numeric, vocabulary, rates, medians)
    return encoder, encoder.assemble(looked_up)


def add_rates(df: DataFrame, rates: Sequence[GroupRates], target: str | None = None) -> DataFrame:
    """Rate and flag columns per key; leave-one-out when the target is named."""
    for index, group in enumerate(rates):
        names = (f"__tb_rate_{index}", f"__tb_known_{index}")
        if target is None:
            df = encode_rates(df, group, *names)
        else:
            df = encode_leave_one_out(df, group, target, *names)
    return df


def _rate_medians(rated: DataFrame, groups: int) -> list[float | None]:
    """Median of each rate as training rows see it; None if no row has one."""
    if not groups:
        return []
    names = [f"__tb_rate_{index}" for index in range(groups)]
    found = rated.agg(
        *(F.count(name).alias(f"count:{name}") for name in names),
        *(F.approx_count_distinct(name).alias(f"distinct:{name}") for name in names),
    ).first()
    counts = {name: found[f"count:{name}"] for name in names}
    distinct = {name: found[f"distinct:{name}"] for name in names}
    medians = exact_medians(rated, names, counts, distinct)
    return [medians.get(name) for name in names]


def _assembled(
    df: DataFrame, before: list[str], categories: Sequence[CategoryStats], after: list[str]
) -> DataFrame:
    named = {f"__tb_cat_{index}": filled(stats) for index, stats in enumerate(categories)}
    encoded = _one_hot(df.withColumns(named) if named else df, categories)
    inputs = [*before, *(f"__tb_hot_{index}" for index in range(len(categories))), *after]
    return VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(encoded)


def _assembled_sparsely(
    df: DataFrame, before: list[str], vocabulary: Vocabulary, after: list[str]
) -> DataFrame:
    """The same vector from its entries, without an attribute per element in the schema."""
    columns = [f"__tb_place_{index}" for index in range(len(vocabulary.columns))]
    placed = places(df, vocabulary, columns)
    size = len(before) + vocabulary.size + len(after)
    entry = [(F.lit(index), F.col(name)) for index, name in enumerate(before)]
    entry += [(F.col(name) + len(before), F.lit(1.0)) for name in columns]
    entry += [(F.lit(len(before) + vocabulary.size + index), F.col(name)) for index, name in enumerate(after)]
    listed = F.array(*(F.struct(at.cast("int").alias("i"), value.alias("x")) for at, value in entry))
    held = F.filter(listed, lambda e: e["i"].isNotNull() & (e["x"] != 0))
    # The layout in which Spark stores a sparse vector; reading it as JSON turns it into one.
    stored = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).alias("size"),
        F.transform(held, lambda e: e["i"]).alias("indices"),
        F.transform(held, lambda e: e["x"]).alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    vector = F.from_json(F.to_json(F.struct(stored.alias("v"))), schema)["v"]
    return placed.withColumn(FEATURES, vector.alias(FEATURES, metadata={"ml_attr": {"num_attrs": size}}))


def _one_hot(df: DataFrame, categories: Sequence[CategoryStats]) -> DataFrame:
    if not categories:
        return df
    indexes, indexed = range(len(categories)), df
    # One model per column: a joint one takes arrays of labels of one length only.
    for index, stats in enumerate(categories):
        indexer = StringIndexerModel.from_labels(
            list(stats.values), f"__tb_cat_{index}", f"__tb_pos_{index}", handleInvalid="keep"
        )
        indexed = indexer.transform(indexed)
    # The last position stands for untrained values and is dropped: they are all zeros.
    encoder = OneHotEncoder(
        inputCols=[f"__tb_pos_{index}" for index in indexes],
        outputCols=[f"__tb_hot_{index}" for index in indexes],
        dropLast=True,
    )
    return encoder.fit(indexed).transform(indexed)


def _summable(df: DataFrame, target: str) -> bool:
    return is_numeric(field_type(df, target))


def _with_labels(
    df: DataFrame, spec: TableSpec, known: dict[Any, int] | None = None
) -> tuple[dict[Any, int] | None, DataFrame]:
    """Class sizes in label order, and the table with the model's label: class index or the value.

    `known` are the class sizes, if they have been counted. Indexes of many classes are joined.
    """
    if spec.task != CLASSIFICATION:
        return None, df.withColumn(LABEL, number_of(df, spec.target).cast("double"))
    sizes = known or count_classes(df, spec.target, MAX_CLASSES).few
    if sizes is None:
        raise ValueError(f"{spec.target!r} has more than {MAX_CLASSES} values; no model learns so many classes")
    dtype = field_type(df, spec.target)
    if list(sizes) == list(range(len(sizes))):
        return sizes, df.withColumn(LABEL, number_of(df, spec.target).cast("double"))
    if len(sizes) > FEW_LABELS:
        schema = T.StructType([T.StructField("__label_value", dtype), T.StructField(LABEL, T.DoubleType())])
        rows = [(label, float(index)) for index, label in enumerate(sizes)]
        table = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # at most MAX_CLASSES rows
        joined = df.join(table, quoted(spec.target) == F.col("__label_value"), "left")
        return sizes, joined.drop("__label_value")
    pairs = [part for index, label in enumerate(sizes) for part in (F.lit(label).cast(dtype), F.lit(float(index)))]
    return sizes, df.withColumn(LABEL, F.create_map(*pairs)[quoted(spec.target)])


def _decoded_type(df: DataFrame, spec: TableSpec) -> T.DataType:
    dtype = field_type(df, spec.target)
    return dtype if spec.task == CLASSIFICATION or is_number(dtype) else T.DoubleType()


def _connect(estimator: Estimator) -> Estimator:
    """Point the estimator at this pipeline's column names, whichever of them it has."""
    columns = {
        "featuresCol": FEATURES,
        "labelCol": LABEL,
        "predictionCol": INDEX,
        "probabilityCol": PROBABILITY,
        "rawPredictionCol": RAW,
    }
    for name, column in columns.items():
        if estimator.hasParam(name):
            estimator.set(estimator.getParam(name), column)
    if estimator.hasParam("classifier"):
        _connect(estimator.getOrDefault("classifier"))
    return estimator


def known_labels(pipeline: PipelineModel) -> list[Any] | None:
    return pipeline.stages[-1].labels


def save_pipeline(pipeline: PipelineModel, path: str) -> None:
    """Save preprocessing and model, group rates included, as one artefact."""
    pipeline.write().overwrite().save(path)


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no trained pipeline at {path}; run training first")
    pipeline = PipelineModel.load(path)
    for model in pipeline.stages:
        # The one column name this model does not keep when saved.
        if isinstance(model, OneVsRestModel):
            model.setRawPredictionCol(RAW)
    return pipeline
