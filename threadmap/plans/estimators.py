"""Routes as a stage of Spark ML pipelines: an estimator with parameters, a model that is saved and loaded, named features."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import one_hot
from ..operators.features import feature_names
from .model import RouteModel, fit

FIELDS = ("route_id", "position", "projected", "residual", "residual_norm", "tangent", "residual_coordinates", "reconstructed", "unexplained_residual", "unexplained_residual_norm")


class _RouteParams(HasInputCol, HasOutputCol, HasSeed):
    idCol = Param(Params._dummy(), "idCol", "column that identifies a row", TypeConverters.toString)
    landmarks = Param(Params._dummy(), "landmarks", "landmarks that the network is made of", TypeConverters.toInt)
    residualDim = Param(Params._dummy(), "residualDim", "coordinates across the routes", TypeConverters.toInt)
    bandwidth = Param(Params._dummy(), "bandwidth", "width of the kernel along a route, as a share of it", TypeConverters.toFloat)
    resultCol = Param(Params._dummy(), "resultCol", "struct column with all fields of a row's result; none where empty", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol="x", outputCol="features", idCol="row_id", landmarks=16, residualDim=0, bandwidth=0.1, resultCol="", seed=0)

    def _points(self, rows: DataFrame, *carry) -> DataFrame:
        return rows.select(F.col(self.getOrDefault("idCol")).cast("long").alias("row_id"), F.col(self.getInputCol()).cast("array<double>").alias("x"), *carry)

    @staticmethod
    def _checked(values: dict) -> dict:
        for name, good in (("landmarks", lambda v: v >= 2), ("residualDim", lambda v: v >= 0), ("bandwidth", lambda v: 0 < v < float("inf"))):
            if values.get(name) is not None and not good(values[name]):
                raise ValueError(f"{name} can't be {values[name]}")
        return values


class RouteEmbedder(Estimator, _RouteParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits routes to an array column; its model gives each row its features along them."""

    @keyword_only
    def __init__(self, *, inputCol="x", outputCol="features", idCol="row_id", landmarks=16, residualDim=0, bandwidth=0.1, resultCol="", seed=0):
        super().__init__()
        self._set(**self._checked(self._input_kwargs))

    @keyword_only
    def setParams(self, *, inputCol=None, outputCol=None, idCol=None, landmarks=None, residualDim=None, bandwidth=None, resultCol=None, seed=None):
        return self._set(**self._checked(self._input_kwargs))

    def _fit(self, rows: DataFrame) -> RouteEmbedderModel:
        get = self.getOrDefault
        routes = fit(self._points(rows), get("landmarks"), get("seed"), residual_dim=get("residualDim"), bandwidth=get("bandwidth"))
        return self._copyValues(RouteEmbedderModel(routes))


class RouteEmbedderModel(Model, _RouteParams, MLReadable, MLWritable):
    """Adds a vector column: the route as one-hot, the position, the residual's norm and, if fitted, its coordinates.

    The names of features are in the column's metadata, as those of Spark ML's own stages are.
    """

    def __init__(self, routes: RouteModel | None = None):
        super().__init__()
        self.routes = routes

    def count(self) -> int:
        """How many routes there are."""
        return self.routes.segments.agg(F.max("route_id")).first()[0] + 1

    def names(self) -> list[str]:
        return feature_names(self.count(), self.routes.residual_dim)

    def result(self, rows: DataFrame) -> DataFrame:
        """row_id and all fields of each row's result."""
        return self.routes.transform(self._points(rows)).select("row_id", *FIELDS)

    def _transform(self, rows: DataFrame) -> DataFrame:
        placed = self.routes.transform(self._points(rows, F.struct("*").alias("__row")))
        names, many = self.names(), self.count()
        parts = F.concat(one_hot(F.col("route_id"), F.lit(many)), F.array("position", "residual_norm"), "residual_coordinates")
        told = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]}, "num_attrs": len(names)}}
        own = [F.struct(*FIELDS).alias(self.getOrDefault("resultCol"))] if self.getOrDefault("resultCol") else []
        return placed.select("__row.*", array_to_vector(parts).alias(self.getOutputCol(), metadata=told), *own)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: RouteEmbedderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.routes.save(f"{path}/routes")


class _Reader(MLReader):
    def load(self, path: str) -> RouteEmbedderModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = RouteEmbedderModel(RouteModel.load(self.sparkSession, f"{path}/routes"))
        out._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(out, told)
        return out
