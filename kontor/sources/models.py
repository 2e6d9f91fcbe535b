"""Fitted models as Parquet tables: fitted once, read by every scoring run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.operators.contracts import artifact_consistency, require_consistent


def _names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "position int, feature string")


def _read_names(spark: SparkSession, path: str) -> list[str]:
    return [r.feature for r in spark.read.parquet(path).orderBy("position").collect()]


def save_tables(path: str, tables: dict[str, DataFrame]) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def save_archetypes(model, names: list[str], path: str) -> None:
    """Scaler, centroids, archetype names, feature order and the fit's figures."""
    spark = model.stats.sparkSession
    save_tables(path, {"stats": model.stats, "centroids": model.centroids, "names": model.names,
                       "features": _names(spark, names),
                       "fit": spark.createDataFrame([(model.k, model.silhouette)], "k int, silhouette double")})


def load_archetypes(spark: SparkSession, path: str):
    """(model, feature names in the model's order)."""
    from kontor.plans.flows import ArchetypeModel
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    fit = read("fit").first()
    return (ArchetypeModel(read("stats"), read("centroids"), read("names"), fit["k"], fit["silhouette"]),
            _read_names(spark, f"{path}/features"))


def save_forest(model, names: list[str], path: str) -> None:
    """Trees, threshold, tuning grid and feature order."""
    spark = model.nodes.sparkSession
    save_tables(path, {"nodes": model.nodes, "grid": model.grid, "features": _names(spark, names),
                       "fit": spark.createDataFrame([(model.psi, model.threshold, model.contamination)],
                                                    "psi int, threshold double, contamination double")})


def load_forest(spark: SparkSession, path: str):
    """(model, feature names in the model's order)."""
    from kontor.plans.flows import ForestModel
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    fit = read("fit").first()
    return (ForestModel(read("nodes"), fit["psi"], fit["threshold"], fit["contamination"], read("grid")),
            _read_names(spark, f"{path}/features"))


def consistency(spark: SparkSession, archetypes: str, forest: str) -> DataFrame:
    """N3 over two stored models."""
    one, behaviour = load_archetypes(spark, archetypes)
    two, anomaly = load_forest(spark, forest)
    return artifact_consistency(one.stats, one.centroids, behaviour, two.nodes, anomaly)


def load_checked(spark: SparkSession, archetypes: str, forest: str):
    """Both models, or an error naming the tables that do not fit."""
    require_consistent(consistency(spark, archetypes, forest))
    return load_archetypes(spark, archetypes)[0], load_forest(spark, forest)[0]


def model_version_of(archetypes, forest=None) -> str:
    from kontor.operators.iforest import model_version
    return model_version(archetypes.k, None if forest is None else forest.contamination)
