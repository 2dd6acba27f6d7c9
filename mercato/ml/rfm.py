"""Customer groups by recency, frequency, spend and review score."""

from __future__ import annotations

import dataclasses

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.ml import kmeans
from mercato.ml.preprocess import FeaturePreparer
from mercato.plans import churn

# Groups, starts and seed.
CLUSTERS, STARTS, SEED = 3, 10, 42
KEY = "customer_unique_id"


@dataclasses.dataclass
class CustomerGroups:
    """Fills and scales the features as fitted, then takes the nearest center."""

    scaled: Model
    inputs: list[str]
    centers: list[list[float]]

    def transform(self, profiles: DataFrame) -> DataFrame:
        near = kmeans.nearest([kmeans.whole(F.col(c)) for c in self.inputs], F.lit(self.centers))
        return self.scaled.transform(profiles).select(*profiles.columns, near["cluster"].alias("cluster"))


def train_rfm_clusters(profiles: DataFrame, clusters: int = CLUSTERS, starts: int = STARTS, seed: int = SEED) -> CustomerGroups:
    """k-means on the scaled features; the best of several starts, which run together."""
    preparer = FeaturePreparer(churn.FEATURES, scaling="standard")
    scaled = preparer.fit(profiles)
    points = scaled.transform(profiles).select(F.col(KEY), *preparer.outputs)
    return CustomerGroups(scaled, preparer.outputs, kmeans.fit(points, KEY, preparer.outputs, clusters, starts, seed))


def risk_profiles(model: CustomerGroups, profiles: DataFrame) -> DataFrame:
    """Customers with their cluster and its name."""
    grouped = model.transform(profiles)
    names = churn.cluster_risk_map(churn.cluster_summary(grouped))
    return churn.map_labels(grouped, names)
