"""Checks on what a question asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names_entity(entity: Column) -> Column:
    """False for NULL, the empty text and the words null and none."""
    return ~F.lower(F.coalesce(entity, F.lit(""))).isin("", "null", "none")


def entity_guard(tasks: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """Tasks that name an entity, and the rest."""
    named = names_entity(F.col(entity))
    return tasks.where(named), tasks.where(~named)
