"""Mutations of a keyed table as pure functions (state, changes) -> state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keeps existing rows; of new rows that share a key the first by column order stays."""
    from .relational import first_wins

    fresh = first_wins(new.join(state, key, "left_anti"), [F.col(key)], new.columns)
    return state.unionByName(fresh, allowMissingColumns=True)


def upsert(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return state.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def update(state: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sets the given columns where the key has a change, nulls included."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"__new_{x}") for x in columns], F.lit(True).alias("__hit"))
    joined = state.join(c, key, "left")
    value = lambda x: F.when(F.col("__hit"), F.col(f"__new_{x}")).otherwise(F.col(x)).alias(x)
    return joined.select(*[value(x) if x in columns else F.col(x) for x in state.columns])


def update_where(state: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    return state.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def promote(state: DataFrame, key: str, status: str, old: str, new: str, n: int) -> DataFrame:
    """The first n rows (by key) with the old status get the new one."""
    chosen = state.where(F.col(status) == old).orderBy(key).limit(n).select(key, F.lit(new).alias(status))
    return update(state, chosen, key, [status])


def review(state: DataFrame, decisions: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """Known and registered type: to extraction; known but unregistered: to learning, with a note; else to learning."""
    known = F.lower(F.trim("human_decision")) == "known"
    valid = F.col("human_event_type").isin(list(types))
    changes = decisions.select(
        key,
        F.when(known & valid, "pending_extraction").otherwise("pending_learning").alias("current_status"),
        F.when(known & valid, F.col("human_event_type")).alias("assigned_event_type"),
        F.when(known & ~valid, "unregistered type").alias("notes"),
    )
    return update(state, changes, key, ["current_status", "assigned_event_type", "notes"])


def delete_entity(nodes: DataFrame, edges: DataFrame, name: Column, node_key: str, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Removes a node and every edge it ends."""
    return nodes.where(F.col(node_key) != name), edges.where((F.col(source) != name) & (F.col(target) != name))


def evolve_schema(state: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Adds missing columns as nulls; existing ones stay as they are."""
    return state.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in state.columns})
