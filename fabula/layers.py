"""One entry to the layers of events and patterns, with the usual defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.operators import mining, prediction, relational, sequences, vectors


class Layers:
    """events(event_id, event_type, ts, user_id, ...), patterns(pattern, sequence, support, confidence), and vectors by id."""

    def __init__(self, events: DataFrame, patterns: DataFrame, embedded: DataFrame | None = None):
        self.events, self.patterns, self.embedded = events, patterns, embedded

    def query_events(self, conditions: dict, limit: int = 100) -> DataFrame:
        return self.events.where(relational.conjunction(conditions)).orderBy("event_id").limit(limit)

    def query_patterns(self, conditions: dict, limit: int = 50) -> DataFrame:
        return self.patterns.where(relational.conjunction(conditions)).orderBy(F.desc("support"), "pattern").limit(limit)

    def similar_events(self, ids: DataFrame, k: int = 10, threshold: float = 0.7) -> DataFrame:
        asked = self.embedded.join(ids, "id", "left_semi")
        return vectors.knn(self.embedded, asked, "id", "vector", k, threshold)

    def matching_patterns(self, threshold: float = 0.8, at_most: int = 5) -> DataFrame:
        return prediction.map_to_patterns(self.events.select("event_id", "event_type"), self.patterns, "event_id", "pattern", threshold, at_most)

    def chains(self, by: str = "user_id") -> DataFrame:
        return sequences.temporal_span(self.events, [by], "ts")

    def extract_patterns(self, by: str = "user_id", min_support: int = 2) -> DataFrame:
        return sequences.mine_sequences(self.events, [by], ["ts", "event_id"], "event_type", (2, 3), min_support)

    def process(self, what: str, **how) -> DataFrame:
        """A request by its name: retrieval, enhancement, pattern_discovery or comprehensive (patterns and their matches)."""
        match what:
            case "retrieval":
                return self.query_events(**how)
            case "enhancement":
                return prediction.infer_attribute(self.events, **how)
            case "pattern_discovery":
                return self.extract_patterns(**how)
            case "comprehensive":
                return self.matching_patterns(**how).groupBy("pattern").agg(F.count(F.lit(1)).alias("events"))
        raise ValueError(f"unknown request {what}")

    def together(self, size: int = 2) -> DataFrame:
        return mining.type_combinations(self.events, "user_id", "event_type", size)
