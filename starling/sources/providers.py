"""Lookups by text: annotators and gazetteers behind one interface.

A provider answers a table of questions with a table of answers, so that Spark joins them. ``Table`` holds answers
offline; ``Service`` asks for each different question once, in tasks, by a function of the caller's, and parses its JSON.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retry import Policy, counted, supervised


class Provider(Protocol):
    def answers(self, questions: DataFrame) -> DataFrame:
        """Of rows (query), rows (query, and what it is answered with), as many for each as there are hits."""


class Table:
    """Answers from a table with a ``query`` column; limit: the first hits by ``rank``."""

    def __init__(self, rows: DataFrame, limit: int | None = None) -> None:
        self.rows = rows if limit is None else rows.where(F.col("rank") <= limit)

    def answers(self, questions: DataFrame) -> DataFrame:
        return questions.select("query").where("query IS NOT NULL").distinct().join(self.rows, "query")


class Service:
    """Answers of a function from a question to a JSON text (an array of hits as in schema), or None if there is none.

    Each different question is asked once for each run of its task, and tried again as the policy says.
    """

    def __init__(self, ask: Callable[[str], str | None], schema: str, policy: Policy = counted, partitions: int = 8) -> None:
        self.ask, self.schema, self.policy, self.partitions = ask, schema, policy, partitions

    def answers(self, questions: DataFrame) -> DataFrame:
        ask, policy = self.ask, self.policy

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(answer=[supervised(lambda q=q: ask(q), {OSError: policy}) for q in f["query"]])

        asked = questions.select("query").where("query IS NOT NULL").distinct().repartition(self.partitions, "query").mapInPandas(run, "query string, answer string")
        hits = asked.select("query", F.posexplode(F.from_json("answer", f"array<struct<{self.schema}>>")).alias("at", "hit"))
        return hits.select("query", (F.col("at") + 1).alias("rank"), "hit.*")
