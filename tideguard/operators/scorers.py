"""Named scorers: models by name, loaded once per worker, run once per distinct text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.operators.funnel import score_distinct
from tideguard.operators.skew import salted_join

Model = Callable[[pd.Series], pd.DataFrame]


@dataclass(frozen=True)
class Scorer:
    """`load` makes the model, a function of a Series of texts; `schema` are its columns."""

    name: str
    load: Callable[[], Model]
    schema: str


SCORERS: dict[str, Scorer] = {}
# Of a Python worker, which runs many tasks one after the other.
_LOADED: dict[str, Any] = {}


def register(name: str, load: Callable[[], Model], schema: str) -> Scorer:
    """Makes a scorer known by name; the last one of a name counts."""
    SCORERS[name] = Scorer(name, load, schema)
    return SCORERS[name]


def loaded(scorer: Scorer) -> Model:
    """The scorer's model, loaded at its first use in this process."""
    if scorer.name not in _LOADED:
        _LOADED[scorer.name] = scorer.load()
    return _LOADED[scorer.name]


def scores(df: DataFrame, name: str, key: str = "key", text: str = "text") -> DataFrame:
    """`key` and the columns of scorer `name`, a row per distinct key with a text that is not blank."""
    scorer = SCORERS[name]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded(scorer)
        for batch in texts:
            yield model(batch)

    return score_distinct(df, run, scorer.schema, key, text)


def with_scores(
    df: DataFrame, name: str, key: str = "key", text: str = "text", spread: str = "content_id"
) -> DataFrame:
    """`df` with the scorer's columns, null where the text is blank; hot texts are spread."""
    return salted_join(df, scores(df, name, key, text), [key], F.col(spread))


def _load_shouting() -> Model:
    import re

    letters, capitals = re.compile("[^A-Za-z]"), re.compile("[^A-Z]")

    def shouting(texts: pd.Series) -> pd.DataFrame:
        n = texts.map(lambda t: len(letters.sub("", t)))
        big = texts.map(lambda t: len(capitals.sub("", t)))
        return pd.DataFrame({"n_letters": n.astype("int64"), "share": (big / n.where(n > 0, 1)).round(6)})

    return shouting


register("shouting", _load_shouting, "n_letters long, share double")
