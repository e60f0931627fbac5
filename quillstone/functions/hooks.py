"""Model calls as a hook: a function of rows to rows, run batch by batch; failures become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expr import first_of


def call(df: DataFrame, prompt: str, model: Callable[[str], str], keep: list[str], most_tokens: int = 8000) -> DataFrame:
    """keep, response, error: model on each prompt; what is too long for its context, or raises, is a row with an error."""
    from ..text.tokens import estimate

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def one(text: str) -> tuple[str | None, str | None]:
        if estimate(text) > most_tokens:
            return None, "prompt does not fit the context"
        try:
            return model(text), None
        except Exception as e:  # a failed call is a result
            return None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [one(t) for t in pdf["__p"]]
            yield pdf[keep].assign(response=[r for r, _ in out], error=[e for _, e in out])

    return df.select(*keep, F.col(prompt).alias("__p")).mapInPandas(run, f"{types}, response string, error string")


def stub(text: str) -> str:
    """A deterministic stand-in for a model."""
    import hashlib
    import json

    return json.dumps({"digest": hashlib.sha1(text.encode()).hexdigest()[:12], "length": len(text)})


def samples_needed(history, prompt_changed, spread, force):
    """Three if forced, without history or after a change of prompt; one where samples agreed within 0.5; else three."""
    return first_of((force, 3), (history.isNull() | prompt_changed, 3), (spread <= 0.5, 1), otherwise=3)
