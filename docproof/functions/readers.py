"""The model-backed reader as an extension point: prompts, backends chosen by name and checked before any work, and their answers."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Ask = Callable[[str], str]
BACKENDS = ("none", "local", "command", "api")
LOOPBACK = ("localhost", "127.0.0.1", "::1")
MOST_SOURCE = 60_000


def prompt(proposition: Column, signal: Column, source: Column, most: int = MOST_SOURCE) -> Column:
    """The question put to a reader; the source is cut to the reader's limit."""
    return F.concat(
        F.lit("Does the opinion support the proposition? Answer in JSON.\nSignal: "), F.coalesce(signal, F.lit("none")),
        F.lit("\nProposition: "), proposition, F.lit("\nOpinion:\n"), F.left(source, F.lit(most)),
    )


def backend(name: str, address: str | None = None, ask: Ask | None = None) -> Ask | None:
    """The callable of a backend, or None for "none". Wrong settings fail here, before any work; a local backend must be on this machine."""
    if name not in BACKENDS:
        raise ValueError(f"unknown reader {name!r}; known are {', '.join(BACKENDS)}")
    if name == "none":
        return None
    if name == "local" and urlsplit(address or "").hostname not in LOOPBACK:
        raise ValueError(f"a local reader must be on this machine, not at {address!r}")
    if ask is None:
        raise ValueError(f"the reader {name!r} needs a callable that asks it")
    return ask


def reading(ask: Ask | None, question: Column) -> Column:
    """The replies, in Arrow batches; null without a reader or where it fails, which is never a verdict."""
    if ask is None:
        return F.lit(None).cast("string")

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else ask(text)
        except Exception:  # noqa: BLE001 - whatever a backend raises, a missing reading says nothing
            return None

    @F.pandas_udf(StringType())
    def replies(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return replies(question)
