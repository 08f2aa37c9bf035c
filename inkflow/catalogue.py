"""The catalogue of the reference operators' queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkflow.plans import books, contexts, control, detection, documents, drafts, events, manuscripts, pages, relational, storage, validation
from inkflow.streaming import expiry, streams


def _all() -> dict:
    return {**pages.CATALOGUE, **documents.CATALOGUE, **relational.CATALOGUE, **events.CATALOGUE, **streams.CATALOGUE, **drafts.CATALOGUE, **expiry.CATALOGUE, **validation.CATALOGUE, **manuscripts.CATALOGUE, **storage.CATALOGUE, **control.CATALOGUE, **books.CATALOGUE, **detection.CATALOGUE, **contexts.CATALOGUE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
