"""Flat facts from Python source: the rows that a repository's relations are derived from."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: One row per fact; the columns that a family does not use are null.
SCHEMA = "family string, file string, line int, column int, fqn string, name string, owner string, target string, detail string, flag boolean"


def extract(files: DataFrame, file: str = "file", source: str = "source") -> DataFrame:
    """Facts of all files (a null source counts as empty): the flat view of the families that an index holds."""
    from ..plans.index import Index

    return Index.of_sources(files, file, source).flat()
