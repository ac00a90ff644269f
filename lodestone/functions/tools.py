"""Tools as table functions: a named handler with checked arguments yields rows in an envelope of success, value and error."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

TEXT_CAP = 4000


def register(spark: SparkSession, name: str, handler: Callable[[str], Iterable[str]], replace: bool = False) -> None:
    """Make ``name(argument)`` a table function: (ok, rank, value, error); values are cut to ``TEXT_CAP`` characters.

    A blank or null argument and an error of the handler are rows that say so, never failures of the query.
    """
    if not replace and spark.catalog.functionExists(name):
        raise ValueError(f"tool {name} is registered already")

    class Tool:
        def eval(self, argument: str):
            if argument is None or not argument.strip():
                yield False, 0, None, "argument must be a non-empty string"
                return
            try:
                found = list(handler(argument))
            except Exception as x:
                yield False, 0, None, f"{type(x).__name__}: {x}"
                return
            for i, v in enumerate(found, 1):
                yield True, i, v[:TEXT_CAP], None

    spark.udtf.register(name, udtf(Tool, returnType="ok boolean, rank int, value string, error string"))
