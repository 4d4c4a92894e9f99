"""Arrow UDFs that are made when they are used: importing the library needs no session."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(f: Callable, kind: str) -> Callable[..., Column]:
    def apply(*columns: Column) -> Column:
        return F.udf(f, kind, useArrow=True)(*columns)

    return apply
