"""Arrays built from optional items."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def optional(cond: Column, item: Column) -> Column:
    """A one-item array when the condition holds, else an empty array.

    Concatenating these stays inside code generation, which filtering nulls out
    of an array with a lambda does not.
    """
    return F.when(cond, F.array(item)).otherwise(F.array())


def gather(items: list[Column], dtype: str) -> Column:
    """Concatenate optional items; see `optional`."""
    return F.concat(*[i.cast(dtype) for i in items])
