from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """A Column as is, a string as a column name, anything else a literal."""
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)
