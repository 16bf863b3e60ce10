"""A table's own columns, set aside while an operator works.

The columns of the input are numbered, so that no name of the operator's can meet one of them, and have their
names again afterwards.  A column that the operator adds takes the place of an input column of the same name;
names are compared without case, as Spark does by default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Aside:
    """``rows`` is the table with numbered columns; ``of`` is the number of a column, ``back`` gives names back."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.numbers = [f"in_{i}" for i in range(len(self.names))]
        self.rows = df.toDF(*self.numbers)

    def of(self, name: str) -> str:
        alike = [n for n in self.names if n == name] or [n for n in self.names if n.lower() == name.lower()]
        if not alike:
            raise ValueError(f"the table has no column {name}")
        return self.numbers[self.names.index(alike[0])]

    def back(self, df: DataFrame, *added: str) -> DataFrame:
        """The input's columns under their names, then the added ones."""
        taken = {a.lower() for a in added}
        own = [F.col(number).alias(name) for number, name in zip(self.numbers, self.names, strict=True) if name.lower() not in taken]
        return df.select(*own, *added)
