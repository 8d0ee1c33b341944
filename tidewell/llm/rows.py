"""Documents whose rows have a number of their own, so that nothing hangs on doc_id being
unique, present or the only column of its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize

#: Stands for a null doc_id, which so comes first.
NULL_ID = -(2**63)


def place(columns: list[str], name: str) -> int:
    """The position of a column: of the exact name, else in other case."""
    if name in columns:
        return columns.index(name)
    found = [i for i, c in enumerate(columns) if c.lower() == name]
    if not found:
        raise ValueError(f"no column {name}")
    return found[0]


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """(row, id, c0, c1, ...): ``docs`` written once with a number for each row; the other
    columns go by their position, so no name can clash. The number stays the same however
    often a task is run again, as it is read from the written table."""
    at = place(docs.columns, "doc_id")
    moved = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key = F.coalesce(F.col(f"c{at}").cast("long"), F.lit(NULL_ID))
    return materialize(moved.select(F.monotonically_increasing_id().alias("row"), key.alias("id"), "*"), label)


def restored(rows: DataFrame, columns: list[str], text: Column, added: dict[str, Column]) -> DataFrame:
    """The columns ``columns`` of numbered rows with ``text`` in place of the text, then
    ``added``; columns of the same name as an added one, in any case, are replaced by it."""
    own = place(columns, "text")
    kept = [i for i, c in enumerate(columns) if c.lower() not in added]
    out = rows.select(
        *[(text if i == own else F.col(f"c{i}")).alias(f"c{i}") for i in kept],
        *[c.alias(f"added{i}") for i, c in enumerate(added.values())],
    )
    return out.toDF(*[columns[i] for i in kept], *added)
