"""Deletes that follow declared foreign keys, and an audit of rows that break them.

The schema declares its keys once (``FOREIGN_KEYS``); a delete names rows of any table, and the
planner walks the graph of keys from parents to children, so a new table or key needs no new
delete code. Every table is read once: one pass flags its rows by the doomed ids of all its
parents, and only ids of tables that have children of their own are passed on. Null references
point nowhere and are never cascaded. Ids reach a table as a semi-join side that Spark
broadcasts if it is small by size.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str = "id"


FOREIGN_KEYS = (
    ForeignKey("story", "subreddit", "subreddit"),
    ForeignKey("story_history", "story", "story"),
    ForeignKey("subreddit_history", "subreddit", "subreddit"),
)


def delete_order(tables: Iterable[str], keys: Iterable[ForeignKey] = FOREIGN_KEYS) -> list[str]:
    """The tables, every parent before its children; a cycle of keys is an error."""
    graph = {t: set() for t in tables}
    for k in keys:
        if k.child in graph and k.parent in graph:
            graph[k.child].add(k.parent)
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as exc:
        raise ValueError(f"foreign keys form a cycle: {' -> '.join(exc.args[1])}") from exc


def flagged(tables: dict[str, DataFrame], doomed: dict[str, DataFrame],
            keys: Iterable[ForeignKey] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """Every table with _gone: whether a delete of the ``doomed`` ids (table → frame with ``id``) takes the row.

    Tables without an ``id`` can be children, not roots. Repeated and unknown ids change nothing.
    """
    keys = [k for k in keys if k.child in tables and k.parent in tables]
    out: dict[str, DataFrame] = {}
    for name in delete_order(tables, keys):
        rows, hits = tables[name], []
        sides = [(doomed[name].select("id"), "id")] if name in doomed else []
        sides += [(out[k.parent].filter("_gone").select(F.col(k.parent_column).alias("id")), k.column)
                  for k in keys if k.child == name and "_gone" in out[k.parent].columns]
        for n, (ids, column) in enumerate(sides):
            known = ids.distinct().select(F.col("id").alias(f"_id{n}"), F.lit(True).alias(f"_hit{n}"))
            rows = rows.join(known, F.col(f"`{column}`") == F.col(f"_id{n}"), "left")
            hits.append(F.col(f"_hit{n}").isNotNull())
        gone = reduce(lambda a, b: a | b, hits) if hits else F.lit(False)
        out[name] = rows.select(*[F.col(f"`{c}`") for c in tables[name].columns], gone.alias("_gone"))
    return out


def cascade(tables: dict[str, DataFrame], doomed: dict[str, DataFrame],
            keys: Iterable[ForeignKey] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """What is left of every table after deleting ``doomed`` and all that refers to it."""
    return {name: rows.filter(~F.col("_gone")).drop("_gone") for name, rows in flagged(tables, doomed, keys).items()}


def orphans(tables: dict[str, DataFrame], keys: Iterable[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """(child, column, parent, references, orphans): for each key, how many rows refer to a missing parent.

    References are reduced to distinct values with their counts before the join, so a parent
    that a third of the rows refer to is one row of it. Keys whose tables are not given are left out.
    """
    parts = []
    for k in keys:
        if k.child not in tables or k.parent not in tables:
            continue
        refs = (tables[k.child].select(F.col(f"`{k.column}`").alias("_ref")).filter(F.col("_ref").isNotNull())
                .groupBy("_ref").agg(F.count(F.lit(1)).alias("_n")))
        known = tables[k.parent].select(F.col(f"`{k.parent_column}`").alias("_ref")).distinct().withColumn("_known", F.lit(True))
        held = refs.join(known, "_ref", "left").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("references"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"))
        parts.append(held.select(F.lit(k.child).alias("child"), F.lit(k.column).alias("column"),
                                 F.lit(k.parent).alias("parent"), "references", "orphans"))
    if not parts:
        raise ValueError("none of the keys has both its tables")
    return reduce(DataFrame.unionByName, parts)
