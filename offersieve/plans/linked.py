"""Suppression of tables that share totals, so that no hidden number can be computed from the published ones.

A cross table with its margins and their total is a circulation: the total flows to the rows, through the cells to the
columns, and back.  What is published stands fixed; a hidden number can be another one if and only if one unit more, or
less, can go round through hidden numbers alone (less only where something is left).  That is a search in a small graph,
and since flows of whole numbers stay whole it is exact: a number for which no way round exists is computable, whatever
chain of sums it takes.  While there is one, the smallest published number beside it is hidden, too.  A table of one
dimension is the same without cells between rows and columns.

Numbers of one place (its N and every other measure) are hidden together, and each measure is looked at on its own.  A
measure whose total is nought tells nothing that the total does not.  Places without a record are published as nought.

Tables are bounded before they come here: the first `top` keys of a dimension, and one for the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offersieve.operators.grouping import by_core, dimension
from offersieve.operators.metrics import status_counts

#: Places of one set of tables that are searched on the driver.
MAX_PLACES = 20_000
REST = "其他"
Place = tuple[str | None, str | None]


def _arc(place: Place) -> tuple[object, object]:
    """Where a place's number flows: total -> row -> column -> total."""
    row, column = place
    if row is None and column is None:
        return "end", "start"
    if column is None:
        return "start", ("row", row)
    return (("column", column), "end") if row is None else (("row", row), ("column", column))


def _reaches(begin: object, end: object, ways: Mapping[object, set[tuple[object, Place]]], without: Place) -> bool:
    seen, left = {begin}, [begin]
    while left:
        at = left.pop()
        if at == end:
            return True
        for to, place in ways.get(at, ()):
            if place != without and to not in seen:
                seen.add(to)
                left.append(to)
    return False


def computable(values: Mapping[Place, int], hidden: set[Place], arcs: Mapping[Place, tuple[object, object]]) -> set[Place]:
    """The hidden places whose value follows from all others that are published."""
    ways: dict[object, set[tuple[object, Place]]] = {}
    for p in hidden:
        tail, head = arcs[p]
        ways.setdefault(tail, set()).add((head, p))
        if values[p] > 0:
            ways.setdefault(head, set()).add((tail, p))
    out = set()
    for p in hidden:
        tail, head = arcs[p]
        more = _reaches(head, tail, ways, p)
        if not more and not (values[p] > 0 and _reaches(tail, head, ways, p)):
            out.add(p)
    return out


def protect(measures: Sequence[Mapping[Place, int]], least: int, single: bool = False) -> set[Place]:
    """Places to hide; measures[0] is N, whose places of 1 to least - 1 records go first. single: one dimension, of rows alone."""
    n = measures[0]
    if len(n) > MAX_PLACES:
        raise ValueError(f"{len(n)} places: publish fewer keys")
    arcs = {p: (("start", "end") if single and p != (None, None) else _arc(p)) for p in n}
    beside: dict[object, set[Place]] = {}
    for p, ends in arcs.items():
        for end in ends:
            beside.setdefault(end, set()).add(p)
    hidden = {p for p, v in n.items() if 0 < v < least}
    told = [m for m in measures if any(m.values())]
    while True:
        found = {p for m in told for p in computable(m, hidden, arcs)}
        if not found:
            return hidden
        p = min(found, key=lambda p: (n[p], str(p)))
        # A neighbour with something of a measure that is computable; else any that has records.
        open_ = [q for end in arcs[p] for q in beside[end] if q not in hidden and n[q] > 0]
        helps = [q for q in open_ if any(m[q] for m in told if p in computable(m, hidden, arcs))] or open_ or [q for q in n if q not in hidden and n[q] > 0]
        if not helps:
            return hidden
        hidden.add(min(helps, key=lambda q: (n[q], str(q))))


def _first_keys(records: DataFrame, key: Column, top: int) -> DataFrame:
    """(_key): the first `top` keys by D, N and key, ranked among those of one hash before they are ranked together."""
    sizes = records.groupBy(key.alias("key")).agg(F.count_if(F.col("offer_status").isin("已入职", "待入职", "拒绝offer", "拒绝口头offer")).alias("n_core"), F.count("*").alias("n_total"))
    part = Window.partitionBy(F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*by_core())
    some = sizes.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= top)
    return some.orderBy(*by_core()).limit(top).select(F.col("key").alias("_key"))


def _keyed(records: DataFrame, name: str, top: int, edges: Sequence[float], to: str) -> DataFrame:
    first = _first_keys(records, dimension(name, edges), top)
    return records.withColumn(to, dimension(name, edges)).join(F.broadcast(first), F.col(to) == F.col("_key"), "left").withColumn(to, F.coalesce("_key", F.lit(REST))).drop("_key")  # at most `top` rows


def linked_table(records: DataFrame, rows: str, columns: str | None = None, least: int = 5, top: int = 30, edges: Sequence[float] = ()) -> DataFrame:
    """(row_key, column_key, hidden, n_total, n_joined, ...): a publishable cross table with margins and total (null keys).

    Hidden places have null counts.  Without columns it is the table of one dimension.
    """
    keyed = _keyed(records, rows, top, edges, "row_key")
    keyed = keyed.withColumn("column_key", F.lit(None).cast("string")) if columns is None else _keyed(keyed, columns, top, edges, "column_key")
    counted = keyed.groupBy("row_key", "column_key", "offer_status").agg(F.count("*").alias("_n"))  # once, then all margins of it
    n = F.col("_n")
    cube = counted.rollup("row_key") if columns is None else counted.cube("row_key", "column_key")
    cells = [r.asDict() for r in cube.agg(*status_counts(n)).collect()]  # (top + 2) squared at most
    names = [k for k in cells[0] if k not in ("row_key", "column_key")] if cells else []
    at = lambda r: (r["row_key"], r.get("column_key"))
    measures = [{at(r): r[m] for r in cells} for m in ["n_total", *[x for x in names if x != "n_total"]]]
    hidden = protect(measures, least, columns is None) if cells else set()
    out = [(*at(r), at(r) in hidden, *[None if at(r) in hidden else r[m] for m in names]) for r in cells]
    schema = ", ".join(["row_key string", "column_key string", "hidden boolean", *[f"{m} long" for m in (names or ["n_total"])]])
    return records.sparkSession.createDataFrame(out, schema)
