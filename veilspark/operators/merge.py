"""Entities of several methods made one: overlap groups, exact repeats, base types, names, neighbours.

The levels are windows over a document's spans in order, each a pass with the open group as its state: one sort, no pairs.

1. A group is a run of spans each of which overlaps an earlier one of it.
2. Of spans equal in extent, type and text the best-scored stays.
3. In a group of several, spans of one base type (before the first '_') that overlap become one: the union's extent, the
   best-scored one's type, all methods. Persons and names become one PERSON, whose score rises with methods and parts.
4. Neighbours that may be parts of one entity join: the first's type, the best score, the methods in order.

Defined results: spans without positions go; ties go to the earlier span, then the smaller type; a null score counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far apart parts of an entity may be.
GAP = 3


def _runs(rows: DataFrame, keys: list[str], fresh: Column, name: str, *order: str) -> DataFrame:
    """`rows` with the number of their run in column `name`; `fresh`: whether a row begins one."""
    return rows.withColumn(name, F.sum(F.when(fresh, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def _reach(keys: list[str], *order: str) -> Column:
    """The furthest end before a row."""
    return F.max("end").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def grouped(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exact repeats once, with `group`, the number of the overlap group, and `members`, how many different spans it has."""
    rows = entities.where("start < end").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = F.min_by("method", F.struct((-F.col("score")).alias("n"), "method")).alias("method")
    rows = rows.groupBy(key, "start", "end", "type", "text").agg(F.max("score").alias("score"), best)
    order = ("start", "end", "type", "text")
    reach = _reach([key], *order)
    rows = rows.withColumn("__reach", reach)
    rows = _runs(rows, [key], F.col("__reach").isNull() | (F.col("start") >= F.col("__reach")), "group", *order)
    return rows.withColumn("members", F.count("*").over(Window.partitionBy(key, "group"))).drop("__reach")


def merged_types(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Levels 1 to 3: (key, start, end, type, score, method)."""
    rows = grouped(entities, key).withColumn("base", F.substring_index("type", "_", 1))
    keys = [key, "group", "base"]
    rows = rows.withColumn("alike", F.count("*").over(Window.partitionBy(*keys)))
    name = (F.col("base") == "PERSON") | F.col("base").contains("NAME")
    order = ("start", "end", "type", "text")
    rows = rows.withColumn("name", name & (F.col("members") > 1) & (F.col("alike") > 1)).withColumn("__reach", _reach(keys, *order))
    rows = _runs(rows, keys, F.col("__reach").isNull() | (~F.col("name") & (F.col("start") >= F.col("__reach"))), "part", *order)
    top = F.struct("score", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))
    out = rows.groupBy(*keys, "part").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max_by(F.struct("type", "end"), F.struct("start", "end")).alias("last"),
        F.min_by("type", F.struct((-F.col("score")).alias("n"), "start", "end", "type")).alias("type"),
        F.max(top)["score"].alias("best"),
        F.array_sort(F.collect_set("method")).alias("methods"),
        F.count("*").alias("parts"),
        F.first("name").alias("name"),
    )
    raised = F.least(F.lit(1.0), F.col("best") + F.size("methods") * F.lit(0.1) + F.least(F.lit(0.1), F.col("parts") * F.lit(0.05)))
    return out.select(
        key,
        "start",
        F.when(F.col("name"), F.col("last.end")).otherwise(F.col("end")).alias("end"),
        F.when(F.col("name"), "PERSON").otherwise(F.col("type")).alias("type"),
        F.when(F.col("name"), raised).otherwise(F.col("best")).alias("score"),
        F.array_join("methods", "+").alias("method"),
    )


def kin(kind: Column) -> Column:
    """What neighbours must have in common to be parts of one entity; null: nothing joins."""
    return F.when(kind.isin("PERSON", "AR_NAME", "ORGANIZATION", "DATE"), kind).when((kind == "LOCATION") | kind.contains("ADDRESS"), "PLACE")


def neighbours(rows: DataFrame, key: str = "doc_id", gap: int = GAP) -> DataFrame:
    """Level 4 on (key, start, end, type, score, method): a run of joining neighbours becomes one row.

    Phones join at any distance, persons follow a title at any. The end is the last part's.
    """
    order = ("start", "end", "type", "score", "method")
    w = Window.partitionBy(key).orderBy(*order)
    kind, last, last_end = F.col("type"), F.lag("type").over(w), F.lag("end").over(w)
    close = F.abs(F.col("start") - last_end) <= gap
    phones = ((last == "PHONE_NUMBER") & (kind == "PHONE_NUMBER")) | (last.endswith("_PHONE") & kind.endswith("_PHONE"))
    # what a row of persons goes back to: the type before the first of them
    head = F.last(F.when(kind != "PERSON", kind), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    titled = (kind == "PERSON") & (head == "TITLE") & last.isin("TITLE", "PERSON")
    joins = F.coalesce((close & (kin(last) == kin(kind))) | phones | titled, F.lit(False))
    rows = _runs(rows.withColumn("__joins", joins), [key], ~F.col("__joins"), "run", *order)
    parts = F.array_sort(F.collect_list(F.struct(*order)))
    out = rows.groupBy(key, "run").agg(parts.alias("parts"), F.max("score").alias("score"))
    tail = F.element_at("parts", -1)
    return out.select(key, F.col("parts")[0]["start"].alias("start"), tail["end"].alias("end"), F.col("parts")[0]["type"].alias("type"), "score", F.array_join(F.transform("parts", lambda p: p["method"]), "+").alias("method"))


def merged(entities: DataFrame, docs: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All levels: (key, start, end, type, score, method), and with `docs` the text at the extent."""
    out = neighbours(merged_types(entities, key), key)
    if docs is None:
        return out
    source = docs.select(key, F.col(text).alias("__text"))
    return out.join(source, key).withColumn("text", F.expr("substring(__text, start + 1, end - start)")).drop("__text")
