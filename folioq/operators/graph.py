"""Relationship graphs and location hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioq.operators.merge import first_rows
from folioq.operators.recurse import kept

LOCATED = "位于"


def edges(relations: DataFrame, seq: str = "seq") -> DataFrame:
    """Relations (source, target, label) without loops and blanks, each once."""
    kept = relations.where("trim(source) <> '' AND trim(target) <> '' AND source <> target")
    return first_rows(kept, ["source", "target", "label"], [seq])


def nodes(kinds: list[tuple[DataFrame, str, str, str]], seq: str = "seq") -> DataFrame:
    """(id, label, kind, detail): tables in order of precedence, each (rows, column of the name, kind, column of the detail)."""
    parts = [d.select(F.col(name).alias("id"), F.col(name).alias("label"), F.lit(kind).alias("kind"), F.col(detail).alias("detail"), F.lit(k).alias("_t"), F.col(seq).alias("_s")) for k, (d, name, kind, detail) in enumerate(kinds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_rows(out.where("trim(id) <> ''"), ["id"], ["_t", "_s"]).drop("_t", "_s")


def degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def neighbours(links: DataFrame, node: str) -> DataFrame:
    """Nodes that share an edge with one."""
    away = F.when(F.col("source") == node, F.col("target")).when(F.col("target") == node, F.col("source"))
    return links.select(away.alias("id")).where("id IS NOT NULL").distinct()


def hierarchy(rows: DataFrame, key: str = "name", parent: str = "parent") -> DataFrame:
    """(name, parent, depth, path) from the roots down; a row whose parent is missing is a root, rows on a cycle are left out.

    A round joins the rows to the level above, and leaves out those that their path has already. It ends with a level of
    none, so no depth is too much; each level is written to the shared folder.
    """
    all_ = kept(rows.select(F.col(key).alias("name"), F.col(parent).alias("parent")), "places")
    names = all_.select(F.col("name").alias("parent")).distinct()
    level = kept(all_.join(names, "parent", "left_anti").select("name", "parent", F.lit(0).alias("depth"), F.array("name").alias("path")), "level")
    out = level
    while not level.isEmpty():
        above = level.select(F.col("name").alias("parent"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
        below = all_.join(above, "parent").where(~F.array_contains("_p", F.col("name")))
        level = kept(below.select("name", "parent", (F.col("_d") + 1).alias("depth"), F.concat("_p", F.array("name")).alias("path")), "level")
        out = out.unionByName(level)
    return out.select("name", "parent", "depth", F.array_join("path", "/").alias("path"))
