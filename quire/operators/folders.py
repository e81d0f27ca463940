"""Folder lookup and get-or-create as joins (JN3, JN4, ST2).

The folder table is ``(id, name, parent_id, path)``; root folders have a null
parent. Lookup matches ``(name, parent_id)`` null-safely and takes the
smallest id when several folders match (D17). Get-or-create works level by
level (addressee, then sender under it): wanted names anti-joined with what
exists are created with a deterministic id derived from the names on the way,
each with its length, so a rerun creates nothing twice and names that hold a
slash keep folders of their own. A null top name makes no folder, a null sub
name none below the top folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDER_COLS = ["id", "name", "parent_id", "path"]


def new_folder_id(*names) -> Column:
    """Id of the folder reached through ``names``: their bytes, each name closed off by its length."""
    parts = [F.col(n) if isinstance(n, str) else n for n in names]
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def _first_ids(folders: DataFrame, out: str = "folder_id") -> DataFrame:
    """(name, parent_id) -> smallest id: the first match of a lookup (D17)."""
    return folders.groupBy("name", "parent_id").agg(F.min("id").alias(out))


def lookup_folder(wanted: DataFrame, folders: DataFrame, out: str = "folder_id", first: DataFrame | None = None) -> DataFrame:
    """JN3 + ST2: id of the first (smallest id) folder named ``name`` under ``parent_id``, or null."""
    f = (first if first is not None else _first_ids(folders, out)).alias("f")
    w = wanted.alias("w")
    cond = (F.col("w.name") == F.col("f.name")) & F.col("w.parent_id").eqNullSafe(F.col("f.parent_id"))
    return w.join(f, cond, "left").select("w.*", F.col(f"f.{out}").alias(out))


def get_or_create_folders(paths: DataFrame, folders: DataFrame, top: str = "addressed_to",
                          sub: str = "sender") -> DataFrame:
    """JN4: the folder table after ensuring ``top`` / ``sub`` folders exist for every row of ``paths``.

    One chain over the distinct paths: resolve the top folder (existing first
    id, else a new id from the path), then the sub folder under it, then emit
    each row's missing folders with one ``explode`` and ``distinct``. Both
    levels look up the same (name, parent) -> first-id aggregate of the
    existing table: a sub-folder cannot already exist under a parent created in
    this run (its id is new).
    """
    folders = folders.select(*FOLDER_COLS)
    first = _first_ids(folders)
    p = paths.select(F.col(top).alias("_top"), F.col(sub).alias("_sub")).filter("_top IS NOT NULL").distinct()
    l1 = lookup_folder(p.select("_top", "_sub", F.col("_top").alias("name"),
                                F.lit(None).cast("string").alias("parent_id")), None, first=first)
    l1 = l1.select("_top", "_sub", F.col("folder_id").isNull().alias("_new1"),
                   F.coalesce("folder_id", new_folder_id("_top")).alias("_id1"))
    path2 = F.concat_ws("/", F.col("_top"), F.col("_sub"))
    l2 = lookup_folder(l1.select("*", F.col("_sub").alias("name"), F.col("_id1").alias("parent_id")), None, first=first)
    l2 = l2.select("*", F.col("folder_id").isNull().alias("_new2"), new_folder_id("_top", "_sub").alias("_id2"),
                   path2.alias("_path2"))
    row = lambda i, n, par, pth: F.struct(i.alias("id"), n.alias("name"), par.alias("parent_id"), pth.alias("path"))
    created = (l2.select(F.explode(F.array(
                   F.when(F.col("_new1"), row(F.col("_id1"), F.col("_top"), F.lit(None).cast("string"), F.col("_top"))),
                   F.when(F.col("_new2") & F.col("_sub").isNotNull(), row(F.col("_id2"), F.col("_sub"), F.col("_id1"), F.col("_path2"))))).alias("f"))
               .filter(F.col("f").isNotNull()).select("f.*").distinct())
    return folders.unionByName(created)
