"""Table changes as pure functions: (current rows, change rows) to new rows. Callers write the result to a new path.

Keys of a change table must be unique (check with ``validate.duplicate_keys``), as for any MERGE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.grouping import dense_ids, first_per_key


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Append source rows whose key is new; repeated keys inside the source keep their first row by
    ``order`` (by their other columns if none is given).

    A NULL in the key never collides, as in a SQL unique constraint.
    """
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    rest = [F.col(c) for c in source.columns if c not in keys]
    whole = first_per_key(source.filter(complete), keys, order or rest or [F.lit(1)])
    fresh = whole.join(target.select(*keys), keys, "left_anti").unionByName(source.filter(~complete))
    return target.unionByName(fresh.select(*[c for c in target.columns if c in fresh.columns]), allowMissingColumns=True)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    insert_only: dict[str, Column] | None = None,
    touched: dict[str, Column] | None = None,
) -> DataFrame:
    """Update matching rows with the source's non-key columns, insert the others, keep the rest.

    ``insert_only`` columns get their value on insert and never change; ``touched`` columns get theirs on insert and
    update. Target columns the source lacks keep their value (NULL on insert).
    """
    insert_only, touched = insert_only or {}, touched or {}
    here, there = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    both = here.join(there, keys, "full_outer")
    columns = []
    for c in target.columns:
        if c in keys:
            value = F.col(c)
        elif c in touched:
            value = F.when(F.col("_s"), touched[c]).otherwise(F.col(f"t.{c}"))
        elif c in insert_only:
            value = F.when(F.col("_t"), F.col(f"t.{c}")).otherwise(insert_only[c])
        elif c in source.columns:
            value = F.when(F.col("_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
        else:
            value = F.col(f"t.{c}")
        columns.append(value.alias(c))
    return both.select(*columns)


def number_new(target: DataFrame, source: DataFrame, natural_key: list[str], id_col: str) -> DataFrame:
    """Source rows with an unseen natural key, one per key, under new ids that continue after the largest one."""
    rest = [F.col(c) for c in source.columns if c not in natural_key]
    fresh = source.join(target.select(*natural_key), natural_key, "left_anti")
    fresh = first_per_key(fresh, natural_key, rest or [F.lit(1)])
    top = target.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).scalar()
    return dense_ids(fresh, natural_key, id_col, start=top + 1)


def insert_new(target: DataFrame, source: DataFrame, natural_key: list[str], id_col: str) -> DataFrame:
    """Append the source rows with an unseen natural key; known rows are never changed."""
    return target.unionByName(number_new(target, source, natural_key, id_col), allowMissingColumns=True)


def fill_missing(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Update only the columns that are still NULL, from matching source rows."""
    patch = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(patch, keys, "left")
    return joined.select(*[F.coalesce(c, f"_new_{c}").alias(c) if c in columns else F.col(c) for c in target.columns])


def patch_fields(target: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Partial update: non-NULL patch fields overwrite, everything else stays."""
    fields = [c for c in patches.columns if c not in keys]
    patch = patches.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = target.join(patch, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in target.columns])


def replace_children(children: DataFrame, new_children: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """Drop all children of the listed parents and add the new ones (a listed parent may end up with none)."""
    listed = parents.select(parent_key)
    kept = children.join(listed, parent_key, "left_anti")
    return kept.unionByName(new_children.join(listed, parent_key, "left_semi"))


def delete_keys(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys.select(*on), on, "left_anti")


def null_out(rows: DataFrame, reference: DataFrame, column: str, key: str) -> DataFrame:
    """Set a reference column to NULL where the referenced row does not exist; the row itself stays."""
    known = reference.select(F.col(key).alias("_known")).dropDuplicates()
    joined = rows.join(known, F.col(column) == F.col("_known"), "left")
    return joined.withColumn(column, F.col("_known")).drop("_known")


def cascade_delete(parents: DataFrame, deleted: DataFrame, key: str, **children: DataFrame) -> dict[str, DataFrame]:
    """Parents without the deleted keys, and each child table without the rows that hung on them."""
    gone = deleted.select(key)
    out = {"parents": parents.join(gone, key, "left_anti")}
    out.update({name: child.join(gone, key, "left_anti") for name, child in children.items()})
    return out


def blocked_by(candidates: DataFrame, users: DataFrame, key: str, user_key: str) -> DataFrame:
    """Delete guard: the candidate keys that some other row still uses."""
    return candidates.join(users.select(F.col(user_key).alias(key)), key, "left_semi")
