"""Upserts without a table format: a snapshot joined with changes gives the next snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def newest(old: Column, new: Column) -> Column:
    """The new value where there is one."""
    return F.coalesce(new, old)


def always(old: Column, new: Column) -> Column:
    """The new value, even if null."""
    return new


def keep(old: Column, new: Column) -> Column:
    """The old value where there is one."""
    return F.coalesce(old, new)


def credits_rule(old: Column, new: Column) -> Column:
    """New credits unless they are 3, which stands for unspecified."""
    return F.when(new.isNotNull() & (new != 3), new).otherwise(F.coalesce(old, new))


def source_rule(old: Column, new: Column) -> Column:
    """A real source stays; anything replaces a seeded or missing one."""
    return F.when(old.isin("pipeline", "upload"), old).otherwise(F.coalesce(new, old))


def merge_upsert(target: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, Rule]) -> DataFrame:
    """The next snapshot: rows only in the target stay, rows only in the changes come in, others follow the rules.

    One full outer join on the keys, in which a null is a key like any other; applying the same changes again changes
    nothing as long as the rules are idempotent. ``changes`` has one row per key (see ``last_by_key``): a key that is
    changed twice fails the job that reads the result.
    """
    rest = [c for c in changes.columns if c not in keys]
    # Structs are equal where both have a null, and rows that are grouped by one needn't be dealt again to be joined on it.
    told = changes.groupBy(F.struct(*keys).alias("key")).agg(F.count("*").alias("told"), F.any_value(F.struct(F.lit(1).alias("told"), *rest)).alias("new"))
    t = target.select(F.struct(*keys).alias("old_key"), F.struct(F.lit(1).alias("there"), *target.columns).alias("old"))
    both = t.join(told, F.col("old_key") == F.col("key"), "full_outer")
    once = F.when(F.col("told") > 1, F.raise_error(F.lit("a key is changed more than once")).cast("boolean")).otherwise(F.col("told").isNotNull())
    both = both.withColumns({"is_told": once, "was": F.col("old").isNotNull()})
    out = [F.when(F.col("is_told"), F.col("key")[k]).otherwise(F.col("old_key")[k]).cast(target.schema[k].dataType).alias(k) for k in keys]
    for name in target.columns:
        if name not in keys:
            old, new = F.col("old")[name], F.col("new")[name] if name in rest else F.lit(None)
            merged = F.when(~F.col("was"), new).when(F.col("is_told"), rules.get(name, newest)(old, new)).otherwise(old)
            out.append(merged.cast(target.schema[name].dataType).alias(name))
    return both.select(*out)


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` for each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def refresh_affected(results: DataFrame, affected: DataFrame, compute: Callable[[DataFrame], DataFrame], aggregates: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates with only the affected keys computed again."""
    fresh = compute(results.join(affected.select(*keys).distinct(), keys, "left_semi"))
    return aggregates.join(affected.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
