"""Comparing two snapshots: changed files, changed entries of maps, sequences of lines, and counts of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import text as T


def changed_files(before: DataFrame, after: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, state and both contents of all keys whose contents differ or that only one side has."""
    b = before.select(F.col(key).alias("__b"), F.col(content).alias("before"))
    a = after.select(F.col(key).alias("__a"), F.col(content).alias("after"))
    both = b.join(a, F.col("__b") == F.col("__a"), "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    return both.select(F.coalesce("__b", "__a").alias(key), state.alias("state"), "before", "after")


def with_formatting(changed: DataFrame) -> DataFrame:
    """Adds whether both sides are equal but for white space."""
    same = F.col("before").isNotNull() & F.col("after").isNotNull() & (T.normalize(F.col("before")) == T.normalize(F.col("after")))
    return changed.withColumn("formatting_only", same)


def state_counts(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Counts of added, modified and removed rows, and their summary."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    out = nodes.groupBy(*by).agg(count("added"), count("modified"), count("removed"))
    return out.withColumn("summary", T.summary(F.col("added"), F.col("modified"), F.col("removed")))


def line_nodes(files: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each line, with its place from 0."""
    return files.select(key, F.posexplode(F.split(content, "\n", -1)).alias("ord", "line"))


def with_node_ids(nodes: DataFrame, file_id: str, parent: str, kind: str, name: str, order: str) -> DataFrame:
    """Ids of siblings; those that share kind and slug are told apart by a number in order."""
    slug = F.substring(F.regexp_replace(F.col(name), "[^A-Za-z0-9]", "_"), 1, 24)
    same = Window.partitionBy(file_id, parent, kind, "slug")
    out = nodes.withColumn("slug", slug)
    out = out.withColumn("n_same", F.count(F.lit(1)).over(same)).withColumn("ordinal", F.row_number().over(same.orderBy(order)) - 1)
    tail = F.when(F.col("n_same") > 1, F.concat(F.lit("#"), F.col("ordinal").cast("string"))).otherwise(F.lit(""))
    return out.withColumn("node_id", F.concat_ws(":", file_id, parent, kind, F.concat("slug", tail)))


def minus(kept: Column, taken: Column) -> Column:
    """The members of kept that taken lacks, repeated as often as they were."""
    return F.filter(kept, lambda x: ~F.array_contains(taken, x))


def times(values: Column, value: Column) -> Column:
    return F.size(F.filter(values, lambda x: x == value))


def entry_diff(before: DataFrame, after: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """keys, name, state, before, after of all entries that were added or removed or whose value changed."""
    b = before.select(*[F.col(k).alias(f"__b_{k}") for k in keys], F.col(name).alias("__b"), F.col(value).alias("before"))
    a = after.select(*[F.col(k).alias(f"__a_{k}") for k in keys], F.col(name).alias("__a"), F.col(value).alias("after"))
    on = [F.col("__b") == F.col("__a"), *[F.col(f"__b_{k}").eqNullSafe(F.col(f"__a_{k}")) for k in keys]]
    both = b.join(a, on, "full_outer")
    state = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    out = both.withColumn("state", state).where("state IS NOT NULL")
    return out.select(*[F.coalesce(f"__b_{k}", f"__a_{k}").alias(k) for k in keys], F.coalesce("__b", "__a").alias(name), "state", "before", "after")


def map_diff(before: Column, after: Column) -> Column:
    """The same over two maps of a row: an array of (name, state, before, after), by name."""
    zipped = F.map_entries(F.map_zip_with(before, after, lambda _, b, a: F.struct(b.alias("b"), a.alias("a"))))
    state = lambda x: F.when(x["value"]["b"].isNull(), "added").when(x["value"]["a"].isNull(), "removed").otherwise("modified")
    changed = F.filter(zipped, lambda x: ~x["value"]["b"].eqNullSafe(x["value"]["a"]))
    return F.array_sort(F.transform(changed, lambda x: F.struct(x["key"].alias("name"), state(x).alias("state"), x["value"]["b"].alias("before"), x["value"]["a"].alias("after"))))


def diff_block(before: Column, after: Column, state: Column, cap: int = 80) -> Column:
    """Both sides' lines with their signs, cap of each, and how many more there are."""

    def side(lines: Column, sign: str) -> Column:
        shown = F.transform(F.slice(lines, 1, cap), lambda x: F.concat(F.lit(f"{sign} "), x))
        over = F.size(lines) - cap
        more = F.concat(F.lit(f"{sign} … "), over.cast("string"), F.when(over == 1, F.lit(" more line")).otherwise(F.lit(" more lines")), F.lit(" (truncated)"))
        return F.when(over > 0, F.concat(shown, F.array(more))).otherwise(shown)

    none = F.array().cast("array<string>")
    old = F.when(state == "added", none).otherwise(side(F.coalesce(before, none), "-"))
    new = F.when(state == "removed", none).otherwise(side(F.coalesce(after, none), "+"))
    return F.array_join(F.concat(old, new), "\n")
