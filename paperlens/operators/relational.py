"""Joins, counts, searches and patches over papers and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """parents with n_<name> rows of each child table; each child is counted before the join, so counts never multiply."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(f"n_{name}")), key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str], into: str = "children") -> DataFrame:
    """parents with an ordered array of their children, empty where there are none."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(into))
    return parents.join(lists, key, "left")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; partial aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return found.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The union of both with the last row of each key; of equal order the new one."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [*order, "_new"]).drop("_new")


def replaced(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base without the keys of new, and new: what deleting and inserting again leaves."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_per(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1, into: str = "rank") -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(into) <= n)


def filtered_children(parents: DataFrame, children: DataFrame, key: str, condition: Column | None) -> DataFrame:
    """parent key and matching children; without a condition parents without children stay."""
    if condition is None:
        return parents.select(key).join(children, key, "left")
    return parents.select(key).join(children.where(condition), key)


def contains_folded(text: Column, needle: str) -> Column:
    """ASCII case-insensitive substring search."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(text, upper, lower), F.lit(needle.translate(str.maketrans(upper, lower))))


def islands(rows: DataFrame, keys: list[str], order: list[Column], starts: Column, into: str = "island") -> DataFrame:
    """Numbers runs of rows: a row that satisfies `starts` begins the next one."""
    return rows.withColumn(into, F.sum(starts.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def carried(rows: DataFrame, keys: list[str], order: list[Column], tag: Column, into: str) -> DataFrame:
    """The last non-null tag up to each row."""
    return rows.withColumn(into, F.last(tag, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


#: Keys of a range in which rows are numbered together.
RANGE = 4_096


def numbered(rows: DataFrame, group: str, key: str, into: str = "place", total: str | None = None, span: int = RANGE) -> DataFrame:
    """rows (group, whole-number key, each pair once) with their place in the group from 0, and the group's size if `total` names it.
    A group is cut into ranges of the key: rows are numbered within a range and ranges start at a running sum of the
    counts before, so that a group that holds a third of all rows is no single task."""
    cut = rows.withColumn("_range", F.floor(F.col(key) / span).cast("long"))
    counts = cut.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")
    starts = counts.select(group, "_range", before.alias("_start"), F.sum("_n").over(Window.partitionBy(group)).alias("_total"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy(group, "_range").orderBy(key)) - 1
    out = cut.join(starts, [group, "_range"]).withColumn(into, place)
    return out.select(*rows.columns, into, *([F.col("_total").alias(total)] if total else []))


def acceptable(name: Column, kind: Column) -> Column:
    """Files that an upload takes, by ending or by type."""
    return F.lower(name).endswith(".pdf") | (kind == "application/pdf")


def enqueued(queue: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The queue and, of incoming rows, the first of each key that the queue does not have."""
    new = incoming.join(queue.select(*keys).distinct(), keys, "left_anti")
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("first")).select("first.*")
    return queue.unionByName(first)


def run_state(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, status, total, completed of each run. log: key, step, value, order columns. A step start sets the total and nothing completed, update sets
    what is completed, finish completes all, fail keeps what is completed. A run without a start is idle, with a total of 0. One pass
    of partial aggregates: the last step of three kinds says it all."""
    last = lambda what, *steps: F.max_by(F.when(F.col("step").isin(*steps), what), F.when(F.col("step").isin(*steps), F.struct(*order)))
    folded = log.groupBy(key).agg(
        F.coalesce(last(F.col("value"), "start"), F.lit(0)).alias("total"), last(F.struct("step", "value"), "start", "update", "finish").alias("moved"), last(F.col("step"), "start", "finish", "fail").alias("turned")
    )
    status = F.when(F.col("turned") == "start", "running").when(F.col("turned") == "finish", "finished").when(F.col("turned") == "fail", "failed").otherwise("idle")
    completed = F.when(F.col("moved.step") == "update", F.col("moved.value")).when(F.col("moved.step") == "finish", F.col("total")).otherwise(F.lit(0))
    return folded.select(key, status.alias("status"), "total", completed.alias("completed"))


def model_urls(base: Column) -> Column:
    """Where a provider with this base address (without a closing slash) may list its models, in order."""
    first = F.concat(base, F.lit("/models"))
    return F.when(base.rlike(r"(?i)/v1\z"), F.array(first)).otherwise(F.array(first, F.concat(base, F.lit("/v1/models"))))


def quoted_setting(value: Column) -> Column:
    inside = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), inside, F.lit('"'))


def settings_saved(lines: DataFrame, values: DataFrame) -> DataFrame:
    """env, line, text of settings files (env, line, text) with values (env, name, value): a line of a name that has a value is written
    anew, all others stay as they are, names without a line follow behind (line -1)."""
    named = lines.withColumn("name", F.nullif(F.regexp_extract("text", r"\A\s*([A-Za-z_][A-Za-z0-9_]*)\s*=", 1), F.lit("")))
    line = F.concat("name", F.lit("="), quoted_setting(F.col("value")))
    kept = named.join(values, ["env", "name"], "left").select("env", "line", F.when(F.col("value").isNotNull(), line).otherwise(F.col("text")).alias("text"))
    new = values.join(named.select("env", "name").distinct(), ["env", "name"], "left_anti")
    return kept.unionByName(new.select("env", F.lit(-1).cast(lines.schema["line"].dataType).alias("line"), line.alias("text")))
