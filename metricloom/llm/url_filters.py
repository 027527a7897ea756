"""URL rules by a sort-merge range join: a sorted sweep that keeps the stack of nested rules.

A rule (host, path) becomes the interval of all keys that start with its own key, the reversed host, a slash and the
path. A page has one key for each of its host's suffixes that any rule names. Rules and page keys are sorted together;
at each page key the stack of the rule last begun holds every rule that can still be open, and the deepest one that the
key starts with is the page's rule for that suffix. The longest over all suffixes wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import lower_ascii, saved


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per distinct (host, path): its key, and the stack of rules open where it begins, itself last.

    Of two verdicts for one (host, path), block holds. Prefixes are looked up by the lengths that occur, so no pairs of
    rules of a host are formed.
    """
    own = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
           .groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
           .withColumn("key", F.concat(_reversed(F.col("host")), F.lit("/"), F.col("path"))))
    lengths = own.agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))
    prefixes = own.withColumn("lengths", lengths.scalar()).select(
        "host", "key", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"), "path")
    outer = own.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.struct(
        F.length("path").alias("n"), F.col("key"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"), F.col("verdict")).alias("open"))
    return (prefixes.join(outer, (F.col("host") == F.col("_host"))
                          & (F.expr("substring(path, 1, n)") == F.col("_path")))
            .groupBy("key").agg(F.first("host").alias("host"), F.array_sort(F.collect_list("open")).alias("stack")))


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id",
                default: str = "allow") -> DataFrame:
    """Judge every row's url: page_id, host, path, rule (null without one), verdict (the rule's, else ``default``).

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest host plus path wins,
    of equally long ones the longer host, then block. A null url, or one without ``://``, has an empty host and path
    and no rule. Repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
    """
    stacks = saved(rule_stacks(rules), "rule-stacks")
    depth = stacks.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    # Suffixes longer than any rule's host can't match; the empty suffix keeps every page in the sweep once.
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, max(depth, 1))
    suffixes = F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, 1, i))))
    points = (pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"),
                           host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
              .withColumn("suffix", F.explode(F.array_distinct(suffixes))))
    named = stacks.select(_reversed(F.col("host")).alias("suffix")).distinct()
    points = points.where("suffix = ''").unionByName(points.where("suffix <> ''").join(named, "suffix", "left_semi"))
    points = points.select("row", "page_id", "host", "path", F.when(
        F.col("suffix") != "", F.concat("suffix", F.lit("/"), "path")).otherwise("").alias("key"))

    begins = stacks.select("key", "stack").withColumn("row", F.lit(-1).cast("long"))
    # A hot key is cut by row number, so one host or url never fills a task.
    swept = saved(begins.unionByName(points, allowMissingColumns=True).repartitionByRange("key", "row")
                  .withColumn("task", F.spark_partition_id()), "url-sweep")
    last = swept.where("stack IS NOT NULL").groupBy("task").agg(F.max_by("stack", "key").alias("stack"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task at most
    carried = (swept.select("task").distinct().join(last, "task", "left")
               .select("task", F.last("stack", ignorenulls=True).over(before).alias("carried")))
    so_far = Window.partitionBy("task").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    opened = (swept.join(carried, "task")
              .withColumn("open", F.coalesce(F.last("stack", ignorenulls=True).over(so_far), "carried"))
              .where("row >= 0")
              .withColumn("hit", F.try_element_at(
                  F.filter("open", lambda r: F.startswith("key", r["key"])), F.lit(-1))))
    best = F.max(F.when(F.col("hit").isNotNull(), F.struct(
        F.length("hit.rule").alias("n"), F.col("hit.host_length").alias("m"), F.col("hit.verdict").alias("verdict"),
        F.col("hit.rule").alias("rule")))).alias("best")
    return (opened.groupBy("row", "page_id", "host", "path").agg(best)
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
