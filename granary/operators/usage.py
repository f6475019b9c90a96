"""Operational analytics: counts, trends, distributions, roll-ups, quotas and pages of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with a count for each condition, in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def daily_trend(df: DataFrame, day: Column, last: str, days: int, **aggregates: Column) -> DataFrame:
    """A row for each of `days` days up to `last`, oldest first, zeros where there is nothing. Half open: a day is from its
    midnight to before the next."""
    spark = df.sparkSession
    end = F.to_date(F.lit(last))
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    daily = df.where((day >= F.date_sub(end, days - 1)) & (day <= end)).groupBy(day.alias("day")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return calendar.join(daily, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in aggregates]).orderBy("day")


def distribution(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def by_category(df: DataFrame, name: str, success: Column, categories: dict[str, str], default: str) -> DataFrame:
    """category, calls and successes, every category with a row."""
    spark = df.sparkSession
    known = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]) if categories else F.create_map()
    got = df.groupBy(F.coalesce(known[F.col(name)], F.lit(default)).alias("category")).agg(F.count("*").alias("calls"), F.count_if(success).alias("successes"))
    every = spark.createDataFrame([(c,) for c in sorted({*categories.values(), default})], "category string")
    return every.join(got, "category", "left").na.fill(0)


def usage_rollup(df: DataFrame, keys: list[str], **sums: str) -> DataFrame:
    """Sums and requests by key: what an accumulating upsert would hold."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count("*").alias("requests"))


def merge_usage(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two roll-ups as one."""
    values = [c for c in old.columns if c not in keys]
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def quota_status(usage: DataFrame, quotas: DataFrame, today: str) -> DataFrame:
    """user_id, used today and this month, and whether another request is allowed; a limit of -1 is none. usage: user_id, day,
    tokens, one row a request. quotas: user_id and the four limits."""
    end = F.to_date(F.lit(today))
    is_day, is_month = F.col("day") == end, F.trunc("day", "month") == F.trunc(end, "month")
    past = F.col("day") <= end
    used = usage.where(past & is_month).groupBy("user_id").agg(
        F.sum(F.when(is_day, F.col("tokens")).otherwise(0)).alias("day_tokens"), F.count_if(is_day).alias("day_requests"), F.sum("tokens").alias("month_tokens"), F.count("*").alias("month_requests")
    )
    within = lambda used, limit: (F.col(limit) == -1) | (F.col(used) < F.col(limit))
    joined = quotas.join(used, "user_id", "left").na.fill(0, ["day_tokens", "day_requests", "month_tokens", "month_requests"])
    ok = within("day_tokens", "daily_tokens") & within("month_tokens", "monthly_tokens") & within("day_requests", "daily_requests") & within("month_requests", "monthly_requests")
    return joined.select("user_id", "day_tokens", "day_requests", "month_tokens", "month_requests", ok.alias("allowed"))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page `number` (from 1) by an order that leaves no ties."""
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("pages are numbered from 1 and hold 1 to 1000 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    total = F.count("*")
    return df.agg(total.alias("total"), F.ceil(total / size).alias("pages")).withColumn("page", F.lit(number))


def log_filter(df: DataFrame, start: str | None = None, end: str | None = None, at: str = "ts", **equal: object) -> DataFrame:
    """Optional filters of a log: equal values, and whole days from start to end."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if start is not None:
        df = df.where(F.col(at) >= F.to_date(F.lit(start)))
    return df if end is None else df.where(F.col(at) < F.date_add(F.to_date(F.lit(end)), 1))


def keyword_search(df: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """Rows with the word in any of the columns, literally."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.col(c), F.lit(word)), F.lit(False))
    return df.where(found)


def latest_in_order(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key, oldest first (rank 1)."""
    ranked = df.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_back") <= n)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("_back")


def turns(messages: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Turn islands: each user message opens a turn; question, and the last assistant text as its summary. Messages before the
    first question are turn 0."""
    running = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turn = F.sum((F.col(role) == "user").cast("long")).over(running)
    user, answer = F.col(role) == "user", (F.col(role) == "assistant")
    return messages.withColumn("turn_no", turn).groupBy(key, "turn_no").agg(
        F.count("*").alias("messages"), F.min(F.when(user, F.col(text))).alias("question"), F.max_by(F.when(answer, F.col(text)), F.when(answer, F.col(order))).alias("summary")
    )
