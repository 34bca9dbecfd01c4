"""Usage ledger: bills, savings, percentiles, limits and quotas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions.text import has_text, sha256_hex, token_estimate
from quarry.operators.skew import running
from quarry.session import cut

TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens")


def usage_between(usage: DataFrame, tenant_id: str | None = None, ts_from=None,
                  ts_to=None) -> DataFrame:
    """Rows of a tenant inside an inclusive time range; None leaves a bound open."""
    if tenant_id and tenant_id.strip():
        usage = usage.filter(F.col("tenant_id") == tenant_id)
    if ts_from is not None:
        usage = usage.filter(F.col("created_at") >= F.lit(ts_from))
    if ts_to is not None:
        usage = usage.filter(F.col("created_at") <= F.lit(ts_to))
    return usage


def _sums() -> list[Column]:
    tokens = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS]
    cost = F.coalesce(F.sum("estimated_cost"), F.lit(0)).cast("double").alias("estimated_cost")
    return [F.count(F.lit(1)).alias("calls"), *tokens, cost]


def usage_summary(usage: DataFrame, tenant_id: str | None = None, ts_from=None,
                  ts_to=None) -> DataFrame:
    """Bill per model and interface. Costs are summed as decimals and turned to double last."""
    rows = usage_between(usage, tenant_id, ts_from, ts_to)
    return rows.groupBy("model", "interface_name").agg(*_sums()).orderBy("model", "interface_name")


def usage_totals(usage: DataFrame, tenant_id: str | None = None, ts_from=None,
                 ts_to=None) -> DataFrame:
    """The bill with subtotals per model and a grand total; ``level`` is 0, 1 and 3."""
    rows = usage_between(usage, tenant_id, ts_from, ts_to)
    return rows.rollup("model", "interface_name").agg(F.grouping_id().alias("level"), *_sums())


def positive_or(value: Column | str, fallback: Column) -> Column:
    """The value when it is positive, else the fallback."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c > 0, c).otherwise(fallback)


def cost_rows(calls: DataFrame, rate: float = C.COST_PER_THOUSAND_TOKENS) -> DataFrame:
    """Ledger rows from raw calls: reported token counts, or estimates where they are missing.

    ``calls``: tier, model_name, instructions, message, answer, prompt_tokens, completion_tokens,
    total_tokens, cached_tokens; other columns pass through.
    """
    estimated_prompt = token_estimate("instructions") + token_estimate("message")
    model = F.concat(F.col("tier"), F.lit(":"), F.coalesce("model_name", F.lit("default")))
    cost = (F.col("total_tokens") / 1000.0 * rate).cast("decimal(18,6)")
    return (calls
            .withColumn("prompt_tokens", positive_or("prompt_tokens", estimated_prompt))
            .withColumn("completion_tokens",
                        positive_or("completion_tokens", token_estimate("answer")))
            .withColumn("total_tokens", positive_or(
                "total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))
            .withColumn("cached_tokens",
                        F.greatest(F.lit(0), F.coalesce("cached_tokens", F.lit(0))))
            .withColumn("estimated_cost", cost)
            .withColumn("model", model)
            .drop("tier", "model_name", "instructions", "message", "answer"))


def cache_savings(usage: DataFrame, by: Sequence[str]) -> DataFrame:
    """Prompt-cache effect per group; every ratio is 0 without prompt tokens."""
    prompt, cached = F.col("prompt_tokens"), F.col("cached_tokens")
    billed = (prompt - cached) + cached * C.CACHE_READ_WEIGHT
    return (usage.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce(F.sum("cached_tokens"), F.lit(0)).cast("long").alias("cached_tokens"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))
        .withColumn("hit_ratio", F.when(prompt > 0, cached / prompt).otherwise(0.0))
        .withColumn("billed_tokens", billed)
        .withColumn("saved_pct", F.when(prompt > 0, (1 - billed / prompt) * 100).otherwise(0.0)))


def cache_hit_ratio(cached: str = "cached_tokens", prompt: str = "prompt_tokens") -> Column:
    """Share of one call's prompt that was cached; null without prompt tokens."""
    return F.when(F.col(prompt) > 0, F.col(cached) / F.col(prompt))


def prefix_cacheability(calls: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Per distinct prompt prefix: calls, token estimate and whether it is long enough to cache."""
    counted = calls.groupBy(sha256_hex(prefix).alias("prefix_hash"),
                            token_estimate(prefix).alias("prefix_tokens")).agg(
        F.count(F.lit(1)).alias("calls"))
    return counted.withColumn("cacheable", F.col("prefix_tokens") >= C.CACHEABLE_PREFIX_TOKENS)


def latency_percentiles(df: DataFrame, by: Sequence[str], value: str,
                        quantiles: dict[str, float] | None = None) -> DataFrame:
    """Per group: n, avg and percentiles by the rank round(q * (n - 1)), half up.

    Equal values are counted before they are shuffled, and the running counts over the distinct
    values are built per value range, so neither many rows nor many values meet in one task.
    ``value`` must not be negative.
    """
    quantiles = quantiles or {"p50": 0.5, "p95": 0.95}
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.count(F.lit(1)).alias("__rows")))
    ranges = F.floor(F.log1p(F.col(value).cast("double")) * 16)
    cumulated = running(counts, by, [value], ranges, __upto=("sum", "__rows"))
    sizes = counts.groupBy(*by).agg(
        F.sum("__rows").alias("n"),
        (F.sum(F.col(value) * F.col("__rows")) / F.sum("__rows")).alias("avg"))
    keyed = cumulated.join(sizes, list(by))

    def at(q):
        index = F.least(F.col("n") - 1, F.floor(q * (F.col("n") - 1) + 0.5))
        return F.min(F.when(F.col("__upto") > index, F.col(value)))

    return keyed.groupBy(*by, "n", "avg").agg(*[at(q).alias(n) for n, q in quantiles.items()])


def dedup_rate(requests: DataFrame, text: str = "text") -> DataFrame:
    """Embedding-cache effect per model: requests, distinct texts, hits, tokens sent and saved.

    Copies are counted per text before they are shuffled.
    """
    tokens = F.when(has_text(text), F.greatest(
        F.lit(1).cast("long"), F.ceil(F.length(text) / 4.0))).otherwise(F.lit(0).cast("long"))
    per_text = (requests.groupBy("model", sha256_hex(text).alias("text_hash"), tokens.alias("size"))
                .agg(F.count(F.lit(1)).alias("copies")))
    return (per_text.groupBy("model").agg(
        F.sum("copies").alias("requests"), F.count(F.lit(1)).alias("distinct_texts"),
        F.sum("size").alias("tokens_sent"),
        F.sum(F.col("size") * (F.col("copies") - 1)).alias("tokens_saved"))
        .withColumn("hits", F.col("requests") - F.col("distinct_texts"))
        .withColumn("hit_rate", F.col("hits") / F.col("requests")))


def rate_limit(calls: DataFrame, max_per_minute: int = C.CALLS_PER_MINUTE) -> DataFrame:
    """Adds ``call_no`` within (user, interface, minute) and ``rejected``; rejected calls count.

    ``calls``: call_id, user_id, interface_name, ts. Seconds are the slices of a busy minute.
    """
    named = (calls.withColumn("__user", F.coalesce("user_id", F.lit("unknown")))
             .withColumn("minute", F.floor(F.unix_seconds("ts") / 60)))
    counted = running(named, ["__user", "interface_name", "minute"], ["ts", "call_id"],
                      F.unix_seconds("ts"), call_no=("row_number", None))
    return counted.withColumn("rejected", F.col("call_no") > max_per_minute).drop("__user")


def daily_call_cap(calls: DataFrame, max_calls: int = C.CALLS_PER_DAY,
                   zone: str = C.CALL_DAY_ZONE) -> DataFrame:
    """Adds the local ``day``, ``call_no`` within it over all callers, and ``admitted``."""
    local = calls.withColumn("day", F.to_date(F.from_utc_timestamp("ts", zone)))
    counted = running(local, ["day"], ["ts", "call_id"], F.floor(F.unix_seconds("ts") / 60),
                      call_no=("row_number", None))
    return counted.withColumn("admitted", F.col("call_no") <= max_calls)


def input_budget(calls: DataFrame, messages: DataFrame,
                 max_tokens: int = C.CHAT_MAX_INPUT_TOKENS) -> DataFrame:
    """Per call: estimated prompt tokens (instructions and all messages) and ``rejected``."""
    spoken = messages.groupBy("call_id").agg(F.sum(token_estimate("content")).alias("__messages"))
    prompt = token_estimate("instructions") + F.coalesce("__messages", F.lit(0))
    return (calls.join(spoken, "call_id", "left").withColumn("prompt_estimate", prompt.cast("long"))
            .withColumn("rejected", F.col("prompt_estimate") > max_tokens)
            .drop("__messages", "instructions"))


def token_quota(calls: DataFrame, user_quota: int = C.USER_DAILY_TOKENS,
                tenant_quota: int = C.TENANT_DAILY_TOKENS, rounds: int = 2) -> DataFrame:
    """Adds ``admitted`` under two daily budgets, spent in (ts, call_id) order.

    ``calls``: call_id, tenant_id, user_id, ts, need, charge. A call is admitted when what its user
    and its tenant have spent that day plus ``need`` stays within both budgets; an admitted call
    spends ``charge``, a rejected one nothing. A user belongs to one tenant.

    Spending depends on all earlier verdicts, but two running sums bound it: everything undecided
    spent (upper) and only surely admitted calls spent (lower). Calls that fit under the upper bound
    are admitted and calls that miss the lower one are rejected, in parallel over slices of the day.
    Each round decides more; what remains near the edge of a budget is walked in order, task by
    task, one Arrow batch at a time.
    """
    day = F.to_date("ts")
    rows = calls.select(
        "call_id", F.coalesce("tenant_id", F.lit("unknown")).alias("tenant"),
        F.coalesce("user_id", F.lit("unknown")).alias("user"), day.alias("day"), "ts",
        F.col("need").cast("long").alias("need"), F.col("charge").cast("long").alias("charge"),
        F.lit(None).cast("boolean").alias("admitted"))
    minute = F.floor(F.unix_seconds("ts") / 60)
    order = ["ts", "call_id"]
    for number in range(rounds):
        sure = F.when(F.col("admitted"), F.col("charge")).otherwise(0)
        open_ = F.when(F.coalesce("admitted", F.lit(True)), F.col("charge")).otherwise(0)
        rows = running(rows, ["tenant", "day"], order, minute,
                       tenant_low=("before", sure), tenant_high=("before", open_))
        rows = running(rows, ["tenant", "user", "day"], order, minute,
                       user_low=("before", sure), user_high=("before", open_))
        fits = ((F.col("user_high") + F.col("need") <= user_quota)
                & (F.col("tenant_high") + F.col("need") <= tenant_quota))
        misses = ((F.col("user_low") + F.col("need") > user_quota)
                  | (F.col("tenant_low") + F.col("need") > tenant_quota))
        verdict = (F.when(F.col("admitted").isNotNull(), F.col("admitted"))
                   .when(fits, True).when(misses, False))
        rows = rows.withColumn("admitted", verdict).drop(
            "tenant_low", "tenant_high", "user_low", "user_high")
        rows = cut(rows, f"token-quota-{number}")

    sure = F.when(F.col("admitted"), F.col("charge")).otherwise(0)
    rows = running(rows, ["tenant", "day"], order, minute, tenant_low=("before", sure))
    rows = running(rows, ["tenant", "user", "day"], order, minute, user_low=("before", sure))
    undecided = rows.filter("admitted IS NULL")
    walked = (undecided.repartition("tenant", "day")
              .sortWithinPartitions("tenant", "day", *order)
              .select("call_id", "tenant", "user", "day", "need", "charge", "tenant_low",
                      "user_low")
              .mapInPandas(_walk(user_quota, tenant_quota), "call_id string, admitted boolean"))
    decided = rows.filter("admitted IS NOT NULL").select(
        F.col("call_id").cast("string").alias("call_id"), "admitted")
    verdicts = decided.unionByName(walked)
    return (calls.withColumn("__id", F.col("call_id").cast("string"))
            .join(verdicts.withColumnRenamed("call_id", "__id"), "__id").drop("__id"))


def _walk(user_quota: int, tenant_quota: int):
    """Decide the open calls of each (tenant, day) in order, keeping only what they spent."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, tenant_spent, user_spent = None, 0, {}
        for batch in batches:
            verdicts = []
            for row in batch.itertuples(index=False):
                if (row.tenant, row.day) != group:
                    group, tenant_spent, user_spent = (row.tenant, row.day), 0, {}
                mine = user_spent.get(row.user, 0)
                fits = (row.user_low + mine + row.need <= user_quota
                        and row.tenant_low + tenant_spent + row.need <= tenant_quota)
                if fits:
                    tenant_spent += row.charge
                    user_spent[row.user] = mine + row.charge
                verdicts.append(fits)
            yield pd.DataFrame({"call_id": batch["call_id"].astype(str), "admitted": verdicts})

    return walk
