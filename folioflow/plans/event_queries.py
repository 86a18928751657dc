"""Queries over service events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import service as S
from ..operators import events as E
from ..sources.tables import table

HOUR = 3600


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as calls of a service: errors over a value of 50 are rate limits."""
    kind = F.when(F.col("event_type") != "error", "success").when(F.col("value") > 50, "rate_limit").otherwise("error")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type", kind.alias("kind"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (400 + F.col("event_id") % 130).cast("string")
    message = F.concat(F.lit("Error code: "), code, F.when(F.col("event_id") % 7 == 0, " billing").otherwise(""), F.lit(" - key sk-"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(" "), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", message.alias("message"))


def event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.window_counts_by_block(_events(spark, sf_dir), HOUR, "success").select("event_id", "n_success")


def event_window_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.window_counts(_events(spark, sf_dir), 24 * HOUR, ("rate_limit", "error", "success"), "user_id").select("event_id", "n_rate_limit", "n_error", "n_success")


def burst_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = E.window_counts(_events(spark, sf_dir), 10 * 24 * HOUR, ("error",), "user_id")
    return E.bursts(counted, "error", 5).select("event_id", "n_error")


def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    paused = E.cooldown(_events(spark, sf_dir), F.col("value"), ("ts", "event_id"), "user_id")
    return paused.filter("resume_after is not null").select("event_id", F.round(F.col("resume_after") * 1e6).cast("long").alias("resume_after_us"))


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.state_changes(_events(spark, sf_dir), "kind", ("ts", "event_id"), "user_id").select("event_id", "user_id", "kind")


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return m.select("event_id", S.error_class("message").alias("error_class"), S.status_code("message").cast("long").alias("status"))


def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("event_id", S.scrubbed("message").alias("message"))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    key = F.when(e % 5 == 0, F.concat(F.lit("sk-ant-"), e)).when(e % 5 == 1, F.concat(F.lit("sk-proj-"), e)).when(e % 5 == 2, F.concat(F.lit("sk-"), F.md5(e.cast("string")))).when(e % 5 == 3, F.concat(F.lit("sk-x"), e)).otherwise("none")
    return table(spark, sf_dir, "events").groupBy(S.provider_of_key(key).alias("provider")).agg(F.count("*").alias("n"))


PRICES = {"hit": "0.0280", "miss": "0.2800", "write": "0.3500", "output": "0.4200"}


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    out = F.when(F.col("role") == "assistant", n).otherwise(0)
    prompt = F.when(F.col("role") != "assistant", n).otherwise(0)
    hit, write = F.floor(prompt / 3), F.floor(prompt / 5)
    cost = S.usage_cost(hit, prompt - hit, write, out, prices=PRICES)
    calls = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") % 3).alias("slot"), prompt.alias("prompt"), out.alias("out"), cost.alias("cost"))
    return calls.withColumn("slot", F.col("slot").cast("string")).rollup("role", "slot").agg(F.sum("prompt").alias("prompt_tokens"), F.sum("out").alias("completion_tokens"), F.sum("cost").cast("double").alias("cost_usd"))


def fallback_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: how many fallbacks a floor of 2, a ratio of 5 % and a share of 20 % allow, and whether the labels keep to it."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("n_failed"))
    budget = F.least(F.greatest(F.lit(2), F.floor(0.05 * F.col("n"))), F.floor(0.2 * F.col("n"))).cast("long")
    return n.withColumn("budget", budget).withColumn("publish", F.col("n_failed") <= F.col("budget"))


QUERIES = {
    f.__name__: f
    for f in (
        event_window, event_window_by_user, burst_flags, cooldown, state_changes, error_classes, scrubbed, providers, usage_cost, fallback_budget,
    )
}

_EVENTS = "e as (select event_id, user_id, ts, value, event_type, case when event_type <> 'error' then 'success' when value > 50 then 'rate_limit' else 'error' end as kind from events)"
_MESSAGES = """m as (select event_id, 'Error code: ' || (400 + event_id % 130) || case when event_id % 7 = 0 then ' billing' else '' end
    || ' - key sk-' || lpad(event_id::varchar, 12, '0') || ' ' || event_type as message, 400 + event_id % 130 as status from events)"""

ORACLES = {
    "event_window": f"with {_EVENTS} select event_id, count_if(kind = 'success') over (order by ts range between interval 3600 seconds preceding and current row)::bigint as n_success from e",
    "event_window_by_user": f"""with {_EVENTS} select event_id, count_if(kind = 'rate_limit') over w::bigint as n_rate_limit, count_if(kind = 'error') over w::bigint as n_error, count_if(kind = 'success') over w::bigint as n_success
        from e window w as (partition by user_id order by ts range between interval 86400 seconds preceding and current row)""",
    "burst_flags": f"""with {_EVENTS}, c as (select event_id, kind, count_if(kind = 'error') over (partition by user_id order by ts range between interval 864000 seconds preceding and current row)::bigint as n_error from e)
        select event_id, n_error from c where kind = 'error' and n_error >= 5""",
    "cooldown": f"""with {_EVENTS}, r as (select event_id, max(case when kind = 'rate_limit' then epoch_us(ts) / 1e6 + value end) over (partition by user_id order by ts, event_id rows unbounded preceding) as r from e)
        select event_id, round(r * 1e6)::bigint as resume_after_us from r where r is not null""",
    "state_changes": f"""with {_EVENTS}, l as (select event_id, user_id, kind, lag(kind) over (partition by user_id order by ts, event_id) as was from e)
        select event_id, user_id, kind from l where was is null or was <> kind""",
    "error_classes": f"""with {_MESSAGES} select event_id, status, case when status in (401, 402, 403) or (status = 400 and message like '%billing%') or (status = 429 and message like '%billing%') then 'key_unusable'
        when status = 429 or regexp_matches(message, '(^|[^0-9])429([^0-9]|$)') then 'rate_limit'
        when status in (408, 409, 425, 500, 502, 503, 504, 520, 521, 522, 524, 529) then 'transient' else 'fatal' end as error_class from m""",
    "scrubbed": f"with {_MESSAGES} select event_id, regexp_replace(message, 'sk-[A-Za-z0-9_-]{{8,}}', '[redacted]', 'g') as message from m",
    "providers": """with k as (select case when event_id % 5 = 0 then 'claude' when event_id % 5 = 1 then 'openai' when event_id % 5 = 2 then 'deepseek' when event_id % 5 = 3 then 'openai' end as provider from events)
        select provider, count(*) as n from k group by 1""",
    "usage_cost": """
        with c as (select role, (conv_id % 3)::varchar as slot, case when role <> 'assistant' then length(text) else 0 end as prompt, case when role = 'assistant' then length(text) else 0 end as out from conversations),
        t as (select *, prompt // 3 as hit, prompt // 5 as wrote from c),
        u as (select role, slot, prompt, out, ((hit * 280 + greatest(prompt - hit - wrote, 0) * 2800 + wrote * 3500 + out * 4200)::decimal(30, 0)) as units from t)
        select role, slot, sum(prompt)::bigint as prompt_tokens, sum(out)::bigint as completion_tokens, (sum(units)::decimal(28, 0)::double / 1e10) as cost_usd from u group by rollup (role, slot)
    """,
    "fallback_budget": """
        with n as (select source, count(*) as n, count_if(quality = 0)::bigint as n_failed from documents join labels using (doc_id) group by 1),
        b as (select *, least(greatest(2, floor(0.05 * n)), floor(0.2 * n))::bigint as budget from n) select *, n_failed <= budget as publish from b
    """,
}
