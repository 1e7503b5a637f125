"""Prices and cost reports as functions of SQL: temporary functions of a session, which the optimizer inlines into the query that calls them.

After `register(spark, usage, messages, papers)`:

    SELECT id, calculate_token_cost(provider, model, prompt_tokens, completion_tokens) FROM token_usage
    SELECT t.id, p.* FROM token_usage t, LATERAL get_model_pricing(t.provider, t.model, t.prompt_tokens) p
    SELECT * FROM get_cost_by_model('chat') WHERE provider = 'openai'
    SELECT k.kind, m.* FROM kinds k, LATERAL get_cost_by_model(k.kind) m

Amounts are exact decimals of USD, rounded half up where a report rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .money import LONG_GEMINI, OTHER, PRICES

USD = "DECIMAL(38,8)"


def price(side: int) -> str:
    """Cents per million tokens, input or output, of p_model at p_prompt_tokens."""
    cases = ""
    for pattern, *cents in PRICES:
        usual = f"CASE WHEN p_prompt_tokens > {LONG_GEMINI[0]} THEN {LONG_GEMINI[1 + side]} ELSE {cents[side]} END" if "gemini" in pattern else str(cents[side])
        cases += f" WHEN p_model ILIKE '{pattern}' THEN {usual}"
    return f"CASE{cases} ELSE {OTHER[side]} END"


SCALARS = {
    "token_cost_units(p_model STRING, p_prompt_tokens BIGINT, p_completion_tokens BIGINT) RETURNS BIGINT COMMENT 'Cost of a call in units of 1e-8 USD'":
        f"p_prompt_tokens * {price(0)} + p_completion_tokens * {price(1)}",
    f"calculate_token_cost(p_provider STRING, p_model STRING, p_prompt_tokens BIGINT, p_completion_tokens BIGINT) RETURNS {USD} COMMENT 'Cost of a call in USD'":
        f"CAST(CAST(token_cost_units(p_model, p_prompt_tokens, p_completion_tokens) AS DECIMAL(20,0)) / 100000000 AS {USD})",
}

COSTS = "calculate_token_cost(provider, model, prompt_tokens, completion_tokens)"
# calls without a message, or without a paper, meet no owner; by a hash of the row they are dealt out, not all to one task
OWNED = f"""(SELECT u.type, coalesce(m.user_id, p.user_id) AS user_id, coalesce(u.message_id, u.paper_id) AS request, prompt_tokens, completion_tokens, {COSTS} AS cost
  FROM (SELECT *, coalesce(message_id, xxhash64(*)) AS message_dealt, coalesce(paper_id, xxhash64(*)) AS paper_dealt FROM token_usage) u
  LEFT JOIN token_messages m ON u.message_id = m.message_id AND u.message_dealt = m.message_id LEFT JOIN token_papers p ON u.paper_id = p.paper_id AND u.paper_dealt = p.paper_id)"""
BY_USER = f"""(SELECT user_id, type, count(DISTINCT request) AS requests, sum(cost) AS cost, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens
  FROM {OWNED} WHERE user_id IS NOT NULL GROUP BY user_id, type)"""

TABLES = {
    "get_model_pricing(p_provider STRING, p_model STRING, p_prompt_tokens BIGINT DEFAULT 0) RETURNS TABLE (input_cost_per_million DECIMAL(10,2), output_cost_per_million DECIMAL(10,2))":
        f"SELECT CAST({price(0)} / 100.0 AS DECIMAL(10,2)), CAST({price(1)} / 100.0 AS DECIMAL(10,2))",
    f"get_avg_cost_per_request_by_type() RETURNS TABLE (usage_type STRING, avg_cost_usd {USD}, total_requests BIGINT, total_cost_usd {USD}, avg_prompt_tokens DECIMAL(38,0), avg_completion_tokens DECIMAL(38,0))":
        f"""SELECT type, round(avg(cost), 6), count(DISTINCT request), round(sum(cost), 4), round(avg(CAST(prompt_tokens AS DECIMAL(20,0))), 0), round(avg(CAST(completion_tokens AS DECIMAL(20,0))), 0)
        FROM (SELECT type, coalesce(message_id, paper_id) AS request, prompt_tokens, completion_tokens, {COSTS} AS cost FROM token_usage) GROUP BY type""",
    f"get_avg_cost_per_user_by_type() RETURNS TABLE (user_id BIGINT, usage_type STRING, avg_cost_per_request {USD}, total_requests BIGINT, total_cost_usd {USD}, total_prompt_tokens BIGINT, total_completion_tokens BIGINT)":
        f"SELECT user_id, type, round(cost / nullif(requests, 0), 6), requests, round(cost, 4), prompt_tokens, completion_tokens FROM {BY_USER}",
    f"get_overall_avg_cost_per_type() RETURNS TABLE (usage_type STRING, num_users BIGINT, avg_cost_per_user {USD}, avg_requests_per_user DECIMAL(20,2), avg_cost_per_request {USD}, total_cost_usd {USD}, total_requests BIGINT)":
        f"""SELECT type, count(*), round(sum(cost) / nullif(count(*), 0), 4), round(CAST(sum(requests) AS DECIMAL(20,0)) / nullif(count(*), 0), 2), round(sum(cost) / nullif(sum(requests), 0), 6), round(sum(cost), 4), sum(requests)
        FROM {BY_USER} GROUP BY type""",
    f"get_cost_by_model(p_type STRING DEFAULT NULL) RETURNS TABLE (usage_type STRING, provider STRING, model STRING, total_calls BIGINT, total_prompt_tokens BIGINT, total_completion_tokens BIGINT, total_cost_usd {USD}, avg_cost_per_call {USD})":
        f"""SELECT * FROM (SELECT type, provider, model, count(*), sum(prompt_tokens), sum(completion_tokens), round(sum(cost), 4), round(avg(cost), 6)
        FROM (SELECT type, provider, model, prompt_tokens, completion_tokens, {COSTS} AS cost FROM token_usage) GROUP BY type, provider, model) AS t(type, provider, model, calls, prompt, completion, total, mean)
        WHERE p_type IS NULL OR type = p_type""",
    f"get_daily_cost_summary(p_days INT DEFAULT 30, p_as_of TIMESTAMP_NTZ DEFAULT NULL) RETURNS TABLE (day DATE, usage_type STRING, total_requests BIGINT, total_cost_usd {USD})":
        f"""SELECT day, type, count(DISTINCT request), round(sum(cost), 4)
        FROM (SELECT CAST(created_at AS DATE) AS day, type, coalesce(message_id, paper_id) AS request, {COSTS} AS cost FROM token_usage WHERE created_at >= coalesce(p_as_of, localtimestamp()) - make_dt_interval(p_days)) GROUP BY day, type""",
}


def register(spark: SparkSession, usage: DataFrame, messages: DataFrame, papers: DataFrame) -> None:
    """The functions in this session, over views of the given tables: usage, messages (message_id, user_id) and papers (paper_id, user_id). Registered anew, they read the new tables."""
    for name, rows in (("token_usage", usage), ("token_messages", messages), ("token_papers", papers)):
        rows.createOrReplaceTempView(name)
    for head, body in {**SCALARS, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
