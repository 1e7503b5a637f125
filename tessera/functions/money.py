"""Prices, costs and amounts as exact integers: cents per million tokens, and units of 1e-8 USD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cents per million tokens, input and output, by model pattern; the first match counts.
PRICES = [("%opus%", 500, 2500), ("%sonnet%", 300, 1500), ("%gemini-2.5-pro%", 125, 1000), ("%gpt-5%", 175, 1400)]
LONG_GEMINI = (200_000, 250, 1500)
OTHER = (100, 300)


def model_price(model: Column, prompt_tokens: Column) -> tuple[Column, Column]:
    """Cents per million input and output tokens. A null model has the price of others."""
    out = []
    for side in (0, 1):
        price = F.lit(None)
        for pattern, *cents in reversed(PRICES):
            usual = F.lit(cents[side])
            if "gemini" in pattern:
                usual = F.when(prompt_tokens > LONG_GEMINI[0], LONG_GEMINI[1 + side]).otherwise(usual)
            price = F.when(model.ilike(pattern), usual).otherwise(price)
        out.append(F.coalesce(price, F.lit(OTHER[side])).cast("bigint"))
    return out[0], out[1]


def cost_units(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Cost of a call in units of 1e-8 USD."""
    price_in, price_out = model_price(model, prompt_tokens)
    return prompt_tokens * price_in + completion_tokens * price_out


def rounded(units: Column, count: Column, step: int) -> Column:
    """units / count rounded half up to multiples of `step` units, as USD; null for a count of 0. Integers until the last division."""
    whole = F.call_function("div", units * 2 + count * step, count * (2 * step))
    return F.when(count > 0, whole.cast("double") / F.lit(1e8 / step))


def file_size(size: Column) -> Column:
    """0 Bytes, or two decimals in Bytes, KB, MB, GB by powers of 1024; from 1 TB on the unit is `undefined`."""
    power = F.when(size >= 1 << 40, 4).when(size >= 1 << 30, 3).when(size >= 1 << 20, 2).when(size >= 1 << 10, 1).otherwise(0)
    units = F.array(*[F.lit(x) for x in ("Bytes", "KB", "MB", "GB", "undefined")])
    return F.when(size == 0, "0 Bytes").otherwise(F.concat(F.format_string("%.2f", size / F.pow(F.lit(1024.0), power)), F.lit(" "), F.element_at(units, power + 1)))


def base_units(usd: Column) -> Column:
    """A decimal string of USD as a string of millionths, cut off after six places; `0` if nothing is left."""
    plain = F.regexp_replace(usd, "[^0-9.]", "")
    fraction = F.substring(F.rpad(F.split_part(plain, F.lit("."), F.lit(2)), 6, "0"), 1, 6)
    digits = F.regexp_replace(F.concat(F.split_part(plain, F.lit("."), F.lit(1)), fraction), "^0+", "")
    return F.when(digits == "", "0").otherwise(digits)


def mb_bytes(mb: Column) -> Column:
    return mb * 1048576


def fixed(x: Column, places: int = 2) -> Column:
    """A number as a string with that many decimals."""
    return F.format_string(f"%.{places}f", x)


def ratio(x: Column, n: Column) -> Column:
    """x / n, null for an n of zero."""
    return x / F.nullif(n, F.lit(0))


def backoff_ms(attempt: Column, first: int = 1000, most: int = 10_000, jitter: Column | None = None) -> Column:
    """Wait before a retry in whole milliseconds: first x 2^attempt, at most `most`, times 1 + jitter (from -0.2 to 0.2, none by default)."""
    wait = F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), attempt))
    return F.floor(wait if jitter is None else wait * (1 + jitter)).cast("bigint")
