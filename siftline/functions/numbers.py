"""Numeric functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(chars: Column, per_token: int = 4) -> Column:
    return F.ceil(chars / per_token).cast("long")


def saved(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0), before - after).cast("long")


def normal_price(price: Column) -> Column:
    """Prices over a cent are per million tokens."""
    return F.when(price > 0.01, price / 1_000_000).otherwise(price)


def cost_range(tokens: Column, input_price: Column, cached_price: Column) -> tuple[Column, Column]:
    """Lowest and highest cost of tokens; null without an input price."""
    priced = input_price > 0
    low = F.when(cached_price > 0, cached_price).otherwise(input_price)
    return F.when(priced, tokens * F.least(low, input_price)), F.when(priced, tokens * F.greatest(low, input_price))


def saved_or_estimated(tokens: Column, chars: Column) -> Column:
    return F.when(tokens > 0, tokens).otherwise(F.greatest(F.lit(0), F.floor(chars / 4 + 0.5))).cast("long")


def compact_count(n: Column) -> Column:
    """1234567 -> 1.2M, 12345 -> 12k, 1234 -> 1.2k, by integer arithmetic (halves up)."""
    tenth = lambda unit: F.floor((n * 20 + unit) / (2 * unit)).cast("long")
    point = lambda t, name: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(name))
    return F.when(n >= 1_000_000, point(tenth(1_000_000), "M")).when(n >= 10_000, F.concat(F.floor((n + 500) / 1000).cast("string"), F.lit("k"))).when(n >= 1000, point(tenth(1000), "k")).otherwise(n.cast("string"))


def cents(dollars: Column) -> Column:
    """Hundredths (from a cent) or thousandths of a dollar, as shown: (number, places)."""
    return F.when(dollars <= 0, F.struct(F.lit(0).cast("long").alias("units"), F.lit(2).alias("places"))).when(dollars < 0.01, F.struct(F.floor(dollars * 1000 + 0.5).cast("long").alias("units"), F.lit(3).alias("places"))).otherwise(F.struct(F.floor(dollars * 100 + 0.5).cast("long").alias("units"), F.lit(2).alias("places")))


def dollars(amount: Column) -> Column:
    """$0.00 for nothing, three places below a cent, else two (halves up, by integer arithmetic)."""
    digits = lambda n, places: F.concat(F.lit("$"), F.floor(n / 10**places).cast("long").cast("string"), F.lit("."), F.lpad((n % 10**places).cast("string"), places, "0"))
    shown = cents(amount)
    return F.when(shown["places"] == 3, digits(shown["units"], 3)).otherwise(digits(shown["units"], 2))


def dollar_range(low: Column, high: Column) -> Column:
    """~low-high, one amount if both read the same, null if there is nothing to show."""
    return F.when(high > 0, F.when(dollars(low) == dollars(high), F.concat(F.lit("~"), dollars(high))).otherwise(F.concat(F.lit("~"), dollars(low), F.lit("-"), F.substring(dollars(high), 2, 30))))


def token_logit(emission: Column) -> Column:
    """Of emissions [drop, keep]: how much keep is ahead."""
    return F.get(emission, F.lit(1)) - F.get(emission, F.lit(0))


def is_on(setting: Column) -> Column:
    """A lenient flag: 0, false, no and off (in any case, blanks around them) are off, anything else is on; null stays null."""
    return ~F.lower(F.trim(setting)).isin("0", "false", "no", "off")


def positive_int(setting: Column) -> Column:
    """A strict setting: null stays null; what isn't a whole number over 0 is an error."""
    number = setting.try_cast("int")
    return F.when(setting.isNull() | (number > 0), number).otherwise(F.raise_error(F.concat(F.lit("not a positive integer: "), setting)).cast("int"))


def sum_or_null(x: Column) -> Column:
    """A sum; null if it is 0 or there is nothing to sum."""
    return F.nullif(F.sum(x), F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def yes_probability(no: Column, yes: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def padded_tokens(lengths: Column) -> Column:
    return (F.size(lengths) * F.array_max(lengths)).cast("long")


def padding_label(waste: Column) -> Column:
    return F.when(waste <= 0.2, "fine").when(waste <= 0.4, "measure").otherwise("bad")


def window_length(tokens: Column, prompt_tokens: Column, explicit: Column, adaptive: bool, least: int = 100) -> Column:
    """Longest model input: the explicit one, else 4096, else by the length of the text; always room for the prompt and some text."""
    by_size = F.when(tokens <= 1500, 2048).otherwise(1024) if adaptive else F.lit(4096)
    return F.when(explicit.isNotNull(), F.greatest(explicit, prompt_tokens + least)).otherwise(F.greatest(by_size, prompt_tokens + least) if adaptive else by_size)


def memory_allows(available_mb: Column, weights_mb: Column, least_mb: Column) -> Column:
    """Room for a cold load: the least asked for (0 or less: no test), else weights and 768 MB, 2,048 at least."""
    return F.coalesce(least_mb <= 0, F.lit(False)) | (available_mb >= F.coalesce(least_mb, F.greatest(F.lit(2048), weights_mb + 768)))
