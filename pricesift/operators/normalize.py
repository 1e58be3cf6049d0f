"""Price normalisation.

The rate table is a fixed literal, so the conversion is a map lookup compiled
into the projection: no join, no shuffle, stays in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import pick_currency, price_digits, us_rule
from ..sources.registry import FX_TO_USD


def rate_map(rates: dict[str, float] | None = None) -> Column:
    rates = rates or FX_TO_USD
    return F.create_map(*[x for k, v in sorted(rates.items()) for x in (F.lit(k), F.lit(v))])


def stage(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that the optimizer does not copy into its uses.

    ``inline`` of one struct is a generator: expressions above it refer to its output
    and filters on it stay above, while it compiles into the same stage.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def normalize_offers(df: DataFrame, price: str = "price", currency: str = "currency",
                     target: str = "target_currency", rates: dict[str, float] | None = None) -> DataFrame:
    """Adds amount, src_currency, norm_price, norm_currency; drops unparsable or zero prices.

    On an unknown currency the amount and the source currency are kept (J3).
    """
    m = rate_map(rates)
    amount = F.col("amount")
    src = F.col("src_currency")
    tgt = F.col(target)
    r_src = F.try_element_at(m, src)
    r_dst = F.try_element_at(m, tgt)
    known = r_src.isNotNull() & r_dst.isNotNull()
    # Both the digit text and the amount are used many times: each is computed once per row.
    d = stage(stage(df, "_pd", price_digits(price)), "amount", us_rule(F.col("_pd"))).drop("_pd")
    return (d.filter(amount > 0)
            .withColumn("src_currency", pick_currency(price, currency, target))
            .withColumn("norm_price", F.when(src == tgt, amount)
                        .when(known, amount * r_src / r_dst).otherwise(amount))
            .withColumn("norm_currency", F.when(src == tgt, tgt).when(known, tgt).otherwise(src)))
