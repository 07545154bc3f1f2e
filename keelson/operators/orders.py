"""Order processing over ordered relations: reads and batch updates.

Warehouses, districts and requests are columns named by the caller, so the same programs
run over any order schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators.access import earliest, latest
from keelson.operators.mutate import assign_sequence


def last_orders(orders: DataFrame, group: Sequence[str], order_id: str, count: int) -> DataFrame:
    """The ``count`` latest orders of each group: ids in [next - count, next)."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.col(order_id).desc()))
    return orders.withColumn("__p", place).where(F.col("__p") <= count).drop("__p")


def stock_level(orders: DataFrame, lines: DataFrame, stock: DataFrame, group: Sequence[str], order_id: str, item_keys: Sequence[str], quantity: str, threshold: float, count: int = 20) -> DataFrame:
    """For each group how many distinct items of its last orders have low stock."""
    recent = last_orders(orders, group, order_id, count).select(*group, order_id)
    items = lines.select(order_id, *item_keys).join(recent, order_id).select(*group, *item_keys).distinct()
    low = items.join(stock, list(item_keys)).where(F.col(quantity) < threshold)
    return low.groupBy(*group).agg(F.count(F.lit(1)).alias("low_stock"))


def order_status(orders: DataFrame, lines: DataFrame, customer: Sequence[str], order_id: str, line_fields: Sequence[str]) -> DataFrame:
    """The lines of each customer's latest order."""
    newest = latest(orders, customer, [order_id], [order_id])
    return newest.join(lines.select(order_id, *line_fields), order_id)


def delivery(undelivered: DataFrame, lines: DataFrame, group: Sequence[str], order_id: str, customer: str, amount: Column, pick: str = "oldest") -> DataFrame:
    """For each group the order to deliver and what it adds to its customer's balance.

    The oldest order is taken; ``pick="newest"`` takes the latest one instead.
    """
    choose = earliest if pick == "oldest" else latest
    chosen = choose(undelivered, group, [order_id], [order_id, customer])
    totals = lines.join(chosen.select(order_id), order_id, "left_semi").groupBy(order_id).agg(F.sum(amount).alias("credit"))
    return chosen.join(totals, order_id, "left").withColumn("credit", F.coalesce("credit", F.lit(0)))


def payment_totals(payments: DataFrame, group: Sequence[str], amount: str) -> DataFrame:
    """Year-to-date totals, balances and counts of payments."""
    return payments.groupBy(*group).agg(F.sum(amount).alias("ytd"), (-F.sum(amount)).alias("balance"), F.count(F.lit(1)).alias("payments"))


def payment_history(payments: DataFrame, worker: str, arrival: Sequence[str]) -> DataFrame:
    """Payments with a dense number for each worker."""
    return assign_sequence(payments, [worker], arrival, F.lit(1), "h_pk")


def customers_by_name(customers: DataFrame, group: Sequence[str], first: str, key: str) -> DataFrame:
    """Of customers that share a name the one at the lower median by first name."""
    from keelson.operators.aggregates import lower_median

    return lower_median(customers, group, [first, key], [key])


def new_orders(requests: DataFrame, districts: DataFrame, district: Sequence[str], arrival: Sequence[str], next_id: str, name: str = "o_id") -> tuple[DataFrame, DataFrame]:
    """Requests with consecutive order ids, and districts with their next id moved on."""
    numbered = assign_sequence(requests.join(districts.select(*district, next_id), list(district)), district, arrival, F.col(next_id), name).drop(next_id)
    used = requests.groupBy(*district).agg(F.count(F.lit(1)).alias("__n"))
    moved = districts.join(used, list(district), "left").withColumn(next_id, F.col(next_id) + F.coalesce("__n", F.lit(0))).drop("__n")
    return numbered, moved


def all_local(lines: DataFrame, order_id: str, home: Column, supply: Column) -> DataFrame:
    return lines.groupBy(order_id).agg(F.bool_and(home == supply).alias("all_local"))


def transaction_mix(requests: DataFrame, draw: Column, shares: Sequence[tuple[str, int]], name: str = "kind") -> DataFrame:
    """Requests with the transaction that a draw from [0, 100) falls on."""
    case, total = F, 0
    for kind, share in shares:
        total += share
        case = case.when(draw < total, kind)
    return requests.withColumn(name, case.otherwise("none"))


def delivered_beyond(orders: DataFrame, group: Sequence[str], order_id: str, delivered: Column, window: int) -> DataFrame:
    """Delivered orders that fall out of a sliding window in id order, up to the first one
    that isn't delivered."""
    marks = orders.groupBy(*group).agg(F.max(order_id).alias("__high"), F.min(F.when(~delivered, F.col(order_id))).alias("__open"))
    joined = orders.join(marks, list(group))
    inside = (F.col(order_id) <= F.col("__high") - window) & F.coalesce(F.col(order_id) < F.col("__open"), F.lit(True))
    return joined.where(inside).select(*orders.columns)
