"""Payments, spreads and agreement of figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


ROW = "struct<n:int,payment:decimal(18,2),profit:decimal(18,2),taxes:decimal(18,2),principal:decimal(18,2),remaining:decimal(18,2)>"


def cents(value: Column) -> Column:
    return F.round(value, 2).cast(MONEY)


def plan(amount: Column, steps: Column, pay: Column, multiplier, first_tax: float, second_tax: float, close_payment: bool) -> Column:
    """Rows of a plan by a fold: the balance goes from step to step, each figure rounded half up to cents. steps: 1 to the last; multiplier(k): the profit's
    share of the balance. The last principal is what remains; close_payment: the last payment is then made anew of its parts."""
    start = F.struct(amount.cast(MONEY).alias("balance"), F.array().cast(f"array<{ROW}>").alias("rows"))
    tax = lambda profit, t: cents(profit * F.lit(t).cast("decimal(8,4)"))

    def step(state: Column, k: Column) -> Column:
        profit = cents(state["balance"] * multiplier(k))
        taxes = (tax(profit, first_tax) + tax(profit, second_tax)).cast(MONEY)
        last = k == F.size(steps)
        principal = F.when(last, state["balance"]).otherwise((pay - profit - taxes).cast(MONEY))
        payment = F.when(last, (principal + profit + taxes).cast(MONEY)).otherwise(pay) if close_payment else pay
        left = (state["balance"] - principal).cast(MONEY)
        row = F.struct(k.alias("n"), payment.alias("payment"), profit.alias("profit"), taxes.alias("taxes"), principal.alias("principal"), left.alias("remaining")).cast(ROW)
        return F.struct(left.alias("balance"), F.concat(state["rows"], F.array(row)).alias("rows"))

    return F.aggregate(steps, start, step, lambda s: s["rows"])


def taxed_schedule(amount: Column, term: Column, rate: float, first_tax: float, second_tax: float) -> Column:
    """A level plan: priced at rate * (1 + taxes), profit at the bare rate."""
    full = rate * (1 + first_tax + second_tax)
    pay = F.round(amount.cast("double") / ((1 - F.pow(F.lit(1 + full), -term)) / full), 2).cast(MONEY)
    share = F.lit(rate).cast("decimal(8,4)")
    return plan(amount, F.sequence(F.lit(1), term), pay, lambda k: share, first_tax, second_tax, False)


def _half_up(x: np.ndarray, by: int) -> np.ndarray:
    """x / by as whole numbers, half away from zero."""
    return np.sign(x) * ((2 * np.abs(x) + by) // (2 * by))


def level_plans(df: DataFrame, key: str, amount: str, term: str, rate: float, first_tax: float, second_tax: float) -> DataFrame:
    """The rows of taxed_schedule for every row of df: key, n, payment, profit, taxes, principal, remaining. The balances of an Arrow batch go from step to step together, in whole cents, so the
    work is one pass for each step of the longest plan."""
    full = rate * (1 + first_tax + second_tax)
    pay = F.round(F.col(amount).cast("double") / ((1 - F.pow(F.lit(1 + full), -F.col(term))) / full), 2).cast(MONEY)
    share, taxes_of = round(rate * 10_000), [round(t * 10_000) for t in (first_tax, second_tax)]
    kind = dict(df.dtypes)[key]
    names = ["payment", "profit", "taxes", "principal", "remaining"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            balance, steps, level = (np.asarray(b.column(c)) for c in ("_balance", "_steps", "_pay"))
            live, made = np.flatnonzero(steps > 0), []
            balance = balance.copy()
            for k in range(1, int(steps.max(initial=0)) + 1):
                live = live[steps[live] >= k]
                held, paid = balance[live], level[live]
                profit = _half_up(held * share, 10_000)
                taxes = sum(_half_up(profit * t, 10_000) for t in taxes_of)
                principal = np.where(steps[live] == k, held, paid - profit - taxes)
                balance[live] = held - principal
                made.append((live, np.full(len(live), k, np.int32), paid, profit, taxes, principal, balance[live]))
            rows = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0, np.int64)] * 7
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows[0])), pa.array(rows[1].astype(np.int32)), *[pa.array(c / 100) for c in rows[2:]]], [key, "n", *names])

    whole = lambda c: (c.cast(MONEY) * 100).cast("long")
    cents_of = df.select(key, whole(F.col(amount)).alias("_balance"), F.col(term).cast("long").alias("_steps"), whole(pay).alias("_pay")).filter("_balance IS NOT NULL AND _steps IS NOT NULL AND _pay IS NOT NULL")
    return cents_of.mapInArrow(run, f"{key} {kind}, n int, " + ", ".join(f"{c} double" for c in names))


def dated_terms(dates: Column, start: Column, rate: float, first_tax: float, second_tax: float) -> Column:
    """What a plan on due dates takes from them alone: `factor`, the sum of the discount factors by days / 30, rounded to six places, and `shares`, the profit's share of the balance in
    ten-thousandths by the days since the date before."""
    full = rate * (1 + first_tax + second_tax)
    factors = F.transform(dates, lambda x: F.round(1 / F.pow(F.lit(1 + full), F.datediff(x, start) / 30), 6))
    before = F.concat(F.array(start), F.slice(dates, 1, F.size(dates) - 1))
    days = F.zip_with(dates, before, F.datediff)
    shares = F.transform(days, lambda n: ((F.round(F.pow(F.lit(1 + rate), n / 30), 4) - 1).cast("decimal(8,4)") * 10_000).cast("long"))
    return F.struct(F.aggregate(factors, F.lit(0.0), lambda a, x: a + x).alias("factor"), shares.alias("shares"))


def dated_plans(df: DataFrame, key: str, amount: str, dates: Column, start: str, rate: float, first_tax: float, second_tax: float) -> DataFrame:
    """Plans on due dates that follow from `start`, at least one: key, n, payment, profit, taxes, principal, remaining. What depends on dates alone is worked out once for each start; the
    balances of an Arrow batch go from step to step together, in whole cents, each figure half up to cents. The last payment takes what remains."""
    terms = df.select(start).distinct().select(F.col(start).alias("_start"), dated_terms(dates, F.col(start), rate, first_tax, second_tax).alias("_terms")).select("_start", "_terms.*")
    taxes_of = [round(t * 10_000) for t in (first_tax, second_tax)]
    kind = dict(df.dtypes)[key]
    names = ["payment", "profit", "taxes", "principal", "remaining"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            balance, level = (np.asarray(b.column(c)) for c in ("_balance", "_pay"))
            steps = np.asarray(b.column("shares").value_lengths())
            share, first = np.asarray(b.column("shares").flatten()), np.concatenate([[0], np.cumsum(steps)])
            live, made = np.arange(len(steps)), []
            balance = balance.copy()
            for k in range(1, int(steps.max(initial=0)) + 1):
                live = live[steps[live] >= k]
                held, last = balance[live], steps[live] == k
                profit = _half_up(held * share[first[live] + k - 1], 10_000)
                taxes = sum(_half_up(profit * t, 10_000) for t in taxes_of)
                principal = np.where(last, held, level[live] - profit - taxes)
                balance[live] = held - principal
                made.append((live, np.full(len(live), k, np.int32), np.where(last, held + profit + taxes, level[live]), profit, taxes, principal, balance[live]))
            rows = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0, np.int64)] * 7
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows[0])), pa.array(rows[1].astype(np.int32)), *[pa.array(c / 100) for c in rows[2:]]], [key, "n", *names])

    whole = lambda c: (c.cast(MONEY) * 100).cast("long")
    met = df.select(key, F.col(amount).cast(MONEY).alias("_amount"), F.col(start).alias("_start")).join(F.broadcast(terms), "_start")
    pay = F.round(F.col("_amount").cast("double") / F.col("factor"), 2)
    cents_of = met.select(key, whole(F.col("_amount")).alias("_balance"), whole(pay).alias("_pay"), "shares").filter("_balance IS NOT NULL AND _pay IS NOT NULL")
    made = cents_of.mapInArrow(run, f"{key} {kind}, n int, " + ", ".join(f"{c} double" for c in names))
    # Without an amount or a start there are the steps, but no figures.
    empty = df.filter(F.col(amount).cast(MONEY).isNull() | F.col(start).isNull()).select(key, F.explode(F.sequence(F.lit(1), F.size(dates))).alias("n"), *[F.lit(None).cast("double").alias(c) for c in names])
    return made.unionByName(empty)


def spread(buy: Column, sell: Column) -> Column:
    """In percent of the middle; null where the middle is not positive."""
    return F.when(buy + sell > 0, (sell - buy) / ((sell + buy) / 2) * 100)


def spread_looks_broken(buy: Column, sell: Column, most: float = 25) -> Column:
    return F.coalesce((spread(buy, sell) > most) | (spread(buy, sell) < 0), F.lit(True))


def agrees(reported: Column, implied: Column, half_a: float, half_b: float, tolerance: float) -> Column:
    near = F.abs(reported - implied) <= tolerance * implied
    return near | ((reported - half_a <= implied + half_b) & (implied - half_b <= reported + half_a))
