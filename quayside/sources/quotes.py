"""Payloads of calculators and rate pages, normalised: JSON and HTML in, rates, products, quotes and schedules out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from . import files

SCHEDULE = "array<struct<n:int,payment:double,principal:double,profit:double,tax:double,remaining:double>>"


def rates_from_json(payload: Column, schema: str, path: str, code: str, name: str, buy: str, sell: str, number=V.money) -> Column:
    """An array of (code, name, buy, sell, unit) from a JSON text; entries without positive prices drop out."""
    rows = F.from_json(payload, schema)
    for p in filter(None, path.split(".")):
        rows = rows[p]
    made = F.transform(rows, lambda r: F.struct(V.currency(r[code].cast("string")).alias("code"), r[name].cast("string").alias("name"), number(r[buy].cast("string")).alias("buy"), number(r[sell].cast("string")).alias("sell"), rate_unit(r[code].cast("string")).alias("unit")))
    return F.filter(made, lambda r: (r["buy"] > 0) & (r["sell"] > 0))


def rates_from_table(page: Column, number=V.money) -> Column:
    """From the first HTML table: rows of name with (CODE), buy, sell."""
    rows = F.filter(files.html_rows(page), lambda r: F.size(r) >= 3)
    made = F.transform(rows, lambda r: F.struct(V.currency(F.coalesce(F.nullif(F.regexp_extract(r[0], "\\(([A-Z]{3})\\)", 1), F.lit("")), F.regexp_extract(r[0], "^([A-Z]{3})\\b", 1))).alias("code"), r[0].alias("name"), number(r[1]).alias("buy"), number(r[2]).alias("sell"), rate_unit(r[0]).alias("unit")))
    return F.filter(made, lambda r: (r["code"] != "") & (r["buy"] > 0) & (r["sell"] > 0))


def rate_unit(code: Column) -> Column:
    own = F.upper(code)
    return F.when(own.contains("(GR)") | own.isin("XAU", "XAG", "XPT", "ALT"), "gram").when(own.contains("COIN") | own.contains("CEYREK"), "coin").otherwise("1")


def prefer_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """A feed's rows, and a page's rows for codes that the feed lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def schedule(rows: Column, n: str, payment: str, principal: str, profit: str, tax: str | None, remaining: str, number=V.money) -> Column:
    """Plan rows of any shape as the common schedule."""
    of = lambda r, c: number(r[c].cast("string")) if c else F.lit(0.0)
    return F.transform(rows, lambda r: F.struct(r[n].cast("string").try_cast("int").alias("n"), of(r, payment).alias("payment"), of(r, principal).alias("principal"), of(r, profit).alias("profit"), of(r, tax).alias("tax"), of(r, remaining).alias("remaining")))


def schedule_from_html(markup: Column, labels: dict[str, str]) -> Column:
    """A plan table whose columns are found by folded header. labels: field -> header text."""
    fold = {k: "".join(c for c in v.lower().translate(str.maketrans(X.FOLD_FROM, X.FOLD_TO)) if c.isalnum()) for k, v in labels.items()}
    rows = files.by_header(files.html_rows(markup), X.fold)
    of = lambda r, k: V.money(F.coalesce(F.element_at(r, F.lit(fold[k])), F.lit(""))) if k in fold else F.lit(0.0)
    made = F.transform(rows, lambda r, i: F.struct((i + 1).alias("n"), *[of(r, k).alias(k) for k in ("payment", "principal", "profit", "tax", "remaining")]))
    return F.filter(made, lambda r: r["payment"] > 0)


def quote(amount: Column, term: Column, instalment: Column, total: Column, rows: Column) -> Column:
    """A quote, or the reason for which there is none: a zero is a refusal, never a price."""
    reason = F.when(instalment <= 0, "no quote").when(total <= amount, "total not above amount").when((F.size(rows) > 0) & (F.size(rows) != term), "plan length differs from term")
    return F.struct(amount.alias("amount"), term.alias("term"), instalment.alias("instalment"), total.alias("total"), rows.alias("schedule"), reason.alias("refused"))


def products(page: Column, select: str) -> Column:
    """(code, name) of the options of a named select that have a value."""
    return F.filter(F.transform(files.html_options(page, select), lambda o: F.struct(F.trim(o["value"]).alias("code"), F.trim(F.regexp_replace(o["label"], "\\s+", " ")).alias("name"))), lambda o: o["code"] != "")


def bounds(bands: Column, low: str, high: str) -> Column:
    """The envelope of an array of bands; nulls are no bounds."""
    return F.struct(F.array_min(F.transform(bands, lambda b: b[low])).alias("low"), F.array_max(F.transform(bands, lambda b: b[high])).alias("high"))


def first_positive(attempts: list[Column]) -> Column:
    """The first attempt with a positive value, with its place; accepted but zero everywhere is no offer."""
    return F.coalesce(*[F.when(a > 0, F.struct(F.lit(i).alias("attempt"), a.alias("value"))) for i, a in enumerate(attempts)], F.struct(F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("double").alias("value")))


def ms_date(text: Column) -> Column:
    """/Date(ms+zone)/ as an ISO day in UTC; years beyond four digits without a sign, those before 0 without padding."""
    ms = F.regexp_extract(text, "\\((-?[0-9]+)", 1).try_cast("bigint")
    day = F.date_from_unix_date(((ms - F.pmod(ms, F.lit(86_400_000))) / 86_400_000).cast("int"))
    year = F.year(day)
    return F.concat(F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string")), F.date_format(day, "-MM-dd"))


def commands(payload: Column) -> Column:
    """AJAX commands as a map from selector to data."""
    rows = F.from_json(payload, "array<struct<command:string,selector:string,data:string>>")
    return F.map_from_entries(F.transform(F.filter(rows, lambda c: c["selector"].isNotNull()), lambda c: F.struct(c["selector"], c["data"])))


def unnest_mile_rates(cards: DataFrame) -> DataFrame:
    """card -> tier -> feature -> map of rates, as flat rows."""
    tiers = cards.select("card", F.explode("tiers").alias("t"))
    features = tiers.select("card", F.col("t.tier").alias("tier"), F.explode("t.features").alias("f"))
    return features.select("card", "tier", F.col("f.feature").alias("feature"), F.explode("f.rates").alias("program", "rate"))
