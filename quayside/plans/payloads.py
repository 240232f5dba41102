"""Payloads of calculators, rate pages and option lists as rows of stated cases: one query for each way in which a provider states its figures."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import lookups
from ..sources import files, quotes
from .catalog import rule
from .documents import fold_sql

C = F.col
J = lambda c, p: F.get_json_object(c, p)
JS = lambda c, p: f"json_extract_string({c}, '{p}')"
TR = lambda e: f"coalesce(TRY_CAST(replace(replace(regexp_replace({e}, '[^0-9,.-]', '', 'g'), '.', ''), ',', '.') AS DOUBLE), 0)"
EN = lambda e: f"coalesce(TRY_CAST(regexp_replace({e}, '[^0-9.-]', '', 'g') AS DOUBLE), 0)"
CUR = lambda e: "coalesce(CASE upper(trim(" + e + ")) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CURRENCIES.items()) + f" END, upper(trim({e})))"
FOLD = lambda e: f"regexp_replace({fold_sql(e)}, '[^a-z0-9]', '', 'g')"
joined = lambda a: F.array_join(a, "|")
J_SQL = lambda e: f"array_to_string({e}, '|')"
num = lambda c: c.cast("decimal(18,4)").cast("string")
NUM = lambda e: f"CAST(CAST({e} AS DECIMAL(18,4)) AS VARCHAR)"

# ---- option lists ----
OPTION = "<option value='([{][^']*[}])'"
PAGES = [(k, p) for k, p in enumerate((
    "<select name='loan'><option value=''>-</option><option value='{\"code\":\"A1\",\"project\":\"p\",\"min\":\"1.000\",\"max\":\"50.000,50\"}'>Home</option><option value='{\"code\":\"A1\",\"project\":\"p\",\"min\":\"1.000\",\"max\":\"50.000,50\"}'>Home</option>"
    "<option value='{\"code\":\"B2\",\"project\":\"q\",\"min\":\"500\",\"max\":\"2.000\"}'>  Car\n loan </option><option value='{bad}'>x</option></select>",
    "<select name=\"loan\"><option value='{\"code\":\"C\",\"project\":\"\",\"min\":\"\",\"max\":\"9\"}'>One</option></select>", "<p>nothing</p>", "",
))]
rule("options_with_json", "Products in the values of options; those that can't be read are skipped, equal ones count once.", "id int, page string", PAGES,
     {"products": lambda: joined(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("page", F.lit(OPTION), F.lit(1)), lambda o: F.concat(J(o, "$.code"), F.lit(":"), J(o, "$.project"))), lambda x: x.isNotNull())))},
     {"products": f"(SELECT coalesce(string_agg(p, '|' ORDER BY n), '') FROM (SELECT p, min(n) AS n FROM (SELECT CASE WHEN json_valid(o) THEN {JS('o', '$.code')} || ':' || {JS('o', '$.project')} END AS p, n FROM (SELECT unnest(l) AS o, generate_subscripts(l, 1) AS n FROM (SELECT regexp_extract_all(page, '{OPTION.replace(chr(39), chr(39) * 2)}', 1) AS l))) WHERE p IS NOT NULL GROUP BY p))"})
envelope = lambda k, f: f(F.transform(F.filter(F.regexp_extract_all("page", F.lit(OPTION), F.lit(1)), lambda o: J(o, f"$.{k}").isNotNull()), lambda o: V.money(J(o, f"$.{k}"))))
rule("options_envelope", "The least of the lower and the greatest of the upper bounds.", "id int, page string", PAGES, {"low": lambda: envelope("min", F.array_min), "high": lambda: envelope("max", F.array_max)},
     {k: f"list_{f}(list_transform(list_filter(regexp_extract_all(page, '{OPTION.replace(chr(39), chr(39) * 2)}', 1), lambda o: json_valid(o)), lambda o: {TR(JS('o', '$.' + m))}))" for k, f, m in (("low", "min", "min"), ("high", "max", "max"))})
SELECT = [(k, p) for k, p in enumerate((
    "<select name='cur'><option value='1'>US Dollar (USD)</option><option value=\"\">-</option><option value=\"2\">  Euro <b>(EUR)</b></option></select><select name='x'><option value='9'>No</option></select>", "<select name='other'><option value='1'>a</option></select>", "",
))]
BODY = "regexp_extract(page, '(?is)<select[^>]*name=[\"'']cur[\"''][^>]*>(.*?)</select>', 1)"
OPT = "(?is)<option[^>]*value=[\"'']([^\"'']*)[\"''][^>]*>\\s*(.*?)\\s*</option>"
clean = "trim(regexp_replace(regexp_replace({e}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
pairs = lambda: F.filter(files.html_options(C("page"), "cur"), lambda o: o["value"] != "")
tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "\\s+", " "))
rule("select_pairs", "Value and label of the options of one named list.", "id int, page string", SELECT, {"options": lambda: joined(F.transform(files.html_options(C("page"), "cur"), lambda o: F.concat(o["value"], F.lit("="), tidy(o["label"]))))},
     {"options": f"(SELECT coalesce(string_agg(v || '=' || {clean.format(e='l')}, '|' ORDER BY n), '') FROM (SELECT unnest(regexp_extract_all({BODY}, '{OPT}', 1)) AS v, unnest(regexp_extract_all({BODY}, '{OPT}', 2)) AS l, generate_subscripts(regexp_extract_all({BODY}, '{OPT}', 1), 1) AS n))"})
rule("select_ids_by_name", "Ids of currencies by the code in their label.", "id int, page string", SELECT, {"ids": lambda: joined(F.transform(pairs(), lambda o: F.concat(F.regexp_extract(o["label"], "\\(([A-Z]{3})\\)", 1), F.lit(">"), o["value"])))},
     {"ids": f"(SELECT coalesce(string_agg(regexp_extract(l, '\\(([A-Z]{{3}})\\)', 1) || '>' || v, '|' ORDER BY n), '') FROM (SELECT unnest(regexp_extract_all({BODY}, '{OPT}', 1)) AS v, unnest(regexp_extract_all({BODY}, '{OPT}', 2)) AS l, generate_subscripts(regexp_extract_all({BODY}, '{OPT}', 1), 1) AS n) WHERE v <> '')"})
LIMITS = [("1=Home|2=Car", '{"1":{"min":"1.000","max":"9.000"},"3":{"min":"5"}}'), ("2=Car", "{}"), ("", '{"1":{}}')]
rule("options_with_limits", "Options beside the limits that another call gives; an option without limits stays.", "options string, limits string", LIMITS,
     {"products": lambda: joined(F.transform(F.filter(F.split("options", "\\|"), lambda o: o != ""), lambda o: F.concat(o, F.lit(":"), F.coalesce(F.try_element_at(F.from_json("limits", "map<string,struct<min:string,max:string>>"), F.substring_index(o, "=", 1))["min"], F.lit("-")))))},
     {"products": f"array_to_string(list_transform(list_filter(string_split(options, '|'), lambda o: o <> ''), lambda o: o || ':' || coalesce(json_extract_string(limits, '$.' || string_split(o, '=')[1] || '.min'), '-')), '|')"})
NESTED = [("{&quot;name&quot;:&quot;Time&quot;,&quot;bands&quot;:[{&quot;d&quot;:31,&quot;low&quot;:100},{&quot;d&quot;:92,&quot;low&quot;:50}]}",), ("{&quot;name&quot;:&quot;One&quot;,&quot;bands&quot;:[]}",)]
bands = lambda: F.from_json(F.replace("value", F.lit("&quot;"), F.lit('"')), "struct<name:string,bands:array<struct<d:int,low:int>>>")
B_SQL = "from_json(replace(value, '&quot;', '\"'), '{\"name\":\"VARCHAR\",\"bands\":[{\"d\":\"INTEGER\",\"low\":\"INTEGER\"}]}')"
rule("escaped_option_bands", "Escaped JSON in an option's value: the envelope over its bands.", "value string", NESTED, {"name": lambda: bands()["name"], "least_day": lambda: F.array_min(bands()["bands"]["d"]), "last_day": lambda: F.array_max(bands()["bands"]["d"]), "low": lambda: F.array_min(bands()["bands"]["low"])},
     {"name": f"{B_SQL}.name", "least_day": f"list_min(list_transform({B_SQL}.bands, lambda b: b.d))", "last_day": f"list_max(list_transform({B_SQL}.bands, lambda b: b.d))", "low": f"list_min(list_transform({B_SQL}.bands, lambda b: b.low))"})
rule("band_days", "The days of a product's bands.", "value string", NESTED, {"days": lambda: joined(bands()["bands"]["d"].cast("array<string>"))}, {"days": f"array_to_string(list_transform({B_SQL}.bands, lambda b: CAST(b.d AS VARCHAR)), '|')"})
rule("band_at_days", "The band of exactly so many days, or none.", "value string, days int", [(v[0], d) for v in NESTED for d in (31, 92, 60)], {"low": lambda: F.get(F.filter(bands()["bands"], lambda b: b["d"] == C("days")), F.lit(0))["low"]}, {"low": f"list_filter({B_SQL}.bands, lambda b: b.d = days)[1].low"})
TERMS = [("TL, usd ,EURO", "36|12|x|3|12 ay"), ("", "")]
rule("currencies_and_terms", "Currencies as shared symbols, terms as sorted whole numbers.", "currencies string, terms string", TERMS,
     {"symbols": lambda: joined(F.transform(F.filter(F.split("currencies", ","), lambda c: F.trim(c) != ""), V.currency)), "months": lambda: joined(F.array_sort(F.transform(F.filter(F.split("terms", "\\|"), lambda t: t.rlike("^[0-9]+$")), lambda t: t.cast("int"))).cast("array<string>"))},
     {"symbols": f"array_to_string(list_transform(list_filter(string_split(currencies, ','), lambda c: trim(c) <> ''), lambda c: {CUR('c')}), '|')", "months": "array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(terms, '|'), lambda t: regexp_matches(t, '^[0-9]+$')), lambda t: CAST(t AS INTEGER))), lambda t: CAST(t AS VARCHAR)), '|')"})
FEC = {"TRY": "0", "USD": "1", "EUR": "19", "XAU": "24"}
rule("currency_number", "A bank's own number of a currency.", "code string", [("TL",), ("usd",), ("ALT",), ("CHF",)], {"number": lambda: F.element_at(F.create_map(*[F.lit(x) for kv in FEC.items() for x in kv]), V.currency(C("code")))}, {"number": f"CASE {CUR('code')} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEC.items()) + " END"})
HOME = [("<div data-account=\"daily\">Daily account</div><div data-account=\"gold\">Gold</div>",), ("<p></p>",)]
rule("account_types", "Kinds of account named on a front page.", "page string", HOME, {"kinds": lambda: joined(F.regexp_extract_all("page", F.lit('data-account="([^"]*)"'), F.lit(1)))}, {"kinds": J_SQL("regexp_extract_all(page, 'data-account=\"([^\"]*)\"', 1)")})
PARAMS = [('[{"k":"cur","v":"TL"},{"k":"cur","v":"USD"},{"k":"min","v":"5"}]',), ("[]",)]
rule("repeated_params", "A list of keys and values as a map of lists.", "payload string", PARAMS,
     {"cur": lambda: joined(F.transform(F.filter(F.from_json("payload", "array<struct<k:string,v:string>>"), lambda p: p["k"] == "cur"), lambda p: p["v"])), "least": lambda: joined(F.transform(F.filter(F.from_json("payload", "array<struct<k:string,v:string>>"), lambda p: p["k"] == "min"), lambda p: p["v"]))},
     {k: f"array_to_string(list_transform(list_filter(from_json(payload, '[{{\"k\":\"VARCHAR\",\"v\":\"VARCHAR\"}}]'), lambda p: p.k = '{m}'), lambda p: p.v), '|')" for k, m in (("cur", "cur"), ("least", "min"))})
ENTRY = [("finance", '{"name":"Car","max":"100","cur":["TL"]}'), ("account", '{"name":"Time","max":"9","cur":["TL","USD"]}'), ("account", '{"name":"One","max":"9","cur":["TL"]}'), ("card", '{"name":"Gold"}')]
rule("product_of_entry", "A product of a category's entry; flat limits hold only where there is one currency.", "category string, entry string", ENTRY,
     {"name": lambda: J("entry", "$.name"), "high": lambda: F.when((C("category") == "finance") | (F.size(F.from_json(J("entry", "$.cur"), "array<string>")) == 1), J("entry", "$.max").cast("double"))},
     {"name": JS("entry", "$.name"), "high": f"CASE WHEN category = 'finance' OR json_array_length(entry, '$.cur') = 1 THEN CAST({JS('entry', '$.max')} AS DOUBLE) END"})

# ---- quotes ----
QUOTES = [(10000.0, 12, '{"instalment":"1.002,50","total":"12.030,00","fees":[{"n":"a","v":"10,5"},{"n":"b","v":"2"}]}'), (10000.0, 12, '{"instalment":"0","total":"0","fees":[]}'), (500.0, 3, '{"instalment":"150","total":"450"}'), (500.0, 3, "{}")]
fees = lambda: F.aggregate(F.transform(F.from_json(J("payload", "$.fees"), "array<struct<n:string,v:string>>"), lambda f: V.money(f["v"])), F.lit(0.0), lambda a, x: a + x)
rule("finance_quote", "Figures as text; an instalment of zero is a refusal, and so is a total that isn't above the amount.", "amount double, term int, payload string", QUOTES,
     {"instalment": lambda: V.money(F.coalesce(J("payload", "$.instalment"), F.lit(""))), "fees": lambda: F.coalesce(fees(), F.lit(0.0)), "refused": lambda: F.when(V.money(F.coalesce(J("payload", "$.instalment"), F.lit(""))) <= 0, "no quote").when(V.money(J("payload", "$.total")) <= C("amount"), "total not above amount")},
     {"instalment": TR(f"coalesce({JS('payload', '$.instalment')}, '')"), "fees": f"coalesce(list_sum(list_transform(from_json(json_extract(payload, '$.fees'), '[{{\"n\":\"VARCHAR\",\"v\":\"VARCHAR\"}}]'), lambda f: {TR('f.v')})), 0)", "refused": f"CASE WHEN {TR(f'coalesce({JS(chr(112) + 'ayload', '$.instalment')}, {chr(39) * 2})')} <= 0 THEN 'no quote' WHEN {TR(JS('payload', '$.total'))} <= amount THEN 'total not above amount' END"})
GATED = [('{"ok":true,"monthlyInterest":"250,75"}', "<b>Annual</b> % 42,5"), ('{"ok":false,"monthlyInterest":"250"}', "% 1"), ('{"ok":true,"monthlyInterest":"0"}', "")]
rule("flagged_quote", "A field with another name holds the instalment; the flag decides; the yearly rate stands in the plan's text.", "payload string, plan string", GATED,
     {"instalment": lambda: F.when((J("payload", "$.ok") == "true") & (V.money(J("payload", "$.monthlyInterest")) > 0), V.money(J("payload", "$.monthlyInterest"))), "yearly": lambda: V.rate(F.regexp_extract("plan", "%\\s*([0-9.,]+)", 1))},
     {"instalment": f"CASE WHEN {JS('payload', '$.ok')} = 'true' AND {TR(JS('payload', '$.monthlyInterest'))} > 0 THEN {TR(JS('payload', '$.monthlyInterest'))} END", "yearly": TR("regexp_extract(plan, '%\\s*([0-9.,]+)', 1)")})
ROWS = [('[{"Amount":"1.100,10"},{"Amount":"1.100,00"}]',), ("[]",)]
rule("first_row_instalment", "The instalment is read from the plan's first row, never divided out.", "plan string", ROWS, {"instalment": lambda: V.money(J("plan", "$[0].Amount")), "n": lambda: F.size(F.from_json("plan", "array<struct<Amount:string>>"))}, {"instalment": TR(JS("plan", "$[0].Amount")), "n": "CAST(json_array_length(plan) AS INTEGER)"})
TAXED = [('[{"n":1,"kkdf":"10,5","bsmv":"2,1"},{"n":2,"kkdf":"1","bsmv":""}]',), ("[]",)]
rule("taxes_of_rows", "Two taxes in one field of the schedule.", "plan string", TAXED, {"taxes": lambda: joined(F.transform(F.from_json("plan", "array<struct<n:int,kkdf:string,bsmv:string>>"), lambda r: num(V.money(r["kkdf"]) + V.money(r["bsmv"]))))},
     {"taxes": f"array_to_string(list_transform(from_json(plan, '[{{\"n\":\"INTEGER\",\"kkdf\":\"VARCHAR\",\"bsmv\":\"VARCHAR\"}}]'), lambda r: {NUM(TR('r.kkdf') + ' + ' + TR('r.bsmv'))}), '|')"})
TRIES = [('[{"unit":"day","net":"0"},{"unit":"month","net":"12,5"}]',), ('[{"unit":"day","net":"0"}]',), ("[]",), ('[{"unit":"day","net":"3"},{"unit":"month","net":"9"}]',)]
tries = lambda: F.from_json("attempts", "array<struct<unit:string,net:string>>")
T_SQL = "from_json(attempts, '[{\"unit\":\"VARCHAR\",\"net\":\"VARCHAR\"}]')"
rule("first_paying_attempt", "Units tried in order, the first that pays; accepted at zero is another thing than not offered.", "attempts string", TRIES,
     {"unit": lambda: F.get(F.filter(tries(), lambda a: V.money(a["net"]) > 0), F.lit(0))["unit"], "reason": lambda: F.when(F.size(tries()) == 0, "not offered").when(~F.exists(tries(), lambda a: V.money(a["net"]) > 0), "accepted at zero")},
     {"unit": f"list_filter({T_SQL}, lambda a: {TR('a.net')} > 0)[1].unit", "reason": f"CASE WHEN len({T_SQL}) = 0 THEN 'not offered' WHEN len(list_filter({T_SQL}, lambda a: {TR('a.net')} > 0)) = 0 THEN 'accepted at zero' END"})
UNITS = [(u, t) for u in ("day", "month", "") for t in (32, 3)]
rule("units_to_try", "Units in which a term is asked for.", "unit string, term int", UNITS, {"units": lambda: F.when(C("unit") == "day", "day").when(C("unit") == "month", "month|day").otherwise("day|month")}, {"units": "CASE unit WHEN 'day' THEN 'day' WHEN 'month' THEN 'month|day' ELSE 'day|month' END"})
rule("days_to_try", "Numbers of days that a term may mean.", "unit string, term int", UNITS, {"days": lambda: F.when(C("unit") == "month", F.concat_ws("|", (C("term") * 30).cast("string"), (C("term") * 30 + 1).cast("string"), (C("term") * 30 + 2).cast("string"))).otherwise(C("term").cast("string"))}, {"days": "CASE unit WHEN 'month' THEN concat_ws('|', term * 30, term * 30 + 1, term * 30 + 2) ELSE CAST(term AS VARCHAR) END"})
NEAR = [(d,) for d in (28, 30, 31, 60, 92, 180, 363, 400, 36)]
BANDS = [31, 91, 180, 364, 366]
near_sql = f"(SELECT CASE WHEN days >= 366 OR off <= 0.15 * days THEN b END FROM (SELECT b, abs(b - days) AS off FROM (SELECT unnest({BANDS}) AS b)) ORDER BY off, b LIMIT 1)"
rule("nearest_term_band", "The band nearest to a term, within 15 % of it; past the last one, the last.", "days int", NEAR, {"band": lambda: _near(C("days"))}, {"band": near_sql})
PAYS = [(31, '{"31":"4,5","92":"0"}'), (90, '{"31":"4,5","91":"0"}'), (60, "{}")]
rule("band_then_rate", "First the band, then its rate; a rate of zero is none.", "days int, rates string", PAYS, {"rate": lambda: F.nullif(V.rate(F.coalesce(F.element_at(F.from_json("rates", "map<string,string>"), _near(C("days")).cast("string")), F.lit("0"))), F.lit(0.0))},
     {"rate": f"nullif({TR('coalesce(json_extract_string(rates, ' + chr(39) + '$.' + chr(39) + ' || ' + near_sql + '), ' + chr(39) + '0' + chr(39) + ')')}, 0)"})
SAVES = [("TRY", 50000.0, 32, 1200.0, 40.0), ("USD", 50000.0, 32, 1.0, 1.0), ("TRY", 49999.0, 32, 1.0, 1.0), ("TRY", 60000.0, 31, 1.0, 1.0), ("TRY", 100000.0, 90, 9000.0, 40.0), ("TRY", 100000.0, 90, 90.0, 40.0)]
implied = "amount * yearly / 100 * days / 365"
rule("account_gate", "One currency, a least amount and term; a profit that contradicts the stated rate is refused.", "currency string, amount double, days int, net double, yearly double", SAVES,
     {"reason": lambda: F.when(C("currency") != "TRY", "currency").when(C("amount") < 50000, "amount").when(C("days") < 32, "term").when(F.abs(C("net") - F.expr(implied)) > 0.15 * F.expr(implied), "contradiction")},
     {"reason": f"CASE WHEN currency <> 'TRY' THEN 'currency' WHEN amount < 50000 THEN 'amount' WHEN days < 32 THEN 'term' WHEN abs(net - {implied}) > 0.15 * ({implied}) THEN 'contradiction' END"})
CARDS = [(1000.0, 6, '{"rate":"4,25","pay":"190,5"}', '<input id="rate" value="3,99">'), (1000.0, 3, '{"rate":"0","pay":"0"}', "<input>")]
rule("card_quote", "Payment and rate of a card's plan; nothing where the payment is zero.", "amount double, n int, payload string, page string", CARDS, {"payment": lambda: F.nullif(V.money(J("payload", "$.pay")), F.lit(0.0)), "total": lambda: F.nullif(V.money(J("payload", "$.pay")), F.lit(0.0)) * C("n")}, {"payment": f"nullif({TR(JS('payload', '$.pay'))}, 0)", "total": f"nullif({TR(JS('payload', '$.pay'))}, 0) * n"})
rule("card_rate_of_page", "A rate in an input of the page, without a payment.", "amount double, n int, payload string, page string", CARDS, {"rate": lambda: F.nullif(V.rate(F.regexp_extract("page", 'value="([^"]*)"', 1)), F.lit(0.0)), "payment": lambda: F.lit(None).cast("double")}, {"rate": f"nullif({TR('regexp_extract(page, ' + chr(39) + 'value=\"([^\"]*)\"' + chr(39) + ', 1)')}, 0)", "payment": "CAST(NULL AS DOUBLE)"})
rule("refusal_with_ratio", "Always a refusal, which names the published ratio.", "ratio double", [(85.0,), (0.5,), (None,)], {"reason": lambda: F.concat(F.lit("no calculator; published ratio "), F.coalesce(num(C("ratio")), F.lit("unknown")))}, {"reason": f"'no calculator; published ratio ' || coalesce({NUM('ratio')}, 'unknown')"})
TABLE = [('[{"n":3,"r":"4,1"},{"n":6,"r":"4,2"}]', 6), ('[{"n":3,"r":"4,1"}]', 12), ("[]", 3)]
table_of = lambda: F.map_from_entries(F.transform(F.from_json("rates", "array<struct<n:int,r:string>>"), lambda x: F.struct(x["n"], V.rate(x["r"]))))
TB = "from_json(rates, '[{\"n\":\"INTEGER\",\"r\":\"VARCHAR\"}]')"
rule("rate_table", "Monthly rates by number of instalments.", "rates string, term int", TABLE, {"n_rates": lambda: F.size(table_of()), "terms": lambda: joined(F.array_sort(F.map_keys(table_of())).cast("array<string>"))}, {"n_rates": f"CAST(len({TB}) AS INTEGER)", "terms": f"array_to_string(list_transform(list_sort(list_transform({TB}, lambda x: x.n)), lambda n: CAST(n AS VARCHAR)), '|')"})
rule("rate_by_term", "The rate of a term, or none.", "rates string, term int", TABLE, {"rate": lambda: F.try_element_at(table_of(), C("term"))}, {"rate": f"(SELECT {TR('x.r')} FROM (SELECT unnest({TB}) AS x) WHERE x.n = term)"})
RANGES = [(6, '[{"Min":1,"Max":12,"R":"4"},{"Min":13,"Max":36,"R":"3,5"}]', None), (24, '[{"Min":1,"Max":12,"R":"4"},{"Min":13,"Max":36,"R":"3,5"}]', 3.1), (48, '[{"Min":1,"Max":12,"R":"4"}]', None)]
RB = "from_json(bands, '[{\"Min\":\"INTEGER\",\"Max\":\"INTEGER\",\"R\":\"VARCHAR\"}]')"
rbands = lambda: F.from_json("bands", "array<struct<Min:int,Max:int,R:string>>")
rule("band_bounds", "The envelope of a credit's bands.", "term int, bands string, own double", RANGES, {"low": lambda: F.array_min(rbands()["Min"]), "high": lambda: F.array_max(rbands()["Max"])}, {"low": f"list_min(list_transform({RB}, lambda b: b.Min))", "high": f"list_max(list_transform({RB}, lambda b: b.Max))"})
rule("band_rate", "The first band that holds the term; a customer's own rate wins.", "term int, bands string, own double", RANGES, {"rate": lambda: F.coalesce("own", V.rate(F.get(F.filter(rbands(), lambda b: C("term").between(b["Min"], b["Max"])), F.lit(0))["R"]))},
     {"rate": f"coalesce(own, CASE WHEN len(list_filter({RB}, lambda b: term BETWEEN b.Min AND b.Max)) > 0 THEN {TR(f'list_filter({RB}, lambda b: term BETWEEN b.Min AND b.Max)[1].R')} ELSE 0 END)"})
NAMED = [("Time", 1000.0, 32), ("Gold", 0.0, 180)]
rule("name_of_band", "A product's name that states its band and least amount.", "name string, low double, days int", NAMED, {"title": lambda: F.concat(C("name"), F.lit(" "), C("days").cast("string"), F.lit(" days, from "), num(C("low")))}, {"title": f"name || ' ' || days || ' days, from ' || {NUM('low')}"})
USABLE = [("",), ("{}",), ('{"errorMessage":"closed"}',), ('{"pay":"5"}',)]
rule("usable_payload", "An empty body is an empty object; an error message is a refusal.", "body string", USABLE, {"usable": lambda: F.when(C("body") == "", "{}").when(J("body", "$.errorMessage").isNull(), C("body")), "refused": lambda: J(F.when(C("body") == "", "{}").otherwise(C("body")), "$.errorMessage")},
     {"usable": "CASE WHEN body = '' THEN '{}' WHEN json_extract_string(CASE WHEN body = '' THEN '{}' ELSE body END, '$.errorMessage') IS NULL THEN body END", "refused": "json_extract_string(CASE WHEN body = '' THEN '{}' ELSE body END, '$.errorMessage')"})
LISTS = [("3|6|12",), ("24",), ("",)]
rule("first_and_last_term", "The least and the greatest term are the list's ends.", "terms string", LISTS, {"low": lambda: F.get(F.split("terms", "\\|"), F.lit(0)).try_cast("int"), "high": lambda: F.element_at(F.split("terms", "\\|"), -1).try_cast("int")}, {"low": "TRY_CAST(string_split(terms, '|')[1] AS INTEGER)", "high": "TRY_CAST(string_split(terms, '|')[-1] AS INTEGER)"})
rule("text_quote", "Amounts and rates that come as text.", "pay string, rate string", [("1.234,56 TL", "% 3,99"), ("", "x")], {"instalment": lambda: V.money(C("pay")), "monthly": lambda: V.rate(C("rate"))}, {"instalment": TR("pay"), "monthly": f"CASE WHEN contains(rate, ',') THEN {TR('rate')} ELSE {EN('rate')} END"})
PLANS = [(100.0, '[{"n":1,"p":"60"},{"n":2,"p":"60"}]'), (100.0, '{"error":"busy"}'), (100.0, None)]
rule("quote_without_plan", "A plan that can't be had leaves an empty schedule, and the quote stands.", "pay double, plan string", PLANS, {"n_rows": lambda: F.coalesce(F.size(F.from_json(F.when(C("plan").startswith("["), C("plan")), "array<struct<n:int,p:string>>")), F.lit(0))}, {"n_rows": "CASE WHEN starts_with(plan, '[') THEN CAST(json_array_length(plan) AS INTEGER) ELSE 0 END"})
FIGURES = [(10000.0, "Amount 10.000,40 TL; monthly 950,10 TL; total 11.401,20 TL"), (10000.0, "Amount 9.000,00 TL; monthly 950,10 TL; total 11.401,20 TL"), (5.0, "nothing")]
figs = lambda: F.transform(F.regexp_extract_all("prose", F.lit("([0-9.]+,[0-9]{2})"), F.lit(1)), V.money)
FG = f"list_transform(regexp_extract_all(prose, '([0-9.]+,[0-9]{{2}})', 1), lambda x: {TR('x')})"
rule("figures_in_order", "Amount, instalment, total in the order of the prose; the first has to be the request, within one.", "amount double, prose string", FIGURES, {"instalment": lambda: F.when(F.abs(F.get(figs(), F.lit(0)) - C("amount")) <= 1, F.get(figs(), F.lit(1))), "total": lambda: F.when(F.abs(F.get(figs(), F.lit(0)) - C("amount")) <= 1, F.get(figs(), F.lit(2)))},
     {"instalment": f"CASE WHEN abs({FG}[1] - amount) <= 1 THEN {FG}[2] END", "total": f"CASE WHEN abs({FG}[1] - amount) <= 1 THEN {FG}[3] END"})
AJAX = [('[{"command":"insert","selector":".net","data":"12,5"},{"command":"settings","data":"x"},{"command":"insert","selector":".gross","data":"20"}]',), ('[{"command":"insert","selector":".net","data":"0"}]',), ('[{"command":"insert","selector":"#plan","data":""},{"command":"insert","selector":"#plan2","data":"<table>"}]',), ("[]",)]
CM = "from_json(payload, '[{\"command\":\"VARCHAR\",\"selector\":\"VARCHAR\",\"data\":\"VARCHAR\"}]')"
rule("commands_by_selector", "Commands of a page's script as a map from selector to data.", "payload string", AJAX, {"fields": lambda: joined(F.transform(F.map_entries(quotes.commands(C("payload"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))}, {"fields": f"array_to_string(list_transform(list_filter({CM}, lambda c: c.selector IS NOT NULL), lambda c: c.selector || '=' || c.data), '|')"})
rule("account_quote_by_selector", "A field found by its selector; zero is no rate.", "payload string", AJAX, {"net": lambda: F.nullif(V.money(F.coalesce(F.try_element_at(quotes.commands(C("payload")), F.lit(".net")), F.lit(""))), F.lit(0.0))}, {"net": f"nullif({TR(f'coalesce(list_filter({CM}, lambda c: c.selector = {chr(39)}.net{chr(39)})[1].data, {chr(39) * 2})')}, 0)"})
rule("first_insert", "The first insertion that brings markup.", "payload string", AJAX, {"markup": lambda: F.get(F.filter(F.from_json("payload", "array<struct<command:string,selector:string,data:string>>"), lambda c: (c["command"] == "insert") & (c["data"] != "")), F.lit(0))["data"]}, {"markup": f"list_filter({CM}, lambda c: c.command = 'insert' AND c.data <> '')[1].data"})
rule("name_without_terms", "A product's name without its band of terms.", "name string", [("Home (12-36 months)",), ("Car 3 - 12 months",), ("Gold",)], {"stem": lambda: F.trim(F.regexp_replace("name", "\\(?[0-9]+\\s*-\\s*[0-9]+ months\\)?", ""))}, {"stem": "trim(regexp_replace(name, '\\(?[0-9]+\\s*-\\s*[0-9]+ months\\)?', ''))"})

# ---- plans as tables ----
PLAN = [("<table><tr><th>Taksit Tutarı</th><th>Ana Para</th><th>Kâr</th><th>Kalan</th></tr><tr><td>1.000,50</td><td>900</td><td>100,50</td><td>900</td></tr><tr><td>1.000,50</td><td>900</td><td>100,50</td><td>0</td></tr></table>",),
        ("<table><tr><th>Kalan</th><th>Kâr</th><th>Ana Para</th><th>Taksit Tutarı</th></tr><tr><td>5</td><td>1</td><td>9</td><td>10</td></tr><tr><td>-</td><td>-</td><td>-</td><td>-</td></tr></table>",), ("<p>no plan</p>",)]
HEADERS = {"payment": "Taksit Tutarı", "principal": "Ana Para", "profit": "Kâr", "remaining": "Kalan"}
CELLS = "regexp_extract_all({r}, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1)"
TRS = "regexp_extract_all(regexp_extract(page, '(?is)<table[^>]*>(.*?)</table>', 1), '(?is)<tr[^>]*>(.*?)</tr>', 1)"
at = lambda h: f"{CELLS.format(r='r')}[list_position(list_transform({CELLS.format(r=TRS + '[1]')}, lambda h: {FOLD('h')}), '{h}')]"
plan_sql = f"(SELECT coalesce(string_agg({NUM(TR(at('taksittutari')))} || '/' || {NUM(TR(at('anapara')))} || '/' || {NUM(TR(at('kar')))} || '/' || {NUM(TR(at('kalan')))}, '|' ORDER BY n), '') FROM (SELECT unnest({TRS}[2:]) AS r, generate_subscripts({TRS}[2:], 1) AS n) WHERE {TR(at('taksittutari'))} > 0)"
shown = lambda: joined(F.transform(quotes.schedule_from_html(C("page"), HEADERS), lambda r: F.concat_ws("/", *[num(r[k]) for k in HEADERS])))
rule("plan_by_header", "A plan's columns are found by their folded headers, not by place; rows without a payment drop out.", "page string", PLAN, {"rows": shown}, {"rows": plan_sql}, costly=True)
rule("plan_row_count", "How many payments a plan's table has.", "page string", PLAN, {"n": lambda: F.size(quotes.schedule_from_html(C("page"), HEADERS))}, {"n": f"CAST((SELECT count(*) FROM (SELECT unnest({TRS}[2:]) AS r) WHERE {TR(at('taksittutari'))} > 0) AS INTEGER)"}, costly=True)
DETAIL = [("<li><b>Toplam Tutar</b><i>12.000,50</i></li><li><b>Yıllık Oran</b><i>% 45,1</i></li>",), ("<li><b>Oran</b><i>3</i></li>",)]
LI = lambda n: f"regexp_extract_all(page, '<b>(.*?)</b><i>(.*?)</i>', {n})"
rule("plan_detail", "The value beside a folded label.", "page string", DETAIL, {"value": lambda: F.try_element_at(F.map_from_arrays(F.transform(F.regexp_extract_all("page", F.lit("<b>(.*?)</b><i>(.*?)</i>"), F.lit(1)), X.fold), F.regexp_extract_all("page", F.lit("<b>(.*?)</b><i>(.*?)</i>"), F.lit(2))), F.lit("yillikoran"))}, {"value": f"{LI(2)}[list_position(list_transform({LI(1)}, lambda l: {FOLD('l')}), 'yillikoran')]"})

# ---- rates and conversions ----
RATES = [('[{"c":"TL","b":"1,5","s":"2"},{"c":"ALT (gr)","b":"4.000,5","s":"4.100"},{"c":"USD","b":"0","s":"2"}]',), ("[]",)]
rated = lambda: quotes.rates_from_json(C("payload"), "array<struct<c:string,b:string,s:string>>", "", "c", "c", "b", "s")
RT = "from_json(payload, '[{\"c\":\"VARCHAR\",\"b\":\"VARCHAR\",\"s\":\"VARCHAR\"}]')"
UNIT = lambda e: f"CASE WHEN contains(upper({e}), '(GR)') OR upper({e}) IN ('XAU', 'XAG', 'XPT', 'ALT') THEN 'gram' WHEN contains(upper({e}), 'COIN') OR contains(upper({e}), 'CEYREK') THEN 'coin' ELSE '1' END"
rule("rates_of_json", "Rates of an array; entries without two positive prices drop out.", "payload string", RATES, {"rates": lambda: joined(F.transform(rated(), lambda r: F.concat_ws(":", r["code"], num(r["buy"]), num(r["sell"]))))}, {"rates": f"array_to_string(list_transform(list_filter({RT}, lambda r: {TR('r.b')} > 0 AND {TR('r.s')} > 0), lambda r: concat_ws(':', {CUR('r.c')}, {NUM(TR('r.b'))}, {NUM(TR('r.s'))})), '|')"})
rule("rate_units", "Grams, coins or ones by the shape of the code.", "code string", [(c,) for c in ("USD", "ALT (gr)", "XAU", "Ceyrek altin", "GOLDCOIN", "alt")], {"unit": lambda: quotes.rate_unit(C("code"))}, {"unit": UNIT("code")})
rule("rates_with_units", "The same rates with their units.", "payload string", RATES, {"units": lambda: joined(F.transform(rated(), lambda r: F.concat_ws(":", r["code"], r["unit"])))}, {"units": f"array_to_string(list_transform(list_filter({RT}, lambda r: {TR('r.b')} > 0 AND {TR('r.s')} > 0), lambda r: {CUR('r.c')} || ':' || {UNIT('r.c')}), '|')"})
BOARD = [("<table><tr><th>x</th></tr><tr><td>US Dollar (USD)</td><td>1,234.50</td><td>1,250.00</td></tr><tr><td>Euro (EUR)</td><td>0</td><td>9</td></tr><tr><td>GBP - Pound</td><td>50.1</td><td>51</td></tr></table>",), ("<p></p>",)]
ROW3 = f"list_filter(list_transform({TRS}, lambda r: list_transform({CELLS.format(r='r')}, lambda c: {clean.format(e='c')})), lambda r: len(r) >= 3)"
CODE = "coalesce(nullif(regexp_extract(r[1], '\\(([A-Z]{3})\\)', 1), ''), regexp_extract(r[1], '^([A-Z]{3})\\b', 1))"
page_rates = f"list_filter({ROW3}, lambda r: {CODE} <> '' AND {EN('r[2]')} > 0 AND {EN('r[3]')} > 0)"
rule("rates_of_page", "Rows of a page's table: the code in brackets or in front, prices written the English way.", "page string", BOARD, {"rates": lambda: joined(F.transform(quotes.rates_from_table(C("page"), V.money_en), lambda r: F.concat_ws(":", r["code"], num(r["buy"]), num(r["sell"]))))}, {"rates": f"array_to_string(list_transform({page_rates}, lambda r: concat_ws(':', {CODE}, {NUM(EN('r[2]'))}, {NUM(EN('r[3]'))})), '|')"})
rule("rate_names_of_page", "Code and name of a label.", "label string", [("USD - US Dollar",), ("EUR",), ("X - Y - Z",)], {"code": lambda: F.trim(F.split("label", " - ", 2)[0]), "name": lambda: F.get(F.split("label", " - ", 2), F.lit(1))}, {"code": "trim(string_split(label, ' - ')[1])", "name": "CASE WHEN contains(label, ' - ') THEN substr(label, strpos(label, ' - ') + 3) END"})
rule("three_cell_rows", "Only rows of exactly three filled cells are rates.", "page string", BOARD, {"n": lambda: F.size(F.filter(files.html_rows(C("page")), lambda r: (F.size(r) == 3) & ~F.array_contains(r, "")))}, {"n": f"CAST(len(list_filter(list_transform({TRS}, lambda r: list_transform({CELLS.format(r='r')}, lambda c: {clean.format(e='c')})), lambda r: len(r) = 3 AND NOT list_contains(r, ''))) AS INTEGER)"})
FEEDS = [("USD:40|EUR:44", "USD:39|GBP:50", "2026-01-02T10:00"), ("", "USD:1", "t"), ("XAU:1", "", "t")]
items = lambda c: F.filter(F.split(c, "\\|"), lambda x: x != "")
IT = lambda c: f"list_filter(string_split({c}, '|'), lambda x: x <> '')"
code_of = lambda x: F.substring_index(x, ":", 1)
rest = lambda: F.filter(items("page"), lambda x: ~F.array_contains(F.transform(items("feed"), code_of), code_of(x)))
REST = f"list_filter({IT('page')}, lambda x: NOT list_contains(list_transform({IT('feed')}, lambda y: string_split(y, ':')[1]), string_split(x, ':')[1]))"
rule("feed_then_page", "A feed's rates, then the page's for codes that the feed lacks.", "feed string, page string, stamp string", FEEDS, {"rates": lambda: joined(F.concat(items("feed"), rest()))}, {"rates": f"array_to_string(list_concat({IT('feed')}, {REST}), '|')"})
rule("feed_stamp_for_all", "The feed's time stands on all rows.", "feed string, page string, stamp string", FEEDS, {"stamped": lambda: joined(F.transform(F.concat(items("feed"), rest()), lambda x: F.concat(x, F.lit("@"), C("stamp"))))}, {"stamped": f"array_to_string(list_transform(list_concat({IT('feed')}, {REST}), lambda x: x || '@' || stamp), '|')"})
METALS = [("XAU", "gram", "TRY", 4000.0), ("XAU", "ounce", "USD", 2400.0), ("XAG", "gram", "TRY", 0.0)]
rule("metal_identity", "Grams and ounces of one metal are rates of their own, by unit and quoting currency; prices that aren't positive drop out.", "code string, unit string, quoted string, price double", METALS, {"key": lambda: F.when(C("price") > 0, F.concat_ws("/", "code", "unit", "quoted"))}, {"key": "CASE WHEN price > 0 THEN concat_ws('/', code, unit, quoted) END"})
CONVERT = [(100.0, '{"from":"100.00","to":"2.45"}'), (100.0, '{"from":"99.5","to":"2.4"}'), (10.5, '{"from":"10.5","to":"1"}'), (100.0, '{"to":"0"}')]
rule("conversion_checked", "Whole amounts only, and the answer has to repeat the amount within a hundredth.", "amount double, payload string", CONVERT,
     {"got": lambda: F.when((C("amount") == F.floor("amount")) & (F.abs(J("payload", "$.from").cast("double") - C("amount")) <= 0.01), J("payload", "$.to").cast("double"))},
     {"got": f"CASE WHEN amount = floor(amount) AND abs(CAST({JS('payload', '$.from')} AS DOUBLE) - amount) <= 0.01 THEN CAST({JS('payload', '$.to')} AS DOUBLE) END"})
rule("conversion_of_json", "A conversion as the server states it.", "amount double, payload string", CONVERT, {"result": lambda: F.nullif(J("payload", "$.to").cast("double"), F.lit(0.0))}, {"result": f"nullif(CAST({JS('payload', '$.to')} AS DOUBLE), 0)"})
IDS = [("USD", "EUR", 100.0, 91.5), ("USD", "USD", 100.0, 0.0), ("USD", "XXX", 100.0, 1.0)]
known = {"USD": 1, "EUR": 2}
rule("conversion_by_ids", "The same currency is itself; an unknown one is refused; the rate is what is got over what is given, as decimals.", "source string, target string, given double, got double", IDS,
     {"rate": lambda: F.when(C("source") == C("target"), F.lit(1.0)).when(C("source").isin(*known) & C("target").isin(*known), F.round(C("got") / C("given"), 8))},
     {"rate": f"CASE WHEN source = target THEN 1.0 WHEN source IN {tuple(known)} AND target IN {tuple(known)} THEN round(got / given, 8) END"})
MILES = [('{"card":"Gold","tiers":[{"t":"A","features":[{"f":"travel","rates":{"m":1.5,"n":2}}]},{"t":"B","features":[]}]}',)]
rule("mile_rates", "Card, tier, feature and programme, four levels unnested.", "payload string", MILES,
     {"flat": lambda: joined(F.flatten(F.transform(F.from_json("payload", _MILES)["tiers"], lambda t: F.flatten(F.transform(t["features"], lambda f: F.transform(F.map_entries(f["rates"]), lambda e: F.concat_ws(":", J("payload", "$.card"), t["t"], f["f"], e["key"], num(e["value"]))))))))},
     {"flat": f"(SELECT string_agg(concat_ws(':', {JS('payload', '$.card')}, {JS('t', '$.t')}, {JS('f', '$.f')}, k, {NUM('CAST(json_extract_string(f, ' + chr(39) + '$.rates.' + chr(39) + ' || k) AS DOUBLE)')}), '|' ORDER BY k) FROM (SELECT unnest(from_json(json_extract(payload, '$.tiers'), '[\"JSON\"]')) AS t), LATERAL (SELECT unnest(from_json(json_extract(t, '$.features'), '[\"JSON\"]')) AS f), LATERAL (SELECT unnest(json_keys(f, '$.rates')) AS k))"})
_MILES = "struct<card:string,tiers:array<struct<t:string,features:array<struct<f:string,rates:map<string,double>>>>>>"


def _near(days: Column) -> Column:
    """As operators.lookups.nearest_band, for one column."""
    return lookups.nearest(days, BANDS)


TOKENS = [('<input name="token" type="hidden" value="a+b/c=">',), ('<meta name="token" content="q">',), ("<p>",)]
rule("page_token", "The token that a form wants back.", "page string", TOKENS, {"token": lambda: F.nullif(F.regexp_extract("page", 'name="token"[^>]*(?:value|content)="([^"]*)"', 1), F.lit(""))}, {"token": "nullif(regexp_extract(page, 'name=\"token\"[^>]*(?:value|content)=\"([^\"]*)\"', 1), '')"})
RETRY = [('{"code":0,"data":1}',), ('{"code":503}',), ("<html>",)]
rule("retry_on_body", "A body whose content says that it should be asked for again.", "body string", RETRY, {"again": lambda: F.coalesce(J("body", "$.code") != "0", F.lit(True))}, {"again": "CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.code') <> '0', true) ELSE true END"})
INFO = [("Title:  A b\nPages: 3\nEncrypted: no",), ("",)]
rule("document_info", "Lines of key and value.", "out string", INFO, {"pages": lambda: F.trim(F.regexp_extract("out", "(?m)^Pages:\\s*(.*)$", 1)), "title": lambda: F.trim(F.regexp_extract("out", "(?m)^Title:\\s*(.*)$", 1))}, {"pages": "trim(regexp_extract(out, '(?m)^Pages:\\s*(.*)$', 1))", "title": "trim(regexp_extract(out, '(?m)^Title:\\s*(.*)$', 1))"})
MAPS = [("<urlset><url><loc> https://h/a?x=1&amp;y=2 </loc></url><url><LOC>https://h/b</LOC></url><url><loc>https://h/c</urlset>",), ("",)]
rule("sitemap_locations", "Locations of a site map, however badly it is made.", "xml string", MAPS, {"locations": lambda: joined(files.sitemap_locations(C("xml")))}, {"locations": "array_to_string(list_transform(regexp_extract_all(xml, '(?is)<loc>\\s*(.*?)\\s*</loc>', 1), lambda u: replace(u, '&amp;', '&')), '|')"})
MARKUP = [('<a href="/a.pdf?x=1">A</a><a href="b.DOCX">B</a><img src="/i.png"><img src="data:x"><img src="/t/pixel.gif"><img src="/i.png"><a href="/page">P</a>',), ("",)]
rule("document_links", "Links to documents by suffix, each once.", "page string", MARKUP, {"links": lambda: joined(F.array_distinct(F.regexp_extract_all("page", F.lit('(?i)href="([^"]+\\.(?:pdf|docx?|xlsx?|pptx?|csv|rtf)(?:\\?[^"]*)?)"'), F.lit(1))))}, {"links": "array_to_string(regexp_extract_all(page, '(?i)href=\"([^\"]+\\.(?:pdf|docx?|xlsx?|pptx?|csv|rtf)(?:\\?[^\"]*)?)\"', 1), '|')"})
rule("content_images", "Images that are content, each once.", "page string", MARKUP, {"images": lambda: joined(F.array_distinct(F.filter(F.regexp_extract_all("page", F.lit('<img[^>]*src="([^"]*)"'), F.lit(1)), lambda u: ~u.rlike("^data:|pixel|\\.svg$"))))},
     {"images": "(SELECT coalesce(string_agg(u, '|' ORDER BY n), '') FROM (SELECT u, min(n) AS n FROM (SELECT unnest(l) AS u, generate_subscripts(l, 1) AS n FROM (SELECT regexp_extract_all(page, '<img[^>]*src=\"([^\"]*)\"', 1) AS l)) WHERE NOT regexp_matches(u, '^data:|pixel|\\.svg$') GROUP BY u))"})
rule("pdf_links_in_text", "PDF links of markdown without their queries.", "text string", [("see [a](https://h/a.pdf?x=1) and [b](https://h/b.html), [c](https://h/c.PDF)",), ("",)], {"links": lambda: joined(F.transform(F.regexp_extract_all("text", F.lit("(?i)\\]\\((https?://[^)]+\\.pdf[^)]*)\\)"), F.lit(1)), lambda u: F.regexp_replace(u, "\\?.*$", "")))}, {"links": "array_to_string(list_transform(regexp_extract_all(text, '(?i)\\]\\((https?://[^)]+\\.pdf[^)]*)\\)', 1), lambda u: regexp_replace(u, '\\?.*$', '')), '|')"})
rule("text_pages", "Pages of a text layer, parted by form feeds.", "id int, text string", [(1, "a\x0cb\x0c"), (2, ""), (3, "one")], {"n": lambda: F.size(F.split("text", "\x0c")), "first": lambda: F.get(F.split("text", "\x0c"), F.lit(0))}, {"n": "CAST(len(string_split(text, chr(12))) AS INTEGER)", "first": "string_split(text, chr(12))[1]"})
FRONT = [('---\nurl: https://h/a\ntitle: "T: t"\ntitle: \'second\'\n---\nbody --- x',), ("no header",), ("---\nurl: x\n---",)]
HEAD = "regexp_extract(text, '(?s)^---[ ]*\\r?\\n(.*?)\\r?\\n---[ ]*(?:\\r?\\n|$)(.*)$', {n})"
rule("front_matter_field", "A field of a header; of several the last counts; quotes go.", "text string", FRONT, {"title": lambda: F.try_element_at(files.front_matter(C("text"))[0], F.lit("title")), "url": lambda: F.try_element_at(files.front_matter(C("text"))[0], F.lit("url"))},
     {k: f"(SELECT regexp_replace(trim(substr(l, strpos(l, ':') + 1)), '^[\"'']|[\"'']$', '', 'g') FROM (SELECT unnest(x) AS l, generate_subscripts(x, 1) AS n FROM (SELECT string_split({HEAD.format(n=1)}, chr(10)) AS x)) WHERE trim(string_split(l, ':')[1]) = '{k}' AND contains(l, ':') ORDER BY n DESC LIMIT 1)" for k in ("title", "url")})
rule("front_matter_body", "What follows a header; a text without one is all body.", "text string", FRONT, {"body": lambda: files.front_matter(C("text"))[1]}, {"body": f"CASE WHEN regexp_matches(text, '(?s)^---[ ]*\\r?\\n(.*?)\\r?\\n---[ ]*(?:\\r?\\n|$)(.*)$') THEN {HEAD.format(n=2)} ELSE text END"})
RECORDS = json.dumps({"https://h/1": {"status": 200, "etag": "e"}, "https://h/2": {"error": "x"}})
rule("manifest_entries", "An object of address to record as rows.", "body string", [(RECORDS,), ("{}",)], {"entries": lambda: joined(F.array_sort(F.transform(F.map_entries(F.from_json("body", f"map<string,{files.MANIFEST_ENTRY}>")), lambda e: F.concat_ws(" ", e["key"], e["value"]["status"].cast("string"), e["value"]["error"]))))},
     {"entries": "array_to_string(list_sort(list_transform(json_keys(body), lambda k: concat_ws(' ', k, json_extract_string(body, '$.\"' || k || '\".status'), json_extract_string(body, '$.\"' || k || '\".error')))), '|')"})
