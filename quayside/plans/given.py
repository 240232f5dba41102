"""What the rules read: values that are made of the whole given tables, in SQL that Spark and DuckDB both run. Keyed by a rule's name, else by its columns. Each has a key `k`, one for each row."""

from __future__ import annotations


def two(x: str) -> str:
    """Cut after the second decimal: binary fractions round the same way in no two engines."""
    return f"CAST(CAST(CAST(floor(CAST({x} AS DOUBLE) * 100) AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) AS STRING)"


def money(x: str) -> str:
    """Points between thousands, a decimal comma; for amounts below a million."""
    whole, rest = f"split_part({two(x)}, '.', 1)", f"split_part({two(x)}, '.', 2)"
    return f"(CASE WHEN length({whole}) > 3 THEN substr({whole}, 1, length({whole}) - 3) || '.' || substr({whole}, length({whole}) - 2) ELSE {whole} END || ',' || {rest})"


def iso(x: str) -> str:
    return f"CAST(CAST({x} AS DATE) AS STRING)"


def moved(x: str) -> str:
    """The day in one of the years 2023 to 2028, as ISO text."""
    return f"(CAST(2023 + o_orderkey % 6 AS STRING) || substr({iso(x)}, 5))"


def slashed(d: str) -> str:
    return f"(substr({d}, 9, 2) || '/' || substr({d}, 6, 2) || '/' || substr({d}, 1, 4))"


def pick(key: str, *values: str | None) -> str:
    """One of some values by a key."""
    return f"CASE CAST({key} AS BIGINT) % {len(values)} " + " ".join(f"WHEN {n} THEN {'NULL' if v is None else v}" for n, v in enumerate(values)) + " END"


def text(*values: str | None) -> tuple[str | None, ...]:
    return tuple(None if v is None else "'" + v.replace("'", "''") + "'" for v in values)


O, P, E = "FROM orders", "FROM part", "FROM events"
DAY = moved("o_orderdate")
LATER = f"(CAST(2024 + o_custkey % 5 AS STRING) || substr({iso('o_orderdate')}, 5))"
WINDOW = f"{slashed(iso('o_orderdate'))} || ' - ' || CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE {slashed(LATER)} END"
LINES = "SELECT doc_id AS k, substr(text, 1, 120) AS {c} FROM documents WHERE text IS NOT NULL"
NAMED = f"p_name || CASE p_partkey % 5 WHEN 0 THEN ' (12-36 ay)' WHEN 1 THEN ' ' || p_type || ' Kredisi' WHEN 2 THEN ' | ' || p_brand WHEN 3 THEN ' İŞÇİ 3 - 12 months' ELSE '' END"
URLS = "SELECT page_id AS k, CAST(page_id AS INT) AS id, CASE page_id % 9 WHEN 0 THEN 'HTTP://WWW.' || substr(url, 8) WHEN 1 THEN url || '.pdf' WHEN 2 THEN replace(url, '.example.', ':443.example.') WHEN 3 THEN url || '/{x}' WHEN 4 THEN url || '/file.PNG' WHEN 5 THEN replace(url, 'http://', 'https://') || '&q=a b' ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN 'rates' ELSE '' END AS label FROM pages"
OPTION = "'<option value=''{{\"code\":\"' || p_brand || '\",\"project\":\"' || p_type || '\",\"min\":\"' || {m} || '\",\"max\":\"' || {x} || '\"}}''>' || p_name || '</option>'"
ONE, TWO = OPTION.format(m=money("p_retailprice"), x=money("p_retailprice * 10")), OPTION.format(m=money("p_size"), x="''")
FORM = f"SELECT p_partkey AS k, CAST(p_partkey AS INT) AS id, '<select name=''loan''><option value=''''>-</option>' || {ONE} || CASE WHEN p_partkey % 3 = 0 THEN {ONE} ELSE {TWO} END || CASE WHEN p_partkey % 4 = 0 THEN '<option value=''{{bad}}''>x</option>' ELSE '' END || '</select>' AS page {P}"
SELECTS = f"SELECT p_partkey AS k, CAST(p_partkey AS INT) AS id, '<select name=''' || CASE WHEN p_partkey % 6 = 0 THEN 'other' ELSE 'cur' END || '''><option value=''' || p_partkey || '''> ' || p_name || ' <b>(' || upper(substr(p_type, 1, 3)) || ')</b></option><option value=\"\">-</option><option value=\"' || p_size || '\">' || p_brand || '</option></select><select name=''x''><option value=''9''>No</option></select>' AS page {P}"
RATES = f"'[{{\"n\":' || (1 + p_size % 6) || ',\"r\":\"' || {money('p_size / 10')} || '\"}},{{\"n\":' || (7 + p_size % 30) || ',\"r\":\"' || {money('p_retailprice / 100')} || '\"}}]'"
BANDS = f"'[{{\"Min\":1,\"Max\":12,\"R\":\"' || p_size || '\"}},{{\"Min\":13,\"Max\":' || (20 + p_size) || ',\"R\":\"' || {money('p_retailprice / 1000')} || '\"}}]'"
CODE = pick("p_partkey", *text("TL", "usd", " EURO ", "ALT (GR)", "PLT (gr)", "GBP", "Silver", "trl", "", "X/Y"))

Q = chr(34)
BANDED = f"SELECT p_partkey AS k, '{{&quot;name&quot;:&quot;' || p_name || '&quot;,&quot;bands&quot;:[' || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '{{&quot;d&quot;:' || p_size || ',&quot;low&quot;:' || CAST(floor(p_retailprice) AS INT) || '}},{{&quot;d&quot;:92,&quot;low&quot;:50}}' END || ']}}' AS value, CAST(1 + p_size * (p_partkey % 3) AS INT) AS days {P}"
COMMANDS = f"SELECT o_orderkey AS k, '[{{\"command\":\"insert\",\"selector\":\".net\",\"data\":\"' || {pick('o_custkey', money('o_totalprice / 100'), text('0')[0])} || '\"}},{{\"command\":\"settings\",\"data\":\"x\"}},{{\"command\":\"insert\",\"selector\":\".gross\",\"data\":\"' || {money('o_totalprice / 50')} || '\"}}]' AS payload {O}"
PLAN = f"SELECT o_orderkey AS k, '<table>' || CASE WHEN o_custkey % 2 = 0 THEN '<tr><th>Taksit Tutarı</th><th>Ana Para</th><th>Kâr</th><th>Kalan</th></tr>' ELSE '<tr><th>Kalan</th><th>Kâr</th><th>Ana Para</th><th>Taksit Tutarı</th></tr>' END || '<tr><td>' || {money('o_totalprice / 12')} || '</td><td>' || {money('o_totalprice / 13')} || '</td><td>' || {money('o_totalprice / 100')} || '</td><td>' || {money('o_totalprice')} || '</td></tr><tr><td>-</td><td>-</td><td>-</td><td>-</td></tr></table>' AS page {O}"
LISTED = f"SELECT p_partkey AS k, '[{{\"c\":\"' || trim({CODE}) || '\",\"b\":\"' || {money('p_retailprice')} || '\",\"s\":\"' || {money('p_retailprice + p_size')} || '\"}},{{\"c\":\"ALT (gr)\",\"b\":\"4.000,5\",\"s\":\"4.100\"}},{{\"c\":\"USD\",\"b\":\"0\",\"s\":\"2\"}}]' AS payload {P}"
BOARD = f"SELECT p_partkey AS k, '<table><tr><th>x</th></tr><tr><td>' || p_name || ' (' || upper(substr(p_type, 1, 3)) || ')</td><td>' || {two('p_retailprice')} || '</td><td>' || {two('p_retailprice + p_size')} || '</td></tr><tr><td>Euro (EUR)</td><td>0</td><td>9</td></tr><tr><td>GBP - Pound</td><td>50.1</td><td>' || {pick('p_partkey', text('51')[0], text('')[0])} || '</td></tr></table>' AS page {P}"
HEADED = f"SELECT page_id AS k, CASE page_id % 4 WHEN 0 THEN '---' || chr(10) || 'url: \"' || url || '\"' || chr(10) || 'title: \"b\"' || chr(10) || '---' WHEN 1 THEN '---' || chr(10) || 'campaign_start: \"old\"' || chr(10) || 'url: \"a: ' || page_id || '\"' || chr(10) || chr(10) || '---' WHEN 2 THEN 'url: x' ELSE '---' || chr(10) || 'url: ' || url || chr(10) || '---' END AS head FROM pages"

GIVEN: dict[str, str] = {
    "id int, url string, source_url string, pdf_url string, kind string, image string, removed boolean, campaign_end string, end_date string, status string": f"SELECT o_orderkey AS k, CAST(o_orderkey AS INT) AS id, {pick('o_custkey', *text('https://h/a', None, '', 'https://h/b'))} AS url, {pick('o_orderkey', *text(None, 'https://h/a', '', 'https://h/i', 'https://h/c'))} AS source_url, "
    f"{pick('o_custkey + o_orderkey', *text('', None, 'https://h/a'))} AS pdf_url, CASE WHEN o_orderpriority < '3' THEN 'image' ELSE 'text' END AS kind, {pick('o_custkey', *text('https://h/i', '', None))} AS image, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS removed, {pick('o_custkey', DAY, None, text('')[0])} AS campaign_end, {pick('o_orderkey', None, LATER)} AS end_date, {pick('o_orderkey', *text('over', 'running', None, ''))} AS status {O}",
    "id int, tag string": f"SELECT event_id AS k, CAST(event_id AS INT) AS id, CASE event_type WHEN 'error' THEN 'gereksiz' WHEN 'view' THEN 'gerekli' WHEN 'click' THEN '' END AS tag {E}",
    "bank string, cells string": f"SELECT o_orderkey AS k, o_orderpriority AS bank, 'offers=' || {pick('o_custkey', *text('Sunuluyor', 'Sunulmuyor', ''))} || '|rate=' || {pick('o_orderkey', money('o_totalprice'), *text('', 'Sunulmuyor'))} || '|rate (Validity)=' || {pick('o_custkey', WINDOW, text('')[0])} AS cells {O}",
    "id int, ends string": f"SELECT o_orderkey AS k, CAST(o_orderkey AS INT) AS id, {pick('o_custkey', DAY, DAY + ' || ' + text('|')[0] + ' || ' + LATER, text('')[0])} AS ends {O}",
    "name string, type string, n_values int": f"SELECT p_partkey AS k, p_name AS name, {pick('p_size', *text('number', 'text', 'link', 'date', 'bank', 'badge'))} AS type, p_size AS n_values {P}",
    "code string, unit string, buy double, sell double": f"SELECT p_partkey AS k, {pick('p_size', *text('USD', 'XAU', 'USD/EUR', 'COIN'))} AS code, {pick('p_partkey', *text('1', 'gram', 'coin'))} AS unit, CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_retailprice END AS DOUBLE) AS buy, CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_retailprice + (p_size - 20) * 8 END AS DOUBLE) AS sell {P}",
    "amount double, term int, low double, high double, least int, most int": f"SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_totalprice END AS DOUBLE) AS amount, CAST(o_custkey % 60 AS INT) AS term, CAST({pick('o_custkey', '50000', None, '0')} AS DOUBLE) AS low, CAST({pick('o_orderkey', '200000', None, '0', '90000')} AS DOUBLE) AS high, CAST({pick('o_custkey', '3', None, '0')} AS INT) AS least, CAST({pick('o_orderkey', '36', None, '0')} AS INT) AS most {O}",
    "amount double, term int, pay double, total double, n_rows int, rate double": f"SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS amount, CAST(12 AS INT) AS term, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_totalprice / 11 END AS DOUBLE) AS pay, CAST(o_totalprice * (1 + (o_custkey % 7 - 1) / 50.0) AS DOUBLE) AS total, CAST({pick('o_orderkey', '12', '0', '11')} AS INT) AS n_rows, CAST(o_custkey % 9 AS DOUBLE) AS rate {O}",
    "amount double, days int, net double, gross double, rate double": f"SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS amount, CAST(1 + o_custkey % 365 AS INT) AS days, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice * 0.03 END AS DOUBLE) AS net, CAST(o_totalprice * (0.02 + (o_orderkey % 4) / 50.0) AS DOUBLE) AS gross, CAST(o_custkey % 60 AS DOUBLE) AS rate {O}",
    "term int": f"SELECT p_partkey AS k, CAST(p_size * (p_partkey % 5) AS INT) AS term {P}",
    "id string, n int, pros int": f"SELECT p_partkey AS k, p_brand AS id, CAST(p_size % 5 AS INT) AS n, CAST(p_partkey % (1 + p_size % 5) AS INT) AS pros {P}",
    "options_with_json": FORM, "options_envelope": FORM, "select_pairs": SELECTS, "select_ids_by_name": SELECTS,
    "currencies string, terms string": f"SELECT p_partkey AS k, upper(substr(p_type, 1, 3)) || ', usd ,' || {pick('p_partkey', *text('EURO', 'TL', ''))} AS currencies, p_size || '|12|x|' || (p_partkey % 40) || '|12 ay' AS terms {P}",
    "currency_symbol": f"SELECT p_partkey AS k, {CODE} AS code {P}", "self_quote": f"SELECT p_partkey AS k, {CODE} AS code {P}", "currency_number": f"SELECT p_partkey AS k, {CODE} AS code {P}", "rate_units": f"SELECT p_partkey AS k, {CODE} AS code {P}",
    "category string, entry string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('finance', 'account'))} AS category, '{{\"name\":\"' || p_name || '\",\"max\":\"' || p_size || '\",\"cur\":[\"TL\"' || CASE WHEN p_partkey % 3 = 0 THEN ',\"USD\"' ELSE '' END || ']}}' AS entry {P}",
    "amount double, term int, payload string": f"SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS amount, CAST(1 + o_custkey % 48 AS INT) AS term, '{{\"instalment\":\"' || {money('o_totalprice / 11')} || '\",\"total\":\"' || {pick('o_orderkey', money('o_totalprice * 1.1'), text('0')[0])} || '\",\"fees\":[{{\"n\":\"a\",\"v\":\"' || {money('o_totalprice / 1000')} || '\"}},{{\"n\":\"b\",\"v\":\"2\"}}]}}' AS payload {O}",
    "payload string, plan string": f"SELECT o_orderkey AS k, '{{\"ok\":' || {pick('o_custkey', *text('true', 'false'))} || ',\"monthlyInterest\":\"' || {pick('o_orderkey', money('o_totalprice / 1000'), text('0')[0])} || '\"}}' AS payload, {pick('o_custkey', text('')[0], text('<b>Annual</b> % ')[0] + ' || ' + money('o_totalprice / 10000'))} AS plan {O}",
    "plan string": f"SELECT o_orderkey AS k, '[{{\"Amount\":\"' || {money('o_totalprice')} || '\"}},{{\"Amount\":\"' || {money('o_totalprice / 2')} || '\"}}]' AS plan {O}",
    "attempts string": f"SELECT o_orderkey AS k, '[{{\"unit\":\"day\",\"net\":\"' || {pick('o_orderkey', text('0')[0], money('o_totalprice / 100'))} || '\"}},{{\"unit\":\"month\",\"net\":\"' || {pick('o_custkey', text('0')[0], money('o_totalprice'))} || '\"}}]' AS attempts {O}",
    "unit string, term int": f"SELECT p_partkey AS k, {pick('p_partkey', *text('day', 'month'))} AS unit, p_size AS term {P}",
    "days int": f"SELECT o_orderkey AS k, CAST(o_custkey % 400 AS INT) AS days {O}",
    "days int, rates string": f"SELECT p_partkey AS k, CAST(p_size * 3 AS INT) AS days, '{{\"31\":\"' || {money('p_retailprice / 100')} || '\",\"' || (80 + p_size) || '\":\"' || {pick('p_partkey', text('0')[0], money('p_size'))} || '\"}}' AS rates {P}",
    "currency string, amount double, days int, net double, yearly double": f"SELECT o_orderkey AS k, {pick('o_custkey', *text('TRY', 'USD', 'TRY'))} AS currency, CAST(o_totalprice AS DOUBLE) AS amount, CAST(o_custkey % 400 AS INT) AS days, CAST(o_totalprice / (10 + o_orderkey % 30) AS DOUBLE) AS net, CAST(o_custkey % 60 AS DOUBLE) AS yearly {O}",
    "amount double, n int, payload string, page string": f"SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS amount, CAST(1 + o_custkey % 12 AS INT) AS n, '{{\"rate\":\"' || {pick('o_orderkey', text('0')[0], money('o_custkey % 9'))} || '\",\"pay\":\"' || {money('o_totalprice / 10')} || '\"}}' AS payload, {pick('o_orderkey', text('<input>')[0], text('<input id=' + chr(34) + 'rate' + chr(34) + ' value=' + chr(34))[0] + ' || ' + money('o_custkey % 9') + ' || ' + text(chr(34) + '>')[0])} AS page {O}",
    "ratio double": f"SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey % 130 END AS DOUBLE) AS ratio {O}",
    "rates string, term int": f"SELECT p_partkey AS k, {RATES} AS rates, CAST(p_size % 12 AS INT) AS term {P}",
    "term int, bands string, own double": f"SELECT p_partkey AS k, p_size AS term, {BANDS} AS bands, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 1000 END AS DOUBLE) AS own {P}",
    "name string, low double, days int": f"SELECT p_partkey AS k, p_name AS name, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE floor(p_retailprice) END AS DOUBLE) AS low, CAST(p_size * 7 AS INT) AS days {P}",
    "terms string": f"SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_size || '|' || (p_size + 6) || '|' || (p_partkey % 60) END AS terms {P}",
    "pay string, rate string": f"SELECT o_orderkey AS k, {pick('o_custkey', money('o_totalprice') + ' || ' + text(' TL')[0], text('')[0])} AS pay, '% ' || {money('o_custkey % 9')} AS rate {O}",
    "pay double, plan string": f"SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS pay, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{{\"error\":\"busy\"}}' ELSE '[{{\"n\":1,\"p\":\"' || (o_custkey % 900) || '\"}},{{\"n\":2,\"p\":\"60\"}}]' END AS plan {O}",
    "amount double, prose string": f"SELECT o_orderkey AS k, CAST(floor(o_totalprice) + o_orderkey % 2 AS DOUBLE) AS amount, 'Amount ' || {money('floor(o_totalprice)')} || ' TL; monthly ' || {money('o_totalprice / 11')} || ' TL; total ' || {money('o_totalprice * 1.1')} || ' TL' AS prose {O}",
    "name string": f"SELECT p_partkey AS k, {NAMED} AS name {P}",
    "month_of_name": f"SELECT p_partkey AS k, {pick('p_partkey', *text('Ocak', 'ŞUBAT', 'subat', 'Mayıs', 'AĞUSTOS', 'kasim', 'Kasım', 'x', '', 'EYLUL', 'aralık', 'mart'))} AS name {P}",
    "validity_column": f"SELECT p_partkey AS k, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (Validity)' ELSE '' END AS name {P}",
    "label string": f"SELECT p_partkey AS k, upper(substr(p_type, 1, 3)) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' - ' || p_name ELSE ' - ' || p_brand || ' - ' || p_size END AS label {P}",
    "feed string, page string, stamp string": f"SELECT p_partkey AS k, {pick('p_partkey', text('USD:')[0] + ' || p_size || ' + text('|EUR:44')[0], text('')[0])} AS feed, 'USD:39|GBP:' || p_size AS page, p_brand AS stamp {P}",
    "code string, unit string, quoted string, price double": f"SELECT p_partkey AS k, {pick('p_partkey', *text('XAU', 'XAG', 'USD'))} AS code, {pick('p_size', *text('gram', 'ounce'))} AS unit, {pick('p_size', *text('TRY', 'USD'))} AS quoted, CAST(CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_retailprice END AS DOUBLE) AS price {P}",
    "amount double, payload string": f"SELECT o_orderkey AS k, CAST(o_custkey + 0.5 AS DOUBLE) AS amount, '{{\"from\":\"' || (o_custkey + o_orderkey % 2) || '.50\",\"to\":\"' || {two('o_totalprice')} || '\"}}' AS payload {O}",
    "source string, target string, given double, got double": f"SELECT o_orderkey AS k, {pick('o_custkey', *text('USD', 'EUR', 'TRY'))} AS source, {pick('o_orderkey', *text('USD', 'EUR', 'XXX'))} AS target, CAST(o_custkey + 1 AS DOUBLE) AS given, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS DOUBLE) AS got {O}",
    "out string": f"SELECT p_partkey AS k, CASE WHEN p_partkey % 12 = 0 THEN '' ELSE 'Title:  ' || p_name || chr(10) || 'Pages: ' || p_size || chr(10) || 'Encrypted: ' || CASE WHEN p_size % 2 = 0 THEN 'no' ELSE 'yes' END END AS out {P}",
    "xml string": "SELECT page_id AS k, '<urlset><url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url><url><LOC>https://h/' || page_id || '</LOC></url></urlset>' AS xml FROM pages",
    "pdf_links_in_text": "SELECT doc_id AS k, substr(text, 1, 200) || ' [a](https://h/' || doc_id || '.pdf?x=1) and [b](https://h/b.html), [c](https://h/c.PDF)' AS text FROM documents WHERE text IS NOT NULL",
    "front_matter_field": "SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN text ELSE '---' || chr(10) || 'url: \"https://h/' || doc_id || '\"' || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10) || text END AS text FROM documents WHERE text IS NOT NULL",
    "front_matter_body": "SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN text ELSE '---' || chr(10) || 'url: \"https://h/' || doc_id || '\"' || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10) || text END AS text FROM documents WHERE text IS NOT NULL",
    "without_pictographs": "SELECT doc_id AS k, 'x 😀 ' || replace(text, 'e', 'e✂') AS text FROM documents WHERE text IS NOT NULL",
    "money_read": f"SELECT o_orderkey AS k, {pick('o_custkey', money('o_totalprice') + ' || ' + text(' TL')[0], text('-')[0] + ' || ' + money('o_totalprice'), text('none')[0], two('o_totalprice'))} AS text {O}",
    "rate_read": f"SELECT o_orderkey AS k, {pick('o_custkey', text('% ')[0] + ' || ' + money('o_totalprice / 1000'), two('o_totalprice'), text('')[0])} AS text {O}",
    "money_english": f"SELECT o_orderkey AS k, {pick('o_custkey', two('o_totalprice') + ' || ' + text(' USD')[0], text('x')[0])} AS text {O}",
    "iso_strict": f"SELECT o_orderkey AS k, {pick('o_custkey', DAY, slashed(DAY), None, text('2026-02-30')[0])} AS text {O}",
    "script_date": f"SELECT o_orderkey AS k, {pick('o_custkey', text('/Date(')[0] + ' || (o_orderkey * 86400000) || ' + text(')/')[0], text('')[0], text('/Date(-')[0] + ' || o_custkey || ' + text('000)/')[0])} AS text {O}",
    "id int, text string": "SELECT doc_id AS k, CAST(doc_id AS INT) AS id, CASE doc_id % 5 WHEN 0 THEN 'I can''t see an image.' WHEN 1 THEN replace(text, chr(10), chr(10) || '[unreadable]' || chr(10)) ELSE text END AS text FROM documents WHERE text IS NOT NULL",
    "text_pages": "SELECT doc_id AS k, CAST(doc_id AS INT) AS id, replace(text, chr(10), chr(12)) AS text FROM documents WHERE text IS NOT NULL",
    "id int, url string": URLS, "id int, url string, label string": URLS, "url string": URLS,
    "kind string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('campaign', 'faq', 'product', 'fees', 'rates', 'blog', 'corporate', 'branch', 'legal', '', None))} AS kind {P}",
    "reason string": f"SELECT event_id AS k, {pick('event_id', *text('HTTP 404', 'http 410 gone', 'HTTP 503', 'timeout', ''))} || ' ' || event_type AS reason {E}",
    "url string, page int": "SELECT page_id AS k, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE url END AS url, CAST(page_id % 30 AS INT) AS page FROM pages",
    "title string": f"SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN p_name || ' | Örnek Bankası' WHEN 1 THEN p_type || ' / ' || p_name || ' | ÖRNEK' WHEN 2 THEN p_name || ' – ' || p_brand || ' — Örnek Bank' WHEN 3 THEN 'Ana Sayfa' WHEN 4 THEN '' ELSE p_name END AS title {P}",
    "file string, anchor string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('Ücret-Tarifesi', 'rapor', 'kampanya_ücret'))} || p_size || '.pdf' AS file, {pick('p_size', *text('Kâr Oranları', None, '', 'Yıllık'))} AS anchor {P}",
    "pattern string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('ucret', 'tarife', 'komisyon', 'sozlesme', ''))} AS pattern {P}",
    "email string": "SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN '  ' || replace(c_name, '#', '.') || '@Example.COM ' || chr(10) END AS email FROM customer",
    "id string, category string": f"SELECT p_partkey AS k, p_name || '/' || p_partkey AS id, {pick('p_partkey', *text('finance', 'cards', 'other'))} AS category {P}",
    "link string": f"SELECT p_partkey AS k, 'https://any.host/en/compare/' || {pick('p_partkey', *text('finance', 'cards', 'loans'))} || '?x=1&table=' || replace(p_name, ' ', '%20') AS link {P}",
    "bank string, title string, detail string": f"SELECT p_partkey AS k, p_brand AS bank, {pick('p_partkey', 'p_name', text('')[0])} AS title, {pick('p_size', 'p_type', None, text('')[0])} AS detail {P}",
    "model string, body string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('big-e5', 'qwen3-embed', 'm'))} AS model, p_name AS body {P}",
    "model string, query string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('big-e5', 'qwen3-embed', 'm'))} AS model, p_name AS query {P}",
    "day int, month int, year int": f"SELECT o_orderkey AS k, CAST(o_orderkey % 33 AS INT) AS day, CAST(o_custkey % 14 AS INT) AS month, CAST(1995 + o_orderkey % 40 AS INT) AS year {O}",
    "start string, stop string": f"SELECT o_orderkey AS k, {pick('o_custkey', iso('o_orderdate'), None)} AS start, {pick('o_orderkey', iso('o_orderdate'), None, iso('o_orderdate'))} AS stop {O}",
    "cell string": f"SELECT o_orderkey AS k, {pick('o_custkey', WINDOW, text('-')[0], WINDOW, text('soon')[0])} AS cell {O}",
    "unit string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('Gün', 'gun', ' ay ', 'MONTHS', 'day', 'year', ''))} AS unit {P}",
    "value double": f"SELECT l_orderkey * 10 + l_linenumber AS k, CAST(l_extendedprice * l_discount AS DOUBLE) AS value FROM lineitem WHERE abs(l_extendedprice * l_discount * 1000 - round(l_extendedprice * l_discount * 1000)) > 0.01",
    "day string, months int": f"SELECT o_orderkey AS k, {iso('o_orderdate')} AS day, CAST(o_custkey % 30 AS INT) AS months {O}",
    "cell_value": f"SELECT p_partkey AS k, {pick('p_partkey', *text(' ', '-', 'Sunulmuyor', 'NOT OFFERED '), 'p_name', text(' ')[0] + ' || p_type')} AS value {P}",
    "cell_key": f"SELECT p_partkey AS k, {pick('p_partkey', *text(' ', '-'), 'p_name', text(' ')[0] + ' || p_type')} AS value {P}",
    "can string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('finance', 'account', 'card', 'rates'))} AS can {P}",
    "category string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('finance', 'card', 'profit_share', 'x'))} AS category {P}",
    "asked int": f"SELECT o_orderkey AS k, CAST(o_custkey % 300 - 5 AS INT) AS asked {O}",
    "id int, url string, title string, page int": "SELECT page_id AS k, CAST(page_id AS INT) AS id, CASE WHEN page_id % 5 <> 0 THEN url END AS url, substr(html, 40, 20) AS title, CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 9 AS INT) END AS page FROM pages",
    "col string, stop string": f"SELECT o_orderkey AS k, {pick('o_custkey', *text('rate', 'rate (Validity)', 'note'))} AS col, {pick('o_orderkey', iso('o_orderdate'), *text('2026-06-20', '2026-07-01'))} AS stop {O}",
    "page string, image string, kind string, idx int, body string": f"SELECT p_partkey AS k, p_brand AS page, {pick('p_partkey', 'p_type', None)} AS image, {pick('p_size', *text('image', 'text'))} AS kind, p_size AS idx, p_name AS body {P}",
    "kind string, doc string, n int, part int": f"SELECT p_partkey AS k, {pick('p_partkey', *text('campaign', 'pdf', 'page'))} AS kind, p_name AS doc, CAST(p_size % 9 AS INT) AS n, CAST(p_partkey % 4 AS INT) AS part {P}",
    "body string, marker string, detail string": f"SELECT p_partkey AS k, 'Fees <t1> of ' || p_name || {pick('p_partkey', *text(' and <t2>.', ' <t1> again', ''))} AS body, {pick('p_size', *text('<t1>', '<t2>'))} AS marker, p_size || ' TL' AS detail {P}",
    "body string, id int": "SELECT doc_id AS k, substr(text, 1, 300) || chr(10) || '![a](https://h/' || doc_id || '.png)' || chr(10) || 'more [b](b.html)' AS body, CAST(doc_id AS INT) AS id FROM documents WHERE text IS NOT NULL",
    "n int": "SELECT doc_id AS k, CAST(n_chars AS INT) AS n FROM documents",
    "word string, field string": "SELECT a.p_partkey AS k, split_part(a.p_name, ' ', 1) AS word, lower(b.p_name || ' ' || b.p_type) AS field FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_size",
    "topic string, category string, note string": f"SELECT p_partkey AS k, p_name AS topic, {pick('p_partkey', 'p_type', text('')[0])} AS category, p_brand AS note {P}",
    "bank string, family string, variant string, broad boolean": f"SELECT p_partkey AS k, p_brand AS bank, p_type AS family, {pick('p_partkey', text('12-36')[0], None)} AS variant, p_size % 2 = 0 AS broad {P}",
    "rate double": f"SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice / 7 END AS DOUBLE) AS rate {P}",
    "bank string, pay double, term int, rate double, reason string": f"SELECT o_orderkey AS k, o_orderpriority AS bank, CAST(CASE WHEN o_custkey % 3 <> 0 THEN round(o_totalprice) + 0.5 END AS DOUBLE) AS pay, CAST(1 + o_custkey % 48 AS INT) AS term, CAST(CASE WHEN o_custkey % 3 <> 0 THEN 3.5 END AS DOUBLE) AS rate, CASE WHEN o_custkey % 3 = 0 THEN 'no quote' END AS reason {O}",
    "card string, tier string, rate double": f"SELECT p_partkey AS k, p_name AS card, {pick('p_partkey', text('')[0], 'p_type')} AS tier, CAST(p_size / 2.0 AS DOUBLE) AS rate {P}",
    "own boolean, derived boolean, general boolean": f"SELECT p_partkey AS k, p_size % 2 = 0 AS own, p_partkey % 3 = 0 AS derived, p_partkey % 5 = 0 AS general {P}",
    "bank string, can string, before string, now string": f"SELECT event_id AS k, CAST(user_id AS STRING) AS bank, event_type AS can, {pick('event_id', *text('ok', None, 'down'))} AS before, CASE WHEN value > 40 THEN 'down' ELSE 'ok' END AS now {E}",
    "key string, asked string": f"SELECT p_partkey AS k, p_name AS key, {pick('p_partkey', 'upper(replace(p_name, ' + text(' ')[0] + ', ' + text('-')[0] + '))', 'p_type')} AS asked {P}",
    "kind string, what string, field string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('rate', 'constant'))} AS kind, upper(substr(p_type, 1, 3)) AS what, {pick('p_size', *text('buy', 'sell', ''))} AS field {P}",
    "branch string, before string, now string, verdict string": f"SELECT p_partkey AS k, p_brand AS branch, {pick('p_partkey', 'p_type', None)} AS before, {pick('p_size', 'p_type', 'p_name')} AS now, {pick('p_size', None, *text('DIVE', 'SKIP'))} AS verdict {P}",
    "bank string, can string, secs double, first boolean, again boolean": f"SELECT event_id AS k, CAST(user_id AS STRING) AS bank, event_type AS can, CAST(value / 10 AS DOUBLE) AS secs, event_id % 3 <> 0 AS first, event_id % 5 <> 0 AS again {E}",
    "id int, cells string, n_columns int": f"SELECT p_partkey AS k, CAST(p_partkey AS INT) AS id, p_name || '|' || p_type || CASE WHEN p_size % 2 = 0 THEN '|' || p_brand ELSE '' END || CASE WHEN p_size % 5 = 0 THEN '|x|y' ELSE '' END AS cells, CAST(3 AS INT) AS n_columns {P}",
    "labels string": f"SELECT p_partkey AS k, p_name || '|' || upper(p_name) || '|' || p_type || '|' || p_name || '!|' || p_brand AS labels {P}",
    "args string, name string": f"SELECT p_partkey AS k, {pick('p_partkey', text('{' + chr(34) + 'b' + chr(34) + ':')[0] + ' || p_size || ' + text(',' + chr(34) + 'a' + chr(34) + ':' + chr(34) + 'x' + chr(34) + '}')[0], text('{' + chr(34) + 'a' + chr(34) + ':' + chr(34) + 'x' + chr(34) + ',' + chr(34) + 'b' + chr(34) + ':')[0] + ' || p_size || ' + text('}')[0])} AS args, p_brand AS name {P}",
    "days string": f"SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE (p_size % 9) || ',' || (p_partkey % 8) || ',1,1,-1' END AS days {P}",
    "hour int, minute int, days string": f"SELECT p_partkey AS k, CAST(p_size % 24 AS INT) AS hour, CAST(p_partkey % 60 AS INT) AS minute, {pick('p_partkey', *text('0,1,2,3,4,5,6', '0,2', '5'))} AS days {P}",
    "type string, value string, label string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('text', 'number', 'bank', 'link', 'date'))} AS type, {pick('p_partkey', 'p_name', text('12.5')[0], 'p_brand', text('https://h/a')[0], text('2026-01-02')[0])} AS value, {pick('p_size', 'p_type', None)} AS label {P}",
    "value double, code string": f"SELECT p_partkey AS k, CAST(floor(p_retailprice) * (p_size - 20) + 0.25 AS DOUBLE) AS value, {pick('p_partkey', *text('TRY', 'XAU', 'USD'))} AS code {P}",
    "type string, unit string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('money', 'rate', 'text', 'number'))} AS type, {pick('p_size', *text('TRY', 'XAU', ''))} AS unit {P}",
    "title string, day string": f"SELECT o_orderkey AS k, {pick('o_custkey', 'o_orderpriority || ' + text(' Konut Kâr!')[0], text('')[0])} AS title, {iso('o_orderdate')} AS day {O}",
    "bank string, picked string, side string": f"SELECT p_partkey AS k, {pick('p_partkey', *text('A', 'B', 'C'))} AS bank, {pick('p_size', *text('A,B', None, ''))} AS picked, {pick('p_size', *text('buy', 'sell'))} AS side {P}",
    "options string, limits string": f"SELECT p_partkey AS k, {pick('p_partkey', text('1=')[0] + ' || p_name || ' + text('|2=')[0] + ' || p_type', text('2=')[0] + ' || p_type', text('')[0])} AS options, '{{\"1\":{{\"min\":\"' || {money('p_size')} || '\",\"max\":\"' || {money('p_retailprice')} || '\"}},\"3\":{{\"min\":\"5\"}}}}' AS limits {P}",
    "escaped_option_bands": BANDED, "band_days": BANDED, "value string, days int": BANDED,
    "account_types": f"SELECT p_partkey AS k, '<div data-account=\"' || p_brand || '\">Daily ' || p_name || '</div>' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<div data-account=\"gold\">' || p_type || '</div>' END AS page {P}",
    "repeated_params": f"SELECT p_partkey AS k, '[{{\"k\":\"cur\",\"v\":\"TL\"}},{{\"k\":\"cur\",\"v\":\"' || upper(substr(p_type, 1, 3)) || '\"}},{{\"k\":\"min\",\"v\":\"' || p_size || '\"}}]' AS payload {P}",
    "usable_payload": f"SELECT event_id AS k, {pick('event_id', *text('', '{}', '{' + Q + 'errorMessage' + Q + ':' + Q + 'closed' + Q + '}'), 'props', text('[1]')[0])} AS body {E}",
    "commands_by_selector": COMMANDS, "account_quote_by_selector": COMMANDS, "first_insert": COMMANDS,
    "plan_by_header": PLAN, "plan_row_count": PLAN,
    "plan_detail": f"SELECT o_orderkey AS k, '<li><b>Toplam Tutar</b><i>' || {money('o_totalprice')} || '</i></li><li><b>Yıllık Oran</b><i>% ' || {money('o_custkey % 60')} || '</i></li>' AS page {O}",
    "rates_of_json": LISTED, "rates_with_units": LISTED,
    "rates_of_page": BOARD, "three_cell_rows": BOARD,
    "mile_rates": f"SELECT p_partkey AS k, '{{\"card\":\"' || p_name || '\",\"tiers\":[{{\"t\":\"' || p_type || '\",\"features\":[{{\"f\":\"travel\",\"rates\":{{\"m\":' || p_size || '.5,\"n\":2}}}}]}},{{\"t\":\"B\",\"features\":[]}}]}}' AS payload {P}",
    "page_token": f"SELECT o_orderkey AS k, {pick('o_custkey', text('<input name=' + Q + 'token' + Q + ' type=' + Q + 'hidden' + Q + ' value=' + Q)[0] + ' || o_orderkey || ' + text('+b/c=' + Q + '>')[0], text('<meta name=' + Q + 'token' + Q + ' content=' + Q)[0] + ' || o_orderstatus || ' + text(Q + '>')[0], text('<p>')[0])} AS page {O}",
    "retry_on_body": f"SELECT event_id AS k, {pick('event_id', text('{' + Q + 'code' + Q + ':0}')[0], text('{' + Q + 'code' + Q + ':503}')[0], 'props', text('')[0])} AS body {E}",
    "document_links": "SELECT page_id AS k, html || '<a href=\"/' || page_id || '.pdf?x=1\">A</a><a href=\"b.DOCX\">B</a><img src=\"/i.png\">' AS page FROM pages",
    "content_images": "SELECT page_id AS k, html || '<img src=\"/' || page_id || '.png\"><img src=\"data:x\"><img src=\"/t/pixel.gif\"><img src=\"/' || page_id || '.png\">' AS page FROM pages",
    "manifest_entries": "SELECT page_id AS k, '{\"' || url || '\": {\"status\": 200, \"etag\": \"e' || page_id || '\"}, \"https://h/2\": {\"error\": \"x\"}}' AS body FROM pages",
    "set_header_field": HEADED, "set_header_dates": HEADED,
    "components_of_category": f"SELECT p_partkey AS k, '{{\"category\":\"' || p_type || '\",\"components\":[' || CASE WHEN p_size % 4 = 0 THEN '' ELSE '{{\"id\":\"' || p_name || '\",\"kind\":\"slider\"}},{{\"id\":\"' || p_brand || '\",\"kind\":\"table\"}}' END || ']}}' AS body {P}",
    "report_blocks": "SELECT doc_id AS k, '# ' || source || chr(10) || substr(text, 1, 200) || chr(10) || '| a | b |' || chr(10) || '| - | - |' || chr(10) || '| 1 | ' || doc_id || ' |' || chr(10) || 'More.' AS body FROM documents WHERE text IS NOT NULL",
    "answer_pieces": "SELECT conv_id * 1000 + turn AS k, text AS body FROM conversations WHERE role = 'assistant' AND text IS NOT NULL",
    "body string, wanted string": "SELECT doc_id AS k, substr(text, 1, 2000) AS body, 'rate|' || substr(source, 1, 2) AS wanted FROM documents WHERE text IS NOT NULL",
}
