"""Rules over stated cases: addresses, titles, headers and text gates, one query a rule, so that odd inputs are compared too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..functions import values as V
from ..sources import quotes
from .catalog import rule
from .documents import fold_sql

C = F.col
URLS = [(k, u) for k, u in enumerate((
    "https://example.com", "http://Example.COM:80/", "https://user:pw@www.example.com./a/b/", "https://example.com:8443/x", "http://example.com:443/p",
    "https://example.com/%C5%9Fube", "https://example.com/şube", "https://example.com/a%20b/c+d", "https://example.com/a?b=2&a=1&utm_source=x&a=0#top",
    "https://example.com/a?q=a+b&r=%2F&empty=&flag&gclid=1", "https://example.com/s?a-b=1&a=2", "https://example.com/100%", "ftp://example.com/x", "mailto:a@b.c", "", "  https://example.com/trim/  ",
    "https://example.com/Docs/List.PDF?v=1", "https://sub.example.com/img/a.PNG", "https://notexample.com/tr/bireysel/kartlar", "https://example.com/tr/Kampanyalar/kart-kampanyalari/yaz.aspx",
    "https://example.com/en/personal/loans", "https://example.com/ticari/krediler/arac", "https://law.gov.example/files/rates.pdf", "http://example.com/plain.pdf", "https://example.com/destek/sss/konu",
    "https://example.com/a/{{slug}}", "https://example.com/undefined", "https://", "https://example.com/x y", "https://example.comhttps://example.com/a", "https://www.example.com/urun_detay-sayfasi.html", None,
), 1)]
ADDRESS = "id int, url string"
ENC = "replace(replace(replace(url_encode({e}), '+', '%20'), '*', '%2A'), '%7E', '~')"
DEC = "url_decode(regexp_replace({e}, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|$|[0-9A-Fa-f]$)', '%25\\1', 'g'))"


def canon_sql(u: str, host: str = "") -> str:
    own = f"trim({u})"
    place = f"regexp_replace(regexp_extract({own}, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', '')"
    name = f"lower(regexp_replace({place}, ':[0-9]*$', ''))"
    port = f"regexp_extract({place}, ':([0-9]+)$', 1)"
    way = ENC.format(e=DEC.format(e=f"regexp_extract({own}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"))
    for c in U.PATH_SAFE:
        if c not in "-._~":
            way = f"replace({way}, '%{ord(c):02X}', '{c if c != chr(39) else chr(39) * 2}')"
    way = f"regexp_replace({way}, '/+$', '')"
    dec = lambda e: DEC.format(e=f"replace({e}, '+', ' ')")
    pieces = f"list_filter(string_split(regexp_extract({own}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"
    pairs = f"list_transform({pieces}, lambda p: {{'k': {dec("string_split(p, '=')[1]")}, 'v': {dec("substr(p, length(string_split(p, '=')[1]) + 2)")}}})"
    kept = f"list_sort(list_filter({pairs}, lambda x: NOT (starts_with(lower(x.k), 'utm_') OR lower(x.k) IN ({', '.join(repr(t) for t in U.TRACKING)}))))"
    tail = f"list_transform({kept}, lambda x: {ENC.format(e='x.k')} || '=' || {ENC.format(e='x.v')})"
    return f"""CASE WHEN regexp_matches(lower({own}), '^https?:') AND {name} <> '' THEN 'https://' || regexp_replace({host or name}, '\\.+$', '') || CASE WHEN {port} IN ('', '80', '443') THEN '' ELSE ':' || {port} END
    || CASE WHEN {way} = '' THEN '/' ELSE {way} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({tail}, '&') ELSE '' END ELSE '' END"""


rule("canonical_spellings", "One spelling of an address: encodings, ports, users, final points, sorted parameters.", ADDRESS, URLS, {"canonical": lambda: U.canonical(C("url"))}, {"canonical": canon_sql("url")})
rule("canonical_forced_host", "The same under a host that a site declares.", ADDRESS, URLS[:14], {"canonical": lambda: U.canonical(C("url"), F.lit("WWW.Example.com"))}, {"canonical": canon_sql("url", "'www.example.com'")})

HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':(80|443)$', '')"
RAW = "regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
PATH = f"(CASE WHEN {RAW} = '' THEN '/' ELSE {RAW} END)"
SEGS = f"list_filter(string_split(lower({PATH}), '/'), lambda s: s <> '')"
LANGUAGES, FOREIGN = ("tr", "tr-tr", "en", "en-us"), ("en", "en-us", "de", "ar")
AUDIENCE = {"bireysel": "personal", "personal": "personal", "ticari": "business", "kobi": "small business"}
KINDS = {"kampanyalar": "campaign", "sss": "faq", "destek": "faq", "kurumsal": "corporate"}
HINTS = ("kart", "kredi", "loan")
quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
OWN = f"(CASE WHEN coalesce({SEGS}[1], '') IN ({quoted(LANGUAGES)}) THEN list_slice({SEGS}, 2, NULL) ELSE {SEGS} END)".replace("list_slice(" + SEGS + ", 2, NULL)", f"{SEGS}[2:]")
mapped = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
case = lambda m, e: f"CASE {e} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
own = lambda: U.without_language(C("url"), LANGUAGES)
PAGES = [r for r in URLS if r[1] and r[1].startswith("http") and r[1].count("/") > 2]

rule("asset_by_suffix", "Files that are never documents.", ADDRESS, PAGES, {"asset": lambda: U.is_asset(C("url"))}, {"asset": f"regexp_extract(lower({PATH}), '\\.([a-z0-9]+)$', 1) IN ({quoted(U.ASSET_SUFFIXES)})"})
rule("language_prefix", "No foreign segment in front; where prefixes are declared, one of them.", ADDRESS, PAGES,
     {"any_path": lambda: U.own_language(C("url"), FOREIGN), "declared": lambda: U.own_language(C("url"), FOREIGN, ("/tr", "/ticari"))},
     {"any_path": f"coalesce({SEGS}[1], '') NOT IN ({quoted(FOREIGN)})", "declared": f"coalesce({SEGS}[1], '') NOT IN ({quoted(FOREIGN)}) AND ({PATH} = '/' OR starts_with(lower({PATH}), '/tr') OR starts_with(lower({PATH}), '/ticari'))"})
rule("wanted_pdf", "PDFs over https on the site or a trusted authority's.", ADDRESS, PAGES, {"wanted": lambda: U.wanted_file(C("url"), "example.com", ("gov.example",))},
     {"wanted": f"starts_with(url, 'https://') AND ends_with(lower({PATH}), '.pdf') AND ({HOST} IN ('example.com', 'gov.example') OR ends_with({HOST}, '.example.com') OR ends_with({HOST}, '.gov.example'))"})
rule("path_segments", "Segments in lower case without a language marker.", ADDRESS, PAGES, {"segments": lambda: F.array_join(own(), "|")}, {"segments": f"array_to_string({OWN}, '|')"})
rule("path_section", "The first segment.", ADDRESS, PAGES, {"section": lambda: F.coalesce(F.get(own(), F.lit(0)), F.lit(""))}, {"section": f"coalesce({OWN}[1], '')"})
rule("path_category", "The second segment.", ADDRESS, PAGES, {"category": lambda: F.coalesce(F.get(own(), F.lit(1)), F.lit(""))}, {"category": f"coalesce({OWN}[2], '')"})
rule("path_audience", "The audience that the first telling segment names.", ADDRESS, PAGES,
     {"audience": lambda: F.coalesce(F.get(F.filter(F.transform(own(), lambda s: F.element_at(mapped(AUDIENCE), s)), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))},
     {"audience": f"coalesce(list_filter(list_transform({OWN}, lambda s: {case(AUDIENCE, 's')}), lambda x: x IS NOT NULL)[1], '')"})
rule("document_kind", "A label wins; then a telling segment; then a product word in the path.", "id int, url string, label string", [(*r, "rates" if r[0] % 7 == 0 else "") for r in PAGES],
     {"kind": lambda: F.when(C("label").isin("campaign", "product", "fees", "rates", "faq"), C("label")).otherwise(F.coalesce(F.get(F.filter(F.transform(own(), lambda s: F.element_at(mapped(KINDS), s)), lambda x: x.isNotNull()), F.lit(0)), F.when(X.contains_any(F.array_join(own(), "/"), HINTS), "product"), F.lit("other")))},
     {"kind": f"CASE WHEN label IN ('campaign', 'product', 'fees', 'rates', 'faq') THEN label ELSE coalesce(list_filter(list_transform({OWN}, lambda s: {case(KINDS, 's')}), lambda x: x IS NOT NULL)[1], CASE WHEN regexp_matches(array_to_string({OWN}, '/'), '{'|'.join(HINTS)}') THEN 'product' END, 'other') END"})
rule("refresh_days", "How often a kind of document is looked at again.", "kind string", [(k,) for k in ("campaign", "faq", "product", "fees", "rates", "blog", "corporate", "branch", "legal", "", None)],
     {"days": lambda: F.when(C("kind").isin("campaign", "faq"), 1).when(C("kind").isin("product", "fees", "rates", "blog", "corporate", "branch"), 7).otherwise(30)},
     {"days": "CASE WHEN kind IN ('campaign', 'faq') THEN 1 WHEN kind IN ('product', 'fees', 'rates', 'blog', 'corporate', 'branch') THEN 7 ELSE 30 END"})
rule("parent_address", "The address one segment up.", ADDRESS, PAGES, {"parent": lambda: U.parent(C("url"))}, {"parent": f"'https://' || {HOST} || '/' || array_to_string(list_filter(string_split({PATH}, '/'), lambda s: s <> '')[:-2], '/')"})
rule("ghost_address", "Placeholders and bare schemes are no pages.", ADDRESS, URLS, {"ghost": lambda: U.is_ghost(C("url"))}, {"ghost": "coalesce(regexp_matches(url, '[{}<>]|%7[bBdD]|undefined$|/null$') OR regexp_matches(url, '^https?:/*$'), true)"})
rule("ghosts_apart", "Real addresses and ghosts, each once, in order.", "url string", [(u,) for _, u in URLS if u] + [("https://example.com",)],
     {"side": lambda: F.when(U.is_ghost(C("url")), "ghost").otherwise("real")}, {"side": "CASE WHEN regexp_matches(url, '[{}<>]|%7[bBdD]|undefined$|/null$') OR regexp_matches(url, '^https?:/*$') THEN 'ghost' ELSE 'real' END"})
rule("broken_address", "White space, two schemes or no host.", ADDRESS, URLS, {"broken": lambda: U.is_broken(C("url"))}, {"broken": "regexp_matches(url, '\\s|^https?:/*$|https?://.*https?://') OR NOT regexp_matches(url, '^https?://[^/]+')"})
ERRORS = [(e,) for e in ("HTTP 404", "http 410 gone", "HTTP 503", "timeout", "DNS missing: no such host", "dead host", "http403", "", None)]
rule("lasting_error", "Reasons that another attempt will not mend; doubt counts as passing.", "reason string", ERRORS,
     {"lasting": lambda: F.coalesce(X.contains_any(F.lower("reason"), ("dns missing", "dead host")) | F.regexp_extract(F.lower("reason"), "http\\s*([0-9]{3})", 1).isin("400", "401", "403", "404", "410"), F.lit(False))},
     {"lasting": "coalesce(contains(lower(reason), 'dns missing') OR contains(lower(reason), 'dead host') OR regexp_extract(lower(reason), 'http\\s*([0-9]{3})', 1) IN ('400', '401', '403', '404', '410'), false)"})
rule("page_link", "An address that opens a document at a page.", "url string, page int", [("https://example.com/a.pdf", 3), ("", 1), (None, 2)], {"link": lambda: U.page_link(C("url"), C("page"))}, {"link": "CASE WHEN coalesce(url, '') = '' THEN '' ELSE url || '#page=' || page END"})
rule("site_label", "The host without www.", ADDRESS, PAGES, {"label": lambda: F.regexp_replace(U.host(C("url")), "^www\\.", "")}, {"label": f"regexp_replace({HOST}, '^www\\.', '')"})
rule("audit_key", "Host without www and path without a final slash: a key for comparing lists.", ADDRESS, PAGES, {"key": lambda: U.without_www(C("url"))}, {"key": f"regexp_replace({HOST}, '^www\\.', '') || {PATH}"})
rule("cited_key", "An address as cited in prose: final marks go, then a final slash.", "url string", [(u,) for u in ("https://a.b/c.", "https://a.b/c/;", "https://a.b/c/!?", "https://a.b/", "x,")],
     {"key": lambda: F.regexp_replace(F.regexp_replace("url", "[.,;:!?]+$", ""), "/+$", "")}, {"key": "regexp_replace(regexp_replace(url, '[.,;:!?]+$', ''), '/+$', '')"})

TITLES = [(t,) for t in ("Konut | Örnek Bankası", "Kredi / Konut | ÖRNEK", "A – B — Örnek Bank", "Örnek", "| Örnek", "Kart | başka site", " spaced — Örnek | Örnek ", "Detay", "Kampanya", "KAMPANYALAR", "Ana Sayfa", "Haber-ler", "", None, "a/b|c")]
EMPTY_TITLES = ("detay", "kampanya", "kampanyalar", "anasayfa", "haberler", "sayfa")


def title_sql(e: str) -> str:
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    e = strip(f"coalesce({e}, '')")
    folded = f"regexp_replace({fold_sql('string_split(w, sep)[-1]')}, '[^a-z0-9]', '', 'g')"
    step = f"list_reduce(list_prepend({e}, ['|', '/', '—', '–']), lambda w, sep: CASE WHEN contains(w, sep) AND {strip('regexp_extract(w, ' + chr(39) + '(?s)^(.*)[' + chr(39) + ' || sep || ' + chr(39) + ']' + chr(39) + ', 1)')} <> '' AND contains({folded}, 'ornek') THEN {strip('regexp_extract(w, ' + chr(39) + '(?s)^(.*)[' + chr(39) + ' || sep || ' + chr(39) + ']' + chr(39) + ', 1)')} ELSE w END)"
    return f"regexp_replace({step}, '^[ |/—–-]+|[ |/—–-]+$', '', 'g')"


rule("clean_title", "A title without the site's name after the last separator, four separators in turn.", "title string", TITLES, {"cleaned": lambda: X.clean_title(C("title"), ("Örnek",))}, {"cleaned": title_sql("title")})
FOLD = lambda e: f"regexp_replace({fold_sql(e)}, '[^a-z0-9]', '', 'g')"
rule("empty_title", "Titles that name a slot and no document.", "title string", TITLES, {"empty": lambda: X.fold(F.coalesce("title", F.lit(""))).isin(*EMPTY_TITLES)}, {"empty": f"{FOLD('coalesce(title, ' + chr(39) * 2 + ')')} IN ({quoted(EMPTY_TITLES)})"})
rule("first_policy_match", "The first pattern that the folded file name or link text holds.", "file string, anchor string", [("Ücret-Tarifesi.pdf", None), ("x.pdf", "Kâr Oranları"), ("kampanya_ücret.pdf", ""), ("rapor.pdf", "Yıllık")],
     {"found": lambda: X.first_match(("ucret", "tarife", "karoran", "kampanya"), C("file"), C("anchor"))},
     {"found": f"coalesce(list_filter(['ucret', 'tarife', 'karoran', 'kampanya'], lambda p: contains({FOLD('concat_ws(' + chr(39) + ' ' + chr(39) + ', file, anchor)')}, p))[1], '')"})
LABELS = {"ucret": "fees", "tarife": "fees", "komisyon": "fees", "karoran": "rates", "kampanya": "campaign", "sss": "faq"}
rule("policy_label", "The label that a pattern stands for.", "pattern string", [(p,) for p in (*LABELS, "sozlesme", "")], {"label": lambda: F.coalesce(F.element_at(mapped(LABELS), C("pattern")), F.lit("product"))}, {"label": f"coalesce({case(LABELS, 'pattern')}, 'product')"})

HEADS = [(h,) for h in ("", '---\nurl: "a"\ntitle: "b"\n---', '---\ncampaign_start: "old"\nurl: "a: b"\n\n---', "url: x")]
rule("set_header_field", "One field set in its place, or added before the closing line.", "head string", HEADS[1:], {"made": lambda: X.set_field(C("head"), "title", F.lit("new"))},
     {"made": """(CASE WHEN len(list_filter(string_split(head, chr(10)), lambda s: trim(string_split(s, ':')[1]) = 'title')) > 0 THEN array_to_string(list_transform(string_split(head, chr(10)), lambda s: CASE WHEN trim(string_split(s, ':')[1]) = 'title' THEN 'title: "new"' ELSE s END), chr(10))
     WHEN trim(string_split(head, chr(10))[-1]) = '---' THEN array_to_string(list_concat(string_split(head, chr(10))[:-2], ['title: "new"', string_split(head, chr(10))[-1]]), chr(10)) ELSE head || chr(10) || 'title: "new"' END)"""})  # fmt: skip
rule("set_header_dates", "Dates set in a header, empty ones too; old lines of theirs and blank lines go; a missing header is made.", "head string", HEADS,
     {"made": lambda: X.set_fields(C("head"), [("campaign_start", F.lit("2026-01-02")), ("campaign_end", F.lit(""))])},
     {"made": """'---' || chr(10) || array_to_string(list_concat(CASE WHEN head = '' THEN [] ELSE list_filter(string_split(head, chr(10)), lambda s: trim(s) NOT IN ('', '---') AND trim(string_split(s, ':')[1]) NOT IN ('campaign_start', 'campaign_end')) END, ['campaign_start: "2026-01-02"', 'campaign_end: ""']), chr(10)) || chr(10) || '---'"""})

PAGES_TEXT = [(k, t) for k, t in enumerate(("I am sorry, I can't see any image here.", "A fee of 12 TL applies.\n[unreadable]\n\n[unreadable] 3", " \n\t ", "x" * 99, "y" * 100, "  " + "z" * 100 + "\n", "NO IMAGE was given", "line\n[unreadable]"))]
rule("blind_answer", "Answers that say that there was nothing to see.", "id int, text string", PAGES_TEXT, {"blind": lambda: X.looks_blind(C("text"), ("can't see", "cannot see", "no image"))}, {"blind": "regexp_matches(lower(text), 'can''t see|cannot see|no image')"})
rule("unreadable_share", "The share of lines marked as unreadable.", "id int, text string", PAGES_TEXT, {"share": lambda: X.marked_line_ratio(C("text"), "[unreadable]")},
     {"share": "(SELECT CASE WHEN count(*) FILTER (trim(l, ' ' || chr(9)) <> '') = 0 THEN 0 ELSE count(*) FILTER (contains(l, '[unreadable]')) / count(*) FILTER (trim(l, ' ' || chr(9)) <> '') END FROM (SELECT unnest(string_split(text, chr(10))) AS l))"})
rule("page_has_text", "A page with a text layer.", "id int, text string", PAGES_TEXT, {"has_text": lambda: X.page_has_text(C("text"))}, {"has_text": "length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100"})
rule("email_key", "One spelling of an address of mail.", "email string", [("  Ada@Example.COM ",), ("x@y.z\n",), (None,), ("",)], {"key": lambda: X.email(C("email"))}, {"key": "lower(regexp_replace(email, '^\\s+|\\s+$', '', 'g'))"})
NOTICE = "Personal data notice: how this site handles what visitors tell it, and for how long it is kept."
rule("strip_notice", "A pasted notice goes up to the next heading.", "id int, text string", [(1, f"Intro.\n\n{NOTICE}\n\nMore of it.\n\n# Rates\n\nTwo."), (2, "Plain.\n\nText."), (3, NOTICE), (4, f"# A\n\n{NOTICE} changed\n\n## B\n\nc")],
     {"kept": lambda: X.strip_block(C("text"), (NOTICE,))},
     {"kept": f"""(WITH p AS (SELECT unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n), m AS (SELECT *, contains(substr(trim(p), 1, 120), '{NOTICE[:60]}') AS mark FROM p),
     g AS (SELECT *, max(CASE WHEN mark THEN n END) OVER (ORDER BY n) AS last_mark, max(CASE WHEN NOT mark AND starts_with(ltrim(p), '#') THEN n END) OVER (ORDER BY n) AS last_head FROM m)
     SELECT coalesce(string_agg(p, chr(10) || chr(10) ORDER BY n) FILTER (last_mark IS NULL OR coalesce(last_head, 0) > last_mark), '') FROM g)"""})  # fmt: skip

NAMES = [(n,) for n in ("İhtiyaç Finansmanı (12-36 Ay)", "Konut Kredisi 2. El", "ARAÇ  Kâr-Payı", "ŞUBE 3 ay", "Crème brûlée", "", None)]
WORDS_SQL = lambda e: f"trim(regexp_replace({fold_sql(e)}, '[^a-z0-9]+', ' ', 'g'))"
rule("fold_letters", "Letters and digits only.", "name string", NAMES, {"folded": lambda: X.fold(C("name"))}, {"folded": FOLD("name")})
rule("fold_words", "The same with word boundaries.", "name string", NAMES, {"folded": lambda: X.fold_words(C("name"))}, {"folded": WORDS_SQL("name")})
rule("product_stem", "A product's name without term bands and filler words.", "name string", NAMES,
     {"stem": lambda: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(X.fold_words(C("name")), "[0-9]+( [0-9]+)* ay\\b", " "), "\\b(finansmani|kredisi)\\b", " "), " +", " "))},
     {"stem": f"trim(regexp_replace(regexp_replace(regexp_replace({WORDS_SQL('name')}, '[0-9]+( [0-9]+)* ay\\b', ' ', 'g'), '\\b(finansmani|kredisi)\\b', ' ', 'g'), ' +', ' ', 'g'))"})
rule("any_word", "Whether a text holds any of some words.", "name string", NAMES, {"found": lambda: X.contains_any(X.fold_words(C("name")), ("konut", "arac"))}, {"found": f"contains({WORDS_SQL('name')}, 'konut') OR contains({WORDS_SQL('name')}, 'arac')"})
rule("slug_with_fallback", "A file name of a title, or a fallback.", "name string", NAMES, {"slug": lambda: X.slug(F.coalesce("name", F.lit("")), "table")},
     {"slug": f"coalesce(nullif(regexp_replace(substr(replace({WORDS_SQL('coalesce(name, ' + chr(39) * 2 + ')')}, ' ', '-'), 1, 80), '-+$', ''), ''), 'table')"})
rule("topic_slug", "A slug that keeps letters of all scripts, up to 60.", "name string", NAMES, {"slug": lambda: F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.translate("name", "İ", "i")), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", ""), 1, 60)},
     {"slug": "substr(regexp_replace(regexp_replace(lower(translate(name, 'İ', 'i')), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)"})
rule("search_tokens", "Words of a folded query.", "name string", NAMES, {"tokens": lambda: F.array_join(F.filter(F.split(X.fold_words(C("name")), "[^\\p{L}\\p{N}]+"), lambda t: t != ""), "|")}, {"tokens": f"array_to_string(list_filter(string_split({WORDS_SQL('name')}, ' '), lambda t: t <> ''), '|')"})
rule("table_link", "A table's address from id and category, and back.", "id string, category string", [("a b", "finance"), ("ö/1", "cards"), ("x", "other")],
     {"link": lambda: F.when(C("category").isin("finance", "cards"), F.concat(F.lit("/en/compare/"), C("category"), F.lit("?table="), U.encoded(C("id"))))},
     {"link": f"CASE WHEN category IN ('finance', 'cards') THEN '/en/compare/' || category || '?table=' || {ENC.format(e='id')} END"})
LINKS = [(u,) for u in ("https://any.host/en/compare/finance?table=a%20b", "/en/compare/cards?x=1&table=%C3%B6", "/en/compare/loans?table=a", "/en/compare/finance", "/fr/compare/finance?table=a")]
rule("table_of_link", "Category and id of a table's address, whatever the host; anything else is none.", "link string", LINKS,
     {"category": lambda: F.nullif(F.regexp_extract("link", "^(?:https?://[^/]*)?/en/compare/(finance|cards)[?](?:[^#]*&)?table=[^&#]+", 1), F.lit("")), "id": lambda: F.nullif(U.decoded(F.regexp_extract("link", "^(?:https?://[^/]*)?/en/compare/(?:finance|cards)[?](?:[^#]*&)?table=([^&#]+)", 1)), F.lit(""))},
     {"category": "nullif(regexp_extract(link, '^(?:https?://[^/]*)?/en/compare/(finance|cards)[?](?:[^#]*&)?table=[^&#]+', 1), '')", "id": "nullif(url_decode(regexp_extract(link, '^(?:https?://[^/]*)?/en/compare/(?:finance|cards)[?](?:[^#]*&)?table=([^&#]+)', 1)), '')"})
PARTS = [(a, b, c) for a in ("Bank", "", None) for b in ("Title", "") for c in ("part", None)]
rule("passage_header", "Parts that say something, joined.", "bank string, title string, detail string", PARTS, {"header": lambda: F.array_join(F.filter(F.array("bank", "title", "detail"), lambda x: F.coalesce(x, F.lit("")) != ""), " — ")}, {"header": "array_to_string(list_filter([bank, title, detail], lambda x: coalesce(x, '') <> ''), ' — ')"})
MODELS = [(m, q) for m in ("big-e5", "qwen3-embed", "plain") for q in ("rates", "")]
rule("passage_text", "Header, blank line, body; one family of models wants a prefix.", "model string, body string", MODELS, {"passage": lambda: F.concat(F.when(C("model").contains("e5"), "passage: ").otherwise(""), F.lit("Bank — Title\n\n"), C("body"))}, {"passage": "CASE WHEN contains(model, 'e5') THEN 'passage: ' ELSE '' END || 'Bank — Title' || chr(10) || chr(10) || body"})
rule("query_text", "A query as each family of models wants it.", "model string, query string", MODELS, {"asked": lambda: F.when(C("model").contains("e5"), F.concat(F.lit("query: "), C("query"))).when(C("model").contains("qwen3"), F.concat(F.lit("Instruct: find passages\nQuery: "), C("query"))).otherwise(C("query"))},
     {"asked": "CASE WHEN contains(model, 'e5') THEN 'query: ' || query WHEN contains(model, 'qwen3') THEN 'Instruct: find passages' || chr(10) || 'Query: ' || query ELSE query END"})
rule("searchable_value", "Case and accents don't matter in a search.", "name string", NAMES, {"value": lambda: F.translate(F.lower(F.translate("name", X.FOLD_FROM, X.FOLD_TO)), X.MARKS_FROM, X.MARKS_TO)}, {"value": fold_sql("name")})
MARKS = [(t,) for t in ("done 🎉 now", "✅ ok", "plain", "a ❤️ b", "")]
rule("without_pictographs", "Text without pictographs, spaces in order.", "text string", MARKS, {"plain": lambda: X.without_pictographs(C("text"))}, {"plain": "trim(regexp_replace(regexp_replace(text, '[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]', '', 'g'), ' +', ' ', 'g'))"})

PRICES = [(t,) for t in ("6.684,28 TL", "18.114,26", "% 36.731684", "%3,75", "1,234.50", "-5,5", "bedava", "", None, "1.000", "0,99 %")]
TR = "coalesce(TRY_CAST(replace(replace(regexp_replace(text, '[^0-9,.-]', '', 'g'), '.', ''), ',', '.') AS DOUBLE), 0)"
rule("money_read", "Points between thousands, a decimal comma; nothing readable is 0.", "text string", PRICES, {"value": lambda: V.money(C("text"))}, {"value": TR})
rule("rate_read", "With a comma points part thousands, without one the point is decimal.", "text string", PRICES, {"value": lambda: V.rate(C("text"))}, {"value": f"CASE WHEN contains(text, ',') THEN {TR} ELSE coalesce(TRY_CAST(regexp_replace(text, '[^0-9,.-]', '', 'g') AS DOUBLE), 0) END"})
rule("money_english", "A point is decimal, commas part thousands.", "text string", PRICES, {"value": lambda: V.money_en(C("text"))}, {"value": "coalesce(TRY_CAST(regexp_replace(text, '[^0-9.-]', '', 'g') AS DOUBLE), 0)"})
CODES = [(c,) for c in ("TL", "trl", " usd ", "ALT (gr)", "GUM", "EURO", "Dolar", "XPT", "")]
code_sql = "coalesce(" + "CASE upper(trim(code)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CURRENCIES.items()) + " END, upper(trim(code)))"
rule("currency_symbol", "A bank's label of a currency as the shared symbol.", "code string", CODES, {"symbol": lambda: V.currency(C("code"))}, {"symbol": code_sql})
rule("self_quote", "The currency that all others are quoted in.", "code string", CODES, {"own": lambda: V.currency(C("code")) == "TRY"}, {"own": f"{code_sql} = 'TRY'"})
DAYS = [(d, m, y) for d, m, y in ((31, 2, 2026), (29, 2, 2024), (1, 12, 1999), (0, 1, 2026), (31, 4, 2026), (15, 13, 2026))]
rule("real_day", "A day as ISO text, or none where there is no such day.", "day int, month int, year int", DAYS, {"iso": lambda: V.day_month_year(C("day"), C("month"), C("year"))}, {"iso": "strftime(try_strptime(lpad(CAST(day AS VARCHAR), 2, '0') || '/' || lpad(CAST(month AS VARCHAR), 2, '0') || '/' || year, '%d/%m/%Y'), '%Y-%m-%d')"})
MONTH_NAMES = [(m,) for m in ("Ocak", "ŞUBAT", "subat", "Mayıs", "MAYIS", "agustos", "Eylul", "KASIM", "Aralik", "March", "")]
rule("month_of_name", "Months by name, in plain letters too.", "name string", MONTH_NAMES, {"month": lambda: V.month_number(C("name"))}, {"month": "CASE lower(translate(name, 'Iİ', 'ıi')) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.MONTHS.items()) + " END"})
ISO = [(a, b) for a, b in (("2026-01-02", "2026-03-04"), ("2026-01-02", None), (None, "2026-03-04"), (None, None), ("bad", "2026-02-30"))]
SHOW = lambda e: f"strftime(try_strptime({e}, '%Y-%m-%d'), '%d/%m/%Y')"
rule("day_shown", "ISO to day/month/year.", "start string, stop string", ISO, {"shown": lambda: F.date_format(F.try_to_date("start", "yyyy-MM-dd"), "dd/MM/yyyy")}, {"shown": SHOW("start")})
rule("window_shown", "Two days as a window, ? for an open side, - for none.", "start string, stop string", ISO, {"shown": lambda: V.window_text(F.try_to_date("start", "yyyy-MM-dd"), F.try_to_date("stop", "yyyy-MM-dd"))},
     {"shown": f"CASE WHEN {SHOW('start')} IS NULL AND {SHOW('stop')} IS NULL THEN '-' ELSE coalesce({SHOW('start')}, '?') || ' - ' || coalesce({SHOW('stop')}, '?') END"})
WINDOWS = [(w,) for w in ("02/01/2026 - 04/03/2026", "? - 04/03/2026", "02/01/2026 - ?", "-", "31/02/2026 - x", "")]
PARSE = lambda n: f"strftime(try_strptime(string_split(cell, ' - ')[{n}], '%d/%m/%Y'), '%Y-%m-%d')"
rule("window_read", "A shown window as two days; what can't be read is none.", "cell string", WINDOWS, {"start": lambda: F.date_format(V.window_dates(C("cell"))["start"], "yyyy-MM-dd"), "stop": lambda: F.date_format(V.window_dates(C("cell"))["end"], "yyyy-MM-dd")}, {"start": PARSE(1), "stop": PARSE(2)})
rule("iso_strict", "An ISO day, strictly.", "text string", [(t,) for t in ("2026-01-02", "2026-02-30", "02/01/2026", "", None)], {"day": lambda: F.when(C("text").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.date_format(F.try_to_date("text", "yyyy-MM-dd"), "yyyy-MM-dd"))},
     {"day": "CASE WHEN regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN strftime(try_strptime(text, '%Y-%m-%d'), '%Y-%m-%d') END"})
CELLS = [(c,) for c in ("12 TL", " ", "-", "Sunulmuyor", "not offered ", None, "SUNULMUYOR", "0")]
rule("cell_value", "Blank cells and those that say that there is no offer are none.", "value string", CELLS, {"shown": lambda: F.when(~F.lower(F.trim("value")).isin("", "-", "sunulmuyor", "not offered"), C("value"))}, {"shown": "CASE WHEN lower(trim(value)) NOT IN ('', '-', 'sunulmuyor', 'not offered') THEN value END"})
rule("cell_key", "Cells compared without case and outer spaces.", "value string", CELLS, {"key": lambda: F.lower(F.trim("value"))}, {"key": "lower(trim(value))"})
NOTES = [(a, b) for a in ("2026-01-02", None) for b in ("2026-03-04", None)]
rule("window_note", "A window for people.", "start string, stop string", NOTES, {"note": lambda: F.when(C("start").isNotNull() & C("stop").isNotNull(), F.concat_ws(" to ", "start", "stop")).when(C("stop").isNotNull(), F.concat(F.lit("until "), C("stop"))).when(C("start").isNotNull(), F.concat(F.lit("from "), C("start"))).otherwise("")},
     {"note": "CASE WHEN start IS NOT NULL AND stop IS NOT NULL THEN start || ' to ' || stop WHEN stop IS NOT NULL THEN 'until ' || stop WHEN start IS NOT NULL THEN 'from ' || start ELSE '' END"})
COLUMNS = [(c,) for c in ("rate", "rate (Validity)", "Validity", "x (validity)", "")]
rule("validity_column", "Columns that hold another one's validity.", "name string", COLUMNS, {"is_validity": lambda: C("name").endswith(" (Validity)")}, {"is_validity": "ends_with(name, ' (Validity)')"})
rule("term_unit_word", "Units of a term in two languages; others are none.", "unit string", [(u,) for u in ("Gün", "gun", " ay ", "MONTHS", "day", "year", "")], {"term": lambda: V.term_unit(C("unit"))}, {"term": "CASE WHEN lower(trim(unit)) IN ('gün', 'gun', 'day', 'days') THEN 'day' WHEN lower(trim(unit)) IN ('ay', 'month', 'months') THEN 'month' END"})
STAMPS = [(s,) for s in ("/Date(1735689600000)/", "/Date(1735689600000+0300)/", "/Date(-86400000)/", "x", "")]
rule("script_date", "Milliseconds since 1970 in a script's wrapping.", "text string", STAMPS, {"day": lambda: F.coalesce(quotes.ms_date(C("text")), F.lit(""))}, {"day": "coalesce(strftime(epoch_ms(TRY_CAST(regexp_extract(text, '\\((-?[0-9]+)', 1) AS BIGINT)), '%Y-%m-%d'), '')"})
HALVES = [(x,) for x in (1.005, 2.675, -1.005, 0.125, 10.0, 1e6)]
rule("round_half_up", "Half away from zero on the decimal that is written.", "value double", HALVES, {"rounded": lambda: F.round(C("value").cast("string").cast("decimal(20,6)"), 2).cast("double")}, {"rounded": "CAST(round(CAST(value AS DECIMAL(20,6)), 2) AS DOUBLE)"})
MONTHS_ON = [(d, n) for d, n in (("2026-01-31", 1), ("2024-01-31", 1), ("2026-12-15", 13), ("2026-03-31", -1))]
rule("months_on", "Months on from a day, clamped to the month's end.", "day string, months int", MONTHS_ON, {"then": lambda: F.date_format(F.add_months(F.to_date("day"), C("months")), "yyyy-MM-dd")}, {"then": "strftime(CAST(day AS DATE) + months * INTERVAL 1 MONTH, '%Y-%m-%d')"})
