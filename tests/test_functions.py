"""Golden cases of the expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from quayside.functions import text, urls, values


@pytest.fixture()
def one(spark):
    def run(f, *args):
        row = spark.createDataFrame([tuple(args)], [f"c{i}" for i in range(len(args))])
        return row.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first().x

    return run


@pytest.mark.parametrize("url", ["http://h/p", "https://h:443/p", "http://h:80/p", "http://h:443/p", "HTTPS://H/p/", "https://h/p#x", "https://h/p?utm_source=a&gclid=3&FBCLID=1"])
def test_canonical_same(one, url):
    assert one(urls.canonical, url) == "https://h/p"


@pytest.mark.parametrize(("url", "want"), [("https://h:8443/p", "https://h:8443/p"), ("https://h/?b=2&a=1", "https://h/?a=1&b=2"), ("https://x.com.tr", "https://x.com.tr/"), ("mailto:a@b", ""), ("javascript:;", ""), ("", "")])
def test_canonical(one, url, want):
    assert one(urls.canonical, url) == want


def test_url_parts(one):
    assert one(lambda c: urls.same_site(c, "bank.com"), "https://www.bank.com/x") and not one(lambda c: urls.same_site(c, "bank.com"), "https://otherbank.com/x")
    assert one(urls.is_pdf, "https://h/a.PDF?x=1") and one(urls.is_asset, "https://h/a.css") and not one(urls.is_asset, "https://h/a")
    assert one(urls.ancestors, "https://h/a/b") == ["h", "h/a", "h/a/b"] and one(urls.parent, "https://h/a/b") == "https://h/a"
    assert one(urls.is_ghost, "https://h/{{slug}}") and one(urls.is_ghost, "https://") and not one(urls.is_ghost, "https://h/a")
    assert one(urls.title_from_slug, "https://h/x/konut-finansmani.html") == "Konut finansmani"


def test_text(one):
    assert one(text.text_hash, " a b\n") == one(text.text_hash, "a b")
    assert one(text.fold, "Sağlam Kart Troy") == "saglamkarttroy" and one(text.fold, "İhtiyaç Finansmanı") == one(text.fold, "IHTIYAC FINANSMANI")
    assert one(text.fold_words, "İŞYERİ kâr") == "isyeri kar"
    assert one(text.strip_links, "a [b](c) ![d](e)") == "a b d"
    assert one(lambda c: text.packed(text.sentences(c), 12), "One. Two two. Three three three. Four.") == ["One.", "Two two.", "Three three three.", "Four."]
    assert one(lambda c: text.uuid5("6ba7b8119dad11d180b400c04fd430c8", c), "http://www.ietf.org/rfc/rfc2616.txt") == str(__import__("uuid").uuid5(__import__("uuid").NAMESPACE_URL, "http://www.ietf.org/rfc/rfc2616.txt"))
    assert one(text.ends_cut, "a.\n# b") and not one(text.ends_cut, "a.\nb.")
    assert one(text.without_pictographs, "a 😀 b") == "a b"


@pytest.mark.parametrize("n", [0, 1, 800, 820, 821, 8196, 8197, 30000])
def test_windows_leave_no_gap(one, n):
    whole = "".join(chr(97 + i * 7 % 26) for i in range(n))
    got = one(lambda c: text.windows(c, 8196, 820), whole)
    joined = got[0] + "".join(p[820:] for p in got[1:])
    assert joined == whole


@pytest.mark.parametrize(("f", "s", "want"), [
    (values.money, "18.114,26 TRY", 18114.26), (values.money, "0,00 USD", 0.0), (values.money, "yok", 0.0), (values.rate, "% 36.731684", 36.731684), (values.rate, "% 0,175", 0.175), (values.money_en, "6,684.28", 6684.28),
    (values.currency, " tl ", "TRY"), (values.currency, "USD", "USD"), (values.term_unit, "Ay", "month"), (values.term_unit, "gün", "day"), (values.term_unit, "?", None),
])
def test_values(one, f, s, want):
    assert one(f, s) == want


@pytest.mark.parametrize(("s", "start", "end", "rule"), [
    ("**Kampanya Tarihleri**6.08.2026 - 31.12.2026", "2026-08-06", "2026-12-31", "label"), ("1.2.2026 — 3.4.2026 arası", "2026-02-01", "2026-04-03", "range"), ("3.4.2026 - 1.2.2026", None, None, ""), ("1 Nisan – 31 Aralık 2026", "2026-04-01", "2026-12-31", "prose"),
    ("31 Aralık 2026 tarihine kadar", None, "2026-12-31", "prose"), ("31.12.2026 tarihine kadar geçerlidir", None, "2026-12-31", "prose"), ("5 Mayıs 2026 ve 1 OCAK 2026, sonra 1 Subat 2027", "2026-01-01", "2026-05-05", "prose"),
    ("5 mayis 2026, yine 5 Mayıs 2026", None, "2026-05-05", "prose"), ("31.02.2026", None, None, ""), ("son gün 3.4.2026", None, None, ""), ("1 Ekim 1999", None, "1999-10-01", "prose"), ("", None, None, ""),
])
def test_validity(one, s, start, end, rule):
    got = one(values.validity, s)
    assert (got.start, got.end, got.rule) == (start, end, rule)


def test_dates(one):
    assert one(lambda c: values.is_active(c, "2026-08-01"), "2026-08-01") and not one(lambda c: values.is_active(c, "2026-08-01"), "2026-07-31") and one(lambda c: values.is_active(c, "2026-08-01"), "")
    assert one(lambda c: values.window_dates(c)["end"], "01/08/2026 - ?") is None and one(lambda c: values.window_dates(c)["end"], "? - 30/09/2026") == datetime.date(2026, 9, 30)
    noon = datetime.datetime(2026, 8, 4, 12)  # a Tuesday
    assert one(lambda c: values.next_run(c, 21, 30, tuple(range(7))), noon) == datetime.datetime(2026, 8, 4, 18, 30)
    assert one(lambda c: values.next_run(c, 9, 0, tuple(range(7))), noon) == datetime.datetime(2026, 8, 5, 6)


def test_validity_work_grows_with_the_text(spark):
    """A thousand labels without a date: no pass over the tokens for each pass over the tokens."""
    import time

    took = []
    for n in (2000, 16000):
        t = time.perf_counter()
        assert values.decide(["kampanya", "tarihleri", ":"] * n + "1 . 02 . 2024 - 3 . 02 . 2024".split()) == ("2024-02-01", "2024-02-03", "label")
        took.append(time.perf_counter() - t)
    assert took[1] < 40 * took[0]
