"""Text expressions: folding, hashing, quality signals and un-nesting of lines and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they fold to, place by place: fixed values.
FOLD_FROM, FOLD_TO = "ıİşŞğĞçÇöÖüÜâÂîÎûÛ", "iissggccoouuaaiiuu"
MARKS_FROM, MARKS_TO = "áàäãåéèêëíìïóòôõúùñýÿß", "aaaaaeeeeiiioooouunyys"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(strip(text), 256), 1, 16)


def fold(text: Column) -> Column:
    """Plain lower-case letters and digits only: equal for spellings that differ in case, accents or punctuation."""
    plain = F.translate(F.lower(F.translate(text, FOLD_FROM, FOLD_TO)), MARKS_FROM, MARKS_TO)
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def fold_words(text: Column) -> Column:
    """As fold, with one space between words."""
    plain = F.translate(F.lower(F.translate(text, FOLD_FROM, FOLD_TO)), MARKS_FROM, MARKS_TO)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slug(text: Column, fallback: str = "item", most: int = 80) -> Column:
    made = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(fold_words(text), " ", "-"), "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(made == "", fallback).otherwise(made)


def lines(text: Column, least: int = 1) -> Column:
    """Trimmed lines of at least so many characters."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def unique_line_ratio(text: Column, least: int = 20, enough: int = 5) -> Column:
    own = lines(text, least)
    return F.when(F.size(own) < enough, 1.0).otherwise(F.size(F.array_distinct(own)) / F.size(own))


def is_stub(text: Column, least: int = 250) -> Column:
    return F.length(strip(text)) < least


def looks_like_contents(text: Column, marker: str = "— Site İçeriği") -> Column:
    """The marker of an index within the first 400 characters, or more than four fifths of the first 40 lines, if there are at least 20, are
    links in lists."""
    first = F.slice(lines(text), 1, 40)
    listed = F.filter(first, lambda s: s.startswith("- [") | s.startswith("* ["))
    return F.substring(text, 1, 400).contains(marker) | (F.size(first) >= 20) & (F.size(listed) > 0.8 * F.size(first))


def language_score(text: Column, letters: str, words: tuple[str, ...], first: int = 8000) -> Column:
    """Mean of three capped signals of a language over the first characters: its special letters among all letters, its function words, and the
    share of letters. 0 for fewer than 40 characters."""
    own = F.substring(text, 1, first)
    n, n_letters = F.length(own), F.length(F.regexp_replace(own, "[^\\p{L}]", ""))
    special = F.when(n_letters == 0, 0.0).otherwise(F.least((n - F.length(F.regexp_replace(own, f"[{letters}]", ""))) / n_letters * 25, F.lit(1.0)))
    tokens = F.array_distinct(F.split(F.lower(own), "[^\\p{L}\\p{N}_]+"))
    function = F.least(F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))) / 6, F.lit(1.0))
    alpha = F.least(n_letters / n * 1.5, F.lit(1.0))
    return F.when(F.length(strip(own)) < 40, 0.0).otherwise(F.round((special + function + alpha) / 3, 3))


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: text.contains(m))


def looks_blind(text: Column, markers: tuple[str, ...]) -> Column:
    """An answer that says that there was nothing to see."""
    return contains_any(F.lower(text), markers)


def marked_line_ratio(text: Column, marker: str) -> Column:
    """The share of lines that hold a marker; 0 without lines."""
    own = lines(text)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda s: s.contains(marker))) / F.size(own))


def page_has_text(text: Column, least: int = 100) -> Column:
    return F.length(strip(text)) >= least


def clean_title(title: Column, names: tuple[str, ...]) -> Column:
    """Without what follows the last separator, for each of four separators in turn, where that names one of the given sites."""
    own = strip(F.coalesce(title, F.lit("")))
    for sep in ("|", "/", "—", "–"):
        tail, head = F.substring_index(own, sep, -1), F.regexp_extract(own, f"(?s)^(.*)[{sep}]", 1)
        named = contains_any(fold(tail), tuple(n.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO)) for n in names)) if names else F.lit(True)
        own = F.when(own.contains(sep) & (strip(head) != "") & named, strip(head)).otherwise(own)
    return F.regexp_replace(own, "^[ |/—–-]+|[ |/—–-]+$", "")


def first_match(patterns: tuple[str, ...], *texts: Column) -> Column:
    """The first pattern that the folded texts hold; "" for none."""
    whole = fold(F.concat_ws(" ", *texts))
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, patterns)), lambda p: whole.contains(p)), F.lit(0)), F.lit(""))


def strip_block(text: Column, marks: tuple[str, ...]) -> Column:
    """Without the blocks that a mark's first 60 characters announce in a paragraph's first 120, each up to the next heading."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))

    def step(state: Column, p: Column) -> Column:
        marked = contains_any(F.substring(strip(p), 1, 120), tuple(m[:60] for m in marks))
        skip = marked | state["skip"] & ~F.ltrim(p).startswith("#")
        return F.struct(F.when(skip, state["kept"]).otherwise(F.concat(state["kept"], F.array(p))).alias("kept"), skip.alias("skip"))

    return F.array_join(F.aggregate(F.split(text, "\n\n"), start, step, lambda s: s["kept"]), "\n\n")


def set_field(head: Column, key: str, value: Column) -> Column:
    """A header with a field set: its line replaced, or added before the closing line."""
    line = F.concat(F.lit(f'{key}: "'), value, F.lit('"'))
    own = F.split(head, "\n")
    is_key = lambda s: F.trim(F.substring_index(s, ":", 1)) == key
    last = F.element_at(own, -1)
    added = F.when(F.trim(last) == "---", F.concat(F.slice(own, F.lit(1), F.size(own) - 1), F.array(line, last))).otherwise(F.concat(own, F.array(line)))
    return F.array_join(F.when(F.exists(own, is_key), F.transform(own, lambda s: F.when(is_key(s), line).otherwise(s))).otherwise(added), "\n")


def set_fields(head: Column, fields: list[tuple[str, Column]]) -> Column:
    """A header with fields set: their old lines and blank lines go, new ones come last; a missing header is made."""
    inner = F.filter(F.split(head, "\n"), lambda s: (F.trim(s) != "") & (F.trim(s) != "---") & ~F.trim(F.substring_index(s, ":", 1)).isin(*[k for k, _ in fields]))
    new = F.array(*[F.concat(F.lit(f'{k}: "'), v, F.lit('"')) for k, v in fields])
    return F.concat(F.lit("---\n"), F.array_join(F.concat(F.when(head == "", F.array().cast("array<string>")).otherwise(inner), new), "\n"), F.lit("\n---"))


def email(text: Column) -> Column:
    return F.lower(strip(text))


def strip_links(text: Column) -> Column:
    """Markdown links and images as their labels."""
    return F.regexp_replace(text, "!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and page furniture dropped, tags as spaces, five entities, single spaces."""
    bare = F.regexp_replace(html, "(?is)<(script|style|nav|footer|header)\\b.*?</(script|style|nav|footer|header)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of overlapping windows that leave no gap."""
    return F.sequence(F.lit(0), F.greatest(length - overlap, F.lit(1)) - 1, F.lit(size - overlap))


def windows(text: Column, size: int, overlap: int) -> Column:
    return F.transform(window_starts(F.length(text), size, overlap), lambda s: F.substring(text, s + 1, F.lit(size)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+"), lambda s: F.trim(s)), lambda s: s != "")


def packed(pieces: Column, most: int, gap: str = " ") -> Column:
    """Pieces joined in order while they fit into `most` characters; a longer piece stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, piece: Column) -> Column:
        fits = (state["open"] == "") | (F.length(state["open"]) + len(gap) + F.length(piece) <= most)
        joined = F.when(state["open"] == "", piece).otherwise(F.concat(state["open"], F.lit(gap), piece))
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"), F.when(fits, joined).otherwise(piece).alias("open"))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def chunks(text: Column, most: int) -> Column:
    """A text as it is up to `most` characters; a longer one as paragraphs packed in order; those still longer as sentences packed; those still longer
    are cut."""
    stripped = lambda pieces: F.transform(pieces, lambda s: strip(s))
    short = lambda p: F.length(p) <= most
    by_sentence = lambda p: F.when(short(p), F.array(p)).otherwise(stripped(packed(F.split(p, "(?<=[.!?])\\s+"), most)))
    by_cut = lambda p: F.when(short(p), F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most))))
    pieces = F.flatten(F.transform(stripped(packed(F.split(text, "\n\n"), most, "\n\n")), by_sentence))
    return F.when(short(text), F.array(text)).otherwise(F.filter(F.flatten(F.transform(pieces, by_cut)), lambda s: s != ""))


def with_overlap(pieces: Column, n: int) -> Column:
    """Each piece but the first behind the last n characters of the one before it, from a word's beginning."""
    def lead(p: Column) -> Column:
        tail = F.when(F.length(p) > n, F.substring(p, -n, n)).otherwise(p)
        at = F.locate(" ", tail)
        return F.when((at >= 1) & (at < F.length(tail)), F.substring(tail, at + 1, F.length(tail))).otherwise(tail)

    return let(pieces, lambda c: F.transform(c, lambda p, i: F.when((i == 0) | (strip(lead(F.get(c, i - 1))) == ""), p).otherwise(F.concat(lead(F.get(c, i - 1)), F.lit("\n\n"), p))))


def ends_cut(text: Column) -> Column:
    """Whether the last line is a heading or lacks a final mark."""
    last = F.element_at(F.concat(F.array(F.lit("")), lines(text)), -1)
    return last.startswith("#") | ~last.rlike("[.!?:;…)\"»]$")


def without_pictographs(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]", ""), " +", " "))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name, from SHA-1 of the namespace's bytes and the name's."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
