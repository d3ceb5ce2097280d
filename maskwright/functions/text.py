"""Row-local text rewrites as column expressions. White space follows Unicode where (?U) is given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: tags removed with their inner text kept
MARKUP_TAGS = "mark ins u span font strike del"
#: fixed values: aliases of entity types
TYPE_ALIASES = {
    "ORG": "ORGANIZATION", "ORGANISATION": "ORGANIZATION", "PER": "PERSON", "LOC": "LOCATION", "GPE": "LOCATION",
    "DATE": "DATE_TIME", "TIME": "DATE_TIME", "EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "IBAN": "IBAN_CODE",
}
#: fixed values: what is trimmed from the ends of a span
TRIMMED = r"(?:</?br\s*/?>|</?\w+\s*/?>|</?br|<|/?>|\s+|[*\-_`~,:;.!?()\[\]{}|])+"


def stripped(c: Column) -> Column:
    """White space of any kind removed from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_markup(c: Column) -> Column:
    return stripped(F.regexp_replace(c, rf"(?i)</?(?:{'|'.join(MARKUP_TAGS.split())})(?:\s+[^>]*)?>", ""))


def clean_tag(c: Column) -> Column:
    """A role or tag for placeholders: upper case, runs of other characters one underscore, none at the ends; null is empty."""
    joined = F.regexp_replace(F.upper(stripped(F.coalesce(c, F.lit("")))), "[^A-Za-z0-9_ÄÖÜäöüß]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


def trim_bounds(value: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds of the span without tags, markdown, white space and punctuation at its ends; empty if nothing is left."""
    head = F.length(F.regexp_extract(value, f"(?iU)^{TRIMMED}", 0))
    inner = F.substring(value, head + 1, F.length(value))
    tail = F.length(F.regexp_extract(inner, f"(?iU){TRIMMED}$", 0))
    return start + head, end - tail


def gender_suffix(following: Column) -> Column:
    """Length of a German gender suffix (:in, *innen, _in, /innen) right at the start of what follows a span."""
    return F.length(F.regexp_extract(following, r"(?iU)^([:*_/]innen|[:*_/]in)\b", 1))


def term_key(c: Column) -> Column:
    """Comparison key of a term: trimmed and folded; full folding of ß as ss, other folds as lower case."""
    return F.regexp_replace(F.lower(stripped(c)), "ß", "ss")


def fingerprint(text: Column, start: Column, end: Column) -> Column:
    """md5 of 50 characters before, the span, and 50 after."""
    before = F.greatest(start - 50, F.lit(0))
    parts = text.substr(before + 1, start - before), text.substr(start + 1, end - start), text.substr(end + 1, F.lit(50))
    return F.md5(F.concat_ws("|", *parts))


def snippet(text: Column, start: Column, end: Column, width: int = 150, most: int = 250, mark: tuple[str, str] = ("<b>", "</b>")) -> Column:
    """A span in its surroundings, out to sentence ends up to `most` characters away, line breaks as spaces, HTML escaped, ellipses where cut."""
    size = F.length(text)
    rules = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    safe = lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), rules, F.translate(c, "\r\n", "  "))
    cut = lambda a, b: text.substr(a + 1, b - a)
    near, far = F.greatest(start - width, F.lit(0)), F.greatest(start - most, F.lit(0))
    a = near - F.length(F.regexp_extract(cut(far, near), r"[^.!?\n]*$", 0))
    a = F.when((a > 0) & cut(a, a + 1).isin(" ", "\n"), a + 1).otherwise(a)
    near = F.least(end + width, size)
    b = near + F.length(F.regexp_extract(cut(near, F.least(end + most, size)), r"^[^.!?\n]*", 0))
    b = F.when((b < size) & cut(b, b + 1).isin(".", "!", "?"), b + 1).otherwise(b)
    dots = lambda c: F.when(c, F.lit("…")).otherwise("")
    return F.concat(dots(a > 0), safe(cut(a, start)), F.lit(mark[0]), safe(cut(start, end)), F.lit(mark[1]), safe(cut(end, b)), dots(b < size))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / F.lit(3.5)).cast("int")


def entity_type(c: Column) -> Column:
    """Canonical name of an entity type: upper case, aliases resolved."""
    names = F.create_map(*(F.lit(x) for pair in TYPE_ALIASES.items() for x in pair))
    up = F.upper(stripped(c))
    return F.coalesce(names[up], up)


def model_json(c: Column) -> Column:
    """The JSON object in a model's answer: reasoning dropped, the first fenced block if there is one, outermost braces."""
    plain = stripped(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
    fenced = F.regexp_extract(plain, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.length(fenced) > 0, fenced).otherwise(plain)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return stripped(F.when(F.length(braces) > 0, braces).otherwise(body))


BREAK = r"<br\s*/?>"
BREAKS = rf"\s*(?:(?:{BREAK}|\n)\s*)+"
#: fixed values: what may mark an item of a list, and the words before which a hyphen stands for a part left out
BULLET, AND = "[-•–—]", "und|oder|bzw|sowie"


def clean_cell(c: Column) -> Column:
    """A Markdown table cell with broken words joined, bullets and paragraphs kept, stray breaks and dashes gone.

    The cell is cut at its runs of breaks. What stands between two pieces follows from the run and the pieces beside it: two
    <br> or more begin a paragraph, a bullet an item, a hyphen goes on with a word; other breaks are a space.
    """
    cell = stripped(c)
    runs, pieces = F.regexp_extract_all(cell, F.lit(BREAKS), F.lit(0)), F.split(cell, BREAKS, -1)

    def joined(x: Column) -> Column:
        piece = lambda i: F.coalesce(F.get(x["pieces"], i), F.lit(""))
        paragraph = lambda i: (i > 0) & (F.regexp_count(F.coalesce(F.get(x["runs"], i - 1), F.lit("")), F.lit(BREAK)) > 1)
        item = lambda i: ~paragraph(i) & piece(i).rlike(rf"^{BULLET}(\s|$)")
        goes_on = lambda i, begin: (i > 0) & ~paragraph(i) & piece(i - 1).rlike("[A-Za-zÄÖÜäöüß]-$") & piece(i).rlike(f"^{begin}")
        part_left_out = lambda i: goes_on(i, rf"(?i:{AND})\b")
        broken_word = lambda i: goes_on(i, "[a-zäöüß]") & ~part_left_out(i)
        bare_bullet = lambda i: (i >= 0) & item(i) & (F.length(piece(i)) == 1)

        def written(p: Column, i: Column) -> Column:
            sewn = (i == 0) | bare_bullet(i - 1) | broken_word(i) | (goes_on(i, "[A-ZÄÖÜ][a-zäöüß]") & ~part_left_out(i))
            before = F.when(item(i), " <br>- ").when(paragraph(i), " <br><br> ").when(sewn, "").otherwise(" ")
            body = F.when(item(i), F.regexp_replace(p, rf"^{BULLET}\s*", "")).otherwise(p)
            return F.concat(before, F.when(broken_word(i + 1), F.regexp_replace(body, "-$", "")).otherwise(body))

        return F.array_join(F.transform(x["pieces"], written), "")

    whole = F.get(F.transform(F.array(F.struct(runs.alias("runs"), pieces.alias("pieces"))), joined), F.lit(0))
    ends = rf"^(?:{BREAK}|\s)+|(?:{BREAK}|\s|{BULLET})+$"
    return stripped(F.regexp_replace(F.regexp_replace(whole, ends, ""), "[ \t]+", " "))


def loopback_url(c: Column) -> Column:
    """Whether an endpoint is http(s) on this host, without user info, query or fragment."""
    host = F.try_parse_url(c, F.lit("HOST"))
    return F.coalesce(
        c.rlike("(?i)^https?://") & F.lower(host).isin("localhost", "127.0.0.1", "[::1]", "::1") & F.try_parse_url(c, F.lit("USERINFO")).isNull() & F.try_parse_url(c, F.lit("QUERY")).isNull() & F.try_parse_url(c, F.lit("REF")).isNull(),
        F.lit(False),
    )


def model_name_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,199}$") & ~F.lower(c).rlike(r"(:|-)cloud$"), F.lit(False))


def json_mime(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^\s*application/(?:[a-z0-9.+-]+\+)?json\s*(?:;.*)?$"), F.lit(False))


def expiry_seconds(c: Column) -> Column:
    """Epoch seconds of an ISO time with a time zone; 0 for anything else, so that nothing counts as ready for ever."""
    zoned = c.rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})\s*$")
    return F.coalesce(F.when(zoned, F.try_to_timestamp(stripped(c)).cast("double")), F.lit(0.0))


def valid_name(c: Column, most: int = 200) -> Column:
    return F.coalesce((F.length(stripped(c)) > 0) & (F.length(c) <= most) & ~c.rlike(r"[\x00-\x1F\x7F]"), F.lit(False))


def valid_uuid4(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))
