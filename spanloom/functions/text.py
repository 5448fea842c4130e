"""Text normalisation and token extraction as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marked() -> dict[str, str]:
    """Lower-case Latin letters with marks and the plain letters that their decomposition begins with; đ folds to d."""
    letters = (chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))
    plain = {x: unicodedata.normalize("NFD", x)[0] for x in letters if x.islower()}
    return {"đ": "d"} | {x: y for x, y in plain.items() if y != x and y.isascii()}


MARKED, PLAIN = ("".join(x) for x in zip(*_marked().items(), strict=True))


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def fold_alnum(text: Column) -> Column:
    return F.regexp_replace(fold(text), "[^0-9a-z]", "")


def normalize_read(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def web_addresses(text: Column) -> Column:
    """Distinct host-like tokens in order of appearance, lower-cased."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?:[a-z0-9-]++\.)+(?:com|net|org|edu|gov|info)\b"), F.lit(0))
    return F.array_distinct(found)


# Words that end like an address without its dot, endings that are words too.
DOTLESS_WORDS = "SITCOM TELECOM INTERCOM DOTCOM INTERNET CABINET PLANET MAGNET GARNET SONNET BONNET HORNET CORNET SIGNET BAYONET CLARINET DRAGNET CYBORG".split()
WORD_ENDINGS = "me to us pro top fun win live link club site app bet vip co cc io ly gg info online".split()
# The patterns of an address in a read: a scheme or www, with its dot, with spaces beside
# the dot, with a comma for it, with nothing for it, with a space for it. (?U): \w and \s as in Unicode.
READ_SHAPES = [
    r"(?Ui)https?://|(?<![\w.@-])www(?![\w])",
    r"(?U)(?<![\w.@-])(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.)*[A-Za-z0-9][A-Za-z0-9-]{1,62}\.(?i:com|net|org|vn|tv|me|io|xyz|cc|co|info|top|club|link|live|online|site|biz|asia|pro|app|fun|vip|bet|win|us|to|ly|gg)(?![\w])",
    r"(?U)(?<![\w.@-])[A-Z0-9][A-Z0-9-]{2,62}(?:\s+\.\s*|\.\s+)(?:COM|NET|ORG|VN|TV)(?![\w])",
    r"(?U)(?<![\w.@-])[A-Z0-9][A-Z0-9-]{2,62}\s*,\s*(?:COM|NET|ORG)(?![\w])",
    r"(?U)(?<![\w.@-])[A-Z0-9][A-Z0-9-]{2,62}(?:COM|NET|ORG|VN|TV)(?![\w])",
    r"(?U)(?<![\w.@-])(?:[A-Z0-9][A-Z0-9-]{2,62}\sCOM|[A-Z0-9][A-Z0-9-]{3,62}\s(?:NET|ORG))(?![\w])",
]


def read_addresses(text: Column) -> Column:
    """Web addresses in a read, by shape and then in order of appearance, each once.

    Left out are ordinary words that end like an address, and ends of sentences whose next word is
    written on without a space (Wait.Me). A null text has none.
    """
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(shape), F.lit(0)) for shape in READ_SHAPES])
    ending = lambda x: F.regexp_extract(x, r"\.([A-Za-z]+)$", 1)
    word = lambda x: F.regexp_replace(F.upper(x), "[^A-Z]", "").isin(DOTLESS_WORDS)
    sentence = lambda x: F.lower(ending(x)).isin(WORD_ENDINGS) & ending(x).rlike("^[A-Z][a-z]+$")
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: ~word(x) & ~sentence(x)))


def slug_key(name: Column, digest: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.substring(slug, 1, 48), F.lit("-"), F.substring(digest, 1, 8))


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


#: What counts as a token of advertising: addresses with a scheme, www hosts, bare hosts under common
#: top domains, mail addresses, phone numbers of 8 to 18 digits and separators, handles.
AD_SHAPES = {
    "address": r"(?i)https?://[a-z0-9./?=&#_%~-]+",
    "www": r"(?i)\bwww\.[a-z0-9.-]+",
    "host": r"(?i)\b(?:[a-z0-9-]+\.)+(?:app|biz|co|com|info|io|me|net|online|org|shop|site|store|tv|vn|xyz)\b",
    "mail": r"(?i)[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z0-9.-]+",
    "phone": r"\+?[0-9][0-9 .-]{6,16}[0-9]",
    "handle": r"(?i)(?:^|[ >(])@[a-z0-9_.]{3,30}",
}


def ad_tokens(text: Column) -> Column:
    """Distinct tokens of advertising in a text, by shape and place, without the space or bracket before a handle."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, "^[ >(]", ""))) for p in AD_SHAPES.values()]
    return F.array_distinct(F.concat(*found))


def deletions(word: Column) -> Column:
    """The word and all that it becomes without one letter: words within one edit of each other share one of these."""
    each = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.when(F.length(word) > 0, F.concat(F.array(word), each)).otherwise(F.array(word)))


def memory_key(token: Column, least: int = 6) -> Column:
    """Folded letters and digits of an address without scheme or www; null if too short to be remembered."""
    key = fold_alnum(F.regexp_replace(F.lower(token), r"^\s*(?:https?:/*)?(?:www\.)?", ""))
    return F.when(F.length(key) >= least, key)


def latin_candidates(text: Column) -> Column:
    """Words, chunks without punctuation and neighbouring word pairs of a folded text, each once."""
    tokens = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
    chunks = F.transform(F.split(text, r"\s+"), lambda c: F.regexp_replace(c, "[^a-z0-9]", ""))
    pairs = F.transform(F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("b")), lambda p: F.concat(p["a"], p["b"]))
    return F.array_distinct(F.filter(F.concat(tokens, chunks, pairs), lambda x: x.isNotNull() & (x != "")))


def spread(values: Column, count: int) -> Column:
    """``count`` evenly spaced values, the first and the last among them."""
    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.size(values) - 1) / F.lit(float(count - 1))).cast("int") + 1)
    return F.when(F.size(values) <= count, values).otherwise(F.transform(places, lambda p: F.element_at(values, p)))
