"""Text normalisation as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.binding import apply_sql, let_sql
from sieveline.functions.literals import quoted, raw

# Character classes and patterns the results depend on. They are written out
# because the engine's own \w, \s, \d and \v differ from the Unicode classes wanted here.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

RARE_LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = r"[\t\r\f\x0b]+"

HTML_TAG = r"<[^>]+>"
EMAIL = rf"{EDGE}[{WORD}.%-]++@[{WORD}.-]+\.[A-Za-z]{{2,}}{EDGE}"
URL = rf"(?<![{WORD}])(?:https?://|www\.)[^{SPACE}]+{EDGE}"
PHONE = (
    rf"(?:\+?{DIGIT}{{1,3}}[{SPACE}-]?)?(?:\({DIGIT}{{2,4}}\)[{SPACE}-]?)?"
    rf"{DIGIT}{{3,4}}[{SPACE}-]?{DIGIT}{{3,4}}"
)
# An edge in front of a digit; asking for the digit first is the cheaper test.
YEARS = rf"(?={DIGIT})(?<![{WORD}])({DIGIT}{{1,2}})[{SPACE}]*\+?[{SPACE}]*years(?![{WORD}])"

# Lines that never carry content, and the longest line that counts as a heading.
BOILERPLATE_LINES = ["resume", "curriculum vitae", "cv", "page"]
HEADING_MAX_CHARS = 40

_SPACES = "'" + "".join(f"\\u{ord(c):04x}" for c in SPACE_CHARS) + "'"


# SQL fragments: each takes and returns the text of an expression.


def strip_sql(x: str) -> str:
    # Trimming a character set walks the whole text; most texts need none of it.
    edges = f"contains({_SPACES}, left(w, 1)) or contains({_SPACES}, right(w, 1))"
    return let_sql(x, "w", f"if({edges}, trim(BOTH {_SPACES} FROM w), w)")


def _replace(x: str, pattern: str, by: str, *needles: str) -> str:
    """Replace matches; every match holds one of the needles, so without them skip the regex."""
    present = " or ".join(f"contains(v, {quoted(n)})" for n in needles)
    return let_sql(x, "v", f"if({present}, regexp_replace(v, {raw(pattern)}, {by}), v)")


def _erase(x: str, pattern: str, *needles: str) -> str:
    return _replace(x, pattern, "' '", *needles)


def html_sql(x: str) -> str:
    return _erase(x, HTML_TAG, "<")


def email_sql(x: str) -> str:
    return _erase(x, EMAIL, "@")


def url_sql(x: str) -> str:
    return _erase(x, URL, "://", "www.")


def phone_sql(x: str) -> str:
    # Every match holds three digits in a row; testing for them is the cheaper scan.
    erased = f"regexp_replace(v, {raw(PHONE)}, ' ')"
    return let_sql(x, "v", f"if(v rlike {raw(DIGIT + '{3}')}, {erased}, v)")


def repeated_lines_sql(x: str) -> str:
    """Most texts have nothing to drop, which the set of their short lines shows. Otherwise
    sorting by (key, place) puts copies next to each other, so a document costs n log n in its own
    number of lines rather than a scan of all earlier lines per line."""
    # Most texts break lines with \n only, which needs no regex.
    other_breaks = " or ".join(f"contains(v, {quoted(c)})" for c in RARE_LINE_BREAKS)
    pieces = let_sql(x, "v", f"if({other_breaks}, split(v, {raw(LINE_BREAK)}, -1), split(v, '\\n', -1))")
    # A final line break does not open another line.
    lines = let_sql(
        pieces,
        "r",
        f"transform(slice(r, 1, size(r) - if(element_at(r, -1) = '', 1, 0)), s -> {strip_sql('s')})",
    )
    boilerplate = ", ".join(quoted(b) for b in BOILERPLATE_LINES)
    short = f"transform(filter(l, s -> length(s) between 1 and {HEADING_MAX_CHARS}), s -> lower(s))"
    clear = f"size(array_distinct(k)) = size(k) and not arrays_overlap(k, array({boilerplate}))"

    keyed = "transform(l, (s, i) -> named_struct('key', lower(s), 'place', i, 'line', s))"
    kept = let_sql(
        f"sort_array({keyed})",
        "s",
        f"""filter(s, (e, i) -> e.key not in ({boilerplate}) and not (
            length(e.key) between 1 and {HEADING_MAX_CHARS} and coalesce(get(s, i - 1).key = e.key, false)))""",
    )
    in_order = f"sort_array(transform({kept}, e -> named_struct('place', e.place, 'line', e.line)))"
    thinned = f"transform({in_order}, e -> e.line)"
    return f"array_join({let_sql(lines, 'l', let_sql(short, 'k', f'if({clear}, l, {thinned})'))}, '\\n')"


def collapse_sql(x: str) -> str:
    x = f"replace({x}, '\\u00a0', ' ')"
    x = _replace(x, BLANKS, "' '", "\t", "\r", "\f", "\x0b")
    x = _replace(x, r"\n{3,}", "'\\n\\n'", "\n\n\n")
    x = _replace(x, " {2,}", "' '", "  ")
    return strip_sql(x)


def clean_sql(x: str) -> str:
    x = f"coalesce(cast({x} as string), '')"
    for step in (html_sql, email_sql, url_sql, phone_sql, repeated_lines_sql, collapse_sql):
        x = step(x)
    return f"lower({x})"


def cap_sql(x: str, max_chars: int) -> str:
    return strip_sql(f"substr({strip_sql(x)}, 1, {max_chars})")


# Column functions.


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(text, F.lit(SPACE_CHARS))


def strip_html(text: Column) -> Column:
    return apply_sql(text, "t", html_sql("t"))


def strip_email(text: Column) -> Column:
    return apply_sql(text, "t", email_sql("t"))


def strip_url(text: Column) -> Column:
    return apply_sql(text, "t", url_sql("t"))


def strip_phone(text: Column) -> Column:
    return apply_sql(text, "t", phone_sql("t"))


def drop_repeated_lines(text: Column) -> Column:
    """Drop boilerplate lines and later copies of short lines, ignoring case."""
    return apply_sql(text, "t", repeated_lines_sql("t"))


def collapse_whitespace(text: Column) -> Column:
    return apply_sql(text, "t", collapse_sql("t"))


def clean_text(text: Column) -> Column:
    """The full cleaning chain; null becomes the empty string."""
    return apply_sql(text, "t", clean_sql("t"))


def cap_text(text: Column, max_chars: int) -> Column:
    return apply_sql(F.coalesce(text, F.lit("")), "t", cap_sql("t", max_chars))


def noise_counts(text: Column) -> Column:
    """How many matches each erasing rule finds in the raw text."""
    rules = {"n_html": HTML_TAG, "n_email": EMAIL, "n_url": URL, "n_phone": PHONE}
    counts = [F.regexp_count(text, F.lit(p)).cast("long").alias(name) for name, p in rules.items()]
    return F.struct(*counts)


# Start of each run of ten decimal digits in the basic plane.
DIGIT_ZEROS = [
    0x0030, 0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6,
    0x0D66, 0x0DE6, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x1090, 0x17E0, 0x1810, 0x1946, 0x19D0, 0x1A80,
    0x1A90, 0x1B50, 0x1BB0, 0x1C40, 0x1C50, 0xA620, 0xA8D0, 0xA900, 0xA9D0, 0xA9F0, 0xAA50, 0xABF0,
    0xFF10,
]


def years_experience(text: Column) -> Column:
    """Largest one- or two-digit number in front of the word "years", else 0."""
    wide = "".join(chr(z + d) for z in DIGIT_ZEROS[1:] for d in range(10))
    narrow = "0123456789" * (len(DIGIT_ZEROS) - 1)
    # Digits outside ASCII are valid matches; they are mapped before the cast.
    number = f"try_cast(translate(d, {quoted(wide)}, '{narrow}') as int)"
    found = f"regexp_extract_all(t, {raw(YEARS)}, 1)"
    best = f"if(contains(t, 'years'), coalesce(array_max(transform({found}, d -> {number})), 0), 0)"
    return apply_sql(F.lower(F.coalesce(text, F.lit(""))), "t", best)


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""
