"""String helpers shared by the operators (pure column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's String.trim strips every char <= U+0020, not only the space.
_JAVA_WS = "".join(chr(i) for i in range(33))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_trim(c: Column | str) -> Column:
    """``btrim`` with the control/space set (no regex pass over the text)."""
    return F.btrim(_col(c), F.lit(_JAVA_WS))


def java_ltrim(c: Column | str) -> Column:
    """``java_trim`` of the beginning alone, which reads no further."""
    return F.ltrim(_col(c), F.lit(_JAVA_WS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often
    ``body`` names it (an expression written twice is otherwise evaluated twice
    inside branches and lambdas)."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def trim_long(c: Column) -> Column:
    """``java_trim`` that looks at the last byte first: a trim of the end goes
    over the whole text, which a text without spaces there can spare."""
    def trimmed(v):
        last = F.substring(v.cast("binary"), -1, 1)  # a byte over 32 is no space or part of one
        return F.when(last > F.lit(b" "), java_ltrim(v)).otherwise(java_trim(v))
    return let(c, trimmed)


def is_blank(c: Column | str) -> Column:
    """NULL or only whitespace (Java isBlank)."""
    return _col(c).isNull() | (F.regexp_replace(_col(c), r"^\s+|\s+$", "") == "")


def clean_list(c: Column | str, lower: bool = False) -> Column:
    """Drop NULL items, trim, optionally lower-case, drop empties; NULL list -> []."""
    arr = F.coalesce(_col(c), F.array().cast("array<string>"))
    t = F.transform(F.filter(arr, lambda x: x.isNotNull()),
                    lambda x: F.lower(java_trim(x)) if lower else java_trim(x))
    return F.filter(t, lambda x: x != "")


# ---- message formatting (X2-X7) -------------------------------------------------

# The HTML tags a message may keep, and the patterns that make
# a text look like a recommendation list.
ALLOWED_TAGS = ("b", "i", "u", "s", "code")
NUMBERED_BOLD = r"(?im)^\s*(\d+|[\*-]|•)\s*[\.)-]?\s*(<b>.+?</b>|<code>.+?</code>|\*\*.+?\*\*)"
PLAIN_NUMBERED = r"(?im)^\s*\d+\s*[\.)-]\s+[^\n]+"
BASIC_TAG = r"(?i)</?(b|i|u|s|code|br)>"


def strip_code_fence(c: Column | str) -> Column:
    """A text starting with ``` loses the opening fence (with its
    language tag) and everything from the last fence on."""
    return let(trim_long(_col(c)), lambda t: F.when(t.startswith("```"), java_trim(
        let(F.regexp_replace(t, r"^```[a-zA-Z0-9]*\s*", ""), lambda body: F.when(
            F.instr(body, "```") > 0, F.regexp_extract(body, r"(?s)^(.*)```", 1)).otherwise(body)))).otherwise(t))


def escape_html(c: Column | str) -> Column:
    """& < > " ' as entities (& first)."""
    x = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape_html(c: Column | str) -> Column:
    """The five entities back; &amp; goes first, so '&amp;lt;' decodes
    twice to '<' as in the reference."""
    x = _col(c)
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def markdown_to_html(c: Column | str) -> Column:
    """**b**, __u__, ~~s~~, `code` to tags, then every '*' removed."""
    x = F.regexp_replace(_col(c), r"(?s)\*\*(.+?)\*\*", "<b>$1</b>")
    x = F.regexp_replace(x, r"(?s)__([^_]+?)__", "<u>$1</u>")
    x = F.regexp_replace(x, r"(?s)~~([^~]+?)~~", "<s>$1</s>")
    x = F.regexp_replace(x, r"(?s)`([^`]+?)`", "<code>$1</code>")
    return F.replace(x, F.lit("*"), F.lit(""))


def remove_prompt_delimiters(c: Column | str) -> Column:
    return F.replace(F.replace(_col(c), F.lit("<<<"), F.lit("")), F.lit(">>>"), F.lit(""))


def _restore_allowed_tags(x: Column) -> Column:
    for tag in ALLOWED_TAGS:
        x = F.regexp_replace(x, rf"(?i)&lt;(/?){tag}&gt;", rf"<$1{tag}>")
    return F.regexp_replace(x, r"(?i)&lt;br\s*/?&gt;", "<br/>")


def sanitize_message(c: Column | str, allow_html: bool = False,
                     strip_delimiters: bool = False) -> Column:
    """Fence strip + trim, then escape -> markdown (plain), or markdown
    -> escape -> restore allowed tags and <br/> (allow_html). NULL -> ''."""
    src = F.coalesce(_col(c), F.lit(""))
    if strip_delimiters:
        src = remove_prompt_delimiters(src)

    def message(unfenced):
        if allow_html:
            out = _restore_allowed_tags(escape_html(markdown_to_html(unfenced)))
        else:
            out = markdown_to_html(escape_html(unfenced))
        return F.when(unfenced == "", F.lit("")).otherwise(java_trim(out))
    return let(strip_code_fence(src), message)


def html_to_plain(c: Column | str) -> Column:
    """<br> variants to newlines, other tags dropped, entities decoded."""
    x = _col(c)
    for br in ("<br/>", "<br />", "<br>"):
        x = F.replace(x, F.lit(br), F.lit("\n"))
    return unescape_html(F.regexp_replace(x, r"<[^>]+>", ""))


def _count(c: Column, needle: str) -> Column:
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle))


def looks_like_recommendation(c: Column | str) -> Column:
    """numbered/bulleted bold or code items, plain numbered lines, two
    <b>/<code> tags with a newline, or any basic tag with two newlines."""
    return let(strip_code_fence(F.coalesce(_col(c), F.lit(""))), lambda t: (t != "") & (
        t.rlike(NUMBERED_BOLD) | t.rlike(PLAIN_NUMBERED)
        | (((_count(t, "<b>") + _count(t, "<code>")) >= 2) & (F.instr(t, "\n") > 0))
        | (t.rlike(BASIC_TAG) & (_count(t, "\n") >= 2))))


# ---- dialog policy (X10) ----------------------------------------------------------

# Phrases that ask for recommendations right away, and the
# number of clarifying turns after which the bot stops asking.
RECOMMEND_NOW_PHRASES = ("дай рекоменда", "предложи фильм", "предложи фильмы",
                         "не задавай вопросы", "хочу рекомендации", "порекомендуй",
                         "давай фильмы", "give recommendation", "recommend now")
MAX_CLARIFY_TURNS = 2


def recommend_now(text: Column | str, clarifying: Column | str | None = None,
                  phrases=RECOMMEND_NOW_PHRASES) -> Column:
    """lower(text) contains a trigger phrase, or two clarifying turns
    were already asked."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    hit = F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(t, p))
    if clarifying is None:
        return hit
    return hit | (F.coalesce(_col(clarifying), F.lit(0)) >= MAX_CLARIFY_TURNS)


# ---- titles (P4) -----------------------------------------------------------------------

# Trailing-year patterns, tried in this order.
TRAILING_YEAR = (r"\s*[\(\[]?(?:18|19|20|21)\d{2}[\)\]]?\s*$",
                 r"\s*[–—-]\s*(?:18|19|20|21)\d{2}\s*$",
                 r"\s*,\s*(?:18|19|20|21)\d{2}\s*$")


def strip_trailing_year(title: Column | str) -> Column:
    """The first of the patterns that matches goes. That is always the first
    one: where a later one matches, it matches the bare year."""
    return java_trim(F.regexp_replace(java_trim(F.coalesce(_col(title), F.lit(""))), TRAILING_YEAR[0], ""))


def format_title(title: Column | str, verified_year: Column | str | None = None) -> Column:
    """Drop a trailing 18xx-21xx year, append ' (verified)' when given
    (an empty remainder gives just '(year)')."""
    cleaned = strip_trailing_year(title)
    if verified_year is None:
        return cleaned
    y = _col(verified_year).cast("string")
    # A cleaned title begins with no space, so only an empty one loses it.
    return F.when(y.isNull(), cleaned).otherwise(F.ltrim(F.concat(cleaned, F.lit(" ("), y, F.lit(")"))))
