"""Text cleaning: escapes, template wikitext, file names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# One escape sequence, or a run without any. Surrogates are matched as pairs
# because a lone half has no UTF-8 form.
_PAIR = r"\\u+\+?[dD][89abAB][0-9a-fA-F]{2}\\u+\+?[dD][c-fC-F][0-9a-fA-F]{2}"
_CODE = r"\\u+\+?[0-9a-fA-F]{4}"
_OCTAL = r"\\(?:[0-3][0-7]{2}|[0-7]{1,2})"
_TOKEN = rf"(?s){_PAIR}|{_CODE}|{_OCTAL}|\\.|\\$|[^\\]+"


def _unescape_token(token: Column) -> Column:
    code = F.regexp_replace(token, r"\\u+\+?", "")
    return (
        F.when(~token.startswith("\\"), token)
        .when(token.rlike(rf"^(?:{_PAIR})$"), F.decode(F.unhex(code), "UTF-16BE"))
        .when(token.rlike(r"^\\u+\+?[dD][89a-fA-F]"), F.lit("\ufffd"))
        .when(token.rlike(rf"^{_CODE}$"), F.decode(F.unhex(code), "UTF-16BE"))
        .when(token == "\\u", F.lit(None).cast("string"))
        .when(token.rlike(r"^\\[0-7]"), F.char(F.conv(F.substring(token, 2, 3), 8, 10).cast("int")))
        # The letters of the control escapes.
        .otherwise(F.translate(F.substring(token, 2, 1), "ntrbf", "\n\t\r\b\f"))
    )


def unescape(s: Column) -> Column:
    """Undo Java string escapes; null when a ``\\u`` has no four hex digits.

    An unknown escape loses its backslash. Strings without a backslash, the
    usual case, skip the tokenizing altogether.
    """
    tokens = F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0))
    # A null among the pieces must not vanish in the join.
    whole = F.transform(
        F.array(F.transform(tokens, _unescape_token)),
        lambda pieces: F.when(
            F.forall(pieces, lambda piece: piece.isNotNull()), F.array_join(pieces, "")
        ),
    )
    return F.when(F.instr(s, "\\") == 0, s).otherwise(F.get(whole, F.lit(0)))


def escape(s: Column) -> Column:
    """The inverse used when writing diff lines: backslash, newline, tab, quote."""
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("'", "\\'")):
        s = F.replace(s, F.lit(plain), F.lit(escaped))
    return s


def unquote(s: Column) -> Column:
    """``u'x'`` and ``'x'`` give ``x``; any other literal stays as it is."""
    return (
        F.when(s.startswith("u'"), s.substr(F.lit(3), F.length(s) - 3))
        .when(s.startswith("'"), s.substr(F.lit(2), F.length(s) - 2))
        .otherwise(s)
    )


# Where template wikitext stops being literal text (magic words, parser
# functions, line ends, behaviour switches, numbered parameters, braces, section marks,
# inclusion tags, signatures, quotes), and the notes that are no part of it.
TEMPLATE_BREAKS = r'''\{\{[A-Z]+\}\}|\{\{#[^\n]*\}\}|\n|__[A-Z]+__|\{\{\{[0-9]\}\}\}|\{\{|\}\}|#|</?includeonly>|~~~~|~~~|'|"'''
TEMPLATE_NOTES = r"(?s)<noinclude>.*?</noinclude>"
MIN_FRAGMENT = 4


def template_fragments(text: Column, min_length: int = MIN_FRAGMENT) -> Column:
    """The literal pieces a substituted template leaves in a page.

    Documentation blocks are dropped, the rest is cut at wiki markup, and
    pieces shorter than ``min_length`` are left out. Quotes are cut points, so
    no piece needs quoting.
    """
    pieces = F.split(F.regexp_replace(text, TEMPLATE_NOTES, ""), TEMPLATE_BREAKS, -1)
    return F.filter(pieces, lambda piece: F.length(piece) >= min_length)


# The two wordings of the comment a substituted template leaves.
COMMENT_WORDINGS = ("<!-- Template:%s -->", "<!-- Added using Template:%s -->")


def template_name_variants(name: Column) -> Column:
    """The name with a small first letter, and capitalized with the rest small."""
    trimmed = F.trim(name)
    rest = F.substring(trimmed, 2, 2**31 - 1)
    lower = F.concat(F.lower(F.substring(trimmed, 1, 1)), rest)
    upper = F.concat(F.upper(F.substring(trimmed, 1, 1)), F.lower(rest))
    return F.array(lower, upper)


def template_comment_variants(name: Column) -> Column:
    """The four comments that mark a substitution of the template."""
    names = template_name_variants(name)
    return F.array(
        *[
            F.format_string(wording, names[i])
            for wording in COMMENT_WORDINGS
            for i in range(2)
        ]
    )


def template_comment_query(name: Column) -> Column:
    """The OR-ed query text of a template's comments, and its output path."""
    quoted = F.transform(
        template_comment_variants(name), lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    )
    return F.struct(
        F.array_join(quoted, " OR ").alias("query"),
        F.concat(F.lit("results/"), template_name_variants(name)[0], F.lit(".txt")).alias("output"),
    )


def safe_query_name(query: Column) -> Column:
    """A query as part of a file name: ``: ! < >`` become ``__``."""
    return F.regexp_replace(query, "[:!<>]", "__")


def safe_title_name(title: Column) -> Column:
    """A page title as a file name: ``/`` and ``:`` become ``__``."""
    return F.regexp_replace(title, "[/:]", "__")
