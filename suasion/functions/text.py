"""Text column expressions (TXT01-05, PRJ07-09).

All are native Spark expressions so they stay inside whole-stage codegen.
Whitespace follows one ASCII contract shared with the DuckDB oracle
(space, tab, LF, CR, FF, VT); Python's ``str.split`` also splits on Unicode
blanks — the difference is documented, not emulated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class and sentence-end punctuation.
WS_PATTERN = "[ \\t\\n\\r\\f\\x0B]+"
SENTENCE_END = "([.!?])[ \\t\\n\\r\\f\\x0B]+"
SENT_SEP = "\u0001"
WORD = "[^ \\t\\n\\r\\f\\x0B]+"
# a token with a character that isn't punctuation; the leading run is possessive, so a long
# punctuation run is read once
KEPT_TOKEN = "(?<![^ \\t\\n\\r\\f\\x0B])\\p{Punct}*+[^ \\t\\n\\r\\f\\x0B][^ \\t\\n\\r\\f\\x0B]*+"
# punctuation run at a token edge: from the token's start, or up to its end (tried only where a run begins)
EDGE_PUNCT = ("(?<![^ \\t\\n\\r\\f\\x0B])\\p{Punct}++"
              "|(?<!\\p{Punct})\\p{Punct}++(?![^ \\t\\n\\r\\f\\x0B])")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Whitespace tokens; null text gives null, blank text an empty array."""
    return F.filter(F.split(_c(text), WS_PATTERN), lambda w: w != F.lit(""))


def word_count(text) -> Column:
    """TXT01: ``len(str.split())``; null in, null out — one regex scan, no token array."""
    return F.regexp_count(_c(text), F.lit(WORD))


def token_count(text) -> Column:
    """Number of 1-gram tokens (``size(lower_tokens(text))``) in one regex scan: a
    whitespace chunk survives the edge-punctuation strip iff it holds a
    non-punctuation character."""
    return F.regexp_count(_c(text), F.lit(KEPT_TOKEN))


def lower_tokens(text) -> Column:
    """TXT04: 1-gram tokens — lower case, whitespace split, outer punctuation stripped.

    The strip runs once per text (a punctuation run that starts or ends a token),
    which equals stripping every token but avoids a regex call per token.
    """
    stripped = F.regexp_replace(F.lower(_c(text)), EDGE_PUNCT, "")
    return tokens(stripped)


def sentences(text) -> Column:
    """TXT03: split after . ! ? followed by blanks; punctuation stays."""
    marked = F.regexp_replace(_c(text), SENTENCE_END, "$1" + SENT_SEP)
    return F.split(marked, SENT_SEP)


def join_tokens(arr) -> Column:
    """TXT05: tokens back to text with single blanks."""
    return F.array_join(_c(arr), " ")


def assemble_text(prompt, message, include_prompt: bool = True) -> Column:
    """PRJ07: "prompt + blank + message" (an empty prompt keeps the blank) or message only."""
    if not include_prompt:
        return _c(message)
    return F.concat(F.coalesce(_c(prompt), F.lit("")), F.lit(" "), _c(message))


def token_budget_merge(prompt, message, max_tokens: int) -> Column:
    """PRJ08: all message tokens, then leading prompt tokens up to the budget, prompt first."""
    p = tokens(F.coalesce(_c(prompt), F.lit("")))
    m = tokens(F.coalesce(_c(message), F.lit("")))
    keep = F.greatest(F.lit(max_tokens) - F.size(m), F.lit(0))
    return join_tokens(F.concat(F.slice(p, 1, keep), m))


def truncate_tokens(text, max_length: int) -> Column:
    """PRJ09: first ``max_length`` tokens."""
    return join_tokens(F.slice(tokens(text), 1, max_length))
