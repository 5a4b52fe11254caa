"""Pre-tokenisation pattern and its engine-specific spellings.

The reference pre-tokenises with a Unicode regex whose ``\\s`` is the Unicode white space; it lacks
U+001C to U+001F, which ``str.strip`` also removes. Java's and RE2's ``\\s`` differ from both, so the two
classes are written out and shared by the Spark (Java) pattern and the DuckDB (RE2) oracle pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's pre-tokenisation pattern (Python ``regex`` syntax) and special tokens.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|n't|\s+\p{L}+|\s+\p{N}+|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PAD, BOS, EOS, UNK = "[PAD]", "[BOS]", "[EOS]", "[UNK]"
SPECIALS = [(PAD, 0), (BOS, 1), (EOS, 2), (UNK, 3)]
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3


def _whitespace_ranges(strip: bool) -> list[tuple[int, int]]:
    """Code points with ``str.isspace()`` (what strip removes), or those of the pattern's ``\\s``; as ranges."""
    cps = [c for c in range(0x110000) if chr(c).isspace() and (strip or not 0x1C <= c <= 0x1F)]
    ranges: list[tuple[int, int]] = []
    for c in cps:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1] = (ranges[-1][0], c)
        else:
            ranges.append((c, c))
    return ranges


def _as_class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


# Java's and RE2's ``\s`` differ from Python's, so both engines get the same explicit class.
WS = _as_class(_whitespace_ranges(strip=False))
STRIP = _as_class(_whitespace_ranges(strip=True))
STRIP_CHARS = "".join(chr(c) for a, b in _whitespace_ranges(strip=True) for c in range(a, b + 1))


def _explicit(pattern: str) -> str:
    """Spell ``\\s`` / ``\\S`` (also inside a negated class) with the explicit whitespace class."""
    return pattern.replace("[^\\s", f"[^{WS}").replace("\\S", f"[^{WS}]").replace("\\s", f"[{WS}]")


# Java (Spark): the full pattern.
PATTERN = _explicit(PRETOKEN_PATTERN)
# The same tokens without their leading white space, and without those of white space alone. A letter after white space
# belongs to a run of letters, so n't does not begin there.
PATTERN_STRIPPED = _explicit("|".join(a.replace("n't", r"(?<!\s)n't") for a in PRETOKEN_PATTERN.split("|") if "\\s+" not in a
                                      or "[" in a))
# What strip also removes but the pattern takes for symbols.
STRIPPED_SYMBOLS = "".join(c for c in STRIP_CHARS if 0x1C <= ord(c) <= 0x1F)
# RE2 (DuckDB oracle) has no look-ahead: the look-ahead alternative is left out and the
# whitespace-only tokens it would have split are split afterwards (see ``duck_pretokenize``).
PATTERN_RE2 = _explicit("|".join(a for a in PRETOKEN_PATTERN.split("|") if "(?!" not in a))
WS_ONLY_RE2 = f"[{WS}]+"
LEADING_WS = f"^[{STRIP}]+"


def pretokenize(text: Column, strip: bool = True) -> Column:
    """Pre-tokens of ``text`` in order. ``strip`` drops leading whitespace and empty tokens (the
    encoding form); without it tokens keep their whitespace (the vocabulary-counting form, D7)."""
    toks = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    if not strip:
        return toks
    # A character-set trim equals Python's strip. Only texts with the separators U+001C to U+001F need one; in others
    # a token has white space at its front alone, which the pattern itself can leave out.
    stripped = F.filter(F.transform(toks, lambda t: F.btrim(t, F.lit(STRIP_CHARS))), lambda t: t != "")
    odd = F.translate(text, STRIPPED_SYMBOLS, "") != text
    return F.when(odd, stripped).otherwise(F.regexp_extract_all(text, F.lit(PATTERN_STRIPPED), F.lit(0)))


def characters(word: Column) -> Column:
    """Code points of a word (what Python's ``tuple(str)`` gives)."""
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def duck_pretokenize(text_sql: str, strip: bool = True) -> str:
    """DuckDB expression equal to :func:`pretokenize` (for the oracles)."""
    toks = f"regexp_extract_all({text_sql}, '{_sql(PATTERN_RE2)}')"
    if strip:
        s = f"list_transform({toks}, lambda t: regexp_replace(t, '{_sql(LEADING_WS)}|[{STRIP}]+$', '', 'g'))"
        return f"list_filter({s}, lambda t: t <> '')"
    # A whitespace-only token of length >= 2 that is not the last token stood before a non-space
    # character: the look-ahead would have split off its last character.
    return (f"flatten(list_transform({toks}, lambda t, i: CASE WHEN regexp_full_match(t, '{_sql(WS_ONLY_RE2)}') "
            f"AND length(t) >= 2 AND i < len({toks}) THEN [t[1:length(t) - 1], t[length(t):length(t)]] "
            f"ELSE [t] END))")


def _sql(s: str) -> str:
    return s.replace("'", "''")
