"""Which of some patterns a text can match at all: Java's engine is asked only about these.

Java tries every alternative of a pattern at every place, which costs some hundred nanoseconds a character for a list of words.
A sieve has a wider form of each pattern, that matches wherever the pattern does and maybe elsewhere, and looks for it with an
automaton that reads a text once, in Arrow batches. Results are those of the patterns alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_BLANK, _BEYOND = r"\s\x0b\x1c-\x1f\x{85}\pZ", r"\x{80}-\x{10FFFF}"
#: Digits and letters beyond ASCII that patterns of digits, or of letters whatever their case, match too: such texts pass every sieve.
ODD = r"[ıİſK]|[^\x00-\x7F\P{Nd}]"


def widened(pattern: str) -> str:
    """A pattern for RE2 that matches wherever a pattern of Java's engine does. Lookarounds go; boundaries, which know ASCII alone, stay before ASCII letters and digits, at a pattern's end they are anything beyond ASCII as well, and else they go."""
    m = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    s = pattern[m.end() :] if m else pattern
    out, i, depth, inside = ["(?i)" if m and "i" in m[1] else ""], 0, 0, False
    while i < len(s):
        c, two = s[i], s[i : i + 2]
        if not inside and (look := re.match(r"\(\?<?[=!]", s[i:])):
            level, i = 1, i + look.end()
            while level:  # no brackets are quoted in the patterns' lookarounds
                level, i = level + (s[i] == "(") - (s[i] == ")"), i + 1
            continue
        if two == r"\Q":
            end = s.index(r"\E", i)
            out.append(re.escape(s[i + 2 : end]))
            i = end + 2
            continue
        if two == r"\b" and not inside:
            rest = s[i + 2 :]
            closed = re.match(r"\)*(?=$|\|)", rest)
            if re.match(r"\(\?:|[A-Za-z0-9]|\\d|\[[A-Za-z0-9]", rest):
                out.append(r"\b")
            elif closed and closed.end() == depth and s[i - 1].isascii() and (s[i - 1] != ")" or s.isascii()):
                out.append(r"(?:\b|[^\x00-\x7F])")
        elif two == r"\s":
            out.append(_BLANK if inside else f"[{_BLANK}]")
        elif two == r"\w":
            out.append(r"\w" + _BEYOND if inside else rf"[\w{_BEYOND}]")
        elif two == r"\u":
            out.append(rf"\x{{{s[i + 2 : i + 6]}}}")
            i += 4
        elif c == "\\":
            if two[1] in "BWSDAzZG":
                raise ValueError(f"no wider form of {two} in {pattern}")
            out.append(two)
        elif c == "$" and not inside:
            out.append(rf"(?:[{_BLANK}]|$)")
        elif c == "+" and not inside and i and s[i - 1] in "*+?" and s[i - 2 : i - 1] != "\\":
            pass  # a possessive count
        else:
            inside = c == "[" or inside and c != "]"
            depth += 0 if inside else (c == "(") - (c == ")")
            out.append(c)
        i += 2 if c == "\\" else 1
    return "".join(out)


class Sieve:
    """Up to 63 patterns, each with its wider form: of its own if given as a pair."""

    def __init__(self, *patterns: str | tuple[str, str]):
        self.wide = {p: widened(p) for p in patterns if isinstance(p, str)} | {p[0]: p[1] for p in patterns if not isinstance(p, str)}
        self.at = {p: i for i, p in enumerate(self.wide)}
        assert len(self.at) < 64
        self.all = (1 << len(self.at)) - 1

    def bits(self, text: pa.Array) -> pa.Array:
        """What of() gives, for a batch."""
        odd = pc.fill_null(pc.match_substring_regex(text, ODD), True)
        out = pc.if_else(odd, pa.scalar(self.all, pa.int64()), pa.scalar(0, pa.int64()))
        for i, p in enumerate(self.wide.values()):
            hit = pc.fill_null(pc.match_substring_regex(text, p), True)
            out = pc.bit_wise_or(out, pc.if_else(hit, pa.scalar(1 << i, pa.int64()), pa.scalar(0, pa.int64())))
        return out

    def of(self, text: Column) -> Column:
        """A number whose bits tell which patterns a text can match."""

        @arrow_udf(T.LongType())
        def bits(text: pa.Array) -> pa.Array:
            return self.bits(text)

        return bits(text)

    def any(self, bits: Column, *patterns: str) -> Column:
        """Whether a text can match one of the patterns."""
        return bits.bitwiseAND(F.lit(sum(1 << self.at[p] for p in patterns))) != 0

    def can(self, bits: Column, pattern: str) -> Column:
        return bits.bitwiseAND(F.lit(1 << self.at[pattern])) != 0

    def has(self, bits: Column, c: Column, pattern: str) -> Column:
        """c.rlike(pattern), given the bits of c or of a text that c is a part of."""
        return self.can(bits, pattern) & c.rlike(pattern)

    def count(self, bits: Column, c: Column, pattern: str) -> Column:
        return F.when(self.can(bits, pattern), F.regexp_count(c, F.lit(pattern))).otherwise(0)

    def matches(self, bits: Column, c: Column, pattern: str) -> Column:
        from granary.functions.text import matches

        return F.when(self.can(bits, pattern), matches(c, pattern)).otherwise(F.array().cast("array<string>"))
