"""Scalar text functions as Column expressions, all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_ansi(x: Column) -> Column:
    """Without colour codes and carriage returns."""
    return F.regexp_replace(x, "\u001b\\[[0-9;]*m|\r", "")


def collapse_blanks(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clip(x: Column, n: int) -> Column:
    """The first n characters and '...' of a longer text."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


#: Notes of what a middle clip left out, by where they are used; {n} is the number of characters.
NOTES = {"observation": "\n[... {n} characters elided ...]\n", "turn": "\n[... {n} chars elided ...]\n", "traceback": "\n[... {n} chars elided from the middle ...]\n"}


def clip_middle(x: Column, cap: int, note: str = NOTES["observation"], even: bool = False) -> Column:
    """Both ends of a longer text around a note of what was left out; ``even`` takes half the cap, rounded down, of either end."""
    head = cap // 2
    before, after = note.split("{n}") if "{n}" in note else (note, None)
    said = F.lit(before) if after is None else F.concat(F.lit(before), (F.length(x) - cap).cast("string"), F.lit(after))
    return F.when(F.length(x) > cap, F.concat(F.left(x, F.lit(head)), said, F.right(x, F.lit(head if even else cap - head)))).otherwise(x)


# How an observation is shown to a model.
NO_OUTPUT = "Your command ran successfully and did not produce any output."
CLIPPED = "\n<response clipped: {n} characters elided from the middle>\n"
CLIP_ADVICE = "\n<NOTE>Observation exceeded {cap} characters. Run a command that produces less output, or pipe through head/tail/grep or redirect to a file. Do not use interactive pagers.</NOTE>"


def format_observation(x: Column, cap: int, empty: str = NO_OUTPUT) -> Column:
    """An observation as a model reads it: no colour codes, both ends of a long one with notes, under a heading; for an empty one a sentence alone."""
    body = F.regexp_replace(strip_ansi(F.coalesce(x, F.lit(""))), r"^\s+|\s+$", "")
    advice = F.when(F.length(body) > cap, CLIP_ADVICE.replace("{cap}", str(cap))).otherwise("")
    return F.when(body == "", F.lit(empty)).otherwise(F.concat(F.lit("Observation:\n"), clip_middle(body, cap, CLIPPED), advice))


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def html_escape(x: Column) -> Column:
    """The three characters that a page's text cannot hold."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def shell_quote(x: Column) -> Column:
    """A word as a POSIX shell reads it back."""
    return F.when(x == "", F.lit("''")).when(x.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), x).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def file_name(x: Column) -> Column:
    """Letters, digits, _ and - only; 'default' if nothing is left."""
    y = F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9_-]", "_"), "^_+|_+$", "")
    return F.when(y == "", "default").otherwise(y)


def count_matches(x: Column, what: str) -> Column:
    """Non-overlapping matches, whatever their case; 0 for an empty pattern."""
    if not what:
        return F.lit(0).cast("long")
    low = F.lower(x)
    return ((F.length(low) - F.length(F.replace(low, F.lit(what.lower()), F.lit("")))) / len(what)).cast("long")


def number_lines(x: Column) -> Column:
    """Each line behind its number in six places and a tab."""
    return F.array_join(F.transform(F.split(x, "\n", -1), lambda line, i: F.concat(F.lpad((i + 1).cast("string"), 6, " "), F.lit("\t"), line)), "\n")


def shift_indent(x: Column, by: int) -> Column:
    """Lines moved right by spaces, or left by as many as they begin with; blank lines stay."""
    one = (lambda s: F.when(F.trim(s) == "", s).otherwise(F.concat(F.lit(" " * by), s))) if by >= 0 else (lambda s: F.regexp_replace(s, f"^ {{1,{-by}}}", ""))
    return F.array_join(F.transform(F.split(x, "\n", -1), one), "\n")


def normal_answer(x: Column) -> Column:
    """Lower case, articles out, then ASCII punctuation out, blanks collapsed (in this order)."""
    y = F.regexp_replace(F.lower(x), r"\b(a|an|the)\b", " ")
    return collapse_blanks(F.regexp_replace(y, r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", ""))


def current_step(x: Column) -> Column:
    """The last STEP number in a text, null without one."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(r"STEP\s+(\d+)"), F.lit(1)), F.lit(-1)).cast("int")


def backoff(attempt: Column, base: float = 2.0, cap: float = 30.0) -> Column:
    """Seconds before a retry: doubling from ``base`` up to ``cap``."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt))


def action_mask(x: Column, names: list[str]) -> Column:
    """Values of named XML parameters replaced by a mask."""
    for n in names:
        x = F.regexp_replace(x, f"(?s)(<parameter={n}>).*?(</parameter>)", "$1<MASKED>$2")
    return x


# Backend spellings of finish reasons.
STOPPED, CUT_OFF = ("completed", "stop", "matched_stop", "eos", "aborted", "abort"), ("length", "max_tokens")


def finish_reason(x: Column) -> Column:
    """Backend spellings as stop or length; unknown ones pass, null is stop."""
    return F.when(x.isNull() | x.isin(*STOPPED), "stop").when(x.isin(*CUT_OFF), "length").otherwise(x)


def fill(template: str, **values: Column) -> Column:
    """A template with its {names} replaced by columns; a name without a column is an error."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if i % 2 == 0 else values[x].cast("string") for i, x in enumerate(parts)])
