"""White space of extracted text, as column expressions and in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spaces that count as one, characters that are dropped, caps on lengths.
WIDE_SPACES = "   -   　"
DROPPED = "­​-‍﻿"
MAX_TITLE, MAX_DESCRIPTION, MAX_TEXT = 300, 500, 200_000
# All white space that trimming removes.
JS_SPACE = "\t-\r    -     　﻿"


def even_spaces(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, f"[{WIDE_SPACES}]", " "), f"[{DROPPED}]", "")
    return F.regexp_replace(text, r"\r\n?", "\n")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{JS_SPACE}]+", ""), f"[{JS_SPACE}]+$", "")


def clean_inline(text: Column, limit: int = MAX_TITLE) -> Column:
    """One line, single spaces, at most ``limit`` characters."""
    flat = trim_all(F.regexp_replace(even_spaces(text), f"[{JS_SPACE}]+", " "))
    return F.when(F.length(flat) > limit, F.regexp_replace(F.substring(flat, 1, limit), f"[{JS_SPACE}]+$", "")).otherwise(flat)


def clean_block(text: Column) -> Column:
    """Lines without outer or repeated spaces and without empty lines between them."""
    spaced = F.regexp_replace(even_spaces(text), "[\t\u000b\f\r   ]+", " ")
    return trim_all(F.regexp_replace(spaced, r" *\n[ \n]*", "\n"))


def truncate(text: Column, limit: int = MAX_TEXT) -> Column:
    """At most ``limit`` characters, cut at a blank if one lies in the last tenth."""
    part = F.substring(text, 1, limit)
    back = F.regexp_instr(F.reverse(part), F.lit("[ \\n]"))
    cut = limit - back
    kept = F.when((back > 0) & (cut > limit * 0.9), F.substring(part, F.lit(1), cut)).otherwise(part)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(kept, f"[{JS_SPACE}]+$", ""))


_WIDE, _DROP, _ANY = re.compile(f"[{WIDE_SPACES}]"), re.compile(f"[{DROPPED}]"), re.compile(f"[{JS_SPACE}]+")


def even_text(text: str) -> str:
    return re.sub(r"\r\n?", "\n", _DROP.sub("", _WIDE.sub(" ", text)))


def inline_text(text: str, limit: int = MAX_TITLE) -> str:
    flat = _ANY.sub(" ", even_text(text)).strip(" ")
    return flat[:limit].rstrip() if len(flat) > limit else flat


def block_text(text: str, limit: int = MAX_TEXT) -> str:
    spaced = re.sub("[\t\u000b\f\r   ]+", " ", even_text(text))
    out = re.sub(r" *\n[ \n]*", "\n", spaced).strip(" \n﻿")
    if len(out) > limit:
        part = out[:limit]
        cut = max(part.rfind(" "), part.rfind("\n"))
        out = (part[:cut] if cut > limit * 0.9 else part).rstrip()
    return out
