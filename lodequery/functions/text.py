"""Tokens, normal forms, stop words and stems.

Column expressions work inside whole-stage codegen; the Python kernels are for
what Spark has no expression for (Unicode compatibility folding, stemming) and
are meant to run over distinct vocabularies.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The token pattern, the longest token, and the stop words.
TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:['’ʼ][\p{L}\p{N}]+)*"
MAX_TOKEN_LENGTH = 64
STOPWORDS = (
    "a about above after again against all am an and any are arent as at "
    "be because been before being below between both but by cannot cant could couldnt "
    "did didnt do does doesnt doing dont down during each few for from further "
    "had hadnt has hasnt have havent having he hed hes her here heres hers herself him himself his how hows "
    "i id if ill im in into is isnt it its itself ive lets me more most mustnt my myself "
    "no nor not of off on once only or other ought our ours ourselves out over own "
    "same shant she shed shes should shouldnt so some such "
    "than that thats the their theirs them themselves then there theres these they theyd theyll theyre theyve this "
    "those through to too under until up very was wasnt we wed were werent weve what whats when whens "
    "where wheres which while who whom whos why whys with wont would wouldnt "
    "you youd youll youre your yours yourself yourselves youve"
).split()

_MARKS = regex.compile("[̀-ͯ]")
_OTHERS = regex.compile(r"[^\p{L}\p{N}\p{M}]")

#: Letters that fold by a plain substitution; every other non-ASCII token goes through ``fold_token``.
_SIMPLE = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_SIMPLE_BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in _SIMPLE)
_PLAIN = rf"^[A-Za-z0-9'’ʼßØøÆæ{_SIMPLE}]*$"


def fold_token(raw: str | None) -> str | None:
    """NFKC, lower case, accents of the Latin kind off, then only letters, digits and marks."""
    if raw is None:
        return None
    if raw.isascii():
        return _OTHERS.sub("", raw.lower())
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", raw).lower())
    return _OTHERS.sub("", unicodedata.normalize("NFC", _MARKS.sub("", text)))


@F.pandas_udf(StringType())
def fold_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(fold_token)


def fold_plain(token: Column) -> Column:
    """``fold_token`` for tokens of ASCII and Latin-1 letters only, without Python."""
    return F.regexp_replace(F.lower(F.translate(token, _SIMPLE, _SIMPLE_BASE)), r"['’ʼ]", "")


def is_plain(token: Column) -> Column:
    return token.rlike(_PLAIN)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def raw_tokens(text: Column) -> Column:
    """All matches of the token pattern of at most 64 UTF-16 units, left to right."""
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    # A token without characters beyond the BMP has as many units as code points.
    return F.filter(found, lambda t: (F.length(t) <= MAX_TOKEN_LENGTH // 2) | (utf16_length(t) <= MAX_TOKEN_LENGTH))


def is_stopword(term: Column) -> Column:
    return term.isin(STOPWORDS)


# -- stemming ---------------------------------------------------------------
# The published suffix-stripping algorithm (Porter 1980, with the author's later
# bli -> ble and logi -> log), driven by a consonant/vowel shape string.

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _shape(word: str) -> str:
    """One of c, v for each letter; y is a vowel after a consonant."""
    out = []
    for ch in word:
        if ch in "aeiou" or (ch == "y" and out and out[-1] == "c"):
            out.append("v")
        else:
            out.append("c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    fitting = [e for e in endings if word.endswith(e)]
    return max(fitting, key=len) if fitting else None


@lru_cache(maxsize=50_000)
def porter_stem(word: str) -> str:
    """The stem; words of fewer than three letters stay as they are."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 1:
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        ending = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else ""
        if ending and "v" in _shape(w[: -len(ending)]):
            w = w[: -len(ending)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = _longest(w, table)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, _STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(porter_stem, na_action="ignore")
