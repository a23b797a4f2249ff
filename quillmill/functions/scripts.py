"""Where texts change between Han and Latin script."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as browsers trim it. Fixed value.
BLANK = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What may stand between two scripts that meet. Fixed value.
FILLER = BLANK + "\u2060,，.。!！?？;；:：、\\-–—>→()（）\\[\\]【】\"“”'‘’/"
#: Fillers that lead over to what follows; a cut comes before them. Fixed value.
LEADING = ">→\\-–—"
#: As many cuts as one text gets. Fixed value.
MOST_CUTS = 6

_HAN = "一-鿿"
_WORD = re.compile("[A-Za-z]+(?:['’][A-Za-z]+)*")
_IDEOGRAM = re.compile(f"[{_HAN}]")
_MEET = re.compile(f"(?:(?<=[{_HAN}])[{FILLER}]*(?=[A-Za-z]))|(?:(?<=[A-Za-z])[{FILLER}]*(?=[{_HAN}]))")
_LABEL = re.compile(f"[A-Za-z][A-Za-z{BLANK}'’-]{{1,40}}[:：]")
_WORDS_APART = re.compile(f"[A-Za-z0-9][{BLANK}]+[A-Za-z]")
_AROUND = re.compile(f"^[{FILLER}]+|[{FILLER.replace(':：', '')}]+$")
_EDGES = re.compile(f"^[{BLANK}]+|[{BLANK}]+$")


def _words(text: str) -> int:
    return sum(1 for _ in _WORD.finditer(text))


def _ideograms(text: str) -> int:
    return len(_IDEOGRAM.findall(text))


def _begins_phrase(text: str, at: int, han: bool) -> bool:
    """Whether a long enough phrase of the script starts at ``at``."""
    if han:
        return _ideograms(text[at : at + 40]) >= 6 and _words(text[at : at + 24]) <= 1
    if _IDEOGRAM.search(text, at, at + 24):
        return False
    return _words(text[at : at + 80]) >= 3 or (_words(text[at : at + 40]) >= 2 and _LABEL.match(text[at : at + 40]) is not None)


def _label(text: str, start: int, stop: int, ideograms: int, words: int) -> bool:
    """Whether text[start:stop], of so many ideograms and words, is short, of one script and stands for itself: words, or a name with a colon."""
    if (words and ideograms) or not (2 <= ideograms <= 10 or words >= 2):
        return False
    text = _EDGES.sub("", _AROUND.sub("", text[start:stop]))
    return 0 < len(text) <= 24 and not re.search("[。！？!?；;]", text) and (text[-1] in ":：" or re.search(f"[{BLANK}]", text) is not None)


def cut_places(text: str) -> list[int]:
    """Where a text of both scripts is cut, as 0-based places; see ``script_cuts``."""
    end = len(text) - len(re.search(f"[{BLANK}]*$", text).group())
    begin = cut = re.match(f"[{BLANK}]*", text).end()
    body = text[:end]
    places: list[int] = []
    ideograms = words = 0  # since the last cut
    seen = begin
    for meet in _MEET.finditer(body, begin):
        ideograms += _ideograms(body[seen : meet.start()])
        words += _words(body[seen : meet.start()])
        seen, right = meet.start(), meet.end()
        between, han = meet.group(), body[right] >= "一"
        if not _begins_phrase(body, right, han):
            continue
        cue = re.search(f"[{LEADING}:：]", between) is not None
        if han:
            long = words >= 3 and cue and _WORDS_APART.search(body, cut, right) is not None
        else:
            long = ideograms >= 6 and cue
        if not long and not _label(body, cut, right, ideograms, words):
            continue
        lead = re.search(f"[{LEADING}]", between)
        cut = meet.start() + lead.start() if lead else right
        places.append(cut)
        ideograms = words = 0
        seen = right
        if len(places) == MOST_CUTS:
            break
    return places


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cuts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[] if t is None else cut_places(t) for t in batch], index=batch.index, dtype=object)


def script_cuts(text: Column) -> Column:
    """array<int>: where a text that runs Han and Latin writing together is cut (characters before the cut), at most six.

    Scripts meet where nothing but white space and punctuation stands between two letters. There the text is cut if a long
    phrase of the second script follows, and what is before it, from the last cut on, is either long and ends in a colon, a
    dash or an arrow, or is a short label of its own. A cut comes before a dash or an arrow, else before the next letter. Null
    and texts of one script have none. The scan hangs on the last cut, so it runs over Arrow batches, once over each text.
    """
    mixed = text.rlike(f"[{_HAN}]") & text.rlike("[A-Za-z]")
    return F.when(mixed, _cuts(F.when(mixed, text))).otherwise(F.array().cast("array<int>"))


def script_parts(text: Column) -> Column:
    """array<string>: the trimmed text cut by ``script_cuts``, each part trimmed, empty ones left out."""
    edge = f"^[{BLANK}]+|[{BLANK}]+$"
    body = F.regexp_replace(text, edge, "")
    return F.filter(F.transform(pieces(body, script_cuts(body)), lambda p: F.regexp_replace(p, edge, "")), lambda p: p != "")


def pieces(text: Column, cuts: Column) -> Column:
    """array<string>: ``text`` cut at ascending 0-based places."""
    starts, ends = F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(F.length(text)))
    return F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
