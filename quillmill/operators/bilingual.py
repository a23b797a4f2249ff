"""Texts in two languages: runs of paragraphs that are brought to equal length, and card rows that belong together."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.scripts import BLANK, pieces, script_parts
from quillmill.functions.text import hard_end, han_chars, heading_like, language, latin_words
from quillmill.functions.urls import card_metadata

ORIGINAL, TRANSLATION, SPACER = "original", "translation", "spacer"
#: Classes of break places, best first; a place is the end of a match. Fixed values.
BREAKS = [r"\n+", rf"[。！？!?；;:：][{BLANK}]*", rf"[,，][{BLANK}]*", rf"[{BLANK}]+"]
#: How far from its target a break may be: this share of the text, within these bounds. Fixed values.
REACH, LEAST_REACH, MOST_REACH = 0.12, 6, 28
#: Marks that set off a list row. Fixed value.
MARKER = r"^([→➜•\-–—*]|\d+\s*[-.:：)]|[A-Za-z]\)|[A-Za-z]\.)\s*"
#: Inline marks in the html of a paragraph that is never cut. Fixed value.
MARKED = r"(?i)<(a|strong|em|code)\b"


def _edged(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def escaped(c: Column) -> Column:
    """Text as html."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def nearest_breaks(text: str, weights: list[int]) -> list[int]:
    """Where ``text`` is cut into parts as long as ``weights`` say: at the nearest break of the best class around each target."""
    n, total, places, start, sum_ = len(text), sum(weights), [], 0, 0
    reach = max(LEAST_REACH, min(MOST_REACH, int(n * REACH)))
    for left, weight in zip(range(len(weights) - 1, 0, -1), weights, strict=False):
        sum_ += weight
        target = (2 * n * sum_ + total) // (2 * total)  # rounded, halves up
        low, high = start + 1, n - left
        if low < high:
            target = min(max(target, low), high)
            first, last = max(low, target - reach), min(high, target + reach)
            for kind in BREAKS:
                ends = [first + m.end() for m in re.finditer(kind, text[first:last])]
                if ends := [e for e in ends if low < e < high]:
                    target = min(ends, key=lambda e: (abs(e - target), e))
                    break
        places.append(target)
        start = target
    return places


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _breaks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, weights in batches:
        found = [None if t is None or w is None else nearest_breaks(t, [int(x) for x in w]) for t, w in zip(texts, weights, strict=True)]
        yield pd.Series(found, index=texts.index, dtype=object)


def align_runs(rows: DataFrame, by_weight: bool = True) -> DataFrame:
    """(doc, side, pos, text, html): the paragraphs of a document's two languages, as many on one side as on the other.

    ``rows``: doc, side (original or translation), pos (ascending within a side), text, html. Sides of equal size, and sides
    without the other, stay as they are. A lone paragraph against n is cut at its blank lines, if that gives n parts, else (with
    ``by_weight``) into n parts as long as the n paragraphs are relative to each other, each cut at the nearest line end, hard
    stop, comma or space. Whatever then still differs is joined: each side becomes one paragraph, unless one has no text.
    A paragraph with links or marks in its html is never cut. pos counts from 0 on. Null text or html is ''.

    Only documents whose sides differ are gathered, both sides in one grouping; the rest stays in windows.
    """
    side = Window.partitionBy("doc", "side")
    rows = rows.select("doc", "side", "pos", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("html", F.lit("")).alias("html"))
    counts = [F.count(F.when(F.col("side") == s, 1)).over(Window.partitionBy("doc")) for s in (ORIGINAL, TRANSLATION)]
    rows = rows.withColumn("n", F.when(F.col("side") == ORIGINAL, counts[0]).otherwise(counts[1])).withColumn("m", counts[0] + counts[1] - F.col("n"))
    rows = rows.withColumn("pos", F.row_number().over(side.orderBy("pos", "text", "html")) - 1)  # after the counts: rows dealt by doc serve both windows
    done = (F.col("m") == 0) | (F.col("n") == F.col("m"))
    kept = rows.where(done).select("doc", "side", "pos", "text", "html")

    gathered = [F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "text", "html")))) for s in (ORIGINAL, TRANSLATION)]
    pairs = rows.where(~done & F.col("doc").isNotNull()).groupBy("doc").agg(gathered[0].alias("a"), gathered[1].alias("b"))
    turns = [F.struct(F.lit(s).alias("side"), F.col(own).alias("own"), F.col(other).alias("other")) for s, own, other in ((ORIGINAL, "a", "b"), (TRANSLATION, "b", "a"))]
    both = pairs.select("doc", F.explode(F.array(*turns)).alias("x")).select("doc", "x.*").withColumn("n", F.size("own")).withColumn("m", F.size("other"))
    # the lone paragraph and what it may be cut into
    lone = (F.col("n") == 1) & (F.col("m") > 1)
    bare = _edged(F.regexp_replace(F.col("own")[0]["text"], r"\r\n?", "\n"))
    by_lines = F.filter(F.transform(F.split(bare, r"\n\s*\n+"), _edged), lambda p: p != "")
    body = _edged(F.col("own")[0]["text"])
    weight = lambda x: F.length(F.regexp_replace(x["text"], f"[{BLANK}]+", ""))
    weights = F.transform("other", weight)
    whole = lone & ~F.col("own")[0]["html"].rlike(MARKED) & (body != "")
    both = both.withColumn("body", F.when(whole, body)).withColumn("by_lines", F.when(whole, by_lines)).withColumn("weights", F.when(whole, weights))
    fits = F.size("by_lines") == F.col("m")
    if by_weight:
        heavy = F.aggregate("weights", F.lit(0), lambda a, b: a + b) > 0
        both = both.withColumn("at", _breaks(F.when(heavy & ~fits, F.col("body")), F.when(heavy & ~fits, F.col("weights"))))
        parts = F.transform(pieces(F.col("body"), F.col("at")), _edged)
        both = both.withColumn("by_weight", F.when(F.col("at").isNotNull(), parts))
        both = both.withColumn("parts", F.when(fits, F.col("by_lines")).when(~F.exists("by_weight", lambda p: p == ""), F.col("by_weight")))
    else:
        both = both.withColumn("parts", F.when(fits, F.col("by_lines")))
    # what couldn't be cut is joined, on both sides of a document alike
    cut = F.max(F.col("parts").isNotNull().cast("int")).over(Window.partitionBy("doc")) == 1
    filled = F.filter(F.transform("own", lambda x: F.struct(_edged(x["text"]).alias("text"), _edged(x["html"]).alias("html"))), lambda x: (x["text"] != "") & (x["html"] != ""))
    both = both.withColumn("cut", cut).withColumn("filled", filled)
    joinable = F.min(F.size("filled")).over(Window.partitionBy("doc")) > 0
    new = F.transform("parts", lambda p: F.struct(p.alias("text"), escaped(p).alias("html")))
    own = F.transform("own", lambda x: F.struct(x["text"].alias("text"), x["html"].alias("html")))
    joined = F.array(
        F.struct(F.array_join(F.transform("filled", lambda x: x["text"]), "\n\n").alias("text"), F.array_join(F.transform("filled", lambda x: x["html"]), "<br><br>").alias("html"))
    )
    out = F.when(F.col("parts").isNotNull(), new).when(F.col("cut"), own).when(F.col("joinable"), joined).otherwise(own)
    both = both.withColumn("joinable", joinable).select("doc", "side", F.posexplode(out).alias("pos", "x"))
    return kept.unionByName(both.select("doc", "side", "pos", "x.text", "x.html"))


def _group_language(texts: Column) -> Column:
    """The language most segments have, English on a tie; else that of any letters in them."""
    kinds = F.transform(texts, language)
    english, chinese = (F.size(F.filter(kinds, lambda k: k == name)) for name in ("english", "chinese"))  # noqa: B023
    every = _joined(texts)
    return F.when((english > 0) & (english >= chinese), "english").when(chinese > 0, "chinese").when(han_chars(every) >= 1, "chinese").when(latin_words(every) >= 1, "english").otherwise("other")


def _joined(texts: Column) -> Column:
    return F.array_join(F.filter(F.transform(texts, _edged), lambda t: t != ""), " ")


def pair_cards(rows: DataFrame) -> DataFrame:
    """(doc, unit, pos, role, text, html, text_only): a card's rows, those of two languages paired, with spacers between units.

    ``rows``: doc, line, seg, role (null, normal, original, translation or spacer), text, html; a row's segments in order. A lone
    plain segment that runs Han and Latin text together becomes two. Spacers, empty rows and bare addresses go. Two rows that
    follow each other pair up if neither has roles yet, their languages differ, both or neither start with a list mark,
    neither alone is a heading, their segments differ by one at most, and the shorter has a fifth of the longer's characters.
    Pairing is greedy and uses up both rows: of rows that could pair with both neighbours in a chain, every other bond holds.
    Where bonds form a chain is an island of a window, so nothing is folded. The English row comes first in a pair.
    """
    rows = rows.select("doc", "line", "seg", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("html", F.lit("")).alias("html"))
    segment = F.struct("seg", "role", "text", "html")
    groups = rows.groupBy("doc", "line").agg(F.array_sort(F.collect_list(segment)).alias("segs"))
    # a lone segment of two scripts
    only, text = F.col("segs")[0], _edged(F.col("segs")[0]["text"])
    plain = (F.size("segs") == 1) & F.coalesce(only["role"] == "normal", F.lit(True)) & (text != "") & (_edged(only["html"]) != "") & ~only["html"].rlike(r"<[^>]+>")
    groups = groups.withColumn("parts", script_parts(F.when(plain, text)))
    kinds = F.transform("parts", language)
    two = (F.size("parts") == 2) & ~F.array_contains(kinds, "other") & (kinds[0] != kinds[1])
    first = F.when(kinds[0] == "english", F.col("parts")[0]).otherwise(F.col("parts")[1])
    second = F.when(kinds[0] == "english", F.col("parts")[1]).otherwise(F.col("parts")[0])
    made = [F.struct(F.lit(i).alias("seg"), F.lit(role).alias("role"), t.alias("text"), escaped(t).alias("html")) for i, (role, t) in enumerate(((ORIGINAL, first), (TRANSLATION, second)))]
    groups = groups.withColumn("segs", F.when(two, F.array(*made)).otherwise(F.transform("segs", lambda s: F.struct(s["seg"].cast("int").alias("seg"), s["role"].alias("role"), s["text"].alias("text"), s["html"].alias("html")))))
    groups = groups.withColumn("segs", F.filter("segs", lambda s: (F.coalesce(s["role"], F.lit("normal")) != SPACER) & ~card_metadata(s["text"]))).where(F.size("segs") > 0)

    texts = F.transform("segs", lambda s: s["text"])
    groups = groups.withColumn("kind", _group_language(texts)).withColumn("all", _joined(texts))
    groups = groups.withColumn("mark", F.col("all").rlike(MARKER)).withColumn("heading", heading_like(F.col("all"), F.col("kind")) & ~hard_end(F.col("all")))
    groups = groups.withColumn("roled", F.exists("segs", lambda s: F.coalesce(s["role"].isin(ORIGINAL, TRANSLATION), F.lit(False))))
    groups = groups.withColumn("n", F.size("segs")).withColumn("chars", F.length(F.regexp_replace("all", f"[{BLANK}]+", "")))
    w = Window.partitionBy("doc").orderBy("line")
    names = ["kind", "mark", "heading", "roled", "n", "chars"]
    here = {c: F.col(c) for c in names}
    then = {c: F.col(f"then.{c}") for c in names}
    groups = groups.withColumn("then", F.lead(F.struct(*names)).over(w))
    bond = (
        F.col("then").isNotNull() & ~here["roled"] & ~then["roled"]
        & (here["kind"] != "other") & (then["kind"] != "other") & (here["kind"] != then["kind"])
        & (here["mark"] == then["mark"]) & (here["mark"] | (here["heading"] == then["heading"]))
        & (F.abs(here["n"] - then["n"]) <= 1)
        & (F.greatest(here["chars"], then["chars"]) > 0) & (F.least(here["chars"], then["chars"]) >= 0.2 * F.greatest(here["chars"], then["chars"]))
    )
    groups = groups.withColumn("bond", F.coalesce(bond, F.lit(False))).withColumn("i", F.row_number().over(w))
    # the row before the chain that a bond belongs to; every other bond of it holds
    before = F.coalesce(F.max(F.when(~F.col("bond"), F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    groups = groups.withColumn("opens", F.col("bond") & ((F.col("i") - before) % 2 == 1))
    groups = groups.withColumn("closes", F.coalesce(F.lag("opens").over(w), F.lit(False)))
    groups = groups.withColumn("unit", F.sum(F.when(~F.col("closes"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    paired = F.col("opens") | F.col("closes")
    groups = groups.withColumn("side", F.when(paired, F.when(F.col("kind") == "english", ORIGINAL).otherwise(TRANSLATION)))
    last = F.max("unit").over(Window.partitionBy("doc"))
    groups = groups.withColumn("spaced", ~F.col("opens") & (F.col("unit") < last))
    segs = groups.select("doc", "unit", "side", "line", F.posexplode("segs").alias("at", "s"))
    role = F.coalesce("side", "s.role", F.lit("normal"))
    segs = segs.select("doc", "unit", F.when(F.col("side") == TRANSLATION, 1).otherwise(0).alias("half"), "line", "at", role.alias("role"), "s.text", "s.html")
    spacers = groups.where("spaced").select("doc", "unit", F.lit(2).alias("half"), "line", F.lit(0).alias("at"), F.lit(SPACER).alias("role"), F.lit("").alias("text"), F.lit("").alias("html"))
    pos = F.row_number().over(Window.partitionBy("doc", "unit").orderBy("half", "line", "at")) - 1
    return segs.unionByName(spacers).select("doc", "unit", pos.alias("pos"), "role", "text", "html", (F.col("role") == TRANSLATION).alias("text_only"))
