"""Periodic run detection on Re-Pair grammars of word ids.

A portion of documents is one sequence of word ids, in which no pair reaches over a document's end. Rounds of Re-Pair replace
pairs that occur twice or more: in each round a place is replaced if its pair is more frequent than the pairs that overlap it,
so the most frequent pair goes everywhere and others go with it where they don't touch. What a round replaces is written down
with its places, which are the derivation positions of its nonterminals. When rounds replace hardly anything more, the rest of
a document is joined two by two; those nodes occur once.

A run of the text lies across the boundary of the lowest node that holds it. So for each nonterminal the runs across its
boundary are looked for once, in its expansion alone, and then translated to all its places; of the intervals of one period
those inside others are parts of the same run and are merged into it.

Across a boundary at m, a run of period q and length 4 q or more has 2 q words on one side. All q up to a quarter of the
expansion are tried, each by a few comparisons; what is left is extended to both sides word by word, smallest periods first,
and multiples of a period inside its own run are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm._util import apart, without

#: Words of a portion; a longer document is a portion of its own.
PORTION = 1 << 19
#: Rounds end when one replaces less than this part of the symbols.
HARDLY = 256
#: Boundaries and periods tried at once.
TRIED = 1 << 21
#: Words that are compared for every period before runs are extended.
CHECKED = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _same_for(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For each pair of places, how many words are equal from there on, going by ``step`` (1 or -1), at most ``most``."""
    out = np.zeros(len(i), dtype=np.int64)
    going, width = np.flatnonzero(most > 0), 16
    while len(going):
        width = min(width * 2, max(16, (1 << 21) // len(going)))
        at = out[going][:, None] + np.arange(width)
        inside = at < most[going][:, None]
        at = np.where(inside, at, 0) * step
        equal = (w[i[going][:, None] + at] == w[j[going][:, None] + at]) & inside
        alike = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        out[going] += alike
        going = going[alike == width]
    return out


def crossing(w: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, power: int, least: int) -> tuple[np.ndarray, ...]:
    """node, start, end, period of the runs within w[lo:hi] that hold both mid - 1 and mid, for each node."""
    most = (hi - lo) // power
    most[hi - lo < least] = 0
    found: list[tuple[np.ndarray, ...]] = []
    before = np.cumsum(most) - most
    portions = np.flatnonzero(np.diff(before // TRIED, prepend=-1))
    for start, stop in zip(portions, [*portions[1:], len(lo)], strict=True):
        n = most[start:stop]
        if n.sum():
            node = np.repeat(np.arange(start, stop), n)
            q = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n) + 1
            found.append(_of_candidates(w, lo, mid, hi, *_candidates(w, lo, mid, hi, node, q), power, least))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _candidates(w: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, node: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes, periods and first places of q + 1 words that equal those q further on, around the boundary; by node and period."""
    kept = []
    for right in (True, False):
        m = mid[node]
        at = m - 1 if right else m - 2 * q
        going = np.flatnonzero((m + 2 * q <= hi[node]) if right else (at >= lo[node]))
        for t in (0, None, 1, 2, *range(3, CHECKED)):
            if not len(going):
                break
            shift = q[going] if t is None else np.minimum(t, q[going])
            place = at[going] + shift
            going = going[w[place] == w[place + q[going]]]
        kept.append((node[going], q[going], at[going]))
    node, q, at = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((q, node))
    return node[order], q[order], at[order]


def _of_candidates(w: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, node: np.ndarray, q: np.ndarray, at: np.ndarray, power: int, least: int) -> tuple[np.ndarray, ...]:
    found = []
    while len(node):
        first = np.flatnonzero(np.diff(node, prepend=-1))  # the smallest period left of each node
        of, p, i = node[first], q[first], at[first]
        on = _same_for(w, i, i + p, hi[of] - i - p, 1)
        back = _same_for(w, i - 1, i - 1 + p, i - lo[of], -1)
        start, end = i - back, i + on + p
        good = (on > p) & (end - start >= np.maximum(least, power * p))
        found.append((of[good], start[good], end[good], p[good]))
        # whatever else of the node is a multiple within the same stretch has the smaller period
        here = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
        done = (q % p[here] == 0) & (at >= start[here]) & (at + 2 * q + 1 <= end[here]) & (on > p)[here]
        done[first] = True
        node, q, at = node[~done], q[~done], at[~done]
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _chosen(seq: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The places whose pair is replaced in a round of Re-Pair: disjoint, each pair twice at least."""
    code = (seq[:-1] << 32) | seq[1:]
    bits = max(8, min(24, int(len(code)).bit_length() + 2))
    key = ((code.astype(np.uint64) * _ODD) >> np.uint64(64 - bits)).astype(np.int64)
    inside = ~opens[1:]
    often = np.bincount(key[inside], minlength=1 << bits)[key]
    rank = np.where(inside & (often > 1), (often << bits) | key, 0)
    less = np.append(rank[:-1] >= rank[1:], True) & np.append(True, rank[1:] >= rank[:-1])
    # of places of equal rank one after another, every other
    at = np.arange(len(rank))
    begin = np.maximum.accumulate(np.where(np.append(True, rank[1:] != rank[:-1]), at, 0))
    places = np.flatnonzero((rank > 0) & less & ((at - begin) % 2 == 0))
    _, pair, times = np.unique(code[places], return_inverse=True, return_counts=True)
    return places[times[pair] > 1]


def runs_of(w: np.ndarray, bounds: np.ndarray, power: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and smallest period of the maximal runs of the documents w[bounds[i]:bounds[i + 1]], by start, end, period.

    A run has ``least`` words and ``power`` periods or more; ``power`` is 4 at least.
    """
    if power < 4:
        raise ValueError("runs of fewer than four periods aren't looked for")
    found: list[tuple[np.ndarray, ...]] = []

    def take(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, rule: np.ndarray | None = None) -> None:
        """Looks for runs at one place of each rule and notes them at all places."""
        if rule is None:
            _, start, end, period = crossing(w, lo, mid, hi, power, least)
            found.append((start, end, period))
            return
        _, one = np.unique(rule, return_index=True)
        node, start, end, period = crossing(w, lo[one], mid[one], hi[one], power, least)
        if len(node):
            order = np.argsort(rule, kind="stable")
            begin = np.searchsorted(rule[order], node)
            n = np.searchsorted(rule[order], node, side="right") - begin
            places = lo[order][np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)]
            moved = places - np.repeat(lo[one][node], n)
            found.append((np.repeat(start, n) + moved, np.repeat(end, n) + moved, np.repeat(period, n)))

    at = np.arange(len(w))
    opens = np.zeros(len(w), dtype=bool)
    opens[bounds[:-1][np.diff(bounds) > 0]] = True
    seq, until, fresh = w.astype(np.int64), at + 1, int(w.max(initial=0)) + 1
    while len(seq) > 1:
        places = _chosen(seq, opens)
        if not len(places):
            break
        _, rule = np.unique((seq[places] << 32) | seq[places + 1], return_inverse=True)
        take(at[places], at[places + 1], until[places + 1], rule)
        seq[places], until[places] = fresh + rule, until[places + 1]
        fresh += int(rule.max()) + 1
        left = np.ones(len(seq), dtype=bool)
        left[places + 1] = False
        few = len(places) * HARDLY < len(seq)
        seq, at, until, opens = seq[left], at[left], until[left], opens[left]
        if few:
            break
    while not opens.all():
        index = np.arange(len(at))
        within = index - np.maximum.accumulate(np.where(opens, index, 0))
        places = np.flatnonzero((within[:-1] % 2 == 0) & ~opens[1:])
        take(at[places], at[places + 1], until[places + 1])
        until[places] = until[places + 1]
        left = np.ones(len(at), dtype=bool)
        left[places + 1] = False
        at, until, opens = at[left], until[left], opens[left]
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        reach = np.maximum.accumulate(end + period * (len(w) + 1))  # of the same period so far
        own = np.append(True, (end + period * (len(w) + 1))[1:] > reach[:-1])
        start, end, period = start[own], end[own], period[own]
    order = np.lexsort((period, end, start))
    return start[order], end[order], period[order]


_OUT = "runs array<struct<start:long,length:long,period:long>>, n_words long, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _portion(texts: list[bytes], power: int, least: int) -> list[pa.Array]:
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words = [t.split() for t in texts]  # bytes are split at space and \t to \r alone
    bounds = np.cumsum([0, *map(len, words)])
    w = np.fromiter((numbers[x] for of in words for x in of), dtype=np.int64, count=int(bounds[-1]))
    start, end, period = runs_of(w, bounds, power, least)
    doc = np.searchsorted(bounds, start, side="right") - 1
    gone = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone)[:-1] == 0
    offsets = np.searchsorted(doc, np.arange(len(texts) + 1))
    rows = pa.StructArray.from_arrays([pa.array(x, type=pa.int64()) for x in (start - bounds[doc], end - start, period)], fields=list(_RUN))
    collapsed = []
    for i, of in enumerate(words):
        if offsets[i] < offsets[i + 1]:
            of = [of[k] for k in np.flatnonzero(kept[bounds[i] : bounds[i + 1]]).tolist()]
        collapsed.append(b" ".join(of).decode())
    return [pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), rows), pa.array(np.diff(bounds), type=pa.int64()), pa.array(collapsed, type=pa.string())]


def collapse_runs(docs: DataFrame, power: int = 4, least: int = 6) -> DataFrame:
    """All columns of ``docs`` and, for the words ``[^\\x20\\x09-\\x0D]+`` of each ``text``: ``runs``, ``n_words``, ``collapsed``.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``least`` words and
    ``power`` * q words long, that no neighbouring word extends. ``runs`` lists start (word number from 0), length and period,
    by start, length and period; ``collapsed`` is what is left, joined by one space, when each run keeps its first q words.
    Null text has no words, no runs and '' left. Columns named as those that are added are replaced; rows that repeat are
    rows of their own; an empty table gives no rows. Whole texts are searched; no run reaches from one text into another.
    """
    rows, of, back = apart(docs)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, size = [], 0, 0
            column = batch.column(batch.num_columns - 1).cast(pa.binary())
            for i, text in enumerate(column):
                texts.append(text.as_py() or b"")
                size += len(texts[-1]) // 6 + 1
                if size >= PORTION or i + 1 == len(column):
                    own = batch.slice(first, len(texts))
                    made = _portion(texts, power, least)
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], *made], [*own.schema.names[:-1], "runs", "n_words", "collapsed"])
                    texts, first, size = [], i + 1, 0

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    out = rows.select(*rows.columns, of("text").cast("string").alias("searched")).mapInArrow(searched, f"{schema}, {_OUT}")
    return out.select(*without(back, docs, ["runs", "n_words", "collapsed"]), "runs", "n_words", "collapsed")


def with_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with periodic tails in about a tenth of its texts, as ``doc_id`` decides; a text with a null id stays as it is.

    With h = crc32(decimal doc_id) and g = h div 10, if h % 10 = 0 and a text has n > 0 words, each word i >= a becomes the
    word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8); the words are then joined by one space.
    """
    rows, of, back = apart(docs)
    h = F.crc32(of("doc_id").cast("string").cast("binary"))
    rows = rows.select("*", (h % 10 == 0).alias("tailed"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("tailed"), F.regexp_extract_all(of("text"), F.lit(r"[^ \t-\r]+"), F.lit(0))))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("int") + 1)
    tail = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    text = F.when(F.col("tailed") & (n > 0), F.array_join(tail, " ")).otherwise(of("text")).alias("text")
    return rows.select(*without(back, docs, ["text"]), text)
