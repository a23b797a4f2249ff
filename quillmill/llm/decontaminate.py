"""Benchmark decontamination by winnowing.

Words are hashed and so are all runs of GRAM words. Of every WINDOW consecutive runs the one with the least hash is kept
as a fingerprint. A shared span of ``words`` = GRAM + WINDOW - 1 words holds one full window on either side, with the
same least run, so a document that holds a benchmark window has a fingerprint in common with it. Fingerprints that meet
are extended to the windows around them; those are joined to the benchmark's windows by hash and compared word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm._util import apart, cut, forget, stored, without

GRAM = 5
#: The bytes of words: digits, small letters and all of UTF-8 beyond ASCII; A-Z are lower-cased first.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: What stands between words. Fixed values.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Names of the benchmark that all tasks are told at most; beyond, documents and benchmark are joined by all names.
NAMES_AT_ONCE = 1 << 20
#: Rows that are broadcast at most (of windows, and of what was found in a text).
ROWS_AT_ONCE = 100_000
#: Bytes of text that are hashed at a time.
BYTES_AT_ONCE = 1 << 20
LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BETWEEN = np.array([b for b in range(128) if re.match(BETWEEN.encode(), bytes([b]))], dtype=np.uint8)
_IS_WORD = np.array([bool(WORD.fullmatch(bytes([b]))) for b in range(256)])
#: As words stand in texts, A-Z included.
_IS_ANY = _IS_WORD[_LOWER]
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: bytes, places, hashes and the text of each word."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    counts: np.ndarray

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the n words from each word on, and whether they are in one text."""
        have = max(0, len(self.hashes) - n + 1)
        out = np.zeros(have, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                out = _mixed(out * _BASE + self.hashes[j : j + have] + np.uint64(j + 1))
        return out, self.text[:have] == self.text[n - 1 : n - 1 + have]

    def join(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.begin[i] : self.end[i]].tobytes() for i in range(at, at + n))


def words_of(texts: list[bytes]) -> Words:
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)]
    word = _IS_WORD[data]
    edges = np.diff(word.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, begin, side="right")
    sizes = end - begin
    hashes = np.zeros(len(begin), dtype=np.uint64)
    if len(begin):
        at = np.flatnonzero(word)
        place = at - np.repeat(begin, sizes)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max()), _BASE), dtype=np.uint64)
            hashes = _mixed(np.add.reduceat(_VALUES[data[at]] * powers[place], np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    return Words(data, begin, end, hashes, text, np.bincount(text, minlength=len(texts)))


def winnow(grams: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """The places of the runs that are least in some window of ``window`` runs; windows at a text's end are cut short."""
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    padded = np.concatenate([np.where(valid, grams, LARGEST), np.full(window, LARGEST)])
    least, place = padded[: len(grams)].copy(), np.arange(len(grams))
    open_ = valid.copy()
    for j in range(1, window):
        open_ &= np.concatenate([valid[j:], np.zeros(j, dtype=bool)])[: len(grams)]  # a window ends with its text
        less = open_ & (padded[j : j + len(grams)] < least)
        least[less] = padded[j : j + len(grams)][less]
        place[less] = np.flatnonzero(less) + j
    return np.unique(place[valid])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


def count_words(texts: pa.Array) -> pa.Array:
    """How many words each text has: places where one begins, after a byte of none or with its text. None for null."""
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends or bytes(8), dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", dtype=np.uint8)
    counts = np.zeros(len(texts), dtype=np.int64)
    for at in range(int(ends[0]), int(ends[-1]), BYTES_AT_ONCE):
        stop = min(at + BYTES_AT_ONCE, int(ends[-1]))
        word = _IS_ANY[data[at:stop]]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        begin[0] &= at == ends[0] or not _IS_ANY[data[at - 1]]
        firsts = ends[np.searchsorted(ends, at) : np.searchsorted(ends, stop)] - at
        begin[firsts] = word[firsts]
        counts += np.diff(np.searchsorted(np.flatnonzero(begin) + at, ends))
    counts[texts.is_null().to_numpy(zero_copy_only=False)] = 0
    return pa.array(counts)


def pieces(data: bytes, words: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a long text of about BYTES_AT_ONCE, with the number of their first word; ``words`` - 1 words overlap."""
    at, first, size = 0, 0, BYTES_AT_ONCE
    between = re.compile(BETWEEN.encode())
    while at + size < len(data) and (stop := between.search(data, at + size)):
        part = data[at : stop.start()]
        word = ~np.isin(np.frombuffer(part, dtype=np.uint8), _BETWEEN)
        begins = np.flatnonzero(np.diff(word.astype(np.int8), prepend=np.int8(0)) == 1)
        back = len(begins) - words + 1
        if back <= 0:  # a few endless words
            size *= 2
            continue
        yield first, part
        at, first, size = at + int(begins[back]) if back < len(begins) else stop.start(), first + back, BYTES_AT_ONCE
    yield first, data[at:]


def portions(texts: list[str | None], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    """The words of about BYTES_AT_ONCE of text at a time: the number of each part's text, of its first word, and its words."""
    of, firsts, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for first, data in pieces((text or "").encode(), words):
            if parts and size + len(data) > BYTES_AT_ONCE:
                yield np.array(of), np.array(firsts), words_of(parts)
                of, firsts, parts, size = [], [], [], 0
            of.append(i)
            firsts.append(first)
            parts.append(data)
            size += len(data)
    if parts:
        yield np.array(of), np.array(firsts), words_of(parts)


def fingerprints(found: Words, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The names and first words of the runs that winnowing keeps, so that every window of ``words`` words holds one."""
    grams, valid = found.runs(min(GRAM, words))
    kept = winnow(grams, valid, max(1, words - GRAM + 1))
    return grams[kept], kept


def around(found: Words, kept: np.ndarray, n: int, words: int) -> np.ndarray:
    """The windows of n words (their first) that hold one of the runs at ``kept``; for shorter windows, that begin there."""
    reach = max(0, n - GRAM) if n == words else 0
    starts = np.unique((kept[:, None] - np.arange(reach + 1)).ravel())
    return starts[(starts >= 0) & (starts + n <= len(found.hashes))]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _items(benchmark: DataFrame, words: int) -> DataFrame:
    """(n, name, words, item): each window of the items, of n words; and with n = 0 the names of winnowing's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut_up = [len(list(pieces(t.encode(), words))) > 1 for t in texts]
            for of, _, found in portions(texts, words):
                rows: list[tuple] = []
                for i, count in enumerate(found.counts.tolist()):
                    n = min(words, count)
                    if n and not (cut_up[of[i]] and n < words):
                        first = int(found.counts[:i].sum())
                        names = found.runs(n)[0]
                        rows += [(n, names[at], found.join(at, n), ids[of[i]]) for at in range(first, first + count - n + 1)]
                grams, kept = fingerprints(found, words)
                rows += [(0, name, b"", "") for name in grams]
                if rows:
                    n, name, text, item = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), _signed(np.array(name, dtype=np.uint64)), pa.array(text, pa.binary()), pa.array(item, pa.string())], ["n", "name", "words", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("item is not null and text is not null")
    return rows.mapInArrow(run, "n int, name long, words binary, item string").dropDuplicates(["n", "name", "words", "item"])


def _hits(keyed: DataFrame, items: DataFrame, words: int) -> DataFrame:
    """(k1, k2, n, start, name, words): windows of the texts of ``keyed`` (k1, k2, text) whose names some item has."""
    spark = keyed.sparkSession
    names = items.select("n", "name").distinct()
    sizes = [r["n"] for r in items.select("n").distinct().collect()]  # at most words + 1 numbers
    shape = "k1 long, k2 string, n int, start int, name long, words binary"

    def windows(batch: pa.RecordBatch, keep: object) -> Iterator[pa.RecordBatch]:
        """keep(found, of, firsts, n): the first words of the windows of n words that go on."""
        k1, k2 = batch.column(0), batch.column(1)
        for of, firsts, found in portions(batch.column(2).to_pylist(), words):
            begins = np.cumsum(found.counts) - found.counts
            for n in sizes:
                if not n:
                    continue
                starts = keep(found, of, firsts, begins, n)
                runs, valid = found.runs(n)
                starts = starts[valid[starts]]
                if len(starts):
                    part = found.text[starts]
                    row = pa.array(of[part])
                    place = pa.array((starts - begins[part] + firsts[part]).astype(np.int32))
                    text = pa.array([found.join(int(at), n) for at in starts], pa.binary())
                    yield pa.RecordBatch.from_arrays([k1.take(row), k2.take(row), pa.array(np.full(len(starts), n, dtype=np.int32)), place, _signed(runs[starts]), text], ["k1", "k2", "n", "start", "name", "words"])

    if names.count() <= NAMES_AT_ONCE:
        told = names.toPandas()
        known = {n: np.sort(told["name"][told["n"] == n].to_numpy(dtype=np.int64).view(np.uint64)) for n in sizes}
        shared = spark.sparkContext.broadcast(known)

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value

            def keep(found: Words, of: np.ndarray, firsts: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
                if n == words:
                    grams, kept = fingerprints(found, words)
                    starts = around(found, kept[_among(grams, known[0])], n, words)
                else:
                    starts = np.arange(max(0, len(found.hashes) - n + 1))
                return starts[_among(found.runs(n)[0][starts], known[n])]

            for batch in batches:
                yield from windows(batch, keep)

        return keyed.mapInArrow(looked_up, shape)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for of, firsts, found in portions(batch.column(2).to_pylist(), words):
                begins = np.cumsum(found.counts) - found.counts
                for n in sizes:
                    if n == words:
                        continue
                    names, at = fingerprints(found, words) if not n else found.runs(n)
                    names, at = (names, at) if not n else (names[at], np.flatnonzero(at))
                    row = pa.array(of[found.text[at]])
                    place = (at - begins[found.text[at]] + firsts[found.text[at]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([k1.take(row), k2.take(row), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(place), _signed(names)], ["k1", "k2", "n", "at", "name"])

    met = keyed.mapInArrow(spots, "k1 long, k2 string, n int, at int, name long").join(names, ["n", "name"], "left_semi")
    met = met.groupBy(F.col("k1").alias("m1"), F.col("k2").alias("m2")).agg(F.collect_set(F.struct("n", "at")).alias("met"))

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [np.array([(m["n"], m["at"]) for m in row]) for row in batch.column(3).to_pylist()]

            def keep(found: Words, of: np.ndarray, firsts: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
                places = [np.zeros(0, dtype=np.int64)]
                for i, row in enumerate(of):
                    spot = met[row][met[row][:, 0] == (0 if n == words else n), 1] - firsts[i]
                    places.append(begins[i] + spot[(spot >= 0) & (spot < found.counts[i])])
                return around(found, np.concatenate(places), n, words)

            yield from windows(batch, keep)

    joined = keyed.join(met, F.expr("k1 = m1 and k2 = m2")).select("k1", "k2", "text", "met")
    return joined.mapInArrow(extended, shape)


def _digest(spans: pd.Series, items: pd.Series) -> pd.DataFrame:
    rows = []
    for flat, ids in zip(spans, items, strict=True):
        pairs = [(s["start"], s["n"]) for s in flat]
        hit = np.zeros(max(at + n for at, n in pairs) + 1, dtype=np.int64)
        for at, n in pairs:
            hit[at] += 1
            hit[at + n] -= 1
        rows.append((int((np.cumsum(hit) > 0).sum()), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return pd.DataFrame(rows, columns=["n_hit", "n_items", "items_sha256"])


def _key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.md5(text.cast("binary"))


def _found(texts: DataFrame, benchmark: DataFrame, words: int) -> tuple[DataFrame, bool]:
    """(k1, k2, n_hit, n_items, items_sha256) of every text of ``texts`` (text) with hits, and whether that is few rows."""
    items, path = stored(_items(benchmark, words))
    k1, k2 = _key(F.col("text"))
    hits = _hits(texts.where("text is not null").select(k1.alias("k1"), k2.alias("k2"), "text"), items, words)
    windows = items.where("n > 0").select(F.col("n").alias("i_n"), F.col("name").alias("i_name"), F.col("words").alias("i_words"), "item")
    small = F.broadcast if windows.count() <= ROWS_AT_ONCE else lambda df: df
    real = hits.join(small(windows), F.expr("n = i_n and name = i_name and words = i_words"))
    each = real.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("item").alias("items"))
    digest = F.pandas_udf(_digest, "n_hit long, n_items long, items_sha256 string")
    found = cut(each.select("k1", "k2", digest("spans", "items").alias("d")).select("k1", "k2", "d.*"))
    forget(texts.sparkSession, path)
    return found, found.count() <= ROWS_AT_ONCE


def mark(docs: DataFrame, benchmark: DataFrame, words: int = 10) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to ``docs``; columns of these names are replaced.

    A window is ``words`` consecutive words of an item, or all words of a shorter item. n_hit counts a document's words
    inside any occurrence of a window, n_items the items that occur, items_sha256 is over their ids, sorted as strings
    and joined by commas.

    The benchmark's fingerprints and windows are a table. If they have at most NAMES_AT_ONCE names, the names (8 bytes
    each) are told to all tasks, which hand on only windows that an item may have; beyond that, all fingerprints of the
    documents are joined to those of the benchmark, and the texts that meet are read again. What is handed on is joined to
    the benchmark's windows. Equal texts are looked at together. No text is shuffled, unless more than ROWS_AT_ONCE texts
    are hit or the benchmark has more names than that.

    Null text has no words; a document without words is clean. Items without words, and items without an id, take no
    part; rows that repeat an item_id count as one item with the windows of all. Repeated documents are marked each. An
    empty benchmark leaves all documents clean, and an empty table gives no rows. Texts of any length are cut into parts.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows, of, back = apart(docs)
    found, few = _found(rows.select(of("text").alias("text")), benchmark, words)
    k1, k2 = _key(F.coalesce(of("text"), F.lit("")))
    n_words = F.arrow_udf(count_words, "long")
    rows = rows.withColumns({"own_1": k1, "own_2": k2, "n_words": n_words(of("text"))})
    out = rows.join(F.broadcast(found) if few else found, F.expr("own_1 = k1 and own_2 = k2"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    clean = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(*without(back, docs, added), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", clean).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, words: int = 10) -> DataFrame:
    """The rows of ``docs`` that ``mark`` finds clean, with all their columns as they are."""
    rows, of, back = apart(docs)
    found, few = _found(rows.select(of("text").alias("text")), benchmark, words)
    k1, k2 = _key(F.coalesce(of("text"), F.lit("")))
    found = found.select("k1", "k2")
    out = rows.withColumns({"own_1": k1, "own_2": k2}).join(F.broadcast(found) if few else found, F.expr("own_1 = k1 and own_2 = k2"), "left_anti")
    return out.select(*back)
