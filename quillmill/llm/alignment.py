"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, by pointer jumping.

The tokens of both tokenizers tile the same bytes. Every token points to the farthest-right token that overlaps it; a token
whose end no other token passes points to itself. ``succ = succ[succ]``, over all tokens at once, doubles the reach of each
pointer until nothing changes; then each token holds the terminal token of its component, which names its group. Groups end
where a token of both ends.

A text is cut into units before the space or line end at a word, where both tokenizers surely start a token, so a unit's tokens, groups
and links are the same wherever it stands. What a worker learned of a unit is kept for the next texts, up to ``KNOWN`` units.

Corpus-wide counts of linked ids work by blocks of documents: a block lists each id pair once, so no pair has more rows than
there are blocks and pairs of very frequent words are no hot keys; what comes back to a block is a count for each of its pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm._util import forget, stored
from quillmill.llm.tokens import WHITE_SPACE, byte_alphabet

#: The stand-in for a space in pieces. Fixed value.
MARK = "▁"
#: Text of a block in UTF-8 bytes, so in characters of one byte; a longer text is a block of its own.
BLOCK_CHARS = 1 << 21
#: Units, characters and linked id pairs of them, that a worker remembers before it starts anew.
KNOWN, KNOWN_CHARS, KNOWN_PAIRS = 200_000, 1 << 24, 1 << 21
#: Characters of new units that are aligned at once; a longer unit is aligned alone.
LEARN_CHARS = 1 << 18
#: Longer units are encoded each apart.
SHORT_CHARS = 256
#: Characters of new units that are encoded in one call.
CALL_CHARS = 1 << 16
#: Groups with more links than this are reduced to different ids before pairs are listed.
WIDE = 4096
#: An id pair is one number: the first id times this, plus the second.
PAIR = 1 << 32

PAIR_SCHEMA = "a int, b int, docs long"
_BLOCK_SCHEMA = (
    "block long, a array<int>, b array<int>, docs array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, groups array<string>, until array<int>, pair array<int>, times array<int>"
)
_DOC_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The terminal token of the component of each token, first those of ``ends_a``, then those of ``ends_b``.

    Both arrays hold the byte offsets, ascending, at which tokens end; both tilings cover the same bytes.
    """
    na = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a - 1, side="right") + na  # the second tokenizer's token over a token's last byte
    over_b = np.searchsorted(ends_a, ends_b - 1, side="right")
    own = np.arange(na, na + len(ends_b))
    succ = np.concatenate([over_a, np.where(ends_a[over_b] > ends_b, over_b, own)]) if na else own
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


class Aligner:
    """Tokenizes units with both tokenizers and aligns them; keeps what it learned of each unit in flat arrays."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        letters = byte_alphabet()
        spell = lambda t: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        names = self.first.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.bytes_a[i] = spell(token)
        self.ranked = _ranked(byte_level, spell)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_b = []
        for i in range(self.second.vocab_size()):
            piece = self.second.id_to_piece(i)
            if re.search(f"[^{MARK}]{MARK}|\n", piece):
                raise ValueError("pieces go on after a word's or a line's end, so texts can't be cut there")
            self.bytes_b.append(bytes((int(piece[3:5], 16),)) if self.second.is_byte(i) else piece.replace(MARK, " ").encode())
        self.size_a = np.array([len(t) for t in self.bytes_a])
        self.size_b = np.array([len(t) for t in self.bytes_b])
        # an id as text, with what follows it inside a group and at the end of its part
        self.said_a = np.array([[f"{i},", f"{i}|"] for i in range(len(self.bytes_a))], dtype=object)
        self.said_b = np.array([[f"{i},", f"{i};"] for i in range(len(self.bytes_b))], dtype=object)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        self.chars = 0
        self.facts = np.zeros((0, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links of each unit
        self.same = np.zeros(0, dtype=bool)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.pairs = self.times = np.zeros(0, dtype=np.int64)  # of each unit in turn

    def encoded(self, units: list[str], short: bool) -> tuple[np.ndarray, np.ndarray, list[int], list[int], list[bool]]:
        """Both id lists of the units one after another; tokens of each unit; whether the tokens of both spell it.

        Encoded is `` a`` and the units: the word before lets any unit start as it does inside a text.
        """
        text = " a" + "".join(units)
        encode = self.ranked if short and self.ranked else lambda t: self.first.encode(t, add_special_tokens=False).ids
        a, b, data = encode(text), self.second.encode(text[1:]), text.encode()
        if not b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b)):
            if len(units) == 1:
                return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [0], [0], [False]
            each = [self.encoded([u], short) for u in units]
            return np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each]), *([x for e in each for x in e[k]] for k in (2, 3, 4))
        stops = np.cumsum([2, *(len(u.encode()) for u in units)])
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        to_a, to_b = (np.searchsorted(np.cumsum(size[ids]), stops, side="right") for ids, size in ((a, self.size_a), (b, self.size_b)))
        return a[to_a[0] :], b[to_b[0] :], np.diff(to_a).tolist(), np.diff(to_b).tolist(), [True] * len(units)

    def calls(self, units: list[str]) -> Iterator[tuple[list[str], bool]]:
        """The units in portions to encode at once; those that aren't plain words, each apart."""
        portion, size = [], 0
        for unit in units:
            if MARK in unit or len(unit) > SHORT_CHARS or unit[1:2] in _BLANK or unit[-1] in _BLANK:
                yield [unit], False
                continue
            portion.append(unit)
            size += len(unit)
            if size > CALL_CHARS:
                yield portion, True
                portion, size = [], 0
        if portion:
            yield portion, True

    def learn(self, units: list[str]) -> None:
        """Aligns units that aren't known yet, all tokens of all of them at once."""
        done = [(portion, *self.encoded(portion, short)) for portion, short in self.calls(units)]
        units = [u for portion, *_ in done for u in portion]
        a, b = (np.concatenate([d[k] for d in done]) for k in (1, 2))
        n_a, n_b, same = (np.array([x for d in done for x in d[k]]) for k in (3, 4, 5))
        last = terminals(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        ends = [np.append(np.diff(x) != 0, True)[: len(x)] for x in (last[: len(a)], last[len(a) :])]
        group_a, group_b = (np.cumsum(x) - x for x in ends)
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        of = np.repeat(np.arange(len(units)), n_a)[first_a]  # the unit of each group
        links = many_a * many_b
        per = lambda x: np.bincount(of, weights=x, minlength=len(units)).astype(np.int64)
        said = np.empty(len(a) + len(b), dtype=object)
        said[np.arange(len(a)) + first_b[group_a]] = self.said_a[a, ends[0].astype(int)]
        said[np.arange(len(b)) + first_a[group_b] + many_a[group_b]] = self.said_b[b, ends[1].astype(int)]
        said, until = said.tolist(), np.cumsum(n_a + n_b).tolist()
        # the pairs of a group: each of its first ids with all of its second ids; wide groups by different ids
        wide = links > WIDE
        going = np.flatnonzero(~wide[group_a])
        n = many_b[group_a[going]]
        partner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[group_a[going]], n)
        found = [(np.repeat(of[group_a[going]], n), np.repeat(a[going], n) * PAIR + b[partner], np.ones(len(partner), dtype=np.int64))]
        for g in np.flatnonzero(wide).tolist():
            ids, times = zip(*(np.unique(x[s : s + k], return_counts=True) for x, s, k in ((a, first_a[g], many_a[g]), (b, first_b[g], many_b[g]))), strict=True)
            codes = (ids[0][:, None] * PAIR + ids[1][None, :]).ravel()
            found.append((np.full(len(codes), of[g]), codes, (times[0][:, None] * times[1][None, :]).ravel()))
        unit, codes, times = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(found) > 1:
            order = np.argsort(unit, kind="stable")
            unit, codes, times = unit[order], codes[order], times[order]
        for u, start, end in zip(units, [0, *until[:-1]], until, strict=True):
            self.places[u] = len(self.groups)
            self.groups.append("".join(said[start:end])[:-1])
            self.chars += len(u)
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, per(np.ones(len(of))), per(links)], axis=1)])
        self.same = np.concatenate([self.same, same])
        self.sizes = np.concatenate([self.sizes, np.bincount(unit, minlength=len(units))])
        self.pairs, self.times = np.concatenate([self.pairs, codes]), np.concatenate([self.times, times])

    def find(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The places of each text's units, which are all known afterwards."""
        if len(self.groups) > KNOWN or self.chars > KNOWN_CHARS or len(self.pairs) > KNOWN_PAIRS:
            self.forget()
        new, size = [], 0
        for unit in dict.fromkeys(u for units in texts for u in units):
            if unit in self.places:
                continue
            if new and size + len(unit) > LEARN_CHARS:
                self.learn(new)
                new, size = [], 0
            new.append(unit)
            size += len(unit)
        if new:
            self.learn(new)
        return [np.fromiter(map(self.places.__getitem__, units), dtype=np.int64, count=len(units)) for units in texts]


#: Also the end of a text: a unit of a lone space.
_BLANK = {"", " ", *WHITE_SPACE}
#: What units start with, between something else than a space and something not blank.
_CUT = re.compile(f"(?<=[^ ])(?= [^{''.join(WHITE_SPACE)} ])|(?<=[^{''.join(WHITE_SPACE)} ])(?=\n[^{''.join(WHITE_SPACE)} ])")


def _ranked(path: str, spell: Callable[[str], bytes]) -> Callable[[str], list[int]] | None:
    """The same encoding by ranks, which is faster on words, if the file's ids are in the order of its merges and it splits as usual."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {spell(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pre = spec["pre_tokenizer"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [ranks[spell("".join(m))] for m in merges]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or made != sorted(set(made)) or len(ranks) != len(made) + 256:
        return None
    split = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranked", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


def units_of(text: str) -> list[str]:
    """`` `` and the text, cut before the spaces and line ends that start a word: both tokenizers start a token there."""
    return _CUT.split(" " + text)


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (n[0] of them), starts[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)


def _block(number: int, ids: list, texts: list[str | None], both: Aligner, whole: bool) -> dict:
    found = both.find([units_of(t) if t else [] for t in texts])
    found = [of if both.same[of].all() else of[:0] for of in found]
    groups = [";".join(map(both.groups.__getitem__, of.tolist())) for of in found]
    if not whole:
        groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    n = np.array([len(of) for of in found])
    doc, unit = np.repeat(np.arange(len(n)), n), np.concatenate(found)
    sums = np.zeros((len(n), 4), dtype=np.int64)
    np.add.at(sums, doc, both.facts[unit])
    # different units of each document, then their pairs
    used, unit = np.unique(unit, return_inverse=True)
    sizes = both.sizes[used]
    spots = _spread((np.cumsum(both.sizes) - both.sizes)[used], sizes)
    codes, local = np.unique(both.pairs[spots], return_inverse=True)
    starts, each = np.cumsum(sizes) - sizes, both.times[spots]
    key, many = np.unique(doc * max(1, len(used)) + unit, return_counts=True)
    doc, unit = np.divmod(key, max(1, len(used)))
    at = _spread(starts[unit], sizes[unit])
    key, where = np.unique(np.repeat(doc, sizes[unit]) * max(1, len(codes)) + local[at], return_inverse=True)
    times = np.bincount(where, weights=each[at] * np.repeat(many, sizes[unit]), minlength=len(key)).astype(np.int64)
    doc, pair = np.divmod(key, max(1, len(codes)))
    docs = np.bincount(pair, minlength=len(codes))
    order = np.argsort(-docs, kind="stable")  # frequent pairs have small numbers, which are stored in few bits
    rank = np.empty(len(codes), dtype=np.int64)
    rank[order] = np.arange(len(codes))
    values = {"block": number, "a": codes[order] // PAIR, "b": codes[order] % PAIR, "docs": docs[order], "doc_id": ids, "groups": groups}
    values |= {name: sums[:, i] for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    return values | {"until": np.cumsum(np.bincount(doc, minlength=len(n))), "pair": rank[pair], "times": times}


_LONGS = pa.list_(pa.int64())
_TYPES = {"block": pa.int64(), "a": (_INTS := pa.list_(pa.int32())), "b": _INTS, "docs": _INTS, "doc_id": _LONGS, "n_a": _LONGS, "n_b": _LONGS, "n_groups": _LONGS}
_TYPES |= {"n_links": _LONGS, "groups": pa.list_(pa.string()), "until": _INTS, "pair": _INTS, "times": _INTS}  # in the order of the schema


def _blocks(docs: DataFrame, byte_level: str, pieces: str, whole: bool) -> DataFrame:
    """A row for each block of documents: its id pairs with the documents that hold each, and its documents with their links."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32

        def row(ids: list, texts: list[str]) -> pa.RecordBatch:
            made = _block(number, ids, texts, both, whole)
            return pa.RecordBatch.from_arrays([pa.array([made[c]], type=t) for c, t in _TYPES.items()], list(_TYPES))

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text, n in zip(batch.column(0).to_pylist(), batch.column(1), pc.binary_length(batch.column(1)).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += n + 1
                if size > BLOCK_CHARS:
                    yield row(ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield row(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(aligned, _BLOCK_SCHEMA)


def _pairs(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "docs"))).select("block", "pos", "col.a", "col.b", "col.docs")


def pair_counts(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """a, b, docs: how many documents link token ``a`` of the byte-level tokenizer with token ``b`` of the other."""
    return _pairs(_blocks(docs, byte_level, pieces, whole=False)).groupBy("a", "b").agg(F.sum("docs").alias("docs"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block, from the block's row and the corpus-wide counts of its pairs."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            one = {name: columns[name][r].values for name in [*names, "groups", "until", "pair", "times"]}
            until, pair, times = (one[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("until", "pair", "times"))
            found = columns["found"][r].values
            count = best = np.zeros(0, dtype=np.int64)
            if found is not None and len(found):  # in no order
                count, best = np.zeros((2, len(found)), dtype=np.int64)
                pos = found.field("pos").to_numpy(zero_copy_only=False)
                count[pos], best[pos] = (found.field(c).to_numpy(zero_copy_only=False) for c in ("count", "best"))
            run = lambda x: np.concatenate([[0], np.cumsum(x)])
            first = np.concatenate([[0], until[:-1]]).astype(np.int64)
            sums = [run(times * x[pair])[until] - run(times * x[pair])[first] for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*(one[c] for c in names), *map(pa.array, sums), one["groups"]], [*names, "n_best", "count_sum", "groups"])


def align(docs: DataFrame, byte_level: str, pieces: str, whole: bool = False) -> DataFrame:
    """How the tokens of two tokenizers align in each document's ``text``, and how usual its links are.

    ``byte_level`` and ``pieces`` are paths of a byte-level BPE (.json) and of a piece BPE with byte fallback (.model) that all
    executors can open. Encoded is a space and the text, without special tokens, whose strings inside a text are plain text.

    Returns doc_id, n_a, n_b (tokens), n_groups (stretches between offsets where tokens of both end), n_links (pairs of a
    token of each within a group), n_best (links whose id pair is in as many documents as any pair of the same first id),
    count_sum (over links, the documents that hold its id pair linked) and groups: ``a1,a2|b1;a3|b2,b3`` if ``whole``, else
    the lowercase hex SHA-256 of that. Texts null, empty or not spelled by the tokens of both have zeros and ''. Rows that
    repeat count as documents of their own, a null doc_id stays null, other columns are ignored, an empty table gives no rows.
    """
    table, path = stored(_blocks(docs, byte_level, pieces, whole), long_rows=True)
    pairs = _pairs(table)
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # an id has no more partners than the other vocabulary has tokens
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("int"))
    found = pairs.select("block", "pos", "a", "b").join(counts, ["a", "b"])
    found = found.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("pos", "count", "best")).alias("found"))
    rows = table.drop("a", "b", "docs").join(found, F.col("block") == F.col("of"), "left").drop("of", "block")
    out, _ = stored(rows.mapInArrow(_totals, _DOC_SCHEMA))
    forget(docs.sparkSession, path)
    return out
