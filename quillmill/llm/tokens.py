"""Token counts: the byte-level BPE compiled to a counting finite-state transducer.

The tokenizer is compiled in two layers.

* Splitting. The pre-tokenizer's pattern is regular and looks one character ahead, so whether a token starts at a
  character follows from the classes of a few neighbours. Each pretoken is one chunk whose state map is constant: the
  word transducer starts it in the state START whatever came before. Chunk maps that are constant compose by adding
  their counts, so the prefix scan over the chunks of a text is a running sum.
* Words. ``WordTransducer`` is a deterministic automaton over bytes. Reading a prefix w of a word brings it into a state,
  and every transition carries the change in the number of tokens, count(wb) - count(w), a small integer that may be
  negative. A state is what can still matter of w: the longest suffix that some longer vocabulary entry begins with, and
  for each live cut in it the token that ends there and the count there. The automaton is determinised as texts ask for
  transitions and kept for the life of the Python worker.

All pretokens of a batch step through the table together (one numpy gather for each byte position), so the work for a
byte is a few nanoseconds and does not depend on how long a text is.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEAD, START = -2, -1
#: From so many bytes on, a cut is remembered by the entries that can still end at it.
KEPT = 3
SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
#: White space as Rust's \s has it, without the space itself. Fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r\x85\xa0                　"
#: Rows of the transition table that one growth step adds.
GROWTH = 1 << 13
#: With more states than this the automaton is dropped and determinised anew as texts ask for it.
MOST_STATES = 1 << 18
#: Characters that are split and counted at a time; bounds the memory of a batch however long its texts are.
CHARS_AT_ONCE = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTransducer:
    """Counts the tokens of pretokens; see the module's docstring."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE with the usual split pattern can be compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_alphabet()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in reversed(list(enumerate(merges)))}
        special = set(self.special)
        self.vocab = {to_bytes(t) for t in model["vocab"] if t not in special}
        self.inner = {t[:i] for t in self.vocab for i in range(len(t))}  # what a longer entry begins with
        self.longer: dict[bytes, list[bytes]] = {}  # the entries that go on from a beginning of KEPT bytes or more
        for t in sorted(self.vocab):
            if self.encode(t) == [t]:
                for i in range(KEPT, len(t)):
                    self.longer.setdefault(t[:i], []).append(t)
        self.hopes: dict[tuple[bytes, bytes], int | None] = {}
        self.hope_ids: dict[tuple[bytes, ...], int] = {}
        self.hope_sets: list[tuple[bytes, ...]] = []
        self.parts = {a + b: (i, (a, b)) for (a, b), i in sorted(self.rank.items(), key=lambda x: -x[1])}  # how each entry is made
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.own: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.configs: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.next = np.full((0, 256), -1, dtype=np.int32)
        self.gain = np.zeros((0, 256), dtype=np.int8)
        self.state((b"", (START,), (0,)))

    def state(self, config: tuple) -> int:
        if (known := self.ids.get(config)) is not None:
            return known
        self.ids[config] = at = len(self.configs)
        self.configs.append(config)
        if at >= len(self.next):
            self.next = np.concatenate([self.next, np.full((GROWTH, 256), -1, dtype=np.int32)])
            self.gain = np.concatenate([self.gain, np.zeros((GROWTH, 256), dtype=np.int8)])
        return at

    def encode(self, word: bytes) -> list[bytes]:
        """The tokens of a short word by the merge rules."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.rank.get((parts[i], parts[i + 1]), sys.maxsize), i) for i in range(len(parts) - 1))
            if best == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The last (side 1) or first (side 0) part of a token at each stage of its making, with the rank of the merge that ends the stage."""
        if (known := self.spines.get((token, side))) is None:
            known, part, until = [], token, sys.maxsize
            while True:
                known.append((part, until))
                if part not in self.parts:
                    break
                until, part = self.parts[part][0], self.parts[part][1][side]
            self.spines[token, side] = known
        return known

    def follows(self, before: bytes, token: bytes) -> bool:
        """Whether ``token`` can stand right after ``before``: a token sequence is an encoding if all its pairs are.

        It can't if the last part of ``before`` and the first part of ``token`` at some stage would have merged with each
        other before either merged within its own token; on a tie the pair further left merges first.
        """
        if (known := self.fits.get((before, token))) is None:
            known = self.fits[before, token] = not any(
                (rank := self.rank.get((a, b))) is not None and rank < until_a and rank <= until_b
                for a, until_a in self.spine(before, 1)
                for b, until_b in self.spine(token, 0)
            )
        return known

    def whole(self, token: bytes) -> bool:
        if (known := self.own.get(token)) is None:
            known = self.own[token] = token in self.vocab and self.encode(token) == [token]
        return known

    def hope(self, last: bytes | int, text: bytes) -> bytes | int:
        """What matters of ``last`` at a cut that ``text`` has followed so far.

        After a few bytes only some entries still go on from ``text``; then it is the set of those that fit, and DEAD if
        none does. Before that it is the token itself, as too many entries go on.
        """
        if last == DEAD or text not in self.inner:
            return DEAD
        if len(text) < KEPT or isinstance(last, int):
            if len(text) < KEPT:
                return last
            going = self.longer.get(text, ()) if last == START else self.hope_sets[last - 1]
            fitting = tuple(t for t in going if t.startswith(text) and len(t) > len(text))
        elif (known := self.hopes.get((last, text))) is not None:
            return known
        else:
            fitting = tuple(t for t in self.longer.get(text, ()) if self.follows(last, t))
        if not fitting:
            found = DEAD
        elif (found := self.hope_ids.get(fitting)) is None:
            found = self.hope_ids[fitting] = len(self.hope_ids) + 1
            self.hope_sets.append(fitting)
        if not isinstance(last, int):
            self.hopes[last, text] = found
        return found

    def allowed(self, last: bytes | int, token: bytes) -> bool:
        if last == DEAD or not self.whole(token):
            return False
        if last == START:
            return True
        return token in self.hope_sets[last - 1] if isinstance(last, int) else self.follows(last, token)

    def step(self, at: int, byte: int) -> None:
        """Works out the transition of state ``at`` under ``byte``."""
        text, lasts, counts = self.configs[at]
        text += bytes((byte,))
        for i, (last, count) in enumerate(zip(lasts, counts, strict=True)):  # only one fits
            if self.allowed(last, text[i:]):
                token, gained = text[i:], count + 1
                break
        else:
            raise AssertionError("every byte is a token")
        lasts = [*(self.hope(last, text[i:]) for i, last in enumerate(lasts)), token]
        first = next(i for i, last in enumerate(lasts) if last != DEAD)
        counts = tuple(0 if last == DEAD else c - gained for c, last in zip([*counts, gained], lasts, strict=True))
        to = self.state((text[first:], tuple(lasts[first:]), counts[first:]))
        self.next[at, byte], self.gain[at, byte] = to, gained

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The tokens of each word data[start : start + size]; all words advance together, byte by byte."""
        if len(self.configs) > MOST_STATES:
            self.reset()
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        states, tokens = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        going = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
        for t, n in enumerate(going):
            codes = states[:n] * 256 + data[starts[:n] + t]
            to = self.next.ravel()[codes]
            if (new := np.flatnonzero(to < 0)).size:
                for code in np.unique(codes[new]):
                    self.step(int(code) >> 8, int(code) & 255)
                to = self.next.ravel()[codes]
            tokens[:n] += self.gain.ravel()[codes]
            states[:n] = to
        out = np.empty_like(tokens)
        out[order] = tokens
        return out


@cache
def transducer(path: str) -> WordTransducer:
    return WordTransducer(path)


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[[ord(c) for c in WHITE_SPACE]] = WHITE
    table[32] = SPACE
    return table


def token_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the split pattern starts a pretoken. chars: code points of texts one after another; first: where a text starts."""
    n = len(chars)
    kind = classes()[chars]
    before = np.concatenate([[WHITE], kind[:-1]]).astype(np.uint8)
    before[first] = WHITE
    ends = np.zeros(n, dtype=bool)
    ends[:-1] = first[1:]
    ends[-1:] = True
    white, white_before = kind <= WHITE, before <= WHITE
    last_white = white & ~ends & (np.concatenate([kind[1:], [OTHER]]) > WHITE)  # white space with something else after it
    # a run of one class is a token; the space before a run belongs to it, and other white space does not
    starts = first | (kind != before) & ~(white & white_before) & ~((before == SPACE) & ~white)
    starts |= last_white & white_before
    # an apostrophe at the start of a token takes s t m d or re ve ll with it
    quote = np.flatnonzero((chars == 39) & (before != OTHER) & (before != SPACE))
    quote = quote[~ends[quote]]
    one = chars[quote + 1]
    inside = ~ends[quote + 1]
    two = np.where(inside, chars[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    starts[quote[short | long] + 1] = False
    starts[quote[long] + 2] = False
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    after = after[after < n]
    # after a contraction a token starts, but for an apostrophe's own rules and white space that joins others
    starts[after[kind[after] > WHITE]] = True
    return starts


def count_texts(texts: list[str], words: WordTransducer) -> np.ndarray:
    """Tokens of each text; special strings inside a text are one token each and split what is around them."""
    out = np.zeros(len(texts), dtype=np.int64)
    pieces: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pieces:
            np.add.at(out, np.array(owner), _count_pieces(pieces, words))
        pieces.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        parts = [text]
        for mark in words.special:
            parts = [y for x in parts for y in x.split(mark)]
        out[i] += len(parts) - 1
        for part in parts:
            for at in _safe_cuts(part):
                pieces.append(part[at])
                owner.append(i)
                size += at.stop - at.start
                if size >= CHARS_AT_ONCE:
                    flush()
    flush()
    return out


def _safe_cuts(text: str) -> Iterator[slice]:
    """Cuts a long text where a token surely starts: at a space between two ASCII letters."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE:
        cut = at + CHARS_AT_ONCE
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isascii() and text[cut - 1].isalpha() and text[cut + 1].isascii() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield slice(at, cut)
        at = cut
    if at < len(text):
        yield slice(at, len(text))


def _count_pieces(pieces: list[str], words: WordTransducer) -> np.ndarray:
    joined = "".join(pieces)
    chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(p) for p in pieces])
    first = np.zeros(len(chars), dtype=bool)
    at = np.cumsum(lengths) - lengths
    first[at] = True
    data = np.frombuffer(joined.encode(), dtype=np.uint8)
    starts = np.flatnonzero(token_starts(chars, first))
    offsets = np.flatnonzero((data & 0xC0) != 0x80)[starts]  # in bytes
    counts = words.count(data, offsets, np.diff(np.append(offsets, len(data))))
    return np.add.reduceat(counts, np.searchsorted(starts, at))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can open. Null text is empty and has 0
    bytes and 0 tokens. Texts of any length are counted whole; long ones are cut where a token surely starts. Repeated
    rows are counted each, an empty table gives no rows, and other columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = transducer(tokenizer)
        for batch in batches:
            n = count_texts(batch.column(2).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
