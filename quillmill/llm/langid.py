"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of sample texts. A text is encoded with each dictionary in
turn; the language of the smallest code wins, and a narrow margin over the second rejects the decision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm._compress import Sizer, chosen, dictionary, spread

#: What texts without letters get.
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    contents: tuple[bytes, ...]


def train(labelled: DataFrame, texts_per_language: int = 200, dictionary_bytes: int = 1 << 16, text_chars: int = 1 << 14) -> LanguageModel:
    """Builds the dictionaries from ``labelled`` (doc_id, text, lang).

    The sample is bounded: about ``texts_per_language`` texts of each language, picked by a hash of doc_id, with at
    most ``text_chars`` characters of each, make a dictionary of at most ``dictionary_bytes``. Only this sample and one
    count for each language reach the driver. Rows with a null lang or text teach nothing.
    """
    rows = labelled.select(F.col("doc_id"), F.col("text"), F.col("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel((), ())
    there = F.create_map(*[F.lit(x) for pair in sorted(counts.items()) for x in pair])
    sample = rows.where(chosen(F.col("doc_id"), texts_per_language, there[F.col("lang")]))
    texts: dict[str, list[str]] = {lang: [] for lang in sorted(counts)}
    for r in sorted(sample.select("lang", "doc_id", spread(F.lower("text"), text_chars).alias("text")).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"])):
        texts[r["lang"]].append(r["text"])
    return LanguageModel(tuple(texts), tuple(dictionary(t, dictionary_bytes) for t in texts.values()))


def identify(docs: DataFrame, model: LanguageModel, least_margin: float = 0.002) -> DataFrame:
    """doc_id, lang_pred, score, margin and accepted of every document, from its whole text alone.

    margin: by how much the second smallest code is larger, as a share of the text's bytes; accepted: whether the margin
    is ``least_margin`` or more, so a caller that wants to reject narrow decisions filters by it. score: the winner's
    share when each language is weighted by 2 ** (-saved bytes / 8), from 0 to 1. Texts that are null or have no letter,
    and all texts if there are no languages, get ``und`` and score 0. A tie goes to the language first in order and is
    never accepted. Case is ignored. Repeated rows are judged each, an empty table gives no rows, and other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sizer = Sizer(list(known.contents))
        for batch in batches:
            out = [_judge(text, known, sizer, least_margin) for text in batch.column(1).to_pylist()]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "lang_pred", "score", "margin", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(judged, "doc_id long, lang_pred string, score double, margin double, accepted boolean")


def _judge(text: str | None, model: LanguageModel, sizer: Sizer, least_margin: float) -> tuple[str, float, float, bool]:
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0, False
    n, sizes = sizer.sizes(text.lower())
    order = np.argsort(sizes, kind="stable")
    best = int(order[0])
    weights = np.exp2(-(np.array(sizes, dtype=float) - sizes[best]) / 8)
    margin = (sizes[int(order[1])] - sizes[best]) / n if len(order) > 1 else 1.0
    return model.languages[best], float(1 / weights.sum()), margin, margin >= least_margin and margin > 0


def held_out(key: Column, divisor: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves ``rest``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor == rest
