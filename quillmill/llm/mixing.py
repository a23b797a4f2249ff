"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Rows of each source are grouped into blocks. In a period of Q slots a source of weight w / Q gets w slots, one block
each. Its i-th block in the period (from 0) is released at floor(i * Q / w) and due by ceil((i + 1) * Q / w); of the
released blocks the one due first takes the slot. Unit jobs with whole-numbered windows that a fluid schedule meets are
all met by this rule, so after any number of slots every source is less than one block away from its share.

The schedule of one period is worked out once, whatever the number of rows, and repeats. A source that runs dry leaves,
and a new phase begins in which the others share by the same weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm._util import apart, bucket_of, number_rows, without

#: From the rows left of each source to the phases: each repeats a period in which a source has least(left, weight)
#: slots, as often as the source that runs dry first can.
_PHASES = """
aggregate(
  sequence(1, 2 * size(blocks) + 1),
  named_struct('rest', blocks, 'done', transform(blocks, x -> 0L), 'start', 0L,
               'phases', cast(array() AS array<struct<start:bigint,periods:bigint,total:bigint,slots:array<bigint>,done:array<bigint>>>)),
  (a, i) -> if(
    forall(a.rest, r -> r = 0), a,
    transform(
      array(zip_with(a.rest, weights, (r, w) -> least(r, w))),
      q -> transform(
        array(named_struct('periods', array_min(filter(zip_with(a.rest, q, (r, w) -> if(w > 0, r div w, NULL)), x -> x IS NOT NULL)),
                           'total', aggregate(q, 0L, (s, w) -> s + w))),
        p -> named_struct(
          'rest', zip_with(a.rest, q, (r, w) -> r - p.periods * w),
          'done', zip_with(a.done, q, (d, w) -> d + p.periods * w),
          'start', a.start + p.periods * p.total,
          'phases', concat(a.phases, array(named_struct('start', a.start, 'periods', p.periods, 'total', p.total, 'slots', q, 'done', a.done)))))[0])[0]),
  a -> a.phases)
"""

#: The source (its index) of each slot of a phase's period: earliest deadline first among the released blocks.
_ORDER = """
aggregate(
  sequence(0L, p.total - 1),
  named_struct('taken', transform(p.slots, x -> 0L), 'order', cast(array() AS array<int>)),
  (a, t) -> transform(
    array(array_min(transform(p.slots, (w, i) -> if(
      a.taken[i] < w AND (a.taken[i] * p.total) div w <= t,
      named_struct('due', ((a.taken[i] + 1) * p.total + w - 1) div w, 'i', i), NULL)))),
    best -> named_struct('taken', transform(a.taken, (x, i) -> if(i = best.i, x + 1, x)), 'order', concat(a.order, array(best.i))))[0],
  a -> a.order)
"""


#: The columns that mixing adds.
ADDED = ["mix_weight", "mix_phase", "mix_block", "mix_rank"]


def _of(source: Column) -> Column:
    """A key for each source, nulls being one of them."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def schedule(sizes: DataFrame, weights: dict[str | None, float] | None, block_rows: int, period: int) -> DataFrame:
    """(of_source, weight, plan) for each source of ``sizes`` (_source, rows).

    plan: the phases that a source takes part in, as structs of the phase's number, first slot, periods, slots in a
    period, the source's slots in it, and its blocks placed before.
    """
    rows = F.col("rows").cast("double")
    if weights is None:
        weight = F.sqrt(rows)
    else:
        known = F.create_map(*[x for k, v in weights.items() for x in (_of(F.lit(k)), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(known[F.col("_source")], F.lit(0.0))
    listed = sizes.select("_source", F.ceil(rows / block_rows).cast("long").alias("blocks"), weight.alias("weight"))
    one = listed.agg(F.array_sort(F.collect_list(F.struct("_source", "blocks", "weight"))).alias("s")).where(F.size("s") > 0)
    share = F.expr("aggregate(s, 0D, (t, x) -> t + x.weight)")
    one = one.withColumn("all", share).selectExpr(
        "transform(s, x -> x._source) AS names",
        "transform(s, x -> x.blocks) AS blocks",
        f"transform(s, x -> greatest(1L, cast(round({period} * if(`all` > 0, x.weight / `all`, 0D)) AS bigint))) AS weights",
    )
    phases = one.withColumn("phases", F.expr(_PHASES)).select("names", "weights", F.posexplode("phases").alias("phase", "p"))
    ordered = phases.withColumn("order", F.expr(_ORDER))
    each = ordered.select("phase", "p", "order", "weights", F.posexplode("names").alias("i", "of_source")).where(F.expr("p.slots[i] > 0"))
    part = F.expr(
        "named_struct('phase', phase, 'start', p.start, 'periods', p.periods, 'total', p.total, 'slots', filter(transform(order, (s, t) -> if(s = i, t, NULL)), t -> t IS NOT NULL), 'done', p.done[i])"
    )
    share = F.expr("weights[i] / aggregate(weights, 0L, (t, w) -> t + w)")
    return each.groupBy("of_source").agg(F.max(share).alias("weight"), F.collect_list(part).alias("plan"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 32, period: int = 256, buckets: int = 1024) -> DataFrame:
    """Places every row of ``docs`` (doc_id, text, source, ...) in one stream that holds the target weights.

    Adds mix_weight (the source's target share), mix_phase, mix_block (the slot, from 0 without gaps) and mix_rank (the
    place in the block); reading the rows by (mix_block, mix_rank) gives the mixture. In phase 0 all sources are there
    and each is less than one block from its share at any point. No row is dropped or repeated: when a source runs dry
    the others go on by their weights in the next phase, and in its last period a source has the blocks that are left.

    weights: by source; missing sources and zero weights get the least share, one slot in a period. None takes the
    square root of each source's size. Shares are rounded to slots of a period. Within a source, rows come by a hash of
    doc_id. No task holds a whole source: rows are numbered by hash bucket, and only sizes are summed.

    A null source is a source. Null doc_ids and repeated rows are rows like others (ties go by the text's hash). An
    empty table gives no rows. Columns of ``docs`` that are named like the added ones are replaced.
    """
    placed, back = _placed(docs, weights, block_rows, period, buckets)
    return placed.select(*without(back, docs, ADDED), *ADDED)


def mixture(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 32, period: int = 256, buckets: int = 1024) -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, sorted into the order of ``mix``."""
    placed, back = _placed(docs, weights, block_rows, period, buckets)
    return placed.orderBy("mix_block", "mix_rank").select(*back)


def _placed(docs: DataFrame, weights: dict[str | None, float] | None, block_rows: int, period: int, buckets: int) -> tuple[DataFrame, list[Column]]:
    rows, of, back = apart(docs)
    rows = rows.withColumn("_source", _of(of("source")))
    plans = schedule(rows.groupBy("_source").agg(F.count(F.lit(1)).alias("rows")), weights, block_rows, period)
    order = [F.xxhash64(of("doc_id")), of("doc_id"), F.xxhash64(of("text"))]
    numbered = number_rows(rows, bucket_of([of("doc_id")], buckets), order, within=["_source"])
    placed = numbered.join(plans, F.col("_source") == F.col("of_source"))
    block = F.floor(F.col("row_number") / block_rows)
    placed = placed.withColumn("_block", block).withColumn("_part", F.expr("filter(plan, x -> _block >= x.done AND _block < x.done + x.periods * size(x.slots))[0]"))
    placed = placed.select(
        *rows.columns,
        F.col("weight").alias("mix_weight"),
        F.col("_part.phase").alias("mix_phase"),
        F.expr("_part.start + ((_block - _part.done) div size(_part.slots)) * _part.total + _part.slots[cast((_block - _part.done) % size(_part.slots) AS int)]").alias("mix_block"),
        (F.col("row_number") % block_rows).alias("mix_rank"),
    )
    return placed, back
