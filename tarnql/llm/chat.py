"""Chat formatting after collapsing cumulative snapshots, with DataFrame functions only.

Logs often hold a conversation once after each turn.  Every turn gets a rolling hash of
all turns up to it: four sums of hashes of (turn, role, text), so it needs no order among
rows and can be summed in blocks.  A conversation whose last hash occurs within a longer
one is a snapshot; two anti-joins remove snapshots and all but the first of equal
conversations before anything is rendered.

No conversation is gathered in one place, nor all rows of one turn number.  Hashes are
summed by turn number, then in blocks of ``BLOCK`` of these, and the blocks' sums are added
up.  Rows meet their conversation's facts by ``CELLS`` cells of each block, so that a
conversation with a third of all rows is spread over many tasks.  For rendering, the rows
that stay are sorted over all tasks; a row's exact place gives its part of ``PART`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK = PART = 256
#: Cells of the rows of one block of a conversation, at most.
CELLS = 4096
LANES = ("a", "b", "c", "d")


def _lanes() -> list[Column]:
    """Four hashes of 32 bits of one turn; sums of 2**31 of them fit a long."""
    none = F.struct(*[F.col(c).isNull() for c in ("turn", "role", "text")])  # nulls alone leave a hash as it is
    one = F.xxhash64(F.lit(11), none, "turn", "role", "text")
    two = F.xxhash64(F.lit(17), none, "text", "role", "turn")
    low = F.lit((1 << 32) - 1)
    halves = (one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32))
    return [h.alias(n) for h, n in zip(halves, LANES)]


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, turn, n, a, b, c, d, all): for each turn number, how many turns there are up to it and their sums; and how many in all."""
    each = turns.groupBy("conv", "block", "turn").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in LANES])
    sums = ("n", *LANES)
    blocks = each.groupBy("conv", "block").agg(*[F.sum(x).alias(x) for x in sums])
    # a row for every BLOCK turn numbers
    own = Window.partitionBy("conv")
    before = own.orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.sum("n").over(own).alias("all"), *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in sums])
    upto = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn")).rowsBetween(Window.unboundedPreceding, 0)
    inner = each.select("conv", "block", "turn", *[F.sum(x).over(upto).alias(x) for x in sums])
    # conv is a struct and block never null: an equality join keeps every row
    return inner.join(blocks, ["conv", "block"]).select("conv", "turn", "all", *[(F.col(x) + F.col(f"{x}0")).alias(x) for x in sums])


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the conversations that no longer one starts with, the smallest id of equal ones."""
    return _maximal(_turns(conversations)).select(F.col("conv.id").alias("conv_id"), F.col("n").alias("n_turns"), "n_copies")


def _place() -> list[Column]:
    """Of a row: its conversation (a null id is an id of its own), block of turn numbers and cell."""
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id")).alias("conv")
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long").alias("block")
    return [conv, block, F.pmod(F.xxhash64(F.lit(23), "turn", "role", "text"), F.lit(CELLS)).cast("int").alias("cell")]


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with hashes instead of texts."""
    return conversations.select(*_place(), "turn", *_lanes()).distinct()


def _maximal(turns: DataFrame) -> DataFrame:
    prefixes = common.stored(_prefixes(turns))
    key = ["n", *LANES]
    # equal conversations: the first id stands for all
    whole = prefixes.where("n = all").groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    # every prefix shorter than its conversation, once
    longer = prefixes.where("n < all").select(*key).distinct()
    return whole.join(longer, key, "left_anti")


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, each one's place among all in order of conversation, turn, role and text."""
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")]
    number = F.monotonically_increasing_id()  # the partition, and the place in it
    rows = common.stored(rows.orderBy(*order).withColumn("number", number))
    partition, place = F.shiftright("number", 33), F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(partition.alias("partition")).count()
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("partition", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    # two numbers for each partition of the sort: small whatever the table's size
    rows = rows.withColumn("partition", partition).join(F.broadcast(starts), "partition")
    return rows.withColumn("at", F.col("start") + place).drop("partition", "start", "number")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text) of every maximal conversation.

    A turn reads ``<|role|>``, a line end, its text, a line end and ``<|end|>`` with
    a line end; the texts of a conversation's parts, in their order, make the whole.
    A part has ``PART`` turns, the last one what is left; most conversations have
    only part 0.  The marks' ``<|`` is written ``< |`` inside roles and texts.

    A repeated row counts once.  Turns with one number follow in order of role, then
    text, nulls first.  Null roles read ``unknown``, null texts are empty, null turn
    numbers come first, and rows without conv_id form one conversation.  An empty table
    gives an empty result; other columns are ignored.
    """
    turns = common.stored(_turns(conversations))
    kept = _maximal(turns).select("conv", "n", "n_copies")
    # conversations meet cells, which have no texts, and cells meet rows
    cells = turns.select("conv", "block", "cell").distinct().join(kept, "conv")
    rows = conversations.select(*_place(), "turn", "role", "text").distinct().join(cells, ["conv", "block", "cell"])
    rows = _ranked(rows.select("conv", "n", "n_copies", "turn", "role", "text"))
    rows = common.stored(rows.withColumn("stretch", F.floor(F.col("at") / PART).cast("long")))
    firsts = rows.groupBy("conv").agg(F.min("at").alias("first"))
    stretches = rows.select("conv", "stretch").distinct().join(firsts, "conv")
    rows = rows.join(stretches, ["conv", "stretch"]).withColumn("part", F.floor((F.col("at") - F.col("first")) / PART).cast("long"))
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    line = F.concat(
        F.lit("<|"), plain(F.coalesce("role", F.lit("unknown"))), F.lit("|>\n"), plain(F.coalesce("text", F.lit(""))), F.lit("\n<|end|>\n")
    )
    lines = F.sort_array(F.collect_list(F.struct("at", line.alias("line"))))  # PART of them at most
    parts = rows.groupBy("conv", "n", "n_copies", "part").agg(lines.alias("lines"))
    return parts.select(
        F.col("conv.id").alias("conv_id"), "part", F.col("n").alias("n_turns"), "n_copies", F.array_join(F.col("lines.line"), "").alias("text")
    )


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (
  SELECT conv_id, turn, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(CAST(turn AS VARCHAR) || chr(1) || coalesce(role, chr(2)) || chr(1) || coalesce(text, chr(2)), chr(3)) OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
),
full_ones AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM r WHERE n = n_turns GROUP BY prefix),
kept AS (SELECT f.* FROM full_ones f ANTI JOIN (SELECT DISTINCT prefix FROM r WHERE n < n_turns) p ON f.prefix = p.prefix),
lines AS (
  SELECT t.conv_id, (row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) - 1) // 256 AS part, t.turn, t.role, t.text, k.n_copies,
         '<|' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS line
  FROM t JOIN kept k ON t.conv_id = k.conv_id
)
SELECT conv_id, part, CAST(sum(count(*)) OVER (PARTITION BY conv_id) AS BIGINT) AS n_turns, CAST(max(n_copies) AS BIGINT) AS n_copies,
       string_agg(line, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
FROM lines GROUP BY conv_id, part
"""
