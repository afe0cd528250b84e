"""Sharding by histogram sort.

Every row gets a 120-bit key (60 bits from its group, here the text, then 60 bits from the row), so
equal texts lie together.  Bytes and rows below candidate boundaries are counted exactly over all
partitions; only the cells that hold a splitter are probed again, finer, until each splitter is
within tolerance or the key has no more bits.  Then rows are exchanged once, by cell.  There are cells
for each 250,000 rows, 4 a shard at least and 8,192 at most, of about equal rows however the bytes lie,
so no task gets a whole shard; beyond 2 * 10 ** 9 rows cells grow and are sorted with spilling.

Defined cases: null text counts no bytes and forms one group with other null and empty texts; a row
larger than a shard's share stays whole; rows of equal text stay together unless a splitter must
fall among them; an empty table gives an empty result; fewer rows than shards leaves shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS = 40
#: Bits of the two halves of the key that each round of probes tells apart.
DIGITS = (12, 6, 6, 6, 6, 6, 6, 6, 6)
HALF = sum(DIGITS)
TOLERANCE = 0.001
ROW_BYTES = 16
#: Rows that a cell is meant to hold, and the most cells: each open cell sends 64 counts a round to the driver.
CELL_ROWS, MOST_CELLS = 250_000, 8192


@dataclass(frozen=True)
class Splitter:
    """All keys (high, low) at or above it lie behind."""

    high: int
    low: int


def sixty_bits(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << HALF) - 1))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds shard_high, shard_low and shard_bytes.  The row number keeps fully equal rows apart; the
    result must be materialised before it is read twice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({
        "shard_high": sixty_bits(text),
        "shard_low": sixty_bits(F.col(id_col), F.monotonically_increasing_id()),
        "shard_bytes": (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long"),
    })


def find_splitters(keyed: DataFrame, wanted: list[tuple[str, float]], tolerance: dict[str, float]) -> list[Splitter]:
    """For each (measure, amount), measure "bytes" or "rows", the key below which that amount lies.

    Every round counts the probes' cells exactly in one aggregate; at most len(wanted) cells are
    open, so at most len(wanted) * 64 counts reach the driver after the first 4,096.
    """
    found: dict[int, Splitter] = {}
    # cell: (known bits of high, known bits of low) with the amounts below it
    start = ((0, 0), (0, 0))
    open_cells: dict[tuple, tuple] = {start: ({"bytes": 0, "rows": 0}, list(range(len(wanted))))}
    while open_cells:
        nxt: dict[tuple, tuple] = {}
        by_level: dict[tuple[int, int], list] = {}
        for cell in open_cells:
            by_level.setdefault((cell[0][1], cell[1][1]), []).append(cell)
        for (hb, lb), cells in by_level.items():
            digit = DIGITS[np.cumsum((0, *DIGITS)).tolist().index(hb if hb < HALF else lb)]
            high, low = F.col("shard_high"), F.col("shard_low")
            if hb < HALF:
                known = F.shiftright(high, HALF - hb) if hb else F.lit(0).cast("long")
                inside = known.isin([c[0][0] for c in cells])
                probe_h, probe_l = F.shiftright(high, HALF - hb - digit), F.lit(0).cast("long")
            else:
                tops = sorted({c[0][0] for c in cells})
                inside = high.isin(tops)
                if lb:
                    pairs = [(high == c[0][0]) & (F.shiftright(low, HALF - lb) == c[1][0]) for c in cells]
                    both = pairs[0]
                    for p in pairs[1:]:
                        both = both | p
                    inside = inside & both
                probe_h, probe_l = high, F.shiftright(low, HALF - lb - digit)
            counts = keyed.filter(inside).groupBy(probe_h.alias("h"), probe_l.alias("l")).agg(
                F.sum("shard_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                F.min("shard_high").alias("first"), F.max("shard_high").alias("last"),
            ).collect()
            groups: dict[tuple, list] = {}
            for r in counts:
                key = ((r.h >> digit, hb), (0, 0)) if hb < HALF else ((r.h, HALF), (r.l >> digit, lb))
                groups.setdefault(key, []).append(r)
            for cell in cells:
                below, splitters = open_cells[cell]
                rows = sorted(groups.get(cell, []), key=lambda r: (r.h, r.l))
                at = dict(below)
                for r in rows:
                    after = {m: at[m] + r[m] for m in at}
                    if hb < HALF:
                        edge = (Splitter(r.h << (HALF - hb - digit), 0), Splitter((r.h + 1) << (HALF - hb - digit), 0))
                        if hb + digit == HALF or r.first == r.last:  # one group only: go on inside it
                            inner = ((r.first, HALF), (0, 0))
                            edge = (Splitter(r.first, 0), Splitter(r.first + 1, 0))
                        else:
                            inner = ((r.h, hb + digit), (0, 0))
                    else:
                        shift = HALF - lb - digit
                        edge = (Splitter(r.h, r.l << shift), Splitter(r.h, (r.l + 1) << shift))
                        inner = ((r.h, HALF), (r.l, lb + digit)) if lb + digit < HALF else None
                    for i in splitters:
                        m, amount = wanted[i]
                        if i in found or not at[m] <= amount < after[m]:
                            continue
                        to_low, to_high = amount - at[m], after[m] - amount
                        if min(to_low, to_high) <= tolerance[m] or inner is None or r.rows == 1:
                            found[i] = edge[0] if to_low <= to_high else edge[1]
                        else:
                            nxt.setdefault(inner, (dict(at), []))[1].append(i)
                    at = after
                for i in splitters:  # beyond the last row
                    if i not in found and not any(i in x[1] for x in nxt.values()):
                        found[i] = Splitter(1 << HALF, 0)
        open_cells = nxt
    return [found[i] for i in range(len(wanted))]


def cell_of(splitters: list[Splitter]):
    """Arrow-batched lookup of the number of splitters at or below a key."""
    highs = np.array([s.high for s in splitters], dtype=np.int64)
    lows = np.array([s.low for s in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def find(high: pd.Series, low: pd.Series) -> pd.Series:
        h, t = high.to_numpy(), low.to_numpy()
        first, last = np.searchsorted(highs, h, "left"), np.searchsorted(highs, h, "right")
        out = first.copy()
        for at in np.unique(first[first < last]):
            own = (first == at) & (first < last)
            end = last[own][0]
            out[own] = at + np.searchsorted(lows[at:end], t[own], "right")
        return pd.Series(out.astype(np.int32))

    return find


def shard_rows(keyed: DataFrame, *, shards: int = SHARDS, cells: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """keyed: materialised, with the columns of with_keys().  Adds shard and slot (gapless from 0 in
    each shard) after one exchange.  Columns of these names, and _cell, _at, _offset and _row, are replaced."""
    spark, keyed = keyed.sparkSession, keyed.drop("shard", "slot", "_cell", "_at", "_offset", "_row")
    total = keyed.agg(F.sum("shard_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n_bytes, n_rows = total.bytes or 0, total.rows
    cells = cells or max(4 * shards, min(-(-n_rows // CELL_ROWS), MOST_CELLS))
    wanted = [("bytes", n_bytes * i / shards) for i in range(1, shards)]
    wanted += [("rows", n_rows * i / cells) for i in range(1, cells)]
    slack = {"bytes": tolerance * n_bytes / shards, "rows": 0.25 * n_rows / cells}
    found = find_splitters(keyed, wanted, slack) if n_rows else [Splitter(1 << HALF, 0)] * len(wanted)
    by_bytes = sorted((s.high, s.low) for s in found[: shards - 1])
    every = sorted({(s.high, s.low) for s in found})
    numbered = keyed.withColumn("_cell", cell_of([Splitter(*s) for s in every])("shard_high", "shard_low"))
    dealt = numbered.repartition(cells, "_cell") if cells > 4 * shards else numbered
    counts = {r["_cell"]: r["n"] for r in numbered.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, offset, before = [], 0, -1
    for cell in range(len(every) + 1):
        shard = 0 if cell == 0 else sum(b <= every[cell - 1] for b in by_bytes)
        offset = offset if shard == before else 0
        rows.append((cell, shard, offset))
        offset, before = offset + counts.get(cell, 0), shard
    side = spark.createDataFrame(rows, "_at int, shard int, _offset long")  # at most shards + cells rows
    order = Window.partitionBy("_cell").orderBy("shard_high", "shard_low")
    return (
        dealt.withColumn("_row", F.row_number().over(order) - 1)
        .join(F.broadcast(side), F.col("_cell") == F.col("_at"))
        .withColumn("slot", (F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_cell", "_at", "_offset", "_row")
    )


def op8_sharding(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keyed = with_keys(docs).select(
        "doc_id", "shard_high", "shard_low", "shard_bytes",
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    return shard_rows(materialize(keyed, "shard-keys")).select(
        "doc_id", F.col("shard_bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
