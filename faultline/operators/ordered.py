"""Ordered scans that do not put a whole machine into one task.

A window ``partitionBy(machine).orderBy(ts)`` sorts every row of a machine in one task. All
ordered operators here run in two levels instead:

1. rows are windowed inside ``(keys, time slot)``;
2. one summary row per slot is windowed over the slots of a key. Their number is bounded by
   the length of the timeline divided by the slot width (87,600 one-hour slots in ten years),
   however many rows the slots hold;
3. the summary is joined back on ``(keys, slot)``, the partitioning step 1 already has.

Slots that hold too many rows are cut into 60 shorter ones, again and again until none is
crowded, so a burst of records in one machine's hour does not end up in one task either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.names import col, pick
from faultline.functions.times import MICROS, epoch_us
from faultline.session import settle

SLOT_SECONDS = 3600
SLOT_ROWS = 2_000_000    # rows a slot may hold
BROADCAST_SLOTS = 100_000  # crowded slots whose list may be broadcast (some 3 MB)
_SLOT, _US = "__slot", "__us"


def with_slots(
    df: DataFrame, keys: Sequence[str], us: Column, slot_seconds: float = SLOT_SECONDS, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """Rows with the start of their time slot; slots are in time order and hold at most ``slot_rows``
    rows, unless as many share one microsecond. Looking for crowded slots reads only keys and times."""
    width = max(int(slot_seconds * MICROS), 1)
    rows = df.withColumn(_US, us).withColumn(_SLOT, F.col(_US) - F.pmod(_US, F.lit(width)))
    while width > 1:
        crowded = (
            rows.groupBy(*pick(keys), _SLOT).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > slot_rows)
            .select(*pick(keys), _SLOT, F.lit(True).alias("__crowded"))
        )
        if crowded.isEmpty():
            break
        crowded = settle(crowded, "crowded-slots")
        found = crowded.count()
        width = max(width // 60, 1)
        part = F.col(_US) - F.col(_SLOT)
        finer = F.when(F.col("__crowded"), F.col(_US) - F.pmod(part, F.lit(width))).otherwise(F.col(_SLOT))
        marked = rows.join(F.broadcast(crowded) if found <= BROADCAST_SLOTS else crowded, [*keys, _SLOT], "left")
        rows = marked.withColumn(_SLOT, finer).drop("__crowded")
    return rows.drop(_US)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    tie: Sequence[str] = (),
    last: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    position: str | None = None,
    slot_seconds: float = SLOT_SECONDS,
    slot_us: Column | None = None,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Add columns that look along the order ``(ts, *tie)`` inside ``keys``.

    last / before:  newest non-null value of an expression up to and including / strictly before the row
    next / after:   oldest non-null value from the row on / strictly after the row
    position:       running row number (1-based); may be used inside the expressions
    """
    looks = [
        (name, expr, True, inclusive)
        for group, inclusive in ((last or {}, True), (before or {}, False))
        for name, expr in group.items()
    ] + [
        (name, expr, False, inclusive)
        for group, inclusive in ((next or {}, True), (after or {}, False))
        for name, expr in group.items()
    ]
    original = list(df.columns)
    order = [col(ts), *pick(tie)]
    cell = [*pick(keys), F.col(_SLOT)]
    rows = with_slots(df, keys, slot_us if slot_us is not None else epoch_us(col(ts)), slot_seconds, slot_rows)
    forward = Window.partitionBy(*cell).orderBy(*order)
    backward = Window.partitionBy(*cell).orderBy(*[o.desc() for o in order])

    if position:
        # Rows before each slot come first, so that expressions may use final positions.
        counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
        over_slots = Window.partitionBy(*pick(keys)).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*cell, F.coalesce(F.sum("__n").over(over_slots), F.lit(0)).alias("__offset"))
        rows = (
            rows.join(offsets, [*keys, _SLOT], "left")
            .withColumn(position, F.row_number().over(forward) + F.col("__offset"))
            .drop("__offset")
        )
        original.append(position)
    if not looks:
        return rows.select(*pick(original))

    rows = rows.withColumns({f"__v{i}": expr for i, (_, expr, _, _) in enumerate(looks)})
    held = order[0] if len(order) == 1 else F.struct(*order)  # a single plain column keeps the aggregate hash-based
    summary = rows.groupBy(*cell).agg(
        *[
            (F.max_by if is_back else F.min_by)(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), held)).alias(f"__c{i}")
            for i, (_, _, is_back, _) in enumerate(looks)
        ]
    )
    earlier = Window.partitionBy(*pick(keys)).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*pick(keys)).orderBy(F.desc(_SLOT)).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *cell,
        *[
            F.last(f"__c{i}", ignorenulls=True).over(earlier if is_back else later).alias(f"__c{i}")
            for i, (_, _, is_back, _) in enumerate(looks)
        ],
    )
    local = [
        F.last(f"__v{i}", ignorenulls=True)
        .over((forward if is_back else backward).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        .alias(f"__l{i}")
        for i, (_, _, is_back, inclusive) in enumerate(looks)
    ]
    joined = rows.select(*pick(original), F.col(_SLOT), *local).join(carry, [*keys, _SLOT], "left")
    replaced = {name for name, *_ in looks}
    return joined.select(
        *pick(n for n in original if n not in replaced),
        *[F.coalesce(f"__l{i}", f"__c{i}").alias(name) for i, (name, *_) in enumerate(looks)],
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_us: Column,
    right_us: Column,
    value: Column,
    out: str,
    inclusive: bool = True,
    slot_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """Add to each left row the ``value`` of the newest right row at or before ``left_us``.

    Both sides are merged into one ordered stream and scanned once: no pairs are formed,
    so dense stretches cost no more than sparse ones.
    """
    lhs = left.select(
        *pick(keys),
        left_us.alias("__at"),
        F.lit(1 if inclusive else -1).alias("__side"),
        F.struct(*pick(left.columns)).alias("__row"),
    )
    rhs = right.select(*pick(keys), right_us.alias("__at"), F.lit(0).alias("__side"), value.alias("__value"))
    merged = lhs.unionByName(rhs, allowMissingColumns=True)
    scanned = scan(
        merged, keys, "__at", ["__side"], last={out: F.col("__value")},
        slot_seconds=slot_seconds, slot_us=F.col("__at"),
    )
    return scanned.filter(F.col("__row").isNotNull()).select("__row.*", out)
