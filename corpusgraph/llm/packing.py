"""Filling fixed-capacity containers with items (problem 7).

Items are spread by hash into blocks of bounded size, which are packed independently by bin completion: the largest
item left opens a container, the undominated sets of items that complete it, of any number of items, are tried from the fullest on,
branches whose waste can't beat the incumbent are cut, and the incumbent starts as the best-fit-decreasing solution. The
search of a block ends when the incumbent meets the lower bound or its budget of nodes is spent; the best solution found
then stands, whole. Containers that a block leaves loose are opened and their items packed again across blocks.

Only items larger than a container are divided: into full containers and a rest that is packed like an item.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.encoding import encode_texts
from corpusgraph.plans.lineage import cut
from corpusgraph.sources.tables import table

CAPACITY = 4096
#: Items of a block, containers that a block's search may open, sets that are enumerated to complete one, and branches that are followed.
BLOCK_ITEMS, NODES, TRIES, WIDTH = 2000, 20_000, 120, 3
#: Containers filled less than this are opened again in the second round.
LOOSE = 0.97


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers of item numbers; each item goes to the fullest container that takes it."""
    order = np.argsort(-sizes, kind="stable")
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    bins: list[list[int]] = []
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        bisect.insort(room, (left - size, b))
    return bins


def fillings(sizes: list[int], room: int, tries: int = TRIES) -> list[tuple[int, ...]]:
    """Sets of places in the ascending ``sizes`` that fit into ``room`` and can't take another item, in the order of a depth-first
    enumeration from the largest items on. Items of one size are alike. It ends with a perfect filling or after ``tries`` sets."""
    made: list[tuple[int, ...]] = []
    chosen: list[int] = []
    left = room
    levels = [bisect.bisect_right(sizes, room) - 1]  # of each level the place to try next
    while levels and len(made) < tries:
        at = levels[-1]
        if at < 0:
            levels.pop()
            if chosen:
                left += sizes[chosen.pop()]
            continue
        levels[-1] = bisect.bisect_left(sizes, sizes[at]) - 1
        chosen.append(at)
        left -= sizes[at]
        under = min(at, bisect.bisect_right(sizes, left)) - 1
        if under >= 0:
            levels.append(under)
            continue
        made.append(tuple(chosen))
        if left == 0:
            break
        left += sizes[chosen.pop()]
        levels[-1] = -1  # a smaller item in the last place is dominated by this one
    return made


def dominated(sizes: list[int], filling: tuple[int, ...], room: int) -> bool:
    """Whether some of the items could give way to one larger item that stays outside: what they'd leave free is then at least as
    useful elsewhere as that item."""
    slack = room - sum(sizes[i] for i in filling)
    inside = set(filling)
    sums = {(0, 0)}
    for i in filling:
        sums |= {(total + sizes[i], count + 1) for total, count in sums}
    for total, count in sums:
        if not count:
            continue
        at = bisect.bisect_left(sizes, total + (count == 1))
        while at < len(sizes) and sizes[at] <= total + slack:
            if at not in inside:
                return True
            at += 1
    return False


def completions(sizes: list[int], room: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """The fullest undominated sets that complete a container with ``room`` left, at most ``width``, fullest first and then of fewer items."""
    found = sorted(fillings(sizes, room), key=lambda f: (-sum(sizes[i] for i in f), len(f)))
    kept: list[tuple[int, ...]] = []
    for filling in found:
        if len(kept) == width:
            break
        if not kept or len(filling) > 12 or not dominated(sizes, filling, room):  # longer sets have too many subsets to test
            kept.append(filling)
    return kept or [()]


def bin_completion(sizes: np.ndarray, capacity: int, nodes: int = NODES, width: int = WIDTH) -> list[list[int]]:
    """Containers of item numbers, as few as the search finds. ``sizes`` must not exceed the capacity.

    The search goes depth first and follows the fullest completion; what it leaves are branches from the deepest container upward, which
    are entered as long as the waste so far leaves a chance to beat the incumbent.
    """
    best = best_fit_decreasing(sizes, capacity)
    total = int(sizes.sum())
    bound = -(-total // capacity)
    order = np.argsort(sizes, kind="stable")
    stack = [(sizes[order].tolist(), order.tolist(), [], 0)]
    opened = 0
    while stack and len(best) > max(bound, 1) and opened < nodes:
        left, items, filled, waste = stack.pop()
        while left and waste <= (len(best) - 1) * capacity - total:
            opened += 1
            largest, number = left[-1], items[-1]
            left, items = left[:-1], items[:-1]
            branches = []
            for places in completions(left, capacity - largest, width if opened < nodes else 1):
                gone = set(places)
                spare = capacity - largest - sum(left[p] for p in places)
                stay = [p for p in range(len(left)) if p not in gone]
                branches.append(([left[p] for p in stay], [items[p] for p in stay], [*filled, [number, *(items[p] for p in places)]], waste + spare))
                if spare == 0:
                    break
            stack.extend(reversed(branches[1:]))
            left, items, filled, waste = branches[0]
        if not left and len(filled) < len(best):
            best = filled
    return best


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "record", "part"], kind="stable").reset_index(drop=True)
        sizes = group["tokens"].to_numpy(np.int64)
        bins = bin_completion(sizes[sizes > 0], capacity)
        shift = int((sizes == 0).sum())
        bins = [[i + shift for i in b] for b in bins]
        if shift:  # items of no size need no room
            bins = bins or [[]]
            bins[0] = bins[0] + list(range(shift))
        number, place, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int32), np.empty(len(group), np.int64)
        for b, items in enumerate(bins):
            number[items] = b
            place[items] = np.arange(len(items))
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        return group.assign(number=number, place=place, offset=offset)

    return run


_ITEM = "record bigint, part int, tokens bigint"


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Every item's place: ``container string, place int, offset bigint, record, part int, tokens bigint``.

    ``place`` numbers the items of a container from 0, ``offset`` is the room used before the item. An item larger than
    the capacity is divided into parts, numbered from 0; all but the last fill a container alone. Other items have the one
    part 0. A null size counts as 0; items of size 0 take a place but no room. Repeated rows and null keys are items like
    others. An empty table needs no containers. A negative size is an error.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    tokens = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    checked = F.when(tokens < 0, F.raise_error(F.lit("negative size"))).otherwise(tokens)
    rows = items.select(F.col(key).cast("bigint").alias("record"), checked.alias("size"))
    full = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / capacity)).cast("int")
    parts = rows.select("record", F.explode(F.sequence(F.lit(0), full)).alias("part"), full.alias("last"), "size")
    parts = cut(parts.select("record", "part", (F.col("part") < F.col("last")).alias("alone"), F.when(F.col("part") < F.col("last"), F.lit(capacity)).otherwise(F.col("size") - F.col("last").cast("bigint") * capacity).cast("bigint").alias("tokens")), "items")

    alone = parts.where("alone").select(
        F.concat_ws("-", F.lit("a"), F.coalesce(F.col("record").cast("string"), F.lit("")), "part", F.hex(F.monotonically_increasing_id())).alias("container"),
        F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("offset"), "record", "part", "tokens",
    )
    rest = parts.where(~F.col("alone"))
    blocks = max(1, -(-rest.count() // block_items))
    schema = f"{_ITEM}, block bigint, number bigint, place int, offset bigint"

    def round_of(rows: DataFrame, blocks: int) -> DataFrame:
        spread = F.pmod(F.xxhash64("record", "part", "tokens", F.monotonically_increasing_id()), F.lit(blocks).cast("bigint"))
        # a given number of partitions: adaptive execution would bring small blocks together in one task
        tasks = min(blocks, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        apart = rows.select("record", "part", "tokens", spread.alias("block")).repartition(tasks, "block")
        return cut(apart.groupBy("block").applyInPandas(_pack(capacity), schema), "packed")

    first = round_of(rest, blocks)
    fill = first.groupBy("block", "number").agg(F.sum("tokens").alias("used"))
    loose = fill.where(F.col("used") < LOOSE * capacity).select("block", "number")
    again = first.join(loose, ["block", "number"], "left_semi")
    stay = first.join(loose, ["block", "number"], "left_anti")
    second = round_of(again, max(1, -(-again.count() // block_items)))

    def named(df: DataFrame, letter: str) -> DataFrame:
        return df.select(F.concat_ws("-", F.lit(letter), "block", "number").alias("container"), "place", "offset", "record", "part", "tokens")

    return alone.unionByName(named(stay, "b")).unionByName(named(second, "c"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = encode_texts(table(spark, folder, "documents"), "doc_id", counts=True)
    return pack(sizes, "record", "ids").withColumnRenamed("record", "doc_id")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container, place and document for all documents, in containers of 4,096 tokens."""
    return _packed(spark, folder)


def p7_waste(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled."""
    used = _packed(spark, folder).groupBy("container").agg(F.sum("tokens").alias("used"))
    return used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.lit(1) - F.sum("used") / (F.count("*") * CAPACITY)).alias("unused"))


QUERIES = {"p7_containers": p7_containers, "p7_waste": p7_waste}
SQL: dict[str, str] = {}
