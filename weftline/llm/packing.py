"""Filling fixed-capacity windows with documents (problem 6): bin completion.

What matters of a document is its length in tokens, so the search runs over the histogram of
lengths, which has at most as many rows as the window has tokens, however many documents
there are. A node of the branch-and-bound tree takes the largest length left and branches
over the fillings around it: the best-fit one first, then all others that no filling dominates
(after Martello and Toth). A node is cut where the windows used and the lower bound of those
still needed reach the incumbent, a filling where its waste is more than a better packing can
afford. The search ends when the incumbent meets the lower bound, or the tree is done, or its
steps are spent, which the plan tells. Documents then take the places of their length by rank.
"""

from __future__ import annotations

import os
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scale import checked_broadcast, cut

TOKENIZERS = "/opt/tokenizers"
#: Split pattern of the byte-level vocabulary (its own definition, a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most steps of the search for one best-fit filling, and of the search over all windows; at the
#: limit the incumbent stands and the plan is marked as not proven.
FILLING_STEPS, MOST_STEPS = 4_000, 300_000
#: Documents of one length are numbered in groups of about this many, so that no task gets all.
RANK_GROUP = 200_000
PACKED = "window_id int, doc_id long, part_no int, bin string, tokens int"
PLAN = "window_id int, length int, first_place long, per_bin int, first_bin long, next_place long, bins long, least long, steps long, proven boolean"


def token_counts(documents: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, tokens`` of every row, by a public byte-level tokenizer; null and empty texts have none."""

    def count(batches):
        import base64

        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, tokens long")


def _mask(histogram: dict[int, int]) -> int:
    """The lengths there are, as the bits of one number."""
    out = bytearray(max(histogram, default=0) // 8 + 1)
    for x, n in histogram.items():
        if n > 0:
            out[x >> 3] |= 1 << (x & 7)
    return int.from_bytes(out, "little")


def _upto(mask: int, most: int) -> int:
    """The largest length of at most ``most``; 0 if there is none."""
    return max(0, (mask & ((1 << (most + 1)) - 1)).bit_length() - 1) if most > 0 else 0


def best_filling(room: int, left: dict[int, int], mask: int, most_steps: int = FILLING_STEPS) -> tuple[list[tuple[int, int]], int]:
    """Lengths with their counts that fill ``room`` with least waste, of those ``left``, and the
    steps taken; of equal waste the one with the larger lengths. ``mask``: the lengths left.

    A step takes a length and how often it comes, so the search is no deeper than a filling has
    distinct lengths, however many documents it holds; its stack is its own.
    """
    small = (mask & -mask).bit_length() - 1
    if not mask or room < small:
        return [], 0
    if mask >> room & 1:
        return [(room, 1)], 1
    best, waste, x = [], room, room + 1
    while x := _upto(mask, min(waste, x - 1)):  # best fit
        n = min(left[x], waste // x)
        best.append((x, n))
        waste -= x * n

    def choices(below: int, r: int):
        """Next length and count for the room left, from large to small."""
        x = below
        while x := _upto(mask, min(r, x - 1)):
            most = min(left[x], r // x)
            # Of the smallest length, fewer than possible is never better.
            for n in range(most, most - 1 if x == small else 0, -1):
                # Waste bound: where nothing fits behind x, the rest of the room is wasted.
                if r - n * x >= small or r - n * x < waste:
                    yield x, n

    steps, chosen, stack = 1, [], [(room, choices(room + 1, room))]
    while stack and waste > 0 and steps <= most_steps:
        r, open_ = stack[-1]
        x, n = next(open_, (0, 0))
        if not x:
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        steps += 1
        chosen.append((x, n))
        r -= n * x
        if r < waste:
            best, waste = chosen[:], r
        if 0 < r < x and mask >> r & 1:
            best, waste = [*chosen, (r, 1)], 0
        if r < small:
            chosen.pop()
        else:
            stack.append((r, choices(x, r)))
    return best, steps


def dominated(filling: list[tuple[int, int]], slack: int, mask: int) -> bool:
    """Whether a length that was left out could take the place of some in ``filling`` which are not
    longer together. What then is left over is easier to place, so another filling dominates.

    ``mask``: the lengths left beside the filling."""
    sums, own = 1, 0
    for x, n in filling:
        own |= 1 << x
        k = 1
        while n > 0:  # sums of up to n copies, by doubling
            take = min(k, n)
            sums |= sums << (x * take)
            n -= take
            k *= 2
    # A sum that is just as long needs several lengths to be worse than the one.
    if sums & mask & ~own:
        return True
    near, width = sums << 1, 1
    while width < slack:
        near |= near << min(width, slack - width)
        width = min(2 * width, slack)
    return slack > 0 and near & mask != 0


def fillings(room: int, left: dict[int, int], mask: int, afford: int) -> Iterator[list[tuple[int, int]] | None]:
    """All fillings of ``room`` with a waste of at most ``afford``, of lengths ``left``, that none
    dominates; None for a step without one."""
    chosen: list[tuple[int, int]] = []
    stack: list[tuple[int, Iterator[tuple[int, int]]]] = []

    def choices(below: int, r: int):
        x = below
        while x := _upto(mask, min(r, x - 1)):
            for n in range(min(left[x], r // x), 0, -1):
                yield x, n
        yield 0, 0

    stack.append((room, choices(room + 1, room)))
    while stack:
        r, open_ = stack[-1]
        x, n = next(open_, (-1, 0))
        if x < 0:
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        if x > 0:
            chosen.append((x, n))
            stack.append((r - n * x, choices(x, r - n * x)))
            yield None
            continue
        if r <= afford:
            rest = mask
            for y, m in chosen:
                if left[y] == m:
                    rest ^= 1 << y
            if not dominated(chosen, r, rest):
                yield chosen[:]
                continue
        yield None


def least_windows(capacity: int, histogram: dict[int, int]) -> int:
    """Lower bound of the windows needed (Martello and Toth's L2): the best bound over all
    thresholds that leave the shorter lengths out of account."""
    items = sorted((x, n) for x, n in histogram.items() if n > 0)
    big = [(x, n) for x, n in items if 2 * x > capacity]
    count_big, sum_small = sum(n for _, n in big), sum(x * n for x, n in items if 2 * x <= capacity)
    best = count_big
    thresholds = [0, *(x for x, _ in items if 2 * x <= capacity)]
    # Rising threshold: big lengths above capacity - threshold stand alone, small ones below it drop out.
    alone, mid_n, mid_sum = len(big), count_big, sum(x * n for x, n in big)
    small = [(x, n) for x, n in items if 2 * x <= capacity]
    at = 0
    for t in thresholds:
        while at < len(small) and small[at][0] < t:
            sum_small -= small[at][0] * small[at][1]
            at += 1
        while alone and big[alone - 1][0] > capacity - t:
            alone -= 1
            mid_n -= big[alone][1]
            mid_sum -= big[alone][0] * big[alone][1]
        best = max(best, count_big + max(0, -(-(sum_small - (mid_n * capacity - mid_sum)) // capacity)))
    return best


@dataclass
class Plan:
    """Fillings with the number of windows that get them; the windows used, their lower bound, the
    steps taken and whether no packing with fewer windows is possible."""

    fillings: list[tuple[dict[int, int], int]]
    bins: int
    least: int
    steps: int
    proven: bool


def plan(capacity: int, histogram: dict[int, int], most_steps: int = MOST_STEPS) -> Plan:
    """Bin completion for pieces of 1 to ``capacity`` tokens."""
    left = {x: n for x, n in histogram.items() if n > 0 and 0 < x <= capacity}
    mask, total = _mask(left), sum(x * n for x, n in left.items())
    least = least_windows(capacity, left)
    best: list[tuple[dict[int, int], int]] | None = None
    most, steps = sum(left.values()) + 1, 0
    chosen: list[tuple[dict[int, int], int]] = []
    used = 0
    # What is left is told by a sum of 128-bit numbers; a state met again with no fewer windows is cut.
    weight = random.Random(capacity)
    weights = {x: weight.getrandbits(128) for x in sorted(left)}
    state, seen = sum(n * weights[x] for x, n in left.items()), {}

    def branches():
        """The fillings around the largest length left, each as often as it goes and once. After
        the first dive most of a node's fillings never come to be: they are made one by one."""
        nonlocal steps, mask
        largest = mask.bit_length() - 1
        left[largest] -= 1
        rest_mask = mask if left[largest] else mask ^ (1 << largest)
        first, took = best_filling(capacity - largest, left, rest_mask)
        left[largest] += 1
        steps += took if best is not None else 0

        def with_times(f):
            per = dict(f)
            per[largest] = per.get(largest, 0) + 1
            times = min(left[x] // n for x, n in per.items())
            yield per, times
            if times > 1:
                yield per, 1

        yield from with_times(first)
        known = sorted(first)
        # A better packing can waste no more than this in all its windows together.
        afford = (most - 1 - used) * capacity - total
        left[largest] -= 1
        source = fillings(capacity - largest, dict(left), rest_mask, afford)
        left[largest] += 1
        for f in source:
            steps += 1
            if f is None:
                yield None
            elif sorted(f) != known:
                yield from with_times(f)

    def take(per: dict[int, int], times: int, sign: int) -> None:
        nonlocal mask, total, used, state
        for x, n in per.items():
            had = left[x]
            left[x] = had - sign * n * times
            if (had > 0) != (left[x] > 0):
                mask ^= 1 << x
            total -= sign * x * n * times
            state -= sign * n * times * weights[x]
        used += sign * times

    if not left:
        return Plan([], 0, 0, 0, True)
    stack = [branches()]
    while stack and (best is None or most > least and steps <= most_steps):
        step = next(stack[-1], False)
        if step is None:
            continue
        if step is False:
            stack.pop()
            if chosen:
                take(*chosen.pop(), -1)
            continue
        take(*step, 1)
        chosen.append(step)
        if total and best is None:  # the first dive, whose packing is the incumbent
            stack.append(branches())
            continue
        if total and used - (-total // capacity) < most and seen.get(state, most) > used:
            seen[state] = used
            steps += len(left) // 16  # the bound reads all lengths
            if used + least_windows(capacity, left) < most:
                stack.append(branches())
                continue
        if not total and used < most:
            best, most = chosen[:], used
        take(*chosen.pop(), -1)
    return Plan(best, most, least, steps, most == least or not stack)


def _plans(capacities: dict[int, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        window = int(pdf.window_id.iloc[0])
        rows, place, first = [], {}, 0
        done = plan(capacities[window], dict(zip(map(int, pdf.length), map(int, pdf.n))))
        for per, times in done.fillings:
            for length, n in per.items():
                at = place.get(length, 0)
                place[length] = at + n * times
                rows.append((window, length, at, n, first, place[length], done.bins, done.least, done.steps, done.proven))
            first += times
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])

    return run


def _split(sizes: DataFrame, windows: DataFrame) -> tuple[DataFrame, dict[int, int]] | None:
    """One row per document and window size, as the result has, with the number of ``whole``
    windows a longer text fills alone and the ``length`` of the rest; and the capacities."""
    rows = windows.where("window_id IS NOT NULL AND capacity_tokens > 0").groupBy("window_id").agg(F.max("capacity_tokens").alias("c")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 window sizes")
    capacities = {r["window_id"]: r["c"] for r in rows}
    if not capacities:
        return None
    caps = F.array(*(F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(c).cast("long").alias("c")) for w, c in sorted(capacities.items())))
    every = sizes.select("doc_id", "tokens", F.inline(caps))
    whole = F.when(F.col("tokens") > F.col("c"), F.expr("tokens DIV c")).otherwise(0).cast("int")
    return every.select("window_id", "doc_id", "c", whole.alias("whole"), (F.col("tokens") - whole.cast("long") * F.col("c")).cast("int").alias("length")), capacities


def window_plans(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """The plan of every window size: for each length the places that one filling gives, with the
    windows used, their lower bound, the steps of the search and whether it proved the plan best."""
    split = _split(sizes, windows)
    if split is None:
        return sizes.sparkSession.createDataFrame([], PLAN)
    # At most ``capacity`` rows per window size reach one task here.
    histogram = split[0].where("length > 0").groupBy("window_id", "length").agg(F.count(F.lit(1)).alias("n"))
    return cut(histogram.groupBy("window_id").applyInPandas(_plans(split[1]), PLAN))


def pack(sizes: DataFrame, windows: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Every document in windows of every capacity: ``window_id, doc_id, part_no, bin, tokens``.

    Only a text longer than a whole window is split: into whole windows of its own (bin
    ``d<doc>.<part>``) and a rest that is packed like other documents (bin ``w<number>``).
    Documents without tokens take no room and go to ``w0``. Windows without positive capacity
    are left out; repeated rows of ``sizes`` are packed each. ``windows`` is a handful of rows
    (checked). ``plans``: those of :func:`window_plans` for the same tables, if they are there.
    """
    split = _split(sizes, windows)
    if split is None:
        return sizes.sparkSession.createDataFrame([], PACKED)
    plans, pieces = window_plans(sizes, windows) if plans is None else plans, split[0]
    own = pieces.where("whole > 0").select("window_id", "doc_id", F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("part_no"), F.col("c").cast("int").alias("tokens"))
    own = own.select("window_id", "doc_id", "part_no", F.concat(F.lit("d"), "doc_id", F.lit("."), "part_no").alias("bin"), "tokens")
    rests = pieces.where("length > 0 OR whole = 0").select("window_id", "doc_id", (F.col("whole") + 1).alias("part_no"), "length")

    groups = max(8, -(-sizes.count() // RANK_GROUP))
    grouped = rests.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    before = grouped.groupBy("window_id", "length", "g").agg(F.count(F.lit(1)).alias("n"))
    base = before.select("window_id", "length", "g", "n", F.coalesce(F.sum("n").over(Window.partitionBy("window_id", "length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # A group's places are a range: it takes along only the fillings that range meets, found once a group.
    starts = plans.groupBy("window_id", "length").agg(F.array_sort(F.collect_list(F.struct("first_place", "per_bin", "first_bin", "next_place"))).alias("starts"))
    low, high = F.col("base"), F.col("base") + F.col("n")
    base = base.join(checked_broadcast(starts), ["window_id", "length"], "left").select("window_id", "length", "g", "base", F.filter("starts", lambda s: (s.first_place < high) & (s.next_place > low)).alias("starts"))
    within = F.row_number().over(Window.partitionBy("window_id", "length", "g").orderBy("doc_id")) - 1
    placed = grouped.withColumn("within", within).join(base, ["window_id", "length", "g"]).withColumn("place", F.col("base") + F.col("within"))

    at = F.col("place")
    step = F.element_at(F.filter("starts", lambda s: s.first_place <= at), -1)
    number = step.first_bin + F.floor((at - step.first_place) / step.per_bin).cast("long")
    shared = placed.select("window_id", "doc_id", "part_no", F.when(F.col("length") == 0, F.lit("w0")).otherwise(F.concat(F.lit("w"), number.cast("string"))).alias("bin"), F.col("length").alias("tokens"))
    return own.unionByName(shared)


def usage(packed: DataFrame, windows: DataFrame, plans: DataFrame) -> DataFrame:
    """Per window size: windows used, tokens, share of room left, the fewest windows any packing
    needs (``least_bins``), the search's steps and whether it ended with a proof (``proven``)."""
    per = packed.where("tokens > 0").groupBy("window_id").agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    alone = packed.where("bin LIKE 'd%'").groupBy("window_id").agg(F.count(F.lit(1)).alias("alone"))
    search = plans.groupBy("window_id").agg(F.max("least").alias("least"), F.max("steps").alias("steps"), F.min("proven").alias("proven"))
    cap = windows.groupBy("window_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    room = F.col("bins") * F.col("capacity_tokens")
    least = F.coalesce("least", F.lit(0)) + F.coalesce("alone", F.lit(0))
    rows = per.join(alone, "window_id", "left").join(search, "window_id", "left").join(checked_broadcast(cap), "window_id")
    return rows.select("window_id", "capacity_tokens", "bins", "tokens", least.alias("least_bins"), (F.floor((1 - F.col("tokens") / room) * 10000 + 0.5) / 10000).alias("room_left"), F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("proven", F.lit(True)).alias("proven"))


def faults(packed: DataFrame, sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window size: documents placed, and how many windows are overfull, documents are not
    there with all their tokens, and documents are split without need (each 0 in a right packing)."""
    cap = checked_broadcast(windows.where("capacity_tokens > 0").groupBy("window_id").agg(F.max("capacity_tokens").alias("cap")))
    full = packed.groupBy("window_id", "bin").agg(F.sum("tokens").alias("t")).join(cap, "window_id").groupBy("window_id").agg(F.sum((F.col("t") > F.col("cap")).cast("long")).alias("overfull"))
    docs = packed.groupBy("window_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("parts"))
    both = docs.join(sizes.groupBy("doc_id").agg(F.sum("tokens").alias("tokens")), "doc_id", "left").join(cap, "window_id")
    torn = (F.col("parts") > 1) & (F.col("tokens") <= F.col("cap"))
    per = both.groupBy("window_id").agg(F.count(F.lit(1)).alias("documents"), F.sum((~F.col("t").eqNullSafe(F.col("tokens"))).cast("long")).alias("incomplete"), F.sum(torn.cast("long")).alias("torn"))
    return per.join(full, "window_id").select("window_id", "documents", "overfull", "incomplete", "torn")
