"""Problem 8: filling fixed-capacity containers with texts of varying length.

Sizes are tokens of a public tokenizer. Texts are dealt into cells of bounded size, and
each cell is packed by bin completion: branch and bound over the undominated fillings
around the largest text left, pruned by the waste that the best solution so far allows,
which starts as best-fit decreasing.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.session import materialize, texts

CAPACITY = 2048
#: Texts in a cell, fillings tried at a node, and nodes opened in a cell before its best solution stands.
CELL, FILLINGS, NODES = 2_000, 6, 1_500
#: A cell's node budget is at least so many dives to a full solution.
DIVES = 4
#: How many sizes are tried at each place of a filling, and how many texts a filling adds at most by search.
BREADTH, DEPTH = 5, 4
#: Larger fillings are not compared piece by piece; they are only kept in order of waste.
DOMINANCE = 5


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """The vocabulary's place: SIJILL_TOKENIZER, else the installed public tokenizers."""
    if path := os.environ.get("SIJILL_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("sijill", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, field: str, path: str) -> DataFrame:
    """(key, n_tokens) of whole texts; null and empty texts have 0."""

    def run(batches):
        encoder = load_tokenizer(path)
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    return df.select(F.col(key).cast("long").alias(key), field).mapInArrow(run, f"`{key}` long, n_tokens long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item into the fullest container that still holds it. Items are positions."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_right(room, (sizes[i] - 1, len(sizes)))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (left - sizes[i], b))
    return bins


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's items can be laid, in groups, into the places of a's items: whatever b achieves, a does."""
    if not b:
        return True
    if len(a) > len(b) + 2 or len(b) > DOMINANCE or sum(a) < sum(b):
        return False
    big, rest = max(b), list(b)
    rest.remove(big)
    seen = set()
    for k, place in enumerate(a):
        if place >= big and place not in seen:
            seen.add(place)
            if dominates(a[:k] + (place - big,) + a[k + 1 :], tuple(rest)):
                return True
    return False


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by volume, and by the room that items over half the capacity leave to those not below k."""
    ordered = sorted(sizes)
    sums = [0]
    for s in ordered:
        sums.append(sums[-1] + s)
    at = lambda size: bisect_right(ordered, size)
    half = at(capacity // 2)
    best = -(-sums[-1] // capacity)
    for k in {0, *(s for s in ordered[:half])}:
        # over capacity - k: alone; over half: one each, with room for some of the rest from k up
        large, low = at(capacity - k), at(k - 1)
        middle, small = large - half, sums[half] - sums[min(low, half)]
        room = middle * capacity - (sums[large] - sums[half])
        best = max(best, len(ordered) - large + middle + max(0, -(-(small - room) // capacity)))
    return best


class BinCompletion:
    def __init__(self, sizes: list[int], capacity: int, nodes: int = NODES):
        self.sizes, self.capacity = sizes, capacity
        self.total = sum(sizes)
        self.best = best_fit(sizes, capacity)
        self.bound = lower_bound(sizes, capacity)
        # every dive to a full solution opens a node a container: the budget is several dives, whatever the cell holds
        self.nodes = max(nodes, DIVES * len(self.best))
        self.stock: dict[int, list[int]] = {}
        for i, s in enumerate(sizes):
            self.stock.setdefault(s, []).append(i)

    def fillings(self, left: list[int], room: int) -> list[tuple[int, ...]]:
        """Undominated sets of sizes that fit into the room, least waste first. left: sizes in stock, ascending."""
        found: list[tuple[int, ...]] = []

        def search(room: int, top: int, chosen: tuple[int, ...]) -> bool:
            k = min(bisect_right(left, room), top) - 1
            if k < 0 or len(chosen) == DEPTH:
                # what still fits is added greedily, so that no filling leaves room for an item
                extra = chosen
                while k >= 0:
                    s = left[k]
                    if s <= room and extra.count(s) < len(self.stock[s]):
                        extra += (s,)
                        room -= s
                        k = bisect_right(left, room, 0, k + 1) - 1
                    else:
                        k -= 1
                found.append(extra)
                return room == 0
            tried = 0
            while k >= 0 and tried < (BREADTH if len(chosen) < DEPTH - 1 else 1):
                s = left[k]
                if chosen.count(s) < len(self.stock[s]):
                    tried += 1
                    if search(room - s, k + 1, (*chosen, s)):
                        return True  # an exact fit dominates all that is left
                k -= 1
            if not tried:
                found.append(chosen)
            return False

        search(room, len(left), ())
        out: list[tuple[int, ...]] = []
        for f in sorted(set(found), key=lambda f: (-sum(f), len(f), f)):
            if not any(dominates(g, f) for g in out):
                out.append(f)
                if len(out) == FILLINGS:
                    break
        return out or [()]

    def solve(self) -> list[list[int]]:
        """The containers as positions of items; no worse than best-fit decreasing."""
        if len(self.best) <= self.bound:
            return self.best
        left = sorted(s for s, items in self.stock.items() if items)
        path: list[list[int]] = []
        # explicit stack of (fillings still to try, sizes taken at this level)
        stack: list[list] = []
        waste, opened, count = 0, 0, len(self.sizes)

        def take(size: int) -> int:
            items = self.stock[size]
            i = items.pop()
            if not items:
                left.pop(bisect_right(left, size) - 1)
            return i

        def give(size: int, i: int) -> None:
            if not self.stock[size]:
                insort(left, size)
            self.stock[size].append(i)

        def open_node() -> None:
            big = left[-1]
            item = take(big)
            stack.append([iter(self.fillings(left, self.capacity - big)), big, item, ()])

        open_node()
        while stack and opened < self.nodes:
            level = stack[-1]
            tries, big, item, used = level
            if used != ():
                # undo the filling tried before
                for s, i in reversed(used[1]):
                    give(s, i)
                waste -= used[2]
                count += len(used[1]) + 1
                path.pop()
                level[3] = ()
            filling = next(tries, None)
            if filling is None:
                give(big, item)
                stack.pop()
                continue
            spare = self.capacity - big - sum(filling)
            # waste that a solution with one container less than the best may have
            if waste + spare > (len(self.best) - 1) * self.capacity - self.total:
                continue
            opened += 1
            taken = [(s, take(s)) for s in filling]
            path.append([item, *(i for _, i in taken)])
            waste += spare
            count -= len(taken) + 1
            level[3] = (True, taken, spare)
            if count == 0:
                self.best = [list(p) for p in path]
                if len(self.best) <= self.bound:
                    break
            else:
                open_node()
        return self.best


def pack_containers(sizes: DataFrame, key: str, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """(container_id, key, part, first_token, n_tokens): every text's place. sizes: key, n_tokens.

    A text over the capacity is cut into full containers and a rest, which is packed as
    any other; no other text is split. Texts without tokens (null or empty) need no room
    and come out with a null container; an empty table gives no rows; repeated keys are
    packed each. Cells are dealt by hash, so they are of like size whatever source or
    length dominates; a task holds `cell` texts' numbers, never their words.
    """
    kept = materialize(sizes, "token-counts")
    cells = max(1, -(-kept.count() // cell))
    full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity).cast("int")
    dealt = kept.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * capacity).withColumn("cell", F.pmod(F.xxhash64(key, "n_tokens"), F.lit(cells)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([key, "n_tokens"], kind="stable")
        keys, rests, fulls = frame[key].tolist(), frame["rest"].tolist(), frame["full"].tolist()
        base = int(frame["cell"].iloc[0]) << 32
        bins = BinCompletion(rests, capacity).solve()
        rows, n = [], len(bins)
        for b, items in enumerate(bins):
            rows += [(base + b, keys[i], fulls[i], fulls[i] * capacity, rests[i]) for i in items]
        for i, f in enumerate(fulls):
            for part in range(f):
                rows.append((base + n, keys[i], part, part * capacity, capacity))
                n += 1
        return pd.DataFrame(rows, columns=["container_id", key, "part", "first_token", "n_tokens"])

    schema = f"container_id long, `{key}` long, part int, first_token long, n_tokens long"
    packed = dealt.where("n_tokens > 0").groupBy("cell").applyInPandas(pack, schema)
    none = dealt.where("n_tokens = 0").select(F.lit(None).cast("long").alias("container_id"), key, F.lit(0).alias("part"), F.lit(0).cast("long").alias("first_token"), "n_tokens")
    return packed.unionByName(none)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of space left unused."""
    used = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    total = used.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.max("n").alias("fullest"))
    return total.withColumn("unused_share", F.when(F.col("n_containers") > 0, 1 - F.col("n_tokens") / (F.col("n_containers") * capacity)))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = token_counts(texts(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", tokenizer_path())
    return pack_containers(sizes, "doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p8_containers(spark, folder))
