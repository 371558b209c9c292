"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by minimum bin slack.

Per bin, subset-sum dynamic programming over a bit set of reachable sizes finds the fullest feasible combination of the
lengths still there, beside the longest of them; that combination is then removed, as often as the counts of its lengths
allow. The programme runs over the histogram of lengths, which has at most `capacity` entries whatever the corpus, so
it is solved on the driver; tokenising, ranking and placing the pieces are Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .tokens import default_vocabulary, encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start (the document's ids before it), length, ids (unsigned 32-bit
    little-endian). Only documents of more than `capacity` ids are cut. A null text counts as empty: its one id is the end id.
    Other columns of docs, whatever their names, are not read. Repeated rows give repeated pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = encoder(vocabulary)
        for batch in batches:
            for some in range(0, len(batch), 1000):
                part, rows = batch.iloc[some : some + 1000], []
                for doc_id, ids in zip(part["doc_id"], made.encode(part["text"].tolist())):
                    rows += [(doc_id, k, k * capacity, len(x), x.tobytes()) for k in range(-(-len(ids) // capacity)) if len(x := ids[k * capacity : (k + 1) * capacity])]
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


@dataclass
class Pattern:
    """`bins` bins that all hold the same lengths: {length: copies}."""

    bins: int
    lengths: dict[int, int]


def fill(room: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """The combination of lengths with the greatest sum up to room; lengths in falling order, left[x] copies of each."""
    reach, steps, full, mask = 1, [], 1 << room, (1 << (room + 1)) - 1
    for x in lengths:
        if x > room:
            continue
        copies, k = min(left[x], room // x), 1
        while copies > 0:  # binary splitting of the copies
            k = min(k, copies)
            grown = (reach | reach << (k * x)) & mask
            if grown != reach:
                steps.append((x, k, reach))
                reach = grown
            copies, k = copies - k, 2 * k
            if reach & full:
                break
        if reach & full:
            break
    total, used = reach.bit_length() - 1, {}
    for x, k, before in reversed(steps):
        if not before >> total & 1:
            used[x] = used.get(x, 0) + k
            total -= k * x
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every length of `counts` (length to number of pieces) exactly as often as it is there."""
    left = {x: n for x, n in counts.items() if n > 0}
    order, patterns = sorted(left, reverse=True), []
    while order:
        longest = order[0]
        left[longest] -= 1
        used = fill(capacity - longest, [x for x in order if left[x]], left)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(left[x] // k for x, k in used.items())
        patterns.append(Pattern(bins, used))
        for x, k in used.items():
            left[x] -= bins * k
        if any(not left[x] for x in used):
            order = [x for x in order if left[x]]
    return patterns


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes. Row i covers the pieces of length[i] with ranks from first[i] on."""
    rows, taken, bin_id = [], {}, 0
    for p in patterns:
        offset = 0
        for x in sorted(p.lengths, reverse=True):
            copies = p.lengths[x]
            first = taken.get(x, 0)
            rows.append((x, first, copies, bin_id, offset))
            taken[x] = first + p.bins * copies
            offset += x * copies
        bin_id += p.bins
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "copies", "bin", "offset"), cols))


@dataclass
class Packed:
    """pieces: a table of doc_id, piece, start, length, ids; placement: doc_id, piece, copy, sequence_id, offset.

    `copy` numbers repeated rows of a (doc_id, piece), so that the two join one to one."""

    pieces: DataFrame
    placement: DataFrame

    def sequences(self) -> DataFrame:
        """The packed sequences themselves: sequence_id, length, ids. A group holds one sequence, at most `capacity` ids."""
        rows = self.pieces.join(self.placement, ["key"])
        return (
            rows.groupBy("sequence_id")
            .agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
        )


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, salts: int = 64) -> Packed:
    """Packs every document; see Packed. salts: groups that the pieces of one length are ranked in, so that a length
    which a third of all rows share is not ranked by one task; raise it with the corpus (a group is rows / salts at most)."""
    pieces = materialize(
        cut_documents(docs, vocabulary or default_vocabulary(), capacity).withColumn("key", F.monotonically_increasing_id()), "pieces"
    )
    narrow = pieces.select("key", "length", F.pmod(F.xxhash64("doc_id", "piece", "key"), F.lit(salts)).cast("int").alias("salt"))
    found = narrow.groupBy("length", "salt").agg(F.count("*").alias("n"))
    groups = [(r["length"], r["salt"], r["n"]) for r in found.collect()]  # at most capacity * salts rows
    counts: dict[int, int] = {}
    before = np.zeros((capacity + 1, salts), np.int64)
    for length, salt, n in sorted(groups):
        before[length, salt] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    plan = slots(minimum_bin_slack(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast((before, plan))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, p = shared.value
        start = p["length"] << 44 | p["first"]
        for b in batches:
            length = b["length"].to_numpy(np.int64)
            rank = base[length, b["salt"].to_numpy(np.int64)] + b["nth"].to_numpy(np.int64)
            at = np.searchsorted(start, length << 44 | rank, side="right") - 1
            turn = rank - p["first"][at]
            yield pd.DataFrame({"key": b["key"], "sequence_id": p["bin"][at] + turn // p["copies"][at], "offset": p["offset"][at] + turn % p["copies"][at] * length})

    ranked = narrow.withColumn("nth", F.row_number().over(W.partitionBy("length", "salt").orderBy("key")) - 1)
    placement = ranked.mapInPandas(place, "key long, sequence_id long, offset long")
    return Packed(pieces, placement)


def placed(packed: Packed) -> DataFrame:
    """One row per piece, with the crc32 of its ids instead of the ids."""
    digests = packed.pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(packed.placement, "key").drop("key")
