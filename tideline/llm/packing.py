"""Best-fit packing: minimum bin slack over the histogram of lengths, placed by distributed ranks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.byte_bpe import encoder
from tideline.llm.common import stored, text_of

SIZE = 2048
CELL_ROWS = 1000

Bin = tuple[int, list[tuple[int, int]]]


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """The largest length left, and the copies of others that with it fill a bin the most.

    Subset sums are bits of one integer; a length with many copies is added in powers of two.
    Longer lengths come first, so of equally full choices one with long pieces is found.
    """
    first = max(counts)
    room = size - first
    mask, reach, steps = (2 << room) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        spare, take = min(counts[length] - (length == first), room // length), 1
        while spare > 0:
            take = min(take, spare)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            spare, take = spare - take, take * 2
        if reach >> room & 1:
            break
    chosen, total = {first: 1}, reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], size: int) -> list[Bin]:
    """Bins as (how many alike, [(length, copies), ...]); each found combination is removed
    as often as the counts allow, so the work depends on the number of lengths, not of pieces."""
    left = {length: n for length, n in counts.items() if n > 0}
    bins: list[Bin] = []
    while left:
        chosen = fullest(left, size)
        times = min(left[length] // copies for length, copies in chosen.items())
        bins.append((times, sorted(chosen.items(), reverse=True)))
        for length, copies in chosen.items():
            left[length] -= times * copies
            if not left[length]:
                del left[length]
    return bins


def places(bins: list[Bin]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which bins: sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, content in bins:
        offset = 0
        for length, copies in content:
            start = used.get(length, 0)
            used[length] = start + times * copies
            rows.append((length, start, copies, base, offset))
            offset += length * copies
        base += times
    rows.sort()
    names = ("length", "rank", "copies", "sequence", "offset")
    return dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, 5).T))


def place_of(where: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The row of ``where`` for each (length, rank), for lengths and ranks of any size.

    Ranks of one length are contiguous in ``where``, so a row's number is found by its length's
    first row and a search among that length's ranks; the two keys stay two columns.
    """
    at = np.empty(len(length), dtype=np.int64)
    for value in np.unique(length):
        first, end = np.searchsorted(where["length"], (value, value + 1))
        mine = length == value
        at[mine] = first + np.searchsorted(where["rank"][first:end], rank[mine], side="right") - 1
    return at


def pack(pieces: DataFrame, size: int = SIZE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``pieces`` (a column ``length`` from 1 to ``size``, any others) with ``sequence_id`` and
    ``offset``: as few sequences as minimum bin slack finds, gapless from 0.

    Only the histogram, at most ``size`` rows, reaches the driver. A piece's place follows from
    its rank among pieces of its length. Ranks are counted in cells of about ``cell_rows`` rows
    by a hash of a stored row number, so that a length a third of all pieces have is split; the
    cells' counts are then summed up. Rows without a length take no part. Repeated rows are
    separate pieces. No rows: none. Columns sequence_id and offset of the input are replaced;
    the names that begin with ``_pack_`` are reserved.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    kept = stored(
        pieces.select(*own).filter(F.col("length").isNotNull()).withColumn("_pack_row", F.monotonically_increasing_id()),
        "pieces",
    )
    counts = {r[0]: r[1] for r in kept.groupBy("length").count().collect()}
    if any(not 1 <= length <= size for length in counts):
        raise ValueError(f"lengths must be from 1 to {size}")
    full = counts.pop(size, 0)
    bins = minimum_bin_slack(counts, size)
    where = places(bins)
    n_bins = sum(times for times, _ in bins)

    spark = pieces.sparkSession
    cells = [(length, -(-n // cell_rows)) for length, n in counts.items()]
    # At most ``size`` rows.
    split = F.broadcast(spark.createDataFrame(cells, "length long, _pack_cells long"))
    rows = kept.filter(F.col("length") < size).join(split, "length")
    rows = rows.withColumn("_pack_cell", F.pmod(F.xxhash64("_pack_row"), F.col("_pack_cells"))).drop("_pack_cells")
    sums = rows.groupBy("length", "_pack_cell").count().withColumn(
        "_pack_before",
        F.sum("count").over(Window.partitionBy("length").orderBy("_pack_cell")) - F.col("count"),
    )
    in_cell = F.row_number().over(Window.partitionBy("length", "_pack_cell").orderBy("_pack_row"))
    ranked = (
        rows.withColumn("_pack_rank", in_cell - 1)
        .join(sums.drop("count"), ["length", "_pack_cell"])
        .withColumn("_pack_rank", F.col("_pack_rank") + F.col("_pack_before"))
        .drop("_pack_cell", "_pack_before", "_pack_row")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(own).schema)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["_pack_rank"].to_numpy(np.int64)
            at = place_of(where, batch["length"].to_numpy(np.int64), rank)
            nth = rank - where["rank"][at]
            copies = where["copies"][at]
            batch["sequence_id"] = where["sequence"][at] + nth // copies
            batch["offset"] = where["offset"][at] + nth % copies * where["length"][at]
            yield batch.drop(columns="_pack_rank")

    placed = ranked.select(*own, "_pack_rank").mapInPandas(place, f"{schema}, sequence_id long, offset long")
    alone = kept.filter(F.col("length") == size).select(
        *own, (F.col("_pack_row") + n_bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(alone) if full else placed


def token_pieces(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """The documents' ids with ``end_id`` after each, in pieces of at most ``size``.

    Columns doc_id, piece, start, length, ids_crc32, and ids if ``keep_ids``. Only documents
    longer than ``size`` are cut; their first piece is the shorter one. A null text is empty,
    an empty one is the end id alone. Null and repeated doc_ids are kept as they are.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], encode(batch["text"].tolist())):
                ids = np.append(ids, np.uint32(end_id))
                start, end = 0, len(ids) % size or size if len(ids) > size else len(ids)
                for piece in range(-(-len(ids) // size)):
                    part = ids[start:end]
                    out.append((doc_id, piece, start, end - start, zlib.crc32(part.tobytes())) + ((part.astype(np.int32),) if keep_ids else ()))
                    start, end = end, end + size
            columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(cut, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """``token_pieces`` of the documents, packed."""
    return pack(token_pieces(docs, tokenizer, size, end_id, keep_ids), size)
