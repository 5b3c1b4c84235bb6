"""Best-fit packing of token pieces into sequences under several capacities at once.

Documents become ids of a public vocabulary plus one end id. A document longer than a sequence is cut: its first piece takes
the remainder, the others are full. Every piece asks for tokens, one document slot and attention cost: the square of its length
in whole attention blocks. Pieces are dealt by hash to groups of bounded size; within a group they are placed longest first into
the open bin that leaves the least weighted residual norm (or has the largest weighted dot product) among the bins that hold all
three demands. The cost of a full piece is the cost capacity, so that many short documents reach it, or the slots, before the
tokens are full.

Defined results: null text counts as empty and gives one piece with the end id only; repeated rows are packed as often as they
come; a null doc_id stays null; texts of any length are cut, none is dropped; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .tokens import ByteBpe, added_tokens, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Documents of one packing group: enough for a tight fit, bounded for one task.
GROUP_DOCS = 16_384
#: Tokens of one attention block; documents of one sequence; what the residuals of tokens, slots and cost weigh.
BLOCK, SLOTS, WEIGHTS = 64, 128, (1.0, 0.05, 0.05)


def pieces(docs: DataFrame, vocabulary: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """Cut every document's ids into pieces of at most `limit` tokens. Added tokens are those of the library's file of the same
    name (*.json), where there is one."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def start():
        beside = Path(vocabulary).with_suffix(".json")
        bpe = ByteBpe(vocabulary, added_tokens(str(beside)) if beside.exists() else None)

        def work(columns):
            for doc_id, text in zip(*columns, strict=True):
                ids = bpe.ids(text or "") + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % limit or limit if at == 0 else limit
                    yield doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])
                    at, k = at + length, k + 1

        return work

    return map_rows(docs, ["doc_id", "text"], PIECES, start)


def place(lengths: np.ndarray, tokens: int, slots: int, cost: float, weights: tuple[float, float, float], rule: str, block: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; lengths come longest first. Open bins are rows of residual vectors."""
    price = lambda n: float((-(-n // block) * block) ** 2)
    caps = np.array([tokens, slots, cost], dtype=float)
    w = np.array(weights, dtype=float)
    room = np.empty((1024, 3))
    name = np.empty(1024, dtype=np.int64)
    n_open = n_bins = 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, price(length)], dtype=float)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        left = room[:n_open] - need
        fits = left.min(axis=1) >= 0 if n_open else np.zeros(0, bool)
        if fits.any():
            score = (w * (left / caps) ** 2).sum(axis=1) if rule == "norm" else -(w * (need / caps) * (room[:n_open] / caps)).sum(axis=1)
            j = int(np.argmin(np.where(fits, score, np.inf)))
        else:
            j, n_open = n_open, n_open + 1
            if n_open > len(room):
                room, name = np.concatenate([room, np.empty_like(room)]), np.concatenate([name, np.empty_like(name)])
            room[j], name[j] = caps, n_bins
            n_bins += 1
        bins[i], offsets[i] = name[j], tokens - room[j, 0]
        room[j] -= need
        if room[j, 0] < least or room[j, 1] < 1 or room[j, 2] < price(least):  # closed: nothing fits any more
            n_open -= 1
            room[j], name[j] = room[n_open], name[n_open]
    return bins, offsets


def pack(
    parts: DataFrame, groups: int, limit: int = 1024, slots: int = SLOTS, cost: float | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", block: int = BLOCK
) -> DataFrame:
    """Give every piece a sequence and an offset in it. slots: documents of a sequence; cost: sum of squared lengths in whole
    blocks, by default what one full piece costs."""
    cost = float((-(-limit // block) * block) ** 2) if cost is None else cost
    names = [x.split()[0] for x in PLACED.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        bins, offsets = place(pdf["length"].to_numpy(), limit, slots, cost, weights, rule, block)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[names]

    dealt = parts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(17)), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(run, PLACED)


def best_fit(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, **options) -> DataFrame:
    """Documents to packed pieces. The number of groups follows the number of documents."""
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    return pack(pieces(docs, vocabulary or vocabulary_path("byte_bpe_50k.tiktoken"), limit), groups, limit, **options)
