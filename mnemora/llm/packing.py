"""Operator 10: cost-balanced packing of documents into training sequences.

The cost of a piece is linear (per token) plus quadratic (attention within the piece). The documents a
task reads are packed in groups of a bounded token count, so no source or group of copies decides how
large a group gets and nothing is shuffled. Within a group, full-length pieces of long documents are sequences of their
own; the remaining pieces, in descending cost, go to the sequence of lowest cost that has room for
them. When none has, the piece is cut to fill the sequences with most room. The tokens left at the
end are cut into sequences of power-of-two length, which need no padding.

Null texts count as empty (the end id alone); repeated rows and null doc_ids are packed like others;
other columns are ignored; an empty table gives no sequence.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import per_slice
from mnemora.llm.tokens import SLICE, encoder, with_end

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for every piece of one group."""
    pieces = []
    sequence = 0
    tails = []
    for doc, n in enumerate(lengths.tolist()):
        full = n // capacity
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            tails.append((n % capacity, doc, full * capacity))
    # the bulk fills whole sequences; what is over goes into powers of two
    total = sum(t[0] for t in tails)
    bins = total // capacity
    sizes = [capacity] * bins + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if (total - bins * capacity) >> k & 1]
    room, costs = list(sizes), [0.0] * len(sizes)
    # pieces come in falling length: a sequence with room for one has room for the next until it is filled further
    roomy: list[tuple[float, int]] = []  # by cost: sequences with room for the current piece
    tight = sorted((-r, b) for b, r in enumerate(room))  # the others, most room first

    def place(doc: int, start: int, n: int, b: int, longest: int) -> None:
        pieces.append((doc, start, n, sequence + b, sizes[b] - room[b]))
        room[b] -= n
        costs[b] += cost(n)
        if room[b] >= longest:
            heapq.heappush(roomy, (costs[b], b))
        elif room[b]:
            heapq.heappush(tight, (-room[b], b))

    for n, doc, start in sorted(tails, key=lambda t: (-cost(t[0]), t[1])):
        while tight and -tight[0][0] >= n:
            b = heapq.heappop(tight)[1]
            heapq.heappush(roomy, (costs[b], b))
        if roomy:
            place(doc, start, n, heapq.heappop(roomy)[1], n)
            continue
        longest = n
        while n:  # no sequence has room for all of it: cut it over those with most room
            b = heapq.heappop(tight)[1]
            part = min(n, room[b])
            place(doc, start, part, b, longest)
            start, n = start + part, n - part
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece. A group is what one task has met when group_tokens are reached: the rows of a
    task come from many documents of any source, so no key decides how large a group gets."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def flush(group: list, first: int):
        doc_ids = np.concatenate([g[0] for g in group])
        null = np.concatenate([g[1] for g in group])
        ids = np.concatenate([g[2] for g in group])
        lengths = np.concatenate([g[3] for g in group])
        at = np.cumsum(lengths) - lengths
        raw = memoryview(ids.astype("<u4").tobytes())
        rows = np.array(pack(lengths, capacity), dtype=np.int64)
        d, start, size, sequence, offset = rows.T
        lo = (at[d] + start) * 4
        crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + size * 4).tolist(), strict=True)), dtype=np.int64, count=len(d))
        columns = [pa.array(doc_ids[d], mask=null[d]), start, size, crc, lengths[d], first + sequence, offset]
        yield pa.record_batch([pa.array(c) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), int(sequence.max()) + 1

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        group, held = [], 0
        for batch in batches:
            for i, j, data, offsets in per_slice(batch.column(1), SLICE):
                ids, bounds = with_end(*encoder(tokenizer).encode(data, offsets), end_id)
                keys = batch.column(0).slice(i, j - i)
                group.append((keys.fill_null(0).to_numpy(), np.asarray(keys.is_null()), ids, np.diff(bounds)))
                held += len(ids)
                if held >= group_tokens:
                    for out, n in flush(group, first):
                        first += n
                        yield out
                    group, held = [], 0
        if group:
            for out, _ in flush(group, first):
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
