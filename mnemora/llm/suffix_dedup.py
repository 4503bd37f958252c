"""Operator 8: removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a smaller document, or
earlier in the same one); the first copy stays. Strings lie within one document.

Equal windows of LENGTH bytes have equal anchors (the Q-gram of least hash in the window), so windows
meet by anchor. Consecutive windows with one anchor form a run.

1. Runs are dealt by anchor. Equal runs are counted once: of each text of a run (told apart by a 64-bit
   fingerprint) the first one stays in question, the others go at once. Each task combines its own runs
   first, so a run that is very common is one row per task. A text whose anchor no other text has is out.
2. The bytes of the runs in question meet by anchor. There the windows' suffixes are put in order by
   prefix doubling, with the longest common prefix of neighbours; in suffix order, the previous and the
   next smaller position give the longest previous factor of every window (all capped at LENGTH), and a
   factor of LENGTH bytes marks the window as a later copy.
3. An anchor with very many different runs (more than `spread` in a task, or MOST in all) would be too
   large a group: its windows are dealt singly, each by a fingerprint of its LENGTH bytes, the task's first
   one only; in a group of equal windows the previous smaller position is the first one.

Null texts count as empty, a null doc_id as the smallest; repeated rows (same doc_id and text) are the
same document and get the same result each, other rows of one doc_id are ordered by a hash of the
text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import ODD, U64, Work, eights, mix, on_batches, per_slice, ragged, signed, with_uid

LENGTH = 100
Q = 32
SPREAD, MOST = 64, 10_000
FLUSH = 1_500_000
CHUNK = 2 << 20
REMOVED, ASKED, SPREAD_RUN, SPREAD_MARK = 0, 1, 2, 3


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive keys, from block-wise running minima."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(U64).max, dtype=U64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def window_hash(data: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all `length` consecutive bytes, from halves of 8, 16, ... bytes that are mixed in turn."""
    n = len(data) - length + 1
    size, h = 8, mix(eights(data)[: len(data) - 7] * ODD)
    while 2 * size <= length:
        h = mix((h[:-size] * ODD) ^ h[size:])
        size *= 2
    return mix((h[:n] * ODD) ^ h[length - size :]) if size < length else h


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, q: int = Q):
    """(anchor, text, document, start, windows) of every run of windows with one anchor."""
    empty = np.zeros(0, dtype=np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return empty.view(U64), empty.view(U64), empty, empty, empty
    grams = window_hash(data, q)
    place = np.arange(len(grams), dtype=U64)
    keys = (grams & ~U64(0xFFFFFFFF)) | place
    anchor = (window_minima(keys, length - q + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets), 0))[:n]
    good = np.arange(n) + length <= offsets[1:][doc]
    start = good.copy()
    start[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(start)
    stop = good.copy()
    stop[:-1] &= ~good[1:] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    last = np.flatnonzero(stop)
    at = anchor[first]
    # a run has at most `length` windows, so its first and last one cover its bytes
    whole = window_hash(data, length)
    text = mix(whole[first] + mix(whole[last] + (last - first).astype(U64) * ODD) + (at - first).astype(U64))
    return grams[at], text, doc[first], first - offsets[:-1][doc[first]], last - first + 1


def _rows(schema_names, *columns, step=50_000):
    for lo in range(0, len(columns[0]), step):
        yield pa.record_batch([pa.array(c[lo : lo + step]) for c in columns], names=schema_names)


RUN_NAMES = ["kind", "anchor", "text_hash", "uid", "start", "windows"]
RUN_SCHEMA = "kind int, anchor long, text_hash long, uid long, start long, windows int"


def _run_rows(kind: int, anchor, text, uid, start, windows):
    return _rows(RUN_NAMES, np.full(len(uid), kind, np.int32), signed(anchor), signed(text), uid, start, windows.astype(np.int32))


def all_runs(rows: DataFrame, length: int, q: int, spread: int) -> DataFrame:
    """The runs of all texts, combined per task."""

    def run(batches):
        held, size = [], 0

        def flush():
            anchor, text, uid, start, windows = (np.concatenate([h[k] for h in held]) for k in range(5))
            order = np.lexsort((start, uid, text, anchor))
            anchor, text, uid, start, windows = anchor[order], text[order], uid[order], start[order], windows[order]
            fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
            gone = ~fresh & ~np.concatenate(([False], (uid[1:] == uid[:-1]) & (start[1:] == start[:-1])))
            # removals keep clear of the anchors: they are dealt by their own places
            yield from _run_rows(REMOVED, mix(uid[gone].view(U64) + start[gone].view(U64)), text[gone], uid[gone], start[gone], windows[gone])
            anchor, text, uid, start, windows = anchor[fresh], text[fresh], uid[fresh], start[fresh], windows[fresh]
            edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            count = np.diff(np.append(edge, len(anchor)))
            wide = np.repeat(count > spread, count)
            yield from _run_rows(ASKED, *(c[~wide] for c in (anchor, text, uid, start, windows)))
            yield from _run_rows(SPREAD_RUN, mix(uid[wide].view(U64) + start[wide].view(U64)), *(c[wide] for c in (text, uid, start, windows)))
            mark = edge[count > spread]
            yield from _run_rows(SPREAD_MARK, anchor[mark], text[mark], *(np.zeros(len(mark), np.int64) for _ in range(3)))

        for batch in batches:
            for i, j, data, offsets in per_slice(batch.column(1)):
                anchor, text, doc, start, windows = runs(data, offsets, length, q)
                if len(doc):
                    held.append((anchor, text, batch.column(0).slice(i, j - i).to_numpy()[doc], start, windows))
                    size += len(doc)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return rows.select("uid", "text").mapInArrow(run, RUN_SCHEMA)


def sort_runs_out(dealt: DataFrame, most: int = MOST) -> DataFrame:
    """Streams the runs of a partition in order of anchor and text: the first of each text of an anchor that has
    several is asked on, others go. Of the anchor at hand only the first ones are held, `most` at most."""

    def run(batches):
        anchor, text, place = None, None, (0, 0)  # of the row before: anchor, text, and the place of that text's first run
        marked, held = False, None  # whether that anchor is spread; its first runs so far

        def told(kind, firsts):
            if len(firsts[0]):
                yield from _run_rows(kind, *firsts)

        def ended(firsts):
            """The first runs of whole anchors."""
            edge = np.flatnonzero(np.concatenate(([True], firsts[0][1:] != firsts[0][:-1])))
            count = np.repeat(np.diff(np.append(edge, len(firsts[0]))), np.diff(np.append(edge, len(firsts[0]))))
            yield from told(SPREAD_RUN, [c[count > most] for c in firsts])
            yield from told(ASKED, [c[(count > 1) & (count <= most)] for c in firsts])

        for batch in batches:
            kind, a, t, u, s, w = (batch.column(k).to_numpy() for k in range(6))
            own = (kind == REMOVED) | (kind == SPREAD_RUN)
            if own.any():
                yield batch.filter(pa.array(own))
            a, t, u, s, w, mark = (c[~own] for c in (a, t, u, s, w, kind == SPREAD_MARK))
            if not len(a):
                continue
            spread = np.unique(a[mark])
            if marked:
                spread = np.union1d(spread, [anchor])
            last = a[-1]
            a, t, u, s, w = (c[~mark] for c in (a, t, u, s, w))
            if len(a):
                new = np.ones(len(a), dtype=bool)
                new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
                new[0] = anchor is None or a[0] != anchor or text is None or t[0] != text
                first = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
                before = first < 0
                gone = ~new & ((u != np.where(before, place[0], u[first])) | (s != np.where(before, place[1], s[first])))
                if gone.any():
                    yield from _run_rows(REMOVED, *(c[gone] for c in (a, t, u, s, w)))
                if first[-1] >= 0:
                    place = (u[first[-1]], s[first[-1]])
                text = t[-1] if a[-1] == last else None
            else:
                new = np.zeros(0, dtype=bool)
                text = text if last == anchor else None
            firsts = [c[new] for c in (a, t, u, s, w)]
            wide = np.isin(firsts[0], spread)
            yield from told(SPREAD_RUN, [c[wide] for c in firsts])
            firsts = [c[~wide] for c in firsts]
            if held is not None:
                firsts = [np.concatenate(c) for c in zip(held, firsts, strict=True)]
            open_ = firsts[0] == last
            if not open_.all():
                yield from ended([c[~open_] for c in firsts])
            held = [c[open_] for c in firsts]
            anchor, marked = last, bool(np.isin(last, spread))
            if not marked and len(held[0]) > most:
                marked = True
                yield from told(SPREAD_RUN, held)
                held = None
        if held is not None and len(held[0]):
            yield from ended(held)

    order = ["anchor", F.desc("kind"), "text_hash", "uid", "start"]
    return dealt.repartition("anchor").sortWithinPartitions(*order).mapInArrow(run, RUN_SCHEMA)


# --- suffix order --------------------------------------------------------------------------------


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(U64)


def suffix_order(data: np.ndarray, at: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes that begin at `at`, by their first `length` bytes and then by position. lcp is the
    longest common prefix with the suffix before in that order, `length` at most. Suffixes have `length` bytes at least.

    Prefix doubling: ranks of 8 bytes from all places give ranks of 16, and so on.
    """
    there = eights(data)
    ranks = [(8, _dense(there.byteswap()))]
    while 2 * ranks[-1][0] <= length:
        size, r = ranks[-1]
        beyond = np.zeros(len(r), dtype=U64)
        beyond[:-size] = r[size:] + U64(1)
        ranks.append((2 * size, _dense((r << U64(32)) | beyond)))
    size, r = ranks[-1]
    order = np.lexsort((position, (r[at] << U64(32)) | r[at + length - size]))
    i, j = at[order[:-1]], at[order[1:]]
    same = np.zeros(len(i), dtype=np.int64)
    end = len(data)
    for size, r in reversed(ranks):
        while True:
            near = r[np.minimum(i + same, end)] == r[np.minimum(j + same, end)]
            near &= same + size <= length
            same += size * near
            if 2 * size <= ranks[-1][0] or not near.any():
                break
    differ = there[np.minimum(i + same, end)] ^ there[np.minimum(j + same, end)]
    for k in range(1, 9):
        same += (differ & U64((1 << 8 * k) - 1)) == 0
    lcp = np.zeros(len(at), dtype=np.int64)
    lcp[1:] = np.minimum(same, length)
    return order, lcp


def _smaller_before(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest common prefix with the nearest place before, in suffix order, of smaller position; 0 where there is none.
    Places that lie between have larger positions, so a place may jump to where its candidate has got to."""
    near, reach = np.arange(-1, len(position) - 1), lcp.copy()
    todo = np.flatnonzero((near >= 0) & (reach > 0))
    todo = todo[position[near[todo]] > position[todo]]
    while len(todo):
        c = near[todo]
        reach[todo] = np.minimum(reach[todo], np.where(near[c] >= 0, reach[c], 0))
        near[todo] = near[c]
        on = (near[todo] >= 0) & (reach[todo] > 0)
        todo = todo[on]
        todo = todo[position[near[todo]] > position[todo]]
    reach[near < 0] = 0
    return reach


def longest_previous_factors(data: np.ndarray, at: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Of each suffix that begins at `at`, the longest prefix (`length` at most) that one of smaller position has too.
    In suffix order it is shared with the previous or the next one of smaller position."""
    order, lcp = suffix_order(data, at, position, length)
    place = position[order]
    following = np.append(lcp[1:], 0)[::-1]
    found = np.maximum(_smaller_before(place, lcp), _smaller_before(place[::-1], following)[::-1])
    out = np.empty(len(at), dtype=np.int64)
    out[order] = found
    return out


def later_copies(data: np.ndarray, bounds: np.ndarray, uid: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(uid, place) of the windows of the pieces data[bounds[k]:bounds[k+1]] whose longest previous factor is whole."""
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    piece = np.repeat(np.arange(len(count)), count)
    at = ragged(bounds[:-1], count)
    u, p = uid[piece], start[piece] + at - bounds[:-1][piece]
    order = np.lexsort((p, u))
    u, p, at = u[order], p[order], at[order]
    # a repeated row brings its windows again: the same place is no earlier one
    new = np.ones(len(u), dtype=bool)
    new[1:] = (u[1:] != u[:-1]) | (p[1:] != p[:-1])
    u, p, at = u[new], p[new], at[new]
    late = longest_previous_factors(data, at, np.arange(len(at)), length) >= length
    return u[late], p[late]


def _as_runs(uid: np.ndarray, position: np.ndarray):
    """Merges single windows into (uid, start, windows)."""
    order = np.lexsort((position, uid))
    uid, position = uid[order], position[order]
    if not len(uid):
        return uid, position, position
    keep = np.concatenate(([True], (uid[1:] != uid[:-1]) | (position[1:] != position[:-1])))
    uid, position = uid[keep], position[keep]
    edge = np.flatnonzero(np.concatenate(([True], (uid[1:] != uid[:-1]) | (position[1:] != position[:-1] + 1))))
    return uid[edge], position[edge], np.diff(np.append(edge, len(uid)))


def run_texts(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs in question; of the spread ones single windows by fingerprint."""
    per_doc = asked.groupBy("uid").agg(F.collect_set(F.struct("kind", "anchor", "start", "windows")).alias("runs"))
    joined = rows.select("uid", "text").join(per_doc, "uid")
    names = ["anchor", "uid", "start", "windows", "piece"]

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in per_slice(batch.column("text")):
                part = batch.column("runs").slice(i, j - i)
                doc = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                kind, anchor, start, windows = (c.to_numpy() for c in part.flatten().flatten())
                uid = batch.column("uid").slice(i, j - i).to_numpy()[doc]
                lo = offsets[:-1][doc] + start
                plain = np.flatnonzero(kind == ASKED)
                raw = data.tobytes()
                for s in range(0, len(plain), 20_000):
                    k = plain[s : s + 20_000]
                    pieces = [raw[a:b] for a, b in zip(lo[k].tolist(), (lo[k] + windows[k] + length - 1).tolist(), strict=True)]
                    yield pa.record_batch([pa.array(anchor[k]), pa.array(uid[k]), pa.array(start[k]), pa.array(windows[k]), pa.array(pieces, type=pa.binary())], names=names)
                spread = np.flatnonzero(kind == SPREAD_RUN)
                if len(spread):
                    n = windows[spread].astype(np.int64)
                    at = ragged(lo[spread], n)
                    factor = window_hash(data, length)[at]
                    owner = np.repeat(uid[spread], n)
                    position = ragged(start[spread], n)
                    order = np.lexsort((position, owner, factor))
                    factor, owner, position = factor[order], owner[order], position[order]
                    fresh = np.concatenate(([True], factor[1:] != factor[:-1]))
                    twin = np.concatenate(([False], (owner[1:] == owner[:-1]) & (position[1:] == position[:-1])))
                    gone = ~fresh & ~twin
                    none = pa.nulls(0, pa.binary())
                    u, p, w = _as_runs(owner[gone], position[gone])
                    for key, a, b, c in ((None, u, p, w), (signed(factor[fresh]), owner[fresh], position[fresh], np.zeros(int(fresh.sum()), np.int64))):
                        if len(a):
                            keys = pa.array(signed(mix(a.view(U64) + b.view(U64)))) if key is None else pa.array(key)
                            yield pa.record_batch([keys, pa.array(a), pa.array(b), pa.array(c.astype(np.int32)), pa.concat_arrays([none, pa.nulls(len(a), pa.binary())])], names=names)

    return joined.mapInArrow(run, "anchor long, uid long, start long, windows int, piece binary")


def removed_windows(pieces: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """(uid, start, windows) of the windows with an earlier factor.

    Rows with a piece are runs in question; without one they are single windows, dealt by fingerprint
    (windows = 0), or removals that a task has found by itself. Whole anchors are solved together, about `chunk`
    bytes at a time; an anchor has at most MOST pieces of less than twice `length` bytes.
    """
    names = ["uid", "start", "windows"]

    def told(uid, start, windows):
        if len(uid):
            yield pa.record_batch([pa.array(uid), pa.array(start), pa.array(windows.astype(np.int32))], names=names)

    def run(batches):
        single = None  # fingerprint of the single window before, and the place of the first of its kind
        held, size = [], 0  # of pieces: (anchor, uid, start, lengths, bytes)

        def solved(parts):
            uid, start, n = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
            data = np.concatenate([p[4] for p in parts])
            yield from told(*_as_runs(*later_copies(data, np.concatenate(([0], np.cumsum(n))), uid, start, length)))

        for batch in batches:
            a, u, s, w = (batch.column(k).to_numpy() for k in range(4))
            whole = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            done = ~whole & (w > 0)
            yield from told(u[done], s[done], w[done])
            alone = ~whole & (w == 0)
            if alone.any():
                f, su, ss = a[alone], u[alone], s[alone]
                new = np.ones(len(f), dtype=bool)
                new[1:] = f[1:] != f[:-1]
                new[0] = single is None or single[0] != f[0]
                first = np.maximum.accumulate(np.where(new, np.arange(len(f)), -1))
                fu, fs = ((np.where(first < 0, single[k] if single else 0, c[first])) for k, c in ((1, su), (2, ss)))
                late = ~new & ((su != fu) | (ss != fs))
                single = (f[-1], fu[-1], fs[-1])
                yield from told(su[late], ss[late], np.ones(int(late.sum()), np.int32))
            if whole.any():
                raw = batch.column(4).filter(pa.array(whole))
                n = pc.binary_length(raw).to_numpy().astype(np.int64)
                held.append((a[whole], u[whole], s[whole], n, np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)))
                size += len(held[-1][4])
                if size >= chunk:
                    # the last anchor may go on in the next batch
                    whole_of = [np.concatenate([h[k] for h in held]) for k in range(5)]
                    cut = int(np.searchsorted(whole_of[0], whole_of[0][-1], side="left"))
                    edge = int(whole_of[3][:cut].sum())
                    if cut:
                        yield from solved([[*(c[:cut] for c in whole_of[:4]), whole_of[4][:edge]]])
                    held = [[*(c[cut:] for c in whole_of[:4]), whole_of[4][edge:]]]
                    size = len(held[0][4])
        if held:
            yield from solved(held)

    return pieces.repartition("anchor").sortWithinPartitions("anchor", "uid", "start").mapInArrow(run, "uid long, start long, windows int")


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, spread: int = SPREAD, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes for every row."""
    with Work(docs.sparkSession, "suffix-dedup") as work:
        rows = with_uid(docs, work, keep=True)
        sorted_out = work.save(sort_runs_out(all_runs(rows, length, q, spread), most), "runs")
        asked = sorted_out.where(F.col("kind").isin(ASKED, SPREAD_RUN))
        late = removed_windows(run_texts(rows, asked, length), length)
        gone = sorted_out.where(F.col("kind") == REMOVED).select("uid", "start", "windows").union(late)
        gone = work.keep(gone.groupBy("uid").agg(F.collect_list(F.struct("start", "windows")).alias("gone")), "gone")
    joined = rows.join(gone, "uid", "left")

    def kernel(batch):
        for i, j, data, offsets in per_slice(batch.column(1)):
            part = batch.column(2).slice(i, j - i)
            n = part.value_lengths().fill_null(0).to_numpy()
            doc = np.repeat(np.arange(j - i), n)
            start, windows = (c.to_numpy() for c in part.flatten().flatten())
            change = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(change, offsets[:-1][doc] + start, 1)
            np.add.at(change, offsets[:-1][doc] + start + windows + length - 1, -1)
            cover = np.cumsum(change[:-1]) > 0
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[offsets] = True
            begins = cover & np.concatenate(([True], ~cover[:-1]))[: len(cover)] if len(cover) else cover
            begins = begins | (cover & edge[:-1])
            removed, spans = (np.concatenate(([0], np.cumsum(x)))[offsets] for x in (cover, begins))
            raw, keep = data, ~cover
            kept = [raw[a:b][keep[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, type=pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return on_batches(joined.select("doc_id", "text", "gone"), ["doc_id", "text", "gone"], kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
