"""Repeated byte strings: sorted suffix runs, exchanged front-coded, merged by loser trees.

Which bytes go: those inside a 100-byte string that also starts earlier.

1. Anchors. Of the 32-byte pieces inside a 100-byte window the one with the least
   hash (leftmost on ties) is the window's anchor. Equal windows have equal anchors
   at equal offsets, so windows can be compared anchor by anchor. Anchors are dealt
   by hash; one that stands alone is dropped, and with it all its windows.
2. Suffix runs. The texts of the others are cut: from an anchor up to 100 bytes to
   the right (the suffix) and what lies to the left. A task sorts its suffixes,
   marks those that repeat another one of the task in full, and writes the rest as
   front-coded runs: length of the prefix shared with the run's previous suffix,
   and the remaining bytes.
3. Merge. Runs of one range of anchors meet in a task. A loser tree merges them:
   of two suffixes the one that shares more with the last output is smaller, and
   only equal lengths are compared, from there on, so known prefixes are never
   read again. It yields the common prefix of neighbours.
4. From the common prefixes of the suffixes, and those of the left sides read
   backwards, windows fall into classes by comparing numbers only. All but the
   first window of a class are repeats.

Tasks of step 3 hold about RECORDS_PER_BUCKET suffixes; copies inside a task of
step 2 are met there, so a passage that a third of all texts hold brings one
suffix per task.

Defined results: a null text has no bytes; of rows with one ``doc_id`` but
different texts the smaller text hash counts as earlier; rows alike in both are
one text and get the same answer; a null ``doc_id`` comes last; other columns are
not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import written

LENGTH, PIECE = 100, 32
REACH = LENGTH - PIECE + 1  # pieces in a window
PLACE_BITS = 24
CHUNK = 1 << 22  # windows that are cut at once
RECORDS_PER_BUCKET = 60_000
KEY = ["doc", "text_hash"]
SPANS = "doc bigint, text_hash bigint, lo bigint, hi bigint"
BLOCK = ("bucket bigint, keys binary, lcp binary, rest_len binary, rest binary, left_len binary, left binary, "
         "doc binary, text_hash binary, anchor binary, n binary")
NO_DOC = 2**63 - 1


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_DOC)).alias("doc"),
                       F.xxhash64(text).alias("text_hash"), text.alias("text"))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each 32-byte piece along the last axis, by doubling the length five times."""
    h, factor = data.astype(np.uint64) + np.uint64(1), 0x100000001B3
    with np.errstate(over="ignore"):
        for k in range(5):
            h = h[..., :-(1 << k)] * np.uint64(factor) + h[..., 1 << k:]
            factor = factor * factor % (1 << 64)
    return mixed(h)


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, anchor, start, n) of the runs of windows with one anchor."""
    out = []
    for lo in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        part = data[lo:lo + CHUNK + LENGTH - 1]
        h = piece_hashes(part)
        least = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if REACH > width:
            least = np.minimum(least[:-(REACH - width)], least[REACH - width:])
        anchor = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        n = np.diff(np.r_[start, len(anchor)])
        out.append((h[anchor[start]].view(np.int64), anchor[start] + lo, start + lo, n))
    if not out:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(rows: DataFrame) -> DataFrame:
    """(key, doc, text_hash, place): place packs start, number of windows, and the anchor's offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            parts = []
            for i, text in enumerate(batch.column(2)):
                key, anchor, start, n = window_anchors(np.frombuffer(as_bytes(text.as_py()), np.uint8))
                parts.append((np.full(len(key), i), key, start << 14 | n << 7 | (anchor - start)))
            if parts:
                row, key, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.record_batch([pa.array(key), pa.array(docs[row]), pa.array(hashes[row]), pa.array(place)],
                                      names=["key", *KEY, "place"])

    return rows.mapInArrow(run, "key bigint, doc bigint, text_hash bigint, place bigint")


def shared(found: DataFrame) -> DataFrame:
    """The anchors that do not stand alone."""
    order = Window.partitionBy("key").orderBy(*KEY, "place")
    beside = F.lead("place").over(order).isNotNull() | F.lag("place").over(order).isNotNull()
    return found.withColumn("beside", beside).filter("beside").drop("beside")


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree in their first ``known`` bytes."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    lo, hi = known, end
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def front_code(suffixes: list[bytes]) -> list[int]:
    return [0, *[common(a, b, 0) for a, b in zip(suffixes, suffixes[1:], strict=False)]] if suffixes else []


def merge(runs: list[list[bytes]], lcps: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Places (run, index) of all suffixes in order, and the common prefix of each with the one before."""
    size = 1
    while size < len(runs):
        size *= 2
    at, held = [0] * size, [0] * size  # held: what a run's head shares with the last output
    head = [r[0] if r else None for r in runs] + [None] * (size - len(runs))

    def wins(i: int, j: int) -> bool:
        """Whether run i's head comes first; the loser then knows what it shares with the winner."""
        a, b = head[i], head[j]
        if a is None or b is None:
            return b is None
        if held[i] != held[j]:
            return held[i] > held[j]
        n = common(a, b, held[i])
        first = a[n:n + 1] < b[n:n + 1] or (a[n:n + 1] == b[n:n + 1] and i < j)
        held[j if first else i] = n
        return first

    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        i, j = build(2 * node), build(2 * node + 1)
        won = wins(i, j)
        losers[node] = j if won else i
        return i if won else j

    top, order, shares = build(1), [], []
    while head[top] is not None:
        order.append((top, at[top]))
        shares.append(held[top])
        at[top] += 1
        if at[top] < len(runs[top]):
            head[top], held[top] = runs[top][at[top]], lcps[top][at[top]]
        else:
            head[top] = None
        node = (top + size) // 2
        while node:
            if not wins(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2
    return order, shares


def suffix_runs(rows: DataFrame, buckets: int) -> DataFrame:
    """Front-coded runs (BLOCK) of (doc, text_hash, text, places) rows; spans of full copies in rows without keys."""
    def cut(batch: pa.RecordBatch) -> list[tuple]:
        records = []
        columns = (batch.column(i).to_pylist() for i in range(4))
        for doc, text_hash, text, places in zip(*columns, strict=True):
            data = as_bytes(text)
            for place in sorted(set(places)):
                start, n, offset = place >> 14, place >> 7 & 127, place & 127
                anchor = start + offset
                records.append((data[anchor:start + n + LENGTH - 1], data[start:anchor], doc, text_hash, anchor, n))
        return records

    def pack(bucket: int, part: list[tuple]) -> tuple:
        suffixes = [r[0] for r in part]
        lcp = front_code(suffixes)
        rest = [s[k:] for s, k in zip(suffixes, lcp, strict=True)]
        number = lambda i: np.array([r[i] for r in part], np.int64).tobytes()
        return (bucket, b"1", np.array(lcp, np.int64).tobytes(), np.array([len(x) for x in rest], np.int64).tobytes(),
                b"".join(rest), np.array([len(r[1]) for r in part], np.int64).tobytes(), b"".join(r[1] for r in part),
                number(2), number(3), number(4), number(5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), *[pa.binary()] * 10]
        names = [x.split()[0] for x in BLOCK.split(", ")]
        held: list[tuple] = []

        def emit() -> Iterator[pa.RecordBatch]:
            held.sort()
            parts: dict[int, list[tuple]] = {}
            copies, kept, before = [], [], None
            for r in held:
                if before is not None and r[:2] == before[:2] and r[5] == before[5]:
                    if r[2:5] != before[2:5]:
                        start = r[4] - len(r[1])
                        copies.append((r[2], r[3], start, start + r[5] + LENGTH - 1))
                    continue
                before = r
                kept.append(r)
            pieces = np.frombuffer(b"".join([r[0][:PIECE] for r in kept]), np.uint8).reshape(-1, PIECE)
            dealt = piece_hashes(pieces)[:, 0] % np.uint64(buckets)
            for bucket, r in zip(dealt.tolist(), kept, strict=True):
                parts.setdefault(bucket, []).append(r)
            rows = [pack(b, part) for b, part in parts.items()]
            if copies:
                docs, hashes, lo, hi = (np.array(x, np.int64).tobytes() for x in zip(*copies, strict=True))
                rows.append((held[0][2] % buckets, b"", b"", b"", b"", b"", b"", docs, hashes, lo, hi))
            held.clear()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                held.extend(cut(batch.slice(i, 500)))
                if len(held) > 250_000:
                    yield from emit()
        if held:
            yield from emit()

    return rows.mapInArrow(run, BLOCK)


def classes_by_depth(shares: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """For neighbours in sorted order: the class of each string when only ``depth`` bytes count."""
    return np.cumsum(shares[:, None] < depths[None, :], axis=0)


def repeats(blocks: pa.Table) -> pa.Table:
    """(doc, text_hash, lo, hi) of repeated windows among the runs of one bucket."""
    spans, runs, lcps, records = [], [], [], []
    number = lambda b: np.frombuffer(b, np.int64)
    for row in blocks.to_pylist():
        fields = [number(row[c]) for c in ("doc", "text_hash", "anchor", "n")]
        if not row["keys"]:
            spans.append(np.stack(fields, 1))
            continue
        lcp, ends = number(row["lcp"]).tolist(), np.cumsum(number(row["rest_len"])).tolist()
        suffixes, before, lo = [], b"", 0
        for k, hi in zip(lcp, ends, strict=True):
            before = before[:k] + row["rest"][lo:hi]
            suffixes.append(before)
            lo = hi
        left_ends = np.cumsum(number(row["left_len"])).tolist()
        lefts = [row["left"][a:b] for a, b in zip([0, *left_ends], left_ends, strict=False)]
        runs.append(suffixes)
        lcps.append(lcp)
        records.append(list(zip(lefts, *[f.tolist() for f in fields], strict=True)))
    order, shares = merge(runs, lcps) if runs else ([], [])
    if order:
        spans.append(repeated_windows([records[r][i] for r, i in order], np.array(shares)))
    every = np.concatenate(spans) if spans else np.empty((0, 4), np.int64)
    return pa.table({c: every[:, i] for i, c in enumerate(("doc", "text_hash", "lo", "hi"))})


def repeated_windows(records: list[tuple], shares: np.ndarray) -> np.ndarray:
    """Spans of repeats; records (left, doc, text_hash, anchor, n) stand in the order of their suffixes."""
    lefts = [r[0][::-1] for r in records]
    doc, text_hash, anchor, n = (np.array(x, np.int64) for x in list(zip(*records, strict=True))[1:])
    offset = np.array([len(x) for x in lefts])  # from the first window's start to the anchor
    group = np.cumsum(shares < PIECE)  # one anchor text
    by_left = sorted(range(len(lefts)), key=lambda i: (group[i], lefts[i]))
    near = [0, *[common(lefts[a], lefts[b], 0) if group[a] == group[b] else -1
                 for a, b in zip(by_left, by_left[1:], strict=False)]]
    right_class = classes_by_depth(shares, np.arange(PIECE, LENGTH + 1))
    left_class = np.empty((len(lefts), REACH), np.int64)
    left_class[by_left] = classes_by_depth(np.array(near), np.arange(REACH))
    age = np.lexsort((anchor, text_hash, doc))
    who = np.repeat(age, n[age])
    step = np.arange(len(who)) - np.repeat(np.cumsum(n[age]) - n[age], n[age])
    a = offset[who] - step  # offset of the anchor in this window
    start = anchor[who] - a
    name = np.stack([right_class[who, LENGTH - a - PIECE], left_class[who, a], a])
    name = (name[0] * (len(lefts) + 1) + name[1]) * LENGTH + name[2]
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    first = first[which]
    repeat = (start != start[first]) | (doc[who] != doc[who[first]]) | (text_hash[who] != text_hash[who[first]])
    same = np.r_[False, (who[1:] == who[:-1]) & (start[1:] == start[:-1] + 1)]
    begin = np.flatnonzero(repeat & ~(same & np.r_[False, repeat[:-1]]))
    end = np.flatnonzero(repeat & ~np.r_[same[1:] & repeat[1:], False])
    return np.stack([doc[who[begin]], text_hash[who[begin]], start[begin], start[end] + LENGTH], 1)


def removed_spans(docs: DataFrame) -> DataFrame:
    """(key, lo, hi): maximal runs of bytes that go, per text."""
    rows = keyed(docs)
    met = written(shared(anchors(rows)), "shared_anchors")
    buckets = max(1, -(-met.count() // RECORDS_PER_BUCKET))
    places = met.groupBy(*KEY).agg(F.collect_list("place").alias("places"))
    cut = suffix_runs(rows.join(places, KEY).select(*KEY, "text", "places"), buckets)
    spans = written(cut.groupBy("bucket").applyInArrow(repeats, SPANS), "spans")
    order = Window.partitionBy(*KEY).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int")).withColumn(
        "number", F.sum("fresh").over(order))
    return fresh.groupBy(*KEY, "number").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("number")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row."""
    spans = removed_spans(docs).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    rows = keyed(docs).join(spans, KEY, "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data, at, kept = as_bytes(text.as_py()), 0, []
                for s in gone or []:
                    kept.append(data[at:s["lo"]])
                    at = s["hi"]
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(gone or []), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([batch.column(0), *[pa.array(columns[i], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    done = rows.mapInArrow(run, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return done.select(F.nullif("doc", F.lit(NO_DOC)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")

