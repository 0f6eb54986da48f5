"""Exchange that finds windows which recur in a corpus.

Every window of fixed length (words or bytes) has an anchor: its minimiser, the
smallest of the hashes of the short grams inside it.  Equal windows have equal
anchors, and consecutive windows mostly share theirs, so a run of windows with
one anchor travels as one row.

1. ``candidates``: anchors that occur once are dropped.  A task sends each
   distinct anchor once, whatever the number of its documents, so a very common
   anchor costs its reducer one entry a task.
2. ``recurring``: the runs that are left are read from their texts and sent to the
   anchor's reducer, equal ones of a task once.
3. Runs of anchors that more than ``HOT`` documents share are first cut to windows.
   Those whose hash occurs once are dropped, and equal ones of a task (by content)
   go on once.  What is left takes step 2 as well, under the window's second anchor,
   the smallest hash of much longer grams: a common passage with many different
   surroundings is no single group, and no window recurs by its hash alone.
4. The reducer says which windows recur; each document's windows are gathered and
   joined to its text.

Documents are told apart by key and text (``with_row_id``), so repeated rows and null
keys need no special case.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.stages import forget, stage
from weft.llm.tokens import mix64, powers, slices

FLUSH = 4 << 20  # bytes of text whose anchors or units a task holds at once
BUCKET = 4 << 20  # bytes of corpus text a reducer answers for
HOT = 10_000  # documents that share an anchor
LONGEST = 1 << 12  # windows of a run that is put together again
SMALL = 100_000  # hot anchors (8 bytes each) that may be broadcast
LAST = np.iinfo(np.int64).max


def with_row_id(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with an id of each row as ``name``: the key, where it is not negative and no other row has it.

    Rows of null, negative and repeated keys are told apart by a 63-bit hash of key and
    whole text.  Up to ``SMALL`` repeated keys are looked up by broadcast; if there are
    more, all rows are hashed, so texts are not dealt by a hot key.
    """
    k, body = F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))
    hashed = F.xxhash64(k.isNull(), F.coalesce(k, F.lit(0)), body).bitwiseOR(F.lit(-(1 << 63)))
    keys = docs.select(k.alias("_again")).where("_again >= 0").groupBy("_again").count().where("count > 1").select("_again").limit(SMALL + 1)
    again = stage(keys, "repeated-keys")
    many = again.count()
    if many > SMALL:
        return docs.withColumn(name, hashed)
    if not many:
        return docs.withColumn(name, F.when(k >= 0, k).otherwise(hashed))
    marked = docs.join(F.broadcast(again), k == F.col("_again"), "left")
    return marked.withColumn(name, F.when((k >= 0) & F.col("_again").isNull(), k).otherwise(hashed)).drop("_again")


def order_of(key: str) -> Column:
    """Null keys come after all others."""
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST))


def buckets_for(docs: DataFrame, text: str) -> int:
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(max(1, -(-total // BUCKET)))


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs(minimiser: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, gram) of each run of windows with one minimiser; ``inside``: windows within one document."""
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, at
    m = minimiser[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), m[first]


def _flushes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for part in slices(whole, column):
            held.append(part)
            size += part.column(column).nbytes
            if size >= FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(bucket: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], names=["b", "blob"])


# Columns of what tasks send each other: packed one after another, so that a blob of one entry is as small as a row.
_ALONE = (0, "<u8", "<i8", "<u4", "<u2")  # anchor, row, first window, windows
_KNOWN = (1, "<i8", "<u4", "<u2", "<u8")  # row, first window, windows, anchor: recurs for certain
_SHARED = (2, "<u8", "<u4")  # anchor, documents of the task that have it
_UNITS = (3, "<u8", "<i8", "<i8", "<u4", "<u2", "<u1", "<u4")  # anchor, order, row, first window, windows, flag, bytes of content
_GONE = (4, "<i8", "<u4", "<u2")  # row, first window, windows
_HASHED = (5, "<u8", "<i8", "<i8", "<u4")  # hash of a window, order, row, window
_HEAD = "<BI"  # layout, entries


def _pack(layout: tuple, arrays: tuple[np.ndarray, ...], body: bytes | None = None) -> bytes:
    packed = struct.pack(_HEAD, layout[0], len(arrays[0])) + b"".join(x.astype(kind, copy=False).tobytes() for x, kind in zip(arrays, layout[1:]))
    return packed if body is None else packed + struct.pack(_HEAD, 0, len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def _split(bucket: np.ndarray, arrays: tuple[np.ndarray, ...], layout: tuple) -> tuple[list[int], list[bytes]]:
    """One blob a bucket; rows must be in order of their bucket."""
    if not len(bucket):
        return [], []
    cut = np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket))
    return [int(bucket[a]) for a in cut[:-1]], [_pack(layout, tuple(x[a:b] for x in arrays)) for a, b in zip(cut[:-1], cut[1:])]


def _gather(blobs: pd.Series, layout: tuple, body: bool = False) -> list[np.ndarray] | None:
    """The columns of all blobs of a layout, and the contents behind them if there are any."""
    parts, contents = [], []
    for blob in blobs:
        tag, n = struct.unpack_from(_HEAD, blob)
        if tag != layout[0]:
            continue
        at, columns = struct.calcsize(_HEAD), []
        for kind in layout[1:]:
            columns.append(np.frombuffer(blob, kind, n, at))
            at += columns[-1].nbytes
        parts.append(columns)
        if body:
            size = struct.unpack_from(_HEAD, blob, at)[1]
            contents.append(pa.decompress(bytes(blob[at + struct.calcsize(_HEAD) :]), size, codec="zstd", asbytes=True))
    if not parts:
        return None
    return [np.concatenate(x) for x in zip(*parts)] + ([b"".join(contents)] if body else [])


def joined_runs(row: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of a row as one run."""
    if not len(row):
        return row, first, n
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return row[at], first[at], np.add.reduceat(n, at)


def equal_chains(texts: list, text: np.ndarray, place: np.ndarray, by: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether all windows of each group have equal content.

    ``by``: windows in order of their group, ``head``: where in it a group begins.
    Every window is held against the one before it in its group; neighbours whose
    predecessors are neighbours too are compared as one stretch.
    """
    before = np.full(len(by), -1)
    later = np.flatnonzero(~head)
    before[by[later]] = by[later - 1]
    t = np.flatnonzero(before >= 0)
    good = np.ones(len(by), bool)
    if len(t):
        b = before[t]
        new = np.ones(len(t), bool)
        new[1:] = (text[t[1:]] != text[t[:-1]]) | (place[t[1:]] != place[t[:-1]] + 1) | (text[b[1:]] != text[b[:-1]]) | (place[b[1:]] != place[b[:-1]] + 1)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(t)) - 1
        ends = [x.tolist() for x in (text[t[lo]], place[t[lo]], place[t[hi]], text[b[lo]], place[b[lo]], place[b[hi]])]
        same = np.array([texts[i].content(a, z) == texts[j].content(c, d) for i, a, z, j, c, d in zip(*ends)])
        good[t] = np.repeat(same, hi - lo + 1)
    return np.logical_and.reduceat(good[by], np.flatnonzero(head))


def candidates(docs: DataFrame, anchors: Callable, across: bool, buckets: int, name: str) -> tuple[DataFrame, int]:
    """``docs`` (rid, ord, text) -> one row a document: rid, runs array<struct<start, n, key, hot>>; and the number of hot anchors.

    ``anchors(texts)`` -> (document, first window in it, windows, anchor hash).
    ``across``: an anchor recurs if two documents have it; else two places.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _flushes(batches, 1):
            parts = []
            for b in held:
                doc, start, n, key = anchors(b.column(1))
                parts.append((key, b.column(0).to_numpy(zero_copy_only=False)[doc], start.astype(np.uint32), n.astype(np.uint16)))
            key, rid, start, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((rid, key))
            key, rid, start, n = key[order], rid[order], start[order], n[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(head)
            if not len(first):
                continue
            differ = np.zeros(len(key), np.int64)
            differ[1:] = (key[1:] == key[:-1]) & (rid[1:] != rid[:-1])
            docs_of = np.add.reduceat(differ, first) + 1
            count = np.diff(np.append(first, len(key)))
            many = (docs_of > 1) if across else (count > 1)
            here = np.repeat(many, count)
            # runs known to recur already: straight on, in spread-out groups; the reducer hears of the anchor once
            known = _split(buckets + np.zeros(int(here.sum()), np.int64), (rid[here], start[here], n[here], key[here]), _KNOWN)
            sent = ~here
            single = _split(_bucket(key[sent], buckets), (key[sent], rid[sent], start[sent], n[sent]), _ALONE)
            shared = _split(_bucket(key[first[many]], buckets), (key[first[many]], docs_of[many]), _SHARED)
            spread = [buckets + int(mix64(rid[here][:1].view(np.uint64))[0] % np.uint64(buckets))] if known[0] else []
            yield _rows(spread + single[0] + shared[0], known[1] + single[1] + shared[1])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        passed = _gather(pdf["blob"], _KNOWN)
        if passed is not None:
            rid, start, n, key = passed
            out.append((rid, start, n, key))
        alone, known = _gather(pdf["blob"], _ALONE), _gather(pdf["blob"], _SHARED)
        if alone is not None or known is not None:
            key, rid, start, n = alone if alone is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint16))
            also, docs_of = known if known is not None else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
            order = np.lexsort((rid, key))
            key, rid, start, n = key[order], rid[order], start[order], n[order]
            names, at, count = np.unique(key, return_index=True, return_counts=True)
            differ = np.zeros(len(key), np.int64)
            differ[1:] = (key[1:] == key[:-1]) & (rid[1:] != rid[:-1])
            spread = (np.add.reduceat(differ, at) + 1) if len(at) else np.zeros(0, np.int64)
            many = np.isin(names, also) | ((spread > 1) if across else (count > 1))
            keep = np.repeat(many, count)
            out.append((rid[keep], start[keep], n[keep], key[keep]))
            # anchors of very many documents, as rows without a document
            every, where = np.unique(np.concatenate([names, also]), return_inverse=True)
            hot = every[np.bincount(where, np.concatenate([spread, docs_of.astype(np.int64)]), len(every)) > HOT]
            out.append((np.zeros(len(hot), np.int64), np.zeros(len(hot), np.uint32), np.zeros(len(hot), np.uint16), hot))
        rid, start, n, key = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"rid": rid, "start": start.astype(np.int32), "n": n.astype(np.int32), "key": key.view(np.int64)})

    hits = stage(docs.select("rid", "text").mapInArrow(scan, "b int, blob binary").groupBy("b").applyInPandas(answer, "rid long, start int, n int, key long"), f"{name}-hits", release=True)
    hot = hits.where("n = 0").select(F.col("key").alias("_hot")).distinct()
    number = hot.count()
    if number <= SMALL:  # else the join shuffles, and adaptive execution splits its large partitions
        hot = F.broadcast(hot)
    marked = hits.where("n > 0").join(hot, F.col("key") == F.col("_hot"), "left").select("rid", F.struct("start", "n", "key", F.col("_hot").isNotNull().alias("hot")).alias("run"))
    found = stage(marked.groupBy("rid").agg(F.collect_set("run").alias("runs")), f"{name}-runs", release=True)  # equal rows have one id: their runs count once
    forget(hits)
    return found, number


def _flat(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(document, start, n, key, hot) of an array<struct> column, in order of document and start."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    fields = [values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
    order = np.lexsort((fields[0], doc))
    return (doc[order], fields[0][order].astype(np.int64), fields[1][order].astype(np.int64), fields[2][order].view(np.uint64), fields[3][order].astype(bool))


def _together(doc: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, n, key): neighbouring single windows with one key as runs."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (start[1:] % LONGEST == 0)
    at = np.flatnonzero(new)
    return doc[at], start[at], np.diff(np.append(at, len(doc))), key[at]


def recurring(docs: DataFrame, found: DataFrame, any_hot: bool, read: Callable, resolve: Callable, first_stays: bool, buckets: int, name: str) -> DataFrame:
    """(rid, start, n) as a written table: runs of windows that are to go, of all documents.

    ``read(texts)`` gives an object with ``units(doc, start, n)`` -> (content hash,
    bytes list), ``windows(doc, start, n)`` -> (index of run, window, hash, second
    anchor, place in the texts) and ``content(first place, last place)`` -> bytes.
    ``resolve(keys, contents, order, rids, starts, n, flags)`` -> (row, first window,
    windows) that are to go.  ``first_stays``: windows go unless their document is
    the first that has them (else all do that occur twice).
    """

    def scan(batches: Iterator[pa.RecordBatch], single: bool = False) -> Iterator[pa.RecordBatch]:
        for held in _flushes(batches, 2):
            keys, marks, orders, rids, starts, counts, contents = [], [], [], [], [], [], []
            hot: list[tuple[np.ndarray, ...]] = []
            texts: list = []
            for b in held:
                doc, start, n, key, is_hot = _flat(b.column(3))
                rid, order = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                text = read(b.column(2))
                if single:
                    doc, start, n, key = _together(doc, start, text.windows(doc, start, n)[3])
                    is_hot = np.zeros(len(doc), bool)
                cold = ~is_hot
                mark, content = text.units(doc[cold], start[cold], n[cold])
                keys.append(key[cold])
                marks.append(mark)
                orders.append(order[doc[cold]])
                rids.append(rid[doc[cold]])
                starts.append(start[cold].astype(np.uint32))
                counts.append(n[cold].astype(np.uint16))
                contents += content
                if is_hot.any():
                    run, window, h, _, place = text.windows(doc[is_hot], start[is_hot], n[is_hot])
                    hot.append((h, order[doc[is_hot]][run], rid[doc[is_hot]][run], window.astype(np.uint32), place, np.full(len(run), len(texts))))
                    texts.append(text)
            key, mark, order, rid, start, n = (np.concatenate(x) for x in (keys, marks, orders, rids, starts, counts))
            gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            bucket_ids, blobs = [], []
            if len(key):
                with np.errstate(over="ignore"):
                    ident = mark * np.uint64(0x9E3779B97F4A7C15) + key  # equal content and anchor place
                while True:  # equal content decides: units that only share its hash get another one
                    by = np.lexsort((start, rid, order, ident))
                    head = np.ones(len(by), bool)
                    head[1:] = ident[by][1:] != ident[by][:-1]
                    first = np.flatnonzero(head)
                    least = by[first][np.cumsum(head) - 1]
                    differ = [i for i, j in zip(by[~head].tolist(), least[~head].tolist()) if contents[i] != contents[j]]
                    if not differ:
                        break
                    ident[differ] += np.uint64(1)
                size = np.diff(np.append(first, len(by)))
                flag = np.zeros(len(first), np.uint8)
                if first_stays:
                    later = order[by] > np.repeat(order[by][first], size)
                else:
                    later = np.repeat(size > 1, size)
                    flag[size > 1] = 1
                gone.append((rid[by][later], start[by][later], n[by][later]))
                # of equal units one is sent; with first_stays it is the first document's, and others of that document are sent too
                send = np.flatnonzero(head | (~later if first_stays else head))
                which = by[send]
                flags = flag[np.cumsum(head)[send] - 1]
                where = _bucket(mix64(key[which]), buckets)
                into = np.argsort(where, kind="stable")
                which, flags, where = which[into], flags[into], where[into]
                cut = np.append(np.flatnonzero(np.r_[True, where[1:] != where[:-1]]), len(where)).tolist()
                for a, z in zip(cut[:-1], cut[1:]):
                    w = which[a:z]
                    body = [contents[i] for i in w]
                    bucket_ids.append(int(where[a]))
                    blobs.append(_pack(_UNITS, (key[w], order[w], rid[w], start[w], n[w], flags[a:z], np.array([len(c) for c in body])), b"".join(body)))
            if hot:
                h, order, rid, window, place, of = (np.concatenate(x) for x in zip(*hot))
                by = np.lexsort((window, rid, order, h))
                head = np.ones(len(by), bool)
                head[1:] = h[by][1:] != h[by][:-1]
                size = np.diff(np.append(np.flatnonzero(head), len(by)))
                equal = np.repeat(equal_chains(texts, of, place, by, head), size)  # where only hashes are equal, all are sent
                h, order, rid, window = h[by], order[by], rid[by], window[by]
                later = equal & ((order > np.repeat(order[head], size)) if first_stays else np.repeat(size > 1, size))
                go = np.flatnonzero(later)
                go = go[np.lexsort((window[go], rid[go]))]
                gone.append(_together(rid[go], window[go], np.zeros(len(go), np.int64))[:3])
                send = head | ~equal | (~later if first_stays else head)
                some = _split(_bucket(h[send], buckets), (h[send], order[send], rid[send], window[send]), _HASHED)
                bucket_ids += some[0]
                blobs += some[1]
            if gone:
                rid, start, n = (np.concatenate(x) for x in zip(*gone))
                if len(rid):
                    to = buckets + int(mix64(rid[:1].view(np.uint64))[0] % np.uint64(buckets))
                    bucket_ids.append(to)
                    blobs.append(_pack(_GONE, (rid, start, n)))
            if blobs:
                yield _rows(bucket_ids, blobs)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        passed = _gather(pdf["blob"], _GONE)
        if passed is not None:
            out.append(tuple(x.astype(np.int64) for x in passed))
        sent = _gather(pdf["blob"], _UNITS, body=True)
        if sent is not None:
            key, order, rid, start, n, flag, length, raw = sent
            ends = np.cumsum(length.astype(np.int64))
            content = [raw[e - w : e] for e, w in zip(ends.tolist(), length.tolist())]
            row, first, windows = joined_runs(*resolve(key, content, order, flag, n.astype(np.int64)))
            out.append((rid[row], start[row].astype(np.int64) + first, windows))
        hot = _gather(pdf["blob"], _HASHED)
        if hot is not None:  # windows that may recur, as rows of no windows
            h, order, rid, window = hot
            by = np.lexsort((order, h))
            head = np.ones(len(by), bool)
            head[1:] = h[by][1:] != h[by][:-1]
            first = np.flatnonzero(head)
            size = np.diff(np.append(first, len(by)))
            some = by[np.repeat((order[by][first] < order[by][first + size - 1]) if first_stays else size > 1, size)]
            out.append((rid[some], window[some].astype(np.int64), np.zeros(len(some), np.int64)))
        rid, start, n = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"rid": rid, "start": start.astype(np.int32), "n": n.astype(np.int32)})

    def exchange(rows: DataFrame, found: DataFrame, step: Callable) -> DataFrame:
        joined = rows.join(found, "rid").select("rid", "ord", "text", "runs")
        return stage(joined.mapInArrow(step, "b int, blob binary").groupBy("b").applyInPandas(answer, "rid long, start int, n int"), f"{name}-gone", release=True)

    first = exchange(docs, found, scan)
    if not any_hot:
        return first
    hot = first.where("n = 0")
    ids = hot.select("rid").distinct()
    many = ids.count()
    again = hot.groupBy("rid").agg(F.collect_set(F.struct("start", F.lit(1).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(False).alias("hot"))).alias("runs"))
    rows = docs.join(F.broadcast(ids), "rid", "left_semi") if many <= SMALL else docs  # texts without such windows need no shuffle
    return first.where("n > 0").unionByName(exchange(rows, again, lambda batches: scan(batches, single=True)))


def covered(start: np.ndarray, n: np.ndarray, length: int, size: int) -> np.ndarray:
    """Mask of ``size`` places covered by windows of ``length`` that start in start .. start + n - 1."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + n - 1 + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


class Prefix:
    """Hashes of any stretch of a sequence in constant time each (polynomial prefix sums modulo 2**64)."""

    BASE = 0xD1342543DE82EF95
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * powers(len(values), self.BASE)[: len(values)], out=self.sums[1:])
            self.back = powers(len(values) + 1, self.INVERSE)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


def each(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of run, place) of every place start .. start + n - 1."""
    run = np.repeat(np.arange(len(n)), n)
    return run, start[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


def with_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``docs`` and, by rid, the list of window runs of each row (null where it has none)."""
    lists = windows.groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("gone"))  # as many as one of several equal rows has
    return docs.join(lists, "rid", "left")


def spans_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(start, n) arrays a row of an array<struct<start, n>> column, None for null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten()
    start, n = (values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    for lo, hi in zip((end - size).tolist(), end.tolist()):
        yield (start[lo:hi], n[lo:hi]) if hi > lo else None
