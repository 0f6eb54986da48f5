"""All terms of a dictionary counted in one pass over a text's bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of terms that one table of states takes, and positions that are looked at together.
TABLE_BYTES = 1 << 16
CHUNK = 1 << 20


class _Table:
    """Terms as a tree of states by bytes.  State 0 is dead, and a term is told by the state that it ends in."""

    def __init__(self, terms: Sequence[tuple[int, bytes]]):
        used = sorted({b for _, t in terms for b in t})
        self.kind = np.zeros(256, np.int64)
        self.kind[used] = range(1, len(used) + 1)
        next_, ends = [{}, {}], [-1, -1]
        for i, term in terms:
            state = 1
            for b in term:
                if b not in next_[state]:
                    next_[state][b] = len(next_)
                    next_.append({})
                    ends.append(-1)
                state = next_[state][b]
            ends[state] = i
        self.step = np.zeros((len(next_), len(used) + 1), np.int32)
        for state, edges in enumerate(next_):
            for b, to in edges.items():
                self.step[state, self.kind[b]] = to
        self.ends = np.array(ends)
        first = self.step[1][self.kind]
        self.pair = self.step[first[:, None], self.kind[None, :]].reshape(-1)
        self.starts = self.pair > 0
        self.single = [(b, ends[to]) for b, to in next_[1].items() if ends[to] >= 0]

    def hits(self, text: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, terms) of the terms that begin in the first ``n`` bytes."""
        for b, term in self.single:
            at = np.flatnonzero(text[:n] == b)
            yield at, np.full(len(at), term)
        m = min(n, len(text) - 1)
        if m <= 0:
            return
        pairs = (text[:m].astype(np.uint16) << 8) | text[1 : m + 1]
        at = np.flatnonzero(self.starts[pairs])
        state, depth = self.pair[pairs[at]], 2
        while len(at):
            term = self.ends[state]
            found = term >= 0
            yield at[found], term[found]
            inside = at + depth < len(text)
            at, state = at[inside], state[inside]
            state = self.step[state, self.kind[text[at + depth]]]
            alive = state > 0
            at, state, depth = at[alive], state[alive], depth + 1


def _tables(terms: Sequence[bytes]) -> list[_Table]:
    parts, size = [[]], 0
    for term, i in sorted((t, i) for i, t in enumerate(terms) if t):
        if parts[-1] and size + len(term) > TABLE_BYTES:
            parts.append([])
            size = 0
        parts[-1].append((i, term))
        size += len(term)
    return [_Table(p) for p in parts if p]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts without nulls, one behind the other, and their bounds."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return body, bounds - bounds[0]


def count_terms(texts: pa.Array, tables: Sequence[_Table], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, n) of each term that a text holds; matches may overlap, and none goes over the end of its text."""
    body, bounds = _bytes(texts)
    reach, codes, counts = int(lengths.max(initial=0)), [], []
    for lo in range(0, len(body), CHUNK):
        chunk, n = body[lo : lo + CHUNK + reach], min(CHUNK, len(body) - lo)
        for table in tables:
            for at, term in table.hits(chunk, n):
                row = np.searchsorted(bounds, at + lo, side="right") - 1
                whole = at + lo + lengths[term] <= bounds[row + 1]
                code, count = np.unique(row[whole] * len(lengths) + term[whole], return_counts=True)
                codes.append(code)
                counts.append(count)
    if not codes:
        return (np.zeros(0, np.int64),) * 3
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(where, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)
    return code // len(lengths), code % len(lengths), n


def count_batches(batches: Iterator[pa.RecordBatch], terms: Sequence[str], ids: Sequence[Sequence[int]]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text) -> batches of (key, term_id, n); a term has several ids where equal terms are listed."""
    spelt = [t.encode() for t in terms]
    tables, lengths = _tables(spelt), np.array([len(t) for t in spelt], np.int64)
    flat, each = np.array([i for some in ids for i in some], np.int64), np.array([len(some) for some in ids], np.int64)
    begin = np.cumsum(each) - each
    for batch in batches:
        row, term, n = count_terms(batch.column(1), tables, lengths)
        for lo in range(0, len(row), CHUNK):
            r, t, k = row[lo : lo + CHUNK], term[lo : lo + CHUNK], n[lo : lo + CHUNK]
            times = each[t]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            columns = [batch.column(0).take(pa.array(np.repeat(r, times))), pa.array(flat[np.repeat(begin[t], times) + place]), pa.array(np.repeat(k, times).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "term_id", "n"])
