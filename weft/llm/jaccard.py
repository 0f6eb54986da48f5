"""N-gram Jaccard join by filtering under several global orders.

A document is the set of its distinct five-word shingles.  Two link when their
Jaccard similarity reaches the threshold t (four fifths).  Equal sets are one class
from the start, and only a class's first document is compared.

*Orders.*  A global order puts all shingles of the corpus in a row.  Three are used:
by frequency, rare ones first; and two by independent hashes.  In all of them,
shingles of a single class come before the others, which costs no link and lets most
documents do without an entry.  Two linked sets x and y share at least
t (|x| + |y|) / (1 + t) shingles, so under every order their first common shingle
stands at places i and j with both |x| - i and |y| - j at least that many: within the
first |x| - ceil(t |x|) + 1 places, their prefixes.

*Pairs* share a prefix shingle by frequency at such places, and a prefix shingle
under each of the other two orders; lengths must fit as well.  Only what passes all
filters is verified, on whole sets of words.

*Rounds.*  Documents of one component need no further pair, so the first round compares
each document of a prefix group with one member of the group, and joins what links.
Later ones compare each document outside a group's main component with 4, 16, 64, ..
random members, and when groups have no more members than that, all pairs that are left
between different components are compared, each group dealt by length.  So a large
group of near copies costs a few comparisons a document.

*Counting.*  Shingles are counted by ids, the first bits of their hash: ``ID_BITS``
and one bit for each doubling of the corpus.  Shingles with one id count as one; that
can add pairs to verify, and loses none, as places are counted by ids too.  Each task
sends packed ids to the reducer of their range; an id that ``LOCAL`` documents of a
task share is sent once, with their number, and its documents pass it by.

Classes are told apart by two 64-bit sums of shingle hashes and the number of shingles.

Defined cases: texts without words, and null texts, have empty sets and link with
nothing; texts under five words are one shingle of all their words; null keys take
part, but a component is named by its smallest key that is not null (null if there
is none); repeated rows are documents of their own with equal sets; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.repeats import Prefix, with_row_id
from weft.llm.stages import SMALL, forget, small, stage
from weft.llm.tokens import Words, grams, mix64, slices, starts_of_grams

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
GROWTH = 4  # members that a document is compared with, from round to round
ID_BITS = 32
BUCKET = 8 << 20  # bytes of corpus text whose shingles a reducer counts
FLUSH, FLUSH_ROWS = 8 << 20, 60_000  # bytes of text and documents whose shingles a task holds at once
LOCAL = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    """Exact shingle set of a text."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def linked(a: set, b: set) -> bool:
    both = len(a & b)
    return both > 0 and DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingle hash, document) of all distinct shingles, in order of document and hash, and the number of documents."""
    w = Words(texts, lower=True)
    count = np.diff(w.first)
    inside = np.flatnonzero(starts_of_grams(w.first, SHINGLE))
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    token = np.concatenate([grams(w.hash, SHINGLE)[inside], Prefix(w.hash).of(w.first[short], w.first[short + 1])])
    doc = np.concatenate([w.doc_of_word()[inside], short])
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return token[new], doc[new], len(count)


def _ids(token: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of ``bits`` bits, in order of document and id."""
    ids = token >> np.uint64(64 - bits)
    new = np.ones(len(ids), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (ids[1:] != ids[:-1])
    return ids[new], doc[new]


def _sets(bits: int):
    """node, key, text -> node, key, shingles, ids, two fingerprints of the set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2)):
            token, doc, docs = _hashed(b.column(2))
            n = np.bincount(doc, minlength=docs)
            n_ids = np.bincount(_ids(token, doc, bits)[1], minlength=docs)
            end = np.cumsum(n)
            marks = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                with np.errstate(over="ignore"):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(token + np.uint64(salt)), dtype=np.uint64)])
                    marks.append((total[end] - total[end - n]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(n_ids, pa.int64()), *map(pa.array, marks)], names=["node", "key", "n", "n_ids", "f1", "f2"])

    return scan


# What tasks send: layout, entries, nodes; then the columns, one after another.
_HEAD = "<BII"
_FEW, _MANY, _SUMS, _PAST = range(4)  # ids and nodes; ids and places in a list of nodes; ids and numbers; whole ids and nodes


def _packed(kind: int, n: int, nodes: int, *columns: np.ndarray) -> bytes:
    return struct.pack(_HEAD, kind, n, nodes) + b"".join(c.tobytes() for c in columns)


def _counted(bits: int):
    """node, text -> range of ids, blob."""
    ranges = 1 << (bits - ID_BITS)
    low = np.uint64((1 << ID_BITS) - 1)

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes = np.concatenate([h[0] for h in held])
        first = np.cumsum([0] + [len(h[0]) for h in held])
        ids = np.concatenate([h[1] for h in held])
        doc = np.concatenate([h[2] + f for h, f in zip(held, first)])
        order = np.argsort(ids, kind="stable")
        ids, doc = ids[order], doc[order].astype(np.uint16)
        head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(ids)))
        often = count >= LOCAL
        past = np.repeat(often, count)
        to, blobs = [], []
        if past.any():
            to.append(ranges + int(mix64(nodes[:1].view(np.uint64))[0] % np.uint64(ranges)))
            blobs.append(_packed(_PAST, int(past.sum()), 0, ids[past], nodes[doc[past]]))
        bounds = np.arange(ranges + 1, dtype=np.uint64) << np.uint64(ID_BITS)
        for one, place in ((ids[~past], doc[~past]), (ids[head[often]], None)):
            cut = np.searchsorted(one, bounds[1:-1]).tolist()
            short = (one & low).astype(np.uint32)
            for r, (a, z) in enumerate(zip([0, *cut], [*cut, len(one)])):
                if z == a:
                    continue
                to.append(r)
                if place is None:
                    blobs.append(_packed(_SUMS, z - a, 0, short[a:z], count[often][a:z].astype(np.uint32)))
                elif z - a < 2 * len(nodes):
                    blobs.append(_packed(_FEW, z - a, 0, short[a:z], nodes[place[a:z]]))
                else:
                    blobs.append(_packed(_MANY, z - a, len(nodes), short[a:z], place[a:z], nodes))
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], names=["b", "blob"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for b in (part for whole in batches for part in slices(whole, 1)):
            if held and rows + b.num_rows > FLUSH_ROWS:
                yield flush(held)
                held, size, rows = [], 0, 0
            token, doc, _ = _hashed(b.column(1))
            held.append((b.column(0).to_numpy(zero_copy_only=False), *_ids(token, doc, bits)))
            size, rows = size + b.column(1).nbytes, rows + b.num_rows
            if size >= FLUSH:
                yield flush(held)
                held, size, rows = [], 0, 0
        if held:
            yield flush(held)

    return scan


def _frequencies():
    """Rows node, token, df of all shared ids; df is 0 where the node's task has passed the id by, and -df stands in a row without a node for such ids."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, nodes, sums, numbers, past = [], [], [], [], []
        for blob in pdf["blob"]:
            kind, n, m = struct.unpack_from(_HEAD, blob)
            at = struct.calcsize(_HEAD)
            if kind == _PAST:
                past.append((np.frombuffer(blob, "<u8", n, at), np.frombuffer(blob, "<i8", n, at + 8 * n)))
                continue
            short = np.frombuffer(blob, "<u4", n, at)
            at += 4 * n
            if kind == _SUMS:
                sums.append(short)
                numbers.append(np.frombuffer(blob, "<u4", n, at))
                continue
            ids.append(short)
            nodes.append(np.frombuffer(blob, "<i8", n, at) if kind == _FEW else np.frombuffer(blob, "<i8", m, at + 2 * n)[np.frombuffer(blob, "<u2", n, at)])
        above = np.int64(int(pdf["b"].iloc[0]) << ID_BITS)
        out = [(n, t.view(np.int64), np.zeros(len(n), np.int64)) for t, n in past]
        one, node = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((ids, np.uint32), (nodes, np.int64)))
        order = np.lexsort((node, one))
        one, node = one[order], node[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (node[1:] != node[:-1])
        one, node = one[new], node[new]
        names, count = np.unique(one, return_counts=True)
        also, where = np.unique(np.concatenate(sums), return_inverse=True) if sums else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        more = np.bincount(where, np.concatenate(numbers) if numbers else None, len(also)).astype(np.int64)
        total = count.astype(np.int64)
        if len(also):
            both, here, there = np.intersect1d(names, also, assume_unique=True, return_indices=True)
            total[here] += more[there]
            more[there] = total[here]
        df = np.repeat(total, count)
        out.append((node[df > 1], above + one[df > 1].astype(np.int64), df[df > 1]))
        out.append((np.zeros(len(also), np.int64), above + also.astype(np.int64), -more))
        return pd.DataFrame({k: np.concatenate(x) for k, x in zip(("node", "token", "df"), zip(*out))})

    return answer


def _jumped(parents: DataFrame, name: str) -> DataFrame:
    """(id, root) of a forest (id, root) whose parents are smaller: pointers double until all are roots."""
    for turn in range(40):
        above = parents.select(F.col("id").alias("id2"), F.col("root").alias("root2"))
        higher = stage(parents.join(small(above), F.col("root") == F.col("id2"), "left").select("id", F.coalesce("root2", "root").alias("root"), F.col("root2").isNotNull().alias("moved")), f"{name}-{turn}")
        parents = higher.select("id", "root")
        if not higher.where("moved").limit(1).count():
            break
    return parents


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, root) of a few edges (a, b), by union of sets."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.get(x, x)) != x:
            up[x] = up.get(above, above)
            x = above
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in up]
    yield pd.DataFrame([f for f in found if f[0] != f[1]], columns=["id", "root"], dtype="int64")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) of every id of ``edges`` (a, b) that is not its component's smallest: root is that smallest id.

    Up to ``SMALL`` edges, as counted, are joined by one task.  Of more, each id hangs
    itself on its smallest neighbour below it; the forest is flattened; edges between
    different roots are what the next turn joins.
    """
    left = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    if left.count() <= SMALL:
        return stage(left.coalesce(1).mapInPandas(_joined, "id long, root long"), f"{name}-roots")
    found = None
    for turn in range(40):
        forest = _jumped(stage(left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")), f"{name}-{turn}-least"), f"{name}-{turn}")
        found = forest if found is None else stage(_moved(found, "root", forest).unionByName(forest), f"{name}-{turn}-all")
        rest = _moved(_moved(left, "a", forest), "b", forest).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        left = stage(rest, f"{name}-{turn}-rest")
        if not left.limit(1).count():
            break
    return found


def _moved(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its root, where ``roots`` (id, root) has one."""
    to = small(roots.select(F.col("id").alias("_id"), F.col("root").alias("_root")))
    return rows.join(to, F.col(column) == F.col("_id"), "left").select(*[F.coalesce("_root", column).alias(column) if c == column else F.col(c) for c in rows.columns])


def _fits(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Whether sets of these sizes whose first common shingle stands at these places may link."""
    least = NUMERATOR * (na + nb)
    total = NUMERATOR + DENOMINATOR
    return (DENOMINATOR * F.least(na, nb) >= NUMERATOR * F.greatest(na, nb)) & (total * (na - pa_) >= least) & (total * (nb - pb) >= least)


def _near() -> Column:
    """Of two that link, the shorter one has their first common shingle this early (within its first ninth)."""
    return 2 * NUMERATOR * F.col("n") <= (NUMERATOR + DENOMINATOR) * (F.col("n") - F.col("at"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, ca, cb) that share prefix shingles under the other orders, with ``ok``: whether the two texts link."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"), F.col("p2").alias("a2"), F.col("p3").alias("a3"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"), F.col("p2").alias("b2"), F.col("p3").alias("b3"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for b in (part for whole in batches for part in slices(whole, 4)):
            ok = []
            for ta, tb in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                if tb != last:
                    last, last_set = tb, shingles(tb)
                ok.append(linked(shingles(ta), last_set))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ok, pa.bool_())], names=["a", "b", "ca", "cb", "ok"])

    both = pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3"))
    return both.select("a", "b", "ca", "cb", "ta", "tb").mapInArrow(compare, "a long, b long, ca long, cb long, ok boolean")


def _index(heads: DataFrame, classes: DataFrame, bits: int) -> DataFrame:
    """(node, n, p1, p2, p3) of the heads whose prefixes hold shared ids: p1 array<struct<token, at>>, p2 and p3 array<long>."""
    counted = heads.select("node", "text").mapInArrow(_counted(bits), "b int, blob binary")
    hits = stage(counted.groupBy("b").applyInPandas(_frequencies(), "node long, token long, df long"), "jaccard-hits", release=True)
    often = small(hits.where("df < 0").select(F.col("token").alias("t"), (-F.col("df")).alias("d")))
    past = hits.where("df = 0").join(often, F.col("token") == F.col("t")).select("node", "token", F.col("d").alias("df"))
    # equal rows share a node, so a token can come twice
    found = hits.where("df > 0").unionByName(past).groupBy("node").agg(F.collect_set(F.struct("df", "token")).alias("found"))
    sized = found.join(classes.select(F.col("head").alias("h"), "n", "n_ids"), F.col("node") == F.col("h"))
    alone = F.col("n_ids") - F.size("found")
    depth = (F.col("n") - F.ceil(NUMERATOR * F.col("n") / DENOMINATOR - F.lit(1e-9)) + 1 - alone).cast("int")
    prefix = lambda order: F.slice(F.array_sort(order), F.lit(1), F.col("depth"))
    by_hash = lambda salt: F.transform(prefix(F.transform("found", lambda x: F.struct(F.xxhash64(x["token"], F.lit(salt)).alias("h"), x["token"].alias("token")))), lambda x: x["token"])
    at_places = F.transform(prefix(F.col("found")), lambda x, i: F.struct(x["token"].alias("token"), (F.col("alone") + i).alias("at")))
    prefixes = sized.withColumns({"depth": depth, "alone": alone.cast("int")}).where("depth > 0").select("node", "n", at_places.alias("p1"), by_hash(2).alias("p2"), by_hash(3).alias("p3"))
    index = stage(prefixes, "jaccard-index", release=True)
    forget(hits)
    return index


def _joined_classes(rows: DataFrame, classes: DataFrame, bits: int) -> DataFrame | None:
    """(id, root): heads of classes that are not the first of their component, and that first one."""
    heads = rows.join(classes.select(F.col("head").alias("h")), F.col("node") == F.col("h"), "left_semi")
    index = _index(heads, classes, bits)
    every = index.select("node", "n", F.explode("p1").alias("p")).select(F.col("p.token").alias("token"), "node", "n", F.col("p.at").alias("at"))
    near = _near()
    met = every.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max(near).alias("near")).where("lo <> hi and near").select(F.col("token").alias("t"))
    entries = stage(every.join(met, F.col("token") == F.col("t"), "left_semi").withColumn("comp", F.col("node")), "jaccard-entries")
    needed = small(stage(entries.select(F.col("node").alias("m")).distinct(), "jaccard-needed"))
    orders = index.select(F.col("node").alias("m"), "p2", "p3").join(needed, "m", "left_semi")
    texts = rows.join(needed, F.col("node") == F.col("m"), "left_semi").dropDuplicates(["node"]).join(orders, F.col("node") == F.col("m")).select("node", "text", "p2", "p3")
    texts = stage(texts, "jaccard-texts", release=True)
    forget(index)

    roots = members = joined = None
    for turn in range(64):
        if members is None or joined is not None:
            # groups of one component stay so: only what was open is looked at again
            now = entries if joined is None else _moved(members.select("token", "node", "n", "at", "comp"), "comp", joined)
            groups = now.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "at", "comp")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
            open_groups = groups.where("lo <> hi").select(F.col("token").alias("t"), "c", "size")
            open_members = stage(now.join(open_groups, F.col("token") == F.col("t")).drop("t"), f"jaccard-open{turn}")
            if members is not None:
                forget(members)
            members = open_members
        largest = members.agg(F.max("size")).first()[0]
        if not largest:
            break
        draws = GROWTH**turn
        last = turn > 0 and draws >= largest
        if last:
            pairs = _all_pairs(members)
        elif turn:
            pairs = _drawn_pairs(members, draws, turn)
        else:
            pairs = members.where((F.col("comp") != F.col("c.comp")) & _fits(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at"))).select(*_pair("node", "c.node", "comp", "c.comp")).distinct()
        links = stage(_verified(pairs, texts).where("ok"), f"jaccard-links{turn}")
        joined = None
        if links.limit(1).count():
            joined = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), f"jaccard-components{turn}")
            roots = joined if roots is None else stage(_moved(roots, "root", joined).unionByName(joined), f"jaccard-roots{turn}")
        if last:
            break
    forget(entries, texts, members)
    return roots


def _drawn_pairs(members: DataFrame, draws: int, turn: int) -> DataFrame:
    """Each document outside a group's main component against about ``draws`` random members of one of its groups."""
    groups_of = members.where("comp <> c.comp").groupBy("node", F.col("c.comp").alias("main")).agg(F.min(F.struct((~_near()).alias("late"), F.xxhash64("token", "node", F.lit(turn)).alias("h"), "token", "n", "at", "comp")).alias("g"))
    x = groups_of.select(F.col("node").alias("x"), F.col("g.token").alias("token"), F.col("g.n").alias("nx"), F.col("g.at").alias("ix"), F.col("g.comp").alias("cx"))
    y = members.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.col("size")) < draws).select(F.col("token").alias("token_"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("at").alias("iy"), F.col("comp").alias("cy"))
    found = x.join(y, (F.col("token") == F.col("token_")) & (F.col("cx") != F.col("cy")) & _fits(F.col("nx"), F.col("ix"), F.col("ny"), F.col("iy")))
    return found.select(*_pair("x", "y", "cx", "cy")).distinct()


def _pair(a: str, b: str, ca: str, cb: str) -> list[Column]:
    """a, b, ca, cb with the smaller document first."""
    swap = F.col(a) > F.col(b)
    return [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n) for x, y, n in ((a, b, "a"), (b, a, "b"), (ca, cb, "ca"), (cb, ca, "cb"))]


def _all_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components that fit, in each group: those outside the component of the chosen member, against all.

    Groups are dealt by length as well: sizes of a pair lie in one band of 5 : 4, or in neighbouring ones.
    """
    band = F.floor(F.log("n") / math.log(DENOMINATOR / NUMERATOR)).cast("int")
    x = members.where("comp <> c.comp").select("token", band.alias("band"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ix"), F.col("comp").alias("cx"))
    near = F.explode(F.array(band - 1, band, band + 1))
    y = members.select(F.col("token").alias("token_"), near.alias("band_"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("at").alias("iy"), F.col("comp").alias("cy"), F.col("c.comp").alias("main"))
    once = (F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))
    found = x.join(y, (F.col("token") == F.col("token_")) & (F.col("band") == F.col("band_")) & (F.col("cx") != F.col("cy")) & once & _fits(F.col("nx"), F.col("ix"), F.col("ny"), F.col("iy")))
    return found.select(*_pair("x", "y", "cx", "cy")).distinct()


def _joined_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, key, n, comp, name) of every row of ``docs`` with ``_node``; comp and name, the smallest key in it, are null for empty sets."""
    rows = docs.select(F.col("_node").alias("node"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = ID_BITS + min(31, max(0, int(-(-total // BUCKET) - 1).bit_length()))
    sets = stage(rows.mapInArrow(_sets(bits), "node long, key long, n long, n_ids long, f1 long, f2 long"), "jaccard-sets", release=True)
    classes = stage(sets.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("node").alias("head"), F.min("n_ids").alias("n_ids"), F.min("key").alias("name")), "jaccard-classes")
    roots = _joined_classes(rows.select("node", "text"), classes, bits)
    named = classes.select("f1", "f2", "n", F.col("head").alias("comp"), "name")
    if roots is not None:
        named = _moved(named, "comp", roots)
        names = named.groupBy(F.col("comp").alias("c")).agg(F.min("name").alias("least"))
        named = named.join(names, F.col("comp") == F.col("c")).select("f1", "f2", "n", "comp", F.col("least").alias("name"))
    named = stage(named, "jaccard-named")
    forget(classes)
    return sets.select("node", "key", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left").select("node", "key", "n", "comp", "name")


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    keyed = _joined_rows(with_row_id(docs, "_node", key, text), key, text)
    return keyed.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("name", "key").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that with the smallest key (null keys last), and every row that links with nothing.

    Rows that repeat key and text count as one.
    """
    rows = with_row_id(docs, "_node", key, text)
    keyed = _joined_rows(rows, key, text)
    stay = keyed.groupBy(F.coalesce("comp", "node").alias("c")).agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "node")).alias("m")).select(F.col("m.node").alias("_stay"))
    # the join deals texts by row id once; dropping repeats needs no other deal
    kept = rows.join(stay, F.col("_node") == F.col("_stay"), "left_semi")
    return kept.dropDuplicates(["_node"]).select(*docs.columns)
