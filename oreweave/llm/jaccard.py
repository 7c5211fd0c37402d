"""Operator 10, n-gram Jaccard join with pivots.

A document's set holds the hashes of its runs of ``k`` (5) words, A-Z lowered; two documents link at a Jaccard distance of at
most 0.25. Exactly three things are used. (1) A document with more than a quarter of its set in no other text links with no
other text; what is common is found by counting all hashes, packed into buckets by hash. (2) Of what is common, in an order of
frequency and hash, the first few must meet the first few of any partner; documents that share one of these are
put into one region, so no link leaves its region. (3) Inside a region pivots do the join: a document that no pivot covers
becomes one, its distances to the region's documents are taken, and those within 0.25 are its Voronoi ball and
linked. By the triangle inequality two balls can only link where their pivots are at most 0.75 apart, and only documents
within 0.5 of the other pivot (the boundary window) are compared.

A region of more than ``most`` documents or ``most_members`` members is joined recursively. Some of its documents become pivots, dealt to
all its parts; a document within 0.25 of one is in the ball of the first such and linked, one within 0.5 is copied to that
ball's window, and window and ball meet in tasks of bounded size. What no pivot covers goes on, by new pivots, then cut by
the shared first member, then by pivots again; what is still too large is cut in parts that meet pairwise.

Nothing hot meets in one task: texts with many copies are reduced to one before their sets are dealt, and members in very many texts
are found by summaries of bounded size and not sent to a bucket, as it is already known that they are common.

Texts are told apart by 64 bits of hash, set members by 40 bits and the bucket's number. Sets are compared in full.

Edge cases. Null and wordless texts have an empty set and link with nothing; shorter texts than k words have their whole
sequence as one member. Texts of any length are taken whole, one at a time. Copies and rows that repeat are one class. Null ids
are passed over in the minimum. Similarities of just 0.75 link. An empty table gives an empty result. Columns but ``doc_id`` and
``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, small, stored, text_hash
from .components import components
from .packed import PART, SLICE, Packed, Rolling, slices, trim

U = np.uint64
_LOW = U((1 << 40) - 1)
#: Stands for the frequency of members that are too frequent to be counted.
_HOT = 255


def sets_of(p: Packed, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct member, by text and hash."""
    hashes = p.word_hashes()
    at, grams = p.grams(hashes, k)
    doc = p.doc[at]
    short = np.flatnonzero((p.n_words > 0) & (p.n_words < k))
    if len(short):
        doc = np.concatenate((doc, short))
        grams = np.concatenate((grams, Rolling(hashes).of(p.first[short], p.first[short + 1])))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def sets_in_runs(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """:func:`sets_of` of runs of rows of about ``SLICE`` bytes, with the bounds of each. Made in smaller parts, as a text's arrays
    take many times what its set does."""
    held, at, size = [], 0, 0
    for i, j, p in slices(column, PART, lower=True):
        doc, grams = sets_of(p, k)
        held.append((doc + (i - at), grams))
        size += len(p.data)
        if size > SLICE - PART or j == len(column):
            yield at, j, *(np.concatenate(x) for x in zip(*held, strict=True))
            held, at, size = [], j, 0


def _five(x: np.ndarray) -> np.ndarray:
    """The low five bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _eight(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel()


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, int)
    return start, np.diff(np.append(start, len(x)))


def _short_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_runs`, those of over 255 in several, with lengths of one byte."""
    start, n = _runs(x)
    parts = -(-n // 255)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(start, parts) + 255 * nth, np.minimum(255, np.repeat(n, parts) - 255 * nth).astype(np.uint8)


class Csr:
    """Rows of numbers; ``find``: how many of its numbers each row shares with a given one."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), size)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.values, self.first = np.unique(flat[order], return_index=True)
        self.bound = np.append(self.first, len(flat))
        spread = np.repeat(np.diff(self.bound), np.diff(self.bound)).astype(float)
        self.weight = np.bincount(self.owner, spread, minlength=len(rows))  # how often each row's numbers stand in all rows

    def find(self, row: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, row)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == row)]
        start, size = self.bound[at], self.bound[at + 1] - self.bound[at]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.bincount(self.owner[np.repeat(start, size) + within], minlength=len(self.rows))


def region_join(rows: list[np.ndarray], n: np.ndarray, near: int = 75) -> np.ndarray:
    """Component of each document of a region: the smallest index it is linked to through others.

    ``rows``: the members of each set that other texts have too (others cannot be shared); ``n``: sizes of the whole sets.
    """
    csr, n = Csr(rows), np.asarray(n)
    eps, slack = 1 - near / 100, 1e-9
    root = np.arange(len(rows))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(i: int, j: int) -> None:
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)

    covered, pivots, ball, shares = np.zeros(len(rows), bool), [], {}, {}
    # those first whose members are the most common: near the middle of a group they cover most of it
    for i in np.argsort(-csr.weight / np.maximum(1, n), kind="stable").tolist():
        if covered[i]:
            continue
        both = csr.find(rows[i])
        met = np.flatnonzero(both)
        union = n[met] + n[i] - both[met]
        own = met[100 * both[met] >= near * union]
        for j in own.tolist():
            unite(i, j)
        mine = own[~covered[own]]
        covered[own] = covered[i] = True
        pivots.append(i)
        ball[i] = np.union1d(mine, [i])
        close = both[met] >= (1 - 3 * eps - slack) * union  # farther ones are in no window
        shares[i] = (met[close], both[met[close]] / union[close])
    # balls of pivots at a distance of 0.75 at most, through the boundary windows; pivots themselves were held against all
    inner = {i: x[x != i] for i, x in ball.items() if len(x) > 1}
    has = np.zeros(len(rows), bool)
    has[list(inner)] = True

    def near_to(i: int, docs: np.ndarray) -> np.ndarray:
        """Those of ``docs`` in the window around pivot i."""
        met, sim = shares[i]
        at = np.minimum(np.searchsorted(met, docs), max(0, len(met) - 1))
        return docs[(met[at] == docs) & (1 - sim[at] <= 2 * eps + slack)] if len(met) else docs[:0]

    for i in inner:
        met = shares[i][0]
        for j in met[has[met] & (met > i)].tolist():
            if top(i) == top(j):
                continue
            a, b = near_to(j, inner[i]), near_to(i, inner[j])
            if len(a) > len(b):
                a, b = b, a
            for x in a.tolist() if len(b) else ():
                both = csr.find(rows[x])[b]
                hit = b[100 * both >= near * (n[x] + n[b] - both)]
                if len(hit):
                    unite(x, int(hit[0]))
                    break
    return np.array([top(i) for i in range(len(rows))], np.int64)


class Summary:
    """Counts of the most frequent values of a long sequence (Misra and Gries): none is too small by more than the total over ``size``."""

    def __init__(self, size: int):
        self.size, self.values, self.counts = size, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        v, c = np.unique(values, return_counts=True)
        v, at = np.unique(np.concatenate((self.values, v)), return_inverse=True)
        c = np.bincount(at, np.concatenate((self.counts, c)), len(v)).astype(np.int64)
        if len(v) > self.size:
            c -= np.partition(c, len(c) - self.size - 1)[len(c) - self.size - 1]
            v, c = v[c > 0], c[c > 0]
        self.values, self.counts = v, c


def hot_members(texts: DataFrame, k: int, n_bytes: int, bound: int, size: int = 500_000) -> np.ndarray:
    """Sorted members that stand in ``bound`` texts, all of them, and some of at least an eighth of that; at most ``16 x members / bound``
    values. Counts come from a summary a task, so they are too small by two millionths of all members at most."""

    def summed(batches):
        found, seen, waiting = Summary(size), 0, []
        for b in batches:
            for _, _, p in slices(b.column("text"), PART, lower=True):
                seen += len(p.data)
                waiting.append(sets_of(p, k)[1])
                if sum(map(len, waiting)) > 2 * size:
                    found.add(np.concatenate(waiting))
                    waiting.clear()
        if waiting:
            found.add(np.concatenate(waiting))
        often = found.counts >= max(2, bound / 8 * seen / max(1, n_bytes))
        yield pa.RecordBatch.from_arrays([pa.array(found.values[often].view(np.int64)), pa.array(found.counts[often])], ["h", "c"])

    rows = texts.select("text").mapInArrow(summed, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= bound / 8).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def one_of_many(keyed: DataFrame, copies: int) -> DataFrame:
    """``text, t`` with texts of more than ``copies`` copies once: their copies merge before the shuffle."""
    many = stored(keyed.groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") > copies).select(F.col("t").alias("many")), "many")
    marked = keyed.join(small(many, 2_000_000), F.col("t") == F.col("many"), "left")
    once = marked.filter("many is not null").groupBy("t").agg(F.first("text").alias("text"))
    return marked.filter("many is null").select("text", "t").unionByName(once.select("text", "t"))


def sets_table(docs: DataFrame, k: int, near: int, bucket_words: int, hot: int, copies: int, together: int = 4) -> DataFrame:
    """``t, n, must, common, members`` of each distinct text: size of its set, how many of its common members must be looked at, and these
    in order of frequency; 0 and null where too little is common.

    Members are dealt to buckets of ``together`` times ``bucket_words`` words and counted there in passes of half of ``bucket_words`` each: a
    text's head in a bucket is nine bytes, so a text should have several members in each.
    """
    keyed = one_of_many(docs.select("text", text_hash(F.col("text")).alias("t")), copies)
    chars, n_texts = docs.agg(F.sum(F.octet_length("text")), F.count("text")).first()
    chars = chars or 0
    n_homes = max(1, int(chars / 6 / bucket_words) + 1)
    n_buckets, passes = -(-n_homes // together), 2 * together
    bound = max(hot, int(chars / 6 / 125_000))
    frequent = hot_members(keyed, k, chars, bound) if n_texts > bound else np.zeros(0, np.uint64)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent)
    pack_kind = "bucket int, kind int, payload binary"
    arrow = [pa.int32(), pa.int32(), pa.binary()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], []), arrow, strict=True)], ["bucket", "kind", "payload"])

    def deal(batches):
        """By bucket of the hash, the texts' hashes with how many members follow, and the members; by bucket of the text, its size and its frequent members."""
        known = frequent.value
        for b in batches:
            ts = np.asarray(b.column("t"))
            for i, j, doc, grams in sets_in_runs(b.column("text"), k):
                t, fresh = ts[i:j], np.zeros(j - i, bool)
                fresh[np.unique(t, return_index=True)[1]] = True
                n = np.bincount(doc, minlength=j - i)
                doc, grams = doc[fresh[doc]], grams[fresh[doc]]
                rows = []
                home = (t % n_homes)[fresh]
                for x in np.unique(home).tolist():
                    own = np.flatnonzero(fresh)[home == x]
                    rows.append((x, 1, np.stack([t[own], n[own]]).astype("<i8").tobytes()))
                bucket = ((grams >> U(40)) % U(n_buckets)).astype(np.int64)
                if len(known):
                    often = known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams
                    of, v, at = t[doc[often]], grams[often] & _LOW | bucket[often].astype(np.uint64) << U(40), (t % n_homes)[doc[often]]
                    for x in np.unique(at).tolist():
                        rows.append((x, 2, np.stack([of[at == x], v[at == x].view(np.int64)]).astype("<i8").tobytes()))
                    bucket, doc, grams = bucket[~often], doc[~often], grams[~often]
                order = np.argsort(bucket, kind="stable")
                bucket, doc, grams = bucket[order], doc[order], grams[order]
                for s, m in zip(*_runs(bucket), strict=True):
                    own = doc[s : s + m]
                    first, times = _short_runs(own)
                    head = np.int64(len(first)).tobytes() + t[own[first]].astype("<i8").tobytes() + times.tobytes()
                    rows.append((int(bucket[s]), 0, head + _five(grams[s : s + m]).tobytes()))
                yield batch(rows)
        trim()

    def count(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a bucket: each text's members that other texts have, with the bits of their number, by bucket of the text."""
        packs, out = [], []
        for b in tables:
            for kind, payload in zip(b.column("kind").to_pylist(), b.column("payload"), strict=True):
                raw = payload.as_buffer()
                if kind:
                    out.append((key[0].as_py(), kind, raw.to_pybytes()))
                    continue
                m = int(np.frombuffer(raw, "<i8", 1)[0])
                packs.append((np.frombuffer(raw, "<i8", m, 8), np.frombuffer(raw, np.uint8, m, 8 + 8 * m), np.frombuffer(raw, np.uint8, offset=8 + 9 * m).reshape(-1, 5)))
        for i in range(0, len(out), 500):
            yield batch(out[i : i + 500])

        def sent() -> Iterator[tuple[int, int, bytes]]:
            t, five, bits = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.lexsort((t, t % n_homes))
            t = t[order]
            for s, m in zip(*_runs(t % n_homes), strict=True):
                own, at = t[s : s + m], order[s : s + m]
                first, times = _short_runs(own)
                head = np.array([len(first), key[0].as_py()], "<i8").tobytes() + own[first].astype("<i8").tobytes() + times.tobytes()
                yield int(own[0] % n_homes), 0, head + bits[at].tobytes() + five[at].tobytes()

        # by a range of the members' highest byte at a time; what is common waits for as many as a text's head pays for
        found = []
        for i in range(passes if packs else 0):
            ts, hs = [], []
            for t, times, five in packs:
                own = np.flatnonzero(five[:, 4].astype(np.int64) * passes >> 8 == i)
                ts.append(np.repeat(t, times)[own])
                hs.append(_eight(five[own].ravel()))
            t, h = np.concatenate(ts), np.concatenate(hs)
            ts.clear(), hs.clear()
            order = np.lexsort((t, h))
            t, h = t[order], h[order]
            del order
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            t, h = t[new], h[new]
            start, df = _runs(h)
            df = np.repeat(df, df)
            t, h, df = t[df > 1], h[df > 1], df[df > 1]
            found.append((t, _five(h), np.minimum(_HOT - 1, np.frexp(df)[1]).astype(np.uint8)))
            if i == passes - 1 or sum(len(x) for x, _, _ in found) > bucket_words:
                rows = sent()
                while some := list(islice(rows, 500)):
                    yield batch(some)
        packs.clear()
        trim()

    def gather(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the texts of a bucket: size, and where enough of the set is common, its common members in order and how many of these must meet."""
        t0, n0, ts, vs, bs = [], [], [], [], []
        for b in tables:
            for kind, payload in zip(b.column("kind").to_pylist(), b.column("payload"), strict=True):
                raw = payload.as_buffer()
                if kind == 1:
                    x = np.frombuffer(raw, "<i8").reshape(2, -1)
                    t0.append(x[0]), n0.append(x[1])
                    continue
                if kind == 2:
                    x = np.frombuffer(raw, "<i8").reshape(2, -1)
                    ts.append(x[0]), vs.append(x[1].view(np.uint64)), bs.append(np.full(x.shape[1], _HOT, np.uint8))
                    continue
                m, bucket = np.frombuffer(raw, "<i8", 2)
                times = np.frombuffer(raw, np.uint8, m, 16 + 8 * m)
                size = int(times.sum())
                ts.append(np.repeat(np.frombuffer(raw, "<i8", m, 16), times))
                bs.append(np.frombuffer(raw, np.uint8, size, 16 + 9 * m))
                vs.append(_eight(np.frombuffer(raw, np.uint8, offset=16 + 9 * m + size)) | U(int(bucket) << 40))
        t0, at = np.unique(np.concatenate(t0), return_index=True)
        n0 = np.concatenate(n0)[at]
        common, members = np.zeros(len(t0), np.int64), [b""] * len(t0)
        if ts:
            t, v, bits = np.concatenate(ts), np.concatenate(vs), np.concatenate(bs)
            ts.clear(), vs.clear(), bs.clear()
            order = np.lexsort((v, bits, t))
            t, v = t[order], v[order]
            del order, bits
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
            t, v = t[fresh], v[fresh]
            start, times = _runs(t)
            at = np.searchsorted(t0, t[start])
            common[at] = times
            alive = 100 * common >= near * n0
            for i, s, m in zip(at.tolist(), start.tolist(), times.tolist(), strict=True):
                if alive[i]:
                    members[i] = v[s : s + m].tobytes()
            del t, v, fresh
        alive = (100 * common >= near * n0) & (common > 0)
        must = np.where(alive, n0 - (near * n0 + 99) // 100 + 1 - (n0 - common), 0)
        for s in range(0, len(t0), 1000):
            z = slice(s, s + 1000)
            yield pa.RecordBatch.from_arrays([pa.array(t0[z]), pa.array(n0[z].astype(np.int32)), pa.array(must[z].astype(np.int32)), pa.array(common[z].astype(np.int32)), pa.array([m or None for m in members[z]], pa.binary())], ["t", "n", "must", "common", "members"])
        members.clear()
        trim()

    dealt = keyed.mapInArrow(deal, pack_kind)
    counted = dealt.repartition(n_homes, "bucket").groupBy("bucket").applyInArrow(count, pack_kind)
    return stored(counted.repartition(n_homes, "bucket").groupBy("bucket").applyInArrow(gather, "t long, n int, must int, common int, members binary"), "sets")


def _groups(batches, key: tuple[str, ...], rest: tuple[str, ...]):
    """Rows that follow each other with one key, as lists."""
    last, held = None, []
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in key + rest], strict=True):
            if row[: len(key)] != last and held:
                yield last, held
                held = []
            last = row[: len(key)]
            held.append(row[len(key) :])
    if held:
        yield last, held


def _members(raw: bytes) -> np.ndarray:
    return np.sort(np.frombuffer(raw, "<u8"))


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def cell_links(held: list[tuple], near: int, every: bool) -> list[tuple[int, int]]:
    """Links of a cell's ``t, n, members``: of each text with the least of its component, or of ``every`` pair."""
    if len(held) < 2:
        return []
    held.sort(key=lambda r: r[0])
    rows, n = [_members(m) for _, _, m in held], np.array([r[1] for r in held])
    if not every:
        return [(held[i][0], held[r][0]) for i, r in enumerate(region_join(rows, n, near).tolist()) if i != r]
    csr, out = Csr(rows), []
    for i, row in enumerate(rows):
        both = csr.find(row)
        out += [(held[i][0], held[j][0]) for j in np.flatnonzero(100 * both >= near * (n + n[i] - both)).tolist() if j > i]
    return out


def pivot_round(big: DataFrame, number: int, near: int, most: int, most_members: int, pivots: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``cell, docs, held, t, n, members`` of large cells to the links that pivots find, ``cell, t`` of what no pivot covers, and the stored table both are read from."""
    eps, slack = 1 - near / 100, 1e-9
    fill = F.ceil(F.greatest(F.col("docs") / most, F.col("held") / most_members)).cast("int")
    draw = F.xxhash64("t", F.lit(number))
    # half are texts with the largest share of common members, as near the middle of a crowd as any, half any; none of so many members that a part would not hold them
    fit = big.filter(F.octet_length("members") <= 8 * most_members // pivots).withColumn("share", F.octet_length("members") / F.col("n"))
    best = lambda *order: fit.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(*order))).filter(F.col("place") <= pivots // 2).drop("place")
    drawn = best(F.desc("share"), draw, "t").unionByName(best(draw, "t")).dropDuplicates(["cell", "t"])
    dealt = drawn.select("cell", F.explode(F.sequence(F.lit(0), fill - 1)).alias("part"), F.lit(0).alias("kind"), "t", "n", "members")
    rows = dealt.unionByName(big.select("cell", F.pmod(F.xxhash64("t", "cell"), fill).cast("int").alias("part"), F.lit(1).alias("kind"), "t", "n", "members"))

    def assigned(batches):
        for (cell, _), held in _groups(batches, ("cell", "part"), ("kind", "t", "n", "members")):
            tops = [r for r in held if r[0] == 0]
            docs = [r for r in held if r[0] == 1]
            out = {c: [] for c in ("cell", "pivot", "far", "t", "n", "members")}

            def put(pivot, far, r, keep, cell=cell, out=out):
                for c, v in zip(out, (cell, pivot, far, r[1], r[2], r[3] if keep else None), strict=True):
                    out[c].append(v)

            csr, size = Csr([_members(r[3]) for r in tops]), np.array([r[2] for r in tops])
            for r in docs:
                both = csr.find(_members(r[3])) if tops else np.zeros(0)
                union = size + r[2] - both
                inside = np.flatnonzero(100 * both >= near * union)
                until = int(inside[0]) if len(inside) else len(tops)
                far = 1 - both / np.maximum(1, union)
                for j in np.flatnonzero(far[:until] <= 2 * eps + slack).tolist():
                    put(tops[j][1], float(far[j]), r, True)
                put(tops[until][1] if len(inside) else None, float(far[until]) if len(inside) else None, r, len(inside))
            yield pa.RecordBatch.from_arrays([pa.array(out["cell"], pa.int64()), pa.array(out["pivot"], pa.int64()), pa.array(out["far"], pa.float64()), pa.array(out["t"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["members"], pa.binary())], list(out))

    found = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "t").mapInArrow(assigned, "cell long, pivot long, far double, t long, n int, members binary")
    found = stored(found, "balls")
    inside = (F.col("far") <= eps + slack) & F.col("pivot").isNotNull()
    links = found.filter(inside).select(F.col("t").alias("a"), F.col("pivot").alias("b")).filter("a <> b")
    rest = found.filter("pivot is null").select("cell", "t")
    # a ball meets its window in tasks of bounded size; where the ball ends too early for any of its window there is nothing to meet
    part = lambda name, size: F.pmod(F.xxhash64("t", F.lit(name)), F.ceil(F.col(size) / most)).cast("int")
    sizes = found.filter("pivot is not null").groupBy("cell", "pivot").agg(F.count_if(inside).alias("balls"), F.count_if(~inside).alias("windows"), F.max(F.when(inside, F.col("far"))).alias("reach")).filter("balls > 0 and windows > 0")
    both = found.join(sizes, ["cell", "pivot"])
    every = lambda size: F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / most).cast("int") - 1))
    ball = both.filter(inside).withColumn("i", part("i", "balls")).withColumn("j", every("windows"))
    window = both.filter(~inside & (F.col("far") <= F.col("reach") + eps + slack)).withColumn("j", part("j", "windows")).withColumn("i", every("balls"))
    cols = ["cell", "pivot", "i", "j", "far", "t", "n", "members"]
    tasks = ball.select(*cols, F.lit(0).alias("kind")).unionByName(window.select(*cols, F.lit(1).alias("kind")))

    def met(batches):
        for _, held in _groups(batches, ("cell", "pivot", "i", "j"), ("kind", "far", "t", "n", "members")):
            inner, outer, out = [r for r in held if r[0] == 0], [r for r in held if r[0] == 1], []
            if inner and outer:
                csr, n, far = Csr([_members(r[4]) for r in inner]), np.array([r[3] for r in inner]), np.array([r[1] for r in inner])
                for r in outer:
                    shared = csr.find(_members(r[4]))
                    hit = np.flatnonzero((far >= r[1] - eps - slack) & (100 * shared >= near * (n + r[3] - shared)))
                    if len(hit):  # all of a ball are one component
                        out.append((r[2], inner[hit[0]][2]))
            yield _links(out)

    crossed = tasks.repartition("cell", "pivot", "i", "j").sortWithinPartitions("cell", "pivot", "i", "j", "kind").mapInArrow(met, "a long, b long")
    return links.unionByName(crossed), rest, found


def part_links(cells: DataFrame, near: int, most: int, most_members: int, every: bool) -> DataFrame:
    """``cell, docs, held, t, n, members`` to links: a small cell is one task, of a large one all pairs of parts are."""
    fill = F.ceil(F.greatest(F.col("docs") / most, F.col("held") / most_members))
    cells = cells.withColumn("parts", F.when(fill > 1, 2 * fill).otherwise(1).cast("int"))
    part = F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != part), lambda x: F.struct(F.least(x, part).alias("i"), F.greatest(x, part).alias("j"))))
    tasks = cells.select("cell", "t", "n", "members", F.explode(pairs).alias("p")).select("cell", "p.i", "p.j", "t", "n", "members")

    def joined(batches):
        for _, held in _groups(batches, ("cell", "i", "j"), ("t", "n", "members")):
            yield _links(cell_links(held, near, every))
        trim()

    return tasks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(joined, "a long, b long")


def _placed(cells: DataFrame, alive: DataFrame) -> DataFrame:
    """``cell, t`` with the cell's numbers of documents and members, stored: three numbers a text, its set stays where it is."""
    sizes = cells.join(alive.select("t", "common"), "t").groupBy("cell").agg(F.count("*").alias("docs"), F.sum("common").alias("held"))
    return stored(cells.join(sizes, "cell").select("cell", "t", "docs", "held"), "placed")


def set_links(sets: DataFrame, near: int, most: int, most_members: int, every: bool = False) -> tuple[DataFrame, bool]:
    """Links between the texts of :func:`sets_table`, ``a, b``, and whether each is with the least text of its component: true unless a region was large."""

    def firsts(batches):
        for b in batches:
            t, must = np.asarray(b.column("t")), np.asarray(b.column("must"))
            rows = [np.frombuffer(m.as_buffer(), "<i8", k) for m, k in zip(b.column("members"), must.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t, must)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))], ["t", "v"])

    alive = sets.filter("must > 0")
    first = stored(alive.select("t", "must", "members").mapInArrow(firsts, "t long, v long"), "firsts")
    least = first.groupBy("v").agg(F.min("t").alias("m"), F.count("*").alias("c")).filter("c > 1").select("v", "m")
    region = stored(components(first.join(least, "v").select(F.col("t").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()), "regions")
    large = (F.col("docs") > most) | (F.col("held") > most_members)
    placed = _placed(region.select(F.col("root").alias("cell"), F.col("node").alias("t")), alive)
    full = lambda which: placed.filter(which).join(alive.select("t", "n", "members"), "t").select("cell", "docs", "held", "t", "n", "members")
    links = part_links(full(F.lit(True) if every else ~large), near, most, most_members, every)
    number, found, held = 0, [], [first, region, placed]
    while not every and not placed.filter(large).isEmpty():
        if number == 5:
            found.append(part_links(full(large), near, most, most_members, False))
            break
        if number == 2:  # texts that link share a first member
            again = first.join(placed.filter(large).select("t").distinct(), "t").select("t", "v")
            cells = again.join(again.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1").select("v"), "v").select(F.col("v").alias("cell"), "t")
        else:
            big = stored(full(large), "large")
            crossed, cells, balls = pivot_round(big, number, near, most, most_members)
            found.append(crossed)
            held += [big, balls]
        placed, number = _placed(cells, alive), number + 1
        held.append(placed)
        found.append(part_links(full(~large), near, most, most_members, False))
    for f in found:
        links = links.unionByName(f)
    links = stored(links, "links")
    for table in held:
        dropped(table)
    return links, not found


def link_sets(docs: DataFrame, k: int = 5, near: int = 75, bucket_words: int = 2_000_000, most: int = 5_000, most_members: int = 2_000_000, hot: int = 50_000, copies: int = 32) -> DataFrame:
    """``doc_id, text`` to ``t, n, comp``: of each distinct text (by hash ``t``) the set's size and its component, the smallest
    ``t`` linked to it."""
    sets = sets_table(docs, k, near, bucket_words, hot, copies)
    links, stars = set_links(sets, near, most, most_members)
    if stars:
        found = links.select(F.col("a").alias("t"), F.col("b").alias("comp"))
    else:  # links of different tasks of a region may share texts
        found = components(links).select(F.col("node").alias("t"), F.col("root").alias("comp"))
    out = stored(sets.select("t", "n").join(found, "t", "left").select("t", "n", F.coalesce("comp", "t").alias("comp")), "linked")
    for table in (sets, links):
        dropped(table)
    return out


def link_pairs(docs: DataFrame, k: int = 5, near: int = 75, bucket_words: int = 2_000_000, most: int = 5_000, most_members: int = 2_000_000, hot: int = 50_000, copies: int = 32) -> DataFrame:
    """``text`` to ``a, b``: every linked pair of different texts, by hash, ``a < b``. As many rows as there are links, so the square of a
    group of near copies; :func:`near_duplicates` has their components for the cost of a pass."""
    links, _ = set_links(sets_table(docs, k, near, bucket_words, hot, copies), near, most, most_members, every=True)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, near: int = 75, **limits: int) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_shingles, component_id``, and ``t, comp`` by which rows of equal text and set can be told."""
    linked = link_sets(docs, k, near, **limits)
    ids = docs.select("doc_id", text_hash(F.col("text")).alias("t")).join(linked, "t")
    ids = stored(ids.select("doc_id", "t", F.col("n").cast("long").alias("n_shingles"), "comp"), "members")
    dropped(linked)
    least = ids.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return ids.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "t", "comp")
