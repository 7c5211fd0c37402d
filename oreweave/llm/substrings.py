"""Operator 5, substring dedup by prefix-partitioned suffix trees.

A window is ``window`` (35) consecutive words of one text; words that a window covers go if its words start anywhere else. Every
window has an anchor: the leftmost of its runs of ``prefix`` (8) words with the smallest hash; equal windows have equal anchors
in equal places, so anchors split all suffixes into groups without loss. Neighbouring suffixes with one anchor form a segment,
which is stored once with the number of its copies.

Prefixes have variable length. A group of more than ``hot`` different segments is split by a longer one: of the windows that
share a run of m words each holds half of the missing words either after or before the run, so the run grows to one side
or the other, 8, 22, 29, 32 and so on, and a segment goes on in two groups. That ends at the latest where the prefix is the whole
window. A group with a single segment is a tree of one path, whose leaves are its copies. All others are read, one text for
each segment, and become suffix trees: suffixes in order with the common prefix of neighbours. A deep internal node, of depth
``window`` or more, is a maximal repeat, and the leaves below the deep nodes nearest the root are the starts that repeat.

Segments are compared by their prefix's and their own hash, 128 bits together, prefixes by 64; in trees the words themselves are.

Edge cases. A null text has no words, as an empty one. A text of fewer words than a window loses none. Copies and rows that
repeat lose all words covered by a window; no occurrence of a repeat is kept, so ties need no order. A long text is cut in
segments like any other, and a tree takes segments, not texts. An empty table gives an empty result. Columns but ``doc_id``
and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_hash
from .packed import P2, Packed, Rolling, mix, signed, slices

U = np.uint64
_SECOND = U(0xA24BAED4963EE407)
#: Segments gathered before their subtrees are built.
GATHER = 4000


def segments(p: Packed, window: int, prefix: int) -> dict[str, np.ndarray]:
    """Of each segment: hash of its anchor, first start as a word index, how far on the anchor is, number of starts and hash of its words."""
    words = p.word_hashes()
    n, runs = len(words), window - prefix + 1
    starts = np.flatnonzero(np.arange(n) + window <= p.first[p.doc + 1]) if n else np.zeros(0, int)
    if not len(starts):
        return {k: np.zeros(0, t) for k, t in (("gram", np.uint64), ("start", np.int64), ("u", np.int64), ("n", np.int64), ("h", np.uint64))}
    at = np.arange(n - prefix + 1)
    least = Rolling(words).of(at, at + prefix)
    place = at.copy()
    done = 1
    while done < runs:  # the smallest of the next ``done`` runs, the leftmost of equals
        ahead = min(done, runs - done)
        left, right = least[: len(least) - ahead], least[ahead:]
        place = np.where(right < left, place[ahead:], place[: len(left)])
        least = np.minimum(left, right)
        done += ahead
    anchor, gram = place[starts], least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    n_starts = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    end = begin + n_starts - 1 + window
    return {"gram": gram[first], "start": begin, "u": anchor[first] - begin, "n": n_starts, "h": Rolling(mix(words + _SECOND), P2).of(begin, end)}


class Subtree:
    """Suffix tree of some segments, as the order of its leaves and the depth of the node between each and the one before.

    ``ids``: words as numbers, segments end to end, bounded by ``bounds``; ``starts``: number of window starts of each, at its head,
    which are the leaves; ``times``: how many copies each leaf stands for.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, starts: np.ndarray, times: np.ndarray):
        n, segment = len(starts), np.repeat(np.arange(len(starts)), starts)
        # an end mark of its own after each segment
        at = np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))
        names = np.empty(len(ids) + n, np.int64)
        names[at] = ids + n
        names[bounds[1:] + np.arange(n)] = np.arange(n)
        self.leaf = bounds[:-1][segment] + segment + np.arange(len(segment)) - np.repeat(np.cumsum(starts) - starts, starts)
        self.times = np.asarray(times)[segment]
        # names of the runs of 1, 2, 4 ... words from each place, in order of their words
        levels, depth, longest = [np.unique(names, return_inverse=True)[1]], 1, int(np.diff(bounds).max(initial=0)) + 1
        while depth < longest:
            now = levels[-1]
            after = np.concatenate((now[depth:] + 1, np.zeros(min(depth, len(now)), np.int64)))
            levels.append(np.unique(now * (len(now) + 2) + after, return_inverse=True)[1])
            depth *= 2
        self.order = np.argsort(levels[-1][self.leaf], kind="stable")
        a, b = self.leaf[self.order[:-1]].copy(), self.leaf[self.order[1:]].copy()
        self.depth = np.zeros(max(0, len(self.leaf) - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (a < len(names)) & (b < len(names))
            same[same] = levels[k][a[same]] == levels[k][b[same]]
            self.depth += same << k
            a, b = a + (same << k), b + (same << k)

    def repeats(self, window: int) -> np.ndarray:
        """Which leaves hang below a node of depth ``window`` or more, or stand for several copies."""
        deep = self.depth >= window
        twice = self.times > 1
        twice[self.order[:-1][deep]] = True
        twice[self.order[1:][deep]] = True
        return twice

    def nodes(self, window: int) -> list[tuple[int, np.ndarray]]:
        """The internal nodes of depth ``window`` or more, each a maximal repeat: its depth and its leaves."""
        out, open_ = [], []
        for i, d in enumerate([*self.depth.tolist(), 0]):
            begin = i
            while open_ and open_[-1][0] > d:
                depth, begin = open_.pop()
                out.append((depth, np.sort(self.order[begin : i + 1])))
            if d >= window and (not open_ or open_[-1][0] < d):
                open_.append((d, begin))
        return out


def _texts(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
    return ids, np.concatenate(([0], np.cumsum([len(ws) for ws in words])))


def halves(n: int, u: int, m: int, window: int) -> list[tuple[int, int, int, int]]:
    """A segment of ``n`` windows that share the run of ``m`` words at ``u``, split by a longer run: first window, number of windows,
    and start and length of the run. Windows with enough words after the run have it grow there, all others ahead."""
    grow = (window - m + 1) // 2
    behind = max(0, min(n, u + m + grow - window))  # so many windows end too early
    out = []
    if behind < n:
        out.append((behind, n - behind, u, m + grow))
    if behind:
        ahead = window - m + 1 - grow
        out.append((0, behind, u - ahead, m + ahead))
    return out


_KEY = ["gram", "h", "n"]
_ROW = "gram long, h long, n int, times long, words string, u int, m int"
_FOUND = "gram long, h long, n int, at array<int>"


def _grow(rows: dict[str, list], window: int) -> pa.RecordBatch:
    """Windows of several groups' segments that repeat: suffixes with different prefixes share no node so deep, so one tree will do."""
    ids, bounds = _texts([w.encode().split() for w in rows["words"]])
    n = np.array(rows["n"])
    twice = Subtree(ids, bounds, n, np.array(rows["times"])).repeats(window)
    ends = np.cumsum(n)
    found = [np.flatnonzero(twice[e - k : e]).tolist() for e, k in zip(ends, n, strict=True)]
    keep = [i for i, f in enumerate(found) if f]
    cols = {c: [rows[c][i] for i in keep] for c in _KEY} | {"at": [found[i] for i in keep]}
    return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(cols.items(), [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())], strict=True)})


def tree_repeats(rows: DataFrame, window: int, hot: int) -> DataFrame:
    """``rows``: different segments of groups that have several, with ``classes``, the number in their group, to the windows that repeat."""

    def trees(batches):
        held: dict[str, list] = {c: [] for c in (*_KEY, "times", "words")}
        for b in batches:
            for c in held:
                held[c] += b.column(c).to_pylist()
            while len(held["gram"]) >= GATHER:  # as many whole groups as fill a gathering; the last one may go on
                grams = held["gram"]
                end = GATHER
                while end < len(grams) and grams[end] == grams[end - 1]:
                    end += 1
                if end == len(grams):
                    break
                yield _grow({c: v[:end] for c, v in held.items()}, window)
                held = {c: v[end:] for c, v in held.items()}
        if held["gram"]:
            yield _grow(held, window)

    def lengthen(batches):
        types = dict(gram=pa.int64(), h=pa.int64(), n=pa.int32(), off=pa.int32(), gram2=pa.int64(), h2=pa.int64(), n2=pa.int32(), times=pa.int64(), words=pa.string(), u=pa.int32(), m=pa.int32())
        for b in batches:
            words = b.column("words")
            keys = {c: b.column(c).to_pylist() for c in (*_KEY, "times", "u", "m")}
            out: dict[str, list] = {c: [] for c in types}
            for i, j, p in slices(words):
                hashes, raw = p.word_hashes(), p.data.tobytes()
                one, two, parts = Rolling(hashes), Rolling(mix(hashes + _SECOND), P2), []
                for k in range(i, j):
                    base = int(p.first[k - i])
                    for off, n2, u2, m2 in halves(keys["n"][k], keys["u"][k], keys["m"][k], window):
                        a = base + off
                        z = a + n2 - 1 + window
                        parts.append((a, z, base + u2, base + u2 + m2))
                        row = {c: keys[c][k] for c in (*_KEY, "times")} | {"off": off, "n2": n2, "u": u2 - off, "m": m2, "words": raw[p.starts[a] : p.ends[z - 1]].decode()}
                        for c, v in row.items():
                            out[c].append(v)
                x = np.array(parts, np.int64).reshape(-1, 4)
                out["gram2"] += signed(one.of(x[:, 2], x[:, 3])).tolist()
                out["h2"] += signed(two.of(x[:, 0], x[:, 1])).tolist()
            yield pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in out.items()})

    small = (F.col("classes") <= hot) | (F.col("m") >= window)
    cold = rows.filter(small).select(*_KEY, "times", "words").repartition("gram").sortWithinPartitions("gram").mapInArrow(trees, _FOUND)
    heat = rows.filter(~small)
    if heat.isEmpty():
        return cold
    links = stored(heat.select(*_KEY, "times", "words", "u", "m").mapInArrow(lengthen, "gram long, h long, n int, off int, gram2 long, h2 long, n2 int, times long, words string, u int, m int"), "longer")
    longer = links.groupBy(F.col("gram2").alias("gram"), F.col("h2").alias("h"), F.col("n2").alias("n")).agg(F.sum("times").alias("times"), F.first("words").alias("words"), F.first("u").alias("u"), F.first("m").alias("m"))
    longer = stored(longer.join(longer.groupBy("gram").agg(F.count("*").alias("classes")), "gram"), "longer-classes")
    path = longer.filter("classes = 1 and times > 1").select(*_KEY, F.sequence(F.lit(0), F.col("n") - 1).alias("at"))
    below = path.unionByName(tree_repeats(longer.filter("classes > 1"), window, hot)).select(F.col("gram").alias("gram2"), F.col("h").alias("h2"), F.col("n").alias("n2"), F.col("at").alias("below"))
    back = links.select(*_KEY, "off", "gram2", "h2", "n2").join(below, ["gram2", "h2", "n2"]).select(*_KEY, F.transform("below", lambda x: x + F.col("off")).alias("at"))
    return cold.unionByName(back)


def dedup_substrings(docs: DataFrame, window: int = 35, prefix: int = 8, hot: int = 5000) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_words, n_removed, removed, kept``: ``removed`` are the spans of words taken out (first, and one
    past the last), ``kept`` is the rest, joined by one space."""
    keyed = docs.select("doc_id", "text", text_hash(F.col("text")).alias("t1"), text_hash(F.col("text"), 1).alias("t2"))

    def cut(batches):
        for b in batches:
            t1, t2 = (np.asarray(b.column(c)) for c in ("t1", "t2"))
            for i, _, p in slices(b.column("text")):
                s = segments(p, window, prefix)
                doc = p.doc[s["start"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(s["gram"])), pa.array(signed(s["h"])), pa.array(s["n"].astype(np.int32)), pa.array(t1[i + doc]), pa.array(t2[i + doc]), pa.array((s["start"] - p.first[doc]).astype(np.int32)), pa.array(s["u"].astype(np.int32))],
                    [*_KEY, "t1", "t2", "s", "u"],
                )

    segs = stored(keyed.select("text", "t1", "t2").mapInArrow(cut, "gram long, h long, n int, t1 long, t2 long, s int, u int"), "segments")
    classes = segs.groupBy(*_KEY).agg(F.count("*").alias("times"), F.first("t1").alias("t1"), F.first("t2").alias("t2"), F.first("s").alias("s"), F.first("u").alias("u"))
    shared = classes.groupBy("gram").agg(F.count("*").alias("classes"))
    meet = classes.join(shared.filter("classes > 1"), "gram")
    wanted = meet.groupBy("t1", "t2").agg(F.collect_list(F.struct(*_KEY, "times", "s", "u", "classes")).alias("segs"))
    texts = keyed.groupBy("t1", "t2").agg(F.first("text").alias("text"))

    def fetch(batches):
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        for b in batches:
            lists = b.column("segs")
            for i, j, p in slices(b.column("text")):
                rows = [(k, r) for k in range(i, j) for r in lists[k].as_py()]
                raw = p.data.tobytes()
                begin = [p.first[k - i] + r["s"] for k, r in rows]
                out = {c: [r[c] for _, r in rows] for c in (*_KEY, "times")}
                out["words"] = [raw[p.starts[a] : p.ends[a + r["n"] - 2 + window]].decode() for a, (_, r) in zip(begin, rows, strict=True)]
                out |= {c: [r[c] for _, r in rows] for c in ("u", "classes")}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    read = wanted.join(texts, ["t1", "t2"]).select("segs", "text").mapInArrow(fetch, "gram long, h long, n int, times long, words string, u int, classes long")
    read = stored(read.withColumn("m", F.lit(prefix)), "subtrees")
    path = classes.filter("times > 1").join(read.select("gram").distinct(), "gram", "left_anti").select(*_KEY, F.lit(None).cast("array<int>").alias("at"))
    repeats = path.unionByName(tree_repeats(read, window, hot))
    marks = segs.join(repeats, _KEY).groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "n", "at")).alias("marks"))

    def finish(batches):
        spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for b in batches:
            marks, out = b.column("marks"), {"n_words": [], "n_removed": [], "removed": [], "kept": []}
            for i, j, p in slices(b.column("text")):
                raw = p.data.tobytes()
                edge = np.zeros(len(p.doc) + 1, np.int64)
                for k in range(i, j):
                    for m in marks[k].as_py() or ():
                        a = p.first[k - i] + m["s"]
                        if m["at"] is None:
                            edge[a] += 1
                            edge[a + m["n"] - 1 + window] -= 1
                        else:
                            at = a + np.asarray(m["at"])
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                for k in range(j - i):
                    a, z = p.first[k], p.first[k + 1]
                    stay = np.flatnonzero(~gone[a:z]) + a
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:z].view(np.int8), [0]))))
                    out["n_words"].append(int(z - a))
                    out["n_removed"].append(int(z - a - len(stay)))
                    out["removed"].append([{"first": x, "last": y} for x, y in turns.reshape(-1, 2).tolist()])
                    out["kept"].append(b" ".join([raw[x:y] for x, y in zip(p.starts[stay].tolist(), p.ends[stay].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.int64(), pa.int64(), spans, pa.string()), strict=True)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = keyed.join(marks, ["t1", "t2"], "left").select("doc_id", "text", "marks")
    return done.mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, removed array<struct<first: int, last: int>>, kept string")
