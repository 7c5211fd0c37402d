import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreweave.llm import components, decontaminate, jaccard, langid, lines, mixing, packed, pii, quality, stages, substrings, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    rng = random.Random(5)
    base = " ".join(words(rng, 120))
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 3), (1, base, "en", "a", 3), (2, base, "en", None, None), (3, " ".join(near), None, "b", 1), (4, None, "en", "a", 0), (5, "", "fr", "b", 0), (6, " \n\t", None, None, None),
        (None, base, "en", "a", 1), (None, None, None, None, None), (7, "one two", "en", "c", 7), (8, "ONE two", "en", "d", 7), (9, "x" * 5000 + " " + " ".join(words(rng, 3000)), "en", "a", 1), (10, "12 34 !!", "en", "b", 1),
        (11, "line of five whole words\n" + base + "\nline of five whole words", "en", "c", 1), (12, "été straße " * 40, "fr", "d", 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("h1", F.lit(1)).withColumn("t", F.lit(2)).withColumn("score", F.lit("s"))


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_packed_words_and_hashes():
    texts = ["a b  a", "", None, "\u00e9\u00e9 b\x1cc", " a\tb\n"]
    got = {}
    for i, _, p in packed.slices(pa.array(texts), limit=4):
        h = p.word_hashes()
        for k in range(len(p.doc)):
            got.setdefault(i + p.doc[k], []).append(h[k])
    want = [brute.WORDS.findall(t or "") for t in texts]
    assert [len(got.get(i, [])) for i in range(5)] == [len(w) for w in want]
    assert got[0][0] == got[0][2] == got[4][0] != got[0][1] == got[4][1]


@given(st.lists(st.text(alphabet="ab \n", max_size=30), max_size=6))
@settings(max_examples=50, deadline=None)
def test_sets_of(texts):
    for _, _, p in packed.slices(pa.array(texts, pa.string()), limit=1 << 30):
        doc, _ = jaccard.sets_of(p, 5)
        assert np.bincount(doc, minlength=len(texts)).tolist() == [len(brute.shingles(t)) for t in texts]


@given(st.integers(0, 10**6))
@settings(max_examples=25, deadline=None)
def test_region_join(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(rng.randrange(2, 25)):
        base = rng.choice(rows).tolist() if rows and rng.random() < 0.7 else rng.sample(range(60), rng.randrange(1, 20))
        rows.append(np.array(sorted({x if rng.random() > 0.08 else rng.randrange(60) for x in base}), np.uint64))
    n = np.array([len(r) for r in rows])
    root = list(range(len(rows)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(rows[i], rows[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert jaccard.region_join(rows, n).tolist() == [top(i) for i in range(len(rows))]


@pytest.mark.parametrize("at_once", [10**6, 0])
def test_components(spark, at_once):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    root = {}
    for a, b in edges:
        ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
        if ra is not rb:
            ra |= rb
            for x in rb:
                root[x] = ra
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), at_once=at_once).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: min(root[x]) for x in linked}


LIMITS = [{}, {"most": 3, "bucket_words": 50}, {"most_members": 300}, {"hot": 2, "copies": 1, "bucket_words": 1000}, {"most": 2, "most_members": 100, "hot": 3, "copies": 2}]


@pytest.mark.parametrize("limits", LIMITS)
def test_jaccard(spark, odd, none, limits):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd, **limits).collect())
    assert got == Counter(brute.jaccard(pairs(odd)))
    assert jaccard.near_duplicates(none, **limits).count() == 0


@pytest.mark.parametrize("limits", [LIMITS[0], LIMITS[4]])
def test_jaccard_of_documents(spark, sf_dir, limits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", F.lit(1)).withColumn("many", F.lit("x"))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, **limits).collect())
    assert got == Counter(brute.jaccard(pairs(docs)))


def chain(rng, n, length=60):
    """Texts of which each is a little farther from the first, in several crowds."""
    rows, base = [], []
    for i in range(n):
        if i % 40 == 0:
            base = words(rng, length, 10**6)
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            base = text
        rows.append((i, "common start of all texts here " * 2 + " ".join(text)))
    return rows


def test_heads_of_texts_are_fewer_than_members(spark, monkeypatch):
    """Members are dealt to few buckets, however few words are counted at once, and sets stay the same."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2 * 7 + j * (i // 2 + 1)) % 997}" for j in range(120))) for i in range(60)], "doc_id long, text string")
    heads, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a: heads.append(out := real(self, f, schema, *a)) or out if schema.startswith("bucket") else real(self, f, schema, *a))
    sets = jaccard.sets_table(docs, 5, 75, 200, 50_000, 32)
    rows = [r["payload"] for r in heads[0].filter("kind = 0").collect()]
    # eight bytes of a count, nine a head and five a member
    n = sum(int.from_bytes(p[:8], "little") for p in rows)
    members = sum((len(p) - 8 - 9 * int.from_bytes(p[:8], "little")) // 5 for p in rows)
    assert members > 8 * n
    want = jaccard.sets_table(docs, 5, 75, 2_000_000, 50_000, 32)
    # the members' numbers hold that of their bucket, so sizes are held against each other
    assert sorted(map(tuple, sets.select("t", "n", "must", "common").collect())) == sorted(map(tuple, want.select("t", "n", "must", "common").collect()))


@pytest.mark.parametrize("limits", [{"most": 10}, {"most": 5, "hot": 20}, {"most_members": 2000}])
def test_jaccard_of_large_regions(spark, limits):
    rows = chain(random.Random(11), 240)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, **limits).collect())
    assert got == Counter(brute.jaccard(rows))
    key = {r["t"]: r["text"] for r in docs.select("text", jaccard.text_hash(F.col("text")).alias("t")).collect()}
    found = [tuple(sorted((key[r["a"]], key[r["b"]]), reverse=True)) for r in jaccard.link_pairs(docs, **limits).collect()]
    assert len(found) == len(set(found)) and set(found) == brute.jaccard_pairs([t for _, t in rows])


def test_summary_finds_the_frequent():
    rng = np.random.default_rng(1)
    values = np.concatenate((np.repeat(np.arange(5, dtype=np.uint64), 400), rng.integers(10, 10**9, 4000).astype(np.uint64)))
    rng.shuffle(values)
    kept = jaccard.Summary(50)
    for x in np.array_split(values, 30):
        kept.add(x)
    count = dict(zip(kept.values.tolist(), kept.counts.tolist(), strict=True))
    assert len(count) <= 50 and all(400 - len(values) / 50 <= count[i] <= 400 for i in range(5))


def digests(df):
    return Counter(map(tuple, df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()))


@pytest.mark.parametrize("hot", [5000, 1, 0])
def test_substrings(spark, odd, none, hot):
    assert digests(substrings.dedup_substrings(odd, hot=hot)) == Counter(brute.substring_dedup(pairs(odd)))
    assert substrings.dedup_substrings(none).count() == 0


@pytest.mark.parametrize("hot", [5000, 3])
def test_substrings_of_documents(spark, sf_dir, hot):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t1", F.lit(1)).withColumn("marks", F.lit(2))
    cut = substrings.dedup_substrings(docs, hot=hot)
    assert digests(cut) == Counter(brute.substring_dedup(pairs(docs)))
    for r in cut.filter("n_removed > 0").join(docs.select("doc_id", "text"), "doc_id").collect():
        w = brute.WORDS.findall(r["text"])
        gone = {i for x in r["removed"] for i in range(x["first"], x["last"])}
        assert len(gone) == r["n_removed"] and " ".join(x for i, x in enumerate(w) if i not in gone) == r["kept"]


def test_substrings_of_one_word(spark):
    rows = [(1, "a " * 100), (2, "b " * 35), (3, "b " * 34), (4, " ".join(f"c{i}" for i in range(50)) + " x " + " ".join(f"c{i}" for i in range(40)))]
    for hot in (5000, 0):
        assert digests(substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)) == Counter(brute.substring_dedup(rows))


@given(st.integers(0, 10**6))
@settings(max_examples=20, deadline=None)
def test_segments_and_subtrees(seed):
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(0, 60), 3)) for _ in range(4)]
    window, prefix, groups = 7, 3, {}
    seen = Counter(tuple(t.split()[s : s + window]) for t in texts for s in range(max(0, len(t.split()) - window + 1)))
    for _, _, p in packed.slices(pa.array(texts), limit=1 << 30):
        s = substrings.segments(p, window, prefix)
        flat = [w for t in texts for w in t.split()]
        assert s["n"].sum() == sum(seen.values())
        for g, a, n, u in zip(s["gram"].tolist(), s["start"].tolist(), s["n"].tolist(), s["u"].tolist(), strict=True):
            groups.setdefault(g, []).append((a, n))
            todo = [(a, n, u, prefix)]
            while todo:  # longer runs are in all windows of their part, and the parts are the whole
                a, n, u, m = todo.pop()
                assert 0 <= u and all(b <= a + u and a + u + m <= b + window for b in range(a, a + n))
                if m < window:
                    parts = substrings.halves(n, u, m, window)
                    assert sorted(x for off, k, _, _ in parts for x in range(off, off + k)) == list(range(n))
                    todo += [(a + off, k, u2 - off, m2) for off, k, u2, m2 in parts]
        for parts in groups.values():
            numbers = {}
            ids = [np.array([numbers.setdefault(w, len(numbers)) for w in flat[a : a + n - 1 + window]]) for a, n in parts]
            n = np.array([x for _, x in parts])
            tree = substrings.Subtree(np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids]))), n, np.ones(len(n), int))
            assert tree.repeats(window).tolist() == [seen[tuple(flat[b : b + window])] > 1 for a, m in parts for b in range(a, a + m)]
            # suffixes by their common prefixes, every pair
            ends = [(b, a + m - 1 + window) for a, m in parts for b in range(a, a + m)]
            common = lambda x, y: next((i for i in range(min(x[1] - x[0], y[1] - y[0])) if flat[x[0] + i] != flat[y[0] + i]), min(x[1] - x[0], y[1] - y[0]))
            want = {(d, tuple(j for j in range(len(ends)) if j == i or common(ends[i], ends[j]) >= d)) for i in range(len(ends)) for d in {common(ends[i], ends[j]) for j in range(len(ends)) if j != i} if d >= window}
            assert {(d, tuple(x.tolist())) for d, x in tree.nodes(window)} == want


def test_mixing(spark, odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count()
    total = sum(r["size"] for r in rows)
    by = {r["source"]: r for r in rows}
    assert abs(sum(r["target"] for r in by.values()) - total) < 1e-6 * max(1, total)
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 and r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(odd).collect()))
    assert mixing.mix_sources(none).count() == 0


def test_mix_is_made(spark, odd, none):
    rows = [(i, f"w{i} " * (1 + i % 9), "en", "abcd"[min(3, i % 7)], i) for i in range(60)] + [(60, None, "en", "a", 0), (61, "x", "en", None, 1)]
    for docs in (odd, spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("clash"))):
        columns = [c for c in docs.columns if c != "copy"]
        copies = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix_sources(docs).collect()}
        want = Counter()
        for r in docs.select(columns).collect():
            want.update({(str(r), k + 1): 1 for k in range(copies[r["doc_id"], r["source"]])})
        mixed = stages.mix(docs)
        assert mixed.columns == [*columns, "copy"]
        assert Counter((str(r["x"]), r["copy"]) for r in mixed.select(F.struct(*columns).alias("x"), "copy").collect()) == want
    assert 0 in copies.values() and max(copies.values()) > 1
    assert stages.mix(none).count() == 0


@given(st.lists(st.integers(0, 50), min_size=1, max_size=6))
@settings(max_examples=10, deadline=None)
def test_targets_by_resharing(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    weight = {i: i % 3 + 1 for i in range(len(sizes))}
    full = set()
    while True:
        rest = sum(sizes) - sum(3 * sizes[i] for i in full)
        share = {i: 3 * sizes[i] if i in full else rest * weight[i] / sum(weight[j] for j in weight if j not in full) for i in weight}
        over = {i for i in weight if i not in full and share[i] > 3 * sizes[i]}
        if not over:
            break
        full |= over
    assert all(abs(got[f"s{i}"] - share[i]) < 1e-6 for i in weight)


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pii(spark, odd, none):
    texts = ["mail ann.7@mail.example.com", "Ann: ann.7@mail.example.com", "card 4111111111111111", "4111-1111-1111-1111", "bad 4111111111111112", "+1 (017) 555-7713", "ip 10.0.0.255", "no 10.0.0.256", "on 2024-02-29", "no 2024-02-30", "29/02/2024", "123-45-6789", "000-45-6789", "k b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "plain 3.14 text", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_replaced", F.lit("clash"))
    out = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(df, "k").collect()}
    same = {4, 7, 9, 12, 14, 15, 16}
    for i, t in enumerate(texts):
        assert (out[i] == (t, 0)) == (i in same), (t, out[i])
        if t and i not in same | {8, 10}:
            shape = lambda x: re.sub("[a-z]", "a", re.sub("[0-9]", "9", x))
            assert i == 6 or shape(out[i][0]) == shape(t)
    assert out[0][0].split()[1] == out[1][0].split()[1]
    cards = [re.sub("[^0-9]", "", out[i][0]) for i in (2, 3)]
    assert cards[0] == cards[1] and luhn(cards[0])
    assert all(0 <= int(x) < 256 for x in out[6][0].split()[1].split("."))
    assert out[8][0][3:] != "2024-02-29"
    assert pii.pseudonymise(odd, "k").count() == odd.count() and pii.pseudonymise(none, "k").count() == 0
    assert pii.pseudonymise(df, "other").filter("doc_id = 2").first()["text"] != out[2][0]


def test_feistel_is_a_permutation(spark):
    got = spark.range(189 * 7).select(pii.feistel(F.array((F.col("id") / 7).cast("long"), F.col("id") % 7), F.array(F.lit(189).cast("long"), F.lit(7).cast("long")), "k", F.lit("t")).alias("v")).distinct()
    assert got.count() == 189 * 7


def test_lines(spark, odd, none):
    rows = [(i, f"own line {i} stays here\nshared by many sites\nshared by few sites" if i < 5 else f"own line {i} stays here\n  shared   by many sites\nonly {i % 3}", None, f"s{i % 12}", 1) for i in range(24)]
    df = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_removed"] == 0
    for i in range(1, 24):
        assert "shared by many" not in re.sub(" +", " ", out[i]["text"]) and out[i]["n_removed"] == 1
    assert "shared by few sites" in out[3]["text"]
    got = lines.dedup_lines(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert lines.dedup_lines(none).count() == 0


def test_lines_near_the_threshold(spark):
    rows = [(i * 1000 + s, f"line number {i} of many", None, f"s{s}", 1) for i in range(1, 40) for s in range(i % 20)]
    out = lines.spread_lines(spark.createDataFrame(rows, DOCS)).count()
    assert out == sum(i % 20 >= 10 for i in range(1, 40))


def test_quality(spark, odd, none):
    rows = quality.rate_quality(odd).collect()
    assert len(rows) == odd.count() and quality.rate_quality(none).count() == 0
    for (i, text), r in zip(sorted(pairs(odd), key=str), sorted(rows, key=lambda r: str((r["doc_id"],)))):
        if i is None or i == 1:
            continue
        r = next(x for x in rows if x["doc_id"] == i)
        w = brute.WORDS.findall(text or "")
        runs = Counter(zip(w, w[1:], w[2:]))
        hit = {k for s in range(len(w) - 2) if runs[tuple(w[s : s + 3])] > 1 for k in range(s, s + 3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))


def test_quality_depletion(spark):
    rng = random.Random(2)
    line = "the very same line of words again and again and again"
    rows = [(i, "\n".join([line] * 1 + [" ".join(words(rng, 60 if i % 2 else 3, 10**6))] + ([line] if i % 2 == 0 else [])) + "\n" + (" ".join(words(rng, 5)) if i % 2 else line + " x" * 0), None, "h", 1) for i in range(100)]
    kept = {r["doc_id"]: r for r in quality.rate_quality(spark.createDataFrame(rows, DOCS), min_words=5, most_repeated=1000).collect()}
    assert all(kept[i]["kept"] == (i % 2 == 1) for i in range(100))


def test_urls(spark):
    rules = [("com", "/en/"), ("example.com", "/en/7"), ("net", "/de/"), ("example.net", "/de/8"), ("org", "/es/")]
    said = dict(zip(rules, ["block", "allow", "allow", "block", "block"], strict=True))
    rows = [(1, "http://A.Example.COM/en/745?q#f"), (2, "https://example.com/en/8"), (3, "http://notexample.net/de/8"), (4, "x"), (5, None), (6, "http://example.net/de/8"), (6, "http://example.net/de/8"), (7, "ftp://org/es/?a"), (8, "http://corg/es/"), (None, "http://a.b.org#/es/"), (9, "http://com"), (10, "a://b://com/en/"), (11, "http://x.com/en/" + "p" * 5000)]
    got = Counter(map(tuple, urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)), urls.rules_table(spark)).collect()))
    want = Counter()
    for i, u in rows:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        fit = [(h, p) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        want[i, host, path, "".join(best) if best else None, said[best] if best else "allow"] += 1
    assert got == want
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), urls.rules_table(spark)).count() == 0


def test_decontaminate(spark, odd, none):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n, 5000))) for i, n in enumerate((13, 20, 35, 60, 3))] + [(50, None), (51, ""), (52, "same same same same same same same same")]
    docs = []
    for d in range(80):
        item = items[d % 5][1].split()
        for _ in range(d // 5 % 4):
            item[rng.randrange(len(item))] = "edited"
        if d % 7 == 3:
            item.insert(len(item) // 2, "inserted")
        docs.append((d, " ".join(words(rng, rng.randrange(0, 40), 5000) + [x.upper() if d % 2 else x for x in item] + words(rng, rng.randrange(0, 40), 5000))))
    docs += [(80, None), (81, ""), (82, "same " * 30), (83, " ".join(words(rng, 300, 5000))), (84, items[2][1][:-20])]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for d, t in docs:
        w = brute.WORDS.findall(brute.lower(t))
        for i, x in items:
            v = brute.WORDS.findall(brute.lower(x))
            if not v:
                continue
            k = min(5, len(v))
            if len(w) < k:
                continue
            best = 0
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[s : s + len(v)], k), grams(v, k)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.75:
                want[d, i] = round(best, 9)
    assert got == want
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_forward_backward():
    rng = np.random.default_rng(0)
    scores, first, start, moves = rng.normal(size=(150, 3)), np.array([0, 70, 70, 71, 150]), rng.normal(size=3), rng.normal(size=(3, 3))
    got = langid.posteriors(scores, first, start, moves)
    for a, b in zip(first, first[1:]):
        if b == a:
            continue
        fwd, back = [np.exp(start + scores[a])], [np.ones(3)]
        for t in range(a + 1, b):
            fwd.append((fwd[-1] @ np.exp(moves)) * np.exp(scores[t]))
            fwd[-1] /= fwd[-1].sum()
        for t in range(b - 1, a, -1):
            back.append(np.exp(moves) @ (back[-1] * np.exp(scores[t])))
            back[-1] /= back[-1].sum()
        both = np.array(fwd) * np.array(back[::-1])
        assert np.allclose(got[a:b], both / both.sum(axis=1, keepdims=True))


def test_code_switching():
    rng = random.Random(4)
    make = {"aa": lambda: "".join(rng.choice(["ka", "mo", "ri"]) for _ in range(3)), "bb": lambda: "".join(rng.choice(["ust", "elg", "orf"]) for _ in range(2))}
    texts = [(" ".join(make[x]() for _ in range(60)), x) for x in ("aa", "bb") for _ in range(20)]
    field = langid.train([t for t, _ in texts], [x for _, x in texts], epochs=15)
    mixed = " ".join([make["aa"]() for _ in range(30)] + [make["bb"]() for _ in range(10)])
    _, _, p = next(packed.slices(pa.array([mixed])))
    post = langid.posteriors(field.emissions(p), p.first, field.start, field.moves)
    assert post.argmax(axis=1).tolist() == [0] * 30 + [1] * 10


def test_training_goes_slice_by_slice(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(words(rng, rng.randrange(0, 40))) for _ in range(30)]
    whole = langid.train(texts, ["aa", "bb", "cc"] * 10, bits=10, epochs=3)
    seen, init = [], packed.Packed.__init__

    def noted(self, data, *args, **more):
        seen.append(len(data))
        init(self, data, *args, **more)

    monkeypatch.setattr(packed.Packed, "__init__", noted)
    monkeypatch.setattr(packed.slices, "__defaults__", (400, False))
    parts = langid.train(texts, ["aa", "bb", "cc"] * 10, bits=10, epochs=3)
    assert max(seen) <= 400
    assert np.allclose(whole.weights, parts.weights) and np.array_equal(whole.lexicon, parts.lexicon) and np.allclose(whole.moves, parts.moves)


def test_sizes_of_samples(spark):
    docs = spark.range(12000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 2 = 0, 'aa', 'bb') as lang")
    assert Counter(toxicity.sample(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic"))[1]) == {1: 1500, 0: 3000}
    assert Counter(langid.sample(docs)[1]) == {"aa": 150, "bb": 150}


def test_every_language_is_learned(spark):
    rng, rows = random.Random(3), []
    pools = {f"l{k:02}": ["".join(rng.choice("abcdefghiklmnoprstuvz") for _ in range(6)) for _ in range(30)] for k in range(70)}
    for k, (lang, pool) in enumerate(pools.items()):
        rows += [(10 * k + i, " ".join(rng.choices(pool, k=25)), lang, "s", 1) for i in range(5 + (k < 64))]
    docs = spark.createDataFrame(rows, DOCS)
    open_ = {r[2] for r in docs.filter("crc32(cast(doc_id as string)) % 3 <> 1").collect()}
    assert len(open_) > 64 and set(langid.sample(docs)[1]) == open_ == set(langid.sample(docs, total=10)[1])
    assert max(Counter(langid.sample(docs, total=2 * len(open_))[1]).values()) == 2
    got = langid.identify(docs).filter("lang_pred = lang").select("lang").distinct().count()
    assert got >= len(open_) - 2


def test_repeated_rows_leave_other_languages(spark):
    rows = [(None, "the same text", "aa", "s", 1)] * 3000 + [(7, "the same text", "aa", "s", 1)] * 3000 + [(8, None, "bb", "s", 1)] * 200 + [(9, "some other words", "bb", "s", 1), (9, "and more words", "bb", "s", 1)]
    texts, names = langid.sample(spark.createDataFrame(rows, DOCS))
    assert Counter(zip(names, texts)) == {("aa", "the same text"): 2, ("bb", "some other words"): 1, ("bb", "and more words"): 1}


def test_learned_operators_on_odd_tables(spark, odd, none):
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[6]["lang_pred"] == got[10]["lang_pred"] == "und" and got[4]["score"] == 0
    assert langid.identify(odd).count() == odd.count() and langid.identify(none).count() == 0
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (7, 1, None), (None, 1, 1), (12, 0, 0), (9, 0, 0), (3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for y in (labels, labels.limit(0), labels.filter("toxic = 0")):
        rows = toxicity.score_toxicity(odd, y).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_toxicity_of_misspellings():
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcdeghklmnoprsu") for _ in range(rng.randrange(3, 8))) for _ in range(800)]
    text = lambda n, *more: " ".join([*rng.choices(pool, k=n), *more])
    model = toxicity.train([text(40) for _ in range(600)] + [text(36, *rng.choices(["rotten", "filthy"], k=2)) for _ in range(300)], [0] * 600 + [1] * 300)
    score = lambda *more: np.mean(model.scores(pa.array([text(36, *more) for _ in range(40)])))
    clean = score()
    assert score("rotten", "filthy") > 0.8 and clean < 0.3
    assert score("rottten", "rotttten") > clean + 0.2 and score("fillthy", "filthyy") > clean + 0.2


def test_stages(spark, odd, none):
    bench = spark.createDataFrame([(0, "nothing of this kind is in any of these texts at all")], "item_id long, text string")
    for stage in (stages.keep_identified, stages.cut_lines, stages.keep_one_of_each, lambda d: stages.drop_contaminated(d, bench)):
        assert stage(odd).columns == odd.columns
        assert stage(none).count() == 0
    kept = Counter(r["doc_id"] for r in stages.keep_one_of_each(odd).collect())
    least = {r[2] for r in brute.jaccard(pairs(odd)) if r[1]}
    assert {i for i in kept if i not in (4, 5, 6, None)} == least - {None} and max(kept[i] for i in least if i) == 1
    assert next(r["kept"] for r in substrings.dedup_substrings(odd).collect() if r["doc_id"] == 5) == ""


CLASHES = "n_lines n_removed emptied gone t t1 _t _tt _id _gone _first in_id in_t first_id first_t rest row text_hash lang_pred score held_out _letters hit_id hit_t i k p sh df w wh near fp size need cell part doc many pair copy _pair _copies _source _seed comp component_id n_shingles worded h1 h2 x site".split()


def test_columns_of_any_name_come_back(spark, odd):
    item = " ".join(f"q{i}" for i in range(30))
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(1, "before " + item + " after", "en", "a", 5), (None, item, "en", "b", 6)], DOCS))
    docs = plain.select("*", *[F.concat_ws("|", F.lit(c), F.col("doc_id"), F.col("source")).alias(c) for c in CLASHES])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string").withColumn("t", F.lit(1))
    for name, stage in {"keep_identified": stages.keep_identified, "cut_lines": stages.cut_lines, "keep_one_of_each": stages.keep_one_of_each, "drop_contaminated": lambda d: stages.drop_contaminated(d, bench), "mix": stages.mix}.items():
        out, want = stage(docs), stage(plain)
        assert set(out.columns) == set(docs.columns), name
        shared = [c for c in ("doc_id", "text", "lang", "source", "n_chars")]
        assert Counter(map(str, out.select(shared).collect())) == Counter(map(str, want.select(shared).collect())), name
        for r in out.collect():
            tail = "|".join(str(x) for x in (r["doc_id"], r["source"]) if x is not None)
            for c in CLASHES:
                assert (name == "mix" and c == "copy") or r[c] == (f"{c}|{tail}" if tail else c), (name, c)
    kept = [(r["doc_id"], r["text"]) for r in stages.drop_contaminated(docs, bench).collect()]
    assert not any("q3 q4" in (t or "") for _, t in kept)
    # others with the id of a contaminated document, or without one as another, stay
    assert Counter(i for i, _ in kept) == Counter(r["doc_id"] for r in odd.collect())
