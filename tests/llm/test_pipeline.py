from collections import Counter

import brute
import corpus_pipeline
import duckdb

from oreweave.llm import decontaminate, mixing
from oreweave.llm.common import stored


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        was, now = ({r["doc_id"]: r for r in d.collect()} for d in (before, docs))
        assert set(now) <= set(was)
        if name == "language_id":
            lang = {i: r["lang"] for i, r in was.items()}
            assert all(lang[i] is None or not was[i]["text"].split() or not any(c.isalpha() for c in was[i]["text"]) for i in set(was) - set(now)) or len(was) - len(now) <= 0.02 * len(was)
        if name == "jaccard_join":
            rows = brute.jaccard([(i, r["text"]) for i, r in was.items()])
            assert set(now) == {c for i, n, c in rows if n} | {i for i, n, _ in rows if not n}
        if name == "decontamination":
            con = duckdb.connect()
            con.register("d", before.select("doc_id", "text").toPandas())
            sql = "with " + decontaminate.SQL_PARTS.replace("{p}", "h").replace("{docs}", "d").replace("{benchmark}", f"'{sf_dir}/benchmark.parquet'") + " select distinct doc_id from h_x"
            assert set(was) - set(now) == {r[0] for r in con.execute(sql).fetchall()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    counts = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    assert all(r["taken"] <= 3 * r["size"] for r in counts.values())
    want = Counter((str(r), k + 1) for r in docs.collect() for k in range(counts[r["doc_id"]]["copies"]))
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.columns == [*columns, "copy"]
    assert Counter((str(r["x"]), r["copy"]) for r in mixed.selectExpr(f"struct({', '.join(columns)}) as x", "copy").collect()) == want
    whole = corpus_pipeline.run(spark, sf_dir)
    assert Counter(map(str, whole.collect())) == Counter(map(str, last))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


def test_last_stage_takes_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(copies) - Counter()
    assert 0 in copies.values() and max(copies.values()) > 1
    assert all(r["text"] == text[r["doc_id"]] for r in rows)
