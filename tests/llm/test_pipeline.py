"""Each stage against a brute-force version of its decision, on what its predecessor kept."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import mixing, neardup, quality
from keelson.llm.common import Tables

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    tables = Tables(spark, "stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = tables.keep(stage(spark, docs, SF), name)
        kept.append(docs)
    columns = kept[0].columns
    assert [k.columns for k in kept[:5]] == [columns] * 5
    rows = [[r.asDict() for r in k.collect()] for k in kept]
    # Quality: exactly the rejected documents go, and clean held-out ones stay.
    model = quality.fit(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(kept[0], model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in rows[1]} == good
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [k for k, q in labels.items() if q == 1 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(k in good for k in clean) >= 0.95 * len(clean)
    # Near-duplicates: one of each component at five words and 0.8.
    sets = {}
    for r in rows[1]:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in rows[2]} == {k for k in ids if find(k) == k}
    # Secrets: the same documents, and nothing to find in them.
    before, after = ({r["doc_id"]: r for r in rows[k]} for k in (2, 3))
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert r["n_chars"] == len(r["text"]) or r["text"] == before[k]["text"]
        assert corpus_pipeline.REDACTED in r["text"] or r["text"] == before[k]["text"]
    # Mixing: copies of documents, two at most, within the budget.
    copies = Counter(r["doc_id"] for r in rows[4])
    assert copies and max(copies.values()) <= 2
    size = {k: len(r["text"].encode().split()) for k, r in after.items()}
    assert sum(size[k] * n for k, n in copies.items()) <= 1.5 * sum(size.values())
    assert sum(size[k] * n for k, n in copies.items()) >= 1.4 * sum(size.values())
    # Packing: each copy whole, sequences gapless.
    assert Counter(r["doc_id"] for r in rows[5] if r["piece"] == 0) == copies
    ends = Counter()
    for r in sorted(rows[5], key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends[r["sequence_id"]] == r["offset"]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Any column names, nulls, equal ids of different texts, equal rows; each stage on its own."""
    spark.createDataFrame([(1, 1), (2, 1), (9, 1), (7, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    clash = ["predicted", "__id", "__linked", "__own1", "__d1", "id", "d1", "passes", "copies", "stays", "__key", "__plain", "__text"]
    docs = odd.select("*", *(F.lit("y").alias(c) for c in clash if c not in odd.columns))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "best_fit_packing" or out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_dedup_and_mix_of_equal_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, c, "x"), (3, c, "x"), (3, c, "y"), (4, None, "x"), (4, None, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = sorted(map(tuple, neardup.deduplicated(docs).select("doc_id", "text").collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (3, c), (4, None), (4, None), (None, a)], key=str)
    # Two texts of one id, source and number of words: each as often as its own passes.
    pair = spark.createDataFrame([(5, "one two", "s"), (5, "six ten", "s"), (6, "big " * 5, "t"), (6, "big " * 5, "t")], "doc_id bigint, text string, source string")
    once = [sorted(map(tuple, mixing.repeated(df).collect())) for df in (pair, pair.orderBy(F.desc("text")), pair.repartition(3))]
    assert once[0] == once[1] == once[2]
    passes = Counter()
    for r in mixing.mix(pair).collect():
        passes[r["doc_id"]] += r["passes"]
    assert Counter(x[0] for x in once[0]) == +passes


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
