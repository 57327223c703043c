"""The stages of the pipeline, each on what its predecessor kept, and line dedup against brute force."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import decontam, line_dedup
from tracemill.llm.common import written
from tests.llm.test_decontam import least_edits
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_tokens import ids

DATA = "/root/testdata/sf0.001"


def test_very_long_texts(spark):
    """A text of some megabytes among short ones goes whole through every operator."""
    from tracemill.llm import fingerprints, importance, langid, near, packing, quality, ranked, simhash, substring_dedup, suffix_dedup, token_counts

    long = " ".join(f"w{i * 7919 % 100003}" for i in range(400_000)) + "\nlast line"
    rows = [(1, "s", long, "en"), (2, "s", long + " and more", "en"), (3, "s", "short text here", "en"), (4, "s", None, "en"), (5, "s", "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").repartition(2)
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    assert by(line_dedup.drop_boilerplate(docs, 0.1, 3))[1]["text"] == long and by(line_dedup.drop_boilerplate(docs, 0.1, 2))[2]["text"] == "last line and more"
    whole = {i: len(ids(t or "")) + 1 for i, _, t, _ in rows}
    assert {r["doc_id"]: r["n"] for r in packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == whole
    counted = by(token_counts.count(docs.withColumn("edits", token_counts.sample_edits())))
    assert all(counted[i]["n_tokens"] == n - 1 for i, n in whole.items())
    scored = by(quality.score(docs, quality.train([(b"a b c", 1), (b"### ###", 0)])))
    assert abs(scored[1]["score"] - scored[2]["score"]) < 1e-3 and scored[4]["score"] == scored[5]["score"]
    assert by(simhash.components(docs))[2]["component_id"] == by(near.components(docs, 0.8))[2]["component_id"] == 1
    assert by(substring_dedup.remove_repeats(docs))[2]["n_removed"] == len(long.split())
    assert by(suffix_dedup.remove_repeats(docs))[1]["n_removed"] == len(long)
    compared = by(fingerprints.compare_edited(docs))
    assert compared[1]["n_chars"] == len(long) and compared[1]["near_next"] > 0.99 and compared[4]["n_chars"] == 0
    drawn = by(importance.resample(docs, spark.createDataFrame([("w1 w2",)], "text string"), share=100))
    assert drawn[1]["n_features"] == 2 * 400_002 - 1 and drawn[1]["rank"] and drawn[4]["n_features"] == 0
    asked = spark.createDataFrame([(1, "line w7919 more")], "item_id long, text string")
    assert [(r["rank"], r["doc_id"]) for r in ranked.search(ranked.build(docs), asked).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    made = langid.fit(docs)
    assert sorted(made) == ["en"] and by(langid.predict(docs, made))[1]["lang_pred"] == "en"
    item = spark.createDataFrame([(7, long[1_500_000:1_500_300])], "item_id long, text string")
    assert sorted(r[0] for r in decontam.matches(docs, item).collect()) == [1, 2] and sorted(r["doc_id"] for r in decontam.clean(docs, item).collect()) == [3, 4, 5]


def brute_lines(rows, ratio, least):
    """rows: (doc_id, host, text) -> texts"""
    totals, counts = {}, {}
    for _, host, text in rows:
        totals[host] = totals.get(host, 0) + 1
        for x in {x for x in (text or "").split("\n") if x.strip(" ")}:
            counts[host, x] = counts.get((host, x), 0) + 1
    drop = {k for k, n in counts.items() if n >= least and n / totals[k[0]] > ratio}
    return [t if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in drop) for _, h, t in rows]


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 7 == 0 else f"h{i % 3}", "\n".join(rng.choice(["nav", "", "  ", "a b", *(f"u{k}" for k in range(200))], 6))) for i in range(300)]
    rows += [(900, "h1", None), (901, "h1", ""), (902, None, "nav\nnav"), (902, None, "nav\nnav"), (903, "alone", "x\ny")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, source string, text string, lines_total int, __ld string")
    out = line_dedup.drop_boilerplate(docs, 0.02, 3)
    assert sorted(out.columns) == sorted(docs.columns + ["lines_dropped"])
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, zip((r[0] for r in rows), brute_lines(rows, 0.02, 3))))
    plain = line_dedup.drop_boilerplate(docs, 0.02, 3, counts=False)
    assert plain.columns == docs.columns and plain.filter("lines_total = 1").count() == len(rows)
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_every_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, kept[-1], DATA))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        kept.append(out)
    texts = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept[:-1]]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i, q in quality.items() if q == 1]
    assert sum(i in texts[1] for i in good) >= 0.95 * len(good)
    assert sum(i in texts[1] for i, q in quality.items() if q == 0) <= 0.1 * len(quality)
    assert all(texts[0][i] == t for i, t in texts[1].items())
    rows = [(r["doc_id"], r["source"], r["text"]) for r in kept[1].collect()]
    assert texts[2] == dict(zip((r[0] for r in rows), brute_lines(rows, line_dedup.RATIO, line_dedup.MIN_PAGES)))
    label = brute_components({i: brute_print(t) for i, t in texts[2].items()})
    assert all(label[i] == i and texts[2][i] == t for i, t in texts[3].items())
    sets = {}
    for i, t in texts[2].items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    for i in {i for i in texts[2] if label[i] == i} - set(texts[3]):  # similar, though not within the radius
        assert max(alike(i, j) for j in sets if j != i) >= 0.6
    assert sum(alike(i, j) >= 0.8 for i in texts[3] for j in texts[3] if i < j) <= 2
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for i, t in texts[3].items():
        t = decontam.normal(t)
        if any(x in t for x in items):
            assert i not in texts[4]
        elif i not in texts[4]:
            assert any(least_edits(x, t) <= decontam.budget(len(x)) for x in items)
    pieces = kept[5].collect()
    assert {r["doc_id"] for r in pieces} == set(texts[4])
    for i, t in texts[4].items():
        own = sorted((r["piece"], r["ids_crc32"], r["length"]) for r in pieces if r["doc_id"] == i)
        all_ids, at = np.array([*ids(t or ""), 0], "<u4"), 0
        for _, crc, n in own:
            assert crc == zlib.crc32(all_ids[at : at + n].tobytes())
            at += n
        assert at == len(all_ids)
    run = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, run.select("doc_id", "piece", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces)


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    odd = docs.limit(6).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text"))).withColumn("source", F.lit(None).cast("string"))
    mixed = docs.union(docs.limit(5)).union(odd).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("rank", F.lit(1)).withColumn("score", F.lit("s"))
    for frame in (mixed, mixed.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, frame, DATA))
            assert out.count() <= 2 * mixed.count() or "piece" in out.columns
            assert "piece" in out.columns or out.columns == frame.columns
