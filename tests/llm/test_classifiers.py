"""Quality classifier and language ID: held-out accuracy and defined cases."""

import math
import re
import zlib

from pyspark.sql import functions as F

from tracemill.llm import langid, quality, queries
from tracemill.llm.common import crc_part

DATA = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = queries.op4_quality_classifier(spark, DATA)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == 1000 and got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    held = [(r["quality"], rows[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_ignores_ids_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "good words here", "en"), (2, None, None), (3, "", "x"), (4, "### " * 5000, "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (2, None), (9, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).orderBy("doc_id")
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    assert rows[0]["score"] > rows[3]["score"] and rows[1]["score"] == rows[2]["score"]
    none = quality.fit(docs.limit(0), labels)
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).count() == 0


def test_quality_draws_repeated_rows_once(spark):
    docs = spark.createDataFrame([(7, "bb"), (7, "a"), (7, "b")] * 50 + [(i, f"text {i}") for i in range(1, 6)] + [(None, "x"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(None, 1)], "doc_id long, quality int")
    assert quality.sample(docs, labels, 10) == [(f"text {i}".encode(), i % 2) for i in range(1, 6)] + [(b"a", 1)]
    assert len(quality.sample(docs, labels, 2)) == 4
    assert [len(x) for x, _ in quality.sample(docs, labels, 10, 2 * 64)] == [1]  # texts of at most 2 bytes
    assert [len(x) for x, _ in quality.sample(docs, labels, 10, max_text=2)] == [1]


def test_features_do_not_depend_on_slices(monkeypatch):
    text = ("Some words, ééé and more " * 40).encode()
    whole = sorted(x for f in quality.features(text, 1 << 17, (3, 5)) for x in f.tolist())
    monkeypatch.setattr(quality, "_STEP", 37)
    assert sorted(x for f in quality.features(text, 1 << 17, (3, 5)) for x in f.tolist()) == whole


def test_language_on_held_out_rows(spark):
    got = queries.op10_language_id(spark, DATA)
    rows = got.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)


def test_language_cases(spark):
    rows = [(1, "the cat and the dog and the house", "en"), (2, "el gato y la casa de los ninos", "es"), (3, None, "en"), (4, "12 !!", None), (5, "", "es"), (6, "the house and the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rejected", F.lit("x"))
    dictionaries = langid.fit(docs)
    assert sorted(dictionaries) == ["en", "es"]
    out = {r["doc_id"]: r for r in langid.predict(docs, dictionaries).collect()}
    assert [out[i]["lang_pred"] for i in range(1, 7)] == ["en", "es", "und", "und", "und", "en"]
    assert out[3]["score"] == 0 and 0.5 < out[6]["score"] <= 1 and not out[6]["rejected"]
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.fit(docs.limit(0)) == {} and langid.predict(docs.limit(0), dictionaries).count() == 0


def plain_score(text, table, bias, grams):
    """The score by plain loops over a text's words, word pairs and byte n-grams."""
    base, low = 0x9E3779B97F4A7C15, (1 << 64) - 1
    salt = 0xA0761D6478BD642F

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & low
        x = (x ^ x >> 27) * 0x94D049BB133111EB & low
        return x ^ x >> 31

    values = [mix(i * 0xD6E8FEB86659FD93 & low) for i in range(1, 257)]
    hashed = lambda data: mix(sum(values[b] * pow(base, i, 1 << 64) for i, b in enumerate(data)) + len(data) * salt & low)
    found = [data for n in grams for k in range(len(text) - n + 1) for data in [text[k : k + n]]]
    words = [hashed(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text)]
    buckets = [hashed(x) % len(table) for x in found] + [w % len(table) for w in words]
    buckets += [mix((b - a + 7) & low) % len(table) for a, b in zip(words, words[1:])]
    return 1 / (1 + math.exp(-(bias + sum(float(table[b]) for b in buckets) / max(1, len(buckets)))))


def test_scores_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 1500").union(spark.createDataFrame([(-1, ""), (-2, None), (-3, "a"), (-4, "é é")], "doc_id long, text string"))
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = quality.score(docs, model).collect()
    assert len(rows) > 50 and model.table.any()
    for r in rows:
        assert abs(r["score"] - plain_score((r["text"] or "").encode(), model.table, model.bias, model.grams)) < 1e-6
        assert r["predicted"] == (r["score"] >= 0.7)


def test_languages_against_a_plain_choice(spark):
    """Dictionaries and predictions again by loops over the rows."""
    import zstandard as Z

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("text").alias("h"))
    rows = docs.collect()
    own = lambda text: (" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode()
    made = {}
    for lang in sorted({r["lang"] for r in rows if r["lang"]}):
        joined, seen = b"", set()
        for r in sorted((r for r in rows if r["lang"] == lang and zlib.crc32(str(r["doc_id"]).encode()) % 5 and 0 < len(r["text"].encode()) <= langid.MAX_TEXT), key=lambda r: r["h"]):
            if own(r["text"]) not in seen and (not seen or len(joined) + len(own(r["text"])) < langid.DICTIONARY):
                joined += own(r["text"])
            seen.add(own(r["text"]))
        made[lang] = Z.ZstdCompressor(langid.LEVEL, dict_data=Z.ZstdCompressionDict(joined, Z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        size = {lang: len(c.compress(own(r["text"]))) for lang, c in made.items()}
        want = min(size, key=lambda x: (size[x], x)) if any(map(str.isalpha, r["text"] or "")) else "und"
        assert got[r["doc_id"]]["lang_pred"] == want


def test_letters_and_draws(spark):
    assert langid.words("½ Ⅷ 12 a½b") == ["a", "b"] and langid.words("½") == [] and langid.words("ça va") == ["ça", "va"]
    rows = [(i, "same words again", "hot") for i in range(300)] + [(1000 + i, f"other text number {'abcdefgh'[i % 8] * (i // 8 + 1)}", "hot") for i in range(64)]
    rows += [(2000 + i, "long " * (30 + i), "long") for i in range(5)] + [(3000, "½ 2", "none"), (3001, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = langid.draw(docs, per_lang=20, max_text=100).collect()
    assert sum(r["lang"] == "hot" for r in drawn) == 20 == len({r["text"] for r in drawn if r["lang"] == "hot"})
    assert [r["text"] for r in drawn if r["lang"] == "long"] == ["long " * 30]
    made = langid.fit(docs, per_lang=20, max_text=100)
    assert sorted(made) == ["hot", "long", "none"]
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, made).collect()}
    assert out[2003] == "long" and out[0] == "hot" and out[3000] == out[3001] == "und"
    one = spark.createDataFrame([(None, "x y")], "doc_id long, text string").withColumn("held_out", crc_part("doc_id", 5) == 0).first()
    assert one["held_out"] is True
