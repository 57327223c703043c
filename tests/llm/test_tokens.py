"""Token ids, packing and edit-aware counts."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tracemill.llm import packing, queries, token_counts, tokens

DATA = "/root/testdata/sf0.001"
PATHS = tokens.byte_bpe_paths()
WHOLE = Tokenizer.from_file(PATHS[0])
PIECES = ["the ", "word", " ", "  ", "\n", "\t", "don't", "'s", "é", "日本", "12", "...", "<|endoftext|>", "<|", "　", " ", "\u0085", "\x1c", "a" * 30, "🙂", "'", " x"]


def ids(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_file(spark):
    rng = random.Random(0)
    for _ in range(2000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 12)))
        assert tokens.encode(text, PATHS) == ids(text), text
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect():
        assert tokens.encode(r[0], PATHS) == ids(r[0])


def test_every_character():
    for c in [*range(0x20), *range(0x7F, 0x3100), 0xFEFF, *range(0xD7A0, 0xD800), *range(0xE000, 0xE010), *range(0x1F600, 0x1F610)]:
        text = f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)} c"
        assert tokens.encode(text, PATHS) == ids(text), hex(c)


def test_fullest_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        got = packing.fullest(dict(counts), room)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        assert sum(k * n for k, n in got.items()) == max(sums)
        assert all(0 < n <= counts[k] for k, n in got.items())


def check_pieces(rows, docs, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in docs.items():
        all_ids = [*ids(text or ""), 0]
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(all_ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(all_ids) and all(r["length"] == capacity for r in own[1:]) and len(own) == -(-len(all_ids) // capacity)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing_the_whole_table(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op2_best_fit_packing(spark, DATA).collect()
    used = check_pieces(rows, docs, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_cases(spark):
    docs = {1: None, 2: "", 3: "one two three", 4: "word " * 100, 5: "x"}
    frame = spark.createDataFrame([(i, t, 7, "b") for i, t in docs.items()], "doc_id long, text string, rank int, bucket string")
    check_pieces(packing.pack(frame, 16).collect(), docs, 16)
    assert packing.pack(frame.limit(0)).collect() == [] and packing.pack(frame.limit(0)).columns == packing.pack(frame).columns
    many = packing.pack(frame.union(frame).union(frame), 16).collect()
    assert len(many) == 3 * len(packing.pack(frame, 16).collect())
    check_pieces([r for r in many if r["doc_id"] == -1], {}, 16)
    hot = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'same words', repeat('y z ', cast(id % 7 as int))) text")
    check_pieces(packing.pack(hot, 16).collect(), {r[0]: r[1] for r in hot.collect()}, 16)


def test_tree_follows_edits():
    rng = random.Random(2)
    count = lambda x: len(tokens.encode(x, PATHS))
    for leaf in (8, 40, 512):
        for _ in range(60):
            text = "".join(rng.choices(PIECES, k=rng.randint(0, 150)))
            tree = token_counts.TokenTree(text, count, leaf)
            assert tree.total == len(ids(text))
            for _ in range(12):
                start, more = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 3, 30])
                new = "".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 40])))
                start_, stop_ = min(start, len(text)), min(start + more, len(text))
                text = text[:start_] + new + text[stop_:]
                tree.edit(start, start + more, new)
                assert "".join(tree.leaves) == text and tree.total == len(ids(text)), (text, leaf)


def test_counts_of_the_whole_table(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_token_counts(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        assert r["n_tokens"] == len(ids(text))
        n, first = len(text), text[:12].upper()
        text = text[: n // 3] + " [edited]" + text[n // 3 :]
        text = text[: n // 2] + text[n // 2 + 40 :]
        text = text[: n * 2 // 3] + first + text[n * 2 // 3 + 12 :]
        assert r["n_tokens_edited"] == len(ids(text))


def test_count_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "some words", 1), (3, "some words", 1)], "doc_id long, text string, n_tokens int")
    edits = spark.createDataFrame([(3, 2, 4, None, None), (3, 1, 0, 4, "Other"), (1, 1, 5, 9, "new text")], "doc_id long, edit_no int, start long, stop long, replacement string")
    got = {(r["doc_id"], r["n_tokens"], r["n_tokens_edited"]) for r in token_counts.count(token_counts.attach(docs, edits)).collect()}
    assert got == {(1, 0, 2), (2, 0, 0), (3, len(ids("some words")), len(ids("Other words")))}
    assert token_counts.count(token_counts.attach(docs.limit(0), edits)).count() == 0


def test_kept_trees(spark, monkeypatch):
    """Trees that were written take edits from a table, twice; leaves that no edit touches aren't encoded."""
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(["some", "words", "and", "don't", "12", "naïve"], k=400)) for i in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trees = token_counts.save_trees(docs, 64)
    assert trees.columns == ["doc_id", "leaves", "chars", "tokens"]
    rows = [(0, 1, 5, 9, "XX"), (0, 2, 900, 900, " new part "), (3, 1, 0, 100, None), (9, 1, 0, 1, "none")]
    edits = spark.createDataFrame(rows, "doc_id long, edit_no int, start long, stop long, replacement string")
    for _ in range(2):
        trees = token_counts.apply_edits(token_counts.attach(trees, edits), 64)
        for i, _, a, b, new in rows[:3]:
            texts[i] = texts[i][:a] + (new or "") + texts[i][b:]
        for r in trees.collect():
            assert "".join(r["leaves"]) == texts[r["doc_id"]] and r["n_tokens_edited"] == r["tokens"][1] == len(ids(texts[r["doc_id"]]))
            assert (r["n_edits"], r["n_chars_encoded_again"] > 0) == ({0: 2, 3: 1}.get(r["doc_id"], 0), r["doc_id"] in (0, 3))
    seen = []
    tree = token_counts.TokenTree(texts[1], lambda x: seen.append(x) or len(ids(x)), 64)
    kept = token_counts.TokenTree.kept(list(tree.leaves), list(tree.chars), list(tree.tokens), tree.count, 64)
    seen.clear()
    kept.edit(700, 703, "abc")
    assert len(seen) == 1 and len(seen[0]) < 200 and kept.total == len(ids(texts[1][:700] + "abc" + texts[1][703:]))
    assert token_counts.apply_edits(token_counts.save_trees(docs.limit(0))).count() == 0
