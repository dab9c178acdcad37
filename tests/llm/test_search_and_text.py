"""Top-k search, chat formatting, language ID, substring dedup and the pipeline."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from raregrain.llm import chains, chat, language, suffix, tokens
from raregrain.llm.topk import threshold_search, top_k


def brute_top(vectors, queries, k):
    out = []
    for q, qv in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, qv)), i) for i, v in vectors if i != q and len(v) == len(qv))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 1 << 14, 1 << 24])
def test_top_k(spark, scale):
    rnd = random.Random(scale)
    rows = [(i, [float(rnd.randrange(-3, 4) * scale) for _ in range(5)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, [0.0] * 5), (401, [1.0]), (402, [2.0]), (403, [])]
    odd = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] + [0.0] * 4), (None, [1.0] * 5)]
    frame = spark.createDataFrame([(i, v, "a", "b") for i, v in rows + odd], "vec_id bigint, embedding array<double>, v string, score string")
    whole = [(i, [int(x) for x in v]) for i, v in rows]
    queries = [r for r in whole if r[0] % 50 == 0 or r[0] > 399]
    got = top_k(frame, frame.where("vec_id % 50 = 0 or vec_id > 399"), scale=1, k=10, block_vectors=64, block_queries=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(whole, queries, 10)
    assert top_k(frame.where("false"), frame).collect() == [] and top_k(frame, frame.where("false")).collect() == []


def test_search_stops_early():
    rnd = np.random.default_rng(0)
    v = rnd.normal(size=(5000, 3)) * 1000
    v = np.floor(v).astype(np.int64)
    ranked = np.argsort(v.T, axis=1)
    ids, scores, looked = threshold_search(v, np.arange(5000), np.array([5, -3, 1]), None, 10, ranked)
    order = np.lexsort((np.arange(5000), -(v @ np.array([5, -3, 1]))))[:10]
    assert ids.tolist() == order.tolist() and looked < 4000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb%", "<|x"]), st.text(alphabet="<|\\im_end>start\n ok%", max_size=30)), max_size=5))
def test_template_reads_back(turns):
    formatted, spans = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == len(turns)


def test_layouts(spark):
    plain = [["user", "hi"], ["assistant", "yo"]]
    records = {
        1: {"messages": [{"role": r, "content": t} for r, t in plain]}, 2: {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        3: {"instruction": "hi", "input": None, "output": "yo"}, 4: {"prompt": "hi", "completion": "yo"}, 5: {"prompt": "hi", "response": "yo", "extra": {"a": 1}},
        6: {"question": "hi", "answer": "yo"}, 7: {"turns": [{"turn": 2, "role": "assistant", "text": "yo"}, {"turn": 1, "role": "user", "text": "hi"}]},
    }
    bad = {8: "[1]", 9: "{", 10: None, 11: '{"other": 1}', 12: '{"turns": []}'}
    frame = spark.createDataFrame([(i, json.dumps(r), "x") for i, r in records.items()] + [(i, r, "x") for i, r in bad.items()], "id bigint, record string, formatted string")
    got = {r.id: r for r in chat.format_chats(frame, "id", "record").collect()}
    assert {got[i].formatted for i in records} == {chat.render([tuple(t) for t in plain])[0]}
    assert len({got[i].fingerprint for i in records}) == len(records) and len({got[i].mapping for i in records}) == len(records)
    assert all(got[i].mapping is None and got[i].formatted is None for i in bad)
    assert chat.fingerprint(chat.field_paths({"messages": [{"role": 1, "content": 2}] * 3})) == got[1].fingerprint


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (None, 0, None, "t"), (2, None, "assistant", "😀"), (2, 5, "assistant", "b")]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.turn_records(turns, "conv_id"), "conv_id", "record"), "conv_id").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, sha("user\nq\nuser\nq\nassistant\n\n"), 0)
    assert got[2].loss_sha256 == sha("😀b") and got[2].loss_chars == 2 and got[None].turns_sha256 == sha("\nt\n")
    assert chat.digests(chat.format_chats(chat.turn_records(turns.where("false"), "conv_id"), "conv_id", "record"), "conv_id").collect() == []


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    got = language.identify(docs, language.learn(docs.where(~language.held_out()))).join(docs.select("doc_id", "lang"), "doc_id")
    right, n, low, high = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 150 and right >= 0.98 and 0 <= low <= high <= 1


def test_language_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", None), (5, "123 !!", "fr"), (6, "the the the", None), (7, "日本語", None), (None, "et le chat", None), (8, "LE  CHIEN", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(docs.where("doc_id < 3"))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None, 8)] == ["en", "fr", "und", "und", "und", "en", "fr", "fr"]
    assert got[7].score == 0 and got[7].lang_pred in ("en", "fr") and got[None].held_out is False
    nothing = language.learn(docs.where("false"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).collect() == []
    many = language.LanguageFilter.build([(i, [f"l{i % 70:02d}"]) for i in range(700)], [f"l{i:02d}" for i in range(70)])
    assert many.slots.shape[0] == 2


def brute_removed(rows, window):
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - window + 1):
            piece = data[i : i + window]
            if piece in seen:
                covered[i : i + window] = b"\1" * window
            seen.add(piece)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        out.append((str(key), len(data), len(data) - len(kept), spans, kept))
    return sorted(out)


@pytest.mark.parametrize("group,shard", [(4096, 4 << 20), (2, 600)])
def test_suffix_dedup(spark, group, shard):
    rnd = random.Random(group)
    passages = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randrange(60, 260))) for _ in range(8)]
    rows = []
    for i in range(70):
        body = [rnd.choice([*passages, "".join(rnd.choice("xyzü") for _ in range(rnd.randrange(120)))]) for _ in range(rnd.randrange(6))]
        rows.append((i, "".join(body)))
    rows += [(100, None), (101, ""), (102, "a" * 900), (103, "ab" * 400), (104, "a" * 99), (105, "a" * 100), (106, rows[3][1]), (107, passages[0][:99])]
    frame = spark.createDataFrame([(i, t, "k", "s") for i, t in rows], "doc_id bigint, text string, key string, start string")
    got = suffix.remove_repeats(frame, group=group, shard_bytes=shard).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_removed(rows, 100)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_suffix_dedup_repeated_keys(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix.remove_repeats(frame).collect())
    assert got == [("1", 300), ("1", 300), ("None", 0)]
    assert suffix.remove_repeats(frame.where("false")).collect() == []


def test_suffix_array_orders():
    rnd = np.random.default_rng(1)
    text = np.concatenate((rnd.integers(97, 99, 700), np.full(300, 97), rnd.integers(97, 99, 200))).astype(np.uint8)
    order, _ = suffix.suffix_array(text, 100)
    raw = text.tobytes()
    pieces = [raw[i : i + 100] for i in order]
    assert pieces == sorted(pieces) and sorted(order) == list(range(len(raw)))


def test_passages(spark):
    rnd = random.Random(7)
    new = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shared, other = new(80), new(60)
    fuzzy = shared[:20] + ["edit"] + shared[21:40] + ["more", "words"] + shared[40:60] + shared[61:]
    rows = [(1, new(200) + shared + new(30)), (2, new(50) + fuzzy + new(10)), (3, new(300)), (4, [w.upper() for w in shared]), (5, new(9) + other + new(9)), (6, other), (7, new(40) + shared[:30]), (8, [])]
    frame = spark.createDataFrame([(i, " ".join(w), "h") for i, w in rows] + [(9, None, "h")], "doc_id bigint, text string, ref string")
    got = {r.doc_id: r for r in chains.repeated_passages(frame).collect()}
    assert set(got) == {2, 4, 6}
    assert (got[2].ref_doc_id, got[2].start_word, got[2].ref_start_word, got[2].n_words) == (1, 50, 200, 81) and 0.9 < got[2].similarity < 1
    assert (got[4].ref_doc_id, got[4].n_words, got[4].similarity) == (1, 80, 1.0) and (got[6].ref_doc_id, got[6].n_words) == (5, 60)
    assert chains.repeated_passages(frame.where("false")).collect() == []
    assert chains.repeated_passages(spark.createDataFrame([(1, " ".join(shared)), (1, " ".join(shared))], "doc_id bigint, text string")).count() == 1


def test_chain_scores_are_best():
    rnd = random.Random(2)
    for _ in range(60):
        blocks = sorted({(a, a + rnd.randrange(0, 6), rnd.randrange(60)) for a in rnd.sample(range(60), 7)})

        def best(i):
            a0, a1, b0 = blocks[i]
            own = a1 - a0 + chains.SEED_WORDS
            before = [j for j, (c0, c1, d0) in enumerate(blocks) if c1 < a0 and d0 + c1 - c0 < b0]
            return own + max([0.0] + [best(j) - chains.SKIP * (a0 - blocks[j][1] + b0 - (blocks[j][2] + blocks[j][1] - blocks[j][0]) - 2 * chains.SEED_WORDS) for j in before])

        first = chains.chains_of(blocks)[0]
        score = sum(blocks[i][1] - blocks[i][0] + chains.SEED_WORDS for i in first)
        for j, i in zip(first, first[1:]):
            score -= chains.SKIP * (blocks[i][0] - blocks[j][1] + blocks[i][2] - (blocks[j][2] + blocks[j][1] - blocks[j][0]) - 2 * chains.SEED_WORDS)
        assert score == pytest.approx(max(best(i) for i in range(len(blocks))))
    assert chains.common_words(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 4])) == 2


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = [(900_001, None, "en", "s", 0), (900_002, "123 !!", None, None, 6), (None, docs.first().text, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema)).withColumn("stage_row", F.lit("clash"))
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "stage_row"]
        counts.append(docs.count())
    assert counts[0] == 201 and counts[0] > counts[1] >= counts[2] and not docs.where("doc_id in (900001, 900002)").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_learning_and_encoding_take_small_slices(monkeypatch):
    """Slices of 8 MB took a worker 250 MB to learn from and kept 145 MB after encoding: with the workers, 3000 MB of an executor were passed."""
    batch = pa.record_batch([["abc " * 50_000] * 60, ["en"] * 60], ["text", "lang"])
    seen = []

    def hashes(texts):
        seen.append(sum(map(len, texts)))
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.ones(len(texts), bool)

    monkeypatch.setattr(language, "ngram_hashes", hashes)
    assert [b.num_rows for b in language.counted(iter([batch]))] == [0] * len(seen)
    assert sum(seen) == 60 * 200_000 and max(seen) <= 1 << 20

    class Kept:
        def encode(self, column, end):
            return np.zeros(len(column) + 1, np.int64), np.empty(0, np.uint32)

    monkeypatch.setattr(tokens, "encoder", lambda path: Kept())
    sizes = [part.column("text").nbytes for part, _, _ in tokens.encoded(iter([batch]), "", 0)]
    assert sum(sizes) >= 60 * 200_000 and max(sizes) <= (4 << 20) + 1000
