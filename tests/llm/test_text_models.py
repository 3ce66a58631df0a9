import random

import numpy as np
import pytest
from brute import pseudo_likelihood, viterbi
from pyspark.sql import functions as F

from cloakwork.llm import langid, lm_scoring, mixing, quality
from cloakwork.llm import sentencepiece_codec as S
from cloakwork.llm.common import WordHasher

DOCS = "doc_id long, text string, lang string, source string, score string"
EN, FR = "the of and that with from this have".split(), "le la les des que dans pour avec".split()


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        rows.append((i, " ".join(rng.choice(EN if lang == "en" else FR) for _ in range(rng.randint(5, 60))), lang, rng.choice(["a", "b", "b", "b"]), "x"))
    return rows


ODD = [(1000, None, "en", None, ""), (1001, "", None, "a", ""), (1002, "123 ++ \u20ac", "fr", "é", ""), (1003, "the " * 200_000, "en", "b", ""), (None, "le la les", None, "b", ""), (1004, "the", None, None, ""), (1004, "the", None, None, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus() + ODD, DOCS)


def test_language_id(spark, docs):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r[0]: r[2] for r in corpus()}
    held = [i for i in truth if got[i]["held_out"]]
    assert 10 < len(held) < 60 and all(got[i]["lang_pred"] == truth[i] for i in held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "fr"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == 0
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)


def test_language_never_reads_the_label(spark, docs):
    swapped = docs.withColumn("lang", F.when(langid.held_out("doc_id"), "zz").otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(d).collect()} for d in (docs, swapped))
    assert a == b


@pytest.mark.parametrize("piece", [langid.PIECE, 5])
def test_language_counts_equal_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    texts = ["Été the " * 20, "", "日本語", "a", "ab", "a\n b", "\U0001f600x\U0001f600x"]
    doc, bucket, n = langid.sparse(texts, 1 << 14)
    for i, t in enumerate(texts):
        low = t.lower()
        plain = [low[j : j + g] for g in (1, 2, 3) for j in range(len(low) - g + 1)]
        number = {g: int(langid.grams([g], 1 << 14)[1][-1]) for g in set(plain)}
        want = np.bincount([number[g] for g in plain], minlength=1 << 14)
        got = np.zeros(1 << 14, int)
        got[bucket[doc == i]] = n[doc == i]
        assert (got == want).all()


def test_language_batches_equal_plain_bayes():
    rng = np.random.default_rng(3)
    model = langid.LanguageModel(["a", "b", "c"], rng.standard_normal((1 << 14, 3)), np.log([0.2, 0.5, 0.3]))
    texts = ["the of and", "", "12", "été", "the of and", "x" * 3000]
    for t, (lang, score) in zip(texts, model.predict(texts), strict=True):
        total, k = model.priors.copy(), 0
        for b in langid.grams([t], 1 << 14)[1]:
            total, k = total + model.logs[b], k + 1
        z = np.exp((total - total.max()) / max(1, k**0.5))
        letter = any(c.isalpha() for c in t)
        assert lang == (model.langs[int(total.argmax())] if letter else "und")
        assert score == pytest.approx(1 / z.sum() if letter else 0)
    ties = langid.LanguageModel(["x", "y"], np.zeros((1 << 14, 2)), np.log([0.5, 0.5]))
    assert ties.predict(["abc"]) == [("x", 0.5)]


def test_long_texts_are_lower_cased_as_others():
    for word in ("Été THE ΣΑΣ ", "ÉTÉ", "日本語"):
        text = word * (17_000_000 // len(word.encode()) + 1)
        parts = list(langid.pieces(text))
        low = np.concatenate([p[known:] for p, known in parts])
        assert max(len(p) for p, _ in parts) < 1 << 19 and (low == np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)).all()


def test_language_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "the of", "en", 7, 8), (3, "le la", "fr", 7, 8)], "doc_id long, text string, lang string, LANG_PRED int, `a b` int")
    got = langid.predict(df, langid.train(df))
    assert got.columns == ["doc_id", "text", "lang", "a b", "lang_pred", "score"]
    assert {r["lang_pred"] for r in got.collect()} == {"en", "fr"}


def test_language_of_nothing(spark):
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc", None, None, "")], DOCS)).first()["lang_pred"] == "und"


def test_targets_fill_up_to_the_cap():
    t = mixing.targets({"a": 10, "b": 100, None: 100})
    assert t["a"] == 20 and sum(t.values()) == pytest.approx(315)
    assert all(t[s] <= 2 * n + 1e-9 for s, n in {"a": 10, "b": 100, None: 100}.items())
    assert t["b"] / t[None] == pytest.approx(1 / 2)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 127
    size = lambda t: len((t or "").encode().split())
    assert sorted(r["size"] for r in rows) == sorted(size(x[1]) for x in corpus() + ODD)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    want = mixing.targets(sizes)
    for s, x in by.items():
        assert x[0]["source_size"] == sizes[s] and x[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in x) == pytest.approx(want[s], rel=0.01, abs=4)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in again) == sorted((r["doc_id"] or -1, r["taken"]) for r in rows)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_schedule_follows_the_weights_everywhere(spark):
    plan = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.5, 0.6), (2, 0.6, 1.0)], "source_no int, lo double, hi double")
    rows = sorted(mixing.schedule(spark, plan, 10_000).collect(), key=lambda r: r["slot"])
    seen = [0, 0, 0]
    for i, r in enumerate(rows):
        assert r["slot"] == i and r["rank"] == seen[r["source_no"]]
        seen[r["source_no"]] += 1
        assert all(abs(s - w * (i + 1)) < 6 for s, w in zip(seen, (0.5, 0.1, 0.4), strict=True))


def mixed_plainly(rows):
    """doc number: words taken; one slot and one word block at a time. rows: (number, source, size), in the order of their hash."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want, order = mixing.targets(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = {s: min(sizes[s], max(mixing.LEAST_BLOCKS, -(-sizes[s] // mixing.BLOCK_WORDS))) for s in order}
    share = {s: want[s] * blocks[s] / sizes[s] if sizes[s] else 0.0 for s in order}
    total, ends, at = sum(share.values()), [], 0.0
    for s in order:
        at += share[s] / total
        ends.append(at)
    used, uses = dict.fromkeys(order, 0), {}
    for slot in range(round(total)):
        point = (slot + 1) * mixing.GOLDEN % 1.0
        s = next((s for s, end in zip(order, ends, strict=True) if point < end), [s for s in order if share[s]][-1])
        if used[s] < 2 * blocks[s]:
            block = used[s] % blocks[s]
            uses[s, block] = uses.get((s, block), 0) + 1
        used[s] += 1
    taken, begin = {}, dict.fromkeys(order, 0)
    for number, s, n in rows:
        taken[number] = sum(uses.get((s, w * blocks[s] // sizes[s]), 0) for w in range(begin[s], begin[s] + n))
        begin[s] += n
    return taken


def test_mix_equals_a_plain_one(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "c", None]), 1) for i in range(200)], "doc_id long, text string, source string, TAKEN int")
    order = docs.select("doc_id", "source", F.size(F.filter(F.split("text", " "), lambda x: x != "")).alias("n"), F.xxhash64(F.lit(7), "doc_id", "text").alias("h")).orderBy("h").collect()
    want = mixed_plainly([(r["doc_id"], r["source"], r["n"]) for r in order])
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()} == want


@pytest.mark.parametrize("sources", [70, 20_000])
def test_many_sources_without_a_nested_loop(spark, sources):
    plan = spark.range(sources).select(F.col("id").cast("int").alias("source_no"), (F.col("id") / sources).alias("lo"), ((F.col("id") + 1) / sources).alias("hi"))
    found = mixing.schedule(spark, plan, 4 * sources)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    counts = found.groupBy("source_no").count().agg(F.sum("count"), F.max("count"), F.count("*")).first()
    assert counts[0] == 4 * sources and counts[1] <= 6 and counts[2] == sources


def test_quality_weights_equal_plain_ones(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(EN) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(70, None), (71, "the " * 40_000)]
    labels = spark.createDataFrame([(i, i % 3 > 0, 0) for i in range(30)], "doc_id long, quality boolean, toxic int").withColumn("quality", F.col("quality").cast("int"))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, KEPT int")
    raw, target, own = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), {}
    for (i, _), h in zip(rows, hashed([t for _, t in rows]), strict=True):
        own[i] = [int(x) >> 40 & quality.BUCKETS - 1 for x in h]
        for a, b in zip(h, h[1:], strict=False):
            own[i].append(((int(a) * 0x9E3779B97F4A7C15 ^ int(b)) * 0xC2B2AE3D27D4EB4F % (1 << 64)) >> 40 & quality.BUCKETS - 1)
        for g in own[i]:
            raw[g] += 1
            target[g] += i < 30 and i % 3 > 0
    logs = np.log((target + 1) / (target.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    got = quality.resample(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_grams"] == len(own[r["doc_id"]]) and r["log_ratio"] == pytest.approx(sum(logs[g] for g in own[r["doc_id"]]), abs=1e-6)
    best = sorted(got, key=lambda r: (-r["key"], r["doc_id"]))[: round(2 / 3 * len(rows))]
    assert {r["doc_id"] for r in got if r["kept"]} == {r["doc_id"] for r in best}


def test_quality_prefers_the_target(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(EN if i % 4 else ["#%", "!!", "xx"]) for _ in range(40))) for i in range(400)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.resample(df, labels).collect()}
    kept = [i for i, r in got.items() if r["kept"]]
    assert len(kept) == round(0.75 * 402) and sum(i % 4 > 0 for i in kept if i < 400) > 0.97 * len([i for i in kept if i < 400])
    assert got[900]["log_ratio"] == got[901]["log_ratio"] == 0
    none = quality.resample(df, labels.limit(0)).collect()
    assert all(r["kept"] and r["log_ratio"] == 0 for r in none)
    assert quality.resample(df.limit(0), labels).count() == 0


def test_top_k_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.5, 1.5, rng.random() * 1e6])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, key double")
    for k in (0, 1, 1000, 2500, 3000):
        kept = {r["id"] for r in quality.top_k(df, k).filter("kept").collect()}
        assert kept == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def hashed(texts):
    return list(WordHasher().texts([(t or "").encode() for t in texts]))


def test_language_model_learns(spark):
    rng = random.Random(4)
    text = lambda: " ".join(w for _ in range(80) for w in rng.choice([("red", "fox", "runs"), ("blue", "cat", "sleeps"), ("old", "dog", "barks")]))
    df = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string").repartition(2).withColumn("TEXT_", F.lit(1))
    held = [text() for _ in range(20)]
    words, flat = lm_scoring.train(df, rounds=2)
    assert words.counts.sum() == 1500 * 240  # every word of every document
    rows = [(1, held[0]), (2, None), (3, ""), (4, " ".join(reversed(held[0].split()))), (1, held[0]), (5, " ".join(held) + " unseen"), (6, "fox"), (None, "red fox " * 40_000)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), (words, flat)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and by[2]["n_tokens"] == 0 and by[2]["log_likelihood"] == 0 and by[3]["mean_log_likelihood"] is None and by[None]["n_tokens"] == 80_000
    assert by[5]["mean_log_likelihood"] > -np.log(9) + 0.5  # both sides tell more than the frequencies of nine words
    assert by[1]["log_likelihood"] > by[4]["log_likelihood"] + 50
    for i, t in rows:
        if t and len(t) < 1000:
            assert by[i]["log_likelihood"] == pytest.approx(pseudo_likelihood(hashed([t])[0], words, flat), rel=1e-4)
    empty = df.limit(0)
    assert lm_scoring.score(empty, lm_scoring.train(empty)).count() == 0


def test_tokens_have_a_distribution_given_both_sides():
    rng = np.random.default_rng(5)
    counts = np.zeros(lm_scoring.FINE)
    counts[rng.integers(0, lm_scoring.FINE, 20_000)] += rng.integers(1, 9, 20_000)
    words = lm_scoring.Vocabulary(counts)
    flat = lm_scoring.fresh(words.counts)
    flat += rng.standard_normal(len(flat)).astype(np.float32) * 0.3
    everything = np.arange(lm_scoring.VOCAB, dtype=np.int16)
    for context in ([0, 0, 5, 9], [17, 3, 8000, 0]):
        logs = lm_scoring.Net(flat).log_probabilities(np.tile(np.array(context, np.int16), (lm_scoring.VOCAB, 1)), everything)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    # the words of a shared token share its probability; a word of its own has all of it
    shared = words.token == lm_scoring.VOCAB - 1
    assert np.exp(words.inside[shared].astype(float)).sum() == pytest.approx(1, abs=1e-3)
    assert words.inside[np.argmax(counts)] == 0 and (words.inside[counts == 0] < 0).all()


def test_language_model_steps_follow_the_gradient():
    rng = np.random.default_rng(2)
    flat = lm_scoring.fresh(rng.integers(0, 50, lm_scoring.VOCAB).astype(float))
    context, token = rng.integers(0, 40, (60, 4)).astype(np.int16), rng.integers(0, 40, 60).astype(np.int16)
    net = lm_scoring.Net(flat)
    net.step(context, token)
    moved = net.flat - flat
    mean = lambda w: lm_scoring.Net(w).log_probabilities(context, token).mean()
    for at in np.argsort(-np.abs(moved))[::400][:12]:
        near = flat.copy()
        near[at] += 0.02
        # Adagrad's first step has the gradient's sign
        assert np.sign(mean(near) - mean(flat)) == np.sign(moved[at])
    assert mean(net.flat) > mean(flat)


def test_examples_cover_every_word_once(monkeypatch):
    texts = ["", "one", *[" ".join(f"b{i}x{j}" for j in range(i)) for i in range(2, 40)]]
    words = lm_scoring.Vocabulary(np.zeros(lm_scoring.FINE))
    for pool in (lm_scoring._POOL, 7):
        monkeypatch.setattr(lm_scoring, "_POOL", pool)
        for h in hashed(texts):
            t = words.token[lm_scoring.fine(h)]
            found = list(lm_scoring.examples(t))
            padded = [0, 0, *[int(x) + 1 for x in t], 0, 0]
            assert [int(x) for _, own in found for x in own] == t.tolist()
            assert [c for own, _ in found for c in own.tolist()] == [[padded[i], padded[i + 1], padded[i + 3], padded[i + 4]] for i in range(len(t))]


def test_weights_are_averaged_by_their_words():
    import pyarrow as pa

    table = pa.table({"task": [0, 0], "block": pa.array([3, 3], pa.int32()), "n": [1, 3], "w": [np.float32([1, 2]).tobytes(), np.float32([5, 2]).tobytes()]})
    got = lm_scoring._averaged(table)
    assert got.column("n").to_pylist() == [4] and np.frombuffer(got.column("w")[0].as_py(), np.float32).tolist() == [4, 2]


PIECES = [("<unk>", 0.0, "special")] + [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)] + [(p, s, "normal") for p, s in (("\u2581", -5.0), ("a", -4.0), ("b", -4.0), ("ab", -3.0), ("aba", -3.5), ("\u2581ab", -2.0), ("ba", -3.0), ("\u2581\u2581", -4.0), ("bab", -5.5))]


def test_viterbi_equals_brute_force():
    codec = S.Codec(PIECES)
    scores = {p: s for p, s, k in PIECES if k == "normal"}
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab \u00e9") for _ in range(rng.randint(1, 14)))
        total, pieces = viterbi((" " + text).replace(" ", "\u2581"), scores, codec.fallback)
        ids = codec.encode(text).tolist()
        got = b"".join(codec.bytes_of[i] for i in ids)
        assert got == "".join(pieces).replace("\u2581", " ").encode()
        own = sum(PIECES[i][1] for i in ids if PIECES[i][2] == "normal") + codec.fallback * text.count("\u00e9")
        assert own == pytest.approx(total)


def test_round_trips():
    codec = S.Codec(PIECES)
    for text in ("", "a", " a", "a ", "  a  b ", "\n\na\n b", "\u2581x\u2581", "a\0b", "\U000f0000 \u2581", "\t", "ab" * 20_000, "a" + " " * 500 + "b", "\r\n", " \n ", "日本語"):
        assert codec.decode(codec.encode(text).tolist()) == text


def test_long_words_in_windows_equal_one_pass(monkeypatch):
    rng = random.Random(8)
    codec = S.Codec(PIECES)
    texts = ["".join(rng.choice("ab\u00e9\u2581") for _ in range(rng.randint(60, 400))) for _ in range(40)] + ["a" * 500, "ab" * 300, "\u2581" * 99]
    whole = [codec.encode(t).tolist() for t in texts]
    monkeypatch.setattr(S, "WINDOW", 16)
    assert [codec.encode(t).tolist() for t in texts] == whole
    assert [codec.decode(x) for x in whole] == texts


def test_codec_on_tables(spark):
    rows = [(1, "aba bab", "x"), (2, None, "y"), (3, "", "z"), (1, "aba bab", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = S.encode(df, PIECES)
    assert got.columns == ["doc_id", "text", "ids", "n_pieces", "decoded_sha256", "round_trip"]
    assert all(r["round_trip"] for r in got.collect())
    back = S.decode(got.select("doc_id", "ids"), PIECES).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == [(1, "aba bab"), (1, "aba bab"), (2, ""), (3, "")]
    assert S.encode(df.limit(0), PIECES).count() == 0
