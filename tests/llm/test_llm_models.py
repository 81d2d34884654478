"""Trained models: held-out accuracy, odd rows, nothing to learn from."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import language_id, quality, suffix_tree, toxicity
from rowloom.llm.common import remainder
from rowloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(4, 20)] + [(5, 1, 0), (None, 1, 1), (6, None, None), (999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = QUERIES["op9_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = told[told.held_out]
    assert len(held) > 150 and (held.lang_pred == held.lang).mean() > 0.98


def test_rare_language_is_learned(spark):
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    text = lambda letters: " ".join(word(letters) for _ in range(40))
    rows = [(i, text("abcde"), "common") for i in range(3000)] + [(5000 + i, text("vwxyz"), "rare") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # Drawn from all rows alike, 100 of 3,008 would rarely hold one of the eight.
    drawn = language_id.chosen_rows(docs, 100).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in drawn} == {"common": 50, "rare": 8}
    model = language_id.train(docs, 100)
    assert model.languages == ["common", "rare"]
    told = language_id.predict(docs.filter("doc_id < 100 OR doc_id >= 5000"), model).collect()
    assert all(r["lang_pred"] == ("rare" if r["doc_id"] >= 5000 else "common") for r in told)


def brute_language(text, model):
    """Prediction and score of a text from its own subwords, one by one."""
    sums, n = np.zeros(len(model.languages)), 0
    for w in text.encode().split():
        for bucket in language_id.subwords([w.lower()])[0]:
            sums += model.embeddings[bucket].astype(float) @ model.weights.astype(float)
            n += 1
    if not n:
        return "und", 0.0
    p = np.exp(sums / n / model.temperature)
    return model.languages[int(p.argmax())], float(p.max() / p.sum())


def test_language_scores_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for r in language_id.predict(docs, model).collect():
        name, score = brute_language(texts[r["doc_id"]], model)
        assert r["lang_pred"] == name and r["score"] == pytest.approx(score, abs=1e-3)


def test_language_of_odd_rows(odd_docs, odd_rows):
    model = language_id.train(odd_docs)
    rows = language_id.predict(odd_docs, model).collect()
    assert len(rows) == len(odd_rows)
    by = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3, 4, None):
        if i is not None:
            assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[9]["lang_pred"] in model.languages and all(0 <= r["score"] <= 1 for r in rows)
    kept = language_id.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert kept.filter("doc_id IN (1, 2, 3, 4)").count() == 0


def test_language_without_labels(spark, no_docs, odd_docs):
    model = language_id.train(no_docs)
    assert model.languages == [] and language_id.predict(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, model).collect()} == {"und"}
    assert language_id.accepted(odd_docs, model).filter("doc_id = 5").count() == 2


def test_toxic_words():
    bad = ["dunderhead", "nincompoop", "blockhead"]
    rng = np.random.default_rng(3)
    syllables = ["ra", "ti", "lo", "mes", "kan", "vor", "shi", "el", "qua", "bir"]
    word = lambda: "".join(rng.choice(syllables, 3))
    clean = [[word().encode() for _ in range(60)] for _ in range(400)]
    toxic = [[word().encode() for _ in range(60)] + [str(rng.choice(bad)).encode()] for _ in range(120)]
    counts = Counter(p for d in clean[80:] for p in toxicity.distinct_pieces(d))
    model = toxicity.fit(toxic, counts, 320, clean[:80])
    score = lambda text: float(model.score(model.margins(toxicity.sentence_words(text.encode()))[:, 0]).max())
    for text in ("such a blockhead there", "such a b.l.o.c.k.h.e.a.d there", "what a d u n d e r h e a d you are", "BLOCKHEAD!", "bl0ckhead"):
        assert score(text) >= 0.5, text
    assert all(score(" ".join(word() for _ in range(40))) < 0.5 for _ in range(50))


def test_subsequence_kernel():
    k = toxicity.kernel(["idiot", "idxiot", "banana"], ["idiot"])[:, 0]
    assert k[0] == pytest.approx(1, abs=1e-5) and k[0] > k[1] > k[2] and k[1] > 0.4


def test_toxicity_of_odd_rows(odd_docs, no_docs, labels, odd_rows):
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    untrained = toxicity.train(odd_docs, labels.filter("false"))
    assert all(r["predicted"] == 0 for r in toxicity.score(odd_docs, untrained).collect())
    assert toxicity.score(no_docs, untrained).count() == 0


@pytest.mark.parametrize("n", [1000, 8000])
def test_toxicity_calibrates_on_other_documents(spark, n, monkeypatch):
    docs = spark.range(n).selectExpr("id AS doc_id", "repeat(char(97 + id % 26), 1 + cast(id / 26 AS int) % 20) || 'x' || translate(string(id), '0123456789', 'abcdefghij') AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 50 = 0 AS int) AS toxic")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda toxic, in_good, n_clean, clean: seen.update(used=set(in_good), n=n_clean, clean=clean))
    toxicity.train(docs, labels, clean_rows=300)
    other = {p for d in seen["clean"] for p in toxicity.distinct_pieces(d)}
    assert len(seen["clean"]) == 400 and seen["n"] == 300 and other and not other & seen["used"]


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = QUERIES["op5_quality"](spark, SF).join(labels, "doc_id").toPandas()
    held = told[told.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95


def test_quality_of_odd_rows(odd_docs, no_docs, labels, odd_rows):
    field = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, field).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    untrained = quality.train(odd_docs, labels.filter("false"))
    assert all(r["predicted"] == 1 for r in quality.score(odd_docs, untrained).collect())
    assert quality.score(no_docs, untrained).count() == 0


def test_forward_backward():
    rng = np.random.default_rng(2)
    field = quality.LineField(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)))
    x = rng.normal(size=(5, quality.WIDTH)) * 0.3
    weight = {}
    for code in range(32):
        y = [code >> i & 1 for i in range(5)]
        s = sum(float(x[i] @ field.weights) * y[i] for i in range(5)) + sum(field.pairs[y[i], y[i + 1]] for i in range(4))
        weight[tuple(y)] = math.exp(s)
    total = sum(weight.values())
    p, joint, log_total = field.marginals(x)
    assert log_total == pytest.approx(math.log(total))
    for i in range(5):
        assert p[i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / total)
    assert joint.sum((1, 2)) == pytest.approx(np.ones(4))


def brute_base(rows):
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    train = [i for i in words if crc("" if i is None else i) != 1]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()) + len(train), len(c) + (1 if train else 0)
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    return {i: (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, sum(log(c[x]) for x in w) + log(len(train))) for i, w in words.items()}


def test_base_scores(spark, unique_rows):
    rows = [(i, r[1]) for i, r in unique_rows.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.score(docs, remainder() != 1).collect()
    want = brute_base(rows)
    assert len(got) == len(rows)
    for r in got:
        n_tokens, n_known, n, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_tree_beats_the_base(spark):
    told = QUERIES["op7_lm_scoring"](spark, SF).toPandas()
    held = told[told.held_out]
    assert held.score.sum() > 0.9 * held.base_score.sum() and (held.score > held.base_score).mean() > 0.9


def test_no_training_texts(spark, odd_docs, odd_rows, no_docs):
    from pyspark.sql import functions as F

    rows = suffix_tree.score(odd_docs, F.lit(False)).collect()
    assert len(rows) == len(odd_rows) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in rows)
    assert suffix_tree.score(no_docs, remainder() != 1).count() == 0


def brute_tree(rows, learn):
    """Score of each text by the tree over all tokens, counted in full."""
    words = {i: ["<s>", *t.lower().split(), "</s>"] for i, t in rows}
    level = [Counter() for _ in range(4)]
    for i in learn:
        for at in range(1, len(words[i])):
            for k in range(min(3, at) + 1):
                level[k][tuple(words[i][at - k : at]), words[i][at]] += 1
    total = Counter()
    for counts in level:
        for (c, _), n in counts.items():
            total[c] += n
    n_next = Counter(c for counts in level for c, _ in counts)
    once, twice = (sum(n == k for n in level[0].values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.75
    gain = Counter()
    for k in (1, 2, 3):
        for (c, w), n in level[k].items():
            gain[c] += n * math.log(n / total[c] / (level[k - 1][c[1:], w] / total[c[1:]]))
    kept = {c for c in total if c and total[c] >= suffix_tree.LEAST_USES and gain[c] >= suffix_tree.LEAST_GAIN + suffix_tree.GAIN_EACH * n_next[c]}

    def p(c, w):
        if not c:
            n = level[0][(), w]
            return (n - d if n else d * len(level[0])) / total[()]
        back = p(c[1:], w)
        return (level[len(c)][c, w] + 8 * back) / (total[c] + 8) if c in kept else back

    return {i: sum(math.log10(p(tuple(w[max(0, at - 3) : at]), w[at])) for at in range(1, len(w))) for i, w in words.items()}, kept


@pytest.mark.parametrize("hot,part,chunk", [(1 << 18, 1 << 18, 1 << 19), (40, 700, 3000), (0, 150, 900)])
def test_rare_contexts_count_in_a_large_corpus(spark, monkeypatch, hot, part, chunk):
    # With small bounds, hot contexts of every length are dealt to several parts.
    monkeypatch.setattr(suffix_tree, "HOT_USES", hot)
    monkeypatch.setattr(suffix_tree, "PART_POSITIONS", part)
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(suffix_tree, "SLICES", 2)
    # "zig zag zog" makes up less than 1/10,000 of all tokens.
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 1000) % 5000)) for i in range(80)]
    rows += [(100 + i, f"w{i} zig zag zog w{i + 9}") for i in range(6)]
    rows += [(200, "zig zag zog"), (201, "zog zig zag never"), (202, ""), (203, "never ever w1"), (120, "w1 " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, docs["doc_id"] < 200).collect()}
    want, kept = brute_tree(rows, [i for i, _ in rows if i < 200])
    assert {("zig",), ("zag",)} <= kept and max(map(len, kept)) == 3
    assert got == pytest.approx(want)


def test_chunks_move_once_and_scores_come_by_chunk(spark, monkeypatch):
    from rowloom.session import stage, stage_buckets

    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 20)
    docs = spark.range(40).selectExpr("id AS doc_id", "concat_ws(' ', 'a', 'b', 'w' || id % 7, 'u' || id) AS text").repartition(2)
    chunks = stage_buckets(suffix_tree.read_chunks(docs, docs["doc_id"] < 30), "chunks", ["first"], 3)
    told = stage_buckets(suffix_tree.told_words(chunks, 4), "told", ["first"], 3)
    # 30 ends, a and b each, the seven words and the 30 that occur once.
    assert told.groupBy().sum("tokens", "kinds", "once").first()[:] == (150, 3 + 7 + 30, 30)
    whole = suffix_tree.numbered(chunks, told, suffix_tree.Counts(150, 40, texts=40))
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    whole, counts = stage(whole, "numbered"), suffix_tree.Counts(150, 40, texts=40, slices=1)
    scores = suffix_tree.slice_scores(suffix_tree.dealt(whole, 0, 1, counts), None, counts)
    assert scores.count() <= whole.count() == chunks.count() < 40
