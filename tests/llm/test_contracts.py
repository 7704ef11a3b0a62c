"""Every registered query over the smallest tables against brute force, and odd rows that queries and operators must stand."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import embedding_dedup as M
from docsieve.llm import queries as Q
from docsieve.llm.bpe import Codec, refuse_others
from docsieve.llm.language_id import fit_languages, held_in, identify, is_held_out
from docsieve.llm.line_dedup import dedup_lines
from docsieve.llm.quality import fit_quality, score_quality
from docsieve.llm.token_counts import BYTE_SCORE, pre_tokens, sentencepiece_pieces, zipf_scores

from .test_similarity import components
from .test_text_operators import rule_spans, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows(df, key="doc_id"):
    got = df.collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def sets(docs, k):
    out = {}
    for i, t in docs.items():
        w = [x for x in (t or "").translate(LOWER).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    return out


def test_op1(spark, sf, docs):
    s = sets(docs, 3)
    owners = defaultdict(list)
    for i, x in s.items():
        for g in x:
            owners[g].append(i)
    common = Counter(p for o in owners.values() for p in itertools.combinations(sorted(o), 2))
    want = components(s, [(a, b) for (a, b), c in common.items() if 100 * c >= 90 * (len(s[a]) + len(s[b]) - c)])
    got = rows(Q.op1_ngram_jaccard_join(spark, sf))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(x), want[i]) for i, x in s.items()}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op2_and_op8(spark, sf, docs):
    got = rows(Q.op2_quality_classifier(spark, sf))
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == set(docs) and all(r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in got.items())
    known = [i for i in label if held(i) and i in got]
    assert np.mean([(got[i]["score"] >= 0.5) == (label[i] == 1) for i in known]) > 0.85
    assert dict(Q.op2_quality_classifier(spark, sf).dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = rows(Q.op8_language_id(spark, sf))
    assert set(got) == set(docs) and all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, docs[i] or ""))) for i, r in got.items())
    known = [i for i, x in lang.items() if held(i) and x is not None and got[i]["lang_pred"] != "und"]
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in known]) > 0.9


def test_op3(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_file())
    for i, r in rows(Q.op3_bpe_encoding(spark, sf)).items():
        ids = t.encode(docs[i] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False)))


def test_bpe_of_all_code_points():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_file())
    spec = open(Q.tokenizer_file(), encoding="utf-8").read()
    c = Codec(spec)
    every = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    # planes without assigned letters are sampled
    every = [x for x in every if ord(x) < 0x30000 or ord(x) % 97 == 0]
    marks = [x for x in every if not x.isascii() and x.isprintable() and not x.isalnum()]
    texts = [" ".join(f"a{x}b {x}" for x in every[i : i + 64]) for i in range(0, len(every), 64)]
    texts += ["b́" + "b̸b́".join(marks[i : i + 64]) for i in range(0, len(marks), 64)]
    assert c.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    import json

    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            refuse_others(json.loads(spec) | change)


def test_op4(spark, sf, docs):
    items = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            items[tuple(w[i : i + m])].add(str(r["item_id"]))
    sizes = sorted({len(p) for p in items})
    for i, r in rows(Q.op4_benchmark_decontamination(spark, sf)).items():
        w, hit, own = words(docs[i]), set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                if (found := items.get(tuple(w[j : j + m]))) is not None:
                    hit |= set(range(j, j + m))
                    own |= found
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit))


def test_op5(spark, sf, docs):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    lines = {i: (t or "").split("\n") for i, t in docs.items()}
    holders = defaultdict(set)
    for i, own in lines.items():
        for x in own:
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    for i, r in rows(Q.op5_line_dedup(spark, sf)).items():
        kept = [x for x in lines[i] if not (len(h := holders.get(key(x), ())) >= 2 and i != min(h))]
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (len(lines[i]), len(lines[i]) - len(kept), sha("\n".join(kept)))


def pairs_of(vectors, labels, threshold=0.93):
    v = np.array(vectors, float)
    n = np.linalg.norm(v, axis=1)
    pair = (v @ v.T) / np.outer(n, n) >= threshold
    pair &= np.array(labels)[:, None] == np.array(labels)[None, :]
    np.fill_diagonal(pair, False)
    return pair


def test_op6(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    good = [r for r in data if r["embedding"] is not None and r["label"] is not None and len(r["embedding"]) == 64 and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    pair = pairs_of([r["embedding"] for r in good], [r["label"] for r in good])
    got = rows(Q.op6_embedding_near_dedup(spark, sf), "vec_id")
    ids = [r["vec_id"] for r in good]
    assert len(got) == len(data) and sum(got[i]["n_links"] for i in ids) >= 0.99 * pair.sum()
    assert all(got[i]["n_links"] <= d for i, d in zip(ids, pair.sum(axis=1)))
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert all(got[r["vec_id"]]["n_links"] == 0 for r in data if r["vec_id"] not in set(ids))


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings_with_cores_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(24)
    hot = [centre + 0.05 * rng.standard_normal(24) for _ in range(120)] + [centre + 0.35 * rng.standard_normal(24) for _ in range(60)]
    data = [(i, [float(x) for x in v], 1) for i, v in enumerate(hot)]
    big = [float(x) for x in centre * 1e200], [float(x) for x in centre * 1e-200], [float(x) for x in (centre + 0.001) * 1e-200]
    data += [(500 + i, v, 2) for i, v in enumerate(big)]
    data += [(600, None, 1), (601, [], 1), (602, [0.0] * 24, 1), (None, [1.0] * 24, 1), (700, [2.0] * 24, 3), (700, [3.0] * 24, 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("bucket", F.lit("clash")).withColumn("id", F.lit(0))
    got = M.near_duplicates(df).collect()
    assert len(got) == len(data)
    by = {r["id"]: r for r in got}
    pair = pairs_of(hot, [1] * len(hot))
    assert sum(by[i]["n_links"] for i in range(len(hot))) >= 0.98 * pair.sum() and all(by[i]["n_links"] <= pair[i].sum() for i in range(len(hot)))
    assert all(by[500 + i]["n_links"] == 2 and by[500 + i]["component_id"] == 500 for i in range(3))
    assert all(by[i]["n_links"] == 0 for i in (600, 601, 602, None)) and [r["n_links"] for r in got if r["id"] == 700] == [1, 1]
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_op7(spark, sf, docs):
    got = rows(Q.op7_sharding(spark, sf))
    sizes, slots = Counter(), defaultdict(list)
    for i, r in got.items():
        raw = (docs[i] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(got) == set(docs) and set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got.values())
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 0.01 * sum(sizes.values()) / 8 + 2 * largest


def test_op9(spark, sf, docs):
    for i, r in rows(Q.op9_secret_scans(spark, sf)).items():
        base = rule_spans(docs[i])
        count = Counter(k for _, _, k in base)
        shown = [f"{k}:{s}:{e}" for s, e, k in base]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (count["assign"], count["access"], count["hex"], sha(",".join(shown)))
        assert set(shown) <= set(r["spans"].split(",")) or not shown


def test_op10(spark, sf, docs):
    scores = zipf_scores(sentencepiece_pieces(Q.tokenizer_file("piece_bpe_32k.model")))
    longest, known = max(map(len, scores)), {}

    def count(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + (scores.get(word[end - 1], BYTE_SCORE * n)), best[end - 1][1] - (1 if word[end - 1] in scores else n))]
            options += [(best[j][0] + scores[word[j:end]], best[j][1] - 1) for j in range(max(0, end - longest), end - 1) if word[j:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    for i, r in rows(Q.op10_token_counts(spark, sf)).items():
        split = pre_tokens(docs[i] or "")
        for w in split:
            if w not in known:
                known[w] = count(w)
        assert (r["n_pre_tokens"], r["n_tokens"]) == (len(split), sum(known[w] for w in split))


def test_null_ids_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,), (5,), (6,)], "doc_id long")
    got = {r["doc_id"]: (r["i"], r["o"]) for r in df.select("doc_id", held_in("doc_id").alias("i"), is_held_out("doc_id").alias("o")).collect()}
    assert got.pop(None) == (False, False) and all(o == held(i) and a == (not o) for i, (a, o) in got.items())


def test_models_stand_odd_rows(spark):
    text = "a good sentence that reads well."
    odd = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, text, "z"), (2, None, None), (3, "", "q"), (4, "### $$$ " * 50_000, "q")], "doc_id long, text string, score string").withColumn("row", F.lit(1)).withColumn("a.b", F.lit(2))
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    model = fit_quality(odd, labels, sample_rows=3)
    got = score_quality(odd, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["row"]["text"] == text}) == 1
    assert score_quality(odd.limit(0), model).count() == 0 and fit_quality(odd.limit(0), labels).bias == 0.0
    learned = fit_languages(odd.withColumn("lang", F.lit("en")))
    said = identify(odd.withColumn("lang_pred", F.lit("clash")), learned).collect()
    assert len(said) == 6 and {r["lang_pred"] for r in said} == {"en", "und"}


def test_hot_lines_are_split(spark):
    hot = spark.range(20_000).selectExpr("id AS doc_id", "concat('a line that all documents share', chr(10), 'own line number ', id) AS text").repartition(8)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = dedup_lines(hot)
        assert sum(r["n_dropped"] for r in out.collect()) == 19_999
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pipeline_stands_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    words_ = "the house of water tree stone river bird under green".split()
    text = lambda i: " ".join(f"{w} {w}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for w in words_ * 2)
    data = [(i, text(i), "en", "s", i) for i in range(40)] + [(None, text(50), "en", None, None), (60, None, None, "s", 0), (61, "", "en", "s", 0), (7, text(55), "en", "s", 1), (62, text(56) * 400, "en", "s", 2), (63, "12 345", "en", "s", 0), (64, text(3), "en", "s", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("a.b", F.lit(2))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(text(5).split()[3:17])), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    out = pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r["doc_id"] for r in out)
    assert max(ids.values()) == 1 and None in ids and 62 in ids and 64 not in ids and 5 not in ids and not {60, 61, 63} & set(ids)
    assert set(range(40)) - {5} <= set(ids)
    none = tmp_path / "none"
    df.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert pipeline.run(spark, str(none)).count() == 0
