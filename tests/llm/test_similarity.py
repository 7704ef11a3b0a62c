"""N-gram join, embeddings, language, quality and the pipeline against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import ngram_join as N
from docsieve.llm._graph import connected_components
from docsieve.llm.embedding_dedup import near_duplicates, plan_tables
from docsieve.llm.language_id import Sizer, fit_languages, identify, normal
from docsieve.llm.quality import FEATURES, features, fit, fit_quality, score_quality


def shingles(t, k):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed=3, n=150):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        if docs and rnd.random() < 0.6:
            w = rnd.choice(docs).split()
            for _ in range(rnd.randint(0, max(1, len(w) // 12))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append(" ".join(w))
        else:
            docs.append(" ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 9, 20, 60, 200]))))
    return docs


@pytest.mark.parametrize(("k", "num", "small"), [(3, 90, False), (5, 80, True)])
def test_ngram_components(spark, monkeypatch, k, num, small):
    if small:  # cells and regions that are dealt in blocks, and cut by pivots
        monkeypatch.setattr(N, "CELL_BLOCK", 4)
        monkeypatch.setattr(N, "REGION_BLOCK", 4)
    texts = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, " \n", None), (903, "solo", "x"), (904, "solo", "x")]
    df = spark.createDataFrame([*rows, rows[5], (None, texts[5], "x")], "doc_id long, text string, component_id string")
    got = {}
    for r in N.ngram_components(df, k=k, num=num).collect():
        assert got.setdefault(r["id"], (r["n_shingles"], r["component_id"])) == (r["n_shingles"], r["component_id"])
    sets = {i: shingles(t, k) for i, t, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert len(links) > 50
    assert got.pop(None)[1] is None
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_ngram_of_nothing(spark):
    assert N.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_two_texts_is_one_node(spark):
    a, b = "a b c d e f g h", "r s t u v w x y"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert {r["component_id"] for r in N.ngram_components(df).collect()} == {1}
    near = " ".join([b] * 5)
    df = spark.createDataFrame([(1, a), (1, near + " z"), (1, None), (2, near + " zz"), (3, None), (4, a)], "doc_id long, text string")
    assert {(r["id"], r["component_id"]) for r in N.ngram_components(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 1)}


def test_sets_that_fill_few_parts_link(spark, monkeypatch):
    # all shared shingles may lie in the parts that a link touches
    monkeypatch.setattr(N, "parts_of", lambda ring, link: np.where(N.most_differences(ring, link) == 0, 0, N.most_differences(ring, link) + 1))
    rnd = random.Random(6)
    texts = [[f"w{rnd.randrange(10**6)}" for _ in range(8)] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join([*t, "more"])) for i, t in enumerate(texts)]
    got = {r["id"]: r["component_id"] for r in N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == i for i in range(60))


@pytest.mark.parametrize("small", [False, True])
def test_a_hot_group_of_near_copies(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(N, "CELL_BLOCK", 16)
        monkeypatch.setattr(N, "REGION_BLOCK", 16)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    copies = []
    for i in range(300):
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        copies.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(copies)] + [(1000, "a text that is very long " * 20_000), (1001, "a text that is very long " * 20_001)]
    got = {r["id"]: r["component_id"] for r in N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=3, num=90).collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert got == components(sets, links) and len(links) > 10_000


def test_region_recursion_is_exact():
    rnd = random.Random(1)
    base = list(range(200))
    sets = [np.unique(np.array(rnd.sample(range(1000), 30) if i % 3 == 0 else [x if rnd.random() > 0.04 else 5000 + rnd.randrange(10**6) for x in base], np.uint64)) for i in range(90)]
    link = N.Link(90, 100)
    g = N._Region(sets, link)
    g.solve(np.arange(90))
    want = components(range(90), [(a, b) for a, b in itertools.combinations(range(90), 2) if link.holds(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))])
    assert [int(x) for x in g.root] == [want[i] for i in range(90)]
    # near copies are decided by pivots and by what pivots link, not pair by pair
    copies = [np.array([x if rnd.random() > 0.01 else 9000 + rnd.randrange(10**6) for x in base], np.uint64) for _ in range(200)]
    g = N._Region([np.unique(x) for x in copies], link)
    g.solve(np.arange(200))
    assert len(set(g.root.tolist())) == 1 and g.measured < 200 * 20


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r["node"], r["component"]) for r in connected_components(e).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    v = np.concatenate([centres[rng.integers(0, 40, 400)] + 0.15 * rng.standard_normal((400, 32)), centres[:20], centres[:20]])
    label = rng.integers(0, 3, len(v))
    label[-40:] = 0
    rows = [(i, [float(x) for x in v[i]], int(label[i])) for i in range(len(v))]
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (904, [1.0] * 32, None), (905, [], 1), (906, [1.0, 2.0], 1)]
    got = {r["id"]: r for r in near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    n = v / np.linalg.norm(v, axis=1)[:, None]
    pair = (n @ n.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(pair, False)
    found = sum(got[i]["n_links"] for i in range(len(v)))
    assert pair.sum() > 500 and found >= 0.97 * pair.sum()
    assert all(got[i]["n_links"] <= pair[i].sum() for i in range(len(v)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, *_ in odd)
    assert all(got[400 + i]["component_id"] == got[420 + i]["component_id"] for i in range(20))
    assert plan_tables(10**6, 0.93)[0] > plan_tables(10**3, 0.93)[0]


def test_languages(spark):
    docs = [(i, " ".join(random.Random(i).choices(["the", "of", "house", "tree", "water"], k=30)), "en") for i in range(40)]
    docs += [(100 + i, " ".join(random.Random(i).choices(["der", "und", "straße", "baum", "wasser"], k=30)), "de") for i in range(40)]
    odd = [(500, None, "en"), (501, "", "en"), (502, "123 !!", None), (503, "THE TREE OF WATER", None), (503, "THE TREE OF WATER", None), (504, "der baum und das wasser " * 20_000, "de")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string")
    learned = fit_languages(df)
    assert sorted(learned) == ["de", "en"]
    got = {r["row"]["doc_id"]: r for r in identify(df.select("doc_id", "text"), learned).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in docs)
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503, 504)] == ["und", "und", "und", "en", "de"] and got[502]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in identify(df, {}).collect()} == {"und"} and identify(df.limit(0), learned).count() == 0
    assert Sizer(learned).decide("the tree")[0] == "en"


def test_languages_are_learned_from_distinct_texts(spark):
    few = [(i, f"word{'abcdefghijkl'[i % 12]} same", "en") for i in range(6000)]
    hot = [(i, "hot copied text", "de") for i in range(3000)] + [(i, " ".join(random.Random(i).choices("abcdefgh", k=40)) + f" tail{chr(97 + i)}", "de") for i in range(20)]
    learned = fit_languages(spark.createDataFrame(few + hot, "doc_id long, text string, lang string"), sample_texts=100)
    assert all(f"word{x}".encode() in learned["en"] for x in "abcdefghijkl") and learned["en"].count(b"same") == 12
    assert all(f"tail{chr(97 + i)}".encode() in learned["de"] for i in range(20)) and learned["de"].count(b"hot") == 1


def test_languages_are_learned_from_whole_texts(spark):
    docs = [(i, "licence line " * 40 + " ".join("abcdefghij"[int(c)] * 3 for c in str(i * 7919 + 10**6)) * 8 + f" end{'abcdefghij'[i % 10]}", "fr") for i in range(60)]
    docs += [(100, "une phrase " * 30_000 + "finale", "fr")]
    learned = fit_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert sorted(learned["fr"].decode().split()) == sorted(w for _, t, _ in docs for w in normal(t).split())
    # no more texts than the bound, each of them whole
    some = fit_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"), sample_texts=7)
    assert sum(some["fr"].count(f" end{c} ".encode()) for c in "abcdefghij") in (6, 7) and set(some["fr"].split()) <= set(learned["fr"].split())


def test_sizes_equal_plain_compression(spark):
    """Every size, choice and margin against one call of the library for each block and dictionary."""
    import zstandard as z

    rnd = random.Random(4)
    vocab = {lang: ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(80)] for lang in ("aa", "bb", "cc")}
    text = lambda lang, n: " ".join(rnd.choices(vocab[lang], k=n))
    docs = [(i, text(lang, 40), lang) for i, lang in enumerate([*vocab] * 30)]
    asked = [(1000 + i, text(lang, n), lang) for i, (lang, n) in enumerate([(x, n) for x in vocab for n in (1, 2, 5, 40, 3000)])] + [(2000, "zz " * 400, None), (2001, "q", None)]
    learned = fit_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    got = {r["row"]["doc_id"]: r for r in identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), learned).collect()}
    for i, t, _ in asked:
        data = normal(t).encode()
        sizes = []
        for lang in sorted(learned):
            p = z.ZstdCompressionParameters.from_level(6, dict_size=len(learned[lang]), source_size=4096, write_content_size=False, write_checksum=False, write_dict_id=False)
            own = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(learned[lang], dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p)
            sizes.append(sum(len(own.compress(data[k : k + 4096])) for k in range(0, len(data), 4096)))
        best, second = sorted(sizes)[:2]
        assert Sizer(learned).sizes(t).tolist() == sizes
        assert got[i]["lang_pred"] == sorted(learned)[sizes.index(best)] and got[i]["rejected"] == (second - best < 0.002 * best)
    assert got[2000]["rejected"] or got[2001]["rejected"]


def test_quality(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choices(["word", "Sentence", "text", "reads", "well."], k=60))
    bad = lambda: " ".join(rnd.choices(["###", "$$$ a|", "%%%", "!!"], k=60))
    docs = [(i, good() if i % 2 else bad(), i % 2) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, ""), (902, "x " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs[:300]] + [(950, 1), (3, None)], "doc_id long, quality int")
    got = {r["row"]["doc_id"]: r["score"] for r in score_quality(df, fit_quality(df, labels)).collect()}
    assert sum((got[i] >= 0.5) == (y == 1) for i, _, y in docs[300:]) >= 98
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 403
    flat = fit_quality(df, labels.limit(0))
    assert {r["score"] for r in score_quality(df.limit(3), flat).collect()} == {0.5}


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape == (1, len(FEATURES))


def test_line_stage_leaves_no_husks(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = "a line that is long enough\nshort\n\n\t"
    rows = [(1, text), (2, text), (3, "a line that is long enough\n\n\t"), (4, "a line that is long enough\nother"), (5, "a line that is long enough"), (6, "brief"), (7, "brief"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    out = {r["doc_id"]: r["text"] for r in pipeline.line_stage(spark, docs, "").collect()}
    assert out == {1: text, 4: "other", 6: "brief", 7: "brief", None: text}


def test_stages_decide_rows_without_id(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    docs = spark.createDataFrame([(1, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (-4, text(4)), (-4, text(4))], "doc_id long, text string")
    kept = pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(-4, text(4)), (0, text(2)), (0, text(3)), (1, text(1))]
    passage = " ".join(text(2).split()[5:17])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert len(left) == 5 and text(2) not in {r["text"] for r in left}


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(4)
    words = {"en": ["the", "house", "of", "water", "tree", "stone", "river", "bird"], "de": ["der", "baum", "und", "straße", "wasser", "stein", "fluss", "vogel"]}
    text = lambda lang, n=60: " ".join(rnd.choice(words[lang]) + str(rnd.randrange(50)) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    passage = text("en", 14)
    near = rows[9][1].split()
    near[30] = "changed"
    rows += [(100, "12 34", "en", "s", 0), (101, rows[7][1], "en", "s", 0), (102, " ".join(near), "en", "s", 0), (103, f"{text('en')}\n{passage} {text('en')}", "en", "s", 0), (104, f"{rows[3][1]}\n{text('en')}", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(60), 104}  # no letters, a copy, a near copy and a benchmark passage are gone
    from docsieve.llm.bpe import Codec
    from docsieve.llm.queries import tokenizer_file

    codec = Codec(open(tokenizer_file(), encoding="utf-8").read())
    assert bytes(out[104]["ids"]) == codec.encode([rows[-1][1].split("\n")[1]])[0]
    assert all(len(out[i]["ids"]) == 4 * out[i]["n_tokens"] for i in out)
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
