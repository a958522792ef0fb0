"""Top-k, near duplicates, decontamination, toxicity and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, decontamination, near_duplicates, secrets, sentencepiece_codec, topk_search, toxicity
from tidemark.llm.common import Scratch

WORDS = [f"w{i}" for i in range(2000)]


def test_topk_equals_sql(spark, data, monkeypatch):
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    want = sorted(duck.sql(topk_search.SQL).fetchall())
    assert sorted(map(tuple, topk_search.op2_topk(spark, data).collect())) == want
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    monkeypatch.setattr(topk_search, "CELLS", 100)
    monkeypatch.setattr(topk_search, "SCAN_BYTES", 2000)
    assert sorted(map(tuple, topk_search.op2_topk(spark, data).collect())) == want


def test_topk_of_many_queries_and_hard_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    plain, skew = rng.normal(size=(300, 12)), rng.normal(size=(300, 12)) * np.array([5] * 3 + [0.01] * 9)
    for vectors, scale in ((plain, 1), (skew, 1), (np.round(plain), 1), (-np.abs(plain), 1), (plain, 2.0**17)):
        held = [(i % 290, [float(x) * scale for x in v]) for i, v in enumerate(vectors)] + [(None, [1.0] * 12)]
        df = spark.createDataFrame(held, "vec_id long, embedding array<double>")
        v = np.array([[int(np.floor(1024.0 * e)) for e in x] for i, x in held if i is not None], dtype=object)
        ids = np.array([i for i, _ in held if i is not None])
        first = {}
        for i, x in zip(ids.tolist(), v.tolist(), strict=True):
            first[i] = min(first.get(i, x), x)
        monkeypatch.setattr(topk_search, "QUERIES", 64)
        monkeypatch.setattr(topk_search, "CELLS", 5000)
        got = defaultdict(list)
        for r in topk_search.top_k(df, df, 5).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert got.keys() == first.keys()
        for i, x in first.items():
            score = [int(n) for n in v @ np.array(x, dtype=object)]
            want = sorted(((int(j), n) for j, n in zip(ids, score, strict=True) if j != i), key=lambda p: (-p[1], p[0]))[:5]
            assert got[i] == want


def test_the_cutoff_spares_products(spark):
    rng = np.random.default_rng(9)
    falling = 0.9 ** np.arange(64)  # as vectors of principal components are
    q, c = (np.floor(1024 * x * falling).astype(np.int64) for x in (rng.normal(size=(50, 64)), rng.normal(size=(4000, 64))))
    made = []

    class Counted(topk_search._Scores):
        def part(self, j):
            made.append(j)
            return super().part(j)

    whole = q @ c.T
    cutoff = np.sort(whole, axis=1)[:, -10]
    i, j, score = topk_search._sufficient(Counted(q, c), cutoff)
    assert len(made) < topk_search.LISTS and (score == whole[i, j]).all()
    assert {*zip(i.tolist(), j.tolist(), strict=True)} >= {*zip(*(x.tolist() for x in np.nonzero(whole >= cutoff[:, None])), strict=True)}


def test_topk_edges(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (7, [-1.0]), (8, []), (100, [-0.001, 0.25, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: [int(np.floor(1024 * x)) for x in e] for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    got = defaultdict(list)
    for r in topk_search.top_k(df, df.where("vec_id % 100 = 0"), 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in (0, 100):
        score = lambda i, q=q: sum(a * b for a, b in zip(v[q], v[i], strict=False))
        assert got[q] == [(i, score(i)) for i in sorted((i for i in v if i != q), key=lambda i: (-score(i), i))[:3]]
    assert topk_search.top_k(df.where("false"), df.where("false"), 3).count() == 0


def brute_components(docs, k):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(docs[a][0]), find(docs[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(docs, sets, strict=True)}


def near_texts():
    rng = random.Random(7)
    base = [rng.choice(WORDS) for _ in range(90)]
    texts = [None, "", " \n", "one", "one two three", "ONE two three", "one two three four", "a b c d e"]
    for _ in range(60):  # near copies, some at the threshold
        w = [*base]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    shared = " ".join(base[:45])
    texts += [shared + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    texts += ["the same text again and again"] * 40 + [" ".join(rng.choice(WORDS) for _ in range(50)) for _ in range(30)]
    return texts


@pytest.mark.parametrize(("block", "size"), [(1024, 8 << 20), (8, 8 << 20), (1024, 2000)])
def test_near_duplicates_equal_brute_force(spark, docs_of, tmp_path, monkeypatch, block, size):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", size)
    texts = near_texts()
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_components(list(enumerate(texts)), 4)
    for r in near_duplicates.op5_near_duplicates(spark, str(tmp_path)).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_a_hot_bucket_of_related_texts(spark, docs_of, monkeypatch):
    """Hundreds of texts that share most of their words, of which few are similar enough."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 32)
    rng = random.Random(13)
    base = [rng.choice(WORDS) for _ in range(60)]
    texts = []
    for _ in range(250):
        w = [*base]
        for p in rng.sample(range(0, 60, 5), rng.randint(1, 3)):
            w[p] = rng.choice(WORDS)
        texts.append(" ".join(w))
    want = brute_components(list(enumerate(texts)), 4)
    got = {r.id_: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs_of(texts), k=4).collect()}
    assert got == want and len({c for _, c in want.values()}) < 250


def test_near_duplicates_edges(spark, docs_of):
    assert near_duplicates.near_duplicates(docs_of([])).count() == 0
    same = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = [(r.id_, r.component_id) for r in near_duplicates.near_duplicates(same).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (None, None), (None, None)]


def test_local_links_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    sets += [s[:-1] if len(s) > 1 else s for s in sets[:20]]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)}
    assert {*zip(*(x.tolist() for x in near_duplicates._local_links(sets, 0, 80)), strict=True)} == want
    assert {*zip(*(x.tolist() for x in near_duplicates._local_links(sets, 25, 80)), strict=True)} == {p for p in want if p[0] < 25 <= p[1]}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5), (7, 6), (7, 6)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.comp for r in components.components(df, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{100 + i: 100 for i in range(1, 20)}}
    assert components.components(df.where("false"), Scratch(spark)).count() == 0


def brute_matches(text, items):
    words = decontamination.WORD.findall((text or "").lower())
    count = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1))
    out = {}
    for key, item in items:
        own = decontamination.WORD.findall((item or "").lower())
        if not own or not words:
            continue
        b = count(own)
        for a in range(max(1, len(words) - len(own) + 1)):
            c = count(words[a : a + len(own)])
            s = sum((b & c).values()) / sum((b | c).values())
            if s >= 0.8 and s > out.get(key, (0, 0))[0]:
                out[key] = (s, a)
    return sorted((k, a, round(s, 9)) for k, (s, a) in out.items())


@pytest.mark.parametrize("most", [20_000, 4])
def test_decontamination_equals_brute_force(spark, docs_of, monkeypatch, most):
    monkeypatch.setattr(decontamination, "ITEMS", most)
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 16, 30, 38, 38, 59, 38])] + [(10, None), (11, ""), (12, "...")]
    items.append((13, items[6][1]))
    texts = [None, "", "w1"]
    for k in range(80):
        w = items[rng.randrange(10)][1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"z{k}"
        if k % 9 == 0:
            w = w[1:]
        around = [rng.choice(WORDS) for _ in range(rng.randint(0, 50))]
        p = rng.randint(0, len(around))
        texts.append(" ".join([*around[:p], *w, *around[p:]]).upper().replace(" ", ", "))
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = defaultdict(list)
    for r in decontamination.benchmark_matches(docs_of(texts), frame).collect():
        got[r.doc_id].append((r.item_id, r.start_word, round(r.similarity, 9)))
    want = {i: m for i, t in enumerate(texts) if (m := brute_matches(t, items))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 30
    left = {r.doc_id for r in decontamination.without_benchmark(docs_of(texts), frame).collect()}
    assert left == set(range(len(texts))) - want.keys()
    none = frame.where("false")
    assert decontamination.benchmark_matches(docs_of(texts), none).count() == 0
    assert decontamination.without_benchmark(docs_of(texts), none).count() == len(texts)


def test_many_equal_items_are_one_text(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 50)
    texts = [" ".join(WORDS[20 * i : 20 * i + 20]) for i in range(60)]
    items = spark.createDataFrame([(i, texts[0]) for i in range(10_000)] + [(20_000 + i, t) for i, t in enumerate(texts)] + [(None, texts[1])], "item_id long, text string")
    held = decontamination._Items(items, "item_id", "text")
    assert held.blocks == 2 and sum(len(held.index(b).ids) for b in range(2)) == 60
    docs = docs_of(["x y z " + texts[0], texts[1] + " and more", "none of it at all", None])
    got = decontamination.benchmark_matches(docs, items).groupBy("doc_id").count()
    assert {tuple(r) for r in got.collect()} == {(0, 10_001), (1, 2)}
    assert sorted(r.doc_id for r in decontamination.without_benchmark(docs, items).collect()) == [2, 3]
    with pytest.raises(ValueError):
        decontamination.benchmark_matches(docs, items, item="doc_id")


def test_long_items_are_compared_in_blocks():
    rng = random.Random(4)
    words = [rng.choice(WORDS) for _ in range(9000)]
    item = " ".join(words[500:8500])
    index = decontamination.ItemIndex([(1, item)])
    (got,) = index.matches(" ".join(words))
    assert got[:2] == (1, 500) and got[2] == 1.0
    assert brute_matches(" ".join(words[:1200]), [(1, " ".join(words[100:1000]))]) == [(k, a, round(s, 9)) for k, a, s in decontamination.ItemIndex([(1, " ".join(words[100:1000]))]).matches(" ".join(words[:1200]))]


def test_index_finds_all_within_the_radius():
    rng = random.Random(2)
    index = decontamination.ItemIndex([(i, " ".join(rng.choice(WORDS) for _ in range(20))) for i in range(50)])
    for _ in range(300):
        f = index.prints[rng.randrange(50)] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 40)))
        assert sorted(index.within(20, f)) == [i for i, p in enumerate(index.prints) if (p ^ f).bit_count() <= decontamination.RADIUS]


def test_folding():
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" 12! ") [:1] == " "
    assert toxicity.fold("You ІDІОT, 1d10t! i$land") == " you idiot idiot island "


def test_toxicity_held_out(spark):
    got = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    both = got.merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.01


def plain_hits(model, folded):
    """Longest entry at each place, less those inside an exception."""
    spared = [(a, a + len(p)) for p in model.exceptions for a in range(len(folded)) if folded.startswith(p, a)]
    out = []
    for a in range(len(folded)):
        found = [t for t in model.lexicon if folded.startswith(t, a)]
        if found and not any(x <= a and a + len(max(found, key=len)) <= y for x, y in spared):
            out.append(model.lexicon[max(found, key=len)])
    return out


def plain_score(model, text):
    folded = toxicity.fold(text)
    total = sum(plain_hits(model, folded))
    x, y = np.log1p(total), np.log1p(100 * total / max(1, len(folded.split())))
    a, b, c = model.logistic
    return 1 / (1 + np.exp(-(a + b * x + c * y)))


def plain_lexicon(texts, toxic):
    """Entries and weights from all words and word beginnings, best first, none beside one that it begins or that begins it."""
    n = {y: sum(t == y for t in toxic) for y in (True, False)}
    held = {True: Counter(), False: Counter()}
    for t, y in zip(texts, toxic, strict=True):
        held[y].update({f" {w[:k]}" for w in toxicity.fold(t).split() for k in range(3, 9) if k <= len(w)} | {f" {w} " for w in toxicity.fold(t).split() if len(w) >= 3})
    rated = []
    for t, a in held[True].items():
        b = held[False][t]
        table = np.array([[a, b], [n[True] - a, n[False] - b]], dtype=float)
        expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / table.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * np.nansum(np.where(table > 0, table * np.log(table / expected), 0))
        p, q = a / n[True], b / n[False]
        if p > q and p >= 7 / 3 * q and a >= 3 and ratio >= toxicity.LEAST_RATIO and _precise(a, b, n):
            rated.append((round(ratio, 6), len(t), t, np.log((a + 0.5) / (n[True] + 1)) - np.log((b + 0.5) / (n[False] + 1))))
    chosen = {}
    for _, _, t, w in sorted(rated, key=lambda r: (-r[0], -r[1], r[2])):
        if not any(c.startswith(t) or t.startswith(c) for c in chosen):
            chosen[t] = w
    return chosen


def _precise(a, b, n):
    base = n[True] / (n[True] + n[False])
    return a * (1 - base) >= 0.7 * (a * (1 - base) + b * base)


def test_toxicity_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = pd.read_parquet(f"{folder}/documents.parquet"), pd.read_parquet(f"{folder}/labels.parquet")
    both = docs.merge(labels[labels.toxic.notna()], on="doc_id").drop_duplicates("doc_id")
    frame = spark.createDataFrame(docs[["doc_id", "text"]], "doc_id long, text string")
    model = toxicity.learn(frame, spark.createDataFrame(both[["doc_id", "toxic"]].astype({"toxic": int}), "doc_id long, toxic int"))
    want = plain_lexicon(both.text.tolist(), [bool(x) for x in both.toxic])
    assert model.lexicon.keys() == want.keys() and all(abs(model.lexicon[t] - w) < 1e-9 for t, w in want.items()) and want
    few = docs.head(150)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame.where(F.col("doc_id").isin(few.doc_id.tolist())), model).collect()}
    for i, t in zip(few.doc_id, few.text, strict=True):
        assert abs(got[i] - plain_score(model, t)) < 1e-9


def test_toxicity_edges(spark, docs_of):
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, toxic int")
    docs = docs_of([None, "", "hello"])
    model = toxicity.learn(docs, labels)
    assert [r.score for r in toxicity.toxicity_scores(docs, model).collect()] == [0.0] * 3
    bad = toxicity.ToxicityModel({" clown ": 3.0, " scu": 2.0}, frozenset({" clown fish "}), (-2.0, 2.0, 0.0))
    assert bad.score("a clown") > 0.5 > bad.score("a clown fish") == bad.score(None)
    assert bad.score("SCUMMY") == bad.score("5cum")


def test_toxicity_learns_rare_terms_of_a_large_vocabulary(spark, docs_of, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TERMS", 5, raising=False)  # a cap that no longer exists
    common = " ".join(WORDS[100:130])
    docs = docs_of([common + (" scumbag" if i < 30 else "") for i in range(80)])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, toxic int")
    assert set(toxicity.learn(docs, labels).lexicon) == {" scumbag "}


@pytest.fixture(scope="module")
def staged(spark):
    folder = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder).toPandas()
        out.append((name, docs.toPandas(), made))
        if name != "encoding":
            docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    return out


SECRETS = [
    ("assign", 12, re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", 18, re.compile("(AKIA[A-Z0-9]+)")),
    ("hex", 16, re.compile("([0-9a-f]+)")),
]


def plain_redacted(text):
    """Secrets by plain search, those that overlap as one; texts of the tables hold none of the checksummed kinds."""
    found = sorted((m.start(), k, m.end()) for k, (_, least, r) in enumerate(SECRETS) for m in r.finditer(text) if len(m[1]) >= least)
    out, at = "", 0
    while found:
        a, k, b = found.pop(0)
        while found and found[0][0] < b:
            b = max(b, found.pop(0)[2])
        out, at = out + text[at:a] + f"[{SECRETS[k][0]}]", b
    return out + text[at:]


def test_pipeline_stages_against_brute_force(spark, staged):
    folder = "/root/testdata/sf0.01"
    items = list(pd.read_parquet(f"{folder}/benchmark.parquet").itertuples(index=False, name=None))
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    for name, given, made in staged:
        before, after = dict(zip(given.doc_id, given.text, strict=True)), set(made.doc_id)
        if name == "toxicity":
            labels = toxicity.training_rows(spark.read.parquet(f"{folder}/labels.parquet")).toPandas().dropna()
            both = given.merge(labels, on="doc_id")
            model = toxicity.learn(spark.read.parquet(f"{folder}/documents.parquet"), toxicity.training_rows(spark.read.parquet(f"{folder}/labels.parquet")))
            assert model.lexicon.keys() == plain_lexicon(both.text.tolist(), [bool(x) for x in both.toxic]).keys()
            assert after == {k for k, t in before.items() if plain_score(model, t) < 0.5} and after < before.keys()
        elif name == "near duplicates":
            assert after == {i for i, (_, c) in brute_components(sorted(before.items()), 5).items() if i == c}
        elif name == "benchmark":
            five = {tuple(w[i : i + 5]) for _, t in items for w in [decontamination.WORD.findall(t.lower())] for i in range(len(w) - 4)}
            near = {k: t for k, t in before.items() if any(tuple(w[i : i + 5]) in five for w in [decontamination.WORD.findall(t.lower())] for i in range(len(w) - 4))}
            assert after == before.keys() - {k for k, t in near.items() if brute_matches(t, items)}
        elif name == "secrets":
            assert dict(zip(made.doc_id, made.text, strict=True)) == {k: plain_redacted(t) for k, t in before.items()}
            assert (made.n_chars == made.text.str.len()).all() and any(made.text.str.contains("[assign]", regex=False))
        else:
            assert {k: list(x) for k, x in zip(made.doc_id, made.ids, strict=True)} == {k: sp.encode(t) for k, t in before.items()}
            assert made.reads_back.all() and (made.ids.str.len() == made.n_tokens).all()
        if name != "encoding":
            assert list(made.columns) == list(corpus_pipeline.COLUMNS)


def test_pipeline_of_nothing_and_of_copies(spark, docs_of, data):
    for texts, left in (([], 0), (["one text of some words, again and again"] * 30, 1)):
        docs = docs_of(texts)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        assert docs.count() == left


def test_pipeline_takes_edges(spark, docs_of, data):
    texts = [None, "", "a b c d e f", "a b c d e f", "token = abcdefghijklmnop", "x" * 20_000]
    docs = docs_of(texts)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        if name == "secrets":
            assert {r.doc_id: r.text for r in docs.collect()} == {0: None, 1: "", 2: "a b c d e f", 4: "[assign]", 5: "x" * 20_000}
    assert docs.count() == 5


def test_pipeline_duplicates_go_by_row(spark, data):
    same, near, other = "a b c d e f", " ".join(WORDS[:60]), "quite another text of some words"
    rows = [(7, same), (7, same), (None, same), (None, same), (3, near), (5, near + " x"), (5, other), (None, "only here and nowhere else at all"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.duplicates(spark, docs, data)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = [(7, same), (3, near), (5, other), (None, "only here and nowhere else at all"), (None, None), (None, None)]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
