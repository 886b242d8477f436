"""Learnt operators: held-out quality on the small tables, exact parts against plain re-computations."""
import math
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import fm, language, ngram, textcnn
from foldwise.llm.eliasfano import EliasFano, NgramTrie, quantise

SF01 = "/root/testdata/sf0.01"


def crc(k, mod):
    return zlib.crc32(str(k).encode()) % mod


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 10**9), (5, 5), (70, 3), (1000, 1200), (1000, 10**6), (50_000, 10**10)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    seq = EliasFano.encode(values)
    assert (seq.get(np.arange(n)).astype(np.int64) == values).all() if n else True
    asked = np.concatenate([values, rng.integers(0, top + 10, 500)])
    left = np.searchsorted(values, asked)
    there = (left < n) & (values[np.minimum(left, max(0, n - 1))] == asked) if n else np.zeros(len(asked), bool)
    assert (seq.find(asked) == np.where(there, left, -1)).all()


def test_trie_gives_back_what_it_holds():
    rng = random.Random(0)
    pairs = sorted({(rng.randrange(0, 300, 3), rng.randrange(500)) for _ in range(4000)})
    contexts = np.array(sorted({c for c, _ in pairs} | {299}))
    sizes = np.array([sum(c == x for x, _ in pairs) for c in contexts])
    logp, logb = -np.arange(1, len(pairs) + 1) / 700, -np.arange(1, len(contexts) + 1) / 90
    trie = NgramTrie(contexts, sizes, np.array([w for _, w in pairs]), logp, logb)
    asked = [(c, w) for c in range(0, 310, 7) for w in range(0, 510, 3)] + pairs
    got, back = trie.lookup(np.array([c for c, _ in asked]), np.array([w for _, w in asked]))
    held = dict(zip(pairs, logp))
    weight = dict(zip(contexts.tolist(), logb))
    for (c, w), p, b in zip(asked, got, back):
        assert math.isnan(p) if (c, w) not in held else abs(p - held[c, w]) <= np.ptp(logp) / 255
        assert abs(b - weight.get(c, 0)) <= np.ptp(logb) / 255
    codes, book = quantise(logp)
    assert codes.dtype == np.uint8 and np.abs(book[codes] - logp).max() <= np.ptp(logp) / 255


def slow_lm(texts, ids):
    """(tokens, known, base, score) of each text and the training tokens, by dictionaries."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for t in texts]
    train = [t for t, k in zip(tokens, ids) if k is not None and crc(k, 10) != 0]
    uni, two = Counter(w for t in train for w in t), Counter()
    for t in train:
        two.update(zip(["<start> of text", *t], t))
    n, v = sum(uni.values()), len(uni)
    context = Counter(uni) + Counter({"<start> of text": len(train)})
    out = []
    for t in tokens:
        base = score = 0.0
        for a, w in zip(["<start> of text", *t], t):
            p = (uni[w] + 0.1) / (n + 0.1 * (v + 1))
            c = context[a]
            b = c ** 0.75 / (c + c ** 0.75) if c else 1.0
            base += math.log10(p)
            score += math.log10((1 - b) * two[a, w] / c + b * p if c else p)
        out.append((len(t), sum(uni[w] > 0 for w in t), base, score))
    return out, n


@pytest.mark.parametrize("limits", [{}, {"batch_tokens": 150, "shard_bytes": 900, "split_count": 20}])
def test_lm_scores(spark, limits):
    """Small limits give many batches and shards, and split the frequent earlier words."""
    rng = random.Random(6)
    vocabulary = [f"w{min(k, rng.randrange(40))}" for k in range(40)] + ["É", "x#", "The"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 30, 120]))) for _ in range(80)] + [None, "", " \n", "the the THE " * 300]
    ids = [*range(len(texts) - 3), None, 5, 5]
    frame = spark.createDataFrame(list(zip(ids, texts, ["s"] * len(ids))), "doc_id long, text string, score string").repartition(3)
    rows = ngram.lm_scores(frame, **limits).collect()
    slow, n = slow_lm(texts, ids)
    want = sorted(((-1 if k is None else k, *s) for k, s in zip(ids, slow)), key=lambda r: (r[0], r[3], r[1]))
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows), key=lambda r: (r[0], r[3], r[1]))
    assert len(got) == len(want) and {r.train_tokens for r in rows} == {n}
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 and abs(g[4] - w[4]) <= 0.03 * w[1], (g, w)
    assert {r.held_out for r in rows if r.doc_id is None} == {None}
    assert all(r.held_out == (crc(r.doc_id, 10) == 0) for r in rows if r.doc_id is not None)


def test_lm_of_nothing(spark):
    assert ngram.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = ngram.lm_scores(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (1, 0, 0) and row.score == row.base_score


def tables(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    y = (np.arange(60) % 2).astype(float)
    texts = [b"good words here %d" % k if k % 2 else b"##bad## ##bad## %d" % k for k in range(60)]
    features = [fm.featuriser()(t, len(t)) for t in texts]
    model = fm.fit([w for w, _ in features], np.array([s for _, s in features]), y)
    index, value, starts = model.csr([features[0][0]], np.array([features[0][1]]))
    x = np.zeros(len(model.w))
    np.add.at(x, index, value)
    used = np.flatnonzero(x)
    pairs = sum(float(model.v[i] @ model.v[j]) * x[i] * x[j] for a, i in enumerate(used) for j in used[a + 1:])
    assert abs(model.margin(index, value, starts)[0][0] - (model.bias + float(model.w[used] @ x[used]) + pairs)) < 1e-4
    scores = model.score([w for w, _ in features], [s for _, s in features])
    assert ((scores >= 0.5) == (y == 1)).all() and rng is not None


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    scored = fm.quality_scores(docs, fm.train_quality(docs, labels), out="q").join(labels, "doc_id").select("doc_id", "q.*", F.col("quality").alias("y")).toPandas()
    held = scored[[crc(k, 4) == 2 for k in scored.doc_id]]
    assert held.score.between(0, 1).all() and (held.predicted == (held.score >= 0.7)).all()
    assert (held.predicted == held.y).mean() >= 0.88 and held[held.y == 1].predicted.mean() >= 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    model = textcnn.train_toxicity(docs, labels)
    scored = textcnn.toxicity_scores(docs, model).join(labels, "doc_id").select("doc_id", "toxicity.*", "toxic").toPandas()
    held = scored[[crc(k, 4) == 2 for k in scored.doc_id]]
    assert (held.predicted == (held.score >= 0.3)).all() and (held.flagged == (held.score >= held.language_threshold)).all()
    # few labelled rows here, and fewer still of the smaller languages
    assert held[held.toxic == 1].score.mean() > 5 * held[held.toxic == 0].score.mean()


def test_long_texts_are_scored_in_blocks_like_short_ones(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 1 << 36, n) for n in (0, 1, 2, 3, 40, 500, 5000)]
    y = np.array([0, 1, 0, 1, 0, 1, 0], dtype=float)
    model = textcnn.fit(texts, y, ["en"] * 7, epochs=1, steps=3)
    together = model.score(texts)
    monkeypatch.setattr(textcnn, "BLOCK", 64)
    assert np.allclose(model.score(texts), together, atol=1e-6)
    assert np.allclose([model.score([t])[0] for t in texts], together, atol=1e-6)


def test_classifiers_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (None, "", 3, "x"), (2, "some words", 10, None), (2, "some words", 10, None)], "doc_id long, text string, n_chars long, toxicity string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    quality = fm.quality_scores(docs, fm.train_quality(docs, labels)).collect()
    assert [r.quality.score for r in quality] == [0.5] * 4
    toxic = textcnn.toxicity_scores(docs, textcnn.train_toxicity(docs, labels)).collect()
    assert [r.toxicity.score for r in toxic] == [0.5] * 4
    none = docs.limit(0)
    assert fm.quality_scores(none, fm.train_quality(none, labels)).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = tables(spark)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = fm.train_quality(docs, labels), fm.train_quality(docs, turned)
    assert np.array_equal(one.w, other.w) and np.array_equal(one.v, other.v)


def test_language_of_documents(spark):
    docs, _ = tables(spark)
    model = language.train_text_model(docs)
    rows = language.language_fusion(docs, model, host="source").select("doc_id", "lang", "language.*").toPandas()
    held = rows[[crc(k, 4) == 2 for k in rows.doc_id]]
    assert (held.language == held.lang).mean() >= 0.98 and rows.kept.mean() >= 0.99


@pytest.fixture(scope="module")
def text_model(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the house and the garden with trees", "en"), ("das Haus und der Garten mit Bäumen", "de")] * 20)], "doc_id long, text string, lang string")
    return language.train_text_model(docs, held_out=None)


def test_evidence_is_fused(spark, text_model):
    """A text without a telling word follows its markup; without markup, its host's other pages; a host without any, its domain's."""
    page = lambda text, lang=None: f"<html{f' lang={lang}' if lang else ''}><script>das das</script><p>{text}</p>"
    rows = [(k, page("das Haus und der Garten", "de"), "https://a.example.de/x", None) for k in range(30)] + [(k, page("the house and the garden", "en"), "http://b.example.com/", None) for k in range(30, 60)]
    rows += [(100, page("zzz", "de"), "http://n.net", None), (101, page("zzz", "en"), "http://n.net", None), (102, page("zzz"), "http://user@A.example.de:80/q", None), (103, page("zzz"), "http://new.example.de/", None),
             (104, page("zzz"), "http://other.de/", None), (105, None, None, "the house"), (106, None, None, None), (107, page(""), "http://n.net", None), (108, page("", "de"), None, None)]
    frame = spark.createDataFrame(rows, "k long, html string, url string, text string")
    got = {r.k: r.language for r in language.language_fusion(frame, text_model, markup="html", url="url", host="source").collect()}
    assert [got[k].language for k in (0, 30, 100, 101, 102, 103, 104, 105, 108)] == ["de", "en", "de", "en", "de", "de", "de", "en", "de"]
    assert (got[102].host, got[100].declared) == ("a.example.de", "de")
    assert not got[106].kept and not got[107].kept and got[108].kept
    assert all(0 <= g.posterior <= 1 + 1e-9 for g in got.values())
    # nothing but the address speaks, and nearer levels weigh more
    assert got[102].posterior > got[104].posterior > 0.5


def test_every_label_is_learnt(spark):
    """Rare labels too: past 64 languages, each of three texts, none is taken for another."""
    rng = random.Random(3)
    words = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(72)}
    frame = spark.createDataFrame([(3 * k + i, " ".join(rng.choices(words[lang], k=20)), lang) for k, lang in enumerate(words) for i in range(3)], "doc_id long, text string, lang string")
    model = language.train_text_model(frame, held_out=None)
    assert model.languages == sorted(words)
    got = language.language_fusion(frame, model).select("lang", "language.*").collect()
    assert len(got) == 216 and all(r.lang == r.language and r.kept for r in got)


def test_address_levels(spark):
    urls = ["http://a.b.co.uk/x", "https://www.x.org", "ftp://h", "nonsense", None]
    frame = spark.createDataFrame([(u, "SRC7") for u in urls], "u string, s string")
    levels = language.address_levels(F.col("u"), F.col("s"))
    assert [tuple(r) for r in frame.select(*[levels[k] for k in language.LEVELS]).collect()] == [
        ("uk", "b.co.uk", "a.b.co.uk"), ("org", "x.org", "www.x.org"), ("", "h", "h"), ("", "src7", "src7"), ("", "src7", "src7")]


def test_declared_languages():
    cases = {b'<HTML dir="ltr" LANG="fr-CA">': "fr", b"<html xml:lang='de'>": "de", b"<html><meta http-equiv='Content-Language' content='es, en'>": "es", b'<meta property="og:locale" content="pt_BR">': "pt", b"<p lang=it>": None}
    assert {k: language.declared_language(k) for k in cases} == cases


def test_language_of_nothing(spark, text_model):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, language string")
    assert language.language_fusion(none, text_model).count() == 0
    blank = language.train_text_model(none)
    assert blank.languages == ["und"]
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert language.language_fusion(rows, blank).first().language.language == "und"


@pytest.mark.parametrize("unit", [b"<script x ", b"<!-- x ", b"<meta http-equiv ", b"<meta http-equiv=content-language ", b"<html lang=   ", b"<style>", b"</script <script>", b"<p &amp"])
def test_hostile_markup_takes_linear_time(unit):
    """10 MB that close nothing are read in seconds."""
    page = unit * (10_000_000 // len(unit))
    t = time.time()
    language.visible_text(page)
    language.declared_language(page)
    assert time.time() - t < 20


def test_visible_text_and_declared_language():
    page = b"<HTML a lang='DE-at'><!-- <meta http-equiv=content-language content=fr> -->a<script>if (1 < 2) x</script >b<style>p {}</style>&nbsp;c<b>d</b> 1 < 2"
    assert language.visible_text(page).split() == [b"a", b"b", b"c", b"d", b"1", b"<", b"2"] and language.declared_language(page) == "de"
    assert language.visible_text(b"x<script>y<b>z").split() == [b"x", b"y", b"z"] and language.visible_text(b"a<!--b>c").split() == [b"a", b"c"]
    assert language.declared_language(b"<meta content=it property=og:locale><meta property='og:locale' content='pt_BR'>") == "pt" and language.declared_language(b"<html lang=engl>") is None


def test_classifiers_learn_from_every_labelled_row(spark, monkeypatch):
    """More rows than one shard, and long ones: a word of one late row moves the weights, wherever it stands."""
    from foldwise.llm import averaging

    monkeypatch.setattr(averaging, "SHARD_ROWS", 40)
    rows = [(k, f"plain words of row {k} " + ("vile " if k % 3 == 0 else "") + "more " * (k % 7), "en", 30) for k in range(160)]
    rows += [(160, "filler " * 40_000 + "lonely", "en", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 == 0)) for k in range(160)] + [(160, 1, 1)], "doc_id long, quality int, toxic int")
    known = labels.filter("crc32(cast(doc_id as string)) % 4 <> 2")
    assert averaging.n_shards(docs.join(known, "doc_id"), "text") > 1
    seen = []
    shard_sum = averaging.shard_sum
    monkeypatch.setattr(averaging, "shard_sum", lambda *a: seen.append(shard_sum(*a)) or seen[-1])
    machine = fm.train_quality(docs, labels)
    assert {found[0] for found in seen} == {known.count()}
    model = textcnn.train_toxicity(docs, labels)
    scored = textcnn.toxicity_scores(docs, model).join(labels, "doc_id").select("toxicity.score", "toxic").toPandas()
    assert scored[scored.toxic == 1].score.mean() > 2 * scored[scored.toxic == 0].score.mean()
    scored = fm.quality_scores(docs, machine).join(labels.withColumnRenamed("quality", "y"), "doc_id").select("quality.score", "y").toPandas()
    assert scored[scored.y == 1].score.mean() > 2 * scored[scored.y == 0].score.mean()
    if zlib.crc32(b"160") % 4 != 2:
        assert np.any(machine.v[fm.bucket_of(b"lonely")] != fm._start(machine.edges, 0, 0, np.random.default_rng(5)).v[fm.bucket_of(b"lonely")])


def test_models_come_back_in_small_blocks(spark, monkeypatch):
    """A model of many numbers is averaged exactly, and no row that the driver reads holds much of it."""
    from foldwise.llm import averaging

    rows = averaging.deal(spark.range(100).select(F.col("id").alias("__id"), F.col("id").cast("double").alias("y")), 3)
    start = [np.arange(300_000, dtype=np.float32).reshape(3, -1), 0.5, np.zeros(7)]
    sizes = []

    def summed(blocks, tasks=None):
        out = sum_blocks(blocks, tasks)
        sizes.extend(r["n"] for r in out.select(F.length("block").alias("n")).collect())
        return out

    sum_blocks = averaging.sum_blocks
    monkeypatch.setattr(averaging, "sum_blocks", summed)

    def learn(parts, columns, rng):
        mean = np.mean(columns["y"])
        return [parts[0] + np.float32(mean > 0), parts[1] + mean, parts[2] + mean]

    got = averaging.averaged(rows, 3, start, 2, learn, seed=1)
    assert np.array_equal(got[0], start[0] + 2) and got[0].dtype == np.float32
    assert math.isclose(got[1], 0.5 + 2 * 49.5) and np.allclose(got[2], 2 * 49.5)
    assert max(sizes) <= 8 * averaging.CELLS
    assert averaging.averaged(rows.filter("false"), 3, start, 1, learn, seed=1) is start


def test_shards_hand_on_what_moved_only(spark, monkeypatch):
    """Numbers that a shard leaves as they are take a bit each, others of four bytes no more than these; shards meet after every second pass."""
    from foldwise.llm import averaging

    rows = averaging.deal(spark.range(100).select(F.col("id").alias("__id"), F.col("id").cast("double").alias("y")), 3)
    start, sent = [np.ones(200_000, np.float32), 0.25], []

    def summed(parts, tasks=None):
        sent.append(parts.select(F.sum(F.length("places") + F.length("block"))).first()[0])
        return sum_blocks(parts, tasks)

    sum_blocks = averaging.sum_blocks
    monkeypatch.setattr(averaging, "sum_blocks", summed)

    def learn(parts, columns, rng):
        parts[0][::10] += np.float32(0.5)
        return [parts[0], parts[1] + 0.1]

    got = averaging.averaged(rows, 3, start, 1, learn, seed=1)
    assert got[0].dtype == np.float32 and np.all(got[0][::10] == 1.5) and np.all(got[0][1::10] == 1) and math.isclose(got[1], 0.35)
    assert sent[0] < 3 * (20_000 * 4 + 25_000 + 100)
    # a single shard's model is its own to the last bit, as are numbers that become zero
    odd = np.random.default_rng(3).normal(size=50_000).astype(np.float32) * np.float32(1e3)
    odd[::7] = 0
    assert np.array_equal(averaging.averaged(rows.coalesce(1), 1, [np.full(50_000, 1e-3, np.float32)], 1, lambda *_: [odd], seed=1)[0], odd)
    for kind in (np.float32, np.float64):
        for some in (odd.astype(kind), np.zeros(0, kind), np.array([np.nan, -0.0, np.inf], kind)):
            assert averaging.from_planes(averaging.planes(some), some.dtype.str).tobytes() == some.tobytes()
    # three tasks at least are added in groups first
    monkeypatch.setattr(averaging, "FAN_IN", 2)
    assert np.array_equal(averaging.averaged(rows, 3, start, 1, learn, seed=1)[0], got[0])
    assert [averaging.rounds_of(12, 12, s) for s in (1, 4)] == [1, 6] and averaging.rounds_of(1, 1, 4) == 1 and averaging.rounds_of(50, 6, 4) == 3
