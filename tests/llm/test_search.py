"""Exact vector search, ranked lexical search and the conversation trie against brute force."""
import math
import random

import pytest
from pyspark.sql import functions as F

from foldwise.llm import topk

SF01 = "/root/testdata/sf0.01"


def brute_top_k(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q is None or q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in ok if i != q)
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def test_top_k_is_exact(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([0.0, 0.001, -0.3, 0.7, rng.uniform(-1, 1)]) for _ in range(rng.choice([0, 3, 8]))]) for k in range(300)]
    rows += [(300 + k, [0.5, -0.25, 0.0]) for k in range(60)]  # copies that tie
    rows += [(None, [0.5] * 8), (None, None), (700, None), (750, [0.1, None]), (800, [float("nan")]), (850, [float("inf"), 1.0]), (900, []), (-50, [0.2, 0.2])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, block string, score int")
    for block_rows in (40, 8192):
        got = topk.top_k(frame.repartition(3), topk.queries_by_id(frame), block_rows=block_rows).collect()
        assert sorted(map(tuple, got), key=str) == brute_top_k(rows, 5, 50)


def test_top_k_of_repeated_and_few_rows(spark):
    """A repeated query row is answered twice, repeated candidates count twice, and fewer rows than k give all."""
    frame = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(frame, topk.queries_by_id(frame)).collect()))
    assert got == [(0, 1, 1, 131072), (0, 1, 1, 131072), (0, 2, 1, 131072), (0, 2, 1, 131072)]
    assert topk.top_k(frame.limit(0), topk.queries_by_id(frame)).collect() == []
    assert topk.top_k(frame, frame.limit(0)).collect() == []


def test_top_k_of_huge_components(spark):
    frame = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.0]), (3, [2.0**40, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(frame, topk.queries_by_id(frame)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -2**63)]


def test_a_hot_id_or_vector_fills_no_block(spark):
    """Rows that share an id and a vector are dealt out like all others."""
    rows = [(7, [0.5, 0.5])] * 900 + [(k, [0.1 * (k % 9), 0.2]) for k in range(100, 400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    dealt = frame.repartition(6).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in dealt) <= 202
    got = topk.top_k(frame, topk.queries_by_id(frame), block_rows=200).collect()
    assert sorted(map(tuple, got), key=str) == brute_top_k(rows, 5, 50)


def brute_search(docs, items, k=10):
    from foldwise.llm.common import alnum_words

    bags = [(d, alnum_words((t or "").encode())) for d, t in docs]
    bags = [(d, w) for d, w in bags if w]
    n_docs, total = len(bags), sum(len(w) for _, w in bags)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(alnum_words((t or "").encode()))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, words in bags:
            m = 100 - 90 + (90 * len(words) * n_docs) // total
            score = 0
            for t in terms:
                df = sum(t in w for _, w in bags)
                tf = words.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=3, n=140):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["the"] * 60 + ["Ümlaut", "日本語", "A1"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90)))) for k in range(n)]
    docs += [(n + k, docs[k][1]) for k in range(20)] + [(3, docs[3][1]), (None, docs[5][1]), (None, "w1 w1 w1"), (900, None), (901, ""), (902, "--- ,.;"), (903, "the " * 3000), (904, "W1,w2;THE\tümlaut")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for k in range(30)] + [(40, None), (41, ""), (42, "nowhere"), (43, "the the the"), (2, "w7 w8"), (None, "w1 w9")]
    return docs, items


def test_lexical_search_is_exact(spark):
    from foldwise.llm import lexical

    docs, items = corpus()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, sketch string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    want = brute_search(docs, items)
    for load, limit in ((4, 200_000), (1, 40)):
        got = lexical.lexical_search(d.repartition(3), i, load=load, slice_terms=limit).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_lexical_search_of_nothing(spark):
    from foldwise.llm import lexical

    docs, items = corpus(n=30)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.lexical_search(d.limit(0), i).collect() == []
    assert lexical.lexical_search(d, i.limit(0)).collect() == []
    assert lexical.lexical_search(d.filter("doc_id = 901"), i).collect() == []


def test_bounds_are_over_the_scores():
    """A sketch's bound is never under the exact score, whatever falls together."""
    from collections import Counter

    import numpy as np

    from foldwise.llm import lexical
    from foldwise.llm.common import alnum_words

    docs, items = corpus(seed=9, n=60)
    bags = [alnum_words((t or "").encode()) for _, t in docs]
    bags = [b for b in bags if b]
    terms = [sorted(set(alnum_words((t or "").encode()))) for _, t in items]
    vocabulary = sorted({t for own in terms for t in own})
    stats = {lexical.DOCUMENTS: len(bags), lexical.WORDS: sum(map(len, bags))} | {k: sum(t in b for b in bags) for k, t in enumerate(vocabulary)}
    chosen = lexical.Items(list(range(len(items))), terms, vocabulary, stats)
    hashes = np.array([lexical.term_hash(t) for t in chosen.vocabulary], dtype=np.uint64)
    some, *_ = chosen.flat()
    for load in (1, 4):
        made = []
        for b in bags:
            c = Counter(b)
            made.append(lexical.sketch(np.array([lexical.term_hash(t) for t in c], dtype=np.uint64), np.array(list(c.values())), load))
        n = np.array([len(b) for b in bags])
        slack = 0
        for rows, bounds in chosen.bounds(hashes, n, made):
            for r, row in zip(rows, bounds):
                c, m = Counter(bags[r]), lexical.length_factor(int(n[r]), chosen.documents, chosen.words)
                for item, bound in zip(some, row):
                    score = sum(int(chosen.weights[t]) * lexical.impact(c[chosen.vocabulary[t]], m) for t in chosen.terms[item] if c[chosen.vocabulary[t]])
                    assert bound >= score
                    slack += bound > score
        assert slack or load == 4


def brute_trie(rows):
    import hashlib
    import zlib
    from collections import defaultdict

    from foldwise.llm.prefixtrie import DIGEST

    def digest(t):
        role = t[0].encode()
        return hashlib.sha256(str(len(role)).encode() + b":" + role + t[1].encode()).hexdigest()[:2 * DIGEST]

    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest((role or "", text or "")), role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(node))))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed=2, n=160):
    rng = random.Random(seed)
    texts = ["hello", "hi", "", None, "wie geht's", "日本語 text", "a longer answer " * 5]
    rows = []
    for c in range(n):
        if c % 7 == 3:
            continue  # some groups have no first conversation
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    hot = [("system", "be kind"), ("user", "hello"), ("assistant", "hi")]
    rows += [(c, t, *x) for c in range(1000, 1300) for t, x in enumerate(hot)]  # copies
    rows += [(c, t, *x) for c in range(2000, 2100) for t, x in enumerate([*hot, ("user", str(c % 9)), ("assistant", str(c))])]
    rows += [(5000, t, "user", str(t % 3)) for t in range(400)]  # one long conversation
    rows += [(None, 0, "user", "x"), (6001, None, "user", "late"), (6001, None, "user", "early"), (6001, 1, "a", "b"), (6001, 1, "a", "b"), (6001, -2, "z", "z"), (-7, 0, "user", "minus"), (7003, 0, "user", "only")]
    return rows


def test_prefix_trie_is_exact(spark):
    from foldwise.llm import prefixtrie

    rows = talks()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    want = brute_trie(rows)
    convs = prefixtrie.rebuilt(prefixtrie.conversations(frame.repartition(3)))
    for limit, bits in ((8192, 12), (60, 3)):
        got = prefixtrie.prefix_trie(convs, shard_turns=limit, piece_bits=bits).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_prefix_trie_of_nothing(spark):
    from foldwise.llm import prefixtrie

    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.conversations(empty))).collect() == []
    for rows in ([(None, 0, "user", "x")], [(4, 0, None, None)], [(0, 0, "a", "b"), (0, 0, "a", "b")]):
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.conversations(frame))).collect()
        assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_a_crowded_prefix_is_split(spark):
    """Paths that share their first turns are dealt to several shards, and no shard is over its bound."""
    from foldwise.llm import prefixtrie

    rows = [(c, t, "user", x) for c in range(500) for t, x in enumerate(["same", "same", "same", str(c % 50), str(c)])]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = prefixtrie.conversations(frame)
    dealt, _ = prefixtrie.deal(prefixtrie.distinct_paths(convs), 100)
    shards = dealt.groupBy("split", "bucket").agg(F.sum(F.size("sizes")).alias("t")).collect()
    assert len(shards) > 10 and max(s.t for s in shards) <= 200 and {s.split for s in shards} == {4}


def test_double_array():
    from foldwise.llm.prefixtrie import DoubleArray, dense_ids

    rng = random.Random(1)
    paths = sorted({b"".join(bytes([rng.randrange(6)]) * 16 for _ in range(rng.randrange(7))) for _ in range(500)})
    ids = dense_ids(paths)
    trie = DoubleArray(ids)
    import numpy as np

    seen = set()
    for s in ids:
        state = np.zeros(1, dtype=np.int64)
        for c in s:
            state = trie.step(state, np.array([c]))
            assert state[0] > 0
        seen.add(int(state[0]))
    assert len(seen) == len(paths)
    assert trie.step(np.zeros(1, dtype=np.int64), np.array([99]))[0] == -1
    assert len(trie.check) < 2 * len({p[:k] for p in paths for k in range(0, len(p) + 1, 16)}) + 20
