"""Operators on texts against plain re-computations on small documents."""
import hashlib
import random
import time
import re
import string
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foldwise.llm import compression, decontaminate, licenses, simhash
from foldwise.llm.license_rules import lines, word_regex

SCHEMA = "doc_id long, text string, fp string, extra int"


def docs(spark, texts):
    """Texts by position, with columns whose names clash with made ones."""
    return spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts)], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_fingerprint(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(prints):
    """Smallest position reachable over links of two bits or fewer."""
    top = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    top[i] = top[j] = min(top[i], top[j])
    return top


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "ÄÖ", "日本語", "a b", "x|y", "#1"]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 50, 300]))) for _ in range(60)]
    return [None, "", " \t\n", "one", "one two", *made, *made[:10], made[5] + " tail", "ONE", "long " * 30_000, "\n".join(["same line here"] * 9 + ["", " "])]


def test_fingerprints_and_components(spark, texts):
    got = {r.doc_id: r for r in simhash.simhash_groups(docs(spark, texts)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k].component_id for k in range(len(texts))] == slow_components(prints)


@pytest.mark.parametrize("shard_nodes", [64, 4096])
def test_links_span_the_components_whatever_the_shard_size(spark, shard_nodes):
    """Clusters around a few centres: small shards are dealt anew, level by level, without losing a link."""
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {0, (1 << 64) - 1, *centres}
    for c in centres:
        for _ in range(150):
            values.add(c ^ (1 << rng.randrange(8)) ^ (1 << rng.randrange(64)) ^ (rng.randrange(2) << 63))
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(frame, "fp", 2, shard_nodes).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    place = {v: k for k, v in enumerate(values)}
    top = list(range(len(values)))
    for _ in values:
        for a, b in links:
            i, j = place[a], place[b]
            top[i] = top[j] = min(top[i], top[j])
    assert top == slow_components(values)


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(2)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree(values[0])
    for v in values[1:]:
        tree.add(v)
    for q in rng.sample(values, 40):
        for radius in (0, 2, 4):
            assert sorted(tree.values[k] for k in tree.within(q, radius)) == sorted(v for v in values if (v ^ q).bit_count() <= radius)


def test_keep_one_each_keeps_whole_rows(spark):
    rows = [(3, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, "quite another text of words", "t"), (7, None, None), (8, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    kept = simhash.keep_one_each(frame.withColumnRenamed("__id", "source"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f", "s"), (None, "quite another text of words", "t"), (7, None, None)], key=str)
    assert kept.columns == ["doc_id", "text", "source"]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert simhash.simhash_groups(none).count() == 0 and simhash.keep_one_each(none).count() == 0
    assert compression.compression_rules(none).count() == 0 and licenses.license_scan(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs(spark, ["a b"]), items).select("contamination.n_hit").first()[0] == 0


def slow_repeats(ws):
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] >= 2 for k in range(3)})


def test_base_counts(spark, texts):
    rows = compression.compression_rules(docs(spark, texts).withColumn("quality_rules", F.lit(1))).collect()
    for r in rows:
        q, text = r.quality_rules, texts[r.doc_id] or ""
        ws = words(text)
        full = [x for x in text.split("\n") if words(x)]
        expected = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), sum(x in full[:i] for i, x in enumerate(full)), slow_repeats(ws))
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == expected, r.doc_id
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert q.base_failed == failed and not (failed and q.kept)


def test_bands_reject_repetition_and_noise(spark):
    rng, letters = random.Random(3), string.ascii_letters + string.digits + "+/"
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(1500))
    loop = " ".join(f"item {k % 7} of the list" for k in range(2000))
    noise = " ".join("".join(rng.choice(letters) for _ in range(30)) for _ in range(900))
    rows = compression.compression_rules(docs(spark, [prose, loop, noise])).orderBy("doc_id").collect()
    assert [r.quality_rules.band for r in rows] == ["ok", "repetitive", "incompressible"]
    assert rows[0].quality_rules.kept


def test_junk_in_a_part_of_a_text_counts(spark):
    """48 % noise or repetition, in long and short texts and in the last bytes, though the median chunk is prose."""
    rng, letters = random.Random(3), string.ascii_letters + string.digits + "+/"
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n // 5))[:n]
    noise = lambda n: " ".join("".join(rng.choice(letters) for _ in range(30)) for _ in range(n // 31 + 1))[:n]
    loop = lambda n: ("one and the same sentence again and again. " * (n // 43 + 1))[:n]
    texts = [prose(4096 * 52) + " " + noise(4096 * 48), prose(4096 * 52) + " " + loop(4096 * 48), prose(4096) + noise(4096), prose(4096) + noise(2000), prose(1500) + " " + noise(1100), prose(4096 * 3), prose(3000), prose(700)]
    rows = compression.compression_rules(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.quality_rules.band for r in rows] == ["incompressible", "repetitive", "incompressible", "incompressible", "incompressible", "ok", "ok", "ok"]
    assert all(b"".join(compression.pieces(x.encode())) == x.encode() for x in texts)


def slow_hits(text, items, width=13):
    ws, hit, found = alnum(text), set(), set()
    for key, item in items:
        iw = alnum(item)
        for i in range(max(1, len(iw) - width + 1)) if iw else ():
            window = iw[i:i + width]
            for j in range(len(ws) - len(window) + 1):
                if ws[j:j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(str(key))
    return ws, hit, found


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(9)] + ["É", "straße"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(10, item(30)), (9, item(13)), (2, "V1, v2; É"), (3, ""), (4, None), (10, item(14)), (None, "v3"), (11, "v8 v8 v8")]
    texts = [None, "", "v1 V2-É!", items[0][1].upper().replace(" ", ", ") + " and more", "filler " * 200 + items[1][1], "v8 " * 7, item(400), "x" * 50, "filler " * 500 + items[0][1][:60]]
    return items, texts


@pytest.mark.parametrize("max_item_bytes", [1 << 20, 500])
def test_contamination_against_a_scan(spark, contaminated, max_item_bytes):
    """Also with a benchmark too large for one broadcast."""
    items, texts = contaminated
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.contamination for r in decontaminate.contamination(docs(spark, texts), frame, max_item_bytes=max_item_bytes).collect()}
    for k, text in enumerate(texts):
        ws, hit, found = slow_hits(text, [(a, b) for a, b in items if a is not None])
        g = got[k]
        assert (g.n_words, g.n_hit, list(g["items"])) == (len(ws), len(hit), sorted(found)), k
        assert g.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(ws))
        covered = [w for a, b in g.spans for w in alnum(text[a:b])]
        assert covered == [ws[i] for i in sorted(hit)]


def test_an_item_larger_than_a_slice(spark, contaminated):
    """A long item is cut into pieces that share the windows between them; clashing columns come back as they were."""
    rng = random.Random(8)
    long_item = " ".join(f"w{rng.randrange(50)}" for _ in range(700))
    words = long_item.split()
    texts = [" ".join(words[k:k + 40]) for k in range(0, 660, 23)] + [long_item, "w1 w2 w3"]
    frame = spark.createDataFrame([(1, long_item), (2, "w1 w2 w3")], "item_id long, text string")
    parts = list(decontaminate.item_slices(frame, "item_id", "text", 400))
    assert len(parts) > 8 and all(sum(len(t) for _, t in p) <= 400 for p in parts)
    wide = docs(spark, texts).withColumn("__hits", F.lit("mine")).withColumn("__row", F.lit(5))
    for r in decontaminate.contamination(wide, frame, max_item_bytes=2000).collect():
        ws, hit, found = slow_hits(texts[r.doc_id], [(1, long_item), (2, "w1 w2 w3")])
        assert (r["__hits"], r["__row"], r.contamination.n_words, r.contamination.n_hit, list(r.contamination["items"])) == ("mine", 5, len(ws), len(hit), sorted(found))


def test_items_digest(spark):
    frame = spark.createDataFrame([(["10", "9"],), ([],)], "i array<string>")
    assert [r[0] for r in frame.select(decontaminate.items_digest(F.col("i"))).collect()] == [hashlib.sha256(x).hexdigest() for x in (b"10,9", b"")]


def slow_licenses(text):
    """Base places, and detections after suppression, by regular expressions over wrapped words."""
    ws = alnum(text)
    wrapped = "".join(f" {w} " for w in ws)
    at = lambda c: wrapped[:c].count(" ") // 2
    base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(ws)) if ws[i:i + len(phrase.split())] == phrase.split())
    found = [(at(m.start()), at(m.end()), p, label) for label, p, _, pattern in lines() for m in re.finditer(word_regex(pattern), wrapped)]
    found = sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[3]))
    kept = [d for i, d in enumerate(found) if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] for e in found[:i])]
    return ws, base, kept


def test_licenses_against_plain_rules(spark):
    texts = [None, "", "no words of that kind", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. GNU General Public License, version 3 or later",
             "cc by cc-by-sa 4.0 CC BY-NC 4.0 cc_by", "SPDX-License-Identifier: GPL-3.0-or-later", "mit license mit license MIT LICENSE", "All rights reserved. " * 40,
             "This work is licensed under the GNU General Public License, version 3. ñ gnu general public licenseñ", "summit license", "BSD 3-Clause License and zlib license in the public domain"]
    rows = {r.doc_id: r.license for r in licenses.license_scan(docs(spark, texts).withColumn("license", F.lit("old"))).collect()}
    for k, text in enumerate(texts):
        ws, base, kept = slow_licenses(text)
        r = rows[k]
        assert r.n_words == len(ws)
        assert sorted((p["first"], p.label) for p in r.base) == base, k
        assert [(p["first"], p.stop, p.priority, p.label) for p in r.detections] == kept, k
        assert r.score == licenses.SCORES.get(max((d[2] for d in kept), default=0), 0.0)


def test_rules_are_gated_by_words_that_they_hold():
    assert len(lines()) >= 200
    for _, priority, keyword, pattern in lines():
        assert priority in licenses.SCORES and f" {keyword} " in word_regex(pattern)
        # no way through the pattern leaves the keyword out
        without = re.sub(r"\[[^\]]*\]", "", pattern)
        groups = re.findall(r"\(([^)]*)\)", without)
        plain = re.sub(r"\([^)]*\)", " ", without).split()
        assert keyword in plain or any(all(keyword in c.split() for c in g.split("|")) for g in groups), pattern


def test_places_of_many_matches_are_right(spark):
    text = "x mit license " * 3000
    r = licenses.license_scan(docs(spark, [text])).first().license
    assert [p["first"] for p in r.base] == [1 + 3 * k for k in range(3000)]


def test_components_of_a_long_path(spark):
    from foldwise.llm.components import connected_components

    n = 200
    order = np.random.default_rng(0).permutation(n).tolist()
    links = [(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1000), (500, 501), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {**dict.fromkeys(range(n), 0), 500: 500, 501: 500}


def test_licenses_of_a_text_full_of_matches(spark):
    """Work on one text stays near its length: tens of thousands of matches in seconds."""
    n = 20_000
    t = time.time()
    row = licenses.license_scan(spark.createDataFrame([("cc by and gpl " * n,)], "text string")).first().license
    assert time.time() - t < 60
    assert [(d["first"], d["stop"]) for d in row.base] == [(4 * k, 4 * k + 2) for k in range(n)] and row.n_words == 4 * n
