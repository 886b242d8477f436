"""WARC round trips, the Pfair mix and the pipeline."""
import base64
import hashlib
import math
import random
import struct
from collections import defaultdict
from fractions import Fraction

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from foldwise.llm import decontaminate, mixing, simhash, warc
from foldwise.session import ensure_checkpoint_dir

SF01 = "/root/testdata/sf0.01"


def pages(spark):
    rng = random.Random(1)
    html = [f"<html><body>{' '.join(rng.choice(['alpha', 'beta', 'gämma', '日本']) for _ in range(rng.randrange(300)))}</body></html>" for _ in range(40)]
    rows = [(k, f"http://h{k}.example/a b", html[k % 30], "r") for k in range(60)] + [(100, None, None, None), (101, "http://x/", "", "r"), (None, "http://y/", html[0], "r"), (7, "http://h7.example/a b", html[7], "r"), (102, "a\r\nWARC-Type: x", "x" * 300_000, "r")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("min_bytes", [0, 200])
def test_warc_round_trip(spark, min_bytes):
    rows, frame = pages(spark)
    directory, manifest = warc.write_archives(frame.repartition(3), min_bytes=min_bytes, archive_bytes=2000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 3
    got = warc.read_archives(spark, directory, manifest).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    by_payload = defaultdict(list)
    for k, _, html, _ in rows:
        if k is not None and len((html or "").encode()) >= min_bytes:
            by_payload[html or ""].append(k)
    want = []
    for k, _, html, _ in rows:
        payload, first = (html or "").encode(), min(by_payload.get(html or "", [k]), key=lambda x: (x is None, x or 0))
        later = k is not None and k != first
        want.append((k, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if later else "response", first if later else None, None if later else payload))
    key = lambda r: (str(r[0]), r[2], str(r[3]))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)


def test_archives_are_plain_zstandard(spark):
    """A dictionary in a skippable frame, then one frame a record that any zstandard reader opens with it."""
    _, frame = pages(spark)
    directory, manifest = warc.write_archives(frame.coalesce(1))
    files, root = warc.filesystem(directory)
    with files.open_input_stream(f"{root}/{manifest.first().file}", compression=None) as f:
        data = f.read()
    magic, size = struct.unpack_from("<II", data)
    assert 0x184D2A50 <= magic <= 0x184D2A5F and size > 0
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    offsets = [o for o, _, _ in warc.frames(data)]
    records = [reader.decompress(data[a:b]) for a, b in zip(offsets, [*offsets[1:], len(data)])]
    assert len(records) == 65 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)


def test_damage_is_told():
    record = warc.record_bytes(5, "http://a/", b"payload", None)
    press = zstandard.ZstdCompressor().compress
    whole = warc.skippable_frame(b"") + press(record) + press(warc.record_bytes(6, None, b"payload", 5))
    assert [warc.parse_record(r)["error"] for _, r, _ in warc.frames(whole)] == [None, None]
    assert [e for _, _, e in warc.frames(whole[:-3])] == [None, "the frame is cut off"]
    assert list(warc.frames(whole[:40]))[-1][2] and list(warc.frames(b"\0" * 30))[-1][2]
    for old, new in ((b"WARC/1.1", b"WARC/9"), (b"Content-Length: 7", b"Content-Length: 8"), (b"sha1:", b"sha1:A"), (b"WARC-Type: response", b"WARC-Typ: response"), (b"payload\r\n", b"paylod\r\n")):
        assert warc.parse_record(record.replace(old, new))["error"], old
    compressed = warc.skippable_frame(press(zstandard.train_dictionary(512, [b"sample %d of text" % k for k in range(200)]).as_bytes()))
    assert warc.read_dictionary(compressed)[0].startswith(b"\x37\xa4\x30\xec")


def test_warc_of_nothing(spark):
    _, frame = pages(spark)
    directory, manifest = warc.write_archives(frame.limit(0))
    assert warc.read_archives(spark, directory, manifest).count() == 0


def slow_schedule(blocks, weights):
    """Slot of every block: windows from the fluid's definition, then earliest deadline first, one slot at a time."""
    out, start = {}, 0
    for part in ({s: Fraction(weights[s]) for s, n in blocks.items() if n and weights[s] > 0}, {s: Fraction(1) for s, n in blocks.items() if n and not weights[s] > 0}):
        flow = lambda v: sum(min(w * v, blocks[s]) for s, w in part.items())  # noqa: B023, E731
        order = sorted(part, key=lambda s: (blocks[s] / part[s], s))  # noqa: B023
        done = dict.fromkeys(part, 0)
        for slot in range(sum(blocks[s] for s in part)):
            ready = []
            for at, s in enumerate(order):
                if done[s] < blocks[s] and math.floor(flow(done[s] / part[s])) <= slot:
                    ready.append((math.ceil(flow((done[s] + 1) / part[s])), at, s))
            s = min(ready)[2]
            done[s] += 1
            out[s, done[s]] = start + slot
        start += sum(done.values())
    return out


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "s1": 3.0, "s2": 1.0, "gone": 9.0}])
def test_mix_against_a_simulation(spark, weights, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 40)
    rng = random.Random(2)
    rows = [(k, rng.choice(["hot"] * 6 + ["s1", "s2", "s3", None]), "old") for k in range(700)] + [(3, "hot", "x"), (3, "hot", "x"), (None, "s1", None), (None, None, None)]
    got = mixing.pfair_mix(spark.createDataFrame(rows, "doc_id long, source string, mix string"), weights=weights, block_docs=4).collect()
    assert sorted(map(str, ((r.doc_id, r.source) for r in got))) == sorted(map(str, ((a, b) for a, b, _ in rows)))
    assert len({r.mix.position for r in got}) == len(rows)
    count = defaultdict(int)
    for r in got:
        count[r.mix.source] += 1
        assert r.mix.source == ((r.source or "") if weights is None or r.source in weights else mixing.REST)
        assert r.mix.release <= r.mix.slot < r.mix.deadline
    targets = mixing.default_weights(count) if weights is None else {**{s: weights[s] for s in count if s != mixing.REST}, mixing.REST: 5 / 3}
    slots = slow_schedule({s: -(-n // 4) for s, n in count.items()}, targets)
    assert {(r.mix.source, r.mix.block): r.mix.slot for r in got} == slots


@pytest.mark.parametrize("given", [None, {"s0": 1.0, "s1": 0.0005, **{f"s{k}": 0.05 for k in range(2, 20)}}])
def test_mix_follows_the_given_weights(spark, given, monkeypatch):
    """Windows and lag against the targets themselves, until the first source ends; the schedule comes in parts."""
    monkeypatch.setattr(mixing, "PLAN_ROWS", 2500)
    count = {f"s{k}": 2000 if k == 0 else 210 for k in range(20)}
    rows = [(k, s) for k, s in enumerate(s for s, n in count.items() for _ in range(n))]
    got = sorted((r.mix.slot, r.mix) for r in mixing.pfair_mix(spark.createDataFrame(rows, "doc_id long, source string"), weights=given, block_docs=1).collect())
    assert [slot for slot, _ in got] == list(range(len(rows)))
    assert all(m.release <= slot < m.deadline for slot, m in got)
    weights = mixing.default_weights(count) if given is None else given
    share = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    end, done = min(n / share[s] for s, n in count.items()), dict.fromkeys(count, 0)
    assert end > 1500
    for slot, m in got:
        if slot + 1 > end:
            break
        done[m.source] += 1
        assert m.block == done[m.source] and m.release == (m.block - 1) // share[m.source]
        assert m.deadline == -(-m.block // share[m.source]) or m.block > share[m.source] * end
        assert all(abs(done[s] - share[s] * (slot + 1)) < 1 for s in count)


def test_schedule_serves_every_block_in_its_window():
    rng = random.Random(5)
    for _ in range(100):
        blocks = {f"s{k}": rng.choice([0, 1, 2, 5, 30, 100]) for k in range(rng.randint(0, 12))}
        weights = {s: rng.choice([n ** 0.5, rng.random(), 3, 0.0]) for s, n in blocks.items()}
        done = dict.fromkeys(blocks, 0)
        for at, (s, k, release, deadline, slot) in enumerate(mixing.schedule(blocks, weights)):
            done[s] += 1
            assert (k, slot) == (done[s], at) and release <= slot < deadline
        assert done == blocks


def test_sources_without_a_weight_are_mixed_as_a_rest(spark):
    rows = [(k, f"s{k % 50}") for k in range(300)]
    got = mixing.pfair_mix(spark.createDataFrame(rows, "doc_id long, source string"), weights={f"s{k}": 1.0 for k in range(5)}, block_docs=2).collect()
    assert len(got) == 300 and len({r.mix.source for r in got}) == 6 and sum(r.mix.source == mixing.REST for r in got) == 270
    assert mixing.pfair_mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_mix_leaves_clashing_columns_alone(spark):
    """Columns named like the mix's own come back as they were; the stage replaces only those that it makes."""
    names = ["nr", "mix_source", "__source", "__at", "__id", "__row", "__block", "__nr", "__before", "release", "slot", "n", "__h"]
    rows = [(k, f"s{k % 3}", *[1000 + k] * len(names)) for k in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{n} long" for n in names))
    for weights in (None, {"s0": 1.0}):
        got = mixing.pfair_mix(frame, weights=weights).collect()
        assert sorted(tuple(r)[:-1] for r in got) == rows and len({r.mix.position for r in got}) == 90
    staged = corpus_pipeline.mix_stage(spark, frame.withColumn("mix_slot", F.lit("old")).withColumn("MIX_block", F.lit("old")).withColumn("__mix", F.lit("mine")), SF01)
    assert sorted(tuple(r[c] for c in frame.columns) for r in staged.collect()) == rows
    assert dict(staged.dtypes)["mix_slot"] == dict(staged.dtypes)["mix_block"] == "bigint" and "__mix" in staged.columns


@pytest.mark.parametrize("given", [False, True])
def test_many_sources_keep_their_own_weights(spark, given):
    """Past 500 sources, each is mixed by name and stays less than one block from its target."""
    rows = [(k, f"s{k % 700}") for k in range(2100)] + [(k, "s0") for k in range(2100, 2700)]
    weights = {f"s{k}": 1.0 + k % 3 for k in range(700)} if given else None
    got = mixing.pfair_mix(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block_docs=1).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows) and all(r.mix.source == r.source for r in got)
    assert sorted(r.mix.slot for r in got) == list(range(2700)) and all(r.mix.release <= r.mix.slot < r.mix.deadline for r in got)
    count = defaultdict(int)
    for _, s in rows:
        count[s] += 1
    weights = weights or mixing.default_weights(count)
    total = sum(map(Fraction, weights.values()))
    assert all(r.mix.release == 0 and r.mix.deadline == -(-total // Fraction(weights[r.source])) for r in got if r.mix.block == 1)


def test_pipeline_stages_against_plain_rules(spark):
    """Each stage on what the one before it kept, against a re-computation of its rule; then run()."""
    docs, kept = spark.read.parquet(f"{SF01}/documents.parquet"), {}
    folder = f"{ensure_checkpoint_dir(spark)}/stages"
    held = [r.asDict() for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF01).write.mode("overwrite").parquet(f"{folder}/{k}")
        before, docs = held, spark.read.parquet(f"{folder}/{k}")
        held = [r.asDict() for r in docs.collect()]
        kept[name] = {r["doc_id"] for r in held}
        rows = {r["doc_id"]: r for r in before}
        assert all({c: r[c] for c in rows[r["doc_id"]]} == rows[r["doc_id"]] for r in held) and len(kept[name]) == len(held)
        if name == "simhash_dedup":
            prints = {d: simhash.fingerprint(r["text"].encode()) for d, r in rows.items()}
            top = {d: d for d in rows}
            links = [(a, b) for a in rows for b in rows if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
            for _ in links:
                new = {**top}
                for a, b in links:
                    new[a] = new[b] = min(new[a], new[b])
                if new == top:
                    break
                top = new
            assert kept[name] == set(top.values())
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
            block = decontaminate.item_blocks([(str(a), b.encode()) for a, b in items], 13)
            clean = set()
            for d, r in rows.items():
                words, hit = decontaminate.alnum_words(r["text"].encode()), set()
                for i in range(len(words)):
                    for n in {len(w) for b in block for w in b}:
                        if any(tuple(words[i:i + n]) in b for b in block):
                            hit |= set(range(i, min(i + n, len(words))))
                if not (hit and 20 * len(hit) >= len(words)):
                    clean.add(d)
            assert kept[name] == clean
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    judged = [d in kept["quality_classifier"] for d, q in labels.items() if q == 1]
    assert sum(judged) >= 0.97 * len(judged)
    assert len(kept["language_id"]) >= 0.99 * len(kept["quality_classifier"])
    assert kept["pfair_mix"] == kept["benchmark_decontamination"]
    result = corpus_pipeline.run(spark, SF01)
    assert {r.doc_id for r in result.select("doc_id").collect()} == kept["pfair_mix"]
    assert corpus_pipeline.ORACLE_SQL is None
