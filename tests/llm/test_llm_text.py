"""Text operators against brute force, with nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoloom.llm import quality, toxicity
from cartoloom.llm import textbytes
from cartoloom.llm.linear_fit import minimise, training_sample
from cartoloom.llm.minhash_dedup import near_duplicates, superminhash
from cartoloom.llm.mixing import ORACLE_MIX, mix_sources
from cartoloom.llm.pieces import PieceCodec, PieceModel, codec, decode_pieces, encode_pieces
from cartoloom.llm.queries import tokenizer_file
from cartoloom.llm.sharding import FIRST, _around, balanced_shards
from cartoloom.llm.suffix_dedup import remove_repeats
from cartoloom.llm.tokenstore import ByteLevelEncoder, read_tokens, token_table, write_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rank string, row int, score double, src string, h long, bucket int, node string, component long"


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(40)
    out = [(k, text(rng.randint(1, 90)), "en", f"s{k % 4}") for k in range(40)]
    for k in range(40, 52):  # near copies: a few words changed
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((k, " ".join(w), "en", "s0"))
    out += [(k, f"{text(20)} {passage} {text(20)}", "de", "s1") for k in range(52, 58)]
    out += [(58, base.upper(), None, None), (59, base.replace(" ", "\n\t "), "fr", None), (60, None, None, "s2"), (61, "", "en", ""), (62, " \n", "en", "s3"), (63, "one two", "en", "s3"), (64, "One  TWO", "en", "s3")]
    out += [(65, "For " * 4000 + text(3000) + " For" * 500, "en", "s0"), (66, "é" * 300 + "日本" * 80, "xx", "s1"), (67, "é" * 300, "xx", "s1"), (None, base, "en", "s2"), (None, None, None, None), (70, passage, "en", "s2"), (70, passage, "en", "s2")]
    return [(*r, 1, 2, "k", 3, 0.5, "z", 7, 8, "n", 9) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_near_duplicates_equal_brute_force(docs, empty):
    sets, parent = {}, {}
    for r in corpus():
        if r[0] is not None:
            sets[r[0]] = shingles(r[1])
            parent[r[0]] = r[0]

    def find(k):
        return k if parent[k] == k else find(parent[k])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    for block in (192, 3):
        got = near_duplicates(docs, block=block).collect()
        assert len(got) == len(corpus())
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and not r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_in_different_blocks_of_a_crowded_star(spark):
    # One template with own endings: similarity 96/132 for most, 99/129 for 100 pairs; the centre links with none but its partner.
    template, pairs = " ".join(f"t{k}" for k in range(100)), 100
    rows = []
    for k in range(600):
        shared = k % 300 if k % 300 < pairs else k
        rows.append((k, " ".join([template, *(f"p{shared}x{j}" for j in range(3)), *(f"o{k}x{j}" for j in range(15))])))
    sets = [shingles(text) for _, text in rows]
    linked = [(a, b) for a in range(600) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sorted(linked) == [(k + 300, k) for k in range(pairs)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in range(600) if got[k] != (k - 300 if 300 <= k < 300 + pairs else k)] == []


def test_near_duplicates_of_one_template(spark):
    rng = random.Random(41)
    template = [f"t{rng.randrange(10**6)}" for _ in range(500)]
    rows = []
    for k in range(400):
        own = list(template)
        for j in rng.sample(range(500), 14):
            own[j] = f"o{k}x{j}"
        rows.append((k, " ".join(own)))
    sets = [shingles(text) for _, text in rows]
    root = list(range(400))
    for a in range(400):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert [got[k] for k in range(400)] == root


def test_superminhash_estimates_and_uses_every_rank():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    sig = superminhash(np.concatenate([a, b, pool[:3]]), np.array([0, 2000, 4000, 4003]), 256)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.1
    assert (sig[2] < np.uint64(2**64 - 1)).all()  # three elements fill 256 places


def covered(texts, length=100):
    """Bytes of each (id, text) that some earlier equal string covers, by definition."""
    seen, out = set(), {}
    for own, raw in texts:
        mark = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                mark[s : s + length] = True
            seen.add(piece)
        out[own] = mark
    return out


@pytest.mark.parametrize("how", [{}, {"hot": 1, "bucket_bytes": 2000}, {"length": 40, "gram": 8}])
def test_repeats_equal_brute_force(docs, empty, how):
    unique = docs.where("doc_id is not null and doc_id <> 70")
    want = covered(sorted((r[0], (r[1] or "").encode()) for r in corpus() if r[0] not in (None, 70)), how.get("length", 100))
    got = {r["doc_id"]: r for r in remove_repeats(unique, rows=True, **how).collect()}
    texts = {r[0]: (r[1] or "").encode() for r in corpus()}
    assert set(got) == set(want)
    for own, mark in want.items():
        kept = bytes(np.frombuffer(texts[own], np.uint8)[~mark])
        r = got[own]
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(mark), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()), own
        assert r["kept_text"] == kept.decode("utf-8", "ignore") and r["row"]["size"] == 2
    everything = remove_repeats(docs).collect()
    assert len(everything) == len(corpus()) and all(r["n_removed"] == 0 for r in everything if r["doc_id"] is None)
    assert remove_repeats(empty).count() == 0


def test_mix_equals_sql_and_its_law(docs, empty):
    got = mix_sources(docs, rows=True).collect()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas().astype({"doc_id": "Int64"}))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((key(tuple(r)[:6]) for r in got)) == sorted(map(key, con.execute(ORACLE_MIX).fetchall()))
    assert {tuple(r)[:6] for r in got} == {tuple(r)[:6] for r in mix_sources(docs.repartition(5)).collect()}
    by = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] and r["row"]["rank"] == "k"
        by.setdefault(r["row"]["source"], []).append(r)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    for v in by.values():
        left = v[0]["target"] - sum(r["taken"] for r in v)
        assert left >= 0 and not any(0 < r["size"] <= left and r["repeats"] < 2 and r["repeats"] == min(x["repeats"] for x in v if x["size"]) for r in v)
    assert mix_sources(empty).count() == 0


def test_mix_with_rows_alike_and_a_straddling_giant(spark):
    alike = [(None, "a b c d e f g h", "s0")] * 40 + [(7, "one two three", "s0")] * 30 + [(k, "w " * (1 + k % 9), "s1") for k in range(200)]
    giant = [(1000 + k, "w " * (3000 if k == 3 else 17 + k % 31), "s2") for k in range(300)]
    t = spark.createDataFrame(alike + giant, "doc_id long, text string, source string").repartition(4)
    for epochs, budget in ((2, (7, 5)), (3, (11, 5))):
        got = mix_sources(t, epochs=epochs, budget=budget).collect()
        again = mix_sources(t.repartition(7), epochs=epochs, budget=budget).collect()
        assert len(got) == 570 and sorted(map(str, got)) == sorted(map(str, again))
        for target in {r["target"] for r in got}:
            own = [r for r in got if r["target"] == target]
            left = target - sum(r["taken"] for r in own)
            least = min(r["repeats"] for r in own)
            assert left >= 0 and all(r["repeats"] <= min(epochs, least + 1) for r in own)
            assert left < 1 or not any(r["size"] <= left and r["repeats"] < min(epochs, least + 1) for r in own)


def test_shards_balance_and_number(docs, empty, spark):
    for table, n in ((docs, 4), (spark.createDataFrame([(k, "same text") for k in range(500)] + [(k, str(k)) for k in range(500, 900)], "doc_id long, text string"), 16)):
        got = balanced_shards(table, shards=n).collect()
        source = table.select("doc_id", "text").collect()
        assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in source)
        sums, total, largest = [0] * n, sum(r["size"] for r in got), max(r["size"] for r in got)
        slots = {}
        for r in got:
            sums[r["shard"]] += r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert r["law"] == "bytes" and r["grown_shard"] is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(abs(s - total / n) for s in sums) <= largest + 0.01 * total / n
    assert balanced_shards(empty).count() == 0


def test_shards_equal_a_plain_placement(spark):
    rng = random.Random(8)
    rows = [(k, "same " * 3 if k % 5 == 0 else "x" * rng.randint(0, 400)) for k in range(600)] + [(None, "n"), (9, None), (9, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = [(r["h"], -(2**63) if r["doc_id"] is None else r["doc_id"], r["size"]) for r in t.select("doc_id", F.xxhash64("text").alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")).collect()]
    keyed.sort()
    total, at, line = sum(k[2] for k in keyed), 0, []
    for h, own, size in keyed:
        at += size
        line.append((h, own, size, at))
    want = []
    for h, own, size, end in line:
        group = [x for x in line if x[0] == h]
        whole = sum(x[2] for x in group)
        middle = 2 * group[-1][3] - whole if whole <= 0.005 * total / 16 else 2 * end - size
        want.append((own, size, min(middle * 16 // (2 * total), 15)))
    got = [(-(2**63) if r["doc_id"] is None else r["doc_id"], r["size"], r["shard"]) for r in balanced_shards(t, ranges=7).collect()]
    assert sorted(got) == sorted(want)


def test_shards_keep_small_groups_whole(spark):
    # Splitters of many ranges fall inside groups of eight copies, each below the share that may be parted.
    t = spark.createDataFrame([(8 * g + k, f"text {g:05d} " + "y" * 40) for g in range(3400) for k in range(8)], "doc_id long, text string")
    got = balanced_shards(t, ranges=2000)
    assert got.count() == 27_200 and got.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n"), F.count("*").alias("c")).where("c = 8 and n > 1").count() == 0
    keys = [(h, d) for h, d in zip(range(5), (3, FIRST, 9, 4, 1), strict=True)]
    sized = spark.createDataFrame([(0, 10), (2, 6), (2, 5), (3, 7), (4, 10)], "h long, size long")
    assert _around(sized, keys, 10) == [(0, FIRST), (1, FIRST), (2, 9), (3, FIRST), (4, FIRST)]


M = (1 << 64) - 1


def mixed(x):
    """The 64-bit finaliser in plain integers."""
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & M
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & M
    return x ^ x >> 33


def test_toxicity_scores_equal_a_plain_rescoring(spark, docs):
    t = spark.createDataFrame([(k, f"{'bad' if k % 3 else 'good'} words {k % 17}", int(k % 3 > 0)) for k in range(400)], "doc_id long, text string, toxic int")
    model = toxicity.fit(t, t)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    assert weight
    for r in toxicity.score_toxicity(docs.union(docs.withColumn("text", F.concat(F.lit("bad words "), "text"))), model, rows=True).collect():
        text, found = (r["text"] or "").lower(), set()
        for n in model.orders:
            for k in range(len(text) - n + 1):
                h = ord(text[k]) + 1
                for c in text[k + 1 : k + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M
                found.add(mixed((h + n) & M) >> 64 - model.bits)
        want = 1 / (1 + np.exp(-(model.bias + sum(weight.get(b, 0.0) for b in found))))
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.7)


def test_quality_scores_equal_a_plain_rescoring(spark, docs):
    rows = [(k, " ".join(["Word", "w", "WORD!!", "9%"][j % (k % 3 + 2)] for j in range(30)), k % 3) for k in range(300)]
    t = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(t, t)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    base, inverse = textbytes._BASE, pow(int(textbytes._BASE), -1, 1 << 64)
    byte = [int(b) for b in textbytes._BYTE]

    def name(raw):  # the hash of bytes: value times power of the place, summed
        return mixed(sum(byte[b] * pow(int(base), k, 1 << 64) for k, b in enumerate(raw)) & M)

    kind = lambda b: b"a"[0] if 97 <= b <= 122 or b > 127 else b"A"[0] if 65 <= b <= 90 else b"0"[0] if 48 <= b <= 57 else b
    assert inverse and weight
    for r in quality.score_quality(docs.unionByName(t.withColumns({c: F.lit(None).cast(k) for c, k in docs.dtypes if c not in ("doc_id", "text")}).select(docs.columns)), model).collect():
        source = next((x[1] for x in [*corpus(), *rows] if x[0] == r["doc_id"]), None)
        if r["doc_id"] is None or sum(x[0] == r["doc_id"] for x in [*corpus(), *rows]) > 1 or len(source or "") > 4000:
            continue
        count, before, last = {}, 1, None
        words = re.findall(rb"[^\x20\x09-\x0D]+", (source or "").encode())
        for w in words:
            shape = bytes(c for k, c in enumerate(map(kind, w)) if not k or c != kind(w[k - 1]))
            lower, own = name(bytes(b + 32 if 65 <= b <= 90 else b for b in w)), name(shape)
            for h in (lower, mixed((own + 11) & M), mixed((own * 31 + before) & M), mixed(int(lower == last) + 77)):
                count[h >> 64 - model.bits] = count.get(h >> 64 - model.bits, 0) + 1
            before, last = own, lower
        z = sum(weight.get(b, 0.0) * (c / len(words)) ** 0.5 for b, c in count.items())
        tails = 1 / (1 + np.exp(-(z - model.thresholds)))
        assert r["expected_grade"] == pytest.approx(model.grades[0] + (tails * np.diff(model.grades)).sum(), abs=1e-9)
        assert r["tail_probability"] == pytest.approx(tails[-1], abs=1e-9) and r["kept"] == (r["tail_probability"] >= 0.5)


def test_too_many_grades_are_an_error(spark):
    t = spark.createDataFrame([(k, "x", k) for k in range(300)], "doc_id long, text string, quality int")
    with pytest.raises(ValueError, match="64"):
        quality.fit(t, t)
    assert sum(r["count"] for r in training_sample(t, t.withColumn("quality", F.col("quality") % 5), "quality", 10, 2).groupBy("label").count().collect()) == 50


def test_toxicity_learns_and_handles_odd_rows(spark, docs, empty):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(200)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60)) + (" vilegrumble" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(600)]
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(t, t)
    got = toxicity.score_toxicity(t, model).join(t, "doc_id").where("held_out").collect()
    assert len(got) > 100 and all(r["predicted"] == r["toxic"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in toxicity.score_toxicity(t, model).collect())
    odd = toxicity.score_toxicity(docs, model, rows=True).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["score"] <= 1 and r["row"]["score"] == 0.5 for r in odd)
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit(t, t.where("doc_id < 0"))
    assert toxicity.score_toxicity(t, none).agg(F.max("predicted")).first()[0] == 0


def test_quality_orders_three_grades(spark, docs, empty):
    rng = random.Random(4)
    rows = []
    for k in range(900):
        g = k % 3
        rows.append((k, " ".join(rng.choice(["Word", "word", "WORD!!", "x%%%"][: 2 + (g < 2) + (g < 1)]) for _ in range(50)), g))
    t = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(t, t)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score_quality(t, model).join(t, "doc_id").where("held_out").collect()
    mean = [np.mean([r["expected_grade"] for r in got if r["quality"] == g]) for g in range(3)]
    assert mean[0] < 0.7 < mean[1] < 1.5 < mean[2]
    assert len(quality.score_quality(docs, model).collect()) == len(corpus())
    assert quality.score_quality(empty, model).count() == 0
    assert quality.score_quality(t, quality.fit(t, t.where("quality = 1"))).agg(F.min("expected_grade")).first()[0] == 1.0


def test_gradient_of_the_ordinal_loss():
    rng = np.random.default_rng(2)
    x, y = rng.random((40, 3)), rng.integers(0, 4, 40)
    loss, parts = quality.ordinal_loss(x, y, 4, 0.1)
    p = rng.random(6)
    numeric = [(loss(p + e)[0] - loss(p - e)[0]) / 2e-6 for e in np.eye(6) * 1e-6]
    assert np.allclose(loss(p)[1], numeric, atol=1e-4)
    assert loss(minimise(loss, p))[0] < loss(p)[0]


TRICKY = ["it's you're  we'll'd ''s 's \n\n x\t y  \n", "<|endoftext|> hi", "'", "", None, "a'r b've1 'RE're  x 12½ ٣ \U0001f600 'st 'lll", "  ", "\n", "'s'", "x y　z", "\x00\x01"]


def test_byte_level_pieces_equal_the_library():
    path = tokenizer_file("byte_bpe_50k.json")
    encoder = ByteLevelEncoder(path)
    texts = TRICKY + [r[1] for r in corpus()]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    path, tokenizer = str(tmp_path / "ids"), tokenizer_file("byte_bpe_50k.json")
    known = docs.where("doc_id is not null and doc_id <> 70")
    got = sorted(token_table(known, tokenizer, path=path).collect())
    library = ByteLevelEncoder(tokenizer).tokenizer
    at = 0
    for r, (own, text) in zip(got, sorted((r[0], r[1] or "") for r in corpus() if r[0] not in (None, 70)), strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (own, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert read_tokens(spark, path).where("doc_id = 63").count() == 1
    assert "EqualTo(doc_id,63)" in read_tokens(spark, path).where("doc_id = 63")._jdf.queryExecution().executedPlan().toString()
    every = sorted(token_table(docs, tokenizer).select("start", "n_tokens").collect())
    assert len(every) == len(corpus()) and [r["start"] for r in every] == np.cumsum([0, *(r["n_tokens"] for r in every[:-1])]).tolist()
    write_tokens(empty, str(tmp_path / "none"), tokenizer)
    assert token_table(empty, tokenizer).count() == 0


def test_lookups_read_few_rows_of_the_stored_files(spark, tmp_path):
    path, n = str(tmp_path / "ids"), 12_000
    spark.range(n).select((F.col("id") * 2).alias("doc_id"), F.lit("a b").alias("text")).createOrReplaceTempView("many")
    write_tokens(spark.table("many").coalesce(1), path, tokenizer_file("byte_bpe_50k.json"))

    def rows_read(condition):
        found = read_tokens(spark, path).where(condition)
        count = len(found.collect())
        plan = found._jdf.queryExecution().executedPlan()
        return count, plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert rows_read("doc_id >= 0") == (n, n)
    found, read = rows_read("doc_id = 4242")  # row groups of 1,000 rows, by their least and greatest id
    assert found == 1 and read <= 1000
    assert rows_read("doc_id = 4243") == (0, 0)  # within a row group's range: its Bloom filter rules it out


def test_pieces_equal_the_library_and_come_back(docs, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*TRICKY, "a" * 3001, "日本語テキスト", "=-" * 300, *(r[1] for r in corpus())]
    assert [x.tolist() for x in codec(path).encode(texts)] == [library.encode(t or "") for t in texts]
    assert [x.tolist() for x in codec(path).encode(texts, window=37)] == [library.encode(t or "") for t in texts]
    rows = encode_pieces(docs, path)
    assert rows.count() == len(corpus()) and rows.where("not round_trip").count() == 0
    back = {r["doc_id"]: r["text"] for r in decode_pieces(rows, path).where("doc_id is not null").collect()}
    assert back == {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    assert encode_pieces(empty, path).count() == 0


def test_text_without_cuts_is_walked_as_it_comes():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), codec(path)
    rng = random.Random(3)
    laid = []
    plain, own._laid_out = own._laid_out, lambda texts, **how: laid.append(sum(map(len, texts))) or plain(texts, **how)
    try:
        for letters, size in (("abcdeortinsh", 9000), ("abcdeortinsh  ", 6000), ("a", 4000), ("etaoinAX,9日 ", 6000)):
            text = "".join(rng.choice(letters) for _ in range(size // 2)) + "the of " * 40 + "".join(rng.choice(letters) for _ in range(size // 2))
            laid.clear()
            assert np.concatenate(list(own.stream(own.normal(text), 300))).tolist() == library.encode(text)
            assert sum(laid) < 2.5 * len(text)
    finally:
        del own._laid_out


def unigram(pieces):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    import struct

    body = b""
    for p, s, kind in pieces:
        body += field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, kind]))
    return body + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 0, 4 << 3, 0]))


def test_unigram_paths_are_best_and_stream():
    rng = random.Random(9)
    vocabulary = [("<unk>", 0.0, 2)] + [(p, -rng.random() * 5, 1) for p in ("a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bca")]
    own = PieceCodec(PieceModel(unigram(vocabulary)))
    score = {p: own.model.scores[k] for p, k in own.model.ids.items()}
    for _ in range(60):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        best = [0.0] + [-1e9] * len(text)
        for e in range(1, len(text) + 1):
            best[e] = max(best[s] + score[text[s:e]] for s in range(max(0, e - 3), e) if text[s:e] in score)
        for window in (None, 1, 5):
            path = list(own.path(text, window))
            assert "".join(path) == text and sum(score[p] for p in path) == pytest.approx(best[-1])
            cut = sorted(rng.randint(0, len(text)) for _ in range(3))
            assert list(own.walk([text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)], window)) == path
