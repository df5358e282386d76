"""The corpus operators against brute force, round trips and the libraries they agree with."""

import base64
import gzip
import hashlib
import io
import math
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm import embed_dedup, media, packing, pieces, queries, similar, simhash, substring, token_counts, toxicity, urlfilter, warc
from lamella.llm.shared import claim, components
from lamella.llm.wordbpe import WholeText, default_path

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, "  ", "one", "Same text twice over", "Same text twice over", "İstanbul ǅ 日本 <|endoftext|> it's 12½", "word " * 9000, "a\x1cb\x85c\xa0d"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i if i != 3 else None, t, "x", 0.5, 1) for i, t in enumerate(ODD)] + [(0, "", "x", 0.5, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, score double, length int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [tuple(map(int, rng.integers(200, 320, 2))) for _ in range(70)] + [(5, 5), (7, None), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    root = {}
    for a, b in chain:
        if b is not None and a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in chain:
            if b is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_warc_round_trip(spark, tmp_path):
    html = ["<a>", "<a>", None, "", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n", "<a>", "long " * 20000, "<a>", "only"]
    ids = [5, 3, 1, 2, 9, 3, 11, None, None]
    pages = spark.createDataFrame([(i, None if i == 9 else f"http://h/{i}\n", h, "z") for i, h in zip(ids, html)], "page_id long, url string, html string, record_type string")
    got = sorted(map(tuple, warc.pages_through_archives(pages).collect()), key=repr)
    want = []
    for i, h in zip(ids, html):
        data = (h or "").encode()
        first = min([j for j, g in zip(ids, html) if (g or "") == (h or "") and j is not None], default=None)
        again = first is not None and i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    big = warc.pages_through_archives(pages, min_bytes=100).collect()
    assert all(r["record_type"] == "response" for r in big)
    assert warc.pages_through_archives(pages.limit(0)).count() == 0


def test_archives_have_a_member_per_record_and_bounded_files(spark, tmp_path):
    """Pages of a megabyte, in archives of about two; a record's member is unpacked without the others."""
    rng = np.random.default_rng(31)
    html = [bytes(rng.integers(33, 127, 1_000_000, dtype=np.uint8)).decode() for _ in range(12)] + ["x" * 17_000_000, "", None]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"), file_bytes=2_000_000)
    files = sorted((tmp_path / "a").rglob("*.warc.gz"))
    assert len(files) >= 6 and all(f.stat().st_size < 3_200_000 for f in files) and not list((tmp_path / "a").rglob("*.txt"))
    kinds, sizes = [], []
    for f in files:
        left = f.read_bytes()
        while left:
            one = zlib.decompressobj(31)
            record = one.decompress(left)
            left = one.unused_data
            assert one.eof and (not record or record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n"))
            kinds += [record.split(b"\r\n")[1]] if record else []
            sizes.append(len(record))
        assert sum(1 for _ in warc.parse(f.read_bytes())) == sum(1 for _ in warc.parse(gzip.decompress(f.read_bytes())))
    assert len(kinds) == 45 and kinds.count(b"WARC-Type: response") == 14 and kinds.count(b"WARC-Type: revisit") == 1
    assert all(len(part) <= 1 << 20 for f in files for part in warc.plain_bytes(f.read_bytes()))
    got = {r["requests"][0]["headers"]["warc-target-uri"]: r["response"] for r in warc.assemble(warc.read_archives(spark, str(tmp_path / "a")).cache()).collect()}
    for i, h in enumerate(html):
        r = got[f"http://h/{i}"]
        assert bytes(r["payload"]) == (h or "").encode()
    assert got["http://h/14"]["headers"]["warc-refers-to"] == got["http://h/13"]["record_id"]


def test_warc_links_of_any_length(spark):
    def record(i, kind, to):
        return (i, kind, to, {}, 1, b"p", 1, "d")

    chain = [record("r", "response", []), record("q0", "request", ["r"])] + [record(f"q{k}", "request", [f"q{k - 1}"]) for k in range(1, 9)] + [record("n", "metadata", ["n2"]), record("n2", "metadata", ["n"]), record(None, "metadata", ["r"])]
    got = warc.assemble(spark.createDataFrame(chain, warc.RECORD)).collect()
    assert [(r["record_id"], [x["record_id"] for x in r["requests"]], r["metadata"]) for r in got] == [("r", [f"q{k}" for k in range(9)], [])]


def test_warc_assembly_follows_links_both_ways(spark):
    def record(i, kind, to):
        return (i, kind, to, {"k": i}, 1, b"p", 1, "d")

    rows = [record("r1", "response", ["q1"]), record("q1", "request", []), record("m1", "metadata", ["q1"]), record("m0", "metadata", ["r1"]), record("r2", "revisit", []), record("x", "request", []), record("q2", "request", ["r2"])]
    got = {r["record_id"]: ([x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]]) for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {"r1": (["q1"], ["m0", "m1"]), "r2": (["q2"], [])}


# 2


@pytest.mark.parametrize("score", ["dot", "norm"])
@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(4096, 6, 4096 * 2000)])
def test_plan_respects_every_capacity(capacity, score):
    lengths = np.clip(np.random.default_rng(3).lognormal(6, 1.1, 20000).astype(int), 1, 2800)
    distinct, counts = np.unique(lengths, return_counts=True)
    runs = packing.plan(dict(zip(distinct.tolist(), counts.tolist())), capacity, score)
    sequences, lens = [], []
    for k, n in enumerate(runs["length"]):
        end = runs["rank"][k + 1] if k + 1 < len(runs["length"]) and runs["length"][k + 1] == n else counts[distinct == n][0]
        ranks = np.arange(end - runs["rank"][k])
        sequences.append(runs["sequence"][k] + ranks // runs["per_bin"][k])
        lens.append(np.full(len(ranks), n))
    sequences, lens = np.concatenate(sequences), np.concatenate(lens)
    assert len(lens) == len(lengths) and np.bincount(sequences).max() <= capacity.vector()[1]
    assert np.bincount(sequences, lens).max() <= 4096 and np.bincount(sequences, lens.astype(float) ** 2).max() <= capacity.vector()[2]
    if capacity.documents is None:
        assert runs["sequences"] <= 1.01 * -(-lengths.sum() // 4096)


def packed_well(rows, texts):
    whole = WholeText(default_path())
    pieces_of, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces_of[r["doc_id"], r["text_key"]].append(r) if "text_key" in r else pieces_of[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096
    for doc_id, text in texts.items():
        ids = np.array([*whole.whole(text or ""), 1], dtype="<u4")
        want = [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces_of[doc_id]) == want
    total = sum(length for spots in places.values() for _, length in spots)
    return len(places), -(-total // 4096)


def test_packing_documents(spark, odd, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    used, least = packed_well([r.asDict() for r in queries.op2_best_fit_packing(spark, SMALL).collect()], texts)
    assert used <= least + max(2, least // 50)
    out = packing.pack_documents(odd, default_path()).collect()
    assert sum(r["piece"] == 0 for r in out) == len(ODD) + 1 and max(r["piece"] for r in out) >= 2
    assert packing.pack_documents(odd.limit(0), default_path()).count() == 0


def test_all_three_capacities_bind(spark):
    """Packed under each set of bounds: every bound holds, and taking any of the three away changes what fits."""
    lengths = np.clip(np.random.default_rng(5).lognormal(4.5, 1.2, 4000).astype(int), 1, 1500)
    df = spark.createDataFrame([(i, int(n), "z", "y", 0.5) for i, n in enumerate(lengths)], "doc_id int, length long, _group string, Offset string, _n double")
    full = packing.Capacity(2048, 12, 1100 * 2048)
    used = {}
    for name, capacity in {"all": full, "tokens": packing.Capacity(10**6, 12, 1100 * 2048), "documents": packing.Capacity(2048, None, 1100 * 2048), "attention": packing.Capacity(2048, 12)}.items():
        out = packing.pack(df, capacity)
        assert out.columns == ["doc_id", "length", "_group", "_n", "sequence_id", "offset"]
        got = out.toPandas()
        assert sorted(got["doc_id"]) == list(range(len(lengths))) and set(got["_group"]) == {"z"} and set(got["_n"]) == {0.5}
        sums = got.assign(square=got["length"] ** 2).groupby("sequence_id").agg(tokens=("length", "sum"), documents=("doc_id", "size"), attention=("square", "sum"))
        assert (sums[["tokens", "documents", "attention"]].to_numpy() <= capacity.vector()).all()
        assert (got.sort_values("offset").groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
        used[name] = len(sums)
    assert all(used[name] < used["all"] for name in ("tokens", "documents", "attention"))


# 3


def test_images_round_trip():
    rng = np.random.default_rng(2)
    for shape in ((5, 7, 3), (1, 1, 3), (9, 4, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_ppm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    grey = rng.integers(0, 256, (4, 6, 1), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(grey)) == grey).all()
    assert media.decode(b"P1\n# note\n3 2\n0 1 0\n1 0 1\n")[:, :, 0].tolist() == [[255, 0, 255], [0, 255, 0]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b01000000, 0b10100000]))[:, :, 0].tolist() == [[255, 0, 255], [0, 255, 0]]
    assert media.decode(b"P2 2 1 255 7 9")[:, :, 0].tolist() == [[7, 9]]
    assert media.decode(b"P3 1 1 255 7 9 11").tolist() == [[[7, 9, 11]]]
    assert media.decode(b"P5 1 1 65535\n" + bytes([1, 2])).tolist() == [[[258]]]
    for bad in (b"", b"GIF", b"P6 2 2 255\nxx", b"BM"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_equals_counting_every_part():
    image = np.random.default_rng(4).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    fine = np.repeat(np.repeat(image, 3 * 4, axis=0), 4 * 4, axis=1).astype(float)  # 84 x 80 parts divide evenly
    want = fine.reshape(3, 28, 4, 20, 3).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 3, 4), want)


def slow_resize(image, height, width):
    """Each target cell's mean, by the part of every pixel that lies in it."""
    h, w, channels = image.shape
    out = np.zeros((height, width, channels))
    for r in range(height):
        for c in range(width):
            for y in range(h):
                for x in range(w):
                    inside = max(0.0, min(y + 1, (r + 1) * h / height) - max(y, r * h / height)) * max(0.0, min(x + 1, (c + 1) * w / width) - max(x, c * w / width))
                    out[r, c] += inside * image[y, x]
    return out * height * width / (h * w)


def slow_hash(image):
    grey = np.round(slow_resize(image.astype(float), 8, 9).mean(axis=2), 6)
    return f"{int(''.join('1' if grey[r, c] < grey[r, c + 1] else '0' for r in range(8) for c in range(8)), 2):016x}"


def test_features_equal_a_slow_version(spark):
    """Tiles are NPY files of the resized image, scaled to 255; hashes are of the whole and of each tile."""
    rng = np.random.default_rng(33)
    ramp = np.arange(65536, dtype=">u2").reshape(256, 256)
    cases = [
        (b"P6\n5 7\n255\n", rng.integers(0, 256, (7, 5, 3)), 255), (b"P5\n6 4\n15\n", rng.integers(0, 16, (4, 6, 1)), 15), (b"P6\n3 9\n1000\n", rng.integers(0, 1001, (9, 3, 3)), 1000),
    ]
    stored = [head + image.astype(">u2" if most > 255 else np.uint8).tobytes() for head, image, most in cases]
    made = spark.createDataFrame([(i, d) for i, d in enumerate(stored)], "i int, m binary").select("i", media.features(F.col("m"), 8, 4).alias("f")).orderBy("i").collect()
    for (_, image, most), r in zip(cases, made):
        f = r["f"]
        want = slow_resize(image.astype(float), 8, 8) * 255 / most
        tiles = {(t["row"], t["col"]): np.load(io.BytesIO(t["npy"])) for t in f["tiles"]}
        got = np.concatenate([np.concatenate([tiles[a, b] for b in (0, 1)], axis=1) for a in (0, 1)])
        assert got.dtype == np.uint8 and np.abs(got - want).max() <= 0.5 + 1e-6
        assert f["hash"] == slow_hash(image) and all(t["hash"] == slow_hash(tiles[t["row"], t["col"]]) for t in f["tiles"])
        assert f["maximum"] == most and bytes(f["samples"]) == image.astype(np.uint16 if most > 255 else np.uint8).tobytes()
        assert f["tiles_crc32"] == zlib.crc32(b"".join(t["npy"] for t in f["tiles"])) and f["samples_sha256"] == hashlib.sha256(f["samples"]).hexdigest()
    wide = spark.createDataFrame([(b"P5\n256 256\n65535\n" + ramp.tobytes(),), (b"P5\n2 1\n9\n\x00\x0a",), (b"P5\n1 1\n0\n\x00",)], "m binary").select(media.features(F.col("m")).alias("f")).collect()
    levels = np.concatenate([np.load(io.BytesIO(t["npy"])).ravel() for t in wide[0]["f"]["tiles"]])
    assert levels.min() < 4 and levels.max() > 251 and len(np.unique(levels)) > 60
    assert wide[1]["f"]["error"] and wide[2]["f"]["error"]


def test_texts_as_images(odd, spark):
    got = media.stored_texts(odd).collect()
    by_text = defaultdict(set)
    for r in got:
        text = (ODD[r["doc_id"]] if r["doc_id"] is not None else ODD[3]) or ""
        raw = text.encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        form = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
        by_text[text].add(r["feature"])
    assert len(got) == len(ODD) + 1 and all(len(f) == 1 for f in by_text.values())
    made = spark.createDataFrame([(media.encode_bmp(np.full((70, 90, 3), 9, np.uint8)),), (b"bad",), (None,)], "m binary").select(media.features(F.col("m")).alias("f")).collect()
    assert len(made[0]["f"]["tiles"]) == 4 and made[1]["f"]["error"] and media.stored_texts(odd.limit(0)).count() == 0


# 4


def test_toxicity_on_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    scored = toxicity.score_documents(docs.select("doc_id", "text"), labels)
    got = scored.join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"])
    right = got["predicted"] == got["toxic"]
    assert right.mean() > 0.97 and ((got["predicted"] == 1) & (got["toxic"] == 0)).mean() < 0.005
    assert got["score"].between(0, 1).all()


def test_toxicity_of_odd_tables(odd, spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, 0), (None, 1), (6, None), (7, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(odd, labels).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in out)
    none = toxicity.score_documents(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.score_documents(odd.limit(0), labels).count() == 0


def test_ftrl_equals_a_scalar_loop():
    rng = np.random.default_rng(35)
    settings = toxicity.Settings(bits=8, alpha=0.7, l1=0.3, l2=0.2, epochs=3)
    examples = [np.unique(rng.integers(0, 256, int(rng.integers(0, 30)))).astype(np.int32) for _ in range(120)]
    labels = rng.integers(0, 2, 120).astype(float)
    n, z, bias, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        return -(z[i] - math.copysign(settings.l1, z[i])) / ((settings.beta + math.sqrt(n[i])) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for x, y in zip(examples, labels):
            own = {int(i): weight(int(i)) for i in x}
            g = 1 / (1 + math.exp(-(bias + sum(own.values())))) - y
            for i, w in own.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / settings.alpha * w
                n[i] += g * g
            bias_n += g * g
            bias -= settings.alpha / (settings.beta + math.sqrt(bias_n)) * g
    got_bias, got = toxicity.ftrl(examples, labels, settings)
    assert abs(got_bias - bias) < 1e-9 and np.allclose(got, [weight(i) for i in range(256)], atol=1e-9) and (got == 0).any() and (got != 0).any()


def test_coordinates_equal_a_slow_list_of_grams():
    for text in ["", None, "One two, THREE four! two --", "a b", "a", "“Quoted” words… and so on - " * 5]:
        bare = [w.strip(toxicity.EDGES) for w in (text or "").lower().split()]
        bare = [w for w in bare if w]
        h, odd = [xxhash.xxh64_intdigest(w, 7) for w in bare], 0x9E3779B97F4A7C15
        grams = [x * odd for x in h] + [xxhash.xxh64_intdigest(w[:5], 9) * odd for w in bare]
        grams += [(h[i] * 3 + h[i + 1]) * odd for i in range(len(h) - 1)] + [(h[i] * 5 + h[i + 2] * 7) * odd for i in range(len(h) - 2)]
        assert sorted(toxicity.coordinates(text, 20).tolist()) == sorted(g % 2**64 >> 44 for g in grams)


def test_scores_are_the_sum_of_the_weights_of_a_text(spark, docs):
    model = toxicity.train(docs.withColumn("label", F.col("text").contains("stupid").cast("int")))
    dense = model.dense()
    got = docs.limit(50).select("text", toxicity.toxicity(F.col("text"), model).alias("score")).collect()
    for r in got:
        z = model.bias + sum(float(dense[i]) for i in set(toxicity.coordinates(r["text"], model.bits).tolist()))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-35, min(35, z))))) < 1e-6


def test_a_sample_over_its_bytes_is_cut_by_hash(spark, docs):
    labelled = docs.withColumn("label", F.col("text").contains("stupid").cast("int"))
    small = toxicity.train(labelled, settings=toxicity.Settings(sample_bytes=60_000))
    again = toxicity.train(labelled.repartition(5), settings=toxicity.Settings(sample_bytes=60_000))
    assert (small.index == again.index).all() and small.bias == again.bias != toxicity.train(labelled).bias


def test_model_is_sparse_and_repeatable(spark, docs):
    labelled = docs.withColumn("label", F.col("text").contains("stupid").cast("int"))
    a, b = toxicity.train(labelled), toxicity.train(labelled.repartition(3))
    assert (a.index == b.index).all() and (a.weight == b.weight).all() and len(a.index) < 20000


# 5


def test_cascade_is_exact_on_its_universe(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 50 = 7 THEN NULL ELSE concat('h', id % 2000) END AS host", "id AS listed", "'k' AS _key", "id AS _h1", "'s' AS _shard")
    listed = spark.range(2100).filter("id % 3 = 0").selectExpr("concat('h', id) AS k")
    keys = {r[0] for r in listed.collect()}
    for most in (32 << 20, 200):  # one cascade, and several shards
        out = urlfilter.in_list(df, F.col("host"), listed, "inside", most_bytes=most)
        got = out.collect()
        assert out.columns == [*df.columns, "inside"] and len(got) == 3000 and all(r["inside"] == (r["host"] in keys) for r in got)
        assert {r["_key"] for r in got} == {"k"} and sorted(r["_h1"] for r in got) == list(range(3000)) and {r["_shard"] for r in got} == {"s"}
    assert urlfilter.in_list(df.limit(0), F.col("host"), listed).count() == 0
    assert urlfilter.in_list(df, F.col("host"), listed).columns == ["host", "_key", "_h1", "_shard", "listed"]
    assert not any(r["inside"] for r in urlfilter.in_list(df, F.col("host"), listed.limit(0), "inside").collect())


def test_levels_alternate_and_undo_each_others_mistakes(spark):
    def keys(df):
        return df.select(*[c.alias(n) for c, n in zip(urlfilter.key_hashes(F.col("k")), ("h1", "h2"))], F.lit(0).alias("shard"))

    corpus, listed = spark.range(20000).selectExpr("cast(id AS string) AS k"), spark.range(5000).selectExpr("cast(id * 3 AS string) AS k")
    cascade = urlfilter.build_cascade(keys(corpus), keys(listed), first=1 / 8)
    levels = cascade.sent[0].value
    rows = keys(corpus).toPandas()
    h1, h2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    inside = np.array([int(r["k"]) % 3 == 0 and int(r["k"]) < 15000 for r in corpus.collect()])
    assert len(levels) >= 4 and (urlfilter.member(levels, h1, h2) == inside).all()
    for k in range(len(levels)):  # without any one level some key is judged wrongly, without the last ones too
        assert (urlfilter.member(levels[:k], h1, h2) != inside).any()
    assert levels[0].holds(h1[inside], h2[inside]).all() and 0 < levels[0].holds(h1[~inside], h2[~inside]).mean() < 0.3


def test_rules(spark):
    urls = ["HTTP://Example.COM/en/7?x", "x://a.example.com/en/7", "http://notexample.com/en/7", "http://com/en/", "http://b.example.net/de/8#t", "http://c.net/de/9", "no scheme", None, "http://x.org", "://é.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, queries.RULES, spark.createDataFrame([("x.org",)], "host string")).collect()}
    assert got[0] == ("example.com", "/en/7", "example.com/en/7", "allow") and got[1][2] == "example.com/en/7" and got[2][2:] == ("com/en/", "block")
    assert got[3][2] == "com/en/" and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("x.org", "", None, "block") and got[9][2:] == ("org/es/", "block")


# 6


def slow_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    rng = np.random.default_rng(radius)
    for _ in range(2000):
        at = rng.choice(64, radius, replace=False)
        assert any(not any(m >> int(i) & 1 for i in at) for m in masks)


def test_linked_fingerprints_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    prints = sorted({b ^ sum(1 << int(i) for i in rng.choice(63, int(rng.integers(0, 5)), replace=False)) for b in base for _ in range(8)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for radius in (2, 3):
        want = slow_components([(a, b) for a, b in combinations(prints, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius], prints)
        got = slow_components([(r["a"], r["b"]) for r in simhash.linked_fingerprints(df, radius).collect()], prints)
        assert got == want


def test_tables_decide_the_links_and_crowded_buckets_lose_none(spark, monkeypatch):
    rng = np.random.default_rng(41)
    prints = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in rng.integers(0, 2**62, 5) for i, j in rng.integers(0, 63, (40, 2))})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = slow_components([(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2], prints)
    for most in (2, 64, 10**6):  # by balls, mixed, and by pairs in buckets alone
        got = slow_components([(r["a"], r["b"]) for r in simhash.linked_fingerprints(df, 2, most).collect()], prints)
        assert got == want
    edges = simhash.linked_fingerprints(df, 2, 10**6).collect()
    assert all(0 < (r["a"] ^ r["b"]).bit_count() <= 2 for r in edges)
    one = simhash.covering_masks(2)[:1]
    monkeypatch.setattr(simhash, "covering_masks", lambda radius: one)
    fewer = {(r["a"], r["b"]) for r in simhash.linked_fingerprints(df, 2, 10**6).collect()}
    assert fewer == {(r["a"], r["b"]) for r in edges if not (r["a"] ^ r["b"]) & one[0]} and len(fewer) < len(edges)


def test_simhash_near_duplicates(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {d: slow_simhash(t) for d, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = slow_components(links, prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in prints}
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) + 1 and {r["component_id"] for r in out if r["fingerprint"] == "0" * 16} == {0}
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None] and simhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_of_a_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    sets = {d: frozenset(substring.shingles(t, 5).tolist()) for d, t in texts.items()}
    prints = {d: slow_simhash(t.decode()) for d, t in texts.items()}

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return (prints[a] ^ prints[b]).bit_count() <= 2 or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    want = slow_components([p for p in combinations(sorted(texts), 2) if alike(*p)], texts)
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    assert sum(got[d] == want[d] for d in texts) >= 0.998 * len(texts)
    assert all(got[d] >= want[d] for d in texts)
    assert sum(d != c for d, c in got.items()) >= 0.95 * sum(d != c for d, c in want.items())


def test_a_family_is_linked_by_a_base_of_any_rank(spark):
    rng = np.random.default_rng(21)
    rows, want, at = [], {}, 0
    for n in (40, 120, 300, 900):
        base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        family = [base]
        while len(family) < 100:
            copy = list(base)
            while similar.jaccard(*(substring.shingles(" ".join(x).encode(), 5) for x in (base, copy))) > 0.87:
                copy[int(rng.integers(0, n))] = f"e{rng.integers(0, 10**9)}"
            if similar.jaccard(*(substring.shingles(" ".join(x).encode(), 5) for x in (base, copy))) >= 0.8:
                family.append(copy)
        family[0], family[50] = family[50], family[0]
        for t in family:
            rows.append((at, " ".join(t)))
            want[at] = at // 100 * 100
            at += 1
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_short_near_copies_of_any_length_are_linked(spark):
    rng = np.random.default_rng(22)
    rows = []
    for n in (14, 16, 20, 25, 30, 60):
        for k in range(60):
            text = [f"w{x}" for x in rng.integers(0, 10**7, n)]
            edited = [["new", *text[1:]], [*text[:-1], "new"], [*text, "new"]][k % 3]
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(edited))]
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}


def test_overlaps_equal_counting():
    rng = np.random.default_rng(25)
    sets = [set(rng.integers(0, 60, int(rng.integers(0, 40))).tolist()) for _ in range(50)] + [set(range(1000, 1000 + n)) for n in (0, 30, 31)]
    row = np.array([i for i, x in enumerate(sets) for _ in x])
    element = np.array([e for x in sets for e in x], dtype=np.uint64)
    for few in (1, 4, 100):
        got = similar.overlaps(row, element, len(sets), few)
        assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(len(sets)) for j in range(len(sets)) if i != j)


def test_what_the_base_does_not_link_is_linked_all_the_same(spark):
    """Families with many copies too far from their base, some of which are near copies of each other; keys dealt over many blocks."""
    rng = np.random.default_rng(26)
    rows, n = [], 150
    for _ in range(2):
        base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        for k in range(160):
            copy = list(base)
            for _ in range(int(rng.integers(0, 14))):
                copy[int(rng.integers(0, n))] = f"e{rng.integers(0, 10**9)}"
            rows.append(copy)
            if k % 5 == 0:  # a copy of the copy
                again = list(copy)
                again[int(rng.integers(0, n))] = f"f{rng.integers(0, 10**9)}"
                rows.append(again)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    sets = [frozenset(substring.shingles(" ".join(r).encode(), 5).tolist()) for r in rows]
    prints = [slow_simhash(" ".join(r)) for r in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 2]
    want = slow_components(links, range(len(rows)))
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")).collect()}
    assert got == want and 3 <= len(set(want.values())) < len(rows)


def test_groups_of_wide_rows_are_bounded_by_bytes(spark):
    """Few rows, each of a long text: a key's are dealt over blocks, every two of them meet once, and many keys' go to more lots."""
    one = [(7, i, bytes(10_000)) for i in range(60)]
    many = [(100 + i // 2, 1000 + i, bytes(10_000)) for i in range(200)]
    rows = spark.createDataFrame(one + many, "key long, doc_id long, diff binary")

    def seen(group):
        return pd.DataFrame({"held": [sum(map(len, group["diff"]))], "rows": [[f"{k},{d},{b}" for k, d, b in zip(group["key"], group["doc_id"], group["block"], strict=True)]], "apart": [bool(group["low"].iloc[0] != group["high"].iloc[0])]})

    got = similar._grouped(rows, wide="diff", most_bytes=200_000).applyInPandas(seen, "held long, rows array<string>, apart boolean").collect()
    assert max(r["held"] for r in got) <= 400_000
    met = defaultdict(int)
    for r in got:
        for (ka, a, x), (kb, b, y) in combinations([tuple(map(int, t.split(","))) for t in r["rows"]], 2):
            if ka == kb and (not r["apart"] or x != y):
                met[min(a, b), max(a, b)] += 1
    assert met == {p: 1 for p in [*combinations(range(60), 2), *((i, i + 1) for i in range(1000, 1200, 2))]}


# 7


def test_pieces_equal_the_library(spark, odd):
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["", None, " ", "  a   b  ", "\n\tx", "日本語 😀 é́", "▁x y", "a▁▁b ▁", "a" * 500 + " b", "x" * 193 + "▁" + "é" * 400, "<s>x</s> <0x41>", "word " * 5000]
    for text, ids in zip(texts, model.encode(texts)):
        assert ids.tolist() == model.library.encode(text or "") and model.decode(ids) == model.library.decode(ids.tolist())
    out = pieces.encoded_documents(odd, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(out) == len(ODD) + 1 and all(r["round_trip"] for r in out)
    assert pieces.encoded_documents(odd.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_best_sums_of_byte_pair_pieces_equal_a_slow_search(spark, odd):
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    score = {t: float(s) for t, s, k in zip(model.texts, model.scores, model.kinds) if k == pieces.NORMAL}
    low = min(score.values()) - 10
    words = sorted({w for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).collect() for w in r["text"].split()})[:300] + ["日本x", "a" * 40]

    def best(word):
        at = [0.0]
        for end in range(1, len(word) + 1):
            at.append(max((at[k] + score.get(word[k:end], low if end - k == 1 else -math.inf) for k in range(max(0, end - model.longest), end))))
        return at[-1]

    for word, ids in zip(words, model.encode(words, True)):
        got = sum(score.get(model.texts[i], 0.0) for i in ids if model.kinds[i] == pieces.NORMAL) + low * sum(1 for c in word if c not in score)
        assert abs(got - best("▁" + word)) <= 1e-4 * abs(got) and model.decode(ids) == word
    long = " ".join(["x" * 700, "y" * 193, "z"])
    assert model.decode(model.encode([long], True)[0]) == long
    rows = {r["doc_id"]: r for r in pieces.encoded_documents(odd, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i in (4, 7, 8):
        ids = model.encode([ODD[i]], True)[0]
        assert (rows[i]["n_best"], rows[i]["best_crc32"]) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        assert rows[i]["n_pieces"] == len(model.library.encode(ODD[i]))


def unigram_file(path, listed):
    """A small unigram model, written field by field."""
    import struct

    def part(number, data):
        size = bytes([len(data)]) if len(data) < 128 else bytes([len(data) & 127 | 128, len(data) >> 7])
        return bytes([number << 3 | 2]) + size + data

    body = b"".join(part(1, part(1, t.encode()) + b"\x15" + struct.pack("<f", s) + (bytes([3 << 3, kind]) if kind != 1 else b"")) for t, s, kind in listed)
    body += part(2, bytes([3 << 3, 1])) + part(3, part(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    path.write_bytes(body)
    return str(path)


def test_viterbi_equals_the_library_and_all_segmentations(tmp_path):
    rng = np.random.default_rng(9)
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.1, 1)] + [(c, -4 - rng.random(), 1) for c in "abcd"]
    seen = {t for t, _, _ in listed}
    for _ in range(80):
        t = ("▁" if rng.random() < 0.5 else "") + "".join(rng.choice(list("abcd"), int(rng.integers(2, 6))))
        if t not in seen:
            seen.add(t)
            listed.append((t, float(-2 - 6 * rng.random()), 1))
    model = pieces.PieceModel(unigram_file(tmp_path / "u.model", listed))
    assert model.kind == pieces.UNIGRAM and model.by_word
    words = ["".join(rng.choice(list("abcdabcdx"), int(rng.integers(1, 11)))) for _ in range(400)]
    for word, ids in zip(words, model.encode(words)):
        assert ids.tolist() == model.library.encode(word)
    score = {t: s for t, s, kind in listed if kind == 1}

    def best(text):
        return 0 if not text else max((score[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in score), default=-1e9)

    for word in [w for w in words if "x" not in w and len(w) < 8][:40]:
        assert abs(sum(score[model.texts[i]] for i in model.encode([word])[0]) - best("▁" + word)) < 1e-3


def slow_best(text, score, low, longest):
    """The best sum of scores over all segmentations; ``low`` for a character that is no piece."""
    at = [0.0]
    for end in range(1, len(text) + 1):
        at.append(max(at[k] + score.get(text[k:end], low if end - k == 1 else -math.inf) for k in range(max(0, end - longest), end)))
    return at[-1]


def test_words_of_any_length_have_the_best_sum(tmp_path, monkeypatch):
    """Exact sums on both sides of ``LONGEST``, also next to characters without a piece; the way of long words gives what the tables give."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.PieceModel(path)
    score = {t: float(s) for t, s, k in zip(model.texts, model.scores, model.kinds) if k == pieces.NORMAL}
    low = model.low
    run = "".join(r["text"] for r in pd.read_parquet(f"{SMALL}/documents.parquet").head(40).to_dict("records")).replace(" ", "")
    words = [run[k * 2000 : k * 2000 + n] for k, n in enumerate([5, 60, 190, 191, 192, 193, 400, 1500])] + [".\nEationth", "end.\nHationnt", "日ation" * 70]
    got = model.both(words)
    for word, (library, best) in zip(words, got):
        assert library.tolist() == model.library.encode(word) and model.decode(best) == word
        bytes_of = [c for c in "▁" + word if c not in score]
        assert sum(score[model.texts[i]] for i in best.tolist() if model.kinds[i] == pieces.NORMAL) + low * len(bytes_of) == slow_best("▁" + word, score, low, model.longest)
    for longest in (2, 10**6):
        monkeypatch.setattr(pieces, "LONGEST", longest)
        again = pieces.PieceModel(path).both(words)
        assert [(a.tolist(), b.tolist()) for a, b in again] == [(a.tolist(), b.tolist()) for a, b in got]
    rng = np.random.default_rng(4)
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.1, 1)] + [(c, -4 - rng.random(), 1) for c in "abc"]
    listed += [(t, -2 - 4 * rng.random(), 1) for t in ("ab", "bca", "▁ca", "abcab", "cc")]
    for more in ([], [("a▁b", -1.5, 1)]):  # with a mark inside a piece, texts are taken whole
        file, results = unigram_file(tmp_path / f"{len(more)}.model", listed + more), []
        own = pieces.PieceModel(file)
        assert own.by_word == (not more)
        texts = ["".join(rng.choice(list("abcabcx "), 700)).strip() for _ in range(4)] + ["".join(rng.choice(list("abc"), 500))]
        for longest in (2, 192, 10**6):
            monkeypatch.setattr(pieces, "LONGEST", longest)
            results.append([ids.tolist() for ids in pieces.PieceModel(file).encode(texts, True)])
        assert results[0] == results[1] == results[2]
        known = {t: float(np.float32(s)) for t, s, kind in listed + more if kind == 1}
        text = "▁" + texts[-1]
        assert abs(sum(known[own.texts[i]] for i in results[0][-1]) - slow_best(text, known, own.low, own.longest)) < 1e-2


# 8


def exact_links(vectors, least=0.95):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    return [(a, b) for a, b in combinations(sorted(unit), 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]


@pytest.mark.parametrize("settings", [embed_dedup.Settings(), embed_dedup.Settings(cell=60, block=40), embed_dedup.Settings(cell=10**6, block=60)])
def test_embedding_links(spark, settings):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 64))
    vectors = {}
    for i in range(700):
        v = centres[i % 30] + rng.standard_normal(64) * (0.05 + 0.25 * rng.random()) if i < 400 else rng.standard_normal(64)
        vectors[i] = v.astype(np.float32).tolist()
    for i in range(700, 760):
        vectors[i] = vectors[3]
    vectors |= {800: [1.0, 0.0], 801: [2.0, 0.001], 802: (np.array(vectors[5]) * 4).tolist()}
    bad = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [float("inf")] + [1.0] * 63), (905, [None] * 64)]
    df = spark.createDataFrame([(i, v, 1) for i, v in list(vectors.items()) + bad], "vec_id long, embedding array<float>, n_links int")
    links = exact_links(vectors)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df, settings=settings).collect()}
    assert len(got) == len(df.collect()) and all(got[i]["n_links"] <= degree[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * 2 * len(links)
    want = slow_components(links, vectors)
    assert np.mean([got[i]["component_id"] == want[i] for i in vectors]) > 0.9
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in bad) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    unit = np.stack([np.array(v, float) for v in df.orderBy("vec_id").toPandas()["embedding"]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = int(((unit @ unit.T) >= 0.95).sum()) - len(unit)
    found = embed_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * true <= found <= true


# 9


def test_compact_windows_equal_the_definition():
    rng = np.random.default_rng(0)
    for n in (10, 46, 47, 100, 500):
        values = substring.mixed(rng.integers(0, n // 2 + 1, n).astype(np.uint64))
        placed, _ = substring.placed(values)
        want = []
        for i in range(n):
            a = b = i
            while a > 0 and placed[a - 1] > placed[i]:
                a -= 1
            while b < n - 1 and placed[b + 1] > placed[i]:
                b += 1
            if b - a + 1 >= 46:
                want.append((i, a, b))
        assert sorted(zip(*(x.tolist() for x in substring.compact_windows(values, 46)))) == want


def test_words_are_hashed_where_they_stand(monkeypatch):
    """Equal words have equal hashes whatever stands around them, in texts hashed at once and in slices."""
    rng = np.random.default_rng(21)
    texts = ["", " ", "one", " a  b\tA\x0bB\x0cb\r\n", "İ ı ÀÉ àé 日本 \x1c\x85 x", "ab ba aab aba baa a aa aaa", "x" * 3000 + " y " + "z" * 70]
    texts += ["".join(rng.choice(list("abAB \t\né"), int(rng.integers(1, 400)))) for _ in range(300)]
    texts += [r["text"] for r in pd.read_parquet(f"{SMALL}/documents.parquet").to_dict("records")]
    want = [substring.word_hashes(t.encode()).tolist() for t in texts]
    hashes = {}
    for text, got in zip(texts, want):
        words = text.encode().lower().split()
        assert len(got) == len(words) and all(hashes.setdefault(w, h) == h for w, h in zip(words, got))
    assert len(set(hashes.values())) == len(hashes) and substring.word_hashes(None).tolist() == []
    other = claim({"word": 1})  # what an operator that ran in the worker before has kept
    substring.word_hashes(b"a b")
    assert not other
    for size in (1, 7, 64):
        monkeypatch.setattr(substring, "SLICE", size)
        monkeypatch.setattr(substring, "_POWERS", {})
        assert [substring.word_hashes(t.encode()).tolist() for t in texts] == want


def test_repeated_shingles_follow_the_place_before():
    """Spans in texts whose lines repeat, against the same rule applied at every place."""

    def places(x, y):
        first = {v: k for k, v in reversed(list(enumerate(y)))}
        out = []
        for i, v in enumerate(x):
            on = out[-1] + 1 if i and out[-1] is not None else None
            out.append(on if v in first and on is not None and on < len(y) and y[on] == v else first.get(v))
        return out

    rng, s = np.random.default_rng(22), substring.Settings()
    for _ in range(60):
        lines = [rng.integers(1, 1000, int(rng.integers(1, 30))).astype(np.uint64) for _ in range(6)]
        x, y = (np.concatenate([lines[k] for k in rng.integers(0, 6, 12)]) for _ in range(2))
        to = places(x.tolist(), y.tolist())
        for span in substring.matching_passages(x, y, s):
            at = [k for k in to[span["start"] : span["end"] - s.words + 1] if k is not None]
            assert span["source_start"] in at and span["source_end"] - s.words in at and span["similarity"] >= s.similarity


def repeats_of(texts, words=50):
    """For each document, the words inside a run of ``words`` that a document of smaller id has too."""
    split = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    first = {}
    for d in sorted(split):
        for i in range(len(split[d]) - words + 1):
            first.setdefault(tuple(split[d][i : i + words]), d)
    out = defaultdict(set)
    for d, w in split.items():
        for i in range(len(w) - words + 1):
            if first[tuple(w[i : i + words])] < d:
                out[d].update(range(i, i + words))
    return out


def test_every_repeated_run_of_words_is_found(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want, got = repeats_of(texts), defaultdict(set)
    for r in substring.repeated_passages(docs).collect():
        assert r["source"] < r["doc_id"]
        for s in r["spans"]:
            got[r["doc_id"]].update(range(s["start"], s["end"]))
            assert s["similarity"] >= 0.8 and s["end"] - s["start"] >= 50
    missed = sum(len(want[d] - got[d]) for d in want)
    assert missed <= 0.002 * sum(map(len, want.values())) and set(want) <= set(got)
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    after = repeats_of({r["doc_id"]: r["text"] for r in out.collect()})
    assert sum(map(len, after.values())) <= 0.002 * sum(map(len, want.values()))
    clean = {d for d in texts if d not in got}
    assert all(r["text"] == texts[r["doc_id"]] for r in out.collect() if r["doc_id"] in clean)
    assert substring.without_repeats(odd).count() == len(ODD) + 1 and substring.repeated_passages(odd.limit(0)).count() == 0


def test_near_copies_of_a_passage(spark):
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage = word(120)
    edited = [*passage[:40], "edit", *passage[41:90], *passage[91:]]
    rows = [(1, " ".join(word(80) + passage + word(60))), (2, " ".join(word(30) + edited + word(90))), (3, " ".join(word(400)))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["source"]) for r in got] == [(2, 1)] and sum(s["end"] - s["start"] for s in got[0]["spans"]) >= 110


def test_passages_of_lines_that_earlier_documents_have(spark):
    rng = np.random.default_rng(23)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    texts, later, at = {}, {}, 0
    for k in range(40):
        size = (10, 15, 20, 30)[k % 4]
        lines = [word(size) for _ in range(60 // size)]
        for line in lines:
            texts[at] = word(60) + line + word(60)
            at += 1
        texts[at], texts[at + 1] = word(70) + sum(lines, []) + word(70), word(50) + sum(lines, []) + word(90)
        later[at + 1] = at
        at += 2
    found = substring.repeated_passages(spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["source"] for r in found} == later
    assert all(min(s["start"] for s in r["spans"]) <= 50 and max(s["end"] for s in r["spans"]) >= 110 for r in found)


def test_columns_of_any_name_pass_through(spark):
    rng = np.random.default_rng(51)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = word(70)
    rows = [(i, " ".join(word(30) + shared + word(30)), f"v{i}", i, "d", "s") for i in range(4)] + [(None, None, "n", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, source long, _digest string, _spans string")
    assert {(r["doc_id"], r["source"]) for r in substring.repeated_passages(df).collect()} >= {(1, 0), (2, 0), (3, 0)}
    out = substring.without_repeats(df)
    assert out.columns == df.columns and sorted((r["_id"], r["source"], r["_digest"], r["_spans"]) for r in out.collect() if r["doc_id"] is not None) == [(f"v{i}", i, "d", "s") for i in range(4)]
    assert sorted(len((r["text"] or "").split()) for r in out.collect()) == [0, 60, 60, 60, 130]
    assert similar.near_duplicates(df).count() == 4


def test_places_far_into_a_text_are_in_order():
    n = (1 << 24) + 300
    values = substring.mixed(np.arange(1, n + 1, dtype=np.uint64))
    values[n - 150] = 0
    c, left, right = substring.compact_windows(values, 46)
    assert (np.diff(c) > 0).all() and (left <= c).all() and (c <= right).all() and (right - left >= 45).all()
    at = np.flatnonzero(c == n - 150)
    assert len(at) == 1 and (left[at[0]], right[at[0]]) == (0, n - 1)


def test_edited_passages_of_lines_that_earlier_documents_have(spark):
    rng = np.random.default_rng(61)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    texts, later, at = {}, {}, 0
    for _ in range(60):
        lines = [word(20) for _ in range(5)]
        for line in lines:
            for _ in range(2):
                texts[at] = word(40) + line + word(40)
                at += 1
        passage = sum(lines, [])
        edited = list(passage)
        edited[int(rng.integers(30, 70))] = "edit"
        texts[at], texts[at + 1] = word(70) + passage + word(70), word(50) + edited + word(90)
        later[at + 1] = at
        at += 2
    found = substring.repeated_passages(spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["source"] for r in found} == later


def test_a_source_of_many_documents_is_joined_in_groups(spark, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", 7)
    rng = np.random.default_rng(62)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    shared = word(60)
    rows = [(i, " ".join(word(20) + shared + word(20))) for i in range(60)]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source"]) for r in found} >= {(i, 0) for i in range(1, 60)} and len(found) == len({(r["doc_id"], r["source"]) for r in found})


def test_cut_keeps_what_is_around():
    assert substring.cut(b"a b  c\nd e", [(1, 3)]) == b"a \nd e" and substring.cut(b"a b", [(0, 2)]) == b"" and substring.cut(b" a b c ", [(1, 2), (0, 1)]) == b"   c "


# 10


def test_token_counts_equal_the_library(spark, odd, docs):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        whole = WholeText(path).whole
        for df in (odd, docs):
            got = token_counts.count_tokens(df, path).collect()
            assert len(got) == df.count()
            for r in got:
                n = len(whole(r["text"] or ""))
                assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 2048)
    assert token_counts.count_tokens(odd.limit(0), default_path()).count() == 0


SCRIPTS = ["it’s “quoted” — naïve… 3.5€", "<|startoftext|><|endoftext|>x <|EndOfText|>", "é z", "Ω ß ẞ ΑΣ σ", "مرحبا بالعالم", "नमस्ते दुनिया", "\ufeffbom \u2003wide", "🇩🇪👨‍👩‍👧 x", "日本語のテキスト", "don't DON'T l'été 12½"]


def test_latin_words_split_as_the_tokenizer_file_says(monkeypatch):
    whole = WholeText(default_path())
    rng = np.random.default_rng(12)
    letters = [chr(c) for c in [*range(33, 127), *range(161, 256)]]
    words = letters + [x + y for x in "a1.'é" for y in letters] + [y + x for x in "a1.'é" for y in letters]
    words += ["".join(rng.choice(letters + list("'stredvml") * 6, int(rng.integers(2, 14)))) for _ in range(20_000)]
    words += ["it's", "don't''s", "we're've'll'd'm", "a\x01b", "\x7f", "a\x85", "日本x", "é́"]
    want = [[part for part, _ in whole.tokenizer.pre_tokenizer.pre_tokenize_str(w)] for w in words]
    assert [whole.pre_tokens(w) for w in words] == want
    for text in (" ".join(words[k : k + 50]) for k in range(0, len(words), 50)):
        assert whole.ids(text).tolist() == whole.whole(text)
    monkeypatch.setattr(whole, "tokenizer", None)
    assert [whole.pre_tokens(w) for w in words[:5000]] == want[:5000]  # without a call to the library for each


def test_frequencies_and_pieces_per_pre_token_add_up_in_any_script():
    whole = WholeText(default_path())
    texts = [*SCRIPTS, "the the the cat, the", "", "word " * 700, *SCRIPTS]
    tokens, bounds, docs, times = token_counts.frequencies(texts, whole.split, whole.pre_tokens)
    got = defaultdict(int)
    for k, token in enumerate(tokens):
        for i in range(bounds[k], bounds[k + 1]):
            got[int(docs[i]), token] += int(times[i])
    want = defaultdict(int)
    for d, text in enumerate(texts):
        for w in whole.split(text):
            for t in whole.pre_tokens(w):
                want[d, t] += 1
    assert got == want and times.max() <= 255 and times.min() >= 1
    pieces_of = {t: len(whole.piece_ids(t)) for t in tokens}
    for d, text in enumerate(texts):
        assert sum(n * pieces_of[t] for (doc, t), n in got.items() if doc == d) == len(whole.whole(text)) and whole.ids(text).tolist() == whole.whole(text)


def test_token_counts_come_through_the_join(spark):
    """Texts that repeat, in blocks of few texts; the plan joins frequencies with the pieces of distinct pre-tokens."""
    rows = [(i, t) for i, t in enumerate([*SCRIPTS, *SCRIPTS, "x " * 3000, None])]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens_ string").withColumnRenamed("n_tokens_", "text").withColumns({"N_Tokens": F.lit("old"), "_digest": F.lit("kept"), "_own": F.lit(1)})
    out = token_counts.count_tokens(df, default_path(), limit=100)
    assert out.columns == ["doc_id", "text", "_digest", "_own", "n_bytes", "n_tokens", "over_limit"]
    whole = WholeText(default_path()).whole
    for r in out.collect():
        n = len(whole(r["text"] or ""))
        assert (r["n_tokens"], r["over_limit"], r["_digest"], r["_own"]) == (n, n > 100, "kept", 1)
    texts = df.filter("text IS NOT NULL").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")
    blocks = token_counts._blocks(texts, default_path(), 7, most_texts=3).collect()
    lists = [r for r in blocks if r["tokens"] is None]
    assert len({r["block"] for r in blocks}) == len(lists) >= 4 and all(len(r["packed"]) <= 3 * 16 for r in lists)
    home = {}  # each pre-token has one bucket, where it is counted for all blocks
    for r in blocks:
        for t in (r["tokens"] or "").split("\n") if r["tokens"] else ():
            assert home.setdefault(t, r["bucket"]) == r["bucket"]
    assert len(set(home.values())) == 7


def test_words_are_kept_within_a_bound():
    small = WholeText(default_path(), limit=10)
    texts = [f"tree{i} {'x' * i} house" for i in range(60)]
    assert [small.ids(t).tolist() for t in texts] == [small.whole(t) for t in texts] and len(small.words) <= 14


# pipeline


def test_rows_that_repeat_or_lack_an_id_take_part(spark):
    rng = np.random.default_rng(24)
    a, b, c = ([f"w{x}" for x in rng.integers(0, 10**6, 100)] for _ in range(3))
    near = lambda t: " ".join(["new", *t[1:]])
    a, b, c, a2, b2, c2 = *map(" ".join, (a, b, c)), *map(near, (a, b, c))
    rows = [(1, a), (1, b), (1, a), (2, b2), (None, a2), (None, c), (None, c2), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()]
    third = [t for t in (c, c2) if (None, t) in got]
    assert len(third) == 1 and sorted(got, key=repr) == sorted([(1, a), (1, b), (None, third[0]), (None, None)], key=repr)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash near-dedup", "substring dedup", "best-fit packing"]
    extra = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema)
    now = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMALL)
        assert after.columns == docs.columns, name
        now = spark.createDataFrame(after.collect(), docs.schema)
    left = {r["doc_id"]: r["text"] for r in now.collect()}
    assert None in left and len(left) == now.count()
    prints = defaultdict(list)
    for r in similar.near_duplicates(docs.join(now.select("doc_id"), "doc_id", "left_semi")).collect():
        prints[r["component_id"]].append(r["doc_id"])
    assert all(len(v) == 1 for v in prints.values())
    out = corpus_pipeline.run(spark, SMALL)
    texts = pd.DataFrame([r.asDict() for r in out.collect()])
    assert set(texts["doc_id"]) <= {r["doc_id"] for r in docs.collect()} and texts.groupby("sequence_id")["length"].sum().max() <= 4096


def test_pipeline_equals_slow_stages(spark):
    """Each stage of the pipeline on whole rows against a slow version of its own."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    # toxicity: the model's weights summed over each text
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    learned = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    rows = spark.createDataFrame([(texts[d], y) for d, y in learned.items() if d in texts], "text string, label int")
    model = toxicity.train(rows)
    weights = dict(zip(model.index.tolist(), model.weight.tolist()))
    score = {d: model.bias + sum(weights.get(i, 0.0) for i in set(toxicity.coordinates(t, model.bits).tolist())) for d, t in texts.items()}
    clean = stages["toxicity"](spark, docs, SMALL)
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert kept == {d: t for d, t in texts.items() if 1 / (1 + math.exp(-score[d])) < 0.7} and 0 < len(kept) < len(texts)

    # near-duplicates: the least id of each component of all pairs
    sets = {d: frozenset(substring.shingles((t or "").encode(), 5).tolist()) for d, t in kept.items()}
    prints = {d: slow_simhash(t) for d, t in kept.items()}
    alike = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = slow_components([p for p in combinations(sorted(kept), 2) if alike(*p)], kept)
    clean = spark.createDataFrame(clean.collect(), docs.schema)
    single = stages["simhash near-dedup"](spark, clean, SMALL)
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert left == {d: t for d, t in kept.items() if root[d] == d} and len(left) < len(kept)

    # repeated passages: gone where a smaller id has them, all else as it was
    repeated = repeats_of(left)
    single = spark.createDataFrame(single.collect(), docs.schema)
    cut = stages["substring dedup"](spark, single, SMALL)
    now = {r["doc_id"]: r["text"] for r in cut.collect()}
    near = {r["doc_id"] for r in substring.repeated_passages(single).collect()}  # edited passages go too
    assert set(now) == set(left) and not repeats_of(now) and set(repeated) <= near
    for d, t in left.items():
        words = (t or "").encode().lower().split()
        rest = [w for i, w in enumerate(words) if i not in repeated.get(d, ())]
        got = (now[d] or "").encode().lower().split()
        assert len(got) <= len(rest) and (now[d] == t if d not in near else len(got) < len(words))

    # packing: every token of every text once, in full sequences
    cut = spark.createDataFrame(cut.collect(), docs.schema)
    used, least = packed_well([r.asDict() for r in stages["best-fit packing"](spark, cut, SMALL).collect()], now)
    assert used <= least + max(2, least // 50)
