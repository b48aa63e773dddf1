"""Vector search against brute force, archives byte by byte, and the pipeline against its stages by hand."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import json
import random
import re
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text import lines_by_hand
from tickloom.llm import hnsw, queries, shingles, simhash, warc
from tickloom.llm.components import components

# --- vectors


def test_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    vectors, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = queries.QUERIES["op1_nearest_vectors"](spark, folder).toPandas()
    good = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = [(-float(s), int(v)) for s, v in zip(unit @ unit[q], ids, strict=True) if v != ids[q]]
        wanted = {v for _, v in sorted(near)[:5]}
        own = found[found["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(own["score"]) <= 0).all()
        good, total = good + len(wanted & set(own["vec_id"])), total + 5
    assert good / total >= 0.9


def test_several_shards_and_ties(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 340)]
    rows += [(300, rows[-1][1]), (400, None), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (404, [1.0, 2.0]), (405, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"vec": F.lit(1), "shard": F.lit(2), "members": F.lit(3)})
    index = hnsw.build_index(df, shard_bytes=64 * 48)
    assert index.count() > 3
    found = hnsw.nearest(df.filter("vec_id IN (300, 339, 400, 401, 402, 403, 404, 405)"), index)
    got = {q: [r["vec_id"] for r in found.filter(F.col("query_id") == q).orderBy("rank").collect()] for q in (300, 339, 400, 401, 402, 403, 404, 405)}
    assert got[300] == [301, 302, 303, 304, 305] and got[339] == [300, 301, 302, 303, 304]
    assert not any(got[q] for q in (400, 401, 402, 403, 404, 405))
    both = lambda asked: sorted(map(tuple, hnsw.nearest(df.filter("vec_id % 3 = 0"), index, query_bytes=asked).collect()))
    assert both(48 * 16) == both(1 << 20)  # seven blocks of queries, or one
    none = df.limit(0)
    assert hnsw.nearest(df,hnsw.build_index(none)).count() == 0 and hnsw.nearest(none, index).count() == 0


@pytest.mark.parametrize("dims", [32, 96])
def test_recall_without_clusters(dims):
    rng = np.random.default_rng(dims)
    unit = hnsw._unit(rng.normal(size=(4000, dims)))
    others = hnsw._unit(rng.normal(size=(100, dims)))
    graph = hnsw.Graph.build(unit)
    assert all(len(set(row[row >= 0].tolist())) == (row >= 0).sum() for row in graph.layers[0])
    for asked, least in ((unit[:100], 0.95), (others, 0.9)):
        wanted = np.argsort(-(asked @ unit.T), 1)[:, :5]
        found = graph.search(asked, 5)
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.tolist(), wanted.tolist(), strict=True)]) >= least
    again = hnsw.Graph.from_bytes(graph.to_bytes(), unit)
    assert (again.search(others, 5) == graph.search(others, 5)).all()


def test_repeated_ids_and_extreme_sizes(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1e200, 1e200]), (100, [1e-200, 3e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = hnsw.nearest(df.filter("vec_id % 50 = 0"), hnsw.build_index(df), k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(50, 1, 1), (50, 1, 2), (50, 2, 3), (50, 2, 100), (100, 1, 2), (100, 2, 50)]
    score = {(r["query_id"], r["vec_id"]): r["score"] for r in found}
    assert abs(score[50, 3] - 0.5**0.5) < 1e-12 and abs(score[100, 2] - 3.1 / (10 * 1.01) ** 0.5) < 1e-12


# --- archives


def test_archives_of_odd_pages(spark):
    long, other = "ü" * 600, "z" * 1000
    rows = [(1, "http://a", None), (2, None, ""), (3, "u\r\nv", "short"), (4, "b", "short"), (5, "c", long), (6, "d", long), (6, "d", long), (7, "e", other), (None, "f", other), (None, "g", "q" * 2000), (8, "h", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "size": F.lit(2), "payload": F.lit(3)})
    manifest = warc.write_archives(warc.classify(pages), warc.archive_folder(spark), archive_bytes=300)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(manifest).collect()
    assert sorted(((r["page_id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(
        ((i or 0), len(data := (html or "").encode()), hashlib.sha1(data).hexdigest(), kind, to)
        for (i, _, html), (kind, to) in zip(rows, [("response", None)] * 4 + [("revisit", 6)] + [("response", None)] * 3 + [("revisit", 7)] + [("response", None)] * 2, strict=True)
    )
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    none = warc.write_archives(warc.classify(pages.limit(0)), warc.archive_folder(spark))
    assert warc.read_archives(none).count() == 0


def _zip64(data: bytes) -> bytes:
    """A stored member whose sizes and offset stand in ZIP64 fields only."""
    name = b"archive/data.warc.gz"
    local = struct.pack("<4sHHHHHIIIHH", warc.LOCAL, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<HHHH", 0x7777, 4, 1, 2) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", warc.CENTRAL, 45, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, len(name), len(extra), 3, 0, 0, 0, warc.FULL32) + name + extra + b"abc"
    at = len(local)
    end64 = struct.pack("<4sQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", warc.LOCATOR64, 0, at + len(central), 1)
    return local + central + end64 + locator + struct.pack("<4sHHHHIIH", warc.END, 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 4) + b"note"


def test_zip64_directory():
    raw = _zip64(b"0123456789")
    package = warc.ZipPackage(io.BytesIO(raw), len(raw))
    assert package.read(warc.DATA) == b"0123456789" and list(package.ranges(warc.DATA, [(2, 3), (9, 1)])) == [b"234", b"9"]
    with pytest.raises(ValueError):
        list(package.ranges(warc.DATA, [(8, 5)]))


def test_ordinary_zip_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("packed", b"x" * 99, zipfile.ZIP_DEFLATED)
        z.writestr("stored", b"y" * 99, zipfile.ZIP_STORED)
    raw = out.getvalue()
    package = warc.ZipPackage(io.BytesIO(raw), len(raw))
    assert package.read("stored") == b"y" * 99 and package.read("packed") == b"x" * 99
    with pytest.raises(ValueError):
        list(package.ranges("packed", [(0, 1)]))
    for bad in (b"", b"no archive", raw[:-30]):
        with pytest.raises(ValueError):
            warc.ZipPackage(io.BytesIO(bad), len(bad))


def test_package_made_elsewhere(spark, tmp_path):
    """Several members, a gzipped and a deflated index, offsets as text, records of other kinds and plain records."""

    def made(kind, uri, block, http=True):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID:<urn:uuid:{uri}>\r\nWARC-Target-URI: {uri}\r\nContent-Type: {'application/http' if http else 'text/plain'}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    one = [gzip.compress(made("warcinfo", "i", b"software: x", False)), gzip.compress(made("response", "a", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"))]
    two = [made("resource", "b", b"body\r\n\r\nmore", False)]
    line = lambda file, offset, data: f"com,x)/ 20240102030405 {json.dumps({'filename': file, 'offset': str(offset), 'length': str(len(data))})}\n"
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("archive/one.warc.gz", b"".join(one))
        z.writestr("archive/two.warc", b"".join(two))
        z.writestr("indexes/index.cdx.gz", gzip.compress((line("one.warc.gz", 0, one[0]) + line("one.warc.gz", len(one[0]), one[1])).encode()))
        z.writestr("indexes/more.cdxj", "!meta\n" + line("two.warc", 0, two[0]) * 2, zipfile.ZIP_DEFLATED)
        z.writestr("pages/pages.jsonl", "{}")
    found = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "path string")).collect()
    assert sorted((r["url"], r["record_type"], bytes(r["payload"]), r["page_id"]) for r in found) == [("a", "response", b"hello", None), ("b", "resource", b"body\r\n\r\nmore", None), ("i", "warcinfo", b"software: x", None)]


def test_long_and_equal_pages(spark):
    rows = [(i, "u", "same" * 500) for i in range(300)] + [(1000, "long", "x\n" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(warc.classify(pages), warc.archive_folder(spark), archive_bytes=5000)).collect()
    assert len(got) == 301 and {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {299} and sum(r["record_type"] == "response" for r in got) == 2
    assert max(r["payload_bytes"] for r in got) == 4_000_000


# --- components


def test_components_by_hand(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(60)] + [(7, 7), (8, 9), (9, 8)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}


# --- pipeline


def test_pipeline_by_hand(spark, tables):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    junk = spark.createDataFrame([(90001, "123 456 !!", None, "s", 10), (90002, None, None, "s", 0), (90003, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    given = docs.unionByName(junk)
    now, sizes = given, []
    kept = {r["doc_id"]: r["text"] for r in given.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = dict(kept)
        now = stage(spark, now, tables).cache()
        if name != "sentencepiece":
            assert now.columns == docs.columns
            kept = {r["doc_id"]: r["text"] for r in now.collect()}
        sizes.append(now.count())
        if name == "language_id":
            assert set(before) - set(kept) == {90001, 90002, 90003}
        elif name == "line_dedup":
            ids = sorted(before)
            wanted = dict(zip(ids, lines_by_hand([before[i] for i in ids], 10, "first"), strict=True))
            assert kept == {i: t for i, t in wanted.items() if t.strip(" \t\n\x0b\x0c\r")}
        elif name == "near_dedup":
            assert set(kept) == alike_by_hand(before)
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
            assert not any(item in t for item in items for t in kept.values()) and len(kept) > 0.8 * len(before)
        else:
            assert all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in now.collect())
    assert sizes == sorted(sizes, reverse=True)


def alike_by_hand(texts):
    """The least id of each group of texts that share 0.8 of their five-word shingles."""

    def own(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: own(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if not a | b or len(a & b) >= 0.8 * len(a | b):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {find(i) for i in sets}


@pytest.mark.parametrize("tile", [shingles.TILE, 3])
def test_near_dedup_keeps_the_rule_of_four_fifths(spark, tables, monkeypatch, tile):
    monkeypatch.setattr(shingles, "TILE", tile)
    monkeypatch.setattr(simhash, "TILE", max(4, tile))
    rng = random.Random(13)
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    for k in range(12):  # copies on both sides of 0.8
        copy = [*base, *[f"x{i}" for i in range(30)]] if k == 11 else [f"y{i}" if k and i % 60 < k and i % 2 else w for i, w in enumerate(base)]
        given[70000 + k] = " ".join(copy)
    for n in (6, 9, 14, 17, 20, 21, 24, 28, 40):  # short texts with a word more or another last word
        words = [f"s{n}x{i}" for i in range(n)]
        given |= {71000 + n: " ".join(words), 72000 + n: " ".join([*words, "more"]), 73000 + n: " ".join([*words[:-1], "other"]), 74000 + n: " ".join([*words[:-1], *"four more of them".split()])}
    for k in range(60):  # a chain of edits: ends far apart, neighbours alike
        base[k * 3] = f"z{k}"
        given[75000 + k] = " ".join(base)
    given |= {80001: None, 80002: " ", 80003: "Ab c", 80004: "aB C", 80005: base[0]}
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in given.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, tables).collect()]
    assert sorted(found) == sorted(alike_by_hand(given))


def test_near_dedup_of_odd_rows(spark, tables):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (4, "other text with some words in it"), (None, "alone in the world of texts"), (None, "alone in the world of texts")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("row", "_row", "_stays", "_text", "part", "n", "set_key", "root")})
    found = shingles.one_of_each(df)
    assert found.columns == df.columns and sorted((r["doc_id"] or 0, r["text"][:5]) for r in found.collect()) == [(0, "alone"), (4, "a b c"), (4, "other")]
    assert shingles.one_of_each(df.limit(0)).count() == 0


def test_no_language_to_learn_drops_no_text(spark, tables):
    rows = [(1, "Plain words", None, "s", 11), (2, "\u6f22\u5b57", None, "s", 2), (3, "123 !", None, "s", 5), (4, "", None, "s", 0), (5, None, None, "s", 0), (None, "more", None, "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.language_id(spark, df, tables)
    assert found.columns == df.columns and {r["doc_id"] for r in found.collect()} == {1, 2, None}
