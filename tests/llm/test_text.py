"""Edge cases and brute-force versions of the operators on texts."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.helpers import by_sql, rows_of
from tickloom.llm import common, decontaminate, language, licenses, line_dedup, lm_score, queries, sentencepiece, simhash, toxicity
from tickloom.llm.common import held_out

TEXTS = [
    None, "", " ", "\n", "\n\n a \n", "A b C", "a b c", "a b c", "mit license", "x" * 200_000, "é É ß ﬁ 漢字 😀", "MIT  License mit\nlicense apache-license", "▁ a▁ b ▁▁",
    "one two three four five six seven\r\neight\tnine\x0bten", "0 1 2", "K K k",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i, t, "en" if t else None, "s", len(t or "")) for i, t in enumerate(texts)]
    if extra:
        rows += [(None, "a b c", "en", "s", 5), (5, "A b C", "en", "s", 5)]  # a null id, a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Columns under the names that operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("pos", "line", "h1", "id", "fp", "chunk", "word", "gram", "table", "node", "_id", "_text", "_ld_drop", "_ld_all", "_ld_id", "_all", "_drop", "_kept", "_sh_id", "_sh_none", "_row", "_dc_part", "_part", "_label", "place")})


# --- line dedup


def lines_by_hand(texts, min_docs, keep="none"):
    split = [(t or "").split("\n") for t in texts]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter(k for ls in split for k in {key(x) for x in ls} if k)
    out, first = [], set()
    for ls in split:
        kept = []
        for x in ls:
            k = key(x)
            if k and seen[k] >= min_docs and (keep == "none" or k in first):
                continue
            first.add(k)
            kept.append(x)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
def test_lines_by_hand(spark, keep):
    rng = random.Random(4)
    texts = [None, "", "\n"] + ["\n".join(rng.choice([" Foo", "foo ", "bar", "", "uniq%d" % rng.randrange(99), "BAR\r", "K"]) for _ in range(rng.randrange(150))) for _ in range(40)]
    df = clashing(docs(spark, texts, extra=False))
    found = line_dedup.dedup_lines(df, min_docs=3, keep=keep)
    assert found.columns == df.columns
    assert [r["text"] for r in found.orderBy("doc_id").collect()] == lines_by_hand(texts, 3, keep)


def test_lines_of_odd_rows(spark):
    df = docs(spark)
    assert line_dedup.dedup_lines(df, min_docs=2).count() == df.count()
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(df, keep="some")


def test_lines_of_a_repeated_id(spark):
    """A document is an id with a text: twelve texts under one id are twelve documents, twelve equal rows are one."""
    df = spark.createDataFrame([(1, f"same\nown {i}") for i in range(12)] + [(2, "again\nx")] * 12, "doc_id long, text string")
    found = [r["text"] for r in line_dedup.dedup_lines(df).orderBy("doc_id", "text").collect()]
    assert found == sorted(f"own {i}" for i in range(12)) + ["again\nx"] * 12


@pytest.mark.parametrize("light", [0, 1 << 20])
def test_lines_with_and_without_broadcast(spark, monkeypatch, light):
    monkeypatch.setattr(common, "LIGHT", light)
    texts = [None, "", *[f"Common \n{i % 7}\n\nunique {i}" for i in range(60)]]
    found = line_dedup.dedup_lines(docs(spark, texts, extra=False), keep="first")
    assert [r["text"] for r in found.orderBy("doc_id").collect()] == lines_by_hand(texts, 10, "first")


def test_bitmaps_of_a_long_document(spark):
    text = "\n".join("again" if i % 3 == 0 else f"line {i}" for i in range(2000))
    df = docs(spark, [text, "again", "again\nb"], extra=False)
    assert line_dedup.dedup_lines(df, min_docs=3).orderBy("doc_id").first()["text"] == "\n".join(f"line {i}" for i in range(2000) if i % 3)


# --- licenses


def test_license_counts_by_hand(spark):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [*TEXTS, "the apache license mit license general public license general public", "mit mit license license, MIT-LICENSE", "licensed under the apache license version 2 0 apache license"]
    found = licenses.scan_licenses(clashing(docs(spark, texts))).collect()
    for row in found:
        words = pattern.findall((row["text"] or "").translate(upper))
        places = sorted({i for p in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()})
        labels = sorted({lab for p, lab in licenses.BASE_PHRASES.items() if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))})
        got = row["license"]
        assert (got["n_words"], got["n_base"], got["base_labels"]) == (len(words), len(places), ",".join(labels))
        assert (got["first_word"], got["last_word"]) == ((places[0], places[-1]) if places else (None, None))
        assert 0 <= got["score"] <= 1 and set(labels) <= set(got["labels"].split(","))
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_matching_statistics_by_hand():
    words = [w.encode() for w in "a b c d a b e a b c".split()]
    templates = [("x", [w.encode() for w in t.split()]) for t in ("a b c", "c d a b", "b e")]
    automaton = licenses.SuffixAutomaton(templates)
    passages = {tuple(t[i:j]) for _, t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    longest = [max(n for n in range(i + 2) if n == 0 or tuple(words[i - n + 1 : i + 1]) in passages) for i in range(len(words))]
    ends = [i for i in range(len(words)) if longest[i] and (i + 1 == len(words) or longest[i + 1] <= longest[i])]
    assert [(e, n) for e, n, _ in automaton.maximal_matches(words, 1)] == [(i, longest[i]) for i in ends]


def test_edited_license_text_is_a_span():
    text = "x y Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files. z"
    got = licenses.Scanner().scan(text)
    assert "mit" in got[5].split(",") and got[7][0][1] == 2


@pytest.mark.parametrize("text,label", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("It is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("It is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
])
def test_licenses_that_differ_in_a_word_are_told_apart(text, label):
    got = licenses.Scanner().scan(text)
    assert got[5] == label and got[6] == 1.0


def test_each_template_has_its_own_label():
    scanner = licenses.Scanner()
    for label, passages in licenses.TEMPLATES.items():
        for passage in passages:
            labels = scanner.scan(f"before {passage} after")[5].split(",")
            base = {b for p, b in licenses.BASE_PHRASES.items() if p in passage}
            assert label in labels and set(labels) <= {label} | base, passage


def test_places_are_those_of_a_search():
    rng = random.Random(3)
    for _ in range(40):
        templates = [(str(k), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 9))]) for k in range(4)]
        automaton = licenses.SuffixAutomaton(templates)
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        for end, n, state in automaton.maximal_matches(words, 1):
            passage = words[end - n + 1 : end + 1]
            want = [(t, i) for t, (_, ws) in enumerate(templates) for i in range(len(ws) - n + 1) if ws[i : i + n] == passage]
            assert sorted(automaton.places(state, n)) == want


def test_chains_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        hits = []
        for _ in range(rng.randrange(1, 9)):
            n = rng.randrange(1, 5)
            hits.append((n + rng.randrange(14), n + rng.randrange(8), n))
        hits = sorted(set(hits))
        ways = []
        for chosen in itertools.chain.from_iterable(itertools.combinations(hits, k) for k in range(1, len(hits) + 1)):
            covered = chosen[0][2]
            for (end, at, _), (end_2, at_2, n) in itertools.pairwise(chosen):
                if end_2 <= end or at_2 <= at or end_2 - n - end > 2:
                    break
                covered += min(n, end_2 - end, at_2 - at)
            else:
                ways.append((covered, chosen[0][0] - chosen[0][2], chosen[-1]))
        best = licenses.best_chains(hits, 2)
        assert best == [max(w[:2] for w in ways if w[2] == h) for h in hits]
        found = licenses.chains(hits, 2)
        assert max(c for _, _, c in found) == max(w[0] for w in ways)
        covered = sorted((first, end) for first, end, _ in found)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(covered))
        assert all(any(first < end and end - n < last for first, last in covered) for end, _, n in hits)


@pytest.mark.parametrize("repeat", ["front", "moved", "between"])
def test_repeated_and_moved_words_do_not_end_a_chain(repeat):
    label, passage = "mpl", licenses.TEMPLATES["mpl"][1].split()
    other = licenses.TEMPLATES["mit"][1].split()
    half = len(passage) // 2
    middle = {"front": passage[:4], "moved": passage[-4:], "between": other[:5]}[repeat]
    got = licenses.Scanner().scan(" ".join([*passage[:half], *middle, *passage[half:]]))
    assert label in got[5].split(",") and got[6] >= 0.9


def test_many_copies_of_a_template_are_spans_of_their_own():
    passage = licenses.TEMPLATES["mit"][1]
    started = time.monotonic()
    got = licenses.Scanner().scan(" ".join([passage] * 5_000))
    n = len(passage.split())
    assert [(s[1], s[2]) for s in got[7]] == [(k * n, k * n + n - 1) for k in range(5_000)] and time.monotonic() - started < 30


def test_stronger_spans_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        spans = []
        for _ in range(rng.randrange(9)):
            first = rng.randrange(12)
            spans.append((rng.choice("abc"), first, first + rng.randrange(8), rng.choice([0.5, 0.7, 1.0]), rng.randrange(3, 6)))
        spans.sort(key=lambda s: (s[1], s[2], s[0]))
        own = [set(range(s[1], s[2] + 1)) for s in spans]
        kept = [
            s for i, s in enumerate(spans)
            if not any(t[0] != s[0] and 2 * len(own[i] & own[k]) > len(own[i]) and t[3] >= s[3] and t[4] >= s[4] and (t[3] > s[3] or t[4] > s[4]) for k, t in enumerate(spans))
        ]
        assert licenses.strongest(spans) == kept


# --- language models


def scores_by_hand(texts, order, alpha):
    upper = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    split = [(t or "").encode().translate(upper).split() for t in texts]
    own = [Counter(tuple(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1)) for ws in split]
    every = sum(own, Counter())
    total = sum(map(len, split))
    out = []
    for ws, mine in zip(split, own, strict=True):
        s = 0.0
        for i in range(len(ws)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                g = tuple(ws[i - n + 1 : i + 1])
                c = every[g] - mine[g]
                if c > 0:
                    below = every[g[:-1]] - mine[g[:-1]] if n > 1 else total - len(ws)
                    s += math.log(alpha ** (most - n) * c / below)
                    break
            else:
                s += math.log(alpha**most / (total - len(ws) + 1))
        out.append((len(ws), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_by_hand(spark, order):
    rng = random.Random(order)
    texts = [*TEXTS, *[" ".join(rng.choice("a b c d e".split()) for _ in range(rng.randrange(60))) for _ in range(40)]]
    found = lm_score.backoff_scores(clashing(docs(spark, texts, extra=False)), order=order, chunk_bytes=400).orderBy("doc_id").collect()
    for row, (n, s) in zip(found, scores_by_hand(texts, order, 0.4), strict=True):
        assert row["n_words"] == n and math.isclose(row["log_sum"], s, rel_tol=1e-9, abs_tol=1e-9)
        assert (row["log_mean"] is None) == (n == 0)
    assert lm_score.backoff_scores(docs(spark)).count() == len(TEXTS) + 2
    assert lm_score.backoff_scores(empty(spark)).count() == 0


def test_backoff_of_long_and_equal_rows(spark):
    texts = ["same words here"] * 50 + ["again " * 40_000 + "end", None]
    found = lm_score.backoff_scores(docs(spark, texts, extra=False), chunk_bytes=2000).orderBy("doc_id").collect()
    for row, (n, s) in zip(found, scores_by_hand(texts, 3, 0.4), strict=True):
        assert row["n_words"] == n and math.isclose(row["log_sum"], s, rel_tol=1e-9, abs_tol=1e-9)
    repeated = docs(spark, texts[:1], extra=False)
    assert lm_score.backoff_scores(repeated.union(repeated)).distinct().count() == 1


def test_packing():
    for x in ([], [0], [1, 0, 300, 2**40], [0] * 9 + [5]):
        a = np.array(x, np.uint64)
        assert lm_score.unpack(lm_score.pack(a)).tolist() == x and lm_score.unpack_sparse(lm_score.pack_sparse(a)).tolist() == x


@pytest.mark.parametrize("name", ["op3_lm_score", "op4_line_dedup", "op8_warc_packages"])
def test_queries_against_sql(spark, tables, name):
    assert rows_of(queries.QUERIES[name](spark, tables).toPandas()) == rows_of(by_sql(queries.SQL[name], tables))


# --- SimHash


def components_by_hand(prints, ids, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    best = {}
    for i, x in enumerate(ids):
        r = find(i)
        best[r] = min(best.get(r, x), x)
    return [best[find(i)] for i in range(len(ids))]


def print_by_hand(text, size=3):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(upper))
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_by_hand(spark):
    rng = random.Random(8)
    texts = list(TEXTS)
    for _ in range(25):
        words = [rng.choice("the of and to in a is that it was %d" % rng.randrange(9999)) for _ in range(rng.randrange(1, 80))]
        texts += [" ".join(words), " ".join([*words[:-1], "edit"]), " ".join(words).upper()]
    found = simhash.near_duplicates(clashing(docs(spark, texts, extra=False))).orderBy("doc_id").collect()
    wanted = [print_by_hand(t) for t in texts]
    assert [r["fingerprint"] % 2**64 for r in found] == wanted
    assert [r["component_id"] for r in found] == components_by_hand(wanted, list(range(len(texts))), 3)


@pytest.mark.parametrize("small", [2, 64])
def test_links_of_a_dense_group(spark, monkeypatch, small):
    """Many prints around one, dealt out as tiles: no link may get lost."""
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "SMALL_UNIT", small)
    rng = random.Random(3)
    near = {sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(near)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.linked_fingerprints(df).collect()]
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    wanted = components_by_hand(prints, prints, 3)
    groups = lambda labels: sorted(sorted(p for p, x in zip(prints, labels, strict=True) if x == r) for r in set(labels))
    assert groups([find(p) for p in prints]) == groups(wanted)


def test_simhash_of_odd_rows(spark):
    df = docs(spark)
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert (None, 5) in found and (5, 5) in found and (6, 5) in found
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(clashing(df))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == clashing(df).columns and None not in ids and ids.count(5) == 1 and 6 not in ids
    nameless = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.near_duplicates(nameless).filter("component_id IS NOT NULL").count() == 0
    assert simhash.one_of_each(nameless).count() == simhash.one_of_each(docs(spark, extra=False)).count()


# --- SentencePiece


@pytest.fixture(scope="module")
def model():
    return sentencepiece.PieceModel(sentencepiece.read_pieces())


def test_pieces_round_trip(spark, model):
    df = clashing(docs(spark))
    back = sentencepiece.decode_documents(sentencepiece.encode_documents(df)).collect()
    assert all(r["decoded"] == r["text"] for r in back)
    assert [r["pieces"] for r in back if r["text"] is None] == [None] and [r["pieces"] for r in back if r["text"] == ""] == [[]]
    assert sentencepiece.encode_documents(empty(spark)).count() == 0
    with open("/root/testdata/sf0.001/documents.parquet", "rb"):
        for t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).toPandas()["text"]:
            assert model.decode(model.encode(t)) == t


def test_best_paths_by_hand(model):
    """The score of the path against a search over all cuts, for words and for texts of several words."""
    model.encode("x")
    scores = {p: s for p, s, kind in model.pieces if kind in (sentencepiece.NORMAL, sentencepiece.USER_DEFINED)}

    def best(text):
        top = [0.0]
        for i in range(1, len(text) + 1):
            top.append(max([top[i - 1] + model.unknown, *[top[j] + scores[text[j:i]] for j in range(max(0, i - 20), i) if text[j:i] in scores]]))
        return top[-1]

    for text in ["hello", "internationalisation", "don't stop, e.g. now!", "x  y\n z;q", "Größe über alles", "naïve 漢字 😀", "a.b,c:d(e)f"]:
        used = [model.pieces[i] for i in model.encode(text).tolist()]
        spelled = bytes(int(p[3:5], 16) for p, _, kind in used if kind == sentencepiece.BYTE).decode()  # characters of no piece
        total = sum(s for _, s, kind in used if kind != sentencepiece.BYTE) + model.unknown * len(spelled)
        assert math.isclose(total, best("▁" + text.replace(" ", "▁")), rel_tol=1e-6), text


# --- classifiers


def test_languages(spark, tables):
    rows = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.95


def test_languages_of_odd_rows(spark):
    df = clashing(docs(spark))
    net = language.train(df, F.col("lang"), ~held_out(F.col("doc_id")))
    found = language.identify(df, net).collect()
    for r in found:
        none = not any(unicodedata.category(c).startswith("L") for c in r["text"] or "")
        assert (r["language"]["lang"] == "und") == none and 0 <= r["language"]["score"] <= 1
    assert language.identify(empty(spark), net).count() == 0
    assert {r["language"]["lang"] for r in language.identify(df, language.train(empty(spark), F.col("lang"), F.lit(True))).collect()} == {"und"}


def test_predictions_by_hand(spark):
    """The network applied filter by filter to each window of texts, against the batched tables."""
    texts = ["Der schnelle Hund läuft über die Straße " * 30, "the quick dog runs over the road", "x", "", None]
    rows = [(i, ("guten tag " if i % 2 else "good day ") * (1 + i % 5), "de" if i % 2 else "en") for i in range(40)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("lang"), F.lit(True), per_language=10)
    for text, (lang, score) in zip(texts, net.predict(texts), strict=True):
        if not text:
            assert (lang, score) == ("und", 0.0)
            continue
        raw, stride, logits, held = text.lower().encode(), language.WINDOW - max(language.WIDTHS) + 1, np.zeros(len(net.classes)), 0
        count = max(1, -(-(len(raw) - max(language.WIDTHS) + 1) // stride))
        for k in range(count):
            window = raw[k * stride : k * stride + language.WINDOW].ljust(language.WINDOW, b"\0")
            tops = [max(sum(w[o, window[at + o]] for o in range(len(w)))[f] for at in range(stride)) for w in net.weights for f in range(net.filters)]
            size = stride if k < count - 1 else max(1, len(raw) - k * stride)
            logits += (np.maximum(np.array(tops) + net.bias, 0) @ net.dense + net.offset) * size
            held += size
        share = np.exp(logits / held - (logits / held).max())
        assert lang == net.classes[int(share.argmax())] and math.isclose(score, share.max() / share.sum(), rel_tol=1e-3)


def test_a_frequent_class_is_sampled_whole(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 1000 == 0, "rare").otherwise("common").alias("lang"))
    sizes = {r["_label"]: r["count"] for r in language.sample_labelled(df, F.col("lang"), F.lit(True), 50).groupBy("_label").count().collect()}
    assert sizes == {"rare": 20, "common": 50}


def test_windows_cover_every_byte():
    for n in (1, 2, 3, 4, 252, 253, 254, 255, 256, 257, 600, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        windows, held = language.window_bytes(text)
        stride = language.WINDOW - max(language.WIDTHS) + 1
        seen = bytearray(len(windows) * stride + language.WINDOW)
        for i, w in enumerate(windows):
            seen[i * stride : i * stride + language.WINDOW] = w.tobytes()
        assert bytes(seen[:n]) == text.encode() and held.sum() >= n - max(language.WIDTHS)


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.QUERIES["op6_toxicity"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    assert sum(s >= 0.3 for s in toxic) / len(toxic) >= 0.9 and sum(s >= 0.3 for s in clean) / len(clean) <= 0.02


def test_toxicity_of_odd_rows(spark):
    df = clashing(docs(spark))
    labels = spark.createDataFrame([(5, 1), (5, 1), (7, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert len(scored) == df.count() and all(0 <= r["toxicity"] <= 1 for r in scored)
    one = toxicity.train(df, labels.filter("toxic = 0"))
    assert all(r["toxicity"] < 0.01 for r in toxicity.score(df, one).collect())
    assert toxicity.score(empty(spark), one).count() == 0


def test_toxicity_by_hand(spark):
    """The fit over hashed blocks against one dense matrix of features, and the scores against sums of weights."""
    rng = random.Random(9)
    bad, good = ["vile", "stupid", "hateful"], ["kind", "lovely", "gentle"]
    texts = [" ".join(rng.choice("the a of road tree house".split()) if rng.random() < 0.7 else rng.choice(bad if i % 3 == 0 else good) for _ in range(12)) for i in range(60)]
    df = docs(spark, texts, extra=False)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    hasher = toxicity.Hasher()
    found = [set(hasher(t).tolist()) for t in texts]
    y = np.array([i % 3 == 0 for i in range(60)])
    every = sorted(set().union(*found))
    dense = np.array([[c in f for c in every] for f in found])
    n1, n0 = dense[y].sum(0), dense[~y].sum(0)
    ratio = np.log((n1 + 1) / (y.sum() + 2)) - np.log((n0 + 1) / ((~y).sum() + 2))
    used = (n1 + n0 >= 5) & (np.abs(ratio) >= 1.5)
    weights = model.weights[np.array(every)]
    assert used.any() and (weights[~used] == 0).all() and (np.sign(weights[used & (weights != 0)]) == np.sign(ratio[used & (weights != 0)])).mean() > 0.9
    for r in toxicity.score(df, model).collect():
        own = 1 / (1 + math.exp(-(sum(float(model.weights[c]) for c in found[r["doc_id"]]) + model.intercept)))
        assert math.isclose(r["toxicity"], own, rel_tol=1e-6) and (r["toxicity"] >= 0.3) == (r["doc_id"] % 3 == 0)


def test_blocks_of_features_do_not_matter():
    rows = toxicity.Rows([np.array(r, np.int32) for r in ([0, 2], [], [1], [0, 1, 2], [2])])
    values, of_rows = np.array([1.0, 10.0, 100.0]), np.array([1.0, 2.0, 4.0, 8.0, 16.0])
    assert rows.sums(values).tolist() == [101, 0, 10, 111, 100] and rows.spread(of_rows, 3).tolist() == [9, 12, 25]
    whole = toxicity.Rows.blocks
    toxicity.Rows.blocks = lambda self, most=2: whole(self, most)
    try:
        assert rows.sums(values).tolist() == [101, 0, 10, 111, 100] and rows.spread(of_rows, 3).tolist() == [9, 12, 25]
    finally:
        toxicity.Rows.blocks = whole


def test_distinct_features():
    hasher = toxicity.Hasher()
    found = hasher("abcabcabc")
    assert len(found) == len(set(found.tolist())) and len(hasher("abcabcabc")) == len(found) and len(hasher("abcdefgh")) < len(found)


# --- decontamination


def alignment_by_hand(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH), h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return int(h.max())


def test_alignment_by_hand():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        score, stop, start = decontaminate.smith_waterman(a, b)
        assert score == alignment_by_hand(a, b) and 0 <= start <= stop <= len(b)


@pytest.mark.parametrize("small", [decontaminate.SMALL, 0])
def test_copies_and_edits_are_found(spark, small):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(30)) for _ in range(8)]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = [" ".join(word() if k % 6 == 5 else w for k, w in enumerate(t.split())) for t in items]
    texts = [f"{noise(50)} {t.upper()} {noise(20)}" for t in items] + [f"{noise(9)}, {t}." for t in edited] + [noise(200) for _ in range(20)] + [None, "", items[0]]
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(clashing(docs(spark, texts, extra=False)), bench, small=small).collect()}
    assert found == {(i, i) for i in range(8)} | {(i + 8, i) for i in range(8)} | {(len(texts) - 1, 0)}
    assert decontaminate.contaminated(empty(spark), bench, small=small).count() == 0
    assert decontaminate.contaminated(docs(spark), bench.limit(0), small=small).count() == 0
    nameless = clashing(docs(spark, texts, extra=False)).withColumn("doc_id", F.lit(None).cast("long"))
    left = decontaminate.clean(nameless, bench, small=small)
    assert left.columns == nameless.columns and left.count() == len(texts) - 17


@pytest.mark.parametrize("small", [decontaminate.SMALL, 0])
def test_edited_copies_without_rare_runs_are_found(spark, small):
    """Copies with every fifth, sixth or third word changed, alone or beside a verbatim one, and words put in between."""
    rng = random.Random(5)
    items = [" ".join(f"{rng.choice('abcdefgh')}{i}x{k}" for k in range(26)) for i in range(5)]
    change = lambda t, n: " ".join("other" if k % n == n - 1 else w for k, w in enumerate(t.split()))
    between = " ".join(w + " new" * (k % 2) for k, w in enumerate(items[3].split()))
    texts = [change(items[0], 5), change(items[1], 6), items[2], "start " + change(items[2], 5), between, change(items[4], 3)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts, extra=False), bench, small=small).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 3)}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_no_alignment_is_lost(threshold):
    rng = random.Random(11)
    for _ in range(150):
        words = [rng.choice("abcdefghij").encode() for _ in range(rng.randrange(1, 14))]
        copy = [w for w in words for w in rng.choice([[w], [w], [w], [b"z"], [w, b"z"], []])]
        text = [rng.choice("abcdefghijklm").encode() for _ in range(rng.randrange(30))] + copy + [rng.choice("klm").encode() for _ in range(9)]
        item = b" ".join(words).decode()
        score = alignment_by_hand([*words], text) / (decontaminate.MATCH * len(words))
        found = decontaminate.matches(decontaminate.Items([(7, item)], threshold), text)
        assert [(m[0], m[1]) for m in found] == ([(7, score)] if score >= threshold else [])


def test_both_paths_give_equal_rows(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(4))
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 9, 15, 30)]
    texts = [" ".join([*[word() for _ in range(9)], *[w for w in t.split() for w in rng.choice([[w], [w], [w], [w, "q"], ["q"]])], word()]) for t in items * 4] + [items[0], None, ""]
    bench = spark.createDataFrame([*enumerate(items), (3, items[4]), (None, items[5]), (2, items[2]), (77, ""), (78, None)], "item_id long, text string")
    small, large = [sorted(map(repr, decontaminate.contaminated(docs(spark, texts), bench, small=n).collect())) for n in (decontaminate.SMALL, 0)]
    assert small == large and any("item_id=0," in r for r in large) and any("item_id=1," in r for r in large)


def test_rarest_seeds_find_all_that_hold_enough(spark):
    rng = random.Random(13)
    items = {k: Counter(rng.choices(range(12), weights=[30, *[3] * 11], k=rng.randrange(1, 15))) for k in range(12)}
    held = [set(rng.sample(range(12), rng.randrange(12))) | {0} for _ in range(60)]
    needs = {k: rng.randrange(1, sum(c.values()) + 1) for k, c in items.items()}
    rows = [(k, 5, needs[k], g, n) for k, c in items.items() for g, n in c.items()]
    seeds = spark.createDataFrame([*rows, (None, 5, 2, 0, 2), (None, 5, 2, 99, 1)], "item_id long, item_part long, need long, gram long, n long")
    counts = spark.createDataFrame([(g, sum(g in h for h in held)) for g in range(12)], "gram long, n_docs long")
    kept = {(r["item_id"], r["gram"]) for r in decontaminate.rarest(seeds, counts).filter("rare").collect()}
    for k, c in items.items():
        assert all(any((k, g) in kept for g in h) for h in held if sum(n for g, n in c.items() if g in h) >= needs[k])
        if sum(c.values()) - c[0] >= sum(c.values()) - needs[k] + 1:  # enough others: what all documents hold isn't looked for
            assert (k, 0) not in kept
    assert {g for k, g in kept if k is None} == {0, 99}
    assert decontaminate.rarest(seeds.limit(0), counts).count() == 0


def test_a_run_that_all_texts_hold_finds_no_pairs(spark, monkeypatch):
    rng = random.Random(14)
    own = lambda k: " ".join(f"{rng.choice('abc')}{k}y{i}" for i in range(26))
    items = [f"one and the same {own(k)}" for k in range(20)]
    texts = [f"one and the same {own(100 + k)}" for k in range(100)] + items[:3]
    seen, rarest = [], decontaminate.rarest
    monkeypatch.setattr(decontaminate, "rarest", lambda *a: seen.append(rarest(*a)) or seen[-1])
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts, extra=False), bench, small=0).collect()}
    assert found == {(100 + k, k) for k in range(3)}
    rows = seen[0].collect()
    assert max(r["n_docs"] for r in rows if r["rare"]) <= 1 and sum(r["n_docs"] == 103 for r in rows) == 3 * len(items)


def test_words_between_tabs_and_newlines_count(spark, monkeypatch):
    taken = []
    joined = decontaminate._joined
    monkeypatch.setattr(decontaminate, "_joined", lambda *a: taken.append(1) or joined(*a))
    bench = spark.createDataFrame([(1, "a\tb\nc\td\re\tf")], "item_id long, text string")
    decontaminate.contaminated(docs(spark), bench, small=6)
    assert not taken
    decontaminate.contaminated(docs(spark), bench, small=5)
    assert taken
    taken.clear()
    decontaminate.contaminated(docs(spark), spark.createDataFrame([(1, "x" * 97)], "item_id long, text string"), small=6)
    assert taken


def test_digest_columns(spark, tables):
    row = queries.QUERIES["op4_line_dedup"](spark, tables).first()
    assert len(row["kept_sha256"]) == len(hashlib.sha256().hexdigest())
