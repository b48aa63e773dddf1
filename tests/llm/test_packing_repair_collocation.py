"""Packing, conversation repair and collocations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tickloom.llm import collocations, common, conversations, packing
from tickloom.llm.queries import SQL

# ---- packing ----


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return [[*e.ids, packing.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["", " ", "  a  b", "a \n b", "x\n", " x", "end", "a <|endoftext|> b", "it's  fine\t\tthat 's", "é　 à b c\x1c d", "  x  y", "a" * 5000, "wort " * 3000, "日本 語 テ\n\nキスト"]


def test_units_encode_like_whole_texts():
    encoder = packing.Encoder(packing.tokenizer_path())
    for __ in range(2):  # new units, then known ones
        assert [x.tolist() for x in encoder.encode(ODD)] == tokens(ODD)


def check_packed(rows, docs, tiers):
    """``docs``: (id, text) with distinct ids. All ids lie in one piece each, windows are gapless and full but for a few."""
    want = dict(zip([d for d, _ in docs], tokens([t for _, t in docs])))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append(r)
    for doc, ids in want.items():
        place = 0
        for start, length in sorted(pieces[doc]):
            assert start == place
            place += length
        assert place == len(ids)
    assert sorted(windows) == list(range(len(windows)))
    gaps = []
    for found in windows.values():
        place = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert len({(r.window, r.step) for r in found}) == 1 and found[0].window in tiers and place <= found[0].window
        gaps.append(found[0].window - place)
        assert place == found[0].window or found[0].window == tiers[0]
    lengths = [windows[i][0].window for i in sorted(windows)]
    assert lengths == sorted(lengths, reverse=True)
    steps = Counter()
    for found in windows.values():
        steps[found[0].step] += found[0].window
    assert not steps or max(steps.values()) - min(steps.values()) <= tiers[0]
    return sum(g > 0 for g in gaps)


def test_packed_documents(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "x", "gamma;", "né"]) for _ in range(rng.choice([0, 1, 3, 40, 300, 900, 2500])))) for i in range(150)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5000, None), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash")).repartition(3)
    for tiers, pool in (((1024, 512, 256, 128), packing.POOL), ((256, 64, 8), 2000)):
        rows = packing.pack(frame, tiers=tiers, pool=pool, step_tokens=5000).collect()
        assert check_packed(rows, docs, tiers) <= 3  # one for each task


def test_short_documents_make_short_windows(spark):
    docs = [(i, "word " * (20 + i % 90)) for i in range(300)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert check_packed(rows, docs, packing.TIERS) <= 1
    assert Counter(r.window for r in rows).most_common(1)[0][0] == 128


def test_packed_repeats_and_nothing(spark):
    frame = spark.createDataFrame([(1, "same"), (1, "same"), (None, None)], "doc_id long, text string")
    rows = packing.pack(frame.coalesce(1)).orderBy("offset").collect()
    assert sorted((r.doc_id or 0, r.start, r.length) for r in rows) == [(0, 0, 1), (1, 0, 2), (1, 0, 2)] and {r.sequence_id for r in rows} == {0}
    assert packing.pack(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(frame, tiers=(100, 10))


# ---- conversation repair ----


def repaired(rows):
    """Forward search for the least (cost, audit) of each state, by (id, turn, role, text)."""
    space = lambda x: " " if x is None else str(x)
    found = {}
    for conv, turn, role, text in rows:
        held, kind = found.setdefault(conv, []), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: repaired_one(held) for conv, held in found.items()}


def repaired_one(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, faults = set(), []
    for __, role, text in rows:
        left = re.sub("[ \t-\r]+$", "", text)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, *_ in rows if t is not None]
    after = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ())}

    def put(into, state, cost, audit, lines):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = cost, audit, lines

    def inserted(into):
        for __ in range(3):
            for state, (cost, audit, lines) in list(into.items()):
                put(into, after[state][0], cost + 3, audit + "I", (*lines, after[state] + ":"))
        return into

    for (__, role, text), fault, initial in zip(rows, faults, initials):
        new = {}
        for state, (cost, audit, lines) in inserted(best).items():
            put(new, state, cost + 4, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            if initial == after[state][0] or initial == "s" and state == "":
                put(new, initial, cost, audit + "K", (*lines, f"{role}:{text}"))
            put(new, after[state][0], cost + 3, audit + "R", (*lines, f"{after[state]}:{text}"))
        best = new
    cost, audit, lines = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


ROWS = "conv_id long, turn long, role string, text string"


def random_rows(seed, sizes, ids=(None, 1, 2, 3, 4, 5)):
    rng = random.Random(seed)
    rows = {}
    for conv in ids:
        for i in range(rng.choice(sizes)):
            turn = rng.choice([None, i, i, i, i + 1, i // 2])
            rows[conv, turn] = (rng.choice([None, "user", "assistant", "system", "tool", "", "user", "assistant"]), rng.choice([None, "", " \t", "a.", "b.", "c", "what?", "d! ", "e\n."]))
    return [(*k, *v) for k, v in rows.items()]


def results(frame, **options):
    rows = conversations.repair(conversations.damage(frame), **options).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize(("fragment", "sizes"), [(4096, (1, 3, 8, 30)), (1, (1, 5, 12)), (7, (40, 300))])
def test_repairs_are_the_cheapest_and_least(spark, fragment, sizes):
    rows = random_rows(fragment, sizes)
    frame = spark.createDataFrame(rows, ROWS).withColumn("audit", F.lit("clash")).repartition(4)
    assert results(frame, fragment=fragment, together=20) == repaired(rows)


def test_one_conversation_with_most_rows(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"text {i % 50}{'.' if i % 7 else ''}") for i in range(3000)] + random_rows(1, (2, 4))
    assert results(spark.createDataFrame(rows, ROWS), fragment=100) == repaired(rows)


def test_repeated_rows_and_nothing(spark):
    rows = [(1, 0, "user", "hello."), (1, 0, "user", "hello."), (1, 1, "assistant", "yes."), (2, 9, None, None)]
    frame = spark.createDataFrame(rows, ROWS)
    assert results(frame) == repaired(rows)
    assert results(frame.limit(0)) == {}


def test_dropped_rows_leave_their_conversation(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert results(spark.createDataFrame([(1, turn, "user", "x.")], ROWS)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_sql_repairs_alike():
    rows = random_rows(11, (1, 4, 9))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rows = [r for r in rows if r[2] != ""]
    con.execute("DELETE FROM conversations WHERE role = ''")
    assert {r[0]: r[1:] for r in con.execute(SQL["op12_conversation_repair"]).fetchall()} == repaired(rows)


def test_paths_of_fragments_add_up():
    rng = np.random.default_rng(4)
    initial, fault = rng.integers(0, 4, 30), rng.integers(0, 4, 30)
    whole = conversations.transfer(initial, fault)
    parts = [conversations.transfer(initial[s : s + 10], fault[s : s + 10]) for s in (0, 10, 20)]
    joined = parts[0]
    for p in parts[1:]:
        joined = (joined[:, :, None] + p[None]).min(1)
    assert (np.minimum(joined, conversations.FAR) == whole).all()


# ---- collocations ----


def phrases(docs, support, covered=80, top=2000, longest=4):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if a >= support and len(p) > 1}
        rows = []
        for p, a in frequent.items():
            score, k = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items() if len(q) > len(p))
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return out


def text_rows(seed, n, length):
    rng = random.Random(seed)
    words = ["new", "york", "New", "city", "of", "the", "a", "é", "\x00", "über", "x\x1cy", "日本"]
    signs = [" ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\x0b", "; "]
    return [(rng.choice(["en", "en", "en", "de", None, "fr"]), "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(length)))) for _ in range(n)]


@pytest.mark.parametrize(("support", "chunk", "bits", "top"), [(5, 200, 1 << 12, 2000), (30, 1 << 20, 1 << 20, 20), (3, 50, 64, 2000)])
def test_collocations_are_exact(spark, support, chunk, bits, top):
    docs = [*text_rows(support, 120, 60), ("en", None), (None, ""), ("en", "of the city of new york. " * 400)]
    frame = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("a", F.lit(1)).repartition(5)
    got = collocations.collocations(frame, support=support, chunk=chunk, bits=bits, top=top)
    assert sorted(map(tuple, got.collect())) == sorted(phrases(docs, support, top=top))


def test_counts_beyond_64_bits(spark):
    """Scores are taken with decimals: a product that 64 bits can't hold."""
    row = spark.sql("SELECT (cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) AS s FROM VALUES (9000000000000000000L, 9100000000000000000L, 9200000000000000000L) AS t(a, l, r)").first()
    assert row.s == 2000000 * 9000000000000000000 // 18300000000000000000


def test_no_collocations(spark):
    frame = spark.createDataFrame([("en", "few words")], "lang string, text string")
    assert collocations.collocations(frame).collect() == [] and collocations.collocations(frame.limit(0)).collect() == []


def shuffled(spark):
    """Bytes of shuffle written by each stage so far."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}


def test_rare_phrases_are_not_shuffled_as_texts(spark):
    """Pairs of frequent words that are rare themselves: less than eight bytes of shuffle for each, results as ever."""
    rng = random.Random(5)
    words = [f"longish{i}" for i in range(300)]
    docs = [("en", " ".join(rng.choices(words, k=100)) + (" new york city" if i % 20 == 0 else "")) for i in range(2000)]
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    frame.write.format("noop").mode("overwrite").save()
    before = shuffled(spark)
    counts, __ = collocations.mine(frame)
    written = sum(n for k, n in shuffled(spark).items() if k not in before)
    pairs = Counter(p for __, t in docs for p in zip(t.split(), t.split()[1:]))
    assert {r.phrase: r.a for r in counts.collect() if r.n_words == 2} == {" ".join(p): a for p, a in pairs.items() if a >= 30}
    assert 0 < written < 8 * sum(pairs.values())


def test_disk_of_tallies_texts_and_chunks(spark):
    """Shuffle and the table of chunks together: less than six bytes for each pair of words that stands somewhere."""
    rng = random.Random(6)
    words = [f"longish{i}" for i in range(2000)]
    docs = [("en", " ".join(rng.choices(words, k=300))) for i in range(3000)]
    frame = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    frame.write.format("noop").mode("overwrite").save()
    root = Path(common.shared_folder(spark).removeprefix("file:"))
    before, old = shuffled(spark), set(root.glob("word-chunks-*"))
    counts, __ = collocations.mine(frame)
    written = sum(n for k, n in shuffled(spark).items() if k not in before)
    [chunks] = set(root.glob("word-chunks-*")) - old
    kept = sum(p.stat().st_size for p in chunks.glob("*.parquet"))
    found = Counter(w for __, t in docs for w in t.split())
    assert {r.phrase: r.a for r in counts.collect() if r.n_words == 1} == {w: a for w, a in found.items() if a >= 30}
    assert 0 < written and 0 < kept and written + kept < 6 * 299 * len(docs)


@pytest.mark.parametrize("held", [1, 400, 1 << 20])
def test_packed_texts_add_up(monkeypatch, held):
    """Whatever is handed on early, counts of texts come back whole, those beyond 32 bits too."""
    monkeypatch.setattr(collocations, "HELD", held)
    rng = random.Random(held)
    words = ["a", "ß", "日本", "\x00", "x" * 300, "b c", "a ß", "日本 a b"]
    want, packed = Counter(), []
    for __ in range(20):
        counts = {w: rng.choice([1, 5, 1 << 40]) for w in rng.sample(words, rng.randrange(1, 9))}
        want.update(counts)
        keys = pa.array([words.index(w) for w in counts], pa.uint64())
        packed += collocations._packed("en", pa.table({"phrase": list(counts), "key": keys, "n": list(counts.values())}), 4)
    rows, got = pa.Table.from_batches(packed), {}
    for bucket in range(4):
        found = collocations._summed(40)(rows.filter(pc.equal(rows["bucket"], bucket))).to_pylist()
        assert all(r["lang"] == "en" and r["n_words"] == r["phrase"].count(" ") + 1 and words.index(r["phrase"]) % 4 == bucket for r in found)
        got |= {r["phrase"]: r["a"] for r in found}
    assert got == {w: a for w, a in want.items() if a >= 40}
