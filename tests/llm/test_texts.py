"""Operators on texts against brute force on awkward documents."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanflow.llm import decontaminate, jaccard_join, langid, license, line_dedup, packing, quality, substring_dedup
from spanflow.llm.common import annotate

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def given(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_quality_measures(docs):
    def brute(t):
        w = BLANK.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {i + j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep))
    got = rows(quality.ledger(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == Counter((i, *brute(t)) for i, t in given(docs))


def test_quality_policies_and_ablations(docs, no_docs):
    led = quality.ledger(docs, keep=["doc_id"]).cache()
    for p in quality.POLICIES.values():
        for r in p.reject + p.weak:
            got = quality.ablations(led).where((F.col("policy") == p.version) & (F.col("dropped_rule") == r)).first()
            assert got.n_kept == quality.apply_policy(led, p).where("kept").count()
            assert got.n_kept_without == quality.apply_policy(led, p.without(r)).where("kept").count()
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.n_words for r in kept.collect()} == {"w"}
    assert quality.keep_good(no_docs).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 1100])
def test_decontamination(spark, docs, no_docs, block_bytes):
    items = [(1, " ".join(f"word{i} and more{i % 7} of it" for i in range(3, 9))), (2, "Short ONE"), (3, None), (4, "x"),
             (5, "nowhere to be found"), (None, "first line"), (7, "first line")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(t):
        w = ALNUM.findall(t.translate(UP))
        hit, found = set(), set()
        for i, x in items:
            v = ALNUM.findall((x or "").translate(UP))
            k = min(13, len(v))
            wins = {tuple(v[a:a + k]) for a in range(len(v) - k + 1)} if k else set()
            for a in range(len(w) - k + 1 if k else 0):
                if tuple(w[a:a + k]) in wins:
                    hit |= set(range(a, a + k))
                    found.add("" if i is None else str(i))
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    got = decontaminate.mark(docs, bench, keep=["doc_id"], block_bytes=block_bytes)
    got = got.withColumn("sha", decontaminate.items_digest())
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "sha") == Counter((i, *brute(t)) for i, t in given(docs))
    clean = decontaminate.remove_documents(docs, bench)
    assert clean.columns == docs.columns and {"it"} == {r["items"] for r in clean.collect()}
    assert decontaminate.mark(no_docs, bench).count() == 0
    assert decontaminate.remove_documents(docs, bench.limit(0)).count() == docs.count()
    spans = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).select("doc_id", "text").collect()}
    assert spans[7] == "" and spans[9].startswith(" of it\n") and spans[4] is None


@pytest.mark.parametrize("words", [5, 35, 50])
def test_substring_dedup(docs, no_docs, words):
    texts = [(i, BLANK.findall(t)) for i, t in given(docs)]
    seen = Counter(tuple(w[a:a + words]) for _, w in texts for a in range(len(w) - words + 1))

    def brute(w):
        gone = {a + j for a in range(len(w) - words + 1) if seen[tuple(w[a:a + words])] > 1 for j in range(words)}
        return len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)
    got = substring_dedup.dedup_substrings(docs, words=words).select("doc_id", F.col("n_words").cast("long").alias("n"), "n_removed", "kept")
    assert rows(got, "doc_id", "n", "n_removed", "kept") == Counter((i, *brute(w)) for i, w in texts)
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_substring_dedup_makes_the_windows_of_a_level_once(spark, tmp_path):
    texts = [(i, " ".join(f"w{j % (50 + i)}" for j in range(90))) for i in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = substring_dedup.dedup_substrings(spark.read.parquet(f"{tmp_path}/docs"))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # one for each level and one for the texts that are left; counts asked back by a join took more
    assert len(re.findall(r"MapInArrow", plan)) == len(substring_dedup.levels(substring_dedup.WORDS)) + 1


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup(docs, no_docs, run):
    texts = sorted({(r.doc_id is not None, r.doc_id or 0, r.text) for r in docs.collect() if r.text is not None})
    seen, out = set(), {}
    for has, i, t in texts:
        lines = t.split("\n")
        content = [k for k, x in enumerate(lines) if BLANK.search(x)]
        gone = set()
        for a in range(len(content) - run + 1):
            win = tuple(lines[k] for k in content[a:a + run])
            if win in seen:
                gone |= set(content[a:a + run])
            seen.add(win)
        out[has, i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    got = line_dedup.dedup_lines(docs, run=run)
    assert got.columns == docs.columns
    want = Counter((r.doc_id, out.get((r.doc_id is not None, r.doc_id or 0, r.text))) for r in docs.collect())
    assert rows(got, "doc_id", "text") == want
    assert line_dedup.dedup_lines(no_docs, counts=("a", "b")).count() == 0


@pytest.mark.parametrize("run, single", [(2, 1), (2, 4), (3, 4)])
def test_line_dedup_takes_long_single_lines(spark, docs, run, single):
    line = "one long line of eight words or more"
    more = [(20, f"{line}\na1\nb1"), (21, f"a2\n{line}\nb2"), (22, line), (23, f"short\nc\n\n{line}"), (24, "a3\nshort\nb3"), (25, line + " ")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    seen, out = set(), {}
    for has, i, t in sorted({(r.doc_id is not None, r.doc_id or 0, r.text) for r in d.collect() if r.text is not None}):
        lines = t.split("\n")
        content = [k for k, x in enumerate(lines) if BLANK.search(x)]
        gone = set()
        for a, k in enumerate(content):
            for win in ([content[a:a + run]] if a + run <= len(content) else []) + ([[k]] if len(BLANK.findall(lines[k])) >= single else []):
                key = tuple(lines[x] for x in win)
                if key in seen:
                    gone |= set(win)
                seen.add(key)
        out[has, i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert out[True, 22, line] == "" and out[True, 21, f"a2\n{line}\nb2"] == "a2\nb2"
    assert single == 1 or out[True, 24, "a3\nshort\nb3"] == "a3\nshort\nb3"
    want = Counter((r.doc_id, out.get((r.doc_id is not None, r.doc_id or 0, r.text))) for r in d.collect())
    assert rows(line_dedup.dedup_lines(d, run=run, single=single), "doc_id", "text") == want


def near_copies():
    rng = np.random.default_rng(5)
    out = []
    for g in range(6):
        base = [f"t{g}x{j}" for j in range(int(rng.integers(5, 260)))]
        for _ in range(25):
            w = list(base)
            for j in rng.choice(len(w), int(rng.integers(0, 1 + len(w) // 25)), replace=False):
                w[j] = f"e{rng.integers(1 << 30)}"
            out.append((len(out) + 1, " ".join(w)))
    return out


@pytest.mark.parametrize("percent", [90, 75])
def test_jaccard_components(spark, docs, no_docs, percent):
    plain = [(i, t) for i, t in given(docs) if i != 13] + [(i + 100, t) for i, t in near_copies()]

    def shingles(t):
        w = BLANK.findall(t.translate(UP))
        return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    sets = [(i, shingles(t)) for i, t in plain]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].add(k)
    for k, (_, s) in enumerate(sets):
        for m in {m for x in s for m in holders[x]}:
            inter = len(s & sets[m][1])
            if 100 * inter >= percent * (len(s) + len(sets[m][1]) - inter):
                parent[root(k)] = root(m)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[root(k)].append(i)
    want = Counter((i, len(s), min((x for x in low[root(k)] if x is not None), default=None) if s else i) for k, (i, s) in enumerate(sets))
    df = spark.createDataFrame(plain, "doc_id long, text string").repartition(4)
    assert rows(jaccard_join.components(df, percent=percent), "doc_id", "n_shingles", "component_id") == want
    if percent == 90:
        kept = jaccard_join.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id < 4").collect()) == [1]
        assert jaccard_join.components(no_docs).count() == 0


@pytest.mark.parametrize("percent", [75, 80, 90])
def test_similar_sets_share_the_signatures_that_each_needs(percent):
    rng, sign = np.random.default_rng(percent), jaccard_join.Signatures(percent)
    for n in [*range(1, 60), 99, 123, 124, 125, 240, 300, 301, 302, 700]:
        most = 100 * n // percent - n  # tokens that only one of the two may have
        for _ in range(25):
            both, k = rng.integers(0, 1 << 64, n, dtype=np.uint64), int(rng.integers(0, most + 1))
            a, b = (np.unique(np.append(both, rng.integers(0, 1 << 64, x, dtype=np.uint64))) for x in (k, most - k))
            (held, need), (other, need_other) = sign(a), sign(b)
            common = np.intersect1d(held, other).view(np.uint64)
            shared = [int((common & np.uint64(1) == q).sum()) for q in (0, 1)]
            assert any(need[q] and need_other[q] and shared[q] >= max(need[q], need_other[q]) for q in (0, 1))


@pytest.mark.parametrize("percent", [80, 90])
def test_unrelated_texts_share_no_signature(percent):
    # parts without a token were signatures of half of all texts: candidates grew with the square of the input
    rng, sign = np.random.default_rng(2), jaccard_join.Signatures(percent)
    held = Counter()
    for n in (130, 190, 250, 290, 299) * 30:
        held.update(sign(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)))[0].tolist())
    assert max(held.values()) == 1


def test_opened_blocks_take_memory_by_their_tokens():
    import tracemalloc

    import pandas as pd
    rng = np.random.default_rng(3)
    a = [np.sort(rng.integers(0, 1 << 63, 142, dtype=np.uint64)) for _ in range(400)]
    every = np.unique(np.concatenate(a))
    b = [s[3:] for s in a[::2]] + [np.sort(rng.choice(every, 142, False)) for _ in range(200)]
    sides = [(0, i, s) for i, s in enumerate(a)] + [(1, 1000 + i, s) for i, s in enumerate(b)]
    pdf = pd.DataFrame([(x, r, r, s.astype("<u8").tobytes()) for x, r, s in sides], columns=["side", "rid", "star", "tokens"])
    tracemalloc.start()
    got = jaccard_join._open_blocks(90)(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(zip(got.a, got.b)) == {(2 * i, 1000 + i) for i in range(200)}
    assert peak < 32 * 8 * len(every)  # members times tokens took 91 MB, four bytes each


def test_rows_are_worked_on_in_pieces(spark):
    def make():
        return lambda cols: [[len(cols[0])] * len(cols[0])]
    d = spark.range(0, 64, 1, 1).withColumn("text", F.repeat(F.lit("x"), 100_000))
    got = annotate(d, [F.col("text")], [("n", "bigint")], make, ["id"], most=1 << 20).collect()
    assert sorted(r.id for r in got) == list(range(64)) and max(r.n for r in got) <= 10
    small = annotate(d, [F.col("text")], [("n", "bigint")], make, ["id"], most=1).collect()
    assert sorted(r.id for r in small) == list(range(64)) and {r.n for r in small} == {1}


def test_one_of_each_component_stays_whatever_the_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(3, long), (5, long + " end"), (5, "another text under the same id"), (5, long + " end"), (3, long),
                               (3, long + " stop"), (None, long), (7, ""), (8, None)], "doc_id long, text string")
    left = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(d).collect())
    assert sum(n for (i, t), n in left.items() if i and (t or "").startswith(long)) in (1, 2)  # equal rows are one document
    assert len([1 for i, t in left if i and (t or "").startswith(long)]) == 1
    assert left[5, "another text under the same id"] == 1 and left[None, long] == 1 and left[7, ""] == left[8, None] == 1


def test_packing_round_trip(spark, docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for i, t in given(docs):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a:a + 4096]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    packed = packing.pack(docs, with_ids=True).cache()
    assert rows(packed, "doc_id", "piece", "start", "length", "ids_crc32") == want
    bins = defaultdict(list)
    for r in packed.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(r.n_tokens * (len(r.ids) == 4 * r.n_tokens) for r in packing.sequences(packed).collect())
    assert total == sum(k[3] * n for k, n in want.items())
    assert packing.pack(no_docs).count() == 0


def test_packing_is_close_to_the_least_number_of_bins():
    rng = np.random.default_rng(1)
    for capacity in (10, 30, 100):
        for _ in range(60):
            h = Counter(rng.integers(1, capacity + 1, int(rng.integers(0, 200))).tolist())
            plan, placed = packing.plan_bins(dict(h), capacity), Counter()
            for contents, count in plan:
                assert sum(n * c for n, c in contents) <= capacity
                assert sum(c for n, c in contents if 3 * n > capacity) <= 2
                for n, c in contents:
                    placed[n] += c * count
            assert placed == h
            least = max(-(-sum(n * c for n, c in h.items()) // capacity), sum(c for n, c in h.items() if 2 * n > capacity))
            assert packing.bins_used(dict(h), capacity) <= 11 * least / 9 + 1


def test_license_scan(spark, docs, no_docs):
    cases = [("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("licensed under the apache license 2.0", "apache-2.0"),
             ("Licensed under the Apache Licence, Version 2.0.", ""), ("released under the mit license", "mit"),
             ("released under the terms of the mit license", "mit"), ("released under the terms of the big mit license", ""),
             ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"), ("all rights reserved", "reserved"), (None, ""),
             ("GNU General Public License", "gpl"), ("Copyright (c) 2020 some people All rights reserved", "copyright-notice,reserved")]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id int, text string")
    got = {r.doc_id: r for r in license.scan(d, with_spans=True).collect()}
    for k, (t, labels) in enumerate(cases):
        assert got[k].labels == labels, t
        assert 0 <= got[k].score <= 1 and (got[k].score == 1.0) == bool(labels)
    assert license.scan(docs).count() == docs.count() and license.scan(no_docs).count() == 0

    def brute(t):
        w = ALNUM.findall(t.translate(UP))
        at = [i for p in license.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        return len(w), len(at), min(at, default=None), max(at, default=None)
    got = license.scan(docs, keep=["doc_id"])
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word") == Counter((i, *brute(t)) for i, t in given(docs))


def test_automaton_accepts_what_its_pattern_does():
    import random
    a = license.Automaton("x", "a b <<optional>>c d<</optional>> e <<any 1-2>> f")
    pattern = re.compile(r"a b (c d )?e (\S+ ){1,2}f ")
    rng = random.Random(3)
    for _ in range(3000):
        w = [rng.choice("abcdef") for _ in range(rng.randint(1, 9))]
        m = pattern.match(" ".join(w) + " ")
        n, part = a.run([x.encode() for x in w], 0)
        assert bool(n) == bool(m) and (part == 1.0) == bool(n)


def test_language_id(spark, docs, no_docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).where("held_out AND n_chars > 200")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = langid.identify(docs).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(odd) == docs.count()
    for r in odd:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.identify(no_docs).count() == 0
    two = spark.createDataFrame([(1, "\u0130", "xx"), (2, "\u0130", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(two.union(two.withColumn("doc_id", F.lit(4)))).collect()} == {"xx"}
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_languages_whose_letters_only_differ(spark):
    """Two alphabets with the same words, letter for letter, with letters 21 apart in code point among them."""
    import random
    rng = random.Random(4)
    pairs = [("\u0430\u0431\u0432\u0433\u0434", "\u0445\u0446\u0447\u0448\u0449"), ("\u00e1\u00e4\u00fco", "\u00f6\u00f9\u00e7a"),
             ("".join(chr(0x4e00 + 21 * k) for k in range(8)), "".join(chr(0xac00 + 21 * k) for k in range(8)))]
    rows = []
    for p, (a, b) in enumerate(pairs):
        for _ in range(120):
            words = [[rng.randrange(len(a)) for _ in range(rng.randint(2, 6))] for _ in range(12)]
            for lang, letters in ((f"{p}a", a), (f"{p}b", b)):
                rows.append((len(rows), " ".join("".join(letters[k] for k in w) for w in words).title(), lang))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = langid.identify(d).collect()
    wrong = Counter(r.lang for r in got if r.lang != r.lang_pred)
    assert not wrong


def test_language_id_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(60)
    rows = d.collect()

    def bundle(t):
        s, v = "".join(c.lower()[0] if c.isalpha() else " " for c in t or ""), np.zeros(langid.DIM, np.int64)
        for w in s.split():
            w = f" {w} "
            for i in range(len(w) - 2):
                x = np.ones(langid.DIM, np.int64)
                for j, c in enumerate(w[i:i + 3]):
                    x *= np.roll(langid.letter_vector(0 if c == " " else ord(c)), 2 - j)
                v += x
        return v
    import zlib
    protos = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            protos[r.lang] = protos.get(r.lang, 0) + bundle(r.text)
    names = sorted(protos)
    for r in langid.identify(d).collect():
        v = bundle(r.text)
        cos = [v @ protos[x] / max(np.linalg.norm(v) * np.linalg.norm(protos[x]), 1e-12) for x in names]
        best = int(np.argmax(cos))
        assert r.lang_pred == (names[best] if v.any() else "und") and abs(r.score - max(0, cos[best])) < 1e-9
