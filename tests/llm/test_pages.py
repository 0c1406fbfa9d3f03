"""URL filter and WARC archives against brute force; the pipeline's stages."""
import base64
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from spanflow.llm import url_filter, warc

PAGES = [(1, "http://A.example.com/en/x?q#f", "<a href='http://b.org/y'>"), (2, "https://www.example.com/en/", "same"),
         (3, "http://b.org/", '<a href="//Spam.net/es/1"><a href=http://spam.net/2>'), (4, None, None), (5, "no scheme", ""),
         (6, "http://spam.net/es/", "same"), (7, "http://spam.net/xx", "same"), (8, "http://c.com", "é" * 70000),
         (8, "http://c.com", "é" * 70000), (None, "http://netes/", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny"),
         (10, "http://x.net/es", "z\r\n\r\n"), (11, "http://q.com/a\r\nX: y", "\r\n\r\nWARC/1.1")]
SCHEMA = "page_id long, url string, html string, host string, path string"


def pages(spark):
    return spark.createDataFrame([(*p, "h", "p") for p in PAGES], SCHEMA).repartition(3)


def test_rules_and_hosts(spark):
    got = {(r.page_id, r.url): r for r in url_filter.judge(pages(spark)).collect()}
    want = {1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            3: ("b.org", "/", None, "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
            6: ("spam.net", "/es/", "net/es/", "block"), 7: ("spam.net", "/xx", None, "block"), 8: ("c.com", "", None, "allow"),
            10: ("x.net", "/es", None, "allow")}
    for (i, _), r in got.items():
        if i in want:
            assert (r.host, r.path, r.rule, r.verdict) == want[i], i
    assert url_filter.judge(pages(spark)).count() == len(PAGES)
    empty = pages(spark).limit(0)
    assert url_filter.judge(empty).count() == 0
    assert url_filter.allowed(pages(spark)).columns == ["page_id", "url", "html", "host", "path"]


def test_ranks_against_brute_force(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 3.0), ("d", "c", 1.0)]
    seeds = {"a": (3.0, 0.0), "c": (1.0, 2.0), "e": (0.0, 2.0)}
    nodes = sorted({x for e in edges for x in e[:2]} | set(seeds))
    t0 = {n: seeds.get(n, (0, 0))[0] / 4 for n in nodes}
    d0 = {n: seeds.get(n, (0, 0))[1] / 4 for n in nodes}
    t, d = dict(t0), dict(d0)
    for _ in range(5):
        nt, nd = {n: .15 * t0[n] for n in nodes}, {n: .15 * d0[n] for n in nodes}
        for s, e, w in edges:
            nt[e] += .85 * t[s] * w / sum(x[2] for x in edges if x[0] == s)
            nd[s] += .85 * d[e] * w / sum(x[2] for x in edges if x[1] == e)
        t, d = nt, nd
    got = url_filter.propagate(spark.createDataFrame([(k, *v) for k, v in seeds.items()], "host string, trust double, distrust double"),
                               spark.createDataFrame(edges, "src string, dst string, n double"), rounds=5)
    for r in got.collect():
        assert abs(r.trust - t[r.host]) < 1e-9 and abs(r.distrust - d[r.host]) < 1e-9
    assert got.count() == len(nodes)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    n = 16
    rows = [(k, f"http://h{k}.org/", f"<a href='http://h{k + 1}.org/'>") for k in range(n)] + [(n, f"http://h{n}.org/", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(d, rules=[(f"h{n}.org/", "block")]).collect()}
    for k in range(n + 1):
        assert abs(got[k].distrust / (.15 * .85 ** (n - k)) - 1) < 1e-9 and got[k].suspicion == 1 and got[k].verdict == "block", k


def test_ranks_stand_whatever_the_tolerance_reaches(spark):
    seeds = spark.createDataFrame([("c3", 0.0, 1.0), ("b", 1.0, 0.0)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c0", "c1", 1.0), ("c1", "c2", 1.0), ("c2", "c3", 1.0)],
                                  "src string, dst string, n double")
    rough = {r.host: r for r in url_filter.propagate(seeds, edges, tolerance=9.0).collect()}
    assert all(rough[f"c{k}"].distrust > 0 for k in range(4))  # no host is left out for a loose tolerance
    got = {r.host: r for r in url_filter.propagate(seeds, edges, damping=.5, tolerance=1e-6).collect()}
    assert abs(got["b"].trust - 2 / 3) < 1e-6 and abs(got["a"].trust - 1 / 3) < 1e-6  # b = .5 + .5 a, a = .5 b


def test_warc_round_trip(spark):
    for chunk in (1 << 16, 50):
        got = warc.archived(pages(spark), chunk=chunk).collect()
        assert all(r.intact for r in got)

        def brute(i, html):
            b = (html or "").encode()
            keeper = max((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
            kind = "response" if i == keeper else "revisit"
            return i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, None if i == keeper else keeper
        want = Counter(brute(i, h) for i, _, h in PAGES)
        assert Counter((r.page, r.bytes, r.digest, r.type, r.refers_to) for r in got) == want
    assert warc.archived(pages(spark).limit(0)).count() == 0


def test_chunk_table(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(pages(spark), path, chunk=50)
    parts = warc.payload_chunks(spark, path).where("type != 'revisit'").orderBy("record", "part").collect()
    texts = {}
    for r in parts:
        texts.setdefault((r.record, r.page), []).append(r.data)
    joined = Counter((p, "".join(x)) for (_, p), x in texts.items())
    assert joined["8", "é" * 70000] == 2 and joined["11", "\r\n\r\nWARC/1.1"] == 1


def test_payloads_that_begin_like_a_record(spark, tmp_path):
    record = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 99\r\n\r\n<html>"
    texts = [record, "\r\n" + record, "\r\n\r\n" + record, "WARC/1.1", "\r\nWARC/1.1", "x" * 50 + record, "x" * 50 + "\r\n" + record,
             "x" * 49 + "\r" + "\n" + record, "x" * 48 + "\r\n\r\n" + record, record * 3, "\n" + record, "WARC/1.1\r\n" * 20]
    whole = spark.createDataFrame([(t,) for t in texts + ["", "\U0001F600" * 9]], "t string")
    for chunk in (1, 3, 7, 50, 1 << 16):
        for r in whole.select("t", warc.chunks(F.col("t"), chunk).alias("parts")).collect():
            assert "".join(r.parts) == r.t and max(map(len, r.parts)) <= chunk and len(r.parts) > 0
            assert not any(warc._BOUNDARY in (warc._BREAK + x + warc._BREAK + "WARC/1.1\r\n")[:-4] for x in r.parts)
    d = spark.createDataFrame([(i, "http://a.b/", t) for i, t in enumerate(texts)], "page_id long, url string, html string").repartition(3)
    want = Counter((i, len(t), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "response", True) for i, t in enumerate(texts))
    for chunk in (1 << 16, 50):
        got = warc.archived(d, chunk=chunk).collect()
        assert Counter((r.page, r.bytes, r.digest, r.type, r.intact) for r in got) == want
    path = str(tmp_path / "warc")
    warc.write(d, path, chunk=50)
    found = {}
    for r in warc.payload_chunks(spark, path).orderBy("record", "part").collect():
        found[r.page] = found.get(r.page, "") + r.data
    assert found == {str(i): t for i, t in enumerate(texts)}


def test_ids_that_look_like_headers(spark, tmp_path):
    ids = ["", "a\r\nWARC-Type: revisit", "50% + 50%25", "\u00e9 \x7f", "\U0001F600\n", None]
    d = spark.createDataFrame([(i, f"http://a.b/\n{k}", "same" if k < 3 else str(k)) for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page: r for r in warc.archived(d.repartition(2)).collect()}
    assert set(got) == set(ids) and all(r.intact for r in got.values())
    keeper = max(ids[:3])
    assert {i: (r.type, r.refers_to) for i, r in got.items()} == {
        i: ("revisit", keeper) if k < 3 and i != keeper else ("response", None) for k, i in enumerate(ids)}
    path = str(tmp_path / "warc")
    warc.write(d, path, chunk=2)
    assert {r.page for r in warc.payload_chunks(spark, path).collect()} == set(ids)
    broken = d.where("page_id = ''").withColumn("html", F.expr("cast(x'61ff62' as string)"))
    want = "a\ufffdb".encode()
    r, = warc.archived(broken).collect()
    assert (r.bytes, r.digest, r.intact) == (len(want), base64.b32encode(hashlib.sha1(want).digest()).decode(), True)


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before, out = docs.count(), stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= before, name
        docs = out
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_near_duplicates_against_brute_force(spark):
    import corpus_pipeline as p
    texts = []
    for g, changed in enumerate([(20, 60), (20, 60, 90), (50,), (10, 30, 50, 70)]):
        words = [f"g{g}w{j}" for j in range(100)]
        texts += [" ".join(words), " ".join(f"x{w}" if j in changed else w for j, w in enumerate(words))]

    def shingles(t):
        w = t.split()
        return {tuple(w[a:a + 5]) for a in range(len(w) - 4)}

    def similar(a, b):
        return 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b))
    rows = list(enumerate(texts, 1))
    want = {i for i, t in rows if not any(similar(t, u) for j, u in rows if j < i)}
    assert want == {1, 3, 4, 5, 7, 8}  # two changes in a hundred words are similar, three are not
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in p.near_duplicates(spark, d, "").collect()} == want


def test_pipeline_leaves_one_copy_whatever_the_ids(spark):
    import corpus_pipeline as p
    long, other = (" ".join(f"{c}{i}" for i in range(90)) for c in "wo")
    rows = [(None, long, "a"), (None, long, "b"), (None, long + " end", "a"), (None, long + " stop", "a"),
            (4, other, "a"), (4, other, "a"), (4, other, "b"), (None, other, "a"), (5, other + " end", "a"), (6, "", "a"), (6, "", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, `a.source` string").repartition(3)
    left = [p.near_duplicates(spark, d.repartition(n), "").collect() for n in (1, 4)]
    assert sorted(map(str, left[0])) == sorted(map(str, left[1]))
    assert [r.doc_id for r in left[0] if r.text.startswith("o")] == [4]
    assert [r.doc_id for r in left[0] if r.text.startswith("w")] == [None]
    assert len(left[0]) == 4 and left[0][0].asDict().keys() == {"doc_id", "text", "a.source"}
