"""URL filters, top-k search, the Jaccard join and the pipeline against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import jaccard, shared, topk, toxicity, url_filter


def test_cascade_is_exact():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    for n in (0, 1, 500, 19_999, 20_000):
        c = url_filter.Cascade.from_bytes(url_filter.Cascade.build(keys[:n], keys[n:]).to_bytes())
        assert c.contains(keys[:n]).all() and not c.contains(keys[n:]).any()


def test_urls(spark, monkeypatch):
    urls = ["http://A.Example.com/en/7x?q", "https://m.site.org/es/1#t", "HTTP://x.NET/de/8", "http://example.net/de/89", "no-scheme", None, "http://m.other.org", "http://amp.b.c/?a/b", "x://y://z/en/", "http://com/en/", "http://notcom/en/", "", "http://É.com/en/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("own"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("m.site.org", "/es/1", "org/es/", "block")
    assert got[2] == ("x.net", "/de/8", "net/de/", "block")
    assert got[3] == ("example.net", "/de/89", "example.net/de/8", "block")
    assert got[4] == got[5] == got[11] == ("", "", None, "allow")
    assert got[6] == ("m.other.org", "", None, "block") and got[7] == ("amp.b.c", "/", None, "block")
    assert got[8] == ("y:", "//z/en/", None, "allow") and got[9][2] == "com/en/" and got[10][2] is None and got[12][0] == "É.com"
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 64)  # many passes
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df).collect()} == {k: v[3] for k, v in got.items()}
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 19)]) for i in range(330)]
    rows += [(1000 + i, rows[3][1]) for i in range(8)] + [(2000, None), (2001, [1.0, None]), (2050, [float("nan")] * 19), (3000, []), (3050, []), (None, rows[5][1]), (150, rows[150][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    monkeypatch.setattr(topk, "QUERY_BYTES", 600)
    monkeypatch.setattr(topk, "CHUNK", 64)
    got = [tuple(r) for r in topk.top_k(df.repartition(5)).collect()]
    ok = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    # Two rows with one id ask twice; every answer of either is right.
    assert set(got) == set(want)
    assert topk.top_k(df.limit(0)).count() == 0


def plain_components(rows):
    import re

    sets = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return [(d, len(s), min((x for x in ids[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed, n=160):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeinrst"), 4)) for _ in range(400)]
    passage = list(rng.choice(words, 40))
    rows = []
    for i in range(n):
        base = list(rng.choice(words, int(rng.choice([3, 4, 5, 7, 9, 14, 30, 60, 120]))))
        if i % 3 == 0:
            base += passage
        for _ in range(int(rng.integers(1, 6))):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(0, len(own)))
                own[at : at + 1] = list(rng.choice(words, int(rng.integers(0, 3))))
            rows.append((len(rows), " ".join(own).title() if i % 2 else "  ".join(own)))
    return rows + [(len(rows) + i, t) for i, t in enumerate(["", None, " \n", "one", "ONE", "one two three four", "One two three four", "a b c d e", "a b c d e f"])]


@pytest.mark.parametrize("settings", [{}, {"SHORT_LIST": 2, "BLOCK": 8}, {"light": 60}, {"light": 0, "MOST_FREQUENT": 5}])
def test_jaccard_components(spark, monkeypatch, settings):
    rows = corpus(len(settings) + settings.get("light", 7))
    rows += [rows[9], rows[9], (None, rows[9][1]), (None, "only nulls have this text here now")]
    if "light" in settings:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: settings["light"])
    for name in settings.keys() - {"light"}:
        monkeypatch.setattr(jaccard, name, settings[name])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("own"), "set_id": F.lit("own")}).repartition(6)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = sorted((tuple(r) for r in jaccard.digest(shared.written(df, "in")).collect()), key=key)
    assert got == sorted(plain_components(rows), key=key)


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.digest(empty).count() == 0 and jaccard.deduplicated(empty).count() == 0
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, ""), (4, None), (None, "p q r s t u"), (None, "v w x y z a")]
    kept = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, "a b c d e f g h"), (3, ""), (4, ""), (0, "p q r s t u"), (0, "v w x y z a")])


def test_bitmaps_never_overstate():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, n // 8 + 1, dtype=np.uint64)]))
        (ma, ha), (mb, hb) = jaccard.bitmaps(a), jaccard.bitmaps(b)
        x, y = (ma, mb) if len(ma) == len(mb) else (ha, mb) if len(ma) > len(mb) else (ma, hb)
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def scans(spark, df):
    """``df`` as read with small and with large splits."""
    out = []
    for most in ("2k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        out.append((df.select("*").rdd.getNumPartitions(), sorted(map(tuple, df.select("_rid", "text").collect()))))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    return out


def test_row_ids_outlast_other_splits(spark, tmp_path):
    path = str(tmp_path / "a b\u00e9.parquet")
    made = spark.range(4000).select(F.col("id").alias("doc_id"), F.format_string("t%d", "id").alias("text"), F.lit("own").alias("_row"))
    made.repartition(5).write.option("parquet.block.size", "4096").parquet(path)
    read = spark.read.parquet(path)
    half = read.where("doc_id % 2 = 0")
    for docs in (read, half, read.unionByName(read), read.withColumn("_metadata", F.lit(1)), made.repartition(3), read.limit(0)):
        (few, a), (many, b) = scans(spark, shared.row_ids(docs))
        n = docs.count()
        assert a == b and len({r for r, _ in a}) == len(a) == n and shared.row_ids(docs).columns == [*docs.columns, "_rid"]
        assert few != many or not n
    assert shared.row_ids(read.withColumn("_rid", F.lit("own"))).select(F.count_distinct("_rid")).first()[0] == 4000


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in corpus(11, 60)]
    rows = [(i, (t + " zquork vlimp zquorks") if i % 9 == 4 and t else t, lang, s, n) for i, t, lang, s, n in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] % 9 == 4 and bool(r[1]))) for r in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, names = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.written(stage(spark, now, str(tmp_path)), name)
        if name != "bpe":
            assert out.columns == names
        seen[name], now = (now.toPandas(), out.toPandas()), out
    before, after = seen["toxicity"]
    bad = set(before[(before.doc_id % 9 == 4) & (before.text.fillna("") != "")].doc_id)
    assert len(bad & set(after.doc_id)) <= 0.1 * len(bad) and len(set(before.doc_id) - bad - set(after.doc_id)) <= 0.02 * len(before)
    before, after = seen["jaccard_join"]
    comps = plain_components(list(zip(before.doc_id.tolist(), before.text.tolist())))
    want = {c for d, n, c in comps if n} | {d for d, n, _ in comps if not n}
    assert set(after.doc_id) == want and len(after) == len(want)
    before, after = seen["mixing"]
    size = lambda t: t.fillna("").str.findall(r"[^\x20\x09-\x0D]+").str.len().sum()
    assert abs(size(after.text) - 1.5 * size(before.text)) <= 4 and set(after.doc_id) <= set(before.doc_id)
    final = seen["bpe"][1]
    assert final.round_trip.all() and len(final) == len(after)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(final)


def test_jaccard_wide_groups(spark):
    """What a group of changed copies shares counts as frequent beyond the prefixes by hash, so that too much changed copies meet nobody in long lists."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(1, 8)), replace=False):
            own[at] = f"x{i}_{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "_rid long, text string").withColumn("doc_id", F.col("_rid")).coalesce(1)
    told = {k for r in jaccard._digests(docs, 0).where("n < 0").collect() for k in r["often"]}
    sets = jaccard.shingle_sets(" ".join(base).encode(), np.array([0, len(" ".join(base))]))[0]
    assert set(sets.view(np.int64).tolist()) <= told
    # A set's own shingles stand first; past a ninth of all it can't link with a set of its size.
    frequent = np.sort(sets)
    own = np.setdiff1d(jaccard.shingle_sets(texts[0].encode(), np.array([0, len(texts[0])]))[0], frequent)
    whole = np.sort(np.concatenate([frequent[: 180 - len(own)], own]))
    n = len(whole)
    keys, reach = jaccard._keys(whole, frequent, 0)
    assert set(keys[: len(own)].tolist()) <= set(own.tolist())
    assert [r >= n for r in reach] == [p <= n - -(-8 * n // 9) for p in range(len(keys))]
    rows = [(1, s, n, reach, comp) for s, n, reach, comp in ((1, 100, 95, 1), (2, 100, 120, 2), (3, 94, 117, 2), (4, 94, 99, 4), (5, 90, 92, 2))]
    members = spark.createDataFrame(rows, "key long, s long, n long, reach long, comp long")
    fits = {a[1] for a in rows for b in rows if a[4] != b[4] and a[2] <= b[3] and b[2] <= a[3]}
    # Others are judged by size together, so some stay that fit none of them.
    assert fits <= {r["s"] for r in jaccard._reached(members, members).collect()} < {1, 2, 3, 4, 5}
