"""Operators whole: other parallelism between scans, clashing names, long texts, and each method's own step."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import bpe, chat, jaccard, line_dedup, mixing, quality, shared, token_file, topk, toxicity, url_filter
from test_search_operators import corpus, plain_components
from test_text_operators import documents, plain_counts, plain_line_dedup

OWN = ("_rid", "doc", "_size", "_struck", "struck", "_toxic", "lines", "n_lines", "n_removed", "taken", "finish", "pass", "name", "size", "set_id", "n", "_part", "range", "_metadata")


@pytest.fixture
def shaken(spark, monkeypatch):
    """Each written table changes how the next scans are split."""
    plain, turn = shared.written, [0]

    def written(df, name):
        out = plain(df, name)
        turn[0] += 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", ("2k", "128m")[turn[0] % 2])
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        return out

    monkeypatch.setattr(shared, "written", written)
    yield
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Documents with ties, nulls and repeated rows, in several row groups of several files."""
    rows = [(i % 80 if i % 9 else None, t + "\nshared one\nshared two\nshared three" if t and i % 3 == 0 else t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in corpus(3, 25)]
    path = str(tmp_path_factory.mktemp("whole") / "documents.parquet")
    spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.option("parquet.block.size", "4096").parquet(path)
    return path


def table(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("operator", [line_dedup.digest, mixing.digest, jaccard.digest, line_dedup.dedup_lines, jaccard.deduplicated, mixing.mixed], ids=lambda f: f.__module__ + f.__name__)
@pytest.mark.parametrize("plain_scan", [True, False])
def test_results_outlast_other_splits(spark, files, shaken, operator, plain_scan):
    docs = spark.read.parquet(files)
    docs = docs if plain_scan else docs.unionByName(docs.limit(0))
    first = operator(docs)
    rows = table(first)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    assert table(first) == rows
    again = table(operator(docs))
    # Rows that aren't a plain scan's are numbered as they come, which decides ties.
    assert again == rows if plain_scan else len(again) == len(rows) or operator is mixing.mixed


@pytest.mark.parametrize("operator", [lambda d: line_dedup.dedup_lines(d, counts=False), jaccard.deduplicated, mixing.mixed], ids=["lines", "jaccard", "mixing"])
def test_clashing_columns_pass(spark, operator):
    df = documents(spark, ["a b c d e f g\nx\ny", "a b c d e f g\nx\ny", "p\nq\nr\ns", None, ""]).withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))) for c in OWN})
    out = operator(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert all(r[c] == f"{c}-{r['doc_id'] if r['doc_id'] is not None else '~'}" for c in OWN)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty texts, ties, clashing names, a long text, no rows and no labels."""
    rows = [(1, "a b c d e f g h\nl2\nl3\nl4"), (1, "a b c d e f g h\nl2\nl3\nl4"), (None, "own words only here now"), (2, None), (3, ""), (4, "w " * 700_000), (5, " \n ")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _toxic string, _rid string"
    docs = spark.createDataFrame([(d, t, None, "s" if d else None, 7, "own", "own") for d, t in rows], schema)
    for name, table_, labels in (("full", docs, [(1, 0), (None, 1)]), ("none", docs.limit(0), [])):
        path = str(tmp_path / name)
        table_.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES:
            now = shared.written(f(spark, now, path), stage)
            if stage != "bpe":
                assert now.columns == docs.columns and now.where("_toxic <> 'own' or _rid <> 'own'").isEmpty()
        assert now.where("not round_trip").isEmpty() and (now.count() > 0) == (name == "full")
        if name == "full":
            assert {r["doc_id"] for r in now.collect()} >= {1, 4}


def test_long_texts(spark):
    """A text of two megabytes beside short ones, through every operator of documents."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(4000)]
    long = "\n".join(" ".join(rng.choice(words, 12)) for _ in range(28_000))
    rows = [(1, long), (2, long + " one more"), (3, "short\ntext"), (4, "\n".join(long.split("\n")[5:9]))]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.digest(docs).collect()) == sorted(plain_line_dedup(rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.digest(docs).collect()} == {d: (n, c) for d, n, c in plain_components(rows)}
    assert {r["doc_id"]: tuple(r[c] for c in quality.COUNTS[:5]) for r in quality.statistics(docs).collect()} == {d: plain_counts(t) for d, t in rows}
    assert bpe.encoded(docs).where("round_trip").count() == 4
    tokens = {r["doc_id"]: r["n_tokens"] for r in bpe.digest(docs).collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_file.digest(docs).collect()} == {d: n + 1 for d, n in tokens.items()}
    taken = mixing.digest(docs).toPandas()
    assert taken["taken"].sum() == int(1.5 * taken["size"].sum() + 1e-6)
    assert mixing.mixed(docs).select(F.sum(mixing.n_words(F.col("text")))).first()[0] == taken["taken"].sum()


def test_long_conversations(spark):
    turns = spark.range(6000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|t"), F.col("id").cast("string")).alias("text"))
    got = chat.digest(turns).first()
    loss = "".join(f"<|t{i}" for i in range(6000) if i % 3)
    assert got["n_turns"] == 6000 and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_mix_is_cut_in_the_queues_order(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 900))), f"s{i % 7}" if i % 13 else None) for i in range(300)]
    numbered = shared.numbered(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sizes, goals = mixing._prepared(numbered, mixing.WEIGHTS, mixing.BUDGET, mixing.PASSES)
    q = mixing.queue(sizes, goals).toPandas().sort_values(["finish", "place", "name"])
    whole = (q["taken"] == q["words"]).to_numpy()
    cut = int(np.argmin(whole))  # the first packet that isn't taken whole
    assert 0 < cut < len(q) and whole[:cut].all() and (q["taken"].to_numpy()[cut + 1 :] == 0).all()
    assert q["taken"].sum() == int(1.5 * q[q["pass"] == 0]["words"].sum() + 1e-6)
    served = q.groupby("name")["taken"].sum()
    for r in goals.collect():
        assert abs(served.get("" if r["source"] is None else f"={r['source']}", 0) - r["target"]) <= mixing.PACKET
    assert (q["words"] <= mixing.PACKET).all()


def test_mix_comes_in_order(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 30, f"s{i % 3}") for i in range(90)], "doc_id long, text string, source string")
    mixed = mixing.mixed(docs).collect()
    first, again = {}, {}
    for i, r in enumerate(mixed):
        (again if r["doc_id"] in first else first)[r["doc_id"]] = i
    by_source = {s: [i for i, r in enumerate(mixed) if r["source"] == s] for s in ("s0", "s1", "s2")}
    # Sources take turns all along, and nobody's second turn comes before the source's first round is over.
    assert all(max(v) > 0.7 * len(mixed) and min(v) < 0.1 * len(mixed) for v in by_source.values())
    for s in by_source:
        own = [d for d in again if d % 3 == int(s[1])]
        if own:
            assert min(again[d] for d in own) > max(first[d] for d in range(int(s[1]), 90, 3))


def test_many_sources_have_targets(spark):
    sizes = spark.range(500).select(F.concat(F.lit("h"), F.format_string("%04d", "id")).alias("source"), (F.col("id") % 17 + 1).alias("size"))
    got = mixing.targets(sizes).toPandas().sort_values("source").reset_index(drop=True)
    assert got["target"].sum() == pytest.approx(1.5 * got["source_size"].sum())
    assert (got["target"] <= 2 * got["source_size"] + 1e-9).all()
    level = (got["target"] / np.array([(3, 1, 2)[i % 3] for i in range(500)]))[got["target"] < 2 * got["source_size"] - 1e-9]
    assert len(level) and level.max() == pytest.approx(level.min())


def test_threshold_rises_block_by_block():
    rng = np.random.default_rng(2)
    vectors = np.floor(256 * rng.normal(0, 1, (4000, 64)) * (0.95 ** np.arange(64))).astype(np.int64)
    ids, query = np.arange(4000), vectors[7]
    chunk = topk.Chunk(vectors, ids)
    scores = vectors @ query
    want = sorted(((-int(s), int(i)) for i, s in zip(ids, scores) if i != 7))[:5]
    x, s, touched = topk.best(query, 7, chunk, 5)
    assert [(-int(b), int(a)) for a, b in zip(x, s)] == want
    assert touched[0] == 3999 and all(a >= b for a, b in zip(touched, touched[1:])) and sum(touched) < 0.4 * 3999 * len(touched)
    # A threshold from an earlier chunk leaves less to do and nothing else.
    y, t, fewer = topk.best(query, 7, chunk, 5, float(s[-1]))
    assert list(y) == list(x) and list(t) == list(s) and sum(fewer) < sum(touched)
    # Masses beyond exact doubles go through whole numbers.
    big = vectors * (1 << 19)
    z, u, _ = topk.best(big[7], 7, topk.Chunk(big, ids), 5)
    assert list(z) == list(x) and [int(v) for v in u] == [int(v) << 38 for v in s]


def test_listed_hosts_are_given(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.x/p") for i in range(200)] + [(900, None)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.x",) for i in range(0, 40, 3)] + [("elsewhere.y",), (None,), ("h0.x",)], "host string")
    want = {i: "block" if (i % 40) % 3 == 0 else "allow" for i in range(200)} | {900: "allow"}
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules=(), listed=listed).collect()} == want
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules=(), listed=listed.limit(0)).collect()} == {"allow"}
    # With the first salt all hosts have one of two hashes, so listed and other ones meet.
    plain = url_filter.key_hash
    monkeypatch.setattr(url_filter, "key_hash", lambda host, salt: plain(host, salt) if salt else F.length(host).cast("long"))
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules=(), listed=listed).collect()} == want


def test_frames_are_smaller_than_deflate(library_ids):
    ids = library_ids
    for lanes in (token_file.LANES, 64):
        packed = token_file.pack(ids)
        block = int(min(token_file.MOST_BLOCK, max(token_file.LEAST_BLOCK, -(-len(ids) // token_file.LANES))))
        deflated = sum(len(zlib.compress(ids[i : i + block].astype("<u2").tobytes(), 6)) for i in range(0, len(ids), block))
        assert len(packed) < 0.9 * deflated
    assert (token_file.unpack(packed) == ids).all()


@pytest.fixture(scope="module")
def library_ids():
    """Ids of text whose words have Zipf's frequencies."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstuvw"), int(n))) for n in rng.integers(2, 9, 3000)]
    text = " ".join(words[i] for i in np.minimum(rng.zipf(1.3, 60_000) - 1, 2999)).encode()
    return bpe.encoder().encode(text, np.array([0, len(text)]))[0].astype(np.uint32)


def plain_buckets(text, k):
    low = [c if len(c) != 1 else c for c in (" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in text)]
    out = []
    for i in range(len(low) - k + 1):
        h = ord(low[i]) + 1
        for c in low[i + 1 : i + k]:
            h = (h * 1_000_003 + ord(c)) % 2**64
        out.append(((h * 0x9E3779B97F4A7C15) % 2**64) >> (64 - toxicity.BITS))
    return out


def test_toxicity_scores_by_the_definition(spark):
    """The model's features and scores against plain loops over the texts."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinrstl"), 5)) for _ in range(200)]
    rows = [(i, " ".join([*rng.choice(words, 30), *(["Vlimp É"] * (i % 3 == 0))])) for i in range(240)] + [(990, None), (991, ""), (3, "repeated row"), (3, "repeated row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n0", F.lit("own"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    got = sorted((r["doc_id"], r["text"] or "", r["score"]) for r in toxicity.scored(docs, model).collect())
    assert len(got) == len(rows)
    for _, text, score in got:
        grams = [b for k in toxicity.LENGTHS for b in plain_buckets(text, k)]
        margin = model.bias + model.slope * sum(weight.get(b, 0.0) for b in grams) / (len(grams) + toxicity.DAMPING)
        assert score == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-4, abs=1e-6)
    # Kept features are those whose shares of texts differ most; their scale has the sign of the log-count ratio.
    train = [(t, i % 3 == 0) for i, t in rows[:240] if zlib.crc32(str(i).encode()) % 3 != 1]
    train += [(t, True) for i, t in rows[242:] if zlib.crc32(str(i).encode()) % 3 != 1]
    seen = Counter((b, toxic) for t, toxic in train for k in toxicity.LENGTHS for b in set(plain_buckets(t, k)))
    n = {c: sum(1 for _, toxic in train if toxic == c) for c in (True, False)}
    r1, r0 = ({b: seen[b, c] / n[c] for b in model.buckets.tolist()} for c in (True, False))
    top = max(model.buckets.tolist(), key=lambda b: abs(r1[b] - r0[b]))
    assert r1[top] > 0.9 and r0[top] < 0.1
    none = toxicity.digest(docs, labels.limit(0)).toPandas()
    assert (none["predicted"] == 0).all() and len(none) == len(rows)


def plain_path(tree, x, usual):
    feature, split, path = tree
    at = 0
    while feature[at] >= 0:
        at = 2 * at + 1 + int(x[feature[at]] >= split[at])
    return path[at]


def test_quality_verdicts_by_the_definition(spark):
    """Verdicts against path lengths walked one by one, and the threshold on labels that weren't fitted."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 80)) if i % 10 else " ".join(w + "#$" for w in rng.choice(words, 80))) for i in range(500)] + [(7, "same again " * 9)] * 2 + [(None, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("own"), "n_words": F.lit("own")})
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(250)], "doc_id long, quality int")
    stats = shared.written(quality.statistics(docs), "stats")
    forest, cut = quality.fit(stats, labels)
    got = quality.judged(docs, labels).toPandas()
    assert len(got) == len(rows)
    x = quality.features(got)
    for i in rng.choice(len(got), 60, replace=False):
        mean = np.mean([plain_path(t, x[i], forest.usual) for t in forest.trees])
        anomaly = 2 ** (-mean / forest.usual)
        r = got.iloc[i]
        assert r["anomaly"] == pytest.approx(anomaly)
        assert r["kept"] == (r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"] and anomaly <= cut)
    fresh = got[(got["doc_id"] >= 250) & (got["doc_id"] < 500)]
    good = fresh["doc_id"] % 10 > 0
    assert fresh["kept"][good].mean() > 0.97 and fresh["kept"][~good].mean() < 0.05


def test_quality_is_fitted_on_all_labelled_rows(spark):
    """Leaves hold every good row, however many and however spread, and the threshold is the best over all scores."""
    n = 21_000
    stats = shared.written(spark.range(n).selectExpr("id AS doc_id", *(f"CAST(100 + pmod(hash(id, {i}), {50 if i < 2 else 9}) AS LONG) AS {c}" if c != "n_repeat_words" else f"0L AS {c}" for i, c in enumerate(quality.COUNTS))).repartition(5), "stats")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 7 > 0 AS INT) AS quality")
    forest, cut = quality.fit(stats, labels)
    rows = stats.toPandas()
    good = (rows["doc_id"] % 7 > 0).to_numpy()
    assert forest.usual == pytest.approx(2 * (np.log(good.sum() - 1) + 0.5772156649) - 2 * (good.sum() - 1) / good.sum())
    score = forest.scores(quality.features(rows))
    worth = {x: (score[~good] > x).mean() - 5 * (score[good] > x).mean() for x in np.unique(score)[-400:] if (score[good] > x).mean() <= quality.CLEAN_LOSS}
    assert (score[~good] > cut).mean() - 5 * (score[good] > cut).mean() == pytest.approx(max(worth.values()))


def test_frequent_shingles_are_counted_over_tasks():
    counts = jaccard._Counts()
    a, b = np.arange(0, 4000, 4, dtype=np.uint64), np.arange(0, 4000, 8, dtype=np.uint64)
    for i, s in enumerate((a, a, b)):
        counts.add(s, bytes([i // 2]) * 16)  # the second is a copy of the first
    each, times = counts.repeated()
    assert set(each.tolist()) == set(a[: jaccard._prefix(len(a))].tolist()) & set(b[: jaccard._prefix(len(b))].tolist()) and (times == 2).all()
    assert counts.held == 0 and not counts.seen


def test_frames_take_few_steps(library_ids, monkeypatch):
    """Frequent pairs are coded at once: the coder's work is by symbol, in packing and in unpacking."""
    coded, plain = [], token_file._Model.predict
    monkeypatch.setattr(token_file._Model, "predict", lambda model: (coded.append(model.n), plain(model))[1])
    packed = token_file.pack(library_ids)
    assert sum(coded) < 0.7 * len(library_ids)
    coded.clear()
    assert (token_file.unpack(packed) == library_ids).all()
    assert sum(coded) < 0.7 * len(library_ids)


def test_pairs_of_any_alphabet_come_back():
    full = np.arange(token_file.MOST_DISTINCT)
    for ids in (np.concatenate([full, np.tile([5, 6, 7], 3000)]), np.concatenate([full[:-9], np.tile([5, 6, 7, 8, 9, 1], 9000)]), np.arange(9001) % 2 * 99_999, np.tile([1, 1, 1, 2], 70_000)):
        assert (token_file.unpack(token_file.pack(ids.astype(np.uint32))) == ids).all()


def test_any_damage_of_a_frame_is_seen(library_ids):
    ids = library_ids[:30_000]
    packed = token_file.pack(ids)
    for at in [*range(8, 40), len(packed) // 2]:
        broken = bytearray(packed)
        broken[at] ^= 16
        with pytest.raises(ValueError):
            token_file.unpack(bytes(broken))
    for end in (20, 200, len(packed) - 1):
        with pytest.raises(ValueError):
            token_file.unpack(packed[:end])


def test_library_is_asked_in_running_text():
    enc, asked = token_file.LibraryEncoder(), []

    class Library:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **how)

    plain, enc.library = enc.library, Library()
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("aeinrst"), 6)) for _ in range(2000))]
    texts += ["", " ", "a b  c", "don't 'll  've 's", "\x1c \x1cz", " <|endoftext|> a<|endoftext|>b", " \x85a \xa0\u2003q \u3000w \u1680", "1 2 33 a1 !? ,", "\u65e5\u672c \u8a9e \xe9t\xe9"]
    texts += ["".join(rng.choice(list(" \t\n  \x1c\x85\xa0\u2003'sLl1\xe9\u65e5!ve<|>"), 30)) for _ in range(100)]
    data = [t.encode() for t in texts]
    flat, at = enc.encode(b"".join(data), np.cumsum([0, *map(len, data)]))
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(asked) < 500  # there are some 2,000 distinct words
