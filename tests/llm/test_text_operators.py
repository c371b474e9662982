"""BPE, token files, chats, line dedup, mixing and quality statistics against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.llm import bpe, chat, line_dedup, mixing, quality, token_file, toxicity

ODD = ["", None, "  \n\t ", "don't we'll 'tis ''s", "<|endoftext|>x<|endof", "héé ß漢字 ١٢ ½\u00a0\u2003z", "a" * 3000, "word " * 500, " lead and trail \n\n", "\x00\x01\x85é", "🎉👩‍👧'll", "x\r\n\r\n  y"]


def documents(spark, texts, extra=False):
    rows = [(i if i % 7 else None if i == 7 else i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"_rid": F.lit("own"), "key": F.lit(1), "n": F.lit(2)}) if extra else df


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_bpe_is_the_librarys(spark, library):
    got = bpe.digest(documents(spark, ODD + ODD)).toPandas()
    want = []
    for t in ODD + ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(map(tuple, got[["n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False))) == Counter(want)


def test_bpe_words_need_exact_merging_sometimes(library):
    v = bpe.Vocabulary()
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aehinorst"), n)) for n in rng.integers(1, 30, 400)]
    for w in words:
        ids = v.greedy(w.encode())
        pairs = np.array(ids)
        good = v.compatible(pairs[:-1], pairs[1:]).all()
        exact = v.exact(w.encode())
        assert exact == library.encode(w, add_special_tokens=False).ids
        assert good == (ids == exact), w
    long_ = ("".join(rng.choice(list("abc"), 400))).encode()
    assert v.exact(long_) == library.encode(long_.decode(), add_special_tokens=False).ids


def test_bpe_round_trip_and_empty_table(spark):
    df = documents(spark, ODD)
    ids = bpe.encode_texts(df)
    back = bpe.decode_ids(ids, "ids", "back").select("text", "back").collect()
    assert all((r["text"] or "") == r["back"] for r in back)
    assert bpe.digest(df.limit(0)).count() == 0 and bpe.encoded(df.limit(0)).count() == 0
    assert bpe.encoded(documents(spark, ODD, True)).where("not round_trip").count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 40_000])
def test_token_frames_come_back(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, token_file.MOST_DISTINCT, n), rng.zipf(1.2, n) % 50_257, np.zeros(n)):
        ids = ids.astype(np.uint32)
        packed = token_file.pack(ids)
        assert (token_file.unpack(packed) == ids).all()
    if n > 1000:
        broken = bytearray(token_file.pack(rng.integers(0, 50_000, n).astype(np.uint32)))
        broken[len(broken) // 2] ^= 64
        with pytest.raises(ValueError):
            token_file.unpack(bytes(broken))


def test_token_file_digest(spark, library):
    df = documents(spark, ODD + ["more"] * 3)
    got = token_file.digest(df).orderBy("start").collect()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"]) for r in df.fillna("", "text").collect())
    want = Counter()
    for (_, doc), text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want[(len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)
    assert token_file.digest(df.limit(0)).count() == 0
    assert token_file.read(token_file.write(df)).count() == len(rows)


def test_chats_read_back(spark):
    nasty = ["\\### Assistant: </turn> ok", "<|end|>\n<|turn:user\n", "a\\b<\\p|", "", None, "\\", "<", "|end|>"]
    rows = [(c, i, ("user", "assistant", "assistant", None, "sy\nstem<|")[(i + c) % 5], nasty[(i * 3 + c) % 8]) for c in range(6) for i in range(7)] + [(None, None, "assistant", "x"), (9, 0, "user", "same"), (9, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(df.withColumn("turns", F.lit(1))).collect()}
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    for c in range(6):
        own = table[table.conv_id == c].sort_values("turn")
        texts = [t or "" for t in own.text]
        text = "".join(f"{r or ''}\n{t}\n" for r, t in zip(own.role, texts))
        loss = "".join(t for r, t in zip(own.role, texts) if r == "assistant")
        assert got[c]["n_turns"] == 7 and got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[9]["n_turns"] == 2 and got[None]["n_turns"] == 1
    one = chat.format_chats(df.where("conv_id = 9")).first()["formatted"]
    assert one == "<|turn:user\nsame<|more|>same<|end|>\n"
    assert chat.digest(df.limit(0)).count() == 0


def plain_line_dedup(rows):
    seen, out = set(), []
    for doc, text in rows:
        if text is None:
            out.append((doc, None))
            continue
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not re.search(r"[^\x20\x09-\x0D]", "".join(w)):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb\nc\nd\na\nb\nc", "a\nb", "", None, "\n\n\n\n", "p\n" * 6, "q\na\nb\nc\nd\nz", "\n".join("abcd") * 1] + ["same\nthree\nlines"] * 5
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id long, text string, lines int, pos string").repartition(3).orderBy("doc_id")
    got = line_dedup.dedup_lines(df)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect())) == sorted(plain_line_dedup(rows))
    assert {r["lines"] for r in got.collect()} == {3}
    assert line_dedup.digest(df.limit(0)).count() == 0
    twins = spark.createDataFrame([(1, "a\nb\nc")] * 4 + [(None, "a\nb\nc")], "doc_id long, text string").coalesce(1)
    assert sorted(r["n_removed"] for r in line_dedup.digest(twins).collect()) == [0, 3, 3, 3, 3]


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 11 else None, ("big" if i % 3 else f"s{i % 5}") if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("own"))
    got = mixing.digest(df).toPandas()
    source = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    got = got.merge(source, on="doc_id")
    got["source"] = got["source"].fillna("~null")
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by.index))}
    target, open_, left = {}, set(by.index), 1.5 * by["size"].sum()
    while True:  # share again until none is above
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * by["size"][s]}
        if not full:
            target |= {s: level * weights[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * by["size"][s]
            left -= target[s]
        open_ -= full
    for s, t in target.items():
        assert by["target"][s] == pytest.approx(t) and abs(by["taken"][s] - t) <= mixing.PACKET
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.digest(df.repartition(7)).toPandas().set_index("doc_id")["taken"]
    assert (again.sort_index().to_numpy() == got.set_index("doc_id")["taken"].sort_index().to_numpy()).all()
    out = mixing.mixed(df).toPandas()
    words = out["text"].str.findall(r"[^\x20\x09-\x0D]+").str.len().sum()
    assert words == got["taken"].sum()
    assert mixing.digest(df.limit(0)).count() == 0


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, rep, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if n[x] > 1:
            rep.update(range(i, i + 5))
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep)


def test_quality_statistics_and_verdicts(spark):
    texts = [*ODD, "a b c d e f a b c d e", "x\nx\n \n \nx \nx", "a a a a a a a", "é # é\né # é", "l1\r\nl1\r\nl1"]
    got = quality.statistics(documents(spark, texts)).collect()
    names = quality.COUNTS[:5]
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(map(plain_counts, texts))
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 80)) if i % 10 else " ".join(w + "#$" for w in rng.choice(words, 80))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(300)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.digest(docs, labels).collect()}
    good = [kept[i] for i in range(300, 600) if i % 10]
    assert np.mean(good) > 0.97 and not any(kept[i] for i in range(300, 600, 10))
    assert quality.digest(docs.limit(0), labels).count() == 0
    assert quality.digest(docs, labels.limit(0)).where("kept").count() == 600


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeinrstl"), rng.integers(2, 8))) for _ in range(500)]
    rows = []
    for i in range(900):
        own = list(rng.choice(words, int(rng.integers(5, 200))))
        if i % 4 == 0:
            for _ in range(max(1, len(own) // 40)):
                own.insert(int(rng.integers(0, len(own))), str(rng.choice(["zquork", "Vlimp", "zquorks"])))
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows + [(None, None), (5000, "")], "doc_id long, text string").withColumn("toxic", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = toxicity.digest(docs, labels).toPandas()
    assert got["score"].between(0, 1).all() and len(got) == 902
    for r in got.dropna().itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 3 == 1)
    held = got[got.held_out & (got.doc_id < 900)]
    truth = held.doc_id % 4 == 0
    assert (held.predicted[truth] == 1).mean() > 0.9 and (held.predicted[~truth] == 1).mean() < 0.02
    assert (toxicity.digest(docs, labels.where("toxic = 0"))).where("predicted = 1").count() == 0
    assert toxicity.digest(docs.limit(0), labels).count() == 0
