import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language_id, line_dedup, sentencepiece_codec, storage, token_store
from test_documents import brute_overlap, components, documents, shingles

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, WORDS, BYTES = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
SF = "/root/testdata/sf0.01"
ODD = ["", " ", "  a", "a ", "a  b ", "\n\t x", "é漢字😀", "x▁y", "▁▁", "a" * 300, "It's, a test... isn't?!", "1234 5.6", "<s> </s> <unk>", "ÀÉ é ﬁ", "<|endoftext|> x", "Ab\x1cd   z", None]


def whole_texts(n=400):
    import pyarrow.parquet as pq

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column("text").to_pylist()[:n]


def test_pieces_equal_the_library():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES)
    texts = ODD + whole_texts()
    for text, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == lib.encode(text or "")
        assert own.decode(ids) == (text or "").replace("▁", " ")


def test_sums_against_brute_force():
    """The unigram search, over the same pieces: no segmentation has a larger sum."""
    own, rng = sentencepiece_codec.Codec(PIECES), random.Random(1)
    names = {i: p for p in own._scores for i, _, _ in [own._automaton.get(p)]}
    for _ in range(200):
        part = "▁" + "".join(rng.choice("thearion漢") for _ in range(rng.randrange(0, 12)))
        best = [0.0] + [-1e300] * len(part)
        for j in range(1, len(part) + 1):
            ends = [best[i] + own._scores[part[i:j]] for i in range(j) if part[i:j] in own._scores]
            best[j] = max([best[j - 1] + own._cost, *ends])
        ids = own.search_sums(part)
        known = [i for i in ids if i in names]
        unknown = sum(c == "漢" for c in part) if "漢" not in own._scores else 0
        assert abs(sum(own._scores[names[i]] for i in known) + unknown * own._cost - best[-1]) < 1e-3
        assert own.decode(np.array(ids)) == part.replace("▁", " ")[1:]


def test_model_kind():
    assert sentencepiece_codec.is_merge_model(b"\x12\x02\x18\x02") and not sentencepiece_codec.is_merge_model(b"\x0a\x03\x0a\x01a\x12\x02\x18\x01")


def test_encode_and_decode_tables(spark):
    df = documents(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (3, "a ")])
    out = sentencepiece_codec.encode(df, PIECES)
    assert out.where("not round_trip").count() == 2  # the texts with the mark itself
    back = sentencepiece_codec.decode(out, PIECES).collect()
    assert sorted(r.text for r in back) == sorted([(t or "").replace("▁", " ") for t in ODD] + ["x", "a "])
    assert sentencepiece_codec.encode(df.limit(0), PIECES).count() == 0
    assert sentencepiece_codec.decode(spark.createDataFrame([(1, None), (2, [None, 13])], "doc_id long, ids array<int>"), PIECES).orderBy("doc_id").first().text is None


def test_words_equal_whole_texts():
    texts = pa.array(ODD + whole_texts(200), pa.string())
    by_word, whole = token_store.Encoder(WORDS, True), token_store.Encoder(WORDS, False)
    for _ in range(2):  # with what is remembered, too
        assert all(np.array_equal(a, b) for a, b in zip(by_word(texts), whole(texts), strict=True))


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 50, 5000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        index = token_store.PerfectHash.of(keys)
        assert sorted(index.slot(keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("vocabulary", [WORDS, BYTES])
def test_store(spark, monkeypatch, vocabulary):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SHARD_DOCS", 7)
    lib = Tokenizer.from_file(vocabulary)
    rows = [(i * 7 % 101, f"text {i} " * (i % 5)) for i in range(60)] + [(-5, None), (500, "repeated"), (500, "repeated"), (None, "null id"), (1 << 40, "ü")]
    df = documents(spark, rows)
    by_word = vocabulary == WORDS
    got = sorted(token_store.store_and_read(df, vocabulary, 2, by_word).collect(), key=lambda r: r.start)
    want, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    files = token_store.write(df, vocabulary, 2, by_word)
    asked = spark.createDataFrame([(500,), (-5,), (3,), (77777,), (None,), (1 << 40,)], "id long")
    found = {r.id: r.ids for r in token_store.lookup(files, asked).collect()}
    assert set(found) == {500, -5, 1 << 40} | ({3} & {r[0] for r in rows})
    assert found[-5] == [2] and found[500] == [*lib.encode("repeated", add_special_tokens=False).ids, 2]
    assert token_store.store_and_read(df.limit(0), vocabulary, 2, by_word).count() == 0


def test_store_splits_hot_keys(spark, monkeypatch):
    """A third of all rows without an id and a third of one id: many files, and each row once."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SHARD_DOCS", 5)
    monkeypatch.setattr(token_store, "LEAST_BYTES", 200)
    monkeypatch.setattr(token_store, "SEARCHED_FILES", 3)
    lib = Tokenizer.from_file(WORDS)
    rows = [(None, "same")] * 20 + [(None, f"text {i}") for i in range(20)] + [(7, f"seven {i % 9}") for i in range(40)] + [(i, f"own {i}") for i in range(10, 50)]
    files = token_store.write(documents(spark, rows).repartition(3), WORDS, 2, True)
    assert files.where("first is null").count() >= 4 and files.where("first = 7 and last = 7").count() >= 4 and files.agg(F.max("n_docs")).first()[0] <= 5
    got = sorted(token_store.read(files, 4).collect(), key=lambda r: r.start)
    want = sorted((i is not None, i or 0, zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert sorted((r.id is not None, r.id or 0, r.ids_crc32) for r in got) == want
    assert [(r.id is not None, r.id or 0) for r in got] == [w[:2] for w in want]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    asked = spark.createDataFrame([(i,) for i in (-1, 7, 7, 8, 10, 29, 49, 50)], "id long")
    found = token_store.lookup(files, asked).collect()
    first = next(r for r in got if r.id == 7)
    assert sorted(r.id for r in found) == [7, 7, 10, 29, 49]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == first.ids_crc32 for r in found if r.id == 7)


def test_key_access_reads_as_much_of_any_file():
    """The bytes read for one key do not grow with the file."""
    import io

    read = set()
    for n in (10, 1000, 40_000):
        keys = [None, *range(0, 3 * n, 3)]
        raw = token_store.shard_bytes(keys, [np.array([i % 1000, 2], np.uint16) for i in range(len(keys))], 2)
        for k in (0, 3 * (n // 2), 3 * n - 3):
            shard = token_store.Shard(io.BytesIO(raw))
            assert shard.find(k).tolist() == [(k // 3 + 1) % 1000, 2]
            read.add(shard.bytes_read)
        assert token_store.Shard(io.BytesIO(raw)).find(1) is None and token_store.Shard(io.BytesIO(raw)).find(3 * n) is None
    assert len(read) == 1


def languages(spark, n=300):
    """Three made-up languages of different letters, some rows without a label or a text."""
    rng = random.Random(2)
    parts = {"aa": ["ka", "mo", "li"], "bb": ["sch", "ung", "er"], "cc": ["ção", "nha", "lhe"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 60)))
        rows.append((i, text, lang if i % 10 else None))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "cc"), (1003, "k", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as key", "'x' as letters", "2 as buckets")


def test_languages(spark):
    df = languages(spark)
    model = language_id.fit(df.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    truth = {r.doc_id: r.lang for r in df.where("lang is not null and doc_id < 1000").collect()}
    held = [i for i in truth if i % 3 == 1]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 and not got[i].accepted for i in (1000, 1001, 1002))
    assert got[1003].lang_pred in ("aa", "bb", "cc") and all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.accepted}
    again = language_id.fit(df.where("doc_id % 3 <> 1").repartition(3))
    assert np.array_equal(again.table, model.table)
    nothing = language_id.fit(df.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0 and language_id.keep_accepted(df, nothing).count() == 0


def test_strange_texts_are_rejected(spark):
    """Gibberish and other scripts go; texts of the languages, of two of them, repeated ones and very long ones stay."""
    df = languages(spark)
    model = language_id.fit(df)
    rng = random.Random(5)
    strange = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(200)) for _ in range(15)]
    strange += ["Это предложение на другом языке", "漢字かな交じり文の例文です", "zxq wvk qjz xvz kqw zzx qvk"]
    real = [r.text for r in df.where("lang is not null and length(text) > 100").limit(12).collect()]
    mixed = [a + " " + b for a, b in zip(real[:6], real[6:], strict=True)]
    texts = strange + real + mixed + [real[0]] * 5 + [real[1] + " " + real[1] * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.accepted for r in language_id.predict(rows, model).collect()}
    assert not any(got[i] for i in range(len(strange)))
    assert all(got[i] for i in range(len(strange), len(texts)))


def test_sample_does_not_depend_on_order_or_copies(spark):
    df = languages(spark, 120)
    twice = df.unionByName(df).repartition(5)
    one, two = (language_id.fit(x) for x in (df, twice))
    assert one.languages == two.languages and np.array_equal(one.table, two.table) and one.accept == two.accept
    same_key = df.withColumn("doc_id", F.lit(1).cast("long"))
    assert np.array_equal(language_id.fit(same_key).table, language_id.fit(same_key.repartition(7)).table)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents(spark):
    """The query's held-out third of the test table: nearly all of its languages are named."""
    from lodestrata.llm.queries import op5_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = op5_language_id(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(held) > 300 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage in turn, on a fixture with copies, shared lines and test items."""
    import sentencepiece

    import corpus_pipeline

    rng = random.Random(11)
    vocab = {"aa": [f"ka{i}mo" for i in range(150)], "bb": [f"sch{i}ung" for i in range(150)]}
    rows, items = [], [(i, " ".join(rng.choice(vocab["aa"]) for _ in range(30))) for i in range(3)]
    for i in range(120):
        lang = "aa" if i % 2 else "bb"
        words = [rng.choice(vocab[lang]) for _ in range(rng.randrange(20, 90))]
        if i % 6 == 5:
            words = rows[i - 4][1].split("\n")[0].split()
            words[3] = "changed"
        text = " ".join(words) + ("\nSubscribe NOW " if i % 4 == 0 else "") + ("\n" + items[i % 3][1] if i % 10 == 7 else "")
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    rows += [(500, None, "aa", None, None), (501, "??", None, "src1", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    accepted = {r.doc_id for r in language_id.predict(docs, language_id.fit(docs)).where("accepted").collect()}
    assert accepted == set(range(120))
    texts = {r[0]: r[1] for r in rows if r[0] in accepted}
    key = lambda x: x.strip(" \t\r").lower()
    counts = {}
    for t in texts.values():
        for k in {key(x) for x in t.split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    texts = {i: "\n".join(x for x in t.split("\n") if not key(x) or counts[key(x)] < 10) for i, t in texts.items()}
    sets = {i: shingles(t) for i, t in texts.items()}
    roots = components(texts, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    texts = {i: t for i, t in texts.items() if roots[i] == i}
    texts = {i: t for i, t in texts.items() if not any(brute_overlap(t, x) for _, x in items)}
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: lib.encode(t) for i, t in texts.items()} and len(got) < 110
    stage = corpus_pipeline.own_lines(spark, docs, str(tmp_path))
    assert stage.columns == docs.columns and stage.where(F.col("n_chars") != F.length("text")).count() == 0


def test_shared_folder(spark):
    """The cluster's setting counts; without one, a folder of our own."""
    assert re.match("file:///", storage.shared_dir(spark))
    assert storage.materialise(spark.range(3), "x").count() == 3
    assert line_dedup.line_key(F.lit(" A ")) is not None
