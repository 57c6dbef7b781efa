"""Operators on texts beside brute force, and the cases every operator has to take."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gladeline.llm import fmindex, language, packing, quality, records, simhash, tokencounts
from gladeline.llm.tokens import default_path, document_ids
from tests.llm.conftest import ODD

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def odd(documents):
    """Odd texts, twice under other ids, once under no id, and one row repeated."""
    all_rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)]
    return documents(all_rows + [(100 + i, t, "fr") for i, t, _ in all_rows] + [(None, t, None) for t in ODD] + [(4, "word", "en")])


@pytest.fixture(scope="module")
def none(documents):
    return documents([(1, "x", "en")]).limit(0)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


# tokens, packing, records


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(5)
    letters = "abcXYZéÉñß'’.,!?-_$%| \n\t ́ İΣσ1²漢😀<|>"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(400)] + [t or "" for t in ODD]
    ids, at = document_ids(default_path(), pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain_ids(tokenizer, t), t[:50]


def test_pieces_fill_windows_and_hold_every_id_once(odd, tokenizer):
    packed = rows(packing.pack(odd, width=64).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"))
    ends = {}
    for _, _, n, ids, _, seq, offset in packed:
        assert len(ids) == 4 * n and offset + n <= 64
        ends.setdefault(seq, []).append((offset, n))
    for seq, found in ends.items():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at == 64 or seq == max(ends)
    assert sorted(ends) == list(range(len(ends)))
    by_id = {}
    for doc_id, start, n, ids, total, seq, _ in packed:
        if doc_id is not None and doc_id != 4:
            by_id.setdefault(doc_id, []).append((start, np.frombuffer(ids, "<u4").tolist(), total, seq))
    for i, text in enumerate(ODD):
        for doc_id in {i, 100 + i} - {4}:
            parts = sorted(by_id[doc_id])
            assert sum((p[1] for p in parts), []) == plain_ids(tokenizer, text)
            assert [p[3] for p in parts] == list(range(parts[0][3], parts[0][3] + len(parts)))


def test_packing_an_empty_table(none):
    assert rows(packing.pack(none)) == []


def test_records_come_back_in_order(odd, tokenizer):
    got = sorted(rows(records.round_trip(odd)), key=lambda r: r[1])
    assert [r[0] for r in got[: len(ODD)]] == [None] * len(ODD)
    known = [r[0] for r in got[len(ODD) :]]
    assert known == sorted(known) and len(known) == 2 * len(ODD) + 1
    at = 0
    for doc_id, start, n, ids in got:
        assert (start, 4 * n) == (at, len(ids))
        at += n
        if doc_id is not None:
            assert np.frombuffer(ids, "<u4").tolist() == plain_ids(tokenizer, ODD[doc_id % 100])


def test_single_records_by_index_and_damage(spark, odd, tmp_path):
    manifest = rows(records.write_records(odd, str(tmp_path / "out"), shard_bytes=2000))
    assert len(manifest) > 3
    folder = f"{tmp_path}/out"
    for _, _, shard, n, tokens in manifest[:4]:
        assert sum(len(records.read_record(folder, shard, i)[1]) for i in reversed(range(n))) == tokens
    path = f"{folder}/{manifest[0][2]}.rec"
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(records.DamagedRecord):
        records.read_record(folder, manifest[0][2], 0)


def test_records_of_an_empty_table(none):
    assert rows(records.round_trip(none)) == []


def test_frame_is_as_described():
    length = b"\x03" + bytes(7)
    mask = lambda x: ((((c := zlib.crc32(x)) >> 15) | (c << 17)) + 0xA282EAD8) % 2**32
    assert records.frame(b"abc") == length + mask(length).to_bytes(4, "little") + b"abc" + mask(b"abc").to_bytes(4, "little")


# token counts


def best_count(scores, word):
    """Pieces of the best segmentation by trying all, from the end."""
    low, memo = min(scores.values()) - 1, {}

    def best(end):
        if end == 0:
            return (0.0, 0)
        if end not in memo:
            n = len(word[end - 1].encode())
            options = [(best(end - 1)[0] + n * low, -best(end - 1)[1] - n)]
            options += [(best(b)[0] + scores[word[b:end]], -best(b)[1] - 1) for b in range(max(0, end - 16), end) if word[b:end] in scores]
            top = max(options)
            memo[end] = (top[0], -top[1])
        return memo[end]

    for end in range(len(word)):  # from the front, so that no word is too long for the call stack
        best(end)
    return best(len(word))[1]


def test_counts_equal_the_best_segmentation(spark, odd):
    scores = tokencounts.read_scores(tokencounts.default_path())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r[0]: r[1:] for r in rows(tokencounts.token_counts(docs))}
    for doc_id, text in docs.filter("doc_id < 25").collect():
        words = re.split(r"[ \t\n\v\f\r]+", text.strip(" \t\n\v\f\r"))
        assert got[doc_id] == (len(words), sum(best_count(scores, "▁" + w) for w in words))
    strange = {r[0]: r[1:] for r in rows(tokencounts.token_counts(odd))}
    assert strange[0] == strange[1] == strange[2] == (0, 0)
    assert strange[8][1] == sum(best_count(scores, "▁" + w) for w in re.split(r"[ \t\n\v\f\r]+", ODD[8]))
    assert strange[10][1] == sum(best_count(scores, "▁" + w) for w in re.split(r"[ \t\n\v\f\r]+", ODD[10]))


@pytest.mark.parametrize("narrow, step", [(1, 3), (1, 256), (5, 4), (48, 256), (10_000, 256), (10_000, 1)])
def test_trie_of_long_words_equals_the_best_segmentation(monkeypatch, narrow, step):
    """Words with long common beginnings, letters of one to four bytes, ends at every depth; any split of the work."""
    monkeypatch.setattr(tokencounts, "NARROW", narrow)
    monkeypatch.setattr(tokencounts, "STEP", step)
    rng = random.Random(3)
    scores = {"".join(rng.choices("abé▁字", k=rng.randrange(1, 7))): -rng.randrange(2, 9) * 0.5 for _ in range(60)}
    words = {"".join(rng.choices("abé字😀", k=rng.randrange(1, 40))) for _ in range(40)}
    words |= {w[: rng.randrange(1, len(w) + 1)] + "".join(rng.choices("ab字", k=rng.randrange(300))) for w in list(words)}
    words = sorted(words, key=lambda w: rng.random())
    got = tokencounts.PieceCounter(scores).counts(pa.array(words))
    assert got.tolist() == [best_count(scores, "▁" + w) for w in words]


def test_long_texts_without_spaces():
    scores = {"▁": -1.0, "ab": -1.0, "abab": -1.5, "b": -1.2}
    words = ["ab" * 40_000, "ab" * 40_000 + "c", "ab" * 20_000 + "b"]
    assert tokencounts.PieceCounter(scores).counts(pa.array(words)).tolist() == [20_001, 20_002, 10_002]


def test_counts_of_an_empty_table(none):
    assert rows(tokencounts.token_counts(none)) == []


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints):
    home = {}

    def root(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    found = sorted(set(fingerprints))
    for i, a in enumerate(found):
        for b in found[:i]:
            if (a ^ b).bit_count() <= 3:
                home[root(a)] = root(b)
    return {f: root(f) for f in found}


def test_components_equal_brute_force(spark, odd):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = base.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    given = docs.collect()
    prints = [plain_fingerprint(t) for _, t in given]
    homes = plain_components(prints)
    smallest = {}
    for (doc_id, _), f in zip(given, prints):
        if doc_id is not None:
            smallest[homes[f]] = min(doc_id, smallest.get(homes[f], doc_id))
    expected = sorted((doc_id is None, doc_id or 0, f"{f:016x}", smallest.get(homes[f])) for (doc_id, _), f in zip(given, prints))
    got = sorted((a is None, a or 0, b, c) for a, b, c in rows(simhash.near_duplicates(docs)))
    assert got == expected


def test_crowded_blocks_are_cut_finer_and_lose_no_link(spark):
    rng = random.Random(3)
    # a crowd within few bits of one fingerprint, far more than a bucket holds, and strangers
    crowd = {0x0123456789ABCDEF}
    while len(crowd) < 500:
        crowd.add(rng.choice(list(crowd)) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    crowd |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in crowd]
    links = [tuple(r) for r in simhash.near_links(spark.createDataFrame(signed, "fp long"), bucket=16).collect()]
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(a) ^ unsigned(b)).bit_count() <= 3 for a, b in links)
    home = {}

    def root(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for a, b in links:
        home[root(unsigned(a))] = root(unsigned(b))
    expected = plain_components(crowd)
    groups = lambda f: sorted(sorted(x for x in crowd if f(x) == r) for r in {f(x) for x in crowd})
    assert groups(root) == groups(expected.get)


def test_majority_over_many_hashes():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 255, 256, 3000, 0])
    hashes = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got, at = simhash.majority(hashes, counts), 0
    for f, n in zip(got.tolist(), counts.tolist()):
        own, at = hashes[at : at + n].tolist(), at + n
        assert f == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)


def test_keep_one_keeps_the_smallest_id_and_all_columns(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {tuple(r) for r in kept.select("__id", "__no", "__hash", "__kept", "__mix").collect()} == {(6, 4, 33, 12, 11)}
    found = kept.select("doc_id", "text").collect()
    assert sorted(r[0] for r in found if r[1] in (None, "", " \n\t ")) == [0]
    assert sorted(r[0] for r in found if r[1] == "word") == [4]
    assert all(r[0] is not None for r in found)
    assert rows(simhash.keep_one(none)) == [] and rows(simhash.near_duplicates(none)) == []


def test_keep_one_without_ids(documents):
    assert simhash.keep_one(documents([(None, "only here", "en"), (None, "only here", "en")])).count() == 1


# decontamination


def plain_contamination(texts, items, window=13):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    phrases = {}
    for item, text in items:
        words = split(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            phrases.setdefault(tuple(words[i : i + window]), set()).add(item)
    out = []
    for text in texts:
        words = split(text)
        hit, found = set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(words) - n + 1):
                if (own := phrases.get(tuple(words[i : i + n]))) is not None:
                    found |= own
                    hit |= set(range(i, i + n))
        out.append((len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_shard_search_equals_brute_force(seed):
    rng = random.Random(seed)
    kinds = rng.randrange(1, 5)
    make = lambda most: " ".join(rng.choices("abcdé"[:kinds], k=rng.randrange(most)))
    texts = [make(80) for _ in range(6)]
    texts += texts[:2]
    items = [(str(i), make(25)) for i in range(5)]
    got = fmindex.Found([pa.RecordBatch.from_pydict({"text": texts})], [fmindex.Phrases(items, 4)])
    assert list(zip(got.n_words.tolist(), got.n_hit.tolist(), got.items)) == plain_contamination(texts, items, 4)
    for text, n, spans in zip(texts, got.n_hit.tolist(), got.spans):
        assert sum(s["end"] - s["first"] for s in spans) == n


def test_benchmark_in_blocks_and_odd_rows(spark, odd, none, monkeypatch):
    bench = [(1, "Word"), (2, None), (None, "two words"), (2, "ab " * 14), (3, "..."), (10, "two words")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    given = odd.select("doc_id", "text").collect()
    expected = sorted(
        (i is None, i or 0, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0 and 20 * h >= n)
        for (i, _), (n, h, f) in zip(given, plain_contamination([t for _, t in given], bench))
    )
    for block, cut in ((fmindex.BLOCK_BYTES, fmindex.ITEM_BYTES), (10, fmindex.ITEM_BYTES), (40, 20)):
        monkeypatch.setattr(fmindex, "BLOCK_BYTES", block)
        monkeypatch.setattr(fmindex, "ITEM_BYTES", cut)
        got = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in rows(fmindex.contamination(odd, items)))
        assert got == expected
    clean = fmindex.keep_clean(odd, items)
    assert clean.columns == odd.columns
    assert clean.count() == sum(not r[-1] for r in expected)
    assert rows(fmindex.contamination(none, items)) == []
    assert fmindex.keep_clean(odd, items.limit(0)).count() == len(given)


def test_blocks_are_bounded_and_hold_every_phrase(spark, monkeypatch):
    """One huge item, many rows of one id and many copies: a block has at most its bytes and one cut more."""
    rng = random.Random(4)
    bench = [(1, " ".join(f"w{rng.randrange(500)}" for _ in range(4000)))]
    bench += [(2, " ".join(f"V{rng.randrange(50)}" for _ in range(rng.randrange(1, 30)))) for _ in range(100)]
    bench += [(3, "the same thing! " * 9)] * 200 + [(4, "The same, thing " * 9), (4, "x" * 3000), (5, None)]
    items = spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(fmindex, "ITEM_BYTES", 400)
    dealt = [tuple(r) for r in fmindex._in_blocks(items, 13).collect()]
    sizes = {}
    for _, words, block in dealt:
        sizes[block] = sizes.get(block, 0) + len(words)
    assert len(sizes) > 10 and sum(n > 2000 + 400 for n in sizes.values()) <= 1 and max(sizes.values()) <= 2000 + 3000
    assert sum(item == "3" for item, _, _ in dealt) == 1
    whole = [(str(i), t or "") for i, t in bench]
    cut = [(item, words) for item, words, _ in dealt]

    def phrases(rows):
        made = fmindex.Phrases(rows, 13)
        vocabulary = made.vocabulary.to_pylist()
        return {
            (tuple(vocabulary[c - 1] for c in made.table[nth, : made.lengths[nth]]), made.items[made.owner[o]])
            for nth in range(len(made.lengths)) for o in range(made.owner_at[nth], made.owner_at[nth + 1])
        }

    assert phrases(cut) == phrases(whole)


def test_suffix_array_and_search():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([np.append(rng.integers(1, 3, n), 0) for n in (1, 50, 200, 200)])
    index = fmindex.FMIndex(symbols, 3, sample=8)
    for n in (1, 2, 5):
        phrase = symbols[60 : 60 + n]
        low, high = index.search(phrase[None], np.array([n]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(len(symbols) - n + 1) if (symbols[i : i + n] == phrase).all()]


# language


def test_language_on_held_out_documents(spark):
    from gladeline.llm.queries import op3_output_codes

    sf = "/root/testdata/sf0.01"
    got = op3_output_codes(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 150 and right / n > 0.97
    assert got.filter("score < 0 or score > 1 or score is null").isEmpty()
    for doc_id, out in got.select("doc_id", "held_out").collect():
        assert out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_language_of_odd_texts(odd, none):
    model = language.fit(odd)
    got = {r["doc_id"]: r for r in language.predict(odd, model, F.lit(False)).collect() if r["doc_id"] is not None}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {0, 1, 2, 3, 100, 101, 102, 103}
    assert all(r["score"] == 0 for r in got.values() if r["lang_pred"] == "und")
    kept = language.keep_known(odd, model)
    assert kept.columns == odd.columns and kept.count() == 3 * (len(ODD) - 4) + 1
    unlearnt = language.fit(none)
    assert {r["lang_pred"] for r in language.predict(odd, unlearnt, F.lit(False)).collect()} == {"und"}
    one = language.fit(odd.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language.predict(odd, one, F.lit(False)).collect()} == {"und", "en"}
    assert rows(language.predict(none, model, F.lit(False))) == []


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20])
def test_codewords_differ_and_every_bit_splits(n):
    code = language.codewords(n)
    assert len({tuple(c) for c in code.tolist()}) == n
    assert (code.min(0) == 0).all() and (code.max(0) == 1).all()


def test_decoding_survives_a_wrong_bit():
    model = language.LanguageModel(["a", "b", "c", "d"], np.random.default_rng(0).random((4, language.BUCKETS - 1)))
    model.trust[:] = 1 / 7
    for k, word in enumerate(2.0 * model.code - 1):
        evidence = 5 * word
        evidence[3] = -evidence[3]
        best, _, close = model.decode(evidence[None])
        assert best[0] == k and not close[0]
    assert model.decode(np.zeros((1, 7)))[2][0]


# quality


def test_quality_on_held_out_documents(spark):
    from gladeline.llm.queries import op1_rule_ensemble

    sf = "/root/testdata/sf0.1"
    labels = quality.label_of(spark.read.parquet(f"{sf}/labels.parquet"))
    got = op1_rule_ensemble(spark, sf).join(labels, "doc_id", "left").collect()
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["label"], r["score"]) for r in got if r["held_out"] and r["label"] is not None]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.97
    assert sum((s >= 0.3) == y for y, s in held) / len(held) > 0.97


def test_quality_of_odd_texts_and_poor_labels(spark, odd, none):
    no_labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(odd, no_labels, F.lit(False)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in quality.classify(odd, one, F.lit(False)).collect()} == {1}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(len(ODD))], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, both, F.lit(False)).collect()
    assert len(got) == 3 * len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert rows(quality.classify(none, both, F.lit(False))) == []


def test_rules_are_the_paths_of_a_tree():
    printed = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0)\n    Predict: 0\n   Else (feature 1 <= 2.0)\n    Predict: 1\n  Else (feature 0 > 1.5)\n   Predict: 1\n"
    assert quality.paths(printed, ["a", "b"]) == {
        (("a", "<=", 1.5),), (("a", "<=", 1.5), ("b", ">", 2.0)), (("a", "<=", 1.5), ("b", "<=", 2.0)), (("a", ">", 1.5),)
    }


def test_statistics_by_hand():
    got = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["Ab ab ab\ncd. é!\nAb ab ab"]))[0]))
    assert got["bang_share"] == got["stop_share"] == 1 / 25
    assert got["beyond_ascii_share"] == 2 / 25
    assert got["same_word_share"] == 4 / 8 and got["word_variety"] == 3 / 8
    assert got["line_variety"] == 2 / 3
