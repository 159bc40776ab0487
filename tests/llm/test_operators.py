"""Training-data operators against brute force, references, round trips and odd inputs."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rangeframe.llm import bpe, common, exact_dedup, language_id, license_scan, line_dedup, media, mixing, queries, simhash, token_counts, toxicity
from tests.conftest import SF

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, ids that repeat, clashing columns."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", 9), (4, LONG, "de", "b", 9), (4, LONG, "de", "b", 9),
        (None, "the quick brown fox jumps", "en", None, 1), (None, None, None, "a", 1), (7, "the quick brown fox jumps", "en", "a", 1),
        (8, "  \n\t ", "fr", "b", 2), (9, "12 34 !?", "en", "b", 2), (10, "x" * 5000, "fr", "c", 3), (11, "日本語 🤷🏽 <|endoftext|>  y", None, "c", 3),
        (12, "A line of more than twenty characters\nshort\n A LINE of more than twenty characters", "en", "a", 1),
        (13, "a line of more than twenty characters ", "en", "a", 1), (14, "a line of more than twenty characters\r\nend", "en", "a", 1),
    ]
    names = ["h", "bucket", "score", "held_out", "copy", "rate", "tree", "id", "pos", "y"]
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(rows):
    return [r.text or "" for r in rows]


def held(doc_id, n, k):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n == k


# Toxicity


def test_toxicity_learns_words_and_misspellings():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bags, labels = [], []
    for k in range(900):
        text = rng.choices(words, k=rng.randint(20, 200))
        if k % 3 == 0:
            text[rng.randrange(len(text))] = rng.choice(["worthless", "disgusting", "pathetic"])
        bags.append(toxicity.gram_counts(" ".join(text), toxicity.split))
        labels.append(int(k % 3 == 0))
    scorer = toxicity.Scorer(toxicity.fit(bags, np.array(labels), epochs=15))
    clean = scorer.score([" ".join(rng.choices(words, k=60)) for _ in range(50)])
    bad = scorer.score([" ".join([*rng.choices(words, k=60), w]) for w in ("worthles", "disgustingg", "patheticc") * 10])
    assert np.mean(bad > np.median(clean)) > 0.9
    assert all(0 <= s <= 1 for s in [*clean, *bad, *scorer.score([""])])


def toxicity_words(text):
    return re.findall(r"\w+", text.lower())


def test_toxicity_on_held_out_labels(spark):
    """Recall of toxic documents and share of clean ones left alone, on labels that never trained."""
    big = SF.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{big}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) > 20 and np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.predicted for r in clean]) < 0.05


def test_labels_without_documents_do_not_train(spark):
    docs = spark.createDataFrame([(k, f"good words number{k}" if k % 2 else f"worthless trash number{k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id long, y int")
    model = toxicity.train(docs, labels, most=20)
    assert model.bias > -50 and toxicity.train(docs, labels.where("doc_id >= 40"), most=20).bias == -50


def test_toxicity_query(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts_of = {r.doc_id: r.text for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity.train(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").select("doc_id", F.col("toxic").alias("y"))))
    for r in rows[:60]:  # the sparse product against plain sums over n-grams
        grams = [g for w in set(toxicity_words(texts_of[r.doc_id] or "")) for g in toxicity.split(w)]
        z = scorer.model.bias + scorer.model.table[grams, 0].astype(float).sum() / (len(grams) + toxicity.PADDING)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    marks = spark.createDataFrame([(1, 0), (1, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    assert all(r.score < 1e-9 for r in toxicity.toxicity(odd, marks).collect())
    assert toxicity.toxicity(empty, marks).collect() == []


# Exact dedup


def test_exact_dedup(spark, docs, odd, empty):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        count = Counter(texts(rows))
        largest = {}
        for r in rows:
            if r.doc_id is not None:
                largest[r.text or ""] = max(largest.get(r.text or "", -1), r.doc_id)
        want = sorted(repr((r.doc_id, (m := largest.get(t)), count[t], r.doc_id == m, hashlib.sha256(t.encode()).hexdigest())) for r in rows for t in [r.text or ""])
        for hot_rows in (1, exact_dedup.HOT_ROWS):
            got = exact_dedup.exact_dedup(table, capacity=8, hot_rows=hot_rows)
            assert sorted(repr(tuple(r)[:5]) for r in got.collect()) == want
    assert exact_dedup.exact_dedup(empty).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("crowd", [0, 300])
def test_directory_splits_overfull_buckets(spark, crowd):
    """Every bucket is within the capacity, and no bucket is split whose parent wasn't overfull; ``crowd`` hashes share 14 bits."""
    spread = spark.range(500).select(F.xxhash64("id").alias("h"))
    hashes = spread.unionByName(spark.range(crowd).select((F.lit(77 << 50) + F.col("id") * (1 << 42)).alias("h")))
    pointers, depth = exact_dedup.directory(hashes, 20)
    rows = pointers.collect()
    counts = Counter((r.h % (1 << 64)) >> (64 - depth) for r in hashes.collect())
    assert depth > (14 if crowd else 4) and len({r.cell for r in rows}) == len(rows) and set(counts) <= {r.cell for r in rows}
    held_by = Counter()
    for r in rows:
        held_by[r.bucket] += counts[r.cell]
        assert r.cell >> (depth - r.depth) == r.bucket >> (depth - r.depth)
    for r in rows:
        assert held_by[r.bucket] == r.held <= 20 and r.final
        if r.depth > exact_dedup.START_DEPTH:
            side = r.bucket >> (depth + 1 - r.depth)
            assert sum(n for c, n in counts.items() if c >> (depth + 1 - r.depth) == side) > 20


def indexed(rows, hot_rows):
    hashes = rows.groupBy("h").agg(F.lit(100).alias("weight"), (F.count("*") > hot_rows).alias("hot"))
    pointers, depth = exact_dedup.directory(hashes, 8)
    return exact_dedup.build_index(rows, hashes, hashes.where("hot").select("h"), pointers, depth)


@pytest.mark.parametrize("hot_rows", [1, 100])
def test_colliding_hashes_stay_apart(spark, hot_rows):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, body string").withColumn("h", F.lit(5).cast("long"))
    entries = indexed(rows, hot_rows).collect()
    assert sorted((r.chain, r.keep_id, r.group_size) for r in entries) in ([(0, 2, 1), (1, 3, 2)], [(0, 3, 2), (1, 2, 1)])


def test_results_come_through_the_directory(spark, docs, monkeypatch):
    """Texts of which the directory knows no bucket have no entry and are not found."""
    whole, real = exact_dedup.exact_dedup(docs).count(), exact_dedup.directory

    def half(hashes, capacity):
        pointers, depth = real(hashes, 8)
        return pointers.where("cell % 2 = 0"), depth

    monkeypatch.setattr(exact_dedup, "directory", half)
    assert 0 < exact_dedup.exact_dedup(docs).count() < whole == docs.count()


def test_owners_take_key_ranges(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNED", 4000)
    hashes = spark.range(500).select(F.xxhash64("id").alias("h"), F.lit(100).alias("weight"))
    pointers, depth = exact_dedup.directory(hashes, 20)
    ranges, n = exact_dedup.owners(pointers, hashes, depth)
    rows = ranges.orderBy("bucket").collect()
    assert n == 13 and [r.owner for r in rows] == sorted(r.owner for r in rows) and {r.owner for r in rows} == set(range(13))


# Language ID


def test_language_id(docs, odd, empty):
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 4, 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert out and np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    got = language_id.language_id(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 8, 9)} == {"und"}
    assert language_id.language_id(empty).collect() == []
    unlabelled = language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_scores_against_plain_bayes(spark):
    rows = [(1, "der hund läuft", "de"), (2, "die katze schläft", "de"), (3, "the dog runs", "en"), (4, "a cat sleeps", "en"), (4, "a cat sleeps", "en"), (5, "le chien", "fr"), (6, "nobody knows", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    split = language_id.splitter(language_id.BUCKETS)
    counts = {x: Counter() for x in ("de", "en", "fr")}
    for text, lang in {(t, x) for _, t, x in rows if x}:
        counts[lang].update(g for w in text.split() for g in split(w))
    prior = {"de": 2, "en": 2, "fr": 1}
    asked = ["the katze", "le hund et le chat", "x" * 300, "dog " * 500]
    for text, (found, score) in zip(asked, language_id.Scorer(model).predict(asked)):
        grams = [g for w in text.split() for g in split(w)]
        logs = {x: sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * language_id.BUCKETS)) for g in grams) for x, c in counts.items()}
        whole = {x: logs[x] + math.log(prior[x] / 5) for x in logs}
        assert found == max(whole, key=whole.get)
        soft = {x: math.exp((logs[x] - max(logs.values())) * min(1, language_id.EVIDENCE / len(grams))) * prior[x] for x in logs}
        assert score == pytest.approx(soft[found] / sum(soft.values()), abs=1e-3)


def test_many_languages_share_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 1 << 15)
    docs = spark.createDataFrame([(k, f"word{k} word{k}", f"l{k}") for k in range(500)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.languages) == 500 and model.table.shape == (65, 500)
    assert [x for x, _ in language_id.Scorer(model).predict(["word7 word7", "..."])][1] == "und"


# Media


@pytest.mark.parametrize("payload", [b"", b"abc", os.urandom(64 * 5), os.urandom(64 * 33 + 1), b"\xff" * 3000, b"\x00" * 64, LONG.encode()])
def test_avi_round_trip(payload):
    stored = media.encode_avi(media.pad(payload))
    assert media.read_avi(stored).payload == media.pad(payload) and stored[8:12] == b"AVI " and stored == media.encode_avi(media.pad(payload))


def test_fast_and_slow_decoders_agree():
    stored = media.encode_avi(media.pad(os.urandom(64 * 20) + b"\xff" * 200))
    for f in media.parse_avi(stored).frames:
        head = media.parse_head(bytes(f))
        c, _ = media.decode_frame(f, head)
        assert (media._slow_scan(bytes(f)[head.scan : -2], head, media.FRAME_BLOCKS) == c).all()


def test_inverse_dct_and_zigzag():
    z = media.zigzag().tolist()
    assert z[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(z) == list(range(64))
    c = np.random.default_rng(1).integers(-200, 200, (1, 64))
    want = np.zeros((8, 8))
    for k, place in enumerate(z):
        v, u = divmod(place, 8)
        for y in range(8):
            for x in range(8):
                scale = (math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1) / 4
                want[y, x] += scale * c[0, k] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
    assert np.allclose(c.astype(np.float32) @ media._BASIS, want.ravel(), atol=0.05)


def test_shots_and_bad_files():
    dark, light = np.full((10, 64), 20), np.full((7, 64), 220)
    assert media.cuts(media.histograms(np.concatenate([dark, light]))).tolist() == [0, 10]
    assert media.cuts(np.zeros((0, 32))).tolist() == [] and media.cuts(np.zeros((1, 32))).tolist() == [0]
    good = media.encode_avi(media.pad(b"x"))
    for bad in (b"RIFF", b"", good[:40], good.replace(b"idx1", b"idx2")):
        with pytest.raises((ValueError, Exception)):
            media.read_avi(bad)


def test_media_query(spark, odd, empty):
    by_text = {}
    for r in media.media_digest(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        payload = media.pad((r.text or "").encode())
        assert (r.n_bytes, r.payload_bytes) == (len((r.text or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert by_text.setdefault(r.text or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.media_digest(empty).collect() == []
    clips = media.clips(media.media(odd.where("doc_id = 3")), "doc_id").orderBy("clip").collect()
    assert clips[0].begin_s == 0 and all(a.end_s == b.begin_s for a, b in zip(clips, clips[1:]))


# Tokens


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def wild(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abc theingATZ '.,\n\t 01é中🙂\x00\x1c\xa0\x85") for _ in range(rng.randint(0, 150))) for _ in range(n)]


def test_token_counts(reference, docs, odd, empty):
    count = token_counts.counter(VOCABULARY)
    cases = [*wild(), "<|endoftext|>a <|endoftext|> b", "  x\n\n y\t z  ", "a" * 3000, "don't we'll  I'm", ""]
    assert count(cases).tolist() == [len(reference(c)) for c in cases]
    for table in (docs, odd):
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(reference(r.text or "")), len(reference(r.text or "")) > 1024) for r in table.collect())
        assert sorted((r.doc_id or -1, *tuple(r)[1:]) for r in token_counts.token_counts(table, VOCABULARY).collect()) == want
    assert token_counts.token_counts(empty, VOCABULARY).collect() == []


def test_other_tokenizers_get_whole_texts(tmp_path):
    """Files for which a split before a space isn't safe: counted by the library on whole texts, refused by bpe."""
    import json

    import sentencepiece

    cases = [*wild(60, seed=4), "two  words", ""]
    spec = json.load(open(VOCABULARY))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = f"{tmp_path}/prefix.json"
    json.dump(spec, open(path, "w"))
    library = Tokenizer.from_file(path)
    assert token_counts.counter(path)(cases).tolist() == [len(library.encode(c, add_special_tokens=False).ids) for c in cases]
    with pytest.raises(ValueError):
        bpe.Vocabulary.from_json(path)
    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    assert token_counts.counter(model)(cases).tolist() == [len(pieces.encode(c)) for c in cases]


def test_pieces_put_texts_together():
    for t in wild(seed=9):
        first, rest = token_counts.pieces(t)
        assert first + "".join(" " + p for p in rest) == t


def test_bpe(reference, docs, odd, empty, monkeypatch):
    coder = bpe.Encoder(bpe.Vocabulary.from_json(VOCABULARY))
    cases = [*wild(seed=5), "<|endoftext|>a <|endoftext|> b", "a" * 3000, "aaaaaaaa aaaaa", "zxqj" * 60, "日本語 🤷🏽‍♀️", ""]
    ids = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(cases)]
    assert ids == [reference(c) for c in cases]
    assert [coder.decode(np.array(i, "<u4").tobytes()) for i in ids] == cases
    word = b"the whole of antidisestablishmentarianism"
    assert coder.vocabulary.merged(word) == coder.vocabulary._heap([int(coder.vocabulary.base[b]) for b in word])
    for table in (docs, odd):
        for r in bpe.bpe_round_trip(table, VOCABULARY).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
            want = np.array(reference(r.text or ""), "<u4")
            assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(empty, VOCABULARY).collect() == []
    coded = bpe.bpe_encode(odd.where("doc_id is not null"), VOCABULARY, ["doc_id"])
    back = {r.doc_id: r.text for r in bpe.bpe_decode(coded, VOCABULARY, ["doc_id"]).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in odd.where("doc_id is not null").collect())


def test_bpe_on_random_vocabularies():
    """Speculation and verification against plain merging, with vocabularies that overlap a lot."""
    rng = random.Random(11)
    for _ in range(60):
        tokens, merges = {bytes([c]): k for k, c in enumerate(b"abc")}, []
        while len(tokens) < 40:
            a, b = rng.choice(list(tokens)), rng.choice(list(tokens))
            if a + b not in tokens:
                merges.append((tokens[a], tokens[b], len(tokens)))
                tokens[a + b] = len(tokens)
        v = bpe.Vocabulary(tokens, merges, {})
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 20))).encode() for _ in range(80)]
        for w, got in zip(words, v.words(words)):
            ids = [tokens[bytes([c])] for c in w]
            while True:
                ranked = [(r, k) for k in range(len(ids) - 1) for r, (x, y, _) in enumerate(merges) if (x, y) == (ids[k], ids[k + 1])]
                if not ranked:
                    break
                r, k = min(ranked)
                ids[k : k + 2] = [merges[r][2]]
            assert got == ids == v._heap([tokens[bytes([c])] for c in w]), (w, merges)


# Mixing


def test_mixing(spark, docs, odd, empty):
    rates = {r.source_key: r.rate for r in mixing.rates(docs).collect()}
    count = Counter(r.source for r in docs.collect())
    total = sum(math.sqrt(n) for n in count.values())
    assert all(rates[s] == pytest.approx(math.sqrt(n) / total * sum(count.values()) / n) for s, n in count.items())
    rows = mixing.mix(docs).collect()
    for d in docs.collect():
        u = (int(hashlib.md5(f"42|count|{d.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        k, cdf = 0, math.exp(-rates[d.source])
        while cdf < u:
            k += 1
            cdf += math.exp(-rates[d.source]) * rates[d.source] ** k / math.factorial(k)
        assert sorted(r.copy for r in rows if r.doc_id == d.doc_id) == list(range(k))
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    mixed = Counter(r.source for r in mixing.mix(many, {"a": 3.0, "b": 1.0, "z": 5.0}, total=40000).collect())
    assert 0.97 < mixed["a"] / 30000 < 1.03 and 0.95 < mixed["b"] / 10000 < 1.05
    mixed = mixing.mix(odd)
    assert mixed.columns == [c for c in odd.columns if c not in mixing.ADDED] + mixing.ADDED
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(r.n_copies * sum(x.doc_id == r.doc_id for x in odd.collect()) >= copies[r.doc_id] >= r.n_copies > r.copy >= 0 for r in mixed.collect())
    assert mixing.mix(odd, {None: 1.0}).where("source is not null").count() == 0
    assert mixing.mix(empty).collect() == []


def test_mixing_with_many_sources(spark, docs, monkeypatch):
    want = sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "copy").collect())
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    assert sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "copy").collect()) == want


@pytest.mark.parametrize("rate", [0.01, 1.0, 30.0, 900.0])
def test_poisson_steps(spark, rate):
    steps = mixing.poisson_steps(spark.createDataFrame([("a", rate), (None, 2.0)], "source_key string, rate double")).where("source_key = 'a'").first().steps
    logs = np.array([k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(len(steps))])
    assert np.allclose(steps, np.cumsum(np.exp(logs)), atol=1e-9) and steps[-1] == pytest.approx(1)


# SimHash


def plain_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64(" ".join(words[k : k + size]).encode(), seed=42).intdigest() for k in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, radius=3):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    label = np.arange(len(prints))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(prints))])
        if (new == label).all():
            break
        label = new
    first = {}
    for k, c in zip(ids, label):
        if k is not None:
            first[c] = min(first.get(c, k), k)
    return [first.get(c) for c in label]


def test_near_duplicates(docs, odd, empty):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        prints = np.array([plain_print(r.text) for r in rows], np.uint64)
        want = sorted(repr((r.doc_id, f"{p:016x}", c)) for r, p, c in zip(rows, prints.tolist(), components(prints, [r.doc_id for r in rows])))
        assert sorted(repr(tuple(r)) for r in simhash.near_duplicates(table).collect()) == want
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("shard, most", [(40, 100_000), (40, 30), (10_000, 50)])
def test_links_by_trees_are_exact(spark, shard, most):
    rng = np.random.default_rng(2)
    centers = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    prints = np.unique(np.concatenate([centers, *[centers ^ np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in centers], np.uint64) for k in (1, 2, 3, 4, 5)]]))
    signed = prints.view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    half = F.explode(F.array(F.struct(F.lit(0).alias("tree"), F.expr("fp & 4294967295L").alias("code")), F.struct(F.lit(1).alias("tree"), F.expr("shiftrightunsigned(fp, 32)").alias("code"))))
    points = frame.select("fp", half.alias("h")).select("h.tree", "h.code", F.col("fp").alias("id"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("sig"))
    root = {r.node: r.root for r in simhash.contract(simhash.find_links(points, 1, 3, shard=shard, shard_most=most)).collect()}
    got = [root.get(x, x) for x in signed]
    assert got == components(prints, signed)


def test_routing_meets_every_pair():
    rng = np.random.default_rng(7)
    codes = np.unique(rng.integers(0, 1 << 32, 3000, dtype=np.uint64))
    near = codes[:800] ^ (np.uint64(1) << rng.integers(0, 32, 800, dtype=np.uint64))
    both = np.concatenate([codes, near])
    tree = simhash.fit_tree(codes[::3], 3, 1, shard=50)
    row, shard, home = simhash.route(tree, both)
    assert np.bincount(row[home], minlength=len(both)).tolist() == [1] * len(both)
    at = [set() for _ in both]
    house = {}
    for r, s, h in zip(row.tolist(), shard.tolist(), home.tolist()):
        at[r].add(s)
        if h:
            house[r] = s
    for k in range(800):
        a, b = k, len(codes) + k
        assert house[a] in at[b] or house[b] in at[a]


def test_contract_long_chains(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    rows = simhash.contract(chain).collect()
    assert len(rows) == 199 and {r.root for r in rows} == {0}
    assert simhash.contract(chain.limit(0)).collect() == []


def test_similar_documents(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    rows, truth = [], {}
    for g in range(60):
        base = rng.choices(words, k=300)
        rows.append((3 * g, " ".join(base)))
        near = list(base)
        for at in rng.sample(range(300), 3):  # about 0.9
            near[at] = rng.choice(words)
        rows.append((3 * g + 1, " ".join(near)))
        rows.append((3 * g + 2, " ".join(rng.choices(words, k=300))))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = {r.doc_id for r in simhash.drop_similar(frame).collect()}
    assert all(3 * g in kept and 3 * g + 2 in kept for g in range(60)) and not truth
    assert sum(3 * g + 1 not in kept for g in range(60)) >= 55


def shingle_sets(text, size=5):
    words = text.lower().split()
    size = min(size, len(words))
    return {" ".join(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def brute_force(sets, similarity=0.8):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                label = [label[j] if x == label[i] else x for x in label]
    return label


def partition(labels):
    groups = {}
    for k, x in enumerate(labels):
        groups.setdefault(x, set()).add(k)
    return {frozenset(g) for g in groups.values()}


def test_similarity_is_exact_around_the_threshold(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(9000)]
    rows = []
    for words_, more in [(8, 1), (8, 2), (10, 1), (12, 2), (12, 3), (24, 5), (24, 6)] * 6:  # J = n / (n + more): 4 of 5, 4 of 6, ...
        base = rng.choices(words, k=words_)
        rows += [" ".join(base), " ".join(base + rng.choices(words, k=more))]
    for more in range(60, 140, 4):  # J from 0.87 down to 0.74
        base = rng.choices(words, k=404)
        rows += [" ".join(base), " ".join(base + rng.choices(words, k=more))]
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(rows)], DOCS)
    got = {r.doc_id: r.group_key for r in simhash.similar_documents(frame).collect()}
    assert partition([got[k] for k in range(len(rows))]) == partition(brute_force([shingle_sets(t) for t in rows]))


@pytest.mark.parametrize("rows,shingles", [(2048, 500_000), (7, 500_000), (2048, 900)])
def test_blocks_join_what_brute_force_joins(spark, rows, shingles):
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 1 << 62, 100)
        sets += [np.unique(np.concatenate([rng.permutation(base)[:keep], rng.integers(0, 1 << 62, 4)])) for keep in rng.integers(70, 100, 12)]
    root = [0 if k < 48 else 48 for k in range(len(sets))]
    frame = spark.createDataFrame([(k, r, s.astype(np.uint64).tobytes()) for k, (r, s) in enumerate(zip(root, sets))], "id long, root long, shingles binary")
    found = {r.node: r.root for r in simhash.contract(simhash.confirmed(frame, 0.8, rows, shingles)).collect()}
    want = brute_force([set(s.tolist()) for s in sets])
    assert 6 < len(set(want)) < len(sets) and partition([found.get(k, k) for k in range(len(sets))]) == partition(want)


def test_drop_similar_odd(odd, empty):
    clashing = odd.withColumns({n: F.lit(n) for n in ("kept_doc", "kept_key", "row_number", "text_key", "n", "root", "fp")})
    kept = simhash.drop_similar(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    # Null, empty and wordless texts are one group, of which the smallest id stays; two lone sentences are equal.
    assert sorted(r.doc_id for r in rows) == [1, 3, 7, 9, 10, 11, 12, 13, 14] and all(r.kept_doc == "kept_doc" and r.root == "root" for r in rows)
    assert simhash.drop_similar(empty).collect() == []


def test_ties_are_broken_by_all_columns(spark):
    rows = [(1, "some words that are the same", lang, "s", n) for lang, n in (("fr", 1), ("de", 2), ("en", 3), ("de", 1))]
    for k in range(3):
        frame = spark.createDataFrame(rows[k:] + rows[:k], DOCS).repartition(3)
        assert [(r.lang, r.n_chars) for r in simhash.drop_similar(frame).collect()] == [("de", 1)]


def test_similar_documents_find_every_pair_of_the_corpus(spark):
    """Recall and precision at 0.8 against brute force over all distinct texts of a table."""
    from tests.conftest import SF as small

    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = {r.doc_id: r.group_key for r in simhash.similar_documents(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    sets = [np.unique(simhash.shingle_hashes((r.text or "").encode(), 5)) for r in rows]
    holders = {}
    for k, x in enumerate(sets):
        for h in x.tolist():
            holders.setdefault(h, []).append(k)
    shared = Counter()
    for group in holders.values():
        for j, b in enumerate(group):
            shared.update((a, b) for a in group[:j])
    similar = [(a, b) for (a, b), c in shared.items() if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9]
    different = [(a, b) for a, b in similar if rows[a].text != rows[b].text]
    linked = [got[rows[a].doc_id] == got[rows[b].doc_id] for a, b in different]
    assert len(different) >= 10 and np.mean(linked) >= 0.95
    label = list(range(len(rows)))  # components of what is really similar

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in similar:
        label[find(a)] = find(b)
    empty = [k for k, x in enumerate(sets) if not len(x)]
    for k in empty:
        label[find(k)] = find(empty[0])
    members = {}
    for k, r in enumerate(rows):
        members.setdefault(got[r.doc_id], set()).add(find(k))
    assert all(len(m) == 1 for m in members.values())


def test_hot_hubs_contract_as_others_do(spark, monkeypatch):
    monkeypatch.setattr("rangeframe.llm.common.HOT_ROWS", 3)
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 60)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(59, 129)]
    got = {r.node: r.root for r in simhash.contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {k: k for e in edges for k in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if k != v}


# Licenses


def base_scan(text):
    """Words and places by comparing word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(k, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), sorted(found)


def test_license_scan(docs, odd, empty):
    cases = [*texts(docs.collect()), *texts(odd.collect()), "CC BY all rights reserved, General Public License!", "cc-by cc by", "ccby", "cc  by"]
    scanner = license_scan.Scanner()
    for t in cases:
        n, found = base_scan(t)
        r = scanner.scan(t.encode())
        places = [k for k, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.license_scan(odd).count() == odd.count() and license_scan.license_scan(empty).collect() == []


@pytest.mark.parametrize(
    "text, postfix, permitted",
    [
        ("MIT", "mit", True),
        ("MIT OR GPL-2.0 AND ISC", "mit gpl-2.0 isc and or", True),
        ("(MIT OR GPL-2.0) AND GPL-3.0", "mit gpl-2.0 or gpl-3.0 and", False),
        ("Apache-2.0 WITH LLVM-exception AND MIT", "apache-2.0 llvm-exception with mit and", True),
        ("GPL-2.0-or-later WITH x", "gpl-2.0-or-later x with", False),
        ("MIT */ rest", "mit", True),
        ("(MIT", None, None),
        ("AND MIT", None, None),
        ("", None, None),
        ("MIT) ", None, None),
        ("see the file", None, None),
        ("MIT and this file is shared", "mit", True),
        ("MIT AND (see LICENSE)", "mit", True),
        ("MIT/Apache-2.0", "mit apache-2.0 or", True),
        ("GPL-2.0+ OR LicenseRef-own-1", "gpl-2.0+ licenseref-own-1 or", False),
        ("GPL-3.0-only WITH Classpath-exception-2.0 OR MIT x", "gpl-3.0-only classpath-exception-2.0 with mit or", True),
        ("(MIT OR this) AND ISC", None, None),
        ("NOASSERTION", None, None),
    ],
)
def test_expressions(text, postfix, permitted):
    found = license_scan.to_postfix(text)
    assert found == (postfix and postfix.split())
    if found:
        assert license_scan.evaluate(found).permitted is permitted
        r = license_scan.Scanner().scan(f"// SPDX-License-Identifier: {text}\ncode".encode())
        assert r["expressions"] == [postfix] and r["permitted"] is permitted


# Lines


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    low = lambda i: -(1 << 63) if i is None else i
    holders = {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(low(r.doc_id))
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= min_docs and low(r.doc_id) != max(h))]
        out.append((r.doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("totals", [200_000, 0])
def test_line_dedup(spark, docs, odd, empty, monkeypatch, totals):
    monkeypatch.setattr(line_dedup, "MAX_TOTALS", totals)
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        assert sorted(repr(tuple(r)) for r in line_dedup.line_digest(table).collect()) == plain_lines(rows)
        assert line_dedup.dedup_lines(table).columns == table.columns and line_dedup.dedup_lines(table).count() == len(rows)
    assert line_dedup.line_digest(empty).collect() == []


def test_line_dedup_with_other_ids(spark):
    """Text ids: the largest by its order keeps the line; a null id is the smallest."""
    line = "a line that several documents have"
    rows = [("b", f"{line}\nx"), ("a", line), (None, f"y\n{line}"), ("c", f"{line}\nz")]
    found = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_digest(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {"b": (2, 1), "a": (1, 1), None: (2, 1), "c": (2, 0)}


def test_runs_across_batches(spark):
    """One line in all documents, read in batches of 7 rows and from several tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(6)
        common = [f"a line that is common to many {k}" for k in range(5)]
        rows = [(k, "\n".join([common[0], *rng.choices(common, k=3), f"a line that only document {k} has"])) for k in range(200)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(repr(tuple(r)) for r in line_dedup.line_digest(frame).collect()) == plain_lines(frame.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bitmaps():
    for n in (1, 8, 9, 1000):
        drop = list(range(0, n, 3))
        keep = line_dedup.unpack(line_dedup.pack(drop, n), n)
        assert keep.tolist() == [k % 3 != 0 for k in range(n)]


# Queries and the pipeline


def test_queries_are_registered(spark):
    names = [*queries.queries()]
    assert [n.split("_")[0] for n in names[:10]] == [f"op{k}" for k in range(1, 11)] and names[10] == "pipeline"
    assert set(queries.oracle_sql()) <= set(names)


def test_oracles(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda df: sorted(repr(tuple(v.item() if hasattr(v, "item") else v for v in r)) for r in df[columns].itertuples(index=False, name=None))
        assert rows(got) == rows(want), name


def test_pipeline_stages(spark, docs, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "mixture", "tokens"]
    found = docs.withColumn("text", F.when(F.col("doc_id") == 5, "123 456").otherwise(F.col("text")))
    kept = corpus_pipeline.language(spark, found, SF)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 0 and kept.count() > 0.98 * docs.count()
    lines = corpus_pipeline.lines(spark, kept, SF)
    assert lines.columns == docs.columns and all(r.text.strip() for r in lines.collect())
    near = corpus_pipeline.near_copies(spark, lines, SF)
    assert near.columns == docs.columns and near.select("text").distinct().count() == near.count()
    more = odd.withColumns({n: F.lit(n) for n in ("found_lang", "found_score", "keep_bitmap", "covered", "kept_doc", "of_source", "steps", "n_copies")})
    # One text is labelled with two languages: neither has a posterior of a half.
    kept = {"language": [7, 10, 11, 12, 13, 14, None], "lines": [3, 4, 4, 7, 9, 10, 11, 12, 14, None], "near_copies": [1, 3, 7, 9, 10, 11, 12, 13, 14]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, SF)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name in kept:
            assert sorted(ids, key=str) == sorted(kept[name], key=str), name
        if name == "tokens":
            assert sorted(ids, key=str) == sorted((r.doc_id for r in odd.collect()), key=str)
        else:
            assert out.columns == more.columns and all(r.covered == "covered" and r.n_copies == "n_copies" for r in out.collect()), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_pipeline_end(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    reference = Tokenizer.from_file(VOCABULARY)
    assert rows and all(r.n_tokens == len(r.token_ids) for r in rows)
    known = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in rows} <= known
    assert all(reference.decode(r.token_ids, skip_special_tokens=False).strip() for r in rows[:20])


def test_pipeline_decodes_its_tokens(spark, docs, odd, monkeypatch):
    for table in (docs, odd.select(*docs.columns)):
        out = corpus_pipeline.tokens(spark, table, SF)
        assert out.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "decoded_sha256"]
        want = sorted(repr((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest())) for r in table.collect())
        assert sorted(repr((r.doc_id, r.decoded_sha256)) for r in out.collect()) == want
    real = bpe.Encoder.decode
    monkeypatch.setattr(bpe.Encoder, "decode", lambda self, ids: "" if ids else real(self, ids))
    work = {}
    monkeypatch.setattr(bpe, "map_text", lambda docs, keep, text, schema, make: work.update(made=make()([b"some text"])))
    bpe.bpe_encode_decode(docs, VOCABULARY, [])
    assert work["made"]["decoded_sha256"] == [hashlib.sha256(b"").hexdigest()]  # the digest is of what the ids decode to


def test_encoders_keep_nothing_of_a_task():
    one = bpe.encoder(VOCABULARY)
    one.encode(["some text of a few words", LONG])
    two = bpe.encoder(VOCABULARY)
    assert one.known and one.words and one.vocabulary.fits
    assert not two.known and not two.words and not two.vocabulary.fits
    assert two.vocabulary.rank is one.vocabulary.rank  # read once


def test_local_tables_run_no_python_workers(spark):
    table = common.local_table(spark, [(1, 2), (3, None)], "root long, blocks int")
    assert "PythonRDD" not in table._jdf.queryExecution().toRdd().toDebugString()
    assert table.dtypes == [("root", "bigint"), ("blocks", "int")] and sorted(map(tuple, table.collect())) == [(1, 2), (3, None)]
    none = common.local_table(spark, [], "root long, blocks int")
    assert none.dtypes == table.dtypes and none.count() == 0
