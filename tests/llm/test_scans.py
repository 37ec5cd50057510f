"""Licence scan, media, language, toxicity and packing: what maps row by row."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import language, license_scan, media, packing, toxicity


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(odd, none, odd_rows):
    rows = license_scan.scan_licenses(odd).collect()
    got = sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows], key=str)
    assert got == sorted([(d, *brute_licenses(t)) for d, t, *_ in odd_rows], key=str)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert license_scan.scan_licenses(none).count() == 0


@pytest.mark.parametrize("text", ["MIT License MIT-license mit. LICENSE", "gnu general public license version 3 general public license", "permission is hereby granted free of charge x the software is provided as is", "Émit license mit éicense", "licensed under cc by-nc 4.0 apache license, version 2.0"])
def test_license_places(text):
    got = license_scan.RareTokenIndex().report(text.encode())
    assert got[:5] == brute_licenses(text)
    assert set(filter(None, got[4].split(","))) <= set(got[5].split(","))


def test_license_labels():
    report = license_scan.RareTokenIndex().report
    for t in license_scan.TEMPLATES:
        got = report(f"some words before {t.text} and after".encode())
        assert t.label in got[5].split(",") and got[6] == 1, t.label
    # A holder's name in the middle, other line breaks and marks.
    copy = license_scan.MIT.replace("subject to", "as Some Holder Inc. 2020 wants it,\n * subject to").replace(", ", " ;\n// ")
    assert "mit-text" in report(copy.encode())[5].split(",")
    # Half of a text without the second key phrase has a score and no label.
    half = report(license_scan.MIT[: len(license_scan.MIT) // 2].encode())
    assert "mit-text" not in half[5] and 0 < half[6] <= 0.5
    # The same words in another order are no copy.
    words = license_scan.MIT.split()
    assert "mit-text" not in report(" ".join(sorted(words)).encode())[5].split(",")
    assert report(b"GNU General Public License, version 3")[5] == "gpl,gpl-3.0"


def brute_begins(words, text, chosen, slack, least):
    """The most of the chosen (word, position) that agree on a beginning within slack, by trying all."""
    at = {(w, i): [p - i for p, x in enumerate(words) if x == w] for w, i in chosen}
    every = sorted({p for held in at.values() for p in held})
    return max((sum(any(low <= p <= low + slack for p in held) for held in at.values()) for low in every), default=0)


def test_postings_meet_by_position():
    import random

    rng, index = random.Random(4), license_scan.RareTokenIndex()
    for t, text in enumerate(index.texts):
        chosen = [(w, i) for w, where in index.postings.items() for k, i in where if k == t]
        for _ in range(6):
            words = list(text) if rng.random() < 0.7 else rng.sample(text, len(text))
            for _ in range(rng.randint(0, 12)):
                words.insert(rng.randrange(len(words) + 1), rng.choice([b"x", rng.choice(text)]))
                if rng.random() < 0.3:
                    del words[rng.randrange(len(words))]
            slack = index.slack if index.phrases[t] else 0
            most = brute_begins(words, text, chosen, slack, index.least[t])
            got = index.begins(words).get(t)
            assert (got[1] if got else 0) == (most if most >= index.least[t] else 0)


def test_media_round_trip(odd, none, odd_rows):
    for text in (b"", b"a", b"x" * 192, b"y" * 193, "é".encode() * 5000):
        payload = media.pad(text)
        stored = media.write_media(payload)
        track = media.read_tracks(stored)[0]
        assert media.read_payload(stored, track) == payload
        assert b"".join(stored[a : a + n] for a, n in zip(track.offsets, track.sizes, strict=True)) == payload
        assert all(stored[a : a + n] == payload[192 * k : 192 * k + n] for k, (a, n) in zip(track.keys, track.keyframe_ranges(), strict=True))
        assert track.duration == len(payload)
    rows = media.describe_media(odd).collect()
    assert len(rows) == 10 and len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert {r["payload_bytes"] for r in rows if r["doc_id"] in (2, 3)} == {192}
    texts = {d: (t or "").encode() for d, t, *_ in odd_rows}
    for r in rows:
        payload = media.pad(texts[r["doc_id"]])
        stored = media.write_media(payload)
        assert r["n_keyframes"] == len(r["keyframes"]) == -(-len(payload) // (192 * media.KEY_EVERY))
        for k, (at, n) in enumerate(r["keyframes"]):
            assert stored[at : at + n] == payload[192 * media.KEY_EVERY * k :][:192]
    assert media.describe_media(none).count() == 0


def test_media_tables():
    # Two chunks with samples of their own sizes, wide offsets, no sync table: all samples are keyframes.
    data = b"abcde" + b"fgh"
    box, full = media.box, media.full
    head = box(b"ftyp", b"isom")

    def moov(at):
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))),
            full(b"stts", struct.pack(">III", 1, 3, 40)),
            full(b"stsc", struct.pack(">I", 2), struct.pack(">IIIIII", 1, 2, 1, 2, 1, 1)),
            full(b"stsz", struct.pack(">IIIII", 0, 3, 2, 3, 3)),
            full(b"co64", struct.pack(">IQQ", 2, at, at + 5)),
        )
        return box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 120)), box(b"minf", stbl))))

    at = len(head) + len(moov(0)) + 8
    stored = head + moov(at) + struct.pack(">I4s", 0, b"mdat") + data  # a box to the end of the file
    track = media.read_tracks(stored)[0]
    assert track.codec == "avc1" and media.read_payload(stored, track) == data
    assert track.keyframe_ranges() == [(at, 2), (at + 2, 3), (at + 5, 3)]
    with pytest.raises(ValueError):
        media.read_tracks(stored[:40])
    for name in (b"mdhd", b"stts", b"stsc", b"stsz", b"co64"):
        with pytest.raises(ValueError):
            media.read_tracks(stored.replace(name, b"none"))
    with pytest.raises(ValueError):
        media.read_tracks(stored[:-4] if stored[-8:-4] == b"mdat" else head + box(b"moof"))


def test_broken_media():
    """A file with any byte changed is read or refused with ValueError."""
    import random

    rng, stored = random.Random(2), media.write_media(media.pad(b"z" * 9000))
    head = stored.index(b"mdat")
    for _ in range(800):
        at = rng.randrange(head)
        broken = stored[:at] + bytes([rng.randrange(256)]) + stored[at + 1 :]
        try:
            media.read_tracks(broken)
        except ValueError:
            pass


def test_nested_media():
    """Boxes nested thousands deep are walked; a file without a track gives none."""
    deep = b""
    for _ in range(3000):
        deep = struct.pack(">I4s", len(deep) + 8, b"moov") + deep
    assert media.read_tracks(deep) == []
    with pytest.raises(ValueError):
        media.read_tracks(deep[:-4])


def test_language(spark, sf, odd, none):
    rows = language.op7_language_id(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
    learned = language.learn({"en": ["the house of the people and the river"], "fr": ["la maison de la reine et le jardin"]})
    wide = odd.withColumn("lang_pred", F.lit("clash")).withColumn("accepted", F.lit("clash"))
    got = language.predict_languages(wide, learned)
    assert got.columns == [*wide.columns, "lang_pred_", "lang_score", "accepted_"] and {r["accepted"] for r in got.collect()} == {"clash"}
    got = language.predict_languages(odd.select("doc_id", "text"), learned).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 7)} == {"und"}
    assert {r["lang_pred"] for r in language.predict_languages(odd.select("doc_id", "text"), {}).collect()} == {"und"}
    assert language.predict_languages(none.select("doc_id", "text"), learned).count() == 0
    assert language.training_sample(none) == {}


def brute_language(text, learned):
    """Each size from a dictionary of its own, the smallest by hand."""
    import zstandard

    raw = " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode()
    sizes = {}
    for name, held in learned.items():
        made = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[name] = len(made.compress(raw))
    return min(sizes, key=sizes.get) if raw else "und"


def test_language_sizes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    learned = language.learn(language.training_sample(docs))
    compressors, same = language.Compressors(learned), []
    rows = [r for r in docs.collect() if r["text"]]
    for r in rows:
        same.append(compressors.predict(r["text"])[0] == brute_language(r["text"], learned))
    # A dictionary that is prepared once may find other matches in a few texts.
    assert np.mean(same) >= 0.99


def test_language_with_few_texts(spark, sf):
    """One language with three texts takes nothing from the others, and all languages are learned."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sample = language.training_sample(docs)
    few = sorted(sample)[0]
    learned = language.learn({k: v[:3] if k == few else v for k, v in sample.items()})
    assert set(learned) == set(sample) and min(len(x) for k, x in learned.items() if k != few) > 3 * len(learned[few])
    compressors = language.Compressors(learned)
    rows = [r for r in docs.collect() if r["lang"] != few and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([compressors.predict(r["text"])[0] == r["lang"] for r in rows]) >= 0.9
    many = spark.createDataFrame([(i, f"text of {i} words", f"l{i}") for i in range(900)], "doc_id long, text string, lang string")
    # More languages than rows to learn from: a sample of all rows.
    assert 0 < len(language.training_sample(many, total=100)) < 300
    assert len(language.training_sample(many)) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(900))


def test_language_margin(spark, sf):
    """Of wrong answers on fragments of a few words, nearly none is accepted; of whole texts, nearly all are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    compressors = language.Compressors(language.learn(language.training_sample(docs)))
    rows = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    short = [(compressors.predict(" ".join(r["text"].split()[:n])), r["lang"]) for r in rows for n in (2, 3, 5)]
    wrong = [found for found, lang in short if found[0] != lang]
    assert len(wrong) > 10 and np.mean([sure for _, _, sure in wrong]) < 0.1
    assert np.mean([compressors.predict(r["text"])[2] for r in rows]) > 0.9


def brute_packing_ids(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for x in texts]


def check_pieces(rows, docs, window, path):
    """Each id in one piece, checksums right, offsets gapless, no sequence too long; returns the fills."""
    ids = dict(zip([d for d, _ in docs], brute_packing_ids([t for _, t in docs], path), strict=True))
    pieces, windows = {}, {}
    for r in rows:
        raw = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(raw) // 4
        assert zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held, ends in ((pieces, {d: len(raw) // 4 for d, raw in ids.items()}), (windows, None)):
        for key, spans in held.items():
            at = 0
            for start, n in sorted(spans):
                assert start == at and n > 0
                at += n
            assert at == ends[key] if ends else at <= window
    assert set(pieces) == set(ids)
    return [sum(n for _, n in w) for w in windows.values()]


def test_packing(spark, corpus, corpus_rows, odd, none):
    path = packing.vocabulary_path()
    for window in (64, 2048):
        fills = check_pieces(packing.pack(corpus, window).collect(), corpus_rows, window, path)
        assert sum(f < window for f in fills) <= corpus.rdd.getNumPartitions()
    rows = packing.pack(odd).collect()
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 2 * [r for r in rows if r["doc_id"] == 6][0]["doc_tokens"]
    assert packing.pack(none).count() == 0


def test_word_encoder():
    import random

    path, rng = packing.vocabulary_path(), random.Random(1)
    parts = [" ", " ", "\n", "a", "b", "é", "1", ".", "'s", "\t", " ", "中", "  ", "word", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)]
    encoder = packing.WordEncoder(path)
    assert [x + (1).to_bytes(4, "little") for x in encoder.encode(texts)] == brute_packing_ids(texts, path)


def test_word_encoder_holds_few(monkeypatch):
    """One call with more words than a worker may remember gives exact ids and leaves no more than those."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    path = packing.vocabulary_path()
    encoder = packing.WordEncoder(path)
    for a in (0, 15, 7, 40):
        texts = [f"word{i} other{i + 1} word{i}" for i in range(a, a + 30)] + ["", "a<|endoftext|>b"]
        assert [x + (1).to_bytes(4, "little") for x in encoder.encode(texts)] == brute_packing_ids(texts, path)
        assert len(encoder.cache) <= 20


def test_sum_of_squares_choice():
    """Each choice minimises the sum of squared counts, by trying all."""
    import random

    rng, packer = random.Random(5), packing.SumOfSquares(16)
    for doc in range(300):
        n = rng.randint(1, 15)
        before = packer.counts.copy()

        def cost(h, n=n, before=before):
            after = before.copy()
            if h:
                after[h] -= 1
            if h + n < 16:
                after[h + n] += 1
            return int((after**2).sum())

        best = min(cost(h) for h in range(17 - n) if not h or before[h])
        list(packer.add(doc, n))
        assert int((packer.counts**2).sum()) == best


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh(rng, 3).items()}
    pre = rng.normal(size=(5, 4, 6 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1, 0]] + [[1, 1, 0, 0]] * 4, dtype=float)
    mask[1, 2] = 1
    labels = np.array([1.0, 0, 1, 0])
    _, g, d_pre = toxicity.gradients(p, pre.astype(np.float32), mask.astype(np.float32), labels)

    def loss():
        prob = toxicity.sigmoid(toxicity.forward(p, pre, mask))
        return -np.mean(labels * np.log(prob + 1e-9) + (1 - labels) * np.log(1 - prob + 1e-9))

    for name in ("u0", "u1", "watt", "vatt", "wout", "batt"):
        flat, at = p[name].reshape(-1), int(rng.integers(p[name].size))
        was, e = flat[at], 1e-2
        flat[at] = was + e
        up = loss()
        flat[at] = was - e
        down = loss()
        flat[at] = was
        assert np.asarray(g[name]).reshape(-1)[at] == pytest.approx((up - down) / (2 * e), abs=2e-3)
    was = pre[0, 0, 5]
    pre[0, 0, 5] = was + 1e-2
    up = loss()
    pre[0, 0, 5] = was - 1e-2
    assert d_pre[0, 0, 5] == pytest.approx((up - loss()) / 2e-2, abs=2e-3)


def test_ngrams():
    words = [b"ab", b"c", "é".encode(), b"abcdef"]
    where, grams = toxicity.ngrams(words)
    wanted = sorted(i for i, w in enumerate(words) for n in (3, 5, 7) for _ in range(max(0, len(w) + 2 - n + 1)))
    assert sorted(where.tolist()) == wanted and grams.max() < toxicity.BUCKETS
    alone = toxicity.ngrams([b"abcdef"])[1]
    assert set(alone.tolist()) == set(grams[where == 3].tolist())


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(200)]
    texts, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, int(rng.integers(5, 200))))
        if i % 4 == 0:
            text.insert(int(rng.integers(len(text))), "vile" + str(rng.choice(words)))
        texts.append(" ".join(text))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts[:480], labels[:480])
    found = model.scores(texts[480:]) >= 0.5
    assert np.mean(found == np.array(labels[480:], dtype=bool)) >= 0.85
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["tox_score"] <= 1 for r in rows)
    assert len({r["tox_score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert toxicity.score_documents(none, model).count() == 0
    tags = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.model_for(odd, tags) == 0.0
    assert toxicity.score_documents(odd, 0.0).filter("tox_score = 0").count() == 10


def brute_score(model, text):
    """A forward pass word by word, window by window."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    words = (text or "").lower()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", words.encode())
    best, h, sig = -np.inf, toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    starts = [0]
    while starts[-1] + 64 < len(words):
        starts.append(starts[-1] + 48)
    for start in starts:
        vectors = [model.inputs.vectors([w])[0].astype(np.float64) for w in words[start : start + 64]]
        directions = []
        for k, u in ((0, p["u0"]), (1, p["u1"])):
            state, states = np.zeros(h), []
            for x in vectors if k == 0 else vectors[::-1]:
                pre = (x @ p["win"] + p["bin"])[3 * h * k : 3 * h * (k + 1)]
                z, r = sig(pre[:h] + state @ u[:, :h]), sig(pre[h : 2 * h] + state @ u[:, h : 2 * h])
                new = np.tanh(pre[2 * h :] + r * (state @ u[:, 2 * h :]))
                state = z * state + (1 - z) * new
                states.append(state)
            directions.append(states if k == 0 else states[::-1])
        pooled = np.zeros(2 * h)
        if vectors:
            both = np.array([np.concatenate(x) for x in zip(*directions, strict=True)])
            score = np.tanh(both @ p["watt"] + p["batt"]) @ p["vatt"]
            weight = np.exp(score - score.max())
            pooled = (weight / weight.sum()) @ both
        best = max(best, pooled @ p["wout"] + p["bout"][0])
    return sig(best - model.shift)


def test_toxicity_scores_by_hand():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefé"), 3)) for _ in range(80)]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 40, 63, 64, 65, 112, 113, 300, 20, 30, 50) * 5] + ["", "... !"]
    labels = [int("aab" in t or i % 7 == 0) for i, t in enumerate(texts)]
    model = toxicity.train(texts, labels)
    assert np.allclose(model.scores(texts), [brute_score(model, t) for t in texts], atol=1e-4)


def test_toxicity_holds_few_words(monkeypatch):
    """A worker's table holds no more words than it may remember, or than one call has, and scores do not depend on it."""
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)) for _ in range(40)]
    model = toxicity.train(texts, [i % 2 for i in range(40)])
    wanted = [model.scores([t])[0] for t in texts]
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 100)
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    model._reset()
    for text, score in zip(texts, wanted, strict=True):
        assert np.isclose(model.scores([text])[0], score, atol=1e-5)
        assert len(model.known) <= 100 and len(model.table) <= 101
    assert np.allclose(model.scores(texts), wanted, atol=1e-5)


def test_toxicity_labels(spark):
    """A doc_id with both labels is toxic, repeated rows are learned from once, and the whole text is read."""
    tags = spark.createDataFrame([(i, t) for i in range(1, 60) for t in ((0, 1) if i % 3 == 0 else (0,))], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"{c} text " + "x " * 30_000) for i in range(1, 60) for c in "ba"], "doc_id long, text string").repartition(5)
    rows, natural = toxicity.labelled_sample(docs, tags)
    held_in = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    assert [(d, y) for d, y, _ in rows] == [(i, int(i % 3 == 0)) for i in held_in]
    assert all(t.startswith("a ") and len(t) > 60_000 for *_, t in rows)
    assert natural == (sum(i % 3 > 0 for i in held_in), sum(i % 3 == 0 for i in held_in))


def test_threshold_by_weight():
    logits, labels = np.array([5.0, 4, 3, 2, 1]), np.array([1, 0, 1, 0, 0])
    assert toxicity._threshold(logits, labels) == 2.5
    # Where label 0 is far more frequent than in the sample, its rows weigh more.
    assert toxicity._threshold(logits, labels, np.where(labels == 1, 0.1, 5.0)) == 4.5


def test_windows_cover_all():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        spans = toxicity.windows_of(n)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b >= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        assert all(b - a <= toxicity.WINDOW for a, b in spans)
