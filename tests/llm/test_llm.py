"""Operators of the llm subpackage against plain code on small tables."""

import hashlib
import math
import os
import random
import re
import string
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veinstone.llm import arrowtokens, bpe, components, decontam, hosts, langid, linededup, media, pii, quality, simhash
from veinstone.llm.common import scratch, shared_dir
from veinstone.llm.queries import rank_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, id string, h string"
LONG = "lorem ipsum dolor sit amet " * 6000


def random_texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["The", "x@y.example.com", "1.2.3.4", "!!"]
    out = []
    for _ in range(n):
        out.append("\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))))
    return out


def odd_docs(spark, texts=None):
    """Nulls in every column, empty and long texts, repeats and columns with clashing names."""
    texts = random_texts() if texts is None else texts
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 11}", len(t), "n", "i", "h") for i, t in enumerate(texts)]
    rows += [(900, None, "en", "s1", None, None, None, None), (901, "", None, None, 0, "", "", ""), (902, LONG, "en", None, 1, "", "", ""), (903, " \n\t ", "en", "s2", 1, "", "", "")]
    rows += [(3, texts[3], "fr", "s3", 1, "n", "i", "h"), (904, texts[3], "fr", "s9", 1, "n", "i", "h"), (None, texts[4], "en", "s4", 1, "n", "i", "h"), (905, "12345 !!", "en", "s1", 8, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "")


def test_bpe_equals_tiktoken(spark):
    ranks = bpe.parse_ranks(rank_file())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, rows = odd_docs(spark)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["well_formed"]) for r in bpe.encode_decode(docs, rank_file(), public_tokenizers.PATTERN).collect())
    want = []
    for r in rows:
        ids = np.array(reference.encode_ordinary(r[1] or ""), "<u4")
        want.append((r[0] is None, r[0] or 0, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), True))
    assert got == sorted(want)
    assert bpe.encode_decode(empty_docs(spark), rank_file(), public_tokenizers.PATTERN).count() == 0


def test_bpe_random_pieces_and_small_memory():
    ranks = bpe.parse_ranks(rank_file())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, max_pieces=50)
    encoder.transducer.max_states = 200
    rng = random.Random(2)
    for _ in range(2000):
        alphabet = rng.choice(["ab", "aab ", "the ing", "é中 a", "0123 ", "!-= \n\t ", "abcdefghij' s"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_streaming_decode_holds_back_unfinished_characters():
    ranks = bpe.parse_ranks(rank_file())
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    text = "naïve \U0001f600 中文 test"
    ids = np.frombuffer(encoder.encode(text), "<u4")
    parts = list(decoder.stream([ids[i : i + 1] for i in range(len(ids))]))
    assert "".join(parts) == text and decoder.ends_clean(ids)
    byte = [ranks[bytes([b])] for b in "é".encode()]
    assert not decoder.ends_clean(np.array(byte[:1])) and not decoder.ends_clean(np.array(byte[1:]))
    assert not decoder.ends_clean(np.array([byte[0], ranks[b"a"]])) and not decoder.ends_clean(np.array([byte[0], ranks[b"a"], byte[1]]))


def test_media_round_trip(spark):
    docs, rows = odd_docs(spark)
    got = media.texts_as_media(docs, with_media=True).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        data = texts[r["doc_id"]]
        payload = data + bytes(64 if not data else -len(data) % 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert media.texts_as_media(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("size", [1, 64, 1000, 70_000, 530_000])
def test_media_any_bytes(size):
    data = media.padded(np.random.default_rng(size).integers(0, 256, size, "u1").tobytes())
    image, coded, feature = media.describe([media.encode(data)])[0]
    assert media.stored(image, coded) == data and ":" in feature


def plain_hash(grey):
    """Every pixel cut into 8 x 8, so that cells of the average are whole."""
    fine = np.kron(grey.astype("i8"), np.ones((8, 8), "i8"))
    h, w = grey.shape
    cells = [fine[h * i : h * i + h, w * j : w * j + w].sum() for i in range(8) for j in range(8)]
    return f"{int(''.join('1' if 64 * c > sum(cells) else '0' for c in cells), 2):016x}"


def test_media_hash_equals_plain_averages_of_near_square_images():
    rng = np.random.default_rng(4)
    varied = 0
    for blocks in [1, 2, 3, 5, 8, 13, 64, 100, 777, 3000]:
        payload = rng.integers(0, 256, (blocks, 64)).astype("u1")
        payload[:, 0] = (rng.integers(0, 256) * np.sin(np.arange(blocks) / rng.uniform(1, 30)) ** 2).astype("u1")
        image, coded, feature = media.describe([media.encode(payload.tobytes())])[0]
        wide = math.isqrt(blocks - 1) + 1
        assert (image.width, image.height) == (8 * wide, 8 * -(-blocks // wide))
        dc = payload[:, 0].astype(int)  # the byte's coefficient, over 8, on middle grey
        dc = np.concatenate([np.where(dc < 128, dc - 255, dc), np.full(wide * -(-blocks // wide) - blocks, -255)])
        grey = np.clip(np.rint(dc / 8 + 128), 0, 255).reshape(-1, wide)
        assert (media.thumbnail(image, coded) == grey).all()
        assert feature == f"{image.width}x{image.height}:{plain_hash(grey)}"
        bits = f"{int(feature[-16:], 16):064b}"
        varied += len({bits[i : i + 8] for i in range(0, 64, 8)}) > 1 and len({bits[i::8] for i in range(8)}) > 1
    assert varied >= 5


def test_media_general_huffman_codes_without_restarts():
    """A colour image with subsampling, runs of zeros and end-of-block codes, from another encoder."""
    rng = np.random.default_rng(5)
    lengths = bytes([0, 1, 2, 2, 2, 4, 4, 8, 16, *[0] * 7])
    symbols = bytes([0x00, 0x01, 0x02, 0x03, 0x04, 0x11, 0x05, 0x21, 0xF0, 0x12, 0x31, 0x06, 0x41, 0x07, 0x13, 0x51, *range(0x60, 0x60 + 23)])
    codes, code, i = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            codes[symbols[i]] = f"{code:0{n}b}"
            code, i = code + 1, i + 1
        code <<= 1
    layout, units, want, bits, dc = [0, 0, 0, 0, 1, 2], 4, [], [], [0, 0, 0]

    def put(run, value):
        size = int(abs(value)).bit_length()
        bits.append(codes[run << 4 | size] + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""))

    for _ in range(units):
        for c in layout:
            block = np.zeros(64, int)
            block[0] = dc[c] + rng.integers(-15, 16)
            put(0, block[0] - dc[c])
            dc[c] = block[0]
            run, last = 0, 0
            for k in sorted(rng.choice(np.arange(1, 64), rng.integers(0, 6), replace=False).tolist()):
                run = k - last - 1
                while run > 15:
                    bits.append(codes[0xF0])
                    run -= 16
                block[k] = rng.choice([-1, 1]) if (run << 4 | 1) in codes else 0
                if not block[k]:
                    break
                put(run, block[k])
                last = k
            if last < 63:
                bits.append(codes[0])
            want.append(block)
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    scan = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")
    seg = media._segment
    frame = b"\x08" + (32).to_bytes(2, "big") + (32).to_bytes(2, "big") + b"\3\1\x22\0\2\x11\0\3\x11\0"
    jpeg = b"\xff\xd8" + seg(0xDB, b"\0" + b"\2" * 64) + seg(0xC0, frame) + seg(0xC4, b"\0" + lengths + symbols) + seg(0xC4, b"\x10" + lengths + symbols) + seg(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + scan + b"\xff\xd9"
    image = media.parse(jpeg)
    coded = media.coefficients([image])[0]
    assert (coded == np.array(want)).all()
    grey = media.thumbnail(image, coded)
    y = np.array(want).reshape(2, 2, 6, 64)[:, :, :4, 0].reshape(2, 2, 2, 2).transpose(0, 2, 1, 3).reshape(4, 4)
    assert (grey == np.clip(np.rint(y * 2 / 8 + 128), 0, 255)).all()


def test_arrow_tokens(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs, rows = odd_docs(spark)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in arrowtokens.tokens_to_arrow(docs, path, 2).collect())
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0] is None, r[0] or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert arrowtokens.tokens_to_arrow(empty_docs(spark), path, 2).count() == 0


def test_arrow_sequences_are_views(tmp_path):
    writer = arrowtokens.SequenceWriter(f"file://{tmp_path}/a.arrow", "<u2")
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40000, n).astype("<u2") for n in (5, 0, 700_000, 3000, 1)]
    for d in docs:
        writer.add(d.tobytes())
    writer.close()
    file, whole = arrowtokens.SequenceFile(f"file://{tmp_path}/a.arrow"), np.concatenate(docs)
    for i in (0, 1, 255, 256, len(whole) // arrowtokens.LENGTH - 1):
        assert (file.sequence(i) == whole[i * arrowtokens.LENGTH : (i + 1) * arrowtokens.LENGTH]).all()
    assert sum(int(m.sum()) for _, m in file.batches()) == len(whole)
    for d, parts in zip(docs, file.documents(iter([len(d) for d in docs])), strict=True):
        assert (np.concatenate([np.empty(0, "u2"), *parts]) == d).all()


def test_word_encoder_equals_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(8)
    encoder = arrowtokens.word_encoder(path)
    texts = ["".join(rng.choice("aB's 1é\u0301\n\t\r\u00a0\u2003\x1c!<|endoftext|>Σς中") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["x <|endoftext|> y", "ΑΣ ΑΣ."]
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xDF, 0x100)]]
    texts += [rng.choice(letters) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + letters
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_encoder_beside_every_closing_sign():
    """Code points before and after every closing sign, so also letters that become letter and mark.

    Of the large blocks of ideographs, syllables and signs that are all alike every 50th is taken; once all passed.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), arrowtokens.word_encoder(path)
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs") and (c < 0x3000 or 0xA640 <= c < 0xAC00 or 0xF900 <= c < 0x12000 or c % 50 == 0)]
    signs = sorted(arrowtokens.CLOSING)
    texts = ["".join(f"{c}{s} {s}{c} x{c}{s} " for c in points[at : at + 200]) for s in signs for at in range(0, len(points), 200)]
    whole = tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, ids, want in zip(texts, encoder.encode(texts), whole, strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == want.ids, repr(text[:60])
    hindi = ["\u092a\u095d, \u0932\u095c.", "\u0130stanbul\u0130, \u0130!"]
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(hindi)] == [x.ids for x in tokenizer.encode_batch(hindi, add_special_tokens=False)]


def test_arrow_tokens_of_one_id_are_dealt_over_tasks(spark):
    docs = spark.createDataFrame([(7, f"text {i % 5} " * 20) for i in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = arrowtokens.write_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2, f"{shared_dir(spark)}/one-id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(m["n_docs"] for m in manifest) == 400
    assert max(m["n_docs"] for m in manifest) < 300


def test_other_tokenizer_files_read_whole_texts():
    arrowtokens.word_encoder.cache_clear()
    assert isinstance(arrowtokens.word_encoder(public_tokenizers.path("word_bpe_49k.json")), arrowtokens.WordEncoder)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, texts = arrowtokens.word_encoder(path), [*random_texts(10, 3), "", "Two  words\n\tand, more"]
    assert isinstance(encoder, arrowtokens.WholeEncoder)
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == [w.ids for w in whole]
    arrowtokens.word_encoder.cache_clear()


def plain_kneser_ney(texts, order):
    """Probabilities straight from the definition."""
    counts = {order: Counter()}
    for t in texts:
        b = quality.START + t
        for i in range(len(quality.START), len(b)):
            counts[order][b[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ds = {k: quality.discounts([sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]) for k in counts}

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        below = p(g[1:])
        around = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        if not around:
            return below
        d = lambda c: ds[k][min(c, 3) - 1]
        total = sum(around.values())
        mine = counts[k].get(g, 0)
        return (max(mine - d(mine), 0) if mine else 0) / total + sum(map(d, around.values())) / total * below

    return p


def test_kneser_ney(spark):
    texts = [t[:60] for t in random_texts(8, 4)]
    table = quality.backoff_table(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string"))
    rows = table.collect()
    none = float("nan")
    model = quality.Model.__new__(quality.Model)
    model.whole = quality.Shard(np.array([r["g"] for r in rows], "i8"), np.array([none if r["logp"] is None else r["logp"] for r in rows], "f4"), np.array([r["bow"] or 0 for r in rows], "f4"))
    p = plain_kneser_ney([t.encode() for t in texts], quality.ORDER)
    for t in [texts[0], texts[3][:20], "zzz bé", "\n\nA"]:
        b = quality.START + t.encode()
        want = [np.log(p(b[i - quality.ORDER + 1 : i + 1])) for i in range(len(quality.START), len(b))]
        assert np.allclose(model.log_probabilities(t.encode()), want, atol=1e-4)


def test_quality_keeps_good_and_drops_noise(spark):
    texts = random_texts(200, 9)
    rng = random.Random(1)
    rows = [(i, t, "en", "s", 1, "", "", "") for i, t in enumerate(texts)] + [(500 + i, "".join(rng.choice("QXZ#%0") for _ in range(200)), "en", "s", 1, "", "", "") for i in range(5)]
    rows += [(600, None, None, None, None, "", "", ""), (601, "", "en", "s", 0, "", "", ""), (602, texts[0], None, "s", 0, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(151, 1, 1), (152, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) and not any(got[500 + i]["keep"] for i in range(5))
    assert sum(got[i]["keep"] for i in range(200)) > 180 and got[600]["keep"] and got[601]["perplexity"] is None
    assert all(r["keep"] for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(empty_docs(spark), labels).count() == 0


@pytest.mark.parametrize("resident", [quality.RESIDENT_ROWS, 0])
def test_quality_equals_a_plain_model_and_a_plain_quantile(spark, monkeypatch, resident):
    """Perplexities, thresholds and verdicts of every document, by a worker's table and by joins over small blocks."""
    monkeypatch.setattr(quality, "RESIDENT_ROWS", resident)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 300)
    texts = [t[:50] for t in random_texts(60, 14)] + ["", None, "zzz QQQ \u4e2d", "a"]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 0, "", "", "") for i, t in enumerate(texts)] + [(3, "another text", "en", "s", 0, "", "", ""), (None, texts[5], "fr", "s", 0, "", "", "")]
    labels = [(i, int(i % 4 != 1), int(i % 9 == 2)) for i in range(0, 60, 1)] + [(8, 0, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    worst = defaultdict(lambda: (1, 0))
    for i, q, x in labels:
        worst[i] = (min(worst[i][0], q), max(worst[i][1], x))
    good = {i for i, w in worst.items() if i is not None and w == (1, 0)}
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    trusted = [t.encode() for i, t, *_ in rows if i in good and not fold(i) and t is not None]
    p = plain_kneser_ney(trusted, quality.ORDER)
    want, held = [], defaultdict(list)
    for i, t, lang, *_ in rows:
        b = quality.START + (t or "").encode()
        logs = [np.log(p(b[j - quality.ORDER + 1 : j + 1])) for j in range(len(quality.START), len(b))]
        nats = -np.mean(logs) if logs else None
        want.append((i, lang or "und", nats))
        if nats is not None and i in good and fold(i):
            held[lang or "und"].append(nats)
    held[None] = [x for v in held.values() for x in v]
    limit = {}
    for lang, v in held.items():
        bins = sorted(math.ceil(x / quality.BIN) for x in v)
        limit[lang] = bins[math.ceil(quality.QUANTILE * len(bins)) - 1] * quality.BIN
    assert len(held) > 2 and len(got) == len(want)
    for r, (i, lang, nats) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["lang"], r["perplexity"] or 0)), sorted(want, key=lambda w: (str(w[0]), w[1], w[2] or 0)), strict=True):
        assert (r["doc_id"], r["lang"]) == (i, lang)
        top = limit.get(lang, limit[None])
        assert abs(r["threshold"] - math.exp(top)) < 1e-3
        if nats is None:
            assert r["perplexity"] is None and r["keep"]
        else:
            assert abs(math.log(r["perplexity"]) - nats) < 1e-4
            assert r["keep"] == (nats <= top) or abs(nats - top) < 1e-4


def test_quality_by_joins_equals_resident(spark, monkeypatch):
    docs, _ = odd_docs(spark, random_texts(60, 6))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    one = sorted(map(str, quality.classify(docs, labels).collect()))
    monkeypatch.setattr(quality, "RESIDENT_ROWS", 0)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(quality, "HELD_GRAMS", 100)
    assert sorted(map(str, quality.classify(docs, labels).collect())) == one


def test_url_rules_and_reputation(spark):
    urls = [
        ("http://A.Example.ORG/es/x", "a.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/12?q", "example.org", "/en/12", "example.org/en/1", "block"),
        ("x://b.org", "b.org", "", None, "allow"), ("http://b.org/?x", "b.org", "/", "org/", "allow"), ("http://c.com/de/", "c.com", "/de/", "com/de/", "block"), ("http://c.com/fr/a#b", "c.com", "/fr/a", "com/fr/", "allow"),
        ("http://notorg/fr/", "notorg", "/fr/", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"), ("http://h.net#/x", "h.net", "", None, "allow"),
    ]
    bad = [(1000 + i, "http://bad.spam.net/p") for i in range(40)]
    good = [(2000 + i, f"http://g{i % 5}.fine.net/p") for i in range(200)]
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(urls)] + [(*b, None) for b in [*bad, *good]] + [(5000, "http://new.spam.net/", "h")], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(i, 1) for i, _ in bad[:30]] + [(i, int(i % 50 == 0)) for i, _ in good] + [(2001, 0), (None, 1), (2003, None)], "id long, bad int")
    got = {r["page_id"]: r for r in hosts.judge(pages, outcomes).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict)
    assert all(got[i]["verdict"] == "block" for i, _ in bad) and all(got[i]["verdict"] == "allow" for i, _ in good)
    assert len(got) == pages.count()
    assert hosts.judge(pages.limit(0), outcomes).count() == 0
    assert {r["verdict"] for r in hosts.judge(pages, outcomes.limit(0)).where("rule is null").collect()} == {"allow"}


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("block, pivots", [(10_000, 64), (2, 0), (3, 1)])
def test_simhash_components_equal_brute_force(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    texts = random_texts(80, 3) + ["a b c", "A B c", "one", "one two"]
    docs, rows = odd_docs(spark, texts)
    for budget in (2, 5):
        fps = [plain_fingerprint(r[1]) for r in rows]
        up = list(range(len(rows)))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= budget:
                    up[root(i)] = root(j)
        least = defaultdict(list)
        for i, r in enumerate(rows):
            least[root(i)].append(r[0])
        want = sorted((str(r[0]), f"{fps[i]:016x}", min(x for x in least[root(i)] if x is not None)) for i, r in enumerate(rows))
        got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs, 3, budget).collect())
        assert got == want
    assert simhash.simhash_components(empty_docs(spark)).count() == 0


def test_components_of_paths_and_hubs(spark):
    rng, n = random.Random(4), 300
    edges = [(i, i + 1) for i in range(0, 100)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(260, n), rng.randrange(260, n)) for _ in range(15)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for s in sorted(near):
        stack = [s] if s not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = s
                stack += near[x]
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def heads(docs, **options):
    """Every row of near_groups: (id, head)."""
    return sorted(((r["id"], r["head_id"]) for r in simhash.near_groups(docs, **options).collect()), key=str)


def test_near_groups(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    base = [[word() for _ in range(200)] for _ in range(30)]
    rows, group = [], {}
    for g, words in enumerate(base):
        for c in range(4):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    n = len(rows)
    rows += [(n, " ".join(base[0][:100] + base[1][:100])), (n + 1, None), (n + 2, ""), (n + 3, " "), (n + 1, None)]
    rows += [(n + 4, rows[7][1]), (n + 4, rows[7][1]), (None, rows[7][1]), (5, "an id of another text"), (0, rows[0][1]), (None, "a text without an id"), (None, "a text without an id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, h string")
    want = [(i, 4 * g) for i, g in group.items() if i != 4 * g] + [(n + 4, 4), (None, 4), (0, 0), (None, None)]
    assert heads(docs) == sorted(want, key=str)
    assert heads(docs.limit(0)) == []
    assert heads(docs.selectExpr("cast(doc_id as string) doc_id", "text")) != []


def plain_groups(docs, size=5, similarity=0.8):
    """Head of every document that isn't the first of its group, by all pairs with a shingle in common."""
    sets, having = {}, defaultdict(list)
    for i, t in docs:
        w = (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).encode().split()
        sets[i] = {b" ".join(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
        for x in sets[i]:
            having[x].append(i)
    head = {i: i for i in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in sets:
        both = Counter(b for x in sets[a] for b in having[x] if b > a)
        for b, c in both.items():
            if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    return sorted(((i, root(i)) for i in sets if root(i) != i), key=str)


@pytest.mark.parametrize("block, shingles, pivots", [(10_000, 4_000_000, 64), (4, 4_000_000, 1), (10_000, 300, 2), (3, 100, 0), (11, 100, 1)])
def test_near_groups_around_the_threshold(spark, monkeypatch, block, shingles, pivots):
    """Texts of 50 to 100 words with 1 to 4 changes lie on both sides of 0.8; buckets that are dealt in blocks lose no link."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(50, 100))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    assert heads(spark.createDataFrame(rows, "doc_id long, text string")) == plain_groups(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_large_group_and_one_borderline_text(spark, seed):
    """A text that is near to one of 300 copies and just below 0.8 to the rest is found."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    base = [word() for _ in range(200)]
    changed = lambda places: " ".join(word() if i in places else w for i, w in enumerate(base))
    apart = (30, 80, 130, 180)  # four changes: 0.815 to a copy changed at one of these places, 0.774 to the others
    rows = [(i, changed({rng.choice([p for p in range(5, 195) if min(abs(p - q) for q in apart) > 5])})) for i in range(300)]
    rows += [(300, changed({30})), (301, changed(set(apart)))]
    found = heads(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == plain_groups(rows) == sorted(((i, 0) for i in range(1, 302)), key=str)


def test_near_groups_writes_few_links_for_a_dense_group_below_the_threshold(spark):
    """300 texts whose pairs lie around 0.7: what is written grows with the texts, not with their pairs."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(300):
        places = rng.sample(range(200), 3)
        rows.append((i, " ".join(word() if j in places else w for j, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = docs.selectExpr("doc_id id", "xxhash64(text) h", "text")
    made = simhash.sketches(plain, 5).selectExpr("*", "id class")
    assert simhash._candidates(made, plain, 5, 0.8).count() <= 8 * len(rows)
    assert heads(docs) == plain_groups(rows)


def test_near_groups_equal_brute_force_under_a_hot_key(spark, monkeypatch):
    """All documents of sf0.01 and near copies among 2,400 texts that share a long passage: recall by brute force."""
    monkeypatch.setattr(simhash, "BLOCK", 500)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    passage, first = [word() for _ in range(60)], 10_000_000
    for i in range(2400):
        if i % 20:
            w = passage + [word() for _ in range(20)]
        else:  # a near copy of the text before
            w = rows[-1][1].split() if i else list(passage)
            w[rng.randrange(len(w))] = word()
        rows.append((first + i, " ".join(w)))
    want, got = plain_groups(rows), heads(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(set(want) & set(got)) >= 0.9 * len(want)
    assert got == want  # measured: nothing is lost


@pytest.mark.parametrize("apart", [0, 30])
def test_a_large_bucket_of_copies_costs_its_blocks(spark, monkeypatch, apart):
    """600 rows in one bucket, all alike but some: tasks grow with the blocks, and what is connected is what all pairs connect."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    monkeypatch.setattr(simhash, "PIVOTS", 5)
    monkeypatch.setattr(simhash, "TASK_ROWS", 1)
    far = lambda i: 600 - apart <= i
    rows = spark.createDataFrame([(i, 10 + i % 7, 1000 * i if far(i) else i % 2, 5) for i in range(600)], "class long, n int, x long, bucket long")
    dealt = []

    def find(df):
        dealt.append(df.groupBy("task").count().collect())
        pairs = df.select(F.col("class").alias("a"), F.col("x").alias("p"), "task").join(df.select(F.col("class").alias("b"), F.col("x").alias("q"), "task"), "task")
        return pairs.where("a > b AND abs(p - q) <= 1").select("a", "b")

    band = F.col("n") % 1
    got = {r["node"]: r["root"] for r in components.components(simhash._links(rows, F.lit(1 / 20), band, find)).collect()}
    assert got == {i: 0 for i in range(600 - apart)}
    assert len(dealt) == (2 if apart else 1) and sum(len(x) for x in dealt) <= 30 + 3 * 30 and sum(r["count"] for x in dealt for r in x) < 600 * 8


def test_a_key_of_texts_with_a_common_passage_is_cut_without_losing_links(spark, monkeypatch):
    """400 texts in one bucket that share a passage: cut by rare shingles, and every near pair still meets."""
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    passage, rows = [word() for _ in range(40)], []
    for i in range(400):
        w = rows[-1][1].split() if i % 8 == 1 else passage + [word() for _ in range(40)]
        if i % 8 == 1:
            w[rng.randrange(40, 80)] = word()
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id id", "xxhash64(text) h", "text")
    made = simhash.sketches(docs, 5).selectExpr("*", "id class", "7L bucket").drop("fp", "keys")
    cut = simhash._by_rare_shingles(made, docs, 5, 0.8).select("bucket", "class").collect()
    at = defaultdict(set)
    for r in cut:
        at[r["bucket"]].add(r["class"])
    assert sum(len(v) ** 2 for v in at.values()) < 400**2 / 20
    near = plain_groups(rows)
    assert len(near) == 50 and all(any({a, b} <= v for v in at.values()) for a, b in near)


def test_near_groups_leave_no_folder(spark):
    place = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(place))
    with scratch(spark):
        simhash.near_groups(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert set(os.listdir(place)) == before


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_plain_spans():
    rng = random.Random(5)
    for _ in range(20_000):
        alphabet = rng.choice(["a@.b", "a@._1 é", "1.2 ", "0123456789 -", "+1 2(3).4-", "a.@-1+ "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert pii.plain(text) == plain_pii(text), text


def test_pii_disguises_map_back():
    cases = {"write to john (at) mail (dot) example (dot) com now": "john (at) mail (dot) example (dot) com", "é bob at example dot com": "bob at example dot com", "j\u043ehn@ex\u0430mple.com": "j\u043ehn@ex\u0430mple.com", "\uff11\uff19\uff12.168.0.1 x": "\uff11\uff19\uff12.168.0.1", "joe[at]mail.example.org": "joe[at]mail.example.org", "a\u200b@b.example": "a\u200b@b.example", "call plus four nine one seven six five five five one two three four!": "plus four nine one seven six five five five one two three four"}
    for text, span in cases.items():
        base, found = pii.find(text)
        assert [text[a:b] for _, a, b in found] == [span], text
    for text in ("we met at noon on one dot", "look at this dot plot", "seven eight nine ten"):
        assert pii.find(text) == ([], [])


def plain_rewrite(text):
    """The three rewritings character by character, each with the source span of every character of its output."""
    numeral = "|".join(pii.DIGIT_WORDS)
    bracketed = r"\(\s*(?:at|dot)\s*\)|\[\s*(?:at|dot)\s*\]|\{\s*(?:at|dot)\s*\}|<\s*(?:at|dot)\s*>"
    connector = re.compile(rf"\s*(?:{bracketed})\s*|\s+(?:at|dot)\s+", re.I)

    def follows(t, i):
        """(a domain follows, the labels, the connector behind them, the domain ends a clause)"""
        labels = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*", re.I).match(t, i)
        if not labels:
            return False, None, None, False
        behind = connector.match(t, labels.end())
        behind = behind if behind and "dot" in behind.group().lower() else None
        names = labels.group().lower().split(".")
        ends = any(x in pii.TOP_LEVEL for x in names)
        rest = t[labels.end() :].replace("\n", "!").lstrip()
        closes = follows(t, behind.end())[3] if behind else names[-1] in pii.TOP_LEVEL and (not rest or rest[0] in ".,;:!?)]}>\"'\u2019\u201d")
        return ends or (behind is not None and follows(t, behind.end())[0]), labels.group(), behind, closes

    def spelled_connector(t, i, done):
        m = connector.match(t, i)
        if not m or (t[i].isspace() and i > done and t[i - 1].isspace()):
            return None
        said = m.group().strip()
        leads, labels, behind, closes = follows(t, m.end())
        if said[0] in "([{<":
            take = True
        elif said.lower() == "dot":
            take = leads or bool(re.compile(rf"(?:{numeral}|[0-9]+)\b", re.I).match(t, m.end()) and re.search(rf"(?:\b(?:{numeral})|[0-9])$", t[: m.start()], re.I))
        else:
            take = behind is not None and "." not in labels and closes
        at = i + m.group().index(said)
        return (m.end(), "." if "dot" in said.lower() else "@", at, at + len(said)) if take else (m.end(), None, i, i)

    def spelled_digit(t, i, done):
        m = re.compile(rf"\b(?:plus\s+(?=(?:{numeral}|[0-9]+)\b)|(?:{numeral})\b(?:[\s,]+(?=(?:{numeral}|[0-9]+)\b))?)", re.I).match(t, i)
        if not m:
            return None
        word = re.match(r"\w+", m.group()).group()
        folded = word.lower().replace("\u0131", "i").replace("\u017f", "s")
        return m.end(), pii.DIGIT_WORDS.get(folded, "+"), i, i + len(word)

    chars, spans = list(text), [(i, i + 1) for i in range(len(text))]
    kept = [(r, s) for c, s in zip(chars, spans) for r in pii._plain_char(c)]
    for step in (spelled_connector, spelled_digit):
        t, spans = "".join(r for r, _ in kept), [s for _, s in kept]
        kept, i, done = [], 0, 0
        while i < len(t):
            edit = step(t, i, done)
            if edit is None:
                kept.append((t[i], spans[i]))
                i += 1
            else:
                end, new, a, b = edit
                kept += [(new, (spans[a][0], spans[b - 1][1]))] if new else list(zip(t[i:end], spans[i:end]))
                i = done = end
    return "".join(r for r, _ in kept), [s for _, s in kept]


def test_pii_equals_rewriting_all_and_mapping_back():
    rng = random.Random(15)
    words = ["at", "dot", "(at)", "( dot )", "[dot]", "{AT}", "<dot>", "(at]", "one", "two", "Seven", "oh", "plus", "plus", "com", "org", "uk", "mail", "example", "joe", "a.b", "x" * 300, "192", "168", "1", "0", "+", "+1",
             "4111 1111 1111 1111", "1" * 25, "555", "0100", "j\u043ehn", "\uff11\uff19", "\u200b", "@", ".", ",", "-", "é", "\u09e7", "\u017fix", "e\u00a0f", "a@b.example", "10.0.0.1", "at  at", "dot dot"]
    seen = 0
    for _ in range(20_000):
        pieces = [rng.choice(words) for _ in range(rng.randint(1, 10))]
        dot = lambda: rng.choice([" dot ", "(dot)", ".", "[ dot ] ", " DOT "])  # noqa: B023, E731
        digit = lambda: rng.choice([*"0123456789", "one", "Two", "oh", "\uff15"])  # noqa: B023, E731
        hidden = [f"joe{rng.choice([' at ', '(at)', '@', ' {at} '])}mail{dot()}example{dot()}com", rng.choice(["+", "plus "]) + " ".join(digit() for _ in range(11)), "192" + dot() + digit() + dot() + "0" + dot() + digit()]
        pieces.insert(rng.randrange(len(pieces) + 1), rng.choice(hidden))
        text = "".join(x + rng.choice([" ", " ", " ", "", "  ", "\n", ", "]) for x in pieces)
        new, spans = plain_rewrite(text)
        base = plain_pii(text)
        more = [] if new == text else [(k, spans[a][0], spans[b - 1][1]) for k, a, b in plain_pii(new)]
        touched = lambda k, a, b: [(s, e) for x, s, e in base if x == k and a < e and s < b]  # noqa: B023, E731
        hidden_in = lambda x: any(pii._plain_char(c) != c for c in x) or re.search(r"\(\s*(at|dot)\s*\)|\[\s*(at|dot)\s*\]|\{\s*(at|dot)\s*\}|<\s*(at|dot)\s*>", x, re.I)
        holds = lambda a, b, on: min(on)[0] >= a and max(on)[1] <= b and (hidden_in(text[a : min(on)[0]]) or hidden_in(text[max(on)[1] : b]))  # noqa: B023, E731
        more = [(k, a, b) for k, a, b in more if not touched(k, a, b) or holds(a, b, touched(k, a, b))]
        want = sorted({*base, *more}, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))
        assert pii.find(text) == (base, want), text
        seen += len(want) > len(base)
    assert seen > 1000


#: Ordinary prose with the words of the disguises, in which there is nothing to find.
PROSE = [
    "let us meet at cafe dot in town", "Look at example dot com for it", "We sat at the table and drew a dot on it.", "She waited at gate one, two and three.", "Meet me at nine at the station", "Aim at the red dot in the middle",
    "The dot at the end is a full stop.", "He arrived at ten and left at two.", "Put a dot at it", "Visit us at example dot org today and say hello", "plus four more at home", "one two three, look at me", "At first the dot was in no place at all.",
    "Version one dot two is at the printer", "They met at dawn, at noon and at dusk.", "a plus b at c dot d", "We stayed at home dot dot dot", "Be at my place at six; the dot is on the map.", "It is at most one plus one", "Look at this dot plot in it",
]
#: Disguises as people write them; in braces what has to be found.
PLANTED = [
    "write to {bob at example dot com}.", "mail {anna.berg (at) post dot example dot org} today", "it is {joe[at]mail.example.net}", "my address: {eve at mail dot example dot co dot uk}", "{j\u043ehn@example.com} wrote", "{anna(dot)berg@example.com} wrote", "contact {x (at) y (dot) org} or call",
    "call {plus four nine one seven one five five five five two one two}", "server {192 dot 168 dot 0 dot 12} is down", "server {\uff1192.168.0.1} is down", "card {\uff14111 1111 1111 1111}", "({tom at example dot de})", "reach me: {sue at example dot io}\nThanks", "{m\u0430x@ex\u0430mple.com}",
]


def test_pii_disguises_in_prose():
    assert [t for t in PROSE if pii.find(t)[1]] == []
    for line in PLANTED:
        want = re.search(r"\{(.*)\}", line, re.S).group(1)
        text = re.sub(r"[{}]", "", line)
        base, found = pii.find(text)
        assert want in [text[a:b] for _, a, b in found], (text, found)
        assert len(found) - len(base) == 1


def test_pii_adds_what_a_look_alike_hides_and_no_more():
    text = "j\u043ehn@example.com"
    assert pii.find(text) == ([("email", 2, len(text))], [("email", 0, len(text)), ("email", 2, len(text))])
    for text in ("call +49 171 5555555 one of us", "one 10.0.0.1 and two", "at joe@example.com dot"):
        base, found = pii.find(text)
        assert len(base) == 1 and found == base


def test_pii_reaches_as_far_as_the_identifier():
    far = "x" * 300 + " (at) mail (dot) example (dot) com"
    assert pii.find(f"to {far} now") == ([], [("email", 3, 3 + len(far))])
    many = "joe at " + " dot ".join("abcdefghij"[i % 10] * 70 for i in range(12)) + " dot com"
    assert [many[a:b] for _, a, b in pii.find(many)[1]] == [many]
    assert pii.find("4" * 25 + " x (at) y") == ([], [])
    for long in (" " * 200_000, "at " * 70_000, "dot" + " dot" * 50_000, "one " * 50_000, "(at)" * 50_000, "a dot " * 40_000, "(" * 200_000):
        pii.find(long)


def test_pii_gate_reaches_what_the_transducers_rewrite():
    spans = ["plus 1 415 555 0100", "+1 four 1 five 5 five 5 oh 1 two 3", "+one 4 1 5 5 5 5 0 1 two 3", "1.one.2.3", "+\u017feven 415 555 0100"]
    for zero in (0x9E6, 0xE50, 0xBE6, 0x1D7CE):  # Bengali, Thai, Tamil, mathematical
        spans += ["".join(chr(zero + int(c)) if c.isdigit() else c for c in s) for s in ("+1 415 555 0100", "4111 1111 1111 1111")]
    for span in spans:
        text = f"call {span} now"
        assert [text[a:b] for _, a, b in pii.find(text)[1]] == [span], text
    assert all(pii._ODD.match(chr(c)) for c in range(0x80, 0x110000) if pii._plain_char(chr(c)) != chr(c))


def test_pii_query_and_long_inputs(spark):
    docs, rows = odd_docs(spark, random_texts(50, 12) + ["a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000])
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digest(pii.find_pii(docs)).collect())
    want = []
    for r in rows:
        t = r[1] or ""
        spans = plain_pii(t) if len(t) < 100_000 or "lorem" in t else pii.plain(t)
        n = Counter(s[0] for s in spans)
        want.append((str(r[0]), *[n[k] for k in pii.KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.digest(pii.find_pii(empty_docs(spark))).count() == 0


def plain_lines(rows, min_sites=8):
    """Texts of (id, text, site) rows without the lines that spread over so many sites, but in the first document that has them."""
    sites, first = defaultdict(set), {}
    for i, t, site in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\r")
            if k and site is not None:
                sites[k].add(site)
            if k and i is not None:
                first[k] = min(first.get(k, i), i)
    return [None if t is None else "\n".join(x for x in t.split("\n") if not ((k := x.strip(" \t\r")) and len(sites[k]) >= min_sites and i != first.get(k))) for i, t, _ in rows]


def test_line_dedup(spark):
    hot = "All rights reserved."
    rows = [(i, f"own line {i}\n {hot}\n\nnear {i % 3}", "en", f"s{i % 20}" if i % 7 else None, 0, "", "", "") for i in range(60)]
    rows += [(100, None, "en", "s1", 0, "", "", ""), (101, "", "en", "s1", 0, "", "", ""), (None, hot, "en", "s2", 0, "", "", ""), (0, rows[0][1], "en", "s0", 0, "", "", ""), (102, hot, None, None, None, "", "", ""), (103, LONG + f"\n{hot}\n" * 50, "en", "s3", 0, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    sites, first = defaultdict(set), {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            k = line.strip()
            if k and r[3] is not None:
                sites[k].add(r[3])
            if k and r[0] is not None:
                first[k] = min(first.get(k, r[0]), r[0])
    want = []
    for r in rows:
        lines = None if r[1] is None else r[1].split("\n")
        kept = lines and [x for x in lines if not (len(sites[x.strip()]) >= 8 and x.strip() and r[0] != first[x.strip()])]
        want.append((str(r[0]), None if r[1] is None else "\n".join(kept), len(lines or []) - len(kept or [])))
    got = sorted(((str(r["doc_id"]), r["text"], r["n_removed"]) for r in linededup.remove_boilerplate(docs).collect()), key=str)
    assert got == sorted(want, key=str)
    assert linededup.remove_boilerplate(empty_docs(spark)).count() == 0


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(i, f"own {i}\nshared", f"s{i}", i, "d", "r") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id long, drop string, h string")
    got = linededup.remove_boilerplate(docs).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == [(i, f"own {i}" + "\nshared" * (i == 0), f"s{i}", i, "d", "r") for i in range(9)]


def test_line_dedup_counts_lines_whose_sites_share_registers(spark):
    """Eight sites on six, five, four and three registers are eight sites; seven are not."""

    sites = spark.range(20_000).select(F.concat(F.lit("site"), "id").alias("site")).withColumn("h", F.lit(1))
    register = F.xxhash64("site", F.lit("site")).bitwiseAND((1 << linededup.PRECISION) - 1)
    full = [sorted(r["s"]) for r in sites.groupBy(register.alias("r")).agg(F.collect_list("site").alias("s")).where(F.size("s") >= 6).orderBy("r").limit(8).collect()]
    picks = {"six": [2, 2, 1, 1, 1, 1], "five": [2, 2, 2, 1, 1], "four": [2, 2, 2, 2], "three": [6, 1, 1], "seven sites": [2, 2, 1, 1, 1]}
    rows = [(line, s) for line, sizes in picks.items() for i, n in enumerate(sizes) for s in full[i][:n]]
    docs = spark.createDataFrame([(i, f"own {i}\n{line}", s) for i, (line, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_removed"] for r in linededup.remove_boilerplate(docs).collect()}
    first = {line: [r[0] for r in rows].index(line) for line in picks}
    assert got == {i: int(line != "seven sites" and i != first[line]) for i, (line, _) in enumerate(rows)}


def test_hyperloglog_estimates(spark):
    for n in (1, 5, 300, 40_000):
        occ = spark.range(n).select(F.lit(1).alias("h"), F.col("id").cast("string").alias("site"))
        (r,) = linededup.estimates(linededup.registers(occ.union(occ))).collect()
        assert abs(r["sites"] - n) <= max(0.5, 5 * 1.04 / 2 ** (linededup.PRECISION / 2) * n)


def plain_decontaminate(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a : a + 10])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if (x := tuple(w[a : a + size])) in windows:
                    hit |= set(range(a, a + size))
                    found |= windows[x]
        ids = ",".join(sorted(map(str, found)))
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("ab Cd e-f g1 é".split()) for _ in range(n))
    items = [(i, some(rng.randint(1, 30))) for i in range(20)] + [(30, None), (31, ""), (32, "!!"), (33, "a a a a a a a a a a a a"), (34, "unseen words only"), (1, "twice the id"), (35, items_text := some(14)), (36, items_text)]
    texts = [some(rng.randint(0, 60)) for _ in range(60)] + [f"x {items_text.upper()} y", "a " * 40, "unseen. words, ONLY"]
    docs, rows = odd_docs(spark, texts)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.decontaminate(docs, bench).collect())
    assert got == plain_decontaminate([(r[0], r[1]) for r in rows], items)
    assert decontam.decontaminate(empty_docs(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.decontaminate(docs, bench.limit(0)).collect())


def test_decontamination_by_shuffle_is_linear_in_words(spark, monkeypatch):
    """Places of words travel without the words of their document, and each document is shuffled once."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(40))) for i in range(20)], "key long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{j}" for j in range(12)))], "item_id long, text string")
    plan = decontam.hits(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    # what goes into the join by word: a row for each place, without the array of words
    assert len(re.findall(r"Project \[key#\d+L, size\(all#\d+, false\) AS n_words#\d+, at#\d+, word#\d+\]", plan)) == 1
    assert plan.count("split(translate(text") == 3 and "collect_list" not in plan


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_of_rows_without_an_id(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(None, f"x {item}"), (None, f"x {item}"), (None, "clean"), (1, f"{item} {item}"), (1, None), (None, None)]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    for kind in ("long", "string"):
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
        got = sorted(((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.decontaminate(docs, items).collect()))
        assert got == sorted([("None", 13, 12, 1, True)] * 2 + [("None", 1, 0, 0, False), ("1", 24, 24, 1, True), ("1", 0, 0, 0, False), ("None", 0, 0, 0, False)])


def test_language_gradients():
    net = langid.Network(["a", "b", "c"], 3)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x, lengths = langid.padded([b" abc ", b" d ", b" zz12 "])
    y = np.array([0, 2, 1])
    _, g = net.gradients(x, lengths, y)
    rng = np.random.default_rng(1)
    for k, v in net.p.items():
        places = np.argwhere(g[k] != 0)
        for at in map(tuple, places[rng.choice(len(places), min(6, len(places)), replace=False)]):
            old = v[at]
            v[at] = old + 1e-3
            up, _ = net.gradients(x, lengths, y)
            v[at] = old - 1e-3
            down, _ = net.gradients(x, lengths, y)
            v[at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3, (k, at)


def test_labeller_equals_a_plain_forward_pass(monkeypatch):
    """Lockstep reading of windows against one text, one window, one byte at a time."""
    monkeypatch.setattr(langid, "LANES", 7)
    monkeypatch.setattr(langid, "CORE", 11)
    monkeypatch.setattr(langid, "CONTEXT", 4)
    net = langid.Network(["a", "b", "c"], 5)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(d, data):
        h, s, out = langid.HIDDEN, np.zeros(langid.HIDDEN), []
        for byte in data:
            into, rec = net.p[f"t{d}"][byte], s @ net.p[f"u{d}"]
            z, r = sigmoid(into[:h] + rec[:h]), sigmoid(into[h : 2 * h] + rec[h : 2 * h])
            s = (1 - z) * np.tanh(into[2 * h :] + r * rec[2 * h :]) + z * s
            out.append(s)
        return out

    def plain(text):
        data, total = text.encode("utf-8", "replace"), np.zeros(3)
        for lo in range(0, len(data), 11):
            hi = min(lo + 11, len(data))
            a, b = max(lo - 4, 0), min(hi + 4, len(data))
            f, back = states("f", data[a:b]), states("b", data[a:b][::-1])[::-1]
            for i in range(lo - a, hi - a):
                e = np.exp(f[i] @ net.p["of"] + back[i] @ net.p["ob"] + net.p["b"])
                total += e / e.sum()
        return total / max(1, len(data))

    rng = random.Random(8)
    texts = ["", "a", "abc def", "def abc", "é" * 30] + ["".join(rng.choice("abc dé中") for _ in range(rng.randint(0, 80))) for _ in range(40)]
    got = langid.Labeller(net).pooled(texts)
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-5)
    assert np.abs(got[2] - got[3]).max() > 1e-4  # the order of the words counts
    assert langid.Labeller(net).pooled([]).shape == (0, 3)


def test_language_identification(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "th", "er", "and"], "de": ["sch", "ung", "ich", "ver", "ein"], "fr": ["eau", "que", "oi", "ment", "é"]}
    say = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    rows = [(i, say(lang := ["en", "de", "fr"][i % 3]), lang, "s", 0, "", "", "") for i in range(300)]
    rows += [(900, None, "en", "", 0, "", "", ""), (901, "", "en", "", 0, "", "", ""), (902, "12 !! 34", "de", "", 0, "", "", ""), (903, "the " * 50_000, None, "", 0, "", "", ""), (None, say("fr"), "fr", "", 0, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(docs, whole=True).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[i]["lang_pred"] == "und" for i in (900, 901, 902)) and by[903]["lang_pred"] == "en"
    tested = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(by[r[0]]["held_out"] for r in tested) and sum(by[r[0]]["lang_pred"] == r[2] for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 and r["row"]["doc_id"] == r["doc_id"] for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    clashing = docs.withColumnsRenamed({"n_tokens": "held_out", "id": "score", "h": "lang_pred"})
    assert Counter(map(str, langid.identify(clashing, whole=True).select("row.*").collect())) == Counter(map(str, clashing.collect()))
    assert {r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text")).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    texts = random_texts(60, 21)
    item = " ".join(f"w{i}" for i in range(15))
    docs, rows = odd_docs(spark, [*texts, f"aa bb {item} cc", *texts[:5]])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert 60 not in ids and not {900, 901, 903, 905} & set(ids) and not {61, 62, 63, 64, 65} & set(ids) and 904 not in ids
    assert len(ids) > 40
    step = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
        assert step.columns == docs.columns
    # rows are dropped for their own text, not for their id
    item_text, clean = f"x {item} y", "a clean text of seven words here"
    mixed = [(None, item_text), (None, clean), (1, item_text), (1, clean + " again"), (2, clean + " again"), (2, "another text"), (None, clean), (5, None), (5, None)]
    mixed = spark.createDataFrame(mixed, "doc_id long, text string")
    left = sorted(map(tuple, corpus_pipeline.decontaminate(spark, mixed, str(tmp_path)).collect()), key=str)
    assert left == sorted([(None, clean), (None, clean), (1, clean + " again"), (2, clean + " again"), (2, "another text"), (5, None), (5, None)], key=str)
    left = sorted(map(tuple, corpus_pipeline.near_dedup(spark, mixed, str(tmp_path)).collect()), key=str)
    assert left == sorted([(1, item_text), (None, clean), (1, clean + " again"), (2, "another text"), (5, None), (5, None)], key=str)
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("name, stages", [("n_removed", slice(1, 2)), ("N_Removed", slice(0, 4))])
def test_pipeline_stages_keep_clashing_columns(spark, name, stages):
    """Extra columns with the names that stages use themselves, unchanged through every stage but the last."""
    import corpus_pipeline

    extra = [name, "id", "h", "row", "lang_pred", "score", "drop", "key", "head_id", "rows"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.select("*", *[(-7 - F.col("doc_id")).cast("string").alias(c) for c in extra])
    for _, stage in corpus_pipeline.STAGES[stages]:
        with scratch(spark):
            after = stage(spark, docs, "/root/testdata/sf0.001")
            assert after.columns == docs.columns
            kept = after.select("doc_id", *extra).collect()
        assert kept and all(set(r[1:]) == {str(-7 - r["doc_id"])} for r in kept)
    with scratch(spark):
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == docs.count()


def test_pipeline_equals_plain_stages(spark):
    """Five plain stages over all documents of sf0.01; the trained network is the only thing that both share."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labeller = langid.Labeller(langid.train(langid.sample(docs, id_col="doc_id", text_col="text", lang_col="lang")))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1])) and labeller.pooled([r[1]])[0].max() >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    rows = [(r[0], t) for r, t in zip(rows, plain_lines(rows), strict=True)]
    gone = {i for i, _ in plain_groups(rows)}
    rows = [r for r in rows if r[0] not in gone]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in plain_decontaminate(rows, items) if r[-1]}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(rank_file()), special_tokens={})
    want = sorted((i, np.array(reference.encode_ordinary(t), "<u4").tobytes()) for i, t in rows if str(i) not in dirty)
    got = sorted((r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect())
    assert gone and dirty and len(want) > 700
    assert got == want


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_queries_equal_sql(spark, scale):
    import duckdb

    from veinstone.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{scale}/{t}.parquet'")
    for name, sql in ORACLES.items():
        want = con.sql(sql)
        columns = sorted(want.columns)
        got = QUERIES[name](spark, f"/root/testdata/{scale}")
        assert sorted(got.columns) == columns
        a = sorted(tuple(str(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
        assert a == sorted(tuple(str(r[c]) for c in columns) for r in got.collect()), name
