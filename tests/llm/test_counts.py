"""Resampling, secret scan and collocations against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metricloom.llm import collocations as phrases
from metricloom.llm import resample as sampling
from metricloom.llm import secrets as scan
from metricloom.llm.queries import QUERIES, SQL
from tests.llm.test_plain import DOCS, LOWER, multiset, prose, words
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 300)
    texts = [None, "", " \n ", "x", base, base, prose(2, 40) + "\n" + prose(3, 30), prose(4, 3000),
             "Über große Straßen.\n" * 30, "a b c d e f g h i j", "%%% 123", base, prose(6, 25) + " ÿ \x00 K ſ",
             "\t a,b;c:d!e?f\x0bg\x0ch\r\n a  b\t\tc " * 9]
    ids = [5, 3, 3, None, 10, 11, 12, 13, 14, 16, 17, 10, 18, 19]
    langs = ["en", None, "und", "de"] * 4
    return [(i, t, l, "s", 0, 1, "z", 2) for i, t, l in zip(ids, texts, langs)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op11_target_resampling", "op12_secret_scan", "op13_collocations"])
def test_query_equals_sql(name, spark, sf):
    assert difference(QUERIES[name](spark, sf), connect(sf), SQL[name]) is None


def grams(text, longest):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(rows, target, longest, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for r in rows for f in grams(r[1], longest))
    t = collections.Counter(bucket(f) for x in target for f in grams(x, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(
        (t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for r in rows:
        own = grams(r[1], longest)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append([r[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None,
                    len(words(r[1]))])
    chosen = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for place, x in enumerate(chosen[:percent * len(chosen) // 100], 1):
        x[4] = place
    return collections.Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, docs, none, rows, longest):
    target = [base := prose(4, 200), None, "", base, "straßen über %"]
    items = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    found = sampling.resample(docs, items, longest, 50, 8, 60)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert multiset(found.collect()) == resampled(rows, target, longest, 50, 8, 60)
    assert multiset(sampling.resample(docs, items.limit(0), longest, 50).collect()) == resampled(
        rows, [], longest, 50, 20, 10)
    assert sampling.resample(none, items, longest, 50).count() == 0


def test_features_do_not_depend_on_where_texts_are_cut(monkeypatch):
    texts = ["", prose(1, 50), "one", "", prose(2, 9) + "…", "a b"]
    for size in (3, 17, 100, 10_000):
        monkeypatch.setattr(sampling, "PORTION", size)
        memory = sampling._Buckets(97)
        owner, bucket, n_words = sampling.features([t.encode() for t in texts], 3, memory)
        assert n_words.tolist() == [len(words(t)) for t in texts]
        for i, t in enumerate(texts):
            assert sorted(bucket[owner == i]) == sorted(zlib.crc32(g.encode()) % 97 for g in grams(t, 3))


def brute_secrets(text, window=scan.WINDOW):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(scan.ASSIGN, text, re.ASCII) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    for m in re.finditer("[A-Za-z0-9+/_=-]{%d,}" % window, text):
        s = m.group()
        if any(re.search(p, s) for p in scan.ALLOWED) or all(
                re.search(scan.PLAIN_PART, x) for x in re.split(scan.SIGNS, s)):
            continue
        open_ = None
        for i in range(len(s) - window + 1):
            w = s[i:i + window]
            bits = -sum(c / window * math.log2(c / window) for c in collections.Counter(w).values())
            letters, digits = re.search("[A-Za-z]", w), re.search("[0-9]", w)
            kind = "letters" if not digits else "hex" if not re.search("[^0-9A-Fa-f]", w) else "mixed"
            if letters and bits >= scan.LEAST_BITS[kind] - 1e-9:
                if open_ and i <= open_[1]:
                    open_[1] = i + window
                else:
                    if open_:
                        spans.append((m.start() + open_[0], 3, m.start() + open_[1]))
                    open_ = [i, i + window]
        if open_:
            spans.append((m.start() + open_[0], 3, m.start() + open_[1]))
    spans.sort()
    say = lambda some: ",".join(f"{scan.KINDS[k]}:{a}:{b}" for a, k, b in some)
    base = say([s for s in spans if s[1] < 3])
    return (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), say(spans))


def test_secrets(spark, docs, none, rows):
    rng = random.Random(5)
    key = lambda n, kind="ABCDEFGHIJabcdefghijklmnopqrst0123456789+/": "".join(rng.choices(kind, k=n))
    texts = [None, "", "token=abc token=abcdefgh", "token=token:abcdefgh", "PassWord: 'hunter22' é\U0001F600 apiKey=\"q1w2e3r4t5\"",
             "AKIA" + key(16, "ABCDEFGHIJ0123456789"), "AKIAAKIA12345678901", "xAKIA" + key(30, "AKI9"), key(24, "0123456789abcdef"),
             key(23, "0123456789abcdef"), "\x01\x02" + key(40) + "\x01", "id " + key(60) + " " + "ab" * 30 + key(30),
             "https://example.org/" + key(40), "internationalization_of-many/words=here", "1" * 60, "0123456789abcdef" * 3,
             "123e4567-e89b-12d3-a456-426614174000", key(40, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             key(30) + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1" + key(30), "ſecret=abcdefghi", "toKen=abcdefgh",
             "\n".join("secret = " + key(30) for _ in range(300)), key(9000), prose(3, 20_000)]
    more = [(i, t, None, None, 0, 0, "", 0) for i, t in enumerate(texts)] + rows
    table = spark.createDataFrame(more, DOCS).repartition(4)
    wanted = collections.Counter((r[0], *brute_secrets(r[1])) for r in more)
    assert multiset(scan.scan_secrets(table).collect()) == wanted
    assert sum(x[5].count("entropy") for x in wanted) > 300
    assert scan.scan_secrets(none).count() == 0


def test_long_candidates_are_judged_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(scan, "PIECE", 7)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh" if k % 2 else "ABCDEFabcdefghij0123456789", k=20 + 9 * k)) for k in range(30)]
    texts += ["".join(rng.choices("aabb", k=40)) + texts[20] + "c" * 50 + texts[22]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = scan.scan_secrets(table).collect()
    assert multiset(found) == collections.Counter((i, *brute_secrets(t)) for i, t in enumerate(texts))


def brute_phrases(rows, longest, least, share, top):
    f, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split("[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(lang == other and len(q) > len(p) and share * a <= 100 * b and any(
                q[i:i + len(p)] == p for i in range(len(q))) for (other, q), b in candidates.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return collections.Counter(
        (lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, found in out.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("longest, least, share, top, shards", [
    (5, 3, 100, 2000, 3), (5, 3, 10_000, 2000, 4), (3, 2, 150, 50, 1), (2, 9, 100, 2000, 2)])
def test_collocations(docs, none, rows, longest, least, share, top, shards):
    found = phrases.collocations(docs, longest, least, share, top, shards)
    wanted = brute_phrases(rows, longest, least, share, top)
    assert multiset(found.collect()) == wanted and len(wanted) >= 3
    assert phrases.collocations(none, longest, least, shards=shards).count() == 0


def test_counts_do_not_depend_on_where_texts_are_cut(monkeypatch, rows):
    batch = pa.RecordBatch.from_pylist([{"lang": r[2] or "und", "text": r[1]} for r in rows],
                                       pa.schema([("lang", pa.string()), ("text", pa.string())]))
    every = np.ones(1 << 12, dtype=np.uint8)  # all phrases have reached the threshold at the first scan
    wanted = collections.Counter()
    for (lang, phrase, n) in ((r[2] or "und", w[i:i + k], k) for r in rows
                              for piece in re.split("[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER))
                              for w in [re.findall("[^\x20\x09]+", piece)] for k in range(1, 6)
                              for i in range(len(w) - k + 1)):
        wanted[f"{lang}\t{' '.join(phrase)}"] += n > 1
    for size in (1, 40, 1000, 1 << 20):
        monkeypatch.setattr(phrases, "PORTION", size)
        found = collections.Counter()
        for out in phrases._scan(iter([batch]), 3, 2, 5, every):
            for row in out.to_pylist():
                found[row["key"]] += row["n"]
                assert row["start"] == 2
        assert found == +wanted


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.range(1).select(F.expr(
        "(CAST(1000 AS DECIMAL(4, 0)) * CAST(9007199254740993 AS DECIMAL(16, 0)) * CAST(9999999999999989 AS DECIMAL(16, 0)))"
        " div (CAST(9007199254740997 AS DECIMAL(19, 0)) * CAST(13 AS DECIMAL(18, 0)))").alias("x")).first()
    assert row["x"] == 1000 * 9007199254740993 * 9999999999999989 // (9007199254740997 * 13)


def test_phrase_keys_from_bytes(monkeypatch):
    """Keys are cut from the bytes of a portion, some at a time, whatever gaps and languages hold."""
    monkeypatch.setattr(phrases, "KEYS", 3)
    langs, texts = ["é", "", "und", "é"], [" Ä \t\t b   c\t\td. \t e ", "b", None, "b  c"]
    batch = pa.RecordBatch.from_pydict({"lang": langs, "text": texts})
    reached = np.ones(1 << 12, dtype=np.uint8)
    found = collections.Counter()
    for out in phrases._scan(iter([batch]), 2, 2, 3, reached):
        assert out.num_rows <= 3
        found.update(dict(zip(out["key"].to_pylist(), out["n"].to_pylist())))
    wanted = collections.Counter()
    for lang, text in zip(langs, texts):
        for piece in re.split(r"[.]", (text or "").lower().replace("ä", "Ä")):
            some = piece.split()
            wanted[lang + "\t"] += len(some)
            for n in (1, 2, 3):
                wanted.update(lang + "\t" + " ".join(some[i:i + n]) for i in range(len(some) - n + 1))
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in wanted.items() if v}
