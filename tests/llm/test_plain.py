"""Operators on texts against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

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

from metricloom.llm.decontaminate import contamination
from metricloom.llm.fingerprints import fingerprints
from metricloom.llm.language_id import fit, identify
from metricloom.llm.lm_score import lm_scores
from metricloom.llm.mixing import mix
from metricloom.llm.near_dedup import near_duplicates
from metricloom.llm.queries import QUERIES, SQL, held_out, quality_weights
from metricloom.llm.repeats import without_repeats
from metricloom.llm.sharding import shard
from metricloom.llm.token_counts import count_tokens
from metricloom.llm.url_filters import apply_rules
from tests.oracle import connect, difference

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, size string, pair long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n, kind="abcdefgh"):
    """Words without sense, the same for a seed."""
    out = []
    for _ in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % 2 ** 64
        out.append("".join(kind[(seed >> (8 + 3 * i)) % len(kind)] for i in range(2 + (seed >> 40) % 5)))
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 300)
    near = base.split()
    near[150] = "other"
    texts = [None, "", " \n ", "x", base, base, " ".join(near), prose(2, 40) + "\n" + prose(3, 30), prose(4, 3000),
             "Über große Straßen.\n" * 30, prose(2, 40) + "\nchanged end", "a b c d e f g h i j", "%%% 123", base,
             prose(5, 80) + " " + prose(6, 100) + " " + prose(7, 60), prose(8, 90) + " " + prose(6, 100)]
    # Ids repeat and are missing; extra columns bear names that the operators use inside.
    ids = [5, 3, 3, None, 10, 11, 12, 13, 14, 15, 16, 17, 18, 10, 19, 20]
    langs = ["en", None, "en", "de"] * 4
    return [(i, t, l, f"s{k % 3}" if k % 5 else None, 0, 1, "z", 2) for k, (i, t, l) in enumerate(zip(ids, texts, langs))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def multiset(found):
    return collections.Counter(tuple(r) for r in found)


def test_language_id(docs, none, spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", held_out(4))
    model = fit(table.where("NOT held"))
    found = identify(table, model).where("held").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found) and len(found) > 20
    assert all(0 <= r["score"] <= 1 for r in found)
    marked = identify(docs, model).collect()
    assert len(marked) == 16 and all((r["lang_pred"] == "und") == (not re.search("[a-zA-Zß]", r["text"] or ""))
                                     for r in marked)
    assert identify(none, model).count() == 0
    assert {r["lang_pred"] for r in identify(docs, fit(none)).collect()} == {"und"}


def test_kernel_regression_by_hand():
    from metricloom.llm.language_id import make_kernel

    landmarks, texts = ["abca", "bcd"], ["abc", "zzz", "", "dcb" * 5]
    grams = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    every = grams(landmarks[0]) | grams(landmarks[1])
    values = make_kernel(landmarks, 3).values(texts)
    for t, row in zip(texts, values):
        for m, value in zip(landmarks, row):
            own = grams(t) & every
            wanted = len(own & grams(m)) / math.sqrt(max(len(own), 1) * len(grams(m)))
            assert abs(value - wanted) < 1e-6


def test_fingerprints(spark, docs, none, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]

    def near(a, b):
        a, b = ({p for p in t.split("\n") if p} for t in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    wanted = []
    for r, t, u in zip(order, texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + u[:half]
        wanted.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(t, edited), 9),
                       round(near(t, u), 9)))
    found = fingerprints(docs)
    assert multiset(found.select("doc_id", "n_chars", "edited_sha256", F.round("near_edited", 9),
                                 F.round("near_next", 9)).collect()) == collections.Counter(wanted)
    by_text = found.join(spark.createDataFrame(rows, DOCS).select("doc_id", "text").distinct(), "doc_id")
    assert by_text.where("doc_id IN (10, 11)").select("fingerprint").distinct().count() == 1
    assert fingerprints(none).count() == 0 and fingerprints(docs.where("doc_id = 14")).count() == 1


def test_large_differences_are_recovered(spark):
    text = lambda a, b: "\n".join(f"line {i}" for i in range(a, b))
    found = fingerprints(spark.createDataFrame([(1, text(0, 3000)), (2, text(1000, 4000)), (3, text(1005, 4000))],
                                               "doc_id long, text string")).orderBy("doc_id").collect()
    assert [round(r["near_next"], 6) for r in found] == [0.5, round(2995 / 3000, 6), round(1995 / 4000, 6)]


def test_mix(docs, none, rows):
    found = mix(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weight = dict(zip(names, (5, 2, 1, 5)))
    level, total = 0.0, sum(sizes.values())
    for _ in range(50):
        full = {s for s in names if 3 * sizes[s] < level * weight[s]}
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
    target = {s: min(3 * sizes[s], level * weight[s]) for s in names}
    assert len(found) == 16
    by_source = collections.defaultdict(int)
    for r in found:
        source = next(s for s in names if abs(target[s] - r["target"]) < 1e-6 and sizes[s] == r["source_size"])
        by_source[source] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert all(abs(by_source[s] - target[s]) <= 3000 / 2 for s in names)
    assert multiset(found) == multiset(mix(docs.repartition(5)).collect())
    assert mix(none).count() == 0
    assert mix(docs.where("text IS NULL")).first()["taken"] == 0


def test_mix_prefers_quality(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(
        F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    quality = docs.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0).alias("quality"))
    taken = mix(docs, quality, weights=(1, 9)).where("source_size = 4000 AND copies = 1").join(quality, "doc_id")
    counts = {r["quality"]: r["n"] for r in taken.where("target < 4000").groupBy("quality").agg(
        F.count("*").alias("n")).collect()}
    assert counts[4.0] > 2 * counts[1.0]


def brute_contamination(texts, items):
    windows = collections.defaultdict(set)
    for name, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(name)
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i:i + n])]
        named = sorted(str(i) for i in ids if i is not None)
        out.append((len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark, docs, none, rows):
    base = rows[4][1].split()
    items = [(1, " ".join(base[20:45])), (2, " ".join(base[30:39]) + " zz"), (3, "A b, C!"), (4, None), (5, ""),
             (3, " ".join(base[200:212]).upper()), (None, " ".join(base[100:111])), (7, "Große Straßen")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, row int")
    found = contamination(docs, bench)
    wanted = brute_contamination([r[1] for r in rows], items)
    assert multiset(found.collect()) == collections.Counter((r[0], *w) for r, w in zip(rows, wanted))
    assert sum(w[4] for w in wanted) > 5
    assert contamination(none, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("contaminated OR n_hit > 0").count() == 0


def test_url_rules(spark):
    urls = ["http://a.org/x", "HTTP://A.ORG/x", "a.org/x", None, "", "x://example.org/es/1?q", "x://example.org/en/12#f",
            "x://m.example.org/en/1", "x://b.com/fr/", "x://b.com/FR/", "x://com/de/", "x://com?x", "x://xcom/fr/",
            "x://example.org:80/es/", "://", "x://a.org", "x://a..org/", "http://a.org/x", "x://é.org/é?", "x:///fr/"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("example.org", "/en/12", "allow"), (None, "/", "block"),
             ("com", "/fr/", "block")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def judge(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
                if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    found = apply_rules(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted(tuple(r) for r in found.collect()) == [(i, *judge(u)) for i, u in enumerate(urls)]
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert apply_rules(pages.limit(0), empty).count() == 0
    assert {r["verdict"] for r in apply_rules(pages, empty, default="block").collect()} == {"block"}


def test_token_counts(docs, none, rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["  two  spaces ", "▁x ▁▁y", "tab\tand\nline", "<s> </s> <unk> <0x0A>", "日本語 ﬁ ①", " ", "a" * 5000, "\0"]
    more = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    texts = [(r[0], r[1]) for r in rows] + list(enumerate(odd))
    found = count_tokens(docs.select("doc_id", "text", "size").unionByName(more, allowMissingColumns=True), path, 300)
    wanted = collections.Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 300)
                                 for i, t in texts)
    assert multiset(found.collect()) == wanted
    assert count_tokens(none, path).count() == 0


def test_token_counts_with_nul():
    """Pre-tokens that differ only behind a NUL are different ones; whole batches of random texts, NUL among them."""
    import public_tokenizers
    import sentencepiece

    from metricloom.llm.token_counts import _count

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = [".", ".\0x", " .", " .\0x", "a\0", "a", "a\0b \0 a\0"]
    texts += ["".join(rng.choices("\0ab. \n▁é", k=rng.randrange(12))) for _ in range(30_000)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(len(part))), "text": part, "n_bytes": [0] * len(part)})
               for part in (texts[:7], texts[7:15_000], texts[15_000:])]
    found = [n for out in _count(iter(batches), path) for n in out["n_tokens"].to_pylist()]
    assert found == [len(ids) for ids in model.encode(texts)]


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_lm_scores(docs, none, rows, ranks):
    marked = docs.withColumn("held_out", held_out(7))
    found = lm_scores(marked, *ranks, steps=5).collect()
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    flow = [re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER)) + [None] for r in rows]
    counts = collections.Counter(t for f, h in zip(flow, held) if not h for t in f)
    n, v = sum(counts.values()), len(counts)
    wanted = collections.Counter(
        (r[0], h, len(f), sum(counts[t] > 0 for t in f), n,
         round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in f), 6)) for r, f, h in zip(rows, flow, held))
    assert multiset((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                     round(r["base_score"], 6)) for r in found) == wanted
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert lm_scores(none.withColumn("held_out", F.lit(True)), *ranks, steps=2).count() == 0
    only_held = lm_scores(docs.withColumn("held_out", F.lit(True)), *ranks, steps=2).collect()
    assert {(r["base_score"], r["n_known"], r["train_tokens"]) for r in only_held} == {(0.0, 0, 0)}


def test_ids_of_a_long_text_are_those_of_the_whole(ranks, monkeypatch):
    from metricloom.llm import lm_score

    encoding, _ = lm_score._tokenizer(*ranks)
    text = prose(11, 400) + " we're   far " + "straße" * 40 + " " * 150 + "12345 ...!!\n\n  end" + "x" * 230
    whole = encoding.encode_ordinary(text)
    for piece in (1, 7, 50, 101):
        monkeypatch.setattr(lm_score, "PIECE", piece)
        assert lm_score._ids(text, encoding).tolist() == whole
    monkeypatch.undo()
    blank = "a" + " " * 1_000_000 + "b"  # too long a match for the tokenizer's pattern
    assert encoding.decode(lm_score._ids(blank, encoding).tolist()) == blank


def test_ids_without_looking_ahead_are_the_same(ranks):
    from metricloom.llm import lm_score

    encoding, _ = lm_score._tokenizer(*ranks)
    assert "(?!" not in lm_score._spread(encoding)._pat_str and encoding._special_tokens
    assert lm_score._spread(lm_score._spread(encoding)) is lm_score._spread(encoding)
    random.seed(3)
    parts = ["a", "Wort", "é", "漢", "12", "'s", "..", " ", " ", "\n", "  ", "\t", "\u2003", "\x1c", "\0", "<|end|>"]
    for text in ["", " ", "\n", *("".join(random.choices(parts, k=random.randrange(12))) for _ in range(5000))]:
        assert lm_score._ids(text, encoding).tolist() == encoding.encode_ordinary(text)


def test_words_hash_by_themselves(monkeypatch):
    """Equal words have equal hashes wherever they stand, also across stretches and in words longer than one."""
    from metricloom.llm import words

    texts = ["", "ab c", prose(5, 300), " c  AB\n" + "x" * 90 + "é c", "x" * 90]
    whole = words.Words(texts, spaced=True)
    names = [w for i in range(len(texts)) for w in whole.words(whole.first[i], whole.first[i + 1])]
    assert names == [w for t in texts for w in words.Words([t], spaced=True).words(0, len(t.split()))]
    hashes = dict(zip(names, whole.hash.tolist()))
    assert len(set(hashes.values())) == len(hashes) and [hashes[w] for w in names] == whole.hash.tolist()
    words._powers.cache_clear()
    monkeypatch.setattr(words, "STRETCH", 16)
    assert (words.Words(texts, spaced=True).hash == whole.hash).all()
    words._powers.cache_clear()


def test_lm_scores_learn_from_every_row(spark, ranks):
    # A long text behind 6,100 short ones: the model must know it, wherever it lies.
    long = prose(4, 6000)
    short = spark.createDataFrame([(i, f"note {i}", False) for i in range(6100)] + [(-1, long[9000:12000], True)],
                                  "doc_id long, text string, held_out boolean")
    every = short.unionByName(spark.createDataFrame([(-2, long, False)], short.schema))
    score = [lm_scores(d, *ranks, steps=5).where("doc_id = -1").first()["score"] for d in (short, every)]
    assert len(long) > 20_000 and score[1] > 0.7 * score[0]
    again = lm_scores(every.repartition(5), *ranks, steps=5).where("doc_id = -1").first()["score"]
    assert abs(again - score[1]) < 0.01


@pytest.mark.parametrize("end", [60, 70_000])
def test_every_token_is_learned_from_once(end):
    import numpy as np
    import pyarrow as pa

    from metricloom.llm import lm_score

    random = np.random.default_rng(3)
    texts = [random.integers(0, end, n).astype(np.int32) for n in (0, 1, 6, 7, 8, 700, 5000, *range(40))]
    hashes = random.integers(0, 1 << 62, len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([t.tolist() for t in texts], pa.list_(pa.int32()))],
                                       ["hash", "ids"])
    found = collections.Counter()
    for turn in range(lm_score.ROUNDS):
        rows = next(lm_score._runs(iter([batch]), end, 8, 3, turn))
        assert set(rows["shard"].to_pylist()) <= {0, 1, 2}
        flow = lm_score._windows(rows["tokens"].to_pylist(), end, 8)
        found += collections.Counter((int(a), int(b)) for a, b in zip(flow[:, :-1].ravel(), flow[:, 1:].ravel()) if b >= 0)
    flows = [[end, *map(int, t), end] for t in texts]
    assert found == collections.Counter(pair for f in flows for pair in zip(f, f[1:]))


def test_tokens_travel_as_bytes():
    """Runs and pairs of packed ids are those of listed ones, for short and long numbers."""
    from metricloom.llm import lm_score

    random = np.random.default_rng(4)
    for end in (60, 70_000):
        texts = [random.integers(0, end, n) for n in (0, 1, 7, 600, *range(20))]
        hashes = pa.array(random.integers(0, 1 << 62, len(texts)))
        listed = pa.array([t.tolist() for t in texts], pa.list_(pa.int32()))
        packed = pa.array([t.astype(np.uint16 if end < 1 << 16 else np.int32).tobytes() for t in texts], pa.binary())
        one, two = (pa.RecordBatch.from_arrays([hashes, ids], ["hash", "ids"]) for ids in (listed, packed))
        assert next(lm_score._runs(iter([one]), end, 8, 3, 1)) == next(lm_score._runs(iter([two]), end, 8, 3, 1))
        pairs = next(lm_score._count_pairs(iter([two]), end))
        wanted = collections.Counter(
            a * (end + 1) + b for t in texts for f in [[end, *t.tolist(), end]] for a, b in zip(f, f[1:]))
        assert dict(zip(pairs["pair"].to_pylist(), pairs["n"].to_pylist())) == wanted


def test_places_of_hashes():
    from metricloom.llm import lm_score

    top = (1 << 64) - 1
    held = np.array([0, 5, 6, 7, 1 << 46, (1 << 46) + 1, 1 << 63, top - 1], dtype=np.uint64)
    for hashes in (held, held[:0], np.append(held, np.uint64(top))):
        wanted = np.array([0, 1, 5, 7, 8, 1 << 46, (1 << 46) + 2, 1 << 63, top - 1, top], dtype=np.uint64)
        at, found = lm_score._places(hashes)(wanted)
        assert found.tolist() == np.isin(wanted, hashes).tolist()
        assert (hashes[at[found]] == wanted[found]).all()


def test_slopes_are_those_of_the_loss():
    """Against differences of the loss, computed plainly in doubles."""
    from metricloom.llm import attention

    random = np.random.default_rng(2)
    kind = random.integers(0, 4, 20).astype(np.int32)
    weights = attention.starting(np.ones(20), kind, 4, 3, 6, 1)
    weights["place"] += random.normal(0, 0.2, (6, 3)).astype(np.float32)
    tokens, wanted = random.integers(0, 12, (5, 6)), random.integers(-1, 4, (5, 6))

    def loss(w):
        x = w["embed"][tokens] + w["place"]
        share = np.exp(x @ w["bilinear"] @ x.transpose(0, 2, 1)) * np.tri(6)
        both = np.concatenate([x, share / share.sum(axis=2, keepdims=True) @ x], axis=2)
        p = np.exp(both @ w["out"] + w["bias"])
        p /= p.sum(axis=2, keepdims=True)
        return -np.log(np.take_along_axis(p, np.maximum(wanted, 0)[:, :, None], 2)[:, :, 0])[wanted >= 0].mean()

    found = attention.slopes(weights, tokens, wanted)
    exact = {k: v.astype(np.float64) for k, v in weights.items()}
    for name, value in exact.items():
        for at in np.ndindex(value.shape):
            values = []
            for step in (1e-4, -1e-4):
                moved = value.copy()
                moved[at] += step
                values.append(loss({**exact, name: moved}))
            assert abs(found[name][at] - (values[0] - values[1]) / 2e-4) < 1e-4
    # Tokens that no window holds have no slope.
    assert not found["embed"][12:].any()


def test_attention_is_causal_and_normalised(ranks):
    import numpy as np

    from metricloom.llm.attention import train

    random = np.random.default_rng(1)
    model = train([random.integers(0, 50, 400) for _ in range(5)], 61, 60, classes=4, rows=20, columns=30, steps=20,
                  window=8, overlap=3)
    tokens = random.integers(0, 50, (1, 8))
    changed = tokens.copy()
    changed[0, 5:] = 7
    after = np.roll(tokens, -1)
    assert np.allclose(model.log10_next(tokens, after)[0, :5], model.log10_next(changed, after)[0, :5], atol=1e-5)
    total = sum(10.0 ** model.log10_next(tokens, np.full_like(tokens, t)) for t in range(61))
    assert np.allclose(total, 1, atol=1e-3)
    # Windows overlap, and each token counts once whatever the block.
    text = random.integers(0, 50, 57)
    flow = np.concatenate([[60], text, [60]])
    by_hand, at = 0.0, 0
    while True:
        index = at + np.arange(8)
        padded = np.concatenate([flow, np.full(20, 60)])
        value = model.log10_next(padded[index][None], padded[index + 1][None])[0]
        by_hand += sum(x for i, x in enumerate(value) if (i >= 3 or at == 0) and at + i < len(flow) - 1)
        if at + 8 >= len(flow) - 1:
            break
        at += 5
    assert abs(model.score([text], block=2)[0] - by_hand) < 1e-3
    assert abs(model.score([text[:5], text, text[:0]])[1] - by_hand) < 1e-3


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone |= set(range(i, i + length))
        kept = bytes(b for i, b in enumerate(t) if i not in gone)
        runs = sum(i - 1 not in gone for i in gone)
        out.append((len(t), len(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, none, rows):
    wanted = brute_repeats([r[1] for r in rows], 400)
    assert sum(0 < w[1] < w[0] for w in wanted) >= 3
    assert multiset(without_repeats(docs).collect()) == collections.Counter((r[0], *w) for r, w in zip(rows, wanted))
    assert without_repeats(none).count() == 0


def test_repeats_of_a_common_passage(spark, monkeypatch):
    from metricloom.llm import repeats

    monkeypatch.setattr(repeats, "KINDS", 4)  # so that keys are split down to single strings
    passage = prose(6, 140)
    texts = [prose(k, 5 + k % 20) + " " + passage[:len(passage) - 15 * (k % 3)] + " " + prose(100 + k, 30)
             for k in range(40)]
    texts.append("ab" * 700)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert multiset(without_repeats(frame).collect()) == collections.Counter(
        (i, *w) for i, w in enumerate(brute_repeats(texts, 400)))


def test_run_index():
    from metricloom.llm.run_index import build, repeated

    segments = [b"abracadabra", b"cadabrx", b"zz", b"q"]
    start, stop = repeated(build(segments), 4)
    flat = b"\0".join(segments) + b"\0"
    wanted = {i for i in range(len(flat)) if b"\0" not in flat[i:i + 4] and len(flat[i:i + 4]) == 4 and any(
        flat[j:j + 4] == flat[i:i + 4] for j in range(len(flat)) if j != i)}
    assert {i for a, b in zip(start, stop) for i in range(a, b)} == wanted


def agreed(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("entry", [3, 1024])
def test_matching_statistics_by_brute_force(monkeypatch, entry):
    from metricloom.llm import run_index

    monkeypatch.setattr(run_index, "ENTRY", entry)
    random = np.random.default_rng(entry)
    for _ in range(60):
        segments = [bytes(random.choice([0, 97, 98], random.integers(0, 30)).tolist())
                    for _ in range(random.integers(1, 6))]
        segments += segments[:random.integers(0, 2)]  # a segment twice
        longest, other = run_index.statistics(run_index.build(segments))
        tails = [s[i:] for s in segments for i in range(len(s) + 1)]
        for i, own in enumerate(tails):
            assert longest[i] == max((agreed(own, t) for j, t in enumerate(tails) if j != i), default=0)
            assert not longest[i] or (other[i] != i and agreed(own, tails[other[i]]) == longest[i])


def test_runs_of_a_repetitive_corpus_are_few():
    from metricloom.llm.run_index import build, repeated

    random = np.random.default_rng(3)
    base = random.integers(97, 123, 2000, dtype=np.uint8)
    segments = []
    for k in range(60):
        version = base.copy()
        version[[300 + k, 1000 + 5 * k]] = 46  # strings of 400 bytes across these places are rare or of one version
        segments.append(version.tobytes())
    index = build(segments)
    assert index.size == 60 * 2001 and index.runs < index.size / 20
    seen = collections.Counter(s[i:i + 400] for s in segments for i in range(1601))
    start, stop = repeated(index, 400)
    assert {i for a, b in zip(start, stop) for i in range(a, b)} == {
        2001 * k + i for k, s in enumerate(segments) for i in range(1601) if seen[s[i:i + 400]] > 1}


def test_shards(docs, none, rows):
    found = shard(docs, shards=4).collect()
    wanted = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert multiset((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == wanted
    for k in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sum(r["shard"] == k for r in found)))
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}
    assert shard(none).count() == 0 and shard(docs.limit(1)).count() == 1


def test_shards_are_even_with_a_hot_text(spark):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 40).otherwise(
        F.concat(F.lit("t"), F.col("id"), F.repeat(F.lit("x"), (F.col("id") % 200).cast("int")))).alias("text"),
        F.lit("a").alias("source"), F.lit(None).cast("string").alias("lang"))
    sums = [r["b"] for r in shard(frame).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 24 and max(sums) < 1.06 * sum(sums) / 24 and min(sums) > 0.94 * sum(sums) / 24


def brute_classes(rows, least=0.8):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] == frozenset([()]):
                same = rows[i][1] == rows[j][1]
            else:
                same = len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])
            if same:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def check_classes(rows, found):
    tops = brute_classes(rows)
    ids = {}
    for k, (r, t) in enumerate(zip(rows, tops)):
        ids.setdefault(t, []).append(r[0])
    least = {t: min((i for i in own if i is not None), default=None) for t, own in ids.items()}
    assert multiset((r["doc_id"], r["class_id"]) for r in found) == collections.Counter(
        (r[0], least[t]) for r, t in zip(rows, tops))
    assert sum(r["kept"] for r in found) == len(ids)


def test_near_duplicates(docs, none, rows):
    check_classes(rows, near_duplicates(docs).collect())
    assert near_duplicates(none).count() == 0


def test_near_duplicates_in_a_dense_group(spark):
    base = prose(9, 150).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        w = list(base)
        for e in range(k % 7):
            w[(k * 37 + e * 23) % 150] = f"edit{k}x{e}"
        rows.append((k, " ".join(w)))
    # A pair that is like each other, but not like the base.
    far = [f"new{i}" if i % 12 == 0 else w for i, w in enumerate(base)]
    rows += [(100, " ".join(far)), (101, " ".join(far[:-1] + ["last"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_classes(rows, near_duplicates(frame).collect())


def test_near_duplicates_that_repeat_a_passage(spark):
    # Pairs of a clean copy and one with a passage of it 200 times; none may be missed.
    rows = []
    for k in range(40):
        base = prose(100 + k, 110).split()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + base[40:70] * 200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tops = brute_classes(rows)
    assert all(tops[i] == tops[i + 1] for i in range(0, 80, 2)) and len(set(tops)) == 40
    check_classes(rows, near_duplicates(frame).collect())


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    from metricloom.llm.near_dedup import REGISTERS, registers

    a, b = np.arange(1, 401, dtype=np.uint64) * 977, np.arange(101, 501, dtype=np.uint64) * 977
    weight = np.where(np.arange(400) % 5 == 0, 3.0, 1.0)
    owner = registers(np.repeat([0, 1], 400), np.concatenate([a, b]), np.concatenate([weight, np.ones(400)]), 2)
    x, y = dict(zip(a.tolist(), weight)), dict(zip(b.tolist(), np.ones(400)))
    wanted = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
                 for d in x.keys() & y.keys())
    assert abs((owner[0] == owner[1]).mean() - wanted) < 4 * math.sqrt(wanted * (1 - wanted) / REGISTERS)
    assert (owner != 0).all()


def test_bands_by_counts_and_by_equal_weights():
    from metricloom.llm.near_dedup import BANDS, band_hashes

    # 0: each shingle once. 1: the same set, some very often. 2: the very counts of 1. 3: nothing.
    value = np.arange(1, 61, dtype=np.uint64) * 977
    count = np.where(np.arange(60) < 5, 300, 1)
    bands, brought = band_hashes(np.repeat([0, 1, 2], 60), np.tile(value, 3),
                                 np.concatenate([np.ones(60, dtype=np.int64), count, count]), 4)
    assert (bands[1] == bands[2]).all() and (bands[0, :BANDS] == bands[0, BANDS:]).all()
    assert brought[0].sum() == BANDS and not brought[3].any() and (brought[1] == brought[2]).all()
    # By counts, 1 is far from 0 (5 shingles hold nearly all its weight); by equal weights they are one.
    assert (bands[0, :BANDS] != bands[1, :BANDS]).all() and (bands[0, BANDS:] == bands[1, BANDS:]).all()
    assert brought[1].sum() == 2 * BANDS


def test_pipeline(spark, docs, none, rows, sf):
    import corpus_pipeline

    benchmark = f"{sf}"
    narrow = docs.select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language ID"](spark, narrow, benchmark)
    assert multiset(spoken.collect()) == collections.Counter(
        r[:5] for r in rows if re.search("[a-zA-Zß]", r[1] or ""))
    one = stages["near-dedup"](spark, narrow, benchmark)
    assert one.count() == len(set(brute_classes(rows))) and one.columns == narrow.columns
    assert multiset(stages["decontamination"](spark, narrow, benchmark).collect()) == collections.Counter(
        r[:5] for r in rows)  # none holds a passage of the benchmark
    taken = {(r["doc_id"], r["size"]): r["copies"] for r in mix(narrow.where("doc_id >= 11")).collect()}
    mixed = stages["mixing"](spark, narrow.where("doc_id >= 11"), benchmark)
    assert collections.Counter((r["doc_id"], len(r["text"].split())) for r in mixed.collect()) == collections.Counter(
        {k: n for k, n in taken.items() if n})
    for stage in stages.values():
        assert stage(spark, none, benchmark).count() == 0


def test_language_stage_judges_by_the_model(spark, monkeypatch):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["language ID"]
    rows = [(i, prose(i, 40, "abcdefgh" if i % 2 else "qrstuvwx"), "one" if i % 2 else "two") for i in range(40)]
    rows += [(50, prose(50, 40), None), (51, "ЖЩЪЫЮЯЖЩ" * 9, None), (52, "12 %", "one"),
             (53, "ЖЩЪЫ ЮЯЖЩ " * 9 + "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # 51 shares no n-gram with a language; 53 few, which shows where the labelled documents count for much.
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == {*range(40), 50, 53}
    monkeypatch.setattr(corpus_pipeline, "HALFWAY", 1)
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == {*range(40), 50}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in stage(spark, bare, "").collect()} == {*range(40), 50, 51, 53}


def test_mixing_stage_draws_by_document(spark, sf):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["mixing"]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    one, other = ([r["doc_id"] for r in stage(spark, d, sf).select("doc_id").collect()]
                  for d in (table, table.repartition(5)))
    assert collections.Counter(one) == collections.Counter(other)
    copies = mix(table, quality_weights(spark, sf)).where("copies > 0").collect()
    assert collections.Counter(one) == collections.Counter({r["doc_id"]: r["copies"] for r in copies})


def test_pipeline_on_a_table(spark, sf):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert 0.8 * len(table) < len(found) < 3 * len(table)
    assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in table}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf):
    assert difference(QUERIES[name](spark, sf), connect(sf), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(name, spark, sf):
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
