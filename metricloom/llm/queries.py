"""The registered queries of this subpackage, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.collocations import collocations
from metricloom.llm.common import read
from metricloom.llm.decontaminate import contamination
from metricloom.llm.fingerprints import fingerprints
from metricloom.llm.language_id import fit, identify
from metricloom.llm.lm_score import lm_scores
from metricloom.llm.mixing import mix
from metricloom.llm.near_dedup import near_duplicates
from metricloom.llm.repeats import without_repeats
from metricloom.llm.resample import resample
from metricloom.llm.secrets import LEAST_BITS, WINDOW, scan_secrets
from metricloom.llm.sharding import shard
from metricloom.llm.token_counts import count_tokens
from metricloom.llm.url_filters import apply_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Rules of the url filter: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def held_out(parts: int) -> Column:
    """Whether a document is held out: the CRC-32 of its id as text leaves 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 2, F.lit(False))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled good documents are drawn twice as readily as unlabelled ones, labelled bad ones half as readily."""
    return read(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("quality"))


@query("op3_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))


@query("op5_url_filter", sql=r"""
    WITH parts AS (
        SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS pos FROM pages),
    cut AS (
        SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM parts),
    split AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    rules(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
        ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    hits AS (
        SELECT page_id, host, path, h || p AS rule, verdict,
               row_number() OVER (PARTITION BY page_id, host, path
                                  ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS place
        FROM split JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
    SELECT split.page_id, split.host, split.path, rule, coalesce(verdict, 'allow') AS verdict
    FROM split LEFT JOIN (SELECT * FROM hits WHERE place = 1) AS best
      ON split.page_id = best.page_id AND split.host = best.host AND split.path = best.path""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return apply_rules(read(spark, sf_dir, "pages"), rules)


@query("op9_shard")
def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


@query("op1_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(4).alias("held_out"))
    model = fit(docs.where("NOT held_out"))
    return identify(docs.drop("lang"), model).drop("text")


@query("op6_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_decontamination", sql=r"""
    WITH words AS (
        SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item_words AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    item_starts AS (
        SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i
        FROM item_words WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM item_starts),
    sizes AS (SELECT DISTINCT n FROM windows),
    starts AS (
        SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n),
    hits AS (
        SELECT row, i, starts.n, item_id FROM starts
        JOIN windows ON windows.n = starts.n AND s = array_to_string(w[i:i + starts.n - 1], ' ')),
    hit_words AS (SELECT DISTINCT row, unnest(generate_series(i, i + n - 1)) AS p FROM hits),
    n_hits AS (SELECT row, count(*) AS n_hit FROM hit_words GROUP BY row),
    n_items AS (
        SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY row)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN n_hits USING (row) LEFT JOIN n_items USING (row)""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op10_near_duplicates")
def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op2_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


@query("op8_remove_repeats")
def remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"))


@query("op7_lm_score")
def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out(7))
    return lm_scores(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: CRC-32 of a word in DuckDB: each byte is followed by eight shifts (-1), over the distinct words only.
_CRC = """
    word_list AS (SELECT word FROM doc_words UNION SELECT word FROM item_words),
    hashed AS (
        SELECT word, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
            generate_series(1, octet_length(encode(word))),
            lambda i: [CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
            4294967295) % 10000 AS bucket FROM word_list)"""


@query("op11_target_resampling", sql=rf"""
    WITH docs AS (
        SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    doc_words AS (SELECT row, unnest(w) AS word FROM docs),
    item_words AS (
        SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
    {_CRC.strip()},
    s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN hashed USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM item_words JOIN hashed USING (word) GROUP BY bucket),
    sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE
            / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
        FROM s LEFT JOIN t USING (bucket), sums),
    weights AS (
        SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
        FROM doc_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row),
    scored AS (
        SELECT doc_id, row, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8)
                   AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
        FROM docs LEFT JOIN weights USING (row)),
    placed AS (
        SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
        FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
    FROM scored LEFT JOIN placed USING (row)""")
def target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: The assignment pattern for a regex library that folds letters beyond ASCII.
_ASSIGN = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_ASSIGN = rf"""({_ASSIGN})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Largest sums of c * log2(c) for the least entropy of each class.
_MOST = {k: math.floor((math.log2(WINDOW) - v) * WINDOW * 1_000_000) for k, v in LEAST_BITS.items()}


@query("op12_secret_scan", sql=rf"""
    WITH texts AS (
        SELECT row_number() OVER () AS row, doc_id,
               translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
    patterns(kind, name, pattern) AS (VALUES (0, 'assign', '{_ASSIGN}'), (1, 'access', 'AKIA[A-Z0-9]{{16,}}'),
        (2, 'hex', '[0-9a-f]{{24,}}'), (3, 'entropy', '[A-Za-z0-9+/_=-]{{{WINDOW},}}')),
    cut AS (
        SELECT row, kind, string_split_regex(regexp_replace(t, pattern, chr(1) || '\0' || chr(2), 'g'),
                                             '[\x01\x02]') AS parts FROM texts, patterns),
    pieces AS (SELECT row, kind, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM cut WHERE len(parts) > 1),
    placed AS (
        SELECT row, kind, p, i, coalesce(sum(length(p)) OVER (
            PARTITION BY row, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pieces),
    matches AS (
        SELECT row, kind, p, start FROM placed
        WHERE i % 2 = 0 AND (kind <> 0 OR length(regexp_extract(p, '{_ASSIGN}', 2)) >= 6)),
    candidates AS (
        SELECT row, p, start FROM matches WHERE kind = 3
          AND NOT regexp_matches(p, '(?i)abcdefghij|0123456789|1234567890|qwertyuiop|example|placeholder|lorem')
          AND NOT starts_with(p, '//')
          AND NOT regexp_full_match(p, '[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}')
          AND NOT list_bool_and(list_transform(string_split_regex(p, '[+/_=-]+'),
                  lambda x: regexp_full_match(x, '[A-Z]?[a-z]*|[A-Z]+|[0-9]+')))),
    starts AS (SELECT row, p, start, unnest(generate_series(0, length(p) - {WINDOW})) AS o FROM candidates),
    windows AS (SELECT row, start, o, substr(p, o + 1, {WINDOW}) AS w FROM starts),
    characters AS (SELECT row, start, o, w, unnest(string_split(w, '')) AS c FROM windows),
    counts AS (SELECT row, start, o, w, c, count(*) AS n FROM characters GROUP BY ALL),
    sums AS (
        SELECT row, start, o, w, sum(CAST(round(n * log2(n) * 1000000) AS BIGINT)) AS s FROM counts GROUP BY ALL),
    passed AS (
        SELECT row, start, o, coalesce(o > lag(o) OVER (PARTITION BY row, start ORDER BY o) + {WINDOW}, true) AS fresh
        FROM sums WHERE s <= CASE WHEN NOT regexp_matches(w, '[A-Za-z]') THEN -1
            WHEN NOT regexp_matches(w, '[0-9]') THEN {_MOST["letters"]}
            WHEN NOT regexp_matches(w, '[^0-9A-Fa-f]') THEN {_MOST["hex"]} ELSE {_MOST["mixed"]} END),
    runs AS (
        SELECT row, start, o, sum(CAST(fresh AS INT)) OVER (PARTITION BY row, start ORDER BY o) AS run FROM passed),
    spans AS (
        SELECT row, kind, start AS s, start + length(p) AS e FROM matches WHERE kind < 3
        UNION ALL SELECT row, 3, start + min(o), start + max(o) + {WINDOW} FROM runs GROUP BY row, start, run),
    per_row AS (
        SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
               count(*) FILTER (kind = 2) AS n_hex,
               string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
               string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
        FROM spans JOIN patterns USING (kind) GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts LEFT JOIN per_row USING (row)""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


@query("op13_collocations", sql=r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    starts AS (
        SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
        FROM words, (SELECT unnest(generate_series(1, 5)) AS m) WHERE len(w) >= m),
    f AS (
        SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL),
    totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE m >= 2 AND a >= 100),
    cuts AS (SELECT lang, m, phrase, w, a, unnest(generate_series(1, m - 1)) AS k FROM candidates),
    scored AS (
        SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n,
               CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
        FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
        JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
        JOIN totals ON totals.lang = c.lang),
    best AS (
        SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
    longer AS (
        SELECT lang, w, a, j, unnest(generate_series(1, m - j + 1)) AS i
        FROM candidates, (SELECT unnest(generate_series(2, 4)) AS j) WHERE j < m),
    inside AS (
        SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS most FROM longer GROUP BY ALL),
    kept AS (
        SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase
        WHERE place = 1 AND (most IS NULL OR 100 * most < 100 * a)),
    ordered AS (
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score FROM kept)
    SELECT * FROM ordered WHERE rank <= 2000""")
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
