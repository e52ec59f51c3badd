"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthoflow.llm import periods, pii, quality, secret_scan, suffixes, toxicity
from orthoflow.llm.collocations import collocations
from orthoflow.llm.decontamination import contamination
from orthoflow.llm.exact_dedup import exact_duplicates
from orthoflow.llm.langid import held_out, identify
from orthoflow.llm.packing import pack
from orthoflow.llm.sharding import digest, shuffled
from orthoflow.llm.simhash import near_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256,
       row_number() OVER (PARTITION BY text_sha256, doc_id) AS copy
FROM rows
"""

def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS k, coalesce(CAST(item_id AS VARCHAR), '') AS item, w FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, list_slice(w, s, least(s + 9, len(w))) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b)
), places AS (
  SELECT doc_id, s, l, list_slice(w, s, s + l - 1) AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s
        FROM d, (SELECT DISTINCT len(win) AS l FROM windows) WHERE len(w) >= l)
), hits AS (
  SELECT doc_id, s, l, item FROM places JOIN windows USING (win)
), words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
), terms AS (
  SELECT doc_id, w, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d
), freq AS (
  SELECT term, count(*) AS f FROM terms GROUP BY term
), item_terms AS (
  SELECT k, len(w) AS n, p, f FROM (SELECT k, w, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM b) JOIN freq USING (term)
), anchored AS (  -- of each window the rarest term that a document has, the first of equally rare ones
  SELECT DISTINCT k, min(f * 1000000000 + p) % 1000000000 AS p
  FROM (SELECT k, p, f, unnest(range(greatest(p - 9, 1), least(p, greatest(n - 9, 1)) + 1)) AS s FROM item_terms) GROUP BY k, s
), around AS (
  SELECT DISTINCT item, list_extract(w, CAST(p AS BIGINT)) AS term, list_slice(w, greatest(p - 9, 1), p - 1) || list_slice(w, p + 1, p + 9) AS own FROM anchored JOIN b USING (k)
), near AS (
  SELECT DISTINCT doc_id, item FROM terms JOIN around USING (term)
  WHERE len(list_intersect(list_distinct(own), list_distinct(list_slice(w, greatest(p - 9, 1), p - 1) || list_slice(w, p + 1, p + 9)))) >= 7
), near_only AS (
  SELECT doc_id, count(*) AS n_near FROM (SELECT * FROM near EXCEPT SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_only USING (doc_id)
"""


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in 24 shuffled shards."""
    return digest(shuffled(table(spark, sf_dir, "documents"), shards=24))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from languages that are not held out."""
    return identify(table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    """Path of the public word-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.report(pii.personal_data(table(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


#: Learns as fit() does: ordinary tokens are those that share no character with a base span.
OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT k, 'assign' AS kind, 0 AS rank, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS m,
         regexp_split_to_array(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS p FROM d
  UNION ALL
  SELECT k, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT k, 'hex', 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_split_to_array(t, '[0-9a-f]+') FROM d
), matched AS (
  SELECT k, kind, rank, m, p, unnest(range(1, len(m) + 1)) AS i FROM split
), valued AS (
  SELECT k, kind, rank, m, p, i, m[i] AS v,
         CASE WHEN kind = 'assign' THEN regexp_extract(m[i], '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE m[i] END AS secret FROM matched
), base AS (
  SELECT k, kind, rank, secret, start, start + length(v) AS stop FROM (
    SELECT *, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM valued WHERE (kind = 'assign' AND length(secret) >= 6) OR (kind = 'access' AND length(v) >= 20) OR (kind = 'hex' AND length(v) >= 24))
), tokens AS (
  SELECT k, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{8,}') AS m, regexp_split_to_array(t, '[A-Za-z0-9+/_=-]{8,}') AS p FROM d
), each AS (
  SELECT k, w, sum(length(gap) + length(w)) OVER (PARTITION BY k ORDER BY i) AS stop
  FROM (SELECT k, unnest(m) AS w, unnest(p[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM tokens)
), ordinary AS (
  SELECT w FROM each WHERE NOT EXISTS (FROM base WHERE base.k = each.k AND base.start < each.stop AND each.stop - length(w) < base.stop)
), pairs AS (
  SELECT x, substr(w, i, 2) AS pair, count(*) AS n FROM (
    SELECT x, w, unnest(range(1, length(w))) AS i FROM (SELECT 1 AS x, secret AS w FROM base UNION ALL SELECT 0, w FROM ordinary)) GROUP BY ALL
), clean AS (
  SELECT * FROM pairs WHERE regexp_full_match(pair, '[A-Za-z0-9+/_=-]{2}')
), totals AS (
  SELECT x, substr(pair, 1, 1) AS a, sum(n) AS n FROM clean GROUP BY ALL
), different AS (
  SELECT DISTINCT w FROM each WHERE NOT regexp_full_match(w, '[0-9+/_=-]*')
), steps AS (
  SELECT w, substr(w, i, 2) AS pair, substr(w, i, 1) AS a FROM (SELECT w, unnest(range(1, length(w))) AS i FROM different)
), letters AS (
  SELECT x, substr(pair, 2, 1) AS b, sum(n) AS n FROM clean GROUP BY ALL
), sizes AS (
  SELECT coalesce(sum(n) FILTER (x = 1), 0) + 66 AS rn, coalesce(sum(n) FILTER (x = 0), 0) + 66 AS o_n FROM clean
), chances AS (
  SELECT w, (coalesce(r, 0) + 10 * (coalesce(rb, 0) + 1) / rn) / (coalesce(ra, 0) + 10) AS random,
         (coalesce(o, 0) + 10 * (coalesce(ob, 0) + 1) / o_n) / (coalesce(oa, 0) + 10) AS ordinary
  FROM (SELECT steps.*, substr(pair, 2, 1) AS b, rn, o_n FROM steps, sizes)
    LEFT JOIN (SELECT pair, n AS r FROM clean WHERE x = 1) USING (pair) LEFT JOIN (SELECT pair, n AS o FROM clean WHERE x = 0) USING (pair)
    LEFT JOIN (SELECT a, n AS ra FROM totals WHERE x = 1) USING (a) LEFT JOIN (SELECT a, n AS oa FROM totals WHERE x = 0) USING (a)
    LEFT JOIN (SELECT b, n AS rb FROM letters WHERE x = 1) USING (b) LEFT JOIN (SELECT b, n AS ob FROM letters WHERE x = 0) USING (b)
), suspects AS (
  SELECT w FROM chances GROUP BY w HAVING sum(ln(random) - ln(ordinary)) >= ln(1000000)
), judged AS (
  SELECT k, m, p FROM tokens WHERE list_has_any(m, (SELECT list(w) FROM suspects))
), random AS (
  SELECT k, 'random' AS kind, 3 AS rank, '' AS secret, start, start + length(v) AS stop FROM (
    SELECT k, m[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM judged) WHERE m[i] IN (FROM suspects))
), found AS (
  SELECT * FROM base UNION ALL SELECT * FROM random WHERE NOT EXISTS (FROM base WHERE base.k = random.k AND base.start < random.stop AND random.start < base.stop)
), reported AS (
  SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'random') AS based,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM found GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN reported USING (k)
"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), meta=["n_chars"])
    scored = quality.quality(docs, machine, meta=["n_chars"])
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document."""
    return periods.report(periods.periodic_runs(table(spark, sf_dir, "documents"), planted=True))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its strings of 400 bytes that start anywhere else as well."""
    return suffixes.report(suffixes.kept_texts(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
  SELECT k, s, md5_number(b[s:s + 399]) AS h FROM (SELECT k, b, unnest(range(1, octet_length(b) - 398)) AS s FROM d WHERE octet_length(b) >= 400)
), again AS (
  SELECT k, s FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)
), steps AS (
  SELECT k, s, s - coalesce(lag(s) OVER (PARTITION BY k ORDER BY s), -1000000) > 400 AS new FROM again
), numbered AS (
  SELECT k, s, sum(CAST(new AS INT)) OVER (PARTITION BY k ORDER BY s) AS run FROM steps
), spans AS (
  SELECT k, run, min(s) AS a, max(s) + 399 AS z FROM numbered GROUP BY k, run
), kept AS (
  SELECT k, a - 1 AS z, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) + 1 AS a FROM (FROM (SELECT k, a, z FROM spans) UNION ALL SELECT k, octet_length(b) + 1, octet_length(b) + 1 FROM d)
), texts AS (
  SELECT k, unhex(string_agg(hex(b[a:z]), '' ORDER BY a)) AS own FROM kept JOIN d USING (k) WHERE z >= a GROUP BY k
), sums AS (
  SELECT k, sum(z - a + 1) AS removed, count(*) AS n FROM spans GROUP BY k
)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(coalesce(own, ''::BLOB)) AS kept_sha256
FROM d LEFT JOIN sums USING (k) LEFT JOIN texts USING (k)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), phrases AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[:c], ' ') AS part, array_to_string(w[c + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
), scores AS (
  SELECT cuts.lang, cuts.phrase, a, c, p.f AS l, q.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (p.f + q.f) AS BIGINT) AS score
  FROM cuts JOIN phrases p ON p.lang = cuts.lang AND p.phrase = part JOIN phrases q ON q.lang = cuts.lang AND q.phrase = rest
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (
    FROM candidates y WHERE y.lang = x.lang AND y.k > len(string_split(x.phrase, ' ')) AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= 80 * x.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op9_secret_scan": OP9_SQL,
    "op12_suffix_dedup": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
