"""Queries of this subpackage: each applies an operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.llm import collocations, decontaminate, importance, language_model, licenses, mixing, neardup, quality, search, secret_scan, substrings, token_counts, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str, folder: str = token_counts.FOLDER, vocabulary: str = token_counts.VOCABULARY) -> DataFrame:
    ranks = token_counts.default_ranks(folder, vocabulary)
    return token_counts.section_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks).drop("text")


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.searched(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.trained(documents, _table(spark, sf_dir, "labels"))
    return quality.scored(documents, model).select("doc_id", (quality.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model.scored(documents, quality.remainder(F.col("doc_id"), 5) != 1)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), urls.trained(urls.labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components_of(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_search": op2_search,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_model": op6_language_model,
    "op7_url_filter": op7_url_filter,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_secret_scan": op11_secret_scan,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _secrets_of_rule(number: int, rule: secret_scan.Rule) -> str:
    """SQL of (doc_id, k, kind, s, e): every text is searched with the rule."""
    p = rule.pattern.replace("'", "''")
    long_enough = f"length(regexp_extract(x, '{p}', {rule.group})) >= {rule.least}"
    return f"""
SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, ends[i] - length(x) AS s, ends[i] AS e
FROM (SELECT doc_id, m, i, m[i] AS x, list_transform(range(1, len(m) + 1), lambda n: list_sum(cut[1:n]) + list_sum(found[1:n])) AS ends
      FROM (SELECT doc_id, m, [length(x) FOR x IN m] AS found, [length(x) FOR x IN string_split_regex(t, '{p}')] AS cut, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m FROM d WHERE regexp_matches(t, '{p}'))))
WHERE {long_enough}"""


ORACLES = {
    "op11_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_secrets_of_rule(i, rule) for i, rule in enumerate(secret_scan.RULES))}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)""",
    "op12_importance_resampling": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS g FROM d),
steps AS (SELECT range AS i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, range) AS t FROM range(256)),
tab AS (SELECT list(t ORDER BY i) AS t FROM steps),
bytes AS (SELECT g, [CAST('0x' || hex(g)[2 * i - 1 : 2 * i] AS BIGINT) FOR i IN range(1, strlen(g) + 1)] AS bs FROM (SELECT g FROM f UNION SELECT g FROM b)),
bucket AS (SELECT g, xor(list_reduce(bs, lambda c, x: xor(c >> 8, tab.t[CAST(xor(c & 255, x) AS INTEGER) + 1]), 4294967295), 4294967295) % 10000 AS b FROM bytes, tab),
s AS (SELECT b, count(*) AS s FROM f JOIN bucket USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM b AS x JOIN bucket USING (g) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM b) AS t),
gain AS (SELECT bs.b, CAST(floor(1000 * ln(CAST(coalesce(t.t, 0) + 1 AS DOUBLE) * CAST(total.s + 10000 AS DOUBLE) / (CAST(coalesce(s.s, 0) + 1 AS DOUBLE) * CAST(total.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
         FROM (SELECT DISTINCT b FROM bucket) bs LEFT JOIN s USING (b) LEFT JOIN t USING (b), total),
w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM f JOIN bucket USING (g) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features,
                  coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
                  CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise
           FROM d LEFT JOIN w USING (doc_id)),
may AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN may USING (doc_id)""",
    "op13_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^.,;:!?\x0A-\x0D]+')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) AS t(k))),
f AS (SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w, unnest(range(1, k)) AS cut_at FROM f WHERE k > 1 AND f >= 10),
parts AS (SELECT lang, k, g, a, cut_at, array_to_string(w[1 : cut_at], ' ') AS g1, array_to_string(w[cut_at + 1 : k], ' ') AS g2 FROM c),
cut AS (SELECT parts.*, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
        FROM parts JOIN f x ON x.lang = parts.lang AND x.g = parts.g1 JOIN f y ON y.lang = parts.lang AND y.g = parts.g2),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut_at) = 1),
longer AS (SELECT lang, string_split(g, ' ') AS w, f FROM f WHERE k = 3 AND f >= 10),
inner_of AS (SELECT lang, g, max(f) AS most FROM (SELECT lang, array_to_string(w[i : i + 1], ' ') AS g, f FROM (SELECT lang, w, f, unnest([1, 2]) AS i FROM longer)) GROUP BY ALL),
left_over AS (SELECT best.*, g AS phrase FROM best LEFT JOIN inner_of USING (lang, g) WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
flagged AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM flagged),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t, count(gone.p) AS n
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(5, len(w)) - 1) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_source_mixing": """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM n),
cdf AS (SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS f FROM r, range(0, 200) AS t(k)),
u AS (SELECT doc_id, source, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':11'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
c AS (SELECT u.doc_id, count(*) FILTER (cdf.f < u.u) AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY u.doc_id)
SELECT d.*, CAST(unnest(range(0, copies)) AS INTEGER) AS copy FROM documents d JOIN c USING (doc_id)""",
}
