"""The registered queries of this subpackage: each operator over its whole table, and its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroid_clusters import CLUSTERS, ROUNDS, centroid_clusters
from .decontamination import contaminated
from .exact_dedup import exact_dedup
from .fingerprints import edited_fingerprints
from .mixing import curriculum_mix
from .ngram_join import ngram_components
from .pii import KINDS as PII_KINDS
from .pii import personal_data
from .quality import quality
from .resampling import resampled
from .secrets import KINDS as SECRET_KINDS
from .secrets import secrets
from .token_counts import token_counts
from .toxicity import NgramModel, fit, scored
from .url_filter import RULES, UNITS, url_verdicts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("n_chunks")


OP1_SQL = """
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = quality(docs, read(spark, sf_dir, "labels").filter(fold(4) != 2), "quality")
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def spans_text(column: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.col("n")[k].alias(f"n_{kind}") for k, kind in enumerate(PII_KINDS)], "base_sha256", spans_text("spans").alias("spans"))


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum_mix(read(spark, sf_dir, "documents")).drop("positions")  # the SQL's columns


OP4_SQL = """
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS ord
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
    FROM d GROUP BY source
), ranked AS (
    SELECT *, [0.5::DOUBLE, 2.0, 4.5][(rank - 1) % 3 + 1] AS w0, [1.5::DOUBLE, 2.0, 1.5][(rank - 1) % 3 + 1] AS w1,
           [1.0::DOUBLE, 2.0, 3.0][(rank - 1) % 3 + 1] AS w, 3 * source_size AS cap
    FROM totals
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
              / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
    FROM ranked
    WINDOW before AS (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), one AS (
    SELECT arg_min(level, cap::DOUBLE / w * 1e6 + rank) AS free_level FROM levels WHERE cap > w * level
), targets AS (
    SELECT source, source_size, w0, w1, w, coalesce(least(cap::DOUBLE, w * free_level), 0.0) AS target
    FROM levels LEFT JOIN one ON true
), placed AS (
    SELECT doc_id, size, source_size, target, w0, w1, w, floor(target)::BIGINT AS wanted,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
), copies AS (
    SELECT *, least(greatest(wanted - before, 0), size) AS c0, least(greatest(wanted - source_size - before, 0), size) AS c1,
           least(greatest(wanted - 2 * source_size - before, 0), size) AS c2
    FROM placed
), due AS (
    SELECT *, w * ((before + c0 / 2.0::DOUBLE) / target) AS due FROM copies
)
SELECT doc_id, size, source_size, target, (c0 + c1 + c2)::BIGINT AS taken,
       (c0 > 0)::INTEGER + (c1 > 0)::INTEGER + (c2 > 0)::INTEGER AS copies,
       CASE WHEN c0 + c1 + c2 > 0 THEN CASE WHEN due > 0 THEN 2 * due / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * due)) ELSE 0 END END AS position
FROM due
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.col("n")[k].alias(f"n_{kind}") for k, kind in enumerate(SECRET_KINDS)], "base_sha256", spans_text("spans").alias("spans"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents")).drop("text_key")


OP8_SQL = """
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS place, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), sets AS (
    SELECT place, doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' ')))
                               WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
    FROM texts
), each AS MATERIALIZED (
    SELECT place, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS MATERIALIZED (
    SELECT x.place AS a, y.place AS b FROM each x JOIN each y ON x.shingle = y.shingle AND x.place <> y.place
    GROUP BY x.place, y.place, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
    SELECT place AS v, place AS w FROM sets UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.w
), least AS (
    SELECT r.v, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.place = r.w GROUP BY r.v
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON v = place
"""


def link_sql(steps: int = 12) -> str:
    """Rules, host edges, and both masses step by step, as whole numbers."""
    folded = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind) for kind, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    space = "[\\x09-\\x0D\\x20]"
    link = f"(?i)(?:href|src){space}*={space}*[\"'']?{space}*(?:https?:)?//([^/?#\"''\\x09-\\x0D\\x20<>]+)"
    parts = [
        f"cut AS MATERIALIZED (SELECT page_id, html, {folded("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"judged AS MATERIALIZED (SELECT *, {case(1)} AS rule, {case(2)} AS ruled FROM cut)",
        f"linked AS (SELECT host AS a, {folded('dest')} AS b FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dest FROM cut))",
        "labels AS (SELECT string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM cut))",
        "up AS (SELECT DISTINCT array_to_string(l[k:], '.') AS low, array_to_string(l[k + 1:], '.') AS high FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM labels WHERE len(l) > 2))",
        "edges AS MATERIALIZED (SELECT a, b, count(*) AS links FROM (SELECT * FROM linked UNION ALL SELECT low, high FROM up UNION ALL SELECT high, low FROM up) WHERE a <> '' AND b <> '' AND a <> b GROUP BY ALL)",
        f"seeds AS MATERIALIZED (SELECT host, ruled, floor({float(UNITS)}::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY ruled))::BIGINT AS seed FROM judged WHERE ruled IS NOT NULL AND host <> '' GROUP BY host, ruled)",
    ]
    for name, kind, a, b in (("trust", "allow", "a", "b"), ("distrust", "block", "b", "a")):
        parts.append(f"{name}_edges AS MATERIALIZED (SELECT {a} AS a, {b} AS b, links, sum(links) OVER (PARTITION BY {a}) AS all_links FROM edges)")
        parts.append(f"{name}_0 AS (SELECT host, seed AS mass FROM seeds WHERE ruled = '{kind}')")
        for k in range(steps):
            sent = f"SELECT b AS host, floor(mass::DOUBLE * 85 * links / (100 * all_links)::DOUBLE)::BIGINT AS mass FROM {name}_edges JOIN {name}_{k} ON a = host"
            parts.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT host, sum(mass)::BIGINT AS mass FROM ({sent} UNION ALL SELECT host, seed * 15 // 100 FROM seeds WHERE ruled = '{kind}') GROUP BY host)")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict,
           coalesce(t.mass, 0) AS trust, coalesce(d.mass, 0) AS distrust
    FROM judged j LEFT JOIN trust_{steps} t ON t.host = j.host LEFT JOIN distrust_{steps} d ON d.host = j.host
    """


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"))


def fold(modulus: int):
    """The remainder that splits rows into folds: CRC-32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def toxicity_model(spark: SparkSession, sf_dir: str) -> NgramModel:
    """Fitted to labels outside the held-out fold."""
    return fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter(fold(3) != 1), "toxic")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, toxicity_model(spark, sf_dir))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: CRC-32 by its rule: 256 steps of the reflected polynomial, then a word's bytes one by one.
OP11_SQL = """
WITH crc_table AS (
    SELECT list(list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) ORDER BY i) AS steps
    FROM range(256) r(i)
), texts AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS place, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    UNION ALL
    SELECT 'b', NULL, row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), split AS (
    SELECT side, doc_id, place, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts
), features AS (
    SELECT side, place, word, count(*) AS n FROM (SELECT side, place, unnest(words) AS word FROM split) GROUP BY ALL
), hashed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(word)), lambda k: ('0x' || substr(hex(encode(word)), (2 * k + 1)::INTEGER, 2))::BIGINT)),
                                 lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM features), crc_table
), sums AS (
    SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM features JOIN hashed USING (word) GROUP BY bucket
), sizes AS (
    SELECT count(*) FILTER (side = 'd') AS all_s, count(*) FILTER (side = 'b') AS all_t FROM (SELECT side, unnest(words) FROM split)
), gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM sums, sizes
), weights AS (
    SELECT place, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS features
    FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY place
), scored AS (
    SELECT doc_id, coalesce(features, 0) AS n_features,
           CASE WHEN features > 0 THEN (total - ((total % features) + features) % features) // features ELSE 0 END AS weight,
           ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM split LEFT JOIN weights USING (place) WHERE side = 'd'
), noisy AS (
    SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS turn,
           count(*) FILTER (n_features >= 20) OVER () AS n
    FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND turn <= 10 * n // 100 THEN turn END AS rank FROM placed
"""


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(read(spark, sf_dir, "embeddings"))


def clustering_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """Every round as two CTEs: the nearest centroid of each vector over all centroids, and the centroids after it."""
    away = "list_sum(list_transform(range(1, 65), lambda j: (v[j] - p[j]) * (v[j] - p[j])))::BIGINT"
    parts = [
        "scaled AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "vectors AS (SELECT row_number() OVER () AS place, vec_id, v::BIGINT[] AS v FROM scaled)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS number, v AS p FROM vectors ORDER BY number LIMIT {clusters})",
    ]
    for turn in range(rounds + 1):
        parts.append(f"a{turn} AS (SELECT place, vec_id, v, min(struct_pack(away := {away}, number := number)) AS near FROM vectors, c{turn} GROUP BY place, vec_id, v)")
        if turn < rounds:
            parts.append(f"m{turn} AS (SELECT number, list((total - ((total % n) + n) % n) // n ORDER BY j)::BIGINT[] AS p FROM (SELECT near.number AS number, j, sum(v[j])::BIGINT AS total, count(*) AS n FROM a{turn}, range(1, 65) r(j) GROUP BY ALL) GROUP BY number)")
            parts.append(f"c{turn + 1} AS (SELECT c.number, coalesce(m.p, c.p) AS p FROM c{turn} c LEFT JOIN m{turn} m ON c.number = m.number)")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT vec_id, near.number::INTEGER AS cluster, near.away AS distance, sum(near.away) OVER (PARTITION BY near.number)::BIGINT AS cluster_inertia,
           sum(near.away) OVER ()::BIGINT AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} c ON near.number = c.number
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_personal_data": op3_personal_data,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op4_curriculum_mix": OP4_SQL,
    "op8_ngram_jaccard_join": OP8_SQL,
    "op9_url_filter": link_sql(),
    "op11_importance_resampling": OP11_SQL,
    "op13_centroid_clusters": clustering_sql(),
}
