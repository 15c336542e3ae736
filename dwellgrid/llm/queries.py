"""The registered queries of this subpackage: thin digests of its operators over whole tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm import (
    alignment, bpe, exact_dedup, hard_negatives, language, mixing, near_dedup, quality, secret_scan, sharding,
    substring_dedup, topk, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(kind: str, place: int, pattern: str, flags: str, least: str) -> str:
    """Oracle part: spans of one kind from the pieces between its matches."""
    return f"""
      SELECT doc_id, '{kind}' AS kind, {place} AS place, hit, start, start + length(hit) AS stop FROM (
        SELECT doc_id, hits[i] AS hit,
          (list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0))::BIGINT AS start
        FROM (
          SELECT doc_id, gaps, hits, unnest(generate_series(1, len(hits))) AS i FROM (
            SELECT doc_id, regexp_split_to_array(text, '{flags}{pattern}') AS gaps,
              regexp_extract_all(text, '{flags}{pattern}') AS hits
            FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '{flags}{pattern}')
          )
        )
      ) WHERE {least}
    """


ASSIGN_HEAD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?"


@query(
    "op1_secret_scan",
    f"""
    WITH spans AS (
      {_spans("assign", 0, ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", "",
              f"length(hit) - length(regexp_extract(hit, '^{ASSIGN_HEAD}')) >= 6")}
      UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "", "length(hit) >= 20")}
      UNION ALL {_spans("hex", 2, "[0-9a-f]+", "", "length(hit) >= 24")}
    ), found AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
      FROM spans GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN found USING (doc_id)
    """,
)
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@query(
    "op2_topk",
    r"""
    WITH v AS (
      SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.e, p.e)::BIGINT AS score
      FROM v q JOIN v p ON q.vec_id % 50 = 0 AND q.vec_id <> p.vec_id
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5
    """,
)
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk.QUERY_STEP == 0)


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(bpe.encode_documents(table(spark, sf_dir, "documents")))


@query(
    "op4_url_filter",
    r"""
    WITH rest AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages
    ), parts AS (
      SELECT page_id,
        coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM rest
    ), rules(verdict, h, p) AS (
      VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
    ), fits AS (
      SELECT page_id, host, path, h || p AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS place
      FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    )
    SELECT parts.page_id, parts.host, parts.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM parts LEFT JOIN fits f ON f.page_id = parts.page_id AND f.place = 1
    """,
)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query(
    "op5_near_dedup",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingles AS (
      SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    common AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id > b.doc_id
      GROUP BY 1, 2
    ), links AS (
      SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
    ), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (
      SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
    ), ids AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY 1)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
      d.doc_id <= coalesce(low, d.doc_id) AS kept
    FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
    """,
)
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.pack_documents(table(spark, sf_dir, "documents"))


@query(
    "op8_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
        length(coalesce(text, '')) AS n FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
      row_number() OVER w = 1 AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


@query(
    "op9_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '')) AS draw FROM documents
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
      FROM d GROUP BY source
    ), dry AS (SELECT *, 3 * source_size / weight AS empty_at FROM s),
    closing AS (
      SELECT *, ((sum(source_size) OVER ())::BIGINT
          - coalesce(sum(3 * source_size) OVER (ORDER BY empty_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
        / (sum(weight) OVER ()
          - coalesce(sum(weight) OVER (ORDER BY empty_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS c
      FROM dry
    ), t AS (
      SELECT source, source_size, least(weight * max(c) OVER (), (3 * source_size)::DOUBLE) AS target FROM closing
    ), placed AS (
      SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM d
    )
    SELECT doc_id, size, source_size, target,
      (greatest(0, least(size, q - b)) + greatest(0, least(size, q - source_size - b))
        + greatest(0, least(size, q - 2 * source_size - b)))::BIGINT AS taken
    FROM placed JOIN (SELECT *, round(target)::BIGINT AS q FROM t) t ON placed.source IS NOT DISTINCT FROM t.source
    """,
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_queue(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_languages(docs, language.fit_languages(docs))


@query(
    "op11_hard_negatives",
    r"""
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
      SELECT a.vec_id AS anchor_id, p.vec_id, a.label = p.label AS same, list_dot_product(a.e, p.e)::BIGINT AS score
      FROM v a JOIN v p ON a.vec_id % 100 = 0 AND a.vec_id <> p.vec_id
    ), positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id,
      (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
      vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [bpe.vocabulary_path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligned = alignment.align_documents(table(spark, sf_dir, "documents"), *files, digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


@query(
    "op13_substring_dedup",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
      SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
      FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
    ), again AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
    gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS j FROM s JOIN again USING (h)),
    kept AS (
      SELECT r, count(*) FILTER (g.j IS NOT NULL) AS n_removed,
        string_agg(word, ' ' ORDER BY e.j) FILTER (g.j IS NULL) AS text
      FROM (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d) e
      LEFT JOIN gone g USING (r, j) GROUP BY r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)
    """,
)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
