"""The queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_digest

    return secret_digest(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))["documents"].select("doc_id", "size", "source_size", "target", "taken")


def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_dedup import phrase_dedup

    return phrase_dedup(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(_table(spark, sf_dir, "pages"))


def op9_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfp_dedup import pfp_dedup

    return pfp_dedup(_table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_dedup

    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import code_digest

    return code_digest(_table(spark, sf_dir, "embeddings"))


def op12_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .template_text import page_texts

    return page_texts(_table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations")).drop("digest")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pivot_dedup": op2_pivot_dedup,
        "op3_secret_scan": op3_secret_scan,
        "op4_source_mixing": op4_source_mixing,
        "op5_phrase_dedup": op5_phrase_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_url_filter": op8_url_filter,
        "op9_pfp_dedup": op9_pfp_dedup,
        "op10_simhash_dedup": op10_simhash_dedup,
        "op11_vector_codes": op11_vector_codes,
        "op12_template_text": op12_template_text,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": pipeline,
    }


def _codes_sql(rounds: int = 2) -> str:
    """The rounds of op11 one after another: each part's nearest entry by a full scan, then the floors of the means."""
    assign = """a{r} AS (SELECT vec_id, p, min(ROW(d, i))[1] AS d, min(ROW(d, i))[2] AS i FROM (
                SELECT vec_id, x.p, b.i, list_sum(list_transform(list_zip(x.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{r} b ON x.p = b.p) GROUP BY vec_id, p)"""
    move = """m{r} AS (SELECT p, i, j, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT x.p, a.i, unnest(x.e) AS v, generate_subscripts(x.e, 1) AS j FROM x JOIN a{r} a ON x.vec_id = a.vec_id AND x.p = a.p) GROUP BY p, i, j),
            n{r} AS (SELECT p, i, list((s - (s % n + n) % n) // n ORDER BY j) AS e FROM m{r} GROUP BY p, i),
            b{n} AS (SELECT b.p, b.i, coalesce(n.e, b.e) AS e FROM b{r} b LEFT JOIN n{r} n ON b.p = n.p AND b.i = n.i)"""
    steps = [t.replace("{r}", str(r)).replace("{n}", str(r + 1)) for r in range(rounds) for t in (assign, move)] + [assign.replace("{r}", str(rounds))]
    return f"""
            WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
            x AS (SELECT vec_id, p, e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)] AS e FROM k, range(16) t(p)),
            s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM k ORDER BY vec_id LIMIT 64),
            b0 AS (SELECT p, i, e FROM x JOIN s USING (vec_id)),
            {", ".join(steps)},
            c AS (SELECT vec_id, string_agg(printf('%02x', i), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
            h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, i, j)) AS h FROM (SELECT p, i, unnest(e) AS v, generate_subscripts(e, 1) AS j FROM b{rounds}))
            SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_pivot_dedup": r"""
            WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
            v AS (SELECT * FROM e WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
            r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
            n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
            c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
            SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(c, vec_id), vec_id) AS component_id, coalesce(c >= vec_id, true) AS kept
            FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
        "op5_phrase_dedup": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
            win AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, unnest(list_transform(range(1, len(words) - 33), lambda i: array_to_string(words[i : i + 34], ' '))) AS s FROM w WHERE len(words) >= 35),
            again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM again),
            t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
            kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM t ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
            SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM w LEFT JOIN kept USING (doc_id)""",
        "op9_pfp_dedup": r"""
            WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            cut AS (SELECT doc_id, h, unnest(range(0, length(h) // 2, 1000)) AS base FROM d),
            part AS (SELECT doc_id, base, substr(h, (2 * base + 1)::BIGINT, 2198) AS p FROM cut),
            win AS (SELECT doc_id * 4294967296 + base + unnest(range(0, length(p) // 2 - 99)) AS place, unnest(list_transform(range(0, length(p) // 2 - 99), lambda i: md5_number(substr(p, (2 * i + 1)::BIGINT, 200)))) AS s FROM part WHERE length(p) >= 200),
            firsts AS (SELECT s, min(place) AS f FROM win GROUP BY s HAVING count(*) > 1),
            again AS (SELECT place // 4294967296 AS doc_id, place % 4294967296 AS i FROM win JOIN firsts USING (s) WHERE place <> f),
            edge AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true)::INT AS new FROM again),
            runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edge) GROUP BY doc_id, run),
            gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
            kept AS (SELECT g.doc_id, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS kept, count(*) AS n, sum(b - a) AS gone FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
            SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
            FROM d LEFT JOIN kept USING (doc_id)""",
        "op11_vector_codes": _codes_sql(),
        "op13_prefix_trie": r"""
            WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
                              {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
            own AS (SELECT conv_id, list(turn ORDER BY k) AS turns FROM t GROUP BY conv_id),
            crc AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                        lambda v, c: list_reduce(range(8), lambda w, i: xor(w >> 1, (w & 1) * 3988292384), xor(v, c)), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h FROM own),
            r AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
            p AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS d, turns FROM r),
            n AS (SELECT d, turns[1:d] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(turns)), '')) AS ends FROM p GROUP BY ALL),
            k AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
            m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n LEFT JOIN k USING (d, path)),
            u AS (SELECT path[1:e] AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT path, n_children, saved, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
            SELECT m.conv_id, m.d AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends AS ends_sha256
            FROM m JOIN u ON u.path = m.path LEFT JOIN n a ON m.d > 0 AND a.path = m.path[1:m.d - 1]""",
        "op6_exact_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   coalesce(doc_id = min(doc_id) OVER (PARTITION BY norm), min(doc_id) OVER (PARTITION BY norm) IS NULL) AS kept, sha256(norm) AS text_sha256
            FROM t""",
    }
