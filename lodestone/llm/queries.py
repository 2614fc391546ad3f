"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import chat, collocations, decontam, html, langid, licences, merkle, neardup, pii, quality, sentencepiece, substrings, topk

#: Public tokenizer files; a parameter of the operators.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_maxplus_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), sentencepiece.read_model(TOKENIZER))


def op3_difference_cover_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op4_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every(table(spark, sf_dir, "embeddings"))


def op5_bagminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bootstrap_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_tool_call_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lineblock_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.build(table(spark, sf_dir, "documents"), claim=merkle.tampered()).audit()


def op12_fuzzy_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op13_packed_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_neighbour_quality,
        op2_maxplus_sentencepiece,
        op3_difference_cover_substrings,
        op4_norm_bucketed_topk,
        op5_bagminhash_neardup,
        op6_bootstrap_pii,
        op7_hyperdimensional_langid,
        op8_tool_call_chats,
        op9_prefix_decontamination,
        op10_lineblock_html,
        op11_merkle_manifest,
        op12_fuzzy_licences,
        op13_packed_collocations,
    )
}

_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op3_difference_cover_substrings": r"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    windows AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
    repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM windows) WHERE c > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM repeated),
    words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
    n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
    """,
    "op4_norm_bucketed_topk": """
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
        FROM v q JOIN v c ON q.r <> c.r AND len(q.w) = len(c.w) WHERE q.vec_id % 20 = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
    """,
    "op9_prefix_decontamination": f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SQL_WORDS} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item, w[i:i + 9] AS seq FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT len(seq) AS n FROM windows),
    places AS (SELECT r, i, n, w[i:i + n - 1] AS seq FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
    hits AS MATERIALIZED (SELECT r, i, n, item FROM places JOIN windows USING (seq)),
    covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
    named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
    """,
    "op11_merkle_manifest": """
    WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM documents),
    fields AS (SELECT r, doc_id, source, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS f, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower FROM d),
    hashed AS (SELECT r, doc_id, source, list_transform([text, lower], lambda t: sha256(list_aggregate(list_transform(list_append(f, t), lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), 'string_agg', ''))) AS h,
        list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: CASE WHEN c = '' THEN []::BIGINT[] ELSE list_concat([ord(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]) END))),
            lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END) AS crc FROM fields),
    leaves AS MATERIALIZED (SELECT r, doc_id, source, h[1] AS leaf, CASE WHEN xor(crc, 4294967295::BIGINT) % 5 = 0 THEN h[2] ELSE h[1] END AS claim, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h[1], r) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed),
    trees AS (SELECT tree, n, 0 AS level, i, leaf AS h FROM leaves UNION ALL
        SELECT tree, ceil(n / 16)::BIGINT, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM trees WHERE n > 1 GROUP BY tree, n, level, i // 16),
    low AS MATERIALIZED (SELECT * FROM trees),
    subroots AS MATERIALIZED (SELECT tree, h FROM low WHERE n = 1),
    tops AS (SELECT (SELECT count(*) FROM subroots) AS n, 0 AS level, tree AS i, h FROM subroots UNION ALL
        SELECT ceil(n / 16)::BIGINT, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY n, level, i // 16),
    high AS MATERIALIZED (SELECT * FROM tops),
    nodes AS MATERIALIZED (SELECT tree, level, i // 16 AS run, i, h FROM low WHERE n > 1 UNION ALL SELECT -1, level, i // 16, i, h FROM high WHERE n > 1),
    steps AS (SELECT x.tree, x.level, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS a, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS b
        FROM nodes x JOIN nodes y ON x.tree = y.tree AND x.level = y.level AND x.run = y.run GROUP BY x.tree, x.level, x.i),
    own AS (SELECT l.r, s.level, s.a, s.b FROM leaves l JOIN steps s ON s.tree = l.tree AND s.i = l.i // (16 ** s.level)::BIGINT),
    up AS (SELECT l.r, 1000 + s.level AS level, s.a, s.b FROM leaves l JOIN steps s ON s.tree = -1 AND s.i = l.tree // (16 ** s.level)::BIGINT),
    paths AS (SELECT r, string_agg(a || b, '' ORDER BY level) AS proof, list({'a': a, 'b': b} ORDER BY level) AS p FROM (SELECT * FROM own UNION ALL SELECT * FROM up) GROUP BY r),
    folds AS (SELECT r, claim AS h, 1 AS k FROM leaves UNION ALL SELECT f.r, sha256(p[k].a || h || p[k].b), k + 1 FROM folds f JOIN paths USING (r) WHERE k <= len(p)),
    folded AS (SELECT r, arg_max(h, k) AS folded_root FROM folds GROUP BY r)
    SELECT doc_id, leaf, subroots.h AS subroot, high.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = high.h AS verified
    FROM leaves JOIN subroots USING (tree) JOIN high ON high.n = 1 JOIN folded USING (r) LEFT JOIN paths USING (r)
    """,
    "op13_packed_collocations": r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
    lists AS MATERIALIZED (SELECT p, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
    grams AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, range(1, 5) t(k) WHERE len(w) >= k)),
    f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 30),
    c AS MATERIALIZED (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
    cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
    scores AS (SELECT cuts.lang, cuts.g, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM cuts
        JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:k] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[k + 1:len(cuts.g)]),
    best AS (SELECT lang, g, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM scores) WHERE o = 1),
    inside AS (SELECT lang, g[i:i + m - 1] AS g, a FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i FROM c, range(2, 4) t(m) WHERE len(g) > m)),
    longer AS (SELECT lang, g, max(a) AS b FROM inside GROUP BY lang, g),
    ranked AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN longer USING (lang, g) WHERE b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
