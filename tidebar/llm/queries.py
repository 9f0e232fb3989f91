"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, common, embeddings, filter_audit, fingerprints, ngram_join, packing, pii, secrets, segmentation, sharding, token_files, toxicity, warc


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(common.documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(common.documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.sampled_segmentations(common.documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(common.documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(common.documents(spark, sf_dir))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(common.documents(spark, sf_dir))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _tree_sql(key: str, shards: int) -> str:
    """SQL for the shard of a key: the least draw among regions, then among a region's racks, then among a rack's shards."""
    leaves = sharding.grown(shards)
    draw = lambda name, weight: f"-ln((CAST('0x' || substr(md5({key} || ':{name}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight}"
    pick = lambda parts: parts[0][2] if len(parts) == 1 else f"list_min([{', '.join(f'{{d: {draw(n, w)}, s: {below}}}' for n, w, below in parts)}]).s"

    def node(path: list[str]) -> str:
        inside = [x for x in leaves if [x.region, x.rack][: len(path)] == path]
        if len(path) == 2:
            return pick([("/".join([*path, str(x.shard)]), x.weight, str(x.shard)) for x in inside])
        names = list(dict.fromkeys([x.region, x.rack][len(path)] for x in inside))
        return pick([("/".join([*path, n]), sum(x.weight for x in inside if [x.region, x.rack][len(path)] == n), node([*path, n])) for n in names])

    return node([])


def _centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """SQL for integer k-means: a table of centroids per round."""
    assign = lambda r: f"SELECT v.i, v.vec_id, v.v, arg_min(c.c, (list_sum(list_transform(range(1, {dims + 1}), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))), c.c)) AS c, min(list_sum(list_transform(range(1, {dims + 1}), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j])))) AS d FROM v, c{r} c GROUP BY ALL"
    ctes = [
        f"""v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds):
        ctes += [
            f"a{r} AS ({assign(r)})",
            f"s{r} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {dims + 1})) AS j FROM a{r}) GROUP BY ALL)",
            f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{r} GROUP BY c)",
            f"c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)",
        ]
    return f"""WITH {', '.join(ctes)}, a AS ({assign(rounds)})
        SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a JOIN c{rounds} f ON f.c = a.c"""


QUERIES = {f.__name__: f for f in (op1_token_output, op2_secret_scan, op3_ngram_jaccard_join, op4_best_fit_packing, op5_toxicity, op6_sampled_segmentations, op7_warc, op8_document_fingerprints, op9_personal_data, op10_embedding_near_dedup, op11_filter_audit, op12_hash_tree_sharding, op13_centroid_clustering)}
ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        c AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.d)
        SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.r) AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.d = doc_id GROUP BY doc_id""",
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
        c AS (SELECT vec_id AS d, vec_id AS r FROM v UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.d),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(c.r) AS component_id, v.vec_id = min(c.r) AS kept FROM v LEFT JOIN n ON n.a = v.vec_id JOIN c ON c.d = v.vec_id GROUP BY v.vec_id""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, html, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to
        FROM d""",
    "op11_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
        w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
        f AS (SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * len(regexp_extract_all(x, '[A-Z]')) > 10 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM w),
        c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN labels USING (doc_id) GROUP BY part, fails),
        k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
        o AS (SELECT [p.k, q.k, r.k, s.k, u.k] AS o FROM k p, k q, k r, k s, k u WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5),
        e AS (SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, CAST(step.k AS INTEGER) AS step, 'ABCDE'[o[step.k]] AS letter,
                 n, good, toxic, fails[o[step.k]] AS here, list_bool_or(list_transform(o[1:step.k - 1], lambda i: fails[i])) IS TRUE AS before, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM c, o, k step),
        r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT before AND NOT here), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (here AND before), 0) AS redundant,
                 coalesce(sum(n) FILTER (here AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (here AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT before), 0) AS toxic_lost FROM e GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r""",
    "op12_hash_tree_sharding": f"""
        WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t),
        b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bytes FROM documents),
        s AS (SELECT doc_id, n + 1 AS size, xor(4294967295, list_reduce(bytes, lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8))) AS crc, {_tree_sql("coalesce(CAST(doc_id AS VARCHAR), 'none')", 16)} AS shard, {_tree_sql("coalesce(CAST(doc_id AS VARCHAR), 'none')", 17)} AS grown_shard FROM b, t)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM s""",
    "op13_centroid_clustering": _centroid_sql(),
}
