"""The queries opN_* with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from .common import few, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark, sf_dir):
    from .token_store import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op2_toxicity(spark, sf_dir):
    from .toxicity import fit, predict

    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_decontamination(spark, sf_dir):
    from .decontamination import find_contaminated

    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minhash(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_embeddings(spark, sf_dir):
    from .nndescent import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_language(spark, sf_dir):
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_substring(spark, sf_dir):
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_secrets(spark, sf_dir):
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark, sf_dir):
    from .byte_bpe import round_trip

    docs = table(spark, sf_dir, "documents")
    return few(round_trip(docs, tokenizer("byte_bpe_50k.tiktoken")), splits=docs.rdd.getNumPartitions())


def op13_centroids(spark, sf_dir):
    from .centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


def _few(query):
    return lambda spark, sf_dir: few(query(spark, sf_dir))


QUERIES = {f.__name__: _few(f) for f in (op1_token_store, op2_toxicity, op3_token_counts, op4_decontamination, op5_minhash, op6_embeddings, op7_language, op8_substring, op9_packing, op10_secrets)}
QUERIES |= {f.__name__: f for f in (op11_filter_audit, op12_byte_bpe, op13_centroids)}

#: Words as the contracts have them: runs of other than 0x20 and 0x09 to 0x0D.
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _centroids_sql(rounds: int = 3) -> str:
    """v: kept vectors; c0, c1, ...: centroids of each round; a0, a1, ...: assignments."""
    steps = [
        "k AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
        "v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM k WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "h AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c FROM v WHERE vec_id IS NOT NULL)",
        "c0 AS (SELECT c, v FROM h WHERE c < 16)",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT r, c, CAST(list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))) AS BIGINT) AS d FROM v, c{i} c)")
        steps.append(f"a{i} AS (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM d{i} GROUP BY r)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT m.c AS c, j, CAST(sum(v.v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) g(j) GROUP BY ALL)")
            steps.append(f"n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS (SELECT c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN n{i} n USING (c))")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(m.c AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = m.c"""


ORACLE_SQL: dict[str, str] = {
    "op5_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, r.c FROM r JOIN both_ways ON a = r.id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM s JOIN r ON r.id = doc_id GROUP BY doc_id, s""",
    "op6_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT b, r.c FROM r JOIN l ON a = r.id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(max(n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM v JOIN r ON r.id = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id""",
    "op8_substring": f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format(t='text')}, []) AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS first_doc FROM k GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (h) WHERE doc_id > first_doc),
each AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_filter_audit": f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format(t='t')} AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)}} AS f FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT part, o AS filter_order, CAST(i AS INT) AS step, good, toxic, f[substr(o, i, 1)] AS fails, len(list_filter(map_values(f), lambda v: v)) AS failing, coalesce(list_position(list_transform(string_split(o, ''), lambda k: f[k]), true), 6) AS first_failing FROM f, o, range(1, 6) r(i)),
g AS (SELECT part, filter_order, step, count_if(first_failing > step) AS kept, count_if(first_failing = step) AS removed, count_if(fails AND first_failing < step) AS redundant, count_if(fails AND failing = 1) AS unique_fails, count_if(first_failing = step AND good = 1) AS good_lost, count_if(first_failing = step AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM g""",
    "op13_centroids": _centroids_sql(),
}
