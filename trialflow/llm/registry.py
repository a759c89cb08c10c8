"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trialflow.llm import decontaminate, embeddings, mixing, phrases, resample, sharding, simhash, spelling, substrings, topk, toxicity, urlfilter, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return topk.search(topk.build_index(docs), docs.filter("doc_id % 100 = 0"), min_df=1)


def op1_sql() -> str:
    """BM25 of every document that shares a term with a query, without an index."""
    k1, b = topk.K1, topk.B
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{mixing.WORD}')) AS word FROM documents),
        p AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
        s AS (SELECT d.doc_id, coalesce(x.size, 0) AS size FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS size FROM w GROUP BY ALL) x USING (doc_id)),
        g AS (SELECT count(*) AS n, avg(size) AS average FROM s),
        f AS (SELECT word, count(*) AS df FROM p GROUP BY word),
        i AS (SELECT word, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM f, g),
        q AS (SELECT p.doc_id AS query_id, word, idf FROM p JOIN i USING (word) WHERE p.doc_id % 100 = 0),
        r AS (SELECT query_id, p.doc_id, round(sum(idf * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * size / average))), {topk.DIGITS}) AS score
            FROM q JOIN p USING (word) JOIN s ON p.doc_id = s.doc_id, g GROUP BY ALL)
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank
        FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"""


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the dated list entries that were active when it was fetched."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.temporal_list_join(urlfilter.captures_of(pages), urlfilter.entries_of(pages))
    return judged.withColumnRenamed("capture_id", "page_id")


def op2_sql() -> str:
    """The same, each capture compared with every interval of its patterns."""
    host = rf"regexp_replace(lower(regexp_extract(url, '{urlfilter._HOST}', 1)), '\.+$', '')"
    return rf"""WITH p AS (SELECT page_id, url, nullif({host}, '') AS host, string_split({host}, '.') AS labels,
            list_filter(string_split(regexp_extract(url, '{urlfilter._PATH}', 1), '/'), lambda s: s <> '') AS steps FROM pages),
        c AS (SELECT DISTINCT page_id, url, host,
            TIMESTAMP '2024-01-01' + to_minutes(((page_id * 7919) % (366 * 1440))::INT) AS fetched_at,
            CASE WHEN host IS NULL THEN NULL ELSE
                list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.'))
                || list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/')) END AS patterns FROM p),
        e AS (
            SELECT DISTINCT 'hosts' AS list, host AS pattern, 'block' AS action, DATE '2024-01-01' + to_months((page_id * 3 % 12)::INT) AS day FROM c WHERE page_id % 5 = 0
            UNION SELECT 'hosts', host, 'remove', DATE '2024-01-01' + to_months((page_id * 5 % 12)::INT) FROM c WHERE page_id % 7 = 0
            UNION SELECT 'paths', patterns[-1], 'allow', DATE '2024-01-01' + to_months((page_id * 7 % 12)::INT) FROM c WHERE page_id % 11 = 0),
        o AS (SELECT list, pattern, day, max(action) AS action FROM e WHERE pattern IS NOT NULL GROUP BY ALL),
        v AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM o),
        a AS (SELECT c.page_id, c.url, c.fetched_at, v.list, v.pattern, v.action FROM (SELECT *, unnest(patterns) AS pattern FROM c) c
            JOIN v ON v.pattern = c.pattern AND v.action <> 'remove' AND v.day <= c.fetched_at AND (v.until IS NULL OR c.fetched_at < v.until)),
        r AS (SELECT *, count(*) OVER w AS n_active, row_number() OVER (PARTITION BY page_id, url, fetched_at
            ORDER BY -length(pattern), action <> 'allow', list, pattern, action) AS k FROM a WINDOW w AS (PARTITION BY page_id, url, fetched_at))
        SELECT c.page_id, c.url, c.fetched_at, coalesce(r.action, 'none') AS verdict, r.pattern, r.list, coalesce(r.n_active, 0) AS n_active
        FROM c LEFT JOIN r ON c.page_id = r.page_id AND c.url = r.url AND c.fetched_at = r.fetched_at AND r.k = 1"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and near-duplicate component."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their toxicity score; one fold of the labels is never learned from."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a monolithic archive, its normalised form and back."""
    return warc.read_archives(warc.archive_pages(read(spark, sf_dir, "pages")), payloads=False).drop("payload", "url")


def op5_sql() -> str:
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY ALL)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
            CASE WHEN k.kept > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN k.kept > p.page_id THEN k.kept END AS refers_to
        FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= {warc.REVISIT_BYTES}"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark items that they overlap."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 40 shards whose row counts are at most one apart."""
    crc = F.coalesce(F.crc32("text"), F.lit(0)).cast("long")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shuffle_into_shards(docs, 40).select(
        "doc_id", sharding.record_bytes("text").alias("size"), crc.alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their cell, calibrated probability and whether they are sampled."""
    return mixing.mix(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_sql() -> str:
    """The same fitting, its rounds written out one after the other."""
    dims = ("source", "lang", "topic")
    steps = [
        f"""r AS (SELECT doc_id, source, lang, tokens, draw,
            CASE WHEN tokens < 100 THEN 'note' WHEN tokens < 1000 THEN 'article' ELSE 'book' END AS topic
            FROM (SELECT doc_id, source, lang,
                coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS tokens,
                ('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE / {mixing.DRAWS} AS draw
                FROM documents))""",
        "f0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS w FROM r GROUP BY ALL)",
    ]
    for d in dims:
        steps.append(f"t_{d} AS (SELECT {d}, pow(sum(tokens), {mixing.SMOOTHING}) / sum(pow(sum(tokens), {mixing.SMOOTHING})) OVER () AS share FROM f0 GROUP BY {d})")
    n = 0
    for _ in range(mixing.ROUNDS):
        for d in dims:
            steps.append(
                f"""f{n + 1} AS MATERIALIZED (SELECT f.source, f.lang, f.topic, f.tokens,
                f.w * t.share * (SELECT sum(tokens) FROM f0) / sum(f.w) OVER (PARTITION BY f.{d}) AS w
                FROM f{n} f JOIN t_{d} t ON f.{d} IS NOT DISTINCT FROM t.{d})"""
            )
            n += 1
    # Cells by falling ratio: of the first k at 1, the factor that the others need; the first k that leaves them below 1 is right.
    steps.append(f"""o AS (SELECT *, w / tokens AS ratio, sum(tokens) OVER () AS total,
        coalesce(sum(tokens) OVER (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f{n} WHERE tokens > 0)""")
    steps.append(f"x AS (SELECT ({mixing.KEEP} * total - before) / rest AS factor FROM o WHERE ratio * ({mixing.KEEP} * total - before) / rest < 1 ORDER BY ratio DESC LIMIT 1)")
    steps.append(f"p AS (SELECT o.*, round(least(1, ratio * coalesce((SELECT factor FROM x), 1e300)), {mixing.DIGITS}) AS probability FROM o)")
    return f"""WITH {", ".join(steps)}
        SELECT r.doc_id, r.source, r.lang, r.topic, r.tokens,
            CASE WHEN r.tokens > 0 THEN p.probability ELSE 0 END AS probability,
            r.tokens > 0 AND r.draw < p.probability AS sampled
        FROM r LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source
            AND r.lang IS NOT DISTINCT FROM p.lang AND r.topic IS NOT DISTINCT FROM p.topic"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 50-byte strings that a smaller document has."""
    return substrings.remove_repeats(read(spark, sf_dir, "documents"), texts=False).drop("kept")


def op10_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 50-word passages that a smaller document has."""
    return phrases.remove_passages(read(spark, sf_dir, "documents"), texts=False).drop("kept")


def crc_sql(source: str, column: str) -> str:
    """CTEs ending in crc_of (value, h): the unsigned CRC-32 of the UTF-8 bytes of ``source``'s distinct ``column``.

    The table of 256 entries is worked out from the polynomial, and a recursion takes one byte of all values at a time.
    """
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""crc_bits AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, {step} FROM crc_bits WHERE k < 8),
        crc_table AS MATERIALIZED (SELECT i, c FROM crc_bits WHERE k = 8),
        crc_run AS (SELECT value, hex(value) AS bytes, 0::BIGINT AS k, 4294967295 AS c FROM (SELECT DISTINCT {column} AS value FROM {source}) WHERE value IS NOT NULL
            UNION ALL SELECT value, bytes, k + 1, xor(r.c >> 8, t.c) FROM crc_run r JOIN crc_table t
            ON t.i = xor(r.c, ('0x' || substr(bytes, 2 * k + 1, 2))::BIGINT) & 255 WHERE k < length(bytes) // 2),
        crc_of AS MATERIALIZED (SELECT value, xor(c, 4294967295) AS h FROM crc_run WHERE k = length(bytes) // 2)"""


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed by their likeness to the benchmark texts, a quarter of them drawn and ranked."""
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_sql() -> str:
    """The same over all words and pairs of words, the scores sorted as a whole."""
    upper, lower, n = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", resample.BUCKETS
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    gumbel = f"('0x' || substr(sha256('{resample.SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
        b AS (SELECT coalesce({words}, []) AS w FROM benchmark),
        fd AS MATERIALIZED (SELECT doc_id, len(w) AS n_words, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
        fb AS MATERIALIZED (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
        every AS (SELECT f FROM fd UNION SELECT f FROM fb),
        {crc_sql("every", "f")},
        s AS (SELECT h % {n} AS k, count(*) AS n FROM fd JOIN crc_of ON f = value GROUP BY ALL),
        t AS (SELECT h % {n} AS k, count(*) AS n FROM fb JOIN crc_of ON f = value GROUP BY ALL),
        g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM fd) + {n}) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM fb) + {n}))))::BIGINT AS gain
            FROM s LEFT JOIN t USING (k)),
        d AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM fd JOIN crc_of ON f = value JOIN g ON g.k = h % {n} GROUP BY doc_id),
        e AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln(({gumbel} + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d USING (doc_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {resample.MIN_WORDS} ORDER BY score DESC, doc_id) AS nth,
            count(*) OVER (PARTITION BY n_words >= {resample.MIN_WORDS}) AS n FROM e)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {resample.MIN_WORDS} AND nth <= {resample.PERCENT} * n // 100 THEN nth END AS rank FROM r"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with the form and root that they are a spelling of."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"), slip=spelling.SLIP)


def op12_sql() -> str:
    """The same by edit distance of all pairs of words; letters beyond ASCII stand as one byte each, as distances are of bytes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    latin = "".join(map(chr, range(0xC0, 0x100)))
    ascii_ = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'{}")
    ascii_ = (ascii_ + "".join(map(chr, range(1, 32))))[: len(latin)]
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
        r AS (SELECT doc_id, run, doc_id::VARCHAR || ':' || run AS name, count(*) AS n FROM runs WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY ALL),
        {crc_sql("r", "name")},
        s AS (SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
            FROM r LEFT JOIN crc_of ON name = value),
        w AS MATERIALIZED (SELECT word, translate(word, '{latin}', '{ascii_}') AS flat, sum(n)::BIGINT AS n FROM s
            WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY ALL HAVING sum(n) >= {spelling.MIN_COUNT}),
        p AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM w a JOIN w b ON length(b.flat) BETWEEN length(a.flat) - 1 AND length(a.flat) + 1
            AND levenshtein(a.flat, b.flat) = 1),
        f AS MATERIALIZED (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM p GROUP BY word),
        g AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {spelling.RATIO} * n THEN best END AS form,
            CASE WHEN best_n >= {spelling.RATIO} * n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
        c AS (SELECT word, word AS root FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL)
        SELECT g.word, g.form, c.root, g.n, g.n_near, g.form_n FROM g JOIN c ON c.word = g.word JOIN g e ON e.word = c.root AND e.form IS NULL"""


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their number of links and their component."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op13_sql() -> str:
    """All pairs of a label compared, components by following links until nothing new is reached."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            AND list_cosine_similarity(a.e, b.e) >= {embeddings.COSINE}),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_url_filters": op2_url_filters,
        "op3_simhash": op3_simhash,
        "op4_toxicity": op4_toxicity,
        "op5_warc": op5_warc,
        "op6_decontamination": op6_decontamination,
        "op7_sharding": op7_sharding,
        "op8_mixing": op8_mixing,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_repeated_phrases": op10_repeated_phrases,
        "op11_resampling": op11_resampling,
        "op12_spelling": op12_spelling,
        "op13_embeddings": op13_embeddings,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": op1_sql(), "op2_url_filters": op2_sql(), "op5_warc": op5_sql(), "op8_mixing": op8_sql(), "op11_resampling": op11_sql(), "op12_spelling": op12_sql(), "op13_embeddings": op13_sql()}
