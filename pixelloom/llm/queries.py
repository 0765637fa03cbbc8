"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import bpe, chat, decontam, embeddings, jaccard_join, langid, licenses, mixing, periodic, quality, spelling, toxicity, urlfilter
from pixelloom.llm.storage import short_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codec() -> bpe.BytePairCodec:
    import public_tokenizers

    return bpe.BytePairCodec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=3, percent=90).drop("class_id")


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_ngram_jaccard with the class and the number of links of every document."""
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=3, percent=90, count=True)


def _remainder(of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(-1))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    guessed = langid.predict(docs, langid.train(docs.where(_remainder(4).isin(0, 1, 3))))
    return guessed.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), codec())


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], said.schema)
    return chat.digests(chat.format_conversations(said.unionByName(planted)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and item_id of every benchmark item found in a document."""
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score (probability of good quality), predicted (1 if the score is 0.5 or more) and kept."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(_remainder(5) > 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spelling.variants(spelling.vocabulary(docs, delete_every=199))


def _with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents repeat a stretch of words to their end."""
    text = F.col("text").cast("string")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", text.alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    rows = rows.withColumn("n", F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0)).cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(_with_periods(table(spark, sf_dir, "documents")))
    longest = F.expr("try_element_at(array_sort(runs, (a, b) -> case when a.length != b.length then if(a.length > b.length, -1, 1) when a.start != b.start then if(a.start < b.start, -1, 1) when a.period != b.period then if(a.period < b.period, -1, 1) else 0 end), 1)")
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("best"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op1_ngram_jaccard_links": op1_ngram_jaccard_links,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_mixing": op13_source_mixing,
}



def _crc32_table() -> list[int]:
    """The remainders of all bytes by the polynomial of CRC-32."""
    rows = list(range(256))
    for _ in range(8):
        rows = [r >> 1 ^ (0xEDB88320 if r & 1 else 0) for r in rows]
    return rows


#: CRC-32 of a list of bytes.
_CRC = f"xor(list_reduce({{}}, lambda h, b: xor(list_extract({_crc32_table()}::BIGINT[], (xor(h, b) & 255) + 1), h >> 8), 4294967295::BIGINT), 4294967295)"
#: UTF-8 bytes of a string of code points below 0x800.
_BYTES = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6), 128 + ord(c) % 64]::BIGINT[] END))"

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"

_SPREAD = "(sum((bad - n * mean) * (bad - n * mean) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0))"
_STRENGTH = f"CASE WHEN {_SPREAD} > 1 / 1001.0::DOUBLE THEN greatest(1 / {_SPREAD} - 1, 1.0) ELSE 1000.0 END"

#: DuckDB equivalents, where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": """
        WITH RECURSIVE cut AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut),
        rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        found AS (SELECT a, b FROM shared WHERE 100 * n >= 90 * (na + nb - n)),
        links AS (SELECT a, b FROM found UNION ALL SELECT b, a FROM found),
        reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node),
        parts AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
        SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN parts ON node = doc_id""",
    "op1_ngram_jaccard_links": """
        WITH RECURSIVE cut AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut),
        rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        found AS (SELECT a, b FROM shared WHERE 100 * n >= 90 * (na + nb - n)),
        links AS (SELECT a, b FROM found UNION ALL SELECT b, a FROM found),
        reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node),
        parts AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
        classes AS (SELECT list_sort(s) AS equal, min(doc_id) AS class_id FROM sets WHERE len(s) > 0 GROUP BY 1),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT doc_id, len(s) AS n_shingles, coalesce(class_id, doc_id) AS class_id, coalesce(n, 0) AS n_links, component_id
        FROM sets JOIN parts ON node = doc_id LEFT JOIN classes ON list_sort(s) = equal LEFT JOIN counts ON a = doc_id""",
    "op8_decontamination": """
        WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        low AS (SELECT side, id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ') AS t FROM texts),
        cut AS (SELECT side, id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
        items AS (SELECT id AS item_id, w, least(5, len(w)) AS k FROM cut WHERE side = 'i' AND len(w) > 0),
        widths AS (SELECT DISTINCT k FROM items),
        item_rows AS (SELECT item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')))) AS shingle FROM items),
        doc_rows AS (SELECT id AS doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')))) AS shingle FROM cut, widths WHERE side = 'd' AND len(w) >= k),
        sizes AS (SELECT item_id, count(*) AS n_item FROM item_rows GROUP BY item_id),
        found AS (SELECT doc_id, item_id, count(*) AS n_found FROM item_rows JOIN doc_rows USING (k, shingle) GROUP BY ALL)
        SELECT doc_id, item_id, n_found, n_item, n_found / n_item AS containment FROM found JOIN sizes USING (item_id) WHERE 10 * n_found >= 8 * n_item""",
    "op3_license_scan": licenses.oracle_sql(),
    "op11_spelling_variants": f"""
        WITH RECURSIVE found AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY ALL),
        hashed AS (SELECT run, n, {_CRC.format(_BYTES.format("doc_id || ':' || run"))} AS h FROM counted),
        words AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
        without AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS place, left(word, place - 1) || substr(word, place + 1) AS rest FROM words),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.rest = b.rest AND a.place = b.place AND a.word != b.word
            UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS best FROM near GROUP BY word),
        formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM words LEFT JOIN best USING (word)),
        chain AS (SELECT word, word AS root, 0 AS step FROM formed UNION ALL SELECT chain.word, form, step + 1 FROM chain JOIN formed ON formed.word = root WHERE form IS NOT NULL),
        last AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)""",
    "op13_source_mixing": """
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                (('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null')), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
        named AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
        rates AS (
            SELECT (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (full_first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (full_first ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rate
            FROM named WINDOW full_first AS (ORDER BY source_size / weight, source)),
        aimed AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * (SELECT max(rate) FROM rates)) AS target FROM named),
        wanted AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM aimed),
        ranked AS (
            SELECT doc_id, source, size, coalesce(sum(size) OVER (
                PARTITION BY source ORDER BY CASE WHEN size > 0 THEN u / (1 - u) / (size / (size + 32)) END NULLS FIRST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized)
        SELECT doc_id, ranked.source, size, source_size, target,
            (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken,
            CASE WHEN size > 0 THEN taken // size ELSE 0 END AS copies
        FROM ranked JOIN wanted ON ranked.source IS NOT DISTINCT FROM wanted.source""",
    "op6_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: x * x), 'sum') > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id != b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node),
        part AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN part ON node = vec_id LEFT JOIN counts ON a = vec_id""",
    "op5_chat_format": f"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
            SELECT *, length({_ESCAPED.format("text")}) + CASE role
                WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'assistant' THEN length('</s>') WHEN 'system' THEN length('<<SYS>><</SYS>>')
                ELSE length('[ROLE][/ROLE][/TURN]') + length({_ESCAPED.format("role")}) END AS chars
            FROM said)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op7_url_filter": f"""
        WITH parsed AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
                CASE WHEN {" OR ".join(f"contains(lower(concat_ws(' ', url, html)), '{w}')" for w in urlfilter.SPAM_WORDS)} THEN 1 WHEN html IS NOT NULL THEN 0 END AS outcome
            FROM pages),
        hosts AS (SELECT host, regexp_extract(host, '([^.]+[.])?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix, count(outcome) AS n, coalesce(sum(outcome), 0)::DOUBLE AS bad FROM parsed GROUP BY host),
        total AS (SELECT sum(n)::DOUBLE AS t_n, sum(bad) AS t_bad, (sum(bad) + 0.5) / (sum(n) + 1.0) AS rate FROM hosts),
        s_counts AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(bad) AS bad FROM hosts GROUP BY suffix),
        s_level AS (SELECT suffix, n, bad, (t_bad - bad + rate) / (t_n - n + 1) AS mean FROM s_counts, total),
        s_strength AS (SELECT {_STRENGTH} AS m FROM s_level),
        suffixes AS (SELECT suffix, n AS s_n, bad AS s_bad, rate, (bad + m * rate) / (n + m) AS s_mean FROM s_counts, total, s_strength),
        d_counts AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
        d_level AS (SELECT domain, n, bad, s_mean, (s_bad - bad + rate) / (s_n - n + 1) AS mean FROM d_counts JOIN suffixes USING (suffix)),
        d_strength AS (SELECT {_STRENGTH} AS m FROM d_level),
        domains AS (SELECT domain, n AS d_n, bad AS d_bad, s_mean, (bad + m * s_mean) / (n + m) AS d_mean FROM d_level, d_strength),
        h_level AS (SELECT host, n::DOUBLE AS n, bad, d_mean, (d_bad - bad + s_mean) / (d_n - n + 1) AS mean FROM hosts JOIN domains USING (domain)),
        h_strength AS (SELECT {_STRENGTH} AS m FROM h_level),
        posterior AS (SELECT host, bad + m * d_mean AS a, n - bad + m * (1 - d_mean) AS b FROM h_level, h_strength),
        bound AS (SELECT host, 1 / (1 + exp(-(ln(a / b) - 1.645 * sqrt(1 / a + 1 / b)))) AS low FROM posterior),
        ruled AS (
            SELECT page_id, host, path, low, CASE
                WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
            FROM parsed JOIN bound USING (host))
        SELECT page_id, host, path, rule,
            CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' ELSE CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
        FROM ruled""",
}
