"""Queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloom.llm import conversations, decontaminate, langid, metricjoin, mixing, neardup, neighbours, pages, periods, quality, sharding, substrings, toxicity
from discloom.llm.support import table


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole_words=True)


def op2_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), k=16)


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's weight is the mean length of its documents, in whole hundreds of characters and 1 at least."""
    docs = table(spark, sf_dir, "documents")
    weights = docs.groupBy("source").agg(F.expr("greatest(1, sum(coalesce(n_chars, 0)) div (100 * count(*)))").alias("weight"))
    return mixing.mix(docs, weights)


def op4_random_field_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), width=35, with_text=False)


def op7_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op8_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_host_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op10_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_recursive_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are damaged first, as a hash of their conversation and turn says."""
    whole = table(spark, sf_dir, "conversations")
    word = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    role = F.when(code == 4, "user").otherwise(word("role"))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    copies = F.expr("explode(case code when 0 then array() when 3 then array(1, 2) else array(1) end)")
    rows = whole.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).select("conv_id", "turn", "role", "text", copies)
    done = conversations.repair(rows)
    found = done.report.join(done.digests(), "conv", "left")
    ids = whole.select("conv_id").distinct().withColumnRenamed("conv_id", "original")
    found = ids.join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("original").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_metric_space_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.jaccard_join(table(spark, sf_dir, "documents"), width=5, percent=80)


def op13_crochemore_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of some texts, chosen by a hash of the id, are made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(code % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.withColumns({"g": F.floor(code / 10), "words": words})
    docs = docs.withColumn("a", F.expr("if(size(words) > 0, g % size(words), null)"))
    docs = docs.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(words, (x, i) -> if(i >= a, words[int(a + (i - a) % p)], x)), ' ')")
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))
    found = periods.collapse_runs(docs)
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        "longest.length",
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pigeonhole_decontamination": op1_pigeonhole_decontamination,
    "op2_karmarkar_karp_shards": op2_karmarkar_karp_shards,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_random_field_language": op4_random_field_language,
    "op5_noisy_channel_toxicity": op5_noisy_channel_toxicity,
    "op6_count_min_substrings": op6_count_min_substrings,
    "op7_super_minhash": op7_super_minhash,
    "op8_quality_discriminant": op8_quality_discriminant,
    "op9_host_path_text": op9_host_path_text,
    "op10_block_matrix_neighbours": op10_block_matrix_neighbours,
    "op11_recursive_repair": op11_recursive_repair,
    "op12_metric_space_join": op12_metric_space_join,
    "op13_crochemore_runs": op13_crochemore_runs,
}

#: crc32 of a string of ASCII characters, in SQL: each byte is followed by eight shifts.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"""

ORACLE_SQL: dict[str, str] = {
    "op3_pfair_mix": """
        WITH RECURSIVE shares AS (
            SELECT source, count(*) AS n, greatest(1, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) // (100 * count(*))) AS e, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx
            FROM documents GROUP BY source
        ), every AS (
            SELECT list(e ORDER BY idx) AS es, CAST(sum(e) AS BIGINT) AS cycle FROM shares
        ), run AS (
            SELECT CAST(0 AS BIGINT) AS t, list_transform(es, lambda x: CAST(0 AS BIGINT)) AS ran, CAST(NULL AS BIGINT) AS chosen, CAST(NULL AS BIGINT) AS nth FROM every
            UNION ALL
            SELECT t + 1, list_transform(ran, lambda x, i: CASE WHEN i = c THEN x + 1 ELSE x END), c, ran[c] FROM (
                SELECT t, ran, list_sort(list_filter(list_transform(range(1, len(es) + 1), lambda i:
                    CASE WHEN ran[i] < es[i] AND ran[i] * cycle // es[i] <= t THEN {'due': ((ran[i] + 1) * cycle + es[i] - 1) // es[i], 'heavy': -es[i], 'i': i} END), lambda x: x IS NOT NULL))[1].i AS c
                FROM run, every WHERE t < cycle)
        ), plan AS (
            SELECT chosen - 1 AS idx, nth, t - 1 AS place FROM run WHERE chosen IS NOT NULL
        ), horizon AS (
            SELECT min(n // 32 // e * cycle + place) AS h FROM shares JOIN plan ON plan.idx = shares.idx AND nth = n // 32 % e, every
        ), numbered AS (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS k FROM documents
        )
        SELECT d.doc_id, d.source, k // 32 AS block, CAST(k % 32 AS INTEGER) AS in_block, k // 32 * cycle // e AS release, ((k // 32 + 1) * cycle + e - 1) // e AS deadline,
            k // 32 // e * cycle + place AS slot, k // 32 // e * cycle + place < h AS on_target
        FROM numbered d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source JOIN plan ON plan.idx = s.idx AND nth = k // 32 % e, every, horizon
    """,
    "op6_count_min_substrings": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)
        ), starts AS (
            SELECT r, i FROM windows SEMI JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)
        ), covered AS (
            SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM starts
        ), words AS (
            SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
        ), kept AS (
            SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN covered USING (r, p) GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op7_super_minhash": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d
        ), sized AS (
            SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM sets
        ), shingles AS (
            SELECT doc_id, n, hash(x) AS h, x FROM (SELECT doc_id, n, unnest(s) AS x FROM sized)
        ), pairs AS (
            SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS common_n
            FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2
        ), links AS (
            SELECT u, v FROM pairs WHERE 100 * common_n >= 80 * (m + n - common_n)
        ), edges AS (
            SELECT u, v FROM links UNION SELECT v, u FROM links
        ), reached AS (
            SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reached.u, edges.v FROM reached JOIN edges ON reached.v = edges.u
        ), roots AS (
            SELECT u, min(v) AS component_id FROM reached GROUP BY u
        )
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN roots ON doc_id = u
    """,
    "op10_block_matrix_neighbours": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), d AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_recursive_repair": f"""
        WITH RECURSIVE given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
        ), coded AS (
            SELECT *, {CRC32_SQL.format("name")} % 20 AS code FROM given
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded
        ), ordered AS (
            SELECT *, row_number() OVER c AS i, left(role, 1) AS initial, left(lag(role) OVER c, 1) AS prior,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail
            FROM damaged WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
        ), judged AS (
            SELECT *, CASE WHEN tail = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM ordered
        ), edits(s, t, letters, base, needs, told) AS (
            VALUES (0, 1, 'K', 0, 's', ''), (0, 2, 'K', 0, 'u', ''), (1, 2, 'K', 0, 'u', ''), (3, 2, 'K', 0, 'u', ''), (2, 3, 'K', 0, 'a', ''),
                (0, 2, 'R', 2, '', 'user'), (1, 2, 'R', 2, '', 'user'), (3, 2, 'R', 2, '', 'user'), (2, 3, 'R', 2, '', 'assistant'),
                (0, 0, 'D', 3, '', ''), (1, 1, 'D', 3, '', ''), (2, 2, 'D', 3, '', ''), (3, 3, 'D', 3, '', '')
        ), inserts(s, t, letters, base, lines) AS (
            VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (3, 2, 'I', 2, ['user:']),
                (2, 3, 'I', 2, ['assistant:']), (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:'])
        ), reached AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS b FROM judged
            UNION ALL
            SELECT r.conv_id, r.i + 1, e.t, min({{'cost': r.b.cost + n.base + e.base + CAST(e.letters <> 'D' AND fault = 't' AS INTEGER), 'audit': r.b.audit || n.letters || e.letters,
                'lines': r.b.lines || n.lines || CASE e.letters WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [told || ':' || text] ELSE [] END}})
            FROM reached r JOIN judged j ON r.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = r.i + 1 JOIN inserts n ON n.s = r.s JOIN edits e ON e.s = n.t
            WHERE CASE WHEN e.letters = 'D' THEN true WHEN fault IN ('b', 'd') THEN false ELSE needs IN ('', initial) END GROUP BY r.conv_id, r.i, e.t
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id
        ), finished AS (
            SELECT c.conv_id, min({{'cost': b.cost + f.base, 'audit': b.audit || f.letters, 'lines': b.lines || f.lines}}) AS b
            FROM counted c JOIN reached r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.n JOIN inserts f ON f.s = r.s AND f.t IN (0, 3) GROUP BY c.conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN finished f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
    "op12_metric_space_join": """
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
        ), shingles AS (
            SELECT r, len(s) AS n, unnest(s) AS x FROM sets
        ), pairs AS (
            SELECT a.r AS u, b.r AS v, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS both_n
            FROM shingles a JOIN shingles b ON a.x = b.x AND a.r < b.r AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2
        ), links AS (
            SELECT u, v FROM pairs WHERE 100 * both_n >= 80 * (m + n - both_n)
        ), edges AS (
            SELECT u, v FROM links UNION SELECT v, u FROM links
        ), reached AS (
            SELECT r AS u, r AS v FROM d UNION SELECT reached.u, edges.v FROM reached JOIN edges ON reached.v = edges.u
        ), roots AS (
            SELECT u, min(doc_id) AS component_id FROM reached JOIN d ON d.r = v GROUP BY u
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN roots ON r = u
    """,
    "op13_crochemore_runs": f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents
        ), planned AS (
            SELECT r, doc_id, w, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) END AS a, 3 + h // 10 % 8 AS parts FROM d
        ), damaged AS (
            SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // parts) END + 1]) END AS w FROM planned
        ), words AS (
            SELECT r, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM damaged
        ), same AS (
            SELECT a.r, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
        ), islands AS (
            SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same
        ), stretches AS (
            SELECT r, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
        ), runs AS (
            SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l
        ), summed AS (
            SELECT r, count(*) AS n_runs, max({{'l': l, 's': -s, 'q': -q}}) AS longest, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r
        ), gone AS (
            SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs
        ), kept AS (
            SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -longest.s AS start, longest.l AS length, -longest.q AS period, 1000 * longest.l // -longest.q AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM damaged LEFT JOIN summed USING (r) LEFT JOIN kept USING (r)
    """,
}
