"""The operators of this package applied to their whole tables, and SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm import conversation_repair, decontaminate, html_extract, langid, license_rules, license_scan, ngram_join, packing, pii, secret_scan, substring_dedup, topk_search, toxicity, vector_codes
from hearthline.storage import ship, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.train(docs.where(remainder != 1))
    seen = docs.select("doc_id", "text", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"))
    return langid.identify(seen, model).drop("text")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    worn = conversation_repair.damage(rows)
    found = written(conversation_repair.audits(worn), "audits")
    hashes = conversation_repair.digest(conversation_repair.replay(worn, found))
    whole = conversation_repair.report(rows, found).join(hashes, "conv", "left")
    return whole.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).drop("conv")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_exact_topk, op3_decontaminate, op4_substring_dedup, op5_secret_scan, op6_html_extract, op7_packing, op8_pii, op9_toxicity, op10_ngram_join, op11_license_scan, op12_vector_codes, op13_conversation_repair)}


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT * FROM r WHERE rank <= 5
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, CAST([] AS VARCHAR[])) AS w FROM documents),
win AS (
  SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)
), firsts AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
dup AS (SELECT DISTINCT win.doc_id, win.k FROM win JOIN firsts USING (s) WHERE win.doc_id > firsts.m),
gone AS (SELECT DISTINCT doc_id, k + o AS pos FROM dup, (SELECT unnest(range(0, 13)) AS o)),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d WHERE len(w) > 0),
kept AS (
  SELECT p.doc_id, count(g.pos) AS n_removed, string_agg(p.word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS t
  FROM pos p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id
) SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
  UNION SELECT doc_id, '<' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY 1, 2
"""


def _op5() -> str:
    """Places of matches, as what stands between them and they are added up, rule by rule."""
    rules = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 12"""),
        *((kind, pattern, f"length(m) >= {least}") for kind, pattern, least in [*secret_scan.BASE, *secret_scan.ADDED][1:]),
    ]
    parts = []
    for rank, (kind, pattern, keep) in enumerate(rules):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS stop FROM (
    SELECT doc_id, m, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, hits, gaps, unnest(hits) AS m, unnest(range(1, len(hits) + 1)) AS k
          FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS hits, string_split_regex(t, '{quoted}') AS gaps FROM d) WHERE len(hits) > 0)
  ) WHERE {keep}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS b, count(*) FILTER (WHERE rank = 2) AS c,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM f GROUP BY doc_id
) SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


def _op11() -> str:
    """Every keyword's occurrence with each of its rules, and intervals without one that contains them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({k}, {quoted(r.keyword)}, {quoted(r.pattern)}, {r.priority}, {quoted(r.label)}, {license_rules.SCORES[r.priority]})" for k, r in enumerate(license_rules.rules()))
    reach, spaces = license_rules.REACH, "length({0}) - length(replace({0}, ' ', ''))"
    phrases = " UNION ALL ".join(
        f"SELECT r, {quoted(label)} AS label, unnest(list_filter(range(0, len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {quoted(x)}' for k, x in enumerate(phrase))})) AS start FROM d" for label, phrase in license_scan.PHRASES
    )
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), rules(o, keyword, pattern, priority, label, score) AS MATERIALIZED (VALUES {rules}),
keys AS MATERIALIZED (SELECT r, word AS keyword, k FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM d) WHERE word IN (SELECT keyword FROM rules)),
near AS MATERIALIZED (
  SELECT r, keyword, k, ' ' || array_to_string(w[greatest(k - {reach}, 0) + 1 : k], ' ') || CASE WHEN k > 0 THEN ' ' ELSE '' END || chr(1) || keyword || ' ' || array_to_string(w[k + 2 : k + {reach} + 1], ' ') || ' ' AS t FROM keys JOIN d USING (r)
), hits AS MATERIALIZED (
  SELECT r, o, label, priority, score, s, s + ({spaces.format("m")}) + 1 AS e FROM (SELECT *, k - ({spaces.format("string_split(m, chr(1))[1]")}) AS s FROM (SELECT *, regexp_extract(t, pattern, 1) AS m FROM near JOIN rules USING (keyword)) WHERE m <> '')
), kept AS (
  SELECT * FROM hits x WHERE NOT EXISTS (
    SELECT 1 FROM hits y WHERE y.r = x.r AND y.s <= x.s AND y.e >= x.e AND y.priority <= x.priority AND (y.e - y.s > x.e - x.s OR (y.priority, y.o) < (x.priority, x.o)))
), places AS MATERIALIZED ({phrases}),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT r, label, score FROM kept UNION ALL SELECT r, label, {license_rules.SCORES[license_rules.NAME]} FROM places) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r)
"""


def _op12() -> str:
    """Rounds of assignment to the nearest of all entries and of means, one after another."""
    distance = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assigned = f"SELECT r, part, (min({{'d': CAST({distance} AS BIGINT), 'e': entry}})).e AS entry, min(CAST({distance} AS BIGINT)) AS d FROM parts p JOIN BOOK c USING (part) GROUP BY 1, 2"
    rounds = "".join(f""",
a{k} AS MATERIALIZED ({assigned.replace('BOOK', f'c{k}')}),
s{k} AS (SELECT part, entry, k, sum(x[k]) AS s, count(*) AS n FROM (SELECT part, a{k}.entry, x, unnest(range(1, len(x) + 1)) AS k FROM parts JOIN a{k} USING (r, part)) GROUP BY 1, 2, 3),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, x) AS x FROM c{k} LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS m FROM s{k} GROUP BY 1, 2) USING (part, entry))""" for k in range(vector_codes.ROUNDS))
    last = f"c{vector_codes.ROUNDS}"
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), parts AS MATERIALIZED (SELECT r, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM v, (SELECT unnest(range(0, 8)) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM parts WHERE r <= 16){rounds},
f AS MATERIALIZED ({assigned.replace('BOOK', last)}),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM {last}),
g AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN g USING (r), h
"""


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))"

OP13 = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")}, 4294967295) % 20 AS kind FROM conversations
), worn AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE kind <> 0
), seen AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    lead(role[1:1]) OVER w AS next FROM worn WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), known AS MATERIALIZED (
  SELECT conv_id, turn, role, text, k, role[1:1] AS i, role[1:1] || next AS pair, CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM seen
), ends AS (SELECT conv_id, max(k) AS n FROM known GROUP BY 1),
moves AS (  -- from the role that stands last, by inserts and perhaps a row's edit, to another
  SELECT * FROM (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')) t(last, after, name)
), inserts AS (
  SELECT last, last AS mid, 0 AS c, '' AS e, CAST([] AS VARCHAR[]) AS t FROM moves
  UNION ALL SELECT last, after, 3, 'I', [name || ':'] FROM moves
  UNION ALL SELECT a.last, b.after, 6, 'II', [a.name || ':', b.name || ':'] FROM moves a JOIN moves b ON a.after = b.last
), best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, '' AS last, {{'c': CAST(0 AS BIGINT), 'e': '', 't': CAST([] AS VARCHAR[])}} AS w FROM ends
  UNION ALL
  SELECT conv_id, k, last, min(w) FROM (
    SELECT r.conv_id, r.k, o.after AS last, {{'c': b.w.c + n.c + o.c, 'e': b.w.e || n.e || o.e, 't': b.w.t || n.t || o.t}} AS w
    FROM best b JOIN known r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.k = b.k + 1 JOIN inserts n ON n.last = b.last JOIN moves m ON m.last = n.mid,
      LATERAL (
        SELECT n.mid AS after, 4 AS c, 'D' AS e, CAST([] AS VARCHAR[]) AS t
        UNION ALL SELECT m.after, 3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'R', [m.name || ':' || r.text] WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')
        UNION ALL SELECT r.i, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [r.role || ':' || r.text] WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate') AND (r.i = m.after OR (r.i = 's' AND n.mid = ''))
      ) o
  ) GROUP BY conv_id, k, last
), whole AS (
  SELECT b.conv_id, min({{'c': b.w.c + n.c, 'e': b.w.e || n.e, 't': b.w.t || n.t}}) AS w FROM best b JOIN ends ON ends.conv_id IS NOT DISTINCT FROM b.conv_id AND ends.n = b.k JOIN inserts n ON n.last = b.last WHERE n.mid IN ('', 'a') GROUP BY 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM known GROUP BY 1
)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.e, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN whole x ON x.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN counts y ON y.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2, "op4_substring_dedup": OP4, "op5_secret_scan": _op5(), "op10_ngram_join": OP10, "op11_license_scan": _op11(), "op12_vector_codes": _op12(), "op13_conversation_repair": OP13}
