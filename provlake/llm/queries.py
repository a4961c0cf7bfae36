"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import collocations, decontamination, importance, interpolation, near_duplicates, packing, prefix_trie, pseudonyms, rules_list, site_lines, token_planes, toxicity, url_rules
from provlake.plans.session import shared_folder, table

#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


#: the key of the pseudonyms; give your own
PSEUDONYM_KEY = "an example key, to be replaced"


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1")
    return importance.resample(table(spark, sf_dir, "documents"), target)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scored(table(spark, sf_dir, "documents"))


def op3_site_relative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.dropped(table(spark, sf_dir, "documents"), ratio=0.1, min_pages=2, copies=True)


OP3_SQL = r"""
WITH p AS (SELECT doc_id, coalesce(source, '') AS host, source, text FROM documents),
t AS (SELECT host, count(*) AS total FROM (SELECT DISTINCT host, doc_id, text FROM p) GROUP BY host),
l AS (SELECT DISTINCT host, doc_id, text, trim(line, ' ') AS line FROM (SELECT host, doc_id, text, unnest(string_split(text, chr(10))) AS line FROM p) WHERE trim(line, ' ') <> ''),
b AS (SELECT host, list(line) AS lines FROM (SELECT host, line, count(*) AS n FROM l GROUP BY host, line) JOIN t USING (host) WHERE n >= 2 AND n > total * 0.1::DOUBLE GROUP BY host),
a AS (SELECT doc_id, source, string_split(text, chr(10)) AS every, coalesce(b.lines, []) AS gone FROM p LEFT JOIN b USING (host)),
k AS (SELECT doc_id, source, every, list_filter(every, lambda x: trim(x, ' ') = '' OR NOT list_contains(gone, trim(x, ' '))) AS kept FROM a)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, coalesce(len(list_filter(every, lambda x: trim(x, ' ') <> '')), 0)::BIGINT AS n_lines, coalesce(len(every) - len(kept), 0)::BIGINT AS n_dropped FROM k
"""


def op3_host_rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.dropped(table(spark, sf_dir, "documents"), **site_lines.HOST_RULE)


OP3_HOST_RULE_SQL = r"""
WITH p AS (SELECT doc_id, coalesce(source, '') AS host, source, text FROM documents),
t AS (SELECT host, count(DISTINCT coalesce(text, '')) AS total FROM p GROUP BY host),
l AS (SELECT DISTINCT host, text, trim(line, ' ') AS line FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM p) WHERE trim(line, ' ') <> ''),
o AS (SELECT line FROM l WHERE len(regexp_extract_all(line, '[^ ]+')) >= 50 GROUP BY line HAVING count(DISTINCT host) >= 10 AND count(DISTINCT text) >= 10),
h AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM l GROUP BY host, line) JOIN t USING (host) WHERE n >= 3 AND n > total * 0.01::DOUBLE UNION SELECT DISTINCT host, line FROM l SEMI JOIN o USING (line)),
b AS (SELECT host, list(line) AS lines FROM h GROUP BY host),
a AS (SELECT doc_id, source, string_split(text, chr(10)) AS every, coalesce(b.lines, []) AS gone FROM p LEFT JOIN b USING (host)),
k AS (SELECT doc_id, source, every, list_filter(every, lambda x: trim(x, ' ') = '' OR NOT list_contains(gone, trim(x, ' '))) AS kept FROM a)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, coalesce(len(list_filter(every, lambda x: trim(x, ' ') <> '')), 0)::BIGINT AS n_lines, coalesce(len(every) - len(kept), 0)::BIGINT AS n_dropped FROM k
"""


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_list.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_prefix_filtered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 12], ' ') AS win, least(13, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, p, n, win FROM dw WHERE win IN (SELECT win FROM iw)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ JOIN iw USING (win)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.linked(table(spark, sf_dir, "documents"), 85).drop("text_key")


def op10_nonnegative_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op9_url_range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""

def grafted(seqs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % 100, h = crc32(decimal c) % 6."""
    base = seqs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("root"), F.slice("turns", 1, 5).alias("head"))
    own = seqs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")).withColumn("root", F.expr("conv_id - conv_id % 100"))
    turns = F.when(F.col("head").isNull(), F.slice("turns", F.col("h") + 1, F.size("turns") + 1)).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns") + 1)))
    return own.join(base, "root", "left").select("conv_id", turns.alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(grafted(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND k <= h UNION ALL SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
p AS (SELECT conv_id, row_number() OVER w AS d, list([role, text]) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix, length(text) AS size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k) UNION ALL SELECT conv_id, 0, [], 0 FROM c),
n AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY d, prefix),
k AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
s AS (SELECT DISTINCT a.prefix AS top, b.prefix AS prefix FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d),
u AS (SELECT s.top AS prefix, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved FROM s JOIN n ON n.prefix = s.prefix LEFT JOIN k ON k.prefix = s.prefix GROUP BY s.top),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
e AS (SELECT p.prefix, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ends FROM p JOIN l USING (conv_id, d) GROUP BY p.prefix)
SELECT n.conv_id, n.d::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n LEFT JOIN n o ON o.d = n.d - 1 AND o.prefix = n.prefix[1:n.d - 1] LEFT JOIN k ON k.prefix = n.prefix JOIN u ON u.prefix = n.prefix LEFT JOIN e ON e.prefix = n.prefix
"""


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    token_planes.write(table(spark, sf_dir, "documents"), byte_vocabulary(), folder)
    return token_planes.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_stripe_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
x AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS s) WHERE s < m)) GROUP BY lang, phrase),
k AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS j FROM c) c LEFT JOIN x USING (lang, phrase) WHERE coalesce(longest, 0) < c.a),
s AS (SELECT k.lang, k.phrase, k.a, j, h.a AS l, r.a AS r, n.n, (1000::HUGEINT * k.a * n.n::HUGEINT) // (h.a::HUGEINT * r.a) AS score FROM k JOIN f h ON h.lang = k.lang AND h.phrase = head JOIN f r ON r.lang = k.lang AND r.phrase = rest JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""

QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_site_relative_lines": op3_site_relative_lines,
    "op3_host_rule_lines": op3_host_rule_lines,
    "op4_decision_list": op4_decision_list,
    "op5_prefix_filtered_windows": op5_prefix_filtered_windows,
    "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
    "op7_tensored_minhash": op7_tensored_minhash,
    "op8_cost_balanced_packing": op8_cost_balanced_packing,
    "op9_url_range_rules": op9_url_range_rules,
    "op10_nonnegative_pu_toxicity": op10_nonnegative_pu_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_planes": op12_token_planes,
    "op13_stripe_collocations": op13_stripe_collocations,
}
ORACLE_SQL = {"op3_site_relative_lines": OP3_SQL, "op3_host_rule_lines": OP3_HOST_RULE_SQL, "op5_prefix_filtered_windows": OP5_SQL, "op9_url_range_rules": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_stripe_collocations": OP13_SQL}
