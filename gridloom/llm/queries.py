"""The registered queries of this subpackage, one thin query an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe_prefixes, chosen_path, common, decontaminate, importance, license_scan, packing, quality, secret_scan, token_counts, topk, toxicity, url_filter, whitening

# The rules that op8 judges by (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(common.table(spark, sf_dir, "documents"))
    some = F.size("starts") > 0
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.when(some, F.col("starts")[0]).cast("long").alias("first_word"), F.when(some, F.element_at("starts", -1)).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of one id are told apart by place, start and content; rows that are alike in all of these may change places."""
    pieces = packing.tokenize_pieces(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, order=("doc_id", "piece", "start", "ids_crc32"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(common.table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.rendered(F.col("base")), 256).alias("base_sha256"), secret_scan.rendered(F.col("spans")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels mark quality and toxicity, so the chain is junk, then toxic."""
    found = toxicity.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return found.select("doc_id", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"), "p_junk")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_classes(common.table(spark, sf_dir, "documents"))


def remainder(of: str):
    return F.crc32(F.col(of).cast("string")) % 3


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, carried: str | None = None) -> DataFrame:
    return quality.classify(docs, common.table(spark, sf_dir, "labels"), learn=remainder("id") != 1, half=(remainder("id") == 0), carried=carried)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(spark, common.table(spark, sf_dir, "documents"), sf_dir)
    return found.select("doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def benchmark_hits(spark: SparkSession, docs: DataFrame, sf_dir: str, id_col: str = "doc_id") -> DataFrame:
    question, answer = decontaminate.split_item()
    items = common.table(spark, sf_dir, "benchmark").select("item_id", question.alias("question"), answer.alias("answer"))
    return decontaminate.contaminated(docs, items, id_col=id_col)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(spark, common.table(spark, sf_dir, "documents"), sf_dir)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages"), URL_RULES)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written as flat token files into the shared folder, then counted from the files alone."""
    path = common.shared_path(spark, "tokens")
    token_counts.write_token_files(common.table(spark, sf_dir, "documents"), path, tokenizer_path())
    counted = token_counts.count_tokens(spark, path)
    common.delete(spark, path)
    return counted.select("doc_id", F.col("tokens").alias("n_tokens"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_bpe_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe_prefixes.encode(common.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    both = bpe_prefixes.decode(encoded, ranks)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_license_scan, op2_best_fit_packing, op3_secret_scan, op4_toxicity, op5_ngram_jaccard, op6_quality, op7_decontamination, op8_url_filter, op9_token_counts, op10_topk, op11_bpe_prefixes, op12_importance, op13_whitening, pipeline]
    return {f.__name__: f for f in found}


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    starts = " || ".join(f"[i for i in range(len(ws)) if ws[i + 1:i + {len(p.split())}] = {_sql_list(p.split())}]" for p in license_scan.PHRASES)
    labels = ", ".join(f"CASE WHEN (' ' || array_to_string(ws, ' ') || ' ') LIKE '% {p} %' THEN '{label}' END" for p, label in license_scan.PHRASES.items())
    reach = license_scan.runs(license_scan.TEMPLATES, 0.8)
    rows = ", ".join(f"({k}, '{label}', {reach[k]}, {_sql_list(sorted(set(t.split())))})" for k, (label, t) in enumerate(license_scan.TEMPLATES))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER_SQL.format("coalesce(text, '')")}, '{word}') AS ws FROM documents),
b AS (SELECT doc_id, len(ws) AS n_words, list_sort({starts}) AS starts, list_sort(list_distinct([x for x in [{labels}] if x IS NOT NULL])) AS bl FROM d),
tpl(k, label, reach, tw) AS (VALUES {rows}),
c AS (SELECT doc_id, ws, k, label, reach, tw FROM d CROSS JOIN tpl WHERE len(list_intersect(ws, tw)) >= ceil(0.8 * len(tw) - 1e-9)),
r AS (SELECT doc_id, label, tw, unnest([ws[i:i + reach - 1] for i in range(1, len(ws) + 1) if list_contains(tw, ws[i])]) AS run FROM c),
m AS (SELECT doc_id, label, len(list_intersect(run, tw)) AS n, len(tw) AS m FROM r),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(CAST(n AS DOUBLE) / m) AS most FROM m WHERE n >= ceil(0.8 * m - 1e-9) GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(starts[1] AS BIGINT) AS first_word, CAST(starts[-1] AS BIGINT) AS last_word,
  array_to_string(bl, ',') AS base_labels, array_to_string(list_sort(list_distinct(bl || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(bl) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN g USING (doc_id)"""


def _secret_sql(reach: int = 200) -> str:
    def found(column: str, kind: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        parts, whole = f"regexp_split_to_array({column}, '{p}')", f"regexp_extract_all({column}, '{p}', 0)"
        part = f"regexp_extract_all({column}, '{p}', {group})"
        before = f"coalesce(list_sum([length(x) for x in ({parts})[1:i]]), 0) + coalesce(list_sum([length(x) for x in ({whole})[1:i - 1]]), 0)"
        return f"[{{'s': CAST({before} AS BIGINT), 'r': {secret_scan.ORDER[kind]}, 'e': CAST({before} + length(({whole})[i]) AS BIGINT), 'k': '{kind}'}} for i in range(1, len({whole}) + 1) if length(({part})[i]) >= {least}]"

    base = " || ".join(found("t", *k) for k in secret_scan.BASE)
    every = " || ".join(found("t", *k) for k in [*secret_scan.BASE, *secret_scan.WEAK])
    guard = "|".join(p for _, p, _, _ in secret_scan.WEAK).replace("'", "''")
    roles = ", ".join(f"'{k}': '{r}'" for k, r in secret_scan.ROLE.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, list_sort({base}) AS base FROM d),
p AS (SELECT doc_id, unnest({every}) AS z FROM d WHERE regexp_matches(t, '{guard}')),
q AS (SELECT doc_id, z.s AS s, z.r AS r, z.e AS e, z.k AS k, MAP {{{roles}}}[z.k] AS role FROM p),
h AS (SELECT a.doc_id, a.s, a.r, a.e, a.k, a.role, bool_or(o.role = 'id') AS id, bool_or(o.role = 'secret') AS secret FROM q a JOIN q o ON a.doc_id = o.doc_id AND o.role <> 'endpoint' AND o.s <= a.e + {reach} AND o.e >= a.s - {reach}
  WHERE a.r >= {len(secret_scan.BASE)} GROUP BY ALL),
kept AS (SELECT doc_id, list({{'s': s, 'r': r, 'e': e, 'k': k}}) AS more FROM h WHERE role = 'id' AND secret OR role = 'secret' AND id OR role = 'endpoint' AND id AND secret GROUP BY doc_id),
j AS (SELECT doc_id, base, list_sort(base || coalesce(more, [])) AS sp FROM b LEFT JOIN kept USING (doc_id))
SELECT doc_id, CAST(len([y for y in base if y.k = 'assign']) AS BIGINT) AS n_assign, CAST(len([y for y in base if y.k = 'access']) AS BIGINT) AS n_access, CAST(len([y for y in base if y.k = 'hex']) AS BIGINT) AS n_hex,
  sha256(coalesce(array_to_string([y.k || ':' || y.s || ':' || y.e for y in base], ','), '')) AS base_sha256, coalesce(array_to_string([y.k || ':' || y.s || ':' || y.e for y in sp], ','), '') AS spans
FROM j"""


def _url_sql() -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, q) AS (VALUES {rows}),
j AS (SELECT page_id, host, path, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST, length(h) DESC, h || q) AS n
  FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE n = 1"""


TOPK_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


def _words_sql(column: str) -> str:
    return f"regexp_extract_all({_LOWER_SQL.format(column)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


# Every pair of different sets that shares an n-gram, and the closure of the links.
JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words_sql("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, greatest(len(ws) - 4, 1) + 1)])) AS grams FROM d WHERE len(ws) > 0),
c AS (SELECT grams, min(doc_id) AS node, count(*) AS copies FROM g GROUP BY grams),
x AS (SELECT node, copies, len(grams) AS n, unnest(grams) AS gram FROM c),
p AS (SELECT a.node AS u, b.node AS v, any_value(b.copies) AS copies FROM x a JOIN x b ON a.gram = b.gram AND a.node <> b.node GROUP BY a.node, b.node HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
r(node, root) AS (SELECT node, node FROM c UNION SELECT p.v, r.root FROM r JOIN p ON p.u = r.node),
s AS (SELECT node, min(root) AS root FROM r GROUP BY node),
l AS (SELECT u AS node, sum(copies) AS links FROM p GROUP BY u),
k AS (SELECT grams, root, coalesce(links, 0) + copies - 1 AS links, copies FROM c JOIN s USING (node) LEFT JOIN l USING (node))
SELECT doc_id, coalesce(root, doc_id) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, CAST(coalesce(copies, 1) AS BIGINT) AS n_copies
FROM documents LEFT JOIN g USING (doc_id) LEFT JOIN k USING (grams)"""


def _bm25_sql(theta: float = 0.6, half: int = 64) -> str:
    """Windows of 2 x half words, for items of at most half words."""

    def share(part: str) -> str:
        runs = lambda x: f"[{x}[i:i + least(4, len({part})) - 1] for i in range(1, len({x}) - least(4, len({part})) + 2)]"
        return f"CASE WHEN len({part}) = 0 THEN 1.0 ELSE len([y for y in list_distinct({runs(part)}) if list_contains({runs('w')}, y)]) / CAST(len(list_distinct({runs(part)})) AS DOUBLE) END"

    n = "CAST(ceil(len(t) * CAST(0.7 AS DOUBLE)) AS BIGINT)"
    return f"""
WITH i AS (SELECT item_id, string_split_regex(trim(coalesce(text, '')), '\\s+') AS t FROM benchmark),
q AS (SELECT item_id, {_words_sql(f"array_to_string(t[1:{n}], ' ')")} AS q, {_words_sql(f"array_to_string(t[{n} + 1:], ' ')")} AS a FROM i),
n AS (SELECT item_id, q, a, len(q) + len(a) AS n FROM q WHERE len(q) + len(a) > 0),
z AS (SELECT count(*) AS items, avg(n) AS mean FROM n),
t AS (SELECT item_id, n, word, count(*) AS tf FROM (SELECT item_id, n, unnest(q || a) AS word FROM n) GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
s AS (SELECT item_id, word, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS w FROM t JOIN f USING (word), z),
v AS (SELECT item_id, word, w / sum(w) OVER (PARTITION BY item_id) AS w FROM s),
d AS (SELECT doc_id, {_words_sql("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, (generate_subscripts(ws, 1) - 1) // {half} AS h FROM d),
x AS (SELECT DISTINCT doc_id, word, unnest([h, h - 1]) AS h FROM p),
m AS (SELECT doc_id, h, item_id, round(sum(w), 9) AS score FROM x JOIN v USING (word) WHERE h >= 0 GROUP BY ALL HAVING sum(w) >= {theta}),
o AS (SELECT doc_id, item_id, h * {half} AS start, score, q, a, ws[h * {half} + 1:h * {half} + {2 * half}] AS w FROM m JOIN d USING (doc_id) JOIN n USING (item_id)),
y AS (SELECT doc_id, item_id, start, score, {share("q")} AS question_overlap, {share("a")} AS answer_overlap FROM o)
SELECT doc_id, item_id, start, score, question_overlap, answer_overlap FROM y WHERE question_overlap >= 0.5 AND answer_overlap >= 0.5
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, question_overlap DESC, answer_overlap DESC, start) = 1"""


# CRC-32 byte by byte: its table from the reversed polynomial, then a fold over the bytes of each different word.
IMPORTANCE_SQL = f"""
WITH k AS (SELECT [list_reduce([i] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) for i in range(256)] AS k),
d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql("coalesce(text, '')")} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
tw AS (SELECT unnest({_words_sql("coalesce(text, '')")}) AS w FROM benchmark),
u AS (SELECT w, list_reduce([4294967295] || [CAST('0x' || hex(w)[2 * i - 1:2 * i] AS BIGINT) for i in range(1, strlen(w) + 1)], lambda c, b: xor(k[(xor(c, b) & 255) + 1], c >> 8)) AS c FROM (SELECT w FROM dw UNION SELECT w FROM tw), k),
b AS (SELECT w, xor(c, 4294967295) % 10000 AS b FROM u),
s AS (SELECT b, count(*) AS s FROM dw JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM tw JOIN b USING (w) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM tw) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
x AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY r),
y AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS score FROM d LEFT JOIN x USING (r)),
z AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n, weight) AS k, 10 * (count(*) OVER (PARTITION BY n >= 20)) // 100 AS most FROM y)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN n >= 20 AND k <= most THEN k END AS BIGINT) AS rank FROM z"""


def oracle_sql() -> dict[str, str]:
    """The other queries have no SQL: a tokenizer or a trained model. Their tests hold them against the library, brute force or held-out labels."""
    return {"op1_license_scan": _license_sql(), "op3_secret_scan": _secret_sql(), "op5_ngram_jaccard": JACCARD_SQL, "op7_decontamination": _bm25_sql(), "op8_url_filter": _url_sql(), "op10_topk": TOPK_SQL, "op12_importance": IMPORTANCE_SQL}
