"""The registered queries of the corpus operators: thin wrappers that apply an operator with production
parameters to a whole table and derive the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprint, html, langid, lm, neardup, quality, secret_scan, toxicity
from .common import checkpointed, in_fold, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.annotate(_documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.as_text("base_spans"), 256).alias("base_sha256"), secret_scan.as_text("spans").alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, fold=(4, 2))
    marked = docs.select("doc_id", "text", in_fold("doc_id", 4, 2).alias("held_out"))
    return langid.annotate(marked, model, keep=["doc_id", "held_out"])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.annotate(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
        "longest_item",
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    """The public tokenizer file of the registered query; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rules = bpe.Rules(tokenizer_path())
    image = bpe.compile_lexicon(rules, bpe.frequent_words(docs))
    return bpe.digests(docs, rules, image, keep=["doc_id"])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(_documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=(5, 0))
    marked = docs.select("doc_id", "text", in_fold("doc_id", 5, 0).alias("held_out"))
    scored = toxicity.annotate(marked, model, keep=["doc_id", "held_out"], score_col="score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold=(4, 2))
    marked = docs.select("doc_id", "text", in_fold("doc_id", 4, 2).alias("held_out"))
    scored = quality.annotate(marked, model, keep=["doc_id", "held_out"], score_col="score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", in_fold("doc_id", 7, 2))
    counts = checkpointed(lm.count(docs.where(~F.col("held_out"))))
    return lm.score(docs, counts, lm.train_tree(counts), keep=["held_out"])


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_fingerprint": op8_fingerprint,
    "op10_lm_scoring": op10_lm_scoring,
    "op9_quality": op9_quality,
}

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _secrets_sql() -> str:
    """Secret scans over rows of tokens: the places of matches by running sums, the battery by list functions."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    assign = f"({names})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"

    def located(kind: int, pattern: str) -> str:
        return f"""SELECT doc_id, {kind} AS kind, sum(gap + len) OVER w - len AS s, sum(gap + len) OVER w AS e, word FROM (
  SELECT doc_id, i, length(p[i]) AS gap, length(m[i]) AS len, m[i] AS word FROM (SELECT doc_id, p, m, unnest(generate_series(1, len(m))) AS i FROM (
    SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM documents WHERE text IS NOT NULL))) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""

    encodings = secret_scan.ENCODINGS
    kinds = f"CASE WHEN enc = {secret_scan.LETTERS} THEN translate(lower(t), '{encodings[secret_scan.LETTERS][2]}', '{secret_scan.VOWEL_OF}') ELSE translate(t, '{encodings[secret_scan.BASE64][2]}', '{secret_scan.KIND_OF}') END"
    pairs = ", ".join(f"'{c}'" for c in secret_scan.CHANGES)
    pick = lambda values: "[" + ", ".join(values) + "][enc + 1]"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(t, '{e[1]}') THEN {i}" for i, e in enumerate(encodings)) + " END"

    def tail(z: str) -> str:
        x = f"(abs({z}) / sqrt(2.0))"
        r = f"(1 / (1 + 0.3275911 * {x}))"
        upper = f"(0.5 * {r} * (0.254829592 + {r} * (-0.284496736 + {r} * (1.421413741 + {r} * (-1.453152027 + {r} * 1.061405429)))) * exp(-{x} * {x}))"
        return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END)"

    return f"""WITH raw AS ({located(0, assign)} UNION ALL {located(1, secret_scan.ACCESS)} UNION ALL {located(2, secret_scan.HEX)}),
base AS (SELECT * FROM raw WHERE kind > 0 OR length(regexp_extract(word, '^{assign}', 2)) >= {secret_scan.ASSIGN_LEAST}),
tokens AS ({located(3, "[A-Za-z0-9+/_-]{%d,}={0,2}" % secret_scan.MIN_LENGTH)}),
free AS (SELECT doc_id, s, e, translate(regexp_replace(word, '=+$', ''), '-_', '+/') AS t FROM tokens k WHERE NOT regexp_matches(word, '^[0-9_/+-]+=*$') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = k.doc_id AND b.s < k.e AND k.s < b.e)),
placed AS (SELECT doc_id, s, e, enc, CAST({pick([f"{len(e[2])}" for e in encodings])} AS DOUBLE) AS k, CAST({pick([f"{e[3]}" for e in encodings])} AS DOUBLE) AS text_ic,
  CAST({pick([f"{e[4]}" for e in encodings])} AS DOUBLE) AS rate, {kinds} AS kinds,
  list_transform(string_split(CASE WHEN enc = {secret_scan.BASE64} THEN t ELSE lower(t) END, ''), lambda c: CAST(strpos({pick([f"'{e[2]}'" for e in encodings])}, c) - 1 AS DOUBLE)) AS v FROM (SELECT *, {kind} AS enc FROM free)),
sized AS (SELECT *, CAST(len(v) AS DOUBLE) AS n, list_sum(v) / len(v) AS mean, CAST(len(list_filter(v, lambda y: y >= k / 2)) AS DOUBLE) AS high,
  CAST(len(list_filter(generate_series(1, len(v) - 1), lambda i: substr(kinds, i, 2) IN ({pairs}))) AS DOUBLE) AS changes FROM placed),
counted AS (SELECT *, list_sum(list_transform(list_distinct(v), lambda x: pow(len(list_filter(v, lambda y: y = x)), 2))) AS squares,
  1 + CAST(len(list_filter(generate_series(1, len(v) - 1), lambda i: (v[i + 1] >= k / 2) <> (v[i] >= k / 2))) AS DOUBLE) AS runs,
  list_sum(list_transform(v, lambda y: (y - mean) * (y - mean))) AS about, list_sum(list_transform(generate_series(1, len(v) - 1), lambda i: (v[i + 1] - mean) * (v[i] - mean))) AS along, 2 * high * (n - high) AS both_ FROM sized),
measured AS (SELECT doc_id, s, e, n, (pow((squares * k / n - n) / (k - 1), 1 / 3.0::DOUBLE) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z_chi,
  CASE WHEN both_ * (both_ - n) / (n * n * (n - 1)) > 0 THEN (runs - 1 - both_ / n) / sqrt(both_ * (both_ - n) / (n * n * (n - 1))) ELSE 9.0 END AS z_runs,
  CASE WHEN about > 0 THEN along / about * sqrt(n) ELSE 9.0 END AS z_serial,
  ((text_ic - (squares - n) / (n * (n - 1))) / sqrt(2 * text_ic * (1 - text_ic) / (n * (n - 1)) + {secret_scan.TEXT_SPREAD} / n)
    + sign(rate) * (changes - (n - 1) * abs(rate)) / sqrt((n - 1) * abs(rate) * (1 - abs(rate)) * {secret_scan.CHANGE_SPREAD})) / sqrt(2.0) AS z_text FROM counted),
judged AS (SELECT doc_id, s, e, 3 * least({tail("z_chi")}, 2 * {tail("abs(z_runs)")}, 2 * {tail("abs(z_serial)")}) AS p_random, {tail("z_text")} * sum(n) OVER d / (n * count(*) OVER d) AS q, count(*) OVER d AS m FROM measured WINDOW d AS (PARTITION BY doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY q) AS r FROM judged),
cut AS (SELECT doc_id, max(q) AS cut FROM ranked WHERE q <= {secret_scan.FALSE_DISCOVERY} * r / m GROUP BY doc_id),
every AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, 3, s, e FROM ranked JOIN cut USING (doc_id) WHERE q <= cut AND p_random >= {secret_scan.BATTERY_LEVEL}),
named AS (SELECT *, {list(secret_scan.KINDS)}[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM every)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, kind, e) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, kind, e), '') AS spans FROM documents LEFT JOIN named USING (doc_id) GROUP BY doc_id"""


ORACLE: dict[str, str] = {
    "op1_secret_scan": _secrets_sql(),
    # Windows by join on their words; a word is hit if it lies in any window found.
    "op3_decontaminate": f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (SELECT item_id, j, size, array_to_string(w[j : j + size - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS k FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, sizes)),
met AS (SELECT doc_id, item_id, j, p, places.size FROM places JOIN windows ON places.k = windows.k AND places.size = windows.size),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS q FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM met) GROUP BY doc_id),
runs AS (SELECT doc_id, item_id, p - j AS diagonal, p, j, size, p - row_number() OVER (PARTITION BY doc_id, item_id, p - j ORDER BY p) AS run FROM met),
longest AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS i, max(p + size) - min(p) AS n, min(p) AS p, item_id FROM runs GROUP BY doc_id, item_id, diagonal, run),
best AS (SELECT doc_id, n, i FROM (SELECT longest.*, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, item_id) AS r FROM longest) WHERE r = 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(best.n, 0) AS longest_match, best.i AS longest_item
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)""",
    # All pairs that share a run of words, and classes by reachability.
    "op7_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS.format("text")} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y, c = p.n AND c = q.n AS same FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 9 * c >= 4 * (p.n + q.n)
  UNION ALL SELECT a.doc_id, b.doc_id, true FROM d a JOIN d b ON a.text = b.text AND a.doc_id <> b.doc_id WHERE len(a.w) = 0),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT x AS doc_id, min(y) AS class_id, (SELECT count(*) FROM links l WHERE l.x = reach.x) AS n_links, 1 + (SELECT count(*) FROM links l WHERE l.x = reach.x AND l.same) AS n_copies FROM reach GROUP BY x""",
}
