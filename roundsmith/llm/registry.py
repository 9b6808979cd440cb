"""The ``opN_<name>`` queries with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundsmith.llm import chat, decontaminate, html_text, neardup, packing, pii, secrets, token_files, topk, toxicity


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(kind_spans) -> F.Column:
    return F.array_join(kind_spans, ",")


def op1_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(_table(spark, sf_dir, "conversations"), *chat.neighbours(F.col("conv_id")))


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    named = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    base = F.concat(*map(named, pii.KINDS))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, terms)).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.to_json("evidence").alias("evidence"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "byte", end_id=0)
    return token_files.read_token_files(files)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    kind = lambda f: F.element_at(F.array(*map(F.lit, secrets.KINDS)), f["kind"] + 1)
    base = F.transform("found", lambda f: F.concat_ws(":", kind(f), f["start"], f["end"]))
    # By start, and at one start by kind as listed, the method's kind last.
    order = F.array_sort(
        F.concat(
            F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end"), kind(f).alias("name"))),
            F.transform(F.filter("found", lambda f: f["verdict"] == "live"), lambda f: F.struct(f["start"].alias("start"), F.lit(len(secrets.KINDS)).alias("kind"), f["end"].alias("end"), F.lit("live").alias("name"))),
        )
    )
    count = lambda field, value: F.size(F.filter("found", lambda f: f[field] == value)).cast("long")
    counts = [count("kind", k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)]
    verdicts = [count("verdict", v).alias(f"n_{v}") for v in ("live", "copied")]
    spans = F.transform(F.array_distinct(order), lambda s: F.concat_ws(":", s["name"], s["start"], s["end"]))
    return found.select("doc_id", *counts, *verdicts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "word", end_id=1)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_chat_preference, op2_pii_sanitisation, op3_toxicity, op4_near_duplicates, op5_token_files, op6_secret_scan, op7_topk_search, op8_best_fit_packing, op9_decontamination, op10_html_text)}

_RENDER = "list_aggregate(list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', '')"
_MASK = "list_aggregate(list_transform({0}, lambda t: (length(t.role) + 5)::VARCHAR || ':0,' || (length(t.text) + 8)::VARCHAR || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END), 'string_agg', ',')"

def _either(word: str) -> str:
    """The word's letters in either case, and no others that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _places(name, kind, pattern, group, least):
    """SQL for (doc_id, source, name, kind, a, b, v) of each match in code points: running sums of the pieces between matches place them."""
    return f"""SELECT doc_id, source, '{name}' AS name, {kind} AS kind, b - length(w) AS a, b, v FROM (
    SELECT *, (sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS b FROM (
      SELECT doc_id, source, unnest(regexp_extract_all(t, '{pattern}', 0)) AS w, unnest(regexp_extract_all(t, '{pattern}', {group})) AS v,
        unnest(string_split_regex(t, '{pattern}')) AS g, unnest(range(len(regexp_extract_all(t, '{pattern}', 0)) + 1)) AS i FROM texts)
    WHERE w IS NOT NULL) WHERE length(v) >= {least}"""


def _spans(name, kind, pattern, valid):
    """SQL for (doc_id, t, name, kind, a, b, v) of the valid matches of a kind of personal data."""
    return f"""SELECT doc_id, t, '{name}' AS name, {kind} AS kind, b - length(w) AS a, b, w AS v FROM (
    SELECT *, (sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS b FROM (
      SELECT doc_id, t, unnest(regexp_extract_all(t, '{pattern}', 0)) AS w, unnest(string_split_regex(t, '{pattern}')) AS g,
        unnest(range(len(regexp_extract_all(t, '{pattern}', 0)) + 1)) AS i FROM texts)
    WHERE w IS NOT NULL) WHERE {valid}"""


_DIGITS = "regexp_replace(w, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"


SQL = {
    "op1_chat_preference": f"""
WITH said AS (
  SELECT (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair_id, ((conv_id % 2) + 2) % 2 AS side, conv_id, turn,
         struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
both_sides AS (
  SELECT pair_id,
         list(t ORDER BY turn NULLS FIRST, t.role, t.text) FILTER (side = 0) AS c,
         list(t ORDER BY turn NULLS FIRST, t.role, t.text) FILTER (side = 1) AS r,
         min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id
  FROM said GROUP BY pair_id),
counted AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, least(len(c), len(r))) AS n
  FROM both_sides WHERE c IS NOT NULL AND r IS NOT NULL),
cut AS (SELECT *, c[1:n] AS p, c[n + 1:] AS cc, r[n + 1:] AS rr FROM counted)
SELECT pair_id, chosen_id, rejected_id, n::INTEGER AS n_prompt_turns,
       coalesce({_RENDER.format("p")}, '') AS prompt, coalesce({_RENDER.format("cc")}, '') AS chosen, coalesce({_RENDER.format("rr")}, '') AS rejected,
       coalesce({_MASK.format("cc")}, '') AS chosen_mask, coalesce({_MASK.format("rr")}, '') AS rejected_mask
FROM cut""",
    "op2_pii_sanitisation": rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  {_spans('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_spans('ip', 1, '[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)', "len(list_filter(string_split(w, '.'), lambda p: p::DOUBLE > 255)) = 0")}
  UNION ALL {_spans('card', 2, '[0-9]([ -]?[0-9])+', f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")}
  UNION ALL {_spans('phone', 3, '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 8 AND 15")}),
held AS (SELECT doc_id, list(struct_pack(a := a, b := b)) AS spans FROM base GROUP BY doc_id),
rests AS (
  SELECT doc_id, t, CASE WHEN spans IS NULL THEN t ELSE array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE WHEN len(list_filter(spans, lambda s: s.a < i AND i <= s.b)) > 0 THEN ' ' ELSE c END), '') END AS rest
  FROM texts LEFT JOIN held USING (doc_id)),
words AS (
  SELECT doc_id, t, lower(w) AS term, b - length(w) AS a, b FROM (
    SELECT *, (sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS b FROM (
      SELECT doc_id, t, unnest(regexp_extract_all(rest, '[\p{{L}}\p{{N}}]+')) AS w, unnest(string_split_regex(rest, '[\p{{L}}\p{{N}}]+')) AS g, unnest(range(len(regexp_extract_all(rest, '[\p{{L}}\p{{N}}]+')) + 1)) AS i FROM rests)
    WHERE w IS NOT NULL)),
n_texts AS (SELECT count(DISTINCT t)::DOUBLE AS n FROM texts),
of_term AS (SELECT term, count(DISTINCT t) AS nt FROM words GROUP BY term),
entity AS (SELECT DISTINCT t, name || ':' || lower(v) AS e FROM base),
of_entity AS (SELECT e, count(*) AS ne FROM entity GROUP BY e),
pairs AS (SELECT e, term, count(*) AS n_both FROM entity JOIN (SELECT DISTINCT t, term FROM words WHERE t IN (SELECT t FROM entity)) USING (t) GROUP BY e, term),
revealing AS (
  SELECT DISTINCT term FROM pairs JOIN of_entity USING (e) JOIN of_term USING (term), n_texts
  WHERE n > ne AND ln(n * (n_both - 0.5) / (ne * nt)) / ln(n / ne) >= 0.7),
all_spans AS (
  SELECT doc_id, name, kind, a, b FROM base
  UNION ALL SELECT doc_id, 'term', 4, a, b FROM words WHERE term IN (SELECT term FROM revealing)),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
    string_agg(name || ':' || a || ':' || b, ',' ORDER BY kind, a) FILTER (kind < 4) AS base_text, string_agg(name || ':' || a || ':' || b, ',' ORDER BY kind, a) AS spans
  FROM all_spans GROUP BY doc_id)
SELECT texts.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN by_doc ON by_doc.doc_id = texts.doc_id""",
    "op4_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
alike AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
items AS (SELECT doc_id, n, unnest(s) AS item FROM alike),
frequent AS (SELECT item, count(*) AS df FROM items GROUP BY item),
ranked AS (SELECT doc_id, n, item, row_number() OVER (PARTITION BY doc_id ORDER BY df, item) AS place FROM items JOIN frequent USING (item)),
prefix AS (SELECT doc_id, n, item FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1),
candidates AS (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM prefix a JOIN prefix b USING (item)
  WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT x, y FROM candidates JOIN alike a ON a.doc_id = x JOIN alike b ON b.doc_id = y
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM alike UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
component AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN alike a ON a.s = list_sort(d.s) LEFT JOIN component c ON c.doc_id = a.doc_id""",
    "op6_secret_scan": rf"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
kept AS (
  {_places('assign', 0, _ASSIGN, 2, 6)}
  UNION ALL {_places('access', 1, 'AKIA[A-Z0-9]+', 0, 20)}
  UNION ALL {_places('hex', 2, '[0-9a-f]{24,}', 0, 24)}),
spread AS (
  SELECT v, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS repositories, count(DISTINCT source) + max((source IS NULL)::INT) AS owners,
    NOT regexp_matches(v, '(?i)example|sample|changeme|placeholder|dummy|your|xxxx|1234567|abcdef|test') AND (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') OR length(v) >= 20)
      AND list_aggregate(string_split(v, ''), 'entropy') >= 0.75 * log2(least(length(v), 16)) AS live
  FROM kept GROUP BY v),
judged AS (SELECT kept.*, CASE WHEN owners >= 3 OR repositories >= 50 THEN 'copied' WHEN live THEN 'live' ELSE 'weak' END AS verdict FROM kept JOIN spread USING (v)),
spans AS (
  SELECT doc_id, name, kind, a, b, true AS base, verdict FROM judged
  UNION SELECT doc_id, 'live', 3, a, b, false, verdict FROM judged WHERE verdict = 'live'),
by_doc AS (
  SELECT doc_id, count(*) FILTER (base AND kind = 0) AS n_assign, count(*) FILTER (base AND kind = 1) AS n_access, count(*) FILTER (base AND kind = 2) AS n_hex,
    count(*) FILTER (base AND verdict = 'live') AS n_live, count(*) FILTER (base AND verdict = 'copied') AS n_copied,
    string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind, b) FILTER (base) AS base_text, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind, b) AS spans
  FROM spans GROUP BY doc_id)
SELECT texts.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied, sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN by_doc ON by_doc.doc_id = texts.doc_id""",
    "op7_topk_search": """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE ((q.vec_id % 20) + 20) % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op9_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F\x{2000}-\x{206F}\x{3000}-\x{3003}\x{3008}-\x{3020}\x{A0}\x{A1}\x{AB}\x{B7}\x{BB}\x{BF}]+') AS w FROM documents WHERE text IS NOT NULL)),
item_words AS (
  SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS q FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F\x{2000}-\x{206F}\x{3000}-\x{3003}\x{3008}-\x{3020}\x{A0}\x{A1}\x{AB}\x{B7}\x{BB}\x{BF}]+') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) >= 5),
laid AS (
  SELECT doc_id, item_id, p - q AS shift, least(any_value(n), 10) AS least_words, list(q ORDER BY q) AS hits
  FROM doc_words JOIN item_words USING (word) GROUP BY doc_id, item_id, shift HAVING 100 * count(*) >= 80 * least(any_value(n), 10)),
ends AS (SELECT doc_id, item_id, shift, least_words, unnest(hits) AS q, unnest(range(len(hits))) AS k FROM laid),
stretches AS (
  SELECT a.doc_id, a.item_id, a.shift, a.q, b.q - a.q + 1 AS n_words, b.k - a.k + 1 AS n_same FROM ends a JOIN ends b USING (doc_id, item_id, shift)
  WHERE b.q >= a.q AND 100 * (b.k - a.k + 1) >= 80 * (b.q - a.q + 1) AND b.q - a.q + 1 >= a.least_words),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, shift, q) AS place FROM stretches)
SELECT doc_id, item_id, (q + shift)::INTEGER AS doc_start, q::INTEGER AS item_start, n_words::INTEGER AS n_words, n_same::INTEGER AS n_same FROM best WHERE place = 1""",
}
