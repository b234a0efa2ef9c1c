"""Registered queries of the operators, and their DuckDB twins where SQL can express them.

A query applies its operator, with production parameters, to a whole table and derives the
columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (langid, merkle, mixing, multiset_hash, packing, preference, quality_rules, simhash,
                          site_quality, url_rules, vector_graph, warc, whitening)

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """The public vocabulary file that the packing query takes its ids from."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), word_bpe())
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces)


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = site_quality.train(docs, table(spark, sf_dir, "labels"))
    return site_quality.judge(docs, model).select("doc_id", "evidence", "host_rate", "path_rate", "quality", "kept")


_RULES = quality_rules.RuleSettings()
_FENCE = f"""q75 + {_RULES.spread} * (q75 - q25) + CASE name {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _RULES.slack.items())} END"""
_QUARTILES = "count(*) AS n, list_sort(list(b))[(25 * count(*) + 99) // 100] AS q25, list_sort(list(b))[(75 * count(*) + 99) // 100] AS q75"


@query("op8_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
            FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM split WHERE len(ws) > 3)),
twice AS (SELECT r, unnest([i, i + 1, i + 2]) AS i
          FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM windows) WHERE k > 1),
repeated AS (SELECT r, count(DISTINCT i) AS n FROM twice GROUP BY r),
stats AS (
  SELECT s.r, doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines FROM split s LEFT JOIN repeated p ON p.r = s.r),
base AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed FROM stats),
cells AS (
  SELECT r, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS name,
         unnest([1, 2, 3, 4]) AS place,
         unnest([1000 * n_symbols // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1),
                 1000 * n_repeat_words // greatest(n_words, 1), 10 * word_chars // greatest(n_words, 1)]) AS v FROM base),
fed AS (SELECT *, least(v, 1000) AS b FROM cells WHERE NOT base_failed),
own AS (SELECT lang, source, name, n, {_FENCE} AS f FROM (SELECT lang, source, name, {_QUARTILES} FROM fed GROUP BY ALL)),
wide AS (SELECT lang, name, n, {_FENCE} AS f FROM (SELECT lang, name, {_QUARTILES} FROM fed GROUP BY ALL)),
whole AS (SELECT name, {_FENCE} AS f FROM (SELECT name, {_QUARTILES} FROM fed GROUP BY ALL)),
judged AS (
  SELECT c.r, string_agg(c.name, ',' ORDER BY place) FILTER (v > CASE WHEN o.n >= {_RULES.min_group} THEN o.f
           WHEN l.n >= {_RULES.min_group} THEN l.f ELSE a.f END) AS failed
  FROM cells c LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM c.lang AND o.source IS NOT DISTINCT FROM c.source AND o.name = c.name
  LEFT JOIN wide l ON l.lang IS NOT DISTINCT FROM c.lang AND l.name = c.name LEFT JOIN whole a ON a.name = c.name
  -- A group of which no row passes the base rule has no fence; its rows have failed anyway.
  WHERE o.n IS NOT NULL GROUP BY c.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM base LEFT JOIN judged USING (r)
""")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=simhash.SHINGLE, percent=None)
    return out.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    # A null id is in no fold, so it is not learned from.
    model = langid.learn(docs.where(~out))
    rows = docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text")
    return langid.identify(rows, model, ["doc_id", "held_out"])


@query("op6_document_fingerprints", f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
ordered AS (
  SELECT doc_id, t, n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx,
         row_number() OVER w AS r, count(*) OVER () AS total
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (SELECT *, substr(t, 1, n - n // 3) || substr(nx, 1, n // 3) AS e FROM ordered),
texts AS (SELECT r, 0 AS v, t AS x FROM edits UNION ALL SELECT r, 1, e FROM edits),
units AS (
  SELECT r, v, unnest(string_split(replace(replace(replace(x, '. ', '.' || chr(10)), '! ', '!' || chr(10)),
                                           '? ', '?' || chr(10)), chr(10))) AS p FROM texts),
digests AS (SELECT r, v, md5(p) AS h FROM units WHERE trim(p) <> ''),
lane AS (SELECT unnest(range({multiset_hash.LANES})) AS i),
sums AS (
  SELECT r, v, i, sum(2 * ((('0x' || substr(h, 8 * (i // 32) + 1, 8))::BIGINT >> (i % 32)::BIGINT) & 1) - 1) AS s
  FROM digests, lane GROUP BY ALL),
full_ AS (
  SELECT t.r, t.v, l.i, ((coalesce(s.s, 0) % 65536) + 65536) % 65536 AS s
  FROM (SELECT r, v FROM texts) t CROSS JOIN lane l LEFT JOIN sums s ON s.r = t.r AND s.v = t.v AND s.i = l.i),
prints AS (SELECT r, v, string_agg(printf('%04x', s::BIGINT), '' ORDER BY i) AS f FROM full_ GROUP BY ALL),
signed AS (SELECT r, v, i, CASE WHEN s >= 32768 THEN s - 65536 ELSE s END AS s FROM full_),
pairs AS (
  SELECT a.r, 'e' AS k, a.s AS x, b.s AS y FROM signed a JOIN signed b ON a.r = b.r AND a.i = b.i WHERE a.v = 0 AND b.v = 1
  UNION ALL
  SELECT a.r, 'n', a.s, b.s FROM signed a JOIN edits o ON o.r = a.r
  JOIN signed b ON b.r = o.r % o.total + 1 AND a.i = b.i WHERE a.v = 0 AND b.v = 0),
figures AS (
  SELECT r, k, sum(x * x) + sum(y * y) AS both_, sum(power(((x - y + 98304) % 65536) - 32768, 2)) AS apart
  FROM pairs GROUP BY ALL),
near AS (
  SELECT r, k, round(CASE WHEN both_ = 0 THEN 1.0 ELSE least(1.0, greatest(0, both_ - apart) / both_) END, 6) AS x FROM figures)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.e) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
       c.x AS near_edited, g.x AS near_next
FROM edits e JOIN prints a ON a.r = e.r AND a.v = 0 JOIN prints b ON b.r = e.r AND b.v = 1
JOIN near c ON c.r = e.r AND c.k = 'e' JOIN near g ON g.r = e.r AND g.k = 'n'
""")
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multiset_hash.compare_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", multiset_hash.as_text(F.col("own")).alias("fingerprint"),
                      multiset_hash.as_text(F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next")


#: The rules that the contract of the query fixes: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query("op1_url_filters", f"""
WITH rules(h, p, v) AS (VALUES {_VALUES}),
rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
bare AS (SELECT page_id, split_part(split_part(coalesce(r, ''), '?', 1), '#', 1) AS b FROM rest),
parts AS (
  SELECT row_number() OVER () AS k, page_id, translate(split_part(b, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, substr(b, length(split_part(b, '/', 1)) + 1) AS path FROM bare),
hits AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN hits USING (k)
""")
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)\
        .select("page_id", "host", "path", "rule", "verdict")


@query("op5_chat_formatting", """
WITH marked AS (
  SELECT *, coalesce(role = 'assistant', false) AND row_number() OVER (
           PARTITION BY conv_id ORDER BY coalesce(role = 'assistant', false) DESC, turn DESC NULLS LAST, coalesce(text, '') DESC) = 1 AS answer
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM marked WHERE answer),
sides AS (
  SELECT conv_id AS pair_id, side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM marked, (VALUES ('chosen'), ('rejected')) v(side) WHERE NOT answer
  UNION ALL SELECT conv_id, 'chosen', turn, 'assistant', text FROM last
  UNION ALL SELECT a.conv_id, 'rejected', a.turn, 'assistant', b.text FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS LAST, role, text) AS p FROM sides),
apart AS (
  SELECT pair_id, coalesce(min(p) FILTER (role IS DISTINCT FROM role_1 OR text IS DISTINCT FROM text_1), max(p) + 1) - 1 AS n
  FROM (SELECT pair_id, p, role, text FROM placed WHERE side = 'chosen') c
  FULL JOIN (SELECT pair_id, p, role AS role_1, text AS text_1 FROM placed WHERE side = 'rejected') r USING (pair_id, p) GROUP BY pair_id),
shown AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS t FROM placed JOIN apart USING (pair_id)),
after AS (
  SELECT *, sum(length(t)) OVER (PARTITION BY pair_id, side ORDER BY p) - length(t) AS at FROM shown WHERE p > n),
rest AS (
  SELECT pair_id, side, count(*) AS turns, string_agg(t, '' ORDER BY p) AS body,
         string_agg((at + length(role) + 5)::BIGINT || ':' || (at + length(t))::BIGINT, ',' ORDER BY p) FILTER (role = 'assistant') AS mask
  FROM after GROUP BY pair_id, side),
prompts AS (SELECT pair_id, count(*) AS turns, string_agg(t, '' ORDER BY p) AS body FROM shown WHERE side = 'chosen' AND p <= n GROUP BY 1)
SELECT a.pair_id, coalesce(p.turns, 0)::INTEGER AS prompt_turns, coalesce(p.body, '') AS prompt,
       coalesce(c.turns, 0)::INTEGER AS chosen_turns, coalesce(c.body, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
       coalesce(r.turns, 0)::INTEGER AS rejected_turns, coalesce(r.body, '') AS rejected, coalesce(r.mask, '') AS rejected_mask,
       (c.turns IS NOT NULL OR r.turns IS NOT NULL) AS differs
FROM apart a LEFT JOIN prompts p USING (pair_id) LEFT JOIN rest c ON c.pair_id = a.pair_id AND c.side = 'chosen'
LEFT JOIN rest r ON r.pair_id = a.pair_id AND r.side = 'rejected'
""")
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.swapped_answers(table(spark, sf_dir, "conversations"))
    out = preference.format_preferences(turns)
    spans = lambda m: F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(m)
    return out.select("pair_id", "prompt_turns", "prompt", "chosen_turns", "chosen", spans("chosen_mask"),
                      "rejected_turns", "rejected", spans("rejected_mask"), "differs")


@query("op7_warc_revisits", """
WITH d AS (
  SELECT page_id, encode(coalesce(html, '')) AS p, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM d WHERE octet_length(p) >= 100 GROUP BY h)
SELECT page_id, octet_length(p)::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (h)
""")
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.embeddings(table(spark, sf_dir, "embeddings"))


#: Levels that the twin of the manifest can reach: 3^12 documents a source, 3^5 sources.
_LEVELS, _TOP_LEVELS = 12, 5


def _climb(name: str, leaves: str, levels: int) -> str:
    """CTEs with the nodes of every level of trees: name0 is ``leaves`` (tree, n, rank, digest)."""
    steps = [f"{name}0 AS ({leaves})"]
    for i in range(levels):
        steps.append(f"""{name}{i + 1} AS (
  SELECT tree, (n + 2) // 3 AS n, rank // 3 AS rank, sha256(string_agg(digest, '' ORDER BY rank)) AS digest
  FROM {name}{i} WHERE n > 1 GROUP BY tree, n, rank // 3
  UNION ALL SELECT tree, n, rank, digest FROM {name}{i} WHERE n = 1)""")
    return ",\n".join(steps)


def _walk(name: str, nodes: str, start: str, levels: int) -> str:
    """CTEs that fold (key, tree, rank, proof, folded) through all levels."""
    steps = [f"{name}0 AS ({start})"]
    for i in range(levels):
        steps.append(f"""{name}{i + 1} AS (
  SELECT w.key, w.tree, CASE WHEN any_value(s.n) > 1 THEN w.rank // 3 ELSE w.rank END AS rank,
         any_value(w.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.rank) FILTER (s.n > 1 AND s.rank <> w.rank), '') AS proof,
         CASE WHEN any_value(s.n) > 1 THEN sha256(string_agg(CASE WHEN s.rank = w.rank THEN w.folded ELSE s.digest END, '' ORDER BY s.rank))
              ELSE any_value(w.folded) END AS folded
  FROM {name}{i} w JOIN {nodes}{i} s ON s.tree = w.tree AND s.rank // 3 = w.rank // 3
  GROUP BY w.key, w.tree, w.rank)""")
    return ",\n".join(steps)


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"


_HEAD = " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars"))


@query("op12_merkle_manifest", f"""
WITH d AS (
  SELECT doc_id, source, {_HEAD} AS head, text,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
             lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS inverted FROM documents),
leaf AS (
  SELECT doc_id, source, sha256(head || {_field("text")}) AS digest,
         CASE WHEN xor(inverted, 4294967295) % 2 = 0 THEN sha256(head || {_field("replace(text, chr(10), '')")}) END AS other FROM d),
place AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER () AS key FROM leaf),
{_climb("own", "SELECT tree, n, rank, digest FROM place", _LEVELS)},
{_climb("top", f"SELECT 0 AS tree, count(*) OVER () AS n, tree AS rank, digest FROM own{_LEVELS}", _TOP_LEVELS)},
{_walk("low", "own", "SELECT key, tree, rank, '' AS proof, coalesce(other, digest) AS folded FROM place", _LEVELS)},
{_walk("high", "top", f"SELECT key, 0 AS tree, tree AS rank, proof, folded FROM low{_LEVELS}", _TOP_LEVELS)}
SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(h.proof) AS proof_sha256,
       h.folded AS folded_root, h.folded = r.digest AS verified
FROM place p JOIN own{_LEVELS} s USING (tree) JOIN high{_TOP_LEVELS} h USING (key) CROSS JOIN top{_TOP_LEVELS} r
""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = merkle.verify(table(spark, sf_dir, "documents"), even, F.replace("text", F.lit("\n"), F.lit("")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")).alias("proof_sha256"),
                      "folded_root", "verified")


@query("op13_nearest_neighbours")
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
