"""Queries of the training-data operators: thin digests of what each operator returns, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import brown, decontaminate, html_text, imatch, mixing, negatives, quality, sharding, simhash, substrings, tokens, trie, urls
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_url_filter(spark, d) -> DataFrame:
    """Op 1: verdict and rule of every page's URL."""
    return urls.judge(table(spark, d, "pages"))


def op2_simhash(spark, d) -> DataFrame:
    """Op 2: fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, d, "documents"))


def op3_decontaminate(spark, d) -> DataFrame:
    """Op 3: words, hits and items of every document."""
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op4_sharding(spark, d) -> DataFrame:
    """Op 4: place of every document in the written shards."""
    return sharding.shard_report(table(spark, d, "documents"))


def op5_quality(spark, d) -> DataFrame:
    """Op 5: quality score of every document."""
    docs = table(spark, d, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, d, "labels")))


def op6_brown(spark, d) -> DataFrame:
    """Op 6: class-model and base score of every document."""
    return brown.scores(table(spark, d, "documents"))


def op7_tokens(spark, d) -> DataFrame:
    """Op 7: every document as decoded from the written token files."""
    return tokens.token_report(tokens.write_tokens(table(spark, d, "documents"), public_tokenizers.path(TOKENIZER)))


def op8_mixing(spark, d) -> DataFrame:
    """Op 8: words the mix takes of every document."""
    return mixing.mix_report(table(spark, d, "documents"))


def op9_html(spark, d) -> DataFrame:
    """Op 9: main text of every page."""
    return html_text.main_text(table(spark, d, "pages"))


def op10_imatch(spark, d) -> DataFrame:
    """Op 10: fingerprints of every document and its edited text."""
    return imatch.near_report(table(spark, d, "documents"))


def op11_negatives(spark, d) -> DataFrame:
    """Op 11: hard negatives of every anchor (vec_id divisible by 100) and positive; where vec_id is divisible by 7 the label is the next one."""
    rows = table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_trie(spark, d) -> DataFrame:
    """Op 12: nodes of the prefix trie of all rebuilt conversations."""
    return trie.rebuilt_nodes(table(spark, d, "conversations"))


def op13_substrings(spark, d) -> DataFrame:
    """Op 13: words of every document that also occur, 13 in a row, in a document of a smaller id."""
    return substrings.repeat_report(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_decontaminate, op4_sharding, op5_quality, op6_brown, op7_tokens, op8_mixing, op9_html, op10_imatch, op11_negatives, op12_trie, op13_substrings)}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The other operators rest on trained models, XXH64, seeded draws or a tokenizer; tests/llm holds them against brute force.
ORACLE = {
    "op3_decontaminate": f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: w[p:p + 9])) AS win FROM items WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: {{'p': p, 'win': w[p:p + n - 1]}})) AS x FROM docs, lens WHERE len(w) >= n),
hits AS (SELECT r, x.p AS p, n, item_id FROM places JOIN wins ON wins.win = places.x.win),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
          FROM hits GROUP BY r),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN found USING (r) LEFT JOIN covered USING (r)""",
    "op11_negatives": """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, a.lab = r.lab AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
      FROM v a JOIN v r ON a.id <> r.id AND a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_trie": """
WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
           FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, list(x ORDER BY p) AS own FROM t GROUP BY c),
crc AS (SELECT c, own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
          lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 9 AS h FROM convs),
built AS (SELECT crc.c, list_concat(coalesce(b.own[1:h], []), crc.own[h + 1:]) AS s FROM crc LEFT JOIN convs b ON b.c = crc.c - crc.c % 5),
m AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS depth FROM built),
node AS (SELECT depth, s[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
up AS (SELECT *, CASE WHEN depth > 0 THEN path[1:depth - 1] END AS parent, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(path[depth].t) ELSE 0 END AS saved FROM node),
kids AS (SELECT parent AS path, depth - 1 AS depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids USING (depth, path)),
sub AS (SELECT d AS depth, path[1:d] AS path, saved, n_children FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS d FROM full_node)),
total AS (SELECT depth, path, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM sub GROUP BY ALL)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, total.n_leaves, total.saved_tokens, f.ends_sha256
FROM full_node f JOIN total USING (depth, path) LEFT JOIN node q ON q.depth = f.depth - 1 AND q.path = f.parent""",
    "op13_substrings": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
wins AS (SELECT r, doc_id, p, w[p:p + 12] AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE doc_id IS NOT NULL)),
again AS (SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY x) AS first FROM wins) WHERE first < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS q FROM again),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS x FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
}
