"""The queries of this subpackage, by the names under which ``__spark_entry__`` registers them."""

from __future__ import annotations

import os
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytebasin.llm import chat, common, decontaminate, embedding_dedup, fingerprints, lexical_search, line_dedup, merkle, ngram_join, pii, sentencepieces, token_counts, token_output, toxicity

#: Where the public tokenizers' files lie; another folder by this variable.
TOKENIZERS = os.environ.get("BYTEBASIN_TOKENIZERS", "")


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.limit_arrow_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "text", "removed_lines")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.with_toxicity(docs, model)
    score = F.col("toxicity.score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("toxicity.passages").cast("long").alias("n_passages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.digests(found.select("doc_id", "hits"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, tokenizer_file("word_bpe_49k.json")).drop("text")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = common.shared_folder(spark, "token-ids")
    manifest = token_output.write_token_shards(docs, folder, tokenizer_file("word_bpe_49k.json"))
    return token_output.read_token_shards(spark, folder, manifest)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbour_likeness(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_personal_data(docs).select("doc_id", "pii")

    def of(*kinds: str) -> Column:
        return F.filter("pii", lambda s: s["kind"].isin(*kinds))

    counts = {f"n_{k}": F.size(of(k)).cast("long") for k in pii.BASE}
    base = of(*pii.BASE)
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",")
    digests = {"base_sha256": F.sha2(pii.joined(base), 256), "spans": pii.joined(F.col("pii")), "scores": scores, "n_spans": F.size("pii").cast("long")}
    return found.select("doc_id", *[c.alias(n) for n, c in (counts | digests).items()])


def _as_log(rows: DataFrame) -> DataFrame:
    """Turns as the events that a chat service would have logged of them: whole messages, messages with a streamed rest,
    messages edited or regenerated later. Turns that are there twice stay whole messages."""
    turn, text = F.col("turn"), F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest, draft = F.left(text, half), F.substr(text, half + 1), F.reverse(text)
    alone = F.count("*").over(Window.partitionBy("conv_id", "turn")) == 1

    def event(k: int, kind: str, said: Column) -> Column:
        return F.struct((turn * 3 + k).cast("long").alias("seq"), F.lit(kind).alias("kind"), said.alias("said"))

    message = F.array(event(0, chat.MESSAGE, text))
    streamed = F.array(event(0, chat.MESSAGE, first), event(1, chat.DELTA, rest))
    edited = F.array(event(0, chat.MESSAGE, draft), event(1, chat.EDIT, text))
    again = F.array(event(0, chat.MESSAGE, draft), event(1, chat.REGENERATE, first), event(2, chat.DELTA, rest))
    kind = F.pmod(F.coalesce(turn, F.lit(0)), F.lit(4))
    events = F.when(~F.col("alone") | (kind == 0), message).when(kind == 1, streamed).when(kind == 2, edited).otherwise(again)
    return rows.withColumn("alone", alone).select("conv_id", "turn", "role", F.inline(events)).withColumnRenamed("said", "text")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    events = _as_log(rows.unionByName(more))
    formatted = chat.format_events(events)
    back = chat.read_back(formatted.withColumn("conv_id", F.struct("conv_id", F.length("formatted").cast("long").alias("chars"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        F.col("conv_id.conv_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.col("conv_id.chars").alias("formatted_chars"),
    )


def op10_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.with_piece_digests(docs, tokenizer_file("piece_bpe_32k.model")).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    later = merkle.digest(*[altered if c == "text" else F.col(c) for c in merkle.FIELDS])
    rows = merkle.verified(merkle.manifest(docs, keep={"later": later}), "later")
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_token_output": op6_token_output,
    "op7_fingerprints": op7_fingerprints,
    "op8_pii": op8_pii,
    "op9_chat": op9_chat,
    "op10_sentencepieces": op10_sentencepieces,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_embedding_dedup": op13_embedding_dedup,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT s.doc_id, s.i, s.n, x.item FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM spots) s JOIN windows x ON x.n = s.n AND x.gram = s.gram),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(owners.n_items, 0) AS n_items, sha256(coalesce(owners.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN owners ON owners.doc_id = d.doc_id""",
    "op9_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)')) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
}


def _leaf(*fields: str) -> str:
    said = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in fields]
    return f"sha256({' || '.join(said)})"


_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"
_STEP = """SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
FROM {0} a JOIN {0} b ON a.tree = b.tree AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.m > 1 GROUP BY a.tree, a.level, a.i"""
_ABOVE = "SELECT tree, level + 1, p, h, count(*) OVER (PARTITION BY tree) FROM (SELECT tree, level, i // 8 AS p, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {0} WHERE m > 1 GROUP BY tree, level, i // 8)"

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf, {_leaf('doc_id', 'source', 'lang', 'n_chars', 'altered')} AS later
  FROM (SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS altered FROM documents)),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
nodes AS (SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS m FROM p UNION ALL {_ABOVE.format('nodes')}),
ranked AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS t FROM nodes WHERE m = 1),
tops AS (SELECT '' AS tree, 0 AS level, t AS i, h, count(*) OVER () AS m FROM ranked UNION ALL {_ABOVE.format('tops')}),
steps AS ({_STEP.format('nodes')}), over AS ({_STEP.format('tops')}),
ways AS (SELECT p.tree, p.i, level, l, r FROM p JOIN steps s ON s.tree = p.tree AND s.i = p.i // CAST(8 ** s.level AS BIGINT)
  UNION ALL SELECT p.tree, p.i, 100 + level, l, r FROM p JOIN ranked k ON k.tree = p.tree JOIN over o ON o.i = k.t // CAST(8 ** o.level AS BIGINT)),
paths AS (SELECT tree, i, list(l || '|' || r ORDER BY level) AS path FROM ways GROUP BY tree, i),
folded AS (SELECT doc_id, leaf, k.h AS subroot, (SELECT h FROM tops WHERE m = 1) AS root, coalesce(path, []) AS path, list_reduce(coalesce(path, []), lambda c, s: sha256(split_part(s, '|', 1) || c || split_part(s, '|', 2)), later) AS folded_root
  FROM p JOIN ranked k ON k.tree = p.tree LEFT JOIN paths w ON w.tree = p.tree AND w.i = p.i)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""

ORACLES["op12_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), z AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM z),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, docs),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN z USING (r), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

ORACLES["op13_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT r, vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r, b.r AS other, b.vec_id AS other_id FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r, r AS other, vec_id AS other_id FROM v UNION SELECT reach.r, l.other, l.other_id FROM reach JOIN links l ON l.r = reach.other),
parts AS (SELECT r, min(other_id) AS component_id FROM reach GROUP BY r), n AS (SELECT r, count(*) AS n_links FROM links GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN parts USING (r) LEFT JOIN n USING (r)"""

ORACLES["op2_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS grams FROM d),
k AS (SELECT r, doc_id, CASE WHEN len(grams) > 0 THEN md5(array_to_string(grams, '|')) END AS node, grams FROM g),
n AS (SELECT node, any_value(grams) AS grams, min(doc_id) AS least, count(*) AS n_copies FROM k WHERE node IS NOT NULL GROUP BY node),
x AS (SELECT node, len(grams) AS size, unnest(grams) AS gram FROM n),
p AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.gram = b.gram AND a.node <> b.node GROUP BY a.node, b.node, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
reach AS (SELECT node, node AS other FROM n UNION SELECT reach.node, p.b FROM reach JOIN p ON p.a = reach.other),
c AS (SELECT reach.node, min(least) AS class_id FROM reach JOIN n ON n.node = reach.other GROUP BY reach.node), l AS (SELECT a AS node, count(*) AS n_links FROM p GROUP BY a)
SELECT doc_id, CASE WHEN k.node IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM k LEFT JOIN n ON n.node = k.node LEFT JOIN c ON c.node = k.node LEFT JOIN l ON l.node = k.node"""
