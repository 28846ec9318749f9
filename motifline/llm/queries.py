"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.llm import ann, chat, decontam, linkgraph, lm, neardup, packing, pii, quality, tokencount
from motifline.session import few_tasks, ship

#: Names of public tokenizer files; a path can be given to the operators instead.
WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
#: The key of the registered surrogate query; a deployment passes its own.
SURROGATE_KEY = b"motifline-demonstration-key"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ESCAPE_PROBE = "\\### Assistant: </turn> ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", ESCAPE_PROBE), (-7, 1, "assistant", ESCAPE_PROBE)], turns.schema)
    back = chat.read_back(chat.format_conversations(turns.unionByName(probe)))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select(
        "conv_id",
        F.size("turns").alias("n"),
        F.char_length("formatted").cast("bigint").alias("chars"),
        F.struct("window", text.alias("text"), F.array_join("losses", "").alias("loss")).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    joined = {c: F.array_join(F.transform("parts", lambda p: p[c]), "") for c in ("text", "loss")}
    return whole.select(
        "conv_id",
        F.col("n").cast("bigint").alias("n_turns"),
        F.sha2(joined["text"], 256).alias("turns_sha256"),
        F.char_length(joined["loss"]).cast("bigint").alias("loss_chars"),
        F.sha2(joined["loss"], 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
        F.size("parts").cast("bigint").alias("n_windows"),
    )


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') || ': '
             || replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') || '</turn>' || chr(10) AS piece FROM c),
t AS (SELECT *, row_number() OVER w AS pos, (strlen(piece) + 3) // 4 AS size FROM e
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(size) OVER o - size AS before, max(CASE WHEN pos = 1 AND role = 'system' AND size <= 512 THEN size END) OVER c AS kept,
      max(CASE WHEN size <= 512 THEN size ELSE 0 END) OVER c AS longest2, max(CASE WHEN size <= 256 THEN size ELSE 0 END) OVER c AS longest4,
      count(*) FILTER (size > 512) OVER o - (size > 512)::INT AS over2, count(*) FILTER (size > 256) OVER o - (size > 256)::INT AS over4
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY pos), c AS (PARTITION BY conv_id)),
k AS (SELECT *, CASE WHEN kept IS NULL THEN 2 * ((before + 1024 * over2) // (1025 - longest2)) + (size > 512)::INT
                     ELSE 2 * ((before + 1024 * over4) // (1025 - kept - longest4)) + (size > 256)::INT END AS win FROM p),
f AS (SELECT conv_id, win, min(pos) AS fp, min(before) AS start, 1024 - sum(size) - coalesce(max(kept), 0) AS space FROM k GROUP BY ALL),
again AS (SELECT f.conv_id, sum(length(r.piece)) AS chars FROM f JOIN k r ON r.conv_id IS NOT DISTINCT FROM f.conv_id
          AND r.pos < f.fp AND ((r.pos = 1 AND r.kept IS NOT NULL) OR (r.pos >= f.fp - 2 AND f.start - r.before <= f.space)) GROUP BY ALL),
s AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos), '') AS loss,
             sum(length(piece)) AS chars, count(DISTINCT win) AS n_windows FROM k GROUP BY ALL)
SELECT s.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(s.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars, n_windows
FROM s LEFT JOIN again ON again.conv_id IS NOT DISTINCT FROM s.conv_id
"""


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def quality_model(spark: SparkSession, sf_dir: str):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.fit(docs, labels, quality.rating(), 2)


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = quality.grade_documents(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), ["doc_id"])
    return graded.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("p_tail").alias("p_good"), "accepted")


def packed(docs: DataFrame, capacity: int = 2048, cached: int = 125_000) -> DataFrame:
    pieces = packing.tokenize_pieces(docs, tokenizer_path(WORD_TOKENIZER), capacity, cached=cached)
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.assign_sequences(digest, capacity).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed(few_tasks(docs, docs.count()), cached=250_000)


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    found = found.withColumn("n_hit", decontam.n_hit(F.col("spans")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.transform("items", lambda i: i.cast("string")), ","), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


_OP5_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP5_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP5_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
h AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
      FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
x AS (SELECT h.r, h.i, h.m, p.item_id FROM h JOIN p ON p.m = h.m AND p.s = h.s),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM x) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM x WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN o USING (r)
"""


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept"
    )


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY, ["doc_id"])
    of = lambda t: F.size(F.filter("entities", lambda e: e["type"] == t)).cast("bigint").alias(f"n_{t}")
    counts = [of(t) for t in pii.TYPES]
    return found.select("doc_id", F.col("clean_text").alias("text"), F.size("entities").cast("bigint").alias("n_entities"), *counts)


def op8_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = linkgraph.judge_pages(table(spark, sf_dir, "pages"))
    return judged.withColumnRenamed("id", "page_id").select("page_id", "host", "path", "rule", "verdict")


def _op8_sql(rounds: int = 160, damping: float = 0.85) -> str:
    """Flows of each round until none is above the tolerance; after ``rounds`` 0.85 ** 160 of a seed would be under way."""
    rest = r"CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^([^?#]*)', 1) ELSE '' END"
    lower = f"'{linkgraph.UPPER}', '{linkgraph.LOWER}'"
    link = linkgraph.LINK.replace("'", "''")
    steps = []
    for name, a, b in (("trust", "a", "b"), ("wrong", "b", "a")):
        kind = "allow" if name == "trust" else "block"
        steps.append(f"{name}_out AS MATERIALIZED (SELECT {a} AS a, {b} AS b, {damping} / count(*) OVER (PARTITION BY {a}) AS pass FROM links)")
        steps.append(
            f"{name}_flow(k, host, score) AS (SELECT 0, host, CAST({kind}ed AS DOUBLE) FROM hosts WHERE {kind}ed > 0 UNION ALL "
            f"SELECT k + 1, l.b, sum(s.score * l.pass) FROM {name}_flow s JOIN {name}_out l ON l.a = s.host WHERE k < {rounds} GROUP BY k + 1, l.b HAVING sum(s.score * l.pass) > 1e-12)"
        )
        steps.append(f"{name}_final AS (SELECT host, sum(score) AS score FROM {name}_flow GROUP BY host)")
    rules = sorted(linkgraph.RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(k, h, p)}'" for k, h, p in rules) + " END"
    return f"""
WITH RECURSIVE r AS (SELECT page_id, html, {rest} AS rest FROM (SELECT page_id, html, coalesce(url, '') AS url FROM pages)),
p AS (SELECT page_id, html, translate(split_part(rest, '/', 1), {lower}) AS host,
             CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM r),
j AS (SELECT *, {case(lambda k, h, p: h + p)} AS rule, {case(lambda k, h, p: k)} AS ruled FROM p),
links AS (SELECT DISTINCT a, b FROM (SELECT host AS a, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), {lower}) AS b FROM j WHERE host <> '') WHERE a <> b),
hosts AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM j WHERE host <> '' GROUP BY host),
{", ".join(steps)}
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(x.score, 0) - coalesce(t.score, 0) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN trust_final t ON t.host = j.host LEFT JOIN wrong_final x ON x.host = j.host
"""


def op9_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER)).withColumnRenamed("id", "doc_id")


def op10_unigram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), ["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_windows": op1_chat_windows,
        "op2_multiprobe_neighbours": op2_multiprobe_neighbours,
        "op3_ordinal_quality": op3_ordinal_quality,
        "op4_bin_completion": op4_bin_completion,
        "op5_wu_manber": op5_wu_manber,
        "op6_lsh_forest": op6_lsh_forest,
        "op7_surrogates": op7_surrogates,
        "op8_host_trust": op8_host_trust,
        "op9_attention_scores": op9_attention_scores,
        "op10_unigram_tokens": op10_unigram_tokens,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_windows": OP1_SQL, "op5_wu_manber": OP5_SQL, "op6_lsh_forest": OP6_SQL, "op8_host_trust": _op8_sql()}
