"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.bpe import decode, encode
from framewright.llm.chat import format_turns, read_back
from framewright.llm.decontaminate import contaminated
from framewright.llm.exact_dedup import exact_duplicates
from framewright.llm.near_dedup import near_duplicates
from framewright.llm.packing import pack_documents
from framewright.llm.pitman_yor import score_texts
from framewright.llm.quality import fit_quality, quality
from framewright.llm.secrets import default_model, secrets
from framewright.llm.substring_dedup import remove_repeats
from framewright.llm.tables import read
from framewright.llm.toxicity import fit_toxicity, toxicity
from framewright.llm.variants import count_words, group_variants
from framewright.llm.whitening import whiten


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


#: A vocabulary file and its size, for texts that must be read back from ids.
CHAT_TOKENIZER, CHAT_RESERVED = "byte_bpe_50k.json", 50_257
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"), learn=F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets(docs, default_model(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    path = public_tokenizers.path(CHAT_TOKENIZER)
    return read_back(format_turns(rows, path, CHAT_RESERVED), path, CHAT_RESERVED)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_TOKENIZER)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encode(read(spark, sf_dir, "documents"), path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"), components=4)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(read(spark, sf_dir, "documents"), damaged_every=31))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_secrets": op2_secrets,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_bpe": op11_bpe,
    "op12_whitening": op12_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS passage FROM s),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY passage) AS first FROM x),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE first < doc_id),
        r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
        k AS (SELECT d.doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, n: NOT list_contains(gone, n)) END AS kept
              FROM d LEFT JOIN r USING (doc_id))
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed,
               sha256(array_to_string(kept, ' ')) AS kept_sha256
        FROM k
    """,
    "op5_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * inter >= 75 * (x.n_shingles + y.n_shingles - inter)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.v)
        SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS component_id FROM reach GROUP BY v) c ON c.v = d.doc_id
    """,
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op10_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        -- two characters more for each control string, one for each escape character
        marked AS (
            SELECT *, length(text) + length(free) - length(replace(free, chr(9243), ''))
                + 2 * list_sum(list_transform(
                    ['<|system|>', '<|user|>', '<|assistant|>', '<|role|>', '<|text|>', '<|end|>', '<|endoftext|>', '<|im_start|>',
                     '<|im_end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
                    lambda c: (length(free) - length(replace(free, c, ''))) // length(c)))
                + length(role) + CASE WHEN role IN ('system', 'user', 'assistant') THEN 4 + 7 ELSE 8 + 8 + 7 END AS shown
            FROM (SELECT *, text || chr(10) || CASE WHEN role IN ('system', 'user', 'assistant') THEN '' ELSE role END AS free FROM rows))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(shown)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
}
