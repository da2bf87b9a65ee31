"""One query per operator of this subpackage; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagekit.llm import (
    binary, codes, fm, licences, pack, phrases, quotes, rules, runs, simhash, templates, toxic, words,
)
from triagekit.sources.store import new_path

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

# Production parameters.
SEQUENCE, PACK_END, FILE_END = 2048, 1, 2
QUALITY_AT, TOXIC_AT = 0.5, 0.3
QUALITY_FOLDS, QUALITY_HELD = 3, 1
TOXIC_FOLDS, TOXIC_HELD = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    return pack.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), SEQUENCE, PACK_END)


def op2_quality_rules(spark, sf_dir):
    return rules.quality_verdicts(table(spark, sf_dir, "documents"))


def as_mail(turns: DataFrame) -> DataFrame:
    """Conversations as mail: each turn quotes the turn before it, with what that one quotes, above its text.

    Of turns that share a name, the least text is the one that others quote.
    """

    def marked(text: str, marker: str) -> F.Column:
        return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit(marker), x)), "\n")

    texts = turns.select("conv_id", "turn", "text")

    def before(n: int) -> DataFrame:
        later = texts.select("conv_id", (F.col("turn") + n).alias("turn"), "text")
        return later.groupBy("conv_id", "turn").agg(F.min("text").alias(f"before_{n}"))

    return (
        texts.join(before(1), ["conv_id", "turn"], "left")
        .join(before(2), ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.concat_ws("\n", marked("before_2", "> > "), marked("before_1", "> "), "text").alias("text"))
    )


def op3_quotation_linking(spark, sf_dir):
    found = quotes.reply_conversations(as_mail(table(spark, sf_dir, "conversations")))
    return found.select(*[c for c in found.columns if c != "own_text"], F.md5("own_text").alias("own_md5"))


def op4_phrase_fingerprints(spark, sf_dir):
    return phrases.compare_with_edited(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_each=3, radius=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_files(spark, sf_dir):
    folder = new_path(spark, "token-files")
    binary.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), FILE_END)
    return binary.read_digests(spark, folder)


def op7_licences(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op8_word_bpe(spark, sf_dir):
    return words.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_toxicity(spark, sf_dir):
    fold = fm.crc32_of("doc_id") % TOXIC_FOLDS
    docs = table(spark, sf_dir, "documents")
    model = toxic.fit_toxicity(docs, table(spark, sf_dir, "labels"), fold != TOXIC_HELD)
    return toxic.toxicity(docs, model).select(
        "doc_id", (fold == TOXIC_HELD).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
        "n_offending", "worst_start", "worst_end",
    )


def op10_quality_classifier(spark, sf_dir):
    fold = fm.crc32_of("doc_id") % QUALITY_FOLDS
    docs = table(spark, sf_dir, "documents")
    machine = fm.fit_quality(docs, table(spark, sf_dir, "labels"), fold != QUALITY_HELD)
    scored = docs.select("doc_id", fm.quality_score(docs, machine).alias("score"))
    return scored.select(
        "doc_id", (fold == QUALITY_HELD).alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted")
    )


#: Verdicts for hosts with their subdomains, and paths that start like this.
URL_RULES = [
    templates.Rule(templates.BLOCK, "net"), templates.Rule(templates.ALLOW, "example.net", "/en/"),
    templates.Rule(templates.BLOCK, "example.com", "/de/"), templates.Rule(templates.ALLOW, "org", "/fr/"),
]


def op11_url_templates(spark, sf_dir):
    return templates.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In one document of ten, by the digest of its id, the words from a certain one on repeat with a period."""
    digest = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not words or digest % 10:
        return words
    n, g = len(words), digest // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark, sf_dir):
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), planted_period)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("longest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * longest.length DIV longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark, sf_dir):
    coded = codes.compress_vectors(table(spark, sf_dir, "embeddings"), codes.PARTS, codes.ENTRIES, codes.ROUNDS)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_phrase_fingerprints": op4_phrase_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_token_files": op6_token_files,
    "op7_licences": op7_licences,
    "op8_word_bpe": op8_word_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_url_templates": op11_url_templates,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}
