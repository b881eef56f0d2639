"""Registered queries opN_<name> of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (chat, graph, langid, lexical, mixing, packing, quality, repair, simhash, suffix, superkmer,
                          token_files, urls)
from riskloom.llm import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ 1 near duplicates by SimHash

@register("op1_simhash")
def op1_simhash(spark, sf_dir):
    return simhash.simhash_classes(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


# ------------------------------------------------------------------ 2 url filters

URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block"))


@register("op2_url_filters", S.URL_FILTERS)
def op2_url_filters(spark, sf_dir):
    values = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


# ------------------------------------------------------------------ 3 chat formatting

@register("op3_chat_formatting", S.CHAT_FORMATTING)
def op3_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"))
    df = turns.unionByName(probe).withColumn("parts", chat.text_parts(F.col("text")))
    df = chat.format_conversations(df)
    df = df.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("read"),
                   chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                     F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                     F.length("formatted").cast("long").alias("formatted_chars"))


# ------------------------------------------------------------------ 4 packing

@register("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), capacity=4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# ------------------------------------------------------------------ 5 suffix arrays

@register("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    done = suffix.removed_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------------------ 6 substrings

@register("op6_substring_dedup", S.SUBSTRING_DEDUP)
def op6_substring_dedup(spark, sf_dir):
    done = superkmer.remove_repeated(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------------------ 7 embeddings

@register("op7_embedding_dedup")
def op7_embedding_dedup(spark, sf_dir):
    classes = graph.embedding_classes(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return classes.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


# ------------------------------------------------------------------ 8 mixing

@register("op8_mixing")
def op8_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, weights=(1, 2, 3), cap=3)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


# ------------------------------------------------------------------ 9 binary token files

@register("op9_token_files")
def op9_token_files(spark, sf_dir):
    return token_files.write_and_digest(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 10 quality rules

@register("op10_quality_rules", S.QUALITY_RULES)
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select(
        "doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


# ------------------------------------------------------------------ 11 ranked search

@register("op11_ranked_search", S.RANKED_SEARCH)
def op11_ranked_search(spark, sf_dir):
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


# ------------------------------------------------------------------ 12 languages

@register("op12_language_id")
def op12_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kept_out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~kept_out))
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(kept_out, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


# ------------------------------------------------------------------ 13 conversation repair

def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the faults that the query repairs, drawn by the crc32 of ``conv_id:turn``."""
    blank = F.lit(" ")
    draw = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), draw.alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("again")).drop("again")


@register("op13_conversation_repair", S.CONVERSATION_REPAIR)
def op13_conversation_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair.Repair(damaged(given))
    lines = fixed.turns.groupBy("key").agg(F.sort_array(F.collect_list(
        F.struct("block", "edit", F.concat("role", F.lit(":"), "text").alias("line")))).alias("lines"))
    lines = lines.select("key", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("repaired_sha256"))
    report = fixed.report.withColumn("key", repair.conversation_key(F.col("conv_id"))).drop("conv_id")
    every = given.select("conv_id", repair.conversation_key(F.col("conv_id")).alias("key")).distinct()
    out = every.join(report, "key", "left").join(lines, "key", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
