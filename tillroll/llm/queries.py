"""The registered queries opN_<name>: each operator, with its production
parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    decontaminate, exact_dedup, hard_negatives, langid, license_scan, mixing, oracles, periodic_runs, pii, quality_lines, secret_scan,
    simhash, substring_dedup, token_counts,
)
from tillroll.llm.text import computed_once, n_words, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op1_quality_lines")
def op1_quality_lines(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    field = quality_lines.fit_line_field(
        quality_lines.training_lines(docs, read_table(spark, sf_dir, "labels")))
    return quality_lines.line_quality(docs, [F.col("doc_id")], F.col("text"), field)


@register("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    import public_tokenizers  # vocabulary files installed on every machine
    return token_counts.token_counts(
        read_table(spark, sf_dir, "documents"), [F.col("doc_id")], F.col("text"),
        public_tokenizers.path("byte_bpe_50k.json"), 512)


@register("op2_license_scan", oracles.license_scan_sql())
def op2_license_scan(spark, sf_dir):
    # The tree of the corpus: source/language/document.
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return license_scan.licences(read_table(spark, sf_dir, "documents"), F.col("doc_id"), path,
                                 F.col("text")).withColumnRenamed("id", "doc_id")


@register("op3_secret_scan", oracles.secret_scan_sql())
def op3_secret_scan(spark, sf_dir):
    found = secret_scan.secret_spans(
        read_table(spark, sf_dir, "documents"), [F.col("doc_id")], F.col("text"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"),
                        secret_scan.span_list(F.col("spans")).alias("spans"))


@register("op4_substring_dedup", oracles.substring_dedup_sql())
def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.without_repeats(
        read_table(spark, sf_dir, "documents"), [F.col("doc_id")], F.col("doc_id"), F.col("text"),
        window=50).select("doc_id", "n_words", "n_removed",
                          F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op5_pii_pseudonyms")
def op5_pii_pseudonyms(spark, sf_dir):
    out = pii.pseudonymise(read_table(spark, sf_dir, "documents"), [F.col("doc_id")], F.col("text"),
                           key="tillroll-demo-key")
    kinds = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", "text", "n_found", *kinds)


def _of_kind(kind):
    return lambda f: f["kind"] == kind


@register("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit_language_model(docs)
    return langid.language_id(
        docs, [F.col("doc_id"), langid.held_out(F.col("doc_id")).alias("held_out")],
        F.col("text"), model)


@register("op8_benchmark_decontamination")
def op8_benchmark_decontamination(spark, sf_dir):
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contaminated(docs, F.col("doc_id"), F.col("text"),
                                      items, F.col("item_id"), F.col("text"))


@register("op9_simhash_near_dup")
def op9_simhash_near_dup(spark, sf_dir):
    near = simhash.near_duplicates(read_table(spark, sf_dir, "documents"),
                                   F.col("doc_id"), F.col("text"), shingle=4, max_bits=4)
    return near.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


@register("op10_source_mix", oracles.source_mix_sql())
def op10_source_mix(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source"),
                      n_words(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


@register("op11_exact_dedup", oracles.exact_dedup_sql())
def op11_exact_dedup(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    return exact_dedup.exact_duplicates(
        read_table(spark, sf_dir, "documents"), [F.col("doc_id"), F.sha2(text, 256).alias("text_sha256")],
        F.col("doc_id"), F.col("text"))


def with_planted_runs(docs):
    """The contract's texts: in one document of ten, by its crc32, the words from some
    place on repeat with a period."""
    def at(i, a, p):
        return F.element_at("_w", F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int") + 1)

    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("_w").cast("long")
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", "text", computed_once(F.when(h % 10 == 0, words)).alias("_w"))
    a = (g % F.greatest(n, F.lit(1))).alias("a")
    placed = split.select("doc_id", "text", "_w", n.alias("_n"), a, g.alias("g")).withColumn(
        "p", F.floor((F.col("_n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    # Through a generator, so that places are not computed anew for each word.
    once = placed.select("doc_id", "text", "_w", "_n", F.explode(F.array(F.struct("a", "p"))).alias("c"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1),
                                       lambda i: at(i, F.col("c.a"), F.col("c.p"))), " ")
    return once.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")),
                                        [F.col("doc_id")], F.col("text"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


@register("op13_hard_negatives", oracles.hard_negatives_sql())
def op13_hard_negatives(spark, sf_dir):
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), vec_id, F.col("embedding"),
                                         moved, vec_id % 50 == 0)
