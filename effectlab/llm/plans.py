"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlab.llm import bagminhash, bpe, fim, kneser_ney, lsa, merkle, mixing, pages, pii, rules, secrets, sharding, urls
from effectlab.session import work_folder


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as byte-level BPE ids and back."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    made = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep_text=False, decoded="decoded")
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    """The perplexity of all documents under trusted text, and which are kept."""
    docs = _table(spark, sf, "documents").select("doc_id", "lang", "text")
    judged = kneser_ney.judge(docs, _table(spark, sf, "labels"))
    return judged.select("doc_id", "lang", "n_words", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"), "kept")


#: Parts in which the documents are delivered to the secret ledger, by their source.
DELIVERIES = 2


def op3_secret_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in all documents, which come in deliveries: each scans only what the stored ledger
    lacks, and the stored findings are joined back to all documents."""
    docs = _table(spark, sf, "documents").select("doc_id", "source", secrets.address().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    store, turn = work_folder(spark, "secret-ledger"), F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(DELIVERIES))
    for delivery in range(DELIVERIES):
        findings = secrets.update(docs.where(turn == delivery).select("blob", "text"), store, delivery)
    told = secrets.digest(findings)
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in secrets.BASE]
    spans = F.coalesce("spans", F.lit(""))
    return docs.select("doc_id", "blob").join(told, "blob", "left").select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op4_decision_list(spark: SparkSession, sf: str) -> DataFrame:
    """Base statistics of all documents, and the verdict of a list learned from the labels."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    table, bad = rules.labelled(docs, _table(spark, sf, "labels"))
    rule = rules.rejecting_rule(rules.learn(table, bad))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = rules.statistics(docs).withColumns({"base_failed": rules.base_failed(), "rule": rule})
    return judged.select("doc_id", *base, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def op5_tree_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of all pages."""
    return pages.extract(_table(spark, sf, "pages").select("page_id", "url", "html"))


def op6_context_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """The log-probability of all documents, under counts and under the mixed model."""
    return mixing.score(_table(spark, sf, "documents").select("doc_id", "text", "lang")).drop("lang")


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    crc = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    placed = sharding.shard(crc, 16, keep_text=False)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bagminhash(spark: SparkSession, sf: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return bagminhash.classes(_table(spark, sf, "documents").select("doc_id", "text"))


def op9_latent_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return lsa.leaks(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark"))


SITE_RULES = (
    urls.SiteRule(True, "com"),
    urls.SiteRule(False, "example.com", "/en/"),
    urls.SiteRule(True, "www.example.com", "/en/"),
    urls.SiteRule(False, "net", "/es/"),
    urls.SiteRule(False, "net", "/fr/"),
)


def op10_url_models(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on the URLs of all pages: the site rules', else the language models'."""
    judged = urls.judge(_table(spark, sf, "pages").select("page_id", "url"), SITE_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op11_octopus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of all documents, and their proofs against claims of which a third are tampered with."""
    docs = _table(spark, sf, "documents")
    leaf = lambda text: merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(merkle.lowered(F.col("text"))))
    leaves = docs.select("doc_id", F.col("lang").alias("group"), leaf(F.col("text")).alias("leaf"), claim.alias("claim"))
    proofs = merkle.prove(merkle.manifest(leaves, ["doc_id"]), "claim")
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    """All documents cut at two lines and put together for filling in, and back."""
    made = fim.transform(_table(spark, sf, "documents").select("doc_id", "text"))
    back = fim.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in all documents, plain and disguised."""
    found = pii.detect(_table(spark, sf, "documents").select("doc_id", "text"), keep_text=False)
    counts = [pii.count(F.col("pii"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.told(F.col("pii"), base_only=True), 256).alias("base_sha256"), pii.told(F.col("pii")).alias("spans"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_decision_list": op4_decision_list,
    "op5_tree_scoring": op5_tree_scoring,
    "op6_context_mixing": op6_context_mixing,
    "op7_sharding": op7_sharding,
    "op8_bagminhash": op8_bagminhash,
    "op9_latent_leaks": op9_latent_leaks,
    "op10_url_models": op10_url_models,
    "op11_octopus_manifest": op11_octopus_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_personal_data": op13_personal_data,
}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op3_secret_ledger": secrets.SQL,
    "op11_octopus_manifest": merkle.SQL,
    "op12_fill_in_middle": fim.sql(),
}
