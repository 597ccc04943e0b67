"""The registered queries of the subpackage: each operator over its whole table with production parameters."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import bpe, crf, divergence, interaction, ledger, mixing, onebit, parity, preferences, sharding, toxicity, urlfilter, whitening
from ledgerline.llm.tables import fold_of, read
from ledgerline.plans.stage import stage_path

RANK_FILE = "byte_bpe_multi_50k.tiktoken"

#: The rules of the url query.
URL_RULES = (
    urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"), urlfilter.Rule("block", "com", "/de/"))
#: The sites of the block list, under each of its domains.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
SHARDS = 8


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labelled rows of two of three folds; every row is scored from its text alone."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold_of(F.col("doc_id"), 3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(f"{s}.{d}",) for s in LISTED_SITES for d in LISTED_DOMAINS], "key string")
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES, listed)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.near_classes(read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"), sharding.tree(SHARDS), sharding.tree(SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), RANK_FILE)


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the rows of four of five folds; every row is predicted from its text alone."""
    docs = read(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = crf.fit(docs.where(~held_out))
    return crf.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(read(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.search(read(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = preferences.format_pairs(*preferences.swapped_replies(read(spark, sf_dir, "conversations")))
    spans = F.array_join(F.transform("loss_spans", lambda s: F.concat_ws("-", s.start, s.end)), ",")
    return formatted.withColumn("loss_spans", spans)


def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a ledger that is new to this run."""
    found = ledger.scan(read(spark, sf_dir, "documents"), stage_path(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in ledger.BASE],
                        F.sha2(ledger.joined("findings", *[r.kind for r in ledger.BASE]), 256).alias("base_sha256"), ledger.joined("findings").alias("spans"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.fit(read(spark, sf_dir, "embeddings"))
    told = whitening.apply(rows, model).select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return told.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), interaction.text_filters(F.col("text")))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_ngram_jaccard, op4_sharding, op5_byte_bpe, op6_language_crf, op7_source_mixing, op8_quality_divergence, op9_nearest_vectors, op10_chat_preferences,
                                   op11_secret_ledger, op12_embedding_whitening, op13_filter_audit)}
