"""The queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, ctph, filters, jpeg, langid, lm, mixing, secrets, setjoin, simhash, substring, turns, urlfilter
from sieveline.llm.common import fold
from sieveline.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def vocabulary() -> str:
    """The vocabulary file of the box; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op10_bpe")
def op10(spark, sf_dir):
    """Every document encoded and decoded again, as digests."""
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


@query("op2_jpeg")
def op2(spark, sf_dir):
    """Every document stored as a baseline JPEG and read back."""
    read = jpeg.media_features(jpeg.media_column(table(spark, sf_dir, "documents")))
    return read.withColumn("feature", F.format_string("%dx%d:%s", "width", "height", "thumb_hash")).drop("width", "height", "thumb_hash", "error")


@query("op9_secrets")
def op9(spark, sf_dir):
    """Secrets of every document: all blobs are unseen, so the ledger starts empty."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query("op3_mix", mixing.SQL)
def op3(spark, sf_dir):
    """How many words of every document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op8_langid")
def op8(spark, sf_dir):
    """The language of every document, learned from the rows of three of four folds."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.Model(langid.learn(docs, fold("doc_id", 4) != 2)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op4_simhash")
def op4(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_substrings")
def op5(spark, sf_dir):
    """What is left of every document without the passages that stand earlier in the corpus."""
    return substring.factors(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_ctph")
def op6(spark, sf_dir):
    """Every document's piecewise hash against its edited text's and the next document's."""
    return ctph.edit_likeness(table(spark, sf_dir, "documents"))


@query("op7_urls", urlfilter.SQL)
def op7(spark, sf_dir):
    """The list's verdict on every page at the time of its capture."""
    pages = table(spark, sf_dir, "pages")
    found = urlfilter.verdicts(urlfilter.captures_of(pages), urlfilter.list_of(pages))
    return found.select(F.col("id").alias("page_id"), "host", F.col("fetched").cast("string").alias("fetched"), "verdict", "pattern", F.col("since").cast("string").alias("since"))


@query("op1_bloom_lm")
def op1(spark, sf_dir):
    """Every document under the model of those in six of seven folds."""
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(fold("doc_id", 7) != 2))
    found = lm.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op12_filter_audit", filters.SQL)
def op12(spark, sf_dir):
    """What each of five filters removes from the documents, by source, order and step."""
    return filters.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_turn_repair", turns.SQL)
def op13(spark, sf_dir):
    """Faults and cheapest repair of every conversation, after damage."""
    return turns.summaries(turns.damaged(table(spark, sf_dir, "conversations")))


@query("op11_partenum")
def op11(spark, sf_dir):
    """The component of every document under a Jaccard similarity of 0.9 of three-word shingles."""
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))
