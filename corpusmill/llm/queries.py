"""The queries of this subpackage: each binds one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.llm import (decontaminate, html_extract, language_id, license_scan, near_dedup, packing,
                            quality_classifier, quality_rules, secret_scan, sharding, token_counts,
                            vector_codes, whitening)
from corpusmill.llm.common import table


def trusted_documents(spark, sf_dir):
    """Ids of the documents labelled as good."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op1_quality_rules(spark, sf_dir):
    """Base counts, likelihood-ratio score and verdict of all documents."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted_documents(spark, sf_dir))


def op2_decontamination(spark, sf_dir):
    """Pairs of a document and a benchmark item that it contains."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_found").distinct()


def tokenizer_path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark, sf_dir):
    """Place of every piece of all documents in sequences of 4096 tokens."""
    pieces = packing.tokenized_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces)


def op4_language_id(spark, sf_dir):
    """Language of all documents, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.learn(docs.filter(fold != 2))
    found = language_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score",
                        F.size("spans").alias("n_spans"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_secret_scan(spark, sf_dir):
    """Counts and digests of the secrets in all documents."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *[count(kind) for kind in secret_scan.BASE],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op6_near_dedup(spark, sf_dir):
    """Near-duplicate classes of all documents at Jaccard >= 0.85."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_quality_classifier(spark, sf_dir):
    """Quality of all documents; the source is the host, its language sections are the paths."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                       host=F.col("source"), path=F.col("lang"))


def op8_sharding(spark, sf_dir):
    """Shard and slot of all documents, by rendezvous hashing of doc_id."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), [1.0] * sharding.SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_license_scan(spark, sf_dir):
    """License notices in all documents, with coverage and span."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark, sf_dir):
    """Main text of all pages."""
    found = html_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op11_embedding_whitening(spark, sf_dir):
    """Whitened components of all embeddings, fitted on the distinct vectors."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    part = F.explode(F.arrays_zip("whitened", "explained", F.sequence(F.lit(1), F.size("whitened")).alias("component")))
    return (found.filter(F.size("whitened") > 0).select("vec_id", "n", "deviation", "identity_error", part.alias("p"))
            .select("vec_id", "p.component", "n", "deviation", "p.whitened", "p.explained", "identity_error"))


def op12_token_counts(spark, sf_dir):
    """Tokens of all documents under a 32,000-piece BPE with byte fallback."""
    import public_tokenizers
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark, sf_dir):
    """Four-byte codes of all embeddings, their errors and the digest of the codebooks."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return coded.select("vec_id", code.alias("code"), "error", "label_error",
                        F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


REGISTRY = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sharding": op8_sharding,
    "op9_license_scan": op9_license_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

# distinct five-word shingles of a table's texts, A-Z lower-cased
_SHINGLES = """
    SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
                             ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
    FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
          FROM (SELECT {id} AS id, [x FOR x IN regexp_split_to_array(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
                FROM {table}) WHERE len(w) > 0)
"""

ORACLE: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
     b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
     n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n_item, count(*) AS n_found
FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n_item HAVING 100 * count(*) >= 80 * n.n_item
""",
}
