"""From raw documents to packed training sequences, in five stages of the operators in ``cinderview.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it
kept; all but the last return the columns of ``documents``. Rejected documents and
all copies but one go, secrets are masked in the text, and what is left is packed.
"""

import public_tokenizers

from cinderview.llm import exact_dedup, near_dedup, packing, quality_classifier, secret_scan
from cinderview.llm.common import batches, written
from cinderview.session import apply_settings

# A document below this score is rejected.
LEAST_SCORE = 0.3


def quality(spark, docs, sf_dir):
    """Documents that the classifier, trained on the labelled ones, does not reject.

    Null and empty texts are scored as texts without a word; repeated rows are scored
    alike and each stay or go; a score of exactly ``LEAST_SCORE`` stays; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = quality_classifier.learn(prepared(spark), docs, labels)
    return quality_classifier.accepted(spark, docs, learned, LEAST_SCORE)


def exact(spark, docs, sf_dir):
    """One document of every group of equal texts, that of the smallest id.

    Null and empty texts are equal; of repeated rows of one id and text one stays; whole
    texts are compared, however long; an empty table gives no rows.
    """
    return exact_dedup.without_exact_duplicates(prepared(spark), docs)


def near(spark, docs, sf_dir):
    """One document of every group linked by five-word shingles at a similarity of 0.8, that of the smallest id.

    A text of fewer words is one shingle; texts without words are linked with nothing and
    stay, and so do rows without an id; exactly 0.8 is a link; rows of one id stay or go
    together; an empty table gives no rows.
    """
    return near_dedup.without_near_duplicates(prepared(spark), docs)


def secrets(spark, docs, sf_dir):
    """All documents, with every secret the scan reports masked.

    Null text stays null, an empty one empty; overlapping secrets get one mark; repeated
    rows are masked alike; an empty table gives no rows.
    """
    prepared(spark)
    return secret_scan.redact_secrets(docs)


def pack(spark, docs, sf_dir):
    """Pieces of all documents and their places in sequences of 2048 tokens.

    Null and empty texts are one token, the separator; longer texts are cut into pieces;
    repeated rows are packed each; an empty table gives no rows.
    """
    return packing.pack(prepared(spark), docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("secret scan", secrets),
    ("packing", pack),
]

# A trained classifier and least-squares packing have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def prepared(spark):
    return batches(apply_settings(spark))


def run(spark, sf_dir):
    """Packed pieces of the documents that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
