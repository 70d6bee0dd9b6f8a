"""Query of operator 2: all documents as Huffman-coded token files, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.llm import tokens
from webloom.llm.common import work_folder
from webloom.llm.registry import query, table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_token_files")
def token_files(spark, folder):
    corpus = work_folder(spark, "tokens")
    tokens.write_corpus(table(spark, folder, "documents").select("doc_id", "text"), corpus, word_tokenizer())
    return tokens.read_corpus(spark, corpus).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
