"""Registered queries of the text operators, each over its whole table, with SQL where SQL can give the same rows."""

from collections.abc import Callable

from dealsift.llm import alignment, bpe, decontaminate, fill_middle, language, near_dedup, quality, rank_bpe, substring, token_counts, token_store, toxicity, url_filter
from dealsift.llm.tables import read, shared_folder

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return toxicity.grade(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_language")
def op3_language(spark, sf_dir):
    return language.identify(read(spark, sf_dir, "documents"))


@query("op5_quality")
def op5_quality(spark, sf_dir):
    out = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_url_filter", url_filter.oracle())
def op8_url_filter(spark, sf_dir):
    return url_filter.judge(read(spark, sf_dir, "pages"))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts.count(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op7_bpe")
def op7_bpe(spark, sf_dir):
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op10_token_store")
def op10_token_store(spark, sf_dir):
    folder = shared_folder(spark, "token-store")
    token_store.write(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), folder)
    return token_store.read(spark, folder, digest=True)


@query("op2_substring_dedup", substring.ORACLE)
def op2_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


@query("op9_near_dedup", near_dedup.ORACLE)
def op9_near_dedup(spark, sf_dir):
    return near_dedup.dedup(read(spark, sf_dir, "documents"))


@query("op6_decontamination")
def op6_decontamination(spark, sf_dir):
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return rank_bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_fill_middle", fill_middle.ORACLE)
def op12_fill_middle(spark, sf_dir):
    return fill_middle.digests(read(spark, sf_dir, "documents"))


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    return alignment.summary(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
