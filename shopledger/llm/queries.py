"""Registered queries of the text operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, graph, language, lm, packing, personal, quality, ranked, simhash, substrings, tokenizers, tournament, weighted
from .text import importable

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", "text")


def _vocabulary(spark: SparkSession) -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(spark, public_tokenizers.path(TOKENIZER))


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.with_tokens(_documents(spark, folder), _vocabulary(spark))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(_documents(spark, folder), size=3, max_bits=2)
    return groups.withColumn("fingerprint", simhash.as_hex(F.col("fingerprint")))


def op3_weighted_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = weighted.fingerprints(_documents(spark, folder), edited_as=_sha256).withColumnRenamed("edited", "edited_sha256")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substrings.without_repeats(_documents(spark, folder))
    return rows.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def op5_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    held = language.held_out(F.col("doc_id"), 4, 2)
    docs = _documents(spark, folder)
    labels = _table(spark, folder, "labels").select("doc_id", "quality").where(~held)
    rows = quality.with_quality(docs, quality.fit(docs, labels), threshold=0.7)
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held = language.held_out(F.col("doc_id"), 4, 2)
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held))
    rows = language.with_language(docs.drop("lang"), model)
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    rows = personal.with_personal_data(docs, personal.fit(docs))
    base = F.filter("personal", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in personal.KINDS]
    return rows.select("doc_id", *counts, _sha256(_listed(base)).alias("base_sha256"), _listed(F.col("personal")).alias("spans"))


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held = language.held_out(F.col("doc_id"), 7, 2)
    rows = lm.scored(_documents(spark, folder), train=~held)
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_embedding_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return graph.linked(_table(spark, folder, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.pack_documents(_documents(spark, folder), _vocabulary(spark), CAPACITY)
    return placed.withColumn("length", F.col("length").cast("long"))


def _byte_tokens(spark: SparkSession) -> tokenizers.Tokenizer:
    import public_tokenizers

    return tokenizers.Tokenizer(spark, tokenizers.ByteTokens, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    pieces = tokenizers.Tokenizer(spark, tokenizers.PieceTokens, public_tokenizers.path("piece_bpe_32k.model"))

    def digest(groups: Column, has_tokens: Column) -> Column:
        return F.when(has_tokens, _sha256(groups)).otherwise("")

    rows = alignment.aligned(_documents(spark, folder), _byte_tokens(spark), pieces, groups_as=digest)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_tournament_packing(spark: SparkSession, folder: str) -> DataFrame:
    return tournament.pack_documents(_documents(spark, folder), _byte_tokens(spark), CAPACITY, separator=1)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(_documents(spark, folder), _table(spark, folder, "benchmark"), k=20)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_simhash_groups,
        op3_weighted_fingerprints,
        op4_substring_dedup,
        op5_quality_scores,
        op6_language_id,
        op7_personal_data,
        op8_lm_scores,
        op9_embedding_neighbours,
        op10_best_fit_packing,
        op11_tokenizer_alignment,
        op12_tournament_packing,
        op13_ranked_search,
    )
}

# DuckDB SQL of the queries that need no learned model, tokeniser or hash that SQL lacks.
STATEMENTS: dict[str, str] = {
    "op4_substring_dedup": r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13),
windows as (select doc_id, i, array_to_string(w[i : i + 12], ' ') words from starts),
firsts as (select words, min(doc_id) first from windows group by words),
gone as (
  select doc_id, list(distinct j) places
  from (select doc_id, unnest(range(i, i + 13)) j from windows join firsts using (words) where first < doc_id) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(len(places), 0)::bigint n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(places, []), i)), ' ')) kept_sha256
from d left join gone using (doc_id)""",
    "op9_embedding_neighbours": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reached as (select vec_id, vec_id other from embeddings union select vec_id, b from reached join links on other = a)
select vec_id, (select count(*) from links where a = vec_id) n_links, min(other) component_id, vec_id = min(other) kept
from reached group by vec_id""",
    "op13_ranked_search": r"""
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
docs as (select doc_id, t, len(t) n from words where len(t) > 0),
corpus as (select count(*) as n_docs, sum(n) as n_terms from docs),
asked as (
  select item_id, term, count(*) times
  from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark)
  group by item_id, term),
counts as (select doc_id, n, term, count(*) tf from (select doc_id, n, unnest(t) term from docs) group by doc_id, n, term),
weight as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint w
  from counts, corpus group by term, n_docs),
scores as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint score
  from asked join weight using (term) join counts using (term), corpus group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
from scores where score > 0 qualify rank <= 20""",
}
