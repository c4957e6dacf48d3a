"""Queries of the text operators, on the whole tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from visitloom.llm import (
    bpe, decontaminate, hnsw, mixing, periods, pii, quality, secrets, sentences, sharding, simhash, tries, url_rules,
)
from visitloom.llm.common import add_columns, table
from visitloom.sources.staging import stage

VOCABULARY = corpus_pipeline.VOCABULARY


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def of_kind(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def counts(spans: Column, kinds: list[str]) -> list[Column]:
    return [F.size(of_kind(spans, [k])).cast("long").alias(f"n_{k}") for k in kinds]


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256(F.concat_ws(",", "items")).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _url_filter_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = {r.name: f"regexp_matches(host || path, '{r.pattern}')" for r in url_rules.SITE_RULES}
    ordered = sorted(url_rules.SITE_RULES, key=lambda r: (-len(r.name), r.name))
    rule = " ".join(f"WHEN {fits[r.name]} THEN '{r.name}'" for r in ordered)
    verdict = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in ordered)
    other = " OR ".join(f"regexp_matches(whole, '{r.pattern}')" for r in url_rules.PART_RULES)
    return f"""
        WITH cut AS (
            SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
                regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
                translate(coalesce(url, ''), '{upper}', '{lower}') AS whole
            FROM cut
        ), ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE {verdict} WHEN {other} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shuffled = sharding.external_shuffle(docs, shards=8, bytes_of=size)
    return shuffled.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(encoder: bpe.Encoder, ids: list[int], decoded: bytes) -> tuple:
        listed = ",".join(map(encoder.names.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()

    types = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), types, digest).select("doc_id", *types)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    spans = F.col("spans")
    return docs.select(
        "doc_id",
        *counts(spans, base),
        sha256(span_text(of_kind(spans, base))).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


def repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.remove_repeats(docs).select("doc_id", "text", "n_removed", "removed", "copies_of")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return docs.select(
        "doc_id",
        *counts(F.col("base"), list(pii.BASE_KINDS)),
        sha256(span_text(F.col("base"))).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = hnsw.near_groups(table(spark, sf_dir, "embeddings"))
    return groups.select("vec_id", "n_links", "component_id", "kept", "recall")


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("size")))
    taken = F.col("copies") * F.col("size")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of about a tenth made periodic from some word on, as the query's contract says."""

    def planted(doc_id: int | None, text: str | None) -> str | None:
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        words = text.encode().split() if text and h % 10 == 0 else []
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        cycle = words[a : a + period]
        return b" ".join((words[:a] + cycle * -(-(n - a) // period))[:n]).decode()

    def make(values: pa.Array) -> list[list]:
        return [[planted(*pair) for pair in zip(values.field("doc_id").to_pylist(), values.field("text").to_pylist())]]

    return add_columns(docs.select("doc_id", F.struct("doc_id", "text").alias("both")), "both", {"text": "string"}, make)


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text")
    found = periods.collapse_runs(docs)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = "strongest"
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"{best}.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr(f"{best}.length * 1000 div {best}.period").alias("exponent_milli"),
        sha256(F.concat_ws("", F.transform("runs", line))).alias("runs_sha256"),
        sha256(F.col("text")).alias("collapsed_sha256"),
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Thin turns of the rebuilt conversations, and the ids of all: of each up to five turns are taken from the
    conversation whose id is the last multiple of 100."""
    placed = stage(tries.numbered(turns))
    kept = F.crc32(F.col("conv").cast("string")) % 6
    members = placed.select("conv").distinct()
    said = ["k1", "k2", "chars"]
    heads = placed.where("pos < 5 and conv % 100 = 0").select(F.col("conv").alias("base"), "pos", *said)
    ids = members.select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"))
    first = ids.join(heads, "base").where(F.col("pos") < kept).select("conv", (F.col("pos") - 5).alias("turn"), *said)
    own = placed.where(F.col("pos") >= kept).select("conv", F.col("pos").alias("turn"), *said)
    return first.unionByName(own), members


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = rebuilt_turns(stage(tries.thin_turns(table(spark, sf_dir, "conversations"))))
    made = tries.trie(turns, members)
    none = F.lit(hashlib.sha256().hexdigest())
    joined = made.nodes.join(tries.listed_digest(made.ends), ["conv_id", "depth"], "left")
    return joined.select(*made.nodes.columns, F.coalesce("ends_sha256", none).alias("ends_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": benchmark_overlap,
    "op2_url_filter": url_filter,
    "op3_byte_bpe": byte_bpe,
    "op4_secret_scan": secret_scan,
    "op5_external_shuffle": shards,
    "op6_sentence_spans": repeated_sentences,
    "op7_boosted_pii": personal_data,
    "op8_simhash_near_dedup": near_duplicates,
    "op9_rule_ensemble": text_quality,
    "op10_hnsw_near_dedup": near_vectors,
    "op11_pivotal_mix": mixed_sources,
    "op12_periodic_runs": periodic_runs,
    "op13_conversation_trie": conversation_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op2_url_filter": _url_filter_sql()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
