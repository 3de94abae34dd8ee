"""The registered queries opN_<name> and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, hard_negatives, hash_forest, license_scan, line_dedup, mixing, ngram_join, pii, prefix_trie, pu_quality, quality_rules, sharding, sstable
from gridloom.llm._common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
        F.coalesce(F.round(F.array_max(F.transform("spans", lambda s: s["score"])), 3), F.lit(0.0)).alias("top_score"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality_probability", 6).alias("quality_probability"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    out = sharding.assign(docs, keep=("doc_id", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.item_of("text").alias("item"), mixing.size_of("text").alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2("clean_text", 256).alias("clean_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.round(F.array_max("containment"), 4).alias("best"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = sstable.new_folder(spark)
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    rows = sstable.read_shards(manifest, folder)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr(decontaminate.CONTAMINATED).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, changed)


def op12_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_ngram_join, op3_quality_rules, op4_pu_quality, op5_sharding, op6_mixing, op7_line_dedup, op8_license_scan, op9_sstable, op10_decontamination, op11_hard_negatives, op12_hash_forest, op13_prefix_trie, pipeline)
}

_WORDS10 = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op10_decontamination": f"""
with d as (select doc_id, {_WORDS10} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS10} as w from benchmark),
bw as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select item, w, least(13, len(w)) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
met as (select doc_id, dw.n, i, item from dw join bw on dw.n = bw.n and dw.win = bw.win),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from met)) group by doc_id),
its as (select doc_id, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as h from met group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join its using (doc_id)""",
    "op11_hard_negatives": """
with r as (select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5""",
    # crc32 bit by bit, over the decimal digits of an id.
    "op13_prefix_trie": """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as p, {'r': coalesce(role, ''), 't': coalesce(text, '')} as x from conversations where conv_id is not null),
own as (select conv_id, list(x order by p) as l from t group by conv_id),
h as (select conv_id, l, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 9 as h from own),
c as (select h.conv_id, list_concat(coalesce(own.l[1:h], []), h.l[h + 1:]) as l from h left join own on own.conv_id = h.conv_id - h.conv_id % 5),
m as (select conv_id, l, unnest(range(0, len(l) + 1)) as depth from c),
n as (select l[1:depth] as k, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len(l) = depth), '') as ends from m group by l[1:depth], depth),
kids as (select k[1:depth - 1] as k, count(*) as n_children from n where depth > 0 group by k[1:depth - 1]),
own_of as (select n.*, coalesce(n_children, 0) as n_children, case when depth > 0 then (n_convs - 1) * strlen(n.k[depth]['t']) else 0 end as amount from n left join kids on n.k = kids.k),
up as (select k, unnest(range(0, depth + 1)) as d, amount, n_children from own_of),
sums as (select k[1:d] as k, sum(amount) as saved, count(*) filter (where n_children = 0) as n_leaves from up group by k[1:d])
select o.conv_id, o.depth, q.conv_id as parent_conv_id, o.n_convs, o.n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(o.ends) as ends_sha256
from own_of o join sums on o.k = sums.k left join own_of q on o.depth > 0 and q.k = o.k[1:o.depth - 1]""",
}
