"""One query per operator over its whole table, with production parameters, and SQL where it can say the same."""

from pyspark.sql import functions as F

from mlframes.llm import ann, dialogue, langid, leaks, lexical, lines, mixing, packing, setjoin, sharding, syncmers, tokens, warc
from mlframes.llm.common import text_column


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_secret_scan(spark, sf):
    return leaks.secret_report(_table(spark, sf, "documents"))


def op2_warc_round_trip(spark, sf):
    return warc.archive_report(_table(spark, sf, "pages"))


def op3_mix_sources(spark, sf):
    return mixing.plan(_table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", mixing.words_taken().alias("taken"))


def op4_token_counts(spark, sf):
    import public_tokenizers
    return tokens.token_counts(_table(spark, sf, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_nearest_vectors(spark, sf):
    return ann.nearest(_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_language(spark, sf):
    docs = _table(spark, sf, "documents")
    profiles = langid.fit(docs.where(~langid.held_out("doc_id")))
    slim = docs.select("doc_id", langid.held_out("doc_id").alias("held_out"), "text")
    return langid.predict(slim, profiles).drop("text")


def op7_line_dedup(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    left = lines.remove_repeats(docs)
    return left.select("doc_id", "n_lines", "n_deleted", "deleted", F.sha2(text_column("text").cast("binary"), 256).alias("text_sha256"))


def op8_jaccard_components(spark, sf):
    return setjoin.jaccard_components(_table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op9_syncmers(spark, sf):
    return syncmers.edit_report(_table(spark, sf, "documents"))


def op10_pack(spark, sf):
    return packing.pack(_table(spark, sf, "documents"), _tokenizer("word_bpe_49k.json"))


def op11_conversation_repair(spark, sf):
    return dialogue.repair_report(_table(spark, sf, "conversations"))


def op12_lexical_search(spark, sf):
    return lexical.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op13_hash_tree_shards(spark, sf):
    return sharding.shard_report(_table(spark, sf, "documents"))


def pipeline(spark, sf):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


OP3_SQL = r"""
with docs as (
  select doc_id, source, source is null as none, coalesce(source, '') as name,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('0:' || coalesce(doc_id::varchar, 'null')) as draw from documents),
sources as (
  select name, none, sum(size)::bigint as source_size, 3 * sum(size)::bigint as most,
    case (row_number() over (order by none, name) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from docs group by name, none),
filled as (
  select *, (sum(source_size) over () - coalesce(sum(most) over fewer, 0))::bigint as remains,
    (sum(weight) over () - coalesce(sum(weight) over fewer, 0))::bigint as weights,
    row_number() over (order by most::double / weight, none, name) as place
  from sources window fewer as (order by most::double / weight, none, name rows between unbounded preceding and 1 preceding)),
level as (select remains / weights::double as level from filled where weight * (remains / weights::double) <= most
  order by place limit 1),
targets as (
  select name, none, source_size,
    case when weight * coalesce((select level from level), 1e300) > most then most else weight * (select level from level) end::double as target
  from sources),
wanted as (
  select *, case when source_size > 0 then round(target)::bigint // source_size else 0 end as rounds from targets),
ordered as (
  select *, coalesce(sum(size) over (partition by name, none order by draw, doc_id, size
    rows between unbounded preceding and 1 preceding), 0)::bigint as before from docs)
select doc_id, size, source_size, target,
  (rounds * size + greatest(0, least(size, round(target)::bigint - rounds * source_size - before)))::bigint as taken
from ordered join wanted using (name, none)
"""

QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_warc_round_trip, op3_mix_sources, op4_token_counts, op5_nearest_vectors, op6_language,
    op7_line_dedup, op8_jaccard_components, op9_syncmers, op10_pack, op11_conversation_repair, op12_lexical_search, op13_hash_tree_shards,
    pipeline)}

OP2_SQL = """
with rows as (
  select page_id, encode(coalesce(html, '')) as payload, row_number() over (partition by coalesce(html, '') order by page_id, url) as place,
    min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest,
  case when place > 1 and octet_length(payload) >= 100 then 'revisit' else 'response' end as record_type,
  case when place > 1 and octet_length(payload) >= 100 then first end as refers_to from rows
"""

OP12_SQL = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tfs as (select doc_id, term, count(*)::bigint as tf from terms group by all),
sizes as (select doc_id, count(*)::bigint as n from terms group by all),
totals as (select count(*)::bigint as docs, sum(n)::bigint as words from sizes),
ms as (select doc_id, 75 + (25 * n * docs) // words as m from sizes, totals),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tfs, totals group by term, docs),
wanted as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from wanted join tfs using (term) join weights using (term) join ms using (doc_id) group by all)
select item_id, (row_number() over best)::int as rank, doc_id, score from scores where score > 0
window best as (partition by item_id order by score desc, doc_id) qualify row_number() over best <= 20
"""

OP13_SQL = """
with crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as steps),
docs as (
  select doc_id, coalesce(doc_id::varchar, 'null') as key, octet_length(encode(coalesce(text, '')))::bigint + 1 as size,
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255)::int + 1])))::bigint as text_crc32
  from documents, crc),
keys as (select distinct key from docs),
leaves as (
  select n, s, '/r' || case when s < 8 then s // 4 else s end as region, '/k' || case when s < 8 then s // 2 % 2 else 0 end as rack
  from (select unnest([8, 9]) as n), range(9) as r(s) where s < n),
regions as (select n, region, count(*) as weight from leaves group by all),
racks as (select n, region, rack, count(*) as weight from leaves group by all),
one as (
  select key, n, arg_max(region, ln((('0x' || md5(key || '|' || region)[:13])::bigint + 0.5) / 4503599627370496.0) / weight) as region
  from keys, regions group by key, n),
two as (
  select key, n, region, arg_max(rack, ln((('0x' || md5(key || '|' || region || rack)[:13])::bigint + 0.5) / 4503599627370496.0) / weight) as rack
  from one join racks using (n, region) group by key, n, region),
three as (
  select key, n, region, rack, arg_max(s, ln((('0x' || md5(key || '|' || region || rack || '/' || s)[:13])::bigint + 0.5) / 4503599627370496.0)) as s
  from two join leaves using (n, region, rack) group by key, n, region, rack)
select doc_id, size, text_crc32, 'key' as law, now.s::int as shard,
  row_number() over (partition by now.s order by doc_id nulls first, size, text_crc32) - 1 as slot, later.s::int as grown_shard,
  now.region[2:] as region, now.rack[2:] as rack
from docs join three now using (key) join three later using (key) where now.n = 8 and later.n = 9
"""

ORACLES = {"op3_mix_sources": OP3_SQL, "op2_warc_round_trip": OP2_SQL, "op12_lexical_search": OP12_SQL,
           "op13_hash_tree_shards": OP13_SQL}
