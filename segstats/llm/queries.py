"""The queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from segstats.llm import bpe, exact, html, imatch, merkle, mixing, packing, quality, simhash, substring, token_shards, toxicity, trie
from segstats.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op6_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_weighted_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


ORACLES["op8_weighted_fair_mixing"] = """
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    md5(concat('42:', coalesce(cast(doc_id as varchar), ''))) as h from documents),
sources as (
  select source, sum(size) as source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end as weight
  from sized group by source),
filled as (
  select *, 3.0 * source_size as cap, sum(source_size) over () as total,
    coalesce(sum(3.0 * source_size) over (order by 3.0 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as held,
    sum(weight) over (order by 3.0 * source_size / weight desc, source desc nulls first rows between unbounded preceding and current row) as open
  from sources),
level as (select max((total - held) / open) as lv from filled),
targets as (select source, cast(source_size as bigint) as source_size, least(cap, weight * coalesce((select lv from level), 1e300)) as target from filled),
queued as (
  select s.doc_id, s.size, t.source_size, t.target, floor(t.target + 1e-6) as quota,
    coalesce(sum(s.size) over (partition by s.source order by s.h, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as start
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target,
  cast(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start)) + greatest(0, least(size, quota - 2 * source_size - start)) as bigint) as taken,
  case when target > 0 then round((start + size) / target, 9) end as finish
from queued"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.decisions(docs, exact.DigestIndex(spark))


ORACLES["op9_exact_dedup"] = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id
  and row_number() over (partition by text_sha256, doc_id) = 1 as kept, text_sha256
from d join g using (text_sha256)"""


def op10_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


#: The table of CRC-32 by its rule, and the CRC-32 of the decimal form of a column.
_CRC_TABLE = """
tab as (
  select list(v order by n) as tab from (
    select n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from (select cast(unnest(range(256)) as bigint) as n)))"""


def _crc(column: str) -> str:
    digits = f"list_transform(string_split(cast({column} as varchar), ''), lambda x: cast(ascii(x) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {digits}), lambda c, x: xor(c >> 8, tab[cast(xor(c, x) & 255 as bigint) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else concat(strlen(cast({value} as varchar)), ':', cast({value} as varchar)) end"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


ORACLES["op11_merkle_manifest"] = f"""
with recursive {_CRC_TABLE},
hit as (select documents.*, coalesce({_crc("doc_id")} % 3 = 0, false) as hit from documents, tab),
lower_case as (select *, case when hit then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other from hit),
leaves as (select doc_id, lang, {_leaf("text")} as leaf, {_leaf("other")} as changed from lower_case),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, dense_rank() over (order by lang nulls first) - 1 as tree,
    row_number() over () as id from leaves),
nodes(tree, lvl, pos, h, n) as (
  select tree, 0, pos, leaf, count(*) over (partition by tree) from placed
  union all
  select tree, lvl, pos, h, count(*) over (partition by tree) from (
    select tree, lvl + 1 as lvl, pos // 8 as pos, sha256(string_agg(h, '' order by pos)) as h from nodes where n > 1 group by tree, lvl, pos // 8)),
subroots as (select tree, h from nodes where n = 1),
tops(lvl, pos, h, n) as (
  select 0, tree, h, count(*) over () from subroots
  union all
  select lvl, pos, h, count(*) over () from (select lvl + 1 as lvl, pos // 8 as pos, sha256(string_agg(h, '' order by pos)) as h from tops where n > 1 group by lvl, pos // 8)),
steps as (
  select tree, lvl, pos, coalesce(string_agg(h, '') over (partition by tree, lvl, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (partition by tree, lvl, pos // 8 order by pos rows between 1 following and unbounded following), '') as r
  from nodes where n > 1),
top_steps as (
  select lvl, pos, coalesce(string_agg(h, '') over (partition by lvl, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (partition by lvl, pos // 8 order by pos rows between 1 following and unbounded following), '') as r
  from tops where n > 1),
up(id, tree, lvl, pos, digest, proof) as (
  select id, tree, 0, pos, changed, '' from placed
  union all
  select id, up.tree, up.lvl + 1, up.pos // 8, sha256(l || digest || r), proof || l || r from up join steps on steps.tree = up.tree and steps.lvl = up.lvl and steps.pos = up.pos),
at_subroot as (select id, tree, arg_max(digest, lvl) as digest, arg_max(proof, lvl) as proof from up group by id, tree),
over(id, lvl, pos, digest, proof) as (
  select id, 0, tree, digest, proof from at_subroot
  union all
  select id, over.lvl + 1, over.pos // 8, sha256(l || digest || r), proof || l || r from over join top_steps on top_steps.lvl = over.lvl and top_steps.pos = over.pos),
at_root as (select id, arg_max(digest, lvl) as folded_root, sha256(arg_max(proof, lvl)) as proof_sha256 from over group by id)
select doc_id, leaf, subroots.h as subroot, tops.h as root, proof_sha256, folded_root, folded_root = tops.h as verified
from placed join at_root using (id) join subroots using (tree) join tops on tops.n = 1"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = f"""
with {_CRC_TABLE},
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, content) as place, content, words from (
    select conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as content,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words from conversations)),
convs as (select conv_id as c, conv_id - conv_id % 20 as first, coalesce({_crc("conv_id")} % 4, 0) as h from (select distinct conv_id from conversations), tab),
taken as (select c, first, h, least(h, count(place)) as k from convs left join turns on turns.conv_id = first group by c, first, h),
rebuilt as (
  select c, place, content, words from taken join turns on turns.conv_id = first where place <= h
  union all
  select c, place - h + k, content, words from taken join turns on turns.conv_id is not distinct from c where place > h),
chain as (
  select c, place as depth, md5(string_agg(content, '') over (partition by c order by place)) as name, words from rebuilt
  union all
  select c, 0, '', 0 from convs),
lined as (select *, lead(name) over (partition by c order by depth) as next_name, lag(name) over (partition by c order by depth) as last_name from chain),
nodes as (
  select depth, name, min(c) as conv_id, count(*) as n_convs, count(distinct next_name) as n_children, any_value(last_name) as last_name, (count(*) - 1) * any_value(words) as saved,
    sha256(coalesce(string_agg(case when next_name is null then cast(c as varchar) end, ',' order by c), '')) as ends_sha256
  from lined group by depth, name),
below as (
  select name, count(*) filter (where n_children = 0) as n_leaves, sum(saved) as saved_tokens from (
    select distinct top.name, low.name as inner_name from chain top join chain low on low.c is not distinct from top.c and low.depth >= top.depth) pairs
  join (select name as inner_name, n_children, saved from nodes) using (inner_name) group by name)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join below using (name) left join nodes p on p.name = n.last_name"""


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


for _query in (op1_imatch_fingerprints, op2_simhash_near_dedup, op3_token_shards, op4_compression_toxicity, op5_fixed_block_anchors, op6_vector_best_fit,
               op7_fourier_quality, op8_weighted_fair_mixing, op9_exact_dedup, op10_text_density, op11_merkle_manifest, op12_prefix_trie, op13_streaming_bpe):
    QUERIES[_query.__name__] = _query
