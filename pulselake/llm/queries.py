"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, bpe, decontam, langid, linededup, ngramlm, quality, setjoin, sharding, tokenstore, toxicity, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_and_read(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"), F.array_join("keep_runs", ",").alias("keep_runs"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_documents(_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(_table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_token_store": op3_token_store,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_sharding": op12_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
with w as (
    select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words
    from (select distinct doc_id, text from documents where doc_id is not null and text is not null)),
b as (
    select distinct item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words
    from benchmark where item_id is not null and text is not null),
items as (select row_number() over () as i, item_id, words, len(words) as p, least(len(words), 5) as k from b where len(words) > 0),
ds as (
    select r, doc_id, n, k, pos, array_to_string(words[pos + 1:pos + k], ' ') as s
    from (select r, doc_id, len(words) as n, k, words, unnest(range(0, len(words) - k + 1)) as pos
          from w cross join (select distinct k from items) where len(words) >= k)),
bs as (select i, p, k, array_to_string(words[spot + 1:spot + k], ' ') as s from (select i, p, k, words, unnest(range(0, p - k + 1)) as spot from items)),
hits as (select distinct r, n, i, p, ds.k, pos, least(n, p) as l from ds join bs on ds.k = bs.k and ds.s = bs.s),
laid as (select distinct r, i, p, k, l, unnest(range(greatest(0, pos - (l - k)), least(pos, n - l) + 1)) as start from hits),
win as (
    select x.r, doc_id, i, p, x.k, l, start, s, count(*) as c
    from (select *, unnest(range(start, start + l - k + 1)) as pos from laid) x join ds on ds.r = x.r and ds.k = x.k and ds.pos = x.pos group by all),
ic as (select i, s, count(*) as c from bs group by all),
common as (select r, doc_id, win.i, p, k, l, start, sum(least(win.c, ic.c)) as m from win join ic on ic.i = win.i and ic.s = win.s group by all),
scored as (select doc_id, item_id, start, l, m / (l - common.k + 1 + common.p - common.k + 1 - m) as similarity from common join items using (i))
select doc_id, item_id, cast(start as integer) as start, cast(l as integer) as n_words, round(similarity, 6) as similarity
from scored where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1
""",
    "op2_ngram_jaccard_join": r"""
with w as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\x0C\r]+') as words from documents),
sh as (
    select r, doc_id, case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
           else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) end as s from w),
cl as (select *, dense_rank() over (order by list_sort(s)) as c from sh),
k as (select c, any_value(len(s)) as n, min(doc_id) as least from cl group by c),
x as (select distinct c, unnest(s) as s from cl),
pr as (select a.c as a, b.c as b, count(*) as m from x a join x b on a.s = b.s and a.c < b.c group by 1, 2),
ln as (select a, b from pr join k p on p.c = a join k q on q.c = b where 100 * m >= 85 * (p.n + q.n - m)),
e as (select a, b from ln union all select b, a from ln union all select c, c from k),
rc as (with recursive t(c, l) as (select c, c from k union select t.c, e.b from t join e on e.a = t.l) select c, l from t),
own as (select rc.c, min(k.least) as component_id from rc join k on k.c = rc.l group by 1)
select doc_id, cast(len(s) as bigint) as n_shingles, case when len(s) = 0 then doc_id else component_id end as component_id from cl join own using (c)
""",
    "op4_line_dedup": r"""
with lines as (
    select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents),
keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
often as (
    select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (
    select d.doc_id, d.pos, d.line, (o.k is not null and d.doc_id <> o.keeper) as drop_it
    from keyed d left join often o on d.k = o.k),
per_doc as (
    select doc_id, count(*) as n_lines, count(*) filter (drop_it) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not drop_it), '')) as kept_sha256,
           coalesce(list(pos - 1 order by pos) filter (drop_it), []) as dropped
    from marked group by doc_id)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_dropped as bigint) as n_dropped, kept_sha256,
       array_to_string(list_transform(dropped, lambda p, i: case when i = 1 then p else p - dropped[i - 1] - 1 end), ',') as keep_runs
from per_doc
""",
}
