"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    darts, divergence, exact, jaccard, passages, pieces, quality, records, suffixes, template, toxic, urls, whitening,
)
from .common import is_training, shared_folder

#: Rules of the URL query: verdict, host, path.
URL_RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out():
    return (~is_training(F.col("doc_id"))).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, _table(spark, sf_dir, "labels"))
    return quality.classify(documents, model).select("doc_id", _held_out(), "score", "predicted")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "records")
    documents = _table(spark, sf_dir, "documents")
    records.write_records(documents, folder, tokenizer_path("byte_bpe_50k.json"), END_ID)
    read = records.read_records(spark, folder)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return template.main_texts(pages).select("page_id", "url", "text", "n_chars")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixes.find_contamination(documents, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        suffixes.digest(F.col("items")).alias("items_sha256"), "contaminated",
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode_pieces(documents, model, decode=True))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic.train(documents, _table(spark, sf_dir, "labels"))
    return toxic.classify(documents, model).select("doc_id", _held_out(), "score", "predicted")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return darts.near_duplicates(documents).drop("text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whitened_rows(embeddings, whitening.fit_whitening(embeddings))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.jaccard_join(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "n_shingles", "component_id")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: value for name, value in list(globals().items()) if name[:2] == "op" and name[2].isdigit() and callable(value)
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": r"""
        with n as (
            select doc_id, length(coalesce(text, '')) as n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as s
            from documents
        ), g as (
            select doc_id, first_value(doc_id) over (partition by s order by n desc, doc_id) as keep_id,
                   count(*) over (partition by s) as group_size, s
            from n
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, s as text_sha256 from g
    """,
    "op6_decontamination": r"""
        with d as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[0-9a-z\x{80}-\x{10FFFF}]+') as w
            from documents
        ), b as (
            select item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[0-9a-z\x{80}-\x{10FFFF}]+') as w
            from benchmark
        ), sized as (
            select item_id, w, least(10, len(w)) as size from b where len(w) > 0
        ), starts as (
            select item_id, w, size, unnest(range(1, len(w) - size + 2)) as k from sized
        ), windows as (
            select distinct item_id, size, array_to_string(w[k:k + size - 1], ' ') as gram from starts
        ), sizes as (
            select distinct size from windows
        ), places as (
            select doc_id, size, w, unnest(range(1, len(w) - size + 2)) as k from d, sizes
        ), met as (
            select p.doc_id, p.k, p.size, x.item_id
            from places p join windows x on x.size = p.size and x.gram = array_to_string(p.w[p.k:p.k + p.size - 1], ' ')
        ), hit as (
            select doc_id, count(distinct word) as n_hit
            from (select doc_id, unnest(range(k, k + size)) as word from met) group by doc_id
        ), items as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
            from (select distinct doc_id, cast(item_id as varchar) as item from met) group by doc_id
        )
        select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join items using (doc_id)
    """,
    "op5_url_filter": r"""
        with r as (
            select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest
            from pages
        ), h as (
            select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from r
        ), u as (
            select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
            from h
        ), w as (
            select *, case
                when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
                when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
                when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
                when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/'
            end as rule
            from u
        )
        select page_id, host, path, rule,
               case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
        from w
    """,
    "op12_ngram_join": r"""
        with recursive d as materialized (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') as w
            from documents
        ), starts as (
            select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as k from d where len(w) > 0
        ), grams as materialized (
            select distinct doc_id, array_to_string(w[k:k + 3], ' ') as gram from starts
        ), sizes as materialized (
            select doc_id, count(*) as n from grams group by doc_id
        ), shared as (
            select a.doc_id as x, b.doc_id as y, count(*) as n
            from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
        ), links as materialized (
            select x, y from shared s join sizes a on a.doc_id = s.x join sizes b on b.doc_id = s.y
            where 100 * s.n >= 85 * (a.n + b.n - s.n)
        ), reached as (
            select doc_id, doc_id as other from d union select r.doc_id, l.y from reached r join links l on l.x = r.other
        ), least as (
            select doc_id, min(other) as component_id from reached group by doc_id
        )
        select d.doc_id, coalesce(n, 0) as n_shingles, component_id
        from d left join sizes using (doc_id) join least using (doc_id)
    """,
    "op13_divergence": r"""
        with d as materialized (
            select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
            from documents
        ), words as (
            select doc, lang, source, unnest(w) as term from d
        ), kept as materialized (
            select lang, term, count(*) as n from words group by lang, term having count(distinct doc) >= 10
        ), langs as (
            select lang, sum(n) as total, count(*) as v from kept group by lang
        ), q as materialized (
            select k.lang, term, 1 + (1000000000 * (n + 2)::hugeint) // (total + 2 * v)::hugeint as q
            from kept k join langs l on l.lang = k.lang
        ), used as materialized (
            select lang, source, term, count(*) as n from words join kept using (lang, term) group by lang, source, term
        ), groups as materialized (
            select distinct lang, source from d
        ), totals as (
            select lang, source, sum(n) as total from used group by lang, source
        ), p as materialized (
            select g.lang, g.source, k.term, coalesce(u.n, 0) as n,
                   1 + (1000000000 * (coalesce(u.n, 0) + 2)::hugeint) // (coalesce(t.total, 0) + 2 * l.v)::hugeint as p
            from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang
            left join totals t on t.lang = g.lang and t.source = g.source
            left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term
        ), pairs as (
            select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
            from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source
            group by a.lang, a.source, b.source
        ), every_pair as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
        ), terms as (
            select p.lang, p.source, 'term' as part, p.term as item, ((p - q) * (p - q) // (p + q))::bigint as value
            from p join q on q.lang = p.lang and q.term = p.term where n > 0 and p > q
        ), ranked as (
            select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
            from (select * from every_pair union all select * from terms)
        )
        select * from ranked where part = 'pair' or rank <= 10
    """,
}
