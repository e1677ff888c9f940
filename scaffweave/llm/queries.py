"""The numbered queries of the corpus operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_prototypes, identify_languages

    docs = table(spark, sf_dir, "documents")
    judged = identify_languages(docs, fit_prototypes(docs), keep=["doc_id"])
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls, rules_frame

    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), 24)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def repeat_tails(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, of every tenth document by a hash of its id with the words from some place on replaced by repeats of
    the next few: words i >= a by word a + (i - a) % p. Null ids count as other documents."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " "))

    # the words are bound to a variable, so that they are found once
    return F.coalesce(F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]), F.col(text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import find_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", repeat_tails().alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = find_runs(docs).withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def misspelt_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the letter runs of the texts, each run that a hash of it and its document picks without one letter."""
    runs = word_runs_of(docs)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % F.length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    words = runs.select(F.when(F.coalesce(h % 199 == 0, F.lit(False)), cut).otherwise(F.col("word")).alias("word"))
    return words.filter(F.length("word") >= 6).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 5")


def word_runs_of(docs: DataFrame) -> DataFrame:
    from .spelling import word_runs

    return word_runs(docs, keep=["doc_id"])


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(misspelt_words(table(spark, sf_dir, "documents")))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _rules():
    from .urls import RULES

    return RULES


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_language_id, op3_best_fit_packing, op4_toxicity, op5_decontamination,
        op6_embedding_dedup, op7_url_filters, op8_sharding, op9_minhash_dedup, op10_quality, op11_periodic_runs, op12_spelling_variants, op13_exact_topk,
    )
}

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: The same results stated without the methods. Learned models, token ids, CRC-32 and shard hashes have none.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
        windows as (select doc_id, i, array_to_string(w[i:i + 49], ' ') x from (select doc_id, w, unnest(range(1, len(w) - 48)) i from docs where len(w) >= 50)),
        gone as (select distinct doc_id, unnest(range(i, i + 50)) k from (select doc_id, i, min(doc_id) over (partition by x) first_id from windows) where first_id < doc_id),
        kept as (select d.doc_id, string_agg(word, ' ' order by d.k) t, count(*) n from (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) k from docs) d
          left join gone g on g.doc_id = d.doc_id and g.k = d.k where g.k is null group by d.doc_id)
        select doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from docs left join kept using (doc_id)""",
    "op5_decontamination": rf"""
        with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
        items as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
        phrases as (select distinct item, least(len(w), 10) n, array_to_string(w[i:i + 9], ' ') x from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from items where len(w) > 0)),
        found as (select doc_id, i, p.n, item from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') x from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) i
          from docs cross join (select distinct n from phrases) where len(w) >= n)) d join phrases p on p.x = d.x and p.n = d.n),
        hits as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + n)) k from (select distinct doc_id, i, n from found)) group by doc_id),
        named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) t from (select distinct doc_id, item from found) group by doc_id)
        select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(t, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from docs left join hits using (doc_id) left join named using (doc_id)""",
    "op6_embedding_dedup": """
        with recursive v as (select vec_id, cast(embedding as double[]) e from embeddings),
        ok as (select * from v where e is not null and len(e) > 0 and list_aggregate(list_transform(e, lambda x: x is not null and isfinite(x)), 'bool_and') and list_aggregate(list_transform(e, lambda x: x <> 0), 'bool_or')),
        links as (select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
        reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
        select vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(low, vec_id)) component_id, vec_id = least(vec_id, coalesce(low, vec_id)) kept
        from v left join (select a, count(*) n from links group by a) x on x.a = vec_id left join (select a, min(b) low from reach group by a) y on y.a = vec_id""",
    "op7_url_filters": f"""
        with rules as (select * from (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in _rules())}) t(h, p, v)),
        cut as (select page_id, row_number() over () k, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end rest from pages),
        parts as (select page_id, k, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_CAPITALS}) host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut),
        fits as (select page_id, k, host, path, h || p rule, v, row_number() over (partition by k order by length(h || p) desc nulls last) best
          from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
        select page_id, host, path, rule, coalesce(v, 'allow') verdict from fits where best = 1""",
    "op9_minhash_dedup": rf"""
        with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x20\x09-\x0D]+') w from documents),
        shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') x from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from docs where len(w) > 0)),
        sizes as (select doc_id, count(*) n from shingles group by doc_id),
        links as (select a, b from (select s.doc_id a, t.doc_id b, count(*) k from shingles s join shingles t using (x) where s.doc_id <> t.doc_id group by all) join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)),
        reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
        select doc_id, coalesce(n, 0) n_shingles, least(doc_id, coalesce(low, doc_id)) component_id, doc_id = least(doc_id, coalesce(low, doc_id)) kept
        from docs left join sizes using (doc_id) left join (select a, min(b) low from reach group by a) y on y.a = doc_id""",
    "op13_exact_topk": """
        with v as (select vec_id, row_number() over () k, cast(embedding as double[]) e from embeddings),
        ok as (select vec_id, k, list_transform(e, lambda x: floor(256 * x)) c from v where e is not null and coalesce(list_aggregate(list_transform(e, lambda x: x is not null and isfinite(x)), 'bool_and'), true)),
        pairs as (select q.vec_id query_id, q.k, d.vec_id, cast(list_inner_product(q.c, d.c) as bigint) score from ok q join ok d on q.k <> d.k and len(q.c) = len(d.c) where q.vec_id % 50 = 0)
        select query_id, cast(place as int) rank, vec_id, score from (select *, row_number() over (partition by k order by score desc, vec_id) place from pairs) where place <= 5""",
}
