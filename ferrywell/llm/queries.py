"""The named queries of this subpackage, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywell.llm import (
    html_wrapper, jaccard_join, language_id, license_scan, line_dedup, packing, periodic_runs, phrase_graph, quality,
    sentencepiece_viterbi, suffix_dedup, token_rollup,
)
from ferrywell.llm.exact_dedup import ExactDedup
from ferrywell.session import Staged, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            EXPECTED[name] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


WORD = r"[^\x20\x09-\x0D]+"


@query("op3_line_dedup", rf"""
    with l as (
      select doc_id, line - 1 as line, list_distinct(regexp_extract_all(lines[line], '{WORD}')) as words
      from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as line
            from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))
      where regexp_matches(lines[line], '{WORD}')),
    s as (select list_sort(words) as words, min((doc_id, line)) as place, len(any_value(words)) as n from l group by 1),
    t as (select place, n, unnest(words) as word from s),
    f as (select word, count(*) as f from t group by word),
    r as (select place, n, t.word, row_number() over (partition by place order by f, t.word) as rk
          from t join f on f.word = t.word),
    p as (select * from r where rk <= n - ceil(0.8 * n - 1e-9) + 1),
    c as (select distinct x.place as later, y.place as earlier from p x join p y on x.word = y.word
          and x.place > y.place and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
    m as (select distinct c.later from c join s a on a.place = c.later join s b on b.place = c.earlier
          where 100 * len(list_intersect(a.words, b.words)) >= 80 * (a.n + b.n - len(list_intersect(a.words, b.words)))),
    g as (select l.doc_id, l.line from l join s on s.words = list_sort(l.words)
          where s.place <> (l.doc_id, l.line) or s.place in (select later from m)),
    e as (select doc_id, count(*) as n_lines from l group by doc_id),
    h as (select doc_id, list(cast(line as integer) order by line) as removed from g group by doc_id)
    select d.doc_id, coalesce(e.n_lines, 0) as n_lines, cast(coalesce(len(h.removed), 0) as bigint) as n_removed,
      coalesce(array_to_string(h.removed, ','), '') as removed
    from documents d left join e on e.doc_id = d.doc_id left join h on h.doc_id = d.doc_id""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.decisions(documents(spark, sf_dir))
    return found.withColumn("removed", F.array_join("removed", ","))


@query("op4_quality_rules", rf"""
    with d as (
      select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines
      from documents),
    grams as (
      select doc_id, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) as gram,
        unnest(range(1, len(words) - 6)) as place from d where len(words) >= 8),
    twice as (select doc_id, place, count(*) over (partition by doc_id, gram) as n from grams),
    covered as (
      select doc_id, count(distinct word) as n from (
        select doc_id, unnest(range(place, place + 8)) as word from twice where n > 1) group by doc_id),
    m as (
      select d.doc_id, cast(len(words) as bigint) as n_words,
        cast(length(array_to_string(words, '')) as bigint) as word_chars,
        cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(len(lines) as bigint) as n_lines,
        cast(coalesce(covered.n, 0) as bigint) as n_repeat_words,
        cast(len(regexp_extract_all(text, '\p{{Lu}}')) as bigint) as n_capitals,
        cast(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) as bigint) as n_stutter
      from d left join covered on covered.doc_id = d.doc_id),
    f as (
      select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
        (case when n_words < 20 then 1 else 0 end) + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
        + (case when 10 * n_symbols > n_words then 4 else 0 end)
        + (case when 100 * n_capitals > 30 * word_chars then 8 else 0 end)
        + (case when 10 * n_dup_lines > 4 * n_lines then 16 else 0 end)
        + (case when 10 * n_stutter > 2 * n_words then 32 else 0 end) as failed
      from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = 0 as kept,
      cast(failed as bigint) as failed from f""")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored, then the base policy and the current one are read from its bits."""
    lines = Staged(quality.ledger(documents(spark, sf_dir)), "quality-ledger").df
    return lines.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.kept(F.col("failed"), quality.BASE)).alias("base_failed"),
        quality.kept(F.col("failed")).alias("kept"), "failed")


@query("op7_exact_dedup", """
    with g as (
      select coalesce(text, '') as text, max(doc_id) as keep_id, count(*) as group_size
      from documents group by coalesce(text, ''))
    select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(g.text) as text_sha256
    from documents d join g on g.text = coalesce(d.text, '')""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ExactDedup(spark, new_folder(spark, "exact-dedup"))
    path = f"{sf_dir}/documents.parquet"
    state.ingest(path)
    return state.decisions(path).drop("file", "row")


def _templates_sql() -> str:
    rows = ", ".join(f"({i}, '{label}', '{' '.join(license_scan._plain_tokens(text))}')"
                     for i, (label, text) in enumerate(license_scan.TEMPLATES))
    return f"select k, label, list_distinct(string_split(words, ' ')) as wanted from (values {rows}) t(k, label, words)"


LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op8_license_scan", rf"""
    with d as (
      select row_number() over () as r, doc_id,
        translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}') as text from documents),
    w as (select r, doc_id, text, regexp_extract_all(text, '{LICENSE_WORD}') as words from d),
    s as (
      select r, doc_id, len(words) as n,
        list_filter(range(0, len(words)), lambda i: words[i + 1] = 'mit' and words[i + 2] = 'license') as mit,
        list_filter(range(0, len(words)), lambda i: words[i + 1] = 'apache' and words[i + 2] = 'license') as apache,
        list_filter(range(0, len(words)),
          lambda i: words[i + 1] = 'general' and words[i + 2] = 'public' and words[i + 3] = 'license') as gpl
      from w),
    t as ({_templates_sql()}),
    l as (
      select r, list_distinct(regexp_extract_all(array_to_string(lines[i:i + {license_scan.LINES - 1}], chr(10)), '{LICENSE_WORD}')) as held
      from (select r, lines, unnest(range(1, greatest(1, len(lines) - {license_scan.LINES - 1}) + 1)) as i
            from (select r, string_split(text, chr(10)) as lines from d))),
    hits as (
      select r, list(distinct label) as more, max(len(list_intersect(held, wanted)) / len(wanted)) as best
      from l join t on len(list_intersect(held, wanted)) >= ceil(0.8 * len(wanted) - 1e-9) group by r),
    b as (
      select *, list_concat(mit, apache, gpl) as places,
        list_concat(case when len(mit) > 0 then ['mit'] else [] end, case when len(apache) > 0 then ['apache'] else [] end,
          case when len(gpl) > 0 then ['gpl'] else [] end) as base from s)
    select doc_id, cast(n as bigint) as n_words, cast(len(places) as bigint) as n_base,
      cast(list_min(places) as bigint) as first_word, cast(list_max(places) as bigint) as last_word,
      coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ','), '') as labels,
      case when len(base) > 0 then 1.0 else coalesce(best, 0.0) end::double as score
    from b left join hits on hits.r = b.r""")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measured(documents(spark, sf_dir))


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(documents(spark, sf_dir), jaccard_join.Setting(width=3, percent=90))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = language_id.fold(F.col("doc_id")) == 1
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with an estimate, which the measured counts then revise; all leave and enter again; two batches come twice."""
    counts = Staged(token_rollup.count_tokens(documents(spark, sf_dir)), "token-counts").df
    estimates = documents(spark, sf_dir).select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.lit("estimate").alias("tokenizer"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("n_tokens"))
    rollup = token_rollup.TokenRollup(spark, new_folder(spark, "token-rollup"))
    batches = {
        "estimates": token_rollup.inserts(estimates),
        "measured": token_rollup.revisions(estimates, counts),
        "out": token_rollup.deletes(counts),
        "in again": token_rollup.inserts(counts),
    }
    for name in ("estimates", "measured", "measured", "out", "in again", "out"):
        rollup.commit(name, batches[name])
    rollup.merge()
    return rollup.totals()


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode(documents(spark, sf_dir), keep_ids=False)


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), keep_ids=False)


@query("op11_html_wrapper")
def op11_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect(documents(spark, sf_dir))


@query("op13_phrase_graph", rf"""
    with p as (
      select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
      from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
    o as (select lang, words, unnest(range(1, len(words) + 1)) as i from w),
    g as (
      select lang, size, array_to_string(words[i:i + size - 1], ' ') as phrase, cast(count(*) as hugeint) as f
      from (select *, unnest([1, 2, 3]) as size from o) where i + size - 1 <= len(words) group by 1, 2, 3),
    total as (select lang, sum(f) as n from g where size = 1 group by 1),
    c as (select lang, size, phrase, f as a, string_split(phrase, ' ') as words from g where size > 1 and f >= 10),
    longer as (
      select lang, array_to_string(words[1:2], ' ') as phrase, a from c where size = 3
      union all select lang, array_to_string(words[2:3], ' '), a from c where size = 3),
    free as (
      select * from c where not exists (
        select 1 from longer x where x.lang = c.lang and x.phrase = c.phrase and 100 * x.a >= 50 * c.a)),
    cuts as (
      select free.lang, free.phrase, a, k, l.f as l, r.f as r, (1000000 * a * a) // (l.f * r.f) as score
      from (select *, unnest(range(1, size)) as k from free) free
      join g l on l.lang = free.lang and l.phrase = array_to_string(words[1:k], ' ')
      join g r on r.lang = free.lang and r.phrase = array_to_string(words[k + 1:free.size], ' ')),
    weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weakest)
    select ranked.lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l,
      cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
    from ranked join total on total.lang = ranked.lang where rank <= 2000""")
def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.collocations(documents(spark, sf_dir))
