"""Queries over the text tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import (
    audit,
    conversations,
    decontaminate,
    jaccard,
    language,
    pieces,
    quality,
    ranking,
    recurrent,
    secrets,
    shards,
    substring,
    toxicity,
)
from quadrat.llm.common import table

#: Place of the vocabulary of op9; None means the installed package of public tokenizers.
TOKENIZER_PATH: str | None = None


def tokenizer_path() -> str:
    if TOKENIZER_PATH:
        return TOKENIZER_PATH
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the rule cascade."""
    docs = table(spark, folder, "documents")
    # which rule rejected first depends on measured costs, so it isn't part of the result
    return quality.judge(docs, quality.cascade(docs)).drop("rejected_by")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more that stand in two documents."""
    return substring.repeated_passages(table(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language by shortest code."""
    return language.identify(table(spark, folder, "documents"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets by pattern and by the name they are assigned to."""
    return secrets.scan(table(spark, folder, "documents"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Eight equal shards, and where rows go with a ninth."""
    return shards.assign(table(spark, folder, "documents"), weights=[1.0] * 8)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_quality_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Quality by pairwise ranking."""
    return ranking.rank_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated chance of toxicity."""
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Exact piece ids and the text they decode to, as digests."""
    return pieces.encode(table(spark, folder, "documents"), pieces.load_vocabulary(tokenizer_path()))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents that share 85 % of their 4-word shingles."""
    return jaccard.join(table(spark, folder, "documents"), rule=jaccard.Rule(words=4, percent=85))


def op11_recurrent_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log-likelihood of each text under word counts and under the recurrent model."""
    return recurrent.score_texts(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each filter does at each step of each order, by source."""
    return audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of damaged conversations."""
    return conversations.audit(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_substring_dedup, op3_language_id, op4_secret_scan, op5_sharding, op6_decontamination,
        op7_quality_ranking, op8_toxicity, op9_piece_codec, op10_jaccard_join, op11_recurrent_lm, op12_filter_audit,
        op13_conversation_repair,
    )
}

_SPACE = r"\x20\x09-\x0D"

#: The verdict of op1 is the conjunction of all rules, whatever their order.
OP1_SQL = rf"""
with base as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') as ws from documents
), words as (
  select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from base
), triples as (
  select a.doc_id, a.i, a.w as w1, b.w as w2, c.w as w3
  from words a join words b on a.doc_id = b.doc_id and b.i = a.i + 1 join words c on a.doc_id = c.doc_id and c.i = a.i + 2
), often as (
  select doc_id, w1, w2, w3 from triples group by all having count(*) > 1
), covered as (
  select distinct t.doc_id, t.i + k.k as i
  from triples t join often using (doc_id, w1, w2, w3) cross join (select unnest(range(0, 3)) as k) k
), repeats as (
  select doc_id, count(*) as n from covered group by doc_id
), lines as (
  select doc_id, unnest(string_split(t, chr(10))) as line from base
), full_lines as (
  select doc_id, count(*) as n, count(*) - count(distinct line) as dup from lines where regexp_matches(line, '[^{_SPACE}]') group by doc_id
), counts as (
  select doc_id, cast(len(ws) as bigint) as n_words,
    cast(length(regexp_replace(t, '[{_SPACE}]', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup, 0) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
    coalesce(f.n, 0) as n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as caps,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as letters,
    strlen(t) - strlen(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) as beyond, strlen(t) as size
  from base left join repeats r using (doc_id) left join full_lines f using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words
    or (n_dup_lines >= 3 and 2 * n_dup_lines > n_lines)
    or word_chars < 2 * n_words or word_chars > 15 * n_words
    or 2 * caps > letters or 2 * (letters + beyond) < size) as kept
from counts
"""

#: All orders of the five filters as joins; the failures of a text as a list of letters.
OP12_SQL = rf"""
with texts as (
  select doc_id, coalesce(text, '') as t, coalesce(source, '') as part, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') as ws
  from documents
), marks as (
  select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels where doc_id is not null group by doc_id
), least as (
  select t, min(doc_id) as smallest from texts group by t
), rows as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(ws) < 50 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 2 else 0 end
    + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when coalesce(doc_id > smallest, false) then 16 else 0 end as fails
  from texts join least using (t) left join marks using (doc_id)
), patterns as (
  select part, fails, count(*) as n, sum(good::int) as n_good, sum(toxic::int) as n_toxic from rows group by all
), letters(letter, bit) as (
  values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a join letters b on b.letter <> a.letter join letters c on c.letter not in (a.letter, b.letter)
    join letters d on d.letter not in (a.letter, b.letter, c.letter) join letters e on e.letter not in (a.letter, b.letter, c.letter, d.letter)
), steps as (
  select filter_order, step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as integer) as earlier
  from orders, (select unnest(range(1, 6)) as step)
), effects as (
  select part, filter_order, step, bit,
    sum(case when fails & (earlier | bit) = 0 then n else 0 end) as kept,
    sum(case when fails & bit <> 0 and fails & earlier = 0 then n else 0 end) as removed,
    sum(case when fails & bit <> 0 and fails & earlier <> 0 then n else 0 end) as redundant,
    sum(case when fails = bit then n else 0 end) as unique_fails,
    sum(case when fails & bit <> 0 and fails & earlier = 0 then n_good else 0 end) as good_lost,
    sum(case when fails & bit <> 0 and fails & earlier = 0 then n_toxic else 0 end) as toxic_lost
  from patterns cross join steps group by all
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from effects
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op12_filter_audit": OP12_SQL}
