"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm.bpe import op1_bpe
from usagelens.llm.byte_bpe import op12_byte_bpe
from usagelens.llm.chat import op5_chat
from usagelens.llm.decontaminate import op3_decontamination
from usagelens.llm.divergence import op13_divergence
from usagelens.llm.fingerprints import op8_fingerprints
from usagelens.llm.jaccard import op2_jaccard
from usagelens.llm.quality import op6_quality
from usagelens.llm.shards import op4_sharding
from usagelens.llm.suffix_dedup import op9_suffix_dedup
from usagelens.llm.toxicity import op7_toxicity
from usagelens.llm.urls import op10_url_filter
from usagelens.llm.whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_jaccard, op3_decontamination, op4_sharding, op5_chat, op6_quality, op7_toxicity, op8_fingerprints, op9_suffix_dedup, op10_url_filter, op11_whitening, op12_byte_bpe, op13_divergence)}


#: DuckDB over whole tables. The others have no SQL (a tokenizer, trained models, seeded shuffles and walks) or
#: none that is quick on whole tables; tests hold them against brute force.
SQL = {
    "op3_decontamination": """
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
items as (
  select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
windows as (
  select item_id, m, list_slice(w, i, i + m - 1) g
  from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) i from (select item_id, w, least(10, len(w)) m from items where len(w) > 0))),
sizes as (select distinct m from windows),
places as (
  select doc_id, m, i, list_slice(w, i, i + m - 1) g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from words, sizes where len(w) >= m)),
hits as (select doc_id, p.m, i, item_id from places p join windows v on p.m = v.m and p.g = v.g),
hit_words as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + m)) p from hits) group by 1),
hit_items as (select doc_id, count(distinct item_id) n, string_agg(distinct item_id, ',' order by item_id) ids from hits group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(h.n, 0) as bigint) n_hit, cast(coalesce(t.n, 0) as bigint) n_items,
  sha256(coalesce(t.ids, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated
from words left join hit_words h using (doc_id) left join hit_items t using (doc_id)""",
    "op13_divergence": """
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') text from documents),
occurring as (select distinct lang, source from d),
words as (
  select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
kept as (select lang, term, count(*) n from words group by lang, term having count(distinct id) >= 30),
own as (select lang, source, term, count(*) n from words join kept using (lang, term) group by all),
langs as (select lang, count(*) v, sum(n) total from kept group by lang),
totals as (select lang, source, sum(n) total from own group by all),
grid as (
  select o.lang, o.source, k.term, coalesce(w.n, 0) n,
    1 + (1000000000::hugeint * (coalesce(w.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) p, 1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) q
  from occurring o join kept k using (lang) join langs l using (lang)
  left join own w on w.lang = o.lang and w.source = o.source and w.term = k.term left join totals t on t.lang = o.lang and t.source = o.source),
apart as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(x.value, 0) as bigint) value
  from occurring a join occurring b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' part, term item, cast(p - q as bigint) value from grid where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) rank from (from pairs union all from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
