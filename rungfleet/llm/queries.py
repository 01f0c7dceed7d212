"""The queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment, jaccard_join, licenses, mixing, passages, quality_rules, repeats, secret_ledger, token_counts, toxicity, url_lists, vector_codes, whitening
from .common import table


def op1_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"))


def op2_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_classes(table(spark, sf_dir, "documents"))


def op3_nearest_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op5_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures fetched on a day that follows their id, against list
    events that follow their hosts: hosts are listed, taken off after 45 days and
    some listed again; some hosts' ``/en`` pages and one kind of parent domain
    are listed for good."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched"))
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("h")).where("h <> ''").distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    size = F.length("h")
    first = (size * 53) % 300
    event = lambda key, action, at: F.struct(key.alias("key"), F.lit(action).alias("action"), day(at).alias("effective"))
    none = F.array().cast("array<struct<key:string,action:string,effective:date>>")
    events = hosts.select(
        F.explode(
            F.concat(
                F.when(size % 2 == 0, F.array(event(F.col("h"), "add", first), event(F.col("h"), "remove", first + 45))).otherwise(none),
                F.when(size % 4 == 0, F.array(event(F.col("h"), "add", first + 100))).otherwise(none),
                F.when(size % 3 == 1, F.array(event(F.concat("h", F.lit("/en")), "add", (size * 31) % 330))).otherwise(none),
            )
        ).alias("e")
    ).select("e.*")
    parents = hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("p")).where("length(p) = 11").distinct()
    events = events.union(parents.select("p", F.lit("add"), day(F.lit(340))))
    return url_lists.filter_captures(pages, events).select("page_id", "host", "fetched", "blocked", "matched_key", "listed_since")


def op7_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.scan_secrets(table(spark, sf_dir, "documents"))


def op13_adaptive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_run_length_repeats, op2_compact_window_passages, op3_nearest_labelled, op4_jaccard_groups, op5_license_paragraphs, op6_temporal_url_lists, op7_whole_token_counts, op8_risk_controlled_rules, op9_source_mix, op10_benchmark_containment, op11_exact_whitening, op12_blob_ledger, op13_adaptive_codes)}

#: The parts of the oracle that fix the same words and grids as the operators.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP9 = rf"""
with sized as (
  select doc_id, source, cast(len({_WORDS}) as bigint) size,
    md5(coalesce(cast(doc_id as varchar), '')) k, md5(coalesce(text, '')) tie
  from documents),
s as (select source, cast(sum(size) as bigint) source_size from sized group by 1),
r as (select *, row_number() over (order by source nulls last) rk from s),
w as (select *, cast([5, 2, 1][cast((rk - 1) % 3 as int) + 1] as bigint) weight, source_size * 3 cap from r),
v as (select *, cast(cap as double) / weight ratio from w),
u as (select *,
    sum(cap) over (order by ratio, rk rows unbounded preceding) - cap cap_before,
    sum(weight) over (order by ratio, rk rows between current row and unbounded following) weight_from,
    sum(source_size) over () total from v),
l as (select *, cast(total - cap_before as double) / weight_from lev from u),
t as (select *, max(case when lev < ratio then lev end) over () lam from l),
g as (select source, source_size, case when lev >= ratio then cast(cap as double) else weight * lam end target from t),
b as (select *, cast(floor(target + 0.5) as bigint) budget from g),
e as (select *, case when source_size > 0 then budget // source_size else 0 end epochs from b),
p as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size rest,
    sum(d.size) over (partition by d.source order by d.k, d.size, d.tie rows unbounded preceding) - d.size before
  from sized d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target,
  cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) taken
from p"""

_OP10 = rf"""
with d as (select doc_id id, {_WORDS.replace('text', 'lower(text)')} w from documents),
b as (select item_id id, {_WORDS.replace('text', 'lower(text)')} w from benchmark),
dg as (select distinct id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
bg as (select distinct id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from b),
n as (select id, count(*) item_shingles from bg group by 1)
select dg.id doc_id, bg.id item_id, item_shingles, count(*) shared
from dg join bg using (g) join n on n.id is not distinct from bg.id
group by 1, 2, 3 having count(*) * 10 >= item_shingles * 8"""

_RULES = "\n  union all ".join(
    f"select stratum, n_good, '{rule}' as rule, {c} as cutoff, (select count(*) from good g where g.stratum = s.stratum and g.{rule} > {c}) as k from s"
    for rule, cs in quality_rules.GRID.items()
    for c in cs
)
_SHARE = quality_rules.ALLOWANCE / len(quality_rules.GRID)
_TESTS = sum(map(len, quality_rules.GRID.values()))

_OP8 = rf"""
with d as (select row_number() over () rid, doc_id, lang, coalesce(text, '') text, {_WORDS} w from documents),
x as (select rid, unnest(w) word, unnest(range(1, len(w) + 1)) i from d),
win as (select rid, i, array_to_string(list(word) over (partition by rid order by i rows between current row and 7 following), ' ') k, lead(i, 7) over (partition by rid order by i) full_ from x),
rep as (select rid, i, count(*) over (partition by rid, k) n from win where full_ is not null),
cov as (select rid, count(distinct p) r from (select rid, unnest(range(i, i + 8)) p from rep where n > 1) group by 1),
ln as (select rid, count(*) n_lines, count(*) - count(distinct line) dup from (select rid, unnest(string_split(text, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select d.doc_id, coalesce('lang ' || lang, 'none') stratum, cast(len(w) as bigint) n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) n_symbols,
    cast(coalesce(dup, 0) as bigint) n_dup_lines, cast(coalesce(r, 0) as bigint) n_repeat_words, coalesce(n_lines, 0) n_lines
  from d left join cov using (rid) left join ln using (rid)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
    case when n_words > 0 then cast(n_symbols as double) / n_words else 0 end symbols_per_word,
    case when n_lines > 0 then cast(n_dup_lines as double) / n_lines else 0 end duplicate_line_share,
    case when n_words > 0 then cast(n_repeat_words as double) / n_words else 0 end repeated_word_share,
    case when n_words > 0 then cast(word_chars as double) / n_words else 0 end chars_per_word from m),
good as (select f.* from f where not base_failed and doc_id in (select doc_id from labels where doc_id is not null group by 1 having max(quality) = 1)),
s as (select stratum, count(*) n_good from good group by 1),
c as ({_RULES}),
pv as (select *, (select count(*) from s) strata, case when k < n_good * {_SHARE} then
    list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({_SHARE}) + (n_good - j) * ln(1 - {_SHARE})))) else 1 end p from c),
best as (select stratum, rule, min(cutoff) cutoff from pv where p <= {quality_rules.DELTA} / ({_TESTS} * strata) group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from best where best.stratum = f.stratum and
    case rule when 'symbols_per_word' then symbols_per_word when 'duplicate_line_share' then duplicate_line_share
      when 'repeated_word_share' then repeated_word_share else chars_per_word end > cutoff) kept
from f"""

_OP4 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from d),
u as (select doc_id, len(s) n, unnest(s) t from g),
p as (select a.doc_id x, b.doc_id y from u a join u b on a.t = b.t and a.doc_id < b.doc_id and a.n * 10 >= b.n * 9 and b.n * 10 >= a.n * 9
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select x, y from p union select y, x from p),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select doc_id, cast(len(s) as bigint) n_shingles, least(doc_id, coalesce((select min(y) from r where r.x = g.doc_id), doc_id)) component_id from g"""

_OP6 = r"""
with p as (select page_id, url, date '2024-01-01' + cast(page_id % 365 as int) fetched,
    lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') parts from pages),
h as (select distinct host h, length(host) n from p where host <> ''),
ev as (select h k, 'add' a, (n * 53) % 300 d from h where n % 2 = 0
  union all select h, 'remove', (n * 53) % 300 + 45 from h where n % 2 = 0
  union all select h, 'add', (n * 53) % 300 + 100 from h where n % 4 = 0
  union all select h || '/en', 'add', (n * 31) % 330 from h where n % 3 = 1
  union all select distinct regexp_extract(h, '([^.]+\.[^.]+)$', 1), 'add', 340 from h where length(regexp_extract(h, '([^.]+\.[^.]+)$', 1)) = 11),
grp as (select k, d, max(case when a = 'remove' then 1 else 0 end) rm from ev group by 1, 2),
iv as (select k, date '2024-01-01' + cast(d as int) f, rm, date '2024-01-01' + cast(lead(d) over (partition by k order by d) as int) t from grp),
ks as (select page_id, fetched, unnest(list_concat(
    list_transform(range(2, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), len(string_split(host, '.')) - i + 1, len(string_split(host, '.'))), '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) k from p where host <> ''),
hit as (select page_id, max_by(ks.k, length(ks.k)) matched_key, max_by(iv.f, length(ks.k)) listed_since from ks join iv on ks.k = iv.k and iv.rm = 0 and ks.fetched >= iv.f and (iv.t is null or ks.fetched < iv.t) group by 1)
select page_id, host, fetched, matched_key is not null blocked, matched_key, listed_since from p left join hit using (page_id)"""

def _letters(word: str) -> str:
    """A pattern of ``word`` with its letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Pattern, group and fewest characters of each kind; RE2 folds more than ASCII letters, so cases are spelled out.
_KINDS = {r.kind: (r.pattern, r.group, r.least) for r in secret_ledger.RULES}
_KINDS["assign"] = ("(" + "|".join(map(_letters, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + _KINDS["assign"][0].partition(")")[2], 2, 8)


def _kind_sql(order: int, kind: str) -> str:
    """Matches of a kind in order, each with the text between it and the one before."""
    pattern, group, least = _KINDS[kind]
    p = pattern.replace("'", "''")
    return f"""select rid, {order} as o, '{kind}' as kind, unnest(m) m, unnest(p[1:len(m)]) p, unnest(range(1, len(m) + 1)) i, unnest(list_transform(m, lambda x: length(regexp_extract(x, '{p}', {group})) >= {least})) ok
  from (select rid, regexp_extract_all(t, '{p}') m, string_split_regex(t, '{p}') p from d) q where len(m) > 0"""


_OP12 = f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
x as ({" union all ".join(_kind_sql(i, k) for i, k in enumerate(_KINDS))}),
y as (select rid, o, kind, ok, length(m) n, sum(length(p)) over w + sum(length(m)) over w - length(m) a from x window w as (partition by rid, o order by i rows unbounded preceding)),
z as (select rid, count(*) filter (where o = 0) n_assign, count(*) filter (where o = 1) n_access, count(*) filter (where o = 2) n_hex,
  string_agg(concat(kind, ':', cast(a as varchar), ':', cast(a + n as varchar)), ',' order by a, o) filter (where o < 3) base, string_agg(concat(kind, ':', cast(a as varchar), ':', cast(a + n as varchar)), ',' order by a, o) spans from y where ok group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join z using (rid)"""

ORACLE_SQL = {"op6_temporal_url_lists": _OP6, "op4_jaccard_groups": _OP4, "op8_risk_controlled_rules": _OP8, "op9_source_mix": _OP9, "op10_benchmark_containment": _OP10, "op12_blob_ledger": _OP12}
