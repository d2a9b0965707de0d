"""The queries opN_<name> over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.llm import bpe, centroids, chat, counts, html, jaccard, mixing, pii, quality, resampling, search, suffix, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask("base"))) != 0
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        quality.kept(F.col("fail_bits")).alias("kept"),
        "fail_bits",
    )


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy removes, from the stored ledger of operator 8."""
    return quality.ablations(runtime.materialize(quality.ledger(table(spark, sf_dir, "documents")), "ledger"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.takes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: Rules of ``url_walks``: trust starts at the first level of its hosts, distrust at the last, and two hosts between have their own.
WALK_RULES = (
    urls.Rule("allow", "l0.org", "/a"),
    urls.Rule("block", "l8.org", "/b"),
    urls.Rule("allow", "n1.l4.org", "/"),
    urls.Rule("block", "n2.l4.org", "/"),
)


def _walk_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and html of a graph of hosts that follows from the page ids: four pages a host, nine levels, each page links to
    its host's own place on the next level, to the place half as far, and to one of five hosts that a level's pages share."""
    level, place = F.col("page_id") % 9, F.floor(F.col("page_id") / 36)
    link = lambda to: F.concat(F.lit('<a href="http://n'), to.cast("string"), F.lit(".l"), (level + 1).cast("string"), F.lit('.org/">x</a>'))
    url = F.concat(F.lit("https://n"), place.cast("string"), F.lit(".l"), level.cast("string"), F.lit(".org/"), F.substring(F.lit("abc"), (F.floor(F.col("page_id") / 9) % 3 + 1).cast("int"), F.lit(1)))
    html = F.when(level < 8, F.concat(link(place), link(F.floor(place / 2)), link(F.col("page_id") * 7 % 5)))
    return pages.select("page_id", url.alias("url"), html.alias("html"))


def url_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 where the walks decide: the longest way has eight links, so the SQL's steps are enough."""
    rows = urls.verdicts(_walk_pages(table(spark, sf_dir, "pages")), rules=WALK_RULES)
    return rows.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search.top_k(vectors, vectors.where(search.every("vec_id", 50)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{runtime.scratch_folder(spark, 'token-counts')}/cache"
    rows = counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return rows.withColumn("over_limit", F.col("n_tokens") > counts.LIMIT)


def counts_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of operator 5 in three runs over one cache: an earlier batch (English), all documents, and all again, which encodes none."""
    docs, model, cache = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), f"{runtime.scratch_folder(spark, 'token-counts')}/cache"
    counts.fill(docs.where("lang = 'en'"), model, cache)
    counts.fill(docs, model, cache)
    return counts.count_tokens(docs, model, cache)


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.EXAMPLE_KEY)
    return rows.select("doc_id", "text", F.size("spans").cast("long").alias("n_replaced"), "spans")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.main_text(table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), jaccard.Rule(width=4, percent=85))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.remove_matches(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: The conversation that the query adds to the table: both its turns say what the template marks turns with.
CLASHING = -7, "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv_id, said = CLASHING
    added = spark.createDataFrame([(conv_id, turn, role, said) for turn, role in enumerate(("user", "assistant"))], own.schema)
    formatted = chat.format_turns(own.unionByName(added))
    return chat.read_back(formatted, chat.turn_columns(own))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.rows.select("doc_id", "n_features", "weight", "score", "rank")


SQL: dict[str, str] = {}

SQL["op8_quality_ledger"] = r"""
with d as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls
  from documents),
win as (
  select doc_id, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + k) as n_repeat_words from rep, range(8) r(k) group by doc_id),
m as (
  select d.doc_id, len(w)::bigint as n_words,
         coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         len(ls)::bigint as n_lines,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(len([1 for i in range(2, len(w) + 1) if w[i] = w[i - 1]]), 0)::bigint as n_stutter,
         length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_shouts
  from d left join cov c on d.doc_id = c.doc_id),
b as (
  select *, (n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint
    + 4 * (10 * n_symbols > n_words)::bigint + 8 * (2 * n_dup_lines > n_lines)::bigint
    + 16 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint
    + 32 * (100 * n_stutter > 30 * n_words)::bigint + 64 * (4 * n_shouts > n_words)::bigint as fail_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed, fail_bits = 0 as kept, fail_bits
from b
"""

SQL["ledger_ablations"] = f"with q as ({SQL['op8_quality_ledger']}) " + " union all ".join(
    f"select '{name}' as rule, count(*) filter (fail_bits & {quality.BIT[name]} <> 0) as n_failed, count(*) filter (fail_bits = {quality.BIT[name]}) as n_failed_alone, "
    f"count(*) filter (fail_bits in (0, {quality.BIT[name]})) as n_kept_without from q"
    for name in quality.POLICIES[quality.CURRENT]
)

SQL["op7_mix_sources"] = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('17|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as o
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as r from d group by source),
w as (select *, 1 + r % 3 as weight, 3 * source_size as cap from s),
l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0))::double / (sum(weight) over () - coalesce(sum(weight) over b, 0))::double as level
  from w window b as (order by cap / weight, r rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(max(level) over () * weight, cap::double) as target from l),
p as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as whole,
         coalesce(sum(d.size) over (partition by d.source order by d.o, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (whole + (before + size / 2.0 < target - whole * source_size)::bigint))::bigint as taken
from p
"""

SQL["op2_topk_search"] = r"""
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as q from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""

SQL["op4_jaccard_join"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as x
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.c) as component_id
from documents d left join n on n.doc_id = d.doc_id join r on r.doc_id = d.doc_id group by all
"""


def _propagation_sql() -> str:
    """The steps of ``urls.propagate``, one common table expression a step."""
    steps = ["s0 as (select kind, host, score from start where score > 0)"]
    for i in range(urls.ROUNDS):
        steps.append(
            f"s{i + 1} as (select kind, host, sum(score) as score from (select m.kind, m.dst as host, {urls.DAMPING} * s.score * m.share as score "
            f"from s{i} s join moves m on m.kind = s.kind and m.host = s.host union all select kind, host, {1 - urls.DAMPING} * score from s0) group by all)"
        )
    return ",\n".join(steps)


_FITS = "(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
_HOST = "translate(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _urls_sql(rules, pages: str = "pages", more: str = "") -> str:
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    return rf"""
with p as (
  select page_id, html, coalesce({_HOST.format(url="url")}, '') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from {pages}),
r as (
  select *, case {" ".join(f"when {_FITS.format(host=r.host, path=r.path)} then '{r.name}'" for r in longest)} end as rule,
         case {" ".join(f"when {_FITS.format(host=r.host, path=r.path)} then '{r.verdict}'" for r in longest)} end as ruled
  from p),
u as (select page_id, host as src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) as url from p),
k as (select distinct page_id, src, {_HOST.format(url="case when starts_with(url, '//') then 'http:' || url else url end")} as dst from u),
e as (select src, dst, count(*) as n from k where src <> dst and src <> '' and dst <> '' group by all),
moves as (
  select 'trust' as kind, src as host, dst, n / sum(n) over (partition by src) as share from e
  union all select 'distrust', dst, src, n / sum(n) over (partition by dst) from e),
h as (
  select host, count(*) filter (ruled = 'allow') as a, count(*) filter (ruled = 'block') as b from r where host <> '' group by host),
start as (
  select 'trust' as kind, host, coalesce(a / nullif(sum(a) over (), 0), 0) as score from h union all select 'distrust', host, b / sum(b) over () from h),
{_propagation_sql()},
f as (
  select host, coalesce(sum(score) filter (kind = 'trust'), 0) as trust, coalesce(sum(score) filter (kind = 'distrust'), 0) as distrust
  from s{urls.ROUNDS} group by host)
select page_id, r.host, path, rule,
       coalesce(ruled, case when coalesce(distrust, 0) > {urls.THRESHOLD} * coalesce(trust, 0) then 'block' else 'allow' end) as verdict{more}
from r left join f on r.host = f.host
"""


SQL["op10_url_filter"] = _urls_sql(urls.RULES)

_LINK_SQL = "'<a href=\"http://n' || {to} || '.l' || (level + 1) || '.org/\">x</a>'"
SQL["url_walks"] = _urls_sql(
    WALK_RULES,
    f"""(select page_id, 'https://n' || place || '.l' || level || '.org/' || ['a', 'b', 'c'][page_id // 9 % 3 + 1] as url,
         case when level < 8 then {" || ".join(_LINK_SQL.format(to=to) for to in ("place", "(place // 2)", "(page_id * 7 % 5)"))} end as html
         from (select page_id, page_id % 9 as level, page_id // 36 as place from pages))""",
    ", round(coalesce(trust, 0), 9) as trust, round(coalesce(distrust, 0), 9) as distrust",
)

_SIZES = " ".join(f"when '{role}' then {len(''.join(marks))}" for role, marks in chat.MARKS.items())
_OTHER = f"{len(chat.ROLE + chat.ROLE_END + chat.END)} + length(role) + len(regexp_extract_all(role, e))"

SQL["op11_chat_format"] = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {CLASHING[0]}, turn, role, '{CLASHING[1]}' from (values (0, 'user'), (1, 'assistant')) v(turn, role)),
m as (
  select *, (length(text) + len(regexp_extract_all(text, e)) + case role {_SIZES} else {_OTHER} end)::bigint as chars,
         (regexp_matches(text, e)::int + (role not in ('system', 'user', 'assistant') and regexp_matches(role, e))::int)::bigint as escaped
  from t, (select '{chat.LOOKALIKE}' as e))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars, sum(escaped)::bigint as n_escaped
from m group by conv_id
"""


def _rounds_sql() -> str:
    """The rounds of ``centroids.cluster``, two common table expressions a round."""
    steps = []
    for i in range(centroids.ROUNDS + 1):
        steps.append(
            f"a{i} as materialized (select vec_id, q, cluster, distance from (select v.vec_id, v.q, c.cluster, "
            f"(v.n + list_inner_product(c.q, c.q) - 2 * list_inner_product(v.q, c.q))::bigint as distance from v, c{i} c) "
            "qualify row_number() over (partition by vec_id order by distance, cluster) = 1)"
        )
        steps.append(
            f"c{i + 1} as materialized (select c.cluster, coalesce(m.q, c.q) as q from c{i} c left join (select cluster, list(x order by j) as q from "
            f"(select cluster, j, floor(sum(q[j]) / count(*)) as x from a{i}, range(1, {centroids.DIMS + 1}) r(j) group by all) group by cluster) m on m.cluster = c.cluster)"
        )
    return ",\n".join(steps[:-1])


SQL["op12_centroid_clusters"] = f"""
with v as materialized (
  select *, list_inner_product(q, q) as n from (
    select vec_id, [floor({centroids.SCALE} * x::double) for x in embedding] as q from embeddings
    where len(embedding) = {centroids.DIMS} and len([x for x in embedding if x is null or not isfinite(x)]) = 0)),
c0 as materialized (
  select row_number() over (order by h) - 1 as cluster, q from (select sha256('{centroids.SEED}:' || vec_id) as h, q from v) order by h limit {centroids.K}),
{_rounds_sql()}
select vec_id, a.cluster::integer as cluster, distance, (sum(distance) over (partition by a.cluster))::bigint as cluster_inertia,
       (sum(distance) over ())::bigint as inertia, sha256(array_to_string([x::bigint for x in c.q], ',')) as centroid_sha256
from a{centroids.ROUNDS} a join c{centroids.ROUNDS} c on c.cluster = a.cluster
"""

_DRAW = resampling.Rule()
#: The reflected polynomial of CRC-32 (a fixed value); the table of 256 entries follows from it.
_CRC = "3988292384"

SQL["op13_resampling"] = rf"""
with d as (
  select 's' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
f as materialized (select side, id, unnest(w) as w from d),
crc as (
  select list(c order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, {_CRC}) else a >> 1 end) as c from range(256) r(i))),
x as (select w, hex(encode(w)) as h from (select distinct w from f)),
b as materialized (
  select w, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 2 * i + 1, 2))::bigint for i in range(0, len(h) // 2)]),
                            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {_DRAW.buckets} as bucket
  from x, crc),
n as (select bucket, count(*) filter (side = 's') as s, count(*) filter (side = 't') as t from f join b using (w) group by bucket),
g as (
  select bucket, floor(1000 * ln((t + 1)::double * (select sum(s) + {_DRAW.buckets} from n)::double
                                 / ((s + 1)::double * (select sum(t) + {_DRAW.buckets} from n)::double))) as gain
  from n),
m as (select id, floor(sum(gain) / count(*))::bigint as weight from f join b using (w) join g using (bucket) where side = 's' group by id),
r as (
  select d.id as doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{_DRAW.seed}:' || d.id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from d left join m on m.id = d.id where side = 's'),
o as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as all_fit from r where n_features >= {_DRAW.least_words})
select r.*, case when rank <= {_DRAW.percent} * all_fit // 100 then rank end as rank from r left join o on o.doc_id = r.doc_id
"""


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        runtime.ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    own = {name: f for name, f in globals().items() if (name.startswith("op") or name in ("ledger_ablations", "counts_from_cache", "url_walks")) and callable(f)}
    return {name: _shipped(f) for name, f in own.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
