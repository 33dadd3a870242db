"""SQL for those queries of this folder that SQL can express."""

from __future__ import annotations

from turfgrid.llm import collocations, mixing, sharding, variants


def _hash(seed: int) -> str:
    return f"cast('0x' || substr(md5('{seed}' || coalesce(':' || doc_id, '')), 1, 12) as bigint)"


_SIZED = rf"""sized as materialized (select doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) size from documents)"""

MIXING = f"""with {_SIZED},
numbered as (select source, sum(size) source_size, row_number() over (order by source nulls last) - 1 k from sized group by source),
weighed as (select *, cast([5, 2, 1][k % 3 + 1] as double) weight, cast(2 as double) * source_size most from numbered),
levels as (select *, most / weight full_at from weighed),
fills as (select *, (cast(1.5 as double) * sum(source_size) over ()
  - coalesce(sum(most) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by full_at, source nulls last rows between current row and unbounded following) now_at from levels),
targets as (select *, coalesce((select f.now_at from fills f where f.now_at < f.full_at
  and (f.full_at < g.full_at or f.full_at = g.full_at and f.k <= g.k) order by f.full_at, f.k limit 1) * weight, most) target from fills g),
rated as (select s.doc_id, s.size, t.k, t.source_size, t.target,
  case when t.source_size > 0 then least(t.target / t.source_size, 2) else 0 end rate,
  (cast({_hash(mixing.SEED)} as double) + cast(0.5 as double)) / cast({1 << 48} as double) u
  from sized s join targets t on t.source is not distinct from s.source),
ordered as (select *, floor(rate) whole, target - sum(size * floor(rate)) over (partition by k) wanted,
  case when rate > floor(rate) then (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) end odds from rated),
summed as (select *, coalesce(sum(size) over (partition by k order by odds nulls last, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) earlier from ordered)
select doc_id, cast(size as bigint) size, cast(source_size as bigint) source_size, target,
 cast(size * (whole + case when odds is not null and earlier + size / cast(2 as double) <= wanted then 1 else 0 end) as bigint) taken from summed"""


# the table of the linear CRC, and the checksum of a string of hex digits with it
_CRC_TABLE = """steps as (select cast(n as bigint) n, cast(n as bigint) v, 0 i from (select unnest(range(0, 256)) n)
 union all select n, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i + 1 from steps where i < 8),
entries as materialized (select list(v order by n) e from steps where i = 8),
"""
_CRC = """case when h = '' then 0 else
 xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x as bigint))),
 lambda c, b: xor(c >> 8, e[cast(xor(c, b) & 255 as integer) + 1])), 4294967295) end"""

SHARDING = f"""with recursive {_CRC_TABLE}bytes as (select doc_id, source, text, coalesce(octet_length(encode(text)), 0) + 16 size, hex(encode(coalesce(text, ''))) h from documents),
summed as materialized (select doc_id, source, size, {_CRC} text_crc32 from bytes, entries),
ranked as (select *, dense_rank() over (order by source nulls last) number, count(*) over (partition by source) n,
 row_number() over (partition by source order by {_hash(sharding.SEED)}, doc_id) - 1 r from summed),
placed as (select *, row_number() over (order by cast(2 * r + 1 as double) / (2 * n), number, r) - 1 p, count(*) over () total from ranked),
cut as (select *, p * {sharding.SHARDS} // total shard from placed)
select doc_id, cast(size as bigint) size, cast(text_crc32 as bigint) text_crc32, 'rows' law, cast(shard as integer) shard,
 cast(p - (shard * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} as bigint) slot, cast(null as double) grown_shard from cut"""

_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

VARIANTS = rf"""with recursive {_CRC_TABLE}runs as (select doc_id, unnest(regexp_extract_all({_FOLDED}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) run from documents),
counted as (select doc_id, run, count(*) times, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) h from runs group by doc_id, run),
summed as materialized (select run, times, {_CRC} c from counted, entries),
misprinted as (select case when c % {variants.DAMAGE} = 0 then left(run, cast(c % length(run) as bigint)) || substr(run, cast(c % length(run) as bigint) + 2) else run end word, times from summed),
known as materialized (select word, cast(sum(times) as bigint) n from misprinted group by word having sum(times) >= {variants.LEAST} and length(word) >= {variants.SHORTEST}),
placed as (select word, n, unnest(range(0, length(word))) i from known),
skips as materialized (select distinct word, n, left(word, i) || '*' || substr(word, i + 2) gap, left(word, i) || substr(word, i + 2) less from placed),
near as materialized (select distinct one, other, n from (
 select a.word one, b.word other, b.n from skips a join skips b on a.gap = b.gap and a.word <> b.word
 union all select s.word, k.word, k.n from skips s join known k on s.less = k.word
 union all select k.word, s.word, s.n from skips s join known k on s.less = k.word)),
judged as (select one, count(*) n_near, min(struct_pack(less := -n, other := other)) best from near group by one),
formed as materialized (select k.word, k.n, coalesce(n_near, 0) n_near, case when -best.less >= {variants.TIMES} * k.n then best.other end form,
 case when -best.less >= {variants.TIMES} * k.n then -best.less end form_n from known k left join judged j on k.word = j.one),
chain as (select word, word reached from formed union all select c.word, f.form from chain c join formed f on c.reached = f.word where f.form is not null),
roots as (select c.word, c.reached root from chain c join formed f on c.reached = f.word where f.form is null)
select f.word, f.form, r.root, f.n, f.n_near, cast(f.form_n as double) form_n from formed f join roots r on f.word = r.word"""

COLLOCATIONS = rf"""with pieces as (select coalesce(lang, '{collocations.UNKNOWN}') lang, unnest(string_split_regex({_FOLDED}, '[.,;:!?\x0A-\x0D]')) piece from documents where text is not null),
worded as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
known as materialized (select lang, size, phrase, count(*) a from (
 select lang, 1 size, unnest(w) phrase from worded
 union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from worded
 union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from worded) group by all),
totals as (select lang, sum(a) n from known where size = 1 group by lang),
found as materialized (select lang, phrase, a, string_split(phrase, ' ') w from known where size > 1 and a >= {collocations.LEAST}),
cuts as (select lang, phrase, a, w, unnest(range(1, len(w))) k from found),
sides as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') one, array_to_string(w[k + 1:], ' ') two from cuts),
scored as (select s.lang, s.phrase, s.a, k, x.a l, y.a r, ({collocations._MILLION}::hugeint * s.a * s.a) // (x.a::hugeint * y.a) score
 from sides s join known x on x.lang = s.lang and x.phrase = s.one join known y on y.lang = s.lang and y.phrase = s.two),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, max(a) most, phrase from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) phrase from found where len(w) = 3) group by lang, phrase),
kept as (select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where i.most is null or 100 * i.most < {collocations.COVERED} * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as "rank", phrase, a, l, r, cast(t.n as bigint) n, cast(score as bigint) score
 from kept join totals t using (lang) qualify "rank" <= {collocations.TOP}"""

NGRAMS = rf"""with recursive worded as (select doc_id, coalesce(regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+'), []) w from documents),
grams as materialized (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
 when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from worded),
sizes as materialized (select doc_id, count(*) n from grams group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
sided as materialized (select a, b from links union all select b, a from links),
reached as (select a id, b other from sided union select r.id, s.b from reached r join sided s on s.a = r.other)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, least(d.doc_id, coalesce(c.least_id, d.doc_id)) component_id
 from documents d left join sizes s on s.doc_id = d.doc_id left join (select id, min(other) least_id from reached group by id) c on c.id = d.doc_id"""

ORACLES = {
    "op8_ngram_join": NGRAMS,
    "op4_sharding": SHARDING,
    "op6_mixing": MIXING,
    "op11_spelling_variants": VARIANTS,
    "op12_collocations": COLLOCATIONS,
}
