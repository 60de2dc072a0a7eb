"""DuckDB SQL with the results that the queries must give."""

from __future__ import annotations

NGRAM_JOIN = r"""
with recursive worded as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
    from documents
), sets as (
    select doc_id, case when len(words) = 0 then []
        when len(words) < 3 then [array_to_string(words, ' ')]
        else list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]
                            for i in range(1, cast(len(words) - 1 as bigint))]) end as shingles
    from worded
), sized as (
    select doc_id, cast(len(shingles) as bigint) as n from sets
), tokens as (
    select doc_id, unnest(shingles) as token from sets
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as shared
    from tokens a join tokens b using (token) where a.doc_id <> b.doc_id group by 1, 2
), links as (
    select a, b from common join sized x on x.doc_id = a join sized y on y.doc_id = b
    where 100 * shared >= 90 * (x.n + y.n - shared)
), reach as (
    select doc_id, doc_id as other from sized
    union
    select reach.doc_id, links.b from reach join links on links.a = reach.other
)
select sized.doc_id, any_value(n) as n_shingles, min(other) as component_id,
       cast(coalesce(any_value(degree), 0) as bigint) as n_links
from sized join reach using (doc_id)
left join (select a, count(*) as degree from links group by a) on a = sized.doc_id
group by sized.doc_id
"""

MIX_SOURCES = r"""
with sized as (
    select doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
    from documents
), sources as (
    select source, cast(sum(size) as bigint) as source_size from sized group by source
), turned as (
    select *, row_number() over (order by source nulls last) as turn from sources
), weighted as (
    select *, cast([1, 2, 3][cast((turn - 1) % 3 as int) + 1] as double) as weight from turned
), levels as (
    select *, row_number() over fill as place,
           (sum(source_size) over () - coalesce(sum(3 * source_size) over
                (order by source_size / weight, turn rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (order by source_size / weight, turn
                rows between current row and unbounded following) as level
    from weighted window fill as (order by source_size / weight, turn)
), settled as (
    select min(place) as place from levels where weight * level <= 3 * source_size
), targets as (
    select l.source, source_size,
           case when s.place is null or l.place < s.place then cast(3 * source_size as double)
                else weight * (select level from levels x where x.place = s.place) end as target
    from levels l, settled s
), shares as (
    select *, case when source_size > 0 then target / source_size else 0 end as ratio,
           cast(floor(case when source_size > 0 then target / source_size else 0 end) as bigint) as base
    from targets
), numbered as (
    select d.doc_id, d.source, size, source_size, target, base,
           ratio - base as p, target - base * source_size as rest,
           (cast(('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint)
            + 0.5::double) / 4503599627370496::double as u
    from sized d join shares t on d.source is not distinct from t.source
), ranked as (
    select *, sum(size) over (partition by source
           order by case when p > 0 then (u * (1 - p)) / ((1 - u) * p) end, doc_id, size
           rows between unbounded preceding and current row) as upto
    from numbered
), taken as (
    select *, base + case when p > 0 and (upto <= rest
           or (upto - size < rest and upto - rest < rest - (upto - size))) then 1 else 0 end as copies
    from ranked
)
select doc_id, source, size, source_size, target, cast(copies as bigint) as copies,
       cast(copies * size as bigint) as taken
from taken
"""

_BARE = r"trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

LINE_DEDUP = f"""
with pages as (
    select row_number() over () as page, doc_id, source, text,
           string_split(text, chr(10)) as lines from documents
), marked as (
    select page, source, lines,
           list_transform(lines, lambda x: {_BARE.format('x')}) as bare from pages
), counted as (
    select source, line, count(*) as n
    from (select source, unnest(list_distinct(bare)) as line from marked)
    where line <> '' group by source, line
), bad as (
    select c.source, list(line) as bad
    from counted c join (select source, count(*) as total from pages group by source) t
      on c.source is not distinct from t.source
    where n >= 3 and n / total > 0.02 group by c.source
), fine as (
    select p.*, b.bad,
           case when b.bad is null then p.lines
                else list_filter(p.lines, lambda x: not list_contains(b.bad, {_BARE.format('x')})) end as fine
    from pages p left join bad b on p.source is not distinct from b.source
), whole as (
    select *, case when len(list_filter(fine, lambda x: {_BARE.format('x')} <> '')) > 0
                   then fine else lines end as stay
    from fine
)
select doc_id, source, case when text is null then null else array_to_string(stay, chr(10)) end as text,
       cast(coalesce(len(lines), 0) as int) as n_lines,
       cast(coalesce(len(lines) - len(stay), 0) as int) as n_dropped
from whole
"""

# base32 of the SHA-1: every five hex digits are four characters
ARC_TO_WARC = """
with paged as (
    select page_id, coalesce(html, '') as html from pages
), summed as (
    select page_id, html, octet_length(encode(html)) as payload_bytes, sha1(html) as hex from paged
), coded as (
    select page_id, html, payload_bytes, array_to_string(list_transform(
        list_transform(range(0, 32), lambda i: (cast('0x' || substr(hex, cast((i // 4) * 5 + 1 as int), 5) as bigint)
            >> cast(15 - 5 * (i % 4) as int)) & 31),
        lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v + 1 as int), 1)), '') as payload_digest
    from summed
), first as (
    select payload_digest, payload_bytes, min(page_id) as first_page
    from coded group by payload_digest, payload_bytes
)
select page_id, payload_bytes, payload_digest,
       case when page_id = first_page then 'response' else 'revisit' end as record_type,
       case when page_id = first_page then null else first_page end as refers_to
from coded join first using (payload_digest, payload_bytes)
"""

# two hex digits a byte, so that places in the text are places in bytes
REPEATED_WINDOWS = """
with hexed as (
    select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as hex from documents
), sized as (
    select *, cast(len(hex) // 2 as bigint) as n_bytes from hexed
), windows as (
    select r, i, md5(substr(hex, cast(2 * i + 1 as bigint), 400)) as key
    from sized, lateral (select unnest(range(0, n_bytes - 199)) as i)
), often as (
    select key from windows group by key having count(*) > 1
), gone as (
    select r, i from windows semi join often using (key)
), opened as (
    select r, i, case when lag(i) over (partition by r order by i) >= i - 200 then 0 else 1 end as opens
    from gone
), numbered as (
    select r, i, sum(opens) over (partition by r order by i) as span from opened
), spans as (
    select r, min(i) as first, max(i) + 200 as last from numbered group by r, span
), listed as (
    select r, list(first order by first) as firsts, list(last order by first) as lasts,
           sum(last - first) as n_removed, count(*) as n_spans
    from spans group by r
)
select doc_id, n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(case when n_spans is null then hex else array_to_string(list_transform(
           range(0, cast(n_spans + 1 as bigint)), lambda k: substr(hex,
               1 + 2 * (case when k = 0 then 0 else lasts[cast(k as int)] end),
               2 * ((case when k = n_spans then n_bytes else firsts[cast(k + 1 as int)] end)
                    - (case when k = 0 then 0 else lasts[cast(k as int)] end)))), '') end)) as kept_sha256
from sized left join listed using (r)
"""

# crc32 of an ASCII string {0}, as bits of a polynomial
_CRC32 = """xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(range(1, cast(len({0}) + 1 as bigint)),
            lambda i: cast(ascii(substr({0}, cast(i as int), 1)) as bigint))),
        lambda c, b: list_reduce(list_concat([xor(c, b)], range(0, 8)),
            lambda d, k: xor(d >> 1, case when d & 1 = 1 then 3988292384 else 0 end))))"""

# equal words q apart: 16 of them in a row at least, so runs are islands of pairs of 16-grams
PERIODIC_RUNS = rf"""
with worded as (
    select row_number() over () as r, doc_id, coalesce(cast(doc_id as varchar), '') as id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as plain
    from documents
), hashed as (
    select r, doc_id, plain, cast(len(plain) as bigint) as n, {_CRC32.format('id')} as h from worded
), planned as (
    select *, case when n > 0 then (h // 10) % n else 0 end as a from hashed
), periods as (
    select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from planned
), final as (
    select r, doc_id, n, case when h % 10 = 0 and n > 0
        then list_transform(range(0, n), lambda i:
            plain[cast(1 + case when i < a then i else a + (i - a) % p end as int)]) else plain end as words
    from periods
), grams as (
    select r, i, md5(array_to_string(words[cast(i + 1 as int):cast(i + 16 as int)], ' ')) as gram
    from final, lateral (select unnest(range(0, n - 15)) as i)
), pairs as (
    select x.r, x.i, y.i - x.i as q from grams x join grams y on x.r = y.r and x.gram = y.gram and x.i < y.i
), islands as (
    select r, q, i, i - row_number() over (partition by r, q order by i) as island from pairs
), stretches as (
    select r, q, min(i) as start, max(i) + 16 + q - min(i) as length from islands group by r, q, island
), runs as (
    select r, start, length, min(q) as period from stretches
    where length >= greatest(24, 3 * q) group by r, start, length
), ranked as (
    select *, row_number() over (partition by r
        order by cast(length as hugeint) * 1000000000000000 // period desc, start, period) as place
    from runs
), listed as (
    select r, count(*) as n_runs,
           string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines
    from runs group by r
), dropped as (
    select distinct r, unnest(range(start + period, start + length)) as i from runs
), left_over as (
    select r, string_agg(words[cast(i + 1 as int)], ' ' order by i) as text
    from (select r, words, unnest(range(0, n)) as i from final) anti join dropped using (r, i) group by r
)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period,
       length * 1000 // period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
       sha256(coalesce(o.text, '')) as collapsed_sha256
from final left join listed using (r)
left join (select * from ranked where place = 1) using (r)
left join left_over o using (r)
"""

CONVERSATION_TRIE = f"""
with plain as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn
    from conversations where conv_id is not null
), numbered as (
    select conv_id, md5(concat(len(role), ':', role, text)) as said, octet_length(encode(text)) as n_bytes,
           row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as j
    from plain
), ids as (
    select conv_id, cast(conv_id as varchar) as id, count(*) as n from numbered group by conv_id
), planned as (
    select conv_id, conv_id - conv_id % 5 as base, {_CRC32.format('id')} % 9 as h from ids
), taken as (
    select p.*, least(h, coalesce(n, 0)) as taken from planned p left join ids b on b.conv_id = p.base
), turns as (
    select t.conv_id, j as place, said, n_bytes from taken t join numbered x on x.conv_id = t.base and j < h
    union all
    select t.conv_id, j - h + taken, said, n_bytes from taken t join numbered x on x.conv_id = t.conv_id and j >= h
), whole as (
    select ids.conv_id, coalesce(list(said order by place) filter (said is not null), []) as said,
           coalesce(list(n_bytes order by place) filter (said is not null), []) as sizes
    from ids left join turns on turns.conv_id = ids.conv_id group by ids.conv_id
), members as (
    select conv_id, d, md5(array_to_string(said[:cast(d as int)], ',')) as key, len(said) as depth_of,
           case when d = 0 then 0 else sizes[cast(d as int)] end as n_bytes,
           case when d = 0 then null else md5(array_to_string(said[:cast(d - 1 as int)], ',')) end as above
    from whole, lateral (select unnest(range(0, cast(len(said) + 1 as bigint))) as d)
), nodes as (
    select d, key, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, any_value(n_bytes) as n_bytes,
           coalesce(string_agg(conv_id, ',' order by conv_id) filter (depth_of = d), '') as ends
    from members group by d, key
), linked as (
    select n.*, (select count(*) from nodes c where c.d = n.d + 1 and c.above = n.key) as n_children,
           (select p.conv_id from nodes p where p.d = n.d - 1 and p.key = n.above) as parent_conv_id
    from nodes n
), sums as (
    select m.d, m.key, sum((u.n_convs - 1) * u.n_bytes) as saved_tokens,
           count(*) filter (u.n_children = 0) as n_leaves
    from linked u join members m on m.conv_id = u.conv_id and m.d <= u.d group by m.d, m.key
)
select conv_id, d as depth, parent_conv_id, n_convs, n_children, n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, sha256(ends) as ends_sha256
from linked join sums using (d, key)
"""
