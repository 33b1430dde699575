"""The thin queries of this subpackage, one for each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import conversations, decontaminate, divergence, licenses, line_dedup, mixing, pieces, quality, quality_rules, sharding, simhash, url_filter, warc
from quern.llm.common import n_words, stored, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the cleaned texts; removed lines as their number and first span."""
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_lines",
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
        F.length("clean").alias("clean_chars"),
        F.md5("clean").alias("clean_md5"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, verdict and a digest of the text left."""
    return quality_rules.clean(table(spark, sf_dir, "documents"), texts=False).drop("clean")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(stored(sized, "sized"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of a text's ids, and the digest of what they decode to."""
    encoded = pieces.encode(table(spark, sf_dir, "documents"))
    counted = encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return pieces.decode(counted).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.accounts(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_licenses": op5_licenses,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_divergence": op11_divergence,
    "op12_pieces": op12_pieces,
    "op13_conversations": op13_conversations,
}

_TEMPLATES = ", ".join(f"({k}, '{t.license}', '{t.kind}', '{t.text}')" for k, t in enumerate(licenses.TEMPLATES))
_PHRASES = "|".join(quality_rules.BOILERPLATE)
_LISTED = ", ".join(f"'{p}'" for p in quality_rules.BOILERPLATE)

SQL: dict[str, str] = {
    "op1_url_filter": r"""
        with parsed as (
            select page_id, coalesce(url, '') as url,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*(.*)\z', 1) as rest
            from pages
        ), stepped as (
            select *, string_split(path, '/') as steps, string_split(regexp_extract(rest, '(?s)^\?([^#]*)', 1), '&') as q from parsed
        ), kinds as (
            select *, list_concat([
                ['scheme=', regexp_extract(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?s)^([a-z0-9+.-]*)://', 1)],
                ['host=', host], ['domain=', regexp_extract(host, '([^.]+\.[^.]+)\z', 1)],
                ['file=', regexp_replace(steps[-1], '(?s)\.[^.]*\z', '')],
                ['ext=', regexp_extract(path, '\.([A-Za-z0-9]{1,8})\z', 1)], ['fragment=', regexp_extract(rest, '(#)', 1)]],
                list_transform(string_split(host, '.'), lambda x: ['part=', x]),
                list_transform(steps[2:len(steps) - 1], lambda x, i: ['dir' || i || '=', x]),
                list_transform(q, lambda x: ['query=', regexp_extract(x, '(?s)^([^=]*)', 1)]),
                list_transform(list_filter(q, lambda x: regexp_matches(x, '(?s)=.*[^0-9]')), lambda x: ['pair=', x])) as kv
            from stepped
        ), rowed as (
            select *, list_distinct(list_transform(list_filter(kv, lambda x: x[2] <> '' and not regexp_matches(x[2], '^[0-9]+\z')), lambda x: x[1] || x[2])) as tokens,
                   try_cast(regexp_extract(path, '/([0-9]+)(/|[.][a-z]+)?\z', 1) as bigint) as number,
                   row_number() over () as r
            from kinds
        ), known as (
            select doc_id, avg(quality) < 0.5 as bad from labels where quality is not null group by doc_id
        ), labelled as (
            select r, tokens, bad from rowed join known on doc_id = number
        ), n as (
            select count(*) filter (bad) as b, count(*) filter (not bad) as g, greatest(ceil(0.002 * count(*)), 5) as least from labelled
        ), sets as (
            select r, bad, list_sort(list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1)) as ante
            from (select r, bad, tokens, unnest(range(1, 1 << len(tokens))) as mask from labelled)
        ), counted as (
            select ante, count(*) filter (bad) as b, count(*) filter (not bad) as g from sets group by ante
        ), mined as (
            select ante, counted.b >= least and counted.b * n.g >= 4 * counted.g * n.b as blocks from counted, n
            where n.b > 0 and n.g > 0 and (counted.b >= least and counted.b * n.g >= 4 * counted.g * n.b or counted.g >= least and counted.g * n.b >= 2 * counted.b * n.g)
        ), hits as (
            select r, max(case when blocks then 'block' else 'allow' end) as mined from rowed, mined where list_has_all(tokens, ante) group by r
        ), rules(verdict, rhost, rpath) as (
            values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), best as (
            select r, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
            from rowed join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by r
        )
        select page_id, host, path, rule, mined, coalesce(verdict, mined, 'allow') as verdict
        from rowed left join best using (r) left join hits using (r)
    """,
    "op2_line_dedup": """
        with docs as (
            select doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \\t\\r\\x0b\\x0c')), lambda x: x <> '') as l
            from documents
        ), windows as (
            select doc_id, p, least(len(l), 3) as n, l[p + 1] as a, l[p + 2] as b, l[p + 3] as c
            from (select doc_id, l, unnest(range(0, greatest(len(l) - 2, 1))) as p from docs where len(l) > 0)
        ), later as (
            select doc_id, p, n from (select doc_id, p, n, row_number() over (partition by n, a, b, c order by doc_id, p) as k from windows) where k > 1
        ), covered as (
            select doc_id, list_sort(list_distinct(list(q))) as q from (select doc_id, unnest(range(p, p + n)) as q from later) group by doc_id
        ), joined as (
            select d.doc_id, l, q,
                   case when q is null then text else array_to_string(list_filter(l, lambda x, i: not list_contains(q, i - 1)), chr(10)) end as clean
            from docs d left join covered c using (doc_id)
        )
        select doc_id, len(l)::int as n_lines, coalesce(len(q), 0)::int as n_removed,
               coalesce(len(list_filter(q, lambda x: not list_contains(q, x - 1))), 0)::int as n_spans,
               length(clean)::int as clean_chars, md5(clean) as clean_md5
        from joined
    """,
    "op3_quality_rules": rf"""
        with docs as (
            select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
        ), words as (
            select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs
        ), triples as (
            select r, p, w[p] as a, w[p + 1] as b, w[p + 2] as c from (select r, w, unnest(range(1, len(w) - 1)) as p from words)
        ), again as (
            select r, p, count(*) over (partition by r, a, b, c) as n from triples
        ), repeats as (
            select r, count(distinct q) as n_repeat_words from (select r, unnest([p, p + 1, p + 2]) as q from again where n > 1) group by r
        ), lines as (
            select r, i, raw, trim(raw, E' \t\x0b\x0c\r') as line, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') as w
            from (select r, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as i from docs)
        ), ruled as (
            select r, i, raw, len(w) as n,
                   (not regexp_matches(line, '[.!?:;…]["''”’»)\]]*\z') and (len(w) < 20 or not regexp_matches(line, '[.!?]')))
                   or (len(list_filter(w, lambda x: x in ('|', '»', '›', '>', '•', '·'))) >= 3 and 5 * len(list_filter(w, lambda x: x in ('|', '»', '›', '>', '•', '·'))) >= len(w))
                   or 2 * (length(line) - length(translate(line, '#*$%&|<>', ''))) >= len(w)
                   or (len(w) >= 3 and not regexp_matches(line, '\p{{Ll}}') and regexp_matches(line, '\p{{Lu}}'))
                   or (len(w) >= 10 and 3 * len(list_distinct(w)) < len(w))
                   or (regexp_matches(lower(line), '{_PHRASES}') and 4 * list_sum([case when contains(lower(line), p) then len(string_split(p, ' ')) else 0 end for p in [{_LISTED}]]) >= len(w)) as fails
            from lines where len(w) > 0
        ), left_over as (
            select r, sum(case when fails then 0 else n end) as kept_words, md5(coalesce(string_agg(raw, chr(10) order by i) filter (not fails), '')) as clean_md5 from ruled group by r
        ), dups as (
            select r, count(*) - count(distinct line) as n_dup_lines
            from (select r, line from (select r, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]')) group by r
        ), counted as (
            select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                   (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
                   coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
                   coalesce(kept_words, 0)::bigint as kept_words, coalesce(clean_md5, md5('')) as clean_md5
            from words left join repeats using (r) left join dups using (r) left join left_over using (r)
        )
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 2 * kept_words >= n_words as kept
        from counted
    """,
    "op5_licenses": rf"""
        with docs as (
            select row_number() over () as r, doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents
        ), units as (
            select r, 0 as line, text as u from docs where len(lines) > 1
            union all select r, i, lines[i] from (select r, lines, unnest(range(1, len(lines) + 1)) as i from docs)
            union all select -k - 1, 0, t from (values {_TEMPLATES}) v(k, license, kind, t)
        ), normal as (
            select r, line, list_filter(string_split(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda x: x <> '') as w
            from units
        ), bigrams as (
            select r, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from normal where len(w) > 1
        ), scored as (
            select x.r, x.line, -y.r - 1 as k, 200 * len(list_intersect(x.b, y.b)) / (len(x.b) + len(y.b)) as dice
            from bigrams x, bigrams y where x.r > 0 and y.r < 0 and 200 * least(len(x.b), len(y.b)) >= 80 * (len(x.b) + len(y.b))
        ), ranked as (
            select *, row_number() over (partition by r order by dice desc, line, k) as place, count(*) over (partition by r, line) as x,
                   count(distinct line) over (partition by r) as n_notices
            from scored where dice >= 80
        )
        select doc_id, license, kind, line::int as line, round(dice / 100, 6) as dice, coalesce(n_notices, 0)::int as n_notices
        from docs left join (select * from ranked where place = 1) using (r)
        left join (values {_TEMPLATES}) v(k, license, kind, t) using (k)
    """,
    "op4_warc": """
        with rows as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
        ), first as (
            select payload_digest, min(page_id) as first from rows where payload_bytes >= 100 group by payload_digest having count(*) > 1
        )
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
               case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
               case when page_id is distinct from first then first end as refers_to
        from rows left join first using (payload_digest)
    """,
    "op10_mixing": r"""
        with sized as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                   ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint as draw
            from documents
        ), bysource as (
            select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from sized group by source
        ), weighed as (
            select *, case k % 3 when 0 then 5 when 1 then 2 else 1 end as w, 3 * source_size as cap from bysource
        ), levels as (
            select *, ((sum(source_size) over ())
                       - coalesce(sum(cap) over (order by cap::double / w, k rows between unbounded preceding and 1 preceding), 0))::double
                      / (sum(w) over (order by cap::double / w, k rows between current row and unbounded following))::double as lev
            from weighed
        ), filled as (
            select *, cap <= lev * w as full_up, max(case when not (cap <= lev * w) then lev end) over () as level from levels
        ), targets as (
            select source, source_size, case when full_up then cap::double else level * w end as target,
                   ('0x' || substr(md5('mix:' || coalesce('=' || source, '-')), 1, 8))::bigint / 4294967296.0::double as u
            from filled
        ), classed as (
            select *, greatest(length(bin(size)) - 7, 0)::integer as step, draw % 256 as bucket from sized
        ), placed as (
            select doc_id, source, size,
                   row_number() over (partition by source order by (size >> step) << step, bucket, size, draw, doc_id) as place
            from classed
        )
        select doc_id, size::bigint as size, source_size, target,
               (least(3, floor(u + (case when source_size > 0 then target / source_size else 0 end) * place)
                         - floor(u + (case when source_size > 0 then target / source_size else 0 end) * (place - 1))) * size)::bigint as taken
        from placed join targets on placed.source is not distinct from targets.source
    """,
    "op11_divergence": r"""
        with docs as (
            select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') as w
            from documents
        ), words as (
            select r, lang, source, unnest(w) as term from docs
        ), kept as (
            select lang, term, count(*) as all_n from words group by lang, term having count(distinct r) >= 10
        ), langs as (
            select lang, count(*) as v, sum(all_n) as lang_n from kept group by lang
        ), counts as (
            select lang, source, term, count(*) as n from words join kept using (lang, term) group by all
        ), sizes as (
            select lang, source, sum(n) as group_n from counts group by all
        ), groups as (
            select lang, source, coalesce(group_n, 0) as group_n from (select distinct lang, source from docs) left join sizes using (lang, source)
        ), shares as (
            select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (group_n + 2 * v) as p, 1 + (1000000000::hugeint * (all_n + 2)) // (lang_n + 2 * v) as q
            from groups join langs using (lang) join kept using (lang) left join counts using (lang, source, term)
        ), summed as (
            select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
            from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
        ), rows as (
            select x.lang, x.source, 'pair' as part, y.source as item, coalesce(value, 0) as value
            from groups x join groups y on x.lang = y.lang and x.source <> y.source left join summed s on s.lang = x.lang and s.source = x.source and s.item = y.source
            union all
            select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from shares where n > 0 and p > q
        )
        select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
        from rows qualify part = 'pair' or rank <= 10
    """,
    "op13_conversations": r"""
        with recursive codes as (
            select list(list_reduce(list_prepend(n, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by n) as code from range(256) t(n)
        ), keyed as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
                       lambda c, b: xor(c // 256, code[xor(c, b) % 256 + 1])), 4294967295) % 20 as kind
            from conversations, codes
        ), damaged as (
            select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
                   unnest(range(case kind when 3 then 2 else 1 end)) as again
            from keyed where kind <> 0
        ), seen as (
            select *, row_number() over (partition by conv_id, role, text order by turn nulls first, again) as nth from damaged
        ), rows as (
            select conv_id, turn, role, text, substr(role, 1, 1) as i, row_number() over (partition by conv_id order by turn nulls first, role, text, nth) as k,
                   case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' end as fault
            from seen
        ), pairs as (
            select *, lag(i) over (partition by conv_id order by k) as before from rows
        ), counted as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                   count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal, count(*) as n
            from pairs group by conv_id
        ), all_ids as (
            select distinct conv_id from conversations
        ), inserts(state, place, letters, added) as (
            values (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
                   (2, 2, '', []), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, '', []), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])
        ), moves(place, letter, goal, price, needs, name) as (
            values (0, 'D', 0, 2, null, null), (1, 'D', 1, 2, null, null), (2, 'D', 2, 2, null, null), (3, 'D', 3, 2, null, null),
                   (0, 'K', 1, 0, 's', null), (0, 'K', 2, 0, 'u', null), (1, 'K', 2, 0, 'u', null), (2, 'K', 3, 0, 'a', null), (3, 'K', 2, 0, 'u', null),
                   (0, 'R', 2, 1, null, 'user'), (1, 'R', 2, 1, null, 'user'), (2, 'R', 3, 1, null, 'assistant'), (3, 'R', 2, 1, null, 'user')
        ), steps as (
            select state, goal, letters || letter as letters, letter, 5 * length(letters) + price as price, needs, name, added from inserts join moves using (place)
        ), paths as (
            select conv_id, 0::bigint as k, 0 as state, 0 as cost, '' as audit, []::varchar[] as lines from all_ids
            union all
            select * from (
                select p.conv_id, r.k, s.goal as state, (p.cost + s.price + case when s.letter <> 'D' and r.fault = 'truncated' then 5 else 0 end)::int as cost, p.audit || s.letters as audit,
                       list_concat(p.lines, s.added, case when s.letter = 'D' then [] else [coalesce(s.name, r.role) || ':' || r.text] end) as lines
                from paths p join rows r on p.conv_id is not distinct from r.conv_id and r.k = p.k + 1 join steps s on s.state = p.state
                where (s.letter = 'D' or r.fault is null or r.fault = 'truncated') and (s.needs is null or s.needs = r.i)
                qualify row_number() over (partition by p.conv_id, s.goal order by p.cost + s.price + case when s.letter <> 'D' and r.fault = 'truncated' then 5 else 0 end, p.audit || s.letters) = 1
            )
        ), ended as (
            select conv_id, k, cost + 5 * length(more) as cost, audit || more as audit, list_concat(lines, added) as lines
            from paths join (values (0, '', []), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])) e(state, more, added) using (state)
        ), cheapest as (
            select e.* from ended e left join counted c on c.conv_id is not distinct from e.conv_id where k = coalesce(n, 0)
            qualify row_number() over (partition by e.conv_id order by cost, audit) = 1
        )
        select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               cost::bigint as cost, audit, sha256(array_to_string(lines, chr(10))) as repaired_sha256
        from all_ids a left join counted c on c.conv_id is not distinct from a.conv_id join cheapest e on e.conv_id is not distinct from a.conv_id
    """,
}
