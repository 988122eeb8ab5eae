"""SQL for the queries that SQL can express, for a small copy of the tables: exact forms of what the operators find."""

from __future__ import annotations

from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, Bounds
from .url_filters import BLOCKED_PARTS

_WORD = "[^\\x20\\x09-\\x0D]+"


def url_filters(host_rules: list[tuple[str, str]]) -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in host_rules)
    parts = ", ".join(f"'{p}'" for p in BLOCKED_PARTS)
    return f"""
with rules(verdict, rule, host, path) as (values {rules}),
a as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
fits as (select a.page_id, r.rule, r.verdict, row_number() over (partition by a.page_id order by length(r.rule) desc, r.rule) as n from a join rules r on (a.host = r.host or a.host like '%.' || r.host) and starts_with(a.path, r.path))
select a.page_id, a.host, a.path, f.rule, case when f.rule is not null then f.verdict when len(list_intersect(regexp_extract_all(translate(a.host || a.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z0-9_%\\x{{80}}-\\x{{10FFFF}}-]+'), [{parts}])) > 0 then 'block' else 'allow' end as verdict
from a left join fits f on f.page_id = a.page_id and f.n = 1"""


def jaccard_join(n: int = 5, threshold: float = 0.8) -> str:
    return f"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words from documents where doc_id is not null),
g as (select distinct doc_id, unnest(case when len(words) >= {n} then list_transform(range(1, len(words) - {n} + 2), lambda i: array_to_string(words[i:i + {n} - 1], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as gram from w),
size as (select doc_id, count(*) as k from g group by 1),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
linked as (select x, y from shared join size s on s.doc_id = x join size t on t.doc_id = y where c >= {threshold} * (s.k + t.k - c) - 1e-9),
edges as (select x, y from linked union all select y, x from linked),
reach as (select doc_id as x, doc_id as y from w union select r.x, e.y from reach r join edges e on e.x = r.y)
select w.doc_id, (select min(y) from reach where reach.x = w.doc_id) as class_id, (select count(*) from edges where edges.x = w.doc_id) as n_links from w"""


def nearest_neighbours(k: int = 20) -> str:
    """Equal to the search where a query's candidates are no more than it reranks."""
    return f"""
with v as (select cast(vec_id as bigint) as vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null),
s as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(c.e, q.e), lambda p: p[1] * p[2]), lambda a, b: a + b) as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= {k}"""


_FINITE = "list_bool_and(list_transform(cast(embedding as double[]), lambda x: x is not null and isfinite(x)))"


def hard_negatives(positives: int = 5, negatives: int = 3) -> str:
    """For integers below 2^31 a component."""
    score = "cast(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) as bigint)"
    return f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as bigint)) as e from embeddings where label is not null and embedding is not null and coalesce({_FINITE}, true)),
s as (select a.vec_id as anchor_id, c.vec_id as other, a.label = c.label as same, {score} as score from v a join v c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= {positives}),
n as (select p.*, s.other as negative_id, s.score as negative_score, cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other) as integer) as rank from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {negatives}"""


def lexical_search(k: int = 50) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select doc_id, {words} as words from documents),
c as (select count(*) as docs, cast(sum(len(words)) as bigint) as total from d where len(words) > 0),
q as (select distinct item_id, unnest({words}) as term from benchmark),
t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(words) as term from d) where term in (select term from q) group by 1, 2),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from t, c group by term, docs),
m as (select doc_id, 100 - 50 + (50 * len(words) * docs) // total as m from d, c where len(words) > 0),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score from q join t using (term) join w using (term) join m using (doc_id) group by 1, 2),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= {k}"""


def near_duplicate_vectors(threshold: float = 0.93) -> str:
    return f"""
with recursive f as (select vec_id, label, cast(embedding as double[]) as e, coalesce({_FINITE}, false) and label is not null as fine from embeddings where vec_id is not null),
v as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from f where fine and list_max(list_transform(e, lambda x: abs(x))) > 0),
edges as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= {threshold}),
reach as (select vec_id as x, vec_id as y from f union select r.x, e.y from reach r join edges e on e.x = r.y),
c as (select x, min(y) as component_id from reach group by x)
select f.vec_id, (select count(*) from edges where edges.x = f.vec_id) as n_links, c.component_id, f.vec_id = c.component_id as kept from f join c on c.x = f.vec_id"""


def _distance(pairs: str, key: str) -> str:
    """Jensen-Shannon distance of shares p and q by key."""
    term = "case when {0} > 0 then {0} * log2({0} / ((p + q) / 2)) else 0 end"
    return f"select {key}, sqrt(greatest(0, sum({term.format('p')} + {term.format('q')}) / 2)) as d from {pairs} group by {key}"


def quality_rules(common_words: int = 100, b: Bounds = Bounds()) -> str:
    """The counts and both distances, rounded as the query rounds them."""
    classes = ["[\\p{Ll}\\p{Lm}\\p{Lo}\\p{M}]", "[\\p{Lu}\\p{Lt}]", "\\p{Nd}", "[ \\t\\r\\x0b\\x0c\\p{Zs}]", "\\n", "[.,;:?!\\x27\\x22()-]"]
    counted = ", ".join(f"len(regexp_extract_all(t, '{p}')) as k{i}" for i, p in enumerate(classes))
    counted = counted.replace(" as k5", " + len(regexp_extract_all(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'), '\\p{P}')) as k5")
    k = [f"k{i}" for i in range(6)]
    rest = f"length(t) - ({' + '.join(k)}) as k6"
    long = lambda table, key, total: " union all ".join(f"select {key}, {i} as class, k{i} / {total} as share from {table}" for i in range(7))
    return f"""
with d as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as win from d, unnest(range(1, len(w) - 1)) as u(i)),
often as (select doc_id, i from windows qualify count(*) over (partition by doc_id, win) > 1),
covered as (select doc_id, count(distinct i + o) as n from often, (values (0), (1), (2)) as x(o) group by 1),
lines as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
base as (select d.doc_id, lang, t, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, {counted}, {rest}
  from d left join covered c using (doc_id) left join lines l using (doc_id)),
langs as (select lang, {', '.join(f'sum(k{i}) as k{i}' for i in range(7))} from base where lang is not null group by 1),
refchars as ({long('langs', 'lang', '(k0 + k1 + k2 + k3 + k4 + k5 + k6)')}),
doclong as ({long('base', 'doc_id', 'nullif(k0 + k1 + k2 + k3 + k4 + k5 + k6, 0)')}),
charpairs as (select doc_id, r.lang, s.share as p, r.share as q from doclong s join refchars r using (class) where s.share is not null),
chardist as (select doc_id, min(d) as d from ({_distance('charpairs', 'doc_id, lang')}) group by 1),
words as (select doc_id, word, count(*) as n from (select doc_id, unnest(w) as word from base) group by 1, 2),
langwords as (select lang, word, sum(n) as n from words join base using (doc_id) where lang is not null group by 1, 2),
top as (select lang, word, n, sum(n) over (partition by lang) as total from langwords qualify row_number() over (partition by lang order by n desc, word) <= {common_words}),
totals as (select lang, sum(n) as total from langwords group by 1),
refwords as (select t.lang, t.word, t.n / a.total as share from (select lang, word, n from top) t join totals a using (lang) union all select a.lang, null, 1 - sum(t.n) / any_value(a.total) from totals a join (select lang, n from top) t using (lang) group by a.lang),
seen as (select b.doc_id, r.lang, r.word, coalesce(x.n, 0) / b.n_words as p, r.share as q from base b cross join (select * from refwords where word is not null) r left join words x on x.doc_id = b.doc_id and x.word = r.word where b.n_words >= {b.min_words}),
wordpairs as (select doc_id, lang, p, q from seen union all select s.doc_id, s.lang, greatest(0, 1 - s.p), r.share from (select doc_id, lang, sum(p) as p from seen group by all) s join refwords r on r.lang = s.lang and r.word is null),
worddist as (select doc_id, min(d) as d from ({_distance('wordpairs', 'doc_id, lang')}) group by 1),
judged as (select b.*, case when k0 + k1 + k2 + k3 + k4 + k5 + k6 >= {b.min_chars} then c.d end as cd, x.d as wd, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from base b left join chardist c using (doc_id) left join worddist x using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 4) as char_distance, round(wd, 4) as word_distance,
  not base_failed and coalesce(cd <= {b.char_distance}, true) and coalesce(wd <= {b.word_distance} + {b.word_spread} / sqrt(n_words), true) as kept from judged"""
